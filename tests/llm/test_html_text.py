import html
import random
import re

from quillmesh.llm import html_text as h


def text_of(source):
    return h.Page(source).text()


def test_rules_of_the_text():
    page = (
        '<html><head><title>T</title><style>p{}</style><script>var a="</p><article>no</article>";</script></head><body>'
        '<header>Site</header><nav><ul><li><a href="/">Menu</a></ul></nav><div class="ad">Buy</div><div id="cookie-notice">Cookies</div>'
        '<article class="post"><h1>Head &amp; line</h1><p>One <b>two</b>&nbsp;three<br>four\n  five<p>Six&#33;<div class="share">Share</div>'
        '<aside>Side</aside><ul><li>a<li>b</ul><table><tr><td>x<td>y</table><form>Mail <input></form><section class="comments"><p>Nice!</p></section>'
        "<pre>7 &lt; 8</pre></article><footer>&copy;</footer></body></html>"
    )
    assert text_of(page) == "Head & line\nOne two three four five\nSix!\na\nb\nx\ny\n7 < 8"
    assert text_of("plain  text &lt;") == "plain text <"
    article = '<article><header class="entry-header"><h1>Head</h1></header><div class="article-header">Sub</div><p>x</p><footer>Tags</footer><nav>n</nav></article>'
    assert text_of(f'<div class="header">Site</div>{article}<main><p>y</p></main>') == "Head\nSub\nx"
    assert text_of('<body><h1>Only</h1><div class="content"><p>z</p></div><div class="sidebar"><p>no</p></div></body>') == "Only\nz"
    assert text_of("") == ""
    assert text_of("<p>cut <b>off") == "cut off"
    assert text_of('<div><p>a</div><p class="x>b</p>') == "a\nb"
    assert text_of("<div>" * 5000 + "deep" + "</div>" * 5000) == "deep"


def test_deep_nests_end_where_they_end():
    nest = "<div>" * 150 + "deep" + "</div>" * 150
    assert text_of(f"<div><article><p>a</p>{nest}<p>b</p></article><p>out</p></div>") == "a\ndeep\nb"
    below = "<div>" * 150 + '<nav>menu</nav><div class="ad">buy</div><form>mail</form><p>kept</p>' + "</div>" * 150
    assert text_of(f"<article>{below}<p>b</p></article>") == "kept\nb"
    assert text_of("<div>" * 150 + "<article><p>in</p></article><p>out</p>" + "</div>" * 150) == "in"
    assert text_of("<ul><li>" * 3000 + "x" + "</ul>" * 3000 + "<p>y") == "x\ny"


def wrapper(*pages):
    whole = h.loaded(h.dumped(h.expression(pages[0])))
    for page in pages[1:]:
        whole = h.merge(whole, h.loaded(h.dumped(h.expression(page))))
    return whole


def through(*pages):
    says = h.decided(wrapper(*pages))
    return [h.Page(p).text(says) for p in pages]


def test_class_words_are_whole_names_around_an_article():
    assert text_of('<div class="layout with-sidebar"><article>x</article></div>') == "x"
    assert text_of('<div class="layout-sidebar"><article>x</article></div><div class="left-sidebar">y</div>') == "x"
    assert text_of('<div class="no-comments"><main>x</main></div>') == "x"
    assert text_of('<div class="no-comments"><p>x</p></div><div class="user-comments"><p>y</p></div>') == "x"
    assert text_of('<form id="all"><article>x<form>Mail</form></article></form>') == "x"


def test_inline_and_hidden_elements():
    page = '<p>a <span class="ad">Buy <span>it</span> now</span> b <a class="share-button">Share</a><a href="x">c</a></p><div hidden>no</div><p style="display: none">no</p><i aria-hidden="true">x</i>d'
    assert text_of(page) == "a b c\nd"
    assert text_of('<p data-x="is hidden" class="lead">kept</p>') == "kept"
    assert text_of('<p><span class="ad">never closed</p><p>kept</p>') == "kept"
    below = "<div>" * 5000 + "<nav>menu</nav><p>deep</p>" + "</div>" * 5000
    assert through(f"<article><p>one</p>{below}</article><p>out</p>", f"<article><p>two</p>{below}</article><p>out</p>") == ["one\ndeep", "two\ndeep"]


def test_expressions_are_union_free():
    def shape(*pages):
        page = h.Page("".join(pages))
        names = {page.path[k]: page.tag[k] for k in range(1, len(page.tag))}
        return [" ".join(names[p] for p in i[0]) + ("!" if i[1] else "") + "+" * i[2] + "?" * i[3] for i in wrapper(*pages)["items"]]

    assert shape("<ul><li>a<li>b<li>c</ul><p>x</p>", "<ul><li>d</ul><hr><p>x</p>") == ["li+", "p!"]
    assert shape("<ul><li>a</ul><p>x</p>", "<ul><li>d</ul><h2>new</h2><p>y</p>") == ["li", "h2?", "p"]
    assert shape("<dl><dt>a<dd>b<dt>c<dd>d</dl>", "<dl><dt>e<dd>f</dl>") in (["dt dd+?", "dt?", "dd?"], ["dt dd+"])


def test_alignment_is_one_whatever_the_order():
    rng = random.Random(8)
    pages = []
    for k in range(12):
        extra = "".join(rng.choice([f"<div><p>z{k}</p></div>", f"<h2>t{k}</h2>", f"<p>q{rng.random()}</p>"]) for _ in range(rng.randint(0, 4)))
        pages.append(f"<body><p>top</p>{extra}<div class='c'><p>text {k}</p>{extra}<p>more {k}</p></div><p>Acme Corp 1999</p></body>")
    first = h.decided(wrapper(*pages))
    for _ in range(5):
        rng.shuffle(pages)
        assert h.decided(wrapper(*pages)) == first
    assert {d for _, d in first["template"]} == {h.digest("top"), h.digest("Acme Corp 1999")}


def test_wrappers_decide_the_text():
    line = "<p>Acme Corp 1999 - all rights</p>"
    two = [f"<body><p>Story one is here</p><p>and goes on</p>{line}</body>", f"<body><p>Another story</p>{line}</body>"]
    assert [text_of(p) for p in two] == ["Story one is here\nand goes on\nAcme Corp 1999 - all rights", "Another story\nAcme Corp 1999 - all rights"]
    assert through(*two) == ["Story one is here\nand goes on", "Another story"]
    # The region from slots: what varies much, and the heading above it.
    many = [f"<body><h1>Head {k}</h1><div>by {k}</div><div class='x'><p>{'w ' * 50}{k}</p><ul><li>{'v ' * 50}{k}</ul></div></body>" for k in range(3)]
    assert through(*many)[1] == "\n".join(["Head 1", "w " * 50 + "1", "v " * 50 + "1"])
    # Inside article elements a line goes once MANY unlike pages repeat it, and never most of a text.
    said = [f"<article><p>{'story ' * 20}{k}</p><div>Follow us</div></article>" for k in range(h.MANY)]
    assert through(*said)[0] == ("story " * 20 + "0").strip() and through(*said[:2])[0].endswith("Follow us")
    near = [f"<article><p>{'the same text ' * 9}</p><p>{k}</p></article>" for k in range(20)]
    assert through(*near)[3].startswith("the same text")
    assert through("<body><p>one</p></body>", "<body><p>one</p></body>") == ["one", "one"]  # nothing else would be left


def test_expressions_are_bounded(monkeypatch):
    monkeypatch.setattr(h, "MOST_PATHS", 40)
    name = lambda k: chr(97 + k % 26) + chr(97 + k // 26)
    pages = ["<body>" + "".join(f"<div class='x{name((37 * k + j) % 600)}'>s{k}.{j}</div>" for j in range(30)) + f"<main><p>text {k}</p></main></body>" for k in range(40)]
    whole = wrapper(*pages)
    assert len(whole["paths"]) <= 40 and len(whole["items"]) <= 80
    assert through(*pages) == [f"text {k}" for k in range(40)]


def test_wrappers_fold_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(h, "FOLD", 3)
    rng = random.Random(1)
    rows = []
    for k in range(120):
        extra = "".join(rng.choice(["<div><p>z</p></div>", "<hr>", "<section><p>q</p></section>", "<h2>t</h2>"]) for _ in range(rng.randint(0, 4)))
        rows.append((k, f"http://host{k % 2 if k > 60 else 0}.example/{k}", f"<body>{extra}<div id='c{k}'><article><p>text {k}</p></article></div></body>"))
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = {r.host: h.loaded(r.wrapper) for r in h.wrappers(frame).collect()}
    assert set(found) == {"host0.example", "host1.example"}
    for host, whole in found.items():
        own = [r[2] for r in rows if host in r[1]]
        assert whole["unlike"] == len(own) and h.decided(whole)["mains"] == h.decided(wrapper(*own))["mains"]
    assert {r.page_id: r.text for r in h.html_text(frame).collect()} == {k: f"text {k}" for k, _, _ in rows}


def plain(source):
    """The article of this table's pages by its own marks, without a tree."""
    body = re.search(r"<article>(.*?)</article>", source, re.S)[1]
    blocks = re.split(r"</?(?:h1|p)>", re.sub(r"</?b>", "", body).replace("<br>", " "))
    return "\n".join(x for x in (" ".join(html.unescape(b).split()) for b in blocks) if x)


def test_query_on_the_table(spark, sf_dir):
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    rows = h.op5_html_text(spark, sf_dir).collect()
    assert sorted(r.page_id for r in rows) == sorted(pages)
    for r in rows:
        assert r.text == plain(pages[r.page_id].html) and r.n_chars == len(r.text) and r.url == pages[r.page_id].url


def test_nulls_repeats_clashing_columns_and_empty(spark):
    frame = spark.createDataFrame(
        [(1, None, None, "x"), (None, "http://a.example/", "<p>é &am", "x"), (2, "//b.example", "", "x"), (3, "nonsense", "<p>w</p>" * 50_000, "x"), (3, "nonsense", "<p>w</p>" * 50_000, "x")],
        "page_id long, url string, html string, text string",
    )
    rows = sorted((r.page_id or -1, r.text[:7], r.n_chars) for r in h.html_text(frame).collect())
    assert rows == [(-1, "é &am", 5), (1, "", 0), (2, "", 0), (3, "w\nw\nw\nw", 99_999), (3, "w\nw\nw\nw", 99_999)]
    assert h.html_text(frame.limit(0)).count() == 0
