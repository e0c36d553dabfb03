"""Main text of web pages by union-free wrappers, one a host.

A page's token stream is the sequence of its text blocks, each with the path of elements that holds
it. Streams of one host are aligned pairwise: text that both have at one path, once, is template and
anchors the alignment; between anchors, text at a path that both have becomes a slot, tokens that
come again in a row become a repeated group, tokens that one lacks become optional. What an
expression says then holds for both pages, and it is aligned with the next one. Equal streams are
counted first; hosts are folded in rounds of bounded groups, so a host with a third of all pages is
aligned by many tasks and ends as one wrapper, the same whatever the order or the partitions.

The wrapper tells where the main text lies: the host's article elements, else its main ones, else
the innermost container, once a page, that holds SHARE of the text in slots (and the first-level
headings above it). Template text inside it goes too: on hosts with article or main elements where
MANY unlike pages repeat it and it is at most a quarter of their text, on others where two do. A page
that would be left without text keeps it; a page without the wrapper's region is read on its own, as is one
that is alone on its host: its article elements, else main ones, else all of it.

Rules of the text: menus, page headers and footers, sidebars, notices, adverts, forms, scripts,
styles and reader comments are left out, by element, role, `hidden` and class words (fixed values
below): whole class names, and their parts where the element holds no article; a name that begins
with a word of HAVING ("no-comments", "with-sidebar") tells of something else. Character references
are decoded; white space in a block becomes one space; blocks are trimmed, empty ones go, the rest
are joined by one newline. A line break element is white space.

An expression of over MOST_PATHS paths takes the rarest of them for their parent's; this bounds
what one task holds, and only tells fewer places apart. Nothing is walked by recursion.

Defined cases: a null or empty page has an empty text; a page without mark-up is one block; a null
url is a host of its own; repeated rows give repeated rows; an empty table gives an empty result;
extra columns are not read.
"""

from __future__ import annotations

import html
import json
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.llm.blocks import runs
from quillmesh.runtime import stage, table, unstage

#: Expressions aligned in one go; a host with more is folded in rounds.
FOLD = 64
#: Unlike pages that must all repeat a text before it is taken out of an article element.
MANY = 8
#: Part of the text in slots that the main region holds, where no element names it.
SHARE = 0.8
#: Paths of one expression.
MOST_PATHS = 4000

# Element names and class words, by what HTML means by them.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
HIDDEN = set("script style noscript template svg math canvas iframe object embed audio video head title meta link map".split())
RAW = set("script style noscript template iframe textarea title xmp noframes".split())
BOILERPLATE = set("nav header footer aside form button select option textarea input menu dialog fieldset".split())
ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
WORDS = set(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs "
    "sidebar aside rail widget related recommended teaser header masthead topbar footer bottombar cookie cookies consent gdpr notice notices notification alert popup modal overlay "
    "newsletter subscribe signup login share sharing social comment comments disqus respond replies form search pagination pager tags toc skip".split()
)
#: Words for the head of a page; inside the main text they name the head of an article, which stays.
HEAD = set("header masthead topbar".split())
MAIN = set("article main".split())
#: Words that leave out an inline element.
INLINE_WORDS = set("ad ads adv advert advertisement sponsor sponsored promo banner share sharing social subscribe newsletter cookie cookies consent breadcrumb breadcrumbs pagination pager popup modal skip".split())
#: First words of class names that tell what an element has or lacks, not what it is.
HAVING = set("no non not without with has have is show hide".split())
#: Elements that may be the region of the main text.
CONTAINERS = set("body div section center td main article".split())
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"},
}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "thead": {"table"}, "tbody": {"table"}, "tfoot": {"table"}, "option": {"select"}}

ATTRIBUTES = r"""[^>"']*(?:"[^"]*"[^>"']*|'[^']*'[^>"']*)*"""
TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)({ATTRIBUTES}|[^>]*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"'<>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
TELLING = re.compile(r"\b(?:class|id|role|hidden|style)\b", re.I)
UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
SPACE = re.compile(r"\s+")


def attributes_of(source: str | None) -> dict[str, str]:
    out: dict[str, str] = {}
    if source and TELLING.search(source):
        for name, a, b, c in ATTRIBUTE.findall(source):
            out.setdefault(name.lower(), a or b or c)
    return out


def class_words(attributes: dict[str, str]) -> tuple[set[str], set[str]]:
    """(whole class names and id, parts of those that are compounds), in lower case."""
    names = [n for key in ("class", "id") for n in attributes.get(key, "").lower().split()]
    parts: set[str] = set()
    for name in names:
        words = [w for w in re.split(r"[^a-z]+", name) if w]
        if words and words[0] not in HAVING:
            parts.update(words)
    return set(names), parts


def unseen(attributes: dict[str, str]) -> bool:
    return "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true" or bool(UNSEEN.search(attributes.get("style", "")))


class Page:
    """Elements in page order: `parent`, `tag`, `path` (hashed keys from the root on), `block` (the block element), `out` (left out); `parts` are (node, text) or (node, None) for a boundary.

    Inline elements are nodes only where they are left out or one of their name around them is.
    """

    def __init__(self, source: str):
        self.parent, self.tag, self.path, self.block = [-1], [""], [0], [0]
        self.key_main, self.inside, self.in_article = [False], [False], [False]
        always, by_part = [False], [False]  # left out whatever is inside; left out unless it holds an article
        self.parts: list[tuple[int, str | None]] = []
        stack: list[int] = [0]
        places: dict[str, list[int]] = {}  # where on the stack each element name is open
        at, n = 0, len(source)

        def shut(place: int) -> None:
            while len(stack) > place:
                node = stack.pop()
                places[self.tag[node]].pop()
                if self.block[node] == node:
                    self.parts.append((node, None))

        def push(tag: str, path: int, block: bool) -> int:
            node = len(self.tag)
            self.parent.append(stack[-1])
            self.tag.append(tag)
            self.path.append(path)
            self.block.append(node if block else self.block[stack[-1]])
            self.key_main.append(False)
            self.inside.append(self.inside[stack[-1]])
            self.in_article.append(self.in_article[stack[-1]] or self.tag[stack[-1]] == "article")
            always.append(False)
            by_part.append(False)
            if tag not in VOID:
                places.setdefault(tag, []).append(len(stack))
                stack.append(node)
            return node

        while at < n:
            m = TOKEN.search(source, at)
            if m is None:
                self.parts.append((stack[-1], source[at:]))
                break
            if m.start() > at:
                self.parts.append((stack[-1], source[at : m.start()]))
            at = m.end()
            tag = m[2]
            if tag is None:
                if m[0].startswith("<![CDATA["):
                    self.parts.append((stack[-1], m[0][9:].removesuffix("]]>")))
                continue
            tag = tag.lower()
            if m[1]:
                if places.get(tag):
                    shut(places[tag][-1])
                continue
            if tag in RAW:
                end = re.compile(rf"</{re.escape(tag)}\s*>?", re.I).search(source, at)
                at = end.end() if end else n
                continue
            if tag == "br":
                self.parts.append((stack[-1], " "))
                continue
            attributes = attributes_of(m[3])
            if tag in INLINE:
                if tag in VOID:
                    continue
                quiet = bool(attributes) and (unseen(attributes) or not INLINE_WORDS.isdisjoint(class_words(attributes)[1]))
                if quiet or places.get(tag):
                    always[push(tag, self.path[stack[-1]], False)] = quiet
                continue
            if tag in CLOSES:
                low = max((places[t][-1] for t in SCOPE[tag] if places.get(t)), default=0)
                ends = [places[t][at_least] for t in (*CLOSES[tag], "p") if t in places and (at_least := bisect_right(places[t], low)) < len(places[t])]
                if ends:
                    shut(min(ends))
            else:
                while self.tag[self.block[stack[-1]]] == "p":
                    shut(places["p"][-1])
            whole, parts = class_words(attributes) if attributes else (set(), set())
            label = (attributes.get("class") or attributes.get("id") or "").split()
            role = attributes.get("role", "").lower()
            key = tag + ("." + re.sub(r"\d+", "#", label[0].lower()) if label else "") + (":main" if role == "main" else "")
            inside = self.inside[stack[-1]]
            node = push(tag, xxhash.xxh64_intdigest(key, seed=self.path[stack[-1]]) >> 1, True)
            words = WORDS - HEAD if inside else WORDS
            kind = tag in BOILERPLATE and not (inside and tag == "header")
            if tag not in ("html", "body", "main"):
                always[node] = (kind and tag != "form") or not words.isdisjoint(whole)
                by_part[node] = kind or not words.isdisjoint(parts)
            always[node] = always[node] or tag in HIDDEN or role in ROLES or (bool(attributes) and unseen(attributes))
            self.key_main[node] = tag in MAIN or role == "main"
            self.inside[node] = inside or self.key_main[node]
            self.parts.append((node, None))

        holds = list(self.key_main)
        for k in range(len(self.tag) - 1, 0, -1):
            if holds[k]:
                holds[self.parent[k]] = True
        self.out = [False]
        for k in range(1, len(self.tag)):
            self.out.append(self.out[self.parent[k]] or always[k] or (by_part[k] and not holds[k]))

    def blocks(self) -> list[tuple[int, str]]:
        """(element, text) of every block that isn't left out, in page order."""
        found, buffer, at = [], [], 0
        for node, text in [*self.parts, (0, None)]:
            if text is None:
                if buffer:
                    block = SPACE.sub(" ", html.unescape("".join(buffer))).strip()
                    if block:
                        found.append((at, block))
                    buffer = []
            elif not self.out[node]:
                buffer.append(text)
                at = self.block[node]
        return found

    def kind(self, node: int) -> str:
        """"a": an article element in no other one, "m": a main one, "c": another container."""
        tag = self.tag[node]
        if tag == "article" and not self.in_article[node]:
            return "a"
        return "m" if self.key_main[node] and tag != "article" else "c" if tag in CONTAINERS else ""

    def region(self, wanted: set[int]) -> set[int] | None:
        """The nodes at the wrapper's paths, else the page's own article or main elements; None: the whole page."""
        found = {k for k in range(1, len(self.tag)) if self.path[k] in wanted and not self.out[k] and self.block[k] == k}
        for kind in ("a", "m"):
            if not found:
                found = {k for k in range(1, len(self.tag)) if self.key_main[k] and not self.out[k] and self.kind(k) == kind}
        return found or None

    def text(self, wrapper: dict | None = None) -> str:
        wrapper = wrapper or NO_WRAPPER
        region = self.region(wrapper["mains"])
        inside = [region is None]
        for k in range(1, len(self.tag)):
            inside.append(inside[self.parent[k]] or (region is not None and k in region))
        blocks = [(k, b) for k, b in self.blocks() if inside[k] or (wrapper["inferred"] and self.tag[k] == "h1")]
        if wrapper["template"]:
            blocks = [(k, b) for k, b in blocks if (self.path[k], digest(b)) not in wrapper["template"]] or blocks
        return "\n".join(b for _, b in blocks)


def digest(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) >> 1 or 1


# ---------------------------------------------------------------- union-free expressions
# {"unlike": pages merged, "paths": {path: [parent, kind, repeated, pages]}, "items": [[[path, ...], text, repeated, optional, chars]]}:
# an item's text is a digest where it is template, 0 where it is a slot; a repeated group has more paths than one.


def expression(source: str | None) -> dict:
    """The expression of one page: all of its text is template as yet."""
    page = Page(source or "")
    blocks = page.blocks()
    times = Counter(page.path[k] for k in range(1, len(page.tag)) if page.block[k] == k and not page.out[k])
    paths: dict[int, list] = {}
    for node in [k for k, _ in blocks] + [k for k in range(1, len(page.tag)) if page.key_main[k] and not page.out[k]]:
        while node and page.path[node] not in paths:
            paths[page.path[node]] = [page.path[page.parent[node]], page.kind(node), times[page.path[node]] > 1, 1]
            node = page.parent[node]
    return {"unlike": 1, "paths": paths, "items": [[[page.path[k]], digest(b), False, False, len(b)] for k, b in blocks]}


def dumped(e: dict) -> str:
    return json.dumps([e["unlike"], [[p, *rest] for p, rest in e["paths"].items()], e["items"]], separators=(",", ":"))


def loaded(text: str, pages: int = 1) -> dict:
    """An expression that stands for so many equal pages."""
    unlike, paths, items = json.loads(text)
    if pages > 1:
        for p in paths:
            p[4] *= pages
        for i in items:
            i[4] *= pages
    return {"unlike": unlike, "paths": {p[0]: p[1:] for p in paths}, "items": items}


def matches(x: list, y: list) -> list[tuple[int, int]]:
    """(i, j) with x[i] = y[j], met once in either, in increasing order of both: the longest such run."""
    in_x, in_y = Counter(x), Counter(y)
    at = {token: j for j, token in enumerate(y) if token is not None and in_y[token] == 1}
    pairs = [(i, at[token]) for i, token in enumerate(x) if token in at and in_x[token] == 1]
    ends, last, before = [], [], [-1] * len(pairs)
    for k, (_, j) in enumerate(pairs):
        place = bisect_left(ends, j)
        before[k] = last[place - 1] if place else -1
        ends[place : place + 1] = [j]
        last[place : place + 1] = [k]
    out, k = [], last[-1] if last else -1
    while k >= 0:
        out.append(pairs[k])
        k = before[k]
    return out[::-1]


def grouped(items: list) -> list:
    """Slots with groups of one to four tokens that come again in a row turned into repeated groups."""
    for width in (1, 2, 3, 4):
        out: list = []
        k = 0
        while k < len(items):
            here = items[k : k + width]
            tokens = [i[0] for i in here]
            end = k + width
            while len(here) == width and [i[0] for i in items[end : end + width]] == tokens:
                end += width
            if end > k + width:
                all_of = items[k:end]
                out.append([[p for t in tokens for p in t], 0, True, all(i[3] for i in all_of), sum(i[4] for i in all_of)])
                k = end
            else:
                out.append(items[k])
                k += 1
        items = out
    return items


def filled(x: list, y: list) -> list:
    """What lies between two anchors: slots aligned by their paths, the rest optional."""
    x, y = (grouped([[i[0], 0, i[2], i[3], i[4]] for i in side]) for side in (x, y))
    tokens_x, tokens_y = [tuple(i[0]) for i in x], [tuple(i[0]) for i in y]
    out: list = []
    i = j = 0
    for a, b in [*matches(tokens_x, tokens_y), (len(x), len(y))]:
        low = 0
        while i + low < a and j + low < b and tokens_x[i + low] == tokens_y[j + low]:
            low += 1
        high = 0
        while a - high > i + low and b - high > j + low and tokens_x[a - high - 1] == tokens_y[b - high - 1]:
            high += 1
        out += [slot(p, q) for p, q in zip(x[i : i + low], y[j : j + low], strict=True)]
        out += [[p[0], 0, p[2], True, p[4]] for p in (*x[i + low : a - high], *y[j + low : b - high])]
        out += [slot(p, q) for p, q in zip(x[a - high : a], y[b - high : b], strict=True)]
        if a < len(x):
            out.append(slot(x[a], y[b]))
        i, j = a + 1, b + 1
    return grouped(out)


def slot(p: list, q: list) -> list:
    return [p[0], 0, p[2] or q[2], p[3] or q[3], p[4] + q[4]]


def merge(a: dict, b: dict) -> dict:
    """The expression of what either of two stands for."""
    x, y = a["items"], b["items"]
    template = [[(i[0][0], i[1]) if i[1] else None for i in side] for side in (x, y)]
    items: list = []
    i = j = 0
    for p, q in matches(*template):
        items += filled(x[i:p], y[j:q])
        items.append([x[p][0], x[p][1], False, False, x[p][4] + y[q][4]])
        i, j = p + 1, q + 1
    items += filled(x[i:], y[j:])
    paths = dict(a["paths"])
    for path, (parent, kind, repeated, pages) in b["paths"].items():
        own = paths.get(path)
        paths[path] = [parent, kind, repeated, pages] if own is None else [parent, own[1] or kind, own[2] or repeated, own[3] + pages]
    return bounded({"unlike": a["unlike"] + b["unlike"], "paths": paths, "items": items})


def bounded(e: dict, most: int | None = None) -> dict:
    """The rarest paths, innermost first, taken for their parent's where there are more than MOST_PATHS."""
    most = most or MOST_PATHS
    if len(e["paths"]) > most or len(e["items"]) > 2 * most:
        depth: dict[int, int] = {0: 0}
        for path in e["paths"]:
            chain = []
            while path not in depth:
                chain.append(path)
                path = e["paths"][path][0]
            for step, p in enumerate(reversed(chain), depth[path] + 1):
                depth[p] = step
        order = sorted(e["paths"], key=lambda p: (e["paths"][p][3], -depth[p], p))
        gone = set(order[: max(0, len(order) - most // 2)])
        stays = {0: 0}

        def standing(path: int) -> int:
            chain = []
            while path not in stays and path in gone:
                chain.append(path)
                path = e["paths"][path][0]
            end = stays.get(path, path)
            for p in chain:
                stays[p] = end
            return end

        e["items"] = grouped([[[standing(p) for p in i[0]], *([0, True] if any(p in gone for p in i[0]) else i[1:3]), *i[3:]] for i in e["items"]])
        e["paths"] = {p: [standing(v[0]), *v[1:]] for p, v in e["paths"].items() if p not in gone}
        if len(e["items"]) > 2 * most:  # slots alike that don't stand side by side
            slots: dict[tuple, list] = {}
            for i in e["items"]:
                if not i[1]:
                    own = slots.setdefault(tuple(i[0]), [i[0], 0, True, True, 0])
                    own[4] += i[4]
            e["items"] = [i for i in e["items"] if i[1]] + list(slots.values())
    return e


def main_region(e: dict) -> int | None:
    """The innermost container, once a page, that holds SHARE of the text in slots."""
    paths = e["paths"]
    below: dict[int, list[int]] = {}
    for path, (parent, *_) in paths.items():
        below.setdefault(parent, []).append(path)
    total = dict.fromkeys([0, *paths], 0)
    for item in e["items"]:
        if not item[1]:
            for p in item[0]:
                total[p] += item[4] / len(item[0])
    order = [0]
    for path in order:
        order += below.get(path, [])
    for path in reversed(order[1:]):
        total[paths[path][0]] += total[path]
    at, found = 0, None
    while total[0] and below.get(at):
        at = max(below[at], key=lambda p: (total[p], -p))
        if total[at] < SHARE * total[0] or paths[at][2]:
            break
        if paths[at][1]:
            found = at
    return found


def decided(e: dict) -> dict:
    """What a wrapper says of its host's pages: the paths of the main text, whether these were inferred, the template text in it."""
    paths = e["paths"]
    ranks = [(kind == "m", repeated, path) for path, (_, kind, repeated, _) in paths.items() if kind in ("a", "m")]
    mains = [path for *rank, path in ranks if tuple(rank) == min(ranks)[:2]]
    inferred = not mains and e["unlike"] > 1
    if inferred:
        mains = [p for p in [main_region(e)] if p is not None]
    template: list = []
    if e["unlike"] >= (2 if inferred else MANY):
        inside: dict[int, bool] = {0: inferred, **dict.fromkeys(mains, True)}
        for path in paths:
            chain = []
            while path not in inside:
                chain.append(path)
                path = paths[path][0]
            for p in chain:
                inside[p] = inside[path]
        chars = sum(i[4] for i in e["items"] if any(inside[p] for p in i[0]))
        fixed = [i for i in e["items"] if i[1] and not i[3] and inside[i[0][0]]]
        if inferred or 4 * sum(i[4] for i in fixed) <= chars:
            template = [(i[0][0], i[1]) for i in fixed]
    return {"mains": set(mains), "inferred": inferred, "template": set(template)}


NO_WRAPPER = {"mains": set(), "inferred": False, "template": set()}


@lru_cache(maxsize=4096)
def _read_wrapper(text: str | None) -> dict:
    if not text:
        return NO_WRAPPER
    mains, inferred, template = json.loads(text)
    return {"mains": set(mains), "inferred": inferred, "template": {tuple(t) for t in template}}


# ---------------------------------------------------------------- DataFrames


def host_of(url):
    return F.coalesce(F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1)), F.lit(""))


def wrappers(pages: DataFrame) -> DataFrame:
    """(host, wrapper): the union-free expression of each host's pages, as JSON; staged."""

    def express(batches):
        for batch in batches:
            out = [dumped(expression(h)) for h in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["host", "wrapper"])

    def read(batch):
        text = np.empty(batch.num_rows, object)
        text[:] = batch.column("wrapper").to_pylist()
        host = np.empty(batch.num_rows, object)
        host[:] = batch.column("host").to_pylist()
        return [host, batch.column("part").to_numpy(), batch.column("n").to_numpy(), text]

    def fold(batches):
        for host, _, n, text in runs(batches, 2, read):
            whole = loaded(text[0], int(n[0]))
            for k in range(1, len(text)):
                whole = merge(whole, loaded(text[k], int(n[k])))
            yield pa.RecordBatch.from_arrays([pa.array([host[0]]), pa.array([dumped(whole)])], names=["host", "wrapper"])

    pages = pages.select(host_of(F.col("url")).alias("host"), "html")
    found = pages.mapInArrow(express, "host string, wrapper string").groupBy("host", "wrapper").agg(F.count("*").alias("n"))
    before = None
    while True:
        found = stage(found, "expressions")
        if before is not None:
            unstage(before)
        before = found
        parts = found.groupBy("host").agg(F.ceil(F.count("*") / FOLD).cast("long").alias("parts"), F.count("*").alias("each"))
        most = parts.agg(F.max("each")).first()[0] or 0
        if most <= 1:
            return found.select("host", "wrapper")
        grouped = found.join(parts.select("host", "parts"), "host").withColumn("part", F.pmod(F.xxhash64("wrapper"), F.col("parts")))
        grouped = grouped.select("host", "part", "n", "wrapper").repartition("host", "part").sortWithinPartitions("host", "part", "wrapper")
        found = grouped.mapInArrow(fold, "host string, wrapper string").withColumn("n", F.lit(1).cast("long"))


def verdicts(found: DataFrame) -> DataFrame:
    """(host, wrapper): what each wrapper says, a few paths and texts."""

    def decide(batches):
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                says = decided(loaded(text))
                out.append(json.dumps([sorted(says["mains"]), says["inferred"], sorted(says["template"])], separators=(",", ":")))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["host", "wrapper"])

    return found.mapInArrow(decide, "host string, wrapper string")


def html_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of pages."""
    found = verdicts(wrappers(pages))
    kinds = {c: pages.schema[c].dataType.simpleString() for c in ("page_id", "url")}

    def read(batches):
        for batch in batches:
            texts = [Page(h or "").text(_read_wrapper(w)) for h, w in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    keyed = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host")).join(found, "host", "left")
    return keyed.select("page_id", "url", "html", "wrapper").mapInArrow(read, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text(table(spark, sf_dir, "pages", "page_id", "url", "html"))
