"""Office packages, batches of pages, cached results and refreshed reports."""

import threading
import zipfile

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillmesh.functions.encoding import encoded
from quillmesh.plans.refresh import Cache, Reports
from quillmesh.sources import packages


def test_docx_keeps_tabs_breaks_tables_and_text_boxes():
    w = packages.WORD[1:-1]
    body = (
        "<w:p><w:r><w:t>a</w:t><w:tab/><w:t>b</w:t><w:br/></w:r><w:r><w:t>c &amp; d</w:t></w:r></w:p><w:p/>"
        "<w:tbl><w:tr><w:tc><w:p><w:r><w:t>cell</w:t></w:r></w:p></w:tc></w:tr></w:tbl>"
        "<w:p><w:r><w:t>out</w:t><w:box><w:p><w:r><w:t>in</w:t></w:r></w:p></w:box></w:r></w:p>"
    )
    content = packages._zipped({"word/document.xml": f'<w:document xmlns:w="{w}"><w:body>{body}</w:body></w:document>'})
    assert [(n, c[0]) for _, n, c in packages.docx_paragraphs(content)] == [(0, "a\tb\nc & d"), (1, ""), (2, "cell"), (3, "in"), (4, "out")]


def test_xlsx_shared_texts_gaps_and_order_of_sheets():
    s, o = packages.SHEET[1:-1], packages.OFFICE[1:-1]
    content = packages._zipped({
        "xl/workbook.xml": f'<workbook xmlns="{s}" xmlns:r="{o}"><sheets><sheet name="two" r:id="b"/><sheet name="one" r:id="a"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="a" Target="worksheets/x.xml"/><Relationship Id="b" Target="/xl/worksheets/y.xml"/></Relationships>',
        "xl/sharedStrings.xml": f'<sst xmlns="{s}"><si><t>plain</t></si><si><r><t>ri</t></r><r><t>ch</t></r><rPh><t>no</t></rPh></si></sst>',
        "xl/worksheets/x.xml": f'<worksheet xmlns="{s}"><sheetData><row r="3"><c r="B3" t="s"><v>1</v></c><c r="AA3" t="b"><v>1</v></c></row><row><c><v>4.5</v></c></row></sheetData></worksheet>',
        "xl/worksheets/y.xml": f'<worksheet xmlns="{s}"><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1"/></row></sheetData></worksheet>',
    })
    assert list(packages.xlsx_rows(content)) == [("two", 0, ["plain", None]), ("one", 2, [None, "rich", *[None] * 24, "TRUE"]), ("one", 3, ["4.5"])]


def test_files_that_cannot_be_read_are_rows(spark, tmp_path):
    (tmp_path / "good.docx").write_bytes(packages.docx_bytes(["ein Text", "zweiter <&> \x01"]))
    (tmp_path / "book.XLSX").write_bytes(b"not matched by the glob")
    (tmp_path / "torn.xlsx").write_bytes(packages.xlsx_bytes("s", [[1, "x", None]])[:40])
    with zipfile.ZipFile(tmp_path / "empty.docx", "w"):
        pass
    got = {(r.path.rpartition("/")[2], r.position): (r.cells, r.error) for r in packages.read_packages(spark, str(tmp_path)).collect()}
    assert got["good.docx", 0] == (["ein Text"], None) and got["good.docx", 1] == (["zweiter <&> "], None)
    assert "BadZipFile" in got["torn.xlsx", None][1] and "KeyError" in got["empty.docx", None][1] and len(got) == 4
    odd = spark.createDataFrame([("a.docx", None, 1), ("b.pdf", b"x", 2), (None, b"x", 3)], "path string, content binary, cells int")
    assert packages.package_rows(odd).where("error IS NULL").count() == 0 and packages.package_rows(odd).count() == 3
    assert packages.package_rows(odd.limit(0)).count() == 0


def test_many_rows_cross_batches(spark):
    rows = [[k, f"n{k}"] for k in range(packages.BATCH + 5)]
    files = spark.createDataFrame([("torn.xlsx", b"x"), ("a.xlsx", packages.xlsx_bytes("s", rows))], "path string, content binary").coalesce(1)
    got = packages.package_rows(files).agg(F.count("*"), F.countDistinct("position"), F.max("position"), F.count("error")).first()
    assert tuple(got) == (len(rows) + 1, len(rows), len(rows) - 1, 1)


def test_page_batches_hold_every_page_once(spark):
    docs = spark.createDataFrame([(1, "abcdefghij"), (2, ""), (3, None), (4, "é" * 7)], "id long, text string")
    pages = packages.pages_of(docs, "id", "text", 3)
    seen = packages.in_page_batches(pages, 2, lambda p: pd.DataFrame({"id": [p["id"].iloc[0]], "text": ["|".join(p["text"])]}), "id long, text string")
    assert sorted(map(tuple, seen.collect())) == [(1, "abc|def"), (1, "ghi|j"), (4, "é"), (4, "ééé|ééé")]


def test_cache_lifetimes():
    now, made, cache = [0.0], [], None

    def fetch():
        made.append(now[0])
        if len(made) == 4:
            raise OSError("gone")
        return len(made)

    cache = Cache(clock=lambda: now[0])
    assert cache.get("k", fetch, 10) == 1
    now[0] = 6.0
    assert cache.get("k", fetch, 10) == 1 and len(made) == 1
    now[0] = 8.0  # past 70 %: the old value now, a new one behind it
    assert cache.get("k", fetch, 10) == 1
    cache.settle()
    assert cache.get("k", fetch, 10) == 2 and made == [0.0, 8.0]
    now[0] = 30.0
    assert cache.get("k", fetch, 10) == 3
    now[0] = 50.0
    assert cache.get("k", fetch, 10) == 3  # the fetch failed: the stale value stays
    assert (cache.hits, cache.misses) == (3, 3)
    with pytest.raises(OSError):
        cache.get("other", lambda: (_ for _ in ()).throw(OSError("none")), 10)


def test_cache_fetches_a_key_once_in_the_background():
    now, gate, made, cache = [0.0], threading.Event(), [], None
    cache = Cache(clock=lambda: now[0])
    cache.get("k", lambda: 0, 10)
    now[0] = 9.0
    for _ in range(5):
        cache.get("k", lambda: (gate.wait(10), made.append(1))[1], 10)
    gate.set()
    cache.settle()
    assert made == [1]


def test_reports_are_made_once_and_keep_their_errors(spark):
    calls = []
    reports = Reports({"a": lambda: (calls.append(1), spark.range(3))[1], "b": lambda: spark.range(1).select("nope")})
    assert {r.report: (r.ok, r.n_rows) for r in reports.status(spark).collect()} == {"a": (True, 3), "b": (False, None)}
    reports.read()
    assert len(calls) == 1 and "nope" in reports.latest["b"].error
    reports.refresh()
    assert len(calls) == 2


def test_encoder_defined_cases(spark):
    docs = spark.createDataFrame([(1, "a a b"), (2, None), (3, "12 ٣"), (4, "A B a")], "id int, text string")
    got = {r.id: r.embedding for r in encoded(docs, 16).collect()}
    assert got[1] == got[4] and abs(sum(x * x for x in got[1]) - 1) < 1e-12
    assert got[2] == got[3] == [0.0] * 16
