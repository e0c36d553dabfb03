"""Office packages (zipped XML) as rows of text, and paged text in batches of a fixed size.

A package is read with the standard library inside the task that holds its bytes; a file that can't
be read gives one row with its error, so that no file is lost and none stops the job.
"""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.catalog import query
from quillmesh.runtime import in_tasks, table

#: Names fixed by the published Office Open XML formats.
WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
OFFICE = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"

ROWS = "path string, part string, position long, cells array<string>, error string"


def docx_paragraphs(content: bytes) -> Iterator[tuple[str, int, list[str]]]:
    """(part, position, [text]) of every paragraph of a document's body, table cells included, in order."""
    with zipfile.ZipFile(io.BytesIO(content)) as package, package.open("word/document.xml") as body:
        open_texts: list[list[str]] = []  # a text box puts paragraphs inside a paragraph
        position = 0
        for event, node in ElementTree.iterparse(body, ("start", "end")):
            if node.tag == WORD + "p":
                if event == "start":
                    open_texts.append([])
                else:
                    yield "body", position, ["".join(open_texts.pop())]
                    position += 1
                    node.clear()
            elif event == "end" and open_texts:
                if node.tag == WORD + "t":
                    open_texts[-1].append(node.text or "")
                elif node.tag == WORD + "tab":
                    open_texts[-1].append("\t")
                elif node.tag in (WORD + "br", WORD + "cr"):
                    open_texts[-1].append("\n")


def column_number(reference: str) -> int:
    """0 for A, 25 for Z, 26 for AA: the letters of a cell's reference."""
    number = 0
    for letter in reference:
        if not letter.isalpha():
            break
        number = number * 26 + ord(letter.upper()) - 64
    return number - 1


def _shared_texts(package: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in package.namelist():
        return []
    out = []
    with package.open("xl/sharedStrings.xml") as part:
        for _, node in ElementTree.iterparse(part):
            if node.tag == SHEET + "si":
                out.append(_plain(node))
                node.clear()
    return out


def _plain(node: ElementTree.Element) -> str:
    """The text of a string item: its runs, without the phonetic ones."""
    runs = [node, *node.findall(SHEET + "r")]
    return "".join(t.text or "" for run in runs for t in run.findall(SHEET + "t"))


def _cell(node: ElementTree.Element, shared: list[str]) -> str | None:
    kind = node.get("t", "n")
    if kind == "inlineStr":
        inline = node.find(SHEET + "is")
        return None if inline is None else _plain(inline)
    value = node.findtext(SHEET + "v")
    if value is None:
        return None
    return shared[int(value)] if kind == "s" else {"0": "FALSE", "1": "TRUE"}.get(value, value) if kind == "b" else value


def xlsx_rows(content: bytes) -> Iterator[tuple[str, int, list[str | None]]]:
    """(sheet, row, cells) of every row of every sheet in the workbook's order; a cell that isn't there is null."""
    with zipfile.ZipFile(io.BytesIO(content)) as package:
        shared = _shared_texts(package)
        links = {r.get("Id"): r.get("Target", "") for r in ElementTree.fromstring(package.read("xl/_rels/workbook.xml.rels"))}
        for sheet in ElementTree.fromstring(package.read("xl/workbook.xml")).iter(SHEET + "sheet"):
            target = links[sheet.get(OFFICE + "id")]
            name = posixpath.normpath(posixpath.join("xl", target)) if not target.startswith("/") else target[1:]
            with package.open(name) as part:
                at = -1
                for _, node in ElementTree.iterparse(part):
                    if node.tag == SHEET + "row":
                        at = int(node.get("r", at + 2)) - 1
                        cells: list[str | None] = []
                        for c in node.findall(SHEET + "c"):
                            k = column_number(c.get("r", "")) if c.get("r") else len(cells)
                            cells.extend([None] * (k + 1 - len(cells)))
                            cells[k] = _cell(c, shared)
                        yield sheet.get("name", ""), at, cells
                        node.clear()


READERS: dict[str, Callable] = {"docx": docx_paragraphs, "xlsx": xlsx_rows}
#: Rows handed to Arrow at once.
BATCH = 10_000
#: Small files that a task writes or reads: a table of few bytes is one split, whatever its files cost.
TASK_FILES = 5_000


def package_rows(files: DataFrame) -> DataFrame:
    """SRC5, SRC8: rows (path, part, position, cells, error) of files (path, content) by their suffix.

    A file that is null, torn, not a package or of another suffix gives one row with its error, after
    the rows that could be read; a file without rows gives none. Extra columns are not read.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []

        def frame() -> pd.DataFrame:
            made = pd.DataFrame(out, columns=["path", "part", "position", "cells", "error"])
            return made.assign(position=made["position"].astype("Int64"))

        for rows in batches:
            for path, content in zip(rows["path"], rows["content"], strict=True):
                try:
                    reader = READERS.get(str(path).rpartition(".")[2].lower())
                    if reader is None or content is None:
                        raise ValueError("no reader for this suffix" if reader is None else "no content")
                    for part, position, cells in reader(bytes(content)):
                        out.append((path, part, position, cells, None))
                        if len(out) >= BATCH:
                            yield frame()
                            out.clear()
                except Exception as error:  # noqa: BLE001  any failure of a file is a row of the result
                    out.append((path, None, None, None, f"{type(error).__name__}: {error}"))
        if out:
            yield frame()

    return files.select("path", "content").mapInPandas(run, ROWS)


def read_packages(spark: SparkSession, folder: str) -> DataFrame:
    """SRC5, SRC8: the rows of every docx and xlsx file under a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{docx,xlsx}").load(folder)
    return package_rows(files)


def _zipped(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as package:
        for name, text in parts.items():
            package.writestr(name, text)
    return out.getvalue()


def docx_bytes(paragraphs: list[str]) -> bytes:
    """A document of plain paragraphs; characters that XML can't hold are left out."""
    body = "".join(f'<w:p><w:r><w:t xml:space="preserve">{escape(_legal(p))}</w:t></w:r></w:p>' for p in paragraphs)
    return _zipped({"word/document.xml": f'<w:document xmlns:w="{WORD[1:-1]}"><w:body>{body}</w:body></w:document>'})


def xlsx_bytes(sheet: str, rows: list[list]) -> bytes:
    """A workbook of one sheet; numbers as numbers, all else as text in place, null as no cell."""

    def cell(value) -> str:
        if value is None:
            return "<c/>"
        if isinstance(value, (int, float)) and not isinstance(value, bool):
            return f"<c><v>{value}</v></c>"
        return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(_legal(str(value)))}</t></is></c>'

    body = "".join("<row>" + "".join(map(cell, row)) + "</row>" for row in rows)
    name = escape(sheet, {'"': "&quot;"})
    return _zipped({
        "xl/workbook.xml": f'<workbook xmlns="{SHEET[1:-1]}" xmlns:r="{OFFICE[1:-1]}"><sheets><sheet name="{name}" sheetId="1" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{SHEET[1:-1]}"><sheetData>{body}</sheetData></worksheet>',
    })


def _legal(text: str) -> str:
    return re.sub("[^\t\n\r\x20-\ud7ff\ue000-\ufffd\U00010000-\U0010ffff]", "", text)


@query("src8_workbook_rows", "SELECT p_partkey, p_name, p_brand FROM part")
def src8(spark, d):
    """Workbooks of 500 rows each, written from a table and read back."""

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        cells = [list(r) for r in rows[["p_partkey", "p_name", "p_brand"]].itertuples(index=False)]
        return pd.DataFrame({"path": [f"{rows['book'].iloc[0]}.xlsx"], "content": [xlsx_bytes("parts", cells)]})

    books = table(spark, d, "part", "p_partkey", "p_name", "p_brand").withColumn("book", F.floor(F.col("p_partkey") / 500))
    rows = package_rows(books.groupBy("book").applyInPandas(pack, "path string, content binary"))
    return rows.select(*[F.get("cells", F.lit(k)).cast(t).alias(c) for k, (c, t) in enumerate((("p_partkey", "long"), ("p_name", "string"), ("p_brand", "string")))])


@query("src5b_word_documents", "SELECT c_custkey, u.position, CASE u.position WHEN 0 THEN c_name ELSE c_mktsegment END AS text FROM customer, (VALUES (0), (1)) u(position)")
def src5b(spark, d):
    """A document of two paragraphs for each row, written and read back."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            files = [(f"{k}.docx", docx_bytes([name, segment])) for k, name, segment in rows.itertuples(index=False)]
            yield pd.DataFrame(files, columns=["path", "content"])

    rows = in_tasks(table(spark, d, "customer", "c_custkey", "c_name", "c_mktsegment"), "c_custkey", TASK_FILES)
    files = rows.mapInPandas(pack, "path string, content binary")
    key = F.regexp_extract("path", r"(\d+)\.docx$", 1).cast("long").alias("c_custkey")
    return package_rows(files).select(key, F.col("position").cast("int").alias("position"), F.get("cells", F.lit(0)).alias("text"))


def pages_of(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """(id, page, text): a text cut into pages of `size` characters, the last one shorter; null and empty texts have none."""
    n = F.length(text_col)
    pages = F.when(n > 0, F.transform(F.sequence(F.lit(0), F.floor((n - 1) / size).cast("int")), lambda k: F.struct(k.alias("page"), F.substring(F.col(text_col), k * size + 1, F.lit(size)).alias("text"))))
    return docs.select(F.col(id_col).alias("id"), F.explode(pages).alias("p")).select("id", "p.page", "p.text")


def in_page_batches(pages: DataFrame, size: int, function: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """SRC7: `function` over each document's pages, `size` at a time and in order; a task holds one batch at once, and the Arrow batch that it came in."""
    batched = pages.withColumn("batch", F.floor(F.col("page") / size)).repartition("id", "batch").sortWithinPartitions("id", "batch", "page")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        carry = None
        for rows in frames:
            if carry is not None:
                rows = pd.concat([carry, rows], ignore_index=True)
            if not len(rows):
                continue
            before = rows[["id", "batch"]].shift()
            new = sum((rows[c] != before[c]) & ~(rows[c].isna() & before[c].isna()) for c in ("id", "batch")).to_numpy() > 0
            cuts = [0, *(k for k in new.nonzero()[0].tolist() if k)]
            done = [function(rows.iloc[i:j]) for i, j in zip(cuts, cuts[1:], strict=False)]
            if done:
                yield pd.concat(done, ignore_index=True)
            carry = rows.iloc[cuts[-1] :]
        if carry is not None:
            yield function(carry)

    return batched.mapInPandas(run, schema)


@query("src7_page_batches", "WITH p AS (SELECT doc_id, k AS page, length(substring(text, CAST(k * 2000 + 1 AS BIGINT), 2000)) AS n FROM (SELECT doc_id, text, unnest(range(CAST(ceil(length(text) / 2000.0) AS BIGINT))) AS k FROM documents WHERE length(text) > 0)) SELECT doc_id, page // 8 AS batch, count(*) AS n_pages, CAST(sum(n) AS BIGINT) AS n_chars FROM p GROUP BY 1, 2")
def src7(spark, d):
    """Pages of 2,000 characters, eight at a time."""

    def measured(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"doc_id": [rows["id"].iloc[0]], "batch": [rows["batch"].iloc[0]], "n_pages": [len(rows)], "n_chars": [rows["text"].str.len().sum()]})

    pages = pages_of(table(spark, d, "documents", "doc_id", "text"), "doc_id", "text", 2000)
    return in_page_batches(pages, 8, measured, "doc_id long, batch long, n_pages long, n_chars long")
