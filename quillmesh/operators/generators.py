"""Generators: chunkers, clauses with offsets, sentences, script runs, tables, JSON repair and array closures."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmesh.catalog import query
from quillmesh.operators.trees import tree_depths
from quillmesh.runtime import table

SEPARATORS = ("\n\n", "\n", ". ", " ")


def split_recursive(text: str, size: int, separators: tuple[str, ...] = SEPARATORS) -> list[tuple[int, str]]:
    """(offset, chunk) pieces of at most `size` characters, cut at the coarsest separator that does, packed greedily; together they are the text."""
    if len(text) <= size:
        return [(0, text)] if text else []
    for k, separator in enumerate(separators):
        if separator in text:
            ends = [m.end() for m in re.finditer(re.escape(separator), text)]
            parts = [text[a:b] for a, b in zip([0, *ends], [*ends, len(text)], strict=True) if b > a]
            if len(parts) > 1:
                break
    else:
        parts, k = [text[i : i + size] for i in range(0, len(text), size)], len(separators)
    out: list[tuple[int, str]] = []
    at, start, packed = 0, 0, ""
    for part in parts:
        if packed and len(packed) + len(part) > size:
            out.append((start, packed))
            packed = ""
        if not packed:
            start = at
        if len(part) > size:
            out += [(at + o, c) for o, c in split_recursive(part, size, separators[k + 1 :])]
        else:
            packed += part
        at += len(part)
    return [*out, (start, packed)] if packed else out


def chunks(docs: DataFrame, size: int = 1000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, chunk, start, n_chars, digest): G2, G3, G6; every character of a text lies in exactly one chunk."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for rows in batches:
            out = [(i, n, start, len(c), c) for i, t in zip(rows["id"], rows["text"], strict=True) for n, (start, c) in enumerate(split_recursive(t or "", size))]
            yield pd.DataFrame(out, columns=["id", "chunk", "start", "n_chars", "text"])

    named = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return named.mapInPandas(run, f"id {kind}, chunk long, start long, n_chars long, text string")


@query("g2_recursive_chunks")
def g2(spark, d):
    return chunks(table(spark, d, "documents", "doc_id", "text")).select(F.col("id").alias("doc_id"), "chunk", "start", "n_chars", F.md5("text").alias("digest"))


@query("g1_clauses_with_offsets", "WITH s AS (SELECT doc_id, string_split(text, '.') AS p FROM documents), e AS (SELECT doc_id, unnest(p) AS clause, generate_subscripts(p, 1) AS n FROM s) SELECT doc_id, n, (coalesce(sum(length(clause) + 1) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS start, length(clause) AS n_chars FROM e")
def g1(spark, d):
    """Clauses between full stops; the offset is the running length of those before, one stop each."""
    parts = F.split("text", r"\.")
    starts = F.aggregate(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), F.array(F.lit(0).cast("long")), lambda s, x: F.concat(s, F.array(F.element_at(s, -1) + F.length(x) + 1)))
    e = table(spark, d, "documents", "doc_id", "text").select("doc_id", F.posexplode(F.arrays_zip(parts.alias("clause"), starts.alias("start"))).alias("n", "c"))
    return e.select("doc_id", (F.col("n") + 1).cast("long").alias("n"), F.col("c.start").alias("start"), F.length("c.clause").cast("long").alias("n_chars"))


@query("g4_boundary_aware_chunks", "WITH p AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS s, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents) SELECT doc_id, n, source || '/' || CAST(n AS VARCHAR) AS path, left(sha256(source || ':' || CAST(doc_id AS VARCHAR) || ':' || s), 16) AS chunk_id FROM p JOIN documents USING (doc_id) WHERE length(s) // 4 BETWEEN 20 AND 512")
def g4(spark, d):
    p = table(spark, d, "documents", "doc_id", "source", "text").select("doc_id", "source", F.posexplode(F.split("text", "\n")).alias("n", "s")).where(F.floor(F.length("s") / 4).between(20, 512))
    return p.select("doc_id", (F.col("n") + 1).cast("long").alias("n"), F.concat_ws("/", "source", F.col("n") + 1).alias("path"), F.substring(F.sha2(F.concat_ws(":", "source", "doc_id", "s"), 256), 1, 16).alias("chunk_id"))


@query("g5_section_descent", "WITH RECURSIVE t(id, root, depth) AS (SELECT 0::BIGINT, 0::BIGINT, 0 UNION ALL SELECT p_partkey, t.root, t.depth + 1 FROM part JOIN t ON t.id = (p_partkey - 1) // 5 WHERE p_partkey > 0) SELECT id, depth FROM t")
def g5(spark, d):
    """The first section and all below it, by pointer doubling over (child, parent)."""
    edges = table(spark, d, "part", "p_partkey").where("p_partkey > 0").select(F.col("p_partkey").alias("child"), F.expr("(p_partkey - 1) DIV 5").alias("parent"))
    return tree_depths(edges).where("root = 0").select(F.col("node").alias("id"), (F.col("depth") - 1).cast("int").alias("depth"))


@query("g7_sentences", r"WITH m AS (SELECT doc_id, regexp_replace(regexp_replace(text, '([0-9])\.([0-9])', '\1<dot>\2', 'g'), '([0-9])\.([0-9])', '\1<dot>\2', 'g') AS t FROM documents), s AS (SELECT doc_id, trim(unnest(regexp_split_to_array(t, '[.!?]'))) AS s FROM m) SELECT doc_id, count(*) AS n, sum(length(replace(s, '<dot>', '.')))::BIGINT AS chars FROM s WHERE s <> '' GROUP BY doc_id")
def g7(spark, d):
    """Sentence ends don't break decimals: lookarounds where the twin replaces."""
    s = table(spark, d, "documents", "doc_id", "text").select("doc_id", F.explode(F.split("text", r"(?<![0-9])\.|\.(?![0-9])|[!?]")).alias("s")).select("doc_id", F.trim("s").alias("s")).where("s != ''")
    return s.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.length("s")).alias("chars"))


@query("g8_script_runs", "WITH r AS (SELECT doc_id, unnest(regexp_extract_all(text, '[À-ÿ]+|[^À-ÿ]+')) AS run FROM documents) SELECT doc_id, regexp_matches(run, '^[À-ÿ]') AS accented, count(*) AS runs, sum(length(run))::BIGINT AS chars FROM r GROUP BY 1, 2")
def g8(spark, d):
    r = table(spark, d, "documents", "doc_id", "text").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("[À-ÿ]+|[^À-ÿ]+"), F.lit(0))).alias("run"))
    return r.groupBy("doc_id", F.col("run").rlike("^[À-ÿ]").alias("accented")).agg(F.count("*").alias("runs"), F.sum(F.length("run")).alias("chars"))


@query("g9_cells_to_rows", "SELECT p_brand, count(*) FILTER (p_type = 'PROMO') AS promo, count(*) FILTER (p_type = 'ECONOMY') AS economy, count(*) FILTER (p_type = 'LARGE') AS large FROM part GROUP BY p_brand")
def g9(spark, d):
    rows = table(spark, d, "part").withColumn("kind", F.lower("p_type")).groupBy("p_brand").pivot("kind", ["promo", "economy", "large"]).agg(F.count(F.lit(1)))
    return rows.fillna(0)


@query("g10_text_tables", "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS s, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents) SELECT doc_id, n, len(string_split(s, '|'))::BIGINT AS n_cells, trim(string_split(s, '|')[1]) AS first_cell FROM l WHERE len(regexp_extract_all(s, '[|]')) >= 2")
def g10(spark, d):
    l = table(spark, d, "documents", "doc_id", "text").select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "s")).where(F.regexp_count("s", F.lit("[|]")) >= 2)  # noqa: E741
    return l.select("doc_id", (F.col("n") + 1).cast("long").alias("n"), F.size(F.split("s", "[|]")).cast("long").alias("n_cells"), F.trim(F.split("s", "[|]")[0]).alias("first_cell"))


@query("g11_parse_json_columns", "SELECT event_id, CASE WHEN event_id % 7 = 0 THEN -1 ELSE CAST(json_extract(props, '$.k') AS INTEGER) END AS k FROM events")
def g11(spark, d):
    broken = F.when(F.col("event_id") % 7 == 0, "{bad").otherwise(F.col("props"))
    return table(spark, d, "events").select("event_id", F.coalesce(F.from_json(broken, "k INT")["k"], F.lit(-1)).alias("k"))


@query("g12_term_variants", "SELECT DISTINCT p_name AS entity, unnest([p_name, replace(p_name, ' ', '_'), upper(p_name)]) AS variant FROM part")
def g12(spark, d):
    variants = F.array_distinct(F.array("p_name", F.replace("p_name", F.lit(" "), F.lit("_")), F.upper("p_name")))
    return table(spark, d, "part").select(F.col("p_name").alias("entity"), F.explode(variants).alias("variant")).distinct()


@query("g13_alias_closure", "SELECT p_name, list_sort(list_distinct(flatten(list([lower(p_brand), p_type])))) AS aliases FROM part GROUP BY p_name")
def g13(spark, d):
    return table(spark, d, "part").groupBy("p_name").agg(F.array_sort(F.array_union(F.collect_set(F.lower("p_brand")), F.collect_set("p_type"))).alias("aliases"))


@query("g14_nested_payload", "SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events")
def g14(spark, d):
    """The value at any of three nesting levels."""
    nested = F.when(F.col("event_id") % 3 == 0, F.col("props")).when(F.col("event_id") % 3 == 1, F.concat(F.lit('{"data":'), F.col("props"), F.lit("}"))).otherwise(F.concat(F.lit('{"data":{"data":'), F.col("props"), F.lit("}}")))
    at = [F.get_json_object(nested, p).cast("int") for p in ("$.k", "$.data.k", "$.data.data.k")]
    return table(spark, d, "events").select("event_id", F.coalesce(*at).alias("k"))


@query("g15_case_to_graph_rows", "SELECT o_orderkey AS case_id, 'party' AS kind, CAST(o_custkey AS VARCHAR) AS value FROM orders UNION ALL SELECT o_orderkey, 'status', o_orderstatus FROM orders UNION ALL SELECT o_orderkey, 'priority', o_orderpriority FROM orders")
def g15(spark, d):
    pairs = F.create_map(F.lit("party"), F.col("o_custkey").cast("string"), F.lit("status"), F.col("o_orderstatus"), F.lit("priority"), F.col("o_orderpriority"))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("case_id"), F.explode(pairs).alias("kind", "value"))


@query("g16_newest_texts_of_section", "WITH r AS (SELECT l_partkey, l_comment, year(l_shipdate) AS y, max(year(l_shipdate)) OVER (PARTITION BY l_partkey) AS top FROM (SELECT l_partkey, l_returnflag || l_linestatus AS l_comment, l_shipdate FROM lineitem)) SELECT l_partkey AS section, string_agg(DISTINCT l_comment, ' ' ORDER BY l_comment) AS texts FROM r WHERE y = top GROUP BY 1")
def g16(spark, d):
    rows = table(spark, d, "lineitem").select("l_partkey", F.concat("l_returnflag", "l_linestatus").alias("t"), F.year("l_shipdate").alias("y"))
    rows = rows.withColumn("rank", F.rank().over(Window.partitionBy("l_partkey").orderBy(F.desc("y")))).where("rank = 1")
    return rows.groupBy(F.col("l_partkey").alias("section")).agg(F.array_join(F.array_sort(F.collect_set("t")), " ").alias("texts"))


def repaired_json(text: Column) -> Column:
    """G17, SRC25: trailing commas and single quotes mended before parsing."""
    return F.regexp_replace(F.regexp_replace(text, ",\\s*([}\\]])", "$1"), "'", '"')


@query("g17_json_repair", "SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events")
def g17(spark, d):
    bad = F.regexp_replace(F.regexp_replace("props", '"', "'"), "}", ", }")
    return table(spark, d, "events").select("event_id", F.from_json(repaired_json(bad), "k INT")["k"].alias("k"))


@F.pandas_udf(T.ArrayType(T.StringType()))
def json_objects(column: pd.Series) -> pd.Series:
    """SRC24: every JSON object in a damaged text, by scanning for one that parses at each brace."""
    decoder = json.JSONDecoder()

    def scan(text):
        out, at = [], 0
        while text and (at := text.find("{", at)) >= 0:
            try:
                value, end = decoder.raw_decode(text, at)
                out.append(json.dumps(value, sort_keys=True))
                at = end
            except ValueError:
                at += 1
        return out

    return column.map(scan)


@query("src24_objects_from_damaged_text", "SELECT user_id, sum(CAST(json_extract(props, '$.k') AS INTEGER))::BIGINT AS k FROM events GROUP BY user_id")
def src24(spark, d):
    torn = F.concat(F.lit("{ torn "), F.col("props"), F.lit(' ... {"k": '))
    rows = table(spark, d, "events").select("user_id", F.explode(json_objects(torn)).alias("o"))
    return rows.groupBy("user_id").agg(F.sum(F.get_json_object("o", "$.k").cast("int")).alias("k"))
