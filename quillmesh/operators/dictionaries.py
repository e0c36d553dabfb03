"""Dictionaries as tables: every term of a table of any size found in every text, and what the terms stand for.

The forms of a dictionary are cut into parts of at most `PART` and texts into blocks of about `BLOCK_CHARS` characters. Each
part meets each block once, in a task that builds an automaton of the part and reads the block's texts through it, so the
cost of a text is its length and its hits, whatever the number of terms, and the plan is the same for any dictionary.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmesh.catalog import query
from quillmesh.functions.records import NOTICE
from quillmesh.runtime import stage, table

#: Shorter forms hit by chance.
LEAST_LETTERS = 4
PART = 50_000
BLOCK_CHARS = 32_000_000


def forms_of(terms: DataFrame, least: int = LEAST_LETTERS) -> DataFrame:
    """(form, canonical) of terms (canonical, aliases): names and aliases in lower case, with spaces and with underscores for them, of `least` letters or more."""
    names = F.concat(F.array("canonical"), F.coalesce("aliases", F.array().cast("array<string>")))
    low = F.transform(names, lambda n: F.lower(F.trim(n)))
    every = F.flatten(F.transform(low, lambda n: F.array(n, F.replace(n, F.lit("_"), F.lit(" ")), F.replace(n, F.lit(" "), F.lit("_")))))
    rows = terms.where("canonical IS NOT NULL").select(F.explode(every).alias("form"), "canonical")
    return rows.where(F.length(F.trim("form")) >= least).distinct()


def occurrences(docs: DataFrame, forms: DataFrame, whole_words: bool = False) -> DataFrame:
    """(id, canonical, n, first) for docs (id, text) and forms (form, canonical): how often forms of a canonical term occur in the lower-cased text, and where first.

    Occurrences may overlap; one place counts once for each of its forms. whole_words: only those with no letter, digit or underscore on either
    side. A null or empty text has no row; repeated rows count together; an empty dictionary gives an empty result; null and empty
    forms are left out. Extra columns are not read.
    """
    kind, name = docs.schema["id"].dataType.simpleString(), forms.schema["canonical"].dataType.simpleString()
    known = stage(forms.where("form IS NOT NULL AND form <> '' AND canonical IS NOT NULL").select(F.lower("form").alias("form"), "canonical").distinct(), "dictionary")
    parts = max(1, -(-known.count() // PART))
    texts = docs.where("text IS NOT NULL AND text <> ''").select("id", F.lower("text").alias("text"))
    blocks = max(1, -(-(texts.agg(F.sum(F.length("text"))).first()[0] or 0) // BLOCK_CHARS))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = texts.withColumn("_block", F.pmod(F.xxhash64("id", "text", F.monotonically_increasing_id()), F.lit(blocks)).cast("int")).withColumn("_part", every(parts))
    right = known.withColumn("_part", F.pmod(F.xxhash64("form"), F.lit(parts)).cast("int")).withColumn("_block", every(blocks))

    # The forms of a part come before the block's texts, which are read as they come: a task holds an automaton and an Arrow batch.
    none = lambda c, kind: F.lit(None).cast(kind).alias(c)
    texts_of = left.select("_part", "_block", F.lit(1).alias("_text"), "id", "text", none("canonical", name))
    forms_of_part = right.select("_part", "_block", F.lit(0).alias("_text"), none("id", kind), F.col("form").alias("text"), "canonical")
    met = forms_of_part.union(texts_of).repartition("_part", "_block").sortWithinPartitions("_part", "_block", "_text")

    def scan(batches):
        import ahocorasick

        own, stands, automaton = None, {}, None
        for batch in batches:
            out: list[tuple] = []
            for *key, is_text, doc_id, text, canonical in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != own:
                    own, stands, automaton = key, {}, None
                if not is_text:
                    stands.setdefault(text, []).append(canonical)
                    continue
                if not stands:
                    continue
                if automaton is None:
                    automaton = ahocorasick.Automaton()
                    for form in stands:
                        automaton.add_word(form, form)
                    automaton.make_automaton()
                found: dict = {}
                for last, form in automaton.iter(text):
                    first = last + 1 - len(form)
                    if whole_words and (first > 0 and _inner(text[first - 1]) or last + 1 < len(text) and _inner(text[last + 1])):
                        continue
                    for c in stands[form]:
                        n, at = found.get(c, (0, first))
                        found[c] = (n + 1, min(at, first))
                out += [(doc_id, c, n, at) for c, (n, at) in found.items()]
            columns = list(zip(*out, strict=True)) or [[], [], [], []]
            kinds = (batch.schema.field("id").type, batch.schema.field("canonical").type, pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["id", "canonical", "n", "first"])

    rows = met.mapInArrow(scan, f"id {kind}, canonical {name}, n long, first long")
    return rows.groupBy("id", "canonical").agg(F.sum("n").alias("n"), F.min("first").alias("first"))  # a term's forms may lie in several parts


def _inner(c: str) -> bool:
    return c.isalnum() or c == "_"


def mentions_table(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(id, canonical) once for every term of the table of which a text holds a form."""
    return occurrences(docs, forms_of(terms)).select("id", "canonical")


def dictionary_entities(docs: DataFrame, forms: DataFrame, near: DataFrame, reach: int = 30) -> DataFrame:
    """FN33: (id, type, term, n, confidence) for forms (form, canonical, type): 0.5, 0.1 for each occurrence up to three, 0.2 with a context word of near (form) within `reach` before the first."""
    typed = forms.select(F.col("form"), F.struct("type", F.col("canonical").alias("term")).alias("canonical"))
    packed = typed.select("form", F.to_json("canonical").alias("canonical"))
    hits = occurrences(docs, packed, whole_words=True)
    words = near.select("form").distinct().withColumn("canonical", F.col("form"))
    context = occurrences_at(docs, words)
    close = hits.alias("h").join(context.alias("c"), (F.col("h.id") == F.col("c.id")), "left")
    inside = F.exists("c.ends", lambda e: (e <= F.col("h.first")) & (e >= F.col("h.first") - reach))
    entity = F.from_json("h.canonical", "type string, term string")
    confidence = F.round(F.least(F.lit(1.0), 0.5 + 0.1 * F.least(F.col("h.n"), F.lit(3)) + F.when(F.coalesce(inside, F.lit(False)), 0.2).otherwise(0.0)), 2)
    return close.select(F.col("h.id").alias("id"), entity["type"].alias("type"), entity["term"].alias("term"), F.col("h.n").alias("n"), confidence.alias("confidence"))


def occurrences_at(docs: DataFrame, words: DataFrame) -> DataFrame:
    """(id, ends): where the context words (form) of a short list end in each text, as whole words. The list is a parameter of at most 1,000 rows."""
    listed = [r["form"].lower() for r in words.limit(1001).collect()]
    if len(listed) > 1000:
        raise ValueError("more than 1,000 context words")
    if not listed:
        return docs.select("id", F.array().cast("array<int>").alias("ends")).where("false")
    pattern = "(?U)\\b(?:" + "|".join("\\Q" + w + "\\E" for w in sorted(listed, key=len, reverse=True)) + ")\\b"
    pieces = F.split(F.lower("text"), pattern)
    found = F.regexp_extract_all(F.lower("text"), F.lit(pattern), F.lit(0))
    step = F.arrays_zip(F.transform(F.slice(pieces, 1, F.size(found)), F.length).alias("a"), F.transform(found, F.length).alias("b"))
    ends = F.aggregate(step, F.array().cast("array<int>"), lambda out, s: F.array_append(out, F.coalesce(F.try_element_at(out, F.lit(-1)), F.lit(0)) + s["a"] + s["b"]))
    return docs.where("text IS NOT NULL").select("id", F.when(F.size(found) > 0, ends).otherwise(F.array().cast("array<int>")).alias("ends"))


def division_details(docs: DataFrame, divisions: DataFrame, scopes: list[tuple[str, list[str]]]) -> DataFrame:
    """FN74: (id, divisions, kinds, scope, details) for divisions (form, division, kind, detail).

    The scope is the first of `scopes` (name, indicators) of which the text holds an indicator, else provincial without a division, divisional with
    one, regional with more. details holds `division: detail` of each, looked up by a join.
    """
    forms = divisions.select("form", F.col("division").alias("canonical"))
    facts = divisions.select("division", "kind", "detail").distinct()
    hits = occurrences(docs, forms, whole_words=True).select("id", F.col("canonical").alias("division")).join(facts, "division")
    told = hits.groupBy("id").agg(
        F.array_sort(F.collect_set("division")).alias("divisions"), F.array_sort(F.collect_set("kind")).alias("kinds"), F.array_sort(F.collect_set(F.concat_ws(": ", "division", "detail"))).alias("details")
    )  # fmt: skip  as many as the dictionary has divisions, at most
    low = F.lower("text")
    named: Column = F.lit(None).cast("string")
    for name, indicators in reversed(scopes):
        named = F.when(sum((F.contains(low, F.lit(i.lower())).cast("int") for i in indicators), F.lit(0)) > 0, name).otherwise(named)
    none = F.array().cast("array<string>")
    rows = docs.select("id", named.alias("_scope")).join(told, "id", "left")
    n = F.size(F.coalesce("divisions", none))
    scope = F.coalesce("_scope", F.when(n == 0, "provincial").when(n == 1, "divisional").otherwise("regional"))
    return rows.select("id", *[F.coalesce(c, none).alias(c) for c in ("divisions", "kinds", "details")], scope.alias("scope"))


_WORDS_SQL = "w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{4,}')) AS form FROM benchmark)"


def _benchmark_forms(spark, d) -> DataFrame:
    return table(spark, d, "benchmark", "text").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{4,}"), F.lit(0))).alias("form")).distinct()


@query("j10b_dictionary_table", f"WITH {_WORDS_SQL} SELECT DISTINCT doc_id, substring(form, 1, 6) AS canonical FROM documents JOIN w ON contains(lower(text), form)")
def j10b(spark, d):
    """Every word of the benchmark as a form of the term that its first six letters name, in every document."""
    forms = _benchmark_forms(spark, d).withColumn("canonical", F.substring("form", 1, 6))
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    return occurrences(docs, forms).select(F.col("id").alias("doc_id"), "canonical")


@query("fn33b_term_counts", f"WITH {_WORDS_SQL}, t AS (SELECT doc_id, unnest(regexp_extract_all(lower(regexp_replace(text, '[^\\x00-\\x7F]', 'é', 'g')), '[a-zé0-9_]+')) AS form FROM documents) SELECT doc_id, form AS term, count(*) AS n FROM t JOIN w USING (form) GROUP BY 1, 2")
def fn33b(spark, d):
    """How often each word of the benchmark stands in each document as a whole word; other letters than English ones count as letters."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.regexp_replace("text", "[^\\x00-\\x7F]", "é").alias("text"))
    rows = occurrences(docs, _benchmark_forms(spark, d).withColumn("canonical", F.col("form")), whole_words=True)
    return rows.select(F.col("id").alias("doc_id"), F.col("canonical").alias("term"), "n")


@query("fn74b_division_details", f"""WITH p AS (SELECT p_partkey AS id, {NOTICE} || CASE p_partkey % 7 WHEN 0 THEN ' for the whole province' WHEN 1 THEN ' and NATION_' || (p_size % 25) ELSE '' END AS text, p_partkey % 25 AS a, CASE WHEN p_partkey % 7 = 1 THEN p_size % 25 ELSE p_partkey % 25 END AS b FROM part),
h AS (SELECT DISTINCT id, n_name, n_regionkey, r_name FROM p JOIN nation ON n_nationkey IN (a, b) JOIN region ON n_regionkey = r_regionkey WHERE n_name = 'NATION_' || n_nationkey)
SELECT p.id AS p_partkey, coalesce(list(n_name ORDER BY n_name) FILTER (n_name IS NOT NULL), []) AS divisions, coalesce(list_sort(list_distinct(list(r_name) FILTER (r_name IS NOT NULL))), []) AS kinds,
  coalesce(list_sort(list(n_name || ': ' || n_regionkey) FILTER (n_name IS NOT NULL)), []) AS details,
  CASE WHEN p.id % 7 = 0 THEN 'whole' WHEN count(n_name) = 0 THEN 'provincial' WHEN count(n_name) = 1 THEN 'divisional' ELSE 'regional' END AS scope
FROM p LEFT JOIN h USING (id) GROUP BY p.id""")
def fn74b(spark, d):
    """Nations that a notice names, looked up in the tables of nations and regions."""
    text = F.expr(NOTICE + " || CASE p_partkey % 7 WHEN 0 THEN ' for the whole province' WHEN 1 THEN ' and NATION_' || (p_size % 25) ELSE '' END")
    docs = table(spark, d, "part").select(F.col("p_partkey").alias("id"), text.alias("text"))
    regions = table(spark, d, "region", "r_regionkey", "r_name")
    nations = table(spark, d, "nation").join(regions, F.col("n_regionkey") == F.col("r_regionkey"))
    divisions = nations.select(F.lower("n_name").alias("form"), F.col("n_name").alias("division"), F.col("r_name").alias("kind"), F.col("n_regionkey").cast("string").alias("detail"))
    return division_details(docs, divisions, [("whole", ["whole province"]), ("local", ["compartment"])]).withColumnRenamed("id", "p_partkey")
