"""Quality rules as a bitmask ledger, in DataFrame expressions only.

Every rule is evaluated once per document. The ledger keeps the measurements and one failure bit
per rule; a policy is a versioned set of rules, applied as one bitwise AND, so that a new policy or
an ablation never reads a text again.

Defined cases: a null or blank text has no words, all measurements 0 and fails `few_words`; a null
doc_id is kept as null; repeated rows give repeated ledger rows; extra columns are not read.
A word is `[^\\x20\\x09-\\x0D]+`. Two 8-word windows count as equal when their 64-bit hashes are.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.runtime import table

WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 8


def bind(value: Column, body) -> Column:
    """Evaluate `value` once and hand it to `body` as a variable (SQL has no LET)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Words lying in a `window`-word window whose words occur twice or more in the same text."""
    count = F.size(words)
    hashes = F.transform(F.sequence(F.lit(1), count - (window - 1)), lambda i: F.xxhash64(F.slice(words, i, window)))

    def covered(places: Column) -> Column:
        last = F.size(places) - 1
        return F.aggregate(
            F.transform(places, lambda p, k: F.when(k == last, F.lit(window)).otherwise(F.least(F.lit(window), F.get(places, k + 1) - p))),
            F.lit(0), lambda total, step: total + step,
        )

    def places_of(ordered: Column) -> Column:
        twice = F.filter(
            ordered,
            lambda x, k: (x["h"] == F.get(ordered, k - 1)["h"]).eqNullSafe(True) | (x["h"] == F.get(ordered, k + 1)["h"]).eqNullSafe(True),
        )
        return F.array_sort(F.transform(twice, lambda x: x["i"]))

    def of(found: Column) -> Column:
        ordered = F.array_sort(F.transform(found, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(found)) == F.size(found), F.lit(0)).otherwise(bind(bind(ordered, places_of), covered))

    return F.when(count < window, F.lit(0)).otherwise(bind(hashes, of))


def measurements(text: Column) -> Column:
    """One struct of all measurements; the words are split once."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(WORD))

    def of(words: Column) -> Column:
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.translate(text, SPACES, "")).cast("long").alias("word_chars"),
            F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
            bind(lines, lambda x: F.struct(F.size(x).alias("n"), F.size(F.array_distinct(x)).alias("d"))).alias("lines"),
            repeated_words(words).cast("long").alias("n_repeat_words"),
            F.regexp_count(text, F.lit(r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D\p{L}]+(?![^\x20\x09-\x0D])")).cast("long").alias("n_bare_words"),
        )

    return bind(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), of)


@dataclass(frozen=True)
class Rule:
    """A failure condition over measurement columns; its bit is its place in RULES and never changes."""

    name: str
    failed: Column | str


#: Conditions in SQL over the ledger's measurements. Products instead of quotients: exact, and no division by zero.
RULES = (
    Rule("few_words", "n_words < 20"),
    Rule("repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    Rule("many_symbols", "10 * n_symbols > 1 * n_words"),
    Rule("repeated_lines", "100 * n_dup_lines > 30 * n_lines"),
    Rule("short_words", "10 * word_chars < 25 * n_words"),
    Rule("long_words", "word_chars > 12 * n_words"),
    Rule("few_letter_words", "10 * (n_words - n_bare_words) < 7 * n_words"),
)
BIT = {rule.name: 1 << k for k, rule in enumerate(RULES)}

#: Versioned policies: the rules that reject a document. A published version is never edited.
POLICIES = {
    "base": ("few_words", "repeated_windows"),
    "v1": ("few_words", "repeated_windows", "many_symbols", "repeated_lines", "short_words", "long_words", "few_letter_words"),
}


def mask_of(policy: str | tuple[str, ...]) -> int:
    return sum(BIT[name] for name in (POLICIES[policy] if isinstance(policy, str) else policy))


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(id, measurements..., failed_bits): every rule evaluated once. One scan, no exchange."""
    measured = docs.select(F.col(id_col), measurements(F.col(text_col)).alias("m")).select(
        id_col, "m.n_words", "m.word_chars", "m.n_symbols",
        (F.col("m.lines.n") - F.col("m.lines.d")).cast("long").alias("n_dup_lines"),
        "m.n_repeat_words", F.col("m.lines.n").cast("long").alias("n_lines"), "m.n_bare_words",
    )
    bits = F.lit(0)
    for k, rule in enumerate(rules):
        failed = F.expr(rule.failed) if isinstance(rule.failed, str) else rule.failed
        bits = bits.bitwiseOR(F.when(failed, F.lit(1 << k)).otherwise(F.lit(0)))
    return measured.withColumn("failed_bits", bits)


def apply_policy(entries: DataFrame, policy: str = "v1", verdict: str = "kept") -> DataFrame:
    """Adds the policy's verdict; reads only the bits."""
    return entries.withColumn(verdict, F.col("failed_bits").bitwiseAND(F.lit(mask_of(policy))) == 0)


def ablate(entries: DataFrame, policy: str = "v1") -> DataFrame:
    """(rule, n_failed, n_only, n_kept_without): what each rule of a policy rejects, alone and in all.

    The ledger shrinks to one row per bit pattern (2^rules at most) before anything is compared.
    """
    patterns = entries.groupBy(F.col("failed_bits").bitwiseAND(F.lit(mask_of(policy))).alias("bits")).agg(F.count("*").alias("n"))
    rules = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(BIT[r]).alias("bit")) for r in POLICIES[policy]]))
    each = patterns.select("bits", "n", rules.alias("r")).select("bits", "n", "r.rule", "r.bit")
    rest = F.col("bits").bitwiseAND(F.bitwise_not(F.col("bit")))
    total = lambda cond: F.sum(F.when(cond, F.col("n")).otherwise(F.lit(0)))
    return each.groupBy("rule").agg(
        total(F.col("bits").bitwiseAND(F.col("bit")) != 0).alias("n_failed"),
        total((F.col("bits") != 0) & (rest == 0)).alias("n_only"),
        total(rest == 0).alias("n_kept_without"),
    )


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = apply_policy(ledger(table(spark, sf_dir, "documents", "doc_id", "text")))
    return entries.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (F.col("failed_bits").bitwiseAND(F.lit(mask_of("base"))) != 0).alias("base_failed"),
        "kept", "failed_bits", "n_lines", "n_bare_words",
    )


#: The same in DuckDB: windows as lists of words themselves rather than hashes.
OP9_SQL = r"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls,
         row_number() OVER () AS rid
  FROM documents),
win AS (
  SELECT rid, unnest(range(1, len(ws) - 6)) AS i, ws FROM w WHERE len(ws) >= 8),
keyed AS (SELECT rid, i, array_to_string(ws[i:i + 7], ' ') AS k FROM win),
rep AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, k) AS c FROM keyed),
steps AS (SELECT rid, least(8, coalesce(lead(i) OVER (PARTITION BY rid ORDER BY i) - i, 8)) AS step FROM rep WHERE c >= 2),
cov AS (SELECT rid, sum(step) AS n FROM steps GROUP BY rid),
m AS (
  SELECT doc_id, len(ws)::BIGINT AS n_words,
         length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
         coalesce(cov.n, 0)::BIGINT AS n_repeat_words, len(ls)::BIGINT AS n_lines,
         len(list_filter(ws, lambda x: NOT regexp_matches(x, '\p{L}')))::BIGINT AS n_bare_words
  FROM w LEFT JOIN cov USING (rid)),
b AS (
  SELECT *, (CASE WHEN n_words < 20 THEN 1 ELSE 0 END) + (CASE WHEN 100 * n_repeat_words > 30 * n_words THEN 2 ELSE 0 END)
    + (CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END) + (CASE WHEN 100 * n_dup_lines > 30 * n_lines THEN 8 ELSE 0 END)
    + (CASE WHEN 10 * word_chars < 25 * n_words THEN 16 ELSE 0 END) + (CASE WHEN word_chars > 12 * n_words THEN 32 ELSE 0 END)
    + (CASE WHEN 10 * (n_words - n_bare_words) < 7 * n_words THEN 64 ELSE 0 END) AS failed_bits
  FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       failed_bits = 0 AS kept, failed_bits::INTEGER AS failed_bits, n_lines, n_bare_words
FROM b
"""
