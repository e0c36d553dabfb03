"""Fields, dates, entities and chunks read from record texts: functions over columns, each with a query whose texts are made of driver tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.catalog import query
from quillmesh.runtime import table

# Date formats in the order tried, and month names in Urdu with their abbreviations.
DATE_FORMATS = [
    "d-M-yyyy", "d/M/yyyy", "d.M.yyyy", "yyyy-M-d", "yyyy/M/d", "yyyy.M.d", "d-MMM-yyyy", "d/MMM/yyyy", "d MMM yyyy", "d-MMMM-yyyy", "d/MMMM/yyyy", "d MMMM yyyy", "yyyy",
]
URDU_MONTHS = {
    "جنوری": "Jan", "فروری": "Feb", "مارچ": "Mar", "اپریل": "Apr", "مئی": "May", "جون": "Jun",
    "جولائی": "Jul", "اگست": "Aug", "ستمبر": "Sep", "اکتوبر": "Oct", "نومبر": "Nov", "دسمبر": "Dec",
}
MONTHS = "|".join(["jan(?:uary)?", "feb(?:ruary)?", "mar(?:ch)?", "apr(?:il)?", "may", "june?", "july?", "aug(?:ust)?", "sep(?:tember)?", "oct(?:ober)?", "nov(?:ember)?", "dec(?:ember)?", *URDU_MONTHS])
DATE = rf"[0-9]{{4}}[-/.][0-9]{{1,2}}[-/.][0-9]{{1,2}}|[0-9]{{1,2}}[-/.][0-9]{{1,2}}[-/.][0-9]{{4}}|[0-9]{{1,2}}[-/ ](?:{MONTHS})[-/ ][0-9]{{4}}|\b[0-9]{{4}}\b"


def any_date(text: Column, formats: list[str] | None = None) -> Column:
    """FN12: the first format that a date text parses with; Urdu month names count as English ones. Null if none does."""
    plain = F.trim(text)
    for urdu, english in URDU_MONTHS.items():
        plain = F.replace(plain, F.lit(urdu), F.lit(english))
    plain = F.initcap(plain)
    return F.coalesce(*[F.to_date(F.try_to_timestamp(plain, F.lit(f))) for f in formats or DATE_FORMATS])


def all_dates(text: Column) -> Column:
    """FN12: every date of a text, ascending; what doesn't parse is left out."""
    return F.array_sort(F.array_compact(F.transform(F.regexp_extract_all(text, F.lit(f"(?i){DATE}"), F.lit(0)), lambda t: any_date(t))))


@query("fn12_parse_dates", "SELECT o_orderkey, (CASE WHEN o_orderkey % 15 = 12 THEN make_date(year(o_orderdate), 1, 1) WHEN o_orderkey % 15 = 14 THEN NULL ELSE CAST(o_orderdate AS DATE) END) AS earliest, (CASE WHEN o_orderkey % 15 = 14 THEN NULL ELSE CAST(o_orderdate AS DATE) + 400 END) AS latest, (CASE WHEN o_orderkey % 15 = 14 THEN 0 ELSE 2 END)::BIGINT AS n_dates FROM orders")
def fn12(spark, d):
    """Texts with a date in each of the formats, one in Urdu, and one without."""
    day, kind = F.to_date("o_orderdate"), F.col("o_orderkey") % 15
    first = F.date_format(day, DATE_FORMATS[0])
    for k, form in enumerate(DATE_FORMATS[1:], 1):
        first = F.when(kind == k, F.date_format(day, form)).otherwise(first)
    urdu = F.element_at(F.array(*map(F.lit, URDU_MONTHS)), F.month(day))
    first = F.when(kind == 13, F.concat_ws(" ", F.dayofmonth(day), urdu, F.year(day))).otherwise(first)
    text = F.when(kind == 14, "on 45/45/1999, sometime").otherwise(F.concat(F.lit("issued "), first, F.lit(" and in force from "), F.date_format(F.date_add(day, 400), "yyyy/MM/dd"), F.lit(".")))
    dates = table(spark, d, "orders").select("o_orderkey", all_dates(text).alias("dates"))
    return dates.select("o_orderkey", F.get("dates", F.lit(0)).alias("earliest"), F.try_element_at("dates", F.lit(-1)).alias("latest"), F.size("dates").cast("long").alias("n_dates"))


# ---------------------------------------------------------------- signals, entities, query terms


def signals(text: Column, dictionary: dict[str, list[str]]) -> Column:
    """FN15, FN74: for every signal the sorted terms of its list that a text holds, as a struct."""
    low = F.lower(text)
    return F.struct(*[F.array_sort(F.array_compact(F.array(*[F.when(F.contains(low, F.lit(t)), t) for t in terms]))).alias(name) for name, terms in dictionary.items()])


#: Eight signals with terms that the driver's invented prose holds.
SIGNALS = {
    "geography": ["heer", "andti", "queque"], "species": ["ouing", "tionre"], "legal": ["sch", "entzkeit"], "temporal": ["ationes", "lichung"],
    "authority": ["thand", "ellement"], "economy": ["ción"], "access": ["@", "http"], "quantity": ["###", "%%%"],
}


def _terms_sql(terms: list[str]) -> str:
    return f"list_sort(list_filter({terms!r}, lambda t: contains(lower(text), t)))"


@query("fn15_enriched_metadata", f"WITH s AS (SELECT doc_id, {', '.join(f'{_terms_sql(t)} AS {n}' for n, t in SIGNALS.items())} FROM documents) SELECT doc_id, {', '.join(n for n in SIGNALS)}, ({' + '.join(f'(len({n}) > 0)::INTEGER' for n in SIGNALS)})::BIGINT AS n_signals FROM s")
def fn15(spark, d):
    rows = table(spark, d, "documents", "doc_id", "text").select("doc_id", signals(F.col("text"), SIGNALS).alias("s"))
    return rows.select("doc_id", "s.*", sum((F.size(f"s.{n}") > 0).cast("long") for n in SIGNALS).alias("n_signals"))


PLACES = {"heer": "north", "andti": "north", "ouing": "south", "que": "south", "sch": "east", "tionre": "east"}


@query("fn74_dictionary_hits", f"""WITH h AS (SELECT doc_id, list_sort(list_filter({list(PLACES)!r}, lambda t: contains(lower(text), t))) AS hits FROM documents),
r AS (SELECT doc_id, hits, list_sort(list_distinct(list_transform(hits, lambda t: CASE WHEN t IN ('heer', 'andti') THEN 'north' WHEN t IN ('ouing', 'que') THEN 'south' ELSE 'east' END))) AS regions FROM h)
SELECT *, CASE len(regions) WHEN 0 THEN 'none' WHEN 1 THEN 'local' WHEN 2 THEN 'regional' ELSE 'general' END AS scope FROM r""")
def fn74(spark, d):
    """Places that a text names, the regions that they lie in, and the scope that these give."""
    regions = F.create_map(*[F.lit(x) for pair in PLACES.items() for x in pair])
    rows = table(spark, d, "documents", "doc_id", "text").select("doc_id", signals(F.col("text"), {"hits": list(PLACES)})["hits"].alias("hits"))
    rows = rows.withColumn("regions", F.array_sort(F.array_distinct(F.transform("hits", lambda t: F.element_at(regions, t)))))
    n = F.size("regions")
    return rows.withColumn("scope", F.when(n == 0, "none").when(n == 1, "local").when(n == 2, "regional").otherwise("general"))


def entities(text: Column, terms: dict[str, list[str]], near: str, reach: int = 30) -> Column:
    """FN33: (type, term, n, confidence) of dictionary terms that a text holds as words; a word of `near` within `reach` characters before raises it."""
    found = []
    for kind, names in terms.items():
        for term in names:
            n = F.regexp_count(text, F.lit(rf"(?i)\b{term}\b"))
            close = F.regexp_count(text, F.lit(rf"(?is)\b(?:{near})\b.{{0,{reach}}}?\b{term}\b"))
            confidence = F.round(F.least(F.lit(1.0), 0.5 + 0.1 * F.least(n, F.lit(3)) + F.when(close > 0, 0.2).otherwise(0.0)), 2)
            found.append(F.when(n > 0, F.struct(F.lit(kind).alias("type"), F.lit(term).alias("term"), n.cast("long").alias("n"), confidence.alias("confidence"))))
    return F.array_compact(F.array(*found))


NAMES = {"species": ["the", "thand"], "officer": ["with", "heer"], "jurisdiction": ["that"]}


@query("fn33_dictionary_entities", " UNION ALL ".join(
    f"SELECT doc_id, '{k}' AS type, '{t}' AS term, len(regexp_extract_all(text, '(?i)\\b{t}\\b'))::BIGINT AS n, round(least(1.0, 0.5 + 0.1 * least(len(regexp_extract_all(text, '(?i)\\b{t}\\b')), 3) + CASE WHEN regexp_matches(text, '(?is)\\b(?:of|and)\\b.{{0,30}}?\\b{t}\\b') THEN 0.2 ELSE 0 END), 2)::DOUBLE AS confidence FROM documents WHERE regexp_matches(text, '(?i)\\b{t}\\b')"
    for k, names in NAMES.items() for t in names))
def fn33(spark, d):
    rows = table(spark, d, "documents", "doc_id", "text").select("doc_id", F.explode(entities(F.regexp_replace("text", "[^\\x00-\\x7F]", "é"), NAMES, "of|and")).alias("e"))
    return rows.select("doc_id", "e.*")


#: Patterns of FN38's types; the named-entity model is not part of this library.
ENTITY_PATTERNS = {
    "section": r"(?i)\bsection\s+([0-9]+[A-Za-z]?)", "act": r"\b([A-Z][a-z]+ (?:Act|Ordinance))\b", "amount": r"\bRs\.?\s*([0-9][0-9,]*)", "defined": r'"([^"]+)"\s+(?:means|includes)', "quoted": r'"([^"]+)"',
}
NOTICE = "'Under Section ' || (p_partkey % 90) || ' of the Forest Act, \"' || p_name || '\" means ' || p_type || '; the fine is Rs. ' || p_size || ',000 or as \"ordered\" by NATION_' || (p_partkey % 25)"


@query("fn38_pattern_entities", """SELECT p_partkey, 'section' AS type, CAST(p_partkey % 90 AS VARCHAR) AS value FROM part UNION ALL SELECT p_partkey, 'act', 'Forest Act' FROM part UNION ALL
SELECT p_partkey, 'amount', p_size || ',000' FROM part UNION ALL SELECT p_partkey, 'defined', p_name FROM part UNION ALL SELECT p_partkey, 'quoted', p_name FROM part UNION ALL SELECT p_partkey, 'quoted', 'ordered' FROM part
UNION ALL SELECT p_partkey, 'place', 'NATION_' || (p_partkey % 25) FROM part""")
def fn38(spark, d):
    """Pattern, quoted-term and reference entities, and those of a dictionary table met by an equi-join on words."""
    text = table(spark, d, "part").select("p_partkey", F.expr(NOTICE).alias("text"))

    def of(kind: str, pattern: str) -> Column:
        return F.transform(F.array_distinct(F.regexp_extract_all("text", F.lit(pattern), F.lit(1))), lambda v: F.struct(F.lit(kind).alias("type"), v.alias("value")))

    found = [of(*pair) for pair in ENTITY_PATTERNS.items()]
    patterns = text.select("p_partkey", F.explode(F.concat(*found)).alias("e")).select("p_partkey", "e.*")
    words = text.select("p_partkey", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"\w+"), F.lit(0)))).alias("value"))
    places = words.join(table(spark, d, "nation").select(F.col("n_name").alias("value")), "value").select("p_partkey", F.lit("place").alias("type"), "value")
    return patterns.unionByName(places)


SYNONYMS = {"penalty": ["fine", "punishment"], "forest": ["woods"], "permit": ["license"]}


def query_terms(text: Column, synonyms: dict[str, list[str]], places: str) -> Column:
    """FN39: search terms of a question by seven rules: sections, acts, quoted terms, synonyms of its words, places, numbers, long words."""
    low = F.lower(text)
    every = lambda pattern, of=text: F.regexp_extract_all(of, F.lit(pattern), F.lit(1))
    sections = F.transform(every(r"\bsection\s+([0-9]+[a-z]?)", low), lambda s: F.concat(F.lit("section "), s))
    words = F.flatten(F.array(*[F.when(F.contains(low, F.lit(w)), F.array(*map(F.lit, more))).otherwise(F.array().cast("array<string>")) for w, more in synonyms.items()]))
    layers = [sections, F.transform(every(r"\b([A-Z][a-z]+ (?:Act|Ordinance))\b"), F.lower), every(r'"([^"]+)"', low), words, F.transform(every(rf"\b({places})\b"), F.lower), every(r"\b([0-9]{3,})\b"), every(r"\b([a-z]{9,})\b", low)]
    return F.array_sort(F.array_distinct(F.concat(*layers)))


@query("fn39_query_entities", r"""WITH q AS (SELECT o_orderkey, o_orderkey % 7 AS k, o_custkey, 'NATION_' || (o_custkey % 25) AS place FROM orders)
SELECT o_orderkey, list_sort(list_distinct(list_concat(['section ' || k], ['forest act'], ['tree felling'], CASE WHEN k < 3 THEN ['fine', 'punishment'] ELSE ['license'] END, ['woods'], [lower(place)],
  CASE WHEN o_custkey >= 100 THEN [CAST(o_custkey AS VARCHAR)] ELSE [] END, ['according']))) AS terms FROM q""")
def fn39(spark, d):
    ask = F.expr("""'According to Section ' || (o_orderkey % 7) || ' of the Forest Act, what ' || if(o_orderkey % 7 < 3, 'penalty', 'permit') || ' goes with "tree felling" in NATION_' || (o_custkey % 25) || ' for party ' || o_custkey || '?'""")
    return table(spark, d, "orders").select("o_orderkey", query_terms(ask, SYNONYMS, r"NATION_[0-9]+").alias("terms"))


# ---------------------------------------------------------------- circulars, plans, places


def circular(text: Column) -> Column:
    """FN59: number, date, authority, deadline in days, recipients and directives of a circular."""
    first = lambda pattern: F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))
    recipients = F.transform(F.split(F.regexp_extract(text, r"(?m)^To:\s*(.+)$", 1), r"\s*[,;]\s*"), lambda r: F.trim(r))
    directives = F.filter(F.split(F.regexp_replace(text, r"(?m)^[A-Z][A-Za-z ]*(?: No\.|:).*$", ""), r"[.!]\s+|[.!]$|\n"), lambda s: s.rlike(r"(?i)\b(directed to|shall|must|required to)\b"))
    return F.struct(
        first(r"(?i)circular\s+no\.?\s*([A-Za-z0-9][A-Za-z0-9/-]*)").alias("number"), any_date(first(rf"(?i)\bdated:?\s*({DATE})")).alias("day"), first(r"(?im)^issued by:\s*(.+)$").alias("authority"),
        first(r"(?i)\bwithin\s+([0-9]+)\s+days?\b").cast("int").alias("deadline"), F.filter(recipients, lambda r: r != "").alias("recipients"), F.size(directives).cast("long").alias("n_directives"),
    )


@query("fn59_circular_fields", """SELECT o_orderkey, o_orderkey || '/' || year(o_orderdate) AS number, CAST(o_orderdate AS DATE) AS day, 'Chief Clerk ' || (o_custkey % 9) AS authority,
CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE 1 + o_custkey % 30 END::INTEGER AS deadline, CASE WHEN o_orderkey % 5 = 0 THEN [] ELSE ['Office ' || (o_custkey % 3), 'Office ' || (o_custkey % 7 + 3)] END AS recipients, (1 + (o_orderkey % 2))::BIGINT AS n_directives FROM orders""")
def fn59(spark, d):
    text = F.expr(r"""'Circular No. ' || o_orderkey || '/' || year(o_orderdate) || '\nDated: ' || date_format(o_orderdate, 'dd.MM.yyyy') || '\nIssued by: Chief Clerk ' || (o_custkey % 9)
        || if(o_orderkey % 5 = 0, '', '\nTo: Office ' || (o_custkey % 3) || '; Office ' || (o_custkey % 7 + 3)) || '\nAll staff are directed to report' || if(o_orderkey % 4 = 0, '', ' within ' || (1 + o_custkey % 30) || ' days') || '. Thanks. '
        || if(o_orderkey % 2 = 1, 'Returns shall be filed.', 'Nothing else.')""")
    return table(spark, d, "orders").select("o_orderkey", circular(text).alias("c")).select("o_orderkey", "c.*")


def working_plan(text: Column) -> Column:
    """FN60: facts of a working plan by pattern; yield index min(1, allowable cut / volume * 10), carbon 0.25 t a cubic metre."""
    number = lambda pattern: F.nullif(F.regexp_replace(F.regexp_extract(text, pattern, 1), ",", ""), F.lit("")).cast("double")
    volume, cut = number(r"(?i)growing stock\s*:?\s*([0-9][0-9,]*(?:\.[0-9]+)?)\s*m3"), number(r"(?i)allowable cut\s*:?\s*([0-9][0-9,]*(?:\.[0-9]+)?)\s*m3")
    return F.struct(
        F.regexp_extract(text, r"(?i)compartment\s+(?:no\.?\s*)?([0-9]+[a-z]?)", 1).alias("compartment"), number(r"(?i)area\s*:?\s*([0-9][0-9,]*(?:\.[0-9]+)?)\s*ha").alias("area"), volume.alias("volume"), cut.alias("cut"),
        F.when(cut.isNotNull() & (volume > 0), F.round(F.least(F.lit(1.0), cut / volume * 10), 6)).alias("yield_index"), F.round(volume * 0.25, 4).alias("carbon"),
    )


@query("fn60_yield_index", "SELECT p_partkey, p_partkey || 'a' AS compartment, p_size::DOUBLE AS area, p_retailprice AS volume, CASE WHEN p_partkey % 6 = 0 THEN NULL ELSE p_size END::DOUBLE AS cut, CASE WHEN p_partkey % 6 = 0 THEN NULL ELSE round(least(1.0, p_size / p_retailprice * 10), 6) END AS yield_index, round(p_retailprice * 0.25, 4) AS carbon FROM part")
def fn60(spark, d):
    text = F.expr("'Compartment No. ' || p_partkey || 'a, area ' || p_size || ' ha, growing stock: ' || format_number(p_retailprice, '#,##0.0###') || ' m3' || if(p_partkey % 6 = 0, '', '; allowable cut ' || p_size || ' m3')")
    return table(spark, d, "part").select("p_partkey", working_plan(text).alias("w")).select("p_partkey", "w.*")


# ---------------------------------------------------------------- languages and structure of lines


def script_shares(text: Column) -> Column:
    """FN58: the shares of letters that are Latin without accents, Latin with them, Arabic and other."""
    count = lambda pattern: F.regexp_count(text, F.lit(pattern))
    parts = {"plain": count("[A-Za-z]"), "accented": count("[À-ÖØ-öø-ÿ]"), "arabic": count("[؀-ۿ]")}
    total = F.nullif(sum(parts.values(), F.lit(0)), F.lit(0))
    return F.struct(*[F.round(F.coalesce(n / total, F.lit(0.0)), 4).alias(k) for k, n in parts.items()])


#: Places where the language changes: a Latin word before or after an Arabic one, a plain word before one that begins with an accent.
SWITCHES = ["[A-Za-z]+ [؀-ۿ]+", "[؀-ۿ]+ [A-Za-z]+", "[a-z] [À-ÖØ-öø-ÿ]"]
_MIXED = "(text || CASE WHEN doc_id % 3 = 0 THEN ' law قانون and جنگل too' ELSE '' END)"
_n = lambda p: f"len(regexp_extract_all(t, '{p}'))"


@query("fn58_code_switches", f"WITH m AS (SELECT doc_id, {_MIXED} AS t FROM documents), c AS (SELECT doc_id, {' + '.join(map(_n, SWITCHES))} AS s, {_n('[A-Za-z]')} AS a, {_n('[À-ÖØ-öø-ÿ]')} AS b, {_n('[' + chr(0x600) + '-' + chr(0x6FF) + ']')} AS c FROM m) SELECT doc_id, s::BIGINT AS switches, {', '.join(f'round(coalesce({x} / nullif(a + b + c, 0), 0), 4)::DOUBLE AS {n}' for x, n in zip('abc', ('plain', 'accented', 'arabic'), strict=True))} FROM c")
def fn58(spark, d):
    rows = table(spark, d, "documents", "doc_id", "text").select("doc_id", F.expr(_MIXED).alias("t"))
    switches = sum((F.regexp_count("t", F.lit(p)) for p in SWITCHES), F.lit(0)).cast("long")
    return rows.select("doc_id", switches.alias("switches"), script_shares(F.col("t")).alias("s")).select("doc_id", "switches", "s.*")


def line_class(line: Column) -> Column:
    """FN57: structure of a line: empty, table, list item, numbered or capital heading, titled, text."""
    return (
        F.when(F.trim(line) == "", "empty").when(line.rlike(r"\|.*\||\t.*\t"), "table").when(line.rlike(r"^\s*(?:[-*•]|\([a-z0-9]{1,3}\))\s+"), "list")
        .when(line.rlike(r"^\s*(?:[0-9]+\.)+\s+\S"), "numbered").when((F.length(line) < 100) & line.rlike("[A-Z]{2}") & ~line.rlike("[a-zà-ÿ]"), "heading")
        .when(line.rlike(r"^[A-Z][a-z]+(?: [A-Z][a-z]+)*:"), "titled").otherwise("text")
    )


def line_language(line: Column) -> Column:
    """FN57: the language class of a line by its letters."""
    arabic, latin = line.rlike("[؀-ۿ]"), line.rlike("[A-Za-zÀ-ÖØ-öø-ÿ]")
    return F.when(arabic & latin, "mixed").when(arabic, "arabic").when(line.rlike("[À-ÖØ-öø-ÿ]"), "accented").when(latin, "plain").otherwise("none")


_LINES = "(text || chr(10) || 'TITLE ' || doc_id || chr(10) || '1.2. Scope' || chr(10) || '- item قانون' || chr(10) || 'Head Office: x')"


@query("fn57_line_classes", rf"""WITH l AS (SELECT doc_id, unnest(string_split({_LINES}, chr(10))) AS s FROM documents) SELECT doc_id,
CASE WHEN trim(s, ' ') = '' THEN 'empty' WHEN regexp_matches(s, '\|.*\||\t.*\t') THEN 'table' WHEN regexp_matches(s, '^\s*(?:[-*•]|\([a-z0-9]{{1,3}}\))\s+') THEN 'list' WHEN regexp_matches(s, '^\s*(?:[0-9]+\.)+\s+\S') THEN 'numbered'
  WHEN length(s) < 100 AND regexp_matches(s, '[A-Z]{{2}}') AND NOT regexp_matches(s, '[a-zà-ÿ]') THEN 'heading' WHEN regexp_matches(s, '^[A-Z][a-z]+(?: [A-Z][a-z]+)*:') THEN 'titled' ELSE 'text' END AS structure,
CASE WHEN regexp_matches(s, '[{chr(0x600)}-{chr(0x6FF)}]') AND regexp_matches(s, '[A-Za-zÀ-ÖØ-öø-ÿ]') THEN 'mixed' WHEN regexp_matches(s, '[{chr(0x600)}-{chr(0x6FF)}]') THEN 'arabic' WHEN regexp_matches(s, '[À-ÖØ-öø-ÿ]') THEN 'accented' WHEN regexp_matches(s, '[A-Za-z]') THEN 'plain' ELSE 'none' END AS language,
count(*) AS n FROM l GROUP BY ALL""")
def fn57(spark, d):
    lines = table(spark, d, "documents", "doc_id", "text").select("doc_id", F.explode(F.split(F.expr(_LINES.replace("chr(10)", r"'\n'")), "\n")).alias("s"))
    return lines.groupBy("doc_id", line_class(F.col("s")).alias("structure"), line_language(F.col("s")).alias("language")).agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- chunks


TOKEN_CHARS = 4
STOP = ". "


#: White space as Java's (?U)\\s has it.
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def pack_parts(parts: list[str], most: int) -> list[str]:
    """The chunks of some paragraphs, in one pass: lengths tell where chunks begin, and each opens with the last sentence before it, once there is one."""
    chunks: list[str] = []
    held: list[str] = []
    chars, tail = 0, None  # of the open chunk; the length of its last sentence
    last = None  # the last sentence before the open chunk

    def close():
        body = "\n\n".join(held)
        if last is None:
            body = body.lstrip("\n")
        chunks.append((body if last is None else last + STOP + body).strip(SPACES))
        return body.rpartition(STOP)[2] if last is not None or STOP in body else None

    for part in parts:
        n, own = len(part), len(part.rpartition(STOP)[2]) if STOP in part else None
        if chars > 0 and chars // TOKEN_CHARS + n // TOKEN_CHARS > most:
            last, held = close(), []
            chars = n if tail is None else tail + len(STOP) + n
            tail = own if own is not None or tail is None else n
        else:
            chars = chars + 2 + n if chars > 0 else n
            tail = own if own is not None or tail is None else tail + 2 + n
        held.append(part)
    close()
    return [chunk for chunk in chunks if chunk]


def packed(parts: Column, most: int) -> Column:
    """The chunks of an array of paragraphs, as an array of texts; null of a null array."""

    @F.pandas_udf("array<string>")
    def run(column: pd.Series) -> pd.Series:
        return pd.Series([None if own is None else pack_parts(list(own), most) for own in column], dtype=object)

    return run(parts)


def packed_paragraphs(docs: DataFrame, most: int = 512) -> DataFrame:
    """(id, chunk, n_chunks, text) of (id, text) rows: paragraphs packed to `most` tokens (four characters each); a chunk opens with the last sentence of the one before.

    A text that fits is one chunk. A paragraph longer than `most` is a chunk of its own, as it is never split.
    """
    text = F.regexp_replace("text", r"(?U)^\s+|\s+$", "")
    rows = docs.where("text IS NOT NULL").select("id", text.alias("text")).where("text <> ''")
    fits = F.floor(F.length("text") / TOKEN_CHARS) <= most
    chunks = F.when(fits, F.array("text")).otherwise(packed(F.when(~fits, F.split("text", "\n")), most))
    return rows.select("id", chunks.alias("chunks")).select("id", F.posexplode("chunks").alias("chunk", "text"), F.size("chunks").cast("long").alias("n_chunks")).select("id", F.col("chunk").cast("long").alias("chunk"), "n_chunks", "text")


def section_chunks(laws: DataFrame, most: int = 512) -> DataFrame:
    """(id, law, chapter, section, heading, chunk, n_chunks, text) of laws (id, title, chapters array<struct<title, sections array<struct<number, heading, paragraphs array<string>>>>>).

    Every section of every chapter by itself: one chunk, heading and paragraphs apart by blank lines, if that fits, else packed with the heading as the
    first paragraph. Chapters without sections and sections without any text have no row.
    """
    chapters = laws.select("id", F.col("title").alias("law"), F.explode("chapters").alias("c"))
    sections = chapters.select("id", "law", F.col("c.title").alias("chapter"), F.explode("c.sections").alias("s"))
    rows = sections.select("id", "law", "chapter", F.col("s.number").alias("section"), F.col("s.heading").alias("heading"), F.array_compact(F.concat(F.array("s.heading"), F.coalesce("s.paragraphs", F.array().cast("array<string>")))).alias("_parts"))
    joined = F.array_join("_parts", "\n\n")
    fits = F.floor(F.length(joined) / TOKEN_CHARS) <= most
    chunks = F.when(F.trim(joined) == "", F.array().cast("array<string>")).when(fits, F.array(joined)).otherwise(packed(F.when(~fits, F.col("_parts")), most))
    found = rows.withColumn("_chunks", chunks).select("id", "law", "chapter", "section", "heading", F.posexplode("_chunks").alias("chunk", "text"), F.size("_chunks").alias("n_chunks"))
    return found.select("id", "law", "chapter", "section", "heading", F.col("chunk").cast("long").alias("chunk"), F.col("n_chunks").cast("long").alias("n_chunks"), "text")


@query("g3_packed_paragraphs")
def g3(spark, d):
    chunks = packed_paragraphs(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"))
    return chunks.select(F.col("id").alias("doc_id"), "chunk", "n_chunks", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("digest"))


@query("g3b_section_chunks")
def g3b(spark, d):
    """Documents as laws of two chapters, a section a line and its sentences the paragraphs, packed to 64 tokens."""
    lines = F.split("text", "\n")
    half = F.ceil(F.size(lines) / 2).cast("int")
    sections = lambda part: F.transform(part, lambda s, k: F.struct((k + 1).alias("number"), F.substring(s, 1, 20).alias("heading"), F.split(s, r"(?<=[.!?]) ").alias("paragraphs")))
    chapters = F.array(*[F.struct(F.lit(n).alias("title"), sections(part).alias("sections")) for n, part in (("I", F.slice(lines, 1, half)), ("II", F.slice(lines, half + 1, F.size(lines))))])
    laws = table(spark, d, "documents", "doc_id", "source", "text").where("text IS NOT NULL").select(F.col("doc_id").alias("id"), F.col("source").alias("title"), chapters.alias("chapters"))
    return section_chunks(laws, 64).select(F.col("id").alias("doc_id"), "chapter", "section", "chunk", "n_chunks", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("digest"))


def chunks_by_type(docs: DataFrame) -> DataFrame:
    """(id, kind, n, text) of (id, type, text) rows by one of four chunkers: laws at their section marks (parts over 50 characters; paragraphs if there is none),
    circulars at blank lines, reports at heading lines, all else by sentences."""
    law = F.filter(F.split("text", r"(?=Section [0-9]+[A-Z]*[.:])"), lambda s: s.rlike("^Section [0-9]") & (F.length(F.trim(s)) > 50))
    paragraphs = F.filter(F.split("text", r"\n[ \t]*\n"), lambda s: F.trim(s) != "")
    sentences = F.filter(F.split("text", "[.!?]"), lambda s: F.trim(s) != "")
    cut = F.when(F.col("type") == "law", F.when(F.size(law) > 0, law).otherwise(paragraphs)).when(F.col("type") == "circular", paragraphs).otherwise(sentences)
    kind = F.when((F.col("type") == "law") & (F.size(law) > 0), "section").when(F.col("type").isin("law", "circular"), "paragraph").otherwise("sentence")
    split = docs.where("type <> 'report' OR type IS NULL").select("id", kind.alias("kind"), F.posexplode(cut).alias("n", "text"))
    lines = docs.where("type = 'report'").select("id", F.posexplode(F.split("text", "\n")).alias("at", "line")).select("id", "at", F.trim("line").alias("line")).where("line <> ''")
    heading = line_class(F.col("line")).isin("heading", "numbered", "titled")
    own = Window.partitionBy("id").orderBy("at")  # the lines of one document
    parts = lines.withColumn("n", F.sum(heading.cast("int")).over(own)).groupBy("id", "n").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "line"))), lambda x: x["line"]), "\n").alias("text"))
    numbered = parts.select("id", F.lit("heading").alias("kind"), (F.row_number().over(Window.partitionBy("id").orderBy("n")) - 1).alias("n"), "text")
    return split.select("id", "kind", "n", F.trim("text").alias("text")).unionByName(numbered)


_TYPED = "CASE doc_id % 4 WHEN 0 THEN 'Section 1: ' || replace(text, chr(10), chr(10) || 'Section 2A. ') WHEN 1 THEN replace(text, chr(10), chr(10) || ' ' || chr(10)) WHEN 2 THEN replace(text, chr(10), chr(10) || 'HEAD' || chr(10)) ELSE text END"


@query("g6_chunks_by_type", f"""WITH t AS (SELECT doc_id, doc_id % 4 AS k, {_TYPED} AS text FROM documents),
law AS (SELECT doc_id, 'section' AS kind, trim(unnest(string_split(regexp_replace(text, '(Section [0-9]+[A-Z]*[.:])', chr(1) || '\\1', 'g'), chr(1))), ' ') AS x FROM t WHERE k = 0),
par AS (SELECT doc_id, 'paragraph' AS kind, trim(unnest(string_split(text, chr(10) || ' ' || chr(10))), ' ') AS x FROM t WHERE k = 1),
sen AS (SELECT doc_id, 'sentence' AS kind, trim(unnest(regexp_split_to_array(text, '[.!?]')), ' ') AS x FROM t WHERE k = 3),
ln AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS s, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM t WHERE k = 2),
hd AS (SELECT doc_id, pos, trim(s, ' ') AS s, sum((CASE WHEN regexp_matches(trim(s, ' '), '\\|.*\\||\\t.*\\t|^\\s*(?:[-*•]|\\([a-z0-9]{{1,3}}\\))\\s+') THEN 0 WHEN regexp_matches(trim(s, ' '), '^\\s*(?:[0-9]+\\.)+\\s+\\S') OR (length(trim(s, ' ')) < 100 AND regexp_matches(s, '[A-Z]{{2}}') AND NOT regexp_matches(s, '[a-zà-ÿ]')) OR regexp_matches(trim(s, ' '), '^[A-Z][a-z]+(?: [A-Z][a-z]+)*:') THEN 1 ELSE 0 END)) OVER (PARTITION BY doc_id ORDER BY pos) AS g FROM ln WHERE trim(s, ' ') <> ''),
rep AS (SELECT doc_id, 'heading' AS kind, string_agg(s, chr(10) ORDER BY pos) AS x FROM hd GROUP BY doc_id, g),
a AS (SELECT * FROM law WHERE length(x) > 50 UNION ALL SELECT * FROM par WHERE x <> '' UNION ALL SELECT * FROM sen WHERE x <> '' UNION ALL SELECT * FROM rep)
SELECT doc_id, kind, count(*) AS n_chunks, sum(length(x))::BIGINT AS n_chars, md5(string_agg(md5(x), '' ORDER BY md5(x))) AS digest FROM a GROUP BY ALL
UNION ALL SELECT doc_id, 'paragraph', 1, length(trim(text, ' ')), md5(md5(trim(text, ' '))) FROM t WHERE k = 0 AND trim(text, ' ') <> '' AND doc_id NOT IN (SELECT doc_id FROM law WHERE length(x) > 50)""")
def g6(spark, d):
    kind = F.element_at(F.array(*map(F.lit, ("law", "circular", "report", "other"))), (F.col("doc_id") % 4 + 1).cast("int"))
    docs = table(spark, d, "documents", "doc_id", "text").select(F.col("doc_id").alias("id"), kind.alias("type"), F.expr(_TYPED.replace("chr(10)", r"'\n'")).alias("text"))
    rows = chunks_by_type(docs).withColumn("digest", F.md5("text"))
    return rows.groupBy(F.col("id").alias("doc_id"), "kind").agg(F.count("*").alias("n_chunks"), F.sum(F.length("text")).cast("long").alias("n_chars"), F.md5(F.array_join(F.array_sort(F.collect_list("digest")), "")).alias("digest"))
