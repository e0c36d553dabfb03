"""Similarity joins, fuzzy merges, dictionary and registry look-ups: exact, with candidates by rare shared tokens."""

from __future__ import annotations

import difflib
import functools
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmesh.blocks import in_pairs, linked_roots, products, runs, with_blocks
from quillmesh.catalog import query
from quillmesh.operators import views
from quillmesh.operators.components import components
from quillmesh.operators.joins import lengths_of, substrings
from quillmesh.operators.sketches import class_sketch, sketched_links
from quillmesh.operators.token_sets import _sets, hashed_words, linked_sets, only_members
from quillmesh.operators.trees import tree_depths
from quillmesh.runtime import stage, table


def similar_sets(sets: DataFrame, threshold: float) -> DataFrame:
    """(a, b, common, na, nb), a < b, of (id, token) sets with a Jaccard similarity of `threshold` or more; exact.

    Equal sets meet as one, but all pairs are emitted: give one set for each group of equal ones where that will do.
    """
    whole = stage(sets.groupBy(F.col("id").cast("long").alias("id")).agg(F.collect_set(F.xxhash64("token")).alias("h")), "hashed-sets")
    sketched, links = linked_sets(whole, lambda rows: rows, threshold, True)
    own = sketched.select("id", F.col("n").cast("long").alias("n"), F.min("id").over(Window.partitionBy("digest")).alias("head"))
    equal = own.groupBy("head").agg(F.count("*").alias("copies"), F.first("n").alias("n")).where("copies > 1").select(F.col("head").alias("a"), F.col("head").alias("b"), *[F.col("n").alias(c) for c in ("common", "na", "nb")])
    one, other = (own.select(F.col("head").alias(c), F.col("id").alias(i)) for c, i in (("a", "x"), ("b", "y")))
    every = links.unionByName(equal).join(one, "a").join(other, "b").where("a <> b OR x < y")
    turned = F.col("x") > F.col("y")
    return every.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "common", F.when(turned, F.col("nb")).otherwise(F.col("na")).alias("na"), F.when(turned, F.col("na")).otherwise(F.col("nb")).alias("nb"))


@query("j3_semantic_jaccard", r"""WITH t AS (SELECT doc_id AS id, list_sort(list_distinct(regexp_extract_all(text, '[^ \n\t\r]+'))) AS ts FROM documents), c AS (SELECT min(id) AS id, ts FROM t WHERE len(ts) > 0 GROUP BY ts),
u AS (SELECT id, len(ts) AS n, unnest(ts) AS token FROM c), p AS (SELECT x.id AS a, y.id AS b, count(*) AS n, any_value(x.n) AS na, any_value(y.n) AS nb FROM u x JOIN u y ON x.token = y.token AND x.id < y.id AND 5 * least(x.n, y.n) >= 4 * greatest(x.n, y.n) GROUP BY 1, 2)
SELECT a, b, round(n / (na + nb - n), 4) AS similarity FROM p WHERE 5 * n >= 4 * (na + nb - n)""")
def j3(spark, d):
    """Pairs of documents, one for each set of white-space tokens, that share four fifths of them."""
    docs = table(spark, d, "documents", "doc_id", "text").select(F.col("doc_id").alias("id"), "text")
    return linked_sets(docs, hashed_words, 0.8, True)[1].select("a", "b", F.round(F.col("common") / (F.col("na") + F.col("nb") - F.col("common")), 4).alias("similarity"))


#: Tokens whose number of texts is broadcast, the most frequent first; the others come in few texts each and are looked up by a join.
MOST_TERMS = 1 << 20


def counted_words(docs: DataFrame, pattern: str) -> DataFrame:
    """(id, digest, h, tf) of every (id, text) with a token: its different tokens, hashed, and how often each comes. Staged."""

    def run(batches):
        for batch in batches:
            bags = [np.unique(h, return_counts=True) for h in _sets(batch.column(1))]
            ends = pa.array(np.cumsum([0, *(len(h) for h, _ in bags)]).astype(np.int32))
            h, tf = (np.concatenate([np.zeros(0, np.int64), *c]) for c in ([b[0] for b in bags], [b[1] for b in bags]))
            digests = [xxhash.xxh3_128_digest(b.tobytes() + n.tobytes()) for b, n in bags]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.binary()), pa.ListArray.from_arrays(ends, pa.array(h)), pa.ListArray.from_arrays(ends, pa.array(tf.astype(np.int32)))], names=["id", "digest", "h", "tf"])

    hashed = F.transform(F.regexp_extract_all("text", F.lit(pattern), F.lit(0)), lambda w: F.xxhash64(w))
    words = docs.select(F.col("id").cast("long").alias("id"), hashed.alias("bag")).where(F.size("bag") > 0)
    # Tokens repeat from text to text: a dictionary of a few megabytes takes a third of the hashes themselves.
    return stage(words.mapInArrow(run, "id long, digest binary, h array<long>, tf array<int>"), "bags", **{"parquet.dictionary.page.size": 8 << 20})


def common_terms(often: DataFrame) -> tuple[np.ndarray, np.ndarray, int]:
    """(tokens, ascending, in how many texts each is, the most texts that any other token is in) of (h, df): MOST_TERMS tokens at most."""
    counts = sorted((r.df, r["count"]) for r in often.groupBy("df").count().collect())
    most, left = 1, sum(c for _, c in counts)
    for df, c in counts:
        if left <= MOST_TERMS:
            break
        most, left = df, left - c
    found = often.where(F.col("df") > most).toArrow()
    h, df = (found.column(k).to_numpy() for k in ("h", "df"))
    order = np.argsort(h)
    return h[order], df[order], most


def _texts_of(h: np.ndarray, terms: np.ndarray, df: np.ndarray) -> np.ndarray:
    """In how many texts each token is, 0 if it is none of the terms."""
    if not len(terms):
        return np.zeros(len(h), np.int64)
    at = np.minimum(np.searchsorted(terms, h), len(terms) - 1)
    return np.where(terms[at] == h, df[at], 0)


def cosine_clusters(docs: DataFrame, threshold: float, pattern: str, idf: bool) -> DataFrame:
    """(id, cluster) for every (id, text) with a token: texts that cosines over the threshold connect; cluster is the least id. Exact.

    Equal bags of tokens meet as one. Tokens fall into classes; the product of two vectors is at most that of their norms by class. All pairs of such
    sketches are compared as products of matrices, in pairs of blocks: this takes the square of the texts in time, but a sketch moves
    once a block, and blocks are few. What passes hangs together in candidate clusters; only vectors in clusters are moved whole, once for
    each pair of blocks of their cluster, and compared there.
    """
    bags = counted_words(docs, pattern)
    spark = bags.sparkSession
    often = stage(bags.select(F.explode("h").alias("h")).groupBy("h").agg(F.count("*").alias("df")).where("df > 1"), "bag-words")
    n, tokens = bags.agg(F.count("*"), F.coalesce(F.sum(F.size("h")), F.lit(0))).first()
    terms, texts, most = common_terms(often)
    shared = spark.sparkContext.broadcast((terms, texts))
    heads = stage(bags.groupBy("digest").agg(F.min("id").alias("head")), "bag-heads")

    def weights(tf: np.ndarray, df: np.ndarray | int) -> np.ndarray:
        return tf * (np.log((1.0 + n) / (1 + df)) + 1) if idf else tf.astype(np.float64)

    def sketches(batches):
        terms, texts = shared.value
        for batch in batches:
            out: list[list] = [[], [], []]
            for h, tf in zip(_sets(batch.column(1)), _sets(batch.column(2)), strict=True):
                df = _texts_of(h, terms, texts)
                rare = df == 0  # in one text to `most`: the weight is between two bounds
                high, low = weights(tf, np.where(rare, 1, df)), weights(tf, np.where(rare, most, df))
                keep = ~rare | (most > 1)
                for o, x in zip(out, class_sketch(h[keep], high[keep] / np.sqrt(low @ low)), strict=True):
                    o.append(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(o, kind) for o, kind in zip(out, (pa.binary(), pa.binary(), pa.float64()), strict=True))], names=["node", "at", "root", "scale"])

    own = only_members(bags.select("id", "h", "tf"), heads.select(F.col("head").alias("node"))).mapInArrow(sketches, "node long, at binary, root binary, scale double")
    near = components(sketched_links(own, tokens, threshold))
    sized = near.join(bags.select(F.col("id").alias("node"), F.size("h").alias("n")), "node")
    members = stage(with_blocks(sized, "component", "node", "n"), "vector-clusters")
    rows = only_members(bags.select("id", "h", "tf"), members)
    whole = members.join(rows.withColumnRenamed("id", "node"), "node")
    if most > 1:

        def others(batches):
            for batch in batches:
                ids, h = np.repeat(batch.column(0).to_numpy(), np.diff(batch.column(1).offsets.to_numpy())), batch.column(1).flatten().to_numpy()
                rare = _texts_of(h, *shared.value) == 0
                yield pa.RecordBatch.from_arrays([pa.array(ids[rare]), pa.array(h[rare])], names=["node", "h"])

        rare = rows.select("id", "h").mapInArrow(others, "node long, h long").join(often.where(F.col("df") <= most), "h")
        whole = whole.join(rare.groupBy("node").agg(F.collect_list(F.struct("h", "df")).alias("rare")), "node", "left")
    else:
        whole = whole.withColumn("rare", F.lit(None).cast("array<struct<h:bigint,df:bigint>>"))

    def vectors(batches):
        """Weights of length one of each text's tokens that another has."""
        for batch in batches:
            out: list[list] = [[], []]
            for h, tf, rare in zip(_sets(batch.column("h")), _sets(batch.column("tf")), batch.column("rare").to_pylist(), strict=True):
                df = _texts_of(h, *shared.value)
                if rare:  # h ascends
                    df[np.searchsorted(h, [r["h"] for r in rare])] = [r["df"] for r in rare]
                df = np.maximum(df, 1)
                x = weights(tf, df)
                out[0].append(h[df > 1])
                out[1].append((x / np.sqrt(x @ x))[df > 1])
            ends = pa.array(np.cumsum([0, *map(len, out[0])]).astype(np.int32))
            parts = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.zeros(0, k), *c]))) for k, c in zip((np.int64, np.float64), out, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in ("component", "node", "_block", "_blocks")), *parts], names=["component", "node", "_block", "_blocks", "h", "x"])

    with_vectors = whole.select("component", "node", "_block", "_blocks", "h", "tf", "rare").mapInArrow(vectors, "component long, node long, _block int, _blocks int, h array<long>, x array<double>")

    def read(batch):
        both = [np.empty(batch.num_rows, object) for _ in range(2)]
        for o, k in zip(both, ("h", "x"), strict=True):
            o[:] = [v.copy() for v in _sets(batch.column(k))]
        return [*(batch.column(k).to_numpy() for k in ("_group", "_i", "_j", "node", "_block")), *both]

    def verify(batches):
        for _, i, j, node, block, h, x in runs(batches, 3, read):
            left, right = np.flatnonzero(block == i[0]), np.flatnonzero(block == j[0])
            if len(node) < 2 or not len(left) or not len(right):
                continue
            linked = products(list(h), list(x), left, right) > threshold
            both = np.zeros((len(node), len(node)), bool)
            both[np.ix_(left, right)] = linked
            both[np.ix_(right, left)] |= linked.T
            roots = linked_roots(len(node), lambda row, others, w=both: w[row, others])
            moved = roots != np.arange(len(node))
            yield pa.RecordBatch.from_arrays([pa.array(node[roots[moved]]), pa.array(node[moved])], names=["src", "dst"])

    linked = components(in_pairs(with_vectors, "component", "node").mapInArrow(verify, "src long, dst long"))
    known = heads.join(linked, F.col("node") == F.col("head"), "left").select("digest", F.coalesce("component", "head").alias("cluster"))
    return bags.select("id", "digest").join(known, "digest").select("id", "cluster")


def tfidf_clusters(docs: DataFrame, threshold: float = 0.85) -> DataFrame:
    """(doc_id, cluster) of (doc_id, text): TF-IDF vectors of all words of two letters or more, linked by cosine."""
    found = cosine_clusters(docs.select(F.col("doc_id").alias("id"), "text"), threshold, r"(?U)\b\w\w+\b", True)
    return found.withColumnRenamed("id", "doc_id")


@query("s7_tfidf_clusters")
def s7(spark, d):
    return tfidf_clusters(table(spark, d, "documents").select("doc_id", F.lower("text").alias("text")))


def normalised(text: str):
    """FN42: lower case, letters and digits only, single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-zà-ÿ0-9 ]", " "), r" +", " "))


SEGMENT = 10


def near_equal(texts: DataFrame, least: float = 0.95, most_longer: int = 5) -> DataFrame:
    """FN42, S6: (a, b) of short (id, text) rows that agree at over `least` of their places, lengths `most_longer` apart at most.

    Less than a twentieth of the places differ, so one whole segment of SEGMENT characters is equal
    at its place, or (under 2 * SEGMENT characters) the texts are: only those meet.
    """
    keyed = texts.select("id", "text", F.posexplode(F.filter(F.transform(F.sequence(F.lit(0), F.length("text")), lambda k: F.substring("text", k * SEGMENT + 1, F.lit(SEGMENT))), lambda s: F.length(s) > 0)).alias("at", "part"))
    one, other = (keyed.select("at", "part", F.col("id").alias(i), F.col("text").alias(t)) for i, t in (("a", "x"), ("b", "y")))
    met = one.join(other, ["at", "part"]).where("a < b").where(F.abs(F.length("x") - F.length("y")) <= most_longer).select("a", "b", "x", "y").distinct()
    same = F.size(F.filter(F.sequence(F.lit(1), F.least(F.length("x"), F.length("y"))), lambda k: F.substring("x", k, F.lit(1)) == F.substring("y", k, F.lit(1))))
    return met.where(same / F.greatest(F.length("x"), F.length("y")) > least).select("a", "b")


def near_duplicates(docs: DataFrame, least: float = 0.8, words: int = 10) -> DataFrame:
    """(id, kept_id) of (id, text) rows of 10 characters or more: kept_id is the least id that near duplicates lead to.

    Texts of over `words` words are linked by the Jaccard similarity of their words, which stands for
    the cosine of sentence vectors, as there is no sentence model; shorter ones when equal, or near so
    place by place. Order doesn't matter.
    """
    rows = stage(docs.select("id", normalised("text").alias("text")).where(F.length("text") >= 10), "normalised")
    long = F.size(F.split("text", " ")) > words
    far, links = linked_sets(rows.where(long), hashed_words, least, False)
    far = far.select("id", F.hex("digest").alias("key"))
    heads = far.groupBy("key").agg(F.min("id").alias("head"))
    short = rows.where(~long).select("id", F.col("text").alias("key"))
    singles = short.groupBy("key").agg(F.min("id").alias("head"))
    links = links.select("a", "b").unionByName(near_equal(singles.select(F.col("head").alias("id"), F.col("key").alias("text"))))
    found = components(links.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    known = heads.select("key", "head").unionByName(singles).join(found, F.col("node") == F.col("head"), "left").select("key", F.coalesce("component", "head").alias("kept_id"))
    return far.select("id", "key").unionByName(short).join(known, "key").select("id", "kept_id")


@query("s6_dedupe_normalised_text")
def s6(spark, d):
    """What is kept of documents and of benchmark items, with the number of texts that each stands for."""
    docs = table(spark, d, "documents", "doc_id", "text").select(F.col("doc_id").alias("id"), "text")
    items = table(spark, d, "benchmark").select((F.col("item_id") + 10_000_000_000).alias("id"), "text")
    return near_duplicates(docs.unionByName(items)).groupBy(F.col("kept_id").alias("doc_id")).agg(F.count("*").alias("copies"))


# ---------------------------------------------------------------- fuzzy names, grounded sentences and terms


def ratio(a: str, b: str) -> float:
    """The Ratcliff-Obershelp ratio."""
    return difflib.SequenceMatcher(None, a, b).ratio()


@F.pandas_udf(T.DoubleType())
def matcher_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else ratio(x, y) for x, y in zip(a, b, strict=True)])


def merged_names(names: DataFrame, least: float = 0.7) -> DataFrame:
    """FN36: (id, merged) of (id, name, context) entities, ids in order of appearance: names with a ratio over `least` whose contexts have one too are one entity, its least id.

    The reference text is order-dependent; components over all pairs are not. A ratio over 0.7 asks for
    that much of both names' letters in common, as multisets: those that share them meet by their rarest.
    """
    low = names.select("id", F.lower("name").alias("name"), F.lower("context").alias("context"))
    letters = F.split("name", "")
    numbered = F.transform(letters, lambda c, k: F.concat(c, F.size(F.filter(F.slice(letters, 1, k + 1), lambda x: x == c)).cast("string")))
    pairs = similar_sets(low.select("id", F.explode(numbered).alias("token")), least / (2 - least)).select("a", "b")
    side = lambda i, n, c: low.select(F.col("id").alias(i), F.col("name").alias(n), F.col("context").alias(c))
    both = pairs.join(side("a", "x", "cx"), "a").join(side("b", "y", "cy"), "b")
    alike = both.where((F.col("x") == F.col("y")) | (matcher_ratio("y", "x") > least)).where(matcher_ratio("cy", "cx") > least)
    found = components(alike.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    return names.select("id").join(found, F.col("node") == F.col("id"), "left").select("id", F.coalesce("component", "id").alias("merged"))


@query("fn36_fuzzy_ratio")
def fn36(spark, d):
    """Part names as entities, in the context of the type and brand that they first come with."""
    names = table(spark, d, "part").groupBy(F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("id"), F.min_by(F.concat_ws(" ", "p_type", "p_brand"), "p_partkey").alias("context"))
    return merged_names(names)


def sentence_sources(rows: DataFrame, least: float = 0.7, shortest: int = 20) -> DataFrame:
    """FN43: (id, n_sentences, n_mapped) of (id, text, sources) rows: sentences of 20 characters or more, and those with a ratio of `least` to one of the row's source texts."""
    plain = lambda c: F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), r"(?U)\s+", " "), r"(?U)[^\w\s\-]", ""))
    sentences = F.filter(F.transform(F.split("text", r"[.!?](?U:\s+)"), lambda s: F.trim(s)), lambda s: F.length(s) >= shortest)
    ready = rows.select("id", F.transform(sentences, plain).alias("sentences"), F.transform("sources", plain).alias("sources"))

    def mapped(sentence: str, sources: list[str]) -> bool:
        for source in sources:
            short, long = sorted((len(sentence), len(source)))
            if 2 * short >= least * (short + long):  # else the ratio can't reach it
                matcher = difflib.SequenceMatcher(None, sentence, source)
                if matcher.quick_ratio() >= least and matcher.ratio() >= least:
                    return True
        return False

    def run(batches):
        for batch in batches:
            counts = [sum(mapped(s, sources or []) for s in own or []) for own, sources in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            sizes = [len(own or []) for own in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64())], names=["id", "n_sentences", "n_mapped"])

    return ready.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, n_sentences long, n_mapped long")


# Terms that stand for one another when one is in the answer and the other in a source.
VARIANTS = [
    ("rs", "rs."), ("section", "sec"), ("includes", "include"), ("means", "mean"), ("penalty", "fine"), ("imprisonment", "jail"), ("timber", "wood"), ("deodar", "cedrus"), ("forest", "woods"),
]


def twos(term: str) -> list[tuple[str, int]]:
    """Each two letters in a row, with how often they came before in the term."""
    met: Counter = Counter()
    out = []
    for k in range(len(term) - 1):
        two = term[k : k + 2]
        out.append((two, met[two]))
        met[two] += 1
    return out


@functools.lru_cache(1 << 16)
def alike(term: str, source: str, least: float) -> bool:
    matcher = difflib.SequenceMatcher(None, term, source)
    return matcher.quick_ratio() > least and matcher.ratio() > least


def unlike_terms(terms: list[str], sources: list[str], least: float) -> list[str]:
    """The terms that no source is equal to or over `least` alike.

    Of m letters in matching blocks, all but one a block stand before another of theirs, and each block but the first takes a letter that
    matches nothing: so many twos are shared.
    """
    known = set(sources)
    rest = [t for t in dict.fromkeys(terms) if t not in known]
    index = defaultdict(list)
    for source in known if rest else ():
        for two in twos(source):
            index[two].append(source)

    def grounded(term: str) -> bool:
        shared = Counter(source for two in twos(term) for source in index.get(two, ()))
        for source, n in shared.items():
            both = len(term) + len(source)
            if 2 * min(len(term), len(source)) > least * both and n > (1.5 * least - 1) * both - 1 - 1e-9 and alike(term, source, least):
                return True
        return False

    return [t for t in rest if not grounded(t)]


def ungrounded_terms(rows: DataFrame, variants: DataFrame | None = None, least: float = 0.85) -> DataFrame:
    """FN44: (id, n_terms, ungrounded) of (id, terms, sources) rows, terms in lower case: those that no source term of the row is equal to, over `least` alike or a variant of.

    A row has its terms and sources: they are compared where it stands, terms with the sources that share enough twos. Variants (a, b), of which one stands in
    the term and the other in a source term, are a table: looked for in each different term once, then joined by row. No join by row is a broadcast, as its
    sides shuffle small but grow with the rows. Null terms are left out.
    """
    if least < 0.85:
        raise ValueError("terms less alike than 0.85 need not share two letters in a row")
    if variants is None:
        variants = rows.sparkSession.createDataFrame(VARIANTS, "a string, b string")
    both = variants.select("a", "b").union(variants.select("b", "a")).where("a <> '' AND b <> ''").distinct()
    none = F.array().cast("array<string>")
    clean = lambda c: F.coalesce(F.array_distinct(F.array_compact(c)), none)
    ready = rows.select("id", clean("terms").alias("terms"), clean("sources").alias("sources")).withColumn("rid", F.monotonically_increasing_id())

    def run(batches):
        for batch in batches:
            rest = [unlike_terms(terms, sources, least) for terms, sources in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            sizes = pa.compute.list_value_length(batch.column(1)).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(3), sizes, batch.column(2), pa.array(rest, pa.list_(pa.string()))], names=["id", "rid", "n_terms", "sources", "rest"])

    own = stage(ready.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, rid long, n_terms long, sources array<string>, rest array<string>"), "terms")
    open_rows = own.where(F.size("rest") > 0)
    terms = open_rows.select("rid", F.explode("rest").alias("term"))
    sources = open_rows.select("rid", F.explode("sources").alias("term"))
    lengths = lengths_of(both, F.col("a"), 1 << 30)
    holds = lambda frame: frame.select("term").distinct().select("term", F.explode(substrings(F.col("term"), 1, max(lengths, default=1), lengths)).alias("a")).join(both, "a")
    told = terms.join(holds(terms).select("term", F.col("b").alias("other")), "term")
    named = sources.join(holds(sources).select("term", F.col("a").alias("other")), "term").select("rid", "other").distinct()
    variant = told.join(named.hint("merge"), ["rid", "other"]).groupBy("rid").agg(F.collect_set("term").alias("_variant"))  # a row's own terms
    found = own.join(variant.hint("merge"), "rid", "left")
    return found.select("id", "n_terms", F.array_sort(F.array_except("rest", F.coalesce("_variant", none))).alias("ungrounded"))


def _answers(spark, d) -> DataFrame:
    """(id, text, before): every message of a conversation with the one before it."""
    chats = table(spark, d, "conversations", "conv_id", "turn", "text")
    return chats.select(F.struct("conv_id", "turn").alias("id"), "text", F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn")).alias("before"))


@query("fn43_mapped_sentences")
def fn43(spark, d):
    """Sentences of each message that stand in the one before it; its own lines are sources as well where its turn is odd."""
    lines = F.when(F.col("id.turn") % 2 == 1, F.split("text", "\n")).otherwise(F.array(F.coalesce("before", F.lit(""))))
    return sentence_sources(_answers(spark, d).select("id", "text", lines.alias("sources"))).select("id.conv_id", "id.turn", "n_sentences", "n_mapped")


@query("fn44_ungrounded_terms")
def fn44(spark, d):
    terms = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[a-zà-ÿ]{5,}"), F.lit(0)))
    found = ungrounded_terms(_answers(spark, d).where("before IS NOT NULL").select("id", terms("text").alias("terms"), terms("before").alias("sources")))
    return found.select("id.conv_id", "id.turn", "n_terms", F.size("ungrounded").cast("long").alias("n_ungrounded"))


# ---------------------------------------------------------------- dictionaries, dimensions, registries


def mentions(docs: DataFrame, terms: dict[str, list[str]]) -> DataFrame:
    """(id, canonical) for every canonical term of which a text holds a variant of four letters or more, once each; the dictionary is a parameter."""
    low = F.lower("text")

    def forms(name: str, variants: list[str]) -> list[str]:
        every = {v.lower() for v in (name, *variants)} | {v.lower().replace("_", " ") for v in (name, *variants)}
        return sorted(v for v in every if len(v) >= 4)

    found = [F.when(F.lit(False) if not (own := forms(n, v)) else sum((F.contains(low, F.lit(x)).cast("int") for x in own), F.lit(0)) > 0, n) for n, v in terms.items()]
    return docs.select("id", F.explode(F.array_compact(F.array(*found))).alias("canonical"))


TERMS = {"of_the": ["de la"], "and_that": ["that and"], "tionre": [], "thand": ["thands"], "schung": ["lichung"], "and": [], "los": ["de las"]}


@query("j10_dictionary_mentions", """WITH v AS (SELECT * FROM (VALUES ('of_the', 'of the'), ('of_the', 'of_the'), ('of_the', 'de la'), ('and_that', 'and that'), ('and_that', 'and_that'), ('and_that', 'that and'), ('tionre', 'tionre'), ('thand', 'thand'), ('thand', 'thands'), ('schung', 'schung'), ('schung', 'lichung'), ('los', 'de las')) x(canonical, form))
SELECT DISTINCT doc_id, canonical FROM documents JOIN v ON contains(lower(text), form)""")
def j10(spark, d):
    return mentions(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"), TERMS).withColumnRenamed("id", "doc_id")


def graph_search(nodes: DataFrame, edges: DataFrame, terms: list[str], least: float = 0.65, hops: int = 3) -> DataFrame:
    """(chunk, pass, n_entities, top, distance): chunks that mention an entity found by id (1), name (2), part of the name (3) or Dice similarity (4).

    top is the last node of a path of up to `hops` edges above the entity, least id first; none keeps the chunk.
    """
    grams = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - 1, F.lit(1))), lambda i: F.substring(c, i, F.lit(2))))
    asked = nodes.select("node_id", "name", F.explode(F.array(*map(F.lit, terms))).alias("term"))  # the question's own terms
    x, y = grams(F.lower("name")), grams(F.lower("term"))
    dice = 2 * F.size(F.array_intersect(x, y)) / (F.size(x) + F.size(y))
    how = F.when(F.col("node_id") == F.col("term"), 1).when(F.lower("name") == F.lower("term"), 2).when(F.contains(F.lower("name"), F.lower("term")), 3).when(dice >= least, 4)
    hits = asked.select("node_id", how.alias("pass")).where("pass IS NOT NULL").groupBy("node_id").agg(F.min("pass").alias("pass"))
    step = edges.select(F.col("src").alias("node"), F.col("dst").alias("next"))
    front = hits.select("node_id", F.col("node_id").alias("node"))
    above = None
    for k in range(1, hops + 1):
        front = front.join(step, "node").select("node_id", F.col("next").alias("node"))
        reached = front.select("node_id", F.struct((-F.lit(k)).alias("far"), F.col("node").alias("top")).alias("end"))
        above = reached if above is None else above.unionByName(reached)
    tops = above.groupBy("node_id").agg(F.min("end").alias("end"))
    mentioned = edges.select(F.col("src").alias("chunk"), F.col("dst").alias("node_id")).join(hits, "node_id").join(tops, "node_id", "left")
    return mentioned.groupBy("chunk").agg(F.min("pass").alias("pass"), F.count_distinct("node_id").alias("n_entities"), F.min("end").alias("end")).select("chunk", "pass", "n_entities", F.col("end.top").alias("top"), (-F.col("end.far")).alias("distance"))


@query("j12_graph_search", f"""WITH RECURSIVE {views.NODES}, {views.EDGES}, terms AS (SELECT unnest(['n3', 'nation_7', 'ATION_2', 'NATOIN_11', 'AMERICAS']) AS term),
g AS (SELECT node_id, name, term, list_distinct(list_transform(range(1, length(name)), lambda i: substring(lower(name), i, 2))) AS x, list_distinct(list_transform(range(1, length(term)), lambda i: substring(lower(term), i, 2))) AS y FROM nodes, terms),
h AS (SELECT node_id, min(CASE WHEN node_id = term THEN 1 WHEN lower(name) = lower(term) THEN 2 WHEN contains(lower(name), lower(term)) THEN 3 WHEN 2 * len(list_intersect(x, y)) / (len(x) + len(y)) >= 0.65 THEN 4 END) AS pass FROM g GROUP BY node_id),
p(node_id, node, k) AS (SELECT node_id, node_id, 0 FROM h WHERE pass IS NOT NULL UNION ALL SELECT p.node_id, e.dst, k + 1 FROM p JOIN edges e ON e.src = p.node WHERE k < 3),
m AS (SELECT e.src AS chunk, h.node_id, pass FROM h JOIN edges e ON e.dst = h.node_id WHERE pass IS NOT NULL),
r AS (SELECT chunk, m.node_id, pass, k, node, row_number() OVER (PARTITION BY chunk ORDER BY k DESC NULLS LAST, node) AS rn FROM m LEFT JOIN p ON p.node_id = m.node_id AND k > 0)
SELECT chunk, min(pass) AS pass, count(DISTINCT node_id) AS n_entities, max(node) FILTER (rn = 1) AS top, max(k) FILTER (rn = 1) AS distance FROM r GROUP BY chunk""")
def j12(spark, d):
    return graph_search(views.nodes(spark, d), views.edges(spark, d), ["n3", "nation_7", "ATION_2", "NATOIN_11", "AMERICAS"])


def asof_dimension(rows: DataFrame, at: str, dimension: DataFrame, key: str, default: int) -> DataFrame:
    """Rows with the columns of the dimension row of the greatest `key` not after `at`, else of the default one. Each distinct `at` is looked up once."""
    values = [c for c in dimension.columns if c != key]
    asked = rows.select(F.col(at).alias("_at")).distinct()
    best = asked.join(dimension, F.col(key) <= F.col("_at"), "left").groupBy("_at").agg(F.max(key).alias("_key")).withColumn("_key", F.coalesce("_key", F.lit(default)))
    known = best.join(dimension, F.col("_key") == F.col(key), "left").select("_at", F.col("_key").alias(f"{key}_used"), *values)
    return rows.join(known, F.col(at).eqNullSafe(F.col("_at")), "left").drop("_at")


@query("j19_asof_year_multiplier", "WITH m AS (SELECT * FROM (VALUES (1996, 1.0), (1998, 1.5), (1999, 2.0), (2002, 3.0)) x(year, factor)) SELECT o_orderkey, coalesce(max(m.year), 2002)::INTEGER AS year_used, coalesce(arg_max(factor, m.year), 3.0)::DOUBLE AS factor, (year(any_value(o_orderdate)) - 2002)::INTEGER AS since_base FROM orders LEFT JOIN m ON m.year <= year(o_orderdate) GROUP BY o_orderkey")
def j19(spark, d):
    steps = spark.createDataFrame([(1996, 1.0), (1998, 1.5), (1999, 2.0), (2002, 3.0)], "year int, factor double")
    rows = table(spark, d, "orders").select("o_orderkey", F.year("o_orderdate").alias("at"))
    return asof_dimension(rows, "at", steps, "year", 2002).select("o_orderkey", "year_used", "factor", (F.col("at") - 2002).alias("since_base"))


def contained_either_way(rows: DataFrame, title: str, registry: DataFrame, base: str, longest: int = 40) -> DataFrame:
    """rows joined with the registry rows whose short text is part of the title, or the title part of it; by equi-joins on substrings."""
    wide = registry.withColumn("_parts", F.array_distinct(F.array_union(substrings(F.col(base), 1, longest), F.array(F.lit(None).cast("string")))))
    inside = rows.withColumn("_part", F.explode(substrings(F.col(title), 1, longest, lengths_of(registry, F.col(base), longest)))).join(registry, F.col("_part") == F.col(base)).drop("_part")
    around = rows.join(wide.withColumn("_part", F.explode("_parts")).drop("_parts"), F.col("_part") == F.col(title)).drop("_part")
    return inside.unionByName(around).distinct()


def registry_checks(rows: DataFrame, gazette: DataFrame, chains: DataFrame, amendments: DataFrame) -> DataFrame:
    """(id, gazette_state, delay_days, chain, superseded, amended_on, amended) of (id, title, reference, effective).

    The gazette is met by reference, the amendment chain by a title inside its base entity or around
    it (the first chain that is), its latest amendment by date.
    """
    noted = rows.join(gazette, "reference", "left")
    state = F.when(F.col("status").isNull(), "missing").when(F.col("repealed_by").isNotNull(), "repealed").when(F.col("status") != "current", "not current").otherwise("current")
    noted = noted.select("id", "title", "effective", state.alias("gazette_state"), F.date_diff("effective", "published").alias("delay_days"))
    first = contained_either_way(rows.select("id", "title"), "title", chains.select("chain", "base"), "base").groupBy("id").agg(F.min("chain").alias("chain"))
    latest = amendments.groupBy("chain").agg(F.max("day").alias("amended_on"))
    known = first.join(chains.select("chain", "current_from"), "chain").join(latest, "chain", "left")
    judged = noted.join(known, "id", "left")
    before = lambda c: F.coalesce(F.col("effective") < F.col(c), F.lit(False))
    return judged.select("id", "gazette_state", "delay_days", "chain", before("current_from").alias("superseded"), "amended_on", before("amended_on").alias("amended"))


@query("j27_registry_validation", """WITH r AS (SELECT o_orderkey AS id, CASE WHEN o_custkey % 3 = 0 THEN 'ATION_' || (o_custkey % 25) ELSE 'Act of NATION_' || (o_custkey % 40) END AS title, o_custkey AS reference, CAST(o_orderdate AS DATE) AS effective FROM orders),
g AS (SELECT c_custkey AS reference, CASE WHEN c_custkey % 4 = 0 THEN 'withdrawn' ELSE 'current' END AS status, CASE WHEN c_custkey % 5 = 0 THEN c_custkey + 1 END AS repealed_by, DATE '1997-01-01' + (c_custkey % 900)::INTEGER AS published FROM customer WHERE c_custkey % 7 <> 0),
c AS (SELECT n_nationkey AS chain, n_name AS base, DATE '1996-01-01' + 60 * n_nationkey AS current_from FROM nation), a AS (SELECT s_nationkey AS chain, max(DATE '1995-06-01' + (s_suppkey % 700)::INTEGER) AS amended_on FROM supplier GROUP BY 1),
f AS (SELECT id, min(chain) AS chain FROM r JOIN c ON contains(title, base) OR contains(base, title) GROUP BY id)
SELECT r.id, CASE WHEN status IS NULL THEN 'missing' WHEN repealed_by IS NOT NULL THEN 'repealed' WHEN status <> 'current' THEN 'not current' ELSE 'current' END AS gazette_state, datediff('day', published, effective)::INTEGER AS delay_days,
f.chain, coalesce(effective < current_from, false) AS superseded, amended_on, coalesce(effective < amended_on, false) AS amended FROM r LEFT JOIN g USING (reference) LEFT JOIN f ON f.id = r.id LEFT JOIN c ON c.chain = f.chain LEFT JOIN a ON a.chain = f.chain""")
def j27(spark, d):
    title = F.expr("if(o_custkey % 3 = 0, 'ATION_' || (o_custkey % 25), 'Act of NATION_' || (o_custkey % 40))")
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), title.alias("title"), F.col("o_custkey").alias("reference"), F.to_date("o_orderdate").alias("effective"))
    gazette = table(spark, d, "customer").where("c_custkey % 7 <> 0").select(
        F.col("c_custkey").alias("reference"), F.expr("if(c_custkey % 4 = 0, 'withdrawn', 'current')").alias("status"), F.expr("if(c_custkey % 5 = 0, c_custkey + 1, NULL)").alias("repealed_by"),
        F.expr("date_add(DATE '1997-01-01', cast(c_custkey % 900 AS int))").alias("published"),
    )
    chains = table(spark, d, "nation").select(F.col("n_nationkey").alias("chain"), F.col("n_name").alias("base"), F.expr("date_add(DATE '1996-01-01', 60 * n_nationkey)").alias("current_from"))
    amendments = table(spark, d, "supplier").select(F.col("s_nationkey").alias("chain"), F.expr("date_add(DATE '1995-06-01', cast(s_suppkey % 700 AS int))").alias("day"))
    return registry_checks(rows, gazette, chains, amendments)


def located(rows: DataFrame, places: DataFrame, longest: int = 40) -> DataFrame:
    """FN63: (id, place, district, division, special) of (id, location): the longest place name that stands in the location, and what it belongs to.

    Each different location is searched once, for substrings as long as a place name. Rows meet what was found by a sorted join: found rows
    are alike and shuffle small, but a broadcast of them grows with the locations.
    """
    texts = rows.select("location").distinct()
    parts = texts.select("location", F.explode(substrings(F.lower("location"), 2, longest, lengths_of(places, F.lower("place"), longest))).alias("part"))
    best = parts.join(places, F.col("part") == F.lower("place")).groupBy("location").agg(F.max_by(F.struct("place", "district", "division", "special"), F.struct(F.length("place"), "place")).alias("found"))
    return rows.select("id", "location").join(best.hint("merge"), "location", "left").select("id", "found.*")


@query("fn63_located_hierarchy", "SELECT o_orderkey AS id, n_name AS place, CAST(n_nationkey AS VARCHAR) AS district, r_name AS division, r_regionkey = 0 AS special FROM orders LEFT JOIN nation ON n_nationkey = o_custkey % 30 LEFT JOIN region ON r_regionkey = n_regionkey")
def fn63(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.expr("'Ward ' || (o_orderkey % 9) || ', nation_' || (o_custkey % 30) || if(o_custkey % 30 >= 25, 'x', ' area')").alias("location"))
    rows = rows.withColumn("location", F.when(F.col("location").endswith("x"), "Ward outside").otherwise(F.col("location")))
    places = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return located(rows, places.select(F.col("n_name").alias("place"), F.col("n_nationkey").cast("string").alias("district"), F.col("r_name").alias("division"), (F.col("r_regionkey") == 0).alias("special")))


@query("gr6_tree_depth_and_branching", "WITH RECURSIVE e AS (SELECT p_partkey AS child, (p_partkey - 1) // 2 AS parent FROM part WHERE p_partkey > 0), t(node, depth) AS (SELECT 0::BIGINT, 1 UNION ALL SELECT e.child, t.depth + 1 FROM t JOIN e ON e.parent = t.node) SELECT max(depth) AS depth, count(*) AS n_nodes, (SELECT max(n) FROM (SELECT count(*) AS n FROM e GROUP BY parent)) AS branching FROM t")
def gr6(spark, d):
    edges = table(spark, d, "part").where("p_partkey > 0").select(F.col("p_partkey").alias("child"), F.expr("(p_partkey - 1) DIV 2").alias("parent"))
    widest = edges.groupBy("parent").agg(F.count("*").alias("n")).agg(F.max("n").alias("branching"))
    return tree_depths(edges).agg(F.max("depth").cast("int").alias("depth"), F.count("*").alias("n_nodes")).crossJoin(widest)  # one row by one
