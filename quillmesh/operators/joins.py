"""Joins: equi, fallback chains, semi and anti, containment, similarity, as-of, interval, range and division."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.catalog import query
from quillmesh.operators import views
from quillmesh.operators.filters import BOXES, first_pool
from quillmesh.runtime import stage, table, unstage


def substrings(text: Column, least: int, most: int, lengths: list[int] | None = None) -> Column:
    """The distinct substrings of a short text, of `least` to `most` characters; of `lengths`, if given, only these."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1)))
    lengths = F.array(*[F.lit(k) for k in range(least, most + 1) if lengths is None or k in lengths]).cast("array<int>")
    parts = F.flatten(F.transform(starts, lambda i: F.transform(F.filter(lengths, lambda n: i + n - 1 <= F.length(text)), lambda n: F.substring(text, i, n))))
    return F.array_distinct(parts)


def lengths_of(frame: DataFrame, text: Column, most: int) -> list[int]:
    """The different lengths, `most` at most, of texts that are looked for in others: no substring of another length can be one."""
    return sorted(r[0] for r in frame.select(F.length(text).alias("n")).where(F.col("n") <= most).distinct().collect())


def asof_join(left: DataFrame, right: DataFrame, key: str, time: str, at: str, value: str, rows: int = 200_000) -> DataFrame:
    """Each left row with the right row of its key that is latest at or before it; the earliest where none is.

    Both sides are sorted by (key, time, id) into ranges of about `rows` rows, so a hot key, and a hot time of it,
    spread over ranges. Within a range the last version is a window's; what earlier ranges leave to a key is carried
    by one row a (range, key). Ties of time: the largest value. A left row without a time takes the earliest version;
    one whose key is null or has no version gets nulls. Versions without a key or a time are no versions.
    """
    versions = right.where(F.col(key).isNotNull() & F.col(at).isNotNull()).groupBy(F.col(key).alias("_k"), F.col(at).alias("_t")).agg(F.max(value).alias("_v"))
    version = F.struct(F.col("_t").alias("_at"), "_v")
    known = versions.select("_k", "_t", F.lit(0).alias("_side"), F.lit(None).cast(left.schema["_id"].dataType).alias("_id"), version.alias("_version"))
    asked = left.select(F.col(key).alias("_k"), F.col(time).alias("_t"), F.lit(1).alias("_side"), "_id", F.lit(None).cast(known.schema["_version"].dataType).alias("_version"))
    both = stage(known.unionByName(asked), "asof-rows")
    order = ("_k", "_t", "_side", "_id")
    cut = stage(both.repartitionByRange(max(1, -(-both.count() // rows)), *order).withColumn("_range", F.spark_partition_id()), "asof-ranges")
    unstage(both)
    ends = cut.where("_side = 0").groupBy("_range", "_k").agg(F.min("_version").alias("_low"), F.max("_version").alias("_high"))
    cells = cut.select("_range", "_k").distinct().join(ends, ["_range", "_k"], "left")
    earlier = Window.partitionBy("_k").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carried = cells.select("_range", "_k", F.max("_high").over(earlier).alias("_carried"), F.min("_low").over(Window.partitionBy("_k")).alias("_first"))
    own = Window.partitionBy("_range", "_k").orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    found = cut.withColumn("_last", F.last("_version", ignorenulls=True).over(own)).where("_side = 1").join(carried, ["_range", "_k"], "left")
    return found.select("_id", F.coalesce("_last", F.when(F.col("_t").isNotNull(), F.col("_carried")), "_first").alias("_version")).select("_id", F.col("_version._v").alias(value), F.col("_version._at").alias(at))


def fallback_lookup(frame: DataFrame, lookups: list[tuple[DataFrame, str, str]], value: str) -> DataFrame:
    """Left joins in order of priority; the first that hits gives the value."""
    found = []
    for k, (dimension, left, right) in enumerate(lookups):
        name = f"_v{k}"
        d = dimension.select(F.col(right).alias(f"_k{k}"), F.col(value).alias(name)).dropDuplicates([f"_k{k}"])
        frame = frame.join(d, F.col(left) == F.col(f"_k{k}"), "left").drop(f"_k{k}")
        found.append(name)
    return frame.withColumn(value, F.coalesce(*found)).drop(*found)


@query("j1_direct_mapping", "SELECT l_orderkey, l_linenumber, p_name FROM lineitem JOIN part ON l_partkey = p_partkey")
def j1(spark, d):
    return table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "l_linenumber", "p_name")


@query("j2_entity_matching", "WITH e AS (SELECT DISTINCT p_name AS node, split_part(p_name, ' ', 1) AS entity, p_type AS type FROM part) SELECT a.node AS chunk, b.node AS node, max(CASE WHEN contains(b.node, a.entity) THEN 0.9 ELSE 0.6 END + CASE WHEN a.type = b.type THEN 0.05 ELSE 0 END)::DOUBLE AS confidence FROM e a JOIN e b ON (contains(b.node, a.entity) OR a.type = b.type) AND a.node <> b.node GROUP BY 1, 2")
def j2(spark, d):
    # Distinct names and types are a small dimension; AQE decides on broadcasting it.
    e = table(spark, d, "part").select(F.col("p_name").alias("node"), F.split_part("p_name", F.lit(" "), F.lit(1)).alias("entity"), F.col("p_type").alias("type")).distinct()
    parts = e.select(F.col("node").alias("other"), F.col("type").alias("other_type"), F.explode(substrings(F.col("node"), 2, 12)).alias("part"))
    # Names are short, so containment is an equi-join on their substrings, plus one on types.
    inside = e.join(parts, e.entity == parts.part).select(F.col("node").alias("chunk"), F.col("other").alias("node"), (F.lit(0.9) + F.when(F.col("type") == F.col("other_type"), 0.05).otherwise(0.0)).alias("c"))
    typed = e.join(e.select(F.col("node").alias("other"), F.col("type")), "type").select(F.col("node").alias("chunk"), F.col("other").alias("node"), F.lit(0.65).alias("c"))
    return inside.unionByName(typed).where("chunk != node").groupBy("chunk", "node").agg(F.round(F.max("c"), 4).alias("confidence"))


@query("j4_two_hop_links", f"WITH {views.EDGES} SELECT a.src AS chunk, b.dst AS node, round(greatest(0.1, 1 - 0.3 * 2), 4)::DOUBLE AS confidence FROM edges a JOIN edges b ON a.dst = b.src UNION ALL SELECT src, dst, round(greatest(0.1, 1 - 0.3), 4)::DOUBLE FROM edges")
def j4(spark, d):
    e = views.edges(spark, d).select("src", "dst")
    two = e.join(e.select(F.col("src").alias("dst"), F.col("dst").alias("far")), "dst").select(F.col("src").alias("chunk"), F.col("far").alias("node"), F.lit(0.4).alias("confidence"))
    return two.unionByName(e.select(F.col("src").alias("chunk"), F.col("dst").alias("node"), F.lit(0.7).alias("confidence")))


@query("j5_links_not_there_yet", "SELECT DISTINCT l_orderkey, l_partkey FROM lineitem WHERE l_returnflag = 'N' AND NOT EXISTS (SELECT 1 FROM lineitem x WHERE x.l_returnflag = 'R' AND x.l_orderkey = lineitem.l_orderkey)")
def j5(spark, d):
    items = table(spark, d, "lineitem", "l_orderkey", "l_partkey", "l_returnflag")
    return items.where("l_returnflag = 'N'").join(items.where("l_returnflag = 'R'").select("l_orderkey"), "l_orderkey", "left_anti").select("l_orderkey", "l_partkey").distinct()


@query("j6_extracted_relations", "SELECT a.n_nationkey AS a, b.n_nationkey AS b, 'SAME_REGION' AS type FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey UNION ALL SELECT n_nationkey, r_regionkey, 'PART_OF' FROM nation JOIN region ON n_regionkey = r_regionkey")
def j6(spark, d):
    n = table(spark, d, "nation")
    pairs = n.select(F.col("n_nationkey").alias("a"), "n_regionkey").join(n.select(F.col("n_nationkey").alias("b"), "n_regionkey"), "n_regionkey").where("a < b").select("a", "b", F.lit("SAME_REGION").alias("type"))
    up = n.join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("a"), F.col("r_regionkey").alias("b"), F.lit("PART_OF").alias("type"))
    return pairs.unionByName(up)


@query("j7_canonical_ids_of_edges", "WITH m AS (SELECT c_custkey, 'nation_' || n_name AS canon FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey AND n_nationkey < 20) SELECT o_orderkey, coalesce(canon, 'customer_' || CAST(o_custkey AS VARCHAR)) AS node FROM orders LEFT JOIN m ON c_custkey = o_custkey")
def j7(spark, d):
    known = table(spark, d, "nation").where("n_nationkey < 20")
    m = table(spark, d, "customer").join(known, F.col("c_nationkey") == F.col("n_nationkey"), "left").select("c_custkey", F.concat(F.lit("nation_"), F.col("n_name")).alias("canon"))
    orders = table(spark, d, "orders", "o_orderkey", "o_custkey").join(m, F.col("c_custkey") == F.col("o_custkey"), "left")
    return orders.select("o_orderkey", F.coalesce("canon", F.concat(F.lit("customer_"), F.col("o_custkey"))).alias("node"))


@query("j8_link_mentions", "SELECT DISTINCT l_orderkey AS chunk, p_brand AS entity FROM lineitem JOIN part ON p_partkey = l_partkey")
def j8(spark, d):
    return table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("chunk"), F.col("p_brand").alias("entity")).distinct()


@query("j9_section_coverage", "SELECT c_custkey, count(o_orderkey) AS n_chunks FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def j9(spark, d):
    return table(spark, d, "customer").join(table(spark, d, "orders"), F.col("o_custkey") == F.col("c_custkey"), "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("n_chunks"))


@query("j11_inferred_pairs", "SELECT a.l_orderkey AS document, a.l_partkey AS law, b.l_partkey AS section FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linestatus = 'F' AND b.l_linestatus = 'O'")
def j11(spark, d):
    items = table(spark, d, "lineitem", "l_orderkey", "l_partkey", "l_linestatus")
    laws = items.where("l_linestatus = 'F'").select(F.col("l_orderkey").alias("document"), F.col("l_partkey").alias("law"))
    return laws.join(items.where("l_linestatus = 'O'").select(F.col("l_orderkey").alias("document"), F.col("l_partkey").alias("section")), "document")


@query("j13_sequential_fallback", "SELECT l_orderkey, l_linenumber, coalesce(a.p_name, b.p_name, c.p_name) AS p_name FROM lineitem LEFT JOIN part a ON a.p_partkey = l_partkey * 1000 LEFT JOIN part b ON b.p_partkey = l_partkey + 1000 LEFT JOIN part c ON c.p_partkey = l_partkey % 10")
def j13(spark, d):
    part = table(spark, d, "part", "p_partkey", "p_name")
    items = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") * 1000).alias("a"), (F.col("l_partkey") + 1000).alias("b"), (F.col("l_partkey") % 10).alias("c"))
    return fallback_lookup(items, [(part, "a", "p_partkey"), (part, "b", "p_partkey"), (part, "c", "p_partkey")], "p_name").drop("a", "b", "c")


@query("j14_corpus_overlap", "SELECT count(*) FILTER (a AND b) AS both_sides, count(*) FILTER (a AND NOT b) AS only_left, count(*) FILTER (b AND NOT a) AS only_right FROM (SELECT coalesce(d.doc_id, l.doc_id) AS id, d.doc_id IS NOT NULL AS a, l.doc_id IS NOT NULL AS b FROM documents d FULL JOIN labels l ON l.doc_id = d.doc_id)")
def j14(spark, d):
    left = table(spark, d, "documents", "doc_id").distinct().withColumn("a", F.lit(True))
    rows = left.join(table(spark, d, "labels", "doc_id").distinct().withColumn("b", F.lit(True)), "doc_id", "full_outer").select(F.coalesce("a", F.lit(False)).alias("a"), F.coalesce("b", F.lit(False)).alias("b"))
    return rows.agg(F.count_if(F.col("a") & F.col("b")).alias("both_sides"), F.count_if(F.col("a") & ~F.col("b")).alias("only_left"), F.count_if(F.col("b") & ~F.col("a")).alias("only_right"))


def dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges of which an end is no node."""
    ids = nodes.select(F.col("node_id"))
    return edges.join(ids, edges.src == ids.node_id, "left_anti").unionByName(edges.join(ids, edges.dst == ids.node_id, "left_anti")).distinct()


@query("j15_dangling_edges", f"WITH {views.NODES}, {views.EDGES} SELECT src, dst, type FROM edges WHERE src NOT IN (SELECT node_id FROM nodes WHERE label <> 'Supplier') OR dst NOT IN (SELECT node_id FROM nodes WHERE label <> 'Supplier')")
def j15(spark, d):
    return dangling(views.edges(spark, d), views.nodes(spark, d).where("label != 'Supplier'"))


@query("j16_isolated_nodes", "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 40)")
def j16(spark, d):
    used = table(spark, d, "lineitem").where("l_returnflag = 'R' AND l_quantity > 40").select(F.col("l_partkey").alias("p_partkey"))
    return table(spark, d, "part", "p_partkey").join(used, "p_partkey", "left_anti")


@query("j17_referential_dedupe", "SELECT DISTINCT l_orderkey AS src, l_returnflag AS type, l_suppkey AS dst FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 1000)")
def j17(spark, d):
    known = table(spark, d, "supplier").where("s_acctbal > 1000").select(F.col("s_suppkey").alias("dst"))
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_returnflag").alias("type"), F.col("l_suppkey").alias("dst")).join(known, "dst", "left_semi").dropDuplicates(["src", "type", "dst"])


@query("j18_asof_version", f"WITH {views.VERSIONS}, v AS (SELECT section, effective, max(law) AS law FROM versions GROUP BY 1, 2), q AS (SELECT o_orderkey AS id, o_custkey % 200 AS section, CAST(o_orderdate AS DATE) AS at FROM orders), m AS (SELECT q.id, max(v.effective) AS eff FROM q JOIN v ON v.section = q.section AND v.effective <= q.at GROUP BY q.id), f AS (SELECT section, min(effective) AS eff FROM v GROUP BY section) SELECT q.id, v.law, v.effective FROM q LEFT JOIN m ON m.id = q.id LEFT JOIN f ON f.section = q.section JOIN v ON v.section = q.section AND v.effective = coalesce(m.eff, f.eff)")
def j18(spark, d):
    questions = table(spark, d, "orders").select(F.col("o_orderkey").alias("_id"), (F.col("o_custkey") % 200).alias("section"), F.to_date("o_orderdate").alias("at"))
    return asof_join(questions, views.versions(spark, d), "section", "at", "effective", "law").withColumnRenamed("_id", "id")


def overlapping(frame: DataFrame, key: str, node: str, start: str, end: str, far: str = "2100-12-31") -> DataFrame:
    """Pairs of one key whose intervals overlap; an open end is `far`.

    Intervals are cut into the years that they touch and joined on (key, year); a pair is kept in the
    year where the later one starts, so it comes out once.
    """
    e = F.coalesce(F.col(end), F.lit(far).cast("date"))
    i = frame.select(F.col(key).alias("k"), F.col(node).alias("n"), F.col(start).alias("s"), e.alias("e"))
    cut = i.withColumn("y", F.explode(F.sequence(F.year("s"), F.year("e"))))
    other = cut.select("k", "y", F.col("n").alias("m"), F.col("s").alias("s2"), F.col("e").alias("e2"))
    pairs = cut.join(other, ["k", "y"]).where((F.col("n") < F.col("m")) & (F.greatest("s", "s2") <= F.least("e", "e2")) & (F.year(F.greatest("s", "s2")) == F.col("y")))
    return pairs.select(F.col("k").alias(key), F.col("n").alias("a"), F.col("m").alias("b"))


@query("j20_interval_overlap", "WITH i AS (SELECT o_custkey AS party, o_orderkey AS id, CAST(o_orderdate AS DATE) AS s, CASE WHEN o_orderstatus <> 'O' OR o_orderkey % 50 <> 0 THEN CAST(o_orderdate AS DATE) + 90 END AS e FROM orders) SELECT a.party, a.id AS a, b.id AS b FROM i a JOIN i b ON a.party = b.party AND a.id < b.id AND greatest(a.s, b.s) <= least(coalesce(a.e, DATE '2100-12-31'), coalesce(b.e, DATE '2100-12-31'))")
def j20(spark, d):
    start = F.to_date("o_orderdate")
    i = table(spark, d, "orders").select(F.col("o_custkey").alias("party"), F.col("o_orderkey").alias("id"), start.alias("s"), F.when((F.col("o_orderstatus") != "O") | (F.col("o_orderkey") % 50 != 0), F.date_add(start, 90)).alias("e"))
    return overlapping(i, "party", "id", "s", "e")


@query("j21_valid_on_date", "WITH i AS (SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS s, CASE WHEN o_orderstatus <> 'O' THEN CAST(o_orderdate AS DATE) + 365 END AS e FROM orders) SELECT id, CASE WHEN DATE '1998-06-01' < s THEN 'not_yet' WHEN e IS NOT NULL AND DATE '1998-06-01' > e THEN 'expired' WHEN DATE '1998-06-01' - s <= 30 THEN 'gazette_pending' ELSE 'valid' END AS state FROM i")
def j21(spark, d):
    start, at = F.to_date("o_orderdate"), F.lit("1998-06-01").cast("date")
    end = F.when(F.col("o_orderstatus") != "O", F.date_add(start, 365))
    state = F.when(at < start, "not_yet").when(at > end, "expired").when(F.datediff(at, start) <= 30, "gazette_pending").otherwise("valid")
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), state.alias("state"))


def overriding(rows: DataFrame, beats: dict[int, list[int]]) -> DataFrame:
    """(grp, src) of (grp, src) rows whose source overrides all others of its group, one at least; `beats` is a parameter of up to 62 sources.

    A group's sources are bits of one number, so neither rows nor pairs are sorted or joined. A source without a place in `beats` is overridden by none.
    """
    if len(beats) > 62:
        raise ValueError("more than 62 sources")
    bits = {name: 1 << k for k, name in enumerate(beats)}
    unknown = 1 << len(beats)
    known = F.create_map(*[F.lit(x).cast("long") for pair in bits.items() for x in pair])
    met = rows.where("grp IS NOT NULL AND src IS NOT NULL").groupBy("grp").agg(F.bit_or(F.coalesce(F.element_at(known, F.col("src").cast("long")), F.lit(unknown).cast("long"))).alias("_met"))
    won = [F.when((F.col("_met").bitwiseAND(F.lit(bit)) != 0) & (F.col("_met") != bit) & (F.col("_met").bitwiseAND(F.lit(~(bit | sum(bits[b] for b in beats[name] if b in bits)))) == 0), F.lit(name).cast("long")) for name, bit in bits.items()]
    return met.select("grp", F.explode(F.array_compact(F.array(*won))).alias("src"))


@query("j22_overrides_all_others", "WITH s AS (SELECT DISTINCT l_orderkey AS grp, l_suppkey % 10 AS src FROM lineitem), p AS (SELECT a.grp, a.src, count(*) AS others, count(*) FILTER (a.src * 3 % 10 > b.src * 3 % 10) AS won FROM s a JOIN s b ON a.grp = b.grp AND a.src <> b.src GROUP BY 1, 2) SELECT grp, src FROM p WHERE won = others")
def j22(spark, d):
    s = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("grp"), (F.col("l_suppkey") % 10).alias("src"))
    return overriding(s, {a: [b for b in range(10) if a * 3 % 10 > b * 3 % 10] for a in range(10)})


@query("j23_first_applicable_authority", "SELECT c_custkey, s_suppkey FROM (SELECT c_custkey, s_suppkey, row_number() OVER (PARTITION BY c_custkey ORDER BY s_acctbal DESC, s_suppkey) AS rn FROM customer JOIN supplier ON s_nationkey = c_nationkey) WHERE rn = 1")
def j23(spark, d):
    best = table(spark, d, "supplier").groupBy("s_nationkey").agg(F.max_by("s_suppkey", F.struct("s_acctbal", (-F.col("s_suppkey")).alias("o"))).alias("s_suppkey"))
    return table(spark, d, "customer").join(best, F.col("s_nationkey") == F.col("c_nationkey")).select("c_custkey", "s_suppkey")


@query("j24_resolve_citation", "WITH ref AS (SELECT event_id, CASE WHEN user_id % 3 = 0 THEN CAST(user_id AS VARCHAR) ELSE CAST(user_id AS VARCHAR) || 'A' END AS cite FROM events), s AS (SELECT CAST(c_custkey AS VARCHAR) AS id FROM customer WHERE c_custkey % 2 = 0) SELECT event_id, coalesce(x.id, y.id, 'context') AS section FROM ref LEFT JOIN s x ON x.id = cite LEFT JOIN s y ON y.id = regexp_extract(cite, '^([0-9]+)', 1)")
def j24(spark, d):
    cite = F.when(F.col("user_id") % 3 == 0, F.col("user_id").cast("string")).otherwise(F.concat("user_id", F.lit("A")))
    refs = table(spark, d, "events").select("event_id", cite.alias("cite")).withColumn("base", F.regexp_extract("cite", "^([0-9]+)", 1))
    s = table(spark, d, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").cast("string").alias("id")).withColumn("section", F.col("id"))
    return fallback_lookup(refs, [(s, "cite", "id"), (s, "base", "id")], "section").select("event_id", F.coalesce("section", F.lit("context")).alias("section"))


@query("j25_neighbour_sections", "SELECT p_partkey, lag(p_partkey) OVER w AS previous, lead(p_partkey) OVER w AS next FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY CAST(regexp_extract(CAST(p_size AS VARCHAR), '[0-9]+') AS INTEGER), p_name, p_partkey)")
def j25(spark, d):
    w = Window.partitionBy("p_brand").orderBy(F.regexp_extract(F.col("p_size").cast("string"), "[0-9]+", 0).cast("int"), "p_name", "p_partkey")
    return table(spark, d, "part").select("p_partkey", F.lag("p_partkey").over(w).alias("previous"), F.lead("p_partkey").over(w).alias("next"))


@query("j26_reference_to_section", "SELECT l_orderkey, l_linenumber, m.p_partkey FROM lineitem JOIN (SELECT p_size, min(p_partkey) AS p_partkey FROM part GROUP BY p_size) m ON m.p_size = CAST(l_quantity AS INTEGER)")
def j26(spark, d):
    first = table(spark, d, "part").groupBy("p_size").agg(F.min("p_partkey").alias("p_partkey"))
    return table(spark, d, "lineitem").join(first, F.col("p_size") == F.col("l_quantity").cast("int")).select("l_orderkey", "l_linenumber", "p_partkey")


@query("j28_merge_result_sets", "WITH v AS (SELECT l_orderkey AS chunk, max(l_discount) AS score FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1), g AS (SELECT l_orderkey AS chunk, max(l_tax) AS score FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1) SELECT coalesce(v.chunk, g.chunk) AS chunk, round(0.6 * coalesce(v.score, 0) + 0.3 * coalesce(g.score, 0) + CASE WHEN v.chunk IS NOT NULL AND g.chunk IS NOT NULL THEN 0.1 ELSE 0 END, 6) AS score FROM v FULL JOIN g ON v.chunk = g.chunk")
def j28(spark, d):
    side = lambda flag, c, name: table(spark, d, "lineitem").where(F.col("l_returnflag") == flag).groupBy(F.col("l_orderkey").alias("chunk")).agg(F.max(c).alias(name))
    rows = side("R", "l_discount", "v").join(side("A", "l_tax", "g"), "chunk", "full_outer")
    bonus = F.when(F.col("v").isNotNull() & F.col("g").isNotNull(), 0.1).otherwise(0.0)
    return rows.select("chunk", F.round(0.6 * F.coalesce("v", F.lit(0.0)) + 0.3 * F.coalesce("g", F.lit(0.0)) + bonus, 6).alias("score"))


@query("j29_repoint_edges", "WITH m AS (SELECT p_partkey AS dup, min(p_partkey) OVER (PARTITION BY p_name, p_brand) AS keeper FROM part) SELECT l_orderkey, l_linenumber, keeper FROM lineitem JOIN m ON dup = l_partkey")
def j29(spark, d):
    part = table(spark, d, "part", "p_partkey", "p_name", "p_brand")
    keepers = part.groupBy("p_name", "p_brand").agg(F.min("p_partkey").alias("keeper"))
    m = part.join(keepers, ["p_name", "p_brand"]).select(F.col("p_partkey").alias("dup"), "keeper")
    return table(spark, d, "lineitem").join(m, F.col("dup") == F.col("l_partkey")).select("l_orderkey", "l_linenumber", "keeper")


LANDMARKS = [("alpha", 30.2, 70.3), ("beta", 30.9, 71.1), ("gamma", 31.4, 70.6), ("delta", 31.8, 71.8)]


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """FN23: great-circle kilometres, radius 6371."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * 6371 * F.asin(F.sqrt(a))


HAVERSINE_SQL = "2 * 6371 * asin(sqrt(pow(sin(radians({b1} - {a1}) / 2), 2) + cos(radians({a1})) * cos(radians({b1})) * pow(sin(radians({b2} - {a2}) / 2), 2)))"
_LAND = "land AS (SELECT * FROM (VALUES ('alpha', 30.2::DOUBLE, 70.3::DOUBLE), ('beta', 30.9, 71.1), ('gamma', 31.4, 70.6), ('delta', 31.8, 71.8)) x(name, la, lo))"


@query("j30_nearest_landmark", f"WITH {views.GEO}, {_LAND}, p AS (SELECT id, name, {HAVERSINE_SQL.format(a1='lat', a2='lon', b1='la', b2='lo')} AS km FROM geo, land) SELECT id, arg_min(name, km) AS name, round(min(km), 4) AS km FROM p GROUP BY id")
def j30(spark, d):
    near = [F.struct(haversine(F.col("lat"), F.col("lon"), F.lit(la), F.lit(lo)).alias("km"), F.lit(name).alias("name")) for name, la, lo in LANDMARKS]  # a parameter list
    return views.geo_events(spark, d).select("id", F.least(*near).alias("n")).select("id", "n.name", F.round("n.km", 4).alias("km"))


@query("j31_points_in_districts", f"WITH {views.GEO}, b AS (SELECT * FROM (VALUES ('north', 31.0, 32.0, 70.0, 71.5), ('centre', 30.5, 31.5, 70.5, 71.5), ('south', 30.0, 30.6, 70.0, 72.0)) x(name, s, n, w, e)) SELECT name, count(*) AS n_events FROM geo JOIN b ON lat BETWEEN s AND b.n AND lon BETWEEN w AND e GROUP BY name")
def j31(spark, d):
    inside = F.array_compact(F.array(*[F.when(F.col("lat").between(s, n) & F.col("lon").between(w, e), F.lit(name)) for name, s, n, w, e in BOXES]))
    return views.geo_events(spark, d).select(F.explode(inside).alias("name")).groupBy("name").agg(F.count("*").alias("n_events"))


@query("j32_protected_radius", f"WITH {views.GEO}, {_LAND} SELECT id, coalesce((SELECT min(name) FROM land WHERE sqrt(pow(lat - la, 2) + pow(lon - lo, 2)) <= 0.25), 'none') AS area FROM geo")
def j32(spark, d):
    out = F.lit("none")
    for name, la, lo in sorted(LANDMARKS, reverse=True):
        out = F.when(F.sqrt(F.pow(F.col("lat") - la, 2) + F.pow(F.col("lon") - lo, 2)) <= 0.25, name).otherwise(out)
    return views.geo_events(spark, d).select("id", out.alias("area"))


@query("j33_location_to_division", "SELECT c_custkey, CASE WHEN contains(c_name, '00012') THEN 'twelve' WHEN contains(c_name, '0001') THEN 'one' WHEN contains(c_name, '5') THEN 'five' ELSE 'general' END AS division FROM customer")
def j33(spark, d):
    out = F.when(F.contains("c_name", F.lit("00012")), "twelve").when(F.contains("c_name", F.lit("0001")), "one").when(F.contains("c_name", F.lit("5")), "five").otherwise("general")
    return table(spark, d, "customer").select("c_custkey", out.alias("division"))


@query("j34_cases_citing_sections", "SELECT DISTINCT l_orderkey FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_size IN (7, 11, 13) ORDER BY l_orderkey LIMIT 5")
def j34(spark, d):
    return table(spark, d, "lineitem").join(table(spark, d, "part").where(F.col("p_size").isin(7, 11, 13)), F.col("p_partkey") == F.col("l_partkey"), "left_semi").select("l_orderkey").distinct().orderBy("l_orderkey").limit(5)


@query("j35_fixed_path", "SELECT r_name, n_name, c_custkey FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey WHERE contains(c_name, '77') OR contains(n_name, '_7') ORDER BY c_custkey LIMIT 10")
def j35(spark, d):
    rows = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.where(F.contains("c_name", F.lit("77")) | F.contains("n_name", F.lit("_7"))).orderBy("c_custkey").limit(10).select("r_name", "n_name", "c_custkey")


@query("j36_cross_reference_expansion", "WITH seed AS (SELECT DISTINCT l_partkey AS p FROM lineitem WHERE l_orderkey = 1), more AS (SELECT DISTINCT b.l_partkey AS p FROM lineitem a JOIN seed ON a.l_partkey = seed.p JOIN lineitem b ON b.l_orderkey = a.l_orderkey) SELECT p AS part, CAST(min(depth) AS INTEGER) AS depth FROM (SELECT p, 0 AS depth FROM seed UNION ALL SELECT p, 1 FROM more) GROUP BY p")
def j36(spark, d):
    items = table(spark, d, "lineitem", "l_orderkey", "l_partkey")
    seed = items.where("l_orderkey = 1").select("l_partkey").distinct()
    orders = items.join(seed, "l_partkey", "left_semi").select("l_orderkey").distinct()
    more = items.join(orders, "l_orderkey", "left_semi").select("l_partkey").distinct()
    return seed.withColumn("depth", F.lit(0)).unionByName(more.withColumn("depth", F.lit(1))).groupBy(F.col("l_partkey").alias("part")).agg(F.min("depth").alias("depth"))


@query("j37_known_reference_ratio", "SELECT round(count(*) FILTER (user_id IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)) / count(*), 6) AS ratio FROM (SELECT DISTINCT user_id FROM events)")
def j37(spark, d):
    users = table(spark, d, "events", "user_id").distinct()
    known = table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("user_id"), F.lit(1).alias("known"))
    return users.join(known, "user_id", "left").agg(F.round(F.count("known") / F.count("*"), 6).alias("ratio"))


PATTERNS = [("report", r"\|", 2), ("prose", r"tion", 1), ("notes", r"que", 1), ("form", r"[0-9]", 2)]


@query("j38_document_type", r"WITH c AS (SELECT doc_id, len(regexp_extract_all(text, '\|')) * 2 AS report, len(regexp_extract_all(text, 'tion')) AS prose, len(regexp_extract_all(text, 'que')) AS notes, len(regexp_extract_all(text, '[0-9]')) * 2 AS form FROM documents), m AS (SELECT *, greatest(report, prose, notes, form) AS top FROM c) SELECT doc_id, CASE WHEN top = 0 OR (report >= 0.8 * top)::INT + (prose >= 0.8 * top)::INT + (notes >= 0.8 * top)::INT + (form >= 0.8 * top)::INT > 1 THEN 'OTHER' WHEN report = top THEN 'report' WHEN prose = top THEN 'prose' WHEN notes = top THEN 'notes' ELSE 'form' END AS type, round(least(top / 10, 1.0), 4)::DOUBLE AS confidence FROM m")
def j38(spark, d):
    scores = [F.struct((F.regexp_count("text", F.lit(p)) * w).alias("n"), F.lit(name).alias("name")) for name, p, w in PATTERNS]
    rows = table(spark, d, "documents", "doc_id", "text").select("doc_id", F.array(*scores).alias("s")).withColumn("top", F.array_max(F.transform("s", lambda x: x["n"])))
    close = F.size(F.filter("s", lambda x: x["n"] >= 0.8 * F.col("top")))
    winner = F.filter("s", lambda x: x["n"] == F.col("top"))[0]["name"]
    return rows.select("doc_id", F.when((F.col("top") == 0) | (close > 1), "OTHER").otherwise(winner).alias("type"), F.round(F.least(F.col("top") / 10, F.lit(1.0)), 4).alias("confidence"))


@query("j39_first_source_with_rows", f"WITH {views.GEO}, m AS (SELECT *, CASE WHEN type = 'signup' AND k > 98 THEN 1 WHEN type = 'error' THEN 2 WHEN type = 'view' THEN 3 END AS p FROM geo WHERE lat BETWEEN 30.5 AND 31.5), b AS (SELECT source, min(p) AS p FROM m WHERE p IS NOT NULL GROUP BY source), r AS (SELECT m.source, m.id, row_number() OVER (PARTITION BY m.source ORDER BY ts DESC, id) AS rn FROM m JOIN b ON b.source = m.source AND b.p = m.p) SELECT source, id FROM r WHERE rn <= 3")
def j39(spark, d):
    pool = F.when((F.col("type") == "signup") & (F.col("k") > 98), 1).when(F.col("type") == "error", 2).when(F.col("type") == "view", 3)
    rows = first_pool(views.geo_events(spark, d).where(F.col("lat").between(30.5, 31.5)), pool, ["source"])
    return rows.withColumn("rn", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("ts"), "id"))).where("rn <= 3").select("source", "id")


@query("j40_citation_validation", "SELECT event_id, n.n_name AS title, list_sort(list(r.n_name)) AS related FROM (SELECT event_id, CAST(regexp_extract('see section ' || CAST(user_id % 30 AS VARCHAR), 'section ([0-9]+)', 1) AS INTEGER) AS sec FROM events) q LEFT JOIN nation n ON n.n_nationkey = sec LEFT JOIN nation r ON r.n_regionkey = n.n_regionkey AND r.n_nationkey <> n.n_nationkey GROUP BY event_id, n.n_name")
def j40(spark, d):
    sec = F.regexp_extract(F.concat(F.lit("see section "), F.col("user_id") % 30), "section ([0-9]+)", 1).cast("int")
    n = table(spark, d, "nation")
    other = n.select(F.col("n_nationkey").alias("rk"), F.col("n_name").alias("rn"), F.col("n_regionkey").alias("rr"))
    known = n.join(other, (F.col("rr") == F.col("n_regionkey")) & (F.col("rk") != F.col("n_nationkey"))).groupBy("n_nationkey", F.col("n_name").alias("title")).agg(F.array_sort(F.collect_list("rn")).alias("related"))
    rows = table(spark, d, "events").select("event_id", sec.alias("sec")).join(known, F.col("sec") == F.col("n_nationkey"), "left")
    return rows.select("event_id", "title", F.when(F.col("title").isNull(), F.array(F.lit(None).cast("string"))).otherwise(F.col("related")).alias("related"))


@query("j41_applicable_authorities", "SELECT c_custkey, authority, CAST(priority AS INTEGER) AS priority FROM (SELECT c_custkey, 'universal' AS authority, 9 AS priority FROM customer UNION ALL SELECT c_custkey, 'region_' || n_regionkey, 5 FROM customer JOIN nation ON n_nationkey = c_nationkey UNION ALL SELECT c_custkey, 'protected', 1 FROM customer WHERE c_acctbal > 9000)")
def j41(spark, d):
    c = table(spark, d, "customer")
    row = lambda f, name, p: f.select("c_custkey", name.alias("authority"), F.lit(p).alias("priority"))
    regional = c.join(table(spark, d, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    return row(c, F.lit("universal"), 9).unionByName(row(regional, F.concat(F.lit("region_"), F.col("n_regionkey")), 5)).unionByName(row(c.where("c_acctbal > 9000"), F.lit("protected"), 1))


@query("j42_group_by_columns", f"WITH {views.GEO}, c AS (SELECT * FROM (VALUES (0, 70.0, 70.7), (1, 70.7, 71.4), (2, 71.4, 72.0)) x(col, a, z)) SELECT col, min(lat) AS top, max(lat) AS bottom, count(*) AS n FROM geo JOIN c ON lon >= a AND lon < z GROUP BY col")
def j42(spark, d):
    col = F.when(F.col("lon") < 70.7, 0).when(F.col("lon") < 71.4, 1).when(F.col("lon") < 72.0, 2)
    return views.geo_events(spark, d).withColumn("col", col).where("col IS NOT NULL AND lon >= 70").groupBy("col").agg(F.min("lat").alias("top"), F.max("lat").alias("bottom"), F.count("*").alias("n"))


@query("j43_drop_orphans", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F')")
def j43(spark, d):
    kept = table(spark, d, "orders").where("o_orderstatus != 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return table(spark, d, "lineitem", "l_orderkey", "l_linenumber").join(kept, "l_orderkey", "left_semi")


@query("j44_coverage_counts", "SELECT count(*) AS n, count(*) FILTER (EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)) AS linked, count(*) FILTER (NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)) AS unlinked FROM customer")
def j44(spark, d):
    linked = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("linked", F.lit(1))
    return table(spark, d, "customer", "c_custkey").join(linked, "c_custkey", "left").agg(F.count("*").alias("n"), F.count("linked").alias("linked"), F.count_if(F.col("linked").isNull()).alias("unlinked"))


@query("j45_nearest_preceding_reference", f"WITH {views.LOG} SELECT id, last_value(CASE WHEN type = 'signup' THEN id END IGNORE NULLS) OVER (PARTITION BY document ORDER BY ts, id ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS reference FROM log")
def j45(spark, d):
    w = Window.partitionBy("document").orderBy("ts", "id").rowsBetween(-10, -1)
    return views.review_log(spark, d).select("id", F.last(F.when(F.col("type") == "signup", F.col("id")), ignorenulls=True).over(w).alias("reference"))
