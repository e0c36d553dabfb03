"""Mergeable quantile summaries: KLL compactors in numpy, verified by exact ranks.

A summary holds items in levels; an item of level h stands for 2**h rows. Past `MOST` items the lowest
level beyond its capacity is sorted and every other item, from a seeded random start, goes up a level;
of an odd number the greatest stays, so weights add up to the rows exactly. Capacities shrink by a third
a level from K at the top, so K * 3 items and a few suffice for any number of rows. With K = 630 the
standard error of a rank is about 0.17 % of the rows, so 1 % lies six of them away.

Tasks summarise their own rows for all keys at once, in flat arrays of (key, level, item). Summaries
of a key meet in a tree, at most FAN of them at a time, so no task holds more than FAN * MOST items of
a key however many rows, tasks or copies there are. A merge puts levels together and compacts.

Exact ranks (`value_ranks`) count equal values first, then add up in windows of WIDTH neighbouring
values, of WIDTH neighbouring windows and so on: no window holds more than WIDTH rows of a key, whatever
the number of rows. Answers ride along as rows without a count.

Defined cases (`op12_quantile_summaries`): rows whose group or money is null or whose money is not finite or
too large for a long of cents are left out; a null id is batch 0 and one click; repeated clicks count once,
the least by client and value where they differ, repeated lines each time; an item met twice counts with its
least brand and price; summaries of under 20 rows give no row; empty tables give an empty result; extra
columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmesh.runtime import stage, table, unstage

K, MOST, SHRINK, LEAST, LEVELS = 630, 2000, 2 / 3, 2, 60
PARTS = 20
BATCHES = 16
FAN = 64
#: Rows or items that a worker has in its arrays at a time.
CHUNK = 500_000
WIDTH_BITS = 13
SEED = 12


def capacities(top: int, k: int = K) -> list[int]:
    """Of levels 0 to top."""
    return [max(LEAST, math.ceil(k * SHRINK ** (top - h))) for h in range(top + 1)]


_CAPACITY = np.full((LEVELS, LEVELS), np.iinfo(np.int64).max)
for _top in range(LEVELS):
    _CAPACITY[_top, : _top + 1] = capacities(_top)


def coin(*parts) -> np.ndarray:
    """A bit of each row of the parts: a mixing function of 64 bits over all of them."""
    h = np.full(np.shape(parts[0]), SEED, np.uint64)
    for p in parts:
        h = (h ^ np.asarray(p).astype(np.int64).view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(31)
    return (h & np.uint64(1)).astype(np.int64)


def firsts(sorted_keys: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[True, sorted_keys[1:] != sorted_keys[:-1]]) if len(sorted_keys) else np.zeros(0, np.int64)


def compacted(g: np.ndarray, level: np.ndarray, x: np.ndarray, salt: np.ndarray, most: int = MOST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(g, level, x) with no group over `most` items; g numbers groups from 0, salt has a number for each."""
    groups = len(salt)
    done = []
    while len(g):
        size = np.bincount(g, minlength=groups)
        over = size > most
        rest = ~over[g]
        done.append((g[rest], level[rest], x[rest]))
        g, level, x = g[~rest], level[~rest], x[~rest]
        if not len(g):
            break
        which, g = np.unique(g, return_inverse=True)  # the groups that are over, numbered anew
        count = np.bincount(g * LEVELS + level, minlength=len(which) * LEVELS).reshape(-1, LEVELS)
        top = LEVELS - 1 - (count[:, ::-1] > 0).argmax(axis=1)
        lowest = (count > _CAPACITY[top]).argmax(axis=1)
        at = np.flatnonzero(level == lowest[g])
        at = at[np.lexsort((x[at], g[at]))]
        own = g[at]
        start = firsts(own)
        number = np.diff(np.r_[start, len(own)])
        place = np.arange(len(own)) - np.repeat(start, number)
        heads = own[start]
        bit = coin(salt[which[heads]], lowest[heads], number, (count[heads] << np.arange(LEVELS)).sum(axis=1))
        paired = place < np.repeat(number - number % 2, number)
        up = paired & (place % 2 == np.repeat(bit, number))
        level = level.copy()
        level[at[up]] += 1
        keep = np.ones(len(g), bool)
        keep[at[paired & ~up]] = False
        g, level, x = which[g[keep]], level[keep], x[keep]
    return tuple(np.concatenate(c) for c in zip(*done, strict=True)) if done else (g, level, x)


def codes(columns: list) -> tuple[np.ndarray, np.ndarray]:
    """(group of each row, a row of each group), groups in the order of their first appearance when rows are sorted by the columns, else in any."""
    code = np.zeros(len(columns[0]), np.int64)
    for column in columns:
        encoded = pc.dictionary_encode(column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column, null_encoding="encode")
        if isinstance(encoded, pa.ChunkedArray):
            encoded = encoded.combine_chunks()
        both = code * len(encoded.dictionary) + encoded.indices.to_numpy(zero_copy_only=False)
        code = np.unique(both, return_inverse=True)[1]
    first = np.zeros(int(code.max()) + 1, np.int64)
    first[code[::-1]] = np.arange(len(code))[::-1]
    return code, first


def lists(flat: np.ndarray, sizes: np.ndarray, kind) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()), pa.array(flat, kind))


def packed(g: np.ndarray, level: np.ndarray, x: np.ndarray, groups: int) -> list:
    """n, counts and items of each group; every group has an item."""
    order = np.lexsort((x, level, g))
    g, level, x = g[order], level[order], x[order]
    size = np.bincount(g, minlength=groups)
    top = np.zeros(groups, np.int64)
    np.maximum.at(top, g, level)
    base = np.r_[0, np.cumsum(top + 1)]
    counts = np.bincount(base[g] + level, minlength=base[-1])
    n = np.add.reduceat(np.left_shift(1, level), np.r_[0, np.cumsum(size)][:-1]) if groups else size
    return [pa.array(n, pa.int64()), lists(counts, top + 1, pa.int32()), lists(x, size, pa.int64())]


def unpacked(row_group: np.ndarray, counts, items) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(g, level, x) of rows of lists."""
    flat, levels = counts.flatten().to_numpy(), np.diff(counts.offsets.to_numpy())
    place = np.arange(len(flat)) - np.repeat(np.cumsum(levels) - levels, levels)
    size = np.diff(items.offsets.to_numpy())
    return np.repeat(row_group, size), np.repeat(place, flat), items.flatten().to_numpy()


def whole_list(column) -> pa.ListArray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return pa.concat_arrays([column]) if column.offset else column


def _schema(frame: DataFrame, keys: list[str]) -> str:
    kinds = ", ".join(f"{k} {frame.schema[k].dataType.simpleString()}" for k in keys)
    return f"{kinds}, part long, n long, counts array<int>, items array<long>"


def _batches(columns: list, names: list[str]) -> Iterator[pa.RecordBatch]:
    yield from pa.Table.from_arrays(columns, names=names).combine_chunks().to_batches()


def part_summaries(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, part, n, counts, items: what each task has of each key, CHUNK rows at a time. rows: of a table, so that a task run again reads the same."""
    width = len(keys)

    def summarise(table_, part):
        code, first = codes([table_.column(k) for k in range(width)])
        salt = table_.column(width).to_numpy()[first] ^ np.int64(part)
        g, level, x = compacted(code, np.zeros(len(code), np.int64), table_.column(width + 1).to_numpy(), salt)
        heads = [table_.column(k).combine_chunks().take(pa.array(first)) for k in range(width)]
        return _batches([*heads, pa.array(np.full(len(first), part), pa.int64()), *packed(g, level, x, len(first))], [*keys, "part", "n", "counts", "items"])

    def run(batches):
        part, held, size = TaskContext.get().partitionId() << 24, [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= CHUNK:
                yield from summarise(pa.Table.from_batches(held), part)
                part, held, size = part + 1, [], 0
        if size:
            yield from summarise(pa.Table.from_batches(held), part)

    return rows.select(*keys, F.xxhash64(*keys).alias("_salt"), F.col(value).cast("long").alias("_x")).mapInArrow(run, _schema(rows, keys))


def _merge_runs(summaries: DataFrame, keys: list[str]) -> DataFrame:
    """One summary for each run of rows with equal keys. keys: sorted by, within partitions."""
    width = len(keys)

    def merge(table_, code, first):
        salt = table_.column(width).to_numpy()[first]
        g, level, x = unpacked(code, whole_list(table_.column(width + 2)), whole_list(table_.column(width + 3)))
        g, level, x = compacted(g, level, x, salt)
        heads = [table_.column(k).combine_chunks().take(pa.array(first)) for k in range(width)]
        return _batches([*heads, pa.array(table_.column(width + 1).to_numpy()[first]), *packed(g, level, x, len(first))], [*keys, "part", "n", "counts", "items"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += len(batch.column(width + 3).flatten()) + batch.num_rows
            if size >= CHUNK:
                table_ = pa.Table.from_batches(held).combine_chunks()
                code, first = codes([table_.column(k) for k in range(width)])
                last = int(np.flatnonzero(code != code[-1])[-1]) + 1 if len(first) > 1 else 0
                if last:  # the last key may go on
                    own, heads = codes([table_.column(k).slice(0, last) for k in range(width)])
                    yield from merge(table_.slice(0, last).combine_chunks(), own, heads)
                held = table_.slice(last).to_batches()
                size = sum(len(b.column(width + 3).flatten()) + b.num_rows for b in held)
        if held:
            table_ = pa.Table.from_batches(held).combine_chunks()
            yield from merge(table_, *codes([table_.column(k) for k in range(width)]))

    return summaries.select(*keys, F.xxhash64(*keys, "part").alias("_salt"), "part", "counts", "items").mapInArrow(run, _schema(summaries, keys))


def merged(summaries: DataFrame, keys: list[str], parts: int = 1) -> DataFrame:
    """One summary for each key. parts: at most so many are to be merged for a key; over FAN of them meet in a tree."""
    while parts > FAN:
        parts = -(-parts // FAN)
        salted = summaries.withColumn("_slot", F.pmod(F.xxhash64("part"), F.lit(parts)))
        by = [*keys, "_slot"]
        summaries = _merge_runs(salted.repartition(*by).sortWithinPartitions(*by, "part"), by).drop("part").withColumnRenamed("_slot", "part")
    return _merge_runs(summaries.repartition(*keys).sortWithinPartitions(*keys, "part"), keys).drop("part")


def summaries(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, n, counts, items: one KLL summary of `value`, a long, for each key. rows: of a table."""
    parts = rows.rdd.getNumPartitions() + rows.count() // CHUNK
    return merged(part_summaries(rows, keys, value), keys, parts)


def estimates(summaries: DataFrame, keys: list[str], parts: int = PARTS) -> DataFrame:
    """keys, i, n, target, points, answer for i in 1..parts-1: the item at rank ceil(i * n / parts), of summaries of `parts` rows or more."""
    kinds = ", ".join(f"{k} {summaries.schema[k].dataType.simpleString()}" for k in keys)
    width, each = len(keys), np.arange(1, parts)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = batch.num_rows
            n = batch.column(width).to_numpy()
            g, level, x = unpacked(np.arange(rows), whole_list(batch.column(width + 1)), whole_list(batch.column(width + 2)))
            order = np.lexsort((x, g))
            reached = np.cumsum(np.left_shift(1, level[order]))
            target = (n[:, None] * each + parts - 1) // parts
            before = np.cumsum(n) - n
            answer = x[order][np.searchsorted(reached, (before[:, None] + target).ravel())]
            points = np.bincount(g, minlength=rows)
            again = pa.array(np.repeat(np.arange(rows), parts - 1))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k).take(again) for k in range(width)), pa.array(np.tile(each, rows), pa.int32()), *(pa.array(c, pa.int64()) for c in (np.repeat(n, parts - 1), target.ravel(), np.repeat(points, parts - 1), answer))],
                names=[*keys, "i", "n", "target", "points", "answer"],
            )

    enough = summaries.where(F.col("n") >= parts).select(*keys, "n", "counts", "items")
    return enough.mapInArrow(run, f"{kinds}, i int, n long, target long, points long, answer long")


def value_ranks(counts: DataFrame, keys: list[str], value: str) -> DataFrame:
    """counts (keys, value, c and more) with `below`, the c of lesser values of a key, and `n`, that of all. counts: of a table, a row for each key and value."""
    low, high = counts.agg(F.min(value), F.max(value)).first()
    bucket = lambda level: F.shiftright(value, WIDTH_BITS * level)
    levels = 1
    while low is not None and (high >> WIDTH_BITS * levels) - (low >> WIDTH_BITS * levels) >= 1 << WIDTH_BITS:
        levels += 1
    before = lambda part, by: F.coalesce(F.sum("c").over(Window.partitionBy(*part).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    names = [f"_b{level}" for level in range(levels + 1)]
    sums = counts.select(*keys, bucket(1).alias("_b1"), "c").groupBy(*keys, "_b1").agg(F.sum("c").alias("c"))
    stack = []
    for level in range(1, levels + 1):  # of each level's buckets what comes before within the bucket above; at the top, within the key
        above = [*keys, names[level + 1]] if level < levels else keys
        if level < levels:
            sums = sums.withColumn(names[level + 1], F.shiftright(names[level], WIDTH_BITS))
        own = sums.withColumn(f"_before{level}", before(above, names[level]))
        if level == levels:
            own = own.withColumn("n", F.sum("c").over(Window.partitionBy(*keys)))
        stack.append(own.drop("c"))
        if level < levels:
            sums = sums.groupBy(*above).agg(F.sum("c").alias("c"))
    offsets = stack[-1].withColumnRenamed(f"_before{levels}", "_before")
    for level in range(levels - 1, 0, -1):
        offsets = stack[level - 1].join(offsets, [*keys, names[level + 1]]).withColumn("_before", F.col("_before") + F.col(f"_before{level}")).drop(f"_before{level}", names[level + 1])
    own = counts.withColumn("_b1", bucket(1)).withColumn("_own", before([*keys, "_b1"], value))
    return own.join(offsets, [*keys, "_b1"]).withColumn("below", F.col("_before") + F.col("_own")).drop("_b1", "_own", "_before")


def verified(found: DataFrame, rows: DataFrame, keys: list[str], value: str, spread=lambda counts: counts, parts: int = PARTS, percent: int = 1) -> DataFrame:
    """found (of estimates) with exact_x, n_below, n_upto, rank_error and within, exactly. spread: makes of counts by key and value those of all keys of found."""
    counts = stage(rows.groupBy(*keys, value).agg(F.count("*").alias("c")), "value-counts")
    marks = found.select(*keys, F.col("answer").alias(value), F.lit(0).cast("long").alias("c"), F.expr("shiftleft(1L, i)").alias("asked"))  # parts < 63
    every = spread(counts).withColumn("asked", F.lit(0).cast("long")).select(*keys, value, "c", "asked").unionByName(marks)
    # The shuffle that the windows need serves the sums as well.
    near = every.withColumn("_near", F.shiftright(value, WIDTH_BITS)).repartition(*keys, "_near")
    summed = near.groupBy(*keys, "_near", value).agg(F.sum("c").alias("c"), F.sum("asked").alias("asked")).drop("_near")
    ranked = value_ranks(stage(summed, "value-sums"), keys, value)
    unstage(counts)
    first, last = F.expr(f"below * {parts} div n + 1"), F.least(F.lit(parts - 1).cast("long"), F.expr(f"(below + c) * {parts} div n"))
    bounds = ranked.where(F.col("n") >= parts).withColumn("_first", first).withColumn("_last", last)
    targets = F.when(F.col("_first") <= F.col("_last"), F.sequence("_first", "_last")).otherwise(F.array().cast("array<long>"))
    asked = F.filter(F.sequence(F.lit(1).cast("long"), F.lit(parts - 1).cast("long")), lambda i: F.expr("asked").bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), i.cast("int"))) != 0)
    none = F.lit(None).cast("long")
    hits = F.concat(
        F.transform(targets, lambda i: F.struct(i.cast("int").alias("i"), F.col(value).alias("exact_x"), none.alias("n_below"), none.alias("n_upto"))),
        F.transform(F.when(F.col("asked") != 0, asked).otherwise(F.array().cast("array<long>")), lambda i: F.struct(i.cast("int").alias("i"), none.alias("exact_x"), F.col("below").alias("n_below"), (F.col("below") + F.col("c")).alias("n_upto"))),
    )
    exact = bounds.where("_first <= _last OR asked <> 0").select(*keys, F.explode(hits).alias("h")).select(*keys, "h.*")
    facts = exact.groupBy(*keys, "i").agg(*(F.max(c).alias(c) for c in ("exact_x", "n_below", "n_upto")))
    same = [F.col(f"f.{k}").eqNullSafe(F.col(f"e.{k}")) for k in (*keys, "i")]
    joined = found.alias("f").join(facts.alias("e"), same).select("f.*", "exact_x", "n_below", "n_upto")
    error = F.greatest(F.lit(0).cast("long"), F.col("n_below") + 1 - F.col("target"), F.col("target") - F.col("n_upto"))
    return joined.withColumn("rank_error", error).withColumn("within", F.col("rank_error") * 100 <= F.col("n") * percent)


def streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """stream, grp, batch, x of both streams."""
    clicks = table(spark, sf_dir, "clicks", "click_id", "client_id", "value")
    value = (
        clicks.groupBy("click_id").agg(F.min(F.struct("client_id", "value")).alias("r"))
        .select(F.lit("value").alias("stream"), F.col("r.client_id").cast("string").alias("grp"), F.col("click_id").cast("string").alias("id"), F.col("r.value").alias("money"))
    )
    items = table(spark, sf_dir, "items", "item_id", "brand", "price").groupBy("item_id").agg(F.min(F.struct("brand", "price")).alias("r"))
    items = stage(items.where("r.brand IS NOT NULL AND r.price IS NOT NULL"), "items")  # a join of two shuffles only is one whose hot keys Spark splits
    lines = table(spark, sf_dir, "sale_lines", "item_id", "vendor_id")
    price = lines.join(items, "item_id").select(F.lit("price").alias("stream"), F.col("r.brand").alias("grp"), F.col("vendor_id").cast("string").alias("id"), F.col("r.price").alias("money"))
    rows = value.unionByName(price).where(F.col("grp").isNotNull() & F.col("money").isNotNull() & ~F.isnan("money") & (F.abs("money") < 4.6e16))
    batch = F.coalesce(F.pmod(F.crc32("id"), F.lit(BATCHES)), F.lit(0)).cast("int")
    return rows.withColumn("batch", batch).select("stream", "grp", "batch", (F.floor(100 * F.col("money") + 0.5) + 1000 * F.col("batch")).alias("x"))


KEYS = ["stream", "grp", "batch"]
WHOLE = -1


def batch_quantiles(rows: DataFrame) -> DataFrame:
    """The quantiles of every batch of a group and of the whole that merging the batches' summaries gives, verified. rows: of a table."""
    batches = stage(summaries(rows, KEYS, "x"), "batch-summaries")
    whole = merged(batches.withColumn("part", F.col("batch").cast("long")).withColumn("batch", F.lit(WHOLE)), KEYS)
    found = stage(estimates(batches.unionByName(whole), KEYS), "quantiles")
    unstage(batches)
    return verified(found, rows, KEYS, "x", lambda counts: counts.withColumn("batch", F.explode(F.array("batch", F.lit(WHOLE)))))


def op12_quantile_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stage(streams(spark, sf_dir), "streams")
    out = batch_quantiles(rows)
    unstage(rows)
    return out.select(*KEYS, "i", "n", "target", "exact_x", "points", "answer", "n_below", "n_upto", "rank_error", "within")
