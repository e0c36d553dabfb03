"""Mixing sources to target weights, block by block.

Each source is a stream of words, its documents laid end to end, cut into blocks of `block` words.
A mix has as many words as the corpus; its slots (one block each) are dealt to output shards: each
source draws its slot counts over the shards from a multinomial, halved level by level down a tree of
shards, so that every source ends at its target exactly and a shard's counts are those of a multinomial
over sources. A source's slots pass over its blocks in the order of a keyed permutation, a new one for
each pass: every block comes once before any comes twice. Of the last pass, which can't take them all,
each shard owns an equal stretch of places and takes as many from its start as a draw of its own gives it
(never more than it owns), so which blocks come once more is the draw's to say. Slots and blocks are joined
by (source, block).

Nothing is sorted or gathered by source: word offsets are prefix sums over (source, hash bucket), so
a source with a third of all rows is spread over as many tasks as any other third. Sources are rows
of a table, of any number: they are ranked by sorted ranges, their targets are found by a few sums
over them, and each draws its slots by itself; slots are placed in runs of RUN over many tasks.

Defined cases: a null text has size 0 and is never taken; a null source is a source of its own, the
last; a null doc_id is kept; repeated rows are documents of their own, each with its own words; an
empty table or one without words gives targets 0; extra columns are not read, and those of the rows
that `mix_documents` carries may have any name.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmesh.runtime import numbered, stage, table

WORD = r"[^\x20\x09-\x0D]+"
BLOCK = 64
MOST = 3
SEED = 20
#: Slots of an output shard, about.
SHARD_SLOTS = 1 << 12
#: Shards whose draw goes on in a task of its own.
SUBTREE = 1 << 14
#: Slots that are placed in one go, and by one task, about.
RUN = 1 << 12
TASK_SLOTS = 20_000
BUCKET_ROWS = 20_000


def with_targets(sources: DataFrame, most: int = MOST) -> DataFrame:
    """Adds `target` to (size, weight) rows: all sizes shared by weight, at most `most` times a source, the excess shared again.

    What is over its most keeps that; the rest is shared over the others, until none is over: each
    round is two exact sums over the sources, and takes at least one of them out.
    """
    size, weight = F.col("size").cast("decimal(38,0)"), F.col("weight").cast("decimal(38,0)")
    total = sources.agg(F.sum(size)).first()[0] or 0
    rest, weights, over = int(total), None, F.lit(False)
    while True:
        state = sources.where("size > 0").where(~over).agg(F.sum(weight)).first()[0] or 0
        kept = sources.where("size > 0").where(over).agg(F.sum(size)).first()[0] or 0
        if weights == int(state):
            break
        weights, rest = int(state), int(total) - most * int(kept)
        if not weights:
            break
        # Over for good: a source taken out leaves more to each of the others.
        over = (size * F.lit(most * weights).cast("decimal(38,0)") < weight * F.lit(rest).cast("decimal(38,0)"))
    share = weight.cast("double") * F.lit(float(rest)) / F.lit(float(weights or 1))
    return sources.withColumn("target", F.when(F.col("size") == 0, F.lit(0.0)).when(over, F.col("size").cast("double") * most).otherwise(share))


@dataclass
class Mix:
    """A mix's plan: (source, source_id, size, n, weight, target, blocks, slots) for every source, staged, and the sums of its rows and slots."""

    sources: DataFrame
    n_rows: int
    n_slots: int

    @property
    def shards(self) -> int:
        return max(1, -(-self.n_slots // SHARD_SLOTS))


def owned(low, width, shards: int, places: int):
    """How many of a source's places the shards low to low + width own, of equal stretches."""
    return (low + width) * places // shards - low * places // shards


def split(slots: int, shards: int, seed: int, source_id: int, low: int = 0, width: int | None = None, stop: int = 1, places: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first shard, width, count): a multinomial draw of so many slots over `width` equal shards from `low`, none left over, down to subtrees of `stop` shards.

    Those without any aren't named. places: how many of them the shards own together, where none may take more than its own.
    """
    rng = np.random.default_rng((seed, source_id, low, stop, bool(places)))
    low, width, count = np.array([low]), np.array([shards if width is None else width]), np.array([slots])
    while len(width) and width.max() > stop:
        left = np.where(width > stop, width // 2, width)
        rest = width - left
        if places:
            room, more = owned(low, left, shards, places), owned(low + left, rest, shards, places)
            first = np.clip(rng.binomial(count, room / np.maximum(room + more, 1)), count - more, room)
        else:
            first = rng.binomial(count, left / width)
        low = np.stack([low, low + left], axis=1).ravel()
        count = np.stack([first, count - first], axis=1).ravel()
        width = np.stack([left, rest], axis=1).ravel()
        some = count > 0
        low, width, count = low[some], width[some], count[some]
    return low[count > 0], width[count > 0], count[count > 0]


def permuted(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """A keyed pseudorandom permutation of range(n): a four-round Feistel network, walked until it lands inside."""
    half = max(1, (max(1, (n - 1).bit_length()) + 1) // 2)
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    keys = [np.uint64((key * 0x9E3779B97F4A7C15 + r * 0xD1B54A32D192ED03) & 0xFFFFFFFFFFFFFFFF) for r in range(1, 5)]

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> shift, x & mask
        for k in keys:
            z = right + k
            z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            left, right = right, left ^ ((z ^ (z >> np.uint64(31))) & mask)
        return (left << shift) | right

    with np.errstate(over="ignore"):
        out = once(index.astype(np.uint64))
        while (outside := out >= n).any():
            out[outside] = once(out[outside])
    return out.astype(np.int64)


# ---------------------------------------------------------------- DataFrames


def sized(docs: DataFrame) -> DataFrame:
    """(rid, doc_id, source, size, row): every row of docs whole, its words counted, with a row id that stays once staged."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    return docs.select("doc_id", F.col("source").cast("string").alias("source"), size.alias("size"), row.alias("row"), F.monotonically_increasing_id().alias("rid"))


def plan_mix(base: DataFrame, weights: dict | None = None, block: int = BLOCK) -> Mix:
    """The plan for staged (rid, doc_id, source, size) rows; `weights` gives the whole-number weight of every source, else they weigh 1, 2, 3, repeating."""
    found = base.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n"))
    ranked = numbered(stage(found, "sources"), "source-ranks", F.col("source").isNull(), F.col("source")).withColumnRenamed("_number", "source_id")
    if weights is None:
        ranked = ranked.withColumn("weight", F.col("source_id") % 3 + 1)
    else:
        given = base.sparkSession.createDataFrame([(s, int(w)) for s, w in weights.items()], "named string, weight long")
        ranked = ranked.join(given, F.col("source").eqNullSafe(F.col("named"))).drop("named")
    blocks = F.expr(f"(size + {block - 1}) div {block}")
    slots = F.when(F.col("size") > 0, F.least(F.col("blocks") * MOST, F.rint(F.col("target") * F.col("blocks") / F.col("size")).cast("long"))).otherwise(F.lit(0).cast("long"))
    sources = stage(with_targets(stage(ranked, "weights")).withColumn("blocks", blocks).withColumn("slots", slots), "mix-plan")
    sums = sources.agg(F.sum("n"), F.sum("slots")).first()
    return Mix(sources, sums[0] or 0, sums[1] or 0)


def offsets(base: DataFrame, mix: Mix) -> DataFrame:
    """Adds source_id, source_size, target and `start`, the words of its source before the document."""
    known = mix.sources.select(F.col("source").alias("named"), "source_id", F.col("size").alias("source_size"), "target")
    buckets = max(1, -(-mix.n_rows // BUCKET_ROWS))
    keyed = base.join(known, F.col("source").eqNullSafe(F.col("named"))).drop("named")  # broadcast by the planner, if small by its files
    keyed = keyed.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "size"), F.lit(buckets)))
    earlier = Window.partitionBy("source_id").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = (
        keyed.groupBy("source_id", "bucket").agg(F.sum("size").alias("n"))
        .select("source_id", "bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    )
    own = Window.partitionBy("source_id", "bucket").orderBy("doc_id", "size", "rid").rowsBetween(Window.unboundedPreceding, -1)
    return (
        keyed.withColumn("own", F.coalesce(F.sum("size").over(own), F.lit(0)))
        .join(before, ["source_id", "bucket"])
        .withColumn("start", F.col("before") + F.col("own"))
        .drop("bucket", "before", "own")
    )


def block_parts(placed: DataFrame, block: int = BLOCK) -> DataFrame:
    """A row for each block that a document touches: `block`, and the document's words lo..hi that lie in it."""
    size, start = F.col("size"), F.col("start")
    first, last = F.expr(f"start div {block}"), F.expr(f"(start + size - 1) div {block}")
    blocks = F.when(size > 0, F.sequence(first, last))
    return (
        placed.withColumn("block", F.explode_outer(blocks))
        .withColumn("lo", F.greatest(F.lit(0), F.col("block") * block - start))
        .withColumn("hi", F.least(size, (F.col("block") + 1) * block - start))
    )


def slot_blocks(mix: Mix, seed: int = SEED) -> DataFrame:
    """(shard, source_id, slot, block): what each slot of the mix takes. A slot's number is its pass and its place in that."""
    shards = mix.shards
    names = ["source_id", "blocks", "slots", "places", "low", "width", "first", "n"]

    def begin(batches):
        """Whole passes and the last one, each dealt to subtrees of shards."""
        for batch in batches:
            out: list = []
            for source, slots, blocks in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                over = slots % blocks
                for own, places in ((slots - over, 0), (over, blocks)):
                    low, width, count = split(own, shards, seed, source, stop=SUBTREE, places=places)
                    first = np.cumsum(count) - count
                    out += [(source, blocks, slots - over, places, *r) for r in zip(low.tolist(), width.tolist(), first.tolist(), count.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else [[]] * 8)], names=names)

    def draw(batches):
        for batch in batches:
            for source, blocks, slots, places, top, width, before, n in zip(*(batch.column(k).to_pylist() for k in range(8)), strict=True):
                shard, _, counts = split(n, shards, seed, source, top, width, places=places)
                first = slots + shard * blocks // shards if places else before + np.cumsum(counts) - counts
                each = -(-counts // RUN)  # runs of a shard
                at = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
                start, left = np.repeat(first, each) + at * RUN, np.repeat(counts, each) - at * RUN
                for k in range(0, len(start), 1 << 14):
                    part = slice(k, k + (1 << 14))
                    columns = [np.repeat(shard, each)[part], None, start[part], np.minimum(left[part], RUN), None]
                    columns[1], columns[4] = np.full(len(columns[0]), source), np.full(len(columns[0]), blocks)
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["shard", "source_id", "first", "n", "blocks"])

    def place(batches):
        for rows in batches:
            for shard, source, first, n, blocks in rows.itertuples(index=False):
                slots = np.arange(first, first + n, dtype=np.int64)
                taken = np.empty_like(slots)
                for epoch in range(int(slots[0]) // blocks, int(slots[-1]) // blocks + 1):
                    here = slots // blocks == epoch
                    taken[here] = permuted(slots[here] % blocks, blocks, seed * 1_000_003 + source * 101 + epoch)
                yield pd.DataFrame({"shard": shard, "source_id": source, "slot": slots, "block": taken})

    trees = mix.sources.where("slots > 0").select("source_id", "slots", "blocks").mapInArrow(begin, ", ".join(f"{c} long" for c in names))
    if shards > SUBTREE:
        trees = trees.repartition("source_id", "low", "places")
    runs = trees.mapInArrow(draw, "shard long, source_id long, first long, n long, blocks long")
    tasks = max(1, -(-mix.n_slots // TASK_SLOTS))
    return runs.repartition(tasks, "source_id", "first").mapInPandas(place, "shard long, source_id long, slot long, block long")


def taken_parts(parts: DataFrame, slots: DataFrame) -> DataFrame:
    """Block parts and `times`, the slots that take their block: the join of slots and blocks by index."""
    times = slots.groupBy("source_id", "block").agg(F.count("*").alias("times"))
    # The plan's few rows stand for all slots: by their size alone the planner would broadcast these.
    return parts.join(times.hint("merge"), ["source_id", "block"], "left").withColumn("times", F.coalesce("times", F.lit(0)))


def mix_taken(docs: DataFrame, weights=None, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target, taken for every row of docs."""
    base = stage(sized(docs).drop("row"), "mix-sizes")
    mix = plan_mix(base, weights, block)
    parts = taken_parts(block_parts(offsets(base, mix), block), slot_blocks(mix, seed))
    return (
        parts.groupBy("rid").agg(
            *[F.first(c).alias(c) for c in ("doc_id", "source", "size", "source_size", "target")],
            F.coalesce(F.sum((F.col("hi") - F.col("lo")) * F.col("times")), F.lit(0)).alias("taken"),
        ).drop("rid")
    )


def mix_shards(docs: DataFrame, weights=None, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """The mix itself: (shard, source, slot, block, words), one row a slot, its words joined by single spaces."""
    base = stage(sized(docs.select("doc_id", "source", "text")).withColumn("text", F.col("row.text")).drop("row"), "mix-texts")
    mix = plan_mix(base, weights, block)
    parts = block_parts(offsets(base, mix), block).where("block IS NOT NULL")
    words = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), (F.col("lo") + 1).cast("int"), (F.col("hi") - F.col("lo")).cast("int")), " ")
    pieces = parts.select("source_id", "source", "block", (F.col("start") + F.col("lo")).alias("at"), words.alias("words"))
    blocks = pieces.groupBy("source_id", "source", "block").agg(F.array_sort(F.collect_list(F.struct("at", "words"))).alias("parts"))  # `block` words at most
    joined = slot_blocks(mix, seed).join(blocks, ["source_id", "block"])
    return joined.select("shard", "source", "slot", "block", F.array_join(F.transform("parts", lambda p: p["words"]), " ").alias("words"))


def mix_documents(docs: DataFrame, weights=None, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """docs after the mix, in their own columns: a row for each pass that takes words of a document.

    A pass that takes a whole document returns its text as it is; one that takes some of its blocks
    returns these, each as it stands in the text, joined by single spaces. Documents of which no
    block is taken are gone; one that is taken three times has three rows.
    """
    base = stage(sized(docs), "mix-documents")
    mix = plan_mix(base, weights, block)
    parts = taken_parts(block_parts(offsets(base.drop("row"), mix), block), slot_blocks(mix, seed))
    # At most a document's own blocks come together.
    ranges = parts.where("times > 0").groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("lo", "hi", "times"))).alias("ranges"))

    def cut(batches):
        import re

        word = re.compile(WORD)
        for batch in batches:
            texts, ranges, sizes = (batch.column(n).to_pylist() for n in ("text", "ranges", "size"))
            rows, out = [], []
            for k, (text, own, size) in enumerate(zip(texts, ranges, sizes, strict=True)):
                places = None
                for epoch in range(1, max(r["times"] for r in own) + 1):
                    runs: list[list[int]] = []
                    for r in own:
                        if r["times"] >= epoch:
                            if runs and runs[-1][1] == r["lo"]:
                                runs[-1][1] = r["hi"]
                            else:
                                runs.append([r["lo"], r["hi"]])
                    if runs == [[0, size]]:
                        rows.append(k)
                        out.append(text)
                    elif runs:
                        places = places or [m.span() for m in word.finditer(text)]
                        rows.append(k)
                        out.append(" ".join(text[places[lo][0] : places[hi - 1][1]] for lo, hi in runs))
            yield pa.RecordBatch.from_arrays([batch.column("row").take(pa.array(rows, pa.int64())), pa.array(out, pa.string())], names=["row", "taken"])

    # The text goes by itself, so that a row that is taken again doesn't carry it twice.
    bare = F.struct(*[F.col("row").getField(c).alias(c) for c in docs.columns if c != "text"], F.lit(0).alias("_"))
    joined = base.join(ranges, "rid").select(bare.alias("row"), F.col("row.text").alias("text"), "ranges", "size")
    schema = T.StructType([joined.schema["row"], T.StructField("taken", T.StringType())])
    changed = {"text": F.col("taken")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.length("taken").cast(docs.schema["n_chars"].dataType)
    return joined.mapInArrow(cut, schema).select(*[(changed[c] if c in changed else F.col("row").getField(c)).alias(c) for c in docs.columns])


def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_taken(table(spark, sf_dir, "documents", "doc_id", "source", "text"))
