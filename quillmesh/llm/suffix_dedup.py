"""Exact substring dedup: which bytes lie in a string of `LENGTH` bytes that starts somewhere else too.

Suffixes are sorted by the difference-cover algorithm (suffix_array.py), distributed by a cover of
the same kind that content chooses: in every window of LENGTH bytes the least k-gram by hash, the
leftmost of several. Like a difference cover it puts a sample at the same distance into any two
windows that are equal, so equal windows meet under one sample; one position in about 69 is one.

1. The sampled k-grams are named by hash and counted over the corpus; a sample whose name comes once
   rules out every window that it stands for.
2. Samples that are left carry their context, the bytes of the windows that they stand for, and meet
   by name. Contexts that are equal are repeated as they stand. Of the others all suffixes are
   sorted: triples at positions 1 and 2 modulo 3, recursion on their names, the rest merged in.
3. Adjacent windows in that order are compared over LENGTH bytes.

One suffix array of the whole corpus would move every suffix in each round, many times the disk
that a pass may use (README); this moves a fraction of them once and gives the same bytes.

Names are met by hash exchange. A name with over `GROUP` contexts is split first (`split_names`):
contexts that are equal count as one, and two others share a window only if they agree for long
enough before the sample or behind it, so they meet by more of their bytes, until a name is small
enough to be sorted or is a whole window itself.

Defined cases: a null text is an empty one; texts shorter than LENGTH lose nothing; repeated rows
and copies cover each other wholly; a null doc_id is kept; an empty table gives an empty result;
extra columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.llm.suffix_array import suffix_array
from quillmesh.llm.worker_state import only
from quillmesh.runtime import stage, table

LENGTH = 200
GRAM = 64
#: Bytes of a window besides its sample.
REST = LENGTH - GRAM
#: Contexts of one name that one task may hold and sort (about 300 bytes each); names with more are split.
GROUP = 20_000
#: Bytes handled at once; an index into them fits 20 bits.
PIECE = 1 << 19
UNIT = 4 << 20
#: Bytes that one suffix array sorts, unless one name has more.
SORTED = 1_500_000
BASE = 0xB5AD4ECEDA1CE2A9
INVERSE = pow(BASE, -1, 1 << 64)
MIX = np.uint64(0x9E3779B97F4A7C15)
LOW = np.uint64((1 << 20) - 1)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base))
    out[0] = 1
    return np.multiply.accumulate(out)


def tables() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse."""
    return only("powers", lambda: (_powers(BASE, 1 << 20), _powers(INVERSE, 1 << 20)))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * MIX
    return x ^ (x >> np.uint64(29))


def window_hashes(data: np.ndarray, *lengths: int) -> list[np.ndarray]:
    """A 64-bit hash of data[i:i+length] for every i, for each length; under 2^20 bytes."""
    up, down = tables()
    n = len(data)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(data.astype(np.uint64) * up[:n] + up[:n], out=sums[1:])
    return [mixed((sums[length:] - sums[:-length]) * down[: n + 1 - length]) if n >= length else np.zeros(0, np.uint64) for length in lengths]


def samples(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """(at, name, lo, hi) of the samples of texts that lie end to end in `data`: a sample stands for the windows that start at lo..hi."""
    if len(data) < LENGTH:
        return tuple(np.zeros(0, t) for t in (np.int64, np.uint64, np.int64, np.int64))
    (names,) = window_hashes(data, GRAM)
    width = LENGTH - GRAM + 1
    least = (names & ~LOW) | np.arange(len(names), dtype=np.uint64)
    span = 1
    while 2 * span <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if width > span:
        least = np.minimum(least[: len(data) - LENGTH + 1], least[width - span :][: len(data) - LENGTH + 1])
    steps = np.zeros(len(least) + 1, np.int32)  # window starts that lie in a text
    inside = ends - begins >= LENGTH
    np.add.at(steps, begins[inside], 1)
    np.add.at(steps, ends[inside] - LENGTH + 1, -1)
    starts = np.flatnonzero(np.cumsum(steps[:-1]))
    if not len(starts):
        return tuple(np.zeros(0, t) for t in (np.int64, np.uint64, np.int64, np.int64))
    at = (least[starts] & LOW).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1])]))
    return at[new], names[at[new]], starts[new], starts[np.concatenate([new[1:], [len(starts)]]) - 1]


def pieces(texts: list[bytes]):
    """Yields (data, begins, ends, owners, bases): texts end to end, long ones in pieces that overlap by LENGTH - 1."""
    parts, owners, bases, size = [], [], [], 0
    step = PIECE - LENGTH + 1

    def out():
        lengths = np.array([len(p) for p in parts], np.int64)
        ends = np.cumsum(lengths)
        return np.frombuffer(b"".join(parts), np.uint8), ends - lengths, ends, np.array(owners), np.array(bases, np.int64)

    for k, text in enumerate(texts):
        for base in range(0, max(1, len(text) - LENGTH + 1), step):
            part = text[base : base + PIECE]
            if size + len(part) > PIECE and parts:
                yield out()
                parts, owners, bases, size = [], [], [], 0
            parts.append(part)
            owners.append(k)
            bases.append(base)
            size += len(part)
    if parts:
        yield out()


def sampled(texts: list[bytes]):
    """Yields (owner, at, name, lo, hi) arrays; positions count from the start of the owner's text."""
    for data, begins, ends, owners, bases in pieces(texts):
        at, name, lo, hi = samples(data, begins, ends)
        piece = np.searchsorted(ends, at, side="right")
        shift = bases[piece] - begins[piece]
        yield owners[piece], at + shift, name, lo + shift, hi + shift


def shared_windows(texts: list[bytes]) -> np.ndarray:
    """Per byte of the texts laid end to end: a window starts here that starts in another place of them too.

    All suffixes are sorted, each text closed by a letter of its own; windows that are equal stand
    side by side, so each is compared with the next one only, eight bytes at a time.
    """
    lengths = np.array([len(t) for t in texts], np.int64)
    closed = np.cumsum(lengths + 1)
    letters = np.zeros(int(closed[-1]), np.int32)
    inside = np.ones(len(letters), bool)
    inside[closed - 1] = False
    data = np.frombuffer(b"".join(texts), np.uint8)
    letters[inside] = data
    letters[closed - 1] = 256 + np.arange(len(texts))
    starts = np.zeros(len(letters), bool)
    for begin, length in zip((closed - lengths - 1).tolist(), lengths.tolist(), strict=True):
        starts[begin : begin + length - LENGTH + 1] = True
    order = suffix_array(letters)
    windows = order[starts[order]].astype(np.int32)
    del order
    words = np.zeros(len(letters) - 7, np.uint64)
    for k in range(8):
        words <<= np.uint64(8)
        words |= (letters[k : k + len(words)] & 255).astype(np.uint64)
    same = np.arange(len(windows) - 1)
    for at in (*range(LENGTH - 8, -1, -8), 0):
        same = same[words[windows[same] + at] == words[windows[same + 1] + at]]
    found = np.zeros(len(letters), bool)
    found[windows[same]] = True
    found[windows[same + 1]] = True
    return found[inside]


def repeated_windows(contexts: list[bytes], names: np.ndarray) -> list[tuple[int, int, int]]:
    """(context, from, to): runs of window starts, within contexts, whose window comes in another place too.

    The contexts of a name must all be here, each for a place of its own.
    """
    codes, distinct = pd.factorize(np.array(contexts, dtype=object))
    copies = np.bincount(codes, minlength=len(distinct))
    out = [(k, 0, len(contexts[k]) - LENGTH) for k in np.flatnonzero(copies[codes] > 1).tolist()]
    first = np.full(len(distinct), -1)
    first[codes[::-1]] = np.arange(len(codes))[::-1]
    _, group, each = np.unique(names[first], return_inverse=True, return_counts=True)
    mine = np.flatnonzero(each[group] > 1)  # distinct contexts with others of their name
    if not len(mine):
        return out
    texts = [distinct[k] for k in mine]
    lengths = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(lengths)
    begins = ends - lengths
    data = np.frombuffer(b"".join(texts), np.uint8)
    hit = np.zeros(len(data), bool)
    breaks = [*(np.flatnonzero(group[mine][1:] != group[mine][:-1]) + 1).tolist(), len(texts)]  # names stay whole
    a = 0
    for k, z in enumerate(breaks):
        if k + 1 == len(breaks) or ends[breaks[k + 1] - 1] - begins[a] > SORTED:
            hit[begins[a] : ends[z - 1]] = shared_windows(texts[a:z])
            a = z
    owners = {int(code): k for k, code in enumerate(codes) if copies[code] == 1}
    marks = np.diff(np.concatenate([[0], hit.view(np.int8), [0]]))
    for b, e in zip(np.flatnonzero(marks == 1).tolist(), np.flatnonzero(marks == -1).tolist(), strict=True):
        text = int(np.searchsorted(ends, b, side="right"))
        context = owners.get(int(mine[text]))
        if context is not None:
            out.append((context, b - int(begins[text]), e - 1 - int(begins[text])))
    return out


# ---------------------------------------------------------------- DataFrames


def as_bytes(texts: list[str | None]) -> list[bytes]:
    return [(t or "").encode("utf-8", "surrogatepass") for t in texts]


def all_samples(docs: DataFrame) -> DataFrame:
    """(name, text_key, at) of every sample of every text."""

    def run(batches):
        for batch in batches:
            keys = batch.column(0).to_numpy()
            for owner, at, name, _, _ in sampled(as_bytes(batch.column(1).to_pylist())):
                yield pa.RecordBatch.from_arrays([pa.array(name.view(np.int64)), pa.array(keys[owner]), pa.array(at.astype(np.int32))], names=["name", "text_key", "at"])

    return docs.select(F.xxhash64("text").alias("text_key"), "text").mapInArrow(run, "name long, text_key long, at int")


def contexts(candidates: DataFrame) -> DataFrame:
    """(name, digest, at, lo, context) for (digest, text, places) rows; copies are left out where met."""

    def run(batches):
        met: set[bytes] = set()
        for batch in batches:
            digests = batch.column(0).to_pylist()
            keep = []
            for k, digest in enumerate(digests):
                if digest not in met:
                    met.add(digest)
                    keep.append(k)
            if len(met) > 500_000:
                met.clear()
            batch = batch.take(pa.array(keep, pa.int64()))
            texts = as_bytes(batch.column(1).to_pylist())
            sets = [np.asarray(p.values) for p in batch.column(2)]
            digests = batch.column(0).to_pylist()
            for owner, at, name, lo, hi in sampled(texts):
                rows: list[list] = [[], [], [], [], []]
                cuts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]])) if len(owner) else []
                for a, z in zip(cuts, [*cuts[1:], len(owner)], strict=True):
                    o = int(owner[a])
                    taken = a + np.flatnonzero(np.isin(at[a:z], sets[o]))
                    text = texts[o]
                    rows[0].append(name[taken].view(np.int64))
                    rows[1] += [digests[o]] * len(taken)
                    rows[2].append(at[taken])
                    rows[3].append(lo[taken])
                    rows[4] += [text[x : y + LENGTH] for x, y in zip(lo[taken].tolist(), hi[taken].tolist(), strict=True)]
                if rows[1]:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate(rows[0])), pa.array(rows[1], pa.binary()), pa.array(np.concatenate(rows[2])), pa.array(np.concatenate(rows[3])), pa.array(rows[4], pa.binary())],
                        names=["name", "digest", "at", "lo", "context"],
                    )

    return candidates.mapInArrow(run, "name long, digest binary, at long, lo long, context binary")


def gathered_spans(found: DataFrame) -> DataFrame:
    """(digest, begin, end) of repeated bytes: names met in tasks, a unit of whole names at a time.

    A place comes once under the names of a branch, but may come in several branches: they are sorted apart.
    """

    def unit(columns):
        name, digest, branch, lo, texts = columns
        once = np.concatenate([[True], (name[1:] != name[:-1]) | (lo[1:] != lo[:-1]) | (digest[1:] != digest[:-1]) | (branch[1:] != branch[:-1])])
        name, digest, branch, lo, texts = name[once], digest[once], branch[once], lo[once], texts[once]
        spans = []
        for b in np.unique(branch):
            own = np.flatnonzero(branch == b)
            spans += [(own[k], *span) for k, *span in repeated_windows(list(texts[own]), name[own])]
        rows = np.array([s[0] for s in spans], np.int64)
        begin = lo[rows] + np.array([s[1] for s in spans], np.int64)
        end = lo[rows] + np.array([s[2] for s in spans], np.int64) + LENGTH
        return pa.RecordBatch.from_arrays([pa.array(digest[rows].tolist(), pa.binary()), pa.array(begin), pa.array(end)], names=["digest", "begin", "end"])

    def objects(column):
        out = np.empty(len(column), object)
        out[:] = column.to_pylist()
        return out

    def run(batches):
        carry = None
        for batch in batches:
            columns = [batch.column(0).to_numpy(), objects(batch.column(1)), batch.column(2).to_numpy(), batch.column(3).to_numpy(), objects(batch.column(4))]
            if carry is not None:
                columns = [np.concatenate(pair) for pair in zip(carry, columns, strict=True)]
            name = columns[0]
            cuts = np.flatnonzero(name[1:] != name[:-1]) + 1
            carry = columns
            if len(cuts) and sum(map(len, columns[4])) >= UNIT:
                yield unit([c[: cuts[-1]] for c in columns])
                carry = [c[cuts[-1] :] for c in columns]
        if carry is not None and len(carry[0]):
            yield unit(carry)

    met = found.select("name", "digest", "branch", "lo", "context").repartition("name").sortWithinPartitions("name", "branch", "digest", "lo")
    return met.mapInArrow(run, "digest binary, begin long, end long")


def split_names(found: DataFrame, group: int) -> tuple[DataFrame, DataFrame]:
    """(contexts by branch under names of at most `group`, (digest, begin, end) of bytes that repeat) for the contexts of crowded names.

    A context whose bytes come in two places repeats as it stands; one of each goes on. A window
    with o bytes before its sample has REST - o behind it. A name stands for windows with l to
    REST - r bytes before the sample: its contexts agree on the l bytes before and the r behind. A
    crowded name is halved, o up to the middle (more bytes behind agree) and beyond it (more before),
    so after eight rounds at most l + r = REST and its contexts agree on a whole window.
    """
    found = stage(found.select("digest", "at", "lo", "context", F.unhex(F.md5("context")).alias("same")), "crowded")
    place = F.xxhash64("digest", "lo")
    heads = found.groupBy("same").agg(F.first(F.struct("digest", "at", "lo", "context")).alias("head"), F.min(place).alias("a"), F.max(place).alias("z"))
    heads = stage(heads, "crowded-heads")
    repeated = found.join(heads.where("a != z").select("same"), "same")
    spans = repeated.select("digest", F.col("lo").alias("begin"), (F.col("lo") + F.length("context")).alias("end"))
    front, small = heads.select("head.*", F.lit(0).alias("l"), F.lit(0).alias("r")), None
    while True:
        part = F.expr(f"substring(context, int(at - lo) - l + 1, l + {GRAM} + r)")
        front = stage(front.withColumn("part", F.unhex(F.md5(part))), "split-contexts")
        names = stage(front.groupBy("part", "l", "r").agg(F.count("*").alias("n")).where("n > 1"), "split-names")
        met = front.join(names, ["part", "l", "r"])
        whole = F.col("l") + F.col("r") == REST
        spans = spans.union(met.where(whole).select("digest", (F.col("at") - F.col("l")).alias("begin"), (F.col("at") - F.col("l") + LENGTH).alias("end")))
        few = met.where(~whole & (F.col("n") <= group)).select(F.xxhash64("part", "l", "r").alias("name"), "digest", (F.col("l") * LENGTH + F.col("r")).alias("branch"), "lo", "context")
        small = few if small is None else small.union(few)
        many = ~whole & (F.col("n") > group)
        if names.where(many).isEmpty():
            return small, spans
        middle = F.floor((F.col("l") + REST - F.col("r")) / 2).cast("int")
        halves = F.array(F.struct(F.col("l"), (REST - middle).alias("r")), F.struct((middle + 1).alias("l"), F.col("r")))
        front = met.where(many).select("digest", "at", "lo", "context", F.explode(halves).alias("half")).select("digest", "at", "lo", "context", "half.l", "half.r")
        front = front.where(f"at - lo >= l AND at - (lo + length(context) - {LENGTH}) <= {REST} - r")


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for begin, end in sorted(spans):
        if out and begin <= out[-1][1]:
            if end > out[-1][1]:
                out[-1] = (out[-1][0], end)
        else:
            out.append((begin, end))
    return out


def repeated_spans(docs: DataFrame, group: int = GROUP) -> DataFrame:
    """(digest, text, spans): the texts that hold repeated strings of another place, each once, and their maximal repeated runs.

    Texts that are copies of one another and share nothing else are not here: `copies` has them.
    """
    found = stage(all_samples(docs), "samples")
    # Staged, so that a name that comes often is split over tasks where samples meet their counts.
    names = stage(found.groupBy("name").agg(F.count("*").alias("n")).where("n > 1"), "names")
    places = (
        found.join(names, "name").groupBy("text_key")
        .agg(F.collect_set(F.when(F.col("n") <= group, F.col("at"))).alias("places"), F.collect_set(F.when(F.col("n") > group, F.col("at"))).alias("crowded"))
    )  # fmt: skip  at most a text's own samples come together
    texts = docs.select(F.xxhash64("text").alias("text_key"), F.unhex(F.md5(F.encode(F.coalesce("text", F.lit("")), "utf-8"))).alias("digest"), "text")
    candidates = stage(texts.join(places, "text_key").select("digest", "text", "places", "crowded"), "candidates")
    met = contexts(candidates.select("digest", "text", "places")).select("name", "digest", F.lit(0).alias("branch"), "lo", "context")
    if names.where(F.col("n") > group).isEmpty():
        spans = gathered_spans(met)
    else:
        small, spans = split_names(contexts(candidates.where(F.size("crowded") > 0).select("digest", "text", F.col("crowded").alias("places"))), group)
        spans = spans.union(gathered_spans(met.union(small)))
    own = spans.groupBy("digest").agg(F.collect_list(F.struct("begin", "end")).alias("spans"))
    return candidates.select("digest", "text").join(own, "digest")


def judged(docs: DataFrame, group: int = GROUP) -> DataFrame:
    """(digest, n_removed, n_spans, kept_sha256, kept_text) for texts that lose bytes to another text or place, once each.

    kept_text is what is left in whole characters: one that is removed in part stays.
    """

    def run(batches):
        for batch in batches:
            met, rows = set(), [[], [], [], [], []]
            for digest, text, spans in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if digest in met:
                    continue
                met.add(digest)
                data = (text or "").encode("utf-8", "surrogatepass")
                runs = merged([(s["begin"], s["end"]) for s in spans])
                cuts = [0, *(x for r in runs for x in r), len(data)]
                kept = b"".join(data[a:z] for a, z in zip(cuts[::2], cuts[1::2], strict=True))
                whole = list(cuts)
                for k in range(1, len(whole) - 1):
                    step = 1 if k % 2 else -1  # a removed run begins at the next character, ends at the last one begun
                    while 0 < whole[k] < len(data) and data[whole[k]] & 0xC0 == 0x80:
                        whole[k] += step
                left = b"".join(data[a:z] for a, z in zip(whole[::2], whole[1::2], strict=True))
                for column, value in zip(rows, (digest, len(data) - len(kept), len(runs), hashlib.sha256(kept).hexdigest(), left.decode("utf-8", "replace")), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(rows, (pa.binary(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)],
                names=["digest", "n_removed", "n_spans", "kept_sha256", "kept_text"],
            )

    rows = repeated_spans(docs, group).mapInArrow(run, "digest binary, n_removed long, n_spans long, kept_sha256 string, kept_text string")
    return rows.dropDuplicates(["digest"])


def suffix_dedup(docs: DataFrame, group: int = GROUP) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row of docs."""
    narrow = docs.select("doc_id", "text")
    data = F.encode(F.coalesce("text", F.lit("")), "utf-8")
    copied = narrow.select(F.unhex(F.md5(data)).alias("digest")).groupBy("digest").agg(F.count("*").alias("copies")).where("copies > 1")
    own = judged(narrow, group).drop("kept_text")
    rows = narrow.select("doc_id", F.unhex(F.md5(data)).alias("digest"), F.length(data).cast("long").alias("n_bytes"), F.sha2(data, 256).alias("sha"))
    whole = F.col("copies").isNotNull() & (F.col("n_bytes") >= LENGTH)
    return rows.join(copied, "digest", "left").join(own, "digest", "left").select(
        "doc_id", "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(whole, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(whole, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
    )


def remove_repeats(docs: DataFrame, group: int = GROUP) -> DataFrame:
    """docs without their repeated strings, in their own columns, whatever their names; n_chars follows the text."""
    narrow = docs.select("doc_id", "text")
    data = F.encode(F.coalesce("text", F.lit("")), "utf-8")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.unhex(F.md5(data)).alias("digest"), F.length(data).alias("n_bytes"))
    copied = narrow.select(F.unhex(F.md5(data)).alias("digest")).groupBy("digest").agg(F.count("*").alias("copies")).where("copies > 1")
    own = judged(narrow, group).select("digest", "kept_text")
    # A text with copies loses all, from LENGTH bytes on.
    whole = F.col("copies").isNotNull() & (F.col("n_bytes") >= LENGTH)
    text = F.when(whole, F.lit("")).otherwise(F.coalesce("kept_text", F.col("row").getField("text")))
    found = rows.join(copied, "digest", "left").join(own, "digest", "left").select("row", text.alias("text"))
    changed = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    return found.select(*[changed.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents", "doc_id", "text"))
