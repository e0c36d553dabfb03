"""Best-fit packing by bin completion.

Packing depends on lengths only, and there are at most `capacity` of them: the corpus is reduced to
a histogram of lengths (at most `capacity` rows, whatever the corpus holds), bin completion with
branch and bound works on that histogram, and its plan (a pattern for each length used up and each
share that the search took short) is broadcast to place every piece. Texts are tokenized once; no piece moves more than once.

A plan row says: of the pieces of this length, those ranked from..to go `each` to a bin, into bins
counted from `bin`, at `offset`. Ranks within a length are counted over hash buckets, so that a
length that a third of all pieces share is spread like any other.

Defined cases: a null text is an empty one (its end token alone); a null doc_id stays null; repeated
rows are documents of their own; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmesh.llm.word_bpe import word_ids
from quillmesh.runtime import stage, table

CAPACITY = 2048
END_ID = 0
#: Rows of one length that one rank window holds, about.
BUCKET_ROWS = 50_000
#: Steps of the search once its first pass has met the end: a branch of a filling, four sizes looked at.
SEARCH_STEPS = 1_000_000


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


# ---------------------------------------------------------------- the histogram kernel


def complete(sizes: list[int], counts: dict[int, int], room: int, nodes: int = 4000, steps: list[int] | None = None) -> list[tuple[int, int]]:
    """The filling of `room` with least waste from `sizes` (descending, available): [(size, times)]; after `nodes`, the best so far.

    It only says which filling the search tries first: `fillings` gives all the others.

    Depth first, larger sizes first, so that a filling is met before those it dominates (any part
    of it replaced by smaller pieces). A branch is cut when even a full take of what is left of it
    can't beat the incumbent's waste; the incumbent starts as the best-fit filling, the first branch.
    """
    down = [-s for s in sizes]
    left = [0] * (len(sizes) + 1)  # what all sizes from here on amount to
    for k in range(len(sizes) - 1, -1, -1):
        left[k] = left[k + 1] + sizes[k] * min(counts[sizes[k]], room // sizes[k] if sizes[k] <= room else 0)
    best: list = [room, []]
    seen = [0]

    def go(k: int, rest: int, taken: list) -> bool:
        seen[0] += 1
        if rest < best[0]:
            best[0], best[1] = rest, list(taken)
            if rest == 0:
                return True
        k = max(k, bisect_left(down, -rest))
        while k < len(sizes) and rest - left[k] < best[0]:
            if seen[0] > nodes:
                return True
            size = sizes[k]
            for times in range(min(counts[size], rest // size), 0, -1):
                taken.append((size, times))
                if go(k + 1, rest - size * times, taken):
                    return True
                taken.pop()
            k += 1
        return False

    go(0, room, [])
    if steps:
        steps[0] -= seen[0]
    return best[1]


def best_fit(histogram: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Best-fit decreasing on the histogram: [(sizes of a bin, bins alike)]."""
    open_bins: dict[int, list[list]] = {}  # room left -> [[sizes, bins alike], ...]
    for size in sorted(histogram, reverse=True):
        n = histogram[size]
        while n:
            room = next((r for r in range(size, capacity) if open_bins.get(r)), None)
            if room is None:
                each = capacity // size
                bins, rest = divmod(n, each)
                for number, alike in ((each, bins), (rest, 1)):
                    if number and alike:
                        open_bins.setdefault(capacity - number * size, []).append([{size: number}, alike])
                break
            sizes, alike = open_bins[room].pop()
            each = min(room // size, n)
            bins = min(alike, n // each)
            open_bins.setdefault(room - each * size, []).append([{**sizes, size: each}, bins])
            if alike > bins:
                open_bins[room].append([sizes, alike - bins])
            n -= each * bins
    return [(sizes, alike) for group in open_bins.values() for sizes, alike in group]


def fillings(sizes: list[int], counts: dict[int, int], room: int, waste: int, steps: list[int]) -> Iterator[list[tuple[int, int]]]:
    """All undominated fillings of `room` that waste at most `waste`, larger sizes first; ends early when `steps[0]` is used up.

    A filling is dominated if one size left out can take the place of some of its pieces, or of none,
    where these are no larger and it fits: whatever the rest of a packing is, it can be had with that one.
    """
    down = [-s for s in sizes]
    left = [0] * (len(sizes) + 1)
    for k in range(len(sizes) - 1, -1, -1):
        left[k] = left[k + 1] + sizes[k] * min(counts[sizes[k]], room // sizes[k])
    whole = sum(1 << s for s in sizes)

    def undominated(rest: int, taken: list[tuple[int, int]]) -> bool:
        one, more, outside = 0, 0, whole  # bit t: a piece of t, two or more pieces of t in all, a size left out
        for size, times in taken:
            for _ in range(times):
                more |= (more | one) << size
                one |= 1 << size
            if times == counts[size]:
                outside &= ~(1 << size)
        reach = more | 1 | one << 1 if rest else more | 1
        for _ in range(rest - 1 if rest else 0):
            reach |= reach << 1
        return not outside & (reach | (more | 1) << rest)

    def go(k: int, rest: int, taken: list[tuple[int, int]]) -> Iterator[list[tuple[int, int]]]:
        k = max(k, bisect_left(down, -rest))
        while k < len(sizes) and rest - left[k] <= waste and steps[0] > 0:
            size = sizes[k]
            for times in range(min(counts[size], rest // size), 0, -1):
                steps[0] -= 1
                taken.append((size, times))
                yield from go(k + 1, rest - size * times, taken)
                taken.pop()
            k += 1
        if rest <= waste and steps[0] > 0 and undominated(rest, taken):
            yield list(taken)

    yield from go(0, room, [])


def lower_bound(histogram: dict[int, int], capacity: int) -> int:
    """Bins that any packing needs: total size, and for each `least` what the sizes from `least` on need beside those that they can't join."""
    number, total = [0] * (capacity + 2), [0] * (capacity + 2)  # of sizes up to k
    for k in range(1, capacity + 1):
        number[k] = number[k - 1] + histogram.get(k, 0)
        total[k] = total[k - 1] + k * histogram.get(k, 0)
    half = capacity // 2
    best = -(-total[capacity] // capacity)
    for least in range(1, half + 1):
        joined = number[capacity - least] - number[half]
        free = joined * capacity - (total[capacity - least] - total[half])
        best = max(best, number[capacity] - number[half] + max(0, -(-(total[half] - total[least - 1] - free) // capacity)))
    return max(best, number[capacity] - number[half])


def shares(most: int) -> Iterator[int]:
    """1..most, each once: `most`, its halves, then the rest."""
    halves, n = [], most
    while n:
        halves.append(n)
        n //= 2
    yield from halves
    yield from (n for n in range(most - 1, 0, -1) if n not in halves)


def search(histogram: dict[int, int], capacity: int, target: int, steps: int, short: bool = True) -> tuple[list[tuple[dict[int, int], int]] | None, bool]:
    """(a packing of at most `target` bins or None, whether all was tried): the largest piece left, with each undominated filling around it.

    A branch takes a filling for as many bins as pieces last, or (`short`) for fewer too; the one with
    least waste comes first. It is cut when its bins waste more than `target` bins may, or when the same pieces
    were left after as few bins before. `steps` count once the first pass has met its end.
    """
    most_waste = target * capacity - sum(s * n for s, n in histogram.items())
    counts = dict(histogram)
    order = sorted(counts, reverse=True)
    left, budget, met = sum(counts.values()), [max(steps, 1)], False
    path: list[tuple[dict[int, int], int]] = []
    seen: dict[tuple, int] = {}

    def branches(used: int, waste: int, but: dict[int, int] | None) -> Iterator[tuple[dict[int, int], int, int]]:
        sizes = [s for s in order if counts[s]]
        if met:
            budget[0] -= len(sizes) // 4 + 1
        state = tuple(counts[s] for s in order)
        if seen.get(state, used + 1) <= used:
            return
        seen[state] = used
        first = sizes[0]
        room = capacity - first
        own = {**counts, first: counts[first] - 1}
        others = [s for s in sizes if own[s] and s <= room]

        def around() -> Iterator[list[tuple[int, int]]]:
            greedy = complete(others, own, room, steps=budget if met else None)
            yield greedy
            for filling in fillings(others, own, room, min(room, most_waste - waste), budget):
                if filling != greedy:
                    yield filling

        for filling in around():
            pattern = Counter({first: 1})
            for size, times in filling:
                pattern[size] += times
            each = capacity - sum(s * k for s, k in pattern.items())
            if pattern == but:
                continue
            full = min(counts[s] // k for s, k in pattern.items())
            for alike in shares(full) if short else [full]:
                if waste + each * alike <= most_waste:
                    yield dict(pattern), alike, waste + each * alike
                elif met:
                    budget[0] -= 1
                if budget[0] <= 0:
                    return

    def take(pattern: dict[int, int], alike: int) -> int:
        for s, k in pattern.items():
            counts[s] -= k * alike
        return alike * sum(pattern.values())

    stack = [(branches(0, 0, None), 0)]
    while stack and budget[0] > 0:
        level, used = stack[-1]
        step = next(level, None)
        if step is None:
            if not steps:
                return None, False
            met = True
            stack.pop()
            if path:
                pattern, alike = path.pop()
                left -= take(pattern, -alike)
            continue
        pattern, alike, waste = step
        if met:
            budget[0] -= 1
        left -= take(pattern, alike)
        path.append((pattern, alike))
        if not left:
            return path, False
        more = all(counts[s] >= k for s, k in pattern.items())
        stack.append((branches(used + alike, waste, pattern if more else None), used + alike))
    return None, short and budget[0] > 0


def bin_completion(histogram: dict[int, int], capacity: int = CAPACITY, steps: int = SEARCH_STEPS) -> list[tuple[dict[int, int], int]]:
    """Bin completion with branch and bound, from the lower bound up, until it is met, nothing is left to try or `steps` are used up.

    Best-fit decreasing is the incumbent: its bins bound the waste of every search, and its packing
    is returned only if none that completes bins is found with as few. The first packing comes of a
    single pass. Then packings are searched for at the lower bound, which rises by one when all was
    tried in vain, and, where an eighth of the steps didn't settle it, halfway between there and the
    incumbent.
    """
    histogram = {s: n for s, n in histogram.items() if n}
    if not histogram:
        return []
    incumbent = best_fit(histogram, capacity)
    most = sum(n for _, n in incumbent)
    best = search(histogram, capacity, most, 0)[0]
    if best:
        most = sum(n for _, n in best)
    bound = lower_bound(histogram, capacity)
    target = bound
    for _ in range(8):
        while target < most or (target == most and not best):
            found, tried = search(histogram, capacity, target, steps // 16, short=False)
            if not found:  # what a filling takes in full doesn't depend on how often the lengths come; the rest may
                found, tried = search(histogram, capacity, target, steps // 16)
            if found:
                best, most = found, sum(n for _, n in found)
                target = bound
            elif tried and target < most:
                bound = target = target + 1
            else:
                break
        if target >= most - 1 and (best or target >= most):
            break
        target = min(target + max(1, (most - 1 - target) // 2), most)
    return best or incumbent


def plan_rows(patterns: list[tuple[dict[int, int], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, from_rank, to_rank, each, bin, offset) for every size of every pattern."""
    rows, used, first = [], Counter(), 0
    for pattern, alike in patterns:
        offset = 0
        for size in sorted(pattern, reverse=True):
            each = pattern[size]
            rows.append((size, used[size], used[size] + each * alike, each, first, offset))
            used[size] += each * alike
            offset += size * each
        first += alike
    return rows


# ---------------------------------------------------------------- DataFrames


def token_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): the ids of each text and an end id, cut at `capacity`."""
    kind = docs.schema[id_col].dataType.simpleString()
    step = 4 * capacity
    end = END_ID.to_bytes(4, "little")

    def cut(batches):
        encoder = word_ids(path)
        for batch in batches:
            rows: list[list] = [[], [], [], [], []]
            at: list[int] = []
            for k, ids in enumerate(encoder.many([t or "" for t in batch.column(1).to_pylist()])):
                ids += end
                for piece, start in enumerate(range(0, len(ids), step)):
                    part = ids[start : start + step]
                    at.append(k)
                    for column, value in zip(rows[1:], (piece, start // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at, pa.int64())), pa.array(rows[1], pa.int32()), *(pa.array(c, pa.int64()) for c in rows[2:])],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        cut, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long"
    )


def rank_in_length(pieces: DataFrame, n_rows: int) -> DataFrame:
    """Adds `rank`, from 0 within each length, without bringing a length's rows together."""
    buckets = max(1, -(-n_rows // BUCKET_ROWS))
    keyed = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    before = (
        keyed.groupBy("length", "bucket").agg(F.count("*").alias("n"))
        .withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)))
        .select("length", "bucket", F.coalesce("before", F.lit(0)).alias("before"))
    )
    own = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32"))
    return keyed.withColumn("own", own).join(before, ["length", "bucket"]).withColumn("rank", F.col("before") + F.col("own") - 1).drop("bucket", "own", "before")


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to pieces that have a `length` of at most `capacity`. Reads `pieces` twice: stage them."""
    spark = pieces.sparkSession
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # `capacity` rows at most
    plan = spark.createDataFrame(
        plan_rows(bin_completion(histogram, capacity)) or [(0, 0, 0, 1, 0, 0)],
        "length long, from_rank long, to_rank long, each long, bin long, at long",
    )
    ranked = rank_in_length(pieces, sum(histogram.values())).alias("p")
    # A pattern has under sqrt(2 * capacity) sizes. Patterns: one a length used up, and one a share taken short, of which SEARCH_STEPS bounds the number.
    placed = ranked.join(
        F.broadcast(plan.alias("q")),
        (F.col("p.length") == F.col("q.length")) & (F.col("rank") >= F.col("from_rank")) & (F.col("rank") < F.col("to_rank")),
    )
    place = F.col("rank") - F.col("from_rank")
    return placed.select(
        *[F.col(f"p.{c}") for c in pieces.columns],
        F.expr("bin + (rank - from_rank) div each").alias("sequence_id"),
        (F.col("at") + F.pmod(place, F.col("each")) * F.col("p.length")).alias("offset"),
    )


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: all documents in as few sequences as found."""
    return pack(stage(token_pieces(docs, path or vocabulary_path(), capacity), "token-pieces"), capacity)


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents", "doc_id", "text"))
