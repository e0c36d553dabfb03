"""Greedy clusters of located events at any size: the one answer of the sequential pass, found in rounds.

The pass takes events by id; each free one becomes a seed and takes all free ones within the radius. So a
seed is an event without a lesser seed near it, and any other belongs to the least seed near it. Events at
one place share their fate and are met once. The globe is cut into cells so small that all in one are near each
other: only the least open event of a cell, its head, can be the next seed, and it is one if no cell within
reach has a lesser head. A round makes all such heads seeds and closes what they take. Seeds lie apart, so
few are within reach of any cell and no pair of mere events is ever formed.

Rounds follow chains of dependent events; once at most `finish` places are open (a bound, not a share) one task
ends the pass over those. Tests run it with 0 and get the same rows. Groups (sources) are independent: those of at most ALONE places
need no rounds, as each is passed over in the task that holds it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmesh.catalog import query
from quillmesh.operators import views
from quillmesh.operators.joins import haversine
from quillmesh.runtime import stage, unstage

EARTH_KM = 6371.0
FINISH = 20_000
#: Places of a group up to which its pass is one task's; larger groups go by rounds.
ALONE = 5_000
#: Places of small groups for which there is a task.
TASK_PLACES = 20_000


def _bands(km: float) -> float:
    """Height of a cell in degrees: cells' diagonals are just shorter than the radius."""
    return math.degrees(km * 0.999 / math.sqrt(2) / EARTH_KM)


def _columns(band: Column, height: float) -> Column:
    """Number of cells around the globe in a band of latitude, each as wide as high where it is widest."""
    low = F.greatest(F.lit(0.0), F.least(F.abs(band * height), F.abs((band + 1) * height)))
    crossing = (band * height <= 0) & ((band + 1) * height >= 0)
    widest = F.cos(F.radians(F.when(crossing, 0.0).otherwise(F.least(low, F.lit(90.0)))))
    return F.greatest(F.lit(1), F.ceil(F.lit(360.0) * widest / height)).cast("long")


def with_cells(places: DataFrame, km: float) -> DataFrame:
    """Adds cy, cx."""
    height = _bands(km)
    banded = places.withColumn("cy", F.floor(F.col("lat") / height))
    n = _columns(F.col("cy"), height)
    return banded.withColumn("cx", F.pmod(F.floor((F.col("lon") + 180) * n / 360), n))


def reached(places: DataFrame, km: float) -> DataFrame:
    """places once for each cell (ry, rx) that their circle may touch."""
    height = _bands(km)
    r = math.degrees(km / EARTH_KM) * 1.0001
    bands = F.sequence(F.floor((F.col("lat") - r) / height), F.floor((F.col("lat") + r) / height))
    lat = F.radians("lat")
    polar = F.abs(F.col("lat")) + r >= 89.999
    wide = F.when(polar, 180.0).otherwise(F.degrees(F.asin(F.least(F.lit(1.0), math.sin(math.radians(r)) / F.cos(lat)))))
    rows = places.withColumn("_wide", wide).withColumn("ry", F.explode(bands))
    n = _columns(F.col("ry"), height)
    first, last = (F.floor((F.col("lon") + 180 + sign * F.col("_wide")) * n / 360) for sign in (-1, 1))
    around = F.array_distinct(F.transform(F.sequence(first, F.least(last, first + n)), lambda c: F.pmod(c, n)))
    return rows.withColumn("rx", F.explode(around)).drop("_wide")


def _owners(rows: pd.DataFrame, km: float) -> np.ndarray:
    """For places of one group in the order of (id, lat, lon): the number of the seed that takes each, by one sequential pass."""
    lat, lon = np.radians(rows.lat.to_numpy()), np.radians(rows.lon.to_numpy())
    owner, todo = np.full(len(rows), -1), np.arange(len(rows))
    while len(todo):
        k = todo[0]
        a = np.sin((lat[todo] - lat[k]) / 2) ** 2 + np.cos(lat[todo]) * np.cos(lat[k]) * np.sin((lon[todo] - lon[k]) / 2) ** 2
        near = 2 * EARTH_KM * np.arcsin(np.sqrt(np.minimum(1, a))) < km
        near[0] = True
        owner[todo[near]] = k
        todo = todo[~near]
    return owner


def _sequential(rows: pd.DataFrame, km: float) -> pd.DataFrame:
    """Seeds of a bounded number of places, one after the other."""
    rows = rows.sort_values(["id", "lat", "lon"], kind="stable")
    groups = pd.factorize(rows["by"], use_na_sentinel=False)[0]
    seeds = [at[np.unique(_owners(rows.iloc[at], km))] for at in (np.flatnonzero(groups == g) for g in range(groups.max(initial=-1) + 1))]
    return rows.iloc[np.sort(np.concatenate([np.zeros(0, np.int64), *seeds]))][["by", "id", "lat", "lon"]]


def _alone(places: DataFrame, km: float, tasks: int) -> DataFrame:
    """(by, lat, lon, seed) of places (by, id, lat, lon) whose groups are small: each group's pass in the task that holds it, group by group of a sorted stream."""
    own = ["by", "id", "lat", "lon"]
    kinds = {c: places.schema[c].dataType.simpleString() for c in own}
    sorted_ = places.select(*own).repartition(tasks, "by").sortWithinPartitions(*own)

    def owned(rows: pd.DataFrame) -> pd.DataFrame:
        at = _owners(rows, km)
        return pd.DataFrame({"by": rows["by"].to_numpy(), "lat": rows["lat"].to_numpy(), "lon": rows["lon"].to_numpy(), "seed": rows["id"].to_numpy()[at]})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        carry = None
        for rows in frames:
            if carry is not None:
                rows = pd.concat([carry, rows], ignore_index=True)
            if not len(rows):
                continue
            before = rows["by"].shift()
            new = ((rows["by"] != before) & ~(rows["by"].isna() & before.isna())).to_numpy()
            cuts = [0, *(k for k in new.nonzero()[0].tolist() if k)]
            done = [owned(rows.iloc[i:j]) for i, j in zip(cuts, cuts[1:], strict=False)]
            if done:
                yield pd.concat(done, ignore_index=True)
            carry = rows.iloc[cuts[-1] :]
        if carry is not None:
            yield owned(carry)

    return sorted_.mapInPandas(run, f"by {kinds['by']}, lat double, lon double, seed {kinds['id']}")


def _near(seeds: DataFrame, places: DataFrame, km: float) -> DataFrame:
    """places (by, lat, lon, cy, cx and more) with each seed within the radius, as `seed` (id, lat, lon)."""
    told = reached(seeds, km).select(F.col("by").alias("_by"), "ry", "rx", F.struct("id", "lat", "lon").alias("seed"))
    met = places.join(told, F.col("by").eqNullSafe(F.col("_by")) & (F.col("cy") == F.col("ry")) & (F.col("cx") == F.col("rx")))
    return met.where(haversine(F.col("lat"), F.col("lon"), F.col("seed.lat"), F.col("seed.lon")) < km).drop("_by", "ry", "rx")


def greedy_seeds(places: DataFrame, km: float, finish: int = FINISH) -> DataFrame:
    """Seeds (by, id, lat, lon) among places (by, id, lat, lon, cy, cx), a place's id being its least. places: of a table."""
    own = ["by", "id", "lat", "lon"]
    open_, found, staged = places, None, []
    while left := open_.count():
        if left <= finish:
            kinds = ", ".join(f"{c} {places.schema[c].dataType.simpleString()}" for c in own)
            new = open_.select(*own).repartition(1).mapInPandas(lambda batches: iter([_sequential(pd.concat(batches), km)]), kinds)
        else:
            heads = stage(open_.groupBy("by", "cy", "cx").agg(F.min(F.struct("id", "lat", "lon")).alias("head")), "heads")
            seen = reached(heads.select("by", "head", "head.lat", "head.lon"), km).select("by", "head", "ry", "rx")
            other = heads.select(F.col("by").alias("_by"), F.col("cy").alias("ry"), F.col("cx").alias("rx"), F.col("head").alias("other"))
            lesser = (F.col("by").eqNullSafe(F.col("_by"))) & (seen["ry"] == other["ry"]) & (seen["rx"] == other["rx"]) & (F.col("other") < F.col("head"))
            new = seen.join(other, lesser, "left").groupBy("by", "head").agg(F.max("other").alias("other")).where("other IS NULL").select("by", "head.*").select(*own)
        new = stage(new, "seeds")
        found = new if found is None else found.union(new)
        if left <= finish:
            break
        taken = _near(new, open_, km).select(F.col("by").alias("_by"), F.col("lat").alias("_lat"), F.col("lon").alias("_lon")).distinct()
        same = F.col("by").eqNullSafe(F.col("_by")) & (F.col("lat") == F.col("_lat")) & (F.col("lon") == F.col("_lon"))
        open_ = stage(open_.join(taken, same, "left_anti"), "open-places")
        unstage(heads)
        if staged:
            unstage(staged.pop())
        staged.append(open_)
    return found if found is not None else places.select(*own)


def greedy_seed_clusters(events: DataFrame, by: str | None, km: float, finish: int = FINISH, alone: int = ALONE) -> DataFrame:
    """GR10 in the order of the ids: (by, id, seed) for events (id, lat, lon), alone in their groups where `by` names a column.

    Events of one id and place are one cluster's; of one id at several places the least place comes first. An event
    without id, latitude or longitude has no row.
    """
    group = F.col(by) if by else F.lit(None).cast("int")
    rows = events.select(group.alias("by"), "id", F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"))
    rows = rows.where(F.col("id").isNotNull() & F.col("lat").between(-90, 90) & F.col("lon").between(-180, 180))
    places = stage(with_cells(rows.groupBy("by", "lat", "lon").agg(F.min("id").alias("id")), km), "cluster-places")
    large, member = places, None
    if by and alone:
        large_groups = stage(places.groupBy(F.col("by").alias("_by")).agg(F.count("*").alias("n")).where(F.col("n") > alone).select("_by"), "large-groups")
        large, small = (places.join(large_groups, F.col("by").eqNullSafe(F.col("_by")), how) for how in ("left_semi", "left_anti"))
        member = _alone(small, km, -(-places.count() // TASK_PLACES) or 1)
        large = None if large_groups.isEmpty() else stage(large, "large-places")
    if large is not None:
        rounds = _near(greedy_seeds(large, km, finish), large, km).groupBy("by", "lat", "lon").agg(F.min("seed").alias("seed")).select("by", "lat", "lon", F.col("seed.id").alias("seed"))
        member = rounds if member is None else member.unionByName(rounds)
    told = member.select(F.col("by").alias("_by"), F.col("lat").alias("_lat"), F.col("lon").alias("_lon"), "seed")
    same = F.col("by").eqNullSafe(F.col("_by")) & (F.col("lat") == F.col("_lat")) & (F.col("lon") == F.col("_lon"))
    return rows.join(told, same).select(*(["by"] if by else []), "id", "seed")


def fused_clusters(events: DataFrame, km: float, finish: int = FINISH) -> DataFrame:
    """GR10: a row a cluster of events (id, lat, lon, source, type, confidence): seed, size, sources, types, confidence, severity, kind.

    Confidence is the greatest of the members and 0.12 for each source and up to 0.08 by the mean latitude, 0.98 at most; a lone
    event keeps its own and its type. Means are taken over millionths of a degree, so they don't depend on the order.
    """
    members = greedy_seed_clusters(events, None, km, finish).distinct()
    facts = events.select("id", "source", "type", "confidence", F.round(F.col("lat") * 1e6).cast("long").alias("_lat"), F.round(F.col("lon") * 1e6).cast("long").alias("_lon"))
    sums = (
        facts.join(members, "id").groupBy("seed", "source", "type")  # counts of a source and type first: hubs are met by sums
        .agg(F.count("*").alias("n"), F.max("confidence").alias("most"), F.sum("_lat").alias("_lat"), F.sum("_lon").alias("_lon"))
        .groupBy("seed").agg(F.sum("n").alias("size"), F.count_distinct("source").alias("sources"), F.count_distinct("type").alias("types"), F.min("type").alias("type"), F.max("most").alias("most"), F.sum("_lat").alias("_lat"), F.sum("_lon").alias("_lon"))
    )
    middle = F.expr("pmod(floor(floor(_lat / size) / 1000), 9)") / 100
    fused = F.least(F.lit(0.98), F.coalesce("most", F.lit(0.4)) + 0.12 * F.col("sources") + middle)
    lone = F.col("size") == 1
    confidence = F.round(F.when(lone, F.coalesce("most", F.lit(0.4))).otherwise(fused), 2)
    return sums.select(
        "seed", "size", "sources", "types", F.floor(F.col("_lat") / F.col("size")).alias("lat_millionths"), F.floor(F.col("_lon") / F.col("size")).alias("lon_millionths"), confidence.alias("confidence"),
        F.when(lone, F.lit(None)).when(fused > 0.8, "CRITICAL").otherwise("HIGH").alias("severity"), F.when(lone, F.col("type")).otherwise("correlated_threat").alias("kind"),
    )


@query("gr10c_greedy_clusters_by_source")
def gr10c(spark, d):
    return greedy_seed_clusters(views.geo_events(spark, d), "source", 10.0).select("id", "seed")


@query("gr10d_fused_clusters")
def gr10d(spark, d):
    """All events, with the confidence of each cluster."""
    return fused_clusters(views.geo_events(spark, d).withColumn("confidence", F.col("confidence") / 250), 10.0)
