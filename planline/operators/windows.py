"""Ranks, fences, cumulative shares and islands."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def outliers(df: DataFrame, group: list[str], value: str, z: float) -> DataFrame:
    """Rows further than z population deviations from their group's mean; a group without spread has none."""
    stats = df.groupBy(*group).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd"))
    score = (F.col(value) - F.col("mean")) / F.nullif(F.col("sd"), F.lit(0.0))
    return df.join(stats, group).withColumn("z", score).where(F.abs("z") > z)


def top_n(df: DataFrame, group: list[str], order: list, n: int) -> DataFrame:
    """First n rows of each group with their rank; ``order`` must be total."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("rank") <= n)


def cumulative_share(counts: DataFrame, n: str, key: str, share: float) -> DataFrame:
    """The largest groups that together first reach ``share`` of all; equal ones by key.

    Only the different sizes are put in order, not the groups: all groups above the size
    where the share is reached are in, and of those of that size the first few by key.
    """
    sizes = counts.groupBy(F.col(n).alias("size")).agg(F.count(F.lit(1)).alias("groups"))
    part = F.col("size") * F.col("groups")
    w = Window.orderBy(F.desc("size"))
    sizes = sizes.select("size", F.coalesce(F.sum(part).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.sum(part).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("total"))
    edge = sizes.where(F.col("before") < share * F.col("total")).orderBy("size").limit(1).first()
    if edge is None:
        return counts.limit(0)
    some = max(0, math.ceil((share * edge.total - edge.before) / edge["size"]))
    return counts.where(F.col(n) > edge["size"]).unionByName(counts.where(F.col(n) == edge["size"]).orderBy(key).limit(some))


def islands(df: DataFrame, group: list[str], low: str, high: str, order: list[str], gap: float, ranges: int = 1024) -> DataFrame:
    """Number runs of intervals: a new one begins where low exceeds every earlier high by more than gap.

    Rows are put in order within ranges of ``low`` alone, cut at its approximate quantiles,
    so clustered values are spread (rows of one group with one ``low`` share a range); what
    a range needs of the earlier ones (their greatest high, and how many runs they begin) comes from one row
    for each range.
    """
    shares = [k / ranges for k in range(1, ranges)]
    borders = sorted({float(b) for b in df.approxQuantile(low, shares, 0.25 / ranges)}) if shares else []
    cut = Bucketizer(splits=[-math.inf, *borders, math.inf] if borders else [-math.inf, 0.0, math.inf], inputCol="range", outputCol="part", handleInvalid="keep")
    numbered = cut.transform(df.withColumn("range", F.col(low).cast("double")))
    # nulls come first
    df = numbered.withColumn("range", F.when(F.col(low).isNull(), F.lit(-1)).otherwise(F.col("part")).cast("long")).drop("part")
    keys = [*group, "range"]
    earlier = Window.partitionBy(*group).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    reach = df.groupBy(*keys).agg(F.max(high).alias("reach")).withColumn("reach", F.max("reach").over(earlier))
    inside = Window.partitionBy(*keys).orderBy(low, high, *order)
    seen = F.greatest(F.col("reach"), F.max(high).over(inside.rowsBetween(Window.unboundedPreceding, -1)))
    df = _beside(df, reach, keys).withColumn("begins", F.coalesce((F.col(low) - seen > gap).cast("int"), F.lit(1)))
    before = df.groupBy(*keys).agg(F.sum("begins").alias("runs")).withColumn("runs", F.coalesce(F.sum("runs").over(earlier), F.lit(0)))
    df = _beside(df, before, keys).withColumn("island", F.col("runs") + F.sum("begins").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    return df.drop("begins", "range", "reach", "runs")


def _beside(df: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """Join by keys that may be null; ``other`` holds one row for each."""
    if not keys:
        return df.crossJoin(F.broadcast(other))  # one row
    other = other.select(*[F.col(k).alias(f"__{k}") for k in keys], *[c for c in other.columns if c not in keys])
    on = [df[k].eqNullSafe(other[f"__{k}"]) for k in keys]
    return df.join(other, on).drop(*[f"__{k}" for k in keys])


#: A rank's values are looked for this far (in shares of the rows) around the approximate quantile.
MARGIN = 0.005


def values_at(df: DataFrame, group: list[str], value: str, ranks: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """Exact order statistics: for each group its columns, ``n`` and the value at each rank (from 1, by a function of n).

    Approximate quantiles bound where a rank's value lies; only the rows between the
    bounds are put in order, and the smaller ones are counted. Null values do not count.
    """
    rows = df.where(F.col(value).isNotNull()).select(*group, F.col(value).alias("v"))
    counts = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("n"))
    at = counts.select(*group, "n", *[f(F.col("n")).cast("long").alias(f"rank_{k}") for k, f in ranks.items()])
    approximate = rows.groupBy(*group).agg(F.percentile_approx("v", [k * MARGIN for k in range(round(1 / MARGIN) + 1)], 20_000).alias("quantiles"))
    at = _beside(at, approximate, group)

    def bound(k: str, step: int) -> Column:
        place = F.floor((F.col(f"rank_{k}") - 1) / F.nullif(F.col("n"), F.lit(0)) / MARGIN).cast("int") + step
        return F.get("quantiles", F.least(F.greatest(place, F.lit(0)), F.size("quantiles") - 1))

    lows, highs = {k: bound(k, -1).alias(f"low_{k}") for k in ranks}, {k: bound(k, 2).alias(f"high_{k}") for k in ranks}
    at = at.select(*group, "n", *[f"rank_{k}" for k in ranks], *lows.values(), *highs.values())
    beside = _beside(rows, at, group)
    below = beside.groupBy(*group).agg(*[F.count_if(F.col("v") < F.col(f"low_{k}")).alias(f"below_{k}") for k in ranks])
    near = F.array(*[F.when(F.col("v").between(F.col(f"low_{k}"), F.col(f"high_{k}")), F.lit(k)) for k in ranks])
    inside = beside.select(*group, "v", F.explode(F.array_compact(near)).alias("k"))
    inside = inside.groupBy(*group, "k", "v").agg(F.count(F.lit(1)).alias("times"))
    upto = F.sum("times").over(Window.partitionBy(*group, "k").orderBy("v"))
    inside = _beside(inside.withColumn("upto", upto), _beside(at, below, group), group)
    found = [
        F.min(F.when((F.col("k") == k) & (F.col("upto") + F.col(f"below_{k}") >= F.col(f"rank_{k}")), F.col("v"))).alias(k)
        for k in ranks
    ]
    out = inside.groupBy(*group).agg(*found)
    return _beside(counts, out, group)


def nearest_rank(df: DataFrame, group: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Quantiles by nearest rank: the value at position ceil(share * n)."""
    rank = lambda s: lambda n: F.greatest(F.lit(1), F.ceil(F.lit(s) * n))
    return values_at(df, group, value, {k: rank(s) for k, s in shares.items()}).drop("n")


def quantiles(df: DataFrame, group: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Quantiles interpolated between the two nearest values: group, n and one column for each share."""
    place = lambda s, n: F.lit(s) * (n - 1)
    ranks = {}
    for k, s in shares.items():
        ranks[f"{k}_a"] = lambda n, s=s: F.floor(place(s, n)) + 1
        ranks[f"{k}_b"] = lambda n, s=s: F.ceil(place(s, n)) + 1
    v = values_at(df, group, value, ranks)
    way = lambda s: place(s, F.col("n")) - F.floor(place(s, F.col("n")))
    mix = [(F.col(f"{k}_a") + (F.col(f"{k}_b") - F.col(f"{k}_a")) * way(s)).alias(k) for k, s in shares.items()]
    return v.select(*group, "n", *mix)
