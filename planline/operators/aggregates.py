"""Sums with their denominators, distributions, facets and classifications."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from planline.operators import windows


def measure(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """matched, measured, zeros, sum of the measured; a total only where all matched were measured.

    A null value is not measurable and never counts as 0.
    """
    v = F.col(value)
    out = df.groupBy(*group).agg(
        F.count(F.lit(1)).alias("matched"),
        F.count(v).alias("measured"),
        F.count_if(v == 0).alias("zeros"),
        F.round(F.sum(v), 4).alias("sum_measured_only"),
    )
    return out.withColumn("total_for_all_matched", F.when(F.col("matched") == F.col("measured"), F.col("sum_measured_only")))


def facets(df: DataFrame, sets: list[list[str]], columns: list[str]) -> DataFrame:
    """Counts over several groupings in one pass; columns outside a grouping are null."""
    out = df.groupingSets([[F.col(c) for c in s] for s in sets], *columns)
    return out.agg(F.count(F.lit(1)).alias("n"), F.grouping_id().cast("long").alias("level"))


def distinct_values(df: DataFrame, field: str) -> DataFrame:
    """Each value's count; null and '' are no values."""
    return df.where(F.col(field).isNotNull() & (F.col(field).cast("string") != "")).groupBy(field).agg(F.count(F.lit(1)).alias("n"))


def mode_binned(df: DataFrame, group: list[str], value: str, decimals: int = 2) -> DataFrame:
    """Most frequent rounded value, the least on a tie, its count and how many tie."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*group, F.round(value, decimals).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*group)
    ranked = counts.withColumns({"rank": F.row_number().over(w.orderBy(F.desc("n"), "bin")), "top": F.max("n").over(w)})
    ties = ranked.withColumn("ties", F.count_if(F.col("n") == F.col("top")).over(w))
    return ties.where("rank = 1").select(*group, F.col("bin").alias("mode"), F.col("n").alias("mode_count"), "ties")


def describe(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """n, mean, sd of the population, least, quartiles (interpolated), greatest and sum, rounded to 4."""
    v = F.col(value)
    out = df.groupBy(*group).agg(
        F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("sd"), F.min(v).alias("least"), F.max(v).alias("greatest"), F.sum(v).alias("total")
    )
    q = windows.quantiles(df, group, value, {"p25": 0.25, "median": 0.5, "p75": 0.75}).drop("n")
    keys = [F.col(c).alias(f"q_{c}") for c in group]
    q = q.select(*keys, "p25", "median", "p75")
    # a group without values has no quartiles
    both = out.join(q, [out[c].eqNullSafe(q[f"q_{c}"]) for c in group], "left") if group else out.join(q, F.lit(True), "left")
    r = lambda c: F.round(c, 4).alias(c)
    return both.select(*group, "n", r("mean"), r("sd"), "least", r("p25"), r("median"), r("p75"), "greatest", r("total"))


def classify(names: DataFrame, name: str, rules: list[tuple[str, str]], overrides: dict[str, str], default: str | None = None) -> DataFrame:
    """Add ``land_use`` and ``basis``: an override by name, else the first rule whose word the name holds, else the default."""
    c = F.col(name)
    use, basis = F.lit(default), F.lit("default" if default else None)
    for word, value in reversed(rules):
        hit = F.contains(F.lower(c), F.lit(word.lower()))
        use, basis = F.when(hit, value).otherwise(use), F.when(hit, "pattern").otherwise(basis)
    for exact, value in overrides.items():
        use, basis = F.when(c == exact, value).otherwise(use), F.when(c == exact, "override").otherwise(basis)
    return names.withColumns({"land_use": use.cast("string"), "basis": basis.cast("string")})


def family(type_: Column) -> Column:
    """Exclusive families: region, network, points, annotation, other."""
    return (
        F.when(type_.isin("LWPOLYLINE", "POLYLINE", "HATCH"), "region")
        .when(type_.isin("LINE", "ARC"), "network")
        .when(type_.isin("INSERT", "POINT", "CIRCLE"), "points")
        .when(type_.isin("TEXT", "MTEXT"), "annotation")
        .otherwise("other")
    )


def role(df: DataFrame, group: list[str], dominance: float = 0.6) -> DataFrame:
    """The leading family of each group if it has ``dominance`` of the rows, else mixed."""
    counts = df.groupBy(*group, family(F.col("type")).alias("family")).agg(F.count(F.lit(1)).alias("n"))
    lead = counts.groupBy(*group).agg(F.max(F.struct("n", "family")).alias("lead"), F.sum("n").alias("entities"))
    return lead.select(
        *group,
        "entities",
        F.when(F.col("lead.n") >= dominance * F.col("entities"), F.col("lead.family")).otherwise("mixed").alias("role"),
    )
