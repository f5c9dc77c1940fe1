"""Quantities that carry their unit or the reason why they are withheld, and grades of evidence."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Weakest first.
GRADES = ("unknown", "inferred", "stated", "corroborated")


def quantity(value: Column, unit: Column, unit_reason: Column, basis: str, method: str, withheld: Column | None = None) -> Column:
    """struct(value, unit, unit_reason, withheld_reason, basis, method); a missing value is withheld, never 0."""
    reason = F.coalesce(withheld, F.when(value.isNull(), "not measured")) if withheld is not None else F.when(value.isNull(), "not measured")
    return F.struct(
        F.when(reason.isNull(), value).alias("value"),
        F.when(reason.isNull(), unit).alias("unit"),
        F.when(unit.isNull(), F.coalesce(unit_reason, F.lit("no unit declared"))).alias("unit_reason"),
        reason.alias("withheld_reason"),
        F.lit(basis).alias("basis"),
        F.lit(method).alias("method"),
    )


def total(value: Column, unit: Column) -> Column:
    """Aggregate: a sum only where every part has a value; a unit only where all parts share one."""
    n, have, units = F.count(F.lit(1)), F.count(value), F.count_distinct(unit)
    reason = F.when(n == 0, "nothing to add").when(have < n, F.concat((n - have).cast("string"), F.lit(" of "), n.cast("string"), F.lit(" not measured")))
    return F.struct(
        F.when(reason.isNull(), F.sum(value)).alias("value"),
        F.when(units == 1, F.min(unit)).alias("unit"),
        F.when(units > 1, "mixed units").when(units == 0, "no unit declared").alias("unit_reason"),
        reason.alias("withheld_reason"),
    )


def grade(corpora: Column, places: Column) -> Column:
    """By how many corpora and places state it: two corpora corroborate, one states, none with a place infers."""
    return F.when(corpora >= 2, "corroborated").when(corpora == 1, "stated").when(places >= 1, "inferred").otherwise("unknown")


def rank(grade_: Column) -> Column:
    return F.array_position(F.array(*[F.lit(g) for g in GRADES]), grade_).cast("int") - 1


def weakest(grade_: Column) -> Column:
    """Aggregate: the least grade of the parts."""
    return F.min_by(grade_, rank(grade_))


def unit_of(space: Column, declared: Column) -> Column:
    """struct(unit, reason): a length unit holds in model space alone, and only where the file declares one."""
    reason = F.when(space != "model", "units hold in model space only").when(declared.isNull() | (declared == "unitless"), "the file declares none")
    return F.struct(F.when(reason.isNull(), declared).alias("unit"), reason.alias("reason"))


def area_unit(unit: Column) -> Column:
    return F.concat(unit, F.lit("2"))
