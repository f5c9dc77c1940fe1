"""Numbers, classes and dictionaries of drawing text, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: First number of a text: sign, digits with optional thousands commas, decimals.
NUMBER = r"([+-]?[0-9]{1,3}(?:,[0-9]{3})+(?:\.[0-9]+)?|[+-]?[0-9]+(?:\.[0-9]+)?)"


def printed_value(text: Column) -> Column:
    """(value, decimals): the first number printed and its decimals; nulls where there is none."""
    found = F.regexp_extract(text, NUMBER, 1)
    plain = F.replace(found, F.lit(","), F.lit(""))
    value = F.when(found != "", plain.try_cast("double"))
    decimals = F.when(found != "", F.length(F.regexp_extract(plain, r"\.([0-9]+)$", 1)).cast("long"))
    return F.struct(value.alias("value"), decimals.alias("decimals"))


def tolerance(decimals: Column, measured: Column, stated: Column | None = None) -> Column:
    """Half a unit in the last printed place, a stated tolerance or a millionth of the measure, whichever is most."""
    parts = [F.lit(0.5) * F.pow(F.lit(10.0), -decimals.cast("double")), F.lit(1e-6) * F.abs(measured)]
    return F.greatest(*parts, *([] if stated is None else [F.coalesce(stated, F.lit(0.0))]))


def as_number(text: Column) -> Column:
    """A whole text as a number, thousands separators and spaces aside, else null."""
    return F.regexp_replace(F.trim(text), r"(?<=[0-9])[,\s](?=[0-9]{3}(?:[^0-9]|$))", "").try_cast("double")


def text_class(text: Column) -> Column:
    """integer, dimension (a number with decimals or a unit), arabic, empty or other."""
    t = F.trim(text)
    return (
        F.when(t == "", "empty")
        .when(t.rlike(r"^[0-9]+$"), "integer")
        .when(t.rlike(r"^[+-]?[0-9]+(?:\.[0-9]+)?\s*(?:m|mm|cm|ft|in|m2)?$"), "dimension")
        .when(t.rlike(r"[؀-ۿ]"), "arabic")
        .otherwise("other")
    )


def digit_count(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"[^0-9]", "")).cast("long")


def clean_cell(text: Column) -> Column:
    r"""A table cell without its formatting codes: {\f...;text}, \P and \~."""
    t = F.regexp_replace(text, r"\\[fFHCWQATpP][^;{}\\]*;", "")
    t = F.regexp_replace(F.regexp_replace(t, r"\\P", " "), r"\\~", " ")
    return F.trim(F.regexp_replace(t, r"[{}]", ""))


def column_kinds(cells: DataFrame) -> DataFrame:
    """(name, numbers, n, kind) of columns of texts (name, value): text, identifier or measure.

    An identifier's values are whole numbers that never repeat and fill nine tenths of
    their range; any other column with a number is a measure. Empty cells do not count.
    """
    filled = cells.where("value is not null and trim(value) <> ''").withColumn("x", as_number(F.col("value")))
    values = filled.groupBy("name", "x").agg(F.count(F.lit(1)).alias("times"))
    known = F.col("x").isNotNull()
    g = values.groupBy("name").agg(
        F.coalesce(F.sum(F.when(known, F.col("times"))), F.lit(0)).alias("numbers"), F.sum("times").alias("n"), F.count("x").alias("different"),
        F.coalesce(F.bool_and(F.when(known, F.col("x") == F.floor("x"))), F.lit(True)).alias("whole"), (F.max("x") - F.min("x") + 1).alias("span"),
    )
    dense = F.col("numbers") / F.col("span") >= 0.9
    identifier = (F.col("numbers") >= 2) & F.col("whole") & (F.col("different") == F.col("numbers")) & dense
    kind = F.when(F.col("numbers") == 0, "text").when(identifier, "identifier").otherwise("measure")
    return g.select("name", "numbers", "n", kind.alias("kind"))


def clip(text: Column, most: int) -> Column:
    """A text of at most ``most`` characters, cut at the last white space, with an ellipsis where more follows."""
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.regexp_replace(F.substring(text, 1, most), r"\s+\S*\z", ""), F.lit("…")))


def says(text: Column, word: str) -> Column:
    """Whether a text states a word, at word edges; words under four letters never count."""
    if len(word) < 4:
        return F.lit(False)
    return F.lower(text).rlike(rf"(^|[^a-z0-9]){word.lower()}([^a-z0-9]|$)")


def media_type(data: Column) -> Column:
    """Media type from a payload's first bytes."""
    head = F.hex(F.substring(data, 1, 8))
    # File signatures.
    marks = {
        "89504E470D0A1A0A": "image/png", "FFD8FF": "image/jpeg", "25504446": "application/pdf", "504B0304": "application/zip",
        "D0CF11E0A1B11AE1": "application/x-ole", "424D": "image/bmp", "47494638": "image/gif",
    }
    out = F.lit("application/octet-stream")
    for mark, kind in marks.items():
        out = F.when(head.startswith(mark), kind).otherwise(out)
    return out
