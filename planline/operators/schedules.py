"""Schedules from drawn tables: parts of one table joined up, and read as keys and values."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from planline.operators import text as X


def merged_grids(cells: DataFrame) -> DataFrame:
    """drawing_id, place, column, text: the rows of a drawing's tables of its commonest width, one after another.

    ``cells``: drawing_id, table, row, column, text, numbered from 0. A schedule too long for
    a sheet is drawn as several tables of one width; a table of another width is another
    thing and stays out. The commonest width is that with most rows (ties: the width of the
    earliest table). Places count rows from 0 in order of table and row.
    """
    grid = cells.groupBy("drawing_id", "table").agg((F.max("column") + 1).alias("width"), (F.max("row") + 1).alias("rows"))
    widths = grid.groupBy("drawing_id", "width").agg(F.sum("rows").alias("rows"), F.min("table").alias("first"))
    common = widths.groupBy("drawing_id").agg(F.max_by("width", F.struct("rows", -F.col("first"))).alias("width"))
    # a row for each table, not for each of its cells
    before = Window.partitionBy("drawing_id").orderBy("table").rowsBetween(Window.unboundedPreceding, -1)
    kept = grid.join(common, ["drawing_id", "width"]).select("drawing_id", "table", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("start"))
    return cells.join(kept, ["drawing_id", "table"]).select("drawing_id", (F.col("start") + F.col("row")).alias("place"), "column", "text")


def schedule(grids: DataFrame) -> DataFrame:
    """drawing_id, item, value, place, times: what a merged grid says of each item in its first column.

    The value is the number in the column with most numbers behind the first (ties: the
    leftmost); rows without a number there, such as headings, say nothing. ``times`` counts
    the rows of an item: more than one is a conflict to be shown, and the first row is given.
    """
    number = X.as_number(F.col("text"))
    counts = grids.where("column > 0").groupBy("drawing_id", "column").agg(F.count(number).alias("numbers")).where("numbers > 0")
    of_value = counts.groupBy("drawing_id").agg(F.max_by("column", F.struct("numbers", -F.col("column"))).alias("column"))
    values = grids.join(of_value, ["drawing_id", "column"]).select("drawing_id", "place", number.alias("value")).where("value is not null")
    items = grids.where("column = 0 and trim(text) <> ''").select("drawing_id", "place", F.trim("text").alias("item"))
    rows = items.join(values, ["drawing_id", "place"])
    return rows.groupBy("drawing_id", "item").agg(F.min_by("value", "place").alias("value"), F.min("place").alias("place"), F.count(F.lit(1)).alias("times"))
