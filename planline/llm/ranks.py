"""Global ranks without a global sort in one task: ordered files, and where each of them starts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from planline.llm.shared import shared_dir


def ranked(df: DataFrame, keys: list[str], name: str, within: str | None = None, rank: str = "rank") -> DataFrame:
    """The rows of df, written as Parquet in order of ``keys``, with their place in that order from 0.

    Rows are dealt by ranges of the keys (Spark samples them, so df is read twice) and
    written as one run of ordered files; a row's place is the count of rows in the files
    before its own plus its number in its file. No window spans the table, and rows of
    equal keys, which any range may hold, are parted by a number of their own. With
    ``within`` the files stand in one folder for each of its values, and places count from
    0 in each. Nulls come first. Rows of equal keys stand in any order.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    order = [within, *keys] if within else keys
    dealt = df.withColumn("ranked_row", F.monotonically_increasing_id()).repartitionByRange(*order, "ranked_row").drop("ranked_row")
    writer = dealt.sortWithinPartitions(*order).write.option("compression", "zstd")
    (writer.partitionBy(within) if within else writer).parquet(path)
    rows = spark.read.schema(df.schema).parquet(path).select(
        *[F.col(f"`{c}`") for c in df.columns], F.col("_metadata.file_path").alias("ranked_file"), F.col("_metadata.row_index").alias("ranked_at")
    )
    groups = [within] if within else []
    part = F.regexp_extract("ranked_file", r"/part-(\d+)[^/]*$", 1).cast("int")
    before = Window.partitionBy(*groups).orderBy(part, "ranked_file").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy(*groups, "ranked_file").agg(F.count(F.lit(1)).alias("ranked_rows"))
    starts = sizes.select("ranked_file", F.coalesce(F.sum("ranked_rows").over(before), F.lit(0)).alias("ranked_start"))
    out = rows.join(starts, "ranked_file").withColumn(rank, F.col("ranked_start") + F.col("ranked_at"))
    out = out.select(*[F.col(f"`{c}`") for c in df.columns], rank)
    out.planline_path = path
    return out
