"""Land use from configuration and patterns: precedence, problems, drafts, what is left over.

A configuration is rows of layer, land_use, role (one for each layer, as a drawing's own
file or a shared standard gives them); patterns are ordered pairs of a word and a use.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planline.operators import aggregates

CONFIG_DDL = "layer string, land_use string, role string"
#: A draft is ready where this share of a layer's objects speak for one use.
READY = 0.6


def read_config(spark: SparkSession, *paths: str) -> DataFrame:
    """Configurations from JSON lines; of a layer that several name the first path's row counts."""
    out = None
    for k, path in enumerate(paths):
        part = spark.read.schema(CONFIG_DDL).json(path).withColumn("place", F.lit(k))
        out = part if out is None else out.unionByName(part)
    first = out.where("layer is not null").groupBy("layer").agg(F.min(F.struct("place", "land_use", "role")).alias("r"))
    return first.select("layer", "r.land_use", "r.role")


def problems(config: DataFrame, declared: DataFrame) -> DataFrame:
    """(layer, problem, meant): configured layers that the drawing does not declare, and one that differs by case or blanks alone."""
    plain = lambda c: F.lower(F.trim(c))
    near = declared.select("layer").distinct().groupBy(plain("layer").alias("plain")).agg(F.min("layer").alias("meant"))
    absent = config.join(declared.select("layer").distinct(), "layer", "left_anti").withColumn("plain", plain("layer"))
    found = absent.join(near, "plain", "left")
    return found.select("layer", F.when(F.col("meant").isNull(), "absent").otherwise("other spelling").alias("problem"), "meant")


def effective_use(layers: DataFrame, config: DataFrame, standard: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """(layer, land_use, basis): the drawing's own configuration, else the shared standard, else the first pattern that the name holds."""
    own = config.select("layer", F.col("land_use").alias("own"))
    shared = standard.select("layer", F.col("land_use").alias("shared"))
    named = aggregates.classify(layers.select("layer").distinct(), "layer", rules, {}).select("layer", F.col("land_use").alias("pattern"))
    both = named.join(own, "layer", "left").join(shared, "layer", "left")
    basis = F.when(F.col("own").isNotNull(), "config").when(F.col("shared").isNotNull(), "standard").when(F.col("pattern").isNotNull(), "pattern")
    return both.select("layer", F.coalesce("own", "shared", "pattern").alias("land_use"), basis.alias("basis"))


def draft(objects: DataFrame, config: DataFrame, ready: float = READY) -> DataFrame:
    """A proposal for each layer of ``objects`` (layer, land_use by pattern or null, closed, area).

    (layer, objects, land_use, share, role, area, status): the use most objects speak for,
    the first by name on a tie, and its share; ``parcel`` where all are closed, ``network``
    where none is, else ``mixed``; the area only where each has one. ``configured`` agrees
    with the configuration, ``conflict`` does not, ``ready`` can be taken, ``unclear`` not.
    """
    by_use = objects.groupBy("layer", "land_use").agg(F.count(F.lit(1)).alias("n"))
    best = by_use.where("land_use is not null").groupBy("layer").agg(F.min(F.struct((-F.col("n")).alias("rank"), "land_use")).alias("b"))
    all_ = objects.groupBy("layer").agg(
        F.count(F.lit(1)).alias("objects"), F.count_if("closed").alias("closed"), F.when(F.count("area") == F.count(F.lit(1)), F.round(F.sum("area"), 4)).alias("area")
    )
    said = config.select("layer", F.col("land_use").alias("said"))
    both = all_.join(best, "layer", "left").join(said, "layer", "left").withColumn("land_use", F.col("b.land_use"))
    share = F.round(-F.col("b.rank") / F.col("objects"), 6)
    role = F.when(F.col("closed") == F.col("objects"), "parcel").when(F.col("closed") == 0, "network").otherwise("mixed")
    status = (
        F.when(F.col("said") == F.col("land_use"), "configured").when(F.col("said").isNotNull(), "conflict").when(-F.col("b.rank") >= ready * F.col("objects"), "ready").otherwise("unclear")
    )
    return both.select("layer", "objects", "land_use", share.alias("share"), role.alias("role"), "area", status.alias("status"))


def accepted(drafts: DataFrame) -> DataFrame:
    """The ready proposals as configuration rows."""
    return drafts.where("status = 'ready'").select("layer", "land_use", "role")


def write_draft(drafts: DataFrame, path: str) -> None:
    """Proposals as JSON lines for review; a path that exists is refused, so no configuration is overwritten."""
    drafts.write.mode("error").json(path)


def residual(layers: DataFrame, effective: DataFrame, vocabulary: dict[str, list[str]]) -> DataFrame:
    """(layer, land_use, word): layers without a use whose name holds a word of a use's vocabulary at word edges."""
    spark = layers.sparkSession
    words = spark.createDataFrame([(u, w.lower()) for u, ws in vocabulary.items() for w in ws], "land_use string, word string")
    open_ = layers.select("layer").distinct().join(effective.where("land_use is not null").select("layer"), "layer", "left_anti")
    tokens = open_.select("layer", F.explode(F.array_distinct(F.split(F.lower("layer"), "[^\\p{L}\\p{N}]+"))).alias("word")).where("word <> ''")
    return tokens.join(words, "word").select("layer", "land_use", "word")


def uses_matching(vocabulary: dict[str, list[str]], word: str) -> list[str]:
    """The uses that a search word names: by their own name or a word of theirs."""
    w = word.strip().lower()
    return sorted(u for u, ws in vocabulary.items() if w and (w == u.lower() or w in (x.lower() for x in ws)))


def availability(objects: DataFrame, config: DataFrame) -> DataFrame:
    """One row: configured layers that have objects, all layers, the share of objects on them, and whether a summary by use is meaningful."""
    on = objects.groupBy("layer").agg(F.count(F.lit(1)).alias("n")).join(config.select("layer", F.lit(1).alias("c")), "layer", "left")
    sums = on.agg(F.count("c").alias("configured"), F.count(F.lit(1)).alias("layers"), F.sum(F.when(F.col("c").isNotNull(), F.col("n"))).alias("some"), F.sum("n").alias("every"))
    share = F.round(F.coalesce("some", F.lit(0)) / F.col("every"), 6)
    return sums.select("configured", "layers", share.alias("share"), (F.col("configured") > 0).alias("meaningful"))
