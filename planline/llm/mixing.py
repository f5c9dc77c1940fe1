"""Mixing sources to target weights by hierarchical budgeting.

A token budget runs down a tree of domains, languages and sources by weight. A child
that cannot use its share (its tokens times the most epochs) leaves the shortage to
its siblings by their weights; only what no sibling can take goes back to the parent's
siblings. Each leaf takes whole epochs first and then a prefix, by tokens, of one more
epoch, whose order is a seeded hash.

All of it is grouped sums and joins over the nodes and rows: neither the tree nor the
rows of a leaf are gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from planline.llm.shared import written

LEVELS = ("domain", "lang", "source")
Path = tuple[str, ...]
#: Hex digits of the order that one step of :func:`_prefix` looks at, and its steps.
DIGITS, STEPS = 3, 2
#: Weights become whole numbers of this part of one, so that sums and quotients are exact.
UNIT = 2**30


def _prefix(rows: DataFrame, group: list[str], limit: str, amount: str) -> DataFrame:
    """Add ``in_prefix``: whether the row ends within its group's first ``limit``, by the hex digits in ``order``.

    Sums over ranges of the order find the range that the limit falls in; only its
    rows are looked at more closely, so that few rows of a group are ever put in order
    in one task. Rows of equal order come one after the other.
    """
    done, rows = [], rows.withColumn("left", F.col(limit))
    for step in range(STEPS):
        rows = rows.withColumn("range", F.substring("order", 1 + step * DIGITS, DIGITS))
        sums = rows.where("left > 0").groupBy(*group, "range").agg(F.sum(amount).alias("n"), F.first("left").alias("room"))
        upto = F.sum("n").over(Window.partitionBy(*group).orderBy("range"))
        cut = sums.withColumn("before", upto - F.col("n")).where("before <= room and before + n > room").select(*group, F.col("range").alias("cut"), "before")
        # written, so that Spark knows its size: a row for each group, sent to the rows where it is small
        rows = rows.join(written(cut, "cut"), group, "left")
        # without a cut the limit is 0 or holds the whole group
        inside = F.when(F.col("cut").isNull(), F.col("left") > 0).otherwise(F.col("range") < F.col("cut"))
        edge = F.coalesce(F.col("range") == F.col("cut"), F.lit(False))
        done.append(rows.where(~edge).withColumn("in_prefix", inside).drop("range", "cut", "before", "left"))
        rows = written(rows.where(edge).withColumn("left", F.col("left") - F.col("before")).drop("range", "cut", "before"), "edge")
    place = Window.partitionBy(*group).orderBy("order").rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumn("in_prefix", F.sum(amount).over(place) <= F.col("left")).drop("left")
    for part in done:
        out = out.unionByName(part)
    return out


def divide(children: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Split each parent's ``budget`` among its children by ``weight``, none over its ``capacity``: adds ``given``.

    Children whose share exceeds their capacity are filled and the rest is shared out
    again, until none is. What whole tokens leave over goes, a token each, to the
    children first in a hash of their names.
    """
    share = F.expr("CAST(CAST(budget - taken AS DECIMAL(19, 0)) * CAST(weight AS DECIMAL(17, 0)) div total AS BIGINT)")
    state = children.withColumn("given", F.when((F.col("weight") <= 0) | (F.col("capacity") <= 0), F.lit(0).cast("long")))
    while True:
        sums = state.groupBy(*parent).agg(
            F.coalesce(F.sum("given"), F.lit(0)).alias("taken"), F.sum(F.when(F.col("given").isNull(), F.col("weight").cast("decimal(17,0)"))).alias("total")
        )
        parted = state.join(sums, parent).withColumn("share", share)
        full = F.col("given").isNull() & (F.col("share") >= F.col("capacity"))
        parted = written(parted.withColumn("filled", full), "budgets")
        if not parted.where("filled").limit(1).count():
            break
        state = parted.withColumn("given", F.when(F.col("filled"), F.col("capacity")).otherwise(F.col("given"))).select(*state.columns)
    over = parted.groupBy(*parent).agg((F.first("budget") - F.first("taken") - F.sum(F.when(F.col("given").isNull(), F.col("share")))).alias("over"))
    parted = parted.join(over, parent).withColumn("one", F.col("given").isNull().cast("long"))
    parted = parted.withColumn("room", F.when(F.col("one") == 1, F.col("over")).otherwise(F.lit(0)).cast("long")).withColumn("order", F.md5(name))
    closed = parted.where("one = 0").select(*children.columns, "given")
    opened = _prefix(parted.where("one = 1"), parent, "room", "one")
    return closed.unionByName(opened.select(*children.columns, (F.col("share") + F.col("in_prefix").cast("long")).alias("given")))


def plan(leaves: DataFrame, weights: dict[Path, float], budget: int, epochs: int) -> DataFrame:
    """``take`` tokens of each leaf (domain, lang, source, n tokens). ``weights``: by path of any level, 1 where absent.

    Nodes of weight 0 take nothing and leave what would have been theirs to the others.
    """
    spark = leaves.sparkSession
    nodes = [leaves.withColumn("capacity", F.col("n") * epochs)]
    for k in range(len(LEVELS), 0, -1):
        path = list(LEVELS[:k])
        own = [(*p, max(1, round(w * UNIT)) if w > 0 else 0) for p, w in weights.items() if len(p) == k]
        own = spark.createDataFrame(own, ", ".join(f"{x} string" for x in path) + ", weight long")
        node = nodes[0].join(own, path, "left").withColumn("weight", F.coalesce("weight", F.lit(UNIT)))
        nodes[0] = written(node.withColumn("capacity", F.when(F.col("weight") > 0, F.col("capacity")).otherwise(F.lit(0).cast("long"))), "nodes")
        if k > 1:
            nodes.insert(0, nodes[0].groupBy(*path[:-1]).agg(F.sum("capacity").alias("capacity")))
    most = nodes[0].agg(F.sum("capacity")).first()[0] or 0
    given = spark.range(1).select(F.lit(min(budget, most)).cast("long").alias("budget"))
    for k, node in enumerate(nodes):
        path = list(LEVELS[: k + 1])
        children = node.withColumn("budget", F.lit(min(budget, most)).cast("long")).withColumn("top", F.lit(0)) if k == 0 else node.join(given, path[:-1])
        given = written(divide(children, path[:-1] or ["top"], path[-1]).select(*path, F.col("given").alias("budget")), "given")
    return leaves.join(given, list(LEVELS)).select(*LEVELS, "n", F.col("budget").alias("take"))


def estimated_tokens(text: Column) -> Column:
    """A token for every four UTF-8 bytes, rounded up; 0 for null."""
    return F.ceil(F.octet_length(F.coalesce(text, F.lit(""))) / 4).cast("long")


def mix(
    docs: DataFrame,
    domain: Column,
    weights: dict[Path, float],
    share: float | None = None,
    budget: int | None = None,
    epochs: int = 3,
    seed: int = 1,
    tokens: Column | None = None,
) -> DataFrame:
    """All columns of ``docs`` with ``mix_tokens`` and ``mix_copies`` (how often the row is taken, 0 or more).

    The budget is ``budget`` tokens or ``share`` of all. Null domain, lang or source are
    the name ''. Rows without tokens (null or empty text) are never taken. A row enters a
    prefix only whole, so a leaf may fall short by less than one row. Rows of equal id
    and text share a place in the order, one after the other; they alone are put in
    order in one task however many they are. Columns of ``docs`` named as the new ones
    are replaced; others may have any name. An empty table gives no rows.
    """
    docs = docs.drop("mix_tokens", "mix_copies", *(f"mix_{x}" for x in LEVELS))
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    names = [F.coalesce(c.cast("string"), F.lit("")).alias(x) for x, c in zip(LEVELS, (domain, F.col("lang"), F.col("source")))]
    key = F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.xxhash64("text")).alias("key")
    rows = docs.select(whole, *names, key, (estimated_tokens(F.col("text")) if tokens is None else tokens).cast("long").alias("tokens"))
    leaves = written(rows.where("tokens > 0").groupBy(*LEVELS).agg(F.sum("tokens").alias("n")), "leaves")
    if budget is None:
        budget = int((leaves.agg(F.sum("n")).first()[0] or 0) * share)
    taken = written(plan(leaves, weights, budget, epochs).select(*LEVELS, F.expr("take div n").alias("full"), F.expr("take % n").alias("rest")), "plan")
    rows = rows.join(taken, list(LEVELS), "left")
    rows = rows.withColumn("order", F.md5(F.concat_ws("|", F.lit(seed), F.col("full"), F.col("key")))).withColumn("rest", F.coalesce("rest", F.lit(0).cast("long")))
    rows = _prefix(rows, list(LEVELS), "rest", "tokens")
    copies = F.when(F.col("tokens") > 0, F.coalesce("full", F.lit(0).cast("long")) + F.col("in_prefix").cast("long")).otherwise(F.lit(0).cast("long"))
    return rows.select("row.*", *[F.col(x).alias(f"mix_{x}") for x in LEVELS], F.col("tokens").alias("mix_tokens"), copies.alias("mix_copies"))
