"""Printed dimensions against drawn geometry: what a label may mean, and whether it is true.

A label is compared with what lies within its reach. A ring offers one candidate for each
distinct length among its edges in reach, a path its own length. Where the candidates do
not measure the same within the label's tolerance no verdict is given: the nearer one would
look like a checked one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from planline.functions import geometry as G
from planline.operators import spatial
from planline.operators.graph import shuffled
from planline.operators.text import NUMBER, tolerance

# Units a label may end with, and which of them state no length.
UNITS = "sqm|m2|mm|cm|km|m|ft|in|deg|°"
AREA_UNITS, ANGLE_UNITS = ("sqm", "m2"), ("°", "deg")
#: Two sizes, as in ``12 x 25``.
PAIR = r"^[0-9]+(?:\.[0-9]+)?\s*[xX×*]\s*[0-9]+(?:\.[0-9]+)?\s*(?:" + UNITS + r")?$"
PLUS_MINUS = r"±|\+/-"


def printed_number(text: Column) -> Column:
    """struct(value, decimals, unit, stated, skipped): the length a label prints, or why it prints none.

    ``skipped``: empty, size (two numbers), area, angle or no number. ``stated`` is a
    tolerance the label gives itself (the number after ± or +/-).
    """
    t = F.trim(F.coalesce(text, F.lit("")))
    unit = F.lower(F.regexp_extract(t, rf"(?i)({UNITS})$", 1))
    numbers = F.transform(F.regexp_extract_all(t, F.lit(NUMBER), F.lit(1)), lambda n: F.replace(n, F.lit(","), F.lit("")))

    def said(r: Column) -> Column:
        t, unit, first, second = r["t"], r["unit"], F.get(r["numbers"], F.lit(0)), F.get(r["numbers"], F.lit(1))
        skipped = (
            F.when(t == "", "empty").when(t.rlike(PAIR), "size").when(unit.isin(*AREA_UNITS), "area").when(unit.isin(*ANGLE_UNITS), "angle").when(first.isNull(), "no number")
        )
        point = F.regexp_extract(first, r"\.([0-9]+)$", 1)
        length = F.struct(first.try_cast("double").alias("value"), F.length(point).cast("long").alias("decimals"), F.when(t.rlike(PLUS_MINUS), F.abs(second.try_cast("double"))).alias("stated"))

        def fields(s: Column) -> Column:
            of = lambda c: F.when(s.isNull(), length[c]).alias(c)
            return F.struct(of("value"), of("decimals"), F.nullif(unit, F.lit("")).alias("unit"), of("stated"), s.alias("skipped"))

        return G.bound(skipped, fields)

    # each pattern is looked for once a text
    return G.bound(F.struct(t.alias("t"), unit.alias("unit"), numbers.alias("numbers")), said)


def _spans(points: Column, edges: Column) -> Column:
    """A ring's sides, with what every distance to them needs; ``long`` is null of a side without length."""
    lengths = F.when(F.size(edges) == F.size(points), edges)

    def side(p: Column, k: Column) -> Column:
        q = F.coalesce(F.get(points, k + 1), F.get(points, F.lit(0)))
        dx, dy = q["x"] - p["x"], q["y"] - p["y"]
        long = F.nullif(dx * dx + dy * dy, F.lit(0.0))
        return F.struct(p["x"].alias("px"), p["y"].alias("py"), q["x"].alias("qx"), q["y"].alias("qy"), dx.alias("dx"), dy.alias("dy"), long.alias("long"), F.get(lengths, k).alias("length"))

    return F.when(F.size(points) >= 3, F.transform(points, side))


def _seen(x: Column, y: Column, radius: Column) -> Column:
    """struct(contains, offers) of a shape (b_spans, b_noise, b_edged, b_length, box) from a point.

    ``offers`` are array<struct<distance, length>> within reach. A path has no stored outline
    here, so the distance to its box is a lower bound; a null length is an offer without a
    measure. Each side's distance is worked out once.
    """
    spans = F.col("b_spans")

    def nearest(e: Column) -> Column:
        t = F.coalesce(((x - e["px"]) * e["dx"] + (y - e["py"]) * e["dy"]) / e["long"], F.lit(0.0))
        t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
        return F.struct(t.alias("t"), e["px"].alias("px"), e["py"].alias("py"), e["dx"].alias("dx"), e["dy"].alias("dy"), e["length"].alias("length"))

    def away(e: Column) -> Column:
        return F.struct(F.hypot(x - (e["px"] + e["t"] * e["dx"]), y - (e["py"] + e["t"] * e["dy"])).alias("distance"), e["length"].alias("length"))

    def crossed(e: Column) -> Column:
        return ((e["py"] > y) != (e["qy"] > y)) & (x < (e["qx"] - e["px"]) * (y - e["py"]) / F.nullif(e["qy"] - e["py"], F.lit(0.0)) + e["px"])

    in_reach = lambda offers: F.filter(offers, lambda o: o["distance"] <= radius)
    whole = lambda outline: F.array(F.struct(outline.alias("distance"), F.col("b_length").alias("length")))

    def of_ring(sides: Column) -> Column:
        outline = F.array_min(F.transform(sides, lambda e: e["distance"]))
        inside = (F.size(F.filter(spans, crossed)) % 2 == 1) | F.coalesce(outline <= F.col("b_noise"), F.lit(False))
        return F.struct(inside.alias("contains"), in_reach(F.when(F.col("b_edged"), sides).otherwise(whole(outline))).alias("offers"))

    box = G.box_distance([x, y, x, y], [F.col(f"b_{c}") for c in ("minx", "miny", "maxx", "maxy")])
    path = F.struct(F.lit(False).alias("contains"), in_reach(whole(box)).alias("offers"))
    return F.when(spans.isNotNull(), G.bound(F.transform(F.transform(spans, nearest), away), of_ring)).otherwise(path)


def label_candidates(labels: DataFrame, shapes: DataFrame, cell: float, among: DataFrame | None = None) -> DataFrame:
    """label, handle, distance, measured, contains: every candidate of every label, and rows of containing shapes out of reach (no distance).

    ``labels``: handle, x, y, radius (null: no reach). ``shapes``: handle, points and edges
    (null for paths), length, minx, miny, maxx, maxy. Boxes meet by grid cells, each box on
    the grid that fits it, so one wide reach does not widen the others'. ``among``: a table
    that holds ``labels`` and costs less to read.
    """
    reach = F.coalesce("radius", F.lit(0.0))
    points, edges = F.col("points"), F.col("edges")
    extent = lambda c: F.array_max(F.transform(points, lambda p: p[c])) - F.array_min(F.transform(points, lambda p: p[c]))
    # worked out once a shape, not for each label near it
    drawn = shapes.select(
        "handle", "length", "minx", "miny", "maxx", "maxy", _spans(points, edges).alias("spans"),
        (F.hypot(extent("x"), extent("y")) * 1e-9).alias("noise"), F.coalesce(F.size(edges) == F.size(points), F.lit(False)).alias("edged"),
    )
    corners = [(F.col("x") - reach).alias("minx"), (F.col("y") - reach).alias("miny"), (F.col("x") + reach).alias("maxx"), (F.col("y") + reach).alias("maxy")]
    placed = lambda l: l.where("x is not null and y is not null")
    asked, around = placed(labels).select("handle", *corners, "x", "y", "radius"), placed(labels if among is None else among).select(*corners)
    points, edges = F.col("points"), F.col("edges")
    extent = lambda c: F.array_max(F.transform(points, lambda p: p[c])) - F.array_min(F.transform(points, lambda p: p[c]))
    # worked out once a shape, not for each label near it
    drawn = shapes.select(
        "handle", "length", "minx", "miny", "maxx", "maxy", _spans(points, edges).alias("spans"),
        (F.hypot(extent("x"), extent("y")) * 1e-9).alias("noise"), F.coalesce(F.size(edges) == F.size(points), F.lit(False)).alias("edged"),
    )
    asked = labels.where("x is not null and y is not null").select(
        "handle", (F.col("x") - reach).alias("minx"), (F.col("y") - reach).alias("miny"), (F.col("x") + reach).alias("maxx"), (F.col("y") + reach).alias("maxy"), "x", "y", "radius"
    )
    pairs = spatial.box_matches(asked, drawn, cell, within=around)
    seen = F.array(_seen(F.col("a_x"), F.col("a_y"), F.col("a_radius")))
    # as rows of a generator this is worked out once a pair
    found = pairs.select(F.col("a_handle").alias("label"), F.col("b_handle").alias("handle"), F.explode(F.filter(seen, lambda r: r["contains"] | (F.size(r["offers"]) > 0))).alias("r"))
    found = found.select("label", "handle", "r.contains", "r.offers")
    rows = found.select("label", "handle", "contains", F.explode_outer("offers").alias("o"))
    rows = rows.where("o is not null or contains").repartition("label")  # for the ranks of each label too
    # one candidate for each length that a shape offers, its nearest edge
    return rows.groupBy("label", "handle", F.round("o.length", 9).alias("of_length"), F.col("o").isNotNull().alias("in_reach")).agg(
        F.min("o.distance").alias("distance"), F.min_by("o.length", "o.distance").alias("measured"), F.first("contains").alias("contains")
    ).select("label", "handle", "distance", "measured", "contains", "in_reach")


def label_truth(labels: DataFrame, shapes: DataFrame, cell: float, drawing_unit: str | None = None, given: float | None = None) -> DataFrame:
    """A row for each label: status, what it prints, what was measured, and why.

    ``status``: skipped (``reason`` says why; a unit other than the drawing's is not
    converted), unplaced (no point), unassociated (nothing measurable in reach), ambiguous
    (candidates differ by more than the tolerance), agrees or differs. ``tolerance`` is the
    widest of half the last printed place, what the label states, and a millionth of the
    measure (null where nothing was measured), or the one ``given`` in the drawing's units. ``nearest`` and ``runner_up`` are the first two candidates by distance, handle
    and length; ``enclosing`` counts rings that hold the label without an edge in reach.
    """
    p = F.col("printed")
    other_unit = p["unit"].isNotNull() & (p["unit"] != (drawing_unit or "").lower()) if drawing_unit else F.lit(False)

    def read(texts: DataFrame) -> DataFrame:
        # as rows of a generator a text is read once
        return texts.select("*", F.explode(F.array(printed_number(F.col("text")))).alias("printed")).withColumn("reason", F.coalesce(p["skipped"], F.when(other_unit, "unit")))

    found = label_candidates(read(labels).where("reason is null"), shapes, cell, among=labels)
    # candidates with a measure stand first; one pass over each label's rows tells all
    measurable = F.col("in_reach") & F.col("measured").isNotNull()
    place = F.row_number().over(Window.partitionBy("label").orderBy(F.desc("measurable"), "distance", "handle", "measured"))
    ranked = found.withColumn("measurable", measurable).withColumn("place", place)
    given_by = lambda c: F.when(F.col("measurable"), F.col(c))
    at = lambda k, c: F.max(F.when(F.col("place") == k, given_by(c)))
    best = ranked.groupBy("label").agg(
        at(1, "handle").alias("nearest"), at(1, "distance").alias("distance"), at(1, "measured").alias("measured"), at(1, "contains").alias("contains"),
        at(2, "handle").alias("runner_up"), at(2, "distance").alias("runner_up_distance"), F.nullif(F.count_if("measurable"), F.lit(0)).alias("candidates"),
        (F.max(given_by("measured")) - F.min(given_by("measured"))).alias("spread"),
        F.count_if(~F.col("in_reach")).alias("enclosing"), F.count_if(F.col("in_reach") & F.col("measured").isNull()).alias("unmeasured"),
    )
    rows = read(labels.select("handle", "text", "x", "y").join(shuffled(best.withColumnRenamed("label", "handle")), "handle", "left"))
    rows = rows.withColumn("tolerance", F.when(F.col("measured").isNotNull(), tolerance(p["decimals"], F.col("measured"), p["stated"]) if given is None else F.lit(float(given))))
    ambiguous = (F.col("candidates") > 1) & (F.col("spread") > F.col("tolerance"))
    status = (
        F.when(F.col("reason").isNotNull(), "skipped").when(F.col("x").isNull() | F.col("y").isNull(), "unplaced").when(F.col("candidates").isNull(), "unassociated")
        .when(ambiguous, "ambiguous").when(F.abs(F.col("measured") - p["value"]) <= F.col("tolerance"), "agrees").otherwise("differs")
    )
    count = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return rows.select(
        "handle", status.alias("status"), "reason", p["value"].alias("printed"), "measured", "tolerance", "nearest", "distance", "contains", "runner_up", "runner_up_distance",
        "spread", count("candidates"), count("enclosing"), count("unmeasured"),
    )
