"""Measures, distributions, classifications and windows over the entities."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from planline.adapter import SQL_ENTITIES as E
from planline.adapter import labels, parcels, paths, table
from planline.operators import aggregates as A
from planline.operators import windows as W

RULES = [("steel", "industrial"), ("brass", "commercial"), ("copper", "residential"), ("promo", "civic"), ("nickel", "residential")]
OVERRIDES = {"STANDARD": "open space"}


def measure_by_layer(spark, d):
    return A.measure(paths(spark, d).where("layout = 'O'"), ["layer"], "length")


def measure_total_withheld(spark, d):
    """The whole scope at once: the total is withheld as some paths have no length."""
    m = A.measure(paths(spark, d), [], "length")
    reason = F.when(F.col("matched") > F.col("measured"), F.concat((F.col("matched") - F.col("measured")).cast("string"), F.lit(" not measurable")))
    return m.withColumn("withheld_reason", reason)


def measure_top_groups(spark, d):
    m = A.measure(paths(spark, d), ["block"], "length")
    return m.orderBy(F.desc("sum_measured_only"), F.desc("matched"), "block").limit(25)


def entity_breakdown(spark, d):
    f = A.facets(paths(spark, d), [["layer"], ["type"]], ["layer", "type"])
    return f.select("layer", "type", "n")


def selection_summary_facet(spark, d):
    p = paths(spark, d).where("price > 20000")
    return A.facets(p, [["layer", "type"], ["layer"], ["type"], []], ["layer", "type"])


def types_and_layouts(spark, d):
    return A.facets(paths(spark, d), [["type"], ["layout"]], ["type", "layout"]).select("type", "layout", "n")


def distinct_values(spark, d):
    return A.distinct_values(labels(spark, d), "text").orderBy(F.desc("n"), "text").limit(25)


def distinct_count(spark, d):
    return labels(spark, d).groupBy("layer").agg(F.countDistinct("text").alias("n_distinct"), F.count("text").alias("total"))


def declared_but_absent(spark, d):
    used = table(spark, d, "customer").where("c_acctbal < -900").select(F.col("c_nationkey").alias("n_nationkey")).distinct()
    return table(spark, d, "nation").join(used, "n_nationkey", "left_anti").select(F.col("n_name").alias("layer"))


def empty_result_diagnosis(spark, d):
    """Why no row matches layer 'A', type 'line', layout 'F': each condition relaxed in one pass."""
    p = paths(spark, d)
    return p.agg(
        F.count_if((F.col("layer") == "A") & (F.col("type") == "line") & (F.col("layout") == "F")).alias("as_asked"),
        F.count_if((F.col("layer") == "A") & (F.col("layout") == "F")).alias("without_type"),
        F.count_if((F.col("type") == "line") & (F.col("layout") == "F")).alias("without_layer"),
        F.count_if((F.col("layer") == "A") & (F.lower("type") == "line") & (F.col("layout") == "F")).alias("any_case"),
    )


def stats_describe(spark, d):
    return A.describe(parcels(spark, d), [], "area")


def stats_by_layer_pooled(spark, d):
    p = paths(spark, d)
    pooled = A.describe(p, [], "length").select(F.lit(None).cast("string").alias("layer"), "*")
    return A.describe(p, ["layer"], "length").unionByName(pooled)


def mode_binned(spark, d):
    return A.mode_binned(parcels(spark, d), ["layer"], "area")


def above_median(spark, d):
    p = parcels(spark, d)
    median = W.quantiles(p, [], "area", {"median": 0.5}).select(F.round("median", 2).alias("median"))
    return p.crossJoin(F.broadcast(median)).agg(F.count_if(F.round("area", 2) > F.col("median")).alias("above"), F.first("median").alias("median"))


def distribution_note(spark, d):
    s = A.describe(parcels(spark, d), ["layer"], "area")
    note = (
        F.when(F.col("sd") == 0, "all equal")
        .when(F.col("least") == F.col("median"), "floored")
        .when(F.col("mean") > F.col("median") * 1.02, "upper tail")
        .otherwise("even")
    )
    return s.select("layer", "mean", "median", "sd", note.alias("note"))


def _classified(spark, d):
    p = parcels(spark, d)
    names = p.select("kind").distinct()
    return p.join(A.classify(names, "kind", RULES, OVERRIDES), "kind")


def classify_priority(spark, d):
    return A.classify(parcels(spark, d).select("kind").distinct(), "kind", RULES, OVERRIDES, "unclassified").orderBy("kind")


def land_use_summary(spark, d):
    return _classified(spark, d).groupBy("land_use").agg(F.count(F.lit(1)).alias("parcels"), F.round(F.sum("area"), 4).alias("area"))


def residual_layers(spark, d):
    c = _classified(spark, d).where(F.col("land_use").isNull())
    return c.groupBy("kind").agg(F.count(F.lit(1)).alias("parcels"), F.round(F.sum("area"), 4).alias("area"))


def unclassified_rank(spark, d):
    c = _classified(spark, d).where(F.col("land_use").isNull()).groupBy("layer").agg(F.count(F.lit(1)).alias("n"))
    return c.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "layer")).cast("long")).orderBy("rank").limit(20)


def shape_fingerprint(spark, d):
    """Parcels by their two edge lengths (the ring's shape)."""
    p = parcels(spark, d).groupBy("w", "h").agg(F.count(F.lit(1)).alias("n"), F.min("handle").alias("first_handle"))
    return p.where("n > 1").orderBy(F.desc("n"), "w", "h").limit(50)


def type_mix(spark, d):
    p = paths(spark, d).groupBy("layer", "type").agg(F.count(F.lit(1)).alias("n"))
    return W.top_n(p, ["layer"], [F.desc("n"), "type"], 2).select("layer", "type", "n", F.col("rank").cast("long").alias("place"))


def dossier_roles(spark, d):
    return A.role(paths(spark, d), ["layer", "layout"])


def dossier_coverage(spark, d):
    """Entities over all buckets equal the table's rows."""
    p = paths(spark, d)
    return p.groupBy("layer", "layout").count().agg(F.sum("count").alias("in_buckets")).crossJoin(p.agg(F.count(F.lit(1)).alias("in_table")))


def anomaly_rollup(spark, d):
    p = paths(spark, d).groupBy("block").agg(F.count_if(F.col("length").isNull()).alias("unmeasured"), F.count(F.lit(1)).alias("n"))
    return p.agg(F.count_if(F.col("unmeasured") > 0).alias("flagged"), F.count_if(F.col("unmeasured") == F.col("n")).alias("unexamined"), F.count(F.lit(1)).alias("buckets"))


def roles_rollup(spark, d):
    r = A.role(paths(spark, d), ["layer", "layout"])
    return r.groupBy("role").agg(F.sum("entities").alias("entities"), F.count(F.lit(1)).alias("buckets"))


def block_census(spark, d):
    p = paths(spark, d).groupBy("block").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("type").alias("types"))
    return p.groupBy("n", "types").agg(F.count(F.lit(1)).alias("blocks"))


def geometry_coverage(spark, d):
    p = paths(spark, d)
    return p.groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.count("length").alias("measured"), F.count_if(F.col("length").isNull()).alias("refused"))


def drafting_hygiene(spark, d):
    p = paths(spark, d)
    return p.agg(F.count_if(F.col("layer") == "R").alias("on_layer_r"), F.count_if((F.col("layer") == "R") & F.col("length").isNull()).alias("unmeasured_on_r"), F.countDistinct("layer").alias("layers"))


def layer_impact(spark, d):
    return paths(spark, d).where("layer = 'N'").groupBy("layout").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("block").alias("blocks"))


def parcel_inventory(spark, d):
    c = _classified(spark, d).where(F.col("area").between(300, 1200))
    return c.groupBy("land_use", "layer").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("area"), 4).alias("mean_area"))


def outliers_z(spark, d):
    o = W.outliers(parcels(spark, d), ["layer"], "area", 1.8)
    return o.select("handle", "layer", F.round("area", 4).alias("area"), F.round("z", 6).alias("z"))


def cumulative_share_98(spark, d):
    n = labels(spark, d).groupBy("text").agg(F.count(F.lit(1)).alias("n"))
    return W.cumulative_share(n, "n", "text", 0.98).select("text", "n")


def quantile_classes(spark, d):
    q = W.nearest_rank(parcels(spark, d), ["layer"], "area", {"q20": 0.2, "q40": 0.4, "q60": 0.6, "q80": 0.8, "q100": 1.0})
    return q.select("layer", *[F.round(c, 4).alias(c) for c in ("q20", "q40", "q60", "q80", "q100")])


def step_lookup(spark, d):
    breaks = F.array(*[F.lit(float(x)) for x in (300, 500, 800, 1200)])
    step = F.size(F.filter(breaks, lambda b: b < F.col("area"))).cast("long")
    return parcels(spark, d).groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("n"))


def tukey_fence(spark, d):
    p = paths(spark, d).where("length is not null")
    q = W.nearest_rank(p, ["layer"], "length", {"p25": 0.25, "p75": 0.75})
    width = F.col("p75") - F.col("p25")
    return q.select("layer", "p25", "p75", (F.col("p25") - 1.5 * width).alias("low"), (F.col("p75") + 1.5 * width).alias("high"))


def top_n_per_group(spark, d):
    t = W.top_n(paths(spark, d), ["layer", "type"], ["handle"], 10)
    return t.select("layer", "type", "handle", F.col("rank").cast("long").alias("place"))


def gap_islands(spark, d):
    i = W.islands(parcels(spark, d), ["layer"], "minx", "maxx", ["handle"], 40.0)
    return i.groupBy("layer", F.col("island").cast("long").alias("island")).agg(F.count(F.lit(1)).alias("n"), F.round(F.min("minx"), 4).alias("low"), F.round(F.max("maxx"), 4).alias("high"))


def widest_feature(spark, d):
    return parcels(spark, d).groupBy("layer").agg(
        F.max_by("handle", F.struct(F.round(F.col("maxx") - F.col("minx"), 6), -F.col("handle"))).alias("handle"), F.round(F.max(F.col("maxx") - F.col("minx")), 4).alias("width")
    )


def dominant_use(spark, d):
    c = _classified(spark, d).where(F.col("land_use").isNotNull()).groupBy("layer", "land_use").agg(F.count(F.lit(1)).alias("n"))
    return W.top_n(c, ["layer"], [F.desc("n"), "land_use"], 1).select("layer", "land_use", "n")


def rank_profiles(spark, d):
    p = paths(spark, d).groupBy("layer", "layout").agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("length"))
    return p.select("layer", "layout", "n", F.row_number().over(Window.orderBy(F.desc("n"), "layer", "layout")).cast("long").alias("place"))


def network_measure(spark, d):
    p = paths(spark, d).where("type IN ('LINE', 'ARC')")
    sums = p.groupBy("layer").agg(F.round(F.sum("length"), 4).alias("length"), F.count_if(F.col("length").isNull()).alias("unmeasured"))
    median = W.quantiles(p, ["layer"], "length", {"median": 0.5}).select("layer", F.round(F.col("median") * 0.001, 6).alias("snap_tolerance"))
    return sums.join(median, "layer", "left")


def grade_spread(spark, d):
    """Evidence grades by how many places state a text, the weakest by layer."""
    g = labels(spark, d).groupBy("layer", "text").agg(F.count(F.lit(1)).alias("places"))
    rank = F.when(F.col("places") >= 6, 3).when(F.col("places") >= 3, 2).otherwise(1)
    return g.groupBy("layer").agg(F.count_if(rank == 3).alias("corroborated"), F.count_if(rank == 2).alias("stated"), F.count_if(rank == 1).alias("inferred"), F.min(rank).cast("long").alias("weakest"))


def null_aware_total(spark, d):
    """A total only where every part has a value and all units agree."""
    p = paths(spark, d).withColumn("unit", F.when(F.col("type") == "ARC", "ft").otherwise("m"))
    ok = (F.count("length") == F.count(F.lit(1))) & (F.countDistinct("unit") == 1)
    return p.groupBy("block").agg(F.when(ok, F.round(F.sum("length"), 4)).alias("total"), F.when(F.countDistinct("unit") == 1, F.min("unit")).alias("unit"), F.count(F.lit(1)).alias("parts"))


_M = "count(*) AS matched, count(length) AS measured, count(CASE WHEN length = 0 THEN 1 END) AS zeros, round(sum(length), 4) AS sum_measured_only, CASE WHEN count(*) = count(length) THEN round(sum(length), 4) END AS total_for_all_matched"
_D = "count({v}) AS n, round(avg({v}), 4) AS mean, round(stddev_pop({v}), 4) AS sd, min({v}) AS least, round(quantile_cont({v}, 0.25), 4) AS p25, round(quantile_cont({v}, 0.5), 4) AS median, round(quantile_cont({v}, 0.75), 4) AS p75, max({v}) AS greatest, round(sum({v}), 4) AS total"
_USE = "CASE WHEN kind = 'STANDARD' THEN 'open space' " + " ".join(f"WHEN contains(lower(kind), '{w}') THEN '{u}'" for w, u in RULES)
_FAM = "CASE WHEN type = 'LWPOLYLINE' THEN 'region' WHEN type IN ('LINE', 'ARC') THEN 'network' ELSE 'points' END"
_ROLE = f"""f AS (SELECT layer, layout, {_FAM} AS family, count(*) AS n FROM paths GROUP BY 1, 2, 3),
roles AS (SELECT layer, layout, CAST(sum(n) AS BIGINT) AS entities, CASE WHEN max(n) >= 0.6 * sum(n) THEN arg_max(family, n) ELSE 'mixed' END AS role FROM f GROUP BY layer, layout)"""
_NR = "max(CASE WHEN rn = greatest(1, ceil({s} * n)) THEN {v} END)"

SQL = {
    "measure_by_layer": f"{E} SELECT layer, {_M} FROM paths WHERE layout = 'O' GROUP BY layer",
    "measure_total_withheld": f"{E} SELECT {_M}, CASE WHEN count(*) > count(length) THEN CAST(count(*) - count(length) AS VARCHAR) || ' not measurable' END AS withheld_reason FROM paths",
    "measure_top_groups": f"{E} SELECT block, {_M} FROM paths GROUP BY block ORDER BY sum_measured_only DESC NULLS LAST, matched DESC, block LIMIT 25",
    "entity_breakdown": f"{E} SELECT layer, NULL AS type, count(*) AS n FROM paths GROUP BY layer UNION ALL SELECT NULL, type, count(*) FROM paths GROUP BY type",
    "selection_summary_facet": f"{E} SELECT layer, type, count(*) AS n, CAST(grouping(layer, type) AS BIGINT) AS level FROM paths WHERE price > 20000 GROUP BY GROUPING SETS ((layer, type), (layer), (type), ())",
    "types_and_layouts": f"{E} SELECT type, NULL AS layout, count(*) AS n FROM paths GROUP BY type UNION ALL SELECT NULL, layout, count(*) FROM paths GROUP BY layout",
    "distinct_values": f"{E} SELECT text, count(*) AS n FROM labels WHERE text IS NOT NULL AND text <> '' GROUP BY text ORDER BY n DESC, text LIMIT 25",
    "distinct_count": f"{E} SELECT layer, count(DISTINCT text) AS n_distinct, count(text) AS total FROM labels GROUP BY layer",
    "declared_but_absent": "SELECT n_name AS layer FROM nation WHERE n_nationkey NOT IN (SELECT c_nationkey FROM customer WHERE c_acctbal < -900)",
    "empty_result_diagnosis": f"{E} SELECT count(CASE WHEN layer = 'A' AND type = 'line' AND layout = 'F' THEN 1 END) AS as_asked, count(CASE WHEN layer = 'A' AND layout = 'F' THEN 1 END) AS without_type, count(CASE WHEN type = 'line' AND layout = 'F' THEN 1 END) AS without_layer, count(CASE WHEN layer = 'A' AND lower(type) = 'line' AND layout = 'F' THEN 1 END) AS any_case FROM paths",
    "stats_describe": f"{E} SELECT {_D.format(v='area')} FROM parcels",
    "stats_by_layer_pooled": f"{E} SELECT layer, {_D.format(v='length')} FROM paths GROUP BY GROUPING SETS ((layer), ())",
    "mode_binned": f"""{E}, c AS (SELECT layer, round(area, 2) AS bin, count(*) AS n FROM parcels GROUP BY 1, 2),
        r AS (SELECT *, row_number() OVER (PARTITION BY layer ORDER BY n DESC, bin) AS rn, max(n) OVER (PARTITION BY layer) AS top FROM c)
        SELECT layer, max(CASE WHEN rn = 1 THEN bin END) AS mode, max(n) AS mode_count, count(CASE WHEN n = top THEN 1 END) AS ties FROM r GROUP BY layer""",
    "above_median": f"{E}, m AS (SELECT round(quantile_cont(area, 0.5), 2) AS median FROM parcels) SELECT count(CASE WHEN round(area, 2) > median THEN 1 END) AS above, max(median) AS median FROM parcels, m",
    "distribution_note": f"""{E}, s AS (SELECT layer, {_D.format(v='area')} FROM parcels GROUP BY layer)
        SELECT layer, mean, median, sd, CASE WHEN sd = 0 THEN 'all equal' WHEN least = median THEN 'floored' WHEN mean > median * 1.02e0 THEN 'upper tail' ELSE 'even' END AS note FROM s""",
    "classify_priority": f"{E} SELECT DISTINCT kind, {_USE} ELSE 'unclassified' END AS land_use, CASE WHEN kind = 'STANDARD' THEN 'override' WHEN {_USE} END IS NULL THEN 'default' ELSE 'pattern' END AS basis FROM parcels",
    "land_use_summary": f"{E} SELECT {_USE} END AS land_use, count(*) AS parcels, round(sum(area), 4) AS area FROM parcels GROUP BY 1",
    "residual_layers": f"{E} SELECT kind, count(*) AS parcels, round(sum(area), 4) AS area FROM parcels WHERE {_USE} END IS NULL GROUP BY kind",
    "unclassified_rank": f"{E}, c AS (SELECT layer, count(*) AS n FROM parcels WHERE {_USE} END IS NULL GROUP BY layer) SELECT layer, n, row_number() OVER (ORDER BY n DESC, layer) AS rank FROM c ORDER BY rank LIMIT 20",
    "shape_fingerprint": f"{E} SELECT w, h, count(*) AS n, min(handle) AS first_handle FROM parcels GROUP BY w, h HAVING count(*) > 1 ORDER BY n DESC, w, h LIMIT 50",
    "type_mix": f"{E}, c AS (SELECT layer, type, count(*) AS n FROM paths GROUP BY 1, 2) SELECT layer, type, n, place FROM (SELECT *, row_number() OVER (PARTITION BY layer ORDER BY n DESC, type) AS place FROM c) WHERE place <= 2",
    "dossier_roles": f"{E}, {_ROLE} SELECT layer, layout, entities, role FROM roles",
    "dossier_coverage": f"{E} SELECT count(*) AS in_buckets, count(*) AS in_table FROM paths",
    "anomaly_rollup": f"{E}, b AS (SELECT block, count(*) - count(length) AS unmeasured, count(*) AS n FROM paths GROUP BY block) SELECT count(CASE WHEN unmeasured > 0 THEN 1 END) AS flagged, count(CASE WHEN unmeasured = n THEN 1 END) AS unexamined, count(*) AS buckets FROM b",
    "roles_rollup": f"{E}, {_ROLE} SELECT role, CAST(sum(entities) AS BIGINT) AS entities, count(*) AS buckets FROM roles GROUP BY role",
    "block_census": f"{E}, b AS (SELECT block, count(*) AS n, count(DISTINCT type) AS types FROM paths GROUP BY block) SELECT n, types, count(*) AS blocks FROM b GROUP BY n, types",
    "geometry_coverage": f"{E} SELECT type, count(*) AS n, count(length) AS measured, count(*) - count(length) AS refused FROM paths GROUP BY type",
    "drafting_hygiene": f"{E} SELECT count(CASE WHEN layer = 'R' THEN 1 END) AS on_layer_r, count(CASE WHEN layer = 'R' AND length IS NULL THEN 1 END) AS unmeasured_on_r, count(DISTINCT layer) AS layers FROM paths",
    "layer_impact": f"{E} SELECT layout, count(*) AS n, count(DISTINCT block) AS blocks FROM paths WHERE layer = 'N' GROUP BY layout",
    "parcel_inventory": f"{E} SELECT {_USE} END AS land_use, layer, count(*) AS n, round(avg(area), 4) AS mean_area FROM parcels WHERE area >= 300 AND area <= 1200 GROUP BY 1, 2",
    "outliers_z": f"""{E}, s AS (SELECT layer, avg(area) AS m, stddev_pop(area) AS sd FROM parcels GROUP BY layer)
        SELECT handle, p.layer, round(area, 4) AS area, round((area - m) / sd, 6) AS z FROM parcels p JOIN s ON p.layer = s.layer WHERE sd <> 0 AND abs((area - m) / nullif(sd, 0)) > 1.8""",
    "cumulative_share_98": f"""{E}, c AS (SELECT text, count(*) AS n FROM labels GROUP BY text), r AS (SELECT *, sum(n) OVER (ORDER BY n DESC, text ROWS UNBOUNDED PRECEDING) - n AS before, sum(n) OVER () AS total FROM c)
        SELECT text, n FROM r WHERE before < 0.98 * total""",
    "quantile_classes": f"""{E}, r AS (SELECT layer, area, row_number() OVER (PARTITION BY layer ORDER BY area, handle) AS rn, count(*) OVER (PARTITION BY layer) AS n FROM parcels)
        SELECT layer, {', '.join(f"round({_NR.format(s=f'{k}e-2', v='area')}, 4) AS q{k}" for k in (20, 40, 60, 80, 100))} FROM r GROUP BY layer""",
    "step_lookup": f"{E} SELECT CAST(area > 300 AS BIGINT) + CAST(area > 500 AS BIGINT) + CAST(area > 800 AS BIGINT) + CAST(area > 1200 AS BIGINT) AS step, count(*) AS n FROM parcels GROUP BY 1",
    "tukey_fence": f"""{E}, r AS (SELECT layer, length, row_number() OVER (PARTITION BY layer ORDER BY length, handle) AS rn, count(*) OVER (PARTITION BY layer) AS n FROM paths WHERE length IS NOT NULL),
        q AS (SELECT layer, {_NR.format(s='25e-2', v='length')} AS p25, {_NR.format(s='75e-2', v='length')} AS p75 FROM r GROUP BY layer)
        SELECT layer, p25, p75, p25 - 1.5e0 * (p75 - p25) AS low, p75 + 1.5e0 * (p75 - p25) AS high FROM q""",
    "top_n_per_group": f"{E} SELECT layer, type, handle, place FROM (SELECT *, row_number() OVER (PARTITION BY layer, type ORDER BY handle) AS place FROM paths) WHERE place <= 10",
    "gap_islands": f"""{E}, g AS (SELECT *, max(maxx) OVER (PARTITION BY layer ORDER BY minx, maxx, handle ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM parcels),
        i AS (SELECT *, CAST(sum(CASE WHEN seen IS NULL OR minx - seen > 40 THEN 1 ELSE 0 END) OVER (PARTITION BY layer ORDER BY minx, maxx, handle ROWS UNBOUNDED PRECEDING) AS BIGINT) AS island FROM g)
        SELECT layer, island, count(*) AS n, round(min(minx), 4) AS low, round(max(maxx), 4) AS high FROM i GROUP BY layer, island""",
    "widest_feature": f"""{E}, r AS (SELECT layer, handle, maxx - minx AS width, row_number() OVER (PARTITION BY layer ORDER BY round(maxx - minx, 6) DESC, handle) AS rn FROM parcels)
        SELECT layer, max(CASE WHEN rn = 1 THEN handle END) AS handle, round(max(width), 4) AS width FROM r GROUP BY layer""",
    "dominant_use": f"""{E}, c AS (SELECT layer, {_USE} END AS land_use, count(*) AS n FROM parcels GROUP BY 1, 2)
        SELECT layer, land_use, n FROM (SELECT *, row_number() OVER (PARTITION BY layer ORDER BY n DESC, land_use) AS rn FROM c WHERE land_use IS NOT NULL) WHERE rn = 1""",
    "rank_profiles": f"{E}, c AS (SELECT layer, layout, count(*) AS n FROM paths GROUP BY 1, 2) SELECT layer, layout, n, row_number() OVER (ORDER BY n DESC, layer, layout) AS place FROM c",
    "network_measure": f"{E} SELECT layer, round(sum(length), 4) AS length, round(quantile_cont(length, 0.5) * 0.001e0, 6) AS snap_tolerance, count(*) - count(length) AS unmeasured FROM paths WHERE type IN ('LINE', 'ARC') GROUP BY layer",
    "grade_spread": f"""{E}, g AS (SELECT layer, text, CASE WHEN count(*) >= 6 THEN 3 WHEN count(*) >= 3 THEN 2 ELSE 1 END AS r FROM labels GROUP BY layer, text)
        SELECT layer, count(CASE WHEN r = 3 THEN 1 END) AS corroborated, count(CASE WHEN r = 2 THEN 1 END) AS stated, count(CASE WHEN r = 1 THEN 1 END) AS inferred, CAST(min(r) AS BIGINT) AS weakest FROM g GROUP BY layer""",
    "null_aware_total": f"""{E}, p AS (SELECT *, CASE WHEN type = 'ARC' THEN 'ft' ELSE 'm' END AS unit FROM paths)
        SELECT block, CASE WHEN count(length) = count(*) AND count(DISTINCT unit) = 1 THEN round(sum(length), 4) END AS total, CASE WHEN count(DISTINCT unit) = 1 THEN min(unit) END AS unit, count(*) AS parts FROM p GROUP BY block""",
}
QUERIES = {name: globals()[name] for name in SQL}
