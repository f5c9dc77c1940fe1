"""Blocks, placements and land-use configuration."""

from __future__ import annotations

from pyspark.sql import functions as F

from planline.adapter import SQL_ENTITIES as E
from planline.adapter import parcels, paths, table
from planline.operators import aggregates as A
from planline.operators import blocks as B
from planline.operators import graph as GR
from planline.operators import landuse as L
from planline.plans.queries_measures import RULES

#: The uses' own words, for names that no pattern classifies.
VOCABULARY = {"industrial": ["anodized", "plated"], "commercial": ["economy"], "residential": ["small", "medium", "large"], "civic": ["promo"]}


def _inserts(spark, d):
    """Each part inserts the parts of twice and of thrice its key and one: the second turned half round and moved."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("container"))
    twice = p.select("container", (F.col("container") * 2).alias("block"), F.lit(0.0).alias("x"), F.lit(0.0).alias("angle"))
    thrice = p.select("container", (F.col("container") * 3 + 1).alias("block"), F.lit(10.0).alias("x"), F.lit(3.141592653589793).alias("angle"))
    both = twice.unionByName(thrice).join(GR.shuffled(p.select(F.col("container").alias("block"))), "block", "left_semi")
    return both.select("container", "block", "x", F.lit(0.0).alias("y"), "angle", F.lit(1.0).alias("sx"), F.lit(1.0).alias("sy"))


def _roots(spark):
    return spark.range(1, 2).select(F.col("id").alias("root"))


def insert_multiplicity(spark, d):
    """How often each block is drawn below block 1, once all inserts are followed."""
    m = B.multiplicity(_inserts(spark, d), _roots(spark), 10_000)
    return m.select("block", F.col("times").cast("long").alias("times"))


def expanded_counts(spark, d):
    """Objects drawn below block 1: each block holds as many as lines of its part's key."""
    entities = paths(spark, d).select((F.col("block") % 500).alias("container"))
    return B.expanded_counts(entities, _inserts(spark, d), _roots(spark), 10_000)


def block_placements(spark, d):
    """How each block stands in the frame of block 1: as defined, in one other way, or in several."""
    p = B.placements(_inserts(spark, d), _roots(spark), 10_000)
    return p.select("block", "placements", "status", F.round("e", 4).alias("x"))


def _config(spark, d):
    n = table(spark, d, "nation")
    use = F.element_at(F.array(*[F.lit(u) for u in ("industrial", "commercial", "residential", "civic", "open space")]), (F.col("n_regionkey") + 1).cast("int"))
    return n.select(F.concat(F.lit("Brand#"), (F.col("n_nationkey") * 2 + 11).cast("string")).alias("layer"), use.alias("land_use"), F.lit("parcel").alias("role"))


def _objects(spark, d):
    p = parcels(spark, d)
    named = A.classify(p.select("kind").distinct(), "kind", RULES, {})
    return p.join(named, "kind").select("layer", "land_use", (F.col("size_code") % 10 != 0).alias("closed"), "area")


def config_problems(spark, d):
    return L.problems(_config(spark, d), parcels(spark, d).select("layer"))


def effective_use(spark, d):
    """Uses of kinds: those with a configuration, else with a standard, else by pattern."""
    kinds = parcels(spark, d).select(F.col("kind").alias("layer")).distinct()
    config = kinds.where("layer LIKE '%TIN%'").select("layer", F.lit("open space").alias("land_use"))
    standard = kinds.where("layer LIKE '%COPPER%' OR layer LIKE '%TIN%'").select("layer", F.lit("civic").alias("land_use"))
    return L.effective_use(kinds, config, standard, RULES)


def landuse_draft(spark, d):
    return L.draft(_objects(spark, d), _config(spark, d), 0.25)


def draft_accepted(spark, d):
    return L.accepted(landuse_draft(spark, d))


def landuse_residual(spark, d):
    """Kinds that no pattern classifies, and the uses that their words speak for."""
    kinds = parcels(spark, d).select(F.col("kind").alias("layer")).distinct()
    none = kinds.select("layer", F.lit(None).cast("string").alias("land_use")).limit(0)
    return L.residual(kinds, L.effective_use(kinds, none, none, RULES), VOCABULARY)


def landuse_availability(spark, d):
    return L.availability(_objects(spark, d), _config(spark, d))


_CONFIG = """c AS (SELECT 'Brand#' || CAST(n_nationkey * 2 + 11 AS VARCHAR) AS layer, ['industrial', 'commercial', 'residential', 'civic', 'open space'][n_regionkey + 1] AS land_use FROM nation)"""
_PATTERN = "CASE " + " ".join(f"WHEN contains(lower({{c}}), '{w}') THEN '{u}'" for w, u in RULES) + " END"
_WAYS = """i AS (SELECT p_partkey AS a, p_partkey * 2 AS b, 0 AS turned FROM part UNION ALL SELECT p_partkey, p_partkey * 3 + 1, 1 FROM part),
w AS (SELECT CAST(1 AS BIGINT) AS block, 1e0 AS s, 0e0 AS x, 0 AS level UNION ALL
  SELECT i.b, CASE WHEN turned = 1 THEN -s ELSE s END, x + CASE WHEN turned = 1 THEN 10 * s ELSE 0 END, level + 1 FROM w JOIN i ON i.a = w.block WHERE i.b IN (SELECT p_partkey FROM part))"""
_DRAFT = f"""o AS (SELECT layer, {_PATTERN.format(c='kind')} AS land_use, size_code % 10 <> 0 AS closed, area FROM parcels), {_CONFIG},
b AS (SELECT layer, land_use, n FROM (SELECT *, row_number() OVER (PARTITION BY layer ORDER BY n DESC, land_use) AS rn FROM (SELECT layer, land_use, count(*) AS n FROM o WHERE land_use IS NOT NULL GROUP BY 1, 2)) WHERE rn = 1),
t AS (SELECT layer, count(*) AS objects, count(CASE WHEN closed THEN 1 END) AS closed, round(sum(area), 4) AS area FROM o GROUP BY layer),
draft AS (SELECT t.layer, objects, b.land_use, round(b.n / objects, 6) AS share, CASE WHEN closed = objects THEN 'parcel' WHEN closed = 0 THEN 'network' ELSE 'mixed' END AS role, area,
  CASE WHEN c.land_use = b.land_use THEN 'configured' WHEN c.land_use IS NOT NULL THEN 'conflict' WHEN b.n >= 0.25e0 * objects THEN 'ready' ELSE 'unclear' END AS status
  FROM t LEFT JOIN b ON b.layer = t.layer LEFT JOIN c ON c.layer = t.layer)"""

SQL = {
    "insert_multiplicity": f"WITH RECURSIVE {_WAYS} SELECT block, count(*) AS times FROM w GROUP BY block",
    "expanded_counts": f"{E.replace('WITH ', 'WITH RECURSIVE ', 1)}, {_WAYS} SELECT CAST(1 AS BIGINT) AS root, count(*) AS entities FROM w JOIN paths p ON p.block % 500 = w.block",
    "block_placements": f"""WITH RECURSIVE {_WAYS}, q AS (SELECT DISTINCT block, s, x FROM w WHERE level > 0)
        SELECT block, count(*) AS placements, CASE WHEN bool_and(s = 1 AND x = 0) THEN 'identity' WHEN count(*) = 1 THEN 'placed' ELSE 'ambiguous' END AS status, CASE WHEN count(*) = 1 THEN round(max(x), 4) END AS x FROM q GROUP BY block""",
    "config_problems": f"{E}, {_CONFIG} SELECT layer, 'absent' AS problem, NULL AS meant FROM c WHERE layer NOT IN (SELECT layer FROM parcels)",
    "effective_use": f"""{E}, k AS (SELECT DISTINCT kind FROM parcels) SELECT kind AS layer,
        CASE WHEN contains(kind, 'TIN') THEN 'open space' WHEN contains(kind, 'COPPER') THEN 'civic' ELSE {_PATTERN.format(c='kind')} END AS land_use,
        CASE WHEN contains(kind, 'TIN') THEN 'config' WHEN contains(kind, 'COPPER') THEN 'standard' WHEN {_PATTERN.format(c='kind')} IS NOT NULL THEN 'pattern' END AS basis FROM k""",
    "landuse_draft": f"{E}, {_DRAFT} SELECT * FROM draft",
    "draft_accepted": f"{E}, {_DRAFT} SELECT layer, land_use, role FROM draft WHERE status = 'ready'",
    "landuse_residual": f"""{E}, v(land_use, word) AS (VALUES {', '.join(f"('{u}', '{w}')" for u, ws in VOCABULARY.items() for w in ws)}),
        k AS (SELECT DISTINCT kind, unnest(string_split(lower(kind), ' ')) AS word FROM parcels WHERE {_PATTERN.format(c='kind')} IS NULL)
        SELECT DISTINCT kind AS layer, v.land_use, v.word FROM k JOIN v ON k.word = v.word""",
    "landuse_availability": f"""{E}, {_CONFIG}, l AS (SELECT p.layer, count(*) AS n, bool_or(c.layer IS NOT NULL) AS yes FROM parcels p LEFT JOIN c ON c.layer = p.layer GROUP BY p.layer)
        SELECT count(CASE WHEN yes THEN 1 END) AS configured, count(*) AS layers, round(coalesce(sum(CASE WHEN yes THEN n END), 0) / sum(n), 6) AS share, count(CASE WHEN yes THEN 1 END) > 0 AS meaningful FROM l""",
}
QUERIES = {name: globals()[name] for name in SQL}
