"""Scalar geometry, text values, grades and run logs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from planline.adapter import SQL_ENTITIES as E
from planline.adapter import labels, parcels, table
from planline.functions import geometry as G
from planline.operators import text as T


def shoelace_area(spark, d):
    return parcels(spark, d).select("handle", F.round(G.signed_area(F.col("ring")), 4).alias("area"))


def ring_centroid(spark, d):
    c = parcels(spark, d).select("handle", G.centroid(F.col("ring")).alias("c"))
    return c.select("handle", F.round("c.x", 4).alias("x"), F.round("c.y", 4).alias("y"))


def edge_lengths(spark, d):
    return parcels(spark, d).select("handle", F.posexplode(G.edge_lengths(F.col("ring"))).alias("edge", "length")).select(
        "handle", F.col("edge").cast("long").alias("edge"), F.round("length", 4).alias("length")
    )


def ring_perimeter(spark, d):
    return parcels(spark, d).select("handle", F.round(G.perimeter(F.col("ring")), 4).alias("perimeter"))


def turn_angles(spark, d):
    """Each parcel turns by a right angle at every corner, one whole turn in all."""
    t = parcels(spark, d).select("handle", F.explode(G.turn_angles(F.col("ring"))).alias("turn"))
    return t.groupBy("handle").agg(F.round(F.sum("turn"), 6).alias("whole"), F.round(F.max("turn"), 6).alias("widest"))


def shape_key(spark, d):
    """Parcels by their shape key: those of one key have one pair of sides."""
    p = parcels(spark, d).select("handle", "w", "h", "ring").repartition("handle")  # one small file is one task
    k = p.select("w", "h", G.shape_key(F.col("ring")).alias("key"))
    return k.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min(F.least("w", "h")).alias("short"), F.max(F.greatest("w", "h")).alias("long")).drop("key")


def place_in_ring(spark, d):
    """Corner, centre and a far point of each parcel against its ring."""
    p = parcels(spark, d)
    r = F.col("ring")
    return p.select(
        "handle",
        G.place_in_ring(F.col("x2"), F.col("y2"), r).alias("corner"),
        G.place_in_ring(F.col("cx"), F.col("cy"), r).alias("centre"),
        G.place_in_ring(F.col("maxx") + 1, F.col("cy"), r).alias("far"),
    )


def utm_to_latlon(spark, d):
    """Parcel corners moved to a zone 38 north frame, in degrees."""
    p = parcels(spark, d)
    at = G.utm_to_lat_lon(F.col("x1") + 691942.0, F.col("y1") + 2750756.0, G.utm_zone(F.lit(32638)), F.lit(False))
    return p.select("handle", at.alias("at")).select("handle", F.round("at.lat", 6).alias("lat"), F.round("at.lon", 6).alias("lon"))


def nearest_edge_distance(spark, d):
    """From each parcel's centre to its boundary."""
    return parcels(spark, d).select("handle", F.round(G.ring_distance(F.col("cx"), F.col("cy"), F.col("ring")), 4).alias("distance"))


def printed_value(spark, d):
    docs = table(spark, d, "documents").select("doc_id", T.printed_value(F.col("text")).alias("v"))
    return docs.select("doc_id", "v.value", F.coalesce("v.decimals", F.lit(-1)).alias("decimals"))


def annotation_census(spark, d):
    l = labels(spark, d).select(F.when(F.col("handle") % 3 == 0, F.concat("text", F.lit(".5 m"))).when(F.col("handle") % 7 == 0, F.col("layer")).otherwise(F.col("text")).alias("text"))
    return l.groupBy(T.text_class(F.col("text")).alias("class")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("text").alias("different"), F.sum(T.digit_count(F.col("text"))).alias("digits"))


def column_typing(spark, d):
    """Whether a column of texts is an identifier (whole numbers that never repeat and fill nine tenths of their range), a measure or text."""
    c = table(spark, d, "customer").select(F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).cast("string").alias("value")) for n in CUSTOMER_COLUMNS])).alias("cell"))
    return T.column_kinds(c.select("cell.name", "cell.value"))


def language_marks(spark, d):
    """Documents that state English or French marker words, by language label."""
    docs = table(spark, d, "documents")
    en, fr = T.says(F.col("text"), "with"), T.says(F.col("text"), "dans")
    return docs.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count_if(en).alias("english"), F.count_if(fr).alias("french"))


def content_address(spark, d):
    return table(spark, d, "pages").select("page_id", F.substring(F.sha2("html", 256), 1, 16).alias("drawing_id"))


def tag_key_codec(spark, d):
    key = F.concat_ws("|", F.col("n_name"), F.lit("layer"), F.col("n_nationkey").cast("string"))
    parts = F.split(key, r"\|")
    return table(spark, d, "nation").select(key.alias("key"), parts[0].alias("drawing"), parts[2].cast("long").alias("target"))


def measure_statement(spark, d):
    """One sentence with its denominator for each layer."""
    g = parcels(spark, d).groupBy("layer").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("size_code") > 25).alias("m"))
    return g.select("layer", F.format_string("%d of %d parcels on %s are large", "m", "n", "layer").alias("statement"))


def ingest_run_latest(spark, d):
    """The last event of each run (user) and its kind."""
    e = table(spark, d, "events")
    last = e.groupBy("user_id").agg(F.max_by(F.struct("event_id", "event_type"), F.struct("ts", "event_id")).alias("last"), F.count(F.lit(1)).alias("stages"))
    return last.select("user_id", "last.event_id", "last.event_type", "stages")


def stall_verdict(spark, d):
    """Runs silent for more than an hour at a fixed moment: the latest event of all."""
    e = table(spark, d, "events")
    now = e.agg(F.max("ts").alias("now"))
    last = e.groupBy("user_id").agg(F.max("ts").alias("ts")).crossJoin(F.broadcast(now))
    return last.agg(F.count_if(F.col("now") - F.col("ts") > F.expr("INTERVAL 1 HOUR")).alias("stalled"), F.count(F.lit(1)).alias("runs"))


def comment_dedup(spark, d):
    """One comment for each request id (user and kind): the first; requests that differ in value conflict."""
    e = table(spark, d, "events")
    g = e.groupBy("user_id", "event_type").agg(F.min("event_id").alias("kept"), F.count(F.lit(1)).alias("received"), F.countDistinct("value").alias("bodies"))
    return g.select("user_id", "event_type", "kept", "received", (F.col("bodies") > 1).alias("conflict"))


def selection_ttl(spark, d):
    """Selections alive 24 hours before the latest event."""
    e = table(spark, d, "events")
    now = e.agg(F.max("ts").alias("now"))
    alive = F.col("now") - F.col("ts") <= F.expr("INTERVAL 24 HOUR")
    return e.crossJoin(F.broadcast(now)).groupBy("event_type").agg(F.count_if(alive).alias("alive"), F.count_if(~alive).alias("expired"))


def event_properties(spark, d):
    e = table(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    return e.groupBy("event_type").agg(F.count("k").alias("n"), F.sum("k").alias("k"), F.round(F.avg("value"), 4).alias("value"))


def run_gaps(spark, d):
    """Longest silence of each run, in seconds."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, d, "events").withColumn("gap", F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lag("ts").over(w).cast("timestamp")))
    return e.groupBy("user_id").agg(F.max("gap").alias("gap_us"))


CUSTOMER_COLUMNS = ("c_name", "c_acctbal", "c_custkey", "c_nationkey")
_N = r"([+-]?[0-9]{1,3}(?:,[0-9]{3})+(?:\.[0-9]+)?|[+-]?[0-9]+(?:\.[0-9]+)?)"
_SIDES = "s(handle, k, ax, ay, qx, qy) AS (SELECT handle, 0, x1, y1, x2, y2 FROM parcels UNION ALL SELECT handle, 1, x2, y2, x3, y3 FROM parcels UNION ALL SELECT handle, 2, x3, y3, x4, y4 FROM parcels UNION ALL SELECT handle, 3, x4, y4, x1, y1 FROM parcels)"


def _utm_sql() -> str:
    n = (1 / 298.257223563) / (2 - 1 / 298.257223563)
    radius = 6378137.0 / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    beta = [n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360, n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440, 17 * n**3 / 480 - 37 * n**4 / 840, 4397 * n**4 / 161280]
    delta = [2 * n - 2 * n**2 / 3 - 2 * n**3 + 116 * n**4 / 45, 7 * n**2 / 3 - 8 * n**3 / 5 - 227 * n**4 / 45, 56 * n**3 / 15 - 136 * n**4 / 35, 4279 * n**4 / 630]
    cosh, sinh = (lambda x: f"((exp({x}) + exp(-({x}))) / 2)"), (lambda x: f"((exp({x}) - exp(-({x}))) / 2)")
    xi = "xi" + "".join(f" - {b!r} * sin({2 * j} * xi) * {cosh(f'{2 * j} * eta')}" for j, b in enumerate(beta, 1))
    eta = "eta" + "".join(f" - {b!r} * cos({2 * j} * xi) * {sinh(f'{2 * j} * eta')}" for j, b in enumerate(beta, 1))
    lat = "chi" + "".join(f" + {x!r} * sin({2 * j} * chi)" for j, x in enumerate(delta, 1))
    return f"""{E}, u AS (SELECT handle, (y1 + 2750756e0) / (0.9996e0 * {radius!r}) AS xi, (x1 + 691942e0 - 500000e0) / (0.9996e0 * {radius!r}) AS eta FROM parcels),
    v AS (SELECT handle, {xi} AS xi1, {eta} AS eta1 FROM u), w AS (SELECT handle, asin(sin(xi1) / {cosh('eta1')}) AS chi, atan2({sinh('eta1')}, cos(xi1)) AS lam FROM v)
    SELECT handle, round(degrees({lat}), 6) AS lat, round(degrees(lam) + 38 * 6 - 183, 6) AS lon FROM w"""


SQL = {
    "shoelace_area": f"{E} SELECT handle, round(w * h, 4) AS area FROM parcels",
    "ring_centroid": f"{E} SELECT handle, round(cx, 4) AS x, round(cy, 4) AS y FROM parcels",
    "edge_lengths": f"{E}, {_SIDES} SELECT handle, CAST(k AS BIGINT) AS edge, round(sqrt((qx - ax) * (qx - ax) + (qy - ay) * (qy - ay)), 4) AS length FROM s",
    "ring_perimeter": f"{E} SELECT handle, round(2 * (w + h), 4) AS perimeter FROM parcels",
    "turn_angles": f"{E} SELECT handle, round(2 * pi(), 6) AS whole, round(pi() / 2, 6) AS widest FROM parcels",
    "shape_key": f"{E} SELECT count(*) AS n, min(least(w, h)) AS short, max(greatest(w, h)) AS long FROM parcels GROUP BY least(w, h), greatest(w, h)",
    "place_in_ring": f"{E} SELECT handle, 'boundary' AS corner, 'inside' AS centre, 'outside' AS far FROM parcels",
    "utm_to_latlon": _utm_sql(),
    "nearest_edge_distance": f"{E} SELECT handle, round(least(w, h) / 2, 4) AS distance FROM parcels",
    "printed_value": f"""WITH n AS (SELECT doc_id, replace(regexp_extract(text, '{_N}', 1), ',', '') AS v FROM documents)
        SELECT doc_id, CASE WHEN v <> '' THEN CAST(v AS DOUBLE) END AS value, CASE WHEN v <> '' THEN length(regexp_extract(v, '\\.([0-9]+)$', 1)) ELSE -1 END AS decimals FROM n""",
    "annotation_census": f"""{E}, t AS (SELECT CASE WHEN handle % 3 = 0 THEN text || '.5 m' WHEN handle % 7 = 0 THEN layer ELSE text END AS text FROM labels),
        c AS (SELECT text, CASE WHEN regexp_full_match(text, '[0-9]+') THEN 'integer' WHEN regexp_full_match(text, '[0-9]+\\.5 m') THEN 'dimension' ELSE 'other' END AS class FROM t)
        SELECT class, count(*) AS n, count(DISTINCT text) AS different, CAST(sum(length(regexp_replace(text, '[^0-9]', '', 'g'))) AS BIGINT) AS digits FROM c GROUP BY class""",
    "column_typing": "WITH c AS (" + " UNION ALL ".join(f"SELECT '{n}' AS name, CAST({n} AS VARCHAR) AS value FROM customer" for n in CUSTOMER_COLUMNS) + """),
        v AS (SELECT name, value, TRY_CAST(value AS DOUBLE) AS x FROM c)
        SELECT name, count(x) AS numbers, count(value) AS n, CASE WHEN count(x) = 0 THEN 'text'
          WHEN count(x) >= 2 AND bool_and(coalesce(x = floor(x), true)) AND count(DISTINCT x) = count(x) AND count(x) / (max(x) - min(x) + 1) >= 0.9e0 THEN 'identifier' ELSE 'measure' END AS kind FROM v GROUP BY name""",
    "language_marks": """SELECT lang, count(*) AS n, count(CASE WHEN regexp_matches(lower(text), '(^|[^a-z0-9])with([^a-z0-9]|$)') THEN 1 END) AS english,
        count(CASE WHEN regexp_matches(lower(text), '(^|[^a-z0-9])dans([^a-z0-9]|$)') THEN 1 END) AS french FROM documents GROUP BY lang""",
    "content_address": "SELECT page_id, substr(sha256(html), 1, 16) AS drawing_id FROM pages",
    "tag_key_codec": "SELECT n_name || '|layer|' || CAST(n_nationkey AS VARCHAR) AS key, n_name AS drawing, CAST(n_nationkey AS BIGINT) AS target FROM nation",
    "measure_statement": f"{E} SELECT layer, CAST(count(CASE WHEN size_code > 25 THEN 1 END) AS VARCHAR) || ' of ' || CAST(count(*) AS VARCHAR) || ' parcels on ' || layer || ' are large' AS statement FROM parcels GROUP BY layer",
    "ingest_run_latest": """SELECT user_id, event_id, event_type, stages FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn, count(*) OVER (PARTITION BY user_id) AS stages FROM events) WHERE rn = 1""",
    "stall_verdict": "SELECT count(CASE WHEN (SELECT max(ts) FROM events) - last > INTERVAL 1 HOUR THEN 1 END) AS stalled, count(*) AS runs FROM (SELECT max(ts) AS last FROM events GROUP BY user_id)",
    "comment_dedup": "SELECT user_id, event_type, min(event_id) AS kept, count(*) AS received, count(DISTINCT value) > 1 AS conflict FROM events GROUP BY user_id, event_type",
    "selection_ttl": "WITH m AS (SELECT max(ts) AS now_ts FROM events) SELECT event_type, count(CASE WHEN now_ts - ts <= INTERVAL 24 HOUR THEN 1 END) AS alive, count(CASE WHEN NOT now_ts - ts <= INTERVAL 24 HOUR THEN 1 END) AS expired FROM events, m GROUP BY event_type",
    "event_properties": "SELECT event_type, count(json_extract(props, '$.k')) AS n, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS k, round(avg(value), 4) AS value FROM events GROUP BY event_type",
    "run_gaps": "SELECT user_id, max(gap) AS gap_us FROM (SELECT user_id, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events) GROUP BY user_id",
}
QUERIES = {name: globals()[name] for name in SQL}
