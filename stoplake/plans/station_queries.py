"""Queries of metro stations: platforms, concourses, exits and their document."""

from __future__ import annotations

from pyspark.sql import functions as F

from stoplake.operators import stations as ops
from stoplake.plans import bridge
from stoplake.plans.registry import query

#: Forty stations on a grid of 600 m; five straight tracks with a vertex each 30 m pass 3 m beside them.
SQL = """WITH st AS (SELECT s_nationkey AS rel_id, (['A', 'B', 'C'])[s_nationkey % 3 + 1] AS ref, s_suppkey AS seq, s_suppkey % 40 AS k FROM supplier),
stops AS (SELECT *, CASE WHEN k = 7 THEN 'Jonio' ELSE 'Stop ' || k END AS name, CASE WHEN k = 7 THEN 'jonio' ELSE 'stop-' || k END AS station, 600 * (k % 8) + 30 * (seq % 3) AS x, 600 * (k // 8) AS y FROM st),
rels AS (SELECT rel_id, arg_max(name, seq) AS terminus, CASE WHEN any_value(ref) = 'B' AND bool_or(k = 7) THEN 'B1' ELSE any_value(ref) END AS line FROM stops GROUP BY rel_id),
ends AS (SELECT p_partkey % 5 AS track, max(p_partkey // 5) AS last FROM part GROUP BY 1),
strips AS (SELECT s.*, greatest(0, least(x // 30, last) - 2) AS lo, least(last, least(x // 30, last) + 2) AS hi FROM stops s JOIN ends ON track = k // 8),
pf AS (SELECT station, rel_id, seq, line, CASE line WHEN 'A' THEN '#E27439' WHEN 'C' THEN '#008456' ELSE '#0570B5' END AS color, 'dir. ' || terminus AS name, 2 * (hi - lo + 1) + 1 AS n_points,
  round((12.5 + 30 * lo / 82800.0) * 1e7) / 1e7 AS lon, round((41.9 + (y + 3 + 1.2) / 111320.0) * 1e7) / 1e7 AS lat FROM strips JOIN rels USING (rel_id)),
en AS (SELECT c_custkey AS exit_id, 'Exit ' || c_custkey AS name, c_custkey % 50 AS k FROM customer),
ex AS (SELECT exit_id, name, CASE WHEN k = 7 THEN 'jonio' ELSE 'stop-' || k END AS station FROM en WHERE k < 40 AND k IN (SELECT k FROM stops))"""


def parts(spark, d):
    s, p, c = (bridge.table(spark, d, t) for t in ("supplier", "part", "customer"))
    number = lambda x: x.cast("double")
    sk, pk, ck = F.col("s_suppkey"), F.col("p_partkey"), F.col("c_custkey")
    k = sk % 40
    stops = s.select(
        F.col("s_nationkey").alias("rel_id"), F.get(F.array(*map(F.lit, "ABC")), (F.col("s_nationkey") % 3).cast("int")).alias("line"), sk.alias("seq"), F.when(k == 7, "Jonio").otherwise(F.concat(F.lit("Stop "), k.cast("string"))).alias("name"),
        number(600 * (k % 8) + 30 * (sk % 3)).alias("x"), number(600 * F.floor(k / 8)).alias("y"),
    )
    tracks = p.select((pk % 5).alias("track"), F.floor(pk / 5).alias("pos"), number(30 * F.floor(pk / 5)).alias("x"), number(600 * (pk % 5) + 3).alias("y"))
    at = ck % 50
    far = F.when(at < 40, 0).otherwise(1_000_000)
    entrances = c.select(ck.alias("exit_id"), F.concat(F.lit("Exit "), ck.cast("string")).alias("name"), number(600 * (at % 8) + 10 * (ck % 7) + far).alias("x"), number(600 * F.floor(at / 8) + 20 - 3 * (ck % 11)).alias("y"))
    return stops, tracks, entrances


def _property(name):
    return F.get_json_object("feature", f"$.properties.{name}").alias(name)


@query("join_station_platforms", f"{SQL} SELECT rel_id, seq, station, n_points, lon, lat FROM pf")
def platforms(spark, d):
    from stoplake.functions.geo import from_metres
    from stoplake.functions.text import slug

    stops, tracks, _ = parts(spark, d)
    found = ops.platforms(stops.withColumn("stop", F.struct("rel_id", "seq")), tracks)
    lon, lat = from_metres(F.col("ring")[0]["x"], F.col("ring")[0]["y"])
    return found.select("rel_id", "seq", slug(F.col("name")).alias("station"), F.size("ring").cast("long").alias("n_points"), lon.alias("lon"), lat.alias("lat"))


@query(
    "set_station_features",
    f"""{SQL} SELECT 'concourse' AS kind, station, NULL AS rel_id, NULL AS seq, NULL AS exit_id, NULL AS line, NULL AS color, NULL AS name FROM pf GROUP BY station
UNION ALL SELECT 'platform', station, rel_id, seq, NULL, line, color, name FROM pf UNION ALL SELECT 'exit', station, NULL, NULL, exit_id, NULL, NULL, name FROM ex""",
)
def station_features(spark, d):
    return ops.features(*parts(spark, d)).select(_property("kind"), "station", "rel_id", "seq", "exit_id", _property("line"), _property("color"), _property("name"))


@query("agg_station_features", f"{SQL} SELECT layer, n, first FROM (SELECT 0 AS layer, count(DISTINCT station) AS n, min(station) AS first FROM pf UNION ALL SELECT 1, count(*), min(station) FROM pf UNION ALL SELECT 2, count(*), min(station) FROM ex)")
def layers(spark, d):
    """Rows of each layer, with the first station of each in the document's order."""
    placed = ops.features(*parts(spark, d))
    return placed.groupBy("layer").agg(F.count(F.lit(1)).alias("n"), F.min("station").alias("first"))
