"""Queries of timetable conversion."""

from __future__ import annotations

from pyspark.sql import functions as F

from stoplake.operators import timetable as ops
from stoplake.plans import bridge
from stoplake.plans.registry import query

MODES = ["tram", "metro", "rail", "water", "bus"]
SQL = """WITH asg AS (SELECT 's' || (o_orderkey % 400) AS service_id, CASE WHEN o_orderkey % 17 = 0 THEN '' ELSE 'p' || o_custkey END AS period_id FROM orders),
per AS (SELECT 'p' || c_custkey AS period_id, CASE WHEN c_custkey % 19 <> 0 THEN DATE '2026-04-01' + CAST(c_custkey % 28 AS INTEGER) END AS from_date, CASE WHEN c_custkey % 23 = 0 THEN '' ELSE bin(c_custkey * 37 + 11) END AS bits FROM customer),
days AS (SELECT service_id, from_date, bits, unnest(range(0, length(bits))) AS i FROM asg JOIN per USING (period_id) WHERE service_id <> '' AND asg.period_id <> '' AND from_date IS NOT NULL AND bits <> ''),
sd AS (SELECT service_id, strftime(from_date + CAST(i AS INTEGER), '%Y%m%d') AS date FROM days WHERE substr(bits, CAST(i AS INTEGER) + 1, 1) = '1'),
ln AS (SELECT CASE WHEN s_suppkey % 6 = 0 THEN 'gone' ELSE 'l' END || s_suppkey AS line_id, 'N' || (s_suppkey % 13) AS short_name, (['tram', 'metro', 'rail', 'water', 'bus'])[s_suppkey % 5 + 1] AS mode FROM supplier),
jn AS (SELECT 'j' || o_orderkey AS journey_id, 'l' || (o_custkey % (SELECT count(*) FROM supplier)) AS line_id, 's' || (o_orderkey % 500) AS service_id, strftime(o_orderdate, '%Y-%m-%d') AS from_date, strftime(o_orderdate + INTERVAL 30 DAY, '%Y-%m-%d') AS to_date FROM orders),
tr AS (SELECT * FROM jn WHERE line_id IN (SELECT line_id FROM ln) AND service_id IN (SELECT service_id FROM sd)),
pp AS (SELECT 'j' || l_orderkey AS journey_id, 'pp' || l_partkey AS point_id, CASE WHEN l_quantity < 20 THEN '' ELSE '10:' || CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) || ':00' END AS arrival, CASE WHEN l_quantity < 5 OR l_quantity > 40 THEN NULL ELSE '11:' || CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) || ':00' END AS departure FROM lineitem),
pt AS (SELECT CASE WHEN p_partkey % 20 = 0 THEN 'gone' ELSE 'pp' END || p_partkey AS point_id, 'st' || (p_partkey % 60) AS stop_id, p_size AS seq FROM part),
st AS (SELECT CASE WHEN p_partkey % 6 = 0 THEN 'gone' ELSE 'st' END || p_partkey AS stop_id FROM part),
stt AS (SELECT journey_id AS trip_id, coalesce(nullif(arrival, ''), nullif(departure, '')) AS arrival_time, coalesce(nullif(departure, ''), nullif(arrival, '')) AS departure_time, stop_id, seq AS stop_sequence FROM pp JOIN pt USING (point_id)
  WHERE journey_id IN (SELECT journey_id FROM tr) AND stop_id IN (SELECT stop_id FROM st) AND coalesce(nullif(arrival, ''), nullif(departure, '')) IS NOT NULL)"""


def parts(spark, d):
    o, c, s, p, li = (bridge.table(spark, d, t) for t in ("orders", "customer", "supplier", "part", "lineitem"))
    text = lambda prefix, x: F.concat(F.lit(prefix), x.cast("string"))
    k, ck, sk, pk, q = F.col("o_orderkey"), F.col("c_custkey"), F.col("s_suppkey"), F.col("p_partkey"), F.col("l_quantity")
    kept = lambda prefix, x, n: F.concat(F.when(x % n == 0, "gone").otherwise(prefix), x.cast("string"))  # noqa: E731  some ids are not there
    n_lines = s.agg(F.count(F.lit(1)).alias("n_lines"))  # one row
    clock = lambda h: F.concat(F.lit(h), q.cast("int").cast("string"), F.lit(":00"))
    return {
        "assignments": o.select(text("s", k % 400).alias("service_id"), F.when(k % 17 == 0, "").otherwise(text("p", F.col("o_custkey"))).alias("period_id")),
        "periods": c.select(text("p", ck).alias("period_id"), F.when(ck % 19 != 0, F.date_add(F.lit("2026-04-01").cast("date"), (ck % 28).cast("int"))).alias("from_date"), F.when(ck % 23 == 0, "").otherwise(F.bin(ck * 37 + 11)).alias("bits")),
        "lines": s.select(kept("l", sk, 6).alias("line_id"), text("N", sk % 13).alias("short_name"), F.get(F.array(*map(F.lit, MODES)), (sk % 5).cast("int")).alias("mode")),
        "journeys": o.crossJoin(F.broadcast(n_lines)).select(text("j", k).alias("journey_id"), text("l", F.col("o_custkey") % F.col("n_lines")).alias("line_id"), text("s", k % 500).alias("service_id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("from_date"), F.date_format(F.date_add("o_orderdate", 30), "yyyy-MM-dd").alias("to_date")),
        "passing": li.select(text("j", F.col("l_orderkey")).alias("journey_id"), text("pp", F.col("l_partkey")).alias("point_id"), F.when(q < 20, "").otherwise(clock("10:")).alias("arrival"), F.when(~((q < 5) | (q > 40)), clock("11:")).alias("departure")),
        "points": p.select(kept("pp", pk, 20).alias("point_id"), text("st", pk % 60).alias("stop_id"), F.col("p_size").alias("seq")),
        "stops": p.select(kept("st", pk, 6).alias("stop_id")),
    }


def dates(spark, d):
    t = parts(spark, d)
    return ops.service_dates(t["assignments"], t["periods"])


query("join_service_dates", f"{SQL} SELECT * FROM sd")(dates)


@query("join_valid_trips", f"{SQL} SELECT journey_id, line_id, service_id FROM tr")
def trips(spark, d):
    t = parts(spark, d)
    return ops.valid_trips(t["journeys"], t["lines"], dates(spark, d)).select("journey_id", "line_id", "service_id")


@query("join_stop_times", f"{SQL} SELECT * FROM stt")
def stop_times(spark, d):
    t = parts(spark, d)
    return ops.stop_times(t["passing"], trips(spark, d), t["points"], t["stops"])


@query("join_trip_shapes", f"{SQL} SELECT journey_id, line_id, service_id, CASE WHEN CAST(regexp_extract(line_id, '[0-9]+') AS INTEGER) % 4 >= 2 THEN line_id ELSE '' END AS shape_id FROM tr")
def trip_shapes(spark, d):
    sizes = parts(spark, d)["lines"].select("line_id", (F.regexp_extract("line_id", "[0-9]+", 0).cast("int") % 4).alias("n_points"))
    return ops.with_shapes(trips(spark, d), sizes)


@query("sink_gtfs_routes", f"{SQL} SELECT line_id AS route_id, short_name, CASE mode WHEN 'tram' THEN 0 WHEN 'metro' THEN 1 WHEN 'rail' THEN 2 WHEN 'water' THEN 4 ELSE 3 END AS route_type FROM ln")
def routes(spark, d):
    return ops.routes(parts(spark, d)["lines"])


@query("agg_validity_window", f"{SQL} SELECT min(from_date) AS start_date, max(to_date) AS end_date FROM jn")
def validity(spark, d):
    return ops.validity(parts(spark, d)["journeys"])


@query("agg_feed_stats", f"{SQL} SELECT (SELECT count(*) FROM st) AS stops, (SELECT count(*) FROM ln) AS routes, (SELECT count(*) FROM tr) AS trips, (SELECT count(*) FROM stt) AS stop_times, (SELECT count(DISTINCT service_id) FROM sd) AS services")
def stats(spark, d):
    t = parts(spark, d)
    return ops.stats({"stops": t["stops"], "routes": t["lines"], "trips": trips(spark, d), "stop_times": stop_times(spark, d), "services": dates(spark, d).select("service_id").distinct()})


@query("filter_incomplete_assignments", f"{SQL} SELECT service_id, period_id FROM asg WHERE service_id <> '' AND period_id <> ''")
def assignments(spark, d):
    return ops.complete_assignments(parts(spark, d)["assignments"])
