"""Queries of delay aggregation."""

from __future__ import annotations

from pyspark.sql import functions as F

from stoplake.functions.geo import rounded
from stoplake.operators import reliability as ops
from stoplake.plans import bridge
from stoplake.plans.bridge import quantile_sql, with_sql
from stoplake.plans.registry import query
from stoplake.sources import sinks
from stoplake.sources.storage import fresh_folder
from stoplake.streaming import ingest

TIER = with_sql("ev", "tier")
R = lambda x, k=6: f"round(({x}) * 1e{k}::DOUBLE) / 1e{k}::DOUBLE"
MOMENTS = ", ".join(ops.MOMENTS)
READ = f"n, {', '.join(f'{R(quantile_sql(q))} AS p{int(q * 100)}_s' for q in (0.5, 0.85, 0.9))}, {R('on_time_count / n')} AS on_time_rate, {R('sum_delay / n')} AS mean_s"


def events(spark, d):
    return ops.plausible(bridge.events(spark, d))


def tier1(spark, d):
    return ops.fold_tier1(events(spark, d))


def tier2(spark, d):
    return ops.rebuild_tier2(tier1(spark, d))


def steady(df):
    """Doubles to six decimals: sums in another order differ in the last bits."""
    return df.select(*[rounded(F.col(c), 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


query("filter_garbage_delay", "WITH " + bridge.SQL["ev"] + " SELECT * FROM ev WHERE abs(delay_s) <= 7200")(events)
query("agg_tier1_fold", f"{TIER} SELECT * FROM t1")(tier1)
query("agg_tier2_rebuild", f"{TIER} SELECT * FROM t2")(tier2)


@query("filter_on_time", "WITH " + bridge.SQL["ev"] + " SELECT route_id, direction_id, stop_id, service_date, delay_s, delay_s BETWEEN -60 AND 300 AS on_time FROM ev")
def on_time(spark, d):
    return bridge.events(spark, d).select("route_id", "direction_id", "stop_id", "service_date", "delay_s", ops.on_time(F.col("delay_s")).alias("on_time"))


@query(
    "agg_delay_histogram",
    "WITH " + bridge.SQL["ev"] + " SELECT route_id, bin, count(*) AS n FROM (SELECT route_id, CASE WHEN delay_s <= -300 THEN 0 WHEN delay_s <= -120 THEN 1 WHEN delay_s <= -60 THEN 2 WHEN delay_s <= 0 THEN 3"
    " WHEN delay_s <= 60 THEN 4 WHEN delay_s <= 120 THEN 5 WHEN delay_s <= 180 THEN 6 WHEN delay_s <= 300 THEN 7 WHEN delay_s <= 600 THEN 8 WHEN delay_s <= 900 THEN 9 WHEN delay_s <= 1800 THEN 10 WHEN delay_s <= 3600 THEN 11 ELSE 12 END AS bin FROM ev) GROUP BY ALL",
)
def histogram(spark, d):
    return bridge.events(spark, d).groupBy("route_id", ops.bin_of(F.col("delay_s")).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query("agg_tier1_merge", f"{TIER} SELECT route_id, service_date, {', '.join(f'min({c}) AS {c}' if c == 'min_delay' else f'max({c}) AS {c}' if c == 'max_delay' else f'CAST(sum({c}) AS DECIMAL(38,0)) AS {c}' if c == 'sum_delay_sq' else f'CAST(sum({c}) AS BIGINT) AS {c}' for c in ops.MOMENTS)} FROM t1 GROUP BY ALL")
def merged(spark, d):
    return tier1(spark, d).groupBy("route_id", "service_date").agg(*ops.merge())


@query("agg_tier2_readout", f"{TIER} SELECT route_id, direction_id, stop_id, tod, day_type, {READ} FROM t2")
def readout(spark, d):
    return steady(ops.readout(tier2(spark, d)))


@query("agg_tier2_overview", f"{TIER}, one AS (SELECT count(*) AS keys, {', '.join(f'CAST(sum({c}) AS BIGINT) AS {c}' for c in ops.MOMENTS if c not in ('min_delay', 'max_delay', 'sum_delay_sq'))} FROM t2) SELECT keys, {READ} FROM one")
def overview(spark, d):
    return steady(ops.overview(tier2(spark, d)))


@query("agg_on_time_index", f"{TIER} SELECT route_id, direction_id, stop_id, {R('sum(on_time_count) / sum(n)')} AS on_time_rate, CAST(sum(n) AS BIGINT) AS n FROM t2 GROUP BY ALL")
def on_time_index(spark, d):
    return steady(ops.on_time_index(tier2(spark, d)))


@query(
    "agg_typical_delay_index",
    f"{TIER}, c AS (SELECT route_id, direction_id, stop_id, n, {quantile_sql(0.5)} AS p50, {quantile_sql(0.85)} AS p85 FROM t2) SELECT route_id, direction_id, stop_id, {R('sum(p50 * n) / sum(n)')} AS p50_s, {R('sum(p85 * n) / sum(n)')} AS p85_s, CAST(sum(n) AS BIGINT) AS n FROM c GROUP BY ALL",
)
def typical_delay_index(spark, d):
    return steady(ops.typical_delay_index(tier2(spark, d)))


@query("join_stop_cells", f"{TIER} SELECT route_id, direction_id, stop_id, tod, day_type, {READ} FROM t2 WHERE route_id = 'view' AND direction_id = 1 AND stop_id = '7'")
def stop_cells(spark, d):
    return steady(ops.stop_cells(tier2(spark, d), "view", 1, "7"))


@query("join_point_lookup", f"{TIER} SELECT route_id, direction_id, stop_id, tod, day_type, {READ} FROM t2 WHERE route_id = 'click' AND direction_id = 0 AND stop_id = '8' AND tod = 'midday' AND day_type = 'weekday'")
def point_lookup(spark, d):
    return steady(ops.cell(tier2(spark, d), "click", 0, "8", "midday", "weekday"))


@query(
    "sink_cell_response",
    f"{TIER}, c AS (SELECT tod, day_type, {READ} FROM t2 WHERE route_id = 'view' AND direction_id = 1) SELECT tod AS \"todBucket\", day_type AS \"dayType\", n AS \"sampleCount\", {R('on_time_rate', 4)} AS \"onTimeRate\", {R('p50_s', 1)} AS \"p50S\", {R('p85_s', 1)} AS \"p85S\", {R('p90_s', 1)} AS \"p90S\", {R('mean_s', 1)} AS \"meanS\" FROM c",
)
def cell_response(spark, d):
    return ops.cell_response(steady(ops.readout(tier2(spark, d).filter("route_id = 'view' AND direction_id = 1"))))


@query("sink_events_by_date", "WITH " + bridge.SQL["ev"] + " SELECT service_date, count(*) AS n FROM ev GROUP BY ALL")
def by_date(spark, d):
    """Events written by date, one batch of them twice, as after a failure; read back, each counts once."""
    path, rows = fresh_folder(spark, "events"), bridge.events(spark, d)
    for batch, odd in (("a", False), ("b", True), ("b", True)):
        sinks.append_events(rows.filter((F.col("feed_hour") % 2 == 1) == odd), path, batch)
    return spark.read.schema(ingest.EVENTS).parquet(path).groupBy("service_date").agg(F.count(F.lit(1)).alias("n"))


@query("scan_partition_dates", "WITH " + bridge.SQL["ev"] + " SELECT DISTINCT service_date FROM ev")
def dates(spark, d):
    path = fresh_folder(spark, "events")
    sinks.append_events(bridge.events(spark, d), path)
    return sinks.partition_dates(spark, path)


@query("stream_ingest_by_date", f"{TIER} SELECT service_date, count(*) AS n, CAST(sum(delay_s) AS BIGINT) AS delay_s FROM ev WHERE abs(delay_s) <= 7200 GROUP BY ALL")
def ingested(spark, d):
    """The events table as a stream, through the ingest job into a table."""
    table, checkpoint = fresh_folder(spark, "events"), fresh_folder(spark, "checkpoint")
    raw = bridge.table(spark, d, "events")
    stream = bridge.events_of(spark.readStream.schema(raw.schema).parquet(f"{d}/events.parque*"))  # a file or a folder, which only a glob may be
    sound = F.coalesce(F.abs(F.col("delay_s")) <= ops.MAX_ABS_DELAY_S, F.lit(False))
    ingest.start_ingest(stream.withColumn("dropped", ~sound), table, checkpoint, availableNow=True).awaitTermination()
    return spark.read.schema(ingest.EVENTS).parquet(table).groupBy("service_date").agg(F.count(F.lit(1)).alias("n"), F.sum("delay_s").alias("delay_s"))


@query("sink_expired_dates", "WITH " + bridge.SQL["ev"] + " SELECT DISTINCT service_date FROM ev WHERE CAST(strptime(service_date, '%Y%m%d') AS DATE) < DATE '2024-01-20' - INTERVAL 10 DAY")
def expired(spark, d):
    return ops.expired_dates(dates(spark, d), "20240120")


@query("stream_refold_two_dates", f"{TIER} SELECT * FROM t1 WHERE service_date IN ('20240115', '20240114')")
def refold(spark, d):
    """What the hourly job folds, today and yesterday, from a stored table into a stored tier."""
    table, tier1_path = fresh_folder(spark, "events"), fresh_folder(spark, "tier1")
    sinks.append_events(bridge.events(spark, d), table)
    ingest.roll_up(spark, table, tier1_path, ["20240115", "20240114"])
    return spark.read.schema(ops.fold_tier1(events(spark, d)).schema).parquet(tier1_path)


@query(
    "filter_derive_events",
    """WITH u AS (SELECT event_id, CASE WHEN user_id % 11 <> 0 THEN event_type END AS route_id, CASE WHEN user_id % 13 <> 0 THEN strftime(ts, '%Y%m%d') END AS start_date,
  CASE WHEN user_id % 3 <> 0 THEN CAST(user_id % 2 AS INTEGER) END AS direction_id, CASE WHEN user_id % 17 <> 0 THEN CAST(user_id AS VARCHAR) END AS stop_id,
  CASE WHEN event_id % 2 = 0 THEN CAST(floor(value * 20) AS INTEGER) END AS dd, CASE WHEN event_id % 3 = 0 THEN CAST(floor(value * 10) AS INTEGER) END AS ad, CASE WHEN event_id % 5 = 0 THEN 45 END AS td FROM events)
SELECT route_id, coalesce(direction_id, 0) AS direction_id, stop_id, start_date AS service_date, coalesce(dd, ad, td) AS delay_s, 12 AS feed_hour,
  NOT (route_id IS NOT NULL AND start_date IS NOT NULL AND stop_id IS NOT NULL AND coalesce(dd, ad, td) IS NOT NULL AND coalesce(abs(coalesce(dd, ad, td)) <= 7200, false)) AS dropped FROM u""",
)
def derive(spark, d):
    e = bridge.table(spark, d, "events")
    u, k = F.col("user_id"), F.col("event_id")
    rows = e.select(
        F.when(u % 11 != 0, F.col("event_type")).alias("route_id"),
        F.when(u % 13 != 0, F.date_format("ts", "yyyyMMdd")).alias("start_date"),
        F.when(u % 3 != 0, (u % 2).cast("int")).alias("direction_id"),
        F.when(u % 17 != 0, u.cast("string")).alias("stop_id"),
        F.when(k % 2 == 0, F.floor(F.col("value") * 20).cast("int")).alias("departure_delay"),
        F.when(k % 3 == 0, F.floor(F.col("value") * 10).cast("int")).alias("arrival_delay"),
        F.when(k % 5 == 0, F.lit(45)).alias("trip_delay"),
        F.lit(None).cast("long").alias("header_ts"),
    )
    return ops.derive_events(rows).withColumn("dropped", F.coalesce("dropped", F.lit(True)))
