"""Configuration and health documents, one JSON text for each target."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stoplake.operators.regions import realtime_url

#: Updaters by realtime channel, how often they poll, and whether trips are matched loosely.
UPDATERS = (("trip-updates", "stop-time-updater", "30s", True), ("vehicle-positions", "vehicle-positions", "30s", None), ("service-alerts", "real-time-alerts", "60s", None))


def build_config(feeds: DataFrame, extracts: DataFrame) -> DataFrame:
    """Routing build document of each target (B11). feeds: target, feed_id; extracts: target, osm."""
    one = F.struct(F.lit("gtfs").alias("type"), F.col("feed_id").alias("feedId"), F.concat("feed_id", F.lit(".gtfs.zip")).alias("source"))
    by_target = feeds.groupBy("target").agg(F.transform(F.sort_array(F.collect_list(F.struct("feed_id", one.alias("o")))), lambda x: x["o"]).alias("transitFeeds"))
    none = F.array().cast("array<struct<type: string, feedId: string, source: string>>")
    doc = F.struct(F.array(F.struct(F.col("osm").alias("source"))).alias("osm"), F.coalesce("transitFeeds", none).alias("transitFeeds"))
    return extracts.join(by_target, "target", "left").select("target", F.to_json(doc).alias("value"))


def router_config(feeds: DataFrame) -> DataFrame:
    """Realtime updaters of each target's feeds, in the feeds' order (B12). feeds: target, pos, feed_id, channels (array of channel, url)."""
    each = [
        F.when(realtime_url(F.col("channels"), channel).isNotNull(), F.struct(F.lit(kind).alias("type"), F.col("feed_id").alias("feedId"), realtime_url(F.col("channels"), channel).alias("url"), F.lit(every).alias("frequency"), F.lit(fuzzy).cast("boolean").alias("fuzzyTripMatching")))
        for channel, kind, every, fuzzy in UPDATERS
    ]
    rows = feeds.select("target", F.struct("pos", F.filter(F.array(*each), lambda x: x.isNotNull()).alias("u")).alias("f"))
    merged = F.flatten(F.transform(F.sort_array(F.collect_list("f")), lambda x: x["u"]))
    return rows.groupBy("target").agg(merged.alias("updaters")).select("target", F.to_json(F.struct("updaters")).alias("value"))


def health(artifacts: DataFrame, version: str, bootstrapped_at: str | None) -> DataFrame:
    """Health document of each target: ok with tiles and a timetable, else degraded (B13, P17). artifacts: target, tiles_built_at, gtfs_loaded."""
    loaded = F.coalesce("gtfs_loaded", F.lit("unknown"))
    state = F.when(F.col("tiles_built_at").isNotNull() & (loaded != "unknown"), "ok").otherwise("degraded")
    doc = F.struct(state.alias("status"), F.lit(version).alias("version"), loaded.alias("gtfsLoaded"), F.col("tiles_built_at").alias("tilesBuiltAt"), F.lit(bootstrapped_at).cast("string").alias("bootstrappedAt"))
    return artifacts.select("target", F.to_json(doc, {"ignoreNullFields": "false"}).alias("value"))
