"""Region profiles: inheritance from root to leaf, and feed selection."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def inherited(levels: DataFrame, key: str, item: str) -> DataFrame:
    """Items of all levels of each target; the deepest of an id wins (H03). levels: target, level, ..., item."""
    deepest = F.max_by(F.struct(*[F.col(f"`{c}`") for c in levels.columns]), "level")
    return levels.groupBy(F.col(key).alias("_t"), F.col(item).alias("_i")).agg(deepest.alias("_row")).select("_row.*")


def resolved_scalars(levels: DataFrame, key: str, names: list[str]) -> DataFrame:
    """The deepest value that is not null, for each scalar."""
    deepest = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col("level"))).alias(c) for c in names]
    return levels.groupBy(key).agg(*deepest)


def ancestry(nodes: DataFrame) -> DataFrame:
    """target, path and level of each node and its parents, the root at level 0, however deep (DF11). nodes: path."""
    parts = F.split("path", "/")
    steps = F.sequence(F.lit(1), F.size(parts))
    return nodes.select(F.col("path").alias("target"), F.posexplode(F.transform(steps, lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))).alias("level", "path"))


def gtfs_feeds(feeds: DataFrame, allowed: list[str] | None = None) -> DataFrame:
    """Enabled timetable feeds, of the allowed ones if some are named."""
    out = feeds.filter(F.coalesce("enabled", F.lit(True)) & (F.coalesce("source", F.lit("gtfs")) == "gtfs"))
    return out if allowed is None else out.filter(F.col("feed_id").isin(allowed))


def realtime_url(channels: Column, channel: str) -> Column:
    """URL of the first entry of a channel."""
    return F.get(F.filter(channels, lambda c: c["channel"] == channel), F.lit(0))["url"]


def extent(override: Column, *values: Column) -> Column:
    return F.coalesce(F.nullif(override, F.lit("")), *values)


def artifact_names(target: Column, tiles: Column) -> list[Column]:
    """Country and file names of a target."""
    return [F.substring_index(target, "/", 1).alias("country"), F.concat(tiles, F.lit(".pmtiles")).alias("tiles_file"), F.concat(F.replace(target, F.lit("/"), F.lit("-")), F.lit(".osm.pbf")).alias("osm_file")]


def feed_ids(paths: Column) -> Column:
    """Feed that a path's archive holds, null if it is none."""
    return F.nullif(F.regexp_extract(paths, r"([^/]+)\.gtfs\.zip$", 1), F.lit(""))


#: Health states from best to worst.
STATES = ("ok", "degraded", "down")


def worst_status(checks: DataFrame, key: str) -> DataFrame:
    """The worst state of each group (E23); states that are not known count as down."""
    order = reduce(lambda acc, kv: acc.when(F.col("status") == kv[1], kv[0]), list(enumerate(STATES))[1:], F.when(F.col("status") == STATES[0], 0)).otherwise(2)
    return checks.groupBy(key).agg(F.max(order).alias("_o")).select(key, F.get(F.array(*map(F.lit, STATES)), F.col("_o")).alias("status"))


def validate_extract(requests: DataFrame, max_area: float = 6.0, max_zoom: int = 14) -> DataFrame:
    """Extract requests with an error code, or clamped zooms (C14). requests: id, bbox, minzoom, maxzoom."""
    p = F.transform(F.split(F.trim("bbox"), ","), lambda x: F.trim(x).try_cast("double"))
    a, b, c, d = (F.get(p, k) for k in range(4))
    unreadable = (F.size(p) != 4) | F.exists(p, lambda x: x.isNull())
    code = (
        F.when(F.coalesce(F.trim("bbox"), F.lit("")) == "", "bbox_required")
        .when(unreadable, "bbox_invalid")
        .when(~(a.between(-180, 180) & c.between(-180, 180) & b.between(-90, 90) & d.between(-90, 90)), "bbox_out_of_range")
        .when((a >= c) | (b >= d), "bbox_degenerate")
        .when((c - a) * (d - b) > max_area, "area_too_large")
    )
    top = F.least(F.coalesce("maxzoom", F.lit(max_zoom)), F.lit(max_zoom))
    return requests.select("id", code.alias("error"), F.when(code.isNull(), F.least(F.coalesce("minzoom", F.lit(0)), top)).alias("minzoom"), F.when(code.isNull(), top).alias("maxzoom"))


def request_metrics(log: DataFrame) -> DataFrame:
    """Requests by method and status."""
    return log.groupBy("method", "status").agg(F.count(F.lit(1)).alias("requests"))


#: Seconds between runs of each job.
JOBS = {"timetable": 86_400, "trip-updates": 30, "reliability-rollup": 3_600}


def jobs(feeds: DataFrame, region: str) -> DataFrame:
    """The jobs of a region's feeds: job, feed_id, url, path and every_s (L10). feeds: feed_id, enabled, source, url, channels.

    A timetable in the European format is converted (path: the feed that it becomes), a feed with a trip-updates channel is polled, and
    where any is, tiers are rolled up. region: names the map extract that shapes are taken from (path of the roll-up: none).
    """
    own = feeds.filter(F.coalesce("enabled", F.lit(True)))
    row = lambda name, feed, url, path: [F.lit(name).alias("job"), feed.alias("feed_id"), url.alias("url"), path.alias("path"), F.lit(JOBS[name]).alias("every_s")]
    none = F.lit(None).cast("string")
    convert = own.filter("source = 'netex'").select(*row("timetable", F.col("feed_id"), F.nullif("url", F.lit("")), F.concat(F.lit("graph/"), "feed_id", F.lit(f".gtfs.zip from graph/{region}.osm.pbf"))))
    live = realtime_url(F.col("channels"), "trip-updates")
    polled = own.filter(live.isNotNull()).select(*row("trip-updates", F.col("feed_id"), live, none))
    fold = polled.limit(1).select(*row("reliability-rollup", none, none, none))
    return convert.unionByName(polled).unionByName(fold)
