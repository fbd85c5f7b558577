"""File sources: timetables, plans, forecasts, places, regions. All schemas are explicit."""

from __future__ import annotations

import tomllib
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stoplake.functions.keys import parse_tier1_key, split_stop_key

POI = "id string, name string, category string, address string, city string, brand_wikidata string, lon double, lat double"
EVENT = "route_id string, direction_id int, stop_id string, service_date string, delay_s int, feed_hour int"
STOP_ID = "struct<gtfsId: string>"
PLAN = f"""struct<data: struct<plan: struct<itineraries: array<struct<duration: double, legs: array<struct<transitLeg: boolean, mode: string, duration: double, distance: double,
  startTime: double, endTime: double, realTime: boolean, route: {STOP_ID}, trip: struct<directionId: int>, `from`: struct<lat: double, lon: double, stop: {STOP_ID}>>>>>>>>"""
HOURLY = "struct<time: array<string>, temperature_2m: array<double>, apparent_temperature: array<double>, precipitation: array<double>, uv_index: array<double>, wind_speed_10m: array<double>>"


def read_pois(spark: SparkSession, path: str) -> DataFrame:
    """POI lines; malformed ones are skipped."""
    return spark.read.schema(POI).option("mode", "DROPMALFORMED").json(path)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Event lines; malformed ones are skipped, a missing hour is noon."""
    return spark.read.schema(EVENT).option("mode", "DROPMALFORMED").json(path).withColumn("feed_hour", F.coalesce("feed_hour", F.lit(12)))


def legs_of_plans(plans: DataFrame) -> DataFrame:
    """Legs of plan documents (A22). plans: plan_id, body. A body that is no plan gives no rows."""
    p = plans.select("plan_id", F.from_json("body", PLAN).alias("p"))
    i = p.select("plan_id", F.posexplode("p.data.plan.itineraries").alias("itin_idx", "i"))
    g = i.select("plan_id", "itin_idx", F.posexplode("i.legs").alias("leg_idx", "g"))
    at = lambda c: F.col(f"g.{c}")
    return g.select(
        "plan_id", "itin_idx", "leg_idx", at("mode").alias("mode"), at("distance").alias("distance_m"), at("duration").alias("duration_s"), at("startTime").alias("start_ms"), at("endTime").alias("end_ms"),
        at("realTime").alias("real_time"), at("transitLeg").alias("transit_leg"), at("route.gtfsId").alias("route_id"), at("trip.directionId").alias("direction_id"), at("from.stop.gtfsId").alias("stop_id"), at("from.lat").alias("lat"), at("from.lon").alias("lon"),
    )


def forecast_cells(bodies: DataFrame) -> DataFrame:
    """Hourly rows of forecast documents by cell (A23, A24, D20). bodies: q_lats, q_lons (arrays), body.

    A body is one object, or an array that runs parallel to the cells. An hour without a temperature is no
    forecast; missing rain is none; short arrays are tolerated.
    """
    one = F.from_json("body", f"struct<hourly: {HOURLY}>")
    several = F.from_json("body", f"array<struct<hourly: {HOURLY}>>")
    rows = bodies.select("q_lats", "q_lons", F.when(F.ltrim("body").startswith("["), several).otherwise(F.array(one)).alias("b"))
    cells = rows.select("q_lats", "q_lons", F.posexplode("b").alias("k", "f"))
    cells = cells.select(F.get("q_lats", F.col("k")).alias("q_lat"), F.get("q_lons", F.col("k")).alias("q_lon"), F.col("f.hourly").alias("h")).filter("q_lat IS NOT NULL")
    hours = cells.select("q_lat", "q_lon", "h", F.posexplode("h.time").alias("i", "t"))
    at = lambda c: F.get(F.col(f"h.{c}"), F.col("i"))
    out = hours.select(
        "q_lat", "q_lon", F.substring("t", 12, 2).try_cast("int").alias("utc_hour"), F.substring("t", 1, 10).alias("utc_date"), at("temperature_2m").alias("air_c"),
        at("apparent_temperature").alias("felt_c"), F.coalesce(at("precipitation"), F.lit(0.0)).alias("precip_mm"), at("uv_index").alias("uv"), at("wind_speed_10m").alias("wind_kmh"),
    )
    return out.filter("air_c IS NOT NULL AND utc_hour IS NOT NULL")


def read_gtfs_routes(spark: SparkSession, zip_path: str) -> DataFrame:
    """Tram and metro routes of a feed archive with a short name; the last row of a short name wins."""
    import csv
    import io

    schema = "short_name string, route_id string, route_type string, color string"
    try:
        with zipfile.ZipFile(zip_path) as z:
            rows = list(csv.DictReader(io.TextIOWrapper(z.open("routes.txt"), "utf-8-sig")))
    except (OSError, KeyError, zipfile.BadZipFile):
        rows = []
    last = {r["route_short_name"]: (r["route_short_name"], r["route_id"], r.get("route_type"), r.get("route_color") or "") for r in rows if r.get("route_type") in ("0", "1") and r.get("route_short_name")}
    return spark.createDataFrame(list(last.values()), schema)


def read_region(directory: str, target: str) -> list[dict]:
    """Profiles from the root to the target, one file for each path segment."""
    at, out = Path(directory), []
    for level, segment in enumerate(target.split("/")):
        at = at / segment
        with (at / "region.toml").open("rb") as f:
            out.append({"level": level, "path": "/".join(target.split("/")[: level + 1]), **tomllib.load(f)})
    return out


BINS = 13
TIER = "map<string, struct<count: long, sum_delay: long, sum_delay_sq: decimal(38,0), min: int, max: int, on_time_count: long, hist: struct<bins: array<long>>>>"
#: Fixed value: a stored Tier-2 map beyond this is taken as damaged.
TIER2_MAX_BYTES = 16 * 1024 * 1024


def tier_map(files: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """Aggregates by key of JSON maps in a binaryFile DataFrame (A17-A19); one that cannot be read, or is larger than max_bytes, is empty."""
    sound = files if max_bytes is None else files.filter(F.col("length") <= max_bytes)
    rows = sound.select(F.explode(F.from_json(F.decode("content", "UTF-8"), TIER)).alias("key", "a"))
    a = lambda c: F.col(f"a.{c}")
    bins = [F.coalesce(F.get(a("hist.bins"), F.lit(i)), F.lit(0)).cast("long").alias(f"b{i}") for i in range(BINS)]
    return rows.select("key", a("count").alias("n"), a("sum_delay").alias("sum_delay"), a("sum_delay_sq").alias("sum_delay_sq"), a("min").alias("min_delay"), a("max").alias("max_delay"), a("on_time_count").alias("on_time_count"), *bins)


def read_tier1(spark: SparkSession, path: str) -> DataFrame:
    """Tier-1 rows of stored JSON maps (A17, A19); keys that are none are left out, and a missing path gives no rows."""
    rows = tier_map(_binary(spark, path)).withColumn("k", parse_tier1_key(F.col("key"))).filter("k IS NOT NULL")
    return rows.select("k.*", *[c for c in rows.columns if c not in ("key", "k")])


def read_tier2(spark: SparkSession, path: str, max_bytes: int = TIER2_MAX_BYTES) -> DataFrame:
    """Tier-2 rows of a stored JSON map (A18, A19); bounded, and as forgiving as read_tier1()."""
    rows = tier_map(_binary(spark, path), max_bytes).withColumn("k", split_stop_key(F.col("key"))).filter("k IS NOT NULL")
    part = lambda i: F.get(F.split("key", "/"), i)
    return rows.select("k.*", part(3).alias("tod"), part(4).alias("day_type"), *[c for c in rows.columns if c not in ("key", "k")])


def _binary(spark: SparkSession, path: str) -> DataFrame:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(where)
    if not there:
        return spark.createDataFrame([], "path string, length long, content binary")
    return spark.read.format("binaryFile").load(path)


def artifacts(spark: SparkSession, path: str) -> DataFrame:
    """path, size and built_at (ISO, UTC) of the files under a path (A28, A30, A31); contents are not read."""
    utc = F.date_format(F.to_utc_timestamp("modificationTime", F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("size"), utc.alias("built_at"))


def boards(docs: DataFrame, kind: str) -> DataFrame:
    """Entries of live boards (C19). docs: station, body (a JSON array); kind: departures or arrivals."""
    way = "Partenza" if kind == "departures" else "Arrivo"
    names = ["compNumeroTreno", "categoria", "destinazione", "origine", f"compOrario{way}", f"binarioEffettivo{way}Descrizione", f"binarioProgrammato{way}Descrizione"]
    schema = f"array<struct<{', '.join(f'{n}: string' for n in names)}, ritardo: long>>"
    e = docs.select("station", F.posexplode(F.from_json("body", schema)).alias("pos", "e"))
    trim = lambda n: F.regexp_replace(F.col(f"e.{n}"), r"^\s+|\s+$", "")
    number = trim(names[0])
    return e.filter(F.col(f"e.{names[0]}").isNotNull()).select(
        "station", "pos", number.alias("train_number"), F.coalesce(trim("categoria"), F.substring_index(number, " ", 1)).alias("category"), (trim("origine") if kind == "arrivals" else F.lit(None).cast("string")).alias("origin"),
        F.coalesce(trim("destinazione"), F.lit("")).alias("destination"), F.coalesce(trim(names[4]), F.lit("")).alias("scheduled_time"), F.coalesce("e.ritardo", F.lit(0)).cast("int").alias("delay_minutes"), F.nullif(F.coalesce(trim(names[5]), trim(names[6])), F.lit("")).alias("platform"),
    )
