"""Itineraries: factors, weather exposure, ranking and delay annotation.

legs: plan_id, itin_idx, leg_idx, mode, distance_m, duration_s, start_ms, end_ms, real_time, transit_leg,
route_id, direction_id, stop_id, lat, lon. A plan is a few dozen rows; windows partition by plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stoplake.functions import weather as wx
from stoplake.functions.geo import exact_sum, rounded
from stoplake.functions.keys import local_id
from stoplake.functions.modes import PROFILES, co2_per_km, is_transit_leg, temperature_coefficient
from stoplake.sources.storage import fresh_folder, stored

PLAN, ITINERARY = ["plan_id"], ["plan_id", "itin_idx"]
NEUTRAL = 0.5
SAMPLE_POINTS = 8
CELL = ["q_lat", "q_lon", "utc_hour", "utc_date"]


def keyed(legs: DataFrame) -> DataFrame:
    """legs with is_transit and key columns, which are null for legs that have no history key."""
    transit = is_transit_leg(F.col("transit_leg"), F.col("route_id"))
    full = transit & F.col("stop_id").isNotNull()
    return legs.withColumns(
        {
            "is_transit": transit,
            "key_route": F.when(full, local_id(F.col("route_id"))),
            "key_direction": F.when(full, F.coalesce("direction_id", F.lit(0))),
            "key_stop": F.when(full, local_id(F.col("stop_id"))),
        }
    )


def with_index(legs: DataFrame, index: DataFrame, columns: list[str]) -> DataFrame:
    """Keyed legs with an index's columns, null where it has no entry.

    Which side is sent where is left to the optimizer: an index of a city is small, one of a country is not. Legs without
    a key match nothing; they are dealt out by itinerary, since all nulls would go to one task.
    """
    right = index.select(F.col("route_id").alias("_route"), F.col("direction_id").alias("_direction"), F.col("stop_id").alias("_stop"), *columns)
    elsewhere = F.concat(F.lit("\0"), *[F.col(c).cast("string") for c in ITINERARY])
    on = (F.coalesce("key_route", F.lit("\0")) == F.col("_route")) & (F.coalesce("key_direction", F.lit(-1)) == F.col("_direction")) & (F.coalesce("key_stop", elsewhere) == F.col("_stop"))
    return legs.join(right, on, "left").drop("_route", "_direction", "_stop")


def index_of_stops(index: DataFrame, stops: DataFrame, columns: list[str]) -> DataFrame:
    """The rows of an index for the stops that legs name, stored: where they are few, the legs need not be shuffled to meet them.

    stops: transit_leg, route_id, direction_id, stop_id of all legs, or of more.
    """
    keys = keyed(stops).filter("key_route IS NOT NULL").select(F.col("key_route").alias("route_id"), F.col("key_direction").alias("direction_id"), F.col("key_stop").alias("stop_id"))
    return stored(index.join(keys.distinct(), ["route_id", "direction_id", "stop_id"], "left_semi").select("route_id", "direction_id", "stop_id", *columns), "index")


def with_segments(legs: DataFrame) -> DataFrame:
    """Keyed legs with their segments: outdoor waits before them, walks and rides, with where and when they are sampled.

    precip_s and temp_s do not depend on coordinates; key is null where they are unusable.
    """
    before = F.lag("end_ms").over(Window.partitionBy(*ITINERARY).orderBy("leg_idx"))
    g = keyed(legs).withColumn("prev_end", before)
    gap = (F.col("start_ms") - F.col("prev_end")) / F.lit(1000.0)
    length = F.when(wx.finite(F.col("duration_s")) & (F.col("duration_s") >= 0), F.col("duration_s")).otherwise(F.lit(0.0))
    zero = F.lit(0.0)
    wait = F.when(wx.finite(gap) & (gap > 0), gap).otherwise(zero)
    walk = F.when(F.col("mode") == "WALK", length).otherwise(zero)
    ride = F.when((F.coalesce(F.col("mode"), F.lit("")) != "WALK") & F.col("is_transit"), length * temperature_coefficient(F.col("mode"))).otherwise(zero)

    def part(at: Column, precip: Column, temp: Column) -> Column:
        return F.struct(at.alias("at_ms"), precip.alias("precip_s"), temp.alias("temp_s"))

    parts = F.array(part(F.col("prev_end"), wait, wait), part(F.col("start_ms"), walk, walk), part(F.col("start_ms"), zero, ride))
    held = F.filter(parts, lambda p: p["temp_s"] > 0)
    # keys, whose dates are texts, are made for the segments that there are
    key = lambda p: wx.sample_key(F.col("lat"), F.col("lon"), p["at_ms"]).alias("key")
    return g.withColumn("segments", F.transform(held, lambda p: F.struct(p["at_ms"].alias("at_ms"), p["precip_s"].alias("precip_s"), p["temp_s"].alias("temp_s"), key(p))))


def segments(legs: DataFrame) -> DataFrame:
    """A row for each of with_segments()' segments."""
    rows = with_segments(legs).select(*ITINERARY, "leg_idx", F.explode("segments").alias("p"))
    return rows.select(*ITINERARY, "leg_idx", "p.at_ms", "p.precip_s", "p.temp_s", "p.key")


def exposure(legs: DataFrame) -> DataFrame:
    """Outdoor and temperature seconds of each itinerary."""
    sums = segments(legs).groupBy(*ITINERARY).agg(F.sum("precip_s").alias("precip_s"), F.sum("temp_s").alias("temp_s"))
    every = legs.select(*ITINERARY).distinct()
    return every.join(sums, ITINERARY, "left").select(*ITINERARY, *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("precip_s", "temp_s")])


def penalty(precip_s: Column, temp_s: Column, rain: Column, temp: Column) -> Column:
    return rain * precip_s / F.lit(60.0) + temp * temp_s / F.lit(60.0)


def badness_columns(forecast: DataFrame) -> DataFrame:
    """Forecast cells with rain and temp badness. forecast: the cell columns, air_c, felt_c, precip_mm, uv, wind_kmh."""
    felt = wx.felt_temperature(F.col("air_c"), F.col("felt_c"))
    return forecast.select(*CELL, wx.precip_badness(F.col("precip_mm")).alias("rain"), wx.temp_badness(felt, F.col("uv"), F.col("wind_kmh")).alias("temp"))


def penalties(legs: DataFrame, forecast: DataFrame) -> DataFrame:
    """Penalty of each itinerary that meets a forecast, each segment against its own cell."""
    s = segments(legs).select(*ITINERARY, "precip_s", "temp_s", "key.*")
    f = badness_columns(forecast)
    on = [s.q_lat == f.q_lat, s.q_lon == f.q_lon, s.utc_hour == f.utc_hour, s.utc_date.eqNullSafe(f.utc_date)]
    return s.join(f, on, "inner").groupBy(*ITINERARY).agg(exact_sum(penalty(F.col("precip_s"), F.col("temp_s"), F.col("rain"), F.col("temp"))).alias("weather_penalty"))


def weather_penalty(legs: DataFrame, forecast: DataFrame) -> DataFrame:
    """Penalty of every itinerary; no forecast adds nothing."""
    hit = penalties(legs, forecast)
    return legs.select(*ITINERARY).distinct().join(hit, ITINERARY, "left").select(*ITINERARY, F.coalesce("weather_penalty", F.lit(0.0)).alias("weather_penalty"))


def sample_points(legs: DataFrame) -> DataFrame:
    """The first cells of each plan's segments, without a date first."""
    cells = segments(legs).filter("key IS NOT NULL").select("plan_id", "key.*").distinct()
    order = Window.partitionBy("plan_id").orderBy(*[F.asc_nulls_first(c) for c in ("q_lat", "q_lon", "utc_hour", "utc_date")])
    return cells.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= SAMPLE_POINTS)


def missing_cells(wanted: DataFrame, known: DataFrame) -> DataFrame:
    """Cells that no forecast is known for."""
    w, k = wanted.select(*CELL).distinct(), known.select(*CELL)
    return w.join(k, [w[c].eqNullSafe(k[c]) for c in CELL], "left_anti")


def fetch_cells(points: DataFrame) -> DataFrame:
    """Places to ask a forecast for, in the order of their first use, and the days it must span.

    points: pos, q_lat, q_lon, utc_date.
    """
    spark = points.sparkSession
    folder = fresh_folder(spark, "cells")
    # a table of places and days, which are few: both results come from it, so that the points are read once
    points.groupBy("q_lat", "q_lon", "utc_date").agg(F.min("pos").alias("pos")).write.parquet(folder)
    days = spark.read.schema(points.select("q_lat", "q_lon", "utc_date", "pos").schema).parquet(folder)
    cells = days.groupBy("q_lat", "q_lon").agg(F.min("pos").alias("first_pos"))
    span = days.agg(F.min("utc_date").alias("first_date"), F.max("utc_date").alias("last_date"))
    return cells.crossJoin(F.broadcast(span))  # span is one row


def factors(legs: DataFrame, index: DataFrame, weather: DataFrame | None = None) -> DataFrame:
    """The five raw factors of each itinerary (E13); without penalties, or a row of them, the weather is neutral."""
    g = with_index(keyed(legs), index, ["on_time_rate"])
    km = F.col("distance_m") / F.lit(1000.0)
    walk = (F.col("mode") == "WALK") & ~F.col("is_transit")
    out = g.groupBy(*ITINERARY).agg(
        F.coalesce(exact_sum(F.col("on_time_rate"), 15) / F.nullif(F.count("on_time_rate"), F.lit(0)), F.lit(NEUTRAL)).alias("reliability"),
        F.count_if("is_transit").cast("double").alias("transfers"),
        F.sum(F.when(walk, F.coalesce("duration_s", F.lit(0.0))).otherwise(F.lit(0.0))).alias("walk_s"),
        F.sum(F.when(F.col("distance_m") > 0, co2_per_km(F.coalesce("mode", F.lit(""))) * km).otherwise(F.lit(0.0))).alias("co2_g"),
    )
    if weather is None:
        return out.withColumn("weather_penalty", F.lit(0.0))
    return out.join(weather, ITINERARY, "left").withColumn("weather_penalty", F.coalesce("weather_penalty", F.lit(0.0)))


def factors_in_weather(legs: DataFrame, index: DataFrame, forecast: DataFrame) -> DataFrame:
    """factors() with penalties(), from one shuffle of the legs by itinerary: segments stay with their leg until it is added up.

    Segments without a cell match no forecast and are dealt out by itinerary.
    """
    km = F.col("distance_m") / F.lit(1000.0)
    walk = (F.col("mode") == "WALK") & ~F.col("is_transit")
    part = F.transform("segments", lambda p: F.struct(p["precip_s"].alias("precip_s"), p["temp_s"].alias("temp_s"), *[p["key"][c].alias(c) for c in CELL]))
    # what a leg adds is worked out before it travels: the columns that it comes from stay behind
    adds = with_segments(legs).select(
        *ITINERARY, "key_route", "key_direction", "key_stop", "is_transit",
        F.when(walk, F.coalesce("duration_s", F.lit(0.0))).alias("walk_s"),
        F.when(F.col("distance_m") > 0, co2_per_km(F.coalesce("mode", F.lit(""))) * km).alias("co2_g"), part.alias("segments"),
    )
    g = with_index(adds, index, ["on_time_rate"]).select(*ITINERARY, "is_transit", "walk_s", "co2_g", "on_time_rate", F.posexplode_outer("segments").alias("k", "p"))
    first = F.coalesce("k", F.lit(0)) == 0  # each leg counts with its first segment
    of_leg = {c: F.when(first & F.col(c), True) if c == "is_transit" else F.when(first, F.col(c)) for c in ("is_transit", "walk_s", "co2_g", "on_time_rate")}
    rows = g.select(*ITINERARY, *[x.alias(c) for c, x in of_leg.items()], "p.*")
    f = stored(badness_columns(forecast), "badness").select(*[F.col(c).alias(f"_{c}") for c in CELL], "rain", "temp")
    nowhere = -F.lit(10**9) - F.pmod(F.xxhash64(*ITINERARY), F.lit(10**9))
    on = (F.coalesce("q_lat", nowhere) == F.col("_q_lat")) & (F.col("q_lon") == F.col("_q_lon")) & (F.col("utc_hour") == F.col("_utc_hour")) & F.col("utc_date").eqNullSafe(F.col("_utc_date"))
    return rows.join(f, on, "left").groupBy(*ITINERARY).agg(
        F.coalesce(exact_sum(F.col("on_time_rate"), 15) / F.nullif(F.count("on_time_rate"), F.lit(0)), F.lit(NEUTRAL)).alias("reliability"),
        F.count("is_transit").cast("double").alias("transfers"),
        F.coalesce(F.sum("walk_s"), F.lit(0.0)).alias("walk_s"),
        F.coalesce(F.sum("co2_g"), F.lit(0.0)).alias("co2_g"),
        F.coalesce(exact_sum(penalty(F.col("precip_s"), F.col("temp_s"), F.col("rain"), F.col("temp"))), F.lit(0.0)).alias("weather_penalty"),
    )


def benefit(value: str, higher_is_better: bool) -> Column:
    """Min-max within the plan; 0.5 where all are equal, and for the value itself if it is not finite."""
    plan = Window.partitionBy(*PLAN)
    v = F.when(wx.finite(F.col(value)), F.col(value)).otherwise(F.lit(NEUTRAL))
    low, high = F.min(v).over(plan), F.max(v).over(plan)
    unit = (v - low) / F.nullif(high - low, F.lit(0.0))
    return F.coalesce(unit if higher_is_better else F.lit(1.0) - unit, F.lit(NEUTRAL))


def rerank(raw: DataFrame, profile: str) -> DataFrame:
    """Itineraries with benefits, score and rank in their plan; ties keep the order they came in."""
    names = ("reliability", "transfers", "walk_s", "co2_g", "weather_penalty")
    g = raw.select(*ITINERARY, "reliability", *[benefit(c, c == "reliability").alias(f"{c}_benefit") for c in names])
    score = sum((F.lit(w) * F.col(f"{c}_benefit") for w, c in zip(PROFILES[profile][1:], names[1:])), F.lit(PROFILES[profile][0]) * F.col("reliability_benefit"))
    g = g.withColumn("score", score)
    order = Window.partitionBy(*PLAN).orderBy(F.desc("score"), "itin_idx")
    return g.select(*ITINERARY, rounded(F.col("reliability"), 4).alias("reliability_score"), rounded(F.col("score"), 4).alias("rerank_score"), F.row_number().over(order).alias("rank"))


def annotate_legs(legs: DataFrame, typical: DataFrame) -> DataFrame:
    """Transit legs without live data that have a typical delay, with it."""
    g = with_index(keyed(legs).filter(~F.coalesce("real_time", F.lit(False)) & F.col("key_route").isNotNull()), typical, ["p50_s", "p85_s", "n"])
    hit = g.filter(F.col("p85_s").isNotNull())
    return hit.select(*ITINERARY, "leg_idx", rounded(F.col("p85_s"), 1).alias("seconds"), rounded(F.col("p50_s"), 1).alias("p50_seconds"), F.col("n").alias("sample_count"), F.lit("historical").alias("source"))


def annotation_summary(annotated: DataFrame) -> DataFrame:
    """Legs and worst delay of each itinerary that has any."""
    return annotated.groupBy(*ITINERARY).agg(F.count(F.lit(1)).alias("annotated_legs"), F.max("seconds").alias("worst_seconds"))
