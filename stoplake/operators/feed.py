"""A timetable document's tables to the members of a feed, end to end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stoplake.functions.calendar import date8
from stoplake.functions.keys import netex_id
from stoplake.operators import timetable as ops
from stoplake.sources import netex
from stoplake.sources.sinks import feed_archive

#: Agencies by profile: id, name, URL, time zone, language.
AGENCIES = {"italy": ("FL", "Trenitalia", "https://www.trenitalia.com", "Europe/Rome", "it")}


def tables(elements: DataFrame) -> dict[str, DataFrame]:
    """The tables that timetable operators work on, of what netex.read() gives; ids are stripped.

    Of elements with one id the last in the document counts, journeys apart, which all count.
    """
    ref = lambda c: netex_id(F.col(c))
    trim = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    of = lambda tag: elements.filter(F.col("tag") == tag)

    def last(df: DataFrame, key: str) -> DataFrame:
        rest = [c for c in df.columns if c not in (key, "ordinal")]
        return df.groupBy(key).agg(F.max_by(F.struct(*rest), "ordinal").alias("_x")).select(key, "_x.*")

    lines = of("Line").select("ordinal", ref("id").alias("line_id"), trim("short_name").alias("short_name"), trim("name").alias("long_name"), trim("mode").alias("mode"))
    stops = of("ScheduledStopPoint").select("ordinal", ref("id").alias("stop_id"), trim("name").alias("name"), "lon", "lat")
    periods = of("UicOperatingPeriod").select("ordinal", ref("id").alias("period_id"), F.try_to_date(date8(trim("from_date")), "yyyyMMdd").alias("from_date"), trim("bits").alias("bits"))
    assigned = of("DayTypeAssignment").select(ref("day_ref").alias("service_id"), F.coalesce(ref("period_ref"), F.lit("")).alias("period_id"))
    points = of("ServiceJourneyPattern").select("ordinal", F.posexplode("points").alias("pos", "p"))
    points = points.select(F.struct("ordinal", "pos").alias("ordinal"), ref("p.id").alias("point_id"), ref("p.stop_ref").alias("stop_id"), F.coalesce("p.seq", F.lit(0)).alias("seq")).filter("stop_id <> ''")
    j = of("ServiceJourney")
    journeys = j.select(
        ref("id").alias("journey_id"), F.coalesce(ref("line_ref"), F.lit("")).alias("line_id"), F.coalesce(ref("day_ref"), F.lit("")).alias("service_id"), trim("name").alias("headsign"),
        date8(trim("from_date")).alias("from_date"), date8(trim("to_date")).alias("to_date"),
    )
    passing = j.select(ref("id").alias("journey_id"), F.posexplode("times").alias("pos", "t"))
    passing = passing.select("journey_id", "pos", ref("t.point_ref").alias("point_id"), trim("t.arrival").alias("arrival"), trim("t.departure").alias("departure"))
    operator = of("Operator").select("ordinal", trim("name").alias("name"))
    days = of("DayType").select(ref("id").alias("service_id"), trim("days").alias("days"))
    return {"lines": last(lines, "line_id"), "stops": last(stops, "stop_id"), "periods": last(periods, "period_id"), "assignments": assigned, "points": last(points, "point_id"), "journeys": journeys, "passing": passing, "operator": operator, "days": days}


def members(t: dict[str, DataFrame], profile: str = "italy", shapes: DataFrame | None = None) -> dict[str, DataFrame]:
    """The members of a feed (C17, D01-D04, F10, I58). shapes: line_id, points (array of lon, lat) or None.

    Stops without coordinates are left out, but passing times may still name them. Of a document with an
    operator the agency has its name. Shapes of less than two points are none.
    """
    ident, name, url, zone, lang = AGENCIES[profile]
    spark = t["lines"].sparkSession
    own = t["operator"].filter("name <> ''").agg(F.max_by("name", "ordinal").alias("own"))
    agency = own.select(F.lit(ident).alias("agency_id"), F.coalesce("own", F.lit(name)).alias("agency_name"), F.lit(url).alias("agency_url"), F.lit(zone).alias("agency_timezone"), F.lit(lang).alias("agency_lang"))
    dates = ops.service_dates(t["assignments"], t["periods"])
    trips = ops.valid_trips(t["journeys"], t["lines"], dates)
    drawn = spark.createDataFrame([], "line_id string, points array<struct<lon: double, lat: double>>") if shapes is None else shapes.filter(F.size("points") >= 2).dropDuplicates(["line_id"])
    with_shape = ops.with_shapes(trips, drawn.select("line_id", F.size("points").alias("n_points")))
    return {
        "agency": agency,
        "stops": t["stops"].filter("lat IS NOT NULL AND lon IS NOT NULL").select("stop_id", F.col("name").alias("stop_name"), F.col("lat").alias("stop_lat"), F.col("lon").alias("stop_lon")),
        "routes": ops.routes(t["lines"]).join(t["lines"].select(F.col("line_id").alias("route_id"), F.col("long_name").alias("route_long_name")), "route_id").select("route_id", F.lit(ident).alias("agency_id"), F.col("short_name").alias("route_short_name"), "route_long_name", "route_type"),
        "calendar_dates": dates.select("service_id", "date", F.lit(1).alias("exception_type")),
        "trips": with_shape.select(F.col("line_id").alias("route_id"), "service_id", F.col("journey_id").alias("trip_id"), F.col("headsign").alias("trip_headsign"), "shape_id"),
        "stop_times": ops.stop_times(t["passing"], trips, t["points"], t["stops"]),
        "shapes": drawn.select(F.col("line_id").alias("shape_id"), F.posexplode("points").alias("shape_pt_sequence", "p")).select("shape_id", F.col("p.lat").alias("shape_pt_lat"), F.col("p.lon").alias("shape_pt_lon"), "shape_pt_sequence"),
    }


def convert(spark: SparkSession, path: str, out: str, profile: str = "italy", shapes: DataFrame | None = None) -> dict[str, int]:
    """A timetable document to a written feed; gives the rows of its members.

    The document is read once, and its elements are kept while the members are written; what is lost is read again.
    """
    elements = netex.read(spark, path).persist()
    try:
        return feed_archive(members(tables(elements), profile, shapes), out)
    finally:
        elements.unpersist()
