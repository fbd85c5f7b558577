"""Timetable conversion: calendar expansion, referential filters and the members of a feed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stoplake.functions.calendar import expand_bits
from stoplake.functions.modes import route_type


def complete_assignments(assignments: DataFrame) -> DataFrame:
    """Assignments with a service and a period."""
    return assignments.filter("service_id <> '' AND period_id <> ''")


def service_dates(assignments: DataFrame, periods: DataFrame) -> DataFrame:
    """service_id and date of each valid day; duplicates across assignments stay.

    assignments: service_id, period_id; periods: period_id, from_date (date), bits. Rows with a missing
    part are left out.
    """
    a = complete_assignments(assignments)
    p = periods.filter("from_date IS NOT NULL AND bits <> ''")
    dates = a.join(p, "period_id").select("service_id", F.explode(expand_bits(F.col("from_date"), F.col("bits"))).alias("d"))
    return dates.select("service_id", F.date_format("d", "yyyyMMdd").alias("date"))


def valid_trips(journeys: DataFrame, lines: DataFrame, dates: DataFrame) -> DataFrame:
    """Journeys of a known line and a service with dates."""
    return journeys.join(lines.select("line_id"), "line_id", "left_semi").join(dates.select("service_id").distinct(), "service_id", "left_semi")


def stop_times(passing: DataFrame, trips: DataFrame, points: DataFrame, stops: DataFrame) -> DataFrame:
    """Passing times of valid trips at known points and stops (D03); a missing time is taken from the other.

    passing: journey_id, point_id, arrival, departure; points: point_id, stop_id, seq.
    """
    t = passing.join(trips.select("journey_id"), "journey_id", "left_semi").join(points, "point_id").join(stops.select("stop_id"), "stop_id", "left_semi")
    a, d = F.nullif("arrival", F.lit("")), F.nullif("departure", F.lit(""))
    out = t.select(F.col("journey_id").alias("trip_id"), F.coalesce(a, d).alias("arrival_time"), F.coalesce(d, a).alias("departure_time"), "stop_id", F.col("seq").alias("stop_sequence"))
    return out.filter("arrival_time IS NOT NULL")


def with_shapes(trips: DataFrame, shape_sizes: DataFrame) -> DataFrame:
    """Trips with the shape of their line if it has two points at least, else an empty text."""
    known = shape_sizes.filter("n_points >= 2").select("line_id", F.col("line_id").alias("shape_id"))
    return trips.join(known, "line_id", "left").withColumn("shape_id", F.coalesce("shape_id", F.lit("")))


def routes(lines: DataFrame) -> DataFrame:
    return lines.select(F.col("line_id").alias("route_id"), "short_name", route_type(F.col("mode")).alias("route_type"))


def validity(journeys: DataFrame) -> DataFrame:
    """First and last day that any journey is valid."""
    return journeys.agg(F.min("from_date").alias("start_date"), F.max("to_date").alias("end_date"))


def stats(members: dict[str, DataFrame]) -> DataFrame:
    """Rows of each member of a feed, as one row."""
    first, *rest = [df.agg(F.count(F.lit(1)).alias(name)) for name, df in members.items()]
    for one in rest:
        first = first.crossJoin(one)  # one row each
    return first
