"""Rules of transit networks as a table, so that another city is another row: which relations are a network's own, its metro lines, colours,
branches, timetable keys and projection (L03, L05, L14)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stoplake.functions.geo import METRES_PER_LON, ORIGIN_LAT, ORIGIN_LON
from stoplake.functions.modes import METRO_COLOURS, OTHER_COLOUR

RULES = """owner string, metro_refs array<string>, colours map<string, string>, other_colour string, branches array<struct<ref: string, mark: string, branch: string>>, key_prefix string, route_prefix string,
feed_file string, origin_lon double, origin_lat double, metres_per_lon double"""
#: The rules of Rome's network.
ROME = (
    "ATAC", ["A", "B", "C"], METRO_COLOURS, OTHER_COLOUR, [("B", "jonio", "B1"), ("B", "conca", "B1")], "ME", "ATAC:",
    "ATAC.gtfs.zip", ORIGIN_LON, ORIGIN_LAT, METRES_PER_LON,
)
#: Draw modes that every network has.
DRAWN = ("tram", "light_rail", "rail", "regional_rail")


def rules(spark: SparkSession, *more: tuple) -> DataFrame:
    """The known networks, a row for each (L03, L14); more: rows of RULES, of which one with a known owner takes its place."""
    rows = {r[0]: r for r in (ROME, *more)}
    return spark.createDataFrame(list(rows.values()), RULES)


def owned(relations: DataFrame, table: DataFrame) -> DataFrame:
    """Relations with a ref of each network that their operator or network tag names, with its rules and their draw mode.

    relations: rel_id, route, ref, operator, network. A relation of two networks comes once for each.
    """
    named = relations.filter(F.coalesce("ref", F.lit("")) != "").withColumn("owner", F.explode(F.array_distinct(F.filter(F.array("operator", "network"), lambda x: x.isNotNull()))))
    found = named.join(table, "owner").withColumn("network", F.coalesce("network", "operator"))
    metro = (F.col("route") == "subway") & F.array_contains("metro_refs", F.col("ref"))
    return found.withColumn("kind", F.when(metro, "metro").when(F.col("route").isin(*DRAWN), F.col("route"))).filter("kind IS NOT NULL")


def colour(ref: Column) -> Column:
    """The colour of a metro line by its network's rules."""
    return F.coalesce(F.try_element_at("colours", ref), F.col("other_colour"))


def branch(ref: Column, slugs: Column) -> Column:
    """The branch that a line's stops tell, by its network's rules, else the line itself."""
    hits = F.filter("branches", lambda b: (b["ref"] == ref) & F.exists(slugs, lambda s: s.contains(b["mark"])))
    return F.coalesce(F.get(hits, F.lit(0))["branch"], ref)


def with_timetable(found: DataFrame, routes: DataFrame) -> DataFrame:
    """owned() rows with route, routable and color (D13, I60). routes: owner, short_name (one row for each), route_id, color.

    Metro and tram lines are looked up in their own network's timetable.
    """
    key = F.when(F.col("kind") == "metro", F.concat("key_prefix", "ref")).when(F.col("kind") == "tram", F.col("ref"))
    known = routes.select("owner", F.col("short_name").alias("_key"), F.col("route_id").alias("_route"), F.col("color").alias("_color"))
    out = found.withColumn("_key", key).join(known, ["owner", "_key"], "left")
    hit = F.col("_route").isNotNull()
    route = F.coalesce(F.concat("route_prefix", "_route"), F.concat(F.lit("OSM:"), "network", F.lit(":"), "ref"))
    shown = F.when(F.col("kind") == "metro", F.coalesce(F.concat(F.lit("#"), F.nullif("_color", F.lit(""))), colour(F.col("ref"))))
    return out.withColumns({"route": route, "routable": hit, "color": shown}).drop("_key", "_route", "_color")


def to_metres(lon: Column, lat: Column, metres_per_lat: float = 111_320.0) -> tuple[Column, Column]:
    """The place in the network's own projection."""
    return (lon - F.col("origin_lon")) * F.col("metres_per_lon"), (lat - F.col("origin_lat")) * F.lit(metres_per_lat)
