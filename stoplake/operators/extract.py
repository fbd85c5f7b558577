"""Map elements to the tables that line, station and shape operators work on.

An extract is decoded once and kept by the caller (a Parquet table, or persist()); each function is a filter of
it, so only the columns and kinds that it needs are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stoplake.functions.modes import METRO_COLOURS, is_rail_role
from stoplake.functions.text import exit_name


def _tag(name: str) -> F.Column:
    return F.try_element_at("tags", F.lit(name))


def _members(elements: DataFrame, kind: str) -> DataFrame:
    """rel_id, seq, ref and role of the members of a kind."""
    each = elements.filter("kind = 'relation'").select(F.col("id").alias("rel_id"), F.posexplode("members").alias("seq", "m"))
    return each.filter(F.col("m.kind") == kind).select("rel_id", "seq", F.col("m.ref").alias("ref"), F.col("m.role").alias("role"))


def route_relations(elements: DataFrame) -> DataFrame:
    """rel_id, route, ref, operator, network and name of relations with a route and a ref."""
    rows = elements.filter("kind = 'relation'").select(F.col("id").alias("rel_id"), *[_tag(c).alias(c) for c in ("route", "ref", "operator", "network", "name")])
    return rows.filter("route IS NOT NULL AND ref IS NOT NULL")


def memberships(elements: DataFrame) -> DataFrame:
    """master_id and rel_id of route masters."""
    masters = elements.filter(_tag("type") == "route_master")
    return _members(masters, "relation").select(F.col("rel_id").alias("master_id"), F.col("ref").alias("rel_id"))


def relation_ways(elements: DataFrame) -> DataFrame:
    """rel_id, seq, way_id and role of relations' ways."""
    return _members(elements, "way").withColumnRenamed("ref", "way_id")


def way_refs(elements: DataFrame) -> DataFrame:
    """way_id and refs (A06); which are needed is a join of the caller's."""
    return elements.filter("kind = 'way'").select(F.col("id").alias("way_id"), "refs")


def nodes(elements: DataFrame) -> DataFrame:
    """node_id, lon and lat."""
    return elements.filter("kind = 'node'").select(F.col("id").alias("node_id"), "lon", "lat")


def metro_stops(elements: DataFrame, lines: tuple[str, ...] = tuple(METRO_COLOURS)) -> DataFrame:
    """rel_id, line, seq and node_id of the stops of subway relations of the given lines."""
    metro = route_relations(elements).filter((F.col("route") == "subway") & F.col("ref").isin(*lines)).select("rel_id", F.col("ref").alias("line"))
    stops = _members(elements, "node").filter(F.col("role").startswith("stop"))
    return stops.join(metro, "rel_id").select("rel_id", "line", "seq", F.col("ref").alias("node_id"))


def track_ways(elements: DataFrame) -> DataFrame:
    """way_id and refs of subway tracks."""
    return way_refs(elements.filter(_tag("railway") == "subway"))


def stop_nodes(elements: DataFrame, stops: DataFrame) -> DataFrame:
    """node_id, name (empty without one), lon and lat of the nodes of metro_stops() (A10)."""
    named = elements.filter("kind = 'node'").select(F.col("id").alias("node_id"), F.coalesce(_tag("name"), F.lit("")).alias("name"), "lon", "lat")
    return named.join(stops.select("node_id").distinct(), "node_id", "left_semi")


def entrances(elements: DataFrame) -> DataFrame:
    """node_id, name, lon and lat of subway entrances."""
    held = elements.filter((F.col("kind") == "node") & (_tag("railway") == "subway_entrance"))
    return held.select(F.col("id").alias("node_id"), exit_name(_tag("name"), _tag("ref")).alias("name"), "lon", "lat")


def rail_members(elements: DataFrame, branches: DataFrame) -> DataFrame:
    """branch, seq, way_id, lons and lats of the rail ways of train relations (A11), as stitch() takes them.

    branches: rel_id, branch (of train relations, null or missing for those to leave out). Nodes that are not
    in the extract are skipped, as are ways that are not.
    """
    trains = elements.filter((F.col("kind") == "relation") & (_tag("route") == "train")).select(F.col("id").alias("rel_id"))
    kept = trains.join(branches.filter("branch IS NOT NULL"), "rel_id")
    members = relation_ways(elements).filter(is_rail_role(F.coalesce("role", F.lit("")))).join(kept, "rel_id").select("branch", "rel_id", "seq", "way_id")
    refs = way_refs(elements).join(members.select("way_id").distinct(), "way_id", "left_semi").select("way_id", F.posexplode("refs").alias("k", "node_id"))
    points = refs.join(nodes(elements), "node_id").groupBy("way_id").agg(F.sort_array(F.collect_list(F.struct("k", "lon", "lat"))).alias("p"))
    # relations of a branch follow one another by id, their ways in their own order; from the 2148th on this is beyond an int
    order = F.dense_rank().over(_by_branch()).cast("long") * 1_000_000 + F.col("seq")
    placed = members.withColumn("seq", order)
    return placed.join(points, "way_id").select("branch", "seq", "way_id", F.transform("p", lambda x: x["lon"]).alias("lons"), F.transform("p", lambda x: x["lat"]).alias("lats"))


def _by_branch():
    from pyspark.sql import Window

    return Window.partitionBy("branch").orderBy("rel_id")
