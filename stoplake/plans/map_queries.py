"""Queries of map extracts, which are written to files and read back in ranges."""

from __future__ import annotations

from pyspark.sql import functions as F

from stoplake.operators import extract as ops
from stoplake.plans import bridge
from stoplake.plans.registry import query
from stoplake.sources import osm_pbf
from stoplake.sources.storage import fresh_folder

SQL = """WITH nd AS (SELECT p_partkey AS id, 100 * (125000000 + 7 * p_partkey) / 1e9::DOUBLE AS lon, 100 * (419000000 - 3 * p_partkey) / 1e9::DOUBLE AS lat,
  CASE WHEN p_partkey % 10 IN (1, 2) THEN p_name END AS name, CASE WHEN p_partkey % 10 IN (0, 2) THEN 'subway_entrance' END AS railway, CASE WHEN p_partkey % 20 = 0 THEN p_size::VARCHAR END AS ref FROM part),
wy AS (SELECT l_orderkey AS id, list(l_partkey ORDER BY l_linenumber, l_partkey) AS refs, CASE WHEN l_orderkey % 5 = 0 THEN 'subway' ELSE 'rail' END AS railway FROM lineitem GROUP BY l_orderkey),
rl AS (SELECT s_suppkey AS id, CASE WHEN s_suppkey % 2 = 0 THEN 'subway' ELSE 'train' END AS route, (['A', 'B', 'C', 'FL1', 'FL2'])[s_nationkey % 5 + 1] AS ref FROM supplier),
mb AS (SELECT s_suppkey AS id, unnest([{'seq': 0, 'kind': 'way', 'ref': s_suppkey, 'role': ''}, {'seq': 1, 'kind': 'way', 'ref': 3 * s_suppkey, 'role': ''}, {'seq': 2, 'kind': 'way', 'ref': s_suppkey + 5, 'role': 'platform'},
  {'seq': 3, 'kind': 'node', 'ref': s_suppkey, 'role': 'stop'}, {'seq': 4, 'kind': 'node', 'ref': s_suppkey + 1, 'role': 'stop_exit_only'}, {'seq': 5, 'kind': 'node', 'ref': s_suppkey, 'role': 'platform'}, {'seq': 6, 'kind': 'relation', 'ref': -s_nationkey, 'role': ''}]) AS m FROM supplier)"""


def elements(spark, d):
    """Parts are nodes, orders with their line items ways, suppliers relations."""
    part, order, supplier = F.col("p_partkey"), F.col("l_orderkey"), F.col("s_suppkey")
    tags = lambda *kv: F.map_filter(F.create_map(*kv), lambda _, v: v.isNotNull())
    none = lambda kind: F.lit(None).cast(kind)
    entrance = F.when((part % 10).isin(0, 2), "subway_entrance")
    nodes = bridge.table(spark, d, "part").select(
        F.lit("node").alias("kind"), part.cast("long").alias("id"), ((F.lit(125000000) + 7 * part) / F.lit(1e7)).alias("lon"), ((F.lit(419000000) - 3 * part) / F.lit(1e7)).alias("lat"),
        tags(F.lit("name"), F.when((part % 10).isin(1, 2), F.col("p_name")), F.lit("railway"), entrance, F.lit("ref"), F.when(part % 20 == 0, F.col("p_size").cast("string"))).alias("tags"),
        none("array<long>").alias("refs"), none("array<struct<kind: string, ref: long, role: string>>").alias("members"),
    )
    refs = F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: x["l_partkey"].cast("long"))
    ways = bridge.table(spark, d, "lineitem").groupBy(order).agg(refs.alias("refs"))
    ways = ways.select(F.lit("way").alias("kind"), order.cast("long").alias("id"), none("double").alias("lon"), none("double").alias("lat"), tags(F.lit("railway"), F.when(order % 5 == 0, "subway").otherwise("rail")).alias("tags"), "refs", none("array<struct<kind: string, ref: long, role: string>>").alias("members"))
    one = lambda kind, ref, role: F.struct(F.lit(kind).alias("kind"), ref.cast("long").alias("ref"), F.lit(role).alias("role"))
    of = F.array(one("way", supplier, ""), one("way", 3 * supplier, ""), one("way", supplier + 5, "platform"), one("node", supplier, "stop"), one("node", supplier + 1, "stop_exit_only"), one("node", supplier, "platform"), one("relation", -F.col("s_nationkey"), ""))
    number = F.get(F.array(*map(F.lit, ("A", "B", "C", "FL1", "FL2"))), (F.col("s_nationkey") % 5).cast("int"))
    relations = bridge.table(spark, d, "supplier").select(
        F.lit("relation").alias("kind"), supplier.cast("long").alias("id"), none("double").alias("lon"), none("double").alias("lat"),
        tags(F.lit("type"), F.lit("route"), F.lit("route"), F.when(supplier % 2 == 0, "subway").otherwise("train"), F.lit("ref"), number).alias("tags"), none("array<long>").alias("refs"), of.alias("members"),
    )
    return nodes.unionByName(ways).unionByName(relations)


def read_back(spark, d, kinds=osm_pbf.KINDS):
    """The elements, written as extract files and read in ranges of 64 KiB."""
    folder = fresh_folder(spark, "extract")
    osm_pbf.write(elements(spark, d), folder)
    return osm_pbf.read(spark, folder, kinds, range_bytes=64 << 10)


def decoded(spark, d, kinds=osm_pbf.KINDS):
    """read_back() as a table, decoded once for queries that scan it several times."""
    folder = fresh_folder(spark, "decoded")
    read_back(spark, d, kinds).write.partitionBy("kind").parquet(folder)
    return spark.read.schema(osm_pbf.SCHEMA).parquet(folder)


@query(
    "scan_map_elements",
    f"""{SQL} SELECT 'node' AS kind, id, lon, lat, name, railway, '' AS refs, '' AS members FROM nd
UNION ALL SELECT 'way', id, NULL, NULL, NULL, railway, array_to_string(refs, ' '), '' FROM wy
UNION ALL SELECT 'relation', id, NULL, NULL, NULL, NULL, '', string_agg(m.kind || m.ref || m.role, ' ' ORDER BY m.seq) FROM mb GROUP BY id""",
)
def all_elements(spark, d):
    tag = lambda n: F.try_element_at("tags", F.lit(n)).alias(n)
    members = F.array_join(F.transform(F.coalesce("members", F.array()), lambda m: F.concat(m["kind"], m["ref"].cast("string"), m["role"])), " ")
    return read_back(spark, d).select("kind", "id", "lon", "lat", tag("name"), tag("railway"), F.array_join(F.coalesce("refs", F.array()), " ").alias("refs"), members.alias("members"))


@query("scan_subway_entrances", f"{SQL} SELECT id AS node_id, coalesce(name, 'Uscita ' || ref, 'Uscita') AS name, lon, lat FROM nd WHERE railway = 'subway_entrance'")
def entrances(spark, d):
    return ops.entrances(read_back(spark, d, ("node",)))


@query("scan_subway_tracks", f"{SQL} SELECT id AS way_id, array_to_string(refs, ' ') AS refs FROM wy WHERE railway = 'subway'")
def tracks(spark, d):
    return ops.track_ways(read_back(spark, d, ("way",))).select("way_id", F.array_join("refs", " ").alias("refs"))


@query(
    "join_metro_stop_nodes",
    f"""{SQL} SELECT mb.id AS rel_id, rl.ref AS line, m.seq AS seq, m.ref AS node_id, coalesce(nd.name, '') AS name, nd.lon, nd.lat FROM mb JOIN rl USING (id) JOIN nd ON m.ref = nd.id
WHERE m.kind = 'node' AND starts_with(m.role, 'stop') AND rl.route = 'subway' AND rl.ref IN ('A', 'B', 'C')""",
)
def metro_stops(spark, d):
    e = decoded(spark, d, ("node", "relation"))
    stops = ops.metro_stops(e)
    return stops.join(ops.stop_nodes(e, stops), "node_id").select("rel_id", "line", "seq", "node_id", "name", "lon", "lat")


@query(
    "join_rail_members",
    f"""{SQL}, kept AS (SELECT id, ref AS branch, dense_rank() OVER (PARTITION BY ref ORDER BY id) AS place FROM rl WHERE route = 'train' AND starts_with(ref, 'FL'))
SELECT branch, (place * 1000000 + m.seq)::INT AS seq, m.ref AS way_id, len(refs) AS n_points, (SELECT nd.lon FROM nd WHERE nd.id = refs[1]) AS first_lon
FROM kept JOIN mb USING (id) JOIN wy ON m.ref = wy.id WHERE m.kind = 'way' AND m.role <> 'platform'""",
)
def rail_members(spark, d):
    e = decoded(spark, d)
    branches = ops.route_relations(e).filter(F.col("ref").startswith("FL")).select("rel_id", F.col("ref").alias("branch"))
    return ops.rail_members(e, branches).select("branch", "seq", "way_id", F.size("lons").cast("long").alias("n_points"), F.get("lons", F.lit(0)).alias("first_lon"))
