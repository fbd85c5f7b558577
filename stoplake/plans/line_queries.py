"""Queries of lines, regions and boards."""

from __future__ import annotations

from pyspark.sql import functions as F

from stoplake.functions import modes, text
from stoplake.functions.geo import rounded
from stoplake.operators import lines as ops
from stoplake.operators import networks, regions
from stoplake.plans import bridge
from stoplake.plans.registry import query

ROUTES = ["subway", "tram", "light_rail", "rail", "bus"]
REFS = ["A", "B", "C", "3", "8", "14", "", "19"]
SQL = """WITH rel AS (SELECT o_orderkey AS rel_id, (['subway', 'tram', 'light_rail', 'rail', 'bus'])[o_orderkey % 5 + 1] AS route, (['A', 'B', 'C', '3', '8', '14', '', '19'])[o_custkey % 8 + 1] AS ref,
  CASE WHEN o_orderkey % 3 = 0 THEN 'ATAC' WHEN o_orderkey % 3 = 1 THEN 'COTRAL' END AS operator, CASE WHEN o_orderkey % 4 = 0 THEN 'ATAC' WHEN o_orderkey % 4 = 1 THEN 'Lazio' END AS network FROM orders),
own AS (SELECT rel_id, ref, coalesce(network, operator) AS network, CASE WHEN route = 'subway' AND ref IN ('A', 'B', 'C') THEN 'metro' WHEN route IN ('tram', 'light_rail', 'rail', 'regional_rail') THEN route END AS kind FROM rel WHERE (operator = 'ATAC' OR network = 'ATAC') AND coalesce(ref, '') <> ''),
owned AS (SELECT * FROM own WHERE kind IS NOT NULL),
mem AS (SELECT c_custkey AS master_id, c_custkey * 4 % (SELECT max(o_orderkey) FROM orders) AS rel_id FROM customer),
mast AS (SELECT owned.*, master_id FROM owned LEFT JOIN (SELECT rel_id, max(master_id) AS master_id FROM mem GROUP BY rel_id) m USING (rel_id)),
rw AS (SELECT l_orderkey AS rel_id, l_partkey AS way_id, CASE WHEN l_linenumber = 7 THEN 'platform_exit' WHEN l_linenumber = 6 THEN 'stop' ELSE '' END AS role FROM lineitem),
keyed AS (SELECT *, coalesce('M' || master_id, network || '|' || kind || '|' || ref) AS line_key FROM mast),
ide AS (SELECT line_key, min({'kind': kind, 'ref': ref, 'network': network}) AS i FROM keyed GROUP BY line_key),
wy AS (SELECT DISTINCT line_key, way_id FROM keyed JOIN rw USING (rel_id) WHERE NOT starts_with(role, 'platform')),
ln AS (SELECT line_key, i.kind AS kind, i.ref AS ref, i.network AS network, n_ways FROM ide JOIN (SELECT line_key, count(*) AS n_ways FROM wy GROUP BY line_key) USING (line_key)),
gt AS (SELECT * FROM (VALUES ('MEA', 'MEA', 'E27439'), ('MEB', 'MEB', ''), ('r8', '8', '00FF00'), ('r3', '3', '')) t(route_id, short_name, color)),
tt AS (SELECT line_key, kind, ref, network, n_ways, CASE WHEN route_id IS NOT NULL THEN 'ATAC:' || route_id ELSE 'OSM:' || network || ':' || ref END AS route, route_id IS NOT NULL AS routable,
  CASE WHEN kind = 'metro' THEN coalesce('#' || nullif(color, ''), CASE WHEN ref = 'A' THEN '#E27439' WHEN ref IN ('B', 'B1') THEN '#0570B5' WHEN ref = 'C' THEN '#008456' ELSE '#666666' END) END AS color
  FROM ln LEFT JOIN gt ON CASE WHEN kind = 'metro' THEN 'ME' || ref WHEN kind = 'tram' THEN ref END = short_name)"""


def relations(spark, d):
    k = F.col("o_orderkey")
    pick = lambda names, i: F.get(F.array(*map(F.lit, names)), i.cast("int"))
    return bridge.table(spark, d, "orders").select(
        k.alias("rel_id"), pick(ROUTES, k % 5).alias("route"), pick(REFS, F.col("o_custkey") % 8).alias("ref"),
        F.when(k % 3 == 0, "ATAC").when(k % 3 == 1, "COTRAL").alias("operator"), F.when(k % 4 == 0, "ATAC").when(k % 4 == 1, "Lazio").alias("network"),
    )


def owned(spark, d):
    return ops.owned_relations(relations(spark, d), "ATAC").select("rel_id", "ref", "network", "kind")


def mastered(spark, d):
    top = bridge.table(spark, d, "orders").agg(F.max("o_orderkey").alias("top"))
    m = bridge.table(spark, d, "customer").crossJoin(F.broadcast(top)).select(F.col("c_custkey").alias("master_id"), (F.col("c_custkey") * 4 % F.col("top")).alias("rel_id"))
    return ops.with_masters(owned(spark, d), m)


def rel_ways(spark, d):
    n = F.col("l_linenumber")
    return bridge.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("rel_id"), F.col("l_partkey").alias("way_id"), F.when(n == 7, "platform_exit").when(n == 6, "stop").otherwise("").alias("role"))


NETWORKS = """net AS (SELECT * FROM (VALUES ('ATAC', ['A', 'B', 'C'], 'ME', 'ATAC:', 'R'), ('COTRAL', ['8', '14'], 'M', 'C:', 'X')) t(owner, metro_refs, key_prefix, route_prefix, mark)),
cand AS (SELECT DISTINCT rel_id, route, ref, operator, network, unnest([operator, network]) AS owner FROM rel WHERE coalesce(ref, '') <> ''),
own2 AS (SELECT rel_id, ref, owner, coalesce(cand.network, operator) AS network, key_prefix, route_prefix, CASE WHEN route = 'subway' AND list_contains(metro_refs, ref) THEN 'metro' WHEN route IN ('tram', 'light_rail', 'rail', 'regional_rail') THEN route END AS kind FROM cand JOIN net USING (owner)),
gt2 AS (SELECT * FROM (VALUES ('ATAC', 'MEA', 'r1', 'E27439'), ('ATAC', 'MEB', 'r2', ''), ('COTRAL', 'M14', 'r3', '00FF00'), ('COTRAL', '8', 'r4', '')) t(owner, short_name, route_id, color))"""


@query(
    "join_network_rules",
    f"""{SQL}, {NETWORKS} SELECT rel_id, own2.owner, kind, ref, network, coalesce(route_prefix || route_id, 'OSM:' || network || ':' || ref) AS route, route_id IS NOT NULL AS routable,
CASE WHEN kind = 'metro' THEN coalesce('#' || nullif(color, ''), CASE WHEN own2.owner = 'COTRAL' THEN CASE ref WHEN '8' THEN '#112233' ELSE '#000000' END WHEN ref = 'A' THEN '#E27439' WHEN ref = 'B' THEN '#0570B5' ELSE '#008456' END) END AS color
FROM own2 LEFT JOIN gt2 ON gt2.owner = own2.owner AND CASE WHEN kind = 'metro' THEN key_prefix || ref WHEN kind = 'tram' THEN ref END = short_name WHERE kind IS NOT NULL""",
)
def network_rules(spark, d):
    """The lines of two networks, each by its own row of rules."""
    other = ("COTRAL", ["8", "14"], {"8": "#112233"}, "#000000", [], "M", "C:", "COTRAL.gtfs.zip", 12.5, 41.9, 82_800.0)
    routes = spark.createDataFrame([("ATAC", "MEA", "r1", "E27439"), ("ATAC", "MEB", "r2", ""), ("COTRAL", "M14", "r3", "00FF00"), ("COTRAL", "8", "r4", "")], "owner string, short_name string, route_id string, color string")
    found = networks.with_timetable(networks.owned(relations(spark, d), networks.rules(spark, other)), routes)
    return found.select("rel_id", "owner", "kind", "ref", "network", "route", "routable", "color")


query("filter_owned_relations", f"{SQL} SELECT * FROM owned")(owned)
query("join_relation_masters", f"{SQL} SELECT * FROM mast")(mastered)


@query("agg_line_grouping", f"{SQL} SELECT * FROM ln")
def lines(spark, d):
    return ops.lines(mastered(spark, d), rel_ways(spark, d))


@query("join_line_timetable", f"{SQL} SELECT * FROM tt")
def timetable(spark, d):
    routes = spark.createDataFrame([("MEA", "MEA", "E27439"), ("MEB", "MEB", ""), ("r8", "8", "00FF00"), ("r3", "3", "")], "route_id string, short_name string, color string")
    return ops.with_timetable(lines(spark, d), routes)


@query("sort_metro_first", f"{SQL}, o AS (SELECT DISTINCT kind, ref, network FROM ln) SELECT kind, ref, network, CAST(row_number() OVER (ORDER BY kind <> 'metro', coalesce(try_cast(ref AS BIGINT), 9223372036854775807), ref, kind, network) AS INTEGER) AS place FROM o")
def metro_first(spark, d):
    return ops.metro_first(lines(spark, d).select("kind", "ref", "network").distinct())


@query("filter_rail_roles", f"{SQL} SELECT rel_id, way_id, role FROM rw WHERE NOT (starts_with(role, 'platform') OR starts_with(role, 'stop')) AND role NOT IN ('station', 'halt')")
def rail_roles(spark, d):
    return rel_ways(spark, d).filter(modes.is_rail_role(F.col("role")))


@query("scan_needed_ways", f"{SQL} SELECT way_id, count(*) AS n FROM rw WHERE rel_id IN (SELECT rel_id FROM owned) GROUP BY way_id")
def needed_ways(spark, d):
    return rel_ways(spark, d).join(owned(spark, d).select("rel_id"), "rel_id", "left_semi").groupBy("way_id").agg(F.count(F.lit(1)).alias("n"))


@query(
    "join_way_geometry",
    f"{SQL}, nd AS (SELECT p_partkey AS node_id, 12 + p_size / 64.0::DOUBLE AS lon, 41 + p_size / 32.0::DOUBLE AS lat FROM part WHERE p_partkey % 9 <> 0), rf AS (SELECT l_orderkey AS way_id, list(l_partkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS refs FROM lineitem GROUP BY l_orderkey), "
    "ex AS (SELECT way_id, unnest(refs) AS node_id, generate_subscripts(refs, 1) AS pos FROM rf WHERE way_id IN (SELECT rel_id FROM owned)), pts AS (SELECT way_id, list({'lon': lon, 'lat': lat} ORDER BY pos) AS l FROM ex JOIN nd USING (node_id) GROUP BY way_id) "
    "SELECT way_id, CAST(len(l) AS INTEGER) AS n, l[1].lon AS first_lon, l[-1].lat AS last_lat FROM pts WHERE len(l) >= 2",
)
def way_geometry(spark, d):
    li = bridge.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("way_id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))), lambda s: s["l_partkey"]).alias("refs"))
    nodes = bridge.table(spark, d, "part").select(F.when(F.col("p_partkey") % 9 == 0, -1 - F.col("p_partkey")).otherwise(F.col("p_partkey")).alias("node_id"), (12 + F.col("p_size") / F.lit(64.0)).alias("lon"), (41 + F.col("p_size") / F.lit(32.0)).alias("lat"))
    g = ops.geometry(li, nodes, owned(spark, d).select(F.col("rel_id").alias("way_id")))
    return g.select("way_id", F.size("points").alias("n"), F.get("points", F.lit(0))["lon"].alias("first_lon"), F.element_at("points", -1)["lat"].alias("last_lat"))


TRACK = "tk AS (SELECT label AS line_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS pos, round(embedding[1] * 100)::DOUBLE AS x, round(embedding[2] * 100)::DOUBLE AS y FROM embeddings)"


def track(spark, d):
    from pyspark.sql import Window

    e = bridge.table(spark, d, "embeddings")
    at = lambda i: F.round(F.get("embedding", F.lit(i)) * F.lit(100).cast("float")).cast("double")
    return e.select(F.col("label").alias("line_id"), F.row_number().over(Window.partitionBy("label").orderBy("vec_id")).alias("pos"), at(0).alias("x"), at(1).alias("y"))


@query("win_run_length", f"WITH {TRACK} SELECT line_id, round(sum(coalesce(s, 0)) * 1e6) / 1e6 AS length FROM (SELECT line_id, sqrt(pow(lead(x) OVER w - x, 2) + pow(lead(y) OVER w - y, 2)) AS s FROM tk WINDOW w AS (PARTITION BY line_id ORDER BY pos)) GROUP BY line_id")
def run_length(spark, d):
    return ops.run_length(track(spark, d)).withColumn("length", rounded(F.col("length"), 6))


@query("win_collapse_duplicates", f"WITH {TRACK}, h AS (SELECT line_id, pos, floor(x / 8) AS x, 0.0::DOUBLE AS y FROM tk) SELECT line_id, CAST(pos AS INTEGER) AS pos, x::DOUBLE AS x, y FROM (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py FROM h WINDOW w AS (PARTITION BY line_id ORDER BY pos)) WHERE NOT coalesce(x = px AND y = py, false)")
def collapse(spark, d):
    return ops.collapse(track(spark, d).select("line_id", "pos", F.floor(F.col("x") / 8).cast("double").alias("x"), F.lit(0.0).alias("y")))


@query("win_densify", f"WITH {TRACK}, g AS (SELECT *, lead(x) OVER w AS nx, lead(y) OVER w AS ny FROM tk WINDOW w AS (PARTITION BY line_id ORDER BY pos)), n AS (SELECT *, coalesce(greatest(floor(sqrt(pow(nx - x, 2) + pow(ny - y, 2)) / 16), 1), 1)::INTEGER AS n FROM g), k AS (SELECT *, unnest(range(0, n)) AS k FROM n) SELECT line_id, CAST(pos AS INTEGER) AS pos, CAST(k AS INTEGER) AS k, round((CASE WHEN k = 0 THEN x ELSE x + (nx - x) * (k / n) END) * 1e6) / 1e6 AS x, round((CASE WHEN k = 0 THEN y ELSE y + (ny - y) * (k / n) END) * 1e6) / 1e6 AS y FROM k")
def densify(spark, d):
    out = ops.densify(track(spark, d))
    return out.select("line_id", "pos", "k", rounded(F.col("x"), 6).alias("x"), rounded(F.col("y"), 6).alias("y"))


@query("agg_station_centroids", f"WITH {TRACK} SELECT line_id, round(avg(x) * 1e6) / 1e6 AS x, round(avg(y) * 1e6) / 1e6 AS y FROM tk GROUP BY line_id")
def centroids(spark, d):
    c = ops.centroids(track(spark, d).withColumnRenamed("line_id", "name"))
    return c.select(F.col("name").alias("line_id"), rounded(F.col("x"), 6).alias("x"), rounded(F.col("y"), 6).alias("y"))


@query("win_terminus", f"WITH {TRACK} SELECT line_id AS rel_id, arg_max('n' || CAST(x AS INTEGER), pos) AS terminus FROM tk GROUP BY ALL")
def terminus(spark, d):
    return ops.terminus(track(spark, d).select(F.col("line_id").alias("rel_id"), "pos", F.concat(F.lit("n"), F.col("x").cast("int").cast("string")).alias("name")))


LEVELS = """lv AS (SELECT c_nationkey AS target, 2 AS level, 'f' || (c_custkey % 7) AS feed_id, c_name AS url, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS bounds, c_custkey AS k FROM customer
  UNION ALL SELECT n_nationkey, 1, 'f' || (n_nationkey % 9), n_name, CASE WHEN n_nationkey % 3 = 0 THEN n_name END, 0 FROM nation UNION ALL SELECT n_nationkey, 0, 'f8', r_name, r_name, 0 FROM nation JOIN region ON n_regionkey = r_regionkey),
dd AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY target, level, feed_id ORDER BY k DESC) AS rn FROM lv) WHERE rn = 1)"""


def levels(spark, d):
    from pyspark.sql import Window

    c, n, r = (bridge.table(spark, d, t) for t in ("customer", "nation", "region"))
    k = F.col("c_custkey")
    text_of = lambda p, x: F.concat(F.lit(p), x.cast("string"))
    leaf = c.select(F.col("c_nationkey").alias("target"), F.lit(2).alias("level"), text_of("f", k % 7).alias("feed_id"), F.col("c_name").alias("url"), F.when(k % 2 == 0, F.col("c_mktsegment")).alias("bounds"), k.alias("k"))
    nk = F.col("n_nationkey")
    mid = n.select(nk.alias("target"), F.lit(1).alias("level"), text_of("f", nk % 9).alias("feed_id"), F.col("n_name").alias("url"), F.when(nk % 3 == 0, F.col("n_name")).alias("bounds"), F.lit(0).cast("long").alias("k"))
    root = n.join(r, n.n_regionkey == r.r_regionkey).select(nk.alias("target"), F.lit(0).alias("level"), F.lit("f8").alias("feed_id"), F.col("r_name").alias("url"), F.col("r_name").alias("bounds"), F.lit(0).cast("long").alias("k"))
    w = Window.partitionBy("target", "level", "feed_id").orderBy(F.desc("k"))
    return leaf.union(mid).union(root).withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


@query("set_region_feeds", f"WITH {LEVELS} SELECT target, level, feed_id, url FROM (SELECT *, row_number() OVER (PARTITION BY target, feed_id ORDER BY level DESC) AS rn FROM dd) WHERE rn = 1")
def region_feeds(spark, d):
    return regions.inherited(levels(spark, d), "target", "feed_id").select("target", "level", "feed_id", "url")


@query("set_region_scalars", f"WITH {LEVELS}, one AS (SELECT target, level, max(bounds) AS bounds FROM dd GROUP BY ALL) SELECT target, arg_max(bounds, level) FILTER (bounds IS NOT NULL) AS bounds FROM one GROUP BY target")
def region_scalars(spark, d):
    one = levels(spark, d).groupBy("target", "level").agg(F.max("bounds").alias("bounds"))
    return regions.resolved_scalars(one, "target", ["bounds"])


@query("filter_gtfs_feeds", "SELECT s_suppkey AS feed_id FROM supplier WHERE coalesce(CASE WHEN s_suppkey % 3 = 0 THEN false WHEN s_suppkey % 3 = 1 THEN true END, true) AND coalesce(CASE WHEN s_suppkey % 4 = 0 THEN 'netex' WHEN s_suppkey % 4 = 1 THEN 'gtfs' END, 'gtfs') = 'gtfs'")
def gtfs_feeds(spark, d):
    k = F.col("s_suppkey")
    f = bridge.table(spark, d, "supplier").select(k.alias("feed_id"), F.when(k % 3 == 0, False).when(k % 3 == 1, True).alias("enabled"), F.when(k % 4 == 0, "netex").when(k % 4 == 1, "gtfs").alias("source"))
    return regions.gtfs_feeds(f).select("feed_id")


@query(
    "set_region_jobs",
    """WITH f AS (SELECT 'f' || s_suppkey AS feed_id, CASE WHEN s_suppkey % 4 = 0 THEN 'netex' WHEN s_suppkey % 4 = 1 THEN 'gtfs' END AS source, CASE WHEN s_suppkey % 8 = 0 THEN '' ELSE 'u' || s_suppkey END AS url,
  CASE WHEN s_suppkey % 3 = 0 THEN 'v' || s_suppkey END AS live FROM supplier WHERE s_suppkey % 5 <> 0),
p AS (SELECT 'trip-updates' AS job, feed_id, live AS url, NULL AS path, 30 AS every_s FROM f WHERE live IS NOT NULL)
SELECT 'timetable' AS job, feed_id, nullif(url, '') AS url, 'graph/' || feed_id || '.gtfs.zip from graph/rome.osm.pbf' AS path, 86400 AS every_s FROM f WHERE source = 'netex'
UNION ALL SELECT * FROM p UNION ALL SELECT 'reliability-rollup', NULL, NULL, NULL, 3600 FROM (SELECT count(*) AS n FROM p) WHERE n > 0""",
)
def region_jobs(spark, d):
    k = F.col("s_suppkey")
    name = lambda prefix: F.concat(F.lit(prefix), k.cast("string"))
    channel = lambda kind, url: F.struct(F.lit(kind).alias("channel"), url.alias("url"))
    channels = F.when(k % 3 == 0, F.array(channel("alerts", name("a")), channel("trip-updates", name("v")))).otherwise(F.array(channel("alerts", name("a"))))
    feeds = bridge.table(spark, d, "supplier").select(name("f").alias("feed_id"), F.when(k % 5 == 0, False).alias("enabled"), F.when(k % 4 == 0, "netex").when(k % 4 == 1, "gtfs").alias("source"), F.when(k % 8 == 0, "").otherwise(name("u")).alias("url"), channels.alias("channels"))
    return regions.jobs(feeds, "rome")


@query("agg_worst_status", "SELECT user_id AS g, CASE max(CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 0 WHEN 'error' THEN 2 ELSE 1 END) WHEN 0 THEN 'ok' WHEN 1 THEN 'degraded' ELSE 'down' END AS status FROM events GROUP BY user_id")
def worst_status(spark, d):
    e = bridge.table(spark, d, "events")
    s = F.when(F.col("event_type").isin("view", "click"), "ok").when(F.col("event_type") == "error", "down").otherwise("degraded")
    return regions.worst_status(e.select(F.col("user_id").alias("g"), s.alias("status")), "g")


@query("agg_request_metrics", "SELECT event_type AS method, 200 + user_id % 3 AS status, count(*) AS requests FROM events GROUP BY ALL")
def request_metrics(spark, d):
    return regions.request_metrics(bridge.table(spark, d, "events").select(F.col("event_type").alias("method"), (200 + F.col("user_id") % 3).alias("status")))


@query("filter_stations", "SELECT s_suppkey AS k, trim(s_name) AS name, nullif(CASE WHEN s_suppkey % 5 = 0 THEN 0.0::DOUBLE ELSE s_acctbal END, 0) AS lat FROM supplier WHERE s_suppkey % 7 <> 0")
def stations(spark, d):
    s = bridge.table(spark, d, "supplier")
    name = F.when(F.col("s_suppkey") % 7 == 0, "  ").otherwise(F.concat(F.lit(" "), F.col("s_name")))
    rows = s.select(F.col("s_suppkey").alias("k"), text.trimmed(name).alias("name"), text.coordinate(F.when(F.col("s_suppkey") % 5 == 0, 0.0).otherwise(F.col("s_acctbal"))).alias("lat"))
    return rows.filter("name IS NOT NULL")
