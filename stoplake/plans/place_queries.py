"""Queries of places."""

from __future__ import annotations

from pyspark.sql import functions as F

from stoplake.functions import address as ad
from stoplake.functions.geo import haversine_m, in_bbox, parse_bbox, rounded, to_metres
from stoplake.operators import places as ops
from stoplake.operators import regions
from stoplake.plans import bridge
from stoplake.plans.registry import query

BOX = (12.1, 41.6, 12.6, 42.1)
IN_BOX = "lon BETWEEN 12.1::DOUBLE AND 12.6::DOUBLE AND lat BETWEEN 41.6::DOUBLE AND 42.1::DOUBLE"
ADDR = "WITH " + bridge.SQL["addr"]
POI = ADDR + ", " + bridge.SQL["poi"]
CLEAN = lambda x: f"trim(regexp_replace(translate(translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), 'àáâäèéêëìíîïòóôöùúûüç.', 'aaaaeeeeiiiioooouuuuc'), '[^a-z0-9à-ÿ]+', ' ', 'g'))"
TYPES = "CASE " + " ".join(f"WHEN {{0}} IN ({', '.join(repr(x) for x in short)}) THEN '{full}'" for full, short in ad.STREET_TYPES.items()) + " ELSE {0} END"
STREET = lambda x: TYPES.format(f"split_part({CLEAN(x)}, ' ', 1)") + f" || substr({CLEAN(x)}, length(split_part({CLEAN(x)}, ' ', 1)) + 1)"
NUMBER = lambda x: f"CASE WHEN {CLEAN(x)} IN ('', 'snc') THEN '__snc__' ELSE replace(CASE WHEN {CLEAN(x)} LIKE '%rosso' THEN trim(regexp_replace({CLEAN(x)}, 'rosso$', '')) WHEN {CLEAN(x)} LIKE '% r' THEN regexp_replace({CLEAN(x)}, ' r$', '') ELSE {CLEAN(x)} END, ' ', '') END"
RED = lambda x: f"({CLEAN(x)} LIKE '%rosso' OR {CLEAN(x)} LIKE '% r')"
SQUASH = lambda x: f"trim(regexp_replace(translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
BUCKET = lambda s, n, c: f"{CLEAN(c)} || '|' || {STREET(s)} || '|' || {NUMBER(n)} || CASE WHEN {RED(n)} THEN '|rosso' ELSE '' END"
SPLIT_S = "coalesce(nullif(regexp_extract(regexp_replace(trim(address), '[, ]+$', ''), '^(.*?)[ ,]+([0-9][^ ,]*)$', 1), ''), regexp_replace(trim(address), '[, ]+$', ''))"
SPLIT_N = "nullif(regexp_extract(regexp_replace(trim(address), '[, ]+$', ''), '^(.*?)[ ,]+([0-9][^ ,]*)$', 2), '')"
PLACES = f"pl AS (SELECT * FROM poi WHERE {IN_BOX} AND name IS NOT NULL AND address IS NOT NULL), bk AS (SELECT *, {BUCKET('street', 'number', 'coalesce(city, chr(32))')} AS bucket FROM (SELECT *, {SPLIT_S} AS street, {SPLIT_N} AS number FROM pl) WHERE number IS NOT NULL)"
HAV = "round((2 * 6371000.0::DOUBLE * asin(least(1, sqrt(pow(sin(radians(lat - a_lat) / 2), 2) + cos(radians(a_lat)) * cos(radians(lat)) * pow(sin(radians(lon - a_lon) / 2), 2))))) * 10) / 10"
ANCHOR = f"an AS (SELECT id AS anchor_id, street, number, city, brand_wikidata, lon AS a_lon, lat AS a_lat, bucket FROM bk)"


def pois(spark, d):
    return ops.addressed_places(bridge.places(spark, d), BOX)


def anchors(spark, d):
    return ops.bucketed(pois(spark, d)).select(F.col("id").alias("anchor_id"), "street", "number", "city", "brand_wikidata", F.col("lon").alias("a_lon"), F.col("lat").alias("a_lat"))


@query("scan_house_numbers", f"{ADDR} SELECT id, street, number, postal_city, postcode, lon, lat FROM (SELECT *, row_number() OVER (PARTITION BY lower(street), number, lower(coalesce(postal_city, '')) ORDER BY id) AS rn FROM addr WHERE {IN_BOX} AND number IS NOT NULL AND street IS NOT NULL) WHERE rn = 1")
def house_numbers(spark, d):
    return ops.house_numbers(bridge.addresses(spark, d), BOX)


@query(
    "sink_house_number_documents",
    f"{ADDR}, o AS (SELECT *, row_number() OVER (PARTITION BY lower(street), number, lower(coalesce(postal_city, '')) ORDER BY id) AS rn FROM addr WHERE {IN_BOX} AND number IS NOT NULL AND street IS NOT NULL) "
    "SELECT left('ov' || regexp_replace(id, '[^A-Za-z0-9_-]', '', 'g'), 60) AS place_id, 'house-number' AS object_type, number AS housenumber, postcode, street, postal_city AS city, lon, lat FROM o WHERE rn = 1",
)
def house_number_documents(spark, d):
    """The documents read back by path, since engines print JSON numbers differently."""
    docs = ops.house_number_documents(house_numbers(spark, d), "it")
    schema = "type string, content array<struct<place_id string, object_type string, housenumber string, postcode string, address struct<street string, city string>, centroid array<double>>>"
    c = docs.select(F.get(F.from_json("value", schema)["content"], F.lit(0)).alias("c"))
    return c.select("c.place_id", "c.object_type", "c.housenumber", "c.postcode", "c.address.street", "c.address.city", F.get("c.centroid", F.lit(0)).alias("lon"), F.get("c.centroid", F.lit(1)).alias("lat"))


query("scan_addressed_places", f"{POI}, {PLACES} SELECT id, name, category, address, city, brand_wikidata, lon, lat FROM pl")(pois)


@query("scalar_split_freeform", f"{POI} SELECT id, address, {SPLIT_S} AS street, {SPLIT_N} AS number FROM poi")
def split_freeform(spark, d):
    p = bridge.places(spark, d).select("id", F.get("addresses", F.lit(0))["freeform"].alias("address"))
    return p.select("id", "address", ad.split_freeform(F.col("address"))["street"].alias("street"), ad.split_freeform(F.col("address"))["number"].alias("number"))


@query("agg_correlation_index", f"{POI}, {PLACES} SELECT bucket, count(*) AS n, min(id) AS first_id FROM bk GROUP BY ALL")
def correlation_index(spark, d):
    return ops.bucketed(pois(spark, d)).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"))


@query("agg_index_size", f"{POI}, {PLACES} SELECT count(*) AS n FROM bk")
def index_size(spark, d):
    return ops.bucketed(pois(spark, d)).agg(F.count(F.lit(1)).alias("n"))


@query("join_bucket_address", f"{POI}, {PLACES}, {ANCHOR} SELECT anchor_id, bk.id AS poi_id, 'same-address' AS relation, {HAV} AS distance_m FROM bk JOIN an ON bk.bucket = an.bucket")
def bucket_address(spark, d):
    return ops.at_address(pois(spark, d), anchors(spark, d))


@query("join_same_brand", f"{POI}, {PLACES}, {ANCHOR} SELECT anchor_id, pl.id AS poi_id, 'same-brand' AS relation, {HAV} AS distance_m FROM pl JOIN an ON pl.brand_wikidata = an.brand_wikidata")
def same_brand(spark, d):
    return ops.same_brand(pois(spark, d), anchors(spark, d))


@query("set_related_places", f"{POI}, {PLACES}, {ANCHOR} SELECT anchor_id, bk.id AS poi_id, 'same-address' AS relation, {HAV} AS distance_m FROM bk JOIN an ON bk.bucket = an.bucket UNION ALL SELECT anchor_id, pl.id, 'same-brand', {HAV} FROM pl JOIN an ON pl.brand_wikidata = an.brand_wikidata")
def related(spark, d):
    return ops.related(pois(spark, d), anchors(spark, d))


@query("filter_bbox_rows", f"{ADDR} SELECT id, lon, lat FROM addr WHERE {IN_BOX}")
def bbox_rows(spark, d):
    return bridge.addresses(spark, d).filter(in_bbox(F.col("lon"), F.col("lat"), BOX)).select("id", "lon", "lat")


BOXES = ["12.1,41.6,12.9,42.2", " 12.1, 41.6 ,12.9,42.2", "12.9,41.6,12.1,42.2", "1,2,3", "a,b,c,d", "200,0,201,1", "", "0,0,0,1", "-10,-10,10,10"]
#: Each supplier asks for a box: fixed ones, some of them wrong, and boxes about a place of its own.
BOX_ROWS = "bx AS (SELECT CAST(s_suppkey AS INTEGER) AS id, CASE s_suppkey % 12 " + " ".join(f"WHEN {i} THEN '{b}'" for i, b in enumerate(BOXES)) + " ELSE concat_ws(',', (s_suppkey % 200 - 10), (s_suppkey % 100 - 5), (s_suppkey % 200 - 8), (s_suppkey % 100 - 4)) END AS bbox FROM supplier)"


def boxes(spark, d):
    k = F.col("s_suppkey")
    own = F.concat_ws(",", *[x.cast("string") for x in (k % 200 - 10, k % 100 - 5, k % 200 - 8, k % 100 - 4)])
    fixed = F.get(F.array(*map(F.lit, BOXES)), (k % 12).cast("int"))
    return bridge.table(spark, d, "supplier").select(k.cast("int").alias("id"), F.when(k % 12 < len(BOXES), fixed).otherwise(own).alias("bbox"))


PARTS = "p AS (SELECT id, bbox, list_transform(string_split(bbox, ','), lambda x: try_cast(trim(x) AS DOUBLE)) AS v FROM bx)"


@query("filter_parse_bbox", f"WITH {BOX_ROWS}, {PARTS} SELECT id, round((v[3] - v[1]) * (v[4] - v[2]) * 1e6) / 1e6 AS area FROM p WHERE len(v) = 4 AND v[1] BETWEEN -180 AND 180 AND v[3] BETWEEN -180 AND 180 AND v[2] BETWEEN -90 AND 90 AND v[4] BETWEEN -90 AND 90 AND v[1] < v[3] AND v[2] < v[4]")
def bbox_parse(spark, d):
    b = boxes(spark, d).withColumn("p", parse_bbox(F.col("bbox")))
    return b.filter("p IS NOT NULL").select("id", rounded(F.col("p.area_deg2"), 6).alias("area"))


@query(
    "filter_validate_extract",
    f"WITH {BOX_ROWS}, {PARTS}, c AS (SELECT id, CASE WHEN trim(bbox) = '' THEN 'bbox_required' WHEN len(v) <> 4 OR list_bool_or(list_transform(v, lambda x: x IS NULL)) THEN 'bbox_invalid' WHEN NOT (v[1] BETWEEN -180 AND 180 AND v[3] BETWEEN -180 AND 180 AND v[2] BETWEEN -90 AND 90 AND v[4] BETWEEN -90 AND 90) THEN 'bbox_out_of_range' WHEN v[1] >= v[3] OR v[2] >= v[4] THEN 'bbox_degenerate' WHEN (v[3] - v[1]) * (v[4] - v[2]) > 6 THEN 'area_too_large' END AS error FROM p) "
    "SELECT id, error, CASE WHEN error IS NULL THEN least(id * 3, least(id * 10, 14)) END AS minzoom, CASE WHEN error IS NULL THEN least(id * 10, 14) END AS maxzoom FROM c",
)
def validate(spark, d):
    return regions.validate_extract(boxes(spark, d).withColumns({"minzoom": F.col("id") * 3, "maxzoom": F.col("id") * 10}))


@query("scalar_haversine", f"{ADDR} SELECT id, round((2 * 6371000.0::DOUBLE * asin(least(1, sqrt(pow(sin(radians(lat - 41.9::DOUBLE) / 2), 2) + cos(radians(41.9::DOUBLE)) * cos(radians(lat)) * pow(sin(radians(lon - 12.5::DOUBLE) / 2), 2))))) * 100) / 100 AS m FROM addr")
def haversine(spark, d):
    return bridge.addresses(spark, d).select("id", rounded(haversine_m(F.lit(12.5), F.lit(41.9), F.col("lon"), F.col("lat")), 2).alias("m"))


@query(
    "join_nearest_station",
    f"{ADDR}, pt AS (SELECT id AS point_id, (lon - 12.5::DOUBLE) * 82800.0::DOUBLE AS x, (lat - 41.9::DOUBLE) * 111320.0::DOUBLE AS y FROM addr), st AS (SELECT 's' || s_suppkey AS name, ((s_suppkey % 97) - 48) * 900.0::DOUBLE AS x, ((s_suppkey % 31) - 15) * 3000.0::DOUBLE AS y FROM supplier), "
    "m AS (SELECT point_id, min({'d2': (pt.x - st.x) * (pt.x - st.x) + (pt.y - st.y) * (pt.y - st.y), 'name': name}) AS m FROM pt, st GROUP BY point_id) SELECT point_id, m.name AS name, round(sqrt(m.d2) * 1e6) / 1e6 AS distance_m FROM m WHERE m.d2 <= 2500.0 * 2500.0",
)
def nearest_station(spark, d):
    a = bridge.addresses(spark, d)
    x, y = to_metres(F.col("lon"), F.col("lat"))
    k = F.col("s_suppkey")
    centres = bridge.table(spark, d, "supplier").select(F.concat(F.lit("s"), k.cast("string")).alias("name"), ((k % 97 - 48) * F.lit(900.0)).alias("x"), ((k % 31 - 15) * F.lit(3000.0)).alias("y"))
    return ops.nearest(a.select(F.col("id").alias("point_id"), x.alias("x"), y.alias("y")), centres, 2500.0).withColumn("distance_m", rounded(F.col("distance_m"), 6))


ADDRESSES = [("V.le Trastevere", "12/A", "Roma"), ("P.za di Spagna", "12 bis", "ROMA"), ("C.so Vittorio", "1 rosso", "Roma"), ("L.go Argentina", "12/r", "Forlì"), ("V XX Settembre", "12r", "Roma"), ("Via Cavour", "snc", ""), ("borgo Pio", "", "Cefalù"), ("", "7", "X"), ("S. Pietro", "7-9", "L'Aquila")]
#: Each customer has one of these, with its own street number where it is none.
ADDRESS_ROWS = f"ar AS (SELECT c_custkey AS id, street || ' ' || c_nationkey AS street, number, city || c_mktsegment AS city FROM customer JOIN (VALUES " + ", ".join(f"({i}, " + ", ".join("'" + x.replace("'", "''") + "'" for x in r) + ")" for i, r in enumerate(ADDRESSES)) + f") t(i, street, number, city) ON c_custkey % {len(ADDRESSES)} = i)"


@query("scalar_address_buckets", f"WITH {ADDRESS_ROWS} SELECT id, {BUCKET('street', 'number', 'city')} AS italian, {SQUASH('city')} || '|' || {SQUASH('street')} || '|' || {SQUASH('number')} AS generic FROM ar")
def address_buckets(spark, d):
    k = F.col("c_custkey") % len(ADDRESSES)
    part = lambda i: F.get(F.array(*[F.lit(r[i]) for r in ADDRESSES]), k.cast("int"))
    a = bridge.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.concat(part(0), F.lit(" "), F.col("c_nationkey").cast("string")).alias("street"), part(1).alias("number"), F.concat(part(2), F.col("c_mktsegment")).alias("city"))
    return ops.with_bucket(ops.with_bucket(a, "italy").withColumnRenamed("bucket", "italian"), "elsewhere").select("id", "italian", F.col("bucket").alias("generic"))
