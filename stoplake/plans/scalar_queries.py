"""Queries of scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from stoplake.functions import calendar as cal
from stoplake.functions import keys, text
from stoplake.plans import bridge
from stoplake.plans.registry import query

DAYS = "dy AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders)"


def days(spark, d):
    return bridge.table(spark, d, "orders").select(F.to_date("o_orderdate").alias("d")).distinct()


@query("scalar_tod_bucket", "WITH hours AS (SELECT event_id, CAST(extract(hour FROM ts) AS INTEGER) + CAST(event_id % 5 AS INTEGER) - 2 AS h FROM events) SELECT event_id, h, CASE WHEN h < 0 THEN 'night' WHEN h <= 5 THEN 'early' WHEN h <= 8 THEN 'am-peak' WHEN h <= 14 THEN 'midday' WHEN h <= 18 THEN 'pm-peak' WHEN h <= 21 THEN 'evening' ELSE 'night' END AS tod FROM hours")
def tod(spark, d):
    """Hours from -2 to 26: those of the events, moved by up to two."""
    h = bridge.table(spark, d, "events").select("event_id", (F.hour("ts") + (F.col("event_id") % 5).cast("int") - 2).alias("h"))
    return h.withColumn("tod", cal.tod_bucket(F.col("h")))


# Easter by the full moon's place in the lunar year, another way than the operator's
EASTER = """moon AS (SELECT y, (y // 100) AS c, y % 19 AS g FROM yr), epact AS (SELECT y, c, g, (c - c // 4 - (8 * c + 13) // 25 + 19 * g + 15) % 30 AS h0 FROM moon),
full_moon AS (SELECT y, c, h0 - (h0 // 28) * (1 - (h0 // 28) * (29 // (h0 + 1)) * ((21 - g) // 11)) AS i FROM epact),
monday AS (SELECT y, make_date(y, 3, 28) + CAST(i - (y + y // 4 + i + 2 - c + c // 4) % 7 AS INTEGER) + 1 AS m FROM full_moon)"""


@query(
    "scalar_day_type",
    f"WITH {DAYS}, yr AS (SELECT DISTINCT year(d) AS y FROM dy), {EASTER}, y AS (SELECT strftime(d, '%Y%m%d') AS ymd, d FROM dy) SELECT ymd, CASE WHEN strftime(d, '%m-%d') IN ('01-01','01-06','04-25','05-01','06-02','08-15','11-01','12-08','12-25','12-26') OR d IN (SELECT m FROM monday) OR isodow(d) = 7 THEN 'sunday-holiday' WHEN isodow(d) = 6 THEN 'saturday' ELSE 'weekday' END AS day_type FROM y",
)
def day_type(spark, d):
    y = days(spark, d).select(F.date_format("d", "yyyyMMdd").alias("ymd"))
    return y.withColumn("day_type", cal.day_type(F.col("ymd")))


@query("scalar_easter_monday", f"WITH yr AS (SELECT DISTINCT CAST(1583 + o_orderkey % 1500 AS INTEGER) AS y FROM orders), {EASTER} SELECT CAST(y AS INTEGER) AS y, strftime(m, '%Y%m%d') AS monday FROM monday")
def easter(spark, d):
    """Of the years from 1583 that the orders' keys stand for."""
    y = bridge.table(spark, d, "orders").select((1583 + F.col("o_orderkey") % 1500).cast("int").alias("y")).distinct()
    return y.select("y", F.date_format(F.date_add(cal.easter_sunday(F.col("y")), 1), "yyyyMMdd").alias("monday"))


@query("scalar_epoch_day", f"WITH {DAYS} SELECT strftime(d, '%Y%m%d') AS ymd, CAST(d - DATE '1970-01-01' AS INTEGER) AS day, strftime(d, '%Y%m%d') AS back, strftime(d - 1, '%Y%m%d') AS previous, year(d) % 4 = 0 AND (year(d) % 100 <> 0 OR year(d) % 400 = 0) AS leap, CAST(day(last_day(d)) AS INTEGER) AS month_days FROM dy")
def epoch_day(spark, d):
    y = days(spark, d).select("d", F.date_format("d", "yyyyMMdd").alias("ymd"))
    e = cal.epoch_day(F.col("ymd"))
    return y.select("ymd", e.alias("day"), cal.ymd_of_day(e).alias("back"), cal.previous_ymd(F.col("ymd")).alias("previous"), cal.is_leap_year(F.year("d")).alias("leap"), cal.days_in_month(F.year("d"), F.month("d")).alias("month_days"))


@query("scalar_utc_date", "SELECT o_orderkey AS k, strftime(make_timestamp(o_orderkey * 86399 * 1000000), '%Y-%m-%d') AS d FROM orders")
def utc_date(spark, d):
    o = bridge.table(spark, d, "orders")
    return o.select(F.col("o_orderkey").alias("k"), cal.utc_date_text(F.col("o_orderkey") * 86399).alias("d"))


@query("scalar_day_offset", f"WITH {DAYS} SELECT strftime(d, '%Y-%m-%d') AS iso, CAST(greatest(d - DATE '1995-06-01', 0) AS INTEGER) AS days, strftime(d, '%Y%m%d') AS d8 FROM dy")
def day_offset(spark, d):
    y = days(spark, d).select(F.date_format("d", "yyyy-MM-dd").alias("iso"))
    return y.select("iso", cal.day_offset(F.lit("1995-06-01"), F.col("iso")).alias("days"), cal.date8(F.concat("iso", F.lit("T10:00:00"))).alias("d8"))


@query("scalar_local_id", "SELECT p_partkey AS k, CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN p_brand ELSE 'b:' || p_brand END AS id FROM part")
def local_id(spark, d):
    k = F.col("p_partkey")
    raw = F.when(k % 3 == 0, F.concat(F.lit("FEED:"), F.col("p_name"))).when(k % 3 == 1, F.col("p_brand")).otherwise(F.concat(F.lit("FEED:b:"), F.col("p_brand")))
    return bridge.table(spark, d, "part").select(k.alias("k"), keys.local_id(raw).alias("id"))


@query("scalar_tier_keys", "SELECT DISTINCT event_type || '/' || CAST(user_id % 2 AS VARCHAR) || '/' || CAST(user_id AS VARCHAR) || '/midday/weekday' AS key2, event_type || '/' || CAST(user_id % 2 AS VARCHAR) || '/' || CAST(user_id AS VARCHAR) || '/20240101/midday' AS key1, event_type AS route, CAST(user_id % 2 AS INTEGER) AS direction, CAST(user_id AS VARCHAR) AS stop FROM events")
def tier_keys(spark, d):
    e = bridge.events(spark, d).select("route_id", "direction_id", "stop_id").distinct()
    r, x, s = F.col("route_id"), F.col("direction_id"), F.col("stop_id")
    k2 = keys.tier2_key(r, x, s, F.lit("midday"), F.lit("weekday"))
    back = keys.split_stop_key(k2)
    return e.select(k2.alias("key2"), keys.tier1_key(r, x, s, F.lit("20240101"), F.lit("midday")).alias("key1"), back["route_id"].alias("route"), back["direction_id"].alias("direction"), back["stop_id"].alias("stop"))


@query("scalar_netex_id", "SELECT p_partkey AS k, CASE WHEN p_partkey % 2 = 0 THEN p_brand || '_' || p_size ELSE 'IT_' || p_brand END AS id FROM part")
def netex_id(spark, d):
    k = F.col("p_partkey")
    raw = F.when(k % 2 == 0, F.concat(F.lit("IT:ITI4:Line:"), F.col("p_brand"), F.lit(":"), F.col("p_size").cast("string"))).otherwise(F.concat(F.lit("IT:"), F.col("p_brand")))
    return bridge.table(spark, d, "part").select(k.alias("k"), keys.netex_id(raw).alias("id"))


@query("scalar_slug", "SELECT doc_id, md5(trim(regexp_replace(translate(lower(text), 'àáâèéêìíòóùú', 'aaaeeeiioouu'), '[^a-z0-9]+', '-', 'g'), '-')) AS slug FROM documents")
def slug(spark, d):
    return bridge.table(spark, d, "documents").select("doc_id", F.md5(text.slug(F.col("text"))).alias("slug"))


@query("scalar_strip_html", r"SELECT page_id, md5(regexp_replace(regexp_replace(html, '<[^>]*(>|$)|>', '', 'g'), '^\s+|\s+$', '', 'g')) AS plain FROM pages")
def strip_html(spark, d):
    return bridge.table(spark, d, "pages").select("page_id", F.md5(text.strip_html(F.col("html"))).alias("plain"))


@query("scalar_percent_encode", "SELECT page_id, url_encode(url) AS encoded, 'https://commons.wikimedia.org/wiki/File:' || url_encode(url) AS page FROM pages")
def percent_encode(spark, d):
    return bridge.table(spark, d, "pages").select("page_id", text.percent_encode(F.col("url")).alias("encoded"), text.commons_file_page(F.concat(F.lit("File:"), F.col("url"))).alias("page"))


@query("scalar_guards", "SELECT doc_id, regexp_full_match(source, 'S[0-9]+') AS station, regexp_full_match(source || '-' || lang, '[A-Za-z0-9_-]{1,128}') AS request_id, regexp_full_match(CAST(doc_id AS VARCHAR) || '-255.pbf', '[0-9]+-[0-9]+\\.pbf') AS glyphs FROM documents")
def guards(spark, d):
    x = bridge.table(spark, d, "documents")
    return x.select("doc_id", keys.is_station_id(F.col("source")).alias("station"), keys.valid_request_id(F.concat_ws("-", "source", "lang")).alias("request_id"), keys.valid_glyph_range(F.concat(F.col("doc_id").cast("string"), F.lit("-255.pbf"))).alias("glyphs"))


@query("scalar_trace_id", "SELECT user_id AS u, CASE WHEN user_id % 3 = 0 THEN NULL ELSE md5(CAST(user_id AS VARCHAR)) END AS trace FROM (SELECT DISTINCT user_id FROM events)")
def trace_id(spark, d):
    u = bridge.table(spark, d, "events").select(F.col("user_id").alias("u")).distinct()
    hexes = F.when(F.col("u") % 3 == 0, F.repeat(F.lit("0"), 32)).otherwise(F.upper(F.md5(F.col("u").cast("string"))))
    return u.select("u", keys.trace_id(F.concat(F.lit("00-"), hexes, F.lit("-01"))).alias("trace"))


@query("scan_props_json", """SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events""")
def props(spark, d):
    return bridge.table(spark, d, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("scalar_image_width", "SELECT p_partkey AS k, least(greatest(coalesce(CASE WHEN p_partkey % 4 <> 0 THEN p_size * 60 END, 640), 16), 2048) AS w FROM part")
def image_width(spark, d):
    k = F.col("p_partkey")
    return bridge.table(spark, d, "part").select(k.alias("k"), text.image_width(F.when(k % 4 != 0, F.col("p_size") * 60)).alias("w"))


@query("scalar_csv_field", "SELECT o_orderkey AS k, CASE WHEN o_orderkey % 2 = 0 THEN '\"a\"\"' || o_orderpriority || '\"' ELSE o_orderpriority END AS f FROM orders")
def csv_field(spark, d):
    k = F.col("o_orderkey")
    return bridge.table(spark, d, "orders").select(k.alias("k"), text.csv_field(F.when(k % 2 == 0, F.concat(F.lit('a"'), F.col("o_orderpriority"))).otherwise(F.col("o_orderpriority"))).alias("f"))
