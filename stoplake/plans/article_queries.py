"""Queries of articles, request flags and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from stoplake.functions import requests
from stoplake.operators import articles as ops
from stoplake.operators import documents
from stoplake.plans import bridge
from stoplake.plans.registry import query

# an article's summary for each page: some fields missing, some of another type
SUM = """sm AS (SELECT page_id AS k, CASE WHEN page_id % 2 = 0 THEN 'it' ELSE 'en' END AS lang, url AS asked,
  CASE WHEN page_id % 5 <> 0 THEN url WHEN page_id % 3 = 0 THEN 'T' || page_id ELSE '' END AS title, CASE WHEN page_id % 4 <> 0 THEN 'about ' || page_id END AS description,
  CASE WHEN page_id % 7 <> 0 THEN 'text ' || page_id END AS summary, CASE WHEN page_id % 6 <> 0 THEN 'Q' || page_id END AS qid, CASE WHEN page_id % 3 <> 0 THEN 'https://x.example/' || page_id || '.jpg' END AS thumb,
  CASE WHEN page_id % 8 <> 0 THEN url END AS article_url, CASE WHEN page_id % 9 <> 0 THEN 12 + page_id % 32 / 64.0::DOUBLE END AS lon, CASE WHEN page_id % 9 <> 0 AND page_id % 10 <> 0 THEN 41 + page_id % 32 / 64.0::DOUBLE END AS lat FROM pages)"""
LINKS = "lk AS (SELECT page_id, 'Q' || page_id AS qid, (['it', 'de', 'en'])[page_id % 3 + 1] AS wanted, CASE WHEN page_id % 4 IN (1, 3) THEN 'voce ' || page_id END AS it, CASE WHEN page_id % 4 >= 2 THEN 'article ' || page_id END AS en FROM pages)"
PICTURE = "pc AS (SELECT 'Q' || page_id AS qid, CASE WHEN page_id % 5 = 1 THEN 'View ' || page_id || '.jpg' END AS value FROM pages)"
META = """mt AS (SELECT 'View ' || page_id || '.jpg' AS file, 'CC BY ' || page_id % 5 AS license, CASE WHEN page_id % 2 = 0 THEN 'Author ' || page_id END AS author,
  CASE WHEN page_id % 3 = 0 THEN 'by ' || page_id WHEN page_id % 3 = 1 THEN 'credit ' || page_id END AS attribution FROM pages WHERE page_id % 11 <> 0)"""


def text(prefix: str, suffix: str = "") -> F.Column:
    return F.concat(F.lit(prefix), F.col("page_id").cast("string"), F.lit(suffix))


def summary_docs(spark, d):
    k = F.col("page_id")
    at = (k % 32) / F.lit(64.0)
    body = F.struct(
        F.when(k % 5 != 0, F.col("url")).alias("title"), F.when(k % 3 == 0, text("<i>T", "</i>")).alias("displaytitle"), F.when(k % 4 != 0, text("about ")).alias("description"), F.when(k % 7 == 0, "  \n").otherwise(text("text ")).alias("extract"),
        F.when(k % 6 != 0, text("Q")).alias("wikibase_item"), F.when(k % 3 != 0, F.struct(text("https://x.example/", ".jpg").alias("source"))).alias("thumbnail"), F.when(k % 8 != 0, F.struct(F.struct(F.col("url").alias("page")).alias("desktop"))).alias("content_urls"),
        F.when(k % 9 != 0, F.struct((12 + at).alias("lon"), F.when(k % 10 != 0, 41 + at).alias("lat"))).alias("coordinates"),
    )
    return bridge.table(spark, d, "pages").select(F.when(k % 2 == 0, "it").otherwise("en").alias("lang"), F.col("url").alias("title"), F.to_json(body).alias("body"))


def entity_docs(spark, d):
    """Entities with links in two languages, and a claim that is a text, an object, or missing."""
    k = F.col("page_id")
    value = F.when(k % 5 == 1, F.concat(F.lit('"'), text("View ", ".jpg"), F.lit('"'))).when(k % 5 == 2, F.lit('{"id": "Q1"}'))
    claim = F.coalesce(F.concat(F.lit('{"P18": [{"mainsnak": {"datavalue": {"value": '), value, F.lit("}}}]}")), F.lit("{}"))
    link = lambda lang, has, name: F.when(has, F.concat(F.lit(f'"{lang}wiki": {{"title": "{name} '), k.cast("string"), F.lit('"}')))
    links = F.concat_ws(", ", link("it", (k % 4).isin(1, 3), "voce"), link("en", k % 4 >= 2, "article"))
    body = F.concat(F.lit('{"entities": {"'), text("Q"), F.lit('": {"claims": '), claim, F.lit(', "sitelinks": {'), links, F.lit("}}}}"))
    return bridge.table(spark, d, "pages").select(text("Q").alias("qid"), body.alias("body"))


def image_docs(spark, d):
    k = F.col("page_id")
    field = lambda x: F.struct(x.alias("value"))
    meta = F.struct(
        field(F.concat(F.lit("CC BY "), (k % 5).cast("string"))).alias("LicenseShortName"), F.when(k % 2 == 0, field(text("<a>Author ", "</a>"))).alias("Artist"),
        F.when(k % 3 == 0, field(text("by "))).alias("Attribution"), F.when(k % 3 == 1, field(text("credit "))).alias("Credit"),
    )
    page = F.struct(F.array(F.struct(meta.alias("extmetadata"))).alias("imageinfo"))
    body = F.when(k % 11 == 0, F.lit('{"query": {"pages": {}}}')).otherwise(F.to_json(F.struct(F.struct(F.struct(page.alias("p1")).alias("pages")).alias("query"))))
    return bridge.table(spark, d, "pages").select(text("View ", ".jpg").alias("file"), body.alias("body"))


@query("scan_article_summaries", f"WITH {SUM} SELECT lang, asked, title, description, summary, qid, thumb, article_url, lon, lat FROM sm")
def summaries(spark, d):
    return ops.summaries(summary_docs(spark, d))


@query("filter_article_claims", f"WITH {PICTURE} SELECT * FROM pc")
def claims(spark, d):
    return ops.claims(entity_docs(spark, d), "P18")


@query("join_article_sitelinks", f"WITH {LINKS} SELECT qid, wanted AS wanted_lang, CASE WHEN wanted = 'it' AND it IS NOT NULL THEN 'it' ELSE 'en' END AS lang, CASE WHEN wanted = 'it' THEN coalesce(it, en) ELSE en END AS title FROM lk WHERE CASE WHEN wanted = 'it' THEN coalesce(it, en) ELSE en END IS NOT NULL")
def sitelinks(spark, d):
    wanted = bridge.table(spark, d, "pages").select(F.get(F.array(*map(F.lit, ("it", "de", "en"))), (F.col("page_id") % 3).cast("int")).alias("lang"), text("Q").alias("qid"))
    return ops.sitelinks(wanted, entity_docs(spark, d))


@query("scan_image_meta", f"WITH {META} SELECT * FROM mt")
def image_meta(spark, d):
    return ops.image_meta(image_docs(spark, d))


@query(
    "set_article_targets",
    "WITH r AS (SELECT page_id AS id, CASE WHEN page_id % 3 = 0 THEN 'de' END AS lang, CASE page_id % 6 WHEN 0 THEN 'fr:' || url WHEN 1 THEN 'bad' END AS wikipedia, CASE WHEN page_id % 6 IN (0, 2) THEN 'Title ' || page_id END AS title, CASE WHEN page_id % 6 IN (2, 3, 4) THEN 'Q' || page_id END AS wikidata FROM pages), "
    "t AS (SELECT id, CASE id % 6 WHEN 1 THEN 'wikipedia must be ''lang:Title''' WHEN 5 THEN 'provide one of: wikidata, wikipedia, title' END AS error, CASE id % 6 WHEN 0 THEN 'fr' WHEN 1 THEN NULL WHEN 5 THEN NULL ELSE coalesce(lang, 'it') END AS lang, CASE id % 6 WHEN 0 THEN substr(wikipedia, 4) WHEN 2 THEN title END AS title, CASE WHEN id % 6 IN (3, 4) THEN wikidata END AS qid FROM r) "
    "SELECT *, CASE WHEN error IS NULL THEN lang || '|' || coalesce(title, '') || '|' || coalesce(qid, '') END AS cache_key FROM t",
)
def targets(spark, d):
    k = F.col("page_id")
    r = bridge.table(spark, d, "pages").select(
        k.alias("id"), F.when(k % 3 == 0, "de").alias("lang"), F.when(k % 6 == 0, F.concat(F.lit("fr:"), F.col("url"))).when(k % 6 == 1, "bad").alias("wikipedia"),
        F.when((k % 6).isin(0, 2), text("Title ")).alias("title"), F.when((k % 6).isin(2, 3, 4), text("Q")).alias("wikidata"),
    )
    return ops.targets(r)


PLACE = f"""WITH {SUM}, {PICTURE}, {META}, j AS (SELECT sm.*, value AS file, license, author, attribution FROM sm LEFT JOIN pc ON sm.qid = pc.qid AND value IS NOT NULL LEFT JOIN mt ON value = file WHERE lon IS NOT NULL)
SELECT coalesce('wd:' || qid, 'wp:' || lang || ':' || asked) AS id, title AS name, lang, lon, coalesce(lat, 0) AS lat, description, summary,
  CASE WHEN file IS NOT NULL THEN '/places/image?file=' || url_encode(file) || '&width=640' ELSE thumb END AS image, file IS NOT NULL AS proxied, license, author, attribution,
  concat_ws(';', CASE WHEN description IS NOT NULL THEN 'description/wikidata/CC0/' END, CASE WHEN summary IS NOT NULL THEN 'summary/wikipedia/CC-BY-SA/' || coalesce(article_url, '') END,
    CASE WHEN file IS NOT NULL THEN 'image/wikimedia-commons/' || coalesce(license, '') || '/https://commons.wikimedia.org/wiki/File:' || url_encode(file) END) AS sources FROM j"""


@query("join_article_places", PLACE)
def places(spark, d):
    p = ops.places(summaries(spark, d), claims(spark, d), image_meta(spark, d))
    shown = F.transform("provenance", lambda x: F.concat_ws("/", x["field"], x["source"], F.coalesce(x["license"], F.lit("")), F.coalesce(x["url"], F.lit(""))))
    return p.withColumn("sources", F.array_join(shown, ";")).drop("provenance")


FLAGS = ["rerank=eco", "predict=historical&rerank=balanced", "predict=historicalX", "a=b&rerank=fast&rerank=eco", "rerank&predict", "", "rerank=comfort&predict=historical=1"]


@query(
    "filter_request_flags",
    "SELECT o_orderkey AS k, o_orderkey % 7 = 1 AS predict, CASE o_orderkey % 7 WHEN 0 THEN 'eco' WHEN 1 THEN 'balanced' WHEN 6 THEN 'comfort' END AS profile, o_orderkey % 3 = 0 AND o_orderkey % 5 <> 0 AND o_totalprice * 100 <= 16777216 AS buffered FROM orders",
)
def request_flags(spark, d):
    k = F.col("o_orderkey")
    q = F.get(F.array(*map(F.lit, FLAGS)), (k % 7).cast("int"))
    length = F.when(k % 5 != 0, F.col("o_totalprice") * 100)
    return bridge.table(spark, d, "orders").select(k.alias("k"), requests.predict_requested(q).alias("predict"), requests.rerank_profile(q).alias("profile"), requests.rerankable(F.when(k % 3 == 0, 200).otherwise(404), length).alias("buffered"))


@query(
    "set_overlays_and_styles",
    "SELECT c_custkey AS k, CASE c_custkey % 4 WHEN 0 THEN 'transit-lines' WHEN 1 THEN 'metro-stations,transit-lines' WHEN 2 THEN 'metro-stations' ELSE '' END AS overlays, "
    "CASE c_custkey % 3 WHEN 0 THEN 'light,dark,transit-light,transit-dark' WHEN 1 THEN 'dark,light' ELSE '' END AS styles, c_custkey % 5 <> 1 AS glyphs FROM customer",
)
def overlays_and_styles(spark, d):
    k = F.col("c_custkey")
    kinds = F.when(k % 4 == 0, F.array(F.lit("transit-lines"), F.lit("bus-lanes"))).when(k % 4 == 1, F.array(F.lit("metro-stations"), F.lit("transit-lines"))).when(k % 4 == 2, F.array(F.lit("x"), F.lit("metro-stations"))).otherwise(F.array().cast("array<string>"))
    styles = F.when(k % 3 == 1, " dark , light,neon").when(k % 3 == 2, "neon")
    glyphs = F.when(k % 5 == 1, False).when(k % 5 == 2, True)
    return bridge.table(spark, d, "customer").select(k.alias("k"), F.array_join(requests.implemented_overlays(kinds), ",").alias("overlays"), F.array_join(requests.bundle_styles(styles), ",").alias("styles"), requests.bundle_part(glyphs).alias("glyphs"))


@query(
    "sink_build_config",
    """SELECT 't' || n_nationkey AS target, '{"osm":[{"source":"' || n_name || '.osm.pbf"}],"transitFeeds":[' || coalesce(f, '') || ']}' AS value FROM nation LEFT JOIN (SELECT s_nationkey, string_agg('{"type":"gtfs","feedId":"f' || lpad(CAST(s_suppkey AS VARCHAR), 9, '0') || '","source":"f' || lpad(CAST(s_suppkey AS VARCHAR), 9, '0') || '.gtfs.zip"}', ',' ORDER BY s_suppkey) AS f FROM supplier GROUP BY s_nationkey) ON s_nationkey = n_nationkey""",
)
def build_config(spark, d):
    feeds = bridge.table(spark, d, "supplier").select(F.concat(F.lit("t"), F.col("s_nationkey").cast("string")).alias("target"), F.concat(F.lit("f"), F.lpad(F.col("s_suppkey").cast("string"), 9, "0")).alias("feed_id"))
    extracts = bridge.table(spark, d, "nation").select(F.concat(F.lit("t"), F.col("n_nationkey").cast("string")).alias("target"), F.concat("n_name", F.lit(".osm.pbf")).alias("osm"))
    return documents.build_config(feeds, extracts)


@query(
    "sink_router_config",
    """WITH u AS (SELECT 't' || s_nationkey AS target, s_suppkey AS pos, 1 AS i, '{"type":"stop-time-updater","feedId":"f' || s_suppkey || '","url":"u' || s_suppkey || '","frequency":"30s","fuzzyTripMatching":true}' AS x FROM supplier WHERE s_suppkey % 2 = 0
UNION ALL SELECT 't' || s_nationkey, s_suppkey, 2, '{"type":"vehicle-positions","feedId":"f' || s_suppkey || '","url":"v' || s_suppkey || '","frequency":"30s"}' FROM supplier WHERE s_suppkey % 3 = 0
UNION ALL SELECT 't' || s_nationkey, s_suppkey, 3, '{"type":"real-time-alerts","feedId":"f' || s_suppkey || '","url":"a' || s_suppkey || '","frequency":"60s"}' FROM supplier WHERE s_suppkey % 5 = 0),
t AS (SELECT DISTINCT 't' || s_nationkey AS target FROM supplier) SELECT target, '{"updaters":[' || coalesce(string_agg(x, ',' ORDER BY pos, i), '') || ']}' AS value FROM t LEFT JOIN u USING (target) GROUP BY target""",
)
def router_config(spark, d):
    k = F.col("s_suppkey")
    channel = lambda n, name, url: F.when(k % n == 0, F.struct(F.lit(name).alias("channel"), F.concat(F.lit(url), k.cast("string")).alias("url")))
    channels = F.filter(F.array(channel(2, "trip-updates", "u"), channel(3, "vehicle-positions", "v"), channel(5, "service-alerts", "a")), lambda x: x.isNotNull())
    feeds = bridge.table(spark, d, "supplier").select(F.concat(F.lit("t"), F.col("s_nationkey").cast("string")).alias("target"), k.alias("pos"), F.concat(F.lit("f"), k.cast("string")).alias("feed_id"), channels.alias("channels"))
    return documents.router_config(feeds)


@query(
    "sink_health",
    """SELECT 't' || n_nationkey AS target, '{"status":"' || CASE WHEN n_nationkey % 2 = 0 AND n_nationkey % 3 <> 0 THEN 'ok' ELSE 'degraded' END || '","version":"1.0","gtfsLoaded":"' || CASE WHEN n_nationkey % 3 <> 0 THEN '2026-01-01T00:00:00Z' ELSE 'unknown' END || '","tilesBuiltAt":' || CASE WHEN n_nationkey % 2 = 0 THEN '"' || n_name || '"' ELSE 'null' END || ',"bootstrappedAt":null}' AS value FROM nation""",
)
def health(spark, d):
    k = F.col("n_nationkey")
    a = bridge.table(spark, d, "nation").select(F.concat(F.lit("t"), k.cast("string")).alias("target"), F.when(k % 2 == 0, F.col("n_name")).alias("tiles_built_at"), F.when(k % 3 != 0, "2026-01-01T00:00:00Z").alias("gtfs_loaded"))
    return documents.health(a, "1.0", None)
