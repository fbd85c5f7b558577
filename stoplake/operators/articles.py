"""Places out of encyclopedia articles: documents that were fetched, parsed and joined.

Documents are JSON texts; fields of another type than expected count as missing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stoplake.functions.text import commons_file_page, percent_encode, strip_html

SUMMARY = """title variant, displaytitle variant, description variant, extract variant, wikibase_item variant, thumbnail struct<source: variant>,
  content_urls struct<desktop: struct<page: variant>>, coordinates struct<lon: variant, lat: variant>"""
ENTITY = "entities map<string, struct<claims: map<string, array<struct<mainsnak: struct<datavalue: struct<value: variant>>>>>, sitelinks: map<string, struct<title: variant>>>>"
IMAGE = "query struct<pages: map<string, struct<imageinfo: array<struct<extmetadata: map<string, struct<value: variant>>>>>>>"
#: Fixed value: width of a place's image.
IMAGE_WIDTH = 640


def text_of(v: Column) -> Column:
    """A JSON value that is a text, else null."""
    return F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))


def number_of(v: Column) -> Column:
    """A JSON value that is a number, else null."""
    return F.when(~F.schema_of_variant(v).isin("STRING", "BOOLEAN", "VOID"), F.try_variant_get(v, "$", "double"))


def summaries(docs: DataFrame) -> DataFrame:
    """Fields of article summaries (I50). docs: lang, title (asked for), body."""
    s = docs.select("lang", F.col("title").alias("asked"), F.from_json("body", SUMMARY).alias("s"))
    get = lambda c: text_of(F.col(f"s.{c}"))
    extract = get("extract")
    return s.select(
        "lang", "asked", F.coalesce(get("title"), strip_html(get("displaytitle")), F.lit("")).alias("title"), get("description").alias("description"), F.when(extract.rlike(r"\S"), extract).alias("summary"), get("wikibase_item").alias("qid"),
        get("thumbnail.source").alias("thumb"), get("content_urls.desktop.page").alias("article_url"), number_of(F.col("s.coordinates.lon")).alias("lon"), number_of(F.col("s.coordinates.lat")).alias("lat"),
    )


def claims(entities: DataFrame, prop: str) -> DataFrame:
    """The first claim of a property whose value is a text (I51). entities: qid, body; value is null without one."""
    e = entities.select("qid", F.try_element_at(F.from_json("body", ENTITY)["entities"], F.col("qid")).alias("e"))
    first = F.get(F.try_element_at(F.col("e.claims"), F.lit(prop)), F.lit(0))
    return e.select("qid", text_of(first["mainsnak"]["datavalue"]["value"]).alias("value"))


def sitelinks(wanted: DataFrame, entities: DataFrame) -> DataFrame:
    """Article of each wanted(lang, qid), in its language or else in English; none drops the row (D21). entities: qid, body."""
    e = entities.select("qid", F.try_element_at(F.from_json("body", ENTITY)["entities"], F.col("qid"))["sitelinks"].alias("links"))
    j = wanted.join(e, "qid")
    title = lambda lang: text_of(F.try_element_at(F.col("links"), F.concat(lang, F.lit("wiki")))["title"])
    own, english = title(F.col("lang")), title(F.lit("en"))
    return j.select("qid", F.col("lang").alias("wanted_lang"), F.when(own.isNotNull(), F.col("lang")).otherwise("en").alias("lang"), F.coalesce(own, english).alias("title")).filter("title IS NOT NULL")


def image_meta(docs: DataFrame) -> DataFrame:
    """Licence, author and attribution of files (I52). docs: file, body; the first page counts; no page drops the row."""
    info = F.get(F.get(F.map_values(F.from_json("body", IMAGE)["query"]["pages"]), F.lit(0))["imageinfo"], F.lit(0))["extmetadata"]
    m = docs.select("file", info.alias("m")).filter("m IS NOT NULL")
    get = lambda k: strip_html(text_of(F.try_element_at(F.col("m"), F.lit(k))["value"]))
    return m.select("file", get("LicenseShortName").alias("license"), get("Artist").alias("author"), F.coalesce(get("Attribution"), get("Credit")).alias("attribution"))


def targets(requests: DataFrame, default_lang: str = "it") -> DataFrame:
    """What each request asks for, or why it cannot be read (I54). requests: id, lang, wikipedia, title, wikidata.

    wikipedia is lang:Title and comes first, then title, then wikidata.
    """
    w, lang = F.col("wikipedia"), F.coalesce("lang", F.lit(default_lang))
    parted = w.contains(":")
    error = F.when(w.isNotNull() & ~parted, "wikipedia must be 'lang:Title'").when(F.coalesce(w, F.col("title"), F.col("wikidata")).isNull(), "provide one of: wikidata, wikipedia, title")
    article = F.when(w.isNotNull(), F.substr(w, F.instr(w, ":") + 1)).otherwise(F.col("title"))
    out = requests.select("id", error.alias("error"), F.when(w.isNotNull(), F.substring_index(w, ":", 1)).otherwise(lang).alias("_l"), article.alias("_t"), F.when(article.isNull(), F.col("wikidata")).alias("_q"))
    key = F.concat_ws("|", "_l", F.coalesce("_t", F.lit("")), F.coalesce("_q", F.lit("")))
    sound = lambda c: F.when(F.col("error").isNull(), c)
    return out.select("id", "error", sound(F.col("_l")).alias("lang"), sound(F.col("_t")).alias("title"), sound(F.col("_q")).alias("qid"), sound(key).alias("cache_key"))


def proxied_image(file: Column) -> Column:
    return F.concat(F.lit("/places/image?file="), percent_encode(file), F.lit(f"&width={IMAGE_WIDTH}"))


def places(found: DataFrame, images: DataFrame, metas: DataFrame) -> DataFrame:
    """A place for each summary with coordinates (I53). images: qid, value (claim of a picture); metas: image_meta().

    The claimed picture comes first, then the summary's thumbnail. Provenance names the source of each field.
    """
    j = found.filter("lon IS NOT NULL").join(images.filter("value IS NOT NULL").select("qid", F.col("value").alias("file")), "qid", "left").join(metas, "file", "left")
    claimed = F.col("file").isNotNull()
    source = lambda field, name, licence, url: F.struct(F.lit(field).alias("field"), F.lit(name).alias("source"), licence.alias("license"), url.alias("url"))
    none = F.lit(None).cast("string")
    told = F.array(
        F.when(F.col("description").isNotNull(), source("description", "wikidata", F.lit("CC0"), none)),
        F.when(F.col("summary").isNotNull(), source("summary", "wikipedia", F.lit("CC-BY-SA"), F.col("article_url"))),
        F.when(claimed, source("image", "wikimedia-commons", F.col("license"), commons_file_page(F.col("file")))),
    )
    return j.select(
        F.coalesce(F.concat(F.lit("wd:"), F.col("qid")), F.concat(F.lit("wp:"), F.col("lang"), F.lit(":"), F.col("asked"))).alias("id"), F.col("title").alias("name"), "lang", "lon", F.coalesce("lat", F.lit(0.0)).alias("lat"), "description", "summary",
        F.when(claimed, proxied_image(F.col("file"))).otherwise(F.col("thumb")).alias("image"), claimed.alias("proxied"), *[F.when(claimed, F.col(c)).alias(c) for c in ("license", "author", "attribution")], F.filter(told, lambda x: x.isNotNull()).alias("provenance"),
    )
