"""Text expressions: slugs, HTML, URLs, article fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Accents that slugs fold.
FOLDED, PLAIN = "àáâèéêìíòóùú", "aaaeeeiioouu"


def slug(x: Column) -> Column:
    """Lower case, some accents folded, other runs as one dash."""
    return F.trim(F.regexp_replace(F.translate(F.lower(x), FOLDED, PLAIN), "[^a-z0-9]+", "-"), F.lit("-"))


def strip_html(x: Column) -> Column:
    """Text without tags; an unclosed tag takes the rest, stray > go as well."""
    return F.regexp_replace(F.regexp_replace(x, r"<[^>]*(>|$)|>", ""), r"^\s+|\s+$", "")


def percent_encode(x: Column) -> Column:
    """RFC 3986 encoding of all but unreserved characters."""
    out = F.url_encode(x)
    for a, b in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def strip_file_prefix(file: Column) -> Column:
    return F.regexp_replace(file, "^File:", "")


def commons_file_url(file: Column, width: Column) -> Column:
    return F.concat(F.lit("https://commons.wikimedia.org/wiki/Special:FilePath/"), percent_encode(strip_file_prefix(file)), F.lit("?width="), width.cast("string"))


def commons_file_page(file: Column) -> Column:
    return F.concat(F.lit("https://commons.wikimedia.org/wiki/File:"), percent_encode(strip_file_prefix(file)))


def csv_field(x: Column) -> Column:
    """Quoted if it holds a comma, a quote or a line end."""
    return F.when(x.rlike("[,\"\r\n]"), F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(x)


def exit_name(name: Column, ref: Column) -> Column:
    return F.coalesce(name, F.concat(F.lit("Uscita "), ref), F.lit("Uscita"))


def trimmed(x: Column) -> Column:
    """Text without white space at its ends; null if nothing is left."""
    return F.nullif(F.regexp_replace(x, r"^\s+|\s+$", ""), F.lit(""))


def coordinate(x: Column) -> Column:
    """A coordinate of 0 means that there is none."""
    return F.nullif(x, F.lit(0.0))


def image_width(width: Column) -> Column:
    """640 by default, within 16 and 2048 (P10)."""
    return F.least(F.greatest(F.coalesce(width, F.lit(640)), F.lit(16)), F.lit(2048))
