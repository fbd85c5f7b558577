"""Identifier and key expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stoplake.functions.calendar import DAY_TYPES, TOD_TOKENS


def sanitize_token(token: Column) -> Column:
    """Letters, digits, _ and - stay; other bytes become + and two hex digits; empty becomes _."""
    pairs = F.regexp_extract_all(F.hex(F.encode(token, "UTF-8")), F.lit("(..)"), F.lit(1))

    def show(h: Column) -> Column:
        c = F.char(F.conv(h, 16, 10).cast("int"))
        return F.when(c.rlike("^[A-Za-z0-9_-]$"), c).otherwise(F.concat(F.lit("+"), h))

    return F.when(token == "", "_").otherwise(F.array_join(F.transform(pairs, show), ""))


def desanitize_token(token: Column) -> Column:
    """The inverse; null for text that sanitize_token() never gives."""
    sound = token.rlike(r"^(?:[A-Za-z0-9_-]|\+[0-9A-F]{2})*$")
    return F.when(sound, F.try_url_decode(F.replace(token, F.lit("+"), F.lit("%"))))


def tier2_key(route: Column, direction: Column, stop: Column, tod: Column, day_type: Column) -> Column:
    return F.concat_ws("/", sanitize_token(route), direction.cast("string"), sanitize_token(stop), tod, day_type)


def tier1_key(route: Column, direction: Column, stop: Column, date: Column, tod: Column) -> Column:
    return F.concat_ws("/", sanitize_token(route), direction.cast("string"), sanitize_token(stop), date, tod)


def parse_tier1_key(key: Column) -> Column:
    """route, direction, stop, service_date, tod of a key; null if it is not one."""
    p = F.split(key, "/")
    out = F.struct(
        desanitize_token(F.get(p, 0)).alias("route_id"),
        F.get(p, 1).try_cast("int").alias("direction_id"),
        desanitize_token(F.get(p, 2)).alias("stop_id"),
        F.get(p, 3).alias("service_date"),
        F.get(p, 4).alias("tod"),
    )
    return F.when((F.size(p) == 5) & F.get(p, 1).try_cast("int").isNotNull() & F.get(p, 4).isin(*TOD_TOKENS), out)


def split_stop_key(key: Column) -> Column:
    """route, direction, stop of a Tier-2 key; null if it is not one."""
    p = F.split(key, "/")
    out = F.struct(desanitize_token(F.get(p, 0)).alias("route_id"), F.get(p, 1).try_cast("int").alias("direction_id"), desanitize_token(F.get(p, 2)).alias("stop_id"))
    return F.when((F.size(p) == 5) & F.get(p, 1).try_cast("int").isNotNull() & F.get(p, 3).isin(*TOD_TOKENS) & F.get(p, 4).isin(*DAY_TYPES), out)


def local_id(gtfs_id: Column) -> Column:
    """Text after the first colon, or all of it."""
    return F.when(F.instr(gtfs_id, ":") > 0, F.substr(gtfs_id, F.instr(gtfs_id, ":") + 1)).otherwise(gtfs_id)


def netex_id(xml_id: Column) -> Column:
    """What follows the third colon, its colons as underscores; with fewer, all of it."""
    p = F.split(xml_id, ":")
    return F.when(F.size(p) > 3, F.concat_ws("_", F.slice(p, F.lit(4), F.greatest(F.size(p) - 3, F.lit(1))))).otherwise(F.replace(xml_id, F.lit(":"), F.lit("_")))


def is_station_id(x: Column) -> Column:
    return x.rlike("^S[0-9]+$")


def valid_request_id(x: Column) -> Column:
    return x.rlike("^[A-Za-z0-9_-]{1,128}$")


def trace_id(traceparent: Column) -> Column:
    """Second field of a trace header in lower case, unless it is malformed or all zero."""
    t = F.lower(F.get(F.split(traceparent, "-"), 1))
    return F.when(t.rlike("^[0-9a-f]{32}$") & ~t.rlike("^0+$"), t)


def valid_glyph_range(x: Column) -> Column:
    return x.rlike(r"^[0-9]+-[0-9]+\.pbf$")


def unsafe_component(x: Column) -> Column:
    return (x == "") | x.contains("..") | x.contains("/") | x.contains("\\")
