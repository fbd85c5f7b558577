"""Request flags and options: Column to Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stoplake.functions.modes import profile_of

#: Largest plan that is buffered; overlays that can be built; styles of an offline bundle.
MAX_BODY_BYTES = 16 * 1024 * 1024
OVERLAYS = ("transit-lines", "metro-stations")
STYLES = ("light", "dark", "transit-light", "transit-dark")


def flags(query: Column, name: str) -> Column:
    """All values of a flag in a raw query string, in order; parts without an equals sign are none."""
    parts = F.filter(F.split(query, "&"), lambda p: p.contains("="))
    hit = F.filter(parts, lambda p: F.substring_index(p, "=", 1) == name)
    return F.transform(hit, lambda p: F.substr(p, F.lit(len(name) + 2)))


def predict_requested(query: Column) -> Column:
    """Whether a query string asks for historical delays, by the exact word."""
    return F.coalesce(F.array_contains(flags(query, "predict"), "historical"), F.lit(False))


def rerank_profile(query: Column) -> Column:
    """The profile that the first rerank flag names, null if it names none."""
    return profile_of(F.get(flags(query, "rerank"), F.lit(0)))


def rerankable(status: Column, length: Column) -> Column:
    """Whether a plan response is buffered: a 200 of known length within the cap."""
    return F.coalesce((status == 200) & (length <= MAX_BODY_BYTES), F.lit(False))


def implemented_overlays(kinds: Column, known: tuple[str, ...] = OVERLAYS) -> Column:
    """The declared overlay kinds that can be built, in their order."""
    return F.filter(kinds, lambda k: k.isin(*known))


def bundle_styles(styles: Column) -> Column:
    """Known styles of a comma-separated list, all of them without a list."""
    chosen = F.filter(F.transform(F.split(styles, ","), lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: s.isin(*STYLES))
    return F.when(styles.isNull(), F.array(*map(F.lit, STYLES))).otherwise(chosen)


def bundle_part(wanted: Column) -> Column:
    """Whether a part of a bundle is in it: yes unless it is refused."""
    return F.coalesce(wanted, F.lit(True))
