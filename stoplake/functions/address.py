"""Address keys: two records share an address if their bucket keys are equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Accents that are folded.
FOLDED, PLAIN = "àáâäèéêëìíîïòóôöùúûüç", "aaaaeeeeiiiioooouuuuc"
#: Street types and their short forms.
STREET_TYPES = {
    "via": ("via", "v"),
    "viale": ("viale", "vle", "vl"),
    "piazza": ("piazza", "pza", "pzza", "pa", "p"),
    "piazzale": ("piazzale", "pzle", "ple"),
    "corso": ("corso", "cso", "c"),
    "largo": ("largo", "lgo"),
    "vicolo": ("vicolo", "vlo"),
    "strada": ("strada", "str"),
    "borgo": ("borgo", "bgo"),
    "lungotevere": ("lungotevere", "lgt", "lungotev"),
    "salita": ("salita",),
    "galleria": ("galleria", "gall"),
    "circonvallazione": ("circonvallazione", "circ"),
}
NO_NUMBER = "__snc__"


def ascii_lower(x: Column) -> Column:
    """Lower case of A to Z alone."""
    return F.translate(x, UPPER, LOWER)


def clean(x: Column) -> Column:
    """Lower case, accents folded, dots dropped, other marks as one blank."""
    folded = F.translate(ascii_lower(x), FOLDED + ".", PLAIN)
    return F.trim(F.regexp_replace(folded, r"[^\p{L}\p{N}]+", " "))


def canonical_type(token: Column) -> Column:
    out = F.when(F.lit(False), token)
    for full, short in STREET_TYPES.items():
        out = out.when(token.isin(*short), F.lit(full))
    return out.otherwise(token)


def normal_street(c: Column) -> Column:
    """A cleaned street with a leading street type in full."""
    head = F.substring_index(c, " ", 1)
    return F.concat(canonical_type(head), F.substr(c, F.length(head) + 1))


def house_number(c: Column) -> Column:
    """number and red of a cleaned number (I43): rosso or a separate r at the end is a colour; none is a mark of its own."""
    rosso, r = c.endswith("rosso"), c.endswith(" r")
    body = F.when(rosso, F.trim(F.regexp_replace(c, "rosso$", ""))).when(r, F.regexp_replace(c, " r$", "")).otherwise(c)
    none = (c == "") | (c == "snc")
    return F.struct(F.when(none, NO_NUMBER).otherwise(F.replace(body, F.lit(" "), F.lit(""))).alias("number"), (~none & (rosso | r)).alias("red"))


def italian_bucket(street: Column, number: Column, city: Column) -> Column:
    """Bucket of cleaned parts."""
    n = house_number(number)
    return F.concat(city, F.lit("|"), normal_street(street), F.lit("|"), n["number"], F.when(n["red"], F.lit("|rosso")).otherwise(F.lit("")))


def squash(x: Column) -> Column:
    return F.trim(F.regexp_replace(ascii_lower(x), r"[^\p{L}\p{N}]+", " "))


def generic_bucket(street: Column, number: Column, city: Column) -> Column:
    """Bucket of squashed parts."""
    return F.concat_ws("|", city, street, number)


def split_freeform(text: Column) -> Column:
    """street and number of a free-form address; number is null if the last word does not begin with a digit."""
    t = F.regexp_replace(F.trim(text), "[, ]+$", "")
    pattern = "^(.*?)[ ,]+([0-9][^ ,]*)$"
    return F.struct(F.coalesce(F.nullif(F.regexp_extract(t, pattern, 1), F.lit("")), t).alias("street"), F.nullif(F.regexp_extract(t, pattern, 2), F.lit("")).alias("number"))


#: Rules by country (L01, L05); others get the generic ones.
NORMALIZERS: dict[str, tuple[Callable[[Column], Column], Callable[[Column, Column, Column], Column]]] = {"italy": (clean, italian_bucket)}
GENERIC = (squash, generic_bucket)


def clean_for(country: str) -> Callable[[Column], Column]:
    """How a country's rules clean each part of an address."""
    return NORMALIZERS.get(country, GENERIC)[0]


def bucket_for(country: str) -> Callable[[Column, Column, Column], Column]:
    """How a country's rules put cleaned street, number and city together."""
    return NORMALIZERS.get(country, GENERIC)[1]
