"""Travel modes, profiles and line rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Grams of CO2 for each passenger kilometre.
CO2 = (
    (("WALK", "BICYCLE", "BIKE", "SCOOTER"), 0.0),
    (("RAIL", "TRAIN"), 35.0),
    (("SUBWAY", "METRO"), 30.0),
    (("TRAM", "LIGHT_RAIL", "CABLE_CAR", "FUNICULAR", "GONDOLA"), 30.0),
    (("BUS", "TROLLEYBUS", "COACH"), 95.0),
    (("FERRY",), 120.0),
    (("CAR", "CARPOOL"), 170.0),
)
OTHER_CO2 = 80.0
#: How much of the outside temperature a ride lets through.
TEMPERATURE = ((("RAIL", "TRAIN", "SUBWAY", "METRO"), 0.1), (("BUS", "TROLLEYBUS", "COACH", "TRAM", "LIGHT_RAIL"), 0.4))
OTHER_TEMPERATURE = 0.3
#: Weights of reliability, transfers, walking, carbon and weather.
PROFILES = {
    "reliability": (1.0, 0.0, 0.0, 0.0, 0.0),
    "balanced": (1.0, 0.6, 0.4, 0.6, 0.5),
    "eco": (0.3, 0.3, 0.2, 1.5, 0.2),
    "comfort": (0.5, 1.2, 1.0, 0.2, 1.0),
}
#: Route types of timetable feeds, and colours of metro lines.
ROUTE_TYPES = ((("tram",), 0), (("metro", "subway"), 1), (("rail",), 2), (("water", "ferry"), 4))
METRO_COLOURS = {"A": "#E27439", "B": "#0570B5", "B1": "#0570B5", "C": "#008456"}
OTHER_COLOUR = "#666666"


def lookup(x: Column, table, other) -> Column:
    first, *rest = table
    out = reduce(lambda acc, row: acc.when(x.isin(*row[0]), F.lit(row[1])), rest, F.when(x.isin(*first[0]), F.lit(first[1])))
    return out.otherwise(F.lit(other))


def profile_of(flag: Column) -> Column:
    """The profile that a flag names, null if it names none."""
    return F.when(flag.isin(*PROFILES), flag)


def profile_weights_of(flag: Column) -> list[Column]:
    """The five weights of the profile that a flag names, null if it names none."""
    return [F.try_element_at(F.create_map(*[x for name, w in PROFILES.items() for x in (F.lit(name), F.lit(w[k]))]), flag) for k in range(5)]


def co2_per_km(mode: Column) -> Column:
    return lookup(mode, CO2, OTHER_CO2)


def temperature_coefficient(mode: Column) -> Column:
    return lookup(mode, TEMPERATURE, OTHER_TEMPERATURE)


def route_type(mode: Column) -> Column:
    return lookup(mode, ROUTE_TYPES, 3)


def line_kind(route: Column, ref: Column) -> Column:
    """Draw mode of a relation's route value; null for other values and for subways that are no metro line."""
    return F.when((route == "subway") & is_metro_line(ref), "metro").when(route.isin("tram", "light_rail", "rail", "regional_rail"), route)


def is_metro_line(ref: Column) -> Column:
    return ref.isin("A", "B", "C")


def metro_colour(ref: Column) -> Column:
    return lookup(ref, [((k,), v) for k, v in METRO_COLOURS.items()], OTHER_COLOUR)


def gtfs_key(kind: Column, ref: Column) -> Column:
    """Key under which a line stands in the timetable: metro lines with a prefix."""
    return F.when(kind == "metro", F.concat(F.lit("ME"), ref)).otherwise(ref)


def relabel_branch(ref: Column, slugs: Column) -> Column:
    """B1 for a B line one of whose stops names that branch's end, else null."""
    return F.when((ref == "B") & F.exists(slugs, lambda s: s.contains("jonio") | s.contains("conca")), "B1")


def is_rail_role(role: Column) -> Column:
    return ~role.rlike("^(platform|stop)") & ~role.isin("station", "halt")


def is_transit_leg(transit_leg: Column, route_id: Column) -> Column:
    return F.coalesce(transit_leg, F.lit(True)) & route_id.isNotNull()


def method_label(method: Column) -> Column:
    """The method if it is a common one, else other (I64)."""
    return F.when(method.isin("GET", "POST", "PUT", "PATCH", "DELETE", "HEAD", "OPTIONS"), method).otherwise("OTHER")
