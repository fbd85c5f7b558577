"""Weather badness expressions. All inputs are doubles; null and non-finite values count as no weather."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stoplake.functions.geo import quantize

#: Ramps of the weather factor.
RAIN_FULL_MM, RAIN_WORST = 4.0, 0.9
COMFORT_LOW, COMFORT_HIGH, COLD_FULL, HEAT_FULL, THERMAL_WORST = 5.0, 30.0, -5.0, 38.0, 0.6
UV_FULL, UV_WORST = 8.0, 0.25
WIND_FULL_KMH, WIND_WORST = 40.0, 0.25


def d(x: float) -> Column:
    return F.lit(float(x))


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < d(float("inf")))


def ramp(x: Column, full: float, worst: float) -> Column:
    """0 for what is not positive, worst from full on, in proportion between."""
    return F.when(finite(x) & (x > 0), F.least(x / d(full), d(1)) * d(worst)).otherwise(d(0))


def precip_badness(mm: Column) -> Column:
    return ramp(mm, RAIN_FULL_MM, RAIN_WORST)


def felt_temperature(air: Column, apparent: Column) -> Column:
    return F.coalesce(apparent, air)


def thermal_badness(felt: Column) -> Column:
    cold = F.least((d(COMFORT_LOW) - felt) / d(COMFORT_LOW - COLD_FULL), d(1)) * d(THERMAL_WORST)
    heat = F.least((felt - d(COMFORT_HIGH)) / d(HEAT_FULL - COMFORT_HIGH), d(1)) * d(THERMAL_WORST)
    return F.when(~finite(felt), d(0)).when(felt < COMFORT_LOW, cold).when(felt > COMFORT_HIGH, heat).otherwise(d(0))


def uv_badness(uv: Column) -> Column:
    return ramp(uv, UV_FULL, UV_WORST)


def wind_badness(kmh: Column) -> Column:
    return ramp(kmh, WIND_FULL_KMH, WIND_WORST)


def temp_badness(felt: Column, uv: Column, kmh: Column) -> Column:
    u, w = uv_badness(uv), wind_badness(kmh)
    return F.least(d(1), F.greatest(thermal_badness(felt), u, w) + (u + w) / d(2))


def badness(rain: Column, temp: Column) -> Column:
    return F.least(d(1), F.greatest(rain, temp) + F.least(rain, temp) / d(2))


def sample_key(lat: Column, lon: Column, time_ms: Column) -> Column:
    """Cell, UTC hour and date of a point; null without finite coordinates, hour 0 and no date without time."""
    at = F.timestamp_millis(time_ms.cast("long"))
    out = F.struct(
        quantize(lat).alias("q_lat"),
        quantize(lon).alias("q_lon"),
        F.coalesce(F.hour(at), F.lit(0)).alias("utc_hour"),
        F.date_format(at, "yyyy-MM-dd").alias("utc_date"),
    )
    return F.when(finite(lat) & finite(lon), out)
