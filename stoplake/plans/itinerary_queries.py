"""Queries of itineraries."""

from __future__ import annotations

from pyspark.sql import functions as F

from stoplake.functions import weather as wx
from stoplake.functions.geo import rounded
from stoplake.functions.modes import PROFILES, co2_per_km, profile_of, profile_weights_of, temperature_coefficient
from stoplake.operators import itineraries as ops
from stoplake.operators import reliability as rel
from stoplake.plans import bridge
from stoplake.plans.bridge import quantile_sql, with_sql
from stoplake.plans.registry import query
from stoplake.plans.reliability_queries import R, on_time_index, steady, tier2, typical_delay_index

LEGS = with_sql("legs")
CO2 = "CASE WHEN mode IN ('WALK', 'BICYCLE', 'BIKE', 'SCOOTER') THEN 0 WHEN mode IN ('RAIL', 'TRAIN') THEN 35 WHEN mode IN ('SUBWAY', 'METRO', 'TRAM', 'LIGHT_RAIL', 'CABLE_CAR', 'FUNICULAR', 'GONDOLA') THEN 30 WHEN mode IN ('BUS', 'TROLLEYBUS', 'COACH') THEN 95 WHEN mode = 'FERRY' THEN 120 WHEN mode IN ('CAR', 'CARPOOL') THEN 170 ELSE 80 END"
TEMP = "CASE WHEN mode IN ('RAIL', 'TRAIN', 'SUBWAY', 'METRO') THEN 0.1::DOUBLE WHEN mode IN ('BUS', 'TROLLEYBUS', 'COACH', 'TRAM', 'LIGHT_RAIL') THEN 0.4::DOUBLE ELSE 0.3::DOUBLE END"
TRANSIT = "(coalesce(transit_leg, true) AND route_id IS NOT NULL)"
LOCAL = lambda c: f"CASE WHEN strpos({c}, ':') > 0 THEN substr({c}, strpos({c}, ':') + 1) ELSE {c} END"
KEYED = f"""keyed AS (SELECT *, {TRANSIT} AS is_transit, CASE WHEN {TRANSIT} AND stop_id IS NOT NULL THEN {LOCAL('route_id')} END AS key_route,
  CASE WHEN {TRANSIT} AND stop_id IS NOT NULL THEN coalesce(direction_id, 0) END AS key_direction, CASE WHEN {TRANSIT} AND stop_id IS NOT NULL THEN {LOCAL('stop_id')} END AS key_stop FROM legs)"""
SEGMENTS = f"""gaps AS (SELECT *, lag(end_ms) OVER (PARTITION BY plan_id, itin_idx ORDER BY leg_idx) AS prev_end FROM keyed),
seg AS (
  SELECT plan_id, itin_idx, leg_idx, lat, lon, prev_end AS at_ms, (start_ms - prev_end) / 1000 AS precip_s, (start_ms - prev_end) / 1000 AS temp_s FROM gaps WHERE start_ms > prev_end
  UNION ALL SELECT plan_id, itin_idx, leg_idx, lat, lon, start_ms, duration_s, duration_s FROM gaps WHERE mode = 'WALK' AND duration_s > 0
  UNION ALL SELECT plan_id, itin_idx, leg_idx, lat, lon, start_ms, 0, duration_s * {TEMP} FROM gaps WHERE mode <> 'WALK' AND is_transit AND duration_s > 0
), cells AS (SELECT *, CAST(round(lat * 100) AS BIGINT) AS q_lat, CAST(round(lon * 100) AS BIGINT) AS q_lon, CAST(extract(hour FROM make_timestamp(CAST(at_ms AS BIGINT) * 1000)) AS INTEGER) AS utc_hour,
  strftime(make_timestamp(CAST(at_ms AS BIGINT) * 1000), '%Y-%m-%d') AS utc_date FROM seg)"""
RAMP = lambda x, full, worst: f"CASE WHEN {x} > 0 THEN least({x} / {full}::DOUBLE, 1) * {worst}::DOUBLE ELSE 0 END"
BAD = f"""bad0 AS (SELECT *, {RAMP('precip_mm', 4, 0.9)} AS rain, coalesce({RAMP('uv', 8, 0.25)}, 0) AS u, coalesce({RAMP('wind_kmh', 40, 0.25)}, 0) AS w,
  CASE WHEN coalesce(felt_c, air_c) < 5 THEN least((5 - coalesce(felt_c, air_c)) / 10, 1) * 0.6::DOUBLE WHEN coalesce(felt_c, air_c) > 30 THEN least((coalesce(felt_c, air_c) - 30) / 8, 1) * 0.6::DOUBLE ELSE 0 END AS th FROM fc),
bad AS (SELECT *, least(1, greatest(th, u, w) + (u + w) / 2) AS temp FROM bad0)"""
PENALTY = f"""pen AS (SELECT plan_id, itin_idx, CAST(round(sum(CAST(rain * precip_s / 60 + temp * temp_s / 60 AS DECIMAL(26,7))), 3) AS DOUBLE) AS weather_penalty FROM cells JOIN bad USING (q_lat, q_lon, utc_hour, utc_date) GROUP BY ALL)"""
INDEX = bridge.SQL["ev"] + ", " + bridge.SQL["tier"]
FACTORS = f"""idx AS (SELECT route_id AS r, direction_id AS d, stop_id AS s, sum(on_time_count) / sum(n) AS rate FROM t2 GROUP BY ALL),
fac AS (SELECT plan_id, itin_idx, coalesce(CAST(sum(CAST(rate AS DECIMAL(34,15))) AS DOUBLE) / count(rate), 0.5) AS reliability, CAST(count(*) FILTER (is_transit) AS DOUBLE) AS transfers, coalesce(sum(duration_s) FILTER (mode = 'WALK' AND NOT is_transit), 0) AS walk_s,
  sum(CASE WHEN distance_m > 0 THEN ({CO2}) * (distance_m / 1000) ELSE 0 END) AS co2_g FROM keyed LEFT JOIN idx ON r = key_route AND d = key_direction AND s = key_stop GROUP BY ALL),
raw AS (SELECT fac.*, coalesce(weather_penalty, 0) AS weather_penalty FROM fac LEFT JOIN pen USING (plan_id, itin_idx)),
stable AS (SELECT plan_id, itin_idx, {', '.join(f'{R(c)} AS {c}' for c in ('reliability', 'transfers', 'walk_s', 'co2_g'))}, {R('weather_penalty', 3)} AS weather_penalty FROM raw)"""
ALL = f"WITH {bridge.SQL['legs']}, {KEYED}, {SEGMENTS}, {bridge.SQL['fc']}, {BAD}, {PENALTY}, {INDEX}, {FACTORS}"


def legs(spark, d):
    return bridge.legs(spark, d)


def of_stops(spark, d, index, *columns):
    return ops.index_of_stops(index, bridge.leg_stops(spark, d), list(columns))


@query("filter_transit_legs", f"{LEGS}, {KEYED} SELECT plan_id, itin_idx, leg_idx, is_transit, coalesce(real_time, false) AS live, key_route, key_direction, key_stop FROM keyed")
def transit_legs(spark, d):
    return ops.keyed(legs(spark, d)).select("plan_id", "itin_idx", "leg_idx", "is_transit", F.coalesce("real_time", F.lit(False)).alias("live"), "key_route", "key_direction", "key_stop")


@query("join_leg_on_time", f"WITH {bridge.SQL['legs']}, {KEYED}, {INDEX}, i AS (SELECT route_id AS r, direction_id AS d, stop_id AS s, {R('sum(on_time_count) / sum(n)')} AS on_time_rate FROM t2 GROUP BY ALL) SELECT plan_id, itin_idx, leg_idx, on_time_rate FROM keyed LEFT JOIN i ON r = key_route AND d = key_direction AND s = key_stop")
def leg_on_time(spark, d):
    return ops.with_index(ops.keyed(legs(spark, d)), of_stops(spark, d, on_time_index(spark, d), "on_time_rate"), ["on_time_rate"]).select("plan_id", "itin_idx", "leg_idx", "on_time_rate")


@query("win_wait_segments", f"{LEGS}, {KEYED}, {SEGMENTS} SELECT plan_id, itin_idx, leg_idx, CAST(at_ms AS BIGINT) AS at_ms, {R('precip_s')} AS precip_s, {R('temp_s')} AS temp_s, CASE WHEN lat IS NOT NULL THEN q_lat END AS q_lat, CASE WHEN lat IS NOT NULL THEN q_lon END AS q_lon, CASE WHEN lat IS NOT NULL THEN utc_hour END AS utc_hour, CASE WHEN lat IS NOT NULL THEN utc_date END AS utc_date FROM cells")
def wait_segments(spark, d):
    return steady(ops.segments(legs(spark, d)).select("plan_id", "itin_idx", "leg_idx", F.col("at_ms").cast("long").alias("at_ms"), "precip_s", "temp_s", "key.*"))


@query("agg_exposure", f"{LEGS}, {KEYED}, {SEGMENTS} SELECT plan_id, itin_idx, {R('coalesce(sum(precip_s), 0)')} AS precip_s, {R('coalesce(sum(temp_s), 0)')} AS temp_s FROM (SELECT DISTINCT plan_id, itin_idx FROM legs) LEFT JOIN seg USING (plan_id, itin_idx) GROUP BY ALL")
def exposure(spark, d):
    return steady(ops.exposure(legs(spark, d)))


@query("agg_weather_penalty_single", f"{LEGS}, {KEYED}, {SEGMENTS} SELECT plan_id, itin_idx, {R('0.9::DOUBLE * coalesce(sum(precip_s), 0) / 60 + 0.06::DOUBLE * coalesce(sum(temp_s), 0) / 60')} AS penalty FROM (SELECT DISTINCT plan_id, itin_idx FROM legs) LEFT JOIN seg USING (plan_id, itin_idx) GROUP BY ALL")
def penalty_single(spark, d):
    """One forecast for all: 9 mm of rain, 6 degrees felt as 4."""
    x = F.lit
    temp = wx.temp_badness(wx.felt_temperature(x(6.0), x(4.0)), x(None).cast("double"), x(None).cast("double"))
    return ops.exposure(legs(spark, d)).select("plan_id", "itin_idx", rounded(ops.penalty(F.col("precip_s"), F.col("temp_s"), wx.precip_badness(x(9.0)), temp), 6).alias("penalty"))


@query("join_weather_penalty", f"WITH {bridge.SQL['legs']}, {KEYED}, {SEGMENTS}, {bridge.SQL['fc']}, {BAD}, {PENALTY} SELECT plan_id, itin_idx, {R('coalesce(weather_penalty, 0)', 3)} AS weather_penalty FROM (SELECT DISTINCT plan_id, itin_idx FROM legs) LEFT JOIN pen USING (plan_id, itin_idx)")
def weather_penalty(spark, d):
    return thousandths(ops.weather_penalty(legs(spark, d), bridge.forecast(spark, d)))


def thousandths(df):
    """Penalties in exact decimals: many of them end in half a thousandth, which a scaled double misses."""
    return df.withColumn("weather_penalty", F.round(F.col("weather_penalty").cast("decimal(26,7)"), 3).cast("double"))


@query("agg_itinerary_factors", f"{ALL} SELECT * FROM stable")
def factors(spark, d):
    return thousandths(steady(ops.factors_in_weather(legs(spark, d), of_stops(spark, d, rel.on_time_index(tier2(spark, d)), "on_time_rate"), bridge.forecast(spark, d))))


BENEFIT = lambda c, up: f"CASE WHEN max({c}) OVER w > min({c}) OVER w THEN {'' if up else '1 - '}({c} - min({c}) OVER w) / (max({c}) OVER w - min({c}) OVER w) ELSE 0.5 END"
NAMES = ("reliability", "transfers", "walk_s", "co2_g", "weather_penalty")


@query("win_minmax_benefit", f"{ALL} SELECT plan_id, itin_idx, {', '.join(R(BENEFIT(c, c == 'reliability')) + f' AS {c}_benefit' for c in NAMES)} FROM stable WINDOW w AS (PARTITION BY plan_id)")
def minmax_benefit(spark, d):
    return steady(factors(spark, d).select("plan_id", "itin_idx", *[ops.benefit(c, c == "reliability").alias(f"{c}_benefit") for c in NAMES]))


def _rank_sql(profile: str) -> str:
    score = " + ".join(f"{w}::DOUBLE * {c}_b" for w, c in zip(PROFILES[profile], NAMES))
    return (
        f"{ALL}, ben AS (SELECT plan_id, itin_idx, reliability, {', '.join(BENEFIT(c, c == 'reliability') + f' AS {c}_b' for c in NAMES)} FROM stable WINDOW w AS (PARTITION BY plan_id)), "
        f"sc AS (SELECT plan_id, itin_idx, reliability, {score} AS score FROM ben) "
        f"SELECT plan_id, itin_idx, {R('reliability', 4)} AS reliability_score, {R('score', 4)} AS rerank_score, CAST(row_number() OVER (PARTITION BY plan_id ORDER BY score DESC, itin_idx) AS INTEGER) AS rank FROM sc"
    )


for _profile in PROFILES:
    query(f"sort_rerank_{_profile}", _rank_sql(_profile))(lambda spark, d, p=_profile: ops.rerank(factors(spark, d), p))


@query("agg_sample_points", f"{LEGS}, {KEYED}, {SEGMENTS}, one AS (SELECT DISTINCT plan_id, q_lat, q_lon, utc_hour, utc_date FROM cells WHERE lat IS NOT NULL), k AS (SELECT *, CAST(row_number() OVER (PARTITION BY plan_id ORDER BY q_lat, q_lon, utc_hour, utc_date NULLS FIRST) AS INTEGER) AS k FROM one) SELECT * FROM k WHERE k <= 8")
def sample_points(spark, d):
    return ops.sample_points(legs(spark, d))


@query("join_missing_forecasts", f"WITH {bridge.SQL['legs']}, {KEYED}, {SEGMENTS}, {bridge.SQL['fc']} SELECT DISTINCT q_lat, q_lon, utc_hour, utc_date FROM cells c WHERE lat IS NOT NULL AND NOT EXISTS (SELECT 1 FROM fc WHERE fc.q_lat = c.q_lat AND fc.q_lon = c.q_lon AND fc.utc_hour = c.utc_hour AND fc.utc_date = c.utc_date)")
def missing_forecasts(spark, d):
    return ops.missing_cells(ops.segments(legs(spark, d)).filter("key IS NOT NULL").select("key.*"), bridge.forecast(spark, d))


@query("agg_fetch_cells", f"{LEGS}, {KEYED}, {SEGMENTS} SELECT q_lat, q_lon, min(itin_idx * 10 + leg_idx) AS first_pos, (SELECT min(utc_date) FROM cells WHERE lat IS NOT NULL) AS first_date, (SELECT max(utc_date) FROM cells WHERE lat IS NOT NULL) AS last_date FROM cells WHERE lat IS NOT NULL GROUP BY q_lat, q_lon")
def fetch_cells(spark, d):
    rows = ops.segments(legs(spark, d)).filter("key IS NOT NULL")
    return ops.fetch_cells(rows.select((F.col("itin_idx") * 10 + F.col("leg_idx")).alias("pos"), "key.q_lat", "key.q_lon", "key.utc_date"))


ANNOTATED = f"""WITH {bridge.SQL['legs']}, {KEYED}, {INDEX}, c AS (SELECT route_id AS r, direction_id AS d, stop_id AS s, n, {quantile_sql(0.5)} AS p50, {quantile_sql(0.85)} AS p85 FROM t2),
td AS (SELECT r, d, s, {R('sum(p50 * n) / sum(n)')} AS p50_s, {R('sum(p85 * n) / sum(n)')} AS p85_s, CAST(sum(n) AS BIGINT) AS n FROM c GROUP BY ALL),
an AS (SELECT plan_id, itin_idx, leg_idx, {R('p85_s', 1)} AS seconds, {R('p50_s', 1)} AS p50_seconds, n AS sample_count, 'historical' AS source FROM keyed JOIN td ON r = key_route AND d = key_direction AND s = key_stop WHERE real_time IS DISTINCT FROM true)"""


@query("join_annotate_legs", f"{ANNOTATED} SELECT * FROM an")
def annotate_legs(spark, d):
    return ops.annotate_legs(legs(spark, d), of_stops(spark, d, typical_delay_index(spark, d), "p50_s", "p85_s", "n"))


@query("agg_annotation_summary", f"{ANNOTATED} SELECT plan_id, itin_idx, count(*) AS annotated_legs, max(seconds) AS worst_seconds FROM an GROUP BY ALL")
def annotation_summary(spark, d):
    return ops.annotation_summary(annotate_legs(spark, d))


@query("scalar_mode_tables", f"{LEGS} SELECT DISTINCT mode, CAST({CO2} AS DOUBLE) AS co2, {TEMP} AS coefficient FROM legs")
def mode_tables(spark, d):
    return legs(spark, d).select("mode", co2_per_km(F.col("mode")).alias("co2"), temperature_coefficient(F.col("mode")).alias("coefficient")).distinct()


@query("scalar_weather_badness", f"WITH {bridge.SQL['fc']}, {BAD} SELECT q_lat, q_lon, utc_hour, utc_date, {R('rain')} AS rain, {R('th')} AS thermal, {R('u')} AS uv, {R('w')} AS wind, {R('temp')} AS temp, {R('least(1, greatest(rain, temp) + least(rain, temp) / 2)')} AS badness FROM bad")
def weather_badness(spark, d):
    felt = wx.felt_temperature(F.col("air_c"), F.col("felt_c"))
    rain, temp = wx.precip_badness(F.col("precip_mm")), wx.temp_badness(felt, F.col("uv"), F.col("wind_kmh"))
    f = bridge.forecast(spark, d)
    return steady(f.select("q_lat", "q_lon", "utc_hour", "utc_date", rain.alias("rain"), wx.thermal_badness(felt).alias("thermal"), wx.uv_badness(F.col("uv")).alias("uv"), wx.wind_badness(F.col("wind_kmh")).alias("wind"), temp.alias("temp"), wx.badness(rain, temp).alias("badness")))


PROFILE_OF = "CASE o_orderpriority WHEN '1-URGENT' THEN 'reliability' WHEN '2-HIGH' THEN 'balanced' WHEN '3-MEDIUM' THEN 'eco' WHEN '4-NOT SPECIFIED' THEN 'comfort' ELSE 'fastest' END"
WEIGHTS = "('reliability', 1.0, 0.0, 0.0, 0.0, 0.0), ('balanced', 1.0, 0.6, 0.4, 0.6, 0.5), ('eco', 0.3, 0.3, 0.2, 1.5, 0.2), ('comfort', 0.5, 1.2, 1.0, 0.2, 1.0)"


@query("scalar_profile_weights", f"SELECT o_orderkey AS request, profile, a::DOUBLE AS reliability, b::DOUBLE AS transfers, c::DOUBLE AS walk, d::DOUBLE AS eco, e::DOUBLE AS weather FROM (SELECT o_orderkey, {PROFILE_OF} AS flag FROM orders) LEFT JOIN (VALUES {WEIGHTS}) t(profile, a, b, c, d, e) ON flag = profile")
def profile_weights(spark, d):
    """Each order asks for a ranking by a flag; a flag that is not known has no profile."""
    o = bridge.table(spark, d, "orders").select(F.col("o_orderkey").alias("request"), F.expr(PROFILE_OF).alias("flag"))
    return o.select("request", profile_of(F.col("flag")).alias("profile"), *[x.alias(n) for n, x in zip(("reliability", "transfers", "walk", "eco", "weather"), profile_weights_of(F.col("flag")))])


@query("agg_tier2_cells_per_plan", f"WITH {bridge.SQL['legs']}, {KEYED}, {INDEX} SELECT plan_id, count(*) AS cells FROM keyed JOIN t2 ON t2.route_id = key_route AND t2.direction_id = key_direction AND t2.stop_id = key_stop GROUP BY ALL")
def cells_per_plan(spark, d):
    t = tier2(spark, d).select("route_id", "direction_id", "stop_id", F.lit(1).alias("one"))
    return ops.with_index(ops.keyed(legs(spark, d)), t, ["one"]).filter("one = 1").groupBy("plan_id").agg(F.count(F.lit(1)).alias("cells"))
