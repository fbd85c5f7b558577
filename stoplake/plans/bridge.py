"""Deterministic projections of the synthetic tables to the domain, and the same as DuckDB SQL.

Each function gives a DataFrame; SQL holds a common table expression of the same rows by name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, d: str) -> DataFrame:
    return events_of(table(spark, d, "events"))


def events_of(rows: DataFrame) -> DataFrame:
    """Delay events of rows of the events table, a batch or a stream."""
    return rows.select(
        F.col("event_type").alias("route_id"),
        (F.col("user_id") % 2).cast("int").alias("direction_id"),
        F.col("user_id").cast("string").alias("stop_id"),
        F.date_format("ts", "yyyyMMdd").alias("service_date"),
        (F.floor(F.col("value") * 20).cast("int") - 400).alias("delay_s"),
        F.hour("ts").alias("feed_hour"),
    )


def legs(spark: SparkSession, d: str) -> DataFrame:
    """A plan is a customer, an itinerary an order, a leg a line item."""
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    line = table(spark, d, "lineitem")
    mode = F.col("l_partkey") % 6
    # line numbers repeat within an order: legs are numbered anew
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate", "l_discount", "l_tax")
    line = line.withColumn("leg_idx", F.row_number().over(order))
    j = line.join(o, line.l_orderkey == o.o_orderkey)
    start = F.unix_millis(F.col("l_shipdate").cast("timestamp")).cast("double") + F.col("l_linenumber") * F.lit(5_400_000.0)
    names = F.when(mode == 0, "WALK").when(mode == 1, "BUS").when(mode == 2, "TRAM").when(mode == 3, "SUBWAY").when(mode == 4, "RAIL").otherwise("FERRY")
    return j.select(
        F.col("o_custkey").alias("plan_id"),
        F.col("l_orderkey").alias("itin_idx"),
        "leg_idx",
        names.alias("mode"),
        F.col("l_extendedprice").alias("distance_m"),
        (F.col("l_quantity") * 60).alias("duration_s"),
        start.alias("start_ms"),
        (start + F.col("l_quantity") * F.lit(60000.0)).alias("end_ms"),
        F.when(F.col("l_returnflag") == "R", True).when(F.col("l_returnflag") == "A", False).alias("real_time"),
        *leg_stop_columns(),
        F.when(F.col("l_partkey") % 7 != 0, F.lit(41.0) + (F.col("l_suppkey") % 20) / F.lit(16.0)).alias("lat"),
        (F.lit(12.0) + (F.col("l_suppkey") % 30) / F.lit(16.0)).alias("lon"),
    )


def leg_stop_columns() -> list[Column]:
    """Where a line item's leg begins and on which route."""
    walk = F.col("l_partkey") % 6 == 0
    kinds = ["signup", "purchase", "view", "click", "error"]
    return [
        F.when(walk, False).when(F.col("l_linestatus") == "O", True).alias("transit_leg"),
        F.when(~walk, F.concat(F.lit("FEED:"), F.get(F.array(*map(F.lit, kinds)), (F.col("l_suppkey") % 5).cast("int")))).alias("route_id"),
        F.when(F.col("l_linenumber") > 1, (F.col("l_partkey") % 2).cast("int")).alias("direction_id"),
        F.concat(F.lit("F:"), (F.col("l_partkey") % 150).cast("string")).alias("stop_id"),
    ]


def leg_stops(spark: SparkSession, d: str) -> DataFrame:
    """Stops and routes of all line items, whether or not they have an order."""
    # 6 and 2 divide 150: remainders and flags decide all of it, so texts are made for those that differ
    kinds = table(spark, d, "lineitem").select((F.col("l_partkey") % 150).alias("l_partkey"), (F.col("l_suppkey") % 5).alias("l_suppkey"), F.when(F.col("l_linenumber") > 1, 2).alias("l_linenumber"), "l_linestatus")
    return kinds.distinct().select(*leg_stop_columns())


def forecast(spark: SparkSession, d: str) -> DataFrame:
    """Cells of the legs' grid with values from the id of the place and the hour: of each day the hours 1 to 9, others are missing."""
    day = table(spark, d, "lineitem").select(F.date_format("l_shipdate", "yyyy-MM-dd").alias("utc_date")).distinct()
    hours = F.explode(F.sequence(F.lit(1), F.lit(9))).alias("utc_hour")
    cells = day.select("utc_date", hours).withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(59))))
    n = F.col("s") + F.col("utc_hour") + F.substring("utc_date", 9, 2).cast("int")
    return cells.select(
        F.round((F.lit(41.0) + (F.col("s") % 20) / F.lit(16.0)) * 100).cast("long").alias("q_lat"),
        F.round((F.lit(12.0) + (F.col("s") % 30) / F.lit(16.0)) * 100).cast("long").alias("q_lon"),
        "utc_hour",
        "utc_date",
        (n % 50 - 8).cast("double").alias("air_c"),
        F.when(n % 3 != 0, (n % 50 - 10).cast("double")).alias("felt_c"),
        ((n % 9) / F.lit(2.0)).alias("precip_mm"),
        F.when(n % 4 != 0, (n % 11).cast("double")).alias("uv"),
        F.when(n % 5 != 0, ((n * 7) % 60).cast("double")).alias("wind_kmh"),
    )  # 60 steps of 20 and 30 places are 60 cells


def addresses(spark: SparkSession, d: str) -> DataFrame:
    p, c = table(spark, d, "part"), table(spark, d, "nation")
    j = p.join(c, (p.p_partkey % 25) == c.n_nationkey)
    return j.select(
        F.concat(F.lit("a:"), F.col("p_partkey").cast("string")).alias("id"),
        F.when(F.col("p_size") % 10 != 0, F.concat(F.lit("Via "), F.col("p_brand"))).alias("street"),
        F.when(F.col("p_size") % 7 != 0, F.col("p_size").cast("string")).alias("number"),
        F.when(F.col("p_partkey") % 4 != 0, F.col("n_name")).alias("postal_city"),
        F.col("n_nationkey").cast("string").alias("postcode"),
        (F.lit(12.0) + F.col("p_size") / F.lit(64.0)).alias("lon"),
        (F.lit(41.5) + F.col("n_nationkey") / F.lit(32.0)).alias("lat"),
    )


def places(spark: SparkSession, d: str) -> DataFrame:
    """Places with nested names, categories, addresses and brand."""
    a = addresses(spark, d)
    freeform = F.concat(F.lit("V.le "), F.substring("street", 5, 20), F.lit(", "), F.col("number"), F.when(F.length("number") == 1, "/A").otherwise(""))
    k = F.substring("id", 3, 20).cast("long")
    return a.select(
        "id",
        F.struct(F.when(k % 11 != 0, F.concat(F.lit("Place "), F.col("id"))).alias("primary")).alias("names"),
        F.struct(F.lit("shop").alias("primary")).alias("categories"),
        F.array(F.struct(freeform.alias("freeform"), F.col("postal_city").alias("locality"))).alias("addresses"),
        F.struct(F.when(k % 3 == 0, F.concat(F.lit("Q"), (k % 40).cast("string"))).alias("wikidata")).alias("brand"),
        "lon",
        "lat",
    )


SQL = {
    "ev": """ev AS (SELECT event_type AS route_id, CAST(user_id % 2 AS INTEGER) AS direction_id, CAST(user_id AS VARCHAR) AS stop_id,
  strftime(ts, '%Y%m%d') AS service_date, CAST(floor(value * 20) AS INTEGER) - 400 AS delay_s, CAST(extract(hour FROM ts) AS INTEGER) AS feed_hour FROM events)""",
    "legs": """legs AS (SELECT o_custkey AS plan_id, l_orderkey AS itin_idx, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate, l_discount, l_tax) AS INTEGER) AS leg_idx,
  CASE l_partkey % 6 WHEN 0 THEN 'WALK' WHEN 1 THEN 'BUS' WHEN 2 THEN 'TRAM' WHEN 3 THEN 'SUBWAY' WHEN 4 THEN 'RAIL' ELSE 'FERRY' END AS mode,
  l_extendedprice AS distance_m, l_quantity * 60 AS duration_s,
  CAST(epoch_ms(l_shipdate) AS DOUBLE) + l_linenumber * 5400000.0::DOUBLE AS start_ms,
  CAST(epoch_ms(l_shipdate) AS DOUBLE) + l_linenumber * 5400000.0::DOUBLE + l_quantity * 60000.0::DOUBLE AS end_ms,
  CASE l_returnflag WHEN 'R' THEN true WHEN 'A' THEN false END AS real_time,
  CASE WHEN l_partkey % 6 = 0 THEN false WHEN l_linestatus = 'O' THEN true END AS transit_leg,
  CASE WHEN l_partkey % 6 <> 0 THEN 'FEED:' || (['signup', 'purchase', 'view', 'click', 'error'])[l_suppkey % 5 + 1] END AS route_id,
  CASE WHEN l_linenumber > 1 THEN CAST(l_partkey % 2 AS INTEGER) END AS direction_id,
  'F:' || CAST(l_partkey % 150 AS VARCHAR) AS stop_id,
  CASE WHEN l_partkey % 7 <> 0 THEN 41.0::DOUBLE + (l_suppkey % 20) / 16.0::DOUBLE END AS lat, 12.0::DOUBLE + (l_suppkey % 30) / 16.0::DOUBLE AS lon
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)""",
    "fc": """fc AS (SELECT DISTINCT CAST(round((41.0::DOUBLE + (s % 20) / 16.0::DOUBLE) * 100) AS BIGINT) AS q_lat, CAST(round((12.0::DOUBLE + (s % 30) / 16.0::DOUBLE) * 100) AS BIGINT) AS q_lon,
  CAST(h AS INTEGER) AS utc_hour, utc_date, CAST(k % 50 - 8 AS DOUBLE) AS air_c, CASE WHEN k % 3 <> 0 THEN CAST(k % 50 - 10 AS DOUBLE) END AS felt_c,
  (k % 9) / 2.0::DOUBLE AS precip_mm, CASE WHEN k % 4 <> 0 THEN CAST(k % 11 AS DOUBLE) END AS uv, CASE WHEN k % 5 <> 0 THEN CAST((k * 7) % 60 AS DOUBLE) END AS wind_kmh
  FROM (SELECT utc_date, h, s, s + h + CAST(substr(utc_date, 9, 2) AS INTEGER) AS k FROM (SELECT DISTINCT strftime(l_shipdate, '%Y-%m-%d') AS utc_date FROM lineitem) , range(1, 10) hh(h), range(60) ss(s)))""",
    "addr": """addr AS (SELECT 'a:' || p_partkey AS id, CASE WHEN p_size % 10 <> 0 THEN 'Via ' || p_brand END AS street, CASE WHEN p_size % 7 <> 0 THEN CAST(p_size AS VARCHAR) END AS number,
  CASE WHEN p_partkey % 4 <> 0 THEN n_name END AS postal_city, CAST(n_nationkey AS VARCHAR) AS postcode,
  12.0::DOUBLE + p_size / 64.0::DOUBLE AS lon, 41.5::DOUBLE + n_nationkey / 32.0::DOUBLE AS lat, p_partkey AS k FROM part JOIN nation ON p_partkey % 25 = n_nationkey)""",
    "poi": """poi AS (SELECT id, CASE WHEN k % 11 <> 0 THEN 'Place ' || id END AS name, 'shop' AS category,
  'V.le ' || substr(street, 5, 20) || ', ' || number || CASE WHEN length(number) = 1 THEN '/A' ELSE '' END AS address,
  postal_city AS city, CASE WHEN k % 3 = 0 THEN 'Q' || (k % 40) END AS brand_wikidata, lon, lat FROM addr)""",
    # Tier-1 and Tier-2 of the plausible events
    "tier": """t1 AS (SELECT route_id, direction_id, stop_id, service_date,
  CASE WHEN feed_hour < 0 THEN 'night' WHEN feed_hour <= 5 THEN 'early' WHEN feed_hour <= 8 THEN 'am-peak' WHEN feed_hour <= 14 THEN 'midday' WHEN feed_hour <= 18 THEN 'pm-peak' WHEN feed_hour <= 21 THEN 'evening' ELSE 'night' END AS tod,
  count(*) AS n, CAST(sum(delay_s) AS BIGINT) AS sum_delay, CAST(sum(CAST(delay_s AS BIGINT) * delay_s) AS DECIMAL(38,0)) AS sum_delay_sq, min(delay_s) AS min_delay, max(delay_s) AS max_delay,
  count(*) FILTER (delay_s BETWEEN -60 AND 300) AS on_time_count, """
    + ", ".join(
        f"count(*) FILTER ({cond}) AS b{i}"
        for i, cond in enumerate(
            ["delay_s <= -300"]
            + [f"delay_s > {a} AND delay_s <= {b}" for a, b in zip((-300, -120, -60, 0, 60, 120, 180, 300, 600, 900, 1800), (-120, -60, 0, 60, 120, 180, 300, 600, 900, 1800, 3600))]
            + ["delay_s > 3600"]
        )
    )
    + """ FROM ev WHERE abs(delay_s) <= 7200 GROUP BY ALL),
typed AS (SELECT *, CASE WHEN strftime(dt, '%m-%d') IN ('01-01','01-06','04-25','05-01','06-02','08-15','11-01','12-08','12-25','12-26') OR dt = DATE '2024-04-01' OR isodow(dt) = 7 THEN 'sunday-holiday'
  WHEN isodow(dt) = 6 THEN 'saturday' ELSE 'weekday' END AS day_type FROM (SELECT *, CAST(strptime(service_date, '%Y%m%d') AS DATE) AS dt FROM t1)),
t2 AS (SELECT route_id, direction_id, stop_id, tod, day_type, CAST(sum(n) AS BIGINT) AS n, CAST(sum(sum_delay) AS BIGINT) AS sum_delay, CAST(sum(sum_delay_sq) AS DECIMAL(38,0)) AS sum_delay_sq,
  min(min_delay) AS min_delay, max(max_delay) AS max_delay, CAST(sum(on_time_count) AS BIGINT) AS on_time_count, """
    + ", ".join(f"CAST(sum(b{i}) AS BIGINT) AS b{i}" for i in range(13))
    + " FROM typed GROUP BY ALL)",
}


def quantile_sql(q: float) -> str:
    """The histogram percentile as a DuckDB expression over b0 to b12 and n, by running sums in a list."""
    edges = "[-300, -120, -60, 0, 60, 120, 180, 300, 600, 900, 1800, 3600, 3600]"
    bins = "[" + ", ".join(f"b{i}" for i in range(13)) + "]"
    low = f"CASE WHEN k = 1 THEN -300 ELSE ({edges})[k - 1] END"
    upto = f"list_sum(({bins})[1:k])"
    return (
        f"(SELECT ({low})::DOUBLE + ((({edges})[k]) - ({low}))::DOUBLE * (({q}::DOUBLE * n - ({upto} - ({bins})[k])) / ({bins})[k]) "
        f"FROM range(1, 14) r(k) WHERE ({bins})[k] > 0 AND {upto} >= {q}::DOUBLE * n ORDER BY k LIMIT 1)"
    )


def with_sql(*names: str) -> str:
    return "WITH " + ",\n".join(SQL[n] for n in names)
