"""Delay observations to mergeable aggregates and their readouts.

Everything is sums, minima and maxima of plain columns, so partial aggregation happens before each
shuffle and a route or stop with a third of all events is one row for each task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stoplake.functions.calendar import day_type, tod_bucket
from stoplake.functions.geo import rounded

#: Delays beyond this are garbage; the window that counts as on time; upper edges of the bins.
MAX_ABS_DELAY_S = 7200
ON_TIME = (-60, 300)
BIN_EDGES_S = (-300, -120, -60, 0, 60, 120, 180, 300, 600, 900, 1800, 3600)
BINS = [f"b{i}" for i in range(len(BIN_EDGES_S) + 1)]
STOP = ["route_id", "direction_id", "stop_id"]
TIER1_KEY = [*STOP, "service_date", "tod"]
TIER2_KEY = [*STOP, "tod", "day_type"]
MOMENTS = ["n", "sum_delay", "sum_delay_sq", "min_delay", "max_delay", "on_time_count", *BINS]


def on_time(delay: Column) -> Column:
    return delay.between(*ON_TIME)


def plausible(events: DataFrame) -> DataFrame:
    """Events without garbage delays; exactly two hours is kept."""
    return events.filter(F.abs("delay_s") <= MAX_ABS_DELAY_S)


def bin_of(delay: Column) -> Column:
    """First bin whose upper edge is not below the delay."""
    out = F.when(delay <= BIN_EDGES_S[0], 0)
    for i, edge in enumerate(BIN_EDGES_S[1:], 1):
        out = out.when(delay <= edge, i)
    return out.otherwise(len(BIN_EDGES_S))


def observe(delay: str = "delay_s") -> list[Column]:
    """Aggregates of raw delays."""
    d = F.col(delay)
    which = bin_of(d)
    return [
        F.count(F.lit(1)).alias("n"),
        F.sum(d.cast("long")).alias("sum_delay"),
        F.sum((d.cast("long") * d.cast("long")).cast("decimal(38,0)")).cast("decimal(38,0)").alias("sum_delay_sq"),
        F.min(d).alias("min_delay"),
        F.max(d).alias("max_delay"),
        F.count_if(on_time(d)).alias("on_time_count"),
        *[F.count_if(which == i).alias(b) for i, b in enumerate(BINS)],
    ]


def merge() -> list[Column]:
    """Aggregates of aggregates."""
    total = {"sum_delay_sq": F.sum("sum_delay_sq").cast("decimal(38,0)"), "min_delay": F.min("min_delay"), "max_delay": F.max("max_delay")}
    return [total.get(c, F.sum(c)).alias(c) for c in MOMENTS]


def fold_tier1(events: DataFrame) -> DataFrame:
    """Events of whole service dates to one row for each key and date (E07); not an upsert."""
    return events.withColumn("tod", tod_bucket(F.col("feed_hour"))).groupBy(*TIER1_KEY).agg(*observe())


def rebuild_tier2(tier1: DataFrame) -> DataFrame:
    """All Tier-1 rows by day type instead of date; a date that cannot be read counts as a weekday."""
    typed = tier1.withColumn("day_type", F.coalesce(day_type(F.col("service_date")), F.lit("weekday")))
    return typed.groupBy(*TIER2_KEY).agg(*merge())


UPTO = [f"_upto{i}" for i in range(len(BINS))]


def with_running_sums(tier: DataFrame) -> DataFrame:
    """tier with the observations up to each bin as columns, each made from the one before."""
    out = tier.withColumn(UPTO[0], F.col(BINS[0]))
    for b, before, upto in zip(BINS[1:], UPTO, UPTO[1:]):
        out = out.withColumn(upto, F.col(before) + F.col(b))
    return out


def quantile(q: float) -> Column:
    """Linear interpolation within the bins; the outer bins are points; null without observations.

    For rows of with_running_sums().
    """
    total = F.col(UPTO[-1])
    need = F.lit(min(max(q, 0.0), 1.0)) * total
    low = [BIN_EDGES_S[0], *BIN_EDGES_S]
    high = [*BIN_EDGES_S, BIN_EDGES_S[-1]]
    out = F.when(total == 0, F.lit(None).cast("double"))
    for b, before, upto, lo, hi in zip(BINS, [None, *UPTO], UPTO, low, high):
        ahead = F.col(before) if before else F.lit(0).cast("long")
        out = out.when((F.col(b) > 0) & (F.col(upto) >= need), F.lit(float(lo)) + F.lit(float(hi - lo)) * ((need - ahead) / F.col(b)))
    return out


def readout(tier: DataFrame) -> DataFrame:
    """Keys of a tier with n, percentiles, on-time rate and mean; all null where n is 0."""
    keys = [c for c in tier.columns if c not in MOMENTS]
    n = F.col("n")
    rate = lambda x: F.when(n > 0, x / n)
    return with_running_sums(tier).select(*keys, "n", *[quantile(q).alias(f"p{int(100 * q)}_s") for q in (0.5, 0.85, 0.9)], rate(F.col("on_time_count")).alias("on_time_rate"), rate(F.col("sum_delay")).alias("mean_s"))


def overview(tier2: DataFrame) -> DataFrame:
    """Number of keys and the readout of all merged."""
    return readout(tier2.agg(F.count(F.lit(1)).alias("keys"), *merge()))


def on_time_index(tier2: DataFrame) -> DataFrame:
    """Share of observations on time for each stop of a route; stops without any are left out."""
    sums = tier2.groupBy(*STOP).agg(F.sum("on_time_count").alias("_on"), F.sum("n").alias("n")).filter("n > 0")
    return sums.select(*STOP, (F.col("_on") / F.col("n")).alias("on_time_rate"), "n")


def typical_delay_index(tier2: DataFrame) -> DataFrame:
    """Mean of the cells' percentiles, weighted by their counts, for each stop of a route."""
    cells = readout(tier2).filter("n > 0")
    mean = lambda c: F.sum(F.col(c) * F.col("n")) / F.sum("n")
    return cells.groupBy(*STOP).agg(mean("p50_s").alias("p50_s"), mean("p85_s").alias("p85_s"), F.sum("n").alias("n"))


def stop_cells(tier2: DataFrame, route_id: str, direction_id: int, stop_id: str) -> DataFrame:
    """Readouts of one stop, by bucket and day type in the order of their names."""
    one = tier2.filter((F.col("route_id") == route_id) & (F.col("direction_id") == direction_id) & (F.col("stop_id") == stop_id))
    return readout(one).orderBy("tod", "day_type")


def cell(tier2: DataFrame, route_id: str, direction_id: int, stop_id: str, tod: str, kind: str) -> DataFrame:
    """Readout of one key."""
    return stop_cells(tier2, route_id, direction_id, stop_id).filter((F.col("tod") == tod) & (F.col("day_type") == kind))


def cell_response(cells: DataFrame) -> DataFrame:
    """Cells under the names that clients read (B16); seconds to one decimal, rates to four."""
    return cells.select(
        F.col("tod").alias("todBucket"),
        F.col("day_type").alias("dayType"),
        F.col("n").alias("sampleCount"),
        rounded(F.col("on_time_rate"), 4).alias("onTimeRate"),
        *[rounded(F.col(c), 1).alias(a) for c, a in (("p50_s", "p50S"), ("p85_s", "p85S"), ("p90_s", "p90S"), ("mean_s", "meanS"))],
    )


def expired_dates(dates: DataFrame, today: str, keep_days: int = 10) -> DataFrame:
    """Service dates older than keep_days before today; dates that cannot be read stay, as do all if today cannot."""
    from stoplake.functions.calendar import civil_date

    first = F.date_sub(civil_date(F.lit(today)), keep_days)
    return dates.filter(civil_date(F.col("service_date")) < first).select("service_date").distinct()


def derive_events(updates: DataFrame) -> DataFrame:
    """Flattened feed rows to events and why others were dropped.

    updates: entity, route_id, start_date, direction_id, stop_id, departure_delay, arrival_delay, trip_delay,
    header_ts. The result has the event columns and dropped (boolean).
    """
    from stoplake.functions.calendar import local_hour

    delay = F.coalesce("departure_delay", "arrival_delay", "trip_delay")
    sound = F.col("route_id").isNotNull() & F.col("start_date").isNotNull() & F.col("stop_id").isNotNull() & delay.isNotNull() & (F.abs(delay) <= MAX_ABS_DELAY_S)
    return updates.select(
        "route_id",
        F.coalesce("direction_id", F.lit(0)).alias("direction_id"),
        "stop_id",
        F.col("start_date").alias("service_date"),
        delay.alias("delay_s"),
        local_hour(F.col("header_ts")).alias("feed_hour"),
        (~sound).alias("dropped"),
    )
