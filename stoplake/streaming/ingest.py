"""Streaming: feed files or polls to events, the periodic roll-up, and a watermarked variant."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from stoplake.functions.calendar import civil_date, tod_bucket
from stoplake.operators import reliability
from stoplake.sources import gtfs_rt, sinks
from stoplake.streaming.polls import TIMEOUT_S, polled


def feed_stream(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """Derived events of feed files as they arrive."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("maxFilesPerTrigger", files_per_trigger).load(path)
    return reliability.derive_events(gtfs_rt.decode(files))


def poll_stream(spark: SparkSession, url: str, journal: str, timeout: float = TIMEOUT_S) -> DataFrame:
    """Derived events of a feed that is fetched once for each trigger (A02, K02); journal: a shared folder of the stream's own."""
    return reliability.derive_events(polled(spark, url, journal, timeout))


def start_ingest(events: DataFrame, table: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Append sound events to a table partitioned by service date and batch; trigger as for DataStreamWriter.trigger.

    The key of a batch is its number after the stream's own id, which Spark keeps in the checkpoint. A batch that is run again after a
    failure therefore replaces what it wrote before: every event is there once.
    """
    sound = events.filter(~F.col("dropped")).drop("dropped")

    def put(batch: DataFrame, number: int) -> None:
        stream = batch.sparkSession.read.json(f"{checkpoint}/metadata").first()["id"]
        sinks.append_events(batch, table, f"{stream}-{number:012d}")

    return sound.writeStream.option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "30 seconds"})).foreachBatch(put).start()


EVENTS = "route_id string, direction_id int, stop_id string, delay_s int, feed_hour int, service_date string, batch string"


def roll_up(spark: SparkSession, events_path: str, tier1_path: str, dates: list[str]) -> DataFrame:
    """Fold the events of some dates anew into Tier 1 and rebuild Tier 2 from all of it.

    Dates are partitions, so only theirs are read. Late events count as long as their date is folded again.
    """
    events = spark.read.schema(EVENTS).parquet(events_path)
    folded = reliability.fold_tier1(reliability.plausible(events.filter(F.col("service_date").isin(dates))))
    sinks.replace_dates(folded, tier1_path)
    return reliability.rebuild_tier2(spark.read.schema(folded.schema).parquet(tier1_path))


def windowed_fold(events: DataFrame, delay: str = "2 days") -> DataFrame:
    """Tier-1 moments with a watermark on the service date: an extension, since late events are dropped after delay."""
    timed = events.withColumn("day", civil_date(F.col("service_date")).cast("timestamp")).withColumn("tod", tod_bucket(F.col("feed_hour")))
    return timed.withWatermark("day", delay).groupBy(F.window("day", "1 day"), *reliability.STOP, "tod").agg(*reliability.observe())
