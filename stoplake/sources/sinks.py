"""Sinks: partitioned events, tables that are replaced as a whole, feed archives."""

from __future__ import annotations

import csv
import io
import os
import shutil
import uuid
import zlib
from collections.abc import Iterator
from functools import reduce
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stoplake.operators.numbering import drop, numbered, stored
from stoplake.session import ship_package
from stoplake.sources import zipped
from stoplake.sources.storage import store

#: Headers of a feed's members.
MEMBERS = {
    "agency": ("agency_id", "agency_name", "agency_url", "agency_timezone", "agency_lang"),
    "stops": ("stop_id", "stop_name", "stop_lat", "stop_lon"),
    "routes": ("route_id", "agency_id", "route_short_name", "route_long_name", "route_type"),
    "calendar_dates": ("service_id", "date", "exception_type"),
    "trips": ("route_id", "service_id", "trip_id", "trip_headsign", "shape_id"),
    "stop_times": ("trip_id", "arrival_time", "departure_time", "stop_id", "stop_sequence"),
    "shapes": ("shape_id", "shape_pt_lat", "shape_pt_lon", "shape_pt_sequence"),
}


def append_events(events: DataFrame, path: str, batch: str | None = None) -> None:
    """Events by service date and batch (B01, E25). A batch of the same key replaces itself; without a key it is a new one."""
    keyed = events.withColumn("batch", F.lit(batch or uuid.uuid4().hex))
    keyed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("service_date", "batch").parquet(path)


def partition_dates(spark: SparkSession, path: str) -> DataFrame:
    """service_date of each partition of a table that append_events() or replace_dates() wrote (A28); only folders are listed."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/service_date=*")
    found = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(where) or []
    dates = sorted({x.getPath().getName().removeprefix("service_date=") for x in found})
    return spark.createDataFrame([(d,) for d in dates], "service_date string")


def replace_dates(tier1: DataFrame, path: str) -> None:
    """Tier-1 rows in place of those of the same dates; dates without rows keep theirs."""
    tier1.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("service_date").parquet(path)


def tier_lines(tier: DataFrame, key: Column) -> DataFrame:
    """The entries of a JSON map of aggregates by key as texts, each with its key."""
    hist = F.struct(F.array(*[F.col(f"b{i}") for i in range(13)]).alias("bins"))
    one = F.struct(F.col("n").alias("count"), "sum_delay", "sum_delay_sq", F.col("min_delay").alias("min"), F.col("max_delay").alias("max"), "on_time_count", hist.alias("hist"))
    name = F.to_json(F.array(key))
    return tier.select(key.alias("key"), F.concat(name.substr(F.lit(2), F.length(name) - 2), F.lit(":"), F.to_json(one)).alias("entry"))


def write_tier_maps(tier: DataFrame, key: Column, path: str, entries: int = 10_000) -> None:
    """A tier as JSON maps of so many entries at most, in the order of keys, each a file of a folder (B02); no task holds a whole tier."""
    placed = numbered(tier_lines(tier, key), "key").withColumn("part", F.expr(f"(place - 1) div {entries}"))
    maps = placed.groupBy("part").agg(F.sort_array(F.collect_list(F.struct("place", "entry"))).alias("e"))
    lines = maps.select("part", F.concat(F.lit("{"), F.array_join(F.transform("e", lambda x: x["entry"]), ","), F.lit("}")).alias("value"))
    lines.repartitionByRange("part").sortWithinPartitions("part").select("value").write.mode("overwrite").option("maxRecordsPerFile", 1).text(path)


def write_atomic(path: str, content: bytes) -> None:
    """Replace a local file as a whole: readers see the old one or the new one."""
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    held = f"{path}.{os.getpid()}.tmp"
    with open(held, "wb") as f:
        f.write(content)
        f.flush()
        os.fsync(f.fileno())
    os.replace(held, path)


def append_lines(path: str, more: str) -> None:
    """Append a file of lines to another, which gets a line end first if it lacks one (B10); in blocks, never as a whole."""
    with open(path, "r+b") as base, open(more, "rb") as extra:
        size = base.seek(0, os.SEEK_END)
        base.seek(max(size - 1, 0))
        if base.read(1) != b"\n":
            base.write(b"\n")
        shutil.copyfileobj(extra, base)


def places_file(places: DataFrame, path: str) -> None:
    """Addressed places as JSON lines (B08); fields without a value are left out."""
    places.select("id", "name", "category", "address", "city", "brand_wikidata", "lon", "lat").write.mode("overwrite").json(path)


#: Rows of a deflated block; the least compression that readers know, and the empty block that ends a stream.
BLOCK_ROWS, LEVEL, LAST_BLOCK = 20_000, 6, b"\x03\x00"
#: Columns of the widest member.
WIDEST = max(map(len, MEMBERS.values()))


def feed_archive(members: dict[str, DataFrame], path: str) -> dict[str, int]:
    """Write a timetable feed as a zip and give the rows of each member (B04, E24, G06). path: on any store of storage.py.

    Rows are sorted by all columns and numbered over the whole feed. Tasks deflate blocks of BLOCK_ROWS rows, cut by number, so
    the bytes are the same however rows are dealt out. Headers and the directory are made from the blocks' lengths and
    sums, and one task copies the blocks behind one another. Without shapes there is neither that member nor the column of
    trips that names them. Calendar rows count services, shapes their ids.
    """
    spark = members["trips" if "trips" in members else next(iter(members))].sparkSession
    ship_package(spark)
    shapes = "shapes" in members and not members["shapes"].isEmpty()
    headers = {k: tuple(c for c in header if c != "shape_id" or shapes) for k, header in MEMBERS.items() if k in members and (k != "shapes" or shapes)}
    names = list(headers)
    rows = reduce(DataFrame.unionByName, (_cells(members[name].select(*header), names.index(name)) for name, header in headers.items()))
    placed = numbered(rows, "member", *[f"{kind}{i}" for i in range(WIDEST) for kind in "nt"])
    cut = placed.select("member", F.expr(f"(place - 1) div {BLOCK_ROWS}").alias("block"), "place", "cells")

    def deflate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in b.to_pylist())
        for (member, block), run in groupby(rows, lambda r: (r["member"], r["block"])):
            cells = [r["cells"] for r in run]
            text = io.StringIO()
            csv.writer(text, lineterminator="\n").writerows([["" if v is None else v for v in c] for c in cells])
            raw = text.getvalue().encode()
            packer = zlib.compressobj(LEVEL, zlib.DEFLATED, -zlib.MAX_WBITS)
            blob = packer.compress(raw) + packer.flush(zlib.Z_FULL_FLUSH)
            keys = [c[0] for c in cells]
            yield pa.RecordBatch.from_pylist([{"member": member, "block": block, "rows": len(cells), "keys": len(set(keys)), "first": keys[0], "last": keys[-1], "size": len(raw), "crc": zlib.crc32(raw), "packed": len(blob), "blob": blob}])

    schema = "member long, block long, rows long, keys long, first string, last string, size long, crc long, packed long, blob binary"
    blocks = cut.repartition("member", "block").sortWithinPartitions("member", "block", "place").mapInArrow(deflate, schema)
    blocks = stored(blocks, "blocks")
    about = blocks.drop("blob").orderBy("member", "block").collect()  # a row for each BLOCK_ROWS rows
    entries, counts = [], {}
    for k, name in enumerate(names):
        own = [b for b in about if b.member == k]
        head = (",".join(headers[name]) + "\n").encode()
        packer = zlib.compressobj(LEVEL, zlib.DEFLATED, -zlib.MAX_WBITS)
        start = packer.compress(head) + packer.flush(zlib.Z_FULL_FLUSH)
        crc = reduce(lambda c, b: zipped.crc32_joined(c, b.crc, b.size), own, zlib.crc32(head))
        size, packed = len(head) + sum(b.size for b in own), len(start) + sum(b.packed for b in own) + len(LAST_BLOCK)
        entries.append(zipped.Entry(f"{name}.txt", crc, size, packed, start))
        ids = sum(b.keys - (i > 0 and own[i - 1].last == b.first) for i, b in enumerate(own))
        if name == "calendar_dates":
            counts["services"] = ids
        else:
            counts[name] = ids if name == "shapes" else sum(b.rows for b in own)

    def copy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, target = store(path)
        held, done = f"{target}.{uuid.uuid4().hex}.tmp", -1
        with at.open_output_stream(held) as f:
            offsets = zipped.offsets(entries)

            def begin(member: int) -> None:
                nonlocal done
                while done < member:
                    f.write(LAST_BLOCK if done >= 0 else b"")
                    done += 1
                    f.write(zipped.local_header(entries[done]) + entries[done].start)

            for batch in batches:
                for member, blob in zip(batch.column("member").to_pylist(), batch.column("blob").to_pylist()):
                    begin(member)
                    f.write(blob)
            begin(len(entries) - 1)
            f.write(LAST_BLOCK + zipped.directory(entries, offsets))
        at.move(held, target)
        yield pa.RecordBatch.from_pydict({"path": [target]})

    blocks.select("member", "block", "blob").repartition(1).sortWithinPartitions("member", "block").mapInArrow(copy, "path string").collect()
    drop(spark, blocks)
    return counts


def _cells(rows: DataFrame, member: int) -> DataFrame:
    """member, the columns as n0, t0, n1 ... (numbers and texts, for the order of all members alike) and as texts in cells."""
    sorts = []
    for i in range(WIDEST):
        name, kind = rows.dtypes[i] if i < len(rows.columns) else (None, "string")
        own = F.lit(None) if name is None else F.col(name)
        sorts += [(own if kind != "string" else F.lit(None)).cast("double").alias(f"n{i}"), (own if kind == "string" else F.lit(None)).cast("string").alias(f"t{i}")]
    return rows.select(F.lit(member).alias("member"), *sorts, F.array(*[F.col(c).cast("string") for c in rows.columns]).alias("cells"))
