"""Trip-update feeds: the protobuf subset that delay aggregation needs, decoded by field number."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from stoplake.session import ship_package

SCHEMA = "entity string, route_id string, start_date string, direction_id int, stop_id string, departure_delay int, arrival_delay int, trip_delay int, header_ts long"


def varint(raw: bytes, at: int) -> tuple[int, int]:
    shift = value = 0
    while True:
        b = raw[at]
        value |= (b & 0x7F) << shift
        at += 1
        if b < 0x80:
            return value, at
        shift += 7


def fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of a message; fixed-width fields are skipped over."""
    at = 0
    while at < len(raw):
        key, at = varint(raw, at)
        number, kind = key >> 3, key & 7
        if kind == 0:
            value, at = varint(raw, at)
            yield number, value
        elif kind == 2:
            size, at = varint(raw, at)
            yield number, raw[at : at + size]
            at += size
        elif kind in (1, 5):
            at += 8 if kind == 1 else 4
        else:
            raise ValueError(f"wire type {kind}")


def signed(value: int) -> int:
    """A 32-bit signed integer out of a varint."""
    value &= 0xFFFFFFFF
    return value - (1 << 32) if value >= 1 << 31 else value


def delay_of(raw: bytes) -> int | None:
    return next((signed(v) for n, v in fields(raw) if n == 1), None)


def flatten(raw: bytes) -> list[tuple]:
    """A row for each stop-time update of each trip update that has a trip; other entities are left out."""
    header_ts, rows = None, []
    for n, v in fields(raw):
        if n == 1:
            header_ts = next((x for k, x in fields(v) if k == 3), None)
    for n, v in fields(raw):
        if n != 2:
            continue
        entity = dict(fields(v))
        update = entity.get(3)
        if update is None:
            continue
        parts = list(fields(update))
        trip = next((dict(fields(x)) for k, x in parts if k == 1), None)
        if trip is None:
            continue
        text = lambda d, k: d[k].decode("utf-8", "replace") if isinstance(d.get(k), bytes) else None
        trip_delay = next((signed(x) for k, x in parts if k == 5), None)
        for k, x in parts:
            if k == 2:
                stop = dict(fields(x))
                arrival, departure = (delay_of(stop[i]) if i in stop else None for i in (2, 3))
                rows.append((text(entity, 1), text(trip, 5), text(trip, 3), trip.get(6), text(stop, 4), departure, arrival, trip_delay, header_ts))
    return rows


def decode(files: DataFrame) -> DataFrame:
    """Rows of feeds (A01) in a binaryFile DataFrame, batch or stream; a feed that cannot be read gives none: see unreadable()."""
    ship_package(files.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int64()]
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        for batch in batches:
            rows = []
            for raw in batch.column("content").to_pylist():
                try:
                    rows += flatten(raw)
                except (ValueError, IndexError, TypeError):  # fail soft, as for any external input
                    continue
            cols = list(zip(*rows)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)

    return files.select("content").mapInArrow(work, SCHEMA)


def unreadable(files: DataFrame) -> DataFrame:
    """path of each feed in a binaryFile DataFrame that cannot be read."""
    ship_package(files.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bad = []
            for path, raw in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                try:
                    flatten(raw)
                except (ValueError, IndexError, TypeError):
                    bad.append(path)
            yield pa.RecordBatch.from_arrays([pa.array(bad, pa.string())], names=["path"])

    return files.select("path", "content").mapInArrow(work, "path string")


def read(spark: SparkSession, path: str) -> DataFrame:
    return decode(spark.read.format("binaryFile").load(path))
