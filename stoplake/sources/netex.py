"""Timetable documents in XML: the element types that a feed needs, in one pass over the file and in document order.

A file is cut into ranges of bytes. A task takes the elements whose start tag begins in its range, reads on to the
end of the last one, and gives each element its place in the document as ordinal, so that of elements
with one id the last can be told whatever task read it. A compressed file is one range.
"""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from stoplake.session import ship_package
from stoplake.sources.storage import files_under, store

#: The element types.
TAGS = ("Operator", "Line", "ScheduledStopPoint", "DayType", "UicOperatingPeriod", "DayTypeAssignment", "ServiceJourneyPattern", "ServiceJourney")
SCHEMA = """tag string, ordinal long, id string, name string, short_name string, mode string, lon double, lat double, days string, from_date string, to_date string, bits string, period_ref string, day_ref string,
line_ref string, points array<struct<id: string, seq: int, stop_ref: string>>, times array<struct<point_ref: string, arrival: string, departure: string>>"""
_POINT = pa.struct([("id", pa.string()), ("seq", pa.int32()), ("stop_ref", pa.string())])
_TIME = pa.struct([("point_ref", pa.string()), ("arrival", pa.string()), ("departure", pa.string())])
ARROW = pa.schema(
    [("tag", pa.string()), ("ordinal", pa.int64()), *((c, pa.string()) for c in ("id", "name", "short_name", "mode")), ("lon", pa.float64()), ("lat", pa.float64())]
    + [(c, pa.string()) for c in ("days", "from_date", "to_date", "bits", "period_ref", "day_ref", "line_ref")]
    + [("points", pa.list_(_POINT)), ("times", pa.list_(_TIME))]
)
#: Bytes of a range and of a read; elements parsed together; how far from a range's start the end of a comment is looked for.
RANGE_BYTES, READ_BYTES, PARSED_BYTES, COMMENT_BYTES = 8 << 20, 1 << 20, 1 << 20, 1 << 20
#: The longest start of a tag that a read can cut.
TAG_BYTES = 128

PREFIX = rb"(?:[\w.-]+:)?"
OPEN = re.compile(rb"<" + PREFIX + rb"(" + b"|".join(t.encode() for t in TAGS) + rb")(?=[\s/>])|<!--|<!\[CDATA\[")
CLOSE = {t.encode(): re.compile(rb"</" + PREFIX + t.encode() + rb"\s*>") for t in TAGS}
CLOSE |= {b"<!--": re.compile(rb"-->"), b"<![CDATA[": re.compile(rb"\]\]>")}
SKIPPED = re.compile(rb"<!--|-->|<!\[CDATA\[|\]\]>")


class _Window:
    """What has been read of a file and is still needed."""

    def __init__(self, f, base: int):
        self.f, self.base, self.held, self.ended = f, base, b"", False

    def more(self) -> bool:
        piece = b"" if self.ended else self.f.read(READ_BYTES)
        self.ended |= not piece
        self.held += piece
        return bool(piece)

    def drop(self, n: int) -> None:
        self.held, self.base = self.held[n:], self.base + n

    def search(self, pattern: re.Pattern, at: int) -> re.Match | None:
        """The next match, for which it reads on; None at the end of the file."""
        while not (m := pattern.search(self.held, at)):
            at = max(at, len(self.held) - TAG_BYTES)
            if not self.more():
                return None
        return m


def elements_in(f, start: int, end: int | None) -> Iterator[tuple[int, str, bytes]]:
    """Place, tag and bytes of the elements that begin in a range of an open file, which stands at its start.

    Comments and character data are passed over. Where the first of their ends comes before a beginning, the range starts in one.
    """
    w, at = _Window(f, start), 0
    if start:
        while len(w.held) < COMMENT_BYTES and not SKIPPED.search(w.held) and w.more():
            pass
        if (m := SKIPPED.search(w.held)) and m[0] in (b"-->", b"]]>"):
            at = m.end()
    while True:
        m = OPEN.search(w.held, at)
        if not m:
            at = max(at, len(w.held) - TAG_BYTES)
            w.drop(at)
            at = 0
            if end is not None and w.base >= end or not w.more():
                return
            continue
        if m[1] is None:
            stop = w.search(CLOSE[m[0]], m.end())
            if not stop:
                return
            w.drop(stop.end())
            at = 0
            continue
        if end is not None and w.base + m.start() >= end:
            return
        w.drop(m.start())
        tag, at = m[1], m.end() - m.start()
        head = w.search(re.compile(rb">"), at)
        done = head if not head or w.held[head.start() - 1 : head.start()] == b"/" else w.search(CLOSE[tag], head.end())
        if not done:
            raise ValueError(f"{tag.decode()} at byte {w.base} does not end")
        yield w.base, tag.decode(), w.held[: done.end()]


def _text(e: ET.Element, path: str) -> str | None:
    found = e.find(path)
    return None if found is None else found.text


def _ref(e: ET.Element, path: str) -> str | None:
    found = e.find(path)
    return None if found is None else found.get("ref")


def _number(text: str | None, kind: type) -> float | int | None:
    try:
        return kind(text)
    except (TypeError, ValueError):
        return None


def row_of(tag: str, ordinal: int, e: ET.Element) -> dict:
    """A row of SCHEMA; what an element lacks is null."""
    row = {"tag": tag, "ordinal": ordinal, "id": e.get("id"), "name": _text(e, "Name")}
    if tag == "Line":
        row |= {"short_name": _text(e, "ShortName"), "mode": _text(e, "TransportMode")}
    elif tag == "ScheduledStopPoint":
        row |= {"lon": _number(_text(e, "Location/Longitude"), float), "lat": _number(_text(e, "Location/Latitude"), float)}
    elif tag == "DayType":
        row["days"] = _text(e, "properties/PropertyOfDay/DaysOfWeek")
    elif tag == "UicOperatingPeriod":
        row |= {"from_date": _text(e, "FromDate"), "to_date": _text(e, "ToDate"), "bits": _text(e, "ValidDayBits")}
    elif tag == "DayTypeAssignment":
        row |= {"period_ref": _ref(e, "OperatingPeriodRef"), "day_ref": _ref(e, "DayTypeRef")}
    elif tag == "ServiceJourneyPattern":
        row["points"] = [{"id": p.get("id"), "seq": _number(p.get("order"), int), "stop_ref": _ref(p, "ScheduledStopPointRef")} for p in e.findall("pointsInSequence/StopPointInJourneyPattern")]
    elif tag == "ServiceJourney":
        row |= {"from_date": _text(e, "ValidBetween/FromDate"), "to_date": _text(e, "ValidBetween/ToDate"), "day_ref": _ref(e, "dayTypes/DayTypeRef"), "line_ref": _ref(e, "FlexibleLineView/LineRef") or _ref(e, "LineRef")}
        row["times"] = [{"point_ref": _ref(t, "StopPointInJourneyPatternRef"), "arrival": _text(t, "ArrivalTime"), "departure": _text(t, "DepartureTime")} for t in e.findall("passingTimes/TimetabledPassingTime")]
    return row


def parsed(raw: list[bytes], encoding: str) -> list[ET.Element]:
    """Elements without name spaces, whose prefixes are declared further up in the document."""
    body = b"".join(re.sub(rb"(</?)[\w.-]+:|\s(?:xmlns(?::[\w.-]+)?)=(?:\"[^\"]*\"|'[^']*')|(\s)[\w.-]+:(?=[\w.-]+=)", rb"\1\2", x) if b":" in x else x for x in raw)
    return list(ET.fromstring(f'<?xml version="1.0" encoding="{encoding}"?><all>'.encode() + body + b"</all>"))


@dataclass
class ByteRange(InputPartition):
    """A file's number, and the bytes where its elements begin; no end: to the end of the file."""

    uri: str
    path: str
    number: int
    start: int
    end: int | None


class TimetableReader(DataSourceReader):
    def __init__(self, options: dict):
        self.uri, self.range_bytes = options["path"], int(options.get("rangebytes", RANGE_BYTES))

    def partitions(self) -> list[ByteRange]:
        out = []
        for number, (path, size) in enumerate(files_under(self.uri)):
            starts = [0] if path.endswith((".gz", ".bz2", ".zst")) else list(range(0, max(1, size), self.range_bytes))
            out += [ByteRange(self.uri, path, number, a, b) for a, b in zip(starts, [*starts[1:], None])]
        return out

    def read(self, part: ByteRange) -> Iterator[pa.RecordBatch]:
        at, _ = store(part.uri)
        with at.open_input_stream(part.path) as f:  # decompresses by the file's ending
            head = f.read(200)
        encoding = (m := re.match(rb"(?:\xef\xbb\xbf)?<\?xml[^>]*encoding=[\"']([\w.-]+)", head)) and m[1].decode() or "utf-8"
        raw, held, size = [], [], 0
        with at.open_input_file(part.path) if part.start else at.open_input_stream(part.path) as f:
            if part.start:
                f.seek(part.start)
            for place, tag, body in elements_in(f, part.start, part.end):
                raw.append(body)
                held.append((tag, part.number << 44 | place))
                size += len(body)
                if size >= PARSED_BYTES:
                    yield self._rows(raw, held, encoding)
                    raw, held, size = [], [], 0
        if raw:
            yield self._rows(raw, held, encoding)

    @staticmethod
    def _rows(raw: list[bytes], held: list[tuple[str, int]], encoding: str) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([row_of(*h, e) for h, e in zip(held, parsed(raw, encoding), strict=True)], ARROW)


class Timetable(DataSource):
    """spark.read.format("netex").load(path); option rangeBytes."""

    @classmethod
    def name(cls) -> str:
        return "netex"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> TimetableReader:
        return TimetableReader(self.options)


def read(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The elements of the documents under a path (A03, A04, P19), each with its place in the order of files and elements."""
    ship_package(spark)
    if Timetable.name() not in (known := spark.__dict__.setdefault("_stoplake_formats", set())):
        spark.dataSource.register(Timetable)
        known.add(Timetable.name())
    return spark.read.format("netex").option("rangeBytes", range_bytes).load(path)
