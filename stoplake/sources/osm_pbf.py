"""Map extracts in the protobuf binary format: nodes, ways and relations as one table, read and written in parts.

A file is a series of blobs that are compressed one by one, each after a header that tells its length. The reader
walks the headers alone to cut a file into ranges of whole blobs; a task opens the file at its range and holds one
blob at a time, so a file of any size is read by as many tasks as it has ranges.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from stoplake.session import ship_package
from stoplake.sources.gtfs_rt import fields
from stoplake.sources.storage import files_under, store

SCHEMA = "kind string, id long, lon double, lat double, tags map<string, string>, refs array<long>, members array<struct<kind: string, ref: long, role: string>>"
KINDS = ("node", "way", "relation")
ARROW = [
    pa.field("kind", pa.string()), pa.field("id", pa.int64()), pa.field("lon", pa.float64()), pa.field("lat", pa.float64()), pa.field("tags", pa.map_(pa.string(), pa.string())), pa.field("refs", pa.list_(pa.int64())),
    pa.field("members", pa.list_(pa.struct([("kind", pa.string()), ("ref", pa.int64()), ("role", pa.string())]))),
]


def varints(raw: bytes) -> np.ndarray:
    """All numbers of a packed field."""
    b = np.frombuffer(raw, np.uint8)
    ends = np.flatnonzero(b < 0x80)
    starts = np.concatenate([[0], ends[:-1] + 1]).astype(np.int64) if len(ends) else np.zeros(0, np.int64)
    out = np.zeros(len(ends), np.uint64)
    for k in range(int((ends - starts).max()) + 1 if len(ends) else 0):
        more = starts + k <= ends
        out[more] |= (b[starts[more] + k].astype(np.uint64) & np.uint64(0x7F)) << np.uint64(7 * k)
    return out


def zigzag(x: np.ndarray) -> np.ndarray:
    """Signed numbers of their zigzag form."""
    return (x >> np.uint64(1)).astype(np.int64) ^ -(x & np.uint64(1)).astype(np.int64)


#: Packed fields of up to so many bytes or numbers go one by one: a way's dozen of numbers cost less than a call of numpy does.
FEW = 128


def numbers(raw: bytes) -> list[int]:
    """varints() as a list."""
    if len(raw) > FEW:
        return varints(raw).tolist()
    out, value, shift = [], 0, 0
    for b in raw:
        value |= (b & 0x7F) << shift
        if b < 0x80:
            out.append(value & (1 << 64) - 1)
            value = shift = 0
        else:
            shift += 7
    return out


def wrapped(x: int) -> int:
    """A number as 64 bits with a sign hold it."""
    return (x + (1 << 63) & (1 << 64) - 1) - (1 << 63)


def deltas(raw: bytes) -> list[int]:
    """Sums of the signed numbers of a packed field."""
    if len(raw) > FEW:
        return np.cumsum(zigzag(varints(raw))).tolist()
    return [wrapped(x) for x in accumulate((x >> 1) ^ -(x & 1) for x in numbers(raw))]


#: Names of blob types, and the features that a reader of written files needs.
HEADER, DATA, FEATURES = "OSMHeader", "OSMData", ("OsmSchema-V0.6", "DenseNodes")
#: Bytes of a range, at least; elements of a written blob; the most that a header may have by the format.
RANGE_BYTES, BLOB_ELEMENTS, MOST_HEADER = 32 << 20, 8000, 64 << 10


def blob_header(f) -> tuple[str, int] | None:
    """Type and length of the blob at the place of an open file, which moves on to it; None at the end of the file."""
    size = f.read(4)
    if not size:
        return None
    n = int.from_bytes(size, "big")
    raw = f.read(n) if len(size) == 4 and n <= MOST_HEADER else b""
    if len(raw) != n or not n:
        raise ValueError("not the header of a blob")
    head = dict(fields(raw))
    return head[1].decode(), head[3]


@dataclass
class BlobRange(InputPartition):
    """Whole blobs of a file, from byte to byte."""

    uri: str
    path: str
    start: int
    end: int


def ranges(uri: str, range_bytes: int = RANGE_BYTES) -> list[BlobRange]:
    """The files under a URI as ranges of whole blobs; only headers are read. A file that is cut short raises ValueError."""
    out, at = [], store(uri)[0]
    for path, size in files_under(uri):
        start = place = 0
        with at.open_input_file(path) as f:
            while head := blob_header(f):
                place = f.tell() + head[1]
                if place > size:
                    raise ValueError(f"{path}: a blob is cut short")
                f.seek(place)
                if place - start >= range_bytes:
                    out.append(BlobRange(uri, path, start, place))
                    start = place
        if place > start:
            out.append(BlobRange(uri, path, start, place))
    return out


def blobs_of(part: BlobRange) -> Iterator[bytes]:
    """The data blobs of a range, one at a time."""
    with store(part.uri)[0].open_input_file(part.path) as f:
        f.seek(part.start)
        while f.tell() < part.end:
            kind, size = blob_header(f)
            blob = f.read(size)
            if kind == DATA:
                yield blob


#: Kinds of a group's messages by their field; 2 holds many nodes.
GROUP_KINDS = {1: "node", 2: "node", 3: "way", 4: "relation"}


def elements_of(blob: bytes, kinds: tuple[str, ...] = KINDS) -> Iterator[tuple]:
    """Rows of SCHEMA of a data blob, raw or compressed with zlib; what is of other kinds is not decoded."""
    body = dict(fields(blob))
    block = list(fields(body[1] if 1 in body else zlib.decompress(body[3])))
    groups = [[(kind, raw) for kind, raw in fields(v) if GROUP_KINDS.get(kind) in kinds] for n, v in block if n == 2]
    if not any(groups):
        return
    scalars = {n: v for n, v in block if n not in (1, 2)}
    texts = [x.decode("utf-8", "replace") for n, table in block if n == 1 for k, x in fields(table) if k == 1]
    grain, lat0, lon0 = scalars.get(17, 100), int(np.uint64(scalars.get(19, 0)).astype(np.int64)), int(np.uint64(scalars.get(20, 0)).astype(np.int64))
    degrees = lambda x, zero: (zero + grain * x) / 1e9
    tags_of = lambda m: [(texts[k], texts[v]) for k, v in zip(numbers(m.get(2, b"")), numbers(m.get(3, b"")))]
    one = lambda x: (x >> 1) ^ -(x & 1)
    for group in groups:
        for kind, raw in group:
            m = dict(fields(raw))
            if kind == 1:
                yield "node", one(m[1]), degrees(one(m[9]), lon0), degrees(one(m[8]), lat0), tags_of(m), None, None
            elif kind == 2:
                ids, lats, lons = (deltas(m[k]) for k in (1, 8, 9))
                pairs, held = iter(numbers(m.get(10, b""))), []
                for i, lat, lon in zip(ids, (degrees(x, lat0) for x in lats), (degrees(x, lon0) for x in lons)):
                    held = []
                    while key := next(pairs, 0):
                        held.append((texts[key], texts[next(pairs)]))
                    yield "node", i, lon, lat, held, None, None
            elif kind == 3:
                yield "way", wrapped(m[1]), None, None, tags_of(m), deltas(m.get(8, b"")), None
            elif kind == 4:
                roles, refs, of = numbers(m.get(8, b"")), deltas(m.get(9, b"")), numbers(m.get(10, b""))
                yield "relation", wrapped(m[1]), None, None, tags_of(m), None, [{"kind": KINDS[k], "ref": r, "role": texts[s]} for s, r, k in zip(roles, refs, of)]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), ARROW)] if rows else [pa.array([], f.type) for f in ARROW], names=[f.name for f in ARROW])


class MapReader(DataSourceReader):
    """Kinds are an option: Spark keeps one set of pushed filters for all scans of a DataFrame, which a self-join has several of."""

    def __init__(self, options: dict):
        self.uri, self.range_bytes = options["path"], int(options.get("rangebytes", RANGE_BYTES))
        self.kinds = tuple(options.get("kinds", ",".join(KINDS)).split(","))

    def partitions(self) -> list[BlobRange]:
        return ranges(self.uri, self.range_bytes) or [BlobRange(self.uri, "", 0, 0)]

    def read(self, part: BlobRange) -> Iterator[pa.RecordBatch]:
        for blob in blobs_of(part) if part.end else ():
            if rows := [(*r[:4], list(dict(r[4]).items()), *r[5:]) for r in elements_of(blob, self.kinds)]:
                yield _batch(rows)


def packed(values: Iterable[int]) -> bytes:
    """Unsigned numbers as a packed field."""
    values = list(values)
    if len(values) <= FEW:
        out = bytearray()
        for v in values:
            while v > 0x7F:
                out.append(v & 0x7F | 0x80)
                v >>= 7
            out.append(v)
        return bytes(out)
    left = np.array(values, np.uint64)
    rows = np.zeros((len(left), 10), np.uint8)
    size = np.ones(len(left), np.int64)
    for k in range(10):
        rows[:, k] = (left & np.uint64(0x7F)).astype(np.uint8)
        left = left >> np.uint64(7)
        rows[left > 0, k] |= 0x80
        size[left > 0] = k + 2
    return rows[np.arange(10) < size[:, None]].tobytes()


def signed_steps(values: Iterable[int]) -> bytes:
    """Signed numbers as a packed field of zigzag differences."""
    values = list(values)
    if len(values) <= FEW:
        steps = (wrapped(b - a) for a, b in zip([0, *values], values))
        return packed(((d << 1) ^ (d >> 63)) & (1 << 64) - 1 for d in steps)
    d = np.diff(np.array(values, np.int64), prepend=np.int64(0))
    return packed(((d << 1) ^ (d >> 63)).view(np.uint64).tolist())


def message(*parts: tuple[int, bytes | int]) -> bytes:
    """A protobuf message of numbered byte strings and numbers."""
    out = b""
    for number, value in parts:
        if isinstance(value, bytes):
            out += packed([number << 3 | 2, len(value)]) + value
        else:
            out += packed([number << 3, value & (1 << 64) - 1])
    return out


def blob_of(kind: str, body: bytes) -> bytes:
    """A blob with its header, as it stands in a file."""
    blob = message((2, len(body)), (3, zlib.compress(body)))
    head = message((1, kind.encode()), (3, len(blob)))
    return len(head).to_bytes(4, "big") + head + blob


def block_of(rows: list[dict]) -> bytes:
    """A data block of elements, with a group for each kind; coordinates have seven places."""
    texts: dict[str, int] = {"": 0}
    place = lambda t: texts.setdefault(t or "", len(texts))
    of = {k: [r for r in rows if r["kind"] == k] for k in KINDS}
    groups = []
    if nodes := of["node"]:
        tags = [i for r in nodes for i in (*(place(t) for pair in r["tags"] or () for t in pair), 0)]
        units = [signed_steps(round(r[c] * 1e7) for r in nodes) for c in ("lat", "lon")]
        groups.append(message((2, message((1, signed_steps(r["id"] for r in nodes)), (8, units[0]), (9, units[1]), (10, packed(tags))))))
    keys = lambda r: [(n, packed(place(pair[n - 2]) for pair in r["tags"] or ())) for n in (2, 3)]
    groups += [message((3, message((1, r["id"]), *keys(r), (8, signed_steps(r["refs"] or ()))))) for r in of["way"]]
    for r in of["relation"]:
        m = r["members"] or ()
        own = (8, packed(place(x["role"]) for x in m)), (9, signed_steps(x["ref"] for x in m)), (10, packed(KINDS.index(x["kind"]) for x in m))
        groups.append(message((4, message((1, r["id"]), *keys(r), *own))))
    return message((1, message(*((1, t.encode()) for t in texts))), *((2, g) for g in groups))


@dataclass
class PartFile(WriterCommitMessage):
    held: str
    name: str


class MapWriter(DataSourceArrowWriter):
    """A file for each task, under a name that only the commit makes visible."""

    def __init__(self, options: dict, overwrite: bool):
        self.uri, self.overwrite, self.run = options["path"], overwrite, uuid.uuid4().hex

    def write(self, batches: Iterator[pa.RecordBatch]) -> PartFile:
        from pyspark import TaskContext

        at, folder = store(self.uri)
        at.create_dir(folder)
        name = f"part-{TaskContext.get().partitionId():05d}-{self.run}.osm.pbf"
        held = f"{folder}/_{uuid.uuid4().hex}.{name}"
        with at.open_output_stream(held) as f:
            f.write(blob_of(HEADER, message(*((4, x.encode()) for x in FEATURES))))
            for batch in batches:
                for low in range(0, batch.num_rows, BLOB_ELEMENTS):
                    f.write(blob_of(DATA, block_of(batch.slice(low, BLOB_ELEMENTS).to_pylist())))
        return PartFile(held, f"{folder}/{name}")

    def commit(self, messages: list[PartFile | None]) -> None:
        at, _ = store(self.uri)
        old = [path for path, _ in files_under(self.uri)] if self.overwrite else []
        for m in messages:
            if m is not None:
                at.move(m.held, m.name)
        for path in old:
            at.delete_file(path)

    def abort(self, messages: list[PartFile | None]) -> None:
        at, _ = store(self.uri)
        for m in messages:
            if m is not None:
                at.delete_file(m.held)


class MapExtract(DataSource):
    """spark.read.format("map_extract").load(path); options rangeBytes and kinds (node, way, relation)."""

    @classmethod
    def name(cls) -> str:
        return "map_extract"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> MapReader:
        return MapReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> MapWriter:
        return MapWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    """Make the format known to a session."""
    ship_package(spark)
    if MapExtract.name() not in (known := spark.__dict__.setdefault("_stoplake_formats", set())):
        spark.dataSource.register(MapExtract)
        known.add(MapExtract.name())


def read(spark: SparkSession, path: str, kinds: Iterable[str] = KINDS, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Elements of the files under a path (A05-A11), of the kinds wanted; of a key that a tag repeats the last value counts."""
    register(spark)
    return spark.read.format("map_extract").option("kinds", ",".join(kinds)).option("rangeBytes", range_bytes).load(path)


def write(elements: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Elements as map extract files, one for each partition."""
    register(elements.sparkSession)
    elements.select(*[f.name for f in ARROW]).write.format("map_extract").mode(mode).save(path)
