"""Token ids in ORC files (operator 4).

Documents are dealt out by ranges of doc_id, sorted and encoded, and each task writes one ORC file: ids
as an integer list column (run-length encoded by the format), row indexes, and Bloom filters on doc_id.
Each row holds its place inside its file, so reading needs no running sum over the corpus: the files'
totals (one row for each file) give every file's first position.

The tokenizer's rules never look across a blank or a line break, so texts are encoded in the pieces
between them, letters and marks apart. Batches are split and dictionary-encoded in Arrow; each worker keeps
the ids of the distinct pieces it met, in tables of bounded size.
"""

from __future__ import annotations

import itertools
import os
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stoplake.llm.common import WORD_BATCH_BYTES, no_collector, prepare, scratch

#: Pieces in a worker's table; of a full one what was used least goes, and longer pieces.
TABLE_ENTRIES, KEPT_CHARS = 600_000, 40
#: Marks that the tokenizer never joins to letters (an apostrophe may begin a suffix).
MARKS = ".,!?;:*&%$#|()"
#: Rows between two entries of a file's row index, and bytes of a stripe.
INDEX_ROWS, STRIPE_BYTES = 1000, 16 << 20
#: Columns of the files. part: the file's number in order; local_start: ids before the row in its file.
COLUMNS = "part int, doc_id long, local_start long, n_tokens long, ids array<int>"


class PieceEncoder:
    """A tokenizer of the tokenizers library with a table of the pieces it has encoded.

    A piece has a place: its ids are those of flat from edges[place] to edges[place + 1]. Place 0 is the end id.
    """

    def __init__(self, path: str, end: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str | None, int] = {None: 0}
        self.flat, self.edges, self.uses = array("I", [end]), array("q", [0, 1]), np.zeros(1, np.int64)

    def prune(self) -> None:
        """Keep of a full table what was used more than usual, without long pieces."""
        flat, edges, usual = self.flat, self.edges, np.median(self.uses)
        held = [(p, flat[edges[k] : edges[k + 1]], self.uses[k]) for p, k in self.known.items() if p is None or self.uses[k] > usual and len(p) <= KEPT_CHARS]
        self.known = {p: k for k, (p, _, _) in enumerate(held)}
        self.flat = array("I", b"".join([ids.tobytes() for _, ids, _ in held]))
        self.edges = array("q", [0, *itertools.accumulate([len(ids) for _, ids, _ in held])])
        self.uses = np.array([n for _, _, n in held], np.int64) // 2

    def places(self, pieces: pa.Array) -> np.ndarray:
        """The place of each of distinct pieces; new ones are encoded."""
        words = pieces.to_pylist()
        if len(self.known) > TABLE_ENTRIES:
            self.prune()
        known = self.known
        found = list(map(known.get, words))
        new = [w for w, k in zip(words, found) if k is None]
        if new:
            first = len(known)
            known.update(zip(new, range(first, first + len(new))))
            for e in self.tokenizer.encode_batch_fast(new, add_special_tokens=False):
                self.flat.extend(e.ids)
                self.edges.append(len(self.flat))
            self.uses = np.concatenate([self.uses, np.zeros(len(new), np.int64)])
            found = list(map(known.get, words))
        out = np.array(found, np.int64)
        self.uses[out] += 1
        return out

    def encode(self, texts: pa.Array) -> pa.ListArray:
        """Ids of each text, the end id last; a null text counts as empty.

        A batch is split and its distinct pieces are found in Arrow; only those are looked up one by one.
        """
        pieces = pc.split_pattern(pc.replace_substring(pc.fill_null(texts, ""), "\n", " "), " ")
        coded = pieces.flatten().dictionary_encode()
        halves = pa.concat_arrays(apart(coded.dictionary)).dictionary_encode()
        place = self.places(halves.dictionary)[np.asarray(halves.indices)].reshape(2, -1)
        # two places for each piece, and one for the end id behind each text's last piece
        starts = 2 * (np.asarray(pieces.offsets, np.int64) - pieces.offsets[0].as_py())
        order = np.insert(place[:, np.asarray(coded.indices)].T.reshape(-1), starts[1:], 0)
        edges = np.frombuffer(self.edges, np.int64)
        sizes = np.diff(edges)[order]
        run = np.concatenate([[0], np.cumsum(sizes)])
        at = np.repeat(edges[order] - run[:-1], sizes) + np.arange(run[-1])
        ids = np.frombuffer(self.flat, "<u4")[at].view("<i4")
        return pa.ListArray.from_arrays(pa.array(run[starts + np.arange(len(starts))], pa.int32()), pa.array(ids))


def apart(words: pa.Array) -> list[pa.Array]:
    """Of each word the letters in lower case and the marks behind them, which the tokenizer takes apart as well.

    Other words stay whole, as do letters beyond Latin-1: in lower case some end with a mark.
    """
    letters = pc.utf8_rtrim(words, characters=MARKS)
    plain = pc.match_substring_regex(letters, "^[A-Za-zÀ-ÖØ-öø-ÿ]+$")
    marks = pc.struct_field(pc.extract_regex(words, f"(?P<m>[{MARKS}]*)$"), 0)
    return [pc.if_else(plain, pc.utf8_lower(letters), words), pc.if_else(plain, marks, "")]


_ENCODERS: dict[tuple[str, int], PieceEncoder] = {}


def encoder(path: str, end: int) -> PieceEncoder:
    if (path, end) not in _ENCODERS:
        _ENCODERS[path, end] = PieceEncoder(path, end)
    return _ENCODERS[path, end]


def write_ids(docs: DataFrame, vocabulary: str, path: str, end: int = 2) -> None:
    """Encode docs(doc_id, text) and write the ORC files of a corpus under path, in doc_id order.

    A null text counts as empty (the end id alone); null doc_ids come first; rows that repeat a doc_id
    stand side by side, ordered by their texts' hashes. An empty table gives an empty corpus. Other columns
    are not read.
    """
    prepare(docs.sparkSession, WORD_BATCH_BYTES)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, at = encoder(vocabulary, end), TaskContext.get().partitionId(), 0
        for batch in batches:
            with no_collector():
                ids = enc.encode(batch.column("text"))
            edges = np.asarray(ids.offsets, np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(ids), part, np.int32)), batch.column("doc_id").cast(pa.int64()), pa.array(edges[:-1] + at), pa.array(np.diff(edges)), ids],
                names=["part", "doc_id", "local_start", "n_tokens", "ids"],
            )
            at += int(edges[-1])

    # the hash parts rows that share an id (or have none), so that they need not be in one range
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    dealt = docs.select("doc_id", "text").repartitionByRange(*order).sortWithinPartitions(*order, "text")
    options = {
        "compression": "zstd",
        "orc.bloom.filter.columns": "doc_id",
        "orc.bloom.filter.fpp": "0.01",
        "orc.row.index.stride": str(INDEX_ROWS),
        "orc.stripe.size": str(STRIPE_BYTES),
    }
    dealt.mapInArrow(work, COLUMNS).write.options(**options).orc(path)


def read_ids(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """part, doc_id, start, n_tokens, ids of a corpus; with doc_ids, of these only.

    Files are read stripe by stripe in parallel; doc_ids reach the reader as a filter, so that stripes and
    row groups without them are skipped by their ranges and Bloom filters.
    """
    files = spark.read.schema(COLUMNS).orc(path)
    totals = sorted((r[0], r[1]) for r in files.groupBy("part").agg(F.max(F.col("local_start") + F.col("n_tokens"))).collect())
    ahead = np.concatenate([[0], np.cumsum([n for _, n in totals])]) if totals else [0]
    first = spark.createDataFrame([(p, int(a)) for (p, _), a in zip(totals, ahead)], "part int, ahead long")
    rows = files if doc_ids is None else files.filter(F.col("doc_id").isin(doc_ids))
    # one row for each file: small beside the corpus by construction
    return rows.join(F.broadcast(first), "part").select("part", "doc_id", (F.col("ahead") + F.col("local_start")).alias("start"), "n_tokens", "ids")


def with_crc32(rows: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of what read_ids() gives."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids")
            edges, flat = ids.offsets.to_numpy(), np.asarray(ids.values, "<u4").tobytes()
            crc = [zlib.crc32(flat[4 * a : 4 * b]) for a, b in zip(edges, edges[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), batch.column("n_tokens"), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return rows.select("doc_id", "start", "n_tokens", "ids").mapInArrow(work, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Write a corpus to the shared folder, read it back and report each document's place and checksum."""
    path = scratch(docs.sparkSession, "token-ids")
    write_ids(docs, vocabulary, path)
    return with_crc32(read_ids(docs.sparkSession, path))
