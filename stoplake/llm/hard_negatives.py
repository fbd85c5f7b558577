"""Hard-negative mining (operator 11) by one-dimensional distance keys.

1. Vectors become integers, floor(256 x). With a last component sqrt(M - |x|^2), M the largest squared length, a higher
   inner product is a smaller distance: |q - x'|^2 = |q|^2 + M - 2 score.
2. Every row belongs to its nearest pivot (k-means of a bounded sample) and is stored in the order of (pivot, distance),
   in blocks of one pivot. A block's key interval bounds the distance, so the score, of its rows to any anchor.
3. A request wants the first k rows of its anchor at or under a cap. It begins with a target score that about 2k rows are
   expected to reach, and scans the key intervals that can hold a row between target and cap: annuli around the
   anchor. k rows at the target certify the result, as nothing outside the intervals can reach it; otherwise
   the interval grows to where the sample alone proves k rows, and then to all that the request may take.
4. Anchors travel in packs to the blocks that their intervals meet; each pair of pack and block is a row of its own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stoplake.llm.common import discard, materialise, prepare

SCALE = 256
POSITIVES, NEGATIVES, LOW_PERCENT, HIGH_PERCENT = 5, 10, 30, 90
#: The fitted sample (pivots, first targets) in rows and bytes, pivots, rounds of k-means.
SAMPLE_ROWS, SAMPLE_BYTES, PIVOTS, FIT_ROUNDS = 8192, 16 << 20, 64, 8
#: Bytes of vectors in a block and in a pack, and scores looked at together.
BLOCK_BYTES, PACK_BYTES, SCORES = 4 << 20, 256 << 10, 1 << 20
#: Scores under this are exact as doubles; larger ones are computed as Python integers.
EXACT = 2**52
LEAST = -(2**63)


def quantised(rows: DataFrame) -> DataFrame:
    """vec_id, label, vec (components as packed doubles) and square (its squared length) of the rows that take part."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("embedding")
            x = np.floor(SCALE * np.asarray(lists.flatten().to_numpy(zero_copy_only=False), np.float64))
            ends = np.cumsum([0 if n is None else n for n in lists.value_lengths().to_pylist()])
            starts = np.concatenate([[0], ends[:-1]]).astype(int)
            bad = np.concatenate([[0], np.cumsum(~np.isfinite(x))])
            keep = [i for i, (a, b) in enumerate(zip(starts, ends)) if bad[a] == bad[b]]
            vecs = [x[starts[i] : ends[i]] for i in keep]
            own = batch.take(pa.array(keep, pa.int64()))
            blobs, squares = pa.array([v.astype("<f8").tobytes() for v in vecs], pa.binary()), pa.array([float(v @ v) for v in vecs], pa.float64())
            yield pa.RecordBatch.from_arrays([own.column("vec_id"), own.column("label"), blobs, squares], names=["vec_id", "label", "vec", "square"])

    there = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    there = there.filter("vec_id is not null and label is not null and embedding is not null")
    return there.mapInArrow(work, "vec_id long, label long, vec binary, square double")


class Space:
    """What every task needs: the pivots and sample, bounded in bytes, and the number of dimensions."""

    def __init__(self, rows: DataFrame):
        found = rows.agg(F.count(F.lit(1)), F.max("square"), F.max(F.octet_length("vec"))).first()
        self.rows, self.most, self.width = found[0], found[1] or 0.0, (found[2] or 0) // 8
        some = max(1, min(SAMPLE_ROWS, SAMPLE_BYTES // (8 * self.width + 16)))
        # in the order of a hash of vec_id, so that the sample is the same each time
        sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "label", "vec").limit(some).toArrow()
        self.ids, self.labels = (np.asarray(sample[c]).astype(np.int64) for c in ("vec_id", "label"))
        self.sample = self.matrix(sample["vec"].to_pylist())
        self.share = len(self.ids) / max(1, self.rows)
        self.slack = 1e-6 * (1 + math.sqrt(self.most))
        self.pivots = self._fit(self.augmented(self.sample, np.asarray(sample["square"])))

    def matrix(self, blobs: list[bytes]) -> np.ndarray:
        """Rows of vectors; shorter ones end in zeros."""
        if all(len(b) == 8 * self.width for b in blobs):
            return np.frombuffer(b"".join(blobs), "<f8").reshape(len(blobs), self.width)
        return np.array([np.pad(np.frombuffer(b, "<f8"), (0, self.width - len(b) // 8)) for b in blobs]).reshape(len(blobs), self.width)

    def augmented(self, x: np.ndarray, square: np.ndarray) -> np.ndarray:
        return np.column_stack([x, np.sqrt(np.maximum(self.most - square, 0))])

    def _fit(self, x: np.ndarray) -> np.ndarray:
        pivots = x[:: max(1, len(x) // PIVOTS)][:PIVOTS].copy()
        for _ in range(FIT_ROUNDS if len(x) > PIVOTS else 0):
            nearest = distances(x, pivots).argmin(1)
            for k in np.unique(nearest):
                pivots[k] = x[nearest == k].mean(0)
        return pivots

    def scores(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Inner products, exact."""
        if self.most < EXACT:
            return x @ y.T
        whole = [np.array([[int(v) for v in row] for row in m], object).reshape(m.shape) for m in (x, y)]
        return np.dot(whole[0], whole[1].T).astype(np.int64)

    def radius(self, square: np.ndarray, score: np.ndarray) -> np.ndarray:
        """The distance at which rows have this score."""
        return np.sqrt(np.maximum(square + self.most - 2.0 * score, 0))


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1) - 2 * (x @ y.T), 0))


def keyed(rows: DataFrame, space: Space) -> DataFrame:
    """rows with their nearest pivot and the distance to it."""
    shared = rows.sparkSession.sparkContext.broadcast(space)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            if batch.num_rows:
                far = distances(own.augmented(own.matrix(batch.column("vec").to_pylist()), np.asarray(batch.column("square"))), own.pivots)
                at = far.argmin(1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at, pa.int32()), pa.array(far[np.arange(len(at)), at])], names=[*batch.schema.names, "pivot", "far"])

    return rows.mapInArrow(work, f"{', '.join(f'{n} {t}' for n, t in rows.dtypes)}, pivot int, far double")


def index(rows: DataFrame, space: Space, most: int) -> DataFrame:
    """Blocks of rows in the order of (pivot, distance): block, pivot, low and high (its key interval), ids, labels, vecs.

    Of rows with the same vector and label the first `most` by vec_id are stored: they come before the others
    in the result of every request, and no request takes more.
    """
    order = Window.partitionBy("label", "vec").orderBy("vec_id")
    once = rows.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most).drop("place")
    dealt = keyed(once, space).repartitionByRange("pivot", "far", "vec_id").sortWithinPartitions("pivot", "far", "vec_id")
    size = max(1, BLOCK_BYTES // (8 * space.width + 1))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, run in enumerate(runs(batches, size, lambda a, b: a["pivot"] == b["pivot"])):
            blob = lambda c: np.array([r[c] for r in run], "<i8").tobytes()
            values = (TaskContext.get().partitionId() << 32 | k, run[0]["pivot"], run[0]["far"], run[-1]["far"], blob("vec_id"), blob("label"), [r["vec"] for r in run])
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, (pa.int64(), pa.int32(), pa.float64(), pa.float64(), pa.binary(), pa.binary(), pa.list_(pa.binary())))], names=BLOCK)

    return dealt.select("pivot", "far", "vec_id", "label", "vec").mapInArrow(work, "block long, pivot int, low double, high double, ids binary, labels binary, vecs array<binary>")


BLOCK = ["block", "pivot", "low", "high", "ids", "labels", "vecs"]


def runs(batches: Iterator[pa.RecordBatch], size: int, alike) -> Iterator[list[dict]]:
    """Rows in runs of at most size rows that are alike."""
    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and (len(held) >= size or not alike(held[0], row)):
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def aimed(requests: DataFrame, space: Space, k: int, same: bool) -> DataFrame:
    """requests(request, anchor_id, label, vec, square, cap, floor) with target and then: scores that about 2k rows, and surely k rows, reach."""
    shared = requests.sparkSession.sparkContext.broadcast(space)
    likely = max(1, min(k, math.ceil(2 * k * space.share)))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            rows = batch.to_pylist()
            aims = []
            for low in range(0, len(rows), step := max(1, SCORES // max(1, len(own.ids)))):
                part = rows[low : low + step]
                for r, scores in zip(part, own.scores(own.matrix([r["vec"] for r in part]), own.sample)):
                    fits = ((own.labels == r["label"]) == same) & (own.ids != r["anchor_id"]) & (scores <= r["cap"]) & (scores >= r["floor"])
                    best = np.sort(scores[fits])[::-1]
                    aims.append(tuple(int(best[n - 1]) if len(best) >= n else r["floor"] for n in (likely, k)))
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array([a[n] for a in aims], pa.int64()) for n in (0, 1))], names=[*batch.schema.names, "target", "then"])

    return requests.mapInArrow(work, f"{', '.join(f'{n} {t}' for n, t in requests.dtypes)}, target long, then long")


PACKED = ("request", "anchor_id", "label", "cap", "target")


def packs(requests: DataFrame, space: Space) -> DataFrame:
    """Packs of near anchors with their requests, and the interval of keys at each pivot that any of them needs."""
    shared = requests.sparkSession.sparkContext.broadcast(space)
    size = max(1, PACK_BYTES // (8 * space.width + 1))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for k, run in enumerate(runs(batches, size, lambda a, b: True)):
            columns = {c: np.array([r[c] for r in run], "<i8") for c in PACKED}
            vecs, at = [], []
            for r in run:  # requests of one anchor follow each other
                if not vecs or vecs[-1] != r["vec"]:
                    vecs.append(r["vec"])
                at.append(len(vecs) - 1)
            low, high = intervals(own, vecs, np.array(at), columns["target"], columns["cap"])
            needs = [{"pivot": p, "from": float(low[:, p].min()), "to": float(high[:, p].max())} for p in range(len(own.pivots)) if (low[:, p] <= high[:, p]).any()]
            values = [TaskContext.get().partitionId() << 32 | k, *(columns[c].tobytes() for c in PACKED), np.array(at, "<i8").tobytes(), vecs, needs]
            need = pa.list_(pa.struct([("pivot", pa.int32()), ("from", pa.float64()), ("to", pa.float64())]))
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, [pa.int64(), *[pa.binary()] * 6, pa.list_(pa.binary()), need])], names=["pack", *PACKED, "at", "anchors", "needs"])

    dealt = keyed(requests, space).repartitionByRange("pivot", "far", "request").sortWithinPartitions("pivot", "far", "request")
    kinds = ", ".join(f"{c} binary" for c in (*PACKED, "at"))
    return dealt.mapInArrow(work, f"pack long, {kinds}, anchors array<binary>, needs array<struct<pivot: int, `from`: double, `to`: double>>")


def intervals(space: Space, vecs: list[bytes], at: np.ndarray, target: np.ndarray, cap: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """low and high keys, by anchor and pivot, between which rows with scores from its least target to its largest cap lie."""
    q = space.matrix(vecs)
    square = (q * q).sum(1)
    least, most = np.full(len(vecs), np.inf), np.full(len(vecs), -np.inf)
    np.minimum.at(least, at, target.astype(np.float64))
    np.maximum.at(most, at, cap.astype(np.float64))
    outer, inner = space.radius(square, least) + space.slack, space.radius(square, most) - space.slack
    far = distances(np.column_stack([q, np.zeros(len(q))]), space.pivots)
    low = np.maximum(far - outer[:, None], inner[:, None] - far)
    return low, far + outer[:, None]


def scan(blocks: DataFrame, requests: DataFrame, space: Space, k: int, same: bool) -> DataFrame:
    """request, score and vec_id of the first k rows of each request among those from its target to its cap."""
    spark = blocks.sparkSession
    shared = spark.sparkContext.broadcast(space)
    packed = materialise(packs(requests, space), "packs")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for row in batch.to_pylist():
                for found in best_of(own, row, k, same):
                    yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in found], names=["request", "score", "vec_id"])

    near = packed.select("pack", F.explode("needs").alias("need")).select("pack", "need.*")
    meets = (F.col("low") <= F.col("to")) & (F.col("high") >= F.col("from"))
    pairs = near.join(blocks.select("block", "pivot", "low", "high"), "pivot").filter(meets).select("pack", "block")
    both = pairs.join(packed.drop("needs"), "pack").join(blocks.drop("pivot"), "block")
    found = both.mapInArrow(work, "request long, score long, vec_id long")
    order = Window.partitionBy("request").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def best_of(space: Space, row: dict, k: int, same: bool) -> Iterator[tuple[np.ndarray, ...]]:
    """request, score and vec_id of the best k rows of a block for each request of a pack."""
    request, anchor_id, label, cap, target, at = (np.frombuffer(row[c], "<i8") for c in (*PACKED, "at"))
    ids, labels = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["labels"], "<i8")
    # only anchors whose own intervals meet the block's pivot are held against it
    q, x = space.matrix(row["anchors"]), space.matrix(row["vecs"])
    first, last = np.searchsorted(at, np.arange(len(q)), "left"), np.searchsorted(at, np.arange(len(q)), "right")
    least, most = np.minimum.reduceat(target, first), np.maximum.reduceat(cap, first)
    best = [np.empty(0, np.int64)] * 3
    step = max(1, SCORES // max(1, len(request)))
    for low in range(0, len(x), step):
        scores = space.scores(x[low : low + step], q)
        i, u = np.nonzero((scores >= least) & (scores <= most))
        s, n = scores[i, u].astype(np.int64), (last - first)[u]
        r = np.repeat(first[u], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        i, s = np.repeat(i, n) + low, np.repeat(s, n)
        fits = (s >= target[r]) & (s <= cap[r]) & ((labels[i] == label[r]) == same) & (ids[i] != anchor_id[r])
        if fits.any():
            merged = [np.concatenate(c) for c in zip(best, (r[fits], s[fits], ids[i[fits]]))]
            order = np.lexsort((merged[2], -merged[1], merged[0]))
            r = merged[0][order]
            starts = np.flatnonzero(np.diff(r, prepend=-1))
            place = np.arange(len(r)) - np.repeat(starts, np.diff(starts, append=len(r)))
            best = [c[order][place < k] for c in merged]
    if len(best[0]):
        yield request[best[0]], best[1], best[2]


def search(blocks: DataFrame, requests: DataFrame, space: Space, k: int, same: bool) -> DataFrame:
    """request, score, vec_id and rank of the first k rows of each request, whose radius grows until they are certain."""
    open_ = materialise(aimed(requests, space, k, same), "requests")
    done = None
    while True:
        found = materialise(scan(blocks, open_, space, k, same), "found")
        # nothing beyond the target is missing; under it there is more if the request may still take it
        short = open_.join(found.groupBy("request").agg(F.count(F.lit(1)).alias("n")), "request", "left")
        short = short.filter((F.coalesce("n", F.lit(0)) < k) & (F.col("target") > F.col("floor"))).drop("n")
        wider = F.when(F.col("target") > F.col("then"), F.col("then")).otherwise(F.col("floor"))
        open_ = materialise(short.withColumn("target", wider), "requests")
        certain = found.join(open_.select("request"), "request", "left_anti")
        done = certain if done is None else done.unionByName(certain)
        if open_.isEmpty():
            return done


def mine(rows: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW_PERCENT, high: int = HIGH_PERCENT) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for anchors of rows(vec_id, label, embedding).

    An anchor's positives are its first other rows of the same label, its negatives for a positive of score p the first
    rows of other labels with scores from low to high percent of p; first means higher score, then smaller vec_id.
    Rows with a null vec_id, label or vector, or a null or non-finite component take no part; shorter vectors
    count as ended by zeros, and rows that share a vec_id are not other to each other. A repeated row counts as
    often as it is there, but as one anchor. Scores must fit a long. Other columns are not read; an empty table gives no rows.
    """
    prepare(rows.sparkSession)
    own = materialise(quantised(rows), "vectors")
    space = Space(own)
    blocks = materialise(index(own, space, max(positives + 1, negatives)), "blocks")
    anchors = own.filter(is_anchor).dropDuplicates(["vec_id", "label", "vec"])
    anchors = materialise(anchors.withColumn("anchor", F.monotonically_increasing_id()).withColumnRenamed("vec_id", "anchor_id"), "anchors")
    discard(own)
    wanted = ("request", "anchor_id", "label", "vec", "square", "cap", "floor")
    every = anchors.withColumns({"request": F.col("anchor"), "cap": F.lit(-LEAST - 1), "floor": F.lit(LEAST)}).select(*wanted)
    near = search(blocks, every, space, positives, True)
    near = near.select(F.col("request").alias("anchor"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"), (F.col("request") * positives + F.col("rank") - 1).alias("request"))
    near = materialise(near.filter("positive_score >= 0"), "positives")  # a negative score has no scores between low and high
    # hundreds and the rest apart, so that no product is larger than a score
    share = "{0} * (positive_score div 100) + cast({1}({0} * (positive_score % 100) / 100D) as long)"
    asked = near.join(anchors, "anchor").withColumns({"cap": F.expr(share.format(high, "floor")), "floor": F.expr(share.format(low, "ceil"))})
    hard = search(blocks, asked.select(*wanted), space, negatives, False)
    named = near.join(anchors.select("anchor", "anchor_id"), "anchor").select("request", "anchor_id", "positive_id", "positive_score")
    out = hard.join(named, "request")
    return out.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


ORACLE = """
WITH rows AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND NOT list_bool_or(list_transform(embedding, lambda x: x IS NULL OR NOT isfinite(x)))
), scores AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM rows a JOIN rows b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
), positives AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM scores WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id)::INT AS rank,
  id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scores USING (anchor_id)
WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10
"""
