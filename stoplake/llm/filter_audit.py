"""Filter interaction audit (operator 13): what five filters remove, in every order, from sorted duplicates and failure masks.

1. Rows are range-dealt by (text fingerprint, doc_id), so that a group of equal texts may cover many parts, and each
   part is sorted by fingerprint, full text and doc_id. One pass compares each row with its predecessor: a row fails E
   if its text has been seen in the part with a smaller doc_id.
2. A group that crosses a border is met at the ends of parts only. Rows of a part's first fingerprint carry a digest of
   their text, and each part reports the least doc_id of every text of its first and its last fingerprint: a few rows
   for each part. The least of those over all parts decides for the rows at a border.
3. Masks of failed filters are counted by part column and mask, which adds up; every figure of every order is a sum
   over the 32 masks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from itertools import permutations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from stoplake.llm.common import GAP_SQL, discard, materialise, prepare

#: The filters, in the order of their bits in a mask.
FILTERS = "ABCDE"
LEAST_WORDS, DISTINCT_PERCENT, UPPER_PERCENT, SIGNS = 50, 65, 5, "[#$%&*|]"
DUPLICATE = 1 << FILTERS.index("E")


def mask(text: Column) -> Column:
    """The bits of the filters A to D that a text fails; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(text, GAP_SQL), lambda w: w != "")
    upper = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    fails = (
        F.size(words) < LEAST_WORDS,
        100 * F.size(F.array_distinct(words)) < DISTINCT_PERCENT * F.size(words),
        100 * upper > UPPER_PERCENT * F.length(text),
        text.rlike(SIGNS),
    )
    return reduce(Column.bitwiseOR, (F.when(f, F.lit(1 << bit)).otherwise(F.lit(0)) for bit, f in enumerate(fails)))


def _digest(text: str) -> bytes:
    return hashlib.sha256(text.encode()).digest()


def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """part, doc_id, mask with E, and border (the text's digest, where earlier parts may hold the text) of rows in order.

    A row without part is a report for other parts: the least doc_id of a text of the first or last fingerprint.
    Only texts of the present fingerprint are held.
    """
    held: dict[str, int | None] = {}  # texts of the present fingerprint, each with its least doc_id
    now = text = border = None
    opening = True  # still in the first fingerprint

    def report() -> pa.RecordBatch:
        n = len(held)
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(([None] * n, list(held.values()), [0] * n, [_digest(t) for t in held]), TYPES)], names=NAMES)

    for batch in batches:
        if not batch.num_rows:
            continue
        texts, ids, masks = batch.column("text"), batch.column("doc_id").to_pylist(), batch.column("mask").to_pylist()
        # each text is held against its predecessor in Arrow, and looked at only where it is another one
        before = pa.concat_arrays([pa.array([text], texts.type), texts.slice(0, len(texts) - 1)])
        same = pc.fill_null(pc.equal(texts, before), False).to_pylist()
        borders = []
        for i, (fingerprint, doc_id) in enumerate(zip(batch.column("print").to_pylist(), ids)):
            if held and fingerprint != now:
                if opening:
                    yield report()
                opening, held, border = False, {}, None
            now = fingerprint
            if not same[i] or not held:
                text = texts[i].as_py()
                held[text] = None
                border = _digest(text) if opening else None
            least = held[text]
            if doc_id is not None:
                if least is None:
                    held[text] = doc_id
                elif doc_id > least:
                    masks[i] |= DUPLICATE
            borders.append(border)
        yield pa.RecordBatch.from_arrays([batch.column("part"), batch.column("doc_id"), pa.array(masks, pa.int32()), pa.array(borders, pa.binary())], names=NAMES)
    if held:
        yield report()


NAMES = ["part", "doc_id", "mask", "border"]
TYPES = (pa.string(), pa.int64(), pa.int32(), pa.binary())


def masks(docs: DataFrame, part: str = "source") -> DataFrame:
    """part, doc_id and mask of each row of docs(doc_id, text and the part column), written to the shared folder.

    A null text is an empty one, a null part an empty string. A row with a null doc_id has no smaller doc_id and is
    smaller than none, so it neither fails E nor lets others fail it; nor do rows that share a doc_id fail by each
    other. Other columns are not read.
    """
    prepare(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("print"))
    # borders of ranges are chosen by fingerprint, doc_id and, among rows that share both, the part of the input
    dealt = rows.repartitionByRange("print", "doc_id", F.spark_partition_id()).sortWithinPartitions("print", "text", "doc_id")
    seen = dealt.select("part", "doc_id", "text", "print", mask(F.col("text")).alias("mask")).mapInArrow(compare, "part string, doc_id long, mask int, border binary")
    seen = materialise(seen, "masks")
    least = materialise(seen.filter("border is not null").groupBy("border").agg(F.min("doc_id").alias("least")), "borders")
    plain = seen.filter("part is not null and border is null").select("part", "doc_id", "mask")
    # a few rows for each part of the sort: Spark broadcasts them while they are small and splits hot borders otherwise
    at_border = seen.filter("part is not null and border is not null").join(least, "border", "left")
    late = F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False))
    at_border = at_border.select("part", "doc_id", F.when(late, F.col("mask").bitwiseOR(F.lit(DUPLICATE))).otherwise(F.col("mask")).alias("mask"))
    out = materialise(plain.unionByName(at_border), "audit")
    discard(seen)
    discard(least)
    return out


def counters(marked: DataFrame, labels: DataFrame) -> DataFrame:
    """n, good and toxic rows of each part and mask: sums, so counters of several tables add up.

    A document is good (toxic) if any row of labels(doc_id, quality, toxic) says so; labels without doc_id say nothing.
    """
    said = labels.filter("quality = 1 or toxic = 1").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    said = said.agg(F.max(F.expr("quality <=> 1").cast("long")).alias("good"), F.max(F.expr("toxic <=> 1").cast("long")).alias("toxic"))
    none = F.lit(0).cast("long")
    every = marked.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n")).select("part", "mask", "n", none.alias("good"), none.alias("toxic"))
    flagged = marked.join(said, "doc_id").groupBy("part", "mask").agg(none.alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))
    return every.unionByName(flagged).groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in ("n", "good", "toxic")])


FIGURES = ("kept", "removed", "redundant", "unique_fails", "shapley")


def rules(spark: SparkSession) -> DataFrame:
    """For each order of the filters, step and mask: how often a row with this mask counts in each figure (19,200 rows, always)."""
    rows = []
    for order in permutations(range(len(FILTERS))):
        gone = 0
        for step, bit in enumerate(order, 1):
            for m in range(1 << len(FILTERS)):
                fails, earlier = m >> bit & 1, bool(m & gone)
                # the filter is the first of a row's failures in 120 / failures of the orders
                share = 120 // m.bit_count() if fails else 0
                rows.append(("".join(FILTERS[b] for b in order), step, m, int(not m & (gone | 1 << bit)), int(fails and not earlier), int(fails and earlier), int(m == 1 << bit), share))
            gone |= 1 << bit
    kinds = [StructField("filter_order", StringType()), StructField("step", IntegerType()), StructField("mask", IntegerType()), *(StructField(f, LongType()) for f in FIGURES)]
    return spark.createDataFrame(rows, StructType(kinds))


def report(counted: DataFrame) -> DataFrame:
    """part, filter_order, step and the figures of every part in counters(), zeros included."""
    rows = counted.join(F.broadcast(rules(counted.sparkSession)), "mask")
    sums = [F.sum(F.col(f) * F.col("n")).alias(f) for f in FIGURES] + [F.sum(F.col("removed") * F.col(f)).alias(f"{f}_lost") for f in ("good", "toxic")]
    order = ("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    return rows.groupBy("part", "filter_order", "step").agg(*sums).select(*order)


def audit(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """One row for each part, order of the five filters and step; see report(). An empty table has no parts."""
    marked = masks(docs, part)
    return report(counters(marked, labels))


ORACLE = """
WITH words AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), fails AS (
  SELECT doc_id, part,
    len(w) < 50 AS a,
    100 * len(list_distinct(w)) < 65 * len(w) AS b,
    100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text) AS c,
    regexp_matches(text, '[#$%&*|]') AS d,
    coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false) AS e
  FROM words
), flags AS (
  SELECT doc_id, max((quality IS NOT DISTINCT FROM 1)::INT) AS good, max((toxic IS NOT DISTINCT FROM 1)::INT) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
), counted AS (
  SELECT part, concat(if(a, 'A', ''), if(b, 'B', ''), if(c, 'C', ''), if(d, 'D', ''), if(e, 'E', '')) AS failed,
    count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
  FROM fails LEFT JOIN flags USING (doc_id) GROUP BY ALL
), f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
  SELECT p.x || q.x || r.x || s.x || t.x AS filter_order FROM f p, f q, f r, f s, f t
  WHERE len(list_distinct([p.x, q.x, r.x, s.x, t.x])) = 5
), steps AS (
  SELECT filter_order, i::INT AS step, filter_order[i] AS filter, filter_order[:i - 1] AS earlier FROM orders, range(1, 6) AS g(i)
), facts AS (
  SELECT part, filter_order, step, filter, n, good, toxic,
    contains(failed, filter) AS fails, failed = filter AS alone,
    earlier <> '' AND regexp_matches(failed, '[' || earlier || '-]') AS gone
  FROM counted, steps
), figures AS (
  SELECT part, filter_order, step, filter,
    sum(if(NOT fails AND NOT gone, n, 0)) AS kept, sum(if(fails AND NOT gone, n, 0)) AS removed, sum(if(fails AND gone, n, 0)) AS redundant,
    sum(if(alone, n, 0)) AS unique_fails, sum(if(fails AND NOT gone, good, 0)) AS good_lost, sum(if(fails AND NOT gone, toxic, 0)) AS toxic_lost
  FROM facts GROUP BY ALL
)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
  good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, filter))::BIGINT AS shapley
FROM figures
"""
