import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from stoplake.llm import hard_negatives
from stoplake.llm.registry import op11_hard_negatives

SCHEMA = "vec_id long, label int, embedding array<double>, rank string, vec string"


def brute(rows, anchors, positives=5, negatives=10, low=30, high=90):
    good = [(i, c, tuple(math.floor(256 * x) for x in v)) for i, c, v in rows if i is not None and c is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, label, q in {r for r in good if anchors(r[0])}:
        scored = sorted((-sum(x * y for x, y in zip(q, v)), i, c) for i, c, v in good if i != a)
        for s, p, _ in [r for r in scored if r[2] == label][:positives]:
            hard = [(-t, i) for t, i, c in scored if c != label and low * -s <= 100 * -t <= high * -s][:negatives]
            out += [(a, p, k, i, -s, t) for k, (t, i) in enumerate(hard, 1)]
    return sorted(out)


def got(spark, rows, anchors, **options):
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)
    return sorted(map(tuple, hard_negatives.mine(df, anchors, **options).collect()))


@pytest.fixture
def small_sample(monkeypatch):
    """Targets and pivots from 20 rows, blocks of few rows and packs of few anchors."""
    monkeypatch.setattr(hard_negatives, "SAMPLE_ROWS", 20)
    monkeypatch.setattr(hard_negatives, "PIVOTS", 6)
    monkeypatch.setattr(hard_negatives, "BLOCK_BYTES", 2000)
    monkeypatch.setattr(hard_negatives, "PACK_BYTES", 500)


def random_rows(n, seed, dims=5, labels=3):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(4)]
    return [(i, rng.randrange(labels), [x + rng.gauss(0, 0.2) * rng.choice((0.1, 1, 3)) for x in rng.choice(centres)]) for i in range(n)]


def test_radii_grow_to_the_exact_result(spark, small_sample):
    rows = random_rows(400, 1)
    assert got(spark, rows, F.col("vec_id") % 10 == 0) == brute(rows, lambda i: i % 10 == 0)


def test_other_numbers_and_few_rows(spark, small_sample):
    rows = random_rows(60, 2, labels=2)
    options = {"positives": 30, "negatives": 40, "low": -20, "high": 100}
    assert got(spark, rows, F.col("vec_id") < 9, **options) == brute(rows, lambda i: i < 9, **options)


def test_a_vector_that_a_third_of_the_rows_have(spark, small_sample):
    rows = random_rows(120, 3) + [(1000 + i, i % 2, [0.5, 0.25, 0.0, 1.0, -0.5]) for i in range(60)]
    want = brute(rows, lambda i: i % 7 == 0)
    assert got(spark, rows, F.col("vec_id") % 7 == 0) == want and len(want) > 500


def test_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, 1, [1.0, 0.5]), (1, 1, [0.5, 0.5]), (2, 2, [0.4, 0.4]), (3, None, [1.0, 1.0]), (4, 2, None), (5, 2, [nan, 0.4]), (6, 2, [0.4, inf]), (7, 2, [0.4, None])]
    rows += [(None, 2, [0.4, 0.4]), (8, 2, [0.4]), (9, 2, []), (10, 1, [-1.0, 0.0]), (2, 2, [0.4, 0.4]), (0, 1, [1.0, 0.5]), (11, 3, [0.4, 0.4])]
    want = brute(rows, lambda i: i == 0)
    assert got(spark, rows, F.col("vec_id") == 0) == want and {r[3] for r in want} == {2, 8, 11}


def test_scores_beyond_exact_doubles(spark):
    rng = random.Random(4)
    rows = [(i, i % 2, [rng.choice((-1, 1)) * 2.0**20 + rng.random() for _ in range(6)]) for i in range(40)]
    assert got(spark, rows, F.col("vec_id") < 8) == brute(rows, lambda i: i < 8)


def test_empty_table(spark):
    assert got(spark, [], F.col("vec_id") == 0) == []


def test_query_matches_sql(spark):
    folder = "/root/testdata/sf0.01"
    c = duckdb.connect()
    c.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet'")
    rows = op11_hard_negatives(spark, folder)
    want = c.sql(hard_negatives.ORACLE)
    assert rows.columns == want.columns and sorted(map(tuple, rows.collect())) == sorted(want.fetchall())
