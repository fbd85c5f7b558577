import random
import re
from itertools import combinations

import pyarrow.parquet as pq

from stoplake.llm import jaccard_join
from stoplake.llm.registry import op7_jaccard_join

SCHEMA = "doc_id long, text string, node string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def in_order(row):
    return [(x is None, x or 0) for x in row]


def brute(rows):
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in combinations(range(len(rows)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            up[root(a)] = root(b)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        least[root(i)] = min([x for x in (least.get(root(i)), doc_id) if x is not None], default=None)
    return sorted(((d, len(s), least[root(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=in_order)


def got(df):
    return sorted(map(tuple, df.collect()), key=in_order)


def test_query_matches_brute_force_on_whole_table(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in pq.read_table(f"{sf_dir}/documents.parquet").to_pylist()]
    assert got(op7_jaccard_join(spark, sf_dir)) == brute(rows)


def test_random_edits_chains_and_shared_passages(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefg", k=4))
    passage = [word() for _ in range(40)]
    rows = []
    for family in range(12):
        text = [word() for _ in range(rng.choice((3, 5, 6, 12, 60)))] + passage * (family % 3 == 0)
        for _ in range(rng.choice((1, 3, 12))):
            new = list(text)
            for _ in range(rng.choice((0, 0, 1, 1, 2, 3))):
                new[rng.randrange(len(new))] = word()
            rows.append((rng.randrange(10_000), " ".join(new)))
            if rng.random() < 0.3:  # chains: the next copy starts from this one
                text = new
    assert got(jaccard_join.join(spark.createDataFrame([(*r, "x") for r in rows], SCHEMA))) == brute(rows)


def test_many_near_copies_of_an_absent_text(spark):
    rng = random.Random(6)
    text = [f"w{i}" for i in range(100)]
    rows = []
    for k in range(60):  # pairs of copies are often under the limit
        new = list(text)
        for _ in range(rng.choice((1, 2, 2))):
            new[rng.randrange(100)] = f"x{rng.randrange(10**6)}"
        rows.append((k, " ".join(new)))
    assert got(jaccard_join.join(spark.createDataFrame([(*r, "x") for r in rows], SCHEMA))) == brute(rows)


def test_awkward_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "One two"), (5, "one\ttwo"), (5, "other words here"), (None, "ONE TWO"), (None, "lonely"), (7, "x " * 5000), (8, "x " * 4000), (9, "É a"), (10, "é a")]
    assert got(jaccard_join.join(spark.createDataFrame([(*r, "x") for r in rows], SCHEMA))) == brute(rows)


def test_empty_table(spark):
    assert got(jaccard_join.join(spark.createDataFrame([], SCHEMA))) == []


def test_hot_shingles(spark, monkeypatch):
    """A passage in a third of all texts, and a group of near copies of a third, past the limit for hot shingles."""
    rng = random.Random(8)
    monkeypatch.setattr(jaccard_join, "HOT_DOCS", 5)
    monkeypatch.setattr(jaccard_join, "GROUP_ROWS", 50)
    passage, text = [f"p{i}" for i in range(30)], [f"t{i}" for i in range(80)]
    rows = []
    for k in range(240):
        own = [f"o{rng.randrange(10**6)}" for _ in range(40)]
        if k % 3 == 0:
            new = own[:20] + passage + own[20:]
        elif k % 3 == 1:
            new = [w if rng.random() > 0.015 else f"x{rng.randrange(10**6)}" for w in text]
        else:
            new = own if rng.random() > 0.2 else passage + own[:1]
        rows.append((k, " ".join(new)))
    assert got(jaccard_join.join(spark.createDataFrame([(*r, "x") for r in rows], SCHEMA).repartition(3))) == brute(rows)


def test_pieces_of_a_part_are_bounded():
    """A part is handled in pieces that end between two shingles: together they give what the whole gives."""
    import numpy as np

    rng = np.random.default_rng(1)
    h, node = np.sort(rng.integers(0, 400, 5000).astype(np.uint64)), rng.integers(0, 90, 5000)
    want = [b.to_pydict() for b in jaccard_join.shared_piece(h, node, np.zeros(0, np.uint64), 1)]
    sizes, found = [], []

    def seen(h, node, hot, n_parts, real=jaccard_join.shared_piece):
        sizes.append(len(h))
        return real(h, node, hot, n_parts)

    rows = list(jaccard_join.pieces(h, node, 300))
    assert max(len(x) for x, _ in rows) <= 300 + int(np.bincount(h.astype(int)).max())
    for x, y in rows:
        found += [b.to_pydict() for b in seen(x, y, np.zeros(0, np.uint64), 1)]
    flat = lambda bs: sorted(zip(*(np.concatenate([jaccard_join.unpacked(b["payload"], "<u8", "<i8", "u1")[i] for b in bs]).tolist() for i in range(3))))
    assert len(sizes) > 10 and flat(found) == flat(want)
