import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import xxhash

from stoplake.llm import simhash_trie
from stoplake.llm.registry import op12_simhash_trie

SCHEMA = "doc_id long, text string, print string, component_id string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(prints, ids, budget=2):
    up = list(range(len(prints)))

    def root(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    a = np.array(prints, np.uint64)
    for i in range(len(a)):
        for j in np.flatnonzero(np.bitwise_count(a[i] ^ a[:i]) <= budget):
            up[root(i)] = root(int(j))
    least = {}
    for i, d in enumerate(ids):
        least[root(i)] = min((x for x in (least.get(root(i)), d) if x is not None), default=None)
    return [least[root(i)] for i in range(len(a))]


def brute(rows):
    prints = [fingerprint(t) for _, t in rows]
    return Counter(zip([d for d, _ in rows], [f"{p:016x}" for p in prints], components(prints, [d for d, _ in rows])))


def got(df):
    return Counter(map(tuple, df.collect()))


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)


def near_prints(n, seed, loose=10):
    """Fingerprints around few centres, in which some bits are loose, and elsewhere."""
    rng = random.Random(seed)
    out = [rng.getrandbits(64) for _ in range(n // 4)]
    for _ in range(3):
        centre, bits = rng.getrandbits(64), rng.sample(range(64), loose)
        out += [centre ^ sum(1 << b for b in bits if rng.random() < 0.3) for _ in range(n // 4)]
    return sorted(set(out))


def test_query_matches_brute_force_on_whole_table(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in pq.read_table(f"{sf_dir}/documents.parquet").to_pylist()]
    assert got(op12_simhash_trie(spark, sf_dir)) == brute(rows)


def test_walk_finds_every_pair_once():
    for seed in range(4):
        a = np.array(near_prints(800, seed), np.uint64)
        found = [(int(x), int(y)) for i, j in simhash_trie.walk(a, a, 2) for x, y in zip(i, j)]
        near = np.nonzero(np.bitwise_count(a[:, None] ^ a) <= 2)
        assert len(found) == len(set(found)) and set(found) == set(zip(*(x.tolist() for x in near)))


def test_nodes_are_subtries_within_their_size(spark):
    prints = near_prints(2000, 5)
    df = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "print long")
    nodes = simhash_trie.nodes_of(df, 50).collect()
    leaves = [np.frombuffer(n.leaves, "<u8") for n in nodes]
    assert max(map(len, leaves)) <= 50 and len(np.unique(np.concatenate(leaves))) == sum(map(len, leaves)) == len(prints)
    assert all(simhash_trie.shared_bits(x[0], x[-1]) == n.depth for x, n in zip(leaves, nodes))


def test_crowded_prefixes_in_many_nodes(spark, monkeypatch):
    """The joined components equal those of all pairs, where nodes hold 20 leaves at most."""
    monkeypatch.setattr(simhash_trie, "NODE_LEAVES", 20)
    prints = near_prints(1200, 6, loose=14)
    ids = list(range(len(prints)))
    random.Random(7).shuffle(ids)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    monkeypatch.setattr(simhash_trie, "fingerprints", lambda docs: docs.selectExpr("doc_id", "cast(text as long) as print"))
    found = {r.doc_id: r.component_id for r in simhash_trie.join(table(spark, [(d, str(p)) for d, p in zip(ids, signed)])).collect()}
    want = dict(zip(ids, components(prints, ids)))
    assert found == want and 1 < len(set(want.values())) < len(want)


def test_awkward_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "One"), (5, "one"), (5, "one"), (None, "ONE"), (None, "a b c d e f g"), (6, "two words"), (7, "x " * 200_000), (8, "X " * 100_000), (9, "É a b"), (10, "é a b")]
    rows += [(20 + i, "tie tie tie tie and more words of one text") for i in range(30)]
    assert got(simhash_trie.join(table(spark, rows))) == brute(rows)


def test_texts_longer_than_a_block_of_hashes(monkeypatch):
    monkeypatch.setattr(simhash_trie, "COUNT_ROWS", 7)
    texts = ["a b", "", None, " ".join(f"w{i % 13}" for i in range(100)), "c " * 9, "d"]
    assert simhash_trie.prints_of(pa.array(texts)).tolist() == [fingerprint(t) for t in texts]


def test_empty_table(spark):
    assert got(simhash_trie.join(table(spark, []))) == Counter()
