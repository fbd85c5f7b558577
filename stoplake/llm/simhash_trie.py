"""SimHash near-duplicates (operator 12): a self-join of a binary trie of fingerprints within a Hamming budget.

1. A document's fingerprint has a bit where over half of its hashed 3-word shingles have it. Equal fingerprints are one
   leaf of the trie, with the least doc_id of its documents.
2. The trie is cut into nodes: fingerprints are range-dealt in their order, and each part closes a node as soon as its
   leaves fit a packed row, so crowded prefixes are cut deeper and all nodes are bounded.
3. Node pairs are found by walking the trie of nodes against itself: both prefixes take a bit at a time, differing bits
   add up, and a pair over the budget is dropped with all that is below it.
4. Each pair that is left is a row with the leaves of both nodes, and the same walk goes on inside it. Of the links of a
   pair of nodes a spanning forest is kept, which says all about components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stoplake.llm.common import discard, materialise, no_collector, prepare, release, split_words
from stoplake.llm.jaccard_join import contract

SHINGLE_WORDS, SEED, BITS, BUDGET = 3, 42, 64, 2
#: Leaves that a node may hold; a MOST_NODES-th of all fingerprints if that is more, so that the table of nodes stays small.
#: A trie has fewer than BITS * MOST_NODES nodes of which the parent is too large, and a part of the sort splits BITS more at most.
NODE_LEAVES, MOST_NODES = 1 << 14, 1 << 14
#: Hashes whose bits are counted at once, pairs of ranges walked at once, and leaf pairs at which a walk compares them all.
COUNT_ROWS, WALK_PAIRS, COMPARE = 1 << 16, 1 << 18, 64
SIGN = np.uint64(1 << 63)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and print (the 64 bits as a long) of each row of docs(doc_id, text); no words: zero."""
    prepare(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with no_collector():
            for batch in batches:
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(prints_of(batch.column("text")).view(np.int64))], names=["doc_id", "print"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(work, "doc_id long, print long")


def prints_of(texts: pa.Array) -> np.ndarray:
    words, at, starts = split_words(texts)
    words = [w.encode() for w in words]
    ones, total = np.zeros((len(texts), BITS), np.int64), np.zeros(len(texts), np.int64)
    digest, of, hashes = xxhash.xxh64_intdigest, [], []

    def count() -> None:
        """Add the bits of the hashes so far to their texts."""
        if not hashes:
            return
        bits = np.unpackbits(np.array(hashes, ">u8").view(np.uint8).reshape(-1, 8), axis=1)
        rows = np.repeat([r for r, _ in of], [n for _, n in of])
        first = np.flatnonzero(np.diff(rows, prepend=-1))
        ones[rows[first]] += np.add.reduceat(bits, first, axis=0, dtype=np.int64)
        total[rows[first]] += np.diff(first, append=len(rows))
        of.clear()
        hashes.clear()

    for row, (a, b) in enumerate(zip(starts[:-1].tolist(), starts[1:].tolist())):
        if a == b:
            continue
        width = min(SHINGLE_WORDS, b - a)
        for low in range(a, b - width + 1, COUNT_ROWS):
            high = min(low + COUNT_ROWS, b - width + 1)
            own = [words[k] for k in at[low : high + width - 1].tolist()]
            hashes += [digest(b" ".join(x), SEED) for x in zip(*(own[k:] for k in range(width)))]
            of.append((row, high - low))
            if len(hashes) >= COUNT_ROWS:
                count()
    count()
    set_bits = (2 * ones > total[:, None]).astype(np.uint8)
    return np.packbits(set_bits, axis=1).view(">u8").ravel().astype(np.uint64)


def nodes_of(prints: DataFrame, leaves: int) -> DataFrame:
    """node, depth, low (its first leaf) and leaves (sorted, packed) of the nodes that part the trie of prints(print)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.empty(0, np.uint64)
        for batch in batches:
            held = np.concatenate([held, np.asarray(batch.column("print")).view(np.uint64) ^ SIGN])
            # the last node may go on in the next batch
            while len(held) > leaves:
                n = first_node(held, leaves)
                yield _node(held[:n])
                held = held[n:]
        while len(held):
            n = first_node(held, leaves)
            yield _node(held[:n])
            held = held[n:]

    dealt = prints.select("print").repartitionByRange("print").sortWithinPartitions("print")
    return dealt.mapInArrow(work, "node binary, depth int, low long, leaves binary")


def shared_bits(a: np.uint64, b: np.uint64) -> int:
    return BITS - int(a ^ b).bit_length()


def first_node(sorted_leaves: np.ndarray, most: int) -> int:
    """How many leaves the largest node has that begins the sequence and holds no more than most."""
    if len(sorted_leaves) <= most:
        return len(sorted_leaves)
    # the node must end before leaf number most: it is the largest one with the first leaf but without that one
    depth = shared_bits(sorted_leaves[0], sorted_leaves[most]) + 1
    end = int(sorted_leaves[0]) >> (BITS - depth) << (BITS - depth) | (1 << BITS - depth) - 1
    return int(np.searchsorted(sorted_leaves[: most + 1], np.uint64(end), "right"))


def _node(leaves: np.ndarray) -> pa.RecordBatch:
    blob = leaves.astype("<u8").tobytes()
    name = blob[:8] + blob[-8:]
    depth = shared_bits(leaves[0], leaves[-1])
    columns = [pa.array([name], pa.binary()), pa.array([depth], pa.int32()), pa.array(leaves[:1].view(np.int64)), pa.array([blob], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=["node", "depth", "low", "leaves"])


def walk(a: np.ndarray, b: np.ndarray, budget: int, depth_a: np.ndarray | None = None, depth_b: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places in the sorted a and b whose values differ in at most budget bits: both tries are walked together.

    With depths, a value counts with so many first bits only, and a pair with those that both have.
    The walk goes depth first in blocks, so that the open pairs of ranges stay bounded.
    """
    if not len(a) or not len(b):
        return
    alike = shared_bits(min(a[0], b[0]), max(a[-1], b[-1]))  # bits that no pair differs in
    stack = [(alike, *(np.array([x], np.int64) for x in (0, len(a), 0, len(b), 0)))]
    while stack:
        bit, a0, a1, b0, b1, spent = stack.pop()
        stop = (a1 - a0) * (b1 - b0) <= COMPARE
        if bit == BITS:
            stop[:] = True
        elif depth_a is not None:  # a range with a node that ends here goes no deeper
            stop |= (np.minimum.reduceat(np.append(depth_a, BITS), np.stack([a0, a1], 1).ravel())[::2] <= bit) | (np.minimum.reduceat(np.append(depth_b, BITS), np.stack([b0, b1], 1).ravel())[::2] <= bit)
        yield from _compared(a, b, budget, depth_a, depth_b, *(x[stop] for x in (a0, a1, b0, b1)))
        a0, a1, b0, b1, spent = (x[~stop] for x in (a0, a1, b0, b1, spent))
        if not len(a0):
            continue
        am, bm = _middle(a, a0, a1, bit), _middle(b, b0, b1, bit)
        # children of both, with one more differing bit where they take different ways
        ways = ((a0, am, b0, bm, spent), (am, a1, bm, b1, spent), (a0, am, bm, b1, spent + 1), (am, a1, b0, bm, spent + 1))
        grown = [np.concatenate(x) for x in zip(*ways)]
        alive = (grown[0] < grown[1]) & (grown[2] < grown[3]) & (grown[4] <= budget)
        grown = [x[alive] for x in grown]
        for k in range(0, len(grown[0]), WALK_PAIRS):
            stack.append((bit + 1, *(x[k : k + WALK_PAIRS] for x in grown)))


def _middle(x: np.ndarray, low: np.ndarray, high: np.ndarray, bit: int) -> np.ndarray:
    """Where values with the bit set begin in each range, whose values share all bits before it."""
    shift = np.uint64(BITS - 1 - bit)
    return np.clip(np.searchsorted(x, (x[low] >> shift | np.uint64(1)) << shift), low, high)


def _compared(a, b, budget, depth_a, depth_b, a0, a1, b0, b1) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The near places of all pairs in each pair of ranges, in blocks of about WALK_PAIRS comparisons."""
    n = (a1 - a0) * (b1 - b0)
    for k in np.flatnonzero(n > WALK_PAIRS):  # ranges with a node that ends early
        rows = max(1, WALK_PAIRS // int(b1[k] - b0[k]))
        low = np.arange(a0[k], a1[k], rows)
        for cut in low:
            yield from _compared(a, b, budget, depth_a, depth_b, *(np.array([x], np.int64) for x in (cut, min(cut + rows, a1[k]), b0[k], b1[k])))
    small = n <= WALK_PAIRS
    a0, b0, b1, n = a0[small], b0[small], b1[small], n[small]
    ends = np.cumsum(n)
    cuts = np.flatnonzero(np.diff(ends // WALK_PAIRS, prepend=-1)).tolist() + [len(n)]
    for low, high in zip(cuts, cuts[1:]):
        pair = np.repeat(np.arange(low, high), n[low:high])
        at = np.arange(len(pair)) - (ends - n)[pair] + (ends - n)[low]
        wide = (b1 - b0)[pair]
        i, j = a0[pair] + at // wide, b0[pair] + at % wide
        differ = a[i] ^ b[j]
        if depth_a is not None:
            shared = np.minimum(depth_a[i], depth_b[j])
            differ = np.where(shared, differ >> np.minimum(BITS - shared, 63).astype(np.uint64), np.uint64(0))
        near = np.bitwise_count(differ) <= budget
        if near.any():
            yield i[near], j[near]


def node_pairs(nodes: DataFrame, budget: int) -> DataFrame:
    """x and y, the nodes that may hold leaves within budget of each other; each pair once, a node with itself too.

    Every task walks its nodes against all of them: a table of prefixes with 28 bytes for each, whose length has a bound (see MOST_NODES).
    """
    spark = nodes.sparkSession
    rows = nodes.select("node", "depth", "low").toArrow()
    low = np.asarray(rows["low"]).view(np.uint64)
    order = np.argsort(low)
    table = spark.sparkContext.broadcast((rows["node"].take(pa.array(order)).to_pylist(), low[order], np.asarray(rows["depth"])[order].astype(np.int64)))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, low, depth = table.value
        for batch in batches:
            own = np.sort(np.asarray(batch.column("id")))
            for i, j in walk(low[own], low, budget, depth[own], depth):
                i = own[i]
                i, j = i[i <= j], j[i <= j]
                yield pa.RecordBatch.from_arrays([pa.array([names[k] for k in x], pa.binary()) for x in (i, j)], names=["x", "y"])

    return spark.range(len(order)).mapInArrow(work, "x binary, y binary")


def unite(up: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Join the sets of places that pairs (i, j) link; up has the least place of each place's set, before and after."""
    while len(i):
        i, j = up[i], up[j]
        apart = i != j
        i, j = i[apart], j[apart]
        np.minimum.at(up, np.maximum(i, j), np.minimum(i, j))  # hooks larger roots to smaller ones
        while (up[up] != up).any():
            up[:] = up[up]


def links(nodes: DataFrame, pairs: DataFrame, budget: int) -> DataFrame:
    """u and v, fingerprints linked directly or through others of their pair of nodes: a spanning forest of each pair."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, y in zip(batch.column("left").to_pylist(), batch.column("right").to_pylist()):
                a, b = np.frombuffer(x, "<u8").astype(np.uint64), np.frombuffer(y, "<u8").astype(np.uint64)
                both = a if x == y else np.concatenate([a, b])
                shift, up = (0 if x == y else len(a)), np.arange(len(both))
                for i, j in walk(a, b, budget):
                    unite(up, i, j + shift)
                k = np.flatnonzero(up != np.arange(len(up)))
                if len(k):
                    u, v = both[k] ^ SIGN, both[up[k]] ^ SIGN
                    yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])

    left = nodes.select(F.col("node").alias("x"), F.col("leaves").alias("left"))
    right = nodes.select(F.col("node").alias("y"), F.col("leaves").alias("right"))
    return pairs.join(left, "x").join(right, "y").select("left", "right").mapInArrow(work, "u long, v long")


def join(docs: DataFrame, budget: int = BUDGET) -> DataFrame:
    """doc_id, fingerprint (16 lower-case hex digits) and component_id of each row of docs(doc_id, text).

    Rows link when their fingerprints differ in at most budget bits; component_id is the smallest doc_id that links
    reach. A null, empty or wordless text has fingerprint zero and links like any other. A row with a null doc_id takes
    part; its component_id is null only if no row with a doc_id is reached. Repeated rows are rows of their own. Other
    columns are not read, and an empty table gives no rows.
    """
    marked = materialise(fingerprints(docs), "prints")
    prints = materialise(marked.groupBy("print").agg(F.min("doc_id").alias("least")), "leaves")
    nodes = materialise(nodes_of(prints, max(NODE_LEAVES, -(-prints.count() // MOST_NODES))), "nodes")
    pairs = materialise(node_pairs(nodes, budget), "node_pairs")
    edges = materialise(links(nodes, pairs, budget), "links")
    for done in (nodes, pairs):
        discard(done)
    linked = edges.select(F.col("u").alias("node")).union(edges.select("v")).distinct()
    labels = materialise(linked.select("node", F.col("node").alias("component")), "labels")
    labels = contract(edges, labels)
    named = prints.join(labels, prints["print"] == labels.node, "left").select("print", "least", F.coalesce("component", "print").alias("component"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    by_print = materialise(named.join(least, "component").select("print", "component_id"), "components")
    discard(edges)
    release(docs.sparkSession)
    out = marked.join(by_print, "print")
    return out.select("doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id")
