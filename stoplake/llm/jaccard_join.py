"""N-gram Jaccard self-join with connected components (operator 7), by vertical partitioning.

A document's set is its distinct five-word shingles, hashed; equal word sequences are one node. The global
order of shingles is by their level, rare ones first, then by hash: the level is the logarithm of the number
of nodes that have a shingle, and the last one for shingles that are hot in some group of documents.

1. Counts. Postings are dealt by shingle, and each part finds the shingles that two or more nodes share. Hot
   shingles skip this: the group that finds one knows that it is shared, tells its part and sends its
   postings by node, so that no task has all postings of a hot shingle. A node whose shared shingles are under
   75 % of its set links with nothing and leaves the join.
2. Candidates. Linked sets share a shingle in the prefix of the global order, and at the first one that
   they share neither has fewer shingles left than a link needs (prefix and position filter). First each node
   is paired with one centre, so that a group of near copies becomes few components at a cost in proportion
   to its size. Then, where the nodes of a prefix shingle are not all in one component yet, those with the
   fewest rarer shingles become centres, and every node of another component is paired with them. The number
   of centres grows by rounds, a round contracts what it links and drops shingles that are within one
   component; rounds end when no pair is left that could join two components. Every pair that could do so is
   compared in the end: no cap on partners.
3. Overlaps. The global order is cut into ranges, the fragments. The pairs' common shingles are counted in
   each fragment separately and summed by pair.

Shingles travel as packed arrays, a few rows for thousands of documents; only pairs, labels and the prefixes
of nodes that are left are rows. Hashes have 64 bits; two shingles that clash would count as one.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from stoplake.llm.common import discard, materialise, prepare, release, texts_of

SHINGLE_WORDS, NUMERATOR, DENOMINATOR = 5, 75, 100
#: Shingles that a task takes together, about; bytes of text for each; postings that it handles at a time.
PART_SHINGLES, SHINGLE_BYTES, PIECE_POSTINGS = 1_000_000, 7, 250_000
#: Fragments of the global order in which a pair's overlap is counted, and bits of the hash that cut a level.
OVERLAP_FRAGMENTS, BIN_BITS = 4, 4
#: Centres for each prefix shingle in the first round; each later round has GROWTH times as many.
CENTRES, GROWTH = 1, 8
#: Shingles, and rows, that a task packs together.
GROUP_SHINGLES, GROUP_ROWS = 500_000, 8192
#: A shingle that more than so many nodes of a group have, and a share of them, is hot: last in the global order.
HOT_DOCS, HOT_SHARE, HOT_LEVEL = 64, 16, 127
MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64)


def normal_words(text: str) -> list[bytes]:
    """Words between ASCII white space, A-Z in lower case."""
    return text.encode().lower().split()


def word_hashes(words: list[bytes], known: dict[bytes, int]) -> np.ndarray:
    """64-bit hashes; known keeps those of short words and is emptied when large."""
    try:
        return np.array([known[w] for w in words], np.uint64)
    except KeyError:
        import xxhash

        if len(known) > 200_000:
            known.clear()
        for w in set(words):
            if w not in known:
                known[w] = xxhash.xxh3_64_intdigest(w)
        return np.array([known[w] for w in words], np.uint64)


def shingles(words: list[bytes], known: dict[bytes, int]) -> np.ndarray:
    """Sorted distinct hashes of five-word shingles; fewer words are one shingle, none give none."""
    if not words:
        return np.zeros(0, np.uint64)
    h = word_hashes(words, known)
    n = max(1, len(h) - SHINGLE_WORDS + 1)
    out = np.full(n, min(len(h), SHINGLE_WORDS), np.uint64)
    for k in range(min(len(h), SHINGLE_WORDS)):
        out = (out ^ h[k : k + n]) * MULTIPLIERS[k]
        out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(32)
    return np.unique(out)


def node_of(words: list[bytes]) -> int:
    return struct.unpack("<q", hashlib.md5(b" ".join(words)).digest()[:8])[0]


def packed(part: np.ndarray, *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows (part, payload): the columns' values of each part, one after the other."""
    order = np.argsort(part, kind="stable")
    part = part[order]
    columns = tuple(c[order] for c in columns)
    edges = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]])) if len(part) else np.zeros(1, int)
    parts = part[edges[:-1]] if len(part) else part
    blobs = [b"".join(c[a:b].tobytes() for c in columns) for a, b in zip(edges, edges[1:])]
    yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(blobs, pa.binary())], names=["part", "payload"])


def unpacked(blobs: list[bytes], *kinds: str) -> list[np.ndarray]:
    """The columns of packed rows, joined."""
    width = sum(np.dtype(k).itemsize for k in kinds)
    out: list[list[np.ndarray]] = [[] for _ in kinds]
    for blob in blobs:
        n, at = len(blob) // width, 0
        for o, k in zip(out, kinds):
            o.append(np.frombuffer(blob, k, n, at))
            at += n * np.dtype(k).itemsize
    return [np.concatenate(o) if o else np.zeros(0, k) for o, k in zip(out, kinds)]


def parts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[list[bytes]]:
    """The payloads of each part, of rows sorted by part."""
    return (blobs for _, blobs in numbered_parts(batches))


def numbered_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[bytes]]]:
    now, held = None, []
    for batch in batches:
        for part, blob in zip(batch.column("part").to_pylist(), batch.column("payload").to_pylist()):
            if part != now and held:
                yield now, held
                held = []
            now = part
            held.append(blob)
    if held:
        yield now, held


def cut_hashes(h: np.ndarray) -> np.ndarray:
    """The low seven bytes of each hash; with the part they tell shingles apart."""
    return np.ascontiguousarray(h.view(np.uint8).reshape(-1, 8)[:, :7])


def whole_hashes(raw: np.ndarray, part: int) -> np.ndarray:
    """Part and low bytes as one 64-bit number, in place of the hash from here on."""
    out = np.empty((len(raw) // 7, 8), np.uint8)
    out[:, :7] = raw.reshape(-1, 7)
    out[:, 7] = part & 0xFF
    return out.reshape(-1).view(np.uint64)


def level_of(n_nodes: np.ndarray) -> np.ndarray:
    """The first part of the global order: half steps of the logarithm of a shingle's nodes."""
    return np.minimum(2 * np.log2(n_nodes), HOT_LEVEL - 1).astype(np.uint8)


def node_part(node: np.ndarray, n_parts: int) -> np.ndarray:
    return (node.view(np.uint64) % np.uint64(n_parts)).astype(np.int32)


#: Kinds of packed rows: postings (shingle, node) by shingle, shingles that are hot in some group, postings of
#: hot shingles by node, and documents (node, doc_id, shingles, whether the id is null) by node.
POSTINGS, HOT, HOT_POSTINGS, DOCUMENTS = range(4)
PACKED = "part int, kind int, payload binary"


def _kind(kind: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if b.num_rows:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.full(b.num_rows, kind, np.int32)), b.column(1)], names=["part", "kind", "payload"])


def posting_rows(docs: DataFrame, n_parts: int) -> DataFrame:
    """Packed rows of docs(doc_id, text), in groups of bounded size; a task sends each node's shingles once."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        seen: dict[int, int] = {}
        held: list[tuple[np.ndarray, int]] = []
        rows: list[tuple[int, int, int, int]] = []
        total = 0

        def send() -> Iterator[pa.RecordBatch]:
            node, doc, n, none = (np.array(c, k) for c, k in zip(zip(*rows), ("<i8", "<i8", "<u4", "u1")))
            yield from _kind(DOCUMENTS, packed(node_part(node, n_parts), node, doc, n, none))
            if not held:
                return
            h = np.concatenate([x for x, _ in held])
            node = np.repeat(np.array([k for _, k in held], np.int64), [len(x) for x, _ in held])
            each, inverse, count = np.unique(h, return_inverse=True, return_counts=True)
            hot = count > max(HOT_DOCS, len(held) // HOT_SHARE)
            if hot.any():
                yield from _kind(HOT, packed(part_of(each[hot], n_parts), cut_hashes(each[hot])))
                is_hot = hot[inverse]
                part = part_of(h[is_hot], n_parts)
                yield from _kind(HOT_POSTINGS, packed(node_part(node[is_hot], n_parts), whole_hashes(cut_hashes(h[is_hot]).reshape(-1), part), node[is_hot]))
                h, node = h[~is_hot], node[~is_hot]
            yield from _kind(POSTINGS, packed(part_of(h, n_parts), cut_hashes(h), node))

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts_of(batch)):
                words = normal_words(text)
                node = node_of(words) if words else wordless(doc_id)
                if not words:
                    n = 0
                elif node in seen:
                    n = seen[node]
                else:
                    if len(seen) > 200_000:
                        seen.clear()
                    h = shingles(words, known)
                    n = seen[node] = len(h)
                    held.append((h, node))
                    total += n
                rows.append((node, doc_id or 0, n, doc_id is None))
                if total >= GROUP_SHINGLES or len(rows) >= GROUP_ROWS:
                    yield from send()
                    held, rows, total = [], [], 0
        if rows:
            yield from send()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(work, PACKED)


def wordless(doc_id: int | None) -> int:
    """Where the row of a text without words goes: it is no node."""
    return (doc_id or 0) * 0x9E3779B9 % (1 << 62)


def part_of(h: np.ndarray, n_parts: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(n_parts) >> np.uint64(32)).astype(np.int32)


def by_part(rows: DataFrame, n_parts: int) -> DataFrame:
    return rows.repartition(n_parts, "part").sortWithinPartitions("part")


def kinds_of_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, dict[int, list[bytes]]]]:
    """Each part and its payloads by kind, of rows sorted by part."""
    now, held = None, {}
    for batch in batches:
        for part, kind, blob in zip(*(batch.column(c).to_pylist() for c in ("part", "kind", "payload"))):
            if part != now and held:
                yield now, held
                held = {}
            now = part
            held.setdefault(kind, []).append(blob)
    if held:
        yield now, held


def shared_rows(postings: DataFrame, n_parts: int) -> DataFrame:
    """By node: the shingles that two or more nodes have, with their level, and what was by node already."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, blobs in kinds_of_parts(batches):
            for kind in (HOT_POSTINGS, DOCUMENTS):
                for blob in blobs.pop(kind, ()):
                    yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([kind], pa.int32()), pa.array([blob], pa.binary())], names=["part", "kind", "payload"])
            hot = whole_hashes(unpacked(blobs.pop(HOT, []), "V7")[0].view(np.uint8), part)
            hot.sort()
            raw, node = unpacked(blobs.pop(POSTINGS, []), "V7", "<i8")
            h = whole_hashes(raw.view(np.uint8), part)
            del raw
            order = np.argsort(h, kind="stable")
            h, node = h[order], node[order]
            del order, blobs
            for piece in pieces(h, node, PIECE_POSTINGS):
                yield from _kind(POSTINGS, shared_piece(*piece, hot, n_parts))

    return postings.mapInArrow(work, PACKED)


def pieces(h: np.ndarray, node: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Postings sorted by shingle in pieces of about most, which end between two shingles."""
    a = 0
    while a < len(h):
        b = int(np.searchsorted(h, h[min(a + most, len(h)) - 1], "right"))
        yield h[a:b], node[a:b]
        a = b


def shared_piece(h: np.ndarray, node: np.ndarray, hot: np.ndarray, n_parts: int) -> Iterator[pa.RecordBatch]:
    """Of postings sorted by shingle, those of shared shingles packed by node: shingle, node, level."""
    order = np.lexsort((node, h))
    h, node = h[order], node[order]
    new = np.concatenate([[True], (h[1:] != h[:-1]) | (node[1:] != node[:-1])])  # several tasks can send a node
    h, node = h[new], node[new]
    edges = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1], [True]]))
    level = np.repeat(level_of(np.diff(edges)), np.diff(edges))
    if len(hot):
        level[hot[np.minimum(np.searchsorted(hot, h), len(hot) - 1)] == h] = HOT_LEVEL
    shared = level > 0
    h, node, level = h[shared], node[shared], level[shared]
    yield from packed(node_part(node, n_parts), h, node, level)


FOUND = "node long, size int, shared int, hashes binary, levels binary, prefix array<long>, doc_id long, n_shingles long"


def survivors(shared: DataFrame) -> DataFrame:
    """Nodes that share at least 75 % of their set, with their shared shingles in the global order; and the documents.

    A row of a document has node (null without words), doc_id and n_shingles, all others of a node are null.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, blobs in kinds_of_parts(batches):
            known, doc, n, none = unpacked(blobs.pop(DOCUMENTS, []), "<i8", "<i8", "<u4", "u1")
            if len(known):
                nulls = pa.nulls(len(known), pa.int32())
                blank = pa.nulls(len(known), pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(known, pa.int64(), mask=n == 0), nulls, nulls, blank, blank, pa.nulls(len(known), pa.list_(pa.int64())), pa.array(doc, pa.int64(), mask=none.astype(bool)), pa.array(n.astype(np.int64))],
                    names=FOUND_NAMES,
                )
            h, node, level = unpacked(blobs.pop(POSTINGS, []), "<u8", "<i8", "u1")
            hot, hot_node = unpacked(blobs.pop(HOT_POSTINGS, []), "<u8", "<i8")
            if len(hot):
                h, node, level = np.concatenate([h, hot]), np.concatenate([node, hot_node]), np.concatenate([level, np.full(len(hot), HOT_LEVEL, np.uint8)])
            if not len(h):
                continue
            order = np.lexsort((h, level, node))
            h, node, level = h[order], node[order], level[order]
            new = np.concatenate([[True], (h[1:] != h[:-1]) | (node[1:] != node[:-1])])
            h, node, level = h[new], node[new], level[new]
            edges = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1], [True]]))
            first, count = edges[:-1], np.diff(edges)
            order = np.argsort(known)
            size = n[order][np.searchsorted(known[order], node[first])].astype(np.int64)
            least = -(-NUMERATOR * size // DENOMINATOR)
            live = np.flatnonzero(count >= least)
            # shingles of its own come first in a node's order
            ahead = np.maximum(count + 1 - least, 0)
            for k in range(0, len(live), 128):
                each = live[k : k + 128]
                spans = [slice(first[i], first[i] + count[i]) for i in each]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(node[first[each]]), pa.array(size[each], pa.int32()), pa.array(count[each], pa.int32()),
                        pa.array([h[x].tobytes() for x in spans], pa.binary()), pa.array([level[x].tobytes() for x in spans], pa.binary()),
                        pa.array([h[x][: ahead[i]].view(np.int64) for x, i in zip(spans, each)], pa.list_(pa.int64())),
                        pa.nulls(len(each), pa.int64()), pa.nulls(len(each), pa.int64()),
                    ],
                    names=FOUND_NAMES,
                )

    return shared.mapInArrow(work, FOUND)


FOUND_NAMES = [c.split()[0] for c in FOUND.split(", ")]


def prefix_postings(alive: DataFrame) -> DataFrame:
    """h, node, size, position of each prefix shingle: where two sets share none, they don't link."""
    each = alive.select("node", "size", "shared", F.posexplode("prefix").alias("k", "h"))
    return each.select("h", "node", "size", (F.col("size") - F.col("shared") + F.col("k")).alias("position"))


def may_link(size_a: str, position_a: str, size_b: str, position_b: str) -> F.Column:
    """Whether sets can link whose first common shingle is at these positions of the global order."""
    a, b = F.col(size_a).cast("long"), F.col(size_b).cast("long")
    need = F.ceil(NUMERATOR * (a + b) / (NUMERATOR + DENOMINATOR))
    return F.least(a - F.col(position_a), b - F.col(position_b)) >= need


def seeds(postings: DataFrame) -> DataFrame:
    """One pair (a, b, both) for each node b that has any: with the least centre among its prefix shingles'.

    A shingle's centre is the node with the fewest rarer shingles. Centres are found by partial sums before the
    shuffle, and the join back is one that Spark can split, so a shingle that many nodes have is no one task.
    """
    first = F.min(F.struct("position", (-F.col("size")).alias("neg"), "node")).alias("c")
    centre = postings.groupBy("h").agg(first, F.count(F.lit(1)).alias("n")).filter("n > 1")
    centre = centre.select("h", F.col("c.node").alias("a"), (-F.col("c.neg")).alias("size_a"), F.col("c.position").alias("position_a"))
    met = postings.join(centre, "h").filter((F.col("a") != F.col("node")) & may_link("size_a", "position_a", "size", "position"))
    best = met.groupBy(F.col("node").alias("b")).agg(F.min(F.struct("a", (F.col("size_a") + F.col("size")).alias("both"))).alias("x"))
    return best.select(F.col("x.a").alias("a"), "b", F.col("x.both").cast("long").alias("both"))


def open_postings(postings: DataFrame, labels: DataFrame, done: int) -> DataFrame:
    """postings with component, of shingles with nodes of two components beyond the centres that are done.

    Extremes of components are summed up before the shuffle; a shingle that is not open stays so.
    """
    each = postings.drop("component").join(labels, "node")
    spread = each.groupBy("h").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count(F.lit(1)).alias("n"))
    return each.join(spread.filter((F.col("x") < F.col("y")) & (F.col("n") > done + 1)).select("h"), "h", "left_semi").select("h", "node", "component", "size", "position")


def candidates(postings: DataFrame, done: int, centres: int) -> DataFrame:
    """Pairs (a, b, size sum) of nodes in two components: a among a shingle's centres done to centres."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[tuple[int, int]] = set()
        out: list[tuple[int, int, int]] = []
        for node, comp, size, position in shingle_runs(batches):
            left = size - position  # at their first common shingle two sets share this much at most
            n = len(node)
            if n - done < 2 or (comp[done:] == comp[done]).all():
                continue
            for c in range(done, min(centres, n)):
                # pairs with earlier centres are their pairs
                need = -(-NUMERATOR * (size[c + 1 :] + size[c]) // (NUMERATOR + DENOMINATOR))  # least overlap of a link
                fit = (comp[c + 1 :] != comp[c]) & (np.minimum(left[c + 1 :], left[c]) >= need)
                for k in np.flatnonzero(fit) + c + 1:
                    pair = (int(node[c]), int(node[k]))
                    if pair not in sent:
                        if len(sent) > 200_000:
                            sent.clear()
                        sent.add(pair)
                        out.append((*pair, int(size[c] + size[k])))
                        if len(out) >= 10_000:
                            yield _pairs(out)
                            out = []
        if out:
            yield _pairs(out)

    order = ["h", "position", F.desc("size"), "node"]
    return postings.repartition("h").sortWithinPartitions(*order).mapInArrow(work, "a long, b long, both long").distinct()


def shingle_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """node, component, size and position of each shingle's rows, of rows sorted by shingle."""
    held, now = [], None
    for batch in batches:
        h, *rest = (batch.column(c).to_numpy() for c in ("h", "node", "component", "size", "position"))
        edges = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1], [True]])) if len(h) else []
        for a, b in zip(edges, edges[1:]):
            if held and h[a] != now:
                yield _joined(held)
                held = []
            now = h[a]
            held.append([x[a:b].astype(np.int64) for x in rest])
    if held:
        yield _joined(held)


def _joined(held: list[list[np.ndarray]]) -> tuple[np.ndarray, ...]:
    return tuple(np.concatenate(x) for x in zip(*held))


def _pairs(rows: list[tuple[int, int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=["a", "b", "both"])


def order_bin(level: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Bins that follow the global order: level, then the first bits of the hash."""
    return (level.astype(np.int64) << BIN_BITS) | (h >> np.uint64(64 - BIN_BITS)).astype(np.int64)


def fragment_edges(alive: DataFrame) -> list[int]:
    """The bins at which the global order is cut into fragments of about equal numbers of shingles."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((HOT_LEVEL + 1) << BIN_BITS, np.int64)
        for batch in batches:
            for h, level in zip(batch.column("hashes").to_pylist(), batch.column("levels").to_pylist()):
                n += np.bincount(order_bin(np.frombuffer(level, "u1"), np.frombuffer(h, "<u8")), minlength=len(n))
        k = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(n[k], pa.int64())], names=["bin", "n"])

    rows = alive.select("hashes", "levels").mapInArrow(work, "bin int, n long").groupBy("bin").agg(F.sum("n").alias("n")).collect()
    found = sorted((r.bin, r.n) for r in rows)
    run, total = np.cumsum([n for _, n in found]), sum(n for _, n in found)
    return [found[int(np.searchsorted(run, total * k / OVERLAP_FRAGMENTS))][0] + 1 for k in range(1, OVERLAP_FRAGMENTS)] if found else []


def links(pairs: DataFrame, alive: DataFrame, edges: list[int]) -> DataFrame:
    """The pairs whose overlap, counted in each fragment of the global order and summed, makes a link."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for node, blob, levels in zip(*(batch.column(c).to_pylist() for c in ("node", "hashes", "levels"))):
                h = np.frombuffer(blob, "<u8")
                which = np.searchsorted(edges, order_bin(np.frombuffer(levels, "u1"), h), "right")
                rows += [(node, k, np.sort(x).tobytes()) for k in range(OVERLAP_FRAGMENTS) if len(x := h[which == k])]
            cols = list(zip(*rows)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.binary()))], names=["node", "fragment", "hashes"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            each = [len(np.intersect1d(np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8"), assume_unique=True)) for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), batch.column("both"), pa.array(each, pa.int64())], names=["a", "b", "both", "common"])

    def cuts(side: str) -> DataFrame:
        own = alive.join(pairs.select(F.col(side).alias("node")).distinct(), "node", "left_semi")
        return own.select("node", "hashes", "levels").mapInArrow(cut, "node long, fragment int, hashes binary")

    left = cuts("a").select(F.col("node").alias("a"), "fragment", F.col("hashes").alias("x"))
    right = cuts("b").select(F.col("node").alias("b"), "fragment", F.col("hashes").alias("y"))
    # each node's own shingles first, then the centre's, which many pairs share
    partial = pairs.join(right, "b").join(left, ["a", "fragment"]).select("a", "b", "both", "x", "y").mapInArrow(count, "a long, b long, both long, common long")
    total = partial.groupBy("a", "b").agg(F.max("both").alias("both"), F.sum("common").alias("common"))
    # 100 * common >= 75 * (both - common)
    return total.filter((NUMERATOR + DENOMINATOR) * F.col("common") >= NUMERATOR * F.col("both")).select("a", "b")


def contract(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """labels(node, component) after joining the components of edges(u, v), which are components.

    Each component is hooked to its least neighbour, edges are renamed and halve at least; the loop ends
    when none is left.
    """
    edges = materialise(edges.filter("u <> v").distinct(), "edges")
    while not edges.isEmpty():
        ways = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        hook = materialise(ways.groupBy("u").agg(F.min("v").alias("to")).filter("to < u"), "hooks")
        new = labels.join(hook, labels.component == hook.u, "left").select("node", F.coalesce("to", "component").alias("component"))
        labels = replaced(labels, new, "labels")
        u = hook.select(F.col("u"), F.col("to").alias("u2"))
        v = hook.select(F.col("u").alias("v"), F.col("to").alias("v2"))
        moved = edges.join(u, "u", "left").join(v, "v", "left").select(F.coalesce("u2", "u").alias("u"), F.coalesce("v2", "v").alias("v"))
        edges = replaced(edges, moved.filter("u <> v").distinct(), "edges")
        discard(hook)
    discard(edges)
    return labels


def replaced(old: DataFrame, new: DataFrame, name: str) -> DataFrame:
    """new, written; what it was made from is deleted."""
    out = materialise(new, name)
    discard(old)
    return out


def found_in(docs: DataFrame) -> DataFrame:
    """What survivors() finds, written to the shared folder."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_parts = max(8, -(-size // (SHINGLE_BYTES * PART_SHINGLES)))
    postings = by_part(posting_rows(docs, n_parts), n_parts)
    out = materialise(survivors(by_part(shared_rows(postings, n_parts), n_parts)), "survivors")
    del postings
    release(docs.sparkSession)
    return out


def components(found: DataFrame) -> DataFrame:
    """node and component of the nodes that are left in the join."""
    alive = found.filter("size is not null")
    edges = fragment_edges(alive)
    labels = materialise(alive.select("node", F.col("node").alias("component")), "labels")
    postings, done, centres = prefix_postings(alive), 0, 0
    while True:
        if centres:
            still = materialise(open_postings(postings, labels, done), "postings")
            if done:
                discard(postings)
            postings = still
            if postings.isEmpty():
                discard(postings)
                return labels
            pairs = materialise(candidates(postings, done, centres), "pairs")
            done, centres = centres, centres * GROWTH
        else:
            pairs = materialise(seeds(postings), "pairs")
            centres = CENTRES
        if not pairs.isEmpty():
            a = labels.select(F.col("node").alias("a"), F.col("component").alias("u"))
            b = labels.select(F.col("node").alias("b"), F.col("component").alias("v"))
            labels = contract(links(pairs, alive, edges).join(a, "a").join(b, "b").select("u", "v"), labels)
        discard(pairs)
        release(found.sparkSession)


def labelled_rows(docs: DataFrame) -> DataFrame:
    """doc_id, node, n_shingles and, for rows with words, component and component_id of each row of docs."""
    spark: SparkSession = docs.sparkSession
    prepare(spark)
    found = found_in(docs)
    labels = components(found)
    known = found.filter("size is null").select("doc_id", "node", "n_shingles")
    first = known.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("least"))
    named = first.join(labels, "node", "left").select("node", "least", F.coalesce("component", "node").alias("component"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    return known.join(named.join(least, "component").select("node", "component", "component_id"), "node", "left")


def join(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of each row of docs(doc_id, text).

    component_id is the smallest doc_id that links reach. A text without words (or null) has no shingles
    and is its own component, as is a row with a null doc_id that links with nothing (null then). Rows
    that repeat a doc_id are compared by their texts. Other columns are not read.
    """
    return labelled_rows(docs).select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """docs with one row of each component: that with the smallest doc_id; rows without words all stay.

    Rows of a component that share the smallest doc_id are one row in the result. Null doc_ids come last.
    All columns of docs stay, whatever their names.
    """
    prepare(docs.sparkSession)
    rows = labelled_rows(docs).filter("node is not null")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node")
    best = rows.groupBy("component").agg(F.min(order).alias("best")).select(F.col("best.doc_id").alias("_id"), F.col("best.node").alias("_node"))
    names = docs.columns
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            each = [normal_words(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("id"), pa.array([node_of(w) if w else None for w in each], pa.int64())], names=["row", "id", "node"])

    with_node = held.mapInArrow(work, StructType([held.schema["row"], held.schema["id"], StructField("node", LongType())]))
    kept = with_node.filter("node is not null").join(best, F.col("id").eqNullSafe(F.col("_id")) & (F.col("node") == F.col("_node")), "left_semi").dropDuplicates(["id", "node"])
    return kept.unionByName(with_node.filter("node is null")).select("row.*")
