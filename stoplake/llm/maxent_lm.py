"""Language-model scoring with a hashed maximum-entropy model (operator 1).

The model gives each next token a probability in two steps: a class, then the token within its class, each
a softmax over hashed features of the context (previous token, previous two, the one before the previous).
The commonest tokens have places in classes. The next ones, up to HEAD, are dealt into bands by frequency, each
a class in which a token's probability follows its count; all others share one more such class (add-one
smoothed, one share for what was never seen), so that the whole is a proper distribution over an open
vocabulary.

1. Counts. Each task counts tokens and sends one entry for each distinct token, packed by hash range; the
   counts of the whole training corpus stay distributed.
2. Training. Each task makes gradient steps over its documents; the changes are averaged slice by slice
   in two levels. What comes to the driver are weights of fixed size.
3. Scoring. Common tokens (at most HEAD, the largest counts) are looked up in
   a broadcast table. The others are sent to the counts of their hash range; none of them has more than a share of 1 / HEAD of all tokens, so
   no range is hot. Sums by document come back.

Tokens are told apart by 64-bit hashes; about one in 3e6 corpora of 5e6 distinct tokens has a clash.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stoplake.llm.common import WORD_BATCH_BYTES, materialise, no_collector, prepare, split_words, texts_of
from stoplake.llm.jaccard_join import by_part, packed, parts_of, unpacked

#: Tokens that are looked up in a broadcast table, at most.
HEAD = 131_072
#: Classes with places for single tokens, places in each, bands of further tokens, and rows of hashed weights.
PLACED, PLACES, BANDS, CLASS_ROWS, TOKEN_ROWS = 32, 32, 15, 1 << 14, 1 << 15
#: Class 0 is for all other tokens, then come the placed ones and the bands.
CLASSES = 1 + PLACED + BANDS
#: Tokens of a gradient step, learning rate, and slices in which weights are averaged.
STEP_TOKENS, RATE, SLICES, LEVELS = 16_384, 0.1, 32, 32
#: Tokens that a training task has at least, if there are that many: each task sends all weights once.
TASK_TOKENS = 2_000_000
#: Distinct tokens that a task holds before it sends their counts, and rare tokens before it sends them to be looked up.
HELD_TOKENS, HELD_RARE = 400_000, 500_000
#: Bytes of text for each hash range, about.
RANGE_BYTES = 128 << 20
#: Hash of the end token, which no word has as its own: words are hashed into even numbers.
END = np.uint64(1)
START = np.uint64(3)
MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xFF51AFD7ED558CCD], np.uint64)


def held_out() -> F.Column:
    """Documents that are not learned from: crc32 of the id as text leaves 2 modulo 7."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False))


def range_of(h: np.ndarray, n_parts: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(n_parts) >> np.uint64(32)).astype(np.int32)


def count_tokens(docs: DataFrame, n_parts: int) -> DataFrame:
    """Packed (hash, count in training, count in all) by hash range; docs: held_out, text."""
    import xxhash

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[int]] = {}  # counts in training and elsewhere
        ends = [0, 0]

        def send() -> Iterator[pa.RecordBatch]:
            h = np.array([xxhash.xxh3_64_intdigest(w) for w in held] + [0], np.uint64) << np.uint64(1)
            h[-1] = END
            train, other = np.array([*held.values(), ends], np.int64).T
            yield from packed(range_of(h, n_parts), h, train, train + other)

        for batch in batches:
            with no_collector():
                words, at, starts = split_words(batch.column("text"))
                out = np.asarray(batch.column("held_out")).astype(bool)
                apart = np.repeat(out, np.diff(starts))
                counts = np.bincount(2 * at + apart, minlength=2 * len(words)).reshape(-1, 2)
                for word, (a, b) in zip(words, counts.tolist()):
                    if a or b:
                        if word in held:
                            pair = held[word]
                            pair[0] += a
                            pair[1] += b
                        else:
                            held[word] = [a, b]
                ends = [ends[0] + int((~out).sum()), ends[1] + int(out.sum())]
            if len(held) > HELD_TOKENS:
                yield from send()
                held.clear()
                ends = [0, 0]
        if sum(ends):
            yield from send()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for blobs in parts_of(batches):
            h, train, every = unpacked(blobs, "<u8", "<i8", "<i8")
            h, inverse = np.unique(h, return_inverse=True)
            sums = [np.bincount(inverse, x, len(h)).astype(np.int64) for x in (train, every)]
            yield from packed(range_of(h, n_parts), h, *sums)

    sent = docs.mapInArrow(work, "part int, payload binary")
    return by_part(sent, n_parts).mapInArrow(add, "part int, payload binary")


def totals(counts: DataFrame) -> tuple[int, int, int]:
    """Tokens in training, distinct tokens in training, and the count that HEAD tokens at most reach."""
    bins = 8 * 64

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, v, by_size = 0, 0, np.zeros(bins, np.int64)
        for batch in batches:
            for blob in batch.column("payload").to_pylist():
                _, train, every = unpacked([blob], "<u8", "<i8", "<i8")
                n, v = n + int(train.sum()), v + int((train > 0).sum())
                by_size += np.bincount((8 * np.log2(every)).astype(int), minlength=bins)
        k = np.flatnonzero(by_size)
        yield pa.RecordBatch.from_arrays([pa.array([-2, -1, *k], pa.int32()), pa.array([n, v, *by_size[k]], pa.int64())], names=["size", "n"])

    found = {r[0]: r[1] for r in counts.mapInArrow(work, "size int, n long").groupBy("size").agg(F.sum("n")).collect()}
    n, v = found.pop(-2, 0), found.pop(-1, 0)
    within, least = 0, bins
    for k in sorted(found, reverse=True):
        within += found[k]
        if within > HEAD:
            break
        least = k
    return n, v, max(2, int(np.ceil(2 ** (least / 8)))) if least < bins else 2


def common_tokens(counts: DataFrame, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (ascending) and training counts of the tokens with this count in all or more."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column("payload").to_pylist():
                h, train, every = unpacked([blob], "<u8", "<i8", "<i8")
                k = every >= least
                if k.any():
                    yield pa.RecordBatch.from_arrays([pa.array([h[k].tobytes()]), pa.array([train[k].tobytes()])], names=["h", "c"])

    rows = counts.mapInArrow(work, "h binary, c binary").collect()
    h = np.frombuffer(b"".join(bytes(r[0]) for r in rows), "<u8")
    order = np.argsort(h)
    return h[order], np.frombuffer(b"".join(bytes(r[1]) for r in rows), "<i8")[order]


class Places:
    """Where each of distinct hashes stands in their array, by the low bits; hashes that share them are searched."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = hashes
        self.mask = np.uint64((1 << max(8, 3 + len(hashes).bit_length())) - 1)
        self.table = np.zeros(int(self.mask) + 1, np.int32)
        self.table[hashes & self.mask] = np.arange(len(hashes), dtype=np.int32)
        lost = np.flatnonzero(self.table[hashes & self.mask] != np.arange(len(hashes)))
        self.lost = lost[np.argsort(hashes[lost])]

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The place of each of h (any place if it is none), and whether it is one."""
        if not len(self.hashes):
            return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
        at = self.table[h & self.mask].astype(np.int64)
        hit = self.hashes[at] == h
        if len(self.lost):
            miss = np.flatnonzero(~hit)
            near = self.lost[np.minimum(np.searchsorted(self.hashes[self.lost], h[miss]), len(self.lost) - 1)]
            found = self.hashes[near] == h[miss]
            at[miss[found]], hit[miss[found]] = near[found], True
        return at, hit


class Model:
    """Weights, and the classes of the common tokens; of fixed size."""

    def __init__(self, head: np.ndarray, counts: np.ndarray, n: int, v: int):
        best = np.lexsort((head, -counts))
        best = best[counts[best] > 0]
        c = counts[best]
        self.places = Places(head)
        #: By place in head: class (0: the others, and what training has not seen), place in it, log10 of the share in a band.
        self.cls, self.place, self.share = np.zeros(len(head), np.int64), np.zeros(len(head), np.int64), np.zeros(len(head))
        rank = np.arange(len(best))
        single = rank < PLACED * PLACES
        run = np.cumsum(np.where(single, 0, c + 1))
        band = np.minimum(run * BANDS // max(int(run[-1]) + 1, 1), BANDS - 1) if len(best) else rank
        cls = np.where(single, 1 + rank // PLACES, 1 + PLACED + band)
        whole = np.bincount(cls, c + 1.0, CLASSES)
        self.cls[best], self.place[best] = cls, np.where(single, rank % PLACES, 0)
        self.share[best] = np.where(single, 0.0, np.log10((c + 1.0) / whole[cls]))
        by_class = np.bincount(cls, c, CLASSES)
        #: The other tokens: log10 of what their smoothed counts add up to, with one share for the unseen.
        self.log_rest = float(np.log10(n - int(c.sum()) + v - len(c) + 1))
        by_class[0] = max(n - int(c.sum()), 1)
        bias = np.where(by_class > 0, np.log(by_class + 0.5), -np.inf)
        self.class_bias = (bias - bias.max()).astype(np.float32)
        token_bias = np.full((CLASSES, PLACES), -np.inf)
        token_bias[cls[single], (rank % PLACES)[single]] = np.log(c[single] + 0.5)
        top = token_bias.max(axis=1, keepdims=True)
        self.token_bias = (token_bias - np.where(np.isfinite(top), top, 0)).astype(np.float32)
        self.weights = np.zeros(CLASS_ROWS * CLASSES + TOKEN_ROWS * PLACES, np.float32)

    def split(self, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        k = CLASS_ROWS * CLASSES
        return flat[:k].reshape(CLASS_ROWS, CLASSES), flat[k:].reshape(TOKEN_ROWS, PLACES)

    def targets(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Class and place of each token (class 0: the others)."""
        return self.targets_at(*self.places.find(h))

    def targets_at(self, at: np.ndarray, hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.cls):
            return np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        return np.where(hit, self.cls[at], 0), np.where(hit, self.place[at], 0)

    def forward(self, f: np.ndarray, cls: np.ndarray, place: np.ndarray):
        """Natural log probabilities of class and place (of tokens with a place: inner); what a gradient needs comes with them."""
        wc, wt = self.split(self.weights)
        rows = (f % np.uint64(CLASS_ROWS)).astype(np.int64)
        x = wc.take(rows[:, 0], 0)
        x += wc.take(rows[:, 1], 0)
        x += wc.take(rows[:, 2], 0)
        x += self.class_bias
        pc, lc = softmax(x, cls)
        inner = np.flatnonzero((cls > 0) & (cls <= PLACED))
        mixed = (f[inner] >> np.uint64(20)) ^ (cls[inner].astype(np.uint64) * MIX[3])[:, None]
        trows = ((mixed * MIX[0]) >> np.uint64(40)).astype(np.int64) % TOKEN_ROWS
        x = wt.take(trows[:, 0], 0)
        x += wt.take(trows[:, 1], 0)
        x += wt.take(trows[:, 2], 0)
        x += self.token_bias.take(cls[inner], 0)
        pt, lt = softmax(x, place[inner])
        return rows, pc, lc, inner, trows, pt, lt


def softmax(x: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities in place of x, and the logarithm of the target's; biases are 0 at most, so exp() stays finite."""
    np.minimum(x, 60, out=x)
    at = x[np.arange(len(x)), target]
    np.exp(x, out=x)
    s = np.maximum(np.einsum("ij->i", x), np.float32(1e-30))
    x *= (1 / s)[:, None]
    return x, at - np.log(s)


def features(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Hashes of each token's context; first: tokens that begin a text."""
    one = np.roll(h, 1)
    one[first] = START
    two = np.roll(one, 1)
    two[first] = START
    f = np.stack([one * MIX[0], (one * MIX[1]) ^ (two * MIX[2]), two * MIX[3]], axis=1)
    f ^= f >> np.uint64(31)
    f *= MIX[1]
    return f ^ (f >> np.uint64(33))


def batch_tokens(texts: pa.Array, known: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all texts, each with the end token, and where each text begins (with the end); known is emptied when large."""
    import xxhash

    words, at, starts = split_words(texts)
    if len(known) > 500_000:
        known.clear()
    for w in words:
        if w not in known:
            known[w] = xxhash.xxh3_64_intdigest(w)
    h = np.array([known[w] for w in words], np.uint64) << np.uint64(1)
    return np.insert(h[at], starts[1:], END), starts + np.arange(len(starts))


def train(docs: DataFrame, model: Model) -> np.ndarray:
    """The weights after one pass: each task makes gradient steps, and their results are averaged."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    size = len(model.weights)
    edges = [size * k // SLICES for k in range(SLICES + 1)]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, known = shared.value, {}
        m.weights = np.zeros(size, np.float32)
        power = np.full(size, 1.0, np.float32)
        seen = 0
        for batch in batches:
            h, starts = batch_tokens(batch.column("text"), known)
            f = features(h, starts[:-1])
            cls, place = m.targets(h)
            for a in range(0, len(h), STEP_TOKENS):
                s = slice(a, a + STEP_TOKENS)
                step(m, power, f[s], cls[s], place[s])
            seen += len(h)
        if seen:
            task = TaskContext.get().partitionId()
            for k in range(SLICES):
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([task % LEVELS], pa.int32()), pa.array([(m.weights[edges[k] : edges[k + 1]] * np.float32(seen)).tobytes()], pa.binary()), pa.array([seen], pa.int64())], names=["slice", "level", "sum", "n"])
        m.weights = None

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        ns: Counter = Counter()
        for batch in batches:
            for k, blob, n in zip(batch.column("slice").to_pylist(), batch.column("sum").to_pylist(), batch.column("n").to_pylist()):
                x = np.frombuffer(blob, "<f4")
                sums[k] = sums[k] + x if k in sums else x.astype(np.float64)
                ns[k] += n
        for k, x in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([0], pa.int32()), pa.array([x.astype("<f4").tobytes()], pa.binary()), pa.array([ns[k]], pa.int64())], names=["slice", "level", "sum", "n"])

    schema = "slice int, level int, sum binary, n long"
    once = docs.mapInArrow(work, schema).repartition(SLICES, "slice", "level").mapInArrow(add, schema)
    rows = once.repartition(SLICES, "slice").mapInArrow(add, schema).collect()
    out = np.zeros(size, np.float32)
    for r in rows:
        out[edges[r.slice] : edges[r.slice + 1]] = np.frombuffer(bytes(r.sum), "<f4") / r.n
    return out


def step(m: Model, power: np.ndarray, f: np.ndarray, cls: np.ndarray, place: np.ndarray) -> None:
    """One gradient step with rates that fall with a weight's past gradients; only rows that occur are touched."""
    rows, pc, _, inner, trows, pt, _ = m.forward(f, cls, place)
    pc[np.arange(len(pc)), cls] -= 1
    pt[np.arange(len(pt)), place[inner]] -= 1
    for w, past, r, p in zip(m.split(m.weights), m.split(power), (rows, trows), (pc, pt)):
        if not len(p):
            continue
        # sums by row, column by column: only over rows that occur
        flat = r.T.reshape(-1)
        occurs = np.zeros(len(w), bool)
        occurs[flat] = True
        at = np.flatnonzero(occurs)
        flat = (np.cumsum(occurs) - 1)[flat]
        sums = np.empty((p.shape[1], len(at)), np.float32)
        for k, column in enumerate(np.ascontiguousarray(p.T, np.float64)):
            sums[k] = np.bincount(flat, np.tile(column, 3), len(at))
        g = np.ascontiguousarray(sums.T)
        so_far = past.take(at, 0)
        so_far += g * g
        past[at] = so_far
        np.sqrt(so_far, out=so_far)
        g /= so_far
        g *= np.float32(RATE)
        w[at] -= g


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each row of docs(doc_id, text).

    A null text counts as empty: its one token is the end. A null doc_id counts as not held out. Rows that
    are alike in both get equal results. Other columns are not read. An empty table gives no rows.
    """
    spark = docs.sparkSession
    prepare(spark, WORD_BATCH_BYTES)
    docs = docs.select("doc_id", "text", held_out().alias("held_out"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_parts = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // RANGE_BYTES))
    counts = materialise(count_tokens(docs.select("held_out", "text"), n_parts), "token-counts")
    n, v, least = totals(counts)
    head, head_counts = common_tokens(counts, least)
    model = Model(head, head_counts, n, v)
    model.weights = train(docs.filter(~F.col("held_out")).select("text").coalesce(max(8, n // TASK_TOKENS)), model)
    whole = float(np.log10(n + v + 1.0))  # taken off token by token: the sums stay small
    shared = spark.sparkContext.broadcast((model, head_counts))
    schema = "kind int, part int, payload binary, key long, doc_id long, held_out boolean, n_tokens long, known long, logs double, model double"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        (m, head_counts), known = shared.value, {}
        head_logs = np.append(np.log10(head_counts + 1.0) - whole, 0.0)
        seen_in_training = np.append(head_counts > 0, False)
        share = np.append(m.share, 0.0)
        rare: list[tuple[np.ndarray, np.ndarray]] = []
        held = 0
        for batch in batches:
            texts = texts_of(batch)
            h, starts = batch_tokens(batch.column("text"), known)
            doc = np.repeat(np.arange(len(texts)), np.diff(starts))
            keys = np.array([xxhash.xxh3_64_intdigest(f"{d} {t}") for d, t in zip(batch.column("doc_id").to_pylist(), texts)], np.uint64).view(np.int64)
            at, hit = m.places.find(h)
            cls, place = m.targets_at(at, hit)
            at[~hit] = len(head_counts)
            logs = head_logs[at]
            f = features(h, starts[:-1])
            parts = np.empty(len(h))
            for a in range(0, len(h), STEP_TOKENS):
                s = slice(a, a + STEP_TOKENS)
                _, _, lc, inner, _, _, lt = m.forward(f[s], cls[s], place[s])
                lc = lc.astype(np.float64)
                lc[inner] += lt
                parts[s] = lc / np.log(10)
            # other tokens: log10(c + 1) - log_rest; the sum of all logs holds those of the head too
            parts += share[at] - np.where(cls == 0, m.log_rest - whole, logs)
            sums = [np.bincount(doc, x, len(texts)) for x in (seen_in_training[at], logs, parts)]
            rows = len(texts)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.zeros(rows, np.int32)), pa.nulls(rows, pa.int32()), pa.nulls(rows, pa.binary()), pa.array(keys), batch.column("doc_id").cast(pa.int64()), batch.column("held_out"), pa.array(np.diff(starts)), pa.array(sums[0].astype(np.int64)), pa.array(sums[1]), pa.array(sums[2])],
                names=["kind", "part", "payload", "key", "doc_id", "held_out", "n_tokens", "known", "logs", "model"],
            )
            rare.append((h[~hit], keys[doc[~hit]]))
            held += len(rare[-1][0])
            if held >= HELD_RARE:
                yield from to_ranges(rare)
                rare, held = [], 0
        if held:
            yield from to_ranges(rare)

    def to_ranges(rare: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        """Rare tokens and the keys of their texts, packed by hash range."""
        h, key = (np.concatenate(x) for x in zip(*rare))
        for out in packed(range_of(h, n_parts), h, key):
            k = out.num_rows
            empty = [pa.nulls(k, t) for t in (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64())]
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(k, np.int32)), *out.columns, *empty], names=["kind", "part", "payload", "key", "doc_id", "held_out", "n_tokens", "known", "logs", "model"])

    both = materialise(docs.mapInArrow(work, schema), "scored")

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by range, its counts first; sums by text are packed once for each range."""
        now, h0, c0, sums = None, None, None, None
        for batch in batches:
            for part, kind, blob in zip(*(batch.column(c).to_pylist() for c in ("part", "kind", "payload"))):
                if part != now:
                    if sums:
                        yield from sent(sums)
                    now, h0, c0, sums = part, np.zeros(0, np.uint64), np.zeros(0, np.int64), []
                if kind == 0:
                    h0, c0, _ = unpacked([blob], "<u8", "<i8", "<i8")
                    continue
                h, key = unpacked([blob], "<u8", "<i8")
                c = np.zeros(len(h), np.int64)
                if len(h0):
                    at = np.minimum(np.searchsorted(h0, h), len(h0) - 1)
                    c = np.where(h0[at] == h, c0[at], 0)
                sums.append(summed(key, (c > 0).astype(np.int64), np.log10(c + 1.0) - whole))
                if len(sums) > 64:
                    sums = [summed(*(np.concatenate(x) for x in zip(*sums)))]
        if sums:
            yield from sent(sums)

    def summed(key: np.ndarray, known: np.ndarray, logs: np.ndarray) -> tuple[np.ndarray, ...]:
        """Sums by key."""
        keys, inverse = np.unique(key, return_inverse=True)
        return keys, np.bincount(inverse, known, len(keys)).astype(np.int64), np.bincount(inverse, logs, len(keys))

    def sent(sums: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        keys, *rest = summed(*(np.concatenate(x) for x in zip(*sums)))
        yield from packed((keys.view(np.uint64) % np.uint64(n_parts)).astype(np.int32), keys, *rest)

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for blobs in parts_of(batches):
            key, known, logs = unpacked(blobs, "<i8", "<i8", "<f8")
            keys, inverse = np.unique(key, return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.bincount(inverse, known, len(keys)).astype(np.int64)), pa.array(np.bincount(inverse, logs, len(keys)))], names=["key", "known2", "logs2"])

    tables = counts.select("part", F.lit(0).alias("kind"), "payload").unionByName(both.filter("kind = 1").select("part", "kind", "payload"))
    dealt = tables.repartition(n_parts, "part").sortWithinPartitions("part", "kind")
    partial = dealt.mapInArrow(look_up, "part int, payload binary")
    found = by_part(partial, n_parts).mapInArrow(add_up, "key long, known2 long, logs2 double")
    rows = both.filter("kind = 0").drop("kind", "part", "payload")
    # rows that are alike share a key: each gets its part of the sums
    alike = rows.groupBy("key").agg(F.count(F.lit(1)).alias("alike"))
    out = rows.join(alike, "key").join(found, "key", "left")
    logs = F.col("logs") + F.coalesce(F.col("logs2") / F.col("alike"), F.lit(0.0))
    known = F.col("known") + F.coalesce((F.col("known2") / F.col("alike")).cast("long"), F.lit(0))
    return out.select("doc_id", "held_out", "n_tokens", known.alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), logs.alias("base_score"), (F.col("model") + logs).alias("score"))
