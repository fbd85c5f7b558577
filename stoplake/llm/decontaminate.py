"""Benchmark decontamination by template canonicalisation (operator 9).

Words lose punctuation and case; numbers, names and units become typed placeholders. Windows of the
resulting templates are hash-joined between documents and benchmark items, as are windows of the plain
words. A template match counts if its slots are consistent: equal values of the item stand where the
document has equal values, and different ones where it has different ones; this is asked of each
occurrence by itself, so a document may hold several versions of a question. A capital at the start of
a sentence may be a name or not: both forms are looked up. Windows with a single plain word only say where
an item may stand; it is then compared there word by word, and two plain words must agree. So a question with other
numbers or names is caught, and a text that only has the same frame by chance is not. A document is
contaminated by an item if matching windows cover at least COVER_PER_100 of a hundred of its words.

The benchmark is joined in blocks of at most BLOCK_WINDOWS windows, which bounds what is broadcast; each
block is one pass over the documents without a shuffle, so hot passages and hosts do not matter.
"""

from __future__ import annotations

import re
import string
from bisect import bisect_left, bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stoplake.llm.common import WORD_BATCH_BYTES, prepare

WINDOW, COVER_PER_100, BLOCK_WINDOWS = 8, 50, 2_000_000
#: Share of an item's slots that must be consistent, and of plain words by which a template window counts by itself.
CONSISTENT_PER_100, PLAIN_PER_100 = 75, 50
#: Unit words after a number.
UNITS = frozenset(
    "mm cm m km mile miles inch inches foot feet yard yards mg g kg gram grams ounce ounces pound pounds lb lbs ton tons ml l litre litres liter liters "
    "gallon gallons second seconds minute minutes hour hours day days week weeks month months year years dollar dollars cent cents euro euros usd eur gbp "
    "percent % $ € £ mph kmh degree degrees watt watts kw volt volts".split()
)
NUMBER = re.compile(r"[+-]?[$€£]?\d[\d.,:/]*(?:st|nd|rd|th|%|[$€£])?")
#: Plain words that a comparison word by word must have (one where an item of a window or more has no other).
LEAST_PLAIN = 2
#: Never names, though sentences begin with them; so are words that the benchmark has in lower case.
NO_NAMES = frozenset(
    "a about after all also an and any are as at be because before but by can did do does each every few find for from give given had has have he her here his how "
    "i if in is it its let many most much my no not of on one or our she so some such than that the their then there these they this those to two was we were what "
    "when where which while who whom whose why will with would you your".split()
)
EDGES = string.punctuation + "«»“”‘’„…¿¡—–\ue000"
NUM, NAME, UNIT = (np.uint64(x) for x in (0x1F3A5B7C9D1E2F31, 0x2F3A5B7C9D1E2F33, 0x3F3A5B7C9D1E2F35))
#: A word that stands for a line break; kinds of words that are nothing but punctuation, or empty.
BREAK, NOTHING, EMPTY = "\ue000", 4, 5
#: Kinds of windows: plain words, a template that counts by itself, and one that only says where to compare.
EXACT, FRAME, SEED = range(3)
MIX = np.uint64(0x9E3779B97F4A7C15)


class Canon:
    """Per worker: what each raw word is; emptied when large."""

    def __init__(self, no_names: frozenset[str] = NO_NAMES) -> None:
        self.at: dict[str, int] = {}
        self.no_names = no_names
        self.clear()

    def clear(self) -> None:
        self.at.clear()
        self.plain = np.zeros(1024, np.uint64)  # hash of the word in lower case
        self.kind = np.zeros(1024, np.int8)  # 0 word, 1 number, 2 capitalised, 3 unit, NOTHING, EMPTY
        self.ends = np.zeros(1024, bool)  # a sentence ends with it
        self.open = np.zeros(1024, bool)  # a name, if it is one at the start of a sentence

    def add(self, word: str) -> int:
        import xxhash

        k = len(self.at)
        if k == len(self.plain):
            self.plain, self.kind, self.ends, self.open = (np.concatenate([x, np.zeros_like(x)]) for x in (self.plain, self.kind, self.ends, self.open))
        bare = word.strip(EDGES)
        low = bare.lower()
        kind = (EMPTY if not word else NOTHING) if not bare else 1 if NUMBER.fullmatch(bare) else 2 if bare[0].isupper() and not bare.isupper() else 3 if low in UNITS else 0
        self.plain[k] = xxhash.xxh3_64_intdigest(low)
        self.kind[k] = kind
        self.ends[k] = word == BREAK or word.rstrip("\"')”»")[-1:] in (".", "!", "?", ":")
        self.open[k] = kind == 2 and low not in self.no_names
        self.at[word] = k
        return k

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
        """Where the words of each text begin (with the end), and of all words, one text after the other: plain
        hashes, template hashes without and with names at the start of sentences, and whether a word is a slot in either.

        Texts are split and their distinct words are found in Arrow; only those are looked up one by one.
        """
        split = pc.utf8_split_whitespace(pc.replace_substring(pc.fill_null(texts, ""), "\n", f" {BREAK} "))
        coded = split.flatten().dictionary_encode()
        words = coded.dictionary.to_pylist()
        if len(self.at) > 400_000:
            self.clear()
        at = self.at
        place = np.array([at[w] if w in at else self.add(w) for w in words], np.int64)
        k = place[np.asarray(coded.indices)]
        starts = np.asarray(split.offsets, np.int64) - split.offsets[0].as_py()
        some = self.kind[k] != EMPTY  # empty words stand for white space at either end
        starts, k = np.concatenate([[0], np.cumsum(some)])[starts], k[some]
        kind = self.kind[k]
        first = np.ones(len(k) + 1, bool)
        first[1:] = self.ends[k]
        first[starts] = True
        live = kind < NOTHING
        edges = np.concatenate([[0], np.cumsum(live)])[starts]
        plain, kind, first, could = self.plain[k][live], kind[live], first[:-1][live], self.open[k][live]
        number = kind == 1
        name = (kind == 2) & ~first
        behind = np.zeros(len(kind) + 1, bool)
        behind[1:] = number
        behind[edges] = False
        unit = (kind == 3) & behind[:-1]
        template = np.where(number, NUM, np.where(name, NAME, np.where(unit, UNIT, plain)))
        slot = number | name | unit
        opening = first & could
        return edges, [plain, template, np.where(opening, NAME, template), slot, slot | opening]

    def words(self, text: str) -> list[np.ndarray]:
        """The columns of batch() for one text."""
        return self.batch(pa.array([text], pa.string()))[1]


def windows(h: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of width words; of the whole where there are fewer."""
    n = max(len(h) - width + 1, 1)
    out = np.full(n, np.uint64(min(len(h), width)))
    for k in range(min(len(h), width)):
        out = (out ^ h[k : k + n]) * MIX
        out ^= out >> np.uint64(29)
    return out


class Items:
    """Windows of some benchmark items, by hash: (item, position) of each."""

    def __init__(self, rows: list[tuple[int, str]]):
        lower = (w.strip(EDGES) for _, text in rows for w in (text or "").split())
        self.no_names = NO_NAMES.union(w.lower() for w in lower if w[:1].islower())
        canon = Canon(self.no_names)
        self.ids, self.words = [], []
        places: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        for item_id, text in rows:
            plain, template, wide, slot, wide_slot = canon.words(text or "")
            if not len(plain):
                continue
            k = len(self.ids)
            self.ids.append(item_id)
            self.words.append((plain, template, wide, slot, wide_slot))
            for p, x in enumerate(windows(plain, WINDOW).tolist()):
                places[x].append((k, p, EXACT))
            if not wide_slot.any():
                continue
            for p, (x, y) in enumerate(zip(windows(template, WINDOW).tolist(), windows(wide, WINDOW).tolist())):
                part, wide_part = slot[p : p + WINDOW], wide_slot[p : p + WINDOW]
                if slot.any() and 100 * int((~part).sum()) >= PLAIN_PER_100 * len(part):
                    places[x].append((k, p, FRAME))
                elif not part.all():
                    places[x].append((k, p, SEED))
                if x != y and not wide_part.all():
                    places[y].append((k, p, SEED))
        self.places = dict(places)
        self.hashes = np.array(sorted(self.places), np.uint64)
        self.short = sorted({len(w[0]) for w in self.words if len(w[0]) < WINDOW})
        # a bit for the place of each hash; most windows of documents end there
        self.mask = np.uint64((1 << max(16, min(24, 3 + len(self.hashes).bit_length()))) - 1)
        self.marked = np.zeros(int(self.mask) + 1, bool)
        self.marked[self.hashes & self.mask] = True

    def hits(self, x: np.ndarray) -> np.ndarray:
        """Whether each hash is one of the windows'."""
        out = self.marked[x & self.mask]
        k = np.flatnonzero(out)
        at = np.minimum(np.searchsorted(self.hashes, x[k]), len(self.hashes) - 1)
        out[k] = self.hashes[at] == x[k]
        return out

    def touched(self, edges: np.ndarray, forms: list[np.ndarray]) -> np.ndarray:
        """The texts of a batch that hold any window of any item; all others match nothing."""
        found = []
        ends = np.repeat(edges[1:], np.diff(edges))
        for width in (WINDOW, *self.short):
            for h in forms:
                if len(h) >= width:
                    at = np.flatnonzero(self.hits(windows(h, width)))
                    found.append(at[at + width <= ends[at]])
        found = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
        return np.unique(np.searchsorted(edges, found, "right") - 1)

    def match(self, plain: np.ndarray, template: np.ndarray, wide: np.ndarray) -> list[tuple[int, int, int]]:
        """item_id, words covered in a hundred, and slots that are consistent in a hundred."""
        hits: dict[int, list[tuple[int, int, int, bool]]] = defaultdict(list)
        seeds: dict[int, set[int]] = defaultdict(set)
        for width in (WINDOW, *self.short):
            if len(plain) < width:
                continue
            usual = None
            for form, h in enumerate((plain, template, wide)):
                x = windows(h, width)
                same = self.hits(x)
                if form == 1:
                    usual = x
                elif form == 2:
                    same &= x != usual
                for d in np.flatnonzero(same).tolist():
                    for k, p, kind in self.places[int(x[d])]:
                        if (kind == EXACT) == (form == 0) and min(len(self.words[k][0]), WINDOW) == width:
                            if kind == EXACT or kind == FRAME and form == 1:
                                hits[k].append((p, d, width, kind == EXACT))
                            seeds[k].add(d - p)
        out = []
        for k, starts in seeds.items():
            found = hits.get(k, [])
            words, _, _, slot, _ = self.words[k]
            sure = np.zeros(len(words), bool)
            for p, _, width, exact in found:
                if exact:
                    sure[p : p + width] = True
            # all places together, then each occurrence by itself; what is covered word by word counts in all
            best = (-1, 0)
            for part in (found, *occurrences(found, len(words))):
                good = consistency((int(words[p + j]), int(plain[d + j])) for p, d, width, _ in part for j in range(width) if slot[p + j])
                covered = sure.copy()
                if good >= CONSISTENT_PER_100:
                    for p, _, width, _ in part:
                        covered[p : p + width] = True
                best = max(best, (100 * int(covered.sum()) // len(words), good))
                if covered.all():
                    break
            if best[0] < 100:
                best = max(best, self.laid(k, starts, sure, plain, template, wide))
            out.append((self.ids[k], *best))
        return out

    def laid(self, k: int, starts: set[int], sure: np.ndarray, plain: np.ndarray, template: np.ndarray, wide: np.ndarray) -> tuple[int, int]:
        """Best cover and consistency of item k laid word by word on a document at each of starts, and about it."""
        words, usual, opened, _, slot = self.words[k]
        n, width, n_plain, best = len(words), min(len(words), WINDOW), int((~slot).sum()), (-1, 0)
        if not n_plain or n_plain < LEAST_PLAIN and n < WINDOW:
            return best
        at = {}
        for start in starts:
            a, b = max(0, -start), min(n, len(plain) - start)
            there = slice(a + start, b + start)
            same = (words[a:b] == plain[there]) | (usual[a:b] == template[there]) | (opened[a:b] == wide[there])
            run = np.concatenate([[0], np.cumsum(same)])
            covered = np.zeros(n, bool)
            for p in np.flatnonzero(run[width:] - run[:-width] == width).tolist():
                covered[a + p : a + p + width] = True
            at[start] = [(p, p + start, 1, False) for p in np.flatnonzero(covered).tolist()]
        found = [hit for part in at.values() for hit in part]
        for part in (found, *occurrences(found, n)):
            good = consistency((int(words[p]), int(plain[d])) for p, d, _, _ in part if slot[p])
            covered = np.zeros(n, bool)
            covered[[p for p, _, _, _ in part]] = True
            if good >= CONSISTENT_PER_100 and int((covered & ~slot).sum()) >= min(LEAST_PLAIN, n_plain):
                best = max(best, (100 * int((covered | sure).sum()) // n, good))
        return best


def consistency(slots: Iterator[tuple[int, int]]) -> int:
    """How many in a hundred pairs of an item's and a document's slot value agree; 100 without a pair."""
    pairs = Counter(slots)
    # each value of the item goes with its commonest partner, each partner with one value
    to, back = {}, {}
    for (a, b), _ in pairs.most_common():
        if a not in to and b not in back:
            to[a], back[b] = b, a
    total = sum(pairs.values())
    return 100 * sum(n for (a, b), n in pairs.items() if to.get(a) == b) // total if total else 100


def occurrences(found: list[tuple[int, int, int, bool]], n: int) -> Iterator[list[tuple[int, int, int, bool]]]:
    """Hits of an item of n words by where it would begin: at one place, and about one (words put in or left out)."""
    at: dict[int, list[tuple[int, int, int, bool]]] = defaultdict(list)
    for hit in found:
        at[hit[1] - hit[0]].append(hit)
    if len(at) < 2:
        return
    yield from at.values()
    # the place with most hits takes those near it, then the next one
    left, order = set(at), sorted(at)
    for middle in sorted(at, key=lambda x: (-len(at[x]), x)):
        if middle in left:
            near = [x for x in order[bisect_left(order, middle - n // 3) : bisect_right(order, middle + n // 3)] if x in left]
            left.difference_update(near)
            if 1 < len(near) < len(order):
                yield [hit for x in near for hit in at[x]]


def blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """Items in blocks of bounded size, by id; they pass through the driver one block at a time."""
    held, size = [], 0
    for r in benchmark.select("item_id", "text").orderBy("item_id", "text").toLocalIterator():
        n = 2 * len((r.text or "").split())
        if held and size + n > BLOCK_WINDOWS:
            yield held
            held, size = [], 0
        held.append((r.item_id, r.text))
        size += n
    if held:
        yield held


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, covered_per_100, consistent_per_100 and copy for each document and item that match.

    docs(doc_id, text) and benchmark(item_id, text). Null and empty texts match nothing, as does an empty
    benchmark. Rows that repeat give repeated matches; null ids stay null. copy is the text's hash, by which
    rows with a null or repeated doc_id can be told apart. Other columns are not read.
    """
    spark = docs.sparkSession
    prepare(spark, WORD_BATCH_BYTES)
    schema = "doc_id long, item_id long, covered_per_100 int, consistent_per_100 int, copy string"
    out = spark.createDataFrame([], schema)
    for rows in blocks(benchmark):
        items = Items(rows)
        if items.ids:
            out = out.unionByName(docs.select("doc_id", "text", F.md5("text").alias("copy")).mapInArrow(_matcher(spark.sparkContext.broadcast(items)), schema))
    return out


def _matcher(shared):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value
        canon = Canon(items.no_names)
        for batch in batches:
            rows = []
            edges, (plain, template, wide, _, _) = canon.batch(batch.column("text"))
            for k in items.touched(edges, [plain, template, wide]).tolist():
                a, b = edges[k], edges[k + 1]
                doc_id, copy = batch.column("doc_id")[k].as_py(), batch.column("copy")[k].as_py()
                rows += [(doc_id, *m, copy) for m in items.match(plain[a:b], template[a:b], wide[a:b]) if m[1] >= COVER_PER_100]
            cols = list(zip(*rows)) or [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["doc_id", "item_id", "covered_per_100", "consistent_per_100", "copy"])

    return work


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs whose text no benchmark item contaminates; all columns stay."""
    bad = contaminated(docs, benchmark).select(F.col("copy").alias("_copy")).distinct()
    return docs.join(bad, F.md5(docs["text"]) == bad["_copy"], "left_anti")
