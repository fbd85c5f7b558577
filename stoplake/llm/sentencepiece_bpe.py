"""SentencePiece encoding and decoding (operator 8).

A merge-type model is encoded exactly without running its merges over the text. For each position the
Aho-Corasick automaton of the vocabulary gives the pieces that begin there, longest first. A piece is
accepted if the pair it forms with the piece before is compatible: merging the characters of the two
anew gives just these two. Where no piece fits, the last one is taken back, and its end is marked in a
bit field, so that no position fails twice; shorter pieces are looked up where they are needed. A sequence of pairwise compatible pieces is what the merges
give, and there is one such sequence only.

Where no piece holds two neighbouring characters, no merge joins them. So a text falls apart before each
run of space marks that follows another character (the constructor checks that no piece has one inside),
and between letters and the marks that no piece holds beside a letter. The parts repeat, so each worker
keeps the encodings of the parts it met, in tables of bounded size that forget what was not met for long.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from stoplake.llm.common import prepare, texts_of

SPACE = "▁"
UNCLEAR = "\uffff"
#: Entries of a worker's pair table, which is emptied when it is full, and of each half of its word table.
TABLE_ENTRIES = 150_000
WORD_ENTRIES = 250_000
#: Longer parts (texts without spaces) are encoded anew each time, not kept.
KEPT_CHARS = 40


class Recent(dict):
    """Values of keys, made where they are not known. At most so many are young; then these become the old ones, and a key that is met again becomes young."""

    def __init__(self, make: Callable[[str], str], most: int):
        super().__init__()
        self.make, self.most = make, most
        self.old: dict[str, str] = {}

    def __missing__(self, key: str) -> str:
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
            if len(key) > KEPT_CHARS:
                return value
        if len(self) >= self.most:
            self.old = self.copy()
            self.clear()
        self[key] = value
        return value


class MergeModel:
    """The pieces of a merge-type (BPE) model with byte fallback and identity normalisation."""

    def __init__(self, path: str):
        import ahocorasick
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        kinds = type(proto.pieces[0])
        norm, trainer = proto.normalizer_spec, proto.trainer_spec
        if trainer.model_type != trainer.BPE or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix:
            raise ValueError("a BPE model with identity normalisation and a dummy prefix is expected")
        if any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in proto.pieces):
            raise ValueError("user-defined and unused pieces are not supported")
        self.pieces = [p.piece for p in proto.pieces]
        self.ids = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == kinds.NORMAL}
        self.scores = {p.piece: p.score for p in proto.pieces if p.type == kinds.NORMAL}
        self.byte_ids = {int(p.piece[1:-1], 16): i for i, p in enumerate(proto.pieces) if p.type == kinds.BYTE}
        self.bytes_of = {i: b for b, i in self.byte_ids.items()}
        self.unk = next(i for i, p in enumerate(proto.pieces) if p.type == kinds.UNKNOWN)
        self.end = next(i for i, p in enumerate(proto.pieces) if p.piece == "</s>")
        self.control = {i for i, p in enumerate(proto.pieces) if p.type == kinds.CONTROL}
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("pieces with a space mark after another character are not supported")
        inner = [p.lstrip(SPACE) for p in self.ids]
        mixed = {c for p in inner if any(map(str.isalpha, p)) for c in p if not c.isalpha()}
        marks = sorted({c for p in inner for c in p if c.isascii() and not c.isalpha() and c not in mixed} | {"\n"} - mixed)
        apart = re.escape("".join(marks))
        #: Parts that can be encoded by themselves: leading space marks, then letters and such, or else marks.
        self.part = re.compile(f"{SPACE}*[{apart}]+|{SPACE}*[^{SPACE}{apart}]+|{SPACE}+")
        self.order = {s: i for i, s in enumerate(sorted(set(self.scores.values()), reverse=True))}
        self.order = {p: self.order[s] for p, s in self.scores.items()}
        self.halves: dict[str, tuple[str, str]] = {}
        self.automaton = ahocorasick.Automaton()
        self.held = {p for p in self.ids if len(p) == 1 or self.merged(p, self.halves) == [p]}  # others never come out of the merges
        self.longest = max(map(len, self.held))
        self.decimal = {p: str(i) for p, i in self.ids.items()}
        for p in self.ids:
            if p in self.held:
                self.automaton.add_word(p, len(p))
        #: Pieces with a half that merges later than the whole: the border rule does not hold for them.
        self.irregular: set[str] = set()
        for p in sorted(self.halves, key=len):
            if any(h in self.irregular or self.order[h] > self.order[p] for h in self.halves[p] if len(h) > 1) or any(len(h) > 1 and h not in self.halves for h in self.halves[p]):
                self.irregular.add(p)
        self.automaton.make_automaton()
        self.pairs: dict[tuple[str, str], bool] = {}
        self.words = Recent(self.split_ids, WORD_ENTRIES // 4)
        self.runs = Recent(self.run_ids, WORD_ENTRIES)
        #: The text of each id; UNCLEAR, which no piece has, for ids whose text depends on others.
        self.shown = {str(i): self.pieces[i].replace(SPACE, " ") for i in self.ids.values()}
        self.shown |= {str(i): chr(b) if b < 128 else UNCLEAR for i, b in self.bytes_of.items()}
        self.shown |= {str(i): "" if i in self.control else UNCLEAR for i in range(len(self.pieces)) if str(i) not in self.shown}

    def merged(self, text: str, halves: dict | None = None) -> list[str]:
        """The merges themselves: the best-scored adjacent pair first, the leftmost of equals.

        halves: gets the two parts that the last merge joined, if one symbol is left.
        """
        symbols: list[str] = list(text)
        n = len(symbols)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        scores, heap = self.scores, []

        def offer(i: int, j: int) -> None:
            if i >= 0 and j >= 0 and (s := scores.get(both := symbols[i] + symbols[j])) is not None:
                heapq.heappush(heap, (-s, i, j, both))

        for i in range(n - 1):
            offer(i, i + 1)
        while heap:
            _, i, j, both = heapq.heappop(heap)
            if symbols[i] + symbols[j] != both or not symbols[i] or not symbols[j] or after[i] != j:
                continue
            if halves is not None and len(both) == n:
                halves[text] = (symbols[i], symbols[j])
            symbols[i], symbols[j] = both, ""
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            offer(before[i], i)
            offer(i, after[i])
        return [s for s in symbols if s]

    def compatible(self, a: str, b: str) -> bool:
        """Whether the merges of a + b give a and b; known pairs are kept."""
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) >= TABLE_ENTRIES:
                self.pairs.clear()
            odd = a in self.irregular or b in self.irregular
            known = self.pairs[a, b] = self.merged(a + b) == [a, b] if odd else self.holds(a, b)
        return known

    def holds(self, a: str, b: str) -> bool:
        """compatible() by re-merging at the border alone, from the last merge back to the first.

        limit is the order of the merge that took the left or right symbol at the border; a merge across
        the border that comes earlier would have won. Of equal merges the leftmost comes first.
        """
        order, halves = self.order, self.halves
        limit, right = len(order), False
        while True:
            across = order.get(a + b)
            if across is not None and (across < limit or across == limit and right):
                return False
            x, y = order.get(a, -1) if len(a) > 1 else -1, order.get(b, -1) if len(b) > 1 else -1
            if x < 0 and y < 0:
                return True
            if x > y:
                limit, right, a = x, False, halves[a][1]
            else:
                limit, right, b = y, True, halves[b][0]

    def split(self, text: str) -> list[str]:
        """The pieces of a text by backtracking; characters outside the vocabulary stand alone."""
        compatible = self.compatible
        fast, at = [], 0
        for last, length in self.automaton.iter_long(text):  # the longest matches often fit at once
            if last + 1 - length != at or fast and not compatible(fast[-1], text[at : last + 1]):
                break
            fast.append(text[at : last + 1])
            at = last + 1
        if at == len(text):
            return fast
        # on from there: what fitted so far is what comes first, as each was the longest
        n, held, out = len(text), self.held, fast
        failed = bytearray(n // 8 + 1)
        size = min(self.longest, n - at)  # of the next piece to try
        while at < n:
            while size > 0:
                to = at + size
                if not failed[to >> 3] >> (to & 7) & 1:
                    piece = text[at:to]
                    if piece in held and (not out or compatible(out[-1], piece)):
                        out.append(piece)
                        at, size = to, min(self.longest, n - to)
                        break
                size -= 1
            else:
                if not any(text[at:to] in held for to in range(at + 1, min(at + self.longest, n) + 1)):  # unknown: a boundary for the merges as well
                    out.append(text[at])
                    at, size = at + 1, min(self.longest, n - at - 1)
                    continue
                failed[at >> 3] |= 1 << (at & 7)
                size = len(out.pop())
                at -= size
                size -= 1
        return out

    def piece_ids(self, pieces: list[str]) -> list[int]:
        out: list[int] = []
        for p in pieces:
            i = self.ids.get(p)
            if i is not None:
                out.append(i)
            elif self.byte_ids:
                out.extend(self.byte_ids[b] for b in p.encode())
            else:
                out.append(self.unk)
        return out

    def encode(self, text: str, end: bool = True) -> list[int]:
        """The ids of a text, as the public library gives them."""
        out = list(map(int, " ".join(self.decimals(text)).split()))
        return [*out, self.end] if end else out

    def decimals(self, text: str) -> list[str]:
        """Ids in decimals, joined by a space for each part of the text."""
        words = text.split(" ") if text else []
        if "" in words or SPACE in text:  # runs of spaces can be one piece
            return list(map(self.words.__getitem__, self.part.findall(SPACE + text.replace(" ", SPACE))))
        return list(map(self.runs.__getitem__, words))

    def split_ids(self, part: str) -> str:
        pieces = self.split(part)
        try:
            return " ".join([self.decimal[p] for p in pieces])
        except KeyError:
            return " ".join(map(str, self.piece_ids(pieces)))

    def run_ids(self, run: str) -> str:
        """The ids of a space mark and the characters up to the next one."""
        parts = self.part.findall(SPACE + run)
        if len(parts) == 1:  # kept as a run, not twice
            return self.split_ids(parts[0])
        return " ".join(map(self.words.__getitem__, parts))

    def plain(self, ids: list[int]) -> str:
        """Pieces as text, without the rule for the first space; runs of bytes are read as UTF-8."""
        out: list[str] = []
        held = bytearray()
        for i in ids:
            b = self.bytes_of.get(i)
            if b is not None:
                held.append(b)
                continue
            if held:
                out.append(utf8(held))
                held = bytearray()
            if i == self.unk:
                out.append(" ⁇ ")
            elif i not in self.control:
                out.append(self.pieces[i].replace(SPACE, " "))
        if held:
            out.append(utf8(held))
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        """The text of ids: control ids vanish, the dummy prefix's space goes."""
        text = self.plain(ids)
        return text[1:] if text[:1] == " " and next((i for i in ids if i not in self.control), None) not in self.bytes_of else text

    def ids_and_text(self, text: str) -> tuple[str, str]:
        """The ids in decimals joined by a space, end id included, and the text decoded from them."""
        parts = self.decimals(text)
        parts.append(str(self.end))
        ids = " ".join(parts)
        each = ids.split(" ")
        back = "".join(map(self.shown.__getitem__, each))
        return ids, self.decode(list(map(int, each))) if UNCLEAR in back else back[back[:1] == " " :]

    def digest(self, text: str) -> tuple[int, str, str]:
        """n_tokens with the end id, sha256 of the ids, sha256 of the decoded text."""
        ids, back = self.ids_and_text(text)
        return ids.count(" ") + 1, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()


def utf8(held: bytes) -> str:
    """Each byte that no valid sequence takes becomes one replacement mark."""
    out, i, n = [], 0, len(held)
    while i < n:
        width = next((w for w in (1, 2, 3, 4) if i + w <= n and _valid(held[i : i + w])), 0)
        out.append(bytes(held[i : i + width]).decode() if width else "�")
        i += width or 1
    return "".join(out)


def _valid(raw: bytes) -> bool:
    try:
        return len(bytes(raw).decode()) == 1
    except UnicodeDecodeError:
        return False


_MODELS: dict[str, MergeModel] = {}


def model(path: str) -> MergeModel:
    """The model of a path, built once in each worker."""
    if path not in _MODELS:
        _MODELS[path] = MergeModel(path)
    return _MODELS[path]


def encode_documents(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """docs with piece_ids array<int> (end id included), decoded string and n_tokens long.

    Null and empty texts give the end id alone and an empty decoded text. All columns of docs stay, but
    those named piece_ids, decoded or n_tokens are replaced. Rows that repeat give repeated results.
    """
    prepare(docs.sparkSession)
    new = ["piece_ids", "decoded", "n_tokens"]
    docs = docs.select(*[f"`{c}`" for c in docs.columns if c not in new])
    schema = StructType([*docs.schema.fields, StructField("piece_ids", ArrayType(IntegerType())), StructField("decoded", StringType()), StructField("n_tokens", LongType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for batch in batches:
            found = [m.ids_and_text(t) for t in texts_of(batch, text)]
            ids = [np.fromstring(i, np.int32, sep=" ") for i, _ in found]
            sizes = np.array([len(i) for i in ids], np.int64)
            flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists, pa.array([t for _, t in found], pa.string()), pa.array(sizes)], names=[*batch.schema.names, *new])

    return docs.mapInArrow(work, schema)


def encode_digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row of docs; one pass, no shuffle.

    A null text counts as empty; a null doc_id stays null; repeated rows give repeated results.
    """
    prepare(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for batch in batches:
            n, ids, back = zip(*map(m.digest, texts_of(batch))) if batch.num_rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select("doc_id", "text").mapInArrow(work, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
