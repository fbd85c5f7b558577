"""Secret scans (operator 3).

Three shapes are looked for by pattern. Beside them, candidate strings of key-like characters are scanned
by a sliding window: for each character class (hexadecimal, lower-case, upper-case and all letters with
digits, base 64) the Shannon entropy of the window's character counts is kept up to date as one character
enters and one leaves; windows over the class's threshold make a span. Base spans and what an allow list
names are cut out of a candidate and the rest is scanned. One pass, no shuffle.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from stoplake.llm.common import prepare, texts_of

#: Fixed patterns, and the least length of the group named with them.
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # a run of 16 or more is what [0-9a-f]+ gives and the length rule keeps
LEAST_ASSIGN, LEAST_ACCESS = 12, 18
#: Order of kinds that begin at the same place.
KINDS = ("assign", "access", "hex", "entropy")

#: Candidates for the entropy scan; they must mix letters and digits.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
WINDOW = 20
#: Bits per character that a window must exceed: by class, its characters and the threshold. Of random windows of
#: the lower (a-z0-9), upper (A-Z2-7) and alnum classes under one in a hundred stays below.
CLASSES = (
    ("hex", frozenset("0123456789abcdefABCDEF"), 3.0),
    ("lower", frozenset("abcdefghijklmnopqrstuvwxyz0123456789"), 3.3),
    ("upper", frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"), 3.2),
    ("alnum", frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"), 3.6),
    ("base64", frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"), 3.9),
)
#: Windows of these classes must mix letters and digits themselves, or long words would be over the threshold.
MIXED = frozenset(("lower", "upper", "alnum"))
DIGITS = frozenset("0123456789")
#: What looks random and is not secret: UUIDs, published examples, hashes named as such, alphabets.
ALLOWED = re.compile(
    r"(?<![0-9a-z])[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}(?![0-9a-z])|wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY|[0-9a-z]*EXAMPLE[0-9a-z]*"
    + "".join(rf"|(?<![0-9a-z]){name}-(?:[0-9a-f]{{{n // 4}}}(?![0-9a-z])|[0-9a-z+/_-]{{1,{-(-n // 6)}}}={{0,2}})" for name, n in (("md5", 128), ("sha1", 160), ("sha256", 256), ("sha384", 384), ("sha512", 512)))
    + "|0123456789|abcdefghij"
    + "".join(f"(?:{c}" for c in "klmnopqrstuvwxyz")
    + ")?" * 16,
    re.IGNORECASE | re.ASCII,
)
#: x * log2(x) for counts in a window, and one more while a character enters before one leaves.
XLOGX = [0.0] + [k * math.log2(k) for k in range(1, WINDOW + 2)]


def hot_span(s: str, chars: frozenset[str], threshold: float, width: int = WINDOW, mixed: bool = False) -> tuple[int, int] | None:
    """From the first to the last window over the threshold in which all characters are of the class.

    With mixed, only windows with letters and digits count (for classes of nothing else).
    The entropy of a window of w characters with counts n is log2(w) - sum(n log2 n) / w; the sum changes
    by two terms when the window moves on.
    """
    counts: dict[str, int] = {}
    total, run, first, last, digits = 0.0, 0, -1, -1, 0
    top = math.log2(width)
    for i, c in enumerate(s):
        if c not in chars:
            counts, total, run, digits = {}, 0.0, 0, 0
            continue
        n = counts.get(c, 0)
        total += XLOGX[n + 1] - XLOGX[n]
        counts[c] = n + 1
        run += 1
        digits += c in DIGITS
        if run > width:
            gone = s[i - width]
            n = counts[gone]
            total += XLOGX[n - 1] - XLOGX[n]
            counts[gone] = n - 1
            digits -= gone in DIGITS
        if run >= width and top - total / width > threshold and (not mixed or 0 < digits < width):
            first, last = (i - width + 1 if first < 0 else first), i + 1
    return None if first < 0 else (first, last)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Spans of the three fixed shapes by start, then kind; start and end in code points."""
    found = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_ASSIGN]
    found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def entropy_spans(text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Spans of high entropy that touch no base span."""
    out, taken, k = [], [], 0
    for a, b, _ in base:
        if taken and a <= taken[-1][1]:
            taken[-1] = (taken[-1][0], max(b, taken[-1][1]))
        else:
            taken.append((a, b))
    for m in CANDIDATE.finditer(text):
        cuts = [(m.start() + x.start(), m.start() + x.end()) for x in ALLOWED.finditer(m[0])]
        while k < len(taken) and taken[k][1] <= m.start():
            k += 1
        j = k
        while j < len(taken) and taken[j][0] < m.end():
            cuts.append(taken[j])
            j += 1
        at = m.start()
        for a, b in [*sorted(cuts), (m.end(), m.end())]:
            s = text[at:a]
            if len(s) >= WINDOW and any(c.isdigit() for c in s) and any(c.isalpha() for c in s):
                spans = [x for name, chars, threshold in CLASSES if (x := hot_span(s, chars, threshold, mixed=name in MIXED))]
                if spans:
                    out.append((at + min(a for a, _ in spans), at + max(b for _, b in spans), "entropy"))
            at = max(at, b)
    return out


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def scan_text(text: str) -> tuple[int, int, int, str, str]:
    """n_assign, n_access, n_hex, the base spans' digest and all spans."""
    base = base_spans(text)
    kinds = [k for _, _, k in base]
    every = sorted(base + entropy_spans(text, base), key=lambda s: (s[0], KINDS.index(s[2])))
    return kinds.count("assign"), kinds.count("access"), kinds.count("hex"), hashlib.sha256(joined(base).encode()).hexdigest(), joined(every)


def scan(docs: DataFrame) -> DataFrame:
    """Spans of secrets in each row of docs(doc_id, text); one result row for each row.

    A null or empty text has no spans (the digest is that of the empty string). A null doc_id stays null.
    Other columns of docs are not read.
    """
    prepare(docs.sparkSession)
    names = ["n_assign", "n_access", "n_hex", "base_sha256", "spans"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = list(zip(*map(scan_text, texts_of(batch)))) or [()] * 5
            kinds = [pa.int64()] * 3 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *[pa.array(c, k) for c, k in zip(cols, kinds)]], names=["doc_id", *names])

    return docs.select("doc_id", "text").mapInArrow(work, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """docs with each span of its text replaced by mark; null texts stay null."""
    prepare(docs.sparkSession)

    def clean(text: str | None) -> str | None:
        if text is None:
            return None
        base = base_spans(text)
        out, at = [], 0
        for a, b, _ in sorted(base + entropy_spans(text, base)):
            if a >= at:
                out += [text[at:a], mark]
            at = max(at, b)
        return "".join([*out, text[at:]])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = batch.schema.get_field_index("text")
            yield batch.set_column(k, "text", pa.array(map(clean, batch.column(k).to_pylist()), pa.string()))

    return docs.mapInArrow(work, docs.schema)
