"""Language identification by compression (operator 6).

Each language has a zstandard raw-content dictionary of labelled texts. A text is cut into blocks, every
block is compressed with every dictionary, and the language with the smallest sum wins; a narrow margin
is reported as rejected. Any number of languages is learned: a dictionary is bounded by DICTIONARY_BYTES, and
what all have together by TOTAL_BYTES, so that more languages get shorter dictionaries.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stoplake.llm.common import prepare

#: Bounds of the sample that is learned from: texts of each language, bytes of a dictionary and of all, and characters of a piece of a text.
SAMPLE_TEXTS, DICTIONARY_BYTES, TOTAL_BYTES, PIECE_CHARS = 400, 96 << 10, 64 << 20, 200
#: Labels whose counts are broadcast, at most.
BROADCAST_LANGUAGES = 100_000
#: Bytes of a block, compression level, and the relative margin under which a verdict is rejected.
BLOCK_BYTES, LEVEL, MARGIN = 8 << 10, 3, 0.01
UNDETERMINED = "und"


def held_out() -> F.Column:
    """Documents that are never learned from: crc32 of the id as text leaves 1 modulo 3."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def learn(docs: DataFrame) -> dict[str, bytes]:
    """Dictionary content by language, from texts with a lang that are not held out.

    The texts of a language are those with the smallest hashes. Counts by language first give the share
    of hashes to look at, so that only about twice the sample is ever sorted. Pieces are taken from all over
    the texts by their hashes, until a dictionary is full; only those come to the driver.
    """
    known = docs.filter(F.col("text").isNotNull() & F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).select("doc_id", "text", "lang")
    counts = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    n_langs = counts.count()
    if not n_langs:
        return {}
    span = float(1 << 32)
    most = min(DICTIONARY_BYTES, TOTAL_BYTES // n_langs)
    place = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 32))
    # labels are joined, not listed: there may be many
    # a row for each label: small, unless labels are counted in hundreds of thousands; then texts are shuffled by label
    few = known.join(F.broadcast(counts) if n_langs <= BROADCAST_LANGUAGES else counts, "lang").withColumn("place", place).filter(F.col("place") < F.lit(1 + 2 * SAMPLE_TEXTS * span) / F.col("n"))
    first = Window.partitionBy("lang").orderBy("place", "doc_id", "text")
    sample = few.withColumn("k", F.row_number().over(first)).filter(F.col("k") <= SAMPLE_TEXTS).select("lang", "k", F.lower("text").alias("text"))
    starts = F.sequence(F.lit(0), F.greatest(F.ceil(F.length("text") / PIECE_CHARS) - 1, F.lit(0)))
    pieces = sample.select("lang", "k", "text", F.explode(starts).alias("i")).select("lang", "k", "i", F.substr("text", (F.col("i") * PIECE_CHARS + 1).cast("int"), F.lit(PIECE_CHARS)).alias("piece"))
    # one piece of each text in turn, the longer texts' further ones behind; up to the size of a dictionary
    turn = Window.partitionBy("lang", "k").orderBy(F.xxhash64("piece", "i"), "i")
    run = Window.partitionBy("lang").orderBy("turn", "k").rowsBetween(Window.unboundedPreceding, 0)
    sized = pieces.withColumn("turn", F.row_number().over(turn)).withColumn("upto", F.sum(F.octet_length("piece") + 1).over(run))
    rows = sized.filter(F.col("upto") <= most).select("lang", "turn", "k", "piece").collect()
    out: dict[str, list[bytes]] = {}
    for lang, _, _, piece in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        out.setdefault(lang, []).append(piece.encode())
    return {lang: b"\n".join(x) for lang, x in out.items()}


class Classifier:
    def __init__(self, content: dict[str, bytes]):
        import zstandard

        self.langs = sorted(content)
        self.coders = []
        for lang in self.langs:
            d = zstandard.ZstdCompressionDict(content[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            self.coders.append(zstandard.ZstdCompressor(dict_data=d, level=LEVEL, write_checksum=False, write_content_size=False, write_dict_id=False))

    def classify(self, text: str | None) -> tuple[str, float, bool, list[int]]:
        """Language, score (0 to 1), whether the margin is narrow, and the sizes."""
        if not text or not self.langs or not any(map(str.isalpha, text)):
            return UNDETERMINED, 0.0, True, []
        raw = text.lower().encode()
        blocks = [raw[i : i + BLOCK_BYTES] for i in range(0, len(raw), BLOCK_BYTES)]
        sizes = [sum([len(c.compress(b)) for b in blocks]) for c in self.coders]
        best, *rest = sorted(zip(sizes, self.langs))
        margin = (rest[0][0] - best[0]) / rest[0][0] if rest else 1.0
        return best[1], margin / (margin + MARGIN), margin < MARGIN, sizes


_CLASSIFIERS: dict[int, tuple[dict, Classifier]] = {}


def predict(docs: DataFrame, content: dict[str, bytes]) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected of each row of docs(doc_id, text).

    A null text, one without a letter, or no dictionary at all gives `und` and score 0. Ties go to the
    first language by name. A null doc_id counts as not held out. Rows that repeat get equal results; an empty
    table gives no rows; other columns are not read.
    """
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(content)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not _CLASSIFIERS or _CLASSIFIERS[0][0] != shared.value:
            _CLASSIFIERS[0] = (shared.value, Classifier(shared.value))
        model = _CLASSIFIERS[0][1]
        for batch in batches:
            found = [model.classify(t)[:3] for t in batch.column("text").to_pylist()]
            cols = [pa.array([f[i] for f in found], k) for i, k in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column("held_out"), *cols], names=["doc_id", "held_out", "lang_pred", "score", "rejected"])

    rows = docs.select("doc_id", held_out().alias("held_out"), "text")
    return rows.mapInArrow(work, "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")


def identify(docs: DataFrame) -> DataFrame:
    """Learn from the labelled documents that are not held out, and predict for all."""
    return predict(docs, learn(docs))
