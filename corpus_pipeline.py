"""A training-corpus pipeline of five of the corpus operators, each stage written and read again.

All stages but the last keep the columns of documents, in their order and whatever further ones there are, by
any name. An empty table gives an empty one. Rows are told apart by their contents, so null and repeated
doc_ids are no obstacle; each docstring says what becomes of null texts and of rows that repeat.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stoplake.llm import decontaminate, jaccard_join, pii_surrogates, quality_rules, sentencepiece_bpe
from stoplake.llm.common import discard, materialise, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep, without their boilerplate lines; n_chars follows the text.

    A null or empty text has too few words and goes. Rows with equal texts and sources get one verdict and all
    stay or go; a null source is a host of its own, together with ''.
    """
    return quality_rules.cleaned(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that with the smallest doc_id, a null one last.

    Of rows that repeat both doc_id and words one stays. Texts without words, null ones too, are copies of
    nothing and all stay.
    """
    return jaccard_join.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark questions, in any parameterisation; null and empty texts stay.

    Rows with equal texts all stay or go. A null or empty benchmark item, or an empty benchmark, matches nothing.
    """
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced; n_chars follows the text, and is null where that is.

    No row goes; a null text stays null, and rows that repeat stay alike.
    """
    out = pii_surrogates.protect(docs, count=None)
    return out.select(*[F.char_length("text").cast("long").alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each document, the end id last, and whether decoding them gives its text.

    A null text is encoded as an empty one, and decodes is then false. No row goes.
    """
    import public_tokenizers

    out = sentencepiece_bpe.encode_documents(docs.select("doc_id", "lang", "source", "text"), public_tokenizers.path("piece_bpe_32k.model"))
    same = F.coalesce(F.col("decoded") == F.col("text"), F.lit(False))
    return out.select("doc_id", "lang", "source", "n_tokens", "piece_ids", same.alias("decodes"))


#: In this order.
STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("surrogates", surrogates),
    ("encoding", encoding),
]
#: Shingle joins, surrogates and encoding are beyond SQL; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of sf_dir; each but the last is written to the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, materialise(stage(spark, docs, sf_dir), name)
        if name != STAGES[0][0]:
            discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
