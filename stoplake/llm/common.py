"""What the corpus operators share: inputs, scratch tables and word splitting."""

from __future__ import annotations

import contextlib
import gc
import os
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from stoplake.session import ship_package

#: A word is a run of characters other than the six ASCII white-space ones.
WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: The same separators for Java and RE2 regular expressions.
GAP_SQL = r"[\x20\x09-\x0D]+"
#: Rows and bytes in an Arrow batch, at most: texts can be long. Operators that look up a batch's distinct words take more.
BATCH_ROWS, BATCH_BYTES, WORD_BATCH_BYTES = 4096, 1 << 20, 4 << 20


def prepare(spark: SparkSession, batch_bytes: int = BATCH_BYTES) -> None:
    """Ship the package and bound Arrow batches by bytes; texts of any length then fit a worker.

    The two settings stay in the session, since Spark reads them when a query runs.
    """
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(batch_bytes))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that the cluster names in spark.checkpoint.dir.

    Only a session with one process may go without: on a cluster a folder of its own would lose the data.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"file://{os.path.join(tempfile.gettempdir(), 'stoplake-scratch')}"
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/stoplake/{name}-{uuid.uuid4().hex}"
    _SCRATCH.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


#: Paths by application that scratch() gave and nobody deleted.
_SCRATCH: dict[str, list[str]] = {}


def clean_scratch(spark: SparkSession) -> int:
    """Delete what operators wrote to the shared folder; for when all results that read it have been written. Gives the number of paths."""
    held = _SCRATCH.pop(spark.sparkContext.applicationId, [])
    for path in held:
        drop_path(spark, path)
    return len(held)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: later jobs neither repeat nor lose it."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stoplake_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table that materialise() wrote and that nothing will read again."""
    drop_path(df.sparkSession, df._stoplake_path)


def drop_path(spark: SparkSession, path: str) -> None:
    if path in (held := _SCRATCH.get(spark.sparkContext.applicationId, [])):
        held.remove(path)
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of DataFrames that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


@contextlib.contextmanager
def no_collector() -> Iterator[None]:
    """Without Python's search for cycles: code that makes none would have its large tables walked each time."""
    gc.disable()
    try:
        yield
    finally:
        gc.enable()


def split_words(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct words of texts with A-Z in lower case, the place of each word among them, and where each text begins (with the end).

    Done in Arrow, so that only distinct words become Python objects; a null text has no words.
    """
    split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    coded = split.flatten().dictionary_encode()
    words, at = coded.dictionary.to_pylist(), np.asarray(coded.indices, np.int64)
    starts = np.asarray(split.offsets, np.int64) - split.offsets[0].as_py()
    if "" in words:  # white space at either end of a text
        some = at != words.index("")
        starts, at = np.concatenate([[0], np.cumsum(some)])[starts], at[some]
    return words, at, starts


def texts_of(batch, name: str = "text") -> list[str]:
    """The texts of an Arrow batch; null counts as empty."""
    return [t or "" for t in batch.column(name).to_pylist()]
