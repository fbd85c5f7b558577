"""Files on any store that a URI names, opened from tasks; and fresh folders in the session's shared one."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession


def store(uri: str) -> tuple[fs.FileSystem, str]:
    """The store of a URI or absolute path, and the path in it. Stores are those that Arrow opens: local, HDFS, S3, GCS, Azure."""
    return fs.FileSystem.from_uri(uri if "://" in uri else os.path.abspath(uri.removeprefix("file:")))


def files_under(uri: str) -> list[tuple[str, int]]:
    """Path (in the store) and size of a file, or of the files in a folder whose names do not begin with _ or a dot."""
    at, path = store(uri)
    found = at.get_file_info(path)
    if found.type == fs.FileType.NotFound:
        raise FileNotFoundError(uri)
    if found.type == fs.FileType.Directory:
        held = at.get_file_info(fs.FileSelector(path))
        return sorted((x.path, x.size) for x in held if x.type == fs.FileType.File and x.base_name[0] not in "_.")
    return [(path, found.size)]


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A new path in the folder of spark.checkpoint.dir; only a session with one process may go without that setting."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"file://{os.path.join(tempfile.gettempdir(), 'stoplake-scratch')}"
    return f"{base.rstrip('/')}/stoplake/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df as a table in a fresh folder, so that its size is known when a join with it is planned."""
    folder = fresh_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def in_pieces(f, start: int, end: int, size: int = 1 << 20) -> Iterator[bytes]:
    """The bytes of an open file from start to end, a piece at a time."""
    f.seek(start)
    while start < end and (piece := f.read(min(size, end - start))):
        start += len(piece)
        yield piece
