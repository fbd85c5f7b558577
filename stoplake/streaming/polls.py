"""A feed that is polled, as a streaming source whose polls can be read again.

Each trigger fetches the feed once and stores the body in a journal under the next number before the number becomes an
offset. A batch is the bodies of a range of numbers. Whatever happens between the fetch and the commit of a batch, the
body is there: a batch that is run again reads the same bodies, and a poll that no batch knew of yet is part of the next one.
"""

from __future__ import annotations

import logging
import urllib.error
import urllib.request
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from stoplake.session import ship_package
from stoplake.sources.gtfs_rt import SCHEMA, flatten
from stoplake.sources.storage import store

#: Seconds that a fetch may take.
TIMEOUT_S = 30.0


def fetch(url: str, timeout: float = TIMEOUT_S) -> bytes | None:
    """The body at a URL (http, https, or any store); None, and a word in the log, if it cannot be had now."""
    try:
        if url.startswith(("http:", "https:")):
            with urllib.request.urlopen(url, timeout=timeout) as answer:
                return answer.read()
        at, path = store(url)
        with at.open_input_stream(path, compression=None) as f:
            return f.read()
    except (OSError, urllib.error.URLError) as error:
        logging.getLogger(__name__).warning("poll of %s failed: %s", url, error)
        return None


class Journal:
    """Bodies by number in a folder that driver and executors share."""

    def __init__(self, uri: str):
        self.uri = uri

    def path(self, number: int) -> tuple[fs.FileSystem, str]:
        at, folder = store(self.uri)
        return at, f"{folder}/poll-{number:012d}.pb"

    def numbers(self) -> list[int]:
        at, folder = store(self.uri)
        found = at.get_file_info(fs.FileSelector(folder, allow_not_found=True))
        return sorted(int(x.base_name[5:-3]) for x in found if x.base_name.startswith("poll-") and x.base_name.endswith(".pb"))

    def put(self, number: int, body: bytes) -> None:
        at, path = self.path(number)
        at.create_dir(path.rpartition("/")[0])
        held = f"{path}.{uuid.uuid4().hex}.tmp"
        with at.open_output_stream(held) as f:
            f.write(body)
        at.move(held, path)  # a number is there as a whole or not at all

    def get(self, number: int) -> bytes:
        at, path = self.path(number)
        with at.open_input_stream(path, compression=None) as f:
            return f.read()

    def forget(self, last: int) -> None:
        """Delete the bodies up to a number, but for the newest of all, which tells the next number."""
        for number in [n for n in self.numbers()[:-1] if n <= last]:
            at, path = self.path(number)
            at.delete_file(path)


@dataclass
class Poll(InputPartition):
    number: int


class PollReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.url, self.journal, self.timeout = options["url"], Journal(options["journal"]), float(options.get("timeout", TIMEOUT_S))

    def initialOffset(self) -> dict:
        return {"poll": 0}

    def latestOffset(self) -> dict:
        last = max(self.journal.numbers(), default=0)
        if body := fetch(self.url, self.timeout):
            last += 1
            self.journal.put(last, body)
        return {"poll": last}

    def partitions(self, start: dict, end: dict) -> list[Poll]:
        return [Poll(n) for n in range(start["poll"] + 1, end["poll"] + 1)]

    def read(self, part: Poll) -> Iterator[tuple]:
        try:
            yield from flatten(self.journal.get(part.number))
        except (ValueError, IndexError, TypeError):  # fail soft, as for any external input
            return

    def commit(self, end: dict) -> None:
        self.journal.forget(end["poll"])


class FeedPolls(DataSource):
    """spark.readStream.format("feed_polls"); options url, journal (a shared folder, as the checkpoint is one) and timeout."""

    @classmethod
    def name(cls) -> str:
        return "feed_polls"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema: StructType) -> PollReader:
        return PollReader(self.options)


def polled(spark: SparkSession, url: str, journal: str, timeout: float = TIMEOUT_S) -> DataFrame:
    """Rows of a trip-update feed as it is polled, once for each trigger."""
    ship_package(spark)
    if FeedPolls.name() not in (known := spark.__dict__.setdefault("_stoplake_formats", set())):
        spark.dataSource.register(FeedPolls)
        known.add(FeedPolls.name())
    return spark.readStream.format("feed_polls").option("url", url).option("journal", journal).option("timeout", timeout).load()
