"""Places in a global order without one task for all rows, and tables kept in the session's shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stoplake.sources.storage import fresh_folder

#: Bits of the rows of a part in Spark's increasing ids.
ROW_BITS = 33


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back: each later read sees the same rows in the same parts."""
    path = fresh_folder(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stoplake_folder = path
    return out


def drop(spark: SparkSession, df: DataFrame) -> None:
    """Delete what stored() wrote, once nothing will read it again."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df._stoplake_folder)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def numbered(df: DataFrame, *order: str | F.Column) -> DataFrame:
    """df with place, from 1, in an order: rows are range-dealt and sorted in parts, and each part begins after those before it.

    Only the counts of parts meet on the driver. Rows that are equal in the order are placed as they come.
    """
    names = df.columns
    parts = stored(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "numbered")
    part, row = F.shiftright("_at", ROW_BITS), F.col("_at").bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    offsets, before = [], 0
    for r in parts.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).orderBy("part").collect():
        offsets.append((r.part, before))
        before += r.n
    starts = df.sparkSession.createDataFrame(offsets, "part long, before long")
    placed = parts.withColumn("part", part).join(F.broadcast(starts), "part")
    return placed.select(*[F.col(f"`{c}`") for c in names], (F.col("before") + row + 1).alias("place"))
