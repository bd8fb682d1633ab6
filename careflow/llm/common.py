"""What several text operators share: table reads, written intermediates, sized broadcasts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from careflow.session import shared_path

# A side of a join is sent to all executors only if its rows times its row width stay below this.
BROADCAST_BYTES = 32 * 1024 * 1024
# Text bytes that a task works on at once.
SLICE_BYTES = 1 << 21


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows, computed once into the shared folder and read back by column."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    release(spark)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of finished steps: it does so once the driver's JVM
    has noticed that nothing refers to them, which may otherwise take long."""
    spark.sparkContext._jvm.System.gc()


def remove(df: DataFrame) -> None:
    """Deletes the files of a frame made by `written` that nothing reads any more."""
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        remove_path(df.sparkSession, folder)


def remove_path(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame, row_bytes: int, limit: int | None = None) -> DataFrame:
    """Marks a written frame for broadcast if its counted rows fit; otherwise leaves the join to a shuffle."""
    limit = BROADCAST_BYTES if limit is None else limit
    return F.broadcast(df) if df.count() * row_bytes <= limit else df


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of rows whose texts have about `most` bytes (one row at least)."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0)
        ends = np.cumsum(sizes.to_numpy(zero_copy_only=False).astype(np.int64))
        at, before = 0, 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, before + most, "right")))
            yield batch.slice(at, to - at)
            at, before = to, int(ends[to - 1])


def free(df: DataFrame, *names: str) -> list[str]:
    """The names, lengthened until no column of `df` has them (in any case)."""
    have, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in have:
            name += "_"
        have.add(name.lower())
        out.append(name)
    return out


def text_key(text: Column) -> Column:
    """64 bits that tell texts under one id apart. Null counts as empty."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def remainder(id_col: str, by: int) -> Column:
    """crc32 of the id as text, modulo `by`; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % by


MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads every bit of 64-bit values over all bits (a bijection)."""
    h = h ^ (h >> np.uint64(30))
    h *= MIX[0]
    h ^= h >> np.uint64(27)
    h *= MIX[1]
    return h ^ (h >> np.uint64(31))
