"""What several operators of this subpackage share."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes of text that a Python function works on at a time.
SLICE_BYTES = 4_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(col: Column) -> Column:
    """A-Z in lower case, nothing else changed."""
    return F.translate(col, UPPER, LOWER)


def crc_mod(col: Column, modulus: int) -> Column:
    """crc32 of the value as text, modulo; a null counts as an empty text."""
    return F.crc32(F.encode(F.coalesce(col.cast("string"), F.lit("")), "utf-8")) % modulus


def columns(df: DataFrame, **wanted: str) -> DataFrame:
    """Only the named input columns, under the operator's own names: further columns can't clash."""
    return df.select(*[F.col(f"`{old}`").alias(new) for new, old in wanted.items()])


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names, which driver and executors share. Where that is unset, a temporary one in local mode only."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if folder is None and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="lexloom-checkpoint-"))
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts the lineage by a copy in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """Cuts the lineage by a Parquet table in the shared folder: smaller than a checkpoint, and read by column."""
    path = os.path.join(shared_folder(df.sparkSession), f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared file system."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


#: Keys more frequent than the number of rows over HOT_KEYS are at most so many; with fewer than HOT_ROWS rows a key isn't hot.
HOT_KEYS, HOT_ROWS = 50_000, 100


def with_values(rows: DataFrame, values: DataFrame, key: str, hot_rows: int = HOT_ROWS, total: int | None = None) -> DataFrame:
    """rows left-joined with values, which have each key once; hot keys' values are broadcast, so that no key gathers its rows in one task.

    The names of neither may begin with ``hot_``. ``total``: about how many rows there are, if that is known.
    """
    often = max(hot_rows, (rows.count() if total is None else total) // HOT_KEYS)
    hot = rows.groupBy(key).agg(F.count("*").alias("hot_n")).filter(F.col("hot_n") > often).select(key)
    names = [c for c in values.columns if c != key]
    sent = values.join(F.broadcast(hot), key).select(key, F.struct(*names).alias("hot_values"))
    met = rows.join(F.broadcast(sent), key, "left")
    # a row whose value is known goes on under a key of its own, which deals it out and meets nothing
    own = F.when(F.col("hot_values").isNull(), F.col(key)).otherwise(F.xxhash64(*rows.columns))
    dealt = met.withColumns({"hot_key": own, "hot_own": F.col("hot_values").isNotNull()})
    cold = values.select(F.col(key).alias("hot_key"), F.lit(False).alias("hot_own"), F.struct(*names).alias("hot_cold"))
    out = dealt.join(cold, ["hot_key", "hot_own"], "left")
    return out.select(*rows.columns, *[F.coalesce(F.col(f"hot_values.{n}"), F.col(f"hot_cold.{n}")).alias(n) for n in names])


def sliced(batches: Iterator[pa.RecordBatch], by: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of about that many bytes of the column, at least one row each."""
    for batch in batches:
        at, size = 0, 0
        for k, n in enumerate(pc.binary_length(batch.column(by)).to_pylist()):
            if size and size + (n or 0) > most:
                yield batch.slice(at, k - at)
                at, size = k, 0
            size += n or 0
        if batch.num_rows > at:
            yield batch.slice(at)


def as_bytes(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """The column's texts in UTF-8, null as empty."""
    return [x or b"" for x in batch.column(name).cast(pa.binary()).to_pylist()]


def let(value: Column, then) -> Column:
    """then(value), where the value is worked out once for a row: as an array of one that a lambda maps."""
    return F.get(F.transform(F.array(value), then), 0)
