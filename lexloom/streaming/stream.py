"""Extension: the stateless column functions and exact dedup over a stream of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.functions import citations
from lexloom.functions import text as T


def documents(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def cited(docs: DataFrame, text: str = "text") -> DataFrame:
    """A row per citation as documents arrive."""
    return docs.withColumn("clean", T.clean_whitespace(F.col(text))).select("*", F.explode(citations.citations_of(F.col("clean"))).alias("citation")).drop("clean")


def deduplicated(docs: DataFrame, time: str, delay: str = "1 hour", text: str = "text") -> DataFrame:
    """Documents whose fingerprint wasn't seen within the delay; the state is bounded by the watermark."""
    return docs.withColumn("fp", T.fingerprint(F.col(text))).withWatermark(time, delay).dropDuplicatesWithinWatermark(["fp"])


def citation_counts(docs: DataFrame, time: str, window: str = "1 hour", delay: str = "1 hour", text: str = "text") -> DataFrame:
    """Citations by window and jurisdiction."""
    rows = cited(docs, text).withWatermark(time, delay)
    return rows.groupBy(F.window(time, window), F.col("citation.jurisdiction").alias("jurisdiction")).count()
