"""The page operators on a stream: stateless per page, so the batch transforms run unchanged on every micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from folioscope.operators import classification, extraction


def read_pages(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """New parquet files of pages (doc_id, page_number, text, width, height)."""
    schema = "doc_id BIGINT, page_number INT, text STRING, width INT, height INT"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def classified(pages: DataFrame) -> DataFrame:
    """Pages with category, confidence and score, as they come."""
    return classification.classify(pages).select("doc_id", "page_number", "category", "confidence", "score")


def counts(pages: DataFrame, at: str, wait: str = "1 hour", width: str = "10 minutes") -> DataFrame:
    """Pages by category in windows of the event time ``at``; later ones than ``wait`` are left out."""
    found = classification.classify(pages.withWatermark(at, wait))
    return found.groupBy(F.window(at, width), "category").count()


def fields(pages: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """A writer that appends the generic fields of each micro-batch to ``path``."""

    def write(batch: DataFrame, batch_id: int) -> None:
        extraction.generic(batch).withColumn("batch_id", F.lit(batch_id)).write.mode("append").parquet(path)

    return pages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
