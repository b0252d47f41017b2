"""Ingest of files as they arrive: clean, chunk, embed, upsert by id in each micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sextant.operators.embedding import Provider
from sextant.operators.store import VectorStore
from sextant.plans.ingest import chunks
from sextant.sources.files import as_documents


def arriving(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """Whole text files that land in a folder, as documents."""
    raw = spark.readStream.option("wholetext", True).option("maxFilesPerTrigger", files_per_batch).text(folder)
    rows = raw.select(F.regexp_extract(F.col("_metadata.file_path"), r"[^/]+$", 0).alias("source"), F.col("_metadata.file_path").alias("absolute_path"), F.col("_metadata.file_size").alias("file_size"), F.col("_metadata.file_modification_time").alias("modified"), F.col("value").alias("content"))
    return as_documents(rows)


def ingest_stream(docs: DataFrame, store: VectorStore, embed: Provider, checkpoint: str, collection: str = "default", once: bool = False, **how) -> StreamingQuery:
    """Start the stream. A batch that is replayed upserts the same ids, so the store ends as if it had run once."""

    def batch(rows: DataFrame, _: int) -> None:
        made = chunks(rows, **how)
        store.add(made.withColumn("embedding", embed(F.col("content"))), collection)

    w = docs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start()
