"""Documents to cleaned, chunked, embedded rows: one lineage from source to store."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Accumulator
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from sextant.errors import ConfigError, IngestError
from sextant.functions.text import CleanOptions, clean_frame
from sextant.operators.chunking import chunk_fixed, chunk_sentences
from sextant.operators.embedding import Provider
from sextant.operators.store import VectorStore


def with_metadata(docs: DataFrame) -> DataFrame:
    """doc_id, source and document_type in the metadata, a document's own entries over them."""
    own = F.coalesce("metadata", F.create_map().cast("map<string,string>"))
    base = F.create_map(F.lit("doc_id"), F.col("id"), F.lit("source"), F.col("source"), F.lit("document_type"), F.col("document_type"))
    return docs.withColumn("metadata", F.map_concat(F.map_filter(base, lambda k, v: ~F.map_contains_key(own, k)), own))


def chunks(docs: DataFrame, chunker: str = "sentence", size: int = 2000, overlap: int = 200, options: CleanOptions = CleanOptions()) -> DataFrame:
    """Clean and chunk; narrow all the way, so it scales with its input's partitions.  A null content has no chunks."""
    d = clean_frame(with_metadata(docs), "content", options)
    if chunker == "fixed":
        return chunk_fixed(d, size=size, overlap=overlap)
    if chunker == "sentence":
        return chunk_sentences(d, least=max(200, size // 4) if size > 200 else size - 1, most=size)
    raise ConfigError(f"no chunker {chunker!r}; known: fixed, sentence")


def counts(docs: DataFrame, made: DataFrame) -> DataFrame:
    """One row: documents_count and chunks_count."""
    return docs.agg(F.count(F.lit(1)).alias("documents_count")).join(made.agg(F.count(F.lit(1)).alias("chunks_count")), F.lit(True))


def sound(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents that can be worked on, the others: source and error)."""
    why = F.when(F.col("id").isNull(), "no id").when(F.col("content").isNull(), "no content")
    name = F.coalesce("id", "source", F.lit("?"))
    said = F.concat(F.lit("Failed to process document "), name, F.lit(": "), why)
    return docs.filter(F.col("id").isNotNull() & F.col("content").isNotNull()), docs.filter(why.isNotNull()).select("source", said.alias("error"))


class Progress:
    """How many documents and chunks of one ingest have passed, as its finished tasks tell."""

    def __init__(self, spark: SparkSession):
        self.documents, self.chunks = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)

    @staticmethod
    def counted(rows: DataFrame, key: str, total: Accumulator) -> DataFrame:
        """rows, each counted as it passes; only the key leaves the JVM."""

        @F.arrow_udf("boolean")
        def seen(keys: pa.Array) -> pa.Array:
            total.add(len(keys))
            return pa.array(np.ones(len(keys), bool))

        return rows.filter(seen.asNondeterministic()(F.col(key)))


def index(made: DataFrame, store: VectorStore, embed: Provider, collection: str = "default") -> None:
    """Embed chunks and upsert them by id: ids follow from the source, so a repeated run changes nothing.  No chunks are an error."""
    out = Observation()
    _indexed(made.observe(out, F.count(F.lit(1)).alias("n")), store, embed, collection)
    if not out.get["n"]:
        raise IngestError("there are no chunks to index")


def _indexed(made: DataFrame, store: VectorStore, embed: Provider, collection: str) -> None:
    store.add(made.withColumn("embedding", embed(F.col("content"))), collection)


def run(docs: DataFrame, store: VectorStore, embed: Provider, collection: str = "default", failed: DataFrame | None = None, progress: Progress | None = None, **how) -> tuple[dict, DataFrame]:
    """(summary, errors) of an ingest: clean, chunk, embed, upsert in one job, counted as the rows pass.

    summary: documents_count, chunks_count, errors_count, elapsed_seconds, documents_per_second.  failed: what
    the source could not read (source, error); documents without id or content join it.  The work goes on
    with the rest.  Counts are those of the job that wrote; a task that ran twice counts once.
    """
    good, bad = sound(docs)
    errors = bad if failed is None else failed.select("source", "error").unionByName(bad)
    seen, out = Observation(), Observation()
    start = time.perf_counter()
    count = progress.counted if progress else lambda rows, key, total: rows
    good = count(good.observe(seen, F.count(F.lit(1)).alias("n")), "id", progress and progress.documents)
    made = count(chunks(good, **how).observe(out, F.count(F.lit(1)).alias("n")), "id", progress and progress.chunks)
    _indexed(made, store, embed, collection)
    took = time.perf_counter() - start
    n = seen.get["n"]
    return {"documents_count": n, "chunks_count": out.get["n"], "errors_count": errors.count(), "elapsed_seconds": round(took, 2), "documents_per_second": round(n / took, 2)}, errors


def run_with_progress(docs: DataFrame, store: VectorStore, embed: Provider, collection: str = "default", failed: DataFrame | None = None, every: float = 1.0, **how) -> Iterator[dict]:
    """run, as dictionaries: documents_done and chunks_done of this ingest, whatever else runs; at last the summary.

    The job has a group of its own; whoever stops listening cancels it.
    """
    spark, done = docs.sparkSession, []
    progress, group = Progress(spark), f"ingest-{uuid.uuid4().hex}"

    def work() -> None:
        try:
            spark.sparkContext.setJobGroup(group, "ingest", True)
            done.append(run(docs, store, embed, collection, failed, progress, **how)[0])
        except Exception as e:  # handed to the caller's thread below
            done.append(e)

    t = threading.Thread(target=work, daemon=True)
    t.start()
    try:
        while t.is_alive():
            yield {"documents_done": progress.documents.value, "chunks_done": progress.chunks.value}
            t.join(every)
    finally:
        if t.is_alive():
            spark.sparkContext.cancelJobGroup(group)
    if isinstance(done[0], Exception):
        raise IngestError(str(done[0])) from done[0]
    yield {"documents_done": progress.documents.value, "chunks_done": progress.chunks.value}
    yield done[0]
