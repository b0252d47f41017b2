"""Embedding providers, and a cache table in front of them."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sextant.errors import ProviderError
from sextant.functions.text import strip
from sextant.operators import remote
from sextant.tables import Runs, written

Provider = Callable[[Column], Column]
_providers: dict[str, Callable[..., Provider]] = {}
#: Words whose places a task remembers at a time.
KNOWN = 1 << 18


def register(name: str, make: Callable[..., Provider]) -> None:
    """Make a provider known: a function of options that gives a function from a text column to a vector column."""
    _providers[name] = make


def provider(name: str = "hashing", **options) -> Provider:
    if name not in _providers:
        raise ProviderError(f"no embedding provider {name!r}; known: {', '.join(sorted(_providers))}")
    return _providers[name](**options)


def hashing(dimension: int = 64) -> Provider:
    """Counts of lower-case words by md5 modulo the dimension, divided by their length. No model, no network."""

    @F.arrow_udf("array<float>")
    def embed(x: pa.Array) -> pa.Array:
        seen: dict[str, int] = {}

        def place(w: str) -> int:
            p = seen.get(w)
            if p is None:
                if len(seen) >= KNOWN:
                    seen.clear()
                p = seen[w] = int(hashlib.md5(w.encode()).hexdigest(), 16) % dimension
            return p

        def vector(t: str | None) -> np.ndarray | None:
            if t is None:
                return None
            v = np.bincount([place(w) for w in t.lower().split()], minlength=dimension).astype(float) if t.strip() else np.zeros(dimension)
            n = float(np.sqrt((v * v).sum()))
            return (v / (n or 1.0)).astype(np.float32)

        # A text at a time, so that a batch stands in memory once.
        return pa.array((vector(t.as_py()) for t in x), pa.list_(pa.float32()), size=len(x))

    return embed


def sentence_model(model: str, normalize: bool = True, batch: int = 32) -> Provider:
    """A sentence-transformers model, loaded once in each Python worker; needs that library on the executors."""

    @F.arrow_udf("array<float>")
    def embed(xs: pa.Array) -> pa.Array:
        from sentence_transformers import SentenceTransformer

        loaded = globals().setdefault("_models", {})
        if model not in loaded:
            loaded[model] = SentenceTransformer(model)
        v = loaded[model].encode([t or "" for t in xs.to_pylist()], batch_size=batch, normalize_embeddings=normalize)
        return pa.array(list(np.asarray(v, np.float32)), pa.list_(pa.float32()))

    return embed


register("hashing", hashing)
register("local", sentence_model)
register("remote", remote.vectors)


def refuse_blank(embed: Provider) -> Provider:
    """A provider that ends the job at a null or blank text instead of giving it a vector or null."""
    said = F.raise_error(F.lit("a blank text has no embedding")).cast("array<float>")
    return lambda c: F.when(F.coalesce(strip(c), F.lit("")) == "", said).otherwise(embed(c))


def cache_key(text: Column, model: str) -> Column:
    return F.sha2(F.concat(F.lit(f"{model}:"), text), 256)


class EmbeddingCache:
    """Vectors by key (model and text) in a table that grows by runs; a large run is never moved to look keys up.

    An entry without a vector, with nulls in it, or with another number of components than it says is corrupt and
    counts as missing; the entry that is made anew takes its place.
    """

    def __init__(self, spark: SparkSession, path: str, model: str, buckets: int = 8, bucket_bytes: int = 128 << 20):
        self.model = model
        self.runs = Runs(spark, path, "key", StructType.fromDDL("key string, model string, vector array<float>, dimension int"), buckets, bucket_bytes)

    @staticmethod
    def _sound(vector: str = "vector", dimension: str = "dimension") -> Column:
        v = F.col(vector)
        return v.isNotNull() & (F.size(v) > 0) & (F.size(v) == F.col(dimension)) & F.forall(v, lambda x: x.isNotNull())

    def entries(self) -> DataFrame:
        """key, model, vector, dimension of the sound entries."""
        return self.runs.read().filter(self._sound())

    def add(self, entries: DataFrame) -> None:
        """Entries by key, each key once."""
        self.runs.append(entries.withColumn("_removed", F.lit(False)))

    def contains(self, rows: DataFrame, text: str = "content") -> DataFrame:
        """(key, text, known) of the distinct texts of rows."""
        return self.looked_up(rows, text).select("key", "text", F.col("vector").isNotNull().alias("known"))

    def looked_up(self, rows: DataFrame, text: str = "content") -> DataFrame:
        """(key, text, vector) of the distinct texts of rows, vector null where the cache has none.

        The texts are dealt out as the largest run's buckets are, so that one stays where it is.
        """
        asked = rows.filter(F.col(text).isNotNull()).select(cache_key(F.col(text), self.model).alias("key"), F.col(text).alias("text")).groupBy("key").agg(F.first("text").alias("text"))
        runs = self.runs.current()
        if not runs:
            return asked.withColumn("vector", F.lit(None).cast("array<float>"))
        found = asked.repartition(max(r[2] for r in runs), "key")
        names = []
        for i, r in enumerate(reversed(runs)):  # the newest first
            names.append(f"_v{i}")
            mine = self.runs.table(r).select("key", F.when(~F.col("_removed") & self._sound(), F.col("vector")).alias(names[-1]))
            found = found.join(mine, "key", "left")
        return found.select("key", "text", F.coalesce(*names).alias("vector"))

    def embed(self, rows: DataFrame, embed: Provider, text: str = "content") -> DataFrame:
        """rows with embedding: each distinct text that the cache lacks is embedded once and kept before any row gets its vector.

        Null texts, and those that the provider has no vector for, have none.
        """
        found = written(self.looked_up(rows, text), "cache-found")
        new = found.filter("vector is null").select("key", F.lit(self.model).alias("model"), embed(F.col("text")).alias("vector"))
        # Filters by the vector stand after the table: before it, they would have the provider asked again.
        new = written(new, "cache-new").filter("vector is not null").withColumn("dimension", F.size("vector"))
        if not new.isEmpty():
            self.add(new)
        every = found.filter("vector is not null").select("key", "vector").unionByName(new.select("key", "vector")).select(F.col("key").alias("_key"), F.col("vector").alias("embedding"))
        keyed = rows.withColumn("_key", cache_key(F.col(text), self.model))
        with_text = keyed.filter("_key is not null").join(every, "_key", "left").drop("_key")
        return with_text.unionByName(keyed.filter("_key is null").drop("_key").withColumn("embedding", F.lit(None).cast("array<float>")))

    def stats(self) -> DataFrame:
        """One row: entries and the numbers in them."""
        return self.entries().agg(F.count(F.lit(1)).alias("entries"), F.coalesce(F.sum("dimension"), F.lit(0)).alias("numbers"))

    def clear(self) -> None:
        self.runs.folder.delete()
