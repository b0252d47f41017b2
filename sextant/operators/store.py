"""A vector store in Parquet: a table by id for each collection, which grows by runs (see ``sextant.tables.Runs``).

A change writes its own rows and, now and then, rewrites about as many as have changed since; it is visible
once it is complete.  One writer at a time.  Ids are unique within a collection; of repeated ids in one batch
the last wins.  Frequent keys of the metadata are columns of their own, with types and statistics, so that
filters by them reach the scan.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping
from functools import reduce
from urllib.parse import quote, unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sextant.errors import ConfigError, StoreError
from sextant.operators.search import key_column, metadata_filter
from sextant.schemas import VECTOR
from sextant.tables import Folder, Runs, scratch, written


def flat_metadata(metadata: Column, document_id: Column, start: Column, end: Column) -> Column:
    """Metadata as strings, nulls as empty, with the chunk's place in it."""
    place = F.create_map(F.lit("document_id"), document_id, F.lit("start_idx"), start.cast("string"), F.lit("end_idx"), end.cast("string"))
    own = F.map_filter(F.coalesce(metadata, F.create_map().cast("map<string,string>")), lambda k, v: ~k.isin("document_id", "start_idx", "end_idx"))
    return F.transform_values(F.map_concat(own, place), lambda k, v: F.coalesce(v.cast("string"), F.lit("")))


def last_of_each(rows: DataFrame, id_col: str = "id", order: str | None = None) -> DataFrame:
    """One row per id: the last by order, or by its place in the frame where there is none.

    Tasks pick their last rows before anything moves, so an id that many rows have is no burden to one task.
    """
    at = F.struct(*([F.col(order)] if order else []), F.monotonically_increasing_id())
    last = rows.select(F.col(id_col).alias("_id"), F.struct(*rows.columns).alias("_r"), at.alias("_at")).groupBy("_id").agg(F.max_by("_r", "_at").alias("_r"))
    return last.select("_r.*")


def frequent_keys(rows: DataFrame, share: float = 0.5, most: int = 16, metadata: str = "metadata") -> dict[str, str]:
    """Keys that at least such a share of the rows have, the most frequent first, with the type that all their values have."""
    n = rows.count()
    each = rows.select(F.explode(metadata).alias("k", "v")).groupBy("k").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("v").try_cast("bigint").cast("string") == F.col("v")).alias("whole"), F.count("v").alias("values"),
    )
    top = each.filter(F.col("n") >= share * n).orderBy(F.desc("n"), "k").limit(most).collect()
    return {r.k: "bigint" if r.whole == r["values"] > 0 else "string" for r in top}


class VectorStore:
    """add, delete, get, count, clear and stats over a folder.

    keys: metadata keys that become columns, with their types; where they are not given, the frequent ones of the
    first rows do.  buckets and bucket_bytes: files of a change, and how large those of merged runs may become.
    """

    def __init__(self, spark: SparkSession, path: str, dimension: int | None = None, columns: str = VECTOR, metric: str = "cosine", keys: Mapping[str, str] | None = None, buckets: int = 8, bucket_bytes: int = 128 << 20):
        self.spark, self.path, self.dimension, self.metric = spark, path.rstrip("/"), dimension, metric
        self.buckets, self.bucket_bytes, self._keys = buckets, bucket_bytes, keys
        self.folder, self.schema = Folder(spark, path), StructType.fromDDL(columns)

    def keys(self, first: DataFrame | None = None) -> dict[str, str]:
        """Metadata keys with columns of their own, by type; settled when the first rows come."""
        if self.folder.exists("_keys.json"):
            return json.loads(self.folder.read_text("_keys.json"))
        if "metadata" not in self.schema.names:
            return {}
        if first is None:
            return dict(self._keys or {})
        found = dict(self._keys) if self._keys is not None else frequent_keys(first) if "metadata" in first.columns else {}
        self.folder.write_text("_keys.json", json.dumps(found))
        return found

    def _runs(self, collection: str) -> Runs:
        keys = self.keys()
        s = StructType([f for f in self.schema if f.name != "collection"])
        for k, kind in keys.items():
            s = s.add(key_column(k), StructType.fromDDL(f"k {kind}")["k"].dataType)
        return Runs(self.spark, f"{self.path}/collection={quote(collection, safe='')}", "id", s, self.buckets, self.bucket_bytes, tuple(map(key_column, list(keys)[:1])))

    def collections(self) -> list[str]:
        return sorted(unquote(n.split("=", 1)[1]) for n in self.folder.names() if n.startswith("collection="))

    def read(self, collection: str | None = None, where: Mapping[str, object] | None = None) -> DataFrame:
        """What the store holds now, with a column for each shredded key; where: equalities on columns or metadata keys."""
        names = self.collections() if collection is None else [collection]
        order = [*self.schema.names, *map(key_column, self.keys())]
        parts = [self._runs(c).read().withColumn("collection", F.lit(c)).select(*order) for c in names]
        if not parts:
            parts = [self._runs("").read().withColumn("collection", F.lit("")).select(*order)]
        out = reduce(DataFrame.unionByName, parts)
        return out.filter(metadata_filter(where, dict(out.dtypes))) if where else out

    def _shaped(self, rows: DataFrame, removed: bool) -> DataFrame:
        have = set(rows.columns)
        cols = {f.name: F.col(f.name).cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType) for f in self.schema if f.name != "collection"}
        for k, kind in self.keys().items():
            cols[key_column(k)] = cols["metadata"][k].try_cast(kind)
        return rows.select(*[c.alias(n) for n, c in cols.items()], F.lit(removed).alias("_removed"))

    def add(self, rows: DataFrame, collection: str = "default", order: str | None = None) -> None:
        """Upsert by id within the collection; only the new rows are written.  Null ids and vectors of another size end it."""
        with scratch(self.spark):
            self._add(rows, collection, order)

    def _add(self, rows: DataFrame, collection: str, order: str | None) -> None:
        if self._keys is None and "metadata" in rows.columns and not self.folder.exists("_keys.json"):
            rows = written(rows, "store-first")  # looked through for keys, then stored
        self.keys(rows)
        new = self._shaped(last_of_each(rows, "id", order), False)
        fail = lambda why, kind: F.raise_error(F.lit(why)).cast(kind)
        new = new.withColumn("id", F.coalesce("id", fail("rows of this store have an id", self.schema["id"].dataType)))
        if self.dimension is not None:
            fits = F.col("embedding").isNull() | (F.size("embedding") == self.dimension)
            new = new.withColumn("embedding", F.when(fits, F.col("embedding")).otherwise(fail(f"vectors of this store have {self.dimension} components", "array<float>")))
        try:
            self._runs(collection).append(new)
        except Exception as e:
            said = next((m for m in (f"vectors of this store have {self.dimension} components", "rows of this store have an id") if m in str(e)), None)
            if said is None:
                raise
            raise StoreError(said) from e

    def delete(self, ids: DataFrame, collection: str = "default") -> int:
        """Remove rows by the ids of a frame (column id); how many there were."""
        gone = self.get(ids, collection).select("id")
        n = gone.count()
        if n:
            self._runs(collection).append(self._shaped(gone, True))
        return n

    def get(self, ids: DataFrame, collection: str = "default") -> DataFrame:
        """Rows by the ids of a frame (column id); for few ids only the files of their buckets are opened."""
        return self._runs(collection).get(ids).withColumn("collection", F.lit(collection)).select(*self.schema.names)

    def count(self, collection: str = "default") -> int:
        return self._runs(collection).read().count()

    def compact(self) -> None:
        """One run for each collection."""
        for c in self.collections():
            self._runs(c).compact()

    def clear(self, collection: str = "default") -> None:
        """The collection goes, and with it its files."""
        self.folder.delete(f"collection={quote(collection, safe='')}")

    delete_collection = clear

    def stats(self) -> DataFrame:
        """count and dimension by collection, with the store's metric and path."""
        d = self.read().groupBy("collection").agg(F.count(F.lit(1)).alias("count"), F.max(F.size("embedding")).alias("dimension"))
        return d.withColumns({"metric": F.lit(self.metric), "path": F.lit(self.path)})


_stores: dict[str, Callable[..., VectorStore]] = {}


def register(name: str, make: Callable[..., VectorStore]) -> None:
    """Make a store known: a function of (spark, path, options)."""
    _stores[name] = make


def known() -> list[str]:
    return sorted(_stores)


def reset() -> None:
    """The stores that the library brings, and no others."""
    _stores.clear()
    register("parquet", VectorStore)


def open_store(kind: str, spark: SparkSession, path: str, **options) -> VectorStore:
    """A store by its name."""
    if kind not in _stores:
        raise ConfigError(f"no store {kind!r}; known: {', '.join(known())}")
    return _stores[kind](spark, path, **options)


reset()
