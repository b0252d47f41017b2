"""What the operators of this subpackage share: word patterns, written tables, size-checked joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, StringType, StructType

from sextant.tables import fresh_path, saved

#: A word is a maximal run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
#: Rows and bytes up to which a small table is broadcast; beyond, the join shuffles and AQE splits its skewed keys.
BROADCAST_ROWS, BROADCAST_BYTES = 50_000, 4 << 20


def written(df: DataFrame, name: str, narrow: bool = False, outlives: bool = False) -> DataFrame:
    """Write df as Parquet to the shared folder and read it again: cuts lineage, survives lost executors; ``tables.scratch`` deletes it.

    narrow: rows are a few ids, so two tasks per core of the cluster write them, however many partitions there are.
    outlives: the result of a scratch, which stays when that deletes what it took to work it out.
    """
    spark = df.sparkSession
    df = df.coalesce(2 * spark.sparkContext.defaultParallelism) if narrow else df
    return saved(df, fresh_path(spark, name, outlives))


def small_join(df: DataFrame, small: DataFrame, on: Column | Sequence[str] | str, how: str = "inner", rows: int = BROADCAST_ROWS) -> DataFrame:
    """Join with a written table that is usually small: broadcast only if its counted rows and bytes are within the bounds."""
    n, size = small.agg(F.count(F.lit(1)), F.coalesce(F.sum(_width(small)), F.lit(0))).first()
    return df.join(F.broadcast(small) if n <= rows and size <= BROADCAST_BYTES else small, on, how)


def _width(df: DataFrame) -> Column:
    """The bytes that a row's values take, about."""
    out = F.lit(0).cast("long")
    for c, f in zip(every(df), df.schema.fields):
        if isinstance(f.dataType, (StringType, BinaryType)):
            n = F.octet_length(c)
        elif isinstance(f.dataType, ArrayType):
            n = 16 + 8 * F.size(c)
        else:
            n = F.lit(16 if isinstance(f.dataType, StructType) else 8)
        out = out + F.coalesce(n.cast("long"), F.lit(0))
    return out


def every(df: DataFrame) -> list[Column]:
    """All columns of df, whatever their names."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def n_words(text: Column) -> Column:
    """Words of a text as long; null: 0."""
    return F.size(words(text)).cast("long")


def words(text: Column) -> Column:
    """The words of a text as an array; null: empty."""
    inner = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, SPACE, -1))

