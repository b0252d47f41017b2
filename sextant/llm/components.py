"""Connected components of a written edge table, on the executors."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sextant.llm.base import small_join, written
from sextant.llm.kernels import tidy

#: Edges that a task joins up at a time before it hands on stars.
HELD = 500_000


def _joined_up(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (lo, hi) of a partition as stars: every node to the smallest that it is joined to there."""
    up: dict = {}

    def root(x):
        while (y := up.get(x, x)) != x:
            up[x] = up.get(y, y)
            x = y
        return x

    kind = None

    def stars() -> pa.RecordBatch:
        rows = [(root(x), x) for x in up]
        rows = [r for r in rows if r[0] != r[1]]
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], kind), pa.array([r[1] for r in rows], kind)], ["lo", "hi"])

    n = 0
    for batch in batches:
        kind = batch.schema.field(0).type
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = root(a), root(b)
            if a != b:
                up[max(a, b)] = min(a, b)
                up.setdefault(min(a, b), min(a, b))
        n += batch.num_rows
        if n >= HELD:
            yield stars()
            up.clear()
            n = 0
    if up:
        yield stars()


def _are_stars(e: DataFrame) -> bool:
    """Whether every node is a centre or hangs on one centre."""
    ends = e.select(F.col("lo").alias("x"), F.lit(0).alias("hangs")).union(e.select("hi", F.lit(1)))
    return ends.groupBy("x").agg(F.min("hangs").alias("a"), F.max("hangs").alias("b"), F.sum("hangs").alias("n")).filter("a != b or n > 1").isEmpty()


def components(edges: DataFrame, name: str) -> DataFrame:
    """(node, label) for every node of edges (a, b), the labels among them; label: the smallest node.

    Tasks join up what their partitions hold; edges that fit one task's share are one partition.  Beyond,
    large-star and small-star rounds hook neighbours to the smallest one seen until only stars are left.
    Each round is written, so a lost executor costs one round.  Minima are found by aggregation, never by
    gathering a node's neighbours in one place.
    """
    kind = edges.schema["a"].dataType.simpleString()
    e = written(edges.filter("a != b").select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")), name, True)
    small = e.count() <= HELD
    if small:
        e = e.coalesce(1)

    def local(e: DataFrame) -> DataFrame:
        return written(e.mapInArrow(tidy(_joined_up), f"lo {kind}, hi {kind}"), name, True)

    e = local(e)
    while not small and not _are_stars(e):
        both = e.select(F.col("lo").alias("u"), F.col("hi").alias("v")).union(e.select("hi", "lo"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.filter("v > u").join(least, "u").filter("v != m").select(F.col("m").alias("lo"), F.col("v").alias("hi")).distinct()
        tips = large.groupBy("hi").agg(F.min("lo").alias("m"))
        star = large.join(tips, "hi").filter("lo != m").select(F.col("m").alias("lo"), F.col("lo").alias("hi")).union(tips.select(F.col("m").alias("lo"), "hi")).distinct()
        e = local(star)
    return e.select(F.col("hi").alias("node"), F.col("lo").alias("label")).distinct().union(e.select("lo", "lo").distinct())


def merged(groups: DataFrame | None, links: DataFrame, name: str) -> DataFrame:
    """groups (node, label) after new links (a, b): only what the links join is worked on again."""
    if groups is None:
        return written(components(links, name), name, True)
    of = lambda c, to: groups.select(F.col("node").alias(c), F.col("label").alias(to))
    d = small_join(small_join(links, of("a", "la"), ["a"], "left"), of("b", "lb"), ["b"], "left")
    new = written(components(d.select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b")), name), name, True)
    d = small_join(groups, new.select(F.col("node").alias("label"), F.col("label").alias("to")), ["label"], "left").select("node", F.coalesce("to", "label").alias("label"))
    return written(d.union(small_join(new, groups.select("node"), ["node"], "left_anti").select("node", "label")), name, True)
