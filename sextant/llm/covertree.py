"""Exact top-k search by a dual-tree walk over cover trees of queries and data.

Vectors lie in cells around pivots, and cells in blocks; each block is packed with a cover tree, built once.
The largest inner product between two nodes is bounded by their centres and covering radii; a pair of
nodes is dropped when that bound is below the worst k-th score of its queries.  Roots of blocks are nodes
like others: each block of queries first meets the data blocks that promise most, and of the others only
those travel whose bound reaches its worst k-th score then.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sextant.llm.base import small_join, written
from sextant.llm.kernels import tidy

#: Vectors in a block of data and of queries at most, about, pivots at most (larger cells are several blocks), data blocks
#: that a block of queries meets first and, of the others, at a time.
DATA_BLOCK, QUERY_BLOCK, PIVOTS, SOONER, TOGETHER = 4096, 1024, 1024, 3, 8
#: Shrinking of radii; points of a leaf of data and of queries (a leaf of few queries stays close together).
SHRINK, LEAF, QUERY_LEAF = 0.8, 96, 32
_LAST = np.iinfo(np.int64).max


#: Children of a node at most; a node with more centres gives the rest to the nearest ones.
FAN = 16


@dataclass
class Tree:
    """Nodes as arrays: centres (and their places in the order), covering radii, the points low to high of the order that they hold, children (0: leaf)."""

    order: np.ndarray
    at: np.ndarray
    centre: np.ndarray
    radius: np.ndarray
    norm: np.ndarray
    low: np.ndarray
    high: np.ndarray
    first: np.ndarray
    count: np.ndarray

    def packed(self) -> bytes:
        return np.concatenate([self.at, self.radius.view(np.int64), self.norm.view(np.int64), self.low, self.high, self.first, self.count]).tobytes()


def unpacked(tree: bytes, points: np.ndarray) -> Tree:
    """The packed tree of points that stand in its order."""
    at, radius, norm, low, high, first, count = np.frombuffer(tree, np.int64).reshape(7, -1)
    return Tree(np.arange(len(points)), at, points[at], radius.view(np.float64), norm.view(np.float64), low, high, first, count)


def cover_tree(points: np.ndarray, leaf: int = LEAF) -> Tree:
    """A node's children are centred on its points, farthest first, until each point is within the shrunken radius of one.

    Nodes are laid out breadth-first, so that the children of a node stand together; points that a node
    holds stand together in the order.
    """
    squares = (points * points).sum(1)
    scale = float(squares.max()) if len(points) else 0.0

    def distance(idx: np.ndarray, c: int) -> np.ndarray:
        return np.sqrt(np.maximum(squares[idx] + squares[c] - 2 * (points[idx] @ points[c]), 0))

    mean = points.mean(0)
    level = [(np.arange(len(points)), int((squares - 2 * (points @ mean)).argmin()))]
    held, centre, radius, first, count = [], [], [], [], []
    while level:
        below, base = [], len(centre) + len(level)
        for idx, c in level:
            d = distance(idx, c)
            r = float(d.max())
            held.append(idx)
            centre.append(c)
            # Rounding of squares must not make a ball smaller than it is.
            radius.append(r + 1e-7 * np.sqrt(scale) + 1e-9)
            first.append(base + len(below))
            if len(idx) <= leaf or r <= 1e-6 * np.sqrt(scale):
                count.append(0)
                continue
            own, near, n, pick = np.zeros(len(idx), np.int64), d.copy(), 1, int(d.argmax())
            names = [c]
            while near[pick] > SHRINK * r and n < FAN or n < 2:
                e = distance(idx, idx[pick])
                own[e < near] = n
                near = np.minimum(near, e)
                own[pick] = n
                names.append(int(idx[pick]))
                n, pick = n + 1, int(near.argmax())
            kids = [(idx[own == i], x) for i, x in enumerate(names)]
            kids = [k for k in kids if len(k[0])]
            below += kids
            count.append(len(kids))
        level = below
    first, count = np.array(first), np.array(count)
    # Leaves in depth-first order give every node its stretch of points.
    low, high, order, at = np.zeros(len(centre), np.int64), np.zeros(len(centre), np.int64), [], 0
    todo = [(0, False)]
    while todo:
        v, done = todo.pop()
        if done:
            high[v] = at
            continue
        low[v] = at
        if count[v]:
            todo.append((v, True))
            todo += [(int(k), False) for k in range(first[v] + count[v] - 1, first[v] - 1, -1)]
        else:
            order.append(held[v])
            at += len(held[v])
            high[v] = at
    c, order = points[np.array(centre)], np.concatenate(order)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return Tree(order, place[np.array(centre)], c, np.array(radius), np.sqrt((c * c).sum(1)), low, high, first, count)


class Search:
    """A block of queries with its tree and the best k so far of each query, best first."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int, tree: Tree | None = None):
        self.tree = tree or cover_tree(vectors, QUERY_LEAF)
        self.ids, self.x, self.k, self.compared = ids[self.tree.order], vectors[self.tree.order], k, 0
        self.length = np.sqrt((self.x * self.x).sum(1))
        self.score = np.full((len(ids), k), -np.inf)
        self.name = np.full((len(ids), k), _LAST)

    def _bounds(self, d: Tree, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """<q, p> <= <cq, cp> + |cq| rp + |cp| rq + rq rp for all below nodes a and b, with room for rounding."""
        q = self.tree
        dot = np.einsum("ij,ij->i", q.centre[a], d.centre[b])
        most = dot + q.norm[a] * d.radius[b] + d.norm[b] * q.radius[a] + q.radius[a] * d.radius[b]
        return most + 1e-9 * (q.norm[a] + q.radius[a]) * (d.norm[b] + d.radius[b]) + 1e-6

    def _worst(self, a: np.ndarray) -> np.ndarray:
        """The smallest k-th score of the queries below each of the nodes a."""
        t, kth = self.tree, self.score[:, -1]
        return np.array([kth[t.low[v] : t.high[v]].min() for v in range(len(t.low))])[a]

    def meet(self, ids: np.ndarray, vectors: np.ndarray, tree: Tree | None = None) -> None:
        """Walk down pairs of nodes level by level, dropping those below bound; then leaves, the most promising first."""
        q, d = self.tree, tree or cover_tree(vectors)
        ids, y = ids[d.order], vectors[d.order]
        a, b = np.zeros(1, np.int64), np.zeros(1, np.int64)
        leaves: list[tuple[np.ndarray, np.ndarray]] = []
        while len(a):
            end = (q.count[a] == 0) & (d.count[b] == 0)
            leaves.append((a[end], b[end]))
            a, b = a[~end], b[~end]
            down = (d.count[b] > 0) & ((q.count[a] == 0) | (d.radius[b] >= q.radius[a]))  # split data or queries
            n = np.where(down, d.count[b], q.count[a])
            step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            a2, b2, down = np.repeat(a, n), np.repeat(b, n), np.repeat(down, n)
            a, b = np.where(down, a2, q.first[a2] + step), np.where(down, d.first[b2] + step, b2)
            if len(a):
                keep = self._bounds(d, a, b) >= self._worst(a)
                a, b = a[keep], b[keep]
        a, b = (np.concatenate(x) for x in zip(*leaves))
        if not len(a):
            return
        bound = self._bounds(d, a, b)
        order = np.lexsort((-bound, a))
        a, b, bound = a[order], b[order], bound[order]
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(a)) + 1, [len(a)]])
        for x, z in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            v, width = a[x], 1
            lo, hi = q.low[v], q.high[v]
            while x < z and bound[x] >= self.score[lo:hi, -1].min():
                part = b[x : min(z, x + width)]
                part = part[bound[x : x + len(part)] >= self.score[lo:hi, -1].min()]
                # Each query's own bound is tighter than that of all its leaf's queries.
                own = self.x[lo:hi] @ d.centre[part].T + self.length[lo:hi, None] * d.radius[part]
                part = part[(own + 1e-9 * np.abs(own) + 1e-6 >= self.score[lo:hi, -1:]).any(0)]
                if not len(part):
                    x, width = x + width, min(2 * width, 8)
                    continue
                at = np.concatenate([np.arange(d.low[p], d.high[p]) for p in part])
                self._compare(lo, hi, ids[at], y[at])
                x, width = x + width, min(2 * width, 8)

    def _compare(self, lo: int, hi: int, ids: np.ndarray, y: np.ndarray) -> None:
        self.compared += (hi - lo) * len(ids)
        s = self.x[lo:hi] @ y.T
        s[(self.ids[lo:hi, None] == ids[None, :]) & (ids[None, :] != _LAST)] = -np.inf
        rows, cols = np.nonzero(s >= self.score[lo:hi, -1:])
        if not len(rows):
            return
        # Newcomers and the best so far of the rows that gain, ranked together.
        gain = np.unique(rows)
        row = np.concatenate([rows, np.repeat(gain, self.k)])
        score = np.concatenate([s[rows, cols], self.score[lo + gain].ravel()])
        name = np.concatenate([ids[cols], self.name[lo + gain].ravel()])
        order = np.lexsort((name, -score, row))
        row = row[order]
        start = np.searchsorted(row, gain)
        best = order[start[:, None] + np.arange(self.k)]
        self.score[lo + gain], self.name[lo + gain] = score[best], name[best]


_BLOCK = "block long, dims int, ids binary, vecs binary, tree binary, centre array<double>, radius double"
_STATE = "dims int, qb long, ids binary, scores binary, names binary, worst double, compared long"


def _nearest(pivots):
    """Rows (.., dims, v) with the cell of the nearest pivot."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, cell = batch.column("dims").to_numpy(), np.zeros(batch.num_rows, np.int64)
            for n in np.unique(dims):
                if n:
                    p, rows = pivots.value[int(n)], np.flatnonzero(dims == n)
                    for part in np.array_split(rows, len(rows) // 4096 + 1):
                        v = batch.column("v").take(pa.array(part))
                        x = v.flatten().to_numpy().reshape(len(part), n)
                        cell[part] = ((p * p).sum(1)[None, :] - 2 * (x @ p.T)).argmin(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], [*batch.schema.names, "cell"])

    return run


def _vectors(row: dict, ids: str = "ids", vecs: str = "vecs", tree: str = "tree") -> tuple[np.ndarray, np.ndarray, Tree]:
    names = np.frombuffer(row[ids], np.int64)
    x = np.frombuffer(row[vecs], np.float64).reshape(len(names), row["dims"])
    return names, x, unpacked(row[tree], x)


def _walk(k: int):
    """A block of queries (one row, with what it has found where it has met others) against some blocks of data."""

    def run(key, asks, data):
        if not (asks.num_rows and data.num_rows):
            return pa.table({"dims": pa.array([], pa.int32()), "qb": pa.array([], pa.int64()), **{c: pa.array([], pa.binary()) for c in ("ids", "scores", "names")}, "worst": pa.array([], pa.float64()), "compared": pa.array([], pa.int64())})
        q = asks.to_pylist()[0]
        s = Search(*_vectors(q)[:2], k, _vectors(q)[2])
        if q["scores"] is not None:
            s.score, s.name = np.frombuffer(q["scores"], np.float64).reshape(-1, k).copy(), np.frombuffer(q["names"], np.int64).reshape(-1, k).copy()
        for i in range(data.num_rows):  # one block at a time as Python objects
            s.meet(*_vectors(data.slice(i, 1).to_pylist()[0]))
        return pa.table({"dims": pa.array([q["dims"]], pa.int32()), "qb": pa.array([q["qb"]], pa.int64()), "ids": pa.array([s.ids.tobytes()], pa.binary()), "scores": pa.array([s.score.tobytes()], pa.binary()), "names": pa.array([s.name.tobytes()], pa.binary()), "worst": [float(s.score[:, -1].min())], "compared": pa.array([s.compared], pa.int64())})

    return run


def _found(k: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, scores, names in zip(*(batch.column(c).to_pylist() for c in ("ids", "scores", "names"))):
                q, score, name = np.frombuffer(ids, np.int64), np.frombuffer(scores, np.float64).reshape(-1, k), np.frombuffer(names, np.int64).reshape(-1, k)
                got = np.isfinite(score)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(q, got.sum(1))), pa.array(name[got], mask=name[got] == _LAST), pa.array(score[got].astype(np.int64))], ["query_id", "vec_id", "score"])

    return run


def _packed(key, rows):
    """A block as one row: ids and vectors as bytes in the order of their tree, of equal vectors only as many smallest ids as can count."""
    block, dims, keep, leaf = (x.as_py() for x in key)
    ids = rows.column("vec_id").fill_null(_LAST).to_numpy()
    x = rows.column("v").combine_chunks().flatten().to_numpy().reshape(len(ids), dims) if dims else np.zeros((len(ids), 0))
    order = np.argsort(ids, kind="stable")
    ids, x = ids[order], np.ascontiguousarray(x[order])
    if keep and dims:
        _, inv = np.unique(x.view(np.dtype((np.void, 8 * dims))).ravel(), return_inverse=True)
        by = np.argsort(inv, kind="stable")
        starts = np.concatenate([[0], np.flatnonzero(np.diff(inv[by])) + 1])
        nth = np.arange(len(by)) - np.repeat(starts, np.diff(np.append(starts, len(by))))
        ids, x = ids[np.sort(by[nth < keep])], x[np.sort(by[nth < keep])]
    t = cover_tree(x, leaf)
    return pa.table({
        "block": pa.array([block], pa.int64()), "dims": pa.array([dims], pa.int32()), "ids": pa.array([ids[t.order].tobytes()], pa.binary()), "vecs": pa.array([x[t.order].tobytes()], pa.binary()),
        "tree": pa.array([t.packed()], pa.binary()), "centre": pa.array([t.centre[0].tolist()], pa.list_(pa.float64())), "radius": pa.array([float(t.radius[0])], pa.float64()),
    })


def _searched(vectors: DataFrame, is_query: Column, k: int, id_col: str, vector_col: str, scale: float) -> list[DataFrame]:
    """What blocks of queries have found, as packed states: at first, and against the other blocks that could matter."""
    spark = vectors.sparkSession
    x = F.col(f"`{vector_col}`")
    fine = x.isNotNull() & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    ints = F.transform(x, lambda c: F.floor(F.lit(float(scale)) * c.cast("double")).cast("double"))
    d = vectors.filter(fine).select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), ints.alias("v"), is_query.alias("asks")).withColumn("dims", F.size("v"))
    d = written(d.dropDuplicates(["vec_id", "v"]), "vectors")
    # Pivots: the vectors smallest by hash, a bounded number of each dimension (there are as many dimensions as kinds of vectors).
    by, order = F.xxhash64(F.lit("pivot"), "vec_id", "v"), ["dims", "h", "vec_id"]
    some = {r.dims: min(PIVOTS, -(-r.n // DATA_BLOCK)) for r in d.groupBy("dims").agg(F.count(F.lit(1)).alias("n")).collect()}
    pivots: dict[int, np.ndarray] = {}
    for dims, n in some.items():
        rows = d.filter(F.col("dims") == dims).withColumn("h", by).orderBy(*order).limit(n).select("v").collect()
        pivots[dims] = np.array([r.v for r in rows], np.float64).reshape(len(rows), dims)
    near = spark.sparkContext.broadcast(pivots)
    d = written(d.mapInArrow(tidy(_nearest(near)), "vec_id long, v array<double>, asks boolean, dims int, cell long"), "vector-cells")

    def packed(rows: DataFrame, per: int, keep: int, leaf: int, name: str) -> DataFrame:
        cells = written(rows.groupBy("dims", "cell").agg(F.ceil(F.count(F.lit(1)) / per).alias("parts")), f"{name}-cells")
        rows = small_join(rows, cells, ["dims", "cell"]).withColumn("block", F.col("cell") * (1 << 32) + F.pmod(F.xxhash64("vec_id", "v"), F.col("parts")))
        rows = rows.select("block", "dims", F.lit(keep).alias("keep"), F.lit(leaf).alias("leaf"), "vec_id", "v")
        return written(rows.groupBy("block", "dims", "keep", "leaf").applyInArrow(_packed, _BLOCK), name)

    data = packed(d, DATA_BLOCK, k + 1, LEAF, "vector-blocks")
    asks = packed(d.filter("asks and vec_id is not null"), QUERY_BLOCK, 0, QUERY_LEAF, "query-blocks").withColumnRenamed("block", "qb")
    # Roots: centres and radii of data blocks, dealt to each block of queries, numbered from 0.
    roots = asks.select("dims", "qb", F.col("centre").alias("qc"), F.col("radius").alias("qr"))
    roots = written(roots.withColumn("no", F.row_number().over(W.partitionBy("dims").orderBy("qb")) - 1), "query-roots")
    many = roots.groupBy("dims").agg(F.max("no").alias("last"))
    pairs = data.select("dims", "block", "centre", "radius").join(F.broadcast(many), "dims").select("dims", "block", "centre", "radius", F.explode(F.sequence(F.lit(0), "last")).alias("no"))
    pairs = pairs.join(roots, ["dims", "no"])
    dot, norm = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x), lambda a: F.sqrt(dot(a, a))
    most = dot("qc", "centre") + norm("qc") * F.col("radius") + norm("centre") * F.col("qr") + F.col("qr") * F.col("radius")
    room = 1e-9 * (norm("qc") + F.col("qr")) * (norm("centre") + F.col("radius")) + 1e-6
    pairs = pairs.select("dims", "qb", "block", (most + room).alias("bound"), dot("qc", "centre").alias("promise"))
    pairs = pairs.withColumn("nth", F.row_number().over(W.partitionBy("dims", "qb").orderBy(F.desc("promise"), "block")) - 1)
    pairs = written(pairs.select("dims", "qb", "block", "bound", "nth"), "block-pairs")

    def met(asking: DataFrame, pairs: DataFrame, name: str) -> DataFrame:
        by = ["dims", "qb", "batch"]
        shipped = pairs.join(data, ["dims", "block"]).select(*by, "ids", "vecs", "tree")
        q = asking.join(pairs.select(*by).distinct(), ["dims", "qb"]).select(*by, "ids", "vecs", "tree", "scores", "names")
        n = max(1, min(pairs.select(*by).distinct().count(), 4096))
        deal = lambda x: x.toDF(*x.columns).repartition(n, *by).groupBy(*by)
        return written(deal(q).cogroup(deal(shipped)).applyInArrow(_walk(k), _STATE), name)

    sooner = pairs.filter(F.col("nth") < SOONER).withColumn("batch", F.lit(0).cast("long"))
    one = met(asks.withColumns({"scores": F.lit(None).cast("binary"), "names": F.lit(None).cast("binary")}), sooner, "search-sooner")
    later = pairs.filter(F.col("nth") >= SOONER).join(one.select("dims", "qb", "worst"), ["dims", "qb"]).filter("bound >= worst")
    later = written(later.select("dims", "qb", "block", F.floor(F.row_number().over(W.partitionBy("dims", "qb").orderBy("nth")) / TOGETHER).alias("batch")), "block-pairs-left")
    two = met(asks.join(one.select("dims", "qb", "scores", "names"), ["dims", "qb"]), later, "search-later")
    return [one, two]


def top_k(vectors: DataFrame, is_query: Column, *, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 256.0) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k largest inner products of floor(scale * x), ties to smaller ids.

    Candidates are all rows but those with the query's id.  Vectors that are null or hold a null or
    non-finite component take no part; vectors of different dimension do not meet.  Repeated rows count
    once.  A null id can be found (after equal scores) but does not ask.  With fewer than k candidates all
    are returned; an empty table gives an empty result.  Other columns are not read, whatever their names.
    Blocks of queries meet blocks of data, packed: pairs of vectors are never rows.  Vectors of many
    dimensions only make a block larger.
    """
    states = _searched(vectors, is_query, k, id_col, vector_col, scale)
    kind = "query_id long, vec_id long, score long"
    part = states[0].unionByName(states[1]).select("ids", "scores", "names").mapInArrow(tidy(_found(k)), kind)
    best = W.partitionBy("query_id").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return part.dropDuplicates().withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def compared_share(vectors: DataFrame, is_query: Column, *, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 256.0) -> float:
    """The part of all pairs of a query and a vector whose score was computed: what the bounds leave over."""
    states = _searched(vectors, is_query, k, id_col, vector_col, scale)
    done = states[0].unionByName(states[1]).agg(F.sum("compared")).first()[0] or 0
    n = vectors.agg(F.count(F.lit(1)), F.count_if(is_query)).first()
    return done / max(1, n[0] * n[1])
