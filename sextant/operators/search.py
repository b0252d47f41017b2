"""Exact top-k over a table of vectors, thresholds, reranking, citations."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sextant.errors import ConfigError
from sextant.functions.tokens import token_set, truncate
from sextant.tables import written

#: Bytes of question vectors that travel to every task.  Beyond that, a cell of the grid holds CELL bytes of vectors and of
#: questions, and up to LARGE where more than CELLS of them would be needed.  Questions and vectors multiplied at a time.
ASKED, CELL, LARGE, CELLS, BLOCK, WIDE = 64 << 20, 16 << 20, 64 << 20, 256, 512, 4096
#: Questions below which no look at their size is needed.
FIRST = 1024
#: Ids of results up to which they travel to the table that holds the contents.
FETCHED = 500_000


def key_column(key: str) -> str:
    """The column that holds a metadata key where a store has one for it."""
    return f"_key_{key}"


def metadata_filter(where: Mapping[str, object] | None, columns: Iterable[str] | Mapping[str, str], map_col: str = "metadata") -> Column:
    """All of the equalities: on a column of that name where there is one, else on a metadata key.

    columns: names, or names with their types (``dict(df.dtypes)``).  Tests of columns reach the scan; so do tests of
    keys for which a store has columns, if the types are given, and the map decides among what they leave.
    """
    kinds = columns if isinstance(columns, Mapping) else dict.fromkeys(columns)

    def test(k: str, v: object) -> Column:
        if k in kinds:
            return F.col(k) == F.lit(v)
        exact, kind = F.col(map_col)[k] == F.lit(str(v)), kinds.get(key_column(k))
        # A value that is none of the column's type stands there as null, so null is equal to null here.
        return F.col(f"`{key_column(k)}`").eqNullSafe(F.lit(str(v)).try_cast(kind)) & exact if kind else exact

    return reduce(lambda a, b: a & b, [test(k, v) for k, v in (where or {}).items()], F.lit(True))


def _matrix(col: pa.Array) -> np.ndarray:
    flat = col.flatten()
    return np.array(flat.to_numpy(zero_copy_only=False), np.float64).reshape(len(col), len(flat) // max(1, len(col)))


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.sqrt((x * x).sum(1, keepdims=True))
    return x / np.where(n > 0, n, 1.0)


def _scores(metric: str, q: np.ndarray, v: np.ndarray, dot: np.ndarray) -> np.ndarray:
    """Scores from inner products of questions and vectors (of unit length for cosine), which are given in shapes that meet."""
    if metric == "cosine":
        s = dot
    elif metric == "l2":
        s = 1 / (1 + np.maximum((q * q).sum(-1) + (v * v).sum(-1) - 2 * dot, 0))
    else:
        s = dot - 1
    # Twelve places: what two ways of adding up may differ by is no order.
    return np.round(np.clip(s, 0.0, 1.0), 12) + 0.0


class _Best:
    """The k best (score, then smaller id) of each question of a block among the vectors seen so far."""

    def __init__(self, q: np.ndarray, k: int, metric: str):
        self.asked, self.k, self.metric = q, k, metric
        self.short = q.astype(np.float32)
        self.q, self.s, self.at = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
        self.ids: pa.Array | None = None
        self.floor = np.zeros(len(q))  # the worst score that is still among the best of a question that has k

    def look(self, v: np.ndarray, short: np.ndarray, ids: pa.Array) -> None:
        """Vectors of some ids, which are sorted; short: the same vectors in single precision."""
        # Questions that have k matches above 0 look in single precision first, which is off by less than the slack.
        quick = self.floor > 0 if self.metric == "cosine" else np.zeros(len(self.floor), bool)
        some, rest = np.flatnonzero(quick), np.flatnonzero(~quick)
        found = []
        if len(some):
            least = self.floor[some] - (v.shape[1] + 8) * 2.0**-23
            mine = self.short if len(some) == len(quick) else self.short[some]
            row, col = np.divmod(np.flatnonzero(mine @ short.T >= least.astype(np.float32)[:, None]), len(v))
            dense = np.bincount(row, minlength=len(some)) > 64 + 4 * self.k
            if dense.any():  # vectors much alike: all scores of these questions
                rest, row, col = np.concatenate([rest, some[dense]]), row[~dense[row]], col[~dense[row]]
            row, step = some[row], max(1, BLOCK * WIDE // v.shape[1])
            s = np.empty(len(row))
            for i in range(0, len(row), step):
                r, c = row[i : i + step], col[i : i + step]
                s[i : i + step] = _scores(self.metric, self.asked[r], v[c], np.einsum("ij,ij->i", self.asked[r], v[c]))
            keep = s >= self.floor[row]
            found.append((row[keep], col[keep], s[keep]))
        if len(rest):
            found.append(self._every(rest, v))
        row, col, s = (np.concatenate(x) for x in zip(*found))
        if len(row):
            self._add(row, col, s, ids)

    def _every(self, rows: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(question, vector, score) of what may be among the best of some questions, from all their scores."""
        k, q = self.k, self.asked[rows]
        s = _scores(self.metric, q[:, None, :], v[None, :, :], q @ v.T)
        floor = self.floor[rows]
        s = np.where(np.isnan(s), -1.0, s)  # no number is no match
        keep = s >= floor[:, None]
        if s.shape[1] > k and np.count_nonzero(keep) > 4 * k * len(s):
            floor = np.maximum(floor, np.partition(s, s.shape[1] - k, axis=1)[:, -k])
            keep = s >= floor[:, None]
        many = np.flatnonzero(keep.sum(1) > 4 * k)
        if len(many):  # ties at the floor: the first ids of them do
            above, tie = s[many] > floor[many, None], s[many] == floor[many, None]
            keep[many] = above | (tie & (np.cumsum(tie, 1) <= k))
        row, col = np.nonzero(keep)
        return rows[row], col, s[row, col]

    def _add(self, row: np.ndarray, col: np.ndarray, s: np.ndarray, ids: pa.Array) -> None:
        used, col = np.unique(col, return_inverse=True)
        new = ids.take(pa.array(used))
        q, score, at = np.concatenate([self.q, row]), np.concatenate([self.s, s]), np.concatenate([self.at, col + (0 if self.ids is None else len(self.ids))])
        every = new if self.ids is None else pa.concat_arrays([self.ids, new])
        rank = np.empty(len(every), np.int64)
        rank[pc.sort_indices(every).to_numpy()] = np.arange(len(every))
        order = np.lexsort((rank[at], -score, q))
        place = np.arange(len(q)) - np.searchsorted(q[order], q[order], "left")
        order, last = order[place < self.k], order[place == self.k - 1]
        self.floor[q[last]] = score[last]
        used, at = np.unique(at[order], return_inverse=True)
        self.q, self.s, self.at, self.ids = q[order], score[order], at, every.take(pa.array(used))


def _steps(n: int) -> Iterator[tuple[int, int]]:
    """(first, number) of the vectors that are looked at together."""
    i, step = 0, WIDE // 32
    while i < n:
        yield i, step
        i, step = i + step, min(WIDE, 4 * step)


def _search(asked: list[np.ndarray], batches: Iterable[tuple[pa.Array, pa.Array]], k: int, metric: str) -> list[tuple[int, _Best]]:
    """(first question, its block's best) of batches of (ids, vectors); vectors of another size than a question's are no match."""
    ready = _unit if metric == "cosine" else lambda x: x
    blocks, at = [], 0
    for q in asked:
        blocks += [(at + j, _Best(ready(q[j : j + BLOCK]), k, metric)) for j in range(0, len(q), BLOCK)]
        at += len(q)
    for ids, vectors in batches:
        sizes = pc.list_value_length(vectors).to_numpy(zero_copy_only=False)
        for d in np.unique(sizes):
            mine = [b for _, b in blocks if b.asked.shape[1] == d]
            part = np.flatnonzero(sizes == d) if mine else ()
            # A few vectors first: with k matches of a question known, the rest can be looked at in single precision.
            for i, n in _steps(len(part)):
                some = pa.array(part[i : i + n])
                order = pc.sort_indices(ids.take(some))
                names, v = ids.take(some).take(order), ready(_matrix(vectors.take(some).take(order)))
                short = v.astype(np.float32)
                for b in mine:
                    b.look(v, short, names)
    return blocks


def _by_size(vectors: pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
    """(places, matrices): questions of one size of vector together."""
    sizes = pc.list_value_length(vectors).to_numpy(zero_copy_only=False)
    order = np.argsort(sizes, kind="stable")
    cuts = np.flatnonzero(np.diff(sizes[order])) + 1
    return order, [_matrix(vectors.take(pa.array(p))) for p in np.split(order, cuts) if len(p)]


def _few(v: DataFrame, q: pa.Table, k: int, metric: str, kind: str) -> DataFrame:
    """Questions that fit into every task: the vectors stay where they are."""
    share = v.sparkSession.sparkContext.broadcast(_questions(q))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, asked = share.value
        yield from _rows(names, _search(asked, ((b.column(0), b.column(1)) for b in batches if b.num_rows), k, metric))

    return v.mapInArrow(run, kind)


def _questions(q: pa.Table) -> tuple[pa.Table, list[np.ndarray]]:
    """(names, matrices): questions by the size of their vectors, each once."""
    q = q.append_column("_at", pa.array(np.arange(q.num_rows)))
    q = q.take(q.group_by(["question_id", "_h"]).aggregate([("_at", "min")])["_at_min"].combine_chunks()).combine_chunks()
    order, asked = _by_size(q["_e"].combine_chunks())
    return q.select(["question_id", "_h"]).take(pa.array(order)).combine_chunks(), asked


def _rows(names: pa.Table, blocks: list[tuple[int, _Best]]) -> Iterator[pa.RecordBatch]:
    for first, best in blocks:
        if best.ids is not None:
            who = names.take(pa.array(best.q + first))
            out = pa.table([*who.columns, best.ids.take(pa.array(best.at)), pa.array(best.s)], ["question_id", "_h", "chunk_id", "score"])
            yield from out.combine_chunks().to_batches(max_chunksize=10_000)


def _many(v: DataFrame, q: DataFrame, k: int, metric: str, kind: str, asked_bytes: int, cell: int) -> DataFrame:
    """A grid of cells, each a share of the vectors and a share of the questions, joined block by block in one task.

    Vectors are dealt by hash into as many groups as their bytes need and sent to each group of questions, and
    the other way round, so a cell holds ``cell`` bytes of either and nothing passes through the driver.  Where that
    takes more than CELLS cells they are larger, up to LARGE: each row is sent to a cell of each row or column.
    """
    size = 4 * v.agg(F.coalesce(F.sum(F.size("_v").cast("long")), F.lit(0))).first()[0]
    cell = max(cell, min(LARGE, math.isqrt(size * asked_bytes // CELLS)))
    rows, columns = max(1, math.ceil(size / cell)), max(1, math.ceil(asked_bytes / cell))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    # Equal rows stand in many partitions, so no group gets all of them.
    left = v.withColumn("_row", F.pmod(F.xxhash64("chunk_id", "_v", F.spark_partition_id()), F.lit(rows)).cast("int")).withColumn("_column", every(columns))
    right = q.withColumn("_column", F.pmod(F.xxhash64("question_id", "_e", F.spark_partition_id()), F.lit(columns)).cast("int")).withColumn("_row", every(rows))

    def run(vectors: pa.Table, questions: pa.Table) -> pa.Table:
        names, asked = _questions(questions)
        best = _search(asked, ((b["chunk_id"], b["_v"]) for b in vectors.to_batches(max_chunksize=WIDE)), k, metric)
        schema = pa.schema([*names.schema, ("chunk_id", vectors["chunk_id"].type), ("score", pa.float64())])
        return pa.Table.from_batches(_rows(names, best), schema)

    return left.groupBy("_row", "_column").cogroup(right.groupBy("_row", "_column")).applyInArrow(run, kind)


def top_k(vectors: DataFrame, questions: DataFrame, k: int = 5, metric: str = "cosine", where: Mapping[str, object] | None = None, id_col: str = "id", vector: str = "embedding", keep: Sequence[str] = (), asked: int = ASKED, cell: int = CELL) -> DataFrame:
    """question_id, rank, chunk_id, score (six places), and kept columns: the k best of the vectors for each question, ties to smaller ids.

    Question vectors of up to ``asked`` bytes go to every task and no vector moves; more of them meet the vectors in
    a grid of cells of bounded size, and none come to the driver; of equal question vectors one is asked.  A task hands on its best k of each
    question, ids and scores alone; kept columns are fetched by id for the rows that are left in the end, so ids are
    unique (of rows with equal ids any one's columns).  Filters stand before the search and reach the scan.
    Null vectors take no part, a vector of another size than the question's is no match, nor is one that
    holds no number.  A question that is there twice is asked once; an id with several vectors gets k for each.  Ids
    may be of any type that sorts.
    """
    if k <= 0:
        raise ConfigError("k is positive")
    some = vectors.filter(metadata_filter(where, dict(vectors.dtypes)))
    q = questions.filter(F.col("embedding").isNotNull()).select("question_id", F.col("embedding").alias("_e")).withColumn("_h", F.xxhash64("_e"))
    v = some.filter(F.col(vector).isNotNull()).select(F.col(id_col).alias("chunk_id"), F.col(vector).alias("_v"))
    kind = ", ".join([f"question_id {q.schema['question_id'].dataType.simpleString()}", "_h long", f"chunk_id {v.schema['chunk_id'].dataType.simpleString()}", "score double"])
    first, who = q.limit(FIRST).toArrow(), None
    if first.num_rows < FIRST:
        found = _few(v, first, k, metric, kind)
    else:
        every = written(q.dropDuplicates(["question_id", "_h"]), "search-questions")
        one = written(every.groupBy("_e").agg(F.min("question_id").alias("question_id"), F.min("_h").alias("_h")), "search-asked").select(*q.columns)
        n, size = one.agg(F.count(F.lit(1)), F.sum(8 * F.size("_e").cast("long") + 16)).first()
        if n < every.count():
            who = every.select("question_id", "_e").join(one.select("_e", F.col("question_id").alias("_one"), "_h"), "_e").drop("_e")
        found = _few(v, one.toArrow(), k, metric, kind) if size <= asked else _many(v, one, k, metric, kind, size, cell)
    best = W.partitionBy("question_id", "_h").orderBy(F.desc("score"), "chunk_id")
    found = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).withColumn("score", F.round("score", 6))
    if who is not None:  # what was found for a vector is found for all that asked it
        f = found.withColumnsRenamed({"question_id": "_first", "_h": "_g"})
        found = f.join(who, f["_first"].eqNullSafe(who["_one"]) & (f["_g"] == who["_h"]))
    found = found.select("question_id", "rank", "chunk_id", "score")
    return fetched(found, some, id_col, keep) if keep else found


def _packed(df: DataFrame, by: str, name: str, size: int) -> DataFrame:
    """Rows (name, embedding) of each value of by in blocks of about ``size``."""
    most = df.groupBy(by).count().agg(F.max("count")).first()[0] or 0
    share = F.pmod(F.xxhash64(name, "embedding", F.spark_partition_id()), F.lit(max(1, math.ceil(most / size))))
    return df.groupBy(by, share.alias("_share")).agg(F.collect_list(F.struct(name, "embedding")).alias(f"_{name}")).drop("_share")


def _whole(vectors: pa.Array) -> np.ndarray:
    """Sizes of vectors; -1: null, or with a null in it."""
    sizes = pc.fill_null(pc.list_value_length(vectors), -1).to_numpy(zero_copy_only=False).copy()
    parents, empty = pc.list_parent_indices(vectors).to_numpy(), pc.is_null(vectors.flatten()).to_numpy(zero_copy_only=False)
    sizes[parents[empty]] = -1
    return sizes


def _block_distances(q: pa.StructArray, v: pa.StructArray) -> Iterator[pa.RecordBatch]:
    (asked, a), (names, b) = q.flatten(), v.flatten()
    sizes, mine = _whole(a), _whole(b)
    parts = {d: (part, m := _matrix(b.take(pa.array(part))), np.sqrt((m * m).sum(1))) for d in np.unique(sizes) if d >= 0 and len(part := np.flatnonzero(mine == d))}
    rows = max(1, (1 << 16) // max(1, len(names)))
    for i in range(0, len(asked), rows):
        n = min(rows, len(asked) - i)
        out, known = np.zeros((3, n, len(names))), np.zeros((n, len(names)), bool)
        for j in range(n):
            if sizes[i + j] in parts:
                part, m, norm = parts[sizes[i + j]]
                x = _matrix(a.slice(i + j, 1))[0]
                dot, away = m @ x, m - x
                with np.errstate(all="ignore"):
                    out[:, j, part] = dot, 1 - dot / (np.sqrt(x @ x) * norm), np.einsum("ij,ij->i", away, away)
                known[j, part] = True
        at = pa.array(np.repeat(np.arange(i, i + n), len(names))), pa.array(np.tile(np.arange(len(names)), n))
        yield pa.RecordBatch.from_arrays([asked.take(at[0]), names.take(at[1]), *[pa.array(x.ravel(), mask=~known.ravel()) for x in out]], ["question_id", "chunk_id", "dot", "cosine", "l2"])


def distances(vectors: DataFrame, questions: DataFrame, by: str, id_col: str = "id") -> DataFrame:
    """question_id, chunk_id, dot, cosine (1 - similarity), l2 (squared): every question with every vector of the same ``by``.

    Blocks of vectors meet blocks of questions, so a row that is joined stands for many pairs, and the pairs are made
    where they are used.  Vectors of another size, null, or with nulls have no distance; that of a zero vector is no number.
    """
    q = _packed(questions.select(by, "question_id", "embedding"), by, "question_id", BLOCK // 4)
    v = _packed(vectors.select(by, F.col(id_col).alias("chunk_id"), "embedding"), by, "chunk_id", BLOCK)
    kind = f"question_id {questions.schema['question_id'].dataType.simpleString()}, chunk_id {vectors.schema[id_col].dataType.simpleString()}, dot double, cosine double, l2 double"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield from _block_distances(*[c.slice(i, 1).flatten() for c in batch.columns])

    # Few values of by would leave the pairs to as many tasks.
    pairs = q.join(v, by).select("_question_id", "_chunk_id")
    return pairs.repartition(4 * q.sparkSession.sparkContext.defaultParallelism).mapInArrow(run, kind)


def fetched(found: DataFrame, rows: DataFrame, id_col: str, keep: Sequence[str]) -> DataFrame:
    """Results with columns of the rows that they name: the ids travel to the rows, if they are few, not the rows to them."""
    found = written(found, "search-results")
    ids = found.select(F.col("chunk_id").alias("_id")).distinct()
    near = F.broadcast(ids) if found.count() <= FETCHED else ids
    mine = rows.select(F.col(id_col).alias("_id"), F.struct(*keep).alias("_k")).join(near, "_id", "left_semi").groupBy("_id").agg(F.first("_k").alias("_k"))
    return found.join(mine, F.col("chunk_id") == F.col("_id"), "left").select(*found.columns, *[F.col(f"_k.{c}").alias(c) for c in keep])


def at_least(results: DataFrame, score: float) -> DataFrame:
    """Results of at least that score, as they stand (after reranking, if they were reranked)."""
    if not 0 <= score <= 1:
        raise ConfigError("a score lies in 0 to 1")
    return results.filter(F.col("score") >= score)


def rerank(results: DataFrame, score: Column | None = None, question: str = "question", content: str = "content") -> DataFrame:
    """Results in the order of a pair score, brought to 0 to 1 within each question (all equal: 1).

    The default pair score is the Jaccard overlap of tokens; any Column of the row will do.
    """
    if score is None:
        a, b = token_set(F.col(question)), token_set(F.col(content))
        score = F.size(F.array_intersect(a, b)) / F.greatest(F.size(F.array_union(a, b)), F.lit(1))
    per = W.partitionBy("question_id")
    d = results.withColumn("_s", score.cast("double")).withColumn("_lo", F.min("_s").over(per)).withColumn("_hi", F.max("_s").over(per))
    span = F.col("_hi") - F.col("_lo")
    d = d.withColumn("score", F.round(F.when(span > 0, (F.col("_s") - F.col("_lo")) / span).otherwise(1.0), 6))
    return d.withColumn("rank", F.row_number().over(per.orderBy(F.desc("_s"), "rank"))).drop("_s", "_lo", "_hi")


def citations(results: DataFrame) -> DataFrame:
    """The first result of each chunk of a question, with the first source that is not empty: result, chunk, 'unknown'."""
    first = W.partitionBy("question_id", "chunk_id").orderBy("rank")
    have = [F.nullif(F.col(c), F.lit("")) for c in ("result_source", "source") if c in results.columns]
    d = results.withColumn("_n", F.row_number().over(first)).filter("_n = 1")
    return d.select("question_id", "rank", "chunk_id", F.coalesce(*have, F.lit("unknown")).alias("source"), F.col("content").alias("text"), "score")


def source_name(c: Column) -> Column:
    """The last component of a path with either separator."""
    return F.regexp_extract(F.regexp_replace(c, r"[\\/]+$", ""), r"[^\\/]+$", 0)


def format_citation(source: Column, chunk_id: Column, text: Column, score: Column, style: str = "default") -> Column:
    """A citation as text; styles default, mla, apa."""
    style, name, two = style.lower(), source_name(source), F.format_string("%.2f", score)
    if style == "mla":
        return F.format_string('"%s" (%s, %s).', truncate(text, 120), name, chunk_id)
    if style == "apa":
        return F.format_string('%s (%s, relevance: %s). "%s"', name, chunk_id, two, truncate(text, 120))
    if style == "default":
        return F.format_string('[%s] (score: %s) %s — "%s"', chunk_id, two, name, truncate(text, 100))
    raise ConfigError(f"no citation style {style!r}; known: default, mla, apa")
