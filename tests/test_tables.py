"""Tables that grow by runs, the cache on them, search for many questions, and questions that fail alone."""

import math
import os
import random
import re
import time
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sextant import tables
from sextant.errors import AnswerError, Refused
from sextant.operators import embedding as E
from sextant.operators import remote
from sextant.operators import search as S
from sextant.operators.store import VectorStore, frequent_keys
from sextant.plans import evaluate, workflow


def plan(df) -> str:
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def scanned(df) -> int:
    """Files that a run of the frame opened."""
    return df.select(F.input_file_name().alias("f")).distinct().count()


# Runs


def test_runs_keep_the_newest_and_few(spark, tmp_path):
    s = VectorStore(spark, f"file://{tmp_path}/s", columns="id string, n int, collection string", buckets=2)
    r, want, runs = random.Random(2), {}, []
    for i in range(12):
        some = [(f"k{r.randrange(60)}", i * 10 + j) for j in range(4)]
        s.add(spark.createDataFrame(some, "id string, n int"))
        want |= dict(some)
        if i % 5 == 4:
            gone = [k for k in want if r.random() < 0.3] + ["none"]
            assert s.delete(spark.createDataFrame([(k,) for k in gone], "id string")) == len(gone) - 1
            for k in gone[:-1]:
                del want[k]
        runs.append(len(s._runs("default").current()))
    assert {x.id: x.n for x in s.read().collect()} == want and s.count() == len(want)
    assert max(runs) <= 6
    s.compact()
    assert len(s._runs("default").current()) == 1 and {x.id: x.n for x in s.read().collect()} == want
    assert s._runs("default").table(s._runs("default").current()[0]).filter("_removed").count() == 0


def test_runs_write_little(spark, tmp_path, monkeypatch):
    """Bytes written grow with the rows times the logarithm of their number."""
    took = []
    plain = tables.Runs._write

    def counted(self, rows, run):
        plain(self, rows, run)
        took.append((run, self.table(run).count()))

    monkeypatch.setattr(tables.Runs, "_write", counted)
    s = VectorStore(spark, f"file://{tmp_path}/s", columns="id long, v array<double>, collection string", buckets=1)
    changes, each = 16, 200
    for i in range(changes):
        s.add(spark.range(i * each, (i + 1) * each).select("id", F.array(*[F.rand(i + j) for j in range(8)]).alias("v")))
    assert s.count() == changes * each
    assert sum(n for _, n in took) <= changes * each * (math.log2(changes) + 2)
    assert len(s._runs("default").current()) <= math.log2(changes) + 1


def test_half_a_run_is_not_there(spark, tmp_path):
    s = VectorStore(spark, f"file://{tmp_path}/s", columns="id string, n int, collection string")
    s.add(spark.createDataFrame([("a", 1)], "id string, n int"))
    os.makedirs(f"{tmp_path}/s/collection=default/run=2-2-8")
    Path(f"{tmp_path}/s/collection=default/run=2-2-8/part-0.parquet").write_bytes(b"half")
    assert s.count() == 1
    s.add(spark.createDataFrame([("b", 1)], "id string, n int"))
    assert {r.id for r in s.read().collect()} == {"a", "b"}


def test_get_opens_the_buckets_of_its_ids(spark, tmp_path):
    s = VectorStore(spark, f"file://{tmp_path}/s", columns="id string, n long, collection string", buckets=16)
    s.add(spark.range(2000).select(F.concat(F.lit("k"), "id").alias("id"), F.col("id").alias("n")))
    one = spark.createDataFrame([("k77",), ("none",), (None,)], "id string")
    assert [(r.id, r.n) for r in s.get(one).collect()] == [("k77", 77)]
    # The bucket of the id is all that is read: the other files may be gone.
    run = s._runs("default")
    mine = run.table(run.current()[0]).filter("id = 'k77'").select(F.input_file_name()).first()[0].rsplit("/", 1)[1]
    found = s.get(spark.createDataFrame([("k77",)], "id string"))
    for f in Path(f"{tmp_path}/s/collection=default").glob("run=*/part-*"):
        if f.name != mine:
            f.unlink()
    assert [r.n for r in found.collect()] == [77]


def test_a_large_run_does_not_move(spark, tmp_path):
    s = VectorStore(spark, f"file://{tmp_path}/s", columns="id long, n long, collection string", buckets=8)
    s.add(spark.range(50_000).select("id", F.col("id").alias("n")))
    s.add(spark.range(10).select("id", (-F.col("id")).alias("n")))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        said = plan(s.read())
        assert "Exchange" not in said and said.count("SelectedBucketsCount: 8 out of 8") >= 2
        assert s.read().agg(F.sum("n")).first()[0] == sum(range(10, 50_000)) - 45
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_repeated_ids_of_a_batch(spark, tmp_path):
    s = VectorStore(spark, f"file://{tmp_path}/s", columns="id string, n long, collection string")
    s.add(spark.range(30_000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("id"), F.col("id").alias("n")))
    assert s.count() == 20_001 and s.get(spark.createDataFrame([("hot",)], "id string")).first().n == 29_997


# Keys of the metadata


def test_metadata_keys_reach_the_scan(spark, tmp_path):
    s = VectorStore(spark, f"file://{tmp_path}/s", columns="id long, metadata map<string,string>, collection string", buckets=1)
    meta = F.create_map(F.lit("year"), (F.col("id") % 50 + 1950).cast("string"), F.lit("lang"), F.when(F.col("id") % 2 == 0, "en").otherwise("de"))
    rare = F.when(F.col("id") % 10 == 0, F.create_map(F.lit("rare"), F.lit("x"))).otherwise(F.create_map().cast("map<string,string>"))
    rows = spark.range(5000).select("id", F.map_concat(meta, rare).alias("metadata"))
    assert frequent_keys(rows) == {"lang": "string", "year": "bigint"}
    before = spark.conf.get("parquet.block.size", None)
    s.add(rows)
    assert s.keys() == {"lang": "string", "year": "bigint"}
    got = s.read(where={"year": 1960, "lang": "en"})
    said = plan(got)
    pushed = next(x for x in said.splitlines() if "PushedFilters" in x)
    assert "_key_year" in pushed and "1960" in pushed and "_key_lang" in pushed and before is None
    assert {r.id for r in got.collect()} == {i for i in range(5000) if i % 50 == 10}
    assert s.read(where={"rare": "x", "lang": "en"}).count() == 500 and s.read(where={"year": "01960"}).count() == 0 and s.read(where={"lang": 7}).count() == 0
    # Values that are no numbers in a column of numbers are found through the map.
    s.add(spark.createDataFrame([(9001, {"year": "about 1960", "lang": "en"}), (9002, None)], "id long, metadata map<string,string>"))
    assert [r.id for r in s.read(where={"year": "about 1960"}).collect()] == [9001] and s.count() == 5002


# The cache


def counting(folder):
    """A provider that leaves a line for each text it is asked for."""

    @F.arrow_udf("array<float>")
    def embed(x):
        import uuid

        import pyarrow as pa

        with open(f"{folder}/{uuid.uuid4().hex}", "w") as f:
            f.writelines(f"{t}\n" for t in x.to_pylist())
        return pa.array([None if t is None else [float(len(t)), 1.0] for t in x.to_pylist()], pa.list_(pa.float32()))

    return embed


def asked(folder) -> Counter:
    return Counter(t for f in Path(folder).iterdir() for t in f.read_text().split("\n") if t)


def test_cache_embeds_a_text_once(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()
    cache = E.EmbeddingCache(spark, f"file://{tmp_path}/cache", "m")
    rows = spark.createDataFrame([(i, None if i % 7 == 0 else f"t{i % 9}") for i in range(200)], "i int, content string").repartition(5)
    out = cache.embed(rows, counting(calls)).collect()
    assert asked(calls) == Counter({f"t{k}": 1 for k in range(9)})
    assert len(out) == 200 and all((r.embedding is None) == (r.content is None) and (r.content is None or list(r.embedding) == [2.0, 1.0]) for r in out)
    cache.embed(rows.unionByName(spark.createDataFrame([(1, "new")], rows.schema)), counting(calls)).collect()
    assert asked(calls) == Counter({f"t{k}": 1 for k in range(9)} | {"new": 1}) and cache.stats().first().entries == 10
    assert {r.text: r.known for r in cache.contains(spark.createDataFrame([("t1",), ("t99",)], "content string")).collect()} == {"t1": True, "t99": False}
    # Corrupt entries are missing ones, and the new ones take their place.
    bad = [("t1", None, 2), ("t2", [1.0], 2), ("t3", [1.0, None], 2)]
    cache.add(spark.createDataFrame(bad, "t string, vector array<float>, dimension int").select(E.cache_key(F.col("t"), "m").alias("key"), F.lit("m").alias("model"), "vector", "dimension"))
    assert cache.stats().first().entries == 7
    assert all(list(r.embedding) == [2.0, 1.0] for r in cache.embed(rows.filter("content is not null"), counting(calls)).collect())
    assert {t: n for t, n in asked(calls).items() if n > 1} == {"t1": 2, "t2": 2, "t3": 2} and cache.stats().first().entries == 10
    cache.clear()
    assert cache.stats().first().entries == 0


def test_cache_does_not_move_for_a_lookup(spark, tmp_path):
    cache = E.EmbeddingCache(spark, f"file://{tmp_path}/cache", "m", buckets=16)
    one = spark.range(20_000).select(E.cache_key(F.concat(F.lit("t"), "id"), "m").alias("key"), F.lit("m").alias("model"), F.array(F.lit(1.0).cast("float")).alias("vector"), F.lit(1).alias("dimension"))
    cache.add(one)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        look = cache.looked_up(spark.range(30_000).select(F.concat(F.lit("t"), "id").alias("content")))
        said = plan(look)
        tree = said.split("== Physical Plan ==")[1].split("\n\n")[0]
        cache_side = tree[tree.index("Scan parquet") - 200 :]
        assert "SelectedBucketsCount: 16 out of 16" in said and "Exchange" not in cache_side.split("+- ")[-1]
        assert look.filter("vector is null").count() == 10_000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


# Search


def plain_top(vs, qs, k):
    out = {}
    for i, q in qs:
        every = []
        for c, v in vs:
            if v is not None and len(v) == len(q):
                a, b = np.array(q, float), np.array(v, float)
                n = np.linalg.norm(a) * np.linalg.norm(b)
                every.append((-round(max(0.0, min(1.0, float(a @ b / n) if n else 0.0)), 12) + 0.0, c))
        out[i] = [c for _, c in sorted(every)[:k]]
    return out


@pytest.mark.parametrize("asked_bytes,cell", [(64 << 20, 256 << 20), (1, 1 << 12), (1, 1 << 20)])
def test_search_small_and_grid_agree(spark, monkeypatch, asked_bytes, cell):
    monkeypatch.setattr(S, "FIRST", 10)
    r = np.random.default_rng(1)
    grid = lambda n: (r.integers(-2, 3, (n, 4)) / 2).tolist()
    vs = [(f"c{i}", v) for i, v in enumerate(grid(300))] + [("n1", None), ("n2", [1.0, 2.0]), ("n3", [float("nan")] * 4)]
    qs = [(i, v) for i, v in enumerate(grid(60))] + [(100, [2.0, 4.0])]
    v = spark.createDataFrame(vs, "id string, embedding array<float>").withColumn("content", F.concat(F.lit("text of "), "id")).repartition(5)
    q = spark.createDataFrame(qs + qs[:3], "question_id long, embedding array<float>")
    got = {}
    for x in S.top_k(v, q, k=4, keep=("content",), asked=asked_bytes, cell=cell).orderBy("question_id", "rank").collect():
        assert x.content == f"text of {x.chunk_id}"
        got.setdefault(x.question_id, []).append(x.chunk_id)
    want = plain_top(vs[:-1], qs, 4)
    assert got == want
    assert S.top_k(v, q.limit(0), k=4).count() == 0 and S.top_k(v.limit(0), q, k=4, asked=asked_bytes, cell=cell).count() == 0


def test_equal_questions_are_searched_once(spark, monkeypatch):
    """Each of 40 vectors is asked under 50 ids, among them one of null; cells do not multiply with small ones."""
    monkeypatch.setattr(S, "FIRST", 10)
    monkeypatch.setattr(S, "CELLS", 4)
    sent = []
    many = S._many

    def counted(v, q, *rest):
        sent.append(q.count())
        return many(v, q, *rest)

    monkeypatch.setattr(S, "_many", counted)
    r = np.random.default_rng(4)
    vs = [(i, x) for i, x in enumerate(r.normal(size=(400, 8)).tolist())] + [(1000 + i, [1.0] * 8) for i in range(300)]
    v = spark.createDataFrame(vs, "id long, embedding array<double>").repartition(6)
    base = [(None if i == 7 else i, x) for i, x in enumerate(r.normal(size=(38, 8)).tolist() + [[2.0] * 8, [0.0] * 8])]
    qs = [(i if n == 0 else 100 * n + j, x) for n in range(50) for j, (i, x) in enumerate(base)]
    q = spark.createDataFrame(qs, "question_id long, embedding array<double>")
    got = {}
    for x in S.top_k(v, q, k=5, asked=1, cell=64).orderBy("question_id", "rank").collect():
        got.setdefault(x.question_id, []).append(x.chunk_id)
    assert got == plain_top(vs, qs, 5)
    assert sent == [40]


def test_single_precision_decides_nothing(spark):
    """Scores that differ in the tenth place, among vectors that come later than k matches."""
    near = [(i, [1.0, 1e-5 * (1 + (997 * i % 1000) / 1000)]) for i in range(1000)]
    blocks = S._search([np.array([[1.0, 0.0]])], ((pa.array([i for i, _ in near[a : a + 50]]), pa.array([x for _, x in near[a : a + 50]])) for a in range(0, 1000, 50)), 4, "cosine")
    assert blocks[0][1].ids.take(pa.array(blocks[0][1].at)).to_pylist() == plain_top(near, [(0, [1.0, 0.0])], 4)[0]


def test_distances_by_blocks(spark):
    """Every pair of a label once, whatever the vectors; what is joined are blocks of them."""
    r = np.random.default_rng(5)
    vs = [(i, i % 3, x) for i, x in enumerate((100 * r.normal(size=(1500, 4))).tolist())] + [(2000, 0, None), (2001, 0, [1.0, None, 2.0, 3.0]), (2002, 0, [1.0]), (2003, 0, [0.0] * 4), (2004, None, [1.0] * 4), (2005, 0, [])]
    v = spark.createDataFrame(vs, "id long, label int, embedding array<double>").repartition(5)
    q = v.filter("id % 10 = 0 or id > 1999").withColumnRenamed("id", "question_id")
    rows = S.distances(v, q, "label").collect()
    got = {(x.question_id, x.chunk_id): x for x in rows}
    want = {(a, b): (x, y) for a, m, x in vs if a % 10 == 0 or a > 1999 for b, n, y in vs if m == n is not None}
    assert len(rows) == len(got) == len(want) and set(got) == set(want)
    for k, (x, y) in want.items():
        if x is None or y is None or None in x or None in y or len(x) != len(y):
            assert got[k].dot is got[k].cosine is got[k].l2 is None
        else:
            a, b = np.array(x), np.array(y)
            assert math.isclose(got[k].dot, a @ b, rel_tol=1e-9, abs_tol=1e-9) and math.isclose(got[k].l2, ((a - b) ** 2).sum(), rel_tol=1e-9)
            if a.any() and b.any():
                assert math.isclose(got[k].cosine, 1 - a @ b / (np.linalg.norm(a) * np.linalg.norm(b)), abs_tol=1e-9)
            else:
                assert math.isnan(got[k].cosine)
    assert S.distances(v.limit(0), q, "label").count() == 0
    assert "zip_with" not in plan(S.distances(v, q, "label"))


def test_contents_do_not_travel_through_the_merge(spark):
    v = spark.range(100).select(F.col("id").cast("string").alias("id"), F.array(F.col("id").cast("float"), F.lit(1.0).cast("float")).alias("embedding"), F.lit("c").alias("content"))
    q = v.select(F.col("id").cast("long").alias("question_id"), "embedding")
    said = plan(S.top_k(v, q, k=2))
    assert "content" not in said and "Window" in said


# Questions


def corpus(spark):
    v = spark.createDataFrame([("c1", "Federal courts interpret laws. They review statutes.", "a"), ("c2", "Cats sleep all day.", "b")], "id string, content string, source string")
    return v.withColumn("embedding", E.provider()(F.col("content")))


def test_every_question_is_settled_once_by_a_provider_of_moods(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()

    def moody(prompts):
        import random as rnd
        import uuid

        with open(f"{calls}/{uuid.uuid4().hex}", "w") as f:
            f.writelines(re.search(r"Question: (.*)", p).group(1) + "\n" for p in prompts)
        return [rnd.choice(["Federal courts interpret laws.", "Zebras whistle jazz loudly.", "Federal courts interpret laws. Zebras whistle jazz."]) for _ in prompts]

    q = spark.range(400).select(F.col("id").alias("question_id"), F.concat(F.lit("What do federal courts interpret, number "), "id", F.lit("?")).alias("question")).repartition(6)
    out = workflow.ask(q, corpus(spark), E.provider(), answer=remote.answers(moody))
    rows = out.collect()
    assert sorted(r.question_id for r in rows) == list(range(400)) and out.count() == 400
    n = asked(calls)
    assert all(n[f"What do federal courts interpret, number {r.question_id}?"] == r.retry_count for r in rows)
    assert {r.action for r in rows} == {"accept", "refuse"} and all(r.retry_count == 3 for r in rows if r.action == "refuse")
    assert all(r.answer == "Federal courts interpret laws." for r in rows if r.action == "accept")


def test_failures_are_rows(spark):
    def shaky(prompts):
        if any(re.search(r"number \d*0\?", p) for p in prompts):
            raise Refused("not this one")
        return ["Federal courts interpret laws." for _ in prompts]

    q = spark.range(40).select(F.col("id").alias("question_id"), F.concat(F.lit("What do federal courts interpret, number "), "id", F.lit("?")).alias("question"))
    rows = workflow.ask(q, corpus(spark), E.provider(), answer=remote.answers(shaky)).collect()
    assert {r.question_id for r in rows if r.error} == {0, 10, 20, 30} and all(r.action == ("refuse" if r.error else "accept") and r.retry_count == 1 for r in rows)
    assert {r.error for r in rows if r.error} == {"The answer provider failed: not this one"}
    m = evaluate.metrics(evaluate.run(q.select("question", F.lit(False).alias("expected_refusal")), corpus(spark), E.provider(), answer=remote.answers(shaky))).first()
    assert (m.total_questions, m.answered, m.refused, m.errors, m.avg_groundedness) == (40, 36, 0, 4, 1.0)
    with pytest.raises(Exception, match="not this one"):
        q.select(remote.answers(shaky)(F.col("question"), F.lit(None))).collect()
    with pytest.raises(AnswerError):
        raise AnswerError


def test_questions_that_cannot_be_embedded(spark):
    def vectors(texts):
        if any("odd" in t for t in texts):
            raise ValueError("no vector for that")
        return [[1.0] * 64 for _ in texts]

    q = spark.createDataFrame([(1, "What is odd?"), (2, "What do courts do?"), (2, "What do cats do?"), (None, "Who sleeps?")], "question_id long, question string")
    rows = workflow.ask(q, corpus(spark), remote.vectors(vectors, attempts=1)).collect()
    assert Counter(r.question_id for r in rows) == Counter([1, 2, 2, None])
    assert {r.question: r.error for r in rows}["What is odd?"] == "The question could not be embedded: no vector for that"
    assert all(r.error is None and len(r.citations) == 2 for r in rows if r.question_id != 1)
    assert workflow.ask(q.limit(0), corpus(spark), E.provider()).count() == 0


def test_refusals_by_the_service_are_not_tried_again():
    class Status(Exception):
        def __init__(self, code):
            self.status_code = code

    def failing(e, log):
        def call():
            log.append(1)
            raise e

        return call

    for e, n in ((Refused("x"), 1), (Status(403), 1), (Status(429), 3), (Status(503), 3), (OSError(), 3)):
        log = []
        with pytest.raises(type(e)):
            remote.persistent(failing(e, log), 3, 0.0, sleep=lambda s: None)()
        assert len(log) == n
    said = []
    call = lambda prompts, system=None, heat=0: said.append((system, heat)) or ["x" for _ in prompts]
    more = remote.answers(call, system="be brief", heat=2)
    assert callable(more) and callable(more.outcomes)


def test_scratch_deletes_what_it_wrote(spark):
    with tables.scratch(spark):
        d = tables.written(spark.range(3).toDF("x"), "some")
        path = d.inputFiles()[0].rsplit("/", 1)[0]
        assert d.count() == 3 and tables.Folder(spark, path).exists()
    assert not tables.Folder(spark, path).exists()


def test_scratch_leaves_what_outlives_it(spark):
    with tables.scratch(spark):
        with tables.scratch(spark):
            path = tables.fresh_path(spark, "some", outlives=True)
            d = tables.saved(spark.range(3).toDF("x"), path)
        assert d.count() == 3
    assert not tables.Folder(spark, path).exists()


def test_a_written_step_leaves_no_shuffle_files(spark):
    top = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    shuffled = lambda: {f for d in top for _, _, names in os.walk(d) for f in names if f.startswith("shuffle_")}
    before = shuffled()
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    said = spark.conf.get(name, None)
    d = tables.written(spark.range(1000).repartition(5, "id").groupBy((F.col("id") % 7).alias("m")).count(), "some")
    for _ in range(50):
        if not shuffled() - before:
            break
        time.sleep(0.2)
    assert not shuffled() - before
    assert d.agg(F.sum("count")).first()[0] == 1000 and spark.conf.get(name, None) == said
