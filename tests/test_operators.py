import json

import pytest
from pyspark.sql import functions as F

from sextant.config import coerce, merged, settings
from sextant.errors import ConfigError, ProviderError, SourceError
from sextant.operators import chunking as C
from sextant.operators import embedding as E
from sextant.operators import grounding as G
from sextant.operators import search as S
from sextant.operators.store import VectorStore
from sextant.plans import evaluate, ingest, workflow
from sextant.sources import files
from sextant.streaming.ingest import arriving, ingest_stream


def model_fixed(text, size, overlap):
    """The closed form, one window after the other."""
    out, a = [], 0
    while a < len(text):
        b = min(a + size, len(text))
        if text[a:b].strip():
            out.append((text[a:b].strip(), a, b))
        if b == len(text):
            break
        a = b - overlap
    return out


@pytest.mark.parametrize("overlap", [0, 3])
def test_fixed_closed_form(spark, overlap):
    texts = [None, "", "short", "x" * 10, "ab cd " * 9, " " * 25 + "end", "y" * 37]
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "id string, content string")
    got = {}
    for r in C.chunk_fixed(df, size=10, overlap=overlap, words=False).collect():
        got.setdefault(int(r.document_id), []).append((r.content, r.start_idx, r.end_idx))
    assert got == {i: m for i, t in enumerate(texts) if (m := model_fixed(t or "", 10, overlap))}


def test_fixed_words():
    text = "alpha beta gamma delta epsilon"
    got = C.fixed_pieces(text, 12, 0, True)
    assert [p["content"] for p in got] == ["alpha beta", "gamma delta", "epsilon"]
    assert all(text[p["start_idx"] : p["end_idx"]].strip() == p["content"] for p in got)
    assert len(C.fixed_pieces("z" * 300, 150, 149, True)) == 151  # always moves on
    with pytest.raises(ConfigError):
        C.check_fixed(10, 10)


def test_sentences_pack(spark):
    text = "One is here. Two is there. 42 left.\nThree! " + "w" * 60 + ". End"
    df = spark.createDataFrame([("d", text), ("e", ""), ("n", None)], "id string, content string")
    rows = C.chunk_sentences(df, least=10, most=30).orderBy("start_idx").collect()
    assert sum(r.sentence_count for r in rows) == 6
    assert all(sum(map(len, r.content.split())) <= 30 or r.sentence_count == 1 for r in rows)
    assert {r.chunk_meta.total_chunks for r in rows} == {len(rows)}
    assert [r.id for r in rows] == [f"d-chunk-{i:04d}" for i in range(len(rows))]


def test_context(spark):
    df = spark.createDataFrame([("d", "abcdefghij" * 5, {"page_number": "7"}), ("e", "", None), ("f", None, None)], "id string, content string, metadata map<string,string>")
    rows = C.chunk_fixed(df, size=20, words=False, context=5).orderBy("start_idx").collect()
    assert (rows[0].context_before, rows[0].context_after) == ("", "abcde...")
    assert (rows[1].context_before, rows[1].position_info.position, rows[1].position_info.page, rows[1].position_info.paragraph) == ("...fghij", 0.4, 7, None)
    assert rows[2].context_after == "" and len(rows) == 3
    assert [r.context_before + r.context_after for r in C.chunk_fixed(df, size=50, words=False, context=0).collect()] == [""]
    with pytest.raises(ConfigError):
        C.chunk_fixed(df, context=-1)


def test_unknown_provider():
    with pytest.raises(ProviderError):
        E.provider("nothing")


def test_top_k_ties_filters_and_zero(spark):
    v = spark.createDataFrame([("b", [1.0, 0.0], {"x": "1"}), ("a", [1.0, 0.0], {"x": "2"}), ("c", [0.0, 0.0], {"x": "1"}), ("d", [-1.0, 0.0], {"x": "1"}), ("e", None, {})], "id string, embedding array<float>, metadata map<string,string>")
    q = spark.createDataFrame([(1, [2.0, 0.0])], "question_id long, embedding array<float>")
    rows = [(r.rank, r.chunk_id, r.score) for r in S.top_k(v, q, k=9).orderBy("rank").collect()]
    assert rows == [(1, "a", 1.0), (2, "b", 1.0), (3, "c", 0.0), (4, "d", 0.0)]
    assert [r.chunk_id for r in S.top_k(v, q, k=1, where={"x": 1}).collect()] == ["b"]
    with pytest.raises(ConfigError):
        S.top_k(v, q, k=0)
    with pytest.raises(ConfigError):
        S.at_least(v, 1.5)


def test_rerank_citations_format(spark):
    r = spark.createDataFrame([(1, 1, "c1", 0.9, "x y", "cats", "C:\\d\\f.txt"), (1, 2, "c2", 0.8, "q", "cats and dogs", ""), (1, 3, "c1", 0.7, "x y", "cats", "later")], "question_id long, rank int, chunk_id string, score double, t string, content string, source string")
    got = {x.chunk_id: (x.rank, x.score) for x in S.rerank(r.filter("rank < 3").withColumn("question", F.lit("cats dogs"))).collect()}
    assert got == {"c2": (1, 1.0), "c1": (2, 0.0)}
    c = S.citations(r).orderBy("rank").collect()
    assert [(x.chunk_id, x.source) for x in c] == [("c1", "C:\\d\\f.txt"), ("c2", "unknown")]
    f = lambda s: S.citations(r).filter("rank = 1").select(S.format_citation(F.col("source"), F.col("chunk_id"), F.col("text"), F.col("score"), s)).first()[0]
    assert f("default") == '[c1] (score: 0.90) f.txt — "cats"'
    assert f("MLA") == '"cats" (f.txt, c1).'
    assert f("apa") == 'f.txt (c1, relevance: 0.90). "cats"'
    with pytest.raises(ConfigError):
        f("chicago")


def test_store(spark, tmp_path):
    s = VectorStore(spark, f"file://{tmp_path}/store", dimension=2)
    assert s.count() == 0
    rows = lambda *x: spark.createDataFrame(x, "id string, embedding array<float>, content string, n int")
    s.add(rows(("a", [1.0, 0.0], "one", 1), ("b", [0.0, 1.0], "two", 1)))
    s.add(rows(("a", [0.5, 0.5], "new", 1), ("a", [0.1, 0.1], "newest", 2)), order="n")
    s.add(rows(("a", [1.0, 1.0], "other", 1)), collection="second")
    assert s.count() == 2 and s.get(spark.createDataFrame([("a",)], "id string")).first().content == "newest"
    assert s.delete(spark.createDataFrame([("a",), ("zz",)], "id string")) == 1
    assert {r.collection: r["count"] for r in s.stats().collect()} == {"default": 1, "second": 1}
    with pytest.raises(Exception, match="components"):
        s.add(rows(("x", [1.0], "bad", 1)))
    s.clear("second")
    assert s.count("second") == 0 and s.count() == 1


def test_grounding_relevance_refusal(spark):
    d = spark.createDataFrame([("The senate has members. Zebras quietly whistle jazz.", ["senate members vote"]), ("Senate members vote.", []), ("", ["x"]), ("Of the.", ["y"])], "a string, p array<string>").withColumn("c", G.context_tokens(F.col("p")))
    g = [r.g for r in d.select(G.grounding(F.col("a"), F.col("c"), F.size("p")).alias("g")).collect()]
    assert [(x.is_grounded, x.confidence) for x in g] == [(True, 0.5), (False, 0.0), (False, 0.0), (True, 1.0)]
    r = spark.createDataFrame([("what is the senate", "The senate meets."), ("what is the senate", ""), ("the of", "any")], "q string, a string")
    assert [x[0] for x in r.select(G.relevance(F.col("q"), F.col("a"))).collect()] == [1.0, 0.0, 1.0]
    v = spark.createDataFrame([(True, None), (True, "r"), (False, None), (False, "r")], "e boolean, r string").select(G.refusal(F.col("e"), F.col("r")).alias("v")).collect()
    assert [x.v.correct for x in v] == [False, True, True, False]


def test_workflow_paths(spark):
    v = spark.createDataFrame([("c1", "Federal courts interpret laws. They review statutes.", "a"), ("c2", "Cats sleep all day.", "b")], "id string, content string, source string")
    e = E.provider()
    v = v.withColumn("embedding", e(F.col("content")))
    q = spark.createDataFrame([(1, "What do federal courts interpret?"), (2, "hello"), (3, "summarize federal courts interpret laws"), (4, None), (5, "what is on page 3")], "question_id long, question string")
    rows = {r.question_id: r for r in workflow.ask(q, v, e, early=0.2).collect()}
    assert rows[1].action == "accept" and rows[1].retry_count == 1 and rows[1].citations[0].chunk_id == "c1"
    assert rows[2].action == "refuse" and rows[2].retry_count == 0 and "No relevant documents" in rows[2].refusal_reason
    assert rows[3].retry_count == 0 and rows[3].action == "accept"
    assert rows[4].action == "refuse" and "chapter" in rows[5].refusal_reason
    bad = {r.question_id: r for r in workflow.ask(q, v, e, answer=lambda p, c: F.lit("Zebras whistle jazz."), early=2.0).collect()}
    assert bad[1].action == "refuse" and bad[1].retry_count == 3 and "3 times" in bad[1].refusal_reason
    blank = {r.question_id: r for r in workflow.ask(q, v, e, answer=lambda p, c: F.lit(" ")).collect()}
    assert blank[1].retry_count == 1 and blank[1].error is not None


def test_sources(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.md").write_text("---\nauthor: Ann\ntags:\n  - x\n  - y\n---\n# T\n\n* one\n")
    (tmp_path / "sub" / "b.txt").write_bytes("caf\xe9".encode("latin-1"))
    (tmp_path / "c.bin").write_bytes(b"\0")
    rows = {r.source: r for r in files.read("local", spark, str(tmp_path)).collect()}
    assert set(rows) == {"a.md", "sub/b.txt"}
    assert rows["a.md"].full_metadata.author == "Ann" and rows["a.md"].full_metadata.tags == ["x", "y"] and rows["a.md"].document_type == "md"
    assert rows["sub/b.txt"].content == "café"
    (tmp_path / "p.json").write_text(json.dumps([{"chapter": 2, "page_number": 7, "source": "s.pdf", "text": "hi"}, {"page_number": 8, "source": "s.pdf", "text": "  "}]))
    pages = files.read("json_pages", spark, str(tmp_path / "p.json")).collect()
    assert [p.source for p in pages] == ["Chapter 2, p. 7"]
    with pytest.raises(SourceError):
        files.read("ftp", spark)
    with pytest.raises(NotImplementedError):
        files.read("web", spark)
    t = spark.createDataFrame([("ch03_x", " 12 ", "a\n 5 \nb"), ("3-intro", "iv", "no"), ("x", None, None)], "s string, l string, t string")
    assert [tuple(r) for r in t.select(files.chapter_of(F.col("s")), files.page_of_label(F.col("l")), files.page_of_text(F.col("t"))).collect()] == [(3, 12, 5), (3, None, None), (None, None, None)]


def test_stream_ingest(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("One thing. Another thing.")
    s = VectorStore(spark, f"file://{tmp_path}/store")
    for _ in range(2):
        ingest_stream(arriving(spark, str(tmp_path / "in")), s, E.provider(), f"{tmp_path}/ck", once=True).awaitTermination()
        (tmp_path / "in" / "b.txt").write_text("More text here.")
    assert {r.content for r in s.read().select("content").collect()} == {"One thing. Another thing.", "More text here."}


def test_evaluation(spark, tmp_path):
    p = tmp_path / "s.json"
    p.write_text(json.dumps({"name": "s", "version": "1", "questions": [{"question": "q?", "expected_answer_contains": ["a"], "expected_refusal": True, "difficulty": "odd", "tags": ["t"]}, {"question": "r?", "expected_answer_contains": [], "expected_refusal": False, "difficulty": "easy", "tags": []}]}))
    suite = evaluate.load_suite(spark, str(p))
    assert suite.count() == 2 and evaluate.invalid(suite).count() == 1 and evaluate.by_tag(suite, "t").count() == 1 and evaluate.by_difficulty(suite, "easy").count() == 1
    a = spark.createDataFrame([("what is x", "x is here", ["x here"], None, False, None, 5.0), ("what is y", None, [], "no", True, None, 7.0), ("z", None, [], None, False, "boom", 9.0)], "question string, answer string, passages array<string>, refusal_reason string, expected_refusal boolean, error string, latency_ms double")
    m = evaluate.metrics(evaluate.score(a)).first()
    assert (m.total_questions, m.answered, m.refused, m.errors, m.refusal_accuracy, m.avg_latency_ms) == (3, 1, 1, 1, 1.0, 7.0)
    assert evaluate.metrics(evaluate.score(a.limit(0))).first().avg_relevance == 0.0
    rep = evaluate.report(evaluate.score(a), "s & t")
    assert "s &amp; t" in evaluate.report_html(rep) and "—" in evaluate.report_html(rep) and "answered: 1" in evaluate.report_text(rep)
    same = evaluate.metrics(evaluate.score(a))
    assert {r.change for r in evaluate.delta(same, same).collect()} == {"(=)"}


def test_report_is_whole(spark):
    a = spark.range(10_050).selectExpr("concat('q', id) AS question", "'x is here' AS answer", "array('x here') AS passages", "cast(null as string) AS refusal_reason", "false AS expected_refusal", "cast(null as string) AS error", "1.0D AS latency_ms")
    rep = evaluate.report(evaluate.score(a), "s")
    assert len({r["question"] for r in rep["results"]}) == 10_050 == rep["metrics"]["total_questions"]


def test_ingest_and_config(spark):
    d = spark.createDataFrame([("i", "A. B. C.", "src", "txt", {"source": "own"})], "id string, content string, source string, document_type string, metadata map<string,string>")
    rows = ingest.chunks(d, "fixed", 500, 50).collect()
    assert rows[0].metadata["source"] == "own" and rows[0].metadata["doc_id"] == "i"
    assert ingest.counts(d, ingest.chunks(d)).first().asDict() == {"documents_count": 1, "chunks_count": 1}
    assert [coerce(x) for x in ("yes", "0", "7", "1.5", "x")] == [True, False, 7, 1.5, "x"]
    assert merged({"a": {"b": 1}}, {"a": {"c": 2}}) == {"a": {"b": 1, "c": 2}}
    assert settings(env={"SEXTANT_GRAPH__K": "9"})["graph"]["k"] == 9
    with pytest.raises(ConfigError):
        settings(env={}, ingestion={"chunker": "odd"})


@pytest.mark.parametrize("size, overlap", [(10, 0), (10, 3), (10, 8), (7, 6)])
def test_fixed_closed_overlaps(spark, size, overlap):
    texts = ["héllo wörld " * 9, "😀a" * 31, " " * 40, "x" * size, "y" * (size + 1), "a\nb\r\nc " * 12]
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "id string, content string")
    got = {}
    for r in C.chunk_fixed(df, size=size, overlap=overlap, words=False).collect():
        got.setdefault(int(r.document_id), []).append((r.content, r.start_idx, r.end_idx))
    assert got == {i: m for i, t in enumerate(texts) if (m := model_fixed(t, size, overlap))}


def test_cleaning_a_frame_and_a_column_agree(spark):
    from sextant.functions.text import CleanOptions, clean, clean_frame

    rows = [("<p>A&#233;é &#x41; &amp; &#55555555555; “q”</p>\n\nMenu\n42\nhttp://a.b c@d.ef\tend",), (None,), ("",), ("plain",)]
    d = spark.createDataFrame(rows, "t string")
    o = CleanOptions(remove_urls=True, remove_emails=True, lowercase=True)
    both = clean_frame(d.withColumn("a", clean(F.col("t"), o)).withColumn("b", F.col("t")), "b", o).collect()
    assert [r.a for r in both] == [r.b for r in both] and both[1].a is None
    plan = clean_frame(d, "t", o)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") < 60


def test_top_k_passes_ids_and_close_scores(spark, monkeypatch):
    """String ids, scores that differ after six places, columns that come along, by either way of search."""
    monkeypatch.setattr(S, "FIRST", 3)
    v = spark.createDataFrame([(f"v{i}", [1.0, 1e-4 * i], f"text {i}") for i in range(30)], "id string, embedding array<double>, content string").repartition(5)
    q = spark.createDataFrame([(f"q{i}", [1.0, 0.0]) for i in range(8)] + [("none", None)], "question_id string, embedding array<double>")
    got = S.top_k(v, q, k=3, keep=("content",), asked=16).collect()
    assert len(got) == 24 and {(r.question_id, r["rank"], r.chunk_id, r.content) for r in got} == {(f"q{i}", j + 1, f"v{j}", f"text {j}") for i in range(8) for j in range(3)}
    assert S.top_k(v, q.limit(0)).count() == 0 and S.top_k(v.limit(0), q).count() == 0
