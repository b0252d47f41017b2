import json
import logging

import pytest
from pyspark.sql import functions as F

from sextant import logs
from sextant.__main__ import main, parser
from sextant.config import settings
from sextant.errors import AnswerError, ConfigError, ProviderError, RetrievalError, SourceError, StoreError
from sextant.operators import answers, remote, store
from sextant.operators import embedding as E
from sextant.plans import evaluate, ingest, workflow
from sextant.plans.engine import engine
from sextant.sources import files, pdf


def model_pages(pages):
    """Numbers of one file's pages, one after the other: (label number, text number, blank, first page) a page."""
    out, nxt = [], None
    for label, text, blank, first in pages:
        nxt = (first or 1) if nxt is None else nxt
        if blank:
            nxt += 1
            continue
        n = nxt if first else label or text or nxt
        out.append(n)
        nxt = n + 1
    return out


def test_page_numbers_in_order(spark):
    import random

    r = random.Random(3)
    rows, want = [], {}
    for f in range(30):
        first = r.choice([None, None, 7])
        pages = [(r.choice([None, None, r.randint(1, 50)]), r.choice([None, None, r.randint(1, 50)]), r.random() < 0.2, first) for _ in range(12)]
        want[f"f{f}"] = model_pages(pages)
        for i, (label, text, blank, _) in enumerate(pages):
            rows.append((f"f{f}", i, None if label is None else str(label), r.choice([None, " "]) if blank else f"words\n{text if text else 'more'}\n", 1, first))
    d = spark.createDataFrame(rows, "source string, position int, label string, text string, chapter int, first_page int")
    got = {}
    for x in pdf.number_pages(d).orderBy("source", "page_number").collect():
        got.setdefault(x.source, []).append(x.page_number)
    assert got == {k: sorted(v) for k, v in want.items() if v}
    assert pdf.number_pages(d.limit(0)).count() == 0


def test_manifest(spark, tmp_path):
    p = tmp_path / "m.json"
    p.write_text(json.dumps([{"file": "a.pdf", "first_page": 9}, {"file": "/x/b.pdf", "chapter": 2}]))
    assert [tuple(r) for r in pdf.read_manifest(spark, str(p)).collect()] == [(f"{tmp_path}/a.pdf", None, 9), ("/x/b.pdf", 2, None)]
    for bad in ('{"file": "a"}', '[{"chapter": 1}]', "no json"):
        p.write_text(bad)
        with pytest.raises(SourceError):
            pdf.read_manifest(spark, str(p))


def test_bad_files_end_nothing(spark, tmp_path):
    (tmp_path / "b.txt").write_text("By: Ann\nwords here")
    (tmp_path / "a.md").write_bytes("caf\xe9".encode("latin-1"))
    (tmp_path / "c.pdf").write_bytes(b"no pdf")
    docs, failed = files.load_folder(spark, str(tmp_path))
    assert {r.source: r.content for r in docs.collect()} == {"b.txt": "By: Ann\nwords here", "a.md": "caf\xe9"}
    assert [r.source for r in failed.collect()] == ["c.pdf"]
    assert [r.source for r in files.list_folder(spark, str(tmp_path)).collect()] == ["a.md", "b.txt", "c.pdf"]
    with pytest.raises(SourceError):
        files.read_folder(spark, str(tmp_path / "none"))
    with pytest.raises(SourceError):
        files.list_folder(spark, str(tmp_path / "b.txt"))
    files.register("mine", files.read_folder)
    files.reset()
    assert "mine" not in files.registered()


def test_page_files(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"chapter": 1, "page_number": 2, "source": "a.pdf", "text": "words"}, {"chapter": 1, "page_number": 3, "source": "a.pdf", "text": " "}]))
    (tmp_path / "b.json").write_text("[{no json")
    docs, failed = files.load_pages(spark, str(tmp_path))
    assert [(r.content, r.source) for r in docs.collect()] == [("words", "Chapter 1, p. 2")]
    assert [r.source for r in failed.collect()] == ["b.json"] and files.read("json_pages", spark, str(tmp_path)).count() == 1


def test_store_merges_changes(spark, tmp_path):
    s = store.open_store("parquet", spark, f"file://{tmp_path}/s", dimension=1)
    rows = lambda *x: spark.createDataFrame(x, "id string, embedding array<float>, content string")
    want = {}
    for i in range(8):
        s.add(rows((f"k{i % 5}", [1.0], f"v{i}"), (f"k{i % 5}", [2.0], f"w{i}")))
        want[f"k{i % 5}"] = f"w{i}"  # of repeated ids the last row
        if i % 3 == 2:
            assert s.delete(spark.createDataFrame([(f"k{i % 5}",)], "id string")) == 1
            del want[f"k{i % 5}"]
        assert {r.id: r.content for r in s.read().collect()} == want
    s.add(rows(("z", [1.0], "z")).limit(0))
    s.add(rows(("k0", [3.0], "other")), "second")
    assert {r.id: r.content for r in s.read("default").collect()} == want and s.count("second") == 1
    assert len(s._runs("default").current()) <= 4
    s.clear()
    assert s.count() == 0 and s.count("second") == 1
    with pytest.raises(StoreError, match="components"):
        s.add(rows(("x", [1.0, 2.0], "bad")))
    with pytest.raises(StoreError, match="id"):
        s.add(rows((None, [1.0], "bad")))
    assert s.count("second") == 1 and s.stats().first().metric == "cosine"
    with pytest.raises(ConfigError):
        store.open_store("odd", spark, "x")


def test_remote_providers(spark):
    tries, slept = [], []

    def shaky(x):
        tries.append(x)
        if len(tries) < 3:
            raise OSError("busy")
        return x

    assert remote.persistent(shaky, 3, 1.0, (OSError,), slept.append)("a") == "a" and len(slept) == 2
    assert [remote.pause(i, 1.0, 0.5) for i in (0, 1, 2, 9)] == [1.5, 2.5, 4.5, 60.0]
    with pytest.raises(ValueError):
        remote.persistent(lambda: int("x"), 5, 1.0, (OSError,), slept.append)()
    run = remote._results(remote._checked(lambda ts: [len(t) for t in ts]), 2, remote.pa.int32())
    assert run(remote.pa.array(["a", None, " ", "bcd", "a", "ee"])).to_pylist() == [1, None, None, 3, 1, 2]
    with pytest.raises(ProviderError):
        remote._results(remote._checked(lambda ts: []), 2, remote.pa.int32())(remote.pa.array(["a"]))
    d = spark.createDataFrame([("x y", ["One. Two. Three."]), (None, None)], "p string, ps array<string>")
    say = answers.provider("remote", call=lambda ts: [t.upper() for t in ts])
    assert [r[0] for r in d.select(say(d.p, d.ps)).collect()] == ["X Y", None]
    assert [r[0] for r in d.select(answers.provider(n=1)(d.p, d.ps)).collect()] == ["One.", ""]
    embed = E.provider("remote", call=lambda ts: [[float(len(t))] for t in ts])
    assert [r[0] for r in d.select(embed(d.p)).collect()] == [[3.0], None]
    with pytest.raises(Exception, match="blank"):
        d.select(E.refuse_blank(embed)(d.p)).collect()
    with pytest.raises(ProviderError):
        answers.provider("odd")

    def down(ts):
        raise OSError("down")

    with pytest.raises(Exception, match=AnswerError.__name__):
        d.select(answers.provider("remote", call=down, attempts=2, base=0.0)(d.p, d.ps)).collect()


def test_token_estimates_and_problems(spark):
    d = spark.createDataFrame([(None,), ("",), ("a",), ("a b  c\n",), ("x" * 41,)], "t string")
    assert [tuple(r) for r in d.select(answers.tokens_by_length(d.t), answers.tokens_by_words(d.t)).collect()] == [(0, 0), (0, 0), (1, 1), (1, 3), (10, 1)]
    q = spark.createDataFrame([(" ",), (None,), ("q",)], "q string")
    assert [len(r[0]) for r in q.select(workflow.problems("grounding", F.col("q"))).collect()] == [3, 3, 2]
    with pytest.raises(ConfigError):
        workflow.problems("odd", F.col("q"))


def test_engine_and_evaluation(spark, tmp_path):
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "a.txt").write_text("Federal courts decide disputes about federal law. The senate confirms judges of these courts.")
    (tmp_path / "docs" / "b.txt").write_text("Bread is baked from flour and water. Yeast lets the dough rise.")
    (tmp_path / "docs" / "c.pdf").write_bytes(b"no pdf")
    it = engine(spark, settings(env={}, store={"path": f"file://{tmp_path}/s"}))
    with pytest.raises(RetrievalError):
        it.ask(spark.createDataFrame([(1, "q")], "question_id long, question string"))
    summary, errors = it.ingest(str(tmp_path / "docs"))
    assert (summary["documents_count"], summary["chunks_count"], summary["errors_count"]) == (2, 2, 1) and errors.first().source == "c.pdf"
    with pytest.raises(RetrievalError):
        it.ask(spark.createDataFrame([(1, " ")], "question_id long, question string"))
    suite = tmp_path / "s.json"
    qs = [{"question": "Which courts decide disputes about federal law?", "expected_refusal": False}, {"question": "hello", "expected_refusal": True}, {"question": "hello", "expected_refusal": True}]
    suite.write_text(json.dumps({"name": "s", "questions": [x | {"expected_answer_contains": [], "difficulty": "easy", "tags": []} for x in qs]}))
    q = evaluate.load_suite(spark, str(suite))
    assert evaluate.refusals(q).count() == 2 and evaluate.answerable(q).count() == 1
    scored = it.evaluate(q).collect()
    assert len(scored) == 3 and all(r.latency_ms > 0 for r in scored)
    first = next(r for r in scored if not r.expected_refusal)
    assert "Federal courts" in first.answer and first.groundedness == 1.0 and first.refusal_correct
    rep = evaluate.report(it.evaluate(q), "s")
    made = evaluate.save_report(rep, str(tmp_path / "out"))
    assert [p.rsplit(".", 1)[1] for p in made] == ["json", "html", "txt"] and evaluate.load_baseline(made[0])["total_questions"] == 3
    with pytest.raises(ConfigError):
        evaluate.save_report(rep, str(tmp_path), ("pdf",))
    steps = list(ingest.run_with_progress(spark.createDataFrame([("n", "New words here.", "n", "txt", None), ("o", None, "o", "txt", None)], "id string, content string, source string, document_type string, metadata map<string,string>"), it.store, it.embed, every=0.2))
    assert steps[-1]["documents_count"] == 1 and steps[-1]["errors_count"] == 1 and "documents_done" in steps[0]
    assert it.store.count() == 3


def test_command_line(spark, tmp_path, capsys):
    assert parser().parse_args(["eval", "s.json"]).format == "all"
    c = tmp_path / "c.json"
    c.write_text(json.dumps({"store": {"path": f"file://{tmp_path}/s"}}))
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.txt").write_text("Federal courts decide disputes about federal law.")
    assert main(["--config", str(c), "ingest", str(tmp_path / "d")]) == 0 and json.loads(capsys.readouterr().out)["chunks_count"] == 1
    assert main(["--config", str(c), "query", "Which courts decide disputes about federal law?"]) == 0 and "Federal courts" in capsys.readouterr().out
    assert main(["--config", str(c), "query", " "]) == 1 and "blank" in capsys.readouterr().err
    c.write_text("[1]")
    with pytest.raises(ConfigError):
        settings(str(c), env={})


def test_json_logs():
    r = logging.makeLogRecord({"name": "n", "levelname": "INFO", "msg": "x %s", "args": ("y",), "job": 7})
    out = json.loads(logs.JsonLines().format(r))
    assert (out["message"], out["level"], out["job"]) == ("x y", "INFO", 7)
