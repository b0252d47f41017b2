"""Character sets, progress of documents, log lines that belong together."""

import json
import logging
import threading

import pytest
from pyspark.sql import functions as F

from sextant import logs
from sextant.errors import IngestError
from sextant.operators import embedding as E
from sextant.operators.store import VectorStore
from sextant.plans import ingest
from sextant.sources import charsets, files

SAID = {
    "utf-8": "Où est l'été? Grüße, naïve café.",
    "utf-8-sig": "Marked text, déjà vu.",
    "utf-16": "Zwei Bytes für jedes Zeichen.",
    "utf-16-le": "Two bytes each, no mark at all here.",
    "utf-16-be": "Two bytes each, the other way round.",
    "cp1252": "“Quoted” text – with dashes, and the café’s menu for 5 €.",
    "latin-1": "Une fenêtre ouverte, où l'été s'arrête à côté.",
    "shift_jis": "これは日本語の文章です。文字コードを判定します。",
    "euc_jp": "これは日本語の文章です。文字コードを判定します。",
    "cp1251": "Это обычный русский текст, написанный строчными буквами.",
    "koi8-r": "Это обычный русский текст, написанный строчными буквами.",
}


def test_charsets_are_told(spark, tmp_path):
    for name, text in SAID.items():
        raw = (text * 3).encode(name)
        assert raw.decode(charsets.guess(raw)) == text * 3, (name, charsets.guess(raw))
        (tmp_path / f"{name}.txt").write_bytes(raw)
    (tmp_path / "odd.txt").write_bytes(bytes(range(128, 256)))
    docs, failed = files.load_folder(spark, str(tmp_path))
    got = {r.source: r for r in docs.collect()}
    assert failed.count() == 0 and len(got) == len(SAID) + 1
    for name, text in SAID.items():
        assert got[f"{name}.txt"].content == text * 3
    assert got["utf-8.txt"].metadata["charset"] == "utf-8" and got["cp1251.txt"].metadata["charset"] == "cp1251"
    plan = docs.select("content")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


DOCS = "id string, content string, source string, document_type string, metadata map<string,string>"


def test_two_ingests_report_their_own_documents(spark, tmp_path):
    def docs(name, n):
        return spark.range(n).select(F.concat(F.lit(name), "id").alias("id"), F.lit("Some words. More words.").alias("content"), F.lit(name).alias("source"), F.lit("txt").alias("document_type"), F.lit(None).cast("map<string,string>").alias("metadata")).repartition(4)

    said: dict = {}

    def work(name, n):
        store = VectorStore(spark, f"file://{tmp_path}/{name}")
        said[name] = list(ingest.run_with_progress(docs(name, n), store, E.provider(), every=0.1))

    threads = [threading.Thread(target=work, args=x) for x in (("a", 300), ("b", 70))]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    for name, n in (("a", 300), ("b", 70)):
        *steps, summary = said[name]
        assert summary["documents_count"] == n == steps[-1]["documents_done"] and summary["chunks_count"] == n == steps[-1]["chunks_done"]
        assert [s["documents_done"] for s in steps] == sorted(s["documents_done"] for s in steps) and steps[0]["documents_done"] <= n


def test_nothing_to_index_is_an_error(spark, tmp_path):
    store = VectorStore(spark, f"file://{tmp_path}/s")
    none = ingest.chunks(spark.createDataFrame([("a", " ", "a", "txt", None)], DOCS))
    with pytest.raises(IngestError):
        ingest.index(none, store, E.provider())
    assert ingest.run(spark.createDataFrame([("a", " ", "a", "txt", None)], DOCS), store, E.provider())[0]["chunks_count"] == 0


def test_log_lines_carry_an_id(caplog):
    line = lambda: json.loads(logs.JsonLines().format(logging.makeLogRecord({"msg": "x", "name": "n", "levelname": "INFO"})))
    assert "correlation_id" not in line()
    with logs.correlated("abc"):
        assert line()["correlation_id"] == "abc"
        with logs.correlated() as inner:
            assert line()["correlation_id"] == inner != "abc"
    assert "correlation_id" not in line()
