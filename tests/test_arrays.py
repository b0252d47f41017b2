"""JSON arrays by many tasks against the json module."""

import json
import random

import pytest
from pyspark.sql import functions as F

from sextant.sources import arrays, files


@pytest.fixture(params=[37, 1 << 20])
def split_bytes(spark, request):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(n) for n in names]
    spark.conf.set(names[0], str(request.param))
    spark.conf.set(names[1], "1")
    yield request.param
    for n, v in zip(names, before):
        spark.conf.set(n, v)


def value(r, depth=0):
    kind = r.random()
    text = "".join(r.choice(['a', '"', "\\", "{", "}", "[", "]", ",", "é", " ", "\n", ":"]) for _ in range(r.randint(0, 12)))
    if kind < 0.5 or depth > 2:
        return text
    if kind < 0.7:
        return {text + str(i): value(r, depth + 1) for i in range(r.randint(0, 3))}
    if kind < 0.8:
        return [value(r, depth + 1) for _ in range(r.randint(0, 3))]
    return r.choice([None, True, 1.5, -3])


def test_entries_match_json(spark, tmp_path, split_bytes):
    r = random.Random(split_bytes)
    want = {}
    for f in range(6):
        want[f"f{f}.json"] = [value(r) for _ in range(r.choice([0, 1, 25]))]
        (tmp_path / f"f{f}.json").write_text(json.dumps(want[f"f{f}.json"], indent=r.choice([None, 2]), ensure_ascii=r.random() < 0.5) + r.choice(["", "\n", " \n\n"]), encoding="utf-8")
    got, failed = arrays.array_entries(spark, str(tmp_path))
    assert failed.count() == 0
    out = {name: {} for name in want}
    for x in got.collect():
        out[x.file.rsplit("/", 1)[1]][x.position] = json.loads(x.entry)
    assert out == {k: dict(enumerate(v)) for k, v in want.items()}
    if split_bytes == 37:
        assert arrays.fragments(spark, str(tmp_path)).select("file", "block").distinct().count() > 12


def test_bad_entries_are_listed(spark, tmp_path, split_bytes):
    page = lambda n: {"chapter": 1, "page_number": n, "source": "a.pdf", "text": f"words {n} }}, {{"}
    good = json.dumps([page(i) for i in range(30)])
    (tmp_path / "a.json").write_text(good[:-1] + ', 7, {"text": 5 5}, "x", {"page_number": "no", "text": "kept", "source": "a.pdf"}, {"text": " "}]')
    (tmp_path / "b.json").write_text('[{"text": "whole", "source": "b", "page_number": 1}, {"text": "half')
    (tmp_path / "c.json").write_text('{"text": "no array"}')
    (tmp_path / "d.json").write_text("[]")
    (tmp_path / "e.json").write_text("\ufeff [ ]\n")
    docs, failed = files.load_pages(spark, str(tmp_path))
    assert sorted(r.content for r in docs.collect()) == sorted([f"words {i} }}, {{" for i in range(30)] + ["kept", "whole"])
    said = {}
    for r in failed.collect():
        said.setdefault(r.source, []).append(r.error)
    assert sorted(said["a.json"]) == [f"entry {i}: not a page" for i in (30, 31, 32)]
    assert [len(said[f]) for f in ("b.json", "c.json")] == [1, 1] and set(said) == {"a.json", "b.json", "c.json"}


def test_one_line_of_many_pages(spark, tmp_path):
    """A file in one line is read by as many tasks as it has splits."""
    with open(tmp_path / "big.json", "w") as f:
        json.dump([{"chapter": 1, "page_number": i, "source": "s", "text": "some words of a page " * 20} for i in range(20_000)], f)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1m")
    try:
        assert arrays.fragments(spark, str(tmp_path)).rdd.getNumPartitions() >= 8
        docs, failed = files.load_pages(spark, str(tmp_path))
        assert docs.count() == 20_000 and failed.count() == 0 and docs.select(F.countDistinct("id")).first()[0] == 20_000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
