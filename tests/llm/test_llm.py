"""Each operator of the subpackage against SQL or a brute-force version, and its edge cases."""

import hashlib
import json
import math
import random
import re
import sys
import zlib
from collections import Counter
from itertools import combinations

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

from sextant import tables
from sextant.llm import chat, covertree, jaccard, kernels, licenses, linededup, mixing, packing, quality, secrets, toxicity
from sextant.llm.components import components
from sextant.llm.queries import QUERIES, oracle_sql
from tests.oracle import compare

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WS = r"[\x20\x09-\x0D]+"


def docs(spark, rows, kind="doc_id long, text string, source string"):
    return spark.createDataFrame(rows, kind)


def odd_docs(spark):
    """Nulls, empties, ties, repeats, a very long text, and columns whose names clash."""
    rows = [(1, "a b c d e f", "s", 1), (1, "a b c d e f", "s", 2), (2, None, None, 3), (None, "x y", "s", 4), (None, None, None, 5), (3, "", "t", 6), (4, " \n\t ", "t", 7), (5, "word " * 30_000, "t", 8), (6, "w" * 70_000, "u", 9)]
    return docs(spark, rows, "doc_id long, text string, source string, k int").withColumns({c: F.lit(0) for c in ("_w", "size", "bin", "score", "first", "label", "_id", "copies", "lang")})


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_matches_sql(spark, sf, name):
    compare(QUERIES[name](spark, sf), oracle_sql()[name], sf)


# 1


def test_mix_targets_and_caps(spark):
    rng = random.Random(1)
    rows = [(i, "w " * rng.randint(0, 60), rng.choice(["a", "b", "c", None])) for i in range(600)]
    out = mixing.mix_report(docs(spark, rows)).collect()
    again = mixing.mix_report(docs(spark, rows[::-1])).collect()
    assert {(r.doc_id, r.taken) for r in out} == {(r.doc_id, r.taken) for r in again}
    assert all(r.taken <= 2 * r.size for r in out)
    size = Counter()
    for r, (_, _, s) in zip(sorted(out, key=lambda r: r.doc_id), rows):
        size[s] += r.size
    taken, target = Counter(), {}
    for r, (_, _, s) in zip(sorted(out, key=lambda r: r.doc_id), rows):
        taken[s] += r.taken
        target[s] = r.target
    assert sum(target.values()) == pytest.approx(min(1.5 * sum(size.values()), 2 * sum(size.values())))
    assert all(target[s] <= 2 * size[s] + 1e-6 and abs(taken[s] - target[s]) <= 60 for s in size)


def test_mix_unequal_probabilities(spark):
    rows = [(i, "w " * 10, "a") for i in range(2000)]
    d = docs(spark, rows).withColumn("good", F.when(F.col("doc_id") % 4 == 0, 3.0).otherwise(1.0))
    sized = mixing.sized_rows(d, appeal=F.col("good"))
    out = mixing.copies(sized, *mixing.plan_mix(sized, weights=(1,), share=0.5)).groupBy("_appeal").agg(F.avg("copies").alias("c")).collect()
    mean = {r._appeal: r.c for r in out}
    assert mean[3.0] == pytest.approx(1.0, abs=0.01) and mean[1.0] == pytest.approx(1 / 3, abs=0.05)


@pytest.mark.parametrize("ident", [7, None])
def test_mix_takes_equal_rows_one_by_one(spark, ident):
    """400 equal rows, half of them to be taken twice: the target is met to a row."""
    d = docs(spark, [(ident, "w " * 20, "a")] * 400).repartition(7)
    out = mixing.mix_report(d, weights=(1,), share=0.75).collect()
    assert abs(sum(r.taken for r in out) - out[0].target) <= 20 and out[0].target == 6000
    assert mixing.mix(d, weights=(1,), share=0.75).count() == 300
    assert abs(sum(r.taken for r in mixing.mix_report(d, weights=(1,), share=1.5, appeal=mixing.length_appeal).collect()) - 12000) <= 20


def test_mix_grades_are_few(spark):
    """An appeal of its own for each row gives few grades, and words still meet the target."""
    rng = random.Random(11)
    d = docs(spark, [(i, "w " * rng.randint(1, 50), "a") for i in range(3000)]).withColumn("good", F.rand(3) * 100)
    sized = mixing.sized_rows(d, appeal=F.col("good"))
    assert sized.select("_appeal").distinct().count() <= 8 * 24
    out = mixing.mix_report(d, appeal=F.col("good"), share=0.4, weights=(1,)).collect()
    assert abs(sum(r.taken for r in out) - out[0].target) <= 50
    odd = spark.createDataFrame([(x,) for x in (0.0, -1.0, float("nan"), float("inf"), None, 3.0, 1e-300)], "a double").select(mixing.graded(F.col("a")).alias("g")).collect()
    assert [r.g for r in odd[:6]] == [0, 0, 0, 0, 0, 3] and 0.9e-300 < odd[6].g < 1.1e-300


def test_mix_columns_of_any_name(spark):
    d = docs(spark, [(i, "w " * 9, "a") for i in range(20)]).withColumn("a.b", F.lit(1)).withColumn("c`d", F.lit(2))
    m = mixing.mix(d)
    assert m.columns == d.columns and m.count() > 20


def test_mix_edges(spark):
    d = odd_docs(spark)
    assert mixing.mix_report(d).count() == 9
    m = mixing.mix(d)
    assert m.columns == d.columns
    assert mixing.mix(d.limit(0)).count() == 0


# 2


def brute_quality(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    at = {}
    for i in range(len(w) - 7):
        at.setdefault(tuple(w[i : i + 8]), []).append(i)
    rep = {j for p in at.values() if len(p) > 1 for i in p for j in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(rep)


def test_quality_base(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choices("ab", k=rng.randint(0, 60))) + rng.choice(["", "\nx y\nx y", " # é |"]), "s") for i in range(80)]
    rows += [(100, None, "s"), (101, "", "s"), (102, "\n\n", "s"), (103, "a " * 8, "s"), (104, "a " * 9, "s")]
    for r in quality.quality_report(docs(spark, rows)).collect():
        n, chars, sym, dup, rep = brute_quality(dict((x[0], x[1]) for x in rows)[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, sym, dup, rep)
        assert r.base_failed == (n < 20 or 100 * rep > 30 * n) and not (r.base_failed and r.kept)


def test_quality_verdicts(spark):
    good = "The committee met in the old hall and read the report that was sent to it by the clerk of the town, and then voted."
    rows = [(1, good, "s"), (2, " ".join(w + "%%%" for w in good.split()), "s"), (3, good.upper(), "s"), (4, "xq zv " * 3 + " ".join(f"q{i}z" for i in range(30)), "s")]
    kept = {r.doc_id: (r.kept, r.failed_rules) for r in quality.quality_report(docs(spark, rows)).collect()}
    assert kept[1][0] and "symbols" in kept[2][1] and "capitals" in kept[3][1] and "stop_words" in kept[4][1]
    assert quality.quality_report(odd_docs(spark)).count() == 9


# 3


def brute_components(rows, size=5):
    sets = {}
    for n, (i, t) in enumerate(rows):
        w = [x.encode().decode() for x in re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))]
        sets[n] = {tuple(w[j : j + size]) for j in range(len(w) - size + 1)} or ({tuple(w)} if w else set())
    parent = {n: n for n in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if both and 4 * both >= 3 * len(sets[a] | sets[b]):
            parent[find(a)] = find(b)
    least = {}
    for n, (i, _) in enumerate(rows):
        if i is not None:
            least[find(n)] = min(least.get(find(n), i), i)
    return sorted(((i, len(sets[n]), least.get(find(n))) for n, (i, _) in enumerate(rows)), key=repr)


def family(rng, n):
    """Texts around the threshold: edits of a few bases, shared passages, short ones."""
    word = lambda: "".join(rng.choices("abcdefgh", k=4))
    bases = [[word() for _ in range(rng.randint(8, 60))] for _ in range(5)]
    shared = [word() for _ in range(30)]
    out = []
    for _ in range(n):
        w = list(rng.choice(bases))
        for _ in range(rng.choice([0, 1, 1, 2, 3])):
            w[rng.randrange(len(w))] = word()
        w = w + shared if rng.random() < 0.4 else w
        out.append(" ".join(w) if rng.random() < 0.9 else " ".join(w[: rng.randint(0, 6)]).upper())
    return out


@pytest.mark.parametrize("orders", [8, 2])
def test_jaccard_components(spark, monkeypatch, orders):
    monkeypatch.setattr(jaccard, "ORDERS", orders)
    monkeypatch.setattr(jaccard, "NEIGHBOURS", 1 if orders == 2 else 3)
    monkeypatch.setattr(jaccard, "GROUP", 4)
    rng = random.Random(orders)
    rows = list(enumerate(family(rng, 140)))
    rows += [(500, None), (501, ""), (502, "one"), (503, "ONE"), (None, rows[0][1]), (None, "alone here"), (7, rows[7][1])]
    got = jaccard.shingle_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got), key=repr) == brute_components(rows)


@pytest.mark.parametrize("hot", [4096, 2, 1])
def test_jaccard_prefixes_alone_lose_nothing(spark, monkeypatch, hot):
    """Without any group from the minima, the matrix finds all links, also where most tokens are dealt over tasks."""
    monkeypatch.setattr(jaccard, "HOT", hot)
    monkeypatch.setattr(jaccard, "_neighbours", lambda t: lambda batches: iter(()))
    rows = list(enumerate(family(random.Random(9), 90)))
    got = jaccard.shingle_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got), key=repr) == brute_components(rows)


def test_jaccard_frequent_token_is_dealt():
    """Each two classes of a token meet under one name, and no name has more than two blocks of them."""
    node, copies = np.arange(3000, dtype=np.int64), 16
    name, side, row = jaccard._dealt(np.full(3000, 77, np.uint64), node, np.full(3000, copies))
    met = Counter()
    for x in np.unique(name):
        r, s = row[name == x], side[name == x]
        assert len(r) < 3 * 3000 / copies
        i, j = np.triu_indices(len(r), 1)
        ok = (s[i] != s[j]) | (s[i] == 0)
        met.update(zip(np.minimum(r[i], r[j])[ok].tolist(), np.maximum(r[i], r[j])[ok].tolist()))
    assert len(met) == 3000 * 2999 // 2 and set(met.values()) == {1}
    name, side, row = jaccard._dealt(np.array([5, 6], np.uint64), np.array([1, 2]), np.array([1, 1]))
    assert name.tolist() == [5, 6] and side.tolist() == [0, 0] and row.tolist() == [0, 1]


def test_jaccard_meets_by_ranges_of_groups():
    """What meets at a token holds all pairs of classes of different groups that could link, each from one end."""
    rng = np.random.default_rng(4)
    n, size = 400, 300
    node, sizes = rng.permutation(n).astype(np.int64), rng.integers(200, size, n)
    rest, comp = rng.integers(sizes // 2, sizes), np.where(node < 300, node, 1000 + node % 7)
    blob = lambda x, t: x.astype(t).tobytes()
    rows = pa.RecordBatch.from_pydict({
        "bucket": pa.array([0], pa.int32()), "tokens": [blob(np.full(n, 3), np.uint32)], "nodes": [blob(node, np.int64)], "sizes": [blob(sizes, np.uint16)], "rests": [blob(rest, np.uint16)], "sides": [blob(np.zeros(n), np.uint8)],
        "grouped": [blob(np.flatnonzero(comp != node), np.uint32)], "comps": [blob(comp[comp != node], np.int64)],
    })
    got = set()
    for b in jaccard._meet((3, 4), 1)([rows]):
        for x in b.column(1).to_pylist():
            got |= set(map(tuple, np.frombuffer(x, np.int64).reshape(-1, 2).tolist()))
    for i, j in zip(*np.triu_indices(n, 1)):
        if comp[i] != comp[j] and 4 * min(sizes[i], sizes[j]) >= 3 * max(sizes[i], sizes[j]) and 7 * min(rest[i], rest[j]) >= 3 * (sizes[i] + sizes[j]):
            assert ((node[i], comp[j]) in got) or ((node[j], comp[i]) in got)
    single = {(a, b) for a, b in got if a < 300 and b < 1000}
    assert all((b, a) not in single for a, b in single)


def _calls(run):
    """(result, calls of functions) of run()."""
    n = 0

    def count(frame, event, arg):
        nonlocal n
        n += event in ("call", "c_call")

    sys.setprofile(count)
    try:
        out = run()
    finally:
        sys.setprofile(None)
    return out, n


def test_jaccard_meets_many_tokens_at_a_time(monkeypatch):
    """Few classes at each of very many tokens: all pairs that could link, and no calls for each token."""
    monkeypatch.setattr(jaccard, "WEIGHED", 1000, raising=False)
    rng = np.random.default_rng(5)
    tokens, n = 5000, 15000
    tok, node = rng.integers(0, tokens, n), rng.integers(0, 2000, n)
    sizes = rng.integers(60, 100, 2000)[node]
    rest, comp = rng.integers(sizes // 2, sizes), np.where(node < 1000, node, 5000 + node % 50)
    side = np.where(tok < 100, rng.integers(0, 3, n), 0)
    blob = lambda x, t: x.astype(t).tobytes()
    rows = pa.RecordBatch.from_pydict({
        "bucket": pa.array([0], pa.int32()), "tokens": [blob(tok, np.uint32)], "nodes": [blob(node, np.int64)], "sizes": [blob(sizes, np.uint16)], "rests": [blob(rest, np.uint16)], "sides": [blob(side, np.uint8)],
        "grouped": [blob(np.flatnonzero(comp != node), np.uint32)], "comps": [blob(comp[comp != node], np.int64)],
    })
    out, calls = _calls(lambda: list(jaccard._meet((3, 4), 1)([rows])))
    got = {x for b in out for p in b.column(1).to_pylist() for x in map(tuple, np.frombuffer(p, np.int64).reshape(-1, 2).tolist())}
    asked = 0
    for t in range(tokens):
        for i, j in combinations(np.flatnonzero(tok == t).tolist(), 2):
            near = 4 * min(sizes[i], sizes[j]) >= 3 * max(sizes[i], sizes[j]) and 7 * min(rest[i], rest[j]) >= 3 * (sizes[i] + sizes[j])
            if comp[i] != comp[j] and near and (side[i] != side[j] or side[i] == 0):
                asked += 1
                assert ((node[i], comp[j]) in got) or ((node[j], comp[i]) in got)
    assert asked > 1000
    assert calls < tokens  # before, some forty for each token


def test_jaccard_minima_of_many_sets_at_a_time():
    """Minima are those of the sets one by one, and take no calls for each document and hash order."""
    texts = [None, "", "one two", *(" ".join(f"w{(i * j) % 97}" for j in range(20 + i % 50)) for i in range(1, 500))]
    rows = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": pa.array(texts, pa.string())})
    (out,), calls = _calls(lambda: list(jaccard._profile(5)([rows])))
    seeds = kernels.mix(np.arange(1, jaccard.ORDERS + 1, dtype=np.uint64))
    for t, n, keys in zip(texts, out.column(1).to_pylist(), out.column(3).to_pylist()):
        data = (t or "").encode()
        (s,) = kernels.shingle_sets(data, np.array([0, len(data)]))
        assert n == len(s) and (np.diff(s.view(np.int64) ^ np.int64(-(2**63))) > 0).all()
        assert keys == ([int(kernels.mix(s ^ x).min().view(np.int64)) for x in seeds] if n else [])
    assert calls < 40 * len(texts)  # before, some seventy


def test_keep_one(spark):
    d = odd_docs(spark)
    out = jaccard.keep_one(d)
    assert out.columns == d.columns
    assert Counter(r.doc_id for r in out.collect()) == Counter({1: 1, 2: 1, None: 2, 3: 1, 4: 1, 5: 1, 6: 1})
    assert jaccard.shingle_report(d.limit(0)).count() == 0


def test_spent_tables_are_gone(spark):
    """What near duplicates and lines took to work out is deleted; only what the result reads stays."""
    words = [f"w{i}" for i in range(40)]
    line = " ".join(words)
    rows = [(0, line), (1, line + " more"), (2, line), (3, "something else\nthat has lines of its own"), (4, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    shared = tables.Folder(spark, f"{tables.shared_dir(spark)}/sextant")
    before = {*shared.names()}
    kept = jaccard.keep_one(d)
    new = {n.rsplit("-", 1)[0] for n in {*shared.names()} - before}
    assert new == {"jaccard-report", "jaccard-gone", "jaccard-several"}
    assert sorted(r.doc_id for r in kept.collect()) == [0, 3, 4]
    before = {*shared.names()}
    kept = linededup.drop_repeated_lines(d)
    assert {n.rsplit("-", 1)[0] for n in {*shared.names()} - before} == {"line-removed"}
    assert sorted(r.doc_id for r in kept.collect()) == [0, 1, 3, 4]


def test_keep_one_tells_rows_apart(spark):
    """Of ids that repeat or are null, what is linked goes, what is not stays, and one of each component is left."""
    text = lambda c, n=40: " ".join(f"{c}{i}" for i in range(n))
    near = lambda c: text(c) + " more"
    rows = [
        (1, text("a")), (5, near("a")), (5, text("b")),  # 5 stands on a copy of 1 and on a clean text
        (6, text("c")), (6, near("c")), (6, text("c").upper()),  # near copies and an equal set that share an id
        (None, text("d")), (None, text("d")), (None, near("d")),  # copies without ids
        (None, near("e")), (9, text("e")), (None, text("f")), (8, text("g")), (10, near("g")), (7, None), (7, None), (None, ""),
    ]
    out = jaccard.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r.doc_id, (r.text or "-")[0].lower()) for r in out) == Counter([(1, "a"), (5, "b"), (6, "c"), (None, "d"), (9, "e"), (None, "f"), (8, "g"), (7, "-"), (None, "-")])


def test_jaccard_lower_threshold(spark, monkeypatch):
    """At 1/2 the prefixes alone find every link that brute force finds."""
    monkeypatch.setattr(jaccard, "_neighbours", lambda t: lambda batches: iter(()))
    rng = random.Random(12)
    rows = []
    for i in range(0, 80, 2):  # pairs around 1/2 that share the front of their texts
        w = ["".join(rng.choices("abcdefgh", k=6)) for _ in range(60)]
        rows += [(i, " ".join(w[:40])), (i + 1, " ".join(w[: rng.randint(24, 36)] + w[40 : 40 + rng.randint(4, 12)]))]
    sets = [{tuple(t.split()[j : j + 5]) for j in range(len(t.split()) - 4)} for _, t in rows]
    want = {}
    for i in range(0, 80, 2):
        linked = 2 * len(sets[i] & sets[i + 1]) >= len(sets[i] | sets[i + 1])
        want |= {i: i, i + 1: i if linked else i + 1}
    got = jaccard.shingle_report(spark.createDataFrame(rows, "doc_id long, text string"), threshold=(1, 2)).collect()
    assert {r.doc_id: r.component_id for r in got} == want


@pytest.mark.parametrize("held", [500_000, 5])
def test_components_chain(spark, monkeypatch, held):
    monkeypatch.setitem(components.__globals__, "HELD", held)
    e = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)]
    got = {r.node: r.label for r in components(spark.createDataFrame(e, "a int, b int"), "t").collect()}
    assert all(got[i] == 0 for i in range(41)) and got[101] == got[100] == 100


def test_kernels_words():
    for t in ["", " ", "a", " a\tb\n", "é" * 70 + " b", "x y z", "a" * 200 + " " + "a" * 199 + "b"]:
        data = t.encode()
        s, e, first = kernels.word_bounds(data, np.array([0, len(data)]))
        words = [data[i:j] for i, j in zip(s, e)]
        assert words == data.split()
        h = kernels.word_hashes(data, s, e)
        assert len(set(h.tolist())) == len(set(words))


# 4


def brute_spans(t):
    t, out = t or "", []
    for no, k in enumerate(secrets.KINDS):
        pattern = k.pattern if k.name != "hex" else "[0-9a-f]+"
        pattern = pattern if k.name != "access" else "AKIA[A-Z0-9]+"
        for m in re.finditer(pattern, t, re.ASCII):
            if len(m[k.group]) >= k.least:
                out.append((m.start(), no, m.end(), k.name))
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(out))


def test_secret_spans_and_owners(spark):
    texts = [
        "é password = 'hunter22' x", "password: token: abcdefgh", "Api_Key=\"a.b-c/d+e\" secret:short", "AKIA" + "Z" * 16 + " AKIAAKIA" + "Q" * 12, "AKIAB", "0123456789abcdef01234567z" * 3, "😀 token==abcdefg", "ghp_" + "a1" * 18, "xoxb-1234567890-ab", "-----BEGIN RSA PRIVATE KEY-----",
        "none", "", None, "apikey='" + "x" * 5000 + "'", "password=b7db7aa4a5fcc78305 " * 50,
    ]
    rows = [(i, t, f"o{i % 3}") for i, t in enumerate(texts)] + [(50 + i, "token = sharedvalue1", f"o{i}") for i in range(4)] + [(60, "token = pairvalue22", "o1"), (61, "token = pairvalue22", "o2")]
    out = {r.doc_id: r for r in secrets.digest(secrets.scan(docs(spark, rows))).collect()}
    for i, t, _ in rows:
        assert out[i].spans == brute_spans(t), t
        base = ",".join(s for s in out[i].spans.split(",") if s.split(":")[0] in ("assign", "access", "hex"))
        assert out[i].base_sha256 == hashlib.sha256(base.encode()).hexdigest()
    assert out[50].n_example == 1 and out[60].n_shared == 1 and out[0].n_live == 1
    assert secrets.scan(odd_docs(spark)).count() == 9 and secrets.scan(odd_docs(spark).limit(0)).count() == 0


def test_secret_verdicts_count_repositories(spark):
    """One owner: few repositories look live, many make an example, those between are shared."""
    many = {"fewrepos1": 3, "somerepos": 6, "manyrepos": 10}
    rows = [(100 * j + i, f"token = {v}", "o") for j, (v, n) in enumerate(many.items()) for i in range(n)]
    rows += rows[:3]  # repeated rows are no further repositories
    out = {r.doc_id: r for r in secrets.scan(docs(spark, rows)).collect()}
    assert [(out[i].n_live, out[i].n_shared, out[i].n_example) for i in (0, 100, 200)] == [(1, 0, 0), (0, 1, 0), (0, 0, 1)]


# 5


def lev(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        q = [i]
        for j, y in enumerate(b, 1):
            q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
        p = q
    return p[-1]


def edited(rng, s, n, letters="abcdefé"):
    b = list(s)
    for _ in range(n):
        i = rng.randrange(len(b) + 1)
        op = rng.random()
        if op < 0.35 or not b or i == len(b):
            b.insert(i, rng.choice(letters))
        elif op < 0.7:
            del b[i]
        else:
            b[i] = rng.choice(letters)
    return "".join(b)


def test_banded_distance():
    rng = random.Random(3)
    for _ in range(4000):
        letters = rng.choice(["ab", "abcdef"])
        a = "".join(rng.choices(letters, k=rng.randint(0, 14)))
        b = edited(rng, a, rng.randint(0, 5), letters)
        for tau in (1, 2, 3):
            assert linededup.within(a, b, tau) == (lev(a, b) <= tau), (a, b, tau)


def test_probes_lose_nothing():
    rng = random.Random(4)
    for _ in range(3000):
        a = "".join(rng.choices("ab", k=rng.randint(6, 20)))
        x, y = sorted((a, edited(rng, a, 2, "ab")), key=len)
        own = linededup.segments(len(x), 2)
        assert any(y[s : s + n] == x[own[i][0] : own[i][0] + n] for i, s, n in linededup.probes(len(y), len(x), 2))


def brute_lines(rows, tau=2):
    key = lambda d, i: (d is None, d or 0, i)
    ids, first = Counter(d for d, _ in rows), {}
    cut = lambda t: [x.strip(" \t\n\x0b\x0c\r") for x in (t or "").split("\n")]
    for d, t in rows:
        for i, x in enumerate(cut(t)):
            if len(x) >= linededup.MIN_EXACT:
                first[x] = min(first.get(x, (9,)), key(d, i))
    long = [x for x in first if len(x) >= linededup.MIN_NEAR]
    late = {a for a in long if any(first[b] < first[a] and abs(len(a) - len(b)) <= tau and lev(a, b) <= tau for b in long)}
    out = []
    for d, t in rows:
        exact, near = set(), set()
        for i, x in enumerate(cut(t)):
            if len(x) >= linededup.MIN_EXACT and d is not None and ids[d] == 1:
                if key(d, i) > first[x]:
                    exact.add(i)
                elif x in late:
                    near.add(i)
        out.append((d, sum(map(bool, cut(t))), len(exact), len(near), ",".join(map(str, sorted(exact | near)))))
    return sorted(out, key=repr)


def test_line_report(spark):
    rng = random.Random(5)
    bases = ["".join(rng.choices("abcdef ", k=rng.randint(26, 60))).strip() + "zz" for _ in range(12)]
    rows = []
    for d in range(45):
        lines = [edited(rng, rng.choice(bases), rng.randint(0, 3)) if rng.random() < 0.8 else rng.choice(["", " ", "x", "short one", "short one!"]) for _ in range(rng.randint(0, 6))]
        rows.append((rng.choice([None, d, d, d]), "\n".join(lines)))
    rows += [(101, None), (102, ""), (103, rows[3][1]), (103, rows[4][1])]
    got = linededup.line_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got), key=repr) == brute_lines(rows)


@pytest.mark.parametrize("first", [1, 4])
def test_line_candidates(monkeypatch, first):
    """Every line with an earlier candidate is named, with its earliest in the windows looked at; no candidate is made up; more is said where there are more."""
    monkeypatch.setattr(linededup, "WINDOW", 16)
    rng = np.random.default_rng(6)
    for n in (3, 40, 100):
        bits = rng.choice(np.array([0, 1, 3, 7, 0xFFFF, 0xFF00FF00], np.uint32), n)
        stands, place = rng.random(n) < 0.5, np.sort(rng.integers(0, n // 2 + 1, n)).astype(np.float32)
        i, c, more = linededup.candidates(bits, stands, place, 2, first)
        ok = lambda a, b: a != b and place[b] <= place[a] and (stands[a] or stands[b]) and int(bits[a] ^ bits[b]).bit_count() <= 2  # noqa: B023, E731
        want = {a: {b for b in range(n) if ok(a, b)} for a in range(n)}
        got = {a: set(c[i == a].tolist()) for a in range(n)}
        for a in range(n):
            assert got[a] <= want[a] and bool(got[a]) == bool(want[a]) and len(got[a]) <= first
            if want[a]:
                assert min(want[a]) in got[a] and (bool(more[i == a].all()) or got[a] == want[a])


def test_line_report_of_like_lines(spark, monkeypatch):
    """A large group of like lines, most of them more than two edits from the earliest, in shares and windows of a few."""
    for name, v in (("FIRST", 1), ("WINDOW", 8), ("SHARE", 5)):
        monkeypatch.setattr(linededup, name, v)
    rng = random.Random(51)
    base = "the quick brown fox jumps over the lazy dog again"
    rows = [(d, "\n".join(edited(rng, base, rng.randint(0, 4)) for _ in range(3)) + "\nthis line stands on every single page") for d in range(60)]
    got = linededup.line_report(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert sorted(map(tuple, got), key=repr) == brute_lines(rows)


def test_like_lines_take_linear_time(monkeypatch):
    """Like lines under one signature: comparisons grow with their number, by less than a hundred a line."""
    rng, counted, plain = np.random.default_rng(7), [], linededup.apart
    monkeypatch.setattr(linededup, "apart", lambda a, b: counted.append(len(a) * len(b)) or plain(a, b))
    for n in (20_000, 200_000):
        bits = (np.uint32(1) << rng.integers(0, 4, n).astype(np.uint32)) ^ np.uint32(0xABCDEF)
        counted.clear()
        i, c, more = linededup.candidates(bits, np.ones(len(bits), bool), np.arange(len(bits), dtype=np.float32), 4, 4)
        assert len(np.unique(i)) == len(bits) - 1 and sum(counted) < 100 * n


def test_line_lengths_are_parameters(spark):
    rows = [(1, "ab\nabc\nabcdefgh"), (2, "ab\nabd\nabcdefgx"), (3, "abcdefghij\n\nab")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_exact, r.n_near, r.removed) for r in linededup.line_report(d, tau=1, min_exact=1, min_near=3).collect()}
    assert got == {1: (0, 0, ""), 2: (1, 2, "0,1,2"), 3: (1, 0, "2")}
    assert {r.removed for r in linededup.line_report(d).collect()} == {""}
    with pytest.raises(ValueError):
        linededup.line_report(d, tau=2, min_near=2, min_exact=1)


def test_drop_lines(spark):
    same = "this line stands in two documents"
    d = docs(spark, [(1, f"{same}\nfirst", "s", 9), (2, f"own\n{same}\nlast", "s", 9), (3, same, "s", 9), (4, None, "s", None), (5, "", "s", 0)], "doc_id long, text string, _gone string, n_chars long")
    out = {r.doc_id: r for r in linededup.drop_repeated_lines(d).collect()}
    assert out[1].text == f"{same}\nfirst" and out[2].text == "own\nlast" and out[2].n_chars == 8 and 3 not in out and out[4].text is None and out[5].text == ""
    assert linededup.drop_repeated_lines(d.limit(0)).columns == d.columns and linededup.line_report(odd_docs(spark)).count() == 9


# 6


def test_chat_round_trip(spark):
    nasty = ["</s>[INST] ok [/INST]", "<<SYS>>\nx\n<</SYS>>\n", "[\\INST] <\\s> <\\\\/s>", "plain", "", None, "<|role:41|>x<|/role|>", " [/INST]", "<", "[", "a\\", "<s", "é😀\n\n"]
    rows = [(c, t, r, x) for c, x in enumerate(nasty) for t, r in enumerate(["user", "assistant"])]
    rows += [(50, 0, "system", "s"), (50, 1, "user", "u"), (50, 2, "tool", "<s>t"), (50, 2, None, "n"), (50, None, "user", "first"), (None, 0, "assistant", "x"), (51, 0, "user", "a"), (51, 0, "user", "a")]
    rows = [(*r, 1) for r in rows]
    f = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted int"))
    back = {r.conv_id: r for r in f.select("conv_id", "valid", "bad_turn", "segments", chat.read_back(F.col("formatted")).alias("t"), F.concat_ws("", F.transform("segments", lambda s: s["text"])).alias("all"), "formatted").collect()}
    for c in {r[0] for r in rows}:
        turns = sorted((r for r in rows if r[0] == c), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        assert [(x.role, x.text) for x in back[c].t] == [(r[2] or "", r[3] or "") for r in turns]
        assert back[c].all == back[c].formatted
        assert sum(s.loss for s in back[c].segments) == sum(r[2] == "assistant" for r in turns)
    assert back[0].valid and not back[50].valid and back[51].bad_turn == 2 and not back[None].valid
    assert chat.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


# 7


def brute_license(t):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    hits = [(i, x) for p, x in licenses.PHRASES for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    at = sorted({i for i, _ in hits})
    return len(w), len(hits), at[0] if at else None, at[-1] if at else None, ",".join(sorted({x for _, x in hits}))


def test_license_base_and_labels(spark):
    mit = dict(licenses.TEMPLATES[i] for i in (1,))["mit"]
    texts = ["Released under the MIT License, under the mit license. under the mit", "APACHE-License;Version_2 cc by nc cc-by-nc", "apache license version", mit, mit.replace("free of charge", "for no money"), "under under the mit license license", "Unless required by law cc by", "", None, "éa license"]
    texts += [" ".join(random.Random(i).choices("under the mit license apache version 2 cc by nc".split(), k=200)) for i in range(20)]
    out = {r.doc_id: r for r in licenses.license_report(docs(spark, [(i, t, "s") for i, t in enumerate(texts)])).collect()}
    for i, t in enumerate(texts):
        r = out[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute_license(t)
        assert 0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
    assert out[3].labels == "mit" and out[3].score == 1.0 and out[4].labels == "mit" and 0.75 < out[4].score < 1 and out[7].score == 0
    assert licenses.license_report(odd_docs(spark)).count() == 9


def brute_covered(t):
    """Best covered part by label: all maximal common runs of at least MIN_RUN tokens, found pair by pair, and every chain of them."""
    w = [x.decode() for x in licenses.tokens(t.encode())]
    out = {}
    for label, template in licenses.TEMPLATES:
        x = [y.decode() for y in licenses.tokens(template.encode())]
        parts = []
        for i in range(len(w)):
            for j in range(len(x)):
                if w[i] == x[j] and not (i and j and w[i - 1] == x[j - 1]):
                    n = 0
                    while i + n < len(w) and j + n < len(x) and w[i + n] == x[j + n]:
                        n += 1
                    if n >= licenses.MIN_RUN:
                        parts.append((i, j, n))
        best = []
        for f, a, m in sorted(parts):
            fits = [(c + m - over) for fe, ae, c in best if -2 * licenses.MAX_GAP <= f - fe <= licenses.MAX_GAP and ae <= a + m and fe <= f + m and (over := max(0, fe - f, ae - a)) < m]
            best.append((f + m, a + m, max([m, *fits])))
        if best:
            out[label] = max(out.get(label, 0), min(1.0, max(c for *_, c in best) / len(x)))
    return out


def test_license_labels_match_brute_force(spark):
    """Labels, scores and covered parts of edited templates."""
    rng = random.Random(71)
    texts = []
    for i in range(40):
        w = rng.choice(licenses.TEMPLATES)[1].split()
        for _ in range(rng.randint(0, 6)):
            at = rng.randrange(len(w))
            w[at : at + rng.randint(0, 2)] = rng.choices(["some", "other", "words", "license", "the"], k=rng.randint(0, 3))
        texts.append(" ".join(["intro"] * rng.randint(0, 3) + w + rng.choice(licenses.TEMPLATES)[1].split()[: rng.randint(0, 30)]))
    out = {r.doc_id: r for r in licenses.license_report(docs(spark, [(i, t, "s") for i, t in enumerate(texts)])).collect()}
    for i, t in enumerate(texts):
        want = brute_covered(t)
        assert {x.label: x.covered for x in out[i].spans} == pytest.approx(want)
        assert set(out[i].labels.split(",")) - {""} == set(out[i].base_labels.split(",")) - {""} | {k for k, v in want.items() if v >= licenses.COVERED}
        assert out[i].score == pytest.approx(1 if out[i].base_labels else max(want.values()))


def test_license_chains_are_not_capped():
    """A hundred short matches within the gap do not push out the chain that covers most."""
    s = licenses.Scanner(templates=(("x", "a b c d e f g h i j k l " + "p q r " * 80),), phrases=(("zz zz", "z"),))
    text = "a b c d e f g h i j k l " + "p q r " * 80
    assert s.scan(text.encode())[2]["x"] == 1.0


def test_automaton_is_exact():
    rng = random.Random(7)
    seqs = [[rng.randrange(3) for _ in range(rng.randint(1, 9))] for _ in range(6)]
    a = licenses.Automaton()
    for i, s in enumerate(seqs):
        a.add(i, s)
    a.close(seqs)
    for n in range(1, 7):
        for _ in range(300):
            s = tuple(rng.randrange(3) for _ in range(n))
            state = 0
            for c in s:
                state = a.moves[state].get(c) if state is not None else None
            want = {(i, j + n) for i, x in enumerate(seqs) for j in range(len(x) - n + 1) if tuple(x[j : j + n]) == s}
            assert (set() if state is None else a.ends[state]) == want


# 8


def naive_pack(sizes, caps):
    """Best fit that opens the smallest length that holds a piece, looking at every bin each time."""
    caps, bins, home = sorted(caps), [], {}
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        fits = [(b["room"], -b["last"], k) for k, b in enumerate(bins) if b["room"] >= sizes[i]]
        if fits:
            k = min(fits)[2]
        else:
            c = min(c for c in caps if c >= sizes[i])
            bins.append({"room": c, "used": 0, "last": 0})
            k = len(bins) - 1
        home[i] = k
        bins[k]["room"] -= sizes[i]
        bins[k]["used"] += sizes[i]
        bins[k]["last"] = len(home)
    return [home[i] for i in range(len(sizes))], [min(c for c in caps if c >= b["used"]) for b in bins]


def test_pack_matches_naive():
    rng = random.Random(8)
    for _ in range(60):
        caps = tuple(rng.sample([8, 16, 24, 32, 64], 3))
        sizes = [rng.randint(1, max(caps)) for _ in range(rng.randint(0, 60))]
        home, start, cap = packing.pack(sizes, caps)
        assert (home, cap) == naive_pack(sizes, caps)
        for b in set(home):
            parts = sorted((start[i], sizes[i]) for i in range(len(sizes)) if home[i] == b)
            assert all(x + n == y for (x, n), (y, _) in zip(parts, parts[1:])) and sum(n for _, n in parts) <= cap[b]


def test_pack_documents_plans_jointly(spark):
    """Uniform sizes open the length that they fill best; a long bin that stays half empty is downsized."""
    d = spark.range(60).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), 600).alias("text"))
    out = packing.pack_documents(d).collect()
    assert {r.capacity for r in out} == {2048} and len({r.bin for r in out}) == 20
    total = lambda caps: sum(packing.cost(c, max(packing.CAPACITIES)) for c in caps)
    sizes = [1200, 1200, 1200, 600]
    best = min(packing.plans(sizes), key=lambda p: total(p[2]))
    assert (best[2], best[3]) == ([4096, 1024], [4096, 4096])
    assert packing.pack_jointly(sizes) == best[:3] and total(best[2]) < total(packing.pack(sizes)[2])


def test_pack_jointly_is_whole():
    rng = random.Random(88)
    for _ in range(60):
        caps = tuple(rng.sample([8, 16, 24, 32, 64], 3))
        sizes = [rng.randint(1, max(caps)) for _ in range(rng.randint(0, 60))]
        home, start, cap = packing.pack_jointly(sizes, caps)
        assert len(home) == len(sizes) and set(home) == set(range(len(cap)))
        assert sum(packing.cost(c, max(caps)) for c in cap) <= sum(packing.cost(c, max(caps)) for c in packing.pack(sizes, caps)[2])
        for b in set(home):
            parts = sorted((start[i], sizes[i]) for i in range(len(sizes)) if home[i] == b)
            assert parts[0][0] == 0 and all(x + n == y for (x, n), (y, _) in zip(parts, parts[1:])) and sum(n for _, n in parts) <= cap[b]


def cheapest(sizes, caps, cut):
    """The least cost of any packing and cutting, by trying all partitions of the pieces."""
    price = lambda used: min(packing.cost(c, max(caps)) for c in caps if c >= used)
    best = math.inf
    for most in caps:
        flat = [x for n in sizes for x in packing.pieces(n, most)]
        if len(flat) > 8:
            continue  # so many cuts alone cost more than what is compared

        def put(i, bins, flat=flat):
            if i == len(flat):
                yield sum(map(price, bins))
                return
            for b in range(len(bins)):
                if bins[b] + flat[i] <= max(caps):
                    yield from put(i + 1, [*bins[:b], bins[b] + flat[i], *bins[b + 1 :]])
            yield from put(i + 1, [*bins, flat[i]])

        best = min(best, min(put(0, [])) + cut * (len(flat) - len(sizes)))
    return best


def test_pack_is_near_the_optimum():
    """Against all packings of a few documents, and against best fit at every single length and at the smallest fitting one."""
    rng, above, shrunk, caps = random.Random(80), 0, 0, packing.CAPACITIES
    total = lambda parts, bins: sum(packing.cost(c, max(caps)) for c in bins) + packing.CUT * (sum(map(len, parts)) - len(parts))
    gap = []
    for _ in range(40):
        sizes = [rng.choice([rng.randint(1, 700), rng.randint(1, 2100), rng.randint(1, 4096)]) for _ in range(rng.randint(1, 5))]
        parts, home, start, bins = packing.pack_whole(sizes)
        best, mine = cheapest(sizes, caps, packing.CUT), total(parts, bins)
        assert best <= mine <= 1.6 * best
        gap.append(mine / best)
        assert [sum(p) for p in parts] == sizes
    assert sum(gap) / len(gap) < 1.08
    for hi in (300, 900, 3000, 9000):
        sizes = [rng.randint(1, hi) for _ in range(1500)]
        parts, home, start, bins = packing.pack_whole(sizes)
        for one in caps:
            cut = [packing.pieces(n, one) for n in sizes]
            assert total(parts, bins) <= total(cut, packing.pack([x for p in cut for x in p], (one,))[2])
        cut = [packing.pieces(n, max(caps)) for n in sizes]
        assert total(parts, bins) < total(cut, packing.pack([x for p in cut for x in p])[2])
        largest = Counter()
        for b, n in zip(home, (x for p in parts for x in p)):
            largest[b] = max(largest[b], n)
        above += sum(c > min(x for x in caps if x >= largest[b]) for b, c in enumerate(bins))
        flat = [x for p in parts for x in p]
        shrunk += sum(a != b for p in packing.plans(flat, longest=max(caps)) for a, b in zip(p[2], p[3]))
    assert above > 0 and shrunk > 0


def test_pack_refills_beyond_any_fixed_length():
    """Bins that are not full are packed again over all lengths: cheaper than every plan with a fixed least length, with bins that shrink."""
    caps, better, shrunk = packing.CAPACITIES, 0, 0
    price = lambda bins: sum(packing.cost(c, max(caps)) for c in bins)
    rng = random.Random(81)
    for _ in range(60):
        sizes = [rng.choice([rng.randint(1, 500), rng.randint(500, 1100), rng.randint(1100, 3000)]) for _ in range(rng.randint(2, 12))]
        fixed = [packing._planned(sizes, caps, lambda n, names, counts, k=k: max(k, next(i for i, c in enumerate(caps) if c >= n))) for k in range(len(caps))]
        home, start, bins = packing.pack_jointly(sizes, caps)
        assert price(bins) <= min(price(p[2]) for p in fixed)
        better += price(bins) < min(price(p[2]) for p in fixed) - 1e-9
        shrunk += any(a != b for p in fixed for a, b in zip(p[2], p[3]))
        for b, c in enumerate(bins):
            parts = sorted((start[i], sizes[i]) for i in range(len(sizes)) if home[i] == b)
            assert parts[0][0] == 0 and all(x + n == y for (x, n), (y, _) in zip(parts, parts[1:])) and sum(n for _, n in parts) <= c
    assert better >= 5 and shrunk > 0


def test_pack_is_near_its_bound(spark):
    """No packing costs less than the bound; that of the test table comes within a thousandth of it."""
    rng, caps = random.Random(82), packing.CAPACITIES
    whole = lambda parts, bins: sum(packing.cost(c, max(caps)) for c in bins) + packing.CUT * sum(len(p) - 1 for p in parts)
    for _ in range(60):
        sizes = [rng.choice([rng.randint(1, 700), rng.randint(1, 2100), rng.randint(1, 9000)]) for _ in range(rng.randint(1, 5))]
        assert packing.least_cost(sizes) <= cheapest(sizes, caps, packing.CUT) + 1e-6
    sizes = [len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("text").collect()]
    parts, home, start, bins = packing.pack_whole([n for n in sizes if n])
    assert 1 <= whole(parts, bins) / packing.least_cost(sizes) < 1.001


def test_pack_does_not_depend_on_partitions(spark):
    rng = random.Random(83)
    rows = [(rng.choice([None, *range(80)]), "w " * rng.randint(0, 900)) for _ in range(200)] + [(5, "a b c")] * 3
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = [sorted(map(repr, packing.pack_documents(x, shard=20).collect())) for x in (d.repartition(1), d.repartition(7), d.orderBy(F.rand(1)))]
    assert got[0] == got[1] == got[2] and len({r.bin >> 32 for r in packing.pack_documents(d, shard=20).collect() if r.bin is not None}) > 3


def test_pack_documents_whole(spark):
    d = odd_docs(spark)
    out = packing.pack_documents(d, shard=3).collect()
    assert sum(r.n_words for r in out) == 6 + 6 + 2 + 30_000 + 1
    assert all(r.start + r.n_words <= r.capacity for r in out if r.bin is not None)
    assert sum(r.bin is None for r in out) == 4 and packing.pack_documents(d.limit(0)).count() == 0


# 9


def test_cover_tree_exact(spark):
    rng = np.random.default_rng(9)
    rows = [(i, (rng.normal(size=6) * rng.choice([0.1, 3])).tolist()) for i in range(400)]
    rows += [(400 + i, [1.0] * 6) for i in range(40)] + [(500, None), (550, [1.0, None] + [0.0] * 4), (600, [math.nan] * 6), (650, [math.inf] * 6), (700, [0.5] * 3), (750, [0.25] * 3), (800, []), (None, [2.0] * 6), (50, rows[50][1])]
    got = covertree.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0).collect()
    fine = {(i, tuple(math.floor(256 * x) for x in v)) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)}
    want = []
    for q, v in fine:
        if q is not None and q % 50 == 0:
            near = sorted((-sum(a * b for a, b in zip(v, w)), i is None, i or 0) for i, w in fine if i != q and len(w) == len(v))[:5]
            want += [(q, r, None if none else i, -s) for r, (s, none, i) in enumerate(near, 1)]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert covertree.top_k(spark.createDataFrame([], "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0).count() == 0


def test_cover_tree_prunes_blocks(spark, monkeypatch):
    """Clusters far apart: blocks around pivots, most pairs of blocks never meet, and nothing is lost; columns of any name."""
    monkeypatch.setattr(covertree, "DATA_BLOCK", 100)
    monkeypatch.setattr(covertree, "QUERY_BLOCK", 20)
    rng = np.random.default_rng(12)
    x = np.repeat(rng.normal(size=(20, 8)) * 5, 100, axis=0) + rng.normal(size=(2000, 8)) * 0.01
    d = spark.createDataFrame([(i, v.tolist(), 1, 2) for i, v in enumerate(x)], "vec_id long, `a.b` array<double>, dims int, v int")
    asks = F.col("vec_id") % 50 == 0
    got = covertree.top_k(d, asks, vector_col="a.b").collect()
    y = np.floor(256 * x)
    want = []
    for q in range(0, 2000, 50):
        s = y @ y[q]
        s[q] = -np.inf
        want += [(q, r, int(i), int(s[i])) for r, i in enumerate(np.lexsort((np.arange(2000), -s))[:5], 1)]
    assert sorted(map(tuple, got)) == sorted(want)
    assert covertree.compared_share(d, asks, vector_col="a.b") < 0.5


def test_cover_tree_prunes_clusters():
    rng = np.random.default_rng(1)
    x = np.floor(256 * (np.repeat(rng.normal(size=(20, 8)) * 5, 200, axis=0) + rng.normal(size=(4000, 8)) * 0.01))
    s, seen = covertree.Search(np.arange(0, 4000, 10), x[::10], 5), []
    plain = s._compare
    s._compare = lambda lo, hi, ids, y: (seen.append((hi - lo) * len(ids)), plain(lo, hi, ids, y))
    s.meet(np.arange(4000), x)
    assert sum(seen) < 0.4 * 400 * 4000
    score = x[::10] @ x.T
    score[np.arange(400), np.arange(0, 4000, 10)] = -1e18
    assert (np.sort(score, axis=1)[:, ::-1][:, :5] == s.score[np.argsort(s.ids)]).all()


# 10


def test_toxicity_held_out(spark):
    d, lab = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    out = toxicity.toxicity_scores(d, lab).join(lab, "doc_id").filter(toxicity.held_out(F.col("doc_id"))).collect()
    pairs = [(a.score, b.score) for a in out if a.toxic for b in out if not b.toxic]
    assert sum((a > b) + 0.5 * (a == b) for a, b in pairs) / len(pairs) > 0.7
    assert sum(r.score >= 0.3 and not r.toxic for r in out) <= 0.05 * len(out)


def test_toxicity_learns_from_whole_texts(spark):
    """What is toxic stands after 20 000 characters of each toxic document."""
    rng = random.Random(10)
    plain = ["".join(rng.choices("abcdefghij", k=5)) for _ in range(300)]
    bad = ["zquxvorkzy", "wyxzukvrox", "kvyzzoxwuq"]
    some = lambda n: " ".join(rng.choices(plain, k=n))
    rows = [(i, f"{some(3600)} {' '.join(bad)} {some(20)}" if i % 3 == 0 else some(3600), int(i % 3 == 0)) for i in range(150)]
    lab = spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id long, quality int, toxic int")
    new = [(1000, f"{some(3600)} {' '.join(bad)}"), (1001, some(3600))]
    d = spark.createDataFrame([r[:2] for r in rows] + new, "doc_id long, text string")
    score = {r.doc_id: r.score for r in toxicity.toxicity_scores(d, lab).collect()}
    assert score[1000] >= 0.9 and score[1001] < 0.3


def plain_score(model, text):
    """A text's score by a fresh compressor for each of its words, without any memory."""
    how = zstandard.ZstdCompressionParameters.from_level(toxicity.LEVEL, source_size=96, dict_size=len(model.ordinary) + len(model.toxic) + 10, write_content_size=0, write_checksum=0, write_dict_id=0, format=zstandard.FORMAT_ZSTD1_MAGICLESS)

    def length(content, x):
        d = zstandard.ZstdCompressionDict(model.ordinary + content + b"0123456789", dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        return len(zstandard.ZstdCompressor(dict_data=d, compression_params=how).compress(x))

    pad = (b"0123456789" * len(model.toxic))[: len(model.toxic)]
    lower = "".join(c.lower() if c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" else c for c in text).encode()
    parts = [w.strip(b".,;:!?\"'()[]{}*#$%&|<>") for w in lower.split()]
    windows = Counter(w[i : i + 64] for w in parts for i in range(0, len(w), 64))
    far = {}
    for w in windows:
        saved = [length(pad, b" " + w + b" " + c) - length(model.toxic, b" " + w + b" " + c) for c in model.carriers]
        far[w] = saved[0] if saved[0] < toxicity.SUSPECT else sum(saved) / len(saved)
    top = sorted(far.values(), reverse=True)[: toxicity.TOP]
    hits, strong = (sum(n for w, n in windows.items() if far[w] >= least) for least in (toxicity.SUSPECT, toxicity.STRONG))
    x = [1, max([0, *top]), sum(d for d in top[1:] if d >= toxicity.SUSPECT), math.log1p(hits), math.log1p(strong), min(1, 20 * hits / max(20, sum(windows.values())))]
    return 1 / (1 + math.exp(-sum(a * b for a, b in zip(model.weights, x))))


def test_toxicity_matches_plain_scorer(spark):
    d, lab = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(d, lab)
    rows = d.filter("length(text) < 3000").orderBy("doc_id").limit(60).collect()
    got = {r.doc_id: model.scorer().score((r.text or "").encode()) for r in rows}
    assert got == pytest.approx({r.doc_id: plain_score(model, r.text or "") for r in rows}, abs=1e-9)
    scored = {r.doc_id: r.score for r in toxicity.toxicity_scores(d, lab).collect()}
    assert all(scored[i] == s for i, s in got.items()) and len(scored) == d.count()
    kept = {r.doc_id for r in toxicity.keep_clean(d, lab).collect()}
    assert kept == {i for i, s in scored.items() if s < 0.3}


def test_toxicity_cross_validates_on_training_rows():
    rng = random.Random(4)
    words = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(200)]
    said = [(i, " ".join(rng.choices(words, k=40)) + (" zquxvorkzy wyxzukvrox" if i % 4 == 0 else ""), int(i % 4 == 0)) for i in range(240)]
    area, loss, caught, wrong = toxicity.cross_validated([(i, *toxicity._packed(toxicity._word_windows(t.encode())), y) for i, t, y in said])
    assert area > 0.99 and caught > 0.95 and wrong < 0.02 and loss < 0.2


def test_toxicity_columns_of_any_name(spark):
    lab = spark.createDataFrame([(1, 1, 1), (2, 1, 0)], "doc_id long, quality int, toxic int")
    d = docs(spark, [(1, "a b", "s"), (1, "c", "s"), (2, None, None)]).withColumn("a.b", F.lit(1)).withColumn("_row", F.lit(2))
    kept = toxicity.keep_clean(d, lab)
    assert kept.columns == d.columns and kept.count() <= 3


def test_toxicity_edges(spark):
    lab = spark.createDataFrame([(1, 1, 1)], "doc_id long, quality int, toxic int")
    d = odd_docs(spark)
    assert all(0 <= r.score <= 1 for r in toxicity.toxicity_scores(d, lab).collect())
    assert all(r.score < 1e-9 for r in toxicity.toxicity_scores(d, lab.limit(0)).collect())
    kept = toxicity.keep_clean(d, lab)
    assert kept.columns == d.columns and kept.count() == 9
    assert toxicity.toxicity_scores(d.limit(0), lab).count() == 0
    ids = spark.createDataFrame([(i,) for i in range(50)] + [(None,)], "doc_id long")
    assert all(r.h == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in ids.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("h")).collect())


# Pipeline


def sql_over(rows, sql):
    """A query of this subpackage's SQL over documents given as rows."""
    con = duckdb.connect()
    frame = pa.table({c: pa.array([r[c] for r in rows], t) for c, t in (("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64()))})
    con.register("documents", frame)
    return con.sql(sql).fetchdf()


def test_pipeline(spark, sf):
    import corpus_pipeline as p

    assert [n for n, _ in p.STAGES] == ["toxicity", "line_dedup", "ngram_jaccard", "source_mix", "best_fit_packing"]
    d = spark.read.parquet(f"{sf}/documents.parquet")
    rows = d.collect()
    model = toxicity.fit(d, spark.read.parquet(f"{sf}/labels.parquet"))
    for i, (_, stage) in enumerate(p.STAGES):
        before = rows
        d = stage(spark, d, sf)
        rows = d.collect()
        if i < 4:
            assert d.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            d = spark.createDataFrame(rows, DOCS)
        if i == 0:
            kept = {r.doc_id for r in rows}
            assert all((plain_score(model, r.text or "") < 0.3) == (r.doc_id in kept) for r in before if len(r.text or "") < 1500)
            assert len(rows) == len(kept) and 0.7 * len(before) < len(rows)
        if i == 1:
            gone = {int(r.doc_id): set(map(int, filter(None, r.removed.split(",")))) for r in sql_over(before, oracle_sql()["op5_segment_lines"]).itertuples()}
            want = {r.doc_id: "\n".join(x for j, x in enumerate((r.text or "").split("\n")) if j not in gone[r.doc_id]) for r in before}
            assert {r.doc_id: r.text or "" for r in rows} == {r.doc_id: want[r.doc_id] for r in before if not gone[r.doc_id] or want[r.doc_id].strip()}
        if i == 2:
            assert {r.doc_id for r in rows} == {c for _, _, c in brute_components([(r.doc_id, r.text) for r in before])}
        if i == 3:
            want = sql_over(before, oracle_sql()["op1_pareto_mix"])
            got = Counter(r.doc_id for r in rows)
            assert all(got[int(r.doc_id)] == r.taken // r.size for r in want.itertuples() if r.size)
    sized = sorted((r.doc_id, len((r.text or "").split())) for r in before)
    parts, home, start, caps = packing.pack_whole([n for _, n in sized if n])
    want = [(i, j, n) for (i, _), part in zip([x for x in sized if x[1]], parts) for j, n in enumerate(part)]
    assert sorted((r.doc_id, r.piece, r.n_words) for r in rows if r.n_words) == sorted(want)
    assert Counter(dict.fromkeys([(r.bin, r.capacity) for r in rows if r.n_words])).keys() and sorted(c for _, c in {(r.bin, r.capacity) for r in rows if r.n_words}) == sorted(caps)
