"""Fill-in-the-middle, personal data and whitening against brute force and SQL, and their odd cases."""

import hashlib
import random
import re
import sys

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from sextant.llm import fim, pii, whitening
from sextant.llm.queries import QUERIES, oracle_sql
from tests.oracle import compare



def stored(folder, rows):
    """Rows (doc_id, text) as the documents table of a folder."""
    ids, texts = zip(*rows)
    pq.write_table(pa.table({"doc_id": pa.array(ids, pa.int64()), "text": pa.array(texts, pa.string())}), f"{folder}/documents.parquet")


# 11


def plain_fim(ident, text):
    """(n, form, prefix, middle, output) by one regular expression and slices of its matches."""
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    h = hashlib.sha256(f"42:{ident}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < 80:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def fim_rows():
    r = random.Random(4)
    words = ["a", "Öl", "<P", "S>", "<", ">", " ", "\x85", "𝛼", "long" * 40, "<M", "P>"]
    rows = [(i, "".join(r.choice(words) + r.choice([" ", "\n", "\t\x0b", "", "  "]) for _ in range(r.randint(0, 40)))) for i in range(400)]
    return rows + [(-5, "x y"), (1007, None), (1008, ""), (1009, " \n"), (1010, "in <S> it"), (1011, "w " * 100_000), (1011, "w " * 100_000), (None, "no id at all")]


def test_fim_matches_plain(spark):
    rows = fim_rows()
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("n", "form", "output", "_r", "_t")})
    out = fim.fill_in_middle(d).withColumn("back", fim.restored(F.col("output"), F.col("form"))).withColumn("digest", fim.restored_sha256(F.col("output"), F.col("form"))).collect()
    want = sorted((str(i), *plain_fim("" if i is None else i, t or "")) for i, t in rows)
    assert sorted((str(r.doc_id), r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in out) == want
    texts = {i: t or "" for i, t in rows}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert all(r.back == texts[r.doc_id] and r.digest == sha(texts[r.doc_id]) and r.output_sha256 == sha(r.output) for r in out)
    assert {r.form for r in out} == {"plain", "psm", "spm"}


def test_fim_rate_and_order():
    some = [fim.maker(seed=1, rate=90, suffix_first=0)(str(i), "a b c")[1] for i in range(2000)]
    assert 1700 < some.count("psm") < 1900 and "spm" not in some
    assert {fim.maker(rate=0)(str(i), "a b")[1] for i in range(50)} == {"plain"}


@pytest.mark.parametrize("marks", [("<a>", "<a>", "b"), ("", "x", "y"), ("ab", "bc", "d"), ("aa", "x", "y"), ("abc", "b", "d"), ("<", ">")])
def test_fim_marks_that_overlap_are_refused(marks):
    with pytest.raises(ValueError):
        fim.check_marks(marks)


def test_fim_of_nothing(spark):
    d = spark.createDataFrame([], "doc_id long, text string")
    assert fim.fill_in_middle(d).count() == 0


def test_fim_sql_on_odd_rows(spark, tmp_path):
    rows = [(i, t) for i, t in fim_rows() if i is not None and "\x85" not in (t or "") and " " not in (t or "")]
    stored(tmp_path, rows)
    compare(QUERIES["op11_fill_in_middle"](spark, str(tmp_path)), oracle_sql()["op11_fill_in_middle"], str(tmp_path))


# 12


def plain_luhn(v):
    d = [int(c) for c in v if c.isdigit()][::-1]
    return sum(d[0::2] + [sum(divmod(2 * x, 10)) for x in d[1::2]]) % 10 == 0


def plain_base(t):
    """The base spans by the patterns as they are written down."""
    digits = lambda v: len(re.findall("[0-9]", v))
    kinds = (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda v: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda v: all(int(p) <= 255 for p in v.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda v: 14 <= digits(v) <= 19 and plain_luhn(v)),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda v: 10 <= digits(v) <= 15),
    )
    return sorted((m.start(), i, m.end(), k) for i, (k, p, ok) in enumerate(kinds) for m in re.finditer(p, t or "") if ok(m.group()))


def card_number(r, n):
    v = [r.randint(0, 9) for _ in range(n - 1)]
    return "".join(map(str, v)) + next(str(c) for c in range(10) if plain_luhn("".join(map(str, [*v, c]))))


def pii_texts():
    r = random.Random(8)
    bits = ["@", ".", "a", "Z9", "b-c", "+", "1", "12", "255", "256", "0007", " ", "-", "(", ")", "é", "İ", "x@y.z", "@@", "..", "+1", "1.2.3.4", "1.2.3.4.5.6.7.8", "99.1.2.300", "%_", "\n", "4111 1111 1111 1111", "http://"]
    out = ["".join(r.choice(bits) for _ in range(r.randint(1, 25))) for _ in range(4000)]
    for _ in range(300):
        v = card_number(r, r.randint(12, 21))
        out.append("İé " + "".join(c + r.choice(["", "", "", " ", "-"]) for c in v) + r.choice(["", "7", " x", "--1"]))
        out.append(f"call +{r.randint(1, 99)} ({r.randint(100, 999)}) {r.randint(100, 999)}-{r.randint(1000, 9999)}{r.choice(['', ')', ' -', '. 5'])}")
    return out + [None, "", "a@b.c@d.e", "a@b@c.d", "a@b.c.@d.e", "9" * 5000, "1." * 5000, "+1" + "(" * 5000, "a" * 5000 + "@" + "b." * 3000, "1 " * 5000]


METHOD = {
    "see https://ann:pa55@host.example/x and sftp://a:b@c": [("login", "ann:pa55"), ("login", "a:b")],
    "http://host.example http://ann@host http://:x@h http://a:@h https://a:b:c@h": [("login", "a:b:c")],
    "IBAN: DE89 3704 0044 0532 0130 00 OK": [("iban", "DE89 3704 0044 0532 0130 00")],
    "iban GB82WEST12345698765432, iban GB83WEST12345698765432 ibanDE89370400440532013000": [("iban", "GB82WEST12345698765432")],
    "SSN 123-45-6789, ssn: 666-45-6789 ssn 900-12-3456 ssn#078 05 1120 xssn 123-45-6789 ssn 123-45-67890": [("ssn", "123-45-6789"), ("ssn", "078 05 1120")],
    "Social Security No. 123-45-6789": [("ssn", "123-45-6789")],
    "account number: 12345678 Account No. 12-3456 account 1234567 acct. = 1234567 acct no 12345": [("account", "12345678"), ("account", "12-3456"), ("account", "1234567")],
    "Passport no. AB123456 passport 123456789 passport number X1234567 passport number 1234567890 passport A12": [("passport", "AB123456"), ("passport", "123456789"), ("passport", "X1234567")],
    "İİ passport É passport AB123456\n": [("passport", "AB123456")],
    "the account of a passport, no number": [],
}


def test_pii_base_matches_patterns(spark):
    texts = pii_texts()
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns({c: F.lit(1) for c in ("found", "_t", "kind")}).repartition(3)
    got = {r.doc_id: [(s.start, s.no, s.end, s.kind) for s in r.found if s.no < 4] for r in pii.personal_data(d).collect()}
    assert got == {i: plain_base(t) for i, t in enumerate(texts)}
    assert {k: sum(s[3] == k for v in got.values() for s in v) > 20 for k in pii.BASE} == dict.fromkeys(pii.BASE, True)


def test_pii_method_spans_and_redaction(spark):
    for text, want in METHOD.items():
        got = [(pii.KINDS[n], text[a:b]) for a, n, b in pii.find(text, pii.automaton()) if n >= 4]
        assert got == want, text
    d = spark.createDataFrame([(1, "to a@b.cd or +1 (555) 123-4567, 10.0.0.1"), (2, "none"), (3, None), (4, "")], "doc_id long, text string")
    said = pii.personal_data(d).join(d, "doc_id").select("doc_id", pii.redacted(F.col("text"), F.col("found")).alias("t")).collect()
    assert {r.doc_id: r.t for r in said} == {1: "to [email] or [phone], [ip]", 2: "none", 3: None, 4: ""}
    assert pii.personal_data(d.limit(0)).count() == 0


def test_pii_small_letters_keep_places():
    assert all(len(c.replace("İ", "I").lower()) == 1 for c in map(chr, range(sys.maxunicode + 1)) if not 0xD800 <= ord(c) < 0xE000)


def test_pii_sql_on_odd_rows(spark, tmp_path):
    texts = [t for t in pii_texts() if not t or len(t) < 1000] + list(METHOD)
    stored(tmp_path, enumerate(texts))
    compare(QUERIES["op12_pii_anchors"](spark, str(tmp_path)), oracle_sql()["op12_pii_anchors"], str(tmp_path))


# 13


def plain_whitening(vectors, k=4):
    """By size of vector: n, sums, the first eigenvalues, unit eigenvectors, trace; by whole numbers, then NumPy."""
    xs = [tuple(int(np.floor(256 * float(c))) for c in v) for v in vectors if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    out = {}
    for d in {len(x) for x in xs if x}:
        fit = sorted({x for x in xs if len(x) == d})
        n, s = len(fit), [sum(c) for c in zip(*fit)]
        c = np.array([[(n * a - b) / n for a, b in zip(x, s)] for x in fit])
        e, u = np.linalg.eigh(c.T @ c / n)
        out[d] = n, s, e[::-1][:k], u.T[::-1][:k], (c * c).sum() / n
    return out


def test_whitening_matches_plain(spark):
    r = np.random.default_rng(3)
    rows = [[float(x) for x in (np.array([3.0, 40.0, -7.0, 0.5, 0, 900.0]) + r.normal(size=6) * [5, 2, 1, 0.2, 3, 0.7])] for _ in range(500)]
    rows += rows[:50] + [rows[0]] * 300 + [None, [1.0, None, 2.0, 3.0, 4.0, 5.0], [float("nan")] * 6, [float("inf")] * 6, [], [1.5, 2.5], [0.5, 7.0], [9.0, -3.0]]
    data = [(i if i != 5 else None, v) for i, v in enumerate(rows)]
    d = spark.createDataFrame(data, "vec_id long, embedding array<double>").withColumns({c: F.lit(0) for c in ("x", "n", "total", "whitened", "component")})
    got = {}
    for p in (1, 7):
        out = whitening.components(whitening.whiten(d.repartition(p))).collect()
        got[p] = {(r.vec_id, r.component): r for r in out}
    assert got[1].keys() == got[7].keys()
    want = plain_whitening(rows)
    ids = [(i, v) for i, v in data if v and all(c is not None and np.isfinite(c) for c in v)]
    assert got[1].keys() == {(i, j + 1) for i, v in ids for j in range(min(4, len(v)))}
    sign = {}
    for p in (1, 7):
        for i, v in ids:
            n, s, e, u, trace = want[len(v)]
            x = [int(np.floor(256 * c)) for c in v]
            c = np.array([(n * a - b) / n for a, b in zip(x, s)])
            for j in range(len(e)):
                row = got[p][i, j + 1]
                assert row.n == n and row.deviation == sum((n * a - b) ** 2 for a, b in zip(x, s)) and abs(row.explained - e[j] / trace) < 1e-9 and row.identity_error < 1e-9
                value = c @ u[j] / np.sqrt(e[j])
                if abs(value) > 1e-6:
                    assert sign.setdefault((p, len(v), j), np.sign(value * row.whitened)) == np.sign(value * row.whitened)
                assert abs(abs(value) - abs(row.whitened)) < 1e-7


def test_whitening_without_variance(spark):
    rows = [(1, [2.0, 1.0]), (2, [2.0, 1.0]), (3, [0.25])]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    out = whitening.components(whitening.whiten(d)).orderBy("vec_id", "component").collect()
    assert [(r.vec_id, r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in out] == [(1, 1, 1, 0, None, None, 0), (1, 2, 1, 0, None, None, 0), (2, 1, 1, 0, None, None, 0), (2, 2, 1, 0, None, None, 0), (3, 1, 1, 0, None, None, 0)]
    line = spark.createDataFrame([(i, [float(i), 2.0 * i, 5.0]) for i in range(9)], d.schema)
    got = whitening.components(whitening.whiten(line)).collect()
    assert {r.component for r in got if r.whitened is None} == {2, 3} and abs(sum(r.whitened**2 for r in got if r.component == 1) / 9 - 1) < 1e-12
    assert {r.explained for r in got if r.component > 1} == {0.0} and max(r.identity_error for r in got) < 1e-9
    assert whitening.components(whitening.whiten(d.limit(0))).count() == 0 and whitening.whiten(d.select("vec_id", F.lit(None).cast("array<float>").alias("embedding"))).count() == 0


def test_whitening_takes_the_mean_off_exactly(spark):
    r = np.random.default_rng(5)
    rows = [[2.0**40 + float(a), -(2.0**41) + float(b)] for a, b in r.integers(-3, 4, (400, 2))]
    d = spark.createDataFrame(list(enumerate(rows)), "vec_id long, embedding array<double>")
    out = whitening.whiten(d).collect()
    n, s, e, u, trace = plain_whitening(rows)[2]
    assert all(x.n == n and x.identity_error < 1e-9 for x in out)
    for x in out:
        v = [int(256 * c) for c in rows[x.vec_id]]
        assert int(x.deviation) == sum((n * a - b) ** 2 for a, b in zip(v, s))
    assert np.allclose([x for x in out[0].explained], e / trace, rtol=1e-12)


def test_whitening_sums_are_exact():
    big = np.array([[2**62, -(2**62), 1], [2**62, -(2**62), 2], [2**62 - 1, 5, 3]], np.int64)
    total = {}
    whitening._sums(total, big)
    whitening._sums(total, big)
    n, s = total[3]
    assert n == 6 and [int(v) for v in s] == [2 * sum(int(v) for v in c) for c in big.T]
    with pytest.raises(ValueError):
        whitening._held({1: (1, np.zeros(3))}, 2, whitening.HELD)


def test_whitening_query_matches_plain(spark, sf):
    got = QUERIES["op13_whitening"](spark, sf).collect()
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    n, s, e, u, trace = plain_whitening([v for _, v in rows])[64]
    x = {i: [int(np.floor(256 * float(c))) for c in v] for i, v in rows}
    assert len(got) == 4 * len(rows) and {r.n for r in got} == {n}
    sign = {}
    for r in got:
        value = (np.array([n * a - b for a, b in zip(x[r.vec_id], s)]) / n) @ u[r.component - 1] / np.sqrt(e[r.component - 1])
        assert sign.setdefault(r.component, np.sign(value * r.whitened)) * value == pytest.approx(r.whitened, abs=1e-8)
        assert r.deviation == sum((n * a - b) ** 2 for a, b in zip(x[r.vec_id], s))
