"""Native chunkers against folds over a text, and that nothing leaves the JVM or grows faster than a text."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from sextant.functions.text import SPACE_CHARS, strip
from sextant.operators import chunking as C

BOUNDARY = re.compile("|".join((r"(?<=[.!?])\s+(?=[A-Z])", r"(?<=[.!?])\s+(?=[a-z])", r"(?<=[.!?])(?=\s)", r"(?<=\n)\s*(?=\S)")), re.MULTILINE)


def sentence_spans(text: str) -> list[tuple[str, int, int]]:
    """(sentence, start, end): start at its first character, end at the boundary after it."""
    cuts = [0, *(m.end() for m in BOUNDARY.finditer(text)), len(text)]
    out = []
    for a, b in zip(cuts, cuts[1:]):
        piece = text[a:b]
        if s := piece.strip():
            out.append((s, a + len(piece) - len(piece.lstrip()), b))
    return out


def sentence_pieces(text: str, most: int) -> list[dict]:
    """Sentences packed in order while their characters (not the joining spaces) stay within most."""
    out: list[dict] = []
    held: list[tuple[str, int, int]] = []
    used = 0
    for s in [*sentence_spans(text), None]:
        if held and (s is None or used + len(s[0]) > most):
            out.append({"content": " ".join(x[0] for x in held), "start_idx": held[0][1], "end_idx": held[-1][2], "sentence_count": len(held)})
            held, used = [], 0
        if s is not None:
            held.append(s)
            used += len(s[0])
    return out


@pytest.fixture(scope="module")
def texts():
    r = random.Random(1)
    bits = ["a", "Bc", "É", ".", "!", "?", " ", "\n", "\t", "  ", "\n\n", "1", "word ", "longer", "\x1c", "\xa0", "𝛼", "\r\n", ". A", ". b", ".1", "...", "\x85"]
    return ["".join(r.choice(bits) for _ in range(r.randint(0, 700))) for _ in range(500)] + ["", "   ", None, "x" * 3000, " " * 3000, "a " * 2000]


@pytest.mark.parametrize("size,overlap", [(500, 0), (500, 50), (120, 10), (120, 20), (150, 50), (101, 0), (40, 30)])
def test_fixed_matches_fold(spark, texts, size, overlap):
    d = spark.createDataFrame(list(enumerate(texts)), "id long, content string")
    got = {x.id: [tuple(p) for p in x.p] for x in d.select("id", C.fixed(F.col("content"), size, overlap).alias("p")).collect()}
    assert got == {i: [tuple(p.values()) for p in C.fixed_pieces(t or "", size, overlap, True)] for i, t in enumerate(texts)}


@pytest.mark.parametrize("most", [50, 201, 1000])
def test_sentences_match_fold(spark, texts, most):
    d = spark.createDataFrame(list(enumerate(texts)), "id long, content string")
    got = {x.id: [tuple(p) for p in x.p] for x in d.select("id", C.by_sentence(F.col("content"), 1, most).alias("p")).collect()}
    assert got == {i: [tuple(p.values()) for p in sentence_pieces(t or "", most)] for i, t in enumerate(texts)}


def test_chunkers_stay_in_the_jvm(spark):
    d = spark.createDataFrame([("a", "One. Two.")], "id string, content string")
    for x in (C.chunk_fixed(d, overlap=50, context=20), C.chunk_sentences(d, context=20)):
        plan = x._jdf.queryExecution().executedPlan().toString()
        assert "ArrowEval" not in plan and "Join" not in plan and "Exchange" not in plan
        # The pieces are made once: nothing asks for their number before.
        assert plan.count("regexp_extract_all") <= 4


def test_context_of_long_texts_takes_linear_time(spark):
    def took(n: int) -> float:
        d = spark.createDataFrame([("d", "ab é " * (n // 5))], "id string, content string")
        start = time.perf_counter()
        assert C.chunk_fixed(d, size=500, overlap=50, context=100).count() >= n // 450
        C.chunk_fixed(d, size=500, overlap=50, context=100).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    took(50_000)
    assert took(1_600_000) < 30 * max(took(200_000), 0.5)  # eight times the text; by the square it would be 64 times


def test_strip_takes_white_space_of_any_script(spark):
    chars = [chr(c) for c in range(0x3100) if not 0xD800 <= c < 0xE000]
    got = spark.createDataFrame([(c, f"{c}x{c}") for c in chars], "c string, t string").select("c", strip(F.col("t")).alias("s")).collect()
    assert {r.c for r in got if r.s == "x"} == set(SPACE_CHARS) == {c for c in chars if c.isspace()}


def test_running_sums(spark):
    xs = [list(range(n)) for n in (0, 1, 2, 15, 16, 17, 300, 1000)]
    got = [r.r for r in spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x array<int>").orderBy("i").select(C.running(F.col("x")).alias("r")).collect()]
    assert got == [[sum(x[:i]) for i in range(len(x))] for x in xs]
