"""Toxicity by compression distance: two zstandard dictionaries, window compression lengths, calibrated thresholds.

Two dictionaries are trained on windows of labelled text: both hold the language of ordinary text, and one
also holds what is peculiar to toxic text, in its place the other holds as many neutral bytes.  A window
is one word before a fixed carrier text, so that each compresses to one block whose length moves by whole
matches.  How many bytes shorter a window is under the toxic dictionary is its distance; a document's
score follows from its largest distances through a calibration on labelled documents that the
dictionaries were not trained on.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import astuple, dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sextant.llm import kernels as K
from sextant.llm.base import every, small_join, written

# RATIO, LEAST and SUSPECT have the least logarithmic loss of cross_validated() over the training rows of two sizes of
# the test tables, added up; no held-out row took part in the choice.
#: Bytes of the ordinary and the toxic part of the dictionaries; level and length of a gram.
ORDINARY, TOXIC, LEVEL, GRAM = 28_000, 6_144, 12, 5
#: A gram speaks for toxicity from this ratio of document frequencies on, if so many toxic documents have it.
RATIO, LEAST = 3.5, 4
#: Carriers over whose lengths a suspicious window's distance is averaged; its first distance must reach SUSPECT.
CARRIERS, SUSPECT, STRONG = 6, 3, 3.5
#: The only sample: labelled documents per class, chosen by a hash of the id, each with its whole text.
SAMPLE_TOXIC, SAMPLE_ORDINARY = 1_500, 3_000
#: Window lengths remembered by a task, and windows of a document that its score looks at.
CACHE, TOP = 150_000, 5
#: The compressor finds no match that begins in a dictionary's last bytes.
_TAIL = b"0123456789"
_EDGE = b".,;:!?\"'()[]{}*#$%&|<>"


def _word_windows(text: bytes) -> Counter[bytes]:
    """The windows of a lower-cased text with their counts; a very long word gives one window per 64 bytes."""
    out: Counter[bytes] = Counter()
    for w, n in Counter(text.translate(K.LOWER).split()).items():
        w = w.strip(_EDGE)
        for i in range(0, len(w), 64):
            out[w[i : i + 64]] += n
    return out


def _packed(windows: Counter[bytes]) -> tuple[bytes, bytes]:
    """Windows and their counts as they travel; no window holds white space."""
    return b" ".join(windows), np.fromiter(windows.values(), np.int64, len(windows)).tobytes()


def _unpacked(windows: bytes, counts: bytes) -> dict[bytes, int]:
    return dict(zip(windows.split(b" "), np.frombuffer(counts, np.int64).tolist()))


def _grams(w: bytes) -> set[bytes]:
    w = b" " + w + b" "
    return {w[i : i + GRAM] for i in range(max(1, len(w) - GRAM + 1))}


@dataclass
class Model:
    """Raw dictionary contents, carriers, and the calibration."""

    ordinary: bytes
    toxic: bytes
    carriers: list[bytes]
    weights: list[float]

    def scorer(self) -> Scorer:
        return Scorer(self)


class Scorer:
    """Compressors of one model, with the distances of windows that it has seen."""

    def __init__(self, model: Model):
        self.model, self.seen = model, {}

        def compressor(content: bytes) -> zstandard.ZstdCompressor:
            how = zstandard.ZstdCompressionParameters.from_level(LEVEL, source_size=96, dict_size=len(content), write_content_size=0, write_checksum=0, write_dict_id=0, format=zstandard.FORMAT_ZSTD1_MAGICLESS)
            return zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=how)

        pad = (b"0123456789" * (len(model.toxic) // 10 + 1))[: len(model.toxic)]
        self.plain, self.toxic = compressor(model.ordinary + pad + _TAIL), compressor(model.ordinary + model.toxic + _TAIL)

    def distance(self, w: bytes) -> float:
        """Bytes that the toxic dictionary saves on a window: the mean over all carriers if the first is suspicious."""
        d = self.seen.get(w)
        if d is None:
            d = self._saved(w, self.model.carriers[0])
            if d >= SUSPECT:
                d = sum(self._saved(w, c) for c in self.model.carriers) / len(self.model.carriers)
            if len(self.seen) >= CACHE:
                self.seen.clear()
            self.seen[w] = d
        return d

    def _saved(self, w: bytes, carrier: bytes) -> float:
        x = b" " + w + b" " + carrier
        return len(self.plain.compress(x)) - len(self.toxic.compress(x))

    def features(self, windows: dict[bytes, int]) -> list[float]:
        """1, the largest distance, the next ones together, how many windows are suspicious, how many strongly, how densely."""
        found = [(self.distance(w), n) for w, n in windows.items()]
        top = sorted((max(d, 0.0) for d, _ in found), reverse=True)[:TOP] + [0.0] * TOP
        hits = sum(n for d, n in found if d >= SUSPECT)
        strong = sum(n for d, n in found if d >= STRONG)
        return [1.0, top[0], sum(x for x in top[1:TOP] if x >= SUSPECT), float(np.log1p(hits)), float(np.log1p(strong)), min(1.0, 20 * hits / max(20, sum(windows.values())))]

    def judge(self, windows: dict[bytes, int]) -> float:
        z = float(np.dot(self.model.weights, self.features(windows)))
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))

    def score(self, text: bytes) -> float:
        return self.judge(_word_windows(text))


def _dictionaries(toxic: list[tuple[bytes, bytes]], plain: list[tuple[bytes, bytes]]) -> tuple[bytes, bytes]:
    """Contents of the dictionaries: frequent ordinary windows; spans of toxic windows that grams mark."""
    ours, theirs, common = Counter(), Counter(), Counter()
    rare, whole = Counter(), Counter()
    for t in toxic:
        ws = _unpacked(*t)
        ours.update(set().union(*map(_grams, ws)) if ws else ())
    for t in plain:
        ws = _unpacked(*t)
        common.update(ws.keys())
        theirs.update(set().union(*map(_grams, ws)) if ws else ())
    a, b = len(toxic) + 1, len(plain) + 1
    marked = {g for g, n in ours.items() if n >= LEAST and (n + 0.5) / a > RATIO * (theirs[g] + 0.5) / b}
    for t in toxic:
        for w in _unpacked(*t):
            x = b" " + w + b" "
            n = [ours[x[i : i + GRAM]] if x[i : i + GRAM] in marked else 0 for i in range(max(1, len(x) - GRAM + 1))]
            i = n.index(max(n))
            if not n[i]:
                continue
            # The span goes on as far as its grams are about as frequent: a stem without its endings.
            j = i
            while i and 2 * n[i - 1] >= max(n):
                i -= 1
            while j + 1 < len(n) and 2 * n[j + 1] >= max(n):
                j += 1
            rare[x[i : j + GRAM]] += 1
            whole[x] += 1
    spans: list[bytes] = []
    room = TOXIC
    for found in (rare, whole):  # stems first, then whole windows while there is room
        for s, n in sorted(found.items(), key=lambda kv: (-kv[1], kv[0])):
            if n >= LEAST and len(s) <= room and not any(s in t for t in spans):
                spans.append(s)
                room -= len(s)
    usual = sorted(common.items(), key=lambda kv: (-kv[1], kv[0]))[:6000]
    return b" ".join(w for w, _ in reversed(usual))[-ORDINARY:], b"".join(reversed(spans))


def _fit(x: np.ndarray, y: np.ndarray) -> list[float]:
    """Logistic weights by Newton steps with a small ridge."""
    w = np.zeros(x.shape[1])
    ridge = np.diag([1e-3] + [1e-2] * (x.shape[1] - 1))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (p - y) + ridge @ w)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return w.tolist()


def train(rows: list[tuple[int, bytes, bytes, int]], odds: float | None = None) -> Model:
    """A model from labelled rows (id, windows and counts as packed, toxic). Two thirds train the dictionaries, one third the calibration.

    odds: toxic rows per ordinary row where the rows come from; the sample may hold more toxic ones.
    """
    rows = sorted(rows, key=lambda r: (zlib.crc32(b"split:%d" % r[0]), r[0]))
    texts = [(r[1:3], r[3], zlib.crc32(b"part:%d" % r[0]) % 3) for r in rows]
    ordinary, toxic = _dictionaries([t for t, y, p in texts if y and p], [t for t, y, p in texts if not y and p])
    tail = [ordinary[i : i + 24] for i in range(max(0, len(ordinary) - 24 * CARRIERS), max(1, len(ordinary) - 23), 24)][:CARRIERS] or [b"of the and in to a is on"]
    model = Model(ordinary, toxic, tail[::-1], [0.0] * 6)
    scorer = model.scorer()
    seen = [(scorer.features(_unpacked(*t)), y) for t, y, p in texts if not p]
    if len({y for _, y in seen}) < 2:
        model.weights[0] = -30.0  # nothing is known of one class
        return model
    model.weights = _fit(np.array([f for f, _ in seen]), np.array([y for _, y in seen], float))
    ones = sum(y for _, y in seen)
    if odds:
        model.weights[0] += float(np.log(odds * (len(seen) - ones) / ones))
    return model


def cross_validated(rows: list[tuple[int, bytes, bytes, int]], folds: int = 3) -> tuple[float, float, float, float]:
    """(area under the curve, logarithmic loss, recall, false positives at 0.3) of rows scored by models of the other folds.

    The constants above were chosen by this, on training rows only.
    """
    scored: list[tuple[float, int]] = []
    for f in range(folds):
        mine = [r for r in rows if zlib.crc32(b"fold:%d" % r[0]) % folds == f]
        model = train([r for r in rows if zlib.crc32(b"fold:%d" % r[0]) % folds != f])
        scorer = model.scorer()
        scored += [(scorer.judge(_unpacked(r[1], r[2])), r[3]) for r in mine]
    p, y = np.array([s for s, _ in scored]), np.array([t for _, t in scored])
    rank = np.searchsorted(np.sort(p), p, "left") + np.searchsorted(np.sort(p), p, "right") + 1
    ones = int(y.sum())
    area = (rank[y == 1].sum() / 2 - ones * (ones + 1) / 2) / (ones * (len(y) - ones))
    safe = np.clip(p, 1e-6, 1 - 1e-6)
    return float(area), float(-np.mean(y * np.log(safe) + (1 - y) * np.log(1 - safe))), float((p[y == 1] >= 0.3).mean()), float((p[y == 0] >= 0.3).mean())


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves 2 modulo 4; null ids are not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _windows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, windows, counts, toxic) of rows (doc_id, text, toxic), over their whole texts."""
    for batch in batches:
        found = [_packed(_word_windows(x.as_buffer().to_pybytes() if x.is_valid else b"")) for x in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([w for w, _ in found], pa.binary()), pa.array([n for _, n in found], pa.binary()), batch.column(2)], ["doc_id", "windows", "counts", "toxic"])


def fit(docs: DataFrame, labels: DataFrame, *, toxic_rows: int = SAMPLE_TOXIC, ordinary_rows: int = SAMPLE_ORDINARY) -> Model:
    """Train on a bounded sample of labelled rows outside the held-out quarter: the ids smallest by hash of each class."""
    known = labels.filter(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")) & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    by = F.xxhash64(F.lit("toxicity"), "doc_id")
    pick = lambda y, n: known.filter(F.col("toxic") == y).orderBy(by, "doc_id").limit(n)
    ids = written(pick(1, toxic_rows).union(pick(0, ordinary_rows)), "toxicity-sample")
    sample = small_join(docs.select("doc_id", "text"), ids, ["doc_id"]).select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("toxic").cast("int").alias("toxic"))
    rows = sample.mapInArrow(K.tidy(_windows), "doc_id long, windows binary, counts binary, toxic int")
    # Where an id repeats, the row whose windows come first by a digest, whatever the order of rows.
    rows = rows.groupBy("doc_id").agg(F.min_by(F.struct("windows", "counts", "toxic"), F.struct(F.sha2("windows", 256), F.sha2("counts", 256))).alias("r")).select("doc_id", "r.*").collect()
    n = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    return train([(r.doc_id, bytes(r.windows), bytes(r.counts), r.toxic) for r in rows], n.get(1, 0) / max(1, n.get(0, 0)))


def _scores(model):
    """score in place of the text of rows (key, text)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Model(*model.value).scorer()
        for batch in batches:
            out = [scorer.score(x.as_buffer().to_pybytes() if x.is_valid else b"") for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64())], ["doc_id", "score"])

    return run


def _clean(model, at: int, threshold: float):
    """Rows (row) whose text, the field at, scores below the threshold."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Model(*model.value).scorer()
        for batch in batches:
            texts = batch.column(0).field(at)
            yield batch.filter(pa.array([scorer.score(x.as_buffer().to_pybytes() if x.is_valid else b"") < threshold for x in texts], pa.bool_()))

    return run


def toxicity_scores(docs: DataFrame, labels: DataFrame, **sample) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id and score, 0 to 1, of the whole text.

    Null and empty texts, and texts without words, score what no evidence gives.  Very long texts are scored
    whole, their words counted once each.  Repeated rows score alike; so do ties in the sample, which goes by
    hash of the id.  Without labelled rows of both classes all scores are about 0.  An empty table gives no
    scores.  Other columns are not read, whatever their names; labels are read only to train.
    """
    model = docs.sparkSession.sparkContext.broadcast(astuple(fit(docs, labels, **sample)))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(K.tidy(_scores(model)), "doc_id long, score double")


def keep_clean(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.3, **sample) -> DataFrame:
    """docs without the rows that score threshold or more; columns unchanged, whatever their names.

    Null and empty texts score what no evidence gives and stay, unless most labelled rows are toxic; repeated
    rows stay or go alike; whole texts are scored, however long.  An empty table stays empty.
    """
    model = docs.sparkSession.sparkContext.broadcast(astuple(fit(docs, labels, **sample)))
    d = docs.select(F.struct(*every(docs)).alias("_row"))
    return d.mapInArrow(K.tidy(_clean(model, docs.columns.index("text"), threshold)), d.schema).select("_row.*")
