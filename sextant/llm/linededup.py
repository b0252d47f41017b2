"""Line dedup over the corpus: exact repeats, and near repeats by a segment-partition edit join.

A line within ``tau`` edits of another one shares with it one of tau + 1 segments, up to a shift.  Every
distinct line therefore stands under its own segments, and looks under those substrings of itself that
can be a segment of a line of its length or up to tau shorter; only as many shifts are tried as a first
and a last edit allow.  Lines that meet are compared by the parity of their characters, then exactly by a
banded bit-parallel edit distance.  A line is compared with a few earlier lines that it meets under each of
its substrings, the earliest and those of the nearest parity; only if there are more of them and those few
do not settle it, with all the others, a share of the open lines at a time.

A line is removed if an equal line, or one within tau edits, comes earlier: documents in order of doc_id,
lines in order of their number.  Whether that earlier line is itself removed makes no difference.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sextant.llm import kernels as K
from sextant.llm.base import every, small_join, written
from sextant.tables import scratch

#: Edits that two near lines may be apart; characters from which lines are removed at all and compared by edits.
TAU, MIN_EXACT, MIN_NEAR = 2, 8, 24
#: Characters whose sums are held at a time.
CHARS = 1 << 20
#: Signatures packed at a time and per bucket; digests a task remembers; open lines of a run that one task compares.
PACK, PER_BUCKET, SEEN, SHARE = 1_000_000, 1_000_000, 200_000, 512
#: Earlier lines that a line is compared with at first in each run; lines of a run that are looked at together.
FIRST, WINDOW = 4, 1024

_SPACE = " \t\n\x0b\x0c\r"
_BASE = 0x9E3779B97F4A7C15 | 1


def _digest(line: str) -> bytes:
    return hashlib.blake2b(line.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def _lines(batches: Iterable[pa.RecordBatch], least: int = MIN_EXACT) -> Iterator[pa.RecordBatch]:
    """(doc_id, line_no, k, chars) per line that may be removed, and a row with line_no -1 per document: its lines."""
    for batch in batches:
        ids, nos, ks, chars = [], [], [], []
        for doc, text in zip(batch.column(0).to_pylist(), K.texts(batch.column(1))):
            full = 0
            for i, line in enumerate(text.split("\n")):
                line = line.strip(_SPACE)
                full += bool(line)
                if len(line) >= least:
                    ids.append(doc)
                    nos.append(i)
                    ks.append(_digest(line))
                    chars.append(len(line))
            ids.append(doc)
            nos.append(-1)
            ks.append(None)
            chars.append(full)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(nos, pa.int32()), pa.array(ks, pa.binary()), pa.array(chars, pa.int32())], ["doc_id", "line_no", "k", "chars"])


def segments(length: int, tau: int) -> list[tuple[int, int]]:
    """(start, size) of the tau + 1 segments of a line: as even as can be, the longer ones last."""
    size, more = divmod(length, tau + 1)
    out, at = [], 0
    for i in range(tau + 1):
        n = size + (i > tau - more)
        out.append((at, n))
        at += n
    return out


def probes(length: int, other: int, tau: int) -> list[tuple[int, int, int]]:
    """(segment, start, size) of substrings of a line that can be a segment of a line of length ``other`` <= length.

    Before the i-th segment at most i edits have happened if it is the first that matches, after it at
    most tau - i more; both bound how far it can have moved.
    """
    out, more = [], length - other
    for i, (at, n) in enumerate(segments(other, tau)):
        low = max(at - i, at + more - (tau - i), 0)
        high = min(at + i, at + more + (tau - i), length - n)
        out += [(i, s, n) for s in range(low, high + 1)]
    return out


class _Signer:
    """Signatures of lines: hashes of (length of the shorter line, segment, substring)."""

    def __init__(self, tau: int, least: int = MIN_NEAR):
        self.least, self.tau, self.shapes, self.power, self.inverse = least, tau, {}, np.ones(1, np.uint64), np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if n > len(self.power):
            n = max(n, 2 * len(self.power))
            up, down = np.full(n, _BASE, np.uint64), np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
            up[0] = down[0] = 1
            self.power, self.inverse = np.multiply.accumulate(up), np.multiply.accumulate(down)

    def shape(self, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, sizes and tags of a line's own segments, then of its probes."""
        if length not in self.shapes:
            rows = [(s, n, length, i) for i, (s, n) in enumerate(segments(length, self.tau))]
            for other in range(max(length - self.tau, self.least), length + 1):
                rows += [(s, n, other, i) for i, s, n in probes(length, other, self.tau)]
            x = np.array(rows, np.int64)
            if len(self.shapes) > 20_000:
                self.shapes.clear()
            self.shapes[length] = (x[:, 0], x[:, 1], K.mix((x[:, 2] * 8 + x[:, 3]).astype(np.uint64)))
        return self.shapes[length]

    def sign(self, lines: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of all lines together: signatures, line of each, whether it is the line's own, parities of the lines."""
        cps = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        self._grow(len(cps) + 1)
        sums = np.zeros(len(cps) + 1, np.uint64)
        np.cumsum((cps + np.uint64(1)) * self.power[: len(cps)], out=sums[1:])
        lens = np.array([len(x) for x in lines], np.int64)
        first = np.cumsum(lens) - lens
        bit = np.uint32(1) << (K.mix(cps) & np.uint64(31)).astype(np.uint32)
        parity = np.bitwise_xor.reduceat(bit, first)
        shapes = [self.shape(n) for n in lens.tolist()]
        count = np.array([len(s[0]) for s in shapes], np.int64)
        line = np.repeat(np.arange(len(lines)), count)
        a = np.concatenate([s[0] for s in shapes]) + first[line]
        b = a + np.concatenate([s[1] for s in shapes])
        sig = K.mix(((sums[b] - sums[a]) * self.inverse[a]) ^ np.concatenate([s[2] for s in shapes]))
        own = np.arange(len(line)) - np.repeat(np.cumsum(count) - count, count) <= self.tau
        return sig, line, own, parity


_PACKED = "bucket int, sigs binary, lines binary, own binary, parity binary, places binary"


def _signatures(tau: int, buckets: int, least: int):
    """Packed signatures by bucket of the distinct lines of a task's documents, again where an earlier document has a line.

    Places are ids as 32-bit floats, null ids last: rounded, but never in the wrong order.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer, seen, held, chars = _Signer(tau, least), {}, [], 0

        def pack() -> pa.RecordBatch:
            sig, line, own, parity = signer.sign([x for _, x, _ in held])
            name = np.array([int.from_bytes(k[:8], "little", signed=True) for k, _, _ in held], np.int64)[line]
            place = np.array([d for _, _, d in held], np.float32)[line]
            home = ((sig >> np.uint64(33)) % np.uint64(buckets)).astype(np.int32)
            order = np.argsort(home, kind="stable")
            a, b = K.runs(home[order])
            cut = [order[x:y] for x, y in zip(a, b)]
            blobs = lambda x: pa.array([x[o].tobytes() for o in cut], pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(home[order][a]), blobs(sig.astype(np.uint32)), blobs(name), blobs(own.astype(np.uint8)), blobs(parity[line]), blobs(place)], ["bucket", "sigs", "lines", "own", "parity", "places"])

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), K.texts(batch.column(1))):
                doc = np.inf if doc is None else doc
                for line in text.split("\n"):
                    line = line.strip(_SPACE)
                    if len(line) < least:
                        continue
                    k = _digest(line)
                    if seen.get(k, np.inf) <= doc and k in seen:
                        continue
                    if len(seen) < SEEN or k in seen:
                        seen[k] = doc
                    held.append((k, line, doc))
                    chars += len(line)
                    if chars >= CHARS or len(held) * (tau + 1) * (2 * tau + 1) >= PACK:
                        yield pack()
                        held, chars = [], 0
        if held:
            yield pack()

    return run


_MET = "run long, q long, x long, more boolean, members binary"


def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bits in which parities differ, all of one side with all of the other."""
    return np.bitwise_count(a[:, None] ^ b[None, :])


def candidates(bits: np.ndarray, stands: np.ndarray, place: np.ndarray, most: int, first: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(line, other line, whether line has more) for lines of a run in order of their places.

    Others are no later by the places, have a parity within ``most`` bits, and stand where the line only
    looks.  Of those in the first window that brings a line to ``first`` others, the earliest and the nearest are named;
    windows after it are not looked at, which counts as more.  Windows start small and grow, so a line among
    like ones is compared with a few of them and a run of such lines takes time in proportion to their
    number; lines without any such other look at all windows before them.
    """
    rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    n = len(bits)
    upto = np.searchsorted(place, place, "right")  # lines that are no later
    for lo in range(0, n, WINDOW):
        q = np.arange(lo, min(n, lo + WINDOW))
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        count = np.zeros(len(q), np.int64)
        open_ = np.ones(len(q), bool)
        at, step = 0, max(1, WINDOW // 64)
        while at < int(upto[q[-1]]):
            who = np.flatnonzero(open_ & (upto[q] > at))
            if not len(who):
                break
            c = np.arange(at, min(n, at + step))
            far = apart(bits[q[who]], bits[c])
            ok = (far <= most) & (c[None, :] < upto[q[who], None]) & (c[None, :] != q[who, None]) & (stands[q[who], None] | stands[None, c])
            i, j = np.nonzero(ok)
            found.append((who[i], c[j], far[i, j]))
            count += np.bincount(who[i], minlength=len(q))
            at, step = at + step, min(4 * step, WINDOW)
            stop = (count >= first) & (at < upto[q]) & open_
            count[stop] += 1  # windows that are not looked at
            open_ &= ~stop
        if not found:
            continue
        i, c, far = (np.concatenate(x) for x in zip(*found))
        if not len(i):
            continue
        order = np.lexsort((c, i))
        head = np.ones(len(i), bool)
        head[1:] = i[order][1:] != i[order][:-1]
        earliest = np.zeros(len(i), bool)
        earliest[order[head]] = True
        order = np.lexsort((c, far, ~earliest, i))
        start = np.searchsorted(i[order], i[order], "left")
        pick = order[np.arange(len(i)) - start < first]
        rows.append((q[i[pick]], c[pick], count[i[pick]] > first))
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    return tuple(np.concatenate(x) for x in zip(*rows))


def _meet(tau: int):
    """What meets under one signature: (run, q, x, more) for lines and their first candidates, and a run's members where one has more.

    Both kinds of rows are in proportion to the lines, however many meet.
    """

    def runs_of(bucket: int, parts: list[tuple]) -> Iterator[pa.RecordBatch]:
        sig, line, own, par, place = (np.concatenate([p[i] for p in parts]) for i in range(5))
        order = np.lexsort((place, 1 - own, line, sig))
        same = np.zeros(len(sig), bool)
        same[1:] = (sig[order][1:] == sig[order][:-1]) & (line[order][1:] == line[order][:-1])
        order = order[~same]  # own signatures first, so that a line that stands and looks counts as standing
        a, b = K.runs(sig[order])
        several = b - a > 1
        # Runs of two are most of them: all at once.
        two = a[b - a == 2]
        x, y = order[two], order[two + 1]
        ok = (np.bitwise_count(par[x] ^ par[y]) <= 2 * tau) & ((own[x] | own[y]) > 0)
        x, y = x[ok], y[ok]
        late = place[x] > place[y]
        x, y = np.where(late, y, x), np.where(late, x, y)
        tie = place[x] == place[y]
        q, z = np.concatenate([line[y], line[x[tie]]]), np.concatenate([line[x], line[y[tie]]])
        yield _met_rows(np.zeros(len(q), np.int64), q, z, np.zeros(len(q), bool), [])
        for x, y in zip(a[several & (b - a > 2)].tolist(), b[several & (b - a > 2)].tolist()):
            o = order[x:y]
            o = o[np.lexsort((line[o], place[o]))]
            names = line[o]
            i, c, more = candidates(par[o], own[o].astype(bool), place[o], 2 * tau, FIRST)
            if len(i):
                run = bucket << 32 | int(sig[o[0]])
                yield _met_rows(np.full(len(i), run), names[i], names[c], more, [(run, names.tobytes())] if more.any() else [])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, list] = {}
        kinds = (np.uint32, np.int64, np.uint8, np.uint32, np.float32)
        for batch in batches:
            for r, b in enumerate(batch.column(0).to_pylist()):
                parts.setdefault(b, []).append(tuple(np.frombuffer(batch.column(i)[r].as_py(), t) for i, t in enumerate(kinds, 1)))
        for b in sorted(parts):
            held, n = [], 0
            for found in runs_of(b, parts.pop(b)):
                held.append(found)
                n += found.num_rows
                if n >= 100_000:
                    yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                    held, n = [], 0
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    def members(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(run, salt, name) of the members of runs that have lines which their first candidates did not settle."""
        for batch in batches:
            for r, salt, m in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                names = np.frombuffer(m, np.int64, len(m) // 8)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(names), r)), pa.array(np.full(len(names), salt)), pa.array(names)], ["run", "salt", "name"])

    return run, members


def _met_rows(run: np.ndarray, q: np.ndarray, x: np.ndarray, more: np.ndarray, members: list[tuple[int, bytes]]) -> pa.RecordBatch:
    none = len(members)
    longs = lambda v, m: pa.array([*v.tolist(), *m], pa.int64())
    return pa.RecordBatch.from_arrays([
        longs(run, [r for r, _ in members]), longs(q, [None] * none), longs(x, [None] * none), pa.array([*more.tolist(), *[None] * none], pa.bool_()), pa.array([None] * len(q) + [m for _, m in members], pa.binary()),
    ], ["run", "q", "x", "more", "members"])


def within(a: str, b: str, tau: int) -> bool:
    """Whether two strings are at most tau edits apart: a bit-vector over the band of 2 tau + 1 diagonals."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > tau:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    a, b = a[i:], b[i:]
    j = 0
    while j < len(a) and a[-1 - j] == b[-1 - j]:
        j += 1
    a, b = a[: len(a) - j], b[: len(b) - j]
    if not a or len(b) <= tau:
        return len(b) <= tau
    where: dict[str, int] = {}
    for at, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << at
    # Bit r of the band at column j is row j - tau + r + 1 of the table; the lowest row of the band is its
    # last bit.  Following the band's last diagonal keeps the distance at row j + tau; past a's end it is
    # read along a's last row.
    width = 2 * tau + 1
    full = (1 << width) - 1
    m = len(a)
    plus, minus, dist = full & ~((1 << tau) - 1), 0, min(tau, m)
    most = 2 * tau + len(b) - m + tau  # what the steps along a's last row can still take back
    for col, c in enumerate(b):
        low = col - tau
        eq = where.get(c, 0)
        eq = (eq >> low if low >= 0 else eq << -low) & full
        d0 = ((((eq & plus) + plus) ^ plus) | eq | minus) & full
        hp = (minus | ~(d0 | plus)) & full
        hn = d0 & plus
        row = col + tau  # of the band's last bit, from 0
        if row < m:
            dist += not d0 >> (width - 1) & 1
        else:
            bit = width - 1 - (row - m + 1)
            dist += (hp >> bit & 1) - (hn >> bit & 1)
        if dist > most:
            return False
        plus = (hn | ~(d0 >> 1 | hp)) & full
        minus = (d0 >> 1) & hp
    return dist <= tau


def _texts(batches: Iterable[pa.RecordBatch], least: int = MIN_NEAR) -> Iterator[pa.RecordBatch]:
    """(k, line) of each line of some documents that edits are counted for, once a task as far as it remembers."""
    seen: set[bytes] = set()
    for batch in batches:
        ks, lines = [], []
        for t in K.texts(batch.column(0)):
            for x in t.split("\n"):
                x = x.strip(_SPACE)
                if len(x) < least or (k := _digest(x)) in seen:
                    continue
                if len(seen) < SEEN:
                    seen.add(k)
                ks.append(k)
                lines.append(x)
        yield pa.RecordBatch.from_arrays([pa.array(ks, pa.binary()), pa.array(lines, pa.string())], ["k", "line"])


def _near(tau: int):
    """q of those rows (q, line, other line) that are near."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [within(a, b, tau) for a, b in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield batch.select([0]).filter(pa.array(ok, pa.bool_()))

    return run


def _settle(tau: int):
    """q of the open lines of a run that are near an earlier member of it; both sides: (name, line, place)."""

    def run(key, queries, members):
        m = members.sort_by("place")
        places = m.column("place").to_numpy(zero_copy_only=False)
        lines = m.column("line").combine_chunks()
        size = np.array([len(x) for x in K.texts(lines)], np.int64)
        bits = np.array([parity(x) for x in K.texts(lines)], np.uint32)
        out = []
        for p, n, x in zip(*(queries.column(c).to_pylist() for c in ("place", "name", "line"))):
            far = np.bitwise_count(bits ^ np.uint32(parity(x)))
            near = np.flatnonzero((far <= 2 * tau) & (np.abs(size - len(x)) <= tau) & (places < p))
            if any(within(x, lines[int(i)].as_py(), tau) for i in near[np.argsort(far[near], kind="stable")]):
                out.append(n)
        return pa.table({"q": pa.array(out, pa.int64())})

    return run


def parity(line: str) -> int:
    """A bit for each of 32 classes of characters, set if their count is odd; an edit flips two at most."""
    out = 0
    for c in line:
        out ^= 1 << (ord(c) * 0x9E3779B1 >> 12 & 31)
    return out


def _head64(k: str):
    h = F.hex(F.col(k))
    return F.conv(F.concat(*[F.substring(h, 2 * i + 1, 2) for i in range(7, -1, -1)]), 16, -10).cast("long")


def repeated_lines(docs: DataFrame, *, tau: int = TAU, min_exact: int = MIN_EXACT, min_near: int = MIN_NEAR) -> tuple[DataFrame, DataFrame]:
    """(lines, removed): written rows of _lines(), and (doc_id, exact, near) with the numbers of removed lines.

    A line number means a line only where an id names one row: rows whose id is null or repeats keep their
    lines, though later documents lose what stands in them (null ids come last).  Null and empty texts have
    no lines.  min_exact: characters from which equal lines go (1: all that are not blank); min_near: those from
    which near ones do, tau + 1 at least, as a line needs a character for each segment.
    """
    lines, removed = _found(docs, tau, min_exact, min_near)
    return lines, written(removed, "line-removed")


def _found(docs: DataFrame, tau: int = TAU, min_exact: int = MIN_EXACT, min_near: int = MIN_NEAR) -> tuple[DataFrame, DataFrame]:
    """What ``repeated_lines`` returns, the removed ones not yet written."""
    if not 1 <= min_exact <= min_near or min_near <= tau:
        raise ValueError("1 <= min_exact <= min_near, and min_near > tau")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    lines = written(docs.mapInArrow(K.tidy(partial(_lines, least=min_exact)), "doc_id long, line_no int, k binary, chars int"), "lines")
    at = F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "line_no")
    classes = lines.filter("line_no >= 0").groupBy("k").agg(F.min(at).alias("first"), F.count(F.lit(1)).alias("n"), F.min("chars").alias("chars"))
    classes = written(classes, "line-classes")
    total = classes.count()
    buckets = max(64, total * (tau + 1) * (2 * tau + 1) // PER_BUCKET)
    packed = docs.mapInArrow(K.tidy(_signatures(tau, buckets, min_near)), _PACKED)
    meet, members = _meet(tau)
    met = written(packed.repartition(buckets, "bucket").mapInArrow(K.tidy(meet), _MET), "line-runs")

    asked = met.filter("q is not null").select("run", "q", "x", "more")
    named = classes.filter(F.col("chars") >= min_near).select("k", "first", _head64("k").alias("name"))
    needed = asked.select(F.col("q").alias("name")).union(asked.select("x")).union(met.filter("members is not null").select("run", F.lit(0).cast("long").alias("salt"), "members").mapInArrow(K.tidy(members), "run long, salt long, name long").select("name"))
    ends = written(named.join(needed.distinct(), "name", "left_semi"), "line-ends")
    ids = written(ends.select(F.col("first.doc_id").alias("_first")).distinct(), "line-docs")
    texts = small_join(docs, ids, F.expr("doc_id <=> _first"), "left_semi").select("text").mapInArrow(K.tidy(partial(_texts, least=min_near)), "k binary, line string")
    # Equal lines meet once per task at most, and are one before they meet their places.
    texts = written(ends.join(texts.dropDuplicates(["k"]), "k"), "line-texts")

    def settled(pairs: DataFrame, name: str) -> DataFrame:
        """Lines q with an earlier line x that is near."""
        d = pairs.join(texts.select(F.col("name").alias("q"), F.col("line").alias("a"), F.col("first").alias("fa")), "q")
        d = d.join(texts.select(F.col("name").alias("x"), F.col("line").alias("b"), F.col("first").alias("fb")), "x").filter("fb < fa")
        return written(d.select("q", "a", "b").mapInArrow(K.tidy(_near(tau)), "q long").distinct(), name)

    one = settled(asked.select("q", "x").distinct(), "line-late")
    # Lines with more candidates than those meet the other members of their runs, a share of a large run's open lines at a time.
    rest = written(asked.filter("more").join(one, "q", "left_anti").select("run", "q").distinct(), "line-open")
    shares = rest.groupBy("run").agg(F.ceil(F.count(F.lit(1)) / SHARE).alias("shares"))
    place = F.struct("first.late", "first.doc_id", "first.line_no").cast("struct<late:boolean,doc_id:bigint,line_no:int>")
    said = texts.select("name", "line", F.concat_ws(":", place["late"].cast("string"), F.lpad((F.coalesce(place["doc_id"], F.lit(0)).cast("decimal(20,0)") + F.lit("9223372036854775808").cast("decimal(20,0)")).cast("string"), 20, "0"), F.lpad(place["line_no"].cast("string"), 10, "0")).alias("place"))
    asks = rest.join(shares, "run").withColumn("salt", F.pmod(F.xxhash64("q"), F.col("shares"))).withColumnRenamed("q", "name").select("run", "salt", "name").join(said, "name")
    held = met.filter("members is not null").select("run", "members").join(shares, "run").select("run", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1)).alias("salt"), "members")
    held = held.mapInArrow(K.tidy(members), "run long, salt long, name long").join(said, "name")
    fresh = lambda d: d.select("run", "salt", "name", "line", "place").toDF("run", "salt", "name", "line", "place").groupBy("run", "salt")
    two = fresh(asks).cogroup(fresh(held)).applyInArrow(_settle(tau), "q long").distinct()
    late = one.union(two).join(ends.select(F.col("name").alias("q"), "k"), "q").select("k", F.lit(True).alias("near"))

    known = classes.join(late, "k", "left").filter("n > 1 or near").select("k", "first", F.coalesce("near", F.lit(False)).alias("near"))
    known = written(known, "line-known")
    several = written(lines.filter("line_no = -1 and doc_id is not null").groupBy("doc_id").count().filter("count > 1").select("doc_id"), "line-ids")
    named = small_join(lines.filter("line_no >= 0 and doc_id is not null"), several, ["doc_id"], "left_anti")
    hit = small_join(named.withColumn("at", at), known, ["k"], "inner")
    again = F.col("at") > F.col("first")
    hit = hit.filter(again | F.col("near")).groupBy("doc_id").agg(
        F.array_sort(F.collect_set(F.when(again, F.col("line_no")))).alias("exact"), F.array_sort(F.collect_set(F.when(~again, F.col("line_no")))).alias("near"))
    return lines, hit


def line_report(docs: DataFrame, **how) -> DataFrame:
    """Per row: doc_id, n_lines (with something on them), n_exact, n_near, and the removed lines' numbers from 0.

    near: first occurrences removed for an earlier line within tau edits; exact: all other removed lines.  how: tau,
    min_exact and min_near of ``repeated_lines``.  Null and empty texts have no lines; very long lines are lines
    like others; other columns are not read, whatever their names; no documents, no rows.
    """
    lines, removed = repeated_lines(docs, **how)
    each = lines.filter("line_no = -1").select("doc_id", F.col("chars").cast("long").alias("n_lines"))
    d = each.join(removed.withColumnRenamed("doc_id", "_id"), F.expr("doc_id <=> _id"), "left")
    none = F.array().cast("array<int>")
    exact, near = F.coalesce("exact", none), F.coalesce("near", none)
    return d.select("doc_id", "n_lines", F.size(exact).cast("long").alias("n_exact"), F.size(near).cast("long").alias("n_near"), F.array_join(F.array_sort(F.concat(exact, near)).cast("array<string>"), ",").alias("removed"))


def drop_repeated_lines(docs: DataFrame, **how) -> DataFrame:
    """docs without repeated lines, columns as before, n_chars (where present) counted anew.

    Documents that lose lines and have no word left are gone: every line of theirs stands elsewhere.  how: as of
    ``line_report``.  Null and empty texts stay, and so do all columns, whatever their names.
    """
    with scratch(docs.sparkSession):
        removed = written(_found(docs.select("doc_id", "text"), **how)[1], "line-removed", outlives=True)
    gone = removed.select(F.col("doc_id").alias("_id"), F.concat("exact", "near").alias("_gone"))
    # The row travels as one column, so that none of its names can clash.
    rows = docs.select(F.struct(*every(docs)).alias("_row"))
    d = small_join(rows.filter("_row.doc_id is not null"), gone, F.expr("_row.doc_id = _id"), "left")
    d = d.unionByName(rows.filter("_row.doc_id is null").selectExpr("_row", "cast(null as long) _id", "cast(null as array<int>) _gone"))
    text, gone = F.col("_row.text"), F.col("_gone")
    kept = F.array_join(F.filter(F.split(text, "\n", -1), lambda x, i: ~F.array_contains("_gone", i)), "\n")
    d = d.withColumn("_text", F.when(gone.isNull(), text).otherwise(kept)).filter(F.col("_gone").isNull() | F.col("_text").rlike(r"[^\x20\x09-\x0D]"))
    out = {c: F.col(f"_row.`{c}`") for c in docs.columns} | {"text": F.col("_text")}
    if "n_chars" in out:
        out["n_chars"] = F.when(gone.isNull(), out["n_chars"]).otherwise(F.length("_text").cast(docs.schema["n_chars"].dataType))
    return d.select(*[c.alias(name) for name, c in out.items()])
