"""N-gram Jaccard join by a token-group matrix: whole shingle sets, exact links at 3/4, one row per document.

1. Documents with equal shingle sets are one class from the start.
2. Under each of a few hash orders, classes are sorted by their minimum, then by the next order's, and
   compared with their neighbours of the same minimum; those that link, directly or through others, form a
   group.  Ranges of the sort break large runs anywhere, which costs candidates and no links.
3. The matrix: for each group a row of bits, one for each token value modulo the row's width, set where a
   member has such a token: the members' union.  Query classes meet groups through the prefix filter (of
   two linked sets, each has a common token among its first n - ceil(3n/4) + 1, in any order that all
   sets share), so no linked pair is missed.  Bits of a query that a group lacks are tokens that no
   member has, which bounds the query's overlap with every member; only groups whose bound reaches the
   threshold are opened, and their members' whole sets compared one by one.
4. Components of all links.

Candidates are compared in rounds, the most promising of each group first, and those that the links found
so far have joined are not compared at all: a large group costs comparisons in proportion to its members.
The common order puts tokens that several groups have last, by how many have them, so that passages that
many documents share stay out of the prefixes.  Beyond the number of such tokens that fits its bound the
order is by hash alone; it changes only the work, never the links.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sextant.llm import kernels as K
from sextant.llm.base import small_join, written
from sextant.llm.components import merged
from sextant.tables import scratch

#: Hash orders under which classes look for a group, and neighbours that they look at in each.
ORDERS, NEIGHBOURS = 8, 3
#: Tokens packed at a time; tokens that may be put last (2^20 of them are 9 MB), and groups that must have them.
PACK, FREQUENT, FREQUENT_MIN = 1_000_000, 1 << 20, 4
#: Pairs of a class and a group that are weighed in one vector operation, and places of the table that rules out most tokens as not frequent.
WEIGHED, PLACES = 1 << 17, 1 << 24
#: Digests that a task remembers, to emit exact copies once.
SEEN = 200_000
#: Classes in a block of those that have a frequent token: two blocks at a time meet in one task.
HOT = 4096
#: Members of a group whose union is one row of the matrix.
GROUP = 512
#: Classes whose ids are broadcast to find their texts; beyond, the join shuffles.
FETCH_ROWS = 500_000

_PROFILE = "doc_id long, n long, k binary, keys array<long>, bits binary"


def _bits(s: np.ndarray) -> bytes:
    """A row of the matrix for one set: at least two bits a token, a power of two of them."""
    wide = 1 << max(8, int(2 * len(s) - 1).bit_length()) if len(s) else 256
    out = np.zeros(wide, bool)
    out[((s >> np.uint64(7)) & np.uint64(wide - 1)).astype(np.int64)] = True
    return np.packbits(out, bitorder="little").tobytes()


def _folded(x: np.ndarray, wide: int) -> np.ndarray:
    """A row of bits narrowed to so many bytes."""
    return np.bitwise_or.reduce(x.reshape(-1, wide), axis=0)


def _minima(sets: list[np.ndarray], seeds: np.ndarray) -> pa.ListArray:
    """The minimum of each set under each seed, all sets at a time; an empty set has none."""
    lens = np.array([len(s) for s in sets], np.int64)
    some = lens > 0
    ends = np.concatenate([[0], np.cumsum(some * len(seeds))]).astype(np.int32)
    low = np.zeros((int(some.sum()), len(seeds)), np.uint64)
    if len(low):
        tok, at = np.concatenate(sets), (np.cumsum(lens) - lens)[some]
        for i, x in enumerate(seeds):
            low[:, i] = np.minimum.reduceat(K.mix(tok ^ x), at)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(low.view(np.int64).ravel()))


def _profile(size: int):
    """A document's set size, digest, minima, and row of bits."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds = K.mix(np.arange(1, ORDERS + 1, dtype=np.uint64))
        for batch in batches:
            ids = batch.column(0)
            for i, j, data, offs in K.blocks(batch.column(1)):
                sets = K.shingle_sets(data.translate(K.LOWER), offs, size)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(i, j - i), pa.array([len(s) for s in sets], pa.int64()), pa.array([K.set_digest(s) for s in sets], pa.binary()), _minima(sets, seeds), pa.array([_bits(s) for s in sets], pa.binary())],
                    ["doc_id", "n", "k", "keys", "bits"],
                )

    return run


def _home(tok: np.ndarray, buckets: int) -> np.ndarray:
    return ((tok >> np.uint64(33)) % np.uint64(buckets)).astype(np.int32)


def _cut(home: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """(buckets, places of each) of tokens by their bucket."""
    small = home.astype(np.uint16) if len(home) and home.max() < 65536 else home  # which numpy sorts by digits
    order = np.argsort(small, kind="stable")
    a, b = K.runs(home[order])
    return home[order][a], [order[x:y] for x, y in zip(a, b)]


class _Once:
    """Whether a task has had a set before: exact copies are worked on once, as far as it remembers."""

    def __init__(self):
        self.seen: set = set()

    def __call__(self, key) -> bool:
        new = key not in self.seen
        if new and len(self.seen) < SEEN:
            self.seen.add(key)
        return new


def _named(batch: pa.RecordBatch, size: int, once: _Once) -> Iterator[tuple[np.ndarray, int, int | None]]:
    """(set, class, group or None) of the texts of rows (text, k64, comp); a row's group counts only for its own class."""
    k64s, comps = batch.column(1).to_pylist(), batch.column(2).to_pylist()
    for i, _, data, offs in K.blocks(batch.column(0)):
        for r, s in enumerate(K.shingle_sets(data.translate(K.LOWER), offs, size), i):
            if len(s):
                k = K.set_digest(s)
                me = int.from_bytes(k[:8], "little", signed=True)
                comp = comps[r] if k64s[r] == me else None
                if once((k, comp is None)):
                    yield s, me, comp


def _all_tokens(size: int, buckets: int):
    """Packed tokens, 32 bits of each, of one class of each group and of all classes without a group."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, held, n_held = _Once(), [], 0

        def pack() -> pa.RecordBatch:
            tok = np.concatenate(held)
            names, cut = _cut(_home(tok, buckets))
            return pa.RecordBatch.from_arrays([pa.array(names), pa.array([tok[o].astype(np.uint32).tobytes() for o in cut], pa.binary())], ["bucket", "tokens"])

        for batch in batches:
            for s, me, comp in _named(batch, size, once):
                if comp is None or comp == me:
                    held.append(s)
                    n_held += len(s)
                if n_held >= 2 * PACK:
                    yield pack()
                    held, n_held = [], 0
        if held:
            yield pack()

    return run


def _repeated(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, times) of tokens that come often enough; key: the bucket and 32 bits of the token."""
    parts: dict[int, list] = {}
    for batch in batches:
        for b, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            parts.setdefault(b, []).append(np.frombuffer(blob, np.uint32))
    for b in sorted(parts):
        t, c = np.unique(np.concatenate(parts.pop(b)), return_counts=True)
        t, c = t[c >= FREQUENT_MIN], c[c >= FREQUENT_MIN]
        yield pa.RecordBatch.from_arrays([pa.array(t.astype(np.int64) | b << 32), pa.array(c.astype(np.int64))], ["key", "times"])


def _neighbours(threshold: tuple[int, int]):
    """(a, g) of classes with the same minimum that stand close in the sort: rows (j, key, s, k, n)."""
    num, den = threshold

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near: list[tuple[bytes, int]] = []
        last = None
        for batch in batches:
            a, g = [], []
            j, key, _, k, n = (batch.column(i).to_pylist() for i in range(5))
            for name, x, size in zip(zip(j, key), k, n):
                if name != last:
                    last, near = name, []
                for y, other in near:
                    if den * min(size, other) >= num * max(size, other):
                        a.append(x)
                        g.append(y)
                near = [*near[-NEIGHBOURS + 1 :], (x, size)]
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(g, pa.binary())], ["a", "g"])

    return run


def _sets(size: int):
    """(k, set) of each text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offs in K.blocks(batch.column(0)):
                sets = K.shingle_sets(data.translate(K.LOWER), offs, size)
                yield pa.RecordBatch.from_arrays([pa.array([K.set_digest(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], ["k", "tokens"])

    return run


def _fetch(docs: DataFrame, wanted: DataFrame, size: int, name: str) -> DataFrame:
    """(k, tokens) of classes; wanted: written rows (k, first_id).  Texts are found by a document of the class.

    Where ids repeat, sets come twice or unasked for; neither changes which pairs link.
    """
    ids = wanted.select(F.col("first_id").alias("_first")).distinct()
    texts = small_join(docs, ids, F.expr("doc_id <=> _first"), "left_semi", FETCH_ROWS)
    sets = texts.select("text").mapInArrow(K.tidy(_sets(size)), "k binary, tokens binary")
    return written(sets, name)


def _linked(threshold: tuple[int, int]):
    """Keeps pairs whose sets link: rows (a, b, ta, tb) to (a, b)."""
    num, den = threshold

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ta, tb = batch.column(2), batch.column(3)
            keep = []
            for i in range(batch.num_rows):
                x, y = (np.frombuffer(t[i].as_buffer(), np.uint64) for t in (ta, tb))
                both = K.overlap(x, y)
                keep.append(den * both >= num * (len(x) + len(y) - both) and both > 0)
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return run


def _verify(pairs: DataFrame, sets: DataFrame, threshold: tuple[int, int], name: str) -> DataFrame:
    """Those of the pairs (a, b) that link."""
    d = pairs.join(sets.select(F.col("k").alias("a"), F.col("tokens").alias("ta")), "a")
    d = d.join(sets.select(F.col("k").alias("b"), F.col("tokens").alias("tb")), "b").select("a", "b", "ta", "tb")
    return written(d.mapInArrow(K.tidy(_linked(threshold)), "a binary, b binary"), name)


def _prefixes(size: int, buckets: int, last, threshold: tuple[int, int]):
    """Packed prefix tokens by bucket of the token: each row holds what a block of documents has for one bucket.

    Columns of the input: text, k64 and comp of the group that the document is in (null: none).  For each
    token: 32 bits of it, its class, the size of the set and how many tokens follow in the common order,
    itself included; for classes in groups also the group.  Sizes are cut at 65535, which says "not less".

    A token that many have is dealt over tasks: its classes are hashed to blocks, and each two blocks, and each
    block alone, meet under a name of their own.  A class goes to one name for each block; sides say which of the
    two blocks it is from (0: they are the same), as classes of one block need not meet there again.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, rank = last.value
        places = np.uint64(min(PLACES, 1 << (16 * len(often)).bit_length()) - 1)
        maybe = np.zeros(int(places) + 1, bool)  # by the token's low bits, which are the key's too
        maybe[often & np.int64(places)] = True
        once, n_held = _Once(), 0
        held: list[tuple[np.ndarray, int, int | None, int, np.ndarray]] = []

        def pack() -> pa.RecordBatch:
            small = lambda x: np.minimum(x, 65535).astype(np.uint16)
            lens = np.array([len(x[0]) for x in held])
            tok, copies = (np.concatenate([x[i] for x in held]) for i in (0, 4))
            who = np.repeat(np.arange(len(held), dtype=np.int32), lens)
            node, comp, n = (np.array([x[i] or 0 for x in held], np.int64) for i in (1, 2, 3))
            grouped = np.array([x[2] is not None for x in held])
            rem = small(np.repeat(n + np.cumsum(lens) - lens, lens) - np.arange(len(tok)))
            tok, side, row = _dealt(tok, node[who], copies)
            if len(row) > len(who):
                who, rem = who[row], rem[row]
            del copies, row
            names, cut = _cut(_home(tok, buckets))
            tok, n = tok.astype(np.uint32), small(n)
            blobs = lambda x, of=None: pa.array([x[o if of is None else of[o]].tobytes() for o in cut], pa.binary())
            at = pa.array([np.flatnonzero(grouped[who[o]]).astype(np.uint32).tobytes() for o in cut], pa.binary())
            comps = pa.array([comp[w[grouped[w]]].tobytes() for w in (who[o] for o in cut)], pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(names), blobs(tok), blobs(node, who), blobs(n, who), blobs(rem), blobs(side), at, comps], ["bucket", "tokens", "nodes", "sizes", "rests", "sides", "grouped", "comps"])

        for batch in batches:
            for s, me, comp in _named(batch, size, once):
                first = K.prefix_length(len(s), *threshold)
                t, copies = s[:first].copy(), np.ones(first, np.int64)
                look = np.flatnonzero(maybe[(s & places).view(np.int64)])
                if len(look):
                    x = s[look]
                    key = _home(x, buckets).astype(np.int64) << 32 | (x & np.uint64(0xFFFFFFFF)).astype(np.int64)
                    at = np.minimum(np.searchsorted(often, key), len(often) - 1)
                    among = np.zeros(len(s), np.int8)
                    among[look] = np.where(often[at] == key, rank[at], 0)
                    order = np.argsort(among, kind="stable")[:first]
                    t, copies = s[order], copies << np.maximum(among[order].astype(np.int64) - HOT.bit_length(), 0)
                held.append((t, me, comp, len(s), copies))
                n_held += int(copies.sum())
                if n_held >= PACK:
                    yield pack()
                    held, n_held = [], 0
        if held:
            yield pack()

    return run


def _dealt(tok: np.ndarray, node: np.ndarray, copies: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(names, sides, rows) of tokens of classes: a token once, or under a name for each pair of blocks that its class is in; copies: blocks, a power of two."""
    if (copies == 1).all():
        return tok, np.zeros(len(tok), np.uint8), np.arange(len(tok))
    row = np.repeat(np.arange(len(tok)), copies)
    other = np.arange(len(row)) - np.repeat(np.cumsum(copies) - copies, copies)
    own = (K.mix(node.view(np.uint64)[row]) & (copies[row] - 1).astype(np.uint64)).astype(np.int64)
    pair = (np.minimum(own, other) << 32 | np.maximum(own, other)).astype(np.uint64) + np.uint64(1)
    name = np.where(copies[row] > 1, K.mix(tok[row] ^ K.mix(pair)), tok[row])
    return name, np.where(own == other, 0, np.where(own < other, 1, 2)).astype(np.uint8), row


_PACKED = "bucket int, tokens binary, nodes binary, sizes binary, rests binary, sides binary, grouped binary, comps binary"


#: A size of which no more is known than that it is large.
_MANY = 1 << 40


def _meet(threshold: tuple[int, int], parts_out: int):
    """(query, group) pairs that share a prefix token, from all packed rows of some buckets, packed by query.

    A pair needs den/(num+den)-ths of both sizes in common (3/7 at 3/4), so its first common token must
    leave as many to come in either set; tokens that leave fewer are not a pair's first.  Of two groups
    the one with fewer members at a token asks there, so that each pair of groups meets once.  A group is
    looked at as a whole, by the range of its sizes: a token costs its rows times its groups.
    """
    num, den = threshold

    def pairs(parts: list[tuple]) -> np.ndarray:
        tok, node, n, rem, side, comp = (np.concatenate([p[i] for p in parts]) for i in range(6))
        order = np.argsort(tok)
        a, b = K.runs(tok[order])
        order = order[np.repeat(b - a > 1, b - a)]  # most tokens have one class alone
        tok, node, n, rem, side, comp = (x[order] for x in (tok, node, n, rem, side, comp))
        order = np.lexsort((comp == node, side, node, tok))  # of equal (token, class, side), the row that knows its group first
        order = order[_new(*(x[order] for x in (tok, node, side)))]
        order = order[np.lexsort((comp[order], tok[order]))]
        # Groups at a token by their members, those with more later; then by side.
        new = np.flatnonzero(_new(tok[order], comp[order]))
        times = np.diff(np.append(new, len(order)))
        order = order[np.lexsort((side[order], comp[order], np.repeat(times, times), tok[order]))]
        tok, ids, side, comp = (x[order] for x in (tok, node, side, comp))
        ns, rs = (np.where(v[order] == 65535, _MANY, v[order].astype(np.int64)) for v in (n, rem))
        # Groups, by side, as rows: the sizes of their members lie between two values, and none leaves more to come.
        at = np.flatnonzero(_new(tok, comp, side))
        if not len(at):
            return np.zeros((0, 2), np.int64)
        g, gs = comp[at], side[at]
        low, high, rest = np.minimum.reduceat(ns, at), np.maximum.reduceat(ns, at), np.maximum.reduceat(rs, at)
        # A class asks the rows of its token from the first of the next group on.
        row = np.repeat(np.arange(len(at)), np.diff(np.append(at, len(tok))))
        group, last = _new(tok[at], g), _new(tok[at])
        since = _next(group)[row]
        asks = _next(last)[row] - since
        q = np.flatnonzero(asks)
        since, asks = since[q], asks[q]
        total = np.cumsum(asks)
        out, n_out, x = [np.zeros((0, 2), np.int64)], 0, 0
        while x < len(q):
            y = max(x + 1, int(np.searchsorted(total, total[x] - asks[x] + WEIGHED, "right")))
            c = np.repeat(q[x:y], asks[x:y])
            i = np.arange(len(c)) + np.repeat(since[x:y] - total[x:y] + asks[x:y] + total[x] - asks[x], asks[x:y])
            m, lo, hi = ns[c], low[i], high[i]
            near = np.clip(m, lo, hi)
            least = np.maximum(lo, -(-num * m // den))
            fits = (den * np.minimum(near, m) >= num * np.maximum(near, m)) & ((num + den) * np.minimum(rest[i], rs[c]) >= num * (least + m))
            ok = (fits | (hi == _MANY) | (m == _MANY)) & ((gs[i] != side[c]) | (side[c] == 0))
            out.append(np.column_stack([ids[c[ok]], g[i[ok]]]))
            n_out += len(out[-1])
            if n_out >= PACK:  # pairs that share several tokens would pile up
                out, n_out = [_once_each(out)], 0
            x = y
        return _once_each(out)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, list] = {}
        kinds = (np.uint32, np.int64, np.uint16, np.uint16, np.uint8, np.uint32, np.int64)
        for batch in batches:
            for r, b in enumerate(batch.column(0).to_pylist()):
                tok, node, n, rem, side, at, comps = (np.frombuffer(batch.column(i)[r].as_py(), t) for i, t in enumerate(kinds, 1))
                comp = node.copy()
                comp[at] = comps
                parts.setdefault(b, []).append((tok, node, n, rem, side, comp))
        for b in sorted(parts):
            p = pairs(parts.pop(b))
            if len(p):
                names, cut = _cut((K.mix(p[:, 0].view(np.uint64)) % np.uint64(parts_out)).astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(names), pa.array([p[o].tobytes() for o in cut], pa.binary())], ["part", "pairs"])

    return run


def _new(*columns: np.ndarray) -> np.ndarray:
    """Where rows that lie sorted differ from the one before."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.logical_or.reduce([x[1:] != x[:-1] for x in columns])
    return new


def _next(new: np.ndarray) -> np.ndarray:
    """For each row the place at which the run after its own begins, or the end."""
    ends = np.append(np.flatnonzero(new)[1:], len(new))
    return ends[np.cumsum(new) - 1]


def _once_each(parts: list[np.ndarray]) -> np.ndarray:
    """The distinct rows of two-column arrays."""
    p = np.concatenate(parts)
    p = p[np.lexsort((p[:, 1], p[:, 0]))]
    new = np.ones(len(p), bool)
    new[1:] = (p[1:] != p[:-1]).any(1)
    return p[new]


def _distinct(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each packed (q, g) once: two classes mostly share several tokens."""
    parts: dict[int, list[np.ndarray]] = {}
    for batch in batches:
        for b, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            held = parts.setdefault(b, [])
            held.append(np.frombuffer(blob, np.int64).reshape(-1, 2))
            if sum(map(len, held[1:])) >= PACK:
                parts[b] = [_once_each(held)]
    for b in sorted(parts):
        p = _once_each(parts.pop(b))
        yield pa.RecordBatch.from_arrays([pa.array(p[:, 0].copy()), pa.array(p[:, 1].copy())], ["q", "g"])


def _rows_of(key, rows):
    """A row of the matrix for the members of a group: the bits of their union, and the smallest size."""
    sets = [np.frombuffer(x.as_buffer(), np.uint8) for x in rows.column("bits").combine_chunks()]
    wide = max(map(len, sets))
    # A narrower row says nothing of the higher bits, so it stands in each of them.
    union = np.bitwise_or.reduce([np.tile(x, wide // len(x)) for x in sets])
    return pa.table({"g": [key[0].as_py()], "part": [key[1].as_py()], "least": pa.array([min(rows.column("n").to_pylist())], pa.int64()), "gbits": pa.array([union.tobytes()], pa.binary())})


def _could(threshold: tuple[int, int], n: int, bits: np.ndarray, least: int, other: np.ndarray) -> int:
    """The most tokens that a set can share with a row of the matrix, or -1 if that makes no link."""
    num, den = threshold
    wide = min(len(bits), len(other))
    most = n - int(np.bitwise_count(_folded(bits, wide) & ~_folded(other, wide)).sum())
    return most if (num + den) * most >= num * (n + max(least, -(-num * n // den))) else -1


def _bound(threshold: tuple[int, int]):
    """Keeps (query, row of the matrix) that could link; rows (.., n, bits, least, gbits), with est in their place."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, bits, least, other = (batch.column(batch.num_columns - i) for i in (4, 3, 2, 1))
            est = np.array([_could(threshold, a, np.frombuffer(x.as_buffer(), np.uint8), b, np.frombuffer(y.as_buffer(), np.uint8)) for a, x, b, y in zip(n.to_pylist(), bits, least.to_pylist(), other)], np.int64)
            names = batch.schema.names[:-4]
            out = pa.RecordBatch.from_arrays([*batch.columns[:-4], pa.array(est)], [*names, "est"])
            yield out.filter(pa.array(est >= 0))

    return run


def _open(threshold: tuple[int, int]):
    """Members of an opened group that each query could link with, the most promising first."""

    def run(key, queries, members):
        ks = members.column("k").to_pylist()
        ns, rows = members.column("n").to_pylist(), [np.frombuffer(x.as_buffer(), np.uint8) for x in members.column("bits").combine_chunks()]
        out: tuple[list, list, list, list] = ([], [], [], [])
        for a, n, bits in zip(queries.column("a").to_pylist(), queries.column("n").to_pylist(), queries.column("bits").combine_chunks()):
            x = np.frombuffer(bits.as_buffer(), np.uint8)
            est = [(_could(threshold, n, x, m, y), k) for m, y, k in zip(ns, rows, ks) if k != a]
            est = sorted((e for e in est if e[0] >= 0), key=lambda e: (-e[0], e[1]))
            if est:
                for o, v in zip(out, (a, est[0][1], [k for _, k in est], est[0][0])):
                    o.append(v)
        return pa.table({"a": pa.array(out[0], pa.binary()), "g": pa.array(out[1], pa.binary()), "bs": pa.array(out[2], pa.list_(pa.binary())), "est": pa.array(out[3], pa.int64())})

    return run


def _settle(rows: DataFrame, groups: DataFrame | None, docs: DataFrame, classes: DataFrame, size: int, threshold: tuple[int, int], name: str, steps: tuple[str, ...] = ("a component", "two components", "all")) -> DataFrame | None:
    """groups (node, label) joined by those links among candidates (a, g, bs, est) that matter for components.

    a is a class, bs classes of one group that it could link with, g one of them.  First the best candidate
    of each component is compared, then the best between each two components, then all that are still
    between different components; steps says which of these are taken.  Sets and candidates are deleted at the end.
    """
    with scratch(docs.sparkSession):
        found = _joined(rows, groups, docs, classes, size, threshold, name, steps)
        return groups if found is groups else written(found, f"{name}-groups", True, outlives=True)


def _joined(rows: DataFrame, groups: DataFrame | None, docs: DataFrame, classes: DataFrame, size: int, threshold: tuple[int, int], name: str, steps: tuple[str, ...]) -> DataFrame | None:
    """The steps of ``_settle``; groups itself, if no candidate is between different components."""
    rows = written(rows, f"{name}-candidates")
    ends = rows.select(F.col("a").alias("k")).union(rows.select(F.explode("bs"))).distinct()
    sets = _fetch(docs, written(classes.select("k", "first_id").join(ends, "k", "left_semi"), f"{name}-wanted", True), size, f"{name}-sets")
    for step in steps:
        if groups is None:
            d = rows.withColumns({"ca": F.col("a"), "cg": F.col("g")})
        else:
            label = lambda c, to: groups.select(F.col("node").alias(c), F.col("label").alias(to))  # noqa: B023, E731
            d = small_join(small_join(rows, label("a", "ca"), ["a"], "left"), label("g", "cg"), ["g"], "left")
            d = d.withColumns({"ca": F.coalesce("ca", "a"), "cg": F.coalesce("cg", "g")}).filter("ca != cg")
        if step == "all":
            pairs = d.select("a", F.explode("bs").alias("b"))
        else:
            by = ["ca"] if step == "a component" else ["ca", "cg"]
            pairs = d.groupBy(*by).agg(F.max(F.struct("est", "a", F.col("bs")[0].alias("b"))).alias("m")).select("m.a", "m.b")
        pairs = written(pairs, f"{name}-pairs", True)
        if pairs.isEmpty():
            break
        groups = merged(groups, _verify(pairs, sets, threshold, f"{name}-links"), f"{name}-groups")
    return groups


def shingle_report(docs: DataFrame, *, size: int = 5, threshold: tuple[int, int] = (3, 4)) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_shingles, component_id.

    component_id is the smallest doc_id reachable over links, itself included.  Null and texts without
    words have no shingles and link with nothing; texts with fewer words than a shingle are one shingle.
    Rows with a null doc_id link like others and take the smallest id of their component (null, if none
    has one).  Repeated rows and ids get a row each.  An empty table gives an empty report.
    """
    return _classed(docs, size, threshold).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def _classed(docs: DataFrame, size: int, threshold: tuple[int, int]) -> DataFrame:
    """Per row of docs: doc_id, n, k (digest of its set, null without shingles), component_id, and chosen.

    chosen: whether the class k is the one that stays of its component, by smallest id (null last), then digest.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    with scratch(spark):  # keys and bits stay with the classes alone
        profile = written(docs.mapInArrow(K.tidy(_profile(size)), _PROFILE), "jaccard-profile")
        classes = profile.filter("n > 0").groupBy("k").agg(F.min("doc_id").alias("first_id"), F.min("n").alias("n"), F.min("keys").alias("keys"), F.min("bits").alias("bits"))
        classes = written(classes, "jaccard-classes", outlives=True)
        each = written(profile.select("doc_id", "n", "k"), "jaccard-rows", outlives=True)
    num, den = threshold
    beside = lambda k, n, bits: classes.select(F.col("k").alias(k), F.col("n").alias(n), F.col("bits").alias(bits))

    # Groups: classes against neighbours with the same minimum.
    keyed = classes.select("k", "n", "keys", F.posexplode("keys").alias("j", "key"))
    keyed = keyed.select("j", "key", F.get("keys", (F.col("j") + 1) % ORDERS).alias("s"), "k", "n").repartitionByRange("j", "key", "s", "k").sortWithinPartitions("j", "key", "s", "k")
    near = keyed.mapInArrow(K.tidy(_neighbours(threshold)), "a binary, g binary")
    near = near.select(F.least("a", "g").alias("g"), F.greatest("a", "g").alias("a")).distinct().join(beside("a", "n", "bits"), "a").join(beside("g", "least", "gbits"), "g")
    near = near.select("a", "g", "n", "bits", "least", "gbits").mapInArrow(K.tidy(_bound(threshold)), "a binary, g binary, est long")
    groups = _settle(near.select("a", "g", F.array("g").alias("bs"), "est"), None, docs, classes, size, threshold, "jaccard-near", ("a component", "all"))
    if groups is None:
        groups = spark.createDataFrame([], "node binary, label binary")

    # Prefixes in an order that puts what several groups share last.
    total = each.agg(F.sum("n")).first()[0] or 0
    buckets = max(64, int(total) // 500_000)
    member = groups.select(F.col("node").alias("k"), "label").join(classes.select("k", "first_id"), "k")
    member = written(member.select("k", "first_id", _head64("k").alias("k64"), _head64("label").alias("comp")), "jaccard-members")
    named = small_join(docs, member.select("first_id", "k64", "comp"), F.expr("doc_id <=> first_id"), "left", FETCH_ROWS).select("text", "k64", "comp")
    often = named.mapInArrow(K.tidy(_all_tokens(size, buckets)), "bucket int, tokens binary").repartition(buckets, "bucket").mapInArrow(K.tidy(_repeated), "key long, times long")
    often = written(often, "jaccard-often").orderBy(F.desc("times"), "key").limit(FREQUENT).toArrow()
    order = np.argsort(often["key"].to_numpy())
    last = spark.sparkContext.broadcast((often["key"].to_numpy()[order], (np.log2(often["times"].to_numpy()).astype(np.int8) + 1)[order]))
    del often
    packed = named.mapInArrow(K.tidy(_prefixes(size, buckets, last, threshold)), _PACKED)
    spread = max(16, buckets // 8)
    met = packed.repartition(buckets, "bucket").mapInArrow(K.tidy(_meet(threshold, spread)), "part int, pairs binary")
    met = written(met.repartition(spread, "part").mapInArrow(K.tidy(_distinct), "q long, g long"), "jaccard-met")

    # The matrix: queries against rows of bits, members of the groups that open.
    if not met.isEmpty():
        home = classes.select("k", "n", "bits", _head64("k").alias("k64")).join(member.select("k", "comp"), "k", "left").withColumn("comp", F.coalesce("comp", "k64"))
        of = home.join(met.select(F.col("g").alias("comp")).distinct(), "comp", "left_semi")
        parts = of.groupBy("comp").agg(F.ceil(F.count(F.lit(1)) / GROUP).alias("parts"))
        of = written(of.join(parts, "comp").withColumn("part", F.pmod(F.xxhash64("k"), F.col("parts"))), "jaccard-homes")
        several = of.groupBy("comp", "part").agg(F.count(F.lit(1)).alias("c"), F.min("n").alias("least"), F.min("bits").alias("gbits"), F.min("k").alias("k"))
        alone = several.filter("c = 1").select(F.col("comp").alias("g"), "part", "least", "gbits", "k")
        crowd = of.join(several.filter("c > 1").select("comp", "part"), ["comp", "part"], "left_semi")
        matrix = crowd.select("comp", "part", "n", "bits").groupBy("comp", "part").applyInArrow(_rows_of, "g long, part long, least long, gbits binary")
        matrix = matrix.withColumn("k", F.lit(None).cast("binary")).unionByName(alone)
        ask = met.join(home.select(F.col("k").alias("a"), F.col("k64").alias("q"), "n", "bits"), "q").join(matrix, "g")
        ask = ask.select("a", "g", "part", "k", "n", "bits", "least", "gbits").mapInArrow(K.tidy(_bound(threshold)), "a binary, g long, part long, k binary, est long")
        ask = written(ask.filter("k is null or a != k"), "jaccard-opened")
        single = ask.filter("k is not null").select("a", F.col("k").alias("g"), F.array("k").alias("bs"), "est")
        busy = ask.filter("k is null").select("a", "g", "part")
        salts = busy.groupBy("g", "part").agg(F.ceil(F.count(F.lit(1)) / (4 * GROUP)).alias("salts"))
        busy = busy.join(salts, ["g", "part"]).withColumn("salt", F.pmod(F.xxhash64("a"), F.col("salts"))).join(beside("a", "n", "bits"), "a")
        inside = of.withColumnRenamed("comp", "g").join(salts, ["g", "part"]).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)))
        by = ["g", "part", "salt"]
        opened = busy.select(*by, "a", "n", "bits").groupBy(*by).cogroup(inside.select(*by, "k", "n", "bits").groupBy(*by)).applyInArrow(_open(threshold), "a binary, g binary, bs array<binary>, est long")
        groups = _settle(single.unionByName(opened), groups, docs, classes, size, threshold, "jaccard-late")
    last.unpersist()

    labelled = classes.select("k", "first_id").join(groups.withColumnRenamed("node", "k"), "k", "left").withColumn("label", F.coalesce("label", "k"))
    smallest = labelled.groupBy("label").agg(F.min(F.struct(F.col("first_id").isNull().alias("none"), "first_id", "k")).alias("m"))
    final = labelled.join(smallest, "label").select("k", F.col("m.first_id").alias("component_id"), (F.col("k") == F.col("m.k")).alias("chosen"))
    full = each.filter("n > 0").join(final, "k").select("doc_id", "n", "k", "component_id", "chosen")
    return full.union(each.filter("n = 0").select("doc_id", "n", F.lit(None).cast("binary"), "doc_id", F.lit(True)))


def _head64(k: str) -> Column:
    """The first eight bytes of a digest as long, little-endian, as the kernels read them."""
    h = F.hex(F.col(k))
    two = lambda i: F.substring(h, 2 * i + 1, 2)
    big = F.concat(*[two(i) for i in range(7, -1, -1)])
    return F.conv(big, 16, -10).cast("long")


def _digested(size: int):
    """Rows (text, _row) with the digest k of the text's set, null without shingles."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offs in K.blocks(batch.column(0)):
                sets = K.shingle_sets(data.translate(K.LOWER), offs, size)
                yield pa.RecordBatch.from_arrays([pa.array([K.set_digest(s) if len(s) else None for s in sets], pa.binary()), *(c.slice(i, j - i) for c in batch.columns)], ["k", "text", "_row"])

    return run


def keep_one(docs: DataFrame, *, size: int = 5, threshold: tuple[int, int] = (3, 4)) -> DataFrame:
    """docs with one row of each component, that with the smallest id (null last); columns unchanged.

    Where ids repeat or are null, rows are told apart by the set of their text as well, and of equal ids the
    smallest digest stays, of equal sets the smallest text.  Texts without shingles link with nothing: they
    stay, those whose id repeats once per text.
    """
    with scratch(docs.sparkSession):
        report = written(_classed(docs.select("doc_id", "text"), size, threshold), "jaccard-report", outlives=True)
    stays = F.col("chosen") & F.col("doc_id").eqNullSafe(F.col("component_id"))
    gone = written(report.filter("doc_id is not null").filter(~stays).select("doc_id").distinct(), "jaccard-gone")
    several = written(report.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").select("doc_id"), "jaccard-several", True)
    none = report.filter("doc_id is null").isEmpty()
    if none and several.isEmpty():
        return small_join(docs, gone, ["doc_id"], "left_anti", FETCH_ROWS)
    named = docs.filter("doc_id is not null")
    single = small_join(small_join(named, several, ["doc_id"], "left_anti", FETCH_ROWS), gone, ["doc_id"], "left_anti", FETCH_ROWS)
    rest = small_join(named, several, ["doc_id"], "left_semi", FETCH_ROWS).unionByName(docs.filter("doc_id is null"))
    rest = rest.select("text", F.struct(*docs.columns).alias("_row"))
    rest = rest.mapInArrow(K.tidy(_digested(size)), f"k binary, text string, _row {rest.schema['_row'].dataType.simpleString()}")
    rest = written(rest, "jaccard-rest")
    chosen = written(report.filter(stays & F.col("k").isNotNull()).select("k", F.col("component_id").alias("_first")).distinct(), "jaccard-chosen")
    linked = small_join(rest.filter("k is not null"), chosen, "k").filter(F.col("_row.doc_id").eqNullSafe(F.col("_first")))
    linked = linked.groupBy("k").agg(F.min_by("_row", F.struct("text")).alias("_row"))
    bare = rest.filter("k is null").select("_row.*")
    bare = bare.filter("doc_id is null").unionByName(bare.filter("doc_id is not null").dropDuplicates(["doc_id", "text"]))
    return single.unionByName(linked.select("_row.*")).unionByName(bare).select(*docs.columns)
