"""Best-fit packing with several permitted sequence lengths, chosen jointly, each bin downsized at the end.

A sequence costs a fixed part, one in proportion to its length and one to its square, so that a word is
dear in short sequences and in the longest ones; each cut of a document costs a number of words.  A shard
is packed by several plans that differ in the lengths that they open and in where they cut long documents;
the sequences of each that are not full are then packed again over all lengths, and the plan whose whole
cost is least is taken.  ``least_cost`` is a bound that no packing can stay below.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections import Counter
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sextant.llm.base import n_words, written

#: Permitted lengths in words; how much dearer a word is in the longest of them; what a sequence costs beside its words;
#: what a cut of a document costs; pieces packed by one task.
CAPACITIES, ATTENTION, START, CUT, SHARD = (512, 1024, 2048, 4096), 0.25, 128, 512, 65_536


def cost(capacity: int, longest: int, attention: float = ATTENTION) -> float:
    """What a sequence costs, in words: a fixed part, a part in proportion to its length, a part to its square."""
    return START + capacity * (1 + attention * capacity / longest)


def filled(sizes: Sequence[int], counts: Sequence[int], room: int) -> int:
    """Words that a sequence of ``room`` words takes of a histogram (sizes ascending), the largest that fits first."""
    free, j = room, len(sizes)
    while free and (j := bisect_right(sizes, free, 0, j)):
        j -= 1
        free -= sizes[j] * min(counts[j], free // sizes[j])
    return room - free


def _planned(sizes: Sequence[int], caps: Sequence[int], opened: Callable[[int, list[int], list[int]], int]) -> tuple[list[int], list[int], list[int], list[int]]:
    """(bin of each size, start of each size in its bin, capacity of each bin, its capacity when opened).

    Sizes go by decreasing size, equal ones in their order, each into the open bin that leaves least room.
    If none has room, a bin opens: ``opened`` names its length by its place in caps, from the size and the
    histogram of what is still to be packed.  When all are packed, each bin gets the smallest permitted
    length that holds its contents.
    """
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    names = sorted(set(sizes))
    times = Counter(sizes)
    counts = [times[n] for n in names]
    home, start = [0] * len(sizes), [0] * len(sizes)
    used: list[int] = []
    first: list[int] = []
    rooms: list[int] = []  # distinct free spaces, ascending
    at: dict[int, list[int]] = {}  # bins by free space, the oldest last
    for i in order:
        n = sizes[i]
        j = bisect_left(rooms, n)
        if j < len(rooms):
            room = rooms[j]
            b = at[room].pop()
            if not at[room]:
                del at[room], rooms[j]
        else:
            room, b = caps[opened(n, names, counts)], len(used)
            used.append(0)
            first.append(room)
        home[i], start[i] = b, used[b]
        used[b] += n
        counts[-1] -= 1
        if not counts[-1]:
            names.pop()
            counts.pop()
        room -= n
        if room:
            if room not in at:
                insort(rooms, room)
                at[room] = []
            at[room].append(b)
    return home, start, [caps[bisect_left(caps, u)] for u in used], first


def pack(sizes: Sequence[int], capacities: Sequence[int] = CAPACITIES) -> tuple[list[int], list[int], list[int]]:
    """(bin of each size, start of each size in its bin, capacity of each bin), for sizes of 1 to max(capacities), each bin opened at the smallest length that holds its first size."""
    caps = sorted(set(capacities))
    return _planned(sizes, caps, lambda n, names, counts: bisect_left(caps, n))[:3]


def plans(sizes: Sequence[int], capacities: Sequence[int] = CAPACITIES, attention: float = ATTENTION, longest: int | None = None) -> Iterator[tuple[list[int], list[int], list[int], list[int]]]:
    """Ways to pack, as ``_planned`` returns them.

    One opens bins of the length whose fill costs least a word, the fill being what the sizes that are
    still to be packed can give it; one for each length opens no shorter bin, so that of the shortest
    is ``pack``.
    """
    caps = sorted(set(capacities))
    price = [cost(c, longest or caps[-1], attention) for c in caps]

    def by_fill(n, names, counts):
        return min(range(bisect_left(caps, n), len(caps)), key=lambda k: (price[k] / filled(names, counts, caps[k]), caps[k]))

    yield _planned(sizes, caps, by_fill)
    for least in range(len(caps)):
        yield _planned(sizes, caps, lambda n, names, counts: max(least, bisect_left(caps, n)))  # noqa: B023


def refilled(sizes: Sequence[int], packed: tuple[list[int], list[int], list[int]], capacities: Sequence[int], attention: float, longest: int) -> tuple[list[int], list[int], list[int]]:
    """A packing whose bins that are not full are packed again, jointly over all lengths, as long as that costs less.

    A bin's contents are first split over shorter bins, if those cost less than it does together; then the contents
    of all bins that are left with room are sizes themselves, and share bins of the length that is cheapest for them.
    """
    caps = sorted(set(capacities))
    price = {c: cost(c, longest, attention) for c in caps}
    parts: list[list[int]] = [[] for _ in packed[2]]
    for i, b in sorted(enumerate(packed[0]), key=lambda x: packed[1][x[0]]):
        parts[b].append(i)
    full, open_ = [], []
    for p, c in zip(parts, packed[2]):
        used = sum(sizes[i] for i in p)
        if used == c:
            full.append((p, c))
            continue
        best = [(p, c)]
        for k in range(1, len(caps)):
            if caps[k] > c or max(sizes[i] for i in p) > caps[k - 1]:
                continue
            home, _, short = pack([sizes[i] for i in p], caps[:k])
            if sum(price[x] for x in short) < sum(price[x] for _, x in best):
                best = [([i for i, h in zip(p, home) if h == b], x) for b, x in enumerate(short)]
        open_ += best
    used = [sum(sizes[i] for i in p) for p, _ in open_]
    now = sum(price[c] for _, c in open_)
    for joined in plans(used, caps, attention, longest):
        if (then := sum(price[c] for c in joined[2])) < now:
            now, made = then, [([], c) for c in joined[2]]
            for b, (p, _) in zip(joined[0], open_):
                made[b][0].extend(p)
            best_open = made
            break
    else:
        best_open = open_
    home, start, out = [0] * len(sizes), [0] * len(sizes), []
    for b, (p, c) in enumerate(full + best_open):
        at = 0
        for i in p:
            home[i], start[i] = b, at
            at += sizes[i]
        out.append(c)
    return home, start, out


def pack_jointly(sizes: Sequence[int], capacities: Sequence[int] = CAPACITIES, attention: float = ATTENTION) -> tuple[list[int], list[int], list[int]]:
    """What ``pack`` returns, of the plan over the lengths that costs least once its open bins are packed again and downsized."""
    caps, longest = sorted(set(capacities)), max(capacities)
    made = (refilled(sizes, p[:3], caps, attention, longest) for p in plans(sizes, caps, attention))
    return min(made, key=lambda p: sum(cost(c, longest, attention) for c in p[2]))


def least_cost(sizes: Sequence[int], capacities: Sequence[int] = CAPACITIES, attention: float = ATTENTION, cut: float = CUT) -> float:
    """What any packing and cutting of documents costs at least.

    A word costs no less than in a full bin of the cheapest length.  A piece that is longer than that needs a
    longer bin, which is dearer by as much as it costs more a word, and of which so many such pieces fit; to have none, or
    fewer, a document must be cut.
    """
    caps = sorted(set(capacities))
    price = {c: cost(c, caps[-1], attention) for c in caps}
    rate = min(price[c] / c for c in caps)
    usual = max(c for c in caps if price[c] / c <= rate * (1 + 1e-12))
    more = min(((price[c] - rate * c) / (c // (usual + 1)) for c in caps if c > usual), default=0.0)

    def extra(n: int) -> float:
        # j cuts give j + 1 pieces, of which so many must be long.
        need = lambda j: max(0, -(-(n - usual * (j + 1)) // (caps[-1] - usual))) if caps[-1] > usual else 0
        return min(cut * j + more * need(j) for j in range(-(-n // caps[-1]) - 1, -(-n // usual)))

    return sum(n * rate + extra(n) for n in sizes if n)


def pieces(size: int, longest: int) -> list[int]:
    """A document as pieces of the longest permitted length and a rest."""
    return [longest] * (size // longest) + ([size % longest] if size % longest else [])


def pack_whole(sizes: Sequence[int], capacities: Sequence[int] = CAPACITIES, attention: float = ATTENTION, cut: float = CUT) -> tuple[list[list[int]], list[int], list[int], list[int]]:
    """(pieces of each size, then bin and start of each piece, capacity of each bin) of the plan that costs least.

    Plans cut documents at one of the permitted lengths, pay for every cut, and open no longer sequence
    than that.  Best fit at any single length is among them.
    """
    caps = sorted(set(capacities))
    best = None
    for i, most in enumerate(caps):
        parts = [pieces(n, most) for n in sizes]
        flat = [x for p in parts for x in p]
        cuts = cut * (len(flat) - len(parts))
        for p in plans(flat, caps[: i + 1], attention, caps[-1]):
            p = refilled(flat, p[:3], caps, attention, caps[-1])
            whole = cuts + sum(cost(c, caps[-1], attention) for c in p[2])
            if best is None or whole < best[0]:
                best = whole, parts, p
    return best[1], *best[2]


def _pack_shard(capacities: tuple[int, ...], attention: float, cut: float):
    def run(key, rows):
        rows = rows.sort_by([("doc_id", "ascending"), ("size", "ascending"), ("uid", "ascending")])
        ids, n = rows.column("doc_id").combine_chunks(), rows.column("size").to_numpy()
        parts, home, start, caps = pack_whole(n.tolist(), capacities, attention, cut)
        row = np.repeat(np.arange(len(parts)), [len(c) for c in parts])
        number = [i for c in parts for i in range(len(c))]
        shard = key[0].as_py()
        return pa.table({
            "doc_id": ids.take(pa.array(row)), "piece": pa.array(number, pa.int32()), "n_words": pa.array([x for c in parts for x in c], pa.int64()), "bin": pa.array([(shard << 32) + b for b in home], pa.int64()), "start": pa.array(start, pa.int64()), "capacity": pa.array([caps[b] for b in home], pa.int32()),
        })

    return run


def pack_documents(docs: DataFrame, *, capacities: Sequence[int] = CAPACITIES, attention: float = ATTENTION, cut: float = CUT, shard: int = SHARD) -> DataFrame:
    """One row per piece: doc_id, piece (from 0), n_words, bin, start (in the bin), capacity (of the bin).

    Documents are dealt at random into shards of about ``shard`` pieces that are packed apart, by a hash of id and
    size, and of a number among the rows that have both alike, so bins do not depend on how the rows lie; of each only
    the sizes travel, so a very long text is a number like others.  A document that is longer than where the
    plan cuts gives whole pieces and a rest; pieces keep the document's order, and ties go by id.  Null and
    empty texts give one piece of no words in no bin.  Repeated rows are packed each; null ids are packed
    like others.  Other columns are not read, whatever their names.  No documents: no rows.
    """
    longest = max(capacities)
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), n_words(F.col("text")).alias("size"))
    # Rows that are alike are one row with their number until they are dealt.
    alike = written(sized.groupBy("doc_id", "size").agg(F.count(F.lit(1)).alias("n")), "pack-sizes")
    n = alike.agg(F.sum(F.col("n") * F.ceil(F.col("size") / longest))).first()[0] or 0
    sized = alike.select("doc_id", "size", F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("uid"))
    dealt = sized.filter("size > 0").withColumn("shard", F.pmod(F.xxhash64("doc_id", "size", "uid"), F.lit(int(n // shard) + 1)))
    kind = "doc_id long, piece int, n_words long, bin long, start long, capacity int"
    packed = dealt.groupBy("shard").applyInArrow(_pack_shard(tuple(capacities), attention, cut), kind)
    none = sized.filter("size = 0").selectExpr("doc_id", "0 piece", "0L n_words", "cast(null as long) bin", "0L start", "0 capacity")
    return packed.unionByName(none)
