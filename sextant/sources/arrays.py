"""Entries of large JSON arrays, read by many tasks.

A file is read in fragments that end at a closing brace, which Spark splits like lines.  Whether a split starts
within a string, and how deep, follows from the splits before it: a first pass says of each split what it does
for either case, a row a split, and those are added up in order.  A second pass then cuts each split at the
commas between entries.  An entry that goes on in the next split is put together from its parts.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sextant.tables import written

_TOKEN = re.compile(r'\\.|["{}\[\],]', re.DOTALL)
_DEPTH = {"{": 1, "[": 1, "}": -1, "]": -1}


def fragments(spark: SparkSession, path: str) -> DataFrame:
    """file, block (where its split starts), value, its bytes and those of the file, in order within a split."""
    raw = spark.read.option("lineSep", "}").text(path)
    return raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value", F.octet_length("value").alias("bytes"), F.col("_metadata.file_size").alias("size"))


def _splits(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], Iterator[tuple]]]:
    """((file, block), its rows: fragment, bytes, size of the file) one split after the other; a fragment gets its brace back."""
    rows = (r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns)))
    for key, part in groupby(rows, lambda r: r[:2]):
        yield key, ((v + "}", n, size) for _, _, v, n, size in part)


def _summaries(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What a split does if it starts outside a string, and inside: change of depth, and commas by relative depth.

    A quote ends a string in one case and starts one in the other, so one walk serves both.
    """
    for (file, block), parts in _splits(batches):
        inside, depth, commas, read, size = 0, [0, 0], [{}, {}], 0, 0
        for text, n, size in parts:
            read += n + 1
            for m in _TOKEN.finditer(text):
                t = m.group()
                if t == '"':
                    inside = 1 - inside
                elif t in _DEPTH:
                    depth[inside] += _DEPTH[t]
                elif t == ",":
                    commas[inside][depth[inside]] = commas[inside].get(depth[inside], 0) + 1
        # What happens outside strings is that of the first case where inside is 0, of the second where it is 1.
        yield pa.RecordBatch.from_pydict({"file": [file], "block": pa.array([block], pa.int64()), "said": [json.dumps([inside, depth, commas, read, size])]})


def _started(rows: list) -> tuple[dict, dict]:
    """({(file, block): (inside, depth, entries closed before)}, {file: how it ends}) from the rows of all splits."""
    starts, ends = {}, {}
    for file, mine in groupby(sorted(rows), lambda r: r[0]):
        inside, depth, closed, read = 0, 0, 0, 0
        for _, block, said in mine:
            flips, change, commas, n, size = json.loads(said)
            read += n
            starts[file, block] = inside, depth, closed
            closed += commas[inside].get(str(1 - depth), 0)
            depth, inside = depth + change[inside], inside ^ flips
        # The last fragment has no brace behind it, unless the file ends with one (three bytes may be a byte order mark).
        ends[file] = inside, depth + (not inside and read - size in (1, -2))
    return starts, ends


def _cut(parts: Iterable[tuple], inside: int, depth: int, position: int) -> Iterator[tuple[int, bool, str]]:
    """(position, whether a comma or the end of the array closes it here, text) of the entries of a split; -1 for text that is in no array."""
    held: list[str] = []
    for text, _, _ in parts:
        at = 0
        for m in _TOKEN.finditer(text):
            t = m.group()
            if t == '"':
                inside = 1 - inside
            elif inside or len(t) > 1:
                continue
            elif t == "," and depth == 1:
                yield position, True, "".join(held) + text[at : m.start()]
                held, at, position = [], m.end(), position + 1
            elif t in _DEPTH:
                depth += _DEPTH[t]
                if t == "[" and depth == 1:
                    if (before := text[at : m.start()].strip("\ufeff \t\r\n")) or held:
                        yield -1, True, "".join(held) + before
                    held, at = [], m.end()
                elif t == "]" and depth == 0:
                    yield position, True, "".join(held) + text[at : m.start()]
                    held, at = [], m.end()
        held.append(text[at:])
    # What stands behind the last fragment is a brace that may not be there.
    yield position if depth > 0 or inside else -1, False, "".join(held)


def array_entries(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(entries: file, position, entry; failures: file, error) of files that hold a JSON array each.

    An entry is the text between two commas of the array, whatever it is; an array that does not end, or text
    outside it, is a failure, and the entries that are closed are read all the same.  The driver gets one row
    for each split of the files.
    """
    rows = fragments(spark, path)
    said = rows.mapInArrow(_summaries, "file string, block long, said string").collect()
    starts, ends = _started([tuple(r) for r in said])
    share = spark.sparkContext.broadcast(starts)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["file", "block", "position", "whole", "entry"]
        for (file, block), parts in _splits(batches):
            start, out, size = share.value[file, block], [], 0
            for i, (position, closed, text) in enumerate(_cut(parts, *start)):
                out.append((file, block, position, closed and (i > 0 or block == 0), text))
                size += len(text)
                if size > 1 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names)
                    out, size = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names)

    d = written(rows.mapInArrow(run, "file string, block long, position long, whole boolean, entry string"), "array-entries")
    whole = d.filter("whole and position >= 0").select("file", "position", "entry")
    # An entry in parts: they are few, and those of one entry lie in splits one after the other.
    parts = d.filter("not whole and position >= 0").groupBy("file", "position").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "entry"))), lambda x: x["entry"]), "").alias("entry"))
    open_ = spark.createDataFrame([(f, "the array does not end") for f, end in ends.items() if end != (0, 0)], "file string, error string")
    odd = d.filter("position = -1 and trim(' \t\r\n}]' from entry) != ''").select("file").distinct().withColumn("error", F.lit("there is text outside the array"))
    last = d.groupBy("file").agg(F.max("position").alias("position"))
    # An open array's last text is no entry; nor is nothing at all before the end.
    blank = F.trim(F.regexp_replace("entry", r"\s+", " ")) == ""
    unclosed = last.join(open_.select("file"), "file", "left_semi")
    every = whole.unionByName(parts).join(unclosed, ["file", "position"], "left_anti").join(last.withColumnRenamed("position", "last"), "file")
    return every.filter(~(blank & (F.col("position") == F.col("last")))).drop("last"), open_.unionByName(odd)
