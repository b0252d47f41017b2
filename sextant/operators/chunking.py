"""Chunkers: one document row to many chunk rows, by expressions alone.

A text is cut into parts by one regular expression whose matches lie end to end; offsets are running sums
of their lengths, and pieces are made of neighbouring parts, so the work is in proportion to the text.  Only
windows that may end before the one before them do are folded by an Arrow function.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sextant.errors import ConfigError
from sextant.functions.text import SPACES, let, lstrip, strip

_PIECE = pa.list_(pa.struct([("content", pa.string()), ("start_idx", pa.int32()), ("end_idx", pa.int32()), ("sentence_count", pa.int32())]))
_PIECE_SQL = "array<struct<content:string,start_idx:int,end_idx:int,sentence_count:int>>"
#: Characters that a cut may move back to reach white space.
LOOK_BACK = 100
_ANY, _NONE = SPACES, SPACES.replace("[", "[^")
# A sentence ends after . ! or ? with white space behind it (with that, where a letter follows), and after a newline and the
# white space behind that.  Each match is a sentence with all up to the next one.
SENTENCE = rf"(?sU).+?(?:(?<=[.!?])(?:{_ANY}+(?=[A-Za-z])|(?={_ANY}))|(?<=\n){_ANY}*+(?={_NONE})|\z)"


def running(lengths: Column) -> Column:
    """The sum of what stands before each entry of an array of whole numbers.

    Entries are added up in blocks of about the root of their number: taking a part of an array copies the whole of it.
    """
    def total(xs: Column) -> Column:
        return F.aggregate(xs, F.lit(0), lambda s, x: s + x)

    def sums(x: Column) -> Column:
        n, size = x["n"], x["size"]
        blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size(n) / size) - 1, F.lit(0)).cast("int")), lambda b: F.slice(n, b * size + 1, size))
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<at:int,xs:array<int>>>").alias("out"))
        placed = F.aggregate(blocks, start, lambda s, b: F.struct((s["at"] + total(b)).alias("at"), F.concat(s["out"], F.array(F.struct(s["at"].alias("at"), b.alias("xs")))).alias("out")), lambda s: s["out"])
        return F.flatten(F.transform(placed, lambda b: F.transform(b["xs"], lambda x, i: b["at"] + total(F.slice(b["xs"], 1, i)))))

    return let(F.struct(lengths.alias("n"), F.greatest(F.lit(16), F.sqrt(F.size(lengths)).cast("int")).alias("size")), sums)


def before(parts: Column, i: Column, count: int) -> Column:
    """The parts that stand before the i-th, so many of them, put together."""
    return F.concat(*[F.coalesce(F.get(parts, i - j), F.lit("")) for j in range(count, 0, -1)]) if count else F.lit("")


def fixed_pieces(text: str, size: int, overlap: int, words: bool) -> list[dict]:
    """Windows of at most size characters, cut at white space where there is some near; blank ones dropped.

    Each window starts overlap before the last one's end, but always after its start.
    """
    out, start = [], 0
    while start < len(text):
        end = min(start + size, len(text))
        if words and end < len(text):
            low = max(start, end - LOOK_BACK) + 1
            end = max([text.rfind(c, low, end + 1) for c in " \t\n\r"] + [-1]) if any(c in text[low : end + 1] for c in " \t\n\r") else end
        if content := text[start:end].strip():
            out.append({"content": content, "start_idx": start, "end_idx": end, "sentence_count": None})
        start = max(end - overlap, start + 1) if overlap and end < len(text) else end
    return out


def _arrow(cut: Callable[[str], list[dict]]):
    @F.arrow_udf(_PIECE_SQL)
    def run(x: pa.Array) -> pa.Array:
        return pa.array([cut(t) if t else [] for t in x.to_pylist()], _PIECE)

    return run


def check_fixed(size: int, overlap: int) -> None:
    if size <= 0 or not 0 <= overlap < size:
        raise ConfigError("a chunk has at least one character and overlaps by fewer than it has")


def fixed(text: Column, size: int = 500, overlap: int = 0, words: bool = True) -> Column:
    """Array of pieces of a text by size."""
    check_fixed(size, overlap)
    if not words:
        return fixed_closed(text, size, overlap)
    if size - LOOK_BACK < overlap:  # a window may end where the one before it does
        return _arrow(lambda t: fixed_pieces(t, size, overlap, words))(text)
    return fixed_words(text, size, overlap)


def fixed_words(text: Column, size: int, overlap: int) -> Column:
    """Windows that end at white space where there is some in their last characters.

    What each window adds to the one before it are parts that lie end to end: all that is left, or as
    much as reaches white space, or as much as fits.
    """
    least = size - LOOK_BACK + 1

    def window(low: int, most: int) -> str:
        return rf"(?:.{{1,{most}}}+\z|.{{{low},{most}}}(?=[ \t\n\r])|.{{{most}}})"

    back = -(-overlap // (least - overlap))  # parts that hold the characters that a window shares with the one before it

    def pieces(parts: Column) -> Column:
        def piece(x: Column, i: Column, at: Column) -> Column:
            shared = F.substring(before(parts, i, back), -overlap, overlap) if overlap else F.lit("")
            a = F.get(at, i)
            start = F.when(i > 0, a - overlap).otherwise(0)
            return F.struct(strip(F.concat(shared, x)).alias("content"), start.cast("int").alias("start_idx"), (a + F.length(x)).cast("int").alias("end_idx"), F.lit(None).cast("int").alias("sentence_count"))

        made = let(running(F.transform(parts, F.length)), lambda at: F.transform(parts, lambda x, i: piece(x, i, at)))
        return F.filter(made, lambda p: p["content"] != "")

    pattern = rf"(?s)\A{window(least, size)}|{window(least - overlap, size - overlap)}"
    return let(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(0)), pieces)


def fixed_closed(text: Column, size: int = 500, overlap: int = 0) -> Column:
    """The same without regard to words: offsets follow from the length alone.

    The text is cut once into steps, and a piece is made of the steps that it spans, so the work is in
    proportion to the text: finding a place by counting from the start for each piece would not be.
    """
    check_fixed(size, overlap)
    step = size - overlap
    span = -(-size // step)

    def cut(x: Column) -> Column:
        n, steps = x["n"], x["steps"]
        count = F.when(F.coalesce(n, F.lit(0)) == 0, 0).when(n <= size, 1).otherwise(F.ceil((n - size) / step) + 1).cast("int")

        def piece(i: Column) -> Column:
            a = i * step
            content = F.substring(before(steps, i + span, span) if span <= 16 else F.array_join(F.slice(steps, i + 1, span), ""), 1, size)
            return F.struct(strip(content).alias("content"), a.cast("int").alias("start_idx"), F.least(a + size, n).cast("int").alias("end_idx"), F.lit(None).cast("int").alias("sentence_count"))

        pieces = F.transform(F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))), piece)
        return F.when(count > 0, F.filter(pieces, lambda p: p["content"] != "")).otherwise(F.array().cast(_PIECE_SQL))

    return let(F.struct(F.length(text).alias("n"), F.regexp_extract_all(text, F.lit(f"(?s).{{1,{step}}}"), F.lit(0)).alias("steps")), cut)


def by_sentence(text: Column, least: int = 200, most: int = 1000) -> Column:
    """Array of pieces of whole sentences, in order, while their characters (not the joining blanks) stay within most; least is checked but never enforced."""
    if least <= 0 or most <= least:
        raise ConfigError("0 < least < most")

    # A sentence: its text and length, the white space in front of it, and its length with all that is around it.
    def one(x: Column) -> Column:
        return let(strip(x), lambda s: F.struct(s.alias("s"), F.length(s).alias("n"), (F.length(x) - F.length(lstrip(x))).alias("head"), F.length(x).alias("size")))

    piece, kind = ("content", "start_idx", "end_idx", "sentence_count"), "array<struct<content:string,start_idx:int,end_idx:int,sentence_count:int>>"
    zero = F.struct(F.lit("").alias("content"), *[F.lit(0).alias(c) for c in (*piece[1:], "used", "at")], F.array().cast(kind).alias("out"))

    def step(a: Column, x: Column) -> Column:
        """The piece that is being filled, the place in the text, and the pieces that are full."""
        end = a["at"] + x["size"]
        full = (a["sentence_count"] > 0) & (a["used"] + x["n"] > most)
        new = full | (a["sentence_count"] == 0)
        taken = F.struct(
            F.when(new, x["s"]).otherwise(F.concat(a["content"], F.lit(" "), x["s"])).alias("content"), F.when(new, a["at"] + x["head"]).otherwise(a["start_idx"]).alias("start_idx"), end.alias("end_idx"),
            F.when(new, 1).otherwise(a["sentence_count"] + 1).alias("sentence_count"), F.when(new, x["n"]).otherwise(a["used"] + x["n"]).alias("used"), end.alias("at"), F.when(full, kept(a)).otherwise(a["out"]).alias("out"),
        )
        skipped = F.struct(*[a[c].alias(c) for c in (*piece, "used")], end.alias("at"), a["out"].alias("out"))
        return F.when(x["n"] > 0, taken).otherwise(skipped)

    def kept(a: Column) -> Column:
        return F.concat(a["out"], F.array(F.struct(*[a[c].alias(c) for c in piece])))

    parts = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(SENTENCE), F.lit(0))
    return F.aggregate(F.transform(parts, one), zero, step, lambda a: F.when(a["sentence_count"] > 0, kept(a)).otherwise(a["out"]))


def surroundings(text: Column, pieces: Column, window: int) -> Column:
    """For each piece struct(context_before, context_after, text_length): up to window characters on either side, dots where the text goes on.

    The text is cut once into blocks as long as a window, so that what surrounds a piece lies in two of them.
    """
    size = max(window, 1)

    def cut(x: Column) -> Column:
        n, blocks = x["n"], x["blocks"]

        def between(a: Column, b: Column) -> Column:
            two = before(blocks, F.floor(a / size).cast("int") + 2, 2)
            return F.when(b > a, F.substring(two, a % size + 1, b - a)).otherwise("")

        def one(p: Column) -> Column:
            a, b = F.greatest(F.lit(0), p["start_idx"] - window), F.least(n, p["end_idx"] + window)
            before = F.concat(F.when(a > 0, "...").otherwise(""), between(a, p["start_idx"]))
            after = F.concat(between(p["end_idx"], b), F.when(b < n, "...").otherwise(""))
            return F.struct(before.alias("context_before"), after.alias("context_after"), n.alias("text_length"))

        return F.transform(pieces, one)

    t = F.coalesce(text, F.lit(""))
    return let(F.struct(F.length(t).alias("n"), F.regexp_extract_all(t, F.lit(f"(?s).{{1,{size}}}"), F.lit(0)).alias("blocks")), cut)


def chunk(docs: DataFrame, pieces: Column, kind: str, overlap: int = 0, id_col: str = "id", keep: tuple[str, ...] = ("metadata",), context: int | None = None, text: str = "content") -> DataFrame:
    """One row per piece: id ({document}-chunk-{0000}), document_id, content, offsets, chunk_meta, and kept columns.

    context: so many characters on either side come along, and position_info: page and paragraph (of the
    metadata, where it has them), the place of the chunk in its text, length and MD5 of the content.
    """
    if context is not None and context < 0:
        raise ConfigError("a window is not negative")
    cols = [c for c in keep if c in docs.columns]
    d = docs.select(F.col(id_col).cast("string").alias("document_id"), *cols, *([F.col(text).alias("_t")] if context is not None else []), pieces.alias("_p"))
    if context is not None:
        d = d.withColumn("_p", F.arrays_zip(F.col("_p").alias("c"), surroundings(F.col("_t"), F.col("_p"), context).alias("around"))).drop("_t")
    # The inner kind of explode would have the optimizer filter by the number of pieces, and make them all once more for that.
    d = d.select("document_id", *cols, F.size("_p").alias("_n"), F.posexplode_outer("_p").alias("_i", "_c")).filter("_i is not null")
    around = []
    if context is not None:
        d = d.withColumn("_c", F.struct("_c.c.*", "_c.around"))
        around = [F.col("_c.around.context_before"), F.col("_c.around.context_after"), position_info(F.col("_c"), F.col("_c.around.text_length"), F.col("metadata") if "metadata" in cols else None).alias("position_info")]
    over = (F.col("_i") > 0) & F.lit(overlap > 0)
    meta = F.struct(
        F.col("_i").alias("chunk_index"), F.col("_n").alias("total_chunks"), F.lit(kind).alias("chunk_type"), over.alias("has_overlap"), F.when(over, overlap).otherwise(0).alias("overlap_chars"),
    )
    return d.select(F.format_string("%s-chunk-%04d", "document_id", "_i").alias("id"), "document_id", "_c.content", "_c.start_idx", "_c.end_idx", *cols, "_c.sentence_count", meta.alias("chunk_meta"), *around)


def position_info(piece: Column, text_length: Column, metadata: Column | None = None) -> Column:
    """struct(start_char, end_char, char_count, page, paragraph, position, content_hash) of a piece of a text."""
    def known(*keys: str) -> Column:
        return F.coalesce(F.lit(None).cast("int"), *([] if metadata is None else [metadata[k].try_cast("int") for k in keys]))

    return F.struct(
        piece["start_idx"].alias("start_char"), piece["end_idx"].alias("end_char"), F.length(piece["content"]).alias("char_count"), known("page", "page_number").alias("page"), known("paragraph").alias("paragraph"),
        F.when(text_length > 0, piece["start_idx"] / text_length).otherwise(0.0).alias("position"), F.md5(piece["content"]).alias("content_hash"),
    )


def chunk_fixed(docs: DataFrame, text: str = "content", size: int = 500, overlap: int = 0, words: bool = True, **how) -> DataFrame:
    return chunk(docs, fixed(F.col(text), size, overlap, words), "fixed_size", overlap, text=text, **how)


def chunk_sentences(docs: DataFrame, text: str = "content", least: int = 200, most: int = 1000, **how) -> DataFrame:
    return chunk(docs, by_sentence(F.col(text), least, most), "sentence", text=text, **how)
