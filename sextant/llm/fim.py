"""Fill-in-the-middle texts: a document cut at two places and put together again around control strings.

An Arrow-batched function finds the ends of a text's units into a compact array, looks two offsets up in it
and slices; seeds come from SHA-256 of the row's id, so reruns and any partitioning agree.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Callable, Sequence
from itertools import chain

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: A unit is a word with the white space before it, or white space at the end of a text.
UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
#: What marks prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")
#: Per cent of rows that are cut, and of these that put the suffix first.
RATE, SUFFIX_FIRST = 50, 80
_MADE = "n long, form string, prefix_chars long, middle_chars long, output string, output_sha256 string"


def check_marks(marks: Sequence[str]) -> tuple[str, str, str]:
    """Three marks that show where they stand in any text without them: none holds another, none starts as one ends."""
    if len(marks) != 3 or not all(marks) or len(set(marks)) != 3:
        raise ValueError("three different marks that are not empty")
    for a in marks:
        for b in marks:
            if a != b and a in b or any(a.endswith(b[:i]) for i in range(1, len(b))):
                raise ValueError(f"marks {a!r} and {b!r} overlap")
    return tuple(marks)


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def draws(seed: int, ident: str) -> list[int]:
    """Four numbers of 32 bits from a row's id."""
    h = sha256(f"{seed}:{ident}")
    return [int(h[i : i + 8], 16) for i in range(0, 32, 8)]


def maker(seed: int = 42, rate: int = RATE, suffix_first: int = SUFFIX_FIRST, marks: Sequence[str] = MARKS) -> Callable[[str, str], tuple]:
    """A function of (id, text) that gives n, form, prefix_chars, middle_chars, output."""
    p, s, m = check_marks(marks)
    unit = regex.compile(UNIT)

    def make(ident: str, text: str) -> tuple:
        ends = array("Q", chain((0,), (x.end() for x in unit.finditer(text))))
        n = len(ends) - 1
        h1, h2, h3, h4 = draws(seed, ident)
        if not n or h3 % 100 >= rate or any(x in text for x in (p, s, m)):
            return n, "plain", None, None, text
        a, b = sorted((ends[h1 % (n + 1)], ends[h2 % (n + 1)]))
        if h4 % 100 < suffix_first:
            return n, "spm", a, b - a, "".join((s, text[b:], p, text[:a], m, text[a:b]))
        return n, "psm", a, b - a, "".join((p, text[:a], s, text[b:], m, text[a:b]))

    return make


def rebuild(output: str, form: str, marks: Sequence[str] = MARKS) -> str:
    """The text that an output of that form was made from."""
    p, s, m = marks
    if form == "plain":
        return output
    head, _, middle = output.partition(m)
    if form == "spm":
        suffix, _, prefix = head[len(s) :].partition(p)
    else:
        prefix, _, suffix = head[len(p) :].partition(s)
    return "".join((prefix, middle, suffix))


def fill_in_middle(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", seed: int = 42, rate: int = RATE, suffix_first: int = SUFFIX_FIRST, marks: Sequence[str] = MARKS) -> DataFrame:
    """Per row: doc_id, n (units), form (plain, psm, spm), prefix_chars, middle_chars, output, output_sha256.

    Rows are worked on alone and whole, in one narrow pass that is linear in a text's length (eight bytes for
    each unit beside the text), so a lost executor costs its tasks.  Null and empty texts are plain and empty; so is
    every text that holds a mark, as it could not be taken apart again.  A null id counts as an empty one;
    rows with equal ids are cut by equal draws.  An empty table gives an empty one.  Other columns are not
    read, whatever their names.
    """
    make = maker(seed, rate, suffix_first, marks)

    @F.pandas_udf(_MADE)
    def made(ids: pd.Series, texts: pd.Series) -> pd.DataFrame:
        rows = [(*(r := make(i or "", t or "")), sha256(r[4])) for i, t in zip(ids, texts)]
        out = pd.DataFrame(rows, columns=["n", "form", "prefix_chars", "middle_chars", "output", "output_sha256"])
        return out.astype({"prefix_chars": "Int64", "middle_chars": "Int64"})

    row = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_t"))
    return row.select("doc_id", made(F.col("doc_id").cast("string"), F.col("_t")).alias("_r")).select("doc_id", "_r.*")


def restored_sha256(output: Column, form: Column, marks: Sequence[str] = MARKS) -> Column:
    """The digest of the text that is rebuilt from an output and its form; a null output is empty."""
    marks = check_marks(marks)

    @F.pandas_udf("string")
    def digest(outputs: pd.Series, forms: pd.Series) -> pd.Series:
        return pd.Series([sha256(rebuild(o or "", f or "plain", marks)) for o, f in zip(outputs, forms)], dtype=object)

    return digest(output, form)


def restored(output: Column, form: Column, marks: Sequence[str] = MARKS) -> Column:
    """The text itself, by expressions: each mark stands once in an output that is not plain."""
    p, s, m = (F.lit(x) for x in check_marks(marks))
    head, middle, two = F.split_part(output, m, F.lit(1)), F.split_part(output, m, F.lit(2)), F.lit(2)
    first = F.when(form == "spm", F.split_part(head, p, two)).otherwise(F.split_part(F.split_part(head, s, F.lit(1)), p, two))
    last = F.when(form == "spm", F.split_part(F.split_part(head, p, F.lit(1)), s, two)).otherwise(F.split_part(head, s, two))
    return F.when(form == "plain", output).otherwise(F.concat(first, middle, last))
