"""Tokens and sentences as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sextant.functions.text import SPACES, strip

#: Words that carry no evidence, and filler words of questions.
STOP_WORDS = tuple(
    "a an the is are was were be been being have has had do does did will would shall should may might can could of in on at to for with by from and or but not no nor so yet as if "
    "it its this that these those i me my we our you your he him his she her they them their what which who whom how when where why".split()
)
FILLERS = tuple("please tell explain describe define about".split())


def token_list(c: Column, fillers: bool = False) -> Column:
    """Lower-case runs of a-z and 0-9 longer than one character, without stop words, in order."""
    drop = STOP_WORDS + (FILLERS if fillers else ())
    return F.filter(F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0)), lambda t: (F.length(t) > 1) & ~t.isin(*drop))


def token_set(c: Column, fillers: bool = False) -> Column:
    return F.array_distinct(token_list(c, fillers))


def sentences(c: Column) -> Column:
    """Pieces after . ! or ? and white space; blank ones dropped."""
    return F.filter(F.transform(F.split(strip(c), rf"(?U)(?<=[.!?]){SPACES}+", -1), strip), lambda s: s != "")


def truncate(c: Column, n: int) -> Column:
    """White space collapsed; at most n characters, the last three dots where cut."""
    one = strip(F.regexp_replace(c, F.lit(rf"(?U){SPACES}+"), F.lit(" ")))
    return F.when(F.length(one) > n, F.concat(F.substring(one, 1, n - 3), F.lit("..."))).otherwise(one)
