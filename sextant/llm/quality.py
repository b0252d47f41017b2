"""Quality rules: a threshold table compiled into one projection of ratios, without user functions."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sextant.llm.base import SPACE, words

#: Frequent function words of the four languages of the corpus.
STOP_WORDS = (
    "a an and are as at be by for from had has have he her his i in is it its not of on or she that the their they this to was were which who will with you "
    "aber als am an auch auf aus bei das dass dem den der des die durch ein eine einen einer er es für hat ich im in ist mit nach nicht sich sie sind über um und von vor war werden wie wird zu zum zur "
    "au aux avec ce ces cette dans de des du elle en est et eux il ils je la le les leur lui ma mais me ne nous on ou où par pas pour qu que qui sa se ses son sont sur un une vous "
    "al con como del el ella en entre era es esta este ha hay la las lo los más me mi no o para pero por que se si sin sobre su sus también un una uno y ya"
)


@dataclass(frozen=True)
class Rule:
    """metric must lie in [low, high]; None leaves a side open."""

    name: str
    metric: str
    low: float | None = None
    high: float | None = None

    def holds(self) -> Column:
        ok = F.lit(True)
        if self.low is not None:
            ok = ok & (F.col(self.metric) >= self.low)
        if self.high is not None:
            ok = ok & (F.col(self.metric) <= self.high)
        return ok


#: The threshold table. Ratios are per word or per line with a word.
RULES: tuple[Rule, ...] = (
    Rule("length", "n_words", 20, None),
    Rule("mean_word_length", "mean_word_length", 2.0, 16.0),
    Rule("symbols", "symbol_ratio", None, 0.1),
    Rule("stop_words", "stop_word_ratio", 0.05, None),
    Rule("capitals", "capital_ratio", None, 0.5),
    Rule("exclamations", "exclamation_ratio", None, 0.3),
    Rule("duplicate_lines", "dup_line_ratio", None, 0.5),
    Rule("bullet_lines", "bullet_line_ratio", None, 0.9),
    Rule("ellipsis_lines", "ellipsis_line_ratio", None, 0.3),
    Rule("repeated_words", "repeat_word_ratio", None, 0.3),
)


def _windows(d: DataFrame, h: str, size: int, out: str) -> DataFrame:
    """A hash of each window of ``size`` words, joined from hashes of halves; each array is a column of its own."""
    if size == 1:
        return d.withColumn(out, F.col(h))
    a, b = f"{out}_{size // 2}", f"{out}_{size - size // 2}"
    d = _windows(d, h, size // 2, a)
    d = d if a == b else _windows(d, h, size - size // 2, b)
    n = F.greatest(F.size(h) - (size - 1), F.lit(0))
    return d.withColumn(out, F.zip_with(F.slice(a, 1, n), F.slice(b, 1 + size // 2, n), lambda x, y: F.xxhash64(x, y))).drop(a, b)


def _covered(grams: Column, size: int) -> Column:
    pairs = F.array_sort(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("p"))))
    twins = F.zip_with(F.slice(pairs, 1, F.size(pairs) - 1), F.slice(pairs, 2, F.size(pairs) - 1), lambda a, b: F.when(a["g"] == b["g"], F.array(a["p"], b["p"])))
    places = F.array_sort(F.array_distinct(F.flatten(F.filter(twins, lambda x: x.isNotNull()))))
    gaps = F.zip_with(F.slice(places, 1, F.size(places) - 1), F.slice(places, 2, F.size(places) - 1), lambda a, b: F.least(b - a, F.lit(size)))
    return F.aggregate(gaps, F.lit(size), lambda s, x: s + x)


def measure(docs: DataFrame, *, text_col: str = "text", window: int = 8, stop_words: Sequence[str] = tuple(STOP_WORDS.split())) -> DataFrame:
    """docs with the metrics of each whole text, in narrow projections; a null text counts as empty."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    mine = docs.columns
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    d = docs.select(*mine, words(F.col(text_col)).alias("_w"), lines.alias("_l"), t.alias("_t"))
    d = d.withColumn("n_words", F.size("_w").cast("long"))
    d = d.withColumn("_h", F.transform("_w", lambda w: F.xxhash64(w)))
    stops = sorted(set(stop_words))
    d = d.withColumns({
        "word_chars": F.length(F.regexp_replace("_t", SPACE, "")).cast("long"),
        "n_symbols": F.regexp_count("_t", F.lit(r"[#*$%&|<>]")).cast("long"),
        "_lines": F.size("_l").cast("long"),
        "n_dup_lines": (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"),
        "_bullets": F.size(F.filter("_l", lambda x: x.rlike(r"^[\x20\x09]*[-*•]\x20"))).cast("long"),
        "_dots": F.size(F.filter("_l", lambda x: x.rlike(r"(\.\.\.|…)[\x20\x09\x0D]*$"))).cast("long"),
        "_caps": F.regexp_count("_t", F.lit(r"\p{Lu}")).cast("long"),
        "_bangs": F.regexp_count("_t", F.lit("!")).cast("long"),
        "_stops": F.size(F.filter("_w", lambda w: F.lower(w).isin(stops))).cast("long"),
    })
    d = _windows(d, "_h", window, "_g")
    twice = F.size("_g") > F.size(F.array_distinct("_g"))
    d = d.withColumn("n_repeat_words", F.when(twice, _covered(F.col("_g"), window)).otherwise(0).cast("long"))
    per_word = lambda c: F.col(c) / F.greatest(F.col("n_words"), F.lit(1))
    per_line = lambda c: F.col(c) / F.greatest(F.col("_lines"), F.lit(1))
    d = d.withColumns({
        "mean_word_length": per_word("word_chars"), "symbol_ratio": per_word("n_symbols"), "stop_word_ratio": per_word("_stops"),
        "capital_ratio": F.col("_caps") / F.greatest(F.col("word_chars"), F.lit(1)), "exclamation_ratio": per_word("_bangs"), "repeat_word_ratio": per_word("n_repeat_words"),
        "dup_line_ratio": per_line("n_dup_lines"), "bullet_line_ratio": per_line("_bullets"), "ellipsis_line_ratio": per_line("_dots"),
    })
    return d.drop("_w", "_l", "_t", "_h", "_g", "_lines", "_bullets", "_dots", "_caps", "_bangs", "_stops")


def judge(measured: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """measured with failed_rules and kept: true if every rule of the table holds."""
    failed = F.array_compact(F.array(*[F.when(~r.holds(), F.lit(r.name)) for r in rules])) if rules else F.array().cast("array<string>")
    return measured.withColumn("failed_rules", failed).withColumn("kept", F.size("failed_rules") == 0)


def quality_report(docs: DataFrame, rules: Sequence[Rule] = RULES, **names) -> DataFrame:
    """Per row: the base measures, base_failed, the ratios, failed_rules, kept.

    Null and empty texts have no words and fail on length.  Rows are judged alone, so repeated rows
    get equal verdicts and an empty table an empty report; other columns of docs are not touched.
    """
    d = judge(measure(docs.select("doc_id", "text"), **names), rules)
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return d.withColumn("base_failed", base).withColumn("kept", F.col("kept") & ~F.col("base_failed")).drop("text")
