"""Whether answers are supported by passages, how relevant they are, whether refusals are right."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sextant.functions.text import let
from sextant.functions.tokens import sentences, token_list, token_set

#: Part of a sentence's tokens that passages must have; part of sentences that must be supported.
SENTENCE, ANSWER = 0.3, 0.5


def clamp(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def context_tokens(passages: Column) -> Column:
    """Distinct tokens of an array of passages."""
    return F.array_distinct(F.flatten(F.transform(F.coalesce(passages, F.array().cast("array<string>")), lambda x: token_set(x))))


def _sentence_scores(answer: Column, context: Column) -> Column:
    """Array of (sentence, score): the part of its tokens that the context has; 1 without tokens."""
    def one(s: Column) -> Column:
        part = lambda t: F.when(F.size(t) == 0, 1.0).otherwise(F.size(F.array_intersect(t, context)) / F.size(t))
        return F.struct(s.alias("sentence"), let(token_set(s), part).alias("score"))
    return F.transform(sentences(F.coalesce(answer, F.lit(""))), one)


def grounding(answer: Column, context: Column, n_passages: Column, sentence: float = SENTENCE, least: float = ANSWER) -> Column:
    """struct(is_grounded, confidence, supported_claims, unsupported_claims); context: a column of distinct tokens.

    Without passages nothing is supported.  A blank answer is not grounded, with confidence 0.
    """
    name = lambda xs: F.transform(xs, lambda x: x["sentence"])

    def judged(x: Column) -> Column:
        ok, n = F.size(x["ok"]), F.size(x["ok"]) + F.size(x["no"])
        ratio = F.when(n > 0, ok / n).otherwise(0.0)
        return F.struct(((ratio >= least) & (n > 0)).alias("is_grounded"), F.round(ratio, 4).alias("confidence"), name(x["ok"]).alias("supported_claims"), name(x["no"]).alias("unsupported_claims"))

    def split(scored: Column) -> Column:
        supported = lambda x: (n_passages > 0) & (x["score"] >= sentence)
        return let(F.struct(F.filter(scored, supported).alias("ok"), F.filter(scored, lambda x: ~supported(x)).alias("no")), judged)

    return let(_sentence_scores(answer, context), split)


def groundedness(answer: Column, context: Column, threshold: float = SENTENCE) -> Column:
    """Part of sentences whose token part, rounded to four places, reaches the threshold; blank answers 0."""
    def part(scored: Column) -> Column:
        ok = F.size(F.filter(scored, lambda x: F.round(x["score"], 4) >= threshold))
        return F.when(F.size(scored) > 0, F.round(ok / F.size(scored), 4)).otherwise(0.0)

    return let(_sentence_scores(answer, context), part)


def relevance(question: Column, answer: Column) -> Column:
    """Weighted part of the question's tokens that the answer has, rarer ones counting more, less for short answers.

    A token weighs 2 less its share of the answer's tokens, so those that the answer lacks weigh 2 and only the
    others are counted.
    """
    def scored(x: Column) -> Column:
        q, a, both = x["q"], x["a"], F.array_intersect(x["q"], x["a"])
        total, distinct = F.greatest(F.size(a), F.lit(1)), F.size(F.array_distinct(a))
        weight = lambda t: 2 - F.size(F.filter(a, lambda y: y == t)) / total
        hits = F.aggregate(both, F.lit(0.0), lambda s, t: s + weight(t))
        short = F.when(distinct < F.size(q), 0.5 + 0.5 * distinct / F.size(q)).otherwise(1.0)
        part = let(F.struct(hits.alias("h"), F.size(both).alias("n")), lambda y: y["h"] / (y["h"] + 2.0 * (F.size(q) - y["n"])))
        return F.when(F.size(q) == 0, 1.0).otherwise(F.round(clamp(part * short), 4))

    tokens = F.struct(token_set(question, fillers=True).alias("q"), token_list(F.coalesce(answer, F.lit("")), fillers=True).alias("a"))
    return F.when(F.trim(F.coalesce(answer, F.lit(""))) == "", 0.0).otherwise(let(tokens, scored))


def refusal(expected: Column, reason: Column) -> Column:
    """struct(correct, expected_refusal, actual_refusal, reason)."""
    actual = reason.isNotNull()
    #: The verdicts.
    said = (
        F.when(expected & actual, "Correctly refused to answer.").when(~expected & ~actual, "Correctly provided an answer.")
        .when(expected, "Should have refused but provided an answer.").otherwise(F.concat(F.lit("Should have answered but refused: "), reason))
    )
    return F.struct((expected == actual).alias("correct"), expected.alias("expected_refusal"), actual.alias("actual_refusal"), said.alias("reason"))
