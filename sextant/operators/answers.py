"""Answer providers by name, and what a text costs in tokens."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from sextant.errors import ProviderError
from sextant.functions.text import SPACES, strip
from sextant.functions.tokens import sentences
from sextant.operators import remote

#: (prompt, passages) to an answer.
Answers = Callable[[Column, Column], Column]
_providers: dict[str, Callable[..., Answers]] = {}


def register(name: str, make: Callable[..., Answers]) -> None:
    """Make a provider known: a function of options that gives a function of (prompt, passages)."""
    _providers[name] = make


def known() -> list[str]:
    return sorted(_providers)


def provider(name: str = "extractive", **options) -> Answers:
    if name not in _providers:
        raise ProviderError(f"no answer provider {name!r}; known: {', '.join(known())}")
    return _providers[name](**options)


def extractive(prompt: Column, passages: Column, n: int = 2) -> Column:
    """An answer without a model: the first sentences of the best passage."""
    return F.array_join(F.slice(sentences(F.coalesce(F.get(passages, F.lit(0)), F.lit(""))), 1, n), " ")


#: A provider that repeats itself need not be asked again.
extractive.repeats = True


def _extractive(n: int = 2) -> Answers:
    def answer(prompt: Column, passages: Column) -> Column:
        return extractive(prompt, passages, n)

    answer.repeats = True
    return answer


register("extractive", _extractive)
register("remote", remote.answers)


def tokens_by_length(text: Column) -> Column:
    """A token for four characters, one at least; 0 for null and empty texts."""
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, 0).otherwise(F.greatest(F.lit(1), F.floor(F.length(text) / 4).cast("int")))


def tokens_by_words(text: Column) -> Column:
    """1.3 tokens for a word, rounded down; 0 for null and empty texts."""
    inner = strip(F.coalesce(text, F.lit("")))
    n = F.when(inner == "", 0).otherwise(F.size(F.split(inner, rf"(?U){SPACES}+", -1)))
    return F.floor(n * F.lit(1.3)).cast("int")
