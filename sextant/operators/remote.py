"""Providers behind a call that may fail: batches of texts, retries with growing pauses.

A call is a plain function from a list of texts to a list of results (vectors or answers) that the caller
supplies; it runs on the executors, once a batch, and is tried again where it raises an error that passes.
Where errors are to be rows and not the end of the job, ``attempted`` gives a struct of value and error.
"""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from sextant.errors import AnswerError, ProviderError, Refused

#: Fixed value: the longest pause in seconds.
LONGEST = 60.0


def pause(attempt: int, base: float = 1.0, jitter: float | None = None) -> float:
    """Seconds before the next attempt (from 0): doubled each time, up to a second more by chance, at most a minute."""
    return min(base * 2**attempt + (random.random() if jitter is None else jitter), LONGEST)


def transient(e: Exception) -> bool:
    """Whether an error may pass: not a refusal, nor one whose status says that the request itself is at fault."""
    status = next((v for v in (getattr(e, n, None) for n in ("status_code", "status", "code")) if isinstance(v, int)), None)
    return not isinstance(e, Refused) and (status is None or not 400 <= status < 500 or status in (408, 425, 429))


Passing = Callable[[Exception], bool] | tuple[type[Exception], ...]


def persistent(call: Callable, attempts: int = 3, base: float = 1.0, passing: Passing = transient, sleep: Callable[[float], None] = time.sleep) -> Callable:
    """call, tried so many times while it raises an error that passes (a test, or kinds); the last error is the caller's."""
    if attempts < 1:
        raise ProviderError("attempts are at least 1")
    may_pass = (lambda e: isinstance(e, passing)) if isinstance(passing, tuple) else passing

    def run(*args):
        for i in range(attempts):
            try:
                return call(*args)
            except Exception as e:
                if i == attempts - 1 or not may_pass(e):
                    raise
                sleep(pause(i, base))

    return run


def _checked(call: Callable[[list[str]], Sequence]) -> Callable[[list[str]], list]:
    def run(part: list[str]) -> list:
        back = list(call(part))
        if len(back) != len(part):
            raise ProviderError(f"{len(part)} texts were sent, {len(back)} results came back")
        return back

    return run


def _todo(texts: list[str | None], batch: int) -> Iterator[list[str]]:
    """What is sent of an Arrow batch: each distinct text once, null and blank ones not at all."""
    todo = list(dict.fromkeys(t for t in texts if t and t.strip()))
    for i in range(0, len(todo), batch):
        yield todo[i : i + batch]


def _results(call: Callable[[list[str]], list], batch: int, kind: pa.DataType) -> Callable[[pa.Array], pa.Array]:
    """Results in the order of the texts; an error is the job's."""

    def run(xs: pa.Array) -> pa.Array:
        texts, got = xs.to_pylist(), {}
        for part in _todo(texts, batch):
            got.update(zip(part, call(part)))
        return pa.array([got.get(t) for t in texts], kind)

    return run


def _outcomes(call: Callable[[list[str]], list], once: Callable[[list[str]], list], batch: int, kind: pa.DataType) -> Callable[[pa.Array], pa.Array]:
    """struct(value, error) in the order of the texts: a batch that fails for good is sent again text by text, so an error is that of its row."""

    def alone(t: str) -> tuple:
        try:
            return once([t])[0], None
        except Exception as e:
            return None, str(e) or type(e).__name__

    def run(xs: pa.Array) -> pa.Array:
        texts, got = xs.to_pylist(), {}
        for part in _todo(texts, batch):
            try:
                got.update((t, (v, None)) for t, v in zip(part, call(part)))
            except Exception as e:
                got.update({part[0]: (None, str(e) or type(e).__name__)} if len(part) == 1 else {t: alone(t) for t in part})
        rows = [got.get(t, (None, None)) for t in texts]
        return pa.StructArray.from_arrays([pa.array([v for v, _ in rows], kind), pa.array([e for _, e in rows], pa.string())], ["value", "error"])

    return run


def vectors(call: Callable[[list[str]], Sequence[Sequence[float]]], batch: int = 64, attempts: int = 3, base: float = 1.0, passing: Passing = transient) -> Callable[[Column], Column]:
    """An embedding provider from a call that gives a vector for each text; its ``outcomes`` gives struct(value, error) and fails no job."""
    once = _checked(call)
    run = _results(persistent(once, attempts, base, passing), batch, pa.list_(pa.float32()))
    each = _outcomes(persistent(once, attempts, base, passing), once, batch, pa.list_(pa.float32()))

    @F.arrow_udf("array<float>")
    def embed(xs: pa.Array) -> pa.Array:
        return run(xs)

    @F.arrow_udf("struct<value:array<float>,error:string>")
    def outcomes(xs: pa.Array) -> pa.Array:
        return each(xs)

    def provider(text: Column) -> Column:
        return embed(text)

    provider.outcomes = lambda text: outcomes(text)
    return provider


def answers(call: Callable[..., Sequence[str]], batch: int = 8, attempts: int = 3, base: float = 1.0, passing: Passing = transient, system: str | None = None, **options) -> Callable[[Column, Column], Column]:
    """An answer provider from a call that gives an answer for each prompt; its ``outcomes`` gives struct(value, error) and fails no job.

    system and other options go along with each call, if there are any.
    """
    more = options | ({"system": system} if system is not None else {})
    once = _checked((lambda part: call(part, **more)) if more else call)
    run = _results(persistent(once, attempts, base, passing), batch, pa.string())
    each = _outcomes(persistent(once, attempts, base, passing), once, batch, pa.string())

    @F.arrow_udf("string")
    def say(xs: pa.Array) -> pa.Array:
        try:
            return run(xs)
        except ProviderError:
            raise
        except Exception as e:
            raise AnswerError(f"the answer provider failed {attempts} times: {e}") from e

    @F.arrow_udf("struct<value:string,error:string>")
    def outcomes(xs: pa.Array) -> pa.Array:
        return each(xs)

    def provider(prompt: Column, passages: Column) -> Column:
        return say(prompt)

    provider.outcomes = lambda prompt, passages: outcomes(prompt)
    return provider


def attempted(provider: Callable[..., Column], *columns: Column) -> Column:
    """struct(value, error) of a provider: its own outcomes, or its result without an error where it has none."""
    if hasattr(provider, "outcomes"):
        return provider.outcomes(*columns)
    return F.struct(provider(*columns).alias("value"), F.lit(None).cast("string").alias("error"))
