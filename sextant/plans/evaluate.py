"""Evaluation suites: questions with expectations, scored answers, one row of metrics, reports."""

from __future__ import annotations

import html
import json
import os
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sextant.errors import ConfigError
from sextant.operators.embedding import Provider
from sextant.operators.grounding import clamp, context_tokens, groundedness, refusal, relevance
from sextant.plans.workflow import ask
from sextant.schemas import DIFFICULTIES, EVAL_QUESTION
from sextant.tables import written


def load_suite(spark: SparkSession, path: str) -> DataFrame:
    """Questions of a suite in JSON ({name, questions: [...]}); YAML where the yaml package is installed."""
    if path.endswith(".json"):
        kind = f"name string, description string, version string, questions array<struct<{', '.join(c.strip().replace(' ', ':', 1) for c in EVAL_QUESTION.split(','))}>>"
        return spark.read.schema(kind).option("multiLine", True).json(path).select("name", "version", F.explode("questions").alias("q")).select("name", "version", "q.*")
    if path.endswith((".yaml", ".yml")):
        import yaml

        text = "\n".join(r.value for r in spark.read.text(path).collect())  # a suite is a small configuration file
        suite = yaml.safe_load(text)
        return spark.createDataFrame([{**q, "name": suite["name"]} for q in suite["questions"]], f"name string, {EVAL_QUESTION}")
    raise ConfigError(f"no reader for {path}; known: .json, .yaml, .yml")


def invalid(questions: DataFrame) -> DataFrame:
    """Questions that contradict themselves, with the reason."""
    why = F.when(~F.col("difficulty").isin(*DIFFICULTIES), "difficulty is easy, medium or hard").when(F.col("expected_refusal") & (F.size("expected_answer_contains") > 0), "an expected refusal expects no text")
    return questions.withColumn("problem", why).filter("problem is not null")


def by_tag(questions: DataFrame, tag: str) -> DataFrame:
    return questions.filter(F.array_contains("tags", tag))


def by_difficulty(questions: DataFrame, difficulty: str) -> DataFrame:
    return questions.filter(F.col("difficulty") == difficulty)


def refusals(questions: DataFrame) -> DataFrame:
    """Questions that should be refused."""
    return questions.filter(F.coalesce("expected_refusal", F.lit(False)))


def answerable(questions: DataFrame) -> DataFrame:
    """All other questions; those that say nothing are answerable."""
    return questions.filter(~F.coalesce("expected_refusal", F.lit(False)))


def run(questions: DataFrame, vectors: DataFrame, embed: Provider, **how) -> DataFrame:
    """A suite asked and scored: a row per question, with what ``score`` adds.

    Questions are worked on together, so latency_ms is the time of all divided by their number.  A question
    that cannot be embedded or answered is an error, not a refusal, and has no scores; the rest is scored.  Repeated
    questions are asked each.  how: options of ask.
    """
    q = questions.select(F.monotonically_increasing_id().alias("question_id"), "question", F.coalesce("expected_refusal", F.lit(False)).alias("expected_refusal"))
    q = written(q, "suite")
    start = time.perf_counter()
    got = written(ask(q.select("question_id", "question"), vectors, embed, **how).drop("question"), "suite-answers")
    each = 1000 * (time.perf_counter() - start) / max(got.count(), 1)
    passages = F.coalesce(F.transform("citations", lambda c: c["text"]), F.array().cast("array<string>"))
    d = q.join(got, "question_id").withColumns({"passages": passages, "refusal_reason": F.when(F.col("error").isNull(), F.col("refusal_reason")), "latency_ms": F.lit(each)})
    return score(d.select("question_id", "question", "query_type", "answer", "confidence", "passages", "refusal_reason", "expected_refusal", "error", "latency_ms"))


def score(answers: DataFrame) -> DataFrame:
    """Answers with their scores; columns question, answer, passages, refusal_reason, expected_refusal, error, latency_ms.

    Groundedness and relevance are scored for answers only, neither for refusals nor errors.
    """
    d = answers.withColumn("_r", refusal(F.col("expected_refusal"), F.col("refusal_reason"))).withColumn("_c", context_tokens(F.col("passages")))
    on = F.col("error").isNull() & F.col("refusal_reason").isNull()
    d = d.withColumn("groundedness", F.when(on, groundedness(F.col("answer"), F.col("_c")))).withColumn("relevance", F.when(on, relevance(F.col("question"), F.col("answer"))))
    return d.withColumn("refusal_correct", F.col("_r.correct")).withColumn("refusal_verdict", F.col("_r.reason")).withColumn("latency_ms", F.round("latency_ms", 2)).drop("_r", "_c")


def metrics(scored: DataFrame) -> DataFrame:
    """One row over scored answers; an empty frame gives zeros."""
    ok, no = F.col("error").isNull(), F.col("error").isNotNull()
    answered = ok & F.col("refusal_reason").isNull()
    mean = lambda c, cond, n: F.coalesce(F.round(F.avg(F.when(cond, F.col(c).cast("double"))), n), F.lit(0.0))
    return scored.agg(
        F.count(F.lit(1)).alias("total_questions"), F.count_if(answered).alias("answered"), F.count_if(ok & F.col("refusal_reason").isNotNull()).alias("refused"), F.count_if(no).alias("errors"),
        mean("groundedness", answered, 4).alias("avg_groundedness"), mean("relevance", answered, 4).alias("avg_relevance"), mean("refusal_correct", ok, 4).alias("refusal_accuracy"), mean("latency_ms", F.lit(True), 2).alias("avg_latency_ms"),
    )


def delta(now: DataFrame, base: DataFrame, names: tuple[str, ...] = ("avg_groundedness", "avg_relevance", "refusal_accuracy")) -> DataFrame:
    """metric, now, base, change between two rows of metrics: (=) below 1e-4, else signed to four places."""
    flat = lambda d, to: d.select(F.explode(F.create_map(*[x for n in names for x in (F.lit(n), F.col(n))])).alias("metric", to))
    d = flat(now, "now").join(flat(base, "base"), "metric")
    gap = F.col("now") - F.col("base")
    return d.withColumn("change", F.when(F.abs(gap) < 1e-4, "(=)").otherwise(F.format_string("(%+.4f)", gap)))


def report(scored: DataFrame, name: str) -> dict:
    """A suite's report as a plain dictionary; a suite is a list that people write, so its rows fit the driver."""
    rows = scored.select(F.to_json(F.struct("*")).alias("j")).collect()
    return {"suite": name, "metrics": metrics(scored).first().asDict(), "results": [json.loads(r.j) for r in rows]}


def report_html(rep: dict) -> str:
    """The report as a table; values that are missing show as a dash."""
    say = lambda v: "—" if v is None else html.escape(str(v))
    state = lambda r: "error" if r.get("error") else "refused" if r.get("refusal_reason") else "answered"
    head = "".join(f"<li>{say(k)}: {say(v)}</li>" for k, v in rep["metrics"].items())
    body = "".join(f"<tr><td>{say(r.get('question'))}</td><td>{state(r)}</td><td>{say(r.get('groundedness'))}</td><td>{say(r.get('relevance'))}</td><td>{say(r.get('refusal_correct'))}</td><td>{say(r.get('latency_ms'))}</td></tr>" for r in rep["results"])
    return f"<html><head><meta charset='utf-8'><title>{say(rep['suite'])}</title></head><body><h1>{say(rep['suite'])}</h1><ul>{head}</ul><table><tr><th>Question</th><th>Status</th><th>Groundedness</th><th>Relevance</th><th>Refusal correct</th><th>Latency ms</th></tr>{body}</table></body></html>"


def report_text(rep: dict) -> str:
    return "\n".join([rep["suite"], *(f"{k}: {v}" for k, v in rep["metrics"].items())]) + "\n"


def save_report(rep: dict, folder: str, formats: tuple[str, ...] = ("json", "html", "text")) -> list[str]:
    """Write the report to the folder, a file for each format, named after the suite; the paths."""
    writers = {"json": ("json", lambda r: json.dumps(r, indent=2, ensure_ascii=False, default=str)), "html": ("html", report_html), "text": ("txt", report_text)}
    if odd := [f for f in formats if f not in writers]:
        raise ConfigError(f"no report format {odd[0]!r}; known: {', '.join(writers)}")
    os.makedirs(folder, exist_ok=True)
    out = []
    for f in formats:
        end, write = writers[f]
        out.append(os.path.join(folder, f"{rep['suite']}.{end}"))
        with open(out[-1], "w", encoding="utf-8") as to:
            to.write(write(rep))
    return out


def load_baseline(path: str) -> dict:
    """The metrics of a report that was saved as JSON."""
    with open(path, encoding="utf-8") as f:
        return json.load(f)["metrics"]


def state_to_result(state: DataFrame) -> DataFrame:
    """Confidence brought to 0 to 1, a missing answer as empty text."""
    return state.withColumn("confidence", clamp(F.coalesce("confidence", F.lit(0.0)))).withColumn("answer", F.coalesce("answer", F.lit("")))
