"""Question answering as a bounded loop over the questions that are not settled yet, a table for each pass."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sextant.errors import ConfigError
from sextant.functions.classify import is_structural, question_class
from sextant.functions.text import strip
from sextant.operators.answers import Answers, extractive
from sextant.operators.embedding import Provider
from sextant.operators.grounding import context_tokens, grounding
from sextant.operators.remote import attempted
from sextant.operators.search import citations, top_k
from sextant.tables import written

#: Results of a search, retries, confidence to accept, mean score that ends summaries and syntheses early.
K, MAX_RETRIES, ACCEPT, EARLY = 5, 2, 0.8, 0.4

#: Prompt by class of question; {context} and {question} are filled in.
PROMPTS = {
    "summarize": "Summarise what these passages say, in short and with the key points listed.\n\nPassages:\n{context}\n\nWhat to summarise: {question}\n\nSummary:",
    "synthesis": "Use these passages as the main source. Connections and proposals are welcome as long as the passages bear them out.\n\nPassages:\n{context}\n\nTask: {question}\n\nResponse:",
    "": "Answer from these passages alone and say so if they do not hold the answer.\n\nPassages:\n{context}\n\nQuestion: {question}\n\nAnswer:",
    "refusal": "Nothing was found that answers this question. Decline politely.\n\nQuestion: {question}\n\nReply:",
}
NO_CONTEXT = "(No relevant context was found.)"


def context_block(passages: Column) -> Column:
    """Passages numbered from 1, a blank line between them."""
    numbered = F.transform(passages, lambda x, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), x))
    return F.when(F.size(F.coalesce(passages, F.array().cast("array<string>"))) == 0, NO_CONTEXT).otherwise(F.array_join(numbered, "\n\n"))


def prompt(question: Column, query_type: Column, passages: Column) -> Column:
    def fill(t: str) -> Column:
        a, b = t.split("{question}")
        parts = a.split("{context}")
        return F.concat(F.lit(parts[0]), *([context_block(passages), F.lit(parts[1])] if len(parts) > 1 else []), question, F.lit(b))
    none = F.size(F.coalesce(passages, F.array().cast("array<string>"))) == 0
    return F.when(none, fill(PROMPTS["refusal"])).when(query_type == "summarize", fill(PROMPTS["summarize"])).when(query_type == "synthesis", fill(PROMPTS["synthesis"])).otherwise(fill(PROMPTS[""]))


def decide(answer: Column, confidence: Column, count: Column, error: Column, max_retries: int = MAX_RETRIES, accept: float = ACCEPT) -> Column:
    """accept, refuse or retry, after ``count`` passes."""
    good = (strip(F.coalesce(answer, F.lit(""))) != "") & (confidence >= accept)
    return F.when(good, "accept").when(count > max_retries, "refuse").when(error.isNotNull(), "refuse").otherwise("retry")


def blank(c: Column) -> Column:
    """Null or nothing but white space."""
    return strip(F.coalesce(c, F.lit(""))) == ""


def problems(stage: str, question: Column, results: Column | None = None, answer: Column | None = None, confidence: Column | None = None, refusal_reason: Column | None = None, error: Column | None = None) -> Column:
    """What a state lacks for a stage (retrieval, answer, grounding, complete): an array of sentences, empty if nothing.

    results is null where no search was made; an empty array is a search that found nothing.
    """
    need = {"initial": 1, "retrieval": 1, "answer": 2, "grounding": 3, "complete": 0}
    if stage not in need:
        raise ConfigError(f"no stage {stage!r}; known: {', '.join(need)}")
    none = F.lit(None).cast("string")
    full = lambda c: ~blank(none if c is None else c)
    #: The sentences.
    said = [
        F.when(~full(question), "question must be a non-empty string"),
        F.when(F.lit(True) if results is None else results.isNull(), "search_results must be present before answer generation"),
        F.when(~full(answer), "answer must be a non-empty string for grounding check"),
    ][: need[stage]]
    if stage == "complete":
        sure = F.coalesce(F.lit(0.0) if confidence is None else confidence, F.lit(0.0))
        said = [
            F.when(~(full(answer) | full(refusal_reason) | full(error)), "completed state must have an answer, refusal_reason, or error"),
            F.when(full(answer) & ~sure.between(0.0, 1.0), "confidence must be a float between 0.0 and 1.0"),
        ]
    return F.array_compact(F.array(*said))


def refusal_message(question: Column, found: Column, confidence: Column, error: Column, count: Column, ascii_words: bool = False) -> Column:
    """Why there is no answer, as the user reads it; ascii_words as in question_class. The sentences."""
    structural = (
        "This system uses semantic search and cannot look up content by chapter, page, or section number. Try asking about a specific topic instead — for example, "
        "\"Summarize the key points of bicameralism\" rather than \"Give me the key points of chapter 2\"."
    )
    q = F.concat(F.lit('"'), question, F.lit('"'))
    first = (
        F.when(~found, F.concat(F.lit("No relevant documents were found in the knowledge base for: "), q))
        .when(confidence > 0, F.concat(F.lit("The available evidence was not strong enough to provide a reliable answer (confidence: "), F.format_string("%.0f", F.bround(confidence * 100, 0)), F.lit("%).")))
        .otherwise(F.concat(F.lit("The retrieved documents did not contain sufficient information to answer: "), q))
    )
    more = F.concat_ws(
        " ", first, F.when(error.isNotNull(), F.concat(F.lit("Additionally, an error occurred: "), error)),
        F.when(count > 1, F.concat(F.lit("The system attempted "), count.cast("string"), F.lit(" times before giving up."))), F.lit("Please try rephrasing your question or providing more context."),
    )
    return F.when(is_structural(question, ascii_words), structural).otherwise(more)


def ask(questions: DataFrame, vectors: DataFrame, embed: Provider, answer: Answers = extractive, *, k: int = K, max_retries: int = MAX_RETRIES, accept: float = ACCEPT, early: float = EARLY, where: dict | None = None) -> DataFrame:
    """One row per question (question_id, question): query_type, answer, confidence, citations, grounding, retries, action, refusal_reason, error.

    Each step is written to the shared folder and read back: questions with their vectors, what is found for
    them, and each pass's answers with what was decided of them.  So a provider is asked once for each open
    question and pass, whatever it says the next time, and accepting, refusing and trying again go by the same
    answer; a lost executor repeats its part of one pass.  Retrieval does not depend on the pass and is made
    once.  A provider that says that it ``repeats`` itself is asked in the first pass only.

    A question that cannot be embedded or answered has the provider's error in its row and is refused; it ends
    nothing.  Rows with equal ids are questions of their own.  The written tables are deleted by ``tables.scratch``.
    """
    on = question_class(F.col("question")) != "unsupported"
    q = questions.select("question_id", "question").withColumn("_row", F.monotonically_increasing_id())
    q = q.withColumns({"query_type": question_class(F.col("question")), "_e": attempted(embed, strip(F.when(on, F.col("question"))))})
    q = written(q, "ask-questions")
    off, on = q.filter("query_type = 'unsupported'"), q.filter("query_type != 'unsupported'")
    if "source" not in vectors.columns:
        vectors = vectors.withColumn("source", F.lit(None).cast("string"))
    rows = top_k(vectors, on.select(F.col("_row").alias("question_id"), F.col("_e.value").alias("embedding")), k=k, where=where, keep=("content", "source"))
    cited = citations(rows).groupBy(F.col("question_id").alias("_row")).agg(F.array_sort(F.collect_list(F.struct("rank", "source", "chunk_id", "text", "score"))).alias("citations"), F.round(F.avg("score"), 4).alias("mean_score"))
    failed = F.concat(F.lit("The question could not be embedded: "), F.col("_e.error"))
    s = on.withColumn("search_error", failed).drop("_e").join(cited, "_row", "left")
    s = s.withColumn("passages", F.coalesce(F.transform("citations", lambda c: c["text"]), F.array().cast("array<string>")))
    state = written(s.withColumn("context", context_tokens(F.col("passages"))), "ask-found")
    passes = _passes(state, answer, max_retries, accept, early)
    ok = F.col("action") == "accept"
    out = state.join(passes, "_row")
    out = out.withColumn("confidence", F.when(~ok, 0.0).when(F.col("is_early"), F.col("mean_score")).otherwise(F.col("grounding_confidence")))
    out = out.withColumn("refusal_reason", F.when(~ok, refusal_message(F.col("question"), F.size("passages") > 0, F.col("grounding_confidence"), F.col("error"), F.col("retry_count"))))
    out = out.withColumn("answer", F.when(ok, F.col("answer")))
    cols = ["question_id", "question", "query_type", "answer", "confidence", "is_grounded", "retry_count", "action", "refusal_reason", "error", "unsupported_claims", "citations"]
    none = off.withColumns({
        "answer": F.lit(None).cast("string"), "confidence": F.lit(0.0), "is_grounded": F.lit(False), "retry_count": F.lit(0), "action": F.lit("refuse"), "error": F.lit(None).cast("string"),
        "refusal_reason": refusal_message(F.coalesce("question", F.lit("your question")), F.lit(False), F.lit(0.0), F.lit(None).cast("string"), F.lit(0)),
        "unsupported_claims": F.array().cast("array<string>"), "citations": F.lit(None).cast(out.schema["citations"].dataType),
    })
    return out.select(*cols).unionByName(none.select(*cols))


def _passes(state: DataFrame, answer: Answers, max_retries: int, accept: float, early: float) -> DataFrame:
    """By _row, what the pass that settled a question says: answer, error, grounding, retry_count, action."""
    repeats, settled, open_ = getattr(answer, "repeats", False), [], state
    for count in range(1, 2 if repeats else max_retries + 2):
        # Nothing is asked where nothing was found or the search failed.
        asked = F.when((F.size("passages") > 0) & F.col("search_error").isNull(), prompt(F.col("question"), F.col("query_type"), F.col("passages")))
        d = open_.withColumn("_a", attempted(answer, asked, F.col("passages")))
        d = written(verified(d, count, max_retries, accept, early), f"ask-pass-{count}")
        settled.append(d.filter("action != 'retry'"))
        again = d.filter("action = 'retry'")
        if repeats:
            settled.append(again.withColumns({"action": F.lit("refuse"), "retry_count": F.lit(max_retries + 1)}))
        elif again.isEmpty():
            break
        open_ = state.join(again.select("_row"), "_row", "left_semi")
    return reduce(DataFrame.unionByName, settled)


def verified(asked: DataFrame, count: int, max_retries: int = MAX_RETRIES, accept: float = ACCEPT, early: float = EARLY) -> DataFrame:
    """What is decided of the answers (_a: value and error) of one pass: a row for each _row.

    A summary or synthesis whose passages are near enough on average is accepted as it is.
    """
    d = asked.select("_row", "query_type", "mean_score", "search_error", "passages", "context", F.col("_a.value").alias("answer"), F.col("_a.error").alias("failure"))
    bare = blank(F.col("answer"))
    d = d.withColumn("_v", grounding(F.col("answer"), F.col("context"), F.size("passages")))
    why = F.coalesce(F.col("search_error"), F.concat(F.lit("The answer provider failed: "), F.col("failure")), F.when(bare, "Cannot verify: the answer is empty"))
    d = d.withColumns({
        "error": why, "is_early": F.col("query_type").isin("synthesis", "summarize") & F.coalesce(F.col("mean_score") >= early, F.lit(False)) & why.isNull(),
        "is_grounded": ~bare & F.col("_v.is_grounded"), "grounding_confidence": F.when(bare, 0.0).otherwise(F.col("_v.confidence")), "unsupported_claims": F.col("_v.unsupported_claims"),
    })
    act = decide(F.col("answer"), F.col("grounding_confidence"), F.lit(count), F.col("error"), max_retries, accept)
    d = d.withColumn("action", F.when(F.col("is_early"), "accept").otherwise(act)).withColumn("retry_count", F.when(F.col("is_early"), 0).otherwise(count))
    return d.select("_row", "answer", "error", "is_early", "is_grounded", "grounding_confidence", "unsupported_claims", "retry_count", "action")
