"""Settings to parts that work together: source, store, embedding and answer providers."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sextant.errors import RetrievalError
from sextant.operators import answers, embedding, store
from sextant.plans import evaluate, ingest, workflow
from sextant.sources import files


@dataclass
class Engine:
    """What a set of settings describes; made by ``engine``."""

    spark: SparkSession
    settings: Mapping
    store: store.VectorStore
    embed: embedding.Provider
    answer: answers.Answers

    def ingest(self, path: str) -> tuple[dict, DataFrame]:
        """(summary, errors) of reading, cleaning, chunking, embedding and storing what is at the path."""
        o = self.settings["ingestion"]
        if o["connector"] in ("local", "s3"):
            docs, failed = files.load_folder(self.spark, path)
        elif o["connector"] == "json_pages":
            docs, failed = files.load_pages(self.spark, path)
        else:
            docs, failed = files.read(o["connector"], self.spark, path), None
        return ingest.run(docs, self.store, self.embed, self.settings["store"]["collection"], failed, chunker=o["chunker"], size=o["chunk_size"], overlap=o["overlap"])

    def _vectors(self) -> DataFrame:
        v = self.store.read(self.settings["store"]["collection"])
        if v.select("id").isEmpty():
            raise RetrievalError("the store is empty: ingest first")
        return v.withColumn("source", F.col("metadata")["source"])

    def _how(self) -> dict:
        g = self.settings["graph"]
        return {"answer": self.answer, "k": g["k"], "max_retries": g["max_retries"], "accept": g["refusal_threshold"], "early": g["early_confidence"]}

    def ask(self, questions: DataFrame) -> DataFrame:
        """Answers to (question_id, question); a blank question ends it."""
        if not questions.filter(workflow.blank(F.col("question"))).isEmpty():
            raise RetrievalError("a question is blank")
        return workflow.ask(questions, self._vectors(), self.embed, **self._how())

    def evaluate(self, suite: DataFrame) -> DataFrame:
        """The suite's questions, asked and scored."""
        return evaluate.run(suite, self._vectors(), self.embed, **self._how())


def engine(spark: SparkSession, settings: Mapping) -> Engine:
    """The parts that the settings name; options of a provider are the other entries of its section."""
    e, s = dict(settings["embeddings"]), settings["store"]
    a = dict(settings["answers"])
    dimension = e.get("dimension")
    kept = store.open_store(s["kind"], spark, s["path"], dimension=dimension, metric=s["metric"])
    return Engine(spark, settings, kept, embedding.provider(e.pop("provider"), **e), answers.provider(a.pop("provider"), **a))
