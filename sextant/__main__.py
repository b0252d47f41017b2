"""python -m sextant ingest|query|eval|pages: the library from the command line."""

from __future__ import annotations

import argparse
import json
import sys

from sextant.config import settings
from sextant.errors import EngineError
from sextant.logs import to_json
from sextant.plans import evaluate
from sextant.plans.engine import engine
from sextant.session import session
from sextant.sources import pdf


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="sextant", description=__doc__)
    top.add_argument("--config", help="settings in JSON or YAML")
    top.add_argument("--master", help="Spark master, if not the one of spark-submit")
    top.add_argument("--log-json", action="store_true", help="log lines as JSON")
    sub = top.add_subparsers(dest="command", required=True)
    sub.add_parser("ingest", help="read, clean, chunk, embed and store").add_argument("path")
    q = sub.add_parser("query", help="ask a question")
    q.add_argument("question")
    q.add_argument("--json", action="store_true", help="the whole answer as JSON")
    e = sub.add_parser("eval", help="ask and score a suite")
    e.add_argument("suite")
    e.add_argument("--output", help="folder for reports")
    e.add_argument("--format", choices=("json", "html", "text", "all"), default="all")
    e.add_argument("--baseline", help="a report in JSON to compare with")
    p = sub.add_parser("pages", help="page dataset from PDF files")
    p.add_argument("path")
    p.add_argument("output")
    p.add_argument("--manifest", help="JSON list of file, chapter, first_page")
    return top


def run(args: argparse.Namespace) -> int:
    spark = session(args.master)
    if args.command == "pages":
        rows, failed = pdf.build_dataset(spark, args.path, pdf.read_manifest(spark, args.manifest) if args.manifest else None)
        rows.write.mode("overwrite").json(args.output)
        for r in failed.toLocalIterator():
            print(f"{r.source}: {r.error}", file=sys.stderr)
        return 0
    it = engine(spark, settings(args.config))
    if args.command == "ingest":
        summary, errors = it.ingest(args.path)
        print(json.dumps(summary))
        for r in errors.toLocalIterator():
            print(f"{r.source}: {r.error}", file=sys.stderr)
        return 0
    if args.command == "query":
        r = it.ask(spark.createDataFrame([(0, args.question)], "question_id long, question string")).first()
        print(json.dumps(r.asDict(True), ensure_ascii=False) if args.json else r.answer or r.refusal_reason)
        return 0
    scored = it.evaluate(evaluate.load_suite(spark, args.suite)).persist()
    rep = evaluate.report(scored, args.suite.rsplit("/", 1)[-1].rsplit(".", 1)[0])
    print(evaluate.report_text(rep), end="")
    if args.baseline:
        base = spark.createDataFrame([evaluate.load_baseline(args.baseline)])
        for r in evaluate.delta(evaluate.metrics(scored), base).collect():
            print(f"{r.metric}: {r.now} {r.change}")
    if args.output:
        evaluate.save_report(rep, args.output, ("json", "html", "text") if args.format == "all" else (args.format,))
    return 0


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    if args.log_json:
        to_json()
    try:
        return run(args)
    except EngineError as e:
        print(f"Error: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
