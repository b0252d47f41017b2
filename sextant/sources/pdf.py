"""A page dataset from PDF files: a row per page with its printed number, and manifests that say where counting starts."""

from __future__ import annotations

import json
import posixpath
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sextant.errors import SourceError
from sextant.functions.text import strip
from sextant.sources.files import chapter_of, page_of_label, page_of_text

PAGES = "path string, source string, chapter int, first_page int, position int, label string, text string, error string"
MANIFEST = "path string, chapter int, first_page int"


def number_pages(pages: DataFrame) -> DataFrame:
    """chapter, page_number, source, text of the pages that have text; rows (source, position, label, text, chapter, first_page).

    A file's page has the number of its label, else one that stands alone in its first or last lines, else one
    more than the page before it, blank ones counted too; before the first such number, counting starts at 1.
    Where first_page is given, pages are counted from there and nothing else.  Numbers that are found restart
    the count, so a page's own is that of the last page with a number, and the distance to it: a window over a
    file's pages.  Null texts are blank.
    """
    text = strip(F.coalesce("text", F.lit("")))
    d = pages.withColumn("text", text)
    found = F.when((F.col("text") != "") & F.col("first_page").isNull(), F.coalesce(page_of_label(F.col("label")), page_of_text(F.col("text"))))
    d = d.withColumn("_lead", found - F.col("position"))
    w = W.partitionBy("source").orderBy("position").rowsBetween(W.unboundedPreceding, W.currentRow)
    start = F.coalesce(F.last("_lead", ignorenulls=True).over(w), F.coalesce("first_page", F.lit(1)))
    return d.withColumn("page_number", (start + F.col("position")).cast("int")).filter("text != ''").select("chapter", "page_number", "source", "text")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """path, chapter and first_page of a manifest: a JSON list of {file, chapter, first_page}, files beside it if relative."""
    try:
        entries = json.loads("\n".join(r.value for r in spark.read.option("wholetext", True).text(path).collect()))  # a file that people write
    except ValueError as e:
        raise SourceError(f"the manifest {path} is no JSON: {e}") from e
    if not isinstance(entries, list):
        raise SourceError("a manifest is a JSON list")
    for i, e in enumerate(entries):
        if not isinstance(e, dict) or "file" not in e:
            raise SourceError(f"entry {i} of the manifest names no file")
    root = posixpath.dirname(path)
    at = lambda f: f if "://" in f else posixpath.join(root, f)
    return spark.createDataFrame([(at(e["file"]), e.get("chapter"), e.get("first_page")) for e in entries], MANIFEST)


def _pages(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Labels and texts of the pages of PDF bytes; a file that cannot be read is one row with its error."""
    import io

    import pypdf

    for b in batches:
        rows = []
        for f in b.itertuples(index=False):
            head = (f.path, f.source, f.chapter, f.first_page)
            try:
                reader = pypdf.PdfReader(io.BytesIO(f.content))
                try:
                    labels = list(reader.page_labels)
                except Exception:  # a file without labels that make sense is numbered by its texts
                    labels = []
                rows += [(*head, i, labels[i] if i < len(labels) else None, p.extract_text() or "", None) for i, p in enumerate(reader.pages)]
            except Exception as e:  # one file must not end the job: its error is its row
                rows.append((*head, None, None, None, str(e) or type(e).__name__))
        out = pd.DataFrame(rows, columns=[c.split()[0] for c in PAGES.split(", ")])
        yield out.astype({"chapter": "Int32", "first_page": "Int32", "position": "Int32"})


def extract_pages(spark: SparkSession, path: str, manifest: DataFrame | None = None) -> DataFrame:
    """Pages, not numbered yet, of the PDF files of a folder or a manifest, with the error of those that fail; needs pypdf."""
    try:
        import pypdf  # noqa: F401
    except ImportError as e:
        raise SourceError("PDF files need pypdf") from e
    if manifest is None:
        raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.[pP][dD][fF]").load(path)
        none = F.lit(None).cast("int")
        raw = raw.withColumns({"chapter": none, "first_page": none})
    else:
        named = [r.path for r in manifest.select("path").collect()]
        raw = spark.read.format("binaryFile").load(named)
        bare = lambda c: F.regexp_replace(c, "^file:/*", "/")
        raw = raw.join(F.broadcast(manifest.select(bare(F.col("path")).alias("_p"), "chapter", "first_page")), bare(F.col("path")) == F.col("_p")).drop("_p")
    source = F.regexp_extract("path", r"[^/]+$", 0)
    stem = F.regexp_replace(source, r"(?i)\.pdf$", "")
    raw = raw.select("path", source.alias("source"), F.coalesce("chapter", chapter_of(stem)).alias("chapter"), "first_page", "content")
    return raw.mapInPandas(_pages, PAGES)


def build_dataset(spark: SparkSession, path: str, manifest: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(pages with numbers, files that failed: source and error); what read_pages reads back if written as JSON."""
    every = extract_pages(spark, path, manifest)
    return number_pages(every.filter("error is null")), every.filter("error is not null").select("source", "error")
