"""Files to documents: folders of text, Markdown, HTML, JSON and PDF, and page datasets in JSON."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sextant.errors import SourceError
from sextant.functions.text import strip
from sextant.schemas import PAGE
from sextant.sources.arrays import array_entries
from sextant.sources.charsets import decoded

#: Document types by extension.
EXTENSIONS = {".pdf": "pdf", ".txt": "txt", ".text": "txt", ".md": "md", ".markdown": "md", ".html": "html", ".htm": "html", ".json": "json"}
SCANNED = (".pdf", ".txt", ".md", ".html", ".htm")
#: What shows HTML (the first never fires on lower-cased text) and Markdown.
HTML = (r"<!DOCTYPE\s+html", r"<html", r"<head", r"<body", r"<div", r"<p\s*>")
MARKDOWN = (r"^#{1,6}\s+", r"^\*\s+", r"^\d+\.\s+", r"\[.*\]\(.*\)", r"\*\*.*\*\*", r"\*.*\*", r"^```", r"^---")


def document_id(source: Column) -> Column:
    """doc- and the sha-256 of the source, stripped and lower-cased."""
    return F.concat(F.lit("doc-"), F.sha2(F.lower(strip(source)), 256))


def sniff_type(content: Column) -> Column:
    """json, html, md or txt by content; null for blank content."""
    c = strip(content)
    low = F.lower(c)
    is_json = c.rlike(r"\A[\[{]") & F.try_parse_json(c).isNotNull()
    is_html = reduce(lambda a, b: a | b, [low.rlike(f"(?U){p}") for p in HTML])
    marks = reduce(lambda a, b: a + b, [c.rlike(f"(?mdU){p}").cast("int") for p in MARKDOWN])
    return F.when(c == "", None).when(is_json, "json").when(is_html, "html").when(marks >= 2, "md").otherwise("txt")


def document_type(source: Column, content: Column) -> Column:
    """By extension where it is known, else by content."""
    ext = F.lower(F.regexp_extract(source, r"(\.[^./\\]+)$", 1))
    known = F.create_map(*[F.lit(x) for kv in EXTENSIONS.items() for x in kv])
    return F.coalesce(F.element_at(known, ext), sniff_type(content))


def front_matter(content: Column) -> Column:
    """struct(author, tags) from a leading --- block, else the author from the first ten lines."""
    block = F.when(content.startswith("---"), F.regexp_extract(content, r"(?s)\A---(.*?)---", 1))
    found = F.when(content.startswith("---") & (F.instr(F.substring(content, 4, 2**30), "---") > 0), block)
    named = F.nullif(F.regexp_extract(found, r"(?iU)author:\s*['\"]?([^'\"\n]+)['\"]?", 1), F.lit(""))
    inline, listed = F.regexp_extract(found, r"(?sU)tags:\s*\[(.*?)\]", 1), F.regexp_extract(found, r"(?U)tags:\s*\n((?:\s*-\s*.+\n?)+)", 1)
    has_inline = found.rlike(r"(?sU)tags:\s*\[.*?\]")
    bare = lambda t: F.regexp_replace(strip(t), r"^['\"]+|['\"]+$", "")
    tags = F.when(has_inline, F.transform(F.split(inline, ",", -1), bare)).when(listed != "", F.transform(F.regexp_extract_all(listed, F.lit(r"(?U)-\s*(.+)"), F.lit(1)), strip))
    first = F.slice(F.split(content, "\n", -1), 1, 10)
    said = F.transform(first, lambda x: F.coalesce(F.nullif(F.regexp_extract(x, r"(?iU)author:\s*(.+)", 1), F.lit("")), F.nullif(F.regexp_extract(x, r"(?iU)^by:\s*(.+)", 1), F.lit(""))))
    return F.struct(F.coalesce(strip(named), strip(F.get(F.array_compact(said), F.lit(0)))).alias("author"), F.coalesce(tags, F.array().cast("array<string>")).alias("tags"))


def _pdf_text(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Text of PDF bytes, pages joined by an empty line, or the error of a file that cannot be read; needs pypdf."""
    import io

    import pypdf

    for b in batches:
        text, error = [], []
        for raw in b["content"]:
            try:
                pages = [(p.extract_text() or "") for p in pypdf.PdfReader(io.BytesIO(raw)).pages]
                text.append("\n\n".join(p for p in pages if p.strip()))
                error.append(None)
            except Exception as e:  # one file must not end the job: its error is in its row
                text.append(None)
                error.append(str(e) or type(e).__name__)
        yield b.drop(columns="content").assign(content=text, error=error)


def _files(spark: SparkSession, path: str, extensions: tuple[str, ...]) -> DataFrame:
    """The files below a folder that have one of the extensions, contents as bytes (not read unless used)."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not any(c in path for c in "*?[{") and not (fs.exists(at) and fs.getFileStatus(at).isDirectory()):
        raise SourceError(f"{path} is no folder")
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    root = path if "://" in path else f"file:{path}"
    rel = F.regexp_replace(F.col("path"), r"^.*?\Q" + root.split("://")[-1].removeprefix("file:").rstrip("/") + r"\E/", "")
    raw = raw.select(rel.alias("source"), F.col("path").alias("absolute_path"), F.col("length").alias("file_size"), F.col("modificationTime").alias("modified"), "content")
    return raw.withColumn("_ext", F.lower(F.regexp_extract("source", r"(\.[^./\\]+)$", 1))).filter(F.col("_ext").isin(*extensions))


def list_folder(spark: SparkSession, path: str, extensions: tuple[str, ...] = SCANNED) -> DataFrame:
    """source, absolute_path, file_size and modified of the files that read_folder reads, sorted by source; no content is read."""
    return _files(spark, path, extensions).drop("content", "_ext").orderBy("source")


def load_folder(spark: SparkSession, path: str, extensions: tuple[str, ...] = SCANNED) -> tuple[DataFrame, DataFrame]:
    """(documents, failures: source and error) of all files below a folder, by their relative path.

    The character set of a text is guessed where it is not UTF-8, and stands in the metadata.  A file that cannot
    be read is a failure and ends nothing.
    """
    raw = _files(spark, path, extensions)
    pdf = raw.filter("_ext = '.pdf'").drop("_ext")
    none = F.lit(None).cast("string")
    text = raw.filter("_ext != '.pdf'").drop("_ext").withColumn("_d", decoded(F.col("content"))).withColumns({"content": F.col("_d.content"), "charset": F.col("_d.charset"), "error": none}).drop("_d")
    if ".pdf" in extensions and not pdf.select("source").isEmpty():
        try:
            import pypdf  # noqa: F401

            read = pdf.mapInPandas(_pdf_text, "source string, absolute_path string, file_size long, modified timestamp, content string, error string").withColumn("charset", none)
        except ImportError:
            read = pdf.withColumns({"content": none, "charset": none, "error": F.lit("PDF files need pypdf")})
        text = text.unionByName(read)
    return as_documents(text.filter("error is null").drop("error")), text.filter("error is not null").select("source", "error")


def read_folder(spark: SparkSession, path: str, extensions: tuple[str, ...] = SCANNED) -> DataFrame:
    """Documents of all files below a folder; those that cannot be read are left out, and load_folder names them."""
    return load_folder(spark, path, extensions)[0]


def as_documents(rows: DataFrame) -> DataFrame:
    """Rows (source, content, and what there is of absolute_path, file_size, modified) as documents."""
    have = set(rows.columns)
    extra = [x for c in ("absolute_path", "file_size", "charset") if c in have for x in (F.lit(c), F.col(c).cast("string"))]
    at = F.col("modified").cast("timestamp") if "modified" in have else F.lit(None).cast("timestamp")
    title = F.regexp_extract("source", r"([^/\\]+?)(?:\.[^./\\]*)?$", 1)
    d = rows.withColumn("_m", front_matter(F.col("content")))
    return d.select(
        document_id(F.col("source")).alias("id"), "content", "source", document_type(F.col("source"), F.col("content")).alias("document_type"),
        (F.create_map(*extra) if extra else F.create_map().cast("map<string,string>")).alias("metadata"),
        F.struct(F.col("_m.author").alias("author"), title.alias("title"), at.alias("created"), at.alias("modified"), F.col("_m.tags").alias("tags")).alias("full_metadata"), F.current_timestamp().alias("created_at"),
    )


def page_label(chapter: Column, page: Column, source: Column) -> Column:
    """Chapter c, p. n / p. n / the source / unknown."""
    return F.when(chapter.isNotNull() & page.isNotNull(), F.format_string("Chapter %s, p. %s", chapter.cast("string"), page.cast("string"))).when(page.isNotNull(), F.format_string("p. %s", page.cast("string"))).otherwise(F.coalesce(F.nullif(source, F.lit("")), F.lit("unknown")))


def load_pages(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(documents, failures: source and error) of files that hold a JSON array of pages (chapter, page_number, source, text).

    Large files are read by many tasks.  Pages without text are skipped; a field of another type is null; an
    entry that is no object is a failure with its place in the array, a file that holds no whole array is one too,
    and neither ends anything.
    """
    entries, failed = array_entries(spark, path)
    name = F.regexp_extract(F.col("file"), r"[^/]+$", 0)
    page = F.from_json("entry", f"{PAGE}, _broken string", {"columnNameOfCorruptRecord": "_broken", "allowUnquotedControlChars": "true"})
    is_object = F.col("entry").rlike(r"(?s)\A\s*\{") & F.try_parse_json("entry").isNotNull()
    good = entries.filter(is_object).select(page.alias("_p")).select("_p.*").filter(strip(F.col("text")) != "")
    ident = F.concat_ws("::", "source", F.lit("page"), F.col("page_number").cast("string"))
    docs = good.select(
        document_id(ident).alias("id"), F.col("text").alias("content"), page_label(F.col("chapter"), F.col("page_number"), F.col("source")).alias("source"), F.lit("txt").alias("document_type"),
        F.map_filter(F.create_map(F.lit("chapter"), F.col("chapter").cast("string"), F.lit("page_number"), F.col("page_number").cast("string"), F.lit("file"), F.col("source")), lambda k, v: v.isNotNull()).alias("metadata"),
    )
    bad = entries.filter(~is_object).select(name.alias("source"), F.concat(F.lit("entry "), F.col("position").cast("string"), F.lit(": not a page")).alias("error"))
    return docs, bad.unionByName(failed.select(name.alias("source"), F.concat(F.lit("not a JSON array of pages: "), "error").alias("error")))


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Documents of page files; those that cannot be read are left out, and load_pages names them."""
    return load_pages(spark, path)[0]


def chapter_of(stem: Column) -> Column:
    """A chapter number from a file name without extension: ch/chapter and digits, or leading digits."""
    return F.coalesce(*[F.regexp_extract(stem, p, 1).try_cast("int") for p in (r"(?iU)ch(?:apter)?[_\s-]*(\d+)", r"^(\d+)")])


def page_of_label(label: Column) -> Column:
    n = strip(label).try_cast("int")
    return F.when(n.between(1, 9999), n)


def page_of_text(text: Column) -> Column:
    """A number alone on one of the first or last three lines that are not blank."""
    lines = F.filter(F.transform(F.split(text, "\n", -1), strip), lambda x: x != "")
    n = F.size(lines)
    ends = F.when(n > 0, F.concat(F.slice(lines, 1, 3), F.slice(lines, F.greatest(n - 2, F.lit(1)), 3)))
    hits = F.filter(ends, lambda x: x.rlike(r"\A[0-9]{1,4}\z") & x.try_cast("int").between(1, 9999))
    return F.get(hits, F.lit(0)).cast("int")


Reader = Callable[..., DataFrame]
_readers: dict[str, Reader] = {}


def register(name: str, reader: Reader) -> None:
    _readers[name] = reader


def unregister(name: str) -> None:
    _readers.pop(name, None)


def registered() -> list[str]:
    return sorted(_readers)


def read(kind: str, spark: SparkSession, *args, **options) -> DataFrame:
    """Documents from a source by its name."""
    if kind not in _readers:
        raise SourceError(f"no source {kind!r}; known: {', '.join(registered())}")
    return _readers[kind](spark, *args, **options)


def _web(spark: SparkSession, *args, **options) -> DataFrame:
    raise NotImplementedError("nothing is fetched from the web; read saved pages with 'local' or a pages table")


def reset() -> None:
    """The sources that the library brings, and no others."""
    _readers.clear()
    for name, reader in (("local", read_folder), ("json_pages", read_pages), ("s3", read_folder), ("web", _web)):
        register(name, reader)


reset()
