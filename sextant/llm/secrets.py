"""Secret scans with corpus-wide ownership frequency, in DataFrame expressions only.

Patterns find candidates with their places.  The hash of each candidate's value is then counted over all
documents by distinct repositories and owners: a value that many owners carry, or that one owner has
copied into many repositories, is an example; one that a single owner keeps in few repositories looks live.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sextant.llm.base import written


@dataclass(frozen=True)
class Kind:
    """A pattern; the value is its group, and matches whose value is shorter than least are dropped."""

    name: str
    pattern: str
    group: int = 0
    least: int = 1
    base: bool = False


#: The base kinds in the order of the contract, then the kinds that the method adds.
KINDS: tuple[Kind, ...] = (
    Kind("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Kind("access", r"AKIA[A-Z0-9]+", 0, 20, True),
    Kind("hex", r"[0-9a-f]{24,}", 0, 24, True),
    Kind("github", r"gh[opsru]_[A-Za-z0-9]{36,255}"),
    Kind("slack", r"xox[abprs]-[A-Za-z0-9-]{10,250}"),
    Kind("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Kind("pem", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"),
)


def spans(text: Column, no: int, k: Kind) -> Column:
    """array of (start, no, end, kind, value) of one kind: leftmost non-overlapping, code points, end exclusive.

    The pieces between the matches and the matches themselves, one after the other, give the places.
    """
    found, pieces = F.regexp_extract_all(text, F.lit(k.pattern), F.lit(0)), F.split(text, k.pattern, -1)
    value = F.regexp_extract_all(text, F.lit(k.pattern), F.lit(k.group))
    rows = F.arrays_zip(F.slice(pieces, 1, F.size(pieces) - 1).alias("p"), found.alias("m"), value.alias("v"))
    kind = "array<struct<start:int,no:int,end:int,kind:string,value:string>>"
    none = F.array().cast(kind)

    def step(s: Column, r: Column) -> Column:
        a = s["at"] + F.length(r["p"])
        b = a + F.length(r["m"])
        one = F.array(F.struct(a.alias("start"), F.lit(no).alias("no"), b.alias("end"), F.lit(k.name).alias("kind"), r["v"].alias("value")))
        return F.struct(b.alias("at"), F.when(F.length(r["v"]) >= k.least, F.concat(s["out"], one)).otherwise(s["out"]).cast(kind).alias("out"))

    fold = F.aggregate(rows, F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda s: s["out"])
    return F.when(text.rlike(k.pattern), fold).otherwise(none)


def find(docs: DataFrame, *, text_col: str = "text", kinds: Sequence[Kind] = KINDS) -> DataFrame:
    """docs with found: the spans of every kind, by start, then kind as listed.  A null text is empty."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    return docs.withColumn("found", F.array_sort(F.concat(*[spans(t, i, k) for i, k in enumerate(kinds)])))


def ownership(found: DataFrame, *, owner_col: str = "owner", repo_col: str = "repo") -> DataFrame:
    """By hash of a value: n_owners and n_repos over the corpus.

    Repositories are counted within owners, so every step deals its rows out by all that it tells apart
    and adds up before it shuffles; a value that a third of the rows carry arrives as one row a task.
    """
    each = found.select(F.col(owner_col).alias("owner"), F.col(repo_col).alias("repo"), F.explode("found.value").alias("v")).select("owner", "repo", F.sha2("v", 256).alias("hash"))
    one = each.groupBy("hash", "owner", "repo").agg(F.count(F.lit(1)).alias("n"))
    two = one.groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("repos"))
    return two.groupBy("hash").agg(F.count(F.lit(1)).alias("n_owners"), F.sum("repos").alias("n_repos"))


def scan(docs: DataFrame, *, id_col: str = "doc_id", owner_col: str = "source", repo_col: str = "doc_id", text_col: str = "text", kinds: Sequence[Kind] = KINDS, example_owners: int = 3, live_repos: int = 3, example_repos: int = 10) -> DataFrame:
    """Per row: doc_id, found spans, and verdicts: how many are live-looking, shared or examples.

    live: one owner has the value, in live_repos repositories at most; example: example_owners or more have
    it, or example_repos repositories or more; shared: between.  A repository of two owners counts for
    each.  A null owner or repository is one of its own.  Null and empty texts have no spans; texts are
    read whole, however long.  Repeated rows are rows of their own but count once for ownership.  Other
    columns are not read, whatever their names.  An empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(owner_col).cast("string").alias("owner"), F.col(repo_col).cast("string").alias("repo"), F.col(text_col).alias("_t"))
    d = written(find(rows, text_col="_t", kinds=kinds).drop("_t").withColumn("uid", F.monotonically_increasing_id()), "secret-spans")
    some = d.filter(F.size("found") > 0)
    freq = written(ownership(some), "secret-owners")
    each = some.select("uid", F.explode("found.value").alias("v")).select("uid", F.sha2("v", 256).alias("hash"))
    example = (F.col("n_owners") >= example_owners) | (F.col("n_repos") >= example_repos)
    live = ~example & (F.col("n_owners") == 1) & (F.col("n_repos") <= live_repos)
    judged = each.join(freq, "hash").groupBy("uid").agg(F.count_if(live).alias("n_live"), F.count_if(~live & ~example).alias("n_shared"), F.count_if(example).alias("n_example"))
    zero = [F.lit(0).cast("long").alias(c) for c in ("n_live", "n_shared", "n_example")]
    return some.join(judged, "uid").drop("uid").unionByName(d.filter(F.size("found") == 0).drop("uid").select("*", *zero))


def digest(scanned: DataFrame, kinds: Sequence[Kind] = KINDS) -> DataFrame:
    """The contract's columns: counts and spans as text."""
    say = lambda xs: F.array_join(F.transform(xs, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = [k.name for k in kinds if k.base]
    count = lambda k: F.size(F.filter("found", lambda s: s["kind"] == k)).cast("long")
    return scanned.select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in base], F.sha2(say(F.filter("found", lambda s: s["kind"].isin(*base))), 256).alias("base_sha256"), say(F.col("found")).alias("spans"), "n_live", "n_shared", "n_example",
    )
