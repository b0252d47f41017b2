"""Mixing sources to target weights by Pareto order sampling, in DataFrame expressions only.

Each source gets a target number of words.  A document's expected copies are its source's target over
its size, times its own appeal where given; the whole part is allocated for certain, the fraction is an
inclusion probability.  Documents of a source are ranked by random odds over inclusion odds, and the
head of that ranking whose words fill what the whole copies leave open is taken once more.

The head's end is found without sorting a source: two histogram passes narrow it down to one bucket of
4096 x 4096, and of that bucket only distinct places in the ranking are ordered, each with the number of
rows that stand there.  A source, or a group of equal rows, that holds a third of all rows is therefore
only ever aggregated map-side.

Appeals count at four significant bits, so that a source has a bounded number of grades of appeal and
never a row per document in a window.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sextant.llm.base import every, n_words, small_join, written

BUCKETS = 4096
#: A row's appeal: a column of docs, or a function of its number of words.
Appeal = Column | Callable[[Column], Column] | None


def length_appeal(size: Column) -> Column:
    """The binary digits of a number of words: a document twice as long is somewhat likelier, not twice as likely."""
    return F.length(F.bin(size)).cast("double")


def graded(appeal: Column) -> Column:
    """An appeal at four significant bits; null, negative and not finite: 0."""
    a = appeal.cast("double")
    step = F.pow(F.lit(2.0), F.floor(F.log2(a)) - 3)
    return F.when((a > 0) & (a < float("inf")), F.round(a / step) * step).otherwise(0.0)


def uniform(seed: int, doc_id: Column, text: Column) -> Column:
    """A draw in (0, 1) from md5 of the seed, the id and the text: reruns agree."""
    key = F.concat_ws(":", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("")), F.md5(F.coalesce(text, F.lit(""))))
    return (F.conv(F.substring(F.md5(key), 1, 12), 16, 10).cast("long").cast("double") + F.lit(0.5)) / F.lit(float(1 << 48))


def water_fill(groups: DataFrame, within: Sequence[str], weight: str, cap: str, budget: Column, out: str) -> DataFrame:
    """Share budget by weight, no group above its cap, the excess reshared among the others.

    In order of cap over weight, the first groups end at their caps and the rest share what is left by
    weight; the first position whose share is below its own cap fixes the level for all.  groups has one
    row per group, and each partition of ``within`` is small (sources, or grades of one source).
    """
    order = W.partitionBy(*within).orderBy(F.col(cap) / F.col(weight), *[F.col(c) for c in groups.columns])
    whole = W.partitionBy(*within)
    before = F.coalesce(F.sum(cap).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum(weight).over(order.rowsBetween(0, W.unboundedFollowing))
    level = (budget - before) / rest
    g = groups.withColumn("_level", level).withColumn("_fits", F.col("_level") * F.col(weight) <= F.col(cap))
    g = g.withColumn("_theta", F.min(F.when(F.col("_fits"), F.struct(F.col(cap) / F.col(weight), "_level"))).over(whole)["_level"])
    return g.withColumn(out, F.when(F.col("_theta").isNull(), F.col(cap).cast("double")).otherwise(F.least(F.col(cap).cast("double"), F.col("_theta") * F.col(weight)))).drop("_level", "_fits", "_theta")


def source_targets(sized: DataFrame, weights: Sequence[float], share: float, max_repeat: float) -> DataFrame:
    """One row per source: source_size, target.  Sources by code point, null last, take the weights in turn."""
    per = sized.groupBy("_src").agg(F.sum("_size").alias("source_size"))
    # One row per source from here on, so the global windows see a dictionary, not the corpus.
    whole = W.partitionBy(F.lit(1))
    per = per.withColumn("_at", F.row_number().over(whole.orderBy(F.col("_src").asc_nulls_last())) - 1)
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("_at") % len(weights) + 1).cast("int"))
    per = per.withColumn("_w", w).withColumn("_cap", F.col("source_size") * max_repeat).withColumn("_one", F.lit(1))
    budget = F.sum("source_size").over(whole) * F.lit(float(share))
    return water_fill(per.withColumn("_budget", budget), ["_one"], "_w", "_cap", F.col("_budget"), "target").select("_src", "source_size", "target")


def _position(lam: Column, u: Column) -> Column:
    """q / (1 + q) for the Pareto ranking variable q = odds(u) / odds(lam)."""
    return F.when(lam <= 0, F.lit(1.0)).when(lam >= 1, F.lit(0.0)).otherwise(u * (1 - lam) / (u * (1 - lam) + lam * (1 - u)))


def _bucket(x: Column) -> Column:
    return F.least(F.floor(x), F.lit(BUCKETS - 1)).cast("int")


def _placed(sized: DataFrame, plan: DataFrame) -> DataFrame:
    """Rows with their certain copies and their place in the ranking."""
    d = small_join(sized, plan, F.expr("_src <=> _src2 and _appeal <=> _appeal2"), "left").drop("_src2", "_appeal2")
    d = d.withColumn("_v", _position(F.col("_lam"), F.col("_u")))
    d = d.withColumn("_b1", _bucket(F.col("_v") * BUCKETS))
    return d.withColumn("_b2", _bucket((F.col("_v") * BUCKETS - F.col("_b1")) * BUCKETS))


def _boundary(d: DataFrame, bucket: str, left: str) -> DataFrame:
    """Per source the first bucket whose words pass what is left to fill, and what is then left."""
    sums = d.groupBy("_src", bucket, left).agg(F.sum("_size").alias("_n"))
    run = F.sum("_n").over(W.partitionBy("_src").orderBy(bucket))
    hit = sums.withColumn("_run", run).filter(F.col("_run") > F.col(left))
    return hit.groupBy("_src").agg(F.min(F.struct(F.col(bucket), (F.col(left) - F.col("_run") + F.col("_n")).alias("rest"))).alias("_m")).select(F.col("_src").alias("_srcb"), F.col(f"_m.{bucket}").alias(f"{bucket}_cut"), F.col("_m.rest").alias("_rest"))


def sized_rows(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", appeal: Appeal = None, seed: int = 17, keep: bool = False) -> DataFrame:
    """What the sampling reads of each row, written, beside the row itself if keep; uid numbers the rows."""
    i, t, s = (F.col(f"`{c}`") for c in (id_col, text_col, source_col))
    own = appeal if isinstance(appeal, Column) else F.lit(1.0)
    cols = [i.alias("_id"), s.cast("string").alias("_src"), n_words(t).alias("_size"), uniform(seed, i, t).alias("_u"), own.alias("_appeal")]
    d = docs.select(F.struct(*every(docs)).alias("_row"), *cols) if keep else docs.select(*cols)
    if appeal is not None:
        d = d.withColumn("_appeal", graded(F.col("_appeal") if isinstance(appeal, Column) else appeal(F.col("_size"))))
    return written(d.withColumn("uid", F.monotonically_increasing_id()), "mix-sizes")


def _rates(sized: DataFrame, targets: DataFrame, max_repeat: int) -> DataFrame:
    """By source and grade of appeal: whole copies, inclusion probability, and what the head of the source's ranking fills."""
    g = sized.groupBy("_src", "_appeal").agg(F.sum("_size").alias("_n"))
    g = g.join(targets.withColumnRenamed("_src", "_s"), F.expr("_src <=> _s"), "left").drop("_s")
    g = g.withColumn("_w", F.when(F.col("_n") == 0, 1.0).otherwise(F.greatest(F.col("_n") * F.col("_appeal"), F.lit(1e-9)))).withColumn("_cap", F.col("_n") * float(max_repeat))
    g = water_fill(g, ["_src"], "_w", "_cap", F.col("target"), "_part")
    mean = F.when(F.col("_n") > 0, F.least(F.col("_part") / F.col("_n"), F.lit(float(max_repeat)))).otherwise(0.0)
    g = g.withColumn("_whole", F.floor(mean).cast("int")).withColumn("_lam", mean - F.col("_whole"))
    left = F.col("target") - F.sum(F.col("_whole") * F.col("_n")).over(W.partitionBy("_src"))
    return g.select(F.col("_src").alias("_src2"), F.col("_appeal").alias("_appeal2"), "source_size", "target", "_whole", "_lam", F.greatest(left, F.lit(0.0)).alias("_left"))


def _ends(last: DataFrame) -> DataFrame:
    """Per source the last place of the ranking's head, and which of the rows at that place still belong to it.

    last: rows of one bucket in 16 million.  Equal places are one row here, with how many rows they have;
    if some of them do not fit, those of the first partitions do, and in the last of these the first rows.
    """
    place = ["_v", "_u", "_id", "_size"]
    keyed = last.groupBy("_src", "_rest", *place).agg(F.count(F.lit(1)).alias("_k"))
    order = W.partitionBy("_src").orderBy("_v", "_u", F.col("_id").asc_nulls_first(), "_size").rowsBetween(W.unboundedPreceding, -1)
    keyed = keyed.withColumn("_before", F.coalesce(F.sum(F.col("_k") * F.col("_size")).over(order), F.lit(0)))
    # A row belongs to the head if at least half of it fits: the n-th of equal rows, if n - 1 rows before it leave that.
    fits = lambda n: F.col("_before") + (n - 1) * F.col("_size") + F.col("_size") / 2 <= F.col("_rest")
    n = F.floor((F.col("_rest") - F.col("_before") - F.col("_size") / 2) / F.greatest("_size", F.lit(1))) + 1
    n = F.when(~fits(n), n - 1).when(fits(n + 1), n + 1).otherwise(n)
    n = F.when(F.col("_size") == 0, F.when(F.col("_before") <= F.col("_rest"), F.col("_k")).otherwise(0)).otherwise(F.greatest(F.lit(0), F.least(n, F.col("_k"))))
    head = keyed.withColumn("_in", n).filter("_in > 0").groupBy(F.col("_src").alias("_srce")).agg(F.max(F.struct(*place, "_in", "_k")).alias("_m"))
    ends = written(head.select("_srce", F.struct(*[F.col(f"_m.{c}") for c in place]).alias("_end"), "_m._in", "_m._k"), "mix-ends")
    torn = ends.filter("_in < _k").select("_srce", F.col("_end").alias("_torn"), "_in")
    at = last.select("_src", "uid", F.struct(*place).alias("_place"))
    at = small_join(at, written(torn, "mix-torn"), F.expr("_src <=> _srce and _place <=> _torn")).select("_src", "_in", "uid", F.shiftright("uid", 33).alias("_part"))
    by = W.partitionBy("_src").orderBy("_part")
    parts = at.groupBy("_src", "_in", "_part").agg(F.count(F.lit(1)).alias("_c")).withColumn("_upto", F.sum("_c").over(by))
    cut = written(parts.filter("_upto >= _in and _upto - _c < _in").select(F.col("_src").alias("_srcp"), F.col("_part").alias("_cut"), (F.col("_in") - F.col("_upto") + F.col("_c")).alias("_nth")), "mix-parts")
    inside = small_join(at, cut, F.expr("_src <=> _srcp and _part = _cut")).withColumn("_no", F.row_number().over(W.partitionBy("_src").orderBy("uid")))
    uids = inside.filter("_no = _nth").select(F.col("_src").alias("_srcu"), F.col("uid").alias("_uid"))
    return ends.select("_srce", "_end").join(uids, F.expr("_srce <=> _srcu"), "left").drop("_srcu")


def plan_mix(sized: DataFrame, *, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, max_repeat: int = 2) -> tuple[DataFrame, DataFrame]:
    """(rates, cuts) for sized_rows().

    rates: by source and grade of appeal, whole copies and inclusion probability.  cuts: by source, where
    the ranking's head ends.  Neither has a row per document.
    """
    targets = written(source_targets(sized, weights, share, max_repeat), "mix-targets")
    rates = written(_rates(sized, targets, max_repeat), "mix-rates")
    d = _placed(sized.drop("_row"), rates).filter("_lam > 0")
    one = written(_boundary(d, "_b1", "_left"), "mix-cut1")
    inner = small_join(d, one, F.expr("_src <=> _srcb and _b1 = _b1_cut")).drop("_srcb").withColumnRenamed("_rest", "_left1")
    two = written(_boundary(inner, "_b2", "_left1"), "mix-cut2")
    last = small_join(inner, two, F.expr("_src <=> _srcb and _b2 = _b2_cut")).drop("_srcb")
    cuts = one.select(F.col("_srcb").alias("_src3"), "_b1_cut").join(two.select("_srcb", "_b2_cut"), F.expr("_src3 <=> _srcb"), "left").drop("_srcb")
    cuts = cuts.join(_ends(last), F.expr("_src3 <=> _srce"), "left").drop("_srce")
    return rates, written(cuts, "mix-cuts")


def copies(sized: DataFrame, rates: DataFrame, cuts: DataFrame) -> DataFrame:
    """sized_rows() with source_size, target and the copies each row is taken in.  No shuffle of rows."""
    d = small_join(_placed(sized, rates), cuts, F.expr("_src <=> _src3"), "left")
    key = F.struct("_v", "_u", "_id", "_size")
    here = (key < F.col("_end")) | ((key == F.col("_end")) & (F.col("_uid").isNull() | (F.col("uid") <= F.col("_uid"))))
    inside = (F.col("_b1") < F.col("_b1_cut")) | ((F.col("_b1") == F.col("_b1_cut")) & ((F.col("_b2") < F.col("_b2_cut")) | ((F.col("_b2") == F.col("_b2_cut")) & here)))
    # Without a cut no bucket passes what is left: with something left, all of them are inside.
    inside = F.when(F.col("_b1_cut").isNull(), F.col("_left") > 0).otherwise(F.coalesce(inside, F.lit(False)))
    return d.withColumn("copies", F.col("_whole") + F.when((F.col("_lam") > 0) & inside, 1).otherwise(0))


def mix(docs: DataFrame, *, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, max_repeat: int = 2, **names) -> DataFrame:
    """The mix itself: every row of docs as often as it is taken, with docs' columns, whatever their names.

    Null texts have no words; null sources are a source of their own, the last.  Rows draw by id and text,
    so equal rows, and null ids with equal texts, share a draw; they are still taken one by one.  Rows
    without words follow their draw and add nothing.  Of a very long text only its number of words and a
    digest take part.  An empty table gives an empty mix.
    """
    sized = sized_rows(docs, keep=True, **names)
    d = copies(sized, *plan_mix(sized, weights=weights, share=share, max_repeat=max_repeat)).filter("copies > 0")
    return d.select("_row", F.explode(F.sequence(F.lit(1), "copies")).alias("_copy")).select("_row.*")


def mix_report(docs: DataFrame, *, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, max_repeat: int = 2, **names) -> DataFrame:
    """Per document: doc_id, size, source_size, target of its source, taken words, copies.  Rows as in mix()."""
    sized = sized_rows(docs, **names)
    d = copies(sized, *plan_mix(sized, weights=weights, share=share, max_repeat=max_repeat))
    return d.select(F.col("_id").alias("doc_id"), F.col("_size").alias("size"), "source_size", "target", (F.col("copies") * F.col("_size")).cast("long").alias("taken"), F.col("copies").cast("int").alias("copies"))
