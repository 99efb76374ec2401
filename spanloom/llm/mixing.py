"""Mixing sources to target weights with Pareto order sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, join_small, only, prefix_sums, store

#: Bins of the odds ratio per source; only the bin at the cut is ordered exactly.
BINS = 65_536


def n_words(text: Column) -> Column:
    """Number of runs of bytes other than space and tab to carriage return; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def uniform(seed: int, *cols: Column) -> Column:
    """A reproducible uniform in (0, 1), from 48 bits of md5."""
    key = F.concat_ws("\x1f", F.lit(str(seed)), *(F.coalesce(c.cast("string"), F.lit("\x00")) for c in cols))
    return (F.conv(F.substring(F.md5(key.cast("binary")), 1, 12), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(2**48))


def targets(sources: DataFrame, weights: tuple[float, ...], share: float, most: float, name: str) -> DataFrame:
    """Share `share` times all sizes among the sources by weight; a target stops at `most` times its
    source's size and the excess goes to the others by weight, until none is above.

    `sources` has (source, source_size). Weights repeat over the sources in code-point order, null last.
    Each round is one aggregate of the source table; only its two sums reach the driver.
    """
    order = [F.col("source").isNull(), F.col("source")]
    ranked, totals = prefix_sums(sources, order, {"__before": "source_size"}, name)
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("__index") % len(weights) + 1).cast("int"))
    ranked = ranked.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * F.lit(float(most))).alias("cap"))
    goal = totals["__before"] * share
    # a source is at its cap when the level that fills the rest reaches cap / weight; levels only rise
    level = 0.0
    while True:
        full = F.col("cap") <= F.col("weight") * F.lit(level)
        got = ranked.agg(F.sum(F.when(full, F.col("cap"))).alias("full"), F.sum(F.when(~full, F.col("weight"))).alias("open")).first()
        if not got["open"]:
            break
        now = (goal - (got["full"] or 0.0)) / got["open"]
        if now <= level:
            break
        level = now
    return ranked.select("source", "source_size", F.least(F.col("cap"), F.col("weight") * F.lit(level)).alias("target"))


def longer_first(most: int = 1000) -> Column:
    """Inclusion odds that grow with a document's size, to twice those of an empty one at `most` words."""
    return F.lit(1.0) + F.least(F.col("size"), F.lit(most)) / F.lit(float(most))


def mix(docs: DataFrame, weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5, most: float = 2.0, seed: int = 17, odds: Column | None = None) -> DataFrame:
    """How many copies of each row a mix takes, so that each source's words come near its target.

    A row's inclusion number is its source's target over its size: that many whole copies are certain,
    and the fraction is drawn by Pareto order sampling: rows of a source are ranked by
    [U/(1-U)] / [p/(1-p)], U uniform from (doc_id, text) and `seed`, and the first ranks are taken up to
    the point nearest the missing words, so that the number of sampled words is fixed to half a
    document. `odds` (a positive column expression over doc_id, text, source, size; default 1) multiplies a
    row's inclusion odds and so makes probabilities unequal within a source too.

    Returns doc_id, source, size, source_size, target, copies, taken and text_hash (a hash of the text
    that names the row together with doc_id).

    Defined cases: a null or blank text has size 0 and takes 0 words; null is a source of its own, last
    in order; equal rows (doc_id, text, source) share one decision; reruns agree; an empty
    table gives no rows; other columns are ignored.
    """
    rows = only(docs, {"doc_id": "long", "text": "string", "source": "string"})
    rows = rows.select("doc_id", "source", F.xxhash64("text").alias("text_hash"), F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("digest"), n_words(F.col("text")).alias("size"), "text")
    rows = rows.withColumn("odds", (odds if odds is not None else F.lit(1.0)).cast("double")).drop("text")
    rows = store(rows.withColumn("u", uniform(seed, F.col("doc_id"), F.col("digest"))).drop("digest"), "mix-sizes")
    goals = store(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most, "mix-sources"), "mix-targets")
    rows = join_small(rows, goals, "source")
    number = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rows = rows.withColumn("whole", F.floor(number)).withColumn("p", number - F.floor(number))
    p = F.col("p")
    rank = (F.col("u") / (1 - F.col("u"))) / (F.col("odds") * p / (1 - p))
    rows = rows.withColumn("rank", F.when(p > 0, rank)).withColumn("bin", F.when(p > 0, F.least(F.lit(BINS - 1), F.floor(F.col("rank") / (1 + F.col("rank")) * BINS))).cast("int"))
    missing = p * F.col("source_size")
    # words in each bin of each source, then in all bins below: at most BINS rows per source
    bins = rows.filter("bin is not null").groupBy("source", "bin").agg(F.sum("size").alias("words"))
    order = "partition by source order by bin rows between unbounded preceding and 1 preceding"
    bins = bins.withColumn("below", F.expr(f"coalesce(sum(words) over ({order}), 0L)"))
    cut = join_small(bins, goals, "source")
    cut = cut.withColumn("missing", (F.col("target") / F.col("source_size") - F.floor(F.col("target") / F.col("source_size"))) * F.col("source_size"))
    cut = cut.filter("below <= missing and missing < below + words").select("source", F.col("bin").alias("cut_bin"), F.col("below").alias("cut_below"))
    rows = join_small(rows, cut, "source")
    inside = F.col("bin") == F.col("cut_bin")
    far = rows.filter(~F.coalesce(inside, F.lit(False))).withColumn("extra", F.when(F.col("bin") < F.col("cut_bin"), 1).otherwise(0))
    near = rows.filter(inside)
    # equal rows share one decision: `upto` runs to the last of them and `tied` is their own words
    near = near.withColumn("upto", F.expr("sum(size) over (partition by source order by rank, doc_id, text_hash)"))
    near = near.withColumn("tied", F.expr("sum(size) over (partition by source, rank, doc_id, text_hash)"))
    near = near.withColumn("extra", F.when(2 * (F.col("cut_below") + F.col("upto")) - F.col("tied") < 2 * missing, 1).otherwise(0)).drop("upto", "tied")
    rows = far.unionByName(near)
    copies = (F.coalesce(F.col("whole"), F.lit(0)) + F.col("extra")).cast("int")
    return rows.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).cast("long").alias("taken"), "text_hash")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each row of `docs`, all its columns, repeated as often as `mix` takes it."""
    keys = ["doc_id", "text_hash", "source"]
    taken = mix(docs, **options).filter("copies > 0").select(*(F.col(c).alias(f"__{c}") for c in keys), F.col("copies").alias("__copies")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("__doc_id")) & F.col("source").eqNullSafe(F.col("__source")) & (F.xxhash64(F.col("text").cast("string")) == F.col("__text_hash"))
    both = docs.join(taken, same).withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies"))))
    return both.select(*(F.col(f"`{c}`") for c in docs.columns))
