"""Samples and budgets. Rows are drawn in the order of an MD5 of their id, so a draw repeats everywhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def draw(key: Column, seed: int = 42) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")).cast("binary"))


def sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """`n` rows without replacement, the first in the order of the draw."""
    return _first_drawn(df.withColumn("__g", F.lit(0)), "__g", key, {0: n}, seed).drop("__g")


#: Bins of the draw; only the rows of a group's bin at the cut are put in order.
_BINS = 65_536


def _first_drawn(df: DataFrame, group: str, key: str, budget: dict, seed: int) -> DataFrame:
    """The first budget[g] rows of each group g in the order of the draw, for a few groups of any size.

    Rows are counted by group and bin (the draw's first four hex digits), at most _BINS rows a group. All rows of
    the bins before a group's cut are taken; only the bin at the cut is ordered, a 65,536th of the group.
    """
    if not any(budget.values()):
        return df.limit(0)
    limit = F.coalesce(*(F.when(F.col(group).eqNullSafe(F.lit(g)), F.lit(n)) for g, n in budget.items()), F.lit(0)).cast("long")
    drawn = df.withColumn("__d", draw(F.col(key), seed)).withColumn("__bin", F.conv(F.substring("__d", 1, 4), 16, 10).cast("int"))
    bins = drawn.groupBy(group, "__bin").agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(group).orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bins = bins.withColumn("__rest", limit - before).filter("__rest > 0").select(F.col(group).alias("__group"), F.col("__bin").alias("__b"), "__n", "__rest")
    small = F.broadcast(bins) if len(budget) <= 16 else bins
    met = drawn.join(small, F.col(group).eqNullSafe(F.col("__group")) & (F.col("__bin") == F.col("__b")))
    whole = met.filter("__rest >= __n")
    place = F.row_number().over(Window.partitionBy(group, "__bin").orderBy("__d", key))
    part = met.filter("__rest < __n").withColumn("__r", place).filter("__r <= __rest").drop("__r")
    return whole.unionByName(part).drop("__d", "__bin", "__group", "__b", "__n", "__rest")


def cap_per_group(df: DataFrame, groups: list[str], key: str, n: Column | int, seed: int = 42) -> DataFrame:
    """At most n rows of each group; row_number <= n is cut within partitions before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*groups).orderBy(draw(F.col(key), seed), key))
    return df.withColumn("__r", rank).filter(F.col("__r") <= n).drop("__r")


def counts(df: DataFrame, group: str) -> dict:
    """Rows of each of a few groups (sections, years)."""
    return {r[group]: r["count"] for r in df.groupBy(group).count().collect()}


def budgets_equal(sizes: dict, total: int) -> dict:
    """Water-filling: equal shares of what is left among sections with room; leftovers one by one."""
    out, left = dict.fromkeys(sizes, 0), min(total, sum(sizes.values()))
    while left:
        room = [s for s in sizes if out[s] < sizes[s]]
        share = max(1, left // len(room))
        for s in room:
            take = min(share, sizes[s] - out[s], left)
            out[s], left = out[s] + take, left - take
    return out


def budgets_natural(sizes: dict, total: int) -> dict:
    """In proportion to size, at least 1 and at most the size; the rest to the largest sections."""
    some, whole = [s for s in sizes if sizes[s]], sum(sizes.values())
    out = dict.fromkeys(sizes, 0) | {s: min(sizes[s], max(1, total * sizes[s] // whole)) for s in some}
    left = total - sum(out.values())
    for s in sorted(some, key=lambda s: -sizes[s]):
        take = max(0, min(left, sizes[s] - out[s]))
        out[s], left = out[s] + take, left - take
    return out


def budgets_rounded(sizes: dict, total: int) -> dict:
    """In proportion, rounded half to even, within the size; what is over goes from the largest."""
    whole = sum(sizes.values())
    out = {s: min(n, round(total * n / whole)) for s, n in sizes.items()}
    over = sum(out.values()) - total
    for s in sorted(out, key=lambda s: -out[s]):
        take = min(out[s], max(over, 0))
        out[s], over = out[s] - take, over - take
    return out


def year_caps(sizes: dict, total: int) -> dict:
    """In proportion, rounded down, the remainder one each to the first years; everything, if it fits."""
    whole, years = sum(sizes.values()), sorted(sizes)
    if whole <= total:
        return dict(sizes)
    out = {y: total * sizes[y] // whole for y in years}
    for y in years[: total - sum(out.values())]:
        out[y] += 1
    return out


def by_budget(df: DataFrame, group: str, key: str, budget: dict, seed: int = 42) -> DataFrame:
    """The first budget[g] rows of each group g in the order of the draw; groups without a budget have none."""
    return _first_drawn(df, group, key, budget, seed)


def last_drawn(df: DataFrame, group: str, order: list[str], budget: dict) -> dict:
    """{g: the values of `order` in the last of the first budget[g] rows of group g, or None where the budget is 0}, for
    groups of more rows than that. order[0] is the draw; rows are counted by bins of it, and only those of the bin at
    the cut are put in order, as in `by_budget`."""
    some = {g: n for g, n in budget.items() if n}
    out = dict.fromkeys(budget)
    if some:
        limit = F.coalesce(*(F.when(F.col(group).eqNullSafe(F.lit(g)), F.lit(n)) for g, n in some.items()), F.lit(0)).cast("long")
        binned = df.withColumn("__bin", F.conv(F.substring(order[0], 1, 4), 16, 10).cast("int"))
        bins = binned.groupBy(group, "__bin").agg(F.count(F.lit(1)).alias("__n"))
        before = F.coalesce(F.sum("__n").over(Window.partitionBy(group).orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        at = bins.withColumn("__rest", limit - before).filter("__rest > 0 and __rest <= __n").select(F.col(group).alias("__g"), F.col("__bin").alias("__b"), "__rest")
        met = binned.join(F.broadcast(at), F.col(group).eqNullSafe(F.col("__g")) & (F.col("__bin") == F.col("__b")))
        place = F.row_number().over(Window.partitionBy(group).orderBy(*order))
        for r in met.withColumn("__r", place).filter("__r = __rest").select(group, *order).collect():
            out[r[group]] = tuple(r[c] for c in order)
    return out


def hard_negatives(docs: DataFrame, targets: DataFrame, n: int, ratio: float = 0.75, seed: int = 42) -> DataFrame:
    """(doc_id, tier) of `n` extra documents (doc_id, sc, sg): those that share a subgroup with the targets'
    one row (sc, sg), those that share a subclass only, and others, with half the hard quota to each
    hard tier, a short tier's rest to the other, and easy ones to fill up."""
    tiers = docs.crossJoin(F.broadcast(targets.select(F.col("sc").alias("tsc"), F.col("sg").alias("tsg")).limit(1)))
    tiers = tiers.select("doc_id", F.when(F.arrays_overlap("sg", "tsg"), "subgroup").when(F.arrays_overlap("sc", "tsc"), "subclass").otherwise("easy").alias("tier"))
    have = {"subgroup": 0, "subclass": 0, "easy": 0} | counts(tiers, "tier")
    hard = int(ratio * n)
    group = min(hard // 2, have["subgroup"])
    sub = min(hard - group, have["subclass"])
    if sub < hard - group:
        group = min(hard - sub, have["subgroup"])
    return by_budget(tiers, "tier", "doc_id", {"subgroup": group, "subclass": sub, "easy": min(n - group - sub, have["easy"])}, seed)
