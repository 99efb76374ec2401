"""The inverted index over centers: assignment of spans, weights, postings, stop centers, idf."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def threshold(radius: Column) -> Column:
    return F.round(1 - F.greatest(radius, F.lit(1e-6)), 6)


def assign_documents(top: DataFrame, radius: DataFrame, per_span: int = 5, cached: int = 16, hard: bool = False) -> DataFrame:
    """(span_id, center_id, sim): of the first `cached` centers (1 if hard), those within their radius and
    similar at all, and of these the first `per_span`."""
    near = top.filter(F.col("rank") <= (1 if hard else cached)).join(radius.select("center_id", "r_c"), "center_id")
    near = near.filter((F.col("sim") > 0) & (F.col("sim") >= threshold(F.col("r_c"))))
    place = F.row_number().over(Window.partitionBy("span_id").orderBy("rank"))
    return near.withColumn("place", place).filter(F.col("place") <= per_span).select("span_id", "center_id", "sim")


def assign_queries(top: DataFrame, spans: DataFrame, radius: DataFrame, per_span: int = 5, first_weight: float = 1.0) -> DataFrame:
    """(query_id, span_id, center_id, w): of each span's first `per_span` centers those within their radius;
    a query with none keeps all of them. A query's first span counts `first_weight` times; only positive
    weights stay. `spans` is (span_id, query_id, position)."""
    near = top.filter(F.col("rank") <= per_span).join(radius.select("center_id", "r_c"), "center_id").join(spans.select("span_id", "query_id", "position"), "span_id")
    near = near.withColumn("ok", (F.col("sim") > 0) & (F.col("sim") >= threshold(F.col("r_c"))))
    near = near.withColumn("any", F.max("ok").over(Window.partitionBy("query_id"))).filter("ok or not any")
    w = F.col("sim") * F.when(F.col("position") == 0, first_weight).otherwise(1.0)
    return near.select("query_id", "span_id", "center_id", w.alias("w")).filter("w > 0")


def weights(rows: DataFrame, unit: str, how: str = "max", value: str = "sim") -> DataFrame:
    """(center_id, unit, weight): the largest (or the sum) of a unit's values at a center."""
    agg = F.max(value) if how == "max" else F.sum(value)
    return rows.groupBy("center_id", unit).agg(agg.alias("weight"))


def stop_centers(postings: DataFrame, n_centers: int, fraction: float = 0.01) -> DataFrame:
    """The most frequent centers: max(1, half-even rounding of n_centers * fraction) of them."""
    n = max(1, round(n_centers * fraction)) if fraction > 0 else 0
    return postings.groupBy("center_id").agg(F.count(F.lit(1)).alias("df")).orderBy(F.desc("df"), "center_id").limit(n)


def idf(postings: DataFrame, n_passages: int) -> DataFrame:
    """(center_id, df, idf): ln((N + 1) / (df + 1)) + 1."""
    df = postings.groupBy("center_id").agg(F.count(F.lit(1)).alias("df"))
    return df.withColumn("idf", F.log((F.lit(n_passages) + 1.0) / (F.col("df") + 1.0)) + 1.0)


def posting_statistics(postings: DataFrame, n_centers: int) -> DataFrame:
    lists = postings.groupBy("center_id").agg(F.count(F.lit(1)).alias("n"))
    return lists.agg(F.sum("n").alias("entries"), F.avg("n").alias("mean_non_empty"), F.max("n").alias("longest"), (F.lit(n_centers) - F.count(F.lit(1))).alias("n_empty"))
