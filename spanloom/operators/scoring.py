"""Scoring and ranking: every model yields (query_id, passage_id, score)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import document_of
from .tables import keep


def sparse_scores(queries: DataFrame, postings: DataFrame, idfs: DataFrame | None = None, spans: DataFrame | None = None, alpha: float = 2.0, beta: float = 0.5) -> DataFrame:
    """Sum over shared terms of query weight * idf^alpha * passage weight, over max(spans^beta, 1e-6).

    `queries` (query_id, center_id, weight), `postings` (center_id, passage_id, weight). idf goes to the
    query side, which is small; the join is on the term and its sums are combined before the shuffle.
    """
    q = queries.select("query_id", "center_id", F.col("weight").alias("qw"))
    if idfs is not None:
        q = q.join(idfs.select("center_id", "idf"), "center_id").withColumn("qw", F.col("qw") * F.pow("idf", F.lit(alpha))).drop("idf")
    out = q.join(postings, "center_id").groupBy("query_id", "passage_id").agg(F.sum(F.col("qw") * F.col("weight")).alias("score"))
    if spans is not None:
        out = out.join(spans.select("passage_id", "n_spans"), "passage_id", "left")
        out = out.withColumn("score", F.col("score") / F.greatest(F.pow(F.coalesce("n_spans", F.lit(1)).cast("double"), F.lit(beta)), F.lit(1e-6)))
    return out.select("query_id", "passage_id", F.round("score", 6).alias("score"))


def ranked(scores: DataFrame, k: int | None = None, item: str = "passage_id") -> DataFrame:
    out = scores.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), item)))
    return out if k is None else out.filter(F.col("rank") <= k)


def document_ranking(scores: DataFrame, k: int | None = None) -> DataFrame:
    """(query_id, doc_id, score, rank): documents by their best passage."""
    best = scores.withColumn("doc_id", document_of(F.col("passage_id"))).groupBy("query_id", "doc_id").agg(F.max("score").alias("score"))
    return ranked(best, k, "doc_id")


def two_stage(scores: DataFrame, passages: DataFrame, k: int = 100) -> DataFrame:
    """(query_id, passage_id, score, rank): all passages of the k best documents; unscored ones last, at -1e9."""
    top = document_ranking(scores, k).select("query_id", "doc_id")
    all_ = passages.select("passage_id", document_of(F.col("passage_id")).alias("doc_id")).distinct()
    out = top.join(all_, "doc_id").join(scores, ["query_id", "passage_id"], "left")
    return ranked(out.select("query_id", "passage_id", F.coalesce("score", F.lit(-1e9)).alias("score")))


def bm25(query_terms: DataFrame, passage_terms: DataFrame, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """Scores from (query_id, term) and (passage_id, term) rows, one row an occurrence:
    idf ln(1 + (N - df + .5) / (df + .5)) * tf / (tf + k1 (1 - b + b len / mean)), once a query term's occurrence.

    Term frequencies are counted once into a stored table, which gives lengths, df, N and the mean length.
    """
    tf = keep(passage_terms.groupBy("passage_id", "term").agg(F.count(F.lit(1)).alias("tf")), "term-frequencies")
    length = tf.groupBy("passage_id").agg(F.sum("tf").alias("len"))
    size = length.agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("mean")).first()
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    q = query_terms.groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qn")).join(df, "term")
    q = q.withColumn("w", F.col("qn") * F.log1p((F.lit(size["n"]) - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    part = q.join(tf, "term").join(length, "passage_id")
    weight = F.col("w") * F.col("tf") / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.lit(size["mean"] or 1.0)))
    return part.groupBy("query_id", "passage_id").agg(F.round(F.sum(weight), 6).alias("score"))


def late_interaction(pairs: DataFrame) -> DataFrame:
    """Sum over query tokens of their best similarity, from (query_id, q_token, passage_id, sim)."""
    best = pairs.groupBy("query_id", "passage_id", "q_token").agg(F.max("sim").alias("m"))
    return best.groupBy("query_id", "passage_id").agg(F.round(F.sum("m"), 6).alias("score"))


def chunk_maximum(scores: DataFrame) -> DataFrame:
    return scores.groupBy("query_id", "passage_id").agg(F.max("score").alias("score"))


def scan_costs(queries: DataFrame, postings: DataFrame) -> DataFrame:
    """One row: postings scanned and terms per query (mean, p50, p90, p99, max) and floating operations."""
    lists = postings.groupBy("center_id").agg(F.count(F.lit(1)).alias("n"))
    each = queries.select("query_id", "center_id").distinct().join(lists, "center_id", "left").groupBy("query_id").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("scanned"), F.count(F.lit(1)).alias("terms"))
    p = lambda c, q: F.expr(f"percentile({c}, {q})").alias(f"{c}_p{round(q * 100)}")
    return each.agg((2 * F.sum("scanned")).alias("flops"), *(x for c in ("scanned", "terms") for x in (F.avg(c).alias(f"{c}_mean"), p(c, 0.5), p(c, 0.9), p(c, 0.99), F.max(c).alias(f"{c}_max"))))
