"""Retrieval metrics over rankings (query_id, item, rank) and relevant items (query_id, item).

Queries without relevant items take no part; a query whose ranking is empty counts 0.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import document_of


def _hits(ranking: DataFrame, truth: DataFrame, k: int | None) -> tuple[DataFrame, DataFrame]:
    """(hits with their rank and number so far, relevant items per query)."""
    truth = truth.select("query_id", "item").distinct()
    ranking = ranking if k is None else ranking.filter(F.col("rank") <= k)
    hits = ranking.select("query_id", "item", "rank").join(truth, ["query_id", "item"])
    return hits.withColumn("nth", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))), truth.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))


def _mean(ranking, truth, k, value, name):
    hits, sizes = _hits(ranking, truth, k)
    each = sizes.join(hits, "query_id", "left").groupBy("query_id", "n").agg(value.alias("v"))
    return each.agg(F.round(F.coalesce(F.avg(F.coalesce("v", F.lit(0.0))), F.lit(0.0)), 6).alias("value")).select(F.lit(name).alias("metric"), "value")


def recall(ranking, truth, k, name):
    return _mean(ranking, truth, k, F.count("rank") / F.col("n"), name)


def average_precision(ranking, truth, name, k=None):
    return _mean(ranking, truth, k, F.sum(F.col("nth") / F.col("rank")) / F.col("n"), name)


def reciprocal_rank(ranking, truth, name, k=None):
    return _mean(ranking, truth, k, 1.0 / F.min("rank"), name)


def ndcg(ranking, truth, k, name):
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n").cast("int"), F.lit(k))), F.lit(0.0), lambda s, r: s + 1 / F.log2(r + 1.0))
    return _mean(ranking, truth, k, F.sum(1 / F.log2(F.col("rank") + 1.0)) / ideal, name)


def pres(ranking, truth, n_max, name):
    """1 - (mean rank of relevant items - (n + 1) / 2) / n_max, the i-th item, if not found, at n_max + i."""
    n, found = F.col("n"), F.count("rank")
    missed = (n - found) * n_max + (n * (n + 1) - found * (found + 1)) / 2
    return _mean(ranking, truth, n_max, 1 - ((F.coalesce(F.sum("rank"), F.lit(0)) + missed) / n - (n + 1) / 2) / n_max, name)


def document_truth(qrels: DataFrame) -> DataFrame:
    return qrels.select("query_id", document_of(F.col("passage_id")).alias("item")).distinct()


def mean_document_precision(ranking: DataFrame, qrels: DataFrame, name: str = "magp") -> DataFrame:
    """Average precision within each relevant document's own passages, then over documents and queries."""
    qrels = qrels.select("query_id", "passage_id").distinct().withColumn("doc_id", document_of(F.col("passage_id")))
    own = ranking.select("query_id", "passage_id", "rank").withColumn("doc_id", document_of(F.col("passage_id"))).join(qrels.select("query_id", "doc_id").distinct(), ["query_id", "doc_id"], "left_semi")
    own = own.withColumn("place", F.row_number().over(Window.partitionBy("query_id", "doc_id").orderBy("rank")))
    hits = own.join(qrels, ["query_id", "doc_id", "passage_id"]).withColumn("nth", F.row_number().over(Window.partitionBy("query_id", "doc_id").orderBy("place")))
    sizes = qrels.groupBy("query_id", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    each = sizes.join(hits.groupBy("query_id", "doc_id").agg(F.sum(F.col("nth") / F.col("place")).alias("s")), ["query_id", "doc_id"], "left")
    topic = each.groupBy("query_id").agg(F.avg(F.coalesce(F.col("s") / F.col("n"), F.lit(0.0))).alias("v"))
    return topic.agg(F.round(F.coalesce(F.avg("v"), F.lit(0.0)), 6).alias("value")).select(F.lit(name).alias("metric"), "value")


def report(passages: DataFrame, documents: DataFrame, qrels: DataFrame) -> DataFrame:
    """All official metrics, from a passage ranking and the untruncated document ranking: the document metrics
    from one table of hits, and one row a query of it."""
    truth = qrels.withColumn("item", F.col("passage_id"))
    hits, sizes = _hits(documents.withColumn("item", F.col("doc_id")), document_truth(qrels), None)
    n, at = F.col("n"), F.col("rank")
    upto = lambda k, x: F.when(at <= k, x)
    found = F.count(upto(100, at))
    missed = (n - found) * 100 + (n * (n + 1) - found * (found + 1)) / 2
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(n.cast("int"), F.lit(10))), F.lit(0.0), lambda s, r: s + 1 / F.log2(r + 1.0))
    values = {
        "pres_doc@100": 1 - ((F.coalesce(F.sum(upto(100, at)), F.lit(0)) + missed) / n - (n + 1) / 2) / 100, "recall_doc@100": found / n,
        "ndcg_doc@10": F.sum(upto(10, 1 / F.log2(at + 1.0))) / ideal, "map_doc": F.sum(F.col("nth") / at) / n, "mrr_doc": 1.0 / F.min(at),
    }
    each = sizes.join(hits, "query_id", "left").groupBy("query_id", "n").agg(*(v.alias(k) for k, v in values.items()))
    mean = lambda k: F.round(F.coalesce(F.avg(F.coalesce(F.col(f"`{k}`"), F.lit(0.0))), F.lit(0.0)), 6)
    rows = each.agg(*(mean(k).alias(k) for k in values)).select(F.explode(F.array(*(F.struct(F.lit(k).alias("metric"), F.col(f"`{k}`").alias("value")) for k in values))).alias("m")).select("m.*")
    return reduce(DataFrame.unionByName, [mean_document_precision(passages, qrels), recall(passages.withColumn("item", F.col("passage_id")), truth, 1000, "recall_passage@1000"), rows])


def in_order(table: DataFrame) -> DataFrame:
    """A metric table (a few rows) with `place`: by name, then by the number after '@'."""
    depth = F.coalesce(F.expr("try_cast(regexp_extract(metric, '@([0-9]+)$', 1) as int)"), F.lit(0))
    return table.withColumn("place", F.row_number().over(Window.orderBy(F.substring_index("metric", "@", 1), depth)))
