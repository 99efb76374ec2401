"""End-to-end retrieval: every model gives (query_id, passage_id, score), then one rerank and one report.

The knobs' defaults are those of the survey's table; those of assignment decide the stored index,
the others apply to it afterwards and need no new one.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import index, metrics, scoring


@dataclass(frozen=True)
class Knobs:
    max_visible_chars: int = 3000
    max_section_chars: int = 32768
    max_docs: int = 300_000
    sample_seed: int = 42
    max_spans: int = 5_000_000
    section_balance: str = "equal_spans"
    unit: str = "spacy_token"
    pooling: str = "mean"
    r_c_percentile: float = 99.0
    hist_bins: int = 512
    center_seed: int = 123
    batch_size_ff: int = 1
    refine_iterations: int = 0
    document_assignment: str = "soft"
    weight_aggregation: str = "max"
    max_centers_per_span: int = 5
    search_cache: int = 16
    idf_exponent: float = 2.0
    length_norm_exponent: float = 0.5
    stop_center_fraction: float = 0.01
    query_max_chunks: int = -1
    first_span_weight: float = 1.0
    top_documents: int = 100
    sample_size: int = 25_000
    hard_neg_ratio: float = 0.75


def build_index(top: DataFrame, spans: DataFrame, radius: DataFrame, knobs: Knobs = Knobs()) -> DataFrame:
    """(center_id, passage_id, weight) of spans (span_id, passage_id), before stop centers, from their stored top
    centers (span_id, rank, center_id, sim)."""
    rows = index.assign_documents(top, radius, knobs.max_centers_per_span, knobs.search_cache, knobs.document_assignment == "hard")
    return index.weights(rows.join(spans.select("span_id", "passage_id"), "span_id"), "passage_id", knobs.weight_aggregation)


def query_weights(top: DataFrame, queries: DataFrame, radius: DataFrame, knobs: Knobs = Knobs()) -> DataFrame:
    """(query_id, center_id, weight) of query spans (span_id, query_id, position)."""
    w = index.assign_queries(top, queries, radius, knobs.max_centers_per_span, knobs.first_span_weight)
    agg = (F.max if knobs.weight_aggregation == "max" else F.sum)("w")
    return w.groupBy("query_id", "center_id").agg(agg.alias("weight"))


def without_stops(postings: DataFrame, n_centers: int, knobs: Knobs = Knobs()) -> DataFrame:
    return postings.join(index.stop_centers(postings, n_centers, knobs.stop_center_fraction).select("center_id"), "center_id", "left_anti")


# ---- models: each takes the inputs it names from a collection and gives (query_id, passage_id, score) ----


def sparse_centers(c: dict[str, DataFrame], knobs: Knobs) -> DataFrame:
    """From `query_weights`, `postings` (without stop centers) and `span_counts` (passage_id, n_spans)."""
    counts = c["span_counts"]
    return scoring.sparse_scores(c["query_weights"], c["postings"], index.idf(c["postings"], counts.count()), counts, knobs.idf_exponent, knobs.length_norm_exponent)


def bm25(c: dict[str, DataFrame], knobs: Knobs) -> DataFrame:
    """From `query_terms` (query_id, term) and `passage_terms` (passage_id, term), one row an occurrence."""
    return scoring.bm25(c["query_terms"], c["passage_terms"])


def splade(c: dict[str, DataFrame], knobs: Knobs) -> DataFrame:
    """From `query_term_weights` and `passage_term_weights`; a query's chunks are merged by maximum."""
    q = c["query_term_weights"].groupBy("query_id", "center_id").agg(F.max("weight").alias("weight"))
    return scoring.sparse_scores(q, c["passage_term_weights"])


def colbert(c: dict[str, DataFrame], knobs: Knobs) -> DataFrame:
    """From `token_similarities` (query_id, q_token, passage_id, sim)."""
    return scoring.late_interaction(c["token_similarities"])


def dense(c: dict[str, DataFrame], knobs: Knobs) -> DataFrame:
    """From `chunk_scores` (query_id, passage_id, score), a row for each chunk of a query."""
    return scoring.chunk_maximum(c["chunk_scores"])


#: Scorers by model name.
MODELS = {"sparse_centers": sparse_centers, "bm25": bm25, "splade": splade, "colbert": colbert, "dense": dense}


def run(model: str, collection: dict[str, DataFrame], knobs: Knobs = Knobs()) -> DataFrame:
    """(query_id, passage_id, score) of one model; ids as strings, whatever the model's are."""
    if model not in MODELS:
        raise ValueError(f"no model {model!r}; there are {', '.join(sorted(MODELS))}")
    return MODELS[model](collection, knobs).select(F.col("query_id").cast("string").alias("query_id"), F.col("passage_id").cast("string").alias("passage_id"), "score")


def evaluate(scores: DataFrame, passages: DataFrame, qrels: DataFrame, knobs: Knobs = Knobs()) -> DataFrame:
    """(metric, value): the official metrics after two-stage reranking."""
    return metrics.report(scoring.two_stage(scores, passages, knobs.top_documents), scoring.document_ranking(scores), qrels)
