"""Queries of vectors, index, scoring and metrics, on `embeddings`: every tenth vector is a center, the
others are spans; vec_id div 5 is a passage, div 20 a document, and vec_id % 50 = 7 the queries."""

from __future__ import annotations

from functools import cached_property, reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import index as I
from ..operators import metrics as M
from ..operators import scoring as S
from ..operators import vectors as V
from ..operators.tables import keep
from . import retrieval as R
from .registry import ORACLES, QUERIES, query, table

#: The cells' own queries use a percentile that cuts small cells too; retrieval uses the knobs' defaults.
PERCENTILE, BINS, TOP = 90.0, 64, 16


def vectors(spark, d) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("span_id"), F.col("embedding").cast("array<double>").alias("v"), "label")


def centers(spark, d) -> DataFrame:
    return vectors(spark, d).filter("span_id % 10 = 0").select(F.col("span_id").alias("center_id"), V.unit(F.col("v")).alias("center"))


def top(spark, d, k=TOP) -> DataFrame:
    return V.top_centers(vectors(spark, d).filter("span_id % 10 <> 0"), centers(spark, d), k)


def cells(spark, d) -> DataFrame:
    return V.cells(vectors(spark, d).filter("span_id % 10 <> 0"), centers(spark, d))


def radii(spark, d) -> DataFrame:
    return V.radii(cells(spark, d), PERCENTILE, BINS)


def spans(spark, d) -> DataFrame:
    """(span_id, passage_id) of the documents' spans."""
    rows = vectors(spark, d).filter("span_id % 10 <> 0 and span_id % 50 <> 7")
    return rows.select("span_id", F.expr("concat(cast(span_id div 20 as string), '::p', cast(span_id div 5 as string))").alias("passage_id"))


def n_centers(spark, d) -> int:
    return table(spark, d, "embeddings").filter("vec_id % 10 = 0").count()


class Run:
    """The tables of one retrieval, each built and stored when a query first asks for it."""

    def __init__(self, spark, d, knobs: R.Knobs = R.Knobs()):
        self.spark, self.d, self.knobs = spark, d, knobs

    @cached_property
    def top(self) -> DataFrame:
        return keep(top(self.spark, self.d, self.knobs.search_cache), "top")

    @cached_property
    def radii(self) -> DataFrame:
        rows = self.top.filter("rank = 1").select("span_id", "center_id", F.round(1 - F.col("sim"), 6).alias("dist"))
        return keep(V.radii(rows, self.knobs.r_c_percentile, self.knobs.hist_bins), "radii")

    @cached_property
    def spans(self) -> DataFrame:
        return spans(self.spark, self.d)

    @cached_property
    def n_spans(self) -> DataFrame:
        return keep(self.spans.groupBy("passage_id").agg(F.count(F.lit(1)).alias("n_spans")), "span-counts")

    @cached_property
    def assigned(self) -> DataFrame:
        return I.assign_documents(self.top, self.radii)

    @cached_property
    def all_postings(self) -> DataFrame:
        return keep(R.build_index(self.top, self.spans, self.radii, self.knobs), "postings")

    @cached_property
    def n_centers(self) -> int:
        return n_centers(self.spark, self.d)

    @cached_property
    def postings(self) -> DataFrame:
        """Without stop centers, which go before any join that scores."""
        return keep(R.without_stops(self.all_postings, self.n_centers, self.knobs), "postings")

    @cached_property
    def query_spans(self) -> DataFrame:
        return vectors(self.spark, self.d).filter("span_id % 50 = 7").select("span_id", F.col("span_id").alias("query_id"), F.lit(0).alias("position"))

    @cached_property
    def query_weights(self) -> DataFrame:
        return R.query_weights(self.top, self.query_spans, self.radii, self.knobs)

    @cached_property
    def collection(self) -> dict[str, DataFrame]:
        return {"query_weights": self.query_weights, "postings": self.postings, "span_counts": self.n_spans}

    @cached_property
    def scores(self) -> DataFrame:
        return keep(R.MODELS["sparse_centers"](self.collection, self.knobs), "scores")

    @cached_property
    def rerank(self) -> DataFrame:
        return keep(S.two_stage(self.scores, self.n_spans, self.knobs.top_documents), "rerank")

    @cached_property
    def documents(self) -> DataFrame:
        return keep(S.document_ranking(self.scores), "document-ranking")

    @cached_property
    def relevant(self) -> DataFrame:
        return keep(relevant(self.spark, self.d), "relevant")


def relevant(spark, d) -> DataFrame:
    """(query_id, passage_id): passages with a third span of the query's label."""
    e = table(spark, d, "embeddings")
    q = e.filter("vec_id % 50 = 7").select(F.col("vec_id").alias("query_id"), "label")
    p = e.filter("vec_id % 10 = 3").select("label", F.expr("concat(cast(vec_id div 20 as string), '::p', cast(vec_id div 5 as string))").alias("passage_id"))
    return q.join(p, "label").select("query_id", "passage_id").distinct()


six = lambda c: F.round(c, 6).alias(c)


@query("SELECT vec_id, unnest(range(len(v)))::INT AS j, round(unnest(v), 6) AS x FROM unit", "unit")
def vec1_unit_vectors(spark, d):
    return vectors(spark, d).select(F.col("span_id").alias("vec_id"), F.posexplode(V.unit(F.col("v"))).alias("j", "x")).select("vec_id", "j", six("x"))


@query("SELECT a.vec_id AS a, b.vec_id AS b, round(list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2])), 6) AS sim FROM unit a, unit b WHERE b.vec_id = a.vec_id + 1", "unit")
def vec2_cosine(spark, d):
    a = vectors(spark, d).select(F.col("span_id").alias("a"), V.unit(F.col("v")).alias("va"))
    b = vectors(spark, d).select(F.col("span_id").alias("b"), V.unit(F.col("v")).alias("vb"))
    return a.join(b, F.col("b") == F.col("a") + 1).select("a", "b", F.round(V.dot(F.col("va"), F.col("vb")), 6).alias("sim"))


@query("SELECT span_id, rank, center_id, sim FROM top WHERE rank <= 5", "unit near")
def vec3_top_centers(spark, d):
    return top(spark, d, 5)


def _farthest(n: int, batch: int) -> str:
    """SQL of the traversal: a table of distances and one of new centers for each step."""
    dot = "list_sum(list_transform(list_zip(u.v, c.v), lambda z: z[1] * z[2]))"
    seed = "(SELECT vec_id FROM embeddings ORDER BY md5(vec_id::VARCHAR), vec_id LIMIT 1)"
    steps = [f"f0 AS MATERIALIZED (SELECT vec_id, v, 9.0::DOUBLE AS far FROM unit), c0 AS MATERIALIZED (SELECT 0 AS position, vec_id, v FROM f0 WHERE vec_id = {seed})"]
    have, t = 1, 0
    while have < n:
        now, t = min(batch, n - have), t + 1
        steps.append(f"f{t} AS MATERIALIZED (SELECT u.vec_id, u.v, CASE WHEN bool_or(u.vec_id = c.vec_id) THEN -1 ELSE least(u.far, min(round(1 - {dot}, 6))) END AS far FROM f{t - 1} u, c{t - 1} c GROUP BY ALL)".replace("GROUP BY ALL", "GROUP BY u.vec_id, u.v, u.far"))
        steps.append(f"c{t} AS MATERIALIZED (SELECT {have} - 1 + row_number() OVER (ORDER BY far DESC, vec_id) AS position, vec_id, v FROM f{t} ORDER BY far DESC, vec_id LIMIT {now})")
        have += now
    return ", " + ", ".join(steps) + " " + " UNION ALL ".join(f"SELECT position::BIGINT AS position, vec_id AS span_id FROM c{k}" for k in range(t + 1))


@query(_farthest(12, 1), "unit")
def vec4_farthest_first(spark, d):
    return V.farthest_first(vectors(spark, d), 12)


@query(_farthest(32, 4), "unit")
def vec5_farthest_first_batches(spark, d):
    return V.farthest_first(vectors(spark, d), 32, batch=4)


@query("SELECT span_id, center_id, dist FROM cells", "unit near cells")
def vec6_voronoi_cells(spark, d):
    return cells(spark, d)


@query("SELECT center_id, n_points, round(r_c, 6) AS r_c FROM radii", "unit near cells radii")
def vec7_cell_radii(spark, d):
    return radii(spark, d).select("center_id", "n_points", six("r_c"))


@query("SELECT round(sum(covered) / sum(n_points), 6) AS coverage FROM radii", "unit near cells radii")
def vec8_coverage(spark, d):
    return radii(spark, d).agg(F.round(F.sum("covered") / F.sum("n_points"), 6).alias("coverage"))


@query("SELECT round(avg(dist), 6) AS mean_cos_distance, round(2 * avg(dist), 6) AS quantization_error_sq_l2, round(avg(dist * dist), 6) AS mean_sq_cos_distance, round(quantile_cont(dist, 0.5), 6) AS cos_distance_p50, round(quantile_cont(dist, 0.95), 6) AS cos_distance_p95, round(quantile_cont(dist, 0.99), 6) AS cos_distance_p99, max(dist) AS cos_distance_max FROM cells", "unit near cells")
def vec9_quantization(spark, d):
    q = V.quantization(cells(spark, d))
    return q.select(*(six(c) for c in q.columns))


@query("SELECT center_id, j, round(x / sqrt(sum(x * x) OVER (PARTITION BY center_id)), 6) AS x FROM (SELECT center_id, j, avg(x) AS x FROM (SELECT center_id, unnest(v) AS x, unnest(range(len(v)))::INT AS j FROM cells JOIN unit ON vec_id = span_id) GROUP BY ALL)", "unit near cells")
def vec10_refined_centers(spark, d):
    own = keep(cells(spark, d), "cells")
    c = V.refine(vectors(spark, d), own, centers(spark, d)).join(own.select("center_id").distinct(), "center_id", "left_semi")
    return c.select("center_id", F.posexplode("center").alias("j", "x")).select("center_id", "j", six("x"))


@query()
def vec11_kmeans_centers(spark, d):
    return V.kmeans_centers(vectors(spark, d), 20)


@query("SELECT round(quantile_cont(greatest(r_c, 1e-6), 0.5), 6) AS r, round(min(greatest(r_c, 1e-6)), 6) AS r_min, round(max(greatest(r_c, 1e-6)), 6) AS r_max, (SELECT count(*) FROM embeddings WHERE vec_id % 10 = 0) - count(*) AS n_empty, min(n_points) AS points_min, quantile_cont(n_points, 0.5) AS points_median, max(n_points) AS points_max, sum(covered)::BIGINT AS covered FROM radii", "unit near cells radii")
def vec12_center_statistics(spark, d):
    return V.center_statistics(radii(spark, d), n_centers(spark, d)).select(six("r"), six("r_min"), six("r_max"), "n_empty", "points_min", "points_median", "points_max", "covered")


@query("SELECT q.vec_id AS query_id, p.vec_id AS passage_id, round(list_sum(list_transform(list_zip(q.v, p.v), lambda z: z[1] * z[2])), 6) AS score FROM unit q, unit p WHERE q.vec_id % 100 = 0", "unit")
def vec13_dense_scores(spark, d):
    """All passages against the stated query set, in blocks."""
    q = vectors(spark, d).filter("span_id % 100 = 0").select(F.col("span_id").alias("center_id"), F.col("v").alias("center"))
    return V.similarities(vectors(spark, d), q).select(F.col("center_id").alias("query_id"), F.col("span_id").alias("passage_id"), F.col("sim").alias("score"))


@query("SELECT query_id, passage_id, max(score) AS score FROM (SELECT q.vec_id // 200 AS query_id, p.vec_id AS passage_id, round(list_sum(list_transform(list_zip(q.v, p.v), lambda z: z[1] * z[2])), 6) AS score FROM unit q, unit p WHERE q.vec_id % 100 = 0) GROUP BY ALL", "unit")
def vec14_chunk_maximum(spark, d):
    return S.chunk_maximum(vec13_dense_scores(spark, d).withColumn("query_id", F.expr("query_id div 200")))


@query("SELECT vec_id // 5 AS passage_id, j, round(avg(x), 6) AS mean, round(min_by(x, vec_id), 6) AS cls FROM (SELECT vec_id, unnest(embedding::DOUBLE[]) AS x, unnest(range(len(embedding)))::INT AS j FROM embeddings) GROUP BY ALL")
def vec15_pooling(spark, d):
    x = vectors(spark, d).select("span_id", F.expr("span_id div 5").alias("passage_id"), F.posexplode("v").alias("j", "x"))
    return x.groupBy("passage_id", "j").agg(F.round(F.avg("x"), 6).alias("mean"), F.round(F.min_by("x", "span_id"), 6).alias("cls"))


@query("SELECT span_id, center_id, sim FROM assigned", "unit near cells radii99 docs_assigned")
def idx1_soft_assignment(spark, d):
    return Run(spark, d).assigned


@query("SELECT span_id, center_id, sim FROM top JOIN radii USING (center_id) WHERE rank = 1 AND sim > 0 AND sim >= round(1 - greatest(r_c, 1e-6), 6)", "unit near cells radii99")
def idx2_hard_assignment(spark, d):
    r = Run(spark, d)
    return I.assign_documents(r.top, r.radii, hard=True)


@query("SELECT query_id, center_id, weight FROM qw", "unit near cells radii99 queries")
def idx3_query_assignment(spark, d):
    return Run(spark, d).query_weights


@query("SELECT query_id, center_id, round(2 * weight, 6) AS w FROM qw", "unit near cells radii99 queries")
def idx4_first_span_weight(spark, d):
    r = Run(spark, d)
    w = I.assign_queries(r.top, r.query_spans, r.radii, first_weight=2.0)
    return w.groupBy("query_id", "center_id").agg(F.round(F.max("w"), 6).alias("w"))


@query("SELECT center_id, passage_id, max(sim) AS max_weight, round(sum(sim), 6) AS sum_weight FROM assigned JOIN spans USING (span_id) GROUP BY ALL", "unit near cells radii99 docs_assigned postings")
def idx5_grouped_weights(spark, d):
    r = Run(spark, d)
    a, b = r.all_postings, R.build_index(r.top, r.spans, r.radii, R.Knobs(weight_aggregation="sum"))
    return a.withColumnRenamed("weight", "max_weight").join(b.select("center_id", "passage_id", F.round("weight", 6).alias("sum_weight")), ["center_id", "passage_id"])


@query("SELECT span_id, passage_id, center_id FROM assigned JOIN spans USING (span_id)", "unit near cells radii99 docs_assigned postings")
def idx6_mapped_spans(spark, d):
    return Run(spark, d).assigned.join(spans(spark, d), "span_id").select("span_id", "passage_id", "center_id")


@query("SELECT p.passage_id, coalesce(n.n_spans, 1) AS n_spans FROM (SELECT DISTINCT (vec_id // 20)::VARCHAR || '::p' || (vec_id // 5) AS passage_id FROM embeddings) p LEFT JOIN n_spans n USING (passage_id)", "unit near cells radii99 docs_assigned postings")
def idx7_span_counts(spark, d):
    every = vectors(spark, d).select(F.expr("concat(cast(span_id div 20 as string), '::p', cast(span_id div 5 as string))").alias("passage_id")).distinct()
    return every.join(Run(spark, d).n_spans, "passage_id", "left").select("passage_id", F.coalesce("n_spans", F.lit(1)).cast("long").alias("n_spans"))


@query("SELECT center_id, passage_id, weight FROM posts", "unit near cells radii99 docs_assigned postings")
def idx8_without_stop_centers(spark, d):
    return Run(spark, d).postings


@query("SELECT center_id, df, round(idf, 6) AS idf FROM idfs", "unit near cells radii99 docs_assigned postings")
def idx9_idf(spark, d):
    r = Run(spark, d)
    return I.idf(r.postings, r.n_spans.count()).select("center_id", "df", six("idf"))


@query("SELECT sum(n)::BIGINT AS entries, round(avg(n), 6) AS mean_non_empty, max(n) AS longest, (SELECT count(*) FROM embeddings WHERE vec_id % 10 = 0) - count(*) AS n_empty FROM (SELECT center_id, count(*) AS n FROM posts0 GROUP BY 1)", "unit near cells radii99 docs_assigned postings")
def idx10_posting_statistics(spark, d):
    return I.posting_statistics(Run(spark, d).all_postings, n_centers(spark, d)).withColumn("mean_non_empty", F.round("mean_non_empty", 6))


@query("SELECT query_id, passage_id, score FROM scores", "unit near cells radii99 docs_assigned postings queries scores")
def scr1_sparse_scores(spark, d):
    return Run(spark, d).scores


@query("SELECT query_id, passage_id, round(sum(q.weight * pow(idf, 2.0) * p.weight), 6) AS score FROM qw q JOIN posts p USING (center_id) JOIN idfs USING (center_id) GROUP BY ALL", "unit near cells radii99 docs_assigned postings queries")
def scr2_without_length_norm(spark, d):
    r = Run(spark, d)
    return S.sparse_scores(r.query_weights, r.postings, I.idf(r.postings, r.n_spans.count()))


@query("SELECT query_id, doc_id, score, rank FROM docrank", "unit near cells radii99 docs_assigned postings queries scores ranks")
def scr7_document_ranking(spark, d):
    return Run(spark, d).documents


@query("SELECT query_id, passage_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, passage_id)::INT AS rank FROM scores) WHERE rank <= 10", "unit near cells radii99 docs_assigned postings queries scores")
def scr8_top_passages(spark, d):
    return S.ranked(Run(spark, d).scores, 10)


@query("SELECT query_id, passage_id, score, rank FROM rerank", "unit near cells radii99 docs_assigned postings queries scores ranks")
def scr6_two_stage_rerank(spark, d):
    return Run(spark, d).rerank


@query("WITH e AS (SELECT query_id, coalesce(sum(n), 0) AS scanned, count(*) AS terms FROM qw LEFT JOIN (SELECT center_id, count(*) AS n FROM posts GROUP BY 1) USING (center_id) GROUP BY 1) SELECT (2 * sum(scanned))::BIGINT AS flops, round(avg(scanned), 6) AS scanned_mean, quantile_cont(scanned, 0.5) AS scanned_p50, round(quantile_cont(scanned, 0.9), 6) AS scanned_p90, round(quantile_cont(scanned, 0.99), 6) AS scanned_p99, max(scanned)::BIGINT AS scanned_max, round(avg(terms), 6) AS terms_mean, quantile_cont(terms, 0.5) AS terms_p50, round(quantile_cont(terms, 0.9), 6) AS terms_p90, round(quantile_cont(terms, 0.99), 6) AS terms_p99, max(terms) AS terms_max FROM e".replace("WITH e AS", ", e AS"), "unit near cells radii99 docs_assigned postings queries")
def scr10_scan_costs(spark, d):
    r = Run(spark, d)
    c = S.scan_costs(r.query_weights, r.postings)
    return c.select(*(F.round(x, 6).alias(x) if x.endswith(("mean", "p90", "p99")) else F.col(x) for x in c.columns))


@query("SELECT query_id, passage_id, round(sum(m), 6) AS score FROM (SELECT q.vec_id // 200 AS query_id, q.vec_id AS q_token, p.vec_id // 5 AS passage_id, max(round(list_sum(list_transform(list_zip(q.v, p.v), lambda z: z[1] * z[2])), 6)) AS m FROM unit q, unit p WHERE q.vec_id % 100 = 0 GROUP BY ALL) GROUP BY ALL", "unit")
def scr5_late_interaction(spark, d):
    pairs = vec13_dense_scores(spark, d).select(F.expr("query_id div 200").alias("query_id"), F.col("query_id").alias("q_token"), F.expr("passage_id div 5").alias("passage_id"), F.col("score").alias("sim"))
    return S.late_interaction(pairs)


def scr9_models(spark, d):
    """The ten best passages of each query by each of the models, all through one dispatch."""
    from . import q_text

    pairs = vec13_dense_scores(spark, d)
    weights, terms = q_text.term_weights(spark, d), q_text.all_terms(spark, d)
    c = Run(spark, d).collection | {"query_term_weights": weights[0], "passage_term_weights": weights[1], "query_terms": terms[0], "passage_terms": terms[1]}
    c["chunk_scores"] = pairs.withColumn("query_id", F.expr("query_id div 200"))
    c["token_similarities"] = pairs.select(F.expr("query_id div 200").alias("query_id"), F.col("query_id").alias("q_token"), F.expr("passage_id div 5").alias("passage_id"), F.col("score").alias("sim"))
    rows = (S.ranked(R.run(m, c), 10).withColumn("model", F.lit(m)) for m in sorted(R.MODELS))
    return reduce(DataFrame.unionByName, rows).select("model", "query_id", "passage_id", "score", "rank")


QUERIES["scr9_models"] = scr9_models


def _docs(spark, d):
    r = Run(spark, d)
    return r.documents.withColumn("item", F.col("doc_id")), M.document_truth(r.relevant)


_M = "unit near cells radii99 docs_assigned postings queries scores ranks truth"


@query("SELECT 'magp' AS metric, round(avg(v), 6) AS value FROM (SELECT query_id, avg(ap) AS v FROM (SELECT r.query_id, r.doc_id, coalesce(sum(h.nth / h.place), 0) / any_value(r.n) AS ap FROM (SELECT query_id, split_part(passage_id, '::', 1) AS doc_id, count(*) AS n FROM rel GROUP BY ALL) r LEFT JOIN (SELECT o.query_id, o.doc_id, o.place, row_number() OVER (PARTITION BY o.query_id, o.doc_id ORDER BY o.place) AS nth FROM (SELECT query_id, passage_id, split_part(passage_id, '::', 1) AS doc_id, row_number() OVER (PARTITION BY query_id, split_part(passage_id, '::', 1) ORDER BY rank) AS place FROM rerank) o JOIN rel USING (query_id, passage_id)) h USING (query_id, doc_id) GROUP BY ALL) GROUP BY 1)", _M)
def met1_magp(spark, d):
    r = Run(spark, d)
    return M.mean_document_precision(r.rerank, r.relevant)


@query("SELECT 'recall_doc@100' AS metric, round(avg(coalesce(h, 0) / n), 6) AS value FROM docn LEFT JOIN (SELECT query_id, count(*) AS h FROM dochit WHERE rank <= 100 GROUP BY 1) USING (query_id)", _M)
def met2_recall(spark, d):
    return M.recall(*_docs(spark, d), 100, "recall_doc@100")


@query("SELECT 'ndcg_doc@10' AS metric, round(avg(coalesce(g, 0) / (SELECT sum(1 / log2(r + 1.0)) FROM range(1, 11) t(r) WHERE r <= n)), 6) AS value FROM docn LEFT JOIN (SELECT query_id, sum(1 / log2(rank + 1.0)) AS g FROM dochit WHERE rank <= 10 GROUP BY 1) USING (query_id)", _M)
def met3_ndcg(spark, d):
    return M.ndcg(*_docs(spark, d), 10, "ndcg_doc@10")


@query("SELECT 'map_doc' AS metric, round(avg(coalesce(a, 0) / n), 6) AS value FROM docn LEFT JOIN (SELECT query_id, sum(nth / rank) AS a FROM dochit GROUP BY 1) USING (query_id)", _M)
def met4_map(spark, d):
    return M.average_precision(*_docs(spark, d), "map_doc")


@query("SELECT 'mrr_doc' AS metric, round(avg(coalesce(a, 0)), 6) AS value FROM docn LEFT JOIN (SELECT query_id, 1.0 / min(rank) AS a FROM dochit GROUP BY 1) USING (query_id)", _M)
def met5_mrr(spark, d):
    return M.reciprocal_rank(*_docs(spark, d), "mrr_doc")


@query("SELECT 'pres_doc@100' AS metric, round(avg(1 - ((coalesce(s, 0) + (n - coalesce(f, 0)) * 100 + (n * (n + 1) - coalesce(f, 0) * (coalesce(f, 0) + 1)) / 2) / n - (n + 1) / 2) / 100), 6) AS value FROM docn LEFT JOIN (SELECT query_id, sum(rank) AS s, count(*) AS f FROM dochit WHERE rank <= 100 GROUP BY 1) USING (query_id)", _M)
def met6_pres(spark, d):
    return M.pres(*_docs(spark, d), 100, "pres_doc@100")


@query("SELECT query_id, doc_id AS item FROM docrel", _M)
def met7_relevant_documents(spark, d):
    return M.document_truth(relevant(spark, d))


@query("SELECT 'recall_passage@1000' AS metric, round(avg(coalesce(h, 0) / n), 6) AS value FROM (SELECT query_id, count(*) AS n FROM rel GROUP BY 1) LEFT JOIN (SELECT query_id, count(*) AS h FROM rerank JOIN rel USING (query_id, passage_id) WHERE rank <= 1000 GROUP BY 1) USING (query_id)", _M)
def met2_passage_recall(spark, d):
    r = Run(spark, d)
    return M.recall(r.rerank.withColumn("item", F.col("passage_id")), r.relevant.withColumn("item", F.col("passage_id")), 1000, "recall_passage@1000")


@query()
def met8_report(spark, d):
    r = Run(spark, d)
    return R.evaluate(r.scores, r.n_spans, r.relevant, r.knobs)


def _bodies() -> str:
    """The SQL of all metrics under their common table expressions."""
    names = ("met1_magp", "met2_passage_recall", "met6_pres", "met2_recall", "met3_ndcg", "met4_map", "met5_mrr")
    head = ORACLES["met7_relevant_documents"].removesuffix("SELECT query_id, doc_id AS item FROM docrel")
    return head + " UNION ALL ".join(ORACLES[n].removeprefix(head) for n in names)


ORACLES["met8_report"] = _bodies()


def _dispatched() -> str:
    """The SQL of all models, each as a subquery of its own."""
    names = {"bm25": "scr4_bm25", "colbert": "scr5_late_interaction", "dense": "vec14_chunk_maximum", "sparse_centers": "scr1_sparse_scores", "splade": "scr3_term_weight_scores"}
    rows = " UNION ALL ".join(f"SELECT '{m}' AS model, query_id::VARCHAR AS query_id, passage_id::VARCHAR AS passage_id, score FROM ({ORACLES[q]})" for m, q in names.items())
    return f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY model, query_id ORDER BY score DESC, passage_id)::INT AS rank FROM ({rows})) WHERE rank <= 10"


from . import q_text  # noqa: E402, F401  (its SQL is part of that of the dispatch)

ORACLES["scr9_models"] = _dispatched()
