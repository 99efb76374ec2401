"""Named queries, each with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, parts: str = ""):
    """Register a function under its name. `parts` names the common table expressions its SQL starts with."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ctes = ", ".join(SQL_PARTS[p] for p in parts.split())
            ORACLES[f.__name__] = (f"WITH RECURSIVE {ctes} " if ctes else "") + sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, i, line): the lines of each document, numbered from 0."""
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))


def fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, title, abstract, claim, invention): first, second and third line, and the rest."""
    x = F.split("text", "\n")
    at = lambda k: F.coalesce(F.get(x, F.lit(k)), F.lit(""))
    rest = F.when(F.size(x) > 3, F.array_join(F.slice(x, F.lit(4), F.greatest(F.size(x) - 3, F.lit(0))), " ")).otherwise("")
    return table(spark, sf_dir, "documents").select("doc_id", at(0).alias("title"), at(1).alias("abstract"), at(2).alias("claim"), rest.alias("invention"))


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(passage_id, doc_id, xpath, text): a passage for each line that isn't blank."""
    n = (F.col("i") + 1).cast("string")
    path = F.when(F.col("i") == 0, "/patent-document/abstract[1]/p[1]").when(F.col("i") % 3 == 1, F.concat(F.lit("/patent-document/claims/claim["), n, F.lit("]"))).otherwise(F.concat(F.lit("/patent-document/description/p["), n, F.lit("]")))
    rows = lines(spark, sf_dir).filter("trim(line) <> ''").select(F.col("doc_id").cast("string").alias("doc_id"), path.alias("xpath"), F.col("line").alias("text"))
    return rows.select(F.concat("doc_id", F.lit("::"), "xpath").alias("passage_id"), "doc_id", "xpath", "text")


def _radii(bins: int, p: int) -> str:
    return f"hist AS (SELECT center_id, least({bins} - 1, floor(dist * {bins} / 2))::INT AS bin, count(*) AS n FROM cells GROUP BY ALL), cum AS (SELECT *, sum(n) OVER (PARTITION BY center_id ORDER BY bin) AS hi FROM hist), whole AS (SELECT center_id, count(*) AS n_points, max(dist) AS largest FROM cells GROUP BY 1), cross_at AS (SELECT center_id, min(bin) AS bin FROM cum JOIN whole USING (center_id) WHERE hi >= n_points * ({p}::DOUBLE / 100) GROUP BY 1), r0 AS (SELECT center_id, n_points, largest, bin / {bins}.0 * 2 + (n_points * ({p}::DOUBLE / 100) - (hi - n)) / n * (2.0 / {bins}) AS r FROM cross_at JOIN cum USING (center_id, bin) JOIN whole USING (center_id)), radii AS (SELECT center_id, n_points, CASE WHEN n_points < ceil(100.0 / (100 - {p})) THEN largest ELSE r END AS r_c, (SELECT sum(n) FROM hist h WHERE h.center_id = r0.center_id AND h.bin <= least({bins} - 1, floor(r * {bins} / 2))) AS covered FROM r0)"


SQL_PARTS = {
    "lines": "lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10)))))::INT AS i FROM documents)",
    "fields": "fields AS (SELECT doc_id, coalesce(x[1], '') AS title, coalesce(x[2], '') AS abstract, coalesce(x[3], '') AS claim, CASE WHEN len(x) > 3 THEN array_to_string(x[4:], ' ') ELSE '' END AS invention FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents))",
    "passages": "passages AS (SELECT doc_id::VARCHAR || '::' || xpath AS passage_id, doc_id::VARCHAR AS doc_id, xpath, line AS text FROM (SELECT doc_id, line, CASE WHEN i = 0 THEN '/patent-document/abstract[1]/p[1]' WHEN i % 3 = 1 THEN '/patent-document/claims/claim[' || (i + 1) || ']' ELSE '/patent-document/description/p[' || (i + 1) || ']' END AS xpath FROM lines WHERE trim(line) <> ''))",
    # vectors: every tenth is a center, the rest are spans of passages, documents and queries
    "unit": "unit AS (SELECT vec_id, label, list_transform(e, lambda x: x / greatest(n, 1e-12)) AS v FROM (SELECT vec_id, label, embedding::DOUBLE[] AS e, sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))) AS n FROM embeddings))",
    "near": "near AS (SELECT s.vec_id AS span_id, c.vec_id AS center_id, round(list_sum(list_transform(list_zip(s.v, c.v), lambda z: z[1] * z[2])), 6) AS sim FROM unit s, unit c WHERE s.vec_id % 10 <> 0 AND c.vec_id % 10 = 0), top AS (SELECT * FROM (SELECT span_id, center_id, sim, row_number() OVER (PARTITION BY span_id ORDER BY sim DESC, center_id)::INT AS rank FROM near) WHERE rank <= 16)",
    "cells": "cells AS (SELECT span_id, center_id, round(1 - sim, 6) AS dist FROM top WHERE rank = 1)",
    "radii": _radii(64, 90),
    "radii99": _radii(512, 99),
    "docs_assigned": "assigned AS (SELECT span_id, center_id, sim FROM (SELECT *, row_number() OVER (PARTITION BY span_id ORDER BY rank) AS place FROM top JOIN radii USING (center_id) WHERE sim > 0 AND sim >= round(1 - greatest(r_c, 1e-6), 6)) WHERE place <= 5)",
    "postings": "spans AS (SELECT vec_id AS span_id, (vec_id // 20)::VARCHAR || '::p' || (vec_id // 5) AS passage_id FROM embeddings WHERE vec_id % 10 <> 0 AND vec_id % 50 <> 7), posts0 AS (SELECT center_id, passage_id, max(sim) AS weight FROM assigned JOIN spans USING (span_id) GROUP BY ALL), stops AS (SELECT center_id FROM (SELECT center_id, count(*) AS df FROM posts0 GROUP BY 1) ORDER BY df DESC, center_id LIMIT greatest(1, round_even((SELECT count(*) FROM embeddings WHERE vec_id % 10 = 0) * 0.01, 0)::INT)), posts AS (SELECT * FROM posts0 WHERE center_id NOT IN (SELECT center_id FROM stops)), n_spans AS (SELECT passage_id, count(*) AS n_spans FROM spans GROUP BY 1), idfs AS (SELECT center_id, count(*) AS df, ln(((SELECT count(*) FROM n_spans) + 1.0) / (count(*) + 1.0)) + 1.0 AS idf FROM posts GROUP BY 1)",
    "queries": "qspans AS (SELECT vec_id AS span_id, vec_id AS query_id, 0 AS position FROM embeddings WHERE vec_id % 50 = 7), qnear AS (SELECT query_id, center_id, sim, (sim > 0 AND sim >= round(1 - greatest(r_c, 1e-6), 6)) AS ok FROM top JOIN qspans USING (span_id) JOIN radii USING (center_id) WHERE rank <= 5), qw AS (SELECT query_id, center_id, max(sim) AS weight FROM (SELECT *, max(ok::INT) OVER (PARTITION BY query_id) AS anyok FROM qnear) WHERE (ok OR anyok = 0) AND sim > 0 GROUP BY ALL)",
    "scores": "scores AS (SELECT query_id, passage_id, round(sum(q.weight * pow(idf, 2.0) * p.weight) / greatest(pow(any_value(coalesce(n_spans, 1)), 0.5), 1e-6), 6) AS score FROM qw q JOIN posts p USING (center_id) JOIN idfs USING (center_id) LEFT JOIN n_spans USING (passage_id) GROUP BY ALL)",
    "ranks": "docrank AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INT AS rank FROM (SELECT query_id, split_part(passage_id, '::', 1) AS doc_id, max(score) AS score FROM scores GROUP BY ALL)), rerank AS (SELECT query_id, passage_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, passage_id)::INT AS rank FROM (SELECT d.query_id, n.passage_id, coalesce(s.score, -1e9) AS score FROM docrank d JOIN n_spans n ON split_part(n.passage_id, '::', 1) = d.doc_id LEFT JOIN scores s ON s.query_id = d.query_id AND s.passage_id = n.passage_id WHERE d.rank <= 100))",
    "truth": "rel AS (SELECT q.vec_id AS query_id, (p.vec_id // 20)::VARCHAR || '::p' || (p.vec_id // 5) AS passage_id FROM embeddings q JOIN embeddings p ON q.label = p.label WHERE q.vec_id % 50 = 7 AND p.vec_id % 10 = 3 GROUP BY ALL), docrel AS (SELECT DISTINCT query_id, split_part(passage_id, '::', 1) AS doc_id FROM rel), docn AS (SELECT query_id, count(*) AS n FROM docrel GROUP BY 1), dochit AS (SELECT d.query_id, d.rank, row_number() OVER (PARTITION BY d.query_id ORDER BY d.rank) AS nth FROM docrank d JOIN docrel r ON d.query_id = r.query_id AND d.doc_id = r.doc_id)",
}
