"""Queries of sources, sinks, caches, samples and the span job."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import encoding, metrics, sampling, tables
from ..sources import corpora as C
from ..sources import embeddings as E
from .q_text import section_texts
from .q_vectors import cells, centers, radii, top, vectors
from .registry import fields, lines, passages, query, table

_F = "SELECT doc_id::VARCHAR AS doc_id, trim(title) AS title, trim(abstract) AS abstract, claim, invention FROM fields"
PASS = "lines passages"


def jsonl(spark, d):
    body = F.struct("title", F.col("abstract").alias("pa01"), F.col("claim").alias("c-en-0001"), F.col("invention").alias("p0001"))
    rows = fields(spark, d).select(F.col("doc_id").alias("seq"), F.to_json(F.struct(F.col("doc_id").cast("string").alias("dnum"), body.alias("Content"))).alias("line"))
    return rows.unionByName(spark.createDataFrame([(-1, ""), (-2, "{broken")], "seq long, line string"))


@query(_F, "fields")
def src1_jsonl_corpus(spark, d):
    path = f"{tables.shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    jsonl(spark, d).select("line").write.text(path)
    return C.read_jsonl(spark, path, entities=False)


def epo(spark, d):
    block = F.concat(F.lit("TITLE ::: "), "title", F.lit("\nABSTR ::: "), "abstract", F.lit("\nOTHER ::: x\ny\nCLAIM1 ::: "), "claim", F.lit("\nmore\nDESCR ::: "), "invention")
    return fields(spark, d).select("doc_id", block.alias("text"))


@query("SELECT doc_id, trim(title) AS title, trim(abstract) AS abstract, trim(trim(claim) || chr(10) || 'more', ' ' || chr(10)) AS claim, trim(invention) AS invention FROM fields", "fields")
def src2_epo_text(spark, d):
    folder = f"{tables.shared_folder(spark)}/epo-{uuid.uuid4().hex}"
    path = F.concat(F.lit(folder), F.lit("/"), (1980 + F.col("doc_id") % 10).cast("string"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    E.write_files(epo(spark, d).select(path.alias("path"), "text"))
    return C.read_epo(spark, folder, 1980, 1989).withColumn("doc_id", F.col("doc_id").cast("long"))


@query("SELECT doc_id, year FROM (SELECT doc_id, year, row_number() OVER (PARTITION BY year ORDER BY md5('42:' || doc_id), doc_id) AS r, count(*) OVER (PARTITION BY year) AS n, (SELECT count(*) FROM documents WHERE 1980 + doc_id % 10 BETWEEN 1982 AND 1985) AS total FROM (SELECT doc_id, (1980 + doc_id % 10)::INT AS year FROM documents) WHERE year BETWEEN 1982 AND 1985) WHERE r <= CASE WHEN total <= 50 THEN n ELSE 50 * n // total + CASE WHEN year - 1982 < 50 - 4 * (50 * n // total) THEN 1 ELSE 0 END END")
def src3_capped_years(spark, d):
    rows = table(spark, d, "documents").select("doc_id", (1980 + F.col("doc_id") % 10).cast("int").alias("year")).filter("year between 1982 and 1985")
    return sampling.by_budget(rows, "year", "doc_id", sampling.year_caps(sampling.counts(rows, "year"), 50))


def xml(spark, d):
    esc = lambda c: F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    f = fields(spark, d)
    p = lambda tag, c: F.concat(F.lit(f"<{tag}>"), esc(F.col(c)), F.lit(f"</{tag}>"))
    lang = F.when(F.col("doc_id") % 4 == 0, "DE").otherwise("EN")
    return f.select("doc_id", F.concat(F.lit('<patent-document lang="'), lang, F.lit('"><invention-title lang="EN">'), esc(F.col("title")), F.lit("</invention-title><abstract>"), p("p", "abstract"), F.lit("<p> </p></abstract><description>"), p("p", "invention"), F.lit("</description><claims>"), p("claim", "claim"), p("claim", "title"), F.lit("</claims></patent-document>")).alias("xml"))


_XML = "xp AS (SELECT doc_id::VARCHAR AS doc_id, trim(title) AS title, CASE WHEN doc_id % 4 = 0 THEN 'DE' ELSE 'EN' END AS lang, unnest(['/patent-document/abstract[1]/p[1]', '/patent-document/description/p[1]', '/patent-document/claims/claim[1]', '/patent-document/claims/claim[2]']) AS xpath, trim(unnest([abstract, invention, claim, title])) AS text FROM fields)"


@query(f", {_XML} SELECT doc_id, xpath, text FROM xp WHERE text <> ''", "fields")
def src4_xml_passages(spark, d):
    return C.passages_of(C.parse_xml(xml(spark, d))).select("doc_id", "xpath", "text")


@query("SELECT doc_id::VARCHAR AS doc_id, trim(title) AS title FROM fields", "fields")
def src5_xml_titles(spark, d):
    return C.parse_xml(xml(spark, d)).select("doc_id", "title")


@query(f", {_XML} SELECT doc_id, '/patent-document/claims/claim[1]' AS xpath, text FROM xp WHERE xpath = '/patent-document/claims/claim[1]' AND text <> ''", "fields")
def src6_resolved_xpaths(spark, d):
    p = C.passages_of(C.parse_xml(xml(spark, d))).select("doc_id", "xpath", "text")
    return C.resolve(table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), F.lit("/patent-document/claims/claim").alias("xpath")), p)


@query("SELECT page_id, CASE WHEN regexp_matches(substr(html, 1, 512), '<html[^>]+lang=\"([^\"]+)\"') THEN upper(regexp_extract(substr(html, 1, 512), '<html[^>]+\\blang=\"([^\"]+)\"', 1)) END AS lang FROM pages")
def src7_header_language(spark, d):
    return table(spark, d, "pages").select("page_id", C.header_language(F.col("html"), "html").alias("lang"))


@query(f", {_XML} SELECT doc_id || '::' || xpath AS passage_id, text, title FROM xp WHERE text <> '' AND lang = 'EN'", "fields")
def src8_language_corpus(spark, d):
    return C.passages_of(C.parse_xml(xml(spark, d)), "EN").select("passage_id", "text", "title")


def topics(spark, d):
    b = table(spark, d, "benchmark")
    block = F.concat(F.lit("<tid>T"), "item_id", F.lit("</tid>\n<tfile>"), "item_id", F.lit(".xml</tfile>\n<tclaims>/patent-document/claims/claim[1] /patent-document/abstract[1]/p[1]</tclaims>\n<tfam-docs>f"), "item_id", F.lit("</tfam-docs>\n\n<tid>bad</tid>"))
    return C.parse_topics(b.select(block.alias("text")))


@query("SELECT 'T' || item_id AS tid, item_id || '.xml' AS tfile, '/patent-document/claims/claim[1] /patent-document/abstract[1]/p[1]' AS tclaims, 'f' || item_id AS tfam FROM benchmark")
def src9_topics(spark, d):
    return topics(spark, d).withColumn("tclaims", F.array_join("tclaims", " "))


@query("SELECT tid, text FROM (SELECT 'T' || item_id AS tid, concat_ws(' ', nullif(trim(claim), ''), nullif(trim(abstract), '')) AS text FROM benchmark JOIN fields ON doc_id = item_id) WHERE text <> ''", "fields")
def src10_topic_texts(spark, d):
    p = C.passages_of(C.parse_xml(xml(spark, d)))
    n = F.regexp_extract("xpath", r"/claim\[(\d+)\]$", 1)
    return C.topic_texts(topics(spark, d), p.filter(n != "").select("doc_id", n.cast("int").alias("number"), "text"), p.select("doc_id", "xpath", "text"))


def qrel_lines(spark, d):
    b = table(spark, d, "benchmark").select(F.concat(F.lit("T"), "item_id", F.lit(","), "item_id", F.lit(", /patent-document/claims/claim[1],1")).alias("line"))
    return b.unionByName(spark.createDataFrame([("short,line",)], "line string"))


@query("SELECT 'T' || item_id AS query_id, item_id::VARCHAR AS doc_id, '/patent-document/claims/claim[1]' AS xpath, item_id || '::/patent-document/claims/claim[1]' AS passage_id FROM benchmark")
def src11_qrels(spark, d):
    return C.parse_qrels(qrel_lines(spark, d))


@query(f", {_XML} SELECT 'T' || doc_id AS query_id, doc_id || '::' || xpath AS passage_id, text FROM xp WHERE text <> '' AND lang = 'EN' AND xpath LIKE '%claim[1]' AND doc_id::INT IN (SELECT item_id FROM benchmark)", "fields")
def src12_qrel_corpus(spark, d):
    x = C.parse_xml(xml(spark, d))
    p, q = C.qrel_corpus(C.passages_of(x), C.parse_qrels(qrel_lines(spark, d)), x.select("doc_id", "lang"))
    return q.select("query_id", "passage_id").join(p.select("passage_id", "text"), "passage_id").select("query_id", "passage_id", "text")


@query("SELECT doc_id::VARCHAR AS doc_id, CASE WHEN doc_id % 3 = 0 THEN '/r/tfiles/' ELSE '/r/coll/' END || doc_id || '.xml' AS path FROM documents")
def src13_document_paths(spark, d):
    a = table(spark, d, "documents").select(F.concat(F.lit("/r/coll/"), "doc_id", F.lit(".xml")).alias("path"))
    b = table(spark, d, "documents").filter("doc_id % 3 = 0").select(F.concat(F.lit("/r/tfiles/"), "doc_id", F.lit(".xml")).alias("path"))
    return C.document_paths(a.unionByName(b))


@query(f", {_XML} SELECT q.tid AS query_id, count(*) AS n_passages FROM (SELECT DISTINCT 'T' || doc_id AS tid FROM xp WHERE text <> '' AND lang = 'EN' AND xpath LIKE '%claim[1]' AND doc_id::INT IN (SELECT item_id FROM benchmark)) q, (SELECT * FROM xp WHERE text <> '' AND lang = 'EN') GROUP BY 1", "fields")
def src14_full_corpus(spark, d):
    x = C.parse_xml(xml(spark, d))
    p, q = C.passages_of(x, "EN"), C.parse_qrels(qrel_lines(spark, d))
    _, q = C.qrel_corpus(p, q, x.select("doc_id", "lang"))
    q = q.join(topics(spark, d).select(F.col("tid").alias("query_id")), "query_id", "left_semi").select("query_id").distinct()
    return q.withColumn("n_passages", F.lit(p.count()).cast("long"))


@query(f", {_XML} SELECT 'T' || doc_id AS query_id, doc_id || '::' || xpath AS passage_id FROM xp WHERE text <> '' AND doc_id::INT IN (SELECT item_id FROM benchmark)", "fields")
def src15_demo_qrels(spark, d):
    t = topics(spark, d).select(F.col("tid").alias("query_id"), F.regexp_replace("tfile", r"\.xml$", "").alias("doc_id"))
    return C.passages_of(C.parse_xml(xml(spark, d))).join(t, "doc_id").select("query_id", "passage_id")


_SECTIONED = "s AS (SELECT vec_id, embedding, (vec_id % 3)::INT AS place FROM embeddings), o AS (SELECT *, row_number() OVER (PARTITION BY place ORDER BY vec_id) - 1 AS i, row_number() OVER (ORDER BY place, vec_id) - 1 AS row FROM s)"


def embedding_files(spark, d):
    """The vectors as a file a section, read back."""
    folder = f"{tables.shared_folder(spark)}/embedding-files-{uuid.uuid4().hex}"
    section = F.element_at(F.array(*(F.lit(x) for x in E.SECTIONS)), (F.col("vec_id") % 3 + 1).cast("int"))
    E.write_embeddings(table(spark, d, "embeddings").select(section.alias("section"), F.col("vec_id").alias("i"), F.col("embedding").alias("v")), folder, "org-m", "noun_chunk")
    return E.read_embeddings(spark, folder)


@query(f"WITH {_SECTIONED} SELECT 'org-m' AS model, 'noun_chunk' AS unit, ['abstract', 'claim', 'invention'][place + 1] AS section, place, i, row, round(embedding[1]::DOUBLE, 6) AS first, round(embedding[64]::DOUBLE, 6) AS last FROM o")
def src16_embedding_files(spark, d):
    at = lambda k: F.round(F.get("v", F.lit(k)).cast("double"), 6)
    return embedding_files(spark, d).select("model", "unit", "section", "place", "i", "row", at(0).alias("first"), at(63).alias("last"))


@query("SELECT vec_id AS center_id FROM embeddings WHERE vec_id % 10 = 0")
def src17_newest_centers(spark, d):
    """Of three tables of centers the newest of the model and unit asked for, which is not the last by name."""
    root = f"{tables.shared_folder(spark)}/found-{uuid.uuid4().hex}"
    for k, (name, step) in enumerate((("centers_m_noun_chunk_b", 20), ("centers_m_noun_chunk_a", 10), ("centers_m_spacy_token_a", 5))):
        centers(spark, d).filter(F.col("center_id") % step == 0).write.parquet(f"{root}/{name}")
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{name}")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).setTimes(path, 1_700_000_000_000 + 60_000 * k, -1)
    return spark.read.parquet(E.find_centers(spark, root, "m", "noun_chunk")).select("center_id")


_CACHE = "SELECT doc_id::VARCHAR AS d, i::VARCHAR AS s, count(*) AS n FROM (SELECT doc_id, i, unnest(string_split(line, ' ')) AS w FROM lines) WHERE w <> '' GROUP BY ALL"


@query(_CACHE, "lines")
def src18_snk1_span_cache(spark, d):
    from ..functions.spans import word_spans

    sp = F.transform(word_spans(F.col("line")), lambda x: F.array(x["start"].cast("string"), x["end"].cast("string"), x["text"]))
    path = f"{tables.shared_folder(spark)}/span-cache-{uuid.uuid4().hex}"
    C.write_span_cache(lines(spark, d).select(F.col("doc_id").cast("string").alias("d"), F.col("i").cast("string").alias("s"), F.lit("body").alias("p"), sp.alias("sp")), path)
    return C.read_span_cache(spark, path).filter(F.size("sp") > 0).select("d", "s", F.size("sp").cast("long").alias("n"))


@query(f"WITH {_SECTIONED} SELECT row, section, round(x, 6) AS first FROM (SELECT row, ['abstract', 'claim', 'invention'][place + 1] AS section, embedding[1]::DOUBLE AS x FROM o) WHERE row BETWEEN 100 AND 179 OR row IN (SELECT o_custkey FROM orders)")
def src19_rows_by_position(spark, d):
    """A chunk of rows that runs over a section's end, and single rows."""
    rows = embedding_files(spark, d)
    some = E.at_rows(rows, table(spark, d, "orders").select(F.col("o_custkey").alias("row"))).filter("row not between 100 and 179")
    return E.chunk(rows, 100, 180).unionByName(some.select(rows.columns)).select("row", "section", F.round(F.get("v", F.lit(0)).cast("double"), 6).alias("first"))


# ---- sinks and caches ----------------------------------------------------------------------------------


@query("SELECT label, count(*) AS n FROM embeddings GROUP BY 1")
def snk2_partitioned_embeddings(spark, d):
    path = f"{tables.shared_folder(spark)}/embeddings-{uuid.uuid4().hex}"
    table(spark, d, "embeddings").write.partitionBy("label").parquet(path)
    return spark.read.parquet(path).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT center_id, n_points, round(r_c, 6) AS r_c FROM radii", "unit near cells radii")
def snk3_center_table(spark, d):
    kept = tables.keep(centers(spark, d).join(radii(spark, d), "center_id"), "centers")
    return kept.select("center_id", "n_points", F.round("r_c", 6).alias("r_c"))


@query("SELECT passage_id, text FROM passages", PASS)
def snk4_passages(spark, d):
    return tables.keep(passages(spark, d).select("passage_id", "text"), "passages")


@query(_F, "fields")
def snk5_corpus_snapshot(spark, d):
    back = C.to_jsonl(C.parse_jsonl(jsonl(spark, d), entities=False)).withColumn("seq", F.lit(0).cast("long"))
    return C.parse_jsonl(back, entities=False)


@query("SELECT 1 AS builds, count(*) AS n FROM passages", PASS)
def snk6_cache_by_parameters(spark, d):
    folder, built = f"{tables.shared_folder(spark)}/cache-{uuid.uuid4().hex}", []

    def build():
        built.append(1)
        return passages(spark, d)

    for _ in range(2):
        out = tables.cached(spark, folder, "passages", build, table="documents", alpha=2.0)
    return out.agg(F.lit(len(built)).alias("builds"), F.count(F.lit(1)).alias("n"))


@query("SELECT span_id, rank, center_id FROM top WHERE rank <= 3", "unit near")
def snk7_cached_top(spark, d):
    folder = f"{tables.shared_folder(spark)}/top-{uuid.uuid4().hex}"
    for k in (8, 3):
        out = tables.cached_top(spark, folder, "top", k, lambda n: top(spark, d, n), table="embeddings")
    return out.select("span_id", "rank", "center_id")


@query("SELECT substr(sha1(string_agg(text || chr(0), '' ORDER BY item_id)), 1, 16) AS signature FROM benchmark")
def snk8_text_signature(spark, d):
    return tables.text_signature(table(spark, d, "benchmark"), "item_id", "text")


_NAMES = "SELECT 'recall@' || (label * 50) AS metric, count(*) AS value FROM embeddings GROUP BY 1"


@query(f"SELECT metric, value, row_number() OVER (ORDER BY base, k)::INT AS place FROM (SELECT *, split_part(metric, '@', 1) AS base, coalesce(try_cast(split_part(metric, '@', 2) AS INT), 0) AS k FROM ({_NAMES} UNION ALL SELECT 'map', 1))")
def snk9_metric_order(spark, d):
    m = table(spark, d, "embeddings").groupBy(F.concat(F.lit("recall@"), (F.col("label") * 50).cast("string")).alias("metric")).agg(F.count(F.lit(1)).alias("value"))
    return metrics.in_order(m.unionByName(spark.createDataFrame([("map", 1)], "metric string, value long")))


@query("SELECT item_id || chr(9) || replace(replace(text, chr(9), ' '), chr(10), ' ') AS row FROM benchmark")
def snk10_tab_separated(spark, d):
    path = f"{tables.shared_folder(spark)}/collection-{uuid.uuid4().hex}"
    table(spark, d, "benchmark").select(F.concat(F.col("item_id").cast("string"), F.lit("\t"), F.translate("text", "\t\n", "  "))).write.text(path)
    return spark.read.text(path).select(F.col("value").alias("row"))


@query("SELECT vec_id, 64 AS dimension FROM embeddings")
def snk11_encoding_cache(spark, d):
    folder = f"{tables.shared_folder(spark)}/enc-{uuid.uuid4().hex}"
    return tables.cached(spark, folder, "dense", lambda: table(spark, d, "embeddings"), model="m", pooling="mean").select("vec_id", F.size("embedding").alias("dimension"))


# ---- samples -------------------------------------------------------------------------------------------

#: sizes of the three strata, then rows within each by the order of their draw
_STRATA = "e AS (SELECT vec_id, (vec_id % 7 % 3)::INT AS s FROM embeddings), z AS (SELECT count(*) FILTER (s = 0) AS a, count(*) FILTER (s = 1) AS b, count(*) FILTER (s = 2) AS c, count(*) AS n FROM e), drawn AS (SELECT vec_id, s, row_number() OVER (PARTITION BY s ORDER BY md5('42:' || vec_id), vec_id) AS r FROM e)"


def strata(spark, d):
    return table(spark, d, "embeddings").select("vec_id", (F.col("vec_id") % 7 % 3).cast("int").alias("s"))


def _budgeted(rule, total):
    def run(spark, d):
        e = strata(spark, d)
        return sampling.by_budget(e, "s", "vec_id", rule(dict(sorted(sampling.counts(e, "s").items())), total))

    return run


@query(f"WITH {_STRATA} SELECT vec_id, s FROM drawn, z WHERE r <= CASE s WHEN 0 THEN least(a, 30) WHEN 1 THEN least(b, 30) ELSE least(c, 30) END")
def sam1_equal_budgets(spark, d):
    return _budgeted(sampling.budgets_equal, 90)(spark, d)


@query(f"WITH {_STRATA}, q AS (SELECT least(a, greatest(1, 101 * a // n)) AS qa, least(b, greatest(1, 101 * b // n)) AS qb, least(c, greatest(1, 101 * c // n)) AS qc FROM z) SELECT vec_id, s FROM drawn, q WHERE r <= CASE s WHEN 0 THEN qa + (101 - qa - qb - qc) WHEN 1 THEN qb ELSE qc END")
def sam2_natural_budgets(spark, d):
    return _budgeted(sampling.budgets_natural, 101)(spark, d)


@query(f"WITH {_STRATA}, q AS (SELECT 101 * a // n AS qa, 101 * b // n AS qb, 101 * c // n AS qc FROM z) SELECT vec_id, s FROM drawn, q WHERE r <= CASE s WHEN 0 THEN qa + (101 - qa - qb - qc >= 1)::INT WHEN 1 THEN qb + (101 - qa - qb - qc >= 2)::INT ELSE qc END")
def sam3_year_caps(spark, d):
    return _budgeted(sampling.year_caps, 101)(spark, d)


@query("SELECT vec_id FROM embeddings ORDER BY md5('42:' || vec_id), vec_id LIMIT 50")
def sam4_uniform_sample(spark, d):
    return sampling.sample(table(spark, d, "embeddings").select("vec_id"), "vec_id", 50)


@query(f"WITH {_STRATA}, q AS (SELECT round_even(100 * a / n, 0)::INT AS qa, round_even(100 * b / n, 0)::INT AS qb, round_even(100 * c / n, 0)::INT AS qc FROM z) SELECT vec_id, s FROM drawn, q WHERE r <= CASE s WHEN 0 THEN qa - greatest(0, qa + qb + qc - 100) WHEN 1 THEN qb ELSE qc END")
def sam5_stratified(spark, d):
    return _budgeted(sampling.budgets_rounded, 100)(spark, d)


@query(f"WITH {_STRATA} SELECT vec_id, s FROM drawn WHERE r <= 20")
def sam6_equal_caps(spark, d):
    return sampling.cap_per_group(strata(spark, d), ["s"], "vec_id", 20)


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT item_id FROM benchmark) ORDER BY md5('42:' || doc_id), doc_id LIMIT 40")
def sam7_other_documents(spark, d):
    docs = table(spark, d, "documents").select("doc_id")
    rest = docs.join(table(spark, d, "benchmark").select(F.col("item_id").alias("doc_id")), "doc_id", "left_anti")
    return sampling.sample(rest, "doc_id", 40)


def ipc_index(spark, d):
    """Synthetic headers' codes: a document's subgroup follows its id, its subclass is one of four."""
    n = F.col("doc_id")
    head = F.concat(F.lit("<main-classification>H0"), n % 4, F.lit("L "), n % 20, F.lit("/"), n % 5, F.lit("</main-classification>"))
    return table(spark, d, "documents").select("doc_id", "lang", T.ipc_codes(F.substring(head, 1, 4096)).alias("c")).select("doc_id", "lang", "c.sc", "c.sg")


_IPC = "ipc AS (SELECT doc_id, lang, 'H0' || (doc_id % 4) || 'L' AS sc, 'H0' || (doc_id % 4) || 'L' || (doc_id % 20) || '/' || (doc_id % 5) AS sg FROM documents), tgt AS (SELECT sc, sg FROM ipc WHERE doc_id IN (0, 1)), tier AS (SELECT doc_id, CASE WHEN sg IN (SELECT sg FROM tgt) THEN 'subgroup' WHEN sc IN (SELECT sc FROM tgt) THEN 'subclass' ELSE 'easy' END AS tier FROM ipc WHERE doc_id > 1), trank AS (SELECT doc_id, tier, row_number() OVER (PARTITION BY tier ORDER BY md5('42:' || doc_id), doc_id) AS r, count(*) FILTER (tier = 'subgroup') OVER () AS ns, count(*) FILTER (tier = 'subclass') OVER () AS nc FROM tier)"


@query(f"WITH {_IPC} SELECT doc_id, tier FROM trank WHERE r <= CASE tier WHEN 'subgroup' THEN least(37, ns) WHEN 'subclass' THEN least(75 - least(37, ns), nc) ELSE 100 - least(37, ns) - least(75 - least(37, ns), nc) END")
def sam8_hard_negatives(spark, d):
    x = ipc_index(spark, d)
    goal = x.filter("doc_id in (0, 1)").agg(F.array_distinct(F.flatten(F.collect_list("sc"))).alias("sc"), F.array_distinct(F.flatten(F.collect_list("sg"))).alias("sg"))
    return sampling.hard_negatives(x.filter("doc_id > 1"), goal, 100)


@query(f"WITH {_IPC} SELECT doc_id, sc, sg FROM ipc WHERE lang = 'en'")
def sam9_ipc_index(spark, d):
    return ipc_index(spark, d).filter("lang = 'en'").select("doc_id", F.array_join("sc", ",").alias("sc"), F.array_join("sg", ",").alias("sg"))


@query(f"WITH {_IPC} SELECT DISTINCT sg FROM ipc WHERE doc_id IN (SELECT item_id FROM benchmark)")
def sam10_target_codes(spark, d):
    b = table(spark, d, "benchmark").select(F.col("item_id").alias("doc_id"))
    return ipc_index(spark, d).join(b, "doc_id", "left_semi").select(F.explode("sg").alias("sg")).distinct()


_QP = "SELECT passage_id, doc_id FROM passages WHERE doc_id::INT IN (SELECT item_id FROM benchmark)"


@query(f"SELECT '-1' AS mode, count(*) AS n FROM ({_QP}) WHERE passage_id LIKE '%/abstract%' UNION ALL SELECT '-2', count(*) FROM ({_QP}) UNION ALL SELECT '0', count(*) FROM passages UNION ALL SELECT '20', (SELECT count(*) FROM ({_QP})) + (SELECT count(*) FROM passages WHERE doc_id IN (SELECT doc_id::VARCHAR FROM (SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT item_id FROM benchmark) ORDER BY md5('42:' || doc_id), doc_id LIMIT 20)))", PASS)
def sam11_corpus_modes(spark, d):
    p = passages(spark, d)
    cited = p.join(table(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("doc_id")), "doc_id", "left_semi")
    more = p.join(sam7_other_documents(spark, d).orderBy(sampling.draw(F.col("doc_id")), "doc_id").limit(20).select(F.col("doc_id").cast("string").alias("doc_id")), "doc_id", "left_semi")
    modes = {"-1": cited.filter(F.contains("passage_id", F.lit("/abstract"))), "-2": cited, "0": p, "20": cited.unionByName(more)}
    from functools import reduce

    return reduce(lambda a, b: a.unionByName(b), (x.agg(F.lit(m).alias("mode"), F.count(F.lit(1)).alias("n")) for m, x in modes.items()))


@query("SELECT k::INT AS pool, count(*) AS n FROM (SELECT 50 AS k UNION ALL SELECT 100), LATERAL (SELECT item_id FROM benchmark UNION ALL (SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY md5((42 + k) || ':' || doc_id), doc_id) AS r FROM documents WHERE doc_id NOT IN (SELECT item_id FROM benchmark)) WHERE r <= k - (SELECT count(*) FROM benchmark))) GROUP BY 1".replace(", LATERAL (", " p, LATERAL ("))
def sam12_growing_pools(spark, d):
    docs, b = table(spark, d, "documents").select("doc_id"), table(spark, d, "benchmark").select(F.col("item_id").alias("doc_id"))
    rest, n = docs.join(b, "doc_id", "left_anti"), b.count()
    out = None
    for k in (50, 100):
        pool = b.unionByName(sampling.sample(rest, "doc_id", max(0, k - n), 42 + k)).agg(F.lit(k).alias("pool"), F.count(F.lit(1)).alias("n"))
        out = pool if out is None else out.unionByName(pool)
    return out


@query("SELECT item_id FROM benchmark JOIN documents ON doc_id = item_id WHERE lang = 'en'")
def sam13_language_filter(spark, d):
    return table(spark, d, "benchmark").join(table(spark, d, "documents").filter("lang = 'en'").select(F.col("doc_id").alias("item_id")), "item_id", "left_semi").select("item_id")


@query("SELECT doc_id FROM documents ORDER BY doc_id LIMIT 25")
def sam14_first_documents(spark, d):
    return table(spark, d, "documents").select("doc_id").orderBy("doc_id").limit(25)


@query("SELECT item_id, row_number() OVER (ORDER BY item_id)::INT AS place FROM benchmark WHERE item_id IN (SELECT doc_id FROM documents WHERE lang <> 'fr')")
def sam15_query_subset(spark, d):
    b = table(spark, d, "benchmark").select("item_id").join(table(spark, d, "documents").filter("lang <> 'fr'").select(F.col("doc_id").alias("item_id")), "item_id", "left_semi")
    return tables.numbered(b, "place", "item_id").select("item_id", (F.col("place") + 1).cast("int").alias("place"))


# ---- span job ------------------------------------------------------------------------------------------


def texts(spark, d, most=3000):
    """3,000 characters are the span cache's default; the embedding path reads 32,768."""
    return section_texts(fields(spark, d), most)


@query()
def spn2_spans(spark, d):
    return encoding.spans_of(texts(spark, d))


@query()
def spn3_phrases(spark, d):
    return encoding.spans_of(texts(spark, d), "noun_chunk")


@query("SELECT vec_id // 5 AS span_id, j, round(m / sqrt(sum(m * m) OVER (PARTITION BY vec_id // 5)), 6) AS x FROM (SELECT vec_id // 5 * 5 AS vec_id, j, avg(x) AS m FROM (SELECT vec_id, unnest(v) AS x, unnest(range(len(v)))::INT AS j FROM unit) GROUP BY ALL)", "unit")
def spn13_span_pooling(spark, d):
    from ..operators.vectors import unit

    t = vectors(spark, d).select(F.expr("span_id div 5").alias("doc_id"), F.expr("span_id % 5").alias("k"), unit(F.col("v")).alias("v"))
    s = t.select("doc_id", F.col("doc_id").alias("span_id"), F.lit(0).alias("first"), F.lit(5).alias("last")).distinct()
    return encoding.pool(t, s).select("span_id", F.posexplode("v").alias("j", "x")).select("span_id", "j", F.round("x", 6).alias("x"))


@query()
def spn14_cached_span_embeddings(spark, d):
    return encoding.embed_grouped(tables.keep(encoding.grouped_spans(texts(spark, d), "noun_chunk"), "spans"))


@query()
def spn15_span_embeddings(spark, d):
    return encoding.embed_texts(texts(spark, d, 32768), "encoder_token")


@query()
def spn18_embedding_job(spark, d):
    return encoding.embed_corpus(texts(spark, d, 32768), most=5_000_000)


@query()
def spn19_query_spans(spark, d):
    q = table(spark, d, "benchmark").select(F.col("item_id").alias("doc_id"), F.posexplode(T.sentence_chunks(F.col("text"), 64)).alias("chunk", "text"))
    q = q.select(F.concat_ws("/", "doc_id", "chunk").alias("doc_id"), F.lit("claim").alias("section"), "text")
    return encoding.embed_texts(q, "encoder_token")


@query()
def spn20_passage_spans(spark, d):
    p = passages(spark, d)
    section = F.when(T.section_of(F.col("passage_id")) == "description", "invention").otherwise(T.section_of(F.col("passage_id")))
    t = p.select(F.col("passage_id").alias("doc_id"), section.alias("section"), "text")
    return encoding.embed_texts(t, "noun_chunk")


@query()
def vec16_encoder_registry(spark, d):
    return encoding.encode(table(spark, d, "benchmark").select("item_id", "text"), dimension=16).drop("text")
