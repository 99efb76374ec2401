"""Every registered query against its SQL, on the smallest tables."""

import decimal
import hashlib
import math
import re

import duckdb
import numpy as np
import pytest

from spanloom.plans import q_sources, q_text, q_vectors  # noqa: F401
from spanloom.plans.registry import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, float | decimal.Decimal):
        return "nan" if math.isnan(v) else round(float(v), 5) + 0.0
    return tuple(map(plain, v)) if isinstance(v, list | tuple) else v


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    names = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr)
    result = duck.execute(ORACLES[name])
    have = [d[0] for d in result.description]
    assert sorted(have) == names
    assert got == sorted((tuple(plain(r[have.index(c)]) for c in names) for r in result.fetchall()), key=repr)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - {"spn14_cached_span_embeddings"}))
def test_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_embedding_job_takes_whole_sections(spark, sf):
    """Spans beyond character 3,000, more than 25 a section and 2,000 in all."""
    got = QUERIES["spn18_embedding_job"](spark, sf).groupBy("doc_id", "section").agg({"*": "count", "start": "max"}).collect()
    assert sum(r["count(1)"] for r in got) > 2000 and max(r["count(1)"] for r in got) > 25 and max(r["max(start)"] for r in got) > 3000
    assert QUERIES["spn15_span_embeddings"](spark, sf).agg({"start": "max"}).first()[0] > 3000


def test_budgets_of_the_embedding_job(spark, sf):
    from spanloom.operators import encoding

    texts = q_sources.texts(spark, sf).filter("doc_id < 20")
    got = encoding.embed_corpus(texts, per_section=5).groupBy("doc_id", "section").count().agg({"count": "max"}).first()[0]
    assert got == 5 and encoding.embed_corpus(texts, most=30).count() == 30


def hashed(word):
    raw = np.frombuffer(hashlib.shake_128(word.encode()).digest(64), "<u2").astype(float) / 65535 - 0.5
    return raw / np.linalg.norm(raw)


@pytest.mark.parametrize(("name", "most"), [("spn14_cached_span_embeddings", 3000), ("spn15_span_embeddings", 32768)])
def test_span_embeddings_pool_tokens_in_context(spark, sf, name, most):
    """Every row of twenty documents: the span's text at its place, and the mean of its tokens' vectors."""
    full = {(r["doc_id"], r["section"]): r["text"] for r in q_sources.texts(spark, sf, most).filter("doc_id < 20").collect()}
    got, seen = QUERIES[name](spark, sf).filter("doc_id < 20").collect(), {}
    assert got
    for r in got:
        text = full[r["doc_id"], r["section"]]
        assert text[r["start"] : r["end"]] == r["text"]
        if (r["doc_id"], r["section"]) not in seen:
            tokens = [m.span() for m in re.finditer("[^ ]+", text)]
            own = [hashed(text[a:b]) for a, b in tokens]
            mixed = [v + (own[k - 1] / 2 if k else 0) + (own[k + 1] / 2 if k + 1 < len(own) else 0) for k, v in enumerate(own)]
            seen[r["doc_id"], r["section"]] = tokens, mixed
        tokens, mixed = seen[r["doc_id"], r["section"]]
        first = next(k for k, (a, b) in enumerate(tokens) if a <= r["start"] < b)
        last = next((k for k, (a, b) in enumerate(tokens) if k >= first and a < r["end"] <= b), first)
        want = np.mean(mixed[first : last + 1], 0)
        assert np.allclose(r["embedding"], want / np.linalg.norm(want), atol=1e-5)


def test_visible_tokens_only(spark):
    from spanloom.operators import encoding

    texts = spark.createDataFrame([(1, "claim", "a bb ccc dddd"), (2, "claim", "")], "doc_id long, section string, text string")
    spans = spark.createDataFrame([(1, "claim", 0, 4, "a bb"), (1, "claim", 5, 8, "ccc"), (1, "claim", 9, 13, "dddd"), (1, "claim", 1, 4, " bb"), (2, "claim", 0, 1, "x")], "doc_id long, section string, start int, end int, text string")
    read = lambda **o: {r["text"] for r in encoding.embed_spans(spans, texts, **o).collect()}
    assert read() == {"a bb", "ccc", "dddd"} and read(most_tokens=2, how="max") == {"a bb"}



def small(tmp_path, spark, *texts):
    """A folder of tables whose `documents` hold these texts, and what DuckDB reads of it."""
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    return str(tmp_path), con


def test_claims_beyond_the_thousandth(spark, tmp_path):
    d, con = small(tmp_path, spark, "\n".join(["x"] * 1100))
    got = QUERIES["txt12_claim_references"](spark, d).select("doc_id", "i", "out").collect()
    assert sorted(map(tuple, got)) == sorted(con.execute(ORACLES["txt12_claim_references"]).fetchall())


def test_sections_of_blank_titles_and_abstracts(spark, tmp_path):
    from spanloom.functions import text as T

    d, con = small(tmp_path, spark, "", " \n \nclaim", "title", "\nabstract")
    f = q_text.F
    got = QUERIES["txt19_formatted_sections"](spark, d).select("doc_id", "a", "c", "p", "i").collect()
    assert sorted(map(tuple, got)) == sorted(con.execute(ORACLES["txt19_formatted_sections"]).fetchall())
    assert spark.range(1).select(T.format_section(f.lit("abstract"), f.lit("no_section_markers"), f.lit(" "), f.lit(None))).first()[0] == ""


def test_spans_stay_beside_their_text(spark, sf):
    """A text went along with each of its words, and spans and texts were shuffled: the disk held its square."""
    from spanloom.operators import encoding

    texts = q_sources.texts(spark, sf, 32768)
    for rows in (encoding.spans_of(texts), encoding.embed_texts(texts, "encoder_token"), encoding.embed_texts(texts, "noun_chunk")):
        plan = rows._jdf.queryExecution().optimizedPlan().toString()
        assert not any(x in plan for x in ("Window", "Join", "Aggregate")) and plan.count("Repartition") == 1


@pytest.mark.parametrize("most", [1, 50, 301])
def test_budget_takes_the_first_drawn(spark, sf, most):
    from spanloom.operators import encoding, sampling

    f, texts = q_text.F, q_sources.texts(spark, sf)
    rows = encoding.spans_of(texts).withColumn("key", f.concat_ws("/", "doc_id", "section", "start", "end"))
    want = sampling.by_budget(rows, "section", "key", sampling.budgets_equal(dict(sorted(sampling.counts(rows, "section").items())), most))
    key = lambda df: sorted(tuple(r) for r in df.select("doc_id", "section", "start", "end", "text").collect())
    assert len(key(want)) == most and key(encoding.embed_corpus(texts, most=most)) == key(want)
