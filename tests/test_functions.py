"""Scalar cases and properties of text, span, sampling and vector operators."""

import pytest
from pyspark.sql import functions as F

from spanloom.functions import spans as P
from spanloom.functions import text as T
from spanloom.operators import encoding, metrics, sampling, tables
from spanloom.operators import vectors as V


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(("given", "want"), [("(AVS", ("AVS", 1, 0)), ("foo)", ("foo", 0, 1)), ("(AVS)", ("(AVS)", 0, 0)), ("(AVS) bar", ("(AVS) bar", 0, 0)), ("(foo (bar)", ("foo (bar)", 1, 0)), ("", ("", 0, 0)), ("((a)))", ("((a))", 0, 1))])
def test_parentheses(spark, given, want):
    assert tuple(one(spark, given, T.trim_parentheses)) == want


@pytest.mark.parametrize(("given", "want"), [("word1;word2", "word1 ; word2"), ("a;b;c", "a ; b ; c"), ("a; b", "a; b"), (";", ";")])
def test_semicolons(spark, given, want):
    assert one(spark, given, T.space_semicolons) == want


@pytest.mark.parametrize(("given", "want"), [("a part (10a, II) of", "a part of"), ("x [10; 20] y", "x y"), ("2) A  device", "A device"), ("(mild) x", "x"), ("(note) x", "(note) x")])
def test_reference_numerals(spark, given, want):
    assert one(spark, given, T.drop_reference_numerals) == want


@pytest.mark.parametrize(("given", "want"), [("The H.264 codec", "h.264 codec"), ("C++", "c+"), ("a Wi-Fi", "wi-fi"), ("the this", ""), ("3.5GHz!", "3.5ghz"), (" any (thing) those ", "thing")])
def test_canonical(spark, given, want):
    assert one(spark, given, T.canonical) == want


@pytest.mark.parametrize(("given", "want"), [("x" + " the an" * 20_000, "x"), ("the any " * 20_000 + "y", "y"), ("x" + " a this" * 20_000 + " y", "x" + " a this" * 20_000 + " y"), ("thesis an any-a an", "thesis an any-a")])
def test_canonical_of_long_runs(spark, given, want):
    """A greedy group recursed once a word, and the stack's end took the executor with it."""
    assert one(spark, given, T.canonical) == want


def test_long_lists_and_runs(spark):
    numbers = ", ".join(map(str, range(1, 20_001)))
    assert one(spark, f"a ({numbers}) b", T.drop_reference_numerals) == "a b"
    assert one(spark, f"claims {numbers}", lambda x: F.size(T.claim_references(x, F.lit(30_000), F.lit(30_000)))) == 20_000
    assert one(spark, "FIELD " * 20_000 + "of", T.strip_capitals)["text"] == "of"
    assert one(spark, "x" + " " * 50_000 + "y ", T.strip) == "x" + " " * 50_000 + "y"
    assert one(spark, "fig. " + "2 " * 20_000, lambda x: P.is_good_span(x, F.lit("claim"))) is False


def test_entities(spark):
    assert one(spark, "a &amp;amp; b &lt;i&gt;", T.decode_entities) == "a & b <i>" and one(spark, None, T.decode_entities) is None


@pytest.mark.parametrize(("text", "n", "want"), [("of claim 1", 3, [1]), ("claims 1, 2 or 3", 5, [1, 2, 3]), ("claims 2 to 5", 9, [2, 3, 4, 5]), ("any one of the preceding claims", 4, [1, 2, 3]), ("claim 3", 3, []), ("", 2, [])])
def test_claim_references(spark, text, n, want):
    assert one(spark, text, lambda x: T.claim_references(x, F.lit(n), F.lit(100))) == want


@pytest.mark.parametrize(("span", "section", "alone", "want"), [("phase shift keying", "claim", False, True), ("device", "claim", False, False), ("device", "claim", True, True), ("DNA", "claim", False, True), ("R1", "claim", False, False), ("the present invention", "claim", False, False), ("[claim] 1.", "claim", False, False), ("5,782,762", "claim", True, False), ("Smith et al", "invention", False, False), ("Smith et al", "claim", False, True), ("FIG. 3", "claim", False, False), ("of the in a", "claim", True, False), ("H-bridge", "claim", False, True)])
def test_quality_filter(spark, span, section, alone, want):
    assert one(spark, span, lambda x: P.is_good_span(x, F.lit(section), alone)) is want


def test_spans_keep_offsets(spark):
    text = "A phase shifter, comprising the signal path (AB and a DNA probe. As in U.S. Pat. see Smith et al. with red lamp."
    rows = encoding.spans_of(spark.createDataFrame([("d", "invention", text), ("e", "invention", ""), ("f", "claim", None)], "doc_id string, section string, text string")).collect()
    assert rows and all(text[r["start"] : r["end"]] == r["text"] for r in rows) and not any("Smith" in r["text"] for r in rows)


def test_budgets():
    sizes = {"a": 10, "b": 3, "c": 100}
    assert sampling.budgets_equal(sizes, 50) == {"a": 10, "b": 3, "c": 37} and sum(sampling.budgets_equal(sizes, 7).values()) == 7
    assert sampling.budgets_natural(sizes, 20) == {"a": 1, "b": 1, "c": 18} and sampling.budgets_rounded({"a": 5, "b": 5}, 5) == {"a": 2, "b": 2}
    assert sampling.year_caps({1: 5, 2: 5, 3: 5}, 7) == {1: 3, 2: 2, 3: 2}


def test_farthest_first_falls(spark):
    import numpy as np

    x = np.random.default_rng(0).normal(size=(120, 8))
    df = spark.createDataFrame([(k, [float(a) for a in v]) for k, v in enumerate(x)], "span_id long, v array<double>")
    got = [r["span_id"] for r in V.farthest_first(df, 20).orderBy("position").collect()]
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    steps = [min(1 - u[got[k]] @ u[j] for j in got[:k]) for k in range(1, 20)]
    assert len(set(got)) == 20 and all(a >= b - 1e-6 for a, b in zip(steps, steps[1:]))
    assert [r["span_id"] for r in V.farthest_first(df, 4, pool_bytes=0).orderBy("position").collect()] == got[:4]
    with pytest.raises(ValueError):
        V.farthest_first(df, 121)


def test_slices_of_centers_agree(spark, monkeypatch):
    rows = [(k, [float(k % 7), float(k % 5), 1.0]) for k in range(60)]
    df = spark.createDataFrame(rows, "span_id long, v array<double>")
    centers = df.limit(20).select(F.col("span_id").alias("center_id"), F.col("v").alias("center"))
    key = lambda d: sorted(map(tuple, d.collect()))
    whole = key(V.top_centers(df, centers, 5))
    monkeypatch.setattr(V, "MAX_BROADCAST", 64)
    assert key(V.top_centers(df, centers, 5)) == whole and len(whole) == 300


def test_radius_of_everything_covers_all(spark):
    cells = spark.createDataFrame([(1, 0.1), (1, 0.5), (2, 0.0)], "center_id long, dist double")
    assert {(r["center_id"], r["r_c"], r["covered"]) for r in V.radii(cells, 100).collect()} == {(1, 0.5, 2), (2, 0.0, 1)}


def test_metrics_of_perfect_and_empty_rankings(spark):
    truth = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "query_id long, item string")
    full = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "c", 1)], "query_id long, item string, rank int")
    for ranking, want in ((full, 1.0), (full.limit(0), 0.0)):
        got = [metrics.recall(ranking, truth, 10, "r"), metrics.ndcg(ranking, truth, 10, "n"), metrics.average_precision(ranking, truth, "a"), metrics.reciprocal_rank(ranking, truth, "m"), metrics.pres(ranking, truth, 100, "p")]
        assert [m.first()["value"] for m in got] == [want] * 5


def test_signatures():
    assert tables.signature(a=1, b=[2]) == tables.signature(b=[2], a=1) != tables.signature(a=1, b=[3])


def test_entry_without_training_data_queries(monkeypatch):
    import importlib
    import sys

    monkeypatch.setitem(sys.modules, "spanloom.llm.queries", None)
    sys.modules.pop("__spark_entry__", None)
    import __spark_entry__ as e

    e = importlib.reload(e)
    assert "scr1_sparse_scores" in e.queries() and not any(n.startswith("op") or n == "pipeline" for n in e.queries())
    sys.modules.pop("__spark_entry__", None)


def test_stems():
    """Pairs from the published description of the algorithm."""
    from spanloom.functions.stem import stem

    pairs = "consigned consign, consistency consist, consolations consol, consolatory consolatori, conspicuous conspicu, conspirators conspir, knackeries knackeri, knaves knave, knavish knavish, kneaded knead, generate generat, generally general, happy happi, hopping hop, hoping hope, relational relat, skies sky, news news, proceed proceed, ties tie, cries cri, gas gas, gaps gap, by by, say say, cry cri, controlling control, communication communic, feed feed, agreed agre, luxuriating luxuri, adjustment adjust, adoption adopt, roll roll"
    assert {w: stem(w) for w, _ in map(str.split, pairs.split(","))} == dict(map(str.split, pairs.split(",")))


def test_stemmed_bm25(spark):
    import math
    import re
    from collections import Counter

    from spanloom.functions.stem import STOP, analysed_terms, stem
    from spanloom.operators.scoring import bm25

    queries = [(1, "Consigned knots, and the KNIGHTS"), (2, ""), (3, None)]
    passages = [(10, "A knight consigns a knot."), (11, "knots knots knots of this"), (12, "nothing here"), (13, None)]
    frames = [spark.createDataFrame(rows, "id long, text string") for rows in (queries, passages)]
    got = {(r["query_id"], r["passage_id"]): r["score"] for r in bm25(analysed_terms(frames[0], "id", "query_id"), analysed_terms(frames[1], "id", "passage_id")).collect()}
    terms = lambda t: [stem(w) for w in re.findall("[a-z0-9]+", (t or "").lower()) if w not in STOP]
    held = {p: Counter(terms(t)) for p, t in passages if terms(t)}
    mean, want = sum(map(Counter.total, held.values())) / len(held), {}
    for q, text in queries:
        for p, tf in held.items():
            score = sum(math.log1p((len(held) - df + 0.5) / (df + 0.5)) * tf[w] / (tf[w] + 1.5 * (0.25 + 0.75 * tf.total() / mean)) for w in terms(text) if tf[w] for df in [sum(w in t for t in held.values())])
            if score:
                want[q, p] = round(score, 6)
    assert got == pytest.approx(want)


def test_unusable_vectors_take_no_part(spark):
    from spanloom.operators import vectors as V

    rows = [(0, [1.0, 0.0, 0.0, 0.0]), (1, [0.0, 1.0, 0.0, 0.0]), (2, None), (3, [0.0, 0.0, 1.0, 0.0]), (4, [0.5, 0.5]), (5, [None, 1.0, 0.0, 0.0]), (6, [float("nan"), 1.0, 0.0, 0.0]), (7, [0.0, 0.9, 0.1, 0.0])]
    spans = spark.createDataFrame(rows, "span_id long, v array<double>")
    centers = spans.filter("span_id < 4").selectExpr("span_id as center_id", "v as center")
    assert {(r["span_id"], r["center_id"]) for r in V.top_centers(spans, centers, 1).collect()} == {(0, 0), (1, 1), (3, 3), (7, 1)}
    assert sorted(r["span_id"] for r in V.farthest_first(spans, 4).collect()) == [0, 1, 3, 7]


@pytest.mark.parametrize(("batch", "room"), [(1, 64), (1, 1 << 20), (3, 1 << 10), (3, 1 << 20)])
def test_farthest_first_whatever_the_candidates(spark, batch, room):
    """Few candidates a round, or all points at once, choose the centers of the plain traversal."""
    import hashlib

    import numpy as np

    from spanloom.operators import vectors as V

    x = np.random.default_rng(4).normal(size=(80, 6))
    got = [r["span_id"] for r in V.farthest_first(spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "span_id long, v array<double>"), 20, batch, room).orderBy("position").collect()]
    x /= np.linalg.norm(x, axis=1)[:, None]
    chosen = [min(range(80), key=lambda k: hashlib.md5(str(k).encode()).hexdigest())]
    far = np.round(1 - x @ x[chosen[0]], 6)
    while len(chosen) < 20:
        far[chosen] = -1
        new = sorted(range(80), key=lambda k: (-far[k], k))[: min(batch, 20 - len(chosen))]
        chosen += new
        far = np.minimum(far, np.round(1 - x @ x[new].T, 6).min(1))
    assert got == chosen


def test_lines_are_numbered_through_files(spark, tmp_path):
    from spanloom.sources import corpora as C

    for name, lines in (("b.txt", ['{"dnum": "7", "Content": {"title": "x"}}', "", '{"title": "y"}']), ("a.txt", ['{"title": "z"}', "{broken"])):
        (tmp_path / name).write_text("\n".join(lines) + "\n")
    assert [r["seq"] for r in C.read_lines(spark, str(tmp_path)).orderBy("seq").collect()] == [0, 1, 2, 3, 4]
    assert {(r["doc_id"], r["title"]) for r in C.read_jsonl(spark, str(tmp_path)).collect()} == {("doc_0", "z"), ("7", "x"), ("doc_4", "y")}


def test_epo_years_and_embedding_files(spark, tmp_path):
    import numpy as np

    from spanloom.sources import corpora as C
    from spanloom.sources import embeddings as E

    for year in (1999, 2001, 2005):
        (tmp_path / "t" / str(year)).mkdir(parents=True)
        (tmp_path / "t" / str(year) / f"d{year}.txt").write_text(f"TITLE ::: t\nABSTR ::: a\nb {year}\n")
    read = lambda *years: {r["doc_id"]: r["abstract"] for r in C.read_epo(spark, str(tmp_path / "t"), *years).collect()}
    assert read(2000) == {"d2001": "a\nb 2001", "d2005": "a\nb 2005"} and read(None, 1999) == {"d1999": "a\nb 1999"} and read(2010, 2011) == {} and len(read()) == 3
    folder = tmp_path / "e" / "m_noun_chunk"
    folder.mkdir(parents=True)
    x = np.arange(12, dtype=np.float16).reshape(4, 3)
    np.save(folder / "claim_noun_chunk.npy", x)
    np.savez(folder / "claim_noun_chunk.npz", x=x * 0)
    np.savez(folder / "abstract_noun_chunk.npz", x=x[:2].astype(np.float32))
    got = [(r["section"], r["i"], r["row"], r["v"]) for r in E.read_embeddings(spark, str(tmp_path / "e")).orderBy("row").collect()]
    assert got == [("abstract", k, k, x[k].tolist()) for k in range(2)] + [("claim", k, k + 2, x[k].tolist()) for k in range(4)]



@pytest.mark.parametrize("k", [1, 3, 16, 60])
def test_top_rows_by_tiles(monkeypatch, k):
    """As a full sort, with many ties and tiles smaller than the table; no product is larger than a tile."""
    import numpy as np

    monkeypatch.setattr(V, "TILE", 16)
    rng = np.random.default_rng(2)
    x, c = (V._unit_rows(rng.integers(-1, 2, (n, 4)).astype(float)) for n in (40, 50))
    sim = np.round(x @ c.T, 6)
    want = np.argsort(-sim, 1, kind="stable")[:, :k]
    row, place, got = V._best(x, c, k)
    assert (row == np.repeat(np.arange(40), want.shape[1])).all() and (place == want.ravel()).all() and (got == np.take_along_axis(sim, want, 1).ravel()).all()


def test_memory_of_top_centers():
    """A task's arrays do not grow with the number of centers: 512 spans against 60,000 took 250 MB a product."""
    import tracemalloc

    import numpy as np

    rng = np.random.default_rng(2)
    x, c = (V._unit_rows(rng.normal(size=(n, 4))) for n in (V.ROWS, 60_000))
    tracemalloc.start()
    V._best(x, c, 16)
    assert tracemalloc.get_traced_memory()[1] < 64 << 20
    tracemalloc.stop()


def test_similarities_are_all_pairs(spark):
    spans = spark.createDataFrame([(k, [1.0, float(k)]) for k in range(7)] + [(9, None)], "span_id long, v array<double>")
    centers = spark.createDataFrame([(k, [float(k), 1.0]) for k in range(5)], "center_id long, center array<double>")
    key = lambda rows: sorted((r["span_id"], r["center_id"], r["sim"]) for r in rows)
    assert key(V.similarities(spans, centers).collect()) == key(V.top_centers(spans, centers, 5).collect())
    assert V.similarities(spans, centers).count() == 35 and V.similarities(spans, centers.limit(0)).count() == 0


def test_refined_centers_add_whole_vectors(spark):
    """The mean of each cell's unit vectors; an empty cell stays; no vector is taken apart into a row a component."""
    import numpy as np

    rng = np.random.default_rng(5)
    x, cell = rng.normal(size=(1500, 6)), rng.integers(0, 700, 1500)
    spans = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)] + [(9999, None)], "span_id long, v array<double>").repartition(7)
    own = spark.createDataFrame([(k, int(c)) for k, c in enumerate(cell)], "span_id long, center_id long")
    centers = spark.createDataFrame([(k, [1.0] + [0.0] * 5) for k in range(701)], "center_id long, center array<double>")
    out = V.refine(spans, own, centers)
    assert "Generate" not in out._jdf.queryExecution().optimizedPlan().toString()
    got, u = {r["center_id"]: r["center"] for r in out.collect()}, V._unit_rows(x)
    assert len(got) == 701 and got[700] == [1.0, 0, 0, 0, 0, 0]
    for k in set(cell.tolist()):
        m = u[cell == k].mean(0)
        assert np.allclose(got[k], m / np.linalg.norm(m), atol=1e-12)
