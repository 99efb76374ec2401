import base64
import hashlib

import numpy as np

from spanloom.llm import ann, warc


def test_archives(spark):
    body = "<html>" + "x" * 200
    rows = [(1, "http://www.b.example.com/a?x=1", body), (2, "https://a.example.com:443/", body), (3, None, None), (4, "nonsense ü\n", ""), (5, "http://b.example.com/a?x=1", "ü" * 5000), (None, "http://c.org/", body), (5, "http://b.example.com/a?x=1", "ü" * 5000)]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, sha int")
    files = warc.archive(pages)
    got = warc.read_archives(warc.scan_index(files)).collect()
    raw = [(p, (h or "").encode()) for p, _, h in rows]
    last = {}
    for p, h in raw:
        last[h] = max(last.get(h, -1), -1 if p is None else p)
    want = sorted((-1 if p is None else p, len(h), base64.b32encode(hashlib.sha1(h).digest()).decode(), "response" if p == last[h] else "revisit", -1 if p == last[h] else last[h]) for p, h in raw)
    assert sorted((-1 if r["page_id"] is None else r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], -1 if r["refers_to"] is None else r["refers_to"]) for r in got) == want
    assert all(hashlib.sha1(r["payload"]).digest() == base64.b32decode(r["payload_digest"]) for r in got if r["record_type"] == "response")
    assert {c["page_id"] for c in warc.lookup(spark, files, "https://b.example.com/a?x=1")} == {1, 5} and warc.lookup(spark, files, "http://no.where/") == []
    by_key = lambda df: sorted(map(repr, df.collect()))
    assert by_key(warc.search_index(pages, files)) == by_key(warc.scan_index(files))
    assert warc.search_index(pages.limit(0), files).count() == 0 and warc.search_index(pages, warc.archive(pages.limit(0))).count() == 0
    assert warc.read_archives(warc.scan_index(warc.archive(pages.limit(0)))).count() == 0
    assert all(r["record_type"] == "response" for r in warc.read_archives(warc.scan_index(warc.archive(pages, least=10**6))).collect())


def test_blocks_and_directory(spark):
    from spanloom.llm.common import new_path

    pages = spark.createDataFrame([(k, f"http://h{k % 40}.example.org/p/{k}", f"t{k}") for k in range(700)], "page_id long, url string, html string")
    folder = new_path(spark, "t")
    files = warc.write_index(warc.write_archives(pages, folder), folder, lines=16)
    assert warc.scan_index(files).count() == 700
    assert sorted(r["page_id"] for r in warc.search_index(pages.filter("page_id % 7 = 0"), files).collect()) == list(range(0, 700, 7))
    for k in (0, 17, 699):
        assert [c["page_id"] for c in warc.lookup(spark, files, f"http://h{k % 40}.example.org/p/{k}")] == [k]


def test_surt():
    assert warc.surt("http://www.Example.COM:8080/A?b=C#d") == "com,example:8080)/a?b=C"
    assert warc.surt("https://x.org") == "org,x)/" and warc.surt(None) == "" and warc.surt("http://[bad") == "http://[bad"
    assert warc.surt("no host\there\nÜ") == "no%20host%09here%0Aü"


def exact(rows, every, top):
    fine = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and len(v) == 8 and None not in v and np.isfinite(np.array(v, float)).all() and np.any(v)]
    out = {}
    for q, x in fine:
        if q % every == 0:
            near = sorted(((-float((x * y).sum()), i) for i, y in fine if i != q))
            out[q] = [(i, -s) for s, i in near[:top]]
    return out


def test_neighbours(spark):
    rng = np.random.default_rng(4)
    rows = [(k, [float(x) for x in rng.normal(size=8) * (3 if k % 5 == 0 else 1)]) for k in range(600)]
    rows += [(600 + k, rows[20][1]) for k in range(40)]
    rows += [(700, None), (None, rows[0][1]), (720, [0.0] * 8), (740, [float("nan")] + [1.0] * 7), (760, [1.0, None] + [1.0] * 6), (780, [1.0] * 7), (800, [float("inf")] * 8)]
    got = ann.nearest(spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, score int"), 20, 20).collect()
    want, found = exact(rows, 20, 20), {}
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        found.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert found.keys() == want.keys() and all([r["rank"] for r in got if r["query_id"] == q] for q in want)
    hits = sum(len({i for i, _ in found[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits / sum(map(len, want.values())) >= 0.9
    vectors = {i: np.array(v, float) for i, v in rows[:640]}
    for q, near in found.items():
        assert len(near) == 20 and near == sorted(near, key=lambda x: (-x[1], x[0]))
        assert all(abs(s - float((vectors[q] * vectors[i]).sum())) < 1e-9 for i, s in near)


def test_few_vectors(spark):
    rows = [(k, [1.0, float(k)]) for k in range(0, 60, 20)]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 20, 20).collect()
    assert sorted((r["query_id"], r["vec_id"]) for r in got) == [(a, b) for a in (0, 20, 40) for b in (0, 20, 40) if a != b]
    assert ann.nearest(spark.createDataFrame([], "vec_id long, embedding array<double>"), 20, 20).count() == 0
    assert ann.nearest(spark.createDataFrame([(20, [1.0, 2.0])], "vec_id long, embedding array<double>"), 20, 20).count() == 0


def test_neighbours_in_tight_clusters(spark):
    """Rows whose differences are small beside their length: codes alone do not tell them apart, and no list may lose any."""
    rng = np.random.default_rng(7)
    x = rng.normal(size=(3, 64))[np.arange(3000) % 3] + 0.02 * rng.normal(size=(3000, 64))
    rows = [(k, [float(c) for c in v]) for k, v in enumerate(x)]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 100, 20, ann.Settings(lists=3, parts=4, codes=16, recall=1.0)).collect()
    score = x[::100] @ x.T
    score[np.arange(30), np.arange(0, 3000, 100)] = -np.inf
    want = {(100 * q, r + 1, int(i)) for q, near in enumerate(np.argsort(-score, 1)[:, :20]) for r, i in enumerate(near)}
    assert {(r["query_id"], r["rank"], r["vec_id"]) for r in got} == want
