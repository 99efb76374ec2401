import corpus_pipeline as P
from test_dedup import brute_components, brute_passages
from test_native import split


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names, seen = docs.columns, []
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == names
        seen.append((name, docs.collect(), out.collect()))
        docs = spark.createDataFrame(seen[-1][2], docs.schema)
    assert [s for s, _, _ in seen] + ["packing"] == [s for s, _ in P.STAGES]
    before, after = seen[0][1:]
    assert {r["doc_id"] for r in after} <= {r["doc_id"] for r in before} and all(len(split(r["text"])) >= 10 for r in after)
    before, after = seen[1][1:]
    assert sorted(r["doc_id"] for r in after) == sorted({c for _, _, c in brute_components([(r["doc_id"], r["text"]) for r in before], 80)})
    before, after = seen[2][1:]
    want = {r["doc_id"]: w[0] for r, w in zip(before, brute_passages([r["text"] for r in before], 51), strict=True)}
    assert {r["doc_id"]: r["text"] for r in after} == want and all(r["n_chars"] == len(r["text"]) for r in after)
    before, after = seen[3][1:]
    assert {r["doc_id"] for r in after} <= {r["doc_id"] for r in before} and max(sum(x["doc_id"] == r["doc_id"] for x in after) for r in after) <= 2
    pieces = P.STAGES[-1][1](spark, docs, sf).collect()
    assert {r["doc_id"] for r in pieces} == {r["doc_id"] for r in after}


def test_run(spark, sf):
    assert P.run(spark, sf).count() > 0


def test_passages_of_51_words_go(spark, sf):
    """Of common and of the shortest words, between texts that share nothing else."""
    rows = []
    for p, word in enumerate(("w{:02d}xyz", "{}")):
        passage = " ".join(word.format(chr(97 + k % 26) if p else k) for k in range(51))
        rows += [(10 * p + k, " ".join(f"{p}{k}u{n * 7919 + k}" for n in range(60)) + f" {passage} " + " ".join(f"{k}{p}v{n * 104729 + k}" for n in range(60)), "en", "s", 0) for k in range(2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"]: r["text"] for r in P.suffix_dedup(spark, docs, sf).collect()}
    for doc, text, *_ in rows:
        words = text.split(" ")
        assert got[doc] == " ".join(words[:60] + words[-60:])
