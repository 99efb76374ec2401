import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from spanloom.llm import huffman, packing, tokens

P = pytest.importorskip("public_tokenizers")
BYTE, WORD = P.path("byte_bpe_50k.json"), P.path("word_bpe_49k.json")
PIECES = st.sampled_from([" ", "  ", "\n", "\t", "\r\n", " ", " ", "　", "a", "Bc", "don't", "'s", "12", "é", "́", "ß", "日本", "!!", ".", "<|endoftext|>", "<|startoftext|>", "<", "|", "“", "\x00", "\x1c", "İ"])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(PIECES, max_size=12).map("".join), min_size=1, max_size=6), st.sampled_from([BYTE, WORD]))
def test_chunks_give_the_library_ids(texts, path):
    enc = tokens.encoder(path)
    data, offsets = tokens.flat(pa.array(texts))
    ids, ends = enc.encode(data, offsets)
    for k, t in enumerate(texts):
        assert ids[ends[k] : ends[k + 1]].tolist() == enc.tokenizer.encode(t, add_special_tokens=False).ids, repr(t)


def test_unknown_vocabularies_get_whole_texts(tmp_path):
    """One that doesn't part texts at white space; chunks would give other ids."""
    import json

    spec = json.load(open(BYTE))
    spec["pre_tokenizer"]["use_regex"] = False
    (tmp_path / "v.json").write_text(json.dumps(spec))
    enc, texts = tokens.Encoder(str(tmp_path / "v.json")), ["the cat, of the", "", "a  b\n\nc"]
    assert not enc.chunked and tokens.encoder(BYTE).chunked and tokens.encoder(WORD).chunked
    ids, ends = enc.encode(*tokens.flat(pa.array(texts)))
    assert [ids[a:z].tolist() for a, z in zip(ends[:-1], ends[1:], strict=True)] == [enc.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


LATIN = "".join(map(chr, [*range(65, 91), *range(97, 123), *range(0xC0, 0x100)]))


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_words_of_latin_letters_reach_the_model_alone(path):
    """Only other chunks are normalized and parted again; the ids stay the library's."""
    enc, asked = tokens.Encoder(path), []
    whole, enc._chunks = enc._chunks, lambda chunks: asked.extend(chunks) or whole(chunks)
    texts = [" ".join(LATIN), " ".join(a + LATIN[-k:] for k, a in enumerate(LATIN, 1)), "e\u0301 a\u00d7b \u00b5m Stra\u00dfe \u0130x \tt \u00c9 12 don't", "x" * 60 + " " + "\u00c9" * 12]
    for _ in range(2):
        ids, ends = enc.encode(*tokens.flat(pa.array(texts)))
        assert [ids[a:z].tolist() for a, z in zip(ends[:-1], ends[1:], strict=True)] == [enc.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert asked and not any(c.strip() and all(x.isalpha() and x in LATIN for x in c.removeprefix(" ")) for c in asked)
    assert len(asked) == len(set(asked))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.text("abc", max_size=3), unique=True, max_size=9), max_size=12))
def test_memo_holds_what_was_used_last(steps):
    """Equal strings alone are found, with their ids; where it is full, strings of the last step stay."""
    memo, ids = tokens.Memo(np.dtype("<u2"), 16), {}
    for step in [["a", "ab", "a\0"], *steps]:
        data, ends = tokens.flat(pa.array(step, pa.string()))
        keys = tokens.short_keys(data, ends[:-1], np.diff(ends))
        entry = memo.find(keys)
        for w, e in zip(step, entry, strict=True):
            assert e < 0 or memo.ids[memo.first[e] : memo.first[e] + memo.size[e]].tolist() == ids[w]
        new = np.flatnonzero(entry < 0)
        for k in new:
            ids[step[k]] = [len(ids) + 1] * (len(ids) % 4)
        made = [ids[step[k]] for k in new]
        memo.add(keys[:, new], np.array([len(x) for x in made], np.int64), np.array(sum(made, []), "<u2"))
        assert memo.n <= 16 and (memo.find(keys) >= 0).sum() >= min(len(step), 8)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.text(LATIN, min_size=1, max_size=9), max_size=30).map(" ".join), min_size=1, max_size=8), st.sampled_from([BYTE, WORD]))
def test_a_full_memo_changes_no_ids(texts, path):
    enc = tokens.encoder(path)
    held, enc.memo = enc.memo, tokens.Memo(enc.wide, 16)
    try:
        for t in texts:
            assert enc.encode(*tokens.flat(pa.array([t])))[0].tolist() == enc.tokenizer.encode(t, add_special_tokens=False).ids
    finally:
        enc.memo = held


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 10**6), min_size=1, max_size=80), st.integers(7, 12))
def test_code_lengths(counts, longest):
    n = huffman.code_lengths(np.array(counts), longest)
    used = np.array(counts) > 0
    assert (n[~used] == 0).all() and (n[used] > 0).all() and n.max(initial=0) <= longest
    if used.sum() > 1:
        assert abs((0.5 ** n[used].astype(float)).sum() - 1) < 1e-12


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 30), max_size=700), min_size=1, max_size=5))
def test_block_round_trip(docs):
    flat = np.array([x for d in docs for x in d], np.int64)
    ends = np.concatenate(([0], np.cumsum([len(d) for d in docs])))
    code = huffman.Code(huffman.code_lengths(np.bincount(flat, minlength=31)))
    data, place, marks = code.encode(flat, ends)
    names = [None if k % 2 else -k for k in range(len(docs))]
    block = huffman.pack_block(names, np.diff(ends), marks, place[:-1].astype("<u8").tobytes() + data.tobytes())
    got = huffman.read_block(block, code)
    assert got[0] == names and got[1].tolist() == [len(d) for d in docs] and got[2].tolist() == flat.tolist()


def expected(rows, path, end):
    enc = tokens.encoder(path).tokenizer
    return [(r[0], enc.encode(r[1] or "", add_special_tokens=False).ids + [end]) for r in rows]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_many_distinct_words_are_encoded_once():
    """700,000 words, as many as a worker meets in a few batches of op6: none goes to the library a second time."""
    enc, asked = tokens.Encoder(BYTE), []
    words, enc._words = enc._words, lambda chunks: asked.append(len(chunks)) or words(chunks)
    letters = np.arange(97, 123, dtype=np.uint8)
    k = np.arange(700_000)
    text = np.stack([np.full(len(k), 32, np.uint8), *(letters[k // 26**p % 26] for p in range(5))], 1)
    parts = [tokens.flat(pa.array([text[a : a + 100_000].tobytes().decode()])) for a in range(0, len(k), 100_000)]
    first = [enc.encode(*p)[0].tolist() for p in parts]
    assert sum(asked) == len(k)
    assert [enc.encode(*p)[0].tolist() for p in parts] == first and sum(asked) == len(k)


def test_huffman_files(spark, docs, rows, none):
    files, lengths = huffman.write_files(docs, BYTE)
    got = sorted(huffman.read_files(spark, files, lengths, ids=True).collect(), key=lambda r: r["start"])
    want = sorted(expected(rows, BYTE, 0), key=lambda x: (x[0] is not None, x[0], zlib.crc32(np.array(x[1], "<u2").tobytes())))
    start = 0
    for r, (doc, ids) in zip(got, want, strict=True):
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (doc, start, len(ids), crc(ids))
        assert np.frombuffer(r["ids"], "<u4").tolist() == ids
        start += len(ids)
    assert huffman.read_files(spark, *huffman.write_files(none, BYTE)).count() == 0


def test_statistics_count_a_document_once(spark):
    raw = [[5, 5, 7], [], [7], [5, 9, 9, 5]]
    table = spark.createDataFrame([(np.array(x, "<u2").tobytes(),) for x in raw], "ids binary").repartition(2)
    df, n, total = packing.corpus_statistics(table, 12)
    assert df.tolist() == [0, 0, 0, 0, 0, 2, 0, 2, 0, 1, 0, 0] and (n, total) == (4, 8)


def test_packing(docs, rows, none):
    got = packing.pack(docs, WORD, window=256, ids=True).collect()
    want = expected(rows, WORD, 2)
    assert sum(r["length"] for r in got) == sum(len(x) for _, x in want)
    from collections import Counter, defaultdict

    left, seqs = Counter((d, len(x), crc(x)) for d, x in want), defaultdict(list)
    parts = defaultdict(list)
    for r in got:
        assert len(r["ids"]) == 4 * r["length"] and zlib.crc32(r["ids"]) == r["ids_crc32"] and r["length"] > 0
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
        parts[r["doc_id"], r["doc_tokens"]].append((r["start"], r["length"], r["ids"]))
    for spans in seqs.values():
        at = 0
        for o, n in sorted(spans):
            assert o == at
            at += n
        assert at <= 256 and (at == 256 or at & (at - 1) == 0)
    for (doc, n), pieces in parts.items():
        same = sum(c for (d, m, _), c in left.items() if (d, m) == (doc, n))
        assert sum(p[1] for p in pieces) == same * n
    assert packing.pack(none, WORD).count() == 0


def test_neighbours_share_words():
    a, b = list(range(100, 140)), list(range(200, 240))
    docs = [np.array(x) for x in (a, b, a[::-1], b[::-1])]
    ends = np.concatenate(([0], np.cumsum([len(d) for d in docs])))
    index = packing.Index(np.concatenate(docs), ends, np.ones(300, np.float32), 40.0)
    assert index.neighbours(0, np.array([False, True, True, True])).tolist() == [2]
    pieces, _ = packing.fill(index, np.array([40] * 4), 64)
    assert [p[0] for p in pieces if p[3] == 0] == [0, 2]


def test_neighbours_of_other_splits_share_windows(spark):
    """Two documents of each topic, which stand in the two halves of the table, so in different splits."""
    import random

    rng = random.Random(5)
    topics = [[f"{chr(97 + t % 26)}{chr(97 + t // 26)}{rng.randrange(10**6)}" for _ in range(30)] for t in range(40)]
    rows = [(h * 40 + t, " ".join(rng.choice(topics[t]) for _ in range(80))) for h in range(2) for t in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(1).sortWithinPartitions("doc_id").coalesce(1)
    halves = docs.filter("doc_id < 40").unionByName(docs.filter("doc_id >= 40"))
    ids = sum(len(x) for _, x in expected(rows, WORD, 2))
    got = packing.pack(halves, WORD, window=1024, shard=ids // 3).collect()
    assert sum(r["length"] for r in got) == ids
    seqs = {}
    for r in got:
        seqs.setdefault(r["doc_id"], set()).add(r["sequence_id"])
    assert sum(bool(seqs[t] & seqs[40 + t]) for t in range(40)) >= 30


def test_neighbours_by_all_terms_and_all_hits():
    """A seed of 100 equally rare terms: document 1 shares 90 of them, and 100 more documents share one each."""
    seed = np.arange(100)
    docs = [seed, np.arange(10, 100), *(np.array([k, *range(1000 + 89 * k, 1089 + 89 * k)]) for k in range(100))]
    ends = np.concatenate(([0], np.cumsum([len(d) for d in docs])))
    index = packing.Index(np.concatenate(docs).astype(np.int64), ends, np.ones(12000, np.float32), 90.0)
    got = index.neighbours(0, np.arange(len(docs)) > 0).tolist()
    assert got[0] == 1 and sorted(got) == list(range(1, 102))
