import hashlib
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from spanloom.llm import components, neardup, repeats, suffixes


def shingles(t):
    w = (t or "").encode().lower().split()
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)]) if w else frozenset()


def brute_components(rows, percent):
    """Rows sharing a doc_id are one document; rows without one come after all ids."""
    keys = [(0, r[0]) if r[0] is not None else (1, hashlib.md5((r[1] or "\0").encode()).hexdigest()) for r in rows]
    sets, root = [shingles(r[1]) for r in rows], list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if keys[a] == keys[b] or (both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both)):
                x, y = root[a], root[b]
                root = [y if r == x else r for r in root]
    least = {}
    for k, r in zip(keys, root, strict=True):
        least[r] = min(least.get(r, k), k)
    return [(r[0], len(s), least[x][1] if least[x][0] == 0 else None) for r, s, x in zip(rows, sets, root, strict=True)]


@pytest.mark.parametrize("percent", [80, 85])
def test_near_duplicates(docs, rows, none, percent):
    got = neardup.near_duplicates(docs, percent).collect()
    want = brute_components(rows, percent)
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == Counter(want)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got if r["doc_id"] is not None and r["component_id"] is not None)
    assert neardup.near_duplicates(none).count() == 0
    left = neardup.without_near_duplicates(docs, percent)
    assert left.columns == docs.columns
    # rows that share doc_id 5 have texts that are not alike: both stay; so do rows without words
    blank = Counter(r[0] for r in rows if not (r[1] or "").split())
    assert Counter(r["doc_id"] for r in left.collect()) == blank + Counter({c: 1 for _, n, c in want if n and c is not None}) + Counter([5])


def test_crossing_pairs_find_chains(spark):
    """A chain of edits whose ends are far apart is one component, whatever its buckets' least members are."""
    import random

    rng = random.Random(5)
    words = [f"v{k}" for k in range(400)]
    rows = []
    for k in range(60):
        rows.append((1000 - k if k % 2 else k, " ".join(words)))
        words[rng.randrange(400)] = f"x{k}"
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 85).collect()
    want = {(d, c) for d, _, c in brute_components(rows, 85)}
    assert {(r["doc_id"], r["component_id"]) for r in got} == want


@settings(max_examples=20, deadline=None)
@given(st.integers(20, 400), st.integers(20, 400), st.integers(0, 400))
def test_estimates_and_merging(only_a, only_b, both):
    rng = np.random.default_rng(only_a * 1000 + only_b + both)
    x = np.unique(rng.integers(0, 2**63, only_a + only_b + both, dtype=np.uint64) * np.uint64(2))
    a, b = np.sort(x[: only_a + both]), np.sort(x[only_a:])
    ra, rb = (neardup.spaced(neardup.registers(s))[None] for s in (a, b))
    j = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    assert abs(neardup.joint_estimate(ra, rb, np.array([len(a)]), np.array([len(b)]))[0] - j) < 0.17
    assert (neardup.spaced(neardup.registers(np.union1d(a, b))) == np.maximum(ra, rb)[0]).all()


def test_components_both_ways(spark):
    rng = np.random.default_rng(1)
    edges = [tuple(map(int, e)) for e in rng.integers(0, 300, (260, 2))] + [(k, k + 1) for k in range(1000, 1040)]
    df = spark.createDataFrame(edges, "u long, v long")
    a, b = ({(r["node"], r["component"]) for r in components.components(df, small=s).collect()} for s in (0, 10**6))
    assert a == b and (1040, 1000) in a
    assert components.components(df.limit(0)).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 4), max_size=80), st.integers(1, 3))
def test_suffix_arrays(text, times):
    s = np.array(text * times + [0], np.uint8)
    with pytest.MonkeyPatch.context() as m:  # as in strings of names, whatever the alphabet
        m.setattr(suffixes, "WAVES", 0)
        assert (suffixes.suffix_array(s) == sorted(range(len(s)), key=lambda k: s[k:].tolist())).all()
    sa, raw = suffixes.suffix_array(s), bytes(s.tolist())
    assert sa.tolist() == sorted(range(len(raw)), key=lambda k: raw[k:])
    got = suffixes.permuted_prefixes(s, sa, 1000)
    for i, j in zip(sa[1:].tolist(), sa[:-1].tolist(), strict=True):
        n = 0
        while i + n < len(raw) and j + n < len(raw) and raw[i + n] == raw[j + n]:
            n += 1
        assert got[i] == n


def test_suffix_arrays_of_many_letters():
    rng = np.random.default_rng(5)
    piece = rng.integers(1, 3000, 60)
    s = np.concatenate((piece, rng.integers(1, 3000, 200), piece[5:], [300], np.full(20, 256), piece, [0]))
    sa = suffixes.suffix_array(s)
    assert (sa == sorted(range(len(s)), key=lambda k: s[k:].tolist())).all()
    got = suffixes.permuted_prefixes(s, sa, 1000)
    for i, j in zip(sa[1:], sa[:-1], strict=True):
        n = 0
        while i + n < len(s) and j + n < len(s) and s[i + n] == s[j + n]:
            n += 1
        assert got[i] == n


def test_repeated_windows_of_words():
    windows = repeats.Windows(3, True)
    texts = [b"a b c d ", "é b c d e ".encode(), b"x y z ", b"ab c d e "]
    got = repeats.repeated_starts(texts, np.array([2, 3, 1, 2]), np.array([1, 1, 2, 1]), windows)
    assert [g.tolist() for g in got] == [[1], [1, 2], [0], [1]]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.none() | st.lists(st.tuples(st.integers(0, 40), st.lists(st.integers(0, 30), unique=True, max_size=8)), max_size=4), max_size=6), st.integers(1, 6))
def test_spans_of_a_batch(texts, size):
    """The contexts' windows of all texts of a batch, put into runs and merged at once, cover what each window covers."""
    kind = pa.list_(pa.struct([("at", pa.int32()), ("runs", pa.list_(pa.int32()))]))
    found, want = [None], [[]]
    for t in texts:
        windows = [np.array(sorted(w), np.int64) for _, w in t or ()]
        runs = repeats._runs(np.repeat(np.arange(len(windows)), [len(w) for w in windows]), np.concatenate([np.zeros(0, np.int64), *windows]), len(windows)).to_pylist()
        for w, r in zip(windows, runs, strict=True):
            assert [k for a, z in zip(r[::2], r[1::2], strict=True) for k in range(a, z + 1)] == w.tolist()
            assert all(z + 1 < a for z, a in zip(r[1::2], r[2::2], strict=False))
        found.append(None if t is None else [{"at": a, "runs": r} for (a, _), r in zip(t, runs, strict=True)])
        covered = np.zeros(100, int)
        for a, w in t or ():
            for k in w:
                covered[a + k : a + k + size] = 1
        edges = np.flatnonzero(np.diff(covered, prepend=0, append=0))
        want.append(edges.reshape(-1, 2).tolist())
    spans, upto = repeats._spans(pa.array(found, kind).slice(1), size)
    assert [spans[a:z].tolist() for a, z in zip(upto[:-1], upto[1:], strict=True)] == want[1:]


def brute_repeats(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[k : k + length] for b in raw for k in range(len(b) - length + 1))
    out = []
    for b in raw:
        cut = np.zeros(len(b) + 1, int)
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                cut[k] += 1
                cut[k + length] -= 1
        gone = np.cumsum(cut)[: len(b)] > 0
        out.append((len(b), int(gone.sum()), int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum()), hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


def brute_passages(texts, n):
    """(text less its runs of n words that start anywhere else, runs, words in them)."""
    at = [[m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", t or "")] for t in texts]
    words = [[t[a:z] for a, z in w] for t, w in zip(texts, at, strict=True)]
    seen = Counter(tuple(w[k : k + n]) for w in words for k in range(len(w) - n + 1))
    out = []
    for t, w, spans in zip(texts, words, at, strict=True):
        gone = {i for k in range(len(w) - n + 1) if seen[tuple(w[k : k + n])] > 1 for i in range(k, k + n)}
        kept = "".join([(t or "")[: spans[0][0] if spans else None], *((t[a : spans[i + 1][0] if i + 1 < len(spans) else z]) for i, (a, z) in enumerate(spans) if i not in gone)])
        kept += (t or "")[spans[-1][1] :] if spans else ""
        out.append((kept, len([i for i in gone if i - 1 not in gone]), len(gone)))
    return out


@pytest.mark.parametrize(("giant", "size"), [(None, 51), (0, 51), (None, 3), (None, 1)])
def test_repeated_words(docs, rows, none, monkeypatch, giant, size):
    if giant is not None:
        monkeypatch.setattr(repeats, "GIANT", giant)
    want = brute_passages([r[1] for r in rows], size)
    got = repeats.strip_repeats(docs, words=size)
    assert got.columns == docs.columns
    assert Counter((r["doc_id"], r["text"]) for r in got.collect()) == Counter((r[0], w[0] if r[1] is not None else None) for r, w in zip(rows, want, strict=True))
    counted = repeats.remove_repeats(docs, words=size).collect()
    assert Counter((r["doc_id"], r["n_passages"], r["passage_words"]) for r in counted) == Counter((r[0], *w[1:]) for r, w in zip(rows, want, strict=True))
    assert repeats.strip_repeats(none, words=size).count() == 0


def test_words_of_long_texts_are_hashed_in_pieces(monkeypatch):
    text = np.frombuffer(" ".join(f"w{k * 7919 % 1000}" for k in range(5000)).encode() + b"  \n" + b"x" * 3000 + b" end", np.uint8)
    ends = np.array([0, len(text)])
    whole, n = repeats.word_values(text, ends)
    monkeypatch.setattr(repeats, "PIECE", 700)
    parts, m = repeats.word_values(text, ends)
    assert n.tolist() == m.tolist() == [0, 5002] and (whole == parts).all()


@pytest.mark.parametrize("giant", [None, 0])
def test_repeats(docs, rows, none, monkeypatch, giant):
    if giant is not None:
        monkeypatch.setattr(repeats, "GIANT", giant)
    got = repeats.remove_repeats(docs, keep_bytes=True).collect()
    assert all(hashlib.sha256(r["kept"]).hexdigest() == r["kept_sha256"] for r in got)
    want = brute_repeats([r[1] for r in rows], 400)
    assert Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == Counter((r[0], *w) for r, w in zip(rows, want, strict=True))
    assert repeats.remove_repeats(none).count() == 0
    stripped = repeats.strip_repeats(docs)
    assert stripped.columns == docs.columns and Counter(len((r["text"] or "").encode()) for r in stripped.collect()) == Counter(w[0] - w[1] for w in want)


def test_segments_of_long_texts():
    rng = np.random.default_rng(2)
    data = rng.integers(97, 100, 5000).astype(np.uint8)
    offsets = np.array([0, 10, 4200, 5000])
    whole = set()
    text, begin, end = repeats.segments(offsets, 100, 700)
    for t, a, z in zip(text, begin, end, strict=True):
        k, at, n, *_ = repeats.anchored(data[a:z], np.array([0, z - a]), 100, 16)
        for x, y in zip(at.tolist(), n.tolist(), strict=True):
            starts = {(int(t), int(a - offsets[t] + x + s)) for s in range(y)}
            assert not whole & starts
            whole |= starts
    assert whole == {(t, s) for t in range(3) for s in range(max(0, offsets[t + 1] - offsets[t] - 99))}
