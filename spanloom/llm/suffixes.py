"""Suffix arrays by induced sorting, and longest common prefixes, as array code."""

from __future__ import annotations

import numpy as np

#: Letters up to which buckets are filled in waves of array code.
WAVES = 1024


def _types(s: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one; equal neighbours take the type of what follows. The last
    two letters differ."""
    n = len(s)
    out = np.ones(n, bool)
    if n > 1:
        differs = np.flatnonzero(s[:-1] != s[1:])
        out[:-1] = np.repeat(s[differs] < s[differs + 1], np.diff(differs, prepend=-1))
    return out


def _induce(s: np.ndarray, small: np.ndarray, lms: np.ndarray, heads: np.ndarray, tails: np.ndarray) -> np.ndarray:
    """The suffix array that LMS positions, in the given order within each bucket, induce.

    Buckets are scanned once upwards for larger-type and once downwards for smaller-type suffixes. What
    one scan step places in its own bucket forms the next wave of that bucket, so a wave is one array
    operation and the order is that of the entry-by-entry scan.
    """
    n, k = len(s), len(heads)
    sa = np.full(n, -1, np.int32)
    size = np.bincount(s[lms], minlength=k)
    upto = np.cumsum(size)

    def place(at: np.ndarray, ends: np.ndarray, up: bool) -> None:
        c = s[at]
        by = np.argsort(c, kind="stable")
        at, c = at[by], c[by]
        many = np.bincount(c, minlength=k)
        rank = np.arange(len(at)) - (np.cumsum(many) - many)[c]
        if up:
            sa[ends[c] + rank] = at
            ends += many
        else:
            sa[ends[c] - 1 - rank] = at
            ends -= many

    head = heads.copy()
    for c in np.flatnonzero(tails > heads):
        done = heads[c]
        while done < head[c]:
            cur, done = sa[done : head[c]], head[c]
            cur = cur[cur > 0] - 1
            cur = cur[~small[cur]]
            if len(cur):
                place(cur, head, True)
        if size[c]:
            cur = lms[upto[c] - size[c] : upto[c]]
            cur = cur[cur > 0] - 1
            if len(cur):
                place(cur, head, True)
    tail = tails.copy()
    for c in np.flatnonzero(tails > heads)[::-1]:
        done = tails[c]
        while done > tail[c]:
            cur, done = sa[tail[c] : done][::-1], tail[c]
            cur = cur[cur > 0] - 1
            cur = cur[small[cur]]
            if len(cur):
                place(cur, tail, False)
        cur = sa[heads[c] : head[c]][::-1]
        cur = cur[cur > 0] - 1
        cur = cur[small[cur]]
        if len(cur):
            place(cur, tail, False)
    sa[0] = n - 1
    return sa


def _chained(code: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The places `at` in order of the codes from each on. A chain of codes ends at one that no other place
    has, so places that still tie have not reached their ends; they are compared at twice the distance."""
    key = code[at] * (int(code.max()) + 1) + code[at + 1]
    by = np.argsort(key)
    order, key, h = at[by], key[by], 2
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    size = np.diff(np.append(first, len(order)))
    tied = np.flatnonzero(np.repeat(size > 1, size))
    if len(tied):  # rank: the code, then the first place of those that tie
        wide = len(at) + 1
        rank = code * wide
        rank[order] += np.repeat(first, size) + 1
    while len(tied):
        here = order[tied]
        nxt, own = rank[here + h], rank[here]
        by = np.lexsort((nxt, own))
        here, own, nxt = here[by], own[by], nxt[by]
        order[tied] = here
        begin = np.flatnonzero(np.concatenate(([True], (own[1:] != own[:-1]) | (nxt[1:] != nxt[:-1]))))
        size = np.diff(np.append(begin, len(here)))
        rank[here] = own // wide * wide + np.repeat(tied[begin], size) + 1
        tied, h = tied[np.repeat(size > 1, size)], h * 2
    return order


def _induce_chains(s: np.ndarray, small: np.ndarray, lms: np.ndarray, heads: np.ndarray, tails: np.ndarray) -> np.ndarray:
    """The same for strings of names, whose buckets are too many and too small for waves.

    A larger-type suffix is its characters up to the next leftmost smaller position, whose place among its
    like is known: a chain with an end of its own. All chains are sorted at once, and then, with the
    larger-type suffixes as ends, those of the smaller type.
    """
    n, k = len(s), len(heads)
    within = lambda x, many: np.arange(len(x)) - (np.cumsum(many) - many)[s[x]]  # noqa: E731  (places in order, by bucket)
    code, size = np.zeros(n, np.int64), np.bincount(s[lms], minlength=k)
    base = np.arange(k) + np.cumsum(size) - size  # in a bucket the larger type goes before the smaller
    larger, smaller = np.flatnonzero(~small), np.flatnonzero(small)[:-1]  # the last one is the end mark
    code[larger] = base[s[larger]]
    code[lms] = base[s[lms]] + 1 + within(lms, size)
    larger = _chained(code, larger)
    size = np.bincount(s[larger], minlength=k)
    base = np.arange(k) + np.cumsum(size) - size
    code[larger] = base[s[larger]] + within(larger, size)
    code[smaller] = (base + size)[s[smaller]]
    smaller = _chained(code, smaller)
    sa = np.empty(n, np.int32)
    sa[heads[s[larger]] + within(larger, size)] = larger
    size = np.bincount(s[smaller], minlength=k)
    sa[(tails - size)[s[smaller]] + within(smaller, size)] = smaller
    sa[0] = n - 1
    return sa


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Suffix array of small non-negative integers that end with the only 0.

    Suffixes are classified as smaller or larger than the next; the substrings between leftmost smaller
    ones are sorted by induction and named; if names repeat, the string of names, at most half as long,
    is sorted in the same way; the sorted leftmost smaller suffixes induce all others in linear time.
    """
    if len(s) == 1:
        return np.zeros(1, np.int32)
    k = int(s.max()) + 1
    induce = _induce if k <= WAVES else _induce_chains
    count = np.bincount(s, minlength=k)
    tails = np.cumsum(count)
    heads = tails - count
    small = _types(s)
    lms = (np.flatnonzero(small[1:] & ~small[:-1]) + 1).astype(np.int32)
    is_lms = np.zeros(len(s), bool)
    is_lms[lms] = True
    sa = induce(s, small, lms[np.argsort(s[lms], kind="stable")], heads, tails)
    order = sa[is_lms[sa]]
    # names: equal substrings (up to and with the next leftmost smaller one) get equal numbers
    number = np.full(len(s), -1, np.int32)
    number[lms] = np.arange(len(lms), dtype=np.int32)
    size = np.diff(np.append(lms, len(s) - 1)) + 1
    power = np.cumprod(np.full(int(size.max()), 0x9E3779B97F4A7C15, np.uint64), dtype=np.uint64)
    rel = np.arange(int(lms[0]), len(s)) - np.repeat(lms, np.diff(np.append(lms, len(s))))
    mark = np.add.reduceat((s[lms[0] :].astype(np.uint64) + np.uint64(1)) * power[rel], lms - lms[0])
    last = np.minimum(lms + size - 1, len(s) - 1)
    mark += (s[last].astype(np.uint64) + np.uint64(1)) * power[size - 1]
    by = number[order]
    fresh = np.concatenate(([True], (mark[by[1:]] != mark[by[:-1]]) | (size[by[1:]] != size[by[:-1]])))
    names = np.empty(len(lms), np.int64)
    names[by] = np.cumsum(fresh) - 1
    if not fresh.all():
        order = lms[suffix_array(names)]
    # within a bucket the sorted order stays; buckets ascend by first character
    return induce(s, small, order, heads, tails)


def permuted_prefixes(s: np.ndarray, sa: np.ndarray, most: int, breaks: np.ndarray | None = None) -> np.ndarray:
    """Common prefix of each suffix (by place in the text) with its predecessor in `sa`, up to `most`.

    Where the characters before a suffix and its predecessor agree, the value is the previous one less 1;
    only the other, irreducible, values are found by comparison, eight bytes at a time. Values at
    `breaks` are compared too, so that the cut at `most` does not carry over from one part to the next.
    """
    n = len(s)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    at = np.arange(n)
    reducible = np.zeros(n, bool)
    reducible[1:] = (before[1:] > 0) & (s[:-1] == s[np.maximum(before[1:], 1) - 1]) & (before[:-1] >= 0)
    if breaks is not None:
        reducible[breaks] = False
    hard = np.flatnonzero(~reducible & (before >= 0))
    kind = np.dtype("<u1" if s.max() < 256 else "<u4")
    step, bits = 8 // kind.itemsize, 8 * kind.itemsize
    padded = np.concatenate((s.astype(kind), np.zeros(most + 16, kind)))
    wide = np.lib.stride_tricks.sliding_window_view(padded, step).copy().view("<u8")[:, 0]
    value, a, b, live, k = np.zeros(n, np.int64), hard, before[hard], np.arange(len(hard)), 0
    got = np.full(len(hard), most, np.int64)
    while len(live) and k < most:
        x = wide[np.minimum(a[live] + k, len(wide) - 1)] ^ wide[np.minimum(b[live] + k, len(wide) - 1)]
        stop = x != 0
        low = x[stop] & (~x[stop] + np.uint64(1))
        got[live[stop]] = np.minimum(most, k + np.log2(low.astype(np.float64)).astype(np.int64) // bits)
        live, k = live[~stop], k + step
    value[hard] = got
    source = np.maximum.accumulate(np.where(reducible, 0, at))
    return np.where(reducible, np.maximum(value[source] - (at - source), 0), value)
