"""Lexical retrieval packing: neighbours found by BM25 share a window."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import only, release, store, trim
from .tokens import tokenized

WINDOW, SHARD, K1, B = 4096, 1 << 21, 1.5, 0.75
#: Lexical groups: dimensions of the hashed term weights, documents fitted to, groups a shard and in all, rounds.
DIMENSIONS, FITTED, FINE, GROUPS, ROUNDS = 256, 20_000, 8, 4096, 8
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_SCHEMA = pa.schema([(x.split()[0], pa.int64()) for x in PIECES.split(", ")])


def corpus_statistics(tokens: DataFrame, size: int) -> tuple[np.ndarray, int, int]:
    """(documents with each id, documents, tokens) of the whole corpus; `size` rows are collected at most."""

    def count(batches):
        df, docs, total, last = np.zeros(size, np.int64), 0, 0, np.empty(size, np.int64)
        for b in batches:
            for ids in b.column(0):
                x = np.frombuffer(ids.as_buffer(), "<u2" if size <= 65536 else "<u4").astype(np.int64)
                here = np.arange(len(x))
                last[x] = here  # one place of each distinct id
                df[x[last[x] == here]] += 1
                docs, total = docs + 1, total + len(x)
        k = np.flatnonzero(df)
        yield pa.RecordBatch.from_pydict({"id": np.concatenate((k, [-1, -2])), "n": np.concatenate((df[k], [docs, total]))}, pa.schema([("id", pa.int64()), ("n", pa.int64())]))

    got = {r["id"]: r["n"] for r in tokens.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()}
    docs, total = got.pop(-1, 0), got.pop(-2, 0)
    df = np.zeros(size, np.int64)
    df[list(got)] = list(got.values())
    return df, docs, total


def weighted_terms(ids: np.ndarray, ends: np.ndarray, idf: np.ndarray, mean: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, term, BM25 weight) of each document's distinct terms, in order."""
    lengths = np.diff(ends)
    key = (np.repeat(np.arange(len(lengths), dtype=np.int64), lengths) << 20) | ids
    key.sort()
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    tf = np.diff(np.append(first, len(key))).astype(np.float32)
    doc, term = (key[first] >> 20).astype(np.int32), (key[first] & 0xFFFFF).astype(np.int32)
    norm = K1 * (1 - B + B * lengths / max(mean, 1e-9)).astype(np.float32)
    return doc, term, idf[term] * tf * (K1 + 1) / (tf + norm[doc])


def hashed_weights(ids: np.ndarray, ends: np.ndarray, idf: np.ndarray, mean: float) -> np.ndarray:
    """A unit vector for each document: its term weights under signed hashing, so that dot products follow shared terms."""
    doc, term, weight = weighted_terms(ids, ends, idf, mean)
    h = (term.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    cell = (h >> np.uint64(40)).astype(np.int64) % DIMENSIONS
    sign = np.where(h >> np.uint64(63), weight, -weight)
    x = np.bincount(doc * np.int64(DIMENSIONS) + cell, sign, (len(ends) - 1) * DIMENSIONS).reshape(-1, DIMENSIONS).astype(np.float32)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def fitted_groups(x: np.ndarray, groups: int) -> np.ndarray:
    """Spherical k-means centers of the unit vectors x, each next to one that is near it."""
    rng = np.random.default_rng(11)
    c = x[rng.permutation(len(x))[:groups]]
    for _ in range(ROUNDS):
        near = np.argmax(x @ c.T, 1)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        size = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(size > 1e-6, total / np.maximum(size, 1e-9), c)
    order, left = [0], np.ones(len(c), bool)
    while len(order) < len(c):
        left[order[-1]] = False
        order.append(int(np.argmax(np.where(left, c @ c[order[-1]], -2))))
    return c[order]


def lexically_grouped(tokens: DataFrame, idf, mean: float, total: int, wide: np.dtype, shard: int) -> DataFrame:
    """The rows of `tokens`, lexically similar documents beside each other, dealt into parts of about a shard.

    Every document is compared with the centers of all groups, which are fitted on at most FITTED documents of
    the whole table. Groups follow a chain of near centers, and parts are ranges of it, so a group larger than a
    part is dealt over several and no part is larger for it.
    """
    parts = max(1, -(-total * 5 // (shard * 4)))
    if parts == 1:
        return tokens.coalesce(1)

    def vectors(b, k):
        flat = np.frombuffer(b"".join(x.as_buffer() for x in b.column(k)), wide).astype(np.int64)
        sizes = np.fromiter((len(x.as_buffer()) for x in b.column(k)), np.int64, b.num_rows) // wide.itemsize
        ends, at = np.concatenate(([0], np.cumsum(sizes))), 0
        while at < b.num_rows:  # about a million ids at a time
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + (1 << 20), "right")) - 1)
            yield hashed_weights(flat[ends[at] : ends[to]], ends[at : to + 1] - ends[at], idf.value, mean)
            at = to

    def sample(batches):
        for b in batches:
            for x in vectors(b, 0):
                yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x], pa.binary())], ["x"])

    rows = tokens.select(F.pmod(F.xxhash64("doc_id", "n"), F.lit(1_000_003)).alias("h"), "ids")
    share = FITTED / max(tokens.count(), 1)
    picked = rows.filter(F.col("h") <= min(1.0, share) * 1_000_003).select("ids").limit(FITTED)
    x = np.frombuffer(b"".join(r["x"] for r in picked.mapInArrow(sample, "x binary").collect()), np.float32).reshape(-1, DIMENSIONS)
    if not len(x):
        x = np.zeros((1, DIMENSIONS), np.float32)
    centers = tokens.sparkSession.sparkContext.broadcast(fitted_groups(x, min(parts * FINE, GROUPS)))

    def run(batches):
        for b in batches:
            place = np.concatenate([np.argmax(v @ centers.value.T, 1) for v in vectors(b, 1)]) if b.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(place.astype(np.int32))], ["doc_id", "ids", "place"])
        trim()

    near = tokens.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids binary, place int")
    near = store(near.withColumn("salt", F.xxhash64(F.monotonically_increasing_id())), "pack-grouped", "zstd")
    release(tokens)
    return near.repartitionByRange(parts, "place", "salt").sortWithinPartitions("place", "salt")


class Index:
    """BM25 postings of a shard, ordered by term, with weights from corpus-wide statistics.

    Terms of over an eighth of the documents hold most of the postings; their weights are a matrix, documents by
    terms (no larger than eight times the postings it stands for), so that a seed adds them up in one product.
    """

    def __init__(self, ids: np.ndarray, ends: np.ndarray, idf: np.ndarray, mean: float):
        docs = len(ends) - 1
        doc, term, weight = weighted_terms(ids, ends, idf, mean)
        many = np.bincount(term, minlength=len(idf))
        common = np.flatnonzero(many > max(docs // 8, 16))
        place = np.full(len(idf), -1, np.int32)
        place[common] = np.arange(len(common))
        at = place[term]
        self.common = np.zeros((docs, len(common)), np.float32)
        self.common[doc[at >= 0], at[at >= 0]] = weight[at >= 0]
        doc, term, weight = doc[at < 0], term[at < 0], weight[at < 0]
        self.own = np.searchsorted(doc, np.arange(docs + 1))
        self.terms = term
        by = np.argsort(term.astype(np.uint16), kind="stable") if len(idf) <= 65536 else np.argsort(term, kind="stable")
        self.docs, self.scores = doc[by].astype(np.int64), weight[by].astype(np.float64)
        self.starts = np.searchsorted(term[by], np.arange(len(idf) + 1))
        self.n = docs

    def neighbours(self, seed: int, unused: np.ndarray) -> np.ndarray:
        """All unused documents that share a term with the seed, best first by all of its terms."""
        terms = self.terms[self.own[seed] : self.own[seed + 1]]
        score = (self.common @ (self.common[seed] > 0).astype(np.float32)).astype(np.float64)
        first, size = self.starts[terms], self.starts[terms + 1] - self.starts[terms]
        at = np.repeat(first - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        if len(at):
            score += np.bincount(self.docs[at], self.scores[at], self.n)
        found = np.flatnonzero(unused & (score > 0))
        return found[np.argsort(-score[found], kind="stable")]


def fill(index: Index, lengths: np.ndarray, window: int = WINDOW):
    """(document, start, length, sequence, offset) pieces that use each id of a shard once.

    A window starts with what is left of the last document, or with the next unused one, and takes its
    best unused neighbours until it is full; the one that crosses its end is cut, and the rest seeds the
    next window. The shard's last, partly filled window is cut at powers of two, which need no padding.
    """
    unused, seed, rest, at, seq, pieces, room = np.ones(len(lengths), bool), None, 0, 0, 0, [], window
    queue, nxt = [], 0
    while True:
        if seed is None:
            while queue and not unused[queue[-1]]:
                queue.pop()
            if queue:
                seed = queue.pop()
            else:
                while nxt < len(lengths) and not unused[nxt]:
                    nxt += 1
                if nxt == len(lengths):
                    break
                seed = nxt
            unused[seed] = False
            rest, at = int(lengths[seed]), 0
        take = min(rest, room)
        pieces.append((seed, at, take, seq, window - room))
        rest, at, room = rest - take, at + take, room - take
        done = seed
        if room == 0:
            seq, room, queue = seq + 1, window, []
        if rest == 0:
            seed = None
        if rest == 0 and room < window and not queue:
            queue = index.neighbours(done, unused)[::-1].tolist()
    if room < window:  # the last window's pieces, cut again into runs of a power of two
        last = [p for p in pieces if p[3] == seq]
        pieces = pieces[: len(pieces) - len(last)]
        left, sizes = window - room, []
        while left:
            sizes.append(1 << (left.bit_length() - 1))
            left -= sizes[-1]
        room, used = sizes.pop(0), 0
        for doc, start, length, _, _ in last:
            while length:
                take = min(length, room - used)
                pieces.append((doc, start, take, seq, used))
                start, length, used = start + take, length - take, used + take
                if used == room:
                    seq, used, room = seq + 1, 0, sizes.pop(0) if sizes else 0
    return pieces, seq


def pack(docs: DataFrame, path: str, end: int = 2, window: int = WINDOW, shard: int = SHARD, ids: bool = False) -> DataFrame:
    """Pieces of all documents (null text: empty) in sequences of at most `window` ids.

    Documents are tokenized once into a stored table. Corpus-wide statistics (bounded by the vocabulary)
    weight the terms. Documents are brought beside lexically similar ones of the whole table (see
    lexically_grouped); seeds then query shards of up to `shard` ids, so no task holds more than a shard or
    one document. Neighbours in other shards are not found; the README gives the recall. Sequences are full,
    but for the last of a shard, whose lengths are powers of two, so none is padded.

    Defined cases: each row is a document of its own even if ids or texts repeat; a null doc_id stays
    null; an empty table gives no rows; other columns are ignored. With `ids`, the pieces' ids follow as
    little-endian 4-byte integers.
    """
    from tokenizers import Tokenizer

    size = Tokenizer.from_file(path).get_vocab_size()
    wide = np.dtype("<u2" if size <= 65536 else "<u4")
    tokens = store(tokenized(only(docs, {"doc_id": "long", "text": "string"}), path, end), "pack-tokens", "zstd")
    df, n, total = corpus_statistics(tokens, size)
    idf = np.log1p((n - df + 0.5) / (df + 0.5)).astype(np.float32)
    shared, mean = docs.sparkSession.sparkContext.broadcast(idf), total / max(n, 1)
    schema = pa.schema([*_SCHEMA, ("ids", pa.binary())]) if ids else _SCHEMA

    def run(batches):
        base = TaskContext.get().partitionId() << 40
        names, held, waiting = [], [], 0

        def close():
            nonlocal base, names, held, waiting
            lengths = np.array([len(x) for x in held], np.int64)
            ends = np.concatenate(([0], np.cumsum(lengths)))
            flat = np.concatenate(held)
            pieces, used = fill(Index(flat.astype(np.int64), ends, shared.value, mean), lengths, window)
            p = np.array(pieces, np.int64).reshape(-1, 5)
            wide4 = flat.astype("<u4")
            raw = [wide4[a : a + k].tobytes() for a, k in zip(ends[p[:, 0]] + p[:, 1], p[:, 2], strict=True)]
            cols = [pa.array([names[k] for k in p[:, 0]], pa.int64()), p[:, 1], p[:, 2], pa.array([zlib.crc32(x) for x in raw], pa.int64()), lengths[p[:, 0]], base + p[:, 3], p[:, 4]]
            base, names, held, waiting = base + used, [], [], 0
            return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in cols] + ([pa.array(raw, pa.binary())] if ids else []), schema=schema)

        for b in batches:
            for doc, raw in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                x = np.frombuffer(raw.as_buffer(), wide)
                if held and waiting + len(x) > shard:
                    yield close()
                names.append(doc)
                held.append(x)
                waiting += len(x)
        if held:
            yield close()
        trim()

    near = lexically_grouped(tokens, shared, mean, total, wide, shard)
    return near.select("doc_id", "ids").mapInArrow(run, PIECES + ", ids binary" * ids)
