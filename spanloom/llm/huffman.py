"""Token files in a canonical, length-limited Huffman code of global id counts.

A file is a run of blocks. A block holds whole documents (up to BLOCK ids, or one longer document) and
can be decoded alone: a header, then for each document its id (with a null mark) and number of ids, then
the bit offsets of a checkpoint every STRIDE ids, then the bits. A document starts on a byte. All lanes
between checkpoints are decoded together by table look-ups.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, only, store, trim
from .files import Reader, Writer
from .tokens import flat, tokenized

LONGEST, STRIDE, BLOCK = 20, 256, 1 << 18
HEAD = "<4sIQQQ"


def code_lengths(counts: np.ndarray, longest: int = LONGEST) -> np.ndarray:
    """Optimal code lengths of at most `longest` bits by package-merge; ids that don't occur get 0."""
    out = np.zeros(len(counts), np.uint8)
    used = np.flatnonzero(counts)
    if len(used) <= 1:
        out[used] = 1
        return out
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.float64)
    if len(leaves) > 1 << longest:
        raise ValueError(f"{len(leaves)} ids don't fit codes of {longest} bits")
    levels, weights, leaf = [], leaves, np.ones(len(leaves), bool)
    for _ in range(longest - 1):
        levels.append(leaf)
        pairs = weights[: len(weights) // 2 * 2].reshape(-1, 2).sum(1)
        both, is_leaf = np.concatenate((leaves, pairs)), np.concatenate((np.ones(len(leaves), bool), np.zeros(len(pairs), bool)))
        by = np.argsort(both, kind="stable")
        weights, leaf = both[by], is_leaf[by]
    levels.append(leaf)
    take, lengths = 2 * len(leaves) - 2, np.zeros(len(leaves), np.uint8)
    for leaf in reversed(levels):
        n = int(leaf[:take].sum())
        lengths[:n] += 1
        take = 2 * (take - n)
    out[order] = lengths
    return out


class Code:
    """The canonical code of given lengths: codes ascend by (length, id)."""

    def __init__(self, lengths: np.ndarray):
        self.lengths = lengths.astype(np.int64)
        self.width = max(1, int(lengths.max(initial=1)))
        order = np.lexsort((np.arange(len(lengths)), lengths))
        order = order[lengths[order] > 0]
        size = self.lengths[order]
        # a code of n bits fills 2**(width-n) entries of the table; codes are the running sums
        span = np.left_shift(1, self.width - size)
        start = np.cumsum(span) - span
        self.codes = np.zeros(len(lengths), np.uint64)
        self.codes[order] = (start >> (self.width - size)).astype(np.uint64)
        self.symbol, self.bits = np.zeros(1 << self.width, np.uint32), np.ones(1 << self.width, np.int64)
        total = int(span.sum())
        self.symbol[:total], self.bits[:total] = np.repeat(order, span), np.repeat(size, span)

    def encode(self, ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(bytes, byte offsets of documents, checkpoints): ids of documents that end at ends[1:].
        A checkpoint is the bit offset, within its document, of each STRIDE-th id."""
        size = self.lengths[ids]
        upto = np.concatenate(([0], np.cumsum(size)))
        total = np.diff(upto[ends])
        place = np.concatenate(([0], np.cumsum((total + 7) // 8)))
        n = np.diff(ends)
        within = upto[:-1] - np.repeat(upto[ends[:-1]], n)
        at = within + np.repeat(place[:-1] * 8, n)
        marks = within[(np.arange(len(ids)) - np.repeat(ends[:-1], n)) % STRIDE == 0]
        word, shift = at >> 6, 64 - (at & 63) - size
        code = self.codes[ids]
        high = np.where(shift >= 0, code << np.maximum(shift, 0).astype(np.uint64), code >> np.maximum(-shift, 0).astype(np.uint64))
        out = np.zeros(int(place[-1] + 7) // 8 + 2, np.uint64)
        if len(ids):
            firsts = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            out[word[firsts]] = np.bitwise_or.reduceat(high, firsts)
            over = np.flatnonzero(shift < 0)
            out[word[over] + 1] |= code[over] << (64 + shift[over]).astype(np.uint64)
        return out.astype(">u8").view(np.uint8)[: place[-1]], place, marks

    def decode(self, data: np.ndarray, place: np.ndarray, counts: np.ndarray, marks: np.ndarray) -> np.ndarray:
        """The ids of documents of `counts` ids each that start at byte `place`."""
        lanes = -(-counts // STRIDE)
        at = marks + np.repeat(place[: len(counts)] * 8, lanes)
        n = int(lanes.sum())
        if not n:
            return np.zeros(0, np.uint32)
        wide = np.concatenate((data, np.zeros(STRIDE * LONGEST // 8 + 8, np.uint8))).astype(np.uint32)
        look = (wide[:-3] << 24) | (wide[1:-2] << 16) | (wide[2:-1] << 8) | wide[3:]
        got, drop = np.empty((STRIDE, n), np.uint32), np.uint32(32 - self.width)
        for k in range(STRIDE):
            index = (look[at >> 3] << (at & 7).astype(np.uint32)) >> drop
            got[k] = self.symbol[index]
            at = at + self.bits[index]
        size = np.full(n, STRIDE)
        size[np.cumsum(lanes)[lanes > 0] - 1] = (counts - (lanes - 1) * STRIDE)[lanes > 0]
        return got.T[np.arange(STRIDE) < size[:, None]]


def pack_block(ids: list[int | None], counts: np.ndarray, marks: np.ndarray, data: bytes) -> bytes:
    """One block; the bit string of a document is as long as the next one's offset says."""
    names = np.array([0 if i is None else i for i in ids], "<i8").tobytes() + np.array([i is None for i in ids], np.uint8).tobytes()
    return struct.pack(HEAD, b"HUF1", len(ids), int(counts.sum()), len(marks), len(data)) + names + counts.astype("<u8").tobytes() + marks.astype("<u8").tobytes() + data


def read_block(raw: bytes, code: Code) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """(document ids, counts, all ids) of one block."""
    _, docs, _, checkpoints, size = struct.unpack_from(HEAD, raw)
    at = struct.calcsize(HEAD)
    names, at = np.frombuffer(raw, "<i8", docs, at), at + 8 * docs
    void, at = np.frombuffer(raw, np.uint8, docs, at), at + docs
    counts, at = np.frombuffer(raw, "<u8", docs, at).astype(np.int64), at + 8 * docs
    marks, at = np.frombuffer(raw, "<u8", checkpoints, at).astype(np.int64), at + 8 * checkpoints
    places, at = np.frombuffer(raw, "<u8", docs, at).astype(np.int64), at + 8 * docs
    return [None if v else int(i) for i, v in zip(names, void, strict=True)], counts, code.decode(np.frombuffer(raw, np.uint8, size - 8 * docs, at), places, counts, marks)


def id_counts(tokens: DataFrame, size: int) -> np.ndarray:
    """How often each id occurs; at most one row an id and partition is shuffled, `size` rows collected."""

    def count(batches):
        total = np.zeros(size, np.int64)
        for b in batches:
            total += np.bincount(flat(b.column(0))[0].view("<u2" if size <= 65536 else "<u4"), minlength=size)
        k = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"id": k, "n": total[k]}, pa.schema([("id", pa.int64()), ("n", pa.int64())]))

    out = np.zeros(size, np.int64)
    for r in tokens.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        out[r["id"]] = r["n"]
    return out


FILES = "part int, file string, docs long, ids long, at array<long>, size array<long>"


def write_files(docs: DataFrame, path: str, end: int = 0, folder: str | None = None) -> tuple[DataFrame, np.ndarray]:
    """Encode documents in ascending doc_id order; returns (one row a file with its blocks, code lengths).

    Each text is tokenized once into a stored table; its counts give the code, each document is encoded
    where it lies, and only bits are moved, to partitions cut at quantiles of doc_id, file `part` before
    file `part + 1`. Null ids come first; equal ids are ordered by a checksum of their stored token ids. A null text is
    empty, so a document has at least the end id; equal rows are documents each. A text of any length that a string
    holds is encoded whole, in as many blocks as it needs. An empty table gives no files, and reading none gives
    no rows. Other columns are ignored.
    """

    from tokenizers import Tokenizer

    size = Tokenizer.from_file(path).get_vocab_size()
    spark = docs.sparkSession
    wide = np.dtype("<u2" if size <= 65536 else "<u4")
    tokens = store(tokenized(only(docs, {"doc_id": "long", "text": "string"}), path, end), "tokens", "zstd")
    lengths = code_lengths(id_counts(tokens, size))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = np.unique(np.array(tokens.approxQuantile("doc_id", [k / parts for k in range(1, parts)], 0.25 / parts) if parts > 1 else [], "int64"))
    shared = spark.sparkContext.broadcast(lengths)
    fields = pa.schema([("part", pa.int32()), ("doc_id", pa.int64()), ("n", pa.int64()), ("crc", pa.int64()), ("marks", pa.binary()), ("bits", pa.binary())])

    def encode(batches):
        code = Code(shared.value)
        for b in batches:
            offsets = np.concatenate(([0], np.cumsum(b.column(1).to_numpy()))).astype(np.int64)
            every, a = flat(b.column(2))[0].view(wide), 0
            while a < b.num_rows:
                z = max(a + 1, int(np.searchsorted(offsets, offsets[a] + (1 << 18), "right")) - 1)
                ends = offsets[a : z + 1] - offsets[a]
                ids = every[offsets[a] : offsets[z]]
                raw = memoryview(ids.tobytes())
                sums = [zlib.crc32(raw[x:y]) for x, y in zip((ends[:-1] * wide.itemsize).tolist(), (ends[1:] * wide.itemsize).tolist(), strict=True)]
                data, place, marks = code.encode(ids, ends)
                first = np.concatenate(([0], np.cumsum(-(-np.diff(ends) // STRIDE))))
                data, marks = data.tobytes(), marks.astype("<u8")
                doc = b.column(0).slice(a, z - a)
                part = np.searchsorted(cuts, doc.fill_null(-(2**63)).to_numpy(), "right").astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    pa.array(part), doc, b.column(1).slice(a, z - a), pa.array(sums, pa.int64()),
                    pa.array([marks[first[k] : first[k + 1]].tobytes() for k in range(z - a)], pa.binary()), pa.array([data[place[k] : place[k + 1]] for k in range(z - a)], pa.binary()),
                ], schema=fields)
                a = z
        trim()

    folder = folder or new_path(spark, "huffman")
    done = pa.schema([("part", pa.int32()), ("file", pa.string()), ("docs", pa.int64()), ("ids", pa.int64()), ("at", pa.list_(pa.int64())), ("size", pa.list_(pa.int64()))])

    def write(batches):
        out, held, part, docs, total, at, sizes = None, [], None, 0, 0, [], []

        def flush():
            counts = np.array([x["n"] for x in held], np.int64)
            bits = [x["bits"] for x in held]
            places = np.cumsum([0, *map(len, bits)][:-1]).astype("<u8").tobytes()
            a, n = out.write(pack_block([x["doc_id"] for x in held], counts, np.frombuffer(b"".join(x["marks"] for x in held), "<u8"), places + b"".join(bits)))
            at.append(a)
            sizes.append(n)
            held.clear()

        waiting = 0
        for b in batches:
            for row in b.to_pylist():
                out, part = out or Writer(folder, "ids.huf"), row["part"]
                if held and waiting + row["n"] > BLOCK:
                    flush()
                    waiting = 0
                held.append(row)
                waiting, docs, total = waiting + row["n"], docs + 1, total + row["n"]
        if out:
            flush()
            out.close()
            yield pa.RecordBatch.from_pydict({"part": [part], "file": [out.uri], "docs": [docs], "ids": [total], "at": [at], "size": [sizes]}, done)

    sent = tokens.mapInArrow(encode, "part int, doc_id long, n long, crc long, marks binary, bits binary").repartitionById(len(cuts) + 1, "part")
    return store(sent.sortWithinPartitions("doc_id", "crc", "n").mapInArrow(write, FILES), "huffman-files"), lengths


def read_files(spark: SparkSession, files: DataFrame, lengths: np.ndarray, ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of each document, decoded block by block.

    `start` counts the ids before: totals of the files (one row each) are summed on the driver, those of
    a file's blocks from their headers.
    """
    rows = sorted(files.select("part", "file", "ids").collect(), key=lambda r: r["part"])
    bases, run = [], 0
    for r in rows:
        bases.append((r["file"], run))
        run += r["ids"]
    shared = spark.sparkContext.broadcast(lengths)
    based = files.join(F.broadcast(spark.createDataFrame(bases, "file string, base long")), "file") if bases else files.withColumn("base", F.lit(0).cast("long"))

    def heads(batches):
        reader = Reader()
        for b in batches:
            for row in b.to_pylist():
                run, got = row["base"], []
                for at, size in zip(row["at"], row["size"], strict=True):
                    got.append({"file": row["file"], "at": at, "size": size, "base": run})
                    run += struct.unpack(HEAD, reader.read(row["file"], at, struct.calcsize(HEAD)))[2]
                yield pa.RecordBatch.from_pylist(got, pa.schema([("file", pa.string()), ("at", pa.int64()), ("size", pa.int64()), ("base", pa.int64())]))
        reader.close()

    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())] + [("ids", pa.binary())] * ids

    def decode(batches):
        code, reader = Code(shared.value), Reader()
        for b in batches:
            for row in b.to_pylist():
                names, counts, flat = read_block(reader.read(row["file"], row["at"], row["size"]), code)
                ends = np.concatenate(([0], np.cumsum(counts)))
                raw = [flat[ends[k] : ends[k + 1]].astype("<u4").tobytes() for k in range(len(counts))]
                cols = [pa.array(names, pa.int64()), pa.array(row["base"] + ends[:-1]), pa.array(counts), pa.array([zlib.crc32(x) for x in raw], pa.int64())]
                yield pa.RecordBatch.from_arrays(cols + [pa.array(raw, pa.binary())] * ids, schema=pa.schema(fields))
        reader.close()
        trim()

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = based.select("file", "at", "size", "base").mapInArrow(heads, "file string, at long, size long, base long").repartition(parts)
    return blocks.mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * ids)
