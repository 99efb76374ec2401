"""Removal of long strings that occur again, by suffix arrays of anchored contexts.

What repeats is a window of so many bytes, or of so many words whatever white space parts them. Every window
has one anchor: its least-hashed gram (a run of a few dozen bytes or a few words), the leftmost of equals.
Equal windows have equal anchors, so windows are compared only within groups of one anchor hash, and a
group whose anchor occurs once is done. A context is the text of the consecutive windows that share an
anchor, and every window belongs to exactly one. Equal contexts are counted, not repeated; a group of one
context that occurs again needs no sorting, as all its windows do. The other groups are dealt over shards by
anchor; a shard's distinct contexts are sorted by induction, and neighbours in its suffix array with a
window in common are repeats.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import only, store, trim
from .neardup import _mixed, word_hashes
from .suffixes import permuted_prefixes, suffix_array
from .tokens import _SPACE, flat, steps

LENGTH, GRAM, WORD_GRAM = 400, 64, 8
#: Bytes (or words) of texts hashed at a time, of one segment of a long text, bytes whose words are hashed at a
#: time, and bytes of contexts in one suffix array.
STEP, SEGMENT, PIECE, SHARD = 1 << 18, 1 << 22, 1 << 20, 3 << 20
#: Contexts of one anchor beyond which windows are counted by digest over the cluster, not in one shard.
GIANT = 4000

_BYTES = np.random.Generator(np.random.PCG64(77)).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ODD = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Windows:
    """Windows of `size` bytes, or of `size` words."""

    size: int
    words: bool = False

    @property
    def gram(self) -> int:
        """Units of a gram, a power of two: fewer for a short window, which would else have hardly a choice of anchors."""
        return min(WORD_GRAM if self.words else GRAM, 1 << max(self.size // 3, 1).bit_length() - 1)

    def edges(self, text: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(begin, end) in bytes of the first `n` windows of a context; each word of one ends with a blank."""
        if not self.words:
            return np.arange(n), np.arange(n) + self.size
        begin = np.append(0, np.flatnonzero(text == 32) + 1)
        return begin[:n], begin[self.size : self.size + n]


def word_bounds(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(begin, end) of each word of one text."""
    edge = np.diff(np.concatenate(([True], _SPACE[text], [True])).astype(np.int8))
    return np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)


def word_values(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of each word, words before each text); one long text is hashed in pieces cut at white space."""
    if len(data) <= PIECE or len(offsets) > 2:
        return word_hashes(data, offsets, lower=False)
    gaps, out, a = np.append(np.flatnonzero(_SPACE[data]), len(data)), [], 0
    while a < len(data):
        z = int(gaps[min(np.searchsorted(gaps, a + PIECE), len(gaps) - 1)])
        out.append(word_hashes(data[a:z], np.array([0, z - a]), lower=False)[0])
        a = z if z > a else len(data)
    values = np.concatenate(out)
    return values, np.array([0, len(values)])


def gram_hashes(data: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """Hash of the `gram` (a power of two) bytes, or word hashes, from each place, by doubling."""
    h, size, by = _BYTES[data] if data.dtype == np.uint8 else data, 1, int(_ODD)
    while size < gram:
        h = h[:-size] * np.uint64(by) + h[size:]
        size, by = size * 2, by * by % (1 << 64)
        h ^= h >> np.uint64(29)
    return h


def anchored(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(text, first start, starts, anchor hash, units before the anchor) of each context in the texts
    data[offsets[k]:offsets[k+1]]."""
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none, none, none
    h = _mixed(gram_hashes(data, gram))
    key = (h & ~np.uint64(0xFFFFFF)) | np.arange(len(h), dtype=np.uint64)
    w = length - gram + 1
    pad = np.concatenate((key, np.full(-len(key) % w, np.iinfo(np.uint64).max, np.uint64))).reshape(-1, w)
    ahead = np.minimum.accumulate(pad, 1).ravel()
    behind = np.minimum.accumulate(pad[:, ::-1], 1)[:, ::-1].ravel()
    least = np.minimum(behind[: len(key) - w + 1], ahead[w - 1 : len(key)])
    n = np.diff(offsets)
    starts = np.maximum(n - length + 1, 0)
    text = np.repeat(np.arange(len(n)), starts)
    place = np.arange(len(text)) - np.repeat(np.cumsum(starts) - starts, starts)
    at = (least[np.repeat(offsets[:-1], starts) + place] & np.uint64(0xFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1]))) if len(at) else none
    return text[first], place[first], np.diff(np.append(first, len(at))), h[at[first]].view(np.int64), at[first] - offsets[text[first]] - place[first]


def segments(offsets: np.ndarray, length: int = LENGTH, most: int = SEGMENT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, begin, end) of pieces whose windows make up all windows: a long text's pieces overlap by length - 1."""
    text, begin, end = [], [], []
    for k, (a, z) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        while z - a > most + length:
            text, begin, end, a = text + [k], begin + [a], end + [a + most + length - 1], a + most
        text.append(k)
        begin.append(a)
        end.append(z)
    return np.array(text, np.int64), np.array(begin, np.int64), np.array(end, np.int64)


ANCHORS = "id long, th long, at int, starts int, lead int, fp long, c long"


def _digests(view: memoryview, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64 bits of a digest of each view[begin:end]."""
    return np.frombuffer(b"".join([hashlib.blake2b(view[x:y], digest_size=8).digest() for x, y in zip(begin.tolist(), end.tolist(), strict=True)]), "<i8")


def anchors(rows: DataFrame, windows: Windows) -> DataFrame:
    """A row for each context of rows (id, th, text): place, number of windows, what lies before the anchor, anchor
    hash, context digest. Places count bytes or words."""
    schema = pa.schema([("id", pa.int64()), ("th", pa.int64()), ("at", pa.int32()), ("starts", pa.int32()), ("lead", pa.int32()), ("fp", pa.int64()), ("c", pa.int64())])
    length, gram = windows.size, windows.gram

    def each(data, offsets, ids, ths):
        text, begin, end = segments(offsets, length)
        # texts lie side by side, so a run of short ones is one slice; a piece of a long one is its own
        sizes = np.concatenate(([0], np.cumsum(end - begin)))
        for i, j in steps(sizes, STEP):
            a, runs = i, []
            while a < j:
                z = a + 1
                while z < j and begin[z] == end[z - 1]:
                    z += 1
                runs.append((a, z))
                a = z
            for a, z in runs:
                base = data[begin[a] : end[z - 1]]
                view, wide = memoryview(np.ascontiguousarray(base).view(np.uint8)), base.itemsize
                edge = np.append(begin[a:z], end[z - 1]) - begin[a]
                k, at, starts, fp, lead = anchored(base, edge, length, gram)
                low = edge[k] + at
                c = _digests(view, low * wide, (low + starts + length - 1) * wide)
                doc = text[a + k]
                at = at + begin[a + k] - offsets[doc]
                yield pa.RecordBatch.from_arrays([pa.array(ids[doc]), pa.array(ths[doc]), pa.array(at.astype(np.int32)), pa.array(starts.astype(np.int32)), pa.array(lead.astype(np.int32)), pa.array(fp), pa.array(c)], schema=schema)

    def run(batches):
        for b in batches:
            data, offsets = flat(b.column(2))
            ids, ths = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)
            for i, j in steps(offsets, PIECE) if windows.words else [(0, b.num_rows)]:
                part, edge = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                yield from each(*(word_values(part, edge) if windows.words else (part, edge)), ids[i:j], ths[i:j])

    return rows.mapInArrow(run, ANCHORS)


CONTEXTS = "fp long, c long, m long, starts int, lead int, text binary"


def contexts(rows: DataFrame, wanted: DataFrame, windows: Windows) -> DataFrame:
    """The text of each wanted (id, th, at, starts, fp, c, m), cut from its row; a row's wants go with it.
    Of words, a blank follows each."""
    each = wanted.groupBy("id", "th").agg(F.collect_list(F.struct("at", "starts", "lead", "fp", "c", "m")).alias("wants"))
    schema = pa.schema([("fp", pa.int64()), ("c", pa.int64()), ("m", pa.int64()), ("starts", pa.int32()), ("lead", pa.int32()), ("text", pa.binary())])

    def run(batches):
        for b in batches:
            data, offsets = flat(b.column(0))
            wants = b.column(1).flatten()
            many = np.diff(b.column(1).offsets.to_numpy()).tolist()
            at, starts = wants.field("at").to_numpy(), wants.field("starts").to_numpy()
            cuts, upto = [], 0
            for k, n in enumerate(many):
                text = data[offsets[k] : offsets[k + 1]]
                low, high = at[upto : upto + n], at[upto : upto + n] + starts[upto : upto + n] + windows.size - 1
                upto += n
                if windows.words:
                    begin, end = word_bounds(text)
                    cuts += [b" ".join(text[x:y].tobytes().split()) + b" " for x, y in zip(begin[low].tolist(), end[high - 1].tolist(), strict=True)]
                else:
                    cuts += [text[x:y].tobytes() for x, y in zip(low.tolist(), high.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(wants.field(c) for c in schema.names[:-1]), pa.array(cuts, pa.binary())], schema=schema)

    return rows.join(each, ["id", "th"]).select("text", "wants").mapInArrow(run, CONTEXTS)


def _letters(texts: list[bytes], windows: Windows) -> tuple[np.ndarray, np.ndarray]:
    """(a number from 2 on for each byte, or for each word by the order in which words first occur, number of them in
    each text). 0 and 1 are left for the end and the gaps; 0xFE and 0xFF never occur in UTF-8."""
    data, sizes = np.frombuffer(b"".join(texts), np.uint8), np.array([len(t) for t in texts])
    if not windows.words:
        return data + np.uint8(2), sizes
    ends = np.flatnonzero(data == 32)
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(np.append(0, ends + 1)), pa.py_buffer(data)]).dictionary_encode()
    return words.indices.to_numpy().astype(np.int64) + 2, np.diff(np.searchsorted(ends, np.append(0, np.cumsum(sizes))))


def repeated_windows(texts: list[bytes], starts: np.ndarray, copies: np.ndarray, windows: Windows = Windows(LENGTH)) -> tuple[np.ndarray, np.ndarray]:
    """(context, window) in order, of the windows that occur at least twice among all contexts' windows, a context's
    windows counting `copies` times."""
    letters, sizes = _letters(texts, windows)
    begin = np.cumsum(sizes + 1) - sizes - 1
    context = np.repeat(np.arange(len(texts)), starts)
    window = np.arange(len(context)) - np.repeat(np.cumsum(starts) - starts, starts)
    s, inner = np.ones(int(sizes.sum()) + len(texts) + 1, letters.dtype), np.ones(int(sizes.sum()) + len(texts) + 1, bool)
    inner[begin + sizes] = inner[-1] = False
    s[inner], s[-1] = letters, 0
    sa = suffix_array(s)
    common = permuted_prefixes(s, sa, int(sizes.max()) + 8, begin)[sa] >= windows.size
    weight, place = np.zeros(len(s), np.int64), begin[context] + window
    weight[place] = copies[context]
    common[0] = False
    first = np.flatnonzero(~common)
    total = np.add.reduceat(weight[sa], first)
    twice = np.zeros(len(s), bool)
    twice[sa] = np.repeat(total >= 2, np.diff(np.append(first, len(s))))
    hit = twice[place]
    return context[hit], window[hit]


def repeated_starts(texts: list[bytes], starts: np.ndarray, copies: np.ndarray, windows: Windows = Windows(LENGTH)) -> list[np.ndarray]:
    """The repeated windows of each context."""
    context, window = repeated_windows(texts, starts, copies, windows)
    return np.split(window, np.searchsorted(context, np.arange(1, len(texts))))


def _runs(context: np.ndarray, window: np.ndarray, many: int) -> pa.ListArray:
    """For each of `many` contexts, [first, last, first, last, ...] of runs of consecutive windows."""
    key = context << 32 | window  # windows are counted by 32 bits
    first = np.flatnonzero(np.diff(key, prepend=-2) != 1)
    runs = np.stack((window[first], window[np.append(first[1:], len(key))[: len(first)] - 1]), 1)
    ends = 2 * np.searchsorted(context[first], np.arange(many + 1))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(runs.ravel(), pa.int32()))


FOUND = "fp long, c long, runs array<int>"
_FOUND = pa.schema([("fp", pa.int64()), ("c", pa.int64()), ("runs", pa.list_(pa.int32()))])


def _meeting(group: list[tuple], windows: Windows) -> list[tuple]:
    """The contexts (fp, c, m, starts, lead, text) of one anchor that may hold a repeat. A window reaches half of what
    the anchor leaves of it to one side at least; where no other context has that side, it is the only one."""
    half, gram, seen, sides = (windows.size - windows.gram) // 2, windows.gram, {}, []
    for _, _, m, starts, lead, text in group:
        units = text.split(b" ") if windows.words else text
        left = (0, hash(tuple(units[lead - half : lead + gram]) if windows.words else units[lead - half : lead + gram])) if lead >= half else None
        right = (1, hash(tuple(units[lead : lead + gram + half]) if windows.words else units[lead : lead + gram + half])) if lead - starts + 1 < half else None
        sides.append((left, right))
        for side in (left, right):
            if side is not None:
                seen[side] = seen.get(side, 0) + m
    return [row for row, both in zip(group, sides, strict=True) if any(x is not None and seen[x] > 1 for x in both)]


def sorted_shards(texts: DataFrame, windows: Windows, shard: int = SHARD) -> DataFrame:
    """The repeated starts of each context (fp, c, m, starts, lead, text), from suffix arrays of whole groups."""

    def run(batches):
        def close(held):
            got = repeated_windows([h[5] for h in held], np.array([h[3] for h in held]), np.array([h[2] for h in held]), windows)
            return pa.RecordBatch.from_arrays([pa.array([h[0] for h in held], pa.int64()), pa.array([h[1] for h in held], pa.int64()), _runs(*got, len(held))], schema=_FOUND)

        def groups():
            group = []
            for b in batches:
                for row in zip(*(b.column(k).to_pylist() for k in range(6)), strict=True):
                    if group and row[0] != group[-1][0]:
                        yield _meeting(group, windows)
                        group = []
                    if not group or row[1] != group[-1][1]:  # else a repeated row's context
                        group.append(row)
            if group:
                yield _meeting(group, windows)

        held, size = [], 0
        for group in groups():
            more = sum(len(row[5]) + 1 for row in group)
            if held and size + more > shard:
                yield close(held)
                held, size = [], 0
            held += group
            size += more
        if held:
            yield close(held)
        trim()

    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return texts.repartition(parts, "fp").sortWithinPartitions("fp", "c").mapInArrow(run, FOUND)


def counted_windows(texts: DataFrame, windows: Windows) -> DataFrame:
    """The same for groups too large for a shard: their windows are counted by 128-bit digest."""
    schema = pa.schema([("fp", pa.int64()), ("c", pa.int64()), ("m", pa.int64()), ("at", pa.int32()), ("w1", pa.int64()), ("w2", pa.int64())])

    def run(batches):
        for b in batches:
            for row in zip(*(b.column(k).to_pylist() for k in range(6)), strict=True):
                view, n = memoryview(row[5]), row[3]
                begin, end = windows.edges(np.frombuffer(view, np.uint8), n)
                d = np.frombuffer(b"".join(hashlib.blake2b(view[x:y], digest_size=16).digest() for x, y in zip(begin.tolist(), end.tolist(), strict=True)), "<i8").reshape(n, 2)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, row[0])), pa.array(np.full(n, row[1])), pa.array(np.full(n, row[2])), pa.array(np.arange(n, dtype=np.int32)), pa.array(d[:, 0].copy()), pa.array(d[:, 1].copy())], schema=schema)

    rows = texts.dropDuplicates(["fp", "c"]).mapInArrow(run, "fp long, c long, m long, at int, w1 long, w2 long")
    twice = rows.groupBy("fp", "w1", "w2").agg(F.sum("m").alias("n")).filter("n >= 2").drop("n")
    back = rows.join(twice, ["fp", "w1", "w2"]).groupBy("fp", "c").agg(F.sort_array(F.collect_list("at")).alias("ats"))
    return back.select("fp", "c", F.flatten(F.transform("ats", lambda x: F.array(x, x))).alias("runs"))


def _spans(found: pa.ListArray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(merged [begin, end) spans, in bytes or words, of the repeated windows of a batch of texts; spans before each
    text). `found` holds a list of (at, runs) for each text, or null."""
    each, many = found.flatten(), pc.fill_null(pc.list_value_length(found), 0).to_numpy()
    runs = each.field("runs")
    pairs = runs.flatten().to_numpy().astype(np.int64).reshape(-1, 2)
    times = pc.list_value_length(runs).to_numpy() // 2
    text = np.repeat(np.repeat(np.arange(len(found)), many), times) << 32  # places are 32 bits wide, so texts stay apart
    at = np.repeat(each.field("at").to_numpy().astype(np.int64), times) + text
    begin, end = at + pairs[:, 0], at + pairs[:, 1] + size
    by = np.argsort(begin, kind="stable")
    begin, far = begin[by], np.maximum.accumulate(end[by])
    first = np.flatnonzero(np.concatenate(([True], begin[1:] > far[:-1]))) if len(begin) else np.zeros(0, np.int64)
    spans = np.stack((begin[first], far[np.append(first[1:], len(far))[: len(first)] - 1]), 1)
    upto = np.searchsorted(spans[:, 0], np.arange(len(found) + 1) << 32)
    return spans - (spans[:, :1] >> 32 << 32), upto


def _found_spans(rows: DataFrame, windows: Windows) -> DataFrame:
    """(id, th, found): where each of the rows (id, th, text) has windows that repeat."""
    marks = store(anchors(rows, windows), "anchors", "zstd")
    groups = marks.groupBy("fp", "c").agg(F.count(F.lit(1)).alias("m"), *(F.first(k).alias(k) for k in ("id", "th", "at", "starts", "lead")))
    shared = groups.groupBy("fp").agg(F.sum("m").alias("total"), F.count(F.lit(1)).alias("kinds")).filter("total >= 2").drop("total")
    wanted = store(groups.join(shared, "fp"), "wanted", "zstd")
    whole = wanted.filter("kinds = 1").select("fp", "c", F.array(F.lit(0), F.col("starts") - 1).alias("runs"))
    wanted = wanted.filter("kinds > 1")
    giant = wanted.filter(F.col("kinds") > GIANT).select(F.col("fp").alias("big")).distinct()
    texts = store(contexts(rows, wanted, windows).join(giant, F.col("fp") == F.col("big"), "left"), "contexts", "zstd")
    found = sorted_shards(texts.filter("big is null").drop("big"), windows)
    if wanted.filter(F.col("kinds") > GIANT).limit(1).count():
        found = found.unionByName(counted_windows(texts.filter("big is not null").drop("big"), windows))
    found = store(found.filter(F.size("runs") > 0).unionByName(whole), "found", "zstd")
    return marks.join(found, ["fp", "c"]).groupBy("id", "th").agg(F.collect_set(F.struct("at", "runs")).alias("found"))


def _keyed(docs: DataFrame) -> tuple:
    """The columns that tell rows apart: doc_id, or the least long where it is null, and a hash of the text."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("id"), F.xxhash64(F.col("text").cast("string")).alias("th")


def _kept(text: np.ndarray, cut: np.ndarray, windows: Windows) -> bytes:
    """What stays of a text. With a span of words goes the white space after it."""
    if not len(cut):
        return text.tobytes()
    if windows.words:
        begin, end = word_bounds(text)
        cut = np.append(begin, end[-1])[cut]
    edges = np.concatenate(([0], cut.ravel(), [len(text)])).reshape(-1, 2)
    return b"".join(text[x:y].tobytes() for x, y in edges.tolist())


def strip_repeats(docs: DataFrame, length: int = LENGTH, words: int | None = None) -> DataFrame:
    """`docs`, all its columns, with texts less their repeated spans (see remove_repeats): of `length` bytes, whose
    cut characters go too, or, if `words` is given, of so many words, whatever white space is between them.
    n_chars, if there is one, is counted anew.

    Defined cases: a null text stays null; a text shorter than a window stays as it is, and one that repeats as a
    whole becomes empty; equal rows are each other's copies, whether or not they share a doc_id; a null doc_id
    stays null; an empty table gives no rows; a text of any length is worked on in pieces of SEGMENT.
    """
    windows = Windows(words, True) if words else Windows(length)
    id_, th = _keyed(docs)
    names = docs.columns
    spans = _found_spans(docs.select(id_, th, F.col("text").cast("binary").alias("text")), windows).select(F.col("id").alias("__id"), F.col("th").alias("__th"), F.col("found").alias("__found"))
    met = docs.select(*(F.col(f"`{c}`") for c in names), id_.alias("__id"), th.alias("__th")).join(spans, ["__id", "__th"], "left").select(*(F.col(f"`{c}`") for c in names), "__found")

    def run(batches):
        here = names.index("text")
        for b in batches:
            data, offsets = flat(b.column(here))
            real = b.column(here).is_valid().to_pylist()
            cuts, upto = _spans(b.column(len(names)), windows.size)
            for i, j in steps(offsets, 4 << 20):
                texts = [_kept(data[offsets[k] : offsets[k + 1]], cuts[upto[k] : upto[k + 1]], windows).decode(errors="ignore") if real[k] else None for k in range(i, j)]
                cols = [pa.array(texts, pa.string()) if k == here else b.column(k).slice(i, j - i) for k in range(len(names))]
                yield pa.RecordBatch.from_arrays(cols, names=names)
        trim()

    out = met.mapInArrow(run, docs.schema)
    out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
    return out.select(*(F.col(f"`{c}`") for c in docs.columns))


RESULT = "n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passages long, passage_words long, kept binary"


def remove_repeats(docs: DataFrame, length: int = LENGTH, keep_bytes: bool = False, words: int | None = None) -> DataFrame:
    """Each row of docs (doc_id, text) with n_bytes, n_removed, n_spans and kept_sha256, less every byte
    covered by `length` bytes that also start anywhere else in the table; with `keep_bytes`, `kept` too.
    With `words`, also n_passages and passage_words: runs, and words in them, that are covered by so many
    words that also start anywhere else, whatever white space is between them; these are counted, not removed.

    Matches never cross rows, overlaps count, and strings are judged on the input. `length` exceeds GRAM.

    Defined cases: a null text is empty; a row shorter than `length` keeps all; equal rows are each
    other's copies; rows that share a doc_id are told apart by a hash of their text; a null doc_id stays
    null; an empty table gives no rows; other columns are ignored. `kept` may end within a character's
    bytes, as spans do.
    """
    docs = only(docs, {"doc_id": "long", "text": "string"})
    rows = docs.select(*_keyed(docs), F.col("text").cast("binary").alias("text"))
    windows, passages = Windows(length), Windows(words or 1, True)
    fields = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("n_passages", pa.int64()), ("passage_words", pa.int64()), ("kept", pa.binary())])

    def run(batches):
        for b in batches:
            data, offsets = flat(b.column(1))
            cuts, upto = _spans(b.column(2), windows.size)
            runs, more = _spans(b.column(3), passages.size)
            gone, in_runs = (np.concatenate(([0], np.cumsum(x[:, 1] - x[:, 0]))) for x in (cuts, runs))
            kept = [_kept(data[offsets[k] : offsets[k + 1]], cuts[upto[k] : upto[k + 1]], windows) for k in range(b.num_rows)]
            sums = [hashlib.sha256(x).hexdigest() for x in kept]
            ids = b.column(0)
            none = pa.array(ids.to_numpy() == -(2**63))
            counts = (np.diff(offsets), np.diff(gone[upto]), np.diff(upto), sums, np.diff(more), np.diff(in_runs[more]), kept if keep_bytes else [None] * len(kept))
            yield pa.RecordBatch.from_arrays([pc.if_else(none, pa.scalar(None, pa.int64()), ids), *(pa.array(c, f.type) for c, f in zip(counts, list(fields)[1:], strict=True))], schema=fields)

    met = rows.join(_found_spans(rows, windows), ["id", "th"], "left")
    if words:
        met = met.join(_found_spans(rows, passages).withColumnRenamed("found", "more"), ["id", "th"], "left")
    else:
        met = met.withColumn("more", F.lit(None).cast("array<struct<at:int,runs:array<int>>>"))
    out = met.select("id", "text", "found", "more").mapInArrow(run, "doc_id long, " + RESULT)
    return out.drop(*([] if keep_bytes else ["kept"]), *([] if words else ["n_passages", "passage_words"]))
