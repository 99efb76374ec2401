"""Whole-text token ids, exactly as the tokenizers library gives them, at the cost of distinct words.

Both public vocabularies split a text at white space before they merge, so the ids of a text are those
of its chunks, where a chunk starts at each run of white space. Chunks are found and told apart by array
code, and the library encodes each distinct chunk once; a bounded memo keeps recent ones. Chunks that are one word
of Latin letters need neither normalizing nor parting, so the library's model gets them alone. Texts with Unicode spaces or a special token's opening go to the library whole, and so do all texts of a vocabulary
that is not known to part texts so (parts_at_marks looks at the file).
"""

from __future__ import annotations

import json
import os
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import trim

#: Bytes of text handled at a time, chunks in the memo, bytes of the longest of them, and long chunks kept beside.
STEP, MEMO, SHORT, LONG = 4 << 20, 1 << 20, 23, 20_000

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
#: ASCII marks that end a run of letters in both vocabularies' patterns; the apostrophe may not.
_MARK = np.zeros(256, bool)
_MARK[[k for k in range(33, 127) if not chr(k).isalnum() and k != 39]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: A chunk that both vocabularies leave whole: letters of ASCII and Latin-1, all in NFC, perhaps after a blank.
PLAIN = r"\A ?[A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{FF}]+\z"
_KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_ODD = [np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all bytes, offsets) of a string or binary column; nulls are empty."""
    if column.null_count:
        column = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def steps(offsets: np.ndarray, most: int = STEP):
    """Runs [a, b) of rows with at most `most` bytes, or of one row."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1)
        yield a, b
        a = b


def chunk_cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where chunks start: at texts, at runs of white space, after a lone one that isn't a blank, and at a
    mark after an ASCII letter."""
    space = _SPACE[data]
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = space[:-1], space[1:]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    before[inner] = False
    after[inner - 1] = False
    start = space & ~before
    lone = np.flatnonzero(start & ~after & (data != 32)) + 1
    mark = start
    mark[1:] |= _MARK[data[1:]] & _LETTER[data[:-1]]
    mark[lone[lone < len(data)]] = True
    mark[inner] = True
    if len(mark):
        mark[0] = True
    return np.append(np.flatnonzero(mark), len(data))


def odd_texts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows with a space beyond ASCII or with '<|'."""
    at = np.flatnonzero((data == 0xC2) | (data == 0xE1) | (data == 0xE2) | (data == 0xE3) | (data == 0x3C))
    at = at[at + 1 < len(data)]
    a, b, c = data[at], data[at + 1], data[np.minimum(at + 2, len(data) - 1)]
    hit = ((a == 0xC2) & ((b == 0x85) | (b == 0xA0))) | ((a == 0xE1) & (b == 0x9A) & (c == 0x80)) | ((a == 0xE3) & (b == 0x80) & (c == 0x80)) | ((a == 0x3C) & (b == 0x7C))
    hit |= (a == 0xE2) & (((b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF))) | ((b == 0x81) & (c == 0x9F)))
    return np.unique(np.searchsorted(offsets, at[hit], "right") - 1)


#: How the public vocabularies make a text ready and part it, which is what chunks rely on.
BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
WORD_NORMAL = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
WORD_SPLIT = {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}
WORD_PARTS = {"type": "Sequence", "pretokenizers": [WORD_SPLIT, {**BYTE_LEVEL, "use_regex": False}]}


def parts_at_marks(spec: dict) -> bool:
    """Whether a vocabulary is known to part texts where chunks start; others get their texts whole."""
    ready = (spec.get("normalizer"), spec.get("pre_tokenizer")) in ((None, BYTE_LEVEL), (WORD_NORMAL, WORD_PARTS))
    plain = spec["model"]["type"] == "BPE" and not spec["model"].get("dropout") and spec.get("post_processor") is None
    return ready and plain and all(t["special"] and t["content"].startswith("<|") for t in spec["added_tokens"])


def byte_letters(lower: bool) -> dict[int, int]:
    """The letter that stands for each byte of a plain chunk in byte-level vocabularies. In such a chunk only Latin-1
    capitals hold the bytes 80 to 9E, so `lower` maps these as their small letters' bytes."""
    shown = [k for k in range(256) if 33 <= k <= 126 or 161 <= k <= 172 or k >= 174]
    out = dict(zip((k for k in range(256) if k not in set(shown)), range(256, 512), strict=False)) | {k: k for k in shown}
    return out | {0: 0} | ({k: out[k + 32] for k in (*range(65, 91), *range(0x80, 0x9F))} if lower else {})


def short_keys(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Three integers for each string of at most SHORT bytes: its bytes and its length, so equal only for equal strings."""
    padded = np.concatenate((data, np.zeros(32, np.uint8)))
    eight = np.ndarray(len(padded) - 7, "<u8", padded, 0, (1,))
    out = np.empty((3, len(starts)), np.uint64)
    for k in range(3):
        np.bitwise_and(eight[starts + 8 * k], _KEEP[np.clip(sizes - 8 * k, 0, 8)], out=out[k])
    out[2] |= sizes.astype(np.uint64) << np.uint64(56)
    return out


class Memo:
    """ids of up to `most` short strings by their keys, in arrays found by hash (open addresses, at most a quarter
    of them taken). Where it is full, the half used last stays."""

    def __init__(self, wide: np.dtype, most: int = MEMO):
        self.most, self.shift = most, 64 - (4 * most - 1).bit_length()
        self.wide, self.now = wide, 0
        self._start(np.zeros((3, 0), np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, wide))

    def _start(self, keys, sizes, used, ids):
        self.slots = np.zeros(1 << (64 - self.shift), np.int32)  # entry + 1, or 0
        self.keys, self.size = np.empty((3, self.most), np.uint64), np.empty(self.most, np.int32)
        self.first, self.used = np.empty(self.most, np.int32), np.empty(self.most, np.int32)
        self.ids, self.n = np.zeros(0, self.wide), 0
        self._append(keys, sizes, used, ids)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        h = keys[0] * _ODD[0] ^ keys[1] * _ODD[1] ^ keys[2] * _ODD[2]
        return ((h ^ (h >> np.uint64(31))) * _ODD[0] >> np.uint64(self.shift)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The entry of each key, or -1."""
        self.now += 1
        out, todo, at = np.full(keys.shape[1], -1, np.int64), np.arange(keys.shape[1]), self._slot(keys)
        while len(todo):
            entry = self.slots[at].astype(np.int64) - 1
            taken = entry >= 0
            todo, at, entry = todo[taken], at[taken], entry[taken]
            same = (self.keys[0, entry] == keys[0, todo]) & (self.keys[1, entry] == keys[1, todo]) & (self.keys[2, entry] == keys[2, todo])
            out[todo[same]] = entry[same]
            todo, at = todo[~same], (at[~same] + 1) & (len(self.slots) - 1)
        self.used[out[out >= 0]] = self.now
        return out

    def _append(self, keys, sizes, used, ids):
        new = np.arange(self.n, self.n + len(sizes))
        self.keys[:, new], self.size[new], self.used[new] = keys, sizes, used
        self.first[new] = len(self.ids) + np.cumsum(sizes) - sizes
        self.ids, self.n = np.concatenate((self.ids, ids)), self.n + len(sizes)
        at = self._slot(keys)
        while len(new):
            free = self.slots[at] == 0
            self.slots[at[free]] = new[free] + 1
            lost = self.slots[at] != new + 1
            new, at = new[lost], (at[lost] + 1) & (len(self.slots) - 1)

    def add(self, keys: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> None:
        """Distinct keys that aren't held, and their ids one after the other; of too many, the first."""
        half = self.most // 2
        if self.n + len(sizes) > self.most:
            keep = np.sort(np.argsort(self.used[: self.n], kind="stable")[max(self.n - half, 0) :])
            first, size = self.first[keep].astype(np.int64), self.size[keep].astype(np.int64)
            place = np.arange(size.sum()) + np.repeat(first - (np.cumsum(size) - size), size)
            self._start(self.keys[:, keep], size, self.used[keep], self.ids[place])
            keys, sizes = keys[:, :half], sizes[:half]
        self._append(keys, sizes, np.full(len(sizes), self.now), ids[: sizes.sum()])


class Encoder:
    """ids of many texts; `wide` is the little-endian integer that holds an id."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import AddedToken, Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        if hasattr(self.tokenizer.model, "_resize_cache"):
            self.tokenizer.model._resize_cache(0)  # the memo holds what the library would
        self.size = self.tokenizer.get_vocab_size()
        self.wide = np.dtype("<u2" if self.size <= 65536 else "<u4")
        self.lower = '"Lowercase"' in self.tokenizer.to_str()
        self.chunked = parts_at_marks(json.loads(self.tokenizer.to_str()))
        special = [(t.content, i) for i, t in sorted(self.tokenizer.get_added_tokens_decoder().items()) if t.special and not (t.lstrip or t.rstrip or t.single_word or t.normalized) and "<|" in t.content]
        self.mark = special[-1] if special else None
        self.memo = Memo(self.wide)
        self.long: dict[bytes, bytes] = {}
        if self.chunked:
            bare = json.loads(self.tokenizer.to_str()) | {"normalizer": None, "pre_tokenizer": None, "post_processor": None, "added_tokens": []}
            self.bare, self.letters = Tokenizer.from_str(json.dumps(bare)), byte_letters(self.lower)
            if hasattr(self.bare.model, "_resize_cache"):
                self.bare.model._resize_cache(0)
            self.bare.add_special_tokens([AddedToken("\x00", special=True, normalized=False)])
            self.part = self.bare.token_to_id("\x00")

    def _chunks(self, texts: list[str]) -> list[bytes]:
        """ids of each chunk. A special token parts a text before anything else is done to it, so chunks
        joined by one are encoded apart in one call; chunks that may hold one belong to texts that the
        library gets whole, and their ids aren't used."""
        if self.mark is None:
            return self._library(texts)
        name, number = self.mark
        out, groups = [], [texts[k : k + 512] for k in range(0, len(texts), 512)]
        joined = [name.join("" if "<|" in t else t for t in g) for g in groups]
        size = self.wide.itemsize
        for g, e in zip(groups, self.tokenizer.encode_batch_fast(joined, add_special_tokens=False), strict=True):
            ids = np.array(e.ids, self.wide)
            raw, cuts = ids.tobytes(), (np.flatnonzero(ids == number) * size).tolist()
            assert len(cuts) == len(g) - 1
            out += [raw[a:b] for a, b in zip([0, *(c + size for c in cuts)], [*cuts, len(raw)], strict=True)]
        return out

    def _library(self, texts: list[str]) -> list[bytes]:
        code = "H" if self.wide.itemsize == 2 else "I"
        return [array(code, e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(sizes, ids) of chunks that match PLAIN. The library's model gets them alone, as byte letters; a token
        that no chunk holds stands before each."""
        joined = [b"\x00" + b"\x00".join(chunks[k : k + 64]) for k in range(0, len(chunks), 64)]
        if self.lower:
            joined = [x.replace(b" ", b"") for x in joined]
        joined = [x.decode("latin-1").translate(self.letters) for x in joined]
        parts = [np.array(e.ids, np.uint32) for e in self.bare.encode_batch_fast(joined, add_special_tokens=False)]
        ids = np.concatenate([*parts, np.zeros(0, np.uint32)])
        mark = ids == self.part
        cuts = np.flatnonzero(mark)
        assert len(cuts) == len(chunks)
        return np.diff(np.append(cuts, len(ids))) - 1, ids[~mark].astype(self.wide)

    def _any(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(sizes, ids) of any chunks; long ones are kept beside the memo."""
        if len(self.long) > LONG:
            self.long.clear()
        got = [self.long.get(c) for c in chunks]
        missing = [k for k, x in enumerate(got) if x is None]
        for k, x in zip(missing, self._chunks([chunks[k].decode() for k in missing]), strict=True):
            got[k] = x
            if len(chunks[k]) > SHORT:
                self.long[chunks[k]] = x
        return np.fromiter(map(len, got), np.int64, len(got)) // self.wide.itemsize, np.frombuffer(b"".join(got), self.wide)

    def _known(self, chunks: pa.BinaryArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first, size, table): the ids of chunk k are table[first[k] : first[k] + size[k]]."""
        data, ends = flat(chunks)
        length = np.diff(ends)
        short = np.flatnonzero(length <= SHORT)
        keys = short_keys(data, ends[short], length[short])
        entry = np.full(len(chunks), -1, np.int64)
        entry[short] = self.memo.find(keys)
        lost = np.flatnonzero(entry < 0)
        left = chunks.take(pa.array(lost))
        plain = pc.match_substring_regex(left.cast(pa.string()), PLAIN).to_numpy(zero_copy_only=False)
        lost = np.concatenate((lost[plain], lost[~plain]))
        words, others = self._words(left.filter(pa.array(plain)).to_pylist()), self._any(left.filter(pa.array(~plain)).to_pylist())
        sizes, ids = np.concatenate((words[0], others[0])), np.concatenate((words[1], others[1]))
        first, size, held = self.memo.first[entry].astype(np.int64), self.memo.size[entry].astype(np.int64), self.memo.ids
        size[lost], first[lost] = sizes, len(held) + np.cumsum(sizes) - sizes
        new = length[lost] <= SHORT
        place = np.zeros(len(chunks), np.int64)
        place[short] = np.arange(len(short))
        self.memo.add(keys[:, place[lost[new]]], sizes[new], ids[np.repeat(new, sizes)])
        return first, size, np.concatenate((held, ids))

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, offsets) for the texts data[offsets[k]:offsets[k+1]]."""
        n = len(offsets) - 1
        if not len(data):
            return np.zeros(0, self.wide), np.zeros(n + 1, np.int64)
        if not self.chunked:
            parts = self._library([data[a:z].tobytes().decode() for a, z in zip(offsets[:-1], offsets[1:], strict=True)])
            return np.frombuffer(b"".join(parts), self.wide), np.concatenate(([0], np.cumsum([len(p) // self.wide.itemsize for p in parts]))).astype(np.int64)
        whole = data
        data = _LOWER[data] if self.lower else data
        cuts = chunk_cuts(data, offsets)
        words = pa.BinaryArray.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
        first, size, table = self._known(words.dictionary)
        code = words.indices.to_numpy(zero_copy_only=False)
        # a text of 2 GB has fewer ids than an INT holds, so places fit 32 bits
        first, size = first.astype(np.int32), size.astype(np.int32)
        each = size[code]
        upto = np.concatenate(([0], np.cumsum(each, dtype=np.int32)))
        place = np.arange(upto[-1], dtype=np.int32) + np.repeat(first[code] - upto[:-1].astype(np.int32), each)
        ids, ends = table[place], upto[np.searchsorted(cuts, offsets)].astype(np.int64)
        odd = odd_texts(data, offsets)
        if len(odd):
            whole = dict(zip(odd.tolist(), self._library([whole[offsets[k] : offsets[k + 1]].tobytes().decode() for k in odd]), strict=True))
            parts = [np.frombuffer(whole[k], self.wide) if k in whole else ids[ends[k] : ends[k + 1]] for k in range(n)]
            ids, ends = np.concatenate(parts), np.concatenate(([0], np.cumsum([len(p) for p in parts])))
        return ids, ends


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each vocabulary file and worker process."""
    if path not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


TOKENS = "doc_id long, n long, ids binary"
TOKENS_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("ids", pa.binary())])


def tokenized(docs: DataFrame, path: str, end: int) -> DataFrame:
    """(doc_id, n, ids): the ids of each whole text (null: empty) and `end`, as little-endian integers of
    2 bytes (4 for vocabularies beyond 65,536). `docs` is (doc_id, text)."""

    def run(batches):
        enc = encoder(path)
        for b in batches:
            data, offsets = flat(b.column(1))
            for i, j in steps(offsets):
                ids, ends = enc.encode(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                ends = ends + np.arange(j - i + 1)  # room for the end ids
                full = np.full(ends[-1], end, enc.wide)
                keep = np.ones(len(full), bool)
                keep[ends[1:] - 1] = False
                full[keep] = ids
                spans = pa.BinaryArray.from_buffers(pa.binary(), j - i, [None, pa.py_buffer((ends * enc.wide.itemsize).astype(np.int32)), pa.py_buffer(full)])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(np.diff(ends)), spans], schema=TOKENS_SCHEMA)
        trim()

    return docs.mapInArrow(run, TOKENS)
