"""Near-duplicates by SetSketch registers: banding, joint likelihood, exact verification.

A document is its set of distinct 5-word shingles, told apart by 64-bit hashes. Documents with one set are
one class; only a class's representative is compared. Representatives that share a band of registers are
candidates. Each bucket first yields a star around its least member, so its cost is linear. After those
links are verified and joined, only buckets whose members still lie in different components matter; while
they are large, they yield stars around other members, and in the end all their pairs between different
components are compared, on registers and then on sets. So no link is left out, and a large group of
copies, once joined, costs no pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import only, release, store, trim
from .components import components
from .tokens import _LOWER, _SPACE, flat, steps

WORDS, BANDS, ROWS = 5, 40, 6
#: SetSketch parameters: base, rate and largest register.
BASE, RATE, TOP = 1.001, 20.0, 65535
#: Rounds of stars at most (they end when under a hundredth of a star's pairs are links), and pairs for each row of the mixed buckets below which all pairs are compared.
ROUNDS, FEW = 8, 4
#: An estimate further below the threshold than so many of its standard deviations is no link (3 in 100,000).
DEVIATIONS = 4.0
#: Keys at or above stand for rows without a doc_id.
NO_ID = 1 << 62

_RNG = np.random.Generator(np.random.PCG64(20240607))
_A = _RNG.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32) | np.uint32(1)
_B = _RNG.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)
_POWER = _RNG.integers(0, 1 << 63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(x: np.ndarray, by: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(by)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of each word, words before each text): A-Z in lower case, words of non-space bytes."""
    data = _LOWER[data] if lower else data
    word = ~_SPACE[data]
    start = word.copy()
    start[1:] &= ~word[:-1]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    start[inner] = word[inner]
    kept = np.flatnonzero(word)
    first = np.flatnonzero(start[kept])
    if not len(first):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    size = np.diff(np.append(first, len(kept)))
    power = np.cumprod(np.full(int(size.max()), _POWER[0]), dtype=np.uint64)
    value = (data[kept].astype(np.uint64) + np.uint64(1)) * power[np.arange(len(kept)) - np.repeat(first, size)]
    return _mixed(np.add.reduceat(value, first)), np.searchsorted(kept[first], offsets)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; a text of fewer words has its whole sequence as one."""
    hashes, ends = word_hashes(data, offsets)
    n = len(hashes)
    long = np.zeros(max(n - words + 1, 0), np.uint64)
    for k in range(words):
        long += hashes[k : k + len(long)] * _POWER[k + 1]
    long, out = _mixed(long), []
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        if b - a >= words:
            x = np.sort(long[a : b - words + 1])
            out.append(x[np.concatenate(([True], x[1:] != x[:-1]))])
        elif b > a:
            out.append(_mixed(np.atleast_1d((hashes[a:b] * _POWER[1 : b - a + 1]).sum(dtype=np.uint64) + np.uint64(b - a)), 0xD6E8FEB86659FD93))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def registers(shingles: np.ndarray) -> np.ndarray:
    """Minima of BANDS * ROWS hash functions; `spaced` turns them into registers."""
    h, low = (shingles >> np.uint64(32)).astype(np.uint32), np.full(len(_A), 0xFFFFFFFF, np.uint32)
    for k in range(0, len(h), 512):
        x = np.multiply.outer(h[k : k + 512], _A)
        x += _B
        np.minimum(low, x.min(0), out=low)
    return low


def spaced(low: np.ndarray) -> np.ndarray:
    """SetSketch registers: floor(1 - log_BASE of an exponential minimum of rate RATE), cut to [0, TOP].
    The larger register of two sketches is the register of the union."""
    x = -np.log1p(-(low.astype(np.float64) + 0.5) / 2.0**32) / RATE
    return np.clip(np.floor(1 - np.log(x) / np.log(BASE)), 0, TOP).astype(np.uint16)


def band_keys(regs: np.ndarray) -> np.ndarray:
    """[documents, BANDS] 64-bit keys of the bands' register values."""
    r = regs.reshape(len(regs), BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * _POWER[9], r.shape[:2]).copy()
    for k in range(ROWS):
        key = _mixed(key + (r[:, :, k] + np.uint64(1)) * _POWER[10 + k % 6])
    return key.view(np.int64)


def joint_estimate(u: np.ndarray, v: np.ndarray, nu: np.ndarray, nv: np.ndarray) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity of pairs of sketches [pairs, registers] with set sizes.

    With p(x) = -log_BASE(1 - x (BASE-1)/BASE), a register is larger on the left with probability
    p(a - bJ) and on the right with p(b - aJ), where a and b are the sizes' shares.
    """
    more, less = (u > v).sum(1), (u < v).sum(1)
    same = u.shape[1] - more - less
    a, b = nu / (nu + nv), nv / (nu + nv)
    p = lambda x: np.maximum(-np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE), 1e-12)

    def worth(j):
        x, y = p(a - b * j), p(b - a * j)
        return more * np.log(x) + less * np.log(y) + same * np.log(np.maximum(1 - x - y, 1e-12))

    low, high = np.zeros(len(u)), np.minimum(a / b, b / a)
    for _ in range(40):  # the likelihood has one peak
        m1, m2 = low + (high - low) * 0.382, low + (high - low) * 0.618
        up = worth(m1) < worth(m2)
        low, high = np.where(up, m1, low), np.where(up, high, m2)
    return (low + high) / 2


def sketches(docs: DataFrame) -> DataFrame:
    """(key, n, d1, d2, regs) of rows (key, text): set size, 128-bit set digest, registers."""
    schema = pa.schema([("key", pa.int64()), ("n", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("regs", pa.binary())])

    def run(batches):
        for b in batches:
            data, offsets = flat(b.column(1))
            for i, j in steps(offsets, 1 << 19):
                sets = shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                n = np.array([len(s) for s in sets], np.int64)
                d1 = np.array([_mixed(s).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
                d2 = np.array([_mixed(s, 0xC2B2AE3D27D4EB4F).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
                low = np.stack([registers(s) for s in sets])
                regs = spaced(low).astype("<u2")
                raw = pa.BinaryArray.from_buffers(pa.binary(), j - i, [None, pa.py_buffer((np.arange(j - i + 1) * regs.shape[1] * 2).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(regs))])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(n), pa.array(d1), pa.array(d2), raw], schema=schema)

    return docs.mapInArrow(run, "key long, n long, d1 long, d2 long, regs binary")


def _regs(column: pa.Array) -> np.ndarray:
    data, offsets = flat(column)
    return data.view("<u2").reshape(len(column), -1)


def banded(reps: DataFrame) -> DataFrame:
    """(band, node, n): a row for each representative and band."""
    schema = pa.schema([("band", pa.int64()), ("node", pa.int64()), ("n", pa.int64())])

    def run(batches):
        for b in batches:
            if b.num_rows:
                keys = band_keys(_regs(b.column(2)))
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(b.column(0).to_numpy(), BANDS)), pa.array(np.repeat(b.column(1).to_numpy(), BANDS))], schema=schema)

    return reps.select("node", "n", "regs").mapInArrow(run, "band long, node long, n long")


_PAIRS = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def likely(pairs: DataFrame, reps: DataFrame, least: float) -> DataFrame:
    """The pairs (u, v) whose estimated similarity is at least `least`."""

    def run(batches):
        for b in batches:
            if b.num_rows:
                got = joint_estimate(_regs(b.column(4)), _regs(b.column(5)), b.column(2).to_numpy(), b.column(3).to_numpy())
                yield b.select([0, 1]).filter(pa.array(got >= least))

    left = reps.select(F.col("node").alias("u"), F.col("n").alias("nu"), F.col("regs").alias("ru"))
    right = reps.select(F.col("node").alias("v"), F.col("n").alias("nv"), F.col("regs").alias("rv"))
    return pairs.select("u", "v").join(left, "u").join(right, "v").select("u", "v", "nu", "nv", "ru", "rv").mapInArrow(run, "u long, v long")


def verified(pairs: DataFrame, texts: DataFrame, percent: int, chunk: int = 500) -> DataFrame:
    """The pairs whose whole sets reach 100 * intersection >= percent * union.

    A pair's left text goes before its right texts in sorted order, so a task holds one left set and
    streams the others; a left text with many partners is dealt to a salt for each `chunk` of them.
    """
    salts = pairs.groupBy("u").agg(F.ceil(F.count(F.lit(1)) / chunk).cast("int").alias("salts"))
    right = pairs.join(salts, "u").select("u", F.pmod(F.hash("v", "u"), F.col("salts")).alias("salt"), "v")
    right = right.join(texts.select(F.col("node").alias("v"), "text"), "v").select("u", "salt", "v", "text")
    left = salts.join(texts.select(F.col("node").alias("u"), "text"), "u").select("u", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(None).cast("long").alias("v"), "text")

    def run(batches):
        where, base = None, np.zeros(0, np.uint64)
        for b in batches:
            data, offsets = flat(b.column(3))
            us, ss, vs = (b.column(k).to_pylist() for k in range(3))
            for i, j in steps(offsets, 1 << 19):
                got = []
                sets = shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                for k, x in zip(range(i, j), sets, strict=True):
                    if vs[k] is None:
                        where, base = (us[k], ss[k]), x
                        continue
                    assert where == (us[k], ss[k])
                    at = np.minimum(np.searchsorted(base, x), max(len(base) - 1, 0))
                    both = int((base[at] == x).sum()) if len(base) else 0
                    if both and 100 * both >= percent * (len(base) + len(x) - both):
                        got.append((us[k], vs[k]))
                yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.int64())], schema=_PAIRS)

    parts = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = left.unionByName(right).repartition(parts, "u", "salt").sortWithinPartitions("u", "salt", F.col("v").asc_nulls_first())
    return rows.mapInArrow(run, "u long, v long")


def crossing(rows: DataFrame, percent: int, least: float, block: int = 512) -> DataFrame:
    """Likely pairs between different components in one bucket, from rows (band, node, n, comp, regs), each
    pair in the first band that it shares.

    A bucket is split into blocks of about `block` rows and each pair of blocks is one group, so no task
    holds more than two blocks; all pairs of the bucket meet in some group.
    """
    counts = rows.groupBy("band").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    rows = rows.join(counts, "band").withColumn("mine", F.pmod(F.hash("node"), F.col("blocks")))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("band", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "node", "n", "comp", "regs")

    def pairs(group: dict) -> pa.RecordBatch:
        n, comp, node, regs = (np.array(group[k]) for k in ("n", "comp", "node", "regs"))
        mine, same = np.array(group["mine"]), group["key"][1] == group["key"][2]
        index = int(np.flatnonzero(band_keys(regs[:1])[0] == group["key"][0])[0])
        us, vs = [], []
        for k in range(len(n)):
            near = (comp != comp[k]) & (100 * np.minimum(n, n[k]) >= percent * np.maximum(n, n[k])) & (node > node[k]) & (same | (mine != mine[k]))
            near = np.flatnonzero(near)
            if len(near):
                same_band = (regs[near] == regs[k]).reshape(len(near), BANDS, ROWS).all(2)
                near = near[same_band.argmax(1) == index]
            if len(near):
                fine = joint_estimate(np.broadcast_to(regs[k], (len(near), regs.shape[1])), regs[near], np.full(len(near), n[k]), n[near]) >= least
                us += [node[k]] * int(fine.sum())
                vs += node[near[fine]].tolist()
        return pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], schema=_PAIRS)

    def run(batches):
        group = None
        for b in batches:
            cols = [b.column(k).to_pylist() for k in range(7)]
            regs = _regs(b.column(7))
            for k, key in enumerate(zip(cols[0], cols[1], cols[2], strict=True)):
                if group is None or group["key"] != key:
                    if group:
                        yield pairs(group)
                    group = {"key": key, "mine": [], "node": [], "n": [], "comp": [], "regs": []}
                for name, c in (("mine", 3), ("node", 4), ("n", 5), ("comp", 6)):
                    group[name].append(cols[c][k])
                group["regs"].append(regs[k])
        if group:
            yield pairs(group)
        trim()

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "band", "i", "j").sortWithinPartitions("band", "i", "j").mapInArrow(run, "u long, v long")


def apart(multi: DataFrame, comps: DataFrame) -> DataFrame:
    """Rows (band, node, n, comp) of the buckets that hold more than one component."""
    placed = multi.select("band", "node", "n").join(comps, "node", "left").withColumn("comp", F.coalesce("component", "node")).drop("component")
    mixed = placed.groupBy("band").agg(F.min("comp").alias("a"), F.max("comp").alias("b")).filter("a < b").select("band")
    return placed.join(mixed, "band", "left_semi").select("band", "node", "n", "comp")


def near_duplicates(docs: DataFrame, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of docs (doc_id, text).

    Rows are linked when their shingle sets have 100 * intersection >= percent * union; component_id is
    the smallest doc_id reachable and kept marks the row that bears it. Links are confirmed on whole sets;
    a pair at the threshold shares no band with a probability under 1e-8 at 85 and 2e-5 at 80 percent, and is
    estimated below the cut with 3e-5.

    Defined cases: null, empty and blank texts have empty sets and are linked with nothing; rows that
    share a doc_id are one document; a row without doc_id counts after all ids, and a component of such
    rows alone has a null component_id, each of its distinct texts' least key being kept; an empty table
    gives no rows; other columns are ignored.
    """
    docs = only(docs, {"doc_id": "long", "text": "string"})
    own, real = _grouped(docs.select(_key(docs), "text"), percent), lambda c: F.when(F.col(c) < NO_ID, F.col(c))
    return own.select(real("key").alias("doc_id"), F.col("n").alias("n_shingles"), real("component").alias("component_id"), (F.col("key") == F.col("component")).alias("kept"))


def without_near_duplicates(docs: DataFrame, percent: int = 80) -> DataFrame:
    """`docs`, all its columns, less all but one row of each group of linked texts (see near_duplicates; the one of
    least id).

    Defined cases: rows without words are linked with nothing and stay; equal rows are one, which stays once if its
    group has no lesser id; of rows that share a doc_id but not the text each is a document of its own, the
    one of least text hash bearing the id and the others coming after all ids, as rows without doc_id do;
    an empty table gives no rows; texts of any length count whole.
    """
    names, word = docs.columns, F.coalesce(F.col("text").cast("string").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    rows = docs.withColumn("__h", F.xxhash64(F.col("text").cast("string"))).withColumn("__key", _key(docs))
    ids = rows.filter(word).select(F.col("doc_id").cast("long").alias("__id"), "__h").groupBy("__id").agg(F.min("__h").alias("__first"), F.max("__h").alias("__last"))
    ids = ids.filter("__id is not null and __first < __last").drop("__last")
    if ids.limit(1).count():
        other = F.lit(NO_ID) + F.xxhash64("__id", "__h").bitwiseAND(F.lit(NO_ID - 1))
        rows = rows.join(ids, F.col("doc_id").cast("long") == F.col("__id"), "left").withColumn("__key", F.when(F.col("__first") != F.col("__h"), other).otherwise(F.col("__key")))
    named = rows.filter(word)
    kept = _grouped(named.select(F.col("__key").alias("key"), "text"), percent).filter("key = component").select(F.col("key").alias("__key")).distinct()
    first = named.join(kept, "__key", "left_semi").dropDuplicates(["__key"])
    return first.unionByName(rows.filter(~word)).select(*(F.col(f"`{c}`") for c in names))


def _key(docs: DataFrame):
    """doc_id, or for rows without one a number from their text that is above all ids."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID) + F.xxhash64(F.col("text").cast("string")).bitwiseAND(F.lit(NO_ID - 1))).alias("key")


def _grouped(rows: DataFrame, percent: int) -> DataFrame:
    """(key, n, component) for each of the rows (key, text)."""
    least = percent / 100 - DEVIATIONS * (percent / 100 * (1 - percent / 100) / (BANDS * ROWS)) ** 0.5
    marks = store(sketches(rows), "sketches", "zstd")
    classes = store(marks.filter("n > 0").groupBy("d1", "d2", "n").agg(F.min("key").alias("node")), "classes")
    reps = marks.join(classes.withColumnRenamed("node", "key"), ["d1", "d2", "n", "key"], "left_semi").select(F.col("key").alias("node"), "n", "regs").dropDuplicates(["node"])
    reps = store(reps, "representatives", "zstd")
    bands = banded(reps)
    shared = bands.groupBy("band").agg(F.min(F.struct("node", "n")).alias("lead"), F.max("node").alias("last")).filter("lead.node < last").select("band", "lead")
    multi = store(bands.join(shared, "band").select("band", "node", "n", "lead"), "buckets")
    texts = rows.join(multi.select(F.col("node").alias("key")).distinct(), "key", "left_semi").select(F.col("key").alias("node"), "text")
    texts = store(texts, "texts", "zstd")
    fits = 100 * F.least("n", F.col("lead.n")) >= percent * F.greatest("n", F.col("lead.n"))
    fits = lambda m: 100 * F.least("n", m) >= percent * F.greatest("n", m)
    pair = (F.least("node", "lead.node").alias("u"), F.greatest("node", "lead.node").alias("v"))
    tested = store(multi.filter((F.col("node") != F.col("lead.node")) & fits(F.col("lead.n"))).select(*pair).distinct(), "stars")
    links = store(verified(store(likely(tested, reps, least), "likely"), texts, percent), "links")
    gained = True
    for turn in range(ROUNDS + 1):
        comps = components(links)
        rest = store(apart(multi, comps), "apart")
        size = rest.groupBy("band", "comp").count().groupBy("band").agg(F.sum("count").alias("n"), F.sum(F.expr("count * count")).alias("own"))
        size = size.agg(F.sum("n").alias("rows"), F.sum(F.expr("(n * n - own) / 2")).alias("pairs")).first()  # pairs between components
        if not size["rows"]:
            break
        last = turn == ROUNDS or not gained or size["pairs"] <= FEW * size["rows"]
        if last:
            pairs = crossing(rest.join(reps.select("node", "regs"), "node").select("band", "node", "n", "comp", "regs"), percent, least)
        else:
            lead = rest.groupBy("band").agg(F.min(F.struct(F.xxhash64("node", "band", F.lit(turn)).alias("h"), "node", "n", "comp")).alias("lead"))
            pairs = rest.join(lead, "band").filter((F.col("comp") != F.col("lead.comp")) & fits(F.col("lead.n"))).select(*pair).distinct()
        pairs = store(pairs.join(tested, ["u", "v"], "left_anti"), "untested")
        release(rest)
        tested = tested.unionByName(pairs)
        found = store(verified(pairs if last else store(likely(pairs, reps, least), "likely"), texts, percent), "links")
        links, gained = links.unionByName(found), 100 * found.count() >= pairs.count()
        if last:
            comps = components(links)
            break
    own = marks.join(classes, ["d1", "d2", "n"], "left").drop("d1", "d2", "regs")
    own = own.join(comps, "node", "left").withColumn("component", F.coalesce("component", "node", "key"))
    same = own.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    if same.filter("low < high").limit(1).count():  # one doc_id with several texts joins their components
        joined = components(same.filter("low < high").select(F.col("low").alias("u"), F.col("high").alias("v")).unionByName(own.select(F.col("key").alias("u"), F.col("component").alias("v"))))
        own = own.drop("component").join(joined.withColumnRenamed("node", "key"), "key", "left").withColumn("component", F.coalesce("component", "key"))
    return own.select("key", "n", "component")
