"""Approximate nearest neighbours: inverted lists of coarse centroids, product-quantised residuals,
asymmetric distance tables and exact reranking, for the largest inner product.

A residual is kept in two parts: its length along the list's centroid, exact, and what is across, quantised, with
the length of the quantisation's error. So the tables bound every row of a list from above, and a row is left out
only if its bound is below rows already scored: within the lists visited nothing is lost, whatever the vectors."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import only, store

#: Rows of a list that one task holds, and queries it scores at a time.
BLOCK, AT_ONCE = 1024, 64


@dataclass(frozen=True)
class Settings:
    """`lists` 0: half the square root of the number of vectors, at most `most_lists`. `sample_rows` bounds
    what the driver fits on; every vector is indexed. The number of lists that a query visits is the least
    with which `sample_queries` queries, measured against brute force, find `recall` of their neighbours."""

    lists: int = 0
    most_lists: int = 16_384
    parts: int = 16
    codes: int = 256
    sample_rows: int = 20_000
    recall: float = 0.97
    sample_queries: int = 128
    seed: int = 5


@dataclass(frozen=True)
class Index:
    """What is sent to every task: centroids (augmented), codebooks [parts, codes, width], list sizes and spreads.
    Its size is bounded by most_lists, codes and the vectors' dimension."""

    centroids: np.ndarray
    books: np.ndarray
    norm: float
    sizes: np.ndarray
    spread: np.ndarray
    settings: Settings


def usable(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, v ARRAY<DOUBLE>): not null, of the commonest length (the smaller one, if tied), finite
    throughout, not zero."""
    rows = only(vectors, {key: "long", vector: "array<double>"}).select(F.col(key).alias("vec_id"), F.col(vector).alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & fine)
    size = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    rows = rows.filter(F.size("v") == (size["n"] if size else 0))
    return rows


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    out, half = np.empty(len(x), np.int64), (centres**2).sum(1) / 2
    step = max(64, (8 << 20) // len(centres))  # 64 MB of products
    for k in range(0, len(x), step):
        out[k : k + step] = np.argmax(x[k : k + step] @ centres.T - half, 1)
    return out


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 10) -> np.ndarray:
    distinct = np.unique(x, axis=0)
    if len(distinct) <= k:
        return distinct
    centres = distinct[rng.choice(len(distinct), k, replace=False)]
    for _ in range(rounds):
        own = _nearest(x, centres)
        count = np.bincount(own, minlength=k)
        sums = np.stack([np.bincount(own, x[:, j], k) for j in range(x.shape[1])], 1)
        centres = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], centres)
        empty = np.flatnonzero(count == 0)
        centres[empty] = x[rng.choice(len(x), len(empty))]
    return centres


def augment(x: np.ndarray, norm: float) -> np.ndarray:
    """One more dimension brings all vectors to one norm, so the largest inner product is the nearest point."""
    return np.concatenate((x, np.sqrt(np.maximum(norm**2 - (x**2).sum(1), 0))[:, None]), 1)


def _split(x: np.ndarray, parts: int) -> np.ndarray:
    width = -(-x.shape[1] // parts)
    return np.pad(x, ((0, 0), (0, parts * width - x.shape[1]))).reshape(len(x), parts, width)


def _across(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Residuals against each row's centroid: their lengths along its direction, and what is left across."""
    rest = x - centroids
    toward = centroids / np.maximum(np.sqrt((centroids**2).sum(1)), 1e-300)[:, None]
    along = (rest * toward).sum(1)
    return along, rest - along[:, None] * toward


def build(vectors: DataFrame, settings: Settings = Settings()) -> tuple[DataFrame, Index | None]:
    """(stored rows (vec_id, list, codes, along, error, v), index) over all usable vectors; None for no vectors."""
    norms = vectors.agg(F.count(F.lit(1)).alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)).alias("m")).first()
    if not norms["n"]:
        return vectors, None
    norm, rng = float(norms["m"]) ** 0.5, np.random.default_rng(settings.seed)
    sample = vectors.orderBy(F.xxhash64(F.lit(settings.seed), F.col("vec_id")), "vec_id").limit(settings.sample_rows).select("v").toArrow()
    x = np.concatenate([_matrix(c) for c in sample.column(0).chunks])
    lists = settings.lists or max(1, min(settings.most_lists, round(norms["n"] ** 0.5 / 2)))
    centroids = _kmeans(augment(x, norm), lists, rng)
    # residuals are quantised in units of their list's spread, so that a list of near copies is told apart too
    own = _nearest(augment(x, norm), centroids)
    _, rest = _across(x, centroids[own, :-1])
    power, count = np.bincount(own, (rest**2).sum(1), len(centroids)), np.bincount(own, minlength=len(centroids))
    spread = np.sqrt(np.where(power > 0, power / np.maximum(count, 1), max(power.sum() / max(count.sum(), 1), 1e-12)))
    rest = _split(rest / spread[own, None], settings.parts)
    books = np.zeros((settings.parts, settings.codes, rest.shape[2]))
    for p in range(settings.parts):
        found = _kmeans(rest[:, p], settings.codes, rng, 8)
        books[p, : len(found)], books[p, len(found) :] = found, found[0]
    shared = vectors.sparkSession.sparkContext.broadcast((centroids, books, norm, spread))
    parts = settings.parts

    def run(batches):
        centroids, books, norm, spread = shared.value
        schema = pa.schema([("vec_id", pa.int64()), ("list", pa.int32()), ("codes", pa.binary()), ("along", pa.float64()), ("error", pa.float64()), ("v", pa.list_(pa.float64()))])
        for b in batches:
            if b.num_rows:
                x = _matrix(b.column(1))
                own = _nearest(augment(x, norm), centroids)
                along, rest = _across(x, centroids[own, :-1])
                rest = _split(rest / spread[own, None], parts)
                codes = np.stack([_nearest(rest[:, p], books[p]) for p in range(parts)], 1)
                error = np.sqrt(((rest - books[np.arange(parts), codes]) ** 2).sum((1, 2))) * spread[own]
                codes = codes.astype(np.uint8)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(own.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(along), pa.array(error), b.column(1)], schema=schema)

    rows = store(vectors.select("vec_id", "v").mapInArrow(run, "vec_id long, list int, codes binary, along double, error double, v array<double>"), "ivf")
    sizes = np.zeros(len(centroids), np.int64)
    for r in rows.groupBy("list").count().collect():  # one row a list
        sizes[r["list"]] = r["count"]
    return rows, Index(centroids, books, norm, sizes, spread, settings)


def visiting_order(q: np.ndarray, index: Index) -> np.ndarray:
    """The lists of each query, nearest centroid first, with queries scaled to the vectors' common norm."""
    unit = q * (index.norm / np.sqrt((q**2).sum(1)))[:, None]
    return np.argsort(-(unit @ index.centroids[:, :-1].T - (index.centroids**2).sum(1) / 2), 1, kind="stable")


def needed_visits(queries: DataFrame, rows: DataFrame, index: Index, top: int) -> int:
    """Lists to visit for the wanted recall: a bounded sample of queries is answered by brute force over
    all rows (in blocks), and the places of the true neighbours' lists in the visiting order decide."""
    s = index.settings
    asked = queries.orderBy(F.xxhash64(F.lit(s.seed), F.col("vec_id")), "vec_id").limit(s.sample_queries).toArrow()
    if not asked.num_rows:
        return 1
    asked = asked.combine_chunks()
    ids, q = asked.column(0).to_numpy(), np.concatenate([_matrix(c) for c in asked.column(1).chunks])
    shared = queries.sparkSession.sparkContext.broadcast((ids, q))

    def run(batches):
        ids, q = shared.value
        schema = pa.schema([("k", pa.int32()), ("list", pa.int32()), ("vec_id", pa.int64()), ("score", pa.float64())])
        for b in batches:
            if b.num_rows:
                mine, lists = b.column(0).to_numpy(), b.column(1).to_numpy()
                score = np.where(mine[None, :] == ids[:, None], -np.inf, q @ _matrix(b.column(2)).T)
                best = np.argsort(-score, 1, kind="stable")[:, :top]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(q), dtype=np.int32), best.shape[1])), pa.array(lists[best].ravel()), pa.array(mine[best].ravel()), pa.array(np.take_along_axis(score, best, 1).ravel())], schema=schema)

    best = rows.select("vec_id", "list", "v").mapInArrow(run, "k int, list int, vec_id long, score double")
    best = best.withColumn("rank", F.expr("row_number() over (partition by k order by score desc, vec_id)")).filter(F.col("rank") <= top).select("k", "list").toPandas()
    place = np.argsort(visiting_order(q, index), 1)[best["k"].to_numpy(), best["list"].to_numpy()]
    return int(np.sort(place)[max(0, int(np.ceil(s.recall * len(place))) - 1)]) + 1


def search(queries: DataFrame, rows: DataFrame, index: Index, top: int) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's `top` nearest rows found, its own id left out.

    A query goes to the lists nearest to it, and to further ones while they hold too few rows. A list is
    split into blocks of about BLOCK rows and a task holds one block, with queries streaming by. In a
    block the distance tables estimate all rows and bound them from above. The first `top` by estimate are scored on
    the original vectors, then all rows whose bound reaches the least of these, and the best `top` leave the
    block. Ties go to the smaller vec_id.
    """
    shared, visits = queries.sparkSession.sparkContext.broadcast(index), needed_visits(queries, rows, index, top)

    def probe(batches):
        i = shared.value
        schema = pa.schema([("query_id", pa.int64()), ("v", pa.list_(pa.float64())), ("lists", pa.list_(pa.int32()))])
        for b in batches:
            if b.num_rows:
                step = max(64, (2 << 20) // len(i.centroids))  # an order of 16 MB at a time
                for k in range(0, b.num_rows, step):
                    part = b.slice(k, step)
                    order = visiting_order(_matrix(part.column(1)), i)
                    have = np.cumsum(i.sizes[order], 1)
                    upto = np.maximum(visits, np.minimum((have < top + 1).sum(1) + 1, len(i.centroids)))
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([o[:u].astype(np.int32) for o, u in zip(order, upto, strict=True)], pa.list_(pa.int32()))], schema=schema)

    blocks = rows.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    data = rows.join(F.broadcast(blocks), "list").select("list", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int").alias("block"), F.lit(0).alias("role"), F.col("vec_id").alias("id"), "codes", "along", "error", "v")
    asked = queries.select(F.col("vec_id").alias("query_id"), "v").mapInArrow(probe, "query_id long, v array<double>, lists array<int>").withColumn("list", F.explode("lists"))
    asked = asked.join(F.broadcast(blocks), "list").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    asked = asked.select("list", "block", F.lit(1).alias("role"), F.col("query_id").alias("id"), F.lit(None).cast("binary").alias("codes"), F.lit(None).cast("double").alias("along"), F.lit(None).cast("double").alias("error"), "v")

    def run(batches):
        i = shared.value
        schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
        key, held, vectors = None, [], None
        ids = codes = along = error = longest = None

        def score(q_ids, q):
            parts, at = i.settings.parts, key[0]
            centroid, spread = i.centroids[at, :-1], i.spread[at]
            toward = centroid / max(np.sqrt((centroid**2).sum()), 1e-300)
            straight = q @ toward
            side = q - straight[:, None] * toward
            table = np.einsum("qpw,pcw->qpc", _split(side, parts), i.books)
            near = (q @ centroid)[:, None] + straight[:, None] * along + spread * sum(table[:, p, codes[:, p]] for p in range(parts))
            length = np.sqrt((q**2).sum(1))
            slack = 1e-9 * length * longest  # far above rounding
            bound = near + np.sqrt((side**2).sum(1))[:, None] * error + slack[:, None]
            own = ids[None, :] == q_ids[:, None]
            near[own] = bound[own] = -np.inf
            some = min(top, len(ids))
            first = np.argpartition(-near, some - 1, 1)[:, :some]
            least = np.where(np.take_along_axis(own, first, 1), -np.inf, (vectors[first] * q[:, None, :]).sum(2)).min(1)
            open_ = ~(bound < least[:, None]) & ~own
            rows = np.flatnonzero(open_.any(0))
            value = np.where(open_[:, rows], q @ vectors[rows].T, -np.inf)
            if len(rows) > top:  # products of equal vectors may differ in their last digit, so equals are kept until they are summed alike
                value[value < np.partition(value, -top, 1)[:, -top, None] - slack[:, None]] = -np.inf
            which, place = np.nonzero(value > -np.inf)
            place = rows[place]
            exact = np.concatenate([(vectors[place[k : k + 16384]] * q[which[k : k + 16384]]).sum(1) for k in range(0, len(place), 16384)] or [np.zeros(0)])
            by = np.lexsort((ids[place], -exact, which))
            which, place, exact = which[by], place[by], exact[by]
            best = np.arange(len(which)) - np.searchsorted(which, which) < top
            return pa.RecordBatch.from_arrays([pa.array(q_ids[which[best]]), pa.array(ids[place[best]]), pa.array(exact[best])], schema=schema)

        for b in batches:
            place = list(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True))
            k = 0
            while k < len(place):
                j = k
                while j < len(place) and place[j] == place[k] and (place[k][2] == 0 or j - k < AT_ONCE):
                    j += 1
                part = b.slice(k, j - k)
                if place[k][:2] != key:
                    key, held, vectors = place[k][:2], [], None
                if place[k][2] == 0:
                    held.append((part.column(3).to_numpy(), np.frombuffer(b"".join(part.column(4).to_pylist()), np.uint8).reshape(j - k, -1), part.column(5).to_numpy(), part.column(6).to_numpy(), _matrix(part.column(7))))
                elif held:
                    if vectors is None:
                        ids, codes, along, error, vectors = (np.concatenate(c) for c in zip(*held, strict=True))
                        longest = np.sqrt((vectors**2).sum(1).max())
                    yield score(part.column(3).to_numpy(), _matrix(part.column(7)))
                k = j

    parts = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = data.unionByName(asked).repartition(parts, "list", "block").sortWithinPartitions("list", "block", "role", "id").mapInArrow(run, "query_id long, vec_id long, score double")
    ranked = met.distinct().withColumn("rank", F.expr("cast(row_number() over (partition by query_id order by score desc, vec_id) as int)")).filter(F.col("rank") <= top)
    return ranked.select("query_id", "rank", "vec_id", "score")


def nearest(vectors: DataFrame, every: int, top: int, settings: Settings = Settings()) -> DataFrame:
    """`search` for the rows whose vec_id is divisible by `every`, against all rows of (vec_id, embedding).

    Defined cases: null vec_ids, and vectors that are null, zero, of another than the commonest length or
    with null or non-finite components, take no part; equal rows count once, and rows that share a vec_id
    are never each other's candidates; an empty table gives no rows; other columns are ignored.
    """
    rows, index = build(store(usable(vectors), "vectors"), settings)
    if index is None:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return search(rows.filter(F.col("vec_id") % every == 0).select("vec_id", "v"), rows, index, top)
