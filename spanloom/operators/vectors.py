"""Vector operators: normalization, exact top-k by blocks, Voronoi cells with radii, centers.

Vectors are ARRAY<DOUBLE>; those that are null, of another than the commonest length, or that hold a null or
non-finite component take no part. Similarities are rounded to 6 places before they are ranked, ties go to the
smaller id. A center table is sent to every task only after its size is checked (MAX_BROADCAST bytes);
a larger one is cut into slices, each sent on its own, and the slices' top rows are merged. A task multiplies
tiles of spans and centers, so its memory is the same for any number of either.
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_BROADCAST = 64 << 20
#: Spans and centers of a tile, and rows that a task gives at once.
ROWS, TILE, HELD = 512, 4096, 512 << 10


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def unit(v: Column) -> Column:
    return F.transform(v, lambda x: x / F.greatest(norm(v), F.lit(1e-12)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def width(rows: DataFrame, v: str) -> int:
    """The commonest length of the vectors, the smaller of two as common; 0 without vectors."""
    first = rows.filter(F.col(v).isNotNull()).groupBy(F.size(v).alias("d")).count().orderBy(F.desc("count"), "d").first()
    return first["d"] if first else 0


def usable(rows: DataFrame, v: str, d: int) -> DataFrame:
    """The rows whose vector has `d` components, all finite."""
    return rows.filter(F.col(v).isNotNull() & (F.size(v) == d) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))


def _slices(centers: DataFrame):
    """(ids, unit matrix) pieces of at most MAX_BROADCAST bytes, streamed through the driver in id order."""
    ids, rows, size = [], [], 0
    for r in centers.select("center_id", "center").orderBy("center_id").toLocalIterator(prefetchPartitions=True):
        ids.append(r["center_id"])
        rows.append(np.asarray(r["center"], float))
        size += rows[-1].nbytes
        if size >= MAX_BROADCAST:
            yield np.array(ids), np.stack(rows)
            ids, rows, size = [], [], 0
    if ids:
        yield np.array(ids), np.stack(rows)


def _unit_rows(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1), 1e-12)[:, None]


def _best(x: np.ndarray, c: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place, sim) of the k most similar rows of `c` for each row of `x`, ties to the smaller place.

    After a first tile only similarities that reach a row's k-th best so far are rounded and ranked, which are few.
    """
    n = len(x)
    row, place, sim, low = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.full(n, -np.inf)
    for at in range(0, len(c), TILE):
        s = x @ c[at : at + TILE].T
        if not at and s.shape[1] > k:
            low = np.partition(s, s.shape[1] - k, 1)[:, s.shape[1] - k]
        r, p = np.nonzero(s >= (low - 1.1e-6)[:, None])  # rounding moves two by a millionth at most
        if not len(r):
            continue
        row, place, sim = np.concatenate((row, r)), np.concatenate((place, p + at)), np.concatenate((sim, np.round(s[r, p], 6)))
        by = np.lexsort((place, -sim, row))
        row, place, sim = row[by], place[by], sim[by]
        first = np.arange(len(row)) - np.searchsorted(row, row) < k
        row, place, sim = row[first], place[first], sim[first]
        last = np.searchsorted(row, np.arange(n), "right") - 1
        low = np.where(np.bincount(row, minlength=n) >= k, sim[last], -np.inf)
    return row, place, sim


_FOUND = pa.schema([("span_id", pa.int64()), ("center_id", pa.int64()), ("sim", pa.float64())])


def _against(spans: DataFrame, centers: DataFrame, pick, most: int) -> DataFrame:
    """(span_id, center_id, sim) of the (row, place, sim) that `pick` gives for some unit spans and each slice of unit
    centers, at most `most` a span."""
    out, d = None, width(centers, "center")
    spans, centers = usable(spans, "v", d), usable(centers, "center", d)
    for ids, matrix in _slices(centers):
        shared = spans.sparkSession.sparkContext.broadcast((ids, _unit_rows(matrix)))

        def run(batches, shared=shared):
            ids, c = shared.value
            step = max(1, min(ROWS, HELD // min(most, len(c))))
            for b in batches:
                for at in range(0, b.num_rows, step):
                    part = b.slice(at, step)
                    row, place, sim = pick(_unit_rows(_matrix(part.column(1))), c)
                    yield pa.RecordBatch.from_arrays([pa.array(part.column(0).to_numpy()[row]), pa.array(ids[place]), pa.array(sim)], schema=_FOUND)

        part = spans.select("span_id", "v").mapInArrow(run, "span_id long, center_id long, sim double")
        out = part if out is None else out.unionByName(part)
    return spans.sparkSession.createDataFrame([], "span_id long, center_id long, sim double") if out is None else out


def similarities(spans: DataFrame, centers: DataFrame) -> DataFrame:
    """(span_id, center_id, sim) of every span and every center: as many rows as there are pairs, none of them ranked."""

    def every(x, c):
        sim = np.round(x @ c.T, 6)
        return np.repeat(np.arange(len(x)), len(c)), np.tile(np.arange(len(c)), len(x)), sim.ravel()

    return _against(spans, centers, every, 1 << 30)


def top_centers(spans: DataFrame, centers: DataFrame, k: int) -> DataFrame:
    """(span_id, rank from 1, center_id, sim): the k most similar centers of each span (span_id, v).

    Tiles' products run in Arrow batches; per slice of centers a span yields at most k rows.
    """
    out = _against(spans, centers, lambda x, c: _best(x, c, k), k)
    rank = F.row_number().over(Window.partitionBy("span_id").orderBy(F.desc("sim"), "center_id"))
    return out.withColumn("rank", rank).filter(F.col("rank") <= k).select("span_id", "rank", "center_id", "sim")


def cells(spans: DataFrame, centers: DataFrame) -> DataFrame:
    """(span_id, center_id, dist): the nearest center and the cosine distance to it."""
    return top_centers(spans, centers, 1).select("span_id", "center_id", F.round(1 - F.col("sim"), 6).alias("dist"))


def radii(cell_rows: DataFrame, percentile: float = 99.0, bins: int = 512) -> DataFrame:
    """(center_id, n_points, r_c, covered): a cell's radius is a percentile of its distances, interpolated
    in a histogram of [0, 2]; cells too small for the percentile to cut anything take their maximum.
    `covered` counts the points up to the histogram radius' bin."""
    bin_of = lambda d: F.least(F.lit(bins - 1), F.floor(d * bins / 2)).cast("int")
    whole = cell_rows.groupBy("center_id").agg(F.count(F.lit(1)).alias("n_points"), F.max("dist").alias("largest"))
    if percentile >= 100:
        return whole.select("center_id", "n_points", F.col("largest").alias("r_c"), F.col("n_points").alias("covered"))
    hist = cell_rows.withColumn("bin", bin_of(F.col("dist"))).groupBy("center_id", "bin").agg(F.count(F.lit(1)).alias("n"))
    upto = Window.partitionBy("center_id").orderBy("bin")
    hist = hist.withColumn("hi", F.sum("n").over(upto)).join(whole, "center_id").withColumn("goal", F.col("n_points") * (percentile / 100))
    at = hist.filter("hi >= goal").groupBy("center_id").agg(F.min(F.struct("bin", "n", "hi", "goal", "n_points", "largest")).alias("x")).select("center_id", "x.*")
    edge = F.col("bin") / bins * 2
    at = at.withColumn("r", edge + (F.col("goal") - (F.col("hi") - F.col("n"))) / F.col("n") * (F.lit(2.0) / bins)).withColumn("bin_r", F.least(F.lit(bins - 1), F.floor(F.col("r") * bins / 2)).cast("int"))
    cover = hist.join(at.select("center_id", "bin_r"), "center_id").filter("bin <= bin_r").groupBy("center_id").agg(F.sum("n").alias("covered"))
    small = F.col("n_points") < ceil(100 / (100 - percentile))
    return at.join(cover, "center_id").select("center_id", "n_points", F.when(small, F.col("largest")).otherwise(F.col("r")).alias("r_c"), "covered")


def quantization(cell_rows: DataFrame) -> DataFrame:
    p = lambda q: F.expr(f"percentile(dist, {q})")
    return cell_rows.agg(
        F.avg("dist").alias("mean_cos_distance"), (2 * F.avg("dist")).alias("quantization_error_sq_l2"), F.avg(F.col("dist") * F.col("dist")).alias("mean_sq_cos_distance"),
        p(0.5).alias("cos_distance_p50"), p(0.95).alias("cos_distance_p95"), p(0.99).alias("cos_distance_p99"), F.max("dist").alias("cos_distance_max"),
    )


def center_statistics(radius_rows: DataFrame, n_centers: int) -> DataFrame:
    """Nominal radius (median, with a floor of 1e-6), empty cells, points per center."""
    r = F.greatest(F.col("r_c"), F.lit(1e-6))
    return radius_rows.agg(
        F.expr("percentile(greatest(r_c, 1e-6), 0.5)").alias("r"), F.min(r).alias("r_min"), F.max(r).alias("r_max"), (F.lit(n_centers) - F.count(F.lit(1))).alias("n_empty"),
        F.min("n_points").alias("points_min"), F.expr("percentile(n_points, 0.5)").alias("points_median"), F.max("n_points").alias("points_max"), F.sum("covered").alias("covered"),
    )


def refine(spans: DataFrame, cell_rows: DataFrame, centers: DataFrame) -> DataFrame:
    """Centers moved to the mean of their cells' unit vectors, on the sphere again; empty cells stay.

    Vectors are added up whole, in the batches first, so a cell's rows are a few partial sums wherever they lie.
    """

    def partial(batches):
        for b in batches:
            if b.num_rows:
                own = b.column(0).to_numpy()
                by = np.argsort(own, kind="stable")
                own, x = own[by], _unit_rows(_matrix(b.column(1)))[by]
                at = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
                yield pa.RecordBatch.from_arrays([pa.array(own[at]), pa.array(np.diff(np.r_[at, len(own)])), pa.array(list(np.add.reduceat(x, at)), pa.list_(pa.float64()))], names=["center_id", "n", "s"])

    def total(batches):
        key, n, s, done = None, 0, None, []
        for b in batches:
            if not b.num_rows:
                continue
            for k, m, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), _matrix(b.column(2)), strict=True):
                if k != key:
                    if key is not None:
                        done.append((key, s / n))
                    key, n, s = k, 0, 0.0
                    if len(done) == ROWS:
                        yield rows(done)
                        done = []
                n, s = n + m, s + x
        if key is not None:
            yield rows([*done, (key, s / n)])

    def rows(done):
        keys, means = zip(*done, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(list(_unit_rows(np.stack(means))), pa.list_(pa.float64()))], names=["center_id", "moved"])

    used = usable(spans.select("span_id", "v"), "v", width(centers, "center"))
    sums = used.join(cell_rows.select("span_id", "center_id"), "span_id").select("center_id", "v").mapInArrow(partial, "center_id long, n long, s array<double>")
    means = sums.repartition("center_id").sortWithinPartitions("center_id").mapInArrow(total, "center_id long, moved array<double>")
    return centers.join(means, "center_id", "left").select("center_id", F.coalesce("moved", "center").alias("center"))


def _greedy(ids: np.ndarray, x: np.ndarray, far: np.ndarray, floor: float, room: int, batch: int) -> list[int]:
    """Places of the next centers among candidates in order of id, while they are farther than `floor`, which no
    other point exceeds: distances only fall, so these are the next centers of all points."""
    chosen: list[int] = []
    far = far.copy()
    while len(chosen) < room:
        best = np.argsort(-far, kind="stable")[: min(batch, room - len(chosen))]
        if far[best[-1]] <= floor:
            break
        chosen += best.tolist()
        far = np.minimum(far, np.round(1 - x @ x[best].T, 6).min(1))
        far[chosen] = -1
    return chosen


def farthest_first(points: DataFrame, n_centers: int, batch: int = 1, pool_bytes: int = 64 << 20) -> DataFrame:
    """(position, span_id): Gonzalez traversal from the point of least id hash; each step adds the `batch`
    points farthest from all chosen ones (ties: smaller id).

    Distances to the nearest center are kept in a stored table. A round brings the farthest points, up to
    `pool_bytes` of them, to the driver, which goes on choosing among these for as long as their distances
    exceed all others'; then the chosen ones update the table. A step that finds no such candidates takes
    the first of them, as a round of one step would.
    """
    from .tables import drop, keep

    d = width(points, "v")
    points = usable(points.select("span_id", "v"), "v", d)
    start = points.orderBy(F.md5(F.col("span_id").cast("string").cast("binary")), "span_id").first()
    n = points.count()
    if n < n_centers:
        raise ValueError(f"{n_centers} centers from {n} points")
    most = max(4 * batch, pool_bytes // max(8 * d, 1))
    spark, chosen, last = points.sparkSession, [start["span_id"]], np.array([start["v"]])
    last = last / np.maximum(np.linalg.norm(last, axis=1), 1e-12)[:, None]
    taken, far = [start["span_id"]], points.select("span_id", "v", F.lit(9.0).alias("far"))
    while len(chosen) < n_centers:
        shared = spark.sparkContext.broadcast((np.array(taken), last))

        def run(batches, shared=shared):
            ids, c = shared.value
            for b in batches:
                if b.num_rows:
                    x = _matrix(b.column(1))
                    x = x / np.maximum(np.linalg.norm(x, axis=1), 1e-12)[:, None]
                    low = np.minimum(b.column(2).to_numpy(), np.round(1 - x @ c.T, 6).min(1))
                    low[np.isin(b.column(0).to_numpy(), ids)] = -1
                    yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(low)], names=["span_id", "v", "far"])

        before, far = far, keep(far.mapInArrow(run, "span_id long, v array<double>, far double"), "far")
        if len(chosen) > 1:
            drop(before)
        shared.destroy()
        got = far.filter("far >= 0").orderBy(F.desc("far"), "span_id").limit(most).toArrow().combine_chunks()
        x = np.concatenate([_matrix(c) for c in got.column(1).chunks])
        x = x / np.maximum(np.linalg.norm(x, axis=1), 1e-12)[:, None]
        ids, low = got.column(0).to_numpy(), got.column(2).to_numpy()
        floor = low[-1] if len(ids) == most else -1.0
        by = np.argsort(ids)
        picks = _greedy(ids[by], x[by], low[by], floor, n_centers - len(chosen), batch)
        if not picks:
            picks = np.argsort(-low[by], kind="stable")[: min(batch, n_centers - len(chosen))].tolist()
        taken, last = ids[by][picks].tolist(), x[by][picks]
        chosen += taken
    drop(far)
    return spark.createDataFrame(list(enumerate(chosen)), "position long, span_id long")


def kmeans_centers(spans: DataFrame, k: int, seed: int = 123, rounds: int = 20, n_init: int = 3) -> DataFrame:
    """Unit centers by k-means with parallel k-means++ seeding, over unit vectors: of `n_init` runs the one of
    least inertia (the first of equals)."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    from .tables import keep

    rows = keep(usable(spans.select("v"), "v", width(spans, "v")).select(array_to_vector(unit(F.col("v"))).alias("features")), "features")
    models = [KMeans(k=k, seed=seed + i, maxIter=rounds).fit(rows) for i in range(n_init)]
    model = min(models, key=lambda m: m.summary.trainingCost)
    rows = [(i, [float(x) for x in c / max(np.linalg.norm(c), 1e-12)]) for i, c in enumerate(model.clusterCenters())]
    return spans.sparkSession.createDataFrame(rows, "center_id long, center array<double>")
