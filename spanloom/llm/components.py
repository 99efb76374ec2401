"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, store


#: Edges up to which (by count) one task joins them: 16 bytes each, so 32 MB.
IN_ONE_TASK = 2_000_000


def _joined(batches):
    """(node, component) of one task's edges, by repeated halving of the paths to smaller nodes."""
    got = [b for b in batches if b.num_rows]
    schema = pa.schema([("node", pa.int64()), ("component", pa.int64())])
    if got:
        u, v = (np.concatenate([b.column(k).to_numpy() for b in got]) for k in (0, 1))
        nodes, at = np.unique(np.concatenate((u, v)), return_inverse=True)
        a, b = at[: len(u)], at[len(u) :]
        root = np.arange(len(nodes))
        while True:
            x, y = root[a], root[b]
            if (x == y).all():
                break
            np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
            while (root[root] != root).any():
                root = root[root]
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[root])], schema=schema)


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return r["n"], r["h"]


def components(edges: DataFrame, rounds: int = 60, small: int = IN_ONE_TASK) -> DataFrame:
    """(node, component) for each node of `edges` (u, v): component is its smallest reachable node.

    Each step is a minimum per node, combined before the shuffle, and a join of the edges with it, so a
    node of any degree is never gathered. Every round is written to the shared folder, which cuts its
    lineage; the number of rounds grows with the logarithm of the size. Up to IN_ONE_TASK edges, counted
    first, are joined by one task instead, with the same result. Loops and repeats are ignored.
    """
    edges = store(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), "edges")
    before = _state(edges)
    if before[0] <= small:
        return store(edges.coalesce(1).mapInArrow(_joined, "node long, component long"), "components")
    for _ in range(rounds):
        if not before[0]:
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = store(large, "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("x")).select(F.col("x.v").alias("u"), F.col("x.m").alias("v"))
        last, edges = edges, store(small.filter("u <> v").distinct(), "small-star")
        release(large, last)
        after = _state(edges)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
