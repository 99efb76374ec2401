"""Shared pieces of the training-data operators: the shared folder, stored tables,
size-checked broadcasts and global prefix sums."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The byte class that separates words in every contract of this subpackage.
SPACES = r"[\x20\x09-\x0D]+"
#: Rows up to which a per-key table may be broadcast (its size is counted first).
BROADCAST_ROWS = 200_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, spark.checkpoint.dir; where it is unset, a temporary one, but only
    if driver and executors are one process."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="spanloom-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/spanloom-{name}-{uuid.uuid4().hex}"


def store(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage and survives lost executors."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    schema = df.schema
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(schema).parquet(path)


def release(*tables: DataFrame) -> None:
    """Delete stored tables that nothing reads any more (what is read later must have been stored anew)."""
    for df in tables:
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if "/spanloom-" in path:
                at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
                at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def join_small(df: DataFrame, small: DataFrame, key: str, how: str = "left") -> DataFrame:
    """Null-safe join with a per-key table: broadcast only if it is counted to be small, else a shuffle
    join whose skewed partitions adaptive execution splits."""
    other = f"__{key}"
    small = small.withColumnRenamed(key, other)
    if small.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        small = F.broadcast(small)
    return df.join(small, F.col(key).eqNullSafe(F.col(other)), how).drop(other)


def only(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """The named columns alone, so that extra columns with clashing names never meet ours."""
    have = {f.name for f in df.schema.fields}
    return df.select(*(F.col(f"`{c}`").cast(t).alias(c) if c in have else F.lit(None).cast(t).alias(c) for c, t in columns.items()))


def trim() -> None:
    """Give a finished task's memory back to the system: Python workers live on between tasks."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def let(value: Column, body) -> Column:
    """Bind an expression once for use inside a higher-order expression."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def prefix_sums(df: DataFrame, order: list[Column], values: dict[str, str], name: str) -> tuple[DataFrame, dict[str, int]]:
    """Global exclusive prefix sums without gathering rows in one task.

    `values` maps an output column to the long column that it sums; `__index` counts rows. Rows are
    range-partitioned and sorted, each partition sums its own rows, and only one total per partition
    (as many as there are partitions) is added up on the driver and sent back.
    """
    import numpy as np
    import pyarrow as pa
    from pyspark import TaskContext
    from pyspark.sql import types as T

    outs = ["__index", *values]
    schema = T.StructType([*df.schema.fields, *(T.StructField(c, T.LongType()) for c in outs), T.StructField("__part", T.IntegerType())])

    def local(batches):
        part, base = TaskContext.get().partitionId(), np.zeros(len(outs), "int64")
        for b in batches:
            cols = [b.column(i) for i in range(b.num_columns)]
            for k, out in enumerate(outs):
                v = np.ones(b.num_rows, "int64") if k == 0 else b.column(values[out]).to_numpy(zero_copy_only=False).astype("int64")
                run = np.cumsum(v)
                cols.append(pa.array(base[k] + run - v))
                base[k] += run[-1] if len(run) else 0
            cols.append(pa.array(np.full(b.num_rows, part, "int32")))
            yield pa.RecordBatch.from_arrays(cols, [*b.schema.names, *outs, "__part"])

    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sums = store(df.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(local, schema), name)
    width = {c: (F.max(F.col(c) + (F.lit(1) if c == "__index" else F.col(values[c])))).alias(c) for c in outs}
    totals = sums.groupBy("__part").agg(*width.values()).collect()
    run, starts = dict.fromkeys(outs, 0), []
    for row in sorted(totals, key=lambda r: r["__part"]):
        starts.append((row["__part"], *(run[c] for c in outs)))
        for c in outs:
            run[c] += row[c]
    if not starts:
        return sums.drop("__part"), run
    base = df.sparkSession.createDataFrame(starts, ", ".join(["__p int", *(f"`__b{c}` long" for c in outs)]))
    out = sums.join(F.broadcast(base), F.col("__part") == F.col("__p"))
    out = reduce(lambda d, c: d.withColumn(c, F.col(c) + F.col(f"__b{c}")), outs, out)
    return out.drop("__part", "__p", *(f"__b{c}" for c in outs)), run
