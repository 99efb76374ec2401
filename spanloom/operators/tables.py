"""Stored tables: caches keyed by a signature, and tables that cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one only where driver and executors are one process."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="spanloom-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def keep(df: DataFrame, name: str = "table") -> DataFrame:
    """Write to the shared folder and read back."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


def drop(*tables: DataFrame) -> None:
    """Delete tables of `keep` that nothing reads any more."""
    for df in tables:
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def numbered(df: DataFrame, name: str, *order: str) -> DataFrame:
    """`df` with `name` LONG, its place from 0 in the order: rows are sorted by range, counted in each
    partition, and only the partitions' totals are added up on the driver."""
    import pyarrow as pa
    from pyspark import TaskContext
    from pyspark.sql import types as T

    def run(batches):
        n, part = 0, TaskContext.get().partitionId()
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(range(n, n + b.num_rows), pa.int64()), pa.array([part] * b.num_rows, pa.int32())], names=[*b.schema.names, name, "__part"])
            n += b.num_rows

    schema = T.StructType([*df.schema.fields, T.StructField(name, T.LongType()), T.StructField("__part", T.IntegerType())])
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = keep(df.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(run, schema), "numbered")
    base, before = 0, []
    for r in sorted(rows.groupBy("__part").count().collect(), key=lambda r: r["__part"]):
        before.append((r["__part"], base))
        base += r["count"]
    starts = df.sparkSession.createDataFrame(before, "__part int, __before long")
    return rows.join(F.broadcast(starts), "__part").withColumn(name, F.col(name) + F.col("__before")).drop("__part", "__before")


def signature(**parameters) -> str:
    """Twelve hex digits that name a parameter set, whatever its order."""
    import hashlib
    import json

    return hashlib.sha1(json.dumps(parameters, sort_keys=True, default=str).encode()).hexdigest()[:12]


def text_signature(texts: DataFrame, order: str, text: str, size: int = 16) -> DataFrame:
    """One row: SHA-1 of the texts in order, each ended by a NUL, cut to `size` hex digits. For query sets, whose
    texts lie in one value; larger tables have `table_signature`."""
    rows = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("k"), F.col(text).alias("t")))), lambda x: F.concat(x["t"], F.lit("\x00")))
    return texts.agg(F.substring(F.sha1(F.array_join(rows, "").cast("binary")), 1, size).alias("signature"))


def table_signature(rows: DataFrame, size: int = 16) -> DataFrame:
    """One row: a signature of a table of any size, whatever the order of its rows: SHA-1 of their number and of the
    sums of two 64-bit hashes of each row, which are added up in partitions first."""
    one = F.xxhash64(*rows.columns)
    two = F.xxhash64(F.lit(1), one, *rows.columns)
    sums = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(one.cast("decimal(38,0)")).alias("a"), F.sum(two.cast("decimal(38,0)")).alias("b"))
    return sums.select(F.substring(F.sha1(F.concat_ws(":", "n", F.coalesce("a", F.lit(0)), F.coalesce("b", F.lit(0))).cast("binary")), 1, size).alias("signature"))


def cached(spark: SparkSession, folder: str, name: str, build, **parameters) -> DataFrame:
    """The table of these parameters, built once. The writer's commit makes a half-written one unreadable."""
    path = f"{folder}/{name}-{signature(**parameters)}"
    fs = spark._jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")
    if not fs.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def cached_top(spark: SparkSession, folder: str, name: str, k: int, build, **parameters) -> DataFrame:
    """Top-k rows from any cached table of the same parameters with at least k ranks, else a new one of k."""
    top = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
    stem = f"{name}-{signature(**parameters)}-k"
    have = [int(s.getPath().getName().removeprefix(stem)) for s in fs.listStatus(top) if s.getPath().getName().startswith(stem)] if fs.exists(top) else []
    k0 = min((h for h in have if h >= k), default=None)
    if k0 is None:
        k0 = max([k, *have])
        build(k0).write.mode("overwrite").parquet(f"{folder}/{stem}{k0}")
    return spark.read.parquet(f"{folder}/{stem}{k0}").filter(F.col("rank") <= k)


def file_signatures(spark: SparkSession, path: str) -> DataFrame:
    """(path, signature) of the files below a path, from their sizes and times alone."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", file_signature(F.col("length"), F.col("modificationTime")).alias("signature"))


def file_signature(size: Column, modified: Column) -> Column:
    return F.concat_ws("-", size.cast("string"), F.unix_seconds(modified).cast("string"))
