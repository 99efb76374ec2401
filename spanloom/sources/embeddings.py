"""Embedding files of one section each: `<folder>/<model>_<unit>/<section>_<unit>.npy`, or .npz where there is no .npy.

Only headers and ranges of rows are read, dealt over the cluster, so a file may be larger than any task's memory.
"""

from __future__ import annotations

import io
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .corpora import embedding_folder

SECTIONS = ("abstract", "claim", "invention")
#: Bytes of rows that one read takes.
CHUNK = 8 << 20


def filesystem(uri: str):
    """(file system, path) of a plain path or of a URI that Arrow knows."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def write_bytes(path: str, pieces) -> None:
    """Write under a name of its own, then give it the right one, so that a lost attempt leaves no half file."""
    system, path = filesystem(path)
    system.create_dir(path.rsplit("/", 1)[0], recursive=True)
    own = f"{path}.{uuid.uuid4().hex}"
    with system.open_output_stream(own) as out:
        for piece in pieces:
            out.write(piece)
    system.move(own, path)


def write_files(rows: DataFrame) -> int:
    """A file for each row (path, text); returns their number."""

    def run(batches):
        for b in batches:
            for path, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                write_bytes(path, [(text or "").encode()])
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], names=["n"])

    return rows.select("path", "text").mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def write_embeddings(rows: DataFrame, folder: str, model: str, unit: str) -> None:
    """Rows (section, i, v ARRAY<FLOAT>) as one .npy a section, in order of i."""
    shapes = {r["section"]: (r["n"], r["d"]) for r in rows.groupBy("section").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("d")).collect()}

    def run(batches):
        def pieces(first, batches):
            head = io.BytesIO()
            np.lib.format.write_array_header_1_0(head, {"descr": "<f4", "fortran_order": False, "shape": shapes[first]})
            yield head.getvalue()
            for section, v in batches:
                assert section == first
                yield v.tobytes()

        def parts():
            for b in batches:
                names = b.column(0).to_pylist()
                v = b.column(1).flatten().to_numpy(zero_copy_only=False).astype("<f4").reshape(b.num_rows, -1)
                a = 0
                while a < len(names):
                    z = a
                    while z < len(names) and names[z] == names[a]:
                        z += 1
                    yield names[a], v[a:z]
                    a = z

        from itertools import groupby

        for section, some in groupby(parts(), key=lambda p: p[0]):
            write_bytes(f"{folder}/{model}_{unit}/{section}_{unit}.npy", pieces(section, some))
            yield pa.RecordBatch.from_arrays([pa.array([section])], names=["section"])

    rows.repartition("section").sortWithinPartitions("section", "i").select("section", "v").mapInArrow(run, "section string").count()


def read_embeddings(spark: SparkSession, folder: str) -> DataFrame:
    """(model, unit, section, place, i, row, v): `i` is the row in its file, `place` the section's in SECTIONS, `row` the
    row in all sections of a model and unit, put one after the other in that order."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.np[yz]").load(folder).select("path")
    files = files.select("path", embedding_folder(F.col("path")).alias("p")).select("path", "p.*").filter(F.col("section").isin(*SECTIONS))
    files = files.groupBy("model", "unit", "section").agg(F.min("path").alias("path"))  # .npy before .npz

    def heads(batches):
        for b in batches:
            for model, unit, section, path in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                system, name = filesystem(path)
                if path.endswith("z"):
                    with system.open_input_file(name) as f, np.load(f) as held:
                        n, at, kind, d = len(held[held.files[0]]), -1, "", 0
                else:
                    with system.open_input_file(name) as f:
                        version = np.lib.format.read_magic(f)
                        shape, _, dtype = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(f)
                        n, at, kind, d = shape[0], f.tell(), dtype.str, shape[1]
                yield pa.RecordBatch.from_pylist([{"model": model, "unit": unit, "section": section, "path": path, "n": n, "at": at, "kind": kind, "d": d}])

    found = files.mapInArrow(heads, "model string, unit string, section string, path string, n long, at long, kind string, d long").collect()  # one row a file
    chunks, before = [], {}
    for r in sorted(found, key=lambda r: (r["model"], r["unit"], SECTIONS.index(r["section"]))):
        base = before.get((r["model"], r["unit"]), 0)
        step = max(1, CHUNK // (r["d"] * np.dtype(r["kind"]).itemsize)) if r["at"] >= 0 else max(r["n"], 1)
        chunks += [(*r[:4], r["at"], r["kind"], r["d"], first, min(step, r["n"] - first), base) for first in range(0, r["n"], step)]
        before[r["model"], r["unit"]] = base + r["n"]
    plan = spark.createDataFrame(chunks, "model string, unit string, section string, path string, at long, kind string, d long, first long, n long, base long")

    def read(batches):
        for b in batches:
            for c in b.to_pylist():
                system, name = filesystem(c["path"])
                with system.open_input_file(name) as f:
                    if c["at"] < 0:
                        with np.load(f) as held:
                            x = held[held.files[0]]
                    else:
                        kind = np.dtype(c["kind"])
                        x = np.frombuffer(f.read_at(c["n"] * c["d"] * kind.itemsize, c["at"] + c["first"] * c["d"] * kind.itemsize), kind).reshape(c["n"], c["d"])
                i, n = np.arange(c["first"], c["first"] + len(x)), len(x)
                v = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * x.shape[1]), pa.array(x.astype(np.float32).ravel()))
                yield pa.RecordBatch.from_arrays([pa.array([c[k]] * n, pa.string()) for k in ("model", "unit", "section")] + [pa.array([SECTIONS.index(c["section"])] * n, pa.int32()), pa.array(i), pa.array(i + c["base"]), v], names=["model", "unit", "section", "place", "i", "row", "v"])

    return plan.repartition(max(1, min(len(chunks), 10_000))).mapInArrow(read, "model string, unit string, section string, place int, i long, row long, v array<float>")


def chunk(rows: DataFrame, start: int, end: int) -> DataFrame:
    """Rows start to end - 1 of all sections."""
    return rows.filter((F.col("row") >= start) & (F.col("row") < end))


def at_rows(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows that `wanted` (row) names, each once."""
    return rows.join(wanted.select("row").distinct(), "row", "left_semi")


def newest(spark: SparkSession, pattern: str) -> str | None:
    """The path of a pattern that was modified last; of equals the last by name; None if there is none."""
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path) or []
    return max(((s.getModificationTime(), s.getPath().toString()) for s in found), default=(0, None))[1]


def find_centers(spark: SparkSession, root: str, model: str, unit: str, suffix: str = "") -> str | None:
    """The newest table of centers of a model and unit below `root`."""
    return newest(spark, f"{root}/centers_{model}_{unit}*{suffix}")
