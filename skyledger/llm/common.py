"""Shared small helpers: null-safe columns, bytes out of Arrow, components of a graph."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyledger.session import COMPRESSION, run_dir

# The ASCII white space of the contracts: space and 09 to 0D.
SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"
SPACE_CLASS = "\\x20\\x09-\\x0D"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

# Bounds of one Arrow batch handed to Python: rows and bytes (a single longer row still passes).
BATCH_ROWS = 2048
BATCH_BYTES = 4 << 20
# Edges that a task turns into stars at once.
FOREST_EDGES = 1_000_000


# Where the work folders made in the running context are noted, if someone asked for it.
_NOTED: ContextVar[list[str] | None] = ContextVar("noted", default=None)


def work_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder below the shared folder."""
    path = run_dir(spark, label)
    noted = _NOTED.get()
    if noted is not None:
        noted.append(path)
    return path


@contextmanager
def noted_folders() -> Iterator[list[str]]:
    """The work folders made inside, for removal when what was made of them is written."""
    made: list[str] = []
    before = _NOTED.set(made)
    try:
        yield made
    finally:
        _NOTED.reset(before)


def discard(spark: SparkSession, path: str) -> None:
    """Remove a work folder; nothing may read it any more."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def settle(df: DataFrame, label: str, path: str | None = None) -> DataFrame:
    """Write a frame to the shared folder and read it back, cutting its lineage."""
    spark = df.sparkSession
    path = path or work_dir(spark, label)
    df.write.parquet(path, compression=COMPRESSION)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_join(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """Equi-join by sort and merge at every size, for sides that grow with the data.

    Adaptive execution splits the partitions of hot keys when both sides are written
    tables or rows, not aggregates made on the fly.
    """
    return left.join(right.hint("merge"), on, how)


class Scratch:
    """Tables of the inside of an operator, removed when its result is written."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.path, self.count = spark, work_dir(spark, label), 0

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        discard(self.spark, self.path)

    def settle(self, df: DataFrame, label: str) -> DataFrame:
        self.count += 1
        return settle(df, label, f"{self.path}/{self.count}-{label}")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small, so that very long texts cannot fill a worker; smaller ones of the caller stay."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        given = spark.conf.get(key).lower().removesuffix("b")
        if not (given.isdigit() and 0 < int(given) <= most):
            spark.conf.set(key, str(most))


def give_back() -> None:
    """Return the memory that a task has freed to the system.

    Python workers outlive their task; what their allocators hold back would stand beside the
    memory of every later task, and of the executor's other workers.
    """
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def _returning(fn):
    """The same over batches, after which the worker is as lean as before."""

    def run(batches):
        try:
            yield from fn(batches)
        finally:
            gc.enable()
            give_back()

    return run


def mapped(df: DataFrame, fn, schema: str) -> DataFrame:
    """mapInArrow with bounded batches; a task leaves no memory to the next one of its worker."""
    bounded_batches(df.sparkSession)
    return df.mapInArrow(_returning(fn), schema)


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes per row; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def numbered(docs: DataFrame, label: str) -> tuple[DataFrame, list[str]]:
    """The rows written once under neutral column names, with a row number `rid`; and those names in order.

    No column of the caller can clash with what an operator adds.
    """
    names = [f"own_{i}" for i in range(len(docs.columns))]
    return settle(docs.toDF(*names).withColumn("rid", F.monotonically_increasing_id()), label), names


def renamed(schema: T.StructType, names: list[str]) -> T.StructType:
    """The schema under other names."""
    return T.StructType([T.StructField(n, f.dataType, f.nullable) for n, f in zip(names, schema.fields)])


def pieces_of(rows: list, size: int) -> Iterator[list]:
    for at in range(0, len(rows), size):
        yield rows[at : at + size]


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(smallest node, other node) of every component of the edges."""
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = place[: len(a)], place[len(a) :]
    up = np.arange(len(nodes))
    while True:
        own, other = up[x], up[y]
        if (own == other).all():
            break
        np.minimum.at(up, np.maximum(own, other), np.minimum(own, other))
        while not np.array_equal(up, up[up]):
            up = up[up]
    far = np.flatnonzero(up != np.arange(len(nodes)))
    return nodes[up[far]], nodes[far]


def edge_batches(pairs, rows: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    """Two arrays of long as batches of (a, b)."""
    for at in range(0, len(pairs[0]), rows):
        yield pa.RecordBatch.from_arrays([pa.array(x[at : at + rows], pa.int64()) for x in pairs], ["a", "b"])


def _forests(batches):
    """The stars of each bounded run of edges: no more edges than nodes go on."""
    held, count = [], 0
    for batch in batches:
        held.append([batch.column(c).to_numpy() for c in ("a", "b")])
        count += batch.num_rows
        if count >= FOREST_EDGES:
            yield from edge_batches(forest(*map(np.concatenate, zip(*held))))
            held, count = [], 0
    if held:
        yield from edge_batches(forest(*map(np.concatenate, zip(*held))))


def components(edges: DataFrame, work: Scratch) -> DataFrame:
    """Connected components of (a, b) edges of longs: one row (node, root) per node, root the smallest node.

    Tasks first turn their edges into stars.  Then, round by round, every node moves to the
    smallest node near it and on to the one near that, edges inside what has become one
    node vanish, and nodes without edges leave, so that rounds shrink; at the end the moves
    are followed from the last round to the first.  Every round is written to the shared
    folder (`work`); only whether an edge is left reaches the driver.  Null ends are no nodes.
    """
    real = edges.select("a", "b").where("a is not null and b is not null and a <> b")
    left, moves = work.settle(mapped(real, _forests, "a long, b long"), "edges"), []
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = work.settle(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("root")), "near")
        onward = near.select(F.col("node").alias("root"), F.col("root").alias("next"))
        moved = work.settle(near.join(onward, "root").select("node", F.col("next").alias("root")), "moves")
        moves.append(moved)
        for end in ("a", "b"):
            left = left.join(moved.select(F.col("node").alias(end), F.col("root").alias(f"new_{end}")), end).drop(end)
        left = left.select(F.col("new_a").alias("a"), F.col("new_b").alias("b")).where("a <> b").distinct()
        left = work.settle(mapped(left, _forests, "a long, b long"), "edges")
    if not moves:
        return left.select(F.col("a").alias("node"), F.col("b").alias("root"))
    roots = moves.pop()
    while moves:
        last = roots.select(F.col("node").alias("root"), F.col("root").alias("last"))
        roots = moves.pop().join(last, "root", "left").select("node", F.coalesce("last", "root").alias("root"))
    return work.settle(roots, "roots")


def running_start(df: DataFrame, key: str, hashed: list[str], order: list, value, buckets: int = 4096) -> DataFrame:
    """Add `start`: the sum of `value` over the earlier rows of the same key, in a fixed order.

    Rows of a key are dealt into hashed buckets, each bucket is summed on its own and
    the bucket sums (at most `buckets` rows a key) carry the rest, so a key with a
    third of all rows is spread over many tasks.
    """
    df = df.withColumn("__bucket", F.pmod(F.xxhash64(*hashed), F.lit(buckets))).withColumn("__value", value)
    earlier = Window.unboundedPreceding, -1
    within = F.sum("__value").over(Window.partitionBy(key, "__bucket").orderBy(*order).rowsBetween(*earlier))
    before = F.sum("__sum").over(Window.partitionBy(key).orderBy("__bucket").rowsBetween(*earlier))
    sums = df.groupBy(key, "__bucket").agg(F.sum("__value").alias("__sum")).select(key, "__bucket", F.coalesce(before, F.lit(0)).alias("__base"))
    placed = df.withColumn("__within", F.coalesce(within, F.lit(0))).join(sums, [key, "__bucket"])
    return placed.withColumn("start", F.col("__base") + F.col("__within")).drop("__bucket", "__value", "__base", "__within")
