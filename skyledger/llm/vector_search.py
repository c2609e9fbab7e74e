"""Nearest neighbours by a block matrix join: int8 products with error bounds, exact scores for what survives.

Queries are dealt into blocks and rows into strips, and every block meets every strip in
one task.  There both are rounded to int8 with one scale per vector; the product of the two
matrices gives all inner products at once, and the lengths of the rounding residuals bound
their errors.  A pair survives when its largest possible product reaches the k-th largest
of the smallest possible ones; survivors are computed again on the original vectors in
double precision, component after component.  A task sends at most k rows a query; a
query's runs are merged by a heap.  Equal vectors of a strip beyond the k + 1 smallest ids
cannot be among the nearest and are left out before the product.

Blocks and strips are bounded by rows, so a task holds two bounded matrices however large
the table or its hot vectors are; their number follows from the counts of the table.

Defined cases: vectors that are null or empty, hold null or non-finite components or have
length zero take no part; only vectors with the same number of components meet; rows of
equal id are rows of their own, and a query leaves out only its own row; null ids come
after all others among ties; fewer than k candidates are all returned; an empty table gives
an empty result.  Texts are not read; columns of other names are ignored.
"""

from __future__ import annotations

import heapq
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyledger.llm.common import mapped, settle, table
from skyledger.llm.vector_codes import finite

NEAREST, EVERY = 20, 20
# Most rows of a block and a strip; small tables are cut finer, for parallel work.
BLOCK_ROWS, LEAST_ROWS = 32_768, 2_048
# Products held at once.
PRODUCTS = 2_000_000

RUNS = "rid long, query_id long, ids array<long>, scores array<double>"
FOUND = "query_id long, rank int, vec_id long, score double"


class Rounded:
    """Vectors as int8 with a scale each, and the lengths that bound the error of a product."""

    def __init__(self, vectors: np.ndarray):
        scale = np.abs(vectors).max(1) / 127
        self.scale = np.where(scale > 0, scale, 1.0)
        codes = np.rint(vectors / self.scale[:, None])
        near = codes * self.scale[:, None]
        # int8 values in a float type whose sums of products are exact.
        self.codes = codes.astype(np.float32 if vectors.shape[1] * 127 * 127 < 1 << 24 else np.float64)
        self.length = np.sqrt((vectors * vectors).sum(1))
        self.near = np.sqrt((near * near).sum(1))
        rest = vectors - near
        self.rest = np.sqrt((rest * rest).sum(1))


def product_bounds(a: Rounded, low: int, high: int, b: Rounded) -> tuple[np.ndarray, np.ndarray]:
    """Approximate products of a[low:high] with b, and how far they may be off."""
    own = slice(low, high)
    about = (a.codes[own] @ b.codes.T).astype(np.float64)
    about *= a.scale[own, None]
    about *= b.scale[None, :]
    # <x, y> - <x', y'> = <x, y - y'> + <x - x', y'>; a little more for the rounding of doubles.
    off = a.length[own, None] * b.rest[None, :] + a.rest[own, None] * b.near[None, :]
    off += 1e-9 * a.length[own, None] * b.length[None, :]
    return about, off


def exact_products(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Inner products of the pairs in double precision, summed from the first component to the last."""
    out = np.zeros(len(i))
    for at in range(a.shape[1]):
        out += a[i, at] * b[j, at]
    return out


def id_order(ids: list) -> np.ndarray:
    """Rank of each id, null last; equal ids have equal ranks."""
    null = np.array([x is None for x in ids], bool)
    return np.unique(np.where(null, np.iinfo(np.int64).max, np.array([x or 0 for x in ids], np.int64)), return_inverse=True)[1] + null


def first_copies(vectors: np.ndarray, rank: np.ndarray, most: int) -> np.ndarray:
    """Rows that are among the `most` smallest ids of their equal vectors."""
    same = np.unique(np.ascontiguousarray(vectors).view(f"V{vectors.shape[1] * 8}").reshape(-1), return_inverse=True)[1].reshape(-1)
    order = np.lexsort((rank, same))
    starts = np.flatnonzero(np.diff(same[order], prepend=-1))
    place = np.arange(len(order)) - np.repeat(starts, np.diff(np.append(starts, len(order))))
    return np.sort(order[place < most])


def strip_nearest(asked: np.ndarray, asked_rids: np.ndarray, rows: np.ndarray, rids: np.ndarray, ids: list, k: int):
    """Per asked vector, places and scores of its nearest rows: best score first, then smaller id."""
    rank = id_order(ids)
    kept = first_copies(rows, rank, k + 1)
    rows, rids, rank = rows[kept], rids[kept], rank[kept]
    a, b = Rounded(asked), Rounded(rows)
    order = np.argsort(rids)
    step = max(1, PRODUCTS // max(len(rows), 1))
    for low in range(0, len(asked), step):
        high = min(low + step, len(asked))
        about, off = product_bounds(a, low, high, b)
        # A query's own row is none of its candidates.
        own = order[np.minimum(np.searchsorted(rids, asked_rids[low:high], sorter=order), len(rids) - 1)]
        mine = np.flatnonzero(rids[own] == asked_rids[low:high])
        about[mine, own[mine]] = -np.inf
        sure, least = about - off, np.full(high - low, -np.inf)
        if len(rows) > k:
            least = np.partition(sure, len(rows) - k, axis=1)[:, len(rows) - k]
        about += off
        i, j = np.nonzero((about >= least[:, None]) & (about > -np.inf))
        scores = np.empty(len(i))
        for at in range(0, len(i), 1 << 16):
            part = slice(at, at + (1 << 16))
            scores[part] = exact_products(asked[low:high], rows, i[part], j[part])
        best = np.lexsort((rank[j], -scores, i))
        i, j, scores = i[best], j[best], scores[best]
        starts = np.searchsorted(i, np.arange(high - low + 1))
        for x in range(high - low):
            part = slice(starts[x], min(starts[x + 1], starts[x] + k))
            yield low + x, kept[j[part]], scores[part]


def _matrix(side: pa.Table) -> np.ndarray:
    column = side.column("v").combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(side.num_rows, -1)


def _tile(k: int):
    """One block of queries against one strip of rows: a run of at most k rows a query."""

    def search(asked: pa.Table, rows: pa.Table) -> pa.Table:
        out = []
        if asked.num_rows and rows.num_rows:
            ids, rids = rows.column("vec_id").to_pylist(), rows.column("rid").to_numpy()
            queries, asked_rids = asked.column("vec_id").to_pylist(), asked.column("rid").to_numpy()
            for x, places, scores in strip_nearest(_matrix(asked), asked_rids, _matrix(rows), rids, ids, k):
                out.append((int(asked_rids[x]), queries[x], [ids[p] for p in places], scores.tolist()))
        kinds = (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.float64()))
        columns = list(zip(*out)) or [()] * 4
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds)], ["rid", "query_id", "ids", "scores"])

    return search


def _merger(k: int):
    """The k best of a query's runs, by a heap over the runs; runs of a query stand together."""

    def merged(runs: list):
        def ranked(run):
            return ((-s, x is None, x or 0) for x, s in zip(run["ids"], run["scores"]))

        best = islice(heapq.merge(*map(ranked, runs)), k)
        return [(runs[0]["query_id"], n, None if null else x, -s) for n, (s, null, x) in enumerate(best, 1)]

    def merge(batches):
        own, runs = None, []
        for batch in batches:
            out = []
            for run in batch.to_pylist():
                if runs and run["rid"] != own:
                    out += merged(runs)
                    runs = []
                own = run["rid"]
                runs.append(run)
            yield from _found(out)
        if runs:
            yield from _found(merged(runs))

    return merge


def _found(rows: list):
    if rows:
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.float64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["query_id", "rank", "vec_id", "score"])


def nearest_rows(vectors: DataFrame, asks: Column, k: int = NEAREST, id_col: str = "vec_id", vector_col: str = "embedding", block_rows: int = BLOCK_ROWS, least_rows: int = LEAST_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of largest inner product for every row that asks."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v"), F.coalesce(asks, F.lit(False)).alias("asks"))
    if rows.schema["v"].dataType.simpleString() not in ("array<float>", "array<double>"):
        rows = rows.withColumn("v", F.col("v").cast("array<double>"))
    rows = rows.where(finite(F.col("v")) & F.exists("v", lambda x: x != 0))
    # Row numbers are fixed by writing them once.
    rows = settle(rows.withColumn("rid", F.monotonically_increasing_id()).withColumn("width", F.size("v")), "search-rows")
    wide = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def blocks(count: Column) -> Column:
        finer = F.least(F.lit(wide), F.ceil(count / least_rows))
        return F.greatest(F.ceil(count / block_rows), finer, F.lit(1)).cast("int")

    counts = rows.groupBy("width").agg(F.count("*").alias("n"), F.sum(F.col("asks").cast("long")).alias("m"))
    counts = settle(counts.select("width", blocks(F.col("n")).alias("strips"), F.greatest(F.ceil(F.col("m") / block_rows), F.lit(1)).cast("int").alias("blocks")), "search-blocks")
    dealt = rows.join(counts, "width")
    number = F.xxhash64("rid")
    asked = dealt.where("asks").withColumn("block", F.pmod(number, F.col("blocks")).cast("int")).withColumn("strip", F.explode(F.sequence(F.lit(0), F.col("strips") - 1)))
    offered = dealt.withColumn("strip", F.pmod(number, F.col("strips")).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    keys, columns = ["width", "block", "strip"], ["width", "block", "strip", "rid", "vec_id", "v"]
    # Both sides come from the same rows, so one side's columns get names of their own.
    offered = offered.select([F.col(c).alias(c) for c in columns])
    meet = asked.select(columns).groupBy(*keys).cogroup(offered.groupBy(*keys))
    runs = meet.applyInArrow(_tile(k), RUNS).repartition("rid").sortWithinPartitions("rid")
    return mapped(runs, _merger(k), FOUND)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_rows(table(spark, sf_dir, "embeddings"), F.col("vec_id") % EVERY == 0)


SQL = f"""
with k as materialized (
  select row_number() over () as rid, vec_id, list_transform(embedding, lambda x: cast(x as double)) as v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0
),
s as (
  select q.rid, q.vec_id as query_id, c.vec_id, list_inner_product(q.v, c.v) as score from k q join k c on q.rid <> c.rid and len(q.v) = len(c.v)
  where q.vec_id % {EVERY} = 0
),
r as (select *, row_number() over (partition by rid order by score desc, vec_id nulls last) as rank from s)
select query_id, cast(rank as integer) as rank, vec_id, score from r where rank <= {NEAREST}
"""
