"""Vector code compression: product codes by Lloyd rounds over cover trees.

A vector becomes whole numbers (scaled, rounded down) and is cut into consecutive parts;
each part is coded by the number of its nearest codebook entry.  Codebooks start from
the rows with the smallest ids and are improved by Lloyd rounds.

Every task cuts its rows into blocks and builds one cover tree per block and part, once:
a node's children are centres more than half its radius apart that cover its points
within that half.  Points are stored in tree order, so a subtree is a slice and its sum
the difference of two cumulative sums.  In a round the tree is walked level by level: when
the nearest entry of a node's centre is nearer than the second nearest by more than twice
the radius, the triangle inequality gives the whole subtree to it; other nodes descend,
and the points of ambiguous leaves are compared exactly.  A round sends one row per task,
part and used entry; codebooks (entries x width numbers) are all that meets the driver.

Defined cases: null vectors, vectors with null or non-finite components and empty vectors
are dropped, and so are vectors of another length than the first row's; null ids come last
in the order of ids, equal ids in the order of their numbers; a length that the number of
parts does not divide gives parts that differ by one; fewer rows than entries give a
smaller codebook; equal entries count as the one with the lowest index; components whose
error could pass a long saturate; null is a label of its own; repeated rows count each
time; an empty table gives an empty result.  Texts are not read; columns of other names
are ignored.
"""

from __future__ import annotations

import hashlib
import io

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyledger.llm.common import Scratch, mapped, settle, table

ENTRIES, PARTS, ROUNDS, SCALE = 256, 4, 4, 1024
# Rows of a block (one cover tree per part) and points of a leaf.
BLOCK_ROWS, LEAF = 4096, 8


# -- numbers -----------------------------------------------------------------------------


def largest_number(width: int) -> int:
    """Numbers saturate here, so that a vector's error fits in a long."""
    return 1 << ((60 - max(width - 1, 0).bit_length()) // 2)


def whole_numbers(vectors: np.ndarray) -> np.ndarray:
    """Scaled and rounded down."""
    most = largest_number(vectors.shape[1])
    return np.clip(np.floor(vectors * SCALE), -most, most).astype(np.int64)


def cuts(width: int, parts: int) -> list[int]:
    """Where the parts begin, and the end."""
    return [k * width // parts for k in range(parts + 1)]


def squared_distances(points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of all points to all entries."""
    width = points.shape[1]
    most = max(int(np.abs(points).max(initial=0)), int(np.abs(entries).max(initial=0)))
    if 4 * width * most * most < 1 << 53:
        # Every product and sum is a whole number that a double holds.
        a, b = points.astype(np.float64), entries.astype(np.float64)
        return (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T)
    out = np.zeros((len(points), len(entries)), np.int64)
    for i in range(width):
        out += (points[:, i, None] - entries[None, :, i]) ** 2
    return out


def nearest(points: np.ndarray, entries: np.ndarray, second: bool = False):
    """Index of the nearest entry (the lowest of equals) and its squared distance; and the second smallest distance."""
    index, least, then = np.zeros(len(points), np.int64), np.zeros(len(points), np.int64), np.full(len(points), np.inf)
    for at in range(0, len(points), 4096):
        far = squared_distances(points[at : at + 4096], entries)
        rows = np.arange(len(far))
        own = far.argmin(1)
        index[at : at + 4096], least[at : at + 4096] = own, far[rows, own]
        if second and far.shape[1] > 1:
            then[at : at + 4096] = np.partition(far, 1, axis=1)[:, 1]
    return (index, least, then) if second else (index, least)


# -- cover trees -------------------------------------------------------------------------


def cover_tree(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tree over distinct points: their order, and per node (centre, low, high, first child, children) and its radius.

    Centre, low and high are places in that order; children stand together.
    """
    real = points.astype(np.float64)
    norms = (real * real).sum(1)
    order = np.arange(len(points))
    nodes: list[list[int]] = [[0, 0, len(points), 0, 0]] if len(points) else []
    radii: list[float] = []
    at = 0
    while at < len(nodes):
        _, low, high, _, _ = nodes[at]
        own = order[low:high].copy()
        # The centre is the first of the slice.  Slack keeps a radius on the safe side of rounding.
        square = norms[own] + norms[own[0]] - 2 * (real[own] @ real[own[0]])
        far = np.sqrt(np.maximum(square, 0)) * (1 + 1e-9) + 1e-3
        far[0] = 0.0
        radius = float(far.max())
        radii.append(radius)
        if high - low > LEAF:
            half = radius / 2
            nodes[at][3], place = len(nodes), low
            while len(own):
                covered = far <= half
                covered[0] = True
                count = int(covered.sum())
                order[place : place + count] = own[covered]
                nodes.append([place, place, place + count, 0, 0])
                place += count
                own = own[~covered]
                if len(own):
                    square = norms[own] + norms[own[0]] - 2 * (real[own] @ real[own[0]])
                    far = np.sqrt(np.maximum(square, 0)) * (1 + 1e-9) + 1e-3
            nodes[at][4] = len(nodes) - nodes[at][3]
        at += 1
    return order, np.array(nodes, np.int64).reshape(-1, 5), np.array(radii)


def slices(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The places of several slices, one after the other."""
    lengths = high - low
    starts = np.cumsum(lengths) - lengths
    return np.arange(int(lengths.sum())) + np.repeat(low - starts, lengths)


class Tree:
    """Cover tree of one part of a block: distinct points in tree order, and the rows that have them."""

    def __init__(self, points: np.ndarray, place: np.ndarray, nodes: np.ndarray, radii: np.ndarray):
        self.points, self.place, self.nodes, self.radii = points, place, nodes, radii

    @classmethod
    def of(cls, numbers: np.ndarray) -> Tree:
        distinct, back = np.unique(numbers, axis=0, return_inverse=True)
        order, nodes, radii = cover_tree(distinct)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        return cls(distinct[order], place[back.reshape(-1)], nodes, radii)

    def owners(self, entries: np.ndarray, given: list | None = None) -> np.ndarray:
        """The nearest entry of every point; whole subtrees are noted in `given` as (low, high, entry)."""
        owner = np.zeros(len(self.points), np.int64)
        # Equal entries would leave every node ambiguous; the lowest index stands for them.
        distinct, first = np.unique(entries, axis=0, return_index=True)
        rank = np.argsort(first)
        distinct, first = distinct[rank], first[rank]
        level = np.arange(min(len(self.nodes), 1))
        while len(level):
            centre, low, high, child, children = self.nodes[level].T
            index, least, then = nearest(self.points[centre], distinct, second=True)
            gap = np.sqrt(then) * (1 - 1e-9) - np.sqrt(least.astype(np.float64)) * (1 + 1e-9)
            whole = gap > 2 * self.radii[level]
            marks = slices(low[whole], high[whole])
            owner[marks] = np.repeat(first[index[whole]], (high - low)[whole])
            if given is not None:
                given.append((low[whole], high[whole], first[index[whole]]))
            leaf = ~whole & (children == 0)
            marks = slices(low[leaf], high[leaf])
            if len(marks):
                owner[marks] = first[nearest(self.points[marks], distinct)[0]]
                if given is not None:
                    given.append((marks, marks + 1, owner[marks]))
            inner = ~whole & (children > 0)
            level = slices(child[inner], (child + children)[inner])
        return owner

    def add_sums(self, entries: np.ndarray, sums: np.ndarray) -> None:
        """Add count and sum of the rows of each entry to `sums`, one row per entry."""
        weight = np.bincount(self.place, minlength=len(self.points))
        rows = np.concatenate([weight[:, None], self.points * weight[:, None]], axis=1)
        running = np.zeros((len(rows) + 1, rows.shape[1]), np.int64)
        np.cumsum(rows, axis=0, out=running[1:])
        given: list = []
        self.owners(entries, given)
        for low, high, entry in given:
            np.add.at(sums, entry, running[high] - running[low])


def packed_trees(numbers: np.ndarray, parts: int) -> bytes:
    """The trees of a block, one per part."""
    edges = cuts(numbers.shape[1], parts)
    out = io.BytesIO()
    arrays = {}
    for part in range(parts):
        tree = Tree.of(numbers[:, edges[part] : edges[part + 1]])
        small = np.int32 if np.abs(tree.points).max(initial=0) < 1 << 31 else np.int64
        arrays |= {f"points{part}": tree.points.astype(small), f"place{part}": tree.place.astype(np.int32), f"nodes{part}": tree.nodes.astype(np.int32), f"radii{part}": tree.radii}
    np.savez(out, **arrays)
    return out.getvalue()


def unpacked_trees(raw: bytes, parts: int) -> list[Tree]:
    with np.load(io.BytesIO(raw)) as held:
        return [Tree(held[f"points{p}"].astype(np.int64), held[f"place{p}"].astype(np.int64), held[f"nodes{p}"].astype(np.int64), held[f"radii{p}"]) for p in range(parts)]


# -- jobs --------------------------------------------------------------------------------


def finite(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vector.isNotNull() & fine


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def _tree_maker(width: int, parts: int, block_rows: int):
    """Blocks of rows: their ids, labels and trees."""

    def block(held: list):
        rows = pa.Table.from_batches(held).combine_chunks()
        numbers = whole_numbers(_matrix(rows.column("v").chunk(0), width))
        ids, labels = [pa.array([rows.column(c).to_pylist()], pa.list_(rows.schema.field(c).type)) for c in ("vec_id", "label")]
        return pa.RecordBatch.from_arrays([ids, labels, pa.array([packed_trees(numbers, parts)], pa.binary())], ["ids", "labels", "trees"])

    def make(batches):
        held, count = [], 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                take = min(block_rows - count, batch.num_rows - at)
                held.append(batch.slice(at, take))
                at, count = at + take, count + take
                if count == block_rows:
                    yield block(held)
                    held, count = [], 0
        if count:
            yield block(held)

    return make


def _summer(books: list[np.ndarray]):
    """Count and sums of the rows of each entry, one row per task, part and used entry."""

    def add(batches):
        sums = [np.zeros((len(b), b.shape[1] + 1), np.int64) for b in books]
        for batch in batches:
            for raw in batch.column("trees"):
                for tree, book, own in zip(unpacked_trees(raw.as_py(), len(books)), books, sums):
                    tree.add_sums(book, own)
        for part, own in enumerate(sums):
            used = np.flatnonzero(own[:, 0])
            if len(used):
                columns = [pa.array([part] * len(used), pa.int32()), pa.array(used, pa.int32()), pa.array(own[used].tolist(), pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, ["part", "entry", "sums"])

    return add


def _coder(books: list[np.ndarray]):
    """Code and error of every row."""

    def code(batches):
        for batch in batches:
            for ids, labels, raw in zip(batch.column("ids"), batch.column("labels"), batch.column("trees")):
                codes, error = [], np.zeros(len(ids.values), np.int64)
                for tree, book in zip(unpacked_trees(raw.as_py(), len(books)), books):
                    owner = tree.owners(book)
                    error += ((tree.points - book[owner]) ** 2).sum(1)[tree.place]
                    codes.append(owner[tree.place])
                texts = ["".join(f"{x:02x}" for x in row) for row in np.stack(codes, 1).tolist()]
                yield pa.RecordBatch.from_arrays([ids.values, labels.values, pa.array(texts, pa.string()), pa.array(error)], ["vec_id", "label", "code", "error"])

    return code


def first_codebooks(rows: DataFrame, entries: int, parts: int) -> list[np.ndarray]:
    """The parts of the first rows by id that have the length of the very first; at most `entries` rows reach the driver."""
    order = (F.col("vec_id").asc_nulls_last(), "v")
    head = rows.orderBy(*order).limit(1).collect()
    if not head:
        return []
    width = len(head[0]["v"])
    first = rows.where(F.size("v") == width).orderBy(*order).limit(entries).collect()
    numbers = whole_numbers(np.array([r["v"] for r in first], np.float64))
    edges = cuts(width, parts)
    return [numbers[:, edges[p] : edges[p + 1]] for p in range(parts)]


def improved(books: list[np.ndarray], trees: DataFrame) -> list[np.ndarray]:
    """Codebooks after one round; entries x (width + 1) numbers reach the driver."""
    sums = mapped(trees.select("trees"), _summer(books), "part int, entry int, sums array<long>")
    sums = sums.select("part", "entry", F.posexplode("sums").alias("at", "x")).groupBy("part", "entry", "at").agg(F.sum("x").alias("x"))
    total = [np.zeros((len(b), b.shape[1] + 1), np.int64) for b in books]
    for r in sums.collect():
        total[r["part"]][r["entry"], r["at"]] = r["x"]
    return [np.where(t[:, :1] > 0, t[:, 1:] // np.maximum(t[:, :1], 1), b) for t, b in zip(total, books)]


def digest_of(books: list[np.ndarray]) -> str:
    """SHA-256 of all entries' numbers by part, entry and position."""
    return hashlib.sha256(",".join(str(x) for b in books for x in b.reshape(-1).tolist()).encode()).hexdigest()


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", entries: int = ENTRIES, parts: int = PARTS, rounds: int = ROUNDS, block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, list[np.ndarray]]:
    """(vec_id, label, code, error) of every kept row, and the final codebooks."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = rows.where(finite(F.col("v")) & (F.size("v") > 0))
    kind = rows.schema["label"].dataType.simpleString()
    spark = vectors.sparkSession
    books = first_codebooks(rows, entries, parts)
    if not books:
        return spark.createDataFrame([], f"vec_id long, label {kind}, code string, error long"), []
    width = sum(b.shape[1] for b in books)
    # The first rows decide the length; the others of that length are coded.
    same = rows.where(F.size("v") == width)
    with Scratch(spark, "codes") as work:
        trees = work.settle(mapped(same, _tree_maker(width, parts, block_rows), f"ids array<long>, labels array<{kind}>, trees binary"), "trees")
        for _ in range(rounds):
            books = improved(books, trees)
        coded = settle(mapped(trees, _coder(books), f"vec_id long, label {kind}, code string, error long"), "codes")
    return coded, books


def label_errors(coded: DataFrame) -> DataFrame:
    """(of_label, label_error): one row per label, written so that a hot label can be split when joined back."""
    return settle(coded.groupBy(F.col("label").alias("of_label")).agg(F.sum("error").alias("label_error")), "codes-labels")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = compress(table(spark, sf_dir, "embeddings"))
    totals = label_errors(coded)
    joined = coded.join(totals, coded["label"].eqNullSafe(totals["of_label"]))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest_of(books)).alias("codebooks_sha256"))


def _sql() -> str:
    rounds = []
    for i in range(ROUNDS + 1):
        rounds.append(f"""a{i} as materialized (
  select rn, p.part, min(cast(list_inner_product(p.x, p.x) - 2 * list_inner_product(p.x, c.x) + list_inner_product(c.x, c.x) as bigint) * {ENTRIES} + entry) as best
  from p join c{i} c on p.part = c.part group by rn, p.part
)""")
        if i < ROUNDS:
            rounds.append(f"""c{i + 1} as materialized (
  select c.part, c.entry, coalesce(m.x, c.x) as x from c{i} c left join (
    select part, entry, list(cast(mean as double) order by pos) as x from (
      select part, entry, pos, floor(sum(n) / count(*)) as mean from (
        select a.part, a.best % {ENTRIES} as entry, unnest(p.x) as n, unnest(range(len(p.x))) as pos from a{i} a join p on p.rn = a.rn and p.part = a.part
      ) group by part, entry, pos
    ) group by part, entry
  ) m on m.part = c.part and m.entry = c.entry
)""")
    return f"""
with k as materialized (
  select vec_id, label, row_number() over (order by vec_id) as rn, list_transform(embedding, lambda x: floor({SCALE} * cast(x as double))) as v
  from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
),
q as (select rn, v, unnest(range({PARTS})) as part from k),
p as materialized (select rn, part, v[part * len(v) // {PARTS} + 1:(part + 1) * len(v) // {PARTS}] as x from q),
c0 as (select part, rn - 1 as entry, x from p where rn <= {ENTRIES}),
{",".join(rounds)},
d as (select rn, string_agg(printf('%02x', best % {ENTRIES}), '' order by part) as code, cast(sum(best // {ENTRIES}) as bigint) as error from a{ROUNDS} group by rn),
h as (select sha256(string_agg(array_to_string(list_transform(x, lambda y: cast(cast(y as bigint) as varchar)), ','), ',' order by part, entry)) as codebooks_sha256 from c{ROUNDS})
select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error, codebooks_sha256
from k join d using (rn), h
"""


SQL = _sql()
