"""Ordered scans over keyed rows that stay parallel when one key is very large.

A window partitioned by the key alone puts every row of that key in one task.
Here the rows of keys that are too large are range-partitioned along key and
order into *blocks* of a bounded number of rows; each block is scanned on its
own, and one small row per block carries the result of all earlier blocks
forward.  Ordinary keys stay whole, and when no key is large the plan is a plain
window with no extra join.

`hot_hashes` counts the rows of each key: one narrow column, summed before the
shuffle, and only the keys above the limit reach the driver, at most one per
`limit` rows of input.  Blocks follow the same order as the windows (nulls
first), and the cut rows are written once, so all branches of a plan agree and
which keys are cut never changes a result.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyledger.session import settle

BLOCK = "_block"
HOT_ROWS_CONF = "spark.skyledger.hotKeyRows"
HOT_ROWS_DEFAULT = 1_000_000
# Rows per block of a large key; by default the same limit.
BLOCK_ROWS_CONF = "spark.skyledger.blockRows"
# Beyond so many large keys a lookup is left to the skew handling of the join.
MOST_BROADCAST_KEYS = 4_096


def _limit(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get(HOT_ROWS_CONF, str(HOT_ROWS_DEFAULT)))


def hot_hashes(df: DataFrame, keys: Sequence[str]) -> list[int]:
    """Hashes of the keys holding more rows than one task should scan.

    Two keys with the same hash are counted together, which is harmless.
    """
    counts = df.select(F.xxhash64(*keys).alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    return sorted(r.h for r in counts.filter(F.col("n") > _limit(df)).select("h").collect())


def hot_frame(df: DataFrame, hashes: Sequence[int]) -> DataFrame:
    """The large-key hashes as a frame, at most one row per `limit` rows of input."""
    return df.sparkSession.createDataFrame([(h,) for h in hashes], "_hot long")


def lookup_join(
    left: DataFrame, right: DataFrame, key: str, hashes: Sequence[int], how: str = "left"
) -> DataFrame:
    """Join to a right side that has few rows per key.

    Rows of large keys meet a broadcast of the right rows for those keys only
    (at most MOST_BROADCAST_KEYS keys); all other rows, and all rows when more
    keys are large, take the ordinary join.
    """
    if not hashes or len(hashes) > MOST_BROADCAST_KEYS:
        return left.join(right, key, how)
    hot = F.broadcast(hot_frame(left, hashes))
    matches = F.xxhash64(key) == F.col("_hot")
    hot_part = left.join(hot, matches, "left_semi").join(
        F.broadcast(right.join(hot, matches, "left_semi")), key, how
    )
    rest = left.join(hot, matches, "left_anti").join(right, key, how)
    return hot_part.unionByName(rest)


@dataclass(frozen=True)
class Scan:
    """One ordered scan: inside a block, over whole blocks, and both merged."""

    out: str
    local: Callable[[Window, Sequence[str]], Column]
    total: Callable[[Sequence[str]], Column]
    carry: Callable[[Column, Window], Column]
    merge: Callable[[Column, Column], Column]


_START = Window.unboundedPreceding


def running_sum(col: str, out: str) -> Scan:
    """Sum of `col` up to and including the row."""
    return Scan(
        out,
        lambda w, order: F.sum(col).over(w.rowsBetween(_START, 0)),
        lambda order: F.sum(col),
        lambda total, w: F.sum(total).over(w.rowsBetween(_START, -1)),
        lambda local, carry: F.coalesce(carry, F.lit(0)) + local,
    )


def running_max(col: str, out: str, inclusive: bool = True) -> Scan:
    """Largest `col` up to the row, with or without the row itself."""
    end = 0 if inclusive else -1
    return Scan(
        out,
        lambda w, order: F.max(col).over(w.rowsBetween(_START, end)),
        lambda order: F.max(col),
        lambda total, w: F.max(total).over(w.rowsBetween(_START, -1)),
        lambda local, carry: F.greatest(local, carry),
    )


def rank(out: str) -> Scan:
    """Position of the row within its key, from 1."""
    return Scan(
        out,
        lambda w, order: F.row_number().over(w).cast("long"),
        lambda order: F.count(F.lit(1)),
        lambda total, w: F.sum(total).over(w.rowsBetween(_START, -1)),
        lambda local, carry: F.coalesce(carry, F.lit(0)) + local,
    )


def last_known(col: str, out: str, inclusive: bool = True) -> Scan:
    """Latest non-null `col` up to the row, with or without the row itself."""
    end = 0 if inclusive else -1
    return Scan(
        out,
        lambda w, order: F.last(col, ignorenulls=True).over(w.rowsBetween(_START, end)),
        lambda order: F.max_by(col, F.when(F.col(col).isNotNull(), F.struct(*order))),
        lambda total, w: F.last(total, ignorenulls=True).over(w.rowsBetween(_START, -1)),
        lambda local, carry: F.coalesce(local, carry),
    )


def previous(col: str, out: str) -> Scan:
    """`col` of the row before; `col` must not be null (use a struct)."""
    return Scan(
        out,
        lambda w, order: F.lag(col).over(w),
        lambda order: F.max_by(col, F.struct(*order)),
        lambda total, w: F.lag(total).over(w),
        lambda local, carry: F.coalesce(local, carry),
    )


def following(col: str, out: str) -> Scan:
    """`col` of the row after; `col` must not be null (use a struct)."""
    return Scan(
        out,
        lambda w, order: F.lead(col).over(w),
        lambda order: F.min_by(col, F.struct(*order)),
        lambda total, w: F.lead(total).over(w),
        lambda local, carry: F.coalesce(local, carry),
    )


@dataclass(frozen=True)
class Ordered:
    """Rows of `df` in `order` within `keys`; `split` if some keys have blocks."""

    df: DataFrame
    keys: tuple[str, ...]
    order: tuple[str, ...]
    split: bool = False
    hashes: tuple[int, ...] = ()

    @classmethod
    def of(
        cls,
        df: DataFrame,
        keys: Sequence[str],
        order: Sequence[str],
        hashes: Sequence[int] | None = None,
    ) -> "Ordered":
        """Order `df`; `order` must be free of ties within a key."""
        found = hot_hashes(df, keys) if hashes is None else list(hashes)
        if not found:
            return cls(df, tuple(keys), tuple(order))
        hot = F.broadcast(hot_frame(df, found))
        matches = F.xxhash64(*keys) == F.col("_hot")
        large = df.join(hot, matches, "left_semi")
        rows = int(df.sparkSession.conf.get(BLOCK_ROWS_CONF, str(_limit(df))))
        blocks = large.repartitionByRange(max(2, -(-large.count() // rows)), *keys, *order)
        cut = settle(blocks.withColumn(BLOCK, F.spark_partition_id().cast("long")), "blocks")
        whole = df.join(hot, matches, "left_anti").withColumn(BLOCK, F.lit(None).cast("long"))
        return cls(whole.unionByName(cut), tuple(keys), tuple(order), True, tuple(found))

    def window(self) -> Window:
        """Window over one block (the whole key unless it was cut)."""
        parts = (*self.keys, BLOCK) if self.split else self.keys
        return Window.partitionBy(*parts).orderBy(*self.order)

    def on(self, df: DataFrame, more_keys: Sequence[str] = ()) -> "Ordered":
        """The same order over a frame derived row by row from this one.

        `more_keys` are columns that split the keys further.
        """
        return Ordered(df, (*self.keys, *more_keys), self.order, self.split, self.hashes)

    def carry(self, df: DataFrame, totals: dict[str, Column], carried: dict[str, Callable]) -> DataFrame:
        """One row per block of the large keys with values from earlier blocks.

        `totals` aggregates a block; `carried` maps an output name to a function
        of the window over the blocks of a key.
        """
        blocks = (
            df.filter(F.col(BLOCK).isNotNull())
            .groupBy(*self.keys, BLOCK)
            .agg(*[c.alias(n) for n, c in totals.items()])
        )
        over = Window.partitionBy(*self.keys).orderBy(BLOCK)
        return blocks.select(*self.keys, BLOCK, *[f(over).alias(n) for n, f in carried.items()])

    def with_carry(self, df: DataFrame, carry: DataFrame) -> DataFrame:
        """Attach a carry frame to the rows of its block; null keys are keys like others."""
        named = carry.withColumnsRenamed({k: f"_of_{k}" for k in (*self.keys, BLOCK)})
        same = F.col(BLOCK) == F.col(f"_of_{BLOCK}")
        for k in self.keys:
            same = same & F.col(k).eqNullSafe(F.col(f"_of_{k}"))
        return df.join(named, same, "left").drop(*[f"_of_{k}" for k in (*self.keys, BLOCK)])

    def scan(self, *scans: Scan) -> "Ordered":
        """Add the output column of each scan."""
        w = self.window()
        if not self.split:
            return self.on(self.df.withColumns({s.out: s.local(w, self.order) for s in scans}))
        totals = {f"_t{i}": s.total(self.order) for i, s in enumerate(scans)}
        carried = {
            f"_c{i}": (lambda over, s=s, i=i: s.carry(F.col(f"_t{i}"), over)) for i, s in enumerate(scans)
        }
        joined = self.with_carry(
            self.df.withColumns({s.out: s.local(w, self.order) for s in scans}),
            self.carry(self.df, totals, carried),
        )
        merged = joined.withColumns(
            {s.out: s.merge(F.col(s.out), F.col(f"_c{i}")) for i, s in enumerate(scans)}
        ).drop(*carried)
        return self.on(merged)

    def rows(self) -> DataFrame:
        """The rows without the block column."""
        return self.df.drop(BLOCK)
