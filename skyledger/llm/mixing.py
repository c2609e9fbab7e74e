"""Mixing sources to target weights.

Each source's words form one stream (documents in a hashed but fixed order), cut into
blocks of `block` words; a document knows its place by a two-level running sum.  The
targets fix how many block slots each source gets.  An output shard's source counts are
multinomial draws conditioned on those totals (multivariate hypergeometric): a shard
finds its own counts, and the first slot number of each source, by walking down a tree
of seeded halvings, so no shard waits for another.  Slot j of a source with n blocks is
block `permutation(j // n)(j % n)` of a keyed Feistel permutation; slots and blocks
meet in an equi-join on (source, block).

A source with a target of at most three times its size gets at most three slots per
block, so no document is taken more than three times.

Bounded driver work: one row per source (name and words).  Above 5e8 slots the
hypergeometric draw uses its normal limit.

Defined cases: null text has size 0; null is a source of its own and comes last; a
document without words takes nothing; very long texts are cut into blocks like others;
repeated rows are separate documents; an empty table gives an empty result; columns of the
caller keep their names and values whatever they are called.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyledger.llm.common import SPACE_CLASS, mapped, numbered, renamed, running_start, settle, shuffle_join, table

WEIGHTS = (5, 2, 1)
MOST_TIMES = 3
BLOCK_WORDS = 64
SHARD_SLOTS = 1 << 14
SEED = 20260
EXACT_DRAW = 500_000_000


def word_count(text) -> F.Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(f"[^{SPACE_CLASS}]+")).cast("long")


def targets(sizes: list[int], weights: tuple = WEIGHTS, most: int = MOST_TIMES) -> list[float]:
    """Share the total by weight; what is above `most` times a size goes to the others by weight."""
    total = float(sum(sizes))
    weight = [weights[i % len(weights)] for i in range(len(sizes))]
    out = [0.0] * len(sizes)
    open_ = [i for i in range(len(sizes))]
    left = total
    while open_:
        of = sum(weight[i] for i in open_)
        above = [i for i in open_ if left * weight[i] / of > most * sizes[i]]
        if not above:
            for i in open_:
                out[i] = left * weight[i] / of
            break
        for i in above:
            out[i] = float(most * sizes[i])
            open_.remove(i)
        left = total - sum(out)
    return out


def slot_totals(sizes: list[int], wanted: list[float], block: int) -> tuple[list[int], list[int]]:
    """Blocks per source, and slots per source: the target over the mean block length."""
    blocks = [-(-n // block) for n in sizes]
    slots = [min(MOST_TIMES * b, round(t * b / n)) if n else 0 for n, t, b in zip(sizes, wanted, blocks)]
    return blocks, slots


def _left_share(counts: list[int], take: int, rng: np.random.Generator) -> list[int]:
    """Multivariate hypergeometric draw of `take` slots, source by source."""
    out, rest = [], sum(counts)
    for n in counts:
        rest -= n
        if take == 0 or n == 0:
            got = 0
        elif rest == 0:
            got = take
        elif n + rest < EXACT_DRAW:
            got = int(rng.hypergeometric(n, rest, take))
        else:
            whole = n + rest
            mean = take * n / whole
            spread = (mean * (rest / whole) * (whole - take) / (whole - 1)) ** 0.5
            got = int(min(max(round(rng.normal(mean, spread)), take - rest, 0), n, take))
        out.append(got)
        take -= got
    return out


def shard_counts(shard: int, slots: list[int], shard_slots: int, seed: int) -> tuple[list[int], list[int]]:
    """Slots of each source in one output shard, and the first slot number of each."""
    total = sum(slots)
    low, high = 0, -(-total // shard_slots)
    counts, first = list(slots), [0] * len(slots)
    while high - low > 1:
        middle = (low + high) // 2
        rng = np.random.default_rng([seed, low, high])
        left = _left_share(counts, (middle - low) * shard_slots, rng)
        if shard < middle:
            counts, high = left, middle
        else:
            first = [f + n for f, n in zip(first, left)]
            counts, low = [c - n for c, n in zip(counts, left)], middle
    return counts, first


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def permuted(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """Keyed pseudorandom permutation of range(n): four Feistel rounds, walked until inside."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    value = index.astype(np.uint64)
    todo = np.ones(len(value), bool)
    while todo.any():
        left, right = value[todo] >> shift, value[todo] & mask
        for turn in range(4):
            salt = np.uint64((key * 4 + turn + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
            left, right = right, left ^ (_mix(right + salt) & mask)
        value[todo] = (left << shift) | right
        todo = value >= n
    return value.astype(np.int64)


def _slot_maker(blocks: list[int], slots: list[int], shard_slots: int, seed: int):
    def make(batches):
        for batch in batches:
            for shard in batch.column("id").to_pylist():
                counts, first = shard_counts(shard, slots, shard_slots, seed)
                for s, (n, start) in enumerate(zip(counts, first)):
                    if n == 0:
                        continue
                    slot = np.arange(start, start + n, dtype=np.int64)
                    epoch, index = slot // blocks[s], slot % blocks[s]
                    block = np.empty(n, np.int64)
                    for e in np.unique(epoch):
                        own = epoch == e
                        block[own] = permuted(index[own], blocks[s], (seed * 1_000_003 + s) * 4 + int(e))
                    columns = (np.full(n, shard, np.int64), np.full(n, s, np.int32), slot, epoch.astype(np.int32), block)
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["shard", "source_no", "slot", "epoch", "block"])

    return make


class Mix:
    """The mix of `sized`: (rid unique, doc_id, source, size) rows, written or otherwise repeatable."""

    def __init__(self, sized: DataFrame, weights: tuple = WEIGHTS, block: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, seed: int = SEED):
        self.spark, self.sized, self.block, self.shard_slots, self.seed = sized.sparkSession, sized, block, shard_slots, seed
        totals = sized.groupBy("source").agg(F.sum("size").alias("n")).orderBy(F.col("source").asc_nulls_last()).collect()
        self.names = [r.source for r in totals]
        self.sizes = [r.n for r in totals]
        self.targets = targets(self.sizes, weights)
        self.blocks, self.slots = slot_totals(self.sizes, self.targets, block)
        rows = [(i, s, n, t) for i, (s, n, t) in enumerate(zip(self.names, self.sizes, self.targets))]
        self.sources = self.spark.createDataFrame(rows, "source_no int, source_name string, source_size long, target double")

    def numbered(self) -> DataFrame:
        """Documents with their source's number, size and target."""
        d = self.sized
        return d.join(self.sources, d["source"].eqNullSafe(self.sources["source_name"])).drop("source", "source_name")

    def shards(self) -> DataFrame:
        """(shard, source_no, slot, epoch, block): the mix itself, one row per slot."""
        count = -(-sum(self.slots) // self.shard_slots)
        ids = self.spark.range(0, count, 1, max(1, min(count, int(self.spark.conf.get("spark.sql.shuffle.partitions")))))
        return mapped(ids, _slot_maker(self.blocks, self.slots, self.shard_slots, self.seed), "shard long, source_no int, slot long, epoch int, block long")

    def spans(self) -> DataFrame:
        """(rid, source_no, block, first, last): words [first, last) of a document in a block of its source."""
        order = [F.col("doc_id").asc_nulls_last(), F.col("size"), F.col("rid")]
        docs = self.numbered().where("size > 0").select("rid", "doc_id", "source_no", "size")
        placed = running_start(docs, "source_no", ["doc_id"], order, F.col("size"))
        size = F.lit(self.block)
        end = F.col("start") + F.col("size")
        cut = placed.select("rid", "source_no", "start", "size", F.explode(F.sequence(F.floor(F.col("start") / size), F.floor((end - 1) / size))).alias("block"))
        first = F.greatest(F.lit(0), F.col("block") * size - F.col("start"))
        last = F.least(F.col("size"), (F.col("block") + 1) * size - F.col("start"))
        return cut.select("rid", "source_no", "block", first.alias("first"), last.alias("last"))

    def taken(self) -> DataFrame:
        """(rid, taken): words the mix takes of each document that it touches."""
        times = self.shards().groupBy("source_no", "block").agg(F.count("*").alias("times"))
        joined = shuffle_join(self.spans(), times, ["source_no", "block"])
        return joined.groupBy("rid").agg(F.sum((F.col("last") - F.col("first")) * F.col("times")).alias("taken"))

    def parts(self) -> DataFrame:
        """(rid, epoch, spans): the word ranges of a document taken in each pass over its source."""
        joined = shuffle_join(self.spans(), self.shards().select("source_no", "block", "epoch"), ["source_no", "block"])
        return joined.groupBy("rid", "epoch").agg(F.sort_array(F.collect_list(F.struct("first", "last"))).alias("spans"))


def mix_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, size, source_size, target, taken for every document."""
    sized = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"))
    mix = Mix(settle(sized, "mix-sizes"))
    rows = shuffle_join(mix.numbered(), mix.taken(), "rid", "left")
    return rows.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def _cut(text_at: int, chars_at: int | None):
    def cut(batches):
        for batch in batches:
            texts = []
            for raw, spans in zip(batch.column(text_at).cast(pa.binary()).to_pylist(), batch.column("spans").to_pylist()):
                words = None
                merged: list[list[int]] = []
                for s in spans:
                    if merged and merged[-1][1] == s["first"]:
                        merged[-1][1] = s["last"]
                    else:
                        merged.append([s["first"], s["last"]])
                if len(merged) == 1 and merged[0][0] == 0:
                    words = raw.split()
                    if len(words) == merged[0][1]:
                        texts.append(raw.decode())
                        continue
                words = words or raw.split()
                texts.append("\n".join(b" ".join(words[a:b]).decode() for a, b in merged))
            columns = [batch.column(i) for i in range(batch.num_columns - 1)]
            columns[text_at] = pa.array(texts, pa.string())
            if chars_at is not None:
                columns[chars_at] = pa.array([len(x) for x in texts], pa.int64())
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names[:-1])

    return cut


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix as documents: one row per document and pass, its text cut to the words taken.

    A wholly taken text stays as it is; of others the taken runs of words are joined by
    blanks, one line per run.  Columns and their order are those of `docs`.
    """
    kept, names = numbered(docs, "mix-docs")
    named = dict(zip(docs.columns, names))
    sized = kept.select("rid", F.col(named[id_col]).cast("long").alias("doc_id"), F.col(named[source_col]).cast("string").alias("source"), word_count(F.col(named[text_col])).alias("size"))
    parts = Mix(settle(sized, "mix-sizes")).parts()
    joined = shuffle_join(kept, parts.select("rid", "spans"), "rid").select(*names, "spans")
    chars = docs.columns.index("n_chars") if "n_chars" in docs.columns else None
    return mapped(joined, _cut(docs.columns.index(text_col), chars), renamed(docs.schema, names)).toDF(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_report(table(spark, sf_dir, "documents"))
