"""Repeated line runs: later copies of runs of lines go, found by distributed prefix doubling.

All lines that hold a word form one sequence, documents in id order with a gap between
them, and each line is named by its digest.  The rank of a suffix at depth 2**k is the
first position whose next 2**k lines are the same; ranks at depth 2**(k + 1) come from
the pair (rank of p, rank of p + 2**k), as in suffix array construction.  Positions with
the same rank form an LCP interval of at least that depth, and a rank that no other
position has ends there, so each round is smaller than the last.

A run of lines with at least `least_words` words that also stands earlier is a copy, and
its lines go.  A maximal repeated run is the union of its shortest stretches with that
many words, counted from each of its lines forwards and backwards; so it is enough to
look at two stretches per position, whose LCP interval at their exact length l is the
pair of ranks at p and p + l - 2**k.  Stretches have at most `least_words` lines, which
bounds the rounds by its logarithm.

Only positions and ranks are shuffled.  The first position of an interval comes from a
partial aggregation, is written, and meets the positions in an equi-join that adaptive
execution can split, so a line that a third of all documents share is never gathered.

Defined cases: null text stays null and has no lines; lines without a word are never
deleted and do not interrupt a run; of repeated documents the first in id order stays
whole (null ids last); a document whose last line with a word goes is dropped; very long
texts are compared whole; an empty table gives an empty result; columns of the caller keep
their names and values whatever they are called.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skyledger.llm.common import SPACE, Scratch, as_bytes, mapped, numbered, renamed, settle, shuffle_join, table

LEAST_WORDS = 50
LINES = "rid long, idx long, digest binary, words long"
STRETCHES = "rid long, idx long, pos long, len long"


def _lines(batches):
    kinds = (pa.int64(), pa.int64(), pa.binary(), pa.int64())
    names = [x.split()[0] for x in LINES.split(", ")]
    for batch in batches:
        rows = []
        for rid, raw in zip(batch.column("rid").to_pylist(), as_bytes(batch.column("text"))):
            idx = 0
            for line in raw.split(b"\n"):
                words = len(line.split())
                if words:
                    rows.append((rid, idx, hashlib.sha256(line).digest()[:16], words))
                    idx += 1
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


def document_starts(counts: DataFrame, work: Scratch) -> DataFrame:
    """(rid, base): the position of a document's first line, by id; `counts` has rid, doc_id, n.

    A range-partitioned sort and the partitions' sums (one row a partition on the
    driver) replace a single ordered window.
    """
    spark = counts.sparkSession
    ordered = counts.orderBy(F.col("doc_id").asc_nulls_last(), "rid").select("rid", "n", F.monotonically_increasing_id().alias("ord"))
    ordered = work.settle(ordered.withColumn("part", F.shiftright("ord", 33)), "lines-order")
    base, rows = 0, []
    for part, total in sorted(ordered.groupBy("part").agg(F.sum(F.col("n") + 1)).collect()):
        rows.append((part, base))
        base += total
    offsets = spark.createDataFrame(rows, "part long, offset long")
    earlier = Window.partitionBy("part").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    within = F.coalesce(F.sum(F.col("n") + 1).over(earlier), F.lit(0))
    return ordered.withColumn("within", within).join(F.broadcast(offsets), "part").select("rid", (F.col("offset") + F.col("within")).alias("base"))


def shared_ranks(rows: DataFrame, key: list[str], work: Scratch) -> DataFrame:
    """(pos, rank) of the positions whose key another position has; rank is the first such position."""
    first = rows.groupBy(*key).agg(F.min("pos").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    first = work.settle(first, "first")
    return shuffle_join(rows, first, key).select("pos", F.col("first").alias("rank"))


def stretches(pos: np.ndarray, words: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(first row, lines) of the shortest stretches of consecutive positions with `least` words.

    Counted forwards from every row and backwards from every row; rows are sorted by position.
    """
    if not len(pos):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    after = np.cumsum(words)
    before = after - words
    breaks = np.flatnonzero(np.diff(pos) != 1)
    run = np.zeros(len(pos), np.int64)
    run[breaks + 1] = 1
    run = np.cumsum(run)
    run_last = np.append(breaks, len(pos) - 1)[run]
    run_first = np.insert(breaks + 1, 0, 0)[run]
    rows = np.arange(len(pos))
    last = np.searchsorted(after, before + least)
    ahead = last <= run_last
    first = np.searchsorted(before, after - least, "right") - 1
    back = first >= run_first
    starts = np.concatenate([rows[ahead], first[back]])
    lines = np.concatenate([last[ahead] - rows[ahead], rows[back] - first[back]]) + 1
    pairs = np.unique(np.stack([starts, lines], 1), axis=0)
    return pairs[:, 0], pairs[:, 1]


def _stretch_maker(least: int):
    names = [x.split()[0] for x in STRETCHES.split(", ")]

    def made(table_: pa.Table):
        rid, idx, pos, words = (table_.column(c).to_numpy() for c in ("rid", "idx", "pos", "words"))
        first, lines = stretches(pos, words, least)
        if len(first):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (rid[first], idx[first], pos[first], lines)], names)

    def make(batches):
        # The last document of a batch may go on in the next; its rows wait.
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            rid = batch.column("rid").to_numpy()
            cut = int(np.searchsorted(rid != rid[-1], False)) if rid[0] == rid[-1] else int(np.flatnonzero(rid != rid[-1])[-1]) + 1
            if cut:
                yield from made(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                held = []
            elif held and held[-1].column("rid")[-1].as_py() != rid[0]:
                yield from made(pa.Table.from_batches(held))
                held = []
            held.append(batch.slice(cut))
        if held:
            yield from made(pa.Table.from_batches(held))

    return make


def copied_runs(docs: DataFrame, work: Scratch, least_words: int = LEAST_WORDS) -> DataFrame:
    """(rid, idx, len): runs of lines, counted over lines with a word, that stand earlier too.

    `docs` has rid (unique), doc_id and text, and gives the same rows whenever it is read;
    the result reads tables of `work`.
    """
    lines = work.settle(mapped(docs.select("rid", "text"), _lines, LINES), "lines")
    counts = lines.groupBy("rid").agg(F.count("*").alias("n")).join(docs.select("rid", "doc_id"), "rid")
    starts = document_starts(counts, work)
    placed = lines.join(starts, "rid").select("rid", "idx", "words", "digest", (F.col("base") + F.col("idx")).alias("pos"))
    placed = work.settle(placed, "lines-placed")
    first = placed.groupBy("digest").agg(F.min("pos").alias("rank"), F.count("*").alias("n")).where("n > 1").drop("n")
    first = work.settle(first, "lines-first")
    shared = work.settle(shuffle_join(placed, first, "digest").select("rid", "idx", "words", "pos", "rank"), "lines-shared")

    sorted_ = shared.select("rid", "idx", "pos", "words").repartition("rid").sortWithinPartitions("rid", "pos")
    asked = work.settle(mapped(sorted_, _stretch_maker(least_words), STRETCHES), "lines-stretches")
    longest = asked.agg(F.max("len")).first()[0] or 0

    ranks, depth, copies = shared.select("pos", "rank"), 1, None
    while depth <= longest:
        own = asked.where((F.col("len") >= depth) & (F.col("len") < 2 * depth))
        own = shuffle_join(own, ranks.select("pos", F.col("rank").alias("head")), "pos")
        own = own.withColumn("other", F.col("pos") + F.col("len") - depth)
        own = work.settle(shuffle_join(own, ranks.select(F.col("pos").alias("other"), F.col("rank").alias("tail")), "other"), f"lines-asked-{depth}")
        interval = own.groupBy("len", "head", "tail").agg(F.min("pos").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
        interval = work.settle(interval, f"lines-intervals-{depth}")
        later = shuffle_join(own, interval, ["len", "head", "tail"]).where("pos > first").select("rid", "idx", "len")
        copies = later if copies is None else copies.union(later)
        if 2 * depth <= longest:
            ahead = ranks.select((F.col("pos") - depth).alias("pos"), F.col("rank").alias("next"))
            ranks = work.settle(shared_ranks(shuffle_join(ranks, ahead, "pos"), ["rank", "next"], work), f"lines-ranks-{2 * depth}")
        depth *= 2
    empty = docs.sparkSession.createDataFrame([], "rid long, idx long, len long")
    return empty if copies is None else copies


def merged(spans: list) -> list[tuple[int, int]]:
    """Sorted (first, lines) stretches as disjoint [a, b) ranges."""
    out: list[list[int]] = []
    for a, n in spans:
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], a + n)
        else:
            out.append([a, a + n])
    return [(a, b) for a, b in out]


def _ranges(copies: DataFrame) -> DataFrame:
    spans = F.sort_array(F.collect_set(F.struct(F.col("idx"), F.col("len"))))
    return copies.groupBy("rid").agg(spans.alias("spans"))


def without(raw: bytes, spans: list) -> tuple[bytes, int, int, list[tuple[int, int]]]:
    """Text without the given lines, lines with a word before, lines deleted, and their ranges."""
    ranges = merged([(s["idx"], s["len"]) for s in spans])
    gone = {i for a, b in ranges for i in range(a, b)}
    out, idx = [], 0
    for line in raw.split(b"\n"):
        if line.strip(SPACE):
            if idx not in gone:
                out.append(line)
            idx += 1
        else:
            out.append(line)
    return b"\n".join(out), idx, len(gone), ranges


def _cutter(text_at: int, chars_at: int | None, keep: int):
    """The columns with shorter texts; documents that lost all lines are left out."""

    def cut(batches):
        for batch in batches:
            texts, stay = [], []
            for raw, spans in zip(batch.column(text_at).cast(pa.binary()).to_pylist(), batch.column(keep).to_pylist()):
                if spans:
                    raw, lines, gone, _ = without(raw, spans)
                    stay.append(gone < lines)
                else:
                    stay.append(True)
                texts.append(None if raw is None else raw.decode())
            columns = [batch.column(i) for i in range(keep)]
            columns[text_at] = pa.array(texts, pa.string())
            if chars_at is not None:
                changed = [len(t) if s else c for t, s, c in zip(texts, batch.column(keep).to_pylist(), columns[chars_at].to_pylist())]
                columns[chars_at] = pa.array(changed, pa.int64())
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names[:keep]).filter(pa.array(stay, pa.bool_()))

    return cut


def _reporter(batches):
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
    for batch in batches:
        rows = []
        for doc_id, raw, spans in zip(batch.column("doc_id").to_pylist(), as_bytes(batch.column("text")), batch.column("spans").to_pylist()):
            text, lines, gone, ranges = without(raw, spans or [])
            rows.append((doc_id, lines, gone, ",".join(f"{a}-{b - 1}" for a, b in ranges), hashlib.sha256(text).hexdigest()))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["doc_id", "n_lines", "n_deleted", "deleted", "text_sha256"])


def _kept(docs: DataFrame, id_col: str, text_col: str, least_words: int) -> tuple[DataFrame, dict[str, str]]:
    """Documents under neutral names with `spans`, the runs to delete; and the names."""
    kept, names = numbered(docs, "lines-docs")
    named = dict(zip(docs.columns, names))
    own = kept.select("rid", F.col(named[id_col]).cast("long").alias("doc_id"), F.col(named[text_col]).cast("string").alias("text"))
    with Scratch(docs.sparkSession, "lines") as work:
        ranges = settle(_ranges(copied_runs(own, work, least_words)), "lines-copies")
    return shuffle_join(kept, ranges, "rid", "left"), named


def without_copied_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = LEAST_WORDS) -> DataFrame:
    """The documents without the lines of later copies, in the columns of `docs`."""
    joined, named = _kept(docs, id_col, text_col, least_words)
    names = list(named.values())
    chars = docs.columns.index("n_chars") if "n_chars" in docs.columns else None
    cut = mapped(joined.select(*names, "spans"), _cutter(docs.columns.index(text_col), chars, len(names)), renamed(docs.schema, names))
    return cut.toDF(*docs.columns)


def line_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = LEAST_WORDS) -> DataFrame:
    """doc_id, n_lines, n_deleted, deleted (line ranges among lines with a word), text_sha256 of what stays."""
    joined, named = _kept(docs, id_col, text_col, least_words)
    own = joined.select(F.col(named[id_col]).cast("long").alias("doc_id"), F.col(named[text_col]).cast("string").alias("text"), "spans")
    return mapped(own, _reporter, "doc_id long, n_lines long, n_deleted long, deleted string, text_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_report(table(spark, sf_dir, "documents"))
