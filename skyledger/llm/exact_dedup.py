"""Exact duplicates by distributed MSD radix partitioning.

Texts are split by successive digits of bytes.  A digit of level k is
`first * factor**k` bytes wide, so a text of n bytes has about log(n) digits.  In
round k the documents that still share everything before digit k are grouped by
(group, digit k): a document alone in its group is done, a group whose digit is
shorter than the level's width has ended and is a group of equal texts, and the
others go on to the next digit.  Equality rests on the bytes alone; the SHA-256 is
only reported.

Each digit is its own row in a table partitioned by level, so every byte is shuffled
at most twice, and a group of copies of any size is only ever counted (with partial
aggregation) and joined, never gathered.  Counts are written before they are joined
back, which lets adaptive execution split the join of a hot group.

Defined cases: null text counts as empty and all empty texts are equal; a null id
sorts after every other id and can be kept only when no copy has an id; of repeated
rows with equal ids one row is kept; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyledger.llm.common import SPACE, Scratch, as_bytes, mapped, settle, shuffle_join, table

FIRST_WIDTH = 32
FACTOR = 4

PIECES = "level int, rid long, digit binary, doc_id long, points long, sha string"


def _cutter(first: int, factor: int):
    """Rows of digits per document; level 0 also carries the report columns."""

    def cut(batches):
        rid = TaskContext.get().partitionId() << 40
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            points = batch.column("points").to_pylist()
            out: list[tuple] = []
            held = 0
            for doc_id, n, raw in zip(ids, points, as_bytes(batch.column("text"))):
                body = raw.translate(None, SPACE)
                out.append((0, rid, body[:first], doc_id, n, hashlib.sha256(body).hexdigest()))
                at, width, level = first, first * factor, 1
                while at < len(body):
                    out.append((level, rid, body[at : at + width], None, None, None))
                    at, width, level = at + width, width * factor, level + 1
                rid += 1
                held += len(body)
                if held > 8 << 20:
                    yield _batch(out)
                    out, held = [], 0
            if out:
                yield _batch(out)

    return cut


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.string())
    names = ("level", "rid", "digit", "doc_id", "points", "sha")
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], list(names))


def equal_groups(pieces, first: int, factor: int, work: Scratch) -> DataFrame:
    """(rid, rep) of every document that has an equal one; `pieces(level)` gives (rid, digit)."""
    level, width, found = 0, first, None
    live = pieces(0).select("rid", F.lit(0).cast("long").alias("grp"), "digit")
    while True:
        shared = live.groupBy("grp", "digit").agg(F.count("*").alias("n"), F.min("rid").alias("rep")).where("n > 1").drop("n")
        shared = work.settle(shared, f"groups-{level}")
        joined = shuffle_join(live, shared, ["grp", "digit"]).select("rid", "rep", (F.length("digit") < width).alias("ended"))
        joined = work.settle(joined, f"shared-{level}")
        ended = joined.where("ended").select("rid", "rep")
        found = ended if found is None else found.union(ended)
        open_ = joined.where("not ended").select("rid", F.col("rep").alias("grp"))
        if open_.isEmpty():
            return found
        level, width = level + 1, width * factor
        live = open_.join(pieces(level), "rid", "left").select("rid", "grp", F.coalesce("digit", F.lit(b"")).alias("digit"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", first: int = FIRST_WIDTH, factor: int = FACTOR) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every document."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.length(text).cast("long").alias("points"))
    schema = "rid long, digit binary, doc_id long, points long, sha string, level int"
    with Scratch(spark, "radix") as work:
        path = f"{work.path}/digits"
        mapped(source, _cutter(first, factor), PIECES).write.partitionBy("level").parquet(path)

        def level_of(level: int) -> DataFrame:
            return spark.read.schema(schema).parquet(path).where(F.col("level") == level)

        groups = equal_groups(lambda level: level_of(level).select("rid", "digit"), first, factor, work)
        rows = level_of(0).select("rid", "doc_id", "points", "sha").join(groups, "rid", "left")
        rows = settle(rows.withColumn("grp", F.coalesce("rep", "rid")).drop("rep"), "radix-rows")
    rank = F.struct((-F.col("points")).alias("less"), F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("keep_id"), F.col("rid").alias("keep_rid"))
    best = settle(rows.groupBy("grp").agg(F.min(rank).alias("best"), F.count("*").alias("group_size")), "radix-best")
    return shuffle_join(rows, best, "grp").select(
        "doc_id",
        F.col("best.keep_id").alias("keep_id"),
        "group_size",
        (F.col("rid") == F.col("best.keep_rid")).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


SQL = r"""
with t as (
  select doc_id, coalesce(text, '') as raw,
         regexp_replace(coalesce(text, ''), '[ \t\n\x0B\x0C\r]', '', 'g') as body
  from documents
), r as (
  select doc_id, body,
         first_value(doc_id) over (partition by body order by length(raw) desc, doc_id nulls last) as keep_id,
         count(*) over (partition by body) as group_size,
         row_number() over (partition by body order by length(raw) desc, doc_id nulls last) = 1 as kept
  from t
)
select doc_id, keep_id, group_size, kept, sha256(body) as text_sha256 from r
"""
