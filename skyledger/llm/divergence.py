"""Source divergence audit: how far the word use of sources differs within a language.

Terms are runs of letters.  Every task finds them with byte masks and counts them without
strings, in buckets by length: terms of up to 8 bytes are one uint64 word and those of up
to 16 bytes two, radix-sorted by digits of 16 bits together with their group; longer terms
are rows of bytes, one bucket per length in words, sorted as bytes.  Runs of equal terms
give the count, and the changes of document inside a run the number of documents, since the
sorts keep the order of reading.  One row per group and term leaves a buffer of bounded
size; Spark adds these up.

A term's share in a group is its smoothed rate in parts of a billion, in whole numbers.
Two sources are compared over all kept terms of the language: tasks hold a bounded square
of sources and stream their terms, so that a pair leaves a task as one sum; terms that
neither source has add the same value each and are only counted.

Defined cases: null text, language and source count as empty; every (language, source)
that occurs is a group, also without terms; a language without kept terms has the value 0
for its pairs and no terms; a group alone in its language has no pairs; every row is a
document of its own, repeated or not; very long texts and terms are counted whole; an empty
table gives an empty result.  Columns of other names are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skyledger.llm.common import Scratch, mapped, settle, shuffle_join, table

LEAST_DOCUMENTS, SMOOTHING, PARTS_OF, TOP = 10, 2, 1_000_000_000, 10
# Terms counted at once, sources of a side of a square, and term rows of a task.
BUFFER_TERMS, SQUARE, SQUARE_ROWS = 2_000_000, 128, 200_000
# Shares of a side held at once.
SQUARE_CELLS = 1 << 19
# Bytes up to which long terms are sorted as rows of a matrix.
MATRIX_BYTES = 128

_LETTER = np.zeros(256, bool)
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = _LETTER[0x80:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32

COUNTS = "lang string, source string, term binary, n long, docs long"


# -- terms of texts ------------------------------------------------------------------------


def term_spans(raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of every term in bytes of texts that stand one after the other and end at `ends`."""
    letter = _LETTER[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[1:-1] = letter[1:] != letter[:-1]
    # A term does not go on into the next text.
    edge[ends] = True
    edge[0] = True
    places = np.flatnonzero(edge)
    begin, end = places[:-1], places[1:]
    real = letter[begin]
    return begin[real], end[real]


def words_at(raw: np.ndarray, begin: np.ndarray, length: np.ndarray, count: int) -> np.ndarray:
    """The first 8 * count bytes from each begin as big-endian words, zero beyond the length."""
    # `raw` has spare bytes behind its last text.
    view = np.lib.stride_tricks.as_strided(raw, (len(raw) - 7, 8), (1, 1))
    out = np.empty((len(begin), count), np.uint64)
    for k in range(count):
        word = np.ascontiguousarray(view[np.minimum(begin + 8 * k, len(raw) - 8)]).view(">u8").reshape(-1).astype(np.uint64)
        spare = np.clip(8 * (k + 1) - length, 0, 8).astype(np.uint64) * np.uint64(8)
        # A shift by a whole word has no defined result, so it is done in two.
        half = spare >> np.uint64(1)
        out[:, k] = word >> half >> (spare - half) << half << (spare - half)
    return out


def radix_order(keys: list[np.ndarray]) -> np.ndarray:
    """Stable order by keys of uint64, the first most significant: least digit first, 16 bits each."""
    order = np.arange(len(keys[0]))
    for key in reversed(keys):
        for digit in range(4):
            part = ((key >> np.uint64(16 * digit)) & np.uint64(0xFFFF)).astype(np.uint16)
            if len(part) and (part != part[0]).any():
                order = order[np.argsort(part[order], kind="stable")]
    return order


def run_counts(differs: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First place, length and distinct documents of each run; `differs` marks the rows that begin one."""
    first = np.flatnonzero(differs)
    new_doc = differs.copy()
    new_doc[1:] |= doc[1:] != doc[:-1]
    return first, np.diff(np.append(first, len(doc))), np.add.reduceat(new_doc.astype(np.int64), first) if len(first) else first


class Buckets:
    """Terms of one buffer by length class: (group, document, words or bytes)."""

    def __init__(self):
        self.terms = 0
        self.short: dict[int, list] = {}
        self.long: dict[int, list] = {}

    def add(self, raw: np.ndarray, ends: np.ndarray, groups: np.ndarray, first_doc: int) -> None:
        """Terms of consecutive texts; `raw` is lower-cased and followed by 8 spare bytes."""
        begin, end = term_spans(raw[:-8], ends)
        doc = np.searchsorted(ends, begin, side="right")
        group, doc, length = groups[doc].astype(np.uint32), doc + first_doc, end - begin
        self.terms += len(begin)
        words = np.minimum((length + 7) // 8, MATRIX_BYTES // 8 + 1)
        for count in np.unique(words).tolist():
            own = np.flatnonzero(words == count)
            if count <= MATRIX_BYTES // 8:
                kept = (group[own], doc[own], words_at(raw, begin[own], length[own], count))
                self.short.setdefault(count, []).append(kept)
            else:
                for g, d, b, e in zip(group[own].tolist(), doc[own].tolist(), begin[own].tolist(), end[own].tolist()):
                    self.long.setdefault(e - b, []).append((g, raw[b:e].tobytes(), d))

    def counted(self):
        """(group, terms, count, documents) of every bucket, as equally long sequences."""
        for count, held in sorted(self.short.items()):
            group, doc = (np.concatenate([h[i] for h in held]) for i in (0, 1))
            words = np.concatenate([h[2] for h in held])
            if count <= 2:
                order = radix_order([group.astype(np.uint64), *words.T])
            else:
                wide = np.concatenate([group[:, None].astype(np.uint64), words], axis=1).astype(">u8")
                order = np.argsort(np.ascontiguousarray(wide).view(f"S{8 * (count + 1)}").reshape(-1), kind="stable")
            group, doc, words = group[order], doc[order], words[order]
            differs = np.ones(len(group), bool)
            differs[1:] = (group[1:] != group[:-1]) | (words[1:] != words[:-1]).any(1)
            first, n, docs = run_counts(differs, doc)
            terms = np.ascontiguousarray(words[first].astype(">u8")).view(f"S{8 * count}").reshape(-1)
            yield group[first], terms.tolist(), n, docs
        for _, held in sorted(self.long.items()):
            held.sort(key=lambda x: x[:2])
            doc = np.array([h[2] for h in held])
            differs = np.array([not i or held[i - 1][:2] != held[i][:2] for i in range(len(held))])
            first, n, docs = run_counts(differs, doc)
            yield np.array([held[i][0] for i in first]), [held[i][1] for i in first], n, docs


def _counter(buffer_terms: int):
    """Rows (lang, source, term, n, docs): counts of a buffer's terms per group."""
    names = [x.split()[0] for x in COUNTS.split(", ")]

    def flush(buckets: Buckets, groups: dict):
        known = pa.array([g[0] for g in groups], pa.string()), pa.array([g[1] for g in groups], pa.string())
        for group, terms, n, docs in buckets.counted():
            own = pa.array(group.astype(np.int64))
            yield pa.RecordBatch.from_arrays([known[0].take(own), known[1].take(own), pa.array(terms, pa.binary()), pa.array(n.astype(np.int64)), pa.array(docs.astype(np.int64))], names)

    def count(batches):
        buckets, groups, docs = Buckets(), {}, 0
        for batch in batches:
            texts = [x or b"" for x in batch.column("text").cast(pa.binary()).to_pylist()]
            if not texts:
                continue
            own = [groups.setdefault(g, len(groups)) for g in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist())]
            raw = _LOWER[np.frombuffer(b"".join(texts) + bytes(8), np.uint8)]
            buckets.add(raw, np.cumsum([len(t) for t in texts]), np.array(own), docs)
            docs += len(texts)
            if buckets.terms >= buffer_terms:
                yield from flush(buckets, groups)
                buckets, groups = Buckets(), {}
        yield from flush(buckets, groups)

    return count


def term_counts(docs: DataFrame, buffer_terms: int = BUFFER_TERMS) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of every term per group."""
    rows = mapped(docs.select("lang", "source", "text"), _counter(buffer_terms), COUNTS)
    # Tasks have counted already, so a common term is a few rows a task here.
    return rows.groupBy("lang", "source", F.col("term").cast("string").alias("term")).agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


# -- shares and divergence ---------------------------------------------------------------


def share(n: Column, total: Column, kept: Column) -> Column:
    """1 + floor(a billion * (n + 2) / (total + 2 * kept)); decimals, since the product may pass a long."""
    above = (n.cast("decimal(20,0)") + SMOOTHING) * F.lit(PARTS_OF).cast("decimal(10,0)")
    below = total.cast("decimal(20,0)") + F.lit(SMOOTHING).cast("decimal(1,0)") * kept.cast("decimal(12,0)")
    # No kept terms: no share is asked for.
    return F.lit(1).cast("long") + F.call_function("div", above, F.when(below > 0, below))


def spread(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)) of two shares."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def spread_of(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


class Square:
    """Sums of one square of sources over the terms that a task sees."""

    def __init__(self, key: list):
        self.key, self.heads, self.held, self.terms, self.seen = key, ([], []), [], 0, 0
        self.sums = None

    def add_heads(self, side: np.ndarray, source: np.ndarray, p: np.ndarray) -> None:
        """Sources of the square's lines (side 0) and columns (side 1), with the share of a term that they do not have."""
        for k in (0, 1):
            self.heads[k].append(np.stack([source[side == k], p[side == k]]))

    def add(self, source: np.ndarray, p: np.ndarray, begins: np.ndarray) -> None:
        """Shares of terms, one term after the other; `begins` marks the rows that begin one."""
        if len(source):
            self.held.append((source, p, begins))
            self.terms += int(begins.sum())
            if len(self.lines()) * self.terms >= SQUARE_CELLS:
                self.flush()

    def lines(self) -> np.ndarray:
        if self.sums is None:
            both = [np.concatenate(h, axis=1) if h else np.zeros((2, 0), np.int64) for h in self.heads]
            self.sides = [h[:, np.argsort(h[0])] for h in both]
            self.sums = np.zeros([h.shape[1] for h in self.sides], np.int64)
        return self.sides[0][0]

    def flush(self, last: bool = False) -> None:
        """Add up the terms that are whole: all but the last one, which may go on."""
        if not self.held:
            return
        source, p, begins = (np.concatenate(x) for x in zip(*self.held))
        stop = len(source) if last else int(np.flatnonzero(begins)[-1])
        self.held, self.terms = [(source[stop:], p[stop:], begins[stop:])] if stop < len(source) else [], int(begins[stop:].sum())
        source, p, term = source[:stop], p[:stop], np.cumsum(begins[:stop]) - 1
        count = int(term[-1]) + 1 if stop else 0
        self.seen += count
        filled = []
        for sources, zero in self.sides:
            shares = np.repeat(zero[:, None], count, 1)
            if len(sources):
                place = np.minimum(np.searchsorted(sources, source), len(sources) - 1)
                own = sources[place] == source
                shares[place[own], term[own]] = p[own]
            filled.append(shares)
        for k, line in enumerate(filled[0]):
            self.sums[k] += spread_of(line[None, :], filled[1]).sum(1)

    def result(self) -> pa.RecordBatch:
        rows, columns = self.lines(), self.sides[1][0]
        self.flush(last=True)
        i, j = np.nonzero(rows[:, None] != columns[None, :])
        held = [pa.array([self.key[0]] * len(i), pa.string()), *map(pa.array, (rows[i], columns[j], self.sums[i, j], np.full(len(i), self.seen, np.int64)))]
        return pa.RecordBatch.from_arrays(held, [x.split()[0] for x in PAIRS.split(", ")])


PAIRS = "lang string, s long, t long, value long, seen long"
KEY = ("lang", "row_block", "column_block", "task")


def changes(column: pa.Array, before) -> np.ndarray:
    """Rows that differ from the row before; `before` is the value before the first."""
    out = np.ones(len(column), bool)
    out[0] = column[0].as_py() != before
    if len(column) > 1:
        out[1:] = pc.fill_null(pc.not_equal(column[1:], column[:-1]), True).to_numpy(zero_copy_only=False)
    return out


def _square_summer():
    """Streams rows sorted by square and term; the sources of a square come first, with a null term."""

    def add(batches):
        square, last, term = None, [None] * len(KEY), None
        for batch in batches:
            if not batch.num_rows:
                continue
            side, source, p = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("side", "source_no", "p"))
            words = batch.column("term")
            fresh = np.logical_or.reduce([changes(batch.column(c), x) for c, x in zip(KEY, last)])
            head = words.is_null().to_numpy(zero_copy_only=False)
            begins = changes(words, term) | fresh
            starts = np.flatnonzero(fresh | (np.arange(len(fresh)) == 0)).tolist()
            for low, high in zip(starts, [*starts[1:], batch.num_rows]):
                if fresh[low]:
                    if square:
                        yield square.result()
                    square = Square([batch.column(c)[low].as_py() for c in KEY])
                middle = low + int(head[low:high].sum())
                square.add_heads(side[low:middle], source[low:middle], p[low:middle])
                square.add(source[middle:high], p[middle:high], begins[middle:high])
            last, term = [batch.column(c)[-1].as_py() for c in KEY], words[-1].as_py()
        if square:
            yield square.result()

    return add


class Audit:
    """The written tables of one audit."""

    def __init__(self, docs: DataFrame, work: Scratch, least_documents: int = LEAST_DOCUMENTS, buffer_terms: int = BUFFER_TERMS):
        text = F.coalesce(F.col("text").cast("string"), F.lit(""))
        own = docs.select(text.alias("text"), *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")])
        counts = work.settle(term_counts(own, buffer_terms), "counts")
        words = counts.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs")).where(F.col("docs") >= least_documents)
        words = work.settle(words.select("lang", "term", "lang_n"), "words")
        kept = work.settle(shuffle_join(counts.select("lang", "source", "term", "n"), words, ["lang", "term"]), "kept")
        langs = words.groupBy("lang").agg(F.sum("lang_n").alias("lang_total"), F.count("*").alias("v"))
        totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
        groups = own.groupBy("lang", "source").agg(F.count("*").alias("documents"))
        groups = groups.join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
        number = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
        zero = F.lit(0).cast("long")
        groups = groups.select("lang", "source", F.coalesce("total", zero).alias("total"), F.coalesce("lang_total", zero).alias("lang_total"), F.coalesce("v", zero).alias("v"), number.cast("long").alias("source_no"))
        # One row per group: every language's sources and totals.
        self.groups = work.settle(groups, "groups")
        shares = kept.join(self.groups, ["lang", "source"])
        p, q = share(F.col("n"), F.col("total"), F.col("v")), share(F.col("lang_n"), F.col("lang_total"), F.col("v"))
        self.shares = work.settle(shares.select("lang", "source", "source_no", "term", p.alias("p"), q.alias("q")), "shares")
        self.work = work

    def terms(self, top: int = TOP) -> DataFrame:
        """Each group's terms of the largest spread above the language."""
        over = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
        rows = self.shares.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), spread(F.col("p"), F.col("q")).alias("value"))
        return rows.withColumn("rank", F.row_number().over(over)).where(F.col("rank") <= top)

    def pairs(self, square: int = SQUARE, square_rows: int = SQUARE_ROWS) -> DataFrame:
        """Each group beside every other source of its language, over all kept terms."""
        zero_share = share(F.lit(0), F.col("total"), F.col("v"))
        groups = self.groups.withColumn("block", F.floor(F.col("source_no") / square)).withColumn("zero", zero_share)
        rows = self.shares.groupBy("lang").agg(F.count("*").alias("rows"))
        plan = groups.groupBy("lang").agg((F.max("block") + 1).alias("blocks"), F.max("v").alias("v")).join(rows, "lang")
        plan = self.work.settle(plan.select("lang", "blocks", F.least(F.ceil(F.col("rows") / square_rows), "v").alias("tasks")), "plan")
        all_blocks = F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)
        own = ["lang", "row_block", "column_block", "task", "side", "source_no", "term", "p"]

        def sides(df: DataFrame) -> DataFrame:
            """Every row in the squares of its block's line and column; in the middle square as both."""
            line = df.withColumn("row_block", F.col("block")).withColumn("column_block", F.explode(all_blocks)).withColumn("side", F.lit(0))
            column = df.withColumn("column_block", F.col("block")).withColumn("row_block", F.explode(all_blocks)).withColumn("side", F.lit(1))
            return line.unionByName(column)

        heads = sides(groups.join(plan, "lang").withColumn("term", F.lit(None).cast("string")).withColumn("p", F.col("zero")))
        heads = heads.withColumn("task", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tasks") - 1)))
        terms = self.shares.withColumn("block", F.floor(F.col("source_no") / square)).join(plan, "lang")
        terms = terms.withColumn("task", F.pmod(F.xxhash64("term"), F.col("tasks")))
        # In the middle square a source is a line and a column at once, so its rows are needed once.
        terms = sides(terms).where("side = 0 or row_block <> column_block")
        meet = heads.select(own).unionByName(terms.select(own)).repartition("lang", "row_block", "column_block", "task")
        meet = meet.sortWithinPartitions("lang", "row_block", "column_block", "task", F.col("term").asc_nulls_first())
        sums = mapped(meet, _square_summer(), PAIRS).groupBy("lang", "s", "t").agg(F.sum("value").alias("value"), F.sum("seen").alias("seen"))
        sums = self.work.settle(sums, "sums")
        a = groups.select("lang", "source", F.col("source_no").alias("s"), F.col("zero").alias("p"), "v")
        b = groups.select("lang", F.col("source").alias("item"), F.col("source_no").alias("t"), F.col("zero").alias("q"))
        both = a.join(b, "lang").where("s <> t").join(sums, ["lang", "s", "t"], "left")
        # Terms that neither source has add one value each.
        unseen = F.col("v") - F.coalesce("seen", F.lit(0))
        rest = F.when(unseen > 0, unseen * spread(F.col("p"), F.col("q")))
        value = F.coalesce("value", F.lit(0)) + F.coalesce(rest, F.lit(0))
        over = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
        rows = both.select("lang", "source", F.lit("pair").alias("part"), "item", value.cast("long").alias("value"))
        return rows.withColumn("rank", F.row_number().over(over))


def divergence(docs: DataFrame, least_documents: int = LEAST_DOCUMENTS, top: int = TOP, square: int = SQUARE, square_rows: int = SQUARE_ROWS, buffer_terms: int = BUFFER_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank): every pair of sources, and each group's most telling terms."""
    with Scratch(docs.sparkSession, "divergence") as work:
        audit = Audit(docs, work, least_documents, buffer_terms)
        return settle(audit.pairs(square, square_rows).unionByName(audit.terms(top)), "divergence")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(table(spark, sf_dir, "documents"))


SQL = f"""
with d as (
  select row_number() over () as rid, coalesce(lang, '') as lang, coalesce(source, '') as source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text
  from documents
),
o as (select rid, lang, source, unnest(regexp_extract_all(text, '[a-z\\x{{80}}-\\x{{10FFFF}}]+')) as term from d),
w as materialized (select lang, term, count(*) as lang_n from o group by lang, term having count(distinct rid) >= {LEAST_DOCUMENTS}),
c as materialized (select lang, source, term, count(*) as n from o join w using (lang, term) group by lang, source, term),
l as (select lang, count(*) as v, sum(lang_n) as total from w group by lang),
g as materialized (
  select e.lang, e.source, coalesce(l.v, 0) as v, coalesce((select sum(n) from c where c.lang = e.lang and c.source = e.source), 0) as total
  from (select distinct lang, source from d) e left join l using (lang)
),
s as materialized (
  select g.lang, g.source, w.term, coalesce(c.n, 0) as n,
         1 + (cast({PARTS_OF} as hugeint) * (coalesce(c.n, 0) + {SMOOTHING})) // (g.total + {SMOOTHING} * g.v) as p,
         1 + (cast({PARTS_OF} as hugeint) * (w.lang_n + {SMOOTHING})) // (l.total + {SMOOTHING} * l.v) as q
  from g join w on w.lang = g.lang join l on l.lang = g.lang left join c on c.lang = g.lang and c.source = g.source and c.term = w.term
),
pairs as (
  select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) as value
  from s a join s b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by a.lang, a.source, b.source
),
r as (
  select a.lang, a.source, 'pair' as part, b.source as item, coalesce(p.value, 0) as value
  from g a join g b on a.lang = b.lang and a.source <> b.source left join pairs p on p.lang = a.lang and p.source = a.source and p.item = b.source
  union all
  select lang, source, 'term', term, (p - q) * (p - q) // (p + q) from s where n > 0 and p > q
),
z as (select *, row_number() over (partition by lang, source, part order by value desc, encode(item)) as rank from r)
select lang, source, part, item, cast(value as bigint) as value, cast(rank as integer) as rank from z where part = 'pair' or rank <= {TOP}
"""
