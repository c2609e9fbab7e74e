"""Host-level quality rules.

Each document gets five counts and a set of rules it may fail.  Rule failures are
counted per host; a host's failure rate is shrunk towards the corpus with a beta prior
fitted to all hosts by moments.  A host is rejected for a rule when its shrunk rate lies
clearly above the prior's: by `SPREADS` posterior standard deviations it stays over `TIMES`
times the prior's rate and over `LEAST_RATE`.  The verdict is joined back to its documents,
and those that fail the rule go; clean documents of a rejected host stay.  A document
that fails the base rule goes on any host.

Hosts are pre-aggregated before the shuffle, so a host with a third of all rows is
one row per task there; the prior (two moments a rule) is all that reaches the driver.

Defined cases: null text has no words and fails the base rule; null is a host of its
own; with one host, or hosts of equal rates, the prior has the largest strength; very
long texts are counted whole; repeated rows count each time; an empty table gives an empty
result; columns of the caller keep their names and values whatever they are called.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyledger.llm.common import SPACE, as_bytes, mapped, settle, table

LEAST_WORDS = 50
MOST_REPEATED_PCT = 50
# When a host's rate is clearly above that of the others, and the prior's bounds in documents.
SPREADS, TIMES, LEAST_RATE = 3.0, 2.0, 0.1
STRENGTHS = (2.0, 1000.0)
SYMBOLS = b"#*$%&|<>"

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
BASE_FAILED = f"n_words < {LEAST_WORDS} or 100 * n_repeat_words > {MOST_REPEATED_PCT} * n_words"
# Rule name -> a document fails when this holds.
RULES = {
    "base": BASE_FAILED,
    "symbols": "2 * n_symbols > n_words",
    "word_length": "word_chars < 2 * n_words or word_chars > 15 * n_words",
    "dup_lines": "10 * n_dup_lines > n_words",
}


def _dup_lines(raw: bytes) -> int:
    lines = raw.split(b"\n")
    if len(set(lines)) == len(lines):
        return 0
    seen: set[bytes] = set()
    again = 0
    for line in lines:
        if line in seen:
            again += bool(line.strip(SPACE))
        else:
            seen.add(line)
    return again


def repeat_words(ids: np.ndarray, doc: np.ndarray, distinct: int, docs: int) -> np.ndarray:
    """Per document, words inside a 3-word window that the document has at least twice."""
    if len(ids) < 4:
        return np.zeros(docs, np.int64)
    at = np.flatnonzero(doc[2:] == doc[:-2])
    pair = ids[at] * distinct + ids[at + 1]
    if distinct >= 1 << 21:
        pair = np.unique(pair, return_inverse=True)[1]
    key, own = pair * distinct + ids[at + 2], doc[at]
    order = np.lexsort((key, own))
    key, own = key[order], own[order]
    same = (key[1:] == key[:-1]) & (own[1:] == own[:-1])
    twice = np.zeros(len(key), bool)
    twice[1:] |= same
    twice[:-1] |= same
    hit = at[order[twice]]
    marked = np.zeros(len(ids), bool)
    for k in range(3):
        marked[hit + k] = True
    return np.bincount(doc[marked], minlength=docs)


def text_counts(raws: list[bytes]) -> list[np.ndarray]:
    """The five counts of each text, in the order of COUNTS."""
    words = [raw.split() for raw in raws]
    n_words = np.array([len(w) for w in words], np.int64)
    number: dict[bytes, int] = {}
    flat = np.fromiter((number.setdefault(x, len(number)) for w in words for x in w), np.int64, int(n_words.sum()))
    doc = np.repeat(np.arange(len(raws)), n_words)
    return [
        n_words,
        np.array([len(raw.translate(None, SPACE).decode()) for raw in raws], np.int64),
        np.array([len(raw) - len(raw.translate(None, SYMBOLS)) for raw in raws], np.int64),
        np.array([_dup_lines(raw) for raw in raws], np.int64),
        repeat_words(flat, doc, len(number), len(raws)),
    ]


def _counter(text_at: int, keep: int, names: tuple):
    """Append the counts to the first `keep` columns."""

    def count(batches):
        for batch in batches:
            counts = [pa.array(c.astype(np.int64)) for c in text_counts(as_bytes(batch.column(text_at)))]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(keep)] + counts, batch.schema.names[:keep] + list(names))

    return count


def host_counts(counted: DataFrame, host_col: str) -> DataFrame:
    """Documents and failures of each rule per host."""
    fails = [F.sum(F.expr(rule).cast("long")).alias(f"k_{name}") for name, rule in RULES.items()]
    return counted.groupBy(F.col(host_col).alias("host")).agg(F.count("*").alias("n"), *fails)


def beta_prior(hosts: DataFrame) -> dict[str, tuple[float, float]]:
    """(a, b) of each rule's beta prior by the moments of the hosts' rates."""
    wanted = [F.avg(F.col(f"k_{r}") / F.col("n")).alias(f"m_{r}") for r in RULES]
    wanted += [F.var_pop(F.col(f"k_{r}") / F.col("n")).alias(f"v_{r}") for r in RULES]
    row = hosts.agg(*wanted).first()
    out = {}
    for r in RULES:
        mean, var = row[f"m_{r}"] or 0.0, row[f"v_{r}"] or 0.0
        spread = mean * (1 - mean)
        strength = min(max(spread / var - 1, STRENGTHS[0]), STRENGTHS[1]) if var > 0 else STRENGTHS[1]
        out[r] = (mean * strength, (1 - mean) * strength)
    return out


def host_verdicts(hosts: DataFrame, spreads: float = SPREADS, times: float = TIMES, least: float = LEAST_RATE) -> DataFrame:
    """(host, bad_<rule>): whether a rule's shrunk failure rate lies clearly above the prior's."""
    out = []
    for r, (a, b) in beta_prior(hosts).items():
        size = F.col("n") + F.lit(a + b)
        rate = (F.col(f"k_{r}") + F.lit(a)) / size
        low = rate - spreads * F.sqrt(rate * (1 - rate) / (size + 1))
        out.append(((low > times * a / (a + b)) & (low > least)).alias(f"bad_{r}"))
    return hosts.select("host", *out)


REJECTED = " or ".join(f"bad_{r} and ({rule})" for r, rule in RULES.items())


def _judged(counted: DataFrame, verdicts: DataFrame, host_col: str) -> DataFrame:
    joined = counted.join(verdicts, counted[host_col].eqNullSafe(verdicts["host"]))
    return joined.withColumn("base_failed", F.expr(BASE_FAILED)).withColumn("kept", ~F.col("base_failed") & ~F.expr(REJECTED))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """doc_id, the five counts, base_failed, kept and the host with its verdict."""
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(host_col).cast("string").alias("source"), F.col(text_col).cast("string").alias("text"))
    counted = settle(mapped(narrow, _counter(2, 2, COUNTS), "doc_id long, source string, " + ", ".join(f"{c} long" for c in COUNTS)), "quality-counts")
    verdicts = settle(host_verdicts(settle(host_counts(counted, "source"), "quality-hosts")), "quality-verdicts")
    return _judged(counted, verdicts, "source").select("doc_id", *COUNTS, "base_failed", "kept")


def kept_documents(docs: DataFrame, text_col: str = "text", host_col: str = "source") -> DataFrame:
    """The documents that pass, with their own columns; texts are read twice and never shuffled."""
    names = docs.columns
    clash = {c: f"__own_{i}" for i, c in enumerate(names)}
    own = docs.select(*[F.col(c).alias(clash[c]) for c in names])
    schema = ", ".join([f"`{clash[f.name]}` {f.dataType.simpleString()}" for f in docs.schema] + [f"{c} long" for c in COUNTS])
    counted = mapped(own, _counter(names.index(text_col), len(names), COUNTS), schema)
    hosts = settle(host_counts(counted.select(clash[host_col], *COUNTS), clash[host_col]), "quality-hosts")
    verdicts = settle(host_verdicts(hosts), "quality-verdicts")
    return _judged(counted, verdicts, clash[host_col]).where("kept").select(*[F.col(clash[c]).alias(c) for c in names])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"))


def _sql() -> str:
    rate = "k_{r} / n"
    fails = ", ".join(f"sum(case when {x} then 1 else 0 end) as k_{r}" for r, x in RULES.items())
    moments = ", ".join(f"avg({rate.format(r=r)}) as m_{r}, var_pop({rate.format(r=r)}) as v_{r}" for r in RULES)
    strength = ", ".join(
        f"m_{r}, case when v_{r} > 0 then least(greatest(m_{r} * (1 - m_{r}) / v_{r} - 1, {STRENGTHS[0]}), {STRENGTHS[1]}) else {STRENGTHS[1]} end as s_{r}" for r in RULES
    )
    shrunk = ", ".join(f"(k_{r} + m_{r} * s_{r}) / (n + s_{r}) as p_{r}" for r in RULES)
    low = "p_{r} - {z} * sqrt(p_{r} * (1 - p_{r}) / (n + s_{r} + 1))"
    bad = ", ".join(f"{low.format(r=r, z=SPREADS)} > {TIMES} * m_{r} and {low.format(r=r, z=SPREADS)} > {LEAST_RATE} as bad_{r}" for r in RULES)
    return f"""
with d as (select row_number() over () as rid, doc_id, source, coalesce(text, '') as text from documents),
w as (
  select rid, list_filter(regexp_split_to_array(text, '[ \\t\\n\\x0B\\x0C\\r]+'), lambda x: x <> '') as words,
         length(regexp_replace(text, '[ \\t\\n\\x0B\\x0C\\r]', '', 'g')) as word_chars,
         length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as n_symbols,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ \\t\\n\\x0B\\x0C\\r]')) as lines
  from d
),
p as (select rid, unnest(range(1, len(words) - 1)) as i, words from w),
t as (select rid, i, words[i:i + 2] as tri from p),
r as (select rid, i, count(*) over (partition by rid, tri) as n from t),
m as (select distinct rid, i + k as i from r, (select unnest([0, 1, 2]) as k) where n > 1),
c as (select rid, count(*) as n_repeat_words from m group by rid),
s as (
  select d.rid, d.doc_id, d.source, cast(len(words) as bigint) as n_words, cast(word_chars as bigint) as word_chars, cast(n_symbols as bigint) as n_symbols,
         cast(len(lines) - len(list_distinct(lines)) as bigint) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words
  from d join w using (rid) left join c using (rid)
),
h as (select source as host, count(*) as n, {fails} from s group by source),
o as (select {moments} from h),
q as (select {strength}, * from o),
z as (select *, {shrunk} from h, q),
v as (select host, {bad} from z)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, ({BASE_FAILED}) as base_failed,
       not ({BASE_FAILED}) and not ({REJECTED}) as kept
from s join v on s.source is not distinct from v.host
"""


SQL = _sql()
