"""URL verdicts: host and path rules, else the smoothed purity of a path template.

Every host has a tree of path templates, grown one path segment at a time.  Below a
node a segment stays literal when it has at least `SUPPORT` urls, whatever its share;
other segments fall to their shape (digits as #), and shapes that are rare themselves to
a wildcard.  Branches are counted into `BINS` bins of their smoothed share of bad urls;
in order of rate a bin joins the group before it when z tests can tell it neither from
the group's pooled counts nor from the group's first bin.  A node's purity is its labelled share of bad urls, smoothed towards its
parent's; the template a url ends in decides, and is blocked from `LIMIT` on.

Work runs on distinct (host, path) with counts.  Each level is partial aggregation and
equi-joins on (host, node, segment), written to the shared folder; only the bins of one
node meet in one row.  A path deeper than `DEPTH` keeps its rest as one
last segment.

Defined cases: a null url, or one without `://`, has empty host and path and ends at the
root of the empty host; without labels every purity is the prior and nothing is
blocked; repeated rows count each time; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyledger.llm.common import UPPER, Scratch, mapped, settle, table

# Fixed values: (verdict, rule).
RULES = (
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
)
SUPPORT = 20
DEPTH = 8
SMOOTHING = 20.0
Z = 1.96
LIMIT = 0.5
# Branches whose rates fall into one of so many equal bins are one before the test; LIMIT is a bin's edge.
BINS = 1000
# A merged branch names up to so many of its branches, else the first and the number of the others.
NAMED = 200

PARTS = "host string, node string, bin int, part int, below double, branches long, first string"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(url.isNull() | (at == 0), F.lit("")).otherwise(F.expr("substring(__url, instr(__url, '://') + 3)"))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, UPPER.lower()), path


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; both null when none fits."""
    rule = verdict = None
    for kind, text in sorted(rules, key=lambda r: (len(r[1]), r[1]), reverse=True):
        cut = text.index("/")
        own = text[:cut]
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(text[cut:])
        rule = F.when(fits, text) if rule is None else rule.when(fits, text)
        verdict = F.when(fits, kind) if verdict is None else verdict.when(fits, kind)
    none = F.lit(None).cast("string")
    return (rule if rule is not None else none), (verdict if verdict is not None else none)


def split_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path."""
    own = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("__url"))
    host, path = host_and_path(F.col("__url"))
    return own.select("page_id", host.alias("host"), path.alias("path"))


def merged_parts(bins: list[tuple[int, int]], purity: float) -> list[int]:
    """The group of each (labelled, bad), in order of rate.

    A bin joins the group before it unless a z test tells it from the group's pooled
    counts or from the group's first bin, so small steps cannot chain.
    """
    smooth = lambda labelled, bad: (labelled + SMOOTHING, (bad + SMOOTHING * purity) / (labelled + SMOOTHING))

    def apart(x: tuple[int, int], y: tuple[int, int]) -> bool:
        (n, p), (m, q) = smooth(*x), smooth(*y)
        return abs(q - p) > Z * math.sqrt(max(0.0, p * (1 - p) / n + q * (1 - q) / m))

    out: list[int] = []
    first = pool = None
    for own in bins:
        if pool is None or apart(pool, own) or apart(first, own):
            out.append(out[-1] + 1 if out else 0)
            first = pool = own
        else:
            out.append(out[-1])
            pool = (pool[0] + own[0], pool[1] + own[1])
    return out


def _parts(batches):
    """Per bin of a node its group, the group's purity, its number of branches and its first branch."""
    kinds = (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.float64(), pa.int64(), pa.string())
    for batch in batches:
        rows = []
        for node in batch.to_pylist():
            bins = sorted(node["bins"], key=lambda x: x["bin"])
            groups: dict[int, list[dict]] = {}
            for x, part in zip(bins, merged_parts([(x["labelled"], x["bad"]) for x in bins], node["purity"])):
                groups.setdefault(part, []).append(x)
            for part, own in groups.items():
                labelled, bad, branches = (sum(x[c] for x in own) for c in ("labelled", "bad", "branches"))
                below = (bad + SMOOTHING * node["purity"]) / (labelled + SMOOTHING)
                first = min((x["first"] for x in own), key=str.encode)
                rows += [(node["host"], node["node"], x["bin"], part, below, branches, first) for x in own]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], [x.split()[0] for x in PARTS.split(", ")])


def _level(rows: DataFrame, level: int, work: Scratch) -> DataFrame:
    """Rows with the branch of their next segment: node and purity move one level down."""
    last = level + 1 >= DEPTH
    segment = F.concat_ws("/", F.slice("segments", level + 1, 1 << 20)) if last else F.element_at("segments", level + 1)
    rows = rows.withColumn("segment", segment).withColumn("shape", F.regexp_replace("segment", "[0-9]+", "#"))
    sums = [F.sum(c).alias(c) for c in ("n", "labelled", "bad")]
    kids = work.settle(rows.groupBy("host", "node", "purity", "segment", "shape").agg(*sums), "url-kids")
    enough = F.col("n") >= SUPPORT
    kids = kids.withColumn("literal", enough)
    shapes = kids.where(~F.col("literal")).groupBy("host", "node", "shape").agg(F.sum("n").alias("n")).where(enough).select("host", "node", "shape", F.lit(True).alias("common"))
    kids = kids.join(shapes, ["host", "node", "shape"], "left")
    kids = kids.withColumn("branch", F.when(F.col("literal"), F.col("segment")).when(F.col("common"), F.concat(F.lit("{"), F.col("shape"), F.lit("}"))).otherwise("*"))
    branches = kids.groupBy("host", "node", "purity", "branch").agg(*sums)
    rate = (F.col("bad") + SMOOTHING * F.col("purity")) / (F.col("labelled") + SMOOTHING)
    branches = work.settle(branches.withColumn("bin", F.floor(rate * BINS).cast("int")), "url-rates")
    one = F.struct("bin", "labelled", "bad", "branches", "first")
    bins = branches.groupBy("host", "node", "purity", "bin").agg(F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad"), F.count("*").alias("branches"), F.min("branch").alias("first"))
    # At most BINS + 1 bins a node meet in one row.
    parts = work.settle(mapped(bins.groupBy("host", "node", "purity").agg(F.collect_list(one).alias("bins")), _parts, PARTS), "url-parts")
    to = branches.select("host", "node", "branch", "bin").join(parts, ["host", "node", "bin"])
    to = work.settle(to, "url-to")
    named = to.where(F.col("branches") <= NAMED).groupBy("host", "node", "part").agg(F.array_join(F.sort_array(F.collect_set("branch")), "|").alias("name"))
    to = to.join(work.settle(named, "url-names"), ["host", "node", "part"], "left")
    name = F.coalesce("name", F.format_string("%s|+%d", "first", F.col("branches") - 1))
    to = kids.select("host", "node", "segment", "branch").join(to.select("host", "node", "branch", "below", name.alias("name")), ["host", "node", "branch"])
    to = to.select("host", "node", "segment", F.concat_ws("/", "node", "name").alias("child"), "below")
    moved = rows.drop("shape").join(work.settle(to, "url-branches"), ["host", "node", "segment"])
    return moved.select("host", "path", "segments", "n", "labelled", "bad", F.col("child").alias("node"), F.col("below").alias("purity"))


def templates(urls: DataFrame, labelled: DataFrame, work: Scratch) -> DataFrame:
    """host, path, template, purity of every distinct (host, path).

    `urls` has host and path; `labelled` has host, path and bad (0 or 1) of urls with a label.
    """
    counts = urls.groupBy("host", "path").agg(F.count("*").alias("n"))
    # Aggregates are written before they are joined back, so that the join of a hot host can be split.
    known = labelled.groupBy("host", "path").agg(F.count("*").alias("labelled"), F.sum(F.col("bad").cast("long")).alias("bad"))
    paths = counts.join(known, ["host", "path"], "left").fillna(0, ["labelled", "bad"])
    paths = work.settle(paths.withColumn("segments", F.filter(F.split("path", "/"), lambda x: x != "")), "url-paths")
    total = paths.agg(F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad")).first()
    prior = (total.bad or 0) / total.labelled if total.labelled else 0.0
    hosts = paths.groupBy("host").agg(((F.sum("bad") + SMOOTHING * prior) / (F.sum("labelled") + SMOOTHING)).alias("purity"))
    live = paths.join(work.settle(hosts, "url-hosts"), "host").withColumn("node", F.lit(""))
    done, level = [], 0
    while True:
        live = work.settle(live, f"url-level-{level}")
        ended = F.size("segments") <= level if level < DEPTH else F.lit(True)
        done.append(live.where(ended).select("host", "path", F.col("node").alias("template"), "purity"))
        live = live.where(~ended)
        if live.isEmpty():
            break
        live = _level(live, level, work)
        level += 1
    out = done[0]
    for more in done[1:]:
        out = out.union(more)
    return out


def url_verdicts(pages: DataFrame, labelled: DataFrame, id_col: str = "page_id", url_col: str = "url", limit: float = LIMIT) -> DataFrame:
    """page_id, host, path, rule, verdict, template and purity of every page."""
    urls = settle(split_urls(pages, id_col, url_col), "url-parts")
    with Scratch(pages.sparkSession, "url") as work:
        found = settle(templates(urls, labelled, work), "url-templates")
    rule, verdict = rule_of(F.col("host"), F.col("path"))
    own = F.when(F.col("purity") >= limit, "block").otherwise("allow")
    joined = urls.join(found, ["host", "path"])
    return joined.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), "template", F.round("purity", 6).alias("purity"))


def labelled_urls(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """Labels of the documents whose number ends a url's path: bad is low quality or toxic."""
    number = F.regexp_extract("path", r"([0-9]{1,18})[^/0-9]*/?$", 1)
    urls = split_urls(pages).withColumn("doc_id", F.when(number != "", number.cast("long")))
    bad = ((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int")
    known = labels.select("doc_id", bad.alias("bad")).where("doc_id is not null and bad is not null")
    return urls.join(known, "doc_id").select("host", "path", "bad")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return url_verdicts(pages, labelled_urls(pages, table(spark, sf_dir, "labels")))
