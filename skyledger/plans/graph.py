"""Graph propagation, trackers and on-time metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyledger.operators import graph as g
from skyledger.operators import lookup
from skyledger.operators import project as p
from skyledger.plans import projection
from skyledger.plans.relations_sql import CREW, FLIGHTS, LEGS, with_
from skyledger.session import run_dir, settle, settle_by
from skyledger.sources import state
from skyledger.sources.flights import crew_assignments, hot_duties

# Rounds that the check SQL writes out; it fails when the last one leaves legs to visit.
SQL_ROUNDS = 30
STATE = projection.STATE
# What links, waits and crew duties read besides.
LINKED = ("next_leg_key", *projection.DUTY)
# What links and waits read of the state.
NEIGHBOURS = ("flight_key", "prev_leg_key", "std_ms", "ogt_min", *LINKED)


def _links(spark: SparkSession, sf_dir: str):
    """Neighbours of all legs, written once because they meet each other, and their crew."""
    wide = settle(state.wide_legs(spark, sf_dir).rows().select(*NEIGHBOURS), "state")
    return wide, crew_assignments(wide, hot_duties(spark, sf_dir))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All links, also as `key||resource` text and split again."""
    found = g.edges(*_links(spark, sf_dir)).withColumn("link", g.link_text(F.col("dst"), F.col("resource_type")))
    key, kind = g.split_link(F.col("link"))
    return found.select("src", "dst", "resource_type", "link", key.alias("link_key"), kind.alias("link_resource"))


def equipment_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links with the crew switched off."""
    wide = state.wide_legs(spark, sf_dir).rows()
    return g.edges(wide, None, with_crew=False)


def inbound_legs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct legs each leg waits for."""
    return g.waits(*_links(spark, sf_dir)).select("flight_key", "prev_key").distinct()


# Late legs start a run by their own request, and every second what-if leg a live run as well; both in batches.
LATE = "ltd_ms > std_ms"
BATCH, ROUTE = "concat('B', part_id % 4)", "concat('R', supp_id % 5)"
TWICE = "request_id <> '0' AND part_id % 2 = 0"


def _roots(wide: DataFrame) -> DataFrame:
    late = wide.filter(LATE).withColumns({"batch_id": F.expr(BATCH), "route_id": F.expr(ROUTE)})
    columns = ("flight_key", "flight_date", "request_id", "request_type", "batch_id", "route_id")
    live = {"request_id": F.lit("0"), "request_type": F.lit("LIVE")}
    return late.select(*columns).unionByName(late.filter(TWICE).withColumns(live).select(*columns))


def _snapshot_times(wide: DataFrame) -> DataFrame:
    """What earlier what-if runs have stored."""
    return state.snapshots(wide).select(F.col("snapshot_id").alias("request_id"), "flight_key", "ptd_ms", "pta_ms")


def _run(spark: SparkSession, sf_dir: str, cancel_continues: bool = False, folder: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Propagate from every leg that departs later than scheduled, by its own event and request."""
    wide = settle_by(state.wide_legs(spark, sf_dir).rows().select(*STATE, *LINKED), "state", "flight_key")
    crew = settle_by(crew_assignments(wide, hot_duties(spark, sf_dir)), "crew", "flight_key")
    legs = wide.select(*STATE)
    links = settle_by(g.linked(g.edges(wide, crew), legs), "links", "src")
    people = crew.select("flight_key", "duty_key", "seat", "prev_flight_key", "turn_min")
    folder = folder or run_dir(spark, "rounds")
    return g.propagate(legs, links, people, state.tails(spark, sf_dir), _roots(wide), folder, cancel_continues, _snapshot_times(wide))


def _shown(log: DataFrame) -> DataFrame:
    return log.select(
        F.col("round").cast("long").alias("round"), *g.TREE, "route_id", "flight_key", "last_key", "resource_type",
        "arrivals", "errors", "children", "continues", *[f"new_{f}" for f in p.PROJECTED],
    )


def propagation_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(_run(spark, sf_dir)[0])


def propagation_after_cancel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with cancelled legs passing their change on."""
    return _shown(_run(spark, sf_dir, cancel_continues=True)[0])


def propagated_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The times that a run changes, per request: the live rows and those of what-if snapshots."""
    return _run(spark, sf_dir)[1].select("request_id", "flight_key", *p.PROJECTED)


def deepest_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per tree the way to its last leg, from the root on."""
    folder = run_dir(spark, "rounds")
    _run(spark, sf_dir, folder=folder)
    visits = g.visits_of(spark, folder)
    last = F.max_by(F.struct("flight_key", "round"), F.struct("round", "flight_key")).alias("v")
    asked = visits.groupBy(*g.TREE).agg(last).select(*g.TREE, "v.flight_key", "v.round")
    found = g.paths_to(settle(asked, "asked"), visits, folder)
    return found.select(*g.TREE, "flight_key", F.col("round").cast("long").alias("round"), F.array_join("path", ",").alias("path"))


def tracker_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    tracked = g.tracker(_run(spark, sf_dir)[0])
    return tracked.withColumn("last_round", F.col("last_round").cast("long"))


def tracker_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.completions(g.tracker(_run(spark, sf_dir)[0]))


def continue_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each leg's own event passes its delay on, counted from the inbound leg's day."""
    done = projection._projected(spark, sf_dir)
    dated = lookup.inbound(done, state.wide_legs(spark, sf_dir).rows(), "prev_leg_key", ("flight_date",))
    go = g.may_continue(F.col("in_flight_date"), F.col("request_type") == p.SWAP)
    return dated.select("flight_key", go.alias("continues"))


def cycle_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two steps on from every leg, the second also over links turned round, so that paths close circles."""
    wide = state.settled_legs(spark, sf_dir, leave=())
    links = settle(g.edges(wide, crew_assignments(wide, hot_duties(spark, sf_dir))), "links")
    back = links.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "resource_type")
    # Dealt by their end, as its join needs them; a step asks nothing of their start.
    both = g.ended_links(links.unionByName(back).repartition("dst").distinct(), wide)
    rounds = g.Rounds(spark, run_dir(spark, "guard"))
    null = F.lit(None).cast("string")
    start = wide.select(
        F.lit("B").alias("batch_id"), F.col("flight_key").alias("root_key"), "request_id", F.col("flight_date").alias("root_date"),
        "request_type", null.alias("route_id"), "flight_key", null.alias("last_key"), null.alias("resource_type"),
        F.col("std_ms").alias("peak_ms"), null.alias("error"),
    )
    start = rounds.add("frontier", 0, g._merged(start))
    first = g.follow(start, g.ended_links(links.filter("resource_type = 'EQUIPMENT'"), wide)).filter("error IS NULL")
    first = rounds.add("frontier", 1, g._merged(first.drop("suspect")))
    arrivals = rounds.add("arrivals", 1, g.follow(first, both))
    path = F.array_sort(F.array_distinct(F.array("root_key", "last_key", "flight_key")))
    return g.refused_cycles(arrivals, rounds, 1).select(
        F.col("root_key").alias("start"), F.col("last_key").alias("at"), F.col("flight_key").alias("dst"), "resource_type", "error",
        F.array_join(path, ",").alias("path"),
    )


def calculated_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.calculated_markers(state.wide_legs(spark, sf_dir).rows())


def ron_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = state.wide_legs(spark, sf_dir).rows()
    return g.overnight(lookup.inbound(wide, wide, "prev_leg_key", ("plmta_ms",)))


def d0_a14_by_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Departures on time to the minute and arrivals within 14 minutes, by flight date."""
    done = projection._projected(spark, sf_dir)
    dep = ((F.col("new_ptd_ms") - F.col("std_ms")) / 60_000).cast("long")
    arr = ((F.col("new_pta_ms") - F.col("sta_ms")) / 60_000).cast("long")
    n = F.count(F.lit(1))
    return done.groupBy("flight_date").agg(
        n.alias("flights"),
        F.count_if(dep == 0).alias("d0"),
        F.count_if(arr <= 14).alias("a14"),
        F.round(F.count_if(dep == 0) / n, 6).alias("d0_rate"),
        F.round(F.count_if(arr <= 14) / n, 6).alias("a14_rate"),
    )


def crew_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct next flights per crew type."""
    crew = _links(spark, sf_dir)[1]
    return crew.filter(F.col("next_flight_key").isNotNull()).groupBy("crew_type").agg(
        F.countDistinct("next_flight_key").alias("next_flights"),
        F.countDistinct("duty_key").alias("duties"),
    )


def unlinked_resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crew continuations without a resource type: counted, not refused."""
    crew = _links(spark, sf_dir)[1].withColumn("kind", F.when(~F.col("deadhead"), F.lit("CREW")))
    return crew.groupBy(F.coalesce("kind", F.lit("UNKNOWN")).alias("resource_type")).agg(
        F.count(F.lit(1)).alias("continuations"), F.count_if(F.col("kind").isNull()).alias("missing_type")
    )


QUERIES = {
    f.__name__: f
    for f in (
        edges,
        equipment_edges,
        inbound_legs,
        propagation_rounds,
        propagation_after_cancel,
        propagated_times,
        deepest_paths,
        tracker_state,
        tracker_complete,
        continue_filter,
        cycle_guard,
        calculated_markers,
        ron_flag,
        d0_a14_by_date,
        crew_groups,
        unlinked_resources,
    )
}

_WIDE = with_(LEGS, FLIGHTS, state.wide_sql())
_LINKS = """
links AS (
  SELECT flight_key AS src, next_leg_key AS dst, 'EQUIPMENT' AS resource_type FROM wide WHERE next_leg_key IS NOT NULL
  UNION
  SELECT flight_key, next_flight_key, 'CREW' FROM crew WHERE next_flight_key IS NOT NULL),
waits AS (
  SELECT flight_key, prev_leg_key AS prev_key, coalesce(ogt_min, 0) AS turn_min FROM wide WHERE prev_leg_key IS NOT NULL
  UNION ALL
  SELECT flight_key, prev_flight_key, turn_min FROM crew WHERE prev_flight_key IS NOT NULL)"""
_ALL = (LEGS, FLIGHTS, state.wide_sql(), CREW, _LINKS)


def _step_sql(r: int) -> str:
    """Resources, ready times and projection of the frontier legs, from the pieces of the projection's SQL.

    Keys are those inside a request, so that a request's legs meet its own state only.
    """
    event = "" if r == 0 else ", 'PE_CONTINUED' AS pe_event"
    named = {"wide w": f"w{r} w", "wide i": f"s{r} i", "FROM served": f"FROM served{r}", "FROM craft": f"FROM craft{r}", "crew c": "people c",
             "FROM res ": f"FROM res{r} ", "mx m": f"mx{r} m", "FROM dep)": f"FROM dep{r})", "FROM ruled)": f"FROM ruled{r})"}
    pieces = []
    for text in (projection._EQUIPMENT, projection._RES, projection._MAX, projection._DEP, projection._RULED):
        for old, new in named.items():
            text = text.replace(old, new)
        for name in ("served", "craft", "res", "mx", "dep", "ruled", "proj"):
            text = text.replace(f"\n{name} AS (", f"\n{name}{r} AS MATERIALIZED (")
        pieces.append(text)
    return f"""
w{r} AS MATERIALIZED (
  SELECT s.* REPLACE (CASE WHEN k.swap THEN 'SWAP_WHATIF' ELSE 'LIVE' END AS request_type{event})
  FROM s{r} s JOIN (SELECT flight_key, bool_or(swap) AS swap FROM f{r} WHERE error IS NULL GROUP BY flight_key) k USING (flight_key)),""" + ",".join(pieces)


_MOVED = " OR ".join(f"(new_{f} IS NOT NULL AND new_{f} IS DISTINCT FROM {f})" for f in p.PROJECTED)


def _state_sql(r: int) -> str:
    """The state before round r."""
    return f"""
s{r} AS MATERIALIZED (
  SELECT w.* REPLACE ({", ".join(f"coalesce(n.new_{f}, w.{f}) AS {f}" for f in p.PROJECTED)})
  FROM s{r - 1} w LEFT JOIN (SELECT * FROM proj{r - 1} WHERE {_MOVED}) n ON n.flight_key = w.flight_key),"""


def _round_sql(r: int, cancel_continues: bool) -> str:
    fields = p.PROJECTED
    state_cte = "" if r == 0 else _state_sql(r)
    stop = "" if cancel_continues else "AND c.leg_status <> 'CANCELLED'"
    return f"""{state_cte}{_step_sql(r)},
v{r} AS MATERIALIZED (
  SELECT f.*, {", ".join(f"c.new_{f}" for f in fields)},
    CASE WHEN f.error IS NULL {stop}
      AND (c.new_pta_ms IS NOT NULL AND c.new_pta_ms IS DISTINCT FROM c.pta_ms
        OR c.new_pcta_ms IS NOT NULL AND c.new_pcta_ms IS DISTINCT FROM c.pcta_ms OR f.swap AND c.new_plmta_ms IS NOT NULL)
      AND coalesce(c.new_pcta_ms, c.new_pta_ms) - c.sta_ms < 172800000 AND CAST(c.flight_date AS DATE) - CAST(f.root_date AS DATE) < 2
      THEN true ELSE false END AS continues
  FROM f{r} f LEFT JOIN proj{r} c ON c.flight_key = f.flight_key),
f{r + 1} AS MATERIALIZED (
  SELECT batch_id, root_key, request_id, min(root_date) AS root_date, min(route_id) AS route_id, bool_or(swap) AS swap, flight_key,
    count(*) AS arrivals, count(error) AS errors,
    arg_min(last_key, o) AS last_key, arg_min(resource_type, o) AS resource_type, arg_min(path, o) AS path,
    CASE WHEN count(error) = count(*) THEN min(error) END AS error
  FROM (SELECT *, {{'e': error IS NOT NULL, 'l': last_key, 't': resource_type}} AS o
    FROM (SELECT v.batch_id, v.root_key, v.request_id, v.route_id, v.root_date, v.swap, l.dst AS flight_key, l.src AS last_key, l.resource_type,
        list_append(v.path, l.dst) AS path,
        CASE WHEN l.resource_type = 'EQUIPMENT' AND w.prev_leg_key <> l.src THEN 'previous leg differs' END AS error
      FROM v{r} v JOIN inside l ON l.src = v.flight_key JOIN s0 w ON w.flight_key = l.dst WHERE v.continues))
  GROUP BY batch_id, root_key, request_id, flight_key)"""


# Relations inside each request: its keys, the stored times of its snapshot, links and crew.
_INSIDE = """
reqs AS (SELECT DISTINCT request_id AS req FROM wide UNION SELECT '0'),
s0 AS MATERIALIZED (
  SELECT w.* REPLACE (r.req || ':' || w.flight_key AS flight_key, r.req || ':' || w.prev_leg_key AS prev_leg_key,
    coalesce(n.ptd_ms, w.ptd_ms) AS ptd_ms, coalesce(n.pta_ms, w.pta_ms) AS pta_ms)
  FROM wide w CROSS JOIN reqs r LEFT JOIN snap n ON n.flight_key = w.flight_key AND n.snapshot_id = r.req),
people AS MATERIALIZED (
  SELECT c.* REPLACE (r.req || ':' || c.flight_key AS flight_key, r.req || ':' || c.prev_flight_key AS prev_flight_key) FROM crew c CROSS JOIN reqs r),
inside AS MATERIALIZED (SELECT r.req || ':' || l.src AS src, r.req || ':' || l.dst AS dst, l.resource_type FROM links l CROSS JOIN reqs r)"""


def _log_sql(cancel_continues: bool = False) -> str:
    first = f"""
late AS (SELECT *, 'B' || (part_id % 4) AS batch_id, 'R' || (supp_id % 5) AS route_id FROM wide WHERE {LATE}),
roots AS (
  SELECT flight_key, flight_date, request_id, request_type, batch_id, route_id FROM late
  UNION ALL SELECT flight_key, flight_date, '0', 'LIVE', batch_id, route_id FROM late WHERE {TWICE}),
f0 AS MATERIALIZED (
  SELECT batch_id, flight_key AS root_key, request_id, flight_date AS root_date,
    CASE WHEN request_type <> 'LIVE' THEN route_id END AS route_id, request_type = 'SWAP_WHATIF' AS swap,
    request_id || ':' || flight_key AS flight_key, 1 AS arrivals, 0 AS errors, CAST(NULL AS VARCHAR) AS last_key,
    CAST(NULL AS VARCHAR) AS resource_type, [request_id || ':' || flight_key] AS path, CAST(NULL AS VARCHAR) AS error
  FROM roots)"""
    log = "\nUNION ALL ".join(
        f"""SELECT CAST({r} AS BIGINT) AS round, v.batch_id, v.root_key, v.request_id, v.route_id, split_part(v.flight_key, ':', 2) AS flight_key,
  split_part(v.last_key, ':', 2) AS last_key, v.resource_type,
  CAST(v.arrivals AS BIGINT) AS arrivals, CAST(v.errors AS BIGINT) AS errors, v.continues,
  {", ".join(f"v.new_{f}" for f in p.PROJECTED)}, v.path,
  CASE WHEN v.continues THEN coalesce(d.n, 0) ELSE 0 END AS children
FROM v{r} v LEFT JOIN degree d ON d.src = split_part(v.flight_key, ':', 2)"""
        for r in range(SQL_ROUNDS)
    )
    return with_(
        *_ALL,
        state.TAILS_SQL,
        state.snap_sql(),
        _INSIDE,
        "degree AS (SELECT src, count(*) AS n FROM links GROUP BY src)",
        first,
        *[_round_sql(r, cancel_continues) for r in range(SQL_ROUNDS)],
        f"""visits AS ({log}
UNION ALL SELECT error('legs are left after the last round'), NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL,
  {", ".join("NULL" for _ in p.PROJECTED)}, NULL, NULL FROM f{SQL_ROUNDS})""",
    )


_SEEN = "SELECT * EXCLUDE (path) FROM visits"
_TRACK = """,
track AS (
  SELECT batch_id, root_key, request_id, CAST(sum(arrivals) AS BIGINT) AS processed, CAST(sum(children) AS BIGINT) AS children,
    CAST(1 + sum(children) - sum(arrivals) AS BIGINT) AS pending, CAST(sum(errors) AS BIGINT) AS failures,
    sum(errors) > 0 AS failed, max(round) AS last_round
  FROM visits GROUP BY batch_id, root_key, request_id)
"""


def _times_sql() -> str:
    asked = " UNION ".join(f"SELECT flight_key FROM f{r} WHERE error IS NULL" for r in range(SQL_ROUNDS))
    last = _state_sql(SQL_ROUNDS).strip().rstrip(",")
    return _log_sql() + f""",
{last}
SELECT split_part(flight_key, ':', 1) AS request_id, split_part(flight_key, ':', 2) AS flight_key, {", ".join(p.PROJECTED)}
FROM s{SQL_ROUNDS} WHERE flight_key IN ({asked})"""


ORACLE = {
    "edges": with_(*_ALL)
    + """SELECT src, dst, resource_type, dst || '||' || resource_type AS link, dst AS link_key,
    resource_type AS link_resource FROM links""",
    "equipment_edges": _WIDE
    + "SELECT flight_key AS src, next_leg_key AS dst, 'EQUIPMENT' AS resource_type FROM wide WHERE next_leg_key IS NOT NULL",
    "inbound_legs": with_(*_ALL) + "SELECT DISTINCT flight_key, prev_key FROM waits",
    "propagation_rounds": _log_sql() + _SEEN,
    "propagation_after_cancel": _log_sql(True) + _SEEN,
    "propagated_times": _times_sql(),
    "deepest_paths": _log_sql()
    + """
SELECT batch_id, root_key, request_id, flight_key, round,
  array_to_string(list_transform(path, lambda x: split_part(x, ':', 2)), ',') AS path
FROM (SELECT *, row_number() OVER (PARTITION BY batch_id, root_key, request_id ORDER BY round DESC, flight_key DESC) AS rn FROM visits)
WHERE rn = 1""",
    "tracker_state": _log_sql() + _TRACK + "SELECT * FROM track",
    "tracker_complete": _log_sql()
    + _TRACK
    + """SELECT batch_id, root_key AS flight_key, request_id, 'PE_COMPLETE' AS event_type, CASE WHEN failed THEN 'FAILED' ELSE 'DONE' END AS status,
       processed FROM track WHERE pending = 0""",
    "continue_filter": projection._PROJ
    + """
SELECT q.flight_key, coalesce((q.new_pta_ms IS DISTINCT FROM q.pta_ms OR q.new_pcta_ms IS DISTINCT FROM q.pcta_ms
    OR (q.request_type = 'SWAP_WHATIF' AND q.new_plmta_ms IS NOT NULL))
  AND coalesce(q.new_pcta_ms, q.new_pta_ms) - coalesce(q.sta_ms, q.std_ms) < 172800000
  AND (i.flight_date IS NULL OR CAST(q.flight_date AS DATE) - CAST(i.flight_date AS DATE) < 2), false) AS continues
FROM proj q LEFT JOIN wide i ON i.flight_key = q.prev_leg_key""",
    "cycle_guard": with_(*_ALL)
    + """,
steps AS (SELECT src, dst, resource_type FROM links UNION SELECT dst, src, resource_type FROM links)
SELECT a.src AS start, a.dst AS at, b.dst, b.resource_type,
       CASE WHEN b.resource_type = 'EQUIPMENT' AND b.dst IN (a.src, a.dst) THEN 'cyclic path'
            WHEN b.resource_type = 'EQUIPMENT' AND w.prev_leg_key <> b.src THEN 'previous leg differs' END AS error,
       array_to_string(list_sort(list_distinct([a.src, a.dst, b.dst])), ',') AS path
FROM links a JOIN steps b ON b.src = a.dst JOIN wide w ON w.flight_key = b.dst WHERE a.resource_type = 'EQUIPMENT'""",
    "calculated_markers": _WIDE
    + "SELECT flight_key, 'PE_CALCULATED' AS event_type, prev_leg_key FROM wide WHERE request_type = 'LIVE'",
    "ron_flag": _WIDE
    + """
SELECT flight_key, cut AS cut_off_ms, CASE
    WHEN in_key IS NULL THEN coalesce(plmtd_ms > cut, true)
    WHEN in_plmta IS NULL OR plmtd_ms IS NULL THEN true
    ELSE in_plmta < cut AND plmtd_ms > cut END AS overnight
FROM (SELECT c.flight_key, c.plmtd_ms, i.flight_key AS in_key, i.plmta_ms AS in_plmta,
    epoch_ms(CAST(c.flight_date AS TIMESTAMP)) + 97200000 - coalesce(c.dep_gmt_min, -300) * 60000 AS cut
  FROM wide c LEFT JOIN wide i ON i.flight_key = c.prev_leg_key)""",
    "d0_a14_by_date": projection._PROJ
    + """
SELECT flight_date, count(*) AS flights, count(*) FILTER (new_ptd_ms - std_ms BETWEEN -59999 AND 59999) AS d0,
       count(*) FILTER (new_pta_ms - sta_ms < 900000) AS a14,
       round(count(*) FILTER (new_ptd_ms - std_ms BETWEEN -59999 AND 59999) / count(*), 6) AS d0_rate,
       round(count(*) FILTER (new_pta_ms - sta_ms < 900000) / count(*), 6) AS a14_rate
FROM proj GROUP BY flight_date""",
    "crew_groups": with_(*_ALL)
    + """SELECT crew_type, count(DISTINCT next_flight_key) AS next_flights, count(DISTINCT duty_key) AS duties
FROM crew WHERE next_flight_key IS NOT NULL GROUP BY crew_type""",
    "unlinked_resources": with_(*_ALL)
    + """SELECT CASE WHEN deadhead THEN 'UNKNOWN' ELSE 'CREW' END AS resource_type, count(*) AS continuations,
       count(*) FILTER (deadhead) AS missing_type FROM crew GROUP BY 1""",
}
