"""Lookup queries: inbound legs, crew, overlays, previous leg, tails."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyledger.operators import lookup
from skyledger.operators.versions import KeyedState
from skyledger.plans.relations_sql import CREW, FLIGHTS, LEGS, with_
from skyledger.sources import state
from skyledger.session import run_dir, settle
from skyledger.sources.flights import crew_assignments, flights, hot_duties, legs

GATE = "'G' || (supp_id % 12)"


def _wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.wide_legs(spark, sf_dir).rows()


def inbound_equipment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every leg with its equipment links and the inbound leg's times."""
    wide = _wide(spark, sf_dir)
    joined = lookup.inbound(
        wide.select("flight_key", "tail", "prev_leg_key", "next_leg_key"),
        wide,
        "prev_leg_key",
        ("pta_ms", "lta_ms", "pcta_ms"),
    )
    return joined.drop("in_flight_key")


def inbound_crew(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every crew member whose inbound leg is known, with that leg's times."""
    wide = _wide(spark, sf_dir)
    crew = crew_assignments(wide, hot_duties(spark, sf_dir))
    joined = lookup.inbound(crew, wide, "prev_flight_key", ("pta_ms", "pcta_ms"), "inner")
    return joined.select("flight_key", "duty_key", "crew_type", "turn_min", "in_flight_key", "in_pta_ms", "in_pcta_ms")


def _resolution(spark: SparkSession, sf_dir: str):
    mine = ("flight_key", "airline", "prev_date", "prev_number", "dep_station", "snapshot_id", "tail", "std_ms")
    theirs = ("flight_key", "airline", "flight_date", "flight_number", "arr_station", "snapshot_id", "tail", "std_ms")
    both = flights(legs(spark, sf_dir)).rows().withColumn("snapshot_id", F.lit("0"))
    # Read several times below, so written once.
    kept = settle(both.select(*dict.fromkeys([*mine, *theirs])), "flights")
    return kept.select(*mine), kept.select(*theirs)


def prev_leg_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many flights could be the previous leg, and the branch that follows."""
    counted = lookup.previous_leg_counts(*_resolution(spark, sf_dir))
    branch = F.when(F.col("n_candidates") == 0, "none").when(F.col("n_candidates") == 1, "single").otherwise("several")
    return counted.select("flight_key", "n_candidates", branch.alias("branch"))


def prev_leg_tail_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates left after those flown by another aircraft are dropped."""
    counted = lookup.previous_leg_counts(*_resolution(spark, sf_dir))
    return counted.filter("n_candidates > 1").select("flight_key", "n_candidates", "n_after_tail")


def prev_leg_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.resolve_previous_leg(*_resolution(spark, sf_dir))


def status_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status under request 7: the what-if row where there is one."""
    wide = _wide(spark, sf_dir)
    live = wide.select("flight_key", "leg_status", "dep_status")
    return lookup.overlay_row(live, state.snapshots(wide), "7", ("leg_status", "dep_status"))


def snapshot_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times under request 7, field by field."""
    wide = _wide(spark, sf_dir)
    live = wide.select("flight_key", "pta_ms", "ptd_ms", "lta_ms", "std_ms")
    return lookup.overlay(live, state.snapshots(wide), "7", ("pta_ms", "ptd_ms", "lta_ms"))


def tail_ready(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = _wide(spark, sf_dir).select("flight_key", "airline", "tail", "ogt_min")
    ready = lookup.tail_ready(wide, state.tails(spark, sf_dir), F.coalesce("ogt_min", F.lit(0)))
    return ready.select("flight_key", "tail", "ots", "tail_ready_ms")


def crew_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = _wide(spark, sf_dir)
    needed = ("flight_key", "part_id", "supp_id", "std_ms", "chain_id", "leg_seq", "line_no")
    wide = settle(wide.select(*needed, "dep_station", "arr_station", "tail", "airline"), "flights")
    known = wide.withColumn("gate", F.expr(GATE))
    crew = crew_assignments(wide, hot_duties(spark, sf_dir)).select(
        "flight_key", "duty_key", "crew_type", "prev_flight_key"
    )
    return lookup.crew_context(crew, known, state.airports(spark, sf_dir))


def id_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times of all legs that some crew member works next."""
    wide = _wide(spark, sf_dir)
    keys = crew_assignments(wide, hot_duties(spark, sf_dir)).filter(F.col("next_flight_key").isNotNull()).select(
        F.col("next_flight_key").alias("flight_key")
    )
    return lookup.by_ids(keys, wide, ("ltd_ms", "lta_ms", "pta_ms"))


# Columns by which stored flights are found.
FOUND_BY = ("airline", "flight_number", "dep_station", "arr_station")


def flight_index(spark: SparkSession, sf_dir: str) -> KeyedState:
    """The flights stored by the columns they are found by, one version of the state."""
    rows = flights(legs(spark, sf_dir)).rows().select("flight_key", "flight_date", "std_ms", *FOUND_BY)
    index = KeyedState(spark, run_dir(spark, "flights"), rows.schema, FOUND_BY)
    index.write(0, rows)
    return index


def indexed_find(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored flights that match four equalities: one bucket of the state, filtered in its scan."""
    found = flight_index(spark, sf_dir).find(airline="A1", flight_number="2", dep_station="S3", arr_station="S1")
    return found.select("flight_key", "flight_date", "std_ms")


QUERIES = {
    f.__name__: f
    for f in (
        inbound_equipment,
        inbound_crew,
        prev_leg_candidates,
        prev_leg_tail_filter,
        prev_leg_resolved,
        status_overlay,
        snapshot_overlay,
        tail_ready,
        crew_context,
        id_lookup,
        indexed_find,
    )
}

_WIDE = with_(LEGS, FLIGHTS, state.wide_sql())
_CREW = with_(LEGS, FLIGHTS, state.wide_sql(), CREW)
_CAND = """
cand AS (
  SELECT c.flight_key, c.tail, c.std_ms, p.flight_key AS cand_key, p.std_ms AS cand_std,
         c.tail IS NULL OR p.tail IS NULL OR lower(c.tail) = lower(p.tail) AS kept
  FROM flights c JOIN flights p ON c.prev_number IS NOT NULL AND p.airline = c.airline AND p.flight_date = c.prev_date
    AND p.flight_number = c.prev_number AND p.arr_station = c.dep_station),
counted AS (
  SELECT f.flight_key, f.std_ms, count(c.cand_key) AS n_candidates, count(c.cand_key) FILTER (c.kept) AS n_after_tail,
         min(c.cand_key) AS only_all, min(c.cand_key) FILTER (c.kept) AS only_kept,
         max({'s': c.cand_std, 'k': c.cand_key}) FILTER (c.kept AND c.cand_std <= c.std_ms AND c.cand_key <> c.flight_key) AS near
  FROM flights f LEFT JOIN cand c ON c.flight_key = f.flight_key GROUP BY f.flight_key, f.std_ms)"""
_PREV = with_(LEGS, FLIGHTS, _CAND)

ORACLE = {
    "inbound_equipment": _WIDE
    + """
SELECT c.flight_key, c.tail, c.prev_leg_key, c.next_leg_key, p.pta_ms AS in_pta_ms, p.lta_ms AS in_lta_ms,
       p.pcta_ms AS in_pcta_ms
FROM wide c LEFT JOIN wide p ON p.flight_key = c.prev_leg_key""",
    "inbound_crew": _CREW
    + """
SELECT c.flight_key, c.duty_key, c.crew_type, c.turn_min, p.flight_key AS in_flight_key, p.pta_ms AS in_pta_ms,
       p.pcta_ms AS in_pcta_ms
FROM crew c JOIN wide p ON p.flight_key = c.prev_flight_key""",
    "prev_leg_candidates": _PREV
    + """
SELECT flight_key, n_candidates, CASE n_candidates WHEN 0 THEN 'none' WHEN 1 THEN 'single' ELSE 'several' END AS branch
FROM counted""",
    "prev_leg_tail_filter": _PREV
    + "SELECT flight_key, n_candidates, n_after_tail FROM counted WHERE n_candidates > 1",
    "prev_leg_resolved": _PREV
    + """
SELECT flight_key, n_candidates, n_after_tail,
       CASE WHEN n_candidates = 0 THEN 'none' WHEN n_candidates = 1 THEN 'single' WHEN n_after_tail = 0 THEN 'none'
            WHEN n_after_tail = 1 THEN 'tail' ELSE 'nearest' END AS rule,
       CASE WHEN n_candidates = 0 THEN NULL WHEN n_candidates = 1 THEN only_all WHEN n_after_tail = 0 THEN NULL
            WHEN n_after_tail = 1 THEN only_kept ELSE near.k END AS resolved_key
FROM counted""",
    "status_overlay": _WIDE
    + ","
    + state.snap_sql()
    + """
SELECT w.flight_key, CASE WHEN s.flight_key IS NULL THEN w.leg_status ELSE s.leg_status END AS leg_status,
       CASE WHEN s.flight_key IS NULL THEN w.dep_status ELSE s.dep_status END AS dep_status,
       s.flight_key IS NOT NULL AS from_snapshot
FROM wide w LEFT JOIN snap s ON s.flight_key = w.flight_key""",
    "snapshot_overlay": _WIDE
    + ","
    + state.snap_sql()
    + """
SELECT w.flight_key, coalesce(s.pta_ms, w.pta_ms) AS pta_ms, coalesce(s.ptd_ms, w.ptd_ms) AS ptd_ms,
       coalesce(s.lta_ms, w.lta_ms) AS lta_ms, w.std_ms
FROM wide w LEFT JOIN snap s ON s.flight_key = w.flight_key""",
    "tail_ready": _WIDE
    + ","
    + state.TAILS_SQL
    + """
SELECT w.flight_key, w.tail, t.ots,
       CASE WHEN t.ots THEN t.est_return_ms ELSE t.return_ms END + coalesce(w.ogt_min, 0) * 60000 AS tail_ready_ms
FROM wide w LEFT JOIN tails t ON t.airline = w.airline AND t.tail = w.tail""",
    "crew_context": _CREW
    + ","
    + state.AIRPORTS_SQL
    + f""", gated AS (SELECT *, {GATE} AS gate FROM wide)
SELECT c.flight_key, c.duty_key, c.crew_type, c.prev_flight_key, m.dep_station AS departure_station,
       m.tail AS departure_tail, m.airline AS departure_airline, m.gate AS departure_gate,
       p.arr_station AS in_arr_station, p.tail AS in_tail, p.airline AS in_airline, p.gate AS in_gate,
       a.airport, a.area, coalesce(m.tail = p.tail, false) AS same_tail
FROM crew c JOIN gated m ON m.flight_key = c.flight_key
LEFT JOIN gated p ON p.flight_key = c.prev_flight_key
LEFT JOIN airports a ON a.station = p.arr_station
WHERE c.prev_flight_key IS NOT NULL""",
    "id_lookup": _CREW
    + """
SELECT flight_key, ltd_ms, lta_ms, pta_ms FROM wide
WHERE flight_key IN (SELECT next_flight_key FROM crew WHERE next_flight_key IS NOT NULL)""",
    "indexed_find": with_(LEGS, FLIGHTS)
    + """
SELECT flight_key, flight_date, std_ms FROM flights
WHERE airline = 'A1' AND flight_number = '2' AND dep_station = 'S3' AND arr_station = 'S1'""",
}
