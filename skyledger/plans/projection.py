"""Ready times, projected times, changes and problems of every leg."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyledger.operators import project as p
from skyledger.operators import sinks
from skyledger.plans.relations_sql import CREW, EVENTS, FLIGHTS, LEGS, with_
from skyledger.session import run_dir
from skyledger.sources import state
from skyledger.sources.flights import crew_assignments, delay_events, hot_duties

# What the projection reads and returns of the state, and what crew duties read.
STATE = (
    "flight_key", "flight_date", "std_ms", "sta_ms", "ltd_ms", "lta_ms", "ptd_ms", "pctd_ms", "pmtd_ms", "plmtd_ms",
    "pta_ms", "pcta_ms", "pmta_ms", "plmta_ms", "ctd_ms", "cta_ms", "taxi_out_min", "taxi_in_min", "pred_air_min",
    "leg_status", "dep_status", "arr_status", "prev_leg_key", "airline", "tail", "ogt_min", "request_type", "request_id",
    "pe_event", "out_ms", "off_ms", "on_ms", "in_ms",
)
DUTY = ("part_id", "supp_id", "chain_id", "leg_seq", "line_no")

# What the resources read of the state.
READY = ("flight_key", "prev_leg_key", "airline", "tail", "ogt_min", "request_type", "pe_event")


def _parts(spark: SparkSession, sf_dir: str):
    """Current state of all legs, and the resources they wait for.

    The scans of lines and duties that find an inbound leg also give what its times follow from, so
    the state is not joined to itself.  It is written once, narrow, and worked out where it is read.
    """
    linked, duties = state.linked_legs(spark, sf_dir), hot_duties(spark, sf_dir)
    legs = state.with_inbound(state.linked_rows(linked).select(*READY, *[f"prev_{c}" for c in state.TIMED]))
    # The narrow columns go to the duty, not what follows from them; very large duties are cut instead.
    near = linked if duties else linked.repartition("part_id")
    crew = crew_assignments(state.linked_rows(near), duties, with_request=True, beside=state.TIMED)
    ready = p.resource_ready(legs, state.with_inbound(crew), state.tails(spark, sf_dir))
    return state.spread_rows(linked).select(*STATE), ready


def _projected(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide, resources = _parts(spark, sf_dir)
    return p.project(wide.join(p.max_ready(resources), "flight_key", "left"))


def resource_ready(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All resource rows; what-if rules apply per request type of the leg."""
    return _parts(spark, sf_dir)[1]


def equipment_ready(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resource rows with the crew switched off."""
    wide = state.wide_legs(spark, sf_dir).rows()
    return p.resource_ready(wide, None, state.tails(spark, sf_dir), with_crew=False)


def max_ready_by_leg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p.max_ready(_parts(spark, sf_dir)[1])


def most_restrictive_resource(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p.most_restrictive(_parts(spark, sf_dir)[1])


def projected_departure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Departures from the ready times, for every leg whatever its event."""
    wide, resources = _parts(spark, sf_dir)
    joined = wide.join(p.max_ready(resources), "flight_key", "left")
    return joined.select("flight_key", *[c.alias(n) for n, c in p.departures().items()])


def projected_arrival(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrivals from the stored departures, for every leg."""
    wide = state.wide_legs(spark, sf_dir).rows()
    stored = {n: F.col(n) for n in p.DEP}
    return wide.select("flight_key", *[c.alias(n) for n, c in p.arrivals(stored).items()])


def schedule_substitution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Legs that fall back to their schedule, with the values they had."""
    done = p.project(_no_ready(state.wide_legs(spark, sf_dir).rows())).filter("rule = 'schedule'")
    return done.select(
        "flight_key",
        *[F.col(f"new_{f}").alias(f) for f in p.PROJECTED],
        *[F.col(f).alias(f"prev_{f}") for f in p.REMEMBERED],
    )


def _no_ready(wide: DataFrame) -> DataFrame:
    return wide.withColumns({f"max_{m}": F.lit(None).cast("long") for m in p.MEASURES})


def actual_event_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight projected fields after each leg's own event, and the rule used."""
    return _projected(spark, sf_dir).select(
        "flight_key", "pe_event", "rule", *[F.col(f"new_{f}").alias(f) for f in p.PROJECTED]
    )


def times_change_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which published fields changed, per leg."""
    changes = p.change_set(_projected(spark, sf_dir))
    return changes.select("flight_key", "request_id", "request_type", *[f"chg_{f}" for f in p.CHANGE_EVENTS])


def change_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = p.change_events(p.change_set(_projected(spark, sf_dir)))
    return sinks.stored(found, run_dir(spark, "changes"), 1)


def published_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the projection writes back to the flight times."""
    return p.published_times(p.change_set(_projected(spark, sf_dir)))


def maintenance_return(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = state.wide_legs(spark, sf_dir).rows()
    return p.maintenance_return(wide, state.tails(spark, sf_dir))


def reseed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change events of a reseed: every field, changed or not."""
    return p.change_events(p.change_set(_projected(spark, sf_dir), reseed=True), maintenance_with_control=True)


def stored_change_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes between the stored projected times and the remembered ones."""
    wide = state.wide_legs(spark, sf_dir).rows()
    flags = {
        f"chg_{f}": F.col(f).isNotNull() if f.startswith("plm") else p.changed(F.col(f), F.col(f"prev_{f}"))
        for f in p.CHANGE_EVENTS
    }
    return wide.select("flight_key", *[c.alias(n) for n, c in flags.items()])


def problem_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p.problems(_projected(spark, sf_dir))


def mntc_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = state.wide_legs(spark, sf_dir).rows()
    times = p.maintenance_times(F.col("ptd_ms"), F.col("pta_ms"), F.col("pmtd_ms"))
    return wide.select("flight_key", *[c.alias(n) for n, c in times.items()])


def debug_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored calculation debug row: the event, the new times and the deciding resource."""
    wide, resources = _parts(spark, sf_dir)
    done = p.project(wide.join(p.max_ready(resources), "flight_key", "left"))
    rows = done.join(p.most_restrictive(resources), "flight_key", "left").select(
        "flight_key",
        "pe_event",
        F.col("new_ptd_ms").alias("ptd_ms"),
        F.col("new_pta_ms").alias("pta_ms"),
        "resource_type",
        "resource_key",
        F.col("ready_ms").alias("resource_ready_ms"),
    )
    return sinks.stored(rows, run_dir(spark, "debug"), 1)


def _delay_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delay events, some without a key, a time or a readable value."""
    events = delay_events(spark, sf_dir)
    chain = F.col("chain_id")
    return events.select(
        "chain_id",
        F.when(chain % 19 != 0, F.concat_ws("-", "chain_id", "event_seq")).alias("flight_key"),
        "event_type",
        F.when(chain % 23 == 0, "late").otherwise(F.col("value")).alias("value"),
        F.when(chain % 29 != 0, F.col("prev_leg_pta_ms")).alias("source_ts_ms"),
    ).withColumns(
        {
            "value_ms": F.expr("try_cast(value as bigint)"),
            "needs_value": F.col("event_type").isin(
                "CREW_CABIN_DLY_EVENT",
                "CREW_COCKPIT_DLY_EVENT",
                "ACTUAL_OFF_CHANGE",
                "ACTUAL_ON_CHANGE",
                "ACTUAL_OUT_CHANGE",
                "ACTUAL_IN_CHANGE",
            ),
        }
    )


def quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p.quarantine(_delay_inputs(spark, sf_dir)).select("chain_id", "event_type", "error")


QUERIES = {
    f.__name__: f
    for f in (
        resource_ready,
        equipment_ready,
        max_ready_by_leg,
        most_restrictive_resource,
        projected_departure,
        projected_arrival,
        schedule_substitution,
        actual_event_projection,
        times_change_set,
        stored_change_set,
        change_events,
        published_times,
        maintenance_return,
        reseed_events,
        problem_rows,
        mntc_times,
        debug_rows,
        quarantine,
    )
}


def _ready_cols(turn: str, continued: str) -> str:
    plain = f"CASE WHEN i.lta_ms IS NULL THEN 0 ELSE coalesce(i.pta_ms, i.lta_ms) + {turn} * 60000 END"
    return f"""
    {plain} AS ready_ms,
    CASE WHEN i.lta_ms IS NULL THEN 0 ELSE coalesce(i.pcta_ms, i.lta_ms) + {turn} * 60000 END AS ready_control_ms,
    CASE WHEN i.pmta_ms IS NOT NULL THEN i.pmta_ms + {turn} * 60000 WHEN i.plmta_ms IS NOT NULL
         THEN i.plmta_ms + {turn} * 60000 ELSE {plain} END AS ready_mntc_ms,
    CASE WHEN w.request_type <> 'SWAP_WHATIF' THEN 0
         ELSE CASE WHEN {continued} AND i.plmta_ms IS NOT NULL THEN i.plmta_ms ELSE coalesce(i.lta_ms, 0) END
              + {turn} * 60000 END AS latest0"""


_EQUIPMENT = f"""
served AS (
  SELECT w.*, t.ots, CASE WHEN w.request_type = 'SWAP_WHATIF' AND w.pe_event = 'PE_TAIL' THEN
      coalesce(CASE WHEN t.ots THEN t.est_return_ms ELSE t.return_ms END + coalesce(w.ogt_min, 0) * 60000, 0) ELSE 0 END AS service
  FROM wide w LEFT JOIN tails t ON t.airline = w.airline AND t.tail = w.tail),
craft AS (
  SELECT flight_key, prev_flight_key, prev_flight_key AS resource_key, 'EQUIPMENT' AS resource_type, 'AC' AS seat, turn_min,
         ready_ms, ready_control_ms, ready_mntc_ms, greatest(latest0, service) AS ready_latest_ms
  FROM (SELECT w.flight_key, i.flight_key AS prev_flight_key, coalesce(w.ogt_min, 0) AS turn_min, w.service,
        {_ready_cols("coalesce(w.ogt_min, 0)", "w.pe_event = 'PE_CONTINUED'")}
        FROM served w JOIN wide i ON i.flight_key = w.prev_leg_key)
  UNION ALL
  SELECT flight_key, flight_key, flight_key, 'EQUIPMENT', 'AC', NULL, 0, 0, 0, service
  FROM served WHERE prev_leg_key IS NULL AND request_type = 'SWAP_WHATIF' AND pe_event = 'PE_TAIL' AND ots)"""
_RES = f"""
res AS (
  SELECT * FROM craft
  UNION ALL
  SELECT flight_key, prev_flight_key, duty_key, 'CREW', seat, turn_min, ready_ms, ready_control_ms, ready_mntc_ms, latest0
  FROM (SELECT c.flight_key, c.prev_flight_key, c.duty_key, c.seat, c.turn_min, {_ready_cols("c.turn_min", "false")}
        FROM crew c JOIN wide w ON w.flight_key = c.flight_key JOIN wide i ON i.flight_key = c.prev_flight_key))"""
_MAX = """
mx AS (
  SELECT flight_key, max(ready_ms) AS max_ready_ms, max(ready_control_ms) AS max_ready_control_ms,
         max(ready_mntc_ms) AS max_ready_mntc_ms, max(ready_latest_ms) AS max_ready_latest_ms,
         CASE WHEN max(ready_ms) > 0 THEN max({'v': ready_ms, 't': resource_type}).t END AS ready_type,
         CASE WHEN max(ready_control_ms) > 0 THEN max({'v': ready_control_ms, 't': resource_type}).t END AS ready_control_type,
         CASE WHEN max(ready_mntc_ms) > 0 THEN max({'v': ready_mntc_ms, 't': resource_type}).t END AS ready_mntc_type
  FROM res GROUP BY flight_key)"""
_FIRST = """
first_res AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY flight_key ORDER BY ready_ms DESC,
      CASE resource_type WHEN 'EQUIPMENT' THEN 0 ELSE 1 END, resource_key) AS rn FROM res) WHERE rn = 1)"""


def _arr(dep: str) -> str:
    """The four arrivals from departures prefixed `dep`."""
    air = "coalesce(pred_air_min, (sta_ms - std_ms) // 60000) * 60000"
    return f"""
  CASE WHEN arr_status IN ('ON', 'IN') THEN lta_ms ELSE greatest(lta_ms, coalesce({dep}ptd_ms, ltd_ms, 0) + {air}) END AS a_pta_ms,
  CASE WHEN arr_status IN ('ON', 'IN') THEN lta_ms ELSE greatest(lta_ms, coalesce({dep}pctd_ms, ltd_ms, 0) + {air},
       CASE WHEN leg_status <> 'ROUTE_OUT' THEN cta_ms + taxi_in_min * 60000 END) END AS a_pcta_ms,
  CASE WHEN arr_status IN ('ON', 'IN') THEN lta_ms ELSE greatest(lta_ms, coalesce({dep}ptd_ms, ltd_ms, 0) + {air},
       coalesce({dep}pmtd_ms, 0) + {air}) END AS a_pmta_ms,
  CASE WHEN arr_status IN ('ON', 'IN') THEN lta_ms ELSE greatest(lta_ms, coalesce({dep}plmtd_ms, 0) + {air}) END AS a_plmta_ms"""


_DEP = """
dep AS (
  SELECT w.*, m.* EXCLUDE (flight_key),
    CASE WHEN dep_status IN ('OUT', 'OFF') THEN ltd_ms ELSE greatest(ltd_ms, max_ready_ms) END AS d_ptd_ms,
    CASE WHEN dep_status IN ('OUT', 'OFF') THEN ltd_ms ELSE greatest(ltd_ms, max_ready_control_ms,
         CASE WHEN leg_status <> 'ROUTE_OUT' THEN ctd_ms - taxi_out_min * 60000 END) END AS d_pctd_ms,
    CASE WHEN dep_status IN ('OUT', 'OFF') THEN ltd_ms ELSE greatest(ltd_ms, max_ready_ms, max_ready_mntc_ms) END AS d_pmtd_ms,
    CASE WHEN dep_status IN ('OUT', 'OFF') THEN ltd_ms ELSE greatest(ltd_ms, max_ready_latest_ms) END AS d_plmtd_ms
  FROM wide w LEFT JOIN mx m ON m.flight_key = w.flight_key)"""
_RULED = f"""
ruled AS (
  SELECT *, CASE
      WHEN leg_status IN ('CANCELLED', 'CANCELLED_VIA_XL', 'CANCELLED_VIA_PLAN') OR pe_event = 'PE_CANCEL' THEN 'schedule'
      WHEN pe_event = 'PE_OUT' THEN CASE WHEN out_ms IS NULL THEN 'ignored' ELSE 'out' END
      WHEN pe_event = 'PE_IN' THEN CASE WHEN in_ms IS NULL THEN 'ignored' ELSE 'in' END
      WHEN pe_event = 'PE_OFF' THEN CASE WHEN off_ms IS NULL THEN 'ignored' ELSE 'off' END
      WHEN pe_event = 'PE_ON' THEN CASE WHEN on_ms IS NULL THEN 'ignored' ELSE 'on' END
      WHEN dep_status IN ('OUT', 'OFF') AND pe_event = 'PE_ETA' THEN 'late arrival'
      WHEN dep_status IN ('OUT', 'OFF') AND pe_event IN ('PE_ETD', 'PE_ETR') THEN 'late departure'
      ELSE 'projected' END AS rule,
    CASE WHEN pe_event = 'PE_OUT' THEN out_ms ELSE d_ptd_ms END AS u_ptd_ms,
    CASE WHEN pe_event = 'PE_OUT' THEN out_ms ELSE d_pctd_ms END AS u_pctd_ms,
    CASE WHEN pe_event = 'PE_OUT' THEN out_ms ELSE d_pmtd_ms END AS u_pmtd_ms,
    CASE WHEN pe_event = 'PE_OUT' THEN out_ms ELSE d_plmtd_ms END AS u_plmtd_ms
  FROM dep),
proj AS (
  SELECT *,
""" + ",\n".join(
    f"""    CASE rule WHEN 'schedule' THEN std_ms WHEN 'out' THEN out_ms WHEN 'off' THEN ltd_ms
         WHEN 'projected' THEN d_{f} {"WHEN 'late departure' THEN ltd_ms" if f != "pctd_ms" else ""} ELSE {f} END AS new_{f}"""
    for f in p.DEP
) + ",\n" + ",\n".join(
    f"""    CASE rule WHEN 'schedule' THEN sta_ms WHEN 'out' THEN a_{f} WHEN 'in' THEN in_ms WHEN 'off' THEN lta_ms
         WHEN 'projected' THEN a_{f}
         {"WHEN 'on' THEN on_ms + taxi_in_min * 60000" if f == "pcta_ms" else "WHEN 'late arrival' THEN lta_ms WHEN 'late departure' THEN lta_ms"}
         ELSE {f} END AS new_{f}"""
    for f in p.ARR
) + """
  FROM (SELECT *, """ + _arr("u_") + """ FROM ruled))"""

_PUB = {
    "ptd_ms": "'schedule', 'out', 'off', 'projected', 'late departure'",
    "pctd_ms": "'schedule', 'out', 'off', 'projected'",
    "plmtd_ms": "'schedule', 'out', 'off', 'projected', 'late departure'",
    "pta_ms": "'schedule', 'out', 'off', 'projected', 'late departure', 'late arrival', 'in'",
    "pcta_ms": "'schedule', 'out', 'off', 'projected', 'in', 'on'",
    "plmta_ms": "'schedule', 'out', 'off', 'projected', 'late departure', 'late arrival', 'in'",
}
_CHG = (
    "chg AS (SELECT *, "
    + ", ".join(
        f"rule IN ({_PUB[f]}) AND new_{f} IS NOT NULL"
        + ("" if f.startswith("plm") else f" AND new_{f} IS DISTINCT FROM {f}")
        + f" AS chg_{f}"
        for f in p.CHANGE_EVENTS
    )
    + " FROM proj)"
)
_BASE = (LEGS, FLIGHTS, state.wide_sql(), state.TAILS_SQL, _EQUIPMENT)
_FULL = (*_BASE, CREW, _RES)
_PROJ = with_(*_FULL, _MAX, _DEP, _RULED)


def _events_sql(chosen: str, extra: str = "") -> str:
    rows = []
    for field, kind in (("pta_ms", "PTA"), ("pcta_ms", "PTA_CONTROL"), ("ptd_ms", "PTD"), ("plmta_ms", "PLMTA"), ("pctd_ms", "PTD_CONTROL")):
        swap = "=" if kind == "PLMTA" else "<>"
        link = "prev_leg_key" if kind == "PTD" else "CAST(NULL AS VARCHAR)"
        rows.append(
            f"SELECT flight_key, request_id, '{kind}' AS event_type, new_{field} AS value_ms, {field} AS previous_ms, "
            f"{link} AS previous_flight_key FROM {chosen.format(f=field)} request_type {swap} 'SWAP_WHATIF'"
        )
    return "\nUNION ALL ".join(rows) + extra


ORACLE = {
    "resource_ready": with_(*_FULL) + "SELECT * FROM res",
    "equipment_ready": with_(*_BASE) + "SELECT * FROM craft",
    "max_ready_by_leg": with_(*_FULL, _MAX) + "SELECT * FROM mx",
    "most_restrictive_resource": with_(*_FULL, _FIRST)
    + "SELECT flight_key, resource_key, resource_type, seat, prev_flight_key, turn_min, ready_ms FROM first_res",
    "projected_departure": with_(*_FULL, _MAX, _DEP)
    + "SELECT flight_key, d_ptd_ms AS ptd_ms, d_pctd_ms AS pctd_ms, d_pmtd_ms AS pmtd_ms, d_plmtd_ms AS plmtd_ms FROM dep",
    "projected_arrival": with_(LEGS, FLIGHTS, state.wide_sql())
    + "SELECT flight_key, a_pta_ms AS pta_ms, a_pcta_ms AS pcta_ms, a_pmta_ms AS pmta_ms, a_plmta_ms AS plmta_ms FROM (SELECT *, "
    + _arr("")
    + " FROM wide)",
    "schedule_substitution": with_(LEGS, FLIGHTS, state.wide_sql())
    + """
SELECT flight_key, std_ms AS ptd_ms, std_ms AS pctd_ms, std_ms AS pmtd_ms, std_ms AS plmtd_ms, sta_ms AS pta_ms,
       sta_ms AS pcta_ms, sta_ms AS pmta_ms, sta_ms AS plmta_ms, ptd_ms AS prev_ptd_ms, pctd_ms AS prev_pctd_ms,
       plmtd_ms AS prev_plmtd_ms, pta_ms AS prev_pta_ms, pcta_ms AS prev_pcta_ms, plmta_ms AS prev_plmta_ms
FROM wide WHERE leg_status = 'CANCELLED' OR pe_event = 'PE_CANCEL'""",
    "actual_event_projection": _PROJ
    + "SELECT flight_key, pe_event, rule, "
    + ", ".join(f"new_{f} AS {f}" for f in p.PROJECTED)
    + " FROM proj",
    "times_change_set": _PROJ
    + ","
    + _CHG
    + "SELECT flight_key, request_id, request_type, "
    + ", ".join(f"chg_{f}" for f in p.CHANGE_EVENTS)
    + " FROM chg",
    "stored_change_set": with_(LEGS, FLIGHTS, state.wide_sql())
    + "SELECT flight_key, "
    + ", ".join(
        f"{f} IS NOT NULL" + ("" if f.startswith("plm") else f" AND {f} IS DISTINCT FROM prev_{f}") + f" AS chg_{f}"
        for f in p.CHANGE_EVENTS
    )
    + " FROM wide",
    "change_events": _PROJ + "," + _CHG + _events_sql("chg WHERE chg_{f} AND"),
    "published_times": _PROJ
    + ","
    + _CHG
    + "SELECT flight_key, request_id AS snapshot_id, "
    + ", ".join(
        f"CASE WHEN request_id <> '0' OR chg_{f} THEN new_{n} END AS {n}"
        for f, n in (*((f, f) for f in p.CHANGE_EVENTS), ("ptd_ms", "pmtd_ms"), ("pta_ms", "pmta_ms"))
    )
    + ", "
    + ", ".join(f"CASE WHEN request_id <> '0' OR chg_{f} THEN {f} END AS prev_{f}" for f in p.CHANGE_EVENTS)
    + " FROM chg WHERE request_id <> '0' OR "
    + " OR ".join(f"chg_{f}" for f in p.CHANGE_EVENTS),
    "maintenance_return": with_(LEGS, FLIGHTS, state.wide_sql(), state.TAILS_SQL)
    + """
SELECT w.flight_key, w.flight_key AS resource_key, 'EQUIPMENT' AS resource_type,
       pmtd_ms + CASE WHEN pe_event = 'PE_ETR' THEN coalesce(ogt_min, 0) * 60000 ELSE 0 END AS ready_mntc_ms
FROM wide w LEFT JOIN tails t ON t.airline = w.airline AND t.tail = w.tail
WHERE pmtd_ms IS NOT NULL AND (pe_event = 'PE_ETR' OR (coalesce(t.ots, false) AND pmtd_ms > ptd_ms))""",
    "reseed_events": _PROJ
    + _events_sql(
        "proj WHERE",
        """
UNION ALL SELECT flight_key, request_id, 'PMTD', new_pmtd_ms, pmtd_ms, prev_leg_key FROM proj WHERE request_type <> 'SWAP_WHATIF'""",
    ),
    "problem_rows": _PROJ
    + "\nUNION ALL ".join(
        f"SELECT flight_key, '{name}' AS problem_type, '{kind}' AS event_type, new_{f} AS value_ms, "
        f"NOT (leg_status = 'CANCELLED' OR {over}) AS active FROM proj WHERE new_{f} IS NOT NULL AND new_{f} IS DISTINCT FROM {f} {given}"
        for name, kind, f, over, given in (
            ("PROJECTED_DEP_DELAY", "PTD", "ptd_ms", "dep_status IN ('OUT', 'OFF')", ""),
            ("PROJECTED_CONTROLLED_DEP_DELAY", "PTD_CONTROL", "pctd_ms", "dep_status IN ('OUT', 'OFF')", "AND ctd_ms IS NOT NULL"),
            ("PROJECTED_ARR_DELAY", "PTA", "pta_ms", "arr_status IN ('ON', 'IN')", ""),
            ("PROJECTED_CONTROLLED_ARR_DELAY", "PTA_CONTROL", "pcta_ms", "arr_status IN ('ON', 'IN')", "AND cta_ms IS NOT NULL"),
        )
    ),
    "mntc_times": with_(LEGS, FLIGHTS, state.wide_sql())
    + """
SELECT flight_key, CASE WHEN pmtd_ms > ptd_ms THEN pmtd_ms ELSE ptd_ms END AS mntc_departure_ms,
       CASE WHEN pmtd_ms > ptd_ms THEN pta_ms + pmtd_ms - ptd_ms ELSE pta_ms END AS mntc_arrival_ms
FROM wide""",
    "debug_rows": _PROJ
    + ","
    + _FIRST
    + """
SELECT q.flight_key, q.pe_event, q.new_ptd_ms AS ptd_ms, q.new_pta_ms AS pta_ms, r.resource_type, r.resource_key,
       r.ready_ms AS resource_ready_ms
FROM proj q LEFT JOIN first_res r ON r.flight_key = q.flight_key""",
    "quarantine": with_(EVENTS)
    + """
SELECT * FROM (
  SELECT chain_id, event_type, CASE WHEN chain_id % 19 = 0 THEN 'no flight key' WHEN chain_id % 29 = 0 THEN 'no source time'
    WHEN chain_id % 23 = 0 AND event_type NOT IN ('DEP_DLY_EVENT', 'ARR_DLY_EVENT', 'GROUND_TIME_CHANGE', 'EQUIP_PREVLEG_CHANGE', 'CANCEL')
    THEN 'value is no number' END AS error FROM ev)
WHERE error IS NOT NULL""",
}
