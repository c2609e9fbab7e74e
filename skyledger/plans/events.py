"""Routing of raw events and change detection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyledger.functions.fixed_values import EQUIPMENT_CHANGES, STATUS_CHANGES, TIMES_CHANGES
from skyledger.operators import diff, routing
from skyledger.plans.relations_sql import EVENTS, with_
from skyledger.sources import documents
from skyledger.sources.flights import delay_events
from skyledger.sources.raw_events import GROUPS, raw_events, raw_sql
from skyledger.sources.tables import table

# "Now" of the registered queries, so that they repeat: 2024-01-15 00:00 UTC.
AS_OF_MS = 1_705_276_800_000
AS_OF_DATE = "2024-01-15"


def times_of(raw: DataFrame) -> DataFrame:
    return routing.times_records(raw, F.lit(AS_OF_MS), F.to_date(F.lit(AS_OF_DATE)))


def status_of(raw: DataFrame) -> DataFrame:
    return routing.status_records(raw, F.lit(AS_OF_MS))


def equipment_of(raw: DataFrame) -> DataFrame:
    records = routing.equipment_records(raw)
    return records.withColumn("prev_leg", F.concat("prev_number", F.lit("/"), "prev_date"))


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_events(table(spark, sf_dir, "events"))


def times_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return times_of(_raw(spark, sf_dir))


def status_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return status_of(_raw(spark, sf_dir))


def equipment_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.equipment_records(_raw(spark, sf_dir))


def delay_event_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = delay_events(spark, sf_dir).withColumn("flight_key", F.concat_ws("-", "chain_id", "event_seq"))
    return routing.delay_event_records(events)


def cancel_event_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cancel events of all cancelled records, with the leg status before each."""
    raw = _raw(spark, sf_dir)
    status = raw.select(
        "flight_key",
        "event_id",
        "source_ts_ms",
        "airline",
        "flight_number",
        "flight_date",
        "dep_station",
        F.expr("try_cast(linkage.next_dup as bigint)").alias("dup_code"),
        F.col("status.leg").alias("leg_status"),
        F.col("status.dep").alias("dep_status"),
    )
    kept = diff.accepted(diff.in_arrival_order(status))
    paired = kept.on(kept.df.withColumn("_me", F.struct("leg_status"))).scan(diff.previous("_me", "_old"))
    cancels = paired.rows().filter(diff.cancel_item().isNotNull())
    return routing.cancel_records(cancels.withColumn("previous_leg_status", F.col("_old.leg_status")))


def times_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.atomic_events(times_routing(spark, sf_dir), TIMES_CHANGES)


def status_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.atomic_events(status_routing(spark, sf_dir), STATUS_CHANGES, with_cancel=True)


def equipment_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.atomic_events(equipment_of(_raw(spark, sf_dir)), EQUIPMENT_CHANGES)


def late_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records that pass the source-time guard."""
    slim = _raw(spark, sf_dir).select("flight_key", "event_id", "source_ts_ms")
    return diff.accepted(diff.in_arrival_order(slim)).rows()


def record_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per flight: records, distinct records by value and by hash, and repeats of the one before.

    Two records are equal in flight key, payload, arrival station and previous leg; the payload
    is the event's name and all groups of its document.
    """
    raw = _raw(spark, sf_dir)
    prior = F.concat_ws("/", "linkage.prior_num", "linkage.prior_date")
    slim = raw.select(
        "flight_key", "event_id", "source_ts_ms", F.struct(F.upper("raw_event").alias("name"), *GROUPS).alias("payload"),
        F.col("stations.arr").alias("arrival"), F.when(F.col("linkage").isNotNull(), prior).alias("previous"),
    )
    value = F.struct("flight_key", "payload", "arrival", "previous")
    rows = diff.in_arrival_order(slim.withColumn("_value", value)).scan(diff.previous("_value", "_old")).rows()
    return rows.groupBy("flight_key").agg(
        F.count(F.lit(1)).alias("records"),
        F.countDistinct("_value").alias("distinct_records"),
        F.countDistinct(F.xxhash64("flight_key", "payload", "arrival", "previous")).alias("distinct_hashes"),
        F.count_if(F.col("_value").eqNullSafe(F.col("_old"))).alias("repeats"),
    )


def event_disposition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every raw event once: accepted, late or quarantined."""
    return diff.disposition(_raw(spark, sf_dir))


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feed as documents, parsed; spread over tasks, because a file may be one scan task and parsing is the work."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    raw = raw_events(table(spark, sf_dir, "events").repartition(parts))
    return documents.parsed(documents.written(raw), raw.schema)


def document_disposition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event document once: accepted or the reason why it is kept apart."""
    rows = _documents(spark, sf_dir)
    return rows.select("event_id", F.coalesce("error", F.lit("accepted")).alias("disposition"))


def document_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status records routed from nested documents; broken ones change nothing."""
    return status_of(documents.accepted(_documents(spark, sf_dir)))


QUERIES = {
    "document_disposition": document_disposition,
    "document_routing": document_routing,
    "times_routing": times_routing,
    "status_routing": status_routing,
    "equipment_routing": equipment_routing,
    "delay_event_normalise": delay_event_normalise,
    "cancel_event_record": cancel_event_record,
    "times_diff": times_diff,
    "status_diff": status_diff,
    "equipment_diff": equipment_diff,
    "late_guard": late_guard,
    "record_equality": record_equality,
    "event_disposition": event_disposition,
}


def _in(names: str) -> str:
    return "ev IN (" + ", ".join(f"'{n}'" for n in names.split()) + ")"


_FULL = "CREATE CYCLE DB"
_STUB = "STUB UNSTUB STUBSTA UNSTUBSTA"
_TAXI = "DCSN ETD DIVERSION EON ETO ETA IN OFF ON OUT REINSTATE XPE STUBSTA UNSTUBSTA UNFLY"
_NEXT = "CONTINUATION DIVERSION EQLINK EQSUB RETURN REINSTATE RTD"
_PREV = f"CONTINUATION EQLINK EQSUB REINSTATE XPE {_STUB}"
_PTA = f"DCSN ETD EON ETO ETA OFF ON OUT OVR {_STUB}"
_PTD = f"DCSN ETD OUT {_STUB}"
_OGT = "EQLINK GROUNDTIME EQSUB STUB UNSTUB UNSTUBSTA REINSTATE XPE CONTINUATION"

_BASE = f"""
base AS (
  SELECT *, upper(raw_event) AS ev, coalesce(source_ts_ms, hub_ts_ms, {AS_OF_MS}) AS now_ms,
         coalesce(source_ts_ms, hub_ts_ms, {AS_OF_MS}) - CASE WHEN upper(raw_event) = 'DB' THEN 120000 ELSE 0 END AS eff,
         coalesce(lower(flt_keys_owns) = 'true', false) AS owned
  FROM raw)"""


def _filled(out: str, source: str, full: bool, always: str, present: str = "", stamp_only: str = "") -> str:
    """Value and stamp: on full events if present, on `always` events in any case."""
    value, stamp = [], []
    if full:
        value.append(f"WHEN {_in(_FULL)} THEN {source}")
        stamp.append(f"WHEN {_in(_FULL)} AND {source} IS NOT NULL THEN eff")
    if always:
        value.append(f"WHEN {_in(always)} THEN {source}")
        stamp.append(f"WHEN {_in(always)} THEN eff")
    if present:
        value.append(f"WHEN {_in(present)} THEN {source}")
        stamp.append(f"WHEN {_in(present)} AND {source} IS NOT NULL THEN eff")
    if stamp_only:
        stamp.append(f"WHEN {_in(stamp_only)} THEN eff")
    stem = out.removesuffix("_ms")
    return f"CASE {' '.join(value)} END AS {out}, CASE {' '.join(stamp)} END AS {stem}_ts"


_TIMES = f"""
tin AS (
  SELECT *, coalesce(times_latest_taxi_in_s, times_skd_taxi_in_s) AS tin_s,
         coalesce(times_latest_taxi_out_s, times_skd_taxi_out_s) AS tout_s,
         CASE WHEN times_std IS NOT NULL THEN now_ms END AS std_at,
         CASE WHEN times_sta IS NOT NULL THEN now_ms END AS sta_at,
         has_times AND ev NOT IN ('CANCEL', 'DELETE', 'DESK', 'FUEL', 'GATE', 'LOADPLAN', 'LOCK', 'PSGRLOAD', 'UNLOCK',
           'UNKNOWN', 'SIGNFLTPLAN', 'M58', 'CREW') AS live,
         ev = 'SKDCHNG' AND flight_date > '{AS_OF_DATE}' AS shifts
  FROM base
  WHERE NOT (has_times AND owned AND ev IN ('FLTPLN', 'FPUPDT'))),
livetimes AS (
  SELECT event_id,
    {_filled("eon_ms", "times_eon", True, "EON ETO", "OVR")},
    {_filled("eto_ms", "times_eto", True, "ETO")},
    {_filled("on_ms", "times_actual_on", True, "IN ON", "", "UNFLY")},
    {_filled("in_ms", "times_actual_in", True, "IN RTD", "", "UNFLY")},
    {_filled("off_ms", "times_actual_off", True, "OFF", "", "UNFLY")},
    {_filled("out_ms", "times_actual_out", True, "OFF OUT RTD", "", "UNFLY")},
    {_filled("ogt_min", "times_ogt_min", True, _OGT)},
    {_filled("door_close_ms", "times_door_close", False, "DCS")},
    CASE WHEN ev = 'CONTINUATION' THEN coalesce(times_pta, times_sta) WHEN {_in(_FULL + " " + _PTA)} THEN times_pta END AS pta_feed_ms,
    CASE WHEN ev = 'CONTINUATION' THEN CASE WHEN times_pta IS NOT NULL THEN eff ELSE sta_at END
         WHEN {_in(_PTA)} THEN eff WHEN {_in(_FULL)} AND times_pta IS NOT NULL THEN eff END AS pta_feed_ts,
    CASE WHEN ev = 'CONTINUATION' THEN coalesce(times_ptd, times_std) WHEN {_in(_FULL + " " + _PTD)} THEN times_ptd END AS ptd_feed_ms,
    CASE WHEN ev = 'CONTINUATION' THEN CASE WHEN times_ptd IS NOT NULL THEN eff ELSE std_at END
         WHEN {_in(_PTD)} THEN eff WHEN {_in(_FULL)} AND times_ptd IS NOT NULL THEN eff END AS ptd_feed_ts,
    CASE WHEN {_in(_FULL + " " + _TAXI)} THEN tin_s // 60 WHEN ev = 'RETURN' THEN times_ogt_min END AS pred_taxi_in_min,
    CASE WHEN {_in(_FULL + " " + _TAXI)} AND tin_s IS NOT NULL THEN eff
         WHEN ev = 'RETURN' AND times_ogt_min IS NOT NULL THEN eff END AS pred_taxi_in_min_ts,
    CASE WHEN {_in(_FULL + " " + _TAXI)} THEN tout_s // 60 END AS pred_taxi_out_min,
    CASE WHEN {_in(_FULL + " " + _TAXI)} AND tout_s IS NOT NULL THEN eff END AS pred_taxi_out_min_ts,
    CASE WHEN ev = 'IN' THEN coalesce((times_actual_in - times_actual_on) // 1000, tin_s) WHEN {_in(_TAXI)} THEN tin_s END AS taxi_in_s,
    CASE WHEN {_in(_TAXI)} AND (tin_s IS NOT NULL OR (ev = 'IN' AND times_actual_in IS NOT NULL AND times_actual_on IS NOT NULL))
         THEN eff END AS taxi_in_s_ts,
    CASE WHEN ev = 'OFF' THEN coalesce((times_actual_off - times_actual_out) // 1000, tout_s) WHEN {_in(_TAXI)} THEN tout_s END AS taxi_out_s,
    CASE WHEN {_in(_TAXI)} AND (tout_s IS NOT NULL OR (ev = 'OFF' AND times_actual_off IS NOT NULL AND times_actual_out IS NOT NULL))
         THEN eff END AS taxi_out_s_ts,
    CASE WHEN {_in("CREATE CYCLE DB DIVERSION REINSTATE RETURN RTD CONTINUATION")} THEN stations_arr END AS arr_station,
    CASE WHEN ev = 'DB' THEN stations_original_arr END AS orig_arr_station,
    times_dep_gmt_min AS dep_gmt_min, times_arr_gmt_min AS arr_gmt_min,
    (times_ltd - times_std) // 60000 AS dep_delay_min, (times_lta - times_sta) // 60000 AS arr_delay_min,
    CASE WHEN ev = 'DCS' THEN times_pax_close END AS pax_close_ms,
    CASE WHEN {_in(_FULL)} THEN false END AS is_oa_flight
  FROM tin WHERE live),
times_rec AS (
  SELECT t.flight_key, t.event_id, t.ev AS event, t.source_ts_ms,
    times_std AS std_ms, std_at AS std_ts, times_sta AS sta_ms, sta_at AS sta_ts,
    CASE WHEN ev = 'OFF' THEN times_actual_out WHEN ev = 'CONTINUATION' OR shifts THEN times_std ELSE times_ltd END AS ltd_ms,
    CASE WHEN ev = 'OFF' AND has_times THEN eff WHEN ev = 'CONTINUATION' OR shifts THEN std_at
         WHEN times_ltd IS NOT NULL THEN now_ms END AS ltd_ts,
    CASE WHEN ev = 'CONTINUATION' OR shifts THEN times_sta ELSE times_lta END AS lta_ms,
    CASE WHEN ev = 'CONTINUATION' OR shifts THEN sta_at WHEN times_lta IS NOT NULL THEN now_ms END AS lta_ts,
    v.* EXCLUDE (event_id)
  FROM tin t LEFT JOIN livetimes v ON v.event_id = t.event_id)"""


def _status_col(out: str, source: str, held: str, present: str, mine: str = "", if_leg: str = "") -> str:
    value = [f"WHEN {_in(held + ' ' + present)} THEN {source}"]
    stamp = [f"WHEN {_in(held)} AND has_status THEN eff", f"WHEN {_in(present)} AND {source} IS NOT NULL THEN eff"]
    if mine:
        value.append(f"WHEN {_in(mine)} AND NOT owned THEN {source}")
        stamp.append(f"WHEN {_in(mine)} AND NOT owned AND {source} IS NOT NULL THEN eff")
    if if_leg:
        value.append(f"WHEN {_in(if_leg)} AND status_leg IS NOT NULL THEN {source}")
        stamp.append(f"WHEN {_in(if_leg)} AND status_leg IS NOT NULL THEN eff")
    return f"CASE {' '.join(value)} END AS {out}, CASE {' '.join(stamp)} END AS {out}_ts"


_STATUS = f"""
status_rec AS (
  SELECT * EXCLUDE (d0, dt0),
    CASE WHEN event = 'OVR' THEN 'OFF' ELSE d0 END AS dep_status,
    CASE WHEN event = 'OVR' THEN effective_ms ELSE dt0 END AS dep_status_ts
  FROM (SELECT flight_key, event_id, ev AS event, source_ts_ms, eff AS effective_ms,
    {_status_col("leg_status", "status_leg", "CANCEL DCSN DELETE DIVERSION CONTINUATION UNFLY " + _STUB,
                 _FULL + " REINSTATE RETURN RTD", "FPUPDT")},
    {_status_col("arr_status", "status_arr", "CANCEL DCSN DELETE DIVERSION CONTINUATION EON ETA ETD ETO OFF OUT " + _STUB,
                 _FULL + " IN ON OVR UNFLY", "FLTPLN FPUPDT", "REINSTATE RETURN RTD")},
    {_status_col("d0", "status_dep", "CANCEL DCSN DELETE DIVERSION ETD ETO OFF OUT UNFLY " + _STUB,
                 _FULL + " CONTINUATION", "FLTPLN FPUPDT", "REINSTATE RTD").replace("d0_ts", "dt0")},
    CASE WHEN {_in(_FULL + " DCSN ETD ETO OFF OUT LOADPLAN XPE " + _STUB)} OR ({_in("FLTPLN FPUPDT")} AND NOT owned)
         THEN type_flt_rel_status END AS release_status,
    CASE WHEN ev = 'XPE' OR ({_in(_STUB)} AND has_type) THEN eff
         WHEN type_flt_rel_status IS NOT NULL AND ({_in(_FULL + " DCSN ETD ETO OFF OUT LOADPLAN")}
              OR ({_in("FLTPLN FPUPDT")} AND NOT owned)) THEN eff END AS release_status_ts,
    CASE WHEN {_in(_FULL + " ETD LOADPLAN REINSTATE " + _STUB)} THEN type_stub_flt_num END AS stub_number,
    CASE WHEN ev = 'REINSTATE' OR ({_in(_STUB)} AND has_type) THEN eff
         WHEN {_in(_FULL + " ETD LOADPLAN")} AND type_stub_flt_num IS NOT NULL THEN eff END AS stub_number_ts,
    CASE WHEN ev = 'CANCEL' THEN reason_code END AS cancelled_code,
    CASE WHEN ev = 'CANCEL' THEN reason_information END AS cancelled_reason,
    CASE WHEN {_in("CANCEL DB DELETE DIVERSION RETURN")} THEN reason_code END AS reason_code,
    CASE WHEN {_in("CANCEL DB DELETE DIVERSION RETURN M58")} THEN reason_information END AS reason_text,
    CASE WHEN {_in(_FULL + " DCSN ETD")} THEN reason_information END AS delay_reason,
    CASE WHEN {_in("DCSN ETD")} AND reason_information IS NOT NULL THEN eff END AS delay_reason_ts,
    CASE WHEN {_in("FLTPLN FPUPDT")} AND NOT owned THEN plan_release_count END AS release_count,
    CASE WHEN {_in("CREATE CYCLE DB DIVERSION RETURN RTD")} OR (ev = 'CONTINUATION' AND has_status) THEN stations_arr END AS arr_station
  FROM base))"""

_EQUIPMENT = f"""
link AS (
  SELECT *, strftime(CAST(linkage_next_date AS DATE), '%d') || upper(strftime(CAST(linkage_next_date AS DATE), '%b%y')) AS next_day,
         strftime(CAST(linkage_prior_date AS DATE), '%d') || upper(strftime(CAST(linkage_prior_date AS DATE), '%b%y')) AS prior_day,
         coalesce(linkage_next_num <> '0000', true) AS goes_on, coalesce(linkage_prior_num <> '0000', true) AS came_from,
         {_in(_FULL)} AS f, {_in(_NEXT)} AS n, {_in(_PREV)} AS p
  FROM base
  WHERE {_in(_FULL + " CONTINUATION DIVERSION EQLINK EQSUB FLTPLN RETURN REINSTATE RTD XPE LOADPLAN " + _STUB)}),
equipment_rec AS (
  SELECT flight_key, event_id, ev AS event, source_ts_ms,
    equipment_tail AS tail, CASE WHEN equipment_tail IS NOT NULL THEN source_ts_ms END AS tail_ts,
    CASE WHEN f AND has_equipment AND equipment_tail IS NULL THEN true END AS created_without_tail,
    CASE WHEN f OR ev = 'CONTINUATION' THEN equipment_sas_code END AS assigned_code,
    CASE WHEN (f OR ev = 'CONTINUATION') AND equipment_sas_code IS NOT NULL THEN source_ts_ms END AS assigned_code_ts,
    CASE WHEN f OR ev = 'RTD' THEN equipment_skd_type END AS scheduled_code,
    CASE WHEN ev IN ('RTD', 'REINSTATE') OR (f AND equipment_skd_type IS NOT NULL) THEN source_ts_ms END AS scheduled_code_ts,
    CASE WHEN f OR {_in("CONTINUATION EQLINK EQSUB REINSTATE RTD XPE " + _STUB)} THEN equipment_assigned_type END AS assigned_type,
    CASE WHEN (f AND equipment_assigned_type IS NOT NULL)
           OR ({_in("CONTINUATION EQLINK EQSUB REINSTATE RTD XPE " + _STUB)} AND has_equipment) THEN source_ts_ms END AS assigned_type_ts,
    CASE WHEN f OR {_in("EQLINK EQSUB")} THEN trim(equipment_registration) END AS registration,
    CASE WHEN (f OR {_in("EQLINK EQSUB")}) AND equipment_registration IS NOT NULL THEN source_ts_ms END AS registration_ts,
    CASE WHEN (f OR n) AND linkage_next_num = '0000' THEN true END AS clear_next,
    CASE WHEN (f OR n) AND linkage_next_num = '0000' THEN source_ts_ms END AS clear_next_ts,
    CASE WHEN (f OR n) AND goes_on THEN airline || linkage_next_num || next_day || stations_arr
         || coalesce(linkage_next_dup, '0') || '0' END AS next_leg_key,
    CASE WHEN n OR (f AND has_linkage) THEN source_ts_ms END AS next_leg_ts,
    CASE WHEN f OR (n AND goes_on) THEN linkage_next_num END AS next_number,
    CASE WHEN (n AND goes_on) OR (f AND linkage_next_num IS NOT NULL) THEN source_ts_ms END AS next_number_ts,
    CASE WHEN f OR (n AND goes_on) THEN next_day END AS next_date,
    CASE WHEN f OR (n AND goes_on) THEN CAST(linkage_next_dup AS BIGINT) END AS next_dup,
    CASE WHEN (f OR p) AND linkage_prior_num = '0000' THEN true END AS clear_prior,
    CASE WHEN (f OR p) AND linkage_prior_num = '0000' THEN source_ts_ms END AS clear_prior_ts,
    CASE WHEN p OR (f AND has_linkage) THEN source_ts_ms END AS prev_leg_ts,
    CASE WHEN f OR ev = 'RTD' OR (p AND came_from) THEN prior_day END AS prev_date,
    CASE WHEN (p AND came_from AND has_linkage) OR ((f OR ev = 'RTD') AND prior_day IS NOT NULL) THEN source_ts_ms END AS prev_date_ts,
    CASE WHEN (f AND linkage_prior_num <> '0000') OR (p AND came_from) OR (ev = 'RTD' AND prior_day IS NOT NULL)
         THEN linkage_prior_num END AS prev_number,
    CASE WHEN (f AND linkage_prior_num <> '0000') OR (p AND came_from AND has_linkage) OR (ev = 'RTD' AND prior_day IS NOT NULL)
         THEN source_ts_ms END AS prev_number_ts,
    CASE WHEN f OR (p AND came_from) OR (ev = 'RTD' AND prior_day IS NOT NULL) THEN CAST(linkage_prior_dup AS BIGINT) END AS prev_dup,
    CASE WHEN (f AND linkage_prior_dup IS NOT NULL) OR (p AND came_from AND has_linkage)
           OR (ev = 'RTD' AND prior_day IS NOT NULL) THEN source_ts_ms END AS prev_dup_ts,
    CASE WHEN f OR ev = 'EQSUB' THEN lower(type_anti_ice) = 'true' WHEN ev = 'LOADPLAN' THEN performance_anti_ice END AS anti_ice,
    CASE WHEN ev IN ('FLTPLN', 'LOADPLAN') THEN equipment_tail END AS tail_on_plan,
    CASE WHEN f OR ev IN ('CONTINUATION', 'DIVERSION') THEN stations_arr END AS arr_station
  FROM link)"""

_RAW = with_(raw_sql(), _BASE)
_TIMES_WITH = with_(raw_sql(), _BASE, _TIMES)
_STATUS_WITH = with_(raw_sql(), _BASE, _STATUS)
_EQUIPMENT_WITH = with_(raw_sql(), _BASE, _EQUIPMENT)


def _kept(records: str) -> str:
    return f"""
seen AS (
  SELECT *, max(source_ts_ms) OVER (PARTITION BY flight_key ORDER BY event_id
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS latest
  FROM {records} WHERE source_ts_ms IS NOT NULL),
kept AS (SELECT * FROM seen WHERE latest IS NULL OR source_ts_ms > latest)"""


def _diff(records: str, tracked: dict[str, str], extra: str = "", cancel: str = "") -> str:
    parts = []
    for kind, column in tracked.items():
        positive = f" AND {column} > 0" if kind.endswith("_DLY_EVENT") else ""
        parts.append(
            f"SELECT flight_key, event_id, '' AS previous, source_ts_ms, CAST({column} AS VARCHAR) AS value, "
            f"'{kind}' AS event_type FROM pairs WHERE {column} IS NOT NULL AND {column} IS DISTINCT FROM old_{column}{positive}"
        )
    if cancel:
        parts.append(cancel)
    lags = ", ".join(f"lag({c}) OVER w AS old_{c}" for c in dict.fromkeys(tracked.values()))
    return (
        "," + _kept(records)
        + f",\npairs AS (SELECT *, {lags} FROM kept WINDOW w AS (PARTITION BY flight_key ORDER BY event_id))\n"
        + "\nUNION ALL ".join(parts)
    )


ORACLE = {
    "times_routing": _TIMES_WITH + "SELECT * FROM times_rec",
    "status_routing": _STATUS_WITH + "SELECT * FROM status_rec",
    "document_disposition": """
SELECT event_id, CASE WHEN event_id % 61 = 0 OR event_id % 67 = 0 THEN 'not readable' WHEN event_id % 71 = 0 THEN 'no document'
  ELSE 'accepted' END AS disposition FROM events""",
    "document_routing": with_(raw_sql(), _BASE.replace("FROM raw)", "FROM raw WHERE event_id % 61 <> 0 AND event_id % 67 <> 0 AND event_id % 71 <> 0)"), _STATUS)
    + "SELECT * FROM status_rec",
    "equipment_routing": _EQUIPMENT_WITH + "SELECT * FROM equipment_rec",
    "delay_event_normalise": with_(EVENTS)
    + "SELECT chain_id || '-' || event_seq AS flight_key, event_type, CAST(value_ms AS VARCHAR) AS value, value_ms, "
    "'DELAY' AS stream_type FROM ev",
    "cancel_event_record": _RAW
    + ","
    + _kept("base")
    + """
SELECT flight_key, event_id, airline AS airline_code, flight_date, dep_station AS departure_station, flight_number,
       coalesce(CAST(linkage_next_dup AS BIGINT), 0) AS dup_dep_code, 'CANCEL' AS event_type,
       status_leg AS new_value, coalesce(old_leg, '') AS previous_value, false AS is_problem
FROM (SELECT *, lag(status_leg) OVER (PARTITION BY flight_key ORDER BY event_id) AS old_leg FROM kept)
WHERE status_leg IN ('CANCELLED', 'CANCELLED_VIA_XL') AND status_dep IS DISTINCT FROM 'CANCELLED'""",
    "times_diff": _TIMES_WITH + _diff("times_rec", TIMES_CHANGES),
    "status_diff": _STATUS_WITH
    + _diff(
        "status_rec",
        STATUS_CHANGES,
        cancel="SELECT flight_key, event_id, '' AS previous, source_ts_ms, leg_status AS value, 'CANCEL' AS event_type FROM pairs "
        "WHERE leg_status IN ('CANCELLED', 'CANCELLED_VIA_XL') AND dep_status IS DISTINCT FROM 'CANCELLED'",
    ),
    "equipment_diff": _EQUIPMENT_WITH
    + ", eq AS (SELECT *, prev_number || '/' || prev_date AS prev_leg FROM equipment_rec)"
    + _diff("eq", EQUIPMENT_CHANGES),
    "late_guard": _RAW + "," + _kept("base") + "SELECT flight_key, event_id, source_ts_ms FROM kept",
    "record_equality": _RAW
    + f"""
SELECT flight_key, count(*) AS records, count(DISTINCT v) AS distinct_records, count(DISTINCT v) AS distinct_hashes,
       count(*) FILTER (v IS NOT DISTINCT FROM old) AS repeats
FROM (SELECT *, lag(v) OVER (PARTITION BY flight_key ORDER BY event_id) AS old
      FROM (SELECT *, row(ev, {", ".join(f"has_{g}, " + ", ".join(f"{g}_{n}" for n in fields) for g, (_, fields) in GROUPS.items())}) AS v
            FROM base WHERE source_ts_ms IS NOT NULL))
GROUP BY flight_key""",
    "event_disposition": _RAW
    + """
SELECT flight_key, event_id, CASE WHEN source_ts_ms IS NULL THEN 'quarantined'
    WHEN latest IS NULL OR source_ts_ms > latest THEN 'accepted' ELSE 'late' END AS disposition
FROM (SELECT *, max(source_ts_ms) OVER (PARTITION BY flight_key ORDER BY event_id
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS latest FROM base)""",
}
