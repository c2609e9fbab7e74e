"""Raw events to typed records, from a routing table of event name to fields.

A rule fills an output column for some events; a later rule wins over an earlier
one.  Every output is one CASE expression, so a record type is a single
projection.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyledger.functions.fixed_values import (
    DELAY_TYPES,
    EQUIPMENT_EVENTS,
    FULL_EVENTS,
    NEXT_LEG_EVENTS,
    NO_FLIGHT,
    PLAN_EVENTS,
    PREV_LEG_EVENTS,
    STUB_EVENTS,
    TAXI_EVENTS,
    TIMES_KEY_ONLY,
)
from skyledger.functions.scalars import effective_ms, is_true, leg_key, short_date


@dataclass(frozen=True)
class Rule:
    """Fill `out` with the SQL value for `events` (None: all) where `given` holds.

    A `value` of None only stamps; a `stamp` of None leaves the stamp alone.
    With `present` the rule needs a non-null value.
    """

    out: str
    events: tuple[str, ...] | None
    value: str | None
    stamp: str | None = None
    present: bool = False
    given: str | None = None

    def condition(self) -> str:
        """SQL condition under which the rule applies."""
        parts = []
        if self.events is not None:
            parts.append("_event IN (" + ", ".join(f"'{e}'" for e in self.events) + ")")
        if self.given:
            parts.append(f"({self.given})")
        if self.present:
            parts.append(f"{self.value} IS NOT NULL")
        return " AND ".join(parts) or "TRUE"


def _last_wins(pairs: list[tuple[str, str]]) -> str:
    return "CASE " + " ".join(f"WHEN {cond} THEN {value}" for cond, value in reversed(pairs)) + " END"


def routed(rules: list[Rule]) -> dict[str, str]:
    """SQL text per output column; outputs with a stamp also get `<out>_ts`."""
    outs: dict[str, list[Rule]] = {}
    for rule in rules:
        outs.setdefault(rule.out, []).append(rule)
    columns = {}
    for out, mine in outs.items():
        values = [(r.condition(), r.value) for r in mine if r.value is not None]
        stamps = [(r.condition(), r.stamp) for r in mine if r.stamp is not None]
        if values:
            columns[out] = _last_wins(values)
        if stamps:
            columns[f"{out.removesuffix('_ms')}_ts"] = _last_wins(stamps)
    return columns


def _with_times(raw: DataFrame, as_of_ms: Column) -> DataFrame:
    """Adds the upper-case event and its effective times; a refresh counts two minutes earlier."""
    now = effective_ms(F.col("source_ts_ms"), F.col("hub_ts_ms"), as_of_ms)
    return raw.withColumns({"_event": F.upper("raw_event"), "_now": now}).withColumn(
        "_eff", F.expr("CASE WHEN _event = 'DB' THEN _now - 120000 ELSE _now END")
    )


def times_records(raw: DataFrame, as_of_ms: Column, as_of_date: Column) -> DataFrame:
    """Flight times record of every raw event; plan events owned elsewhere drop out."""
    std_ts, sta_ts = "CASE WHEN times.std IS NOT NULL THEN _now END", "CASE WHEN times.sta IS NOT NULL THEN _now END"

    def full(out: str, value: str) -> Rule:
        return Rule(out, FULL_EVENTS, value, "_eff", present=True)

    def always(out: str, events: tuple[str, ...], value: str | None) -> Rule:
        return Rule(out, events, value, "_eff")

    rules = [
        Rule("std_ms", None, "times.std", "_now", present=True),
        Rule("sta_ms", None, "times.sta", "_now", present=True),
        Rule("ltd_ms", None, "times.ltd", "_now", present=True),
        Rule("lta_ms", None, "times.lta", "_now", present=True),
        always("ltd_ms", ("OFF",), "times.actual_out"),
        Rule("ltd_ms", ("SKDCHNG",), "times.std", std_ts, given="_future"),
        Rule("lta_ms", ("SKDCHNG",), "times.sta", sta_ts, given="_future"),
        Rule("ltd_ms", ("CONTINUATION",), "times.std", std_ts),
        Rule("lta_ms", ("CONTINUATION",), "times.sta", sta_ts),
        full("pta_feed_ms", "times.pta"),
        always("pta_feed_ms", ("DCSN", "ETD", "EON", "ETO", "ETA", "OFF", "ON", "OUT", "OVR", *STUB_EVENTS), "times.pta"),
        Rule("pta_feed_ms", ("CONTINUATION",), "times.sta", sta_ts),
        Rule("pta_feed_ms", ("CONTINUATION",), "times.pta", "_eff", present=True),
        full("ptd_feed_ms", "times.ptd"),
        always("ptd_feed_ms", ("DCSN", "ETD", "OUT", *STUB_EVENTS), "times.ptd"),
        Rule("ptd_feed_ms", ("CONTINUATION",), "times.std", std_ts),
        Rule("ptd_feed_ms", ("CONTINUATION",), "times.ptd", "_eff", present=True),
        full("eon_ms", "times.eon"),
        always("eon_ms", ("EON", "ETO"), "times.eon"),
        Rule("eon_ms", ("OVR",), "times.eon", "_eff", present=True),
        full("eto_ms", "times.eto"),
        always("eto_ms", ("ETO",), "times.eto"),
        full("on_ms", "times.actual_on"),
        always("on_ms", ("IN", "ON"), "times.actual_on"),
        always("on_ms", ("UNFLY",), None),
        full("in_ms", "times.actual_in"),
        always("in_ms", ("IN", "RTD"), "times.actual_in"),
        always("in_ms", ("UNFLY",), None),
        full("off_ms", "times.actual_off"),
        always("off_ms", ("OFF",), "times.actual_off"),
        always("off_ms", ("UNFLY",), None),
        full("out_ms", "times.actual_out"),
        always("out_ms", ("OFF", "OUT", "RTD"), "times.actual_out"),
        always("out_ms", ("UNFLY",), None),
        full("ogt_min", "times.ogt_min"),
        always(
            "ogt_min",
            ("EQLINK", "GROUNDTIME", "EQSUB", "STUB", "UNSTUB", "UNSTUBSTA", "REINSTATE", "XPE", "CONTINUATION"),
            "times.ogt_min",
        ),
        full("pred_taxi_in_min", "_taxi_in DIV 60"),
        Rule("pred_taxi_in_min", TAXI_EVENTS, "_taxi_in DIV 60", "_eff", present=True),
        Rule("pred_taxi_in_min", ("RETURN",), "times.ogt_min", "_eff", present=True),
        full("pred_taxi_out_min", "_taxi_out DIV 60"),
        Rule("pred_taxi_out_min", TAXI_EVENTS, "_taxi_out DIV 60", "_eff", present=True),
        Rule("taxi_in_s", TAXI_EVENTS, "_taxi_in", "_eff", present=True),
        Rule("taxi_in_s", ("IN",), "(times.actual_in - times.actual_on) DIV 1000", "_eff", present=True),
        Rule("taxi_out_s", TAXI_EVENTS, "_taxi_out", "_eff", present=True),
        Rule("taxi_out_s", ("OFF",), "(times.actual_off - times.actual_out) DIV 1000", "_eff", present=True),
        Rule(
            "arr_station",
            ("CREATE", "CYCLE", "DB", "DIVERSION", "REINSTATE", "RETURN", "RTD", "CONTINUATION"),
            "stations.arr",
        ),
        Rule("orig_arr_station", ("DB",), "stations.original_arr"),
        Rule("dep_gmt_min", None, "times.dep_gmt_min"),
        Rule("arr_gmt_min", None, "times.arr_gmt_min"),
        Rule("dep_delay_min", None, "(times.ltd - times.std) DIV 60000"),
        Rule("arr_delay_min", None, "(times.lta - times.sta) DIV 60000"),
        always("door_close_ms", ("DCS",), "times.door_close"),
        Rule("pax_close_ms", ("DCS",), "times.pax_close"),
        Rule("is_oa_flight", FULL_EVENTS, "FALSE"),
    ]
    core = ("std", "sta", "ltd", "lta")
    columns = []
    for out, text in routed(rules).items():
        gate = "times IS NOT NULL" if out.removesuffix("_ms").removesuffix("_ts") in core else "_live"
        columns.append(F.expr(f"CASE WHEN {gate} THEN {text} END").alias(out))
    known = F.col("times").isNotNull()
    prepared = _with_times(raw, as_of_ms).withColumns(
        {
            "_future": F.to_date("flight_date") > as_of_date,
            "_live": known & ~F.col("_event").isin(*TIMES_KEY_ONLY),
            "_taxi_in": F.expr("coalesce(times.latest_taxi_in_s, times.skd_taxi_in_s)"),
            "_taxi_out": F.expr("coalesce(times.latest_taxi_out_s, times.skd_taxi_out_s)"),
        }
    )
    owned = F.col("_event").isin(*PLAN_EVENTS) & is_true(F.col("flt_keys_owns")) & known
    return prepared.filter(~owned).select(
        "flight_key", "event_id", F.col("_event").alias("event"), "source_ts_ms", *columns
    )


def status_records(raw: DataFrame, as_of_ms: Column) -> DataFrame:
    """Flight status record of every raw event.

    Events that no rule names (STATUS_KEY_ONLY) give the keys alone.
    """
    leg, dep, arr = "status.leg", "status.dep", "status.arr"
    has_status, has_leg, has_type = "status IS NOT NULL", "status.leg IS NOT NULL", "type IS NOT NULL"
    release, stub = "type.flt_rel_status", "type.stub_flt_num"
    code, text = "reason.code", "reason.information"

    def held(out: str, events: tuple[str, ...], value: str) -> Rule:
        return Rule(out, events, value, "_eff", given=has_status)

    def present(out: str, events: tuple[str, ...], value: str, given: str | None = None) -> Rule:
        return Rule(out, events, value, "_eff", present=True, given=given)

    all_three = ("CANCEL", "DCSN", "DELETE", "DIVERSION")
    rules = [
        held("leg_status", (*all_three, "CONTINUATION", "UNFLY", *STUB_EVENTS), leg),
        present("leg_status", (*FULL_EVENTS, "REINSTATE", "RETURN", "RTD"), leg),
        present("leg_status", ("FPUPDT",), leg, "_mine"),
        held("arr_status", (*all_three, "CONTINUATION", "EON", "ETA", "ETD", "ETO", "OFF", "OUT", *STUB_EVENTS), arr),
        present("arr_status", (*FULL_EVENTS, "IN", "ON", "OVR", "UNFLY"), arr),
        present("arr_status", PLAN_EVENTS, arr, "_mine"),
        Rule("arr_status", ("REINSTATE", "RETURN", "RTD"), arr, "_eff", given=has_leg),
        held("dep_status", (*all_three, "ETD", "ETO", "OFF", "OUT", "UNFLY", *STUB_EVENTS), dep),
        present("dep_status", (*FULL_EVENTS, "CONTINUATION"), dep),
        present("dep_status", PLAN_EVENTS, dep, "_mine"),
        Rule("dep_status", ("OVR",), "'OFF'", "_eff"),
        Rule("dep_status", ("REINSTATE", "RTD"), dep, "_eff", given=has_leg),
        present("release_status", (*FULL_EVENTS, "DCSN", "ETD", "ETO", "OFF", "OUT", "LOADPLAN"), release),
        present("release_status", PLAN_EVENTS, release, "_mine"),
        Rule("release_status", STUB_EVENTS, release, "_eff", given=has_type),
        Rule("release_status", ("XPE",), release, "_eff"),
        present("stub_number", (*FULL_EVENTS, "ETD", "LOADPLAN"), stub),
        Rule("stub_number", ("REINSTATE",), stub, "_eff"),
        Rule("stub_number", STUB_EVENTS, stub, "_eff", given=has_type),
        Rule("cancelled_code", ("CANCEL",), code),
        Rule("cancelled_reason", ("CANCEL",), text),
        Rule("reason_code", ("CANCEL", "DB", "DELETE", "DIVERSION", "RETURN"), code),
        Rule("reason_text", ("CANCEL", "DB", "DELETE", "DIVERSION", "RETURN", "M58"), text),
        Rule("delay_reason", FULL_EVENTS, text),
        present("delay_reason", ("DCSN", "ETD"), text),
        Rule("release_count", PLAN_EVENTS, "plan_release_count", given="_mine"),
        Rule("arr_station", ("CREATE", "CYCLE", "DB", "DIVERSION", "RETURN", "RTD"), "stations.arr"),
        Rule("arr_station", ("CONTINUATION",), "stations.arr", given=has_status),
    ]
    prepared = _with_times(raw, as_of_ms).withColumn("_mine", ~is_true(F.col("flt_keys_owns")))
    return prepared.select(
        "flight_key",
        "event_id",
        F.col("_event").alias("event"),
        "source_ts_ms",
        F.col("_eff").alias("effective_ms"),
        *[F.expr(x).alias(n) for n, x in routed(rules).items()],
    )


def equipment_records(raw: DataFrame) -> DataFrame:
    """Flight equipment record of the events that carry equipment; stamps are source times."""
    now = "source_ts_ms"
    has_equipment, has_linkage = "equipment IS NOT NULL", "linkage IS NOT NULL"
    next_dup, prior_dup = "try_cast(linkage.next_dup AS BIGINT)", "try_cast(linkage.prior_dup AS BIGINT)"
    typed = ("CONTINUATION", "EQLINK", "EQSUB", "REINSTATE", "RTD", "XPE", *STUB_EVENTS)
    from_prior = f"_came_from AND {has_linkage}"

    def present(out: str, events: tuple[str, ...] | None, value: str, given: str | None = None) -> Rule:
        return Rule(out, events, value, now, present=True, given=given)

    rules = [
        present("tail", None, "equipment.tail"),
        Rule("created_without_tail", FULL_EVENTS, "TRUE", given=f"{has_equipment} AND equipment.tail IS NULL"),
        present("assigned_code", (*FULL_EVENTS, "CONTINUATION"), "equipment.sas_code"),
        present("scheduled_code", FULL_EVENTS, "equipment.skd_type"),
        Rule("scheduled_code", ("RTD",), "equipment.skd_type", now),
        Rule("scheduled_code", ("REINSTATE",), None, now),
        present("assigned_type", FULL_EVENTS, "equipment.assigned_type"),
        Rule("assigned_type", typed, "equipment.assigned_type", now, given=has_equipment),
        present("registration", (*FULL_EVENTS, "EQLINK", "EQSUB"), "trim(equipment.registration)"),
        Rule("clear_next", (*FULL_EVENTS, *NEXT_LEG_EVENTS), "TRUE", now, given="NOT _goes_on"),
        Rule("next_leg_key", (*FULL_EVENTS, *NEXT_LEG_EVENTS), "_next_key", given="_goes_on"),
        Rule("next_leg", FULL_EVENTS, None, now, given=has_linkage),
        Rule("next_leg", NEXT_LEG_EVENTS, None, now),
        present("next_number", FULL_EVENTS, "linkage.next_num"),
        Rule("next_number", NEXT_LEG_EVENTS, "linkage.next_num", now, given="_goes_on"),
        Rule("next_date", FULL_EVENTS, "_next_day"),
        Rule("next_date", NEXT_LEG_EVENTS, "_next_day", given="_goes_on"),
        Rule("next_dup", FULL_EVENTS, next_dup),
        Rule("next_dup", NEXT_LEG_EVENTS, next_dup, given="_goes_on"),
        Rule("clear_prior", (*FULL_EVENTS, *PREV_LEG_EVENTS), "TRUE", now, given="NOT _came_from"),
        Rule("prev_leg", FULL_EVENTS, None, now, given=has_linkage),
        Rule("prev_leg", PREV_LEG_EVENTS, None, now),
        present("prev_date", FULL_EVENTS, "_prior_day"),
        Rule("prev_date", PREV_LEG_EVENTS, "_prior_day", now, given=from_prior),
        present("prev_date", ("RTD",), "_prior_day"),
        present("prev_number", FULL_EVENTS, "linkage.prior_num", "_came_from"),
        Rule("prev_number", PREV_LEG_EVENTS, "linkage.prior_num", now, given=from_prior),
        Rule("prev_number", ("RTD",), "linkage.prior_num", now, given="_prior_day IS NOT NULL"),
        present("prev_dup", FULL_EVENTS, prior_dup),
        Rule("prev_dup", PREV_LEG_EVENTS, prior_dup, now, given=from_prior),
        Rule("prev_dup", ("RTD",), prior_dup, now, given="_prior_day IS NOT NULL"),
        Rule("anti_ice", (*FULL_EVENTS, "EQSUB"), "lower(type.anti_ice) = 'true'"),
        Rule("anti_ice", ("LOADPLAN",), "performance.anti_ice"),
        Rule("tail_on_plan", ("FLTPLN", "LOADPLAN"), "equipment.tail"),
        Rule("arr_station", (*FULL_EVENTS, "CONTINUATION", "DIVERSION"), "stations.arr"),
    ]
    link = lambda name: F.col(f"linkage.{name}")
    prepared = (
        raw.withColumn("_event", F.upper("raw_event"))
        .filter(F.col("_event").isin(*EQUIPMENT_EVENTS))
        .withColumns(
            {
                "_goes_on": F.coalesce(link("next_num") != NO_FLIGHT, F.lit(True)),
                "_came_from": F.coalesce(link("prior_num") != NO_FLIGHT, F.lit(True)),
                "_next_day": short_date(link("next_date")),
                "_prior_day": short_date(link("prior_date")),
            }
        )
        .withColumn(
            "_next_key",
            leg_key(F.col("airline"), link("next_num"), F.col("_next_day"), F.col("stations.arr"), link("next_dup")),
        )
    )
    return prepared.select(
        "flight_key",
        "event_id",
        F.col("_event").alias("event"),
        "source_ts_ms",
        *[F.expr(x).alias(n) for n, x in routed(rules).items()],
    )


def delay_event_records(events: DataFrame) -> DataFrame:
    """Delay events with the three consumed fields and the stream type.

    Only the consumed types and cancel pass; a value that is no number is kept
    as text and shows as a null `value_ms`.
    """
    return events.filter(F.col("event_type").isin(*DELAY_TYPES)).select(
        "flight_key",
        "event_type",
        "value",
        F.expr("try_cast(value as bigint)").alias("value_ms"),
        F.lit("DELAY").alias("stream_type"),
    )


def cancel_records(status: DataFrame) -> DataFrame:
    """Cancel events with the flattened attributes; absent parts become empty."""
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    return status.select(
        "flight_key",
        "event_id",
        blank("airline").alias("airline_code"),
        blank("flight_date").alias("flight_date"),
        blank("dep_station").alias("departure_station"),
        blank("flight_number").alias("flight_number"),
        F.coalesce("dup_code", F.lit(0)).alias("dup_dep_code"),
        F.lit("CANCEL").alias("event_type"),
        blank("leg_status").alias("new_value"),
        blank("previous_leg_status").alias("previous_value"),
        F.lit(False).alias("is_problem"),
    )
