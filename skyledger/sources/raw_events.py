"""Nested raw flight events derived from the `events` table.

The field formulas are plain SQL text that Spark and the check database both
read; only formatting a day differs between them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyledger.functions.fixed_values import EVENT_NAMES

NAMES = ",".join(EVENT_NAMES)

# Inputs of the formulas: e = event id, u = user, k = props.k, vc = value in
# cents, t = event time in ms, b = the same on the full minute.
TOP = {
    "flight_key": "'F' || u",
    "airline": "'A' || (u % 3)",
    "flight_number": "CAST(u AS STRING)",
    "dep_station": "'S' || (u % 9)",
    "raw_event": f"CASE WHEN e % 7 = 0 THEN lower(split_part('{NAMES}', ',', CAST((e + k) % {len(EVENT_NAMES)} + 1 AS INT))) "
    f"ELSE split_part('{NAMES}', ',', CAST((e + k) % {len(EVENT_NAMES)} + 1 AS INT)) END",
    "source_ts_ms": "CASE WHEN e % 53 = 0 THEN NULL WHEN e % 13 = 0 THEN t - 129600000 ELSE t END",
    "hub_ts_ms": "CASE WHEN e % 59 <> 0 THEN t + 1500 END",
    "flt_keys_owns": "CASE e % 4 WHEN 0 THEN 'true' WHEN 1 THEN 'TRUE' WHEN 2 THEN 'false' END",
    "plan_release_count": "CASE WHEN e % 23 <> 0 THEN k % 5 END",
}
_STD = "b + 7200000 + (k % 5) * 1800000"
_STA = f"{_STD} + (60 + k) * 60000"
GROUPS = {
    "times": ("e % 97 <> 0", {
        "std": f"CASE WHEN e % 11 <> 0 THEN {_STD} END",
        "sta": f"CASE WHEN e % 17 <> 0 THEN {_STA} END",
        "ltd": f"CASE WHEN k % 9 <> 0 THEN {_STD} + (vc % 40) * 60000 END",
        "lta": f"CASE WHEN k % 8 <> 0 THEN {_STA} + (vc % 50 - 10) * 60000 END",
        "pta": f"CASE WHEN k % 7 <> 0 THEN {_STA} + 180000 END",
        "ptd": f"CASE WHEN k % 6 <> 0 THEN {_STD} + 120000 END",
        "eon": f"CASE WHEN vc % 6 <> 0 THEN {_STA} + 60000 END",
        "eto": f"CASE WHEN vc % 5 <> 0 THEN {_STD} + 60000 END",
        "actual_out": f"CASE WHEN vc % 4 <> 0 THEN {_STD} + 240000 END",
        "actual_off": f"CASE WHEN vc % 3 <> 0 THEN {_STD} + 240000 + (9 + k % 7) * 60000 + 30000 END",
        "actual_on": f"CASE WHEN k % 4 <> 0 THEN {_STA} - 300000 END",
        "actual_in": f"CASE WHEN k % 5 <> 0 THEN {_STA} - 300000 + (4 + k % 5) * 60000 END",
        "door_close": f"{_STD} - 600000",
        "pax_close": f"CASE WHEN k % 3 <> 0 THEN {_STD} - 900000 END",
        "ogt_min": "CASE WHEN vc % 9 <> 0 THEN 20 + k END",
        "latest_taxi_in_s": "CASE WHEN k % 3 <> 0 THEN 200 + k * 7 END",
        "skd_taxi_in_s": "CASE WHEN k % 2 <> 0 THEN 300 + k END",
        "latest_taxi_out_s": "CASE WHEN vc % 3 <> 0 THEN 400 + k * 5 END",
        "skd_taxi_out_s": "CASE WHEN vc % 2 <> 0 THEN 500 + k END",
        "dep_gmt_min": "-300 + (k % 4) * 60",
        "arr_gmt_min": "-360 + (k % 5) * 60",
    }),
    "status": ("e % 31 <> 0", {
        "leg": "CASE vc % 5 WHEN 0 THEN 'ACTIVE' WHEN 1 THEN 'CANCELLED' WHEN 2 THEN 'CANCELLED_VIA_XL' WHEN 3 THEN 'ROUTE_OUT' END",
        "dep": "CASE k % 5 WHEN 0 THEN 'SCHEDULED' WHEN 1 THEN 'OUT' WHEN 2 THEN 'OFF' WHEN 3 THEN 'CANCELLED' END",
        "arr": "CASE (k + vc) % 4 WHEN 0 THEN 'SCHEDULED' WHEN 1 THEN 'ON' WHEN 2 THEN 'IN' END",
    }),
    "type": ("e % 37 <> 0", {
        "flt_rel_status": "CASE WHEN k % 6 <> 0 THEN 'R' || (k % 3) END",
        "stub_flt_num": "CASE WHEN k % 7 <> 0 THEN CAST(9000 + k AS STRING) END",
        "anti_ice": "CASE k % 3 WHEN 0 THEN 'true' WHEN 1 THEN 'FALSE' END",
    }),
    "reason": ("e % 5 <> 0", {
        "code": "'C' || (k % 10)",
        "information": "CASE WHEN vc % 8 <> 0 THEN 'reason ' || (vc % 10) END",
    }),
    "stations": ("e % 41 <> 0", {"arr": "'S' || (k % 9)", "original_arr": "'S' || (vc % 9)"}),
    "equipment": ("e % 43 <> 0", {
        "tail": "CASE WHEN vc % 10 <> 0 THEN 'T' || (vc % 20) END",
        "sas_code": "CASE WHEN k % 10 <> 0 THEN 'E' || (k % 4) END",
        "skd_type": "CASE WHEN k % 11 <> 0 THEN 'Q' || (k % 3) END",
        "assigned_type": "CASE WHEN k % 13 <> 0 THEN 'B' || (vc % 3) END",
        "registration": "CASE WHEN vc % 7 <> 0 THEN '  N' || (vc % 20) || ' ' END",
    }),
    "linkage": ("e % 47 <> 0", {
        "next_num": "CASE WHEN k % 6 = 0 THEN '0000' ELSE CAST(100 + k AS STRING) END",
        "next_date": "CASE WHEN k % 12 <> 1 THEN <day b + 86400000> END",
        "next_dup": "CASE WHEN k % 5 <> 0 THEN CAST(k % 2 AS STRING) END",
        "prior_num": "CASE WHEN vc % 6 = 0 THEN '0000' WHEN vc % 13 <> 0 THEN CAST(200 + vc % 50 AS STRING) END",
        "prior_date": "CASE WHEN vc % 11 <> 0 THEN <day b - 86400000> END",
        "prior_dup": "CASE WHEN vc % 14 <> 0 THEN CAST(vc % 2 AS STRING) END",
    }),
    "performance": ("e % 29 <> 0", {"anti_ice": "k % 2 = 0"}),
}


def formula(text: str, day: Callable[[str], str]) -> str:
    """Formula text with its day markers written for one engine."""
    head, marker, rest = text.partition("<day ")
    if not marker:
        return text
    inner, _, tail = rest.partition(">")
    return head + day(inner) + tail


def _spark_day(ms: str) -> str:
    return f"date_format(timestamp_millis({ms}), 'yyyy-MM-dd')"


def raw_events(events: DataFrame) -> DataFrame:
    """Nested raw events; works on a batch and on a streaming `events` frame."""
    props = F.from_json("props", "k long")
    base = events.select(
        F.col("event_id").alias("e"),
        F.col("user_id").alias("u"),
        F.coalesce(props["k"], F.lit(0)).alias("k"),
        F.round(F.col("value") * 100).cast("long").alias("vc"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("t"),
    ).withColumn("b", F.col("t") - F.col("t") % 60_000)
    nested = [
        F.when(
            F.expr(present), F.struct(*[F.expr(formula(x, _spark_day)).alias(n) for n, x in fields.items()])
        ).alias(group)
        for group, (present, fields) in GROUPS.items()
    ]
    return base.select(
        F.col("e").alias("event_id"),
        *[F.expr(x).alias(n) for n, x in TOP.items()],
        F.expr(_spark_day("b")).alias("flight_date"),
        *nested,
    )


def _duck_day(ms: str) -> str:
    return f"strftime(epoch_ms({ms}), '%Y-%m-%d')"


def raw_sql() -> str:
    """The same relation flattened, as a CTE named `raw`."""
    flat = [f"{x} AS {n}" for n, x in TOP.items()]
    for group, (present, fields) in GROUPS.items():
        flat.append(f"{present} AS has_{group}")
        flat += [
            f"CASE WHEN {present} THEN {formula(x, _duck_day)} END AS {group}_{n}" for n, x in fields.items()
        ]
    columns = ",\n    ".join(flat)
    return f"""
raw AS (
  SELECT e AS event_id, {_duck_day("b")} AS flight_date,
    {columns}
  FROM (SELECT *, t - t % 60000 AS b FROM (
    SELECT event_id AS e, user_id AS u, coalesce(CAST(json_extract(props, '$.k') AS BIGINT), 0) AS k,
           CAST(round(value * 100) AS BIGINT) AS vc, epoch_us(ts) // 1000 AS t FROM events))
)"""
