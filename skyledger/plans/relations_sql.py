"""SQL twins of the derived relations, for the side-by-side check."""

LEGS = """
legs AS (
  SELECT *, greatest(sta_ms, ltd_ms) AS lta_ms, ltd_ms AS ptd_ms,
         greatest(sta_ms, ltd_ms + air_min * 60000) AS pta_ms,
         CASE WHEN part_id % 4 <> 0 THEN std_ms + (part_id % 4) * 1800000 END AS equip_ready_ms,
         CASE WHEN part_id % 3 <> 0 THEN std_ms + 300000 END AS cabin_ready_ms,
         CASE WHEN part_id % 6 = 0 THEN std_ms + 2400000 END AS cockpit_ready_ms,
         chain_id || '-' || leg_seq AS flight_key,
         CASE WHEN part_id % 29 = 0 THEN 'CANCELLED' WHEN part_id % 31 = 0 THEN 'ROUTE_OUT'
              ELSE 'ACTIVE' END AS leg_status
  FROM (
    SELECT *, std_ms + air_min * 60000 AS sta_ms,
           std_ms + CASE WHEN supp_id % 7 = 0 THEN 1500000 ELSE 0 END AS ltd_ms
    FROM (
      SELECT *, order_ms + (leg_seq - 1) * 7200000 AS std_ms FROM (
        SELECT l_orderkey AS chain_id, l_partkey AS part_id, l_suppkey AS supp_id,
               CAST(l_linenumber AS BIGINT) AS line_no, o_custkey AS tail_no,
               epoch_ms(o_orderdate) AS order_ms,
               30 + CAST(floor(l_quantity) AS BIGINT) AS air_min,
               20 + (l_partkey % 5) * 10 AS mogt_min,
               row_number() OVER (PARTITION BY l_orderkey
                 ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey, l_quantity) AS leg_seq
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey)))
)"""

EVENTS = """
ev AS (
  SELECT chain_id, event_seq, event_type,
         at_ms + (chain_id % 7) * 1800000
           + CASE WHEN event_type IN ('ACTUAL_ON_CHANGE', 'ACTUAL_IN_CHANGE') THEN 3600000 ELSE 0 END AS value_ms,
         at_ms - 1800000 + (chain_id % 6) * 1500000 AS prev_leg_pta_ms
  FROM (
    SELECT o_orderkey AS chain_id, 1 + o_orderkey % 2 AS event_seq,
           epoch_ms(o_orderdate) + (o_orderkey % 2) * 7200000 AS at_ms,
           ['DEP_DLY_EVENT', 'ARR_DLY_EVENT', 'GROUND_TIME_CHANGE', 'CREW_CABIN_DLY_EVENT',
            'CREW_COCKPIT_DLY_EVENT', 'EQUIP_PREVLEG_CHANGE', 'ACTUAL_OFF_CHANGE', 'ACTUAL_ON_CHANGE',
            'ACTUAL_OUT_CHANGE', 'ACTUAL_IN_CHANGE', 'CANCEL'][1 + o_orderkey % 11] AS event_type
    FROM orders)
)"""

# The same with the arrival of the previous leg looked up in the line.
EVENTS_LOOKED = EVENTS.replace("\nev AS (", "\ngiven AS (") + """,
ev AS (
  SELECT g.* REPLACE (p.pta_ms AS prev_leg_pta_ms)
  FROM given g LEFT JOIN legs p ON p.chain_id = g.chain_id AND p.leg_seq = g.event_seq - 1)"""

FLIGHTS = """
flights AS (
  SELECT *, coalesce(lag(arr_station) OVER c, 'S' || ((supp_id + 1) % 5)) AS dep_station,
         lag(flight_key) OVER c AS prev_leg_key, lag(flight_number) OVER c AS prev_number,
         lag(flight_date) OVER c AS prev_date, lead(flight_key) OVER c AS next_leg_key
  FROM (
    SELECT *, 'A' || (tail_no % 3) AS airline, CAST(part_id % 4 AS VARCHAR) AS flight_number,
           strftime(epoch_ms(std_ms), '%Y-%m-%d') AS flight_date,
           'S' || (supp_id % 5) AS arr_station,
           CASE WHEN part_id % 6 <> 0 THEN 'T' || tail_no END AS tail
    FROM legs)
  WINDOW c AS (PARTITION BY chain_id ORDER BY leg_seq)
)"""

CREW = """
crew AS (
  SELECT flight_key, seat0 || '-' || duty AS duty_key,
         CASE WHEN seat0 = 'PILOT' THEN 'P' WHEN duty % 3 = 0 THEN 'F' ELSE 'C' END AS crew_type,
         CASE WHEN seat0 = 'PILOT' THEN 'CA' ELSE 'FA' END AS seat,
         prev_flight_key, next_flight_key, 30 + (duty % 4) * 10 AS turn_min, supp_id % 10 = 0 AS deadhead
  FROM (
    SELECT flight_key, part_id AS duty, supp_id, line_no,
           lag(flight_key) OVER d AS prev_flight_key, lead(flight_key) OVER d AS next_flight_key,
           unnest(CASE WHEN line_no % 2 = 0 THEN ['CREW', 'PILOT'] ELSE ['CREW'] END) AS seat0
    FROM legs WINDOW d AS (PARTITION BY part_id ORDER BY std_ms, chain_id, leg_seq))
)"""


def with_(*ctes: str) -> str:
    """WITH clause of the given relations."""
    return "WITH RECURSIVE " + ",".join(ctes) + "\n"
