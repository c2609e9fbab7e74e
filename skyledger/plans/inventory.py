"""Stock, order, sales and supplier queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyledger.operators import inventory as inv
from skyledger.operators import lof, sinks
from skyledger.operators import project as p
from skyledger.operators.ordered import hot_hashes
from skyledger.operators.versions import KeyedState
from skyledger.plans import lof as lof_plans
from skyledger.plans import projection
from skyledger.plans.relations_sql import LEGS, with_
from skyledger.session import run_dir, settle
from skyledger.sources import flights, state, stock
from skyledger.sources.tables import table

# Day of the registered reports: 1998-08-02 00:00 UTC.
AS_OF_MS = 902_016_000_000


_MOVED = (
    "product_id", "order_id", "line_no", "supplier_id", "location_id", "units", "ship_ms", "order_status", "return_flag",
    "line_status", "untaxed",
)


def _opening():
    return stock.opening_units(F.col("size"))


def _rule():
    return stock.reorder_point(F.col("size"), F.col("location_id")), stock.reorder_qty(F.col("size"))


def planned_opening(spark: SparkSession, sf_dir: str):
    """Opening units of a product over all locations of the location table."""
    return _opening() * stock.locations(spark, sf_dir).count()


def _moved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inv.movements(stock.order_lines(spark, sf_dir, *_MOVED), stock.locations(spark, sf_dir))


def _moves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[int]]:
    """All movements with openings, and the hashes of very long positions.

    The movements are written once; their positions open them as they are read.
    """
    moved = settle(_moved(spark, sf_dir), "moved")
    return inv.with_openings(moved, stock.products(spark, sf_dir), _opening()), hot_hashes(moved, inv.POSITION)


def _levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inv.stock_levels(_moved(spark, sf_dir), stock.products(spark, sf_dir), _opening())


def _status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inv.stock_status(_levels(spark, sf_dir), stock.products(spark, sf_dir), *_rule())


def stock_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _levels(spark, sf_dir)


def stock_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _status(spark, sf_dir).select("product_id", "location_id", "available", "reorder_point", "status")


def low_stock_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    moves, hashes = _moves(spark, sf_dir)
    return inv.low_stock_alerts(moves, stock.products(spark, sf_dir), *_rule(), hashes)


def stock_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inv.stock_rollup(_levels(spark, sf_dir), stock.locations(spark, sf_dir))


def stock_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stock history: every movement with the balance after it."""
    return inv.ledger(*_moves(spark, sf_dir)).rows().drop("_free", "step")


def order_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inv.order_effects(*_moves(spark, sf_dir))


def order_fulfilment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per order what stock that never falls below zero could serve."""
    return inv.order_fulfilment(*_moves(spark, sf_dir))


def refused_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Movements that found too little stock, with the units refused and the stock left."""
    rows = inv.refusing_ledger(*_moves(spark, sf_dir)).rows().filter("refused > 0")
    return rows.select("product_id", "location_id", "ts_ms", "kind", "order_id", "line_no", "supplier_id", "refused", "stock")


def order_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order feed in which urgent and high orders arrive again, ten minutes later."""
    once = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("order_id"),
        F.lit(1).cast("long").alias("received_no"),
        stock.cents("o_totalprice").alias("total_cents"),
        "o_orderpriority",
        F.col("o_orderdate").cast("timestamp").alias("received_at"),
    )
    again = once.filter(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).withColumns(
        {"received_no": F.lit(2).cast("long"), "received_at": F.col("received_at") + F.expr("INTERVAL 10 MINUTES")}
    )
    return once.unionByName(again)


def order_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inv.dedup_orders(order_feed(spark, sf_dir))


def sales_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inv.sales_trend(stock.order_lines(spark, sf_dir, "order_ms", "units", "revenue_e4"))


def _sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inv.product_sales(stock.order_lines(spark, sf_dir, "product_id", "units", "revenue_e4"))


def top_sellers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inv.top_sellers(_sales(spark, sf_dir), stock.products(spark, sf_dir))


def slow_movers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inv.slow_movers(stock.products(spark, sf_dir), _sales(spark, sf_dir), planned_opening(spark, sf_dir))


def order_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inv.order_value(stock.order_lines(spark, sf_dir, "customer_id", "order_id", "revenue_e4", "order_ms"))


def turnover(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inv.turnover(
        stock.products(spark, sf_dir), _sales(spark, sf_dir), _levels(spark, sf_dir), _opening(), stock.locations(spark, sf_dir).count()
    )


def stock_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inv.stock_value(_status(spark, sf_dir), stock.products(spark, sf_dir))


def po_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    suppliers = inv.preferred_suppliers(stock.order_lines(spark, sf_dir, "product_id", "supplier_id"))
    return inv.po_suggestions(_status(spark, sf_dir), suppliers, AS_OF_MS)


def po_by_supplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inv.po_by_supplier(stock.purchase_orders(spark, sf_dir), AS_OF_MS)


def supplier_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inv.supplier_score(stock.purchase_orders(spark, sf_dir, with_value=False))


def dashboard_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inv.dashboard(
        _status(spark, sf_dir),
        stock.products(spark, sf_dir),
        stock.order_lines(spark, sf_dir, "order_id", "order_ms"),
        stock.purchase_orders(spark, sf_dir, with_value=False),
        AS_OF_MS,
    )


def csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stock report exported to CSV and read back."""
    report = stock_value(spark, sf_dir)
    path = run_dir(spark, "report")
    sinks.export_csv(report, path)
    return sinks.read_csv(spark, path, report.schema)


PATCHED = ("ptd_ms", "pta_ms", "equip_ready_ms", "cabin_ready_ms", "cockpit_ready_ms")


def upsert_patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored legs after the departure-delay results are patched in: a version of the patched legs only."""
    legs = flights.legs(spark, sf_dir)
    at = F.col("order_ms")
    stored = legs.rows().select("flight_key", "std_ms", *PATCHED)
    kept = KeyedState(spark, run_dir(spark, "times"), stored.schema, ["flight_key"])
    kept.write(0, stored)
    patch = settle(lof.emitted_legs(lof.apply_delay(lof.same_event(legs, "DEP_DLY_EVENT", at, at))), "patch")
    kept.write(1, sinks.upsert(kept.read(0, patch), patch, "flight_key", PATCHED))
    return kept.read()


def replace_resource_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equipment rows on file, replaced by fresh ones for the legs of a swap what-if."""
    wide = state.wide_legs(spark, sf_dir).rows()
    columns = ("flight_key", "resource_key", "turn_min", "ready_ms")
    old = wide.filter(F.col("prev_leg_key").isNotNull()).select(
        "flight_key",
        F.col("prev_leg_key").alias("resource_key"),
        F.lit(0).cast("long").alias("turn_min"),
        F.col("std_ms").alias("ready_ms"),
    )
    fresh = p.resource_ready(wide, None, state.tails(spark, sf_dir), with_crew=False)
    swap = wide.filter(F.col("request_type") == p.SWAP).select("flight_key")
    kept = KeyedState(spark, run_dir(spark, "resources"), old.schema, ["flight_key"])
    kept.write(0, old)
    kept.write(1, fresh.join(swap, "flight_key", "left_semi").select(*columns))
    return kept.read()


QUERIES = {
    f.__name__: f
    for f in (
        stock_levels,
        stock_status,
        low_stock_alerts,
        stock_rollup,
        stock_ledger,
        order_effects,
        order_fulfilment,
        refused_units,
        order_dedup,
        sales_trend,
        top_sellers,
        slow_movers,
        order_value,
        turnover,
        stock_value,
        po_suggestions,
        po_by_supplier,
        supplier_score,
        dashboard_totals,
        csv_roundtrip,
        upsert_patch,
        replace_resource_rows,
    )
}

_LINES = """
prod AS (SELECT p_partkey AS product_id, p_name AS name, p_type AS category, CAST(p_size AS BIGINT) AS size,
           CAST(round(p_retailprice * 100) AS BIGINT) AS cost_cents FROM part),
lines AS (
  SELECT l_orderkey AS order_id, o_custkey AS customer_id, l_partkey AS product_id, l_suppkey AS supplier_id,
         CAST(l_linenumber AS BIGINT) AS line_no, CAST(s_nationkey AS BIGINT) AS location_id,
         CAST(floor(l_quantity) AS BIGINT) AS units,
         CAST(round(l_extendedprice * 100) AS BIGINT) * (100 - CAST(round(l_discount * 100) AS BIGINT)) AS revenue_e4,
         l_returnflag AS return_flag, l_linestatus AS line_status, l_tax = 0.0 AS untaxed, o_orderstatus AS order_status,
         epoch_ms(o_orderdate) AS order_ms, epoch_ms(l_shipdate) AS ship_ms
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey)"""
_MOVES = """
loc AS (SELECT CAST(n_nationkey AS BIGINT) AS location_id,
          CAST(coalesce(lead(n_nationkey) OVER (ORDER BY n_nationkey), min(n_nationkey) OVER ()) AS BIGINT) AS next_id FROM nation),
moved AS (
  SELECT product_id, order_id, line_no, supplier_id, 'TRANSFER_OUT' AS kind, 1 AS step, ship_ms - 86400000 AS ts_ms,
    coalesce(next_id, location_id) AS location_id, -units AS on_hand, CAST(0 AS BIGINT) AS reserved, CAST(0 AS BIGINT) AS damaged
    FROM lines LEFT JOIN loc USING (location_id) WHERE line_no = 1
  UNION ALL SELECT product_id, order_id, line_no, supplier_id, 'TRANSFER_IN', 2, ship_ms - 86400000, location_id, units, 0, 0
    FROM lines WHERE line_no = 1
  UNION ALL SELECT product_id, order_id, line_no, supplier_id, 'RESERVE', 3, ship_ms, location_id, 0, units, 0
    FROM lines WHERE order_status = 'P'
  UNION ALL SELECT product_id, order_id, line_no, supplier_id, 'SALE', 4, ship_ms, location_id, -units, 0, 0
    FROM lines WHERE order_status <> 'P'
  UNION ALL SELECT product_id, order_id, line_no, supplier_id, 'RELEASE', 5, ship_ms + 172800000, location_id, 0, -units, 0
    FROM lines WHERE order_status = 'P' AND line_status = 'F'
  UNION ALL SELECT product_id, order_id, line_no, supplier_id, 'ADJUST_DAMAGED', 6, ship_ms + 432000000, location_id, -1, 0, 1
    FROM lines WHERE order_status <> 'P' AND return_flag = 'A' AND untaxed
  UNION ALL SELECT product_id, order_id, line_no, supplier_id, 'RETURN_SELLABLE', 7, ship_ms + 864000000, location_id, units, 0, 0
    FROM lines WHERE order_status <> 'P' AND return_flag = 'R' AND line_status = 'O'
  UNION ALL SELECT product_id, order_id, line_no, supplier_id, 'RETURN_DAMAGED', 8, ship_ms + 864000000, location_id, 0, 0, units
    FROM lines WHERE order_status <> 'P' AND return_flag = 'R' AND line_status = 'F'),
moves AS (
  SELECT product_id, CAST(-1 AS BIGINT) AS order_id, CAST(-1 AS BIGINT) AS line_no, CAST(-1 AS BIGINT) AS supplier_id,
    'OPENING' AS kind, 0 AS step, CAST(0 AS BIGINT) AS ts_ms, location_id, size * 2 AS on_hand,
    CAST(0 AS BIGINT) AS reserved, CAST(0 AS BIGINT) AS damaged
  FROM (SELECT DISTINCT product_id, location_id FROM moved) JOIN prod USING (product_id)
  UNION ALL SELECT * FROM moved),
thr AS (SELECT product_id, location_id, size * (1 + location_id % 3) // 2 AS reorder_point, size * 20 AS reorder_qty
        FROM (SELECT DISTINCT product_id, location_id FROM moved) JOIN prod USING (product_id))"""
_LEVELS = """
levels AS (
  SELECT product_id, location_id, CAST(sum(on_hand) AS BIGINT) AS on_hand, CAST(sum(reserved) AS BIGINT) AS reserved,
         CAST(sum(damaged) AS BIGINT) AS damaged, CAST(sum(on_hand) - sum(reserved) AS BIGINT) AS available
  FROM moves GROUP BY product_id, location_id),
stat AS (
  SELECT l.*, t.reorder_point, t.reorder_qty,
    CASE WHEN available <= 0 THEN 'out' WHEN available <= coalesce(t.reorder_point, 0) THEN 'low' ELSE 'in' END AS status
  FROM levels l LEFT JOIN thr t ON t.product_id = l.product_id AND t.location_id = l.location_id)"""
_LEDGER = """
led AS (
  SELECT *, CAST(sum(on_hand) OVER w AS BIGINT) AS balance, CAST(sum(on_hand - reserved) OVER w AS BIGINT) AS available
  FROM moves WINDOW w AS (PARTITION BY product_id, location_id ORDER BY ts_ms, step, order_id, line_no, supplier_id, on_hand, reserved, damaged
                          ROWS UNBOUNDED PRECEDING))"""
_SALES = """
sales AS (SELECT product_id, CAST(sum(units) AS BIGINT) AS units, CAST(sum(revenue_e4) AS BIGINT) AS revenue_e4
          FROM lines GROUP BY product_id)"""
_PO = """
po AS (
  SELECT order_id, line_no, supplier_id, l.product_id, units, units * cost_cents AS value_cents,
    CASE WHEN line_status = 'F' AND line_no % 7 = 0 THEN units - 1 WHEN line_status = 'F' THEN units ELSE 0 END AS received,
    CASE WHEN line_status = 'F' AND return_flag = 'R' THEN units // 10 ELSE 0 END AS defects,
    order_ms AS ordered_ms, order_ms + (25 + supplier_id % 5) * 86400000 AS expected_ms,
    CASE WHEN line_status = 'F' THEN order_ms + (10 + l.product_id % 30) * 86400000 END AS received_ms,
    CASE WHEN line_status = 'F' THEN 'RECEIVED' WHEN return_flag = 'N' THEN 'CONFIRMED' ELSE 'SENT' END AS status
  FROM lines l JOIN prod p ON p.product_id = l.product_id)"""
_L = with_(_LINES, _MOVES, _LEVELS)
_REPORT = (
    _L
    + """SELECT s.product_id, name, category, location_id, on_hand, on_hand * cost_cents AS value_cents, status
FROM stat s JOIN prod p ON p.product_id = s.product_id"""
)

_REFUSED = """
ref AS (
  SELECT *, CAST(total + greatest(0, coalesce(now, 0)) AS BIGINT) AS stock,
         CAST(greatest(0, coalesce(now, 0)) - greatest(0, coalesce(before, 0)) AS BIGINT) AS refused
  FROM (SELECT *, max(-total) OVER (w ROWS UNBOUNDED PRECEDING) AS now,
               max(-total) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
        FROM (SELECT *, balance AS total FROM led)
        WINDOW w AS (PARTITION BY product_id, location_id ORDER BY ts_ms, step, order_id, line_no, supplier_id, on_hand, reserved, damaged)))"""

ORACLE = {
    "order_fulfilment": with_(_LINES, _MOVES, _LEDGER, _REFUSED)
    + """
SELECT *, CASE WHEN units_refused > 0 AND units_sold = 0 AND units_held = units_released THEN 'REFUSED'
    WHEN units_refused > 0 THEN 'PARTLY_REFUSED'
    WHEN units_released > 0 AND units_sold = 0 AND units_held = units_released THEN 'CANCELLED'
    WHEN units_released > 0 THEN 'PARTLY_CANCELLED' ELSE 'OK' END AS outcome
FROM (SELECT order_id, count(*) FILTER (kind <> 'RELEASE') AS lines,
    CAST(coalesce(sum(-on_hand - refused) FILTER (kind = 'SALE'), 0) AS BIGINT) AS units_sold,
    CAST(coalesce(sum(refused) FILTER (kind = 'SALE'), 0) AS BIGINT) AS units_refused,
    count(*) FILTER (kind = 'SALE' AND refused > 0) AS lines_refused,
    CAST(coalesce(sum(reserved) FILTER (kind = 'RESERVE'), 0) AS BIGINT) AS units_held,
    CAST(coalesce(sum(-reserved) FILTER (kind = 'RELEASE'), 0) AS BIGINT) AS units_released
  FROM ref WHERE kind IN ('SALE', 'RESERVE', 'RELEASE') GROUP BY order_id)""",
    "refused_units": with_(_LINES, _MOVES, _LEDGER, _REFUSED)
    + "SELECT product_id, location_id, ts_ms, kind, order_id, line_no, supplier_id, refused, stock FROM ref WHERE refused > 0",
    "stock_levels": _L + "SELECT * FROM levels",
    "stock_status": _L + "SELECT product_id, location_id, available, reorder_point, status FROM stat",
    "low_stock_alerts": with_(_LINES, _MOVES, _LEDGER)
    + """
SELECT l.product_id, l.location_id, ts_ms, kind, order_id, line_no, balance, reorder_point, reorder_qty
FROM led l JOIN thr t ON t.product_id = l.product_id AND t.location_id = l.location_id
WHERE balance <= reorder_point AND (kind = 'OPENING' OR balance - on_hand > reorder_point)""",
    "stock_rollup": _L
    + """
SELECT r_name AS region, location_id, CAST(sum(on_hand) AS BIGINT) AS on_hand, CAST(sum(available) AS BIGINT) AS available,
       CAST(grouping(r_name) * 2 + grouping(location_id) AS BIGINT) AS level
FROM levels JOIN nation ON n_nationkey = location_id JOIN region ON n_regionkey = r_regionkey
GROUP BY ROLLUP (r_name, location_id)""",
    "stock_ledger": with_(_LINES, _MOVES, _LEDGER) + "SELECT * EXCLUDE (step) FROM led",
    "order_effects": with_(_LINES, _MOVES, _LEDGER)
    + """
SELECT order_id, count(*) AS lines, count(*) FILTER (available < 0) AS short_lines, CAST(sum(-on_hand) AS BIGINT) AS units_sold,
       CAST(sum(reserved) AS BIGINT) AS units_reserved,
       CASE WHEN count(*) FILTER (available < 0) > 0 THEN 'REVIEW' ELSE 'OK' END AS outcome
FROM led WHERE kind IN ('SALE', 'RESERVE') GROUP BY order_id""",
    "order_dedup": """
SELECT o_orderkey AS order_id, CAST(1 AS BIGINT) AS first_received,
       CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN CAST(2 AS BIGINT) ELSE 1 END AS copies,
       CAST(round(o_totalprice * 100) AS BIGINT) AS total_cents FROM orders""",
    "sales_trend": with_(_LINES)
    + """,
t AS (
  SELECT grain, CAST(CAST(date_trunc(grain, epoch_ms(order_ms)) AS DATE) AS VARCHAR) AS period, CAST(sum(units) AS BIGINT) AS units,
         CAST(sum(revenue_e4) AS BIGINT) AS revenue_e4
  FROM (SELECT *, unnest(['day', 'week', 'month', 'year']) AS grain FROM lines) GROUP BY ALL)
SELECT * EXCLUDE (before), round((revenue_e4 - before) / before, 6) AS growth
FROM (SELECT *, CASE WHEN CAST(lag(period) OVER w AS DATE) = CAST(date_trunc(grain, CAST(period AS DATE) - 1) AS DATE)
        THEN lag(revenue_e4) OVER w END AS before FROM t WINDOW w AS (PARTITION BY grain ORDER BY period))""",
    "top_sellers": with_(_LINES, _SALES)
    + """
SELECT s.product_id, s.units, s.revenue_e4, p.name, p.category
FROM (SELECT * FROM sales ORDER BY units DESC, product_id LIMIT 10) s JOIN prod p ON p.product_id = s.product_id""",
    "slow_movers": with_(_LINES, _SALES)
    + """
SELECT p.product_id, p.name, coalesce(s.units, 0) AS units_sold, p.size * 2 * (SELECT count(*) FROM nation) AS opening_units
FROM prod p LEFT JOIN sales s ON s.product_id = p.product_id WHERE coalesce(s.units, 0) * 4 < p.size * 2 * (SELECT count(*) FROM nation)""",
    "order_value": with_(_LINES)
    + """
SELECT customer_id, count(*) AS orders, round(sum(rev) / count(*) / 10000, 6) AS average_value,
       round(count(*) * 365 / ((max(order_ms) - min(order_ms)) / 86400000 + 1), 6) AS orders_per_year
FROM (SELECT customer_id, order_id, CAST(sum(revenue_e4) AS BIGINT) AS rev, min(order_ms) AS order_ms FROM lines GROUP BY ALL)
GROUP BY customer_id""",
    "turnover": with_(_LINES, _MOVES, _LEVELS, _SALES)
    + """,
b AS (
  SELECT p.product_id, category, coalesce(s.units, 0) AS sold,
    CAST(p.size * 2 * (2 * (SELECT count(*) FROM nation) - coalesce(c.moved, 0)) + coalesce(c.closing, 0) AS BIGINT) AS stock2, cost_cents
  FROM prod p LEFT JOIN sales s ON s.product_id = p.product_id
  LEFT JOIN (SELECT product_id, sum(on_hand) AS closing, count(*) AS moved FROM levels GROUP BY product_id) c ON c.product_id = p.product_id),
u AS (
  SELECT 'product' AS grain, CAST(product_id AS VARCHAR) AS item, CAST(sold AS BIGINT) AS sold, stock2 FROM b
  UNION ALL SELECT 'category', category, CAST(sum(sold * cost_cents) AS BIGINT), CAST(sum(stock2 * cost_cents) AS BIGINT) FROM b GROUP BY category),
r AS (SELECT *, CASE WHEN stock2 > 0 THEN round(sold * 2 / stock2, 6) END AS rate FROM u)
SELECT grain, item, sold, rate, CASE WHEN rate IS NULL THEN 'no stock' WHEN rate >= 1 THEN 'fast' WHEN rate < 0.25 THEN 'slow'
       ELSE 'normal' END AS pace FROM r""",
    "stock_value": _REPORT,
    "csv_roundtrip": _REPORT,
    "po_suggestions": _L
    + f""",
pref AS (SELECT product_id, arg_max(supplier_id, {{'n': n, 's': -supplier_id}}) AS supplier_id
  FROM (SELECT product_id, supplier_id, count(*) AS n FROM lines GROUP BY ALL) GROUP BY product_id)
SELECT s.product_id, location_id, available, reorder_point, reorder_qty AS suggested_qty, f.supplier_id,
       {AS_OF_MS} + (3 + f.supplier_id % 10) * 86400000 AS expected_ms, 'DRAFT' AS po_status
FROM stat s LEFT JOIN pref f ON f.product_id = s.product_id WHERE status IN ('low', 'out')""",
    "po_by_supplier": with_(_LINES, _PO)
    + f"""
SELECT supplier_id, count(*) AS orders, CAST(sum(value_cents) AS BIGINT) AS value_cents,
       count(*) FILTER (status <> 'RECEIVED') AS open_orders, count(*) FILTER (status = 'SENT') AS sent_orders,
       CAST(coalesce(sum(value_cents) FILTER (status <> 'RECEIVED'), 0) AS BIGINT) AS open_value_cents,
       count(*) FILTER (status <> 'RECEIVED' AND expected_ms < {AS_OF_MS}) AS overdue_orders
FROM po GROUP BY supplier_id""",
    "supplier_score": with_(_LINES, _PO)
    + """
SELECT supplier_id, count(*) AS deliveries, round(count(*) FILTER (received_ms <= expected_ms) / count(*), 6) AS on_time_rate,
       round(count(*) FILTER (received = units) / count(*), 6) AS accuracy_rate,
       round(sum((received_ms - ordered_ms) / 86400000) / count(*), 6) AS mean_lead_days,
       round(sum(defects) / sum(units), 6) AS defect_rate
FROM po WHERE received_ms IS NOT NULL GROUP BY supplier_id""",
    "dashboard_totals": with_(_LINES, _MOVES, _LEVELS, _PO)
    + f"""
SELECT 'products' AS metric, count(*) AS value FROM prod
UNION ALL SELECT 'stock_value_cents', CAST(sum(on_hand * cost_cents) AS BIGINT) FROM stat s JOIN prod p ON p.product_id = s.product_id
UNION ALL SELECT 'low_stock', count(*) FROM stat WHERE status = 'low'
UNION ALL SELECT 'out_of_stock', count(*) FROM stat WHERE status = 'out'
UNION ALL SELECT 'recent_orders', count(DISTINCT order_id) FROM lines
  WHERE order_ms <= {AS_OF_MS} AND order_ms > {AS_OF_MS - 30 * 86_400_000}
UNION ALL SELECT 'pending_purchases', count(*) FROM po WHERE status <> 'RECEIVED'""",
    "upsert_patch": with_(LEGS, lof_plans._one_kind("DEP_DLY_EVENT", 0, 0), lof_plans.fold("one"))
    + f""", done AS (SELECT flight_key, ptd, pta, {lof_plans.READY} FROM run WHERE ok)
SELECT l.flight_key, l.std_ms, coalesce(d.ptd, l.ptd_ms) AS ptd_ms, coalesce(d.pta, l.pta_ms) AS pta_ms,
       coalesce(d.equip_ready_ms, l.equip_ready_ms) AS equip_ready_ms,
       coalesce(d.cabin_ready_ms, l.cabin_ready_ms) AS cabin_ready_ms,
       coalesce(d.cockpit_ready_ms, l.cockpit_ready_ms) AS cockpit_ready_ms
FROM legs l LEFT JOIN done d ON d.flight_key = l.flight_key""",
    "replace_resource_rows": with_(*projection._BASE)
    + """,
fresh AS (SELECT flight_key, resource_key, coalesce(turn_min, NULL) AS turn_min, ready_ms FROM craft
          WHERE flight_key IN (SELECT flight_key FROM wide WHERE request_type = 'SWAP_WHATIF'))
SELECT * FROM fresh
UNION ALL
SELECT flight_key, prev_leg_key, CAST(0 AS BIGINT), std_ms FROM wide
WHERE prev_leg_key IS NOT NULL AND flight_key NOT IN (SELECT flight_key FROM fresh)""",
}
