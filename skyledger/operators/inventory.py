"""Stock ledger, stock state, sales and supplier reports."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyledger.operators.ordered import Ordered, running_max, running_sum

DAY = 86_400_000

# Movement kinds in the order they apply at one moment.
KINDS = (
    "OPENING", "TRANSFER_OUT", "TRANSFER_IN", "RESERVE", "SALE", "RELEASE", "ADJUST_DAMAGED", "RETURN_SELLABLE",
    "RETURN_DAMAGED",
)


def _move(kind: str, when: Column, hand: Column, reserved: Column, damaged: Column, location: Column) -> Column:
    return F.struct(
        F.lit(kind).alias("kind"),
        F.lit(KINDS.index(kind)).cast("long").alias("step"),
        when.alias("ts_ms"),
        location.alias("location_id"),
        hand.alias("on_hand"),
        reserved.alias("reserved"),
        damaged.alias("damaged"),
    )


def movements(lines: DataFrame, locations: DataFrame) -> DataFrame:
    """All stock movements of order lines as signed rows.

    An open order reserves and a cancelled line of it releases; other lines
    sell.  The first line of an order is supplied from the next location of the
    location table by a transfer pair.  Returned goods come back sellable or
    damaged, and some accepted goods are written off.
    """
    # The location table is a reference list; a location that it lacks supplies itself.
    lines = lines.join(F.broadcast(locations.select("location_id", "next_location_id")), "location_id", "left")
    units, zero, here = F.col("units"), F.lit(0).cast("long"), F.col("location_id")
    ship, open_order = F.col("ship_ms"), F.col("order_status") == "P"
    source = F.coalesce("next_location_id", "location_id")
    returned = ~open_order & (F.col("return_flag") == "R")
    first = F.col("line_no") == 1
    items = F.array(
        F.when(first, _move("TRANSFER_OUT", ship - DAY, -units, zero, zero, source)),
        F.when(first, _move("TRANSFER_IN", ship - DAY, units, zero, zero, here)),
        F.when(open_order, _move("RESERVE", ship, zero, units, zero, here)),
        F.when(~open_order, _move("SALE", ship, -units, zero, zero, here)),
        F.when(open_order & (F.col("line_status") == "F"), _move("RELEASE", ship + 2 * DAY, zero, -units, zero, here)),
        F.when(
            ~open_order & (F.col("return_flag") == "A") & F.col("untaxed"),
            _move("ADJUST_DAMAGED", ship + 5 * DAY, F.lit(-1).cast("long"), zero, F.lit(1).cast("long"), here),
        ),
        F.when(
            returned & (F.col("line_status") == "O"),
            _move("RETURN_SELLABLE", ship + 10 * DAY, units, zero, zero, here),
        ),
        F.when(
            returned & (F.col("line_status") == "F"),
            _move("RETURN_DAMAGED", ship + 10 * DAY, zero, zero, units, here),
        ),
    )
    return lines.select(
        "product_id", "order_id", "line_no", "supplier_id", F.inline(F.filter(items, lambda x: x.isNotNull()))
    )


def with_openings(moved: DataFrame, products: DataFrame, opening: Column) -> DataFrame:
    """Movements and, for every product at every location they touch, its opening stock."""
    none, zero = F.lit(-1).cast("long"), F.lit(0).cast("long")
    positions = moved.select("product_id", "location_id").distinct()
    start = positions.join(products.select("product_id", opening.alias("_opening")), "product_id").select(
        "product_id",
        none.alias("order_id"),
        none.alias("line_no"),
        none.alias("supplier_id"),
        F.lit("OPENING").alias("kind"),
        zero.alias("step"),
        zero.alias("ts_ms"),
        "location_id",
        F.col("_opening").alias("on_hand"),
        zero.alias("reserved"),
        zero.alias("damaged"),
    )
    return start.unionByName(moved)


def stock_levels(moved: DataFrame, products: DataFrame, opening: Column) -> DataFrame:
    """On hand, reserved, available and damaged units per product and location with movements.

    The opening stock is added once per position, after the movements are summed.
    """
    sums = moved.groupBy("product_id", "location_id").agg(
        F.sum("on_hand").alias("moved"), F.sum("reserved").alias("reserved"), F.sum("damaged").alias("damaged")
    )
    opened = sums.join(products.select("product_id", opening.alias("_opening")), "product_id")
    on_hand = F.col("_opening") + F.col("moved")
    return opened.select(
        "product_id", "location_id", on_hand.alias("on_hand"), "reserved", "damaged",
        (on_hand - F.col("reserved")).alias("available"),
    )


def status_of(available: Column, reorder_point: Column) -> Column:
    return F.when(available <= 0, "out").when(available <= F.coalesce(reorder_point, F.lit(0)), "low").otherwise("in")


def stock_status(levels: DataFrame, products: DataFrame, point: Column, quantity: Column) -> DataFrame:
    """Levels with the reorder rule of their product and location, and their status."""
    joined = levels.join(products.select("product_id", "size"), "product_id", "left")
    ruled = joined.withColumns({"reorder_point": point, "reorder_qty": quantity}).drop("size")
    return ruled.withColumn("status", status_of(F.col("available"), F.col("reorder_point")))


POSITION = ("product_id", "location_id")
_ORDER = ("ts_ms", "step", "order_id", "line_no", "supplier_id", "on_hand", "reserved", "damaged")


def ledger(moves: DataFrame, hashes: Sequence[int] | None = None) -> Ordered:
    """Movements in order with the running on-hand and available balance; `hashes` are those of very long positions."""
    prepared = moves.withColumn("_free", F.col("on_hand") - F.col("reserved"))
    line = Ordered.of(prepared, POSITION, _ORDER, hashes)
    return line.scan(running_sum("on_hand", "balance"), running_sum("_free", "available"))


def low_stock_alerts(moves: DataFrame, products: DataFrame, point: Column, quantity: Column, hashes: Sequence[int] | None = None) -> DataFrame:
    """One alert each time the balance falls to the reorder point, until it recovers."""
    sized = ledger(moves, hashes).rows().join(products.select("product_id", "size"), "product_id")
    rows = sized.withColumns({"reorder_point": point, "reorder_qty": quantity})
    low = F.col("balance") <= F.col("reorder_point")
    before = (F.col("balance") - F.col("on_hand") <= F.col("reorder_point")) & (F.col("kind") != "OPENING")
    return rows.filter(low & ~before).select(
        "product_id", "location_id", "ts_ms", "kind", "order_id", "line_no", "balance", "reorder_point", "reorder_qty"
    )


def stock_rollup(levels: DataFrame, locations: DataFrame) -> DataFrame:
    """Units per location with subtotals per region and overall.

    Units are summed per location first, so the rollup sees a few rows only.
    """
    small = levels.groupBy("location_id").agg(F.sum("on_hand").alias("on_hand"), F.sum("available").alias("available"))
    joined = small.join(F.broadcast(locations.select("location_id", "region")), "location_id")
    return joined.rollup("region", "location_id").agg(
        F.sum("on_hand").alias("on_hand"),
        F.sum("available").alias("available"),
        F.grouping_id().cast("long").alias("level"),
    )


def order_effects(moves: DataFrame, hashes: Sequence[int] | None = None) -> DataFrame:
    """Per order: lines, lines that found too little stock, and the outcome."""
    taken = ledger(moves, hashes).rows().filter(F.col("kind").isin("SALE", "RESERVE"))
    return (
        taken.groupBy("order_id")
        .agg(
            F.count(F.lit(1)).alias("lines"),
            F.count_if(F.col("available") < 0).alias("short_lines"),
            F.sum(-F.col("on_hand")).alias("units_sold"),
            F.sum("reserved").alias("units_reserved"),
        )
        .withColumn("outcome", F.when(F.col("short_lines") > 0, "REVIEW").otherwise("OK"))
    )


def refusing_ledger(moves: DataFrame, hashes: Sequence[int] | None = None) -> Ordered:
    """Movements in order with the stock that never falls below zero, and the units refused for lack of it.

    Taking d units from a stock x leaves max(0, x - d).  Chained, that is the running sum of the
    movements plus the largest shortfall so far, so two scans give it for positions of any
    length: `refused_so_far` is the running maximum of the negative running sum.
    """
    line = Ordered.of(moves, POSITION, _ORDER, hashes).scan(running_sum("on_hand", "_sum"))
    line = line.on(line.df.withColumn("_short", -F.col("_sum")))
    line = line.scan(running_max("_short", "_now"), running_max("_short", "_before", inclusive=False))
    now, before = (F.greatest(F.coalesce(c, F.lit(0)), F.lit(0)) for c in ("_now", "_before"))
    stock = line.df.withColumns({"stock": F.col("_sum") + now, "refused": now - before})
    return line.on(stock.drop("_sum", "_short", "_now", "_before"))


def order_fulfilment(moves: DataFrame, hashes: Sequence[int] | None = None) -> DataFrame:
    """Per order what was asked, sold, refused for lack of stock, held and released, and the outcome.

    An order is refused or partly refused by its sales, and cancelled or partly cancelled by the
    lines whose hold was released.
    """
    own = refusing_ledger(moves, hashes).rows().filter(F.col("kind").isin("SALE", "RESERVE", "RELEASE"))
    sale, zero = F.col("kind") == "SALE", F.lit(0).cast("long")
    sums = own.groupBy("order_id").agg(
        F.count_if(F.col("kind") != "RELEASE").alias("lines"),
        F.sum(F.when(sale, -F.col("on_hand") - F.col("refused")).otherwise(zero)).alias("units_sold"),
        F.sum(F.when(sale, F.col("refused")).otherwise(zero)).alias("units_refused"),
        F.count_if(sale & (F.col("refused") > 0)).alias("lines_refused"),
        F.sum(F.when(F.col("kind") == "RESERVE", F.col("reserved")).otherwise(zero)).alias("units_held"),
        F.sum(F.when(F.col("kind") == "RELEASE", -F.col("reserved")).otherwise(zero)).alias("units_released"),
    )
    none_left = (F.col("units_sold") == 0) & (F.col("units_held") == F.col("units_released"))
    outcome = (
        F.when((F.col("units_refused") > 0) & none_left, "REFUSED")
        .when(F.col("units_refused") > 0, "PARTLY_REFUSED")
        .when((F.col("units_released") > 0) & none_left, "CANCELLED")
        .when(F.col("units_released") > 0, "PARTLY_CANCELLED")
        .otherwise("OK")
    )
    return sums.withColumn("outcome", outcome)


def dedup_orders(received: DataFrame) -> DataFrame:
    """First receipt of every order and how often it came."""
    return received.groupBy("order_id").agg(
        F.min("received_no").alias("first_received"),
        F.count(F.lit(1)).alias("copies"),
        F.min_by("total_cents", "received_no").alias("total_cents"),
    )


GRAINS = ("day", "week", "month", "year")


def sales_trend(lines: DataFrame) -> DataFrame:
    """Units and revenue per day, week, month and year, and growth on the period before.

    Days are summed first; the coarser periods and the growth window then work
    on one row per calendar day.  Where the period before has no sales there is no growth.
    """
    daily = lines.groupBy(F.to_date(F.timestamp_millis("order_ms")).alias("day")).agg(
        F.sum("units").alias("units"), F.sum("revenue_e4").alias("revenue_e4")
    )
    periods = F.inline(
        F.array(*[F.struct(F.lit(g).alias("grain"), F.to_date(F.date_trunc(g, "day")).alias("period")) for g in GRAINS])
    )
    prior = F.to_date(F.expr("date_trunc(grain, date_sub(period, 1))"))
    totals = daily.select("units", "revenue_e4", periods).groupBy("grain", "period").agg(
        F.sum("units").alias("units"), F.sum("revenue_e4").alias("revenue_e4")
    )
    over = Window.partitionBy("grain").orderBy("period")
    before = F.when(F.lag("period").over(over) == prior, F.lag("revenue_e4").over(over))
    return totals.select(
        "grain",
        F.col("period").cast("string").alias("period"),
        "units",
        "revenue_e4",
        F.round((F.col("revenue_e4") - before) / before, 6).alias("growth"),
    )


def product_sales(lines: DataFrame) -> DataFrame:
    return lines.groupBy("product_id").agg(F.sum("units").alias("units"), F.sum("revenue_e4").alias("revenue_e4"))


def top_sellers(sales: DataFrame, products: DataFrame, n: int = 10) -> DataFrame:
    """The n products with most units; ties go to the smaller product number."""
    best = sales.orderBy(F.desc("units"), "product_id").limit(n)
    # At most n rows.
    return F.broadcast(best).join(products.select("product_id", "name", "category"), "product_id")


def slow_movers(products: DataFrame, sales: DataFrame, opening_units: Column) -> DataFrame:
    """Products that sold less than a quarter of their opening stock, also none at all."""
    sold = F.coalesce("units", F.lit(0))
    return (
        products.join(sales, "product_id", "left")
        .filter(sold * 4 < opening_units)
        .select("product_id", "name", sold.alias("units_sold"), opening_units.alias("opening_units"))
    )


def order_value(lines: DataFrame) -> DataFrame:
    """Per customer: orders, average order value and orders per year."""
    per_order = lines.groupBy("customer_id", "order_id").agg(
        F.sum("revenue_e4").alias("revenue_e4"), F.min("order_ms").alias("order_ms")
    )
    n = F.count(F.lit(1))
    days = (F.max("order_ms") - F.min("order_ms")) / DAY + 1
    return per_order.groupBy("customer_id").agg(
        n.alias("orders"),
        F.round(F.sum("revenue_e4") / n / 10_000, 6).alias("average_value"),
        F.round(n * 365 / days, 6).alias("orders_per_year"),
    )


def turnover(products: DataFrame, sales: DataFrame, levels: DataFrame, opening_each: Column, locations: int) -> DataFrame:
    """Units or cost sold over average stock, per product and per category.

    Opening and closing stock are taken over all locations; one where a product did not move
    closes as it opened.
    """
    closing = levels.groupBy("product_id").agg(F.sum("on_hand").alias("closing"), F.count(F.lit(1)).alias("_moved"))
    still = locations - F.coalesce("_moved", F.lit(0))
    base = (
        products.join(sales.select("product_id", "units"), "product_id", "left")
        .join(closing, "product_id", "left")
        .select(
            "product_id",
            "category",
            F.coalesce("units", F.lit(0)).alias("sold"),
            (opening_each * (locations + still) + F.coalesce("closing", F.lit(0))).alias("stock2"),
            "cost_cents",
        )
    )
    by_product = base.select(
        F.lit("product").alias("grain"), F.col("product_id").cast("string").alias("item"), "sold", "stock2"
    )
    by_category = base.groupBy("category").agg(
        F.sum(F.col("sold") * F.col("cost_cents")).alias("sold"), F.sum(F.col("stock2") * F.col("cost_cents")).alias("stock2")
    ).select(F.lit("category").alias("grain"), F.col("category").alias("item"), "sold", "stock2")
    rate = F.when(F.col("stock2") > 0, F.round(F.col("sold") * 2 / F.col("stock2"), 6))
    return by_product.unionByName(by_category).select(
        "grain",
        "item",
        "sold",
        rate.alias("rate"),
        F.when(rate.isNull(), "no stock").when(rate >= 1, "fast").when(rate < 0.25, "slow").otherwise("normal").alias("pace"),
    )


def stock_value(status: DataFrame, products: DataFrame) -> DataFrame:
    """Stock report: units, value at cost and status."""
    return status.join(products, "product_id").select(
        "product_id", "name", "category", "location_id", "on_hand",
        (F.col("on_hand") * F.col("cost_cents")).alias("value_cents"), "status",
    )


def preferred_suppliers(lines: DataFrame) -> DataFrame:
    """Supplier that delivered a product most often; ties go to the smaller number."""
    per = lines.groupBy("product_id", "supplier_id").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("product_id").agg(
        F.max_by("supplier_id", F.struct("n", -F.col("supplier_id"))).alias("supplier_id")
    )


def po_suggestions(status: DataFrame, suppliers: DataFrame, as_of_ms: int) -> DataFrame:
    """Draft purchase order for every product and location at or below its reorder point."""
    lead = F.lit(3) + F.col("supplier_id") % 10
    return (
        status.filter(F.col("status").isin("low", "out"))
        .join(suppliers, "product_id", "left")
        .select(
            "product_id", "location_id", "available", "reorder_point", F.col("reorder_qty").alias("suggested_qty"),
            "supplier_id", (F.lit(as_of_ms) + lead * DAY).alias("expected_ms"), F.lit("DRAFT").alias("po_status"),
        )
    )


def po_by_supplier(orders: DataFrame, as_of_ms: int) -> DataFrame:
    """Value, open and overdue purchase orders per supplier."""
    is_open = F.col("status") != "RECEIVED"
    overdue = is_open & (F.col("expected_ms") < as_of_ms)
    return orders.groupBy("supplier_id").agg(
        F.count(F.lit(1)).alias("orders"),
        F.sum("value_cents").alias("value_cents"),
        F.count_if(is_open).alias("open_orders"),
        F.count_if(F.col("status") == "SENT").alias("sent_orders"),
        F.sum(F.when(is_open, F.col("value_cents")).otherwise(0)).alias("open_value_cents"),
        F.count_if(overdue).alias("overdue_orders"),
    )


def supplier_score(orders: DataFrame) -> DataFrame:
    """On-time and accuracy rate, mean lead time and defect rate per supplier."""
    done = orders.filter("received_ms IS NOT NULL")
    n = F.count(F.lit(1))
    return done.groupBy("supplier_id").agg(
        n.alias("deliveries"),
        F.round(F.count_if(F.col("received_ms") <= F.col("expected_ms")) / n, 6).alias("on_time_rate"),
        F.round(F.count_if(F.col("received") == F.col("units")) / n, 6).alias("accuracy_rate"),
        F.round(F.sum((F.col("received_ms") - F.col("ordered_ms")) / DAY) / n, 6).alias("mean_lead_days"),
        F.round(F.sum("defects") / F.sum("units"), 6).alias("defect_rate"),
    )


def dashboard(status: DataFrame, products: DataFrame, lines: DataFrame, orders: DataFrame, as_of_ms: int) -> DataFrame:
    """Headline numbers, one row each."""
    recent = (F.col("order_ms") <= as_of_ms) & (F.col("order_ms") > as_of_ms - 30 * DAY)
    value = status.join(products.select("product_id", "cost_cents"), "product_id").agg(
        F.sum(F.col("on_hand") * F.col("cost_cents")).alias("stock_value_cents"),
        F.count_if(F.col("status") == "low").alias("low_stock"),
        F.count_if(F.col("status") == "out").alias("out_of_stock"),
    )
    parts = [
        products.agg(F.count(F.lit(1)).alias("products")),
        value,
        lines.filter(recent).agg(F.countDistinct("order_id").alias("recent_orders")),
        orders.filter("status <> 'RECEIVED'").agg(F.count(F.lit(1)).alias("pending_purchases")),
    ]
    rows = [
        p.select(F.inline(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("value")) for c in p.columns])))
        for p in parts
    ]
    return reduce(DataFrame.unionByName, rows)
