"""Stock-shaped relations derived from the order tables.

Parts are products, supplier nations are locations.  Quantities are whole
units and money whole cents, so sums are exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skyledger.sources.flights import epoch_ms
from skyledger.sources.tables import table

DAY = 86_400_000
DAMAGED_TAX = 0.0


def cents(col: str):
    return F.round(F.col(col) * 100).cast("long")


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("product_id"),
        F.col("p_name").alias("name"),
        F.col("p_type").alias("category"),
        F.col("p_size").cast("long").alias("size"),
        cents("p_retailprice").alias("cost_cents"),
    )


def locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The location table: each location with its region and the next location in number order."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    order = Window.orderBy("n_nationkey")
    # A reference list of one row per nation; the last location is followed by the first.
    first = F.first("n_nationkey").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    after = nation.withColumn("after", F.coalesce(F.lead("n_nationkey").over(order), first))
    return after.join(F.broadcast(region), nation.n_regionkey == region.r_regionkey).select(
        F.col("n_nationkey").cast("long").alias("location_id"),
        F.col("r_name").alias("region"),
        F.col("after").cast("long").alias("next_location_id"),
    )


def reorder_point(size: Column, location: Column) -> Column:
    """Stock at which a product is ordered again at a location."""
    return (size * (F.lit(1) + location % 3) / 2).cast("long")


def reorder_qty(size: Column) -> Column:
    return size * 20


def opening_units(size: Column) -> Column:
    """Opening stock of a product at every location that stocks it."""
    return size * 2


# Columns of an order line that need a joined table.
_OF_ORDER = {"customer_id", "order_status", "order_ms"}
_OF_SUPPLIER = {"location_id"}


def order_lines(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Order lines with the given columns; only the tables that these need are joined."""
    line = table(spark, sf_dir, "lineitem")
    disc = F.round(F.col("l_discount") * 100).cast("long")
    known = {
        "order_id": F.col("l_orderkey"),
        "customer_id": F.col("o_custkey"),
        "product_id": F.col("l_partkey"),
        "supplier_id": F.col("l_suppkey"),
        "line_no": F.col("l_linenumber").cast("long"),
        "location_id": F.col("s_nationkey").cast("long"),
        "units": F.col("l_quantity").cast("long"),
        "revenue_e4": cents("l_extendedprice") * (F.lit(100) - disc),
        "return_flag": F.col("l_returnflag"),
        "line_status": F.col("l_linestatus"),
        "untaxed": F.col("l_tax") == DAMAGED_TAX,
        "order_status": F.col("o_orderstatus"),
        "order_ms": epoch_ms("o_orderdate"),
        "ship_ms": epoch_ms("l_shipdate"),
    }
    wanted = columns or tuple(known)
    if _OF_ORDER & set(wanted):
        line = line.join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    if _OF_SUPPLIER & set(wanted):
        line = line.join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return line.select(*[known[c].alias(c) for c in wanted])


def purchase_orders(spark: SparkSession, sf_dir: str, with_value: bool = True) -> DataFrame:
    """Every order line read as a purchase from its supplier, with its value if asked."""
    line = order_lines(
        spark, sf_dir,
        "order_id", "line_no", "product_id", "supplier_id", "units", "return_flag", "line_status", "order_ms",
    )
    if with_value:
        cost = products(spark, sf_dir).select("product_id", "cost_cents")
        line = line.join(cost, "product_id").withColumn("value_cents", F.col("units") * F.col("cost_cents"))
    got = F.col("line_status") == "F"
    return line.select(
        "order_id",
        "line_no",
        "supplier_id",
        "product_id",
        "units",
        *(["value_cents"] if with_value else []),
        F.when(got & (F.col("line_no") % 7 == 0), F.col("units") - 1).when(got, F.col("units")).otherwise(0).alias("received"),
        F.when(got & (F.col("return_flag") == "R"), F.floor(F.col("units") / 10)).otherwise(0).alias("defects"),
        F.col("order_ms").alias("ordered_ms"),
        (F.col("order_ms") + (F.lit(25) + F.col("supplier_id") % 5) * DAY).alias("expected_ms"),
        F.when(got, F.col("order_ms") + (F.lit(10) + F.col("product_id") % 30) * DAY).alias("received_ms"),
        F.when(got, "RECEIVED").when(F.col("return_flag") == "N", "CONFIRMED").otherwise("SENT").alias("status"),
    )
