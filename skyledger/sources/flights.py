"""Flight-shaped relations derived from the order tables.

Every order is one line of flying (a chain of legs of one aircraft), every line
item one leg.  All times are BIGINT epoch milliseconds in UTC.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyledger.functions.fixed_values import DELAY_TYPES
from skyledger.operators.ordered import Ordered, following, hot_hashes, lookup_join, previous, rank
from skyledger.sources.tables import table

MINUTE = 60_000
DAY = 86_400_000

def epoch_ms(col: str) -> Column:
    """Milliseconds of a zone-less timestamp read as UTC."""
    return F.unix_millis(F.col(col).cast("timestamp"))


def pick(names: tuple[str, ...], index: Column) -> Column:
    """Element of a short list of names by position from 0."""
    return F.element_at(F.array(*[F.lit(n) for n in names]), (index + 1).cast("int"))


def _order_columns(orders: DataFrame) -> DataFrame:
    return orders.select(
        F.col("o_orderkey").alias("chain_id"),
        F.col("o_custkey").alias("tail_no"),
        epoch_ms("o_orderdate").alias("order_ms"),
    )


def leg_columns(df: DataFrame, air_min: Column) -> DataFrame:
    """Adds what follows from a leg's own row: its order, its place in the line and its minutes in the air."""
    std = F.col("order_ms") + (F.col("leg_seq") - 1) * (120 * MINUTE)
    return (
        df.withColumns(
            {
                "std_ms": std,
                "air_min": air_min,
                "mogt_min": F.lit(20) + F.col("part_id") % 5 * 10,
            }
        )
        .withColumns(
            {
                "sta_ms": F.col("std_ms") + F.col("air_min") * MINUTE,
                "ltd_ms": F.col("std_ms") + F.when(F.col("supp_id") % 7 == 0, 25 * MINUTE).otherwise(0),
            }
        )
        .withColumns(
            {
                "lta_ms": F.greatest("sta_ms", "ltd_ms"),
                "ptd_ms": F.col("ltd_ms"),
                "pta_ms": F.greatest(F.col("sta_ms"), F.col("ltd_ms") + F.col("air_min") * MINUTE),
                "equip_ready_ms": F.when(
                    F.col("part_id") % 4 != 0, F.col("std_ms") + F.col("part_id") % 4 * (30 * MINUTE)
                ),
                "cabin_ready_ms": F.when(F.col("part_id") % 3 != 0, F.col("std_ms") + 5 * MINUTE),
                "cockpit_ready_ms": F.when(F.col("part_id") % 6 == 0, F.col("std_ms") + 40 * MINUTE),
                "flight_key": F.concat_ws("-", "chain_id", "leg_seq"),
                "leg_status": F.when(F.col("part_id") % 29 == 0, "CANCELLED")
                .when(F.col("part_id") % 31 == 0, "ROUTE_OUT")
                .otherwise("ACTIVE"),
            }
        )
    )


def legs(spark: SparkSession, sf_dir: str) -> Ordered:
    """All legs, ordered by `leg_seq` within `chain_id`."""
    items = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("chain_id"),
        F.col("l_partkey").alias("part_id"),
        F.col("l_suppkey").alias("supp_id"),
        F.col("l_linenumber").alias("line_no"),
        F.col("l_quantity").cast("long").alias("qty"),
        F.unix_micros(F.col("l_shipdate").cast("timestamp")).alias("ship_us"),
    )
    hashes = hot_hashes(items, ["chain_id"])
    joined = lookup_join(items, _order_columns(table(spark, sf_dir, "orders")), "chain_id", hashes, "inner")
    ranked = Ordered.of(
        joined,
        keys=["chain_id"],
        order=["ship_us", "line_no", "part_id", "supp_id", "qty"],
        hashes=hashes,
    ).scan(rank("leg_seq"))

    df = leg_columns(ranked.df, F.lit(30) + F.col("qty")).drop("ship_us", "qty")
    return Ordered(df, ("chain_id",), ("leg_seq",), ranked.split, ranked.hashes)


def delay_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One delay event per chain, aimed at its first or second leg."""
    return delay_events_of(table(spark, sf_dir, "orders"))


def delay_events_of(orders: DataFrame) -> DataFrame:
    """The same for a batch or a streaming `orders` frame."""
    chain = F.col("chain_id")
    target = F.lit(1) + chain % 2
    kind = pick(DELAY_TYPES, chain % 11)
    late = F.when(kind.isin("ACTUAL_ON_CHANGE", "ACTUAL_IN_CHANGE"), 60 * MINUTE).otherwise(0)
    at = F.col("order_ms") + (target - 1) * (120 * MINUTE)
    return _order_columns(orders).select(
        "chain_id",
        target.alias("event_seq"),
        kind.alias("event_type"),
        (at + chain % 7 * (30 * MINUTE) + late).cast("string").alias("value"),
        (at - 30 * MINUTE + chain % 6 * (25 * MINUTE)).alias("prev_leg_pta_ms"),
    )


def flight_columns(df: DataFrame) -> DataFrame:
    """Adds airline, number, date, arrival station and tail."""
    return df.withColumns(
        {
            "airline": F.concat(F.lit("A"), F.col("tail_no") % 3),
            "flight_number": (F.col("part_id") % 4).cast("string"),
            "flight_date": F.date_format(F.timestamp_millis("std_ms"), "yyyy-MM-dd"),
            "arr_station": F.concat(F.lit("S"), F.col("supp_id") % 5),
            "tail": F.when(F.col("part_id") % 6 != 0, F.concat(F.lit("T"), F.col("tail_no"))),
        }
    )


def flights(legs_: Ordered, beside: tuple[str, ...] = ()) -> Ordered:
    """Adds airline, number, date, stations, tail and both neighbour keys.

    `beside` are columns of the leg before, wanted as `prev_*`.
    """
    with_attrs = legs_.on(
        flight_columns(legs_.df).withColumn("_me", F.struct("flight_key", "flight_number", "flight_date", "arr_station", *beside))
    ).scan(previous("_me", "_prev"), following("_me", "_next"))
    return with_attrs.on(
        with_attrs.df.withColumns(
            {
                "prev_leg_key": F.col("_prev.flight_key"),
                "prev_number": F.col("_prev.flight_number"),
                "prev_date": F.col("_prev.flight_date"),
                "next_leg_key": F.col("_next.flight_key"),
                "dep_station": F.coalesce(
                    "_prev.arr_station", F.concat(F.lit("S"), (F.col("supp_id") + 1) % 5)
                ),
                **{f"prev_{c}": F.col(f"_prev.{c}") for c in beside},
            }
        ).drop("_me", "_prev", "_next")
    )


def hot_duties(spark: SparkSession, sf_dir: str) -> list[int]:
    """Hashes of the duties with very many legs, from the one column that decides it."""
    return hot_hashes(table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("duty")), ["duty"])


def crew_assignments(legs_: DataFrame, hashes: list[int], with_request: bool = False, beside: tuple[str, ...] = ()) -> DataFrame:
    """Crew duties: each part is a duty that works its legs in departure order.

    `hashes` are those of the very large duties; `with_request` adds the leg's request type;
    `beside` are columns of the inbound leg, wanted as `prev_*`.
    """
    # The key stands in the struct only, so that it is shuffled once.
    own = ["request_type"] if with_request else []
    theirs = [f"prev_{c}" for c in beside]
    cols = legs_.select(
        F.col("part_id").alias("duty"), F.struct("flight_key", *beside).alias("_me"), "std_ms", "chain_id", "leg_seq", "line_no", "supp_id", *own
    )
    linked = Ordered.of(
        cols,
        keys=["duty"],
        order=["std_ms", "chain_id", "leg_seq"],
        hashes=hashes,
    ).scan(previous("_me", "_prev"), following("_me", "_next"))
    seats = F.when(
        F.col("line_no") % 2 == 0, F.array(F.lit("CREW"), F.lit("PILOT"))
    ).otherwise(F.array(F.lit("CREW")))
    return linked.rows().select(
        "_me.flight_key",
        F.explode(seats).alias("_seat"),
        "duty",
        F.col("_prev.flight_key").alias("prev_flight_key"),
        F.col("_next.flight_key").alias("next_flight_key"),
        F.col("supp_id"),
        *own,
        *[F.col(f"_prev.{c}").alias(n) for c, n in zip(beside, theirs)],
    ).select(
        "flight_key",
        F.concat_ws("-", F.col("_seat"), "duty").alias("duty_key"),
        F.when(F.col("_seat") == "PILOT", "P")
        .when(F.col("duty") % 3 == 0, "F")
        .otherwise("C")
        .alias("crew_type"),
        F.when(F.col("_seat") == "PILOT", "CA").otherwise("FA").alias("seat"),
        "prev_flight_key",
        "next_flight_key",
        (F.lit(30) + F.col("duty") % 4 * 10).alias("turn_min"),
        (F.col("supp_id") % 10 == 0).alias("deadhead"),
        *own,
        *theirs,
    )
