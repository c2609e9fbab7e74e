"""Change events: each record against the last accepted record of its key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyledger.functions.fixed_values import CANCEL_EVENT_STATUSES, POSITIVE_ONLY
from skyledger.functions.scalars import changed
from skyledger.operators.ordered import Ordered, previous, running_max


def quarantined(records: DataFrame) -> DataFrame:
    """Records without a source time: they cannot be compared and are kept apart, with the reason."""
    return records.filter(F.col("source_ts_ms").isNull()).withColumn("error", F.lit("no source time"))


def in_arrival_order(records: DataFrame) -> Ordered:
    """Records with a source time, in arrival order within their flight."""
    return Ordered.of(
        records.filter(F.col("source_ts_ms").isNotNull()),
        keys=["flight_key"],
        order=["event_id"],
    )


def accepted(records: Ordered) -> Ordered:
    """Drop late and duplicate records: the source time must pass all earlier ones."""
    marked = records.scan(running_max("source_ts_ms", "_latest", inclusive=False))
    return records.on(
        marked.df.filter(F.col("_latest").isNull() | (F.col("source_ts_ms") > F.col("_latest"))).drop("_latest")
    )


def disposition(records: DataFrame) -> DataFrame:
    """What becomes of every record: accepted, late or quarantined."""
    slim = records.select("flight_key", "event_id", "source_ts_ms")
    marked = in_arrival_order(slim).scan(running_max("source_ts_ms", "_latest", inclusive=False)).rows()
    passed = F.col("_latest").isNull() | (F.col("source_ts_ms") > F.col("_latest"))
    timed = marked.select("flight_key", "event_id", F.when(passed, "accepted").otherwise("late").alias("disposition"))
    apart = quarantined(slim).select("flight_key", "event_id", F.lit("quarantined").alias("disposition"))
    return timed.unionByName(apart)


def unpivot_changes(tracked: dict[str, str], old: str | None, extra: list[Column] = ()) -> Column:
    """Array of (event_type, value) for the tracked columns that changed.

    `old` names the struct with the previous record; with None every non-null
    value counts.
    """
    items = []
    for kind, column in tracked.items():
        new = F.col(column)
        moved = new.isNotNull() if old is None else changed(new, F.col(f"{old}.{column}"))
        if kind in POSITIVE_ONLY:
            moved = moved & (new > 0)
        items.append(
            F.when(moved, F.struct(F.lit(kind).alias("event_type"), new.cast("string").alias("value")))
        )
    return F.filter(F.array(*items, *extra), lambda x: x.isNotNull())


def cancel_item() -> Column:
    """Cancel event raised by the state itself; a deleted flight raises none."""
    raised = F.col("leg_status").isin(*CANCEL_EVENT_STATUSES) & ~F.col("dep_status").eqNullSafe(F.lit("CANCELLED"))
    return F.when(raised, F.struct(F.lit("CANCEL").alias("event_type"), F.col("leg_status").alias("value")))


def emit(paired: DataFrame, tracked: dict[str, str], with_cancel: bool) -> DataFrame:
    """One row per change of every record paired with the one before it (`_old`)."""
    extra = [cancel_item()] if with_cancel else []
    return paired.select(
        "flight_key",
        "event_id",
        "source_ts_ms",
        F.inline(unpivot_changes(tracked, "_old", extra)),
    ).select(
        "flight_key", "event_id", F.lit("").alias("previous"), "source_ts_ms", "value", "event_type"
    )


def _pairs(kept: Ordered, columns: list[str]) -> DataFrame:
    return kept.on(kept.df.withColumn("_me", F.struct(*columns))).scan(previous("_me", "_old")).rows()


def tracked_columns(tracked: dict[str, str], with_cancel: bool = False) -> list[str]:
    """Columns a record needs: the tracked ones, and the statuses for cancels."""
    return list(dict.fromkeys([*tracked.values(), *(("leg_status", "dep_status") if with_cancel else ())]))


def atomic_events(records: DataFrame, tracked: dict[str, str], with_cancel: bool = False) -> DataFrame:
    """Change events of all records: late records out, then neighbours compared."""
    columns = tracked_columns(tracked, with_cancel)
    slim = records.select("flight_key", "event_id", "source_ts_ms", *columns)
    return emit(_pairs(accepted(in_arrival_order(slim)), columns), tracked, with_cancel)


def advance(
    state: DataFrame | None, batch: DataFrame, tracked: dict[str, str], with_cancel: bool = False, keep=None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One micro-batch: (rows both results derive from, change events, new state).

    The state holds the last accepted record of the batch's flights and comes first
    in its flight's order; the batch follows in arrival order.  `keep` writes the rows
    that both results derive from and reads them back.
    """
    columns = tracked_columns(tracked, with_cancel)
    wanted = ("flight_key", "event_id", "source_ts_ms", *columns)
    rows = batch.select(*wanted, F.lit(1).alias("_new")).filter(F.col("source_ts_ms").isNotNull())
    if state is not None:
        rows = state.select(*wanted, F.lit(0).alias("_new")).unionByName(rows)
    line = Ordered.of(
        rows,
        keys=["flight_key"],
        order=["_new", "event_id"],
    )
    paired = _pairs(accepted(line), columns)
    paired = keep(paired) if keep else paired
    last = F.max_by(F.struct(*wanted[1:]), F.struct("_new", "event_id"))
    new_state = paired.groupBy("flight_key").agg(last.alias("r")).select("flight_key", "r.*")
    return paired, emit(paired.filter("_new = 1"), tracked, with_cancel), new_state
