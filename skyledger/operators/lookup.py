"""Lookups as joins: inbound legs, crew, overlays, previous-leg resolution."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyledger.operators.ordered import Ordered, hot_frame, hot_hashes, last_known
from skyledger.session import settle

_FLIGHT_KEY = ("airline", "flight_date", "flight_number", "arr_station", "snapshot_id")


def prefixed(df: DataFrame, prefix: str, columns: Sequence[str]) -> DataFrame:
    """Only the given columns, each with a prefix."""
    return df.select(*[F.col(c).alias(f"{prefix}{c}") for c in columns])


def spread_nulls(key: str, own: str = "flight_key") -> Column:
    """Join key whose nulls become distinct values that match nothing.

    Plain nulls of a left join would all meet in one partition.
    """
    return F.coalesce(F.col(key), F.concat(F.lit("~"), F.col(own)))


def inbound(legs: DataFrame, times: DataFrame, key: str, columns: Sequence[str], how: str = "left") -> DataFrame:
    """Legs with the times of the leg named in `key`, as `in_*` columns."""
    other = prefixed(times, "in_", ["flight_key", *columns])
    wanted = spread_nulls(key) if how == "left" else F.col(key)
    return legs.join(other, wanted == F.col("in_flight_key"), how)


def by_ids(keys: DataFrame, state: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows of a state table for a set of keys, with the wanted columns only."""
    return state.select("flight_key", *columns).join(keys.select("flight_key").distinct(), "flight_key", "left_semi")


def overlay(live: DataFrame, snap: DataFrame, request: str, columns: Sequence[str]) -> DataFrame:
    """Per field: the what-if value of the request, else the live value."""
    mine = prefixed(snap.filter(F.col("snapshot_id") == request), "_s_", ["flight_key", *columns])
    joined = live.join(mine, F.col("flight_key") == F.col("_s_flight_key"), "left")
    return joined.withColumns({c: F.coalesce(f"_s_{c}", c) for c in columns}).drop(
        "_s_flight_key", *[f"_s_{c}" for c in columns]
    )


def overlay_row(live: DataFrame, snap: DataFrame, request: str, columns: Sequence[str]) -> DataFrame:
    """The whole what-if row of the request if there is one, else the live row."""
    mine = snap.filter(F.col("snapshot_id") == request).select(
        F.col("flight_key").alias("_s_key"), F.struct(*columns).alias("_s")
    )
    joined = live.join(mine, F.col("flight_key") == F.col("_s_key"), "left")
    found = F.col("_s").isNotNull()
    return joined.withColumns(
        {c: F.when(found, F.col(f"_s.{c}")).otherwise(F.col(c)) for c in columns}
        | {"from_snapshot": found}
    ).drop("_s", "_s_key")


def _joined_text(*parts: Column) -> Column:
    """Parts as one text, each behind its length; null if any part is null, and never equal otherwise."""
    return F.concat(*[F.concat(F.length(x).cast("string"), F.lit(":"), x) for x in parts])


def _match_key(airline: str, date: str, number: str, station: str, snapshot: str) -> Column:
    """The five columns without case; null, which matches nothing, if one of them is null."""
    return _joined_text(*[F.lower(F.col(c)) for c in (airline, date, number, station, snapshot)])


def candidate_counts(candidates: DataFrame) -> DataFrame:
    """Candidates per match key and tail without case, with the key of the only one."""
    return candidates.filter("_match IS NOT NULL").groupBy("_match", F.lower("tail").alias("_tail")).agg(
        F.count(F.lit(1)).alias("_n"), F.min("flight_key").alias("_only")
    )


def _wanted(current: DataFrame) -> DataFrame:
    """Legs with the match key of the previous flight they name, if any."""
    named = F.col("prev_number").isNotNull() & F.col("prev_date").isNotNull()
    key = _match_key("airline", "prev_date", "prev_number", "dep_station", "snapshot_id")
    return current.withColumn("_match", F.when(named, key))


def previous_leg_counts(current: DataFrame, flights: DataFrame) -> DataFrame:
    """Adds how many flights could be the previous leg, and how many after the tail test.

    A candidate shares airline, date, number and snapshot with the wanted
    previous flight and arrives at our departure station, compared without
    case.  The tail test drops candidates flown by another aircraft; an unknown
    tail on either side drops nothing.  Candidates are counted per key before
    they are joined, so no pairs are formed.
    """
    wanted = _wanted(current)
    found = flights.withColumn("_match", _match_key(*_FLIGHT_KEY))
    per_tail = candidate_counts(found)
    per_key = per_tail.groupBy("_match").agg(
        F.sum("_n").alias("n_candidates"),
        F.min("_only").alias("_only_all"),
        F.sum(F.when(F.col("_tail").isNull(), F.col("_n"))).alias("_n_free"),
        F.min(F.when(F.col("_tail").isNull(), F.col("_only"))).alias("_only_free"),
    )
    same = per_tail.filter(F.col("_tail").isNotNull()).select(
        "_match", F.col("_tail").alias("tail"), F.col("_n").alias("_n_same"), F.col("_only").alias("_only_same")
    )
    named = wanted.withColumn("_want", spread_nulls("_match")).withColumn("_craft", F.lower(spread_nulls("tail")))
    joined = (
        named.join(per_key.withColumnRenamed("_match", "_want"), "_want", "left")
        .join(same.withColumnsRenamed({"_match": "_want", "tail": "_craft"}), ["_want", "_craft"], "left")
        .drop("_want", "_craft")
    )
    free = F.coalesce("_n_free", F.lit(0))
    kept = F.when(F.col("tail").isNull(), F.col("n_candidates")).otherwise(
        F.coalesce("_n_same", F.lit(0)) + free
    )
    only = F.when(F.col("tail").isNull(), F.col("_only_all")).otherwise(F.least("_only_same", "_only_free"))
    return joined.withColumns(
        {
            "n_candidates": F.coalesce("n_candidates", F.lit(0)),
            "n_after_tail": F.coalesce(kept, F.lit(0)),
            "_only_kept": only,
        }
    )


def _offers(flights: DataFrame) -> DataFrame:
    """Candidates under their groups: by tail or tail unknown, and all together."""
    match = F.col("_match")
    own = F.when(F.col("tail").isNull(), _joined_text(match, F.lit("free"))).otherwise(
        _joined_text(match, F.lit("tail"), F.lower("tail"))
    )
    return flights.withColumn("_match", _match_key(*_FLIGHT_KEY)).filter("_match IS NOT NULL").select(
        F.explode(F.array(own, _joined_text(match, F.lit("every")))).alias("grp"),
        "std_ms",
        F.lit(0).alias("asks"),
        "flight_key",
        F.struct("std_ms", "flight_key").alias("cand"),
    )


def _questions(current: DataFrame) -> DataFrame:
    """Legs under the groups they may choose from."""
    match = F.col("_match")
    every = F.array(_joined_text(match, F.lit("every")))
    known = F.array(_joined_text(match, F.lit("tail"), F.lower("tail")), _joined_text(match, F.lit("free")))
    return current.select(
        F.explode(F.when(F.col("tail").isNull(), every).otherwise(known)).alias("grp"),
        "std_ms",
        F.lit(1).alias("asks"),
        "flight_key",
        F.lit(None).cast("struct<std_ms:bigint,flight_key:string>").alias("cand"),
    )


def _nearest_earlier(several: DataFrame, flights: DataFrame) -> DataFrame:
    """Latest kept candidate departing no later than the leg, other than itself.

    Only groups that some leg asks for are laid out.  Candidates and legs stand in
    one sequence per match group; each leg reads the last candidate before it, and
    the one before that for the case that the last is the leg itself.
    """
    asked = settle(_questions(several), "asked")
    groups = settle(asked.select("grp").distinct(), "groups")
    offered = _offers(flights).join(groups, "grp", "left_semi")
    line = Ordered.of(
        settle(offered.unionByName(asked), "offers"),
        keys=["grp"],
        order=["std_ms", "asks", "flight_key"],
    ).scan(last_known("cand", "_before", inclusive=False))
    pair = F.when(F.col("asks") == 0, F.struct("cand", "_before"))
    line = line.on(line.df.withColumn("pair", pair)).scan(last_known("pair", "last"))
    pick = F.when(F.col("last.cand.flight_key") != F.col("flight_key"), F.col("last.cand")).otherwise(
        F.col("last._before")
    )
    return (
        line.rows()
        .filter("asks = 1")
        .groupBy("flight_key")
        .agg(F.max(pick).alias("_near"))
        .select("flight_key", F.col("_near.flight_key").alias("_near_key"))
    )


def _by_counts(current: DataFrame, flights: DataFrame) -> DataFrame:
    """Counts, only and nearest candidates of legs whose match groups are very large."""
    counted = settle(previous_leg_counts(current, flights), "counted")
    near = _nearest_earlier(counted.filter((F.col("n_candidates") > 1) & (F.col("n_after_tail") > 1)), flights)
    return counted.join(near, "flight_key", "left").select(*_SETTLED)


def _nearest(line: Ordered, cand: str, out: str) -> Ordered:
    """Adds the last `cand` of the line before each row, other than the row itself."""
    line = line.scan(last_known(cand, "_before", inclusive=False))
    pair = F.when(F.col(cand).isNotNull(), F.struct(F.col(cand).alias("cand"), "_before"))
    line = line.on(line.df.withColumn("_pair", pair)).scan(last_known("_pair", "_last"))
    pick = F.when(F.col("_last.cand.flight_key") != F.col("flight_key"), F.col("_last.cand")).otherwise(F.col("_last._before"))
    return line.on(line.df.withColumn(out, pick).drop("_before", "_pair", "_last"))


def _in_groups(asking: DataFrame, offered: DataFrame) -> DataFrame:
    """The same of legs whose match groups fit a task.

    Candidates and legs of a group meet by one shuffle; counts and nearest candidates are windows
    over the group and over its aircraft.
    """
    both = asking.withColumn("asks", F.lit(1)).unionByName(offered.withColumn("asks", F.lit(0))).repartition("_match")
    cand = F.when(F.col("asks") == 0, F.struct("std_ms", "flight_key"))
    both = both.withColumns({"_craft": F.lower("tail"), "_any": cand, "_open": F.when(F.col("tail").isNull(), cand)})
    every = Ordered.of(both, keys=["_match"], order=["std_ms", "asks", "flight_key"], hashes=[])
    every = _nearest(_nearest(every, "_any", "_near_any"), "_open", "_near_open")
    craft = _nearest(every.on(every.df, more_keys=("_craft",)), "_any", "_near_same").rows()
    group, same = Window.partitionBy("_match"), Window.partitionBy("_match", "_craft")
    counts = {
        f"{name}{kind}": f.over(over)
        for kind, c, over in (("_any", "_any", group), ("_open", "_open", group), ("_same", "_any", same))
        for name, f in (("_n", F.count(c)), ("_only", F.min(f"{c}.flight_key")))
    }
    free = F.col("tail").isNull()
    return craft.withColumns(counts).filter("asks = 1").select(
        "flight_key",
        F.col("_n_any").alias("n_candidates"),
        F.when(free, F.col("_n_any")).otherwise(F.col("_n_same") + F.col("_n_open")).alias("n_after_tail"),
        F.col("_only_any").alias("_only_all"),
        F.when(free, F.col("_only_any")).otherwise(F.least("_only_same", "_only_open")).alias("_only_kept"),
        F.when(free, F.col("_near_any")).otherwise(F.greatest("_near_same", "_near_open"))["flight_key"].alias("_near_key"),
    )


# What settles a previous leg.
_SETTLED = ("flight_key", "n_candidates", "n_after_tail", "_only_all", "_only_kept", "_near_key")


def resolve_previous_leg(current: DataFrame, flights: DataFrame) -> DataFrame:
    """Previous leg of every flight and the rule that settled it.

    Legs and candidates of a match group meet in one task; those of very large groups are counted
    per key and laid out in blocks.
    """
    asking, offered = _wanted(current), flights.withColumn("_match", _match_key(*_FLIGHT_KEY)).filter("_match IS NOT NULL")
    named, own = asking.filter("_match IS NOT NULL"), ("flight_key", "tail", "std_ms", "_match")
    hashes = hot_hashes(named.select("_match").unionByName(offered.select("_match")), ["_match"])
    if hashes:
        hot, matches = F.broadcast(hot_frame(current, hashes)), F.xxhash64("_match") == F.col("_hot")
        large = _by_counts(*[df.join(hot, matches, "left_semi").drop("_match") for df in (named, offered)])
        named, offered = (df.join(hot, matches, "left_anti") for df in (named, offered))
    found = _in_groups(named.select(*own), offered.select(*own))
    found = found.unionByName(large) if hashes else found
    none, text = F.lit(0).cast("long"), F.lit(None).cast("string")
    unnamed = asking.filter("_match IS NULL").select("flight_key", *[x.alias(c) for c, x in zip(_SETTLED[1:], (none, none, text, text, text))])
    rule = (
        F.when(F.col("n_candidates") == 0, "none")
        .when(F.col("n_candidates") == 1, "single")
        .when(F.col("n_after_tail") == 0, "none")
        .when(F.col("n_after_tail") == 1, "tail")
        .otherwise("nearest")
    )
    ruled = found.unionByName(unnamed).withColumn("rule", rule)
    key = (
        F.when(F.col("rule") == "single", F.col("_only_all"))
        .when(F.col("rule") == "tail", F.col("_only_kept"))
        .when(F.col("rule") == "nearest", F.col("_near_key"))
    )
    return ruled.select("flight_key", "n_candidates", "n_after_tail", "rule", key.alias("resolved_key"))


def tail_ready(legs: DataFrame, tails: DataFrame, turn_min: Column) -> DataFrame:
    """When each leg's aircraft is back in service, plus the turn."""
    back = F.when(F.col("ots"), F.col("est_return_ms")).otherwise(F.col("return_ms"))
    service = tails.withColumnsRenamed({"airline": "_airline", "tail": "_craft"})
    same = (F.col("airline") == F.col("_airline")) & (spread_nulls("tail") == F.col("_craft"))
    return legs.join(service, same, "left").withColumn("tail_ready_ms", back + turn_min * 60_000).drop(
        "_airline", "_craft"
    )


def crew_context(crew: DataFrame, flights: DataFrame, airports: DataFrame) -> DataFrame:
    """Each inbound crew member with where they come from and on which aircraft.

    `airports` is a fixed reference list and is broadcast.
    """
    mine = flights.select(
        "flight_key",
        F.col("dep_station").alias("departure_station"),
        F.col("tail").alias("departure_tail"),
        F.col("airline").alias("departure_airline"),
        F.col("gate").alias("departure_gate"),
    )
    theirs = prefixed(flights, "in_", ["flight_key", "arr_station", "tail", "airline", "gate"])
    return (
        crew.filter(F.col("prev_flight_key").isNotNull())
        .join(mine, "flight_key")
        .join(theirs, F.col("prev_flight_key") == F.col("in_flight_key"), "left")
        .join(F.broadcast(airports), F.col("in_arr_station") == F.col("station"), "left")
        .withColumn(
            "same_tail", F.coalesce(F.col("departure_tail") == F.col("in_tail"), F.lit(False))
        )
        .drop("station", "in_flight_key")
    )
