"""Resource ready times and the projected times of a leg."""

from __future__ import annotations

from collections.abc import Callable

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyledger.functions.fixed_values import CANCELLED
from skyledger.functions.scalars import changed
from skyledger.operators.lookup import inbound, tail_ready

MINUTE = 60_000
INBOUND_TIMES = ("lta_ms", "pta_ms", "pcta_ms", "pmta_ms", "plmta_ms")
MEASURES = ("ready_ms", "ready_control_ms", "ready_mntc_ms", "ready_latest_ms")
PROJECTED = ("ptd_ms", "pctd_ms", "pmtd_ms", "plmtd_ms", "pta_ms", "pcta_ms", "pmta_ms", "plmta_ms")
REMEMBERED = ("ptd_ms", "pctd_ms", "plmtd_ms", "pta_ms", "pcta_ms", "plmta_ms")
SWAP = "SWAP_WHATIF"


_BUILT: dict[tuple[str, str], dict] = {}


def built(name: str, make: Callable[[], dict]) -> dict:
    """Columns that never change, put together once per application.

    A run projects round by round, and making them takes longer than planning a round.
    """
    key = (SparkContext._active_spark_context.applicationId, name)
    if key not in _BUILT:
        _BUILT[key] = make()
    return _BUILT[key]


# Our rules for values whose calculation lies outside the event feeds.
def air_minutes() -> Column:
    """Predicted flight minutes, else the scheduled ones; taxi is included."""
    return F.coalesce("pred_air_min", ((F.col("sta_ms") - F.col("std_ms")) / MINUTE).cast("long"))


def turn_minutes() -> Column:
    """Ground minutes of the leg, none if unknown."""
    return F.coalesce("ogt_min", F.lit(0))


def ready_measures(turn_min: Column, continued: Column) -> dict[str, Column]:
    """The four ready times a resource has after an inbound leg (`in_*` columns).

    Plain, with air-traffic control, for maintenance, and on latest times.
    """
    turn = turn_min * MINUTE
    lta, pta, pcta = F.col("in_lta_ms"), F.col("in_pta_ms"), F.col("in_pcta_ms")
    pmta, plmta = F.col("in_pmta_ms"), F.col("in_plmta_ms")
    plain = F.when(lta.isNotNull(), F.coalesce(pta, lta) + turn).otherwise(F.lit(0))
    latest = F.when(continued, F.coalesce(plmta, lta, F.lit(0))).otherwise(F.coalesce(lta, F.lit(0))) + turn
    return {
        "ready_ms": plain,
        "ready_control_ms": F.when(lta.isNotNull(), F.coalesce(pcta, lta) + turn).otherwise(F.lit(0)),
        "ready_mntc_ms": F.when(F.coalesce(pmta, plmta).isNotNull(), F.coalesce(pmta, plmta) + turn).otherwise(plain),
        "ready_latest_ms": F.when(F.col("request_type") == SWAP, latest).otherwise(F.lit(0)),
    }


_RESOURCE = (
    "flight_key", "prev_flight_key", "resource_key", "resource_type", "seat", "turn_min", *MEASURES
)


def repeated_tails(tails: DataFrame) -> bool:
    """Whether the service table has several rows for an aircraft."""
    return not tails.groupBy("airline", "tail").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").isEmpty()


def _swap_tail() -> Column:
    """Tail event of a swap what-if, the only one that asks when the aircraft is back in service."""
    return F.coalesce((F.col("request_type") == SWAP) & (F.col("pe_event") == "PE_TAIL"), F.lit(False))


def _served(legs: DataFrame, tails: DataFrame, repeated: bool) -> DataFrame:
    """Legs with the service state of their aircraft, where a resource needs it.

    The other legs stay where they are; they meet the table only if it is `repeated`, since a
    leg counts once per row of its aircraft.
    """
    if repeated:
        return tail_ready(legs, tails, turn_minutes())
    asking = tail_ready(legs.filter(_swap_tail()), tails, turn_minutes())
    return asking.unionByName(legs.filter(~_swap_tail()), allowMissingColumns=True)


def resource_ready(
    legs: DataFrame, crew: DataFrame, tails: DataFrame, with_crew: bool = True, times: DataFrame | None = None, repeated: bool | None = None
) -> DataFrame:
    """One row per resource a leg waits for: its aircraft and each crew member.

    `times` holds the legs they come from, by default the same legs.  Legs and crew that carry
    the key and times of their inbound leg (`in_*`) are not joined to it.  Crew that carries the
    `request_type` of its leg is not joined to it.  `repeated` tells whether `tails` names an
    aircraft more than once; by default it is looked up.

    Without an inbound leg the aircraft still gives a row when it is out of
    service in a swap what-if, with the return to service as latest time.
    """
    served = _served(legs, tails, repeated_tails(tails) if repeated is None else repeated)
    times = legs if times is None else times
    craft = served if "in_flight_key" in legs.columns else inbound(served, times, "prev_leg_key", INBOUND_TIMES)
    own = built("equipment", _equipment)
    equipment = craft.filter(own["given"]).withColumns(own["columns"]).withColumn("resource_key", F.col("prev_flight_key")).select(*_RESOURCE)
    if not with_crew:
        return equipment
    if "request_type" not in crew.columns:
        crew = crew.join(legs.select("flight_key", "request_type"), "flight_key")
    if "in_flight_key" in crew.columns:
        people = crew.filter(F.col("in_flight_key").isNotNull())
    else:
        people = inbound(crew, times, "prev_flight_key", INBOUND_TIMES, "inner")
    persons = people.withColumns(
        {
            **built("people", lambda: ready_measures(F.col("turn_min"), F.lit(False))),
            "resource_key": F.col("duty_key"),
            "resource_type": F.lit("CREW"),
        }
    ).select(*_RESOURCE)
    return equipment.unionByName(persons)


def _equipment() -> dict:
    """When an aircraft is a resource, and the columns of its row."""
    swap_tail = _swap_tail()
    turn, zero = turn_minutes(), F.lit(0)
    service = F.when(swap_tail, F.coalesce("tail_ready_ms", F.lit(0))).otherwise(F.lit(0))
    found = F.col("in_flight_key").isNotNull()
    measures = ready_measures(turn, F.col("pe_event") == "PE_CONTINUED")
    raised = F.greatest(measures["ready_latest_ms"], F.when(F.col("request_type") == SWAP, service).otherwise(zero))
    columns = {
        **{m: F.when(found, measures[m]).otherwise(zero) for m in MEASURES[:3]},
        "ready_latest_ms": F.when(found, raised).otherwise(service),
        "prev_flight_key": F.when(found, F.col("in_flight_key")).otherwise(F.col("flight_key")),
        "resource_type": F.lit("EQUIPMENT"),
        "seat": F.lit("AC"),
        "turn_min": F.when(found, turn),
    }
    return {"given": found | (swap_tail & F.coalesce("ots", F.lit(False))), "columns": columns}


def max_ready(resources: DataFrame, key: tuple[str, ...] = ("flight_key",)) -> DataFrame:
    """Largest ready times of a leg (or of another `key`) and the resource type behind each.

    On a tie the aircraft counts before the crew.
    """
    # One largest pair per measure instead of value, type and pair, so rows are shuffled with less beside them.
    pairs = [F.max(F.struct(F.col(m).alias("at"), F.col("resource_type").alias("kind"))).alias(f"_{m}") for m in MEASURES[:3]]
    found = resources.groupBy(*key).agg(*pairs, F.max(MEASURES[3]).alias(f"max_{MEASURES[3]}"))
    most = [F.col(f"_{m}.at").alias(f"max_{m}") for m in MEASURES[:3]]
    kinds = [F.when(F.col(f"_{m}.at") > 0, F.col(f"_{m}.kind")).alias(f"{m.removesuffix('_ms')}_type") for m in MEASURES[:3]]
    return found.select(*key, *most, f"max_{MEASURES[3]}", *kinds)


def most_restrictive(resources: DataFrame) -> DataFrame:
    """The resource a leg waits for longest; aircraft before crew on a tie.

    A minimum over a struct, so rows combine before the shuffle.
    """
    first = F.min(
        F.struct(
            (-F.col("ready_ms")).alias("_late"),
            F.when(F.col("resource_type") == "EQUIPMENT", 0).otherwise(1).alias("_rank"),
            "resource_key",
            "resource_type",
            "seat",
            "prev_flight_key",
            "turn_min",
            "ready_ms",
        )
    )
    return resources.groupBy("flight_key").agg(first.alias("r")).select(
        "flight_key", *[f"r.{c}" for c in ("resource_key", "resource_type", "seat", "prev_flight_key", "turn_min", "ready_ms")]
    )


def is_cancelled() -> Column:
    return F.coalesce(F.col("leg_status").isin(*CANCELLED), F.lit(False))


def is_out() -> Column:
    return F.coalesce(F.col("dep_status").isin("OUT", "OFF"), F.lit(False))


def is_on() -> Column:
    return F.coalesce(F.col("arr_status").isin("ON", "IN"), F.lit(False))


def departures() -> dict[str, Column]:
    """Projected departures from the latest departure and the ready times."""
    ltd, routed = F.col("ltd_ms"), F.col("leg_status") == "ROUTE_OUT"
    control = F.when(~F.coalesce(routed, F.lit(False)), F.col("ctd_ms") - F.col("taxi_out_min") * MINUTE)
    ptd = F.greatest(ltd, F.col("max_ready_ms"))
    free = {
        "ptd_ms": ptd,
        "pctd_ms": F.greatest(ltd, F.col("max_ready_control_ms"), control),
        "pmtd_ms": F.greatest(ptd, F.col("max_ready_mntc_ms")),
        "plmtd_ms": F.greatest(ltd, F.col("max_ready_latest_ms")),
    }
    return {
        n: F.when(ltd.isNull(), F.col(n)).when(is_out(), ltd).otherwise(c) for n, c in free.items()
    }


def arrivals(dep: dict[str, Column]) -> dict[str, Column]:
    """Projected arrivals from the latest arrival and given departures."""
    lta, ltd, zero = F.col("lta_ms"), F.col("ltd_ms"), F.lit(0)
    air = air_minutes() * MINUTE
    routed = F.coalesce(F.col("leg_status") == "ROUTE_OUT", F.lit(False))
    control = F.when(~routed, F.col("cta_ms") + F.col("taxi_in_min") * MINUTE)
    pta = F.greatest(lta, F.coalesce(dep["ptd_ms"], ltd, zero) + air)
    free = {
        "pta_ms": pta,
        "pcta_ms": F.greatest(lta, F.coalesce(dep["pctd_ms"], ltd, zero) + air, control),
        "pmta_ms": F.greatest(pta, F.coalesce(dep["pmtd_ms"], zero) + air),
        "plmta_ms": F.greatest(lta, F.coalesce(dep["plmtd_ms"], zero) + air),
    }
    return {n: F.when(lta.isNull(), F.col(n)).when(is_on(), lta).otherwise(c) for n, c in free.items()}


def _same(value: Column, names: tuple[str, ...]) -> dict[str, Column]:
    return {n: value for n in names}


DEP = PROJECTED[:4]
ARR = PROJECTED[4:]


def project(legs: DataFrame, continued: bool = False) -> DataFrame:
    """Projected times after the leg's event.

    `legs` carries the stored times, the statuses, `pe_event` and the `max_*`
    ready columns.  Adds `new_*` for the eight projected fields, `rule`, and
    `pub_*` flags for the fields the event publishes.  A cancelled leg takes
    its schedule whatever the event.  Legs that all are `continued` need no
    `pe_event`, which only they meet; their columns are few, so that a round is
    planned quickly, and without `pub_*`, since a continuation publishes all.
    """
    if continued:
        own = built("continued", lambda: _rules(continued=True))
        timed = legs.withColumn("rule", own["rule"]).withColumns(own["dep"])
        return timed.withColumns(own["arr"])
    own = built("project", _rules)
    timed = legs.withColumn("rule", own["rule"]).withColumns(own["dep"]).withColumns(own["usual"]).withColumns(own["arr"])
    return timed.withColumns(own["pub"]).drop(*own["usual"])


def _rules(continued: bool = False) -> dict:
    """The columns of `project`, in the order in which they build on each other."""
    event = F.col("pe_event")
    std, sta = F.col("std_ms"), F.col("sta_ms")
    ltd, lta = F.col("ltd_ms"), F.col("lta_ms")
    taxi_in = F.coalesce("taxi_in_min", F.lit(0)) * MINUTE
    late_arr = ("pta_ms", "pmta_ms", "plmta_ms")
    late_dep = ("ptd_ms", "pmtd_ms", "plmtd_ms")
    usual_arr = {f: F.col(f"_arr_{f}") for f in ARR}
    # rule -> (condition, new values, published fields); a continuation is no event of a leg's own.
    rules = {
        "schedule": (is_cancelled() if continued else is_cancelled() | (event == "PE_CANCEL"), _same(std, DEP) | _same(sta, ARR), PROJECTED),
        "out": (
            (event == "PE_OUT") & F.col("out_ms").isNotNull(),
            _same(F.col("out_ms"), DEP) | usual_arr,
            PROJECTED,
        ),
        "in": ((event == "PE_IN") & F.col("in_ms").isNotNull(), _same(F.col("in_ms"), ARR), ARR),
        "off": ((event == "PE_OFF") & F.col("off_ms").isNotNull(), _same(ltd, DEP) | _same(lta, ARR), PROJECTED),
        "on": ((event == "PE_ON") & F.col("on_ms").isNotNull(), {"pcta_ms": F.col("on_ms") + taxi_in}, ("pcta_ms",)),
        "ignored": (event.isin("PE_OUT", "PE_IN", "PE_OFF", "PE_ON"), {}, ()),
        "late arrival": (is_out() & (event == "PE_ETA"), _same(lta, late_arr), late_arr),
        "late departure": (
            is_out() & event.isin("PE_ETD", "PE_ETR"),
            _same(ltd, late_dep) | _same(lta, late_arr),
            late_dep + late_arr,
        ),
    }
    if continued:
        rules = {"schedule": rules["schedule"]}
    name = F
    for rule, (cond, _, _) in rules.items():
        name = name.when(cond, rule)

    def ruled(field: str, otherwise: Column) -> Column:
        value = F
        for rule, (_, values, _) in rules.items():
            value = value.when(F.col("rule") == rule, values.get(field, F.col(field)))
        return value.otherwise(otherwise)

    def published(field: str) -> Column:
        return F.col("rule").isin("projected", *[r for r, (_, _, pubs) in rules.items() if field in pubs])

    # Departures first: the arrivals build on them and must not repeat them.
    dep = departures()
    arr = arrivals({f: F.col(f"new_{f}") for f in DEP})
    if continued:
        usual_arr = arr
    return {
        "rule": name.otherwise("projected"),
        "dep": {f"new_{f}": ruled(f, dep[f]) for f in DEP},
        "usual": {f"_arr_{f}": arr[f] for f in ARR},
        "arr": {f"new_{f}": ruled(f, usual_arr[f]) for f in ARR},
        "pub": {f"pub_{f}": published(f) for f in PROJECTED},
    }


# Published field -> change event type.
CHANGE_EVENTS = {
    "pta_ms": "PTA",
    "pcta_ms": "PTA_CONTROL",
    "ptd_ms": "PTD",
    "plmtd_ms": "PLMTD",
    "plmta_ms": "PLMTA",
    "pctd_ms": "PTD_CONTROL",
}


def change_set(projected: DataFrame, reseed: bool = False) -> DataFrame:
    """Which published fields changed (`chg_*`).

    The fields on latest times count as changed whenever they have a value.
    A reseed marks every field, changed or not.
    """
    flags = {}
    for field in CHANGE_EVENTS:
        new = F.col(f"new_{field}")
        moved = new.isNotNull() if field.startswith("plm") else changed(new, F.col(field))
        flags[f"chg_{field}"] = F.lit(True) if reseed else F.col(f"pub_{field}") & moved
    return projected.withColumns(flags)


def change_events(changes: DataFrame, maintenance_with_control: bool = False) -> DataFrame:
    """One row per published change.

    A swap what-if publishes only the latest arrival; a departure on latest
    times is stored but never published.  `maintenance_with_control` also emits
    the maintenance departure beside every controlled departure.
    """
    swap = F.col("request_type") == SWAP
    items = []
    for field, kind in CHANGE_EVENTS.items():
        if kind == "PLMTD":
            continue
        allowed = swap if kind == "PLMTA" else ~swap
        linked = F.col("prev_leg_key") if kind == "PTD" else F.lit(None).cast("string")

        def item(kind=kind, field=field, linked=linked):
            return F.struct(
                F.lit(kind).alias("event_type"),
                F.col(f"new_{field}").alias("value_ms"),
                F.col(field).alias("previous_ms"),
                linked.alias("previous_flight_key"),
            )

        items.append(F.when(F.col(f"chg_{field}") & allowed, item()))
        if maintenance_with_control and kind == "PTD_CONTROL":
            items.append(F.when(F.col(f"chg_{field}") & allowed, item("PMTD", "pmtd_ms", F.col("prev_leg_key"))))
    rows = F.filter(F.array(*items), lambda x: x.isNotNull())
    return changes.select("flight_key", "request_id", F.inline(rows))


def published_times(changes: DataFrame) -> DataFrame:
    """Rows to store: changed fields of the live legs, whole rows of a what-if.

    A live row (snapshot 0) holds a value only where the field changed, so a
    null leaves the stored one; a what-if row replaces its snapshot.
    """
    live = F.col("request_id") == "0"
    beside = {"ptd_ms": ("pmtd_ms",), "pta_ms": ("pmta_ms",)}
    columns = {}
    for field in CHANGE_EVENTS:
        for f in (field, *beside.get(field, ())):
            columns[f] = F.when(~live | F.col(f"chg_{field}"), F.col(f"new_{f}"))
        columns[f"prev_{field}"] = F.when(~live | F.col(f"chg_{field}"), F.col(field))
    any_change = F.greatest(*[F.coalesce(F.col(f"chg_{f}"), F.lit(False)) for f in CHANGE_EVENTS])
    # Generated, not filtered: a pushed-down filter would repeat the whole projection.
    row = F.when(~live | any_change, F.array(F.struct(*[c.alias(n) for n, c in columns.items()])))
    return changes.select("flight_key", F.col("request_id").alias("snapshot_id"), F.inline(row))


def maintenance_return(legs: DataFrame, tails: DataFrame) -> DataFrame:
    """Resource row for an aircraft out of service whose maintenance departure is later.

    Optional beside `resource_ready`; on a return-time event the turn is added.
    """
    etr = F.col("pe_event") == "PE_ETR"
    served = tail_ready(legs, tails, turn_minutes())
    due = etr | (F.coalesce("ots", F.lit(False)) & (F.col("pmtd_ms") > F.col("ptd_ms")))
    ready = F.col("pmtd_ms") + F.when(etr, turn_minutes() * MINUTE).otherwise(0)
    return served.filter(due & F.col("pmtd_ms").isNotNull()).select(
        "flight_key",
        F.col("flight_key").alias("resource_key"),
        F.lit("EQUIPMENT").alias("resource_type"),
        ready.alias("ready_mntc_ms"),
    )


def problems(projected: DataFrame, reseed: bool = False) -> DataFrame:
    """Delay problem rows for projected and controlled departures and arrivals.

    Controlled rows need a control time.  A problem is inactive on a cancelled
    leg, on departures once out or off, on arrivals once on or in.
    """
    specs = (
        ("PROJECTED_DEP_DELAY", "PTD", "ptd_ms", None, is_out()),
        ("PROJECTED_CONTROLLED_DEP_DELAY", "PTD_CONTROL", "pctd_ms", "ctd_ms", is_out()),
        ("PROJECTED_ARR_DELAY", "PTA", "pta_ms", None, is_on()),
        ("PROJECTED_CONTROLLED_ARR_DELAY", "PTA_CONTROL", "pcta_ms", "cta_ms", is_on()),
    )
    items = []
    for problem, kind, field, control, over in specs:
        new = F.col(f"new_{field}")
        raised = new.isNotNull() if reseed else changed(new, F.col(field))
        if control:
            raised = raised & F.col(control).isNotNull()
        items.append(
            F.when(
                raised,
                F.struct(
                    F.lit(problem).alias("problem_type"),
                    F.lit(kind).alias("event_type"),
                    new.alias("value_ms"),
                    (~(is_cancelled() | over)).alias("active"),
                ),
            )
        )
    return projected.select("flight_key", F.inline(F.filter(F.array(*items), lambda x: x.isNotNull())))


def maintenance_times(ptd: Column, pta: Column, pmtd: Column) -> dict[str, Column]:
    """Later of both departures, and the arrival moved by the same amount."""
    later = F.coalesce(pmtd > ptd, F.lit(False)) & pta.isNotNull()
    return {
        "mntc_departure_ms": F.when(F.coalesce(pmtd > ptd, F.lit(False)), pmtd).otherwise(ptd),
        "mntc_arrival_ms": F.when(later, pta + (pmtd - ptd)).otherwise(pta),
    }


def quarantine(events: DataFrame) -> DataFrame:
    """Events that cannot be processed, with the reason; others pass elsewhere."""
    reason = (
        F.when(F.col("flight_key").isNull(), "no flight key")
        .when(F.col("source_ts_ms").isNull(), "no source time")
        .when(F.col("needs_value") & F.col("value_ms").isNull(), "value is no number")
    )
    return events.withColumn("error", reason).filter(F.col("error").isNotNull())
