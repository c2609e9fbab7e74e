"""Operators on small hand-made inputs."""

import random

import pytest
from pyspark.sql import functions as F

from skyledger.operators import graph, inventory, lookup, project, sinks
from skyledger.session import run_dir, settle, settle_by
from skyledger.operators.ordered import (
    BLOCK_ROWS_CONF,
    HOT_ROWS_CONF,
    Ordered,
    following,
    hot_hashes,
    last_known,
    lookup_join,
    previous,
    rank,
    running_max,
    running_sum,
)

LEG = (
    "flight_key string, flight_date string, std_ms long, sta_ms long, ltd_ms long, lta_ms long, ptd_ms long, "
    "pctd_ms long, pmtd_ms long, plmtd_ms long, pta_ms long, pcta_ms long, pmta_ms long, plmta_ms long, ctd_ms long, "
    "cta_ms long, taxi_out_min long, taxi_in_min long, pred_air_min long, leg_status string, dep_status string, "
    "arr_status string, prev_leg_key string, airline string, tail string, ogt_min long, request_type string, "
    "request_id string, pe_event string, out_ms long, off_ms long, on_ms long, in_ms long"
)
M = 60_000


def state_row(key, dep, late=0, prev=None, status="ACTIVE", air=60, turn=20, event="PE_ETD", request="LIVE"):
    std, sta = dep * M, (dep + air) * M
    ltd = std + late * M
    return (
        key, "2024-01-01", std, sta, ltd, max(sta, ltd), ltd, ltd, None, None, sta, sta, None, None, None, None,
        0, 0, air, status, "SCHEDULED", "SCHEDULED", prev, "AA", "T1", turn, request, "0", event, None, None, None, None,
    )


ROOT = "flight_key string, flight_date string, request_id string, request_type string, batch_id string, route_id string"


def run_rounds(spark, legs, links, crew, roots, **options):
    """Log and patch of a run; `crew` has (leg, inbound leg, turn minutes), `roots` leg names or whole rows."""
    state = settle(spark.createDataFrame(legs, LEG), "state")
    edges = spark.createDataFrame(links, "src string, dst string, resource_type string")
    people = spark.createDataFrame(
        [(a, "d", "FA", b, t) for a, b, t in crew],
        "flight_key string, duty_key string, seat string, prev_flight_key string, turn_min long",
    )
    tails = spark.createDataFrame([], "airline string, tail string, ots boolean, est_return_ms long, return_ms long")
    kinds = {r[0]: (r[26], r[27]) for r in legs}
    rows = [r if isinstance(r, tuple) else (r, "2024-01-01", kinds[r][1], kinds[r][0], "b", None) for r in roots]
    known = settle(graph.linked(edges, state), "links")
    return graph.propagate(state, known, people, tails, spark.createDataFrame(rows, ROOT), run_dir(spark, "rounds"), **options)


def spread(spark, legs, links, crew, roots, **options):
    """Newest visit by (root, leg) and patch by leg, for runs of one request."""
    log, patch = run_rounds(spark, legs, links, crew, roots, **options)
    visits = sorted(log.collect(), key=lambda r: r["round"])
    return {(r.root_key, r.flight_key): r for r in visits}, {r.flight_key: r for r in patch.collect()}


def what_if(key, request="7", kind="SWAP_WHATIF", route="r1"):
    return (key, "2024-01-01", request, kind, "b", route)


def live(key, batch="b"):
    return (key, "2024-01-01", "0", "LIVE", batch, None)


def test_delay_passes_through_aircraft_and_crew(spark):
    legs = [state_row("a", 100, late=50), state_row("b", 180, prev="a"), state_row("c", 190)]
    visits, patch = spread(spark, legs, [("a", "b", "EQUIPMENT"), ("a", "c", "CREW")], [("c", "a", 30)], ["a"])
    assert set(visits) == {("a", "a"), ("a", "b"), ("a", "c")}
    assert patch["a"].pta_ms == 210 * M and patch["b"].ptd_ms == 230 * M and patch["c"].ptd_ms == 240 * M
    assert patch["b"].pmtd_ms == 230 * M


def test_a_chain_of_twelve_is_followed_to_its_end(spark):
    legs = [state_row("l0", 100, late=50)]
    links = []
    for i in range(1, 13):
        legs.append(state_row(f"l{i}", 100 + 80 * i, prev=f"l{i - 1}"))
        links.append((f"l{i - 1}", f"l{i}", "EQUIPMENT"))
    visits, patch = spread(spark, legs, links, [], ["l0"])
    assert len(visits) == 13 and max(v["round"] for v in visits.values()) == 12
    assert patch["l12"].ptd_ms == (100 + 80 * 12 + 50) * M
    log = run_rounds(spark, legs, links, [], ["l0"])[0]
    assert [(r.pending, r.processed) for r in graph.tracker(log).collect()] == [(0, 13)]


def shared_crew(late_a=60, late_b=50):
    """Leg c waits for the aircraft of a and the crew of b, both late."""
    legs = [state_row("a", 100, late=late_a), state_row("b", 100, late=late_b), state_row("c", 190, prev="a")]
    return legs, [("a", "c", "EQUIPMENT"), ("b", "c", "CREW")], [("c", "b", 60)]


def test_what_if_runs_leave_the_live_legs_alone(spark):
    """The live leg c leaves as it would without the what-if run of b, and the other way round."""
    legs, links, crew = shared_crew()
    alone = run_rounds(spark, legs, links, crew, [live("a")])[1].collect()
    both = run_rounds(spark, legs, links, crew, [live("a"), what_if("b", kind="HEATWHATIF")])[1]
    assert {r.flight_key: r for r in graph.live_times(both).collect()} == {r.flight_key: r for r in alone}
    other = run_rounds(spark, legs, links, crew, [what_if("b", kind="HEATWHATIF")])[1].collect()
    assert {r.flight_key: r for r in both.collect() if r.request_id == "7"} == {r.flight_key: r for r in other}
    assert {(r.request_id, r.flight_key) for r in both.collect()} == {("0", "a"), ("0", "c"), ("7", "b"), ("7", "c")}
    # Without the other's delay, c waits for the stored arrival of the other resource.
    times = {(r.request_id, r.flight_key): r.ptd_ms // M for r in both.collect()}
    assert times[("0", "c")] == 240 and times[("7", "c")] == 270


def test_two_requests_on_one_root_are_two_trees(spark):
    legs, links, crew = shared_crew()
    log, patch = run_rounds(spark, legs, links, crew, [live("a"), what_if("a", kind="HEATWHATIF")])
    got = sorted((r.request_id, r.flight_key, r.arrivals, r.route_id) for r in log.collect())
    assert got == [("0", "a", 1, None), ("0", "c", 1, None), ("7", "a", 1, "r1"), ("7", "c", 1, "r1")]
    tracked = {(r.root_key, r.request_id): (r.processed, r.pending) for r in graph.tracker(log).collect()}
    assert tracked == {("a", "0"): (2, 0), ("a", "7"): (2, 0)}
    assert patch.count() == 4


def test_batches_are_trees_of_their_own(spark):
    legs, links, crew = shared_crew()
    log = run_rounds(spark, legs, links, crew, [live("a", "b1"), live("a", "b2")])[0]
    assert {(r.batch_id, r.flight_key): r.arrivals for r in log.collect()} == {("b1", "a"): 1, ("b1", "c"): 1, ("b2", "a"): 1, ("b2", "c"): 1}


def test_stored_snapshots_are_read_by_their_request_only(spark):
    legs, links, crew = shared_crew(late_b=0)
    stored = spark.createDataFrame([("7", "b", 400 * M)], "request_id string, flight_key string, pta_ms long")
    patch = run_rounds(spark, legs, links, crew, [live("a"), what_if("a", kind="HEATWHATIF")], stored=stored)[1]
    times = {(r.request_id, r.flight_key): r.ptd_ms // M for r in patch.collect()}
    assert times[("0", "c")] == 240 and times[("7", "c")] == 460


def test_a_leg_of_another_request_type_is_projected_by_the_run(spark):
    """The next leg's own row says swap; a live run does not follow it on latest times."""
    legs = [state_row("a", 100, late=0), state_row("b", 400, prev="a", request="SWAP_WHATIF")]
    log = run_rounds(spark, legs, [("a", "b", "EQUIPMENT")], [], [live("a")])[0]
    assert [r.flight_key for r in log.collect()] == ["a"]
    log = run_rounds(spark, legs, [("a", "b", "EQUIPMENT")], [], [what_if("a")])[0]
    assert sorted(r.flight_key for r in log.collect()) == ["a", "b"]


def test_roots_that_cannot_be_processed_are_marked_and_the_others_go_on(spark):
    legs, links, crew = shared_crew()
    log = run_rounds(spark, legs, links, crew, [live("a"), live(None), live("nowhere")])[0]
    errors = {r.flight_key: r.error for r in log.collect()}
    assert errors == {"a": None, "c": None, None: "no flight key", "nowhere": "leg is not known"}
    status = {r.flight_key: r.status for r in graph.completions(graph.tracker(log)).collect()}
    assert status == {"a": "DONE", None: "FAILED", "nowhere": "FAILED"}


def test_a_link_without_a_type_is_followed_and_counted(spark):
    legs, _, crew = shared_crew()
    log = run_rounds(spark, legs, [("a", "c", None)], crew, [live("a")])[0]
    assert {r.flight_key: r.missing_type for r in log.collect()} == {"a": 0, "c": 1}


def test_a_circle_is_refused_only_when_every_path_closes_it(spark):
    """Leg d is reached over b and over c; its link to b closes a circle on the way over b alone."""
    legs = [state_row("a", 100, late=80), state_row("b", 180, prev="d"), state_row("c", 180, prev="a"), state_row("d", 260, prev="c")]
    links = [("a", "b", "CREW"), ("a", "c", "EQUIPMENT"), ("b", "d", "CREW"), ("c", "d", "EQUIPMENT"), ("d", "b", "EQUIPMENT")]
    crew = [("b", "a", 20), ("d", "b", 20)]
    log = run_rounds(spark, legs, links, crew, [live("a")])[0]
    sound = [r for r in log.collect() if r.flight_key == "b" and r["round"] == 3]
    assert [(r.error, r.last_key) for r in sound] == [(None, "d")]
    # Over b alone, the link back is refused.
    log = run_rounds(spark, legs, [x for x in links if x[:2] != ("c", "d")], crew, [live("a")])[0]
    refused = [r for r in log.collect() if r.flight_key == "b" and r["round"] == 3]
    assert [(r.error, r.errors) for r in refused] == [("cyclic path", 1)]


def test_finished_trees_are_known_while_others_run(spark):
    legs = [state_row("l0", 100, late=50), state_row("x", 100, late=5)]
    links = []
    for i in range(1, 5):
        legs.append(state_row(f"l{i}", 100 + 80 * i, prev=f"l{i - 1}"))
        links.append((f"l{i - 1}", f"l{i}", "EQUIPMENT"))
    heard = []
    run_rounds(spark, legs, links, [], ["l0", "x"], on_ended=lambda n, trees: heard.append((n, [r.root_key for r in trees.collect()])))
    assert heard == [(0, ["x"]), (1, []), (2, []), (3, []), (4, ["l0"])]


def test_paths_are_walked_back_for_what_is_asked(spark):
    legs, links, crew = shared_crew()
    legs.append(state_row("d", 270, prev="c"))
    folder = run_dir(spark, "asked")
    log = run_rounds(spark, legs, [*links, ("c", "d", "EQUIPMENT")], crew, [live("a"), live("b")])[0]
    asked = settle(log.filter("flight_key = 'd'"), "asked")
    got = {r.root_key: r.path for r in graph.paths_to(asked, settle(log, "visits"), folder).collect()}
    assert got == {"a": ["a", "c", "d"], "b": ["b", "c", "d"]}


def test_overlay_merges_generations(spark):
    kept = graph.Overlay(spark, run_dir(spark, "overlay"), None)
    columns = "request_id string, flight_key string, " + ", ".join(f"{f} long" for f in project.PROJECTED)
    for n in range(9):
        rows = [("0", f"k{i}", *[n] * 8) for i in range(n % 3 + 1)]
        kept.add(spark.createDataFrame(rows, columns), n)
    assert len(kept.generations) <= 3
    asked = spark.createDataFrame([("0", f"k{i}", *[None] * 8) for i in range(4)] + [("7", "k0", *[None] * 8)], columns)
    got = {(r.request_id, r.flight_key): r.pta_ms for r in kept.onto(asked).collect()}
    assert got == {("0", "k0"): 8, ("0", "k1"): 8, ("0", "k2"): 8, ("0", "k3"): None, ("7", "k0"): None}


def test_a_root_acts_by_its_own_event(spark):
    legs = [state_row("a", 100, late=50, event="PE_CANCEL"), state_row("b", 180, prev="a")]
    visits, patch = spread(spark, legs, [("a", "b", "EQUIPMENT")], [], ["a"])
    assert patch["a"].ptd_ms == 100 * M and not visits[("a", "a")].continues


def test_swap_what_if_passes_on_latest_times(spark):
    calm = state_row("a", 100, late=0, request="SWAP_WHATIF")
    legs = [calm, state_row("b", 400, prev="a")]
    assert set(spread(spark, legs, [("a", "b", "EQUIPMENT")], [], ["a"])[0]) == {("a", "a"), ("a", "b")}
    legs[0] = state_row("a", 100, late=0)
    assert set(spread(spark, legs, [("a", "b", "EQUIPMENT")], [], ["a"])[0]) == {("a", "a")}


def test_nothing_to_start_from(spark):
    visits, patch = spread(spark, [state_row("a", 100)], [("a", "b", "CREW")], [], [])
    assert visits == {} and patch == {}


def test_link_back_onto_the_path_is_refused(spark):
    legs = [state_row("a", 100, late=50), state_row("b", 180, prev="a")]
    visits, _ = spread(spark, legs, [("a", "b", "EQUIPMENT"), ("b", "a", "EQUIPMENT")], [], ["a"])
    assert visits[("a", "b")].continues
    assert any(v.errors for v in visits.values())


def test_link_that_disagrees_with_the_leg_is_refused(spark):
    legs = [state_row("a", 100, late=50), state_row("b", 180, prev="x")]
    visits, patch = spread(spark, legs, [("a", "b", "EQUIPMENT")], [], ["a"])
    assert visits[("a", "b")].error == "previous leg differs"
    assert "b" not in patch


def test_cancelled_leg_passes_nothing_on_unless_asked(spark):
    legs = [state_row("a", 100, late=50, status="CANCELLED"), state_row("b", 180, prev="a")]
    links = [("a", "b", "EQUIPMENT")]
    legs[0] = legs[0][:10] + (999 * M,) + legs[0][11:]
    assert set(spread(spark, legs, links, [], ["a"])[0]) == {("a", "a")}
    assert set(spread(spark, legs, links, [], ["a"], cancel_continues=True)[0]) == {("a", "a"), ("a", "b")}


def test_tracker_counts_pending_children(spark):
    log = spark.createDataFrame(
        [(0, "b", "a", "0", "a", 1, 0, 2), (1, "b", "a", "0", "b", 1, 0, 0), (0, "b", "z", "7", "z", 1, 0, 1), (1, "b", "z", "7", "y", 1, 1, 0)],
        "round int, batch_id string, root_key string, request_id string, flight_key string, arrivals long, errors long, children long",
    )
    got = {r.root_key: (r.pending, r.failed) for r in graph.tracker(log).collect()}
    assert got == {"a": (1, False), "z": (0, True)}
    done = graph.completions(graph.tracker(log)).collect()
    assert [(r.flight_key, r.request_id, r.status) for r in done] == [("z", "7", "FAILED")]


FLIGHT = (
    "flight_key string, airline string, flight_number string, flight_date string, arr_station string, "
    "dep_station string, snapshot_id string, tail string, std_ms long, prev_number string, prev_date string"
)


def resolve(spark, rows):
    df = spark.createDataFrame(rows, FLIGHT)
    return {r.flight_key: (r.rule, r.resolved_key) for r in lookup.resolve_previous_leg(df, df).collect()}


def flight(key, arr, dep, tail, std, number="1", prev="9"):
    return (key, "AA", number, "2024-01-01", arr, dep, "0", tail, std, prev, "2024-01-01" if prev else None)


def test_previous_leg_rules(spark):
    cands = [flight("p1", "X", "Q", "T1", 10, "9", None), flight("p2", "x", "Q", "T2", 20, "9", None)]
    ours = [flight("t", "Z", "X", "T2", 100), flight("u", "Z", "X", "T9", 100), flight("n", "Z", "X", None, 15)]
    got = resolve(spark, cands + ours)
    assert got["t"] == ("tail", "p2")
    assert got["u"] == ("none", None)
    assert got["n"] == ("nearest", "p1")
    assert got["p1"] == ("none", None)


def test_previous_leg_skips_the_flight_itself(spark):
    loop = flight("me", "X", "X", "T1", 50, "9")
    other = flight("o1", "X", "Q", "T1", 40, "9", None)
    later = flight("o2", "X", "Q", "T1", 60, "9", None)
    assert resolve(spark, [loop, other, later])["me"] == ("nearest", "o1")
    tied = flight("o3", "X", "Q", "T1", 50, "9", None)
    assert resolve(spark, [loop, other, tied])["me"] == ("nearest", "o3")


def test_schedule_replaces_every_projected_time(spark):
    row = state_row("a", 100, event="PE_CANCEL")
    late = row[:6] + (145 * M, 150 * M, 145 * M, None) + row[10:]
    df = spark.createDataFrame([late], LEG)
    for m in project.MEASURES:
        df = df.withColumn(f"max_{m}", F.lit(None).cast("long"))
    r = project.project(df).first()
    assert {r[f"new_{f}"] for f in project.DEP} == {100 * M}
    assert {r[f"new_{f}"] for f in project.ARR} == {160 * M}
    assert r.ptd_ms == 145 * M


def test_upsert_keeps_adds_and_patches(spark):
    state = spark.createDataFrame([("a", 1, 1), ("b", 2, 2)], "k string, x long, y long")
    patch = spark.createDataFrame([("b", None, 9), ("c", 3, None)], "k string, x long, y long")
    got = sorted(tuple(r) for r in sinks.upsert(state, patch, "k", ("x", "y")).collect())
    assert got == [("a", 1, 1), ("b", 2, 9), ("c", 3, None)]


def test_replace_rows(spark):
    state = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "k string, v long")
    new = spark.createDataFrame([("a", 7)], "k string, v long")
    assert sorted(tuple(r) for r in sinks.replace_rows(state, new, "k").collect()) == [("a", 7), ("b", 3)]


def test_one_key_with_a_third_of_the_rows(spark):
    rows = spark.range(30_000).select(
        F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")).alias("k"), F.col("id").alias("t"), F.lit(1).alias("one")
    )
    spark.conf.set(HOT_ROWS_CONF, "5000")
    spark.conf.set(BLOCK_ROWS_CONF, "700")
    try:
        found = hot_hashes(rows, ["k"])
        line = Ordered.of(rows.withColumn("me", F.struct("t")), ["k"], ["t"])
        scanned = line.scan(running_sum("one", "n"), rank("r"), previous("me", "before")).rows().filter("k = -1")
        joined = lookup_join(
            rows, spark.createDataFrame([(-1, "hot"), (5, "cold")], "k long, name string"), "k", found, "inner"
        )
        assert len(found) == 1 and line.split
        last = scanned.orderBy(F.desc("t")).first()
        assert (last.n, last.r, last.before.t) == (10_000, 10_000, 29_994)
        assert scanned.filter("n <> r OR (n > 1 AND before.t <> t - 3)").count() == 0
        assert {(r.name, r["count"]) for r in joined.groupBy("name").count().collect()} == {("hot", 10_000), ("cold", 1)}
    finally:
        spark.conf.unset(HOT_ROWS_CONF)
        spark.conf.unset(BLOCK_ROWS_CONF)


def test_cut_keys_never_change_a_scan(spark):
    """Null order values, null keys, ties broken late and one very full moment: cut against uncut."""
    rng = random.Random(11)
    rows = []
    for i in range(400):
        key = rng.choice(["hot", "hot", "hot", None, "cold"])
        moment = rng.choice([None, 5, 5, 5, rng.randrange(100)])
        rows.append((key, moment, rng.choice([None, i % 3]), i, rng.choice([None, rng.randrange(50)])))
    df = spark.createDataFrame(rows, "k string, t long, u long, i long, v long").withColumn("me", F.struct("i"))

    def scanned():
        line = Ordered.of(df, ["k"], ["t", "u", "i"])
        return line.split, sorted(
            map(
                tuple,
                line.scan(
                    running_sum("i", "total"),
                    running_max("v", "most", inclusive=False),
                    rank("place"),
                    last_known("v", "known", inclusive=False),
                    previous("me", "before"),
                    following("me", "after"),
                )
                .rows()
                .select("i", "total", "most", "place", "known", "before.i", "after.i")
                .collect(),
            )
        )

    split, whole = scanned()
    assert not split
    for block in ("7", "60"):
        spark.conf.set(HOT_ROWS_CONF, "50")
        spark.conf.set(BLOCK_ROWS_CONF, block)
        try:
            split, cut = scanned()
        finally:
            spark.conf.unset(HOT_ROWS_CONF)
            spark.conf.unset(BLOCK_ROWS_CONF)
        assert split and cut == whole


def test_null_parts_never_match_and_tails_ignore_case(spark):
    lost = flight("lost", None, "Q", "T1", 10, "9", None)
    leg = flight("me", "Z", None, "T1", 100)
    assert resolve(spark, [lost, leg])["me"] == ("none", None)
    shifted = ("shift", "A", "A", "2024-01-01", "X", "Q", "0", "T1", 10, None, None)
    assert resolve(spark, [shifted, flight("me", "Z", "X", "T1", 100)])["me"] == ("none", None)
    cands = [flight("p1", "X", "Q", "t2", 10, "9", None), flight("p2", "X", "Q", "T3", 20, "9", None)]
    assert resolve(spark, [*cands, flight("me", "Z", "X", "T2", 100)])["me"] == ("tail", "p1")


MOVE = "product_id long, order_id long, line_no long, supplier_id long, kind string, step long, ts_ms long, location_id long, on_hand long, reserved long, damaged long"


def random_moves(seed, positions=4, each=60):
    rng, rows = random.Random(seed), []
    for p in range(positions):
        rows.append((p, -1, -1, -1, "OPENING", 0, 0, 1, rng.randrange(20), 0, 0))
        for n in range(each):
            kind, step, units = rng.choice([("SALE", 4, -rng.randrange(12)), ("RETURN_SELLABLE", 7, rng.randrange(9)), ("RESERVE", 3, 0), ("TRANSFER_OUT", 1, -3)])
            rows.append((p, n, 1, 1, kind, step, rng.randrange(1, 40), 1, units, 2 if kind == "RESERVE" else 0, 0))
    return rows


@pytest.mark.parametrize("limit", [None, 5])
def test_stock_never_falls_below_zero(spark, limit):
    """Against a row-by-row model, also with positions cut into blocks."""
    rows = random_moves(3)
    if limit:
        spark.conf.set(HOT_ROWS_CONF, str(limit))
        spark.conf.set(BLOCK_ROWS_CONF, "30")
    try:
        got = {(r.product_id, r.order_id): (r.stock, r.refused) for r in inventory.refusing_ledger(spark.createDataFrame(rows, MOVE)).rows().collect()}
        orders = {r.order_id: r for r in inventory.order_fulfilment(spark.createDataFrame(rows, MOVE)).collect()}
    finally:
        spark.conf.unset(HOT_ROWS_CONF)
        spark.conf.unset(BLOCK_ROWS_CONF)
    want, sold, refused = {}, {}, {}
    for p in range(4):
        stock = 0
        for r in sorted((r for r in rows if r[0] == p), key=lambda r: (r[6], r[5], r[1])):
            left = max(0, stock + r[8])
            short = left - stock - r[8]
            want[(p, r[1])] = (left, short)
            stock = left
            if r[4] == "SALE":
                sold[r[1]] = sold.get(r[1], 0) - r[8] - short
                refused[r[1]] = refused.get(r[1], 0) + short
    assert got == want and any(short for _, short in want.values())
    assert {k: (r.units_sold, r.units_refused) for k, r in orders.items() if k in sold} == {k: (sold[k], refused[k]) for k in sold}


def test_orders_refused_and_cancelled_in_part(spark):
    rows = [(1, -1, -1, -1, "OPENING", 0, 0, 1, 5, 0, 0)]
    rows += [(1, 10, 1, 1, "SALE", 4, 1, 1, -3, 0, 0), (1, 11, 1, 1, "SALE", 4, 2, 1, -4, 0, 0), (1, 12, 1, 1, "SALE", 4, 3, 1, -1, 0, 0)]
    rows += [(1, 13, n, 1, "RESERVE", 3, 4, 1, 0, 1, 0) for n in (1, 2)] + [(1, 13, 1, 1, "RELEASE", 5, 5, 1, 0, -1, 0)]
    rows += [(1, 14, 1, 1, "RESERVE", 3, 4, 1, 0, 2, 0), (1, 14, 1, 1, "RELEASE", 5, 5, 1, 0, -2, 0)]
    got = {r.order_id: (r.units_sold, r.units_refused, r.outcome) for r in inventory.order_fulfilment(spark.createDataFrame(rows, MOVE)).collect()}
    assert got == {10: (3, 0, "OK"), 11: (2, 2, "PARTLY_REFUSED"), 12: (0, 1, "REFUSED"), 13: (0, 0, "PARTLY_CANCELLED"), 14: (0, 0, "CANCELLED")}


def test_largest_ready_times_without_values(spark):
    rows = [("a", "CREW", 5, None, 0, 1), ("a", "EQUIPMENT", 5, None, 0, None), ("a", "CREW", 4, 3, None, 2), ("b", "CREW", None, None, None, None)]
    columns = "flight_key string, resource_type string, " + ", ".join(f"{m} long" for m in project.MEASURES)
    found = project.max_ready(spark.createDataFrame(rows, columns))
    got = {r.flight_key: tuple(r)[1:] for r in found.collect()}
    assert got == {"a": (5, 3, 0, 2, "EQUIPMENT", "CREW", None), "b": (None,) * 7}
    # Each measure is shuffled once, with its type.
    text = found._sc._jvm.PythonSQLUtils.explainString(found._jdf.queryExecution(), "simple")
    assert "max_by" not in text


def test_a_round_gives_the_same_by_sent_and_by_shuffled_keys(spark, monkeypatch):
    legs, links, crew = shared_crew()
    got = []
    for few in (0, 200_000):
        monkeypatch.setattr(graph, "FEW_ROWS", few)
        log, patch = run_rounds(spark, legs, links, crew, [live("a"), what_if("b", kind="HEATWHATIF")])
        got.append([sorted(map(tuple, df.collect()), key=repr) for df in (log, patch)])
    assert got[0] == got[1] and len(got[0][0]) == 4


def test_tables_of_a_round_are_not_shuffled(spark):
    state = settle_by(spark.range(1000).selectExpr("concat('k', id) AS flight_key", "id AS std_ms"), "test", "flight_key")
    keys = settle(spark.createDataFrame([("k1",), ("k5",)], "flight_key string"), "keys")

    def shuffles(df):
        return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "simple").count("Exchange hashpartitioning")

    for few, n in ((True, 0), (False, 1)):
        found = graph._matched(state, keys, "flight_key", few)
        assert shuffles(found) == n
        assert sorted(map(tuple, found.collect())) == [("k1", 1), ("k5", 5)]
    assert spark.catalog.listTables() == []


def test_only_suspects_are_looked_up(spark):
    """Arrivals that can close no circle pass as they are; suspects are judged by the written frontiers."""
    rounds = graph.Rounds(spark, run_dir(spark, "guard"))
    tree = "batch_id string, root_key string, request_id string, flight_key string"
    rounds.add("frontier", 1, spark.createDataFrame([("b", "a", "0", "c", ["a"])], tree + ", parents array<string>"))
    rows = [("b", "a", "0", "d", "c", None, False), ("b", "a", "0", "a", "c", None, True), ("b", "a", "0", "e", "c", "x", True)]
    arrivals = settle(spark.createDataFrame(rows, tree + ", last_key string, error string, suspect boolean"), "arrivals")
    found = graph.refused_cycles(arrivals, rounds, 1)
    assert sorted((r.flight_key, r.error) for r in found.collect() if r.error) == [("a", "cyclic path"), ("e", "x")]
    assert found.count() == 3
    text = found._sc._jvm.PythonSQLUtils.explainString(found._jdf.queryExecution(), "simple")
    assert "Union" in text


def test_a_leg_counts_once_per_row_of_its_aircraft(spark):
    rows = [state_row("a", 0), state_row("b", 90, prev="a"), state_row("c", 90, prev="a", event="PE_TAIL", request="SWAP_WHATIF")]
    legs = settle(spark.createDataFrame(rows, LEG), "legs")
    kind = "airline string, tail string, ots boolean, est_return_ms long, return_ms long"
    once = spark.createDataFrame([("AA", "T1", False, None, 500 * M)], kind)
    crew = spark.createDataFrame([("b", "d", "FA", "a", 30, "LIVE")], "flight_key string, duty_key string, seat string, prev_flight_key string, turn_min long, request_type string")

    def ready(tails):
        found = project.resource_ready(legs, crew, tails)
        return sorted((r.flight_key, r.resource_type, r.ready_latest_ms) for r in found.collect())

    assert ready(once) == [("b", "CREW", 0), ("b", "EQUIPMENT", 0), ("c", "EQUIPMENT", 520 * M)]
    twice = [("b", "CREW", 0), *[("b", "EQUIPMENT", 0)] * 2, *[("c", "EQUIPMENT", 520 * M)] * 2]
    assert ready(once.unionByName(once)) == twice


def test_only_swapped_tails_meet_the_service_table(spark):
    legs = settle(spark.createDataFrame([state_row("a", 0)], LEG), "legs")
    tails = spark.createDataFrame([], "airline string, tail string, ots boolean, est_return_ms long, return_ms long")
    text = project._served(legs, tails, False)._jdf.queryExecution().optimizedPlan().toString()
    assert "PE_TAIL" in text.split("Join")[1]


def test_later_rounds_write_their_waits_and_projections_only(spark, monkeypatch):
    """The times of inbound legs lie beside the waits, so a later round asks neither the crew nor the state for them again."""
    legs, links, crew = shared_crew()
    written = []
    add = graph.Rounds.add
    monkeypatch.setattr(graph.Rounds, "add", lambda self, name, number, rows: written.append((number, name)) or add(self, name, number, rows))
    run_rounds(spark, legs, links, crew, [live("a")])
    assert {name for number, name in written if number} == {"waited", "projected", "frontier"}


def test_a_continuation_is_projected_like_its_event(spark):
    rows = [
        state_row(f"{status}-{out}-{late}", 0, late, status=status, event="PE_CONTINUED")[:19] + (status, out, arrived, *state_row("x", 0)[22:28], "PE_CONTINUED", 3, 4, 5, 6)
        for status in ("ACTIVE", "CANCELLED", "ROUTE_OUT", None) for out, arrived in (("SCHEDULED", "SCHEDULED"), ("OUT", "ON"), (None, None)) for late in (0, 25)
    ]
    legs = spark.createDataFrame(rows, LEG).withColumns(
        {"rule": F.lit(None).cast("string"), "ctd_ms": F.col("std_ms") + 90 * M, **{f"max_{m}": F.col("std_ms") + 40 * M for m in project.MEASURES}}
    )
    fields = ["flight_key", "rule", *[f"new_{f}" for f in project.PROJECTED]]
    both = [sorted(map(tuple, project.project(legs, **more).select(*fields).collect())) for more in ({}, {"continued": True})]
    assert both[0] == both[1] and len(both[0]) == 24


def test_carried_inbound_times_count_like_joined_ones(spark):
    rows = [state_row("a", 0), state_row("b", 90, 25, prev="a"), state_row("c", 200, prev="b", event="PE_TAIL", request="SWAP_WHATIF"), state_row("d", 300, prev="gone")]
    legs = settle(spark.createDataFrame(rows, LEG), "legs")
    tails = spark.createDataFrame([("AA", "T1", True, 500 * M, None)], "airline string, tail string, ots boolean, est_return_ms long, return_ms long")
    kind = "flight_key string, duty_key string, seat string, prev_flight_key string, turn_min long, request_type string"
    crew = spark.createDataFrame([("b", "d", "FA", "a", 30, "LIVE"), ("c", "e", "CA", "b", 40, "SWAP_WHATIF"), ("c", "f", "FA", None, 40, "SWAP_WHATIF")], kind)
    carried = lookup.inbound(legs, legs, "prev_leg_key", project.INBOUND_TIMES), lookup.inbound(crew, legs, "prev_flight_key", project.INBOUND_TIMES)
    joined, without = (sorted(map(tuple, project.resource_ready(*both, tails).collect()), key=str) for both in ((legs, crew), carried))
    assert joined == without and len(joined) == 4


def test_a_run_reads_only_what_it_can_still_reach(spark, monkeypatch):
    """Tables cut down to the reachable legs give what the whole ones give, and the legs out of reach are not read again."""
    legs = [state_row("a", 100, late=300), state_row("z", 100, late=300), *[state_row(f"n{i}", 150 + i) for i in range(9)]]
    links, crew = [], [("b", "a", 20), ("e", "d", 20)]
    for before, leg, dep in (("a", "b", 170), ("b", "c", 240), ("c", "d", 310), ("d", "e", 380)):
        legs.append(state_row(leg, dep, prev=before))
        links.append((before, leg, "EQUIPMENT"))
    # Two days after the root a leg is visited and passes nothing on; a link that its end denies is not followed.
    legs += [state_row("f", 400, prev="e")[:1] + ("2024-01-03",) + state_row("f", 400, prev="e")[2:], state_row("g", 470, prev="f"), state_row("h", 500, prev="x")]
    links += [("e", "f", "EQUIPMENT"), ("f", "g", "EQUIPMENT"), ("d", "h", "EQUIPMENT"), ("c", "b", "CREW")]
    read, found = [], []
    within = graph._within
    monkeypatch.setattr(graph, "_within", lambda table, keys, label, key: read.append({r.flight_key for r in keys.collect()}) or within(table, keys, label, key))
    monkeypatch.setattr(graph, "FIRST_FALL", 1)
    for least in (2_000_000, 0):
        monkeypatch.setattr(graph, "NARROW_LINKS", least)
        log, patch = run_rounds(spark, legs, links, crew, [live("a"), what_if("a"), live("z")])
        found.append([sorted(map(tuple, df.collect()), key=repr) for df in (log, patch)])
        assert bool(read) == (least == 0)
    assert found[0] == found[1] and {r[7] for r in found[0][0]} >= {"a", "b", "c", "d", "e", "f", "h", "z"}
    assert "g" not in read[0] and "h" not in read[0] and not {"z", "n1"} & read[0] and {"c", "d", "e", "f"} <= read[0]
