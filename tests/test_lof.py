"""Line-of-flying propagation against a leg-by-leg model, and golden rows."""

import random

import pytest

from skyledger.functions.fixed_values import DELAY_TYPES
from skyledger.operators import lof
from skyledger.operators.ordered import Ordered

M = 60_000
SCHEMA = (
    "chain_id long, leg_seq long, flight_key string, std_ms long, sta_ms long, ltd_ms long, lta_ms long, "
    "ptd_ms long, pta_ms long, equip_ready_ms long, cabin_ready_ms long, cockpit_ready_ms long, "
    "mogt_min long, air_min long"
)
EVENT_SCHEMA = "chain_id long, event_seq long, event_type string, value string, prev_leg_pta_ms long"


def leg(chain, seq, ltd, lta, air, ptd, pta, mogt=40, equip=None, cabin=None, cockpit=None, std=None, sta=None):
    ms = [None if v is None else v * M for v in (ltd if std is None else std, lta if sta is None else sta, ltd, lta, ptd, pta, equip, cabin, cockpit)]
    return (chain, seq, f"{chain}-{seq}", *ms, mogt, air)


def run(spark, legs, events, limit=None, strict=False):
    """Emitted legs as {(chain, seq): (ptd, pta, equip, cabin, cockpit)} in minutes."""
    if limit:
        spark.conf.set("spark.skyledger.hotKeyRows", str(limit))
        spark.conf.set("spark.skyledger.blockRows", "40")
    try:
        df = spark.createDataFrame(legs, SCHEMA)
        line = Ordered.of(df, ["chain_id"], ["leg_seq"])
        done = lof.apply_delay(lof.attach_events(line, spark.createDataFrame(events, EVENT_SCHEMA)), strict)
        rows = lof.emitted_legs(done).collect()
    finally:
        spark.conf.unset("spark.skyledger.hotKeyRows")
        spark.conf.unset("spark.skyledger.blockRows")
    small = lambda v: None if v is None else v / M
    return {
        (r.chain_id, r.leg_seq): tuple(
            small(v) for v in (r.ptd_ms, r.pta_ms, r.equip_ready_ms, r.cabin_ready_ms, r.cockpit_ready_ms)
        )
        for r in rows
    }


def model(chain, event):
    """The same rules, one leg after the other; times in minutes."""
    kind, value, prev = event
    crew = kind in lof.CREW
    out, before = {}, None
    for i, row in enumerate(chain):
        _, seq, _, std, sta, ltd, lta, ptd, pta, eq, cab, coc = [v / M if isinstance(v, int) and k > 2 else v for k, v in enumerate(row[:12])]
        mogt, air = row[12], row[13]
        top = lambda *xs: max(x for x in xs if x is not None)
        ready = None
        if kind == "CANCEL":
            out[seq] = (std, sta, 0, 0, 0)
            break
        if i == 0 and kind == "DEP_DLY_EVENT":
            new = top(ltd, eq, coc, cab)
        elif i == 0 and kind in lof.DEPARTED:
            new = ready = value
        elif i == 0 and kind in ("ARR_DLY_EVENT", *lof.ARRIVED):
            new = ptd
        else:
            if i > 0:
                turn = 0 if kind in lof.DEPARTED + lof.ARRIVED else mogt
                ready = before + turn
            else:
                ready = (value if crew else prev) + mogt
            new = top(ltd, eq, cab, ready) if crew else top(ltd, cab, ready)
        arr = value if i == 0 and kind in lof.ARRIVED else max(lta, new + air)
        if i == 0 and kind in ("ARR_DLY_EVENT", *lof.DEPARTED, *lof.ARRIVED):
            ok = arr != pta
        else:
            ok = new != ptd and arr != pta
        if not ok:
            break
        if ready is not None:
            if kind in lof.CABIN:
                cab = ready
            elif kind in lof.COCKPIT:
                coc = ready
            else:
                eq = ready
        out[seq] = (new, arr, eq, cab, coc)
        before = arr
    return out


@pytest.mark.parametrize("limit", [None, 1])
def test_random_chains_match_the_model(spark, limit):
    rng = random.Random(7)
    legs, events, want = [], [], {}
    for chain_id in range(600):
        kind = DELAY_TYPES[chain_id % len(DELAY_TYPES)]
        maybe = lambda t: None if rng.random() < 0.4 else t + rng.randrange(0, 90)
        chain, t = [], rng.randrange(100, 200)
        for seq in range(1, rng.randrange(2, 9)):
            air, mogt = rng.randrange(10, 90), rng.randrange(0, 60)
            ltd = t + rng.choice([0, 0, 15])
            lta = ltd + air + rng.choice([0, 20])
            ptd = ltd + rng.choice([0, 0, 30])
            chain.append(
                leg(chain_id, seq, ltd, lta, air, ptd, max(lta, ptd + air), mogt, maybe(t), maybe(t), maybe(t), std=t, sta=t + air)
            )
            t += air + mogt + rng.randrange(0, 60)
        value, prev = chain[0][3] // M + rng.randrange(0, 200), chain[0][3] // M + rng.randrange(-30, 60)
        legs += chain
        events.append((chain_id, 1, kind, str(value * M), prev * M))
        for seq, row in model(chain, (kind, value, prev)).items():
            want[(chain_id, seq)] = row
    assert run(spark, legs, events, limit) == want


def test_carry_reaches_the_next_leg(spark):
    chain = [leg(1, 1, 30, 90, 60, 0, 60), leg(1, 2, 100, 160, 60, 100, 160)]
    got = run(spark, chain, [(1, 1, "DEP_DLY_EVENT", None, None)])
    assert {k: v[:2] for k, v in got.items()} == {(1, 1): (30, 90), (1, 2): (130, 190)}


def test_slack_stops_the_carry(spark):
    chain = [leg(1, 1, 30, 90, 60, 0, 60), leg(1, 2, 200, 260, 60, 200, 260)]
    got = run(spark, chain, [(1, 1, "DEP_DLY_EVENT", None, None)])
    assert set(got) == {(1, 1)}


def test_absorbed_arrival_emits_nothing(spark):
    assert run(spark, [leg(1, 1, 20, 80, 60, 0, 80)], [(1, 1, "DEP_DLY_EVENT", None, None)]) == {}


def test_actual_arrival_carries_without_turn(spark):
    chain = [leg(1, 1, 30, 90, 60, 0, 60), leg(1, 2, 100, 160, 60, 100, 160)]
    got = run(spark, chain, [(1, 1, "ACTUAL_IN_CHANGE", str(120 * M), None)])
    assert {k: v[:2] for k, v in got.items()} == {(1, 1): (0, 120), (1, 2): (120, 180)}


D, A = 1000, 1120


@pytest.mark.parametrize("late", [45, 30, 0])
def test_cancel_resets_to_schedule(spark, late):
    one = [leg(1, 1, D, A, 120, D + late, A + late, equip=D, cabin=D, cockpit=D, std=D, sta=A)]
    assert run(spark, one, [(1, 1, "CANCEL", None, None)]) == {(1, 1): (D, A, 0, 0, 0)}


@pytest.mark.parametrize("target", [1, 2])
def test_cancel_touches_only_its_leg(spark, target):
    chain = [
        leg(1, s, D + 150 * s, A + 150 * s, 120, D + 150 * s + 60, A + 150 * s + 60, std=D + 150 * s, sta=A + 150 * s)
        for s in range(1, 6)
    ]
    got = run(spark, chain, [(1, target, "CANCEL", None, None)])
    assert got == {(1, target): (D + 150 * target, A + 150 * target, 0, 0, 0)}


def test_cancel_twice_is_cancel_once(spark):
    df = spark.createDataFrame([leg(1, 1, D, A, 120, D + 45, A + 45, std=D, sta=A)], SCHEMA)
    line = Ordered(df, ("chain_id",), ("leg_seq",))
    twice = spark.createDataFrame(
        [(1, 1, "CANCEL", None, None, 1), (1, 1, "CANCEL", None, None, 2)], EVENT_SCHEMA + ", event_rank int"
    )
    row = lof.fold_events(line, twice, lambda d: d).df.first()
    assert (row.ptd_ms, row.pta_ms, row.equip_ready_ms) == (D * M, A * M, 0)


def test_unreadable_value_emits_nothing(spark):
    chain = [leg(1, 1, 30, 90, 60, 30, 90)]
    assert run(spark, chain, [(1, 1, "ACTUAL_OFF_CHANGE", "late", None)]) == {}


def test_two_events_of_a_chain_do_not_mix(spark):
    chain = [leg(1, 1, 30, 90, 60, 0, 60), leg(1, 2, 100, 160, 60, 100, 160)]
    df = spark.createDataFrame(chain, SCHEMA)
    events = spark.createDataFrame(
        [(1, 1, "DEP_DLY_EVENT", None, None), (1, 1, "ACTUAL_IN_CHANGE", str(120 * M), None)], EVENT_SCHEMA
    )
    done = lof.apply_delay(lof.attach_events(Ordered(df, ("chain_id",), ("leg_seq",)), events))
    got = sorted((r.leg_seq, r.ptd_ms // M, r.pta_ms // M) for r in lof.emitted_legs(done).collect())
    assert got == [(1, 0, 120), (1, 30, 90), (2, 120, 180), (2, 130, 190)]
    assert sorted(r.legs_seen for r in lof.audit(done).collect()) == [2, 2]


def test_fold_carries_only_chains_with_events(spark):
    legs = [leg(c, s, 100 * s, 100 * s + 60, 60, 100 * s, 100 * s + 60) for c in (1, 2) for s in (1, 2)]
    line = Ordered(spark.createDataFrame(legs, SCHEMA), ("chain_id",), ("leg_seq",))
    events = spark.createDataFrame(
        [(1, 1, "ACTUAL_OFF_CHANGE", str(150 * M), None, 1), (1, 2, "ACTUAL_OFF_CHANGE", str(400 * M), None, 2)],
        EVENT_SCHEMA + ", event_rank int",
    )
    passes = []
    done = lof.fold_events(line, events, lambda d: d, passes.append)
    got = {(r.chain_id, r.leg_seq): r.ptd_ms // M for r in done.df.collect()}
    assert got == {(1, 1): 150, (1, 2): 400, (2, 1): 100, (2, 2): 200}
    assert len(passes) == 2
