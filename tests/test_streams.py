"""Streams over several micro-batches give the batch result."""

import datetime
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyledger.functions.fixed_values import STATUS_CHANGES, TIMES_CHANGES
from skyledger.operators import diff, line_fold, lof
from skyledger.operators.ordered import Ordered
from skyledger.operators.versions import KeyedState
from skyledger.plans import events as plans
from skyledger.session import run_dir, settle, settle_by
from skyledger.sources.raw_events import raw_events
from skyledger.sources import documents
from skyledger.sources.tables import SCHEMAS, table
from skyledger.streaming import changes, delays, orders
from tests.test_lof import SCHEMA as LEGS
from tests.test_lof import M, leg


@pytest.fixture(scope="module")
def parts(spark, sf_dir):
    """The events in five files, in arrival order."""
    folder = run_dir(spark, "parts")
    rows = table(spark, sf_dir, "events")
    for n in range(5):
        rows.filter((F.col("event_id") >= n * 200) & (F.col("event_id") < (n + 1) * 200)).coalesce(1).write.mode(
            "append"
        ).parquet(folder)
    return folder


def incoming(spark, folder):
    source = spark.readStream.schema(SCHEMAS["events"]).option("maxFilesPerTrigger", 1).parquet(folder)
    return raw_events(source)


def rows(df):
    columns = ["flight_key", "event_id", "event_type", "source_ts_ms", "value"]
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_windowed_state_matches_batch(spark, sf_dir, parts):
    folder = run_dir(spark, "windowed")
    got = changes.run_changes(plans.status_of(incoming(spark, parts)), STATUS_CHANGES, folder, with_cancel=True)
    assert rows(got) == rows(plans.status_diff(spark, sf_dir))
    kept = KeyedState(spark, f"{folder}/state", T.StructType.fromDDL("flight_key string"), ["flight_key"])
    assert kept.versions() == [0, 1, 2, 3, 4] and len(kept.generations()) < 4
    apart = spark.read.parquet(f"{folder}/quarantine")
    balance = {r.disposition: r["count"] for r in plans.event_disposition(spark, sf_dir).groupBy("disposition").count().collect()}
    assert apart.count() == balance["quarantined"] > 0
    assert sum(balance.values()) == table(spark, sf_dir, "events").count()


def test_state_store_matches_batch(spark, sf_dir, parts):
    folder = run_dir(spark, "stateful")
    found = changes.stateful_changes(plans.times_of(incoming(spark, parts)), TIMES_CHANGES)
    changes.drain(found, lambda df, n: df.write.parquet(f"{folder}/out/n={n}"), f"{folder}/checkpoint")
    got = spark.read.schema(found.schema).option("basePath", f"{folder}/out").parquet(f"{folder}/out/*")
    assert rows(got) == rows(plans.times_diff(spark, sf_dir))


def test_late_records_are_ignored(spark):
    data = [("F", 1, 100, "OUT"), ("F", 2, 90, "IN"), ("F", 3, 100, "OFF"), ("F", 4, 101, "OUT"), ("F", 5, 102, "OFF")]
    df = spark.createDataFrame(data, "flight_key string, event_id long, source_ts_ms long, dep_status string")
    got = diff.atomic_events(df, {"D": "dep_status"})
    assert [(r.event_id, r.value) for r in got.orderBy("event_id").collect()] == [(1, "OUT"), (5, "OFF")]


@pytest.mark.parametrize("dep, raised", [("OUT", True), (None, True), ("CANCELLED", False)])
def test_cancel_event_needs_a_flight_that_was_not_deleted(spark, dep, raised):
    schema = "flight_key string, event_id long, source_ts_ms long, leg_status string, dep_status string"
    df = spark.createDataFrame([("F", 1, 100, "CANCELLED", dep)], schema)
    got = diff.atomic_events(df, {"LEG": "leg_status"}, with_cancel=True).select("event_type").collect()
    assert ("CANCEL" in [r[0] for r in got]) is raised


def test_a_batch_that_runs_again_replaces_itself(spark):
    first = spark.createDataFrame([("F", 1, 100, "OUT")], "flight_key string, event_id long, source_ts_ms long, s string")
    second = spark.createDataFrame([("F", 2, 101, "OFF")], first.schema)
    _, events, state = diff.advance(None, first, {"S": "s"})
    assert [r.value for r in events.collect()] == ["OUT"]
    for _ in range(2):
        _, events, _ = diff.advance(state, second, {"S": "s"})
        assert [r.value for r in events.collect()] == ["OFF"]


DELAYS = "chain_id long, event_seq long, event_type string, value string"
MIXED = ("DEP_DLY_EVENT", "ARR_DLY_EVENT", "ACTUAL_OFF_CHANGE", "ACTUAL_IN_CHANGE", "GROUND_TIME_CHANGE", "CREW_CABIN_DLY_EVENT", "CREW_COCKPIT_DLY_EVENT", "CANCEL")


def line_of(spark, chains, length=4, late=30):
    legs = [leg(c, s, 100 * s + late * (s % 2), 100 * s + 60 + late, 60, 100 * s, 100 * s + 60, cabin=100 * s + 5 * c) for c in chains for s in range(1, length + 1)]
    return Ordered(spark.createDataFrame(legs, LEGS), ("chain_id",), ("leg_seq",))


def random_events(seed, chains, each):
    rng = random.Random(seed)
    return [(n, c, rng.randint(1, 4), rng.choice(MIXED), str(rng.randint(90, 600) * M)) for c in chains for n in range(1, each + 1)]


def windows_fold(line, events):
    """The same events applied pass by pass with windows."""
    ranked = events.withColumn("event_rank", F.col("event_no")).drop("event_no")
    return lof.fold_events(line, ranked, lambda d: settle(d, "test")).df


def times(df):
    return sorted(map(tuple, df.select("chain_id", "leg_seq", *lof.STORED).collect()), key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_one_pass_equals_windows(spark, seed):
    line = line_of(spark, (1, 2, 3))
    events = spark.createDataFrame(random_events(seed, (1, 2), 5), f"event_no long, {DELAYS}")
    result = settle(line_fold.folded(line.df, events, ["event_no"]), "folded")
    moved = line_fold.moved_on(line, result)
    assert times(moved) == times(windows_fold(line, events))
    audits = line_fold.audits_of(result)
    assert audits.count() == 10 and audits.agg(F.sum("legs_changed")).first()[0] == line_fold.legs_of(result).count()


def test_previous_arrival_is_looked_up(spark):
    """A ground event on the second leg takes the arrival that the first leg has by then."""
    line = line_of(spark, (1,), late=0)
    events = [(1, 1, 1, "ACTUAL_IN_CHANGE", str(300 * M)), (2, 1, 2, "GROUND_TIME_CHANGE", None)]
    result = line_fold.folded(line.df, spark.createDataFrame(events, f"event_no long, {DELAYS}"), ["event_no"])
    got = {r.leg_seq: r.ptd_ms // M for r in line_fold.moved_on(line, result).collect()}
    assert got[2] == 340
    # The first leg of a line has none before it.
    first = line_fold.folded(line.df, spark.createDataFrame([(1, 1, 1, "GROUND_TIME_CHANGE", None)], f"event_no long, {DELAYS}"), ["event_no"])
    batch = lof.apply_delay(lof.attach_events(line, spark.createDataFrame([(1, 1, "GROUND_TIME_CHANGE", None)], DELAYS)))
    assert line_fold.legs_of(first).count() == lof.emitted_legs(batch).count()


def stream_of(spark, batches, schema):
    source = run_dir(spark, "delay-source")
    for batch in batches:
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(source)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)


def test_order_of_files_does_not_matter(spark):
    """Numbered events dealt over four files in three ways, with repeated deliveries and a value that is none."""
    line, schema = line_of(spark, (1, 2)), f"event_no long, {DELAYS}"
    events = random_events(9, (1, 2), 6)
    events[3] = (4, 1, 1, "ACTUAL_OFF_CHANGE", "late")
    sound = [e for e in events if e[4] != "late"]
    want = times(windows_fold(line, renumbered(spark, sound, schema)))
    for seed in range(3):
        rng = random.Random(seed)
        own = events + [events[0], events[7]]
        rng.shuffle(own)
        folder = run_dir(spark, "delay-run")
        _, audit = delays.run_delays(stream_of(spark, [own[n::4] for n in range(4)], schema), line, folder)
        got = delays.current(line.df, line.df.select("chain_id").distinct(), delays.times_after(spark, folder).read())
        assert times(got) == want
        assert spark.read.parquet(f"{folder}/quarantine").count() >= 1
        assert spark.read.schema(delays.AUDIT_SCHEMA).parquet(audit).count() == len(sound)


def renumbered(spark, events, schema):
    """Numbers without gaps, for the passes."""
    seen, out = {}, []
    for e in sorted(events, key=lambda e: (e[1], e[0])):
        seen[e[1]] = seen.get(e[1], 0) + 1
        out.append((seen[e[1]], *e[1:]))
    return spark.createDataFrame(out, schema)


def test_a_gap_that_stays_is_passed_at_the_end(spark):
    line, schema = line_of(spark, (1,)), f"event_no long, {DELAYS}"
    events = [(1, 1, 1, "ACTUAL_OFF_CHANGE", str(250 * M)), (3, 1, 2, "ACTUAL_IN_CHANGE", str(500 * M))]
    folder = run_dir(spark, "delay-run")
    delays.run_delays(stream_of(spark, [events[1:], events[:1]], schema), line, folder)
    got = {r.leg_seq: r.pta_ms // M for r in delays.times_after(spark, folder).read().collect()}
    assert got[1] == 310 and got[2] == 500


def test_a_long_event_list_is_one_pass(spark):
    """A line with 3,000 events beside others: the same times as the events one by one."""
    line = line_of(spark, (1, 2))
    rng = random.Random(4)
    events = [(n, 1, 1, "ACTUAL_OFF_CHANGE", str(rng.randint(100, 400) * M)) for n in range(1, 3001)] + [(1, 2, 1, "ACTUAL_OFF_CHANGE", str(150 * M))]
    result = line_fold.folded(line.df, spark.createDataFrame(events, f"event_no long, {DELAYS}"), ["event_no"])
    got = {(r.chain_id, r.leg_seq): r.ptd_ms for r in line_fold.moved_on(line, result).collect()}
    assert got[(1, 1)] == int(events[2999][4]) and got[(2, 1)] == 150 * M
    assert line_fold.audits_of(result).count() == 3001


def test_repeated_orders_go_and_the_state_stays_small(spark):
    """Repetitions inside a file, over two files and after the delay; the state forgets what is past."""
    schema = "order_id long, total_cents long, received_at timestamp"
    hour = lambda h, m=0: datetime.datetime(2024, 1, 1 + h // 24, h % 24, m)
    batches = [[(n, n * 10, hour(n)) for n in range(0, 20)] + [(3, 30, hour(3, 30))], [(19, 190, hour(19, 50))] + [(n, n * 10, hour(n)) for n in range(20, 60)], [(90, 900, hour(90))], [(91, 910, hour(91))]]
    folder, seen = run_dir(spark, "orders"), []
    stream = orders.first_receipts(stream_of(spark, batches, schema))
    query = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    got = sorted(r.order_id for r in spark.read.schema(schema).parquet(f"{folder}/out").collect())
    assert got == [*range(60), 90, 91]
    seen = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert max(seen) > 20 and seen[-1] <= 3


NESTED = T.StructType([T.StructField("k", T.LongType()), T.StructField("group", T.StructType([T.StructField("at", T.LongType()), T.StructField("name", T.StringType())]))])


def test_broken_documents_are_counted_and_the_others_pass(spark):
    texts = ['{"k":1,"group":{"at":5,"name":"x"}}', '{"k":2,"group":null}', '{"k":3,"more":[1]}', '{"k":4,"group":{"at":', '{"k":"five"}', '{"k":6,"group":{"at":"soon"}}', "[]", "", "null", None, "no json"]
    rows = documents.parsed(spark.createDataFrame([(t,) for t in texts], "document string"), NESTED)
    good = sorted((r.k, r.group and r.group.at) for r in documents.accepted(rows).collect())
    assert good == [(1, 5), (2, None), (3, None)]
    apart = documents.quarantined(rows)
    assert apart.count() + len(good) == len(texts)
    assert apart.filter("error = 'no document'").count() == 1


def test_a_batch_does_not_shuffle_or_store_legs_that_stay(spark):
    """Bucketed lines meet a batch's lines where they lie; the state has moved legs only, and earlier moves stay."""
    line = line_of(spark, (1, 2), late=0)
    lines = line.on(settle_by(line.df, "line", "chain_id"))
    schema = f"event_no long, {DELAYS}"
    events = [(1, 1, 2, "ACTUAL_OFF_CHANGE", str(900 * M)), (2, 1, 4, "ACTUAL_OFF_CHANGE", str(2000 * M))]
    folder = run_dir(spark, "delay-run")
    delays.run_delays(stream_of(spark, [[e] for e in events], schema), lines, folder)
    kept = {(r.chain_id, r.leg_seq) for r in delays.times_after(spark, folder).read().collect()}
    assert (1, 2) in kept and (1, 4) in kept and (1, 1) not in kept and all(c == 1 for c, _ in kept)
    got = delays.current(line.df, None, delays.times_after(spark, folder).read())
    assert times(got) == times(windows_fold(line, spark.createDataFrame(events, schema)))
    text = line_fold.folded(lines.df, spark.createDataFrame(events, schema), ["event_no"])._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in text
