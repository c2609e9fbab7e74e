"""Physical plans: shuffles, pushed-down columns, no Python and no cross joins."""

import pytest

import __spark_entry__ as contract
from skyledger.operators.ordered import BLOCK_ROWS_CONF, HOT_ROWS_CONF


def plan(df) -> str:
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "simple")


@pytest.fixture(scope="module")
def queries():
    return contract.queries()


def test_line_of_flying_shuffles_each_table_once(spark, sf_dir, queries):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(queries["lof_departure_delay"](spark, sf_dir))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert text.count("Exchange hashpartitioning") == 2
    assert "Python" not in text and "Pandas" not in text


def test_only_needed_columns_are_read(spark, sf_dir, queries):
    text = plan(queries["lof_departure_delay"](spark, sf_dir))
    assert "l_extendedprice" not in text and "o_totalprice" not in text


@pytest.mark.parametrize("name", ["prev_leg_resolved", "crew_context", "change_events", "dashboard_totals", "edges"])
def test_no_cross_joins(spark, sf_dir, queries, name):
    text = plan(queries[name](spark, sf_dir))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_change_detection_has_one_shuffle(spark, sf_dir, queries):
    text = plan(queries["times_diff"](spark, sf_dir))
    assert text.count("Exchange hashpartitioning") == 1


def test_indexed_find_filters_early(spark, sf_dir, queries):
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    try:
        text = plan(queries["indexed_find"](spark, sf_dir))
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    for column in ("airline", "flight_number", "dep_station", "arr_station"):
        assert f"EqualTo({column}," in text
    assert "Join" not in text and "Window" not in text


@pytest.mark.parametrize("name, joins", [("sales_trend", 1), ("supplier_score", 1), ("po_by_supplier", 2), ("order_value", 1)])
def test_reports_join_only_what_they_read(spark, sf_dir, queries, name, joins):
    text = plan(queries[name](spark, sf_dir))
    assert text.count("Join") == joins and "supplier.parquet" not in text


def test_cut_keys_keep_one_scan_of_the_rest(spark, sf_dir, queries):
    spark.conf.set(HOT_ROWS_CONF, "2")
    spark.conf.set(BLOCK_ROWS_CONF, "500")
    try:
        text = plan(queries["times_diff"](spark, sf_dir))
    finally:
        spark.conf.unset(HOT_ROWS_CONF)
        spark.conf.unset(BLOCK_ROWS_CONF)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_cycle_guard_tells_the_path(spark, sf_dir, queries):
    rows = queries["cycle_guard"](spark, sf_dir).limit(50).collect()
    assert rows and all(r.path.split(",") == sorted({r.start, r["at"], r.dst}) for r in rows)


def test_links_are_written_with_the_columns_they_need(spark, sf_dir):
    from skyledger.plans import graph

    wide = graph._links(spark, sf_dir)[0]
    assert "ptd_ms" not in wide.columns and "tail" not in wide.columns


def test_documents_are_parsed_once(spark, sf_dir, queries):
    text = queries["document_routing"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    # The document and the short properties of an event.
    assert text.count("from_json(") == 2
    assert "RoundRobinPartitioning" in text


@pytest.mark.parametrize("name, most", [("published_times", 6), ("resource_ready", 5)])
def test_resources_do_not_shuffle_the_state(spark, sf_dir, queries, name, most):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(queries[name](spark, sf_dir))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert text.count("Exchange hashpartitioning") <= most


@pytest.mark.parametrize("name, most", [("resource_ready", 3), ("max_ready_by_leg", 4), ("most_restrictive_resource", 4), ("projected_departure", 5), ("problem_rows", 5)])
def test_inbound_times_come_with_the_scans(spark, sf_dir, queries, name, most):
    """The state meets itself for no resource; what an inbound leg's times follow from comes from the scan that finds it."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(queries[name](spark, sf_dir))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert text.count("Exchange hashpartitioning") <= most


def test_cut_lines_and_duties_give_the_same_resources(spark, sf_dir, queries):
    def rows():
        return sorted(queries["resource_ready"](spark, sf_dir).collect(), key=str)

    whole = rows()
    spark.conf.set(HOT_ROWS_CONF, "33")
    spark.conf.set(BLOCK_ROWS_CONF, "500")
    try:
        assert rows() == whole and len(whole) > 10_000
    finally:
        spark.conf.unset(HOT_ROWS_CONF)
        spark.conf.unset(BLOCK_ROWS_CONF)


def test_legs_and_candidates_meet_by_one_shuffle(spark, sf_dir, queries):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(queries["prev_leg_resolved"](spark, sf_dir))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert text.count("Exchange hashpartitioning") == 1 and "Join" not in text


def test_very_large_match_groups_give_the_same_previous_legs(spark, sf_dir, queries):
    def rows():
        return sorted(queries["prev_leg_resolved"](spark, sf_dir).collect(), key=str)

    whole = rows()
    spark.conf.set(HOT_ROWS_CONF, "6")
    try:
        assert rows() == whole and {r.rule for r in whole} == {"none", "single", "tail", "nearest"}
    finally:
        spark.conf.unset(HOT_ROWS_CONF)
