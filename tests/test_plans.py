"""Properties of the physical plans that matter on large tables."""

import re

import pytest

import checks.jobs  # noqa: F401  (registers)
from checks.queries import REGISTRY

FACT_SCAN = r"FileScan parquet [^\n]*/(lineitem|orders)\.parquet"
STREAMS = {name for name in REGISTRY if name.startswith("stream_")}


PLANS = {}


def plan(spark, name, small):
    """The initial plan: one mention of every operator."""
    if name not in PLANS:
        PLANS[name] = REGISTRY[name](spark, small)._jdf.queryExecution().executedPlan().toString()
    return PLANS[name]


@pytest.mark.parametrize("name", sorted(set(REGISTRY) - STREAMS))
def test_no_cross_join_and_no_python(spark, small, name):
    text = plan(spark, name, small)
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "Pandas"):
        assert operator not in text


def above_fact_scans(text):
    """For every scan of a fact, the operators above it, from the scan upwards."""
    lines = [(re.search(r"[A-Za-z*]", line).start(), line) for line in text.splitlines() if re.search(r"[A-Za-z]", line)]
    for place, (depth, line) in enumerate(lines):
        if not re.search(FACT_SCAN, line):
            continue
        path = []
        for higher, operator in reversed(lines[:place]):
            if higher < depth:
                depth = higher
                path.append(operator)
        yield path


def first(path, *operators):
    return next((i for i, line in enumerate(path) if any(o in line for o in operators)), len(path))


def test_facts_are_aggregated_before_they_are_joined(spark, small):
    for name in ("top_buildings_quarter", "user_footprint", "department_summary", "building_type_summary", "peak_hours"):
        paths = list(above_fact_scans(plan(spark, name, small)))
        assert paths
        for path in paths:
            assert first(path, "HashAggregate") < first(path, "Join") < len(path), name


def test_mean_comparison_scans_the_fact_once(spark, small):
    for name in ("buildings_vs_campus_average", "user_vs_campus_average"):
        df = REGISTRY[name](spark, small)
        df.collect()
        text = df._jdf.queryExecution().executedPlan().toString()
        assert "ReusedExchange" in text


def test_top_reports_do_not_sort_everything(spark, small):
    for name in ("top_buildings_quarter", "energy_listing", "trip_listing_admin", "top_initiatives"):
        text = plan(spark, name, small)
        assert "TakeOrderedAndProject" in text and "rangepartitioning" not in text


def test_rank_filters_run_before_the_shuffle(spark, small):
    for name in ("peak_hours", "trip_listing"):
        assert plan(spark, name, small).count("WindowGroupLimit") == 2


@pytest.mark.parametrize("name", sorted(set(REGISTRY) - STREAMS))
def test_no_fact_passes_through_one_task_unaggregated(spark, small, name):
    """One task may see totals, never the rows of a fact scan."""
    for path in above_fact_scans(plan(spark, name, small)):
        assert first(path, "HashAggregate", "SortAggregate") <= first(path, "Exchange SinglePartition")


def test_scans_read_needed_columns_and_push_dates(spark, small):
    text = plan(spark, "transport_mode_breakdown", small)
    assert "PushedFilters: [IsNotNull(o_orderdate), GreaterThanOrEqual(o_orderdate" in text
    assert "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double,o_orderdate:timestamp_ntz>" in text
