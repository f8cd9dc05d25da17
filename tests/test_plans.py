"""Properties of the physical plans that have to hold at any size."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from terrastat.operators import aggregates, ordering, reshape, sketches
from terrastat.plans import study
from terrastat.plans.catalog import QUERIES
from terrastat.plans.standins import FLAGS, StandIns
from terrastat.sources import MODEL_SCHEMAS, load_model, save_model

SF_DIR = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def at_scale(spark):
    """Plan as if nothing were small enough to broadcast, with exchange reuse visible."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.enabled": "false",
    }
    before = {key: spark.conf.get(key) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    yield
    for key, value in before.items():
        spark.conf.set(key, value)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_cross_join_and_no_python(spark, at_scale, name):
    plan = _plan(QUERIES[name](spark, SF_DIR))
    for node in ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "InPandas"):
        assert node not in plan


def _scans(plan, column):
    return len(re.findall(rf"FileScan parquet [^\n]*\b{column}#", plan))


def _tables(plan):
    return Counter(re.findall(r"FileScan parquet [^\n]*?/(\w+)\.parquet\]", plan))


# Queries that read a table more than once, and why.
_LEVELS = {
    # establishments, the areas of the orders, and the departments that are taken from customers
    "customer": 3,
    # the bridge, and the areas of the lineitems
    "orders": 2,
}
READ_AGAIN = {
    "consulta_levels": _LEVELS,
    "fit_line_points": _LEVELS,
    "linear_fit": _LEVELS,
    "scatter_points": _LEVELS,
    # establishments, areas of the orders, departments; names and the row of the city
    "coverage_report": {"customer": 3, "nation": 2},
    # exact and estimated
    "estimated_totals": {"customer": 2},
    # the sketches, and the ranks of what they say
    "estimated_quartiles": {"customer": 2, "lineitem": 2},
    # establishments, and the areas of the orders
    "rate_per_thousand": {"customer": 2},
    # rows, and the bucket summary
    "dense_row_id": {"orders": 2},
    # rows, and the bucket summary; the list of documents has been written
    "dense_row_id_by_customer": {"orders": 2},
    "dense_row_id_by_name": {"orders": 2},
    "dense_row_id_by_two_keys": {"orders": 2},
    # as the sectioned report
    "reject_counts": {"orders": 4},
    "reject_table": {"orders": 4},
    # rows, buckets, and the values that buckets end with
    "forward_fill": {"orders": 3},
    # the same, and the last order, which the stand-in makes the summary line
    "sectioned_report": {"orders": 4},
    "numeric_quality": {"orders": 2},
    # the dearest order, the first row that has its price, and the rows
    "truncate_at_sentinel": {"orders": 3},
    # rows, buckets, and the cut of each document
    "truncate_by_document": {"orders": 3},
    # centres, and the departments that are taken from them
    "dominant_domain": {"events": 2},
    "threshold_count": {"events": 2},
    "threshold_with_gaps": {"events": 2},
}

# Queries whose result is read from counts that have been dealt by range and written.
WRITTEN = {"box_stats", "group_median", "price_median"}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_tables_are_scanned_once(spark, at_scale, name):
    scans = _tables(_plan(QUERIES[name](spark, SF_DIR)))
    again = READ_AGAIN.get(name, {})
    assert bool(scans) != (name in WRITTEN)
    assert {t: n for t, n in scans.items() if n > 1} == again


@pytest.mark.parametrize(
    "name", ["dense_row_id_by_customer", "dense_row_id_by_name", "dense_row_id_by_two_keys", "truncate_by_document"]
)
def test_no_window_over_all_documents(spark, at_scale, name):
    plan = _plan(QUERIES[name](spark, SF_DIR))
    partitions = re.findall(r"Window \[.*?windowspecdefinition\((.*?)specifiedwindowframe", plan)
    whole = [p for p in partitions if not re.match(r"c\d+#|_bucket|_group|_part#\d+, ", p)]
    assert len(whole) == plan.count("Exchange SinglePartition") == name.startswith("dense")
    # Without a partition only the totals of the parts are added up, a row for each.
    single = re.findall(r"Exchange SinglePartition[^\n]*\n[^\n]*HashAggregate\(keys=\[_part#\d+\]", plan)
    assert len(single) == len(whole)


@pytest.mark.parametrize("operator", ["dense_row_id", "forward_fill"])
def test_ordering_never_puts_rows_in_one_partition(spark, at_scale, operator):
    plan = _plan(QUERIES[operator](spark, SF_DIR))
    single = re.search(r"Exchange SinglePartition[^\n]*\n[^\n]*\n[^\n]*", plan)
    assert plan.count("Exchange SinglePartition") == 1
    assert re.search(r"Filter _first#|Project \[_group#", single[0])
    assert "ReusedExchange" in plan


@pytest.mark.parametrize("operator, shuffles", [("dense_row_id", 6), ("forward_fill", 7)])
def test_summaries_share_shuffles(spark, at_scale, operator, shuffles):
    plan = _plan(QUERIES[operator](spark, SF_DIR))
    assert len(re.findall(r"- Exchange ", plan)) == shuffles


@pytest.mark.parametrize("operator", ["dense_row_id", "forward_fill"])
def test_wide_rows_are_shuffled_once(spark, at_scale, operator, tmp_path):
    path = str(tmp_path / "t")
    spark.range(100).select(
        F.col("id").alias("seq"), F.lit("x").alias("a"), F.lit("payload").alias("wide")
    ).write.parquet(path)
    df = spark.read.parquet(path)
    if operator == "dense_row_id":
        plan = _plan(ordering.dense_row_id(df, "seq"))
    else:
        plan = _plan(ordering.forward_fill(df, ["a"], "seq"))
    assert _scans(plan, "wide") == 1
    # The join with the bucket summary reuses the window's partitioning and order.
    join = plan[plan.index("SortMergeJoin") :].split("\n")
    assert "Window" in join[1] or "Window" in join[2]


def test_level_pivot_join_needs_no_extra_shuffle(spark, at_scale):
    plan = _plan(QUERIES["level_pivot"](spark, SF_DIR))
    assert len(re.findall(r"[^d]Exchange hashpartitioning", plan)) == 3


def test_co_located_tables_are_joined_without_a_shuffle(spark, at_scale, tmp_path):
    t = StandIns(spark, SF_DIR)
    model = {
        "Establecimientos_educativos": t.establishments().selectExpr(
            "Cueanexo", "id_prov", "length(id_depto) AS id_depto", "'x' AS ambito", "'y' AS sector"
        ),
        "ee_tipo_establecimiento": reshape.unpivot_flags(
            t.flags(), "Cueanexo", FLAGS, type_col="id_tipo_establecimiento"
        ),
    }
    empty = {n: spark.createDataFrame([], s) for n, s in MODEL_SCHEMAS.items()}
    pivots = {}
    for kind, more in {"plain": {}, "bucketed": {"bucket_by": study.BUCKETED_BY, "buckets": 5}}.items():
        save_model({**empty, **model}, str(tmp_path / kind), **more)
        loaded = load_model(spark, str(tmp_path / kind))
        pivots[kind] = aggregates.level_pivot(
            loaded["Establecimientos_educativos"],
            loaded["ee_tipo_establecimiento"],
            key="Cueanexo",
            type_col="id_tipo_establecimiento",
            by=["id_prov", "id_depto"],
            levels=study.LEVELS,
        )
    plan = _plan(pivots["bucketed"])
    assert "Exchange" not in plan[plan.index("Join") :]
    assert plan.count("Exchange hashpartitioning") == 1
    assert "Exchange" in _plan(pivots["plain"])[_plan(pivots["plain"]).index("Join") :]
    got = {kind: sorted(map(str, pivot.collect())) for kind, pivot in pivots.items()}
    assert got["bucketed"] == got["plain"] and len(got["plain"]) > 50


def test_distinct_sketches_read_once_and_repeat_no_row(spark, at_scale):
    """The rows are sketched beside the scan; the second shuffle has a row for each area."""
    t = StandIns(spark, SF_DIR)
    total = {"region": "id_prov", "area": "id_depto", "total_regions": [2], "total_label": "ALL"}
    plan = _plan(
        sketches.estimated_distinct_with_totals(t.establishments(), value="Cueanexo", name="n", **total)
    )
    assert _tables(plan) == {"customer": 1}
    assert plan.count("Exchange hashpartitioning") == 2
    order = [plan.index(node) for node in ("hll_union_agg", "Generate inline", "hll_sketch_agg", "FileScan")]
    assert order == sorted(order)


def test_band_edges_meet_sums(spark, at_scale):
    """The table is joined above the sums per area and age."""
    plan = _plan(QUERIES["bands_by_table"](spark, SF_DIR))
    join = plan.index("Join [id_prov")
    assert "sum(Casos" in plan[join:] and "s_nationkey" in plan[join:]


def test_most_frequent_reads_its_counts_once(spark, at_scale):
    plan = _plan(QUERIES["dominant_domain"](spark, SF_DIR))
    assert "ReusedExchange" in plan


def test_filters_and_columns_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "people")
    spark.range(10).select(
        F.lit(1).alias("p"), F.col("id").alias("age"), F.lit(2).alias("n"), F.lit("x").alias("z")
    ).write.parquet(path)
    people = spark.read.parquet(path)
    bands = [aggregates.Band("a", up_to=5), aggregates.Band("b", above=5, up_to=19)]
    sums = aggregates.band_sums(
        people, ["p"], value="age", amount="n", bands=bands, highest=19
    )
    plan = _plan(sums)
    assert "LessThanOrEqual(age,19)" in plan
    assert "ReadSchema: struct<p:int,age:bigint,n:int>" in plan
    above = aggregates.count_above(people, ["p"], value="n", threshold=1, name="c")
    assert "GreaterThan(n,1)" in _plan(above)


def test_literal_dimension_is_broadcast_by_size(spark):
    plan = _plan(QUERIES["type_dimension"](spark, SF_DIR))
    assert "BroadcastHashJoin" in plan and "LocalTableScan" in plan
