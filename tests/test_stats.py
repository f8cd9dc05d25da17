import random

import numpy as np
import pytest

from terrastat.operators import quality, stats


def _points(spark, groups):
    data = [(g, v) for g, values in groups.items() for v in values]
    return spark.createDataFrame(data, "g string, v bigint")


def test_box_stats(spark):
    groups = {
        "plain": [1, 2, 3, 4],
        "far": [1, 2, 3, 4, 100],
        "inside": [0, 0, 0, 100],  # the upper whisker may not end inside the box
        "one": [7],
        "holes": [5, None, 5],
    }
    boxes = stats.box_stats(_points(spark, groups), group="g", value="v")
    got = {r.g: r for r in boxes.collect()}

    def box(g):
        return tuple(got[g])[1:]

    assert box("plain") == (4, 1.75, 2.5, 3.25, 1.0, 4.0, 0)
    assert box("far") == (5, 2.0, 3.0, 4.0, 1.0, 4.0, 1)
    assert box("inside") == (4, 0.0, 0.0, 25.0, 0.0, 25.0, 1)
    assert box("one") == (1, 7.0, 7.0, 7.0, 7.0, 7.0, 0)
    assert box("holes") == (2, 5.0, 5.0, 5.0, 5.0, 5.0, 0)


def test_nan_is_no_point(spark):
    nan = float("nan")
    data = [("a", v) for v in (1.0, 2.0, 3.0, 4.0, nan, None)] + [("b", nan)]
    points = spark.createDataFrame(data, "g string, v double")
    median = stats.group_quantiles(points, group="g", value="v", quantiles={"m": 0.5})
    assert [tuple(r) for r in median.collect()] == [("a", 4, 2.5)]
    assert [r.outliers for r in stats.box_stats(points, group="g", value="v").collect()] == [0]
    assert stats.box_outliers(points, group="g", value="v").count() == 0
    xy = [("s", 1.0, 3.0), ("s", 2.0, 5.0), ("s", nan, 1.0), ("s", 1.0, nan)]
    (fit,) = stats.linear_fit(
        spark.createDataFrame(xy, "s string, x double, y double"), series="s", x="x", y="y"
    ).collect()
    assert (fit.slope, fit.intercept, fit.points) == (2.0, 1.0, 2)


def test_quantiles_of_any_numbers(spark):
    rng = random.Random(9)
    groups = {
        "wide": [rng.choice([-1, 1]) * 10 ** rng.uniform(-300, 300) for _ in range(301)],
        "near": [1 + rng.random() * 1e-12 for _ in range(200)],
        "tiny": [0.0, -0.0, 5e-324, -5e-324, 1e-310],
        "mixed": [rng.gauss(0, 1) for _ in range(500)] + [0.0] * 100,
        None: [1.0, 2.0],
    }
    points = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs], "g string, v double")
    asked = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.9, "e": 1.0}
    got = {r.g: r for r in stats.group_quantiles(points, group="g", value="v", quantiles=asked).collect()}
    assert set(got) == set(groups)
    for g, values in groups.items():
        expected = np.quantile(values, list(asked.values()))
        assert [got[g][n] for n in asked] == pytest.approx(list(expected), rel=1e-12)


@pytest.mark.parametrize("parts", ["1", "3", "40"])
def test_groups_over_many_parts(spark, parts):
    rng = random.Random(11)
    groups = {
        "hot": [rng.gauss(0, 1) for _ in range(3000)] + [0.5] * 2000,
        "one value": [3.0] * 500,
        **{f"small {i}": [rng.random() for _ in range(rng.randint(1, 6))] for i in range(60)},
        None: [rng.random() for _ in range(400)],
        "": [1.0, 4.0],
    }
    data = [(g, v) for g, vs in groups.items() for v in vs]
    points = spark.createDataFrame(data, "g string, v double").repartition(5)
    asked = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.99, "e": 1.0}
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = stats.group_quantiles(points, group="g", value="v", quantiles=asked).collect()
        boxes = stats.box_stats(points, group="g", value="v").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "2")
    assert len(got) == len(boxes) == len(groups)
    for r in got:
        assert r.points == len(groups[r.g])
        assert [r[n] for n in asked] == pytest.approx(list(np.quantile(groups[r.g], list(asked.values()))), rel=1e-12)
    for r in boxes:
        assert (r.q1, r.median, r.q3) == pytest.approx(tuple(np.quantile(groups[r.g], [0.25, 0.5, 0.75])), rel=1e-12)


def test_quantiles_of_nothing(spark):
    empty = spark.createDataFrame([("a", None)], "g string, v double")
    assert stats.group_quantiles(empty, group="g", value="v", quantiles={"m": 0.5}).collect() == []
    assert stats.box_stats(empty, group="g", value="v").collect() == []


def test_counts_are_not_shuffled_again(spark):
    points = spark.range(10).selectExpr("id % 2 AS g", "CAST(id AS DOUBLE) AS v")
    df = stats.group_quantiles(points, group="g", value="v", quantiles={"m": 0.5})
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "percentile" not in plan and "collect" not in plan and "Join" not in plan
    assert "Exchange" not in plan


def test_box_parts_add_up(spark):
    rng = random.Random(4)
    groups = {g: [int(rng.gauss(50, 20)) ** 2 for _ in range(200)] for g in "abc"}
    points = _points(spark, groups)
    far = stats.box_outliers(points, group="g", value="v").collect()
    for r in stats.box_stats(points, group="g", value="v").collect():
        values = groups[r.g]
        assert (r.q1, r.median, r.q3) == pytest.approx(tuple(np.percentile(values, [25, 50, 75])))
        outside = sorted(v for v in values if v < r.whisker_low or v > r.whisker_high)
        assert outside == sorted(f.v for f in far if f.g == r.g)
        assert len(outside) == r.outliers


def test_group_median(spark):
    got = stats.group_quantiles(
        _points(spark, {"a": [1, 2, 3, 4], "b": [9]}), group="g", value="v",
        quantiles={"median": 0.5},
    )
    assert {tuple(r) for r in got.collect()} == {("a", 4, 2.5), ("b", 1, 9.0)}


def test_fit_equals_polyfit(spark):
    rng = random.Random(6)
    xy = [(float(x), 3 * x + rng.random() * 10) for x in range(40)]
    df = spark.createDataFrame([("s", *p) for p in xy] + [("s", None, 1.0)],
                               "s string, x double, y double")
    fit = stats.linear_fit(df, series="s", x="x", y="y")
    (row,) = fit.collect()
    slope, intercept = np.polyfit(*zip(*xy), deg=1)
    assert (row.slope, row.intercept) == pytest.approx((slope, intercept))
    assert row.points == 40
    line = stats.fit_line_points(fit, series="s", n=5).orderBy("i").collect()
    assert [r.x for r in line] == pytest.approx(list(np.linspace(0, 39, 5)))
    assert [r.y for r in line] == pytest.approx([slope * r.x + intercept for r in line])


def test_degenerate_fits(spark):
    df = spark.createDataFrame(
        [("flat", 1.0, 2.0), ("flat", 2.0, 2.0), ("wall", 1.0, 1.0), ("wall", 1.0, 2.0),
         ("dot", 1.0, 1.0)],
        "s string, x double, y double",
    )
    got = {r.s: r for r in stats.linear_fit(df, series="s", x="x", y="y").collect()}
    assert got["flat"].r2 == 1.0 and got["flat"].slope == 0.0
    assert got["wall"].r2 is None and got["wall"].slope is None
    assert got["dot"].r2 is None


def test_view_is_closed(spark):
    df = spark.createDataFrame([(0.0, 80.0), (15000.0, 0.0), (15001.0, 1.0), (1.0, 81.0)],
                               "x double, y double")
    got = stats.scatter_points(df, x="x", y="y", x_view=(0, 15_000), y_view=(0, 80))
    assert [r.in_view for r in got.collect()] == [True, True, False, False]


def test_numeric_quality(spark):
    cells = ["AREA", "nan", None, "1d", "1e3", " 5 "]
    df = spark.createDataFrame([(c,) for c in cells], "v string")
    (row,) = quality.numeric_quality(df, "v").collect()
    assert tuple(row) == (6, 4, pytest.approx(400 / 6))


def test_contact_quality(spark):
    mails = [None, "a@x.org", "a@x.org, b@y.org", "a@x.org,b@z.org", " a@x.org ", "s/d",
             "\u00a0a@x.org\u00a0", "u@"]
    df = spark.createDataFrame([(m,) for m in mails], "v string")
    (row,) = quality.contact_quality(df, "v").collect()
    assert tuple(row) == (8, 2, 3, 25.0, 37.5)


def test_flag_quality(spark):
    df = spark.createDataFrame([("1", "1"), (" ", None)], "f string, g string")
    (row,) = quality.flag_quality(df, ["f", "g"]).collect()
    assert tuple(row) == (4, 2, 50.0)


def test_quality_of_nothing_is_null(spark):
    empty = spark.createDataFrame([], "v string")
    assert quality.numeric_quality(empty, "v").collect()[0].pct_non_numeric is None
    assert quality.flag_quality(empty, ["v"]).collect()[0].pct_unset is None
