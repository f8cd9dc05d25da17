"""The bucketed operators against plain Python over the whole order."""

import random

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from terrastat.operators import ordering
from terrastat.operators.ranges import total_before
from terrastat.operators.ordering import dense_row_id, forward_fill, truncate_at_sentinel

PROPERTY = settings(
    max_examples=12,
    deadline=None,
    suppress_health_check=[HealthCheck.function_scoped_fixture],
)
ROWS = st.dictionaries(
    st.integers(-5_000, 5_000),
    st.tuples(st.none() | st.sampled_from("abc"), st.none() | st.integers(0, 9)),
    min_size=1,
    max_size=40,
)
WIDTHS = st.sampled_from([(0, 0), (1, 1), (3, 2), (6, 1), (16, 20)])


def _frame(spark, table, partitions=3):
    data = [(seq, *cells) for seq, cells in table.items()]
    random.Random(7).shuffle(data)
    return spark.createDataFrame(data, "seq bigint, a string, b int").repartition(partitions)


def _filled(table):
    out, last = {}, [None, None]
    for seq in sorted(table):
        last = [new if new is not None else old for new, old in zip(table[seq], last)]
        out[seq] = tuple(last)
    return out


@PROPERTY
@given(table=ROWS, widths=WIDTHS)
def test_forward_fill_equals_sequential_fill(spark, table, widths):
    df = forward_fill(
        _frame(spark, table), ["a", "b"], "seq", bucket_bits=widths[0], group_bits=widths[1]
    )
    assert {r.seq: (r.a, r.b) for r in df.collect()} == _filled(table)


@PROPERTY
@given(table=ROWS, widths=WIDTHS)
def test_dense_row_id_counts_in_order(spark, table, widths):
    df = dense_row_id(
        _frame(spark, table), "seq", bucket_bits=widths[0], group_bits=widths[1]
    )
    assert df.columns[0] == "row_id"
    got = {r.seq: r.row_id for r in df.collect()}
    assert got == {seq: i for i, seq in enumerate(sorted(table), 1)}


@pytest.mark.parametrize("partitions", [1, 3, 17])
def test_partitioning_does_not_matter(spark, partitions):
    rng = random.Random(3)
    table = {
        s: (rng.choice([None, None, "x", "y"]), rng.choice([None, 1, 2]))
        for s in rng.sample(range(10_000), 300)
    }
    df = _frame(spark, table, partitions)
    filled = forward_fill(df, ["a", "b"], "seq", bucket_bits=5, group_bits=2)
    assert {r.seq: (r.a, r.b) for r in filled.collect()} == _filled(table)
    ids = dense_row_id(df, "seq", bucket_bits=5, group_bits=2)
    assert sorted(r.row_id for r in ids.collect()) == list(range(1, 301))


def test_documents_are_filled_apart_and_numbered_together(spark):
    data = [("f2", 1, None), ("f2", 2, "z"), ("f1", 9, None), ("f1", 3, "a"), ("f1", 70, None)]
    df = spark.createDataFrame(data, "path string, seq bigint, a string")
    filled = forward_fill(df, ["a"], "seq", keys=["path"], bucket_bits=2, group_bits=1)
    assert {(r.path, r.seq): r.a for r in filled.collect()} == {
        ("f1", 3): "a",
        ("f1", 9): "a",
        ("f1", 70): "a",
        ("f2", 1): None,
        ("f2", 2): "z",
    }
    ids = dense_row_id(df, "seq", keys=["path"], bucket_bits=2, group_bits=1)
    assert [(r.path, r.seq) for r in sorted(ids.collect(), key=lambda r: r.row_id)] == [
        ("f1", 3),
        ("f1", 9),
        ("f1", 70),
        ("f2", 1),
        ("f2", 2),
    ]


def test_columns_may_have_dots_and_spaces(spark):
    df = spark.createDataFrame([(1, "x", "m")], "seq bigint, `a.1` string, `Mail ` string")
    for out in (
        dense_row_id(df, "seq").drop("row_id"),
        forward_fill(df, ["Mail "], "seq"),
        truncate_at_sentinel(df, F.lit(False), "seq", keys=["Mail "]),
    ):
        assert out.columns == df.columns
        assert [tuple(r) for r in out.collect()] == [(1, "x", "m")]


def test_huge_positions(spark):
    positions = [-(2**62), -1, 0, 2**40, 2**62, 2**63 - 1]
    df = spark.createDataFrame([(p, None if i else "v") for i, p in enumerate(positions)],
                               "seq bigint, a string")
    assert {r.seq: r.a for r in forward_fill(df, ["a"], "seq").collect()} == dict.fromkeys(
        positions, "v"
    )
    ids = {r.seq: r.row_id for r in dense_row_id(df, "seq").collect()}
    assert [ids[p] for p in positions] == [1, 2, 3, 4, 5, 6]


def test_truncate(spark, rows):
    df = spark.createDataFrame(
        [("d", 1, "x"), ("d", 2, "END"), ("d", 3, "y"), ("e", 5, "END"), ("f", 9, None)],
        "doc string, seq bigint, v string",
    )
    whole = truncate_at_sentinel(df, F.col("v") == "END", "seq")
    assert rows(whole) == [("d", 1, "x")]
    by_doc = truncate_at_sentinel(df, F.col("v") == "END", "seq", keys=["doc"])
    assert rows(by_doc) == [("d", 1, "x"), ("f", 9, None)]
    untouched = truncate_at_sentinel(df, F.col("v") == "nothing", "seq")
    assert untouched.count() == 5


def test_many_documents_with_any_keys(spark):
    keys = [0, 1, 65535, 65536, -1, -65537, 2**40, 2**62, -(2**63), 2**63 - 1]
    data = [(k, i) for k in keys for i in range(3)]
    df = spark.createDataFrame(data, "k bigint, s bigint").repartition(5)
    got = ordering.dense_row_id(df, "s", keys=["k"], bucket_bits=1).orderBy("row_id").collect()
    assert [(r.k, r.s) for r in got] == sorted(data)
    assert [r.row_id for r in got] == list(range(1, len(data) + 1))


@pytest.mark.parametrize("parts", ["1", "2", "7"])
def test_documents_with_texts_and_several_keys(spark, parts):
    rng = random.Random(3)
    names = ["", "a", "a ", "b", "ñ", "日", "hot"]
    data = sorted({(rng.choice(names), rng.randrange(5), i) for i in range(300)} | {("hot", 2, i) for i in range(1000, 1500)})
    df = spark.createDataFrame(data, "name string, n int, s bigint").repartition(6)
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = ordering.dense_row_id(df, "s", keys=["name", "n"], bucket_bits=4).orderBy("row_id").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "2")
    assert [tuple(r) for r in got] == [(i, *row) for i, row in enumerate(sorted(data, key=lambda r: (r[0].encode(), *r[1:])), 1)]


@pytest.mark.parametrize("parts", ["1", "5"])
def test_total_before(spark, parts):
    rng = random.Random(5)
    data = [(None, 0, 3), *[(rng.choice("abc"), i, rng.randrange(4)) for i in range(200)]]
    df = spark.createDataFrame(data, "k string, i int, n int").repartition(4)
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = {(r.k, r.i): r.sofar for r in total_before(df, ["k", "i"], "n", "sofar").collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "2")
    expected, sofar = {}, 0
    for k, i, n in sorted(data, key=lambda r: (r[0] is not None, r[0] or "", r[1])):
        expected[k, i] = sofar
        sofar += n
    assert got == expected
    assert total_before(df.limit(0), ["k"], "n", "sofar").count() == 0


@pytest.mark.parametrize("row", [(None, 1, "a"), (1, None, "a")])
def test_rows_without_a_place_are_refused(spark, row):
    df = spark.createDataFrame([(1, 2, "b"), row], "k int, s bigint, v string")
    for result in (
        lambda: ordering.dense_row_id(df, "s", keys=["k"]),
        lambda: ordering.forward_fill(df, ["v"], "s", keys=["k"]),
        lambda: ordering.truncate_at_sentinel(df, F.col("v") == "z", "s", keys=["k"]),
    ):
        with pytest.raises(Exception, match="must not be NULL"):
            result().collect()


def test_names_with_dots_and_spaces(spark, rows):
    df = spark.createDataFrame(
        [(1, 1, "a"), (1, 2, None), (1, 3, "z")], "`k.y` int, `the s` bigint, `v.x` string"
    )
    filled = ordering.forward_fill(df, ["v.x"], "the s", keys=["k.y"])
    assert filled.columns == df.columns
    assert rows(filled) == [(1, 1, "a"), (1, 2, "a"), (1, 3, "z")]
    cut = ordering.truncate_at_sentinel(df, F.col("`v.x`") == "z", "the s", keys=["k.y"])
    assert rows(cut) == [(1, 1, "a"), (1, 2, None)]
    assert ordering.dense_row_id(df, "the s", keys=["k.y"]).columns == ["row_id", *df.columns]
