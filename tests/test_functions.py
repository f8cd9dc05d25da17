import duckdb
import pandas as pd
from pyspark.sql import functions as F

from terrastat.functions import (
    email_domain,
    first_email,
    is_glued_key_reject,
    is_location_reject,
    is_number,
    location_department,
    location_province,
    split_glued_key,
    to_number,
    to_whole,
    trim_unicode,
)
from terrastat.operators.joins import remap, remap_by_table

MAILS = {
    None: (None, None),
    "a@x.org": ("a@x.org", "x.org"),
    "A1@Mail.Com": ("A1@Mail.Com", "mail.com"),
    "a@x.org, b@y.org": ("a@x.org", "x.org"),
    "a@x.org,b@z.org": ("a@x.org", "x.org"),
    "a@x.org b@y.org": ("a@x.org", "x.org"),
    " a@x.org ": ("a@x.org", "x.org"),
    "\u00a0a@x.org\u00a0": ("a@x.org", "x.org"),
    "a @x.org,b@y.org": ("a@x.org", "x.org"),
    "s/d": (None, None),
    "s/d a@b.com": (None, None),
    ",a@b.com": (None, None),
    "": (None, None),
    "u@": ("u@", ""),
    "a@x.org;b@y.org": ("a@x.org;b@y.org", "x.org;b"),
}


def _one(spark, values, kind="string"):
    return spark.createDataFrame([(v,) for v in values], f"v {kind}")


def test_first_email_and_domain(spark):
    mail = first_email(F.col("v"))
    df = _one(spark, MAILS).select("v", mail.alias("m"), email_domain(mail).alias("d"))
    assert {r.v: (r.m, r.d) for r in df.collect()} == MAILS


def test_domain_can_drop_empty(spark):
    df = _one(spark, ["u@", "a@b"]).select(email_domain(F.col("v"), drop_empty=True).alias("d"))
    assert [r.d for r in df.collect()] == [None, "b"]


def test_trim_strips_unicode_spaces_but_not_tabs(spark):
    df = _one(spark, ["\u2003 a b\u3000\u00a0", "\ta\t", " ", None])
    assert [r[0] for r in df.select(trim_unicode(F.col("v"))).collect()] == [
        "a b",
        "\ta\t",
        "",
        None,
    ]


def test_trim_strips_what_sql_trim_strips(spark):
    candidates = [chr(i) for i in [*range(1, 0x21), 0x85, 0xA0, 0x1680, 0x180E,
                                   *range(0x2000, 0x2070), 0x3000, 0xFEFF]]
    con = duckdb.connect()
    expected = [con.execute("SELECT trim(?)", [c + "x" + c]).fetchall()[0][0] for c in candidates]
    df = spark.createDataFrame([(i, c + "x" + c) for i, c in enumerate(candidates)],
                               "i int, v string")
    got = df.select("i", trim_unicode(F.col("v")).alias("t")).orderBy("i").collect()
    assert [r.t for r in got] == expected


def test_numbers_are_what_a_numeric_column_accepts(spark):
    cells = ["1", "-1", "+1", " 5 ", "5.", ".5", "1E3", "1e+3", "1e-3", "e3", "1e", "1_000",
             "1,000", "0x10", "1d", "1f", "inf", "-Infinity", "iNf", "nan", "", "  ", "1 2",
             "\t5\n", "1.2.3", "--1", "\u0663", "True", "-", ".", "0005", "1L", "5%"]
    expected = pd.to_numeric(pd.Series(cells, dtype=object), errors="coerce")
    df = spark.createDataFrame(list(enumerate(cells)), "i int, v string")
    got = df.select("i", to_number(F.col("v")).alias("n")).orderBy("i").collect()
    assert [r.n for r in got] == [None if pd.isna(n) else n for n in expected]


def test_location_codes(spark):
    cases = [
        ("6028010", "CAPITAL", 6, 28, False),
        ("14042010", "CAPITAL", 14, 42, False),
        ("2005010", "COMUNA 5", 2, 35, False),
        (None, "CAPITAL", None, None, True),
        ("123456", "CAPITAL", 12, 345, True),
        ("60x8010", "CAPITAL", 6, None, True),
    ]
    df = spark.createDataFrame([c[:2] for c in cases], "code string, district string")
    code = F.col("code")
    got = df.select(
        "code",
        "district",
        location_province(code),
        location_department(code, F.col("district")),
        is_location_reject(code),
    ).collect()
    assert [tuple(r) for r in got] == cases


def test_split_glued_key(spark):
    df = _one(spark, ["2000", "6028", "14042", None])
    got = df.select(*split_glued_key(F.col("v"))).collect()
    assert [tuple(r) for r in got] == [(2, 0), (6, 28), (14, 42), (None, None)]


def test_glued_key_rejects(spark):
    df = _one(spark, ["2000", "14042", "12", "abc12", "141234", None])
    got = df.select(is_glued_key_reject(F.col("v"))).collect()
    assert [r[0] for r in got] == [False, False, True, True, True, True]


def test_remap_uses_the_original_number(spark, rows):
    df = spark.createDataFrame([(94, 8), (94, 15), (94, 7), (6, 8), (None, 8)], "p int, d int")
    moved = remap(df, {(94, 8): 15, (94, 15): 14}, region="p", area="d")
    assert moved.dtypes == df.dtypes
    assert rows(moved) == [(6, 8), (94, 7), (94, 14), (94, 15), (None, 8)]
    assert rows(remap(df, {}, region="p", area="d")) == rows(df)


def test_remap_of_many_pairs(spark):
    df = spark.range(6000).selectExpr("1 AS p", "CAST(id AS INT) AS d")
    moved = remap(df, {(1, i): i + 100_000 for i in range(5000)}, region="p", area="d")
    assert moved.count() == 6000
    assert moved.where("d >= 100000").count() == 5000


def test_a_pair_listed_twice_moves_once(spark, rows):
    df = spark.createDataFrame([(1, 1)], "p int, d int")
    moved = spark.createDataFrame([(1, 1, 9), (1, 1, 7)], "p int, d int, n int")
    assert rows(remap_by_table(df, moved, region="p", area="d", new_area="n")) == [(1, 7)]


def test_whole_numbers(spark):
    cases = {"12": 12, " 12.0 ": 12, "1e2": 100, "12.5": None, "1d": None, "nan": None, "x": None, None: None}
    got = _one(spark, cases).select("v", to_whole(F.col("v"), "int").alias("n")).collect()
    assert {r.v: r.n for r in got} == cases


def test_number_coercion(spark):
    cases = {
        "AREA": None,
        "nan": None,
        None: None,
        "1d": None,
        "1f": None,
        "": None,
        "0x1": None,
        "1e3": 1000.0,
        " 5 ": 5.0,
        "-.5": -0.5,
        "7.": 7.0,
        "inf": float("inf"),
    }
    df = _one(spark, cases).select("v", to_number(F.col("v")).alias("n"), is_number(F.col("v")))
    got = df.collect()
    assert {r.v: r.n for r in got} == cases
    assert all(r[2] == (r.n is not None) for r in got)


def test_digits_only_cast(spark):
    df = _one(spark, ["12.7", "", "7"]).select(F.col("v").try_cast("int"))
    assert [r[0] for r in df.collect()] == [None, None, 7]
