import pytest
from pyspark.sql import functions as F, types as T

from terrastat.operators.ordering import dense_row_id
from terrastat.sources import (
    MODEL_SCHEMAS,
    WorkbookSource,
    literal_table,
    load_model,
    read_delimited,
    read_workbooks,
    save_model,
    sheet_columns,
    stage,
    versions,
)
from workbook_files import write_workbook

CENTRES = T.StructType(
    [
        T.StructField("ID_PROV", T.IntegerType()),
        T.StructField("Mail ", T.StringType()),
        T.StructField("Capacidad", T.DoubleType()),
    ]
)


def test_csv_scan(spark, tmp_path):
    (tmp_path / "c.csv").write_text(
        'Otra,ID_PROV,Mail ,Capacidad\n'
        'x,2,"a@x.org, ""b""",101\n'
        'x,6,NA,\n'
        'x,n/a,  b@x.org ,12x\n',
        encoding="utf-8",
    )
    df = read_delimited(spark, str(tmp_path), CENTRES)
    assert df.columns == ["ID_PROV", "Mail ", "Capacidad"]
    assert {tuple(r) for r in df.collect()} == {
        (2, 'a@x.org, "b"', 101.0),
        (6, None, None),
        (None, "  b@x.org ", None),
    }


def test_csv_multi_line(spark, tmp_path):
    (tmp_path / "c.csv").write_text('ID_PROV,Mail ,Capacidad\n1,"a\nb",2\n', encoding="utf-8")
    df = read_delimited(spark, str(tmp_path), CENTRES, multi_line=True)
    assert [tuple(r) for r in df.collect()] == [(1, "a\nb", 2.0)]


@pytest.mark.parametrize("split", ["200", "4000", "128m"])
def test_csv_order_survives_splits_and_packing(spark, tmp_path, split):
    schema = T.StructType([T.StructField("n", T.IntegerType())])
    expected = []
    for name, start, count in [("a", 0, 1500), ("b", 5000, 3), ("c", 7000, 700), ("d", 9000, 2)]:
        numbers = range(start, start + count)
        (tmp_path / f"{name}.csv").write_text("n\n" + "".join(f"{n}\n" for n in numbers))
        expected += numbers
    before = {
        key: spark.conf.get(key)
        for key in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    }
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        df = read_delimited(spark, str(tmp_path), schema, seq="seq")
        df = stage(df)
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    got = dense_row_id(df, "seq", keys=["path"], bucket_bits=6, group_bits=2).collect()
    assert [r.n for r in sorted(got, key=lambda r: r.row_id)] == expected
    assert sorted(r.row_id for r in got) == list(range(1, len(expected) + 1))


@pytest.mark.parametrize("in_tasks", [False, True])
@pytest.mark.parametrize("shared", [True, False])
def test_workbook_ingest(spark, tmp_path, shared, in_tasks):
    rows = [["title"], [None], ["Clave", "Común", "Común"], ["a<b", 1, "1"], [None], ["z", None, " "]]
    write_workbook(tmp_path / "one.xlsx", rows, shared=shared)
    (tmp_path / "sub").mkdir()
    write_workbook(tmp_path / "sub" / "two.xlsX", rows[:4], shared=shared)
    (tmp_path / "notes.txt").write_text("not a workbook")
    sheet = read_workbooks(spark, str(tmp_path), skip_rows=2, open_in_tasks=in_tasks)
    assert sheet.schema.simpleString() == "struct<path:string,row_no:bigint,cells:map<string,string>>"
    got = {(r.path.rsplit("/", 1)[1], r.row_no): r.cells for r in sheet.collect()}
    assert got == {
        ("one.xlsx", 4): {"Clave": "a<b", "Común": "1", "Común.1": "1"},
        ("one.xlsx", 5): {},
        ("one.xlsx", 6): {"Clave": "z", "Común.1": " "},
        ("two.xlsX", 4): {"Clave": "a<b", "Común": "1", "Común.1": "1"},
    }


@pytest.mark.parametrize("in_tasks", [False, True])
def test_sheet_columns(spark, tmp_path, in_tasks):
    write_workbook(tmp_path / "p.xlsx", [["x"], [None, "AREA", "Uno"], [None, "NaN", 5], [""]])
    sheet = read_workbooks(spark, str(tmp_path / "p.xlsx"), skip_rows=1, header=False, open_in_tasks=in_tasks)
    cells = sheet_columns(sheet, {"B": "Edad", "C": "Casos"}).orderBy("row_no")
    assert [tuple(r)[1:] for r in cells.collect()] == [(2, "AREA", "Uno"), (3, None, "5")]


@pytest.mark.parametrize("in_tasks", [False, True])
def test_many_rows_come_in_batches(spark, tmp_path, in_tasks):
    write_workbook(tmp_path / "long.xlsx", [["n"]] + [[i] for i in range(25_000)])
    sheet = read_workbooks(spark, str(tmp_path), open_in_tasks=in_tasks)
    total = sheet.agg(F.count(F.lit(1)), F.sum(F.col("cells")["n"].cast("bigint"))).collect()[0]
    assert tuple(total) == (25_000, sum(range(25_000)))


def test_workbook_source(spark, tmp_path):
    """Asked cells only, a task for each file or several small ones, no file's bytes in a row."""
    folder = tmp_path / "a folder"
    folder.mkdir()
    for n in range(7):
        write_workbook(folder / f"b{n}.xlsx", [["Clave", "Común", "Otra"], [f"k{n}", None, "x"], ["z", n, "y"]])
    for ignored in ("_tmp.xlsx", ".b0.xlsx", "b.csv"):
        (folder / ignored).write_text("no workbook")
    spark.dataSource.register(WorkbookSource)
    reader = spark.read.format("workbook").schema("`Común` string, path string, Clave string, `None` string")
    one_each = reader.option("taskBytes", 1).load(str(folder))
    assert one_each.rdd.getNumPartitions() == 7
    assert reader.option("taskBytes", 1 << 27).load(f"file:{folder}").rdd.getNumPartitions() == 1
    expected = [row for n in range(7) for row in ((None, f"b{n}.xlsx", f"k{n}", None), (str(n), f"b{n}.xlsx", "z", None))]
    got = [(r[0], r.path.rsplit("/", 1)[1], r[2], r[3]) for r in one_each.collect()]
    assert sorted(got, key=str) == sorted(expected, key=str)
    both = [
        {(r.path, r.row_no, tuple(sorted(r.cells.items()))) for r in read_workbooks(spark, str(folder), open_in_tasks=w).collect()}
        for w in (False, True)
    ]
    assert {r[1:] for r in both[0]} == {r[1:] for r in both[1]}
    assert {p for p, *_ in both[1]} == {f"file:{folder}/b{n}.xlsx" for n in range(7)}
    assert "content" not in _plan_of(one_each)


def _plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_workbook_source_refuses(spark, tmp_path):
    (tmp_path / "empty").mkdir()
    assert read_workbooks(spark, str(tmp_path / "empty"), open_in_tasks=True).count() == 0
    for path, said in (("*.xlsx", "not a pattern"), ("none", "FileNotFound")):
        with pytest.raises(Exception, match=said):
            read_workbooks(spark, str(tmp_path / path), open_in_tasks=True).count()
    with pytest.raises(Exception, match="row_no of a workbook is bigint"):
        spark.read.format("workbook").schema("path string, row_no int").load(str(tmp_path)).count()


def test_literal_table_has_a_known_size(spark):
    schema = MODEL_SCHEMAS["Tipos_de_establecimientos"]
    df = literal_table(spark, [(0, "a"), (1, None)], schema)
    assert df.schema == schema
    assert [tuple(r) for r in df.collect()] == [(0, "a"), (1, None)]
    assert "LocalTableScan" in df._jdf.queryExecution().executedPlan().toString()
    assert literal_table(spark, [], schema).count() == 0


MODEL_ROWS = {
    "Centros_culturales": [(1, 2, 0, 100.0, " a@x.org"), (2, 6, 28, None, None)],
    "Departamentos": [(2, 0, 'Ciudad "x", y'), (6, 28, "CAPITAL")],
    "Establecimientos_educativos": [(900000100, 6, 28, "Urbano", "Estatal")],
    "Poblacion": [(6, 28, 0, 10)],
    "Provincias": [(6, "CÓRDOBA")],
    "Tipos_de_establecimientos": [(0, "Jardin_maternal")],
    "ee_tipo_establecimiento": [(900000100, 0)],
}


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_model_roundtrip(spark, tmp_path, fmt):
    tables = {n: spark.createDataFrame(r, MODEL_SCHEMAS[n]) for n, r in MODEL_ROWS.items()}
    directory = str(tmp_path / "model")
    for _ in range(2):  # the second save replaces the first
        save_model(tables, directory, fmt=fmt)
    loaded = load_model(spark, directory, views=True)
    for name, expected in MODEL_ROWS.items():
        assert loaded[name].dtypes == tables[name].dtypes
        assert {tuple(r) for r in loaded[name].collect()} == set(expected)
        assert spark.table(name).count() == len(expected)
    save_model(tables, directory, partition_by={"Poblacion": ["id_prov"]})
    again = load_model(spark, directory)["Poblacion"]
    assert [tuple(r) for r in again.collect()] == MODEL_ROWS["Poblacion"]


def test_csv_reload_reads_missing_tokens(spark, tmp_path):
    names = {n: spark.createDataFrame([], s) for n, s in MODEL_SCHEMAS.items()}
    names["Provincias"] = spark.createDataFrame(
        [(1, "NA"), (2, ""), (3, "None"), (4, "x")], MODEL_SCHEMAS["Provincias"]
    )
    save_model(names, str(tmp_path), fmt="csv")
    got = load_model(spark, str(tmp_path))["Provincias"]
    assert {tuple(r) for r in got.collect()} == {(1, None), (2, None), (3, None), (4, "x")}


def model_of(spark, province):
    tables = {n: spark.createDataFrame(r, MODEL_SCHEMAS[n]) for n, r in MODEL_ROWS.items()}
    tables["Provincias"] = spark.createDataFrame([(6, province)], MODEL_SCHEMAS["Provincias"])
    tables["Centros_culturales"] = tables["Centros_culturales"].withColumn("Mail", F.lit(province))
    return tables


def test_a_save_that_fails_midway_leaves_the_model_as_it_was(spark, tmp_path):
    directory = str(tmp_path / "model")
    with pytest.raises(FileNotFoundError):
        load_model(spark, directory)
    save_model(model_of(spark, "OLD"), directory)
    broken = model_of(spark, "NEW")
    fourth = list(broken)[3]
    broken[fourth] = broken[fourth].withColumn("id_prov", F.raise_error(F.lit("lost")).cast("int"))
    with pytest.raises(Exception, match="lost"):
        save_model(broken, directory)
    assert len(list((tmp_path / "model" / "versions").glob("00000002-*/*/_SUCCESS"))) == 3
    loaded = load_model(spark, directory)
    assert loaded["Provincias"].collect() == [(6, "OLD")]
    assert {r.Mail for r in loaded["Centros_culturales"].collect()} == {"OLD"}
    save_model(model_of(spark, "NEW"), directory)
    # Tables that were loaded before stay on their version; older versions can be asked for.
    assert loaded["Provincias"].collect() == [(6, "OLD")]
    assert load_model(spark, directory)["Provincias"].collect() == [(6, "NEW")]
    assert load_model(spark, directory, version=1)["Provincias"].collect() == [(6, "OLD")]
    assert [r.version for r in versions(spark, directory).orderBy("version").collect()] == [1, 2]
    with pytest.raises(FileNotFoundError, match="3"):
        load_model(spark, directory, version=3)


BUCKETED = {"Establecimientos_educativos": "Cueanexo", "ee_tipo_establecimiento": "Cueanexo"}


def test_bucketed_tables_are_found_by_their_commit(spark, tmp_path):
    directory = str(tmp_path / "it's a model")
    n = 5000
    tables = model_of(spark, "OLD")
    kinds = MODEL_SCHEMAS["ee_tipo_establecimiento"].simpleString()
    tables["ee_tipo_establecimiento"] = spark.range(n).selectExpr(
        "IF(id % 50 = 0, NULL, id div 2) AS Cueanexo", "CAST(id % 2 AS INT) AS id_tipo_establecimiento"
    )
    def stored_tables():
        return {t.name for t in spark.catalog.listTables() if t.name.startswith("model_")}

    of_others = stored_tables()
    save_model(tables, directory, bucket_by=BUCKETED, buckets=3)
    loaded = load_model(spark, directory, views=True)
    stored = stored_tables() - of_others
    assert len(stored) == 2
    expected = sorted(map(str, tables["ee_tipo_establecimiento"].collect()))
    for _ in range(2):
        types = loaded["ee_tipo_establecimiento"]
        assert types.schema.simpleString() == kinds
        assert sorted(map(str, types.collect())) == expected
        assert spark.table("ee_tipo_establecimiento").count() == n
        # In a session that knows nothing of them, the tables are entered anew; the files stay.
        for name in stored:
            spark.sql(f"DROP TABLE {name}")
        loaded = load_model(spark, directory, views=True)
    files = list((tmp_path / "it's a model" / "versions").glob("*/ee_tipo_establecimiento/*.parquet"))
    assert len(files) == 3
    # A later version is stored plainly, and the earlier one stays what it is.
    save_model(model_of(spark, "NEW"), directory)
    assert load_model(spark, directory)["ee_tipo_establecimiento"].count() == 1
    assert load_model(spark, directory, version=1)["ee_tipo_establecimiento"].count() == n


def test_commits_of_before_have_no_buckets(spark, tmp_path):
    directory = str(tmp_path / "model")
    save_model(model_of(spark, "OLD"), directory)
    commits = spark.read.parquet(f"{directory}/commits").drop("buckets", "bucketed_by")
    commits.withColumn("version", F.lit(2).cast("bigint")).write.mode("append").parquet(f"{directory}/commits")
    assert load_model(spark, directory, version=2)["Provincias"].collect() == [(6, "OLD")]


def test_buckets_that_cannot_be_are_refused(spark, tmp_path):
    tables = model_of(spark, "x")
    for wrong in (
        {"fmt": "csv"},
        {"bucket_by": {"Colegios": "Cueanexo"}},
        {"partition_by": {"ee_tipo_establecimiento": ["Cueanexo"]}},
    ):
        with pytest.raises(ValueError):
            save_model(tables, str(tmp_path), **{"bucket_by": BUCKETED, **wrong})
    with pytest.raises(ValueError, match="absolute"):
        save_model(tables, "model", bucket_by=BUCKETED)


def test_an_unreadable_commit_is_not_taken_for_none(spark, tmp_path):
    (tmp_path / "commits").mkdir()
    (tmp_path / "commits" / "part-0.parquet").write_text("no parquet")
    with pytest.raises(Exception):
        load_model(spark, str(tmp_path))


def test_unknown_format_is_refused(tmp_path):
    with pytest.raises(ValueError):
        save_model({}, str(tmp_path), fmt="xml")
    with pytest.raises(ValueError, match="without tables"):
        save_model({}, str(tmp_path))
    with pytest.raises(ValueError):
        save_model({}, str(tmp_path), fmt="csv", partition_by={"Poblacion": ["id_prov"]})


@pytest.mark.parametrize("named", [True, False])
def test_stage_replaces_lineage(spark, tmp_path, named):
    df = spark.range(10).withColumn("x", F.col("id") * 2)
    staged = stage(df, str(tmp_path / "staged") if named else None)
    assert staged.schema.simpleString() == df.schema.simpleString()
    plan = staged.select("x")._jdf.queryExecution().executedPlan().toString()
    assert "Range" not in plan and "ReadSchema: struct<x:bigint>" in plan


def test_csv_files_must_agree_on_their_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text("ID_PROV,ID_DEPTO\n6,6028\n")
    schema = T.StructType(
        [T.StructField("ID_PROV", T.IntegerType()), T.StructField("ID_DEPTO", T.LongType())]
    )
    assert read_delimited(spark, str(tmp_path), schema).collect()[0].ID_DEPTO == 6028
    (tmp_path / "b.csv").write_text("ID_DEPTO,ID_PROV\n14042,14\n")
    with pytest.raises(Exception, match="(?s)header.*csv"):
        read_delimited(spark, str(tmp_path), schema).collect()


def test_cells_that_do_not_convert(spark, tmp_path):
    cells = ["101", "NAN", "1d", " nan", "12.0", "x", ""]
    (tmp_path / "a.csv").write_text("n,d\n" + "".join(f'"{c}","{c}"\n' for c in cells))
    schema = T.StructType([T.StructField("n", T.IntegerType()), T.StructField("d", T.DoubleType())])
    got = read_delimited(spark, str(tmp_path), schema, seq="seq", reject="lost").orderBy("seq").collect()
    assert [r.n for r in got] == [101, None, None, None, 12, None, None]
    assert [r.d for r in got] == [101.0, None, None, None, 12.0, None, None]
    assert [r.lost for r in got] == [False, True, True, True, False, True, False]


@pytest.mark.parametrize("in_tasks", [False, True])
def test_a_workbook_without_a_header_fails(spark, tmp_path, in_tasks):
    write_workbook(tmp_path / "good.xlsx", [["Clave", "Común"], ["a", "1"]])
    how = {"required": ["Común"], "open_in_tasks": in_tasks}
    assert read_workbooks(spark, str(tmp_path), **how).count() == 1
    write_workbook(tmp_path / "bad.xlsx", [["Clave", "Comun"], ["a", "1"]])
    with pytest.raises(Exception, match="bad.xlsx has no column Común"):
        read_workbooks(spark, str(tmp_path), **how).collect()
