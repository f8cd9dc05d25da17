"""Sectioned reports, aggregates and the reports over a small invented model."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from terrastat.operators import aggregates as agg
from terrastat.operators.joins import remap_by_table
from terrastat.operators.reports import drop_noise, sectioned_report, typed_cells
from terrastat.operators.reshape import extract_dimension, unpivot_flags
from terrastat.plans import reports
from terrastat.sources import MODEL_SCHEMAS

REPORT = [
    (0, "3", "99"),
    (1, "AREA # 02007", "Comuna 1"),
    (2, None, None),
    (3, "Edad", "Casos"),
    (4, "0", "10"),
    (5, "5", "20"),
    (6, "Total", "30"),
    (7, "AREA # 94008", "Río de prueba"),
    (8, "6", "7"),
    (9, "6x", "7"),
    (10, "RESUMEN", None),
    (11, "0", "999"),
]


@pytest.mark.parametrize("bits", [0, 2, 16])
def test_sectioned_report(spark, bits):
    df = spark.createDataFrame(REPORT, "seq bigint, Edad string, Casos string")
    flat = sectioned_report(df, seq="seq", label="Edad", value="Casos", bucket_bits=bits)
    names = {r.seq: r.area_name for r in flat.collect()}
    assert names == {0: None, 4: "COMUNA 1", 5: "COMUNA 1", 8: "RÍO DE PRUEBA",
                     9: "RÍO DE PRUEBA"}
    typed = typed_cells(flat, label="Edad", value="Casos").collect()
    assert sorted(tuple(r)[:4] for r in typed if not r.is_reject) == [
        (2, 7, 0, 10),
        (2, 7, 5, 20),
        (94, 8, 6, 7),
    ]
    assert sum(r.is_reject for r in typed) == 2


def test_noise_filter_drops_nulls(spark, rows):
    df = spark.createDataFrame([("NaN",), ("TOTAL",), (None,), ("12",)], "v string")
    assert rows(drop_noise(df, "v")) == [("12",)]


def test_unpivot_keeps_distinct_set_flags(spark, rows):
    df = spark.createDataFrame(
        [(1, "1", " ", None), (1, "1", "1", None), (2, " ", None, "0"), (None, "1", " ", " ")],
        "k bigint, f string, g string, h string",
    )
    got = unpivot_flags(df, "k", {"f": 7, "g": 8, "h": 9}, type_col="t")
    assert rows(got) == [(1, 7), (1, 8), (None, 7)]


def test_many_flags_and_flags_of_one_type(spark):
    names = [f"f {i}" for i in range(200)]
    df = spark.createDataFrame(
        [[1, *["1" if i % 3 == 0 else " " for i in range(200)]], [2, *[None] * 200]],
        ", ".join(["`k.y` int", *[f"`{n}` string" for n in names]]),
    )
    got = unpivot_flags(df, "k.y", {n: i for i, n in enumerate(names)}, type_col="t").collect()
    assert sorted(tuple(r) for r in got) == [(1, i) for i in range(0, 200, 3)]
    shared = unpivot_flags(df, "k.y", {n: i // 100 for i, n in enumerate(names)}, type_col="t")
    assert sorted(tuple(r) for r in shared.collect()) == [(1, 0), (1, 1)]


def test_levels_without_age_groups(spark):
    tables = {n: spark.createDataFrame([], s) for n, s in MODEL_SCHEMAS.items()}
    assert reports.levels_table(tables, {}).count() == 0


def test_unpivot_then_pivot_restores_the_flags(spark):
    rng = random.Random(5)
    data = [(k, *[rng.choice(["1", " ", None]) for _ in range(5)]) for k in range(50)]
    names = [f"f{i}" for i in range(5)]
    df = spark.createDataFrame(data, "k bigint, " + ", ".join(f"{n} string" for n in names))
    pairs = unpivot_flags(df, "k", {n: i for i, n in enumerate(names)}, type_col="t")
    assert {tuple(r) for r in pairs.collect()} == {
        (row[0], i) for row in data for i in range(5) if row[i + 1] == "1"
    }


def test_extract_dimension_adds_a_slice_by_position(spark, rows):
    a = spark.createDataFrame([(1, "A"), (1, "A"), (2, "B")], "id int, name string")
    b = spark.createDataFrame([(2, "B"), (3, "c")], "other int, label string")
    got = extract_dimension(a, ["id", "name"], extra=b)
    assert got.columns == ["id", "name"]
    assert rows(got) == [(1, "A"), (2, "B"), (3, "c")]


def test_remap_by_table(spark, rows):
    df = spark.createDataFrame([(94, 8, "x"), (94, 9, "y"), (6, 8, None)], "p int, d int, v string")
    moved = spark.createDataFrame([(94, 8, 7)], "p int, d int, n int")
    got = remap_by_table(df, moved, region="p", area="d", new_area="n")
    assert rows(got) == [(6, 8, None), (94, 7, "x"), (94, 9, "y")]


# -- aggregates against brute force ---------------------------------------------------------


def test_bands_equal_one_aggregate_per_band(spark):
    rng = random.Random(11)
    people = [
        (rng.randrange(4), rng.randrange(3), rng.randrange(0, 25), rng.choice([None, 1, 5]))
        for _ in range(400)
    ]
    people += [(8, 0, 3, 1), (8, 0, 15, 1)]  # no primary: left out
    people += [(9, 0, 3, 1), (9, 0, 8, 1), (9, 0, 15, 1)]  # region without an edge: left out
    people += [(7, 0, 3, None), (7, 0, 8, 1), (7, 0, 15, 1)]  # a band of NULLs stays
    edges = {12: (0, 2, 8), 13: (1, 3, 7)}
    df = spark.createDataFrame(people, "id_prov int, id_depto int, Edad int, Casos int")
    got = agg.band_sums(
        df,
        ["id_prov", "id_depto"],
        value="Edad",
        amount="Casos",
        bands=reports.school_age_bands(agg.edge_by_region("id_prov", edges)),
    )
    last = {r: edge for edge, members in edges.items() for r in members}
    expected = []
    for area in {p[:2] for p in people}:
        edge = last.get(area[0], -1)
        limits = [(-1, 5), (5, edge), (edge, 19)] if edge > 0 else [(-1, 5), (1, 0), (1, 0)]
        found = [
            [c for p, d, e, c in people if (p, d) == area and lo < e <= hi] for lo, hi in limits
        ]
        if all(found):
            sums = [
                sum(c for c in cs if c is not None) if any(c is not None for c in cs) else None
                for cs in found
            ]
            expected.append((*area, *sums))
    assert sorted(map(str, expected)) == sorted(str(tuple(r)) for r in got.collect())


@pytest.mark.parametrize("highest", [None, 25])
def test_a_region_edge_may_lie_above_the_last_band(spark, rows, highest):
    df = spark.createDataFrame([(1, 22, 5), (1, 3, 2)], "id_prov int, Edad int, Casos int")
    edge = agg.edge_by_region("id_prov", {25: (1,)})
    bands = [agg.Band("low", up_to=5), agg.Band("mid", above=5, up_to=edge)]
    got = agg.band_sums(
        df, ["id_prov"], value="Edad", amount="Casos", bands=bands, highest=highest
    )
    assert rows(got) == [(1, 2, 5)]


def test_region_under_two_edges_is_refused(spark):
    with pytest.raises(ValueError):
        agg.edge_by_region("id_prov", {12: (1, 2), 13: (2,)})


def _by_table(df, edges, **more):
    return agg.band_sums_by_table(
        df,
        ["id_prov", "id_depto"],
        edges,
        region="id_prov",
        edge="last_age",
        value="Edad",
        amount="Casos",
        bands=reports.school_age_bands,
        **more,
    )


@pytest.mark.parametrize("highest", [None, 19])
def test_edges_of_a_table_equal_edges_in_the_query(spark, rows, highest):
    """Ten thousand regions, one of them with a third of the rows."""
    rng = random.Random(12)
    people = [
        (7 if rng.random() < 0.33 else rng.randrange(10_000), rng.randrange(2), rng.randrange(0, 22), rng.choice([None, 1, 5]))
        for _ in range(60_000)
    ]
    df = spark.createDataFrame(people, "id_prov int, id_depto int, Edad int, Casos int").repartition(5)
    edges = spark.range(10_000).selectExpr("CAST(id AS INT) AS id_prov", "CAST(12 + id % 2 AS INT) AS last_age")
    got = rows(_by_table(df, edges, highest=highest))
    written_out = {12: range(0, 10_000, 2), 13: range(1, 10_000, 2)}
    expected = agg.band_sums(
        df,
        ["id_prov", "id_depto"],
        value="Edad",
        amount="Casos",
        bands=reports.school_age_bands(agg.edge_by_region("id_prov", written_out)),
    )
    assert len(got) > 100 and got == rows(expected)


def test_table_of_edges_with_gaps_and_repeats(spark, rows):
    people = [(p, 0, age, 1) for p in (1, 2, 3, None) for age in (3, 8, 13, 15)]
    df = spark.createDataFrame(people, "id_prov int, id_depto int, Edad int, Casos int")
    kind = "id_prov int, last_age int"
    said = [(1, 12), (1, 12), (1, None), (2, 13), (3, None), (None, 12), (9, 12)]
    edges = spark.createDataFrame(said, kind)
    assert rows(_by_table(df, edges)) == [(1, 0, 1, 1, 2), (2, 0, 1, 2, 1)]
    assert rows(agg.regions_without_edge(df, edges, "id_prov", "last_age")) == [(3,), (None,)]
    assert _by_table(df, edges.limit(0)).count() == 0
    assert _by_table(df.limit(0), edges).count() == 0
    with pytest.raises(Exception, match="two band edges for region 2, 13, 14"):
        _by_table(df, edges.union(spark.createDataFrame([(2, 14)], kind))).collect()


def test_table_of_edges_needs_its_region_among_the_keys(spark):
    df = spark.createDataFrame([(1, 0, 3, 1)], "id_prov int, id_depto int, Edad int, Casos int")
    edges = spark.createDataFrame([(1, 12)], "id_prov int, last_age int")
    with pytest.raises(ValueError):
        agg.band_sums_by_table(
            df, ["id_depto"], edges, region="id_prov", edge="last_age", value="Edad", amount="Casos", bands=reports.school_age_bands
        )
    with pytest.raises(ValueError):
        _by_table(df.withColumnRenamed("Casos", "last_age"), edges)


def test_totals(spark, rows):
    df = spark.createDataFrame(
        [(2, 7, 1, 5), (2, 7, 1, 6), (2, 14, 1, None), (2, 14, 2, 1), (6, 7, 3, 2), (6, 7, None, 2)],
        "p int, d int, k bigint, n int",
    )
    common = {"region": "p", "area": "d", "total_regions": [2], "total_label": 0}
    distinct = agg.distinct_with_totals(df, value="k", name="k", **common)
    assert rows(distinct) == [(2, 0, 2), (2, 7, 1), (2, 14, 2), (6, 7, 1)]
    sums = agg.sums_with_totals(df, value="n", name="n", **common)
    assert rows(sums) == [(2, 0, 12), (2, 7, 11), (2, 14, 1), (6, 7, 4)]


def test_a_detail_equal_to_the_total_is_listed_once(spark, rows):
    df = spark.createDataFrame([(2, 0, 1, 5), (2, 7, 1, 0)], "p int, d int, k bigint, n int")
    common = {"region": "p", "area": "d", "total_regions": [2], "total_label": 0}
    distinct = agg.distinct_with_totals(df, value="k", name="k", **common)
    assert rows(distinct) == [(2, 0, 1), (2, 7, 1)]
    sums = agg.sums_with_totals(df, value="n", name="n", **common)
    assert rows(sums) == [(2, 0, 5), (2, 7, 0)]


def test_most_frequent_keeps_ties(spark, rows):
    data = [(1, "a"), (1, "a"), (1, "b"), (1, "b"), (1, "c"), (2, None), (3, ""), (3, None)]
    df = spark.createDataFrame(data, "k int, v string")
    assert rows(agg.most_frequent(df, ["k"], "v")) == [(1, "a"), (1, "b"), (3, "")]


def test_most_frequent_equals_brute_force(spark):
    rng = random.Random(2)
    data = [(rng.randrange(9), rng.choice("abcdef")) for _ in range(300)]
    counts = Counter(data)
    best = {k: max(n for (kk, _), n in counts.items() if kk == k) for k, _ in data}
    df = spark.createDataFrame(data, "k int, v string")
    got = {tuple(r) for r in agg.most_frequent(df, ["k"], "v").collect()}
    assert got == {kv for kv, n in counts.items() if n == best[kv[0]]}


# -- the reports ----------------------------------------------------------------------------


@pytest.fixture(scope="module")
def model(spark):
    tables = {
        "Provincias": [(2, "CABA"), (6, "BUENOS AIRES"), (14, "CORDOBA")],
        "Departamentos": [
            (2, 7, "COMUNA 1"),
            (2, 0, "Ciudad de prueba"),
            (6, 28, "CAPITAL"),
            (6, 35, "SUR"),
            (14, 28, "CAPITAL"),
        ],
        "Establecimientos_educativos": [
            (1, 6, 28, "Urbano", "Estatal"),
            (2, 6, 28, "Rural", "Estatal"),
            (3, 6, 35, "Rural", "Privado"),
            (4, 2, 7, "Urbano", "Privado"),
            (5, 14, 28, "Urbano", "Privado"),  # no type
        ],
        "Tipos_de_establecimientos": [(0, "Jardin_maternal")],
        "ee_tipo_establecimiento": [(1, 0), (1, 1), (1, 2), (2, 2), (3, 2), (4, 4), (4, 3)],
        "Centros_culturales": [
            (1, 2, 0, 101.0, "a@x.org"),
            (2, 2, 0, 100.0, "b@x.org"),
            (3, 6, 28, 500.0, "c@Y.org"),
            (4, 6, 28, None, "d@x.org"),
            (5, 6, 28, 200.0, None),
            (6, 14, 28, 0.0, None),
        ],
        "Poblacion": [
            (p, d, age, 10)
            for p, d in [(6, 28), (6, 35), (2, 7), (14, 28)]
            for age in (0, 5, 6, 12, 13, 19, 20)
        ],
    }
    return {n: spark.createDataFrame(r, MODEL_SCHEMAS[n]) for n, r in tables.items()}


def _list(df):
    return [tuple(r) for r in df.collect()]


def test_levels_report(model):
    report = reports.levels_report(model)
    assert report.columns == [
        "Provincia",
        "Departamento",
        "Jardines",
        "Poblacion_jardin",
        "Primarias",
        "Poblacion_primaria",
        "Secundario",
        "Poblacion_secundaria",
    ]
    # The city's primary school is a year longer; the untyped establishment drops (14, 28).
    assert _list(report) == [
        ("BUENOS AIRES", "CAPITAL", 2, 20, 2, 20, 0, 20),
        ("BUENOS AIRES", "SUR", 0, 20, 1, 20, 0, 20),
        ("CABA", "COMUNA 1", 0, 20, 0, 30, 2, 10),
    ]
    kept = _list(reports.levels_report(model, keep_empty=True))
    assert ("CORDOBA", "CAPITAL", 0, 20, 0, 20, 0, 20) in kept and len(kept) == 4


def test_threshold_report(model):
    assert _list(reports.threshold_report(model)) == [
        ("BUENOS AIRES", "CAPITAL", 2),
        ("CABA", "Ciudad de prueba", 1),
    ]


def test_coverage_report_order_and_nulls(model):
    assert _list(reports.coverage_report(model)) == [
        ("BUENOS AIRES", "CAPITAL", 2, 3, 70),
        ("CABA", "Ciudad de prueba", 1, 2, 70),
        ("CORDOBA", "CAPITAL", 1, 1, 70),
        ("BUENOS AIRES", "SUR", 1, None, 70),
        ("CABA", "COMUNA 1", 1, None, 70),
    ]


def test_coverage_report_keeps_empty_departments_last(spark, model):
    extra = spark.createDataFrame([(14, 99, "VACIO")], MODEL_SCHEMAS["Departamentos"])
    wider = {**model, "Departamentos": model["Departamentos"].union(extra)}
    assert _list(reports.coverage_report(wider))[-1] == ("CORDOBA", "VACIO", None, None, None)


def test_dominant_domain_report(model, rows):
    assert rows(reports.dominant_domain_report(model)) == [
        ("BUENOS AIRES", "CAPITAL", "x.org"),
        ("BUENOS AIRES", "CAPITAL", "y.org"),
        ("CABA", "Ciudad de prueba", "x.org"),
    ]


def test_centres_by_province(model):
    assert _list(reports.centres_by_province(model)) == [
        ("BUENOS AIRES", 3),
        ("CABA", 2),
        ("CORDOBA", 1),
    ]


def test_rates(model):
    got = _list(reports.rates_by_province(model))
    assert [r[0] for r in got] == [6, 14, 2]
    assert got[0][2:] == pytest.approx((3000 / 140, 3000 / 140, 1.0))
    assert got[2][2:] == pytest.approx((2000 / 70, 1000 / 70, 0.5))


def test_rate_without_people_is_null(spark, model):
    empty = model["Poblacion"].withColumn("Casos", F.lit(0))
    got = _list(reports.rates_by_province({**model, "Poblacion": empty}))
    assert all(r[2:] == (None, None, None) for r in got) and len(got) == 3


def test_level_points_fit_and_view(model):
    levels = reports.levels_table(model)
    assert reports.level_points(levels).count() == 9
    fit = {r.nivel: r for r in reports.level_fit(levels).collect()}
    assert fit["Jardines"].slope is None  # all populations are equal
    assert fit["Primarias"].points == 3
    assert all(r.in_view for r in reports.level_scatter(levels).collect())
