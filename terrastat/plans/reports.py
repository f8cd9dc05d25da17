"""The reports and chart tables over the model.

Each takes model tables and returns a lazy DataFrame. Detail tables are aggregated to one row per
area before names are joined, so no join sees a hot area. Sorts name the place of NULLs, because
Spark's default differs from the SQL the reports are specified in (NULLs last in both directions).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import email_domain
from ..operators import stats
from ..operators.aggregates import (
    Band,
    band_sums,
    count_above,
    count_rows,
    distinct_with_totals,
    edge_by_region,
    level_pivot,
    most_frequent,
    sums_with_totals,
)
from ..operators.joins import left_chain, lookup, star
from ..operators.reshape import to_long
from . import study

AREA = ["id_prov", "id_depto"]


def area_names(departments: DataFrame, provinces: DataFrame) -> DataFrame:
    """(id_prov, id_depto, Departamento, Provincia) for every department of a known province."""
    return lookup(
        departments.select(*AREA, F.col("nombre").alias("Departamento")),
        provinces.select("id_prov", F.col("nombre").alias("Provincia")),
        "id_prov",
    )


def school_age_bands(last_primary: Column) -> list[Band]:
    nursery, primary, secondary = study.POPULATION_COLUMNS
    return [
        Band(nursery, up_to=study.LAST_NURSERY_AGE),
        Band(primary, above=study.LAST_NURSERY_AGE, up_to=last_primary),
        Band(secondary, above=last_primary, up_to=study.LAST_SECONDARY_AGE),
    ]


def provinces_without_edge(
    provinces: DataFrame,
    last_primary_age: Mapping[int, Sequence[int]] = study.LAST_PRIMARY_AGE,
) -> DataFrame:
    """Provinces listed under no school age. The levels report leaves them out."""
    return provinces.where(edge_by_region("id_prov", last_primary_age).isNull())


def levels_table(
    model: Mapping[str, DataFrame],
    last_primary_age: Mapping[int, Sequence[int]] = study.LAST_PRIMARY_AGE,
    *,
    keep_empty: bool = False,
) -> DataFrame:
    """Establishments per level and people of the matching ages, per department; unsorted."""
    bands = band_sums(
        model["Poblacion"],
        AREA,
        value="Edad",
        amount="Casos",
        bands=school_age_bands(edge_by_region("id_prov", last_primary_age)),
        highest=max([study.LAST_SECONDARY_AGE, *last_primary_age]),
    )
    levels = level_pivot(
        model["Establecimientos_educativos"],
        model["ee_tipo_establecimiento"],
        key="Cueanexo",
        type_col="id_tipo_establecimiento",
        by=AREA,
        levels=study.LEVELS,
        keep_empty=keep_empty,
    )
    names = area_names(model["Departamentos"], model["Provincias"])
    pairs = [c for pair in zip(study.LEVELS, study.POPULATION_COLUMNS) for c in pair]
    return star(names, [bands, levels], AREA).select("Provincia", "Departamento", *pairs)


def levels_report(
    model: Mapping[str, DataFrame],
    last_primary_age: Mapping[int, Sequence[int]] = study.LAST_PRIMARY_AGE,
    *,
    keep_empty: bool = False,
) -> DataFrame:
    """:func:`levels_table` by province, then most primary schools first."""
    return levels_table(model, last_primary_age, keep_empty=keep_empty).orderBy(
        F.asc_nulls_last("Provincia"), F.desc_nulls_last("Primarias")
    )


def threshold_report(
    model: Mapping[str, DataFrame],
    threshold: float = study.CAPACITY_THRESHOLD,
    name: str = "Cantidad_mayor_100",
) -> DataFrame:
    """Cultural centres above a capacity, per department that has any."""
    counts = count_above(
        model["Centros_culturales"], AREA, value="Capacidad", threshold=threshold, name=name
    )
    names = area_names(model["Departamentos"], model["Provincias"])
    return (
        lookup(names, counts, AREA)
        .select("Provincia", "Departamento", name)
        .distinct()
        .orderBy(F.asc_nulls_last("Provincia"), F.desc_nulls_last(name))
    )


def coverage_report(
    model: Mapping[str, DataFrame],
    city: int = study.CITY_PROVINCE,
    city_label=study.CITY_DEPARTMENT,
) -> DataFrame:
    """Establishments, centres and people per department, omitting none.

    Departments of ``city`` are listed one by one and once more as a whole.
    """
    total = {"region": "id_prov", "area": "id_depto", "total_regions": [city]}
    establishments = distinct_with_totals(
        model["Establecimientos_educativos"],
        value="Cueanexo",
        name="Cantidad_ee",
        total_label=city_label,
        **total,
    )
    people = sums_with_totals(
        model["Poblacion"], value="Casos", name="Personas", total_label=city_label, **total
    )
    centres = count_rows(model["Centros_culturales"], AREA, "Cantidad_cc")
    names = area_names(model["Departamentos"], model["Provincias"])
    return (
        left_chain(names, [establishments, centres, people], AREA)
        .select("Provincia", "Departamento", "Cantidad_ee", "Cantidad_cc", "Personas")
        .orderBy(
            F.desc_nulls_last("Cantidad_ee"),
            F.desc_nulls_last("Cantidad_cc"),
            F.asc_nulls_last("Provincia"),
            F.asc_nulls_last("Departamento"),
        )
    )


def dominant_domain_report(
    model: Mapping[str, DataFrame], *, drop_empty: bool = False
) -> DataFrame:
    """Most used mail domain(s) of each department's cultural centres; ties kept."""
    domains = model["Centros_culturales"].select(
        *AREA, email_domain(F.col("Mail"), drop_empty).alias("Dominio")
    )
    top = most_frequent(domains, AREA, "Dominio", name="Dominio_mas_frecuente")
    names = area_names(model["Departamentos"], model["Provincias"])
    return lookup(names, top, AREA).select("Provincia", "Departamento", "Dominio_mas_frecuente")


def centres_by_province(model: Mapping[str, DataFrame]) -> DataFrame:
    """Cultural centres per province name, most first."""
    counts = model["Centros_culturales"].groupBy("id_prov").agg(F.count("id_cc").alias("_n"))
    return (
        lookup(counts, model["Provincias"], "id_prov")
        .groupBy(F.col("nombre").alias("provincia"))
        .agg(F.sum("_n").alias("cantidad_cc"))
        .orderBy(F.desc_nulls_last("cantidad_cc"), "provincia")
    )


def level_points(levels: DataFrame) -> DataFrame:
    """(nivel, poblacion, cantidad) points of the levels report, one per department and level."""
    pairs = dict(zip(study.LEVELS, zip(study.POPULATION_COLUMNS, study.LEVELS)))
    return to_long(levels, pairs, names=("nivel", "poblacion", "cantidad"))


def level_fit(levels: DataFrame) -> DataFrame:
    """Line and R² of establishments against population, per level."""
    return stats.linear_fit(level_points(levels), series="nivel", x="poblacion", y="cantidad")


def level_scatter(levels: DataFrame) -> DataFrame:
    return stats.scatter_points(
        level_points(levels),
        x="poblacion",
        y="cantidad",
        x_view=study.POPULATION_VIEW,
        y_view=study.COUNT_VIEW,
    )


def department_counts(model: Mapping[str, DataFrame]) -> DataFrame:
    """Establishments per (province name, department), departments without any left out."""
    counts = count_rows(model["Establecimientos_educativos"], AREA, "_n")
    return (
        lookup(counts, model["Provincias"], "id_prov")
        .groupBy("nombre", "id_depto")
        .agg(F.sum("_n").alias("Cantidad"))
    )


def department_boxes(model: Mapping[str, DataFrame]) -> DataFrame:
    """Box-plot numbers of establishments per department, by province, in the chart's order."""
    boxes = stats.box_stats(department_counts(model), group="nombre", value="Cantidad")
    # One window over all boxes: a row for each province of the country.
    order = Window.orderBy(F.asc_nulls_last("median"), F.asc_nulls_last("nombre"))
    return boxes.withColumn("plot_order", F.row_number().over(order))


def rates_by_province(model: Mapping[str, DataFrame]) -> DataFrame:
    """Centres and establishments per 1000 inhabitants, and their ratio, highest ratio first."""
    people = model["Poblacion"].groupBy("id_prov").agg(F.sum("Casos").alias("_people"))
    centres = count_rows(model["Centros_culturales"], ["id_prov"], "_cc")
    establishments = count_rows(model["Establecimientos_educativos"], ["id_prov"], "_ee")
    return (
        star(model["Provincias"], [centres, people, establishments], "id_prov")
        .select(
            "id_prov",
            "nombre",
            stats.rate_per_thousand("_cc", "_people").alias("cant_cc_cada_mil"),
            stats.rate_per_thousand("_ee", "_people").alias("cant_ee_cada_mil"),
        )
        .withColumn("cociente_ee_cc", F.try_divide("cant_ee_cada_mil", "cant_cc_cada_mil"))
        .orderBy(F.desc_nulls_last("cociente_ee_cc"), "id_prov")
    )
