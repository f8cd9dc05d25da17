"""Registered queries: every operator over the driver's tables, whole."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import (
    email_domain,
    first_email,
    is_glued_key_reject,
    is_location_reject,
    location_department,
    location_province,
    split_glued_key,
    to_number,
)
from ..operators import (
    aggregates,
    ordering,
    quality,
    rejects,
    reports as report_ops,
    reshape,
    sketches,
    stats,
)
from ..operators.joins import lookup, remap
from ..sources import MODEL_SCHEMAS, literal_table
from . import reports, study
from .standins import CITY, CITY_LABEL, FLAGS, LAST_PRIMARY_AGE, StandIns

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def register(query: Callable[[StandIns], DataFrame]) -> Callable[[StandIns], DataFrame]:
    """Register a query under its function's name (a trailing underscore avoids an import)."""
    name = query.__name__.rstrip("_")
    QUERIES[name] = lambda spark, sf_dir: query(StandIns(spark, sf_dir))
    return query


def _rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


# -- order, identity and fill ---------------------------------------------------------------


@register
def dense_row_id(t: StandIns) -> DataFrame:
    return ordering.dense_row_id(t.table("orders").select("o_orderkey"), "o_orderkey")


@register
def dense_row_id_by_customer(t: StandIns) -> DataFrame:
    """Every customer is a document; their orders are numbered one document after the other."""
    orders = t.table("orders").select("o_custkey", "o_orderkey")
    return ordering.dense_row_id(orders, "o_orderkey", keys=["o_custkey"])


@register
def dense_row_id_by_name(t: StandIns) -> DataFrame:
    """Documents named by a text, as many as there are customers with orders."""
    orders = t.table("orders").select(
        F.format_string("customer %d", "o_custkey").alias("customer"), "o_orderkey"
    )
    return ordering.dense_row_id(orders, "o_orderkey", keys=["customer"])


@register
def dense_row_id_by_two_keys(t: StandIns) -> DataFrame:
    """Documents named by a priority and a customer."""
    orders = t.table("orders").select("o_orderpriority", "o_custkey", "o_orderkey")
    return ordering.dense_row_id(orders, "o_orderkey", keys=["o_orderpriority", "o_custkey"])


@register
def forward_fill(t: StandIns) -> DataFrame:
    marked = t.table("orders").select(
        "o_orderkey",
        F.when(F.col("o_orderstatus") == "F", F.col("o_custkey")).alias("customer"),
        F.when(F.col("o_orderpriority") == "1-URGENT", F.col("o_orderstatus")).alias("status"),
    )
    return ordering.forward_fill(marked, ["customer", "status"], "o_orderkey")


@register
def truncate_at_sentinel(t: StandIns) -> DataFrame:
    orders = t.table("orders").select("o_orderkey", "o_custkey", "o_totalprice")
    dearest = orders.agg(F.max("o_totalprice")).scalar()
    return ordering.truncate_at_sentinel(
        orders, F.col("o_totalprice") == dearest, "o_orderkey"
    ).select("o_orderkey", "o_custkey")


@register
def truncate_by_document(t: StandIns) -> DataFrame:
    """A thousand orders in a row are a document, which ends at its first dear urgent order."""
    orders = t.table("orders").selectExpr(
        "o_orderkey div 1000 AS document", "o_orderkey", "o_orderpriority", "o_totalprice"
    )
    is_end = (F.col("o_orderpriority") == "1-URGENT") & (F.col("o_totalprice") > 490_000)
    return ordering.truncate_at_sentinel(
        orders, is_end, "o_orderkey", keys=["document"]
    ).select("document", "o_orderkey")


@register
def sectioned_report(t: StandIns) -> DataFrame:
    flat = report_ops.sectioned_report(t.raw_report(), seq="seq", label="Edad", value="Casos")
    return report_ops.typed_cells(flat, label="Edad", value="Casos")


# -- filters, keys and contact fields -------------------------------------------------------


@register
def not_in_null_drop(t: StandIns) -> DataFrame:
    labelled = t.table("orders").select(
        "o_orderkey",
        F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority")).alias("label"),
    )
    return report_ops.drop_noise(labelled, "label", ("1-urgent", "5-low"))


@register
def code_decode(t: StandIns) -> DataFrame:
    code, district = F.col("cod_loc"), F.col("district")
    return t.location_codes().select(
        "c_custkey",
        location_province(code).alias("id_prov"),
        location_department(code, district).alias("id_depto"),
        is_location_reject(code).alias("is_reject"),
    )


@register
def composite_key_split(t: StandIns) -> DataFrame:
    key = F.col("glued")
    province, department = split_glued_key(key)
    return t.glued_keys().select(
        "s_suppkey",
        province.alias("id_prov"),
        department.alias("id_depto"),
        is_glued_key_reject(key).alias("is_reject"),
    )


def _decoded(t: StandIns) -> dict[str, DataFrame]:
    """Codes, keys and report lines decoded, each row with its place and its faults."""
    code, key = F.col("cod_loc"), F.col("glued")
    lines = report_ops.sectioned_report(
        t.raw_report(with_words=True), keys=["path"], seq="seq", label="Edad", value="Casos"
    )
    return {
        "codes": t.location_codes().select(
            F.lit("customer").alias("path"),
            F.col("c_custkey").alias("seq"),
            rejects.row_faults(
                rejects.cell_fault("cod_loc", code, is_location_reject(code), "not 7 or 8 digits")
            ).alias(rejects.FAULTS),
        ),
        "keys": t.glued_keys().select(
            F.lit("supplier").alias("path"),
            F.col("s_suppkey").alias("seq"),
            rejects.row_faults(
                rejects.cell_fault("glued", key, is_glued_key_reject(key), "not 4 or 5 digits")
            ).alias(rejects.FAULTS),
        ),
        "lines": report_ops.typed_cells(lines, label="Edad", value="Casos", keep=["path", "seq"]),
    }


@register
def reject_table(t: StandIns) -> DataFrame:
    """Every cell that did not decode, with its place, its text and the reason."""
    decoded = _decoded(t)
    return rejects.reject_table(decoded, {source: ("path", "seq") for source in decoded})


@register
def reject_counts(t: StandIns) -> DataFrame:
    return rejects.reject_counts(_decoded(t))


@register
def key_remap(t: StandIns) -> DataFrame:
    places = t.table("customer").select(
        "c_custkey",
        F.col("c_nationkey").alias("id_prov"),
        (F.col("c_custkey") % 20).cast("int").alias("id_depto"),
    )
    return remap(places, {(4, 8): 7, (4, 15): 14}, region="id_prov", area="id_depto")


@register
def first_email_(t: StandIns) -> DataFrame:
    mail = first_email(F.col("Mail"))
    return t.event_centres().select(
        "id_cc", mail.alias("mail"), email_domain(mail).alias("domain")
    )


# -- reshape and dimensions -----------------------------------------------------------------


def _bridge(t: StandIns) -> DataFrame:
    return reshape.unpivot_flags(
        t.flags(), "Cueanexo", FLAGS, type_col="id_tipo_establecimiento"
    )


@register
def unpivot_flags(t: StandIns) -> DataFrame:
    return _bridge(t)


@register
def dimension_extract(t: StandIns) -> DataFrame:
    return t.departments(with_city=True)


@register
def type_dimension(t: StandIns) -> DataFrame:
    types = literal_table(
        t.spark, study.ESTABLISHMENT_TYPES, MODEL_SCHEMAS["Tipos_de_establecimientos"]
    )
    counts = aggregates.count_rows(_bridge(t), ["id_tipo_establecimiento"], "establishments")
    return lookup(types, counts, "id_tipo_establecimiento")


@register
def province_lookup(t: StandIns) -> DataFrame:
    return lookup(t.establishments(), t.provinces(), "id_prov").select("Cueanexo", "nombre")


@register
def department_lookup(t: StandIns) -> DataFrame:
    return lookup(t.supplier_centres(), t.departments(), reports.AREA).select(
        "id_cc", "id_prov", "nombre"
    )


# -- aggregates -----------------------------------------------------------------------------


def _bands():
    return reports.school_age_bands(aggregates.edge_by_region("id_prov", LAST_PRIMARY_AGE))


def _band_sums(t: StandIns, bands, highest: int) -> DataFrame:
    return aggregates.band_sums(
        t.population(),
        reports.AREA,
        value="Edad",
        amount="Casos",
        bands=bands,
        highest=highest,
    )


@register
def band_sum(t: StandIns) -> DataFrame:
    return _band_sums(t, [_bands()[1]], max(LAST_PRIMARY_AGE))


@register
def bands_wide(t: StandIns) -> DataFrame:
    return _band_sums(t, _bands(), study.LAST_SECONDARY_AGE)


@register
def bands_by_table(t: StandIns) -> DataFrame:
    """The bands where a table says at what age primary school ends in each province."""
    return aggregates.band_sums_by_table(
        t.population(),
        reports.AREA,
        t.primary_ages(),
        region="id_prov",
        edge="last_age",
        value="Edad",
        amount="Casos",
        bands=reports.school_age_bands,
        highest=study.LAST_SECONDARY_AGE,
    )


@register
def provinces_without_edge(t: StandIns) -> DataFrame:
    """Provinces of establishments that the table of school ages leaves out."""
    return aggregates.regions_without_edge(
        t.establishments(), t.primary_ages(), "id_prov", "last_age"
    )


@register
def level_pivot(t: StandIns) -> DataFrame:
    return aggregates.level_pivot(
        t.establishments(),
        _bridge(t),
        key="Cueanexo",
        type_col="id_tipo_establecimiento",
        by=reports.AREA,
        levels=study.LEVELS,
    )


_TOTAL = {
    "region": "id_prov",
    "area": "id_depto",
    "total_regions": [CITY],
    "total_label": CITY_LABEL,
}


@register
def totals_with_override(t: StandIns) -> DataFrame:
    return aggregates.distinct_with_totals(
        t.establishments(), value="Cueanexo", name="Cantidad_ee", **_TOTAL
    )


@register
def estimated_totals(t: StandIns) -> DataFrame:
    """Distinct establishments, and whether their estimate is within four standard errors."""
    establishments = t.establishments()
    names = {"value": "Cueanexo", **_TOTAL}
    exact = aggregates.distinct_with_totals(establishments, name="Cantidad_ee", **names)
    estimate = sketches.estimated_distinct_with_totals(establishments, name="_estimate", **names)
    off = F.abs(F.col("_estimate") - F.col("Cantidad_ee"))
    return exact.join(estimate, reports.AREA).select(
        *reports.AREA,
        "Cantidad_ee",
        (off <= 4 * sketches.distinct_error() * F.col("Cantidad_ee")).alias("is_near"),
    )


@register
def population_totals(t: StandIns) -> DataFrame:
    return aggregates.sums_with_totals(t.people(), value="Casos", name="Personas", **_TOTAL)


# -- reports --------------------------------------------------------------------------------


def _levels_model(t: StandIns) -> dict[str, DataFrame]:
    return {
        "Poblacion": t.population(),
        "Establecimientos_educativos": t.establishments(),
        "ee_tipo_establecimiento": _bridge(t),
        "Departamentos": t.departments(),
        "Provincias": t.provinces(),
    }


def _levels(t: StandIns) -> DataFrame:
    return reports.levels_table(_levels_model(t), LAST_PRIMARY_AGE)


@register
def consulta_levels(t: StandIns) -> DataFrame:
    return reports.levels_report(_levels_model(t), LAST_PRIMARY_AGE)


@register
def threshold_count(t: StandIns) -> DataFrame:
    return reports.threshold_report(_event_model(t), 20, "Cantidad_mayor_20")


@register
def threshold_with_gaps(t: StandIns) -> DataFrame:
    """The same where capacities are missing: NULL for some centres, NaN for others."""
    model = _event_model(t)
    capacity = (
        F.when(F.col("id_cc") % 5 == 0, None)
        .when(F.col("id_cc") % 5 == 1, F.lit(float("nan")))
        .otherwise(F.col("Capacidad"))
    )
    model["Centros_culturales"] = model["Centros_culturales"].withColumn("Capacidad", capacity)
    return reports.threshold_report(model, 20, "Cantidad_mayor_20")


@register
def coverage_report(t: StandIns) -> DataFrame:
    model = {
        "Poblacion": t.people(),
        "Establecimientos_educativos": t.establishments(),
        "Centros_culturales": t.supplier_centres(),
        "Departamentos": t.departments(with_city=True),
        "Provincias": t.provinces(),
    }
    return reports.coverage_report(model, CITY, CITY_LABEL)


def _event_model(t: StandIns) -> dict[str, DataFrame]:
    return {
        "Centros_culturales": t.event_centres(),
        "Departamentos": t.event_departments(),
        "Provincias": t.provinces(),
    }


@register
def dominant_domain(t: StandIns) -> DataFrame:
    model = _event_model(t)
    mail = first_email(F.col("Mail"))
    model["Centros_culturales"] = model["Centros_culturales"].withColumn("Mail", mail)
    return reports.dominant_domain_report(model)


# -- chart tables ---------------------------------------------------------------------------


@register
def count_by_province(t: StandIns) -> DataFrame:
    return reports.centres_by_province(
        {"Centros_culturales": t.event_centres(), "Provincias": t.provinces()}
    )


def _department_model(t: StandIns) -> dict[str, DataFrame]:
    return {"Establecimientos_educativos": t.establishments(), "Provincias": t.provinces()}


def _department_counts(t: StandIns) -> DataFrame:
    return reports.department_counts(_department_model(t))


@register
def group_median(t: StandIns) -> DataFrame:
    return stats.group_quantiles(
        _department_counts(t), group="nombre", value="Cantidad", quantiles={"median": 0.5}
    )


@register
def price_median(t: StandIns) -> DataFrame:
    """Median line price by nation: continuous values, nearly all of them different."""
    quantiles = stats.group_quantiles(
        t.line_prices(), group="id_prov", value="price", quantiles={"q1": 0.25, "median": 0.5}
    )
    return _rounded(quantiles, 4, "q1", "median")


@register
def estimated_quartiles(t: StandIns) -> DataFrame:
    """Lines of each nation, and whether estimates of their price quartiles have nearly that rank.

    The nations' sketches are merged from those of their market segments. A quartile's rank may be off
    by twice the sketch's error.
    """
    shares = {"q1": 0.25, "median": 0.5, "q3": 0.75}
    prices = t.line_prices()
    by_area = sketches.quantile_sketches(prices, reports.AREA, "price")
    by_nation = sketches.merge_quantile_sketches(by_area, ["id_prov"])
    found = sketches.estimated_quantiles(by_nation, shares)
    ranked = (
        prices.join(found, "id_prov")
        .groupBy("id_prov", "points")
        .agg(
            *[F.count_if(F.col("price") < F.col(q)).alias(f"_below_{q}") for q in shares],
            *[F.count_if(F.col("price") <= F.col(q)).alias(f"_upto_{q}") for q in shares],
        )
    )
    slack = 2 * sketches.rank_error() * F.col("points") + 1
    return ranked.select(
        "id_prov",
        "points",
        *[
            (
                (F.col(f"_below_{q}") <= share * F.col("points") + slack)
                & (F.col(f"_upto_{q}") >= share * F.col("points") - slack)
            ).alias(f"{q}_is_near")
            for q, share in shares.items()
        ],
    )


@register
def box_stats(t: StandIns) -> DataFrame:
    return reports.department_boxes(_department_model(t))


@register
def box_outliers(t: StandIns) -> DataFrame:
    return stats.box_outliers(
        _department_counts(t), group="nombre", value="Cantidad", keep=["id_depto"]
    )


@register
def linear_fit(t: StandIns) -> DataFrame:
    return _rounded(reports.level_fit(_levels(t)), 6, "slope", "intercept", "r2")


@register
def fit_line_points(t: StandIns) -> DataFrame:
    fit = reports.level_fit(_levels(t))
    return _rounded(stats.fit_line_points(fit, series="nivel"), 4, "x", "y")


@register
def scatter_points(t: StandIns) -> DataFrame:
    return reports.level_scatter(_levels(t))


@register
def rate_per_thousand(t: StandIns) -> DataFrame:
    model = {
        "Poblacion": t.people(),
        "Establecimientos_educativos": t.establishments(),
        "Centros_culturales": t.supplier_centres(),
        "Provincias": t.provinces(),
    }
    return _rounded(
        reports.rates_by_province(model),
        6,
        "cant_cc_cada_mil",
        "cant_ee_cada_mil",
        "cociente_ee_cc",
    )


# -- data quality ---------------------------------------------------------------------------


@register
def numeric_quality(t: StandIns) -> DataFrame:
    return _rounded(quality.numeric_quality(t.raw_report(), "Edad"), 6, "pct_non_numeric")


@register
def numeric_coercion(t: StandIns) -> DataFrame:
    shapes = ["AREA # 1", "nan", None, "1d", "1e3", " 5 ", ""]
    kind = F.col("event_id") % (len(shapes) + 1)
    cell = F.col("value").cast("string")
    for i, shape in enumerate(shapes):
        cell = F.when(kind == i, F.lit(shape)).otherwise(cell)
    return t.table("events").select("event_id", to_number(cell).alias("number"))


@register
def contact_quality(t: StandIns) -> DataFrame:
    return _rounded(
        quality.contact_quality(t.event_centres(), "Mail"), 6, "pct_multiple", "pct_invalid"
    )


@register
def flag_quality(t: StandIns) -> DataFrame:
    return _rounded(quality.flag_quality(t.flags(), list(FLAGS)), 6, "pct_unset")
