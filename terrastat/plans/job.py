"""The whole study as one batch job.

    spark-submit terrastat_job.py --register DIR --centres DIR --population DIR --out DIR [--buckets N]
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import quality, stats
from ..operators.reshape import is_set
from ..sources import load_model, save_model, stage
from . import model as raw_model, reports, study


def report_tables(
    model: dict[str, DataFrame], levels: DataFrame | None = None
) -> dict[str, DataFrame]:
    """Every report and chart table over the model except the levels report, by name; lazy.

    ``levels`` is the levels report where it is already stored.
    """
    if levels is None:
        levels = reports.levels_table(model)
    fit = reports.level_fit(levels)
    counts = reports.department_counts(model)
    return {
        "provincias_sin_grupo": reports.provinces_without_edge(model["Provincias"]),
        "consulta_2": reports.threshold_report(model),
        "consulta_3": reports.coverage_report(model),
        "consulta_4": reports.dominant_domain_report(model),
        "grafico_1": reports.centres_by_province(model),
        "grafico_2_puntos": reports.level_scatter(levels),
        "grafico_2_ajuste": fit,
        "grafico_2_recta": stats.fit_line_points(fit, series="nivel"),
        "grafico_3": reports.department_boxes(model),
        "grafico_3_atipicos": stats.box_outliers(
            counts, group="nombre", value="Cantidad", keep=["id_depto"]
        ),
        "grafico_4": reports.rates_by_province(model),
    }


def quality_tables(
    centres: DataFrame, population: DataFrame, decoded: dict[str, DataFrame]
) -> dict[str, DataFrame]:
    """Quality metrics of the raw and the decoded sources, by name; lazy."""
    return {
        "calidad_poblacion": quality.numeric_quality(population, "Edad"),
        "calidad_centros": quality.contact_quality(centres, "Mail "),
        "calidad_establecimientos": quality.flag_quality(
            decoded["register"].where(is_set("comun")), list(study.FLAG_COLUMNS)
        ),
        "rechazos": raw_model.rejects(decoded),
        "rechazos_celdas": raw_model.rejected_cells(decoded),
    }


def run_study(
    spark: SparkSession,
    *,
    register: str,
    centres: str,
    population: str,
    out: str,
    buckets: int | None = None,
) -> dict[str, DataFrame]:
    """Raw files to ``out/model`` and ``out/reports``; returns the written reports.

    A stored report has its order in ``posicion``, which ascends but has gaps.

    The sources are decoded once, into staged rows that hold their faults; the model, the reject
    table and the counts are selections of these. The reports read the written model: no report
    recomputes the cleaning, and a lost executor costs a re-read. With ``buckets`` the establishments
    and their types are stored by establishment, so that whoever loads the model joins them without
    a shuffle.
    """
    raw_centres = stage(raw_model.read_centres(spark, centres))
    raw_population = stage(raw_model.read_population(spark, population))
    sources = raw_model.decode(raw_model.read_register(spark, register), raw_centres, raw_population)
    decoded = {name: stage(rows) for name, rows in sources.items()}
    save_model(
        raw_model.model_tables(decoded),
        f"{out}/model",
        **({"bucket_by": study.BUCKETED_BY, "buckets": buckets} if buckets else {}),
    )
    model = load_model(spark, f"{out}/model")
    written = {}

    def write(tables: dict[str, DataFrame]) -> None:
        for name, table in tables.items():
            location = f"{out}/reports/{name}"
            # Rows of a sorted table keep their places: ids ascend with the partitions.
            table = table.withColumn("posicion", F.monotonically_increasing_id())
            table.write.mode("overwrite").parquet(location)
            written[name] = spark.read.parquet(location)

    write({"consulta_1": reports.levels_report(model)})
    write(report_tables(model, levels=written["consulta_1"]))
    write(quality_tables(raw_centres, raw_population, decoded))
    return written
