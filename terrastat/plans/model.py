"""Raw sources to the seven-table model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..functions import (
    first_email,
    is_glued_key_reject,
    is_location_reject,
    location_department,
    location_province,
    split_glued_key,
    to_whole,
)
from ..operators.joins import remap
from ..operators.ordering import dense_row_id
from ..operators.rejects import (
    FAULTS,
    cell_fault,
    has_fault,
    is_faulty,
    reject_counts,
    reject_table,
    row_faults,
)
from ..operators.reports import sectioned_report, typed_cells
from ..operators.reshape import extract_dimension, is_set, unpivot_flags
from ..sources import literal_table, read_delimited, read_workbooks, sheet_columns
from ..sources.model_store import MODEL_SCHEMAS
from . import study

_REGISTER_COLUMNS = {
    "Cueanexo": "Cueanexo",
    "Jurisdicción": "jurisdiccion",
    "Departamento": "departamento",
    "Código de localidad": "cod_loc",
    "Ámbito": "ambito",
    "Sector": "sector",
    "Común": "comun",
    **{flag: flag for flag in study.FLAG_COLUMNS},
}

_CENTRES_SCHEMA = T.StructType(
    [
        T.StructField("ID_PROV", T.IntegerType()),
        T.StructField("ID_DEPTO", T.LongType()),
        T.StructField("Departamento", T.StringType()),
        T.StructField("Mail ", T.StringType()),
        T.StructField("Capacidad", T.DoubleType()),
    ]
)


def read_register(spark: SparkSession, path: str) -> DataFrame:
    """Establishment register workbooks: all cells as text, renamed to plain names, by (path, row_no)."""
    sheet = read_workbooks(
        spark, path, skip_rows=study.REGISTER_PREAMBLE_ROWS, required=list(_REGISTER_COLUMNS)
    )
    return sheet_columns(sheet, _REGISTER_COLUMNS)


def read_centres(spark: SparkSession, path: str) -> DataFrame:
    """Cultural-centre lists with their row order in (path, seq); ``faults`` lists unread cells."""
    return read_delimited(spark, path, _CENTRES_SCHEMA, seq="seq", faults=FAULTS)


def read_population(spark: SparkSession, path: str) -> DataFrame:
    """Population workbooks as (path, row_no, Edad, Casos), header rows included."""
    sheet = read_workbooks(
        spark, path, skip_rows=study.POPULATION_PREAMBLE_ROWS, header=False
    )
    return sheet_columns(sheet, {"B": "Edad", "C": "Casos"})


#: Where a decoded row of each source stood: its path and position columns.
PLACES = {"register": ("path", "row_no"), "centres": ("path", "seq"), "population": ("path", "row_no")}


def decode_register(register: DataFrame) -> DataFrame:
    """Every row of the register, with the faults of its number and location."""
    district = F.upper("departamento")
    code, number = F.col("cod_loc"), to_whole(F.col("Cueanexo"), "bigint")
    found = row_faults(
        cell_fault("Cueanexo", F.col("Cueanexo"), number.isNull(), "not a whole number"),
        cell_fault("Código de localidad", code, is_location_reject(code), "not 7 or 8 digits"),
    )
    return register.select(
        *PLACES["register"],
        "comun",
        number.alias("Cueanexo"),
        F.upper("jurisdiccion").alias("nombre"),
        district.alias("nombre_departamento"),
        "ambito",
        "sector",
        *[F.col(f"`{flag}`") for flag in study.FLAG_COLUMNS],
        location_province(code).alias("id_prov"),
        location_department(code, district).alias("id_depto"),
        found.alias(FAULTS),
    )


def _common(decoded: DataFrame) -> DataFrame:
    return decoded.where(is_set("comun")).drop("comun")


def establishment_info(register: DataFrame) -> DataFrame:
    """Common-modality establishments with decoded location; flags stay as they are."""
    return _common(decode_register(register))


def decode_centres(centres: DataFrame) -> DataFrame:
    """Every centre with its key split and its faults: unread cells, a province or key that is missing
    or malformed."""
    key = F.col("ID_DEPTO").cast("string")
    _, department = split_glued_key(key)
    unread = lambda column: F.coalesce(has_fault(column), F.lit(False))
    nothing = F.lit(False)
    found = row_faults(
        F.when(~unread("ID_PROV"), cell_fault("ID_PROV", F.col("ID_PROV"), nothing, "")),
        F.when(~unread("ID_DEPTO"), cell_fault("ID_DEPTO", key, is_glued_key_reject(key), "not 4 or 5 digits")),
    )
    return centres.select(
        *PLACES["centres"],
        F.col("ID_PROV").alias("id_prov"),
        department.alias("id_depto"),
        F.substring(key, 2, 4).try_cast("int").alias("city_depto"),
        "Departamento",
        F.col("`Mail `").alias("Mail"),
        "Capacidad",
        F.concat(F.col(FAULTS), found).alias(FAULTS),
    )


def _numbered_centres(decoded: DataFrame) -> DataFrame:
    numbered = dense_row_id(decoded, "seq", keys=["path"], id_col="id_cc")
    return numbered.select("id_cc", "id_prov", "id_depto", "Mail", "Capacidad")


def centres_info(centres: DataFrame) -> DataFrame:
    """Centres numbered in file order, key split, mail as typed."""
    return _numbered_centres(decode_centres(centres))


def decode_population(population: DataFrame) -> DataFrame:
    """Every detail line of the population with its faults; departments renumbered.

    Headings, totals and blank lines hold no data and are left behind.
    """
    flat = sectioned_report(
        population, keys=["path"], seq="row_no", label="Edad", value="Casos"
    )
    typed = typed_cells(flat, label="Edad", value="Casos", keep=PLACES["population"])
    return remap(typed.drop("is_reject"), study.MOVED_DEPARTMENTS, region="id_prov", area="id_depto")


def decode(register: DataFrame, centres: DataFrame, population: DataFrame) -> dict[str, DataFrame]:
    """The raw sources decoded, by name; lazy. Stage them: every table is made from these rows."""
    return {
        "register": decode_register(register),
        "centres": decode_centres(centres),
        "population": decode_population(population),
    }


def model_tables(decoded: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The seven model tables from the decoded sources; lazy.

    Population lines with a fault are left out; establishments and centres with one are kept, with
    what could be decoded. The faults of all of them are in :func:`rejected_cells`.
    """
    info = _common(decoded["register"])
    centres, population = decoded["centres"], decoded["population"]
    city = centres.where(F.col("id_prov") == study.CITY_PROVINCE).select("id_prov", "city_depto", "Departamento")
    spark = info.sparkSession
    return {
        "Poblacion": population.where(~is_faulty()).select("id_prov", "id_depto", "Edad", "Casos"),
        "Centros_culturales": _numbered_centres(centres).withColumn("Mail", first_email(F.col("Mail"))),
        "Establecimientos_educativos": info.select(
            "Cueanexo", "id_prov", "id_depto", "ambito", "sector"
        ),
        "Tipos_de_establecimientos": literal_table(
            spark, study.ESTABLISHMENT_TYPES, MODEL_SCHEMAS["Tipos_de_establecimientos"]
        ),
        "Departamentos": extract_dimension(
            info.select("id_prov", "id_depto", F.col("nombre_departamento").alias("nombre")),
            ["id_prov", "id_depto", "nombre"],
            extra=city,
        ),
        "Provincias": extract_dimension(info, ["id_prov", "nombre"]),
        "ee_tipo_establecimiento": unpivot_flags(
            info, "Cueanexo", study.FLAG_COLUMNS, type_col="id_tipo_establecimiento"
        ),
    }


def build_model(
    register: DataFrame, centres: DataFrame, population: DataFrame
) -> dict[str, DataFrame]:
    """The seven model tables from the raw sources, lazy; each source is decoded once a table."""
    return model_tables(decode(register, centres, population))


def rejected_cells(decoded: dict[str, DataFrame]) -> DataFrame:
    """(source, path, position, column, raw, reason) of every cell that did not decode."""
    return reject_table(decoded, PLACES)


def rejects(decoded: dict[str, DataFrame]) -> DataFrame:
    """How many rows and cells did not decode, by source, before any row is left out.

    Of the population these are its detail lines: headings, totals and blank lines hold no data.
    """
    return reject_counts(decoded)
