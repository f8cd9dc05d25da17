"""The seven tables of the model, and their storage.

A save is one commit of all tables. They go to a folder of their own, ``versions/<name>``, and only
when the last of them is written is that folder named in a new row of the ``commits`` table, which
is one small file that appears whole. A job that dies midway leaves an unnamed folder, and readers
go on with the version before; a reader that has resolved its version keeps reading it whole while a
later one is committed. Nothing but Spark's own readers and writers is used, so a model can be in
any store that these reach. One job at a time may save to a directory.

Folders of earlier versions stay until someone removes them: a reader may still be on them.

Tables that are joined on one key can be stored in buckets of that key, the same number for each. The
commit says so, and a reader gets them as bucketed tables of the session's catalog, where they are
named after their version: a join or an aggregate on the key then reads bucket by bucket and shuffles
nothing.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession, functions as F, types as T

from .delimited import read_delimited

def _schema(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


_INT, _LONG, _DOUBLE, _TEXT = T.IntegerType(), T.LongType(), T.DoubleType(), T.StringType()

MODEL_SCHEMAS: dict[str, T.StructType] = {
    "Centros_culturales": _schema(
        id_cc=_LONG, id_prov=_INT, id_depto=_INT, Capacidad=_DOUBLE, Mail=_TEXT
    ),
    "Departamentos": _schema(id_prov=_INT, id_depto=_INT, nombre=_TEXT),
    "Establecimientos_educativos": _schema(
        Cueanexo=_LONG, id_prov=_INT, id_depto=_INT, ambito=_TEXT, sector=_TEXT
    ),
    "Poblacion": _schema(id_prov=_INT, id_depto=_INT, Edad=_INT, Casos=_INT),
    "Provincias": _schema(id_prov=_INT, nombre=_TEXT),
    "Tipos_de_establecimientos": _schema(
        id_tipo_establecimiento=_INT, tipo_establecimiento=_TEXT
    ),
    "ee_tipo_establecimiento": _schema(Cueanexo=_LONG, id_tipo_establecimiento=_INT),
}


_COMMITS = _schema(
    version=_LONG,
    folder=_TEXT,
    format=_TEXT,
    committed_at=T.TimestampType(),
    buckets=_INT,
    bucketed_by=T.MapType(_TEXT, _TEXT),
)


def _location(directory: str, name: str) -> str:
    return f"{directory.rstrip('/')}/{name}"


def _bucketed_name(folder: str, name: str) -> str:
    return f"model_{folder.rpartition('-')[2]}_{name.lower()}"


def _write_bucketed(table: DataFrame, name: str, location: str, key: str, buckets: int) -> None:
    """One sorted file a bucket: the rows are dealt by the hash that buckets are made with."""
    (
        table.repartition(buckets, key)
        .write.format("parquet")
        .bucketBy(buckets, key)
        .sortBy(key)
        .option("path", location)
        .saveAsTable(name)
    )


def _open_bucketed(
    spark: SparkSession, name: str, schema: T.StructType, location: str, key: str, buckets: int
) -> DataFrame:
    """The stored table, entered in the catalog where another session has written it."""
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    quoted = location.replace("\\", "\\\\").replace("'", "\\'")
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet "
        f"CLUSTERED BY (`{key}`) SORTED BY (`{key}`) INTO {buckets} BUCKETS LOCATION '{quoted}'"
    )
    return spark.table(name)


def save_model(
    tables: Mapping[str, DataFrame],
    directory: str,
    *,
    fmt: str = "parquet",
    partition_by: Mapping[str, Sequence[str]] | None = None,
    bucket_by: Mapping[str, str] | None = None,
    buckets: int = 200,
) -> None:
    """Write all tables of ``tables`` and commit them together as the model's next version.

    Parquet by default; ``fmt='csv'`` writes header CSV. A table is a directory of part files.
    ``bucket_by`` names tables and the key that each is stored by, in ``buckets`` buckets: choose
    the number so that a bucket of the largest fits a task's memory (a few hundred MB).
    """
    bucket_by = dict(bucket_by or {})
    if fmt not in ("parquet", "csv"):
        raise ValueError(f"unknown format {fmt!r}")
    if (partition_by or bucket_by) and fmt != "parquet":
        raise ValueError("only parquet tables can be partitioned or bucketed")
    if both := bucket_by.keys() & (partition_by or {}).keys():
        raise ValueError(f"partitioned and bucketed: {', '.join(sorted(both))}")
    if unknown := bucket_by.keys() - tables.keys():
        raise ValueError(f"no such table to bucket: {', '.join(sorted(unknown))}")
    if bucket_by and not re.match(r"/|[a-zA-Z][\w+.-]*:", directory):
        raise ValueError("bucketed tables need an absolute directory")
    if not tables:
        raise ValueError("a model without tables")
    spark = next(iter(tables.values())).sparkSession
    last = latest_version(spark, directory)
    version = 1 if last is None else last.version + 1
    folder = f"versions/{version:08d}-{uuid.uuid4().hex}"
    for name, table in tables.items():
        table = table.select(
            *[table[f"`{f.name}`"].cast(f.dataType) for f in MODEL_SCHEMAS[name]]
        )
        location = _location(directory, f"{folder}/{name}")
        if name in bucket_by:
            _write_bucketed(table, _bucketed_name(folder, name), location, bucket_by[name], buckets)
            continue
        writer = table.write.mode("overwrite").format(fmt)
        if fmt == "csv":
            # Keep cells as they are: doubled quotes, outer spaces not trimmed.
            writer = writer.options(
                header=True,
                escape='"',
                ignoreLeadingWhiteSpace=False,
                ignoreTrailingWhiteSpace=False,
            )
        if partition_by and name in partition_by:
            writer = writer.partitionBy(*partition_by[name])
        writer.save(location)
    commit = spark.range(1).select(
        F.lit(version).cast("bigint").alias("version"),
        F.lit(folder).alias("folder"),
        F.lit(fmt).alias("format"),
        F.current_timestamp().alias("committed_at"),
        F.lit(buckets if bucket_by else None).cast("int").alias("buckets"),
        F.create_map(*[F.lit(x) for pair in bucket_by.items() for x in pair])
        .cast("map<string,string>")
        .alias("bucketed_by"),
    )
    commit.coalesce(1).write.mode("append").parquet(_location(directory, "commits"))


def versions(spark: SparkSession, directory: str) -> DataFrame:
    """The committed versions of a model: version, folder, format, committed_at, buckets, bucketed_by."""
    try:
        return spark.read.schema(_COMMITS).parquet(_location(directory, "commits"))
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _COMMITS)


def latest_version(spark: SparkSession, directory: str, version: int | None = None) -> Row | None:
    """The commit of the newest version, or of ``version``; None where there is none.

    All readers choose alike if two jobs have committed the same number against the rule.
    """
    commits = versions(spark, directory)
    if version is not None:
        commits = commits.where(F.col("version") == version)
    return commits.orderBy(F.desc("version"), F.desc("folder")).first()


def load_model(
    spark: SparkSession, directory: str, *, views: bool = False, version: int | None = None
) -> dict[str, DataFrame]:
    """The saved tables by name; with ``views`` also registered as temporary views.

    All are of one version, the newest or the one asked for, found once. The format is the one that
    it was saved in.
    """
    commit = latest_version(spark, directory, version)
    if commit is None:
        raise FileNotFoundError(f"no committed model{'' if version is None else f' {version}'} in {directory}")
    tables = {}
    for name, schema in MODEL_SCHEMAS.items():
        location = _location(directory, f"{commit.folder}/{name}")
        if key := (commit.bucketed_by or {}).get(name):
            stored = _bucketed_name(commit.folder, name)
            table = _open_bucketed(spark, stored, schema, location, key, commit.buckets)
        elif commit.format == "csv":
            table = read_delimited(spark, location, schema)
        else:
            table = spark.read.schema(schema).parquet(location).select(*schema.names)
        if views:
            table.createOrReplaceTempView(name)
        tables[name] = table
    return tables
