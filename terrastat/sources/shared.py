"""Tables between steps, in the folder that all executors share."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``.

    Only a session whose tasks run in this very process may go without; it gets a temporary folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    master = spark.sparkContext.master
    if not re.match(r"local(\[|$)", master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if master not in _own_folders:
        _own_folders[master] = tempfile.mkdtemp(prefix="terrastat-")
        atexit.register(shutil.rmtree, _own_folders[master], ignore_errors=True)
    return _own_folders[master]


def stage(df: DataFrame, location: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet and read it back.

    For results that are costly to compute or whose row positions depend on how files were split,
    and that are read several times. The files replace the lineage, so a lost executor costs a
    re-read, and later scans are pruned to the columns they use. The default location is a new
    folder below :func:`shared_folder`. Staged files are not deleted; they can go once the job that
    reads them is done.
    """
    spark = df.sparkSession
    if location is None:
        location = f"{shared_folder(spark)}/stage-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(location)
    return spark.read.schema(df.schema).parquet(location)
