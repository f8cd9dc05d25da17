"""Header CSV with the null tokens and row order of the raw lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions.numbers import to_number, to_whole

# The cell texts that mean "missing" when such a file is read as a table.
NULL_TOKENS = (
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
)


def _converted(text: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.IntegralType):
        return to_whole(text, kind.simpleString())
    if isinstance(kind, T.FractionalType):
        return to_number(text).try_cast(kind)
    return text.try_cast(kind)


def read_delimited(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    *,
    null_tokens: Sequence[str] = NULL_TOKENS,
    seq: str | None = None,
    reject: str | None = None,
    faults: str | None = None,
    multi_line: bool = False,
) -> DataFrame:
    """Read the columns named in ``schema`` (verbatim, spaces included) with its types.

    Set ``multi_line`` when quoted cells contain line breaks; such a file cannot be split.

    All files must have the same header: Spark compares each file's own when it is read and fails
    naming the file, so swapped columns are never read by position.

    Cells are read as text, missing-value tokens become NULL, and the rest is converted: what is not
    a number (``nan`` and ``1d`` are none) becomes NULL, whole numbers may be written ``12.0``. With
    ``reject``, a boolean column tells the rows with a cell that did not convert; with ``faults``, an
    array column lists those cells with their text, for :mod:`terrastat.operators.rejects`. With
    ``seq``, two columns are added: ``path`` and a bigint that is unique and ascending in file order
    within it, as the ordering operators need. That is the byte offset of
    the row's file split plus the row's number in its task: a task reads at most one split's
    length of bytes and a row has at least one, so offsets of successive splits never overlap.
    Splits depend on the cluster's size at the moment of the scan: write the result out
    (:func:`terrastat.sources.stage`) before an operator reads it more than once.
    """
    raw = spark.read.csv(
        path, header=True, enforceSchema=False, escape='"', multiLine=multi_line
    )
    columns = {f.name: F.col(f"`{f.name}`") for f in schema}
    if seq is not None:
        row_in_task = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
        raw = raw.select(
            F.col("_metadata.file_path").alias("path"),
            (F.col("_metadata.file_block_start") + row_in_task).alias(seq),
            *columns.values(),
        )
    texts = {name: F.when(~c.isin(*null_tokens), c) for name, c in columns.items()}
    typed = {name: _converted(text, schema[name].dataType) for name, text in texts.items()}
    lost = {name: text.isNotNull() & typed[name].isNull() for name, text in texts.items()}
    if reject is not None:
        typed[reject] = F.greatest(F.lit(False), F.lit(False), *lost.values())
    if faults is not None:
        cells = [
            F.when(bad, F.struct(F.lit(name).alias("column"), texts[name].alias("raw"), F.lit("does not convert").alias("reason")))
            for name, bad in lost.items()
        ]
        typed[faults] = F.array_compact(F.array(*cells))
    return raw.select(
        *(["path", seq] if seq is not None else []), *[c.alias(name) for name, c in typed.items()]
    )
