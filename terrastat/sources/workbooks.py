"""Ingest of many spreadsheet workbooks, one task step per file.

Spark has no xlsx source. A workbook is a zip of XML whose rows are streamed out in Arrow batches. A
sheet has at most 1,048,576 rows, so a single file bounds what one task step handles and the
parallelism is across files. Only cell texts are read: no styles, dates or formulas.

There are two ways to the files. By default ``binaryFile`` lists and distributes them, from any store
that Spark reaches; each file is a cell of 2 GB at most, and a task's files together are at most
``spark.sql.files.maxPartitionBytes`` or a single larger one. :class:`WorkbookSource` is a data
source (``spark.read.format("workbook")``) whose tasks open the files themselves, where they lie, and
read no more than the sheet and the cells that are asked for; that takes a store that Arrow can open.
"""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections.abc import Iterator, Sequence
from typing import BinaryIO
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema

from .delimited import NULL_TOKENS

_BATCH_ROWS = 10_000
_SCHEMA = "path string, row_no bigint, cells map<string,string>"
_FIXED = ("path", "row_no")

#: A task of the data source opens files of about this many bytes; opening one counts as some.
TASK_BYTES = 128 << 20
_OPEN_BYTES = 4 << 20


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _texts(node) -> str:
    """Text of a string item; phonetic hints are not part of it."""
    runs = [c for c in node if _local(c.tag) == "r"] or [node]
    return "".join(t.text or "" for run in runs for t in run if _local(t.tag) == "t")


def _shared_strings(book: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    strings = []
    with book.open("xl/sharedStrings.xml") as stream:
        for _, node in ElementTree.iterparse(stream):
            if _local(node.tag) == "si":
                strings.append(_texts(node))
                node.clear()
    return strings


def _first_sheet(book: zipfile.ZipFile) -> str:
    """Part name of the first sheet in workbook order."""
    sheets = ElementTree.fromstring(book.read("xl/workbook.xml")).iter()
    first = next(n for n in sheets if _local(n.tag) == "sheet")
    rel_id = next(v for k, v in first.attrib.items() if _local(k) == "id")
    rels = ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))
    target = next(r.get("Target") for r in rels if r.get("Id") == rel_id)
    return target.lstrip("/") if target.startswith("/") else f"xl/{target}"


def _cell_text(cell, strings: Sequence[str]) -> str | None:
    kind = cell.get("t")
    if kind == "inlineStr":
        return next((_texts(c) for c in cell if _local(c.tag) == "is"), None)
    value = next((c.text for c in cell if _local(c.tag) == "v"), None)
    return strings[int(value)] if kind == "s" and value is not None else value


def _sheet_rows(workbook: BinaryIO) -> Iterator[tuple[int, dict[str, str]]]:
    """(row number, {column letter: text}) up to the last row with a cell; blank rows are {}."""
    with zipfile.ZipFile(workbook) as book:
        strings = _shared_strings(book)
        with book.open(_first_sheet(book)) as stream:
            number = last = 0
            for _, node in ElementTree.iterparse(stream):
                if _local(node.tag) != "row":
                    continue
                number = int(node.get("r", number + 1))
                cells = {}
                for position, cell in enumerate(node):
                    ref = cell.get("r")
                    letter = re.match("[A-Z]+", ref)[0] if ref else _letter(position)
                    text = _cell_text(cell, strings)
                    if text:
                        cells[letter] = text
                if cells:
                    for blank in range(last + 1, number):
                        yield blank, {}
                    yield number, cells
                    last = number
                node.clear()


def _letter(position: int) -> str:
    name = ""
    position += 1
    while position:
        position, digit = divmod(position - 1, 26)
        name = chr(65 + digit) + name
    return name


def _header_names(cells: dict[str, str]) -> dict[str, str]:
    """{letter: header text}; a repeated text gets .1, .2, …"""
    names, seen = {}, {}
    for letter, text in cells.items():
        count = seen.get(text, 0)
        seen[text] = count + 1
        names[letter] = f"{text}.{count}" if count else text
    return names


def _named_rows(
    workbook: BinaryIO, file: str, skip_rows: int, header: bool, required: Sequence[str]
) -> Iterator[tuple[int, dict[str, str]]]:
    """The rows below the preamble and the header, cells by the header's names if there is one."""
    names = None
    for number, cells in _sheet_rows(workbook):
        if number <= skip_rows:
            continue
        if header and names is None:
            names = _header_names(cells)
            if missing := [n for n in required if n not in names.values()]:
                raise ValueError(f"{file} has no column {', '.join(missing)}")
            continue
        yield number, {names[k]: v for k, v in cells.items() if k in names} if header else cells
    if header and required and names is None:
        raise ValueError(f"{file} has no header row")


class _Files(InputPartition):
    """The files of one task, as URIs."""

    def __init__(self, files: list[str]):
        super().__init__(files)


def _store(uri: str) -> tuple[fs.FileSystem, str]:
    """The store of a URI or a plain path, and the path in it."""
    if uri.startswith("file:") or "://" not in uri:
        return fs.LocalFileSystem(), re.sub("^file:(//(?=/))?", "", uri)
    return fs.FileSystem.from_uri(re.sub("^s3[an]://", "s3://", uri))


class _WorkbookReader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict[str, str]):
        self.schema = schema
        self.path = options.get("path") or ""
        self.skip_rows = int(options.get("skipRows", "0"))
        self.header = options.get("header", "true").lower() == "true"
        self.required = json.loads(options.get("required", "[]"))
        self.task_bytes = int(options.get("taskBytes", str(TASK_BYTES)))
        if not self.path or re.search(r"[*?\[{]", self.path):
            raise ValueError("the path of workbooks is a file or a folder, not a pattern")

    def partitions(self) -> list[_Files]:
        """Files in the order of their names, in tasks of about ``taskBytes``."""
        store, path = _store(self.path)
        info = store.get_file_info(path)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        found = [info]
        if info.type == fs.FileType.Directory:
            found = store.get_file_info(fs.FileSelector(path, recursive=True))
        local = isinstance(store, fs.LocalFileSystem)
        before = "file:" if local else self.path.partition("://")[0] + "://"
        if not local and path.startswith("/"):
            before += self.path.partition("://")[2].partition("/")[0]
        tasks: list[list[str]] = []
        room = 0
        for file in sorted(found, key=lambda f: f.path):
            if file.type != fs.FileType.File or not re.match(r"[^._].*\.xlsx$", file.base_name, re.IGNORECASE):
                continue
            cost = (file.size or 0) + _OPEN_BYTES
            if cost > room:
                tasks.append([])
                room = max(self.task_bytes, cost)
            tasks[-1].append(before + file.path)
            room -= cost
        return [_Files(files) for files in tasks]

    def read(self, partition: _Files) -> Iterator[pa.RecordBatch]:
        schema = to_arrow_schema(self.schema)
        asked = [name for name in schema.names if name not in _FIXED]
        whole = asked == ["cells"]

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            columns = dict(zip([*_FIXED, *asked], zip(*rows)))
            return pa.RecordBatch.from_arrays(
                [pa.array(columns[field.name], field.type) for field in schema], schema=schema
            )

        for file in partition.value if partition else []:
            store, path = _store(file)
            rows = []
            with store.open_input_file(path) as workbook:
                for number, cells in _named_rows(workbook, file, self.skip_rows, self.header, self.required):
                    texts = [list(cells.items())] if whole else [cells.get(name) for name in asked]
                    rows.append((file, number, *texts))
                    if len(rows) == _BATCH_ROWS:
                        yield batch(rows)
                        rows = []
            if rows:
                yield batch(rows)


class WorkbookSource(DataSource):
    """``spark.dataSource.register(WorkbookSource)``, then ``spark.read.format("workbook").load(path)``.

    Rows of the first sheet of every workbook of a file or folder: path, row_no, and either ``cells``
    (a map) or, with a schema of your own, a text column for each cell that it names, by the header's
    name or the column's letter; other cells are not kept. Options: ``skipRows``, ``header`` and
    ``required`` (a JSON list) as in :func:`read_workbooks`, ``taskBytes`` for a task's files.
    """

    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> str:
        return _SCHEMA

    def reader(self, schema: T.StructType) -> DataSourceReader:
        for field in schema:
            expected = T.StringType()
            if field.name == "row_no":
                expected = T.LongType()
            elif schema.names[-1] == field.name == "cells" and len(schema) == 3:
                expected = T.MapType(T.StringType(), T.StringType())
            if field.dataType != expected:
                raise TypeError(f"{field.name} of a workbook is {expected.simpleString()}")
        return _WorkbookReader(schema, self.options)


def read_workbooks(
    spark: SparkSession,
    path: str,
    *,
    skip_rows: int = 0,
    header: bool = True,
    required: Sequence[str] = (),
    open_in_tasks: bool = False,
) -> DataFrame:
    """First sheet of every workbook under ``path`` as (path, row_no, cells).

    ``skip_rows`` preamble rows are skipped. With ``header`` the next row names the columns and
    ``cells`` is keyed by those names, otherwise by column letter. ``row_no`` is the sheet's own
    row number: unique and ordered within a path. A workbook whose header lacks one of the
    ``required`` names fails, naming the file: its rows would have no such cell and vanish later.
    With ``open_in_tasks`` the files are read by :class:`WorkbookSource` instead of ``binaryFile``.
    """
    required = tuple(required)
    if required and not header:
        raise ValueError("only a header can be required to have names")
    if open_in_tasks:
        spark.dataSource.register(WorkbookSource)
        reader = spark.read.format(WorkbookSource.name()).option("required", json.dumps(required))
        return reader.option("skipRows", skip_rows).option("header", header).load(path)

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, content in zip(batch["path"], batch["content"]):
                rows = []
                for number, cells in _named_rows(io.BytesIO(content), file, skip_rows, header, required):
                    rows.append((file, number, cells))
                    if len(rows) == _BATCH_ROWS:
                        yield pd.DataFrame(rows, columns=["path", "row_no", "cells"])
                        rows = []
                if rows:
                    yield pd.DataFrame(rows, columns=["path", "row_no", "cells"])

    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "*.[xX][lL][sS][xX]")
        .option("recursiveFileLookup", True)
        .load(path)
        .select("path", "content")
    )
    return files.mapInPandas(parse, _SCHEMA)


def sheet_columns(
    sheet: DataFrame, columns: dict[str, str], null_tokens: Sequence[str] = NULL_TOKENS
) -> DataFrame:
    """(path, row_no, …) with one text column per entry of ``{cell key: column name}``."""
    texts = {name: F.try_element_at("cells", F.lit(key)) for key, name in columns.items()}
    return sheet.select(
        "path",
        "row_no",
        *[F.when(~text.isin(*null_tokens), text).alias(name) for name, text in texts.items()],
    )
