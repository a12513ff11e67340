"""CSV files bound by their own headers, and a table of the records that do not fit.

Files of one folder may hold the columns in any order, lack optional ones or have more.
Headers are read by one small job that stops after the first record of every file; files
with the same header are then scanned together, with a schema in the order of that header.
Records of another length than their header, and cells that are not of their column's type,
go to the rejects with the record as it stands.
"""

from __future__ import annotations

import csv
import io
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..plans.staging import stage

RECORD = "_record"  # where Spark puts a record that does not fit
_ONE_FILE_EACH = str(1 << 40)  # bytes that opening a file counts for, so that no task reads two of them


def cells_of(record: str) -> list[str]:
    return next(csv.reader(io.StringIO(record.removeprefix("\ufeff"))), [])


def _headers_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first record of the one file that a task reads; a quoted line break belongs to its cell."""
    text, file = "", None
    for batch in batches:
        if batch.num_rows and batch.column("begin")[0].as_py():
            return  # not the beginning of the file
        for file, line in zip(batch.column("file").to_pylist(), batch.column("value").to_pylist()):
            text += line + "\n"
            if text.count('"') % 2 == 0:
                yield pa.RecordBatch.from_pydict({"file": [file], "header": [cells_of(text)]})
                return
    if file is not None:
        yield pa.RecordBatch.from_pydict({"file": [file], "header": [cells_of(text)]})


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    """(file, header) of every file that is not empty; a file is read up to its first record."""
    session = spark.newSession()  # has settings of its own
    session.conf.set("spark.sql.files.openCostInBytes", _ONE_FILE_EACH)
    lines = session.read.text(path)
    lines = lines.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("begin"))
    return lines.mapInArrow(_headers_task, "file string, header array<string>")


def _folder_columns(file: str) -> set[str]:
    """Names of the columns that a file's folders stand for."""
    return set(re.findall(r"/([^/=]+)=[^/]*(?=/)", file))


@dataclass
class Layout:
    """Files with one header, read as texts in its order."""

    spark: SparkSession
    files: list[str]
    base: str | None  # folder above those that stand for columns
    header: list[str]
    asked: StructType

    def scan(self, rejects: bool) -> DataFrame:
        """Records of the header's length; or all, with those of another length as they stand."""
        inside = [StructField(c, StringType()) for c in self.header] + [StructField(RECORD, StringType())] * rejects
        folders = [f for f in self.asked if f.name not in self.header and f.name in _folder_columns(self.files[0])]
        reader = self.spark.read.schema(StructType([*inside, *folders])).options(
            header=True, multiLine=True, quote='"', escape='"', encoding="UTF-8", columnPruning=False,
            mode="PERMISSIVE" if rejects else "DROPMALFORMED", columnNameOfCorruptRecord=RECORD,
        )
        return (reader.option("basePath", self.base) if self.base else reader).csv(self.files)

    def typed(self) -> dict[str, tuple[Column, Column]]:
        """Asked columns that the files have: value, and whether a cell is not of the column's type."""
        found = {}
        for f in self.asked:
            cell = F.col(f"`{f.name}`")
            if f.name in self.header:
                value = cell.try_cast(f.dataType)
                found[f.name] = value, cell.isNotNull() & value.isNull()
            elif f.name in _folder_columns(self.files[0]):
                found[f.name] = cell, F.lit(False)
        return found

    def rows(self) -> DataFrame:
        wide, typed = self.scan(False), self.typed()
        for f in self.asked:
            if f.name in typed and not isinstance(f.dataType, StringType):
                wide = wide.filter(~typed[f.name][1])
        none = lambda f: F.lit(None).cast(f.dataType)
        return wide.select(*[(typed[f.name][0] if f.name in typed else none(f)).alias(f.name) for f in self.asked])

    def rejects(self) -> DataFrame:
        wide = self.scan(True)
        wrong = F.concat_ws(",", *[F.when(bad, F.lit(name)) for name, (_, bad) in self.typed().items()])
        reason = F.when(F.col(RECORD).isNotNull(), "cells").otherwise(wrong)
        whole = F.to_csv(F.struct(*[F.col(f"`{c}`") for c in self.header]), {"escape": '"', "emptyValue": ""})
        file = F.col("_metadata.file_path").alias("file")
        return wide.select(file, reason.alias("reason"), F.coalesce(RECORD, whole).alias("record")).filter("reason <> ''")


@dataclass
class BoundCsv:
    """Rows in the columns of the asked schema, and the layouts they come from."""

    rows: DataFrame
    layouts: list[Layout]

    def rejects(self) -> DataFrame:
        """(file, reason, record) of the records that did not fit, staged by a scan of their own.

        The reason is ``cells`` for a record of another length than its header, or else
        the names of the columns whose cells are not of their type.
        """
        none = self.rows.sparkSession.createDataFrame([], "file string, reason string, record string")
        return stage(reduce(DataFrame.unionByName, [x.rejects() for x in self.layouts], none), "rejects")


def _schema(schema: str | StructType) -> StructType:
    return schema if isinstance(schema, StructType) else StructType.fromDDL(schema)


def _check(file: str, header: list[str], required: list[str]) -> None:
    missing = [c for c in required if c not in header and c not in _folder_columns(file)]
    if missing:
        raise ValueError(f"missing column(s): {', '.join(missing)} in {file}")
    twice = sorted({c for c in header if header.count(c) > 1})
    if twice:
        raise ValueError(f"column(s) named twice: {', '.join(twice)} in {file}")


def bind_csv(
    spark: SparkSession, path: str, schema: str | StructType, required: list[str] | None = None, fill_empty=("emojis",)
) -> BoundCsv:
    """Headered UTF-8 CSV, each file's columns bound by name.

    ``required`` columns (default: all of ``schema``) must be in every file, or at once a
    ValueError names the file; others are null where a file lacks them.  Columns that
    nobody asks for are not returned, but a record must still have one cell for each.
    Empty cells of ``fill_empty`` columns become ''.
    """
    asked = _schema(schema)
    required = asked.names if required is None else list(required)
    layouts = defaultdict(list)
    for r in read_headers(spark, path).collect():  # one row per file
        file = unquote(r.file)
        _check(file, r.header, required)
        layouts[tuple(r.header), frozenset(_folder_columns(file))].append(file)
    found = [
        Layout(spark, files, path if folders else None, list(header), asked) for (header, folders), files in layouts.items()
    ]
    rows = reduce(DataFrame.unionByName, [x.rows() for x in found] or [spark.createDataFrame([], asked)])
    return BoundCsv(rows.fillna("", [c for c in fill_empty if c in asked.names]), found)
