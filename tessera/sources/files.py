"""Readers by file kind, and tables as JSON."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.session import name
from tessera.sources.xls import XlsDataSource
from tessera.sources.xlsx import XlsxDataSource

# The public names of the two kinds of workbook.
WORKBOOKS = {XlsDataSource: "application/vnd.ms-excel", XlsxDataSource: "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet"}


def read(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """A CSV, Parquet, JSON, ORC or Excel file by its kind or suffix; others are refused."""
    kind = (kind or path.rstrip("/").rpartition(".")[2]).lower()
    if kind in ("csv", "text/csv"):
        return spark.read.csv(path, header=True, inferSchema=True, multiLine=True, escape='"')
    if kind in ("parquet", "orc", "json"):
        return spark.read.format(kind).load(path)
    for source, mime in WORKBOOKS.items():
        if kind in (source.name(), mime):
            spark.dataSource.register(source)
            return typed(spark.read.format(source.name()).load(path))
    raise ValueError(f"unsupported file type {kind!r}")


def typed(df: DataFrame) -> DataFrame:
    """String columns whose every value is a whole number, a number or a truth value become such, in one pass."""
    texts = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    kinds = ["bigint", "double", "boolean"]
    if not texts:
        return df
    fits = [F.coalesce(F.every(name(c).isNull() | name(c).try_cast(k).isNotNull()) & (F.count(name(c)) > 0), F.lit(False)) for c in texts for k in kinds]
    good = df.agg(*(f.alias(f"c{n}") for n, f in enumerate(fits))).first()
    to = {c: next((k for m, k in enumerate(kinds) if good[len(kinds) * n + m]), None) for n, c in enumerate(texts)}
    return df.select(*(name(c).try_cast(to[c]).alias(c) if to.get(c) else name(c) for c in df.columns))


def json_rows(df: DataFrame, key: str | None = None, limit: int = 5000) -> DataFrame:
    """The first rows (by key if given) for display: dates as text, null texts as ''."""
    columns = []
    for f in df.schema:
        shown = name(f.name)
        if isinstance(f.dataType, T.DateType | T.TimestampType | T.TimestampNTZType):
            shown = shown.cast("string")
        if isinstance(f.dataType, T.StringType | T.DateType | T.TimestampType | T.TimestampNTZType):
            shown = F.coalesce(shown, F.lit(""))
        columns.append(shown.alias(f.name))
    ordered = df if key is None else df.orderBy(name(key))
    return ordered.limit(limit).select(*columns)


def to_json(df: DataFrame, key: str | None = None, limit: int = 5000) -> dict[str, Any]:
    """{columns, rows, total_rows, returned_rows}; at most `limit` rows reach the driver, nulls as ''."""
    rows = [{k: "" if v is None else v for k, v in r.asDict(recursive=True).items()} for r in json_rows(df, key, limit).collect()]
    return {"columns": df.columns, "rows": rows, "total_rows": df.count(), "returned_rows": len(rows)}
