"""Profiles of all columns in one pass, and summaries."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.session import name
from tessera.operators.counts import value_counts


def _plain(df: DataFrame, column: str) -> Column:
    """The column, with NaN as null."""
    kind = df.schema[column].dataType
    return F.nanvl(name(column), F.lit(None).cast(kind)) if isinstance(kind, T.FloatType | T.DoubleType) else name(column)


def _numeric(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, T.NumericType | T.BooleanType)


def columns(df: DataFrame, which: list[str] | None = None, approximate: bool = False) -> DataFrame:
    """(name, dtype, unique_count, non_null, min, max, mean), one row per column; NaN counts as null.

    All columns are aggregated at once. approximate: sketches in place of exact
    distinct counts, whose state does not grow with the data.
    """
    which = [c for c in (which or df.columns) if not isinstance(df.schema[c].dataType, T.MapType | T.VariantType)]
    distinct = F.approx_count_distinct if approximate else F.count_distinct
    parts: list[Column] = []
    for k, c in enumerate(which):
        x = _plain(df, c)
        value = x.cast("double") if _numeric(df, c) else F.lit(None).cast("double")
        parts += [
            distinct(x).alias(f"u{k}"), F.count(x).alias(f"c{k}"), F.min(value).alias(f"l{k}"), F.max(value).alias(f"h{k}"), F.avg(value).alias(f"m{k}"),
        ]
    wide = df.agg(*parts)
    rows = [
        F.struct(
            F.lit(c).alias("name"), F.lit(df.schema[c].dataType.simpleString()).alias("dtype"), F.col(f"u{k}").alias("unique_count"),
            F.col(f"c{k}").alias("non_null"), F.col(f"l{k}").alias("min"), F.col(f"h{k}").alias("max"), F.col(f"m{k}").alias("mean"),
        )
        for k, c in enumerate(which)
    ]
    return wide.select(F.explode(F.array(*rows)).alias("x")).select("x.*")


def column_stats(df: DataFrame, top: int = 10) -> list[dict[str, Any]]:
    """The profile as dictionaries; text columns also have top_values, a list of (label, count)."""
    found = []
    for row in columns(df).collect():  # one row per column
        stats = row.asDict()
        if isinstance(df.schema[row["name"]].dataType, T.StringType):
            stats["top_values"] = [tuple(r) for r in value_counts(df, row["name"], top).collect()]
        found.append(stats)
    return found


def null_counts(df: DataFrame) -> DataFrame:
    """(name, nulls): null or NaN values of each column."""
    wide = df.agg(*(F.count_if(_plain(df, c).isNull()).alias(f"c{k}") for k, c in enumerate(df.columns)))
    rows = [F.struct(F.lit(c).alias("name"), F.col(f"c{k}").alias("nulls")) for k, c in enumerate(df.columns)]
    return wide.select(F.explode(F.array(*rows)).alias("x")).select("x.*")


def summary(df: DataFrame | None, analyzed: int = 0) -> dict[str, Any]:
    """Rows, columns, types, nulls and size as text (nested columns left out) of a dataset; zeros for none."""
    if df is None:
        return {"rows": 0, "columns": 0, "dtypes": {}, "null_counts": {}, "size_mb": 0.0, "analyzed_columns": 0}
    nulls = {r["name"]: r["nulls"] for r in null_counts(df).collect()}
    shown = [c for c, kind in df.dtypes if not kind.startswith(("array", "map", "struct", "variant"))]
    width = sum((F.coalesce(F.octet_length(name(c).cast("string")), F.lit(0)) for c in shown), F.lit(0))
    rows, size = df.agg(F.count("*"), F.sum(width)).first()
    return {
        "rows": rows, "columns": len(df.columns), "dtypes": dict(df.dtypes), "null_counts": nulls,
        "size_mb": round((size or 0) / 1e6, 2), "analyzed_columns": analyzed,
    }
