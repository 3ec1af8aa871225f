"""Filters from specifications: each becomes a predicate that Catalyst pushes into the scan."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.session import name


@dataclass(frozen=True)
class FilterSpec:
    """One filter; kind is categorical, numeric, text or date. A spec that lacks what its kind needs is ignored."""

    column: str
    kind: str
    values: list[Any] | None = None
    min_val: Any = None
    max_val: Any = None
    pattern: str | None = None
    case_sensitive: bool = False


def predicate(df: DataFrame, spec: FilterSpec) -> Column | None:
    """The predicate of a spec, or None if the column is unknown or the spec is incomplete.

    Categorical compares as text and keeps nothing for an empty list; a None
    among the values keeps nulls. Ranges include both ends and drop nulls and NaN. Text
    searches a regular expression anywhere; nulls never match.
    """
    if spec.column not in df.columns:
        return None
    column = name(spec.column)
    if spec.kind == "categorical" and spec.values is not None:
        known = [str(v) for v in spec.values if v is not None]
        found = column.cast("string").isin(known) if known else F.lit(False)
        return found | column.isNull() if None in spec.values else F.coalesce(found, F.lit(False))
    if spec.kind in ("numeric", "date") and spec.min_val is not None and spec.max_val is not None:
        return column.between(F.lit(spec.min_val), F.lit(spec.max_val))
    if spec.kind == "text" and spec.pattern:
        re.compile(spec.pattern)  # a bad pattern fails here, before any job
        return column.cast("string").rlike(spec.pattern if spec.case_sensitive else f"(?i){spec.pattern}")
    return None


def apply_filters(df: DataFrame, specs: Iterable[FilterSpec]) -> DataFrame:
    """Rows of df that meet all specs; none given: df itself."""
    found = [p for p in (predicate(df, s) for s in specs) if p is not None]
    return reduce(DataFrame.filter, found, df)


def filter_kind(df: DataFrame, column: str) -> str:
    """The kind of filter that suits a column's type."""
    kind = df.schema[column].dataType
    if isinstance(kind, T.NumericType | T.BooleanType):
        return "numeric"
    if isinstance(kind, T.DateType | T.TimestampType | T.TimestampNTZType):
        return "date"
    return "text"


def slider(df: DataFrame, column: str) -> dict[str, float | None]:
    """The full range of a numeric column and a hundredth of it as step, for a range filter."""
    row = df.agg(F.min(name(column)).cast("double").alias("low"), F.max(name(column)).cast("double").alias("high")).first()
    step = None if row["low"] is None else (row["high"] - row["low"]) / 100
    return {"min_val": row["low"], "max_val": row["high"], "step": step}


def suggest_kind(stats: dict[str, Any]) -> str:
    """The kind of filter that suits a column's profile (see profile.column_stats)."""
    if stats.get("top_values"):
        return "categorical"
    return "numeric" if stats.get("min") is not None else "text"


def non_blank(df: DataFrame, column: str) -> DataFrame:
    """Rows whose text is neither null nor blank."""
    return df.filter(name(column).isNotNull() & (F.trim(name(column).cast("string")) != ""))


def non_empty(df: DataFrame, column: str) -> DataFrame:
    """Rows whose text is neither null nor empty; blanks stay."""
    return df.filter(name(column).isNotNull() & (name(column).cast("string") != ""))


def filtered_pct(before: DataFrame, after: DataFrame) -> DataFrame:
    """(n_before, n_after, pct): the share of rows left, in percent; 0 for no rows."""
    counts = before.agg(F.count("*").alias("n_before")).join(after.agg(F.count("*").alias("n_after")))
    pct = F.coalesce(F.try_divide(F.col("n_after") * 100.0, F.col("n_before")), F.lit(0.0))
    return counts.select("n_before", "n_after", pct.alias("pct"))


def sort_rows(df: DataFrame, column: str, direction: str | None, tie: str) -> DataFrame:
    """Rows by a column, nulls last either way, ties by another; direction asc, desc or None."""
    if direction is None:
        return df.orderBy(name(tie))
    key = name(column).asc_nulls_last() if direction == "asc" else name(column).desc_nulls_last()
    return df.orderBy(key, name(tie))


def page(df: DataFrame, number: int, size: int = 100) -> DataFrame:
    """Page number (from 0) of ordered rows."""
    return df.offset(number * size).limit(size)


def head(df: DataFrame, key: str, n: int = 10_000, drop: tuple[str, ...] = ("embeddings",)) -> DataFrame:
    """The first n rows by a key, without columns too wide to explore; a negative n is refused."""
    if n < 0:
        raise ValueError("n must not be negative")
    return df.drop(*drop).orderBy(name(key)).limit(n)


def promote_dates(df: DataFrame, formats: tuple[str, ...] = ("yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ssXXX", "MM/dd/yyyy")) -> DataFrame:
    """String columns whose every value reads as a date become timestamps without a zone."""
    texts = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    if not texts:
        return df
    read = {c: F.coalesce(*(F.try_to_timestamp(name(c), F.lit(f)) for f in formats)) for c in texts}
    checks = [F.coalesce(F.every(name(c).isNull() | read[c].isNotNull()) & (F.count(name(c)) > 0), F.lit(False)) for c in texts]
    good = df.agg(*(c.alias(f"c{k}") for k, c in enumerate(checks))).first()
    dates = [c for k, c in enumerate(texts) if good[k]]
    return df.select(*(read[c].cast("timestamp_ntz").alias(c) if c in dates else name(c) for c in df.columns))
