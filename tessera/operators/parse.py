"""Answers of a language model as tables, and asking for them."""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.session import fresh, name


def lenient_json(df: DataFrame, column: str) -> DataFrame:
    """df with parsed (variant) and status: strict, repaired (single quotes taken for double ones) or failed."""
    # within brackets a text with anything after its value is broken, or has two
    def read(text: Column) -> Column:
        held = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
        alone = F.try_variant_get(held, "$[1]", "variant").isNull()
        return F.when(alone, F.try_variant_get(held, "$[0]", "variant"))

    strict, repaired = read(name(column)), read(F.replace(name(column), F.lit("'"), F.lit('"')))
    status = F.when(strict.isNotNull(), "strict").when(repaired.isNotNull(), "repaired").otherwise("failed")
    return df.withColumn("parsed", F.coalesce(strict, repaired)).withColumn("status", status)


def _leaves(kind: T.StructType, path: tuple[str, ...] = ()) -> Iterator[tuple[tuple[str, ...], T.DataType]]:
    for f in kind:
        if isinstance(f.dataType, T.StructType):
            yield from _leaves(f.dataType, (*path, f.name))
        else:
            yield (*path, f.name), f.dataType


def flatten(df: DataFrame, key: str, column: str, under: str, separator: str = ".") -> DataFrame:
    """key and the fields of the object under a top-level name, nested ones with joined names, arrays as they are.

    The schema is the union over all rows that parse; what a row lacks is null. Keys
    are told apart by case. A joined name that is taken already, in any case, gets a number: "color" and "Color"
    are columns Color and color_2, in the order of their paths.
    """
    parsed = lenient_json(df, column).filter("status <> 'failed'")
    held, = fresh(df, "object")
    inner = F.try_variant_get("parsed", f"$[{_quoted(under)}]", "variant")
    rows = parsed.select(name(key).alias(key), inner.alias(held)).filter(F.col(held).isNotNull() & ~F.is_variant_null(held))
    found = rows.agg(F.schema_of_variant_agg(held).alias("s")).first()["s"]
    if not found or not found.startswith("OBJECT<"):
        return rows.select(name(key))
    kind = T.StructType.fromDDL(f"x {_ddl(found)}")["x"].dataType
    columns, taken = [], {key.lower()}
    for path, of in sorted(_leaves(kind), key=lambda leaf: leaf[0]):
        wanted = column_name = separator.join(path)
        n = 1
        while column_name.lower() in taken:
            n += 1
            column_name = f"{wanted}_{n}"
        taken.add(column_name.lower())
        steps = "".join(f"[{_quoted(part)}]" for part in path)
        columns.append(F.try_variant_get(held, f"${steps}", of.simpleString()).alias(column_name))
    return rows.select(name(key), *columns)


def _quoted(key: str) -> str:
    """A key within a variant path, in the quotes that it does not have itself."""
    if "'" in key and '"' in key:
        raise ValueError(f"a key with both kinds of quotes can't be looked up: {key!r}")
    return f'"{key}"' if "'" in key else f"'{key}'"


def _ddl(variant_schema: str) -> str:
    """The schema as a DDL type; names of fields, which a colon follows, stay as they are."""
    types = {"OBJECT<": "STRUCT<", "VOID": "STRING"}
    pattern = r"`(?:[^`]|``)*`\s*:|[^<>,:`\s]+\s*:|OBJECT<|VOID"
    return re.sub(pattern, lambda m: types.get(m[0], m[0]), variant_schema)


def dedupe_last(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key: the one with the greatest order."""
    place, = fresh(df, "place")
    newest = Window.partitionBy(name(key)).orderBy(name(order).desc())
    return df.withColumn(place, F.row_number().over(newest)).filter(F.col(place) == 1).drop(place)


def with_retry(call: Callable[[str], str], tries: int = 10, first: float = 5.0, most: float = 600.0, sleep: Callable[[float], None] = time.sleep) -> Callable[[str], str | None]:
    """call with exponential waits between failures; None when all tries failed."""

    def attempt(text: str) -> str | None:
        wait = first
        for turn in range(tries):
            try:
                return call(text)
            except Exception:  # whatever a client's failure is, it is tried again
                if turn + 1 < tries:
                    sleep(wait)
                    wait = min(most, wait * 2)
        return None

    return attempt


def ask(df: DataFrame, column: str, client: Callable[[], Callable[[str], str]], parallel: int = 32, **retry) -> DataFrame:
    """(description, response) of each distinct text; client() makes one caller per partition."""
    texts = df.select(name(column).alias("description")).filter("description IS NOT NULL").distinct().repartition(parallel, "description")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = with_retry(client(), **retry)
        for batch in batches:
            yield batch.assign(response=[call(t) for t in batch["description"]])

    return texts.mapInPandas(run, "description string, response string")


def field(column: Column, path: str, kind: str) -> Column:
    """A typed field of a JSON text; null if it is absent or the text is broken."""
    return F.try_variant_get(F.try_parse_json(column), path, kind)
