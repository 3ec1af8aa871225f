"""Session helpers: names, shared storage and written tables."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def name(column: str) -> Column:
    """A column by its literal name; dots and spaces are part of the name."""
    return F.col("`" + column.replace("`", "``") + "`")


def fresh(df: DataFrame, *wanted: str) -> list[str]:
    """Names like the wanted ones that no column of df has, in any case."""
    taken, found = {c.lower() for c in df.columns}, []
    for c in wanted:
        new = f"_{c}"
        while new.lower() in taken:
            new = f"_{new}"
        found.append(new)
        taken.add(new.lower())
    return found


def table(spark: SparkSession, sf_dir: str, which: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{which}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is the one the cluster names in spark.checkpoint.dir; a temporary one
    is made only in local mode, where nothing is set and there is one machine.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", folder)
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


_made: ContextVar[list[str] | None] = ContextVar("made", default=None)  # what the innermost scratch has written


def written(df: DataFrame, what: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back.

    This cuts the lineage: a lost executor costs a reread, not a recomputation,
    and values drawn while writing (ids of rows) are fixed from here on. Within
    a scratch the table goes when the scratch ends, unless it is kept.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tessera/{uuid.uuid4().hex}-{what}"
    if (made := _made.get()) is not None:
        made.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a table's folder, on whatever store it is."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Delete what is written within, but for what the given function writes.

    Such a table belongs to the scratch around this one, if there is one. What is
    returned from within may depend on nothing else that was written there.
    """
    outer, made, kept = _made.get(), [], []
    token = _made.set(made)

    def keep(df: DataFrame, what: str) -> DataFrame:
        found = written(df, what)
        kept.append(made[-1])
        return found

    try:
        yield keep
    finally:
        _made.reset(token)
        if outer is not None:
            outer += kept
        for path in made:
            if path not in kept:
                delete(spark, path)


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of at most so many rows for the jobs that run within."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key, "10000")
    spark.conf.set(key, str(min(int(before), rows)))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def small_batches(spark: SparkSession, rows: int = 256) -> None:
    """Keep Arrow batches small from here on: rows may hold megabytes of text each."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > rows:
        spark.conf.set(key, str(rows))
