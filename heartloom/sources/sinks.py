"""Sinks: tables for people as one CSV file, tables for machines as Parquet, and the run manifest."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def path_of(spark: SparkSession, path: str):  # noqa: ANN202
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str, folder: bool = False) -> bool:
    """There is a file (or a folder) of that path in the session's file system."""
    p, fs = path_of(spark, path)
    return fs.exists(p) and bool(fs.getFileStatus(p).isDirectory()) == folder


def require_empty(spark: SparkSession, path: str) -> None:
    """The folder doesn't exist or has nothing in it."""
    p, fs = path_of(spark, path)
    if fs.exists(p) and len(fs.listStatus(p)):
        raise FileExistsError(f"output folder is not empty: {path}")


@contextmanager
def publication(spark: SparkSession, output: str) -> Iterator[str]:
    """A folder beside the output to write into; it becomes the output by one rename when all is written.

    The output must not exist or be empty. When anything fails, what was written goes and the output stays as it was, so
    a reader sees all tables or none.
    """
    require_empty(spark, output)
    place, fs = path_of(spark, output)
    staging, _ = path_of(spark, f"{output.rstrip('/')}.{uuid.uuid4().hex}.staging")
    fs.mkdirs(staging)
    try:
        yield staging.toString()
        fs.mkdirs(place.getParent())
        if fs.exists(place):
            fs.delete(place, False)
        if not fs.rename(staging, place):
            raise OSError(f"could not publish {output}")
    finally:
        fs.delete(staging, True)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV files with a header, one for each task; booleans as True and False, missing as empty."""
    cols = [F.initcap(F.col(c).cast("string")).alias(c) if t == "boolean" else F.col(c) for c, t in df.dtypes]
    df.select(*cols).write.option("header", True).csv(path)


def write_report(df: DataFrame, path: str) -> None:
    """The same as one file; for reports whose number of rows the protocol fixes."""
    write_csv(df.coalesce(1), path)


def write_table(df: DataFrame, path: str, *partition: str) -> None:
    df.write.partitionBy(*partition).parquet(path) if partition else df.write.parquet(path)


def write_json(spark: SparkSession, path: str, value: dict[str, Any]) -> None:
    p, fs = path_of(spark, path)
    out = fs.create(p, True)
    out.write(bytearray(json.dumps(value, indent=2, sort_keys=True, default=str).encode()))
    out.close()


def read_json(spark: SparkSession, path: str) -> dict[str, Any]:
    return json.loads(spark.read.text(path, wholetext=True).first()[0])
