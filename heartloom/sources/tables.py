"""Sources: recordings on disk, exported tables and driver tables."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heartloom.missing import require_none
from heartloom.schemas import CANDIDATES, REFERENCE_WINDOWS, ROI_COLUMNS, ROIS, TRACE_LONG, WIDE_TRACE
from heartloom.sources.files import sha256_of
from heartloom.sources.sinks import exists, path_of


def discover_subjects(spark: SparkSession, root: str) -> DataFrame:
    """(subject, subject_no, video_path, ground_truth_path) of folders subject<digits> that hold both files, by number.

    Only names are listed, by the session's file system; no file is read, and empty files count. Two folders of one
    number break the contract.
    """
    folder, fs = path_of(spark, root)
    listed = fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(folder, "*/*")) or []
    files = spark.createDataFrame([(x.getPath().toString(),) for x in listed], "path string")
    found = files.select("path", F.regexp_extract("path", r"/(subject\d+)/[^/]+$", 1).alias("subject"), F.regexp_extract("path", r"([^/]+)$", 1).alias("name"))
    found = found.filter("subject <> '' and name in ('vid.avi', 'ground_truth.txt')").groupBy("subject").agg(
        F.max(F.when(F.col("name") == "vid.avi", F.col("path"))).alias("video_path"), F.max(F.when(F.col("name") == "ground_truth.txt", F.col("path"))).alias("ground_truth_path")
    )
    found = found.dropna().withColumn("subject_no", F.regexp_extract("subject", r"(\d+)$", 1).cast("int"))
    require_none(found.groupBy("subject_no").count().filter("count > 1"), "two folders have one subject number")
    return found.select("subject", "subject_no", "video_path", "ground_truth_path").orderBy("subject_no", "subject")


def load_ground_truth(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, ppg, sensor_hr, time_sec): the three lines of numbers of each file, blank lines left out.

    Other than three lines, or lines of unequal or no length, raise when the rows are read.
    """
    lines = F.filter(F.split("value", r"\r?\n"), lambda x: F.trim(x) != "")
    text = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("path"), lines.alias("lines"))
    numbers = lambda i: F.transform(F.split(F.trim(F.get("lines", F.lit(i))), r"\s+"), lambda x: x.cast("double"))
    wide = text.select("path", F.when(F.size("lines") == 3, F.lit(True)).otherwise(F.raise_error(F.lit("ground truth must have three rows"))).alias("ok"), numbers(0).alias("ppg"), numbers(1).alias("sensor_hr"), numbers(2).alias("time_sec"))
    equal = F.col("ok") & (F.size("ppg") == F.size("sensor_hr")) & (F.size("ppg") == F.size("time_sec")) & (F.size("ppg") > 0)
    return wide.filter(F.when(equal, F.lit(True)).otherwise(F.raise_error(F.lit("ground truth rows must have equal lengths")))).drop("ok")


def samples_long(ground_truth: DataFrame) -> DataFrame:
    """(subject, i, time_sec, ppg, sensor_hr) from one row per subject with three arrays."""
    each = ground_truth.select("subject", F.posexplode(F.arrays_zip("time_sec", "ppg", "sensor_hr")).alias("i", "s"))
    return each.select("subject", F.col("i").cast("bigint").alias("i"), "s.time_sec", "s.ppg", "s.sensor_hr")


def _csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("nanValue", "NaN").csv(path)


def read_references(spark: SparkSession, path: str) -> DataFrame:
    return _csv(spark, path, REFERENCE_WINDOWS)


def read_candidates(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path) if path.endswith(".parquet") else _csv(spark, path, CANDIDATES)


def read_traces(spark: SparkSession, path: str) -> DataFrame:
    """Wide traces of many subjects; the subject is the file's name."""
    return _csv(spark, path, WIDE_TRACE).withColumn("subject", F.regexp_extract("_metadata.file_path", r"([^/]+)\.csv$", 1))


def trace_long(wide: DataFrame) -> DataFrame:
    """One row per frame and region; the frame's own columns are repeated."""
    own = [c for c in wide.columns if not any(c.startswith(f"{r}_") for r in ROIS)]
    each = F.explode(F.array(*(F.struct(F.lit(r).alias("roi"), *(F.col(f"{r}_{c}").alias(c) for c in ROI_COLUMNS)) for r in ROIS)))
    return wide.select(*own, each.alias("x")).select(*own, "x.*").withColumnsRenamed({"r_mean": "r", "g_mean": "g", "b_mean": "b"})


def trace_wide(long: DataFrame) -> DataFrame:
    """The inverse of trace_long."""
    own = [c for c in long.columns if c not in ("roi", "r", "g", "b", *ROI_COLUMNS)]
    held = long.withColumnsRenamed({"r": "r_mean", "g": "g_mean", "b": "b_mean"})
    return held.groupBy(*own).pivot("roi", list(ROIS)).agg(*(F.first(c).alias(c) for c in ROI_COLUMNS))


def file_sha256(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256) of every file's bytes, empty ones too; the driver lists names and sizes, and tasks read files in
    pieces, so that they may be of any size."""
    place, fs = path_of(spark, path)
    found, rows = fs.listFiles(place, True), []
    while found.hasNext():
        f = found.next()
        rows.append((f.getPath().toString(), f.getLen()))
    listed = spark.createDataFrame(rows, "path string, length long").repartition(max(1, min(len(rows), 1000)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.append_column("sha256", pa.array([sha256_of(p) for p in batch.column("path").to_pylist()], pa.string()))

    return listed.mapInArrow(run, "path string, length long, sha256 string")


def file_facts(spark: SparkSession, path: str) -> dict[str, object]:
    """Size and SHA-256 of a file; of a folder the sum of sizes and the hash of its files' names and hashes, in order."""
    files = file_sha256(spark, path).select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), "length", F.col("sha256").alias("sha")).filter(~F.col("name").rlike(r"^[._]"))
    rows = sorted(files.collect())
    sha = rows[0].sha if len(rows) == 1 else hashlib.sha256("\n".join(f"{r.name} {r.sha}" for r in rows).encode()).hexdigest()
    return {"size_bytes": sum(r.length for r in rows), "sha256": sha}


def baseline_traces(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(subjects that have a trace, long traces) of a baseline run's output: its Parquet table, or a CSV file a subject."""
    if exists(spark, f"{folder}/traces.parquet", folder=True):
        long = spark.read.parquet(f"{folder}/traces.parquet")
        return long.select("subject").distinct(), long
    named = trace_files(spark, f"{folder}/traces")
    if named.isEmpty():
        return named, spark.createDataFrame([], TRACE_LONG)
    return named, trace_long(read_traces(spark, f"{folder}/traces/*.csv")).withColumn("sel_seq", F.col("frame_idx"))


def trace_files(spark: SparkSession, folder: str) -> DataFrame:
    """(subject) of each trace file or folder <subject>.csv; only names are listed."""
    place, fs = path_of(spark, folder)
    listed = fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(place, "*.csv")) or []
    return spark.createDataFrame([(x.getPath().getName()[: -len(".csv")],) for x in listed], "subject string")
