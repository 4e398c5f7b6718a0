"""The four batch jobs: baseline, formal degradation run, degradation statistics, reliability model."""

from __future__ import annotations

import time
from collections.abc import Callable
from datetime import datetime, timezone
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heartloom.lineage import cut
from heartloom.missing import ContractError, require_none, require_same_keys, require_unique
from heartloom.operators import bootstrap, candidates, degrade, faces, reliability, validate
from heartloom.operators.landmarks import FaceMesh, Factory
from heartloom.schemas import CONDITIONS, METHODS, REPLICATES, ROIS, SEED
from heartloom.sources import provenance, sinks, tables, video

FORMAL_SUBJECTS, FORMAL_WINDOWS = 42, 248


def baseline(samples: DataFrame, original: DataFrame, output: str, subjects: list[str] | None = None) -> dict[str, int]:
    """Reference windows, original candidates and metrics of all (or the named) subjects; returns three counts.

    samples: contact samples; original: long traces of the undegraded recordings with sel_seq. The output is published
    as one, in the form that ``formal_run_from_folders`` reads.
    """
    if subjects is not None:
        samples, original = (d.filter(F.col("subject").isin(subjects)) for d in (samples, original))
    with sinks.publication(samples.sparkSession, output) as place:
        sinks.write_table(original, f"{place}/traces.parquet")
        original = samples.sparkSession.read.parquet(f"{place}/traces.parquet")  # recordings are read once
        refs = candidates.reference_windows(samples).persist()
        found = candidates.candidates(refs, original.withColumn("condition", F.lit("original")), ["original"]).persist()
        try:
            sinks.write_csv(refs.orderBy("subject", "window_id"), f"{place}/reference_windows.csv")
            sinks.write_csv(found, f"{place}/original_candidates.csv")
            sinks.write_report(candidates.metrics(found), f"{place}/original_metrics.csv")
            return {"subjects": refs.select("subject").distinct().count(), "reference_windows": refs.count(), "candidates": found.count()}
        finally:
            refs.unpersist()
            found.unpersist()


def recording_traces(recordings: DataFrame, detector: Factory, fractions: list[float], max_frames: int | None = None) -> DataFrame:
    """Long traces, with sel_seq, of recordings (subject, video_path) at all fractions of shift, from one reading."""
    ranges = video.ranges(recordings.select("subject", "video_path"), max_frames)
    return faces.video_traces(ranges, detector, fractions).withColumn("sel_seq", F.col("frame_idx"))


def baseline_from_folders(spark: SparkSession, dataset: str, detector: Factory, output: str, subjects: list[str] | None = None, max_frames: int | None = None) -> dict[str, int]:
    """The baseline run from a folder of recordings: contact samples and videos, one detector a recording."""
    found = tables.discover_subjects(spark, dataset)
    found = found.filter(F.col("subject").isin(subjects)) if subjects is not None else found
    names = found.collect()  # a name and two paths a subject
    if not names:
        raise ContractError("dataset has no (such) subjects")
    truth = tables.load_ground_truth(spark, [r.ground_truth_path for r in names])
    truth = truth.withColumn("subject", F.regexp_extract("path", r"/([^/]+)/[^/]+$", 1))
    return baseline(tables.samples_long(truth), recording_traces(found, detector, [0.0], max_frames), output)


def degradation(references: DataFrame, original: DataFrame, shifted: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Candidates and condition audits of all subjects and conditions, from traces that are made once."""
    frames = cut(degrade.condition_traces(references, original, shifted))
    return candidates.candidates(references, frames), candidates.condition_audit(references, frames)


Tables = tuple[DataFrame, DataFrame, DataFrame]


def formal_run(spark: SparkSession, references: DataFrame, original: DataFrame, shifted: DataFrame, output: str, subjects: int = FORMAL_SUBJECTS, windows: int = FORMAL_WINDOWS, inputs: dict[str, Any] | None = None) -> dict[str, Any]:
    """The formal run over tables; see ``_formal``."""
    return _formal(spark, lambda facts: (references, original, shifted), output, subjects, windows, inputs or {})


def formal_run_from_folders(spark: SparkSession, dataset: str, model: str, baseline: str, shifted: str | None, output: str, subjects: int = FORMAL_SUBJECTS, windows: int = FORMAL_WINDOWS, detector: Factory | None = None) -> dict[str, Any]:
    """The formal run from a folder of recordings, the face model and a baseline run's output.

    What is there is counted and hashed for the manifest, and checked against the protocol. The shifted regions are
    measured from the recordings, all shifts from one reading, by detectors made by ``detector`` (of the model file if it
    is not given); or they are long traces in a Parquet folder, if shifted names one.
    """

    def load(facts: dict[str, Any]) -> Tables:
        facts |= {"dataset": {"root": dataset, "readable": False, "subject_count": 0}, "model": {"path": model, "size_bytes": None, "sha256": None}, "baseline": {"path": baseline, "reference_window_count": 0, "reference_sha256": None}, "shifted": {"path": shifted}}
        if not sinks.exists(spark, dataset, folder=True):
            raise ContractError("dataset root is not readable")
        facts["dataset"]["readable"] = True
        found = tables.discover_subjects(spark, dataset)
        facts["dataset"]["subject_count"] = found.count()
        if facts["dataset"]["subject_count"] != subjects:
            raise ContractError(f"dataset has {facts['dataset']['subject_count']} subjects, the protocol {subjects}")
        if not sinks.exists(spark, model):
            raise ContractError("face model does not exist")
        facts["model"] |= tables.file_facts(spark, model)
        path = f"{baseline}/reference_windows.csv"
        if not sinks.exists(spark, path) and not sinks.exists(spark, path, folder=True):
            raise ContractError("baseline reference table does not exist")
        references = tables.read_references(spark, path)
        facts["baseline"] |= {"reference_window_count": references.count(), "reference_sha256": tables.file_facts(spark, path)["sha256"]}
        if facts["baseline"]["reference_window_count"] != windows:
            raise ContractError(f"baseline has {facts['baseline']['reference_window_count']} windows, the protocol {windows}")
        require_unique(references, ["subject", "window_id"], "baseline references")
        require_same_keys(references, found, ["subject"], "baseline subjects")
        traced, original = tables.baseline_traces(spark, baseline)
        require_none(found.join(traced, "subject", "left_anti"), "baseline trace is missing")
        if shifted is not None:
            return references, original, spark.read.parquet(shifted)
        moved = recording_traces(found, detector or FaceMesh(model), [f for _, _, kind, f, _ in CONDITIONS if kind == "roi_shift"])
        names = [F.when(F.col("roi_shift_fraction") == f, name) for name, _, kind, f, _ in CONDITIONS if kind == "roi_shift"]
        return references, original, moved.withColumn("condition", F.coalesce(*names))

    return _formal(spark, load, output, subjects, windows, {})


def _formal(spark: SparkSession, load: Callable[[dict[str, Any]], Tables], output: str, subjects: int, windows: int, facts: dict[str, Any]) -> dict[str, Any]:
    """Contracts on inputs, degradation, validation, outputs, and a manifest on success and failure.

    The output folder must be empty. Tables are written after validation only, and published together by one rename; the
    manifest comes last. An error is recorded, then raised, and leaves no table.
    """
    sinks.require_empty(spark, output)
    began, clock = datetime.now(timezone.utc), time.monotonic()
    protocol = {"conditions": [c[0] for c in CONDITIONS], "rois": ROIS, "methods": METHODS, "subjects": subjects, "windows": windows}
    manifest: dict[str, Any] = {"schema_version": "degradation_run_v1", "status": "failed", "started_at": began.isoformat(), "inputs": facts, "environment": provenance.environment(spark), "code": provenance.code(), "protocol": protocol, "output": output, "output_files": {}}
    kept: list[DataFrame] = []
    try:
        references, original, shifted = load(facts)
        n = references.agg(F.countDistinct("subject").alias("s"), F.count("*").alias("w")).first()
        if (n.s, n.w) != (subjects, windows):
            raise ContractError(f"protocol has {subjects} subjects and {windows} windows, found {n.s} and {n.w}")
        missing = references.select("subject").distinct().join(original.select("subject").distinct(), "subject", "left_anti").limit(1).collect()
        if missing:
            raise ContractError(f"no trace for {missing[0].subject}")
        kept = [d.persist() for d in degradation(references, original, shifted)]
        found, audit = kept
        manifest["summary"] = validate.validate(references, found, audit)
        with sinks.publication(spark, output) as place:
            sinks.write_table(found, f"{place}/degradation_candidates.parquet")
            sinks.write_csv(audit, f"{place}/condition_audit.csv")
            manifest["output_files"] = {name: tables.file_facts(spark, f"{place}/{name}") for name in ("degradation_candidates.parquet", "condition_audit.csv")}
        manifest["status"] = "completed"
    except Exception as e:
        manifest |= {"error": {"type": type(e).__name__, "message": str(e)}, "output_files": {}}
        raise
    finally:
        for d in kept:
            d.unpersist()
        manifest |= {"finished_at": datetime.now(timezone.utc).isoformat(), "duration_sec": time.monotonic() - clock}
        sinks.write_json(spark, f"{output}/run_manifest.json", manifest)
    return manifest


def statistics(spark: SparkSession, path: str, output: str, replicates: int = REPLICATES, seed: int = SEED, metric_rows: int | None = 30, bootstrap_rows: int | None = 120) -> dict[str, int]:
    """Metrics and bootstrap of a candidates table; nothing is written unless both have their number of rows."""
    df = tables.read_candidates(spark, path).persist()
    metrics, boot = candidates.metrics(df).persist(), bootstrap.degradation_bootstrap(df, replicates, seed).persist()
    try:
        for table, n, what in ((metrics, metric_rows, "degradation metrics"), (boot, bootstrap_rows, "degradation bootstrap")):
            if n is not None:
                validate.require_count(table, n, what)
        with sinks.publication(spark, output) as place:
            sinks.write_report(metrics, f"{place}/degradation_metrics.csv")
            sinks.write_report(boot, f"{place}/degradation_bootstrap.csv")
        return {"metrics": metrics.count(), "bootstrap": boot.count()}
    finally:
        for d in (df, metrics, boot):
            d.unpersist()


def reliability_model(spark: SparkSession, path: str, output: str, replicates: int = REPLICATES, seed: int = SEED) -> dict[str, Any]:
    """Predictions and report of the reliability model of a candidates table."""
    df = tables.read_candidates(spark, path).persist()
    try:
        route, predicted, report = reliability.reliability(df, replicates, seed)
        with sinks.publication(spark, output) as place:
            sinks.write_table(predicted, f"{place}/reliability_predictions.parquet")
            sinks.write_report(report, f"{place}/reliability_metrics.csv")
        return {"route": route, "predictions": predicted.count()}
    finally:
        df.unpersist()
