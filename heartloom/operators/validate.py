"""Data contracts of a formal run, each a table of violations that must be empty."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heartloom.missing import ContractError, fin, require_none, require_same_keys, require_unique
from heartloom.schemas import AUDIT_KEY, CANDIDATE_KEY, CONDITIONS, METHODS, ROIS, STATUSES, condition_dim, method_dim, roi_dim


def grid(references: DataFrame, methods: bool) -> DataFrame:
    """Keys that candidates (with methods) or audits must have."""
    spark = references.sparkSession
    dims = condition_dim(spark).select("condition").join(roi_dim(spark).select("roi"), F.lit(True))
    dims = dims.join(method_dim(spark).select("method"), F.lit(True)) if methods else dims
    return references.select("subject", "window_id").join(F.broadcast(dims), F.lit(True))


def missing_keys(references: DataFrame, candidates: DataFrame) -> DataFrame:
    """Keys of ``grid(references, True)`` that no candidate has.

    A window's candidates are summed into one number with a bit for each cell of the protocol, so a row for each window,
    and not one for each key, meets its reference.
    """
    cells = [(c[0], r, m) for c in CONDITIONS for r in ROIS for m in METHODS]
    bits = references.sparkSession.createDataFrame([(*cell, 1 << i) for i, cell in enumerate(cells)], "condition string, roi string, method string, bit long")
    seen = candidates.join(F.broadcast(bits), ["condition", "roi", "method"]).groupBy("subject", "window_id").agg(F.bit_or("bit").alias("seen"))
    gone = lambda i: (F.coalesce("seen", F.lit(0)).bitwiseAND(F.lit(1 << i)) == 0)
    each = F.array_compact(F.array(*(F.when(gone(i), F.struct(*(F.lit(v).alias(k) for k, v in zip(("condition", "roi", "method"), cell, strict=True)))) for i, cell in enumerate(cells))))
    out = references.select("subject", "window_id").join(seen, ["subject", "window_id"], "left").select("subject", "window_id", F.explode(each).alias("cell"))
    return out.select("subject", "cell.condition", "window_id", "cell.roi", "cell.method")


def _differ(a: F.Column, b: F.Column, rtol: float = 0.0, atol: float = 1e-9) -> F.Column:
    """Neither both missing nor within tolerance."""
    return ~F.coalesce(F.abs(a - b) <= atol + rtol * F.abs(b), a.isNull() & b.isNull())


def reference_mismatches(references: DataFrame, candidates: DataFrame) -> DataFrame:
    """Windows' references as candidates have them (and how many have them so, column n) that aren't the canonical one."""
    known = references.select("subject", "window_id", F.col("reference_hr_bpm").alias("hr"), F.col("reference_valid").alias("valid"))
    held = candidates.groupBy("subject", "window_id", "reference_hr_bpm", "reference_valid").agg(F.count("*").alias("n"))
    both = held.join(known, ["subject", "window_id"])
    return both.filter(_differ(fin("reference_hr_bpm"), fin("hr")) | ~F.col("reference_valid").eqNullSafe(F.col("valid")))


def status_broken() -> F.Column:
    """Unknown status; ok without an estimate; not ok with an estimate or an error."""
    ok = F.col("window_status") == "ok"
    some = F.col("rppg_hr_bpm").isNotNull() | F.col("signed_error_bpm").isNotNull() | F.col("absolute_error_bpm").isNotNull()
    return F.coalesce(~F.col("window_status").isin(*STATUSES), F.lit(True)) | (ok & fin("rppg_hr_bpm").isNull()) | (~ok & some)


def status_violations(c: DataFrame) -> DataFrame:
    return c.filter(status_broken())


def error_broken() -> F.Column:
    """Errors that aren't estimate less reference, or are there without both."""
    want = fin("rppg_hr_bpm") - fin("reference_hr_bpm")
    wrong = lambda a, b: F.when(want.isNull(), a.isNotNull()).otherwise(_differ(a, b, 1e-5, 1e-8))
    return wrong(F.col("signed_error_bpm"), want) | wrong(F.col("absolute_error_bpm"), F.abs(want))


def error_violations(c: DataFrame) -> DataFrame:
    return c.filter(error_broken())


def strength_violations(audit: DataFrame) -> DataFrame:
    """Frame rates beyond 0.4 of their target, and drifts that are not as strong as configured."""
    fps, shift = F.col("target_fps"), F.col("degradation_severity")
    rate = (F.col("degradation_factor") == "fps") & (F.col("retained_frame_count") >= 2) & F.coalesce(F.abs(fin("effective_fps") - fps) > 0.4, F.lit(True))
    moved = F.col("degradation_factor") == "roi_shift"
    seen = fin("max_roi_shift_fraction")
    far = (F.col("auditable_frame_count") > 0) & F.coalesce((seen > shift + 1e-9) | (seen < shift - 0.001), F.lit(True))
    return audit.filter(rate | (moved & (_differ(fin("roi_shift_fraction"), shift, 1e-5, 1e-8) | far)))


def strength_unseen(audit: DataFrame) -> DataFrame:
    """Degraded conditions none of whose windows can be checked."""
    seen = F.when(F.col("degradation_factor") == "fps", F.col("retained_frame_count") >= 2).otherwise(F.col("auditable_frame_count") > 0)
    return audit.filter("degradation_factor <> 'none'").groupBy("condition").agg(F.bool_or(seen).alias("seen")).filter("not seen")


def status_counts(c: DataFrame) -> DataFrame:
    return c.groupBy("window_status").agg(F.count("*").alias("n"))


def validate(references: DataFrame, candidates: DataFrame, audit: DataFrame) -> dict[str, object]:
    """Raise at the first contract broken, else the run's counts."""
    require_unique(references, ["subject", "window_id"], "references")
    require_unique(candidates, CANDIDATE_KEY, "candidates")
    require_unique(audit, AUDIT_KEY, "condition audit")
    require_same_keys(candidates, grid(references, True), CANDIDATE_KEY, "candidate grid")
    require_same_keys(audit, grid(references, False), AUDIT_KEY, "condition audit grid")
    require_none(reference_mismatches(references, candidates), "candidates do not match the canonical references")
    require_none(status_violations(candidates), "candidate status does not match its estimate")
    require_none(error_violations(candidates), "candidate errors do not match heart-rate estimates")
    require_none(strength_violations(audit), "degradation strength is outside its tolerance")
    require_none(strength_unseen(audit), "degradation strength cannot be checked")
    r = references.agg(F.countDistinct("subject").alias("s"), F.count("*").alias("n"), F.count_if("reference_valid").alias("v")).first()
    return {
        "subject_count": r.s, "completed_subject_count": r.s, "reference_window_count": r.n, "valid_reference_window_count": r.v, "candidate_count": candidates.count(),
        "condition_audit_count": audit.count(), "candidate_status_counts": {x.window_status: x.n for x in status_counts(candidates).collect()},
    }


def require_count(df: DataFrame, n: int, what: str) -> None:
    found = df.count()
    if found != n:
        raise ContractError(f"{what}: {found} rows, expected {n}")
