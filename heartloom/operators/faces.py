"""Face geometry, shifted regions and their colours.

Frames and masks stay inside Arrow stages: a frame comes from the video scan (or from a raster column) as an array, the
regions are runs of pixels (``functions.runs``), and colours are differences of running sums, so that a row for each
region is all that leaves a stage, and no pixel is ever shuffled.

Tables: frames (subject, frame_idx, time_sec, width, height), landmarks (subject, frame_idx, landmark_id, x, y) with x and
y from 0 to 1; and frames with rasters, which have also

* raster: r, g, b of each pixel, line by line, as bytes or as doubles,
* landmarks: array of x, y, x, y ..., null without a face,
* regions: array of (roi, runs), runs being y, x0, x1 (after the last pixel), y, ...; where it is null, the three regions
  are drawn from the landmarks,
* present (optional): runs of the pixels that the raster holds; all others count for nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heartloom.functions import regions as face
from heartloom.functions import runs
from heartloom.functions.runs import Runs, Size
from heartloom.lineage import cut
from heartloom.missing import ratio
from heartloom.operators.landmarks import Factory, tracked
from heartloom.operators.windows import motion_since_face
from heartloom.schemas import ROIS
from heartloom.sources import video

FRAME = ["subject", "frame_idx"]


def first_frames(frames: DataFrame, n: int | None) -> DataFrame:
    """The first n frames of each recording, all if n is null."""
    return frames if n is None else frames.filter(F.col("frame_idx") < n)


def landmark_pixels(landmarks: DataFrame, frames: DataFrame) -> DataFrame:
    """landmarks with x and y in pixels: 0 and 1 are the first and the last pixel."""
    held = landmarks.join(frames.select(*FRAME, "width", "height"), FRAME)
    return held.withColumns({"x": F.col("x") * (F.col("width") - 1), "y": F.col("y") * (F.col("height") - 1)})


def face_geometry(frames: DataFrame, landmarks: DataFrame) -> DataFrame:
    """frames with landmark_valid, face_width_px, face_area_ratio, face_center_shift and face_area_change.

    Frames without landmarks keep their row, with missing measures.
    """
    box = landmark_pixels(landmarks, frames).groupBy(*FRAME).agg(*(f(c).alias(f"{c}{k}") for c in ("x", "y") for k, f in ((0, F.min), (1, F.max))))
    wide, high = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    held = frames.join(box, FRAME, "left").withColumns({
        "landmark_valid": F.col("x0").isNotNull(), "cx": (F.col("x0") + F.col("x1")) / 2, "cy": (F.col("y0") + F.col("y1")) / 2, "face_width_px": wide,
        "face_area_ratio": ratio(wide * high, F.col("width") * F.col("height")),
    })
    return motion_since_face(held).drop("cx", "cy", "x0", "x1", "y0", "y1")


COLOURS = {"n_pixels": pa.int64(), "r": pa.float64(), "g": pa.float64(), "b": pa.float64(), "brightness": pa.float64(), "overexposure_ratio": pa.float64(), "valid": pa.bool_()}
REGION = {"roi_shift_fraction": pa.float64(), "roi_shift_x_px": pa.float64(), "roi_shift_y_px": pa.float64(), "roi": pa.string(), **COLOURS, "retention_ratio": pa.float64()}
KINDS = {pa.int64(): "bigint", pa.float64(): "double", pa.bool_(): "boolean", pa.string(): "string"}
FACE = {"frame_idx": pa.int64(), "time_sec": pa.float64(), "landmark_valid": pa.bool_(), "cx": pa.float64(), "cy": pa.float64(), "face_width_px": pa.float64(), "face_area_ratio": pa.float64()}
MEASURED = "subject string, " + ", ".join(f"{c} {KINDS[t]}" for c, t in FACE.items()) + ", regions array<struct<" + ", ".join(f"{c}: {KINDS[t]}" for c, t in REGION.items()) + ">>"


def _column(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    """An Arrow column; NaN is missing."""
    return pa.array(values, kind, from_pandas=pa.types.is_floating(kind))


def _figure(time: np.ndarray, width: np.ndarray, fraction: float) -> tuple[np.ndarray, np.ndarray]:
    """The drift of ``degrade.drift``, for arrays."""
    phase = np.mod(time, 10.0) * (2 * math.pi / 10.0)
    return np.sin(phase) * width * fraction, np.sin(phase * 2) * 0.5 * width * fraction


def _moved_colours(own: dict[str, Runs], dx: np.ndarray, dy: np.ndarray, prefix: np.ndarray, present: Runs | None) -> dict[str, dict[str, np.ndarray]]:
    """Of each region, moved by each frame's offsets: its colours and what it retains."""
    f, h, w, _ = prefix.shape
    size, out = Size(h, w - 1), {}
    for roi, region in own.items():
        there = runs.moved(region, face.whole_offset(dx), face.whole_offset(dy), size)
        out[roi] = face.colours(there if present is None else runs.both(there, present), prefix) | {"retention_ratio": face.retained(region, there, f, size)}
    return out


def measured(subject: str, index: np.ndarray, time: np.ndarray, shown: np.ndarray, marks: list[np.ndarray | None], given: list[dict[str, Runs]] | None, present: Runs | None, fractions: list[float]) -> pa.RecordBatch:
    """A row (columns MEASURED) for each of a recording's frames: geometry of the face, and its regions at each fraction of
    shift. Frames without a face have all regions, without measures."""
    n, h, w = shown.shape[:3]
    size = Size(h, w)
    faced = np.array([m is not None for m in marks])
    box = np.full((n, 4), np.nan)
    for i in np.flatnonzero(faced):
        p = face.pixel_landmarks(marks[i], size)
        box[i] = (*p.min(0), *p.max(0))
    x0, y0, x1, y1 = box.T
    width = x1 - x0
    seen = np.flatnonzero(faced)
    own: dict[str, Runs] = {}
    if len(seen):
        own = given if given is not None else face.face_regions(np.stack([face.pixel_landmarks(marks[i], size) for i in seen]), size)
        prefix = runs.prefix_sums(shown[seen], face.OVEREXPOSED)
    cells = {c: [] for c in REGION}
    for fraction in fractions:
        dx, dy = _figure(time, width, fraction) if fraction else (np.where(faced, 0.0, np.nan),) * 2
        found = _moved_colours(own, dx[seen], dy[seen], prefix, present) if len(seen) else {}
        for roi in ROIS:
            full = {c: np.zeros(n, np.int64 if t == pa.int64() else bool) if t != pa.float64() else np.full(n, np.nan) for c, t in (*COLOURS.items(), ("retention_ratio", pa.float64()))}
            for c, v in found.get(roi, {}).items():
                full[c][seen] = v
            for c, v in ({"roi_shift_fraction": np.full(n, fraction), "roi_shift_x_px": dx, "roi_shift_y_px": dy, "roi": np.full(n, roi, object)} | full).items():
                cells[c].append(v)
    each = len(fractions) * len(ROIS)
    flat = {c: np.stack(v, 1).ravel() if v else np.empty(0) for c, v in cells.items()}
    struct = pa.StructArray.from_arrays([_column(flat[c], t) for c, t in REGION.items()], list(REGION))
    area = width * (y1 - y0) / float(w * h)
    cols = {"frame_idx": index, "time_sec": time, "landmark_valid": faced, "cx": (x0 + x1) / 2, "cy": (y0 + y1) / 2, "face_width_px": width, "face_area_ratio": area}
    lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * each, pa.int32()), struct)
    return pa.RecordBatch.from_arrays([pa.array([subject] * n, pa.string()), *(_column(cols[c], t) for c, t in FACE.items()), lists], ["subject", *FACE, "regions"])


def _traces(rows: DataFrame) -> DataFrame:
    """Long traces of measured frames: motion since the last face first, then a row for each region and fraction."""
    moved = motion_since_face(cut(rows)).drop("cx", "cy")
    return moved.select("*", F.explode("regions").alias("x")).select(*(c for c in moved.columns if c != "regions"), "x.*")


def video_traces(ranges: DataFrame, make: Factory, fractions: list[float], stateful: bool = True) -> DataFrame:
    """Long traces (schemas.FRAME_COLUMNS, roi and its columns) of recordings at all fractions of shift, from one reading.

    ranges are the scan's (``sources.video.ranges``); a task reads its frames, finds landmarks and measures regions. With
    a stateful detector a recording's frames come to one detector in order; otherwise every range gets a detector of its
    own and ranges are dealt over all tasks. Every frame has a row for each region and fraction; without a face, or
    with too few pixels, its measures are missing and it is not valid. A fraction of 0 keeps its whole region.
    """
    fractions = [float(f) for f in fractions]
    found = video.in_order(ranges) if stateful else video.spread_out(ranges)

    def blocks(rows: Iterator[dict]) -> Iterator[tuple[tuple, int, float, np.ndarray]]:
        for r in rows:
            recording = (r["subject"], r["video_path"]) if stateful else (r["subject"], r["video_path"], r["first_frame"])
            at = r["first_frame"]
            for shown in video.rasters(r["video_path"], r["width"], r["height"], r["bits"], r["top_down"], r["places"]):
                yield recording, at, r["fps"], shown
                at += len(shown)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for batch in batches for r in batch.to_pylist())
        for recording, first, fps, shown, marks in tracked(blocks(rows), make):
            index = first + np.arange(len(shown))
            yield measured(recording[0], index, index / fps, shown, marks, None, None, fractions)

    return _traces(found.mapInArrow(run, MEASURED))


def _runs_of(flat: list[list[int] | None], size: Size) -> Runs:
    """Runs of frames, each given as y, x0, x1, y, ...; null has none. Runs outside the frame are an error."""
    n = [len(r or ()) // 3 for r in flat]
    v = np.array([x for r in flat for x in (r or ())], np.int64).reshape(-1, 3)
    y, x0, x1 = v.T
    if len(v) and (min(y.min(), x0.min()) < 0 or y.max() >= size.height or x1.max() > size.width):
        raise ValueError("a region's runs leave the frame")
    base = (np.repeat(np.arange(len(flat)), n) * size.height + y) * (size.width + 1)
    return runs.merged(base + x0, base + x1)


def _raster(data: bytes, size: Size) -> np.ndarray:
    kind = np.float64 if len(data) == 8 * 3 * size.height * size.width else np.uint8
    return np.frombuffer(data, kind).reshape(*size, 3)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """Rows of one recording and frame size that stand together, as many as the scan holds at a time."""
    held, room = [], 0
    for batch in batches:
        for i in range(batch.num_rows):
            r = {c: batch.column(k)[i].as_py() for k, c in enumerate(batch.schema.names)}
            same = held and all(r[c] == held[0][c] for c in ("subject", "width", "height")) and len(r["raster"]) == len(held[0]["raster"])
            if held and (not same or room + len(r["raster"]) > video.HELD):
                yield held
                held, room = [], 0
            held.append(r)
            room += len(r["raster"])
    if held:
        yield held


def _given(rows: list[dict], size: Size) -> dict[str, Runs]:
    by = [{g["roi"]: g["runs"] for g in r["regions"]} for r in rows]
    return {roi: _runs_of([b.get(roi) for b in by], size) for roi in sorted({k for b in by for k in b})}


def frame_traces(frames: DataFrame, fractions: list[float]) -> DataFrame:
    """The same from a table of frames with rasters, landmarks and, where not null, regions.

    A table with large frames should be read in small Arrow batches (spark.sql.execution.arrow.maxRecordsPerBatch).
    """
    fractions = [float(f) for f in fractions]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _blocks(batches):
            size = Size(rows[0]["height"], rows[0]["width"])
            marks = [None if r["landmarks"] is None else np.reshape(np.array(r["landmarks"], float), (-1, 2)) for r in rows]
            faced = [r for r, m in zip(rows, marks, strict=True) if m is not None]
            drawn = [r["regions"] is not None for r in faced]
            if any(drawn) and not all(drawn):
                raise ValueError(f"some frames of {rows[0]['subject']} have regions and some have none")
            args = (np.array([r["frame_idx"] for r in rows]), np.array([r["time_sec"] for r in rows], float), np.stack([_raster(r["raster"], size) for r in rows]), marks)
            yield measured(rows[0]["subject"], *args, _given(faced, size) if any(drawn) else None, None, fractions)

    held = frames.select(*FRAME, "time_sec", "width", "height", "raster", "landmarks", "regions")
    return _traces(held.mapInArrow(run, MEASURED))


def moved_regions(frames: DataFrame, x: float, y: float) -> DataFrame:
    """(subject, frame_idx, roi, the colours and retention_ratio) of given regions moved by x and y pixels.

    Regions without pixels of their own have no row. Pixels that are not present count for the region's extent, not for
    its colours.
    """
    names = {c: t for c, t in (*COLOURS.items(), ("retention_ratio", pa.float64()))}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _blocks(batches):
            size, n = Size(rows[0]["height"], rows[0]["width"]), len(rows)
            prefix = runs.prefix_sums(np.stack([_raster(r["raster"], size) for r in rows]), face.OVEREXPOSED)
            present = None if all(r["present"] is None for r in rows) else _runs_of([[v for line in range(size.height) for v in (line, 0, size.width)] if r["present"] is None else r["present"] for r in rows], size)
            for roi, got in _moved_colours(_given(rows, size), np.full(n, x), np.full(n, y), prefix, present).items():
                keep = ~np.isnan(got["retention_ratio"])
                cols = [pa.array([r["subject"] for r, k in zip(rows, keep, strict=True) if k], pa.string()), pa.array(np.array([r["frame_idx"] for r in rows])[keep]), pa.array([roi] * int(keep.sum()), pa.string())]
                yield pa.RecordBatch.from_arrays([*cols, *(_column(got[c][keep], t) for c, t in names.items())], [*FRAME, "roi", *names])

    held = frames.select(*FRAME, "width", "height", "raster", "regions", "present")
    return held.mapInArrow(run, "subject string, frame_idx long, roi string, " + ", ".join(f"{c} {KINDS[t]}" for c, t in names.items()))


def encoded(masks: DataFrame) -> DataFrame:
    """(subject, frame_idx, regions) of masks given as rows of pixels (subject, frame_idx, roi, x, y)."""
    lines = masks.groupBy(*FRAME, "roi", "y").agg(F.array_sort(F.collect_set(F.col("x").cast("int"))).alias("xs"))
    starts = F.filter("xs", lambda x: ~F.array_contains("xs", x - 1))
    ends = F.filter("xs", lambda x: ~F.array_contains("xs", x + 1))
    each = lines.select(*FRAME, "roi", F.flatten(F.zip_with(starts, ends, lambda a, b: F.array(F.col("y").cast("int"), a, b + 1))).alias("runs"))
    region = each.groupBy(*FRAME, "roi").agg(F.flatten(F.collect_list("runs")).alias("runs"))
    return region.groupBy(*FRAME).agg(F.collect_list(F.struct("roi", "runs")).alias("regions"))
