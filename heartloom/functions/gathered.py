"""Windows whose frames lie together in a task: what is measured of each window, condition and region, many at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

from heartloom.functions import kernels
from heartloom.schemas import METHODS, ROIS

#: Rows that are worked through together, in whole windows.
CHUNK = 150_000
#: Columns of a frame of which the mean is taken.
MEANS = ("brightness", "overexposure_ratio", "face_area_ratio", "face_center_shift", "face_area_change")
FRAMES = ("__key", "subject", "window_id", "start_time_sec", "end_time_sec", "cell", "sel_seq", "time_sec", "r", "g", "b", *MEANS)
MEASURED = (
    "subject string, window_id bigint, condition string, roi string, n_frames bigint, sample_rate_hz double, valid_frame_fraction double, max_missing_gap_sec double, window_status string, "
    + ", ".join(f"mean_{c} double" for c in MEANS) + ", brightness_std double, " + ", ".join(f"{m.lower()}_{c} double" for m in METHODS for c in kernels.RATE.names)
)


def pick(times: np.ndarray, start: float, end: float, fps: float) -> list[int]:
    """Indices (from 0) of the frames picked for evenly spaced ticks, in the order of picking.

    Each tick takes the nearest frame not yet taken, the one of lower index of two equally near; it stops when none is
    left. Frames and ticks are gone through in order of time: of the frames not taken, only the last one passed and the
    next one ahead can be nearest, so a step looks at two frames and is exact.
    """
    at = np.argsort(times, kind="stable").tolist()
    t = times[at].tolist()
    ahead, n = 0, len(t)
    behind: list[int] = []  # passed and not taken, in order of time
    taken: list[int] = []
    for k in range(round((end - start) * fps)):
        tick = start + k / fps
        while ahead < n and t[ahead] <= tick:
            behind.append(ahead)
            ahead += 1
        if behind:
            own = len(behind) - 1
            while own and t[behind[own - 1]] == t[behind[own]]:  # of frames of one time the lowest index goes first
                own -= 1
            left = behind[own]
            if ahead == n or (abs(t[left] - tick), at[left]) < (abs(t[ahead] - tick), at[ahead]):
                taken.append(at[behind.pop(own)])
                continue
        if ahead == n:
            break
        taken.append(at[ahead])
        ahead += 1
    return taken


def _places(own: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Places in own, which is sorted, of all rows with each of the wanted values."""
    first = np.searchsorted(own, wanted)
    n = np.searchsorted(own, wanted, "right") - first
    return np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())


@np.errstate(divide="ignore", invalid="ignore")
def _quality(col: dict[str, np.ndarray], at: np.ndarray, n: np.ndarray, start: np.ndarray, end: np.ndarray) -> dict[str, np.ndarray]:
    """Measures of groups of n rows each, the rows at ``at``; the same as ``windows.window_quality``."""
    full = n > 0
    first = (np.cumsum(n) - n)[full]

    def sums(v: np.ndarray) -> np.ndarray:
        out = np.zeros(len(n))
        if len(first):
            out[full] = np.add.reduceat(v.astype(float), first)
        return out

    def mean(v: np.ndarray) -> np.ndarray:
        there = np.isfinite(v)
        return sums(np.where(there, v, 0.0)) / sums(there)

    t, good = col["time_sec"][at], np.isfinite(col["r"][at])
    n_good = sums(good).astype(int)
    out = {"n_frames": n, "valid_frame_fraction": np.where(full, n_good / np.maximum(n, 1), 0.0)} | {f"mean_{c}": mean(col[c][at]) for c in MEANS}
    light = col["brightness"][at]
    out["brightness_std"] = np.sqrt(mean((light - np.repeat(out["mean_brightness"], n)) ** 2))
    span = np.zeros(len(n))
    span[full] = t[first + n[full] - 1] - t[first]
    out["sample_rate_hz"] = rate = np.where((n >= 2) & (span != 0), (n - 1) / span, np.nan)
    some = n_good > 0
    gap, tg = end - start, t[good]
    if len(tg):
        begin = (np.cumsum(n_good) - n_good)[some]
        step = np.diff(tg, prepend=0.0)
        step[begin] = tg[begin] - start[some]
        gap[some] = np.maximum(np.maximum.reduceat(step, begin), end[some] - tg[begin + n_good[some] - 1])
    out["max_missing_gap_sec"] = gap
    expected = np.rint((end - start) * rate)
    cover = np.where(expected > 0, np.minimum(n / np.where(expected > 0, expected, 1), 1.0), 0.0)
    failed = [cover < 0.95, out["valid_frame_fraction"] < 0.80, gap > 0.50]
    return out | {"window_status": np.select(failed, ["low_video_coverage", "low_valid_fraction", "long_missing_gap"], "ok")}


def _work(table: pa.Table, sources: list[str], conditions: list[str], picked: dict[str, float]) -> pa.Table:
    col = {c: table[c].to_numpy() for c in ("window_id", "start_time_sec", "end_time_sec", "cell", "time_sec", "r", "g", "b", *MEANS)}
    subject, seq = table["subject"].combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False), table["sel_seq"].fill_null(0).to_numpy()
    order = np.lexsort((seq, col["cell"], col["window_id"], subject))
    col = {c: v[order] for c, v in col.items()}
    subject, seq = subject[order], seq[order]
    opens = np.flatnonzero(np.append(True, (subject[1:] != subject[:-1]) | (col["window_id"][1:] != col["window_id"][:-1])))
    window = np.repeat(np.arange(len(opens)), np.diff(np.append(opens, len(order))))
    cells = len(sources) * len(ROIS)
    # the place of each window's and cell's first row; rows of cell -1, which each window has, come before the others
    edge = np.searchsorted(window * (cells + 1) + col["cell"] + 1, np.arange(len(opens) * (cells + 1) + 1)).tolist()
    rows: list[np.ndarray] = []
    for w, head in enumerate(opens.tolist()):
        base = w * (cells + 1) + 1
        chosen = {}
        if picked:
            own = base + sources.index("original") * len(ROIS)
            lo, hi = edge[own], edge[own + len(ROIS)]
            frames, first = np.unique(seq[lo:hi], return_index=True)
            times = col["time_sec"][lo:hi][first]
            start, end = float(col["start_time_sec"][head]), float(col["end_time_sec"][head])
            chosen = {c: frames[pick(times, start, end, fps)] for c, fps in picked.items()}
        for c in conditions:
            at = base + sources.index("original" if c in picked else c) * len(ROIS)
            for k in range(at, at + len(ROIS)):
                rows.append(edge[k] + _places(seq[edge[k] : edge[k + 1]], chosen[c]) if c in picked else np.arange(edge[k], edge[k + 1]))
    n, each = np.array([len(x) for x in rows]), len(conditions) * len(ROIS)
    heads = np.repeat(opens, each)
    out = _quality(col, np.concatenate(rows), n, col["start_time_sec"][heads], col["end_time_sec"][heads])
    rate = out["sample_rate_hz"]
    ok = np.flatnonzero((out["window_status"] == "ok") & (rate > kernels.LEAST_RATE))
    rgb = np.column_stack([col[c] for c in "rgb"])
    found = np.full((len(METHODS), len(rows), len(kernels.RATE.names)), np.nan)
    found[:, ok] = kernels.estimates(rate[ok], [col["time_sec"][rows[i]] for i in ok], [rgb[rows[i]] for i in ok], METHODS)
    out |= {f"{m.lower()}_{c}": found[i, :, k] for i, m in enumerate(METHODS) for k, c in enumerate(kernels.RATE.names)}
    names = {"condition": np.tile(np.repeat(conditions, len(ROIS)), len(opens)).tolist(), "roi": np.tile(ROIS, len(opens) * len(conditions)).tolist()}
    names["window_status"] = out.pop("window_status").tolist()
    fields = [x.split()[0] for x in MEASURED.split(", ")]
    known = {"subject": table["subject"].take(pa.array(order[heads])), "window_id": pa.array(col["window_id"][heads])} | {c: pa.array(v, pa.string()) for c, v in names.items()}
    known |= {c: pa.array(v, from_pandas=True) for c, v in out.items()}
    return pa.table([known[c] for c in fields], names=fields)


def measured(sources: list[str], conditions: list[str], picked: dict[str, float]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows MEASURED of rows FRAMES that are sorted by __key, a number that the rows of a window share.

    cell is the number of the frame's source and region (source by source), or -1 in a row that each window has beside
    its frames. Conditions are sources, or picked from the original's frames at their frames a second.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending: list[pa.RecordBatch] = []
        held, wanted = 0, CHUNK
        for batch in batches:
            pending.append(batch)
            held += batch.num_rows
            if held < wanted:
                continue
            table = pa.Table.from_batches(pending)
            key = table["__key"].to_numpy()
            whole = int(np.searchsorted(key, key[-1]))  # the last window may go on in the next batch
            if whole:
                yield from _work(table.slice(0, whole), sources, conditions, picked).to_batches()
            table = table.slice(whole)
            pending, held = table.to_batches(), table.num_rows
            wanted = max(CHUNK, 2 * held)
        if held:
            yield from _work(pa.Table.from_batches(pending), sources, conditions, picked).to_batches()

    return run
