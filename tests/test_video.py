"""From uncompressed AVI files to traces: scan, landmark stage, region masks."""

import hashlib
import math
import struct
import sys
import types
from fractions import Fraction

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from heartloom.functions import regions, runs
from heartloom.functions.runs import Size
from heartloom.missing import ContractError
from heartloom.operators import faces, landmarks
from heartloom.plans import jobs
from heartloom.sources import provenance, sinks, tables, video

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks don't know this module


def chunk(name, data):
    return name + struct.pack("<I", len(data)) + data + bytes(len(data) % 2)


def avi(frames, fps=10, bits=24, top_down=False, index="idx1", codec=bytes(4), parts=2, base=0):
    """A RIFF/AVI file of uncompressed frames (n x height x width x r, g, b); an empty frame repeats the one before."""
    h, w = next(f for f in frames if f is not None).shape[:2]
    line = -(-w * bits // 32) * 4

    def stored(f):
        if f is None:
            return b""
        rows = np.zeros((h, line), np.uint8)
        pixels = np.zeros((h, w, bits // 8), np.uint8)
        pixels[..., :3] = f[..., ::-1]
        rows[:, : w * bits // 8] = pixels.reshape(h, -1)
        return (rows if top_down else rows[::-1]).tobytes()

    data = [stored(f) for f in frames]
    strh = b"vids" + codec + struct.pack("<IHHIIIIIIII", 0, 0, 0, 0, 1, fps, 0, len(frames), 0, 0, 0) + bytes(8)
    strf = struct.pack("<IiiHH4sIiiII", 40, w, -h if top_down else h, 1, bits, codec, line * h, 0, 0, 0, 0)

    def header(extra):
        return chunk(b"LIST", b"hdrl" + chunk(b"avih", bytes(56)) + chunk(b"LIST", b"strl" + chunk(b"strh", strh) + chunk(b"strf", strf) + extra))

    if index == "super":  # frames in several RIFF parts, each with an index of its own; the header has the parts' places
        size = lambda n: len(header(chunk(b"indx", bytes(24 + 16 * n))))
        each = -(-len(data) // parts)
        groups = [data[i : i + each] for i in range(0, len(data), each)]
        at, places, bodies = 12 + size(len(groups)), [], []
        for k, group in enumerate(groups):
            at += 0 if k == 0 else 12
            first, offsets, body = at + 12, [], b""
            for d in group:
                offsets.append((len(body) + 8, len(d)))
                body += chunk(b"00db", d)
            place = first + len(body)
            index_chunk = chunk(b"ix00", struct.pack("<HBBI4sQI", 2, 0, 1, len(group), b"00db", first, 0) + b"".join(struct.pack("<II", o, n) for o, n in offsets))
            bodies.append(chunk(b"LIST", b"movi" + body + index_chunk))
            places.append(place)
            at = place + len(index_chunk)
        indx = chunk(b"indx", struct.pack("<HBBI4s12x", 4, 0, 0, len(places), b"00db") + b"".join(struct.pack("<QII", p, 0, 0) for p in places))
        out = b""
        for k, body in enumerate(bodies):
            inner = (b"AVI " + header(indx) + body) if k == 0 else (b"AVIX" + body)
            out += chunk(b"RIFF", inner)
        return out
    body, entries = b"movi", b""
    for d in data:
        entries += struct.pack("<4sIII", b"00db", 16, len(body) + base, len(d))
        body += chunk(b"00db", d) + chunk(b"01wb", b"abc")  # sound between the frames
        entries += struct.pack("<4sIII", b"01wb", 0, len(body) - 12 + base, 3)
    return chunk(b"RIFF", b"AVI " + header(b"") + chunk(b"LIST", body) + (chunk(b"idx1", entries) if index == "idx1" else b""))


def scanned(spark, path, **kw):
    files = spark.createDataFrame([("s", str(path))], "subject string, video_path string")
    return video.frames(video.ranges(files, **kw)).orderBy("frame_idx").collect()


@pytest.mark.parametrize("bits", [24, 32])
@pytest.mark.parametrize("index", ["idx1", "super", "none"])
def test_scan_gives_every_frame(spark, tmp_path, index, bits):
    rng = np.random.default_rng(bits)
    shown = [rng.integers(0, 256, (5, 7, 3)).astype(np.uint8) for _ in range(11)]
    held = [f if i != 4 else None for i, f in enumerate(shown)]  # the fifth repeats the fourth
    (tmp_path / "a.avi").write_bytes(avi(held, bits=bits, top_down=bits == 32, index=index, parts=3))
    got = scanned(spark, tmp_path / "a.avi", frames_per_range=4)
    assert [(r.frame_idx, r.time_sec, r.width, r.height) for r in got] == [(i, i / 10, 7, 5) for i in range(11)]
    for i, r in enumerate(got):
        assert (np.frombuffer(r.raster, np.uint8).reshape(5, 7, 3) == shown[3 if i == 4 else i]).all(), i
    assert [r.frame_idx for r in scanned(spark, f"file:{tmp_path}/a.avi", max_frames=6, frames_per_range=4)] == list(range(6))
    assert not scanned(spark, tmp_path / "a.avi", max_frames=0)


def test_frame_cap_reaches_the_ranges(spark, tmp_path):
    (tmp_path / "a.avi").write_bytes(avi([np.zeros((2, 2, 3), np.uint8)] * 20))
    files = spark.createDataFrame([("s", f"{tmp_path}/a.avi")], "subject string, video_path string")
    got = video.ranges(files, max_frames=7, frames_per_range=5).orderBy("first_frame").collect()
    assert [(r.first_frame, len(r.places)) for r in got] == [(0, 5), (5, 2)]


def test_what_is_not_readable_is_an_error(spark, tmp_path):
    (tmp_path / "mjpg.avi").write_bytes(avi([np.zeros((2, 2, 3), np.uint8)], codec=b"MJPG"))
    (tmp_path / "cut.avi").write_bytes(avi([np.zeros((40, 40, 3), np.uint8)])[:3000])
    (tmp_path / "text.avi").write_bytes(b"nothing of the kind")
    for name, said in (("mjpg", "codec MJPG"), ("text", "not a RIFF/AVI file"), ("none", "not found")):
        with pytest.raises(Exception, match=said):
            scanned(spark, tmp_path / f"{name}.avi")
    with pytest.raises(Exception, match="cut off"):
        scanned(spark, tmp_path / "cut.avi")


def face_points():
    """Landmarks in a frame of 100 x 100: an oval, and ellipses for the other groups."""
    out = np.full((regions.LANDMARKS, 2), 50.0)

    def ring(ids, cx, cy, rx, ry, turn=0.0):
        t = turn + 2 * math.pi * np.arange(len(ids)) / len(ids)
        out[list(ids)] = np.stack((cx + rx * np.cos(t), cy + ry * np.sin(t)), 1)

    ring(regions.FACE_OVAL, 50, 50, 36, 44, -math.pi / 2)
    for ids, x0, y0, x1, y1 in ((regions.FOREHEAD, 30, 25, 70, 43), (regions.LEFT_CHEEK, 18, 48, 44, 76), (regions.RIGHT_CHEEK, 56, 48, 82, 76), (regions.LEFT_EYE, 30, 40, 43, 48), (regions.RIGHT_EYE, 57, 40, 70, 48), (regions.MOUTH, 40, 65, 60, 75)):
        ring(ids, (x0 + x1) / 2, (y0 + y1) / 2, (x1 - x0) / 2, (y1 - y0) / 2)
    return out


class Scripted:
    """Finds a face in every frame but the listed ones, and counts what it saw in the landmarks' last point."""

    def __init__(self, absent=()):
        self.absent, self.seen, self.stamps = absent, 0, []

    def detect(self, rgb, timestamp_ms):
        self.seen += 1
        self.stamps.append(timestamp_ms)
        assert rgb.shape[2] == 3 and self.stamps == sorted(self.stamps)
        return None if self.seen - 1 in self.absent else face_points() / 99.0


def test_video_to_traces_with_a_missing_face(spark, tmp_path):
    (tmp_path / "a.avi").write_bytes(avi([np.full((100, 100, 3), (40, 80, 120), np.uint8)] * 3))
    found = video.ranges(spark.createDataFrame([("s", f"{tmp_path}/a.avi")], "subject string, video_path string"), frames_per_range=2)
    got = faces.video_traces(found, lambda: Scripted(absent=(1,)), [0.0]).orderBy("frame_idx", "roi").collect()
    assert len(got) == 9 and [r.time_sec for r in got[::3]] == pytest.approx([0.0, 0.1, 0.2])
    assert [r.landmark_valid for r in got[::3]] == [True, False, True]  # one detector saw all three frames
    for r in got:
        if r.frame_idx == 1:
            assert not r.valid and r.n_pixels == 0 and r.r is None and r.retention_ratio is None and r.face_center_shift is None
        else:
            assert r.valid and r.n_pixels > 50 and (r.r, r.g, r.b) == (40, 80, 120) and r.retention_ratio == 1.0 and r.face_center_shift == 0.0


@pytest.mark.parametrize("stateful", [True, False])
def test_two_shifts_from_one_reading(spark, tmp_path, stateful):
    frame = np.zeros((100, 100, 3), np.uint8)
    frame[:, :, 0] = np.arange(100)
    (tmp_path / "a.avi").write_bytes(avi([frame] * 6, fps=2, index="super"))
    found = video.ranges(spark.createDataFrame([("s", f"{tmp_path}/a.avi")], "subject string, video_path string"), frames_per_range=2)
    got = {(r.roi_shift_fraction, r.frame_idx, r.roi): r for r in faces.video_traces(found, Scripted, [0.0, 0.03, 0.05], stateful).collect()}
    assert len(got) == 3 * 6 * 3
    still, moved = got[0.0, 5, "full_face_inner"], got[0.05, 5, "full_face_inner"]
    assert still.roi_shift_x_px == 0 and moved.roi_shift_x_px > got[0.03, 5, "forehead"].roi_shift_x_px
    assert moved.roi_shift_x_px == pytest.approx(0.05 * moved.face_width_px) and moved.roi_shift_y_px == pytest.approx(0, abs=1e-12)
    assert all(0 < got[0.05, 5, roi].retention_ratio < 1 for roi in faces.ROIS) and moved.r > still.r


def test_each_recording_gets_its_own_detector(spark, tmp_path):
    for name in ("a", "b"):
        (tmp_path / f"{name}.avi").write_bytes(avi([np.zeros((100, 100, 3), np.uint8)] * 5))
    files = spark.createDataFrame([(n, f"{tmp_path}/{n}.avi") for n in "ab"], "subject string, video_path string")
    got = faces.video_traces(video.ranges(files, frames_per_range=2).repartition(1), lambda: Scripted(absent=(0, 3)), [0.0]).filter("roi = 'forehead'").collect()
    assert {(r.subject, r.frame_idx) for r in got if not r.landmark_valid} == {(s, i) for s in "ab" for i in (0, 3)}


def test_detectors_are_closed_and_frames_in_order():
    made = []

    class Closing(Scripted):
        closed = False

        def close(self):
            self.closed = True

    def make():
        made.append(Closing())
        return made[-1]

    shown = np.zeros((2, 4, 4, 3), np.uint8)
    assert len(list(landmarks.tracked(iter([(("a",), 0, 10.0, shown), (("a",), 2, 10.0, shown), (("b",), 0, 10.0, shown)]), make))) == 3
    assert [(d.closed, d.seen, d.stamps) for d in made] == [(True, 4, [0, 100, 200, 300]), (True, 2, [0, 100])]
    with pytest.raises(ValueError, match="comes after"):
        list(landmarks.tracked(iter([(("a",), 2, 10.0, shown), (("a",), 0, 10.0, shown)]), make))
    assert made[-1].closed


def test_face_mesh_options(monkeypatch):
    with pytest.raises(RuntimeError, match="mediapipe"):
        landmarks.FaceMesh("model.task")()
    seen = {}
    said = lambda **kw: types.SimpleNamespace(**kw)
    result = said(face_landmarks=[[said(x=0.25, y=0.5)]])
    model = said(detect_for_video=lambda image, ms: result if ms else said(face_landmarks=[]), close=lambda: seen.setdefault("closed", True))
    base = type("BaseOptions", (), {"Delegate": said(CPU="cpu"), "__init__": lambda self, **kw: seen.update(kw)})
    vision = said(FaceLandmarkerOptions=lambda **kw: seen.update(kw), RunningMode=said(VIDEO="video"), FaceLandmarker=said(create_from_options=lambda options: model))
    python = types.ModuleType("mediapipe.tasks.python")
    python.BaseOptions, python.vision = base, vision
    top = types.ModuleType("mediapipe")
    top.Image, top.ImageFormat = lambda **kw: kw, said(SRGB="srgb")
    for name, module in (("mediapipe", top), ("mediapipe.tasks", types.ModuleType("mediapipe.tasks")), ("mediapipe.tasks.python", python)):
        monkeypatch.setitem(sys.modules, name, module)
    mesh = landmarks.FaceMesh("model.task")()
    assert (seen["delegate"], seen["running_mode"], seen["num_faces"], seen["model_asset_path"]) == ("cpu", "video", 1, "model.task")
    assert {seen[f"min_{k}_confidence"] for k in ("face_detection", "face_presence", "tracking")} == {0.5}
    assert mesh.detect(np.zeros((2, 2, 3), np.uint8), 0) is None and mesh.detect(np.zeros((2, 2, 3), np.uint8), 10).tolist() == [[0.25, 0.5]]
    mesh.close()
    assert seen["closed"]


SMALL = Size(30, 40)


def dense(r, frames, size=SMALL):
    out = np.zeros((frames * size.height, size.width), bool)
    for line, a, b in zip(*r.lines(size), strict=True):
        out[line, a:b] = True
    return out.reshape(frames, *size)


def line_pixels(a, b):
    """One pixel for each step along the longer axis, from the left end, halves staying with it."""
    (x0, y0), (x1, y1) = sorted((a, b)) if a[0] != b[0] else (a, b)
    n = max(abs(x1 - x0), abs(y1 - y0))
    part = lambda d, k: math.ceil(Fraction(k * abs(d), n) - Fraction(1, 2)) * (1 if d > 0 else -1) if n else 0
    return {(x0 + part(x1 - x0, k), y0 + part(y1 - y0, k)) for k in range(n + 1)}


def drawn(points, size=SMALL):
    """A polygon by a test of every pixel: its middle is inside or on the border, or it is a pixel of an edge."""
    out = np.zeros(size, bool)
    edges = list(zip(points, points[1:] + points[:1]))
    for y in range(size.height):
        cross = sorted(Fraction(a[0]) + Fraction((y - a[1]) * (b[0] - a[0]), b[1] - a[1]) for a, b in edges if min(a[1], b[1]) <= y < max(a[1], b[1]))
        for left, right in zip(cross[::2], cross[1::2]):
            out[y, [x for x in range(size.width) if left <= x <= right]] = True
    for x, y in set().union(*(line_pixels(a, b) for a, b in edges)):
        out[y, x] = True
    return out


def corners(rng, n, frames=3):
    return np.stack([rng.integers(0, SMALL.width, (frames, n)), rng.integers(0, SMALL.height, (frames, n))], 2)


def test_polygons_equal_a_test_of_every_pixel():
    rng = np.random.default_rng(1)
    for _ in range(40):
        p = corners(rng, rng.integers(1, 9))
        got = dense(runs.filled(p, SMALL), 3)
        for f in range(3):
            assert (got[f] == drawn([tuple(map(int, q)) for q in p[f]])).all(), p[f]


def hull_of(points):
    """Corners of the hull in order, by turning round the middle."""
    sides = {(a, b) for a in points for b in points if a != b and all((b[0] - a[0]) * (c[1] - a[1]) >= (b[1] - a[1]) * (c[0] - a[0]) for c in points)}
    corner = sorted({p for s in sides for p in s} or set(points))
    mx, my = (sum(Fraction(p[k]) for p in corner) / len(corner) for k in (0, 1))
    return sorted(corner, key=lambda p: math.atan2(p[1] - my, p[0] - mx))


def test_hulls_equal_a_test_of_every_pixel_but_for_halves():
    rng = np.random.default_rng(2)
    for _ in range(40):
        p = corners(rng, rng.integers(1, 9))
        got = dense(runs.convex(p, SMALL), 3)
        for f in range(3):
            points = [tuple(map(int, q)) for q in p[f]]
            hull = hull_of(points)
            want = drawn(hull)
            assert not (want & ~got[f]).any(), points
            for y, x in zip(*np.nonzero(got[f] & ~want)):  # filled up to where an edge crosses the line at a half
                assert any(a[1] != b[1] and min(a[1], b[1]) <= y <= max(a[1], b[1]) and abs(Fraction(a[0]) + Fraction(int(y - a[1]) * (b[0] - a[0]), b[1] - a[1]) - int(x)) <= Fraction(1, 2) for a, b in zip(hull, hull[1:] + hull[:1])), (points, x, y)


def masks(rng, share, frames=2):
    m = rng.random((frames, *SMALL)) < share
    line, x = np.nonzero(m.reshape(-1, SMALL.width))
    at = line * (SMALL.width + 1) + x
    return m, runs.merged(at, at + 1)


def test_run_algebra_equals_masks():
    rng = np.random.default_rng(3)
    for _ in range(20):
        (a, ra), (b, rb) = masks(rng, 0.3), masks(rng, 0.1)
        for got, want in ((runs.both(ra, rb), a & b), (runs.either(ra, rb), a | b), (runs.without(ra, rb), a & ~b)):
            assert (dense(got, 2) == want).all() and (runs.counted(got, 2, SMALL) == want.sum((1, 2))).all()
        wide = np.zeros_like(b)
        for dy, reach in runs.ellipse(13):
            for dx in range(-reach, reach + 1):
                f, y, x = np.nonzero(b)
                y, x = y + dy, x + dx
                ok = (y >= 0) & (y < SMALL.height) & (x >= 0) & (x < SMALL.width)
                wide[f[ok], y[ok], x[ok]] = True
        assert (dense(runs.dilated(rb, runs.ellipse(13), SMALL), 2) == wide).all()
        dx, dy = rng.integers(-9, 9, 2), rng.integers(-9, 9, 2)
        there = np.zeros_like(a)
        for f in range(2):
            y, x = np.nonzero(a[f])
            y, x = y + dy[f], x + dx[f]
            ok = (y >= 0) & (y < SMALL.height) & (x >= 0) & (x < SMALL.width)
            there[f, y[ok], x[ok]] = True
        assert (dense(runs.moved(ra, dx, dy, SMALL), 2) == there).all()
        raster = rng.integers(0, 256, (2, *SMALL, 3)).astype(np.uint8)
        got = runs.sums(ra, runs.prefix_sums(raster, 250))
        assert (got == [[*raster[f][a[f]].sum(0), (raster[f][a[f]] >= 250).any(1).sum()] for f in range(2)]).all()
    assert [reach for _, reach in runs.ellipse(13)] == [0, 3, 4, 5, 6, 6, 6, 6, 6, 5, 4, 3, 0]


def test_three_regions_of_a_face():
    size = Size(100, 100)
    points = face_points()[None]
    got = regions.face_regions(np.concatenate((points, points + 3)), size)
    assert tuple(got) == faces.ROIS
    whole = lambda ids, p=points[0]: [tuple(map(int, q)) for q in np.rint(p[list(ids)])]
    oval = points[0][list(regions.FACE_OVAL)]
    inner = drawn([tuple(map(int, q)) for q in np.rint(oval.mean(0) + 0.82 * (oval - oval.mean(0)))], size)
    hidden = np.zeros(size, bool)
    for ids in (regions.RIGHT_EYE, regions.LEFT_EYE, regions.MOUTH):
        y, x = np.nonzero(drawn(hull_of(whole(ids)), size))
        for dy, reach in runs.ellipse(13):
            for dx in range(-reach, reach + 1):
                hidden[y + dy, x + dx] = True
    face = inner & ~hidden
    cheeks = drawn(hull_of(whole(regions.LEFT_CHEEK)), size) | drawn(hull_of(whole(regions.RIGHT_CHEEK)), size)
    for roi, want in (("full_face_inner", face), ("forehead", drawn(hull_of(whole(regions.FOREHEAD)), size) & face), ("cheeks_mean", cheeks & face)):
        m = dense(got[roi], 2, size)
        assert want.sum() > 50 and (m[0] != want).sum() <= 8, roi  # pixels at halves of a hull's edges
        assert m[1].sum() > 50


def test_offsets_in_1024ths():
    assert regions.whole_offset(np.array([2.4, -1.4, 0.5, -0.5, 0.0, 1.5, 0.4999, 0.501])).tolist() == [2, -1, 0, -1, 0, 1, 0, 1]


def test_scan_is_dealt_and_kept_in_order(spark, tmp_path):
    (tmp_path / "a.avi").write_bytes(avi([np.zeros((2, 2, 3), np.uint8)] * 40))
    found = video.ranges(spark.createDataFrame([("s", f"{tmp_path}/a.avi")], "subject string, video_path string"), frames_per_range=2)
    assert video.spread_out(found, 4).select(F.spark_partition_id()).distinct().count() > 1
    (one,) = video.in_order(found, 4).groupBy(F.spark_partition_id().alias("p")).agg(F.collect_list("first_frame").alias("x")).collect()
    assert one.x == list(range(0, 40, 2))


def dataset(folder, subjects=("subject1",), frames=300, bpm=72.0):
    """Folders of recordings: a face whose colour beats, and contact samples of the same pulse."""
    t = np.arange(frames) / 30
    beat = np.sin(2 * math.pi * bpm / 60 * t)
    for s in subjects:
        (folder / s).mkdir(parents=True)
        noise = np.random.default_rng(1).integers(-4, 5, (100, 100, 3))  # so that means are finer than one level
        shown = [np.clip(np.array((180, 140, 120)) * (1 + np.array((0.003, 0.010, 0.005)) * b * 3) + noise, 0, 255).round().astype(np.uint8) for b in beat]
        (folder / s / "vid.avi").write_bytes(avi(shown, fps=30, index="super"))
        lines = (beat, np.full(frames, bpm), t)
        (folder / s / "ground_truth.txt").write_text("\n".join(" ".join(repr(float(v)) for v in line) for line in lines))


def test_folder_to_manifest_with_nothing_by_hand(spark, tmp_path):
    dataset(tmp_path / "data")
    (tmp_path / "model").write_bytes(b"model")
    got = jobs.baseline_from_folders(spark, str(tmp_path / "data"), Scripted, str(tmp_path / "base"))
    assert got == {"subjects": 1, "reference_windows": 1, "candidates": 6}
    done = jobs.formal_run_from_folders(spark, str(tmp_path / "data"), str(tmp_path / "model"), str(tmp_path / "base"), None, str(tmp_path / "out"), 1, 1, Scripted)
    assert done["status"] == "completed" and done["summary"]["candidate_count"] == 30 and done["summary"]["condition_audit_count"] == 15 and done["summary"]["candidate_status_counts"] == {"ok": 30}
    found = spark.read.parquet(f"{tmp_path}/out/degradation_candidates.parquet")
    assert found.filter("condition = 'original' and absolute_error_bpm < 1").count() == 6
    audit = {(r.condition, r.roi): r for r in spark.read.option("header", True).option("inferSchema", True).csv(f"{tmp_path}/out/condition_audit.csv").collect()}
    assert audit["fps10", "forehead"].retained_frame_count == 100 and audit["roi_shift_3", "forehead"].max_roi_shift_fraction == pytest.approx(0.03, abs=1e-3)
    assert 0 < audit["roi_shift_5", "cheeks_mean"].min_roi_retention_ratio < 1 and audit["original", "forehead"].mean_roi_retention_ratio == 1
    assert sorted(p.name for p in tmp_path.iterdir()) == ["base", "data", "model", "out"]  # no staging is left
    with pytest.raises(ContractError, match="no .such. subjects"):
        jobs.baseline_from_folders(spark, str(tmp_path / "data"), Scripted, str(tmp_path / "none"), ["subject9"])


def test_a_failed_second_write_publishes_no_table(spark, tmp_path, monkeypatch):
    dataset(tmp_path / "data")
    (tmp_path / "model").write_bytes(b"model")
    jobs.baseline_from_folders(spark, str(tmp_path / "data"), Scripted, str(tmp_path / "base"))

    def broken(df, path):
        raise OSError("disk full")

    monkeypatch.setattr(jobs.sinks, "write_csv", broken)
    with pytest.raises(OSError, match="disk full"):
        jobs.formal_run_from_folders(spark, str(tmp_path / "data"), str(tmp_path / "model"), str(tmp_path / "base"), None, str(tmp_path / "out"), 1, 1, Scripted)
    assert [p.name for p in (tmp_path / "out").iterdir() if not p.name.startswith(".")] == ["run_manifest.json"] and not list(tmp_path.glob("*.staging"))
    said = sinks.read_json(spark, f"{tmp_path}/out/run_manifest.json")
    assert said["status"] == "failed" and said["output_files"] == {} and "disk full" in said["error"]["message"]


def test_files_are_hashed_in_pieces(spark, tmp_path, monkeypatch):
    (tmp_path / "a" / "b").mkdir(parents=True)
    for name, data in (("a/x", b"x" * 20_000_001), ("a/b/y", b""), ("a/z z", b"z")):
        (tmp_path / name).write_bytes(data)
    got = {r.path.rsplit("/", 1)[1]: (r.length, r.sha256) for r in tables.file_sha256(spark, f"{tmp_path}/a").collect()}
    assert {k.replace("%20", " "): v for k, v in got.items()} == {n: (len(d), hashlib.sha256(d).hexdigest()) for n, d in (("x", b"x" * 20_000_001), ("y", b""), ("z z", b"z"))}


def test_revision_is_read_from_the_repository(tmp_path):
    assert provenance.revision(tmp_path) == {"branch": None, "commit": None}
    git = tmp_path / ".git"
    (git / "refs" / "heads").mkdir(parents=True)
    (git / "HEAD").write_text("ref: refs/heads/main\n")
    (git / "packed-refs").write_text("# pack-refs\nabc refs/heads/main\n")
    (tmp_path / "src").mkdir()
    assert provenance.revision(tmp_path / "src") == {"branch": "main", "commit": "abc"}
    (git / "refs" / "heads" / "main").write_text("def\n")
    assert provenance.revision(tmp_path) == {"branch": "main", "commit": "def"}
    (git / "HEAD").write_text("123\n")
    assert provenance.revision(tmp_path) == {"branch": "HEAD", "commit": "123"}
