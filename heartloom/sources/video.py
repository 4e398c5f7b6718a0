"""Video scan: uncompressed frames of RIFF/AVI files by byte ranges.

``ranges`` reads headers and frame indexes in tasks (some kilobytes a file, whatever the file's size) and gives a row for
each run of frames with their places in the file; ``frames`` and the face stage read those places. So a long recording
is spread over tasks, files above 2 GB are never one value, and a frame cap costs nothing beyond it. Paths are opened by
pyarrow's file systems: local paths and the URIs that they know.

Frames must be uncompressed (RGB of 24 or 32 bits); any other codec is an error, for its decoder is not part of this
library. A file is indexed by its OpenDML super index, else by its ``idx1`` chunk, else by a walk over its chunks' heads.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from typing import BinaryIO, NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heartloom.sources.files import open_file

#: Frames of one range: what a task reads at a time is some of them, never all.
RANGE = 256
#: Bytes of frames that are held at a time.
HELD = 16 << 20
RANGES = "subject string, video_path string, width int, height int, fps double, bits int, top_down boolean, first_frame long, places array<long>"


class Header(NamedTuple):
    width: int
    height: int
    fps: float
    bits: int
    top_down: bool
    codec: str
    super_index: list[int]
    movies: list[tuple[int, int]]  # of each list of frames: its first byte after the list's name, and its end
    old_index: tuple[int, int] | None


def _read(f: BinaryIO, at: int, n: int) -> bytes:
    f.seek(at)
    return f.read(n)


def chunks(f: BinaryIO, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(name, first byte, size) of the chunks from at to end. Only their heads are read; a chunk that is cut off ends the walk."""
    while at + 8 <= end:
        head = _read(f, at, 8)
        if len(head) < 8:
            return
        name, size = head[:4], int.from_bytes(head[4:], "little")
        yield name, at + 8, size
        at += 8 + size + size % 2


def read_header(f: BinaryIO) -> Header:
    f.seek(0, 2)
    length = f.tell()
    if _read(f, 0, 4) != b"RIFF" or _read(f, 8, 4) != b"AVI ":
        raise ValueError("not a RIFF/AVI file")
    video: dict = {}
    movies, old = [], None
    for name, at, size in chunks(f, 0, length):
        if name != b"RIFF":
            continue
        for inner, start, n in chunks(f, at + 4, min(at + size, length)):
            if inner == b"LIST" and _read(f, start, 4) == b"movi":
                movies.append((start + 4, min(start + n, length)))
            elif inner == b"LIST" and _read(f, start, 4) == b"hdrl" and not video:
                video = _video_stream(f, start + 4, start + n)
            elif inner == b"idx1" and old is None:
                old = (start, n)
    if not video:
        raise ValueError("no video stream")
    return Header(**video, movies=movies, old_index=old)


def _video_stream(f: BinaryIO, at: int, end: int) -> dict:
    """The first video stream of a header list."""
    for name, start, n in chunks(f, at, end):
        if name != b"LIST" or _read(f, start, 4) != b"strl":
            continue
        parts = {inner: (s, m) for inner, s, m in chunks(f, start + 4, start + n)}
        if b"strh" not in parts or b"strf" not in parts or _read(f, parts[b"strh"][0], 4) != b"vids":
            continue
        scale, rate = struct.unpack("<II", _read(f, parts[b"strh"][0] + 20, 8))
        _, width, height, _, bits, codec = struct.unpack("<IiiHH4s", _read(f, parts[b"strf"][0], 20))
        if not scale or not rate:
            raise ValueError("the video stream has no frame rate")
        index = []
        if b"indx" in parts:
            s, m = parts[b"indx"]
            per, kind, used = struct.unpack("<HxBI", _read(f, s, 8))
            if kind == 0 and per == 4:
                index = [struct.unpack_from("<Q", _read(f, s + 24 + 16 * i, 8))[0] for i in range(min(used, (m - 24) // 16))]
        return {"width": width, "height": abs(height), "fps": rate / scale, "bits": bits, "top_down": height < 0, "codec": "" if codec == bytes(4) else codec.decode("latin1"), "super_index": index}
    return {}


def _is_frame(name: bytes) -> bool:
    return name[:2].isdigit() and name[2:] in (b"db", b"dc")


def places(f: BinaryIO, h: Header) -> Iterator[np.ndarray]:
    """First bytes of the frames in order, some at a time; 0 stands for an empty frame, which repeats the one before."""
    if h.super_index:
        for at in h.super_index:
            head = _read(f, at, 32)
            used, base = struct.unpack("<I", head[12:16])[0], struct.unpack("<Q", head[20:28])[0]
            for k in range(0, used, 65536):
                rows = np.frombuffer(_read(f, at + 32 + 8 * k, 8 * min(65536, used - k)), "<u4").reshape(-1, 2).astype(np.int64)
                yield np.where(rows[:, 1] & 0x7FFFFFFF, rows[:, 0] + base, 0)
    elif h.old_index:
        at, n = h.old_index
        base = None
        for k in range(0, n, 16 * 65536):
            rows = np.frombuffer(_read(f, at + k, min(16 * 65536, n - k)), "<u4")
            rows = rows[: len(rows) // 4 * 4].reshape(-1, 4)
            names = np.ascontiguousarray(rows[:, 0]).view("S1").reshape(-1, 4)
            frame = np.isin(names[:, 2], [b"d"]) & np.isin(names[:, 3], [b"b", b"c"])
            rows = rows[frame].astype(np.int64)
            if base is None and len(rows):  # offsets count from the list's name, or from the file's start
                base = h.movies[0][0] - 4 if not _is_frame(_read(f, int(rows[0, 2]), 4)) else 0
            if len(rows):
                yield np.where(rows[:, 3] > 0, rows[:, 2] + base + 8, 0)
    else:
        for start, end in h.movies:
            for name, at, size in chunks(f, start, end):
                if name == b"LIST":  # frames in records
                    inner = [a if s else 0 for x, a, s in chunks(f, at + 4, at + size) if _is_frame(x)]
                    yield np.array(inner, np.int64)
                elif _is_frame(name):
                    yield np.array([at if size else 0], np.int64)


def ranges(files: DataFrame, max_frames: int | None = None, frames_per_range: int = RANGE) -> DataFrame:
    """Ranges of frames (columns RANGES) of files (subject, video_path); at most max_frames of each file.

    A file without frames gives no rows. One that is missing, cut short in its header, or compressed raises.
    """
    names = [c.split()[0] for c in RANGES.split(", ")]
    types = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.float64(), pa.int32(), pa.bool_(), pa.int64(), pa.list_(pa.int64())]

    def of_file(subject: str, path: str) -> Iterator[tuple]:
        with open_file(path) as f:
            h = read_header(f)
            if h.codec or h.bits not in (24, 32):
                raise ValueError(f"{path}: codec {h.codec or 'raw'} of {h.bits} bits is not supported, only uncompressed frames of 24 or 32 bits")
            first, last, held = 0, 0, np.empty(0, np.int64)
            for part in places(f, h):
                for i in np.flatnonzero(part == 0):  # an empty frame shows the last one again
                    part[i] = part[i - 1] if i else last
                held = np.concatenate((held, part))
                last = int(held[-1]) if len(held) else last
                if max_frames is not None:
                    held = held[: max(0, max_frames - first)]
                while len(held) >= frames_per_range:
                    yield (subject, path, h.width, h.height, h.fps, h.bits, h.top_down, first, held[:frames_per_range])
                    first, held = first + frames_per_range, held[frames_per_range:]
                if max_frames is not None and first + len(held) >= max_frames:
                    break
            if len(held):
                yield (subject, path, h.width, h.height, h.fps, h.bits, h.top_down, first, held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for subject, path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for row in of_file(subject, path):
                    yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], names)

    return files.select("subject", "video_path").mapInArrow(run, RANGES)


def rasters(path: str, width: int, height: int, bits: int, top_down: bool, at: list[int]) -> Iterator[np.ndarray]:
    """Frames (n x height x width x r, g, b) at the places of a range, as many at a time as HELD bytes allow."""
    line = -(-width * bits // 32) * 4
    n = max(1, HELD // max(1, line * height))
    with open_file(path) as f:
        for k in range(0, len(at), n):
            data = [_read(f, int(a), line * height) for a in at[k : k + n]]
            if any(len(d) < line * height for d in data):
                raise ValueError(f"{path}: a frame is cut off")
            rows = np.frombuffer(b"".join(data), np.uint8).reshape(len(data), height, line)[:, :, : width * bits // 8]
            shown = rows.reshape(len(data), height, width, bits // 8)[..., 2::-1]  # blue comes first
            yield shown if top_down else shown[:, ::-1]


def frames(found: DataFrame) -> DataFrame:
    """(subject, frame_idx, time_sec, width, height, raster) of ranges; raster holds r, g, b of each pixel, line by line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                index = r["first_frame"]
                for x in rasters(r["video_path"], r["width"], r["height"], r["bits"], r["top_down"], r["places"]):
                    i = index + np.arange(len(x))
                    cols = [pa.array([r["subject"]] * len(x)), pa.array(i), pa.array(i / r["fps"]), pa.array([r["width"]] * len(x), pa.int32()), pa.array([r["height"]] * len(x), pa.int32()), pa.array([np.ascontiguousarray(f).tobytes() for f in x], pa.binary())]
                    yield pa.RecordBatch.from_arrays(cols, ["subject", "frame_idx", "time_sec", "width", "height", "raster"])
                    index += len(x)

    return found.mapInArrow(run, "subject string, frame_idx long, time_sec double, width int, height int, raster binary")


def spread_out(found: DataFrame, tasks: int | None = None) -> DataFrame:
    """Ranges dealt over tasks, whatever recording they are of; they are a few kilobytes each."""
    n = tasks or int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return found.repartition(n, "subject", "first_frame")


def in_order(found: DataFrame, tasks: int | None = None) -> DataFrame:
    """Ranges with all of a recording in one task and in order, for stages that carry a state along it.

    Only places are shuffled and sorted; frames are read by the task that needs them, some at a time.
    """
    n = tasks or int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return found.repartition(n, "subject").sortWithinPartitions("subject", F.col("video_path"), "first_frame")
