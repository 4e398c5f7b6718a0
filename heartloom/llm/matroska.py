"""Matroska media columns: packet tables with timestamps, tracks and byte ranges from EBML files.

``parse`` reads variable-length elements, clusters of known or unknown size, simple and grouped blocks, all three
lacings and cues. ``mux`` writes 8-bit PCM files, so any bytes can be stored as samples and read back.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Element ids of the format. Fixed values.
EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
SCALE, DURATION, DOCTYPE = 0x2AD7B1, 0x4489, 0x4282
TRACK, NUMBER, TYPE, CODEC, AUDIO, RATE, CHANNELS, DEPTH, FRAME_NS = 0xAE, 0xD7, 0x83, 0x86, 0xE1, 0xB5, 0x9F, 0x6264, 0x23E383
TIMESTAMP, SIMPLE, GROUP, BLOCK, REFERENCE = 0xE7, 0xA3, 0xA0, 0xA1, 0xFB
POINT, CUE_TIME, POSITIONS, CUE_TRACK, CUE_CLUSTER = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
TOP = {INFO, TRACKS, CLUSTER, CUES, 0x114D9B74, 0x1043A770, 0x1941A469, 0x1254C367}


@dataclass
class Media:
    doctype: str = ""
    scale: int = 1_000_000
    duration: float | None = None
    tracks: dict[int, dict] = field(default_factory=dict)
    #: (track, timestamp in ns, keyframe, offset, size, cluster, number within its block, frames of its block)
    packets: list[tuple] = field(default_factory=list)
    #: (time in ns, track, offset of the cluster)
    cues: list[tuple] = field(default_factory=list)
    clusters: list[int] = field(default_factory=list)


def _id(b: bytes, at: int) -> tuple[int, int]:
    first = b[at] if at < len(b) else 0
    width = 9 - first.bit_length()
    if not 1 <= width <= 4 or at + width > len(b):
        raise ValueError(f"no element id at byte {at}")
    return int.from_bytes(b[at : at + width], "big"), at + width


def _size(b: bytes, at: int) -> tuple[int | None, int]:
    """A size and the place after it; None for an unknown size."""
    first = b[at] if at < len(b) else 0
    width = 9 - first.bit_length()
    if width > 8 or at + width > len(b):
        raise ValueError(f"no size at byte {at}")
    value = int.from_bytes(b[at : at + width], "big") & ((1 << (7 * width)) - 1)
    return (None if value == (1 << (7 * width)) - 1 else value), at + width


def _children(b: bytes, at: int, end: int) -> Iterator[tuple[int, int, int]]:
    """(id, start, end) of the elements in a range; one of unknown size ends at the next of its level or above."""
    while at < end:
        kind, start = _id(b, at)
        size, start = _size(b, start)
        if size is None:
            stop = start
            while stop < end:
                k, s = _id(b, stop)
                if k in TOP and kind == CLUSTER or k in (EBML, SEGMENT):
                    break
                n, s = _size(b, s)
                stop = end if n is None else s + n
            stop = min(stop, end)
        else:
            stop = start + size
            if stop > end:
                raise ValueError(f"element {kind:x} at byte {at} runs over the end")
        yield kind, start, stop
        at = stop


def _uint(b: bytes, s: int, e: int) -> int:
    return int.from_bytes(b[s:e], "big")


def _float(b: bytes, s: int, e: int) -> float:
    return {0: lambda: 0.0, 4: lambda: struct.unpack(">f", b[s:e])[0], 8: lambda: struct.unpack(">d", b[s:e])[0]}[e - s]()


def _frames(b: bytes, s: int, e: int) -> tuple[int, int, int, list[tuple[int, int]]]:
    """Track, relative time, flags, and the (offset, size) of each frame of a block."""
    track, at = _size(b, s)
    if track is None or at + 3 > e:
        raise ValueError(f"short block at byte {s}")
    time, flags = struct.unpack(">hB", b[at : at + 3])
    at += 3
    lacing = flags & 6
    if not lacing:
        return track, time, flags, [(at, e - at)]
    n, at = b[at] + 1, at + 1
    sizes: list[int] = []
    if lacing == 2:  # Xiph: sums of bytes, each but the last 255
        for _ in range(n - 1):
            size = 0
            while (x := b[at]) == 255:
                size, at = size + 255, at + 1
            sizes.append(size + x)
            at += 1
    elif lacing == 6:  # EBML: the first size, then signed differences
        for k in range(n - 1):
            value, after = _size(b, at)
            width = after - at
            value = (1 << (7 * width)) - 1 if value is None else value
            sizes.append(value if k == 0 else sizes[-1] + value - ((1 << (7 * width - 1)) - 1))
            at = after
    else:
        if (e - at) % n:
            raise ValueError(f"uneven fixed lacing at byte {s}")
        sizes = [(e - at) // n] * (n - 1)
    sizes.append(e - at - sum(sizes))
    if min(sizes) < 0:
        raise ValueError(f"lace sizes run over the block at byte {s}")
    starts = np.concatenate(([at], at + np.cumsum(sizes)[:-1])).tolist()
    return track, time, flags, list(zip(starts, sizes, strict=True))


def parse(b: bytes) -> Media:
    m = Media()
    for kind, s, e in _children(b, 0, len(b)):
        if kind == EBML:
            m.doctype = next((b[x:y].rstrip(b"\0").decode("ascii", "replace") for k, x, y in _children(b, s, e) if k == DOCTYPE), "")
        elif kind == SEGMENT:
            _segment(b, s, e, m)
    if not m.doctype:
        raise ValueError("no EBML header")
    return m


def _segment(b: bytes, base: int, end: int, m: Media) -> None:
    for kind, s, e in _children(b, base, end):
        if kind == INFO:
            for k, x, y in _children(b, s, e):
                if k == SCALE:
                    m.scale = _uint(b, x, y)
                elif k == DURATION:
                    m.duration = _float(b, x, y)
        elif kind == TRACKS:
            for k, x, y in _children(b, s, e):
                if k == TRACK:
                    _track(b, x, y, m)
        elif kind == CLUSTER:
            _cluster(b, s, e, m)
        elif kind == CUES:
            for k, x, y in _children(b, s, e):
                if k == POINT:
                    time = 0
                    for k2, x2, y2 in _children(b, x, y):
                        if k2 == CUE_TIME:
                            time = _uint(b, x2, y2)
                        elif k2 == POSITIONS:
                            got = {k3: _uint(b, x3, y3) for k3, x3, y3 in _children(b, x2, y2)}
                            m.cues.append((time * m.scale, got.get(CUE_TRACK, 0), base + got.get(CUE_CLUSTER, 0)))


def _track(b: bytes, s: int, e: int, m: Media) -> None:
    t: dict = {"type": 0, "codec": "", "rate": 8000.0, "channels": 1, "depth": None, "frame_ns": None}
    number = 0
    for k, x, y in _children(b, s, e):
        if k == NUMBER:
            number = _uint(b, x, y)
        elif k == TYPE:
            t["type"] = _uint(b, x, y)
        elif k == CODEC:
            t["codec"] = b[x:y].decode("ascii", "replace")
        elif k == FRAME_NS:
            t["frame_ns"] = _uint(b, x, y)
        elif k == AUDIO:
            for k2, x2, y2 in _children(b, x, y):
                if k2 == RATE:
                    t["rate"] = _float(b, x2, y2)
                elif k2 in (CHANNELS, DEPTH):
                    t["channels" if k2 == CHANNELS else "depth"] = _uint(b, x2, y2)
    m.tracks[number] = t


def _cluster(b: bytes, s: int, e: int, m: Media) -> None:
    time, cluster = 0, len(m.clusters)
    m.clusters.append(s)
    for k, x, y in _children(b, s, e):
        if k == TIMESTAMP:
            time = _uint(b, x, y)
        elif k in (SIMPLE, GROUP):
            key = True
            if k == GROUP:
                inner = list(_children(b, x, y))
                key = all(i != REFERENCE for i, _, _ in inner)
                x, y = next(((p, q) for i, p, q in inner if i == BLOCK), (x, x))
            track, rel, flags, frames = _frames(b, x, y)
            start = (time + rel) * m.scale
            step = _frame_ns(m, track, frames)
            for i, (at, size) in enumerate(frames):
                m.packets.append((track, start + step[i], key if k == GROUP else bool(flags & 0x80), at, size, cluster, i, len(frames)))


def _frame_ns(m: Media, track: int, frames: list[tuple[int, int]]) -> list[int]:
    """When each frame of a lace begins, after its block: by the track's frame time, or by the length of PCM frames."""
    t = m.tracks.get(track, {})
    if t.get("frame_ns"):
        return [i * t["frame_ns"] for i in range(len(frames))]
    if t.get("codec", "").startswith("A_PCM") and t.get("depth") and t.get("rate"):
        width = max(1, t["depth"] // 8 * t["channels"])
        before = np.concatenate(([0], np.cumsum([n for _, n in frames])[:-1]))
        return [int(x // width * 1e9 / t["rate"]) for x in before]
    return [0] * len(frames)


def _vint(n: int, width: int | None = None) -> bytes:
    width = width or next(w for w in range(1, 9) if n < (1 << (7 * w)) - 1)
    return (n | 1 << (7 * width)).to_bytes(width, "big")


def _element(kind: int, body: bytes) -> bytes:
    return kind.to_bytes((kind.bit_length() + 7) // 8, "big") + _vint(len(body)) + body


def _number(kind: int, n: int) -> bytes:
    return _element(kind, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def _lace(frames: list[bytes], lacing: str) -> tuple[int, bytes]:
    """The lacing flag and the head of a block's frames."""
    if len(frames) == 1:
        return 0, b""
    sizes = [len(f) for f in frames]
    n = bytes([len(frames) - 1])
    if lacing == "fixed" or lacing == "auto" and len(set(sizes)) == 1:
        return 4, n
    if lacing == "xiph":
        return 2, n + b"".join(b"\xff" * (s // 255) + bytes([s % 255]) for s in sizes[:-1])
    out = n + _vint(sizes[0])
    for a, b in zip(sizes[:-2], sizes[1:-1], strict=True):
        width = next(w for w in range(1, 9) if abs(b - a) <= (1 << (7 * w - 1)) - 1)
        out += _vint(b - a + (1 << (7 * width - 1)) - 1, width)
    return 6, out


def mux(samples: bytes, rate: int = 8000, frame: int = 512, laced: int = 8, blocks: int = 7, lacing: str = "auto") -> bytes:
    """A file with one PCM track of 8-bit samples. A tick is one sample of 10**9 // rate nanoseconds, so times are exact
    where the rate divides 10**9; at other rates a tick is short by less than a nanosecond."""
    head = b"".join((_number(0x4286, 1), _number(0x42F7, 1), _number(0x42F2, 4), _number(0x42F3, 8), _element(DOCTYPE, b"matroska"), _number(0x4287, 4), _number(0x4285, 2)))
    info = _number(SCALE, 1_000_000_000 // rate) + _element(DURATION, struct.pack(">d", float(len(samples)))) + _element(0x4D80, b"pcm8") + _element(0x5741, b"pcm8")
    audio = _element(RATE, struct.pack(">d", float(rate))) + _number(CHANNELS, 1) + _number(DEPTH, 8)
    track = _number(NUMBER, 1) + _number(0x73C5, 1) + _number(TYPE, 2) + _number(0x9C, 1) + _element(CODEC, b"A_PCM/INT/LIT") + _element(AUDIO, audio)
    parts = [_element(INFO, info), _element(TRACKS, _element(TRACK, track))]
    at, cues = sum(map(len, parts)), b""
    for start in range(0, len(samples), frame * laced * blocks):
        body = [_number(TIMESTAMP, start)]
        for b in range(start, min(len(samples), start + frame * laced * blocks), frame * laced):
            frames = [samples[i : min(i + frame, b + frame * laced)] for i in range(b, min(len(samples), b + frame * laced), frame)]
            flag, sizes = _lace(frames, lacing)
            body.append(_element(SIMPLE, _vint(1) + struct.pack(">hB", b - start, 0x80 | flag) + sizes + b"".join(frames)))
        cluster = _element(CLUSTER, b"".join(body))
        cues += _element(POINT, _number(CUE_TIME, start) + _element(POSITIONS, _number(CUE_TRACK, 1) + _number(CUE_CLUSTER, at)))
        parts.append(cluster)
        at += len(cluster)
    parts.append(_element(CUES, cues))
    return _element(EBML, head) + _element(SEGMENT, b"".join(parts))


PACKETS = "track long, timestamp_ns long, keyframe boolean, offset long, size long, cluster long, lace long, laced long"


def packets(files: DataFrame, key: str, media: str) -> DataFrame:
    """One row per packet of each file: the key, the packet's columns, and error.

    A file that cannot be parsed, or a null or empty one, gives one row with only the key and the error; one without
    packets a row with the key alone. Packets are emitted in slices, so a long file does not become one large batch.
    Repeated rows and equal files give equal rows, each of them; null keys stay null; extra columns are ignored, and the
    key may have any name but a packet column's; an empty table gives an empty table.
    """
    names = [x.split()[0] for x in PACKETS.split(", ")]
    types = {"long": pa.int64(), "boolean": pa.bool_()}
    kinds = [types[x.split()[1]] for x in PACKETS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, b in zip(batch.column(0), batch.column(1), strict=True):
                rows, error = [(None,) * len(names)], None
                try:
                    rows = parse(b.as_py() or b"").packets or rows
                except (ValueError, IndexError, KeyError, struct.error) as e:
                    error = str(e)
                for at in range(0, len(rows), 50_000):
                    part = rows[at : at + 50_000]
                    cols = [pa.array([r[i] for r in part], kinds[i]) for i in range(len(names))]
                    yield pa.RecordBatch.from_arrays([pa.array([k.as_py()] * len(part), batch.schema.field(0).type), *cols, pa.array([error] * len(part), pa.string())], [key, *names, "error"])

    return files.select(key, F.col(media).cast("binary").alias("media")).mapInArrow(run, f"{key} {files.schema[key].dataType.simpleString()}, {PACKETS}, error string")


def feature(m: Media, samples: bytes) -> str:
    """What the packet table and the samples read back say of a file, as text."""
    x = np.frombuffer(samples, np.uint8).astype(np.int64)
    ms = len(x) * 1000 // max(1, int(m.tracks[1]["rate"]))
    crossings = int(np.count_nonzero(np.diff((x >= 128).astype(np.int8))))
    return f"packets={len(m.packets)};clusters={len(m.clusters)};cues={len(m.cues)};laced={sum(p[7] > 1 for p in m.packets)};ms={ms};sum={int(x.sum())};energy={int(((x - 128) ** 2).sum())};crossings={crossings}"


def round_trip(docs: DataFrame) -> DataFrame:
    """One row per row of docs: the text's padded bytes stored as 8-bit samples, read back by the packets' byte ranges.

    A null or empty text is 64 zero bytes; very long texts are stored whole. Equal texts give equal values, repeated rows
    equal rows; a null doc_id stays null; extra columns are ignored, whatever their names; an empty table gives an empty
    table.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column("text").cast(pa.binary()).to_pylist():
                text = text or b""
                media = mux(text + bytes(-len(text) % 64 or (0 if text else 64)))
                m = parse(media)
                back = b"".join([media[p[3] : p[3] + p[4]] for p in m.packets])
                out.append((len(text), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature(m, back)))
            cols = list(zip(*out, strict=True)) or [[]] * 7
            types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    held = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text"))
    return held.mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
