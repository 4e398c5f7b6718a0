"""Face landmarks: the plug-in that finds them, and the stage that carries its state along a recording.

A detector belongs to one recording and sees its frames in order, so it may track a face from frame to frame. Whatever
has ``detect`` will do; a factory (any picklable callable) makes one in the task for each recording. ``FaceMesh`` is the
factory for a face-mesh model file, where the mediapipe library is installed on the executors.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any, Protocol

import numpy as np


class Detector(Protocol):
    def detect(self, rgb: np.ndarray, timestamp_ms: int) -> np.ndarray | None:
        """Landmarks (n x 2, from 0 to 1) of the frame's face, None where there is none."""


Factory = Callable[[], Detector]


@dataclass(frozen=True)
class FaceMesh:
    """Makes detectors from a model file: on the CPU, in video mode, one face, confidences of one half."""

    path: str
    confidence: float = 0.5

    def __call__(self) -> Detector:
        try:
            from mediapipe import Image, ImageFormat
            from mediapipe.tasks.python import BaseOptions
            from mediapipe.tasks.python import vision
        except ImportError as e:
            raise RuntimeError("a face-mesh model needs the mediapipe library on every executor; another detector may be given instead") from e
        sure = {f"min_{what}_confidence": self.confidence for what in ("face_detection", "face_presence", "tracking")}
        base = BaseOptions(model_asset_path=self.path, delegate=BaseOptions.Delegate.CPU)
        model = vision.FaceLandmarker.create_from_options(vision.FaceLandmarkerOptions(base_options=base, running_mode=vision.RunningMode.VIDEO, num_faces=1, **sure))
        return _Mesh(model, lambda rgb: Image(image_format=ImageFormat.SRGB, data=np.ascontiguousarray(rgb)))


class _Mesh:
    def __init__(self, model: Any, image: Callable[[np.ndarray], Any]) -> None:
        self.model, self.image = model, image

    def detect(self, rgb: np.ndarray, timestamp_ms: int) -> np.ndarray | None:
        found = self.model.detect_for_video(self.image(rgb), timestamp_ms).face_landmarks
        return np.array([(p.x, p.y) for p in found[0]], float) if found else None

    def close(self) -> None:
        self.model.close()


class Tracker:
    """One detector at a time: a new recording closes the one before and gets its own."""

    def __init__(self, make: Factory) -> None:
        self.make, self.recording, self.detector, self.next = make, None, None, 0

    def of(self, recording: tuple, first_frame: int) -> Detector:
        """The detector of a recording whose frames from first_frame on come next. Frames of one must come in order."""
        if recording != self.recording:
            self.close()
            self.recording, self.detector = recording, self.make()
        elif first_frame < self.next:
            raise ValueError(f"frame {first_frame} of {recording[0]} comes after frame {self.next - 1}")
        return self.detector

    def detect(self, rgb: np.ndarray, frame: int, fps: float) -> np.ndarray | None:
        self.next = frame + 1
        return self.detector.detect(rgb, int(frame * 1000.0 / fps))

    def close(self) -> None:
        if self.detector is not None and hasattr(self.detector, "close"):
            self.detector.close()
        self.recording = self.detector = None
        self.next = 0


def tracked(blocks: Iterator[tuple[tuple, int, float, np.ndarray]], make: Factory) -> Iterator[tuple[tuple, int, float, np.ndarray, list[np.ndarray | None]]]:
    """Blocks (recording, first frame, fps, frames) with the landmarks of their frames. The last detector is closed too."""
    tracker = Tracker(make)
    try:
        for recording, first, fps, shown in blocks:
            tracker.of(recording, first)
            yield recording, first, fps, shown, [tracker.detect(rgb, first + i, fps) for i, rgb in enumerate(shown)]
    finally:
        tracker.close()
