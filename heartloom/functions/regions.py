"""The three regions of a face from its landmarks, and their colours, for many frames at once."""

from __future__ import annotations

import numpy as np

from heartloom.functions import runs
from heartloom.functions.runs import Runs, Size

#: Landmark numbers of the face mesh. Outline, eyes, mouth, forehead and cheeks, in drawing order.
FACE_OVAL = (
    10, 338, 297, 332, 284, 251, 389, 356, 454, 323, 361, 288, 397, 365, 379, 378, 400, 377, 152, 148, 176, 149, 150, 136, 172, 58, 132, 93, 234, 127, 162, 21, 54, 103, 67, 109,
)
RIGHT_EYE = (33, 7, 163, 144, 145, 153, 154, 155, 133, 173, 157, 158, 159, 160, 161, 246)
LEFT_EYE = (263, 249, 390, 373, 374, 380, 381, 382, 362, 398, 384, 385, 386, 387, 388, 466)
MOUTH = (61, 146, 91, 181, 84, 17, 314, 405, 321, 375, 291, 409, 270, 269, 267, 0, 37, 39, 40, 185)
FOREHEAD = (103, 67, 109, 10, 338, 297, 332, 333, 299, 337, 151, 108, 69, 104)
LEFT_CHEEK = (234, 93, 132, 58, 172, 136, 150, 149, 176, 148, 123, 116, 111, 117, 118, 119, 100, 47)
RIGHT_CHEEK = (454, 323, 361, 288, 397, 365, 379, 378, 400, 377, 352, 345, 340, 346, 347, 348, 329, 277)
#: Landmarks that a detector gives for a face.
LANDMARKS = 478
#: The inner face is the outline drawn in towards its middle; eyes and mouth are widened by an ellipse. Fixed values.
INNER, ELLIPSE = 0.82, 13
#: Pixels that a region needs, the level from which a channel is overexposed, and the weights of brightness. Fixed values.
LEAST_PIXELS, OVEREXPOSED, LUMA = 50, 250.0, (0.299, 0.587, 0.114)


def pixel_landmarks(normalised: np.ndarray, size: Size) -> np.ndarray:
    """Landmarks from 0 to 1 in pixels: 1 is the last pixel's middle."""
    return normalised * [size.width - 1, size.height - 1]


def face_regions(landmarks: np.ndarray, size: Size) -> dict[str, Runs]:
    """full_face_inner, forehead and cheeks_mean of frames' landmarks (frames x 478 x 2, pixels)."""
    oval = landmarks[:, FACE_OVAL]
    middle = oval.mean(1, keepdims=True)
    inner = runs.filled(runs.whole_points(middle + INNER * (oval - middle), size), size)
    hull = lambda ids: runs.convex(runs.whole_points(landmarks[:, ids], size), size)
    hidden = runs.either(runs.either(hull(RIGHT_EYE), hull(LEFT_EYE)), hull(MOUTH))
    face = runs.without(inner, runs.dilated(hidden, runs.ellipse(ELLIPSE), size))
    return {"full_face_inner": face, "forehead": runs.both(hull(FOREHEAD), face), "cheeks_mean": runs.both(runs.either(hull(LEFT_CHEEK), hull(RIGHT_CHEEK)), face)}


def whole_offset(offset: np.ndarray) -> np.ndarray:
    """Offsets in whole pixels as a nearest-pixel shift takes them: counted in 1024ths, halves down."""
    return -np.floor_divide(np.rint(-offset.astype(np.float32).astype(np.float64) * 1024) + 512, 1024).astype(np.int64)


def colours(region: Runs, prefix: np.ndarray) -> dict[str, np.ndarray]:
    """n_pixels, r, g, b, brightness, overexposure_ratio and valid of each frame; measures are NaN below LEAST_PIXELS."""
    f, h, w, _ = prefix.shape
    n = runs.counted(region, f, Size(h, w - 1))
    enough = n >= LEAST_PIXELS
    mean = np.where(enough[:, None], runs.sums(region, prefix) / np.maximum(n, 1)[:, None], np.nan)
    return {"n_pixels": n, "r": mean[:, 0], "g": mean[:, 1], "b": mean[:, 2], "brightness": mean[:, :3] @ np.array(LUMA), "overexposure_ratio": mean[:, 3], "valid": enough}


def retained(region: Runs, other: Runs, frames: int, size: Size) -> np.ndarray:
    """The share of each frame's own pixels that the other region covers too; NaN where it has none."""
    own = runs.counted(region, frames, size)
    kept = runs.counted(runs.both(region, other), frames, size)
    return np.where(own > 0, kept / np.maximum(own, 1), np.nan)
