"""Page images for an OCR engine: the array steps around a detector and a recogniser.

They run inside a reader's Arrow function (`seams.read_pages`), one page at a time.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np


def to_rgb(image: np.ndarray) -> np.ndarray:
    """H x W (x 1, 3 or 4) bytes to H x W x 3; alpha goes."""
    if image.dtype != np.uint8 or image.ndim not in (2, 3):
        raise ValueError(f"not a byte image: {image.dtype}, {image.shape}")
    planes = image[..., None] if image.ndim == 2 else image
    if planes.shape[2] not in (1, 3, 4):
        raise ValueError(f"{planes.shape[2]} channels")
    return np.ascontiguousarray(np.broadcast_to(planes[..., :3], (*planes.shape[:2], 3)))


def crop(image: np.ndarray, box: Sequence[float]) -> np.ndarray:
    """The pixels that a box touches, at least one."""
    height, width = image.shape[:2]
    left = min(max(math.floor(box[0]), 0), width - 1)
    top = min(max(math.floor(box[1]), 0), height - 1)
    right, bottom = max(left + 1, min(math.ceil(box[2]), width)), max(top + 1, min(math.ceil(box[3]), height))
    return image[top:bottom, left:right]


def resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Bilinear, pixel centres at halves."""

    def weights(size: int, old: int) -> np.ndarray:
        at = np.clip((np.arange(size) + 0.5) * old / size - 0.5, 0, old - 1)
        return np.maximum(0, 1 - np.abs(at[:, None] - np.arange(old)[None, :]))

    out = np.einsum("yi,xj,ij...->yx...", weights(height, image.shape[0]), weights(width, image.shape[1]), image.astype(np.float64))
    return np.clip(np.rint(out), 0, 255).astype(np.uint8) if image.dtype == np.uint8 else out.astype(image.dtype)


def unclip(box: Sequence[float], ratio: float) -> tuple[float, float, float, float]:
    """A box grown on all sides by area times ratio over its perimeter."""
    w, h = box[2] - box[0], box[3] - box[1]
    by = w * h * ratio / (2 * (w + h)) if w + h > 0 else 0.0
    return box[0] - by, box[1] - by, box[2] + by, box[3] + by


def regions(score: np.ndarray, threshold: float, most: int = 1000) -> list[tuple[tuple[int, int, int, int], float]]:
    """Boxes and mean scores of 8-connected areas over a threshold, the largest first.

    Labels spread as minima over neighbours until nothing changes.
    """
    mask = score > threshold
    label = np.where(mask, np.arange(1, mask.size + 1).reshape(mask.shape), 0)
    far = mask.size + 1
    while True:
        padded = np.pad(np.where(mask, label, far), 1, constant_values=far)
        near = np.min([padded[1 + i : padded.shape[0] - 1 + i, 1 + j : padded.shape[1] - 1 + j] for i in (-1, 0, 1) for j in (-1, 0, 1)], axis=0)
        new = np.where(mask, near, 0)
        if (new == label).all():
            break
        label = new
    found = []
    for k in np.unique(label[mask]):
        y, x = np.nonzero(label == k)
        found.append(((int(x.min()), int(y.min()), int(x.max()) + 1, int(y.max()) + 1), float(score[y, x].mean()), len(x)))
    found.sort(key=lambda r: -r[2])
    return [(b, s) for b, s, _ in found[:most]]


def charset(lines: Sequence[str], n_classes: int) -> list[str]:
    """Recogniser classes: blank, the dictionary, and a space where the model has one class more."""
    out = ["", *lines]
    if n_classes == len(out) + 1:
        out.append(" ")
    if n_classes != len(out):
        raise ValueError(f"{n_classes} classes, dictionary has {len(out)}")
    return out
