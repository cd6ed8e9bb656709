"""The detector of one stream: background and noise as running averages, hot pixels, blobs. NumPy only.

State is single precision, as results depend on it. A k by k ellipse's border pixels don't constrain an erosion.
"""

from __future__ import annotations

import numpy as np

from ravelin.operators.config import DetectorConfig

Box = tuple[float, float, float, float, float, int]  # x0, y0, x1, y1 (ends left out), mean rise, area


def ellipse(size: int) -> list[tuple[int, int]]:
    """Offsets (dy, dx) of a filled ellipse in a square of ``size``; size 3 is the plus sign."""
    r = size // 2
    offsets = []
    for dy in range(-r, size - r):
        reach = round(r * np.sqrt(max(0.0, 1 - (dy / r) ** 2))) if r else 0
        offsets += [(dy, dx) for dx in range(-reach, min(reach, size - r - 1) + 1)]
    return offsets


def _shifted(mask: np.ndarray, dy: int, dx: int, fill: bool) -> np.ndarray:
    h, w = mask.shape
    out = np.full_like(mask, fill)
    if abs(dy) < h and abs(dx) < w:
        out[max(0, -dy) : h - max(0, dy), max(0, -dx) : w - max(0, dx)] = mask[max(0, dy) : h + min(0, dy), max(0, dx) : w + min(0, dx)]
    return out


def erode(mask: np.ndarray, offsets: list[tuple[int, int]]) -> np.ndarray:
    return np.logical_and.reduce([_shifted(mask, dy, dx, True) for dy, dx in offsets])


def dilate(mask: np.ndarray, offsets: list[tuple[int, int]]) -> np.ndarray:
    return np.logical_or.reduce([_shifted(mask, -dy, -dx, False) for dy, dx in offsets])


def open_and_close(mask: np.ndarray, size: int) -> np.ndarray:
    """Opening, then closing; a size of 1 or less leaves the mask as it is."""
    if size <= 1:
        return mask
    ys, xs = np.nonzero(mask)
    if not len(ys):
        return mask
    # Nothing changes further away than twice the radius; one pixel more is left out of reach of the part's border.
    far = 2 * (size // 2) + 1
    part = slice(max(0, ys.min() - far), ys.max() + far + 1), slice(max(0, xs.min() - far), xs.max() + far + 1)
    own, out = ellipse(size), mask.copy()
    opened = dilate(erode(mask[part], own), own)
    out[part] = erode(dilate(opened, own), own)
    return out


def label_components(mask: np.ndarray) -> np.ndarray:
    """8-connected components: 0 outside, then 1, 2, ... by each component's first pixel in row order."""
    h, w = mask.shape
    far = h * w
    label = np.where(mask, np.arange(far).reshape(h, w), far)
    while True:
        padded = np.pad(label, 1, constant_values=far)
        least = np.minimum.reduce([padded[y : y + h, x : x + w] for y in range(3) for x in range(3)])
        least = np.where(mask, least, far)
        # A label is a pixel's place, whose own label may be lower by now.
        least = np.where(mask, np.minimum(least, np.append(least.ravel(), far)[least]), far)
        if (least == label).all():
            break
        label = least
    firsts = np.unique(label[mask])
    return np.where(mask, np.searchsorted(firsts, label) + 1, 0)


def blobs(mask: np.ndarray, delta: np.ndarray, least: int = 1, most: int | None = None) -> list[Box]:
    """Bounding box, mean rise and area of each component of ``least`` to ``most`` pixels."""
    ys, xs = np.nonzero(mask)
    if not len(ys):
        return []
    top, side = ys.min(), xs.min()
    own = label_components(mask[top : ys.max() + 1, side : xs.max() + 1])[ys - top, xs - side]
    order = np.argsort(own, kind="stable")  # a component's pixels, row by row
    ys, xs, values = ys[order], xs[order], delta[ys, xs][order]
    starts = np.flatnonzero(np.diff(own[order], prepend=0))
    areas = np.diff(np.append(starts, len(ys)))
    left, right = np.minimum.reduceat(xs, starts), np.maximum.reduceat(xs, starts)
    found = []
    for n in np.flatnonzero((areas >= least) & (areas <= (len(ys) if most is None else most))).tolist():
        low, high = int(starts[n]), int(starts[n] + areas[n])
        found.append((int(left[n]), int(ys[low]), int(right[n]) + 1, int(ys[high - 1]) + 1, float(values[low:high].mean()), high - low))
    return found


class Detector:
    """Takes a stream's frames in order."""

    def __init__(self, shape: tuple[int, int], config: DetectorConfig) -> None:
        self.config = config
        self.background: np.ndarray | None = None
        self.noise = np.ones(shape, np.float32)
        self.frames = 0
        self.least_area = max(3, int(config.min_area_frac * shape[0] * shape[1]))
        self.most_area = int(config.max_area_frac * shape[0] * shape[1])

    def step(self, frame: np.ndarray) -> list[Box]:
        c = self.config
        frame = frame.astype(np.float32)
        self.frames += 1
        if self.background is None:
            self.background = frame.copy()
        delta = frame - self.background
        level = np.maximum(np.float32(c.min_delta), np.float32(c.sigma_k) * np.minimum(self.noise, np.float32(c.sigma_cap)))
        warm = self.frames > c.warmup
        mask = open_and_close(delta > level, c.morph_kernel) if warm else np.zeros(frame.shape, bool)
        moved = ~mask if warm and c.freeze_update else np.ones(frame.shape, bool)
        self.noise = np.where(moved, self.noise + np.float32(c.noise_alpha) * (np.abs(delta) - self.noise), self.noise)
        self.background = np.where(moved, self.background + np.float32(c.bg_alpha) * delta, self.background)
        kept = [b for b in blobs(mask, delta, self.least_area, self.most_area) if b[4] >= c.min_mean_delta]
        return kept if len(kept) <= c.max_blobs else []
