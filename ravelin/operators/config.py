"""Parameters, with the defaults that results depend on (fixed values)."""

from __future__ import annotations

from dataclasses import dataclass, fields
from typing import Any, Self


class _Named:
    @classmethod
    def of(cls, **given: Any) -> Self:
        """With some parameters changed; an unknown one is a KeyError."""
        known = {f.name for f in fields(cls)}  # type: ignore[arg-type]
        if unknown := set(given) - known:
            raise KeyError(f"unknown parameters: {', '.join(sorted(unknown))}")
        return cls(**given)


@dataclass(frozen=True)
class DetectorConfig(_Named):
    bg_alpha: float = 0.02
    noise_alpha: float = 0.01
    freeze_update: bool = True
    warmup: int = 50
    min_delta: float = 22.0
    sigma_k: float = 6.0
    sigma_cap: float = 18.0
    min_mean_delta: float = 25.0
    min_area_frac: float = 0.0002
    max_area_frac: float = 0.06
    morph_kernel: int = 3
    max_blobs: int = 12
    min_track_frames: int = 3
    min_event_delta: float = 35.0


@dataclass(frozen=True)
class TierRule:
    delta: float
    displacement: float
    speed: float
    area_frac: float


@dataclass(frozen=True)
class TrackConfig(_Named):
    merge_gap: float = 3.0
    max_dist_frac: float = 0.16
    iou_weight: float = 0.5
    max_age: int = 12
    min_hits: int = 3
    process_var: float = 4.0
    measure_var: float = 6.0
    min_track_delta: float = 35.0
    high: TierRule = TierRule(80.0, 35.0, 2.0, 0.0013)
    medium: TierRule = TierRule(60.0, 35.0, 1.0, 0.0008)
    max_edge_frac: float = 0.8
    min_median_box_frac: float = 0.001


#: Sensor models: name -> (product id, width, height).
MODELS = {"P1": (0x45C2, 160, 120), "P3": (0x45A2, 256, 192)}


def model_geometry(width: int, height: int) -> dict[str, int]:
    """Rows and bytes of a raw frame: brightness rows, two rows of metadata, thermal rows; read with two 12-byte markers."""
    rows = 2 * height + 2
    return {"frame_rows": rows, "frame_size": 2 * rows * width, "frame_read_size": 2 * rows * width + 24, "thermal_row_start": height + 2, "thermal_row_end": rows}
