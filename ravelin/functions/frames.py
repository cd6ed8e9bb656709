"""Array functions over frames stored as one row each: pixels in row-major order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rotate(px: Column, height: int, width: int, degrees: int) -> Column:
    """Clockwise; a quarter turn swaps height and width."""
    if degrees not in (0, 90, 180, 270):
        raise ValueError(f"can't rotate by {degrees}")
    if degrees == 0:
        return px
    last = height * width - 1
    at = {
        90: lambda i: (height - 1 - i % height) * width + F.floor(i / height),
        180: lambda i: last - i,
        270: lambda i: (i % height) * width + (width - 1 - F.floor(i / height)),
    }[degrees]
    return F.transform(F.sequence(F.lit(0), F.lit(last)), lambda i: F.get(px, at(i).cast("int")))


def mask_bottom(px: Column, height: int, width: int, rows: int) -> Column:
    """The last ``rows`` rows at zero."""
    first = (height - rows) * width
    return F.transform(px, lambda x, i: F.when(i >= first, F.lit(0).cast("double")).otherwise(x.cast("double")))


def thermal_plane(words: Column, height: int, width: int) -> Column:
    """The thermal rows of a raw frame of 16-bit words: after ``height`` brightness rows and two rows of metadata; null if
    the frame is too short."""
    size = height * width
    return F.when(F.size(words) >= (2 * height + 2) * width, F.slice(words, (height + 2) * width + 1, size))


def brightness_plane(words: Column, height: int, width: int) -> Column:
    """The low bytes of the first rows; null if the frame is too short."""
    return F.when(F.size(words) >= height * width, F.transform(F.slice(words, 1, height * width), lambda x: x.bitwiseAND(255)))


def min_max_normalised(px: Column) -> Column:
    """0 to 255 between the frame's least and greatest value; 0 for a flat frame."""
    low, high = F.array_min(px), F.array_max(px)
    return F.transform(px, lambda x: F.when(high > low, F.floor((x - low) * 255.0 / (high - low)).cast("int")).otherwise(0))


def enlarge(px: Column, height: int, width: int, factor: int) -> Column:
    """Each pixel ``factor`` times in both directions."""
    wide = width * factor
    return F.transform(
        F.sequence(F.lit(0), F.lit(height * factor * wide - 1)),
        lambda i: F.get(px, (F.floor(F.floor(i / wide) / factor) * width + F.floor((i % wide) / factor)).cast("int")),
    )
