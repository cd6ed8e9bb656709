"""Scalar functions over columns: temperatures, boxes, rates, commands, times and strings.

All are column expressions, so they stay inside generated code and can be pushed down or folded.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Raw units per kelvin, and 0 degrees Celsius in kelvin.
UNITS, ZERO = 64.0, 273.15


def raw_to_kelvin(raw: Column) -> Column:
    return raw.cast("double") / UNITS


def kelvin_to_celsius(kelvin: Column) -> Column:
    return kelvin - ZERO


def celsius_to_kelvin(celsius: Column) -> Column:
    return celsius + ZERO


def raw_to_celsius(raw: Column) -> Column:
    return kelvin_to_celsius(raw_to_kelvin(raw))


def celsius_to_raw(celsius: Column) -> Column:
    """Cut towards zero."""
    return (celsius_to_kelvin(celsius) * UNITS).cast("int")


def emissivity_corrected(kelvin: Column, emissivity: Column, reflected_celsius: Column) -> Column:
    """Object temperature in kelvin; unchanged for an emissivity of 1 or more, or 0 or less."""
    reflected = celsius_to_kelvin(reflected_celsius)
    fourth = lambda t: t * t * t * t
    own = (fourth(kelvin) - (F.lit(1.0) - emissivity) * fourth(reflected)) / emissivity
    return F.when((emissivity >= 1) | (emissivity <= 0), kelvin).otherwise(F.sqrt(F.sqrt(F.greatest(own, F.lit(0.0)))))


def raw_to_celsius_corrected(raw: Column, emissivity: Column, reflected_celsius: Column) -> Column:
    return kelvin_to_celsius(emissivity_corrected(raw_to_kelvin(raw), emissivity, reflected_celsius))


def fixed_range(raw: Column, low: Column, high: Column) -> Column:
    """0 to 255 from low to high, cut towards zero; null where low equals high."""
    scaled = (raw - low) * 255.0 / F.nullif(high - low, F.lit(0))
    return F.when(scaled.isNotNull(), F.floor(F.least(F.greatest(scaled, F.lit(0.0)), F.lit(255.0))).cast("int"))


def iou(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Intersection over union of boxes given as x0, y0, x1, y1; 0 where the union is empty."""
    w = F.greatest(F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"]), F.lit(0))
    h = F.greatest(F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"]), F.lit(0))
    common = (w * h).cast("double")
    union = (a["x1"] - a["x0"]) * (a["y1"] - a["y0"]) + (b["x1"] - b["x0"]) * (b["y1"] - b["y0"]) - common
    return F.when(union > 0, common / union).otherwise(0.0)


def box_gap(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Distance between the edges of two boxes; 0 where they touch or overlap."""
    x = F.greatest(a["x0"] - b["x1"], b["x0"] - a["x1"], F.lit(0)).cast("double")
    y = F.greatest(a["y0"] - b["y1"], b["y0"] - a["y1"], F.lit(0)).cast("double")
    return F.sqrt(x * x + y * y)


def achieved_rate(native: Column, wanted: Column) -> Column:
    """The rate that taking every n-th frame gives, not above what is wanted."""
    return native / F.ceil(native / wanted - 1e-9)


def or_default(value: Column, default: float) -> Column:
    """Null and 0 both count as missing."""
    return F.coalesce(F.nullif(value, F.lit(0).cast("double")), F.lit(default))


def crc16(data: list[Column]) -> Column:
    """CRC-16 with polynomial 0x1021 and start 0 of byte values 0 to 255, a byte at a step."""
    crc: Column = F.lit(0)
    return F.aggregate(F.array(*data), crc, _crc16_step)


def _crc16_step(crc: Column, byte: Column) -> Column:
    x = F.shiftright(crc, 8).bitwiseXOR(byte.cast("int"))
    x = x.bitwiseXOR(F.shiftright(x, 4)).bitwiseAND(255)
    return F.shiftleft(crc, 8).bitwiseXOR(F.shiftleft(x, 12)).bitwiseXOR(F.shiftleft(x, 5)).bitwiseXOR(x).bitwiseAND(0xFFFF)


def little_endian(value: Column, size: int) -> list[Column]:
    return [F.shiftrightunsigned(value.cast("long"), 8 * i).bitwiseAND(255) for i in range(size)]


def hex_of(data: list[Column]) -> Column:
    return F.lower(F.concat(*[F.lpad(F.hex(b), 2, "0") for b in data]))


def build_command(kind: Column, param: Column, register: Column, length: Column) -> Column:
    """18 bytes as hex: three 16-bit fields, eight zero bytes, the response's length, and the CRC-16 of all that."""
    body = little_endian(kind, 2) + little_endian(param, 2) + little_endian(register, 2) + [F.lit(0)] * 8 + little_endian(length, 2)
    return F.concat(hex_of(body), hex_of(little_endian(crc16(body), 2)))


def clean(text: Column) -> Column:
    """Without NUL bytes at the end, other unprintable characters left out."""
    return F.regexp_replace(F.regexp_replace(text, "\\x00+$", ""), "[^\\x20-\\x7e]", "")


def utc(micros: Column) -> Column:
    """Epoch microseconds as a time without a zone, whatever the session's."""
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=(micros.cast("decimal(20,0)") / 1_000_000).cast("decimal(18,6)"))


def iso_utc(seconds: Column) -> Column:
    """ISO time with offset of epoch seconds."""
    at = utc(F.floor(seconds * 1e6 + 0.5).cast("long"))
    return F.concat(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"), F.when(F.date_format(at, "SSSSSS") == "000000", "").otherwise(F.concat(F.lit("."), F.date_format(at, "SSSSSS"))), F.lit("+00:00"))


def display_stamp(micros: Column) -> Column:
    """Time with milliseconds, cut."""
    return F.date_format(utc(micros), "yyyy-MM-dd HH:mm:ss.SSS")


def file_stamp(micros: Column) -> Column:
    return F.date_format(utc(micros), "yyyyMMdd_HHmmss")


def half_up(value: Column, digits: int) -> Column:
    """floor(x * 10^digits + 0.5) / 10^digits: the same in every engine, unlike round."""
    scale = 10.0**digits
    return F.floor(value * scale + 0.5) / scale
