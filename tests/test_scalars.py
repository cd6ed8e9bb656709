import pytest
from pyspark.sql import functions as F

from ravelin.functions import frames, scalars

#: Fixed: known commands; their last two bytes are the checksum of those before.
GOLDEN = [
    "0101810001000000000000001e0000004f90",
    "0101810002000000000000000c0000001f63",
    "01018100060000000000000040000000654f",
    "01018100070000000000000040000000104c",
    "010181000a00000000000000400000001959",
    "010181000f0000000000000040000000b857",
    "1021810000000000000000000200000095d1",
    "012f81000000000000000000010000004930",
    "012f41000000000000000000000000003c3a",
    "012f41000100000000000000000000004939",
    "01364300000000000000000000000000cd0b",
]


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize("command", GOLDEN)
def test_known_checksums(spark, command):
    raw = bytes.fromhex(command)
    assert one(spark, scalars.crc16([F.lit(b) for b in raw[:16]])) == int.from_bytes(raw[16:], "little")


def test_command_layout(spark):
    raw = bytes.fromhex(one(spark, scalars.build_command(F.lit(0x0101), F.lit(0x81), F.lit(0x0F), F.lit(64))))
    assert raw[:16].hex() == "010181000f0000000000000000004000" and len(raw) == 18
    assert one(spark, scalars.crc16([F.lit(b) for b in raw[:16]])) == int.from_bytes(raw[16:], "little")


@pytest.mark.parametrize(("celsius", "raw"), [(25.0, 19081), (0.0, 17481), (-273.15, 0)])
def test_celsius_to_raw_cuts(spark, celsius, raw):
    assert one(spark, scalars.celsius_to_raw(F.lit(celsius))) == raw


def test_emissivity_edges(spark):
    for e in (0.0, 1.0, 1.5, -1.0):
        assert one(spark, scalars.emissivity_corrected(F.lit(300.0), F.lit(e), F.lit(25.0))) == 300.0
    assert one(spark, scalars.emissivity_corrected(F.lit(10.0), F.lit(0.5), F.lit(25.0))) == 0.0  # negative before the root


def test_fixed_range(spark):
    level = lambda x, a=0, b=10: one(spark, scalars.fixed_range(F.lit(x), F.lit(a), F.lit(b)))
    assert [level(-5), level(0), level(5), level(10), level(99), level(3, 7, 7)] == [0, 0, 127, 255, 255, None]


def test_missing_is_null_or_zero(spark):
    assert [one(spark, scalars.or_default(F.lit(x).cast("double"), 10.0)) for x in (None, 0.0, 7.0)] == [10.0, 10.0, 7.0]


def test_four_quarter_turns_are_none(spark):
    px, h, w = F.array(*map(F.lit, range(6))), 2, 3
    for _ in range(4):
        px, h, w = frames.rotate(px, h, w, 90), w, h
    assert one(spark, px) == list(range(6))
    assert one(spark, frames.rotate(F.array(*map(F.lit, range(6))), 2, 3, 90)) == [3, 0, 4, 1, 5, 2]
    assert one(spark, frames.rotate(F.array(*map(F.lit, range(6))), 2, 3, 270)) == [2, 5, 1, 4, 0, 3]
    with pytest.raises(ValueError):
        frames.rotate(px, 2, 3, 45)


def test_planes_of_short_frames_are_null(spark):
    assert one(spark, frames.thermal_plane(F.array(*map(F.lit, range(11))), 2, 2)) is None
    assert one(spark, frames.thermal_plane(F.array(*map(F.lit, range(12))), 2, 2)) == [8, 9, 10, 11]
    assert one(spark, frames.brightness_plane(F.array(*map(F.lit, (256, 257, 513, 4))), 2, 2)) == [0, 1, 1, 4]


def test_enlarge(spark):
    assert one(spark, frames.enlarge(F.array(F.lit(1), F.lit(2)), 1, 2, 2)) == [1, 1, 2, 2, 1, 1, 2, 2]
