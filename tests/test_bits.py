import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from muxlake.functions import bits, clock, codes
from muxlake.operators.elementary import decode_pts, encode_pts


@given(st.binary(max_size=200))
def test_emulation_prevention_round_trip(data):
    safe = bits.escape(data)
    assert bits.unescape(safe) == data
    assert not any(safe[i : i + 2] == b"\0\0" and safe[i + 2] < 3 for i in range(len(safe) - 2))


@given(st.lists(st.integers(0, 5000), max_size=20), st.lists(st.integers(-300, 300), max_size=20))
def test_exp_golomb_round_trip(plain, signed):
    codes_ = plain + [2 * v - 1 if v > 0 else -2 * v for v in signed]
    text = "".join("0" * (len(f"{v + 1:b}") - 1) + f"{v + 1:b}" for v in codes_)
    text += "0" * (-len(text) % 8)
    r = bits.BitReader(int(text or "0", 2).to_bytes(len(text) // 8, "big"))
    assert [r.ue() for _ in plain] == plain
    assert [r.se() for _ in signed] == signed


def test_crc_of_known_text(spark):
    assert bits.crc32_mpeg_of(b"123456789") == 0x0376E6E7
    rows = spark.createDataFrame([(b"123456789",), (b"",), (None,)], "d binary").select(bits.crc32_mpeg("d").alias("c")).collect()
    assert [r.c for r in rows] == [0x0376E6E7, 0xFFFFFFFF, None]


def test_pts_fields(spark):
    values = [0, 1, 2, 3, 4, 5, 6, 7, 8, 100, 10**4, 10**6, 10**8, (1 << 33) - 1, 10**10]
    df = spark.createDataFrame([(v,) for v in values], "v long")
    got = df.select("v", encode_pts(F.col("v"), 2).alias("f")).select("v", "f", decode_pts(F.col("f"), 2).alias("d")).collect()
    for r in got:
        assert r.d.value == r.v % (1 << 33) and r.d.err is None and len(r.f) == 5
    bad = spark.createDataFrame([(b"\x20\x00\x01\x00\x01",), (b"\x31\x00\x01\x00\x01",), (b"\x21",)], "f binary").select(decode_pts(F.col("f"), 2)["err"].alias("e")).collect()
    assert [r.e for r in bad] == ["marker", "guard", "short"]


@pytest.mark.parametrize("a,b,d", [(5, (1 << 33) - 2, 7), ((1 << 33) - 1, 0, -1), (10, 3, 7)])
def test_clock_differences(spark, a, b, d):
    row = spark.range(1).select(clock.pts_signed_diff(F.lit(a), F.lit(b)).alias("p"), clock.pcr_unsigned_diff(F.lit(7), F.lit(7)).alias("z"), clock.pcr_unsigned_diff(F.lit(7), F.lit(7), True).alias("c"), clock.pcr_signed_diff(F.lit(1), F.lit(clock.PCR_MOD - 1)).alias("s")).first()
    assert (row.p, row.z, row.c, row.s) == (d, 0, clock.PCR_MOD, 2)


def test_texts_and_addresses(spark):
    row = spark.range(1).select(
        clock.format_hms(F.lit(27_000_000 * 3661 + 27_000 * 5)).alias("hms"),
        codes.stream_type_text(F.lit(0x1B)).alias("avc"),
        codes.stream_type_text(F.lit(0x90)).alias("private"),
        codes.stream_id_text(F.lit(0xE1)).alias("video"),
        codes.start_code_text(F.lit(5)).alias("slice"),
        bits.ipv4_text(F.lit(0xC0A80001)).alias("ip"),
        bits.ipv4_value(F.lit("192.168.0.1")).alias("ipn"),
        bits.set_bits(F.lit(0b1010)).alias("bits"),
        bits.uint_le(F.unhex(F.lit("0102")), 0, 2).alias("le"),
        codes.avs_frame_rate(F.lit(3)).alias("rate"),
    ).first()
    assert row.hms == "1:01:01.0005" and row.avc.startswith("H.264") and row.private == "User private"
    assert (row.video, row.slice, row.ip, row.ipn, row.bits, row.le, row.rate) == ("Video stream 0x1", "H.262 Slice 5", "192.168.0.1", 0xC0A80001, [1, 3], 0x0201, 25.0)
