"""Conversions there and back, trick play, and the file views."""

import pytest
from pyspark.sql import functions as F
from test_media import chunks_of, h264_stream, nal, pps, slice_, sps, transport_file

from muxlake import api
from muxlake.operators import convert, elementary, transport, trickplay
from muxlake.sources import files


def parsed(built):
    return transport.parse(transport.lay_out(built))


def test_es_to_transport_and_back(spark):
    data = h264_stream()
    units = elementary.es_units(chunks_of(spark, data, [50]))
    x = parsed(convert.es_to_transport(units)).cache()
    assert x.where("err is not null").count() == 0 and {r.n for r in x.select(F.length("raw").alias("n")).collect()} == {188}
    got = convert.extract_first(x).orderBy("pos").collect()
    assert b"".join(bytes(r.es_data) for r in got) == data
    assert convert.extract_first(x, video=False).count() == 0


def test_ps_to_transport(spark, tmp_path):
    head = convert.pack_header(F.lit(27_000_000 * 3 + 7))
    pack = bytes(spark.range(1).select(head.alias("h")).first().h)
    assert files.pack_header(pack[4:])[:3] == (10, 27_000_000 * 3 + 7, 25_000)
    packet = lambda i, d: b"\0\0\1" + bytes([i]) + len(d).to_bytes(2, "big") + d
    data = pack + packet(0xE1, b"\x80\0\0" + b"v" * 300) + packet(0xE2, b"\x80\0\0other") + packet(0xC0, b"\x80\0\0sound") + pack + packet(0xE1, b"\x80\0\0more") + b"\0\0\1\xb9"
    (tmp_path / "x.ps").write_bytes(data)
    x = parsed(convert.ps_to_transport(files.read_program_stream(spark, str(tmp_path / "x.ps")))).cache()
    video = convert.extract_first(x).orderBy("pos").collect()
    assert [bytes(r.es_data) for r in video] == [b"v" * 300, b"more"]
    assert [bytes(r.es_data) for r in convert.extract_first(x, video=False).collect()] == [b"sound"]
    assert [r.pcr for r in x.where("pcr is not null").collect()] == [27_000_000 * 3 + 7] * 2


def test_transport_to_ps(spark, tmp_path):
    pes = spark.createDataFrame([("f", 1, 0xE0, bytearray(b"x" * 150_000), 90000), ("f", 2, 0xC0, bytearray(b"snd"), None)], "source string, pos long, stream_id int, es_data binary, pts long")
    parts = convert.transport_to_ps(pes).orderBy("pos").collect()
    (tmp_path / "y.ps").write_bytes(b"".join(bytes(r.data) for r in parts) + b"\0\0\1\xb9")
    got = files.read_program_stream(spark, str(tmp_path / "y.ps")).orderBy("pos").collect()
    assert [r.stream_id for r in got] == [0xBA, 0xE0, 0xBA, 0xE0, 0xBA, 0xE0, 0xBA, 0xC0, 0xB9] and not any(r.err for r in got)
    assert sum(len(r.data) - 9 for r in got if r.stream_id == 0xE0) == 150_000 and got[0].scr == 27_000_000


def test_merge_audio_and_video(spark):
    v = spark.createDataFrame([("f", i, bytearray(b"\0\0\1\x65" + bytes([i]))) for i in range(6)], "source string, idx long, data binary")
    a = spark.createDataFrame([("f", i, bytearray(b"aud" + bytes([i]))) for i in range(10)], "source string, idx long, data binary")
    x = parsed(convert.merge_av(v, a, repeat=4)).cache()
    order = [("v" if r.pid == 0x68 else "a") for r in x.where("pusi and pid in (104, 103)").orderBy("pos").collect()]
    times = sorted([(i * 90000 / 25, 0, "v") for i in range(6)] + [(i * 90000 * 1024 // 44100, 1, "a") for i in range(10)])
    assert order == [t[2] for t in times]
    assert x.where("pid = 0").count() == 2 and x.where("pcr is not null").count() == 6
    pes = transport.pes_packets(x.where("pid = 103")).orderBy("pos").collect()
    assert [bytes(r.es_data) for r in pes] == [b"aud" + bytes([i]) for i in range(10)] and pes[1].pts == 45000 + 90000 * 1024 // 44100


def test_null_and_padding_packets(spark):
    x = transport.parse(convert.null_packets(spark, "f", 3).withColumn("pos", F.col("n") * 188))
    assert [(r.pid, r.payload, r.err) for r in x.collect()] == [(0x1FFF, None, None)] * 3
    pes = spark.createDataFrame([("f", bytearray(b"\0\0\1\xe0\0\5hello"))], "source string, data binary")
    got = convert.pad(pes, 2).orderBy("padding").collect()
    assert [len(r.data) for r in got] == [11, 11, 11] and bytes(got[1].data[:6]) == b"\0\0\1\xbe\0\5"


def test_latest_parameter_sets(spark):
    data = nal(3, 7, sps()) + nal(3, 8, pps()) + nal(3, 5, slice_(7, 0, idr=0)) + nal(3, 7, sps(5)) + nal(3, 8, pps())
    nals = elementary.nal_units(elementary.es_units(chunks_of(spark, data, [1000])))
    got = {(r.unit_type, r.set_id): r.start for r in convert.parameter_sets_first(nals).collect()}
    assert got == {(7, 0): data.rindex(b"\0\0\1\x67"), (8, 0): data.rindex(b"\0\0\1\x68")}


@pytest.mark.parametrize("commands,want", [
    ([("n", 3), ("f", 2)], [0, 1, 2, 4, 8]),
    ([("n", 9), ("r", 2), ("n", 2)], [0, 1, 2, 3, 4, 5, 6, 7, 8, 8, 4, 4, 5]),
    ([(">", 2)], [252, 253]),
    ([("n", 1), ("F", 2)], [0, 4, 36]),
])
def test_trick_play(spark, commands, want):
    pics = spark.range(600).select(F.lit("f").alias("source"), F.col("id").alias("idx"), (F.col("id") % 4 == 0).alias("ref"))
    got = trickplay.plan(pics, commands).orderBy("step", "out_no").collect()
    assert [r.idx for r in got] == want


def test_file_views(spark, tmp_path):
    path, bodies = transport_file(spark, tmp_path)
    with api.TransportFile(spark, path) as f:
        pat = f.find_pat()
        assert pat == {1: 32, 2: 48} and pat.has_pmt(48) and pat.program_numbers(32) == [1]
        assert sorted(r.elementary_pid for r in f.find_pmt(1).collect()) == [256, 257] and f.find_pmt(number=2).count() == 0
        assert [bytes(r.es_data) for r in f.pes(256).orderBy("pos").collect()] == bodies
        assert next(iter(f)).pid == 0
    data = h264_stream()
    (tmp_path / "x.264").write_bytes(data)
    es = api.ElementaryFile(spark, str(tmp_path / "x.264"))
    assert es.read(10, 60) == data[10:70] and es.video_type().first().video == "H.264"
    assert b"".join(bytes(u.data) for u in es) == data
