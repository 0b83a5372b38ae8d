"""Report lines, code texts and pacing on hand-made records."""

from pyspark.sql import functions as F

from muxlake.functions import clock, codes
from muxlake.operators import elementary, packets, reports, transport
from muxlake.sources import files


def lines(df):
    return [r.text for r in df.orderBy(*[c for c in ("pos", "start", "line") if c in df.columns]).collect()]


def test_pes_header_fields(spark):
    head = bytes([0, 0, 1, 0xE0, 0, 0, 0x8D, 0xFE, 25])
    pts, dts = bytes.fromhex("3100018001"), bytes.fromhex("1100010001")
    escr = (1 << 46 | 1 << 42 | 1 << 26 | 2 << 11 | 1 << 10 | 5 << 1 | 1).to_bytes(6, "big")
    rest = (1 << 23 | 1234 << 1 | 1).to_bytes(3, "big") + bytes([2 << 5]) + bytes([0x80 | 17]) + b"\xab\xcd"
    data = bytearray(head + pts + dts + escr + rest + b"body")
    pes = transport.decode_pes(spark.createDataFrame([("f", 256, 0, data)], "source string, pid int, pos long, data binary"))
    r = reports.pes_fields(pes).first()
    assert (r.scrambling, r.priority, r.aligned, r.copyright, r.original) == (0, True, True, False, True)
    assert (r.times, r.has_escr, r.escr, r.es_rate, r.trick_mode, r.copy_info, r.last_crc, r.has_extension) == (3, True, 2 * 300 + 5, 1234, 2, 17, 0xABCD, False)
    types = spark.createDataFrame([("f", 256, 0x1B)], "source string, pid int, stream_type int")
    (text,) = lines(reports.pes_lines(pes, types))
    assert text.startswith("Video stream 0x0 (H.264/14496-10 video (MPEG-4/AVC)) length 0 priority aligned original PTS ") and text.endswith(" ESCR 605 rate 1234 trick 2 CRC 43981")


def test_packet_and_table_lines(spark):
    rows = [("f", 0, 256, 3, True, False, 27, bytearray(b"\0\0\1\xc1rest")), ("f", 188, 257, 4, False, True, None, None)]
    x = spark.createDataFrame(rows, "source string, pos long, pid int, cc int, pusi boolean, disc boolean, pcr long, payload binary")
    assert lines(reports.packet_lines(x)) == ["PID 0100 cc  3 start PCR 27 PES Audio stream 0x01", "PID 0101 cc  4 discontinuity no payload"]
    info = bytearray(b"\x59\x08eng\x24\0\1\0\2" + b"\x52\x01\x07")
    t = spark.createDataFrame([("f", 5, 32, 1, 0x100, 3, 6, 0x101, info), ("f", 5, 32, 1, 0x100, 3, 2, 0x100, bytearray())], "source string, pos long, pmt_pid int, program_number int, pcr_pid int, version int, stream_type int, elementary_pid int, es_info binary")
    assert lines(reports.table_lines(t)) == ["Program 1, version 3, PCR on PID 0100, streams: 2", "PID 0100 type 02 13818-2 video (MPEG-2)", "PID 0101 type 06 13818-1 private data in PES packets; Subtitling: eng subtitles for the hard of hearing, high definition; Stream identifier: 7"]


def test_unit_lines(spark):
    x = spark.createDataFrame([("f", 0, 0xB3, 9, bytearray(b"\0\0\1\xb3abcde")), ("f", 9, 5, 6, bytearray(b"\0\0\1\5zz"))], "source string, start long, start_code int, len int, data binary")
    assert lines(reports.unit_lines(x)) == ["B3 H.262 Sequence header, 9 bytes: 6162636465", "05 H.262 Slice 5, 6 bytes: 7A7A"]
    pics = spark.createDataFrame([("f", 0, True, False, "I", 3, 2, 8, 100), ("f", 9, False, True, None, None, 0, None, 20), ("f", 12, False, False, None, None, 0, None, 4)], "source string, start long, is_picture boolean, is_seq_header boolean, kind string, temporal_reference int, slices int, afd int, size long")
    assert lines(reports.picture_lines(pics)) == ["I picture 3, 2 slices AFD 8, 100 bytes", "Sequence header, 20 bytes", "Sequence end, 4 bytes"]
    avs = spark.createDataFrame([("f", 0, True, None, 3, 30), ("f", 1, False, "P", None, 5)], "source string, start long, is_seq_header boolean, kind string, rate_code int, size long")
    assert lines(reports.avs_lines(avs)) == ["Sequence header at 25.00, 30 bytes", "P frame, 5 bytes"]
    au = spark.createDataFrame([("f", 1, 0, 70, 2, "I", True, True, 4)], "source string, idx int, start long, size long, slices int, slice_class string, ref boolean, idr boolean, frame_num int")
    assert lines(reports.access_unit_lines(au)) == ["Access unit 1: 2 slices I IDR reference frame number 4, 70 bytes"]


def test_nal_lines(spark):
    sps = bytearray(b"\0\0\1\x67\x42\xe0\x1e\xda\x02\x80\xf6\x84")
    units = spark.createDataFrame([("f", 0, 0x67, len(sps), sps), ("f", 12, 9, 5, bytearray(b"\0\0\1\x09\x10"))], "source string, start long, start_code int, len int, data binary")
    got = lines(reports.nal_lines(elementary.nal_units(units)))
    assert got[0].startswith("3/7 sequence parameter set, 12 bytes id 0 profile 66 level 30") and got[1] == "0/9 access unit delimiter, 5 bytes"


def test_code_texts(spark):
    row = spark.range(1).select(
        codes.dvb_component_text(F.lit(0x12)), codes.dvb_component_text(F.lit(0xB7)), codes.dvb_component_text(F.lit(0x40)),
        codes.service_text(F.lit(0), F.lit(7)), codes.service_text(F.lit(7), F.lit(1)), codes.service_text(F.lit(7), F.lit(2)),
        codes.profile_note(F.lit(66), F.lit(True), F.lit(False), F.lit(True)), codes.profile_note(F.lit(88), F.lit(False), F.lit(False), F.lit(False)),
        codes.profile_note(F.lit(77), F.lit(False), F.lit(False), F.lit(False)), codes.profile_note(F.lit(66), F.lit(True), F.lit(True), F.lit(False)),
        codes.descriptor_name(F.lit(0x7A)), codes.nal_type_text(F.lit(30)),
    ).first()
    assert tuple(row) == ("subtitles, 16:9", "user defined", "reserved", "complete main, 3/2", "voice over, 1/0", "karaoke, 2/0", "declares the baseline profile (66), within the limits of baseline and extended; parts of it may not be understood", "declares the extended profile (88); parts of it may not be understood", None, None, "Enhanced AC-3", "unspecified")


def test_audio_details_and_capture_start(spark):
    f = spark.createDataFrame([("f", 0, 8, bytearray(b"\x0b\x77\0\0\x5e\x42\xe0\0"))], "source string, pos long, len int, data binary")
    r = files.ac3_details(f).first()
    assert (r.fscod, r.bsid, r.bsmod, r.acmod, r.service) == (1, 8, 2, 7, "visually impaired, 3/2")
    c = spark.createDataFrame([("f", 1, 86400, 5), ("f", 0, 3600, 250000)], "source string, pkt_no long, sec long, usec long")
    assert files.capture_start(c).first().start == "1970-01-01 01:00:00.250000"


def test_credit_pacing(spark):
    # a steady stream: after its second PCR the credit follows the stream's own rate
    rows = [("f", i, 27_000_000 // 100 * (i // 10) if i % 10 == 0 else None) for i in range(3000)]
    x = spark.createDataFrame(rows, "source string, n long, pcr long")
    got = [r.send_us for r in packets.schedule_by_credit(x, 188_000, per_item=5).orderBy("item").collect()]
    steps = [b - a for a, b in zip(got, got[1:])]
    assert min(steps) > 0 and all(abs(s - 5_000) <= 250 for s in steps[100:])
    # a jump of the clock primes the credit anew at the last rate
    rows += [("f", 3000 + i, clock.PCR_HZ * 3600 + 27_000_000 // 100 * (i // 10) if i % 10 == 0 else None) for i in range(1000)]
    got = [r.send_us for r in packets.schedule_by_credit(spark.createDataFrame(rows, "source string, n long, pcr long"), 188_000, per_item=5).orderBy("item").collect()]
    assert all(0 < b - a < 10_000 for a, b in zip(got, got[1:]))


def test_perturbed_times(spark):
    x = spark.range(200).select(F.lit("f").alias("source"), F.col("id").alias("n"), (F.col("id") * 1000).alias("send_us"))
    a, b, c = ([r.send_us for r in packets.perturb(x, 100, s).orderBy("n").collect()] for s in (1, 1, 2))
    assert a == b != c and all(abs(v - max(0, 1000 * i)) <= 100 for i, v in enumerate(a)) and len({v % 1000 for v in a}) > 50


def test_video_type_of_pes(spark):
    es = b"\0\0\1\xb3" + bytes(8) + b"\0\0\1\x00\0\x10\0\0" + b"\0\0\1\xb8" + bytes(4)
    rows = [("f", i, bytearray(es[a : a + 7])) for i, a in enumerate(range(0, len(es), 7))]
    pes = spark.createDataFrame(rows, "source string, pos long, es_data binary")
    assert elementary.pes_video_type(pes).first().video == "H.262"
    ps = spark.createDataFrame([("f", i, 0xE0, bytearray(b"\0\0\1\xe0" + (3 + len(d)).to_bytes(2, "big") + b"\x80\0\0" + bytes(d)), None) for _, i, d in rows], "source string, pos long, stream_id int, data binary, err string")
    assert elementary.ps_video_type(ps).first().video == "H.262"
