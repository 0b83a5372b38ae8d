"""Byte-level layers on streams made by our own encoders."""

import base64
import random
import struct

import pytest
from pyspark.sql import functions as F

from muxlake.functions.bits import crc32_mpeg_of, escape
from muxlake.operators import elementary, frames, packets, subtitles, transport
from muxlake.sources import files, records


class Bits:
    def __init__(self):
        self.s = ""

    def u(self, n, v):
        self.s += f"{v:0{n}b}"
        return self

    def ue(self, v):
        t = f"{v + 1:b}"
        self.s += "0" * (len(t) - 1) + t
        return self

    def se(self, v):
        return self.ue(2 * v - 1 if v > 0 else -2 * v)

    def bytes(self):
        s = self.s + "1"
        s += "0" * (-len(s) % 8)
        return int(s, 2).to_bytes(len(s) // 8, "big")


def nal(ref, kind, body):
    return b"\0\0\1" + bytes([ref << 5 | kind]) + escape(body)


def sps(log2_frame=4):
    return Bits().u(8, 66).u(8, 0).u(8, 30).ue(0).ue(log2_frame - 4).ue(2).ue(1).u(1, 0).ue(10).ue(10).u(1, 1).bytes()


def pps():
    return Bits().ue(0).ue(0).u(1, 0).u(1, 0).ue(0).ue(0).ue(0).u(1, 0).u(2, 0).se(0).se(0).se(0).u(1, 0).u(1, 0).u(1, 0).bytes()


def slice_(kind, frame, idr=None, first=0):
    b = Bits().ue(first).ue(kind).ue(0).u(4, frame % 16)
    if idr is not None:
        b.ue(idr)
    return b.u(40, 0xABCDEF1234).bytes()


def h264_stream():
    out = nal(3, 7, sps()) + nal(3, 8, pps())
    out += nal(0, 9, b"\x10") + nal(3, 5, slice_(7, 0, idr=0)) + nal(3, 5, slice_(7, 0, idr=0, first=50))
    out += nal(0, 9, b"\x30") + nal(2, 1, slice_(5, 1)) + nal(0, 1, slice_(6, 2)) + nal(0, 1, slice_(6, 3))
    return out + nal(0, 9, b"\x10") + nal(3, 5, slice_(7, 0, idr=1))


def chunks_of(spark, data, sizes):
    rows, at = [], 0
    while at < len(data):
        n = sizes[len(rows) % len(sizes)]
        rows.append(("f", at, bytearray(data[at : at + n])))
        at += n
    return spark.createDataFrame(rows, "source string, infile long, data binary")


@pytest.mark.parametrize("sizes", [[1000], [1], [2, 3], [7, 1, 1, 5]])
def test_units_over_chunk_edges(spark, sizes):
    data = b"junk" + b"\0\0\1\x00abc\0" + b"\0\0\1\xb3xy" + b"\0\0\1\x01" + b"\0\0\0\1\xb7"
    got = elementary.split_units(chunks_of(spark, data, sizes)).orderBy("start").collect()
    assert [bytes(r.data) for r in got] == [b"\0\0\1\x00abc\0", b"\0\0\1\xb3xy", b"\0\0\1\x01\0", b"\0\0\1\xb7"]
    assert [r.start for r in got] == [data.index(b"\0\0\1\x00"), data.index(b"\0\0\1\xb3"), data.index(b"\0\0\1\x01"), len(data) - 4]


def test_h264_access_units(spark):
    units = elementary.es_units(chunks_of(spark, h264_stream(), [17]))
    assert elementary.video_type(units).first().video == "H.264"
    nals = elementary.nal_units(units)
    sliced = elementary.slice_headers(nals).cache()
    got = [r.slice.frame_num for r in sliced.where("slice is not null").orderBy("start").collect()]
    assert got == [0, 0, 1, 2, 3, 0]
    au = elementary.access_units(sliced).where("slices > 0").orderBy("idx").collect()
    assert [(r.slices, r.slice_class, r.ref, r.idr) for r in au] == [(2, "I", True, True), (1, "P", True, False), (1, "B", False, False), (1, "B", False, False), (1, "I", True, True)]
    line = frames.dots(spark.createDataFrame(au), frames.avc_mark(F.col("ref"), F.col("idr"), F.col("slice_class"), F.lit(True))).first().dots
    assert line == "DPbbD"


def test_h262_pictures(spark):
    def picture(ref, coding):
        return b"\0\0\1\0" + struct.pack(">H", ref << 6 | coding << 3) + b"\xff\xf8" + b"\0\0\1\xb5\x8f\xff\xf3\x41"

    data = b"\0\0\1\xb3" + b"\x12\x34\x56\x33abcd" + picture(0, 1) + b"\0\0\1\xb2DTG1\x41\xf8" + b"\0\0\1\1aa" + b"\0\0\1\2bb" + picture(1, 2) + b"\0\0\1\1cc" + b"\0\0\1\xb7"
    units = elementary.es_units(chunks_of(spark, data, [9]))
    items = elementary.h262_items(units)
    pics = elementary.h262_pictures(items).orderBy("idx").collect()
    assert [(r.is_picture, r.is_seq_header, r.slices, r.kind, r.afd) for r in pics] == [(False, True, 0, None, None), (True, False, 2, "I", 8), (True, False, 1, "P", 8), (False, False, 0, None, None)]
    assert [r.temporal_reference for r in pics] == [None, 0, 1, None]
    assert elementary.video_type(units).first().video == "unknown"


def test_field_pairs(spark):
    rows = [("f", 1, 10, "I", 1, 0), ("f", 2, 11, "P", 2, 0), ("f", 3, 5, "P", 3, 1), ("f", 4, 7, "B", 1, 2), ("f", 5, 7, "B", 3, 3)]
    df = spark.createDataFrame(rows, "source string, idx long, size long, kind string, structure int, temporal_reference int")
    got = elementary.pair_fields(df).orderBy("idx").collect()
    assert [(r.idx, r.size, r.fields, r.unmatched) for r in got] == [(1, 21, 2, False), (3, 5, 1, False), (4, 7, 1, True), (5, 7, 1, False)]


def test_avs_frames(spark):
    data = b"\0\0\1\xb0" + bytes(6) + b"\x00\xc0" + b"\0\0\1\xb3" + b"1234" + b"\0\0\1\1aa" + b"\0\0\1\xb6\0\0\x40x" + b"\0\0\1\1bb" + b"\0\0\1\xb6\0\0\x80x"
    got = elementary.avs_frames(elementary.es_units(chunks_of(spark, data, [11]))).orderBy("idx").collect()
    assert [(r.kind, r.is_seq_header) for r in got] == [(None, True), ("I", False), ("P", False), ("B", False)]
    assert got[0].rate_code == 3


def transport_file(spark, tmp_path):
    """PAT, PMT over two packets, and two PES streams, as a file."""
    rng = random.Random(1)
    descriptor = bytes([10, 4]) + b"eng\0" + bytes([5, 150]) + b"X" * 150
    pat = transport.build_programs([(0, 16), (1, 32), (2, 48)])
    pmt = transport.build_streams(1, 256, [(0x1B, 256, descriptor), (0x0F, 257, b"")], version=3)
    bodies = [bytes(rng.randrange(256) for _ in range(n)) for n in (400, 150, 1000)]
    rows, pos = [], 0

    def section(pid, data):
        nonlocal pos
        data = b"\0" + data
        for i in range(0, len(data), 184):
            rows.append(("f", pid, pos, i == 0, None, bytearray(data[i : i + 184].ljust(184, b"\xff"))))
            pos += 1

    section(0, pat)
    section(32, pmt)
    psi = spark.createDataFrame(rows, "source string, pid long, pos long, pusi boolean, pcr long, payload binary").withColumn("disc", F.lit(False))
    psi = transport.build(transport.number_counters(psi.withColumn("pos", F.struct("pos", F.lit(0).alias("k"))))).select("source", "pid", "pos", "raw")
    pes = spark.createDataFrame([("f", 256, pos + i, bytearray(b), 90000 * (i + 1), 27_000_000 * i) for i, b in enumerate(bodies)], "source string, pid long, pos long, body binary, pts long, pcr long")
    pes = pes.withColumn("data", F.concat(transport.pes_header(0xE0, F.length("body"), F.col("pts"), F.col("pts") - 3600), F.col("body")))
    av = transport.pes_to_packets(pes).select("source", "pid", "pos", "raw")
    out = [bytes(r.raw) for r in psi.union(av).orderBy("pos.pos", "pos.k").collect()]
    assert all(len(x) == 188 for x in out)
    path = tmp_path / "x.ts"
    path.write_bytes(b"".join(out))
    return str(path), bodies


def test_transport_round_trip(spark, tmp_path):
    path, bodies = transport_file(spark, tmp_path)
    raw = records.read_transport(spark, path)
    assert transport.looks_like_transport(raw).first().is_ts
    assert [r.n for r in raw.orderBy("pos").collect()] == list(range(raw.count()))
    x = transport.parse(raw).cache()
    assert x.where("err is not null").count() == 0
    s = transport.sections(x).cache()
    assert s.where("crc_ok").count() == 2
    assert sorted((r.program_number, r.pmt_pid) for r in transport.programs(s).collect()) == [(1, 32), (2, 48)]
    streams = transport.streams(s).orderBy("elementary_pid").collect()
    assert [(r.stream_type, r.elementary_pid, r.version, r.pcr_pid, r.pmt_pid) for r in streams] == [(0x1B, 256, 3, 256, 32), (0x0F, 257, 3, 256, 32)]
    texts = transport.streams(s).where("elementary_pid = 256").select(F.explode(transport.descriptors(F.col("es_info"))).alias("d")).select(transport.descriptor_text(F.col("d.tag"), F.col("d.body")).alias("t")).collect()
    assert [r.t for r in texts] == ["Languages: eng", "Registration XXXX"]
    got = transport.pes_packets(x.where("pid = 256")).orderBy("pos").collect()
    assert [bytes(r.es_data) for r in got] == bodies
    assert [(r.pts, r.dts, r.dts_explicit, r.overlong) for r in got] == [(90000 * i, 90000 * i - 3600, True, False) for i in (1, 2, 3)]
    assert [r.pcr for r in x.where("pcr is not null").orderBy("pos").collect()] == [0, 27_000_000, 54_000_000]
    cc = packets.continuity(x.withColumn("source", F.lit("f"))).collect()
    assert all(r.cc_errors == 0 and r.dup_errors == 0 for r in cc)
    records.write_pieces(raw, ["pos"], "raw", str(tmp_path / "out"))
    with open(path, "rb") as f:
        want = f.read()
    assert b"".join(bytes(r.value) for r in records.read_pieces(spark, str(tmp_path / "out")).collect()) == want
    assert records.write_stream(raw, ["pos"], "raw", str(tmp_path / "out.ts")) == len(want)
    assert (tmp_path / "out.ts").read_bytes() == want
    kept, waits = [], []
    slow = raw.where("n < 3").withColumn("us", F.col("n") * 10**9)
    assert records.write_stream(slow, ["pos"], "raw", kept.append, "us", waits.append) == 3 * 188
    assert b"".join(kept) == want[: 3 * 188] and [round(w / 1000) for w in waits] == [1, 2]


def test_bad_section_crc_and_incomplete_pes(spark):
    pat = bytearray(transport.build_programs([(1, 32)]))
    assert crc32_mpeg_of(bytes(pat)) == 0
    pat[10] ^= 1
    rows = [("f", 0, 0, True, bytearray(b"\0" + pat)), ("f", 9, 1, False, bytearray(b"orphan")), ("f", 9, 2, True, bytearray(b"\0\0\1\xe0\0\x20\x80\0\0abc")), ("f", 9, 3, True, bytearray(b"\0\0\1\xe0\0\x06\x80\0\0abc" + b"over")), ("f", 9, 4, True, bytearray(b"\0\0\1\xe0\0\0\x80\0\0open"))]
    x = spark.createDataFrame(rows, "source string, pid int, pos long, pusi boolean, payload binary")
    s = transport.sections(x.where("pid = 0"))
    assert [r.crc_ok for r in s.collect()] == [False] and transport.programs(s).count() == 0
    got = transport.pes_packets(x.where("pid = 9")).orderBy("pos").collect()
    assert [(r.pos, bytes(r.es_data), r.overlong) for r in got] == [(3, b"abc", True), (4, b"open", False)]


def test_program_stream(spark, tmp_path):
    base, ext = 12345, 7
    v = 1 << 46 | (base >> 30) << 43 | 1 << 42 | (base >> 15 & 0x7FFF) << 27 | 1 << 26 | (base & 0x7FFF) << 11 | 1 << 10 | ext << 1 | 1
    pack = b"\0\0\1\xba" + v.to_bytes(6, "big") + (5000 << 2 | 3).to_bytes(3, "big") + b"\xf8"
    packet = lambda i, d: b"\0\0\1" + bytes([i]) + len(d).to_bytes(2, "big") + d
    data = pack + packet(0xE0, b"\x80\0\0video") + packet(0xC1, b"\x80\0\0au") + b"\0\0" + packet(0xBD, b"\x80\0\0\x81ac3") + b"GARBAGE" + pack + packet(0xE0, b"\x80\0\0more!") + b"\0\0\1\xb9"
    (tmp_path / "x.ps").write_bytes(data)
    ps = files.read_program_stream(spark, str(tmp_path / "x.ps")).cache()
    got = ps.orderBy("pos").collect()
    assert [r.stream_id for r in got] == [0xBA, 0xE0, 0xC1, 0xBD, None, 0xBA, 0xE0, 0xB9]
    assert got[0].scr == base * 300 + ext and got[0].mux_rate == 5000 and not got[0].mpeg1 and got[4].err == "no start code"
    sizes = {(r.kind, r.number): (r.packets, r.min_len, r.max_len) for r in files.stream_sizes(files.substreams(ps, dvd=True)).collect()}
    assert sizes == {("video", 0): (2, 14, 14), ("audio", 1): (1, 11, 11), ("AC3", 1): (1, 13, 13)}
    assert files.detect(spark, str(tmp_path / "x.ps")).first().kind == "PS"


def udp(payload, seq=None, ident=1, dst=5004):
    if seq is not None:
        payload = struct.pack(">BBHII", 0x80, 33, seq, 90 * seq, 77) + payload
    body = struct.pack(">HHHH", 1000, dst, 8 + len(payload), 0) + payload
    return ip(body, ident)


def ip(body, ident, flags=0):
    return struct.pack(">BBHHHBBHII", 0x45, 0, 20 + len(body), ident, flags, 64, 17, 0, 0x0A000001, 0xE0000001) + body


def ether(packet, vlans=()):
    tags = b"".join(b"\x81\x00" + (p << 13 | v).to_bytes(2, "big") for v, p in vlans)
    return b"\1" * 12 + tags + b"\x08\x00" + packet


@pytest.mark.parametrize("order", ["<", ">"])
def test_captures(spark, tmp_path, order):
    ts = b"\x47" + bytes(187)
    big = struct.pack(">HHHH", 1, 6000, 8 + 300, 0) + bytes(300)
    frames_ = [ether(udp(ts, 1), [(5, 3)]), ether(udp(ts * 2, 3), [(5, 3), (6, 1)]), ether(ip(big[:160], 9, 0x2000)), ether(ip(big[160:], 9, 20)), b"\1" * 12 + b"\x86\xdd" + bytes(30)]
    data = struct.pack(order + "IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1)
    for i, f in enumerate(frames_):
        data += struct.pack(order + "IIII", 100 + i, 500_000, len(f), len(f)) + f
    (tmp_path / "x.pcap").write_bytes(data)
    x = files.read_capture(spark, str(tmp_path / "x.pcap")).cache()
    got = x.orderBy("pkt_no").collect()
    assert [r.t90 for r in got[:2]] == [100 * 90000 + 45000, 101 * 90000 + 45000]
    assert [(v.vid, v.pcp) for v in got[1].vlans] == [(5, 3), (6, 1)] and got[0].rtp.seq == 1 and bytes(got[1].payload) == ts * 2 and got[4].err == "not IPv4"
    joined = files.reassemble_fragments(x).first()
    assert joined.dst_port == 6000 and len(joined.payload) == 300
    cut = records.from_payloads(x.where("rtp is not null"))
    assert cut.count() == 3


def test_pcapng(spark, tmp_path):
    def block(kind, body):
        body += b"\0" * (-len(body) % 4)
        return struct.pack("<II", kind, len(body) + 12) + body + struct.pack("<I", len(body) + 12)

    f = ether(udp(b"hello"))
    data = block(0x0A0D0D0A, struct.pack("<IHHq", 0x1A2B3C4D, 1, 0, -1)) + block(1, struct.pack("<HHI", 1, 0, 0) + struct.pack("<HHB", 9, 1, 9) + b"\0\0\0" + bytes(4))
    t = 7 * 10**9 + 250_000_000
    data += block(6, struct.pack("<IIIII", 0, t >> 32, t & 0xFFFFFFFF, len(f), len(f)) + f)
    (tmp_path / "x.pcapng").write_bytes(data)
    r = files.read_capture(spark, str(tmp_path / "x.pcapng")).first()
    assert (r.sec, r.usec, bytes(r.payload)) == (7, 250_000, b"hello")


def test_audio_frames(spark, tmp_path):
    adts = lambda n: bytes([0xFF, 0xF1, 0x50, 0x80 | n >> 11, n >> 3 & 255, (n & 7) << 5 | 31, 0xFC]) + bytes(n - 7)
    (tmp_path / "a.aac").write_bytes(adts(100) + adts(57) + b"xxxxxxxxx")
    got = files.read_audio(spark, str(tmp_path / "a.aac"), "adts").orderBy("pos").collect()
    assert [(r.len, r.err) for r in got] == [(100, None), (57, None), (9, "no sync")]
    head = bytes([0xFF, 0xFD, 0xA4, 0x00])
    n = files.layer2_length(head)
    (tmp_path / "a.mp2").write_bytes(b"zz" + (head + bytes(n - 4)) * 2)
    assert n == 144 * 192000 // 48000
    assert [(r.len, r.err) for r in files.read_audio(spark, str(tmp_path / "a.mp2"), "l2").orderBy("pos").collect()] == [(2, "no sync"), (n, None), (n, None)]
    assert (files.ac3_length(20, 0), files.ac3_length(21, 1)) == (768, 836)
    (tmp_path / "a.ac3").write_bytes((b"\x0b\x77\0\0" + bytes([20]) + bytes(763)) * 2)
    assert [r.len for r in files.read_audio(spark, str(tmp_path / "a.ac3"), "ac3").collect()] == [768, 768]


def test_rtp_dump(spark, tmp_path):
    def rtp(body):
        p = struct.pack(">BBHII", 0x80, 96, 1, 2, 3) + body
        return b"RTP " + len(p).to_bytes(4, "big") + p

    data = rtp(b"\x65\0\0\1") + rtp(b"\x7c\x85ab") + rtp(b"\x7c\x45cd") + rtp(b"\x78zz")
    (tmp_path / "x.rtp").write_bytes(data)
    got = files.read_rtp_dump(spark, str(tmp_path / "x.rtp"), base64.b64encode(b"\x67SPS").decode()).orderBy("pos").collect()
    assert [bytes(r.data) if r.data else r.err for r in got] == [b"\0\0\0\1\x67SPS", b"\0\0\0\1\x65\0\0\3\1", b"\0\0\0\1\x65abcd", "packet type 24"]


def test_stamped_packets_in_order(spark, tmp_path):
    stamps = [1, 3, 2, 5, 4, 6]
    (tmp_path / "x.m2ts").write_bytes(b"".join(s.to_bytes(4, "big") + b"\x47" + bytes([s]) * 187 for s in stamps))
    x = records.read_stamped(spark, str(tmp_path / "x.m2ts"))
    for depth in (None, 4):
        got = packets.reorder(x, "stamp", depth).orderBy("out_no").collect()
        assert [r.stamp for r in got] == [1, 2, 3, 4, 5, 6] and bytes(got[0].raw[:2]) == b"\x47\x01"


def test_subtitle_segments():
    page = b"\x0f\x10\0\1" + (8).to_bytes(2, "big") + b"\x05\x00" + b"\x01\0" + b"\0\x10\0\x20"
    region = b"\x0f\x11\0\1" + (6).to_bytes(2, "big") + b"\x01\0" + (720).to_bytes(2, "big") + (60).to_bytes(2, "big")
    got = list(subtitles.segments_of(b"\x20\0" + page + region + b"\x0f\x80\0\1\0\0\xff"))
    assert [g["kind"] for g in got] == ["page", "region", "end"]
    assert got[0]["regions"] == [{"id": 1, "x": 16, "y": 32}] and (got[1]["width"], got[1]["height"]) == (720, 60)


def test_interpolation_does_not_depend_on_chunks(spark):
    rng = random.Random(5)
    rows = [("f", i, 188 * i, 1000 + 300 * i if rng.random() < 0.2 else None) for i in range(300)]
    df = spark.createDataFrame(rows, "source string, n long, pos long, pcr long")
    ways = [[tuple(r) for r in packets.interpolate_pcr(df.repartition(p), c).select("n", "acc_pcr").orderBy("n").collect()] for p, c in ((1, 1 << 20), (5, 7), (3, 64))]
    assert ways[0] == ways[1] == ways[2]
    report = [tuple(packets.pcr_report(df, c).first()) for c in (1 << 20, 11)]
    assert report[0] == report[1]


def test_send_times_do_not_depend_on_chunks(spark):
    rng, at, rows = random.Random(6), 2**33 * 300 - 40_000_000, []
    for i in range(300):
        at += rng.choice([300_000, 300_000, 300_000, 90_000_000, -500_000])
        rows.append(("f", i, 188 * i, at % (2**33 * 300) if i % 3 == 0 else None))
    df = spark.createDataFrame(rows, "source string, n long, pos long, pcr long")
    ways = [[tuple(r) for r in packets.schedule_by_pcr(df.repartition(p), chunk=c).select("n", "epoch", "send_us").orderBy("n").collect()] for p, c in ((1, 1 << 20), (5, 7), (3, 64))]
    assert ways[0] == ways[1] == ways[2] and len({e for _, e, _ in ways[0]}) > 5
    assert all(us >= 0 for _, _, us in ways[0])


def test_sources_are_kept_apart(spark):
    rows = [(s, i, 188 * i, 7, (i + k) % 16, True, False, "x") for k, s in enumerate("ab") for i in range(20)]
    df = spark.createDataFrame(rows, "source string, n long, pos long, pid long, cc long, has_payload boolean, disc boolean, raw string")
    assert {(r.source, r.packets, r.cc_errors) for r in packets.continuity(df).collect()} == {("a", 20, 0), ("b", 20, 0)}
    assert packets.pid_histogram(df).count() == 2


def test_files_in_pieces(spark, tmp_path):
    rng = random.Random(8)
    bodies = {"a.bin": rng.randbytes(30_007), "b.bin": rng.randbytes(4_000) + b"\n", "c.bin": rng.randbytes(10), "d.bin": b"\xef\xbb\xbf" + rng.randbytes(3000), "e.bin": b"\xef\xbb\xbf\n\n" + rng.randbytes(900) + b"\n", "f.bin": b"\n" * 700, "g.bin": b""}
    for name, body in bodies.items():
        (tmp_path / name).write_bytes(body)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2500")  # several splits to a file
    try:
        rows = records.read_chunks(spark, str(tmp_path), piece=1000, whole=500).collect()
        for name, body in bodies.items():
            own = sorted((r.infile, bytes(r.data)) for r in rows if r.source.endswith(name))
            assert b"".join(d for _, d in own) == body
            assert [at for at, _ in own] == [sum(len(d) for _, d in own[:i]) for i in range(len(own))]
        chunks = records.read_chunks(spark, str(tmp_path / "a.bin"), piece=1000, whole=0)
        got = records.cut_records(chunks, 188).orderBy("n").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    whole = bodies["a.bin"]
    assert [(r.n, r.pos, bytes(r.raw)) for r in got] == [(i, 188 * i, whole[188 * i : 188 * i + 188]) for i in range(30_007 // 188)]


@pytest.mark.parametrize("size", [1, 7, 100, 5000])
def test_readers_do_not_depend_on_pieces(size):
    rng = random.Random(size)
    ps = b""
    for i in range(60):
        body = rng.randbytes(rng.randint(1, 40)).replace(b"\0\0\1", b"xyz")
        ps += b"\0\0\1" + bytes([rng.choice([0xE0, 0xC0])]) + len(body).to_bytes(2, "big") + body
    audio = b"".join(bytes([0xFF, 0xF1, 0x50, 0x80, n >> 3 & 255, (n & 7) << 5 | 31, 0xFC]) + bytes(n - 7) for n in (rng.randint(7, 50) for _ in range(50))) + b"rest" * 200

    def fed(reader, data):
        out = []
        for at in range(0, len(data), size):
            out += [dict(r) for r in reader.feed(data[at : at + size], False)]
        return out + [dict(r) for r in reader.feed(b"", True)]

    for reader, data in ((files.program_stream, ps + b"\0\0\1\xb9behind"), (files.program_stream, ps + b"junk" + ps), (files.adts_frames, audio)):
        want = list(files.Resumed(reader).feed(data, True))
        assert fed(files.Resumed(reader, margin=128), data) == want and len(want) > 40
    head = struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1)
    cap = head + b"".join(struct.pack("<IIII", i, i, 60, 60) + ether(udp(rng.randbytes(18)))[:60] for i in range(30))
    assert fed(files.CaptureReader(), cap) == list(files.CaptureReader().feed(cap, True))
    dump = b"".join(b"RTP " + (14).to_bytes(4, "big") + struct.pack(">BBHII", 0x80, 96, i, 2, 3) + b"\x65" + bytes([i]) for i in range(40))
    assert fed(files.RtpDumpReader(), dump) == list(files.RtpDumpReader().feed(dump, True))


def test_pid_reports_do_not_depend_on_chunks(spark):
    rng, rows, cc = random.Random(9), [], {1: 0, 2: 5}
    for i in range(600):
        pid, event = rng.choice([1, 1, 2]), rng.random()
        if event < 0.5:
            cc[pid] = (cc[pid] + 1) % 16
        elif event < 0.6:
            cc[pid] = rng.randrange(16)
        rows.append(("f", i, 188 * i, pid, cc[pid], rng.random() < 0.9, rng.random() < 0.05, rng.choice("ab"), (90_000 * i + rng.choice([0, 0, -200_000])) % 2**33 if rng.random() < 0.5 else None, 27_000 * i))
    df = spark.createDataFrame(rows, "source string, n long, pos long, pid long, cc long, has_payload boolean, disc boolean, raw string, pts long, t long").withColumn("dts", F.col("pts") - F.col("n") % 3 + 1)
    for report in (lambda c: packets.continuity(df, chunk=c), lambda c: packets.continuity(df, compat=True, chunk=c), lambda c: packets.dts_order(df, chunk=c), lambda c: packets.max_rate(df, "t", 135_000, spans=c)):
        ways = [sorted(tuple(r) for r in report(c).collect()) for c in (1 << 20, 1, 2, 17)]
        assert ways[0] == ways[1] == ways[2] == ways[3] and len(ways[0]) == 2
    # by a plain walk
    want = {}
    for pid in (1, 2):
        last, chain, dup, good, bad, wrong = None, 0, 0, 0, 0, 0
        for r in (r for r in rows if r[3] == pid):
            if last is not None and not r[6]:
                if r[4] == last[4] and r[5]:
                    chain += 1
                    dup, good, bad = dup + (chain > 1), good + (r[7] == last[7]), bad + (r[7] != last[7])
                elif r[4] != last[4]:
                    chain, wrong = 0, wrong + (not r[5] or (last[4] + 1) % 16 != r[4])
            last = r
        want[pid] = dup, bad, good, wrong
    got = {r.pid: (r.dup_errors, r.content_errors, r.good_dups, r.cc_errors) for r in packets.continuity(df, chunk=7).collect()}
    assert got == want and min(min(v) for v in want.values()) > 0
