"""Variable-length formats: program streams, captures, audio frames and RTP dumps.

Files of any size and store come in pieces (``records.read_chunks``). A record is found only by
following the one before, so each file's pieces stream in order through one task. They are put
together to blocks and compressed by other tasks before, so that this one sorts and reads little.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from muxlake.functions import codes
from muxlake.functions.bits import bits, uint

from . import records


#: Bytes of a file that are compressed together.
BLOCK = 1 << 20


class Resumed:
    """Feeds a reader of whole files piece by piece: its rows have ``pos`` and ``len``.

    A row is settled once ``margin`` bytes (more than any record has) follow it; the reader then
    starts again behind it. Rows with ``rest`` run to the file's end; one with ``last`` ends the stream.
    """

    def __init__(self, reader: Callable[[bytes], Iterator[dict]], margin: int = 1 << 17):
        self.reader, self.margin = reader, margin
        self.buffer, self.base, self.over, self.rest = b"", 0, False, None

    def feed(self, data: bytes, final: bool) -> Iterator[dict]:
        """Rows settled by more ``data``; with ``final`` all that are left."""
        if self.rest is not None:
            self.rest["len"] += len(data)
        elif not self.over:
            self.buffer += data
            if not final and len(self.buffer) < 4 * self.margin:
                return
            at = 0
            for row in self.reader(self.buffer):
                rest, last = row.pop("rest", False), row.pop("last", False)
                end = row["pos"] + row["len"]
                if not final and not rest and end + self.margin > len(self.buffer):
                    break
                if rest and not final and row["pos"] + self.margin > len(self.buffer):
                    break
                row["pos"] += self.base
                at = end
                if rest:
                    self.rest = row
                    break
                yield row
                if last:
                    self.over = True
                    break
            self.buffer, self.base = self.buffer[at:], self.base + at
        if final and self.rest is not None:
            yield self.rest


def walk_chunks(chunks: DataFrame, begin: Callable[[], object], ddl: str) -> DataFrame:
    """Rows that a reader made by ``begin`` finds in each source of ``(source, infile, data)``.

    The reader's ``feed(data, final)`` takes the pieces in order.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    shape = T.StructType.fromDDL(f"source string, {ddl}")
    schema = to_arrow_schema(shape)

    def run(batches):
        current, reader, rows = None, None, []

        def take(found, source):
            for row in found:
                rows.append({"source": source, **row})
                if len(rows) == 1024:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)
                    rows.clear()

        for batch in batches:
            for source, size, data in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3)):
                if source != current:
                    if reader is not None:
                        yield from take(reader.feed(b"", True), current)
                    current, reader = source, begin()
                yield from take(reader.feed(pa.decompress(data.as_py(), size, "zstd", asbytes=True) if size else b"", False), current)
        if reader is not None:
            yield from take(reader.feed(b"", True), current)
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return _blocks(chunks).repartition("source").sortWithinPartitions("source", "infile").mapInArrow(run, shape)


def _blocks(chunks: DataFrame) -> DataFrame:
    """``(source, infile, size, data)``: pieces that start in one block joined in order, compressed."""
    names = ["source", "infile", "size", "data"]

    def join(batches):
        key, start, held = None, 0, []

        def flush():
            data = b"".join(held)
            return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.string()), pa.array([start], pa.int64()), pa.array([len(data)], pa.int64()), pa.array([pa.compress(data, "zstd", asbytes=True)], pa.binary())], names)

        for batch in batches:
            for source, block, infile, data in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if (source, block) != key:
                    if held:
                        yield flush()
                    key, start, held = (source, block), infile, []
                held.append(data or b"")
        if held:
            yield flush()

    x = chunks.select("source", F.floor(F.col("infile") / BLOCK).alias("block"), "infile", "data")
    return x.repartition("source", "block").sortWithinPartitions("source", "block", "infile").mapInArrow(join, "source string, infile long, size long, data binary")


# --- program streams -----------------------------------------------------------------------------

PS = "pos long, stream_id int, len int, data binary, scr long, mux_rate int, mpeg1 boolean, err string"


def pack_header(d: bytes) -> tuple[int, int, int, bool]:
    """Length, 27 MHz reference, rate and MPEG-1 flag of the pack header after its start code."""
    if d[0] >> 6 == 1:
        v = int.from_bytes(d[:6], "big")
        base = (v >> 43 & 7) << 30 | (v >> 27 & 0x7FFF) << 15 | v >> 11 & 0x7FFF
        return 10 + (d[9] & 7), base * 300 + (v >> 1 & 0x1FF), int.from_bytes(d[6:9], "big") >> 2, False
    v = int.from_bytes(d[:5], "big")
    base = (v >> 33 & 7) << 30 | (v >> 17 & 0x7FFF) << 15 | v >> 1 & 0x7FFF
    return 8, base * 300, int.from_bytes(d[5:8], "big") >> 1 & 0x3FFFFF, True


def program_stream(d: bytes) -> Iterator[dict]:
    """Packets of a program stream up to its end code; garbage is told and skipped to the next pack.

    Zero bytes before a start code are allowed; a packet of length 0 is an error.
    """
    row = {"scr": None, "mux_rate": None, "mpeg1": None, "err": None}
    at = 0
    while at + 4 <= len(d):
        if d[at : at + 3] != b"\x00\x00\x01":
            if d[at] == 0 and d[at + 1] == 0:
                at += 1
                continue
            to = d.find(b"\x00\x00\x01\xba", at)
            yield row | {"pos": at, "stream_id": None, "len": (to if to >= 0 else len(d)) - at, "data": None, "err": "no start code"}
            if to < 0:
                return
            at = to
            continue
        kind = d[at + 3]
        if kind == 0xB9:
            yield row | {"pos": at, "stream_id": kind, "len": 4, "data": d[at : at + 4], "last": True}
            return
        if kind == 0xBA:
            if at + 14 > len(d):
                return
            size, scr, rate, old = pack_header(d[at + 4 : at + 18])
            yield row | {"pos": at, "stream_id": kind, "len": size + 4, "data": d[at : at + 4 + size], "scr": scr, "mux_rate": rate, "mpeg1": old}
            at += 4 + size
            continue
        size = int.from_bytes(d[at + 4 : at + 6], "big")
        bad = "length 0" if size == 0 else "short" if at + 6 + size > len(d) else None
        yield row | {"pos": at, "stream_id": kind, "len": size + 6, "data": d[at : at + 6 + size], "err": bad}
        at += 6 + size


def program_packets(chunks: DataFrame) -> DataFrame:
    """Packets and pack headers of program streams in pieces."""
    return walk_chunks(chunks, lambda: Resumed(program_stream), PS)


def read_program_stream(spark: SparkSession, path: str) -> DataFrame:
    """Packets and pack headers of program streams."""
    return program_packets(records.read_chunks(spark, path))


def classify_private(d: bytes, dvd: bool) -> tuple[str, int | None]:
    """Kind and number of the substream in a private_stream_1 payload.

    On a DVD the first byte names the substream; otherwise sync words tell.
    """
    if not d:
        return "error", None
    if dvd:
        n = d[0]
        if 0x20 <= n <= 0x3F:
            return "subpicture", n & 0x1F
        if 0x80 <= n <= 0x87:
            return "AC3", n & 7
        if 0x88 <= n <= 0x8F:
            return "DTS", n & 7
        if 0xA0 <= n <= 0xAF:
            return "LPCM", n & 15
        return "other", n
    if d[:2] == b"\x0b\x77":
        return "AC3", 0
    if d[:4] == b"\x7f\xfe\x80\x01":
        return "DTS", 0
    return "other", None


def substreams(ps: DataFrame, dvd: bool = False) -> DataFrame:
    """Program stream packets with ``kind`` and ``number`` of what they carry."""
    schema = T.StructType([*ps.schema.fields, T.StructField("kind", T.StringType()), T.StructField("number", T.IntegerType())])

    def run(batches):
        for batch in batches:
            kinds, numbers = [], []
            for i, d in zip(batch.column(batch.schema.get_field_index("stream_id")).to_pylist(), batch.column(batch.schema.get_field_index("data")).to_pylist()):
                if i is not None and 0xE0 <= i <= 0xEF:
                    kind = "video", i & 15
                elif i is not None and 0xC0 <= i <= 0xDF:
                    kind = "audio", i & 31
                elif i == 0xBD and d is not None:
                    head = 9 + d[8] if len(d) > 8 and d[6] >> 6 == 2 else 6
                    kind = classify_private(d[head:], dvd)
                else:
                    kind = "other", i
                kinds.append(kind[0])
                numbers.append(kind[1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(kinds), pa.array(numbers, pa.int32())], names=schema.names)

    return ps.mapInArrow(run, schema)


def stream_sizes(classified: DataFrame) -> DataFrame:
    """Count, least, greatest and mean length for each kind and number of stream."""
    return classified.where("kind <> 'other' or stream_id = 189").groupBy("source", "kind", "number").agg(F.count("*").alias("packets"), F.min("len").alias("min_len"), F.max("len").alias("max_len"), F.expr("sum(len) div count(*)").alias("mean_len"))


# --- captures ------------------------------------------------------------------------------------

NET = "pkt_no long, sec long, usec long, t90 long, vlans array<struct<vid: int, cfi: int, pcp: int>>, src_ip long, dst_ip long, src_port int, dst_port int, ident int, fragment int, more boolean, proto int, payload binary, rtp struct<pt: int, seq: int, ts: long, ssrc: long, marker: boolean>, err string"


class CaptureReader:
    """Packets of a pcap or pcapng file, either byte order, fed in pieces.

    pcapng times use the interface's resolution where it is stated, microseconds otherwise.
    """

    def __init__(self, raw_type: int | None = None):
        self.raw_type, self.no = raw_type, 0
        self.buffer, self.order, self.units, self.per = b"", None, None, 1

    def feed(self, data: bytes, final: bool) -> Iterator[dict]:
        """Rows of the packets completed by more ``data``."""
        self.buffer += data
        for sec, usec, frame in self.records(final):
            yield network_packet(self.no, sec, usec, frame, self.raw_type)
            self.no += 1

    def records(self, final: bool) -> Iterator[tuple[int, int, bytes]]:
        """Seconds, microseconds and bytes of each whole packet in the buffer."""
        d, at = self.buffer, 0
        if self.order is None and len(d) >= 24:
            if d[:4] == b"\x0a\x0d\x0d\x0a":
                self.order, self.units = "<", []
            else:
                self.order = {b"\xd4\xc3\xb2\xa1": "<", b"\xa1\xb2\xc3\xd4": ">", b"\x4d\x3c\xb2\xa1": "<", b"\xa1\xb2\x3c\x4d": ">"}.get(d[:4])
                if self.order is None:
                    raise ValueError("neither pcap nor pcapng")
                self.per = 1000 if d[:4] in (b"\x4d\x3c\xb2\xa1", b"\xa1\xb2\x3c\x4d") else 1
                at = 24
        if self.order is not None and self.units is None:
            while at + 16 <= len(d):
                sec, frac, n, _ = struct.unpack_from(self.order + "IIII", d, at)
                if at + 16 + n > len(d) and not final:
                    break
                yield sec, frac // self.per, d[at + 16 : at + 16 + n]
                at += 16 + n
        elif self.order is not None:
            while at + 12 <= len(d):
                if d[at : at + 4] == b"\x0a\x0d\x0d\x0a":
                    self.order = "<" if d[at + 8 : at + 12] == b"\x4d\x3c\x2b\x1a" else ">"
                    self.units = []
                kind, size = struct.unpack_from(self.order + "II", d, at)
                if size < 12 or at + size > len(d):
                    break
                found = self._block(kind, d[at + 8 : at + size - 4])
                if found:
                    yield found
                at += size
        self.buffer = d[at:]

    def _block(self, kind: int, body: bytes) -> tuple[int, int, bytes] | None:
        """The packet of a pcapng block, if it has one; an interface's time unit is noted."""
        if kind == 1:
            unit, o = 10**6, 8
            while o + 4 <= len(body):
                code, n = struct.unpack_from(self.order + "HH", body, o)
                if code == 0:
                    break
                if code == 9 and n >= 1:
                    unit = 2 ** (body[o + 4] & 127) if body[o + 4] & 128 else 10 ** body[o + 4]
                o += 4 + (n + 3 & ~3)
            self.units.append(unit)
        elif kind == 6:
            port, high, low, n, _ = struct.unpack(self.order + "IIIII", body[:20])
            unit = self.units[port] if port < len(self.units) else 10**6
            t = high << 32 | low
            return t // unit, t % unit * 10**6 // unit, body[20 : 20 + n]
        elif kind == 3:
            return 0, 0, body[4:]
        return None


def rtp_header(d: bytes, raw_type: int | None = None) -> tuple[dict | None, bytes]:
    """RTP fields and payload of a datagram: version 2, payload type 33 or the wanted one."""
    if len(d) < 12 or d[0] >> 6 != 2 or d[1] & 127 not in (33, raw_type):
        return None, d
    at = 12 + 4 * (d[0] & 15)
    if d[0] & 16 and at + 4 <= len(d):
        at += 4 + 4 * int.from_bytes(d[at + 2 : at + 4], "big")
    end = len(d) - (d[-1] if d[0] & 32 else 0)
    seq, ts, ssrc = struct.unpack(">HII", d[2:12])
    return {"pt": d[1] & 127, "seq": seq, "ts": ts, "ssrc": ssrc, "marker": bool(d[1] & 128)}, d[at:end]


def network_packet(no: int, sec: int, usec: int, frame: bytes, raw_type: int | None = None) -> dict:
    """Ethernet, stacked VLANs, IPv4, UDP and RTP of a captured packet."""
    row = dict.fromkeys(("src_ip", "dst_ip", "src_port", "dst_port", "ident", "fragment", "more", "proto", "payload", "rtp", "err"))
    row |= {"pkt_no": no, "sec": sec, "usec": usec, "t90": sec * 90000 + usec * 9 // 100, "vlans": []}
    at = 12
    while frame[at : at + 2] in (b"\x81\x00", b"\x88\xa8", b"\x91\x00"):
        tag = int.from_bytes(frame[at + 2 : at + 4], "big")
        row["vlans"].append({"vid": tag & 0xFFF, "cfi": tag >> 12 & 1, "pcp": tag >> 13})
        at += 4
    ip = frame[at + 2 :]
    if frame[at : at + 2] != b"\x08\x00" or len(ip) < 20 or ip[0] >> 4 != 4:
        return row | {"err": "not IPv4"}
    head, total = (ip[0] & 15) * 4, int.from_bytes(ip[2:4], "big")
    flags = int.from_bytes(ip[6:8], "big")
    row |= {"ident": int.from_bytes(ip[4:6], "big"), "fragment": (flags & 0x1FFF) * 8, "more": bool(flags & 0x2000), "proto": ip[9], "src_ip": int.from_bytes(ip[12:16], "big"), "dst_ip": int.from_bytes(ip[16:20], "big")}
    body = ip[head:total]
    if row["fragment"] or row["more"] or ip[9] != 17:
        return row | {"payload": body}
    return row | _datagram(body, raw_type)


def _datagram(body: bytes, raw_type: int | None) -> dict:
    if len(body) < 8:
        return {"err": "short UDP"}
    rtp, payload = rtp_header(body[8 : int.from_bytes(body[4:6], "big")], raw_type)
    return {"src_port": int.from_bytes(body[:2], "big"), "dst_port": int.from_bytes(body[2:4], "big"), "rtp": rtp, "payload": payload}


def read_capture(spark: SparkSession, path: str, raw_type: int | None = None) -> DataFrame:
    """Network packets of pcap and pcapng files."""
    return capture_packets(records.read_chunks(spark, path), raw_type)


def capture_start(packets: DataFrame) -> DataFrame:
    """``(source, start)``: the day and time (UTC) of each capture's first packet."""
    first = packets.groupBy("source").agg(F.min_by(F.struct("sec", "usec"), "pkt_no").alias("t"))
    at = F.timestamp_micros(F.col("t.sec") * 1_000_000 + F.col("t.usec"))
    return first.select("source", F.date_format(F.to_utc_timestamp(at, F.current_timezone()), "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("start"))


def capture_packets(chunks: DataFrame, raw_type: int | None = None) -> DataFrame:
    """Network packets of pcap and pcapng files in pieces."""
    return walk_chunks(chunks, lambda: CaptureReader(raw_type), NET)


def reassemble_fragments(packets: DataFrame) -> DataFrame:
    """Datagrams out of IPv4 fragments that came in order, by (addresses, identification)."""
    ddl = "src_port int, dst_port int, payload binary"
    parts = packets.where("err is null and proto = 17 and (fragment > 0 or more)")
    done = parts.groupBy("source", "src_ip", "dst_ip", "ident").agg(F.min("pkt_no").alias("pkt_no"), F.min("t90").alias("t90"), F.sort_array(F.collect_list(F.struct("fragment", "more", "payload"))).alias("parts"))
    shape = T.StructType([T.StructField("source", T.StringType()), *T.StructType.fromDDL(f"src_ip long, dst_ip long, ident int, pkt_no long, t90 long, {ddl}").fields])

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(shape)
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                data = b""
                for p in r["parts"]:
                    if p["fragment"] != len(data):
                        break
                    data += p["payload"]
                else:
                    if not r["parts"][-1]["more"]:
                        got = _datagram(data, None)
                        rows.append({k: v for k, v in {**r, **got}.items() if k in shape.names})
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return done.mapInArrow(run, shape)


# --- audio ---------------------------------------------------------------------------------------

# fixed values: layer 2 bit rates (kbit/s) by index for MPEG-1 and MPEG-2; sample rates
L2_RATES = ((0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384), (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160))
L2_SAMPLES = ((44100, 48000, 32000), (22050, 24000, 16000))
# fixed values: AC-3 bit rates (kbit/s) by half the frame size code, sample rates
AC3_RATES = (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384, 448, 512, 576, 640)
AC3_SAMPLES = (48000, 44100, 32000)


def adts_frames(d: bytes) -> Iterator[dict]:
    """ADTS frames, lengths from their headers; bytes without a sync word end in an error row."""
    at = 0
    while at + 7 <= len(d):
        if d[at] != 0xFF or d[at + 1] & 0xF6 != 0xF0:
            yield {"pos": at, "len": len(d) - at, "data": None, "err": "no sync", "rest": True}
            return
        size = int.from_bytes(d[at + 3 : at + 6], "big") >> 5 & 0x1FFF
        if size < 7 or at + size > len(d):
            yield {"pos": at, "len": len(d) - at, "data": None, "err": "short"}
            return
        yield {"pos": at, "len": size, "data": d[at : at + size], "err": None}
        at += size


def layer2_length(head: bytes) -> int | None:
    """Frame length from a layer 2 header, or nothing if it is none."""
    if len(head) < 4 or head[0] != 0xFF or head[1] & 0xE0 != 0xE0:
        return None
    version, layer = head[1] >> 3 & 3, head[1] >> 1 & 3
    rate, sample, pad = head[2] >> 4, head[2] >> 2 & 3, head[2] >> 1 & 1
    if layer != 2 or version == 1 or rate in (0, 15) or sample == 3:
        return None
    old = 0 if version == 3 else 1
    hz = L2_SAMPLES[old][sample] // (2 if version == 0 else 1)
    return 144 * L2_RATES[old][rate] * 1000 // hz + pad


def layer2_frames(d: bytes) -> Iterator[dict]:
    """Layer 2 frames; after lost sync the next header is searched for."""
    at = 0
    while at + 4 <= len(d):
        size = layer2_length(d[at : at + 4])
        if size is None or at + size > len(d):
            to = next((i for i in range(at + 1, len(d) - 3) if layer2_length(d[i : i + 4])), len(d))
            yield {"pos": at, "len": to - at, "data": None, "err": "no sync"}
            at = to
            continue
        yield {"pos": at, "len": size, "data": d[at : at + size], "err": None}
        at += size


def ac3_length(code: int, sample: int) -> int | None:
    """AC-3 frame length in bytes of a frame size code and sample rate code."""
    if sample > 2 or code // 2 >= len(AC3_RATES):
        return None
    words = AC3_RATES[code // 2] * 1000 * 1536 // (AC3_SAMPLES[sample] * 16)
    return 2 * (words + (code & 1 if sample == 1 else 0))


def ac3_frames(d: bytes) -> Iterator[dict]:
    """AC-3 frames."""
    at = 0
    while at + 7 <= len(d):
        size = ac3_length(d[at + 4] & 63, d[at + 4] >> 6) if d[at : at + 2] == b"\x0b\x77" else None
        if size is None or at + size > len(d):
            yield {"pos": at, "len": len(d) - at, "data": None, "err": "no sync" if size is None else "short", "rest": size is None}
            return
        yield {"pos": at, "len": size, "data": d[at : at + size], "err": None}
        at += size


def ac3_details(frames: DataFrame) -> DataFrame:
    """AC-3 frames with sample rate code, bit stream version and mode, and channel layout."""
    d = F.col("data")
    bsmod, acmod = uint(d, 5).bitwiseAND(7), bits(uint(d, 6), 5, 7)
    return frames.select("*", bits(uint(d, 4), 6, 3).alias("fscod"), bits(uint(d, 5), 3, 31).alias("bsid"), bsmod.alias("bsmod"), acmod.alias("acmod"), codes.service_text(bsmod, acmod).alias("service"))


AUDIO = {"adts": adts_frames, "l2": layer2_frames, "ac3": ac3_frames}


def read_audio(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Audio frames of files of one kind: adts, l2 or ac3."""
    return audio_frames(records.read_chunks(spark, path), kind)


def audio_frames(chunks: DataFrame, kind: str) -> DataFrame:
    """Audio frames of files in pieces."""
    return walk_chunks(chunks, lambda: Resumed(AUDIO[kind]), "pos long, len long, data binary, err string")


# --- RTP dumps of H.264 --------------------------------------------------------------------------


class RtpDumpReader:
    """NAL units out of an RTP dump (``RTP `` and a length before each packet), fed in pieces.

    Single units and fragments (type 28) are re-escaped; other packet types are told.
    ``parameter_sets`` is comma-separated base64, written first.
    """

    def __init__(self, parameter_sets: str = ""):
        import base64

        self.first = [b"\x00\x00\x00\x01" + base64.b64decode(t) for t in filter(None, parameter_sets.split(","))]
        self.buffer, self.base, self.parts, self.start = b"", 0, b"", 0

    def feed(self, data: bytes, final: bool) -> Iterator[dict]:
        """Rows of the packets completed by more ``data``."""
        for own in self.first:
            yield {"pos": -1, "data": own, "err": None}
        self.first = []
        self.buffer += data
        d, at = self.buffer, 0
        while at + 8 <= len(d) and d[at : at + 4] == b"RTP ":
            size = int.from_bytes(d[at + 4 : at + 8], "big")
            if at + 8 + size > len(d) and not final:
                break
            row = self._unit(self.base + at, d[at + 8 : at + 8 + size])
            if row:
                yield row
            at += 8 + size
        self.buffer, self.base = d[at:], self.base + at

    def _unit(self, pos: int, packet: bytes) -> dict | None:
        from muxlake.functions.bits import escape

        rtp, body = rtp_header(packet, packet[1] & 127 if len(packet) > 1 else None)
        if rtp is None or not body:
            return {"pos": pos, "data": None, "err": "not RTP"}
        kind = body[0] & 31
        if 1 <= kind <= 23:
            return {"pos": pos, "data": b"\x00\x00\x00\x01" + body[:1] + escape(body[1:]), "err": None}
        if kind != 28 or len(body) < 2:
            return {"pos": pos, "data": None, "err": f"packet type {kind}"}
        if body[1] & 0x80:
            self.parts, self.start = bytes([body[0] & 0xE0 | body[1] & 31]), pos
        self.parts += body[2:]
        if body[1] & 0x40:
            return {"pos": self.start, "data": b"\x00\x00\x00\x01" + self.parts[:1] + escape(self.parts[1:]), "err": None}
        return None


def rtp_units(chunks: DataFrame, parameter_sets: str = "") -> DataFrame:
    """H.264 units of RTP dumps in pieces."""
    return walk_chunks(chunks, lambda: RtpDumpReader(parameter_sets), "pos long, data binary, err string")


def read_rtp_dump(spark: SparkSession, path: str, parameter_sets: str = "") -> DataFrame:
    """H.264 units of RTP dumps."""
    return rtp_units(records.read_chunks(spark, path), parameter_sets)


def stream_kind(d: bytes) -> str:
    """TS, PS, or neither (perhaps an elementary stream) by a file's first bytes."""
    if len(d) >= 188 and all(d[i] == 0x47 for i in range(0, min(len(d), 188 * 500), 188)):
        return "TS"
    if d[:4] == b"\x00\x00\x01\xba" and len(d) > 4 and (d[4] >> 6 == 1 or d[4] >> 4 == 2):
        return "PS"
    return "ES?"


def detect(spark: SparkSession, path: str) -> DataFrame:
    """``(source, kind)`` of each file, by its first piece."""

    def run(batches):
        for batch in batches:
            kinds = [stream_kind(d or b"") for d in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kinds, pa.string())], ["source", "kind"])

    head = records.read_chunks(spark, path).where("infile = 0").select("source", F.expr(f"substring(data, 1, {188 * 500})").alias("data"))
    return head.mapInArrow(run, "source string, kind string")
