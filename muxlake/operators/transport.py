"""Transport packets: parsing, sections, PES assembly and building, on binary columns.

``packets`` tables here have (source, n, pos, raw) with 188-byte ``raw``. Errors are kept as rows with
``err`` set; ``strict`` functions leave raising to the caller.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from muxlake.functions import codes
from muxlake.functions.bits import be, bits, crc32_mpeg, flag, uint

from . import places
from .elementary import concat_ordered, decode_pts
from .packets import islands

NULL_PID = 0x1FFF


def parse(packets: DataFrame) -> DataFrame:
    """Header fields, adaptation field and payload of each packet.

    Null packets have neither adaptation nor payload; adaptation control 0 is no error.
    """
    raw = F.col("raw")
    head = uint(raw, 0, 4)
    x = packets.select("*", head.alias("_h"), F.length(raw).alias("_len"))
    h = F.col("_h")
    x = x.select(
        "*",
        bits(h, 8, 0x1FFF).cast("int").alias("pid"),
        flag(h, 0x400000).alias("pusi"),
        bits(h, 4, 3).cast("int").alias("afc"),
        bits(h, 0, 15).cast("int").alias("cc"),
        F.when(F.col("_len") != 188, "length").when(bits(h, 24, 255) != 0x47, "sync").alias("err"),
    )
    real = F.col("err").isNull() & (F.col("pid") != NULL_PID)
    adapt_len = F.when(real & F.col("afc").isin(2, 3), uint(raw, 4)).cast("int")
    x = x.withColumn("adapt_len", adapt_len)
    start = F.when(F.col("adapt_len").isNull(), 4).otherwise(5 + F.col("adapt_len"))
    flags = F.when(F.col("adapt_len") > 0, uint(raw, 5))
    has = real & F.col("afc").isin(1, 3) & (start < 188)
    x = x.select(
        "*",
        F.when(F.col("adapt_len") > 0, F.substring(raw, F.lit(6), F.col("adapt_len"))).alias("adapt"),
        F.when(has, F.substring(raw, start + 1, F.lit(188))).alias("payload"),
        F.coalesce(flag(flags, 0x80), F.lit(False)).alias("disc"),
        F.when((F.col("adapt_len") >= 7) & flag(flags, 0x10), clock_field(raw, 6)).alias("pcr"),
        F.when(real & (F.col("adapt_len") > 183), "adaptation length").alias("_bad"),
    )
    return x.withColumn("err", F.coalesce("err", "_bad")).withColumn("has_payload", F.col("payload").isNotNull()).drop("_h", "_len", "_bad")


def clock_field(raw: Column, at: int) -> Column:
    """27 MHz clock from its 6-byte field: 33-bit base times 300, plus the 9-bit extension."""
    return (F.shiftleft(uint(raw, at, 4), 1) + bits(uint(raw, at + 4), 7, 1)) * 300 + uint(raw, at + 4, 2).bitwiseAND(0x1FF)


def adaptation_flags(packets: DataFrame) -> DataFrame:
    """Packets with the adaptation field's flags as columns."""
    f = F.when(F.length("adapt") > 0, uint(F.col("adapt"), 0))
    names = {0x80: "discontinuity", 0x40: "random_access", 0x20: "es_priority", 0x10: "has_pcr", 0x08: "has_opcr", 0x04: "splicing", 0x02: "private_data", 0x01: "extension"}
    return packets.select("*", *[flag(f, m).alias(n) for m, n in names.items()])


def build(packets: DataFrame) -> DataFrame:
    """Adds ``raw``: packets of pid, cc, disc, pcr, payload (at most 184 bytes less adaptation).

    Short payloads are stuffed by the adaptation field. ``pusi`` is taken if there.
    """
    pusi = F.col("pusi") if "pusi" in packets.columns else F.lit(False)
    payload = F.coalesce(F.when(F.col("has_payload"), F.col("payload")) if "has_payload" in packets.columns else F.col("payload"), F.unhex(F.lit("")))
    size = F.length(payload)
    has = F.coalesce(F.col("has_payload"), F.lit(True)) if "has_payload" in packets.columns else size > 0
    timed, disc = F.col("pcr").isNotNull(), F.coalesce(F.col("disc"), F.lit(False))
    base, ext = F.expr("pcr div 300"), F.pmod(F.col("pcr"), F.lit(300))
    clock = F.coalesce(be(F.shiftleft(base, 15).bitwiseOR(0x7E00).bitwiseOR(ext), 6), F.unhex(F.lit("")))
    adapted = timed | disc | (size < 184)
    flags = F.when(disc, 0x80).otherwise(0) + F.when(timed, 0x10).otherwise(0)
    body = F.concat(be(flags, 1), clock)
    alen = F.lit(183) - size
    field = F.when(alen == 0, be(F.lit(0), 1)).otherwise(F.concat(be(alen, 1), body, F.unhex(F.expr("repeat('FF', cast(greatest(0, 183 - length(_p) - 1 - length(_c)) as int))"))))
    x = packets.withColumn("_p", payload).withColumn("_c", clock)
    afc = F.when(adapted & has, 3).when(adapted, 2).otherwise(1)
    head = F.lit(0x47 << 24) + F.when(pusi, 0x400000).otherwise(0) + F.col("pid") * 256 + afc * 16 + F.col("cc") % 16
    return x.withColumn("raw", F.concat(be(head, 4), F.when(adapted, field).otherwise(F.unhex(F.lit(""))), F.col("_p"))).drop("_p", "_c")


def lay_out(built: DataFrame) -> DataFrame:
    """``(source, n, pos, raw)`` of built packets in order: numbers and byte offsets of the new stream."""
    x = places.number(built.select("source", "pos", "raw"), ["source"], places.leading(built, "pos"), ["pos"], "n")
    return x.select("source", "n", (F.col("n") * 188).alias("pos"), "raw")


def number_counters(packets: DataFrame) -> DataFrame:
    """Continuity counters assigned in order for each PID, from 0."""
    x = places.number(packets.drop("cc"), ["source", "pid"], places.leading(packets, "pos"), ["pos"], "cc")
    return x.withColumn("cc", (F.col("cc") % 16).cast("int"))


def sections(packets: DataFrame) -> DataFrame:
    """``(source, pid, pos, table_id, section, crc_ok)``: sections assembled over packets.

    A payload that starts a unit has a pointer field; bytes before the place it points at close the
    section before. An incomplete section is dropped when the next one starts.
    """
    x = packets.where("payload is not null").select("source", "pid", "pos", "pusi", "payload")
    skip = uint(F.col("payload"), 0)
    old = x.where("pusi").select("source", "pid", F.col("pos").alias("pos"), F.lit(0).alias("part"), F.expr("substring(payload, 2)").alias("payload"), skip.alias("size"), F.lit(False).alias("pusi"))
    old = old.where("size > 0").select("source", "pid", "pos", "part", F.expr("substring(payload, 1, cast(size as int))").alias("payload"), "pusi")
    new = x.select("source", "pid", "pos", F.lit(1).alias("part"), F.when(F.col("pusi"), F.substring(F.col("payload"), (skip + 2).cast("int"), F.lit(188))).otherwise(F.col("payload")).alias("payload"), "pusi")
    rows = islands(old.unionByName(new).withColumn("at", F.struct("pos", "part")), ["source", "pid"], "at", F.col("pusi")).where("island > 0")
    joined = rows.groupBy("source", "pid", "island").agg(F.min("pos").alias("pos"), concat_ordered(F.col("at"), F.col("payload")).alias("data"))
    size = uint(F.col("data"), 1, 2).bitwiseAND(0xFFF).cast("int") + 3
    cut = joined.withColumn("size", size).where("length(data) >= size").withColumn("section", F.expr("substring(data, 1, size)"))
    return cut.select("source", "pid", "pos", uint(F.col("section"), 0).cast("int").alias("table_id"), "section", (crc32_mpeg(F.col("section")) == 0).alias("crc_ok"))


def programs(section_table: DataFrame) -> DataFrame:
    """``(source, pos, program_number, pmt_pid)`` of association sections with a good CRC; not program 0."""
    s = F.col("section")
    n = ((F.length(s) - 12) / 4).cast("int")
    rows = section_table.where("pid = 0 and table_id = 0 and crc_ok").where(n > 0).withColumn("i", F.explode(F.sequence(F.lit(0), n - 1)))
    value = lambda at, size: uint(s, F.lit(8) + F.col("i") * 4 + at, size)
    out = rows.select("source", "pos", value(0, 2).alias("program_number"), value(2, 2).bitwiseAND(0x1FFF).alias("pmt_pid"))
    return out.where("program_number <> 0")


def streams(section_table: DataFrame) -> DataFrame:
    """Elementary streams of map sections: a bad CRC is told, not fatal."""

    def split(batches):
        import pyarrow as pa

        schema = pa.schema([("source", pa.string()), ("pos", pa.int64()), ("pmt_pid", pa.int32()), ("program_number", pa.int32()), ("version", pa.int32()), ("pcr_pid", pa.int32()), ("stream_type", pa.int32()), ("elementary_pid", pa.int32()), ("es_info", pa.binary()), ("crc_ok", pa.bool_())])
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                s = r["section"]
                info = (s[10] & 15) << 8 | s[11]
                at, end = 12 + info, len(s) - 4
                while at + 5 <= end:
                    size = (s[at + 3] & 15) << 8 | s[at + 4]
                    rows.append((r["source"], r["pos"], r["pid"], s[3] << 8 | s[4], s[5] >> 1 & 31, (s[8] & 31) << 8 | s[9], s[at], (s[at + 1] & 31) << 8 | s[at + 2], s[at + 5 : at + 5 + size], r["crc_ok"]))
                    at += 5 + size
            cols = list(zip(*rows)) or [[]] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)

    rows = section_table.where("table_id = 2 and length(section) >= 16").select("source", "pos", "pid", "section", "crc_ok")
    return rows.mapInArrow(split, "source string, pos long, pmt_pid int, program_number int, version int, pcr_pid int, stream_type int, elementary_pid int, es_info binary, crc_ok boolean")


def build_programs(table: list[tuple[int, int]], stream_id: int = 1, version: int = 0) -> bytes:
    """An association section; the CRC stands at its end whatever the number of programs."""
    body = b"".join(n.to_bytes(2, "big") + (0xE000 | p).to_bytes(2, "big") for n, p in table)
    return _section(0, stream_id, version, body)


def build_streams(program: int, pcr_pid: int, table: list[tuple[int, int, bytes]], version: int = 0, info: bytes = b"") -> bytes:
    """A map section of (stream type, PID, descriptors)."""
    body = (0xE000 | pcr_pid).to_bytes(2, "big") + (0xF000 | len(info)).to_bytes(2, "big") + info
    body += b"".join(bytes([t]) + (0xE000 | p).to_bytes(2, "big") + (0xF000 | len(d)).to_bytes(2, "big") + d for t, p, d in table)
    return _section(2, program, version, body)


def _section(table_id: int, number: int, version: int, body: bytes) -> bytes:
    from muxlake.functions.bits import crc32_mpeg_of

    size = len(body) + 9
    head = bytes([table_id]) + (0xB000 | size).to_bytes(2, "big") + number.to_bytes(2, "big") + bytes([0xC1 | version << 1, 0, 0])
    return head + body + crc32_mpeg_of(head + body).to_bytes(4, "big")


def descriptors(loop: Column) -> Column:
    """``array<struct<tag, body>>`` of a descriptor loop of up to 64 entries' worth of bytes."""

    @F.pandas_udf("array<struct<tag: int, body: binary>>")
    def split(raw):
        import pandas as pd

        out = []
        for data in raw:
            at, got = 0, []
            while data and at + 2 <= len(data):
                got.append({"tag": data[at], "body": data[at + 2 : at + 2 + data[at + 1]]})
                at += 2 + data[at + 1]
            out.append(got)
        return pd.Series(out)

    return split(loop)


def descriptor_text(tag: Column, body: Column) -> Column:
    """What a descriptor says, for the kinds that name a stream."""
    text = body.cast("string")
    b = lambda i: uint(body, i)
    return (
        F.when(tag == 5, F.concat(F.lit("Registration "), F.substring(text, 1, 4)))
        .when(tag == 9, F.format_string("Conditional access: id %04X PID %d", uint(body, 0, 2), uint(body, 2, 2).bitwiseAND(0x1FFF)))
        .when(tag == 10, F.concat(F.lit("Languages: "), F.substring(text, 1, 3)))
        .when(tag == 40, F.format_string("AVC video: profile %d constraints %02X level %d", b(0), b(1), b(2)))
        .when(tag == 42, "AVC timing and HRD")
        .when(tag == 52, F.format_string("Stereoscopic: %02X", b(0)))
        .when(tag == 56, F.format_string("HEVC video: profile %d tier %d level %d", b(0).bitwiseAND(31), bits(b(0), 5, 1), b(11)))
        .when(tag == 0x56, F.concat(F.lit("Teletext: "), F.substring(text, 1, 3)))
        .when(tag == 0x59, F.concat(F.lit("Subtitling: "), F.substring(text, 1, 3), F.lit(" "), codes.dvb_component_text(b(3))))
        .when(tag == 14, F.format_string("Maximum bit rate: %d bytes a second", uint(body, 0, 3).bitwiseAND(0x3FFFFF) * 50))
        .when(tag == 0x50, F.concat(F.lit("Component: "), F.when(b(0).bitwiseAND(15) == 3, codes.dvb_component_text(b(1))).otherwise(F.format_string("content %d type %02X", b(0).bitwiseAND(15), b(1)))))
        .when(tag == 0x52, F.format_string("Stream identifier: %d", b(0)))
        .when(tag == 0x6A, F.format_string("DVB AC-3: %02X", b(0)))
        .when(tag == 0x81, F.format_string("ATSC AC-3: rate %d bsid %d", bits(b(0), 5, 7), b(0).bitwiseAND(31)))
        .otherwise(F.concat(F.coalesce(codes.descriptor_name(tag), F.format_string("Descriptor %d", tag)), F.lit(": "), F.hex(body)))
    )


def pes_packets(packets: DataFrame) -> DataFrame:
    """PES packets assembled per PID: a unit start opens one; a declared length cuts it.

    Continuation without a start is dropped; a declared length that never fills is dropped, also at
    the end of the file; length 0 runs to the next start. Overlong packets are told and kept.
    """
    x = packets.where("payload is not null").select("source", "pid", "pos", "pusi", "payload")
    x = islands(x, ["source", "pid"], "pos", F.col("pusi")).where("island > 0")
    x = x.groupBy("source", "pid", "island").agg(F.min("pos").alias("pos"), concat_ordered(F.col("pos"), F.col("payload")).alias("data"))
    return decode_pes(x.drop("island"))


def decode_pes(pes: DataFrame) -> DataFrame:
    """Header fields, times and elementary data of PES packets in ``data``."""
    d = F.col("data")
    x = pes.where(uint(d, 0, 3) == 1).withColumn("stream_id", uint(d, 3).cast("int")).withColumn("declared_len", uint(d, 4, 2).cast("int"))
    whole = F.col("declared_len") + 6
    x = x.where((F.col("declared_len") == 0) | (F.length(d) >= whole))
    x = x.withColumn("overlong", (F.col("declared_len") > 0) & (F.length(d) > whole))
    x = x.withColumn("data", F.when(F.col("declared_len") == 0, d).otherwise(F.expr("substring(data, 1, declared_len + 6)")))
    plain = F.col("stream_id").isin(0xBC, 0xBE, 0xBF, 0xF0, 0xF1, 0xF2, 0xF8, 0xFF)
    second = uint(d, 6).bitwiseAND(0xC0) == 0x80
    f = uint(d, 7)
    pts = F.when(~plain & second & flag(f, 0x80), decode_pts(F.substring(d, F.lit(10), F.lit(5)), None))
    dts = F.when(~plain & second & (f.bitwiseAND(0xC0) == 0xC0), decode_pts(F.substring(d, F.lit(15), F.lit(5)), None))
    at = 9 + F.when(f.bitwiseAND(0xC0) == 0xC0, 10).when(flag(f, 0x80), 5).otherwise(0)
    escr = F.when(~plain & second & flag(f, 0x20), _escr(d, at))
    es = F.when(plain, F.expr("substring(data, 7)")).when(second, F.substring(d, (uint(d, 8) + 10).cast("int"), F.length(d))).otherwise(F.expr("substring(data, 7)"))
    return x.select("*", pts["value"].alias("pts"), F.coalesce(dts["value"], pts["value"]).alias("dts"), dts.isNotNull().alias("dts_explicit"), escr.alias("escr"), es.alias("es_data"), F.coalesce(pts["err"], dts["err"]).alias("err"))


def _escr(d: Column, at: Column) -> Column:
    x = lambda i, n: uint(d, at + i, n)
    v = x(0, 6)
    base = F.shiftleft(bits(v, 43, 7), 30) + F.shiftleft(bits(v, 27, 0x7FFF), 15) + bits(v, 11, 0x7FFF)
    return base * 300 + bits(v, 1, 0x1FF)


def pes_header(stream_id: int, size: Column, pts: Column | None = None, dts: Column | None = None) -> Column:
    """A PES header; length 0 where the packet is too long to say."""
    from .elementary import encode_pts

    nothing = F.unhex(F.lit(""))
    times = nothing if pts is None else encode_pts(pts, 2 if dts is None else 3)
    if dts is not None:
        times = F.concat(times, encode_pts(dts, 1))
    n = 0 if pts is None else 5 if dts is None else 10
    flags = 0 if pts is None else 0x80 if dts is None else 0xC0
    declared = F.when(size + 3 + n > 0xFFFF, 0).otherwise(size + 3 + n)
    return F.concat(be(F.lit(0x100 + stream_id), 4), be(declared, 2), be(F.lit(0x800000 | flags << 8 | n), 3), times)


def pes_to_packets(pes: DataFrame) -> DataFrame:
    """PES packets (source, pid, pos, data, pcr) cut into transport packets; the first has the PCR.

    The first packet takes 176 bytes where it has a PCR, others 184; counters run on for each PID.
    """
    first = F.when(F.col("pcr").isNotNull(), 176).otherwise(184)
    x = pes.withColumn("_first", first)
    more = F.greatest(F.lit(0), F.ceil((F.length("data") - F.col("_first")) / 184)).cast("int")
    x = x.withColumn("_k", F.explode(F.sequence(F.lit(0), more)))
    start = F.when(F.col("_k") == 0, 0).otherwise(F.col("_first") + (F.col("_k") - 1) * 184)
    x = x.select("source", "pid", F.struct("pos", F.col("_k").alias("k")).alias("pos"), (F.col("_k") == 0).alias("pusi"), F.when(F.col("_k") == 0, F.col("pcr")).alias("pcr"), F.lit(False).alias("disc"), F.substring(F.col("data"), (start + 1).cast("int"), F.when(F.col("_k") == 0, F.col("_first")).otherwise(184)).alias("payload"))
    return build(number_counters(x))


def with_type_names(stream_table: DataFrame) -> DataFrame:
    """Stream tables with the names of their types."""
    return stream_table.withColumn("type_text", codes.stream_type_text(F.col("stream_type")))


def looks_like_transport(packets: DataFrame, limit: int = 500) -> DataFrame:
    """Per source whether each of the first ``limit`` packets starts with a sync byte."""
    x = packets.where(F.col("n") < limit)
    return x.groupBy("source").agg(F.bool_and(F.coalesce(uint(F.col("raw"), 0) == 0x47, F.lit(False))).alias("is_ts"))
