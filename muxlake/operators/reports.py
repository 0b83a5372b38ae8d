"""Text forms of records, one line a record: ``(source, pos or start, text)`` in columns to sort by."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from muxlake.functions import codes
from muxlake.functions.bits import bits, flag, uint

from . import places
from .transport import descriptor_text, descriptors


def _yes(condition: Column, text: str) -> Column:
    """``text`` where the condition holds, else nothing."""
    return F.when(F.coalesce(condition, F.lit(False)), text).otherwise("")


def packet_lines(packets: DataFrame) -> DataFrame:
    """Transport packets: place, PID, counter, flags, PCR and what the payload starts with."""
    payload = F.col("payload")
    starts_pes = F.coalesce(F.col("pusi") & (uint(payload, 0, 3) == 1), F.lit(False))
    what = F.when(payload.isNull(), " no payload").when(starts_pes, F.concat(F.lit(" PES "), codes.stream_id_text(uint(payload, 3)))).otherwise(F.format_string(" %d bytes", F.length(payload)))
    pcr = F.when(F.col("pcr").isNotNull(), F.format_string(" PCR %d", F.col("pcr"))).otherwise("")
    text = F.concat(F.format_string("PID %04X cc %2d", F.col("pid"), F.col("cc")), _yes(F.col("pusi"), " start"), _yes(F.col("disc"), " discontinuity"), pcr, what)
    return packets.select("source", "pos", text.alias("text"))


def pes_fields(pes: DataFrame) -> DataFrame:
    """PES packets with every flag and optional field of their header (null where absent)."""
    d = F.col("data")
    second = F.coalesce(uint(d, 6).bitwiseAND(0xC0) == 0x80, F.lit(False))
    one, two = F.when(second, uint(d, 6)), F.when(second, uint(d, 7))
    x = pes.select(
        "*",
        second.alias("mpeg2_header"),
        bits(one, 4, 3).alias("scrambling"),
        flag(one, 8).alias("priority"),
        flag(one, 4).alias("aligned"),
        flag(one, 2).alias("copyright"),
        flag(one, 1).alias("original"),
        bits(two, 6, 3).alias("times"),
        flag(two, 0x20).alias("has_escr"),
        flag(two, 0x10).alias("has_rate"),
        flag(two, 8).alias("has_trick"),
        flag(two, 4).alias("has_copy_info"),
        flag(two, 2).alias("has_crc"),
        flag(two, 1).alias("has_extension"),
        F.when(second, uint(d, 8)).alias("header_len"),
    )
    # optional fields follow one another in this order
    at = F.lit(9) + F.when(F.col("times") == 3, 10).when(F.col("times") == 2, 5).otherwise(0) + F.when(F.col("has_escr"), 6).otherwise(0)
    x = x.withColumn("es_rate", F.when(F.col("has_rate"), bits(uint(d, at, 3), 1, 0x3FFFFF)))
    at = at + F.when(F.col("has_rate"), 3).otherwise(0)
    x = x.withColumn("trick_mode", F.when(F.col("has_trick"), bits(uint(d, at), 5, 7)))
    at = at + F.when(F.col("has_trick"), 1).otherwise(0)
    x = x.withColumn("copy_info", F.when(F.col("has_copy_info"), uint(d, at).bitwiseAND(0x7F)))
    at = at + F.when(F.col("has_copy_info"), 1).otherwise(0)
    x = x.withColumn("last_crc", F.when(F.col("has_crc"), uint(d, at, 2)))
    at = at + F.when(F.col("has_crc"), 2).otherwise(0)
    return x.withColumn("extension", F.when(F.col("has_extension"), uint(d, at)))


def pes_lines(pes: DataFrame, types: DataFrame | None = None) -> DataFrame:
    """PES packets (decoded): stream, length, header flags and times.

    ``types`` (source, pid, stream_type) adds the name of the PID's stream type.
    """
    x = pes_fields(pes)
    name = F.lit("")
    if types is not None:
        x = x.join(types, ["source", "pid"], "left")
        name = F.coalesce(F.concat(F.lit(" ("), codes.stream_type_text(F.col("stream_type")), F.lit(")")), F.lit(""))
    times = F.when(F.col("pts").isNull(), "").when(F.col("dts_explicit"), F.format_string(" PTS %d DTS %d", F.col("pts"), F.col("dts"))).otherwise(F.format_string(" PTS %d", F.col("pts")))
    flags = F.concat(_yes(F.col("priority"), " priority"), _yes(F.col("aligned"), " aligned"), _yes(F.col("copyright"), " copyright"), _yes(F.col("original"), " original"), _yes(F.col("scrambling") > 0, " scrambled"))
    extra = F.concat(*[F.when(F.col(c).isNotNull(), F.format_string(f" {k} %d", F.col(c))).otherwise("") for k, c in (("ESCR", "escr"), ("rate", "es_rate"), ("trick", "trick_mode"), ("CRC", "last_crc"))])
    text = F.concat(codes.stream_id_text(F.col("stream_id")), name, F.format_string(" length %d", F.col("declared_len")), flags, times, extra, _yes(F.col("overlong"), " overlong"))
    return x.select("source", "pid", "pos", text.alias("text"))


def program_lines(programs: DataFrame) -> DataFrame:
    """Programs of association tables."""
    n = F.col("program_number")
    text = F.when(n == 0, F.format_string("Network information on PID %04X", F.col("pmt_pid"))).otherwise(F.format_string("Program %d: map on PID %04X", n, F.col("pmt_pid")))
    return programs.select("source", "pos", text.alias("text"))


def table_lines(streams: DataFrame) -> DataFrame:
    """Map tables: line 0 for the program, then one for each stream with its descriptors."""
    table = ["source", "pos", "pmt_pid", "program_number"]
    head = streams.groupBy(*table).agg(F.min("pcr_pid").alias("pcr_pid"), F.min("version").alias("version"), F.count("*").alias("n"))
    head = head.select("source", "pos", "pmt_pid", F.lit(0).alias("line"), F.format_string("Program %d, version %d, PCR on PID %04X, streams: %d", "program_number", "version", "pcr_pid", "n").alias("text"))
    said = F.transform(descriptors(F.col("es_info")), lambda d: descriptor_text(d["tag"], d["body"]))
    said = F.when(F.size(said) > 0, F.concat(F.lit("; "), F.array_join(said, "; "))).otherwise("")
    text = F.concat(F.format_string("PID %04X type %02X ", F.col("elementary_pid"), F.col("stream_type")), codes.stream_type_text(F.col("stream_type")), said)
    rows = streams.select("source", "pos", "pmt_pid", F.col("elementary_pid").cast("int").alias("line"), text.alias("text"))
    return head.unionByName(rows)


def unit_lines(units: DataFrame) -> DataFrame:
    """Start-code units: code, its H.262 name, length and first bytes."""
    head = F.hex(F.expr("substring(data, 5, 8)"))
    text = F.concat(F.format_string("%02X ", F.col("start_code")), codes.start_code_text(F.col("start_code")), F.format_string(", %d bytes: ", F.col("len")), head)
    return units.select("source", "start", text.alias("text"))


def nal_lines(nals: DataFrame) -> DataFrame:
    """H.264 units: reference level, kind, length, and what a parameter set says."""
    sps, pps = F.col("sps"), F.col("pps")
    more = F.when(sps.isNotNull(), F.format_string(" id %d profile %d level %d", sps["id"], sps["profile"], sps["level"])).when(pps.isNotNull(), F.format_string(" id %d of set %d", pps["id"], pps["sps_id"])).otherwise("")
    text = F.concat(F.format_string("%d/%d ", F.col("ref_idc"), F.col("unit_type")), codes.nal_type_text(F.col("unit_type")), F.format_string(", %d bytes", F.col("len")), more, F.coalesce(F.concat(F.lit(" broken: "), F.col("err")), F.lit("")))
    return nals.select("source", "start", text.alias("text"))


def access_unit_lines(units: DataFrame) -> DataFrame:
    """Access units: number, slices, class, reference and size."""
    text = F.concat(F.format_string("Access unit %d: %d slices", F.col("idx"), F.col("slices")), F.coalesce(F.concat(F.lit(" "), F.col("slice_class")), F.lit("")), _yes(F.col("idr"), " IDR"), _yes(F.col("ref"), " reference"), F.coalesce(F.format_string(" frame number %d", F.col("frame_num")), F.lit("")), F.format_string(", %d bytes", F.col("size")))
    return units.select("source", "start", text.alias("text"))


def picture_lines(pictures: DataFrame) -> DataFrame:
    """H.262 pictures, sequence headers and ends."""
    what = F.when(F.col("is_picture"), F.concat(F.col("kind"), F.format_string(" picture %d, %d slices", F.col("temporal_reference"), F.col("slices")))).when(F.col("is_seq_header"), "Sequence header").otherwise("Sequence end")
    afd = F.when(F.col("afd").isNotNull(), F.format_string(" AFD %d", F.col("afd"))).otherwise("")
    return pictures.select("source", "start", F.concat(what, afd, F.format_string(", %d bytes", F.col("size"))).alias("text"))


def avs_lines(frames: DataFrame) -> DataFrame:
    """AVS frames and sequence headers."""
    rate = F.when(F.col("rate_code").isNotNull(), F.format_string(" at %.2f", codes.avs_frame_rate(F.col("rate_code")))).otherwise("")
    what = F.when(F.col("is_seq_header"), F.concat(F.lit("Sequence header"), rate)).when(F.col("kind").isNotNull(), F.concat(F.col("kind"), F.lit(" frame"))).otherwise("Sequence end")
    return frames.select("source", "start", F.concat(what, F.format_string(", %d bytes", F.col("size"))).alias("text"))


def ps_mark(stream_id: Column) -> Column:
    """The characters of a program stream packet: ``[`` pack, ``H`` system header, ``]`` end,
    ``v`` and ``a`` with their number if it is not 0, ``p1`` ``p2`` private, ``M`` map, ``D``
    directory, ``.`` padding, ``?`` else."""
    number = lambda mark, n: F.concat(F.lit(mark), F.when(n > 0, n.cast("string")).otherwise(""))
    fixed = {0xBA: "[", 0xBB: "H", 0xB9: "]", 0xBD: "p1", 0xBF: "p2", 0xBC: "M", 0xFF: "D", 0xBE: "."}
    out = F.when(stream_id.between(0xE0, 0xEF), number("v", stream_id - 0xE0)).when(stream_id.between(0xC0, 0xDF), number("a", stream_id - 0xC0))
    for code, mark in fixed.items():
        out = out.when(stream_id == code, mark)
    return out.otherwise("?")


def ps_dots(ps: DataFrame, max_packs: int | None = None) -> DataFrame:
    """``(source, pack, dots)``: a program stream's packets as characters, a row for each pack."""
    starts = F.coalesce(F.col("stream_id") == 0xBA, F.lit(False)).cast("long")
    x = places.sums_before(ps.select("source", "pos", "stream_id"), ["source"], F.col("pos"), ["pos"], {"pack": starts})
    x = x.withColumn("pack", F.col("pack") + starts).where("pack > 0")
    if max_packs is not None:
        x = x.where(F.col("pack") <= max_packs)
    marks = F.sort_array(F.collect_list(F.struct("pos", ps_mark(F.col("stream_id")).alias("m"))))
    return x.groupBy("source", "pack").agg(F.array_join(F.transform(marks, lambda m: m["m"]), "").alias("dots"))


def progress(rows: DataFrame, every: int, order: str = "n") -> DataFrame:
    """``(source, upto, rows, total)``: rows in each stretch of ``every``, and so far."""
    from pyspark.sql import Window

    step = F.floor(F.col(order) / every)
    own = rows.groupBy("source", step.alias("_s")).agg(F.count("*").alias("rows"))
    so_far = F.sum("rows").over(Window.partitionBy("source").orderBy("_s"))
    return own.select("source", ((F.col("_s") + 1) * every).alias("upto"), "rows", so_far.alias("total"))
