"""Conversions between elementary, transport and program streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from muxlake.functions import codes
from muxlake.functions.bits import be, bits, flag, uint

from . import places, transport
from .packets import islands


def extract_pid(packets: DataFrame, pid: int | Column) -> DataFrame:
    """``(source, pos, es_data)``: payload of one PID without PES headers, in PES packets by place.

    ``packets`` are parsed transport packets.
    """
    chosen = packets.where((F.col("pid") == pid) if isinstance(pid, int) else pid)
    return transport.pes_packets(chosen).select("source", "pid", "pos", "es_data")


def extract_first(packets: DataFrame, video: bool = True) -> DataFrame:
    """The first video (or audio) stream that the program tables name."""
    kind = codes.is_video_type if video else codes.is_audio_type
    tables = transport.streams(transport.sections(packets))
    first = tables.where(kind(F.col("stream_type"))).groupBy("source").agg(F.min(F.struct("pos", "elementary_pid"))["elementary_pid"].alias("es_pid")).withColumnRenamed("source", "es_source")
    own = packets.join(first, (F.col("source") == F.col("es_source")) & (F.col("pid") == F.col("es_pid"))).drop("es_source", "es_pid")
    return transport.pes_packets(own).select("source", "pid", "pos", "es_data")


def _table_packets(spark: SparkSession, pat: bytes, pmt: bytes, pmt_pid: int) -> list[tuple[int, int, bytes]]:
    out = []
    for pid, section in ((0, pat), (pmt_pid, pmt)):
        data = b"\0" + section
        out += [(pid, i // 184, data[i : i + 184].ljust(184, b"\xff")) for i in range(0, len(data), 184)]
    return out


def program_packets(at: DataFrame, program: int, pcr_pid: int, streams: list[tuple[int, int, bytes]], pmt_pid: int = 0x66) -> DataFrame:
    """Unbuilt packets of the association and map tables, once for each row ``(source, pos)`` of ``at``."""
    pat, pmt = transport.build_programs([(program, pmt_pid)]), transport.build_streams(program, pcr_pid, streams)
    rows = [F.struct(F.lit(pid).cast("long").alias("pid"), F.lit(k).alias("k"), F.lit(bytearray(data)).alias("payload")) for pid, k, data in _table_packets(at.sparkSession, pat, pmt, pmt_pid)]
    x = at.withColumn("_p", F.explode(F.array(*rows)))
    return x.select("source", F.col("_p.pid").alias("pid"), F.struct("pos", F.when(F.col("_p.pid") == 0, 0).otherwise(1).alias("rank"), F.col("_p.k").alias("k")).alias("pos"), (F.col("_p.k") == 0).alias("pusi"), F.lit(None).cast("long").alias("pcr"), F.lit(False).alias("disc"), F.col("_p.payload").alias("payload"))


def _cut(pes: DataFrame) -> DataFrame:
    """PES rows (source, pid, pos, data, pcr) as unbuilt packets behind any tables at their place."""
    first = F.when(F.col("pcr").isNotNull(), 176).otherwise(184)
    x = pes.withColumn("_first", first)
    more = F.greatest(F.lit(0), F.ceil((F.length("data") - F.col("_first")) / 184)).cast("int")
    x = x.withColumn("_k", F.explode(F.sequence(F.lit(0), more)))
    start = F.when(F.col("_k") == 0, 0).otherwise(F.col("_first") + (F.col("_k") - 1) * 184)
    part = F.substring(F.col("data"), (start + 1).cast("int"), F.when(F.col("_k") == 0, F.col("_first")).otherwise(184))
    return x.select("source", "pid", F.struct("pos", F.lit(2).alias("rank"), F.col("_k").alias("k")).alias("pos"), (F.col("_k") == 0).alias("pusi"), F.when(F.col("_k") == 0, F.col("pcr")).alias("pcr"), F.lit(False).alias("disc"), part.alias("payload"))


def multiplex(pes: DataFrame, tables: DataFrame) -> DataFrame:
    """One transport stream of PES rows and table packets, in order, with counters: adds ``raw``."""
    return transport.build(transport.number_counters(_cut(pes).unionByName(tables)))


def es_to_transport(units: DataFrame, stream_type: int = 0x1B, pid: int = 0x68, program: int = 1, stream_id: int = 0xE0) -> DataFrame:
    """Start-code units as a transport stream: a PES packet for each, tables at the start."""
    pes = units.select("source", F.lit(pid).cast("long").alias("pid"), F.col("start").alias("pos"), F.concat(transport.pes_header(stream_id, F.length("data")), F.col("data")).alias("data"), F.lit(None).cast("long").alias("pcr"))
    at = units.groupBy("source").agg(F.min("start").alias("pos"))
    return multiplex(pes, program_packets(at, program, pid, [(stream_type, pid, b"")]))


def ps_to_transport(ps: DataFrame, video_type: int = 0x02, audio_type: int = 0x03, video_pid: int = 0x68, audio_pid: int = 0x67, program: int = 1, every: int = 100) -> DataFrame:
    """Program stream packets as a transport stream: first video and first audio stream.

    The system reference of a pack is the PCR of the first video packet after it; tables come at the
    start and before every ``every``-th pack.
    """
    w = Window.partitionBy("source").orderBy("pos")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    x = islands(ps.where("err is null"), ["source"], "pos", F.col("stream_id") == 0xBA, "pack").withColumn("scr", F.last("scr", True).over(run))
    first = x.groupBy("source").agg(F.min(F.when(codes.is_video_id(F.col("stream_id")), F.struct("pos", "stream_id")))["stream_id"].alias("v"), F.min(F.when(codes.is_audio_id(F.col("stream_id")), F.struct("pos", "stream_id")))["stream_id"].alias("a")).withColumnRenamed("source", "s")
    own = x.join(first, F.col("source") == F.col("s")).where((F.col("stream_id") == F.col("v")) | (F.col("stream_id") == F.col("a")))
    video = F.col("stream_id") == F.col("v")
    nth = F.row_number().over(Window.partitionBy("source", "pack", "stream_id").orderBy("pos"))
    pes = own.select("source", F.when(video, video_pid).otherwise(audio_pid).cast("long").alias("pid"), "pos", "data", F.when(video & (nth == 1), F.col("scr")).alias("pcr"))
    at = x.where((F.col("stream_id") == 0xBA) & ((F.col("pack") - 1) % every == 0)).select("source", "pos")
    return multiplex(pes, program_packets(at, program, video_pid, [(video_type, video_pid, b""), (audio_type, audio_pid, b"")]))


def pack_header(scr: Column, rate: int = 25_000) -> Column:
    """A pack header with a 27 MHz reference."""
    base, ext = F.floor(scr / 300).cast("long"), F.pmod(scr, F.lit(300))
    v = F.shiftleft(bits(base, 30, 7), 43) + F.shiftleft(bits(base, 15, 0x7FFF), 27) + F.shiftleft(bits(base, 0, 0x7FFF), 11) + ext * 2 + F.lit(1 << 46 | 1 << 42 | 1 << 26 | 1 << 10 | 1)
    return F.concat(be(F.lit(0x1BA), 4), be(v, 6), be(F.lit(rate << 2 | 3), 3), be(F.lit(0xF8), 1))


def transport_to_ps(pes: DataFrame, limit: int = 0xFFFF - 3) -> DataFrame:
    """PES rows (source, pos, stream_id, es_data, pts) as program stream pieces in order.

    A packet too long for a declared length is split; each packet is led by a pack header whose
    reference is its PTS or, without one, the last.
    """
    w = Window.partitionBy("source").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    x = pes.withColumn("_t", F.coalesce(F.last("pts", True).over(w), F.lit(0)))
    n = F.greatest(F.lit(1), F.ceil(F.length("es_data") / limit)).cast("int")
    x = x.withColumn("k", F.explode(F.sequence(F.lit(0), n - 1)))
    part = F.substring(F.col("es_data"), F.col("k") * limit + 1, F.lit(limit))
    head = F.concat(be(F.lit(0x100) + F.col("stream_id"), 4), be(F.length(part) + 3, 2), be(F.lit(0x800000), 3))
    return x.select("source", F.struct("pos", "k").alias("pos"), F.concat(pack_header(F.col("_t") * 300), head, part).alias("data"))


def null_packets(spark: SparkSession, source: str, count: int) -> DataFrame:
    """Null packets."""
    return spark.range(count).select(F.lit(source).alias("source"), F.col("id").alias("n"), F.concat(be(F.lit(0x471FFF10), 4), F.unhex(F.lit("FF" * 184))).alias("raw"))


def pad(pes: DataFrame, n: int) -> DataFrame:
    """Each PES row followed by ``n`` dummy packets of its size (padding stream)."""
    x = pes.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(n))))
    dummy = F.concat(be(F.lit(0x1BE), 4), be(F.least(F.length("data") - 6, F.lit(0xFFFF)), 2), F.unhex(F.expr("repeat('FF', greatest(0, length(data) - 6))")))
    return x.select(*[F.when(F.col("_k") == 0, F.col("data")).otherwise(dummy).alias("data") if c == "data" else F.col(c) for c in pes.columns], F.col("_k").alias("padding"))


def merge_av(video: DataFrame, audio: DataFrame, frame_rate: float = 25.0, audio_samples: int = 1024, sample_rate: int = 44100, stream_type: int = 0x1B, audio_type: int = 0x0F, video_pid: int = 0x68, audio_pid: int = 0x67, program: int = 1, repeat: int = 100) -> DataFrame:
    """Video and audio frames, each in order by ``idx`` with ``data``, as one transport stream.

    Frame times follow from the rates; audio goes before a video frame only while it is earlier.
    Video packets carry the PCR; tables come before every ``repeat``-th video frame.
    """
    number = lambda x: places.number(x.select("source", "idx", "data"), ["source"], places.leading(x, "idx"), ["idx"], "i").drop("idx")
    v = number(video).withColumn("pts", F.floor(F.col("i") * 90000 / frame_rate).cast("long"))
    a = number(audio).withColumn("pts", F.floor(F.col("i") * 90000 * audio_samples / sample_rate).cast("long"))
    rows = v.select("source", "data", "pts", "i", F.lit(0).alias("kind")).unionByName(a.select("source", "data", "pts", "i", F.lit(1).alias("kind")))
    pos = F.struct("pts", "kind", "i")
    is_video = F.col("kind") == 0
    header = F.when(is_video, transport.pes_header(0xE0, F.length("data"), F.col("pts") + 45000)).otherwise(transport.pes_header(0xC0, F.length("data"), F.col("pts") + 45000))
    pes = rows.select("source", F.when(is_video, video_pid).otherwise(audio_pid).cast("long").alias("pid"), pos.alias("pos"), F.concat(header, F.col("data")).alias("data"), F.when(is_video, F.col("pts") * 300).alias("pcr"))
    at = v.where(F.col("i") % repeat == 0).withColumn("kind", F.lit(0)).select("source", pos.alias("pos"))
    return multiplex(pes, program_packets(at, program, video_pid, [(stream_type, video_pid, b""), (audio_type, audio_pid, b"")]))


def fake_afd(afd: int) -> bytes:
    """The user data unit that states an active format."""
    return b"\x00\x00\x01\xb2DTG1" + bytes([0x41, 0xF0 | afd])


def parameter_sets_first(nals: DataFrame) -> DataFrame:
    """The last parameter set of each kind and id, to go before reversed pictures."""
    kind = F.when(F.col("unit_type") == 7, F.col("sps.id")).when(F.col("unit_type") == 8, F.col("pps.id"))
    x = nals.where("unit_type in (7, 8)").withColumn("set_id", kind)
    return x.groupBy("source", "unit_type", "set_id").agg(F.max("start").alias("start"))


def end_of_unit(units: DataFrame) -> DataFrame:
    """Whether each NAL ends a sequence (10) or the stream (11)."""
    return units.withColumn("ends", uint(F.col("data"), 3).bitwiseAND(31).isin(10, 11))


def dvd_ac3(packets: DataFrame) -> DataFrame:
    """``(source, pos, part, data)``: AC-3 packets of a DVD (private stream 1) as plain PES packets.

    The four bytes that name the substream go. Where the PTS belongs to a frame that starts later in
    the packet, the bytes before it become a packet of their own without times.
    """
    d = F.col("data")
    head = 9 + uint(d, 8)
    size = F.length("data")
    frames, offset = uint(d, head + 1), uint(d, head + 2, 2)
    timed = flag(uint(d, 7), 0x80)
    split = (frames > 0) & (offset > 1) & timed
    x = packets.where((F.col("stream_id") == 0xBD) & (uint(d, 6).bitwiseAND(0xC0) == 0x80)).select("source", "pos", "data", head.cast("int").alias("h"), F.coalesce(split, F.lit(False)).alias("split"), offset.cast("int").alias("o"), size.alias("size"))
    rest = F.when(F.col("split"), F.col("o") + 3).otherwise(4)
    own = F.concat(F.expr("substring(data, 1, 4)"), be(F.col("size") - 6 - rest, 2), F.substring(d, F.lit(7), F.col("h") - 6), F.substring(d, F.col("h") + rest + 1, F.col("size")))
    before = F.substring(d, F.col("h") + 5, F.col("o") - 1)
    plain = F.concat(transport.pes_header(0xBD, F.length(before)), before)
    parts = F.when(F.col("split"), F.array(plain, own)).otherwise(F.array(own))
    return x.select("source", "pos", F.posexplode(parts).alias("part", "data"))
