"""Reports on network captures: (source, pkt_no, t90, dst_ip, dst_port, vlan, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .automata import scan
from .packets import islands

STREAM = ["source", "vlan", "dst_ip", "dst_port"]


def stream_report(packets: DataFrame) -> DataFrame:
    """Per stream: packets, bytes, TS-shaped and other payloads, RTP sources, VLAN priorities."""
    shaped = (F.col("size") > 0) & (F.col("size") % 188 == 0)
    return packets.groupBy(*STREAM).agg(
        F.min("pkt_no").alias("first_pkt"),
        F.count("*").alias("packets"),
        F.sum("size").alias("bytes"),
        F.count_if(shaped).alias("good"),
        F.count_if(~shaped).alias("dodgy"),
        F.min_by("ssrc", "pkt_no").alias("first_ssrc"),
        (F.count_distinct("ssrc") > 1).alias("several_ssrc"),
        F.expr("bit_or(shiftleft(1, pcp))").alias("pcp_bits"),
    )


def number_streams(report: DataFrame) -> DataFrame:
    """Streams numbered from 0 by first packet."""
    return report.withColumn("stream_no", F.row_number().over(Window.partitionBy("source").orderBy("first_pkt")) - 1)


def sequence_gaps(packets: DataFrame, modulus: int = 1 << 16) -> DataFrame:
    """Packets whose RTP sequence number is not one after the last of their stream."""
    w = Window.partitionBy(*STREAM).orderBy("pkt_no")
    gap = F.pmod(F.col("seq") - (F.lag("seq").over(w) + 1), F.lit(modulus))
    return packets.withColumn("gap", gap).where("gap > 0")


def sections(packets: DataFrame, silence: int = 6 * 90_000) -> DataFrame:
    """Adds ``section``: it goes up where a stream is silent for more than ``silence`` ticks."""
    w = Window.partitionBy(*STREAM).orderBy("pkt_no")
    jump = F.abs(F.col("t90") - F.lag("t90").over(w)) > silence
    return islands(packets.withColumn("_jump", jump), STREAM, "pkt_no", F.col("_jump"), "section").drop("_jump")


def sections_by_skew(packets: DataFrame, limit: int = 6 * 90_000) -> DataFrame:
    """Adds ``section`` by the full rule: time, PCR or skew jumps, skew counted from the section's start.

    Time and PCR jumps count either way, skew only upwards. Each stream's packets are worked through
    in order, since a section's start decides the skew of those after it.
    """
    turn = 1 << 33

    def near(d: int) -> int:
        return (d + turn // 2) % turn - turn // 2

    def step(state, t, pcr):
        start, last, section = state
        if start is None:
            return ((t, pcr), (t, pcr), section), (section, 0)
        skew = near(pcr - start[1]) - (t - start[0])
        if abs(t - last[0]) > limit or abs(near(pcr - last[1])) > limit or skew > limit:
            start, section, skew = (t, pcr), section + 1, 0
        return (start, (t, pcr), section), (section, skew)

    added = T.StructType([T.StructField("section", T.IntegerType()), T.StructField("skew", T.LongType())])
    return scan(packets, STREAM, ["pkt_no"], ["t90", "pcr90"], lambda: (None, None, 0), step, added)


def section_report(packets: DataFrame) -> DataFrame:
    """Per stream and section: bytes, time and clock spans, drift and drift a minute (ticks)."""
    first, last = (F.expr(f"{f}(struct(t90, pcr90), pkt_no)") for f in ("min_by", "max_by"))
    x = packets.groupBy(*STREAM, "section").agg(F.count("*").alias("packets"), F.sum("size").alias("bytes"), first.alias("a"), last.alias("b"))
    x = x.select(*STREAM, "section", "packets", "bytes", (F.col("b.t90") - F.col("a.t90")).alias("time_span"), F.shiftright(F.shiftleft(F.col("b.pcr90") - F.col("a.pcr90"), 31), 31).alias("clock_span"))
    drift = F.col("clock_span") - F.col("time_span")
    return x.select("*", drift.alias("drift"), F.expr("case when time_span > 0 then ((clock_span - time_span) * 5400000) div time_span end").alias("drift_per_minute"), F.expr("case when time_span > 0 then (bytes * 8 * 90000) div time_span end").alias("bits_per_second"))


def jitter(packets: DataFrame, skew: Column, span: int = 900_000, ring: int | None = None) -> DataFrame:
    """Adds ``jitter``: greatest less least skew over the last ``span`` ticks (``ring``: last so many)."""
    w = Window.partitionBy(*STREAM).orderBy("t90")
    frame = w.rangeBetween(-span, 0) if ring is None else w.rowsBetween(-ring + 1, 0)
    return packets.withColumn("_s", skew).withColumn("jitter", F.max("_s").over(frame) - F.min("_s").over(frame)).drop("_s")


def plausibility(packets: DataFrame, good_only: bool = False) -> DataFrame:
    """Adds ``score`` and ``good``: hysteresis of TS-shaped payloads, kept within -10 and 10.

    Each check (length a multiple of 188, each sync byte) counts one up or down; a payload is bad
    at 0 or below, or with ``good_only`` at any failed check.
    """

    def step(score, payload):
        data = bytes(payload or b"")
        checks = [len(data) > 0 and len(data) % 188 == 0] + [data[i] == 0x47 for i in range(0, len(data), 188)]
        for ok in checks:
            score = max(-10, min(10, score + (1 if ok else -1)))
        return score, (score, score > 0 and (all(checks) or not good_only))

    added = T.StructType([T.StructField("score", T.IntegerType()), T.StructField("good", T.BooleanType())])
    return scan(packets, STREAM, ["pkt_no"], ["payload"], lambda: 0, step, added)


def output_name(prefix: Column, stream: Column, section: Column | None = None) -> Column:
    """Name of a stream's file, with its section if given."""
    parts = [prefix, F.concat(F.lit("s"), stream.cast("string"))]
    if section is not None:
        parts.append(F.concat(F.lit("p"), section.cast("string")))
    return F.concat_ws("_", *parts)
