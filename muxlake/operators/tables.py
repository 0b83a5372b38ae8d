"""Program tables: which PID carries what, as joins and change detection.

``programs`` has (source, pos, program_number, pmt_pid); ``streams`` has (source, pos, pmt_pid,
program_number, stream_type, elementary_pid). Program tables are small next to packets, but their
joins leave the choice of a broadcast to Spark's own size check.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from muxlake.functions import codes

from .packets import changes


def program_streams(programs: DataFrame, streams: DataFrame) -> DataFrame:
    """The chain program - PMT - elementary stream, with names of stream types."""
    p = programs.where("program_number <> 0").select("source", "program_number", "pmt_pid").distinct()
    s = streams.select("source", "pmt_pid", "stream_type", "elementary_pid").distinct()
    return p.join(s, ["source", "pmt_pid"]).withColumn("type_text", codes.stream_type_text(F.col("stream_type")))


def select_program(programs: DataFrame, index: int | None = None, number: int | None = None) -> DataFrame:
    """The program listed ``index``-th (from 1), or that of ``number`` (0: the first listed)."""
    listed = programs.where("program_number <> 0")
    if number:
        return listed.where(F.col("program_number") == number)
    w = Window.partitionBy("source").orderBy("pos", "program_number")
    return listed.withColumn("_i", F.row_number().over(w)).where(F.col("_i") == (index or 1)).drop("_i")


def with_stream_type(packets: DataFrame, streams: DataFrame) -> DataFrame:
    """Packets with the stream type of their PID; PIDs in no table keep null."""
    types = streams.groupBy("source", F.col("elementary_pid").alias("pid")).agg(F.min_by("stream_type", "pos").alias("stream_type"))
    return packets.join(types, ["source", "pid"], "left")


def unknown_pids(packets: DataFrame, streams: DataFrame) -> DataFrame:
    """PIDs that occur in packets but in no table."""
    known = streams.select("source", F.col("elementary_pid").alias("pid"))
    return packets.groupBy("source", "pid").agg(F.count("*").alias("packets")).join(known, ["source", "pid"], "left_anti")


def choose_pids(streams: DataFrame) -> DataFrame:
    """Per source the first video and the first audio PID."""
    first = lambda kind: F.min(F.when(kind(F.col("stream_type")), F.struct("pos", "elementary_pid")))["elementary_pid"]
    return streams.groupBy("source").agg(first(codes.is_video_type).alias("video_pid"), first(codes.is_audio_type).alias("audio_pid"))


def table_changes(tables: DataFrame, digest: Column) -> DataFrame:
    """First table of each PMT PID and each later one that differs from the one before."""
    return changes(tables, ["source", "pmt_pid"], "pos", digest)


def validity(tables: DataFrame) -> DataFrame:
    """Tables with ``until``: the position at which the next one of their PID takes over."""
    return tables.withColumn("until", F.lead("pos").over(Window.partitionBy("source", "pmt_pid").orderBy("pos")))


def stream_list(streams: DataFrame) -> DataFrame:
    """One row for each table with its streams as a sorted array, fit for comparing."""
    return streams.groupBy("source", "pmt_pid", "pos").agg(F.sort_array(F.collect_list(F.struct("elementary_pid", "stream_type"))).alias("streams"))


def pcr_pid(programs: DataFrame, streams: DataFrame, index: int | None = None, number: int | None = None) -> DataFrame:
    """``(source, program_number, pcr_pid)``: the PID with the clock of the program to be played.

    ``streams`` has ``pcr_pid``; the first map table of the program tells it.
    """
    chosen = select_program(programs, index, number).select("source", "program_number", "pmt_pid").distinct()
    return chosen.join(streams, ["source", "program_number", "pmt_pid"]).groupBy("source", "program_number").agg(F.min_by("pcr_pid", "pos").alias("pcr_pid"))
