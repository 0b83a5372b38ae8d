"""File-like views for interactive use; every property is a DataFrame unless said otherwise."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

from pyspark.sql import DataFrame, Row, SparkSession

from muxlake.operators import elementary, packets, tables, transport
from muxlake.sources import files, records


class ProgramTable(dict):
    """Program number to map PID, as a plain dictionary."""

    def has_pmt(self, pid: int) -> bool:
        """Whether a PID is a map PID."""
        return pid in self.values()

    def program_numbers(self, pid: int) -> list[int]:
        """Programs whose map is on a PID."""
        return sorted(k for k, v in self.items() if v == pid)


class TransportFile:
    """A transport stream."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def __enter__(self) -> TransportFile:
        return self

    def __exit__(self, *_: object) -> None:
        self.packets.unpersist()

    def __iter__(self) -> Iterator[Row]:
        return self.packets.orderBy("pos").toLocalIterator()

    @cached_property
    def packets(self) -> DataFrame:
        """Parsed packets."""
        return transport.parse(records.read_transport(self.spark, self.path))

    @cached_property
    def sections(self) -> DataFrame:
        """Program table sections."""
        return transport.sections(self.packets)

    @property
    def streams(self) -> DataFrame:
        """Elementary streams of all map tables."""
        return transport.with_type_names(transport.streams(self.sections))

    def find_pat(self) -> ProgramTable:
        """The first association table (a few rows, on the driver)."""
        rows = transport.programs(self.sections)
        first = rows.agg({"pos": "min"}).first()[0]
        return ProgramTable({r["program_number"]: r["pmt_pid"] for r in rows.where(rows["pos"] == first).collect()} if first is not None else {})

    def find_pmt(self, index: int = 1, number: int | None = None) -> DataFrame:
        """Streams of the ``index``-th program listed, or of program ``number``."""
        chosen = tables.select_program(transport.programs(self.sections), index, number).select("source", "pmt_pid", "program_number").distinct()
        return self.streams.join(chosen, ["source", "pmt_pid", "program_number"])

    def pes(self, pid: int | None = None) -> DataFrame:
        """PES packets, of one PID if given."""
        x = self.packets if pid is None else self.packets.where(self.packets["pid"] == pid)
        return transport.pes_packets(x)

    def interpolated(self, pcr_pid: int) -> DataFrame:
        """Packets with interpolated PCRs of one PCR PID."""
        from pyspark.sql import functions as F

        return packets.interpolate_pcr(self.packets.withColumn("pcr", F.when(F.col("pid") == pcr_pid, F.col("pcr"))))


class ProgramStream:
    """A program stream."""

    def __init__(self, spark: SparkSession, path: str):
        self.packets = files.read_program_stream(spark, path)

    def __iter__(self) -> Iterator[Row]:
        return self.packets.orderBy("pos").toLocalIterator()


class ElementaryFile:
    """An elementary stream: start-code units of a plain file."""

    def __init__(self, spark: SparkSession, path: str):
        self.units = elementary.es_units(records.read_chunks(spark, path))

    def __iter__(self) -> Iterator[Row]:
        return self.units.orderBy("start").toLocalIterator()

    def read(self, start: int, size: int) -> bytes:
        """Bytes from ``start`` on, joined on the driver."""
        from pyspark.sql import functions as F

        rows = self.units.where((F.col("start") < start + size) & (F.col("start") + F.col("len") > start)).orderBy("start").collect()
        data = b"".join(bytes(r["data"]) for r in rows)
        return data[start - rows[0]["start"] :][:size] if rows else b""

    def video_type(self) -> DataFrame:
        """The video kind that the first units allow."""
        return elementary.video_type(self.units)
