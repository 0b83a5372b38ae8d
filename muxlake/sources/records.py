"""Byte streams in pieces, and fixed-length records: transport (188 bytes) and stamped transport (192).

A large file is read by Spark's text source, cut at newline bytes, so that a file of any size in any
store is split over tasks; the cuts are put together to pieces with their places in the file.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from muxlake.functions.bits import uint

#: Bytes of a piece (about), and files that are read as one piece.
PIECE, WHOLE = 1 << 20, 1 << 24
_MARK = b"\xef\xbb\xbf"


def _files(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """Paths and sizes of the files under ``path``, which may be a pattern."""
    context = spark.sparkContext
    where = context._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(context._jsc.hadoopConfiguration())
    todo, found = list(files.globStatus(where) or []), []
    while todo:
        status = todo.pop()
        if status.isDirectory():
            todo += [s for s in files.listStatus(status.getPath()) if not s.getPath().getName().startswith(("_", "."))]
        else:
            found.append((status.getPath().toString(), status.getLen()))
    if not found:
        raise FileNotFoundError(path)
    return found


def _large_file(spark: SparkSession, path: str, size: int, piece: int) -> DataFrame:
    """Pieces of one file, each a run of lines of one split."""
    lines = spark.read.option("lineSep", "\n").text(path)
    lines = lines.select(F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("line"))
    sums = lines.groupBy("block").agg(F.sum(F.length("line").cast("long") + 1).alias("held"))
    ahead = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    # a row for each split
    bases = sums.select(F.col("block").alias("b"), F.coalesce(F.sum("held").over(ahead), F.lit(0).cast("long")).alias("base"))

    def join(batches):
        block, at, held, n = None, 0, [], 0

        def flush():
            nonlocal held, n, at
            data = b"".join(held)
            out = pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([at], pa.int64()), pa.array([data], pa.binary())], ["block", "at", "data"])
            at, held, n = at + len(data), [], 0
            return out

        for batch in batches:
            for own, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if own != block:
                    if held:
                        yield flush()
                    block, at = own, 0
                held += [line, b"\n"]
                n += len(line) + 1
                if n >= piece:
                    yield flush()
        if held:
            yield flush()

    pieces = lines.mapInArrow(join, "block long, at long, data binary").join(bases, F.col("block") == F.col("b"))
    # the text source leaves out a byte order mark at the start and cannot tell whether a newline ends the file
    total = sums.agg(F.sum("held")).first()[0] or 0
    marked = size - total >= 2
    infile = F.col("base") + F.col("at") + (len(_MARK) if marked else 0)
    end = infile + F.length("data")
    data = F.when(end > size, F.substring(F.col("data"), F.lit(1), F.length("data") - 1)).otherwise(F.col("data"))
    out = pieces.select(F.lit(path).alias("source"), infile.alias("infile"), data.alias("data"))
    return out.unionByName(spark.createDataFrame([(path, 0, bytearray(_MARK))], "source string, infile long, data binary")) if marked else out


def read_chunks(spark: SparkSession, path: str, piece: int = PIECE, whole: int = WHOLE) -> DataFrame:
    """``(source, infile, data)``: the bytes of each file under ``path`` in pieces, with their offsets.

    A file over ``whole`` bytes comes in pieces of about ``piece``, others in one.
    """
    found, out = _files(spark, path), None
    small = [p for p, n in found if n <= whole]
    if small:
        out = spark.read.format("binaryFile").load(small).select(F.col("path").alias("source"), F.lit(0).cast("long").alias("infile"), F.col("content").alias("data"))
    for name, size in found:
        if size > whole:
            own = _large_file(spark, name, size, piece)
            out = own if out is None else out.unionByName(own)
    return out


def cut_records(chunks: DataFrame, size: int) -> DataFrame:
    """``(source, n, pos, raw)`` of byte pieces in any cut; a short tail is left out."""
    first, last = F.floor(F.col("infile") / size), F.floor((F.col("infile") + F.length("data") - 1) / size)
    x = chunks.where(F.length("data") > 0).withColumn("n", F.explode(F.sequence(first, last)))
    start = F.greatest(F.col("n") * size - F.col("infile"), F.lit(0))
    x = x.select("source", "n", "infile", F.substring(F.col("data"), (start + 1).cast("int"), (F.col("n") * size + size - F.col("infile") - start).cast("int")).alias("raw"))
    parts = x.where(F.length("raw") < size).groupBy("source", "n").agg(F.sort_array(F.collect_list(F.struct("infile", F.hex("raw").alias("h")))).alias("p"))
    joined = parts.select("source", "n", F.unhex(F.array_join(F.transform("p", lambda s: s["h"]), "")).alias("raw"))
    every = x.where(F.length("raw") == size).select("source", "n", "raw").unionByName(joined.where(F.length("raw") == size))
    return every.select("source", "n", (F.col("n") * size).alias("pos"), "raw")


def read_records(spark: SparkSession, path: str, size: int, source: str | None = None) -> DataFrame:
    """``(source, n, pos, raw)``: record number, byte offset and bytes; a short tail is left out."""
    x = cut_records(read_chunks(spark, path), size)
    return x if source is None else x.withColumn("source", F.lit(source))


def read_transport(spark: SparkSession, path: str, source: str | None = None) -> DataFrame:
    """Transport packets of a file."""
    return read_records(spark, path, 188, source)


def read_stamped(spark: SparkSession, path: str, source: str | None = None) -> DataFrame:
    """Packets with a 4-byte arrival stamp before each; ``stamp`` is apart, ``raw`` the packet."""
    x = read_records(spark, path, 192, source)
    return x.select("source", "n", "pos", uint(F.col("raw"), 0, 4).alias("stamp"), F.expr("substring(raw, 5)").alias("raw"))


def from_payloads(packets: DataFrame, payload: str = "payload") -> DataFrame:
    """Transport packets carried in datagrams: each payload is cut into 188-byte slices."""
    x = packets.where(F.length(payload) >= 188).withColumn("_k", F.explode(F.sequence(F.lit(0), (F.floor(F.length(payload) / 188) - 1).cast("int"))))
    return x.withColumn("raw", F.substring(F.col(payload), F.col("_k") * 188 + 1, F.lit(188))).drop("_k")


def write_pieces(rows: DataFrame, order: list[str], column: str, path: str) -> None:
    """Writes a binary column in order: a Parquet folder whose rows, by ``part``, are the stream.

    Rows are range-partitioned by ``order``, so writing is spread over tasks; each row holds a few
    megabytes.
    """
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order).select(F.spark_partition_id().alias("part"), column)

    def join(batches):
        n = 0
        for batch in batches:
            if batch.num_rows:
                data = b"".join(b for b in batch.column(1).to_pylist() if b)
                yield pa.RecordBatch.from_arrays([pa.array([batch.column(0)[0].as_py()], pa.int32()), pa.array([n], pa.int64()), pa.array([data], pa.binary())], ["part", "piece", "value"])
                n += 1

    ordered.mapInArrow(join, "part int, piece long, value binary").write.mode("overwrite").parquet(path)


def read_pieces(spark: SparkSession, path: str) -> DataFrame:
    """``(part, piece, value)`` written by :func:`write_pieces`, in order."""
    return spark.read.parquet(path).orderBy("part", "piece")


def write_stream(rows: DataFrame, order: list[str], column: str, target: str | BinaryIO | Callable[[bytes], object], pace: str | None = None, sleep: Callable[[float], object] | None = None) -> int:
    """Writes a binary column in order to one file, an open binary stream or a function; returns bytes.

    A stream file is written from its start to its end, so the driver takes one partition of the
    ordered rows at a time; the work before is spread over tasks. With ``pace``, a column of
    microseconds from the start, each row waits for its time (``sleep`` takes seconds).
    """
    import time

    columns = [column] if pace is None else [column, pace]
    ordered = rows.where(F.col(column).isNotNull()).orderBy(*order).select(*columns)
    opened = open(target, "wb") if isinstance(target, str) else None
    put = opened.write if opened else target.write if hasattr(target, "write") else target
    total, began, sleep = 0, time.monotonic(), sleep or time.sleep
    try:
        for row in ordered.toLocalIterator(prefetchPartitions=True):
            if pace is not None and (late := row[1] / 1e6 - (time.monotonic() - began)) > 0:
                sleep(late)
            put(bytes(row[0]))
            total += len(row[0])
    finally:
        if opened:
            opened.close()
    return total
