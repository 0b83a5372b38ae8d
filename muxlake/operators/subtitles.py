"""DVB subtitles: segments of subtitle PES packets."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from muxlake.functions.clock import pts_signed_diff

SEGMENT = "source string, pid int, pos long, pts long, no int, kind string, page int, len int, regions array<struct<id: int, x: int, y: int>>, width int, height int, object int, err string"
# fixed values: segment types
KINDS = {0x10: "page", 0x11: "region", 0x12: "CLUT", 0x13: "object", 0x14: "display", 0x80: "end", 0xFF: "stuffing"}


def segments_of(d: bytes) -> Iterator[dict]:
    """Segments in a subtitle PES payload: data id 20, stream id 0, then sync bytes 0F."""
    row = dict.fromkeys(("regions", "width", "height", "object", "err"))
    if d[:2] != b"\x20\x00":
        yield row | {"no": 0, "kind": None, "page": None, "len": len(d), "err": "no subtitle data"}
        return
    at, no = 2, 0
    while at + 6 <= len(d) and d[at] == 0x0F:
        kind, size = d[at + 1], int.from_bytes(d[at + 4 : at + 6], "big")
        body = d[at + 6 : at + 6 + size]
        got = row | {"no": no, "kind": KINDS.get(kind, f"0x{kind:02X}"), "page": int.from_bytes(d[at + 2 : at + 4], "big"), "len": size}
        if len(body) < size:
            got["err"] = "short"
        elif kind == 0x10:
            got["regions"] = [{"id": body[i], "x": int.from_bytes(body[i + 2 : i + 4], "big"), "y": int.from_bytes(body[i + 4 : i + 6], "big")} for i in range(2, size - 5, 6)]
        elif kind == 0x11 and size >= 6:
            got |= {"width": int.from_bytes(body[2:4], "big"), "height": int.from_bytes(body[4:6], "big")}
        elif kind == 0x13 and size >= 2:
            got["object"] = int.from_bytes(body[:2], "big")
        yield got
        at, no = at + 6 + size, no + 1


def segments(pes: DataFrame) -> DataFrame:
    """Segments of the subtitle PES packets in ``es_data``."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(SEGMENT))

    def run(batches):
        for batch in batches:
            rows = [{"source": r["source"], "pid": r["pid"], "pos": r["pos"], "pts": r["pts"], **s} for r in batch.to_pylist() for s in segments_of(r["es_data"] or b"")]
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return pes.select("source", F.col("pid").cast("int").alias("pid"), "pos", "pts", "es_data").mapInArrow(run, SEGMENT)


def with_step(pes: DataFrame) -> DataFrame:
    """Subtitle packets with the PTS distance to the one before."""
    return pes.withColumn("step", pts_signed_diff(F.col("pts"), F.lag("pts").over(Window.partitionBy("source", "pid").orderBy("pos"))))
