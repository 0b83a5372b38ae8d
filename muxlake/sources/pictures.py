"""Raw planar pictures: a file of frames without headers, a row for each frame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import records

# fixed values: samples of the two colour planes to one of brightness, across and down
LAYOUTS = {"420": (2, 2), "422": (2, 1), "444": (1, 1), "400": None}


def plane_sizes(width: int, height: int, layout: str = "420") -> tuple[int, int]:
    """Bytes of the brightness plane and of each colour plane."""
    parts = LAYOUTS[layout]
    return width * height, 0 if parts is None else -(-width // parts[0]) * -(-height // parts[1])


def read_planar(spark: SparkSession, path: str, width: int, height: int, layout: str = "420") -> DataFrame:
    """``(source, n, y, u, v)``: the planes of each frame; without colour, ``u`` and ``v`` are null."""
    bright, colour = plane_sizes(width, height, layout)
    x = records.read_records(spark, path, bright + 2 * colour)
    part = lambda at, size: F.substring(F.col("raw"), F.lit(at + 1), F.lit(size)) if size else F.lit(None).cast("binary")
    return x.select("source", "n", part(0, bright).alias("y"), part(bright, colour).alias("u"), part(bright + colour, colour).alias("v"))


def as_pgm(frames: DataFrame, width: int, height: int) -> DataFrame:
    """``(source, n, image)``: each frame's brightness as a portable grey map, for any viewer."""
    head = F.lit(f"P5\n{width} {height}\n255\n").cast("binary")
    return frames.select("source", "n", F.concat(head, F.col("y")).alias("image"))
