"""Trick play as data: a list of commands becomes the pictures that are shown, in order.

``pictures`` has (source, idx, ref); the plan is computed over the picture index, which is small next
to the pictures' bytes. Commands: ``n`` play on, ``f`` fast (reference pictures), ``F`` faster (every
8th place), ``r`` reverse, ``R`` faster reverse, ``>`` ``<`` 10 seconds, ``]`` ``[`` 3 minutes, each with
the number of pictures it lasts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import places

# fixed values: distances in frames at 25 a second
SMALL_SKIP, BIG_SKIP = 250, 4500


def plan(pictures: DataFrame, commands: list[tuple[str, int]], fast: int = 8) -> DataFrame:
    """``(source, step, out_no, idx)`` for one list of commands over every source.

    Positions are ordinals; each command starts where the one before ended, forward commands after
    reverse ones at the next reference picture.
    """
    own = pictures.select("source", "idx", F.coalesce("ref", F.lit(False)).alias("ref"))
    x = places.sums_before(own, ["source"], places.leading(own, "idx"), ["idx"], {"n": F.lit(1), "refs": F.col("ref").cast("int")})
    # a command passes at most so many reference pictures, so later pictures are out of reach
    passed = {">": SMALL_SKIP, "]": BIG_SKIP}
    x = x.where(F.col("refs") <= sum(count * (fast if c in "FR" else 1) + passed.get(c, 0) + 1 for c, count in commands)).drop("refs")
    # each command reads them, so they are worked out once
    x = x.localCheckpoint()
    sizes = own.groupBy("source").agg((F.count("*") - 1).alias("last"))
    state = sizes.select("source", "last", F.lit(0).cast("long").alias("at"))
    out, after_reverse = None, False
    for step, (command, count) in enumerate(commands):
        if command in "><][":
            jump = {">": SMALL_SKIP, "<": -SMALL_SKIP, "]": BIG_SKIP, "[": -BIG_SKIP}[command]
            state = state.withColumn("at", F.greatest(F.lit(0), F.least(F.col("last"), F.col("at") + jump)))
            command, after_reverse = "n", True
        here = state.select(F.col("source").alias("s"), "at")
        rows = x.join(here, F.col("source") == F.col("s")).drop("s")
        if command in "rR":
            shown = rows.where((F.col("n") <= F.col("at")) & F.col("ref"))
            order = F.desc("n")
        else:
            shown = rows.where(F.col("n") >= F.col("at"))
            order = F.asc("n")
            if command in "fF":
                shown = shown.where("ref")
            elif after_reverse:
                first = Window.partitionBy("source")
                shown = shown.withColumn("_f", F.min(F.when(F.col("ref"), F.col("n"))).over(first)).where("n >= _f").drop("_f")
        ranked = shown.withColumn("k", F.row_number().over(Window.partitionBy("source").orderBy(order)))
        if command in "FR":
            ranked = ranked.where((F.col("k") - 1) % fast == 0).withColumn("k", F.floor((F.col("k") - 1) / fast) + 1)
        ranked = ranked.where(F.col("k") <= count)
        rows = ranked.select("source", F.lit(step).alias("step"), F.col("k").cast("long").alias("out_no"), "idx", "n")
        out = rows if out is None else out.unionByName(rows)
        end = (F.min("n") if command in "rR" else F.max("n") + 1).alias("to")
        ends = rows.groupBy(F.col("source").alias("s")).agg(end)
        state = state.join(ends, F.col("source") == F.col("s"), "left").select("source", "last", F.coalesce("to", "at").alias("at"))
        after_reverse = command in "rR"
    return out.drop("n")
