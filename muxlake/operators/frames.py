"""Reports and filters on frame tables: (source, idx, kind, size, ...), ordered by ``idx``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .automata import scan
from .packets import changes, islands


def sizes_by_kind(frames: DataFrame) -> DataFrame:
    """Count, least, greatest and whole mean size for each kind of frame and over all (null kind)."""
    out = frames.rollup("kind").agg(F.count("*").alias("frames"), F.min("size").alias("min_size"), F.max("size").alias("max_size"), F.expr("sum(size) div count(*)").alias("mean_size"), F.sum("size").alias("total_size"))
    return out


def duration(frames: DataFrame, rate: float = 25.0) -> DataFrame:
    """Frames and seconds at a frame rate."""
    return frames.groupBy("source").agg(F.count("*").alias("frames"), (F.count("*") / F.lit(rate)).alias("seconds"))


def category_by_slices(frames: DataFrame, categories: list[str]) -> DataFrame:
    """Frames counted by category, one row for each slice class."""
    out = frames.groupBy("slice_class").pivot("category", categories).count()
    return out.select("slice_class", *[F.coalesce(F.col(f"`{c}`"), F.lit(0)).cast("long").alias(c) for c in categories])


def unit_histograms(units: DataFrame) -> DataFrame:
    """Units by reference level, by type (13-23 and 24-31 pooled) and by slice type, in one pass."""
    t = F.col("unit_type")
    pooled = F.when(t.between(13, 23), 13).when(t.between(24, 31), 24).otherwise(t)
    rows = units.select("ref_idc", pooled.alias("unit_type"), "slice_type")
    out = rows.groupingSets([["ref_idc"], ["unit_type"], ["slice_type"]], "ref_idc", "unit_type", "slice_type").agg(F.count("*").alias("units"), F.grouping_id().alias("gid"))
    names = F.element_at(F.create_map(F.lit(3), F.lit("ref_idc"), F.lit(5), F.lit("unit_type"), F.lit(6), F.lit("slice_type")), F.col("gid").cast("int"))
    return out.select(names.alias("measure"), F.coalesce("ref_idc", "unit_type", "slice_type").cast("long").alias("value"), "units")


def afd_changes(pictures: DataFrame) -> DataFrame:
    """Pictures whose active format differs from the last (at first 0); absent values carry on."""
    w = Window.partitionBy("source").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    held = pictures.withColumn("afd", F.coalesce(F.last("afd", True).over(w), F.lit(0)))
    return changes(held, ["source"], "idx", F.col("afd"), F.lit(0))


def gop_sizes(frames: DataFrame, start: Column) -> DataFrame:
    """Frames of each group of pictures; frames before the first start belong to none."""
    x = islands(frames, ["source"], "idx", start, "gop").where("gop > 0")
    return x.groupBy("source", "gop").agg(F.count("*").alias("frames"), F.sum("size").alias("bytes"))


def gop_report(frames: DataFrame, start: Column) -> DataFrame:
    """Number, least, greatest and mean size of groups; no mean for fewer than two."""
    g = gop_sizes(frames, start)
    return g.groupBy("source").agg(F.count("*").alias("gops"), F.min("frames").alias("min_frames"), F.max("frames").alias("max_frames"), F.when(F.count("*") > 1, F.sum("frames") / F.count("*")).alias("mean_frames"))


def dots(frames: DataFrame, mark: Column, width: int = 60) -> DataFrame:
    """Lines of ``width`` characters, one for each frame in order."""
    x = frames.select("source", "idx", F.floor((F.row_number().over(Window.partitionBy("source").orderBy("idx")) - 1) / width).cast("long").alias("line"), mark.alias("mark"))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("idx", "mark"))), lambda s: s["mark"]), "")
    return x.groupBy("source", "line").agg(text.alias("dots"))


def avc_mark(ref: Column, idr: Column, slices: Column, gop: Column) -> Column:
    """Character of an H.264 frame: D d IDR, I i, P p, B b, X x mixed; lower case without reference."""
    letter = F.when(idr, "D").when(slices == "I", "I").when(slices == "P", "P").when(slices == "B", "B").when(slices.isNull(), "_").otherwise("X")
    return F.when(letter == "_", "_").when(idr & ~gop, "d").when(ref, letter).otherwise(F.lower(letter))


def strip_to_reference(frames: DataFrame, all_references: bool = False) -> DataFrame:
    """IDR frames and references of I slices only, or every reference frame."""
    keep = F.col("ref") if all_references else F.col("idr") | (F.col("ref") & (F.col("slice_class") == "I"))
    return frames.where(keep)


def drop_repeated_headers(items: DataFrame) -> DataFrame:
    """Sequence headers equal to the last one are dropped; other items stay."""
    heads = changes(items.where("is_header"), ["source"], "idx", F.col("content"))
    return heads.unionByName(items.where("not is_header"))


def keep_every(frames: DataFrame, freq: int) -> DataFrame:
    """Reference pictures at about every ``freq``-th place, in order, each with its repeat count.

    A picture is taken once at least ``freq`` places lie between it and the last taken; ``repeats``
    tells how often it stands in for the places to the next. State runs along each source.
    """

    def step(last, idx):
        return (idx, (idx,)) if last is None or idx - last >= freq else (last, None)

    added = T.StructType([T.StructField("taken", T.LongType())])
    rows = scan(frames.select("source", "idx"), ["source"], ["idx"], ["idx"], lambda: None, step, added)
    gap = F.lead("idx").over(Window.partitionBy("source").orderBy("idx")) - F.col("idx")
    return rows.select("source", "idx", F.coalesce(F.floor(gap / freq), F.lit(1)).cast("long").alias("repeats"))


def reverse(pictures: DataFrame, freq: int = 1) -> DataFrame:
    """Pictures from last to first: ``out_no`` counts those at every ``freq``-th place."""
    n = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("idx")))
    return pictures.withColumn("_n", n).where((F.col("_n") - 1) % freq == 0).withColumn("out_no", F.floor((F.col("_n") - 1) / freq) + 1).drop("_n")


def skip(pictures: DataFrame, at: int, by: int) -> DataFrame:
    """Pictures from ``by`` places after (before, if negative) picture ``at`` on."""
    return pictures.where(F.col("idx") >= max(0, at + by))


def up_to_reference(frames: DataFrame) -> DataFrame:
    """Frames up to and including the first reference frame of each source."""
    first = frames.where("ref").groupBy("source").agg(F.min("idx").alias("_to"))
    return frames.join(first, "source").where(F.col("idx") <= F.col("_to")).drop("_to")


def merge_by_time(video: DataFrame, audio: DataFrame) -> DataFrame:
    """One stream of video and audio frames by presentation time; at equal times video is first."""
    own = video.select("source", "time", F.lit(0).alias("kind"), "size")
    both = own.unionByName(audio.select("source", "time", F.lit(1).alias("kind"), "size"))
    return both.withColumn("out_no", F.row_number().over(Window.partitionBy("source").orderBy("time", "kind", "size")))


def first_items(items: DataFrame, limit: int, order: str = "idx") -> DataFrame:
    """The first ``limit`` items of each source."""
    n = F.row_number().over(Window.partitionBy("source").orderBy(order))
    return items.withColumn("_n", n).where(F.col("_n") <= limit).drop("_n")


def act(pictures: DataFrame, action: str, freq: int = 8, limit: int | None = None) -> DataFrame:
    """``(source, idx, repeats)`` of what an action shows: ``copy`` all, ``strip`` to reference
    pictures, ``filter`` to reference pictures at about every ``freq``-th place, repeated in the
    gaps. ``limit`` looks at the first so many pictures."""
    x = pictures if limit is None else first_items(pictures, limit)
    if action == "filter":
        return keep_every(x.where("ref"), freq)
    if action not in ("copy", "strip"):
        raise ValueError(f"unknown action {action}")
    kept = x if action == "copy" else strip_to_reference(x)
    return kept.select("source", "idx", F.lit(1).cast("long").alias("repeats"))


def shown(plan: DataFrame, pictures: DataFrame) -> DataFrame:
    """``(source, order, data)``: the bytes of planned pictures, repeats written out.

    ``plan`` has (source, idx) with ``repeats``, or ``step`` and ``out_no`` of trick play; ``pictures``
    has (source, idx, data). ``order`` sorts the rows into the stream to be written.
    """
    times = F.col("repeats") if "repeats" in plan.columns else F.lit(1).cast("long")
    place = [F.col(c).cast("long").alias(c) for c in ("step", "out_no") if c in plan.columns] or [F.col("idx").cast("long").alias("idx")]
    x = plan.select("source", "idx", F.explode(F.sequence(F.lit(1).cast("long"), times)).alias("_k"), F.array(*place).alias("_p"))
    x = x.select("source", "idx", F.concat("_p", F.array("_k")).alias("order"))
    return x.join(pictures.select("source", "idx", "data"), ["source", "idx"]).select("source", "order", "data")
