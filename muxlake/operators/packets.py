"""Order-dependent operators on packet tables.

A packet table has ``source``, ``n`` (packet number in the source) and ``pos`` (byte offset), and
``pid``, ``cc``, ``has_payload``, ``disc``, ``pcr`` (null where absent) as far as an operator needs them.

Windows over a whole source are split into chunks of packets: within a chunk by a window keyed
``(source, chunk)``, between chunks by a window over one summary row for each chunk. So a single large
source is worked on by many tasks. An operator makes one such pass: all that its rows need of earlier or
later chunks is carried together.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from muxlake.functions import clock

from . import places
from .automata import emit, scan

CHUNK = 1 << 16


def pid_histogram(packets: DataFrame) -> DataFrame:
    """Packets and bytes of each source's PIDs."""
    return packets.groupBy("source", "pid").agg(F.count("*").alias("packets"), (F.count("*") * 188).alias("bytes"), F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"))


def filter_pids(packets: DataFrame, pids: Iterable[int], invert: bool = False, max_packets: int | None = None, compat: bool = False) -> DataFrame:
    """Packets of the given PIDs, or of all others.

    ``max_packets`` looks at that many packets of the source; ``compat`` at one more, and with
    ``invert`` lets all later packets through.
    """
    chosen = F.col("pid").isin(*pids)
    keep = ~chosen if invert else chosen
    if max_packets is not None:
        within = F.col("n") < max_packets + (1 if compat else 0)
        keep = (~within | keep) if compat and invert else (within & keep)
    return packets.where(keep)


def first_of_pid(packets: DataFrame, pid: int, limit: int) -> DataFrame:
    """The first ``limit`` packets of one PID."""
    return packets.where(F.col("pid") == pid).orderBy("source", "pos").limit(limit)


def drop_periodically(packets: DataFrame, keep: int, drop: int) -> DataFrame:
    """Keeps ``keep`` packets and drops the next ``drop``, over and over."""
    return packets.where(F.col("n") % (keep + drop) < keep)


def hide_pid(packets: DataFrame, pid: int) -> DataFrame:
    """Drops a PID's packets, but those with a PCR stay as null packets."""
    own = F.col("pid") == pid
    return packets.where(~own | F.col("pcr").isNotNull()).withColumn("pid", F.when(own, 0x1FFF).otherwise(F.col("pid")))


def _stretch(chunk: int) -> Column:
    """The number of a row's chunk, by its place."""
    return F.floor(F.col("pos") / (188 * chunk)).alias("_chunk")


def continuity(packets: DataFrame, content: Column | None = None, compat: bool = False, chunk: int = CHUNK) -> DataFrame:
    """Per source and PID: packets, flagged discontinuities, good and bad duplicates, and counter errors.

    The counter goes up by one with a payload and stays without; nothing is compared at a flagged
    discontinuity. One repetition of a packet is allowed; a second is a duplicate error, and
    different ``content`` under an equal counter is a contents error. ``compat`` compares only after
    a counter above 0. Each chunk of a PID is counted by itself; its first row, and whether a
    repetition is open there, are settled from the chunks' ends.
    """
    key = ["source", "pid", "_chunk"]
    w = Window.partitionBy(*key).orderBy("pos")
    content = F.col("raw") if content is None else content

    def events(row: str, last: str) -> dict[str, Column]:
        """What a row is next to the last one; each has cc, disc, has_payload and content."""
        c = lambda x, f: F.col(f"{x}.{f}")
        compared = F.col(last).isNotNull() & ~c(row, "disc") & ((c(last, "cc") > 0) if compat else F.lit(True))
        same = compared & (c(row, "cc") == c(last, "cc")) & c(row, "has_payload")
        moved = compared & (c(row, "cc") != c(last, "cc"))
        equal = c(row, "content").eqNullSafe(c(last, "content"))
        wrong = moved & F.when(c(row, "has_payload"), (c(last, "cc") + 1) % 16 != c(row, "cc")).otherwise(True)
        return {k: F.coalesce(v, F.lit(False)) for k, v in (("same", same), ("moved", moved), ("good", same & equal), ("bad", same & ~equal), ("wrong", wrong))}

    x = packets.select("source", "pid", "pos", _stretch(chunk), F.struct("cc", "disc", "has_payload", content.alias("content")).alias("row"))
    x = x.withColumn("last", F.lag("row").over(w))
    x = x.select(*key, "pos", "row", *[v.alias(k) for k, v in events("row", "last").items()])
    x = x.withColumn("chain", F.sum(F.col("moved").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    in_chain = Window.partitionBy(*key, "chain").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumn("nth", F.sum(F.col("same").cast("int")).over(in_chain))
    own = x.groupBy(*key).agg(
        F.count("*").alias("packets"),
        F.count_if("row.disc").alias("flagged"),
        F.count_if(F.col("same") & (F.col("nth") > 1)).alias("dups"),
        F.count_if("bad").alias("bad"),
        F.count_if("good").alias("good"),
        F.count_if("wrong").alias("wrong"),
        F.min_by("row", "pos").alias("head"),
        F.max_by("row", "pos").alias("tail"),
        F.bool_or("moved").alias("any_moved"),
        F.bool_or(F.col("same") & (F.col("chain") == 0)).alias("same_ahead"),
        F.max_by(F.col("nth") > 0, "pos").alias("open"),
    )
    chunks = Window.partitionBy("source", "pid").orderBy("_chunk")
    own = own.withColumn("before", F.lag("tail").over(chunks))
    own = own.select("*", *[v.alias(f"b_{k}") for k, v in events("head", "before").items()])
    leaves = F.when(F.col("any_moved"), F.col("open")).when(F.col("same_ahead") | F.col("b_same"), True).when(F.col("b_moved"), False)
    own = own.withColumn("comes", F.coalesce(F.last(leaves, True).over(chunks.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False)))
    inside = F.when(F.col("b_same"), True).when(F.col("b_moved"), False).otherwise(F.col("comes"))
    more = (F.col("b_same") & F.col("comes")).cast("int") + (F.col("same_ahead") & inside).cast("int")
    plus = lambda k: F.sum(F.col(k) + F.col(f"b_{k}").cast("int"))
    return own.groupBy("source", "pid").agg(
        F.sum("packets").alias("packets"),
        F.sum("flagged").alias("flagged"),
        F.sum(F.col("dups") + more).alias("dup_errors"),
        plus("bad").alias("content_errors"),
        plus("good").alias("good_dups"),
        plus("wrong").alias("cc_errors"),
        F.min_by("head.cc", "_chunk").alias("first_cc"),
    )


def counter_lines(packets: DataFrame, pid: int) -> DataFrame:
    """The counters of one PID as text, a line ending after each 15."""
    w = Window.partitionBy("source").orderBy("pos")
    x = packets.where(F.col("pid") == pid).select("source", "pos", "cc", F.coalesce(F.sum((F.col("cc") == 15).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("line"))
    lists = x.groupBy("source", "line").agg(F.sort_array(F.collect_list(F.struct("pos", "cc"))).alias("l"))
    return lists.select("source", "line", F.array_join(F.transform("l", lambda s: s["cc"].cast("string")), " ").alias("text"))


def _in_chunks(df: DataFrame, chunk: int) -> DataFrame:
    return df.withColumn("_chunk", F.floor(F.col("n") / chunk))


def _pcr_summary(packets: DataFrame, chunk: int) -> DataFrame:
    """For each chunk with a PCR: its first and last PCR, the one before the last, and the PCRs around.

    Columns are ``first``, ``last`` (``n``, ``pos``, ``pcr``), ``second`` (the PCR before ``last``),
    ``before``, ``before2`` (the last two of earlier chunks) and ``after`` (the first of later chunks).
    """
    point = F.struct("n", "pos", "pcr")
    rows = _in_chunks(packets.where("pcr is not null").select("source", "n", "pos", "pcr"), chunk)
    w = Window.partitionBy("source", "_chunk").orderBy("n")
    rows = rows.select("source", "_chunk", point.alias("p"), F.lag(point).over(w).alias("q"), F.lead("n").over(w).alias("_next"), F.lag("n").over(w).alias("_last"))
    # only a chunk's first and last row are left, so the aggregate is small
    rows = rows.where("_next is null or _last is null")
    own = rows.groupBy("source", "_chunk").agg(F.min_by("p", "p.n").alias("first"), F.max_by("p", "p.n").alias("last"), F.max_by("q", "p.n").alias("second"))
    chunks = Window.partitionBy("source").orderBy("_chunk")
    own = own.select("*", F.lag("last").over(chunks).alias("before"), F.lead("first").over(chunks).alias("after"), F.lead("_chunk").over(chunks).alias("_until"))
    own = own.withColumn("second", F.coalesce("second", "before"))
    return own.select("*", F.lag("second").over(chunks).alias("before2"))


def interpolate_pcr(packets: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Adds ``acc_pcr`` to the packets from the first PCR on.

    Between two PCRs the step of one packet is their distance divided by the packets between,
    whole; after the last PCR the last step goes on. Packets before the first PCR are dropped.
    """
    ends = packets.groupBy("source").agg(F.floor(F.max("n") / chunk).alias("_end"))
    around = _pcr_summary(packets, chunk).join(ends, "source")
    # chunks without a PCR of their own look back to the last chunk that has one
    reach = F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(F.col("_until") - 1, "_end") - F.col("_chunk"))).alias("_on")
    around = around.select("source", F.col("_chunk"), "last", "second", "before", "before2", "after", reach)
    own = F.col("_on") == 0
    around = around.select("source", (F.col("_chunk") + F.col("_on")).alias("_chunk"), F.when(own, F.col("before")).otherwise(F.col("last")).alias("_prev_in"), F.when(own, F.col("before2")).otherwise(F.col("second")).alias("_prev2_in"), F.col("after").alias("_next_in"))
    point = F.when(F.col("pcr").isNotNull(), F.struct("n", "pcr"))
    w = Window.partitionBy("source", "_chunk").orderBy("n")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    # from the end backwards: a frame that grows is kept up, one that shrinks is worked out anew for each row
    later = Window.partitionBy("source", "_chunk").orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1)
    x = _in_chunks(packets, chunk).join(around, ["source", "_chunk"])
    x = x.withColumn("_q", F.when(F.col("pcr").isNotNull(), F.last(point, True).over(w.rowsBetween(Window.unboundedPreceding, -1))))
    pair = F.last(F.when(F.col("pcr").isNotNull(), F.struct(point.alias("p"), F.col("_q").alias("q"))), True).over(so_far)
    x = x.select("*", pair.alias("_pair"), F.last(point, True).over(later).alias("_next"))
    short = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.col(c)["n"].alias("n"), F.col(c)["pcr"].alias("pcr")))
    inside = F.col("_pair").isNotNull()
    x = x.withColumn("_prev", F.when(inside, F.col("_pair.p")).otherwise(short("_prev_in")))
    x = x.withColumn("_prev2", F.when(inside, F.coalesce("_pair.q", short("_prev_in"))).otherwise(short("_prev2_in")))
    x = x.withColumn("_next", F.coalesce("_next", short("_next_in"))).where("_prev is not null")
    step = F.expr(f"pmod(_next.pcr - _prev.pcr, {clock.PCR_MOD}) div (_next.n - _prev.n)")
    last_step = F.expr(f"pmod(_prev.pcr - _prev2.pcr, {clock.PCR_MOD}) div (_prev.n - _prev2.n)")
    moved = F.col("_prev.pcr") + F.coalesce(step, last_step, F.lit(0)) * (F.col("n") - F.col("_prev.n"))
    return x.withColumn("acc_pcr", clock.pcr_unsigned_wrap(moved)).select(*packets.columns, "acc_pcr")


def _pcr_before(packets: DataFrame, chunk: int) -> DataFrame:
    """PCR rows with the one and the two before (``p1``, ``p2``: ``n``, ``pos``, ``pcr``)."""
    rows = _in_chunks(packets.where("pcr is not null").select("source", "n", "pos", "pcr"), chunk)
    w = Window.partitionBy("source", "_chunk").orderBy("n")
    point = F.struct("n", "pos", "pcr")
    x = rows.select("*", F.lag(point).over(w).alias("l1"), F.lag(point, 2).over(w).alias("l2"))
    x = x.join(_pcr_summary(packets, chunk).select("source", "_chunk", "before", "before2"), ["source", "_chunk"])
    second = F.coalesce(F.col("l2"), F.when(F.col("l1").isNull(), F.col("before2")).otherwise(F.col("before")))
    return x.select("source", "n", "pos", "pcr", F.coalesce("l1", "before").alias("p1"), second.alias("p2"))


def pcr_steps(packets: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """PCR rows with their gaps to the one before, rates and linear prediction errors."""
    x = _pcr_before(packets, chunk)
    x = x.withColumn("gap", F.when(F.col("p1").isNotNull(), clock.pcr_unsigned_diff(F.col("pcr"), F.col("p1.pcr"))))
    before = clock.pcr_unsigned_diff(F.col("p1.pcr"), F.col("p2.pcr"))
    rate = ((F.col("p1.pos") - F.col("p2.pos")).cast("double") * 27.0 / before.cast("double")) * 1000000.0
    guess = clock.estimate_pcr(F.col("pos"), F.col("p1.pos"), F.col("p1.pcr"), rate)
    return x.withColumn("error", F.when(F.col("p2").isNotNull(), clock.pcr_signed_diff(F.col("pcr"), guess))).select("source", "n", "pos", "pcr", "gap", "error")


def far_pcrs(packets: DataFrame, limit: int = 20_000, chunk: int = CHUNK) -> DataFrame:
    """``(source, after, n, packets)``: PCRs more than ``limit`` packets behind the one before.

    ``after`` is the packet with the PCR before (null: the start). A player that reads ahead from
    PCR to PCR fails there; interpolation goes on, so this is the check to run before it.
    """
    x = _pcr_before(packets, chunk)
    between = F.col("n") - F.coalesce("p1.n", F.lit(-1))
    return x.where(between > limit).select("source", F.col("p1.n").alias("after"), "n", between.alias("packets"))


def repeat(packets: DataFrame, times: int) -> DataFrame:
    """Each source's packets ``times`` times over, numbers and places going on; ``loop`` counts."""
    ends = packets.groupBy("source").agg((F.max("n") + 1).alias("_all"))
    x = packets.join(ends, "source").withColumn("loop", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))
    shift = F.col("loop") * F.col("_all")
    return x.withColumn("n", F.col("n") + shift).withColumn("pos", F.col("pos") + shift * 188).drop("_all")


def pcr_report(packets: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Per source: PCRs, gaps over 0.1 s, greatest gap, prediction errors, overall rate in bits/s."""
    x = pcr_steps(packets, chunk)
    turn = F.sum("gap")
    return x.groupBy("source").agg(
        F.count("*").alias("pcrs"),
        F.count_if(F.col("gap") > clock.PCR_HZ // 10).alias("bad_gaps"),
        F.max("gap").alias("max_gap"),
        F.min("error").alias("min_error"),
        F.max("error").alias("max_error"),
        F.floor(((F.max("pos") - F.min("pos")).cast("double") * 27000000.0 / turn.cast("double")) * 8.0).cast("long").alias("bits_per_second"),
    )


def unwrap(df: DataFrame, clock_column: str, name: str, chunk: int = CHUNK, max_step: int | None = None) -> DataFrame:
    """Adds ``name``: a 27 MHz clock counted on from its first value, without turns.

    With ``max_step`` a greater step, or one backwards, starts an epoch: ``epoch`` counts them and ``epoch_start`` is
    the counted clock at the epoch's first row.
    """
    own = Window.partitionBy("source", "_chunk").orderBy("n")
    so_far = own.rowsBetween(Window.unboundedPreceding, 0)
    jumps = lambda c: F.lit(False) if max_step is None else (c > max_step) | (c < 0)
    x = _in_chunks(df, chunk)
    x = x.withColumn("_step", F.coalesce(clock.pcr_signed_diff(F.col(clock_column), F.lag(clock_column).over(own)), F.lit(0)))
    x = x.select("*", F.sum("_step").over(so_far).alias("_sum"), F.sum(jumps(F.col("_step")).cast("int")).over(so_far).alias("_epochs"))
    x = x.withColumn("_at", F.last(F.when(jumps(F.col("_step")), F.col("_sum")), True).over(so_far))
    ends = x.groupBy("source", "_chunk").agg(F.min_by(clock_column, "n").alias("_first"), F.max_by(clock_column, "n").alias("_last"), F.sum("_step").alias("_all"), F.max("_epochs").alias("_jumps"), F.max_by("_at", "n").alias("_jumped"))
    chunks = Window.partitionBy("source").orderBy("_chunk")
    upto, ahead = chunks.rowsBetween(Window.unboundedPreceding, 0), chunks.rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("_border", F.coalesce(clock.pcr_signed_diff(F.col("_first"), F.lag("_last").over(chunks)), F.lit(0)))
    zero = F.lit(0)
    ends = ends.select("*", (F.sum("_border").over(upto) + F.coalesce(F.sum("_all").over(ahead), zero)).alias("_base"), (F.sum(jumps(F.col("_border")).cast("int")).over(upto) + F.coalesce(F.sum("_jumps").over(ahead), zero)).alias("_epoch"))
    at_border = F.when(jumps(F.col("_border")), F.col("_base"))
    ends = ends.withColumn("_start", F.coalesce(at_border, F.last(F.coalesce(F.col("_base") + F.col("_jumped"), at_border), True).over(ahead), zero))
    x = x.join(ends.select("source", "_chunk", "_base", "_epoch", "_start"), ["source", "_chunk"])
    added = [(F.col("_base") + F.col("_sum")).alias(name)]
    if max_step is not None:
        added += [(F.col("_epoch") + F.col("_epochs")).alias("epoch"), F.coalesce(F.col("_base") + F.col("_at"), F.col("_start")).alias("epoch_start")]
    return x.select(*df.columns, *added)


def max_rate(packets: DataFrame, time: str, window: int = clock.PCR_HZ // 2, spans: int = 64) -> DataFrame:
    """Per PID the greatest rate, in bits/s, over any ``window`` ticks of ``time`` (27 MHz, unwrapped).

    Time is cut into stretches of ``spans`` windows; a packet less than a window before a cut is
    counted on both sides of it.
    """
    span = window * spans
    own, next_ = F.floor(F.col(time) / span), F.floor((F.col(time) + window) / span)
    x = packets.select("source", "pid", F.col(time).alias("t"), own.alias("own"), F.explode(F.sequence(own, next_)).alias("stretch"))
    w = Window.partitionBy("source", "pid", "stretch").orderBy("t")
    x = x.withColumn("bytes", F.sum(F.lit(188)).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    x = x.withColumn("bytes", F.coalesce("bytes", F.lit(0)))
    back = w.rangeBetween(-window, 0)
    x = x.select("source", "pid", "own", "stretch", (F.col("t") - F.first("t").over(back)).alias("dt"), (F.col("bytes") - F.first("bytes").over(back)).alias("db"))
    rate = F.when(F.col("dt") > 0, F.expr(f"(db * {8 * clock.PCR_HZ}) div dt"))
    return x.where("own = stretch").groupBy("source", "pid").agg(F.max(rate).alias("max_bits_per_second"))


def dts_order(pes: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Per source and PID: timed packets, DTS before or equal to the last, PTS before DTS, DTS steps.

    A missing DTS is the PTS. Each chunk of a PID is counted by itself, and the steps between chunks
    are added from their ends.
    """
    key = ["source", "pid", "_chunk"]
    x = pes.where("pts is not null").select("source", "pid", "pos", "pts", F.coalesce("dts", "pts").alias("dts"), _stretch(chunk))
    step = clock.pts_signed_diff(F.col("dts"), F.lag("dts").over(Window.partitionBy(*key).orderBy("pos")))
    x = x.select(*key, "pos", "dts", step.alias("step"), clock.pts_signed_diff(F.col("pts"), F.col("dts")).alias("ahead"))
    own = x.groupBy(*key).agg(F.count("*").alias("timed"), F.count_if(F.col("step") <= 0).alias("late"), F.count_if(F.col("ahead") < 0).alias("early"), F.min("step").alias("least"), F.max("step").alias("most"), F.min_by("dts", "pos").alias("head"), F.max_by("dts", "pos").alias("tail"))
    border = clock.pts_signed_diff(F.col("head"), F.lag("tail").over(Window.partitionBy("source", "pid").orderBy("_chunk")))
    own = own.withColumn("border", border)
    return own.groupBy("source", "pid").agg(F.sum("timed").alias("timed"), (F.sum("late") + F.count_if(F.col("border") <= 0)).alias("dts_not_later"), F.sum("early").alias("pts_before_dts"), F.min(F.least("least", "border")).alias("min_step"), F.max(F.greatest("most", "border")).alias("max_step"))


def buffering(packets: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Per source and PID: how far PTS and DTS lie ahead of the interpolated PCR, with places, and bytes.

    Least and greatest difference come with their first position; means are floored ticks.
    """
    x = interpolate_pcr(packets.select("source", "n", "pos", "pid", "pcr", "pts", "dts"), chunk).withColumn("t90", F.expr("acc_pcr div 300"))
    dts = F.coalesce("dts", "pts")
    x = x.select("source", "pid", "pos", "pts", dts.alias("dts"), clock.pts_signed_diff(F.col("pts"), F.col("t90")).alias("pts_ahead"), clock.pts_signed_diff(dts, F.col("t90")).alias("dts_ahead"))
    out = [F.count("*").alias("packets"), (F.count("*") * 188).alias("bytes"), F.count("pts").alias("timed"), F.expr("min_by(pts, pos) filter (where pts is not null)").alias("first_pts"), F.expr("max_by(pts, pos) filter (where pts is not null)").alias("last_pts")]
    for k in ("pts", "dts"):
        d = F.col(f"{k}_ahead")
        out += [F.min(d).alias(f"{k}_min"), F.max(d).alias(f"{k}_max"), F.min(F.when(d.isNotNull(), F.struct(d, "pos")))["pos"].alias(f"{k}_min_pos"), (-F.max(F.when(d.isNotNull(), F.struct(d.alias("d"), (-F.col("pos")).alias("p"))))["p"]).alias(f"{k}_max_pos"), F.expr(f"sum({k}_ahead) div count({k}_ahead)").alias(f"{k}_mean")]
    return x.groupBy("source", "pid").agg(*out)


def islands(df: DataFrame, keys: list[str], order: str, starts: Column, name: str = "island") -> DataFrame:
    """Adds ``name``: the number of island starts so far (0: before the first)."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.sum(F.coalesce(starts, F.lit(False)).cast("int")).over(w))


def changes(df: DataFrame, keys: list[str], order: str, value: Column, seed: Column | None = None) -> DataFrame:
    """Rows whose ``value`` differs from the one before (the first differs from ``seed``)."""
    w = Window.partitionBy(*keys).orderBy(order)
    x = df.withColumn("_value", value)
    x = x.withColumn("_first", F.row_number().over(w) == 1).withColumn("_last", F.lag("_value").over(w))
    last = F.when(F.col("_first"), seed if seed is not None else F.lit(None)).otherwise(F.col("_last"))
    differs = ~F.col("_value").eqNullSafe(last)
    return x.where(differs if seed is not None else (F.col("_first") | differs)).drop("_value", "_first", "_last")


def reorder(packets: DataFrame, stamp: str, depth: int | None = None) -> DataFrame:
    """Packets by arrival stamp; with ``depth`` only as far as a buffer of that many allows.

    Without ``depth`` (or while packets are out of place by less) this is a plain sort. The exact
    bounded buffer holds ``depth`` packets' stamps along each source and gives up the least when one
    more comes; packets themselves do not pass through it.
    """
    if depth is None:
        x = places.number(packets, ["source"], places.leading(packets, stamp), [stamp, "pos"], "out_no")
        return x.withColumn("out_no", F.col("out_no") + 1)

    def step(state, time, place):
        heap, n = state
        heapq.heappush(heap, (time, n, place))
        gone = [(heapq.heappop(heap)[2], n + 1 - depth)] if len(heap) > depth else []
        return (heap, n + 1), gone

    def finish(state):
        heap, n = state
        return [(heapq.heappop(heap)[2], n - len(heap)) for _ in range(len(heap))]

    added = T.StructType([T.StructField("_pos", packets.schema["pos"].dataType), T.StructField("out_no", T.LongType())])
    order = emit(packets, ["source"], ["pos"], [stamp, "pos"], lambda: ([], 0), step, finish, added)
    placed = order.withColumnRenamed("source", "_source")
    return packets.join(placed, (F.col("source") == F.col("_source")) & (F.col("pos") == F.col("_pos"))).drop("_source", "_pos")


def insert_at(packets: DataFrame, fractions: list[float], total: int) -> DataFrame:
    """``(pos, kind)`` of a stream of ``total`` packets with packets put in at the given fractions."""
    spark = packets.sparkSession
    places = spark.createDataFrame([(int(f * total),) for f in sorted(fractions)], "n long")
    own = packets.select("n", F.lit(1).alias("kind"))
    return own.unionByName(places.select("n", F.lit(0).alias("kind")))


def schedule(packets: DataFrame, bytes_per_second: int = 250_000, per_item: int = 7) -> DataFrame:
    """Send times by plain rate: packets in items of ``per_item``, microseconds from the start."""
    item = F.floor(F.col("n") / per_item).cast("long")
    return packets.select("source", "n", item.alias("item"), F.expr(f"(n div {per_item}) * {per_item} * 188 * 1000000 div {bytes_per_second}").alias("send_us"))


def schedule_by_pcr(packets: DataFrame, max_gap: int = 2 * clock.PCR_HZ, percent: int = 100, chunk: int = CHUNK) -> DataFrame:
    """Send times by interpolation between PCRs; a gap over ``max_gap``, or a step back, starts a new epoch at 0."""
    x = unwrap(interpolate_pcr(packets.select("source", "n", "pos", "pcr"), chunk), "acc_pcr", "clock", chunk, max_gap)
    return x.select("source", "n", "pos", "epoch", F.expr(f"(clock - epoch_start) * {percent} div 100 div 27").alias("send_us"))


def schedule_by_credit(packets: DataFrame, bytes_per_second: float = 250_000, per_item: int = 7, prime_items: int = 20, speed_percent: float = 100) -> DataFrame:
    """Send times of items of ``per_item`` packets from a credit of bytes and time.

    The credit starts as ``prime_items`` items at the plain rate (``speed_percent`` faster). An item
    takes its bytes' part of the credit's time. Each PCR adds the bytes since the last PCR and the
    time they stand for; the second PCR also replaces the first credit's time by one at the real
    rate. After a gap of over two seconds, and when the credit runs out, it starts anew. State runs
    along each source.
    """
    point = F.min(F.when(F.col("pcr").isNotNull(), F.struct("n", "pcr")))
    items = packets.groupBy("source", F.floor(F.col("n") / per_item).alias("item")).agg(F.count("*").alias("packets"), point.alias("p"))
    items = items.select("source", "item", "packets", F.col("p.n").alias("pcr_n"), F.col("p.pcr").alias("pcr"))
    first_bytes = 188 * per_item * prime_items

    def step(s, count, pcr_n, pcr):
        s = dict(s)
        if s["bytes"] <= 0 or s["time"] <= 0:
            s["bytes"], s["time"] = first_bytes, first_bytes * 1e6 / (s["rate"] * speed_percent / 100)
            if s["seen"] < 2:
                s["primed"] = s["time"]
        size = 188 * count
        took = size / s["bytes"] * s["time"]
        s["clock"] += took
        s["bytes"] -= size
        s["time"] -= took
        if pcr is not None:
            gap = (pcr - s["pcr"]) % clock.PCR_MOD if s["pcr"] is not None else 0
            if gap > 2 * clock.PCR_HZ:
                s["seen"], s["bytes"], s["time"] = 0, 0, 0.0
            elif s["seen"] == 0 or gap == 0:
                s["seen"] = max(s["seen"], 1)
            else:
                new = (pcr_n - s["at"]) * 188
                s["rate"] = new * clock.PCR_HZ / gap
                s["bytes"] += new
                s["time"] += gap / 27
                if s["seen"] == 1:
                    s["time"] += first_bytes * 1e6 / s["rate"] - s["primed"]
                    s["seen"] = 2
            s["pcr"], s["at"] = pcr, pcr_n
        return s, (int(s["clock"]),)

    begin = {"bytes": 0, "time": 0.0, "rate": float(bytes_per_second), "seen": 0, "primed": 0.0, "clock": 0.0, "pcr": None, "at": 0}
    added = T.StructType([T.StructField("send_us", T.LongType())])
    return scan(items, ["source"], ["item"], ["packets", "pcr_n", "pcr"], lambda: begin, step, added).select("source", "item", "send_us")


def waits(sent: DataFrame, limit: int = 200_000) -> DataFrame:
    """Adds ``wait_us``, ``late_us`` and ``reset`` to rows with due (``send_us``) and actual (``now_us``) times.

    A row is due at its time after the start; more than ``limit`` microseconds early or late, the
    start is set anew so that the row is due at once.
    """

    def step(start, due, now):
        start = now - due if start is None else start
        ahead = start + due - now
        reset = abs(ahead) > limit
        if reset:
            start, ahead = now - due, 0
        return start, (max(ahead, 0), max(-ahead, 0), reset)

    added = T.StructType([T.StructField("wait_us", T.LongType()), T.StructField("late_us", T.LongType()), T.StructField("reset", T.BooleanType())])
    return scan(sent, ["source"], ["n"], ["send_us", "now_us"], lambda: None, step, added)


def perturb(scheduled: DataFrame, within: int, seed: int = 1) -> DataFrame:
    """Send times moved by up to ``within`` microseconds either way, alike for a seed, never before 0."""
    noise = F.pmod(F.xxhash64(F.lit(seed), F.col("source"), F.col("n")), F.lit(2 * within + 1)) - within
    return scheduled.withColumn("send_us", F.greatest(F.lit(0).cast("long"), F.col("send_us") + noise))
