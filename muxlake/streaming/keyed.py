"""Keyed state over streams: continuity, hysteresis, sections and bounded re-ordering.

Each processor keeps one small state for each key, and takes a trigger's rows of a key in order.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def _stateful(stream: DataFrame, keys: list[str], out: str, state: str, fn: Callable, timeout: str = GroupStateTimeout.NoTimeout) -> DataFrame:
    return stream.groupBy(*keys).applyInPandasWithState(fn, out, state, "append", timeout)


def _ordered(batches: Iterator[pd.DataFrame], by: str) -> pd.DataFrame:
    """All rows that a trigger brings for a key, in order."""
    return pd.concat(list(batches), ignore_index=True).sort_values(by, kind="stable")


def continuity(stream: DataFrame, content: str | None = None) -> DataFrame:
    """``(source, pid, pos, fault)``: packets whose counter is wrong, as they come.

    Faults are ``discontinuity``, ``duplicate`` (repeated more than once) and, with a ``content``
    column, ``content`` (repeated with other bytes); the batch operator counts the same packets.
    """
    x = stream.withColumn("digest", F.xxhash64(content) if content else F.lit(0).cast("long"))

    def run(key, batches: Iterator[pd.DataFrame], state: GroupState):
        last, digest, repeats = state.get if state.exists else (None, None, 0)
        rows = []
        for r in _ordered(batches, "pos").itertuples():
            if last is not None and not r.disc:
                if r.cc != last:
                    repeats = 0
                    if not r.has_payload or (last + 1) % 16 != r.cc:
                        rows.append((*key, r.pos, "discontinuity"))
                elif r.has_payload:
                    repeats += 1
                    if repeats > 1:
                        rows.append((*key, r.pos, "duplicate"))
                    if r.digest != digest:
                        rows.append((*key, r.pos, "content"))
            last, digest = int(r.cc), int(r.digest)
        state.update((last, digest, repeats))
        yield pd.DataFrame(rows, columns=["source", "pid", "pos", "fault"])

    return _stateful(x, ["source", "pid"], "source string, pid long, pos long, fault string", "last int, digest long, repeats int", run)


def sections(stream: DataFrame, limit: int = 6 * 90_000) -> DataFrame:
    """``(source, dst_ip, dst_port, pkt_no, section)`` by time, clock and skew jumps."""
    turn = 1 << 33

    def near(d):
        return (int(d) + turn // 2) % turn - turn // 2

    def run(key, batches: Iterator[pd.DataFrame], state: GroupState):
        t0, p0, t1, p1, section = state.get if state.exists else (None, None, None, None, 0)
        rows = []
        for r in _ordered(batches, "pkt_no").itertuples():
            t, p = int(r.t90), int(r.pcr90)
            if t0 is None:
                t0, p0 = t, p
            elif abs(t - t1) > limit or abs(near(p - p1)) > limit or near(p - p0) - (t - t0) > limit:
                t0, p0, section = t, p, section + 1
            t1, p1 = t, p
            rows.append((*key, r.pkt_no, section))
        state.update((t0, p0, t1, p1, section))
        yield pd.DataFrame(rows, columns=["source", "dst_ip", "dst_port", "pkt_no", "section"])

    return _stateful(stream, ["source", "dst_ip", "dst_port"], "source string, dst_ip long, dst_port long, pkt_no long, section int", "t0 long, p0 long, t1 long, p1 long, section int", run)


def plausibility(stream: DataFrame) -> DataFrame:
    """``(source, dst_ip, dst_port, pkt_no, score)``: hysteresis of TS-shaped payloads."""

    def run(key, batches: Iterator[pd.DataFrame], state: GroupState):
        score = state.get[0] if state.exists else 0
        rows = []
        for r in _ordered(batches, "pkt_no").itertuples():
            data = bytes(r.payload or b"")
            for ok in [len(data) > 0 and len(data) % 188 == 0] + [data[i] == 0x47 for i in range(0, len(data), 188)]:
                score = max(-10, min(10, score + (1 if ok else -1)))
            rows.append((*key, r.pkt_no, score))
        state.update((score,))
        yield pd.DataFrame(rows, columns=["source", "dst_ip", "dst_port", "pkt_no", "score"])

    return _stateful(stream, ["source", "dst_ip", "dst_port"], "source string, dst_ip long, dst_port long, pkt_no long, score int", "score int", run)


def reorder(stream: DataFrame, depth: int = 4, silence_ms: int | None = None) -> DataFrame:
    """``(source, out_no, stamp, n)``: packets by stamp through a buffer of ``depth`` packets.

    The packets still in the buffer are emitted once later ones push them out, or when nothing came
    for ``silence_ms`` milliseconds.
    """

    def run(key, batches: Iterator[pd.DataFrame], state: GroupState):
        held, out_no = (list(zip(state.get[0], state.get[1])), state.get[2]) if state.exists else ([], 0)
        held, rows = [(int(a), int(b)) for a, b in held], []
        heapq.heapify(held)
        if state.hasTimedOut:
            while held:
                out_no += 1
                rows.append((*key, out_no, *heapq.heappop(held)))
        else:
            for r in _ordered(batches, "n").itertuples():
                heapq.heappush(held, (int(r.stamp), int(r.n)))
                if len(held) > depth:
                    out_no += 1
                    rows.append((*key, out_no, *heapq.heappop(held)))
        state.update(([h[0] for h in held], [h[1] for h in held], out_no))
        if silence_ms is not None and held:
            state.setTimeoutDuration(silence_ms)
        yield pd.DataFrame(rows, columns=["source", "out_no", "stamp", "n"])

    timeout = GroupStateTimeout.NoTimeout if silence_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    return _stateful(stream, ["source"], "source string, out_no long, stamp long, n long", "stamps array<long>, ns array<long>, out_no long", run, timeout)


def rates(stream: DataFrame, span: str = "500 milliseconds", slide: str = "100 milliseconds", late: str = "2 seconds") -> DataFrame:
    """Bits a second of each PID over sliding event-time windows of ``ts``."""
    w = F.window("ts", span, slide)
    n = stream.withWatermark("ts", late).groupBy("source", "pid", w).agg(F.count("*").alias("packets"))
    seconds = F.unix_micros(F.col("window.end")) - F.unix_micros(F.col("window.start"))
    return n.select("source", "pid", F.col("window.start").alias("from"), (F.col("packets") * 188 * 8 * 1_000_000 / seconds).cast("long").alias("bits_per_second"))


def sessions(stream: DataFrame, silence: str = "6 seconds", late: str = "2 seconds") -> DataFrame:
    """Packets of each stream between silences (the time rule alone)."""
    return stream.withWatermark("ts", late).groupBy("source", "dst_ip", "dst_port", F.session_window("ts", silence)).agg(F.count("*").alias("packets"))
