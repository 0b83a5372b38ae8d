"""Suffix-array dedup (operator 6): bucket-pointer refinement over all texts.

Two byte strings of ``length`` are found equal by refining buckets of suffixes. A suffix's bucket
identifier at depth q names its first q bytes; identifiers are content names, so each task knows a
suffix's identifier without a global rank. Initial buckets of q = 8 bytes are refined to 16, 32, 64
and 128 by pairing a suffix's identifier with that of the suffix q later; each round reuses what
the round before has made. Longer strings are named, in 128 bits, by folding the identifiers at
offsets 0, 128, 256 and so on.

Only suffixes that can matter are compared between tasks. Of the suffixes whose 128 bytes lie within
a ``length``-byte window, the least identifier is the window's anchor: equal windows have equal
anchors at equal places. A run of consecutive windows with one anchor is one row:

1. bucket by the anchor's identifier; a bucket of one row is closed (nothing equal);
2. refine by the identifiers of the later offsets up to the run's end: rows still together are
   equal over the whole run, so all its windows repeat;
3. only for buckets that fall apart in step 2, both steps are repeated on pieces of ``STEPS`` windows
   cut at fixed distances from the anchor (bucket: the bytes common to a piece's windows;
   refined: all its bytes), at last on single windows, where bucket and string are the same.

Hence a window is marked if and only if an equal one starts anywhere else, the same document
included. Counts are pre-aggregated before each shuffle, joins are on content names with one
unique side, and no group is gathered in a task.

Defined cases: a null text is empty; texts shorter than ``length`` lose nothing; rows repeated
whole are two places of the same bytes, so both lose them; null ids are kept apart by text;
an empty table gives an empty result; further columns do not matter.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import Workspace, anchor_runs, attach, i64, keyed, map_slices, mix64, read_table, slices, tidy

#: Depth of the anchors' buckets.
DEPTH = 128
#: Windows in a piece, round by round.
STEPS = (16, 1)
_FIRST, _LANES = np.uint64(0x8CB92BA72F3D8DD7), (np.uint64(0xA24BAED4963EE407), np.uint64(0xD6E8FEB86659FD93))


def _refine(here: np.ndarray, later: np.ndarray) -> np.ndarray:
    """The identifier of a suffix from its own and a later offset's, both at a lesser depth."""
    x = here * _FIRST
    x ^= x >> np.uint64(32)
    x += later
    x *= _LANES[1]
    x ^= x >> np.uint64(29)
    return x


def buckets(data: np.ndarray) -> np.ndarray:
    """Identifiers at depth 128 of all suffixes that have as many bytes."""
    if len(data) < DEPTH:
        return np.zeros(0, np.uint64)
    names = np.empty(len(data) - 7, np.uint64)
    for k in range(8):
        words = (len(data) - k) // 8
        names[k::8] = np.frombuffer(data[k : k + 8 * words].tobytes(), "<u8")
    depth = 8
    while depth < DEPTH:
        names = _refine(names[:-depth], names[depth:])
        depth *= 2
    return names


def _deepen(names: np.ndarray, start: np.ndarray, size: np.ndarray) -> list[np.ndarray]:
    """128-bit names of the strings at ``start`` with ``size`` (at least 128) bytes."""
    steps = -(-(size - DEPTH) // DEPTH)
    last = start + size - DEPTH
    out = []
    for lane in _LANES:
        x = mix64(names[start] * lane + size.astype(np.uint64))
        for k in range(1, int(steps.max(initial=0)) + 1):
            on = steps >= k
            x[on] = mix64(x[on] * lane + names[np.minimum(start[on] + k * DEPTH, last[on])])
        out.append(x)
    return out


def _runs(docs: DataFrame, length: int) -> DataFrame:
    """A row for each run of windows with one anchor."""
    width = length - DEPTH + 1

    def fn(part, data, offsets):
        names = buckets(data)
        starts = np.arange(max(0, len(names) - width + 1))
        if not len(starts):
            return None
        # a window must not cross the end of its text
        of = np.repeat(np.arange(part.num_rows), np.diff(offsets))[: len(starts)]
        lo, hi, at = anchor_runs(names, width, starts + length <= offsets[of + 1])
        if not len(lo):
            return None
        doc = of[lo]
        s1, s2 = _deepen(names, lo, hi - lo + length)
        ids, dh = (part.column(k).take(pa.array(doc)) for k in ("doc_id", "dh"))
        return pa.RecordBatch.from_arrays([i64(names[at]), i64(s1), i64(s2), ids, dh, *(i64(x).cast(pa.int32()) for x in (lo - offsets[doc], hi - lo + 1, at - offsets[doc]))], ["k1", "s1", "s2", "doc_id", "dh", "lo", "n", "anchor"])

    return map_slices(keyed(docs), fn, "k1 long, s1 long, s2 long, doc_id long, dh long, lo int, n int, anchor int")


def _pieces(docs: DataFrame, runs: DataFrame, length: int, step: int) -> DataFrame:
    """The given runs cut into pieces of ``step`` windows at fixed distances from the anchor."""
    lists = runs.groupBy("doc_id", "dh").agg(F.collect_list(F.struct("lo", "n", "anchor", "need")).alias("runs"))
    rows = attach(keyed(docs).dropDuplicates(["doc_id", "dh"]), lists, "inner")

    def fn(part, data, offsets):
        names = buckets(data)
        runs = part.column("runs")
        flat, sizes = runs.flatten(), np.diff(runs.offsets.to_numpy())
        doc = np.repeat(np.arange(part.num_rows), sizes)
        lo, n, anchor, need = (flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(4))
        # piece k has the windows at distances k * step .. k * step + step - 1 before the anchor
        near, far = (anchor - lo - n + 1) // step, (anchor - lo) // step
        count = far - near + 1
        which = np.repeat(np.arange(len(lo)), count)
        k = near[which] + np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
        whole_lo = anchor[which] - k * step - step + 1
        first = np.maximum(whole_lo, lo[which])
        last = np.minimum(whole_lo + step - 1, lo[which] + n[which] - 1)
        base, size = offsets[doc[which]], np.diff(offsets)[doc[which]]
        k1, k2 = _deepen(names, base + whole_lo + step - 1, np.full(len(k), length - step + 1))
        if step > 1:
            # a piece cut short by its run or its text has a name of its own: the piece across the border
            # of two runs on one grid would else enter twice and meet itself
            fits = (first == whole_lo) & (last == whole_lo + step - 1) & (whole_lo + step - 1 + length <= size)
            own = mix64(part.column("dh").to_numpy().view(np.uint64)[doc[which]] + first.astype(np.uint64))
            s1, s2 = own, mix64(own + part.column("doc_id").fill_null(0).to_numpy().view(np.uint64)[doc[which]])
            t1, t2 = _deepen(names, (base + whole_lo)[fits], np.full(int(fits.sum()), length + step - 1))
            s1[fits], s2[fits] = t1, t2
        else:
            s1, s2 = k1, k2
        take = pa.array(doc[which])
        return pa.RecordBatch.from_arrays([*map(i64, (k1, k2, s1, s2)), part.column("doc_id").take(take), part.column("dh").take(take), *(i64(x).cast(pa.int32()) for x in (first, last - first + 1, anchor[which])), pa.array(need[which].astype(bool))], ["k1", "k2", "s1", "s2", "doc_id", "dh", "lo", "n", "anchor", "need"])

    return map_slices(rows, fn, "k1 long, k2 long, s1 long, s2 long, doc_id long, dh long, lo int, n int, anchor int, need boolean")


def _same(a: str, b: str, names: list[str]):
    out = F.lit(True)
    for x in names:
        out = out & (F.col(f"{a}{x}") == F.col(f"{b}{x}"))
    return out


def _split(rows: DataFrame, bucket: list[str], work: Workspace, label: str) -> tuple[DataFrame, DataFrame]:
    """Buckets and refines rows: those that repeat whole, and those to be cut further.

    Of the rows to be cut, ``need`` marks those not decided yet; the others (one of each class of
    equal rows) are there to be met.
    """
    spark, names = work.spark, [*bucket, "s1", "s2"]
    rows = work.put(rows, f"rows-{label}")
    tidy(spark)
    # stored, so that both sides of the join are plain shuffles and a hot bucket's rows can be split
    shared = work.put(rows.groupBy(*bucket).agg(F.count("*").alias("m"), F.max("need").alias("any")).where("m > 1 and any").select(*[F.col(x).alias(f"b_{x}") for x in bucket]), f"shared-{label}")
    alive = work.put(rows.join(shared, _same("", "b_", bucket), "left_semi"), f"alive-{label}")
    work.drop(f"rows-{label}")
    tidy(spark)
    place = F.struct("doc_id", "dh", "lo", "n", "anchor")
    classes = work.put(alive.groupBy(*names).agg(F.count("*").alias("m"), F.max("need").alias("need"), F.min(place).alias("one")), f"classes-{label}")
    tidy(spark)
    whole = classes.where("m > 1 and need").select(*[F.col(x).alias(f"c_{x}") for x in names])
    marked = work.put(alive.where("need").join(whole, _same("", "c_", names), "left_semi").select("doc_id", "dh", "lo", "n"), f"marked-{label}")
    work.drop(f"alive-{label}")
    tidy(spark)
    open_ = (F.col("m") == 1) & F.col("need")
    apart = work.put(classes.groupBy(*bucket).agg(F.count("*").alias("k"), F.max(open_).alias("open")).where("k > 1 and open").select(*[F.col(x).alias(f"b_{x}") for x in bucket]), f"apart-{label}")
    edge = classes.join(apart, _same("", "b_", bucket), "left_semi").select("one.*", open_.alias("need"))
    return marked, edge


def repeats(docs: DataFrame, work: Workspace, length: int = 400) -> DataFrame:
    """``(doc_id, dh, starts)``: first windows and counts of the repeated windows' runs."""
    if length < 2 * DEPTH:
        raise ValueError(f"length must be at least {2 * DEPTH}")
    marked, edge = _split(_runs(docs, length).withColumn("need", F.lit(True)), ["k1"], work, "runs")
    for step in STEPS:
        more, edge = _split(_pieces(docs, edge, length, step), ["k1", "k2"], work, f"step{step}")
        marked = marked.unionByName(more)
    return marked.groupBy("doc_id", "dh").agg(F.collect_list(F.struct("lo", "n")).alias("starts"))


def spans(size: int, starts, length: int) -> np.ndarray:
    """Maximal covered runs, as rows (from, to)."""
    step = np.zeros(size + 1, np.int64)
    lo = np.fromiter((s["lo"] for s in starts), np.int64, len(starts))
    n = np.fromiter((s["n"] for s in starts), np.int64, len(starts))
    np.add.at(step, lo, 1)
    np.add.at(step, lo + n - 1 + length, -1)
    on = np.concatenate(([0], (np.cumsum(step[:-1]) > 0).astype(np.int8), [0]))
    turn = np.flatnonzero(np.diff(on))
    return turn.reshape(-1, 2)


def dedup(docs: DataFrame, length: int = 400, work: Workspace | None = None) -> DataFrame:
    """``(doc_id, dh, kept, n_bytes, spans)``: what is left, and the removed byte ranges."""
    work = work or Workspace(docs.sparkSession, "suffixes")
    starts = work.put(repeats(docs, work, length), "starts")
    tidy(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("dh", pa.int64()), ("kept", pa.binary()), ("n_bytes", pa.int64()), ("spans", pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())])))])

    def run(batches):
        for batch in batches:
            for part, data, offsets in slices(batch):
                kept, sizes, removed = [], [], []
                for i, found in enumerate(part.column("starts").to_pylist()):
                    own = data[offsets[i] : offsets[i + 1]]
                    cut = spans(len(own), found, length) if found else np.zeros((0, 2), np.int64)
                    keep = np.ones(len(own), bool)
                    for a, b in cut:
                        keep[a:b] = False
                    kept.append(own[keep].tobytes())
                    sizes.append(len(own))
                    removed.append([{"from": int(a), "to": int(b)} for a, b in cut])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("dh"), pa.array(kept, pa.binary()), pa.array(sizes, pa.int64()), pa.array(removed, schema.field("spans").type)], schema=schema)

    return attach(keyed(docs), starts).mapInArrow(run, "doc_id long, dh long, kept binary, n_bytes long, spans array<struct<from: long, to: long>>")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes that every document loses, with the digest of what stays."""
    rows = dedup(read_table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["to"] - s["from"])
    return rows.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(texts: dict[int, str | None], length: int = 400) -> dict[int, tuple[int, int, int, str]]:
    """The same by a dictionary of all windows; for tests."""
    raw = {k: (t or "").encode() for k, t in texts.items()}
    count: dict[bytes, int] = {}
    for b in raw.values():
        for i in range(len(b) - length + 1):
            w = b[i : i + length]
            count[w] = count.get(w, 0) + 1
    out = {}
    for k, b in raw.items():
        keep = [True] * len(b)
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                keep[i : i + length] = [False] * length
        left = bytes(x for x, on in zip(b, keep) if on)
        n_spans = sum(1 for i, on in enumerate(keep) if not on and (i == 0 or keep[i - 1]))
        out[k] = (len(b), len(b) - len(left), n_spans, hashlib.sha256(left).hexdigest())
    return out
