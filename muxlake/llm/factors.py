"""Substring dedup (operator 7): relative Lempel-Ziv parsing over words.

Every document is both text to parse and reference. The index splits all documents into reference
blocks at places chosen by content: of the ``gram``-word strings within a window of ``length``
words the one of least hash is the window's anchor, and the windows with one anchor form a block.
Equal stretches of text are cut into equal blocks wherever they stand. The index keeps, for each
block, its earliest occurrence.

A document is parsed greedily, block by block: a block with an earlier occurrence continues the
factor before it if it continues at the same place of the same reference document, else it opens
a factor; a block without one ends it. Factors are at least ``length`` words long, so each is a
duplicate span. At the factors' boundaries, where only a part of a block has occurred before, the
windows are looked up one by one, each against the earliest place of an equal window. So a window
belongs to a duplicate span if and only if its words also start earlier: in a lesser doc_id, or
in the same document at an earlier word.

Defined cases: a null or blank text has no words; texts under ``length`` words lose nothing; a
null ``doc_id`` counts as the least; rows repeated whole tie, and none of them is earlier than the
other; an empty table gives an empty result; further columns do not matter. Words are maximal runs
of bytes other than ``\\x20`` and ``\\x09-\\x0D``, compared unchanged (128-bit names).
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import Words, Workspace, anchor_runs, attach, i64, keyed, map_slices, read_table, slices, tidy

_NO_ID = -(1 << 63)


def _names(words: Words, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128-bit names of the word strings first..last (inclusive)."""
    view, digest = memoryview(words.canon), xxhash.xxh3_128_digest
    raw = b"".join([digest(view[a:b]) for a, b in zip(words.start[first].tolist(), words.end[last].tolist())])
    both = np.frombuffer(raw, np.uint64).reshape(-1, 2)
    return both[:, 0], both[:, 1]


def reference_blocks(docs: DataFrame, length: int = 20, gram: int = 6) -> DataFrame:
    """``(b, c, doc_id, dh, lo, n)``: anchor, block name, first window's word, windows."""
    width = length - gram + 1

    def fn(part, data, offsets):
        words = Words(data, offsets)
        h, _ = words.grams(gram)
        n = len(words.start) - length + 1
        if n <= 0:
            return None
        lo, hi, at = anchor_runs(h, width, words.doc[:n] == words.doc[length - 1 :])
        if not len(lo):
            return None
        c, _ = _names(words, lo, hi + length - 1)
        doc = words.doc[lo]
        ids, dh = (part.column(k).take(pa.array(doc)) for k in ("doc_id", "dh"))
        return pa.RecordBatch.from_arrays([i64(h[at]), i64(c), ids, dh, i64(lo - words.first[doc]).cast(pa.int32()), i64(hi - lo + 1).cast(pa.int32())], ["b", "c", "doc_id", "dh", "lo", "n"])

    return map_slices(keyed(docs), fn, "b long, c long, doc_id long, dh long, lo int, n int")


def _windows(docs: DataFrame, blocks: DataFrame, length: int) -> DataFrame:
    lists = blocks.groupBy("doc_id", "dh").agg(F.collect_list(F.struct("lo", "n")).alias("blocks"))
    rows = attach(keyed(docs).dropDuplicates(["doc_id", "dh"]), lists, "inner")

    def fn(part, data, offsets):
        words = Words(data, offsets)
        blocks = part.column("blocks")
        flat, sizes = blocks.flatten(), np.diff(blocks.offsets.to_numpy())
        doc = np.repeat(np.arange(part.num_rows), sizes)
        lo, n = (flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(2))
        which = np.repeat(np.arange(len(lo)), n)
        at = lo[which] + np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
        start = at + words.first[doc[which]]
        w1, w2 = _names(words, start, start + length - 1)
        take = pa.array(doc[which])
        return pa.RecordBatch.from_arrays([i64(w1), i64(w2), part.column("doc_id").take(take), part.column("dh").take(take), i64(at).cast(pa.int32())], ["w1", "w2", "doc_id", "dh", "lo"])

    return map_slices(rows, fn, "w1 long, w2 long, doc_id long, dh long, lo int")


def parse(docs: DataFrame, work: Workspace, length: int = 20, gram: int = 6) -> DataFrame:
    """``(doc_id, dh, lo, n, ref_id, ref_lo)``: windows that occur earlier, by block.

    The ``n`` windows from word ``lo`` on equal those from word ``ref_lo`` of document ``ref_id``.
    """
    doc = F.coalesce("doc_id", F.lit(_NO_ID))
    place = F.struct(doc.alias("d"), F.col("lo"), F.col("dh"), F.col("n"), F.col("doc_id"))
    blocks = work.put(reference_blocks(docs, length, gram), "blocks")
    # stored, so that both sides of the join are plain shuffles and a hot anchor's rows can be split
    shared = work.put(blocks.groupBy("b").agg(F.count("*").alias("m")).where("m > 1").select(F.col("b").alias("k")), "shared")
    alive = work.put(blocks.join(shared, F.col("b") == F.col("k"), "left_semi"), "alive")
    work.drop("blocks")
    tidy(docs.sparkSession)
    index = work.put(alive.groupBy("b", "c").agg(F.count("*").alias("m"), F.min(place).alias("ref")), "index")
    tidy(docs.sparkSession)
    refs = index.where("m > 1").select(F.col("b").alias("k"), F.col("c").alias("kc"), F.col("ref.d").alias("ref_id"), F.col("ref.lo").alias("ref_lo"))
    later = (doc > F.col("ref_id")) | ((doc == F.col("ref_id")) & (F.col("lo") > F.col("ref_lo")))
    found = work.put(alive.join(refs, (F.col("b") == F.col("k")) & (F.col("c") == F.col("kc"))).where(later).select("doc_id", "dh", "lo", "n", "ref_id", "ref_lo"), "found")
    work.drop("alive")
    tidy(docs.sparkSession)
    # blocks that share an anchor but differ: their windows are looked up singly
    apart = work.put(index.groupBy("b").agg(F.count("*").alias("k")).where("k > 1").select(F.col("b").alias("a")), "apart")
    edge = index.join(apart, F.col("b") == F.col("a"), "left_semi").select("ref.doc_id", "ref.dh", "ref.lo", "ref.n")
    windows = work.put(_windows(docs, edge, length), "windows")
    tidy(docs.sparkSession)
    at = F.struct(doc.alias("d"), F.col("lo"))
    first = windows.groupBy("w1", "w2").agg(F.count("*").alias("m"), F.min(at).alias("ref")).where("m > 1").select(F.col("w1").alias("x1"), F.col("w2").alias("x2"), F.col("ref.d").alias("ref_id"), F.col("ref.lo").alias("ref_lo"))
    single = windows.join(first, (F.col("w1") == F.col("x1")) & (F.col("w2") == F.col("x2"))).where(later).select("doc_id", "dh", "lo", F.lit(1).alias("n"), "ref_id", "ref_lo")
    return found.unionByName(single)


def factors(pieces, length: int) -> list[tuple[int, int, int, int]]:
    """Greedy factors (word, words, ref_id, ref_word) of one document's pieces."""
    out: list[list[int]] = []
    for p in sorted(pieces, key=lambda p: (p["lo"], -p["n"])):
        last = out[-1] if out else None
        if last and last[2] == p["ref_id"] and last[3] - last[0] == p["ref_lo"] - p["lo"] and p["lo"] <= last[0] + last[1] - length + 1:
            last[1] = max(last[1], p["lo"] + p["n"] - 1 + length - last[0])
        else:
            out.append([p["lo"], p["n"] - 1 + length, p["ref_id"], p["ref_lo"]])
    return [tuple(x) for x in out]


def dedup(docs: DataFrame, length: int = 20, gram: int = 6, work: Workspace | None = None) -> DataFrame:
    """``(doc_id, dh, kept, n_words, n_removed, factors)`` of every row."""
    work = work or Workspace(docs.sparkSession, "factors")
    piece = F.struct("lo", "n", "ref_id", "ref_lo")
    lists = work.put(parse(docs, work, length, gram).groupBy("doc_id", "dh").agg(F.collect_list(piece).alias("pieces")), "pieces")
    tidy(docs.sparkSession)
    factor = pa.struct([("word", pa.int64()), ("words", pa.int64()), ("ref_id", pa.int64()), ("ref_word", pa.int64())])

    def run(batches):
        for batch in batches:
            for part, data, offsets in slices(batch):
                words = Words(data, offsets)
                kept, sizes, removed, all_factors = [], [], [], []
                for i, pieces in enumerate(part.column("pieces").to_pylist()):
                    a, b = int(words.first[i]), int(words.first[i + 1])
                    own = factors(pieces, length) if pieces else []
                    keep = np.ones(b - a, bool)
                    for word, n, _, _ in own:
                        keep[word : word + n] = False
                    if own:
                        at = np.flatnonzero(keep) + a
                        view = words.canon
                        kept.append(b" ".join([view[s:e].tobytes() for s, e in zip(words.start[at].tolist(), words.end[at].tolist())]))
                    else:
                        kept.append(words.canon[words.start[a] : words.end[b - 1]].tobytes() if b > a else b"")
                    sizes.append(b - a)
                    removed.append(b - a - int(keep.sum()))
                    all_factors.append([dict(zip(("word", "words", "ref_id", "ref_word"), f)) for f in own])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("dh"), pa.array(kept, pa.binary()), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(all_factors, pa.list_(factor))], ["doc_id", "dh", "kept", "n_words", "n_removed", "factors"])

    return attach(keyed(docs), lists).mapInArrow(run, "doc_id long, dh long, kept binary, n_words long, n_removed long, factors array<struct<word: long, words: long, ref_id: long, ref_word: long>>")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that every document loses, with the digest of what stays."""
    rows = dedup(read_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"), F.size("factors").cast("long").alias("n_factors"))


def brute_force(texts: dict[int, str | None], length: int = 20) -> dict[int, tuple[int, int, str]]:
    """The same by a dictionary of all windows; for tests."""
    words = {k: re.findall(r"[^\x20\x09-\x0D]+", texts[k] or "") for k in sorted(texts)}
    seen: set[tuple[str, ...]] = set()
    out = {}
    for k, w in words.items():
        keep = [True] * len(w)
        for i in range(len(w) - length + 1):
            key = tuple(w[i : i + length])
            if key in seen:
                keep[i : i + length] = [False] * length
            seen.add(key)
        left = " ".join(x for x, on in zip(w, keep) if on)
        out[k] = (len(w), keep.count(False), hashlib.sha256(left.encode()).hexdigest())
    return out
