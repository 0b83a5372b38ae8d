"""LM scoring (operator 8): cross-entropy difference of two matched bigram models.

The target model is trained on the documents that are labelled as of good quality, the background
model on all documents. Both have one vocabulary (all words of all documents), one order, and one
smoothing:
P(v | u) = a * c(u, v) / c(u) + (1 - a) * (c(v) + 1) / (n + words + 2), a = c(u) / (c(u) + 5).
A document's score is its mean over tokens of the target's loss less the background's (nats): the
lower, the more it is like the target. A document's own counts are taken out of both models when
it is scored, so a labelled document is not favoured.

Counts are exact, over every token of every document, and grow with the corpus: words, contexts and
bigrams have names of 64 bits, two of them for the kind. Documents are dealt to blocks of about
``BLOCK_BYTES``; a block sends each distinct name once with its counts to the name's shard, shards
sum them up, and each block gets the sums of its own names back. Nothing is held for the whole
corpus in one place but the numbers of tokens and of distinct words.

Defined cases: a null text is empty; a text without words has 0 tokens and null losses; without
any labelled document the target model is the smoothing alone; null labels or ids do not count as
labelled; rows that repeat an id are counted and scored each; an empty table gives an empty
result; further columns do not matter. Words are cut at ``[\\x20\\x09-\\x0D]``, ASCII lower-cased.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import Words, Workspace, i64, mix64, read_table, slices, tidy

#: Text of a block of documents, and text whose names a shard sums up.
BLOCK_BYTES, SHARD_BYTES = 1 << 22, 1 << 23
_START = np.uint64(0x9E3779B97F4A7C15)
_SEEDS = tuple(np.uint64(x) for x in (0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5))


def _pack(x: np.ndarray) -> bytes:
    """Numbers as all their first bytes, then all second ones and so on, which compress well."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.itemsize).T.tobytes()


def _unpack(raw: bytes, kind: type) -> np.ndarray:
    """The numbers of :func:`_pack`."""
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).view(kind).ravel()


def _names(x: np.ndarray, kind: int) -> np.ndarray:
    """Names of words (kind 0), contexts (1) or bigrams (2)."""
    return mix64(x ^ _SEEDS[kind]) & ~np.uint64(3) | np.uint64(kind)


class Tokens:
    """Of a block's texts: each token's row and, by kind, the place of its name in ``names``."""

    def __init__(self, table: pa.Table):
        docs, kinds, at = [np.zeros(0, np.int64)], [[np.zeros(0, np.uint64)] for _ in range(3)], 0
        for batch in table.select(["text"]).to_batches():
            for part, data, offsets in slices(batch):
                words = Words(data, offsets, lower=True)
                h = words.span_hash(words.start, words.end) if len(words.start) else np.zeros(0, np.uint64)
                context = np.empty_like(h)
                context[1:] = h[:-1]
                lead = words.first[:-1]
                context[lead[lead < words.first[1:]]] = _START
                docs.append(words.doc + at)
                for kind, x in enumerate((h, context, context * _START + mix64(h))):
                    kinds[kind].append(_names(x, kind))
                at += part.num_rows
        self.doc = np.concatenate(docs)
        self.names, place = np.unique(np.concatenate([x for kind in kinds for x in kind]), return_inverse=True)
        self.word, self.context, self.pair = np.split(place.astype(np.int64), 3)
        self.chosen = table.column("target").to_numpy().astype(bool)

    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        """How often each name occurs in the labelled and in all documents."""
        own = self.chosen[self.doc]
        both = [np.zeros(len(self.names), np.int64), np.zeros(len(self.names), np.int64)]
        for place in (self.word, self.context, self.pair):
            both[0] += np.bincount(place[own], minlength=len(self.names))
            both[1] += np.bincount(place, minlength=len(self.names))
        return both[0], both[1]


def _own(doc: np.ndarray, value: np.ndarray) -> np.ndarray:
    """How often each position's value occurs in its document."""
    key = doc.astype(np.int64) << np.int64(32) | value
    _, at, n = np.unique(key, return_inverse=True, return_counts=True)
    return n[at]


def losses(t: Tokens, counts: np.ndarray, tokens: int, within: np.ndarray, words: int) -> np.ndarray:
    """Loss of each token in a model of ``counts`` by name and ``tokens``; ``within`` tells the texts whose own counts are taken out."""
    inside = within[t.doc]
    each = np.bincount(t.doc, minlength=len(within))
    pair, context, word = (counts[x] - _own(t.doc, x) * inside for x in (t.pair, t.context, t.word))
    total = tokens - (each * within)[t.doc]
    share = context / (context + 5.0)
    return -np.log(share * pair / np.maximum(context, 1) + (1 - share) * (word + 1) / (total + words + 2))


def label(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(doc_id, text, target)``: ``target`` marks documents labelled as of good quality."""
    good = labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("long").alias("good_id")).distinct()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    # one plan at every size: whether labels fit a broadcast would else decide if texts move
    return rows.join(good.hint("merge"), F.col("doc_id") == F.col("good_id"), "left").select("doc_id", "text", F.col("good_id").isNotNull().alias("target"))


def score(labelled: DataFrame, work: Workspace | None = None) -> DataFrame:
    """``(doc_id, n_tokens, target_loss, background_loss, score)`` of ``(doc_id, text, target)``."""
    spark = labelled.sparkSession
    work = work or Workspace(spark, "losses")
    stored = work.put(labelled, "labelled")
    size = stored.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks, shards = -(-size // BLOCK_BYTES) or 1, -(-size // SHARD_BYTES) or 1
    parts = work.buckets
    tidy(spark)
    # texts move once more: both passes over the blocks read them from buckets of whole blocks
    rows = stored.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)))
    rows = work.put_sorted(rows.repartition(parts, "block"), "blocks", parts, "block")
    work.drop("labelled")
    tidy(spark)

    def ask(table: pa.Table) -> pa.Table:
        t = Tokens(table)
        target, background = t.counts()
        shard = ((t.names >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)
        cut = np.searchsorted(shard, np.arange(shards + 1).astype(np.uint64))
        some = np.flatnonzero(cut[1:] > cut[:-1])
        pieces = [slice(cut[k], cut[k + 1]) for k in some]
        # names are sorted: their differences have fewer bytes
        names = pa.array([_pack(np.diff(t.names[x], prepend=np.uint64(0))) for x in pieces], pa.binary())
        columns = [pa.array([_pack(n[x].astype(np.int32)) for x in pieces], pa.binary()) for n in (target, background)]
        block = table.column("block")[0].as_py()
        return pa.table([i64(np.full(len(some), block)), i64(some), names, *columns], ["block", "shard", "names", "target", "background"])

    def add(table: pa.Table) -> pa.Table:
        raw = [np.cumsum(_unpack(x, np.uint64), dtype=np.uint64) for x in table.column("names").to_pylist()]
        names, place = np.unique(np.concatenate(raw), return_inverse=True)
        sums = [np.bincount(place, np.concatenate([_unpack(x, np.int32) for x in table.column(k).to_pylist()]), len(names)).astype(np.int64) for k in ("target", "background")]
        cut = np.cumsum([0] + [len(x) for x in raw])
        back = [pa.array([_pack(x[place[a:b]]) for a, b in zip(cut[:-1], cut[1:])], pa.binary()) for x in sums]
        word = (names & np.uint64(3)) == 0
        # the shard's own numbers go with its first row
        whole = [i64(np.append(x, np.zeros(len(raw) - 1, np.int64))) for x in (word.sum(), sums[0][word].sum(), sums[1][word].sum())]
        return pa.table([table.column("block"), table.column("shard"), *back, *whole], ["block", "shard", "target", "background", "words", "n_target", "n_background"])

    asked = rows.groupBy("block").applyInArrow(ask, "block long, shard long, names binary, target binary, background binary")
    with work.sorted_scans():
        answers = work.put(asked.groupBy("shard").applyInArrow(add, "block long, shard long, target binary, background binary, words long, n_target long, n_background long"), "answers", row_group=1 << 22)
    tidy(spark)
    words, n_target, n_background = (x or 0 for x in answers.agg(F.sum("words"), F.sum("n_target"), F.sum("n_background")).first())

    def fn(table: pa.Table, answer: pa.Table) -> pa.Table:
        t = Tokens(table)
        answer = answer.sort_by("shard")
        n = np.bincount(t.doc, minlength=table.num_rows)
        means = []
        for kind, tokens, within in (("target", n_target, t.chosen), ("background", n_background, np.ones(table.num_rows, bool))):
            counts = np.concatenate([np.zeros(0, np.int64), *(_unpack(x, np.int64) for x in answer.column(kind).to_pylist())])
            sums = np.bincount(t.doc, losses(t, counts, tokens, within, words), minlength=table.num_rows)
            means.append(np.where(n > 0, sums / np.maximum(n, 1), np.nan))
        columns = [pa.array(x, pa.float64(), from_pandas=True) for x in (*means, means[0] - means[1])]
        return pa.table([table.column("doc_id"), i64(n), *columns], ["doc_id", "n_tokens", "target_loss", "background_loss", "score"])

    answers = answers.select("block", "shard", "target", "background")
    return rows.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(fn, "doc_id long, n_tokens long, target_loss double, background_loss double, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's losses under both models and their difference."""
    return score(label(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")))
