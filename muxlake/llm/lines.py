"""Line dedup (operator 5): levelled sorted runs of line hashes.

The store keeps the 128-bit hashes of all lines seen, with the first document that holds each,
as sorted runs on levels. A new batch of documents is merge-anti-joined with every run: the hashes
that no run has form a new run on level 0; when a level has ``fanout`` runs they are merged into
one sorted run of the next level. Batches come in ascending doc_id, so the document recorded for
a hash is the least that holds it.

A line's key is the line stripped of ``[\\x20\\x09-\\x0D]`` at both ends, with A-Z lower-cased; a
key shorter than ``min_chars`` code points is never dropped. A document keeps every occurrence of
the lines it holds first.

Defined cases: a null or empty text is one empty line; a null ``doc_id`` counts as the least;
rows that repeat an id count as one document; ties cannot arise otherwise; an empty table gives
an empty result; further columns do not matter. Hot lines are pre-aggregated before the shuffle,
and the join that tells which rows lose a line has the document in its key, so a hot line's rows
are spread.
"""

from __future__ import annotations

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import Workspace, attach, keyed, map_columns, read_table, unused

_STRIP = " \t\n\x0b\x0c\r"
_NO_ID = -(1 << 63)


def line_key(line: str) -> bytes:
    """The bytes that decide whether two lines are equal."""
    return line.strip(_STRIP).encode("utf-8", "surrogatepass").lower()


def _hash(key: bytes) -> tuple[int, int]:
    x = xxhash.xxh3_128_intdigest(key)
    return (x >> 64) - (1 << 63), (x & (1 << 64) - 1) - (1 << 63)


def line_hashes(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """``(doc, doc_id, dh, h1, h2)``: each distinct long line of each document row."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                x = batch.slice(at, 2000).to_pydict()
                rows = []
                for doc_id, dh, text in zip(x["doc_id"], x["dh"], x["text"]):
                    for pair in {_hash(line_key(s)) for line in text.split("\n") if len(s := line.strip(_STRIP)) >= min_chars}:
                        rows.append((doc_id, dh, *pair))
                cols = list(zip(*rows)) or [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "dh", "h1", "h2"])

    out = keyed(docs).mapInArrow(run, "doc_id long, dh long, h1 long, h2 long")
    return out.withColumn("doc", F.coalesce("doc_id", F.lit(_NO_ID)))


class LineRuns:
    """Sorted runs of line hashes on levels; runs are tables ``(h1, h2, first)``.

    All runs are cut by one hash into equally many buckets, each a sorted file, so a bucket of a
    batch meets the same bucket of every run in one task, and neither merging a batch with the
    runs nor merging runs moves the runs' rows.
    """

    def __init__(self, work: Workspace, fanout: int = 2):
        self.work, self.fanout, self.made = work, fanout, 0
        self.parts = work.buckets
        self.levels: list[list[tuple[str, DataFrame]]] = [[]]

    def _write(self, rows: DataFrame, level: int) -> DataFrame:
        name = f"run-{level}-{self.made}"
        self.made += 1
        while len(self.levels) <= level:
            self.levels.append([])
        run = self.work.put_sorted(rows, name, self.parts, "h1", "h2")
        self.levels[level].append((name, run))
        return run

    def unseen(self, pairs: DataFrame) -> DataFrame:
        """``(h1, h2, first)`` of the hashes that no run has; ``first`` is the least ``doc``."""
        out = pairs.groupBy("h1", "h2").agg(F.min("doc").alias("first"))
        for _, run in (r for level in self.levels for r in level):
            old = run.select(F.col("h1").alias("o1"), F.col("h2").alias("o2")).hint("merge")
            out = out.join(old, (F.col("h1") == F.col("o1")) & (F.col("h2") == F.col("o2")), "left_anti")
        return out

    def add(self, pairs: DataFrame, name: str) -> DataFrame:
        """Takes a batch of ``line_hashes``; returns those of its rows that an earlier document holds."""
        with self.work.sorted_scans():
            fresh = self._write(self.unseen(pairs), 0)
        # a row stays if its document is the first of a new hash; the document in the key parts hot lines
        kept = fresh.select(F.col("h1").alias("o1"), F.col("h2").alias("o2"), "first")
        same = (F.col("h1") == F.col("o1")) & (F.col("h2") == F.col("o2")) & (F.col("doc") == F.col("first"))
        lost = self.work.put(pairs.join(kept, same, "left_anti").select("doc_id", "dh", "h1", "h2"), f"lost-{name}")
        self.compact()
        return lost

    def compact(self) -> None:
        """Merges a full level's runs into one run of the next level."""
        level = 0
        while level < len(self.levels):
            if len(self.levels[level]) >= self.fanout:
                runs, self.levels[level] = self.levels[level], []
                both = runs[0][1]
                for _, run in runs[1:]:
                    # no hash is in two runs: the full join is the sorted files' merge
                    old = run.select(*[F.col(c).alias(f"o_{c}") for c in ("h1", "h2", "first")]).hint("merge")
                    both = both.join(old, (F.col("h1") == F.col("o_h1")) & (F.col("h2") == F.col("o_h2")), "full")
                    both = both.select(*[F.coalesce(c, f"o_{c}").alias(c) for c in ("h1", "h2", "first")])
                with self.work.sorted_scans():
                    self._write(both, level + 1)
                for name, _ in runs:
                    self.work.drop(name)
            level += 1


def repeated_lines(docs: DataFrame, work: Workspace, batches: int = 4, min_chars: int = 10) -> DataFrame:
    """``(doc_id, dh, drops)``: hashes of the lines that each document loses.

    ``batches`` is the number of ranges of doc_id that are merged one after the other.
    """
    pairs = line_hashes(docs, min_chars)
    cuts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("doc")).agg(F.percentile_approx("doc", [i / batches for i in range(1, batches)] or [0.5], 1000).alias("c")).first()["c"] or []
    cuts = sorted(set(cuts)) if batches > 1 else []
    at = F.size(F.filter(F.array(*[F.lit(int(c)) for c in cuts]), lambda c: c < F.col("doc"))) if cuts else F.lit(0)
    pairs = work.put(pairs.withColumn("batch", at.cast("int")), "pairs", "batch")
    runs, out = LineRuns(work), None
    for i in range(len(cuts) + 1):
        lost = runs.add(pairs.where(F.col("batch") == i), str(i))
        out = lost if out is None else out.unionByName(lost)
    return out.groupBy("doc_id", "dh").agg(F.collect_set(F.struct("h1", "h2")).alias("drops"))


def _kept(text: str, drops, min_chars: int) -> tuple[int, list[str]]:
    lines = text.split("\n")
    if not drops:
        return len(lines), lines
    lost = {(d["h1"], d["h2"]) for d in drops}
    return len(lines), [x for x in lines if len(x.strip(_STRIP)) < min_chars or _hash(line_key(x)) not in lost]


def dedup(docs: DataFrame, batches: int = 4, min_chars: int = 10, work: Workspace | None = None) -> DataFrame:
    """``(doc_id, dh, kept, n_lines, n_dropped)`` of every row, ``kept`` being the text left."""
    work = work or Workspace(docs.sparkSession, "lines")
    drops = repeated_lines(docs, work, batches, min_chars)

    def run(x):
        out = {"kept": [], "n_lines": [], "n_dropped": []}
        for text, lost in zip(x["text"], x["drops"]):
            n, lines = _kept(text, lost, min_chars)
            out["kept"].append("\n".join(lines))
            out["n_lines"].append(n)
            out["n_dropped"].append(n - len(lines))
        return {"doc_id": x["doc_id"], "dh": x["dh"], **out}

    return map_columns(attach(keyed(docs), drops), run, "doc_id long, dh long, kept string, n_lines long, n_dropped long")


def rewrite(docs: DataFrame, batches: int = 4, min_chars: int = 10) -> DataFrame:
    """``docs`` with repeated lines dropped, ``n_chars`` (if there) renewed, other columns as before.

    Rows left with no character that is not white space go, unless they had none before.
    """
    names = [unused(docs, x) for x in ("l_id", "l_dh", "l_own", "l_kept")]
    found, key, own, kept = names
    left = dedup(docs, batches, min_chars).where("n_dropped > 0").select(F.col("doc_id").alias(found), F.col("dh").alias(key), F.col("kept").alias(kept)).dropDuplicates([found, key])
    rows = docs.withColumn(own, F.xxhash64(F.coalesce("text", F.lit(""))))
    rows = rows.join(left, rows["doc_id"].eqNullSafe(F.col(found)) & (F.col(own) == F.col(key)), "left")
    rows = rows.where(F.col(kept).isNull() | F.col(kept).rlike(r"[^\x20\x09-\x0D]"))
    changed = {"text": F.coalesce(kept, "text")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col(kept).isNull(), F.col("n_chars")).otherwise(F.length(kept).cast(docs.schema["n_chars"].dataType))
    return rows.select(*[changed[c].alias(c) if c in changed else F.col(c) for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines dropped from every document, with the digest of what stays."""
    rows = dedup(read_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


#: The same rows in DuckDB SQL.
ORACLE = r"""
WITH lines AS (
  SELECT doc_id, i, line, translate(trim(line, E' \t\n\x0b\x0c\r'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(s) AS line, generate_subscripts(s, 1) AS i
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS s FROM documents))),
firsts AS (
  SELECT k, min(doc_id) AS first FROM lines WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) > 1),
marked AS (
  SELECT l.doc_id, l.i, l.line, f.first IS NOT NULL AND l.doc_id > f.first AS lost FROM lines l LEFT JOIN firsts f ON l.k = f.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE lost) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT lost), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
