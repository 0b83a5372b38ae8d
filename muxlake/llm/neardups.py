"""MinHash near-dedup (operator 1): ProbMinHash over weighted word shingles.

A text is the multiset of its five-word shingles (words without ``[\\x20\\x09-\\x0D]``, ASCII
lower-cased; a text of fewer words is one shingle), a shingle's weight being its count. Two texts
are alike by their probability Jaccard index
J_P = sum over common d of 1 / sum over d' of max(v[d'] / v[d], w[d'] / w[d]),
which is the plain Jaccard index where no shingle repeats.

Signature (ProbMinHash): each shingle is a Poisson process of its weight's rate, seeded by the
shingle alone; each arrival falls on one of ``bands * rows`` registers at random, and a register
keeps the shingle that arrives first. A shingle whose last arrival is later than all registers'
first arrivals can change nothing and ends early. Registers of two texts agree with probability
J_P. Bands of ``rows`` registers are bucket keys: at 0.8, 32 bands of 6 meet with probability
0.99994 (0.02 at 0.3).

Verification: equal texts are one node first. A bucket's least node is its centre; the nodes that
share a bucket with one centre form a star, so every bucket lies within a star, and a pair of texts
that many bands bring together is met in few of them. A star is dealt to chunks of about ``CHUNK``
nodes, each with the centre. In a chunk all pairs not yet linked are compared: an upper bound of
J_P, from a product of the chunk's shingle matrix with itself, excludes a pair or its exact value
decides. The links (a spanning forest of each chunk) make components. Stars of several chunks that
hold several components are settled in a second pass: their nodes outside the star's main component
meet all nodes of the star, tile by tile. So every pair in a bucket is linked, excluded exactly, or
within one component, and no task holds more than two chunks. The second pass grows with the square
of a star whose texts are nearly alike but not linked.

Defined cases: null text is empty; texts without words are alike only if equal; a row with a null
``doc_id`` takes the class of an equal text that has an id, else null; rows that repeat an id are
one document, alike to what any of its texts is alike to; an empty table gives an empty result; further columns do not matter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import Words, Workspace, i64, map_slices, mix64, read_table, tidy, unused
from .graph import components

BANDS, ROWS, WORDS, LEAST = 32, 6, 5, 0.8
#: Nodes that a task compares with each other at once, and columns of a slice of their matrix.
CHUNK, _COLUMNS = 256, 4096
_STEP, _PICK = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def shingles(data: np.ndarray, offsets: np.ndarray, size: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, hash and count of each distinct shingle, sorted by text and hash."""
    words = Words(data, offsets, lower=True)
    h, ok = words.grams(size)
    doc, h = words.doc[: len(h)][ok], h[ok]
    first, after = words.first[:-1], words.first[1:]
    short = np.flatnonzero((after > first) & (after - first < size))
    if len(short):
        doc = np.concatenate((doc, short))
        h = np.concatenate((h, words.span_hash(words.start[first[short]], words.end[after[short] - 1])))
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    lead = np.ones(len(h), bool)
    lead[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(lead)
    return doc[at], h[at], np.diff(np.append(at, len(h)))


def signatures(texts: int, doc: np.ndarray, h: np.ndarray, weight: np.ndarray, registers: int) -> np.ndarray:
    """ProbMinHash registers (texts, registers) of weighted elements; zero rows have no elements."""
    soonest = np.full(texts * registers, np.inf)
    winner = np.zeros(texts * registers, np.uint64)
    alive = np.arange(len(h))
    clock = np.zeros(len(h))
    count = np.zeros(len(h), np.int64)
    while len(alive):
        left = np.bincount(doc[alive], minlength=texts)
        times = np.maximum(1, -(-registers // np.maximum(left, 1)))[doc[alive]]
        e = np.repeat(alive, times)
        start = np.cumsum(times) - times
        nth = np.arange(len(e)) - np.repeat(start, times)
        seed = mix64(h[e] + _STEP * (count[e] + nth + 1).astype(np.uint64))
        gap = -np.log(((seed >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / weight[e]
        total = np.cumsum(gap)
        t = clock[e] + total - np.repeat(total[start] - gap[start], times)
        at = doc[e] * registers + (mix64(seed ^ _PICK) % np.uint64(registers)).astype(np.int64)
        clock[alive] = t[start + times - 1]
        count[alive] += times
        better = np.flatnonzero(t < soonest[at])
        better = better[np.argsort(-t[better], kind="stable")]
        soonest[at[better]] = t[better]  # of several arrivals the soonest is written last
        winner[at[better]] = h[e[better]]
        latest = soonest.reshape(texts, registers).max(1)
        alive = alive[clock[alive] < latest[doc[alive]]]
    return winner.reshape(texts, registers)


def likeness(h1: np.ndarray, v: np.ndarray, h2: np.ndarray, w: np.ndarray) -> float:
    """Exact probability Jaccard of two weighted sets with sorted hashes."""
    common, i, j = np.intersect1d(h1, h2, assume_unique=True, return_indices=True)
    if not len(common):
        return 0.0
    if v.sum() == len(v) and w.sum() == len(w):
        return len(common) / (len(v) + len(w) - len(common))
    both_v, both_w = v[i].astype(np.float64), w[j].astype(np.float64)
    only_v, only_w = v.sum() - both_v.sum(), w.sum() - both_w.sum()
    kinds, n = np.unique(np.stack((both_v, both_w), 1), axis=0, return_counts=True)
    out = 0.0
    for (a, b), times in zip(kinds, n):
        out += times / ((np.maximum(kinds[:, 0] / a, kinds[:, 1] / b) * n).sum() + only_v / a + only_w / b)
    return float(out)


def bounds(sets: list[tuple[np.ndarray, np.ndarray]], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """An upper bound of J_P for each pair of a left and a right set; exact where all weights are 1.

    Each of J_P's terms is at most max(v[d], w[d]) / sum over d' of max(v[d'], w[d']). With the sums
    V and W of common shingles' weights, the number C of common shingles and the totals, the sum of
    the terms is at most (V + W - C) / (total_v + total_w - C).
    """
    sizes = np.array([len(h) for h, _ in sets])
    flat, weight = (np.concatenate([x[k] for x in sets]) for k in range(2))
    _, place, count = np.unique(flat, return_inverse=True, return_counts=True)
    column = np.cumsum(count > 1) - 1
    shared = count[place] > 1
    row, at, weight_at = np.repeat(np.arange(len(sets)), sizes)[shared], column[place[shared]], weight[shared]
    order = np.argsort(at, kind="stable")
    row, at, weight_at = row[order], at[order], weight_at[order]
    columns, many = int((count > 1).sum()), bool((weight_at > 1).any())
    common = np.zeros((len(left), len(right)))
    both = np.zeros_like(common)
    for start in range(0, columns, _COLUMNS):
        a, b = np.searchsorted(at, (start, start + _COLUMNS))
        has = np.zeros((len(sets), min(_COLUMNS, columns - start)), np.float32)
        has[row[a:b], at[a:b] - start] = 1
        common += has[left] @ has[right].T
        if many:
            held = np.zeros_like(has)
            held[row[a:b], at[a:b] - start] = weight_at[a:b]
            both += held[left] @ has[right].T + has[left] @ held[right].T
    if not many:
        both = 2 * common
    total = np.array([n.sum() for _, n in sets], np.float64)
    return (both - common) / np.maximum(total[left][:, None] + total[right] - common, 1)


def forest(roots: list[int], sides: list[int], sets: list[tuple[np.ndarray, np.ndarray]], least: float) -> list[tuple[int, int]]:
    """Links between the components ``roots`` of alike sets, as few as join them.

    Where both sides 0 and 1 occur, only pairs across them are compared.
    """
    parent: dict[int, int] = {r: r for r in roots}

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    k, across = len(roots), len(set(sides)) > 1
    left = np.array([i for i in range(k) if not across or sides[i] == 0])
    right = np.array([i for i in range(k) if not across or sides[i] == 1])
    if len(left) * len(right) <= 72:
        pairs = ((i, j) for i in left.tolist() for j in right.tolist() if across or i < j)
    else:
        i, j = np.nonzero(bounds(sets, left, right) >= least - 1e-9)
        i, j = left[i], right[j]
        keep = slice(None) if across else i < j
        pairs = zip(i[keep].tolist(), j[keep].tolist())
    out = []
    for i, j in pairs:
        a, b = find(roots[i]), find(roots[j])
        if a != b and likeness(*sets[i], *sets[j]) >= least:
            parent[max(a, b)] = min(a, b)
            out.append((max(a, b), min(a, b)))
    return out


def _sign(docs: DataFrame) -> DataFrame:
    """``(doc_id, x1, x2, keys)`` of every row: text identity and bucket keys (none: empty)."""
    registers = BANDS * ROWS

    def fn(part, data, offsets):
        doc, h, n = shingles(data, offsets)
        own = signatures(part.num_rows, doc, h, n, registers).reshape(part.num_rows, BANDS, ROWS)
        keys = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), (part.num_rows, BANDS)).copy()
        for r in range(ROWS):
            keys = mix64(keys * _STEP + own[:, :, r])
        some = np.zeros(part.num_rows, bool)
        some[doc] = True
        size = np.where(some, BANDS, 0)
        flat = keys[some].ravel()
        lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)).astype(np.int32)), i64(flat))
        return pa.RecordBatch.from_arrays([*(part.column(k) for k in ("doc_id", "x1", "x2")), lists], ["doc_id", "x1", "x2", "keys"])

    return map_slices(_identified(docs), fn, "doc_id long, x1 long, x2 long, keys array<long>")


def _identified(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("x1"), F.xxhash64(F.lit(1), text).alias("x2"), text.alias("text"))


def _weighted_sets(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(node, h, n)``: shingle hashes and counts (as bytes; none: all are 1) of the nodes' texts."""
    wanted = nodes.select("node", F.col("x1").alias("k1"), F.col("x2").alias("k2"))
    rows = _identified(docs).join(wanted, (F.col("doc_id") == F.col("node")) & (F.col("x1") == F.col("k1")) & (F.col("x2") == F.col("k2")))
    rows = rows.select("node", "x1", "x2", "text").dropDuplicates(["node", "x1", "x2"])

    def fn(part, data, offsets):
        doc, h, n = shingles(data, offsets)
        cut = np.searchsorted(doc, np.arange(part.num_rows + 1))
        hs = [h[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:])]
        ns = [n[a:b].astype(np.int32).tobytes() if (n[a:b] > 1).any() else b"" for a, b in zip(cut[:-1], cut[1:])]
        return pa.RecordBatch.from_arrays([part.column("node"), pa.array(hs, pa.binary()), pa.array(ns, pa.binary())], ["node", "h", "n"])

    return map_slices(rows, fn, "node long, h binary, n binary")


def _compared(dealt: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Links ``(a, b)`` between roots, from ``(centre, tile, side, node, root)`` dealt to tiles."""
    own = sets.select(F.col("node").alias("s_node"), "h", "n")
    rows = dealt.join(own, F.col("node") == F.col("s_node")).select("centre", "tile", "side", "node", "root", "h", "n")

    def run(batches):
        held: list[tuple] = []
        at = None

        def settle():
            pairs = []
            if len(held) > 1:
                hs = [np.frombuffer(h, np.uint64) for _, _, h, _ in held]
                sets = [(h, np.frombuffer(n, np.int32) if n else np.ones(len(h), np.int32)) for h, (_, _, _, n) in zip(hs, held)]
                pairs = forest([x[1] for x in held], [x[0] for x in held], sets, least)
            held.clear()
            return pairs

        for batch in batches:
            links = []
            for centre, tile, *row in zip(*(batch.column(k).to_pylist() for k in ("centre", "tile", "side", "root", "h", "n"))):
                if (centre, tile) != at:
                    links += settle()
                    at = centre, tile
                held.append(tuple(row))
            if links:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*links)], ["a", "b"])
        if links := settle():
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*links)], ["a", "b"])

    return rows.repartition("centre", "tile").sortWithinPartitions("centre", "tile", "node").mapInArrow(run, "a long, b long")


def _second_pass(stars: DataFrame, large: DataFrame, labels: DataFrame, work: Workspace) -> DataFrame | None:
    """Tiles of the stars of several chunks that hold several components; null if there are none."""
    own = stars.join(large, F.col("centre") == F.col("l_centre"), "left_semi").unionByName(large.select(F.col("l_centre").alias("centre"), F.col("l_centre").alias("node")))
    known = labels.select(F.col("node").alias("k_node"), F.col("root").alias("k_root"))
    named = work.put(own.join(known, F.col("node") == F.col("k_node"), "left").select("centre", "node", F.coalesce("k_root", "node").alias("root")), "named")
    counts = named.groupBy("centre", "root").agg(F.count("*").alias("n"))
    main = counts.groupBy("centre").agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.max("n").alias("in"), F.sum("n").alias("all"), F.count("*").alias("roots")).where("roots > 1")
    parts = lambda n: F.ceil(n / CHUNK).cast("int")
    main = work.put(main.select(F.col("centre").alias("m_centre"), "main", parts(F.col("in")).alias("inner"), parts(F.col("all") - F.col("in")).alias("outer")), "main")
    if main.isEmpty():
        return None
    outside = F.col("root") != F.col("main")
    rows = named.join(main, F.col("centre") == F.col("m_centre")).withColumn("c", F.pmod(F.xxhash64("node"), F.when(outside, F.col("outer")).otherwise(F.col("inner"))).cast("int"))

    def tile(kind: int, i, j, side):
        return F.struct((F.lit(kind) * F.lit(1 << 60) + i.cast("long") * F.lit(1 << 30) + j.cast("long")).alias("tile"), side.cast("int").alias("side"))

    count = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    among = F.transform(count("outer"), lambda j: tile(0, F.least("c", j), F.greatest("c", j), F.col("c") > j))
    to_main = F.transform(count("inner"), lambda i: tile(1, i, F.col("c"), F.lit(1)))
    from_main = F.transform(count("outer"), lambda j: tile(1, F.col("c"), j, F.lit(0)))
    rows = rows.withColumn("t", F.explode(F.when(outside, F.concat(among, to_main)).otherwise(from_main)))
    return rows.select("centre", "t.tile", "t.side", "node", "root")


def classes(docs: DataFrame, least: float = LEAST, work: Workspace | None = None) -> DataFrame:
    """``(doc_id, x1, x2, class_id)`` of every row; ``class_id`` is the class's least doc_id."""
    spark = docs.sparkSession
    work = work or Workspace(spark, "neardups")
    signed = work.put(_sign(docs), "signed")
    # equal texts are one node, named by their least id
    equal = work.put(signed.groupBy("x1", "x2").agg(F.min("doc_id").alias("node"), F.max(F.when(F.col("doc_id").isNotNull(), F.col("keys"))).alias("keys")), "equal")
    tidy(spark)
    nodes = equal.where("node is not null and size(keys) > 0")
    members = nodes.select("node", F.explode("keys").alias("key"))
    buckets = work.put(members.groupBy("key").agg(F.min("node").alias("centre"), F.max("node").alias("most")).where("centre < most").select(F.col("key").alias("k"), "centre"), "buckets")
    stars = work.put(members.join(buckets, F.col("key") == F.col("k")).where("node > centre").select("centre", "node").distinct(), "stars")
    tidy(spark)
    involved = stars.select("node").union(stars.select("centre")).distinct().withColumnRenamed("node", "m")
    sets = work.put(_weighted_sets(docs, nodes.join(involved, F.col("node") == F.col("m"), "left_semi")), "sets")
    large = work.put(stars.groupBy("centre").agg(F.count("*").alias("n")).where(F.col("n") > CHUNK).select(F.col("centre").alias("l_centre"), F.ceil(F.col("n") / CHUNK).cast("int").alias("chunks")), "large")
    tidy(spark)
    chunks = F.coalesce("chunks", F.lit(1))
    spread = lambda rows: rows.join(large, F.col("centre") == F.col("l_centre"), "left")
    outer = spread(stars).select("centre", F.pmod(F.xxhash64("node"), chunks).cast("long").alias("tile"), "node")
    inner = spread(stars.select("centre").distinct()).select("centre", F.explode(F.sequence(F.lit(0).cast("long"), chunks.cast("long") - 1)).alias("tile"), F.col("centre").alias("node"))
    dealt = outer.unionByName(inner).select("centre", "tile", F.lit(0).alias("side"), "node", F.col("node").alias("root"))
    labels = components(work.put(_compared(dealt, sets, least), "links"), work, "first")
    if labels is None:
        labels = nodes.where("false").select("node", F.col("node").alias("root"))
    tidy(spark)
    tiles = None if large.isEmpty() else _second_pass(stars, large, labels, work)
    joined = None if tiles is None else components(work.put(_compared(tiles, sets, least), "more-links"), work, "second")
    if joined is not None:
        moved = joined.select(F.col("node").alias("old"), F.col("root").alias("new"))
        # a root of the first pass is a node of its own, perhaps without any link of that pass
        every = labels.unionByName(joined.select("node", F.col("node").alias("root")).join(labels.select(F.col("node").alias("had")), F.col("node") == F.col("had"), "left_anti"))
        labels = work.put(every.join(moved, F.col("root") == F.col("old"), "left").select("node", F.coalesce("new", "root").alias("root")), "labels")
    named = equal.select(F.col("x1").alias("e1"), F.col("x2").alias("e2"), "node")
    named = named.join(labels.select(F.col("node").alias("n"), "root"), F.col("node") == F.col("n"), "left").select("e1", "e2", F.coalesce("root", "node").alias("class_id"))
    rows = signed.select("doc_id", "x1", "x2")
    return rows.join(named, (F.col("x1") == F.col("e1")) & (F.col("x2") == F.col("e2"))).select("doc_id", "x1", "x2", "class_id")


def dedup(docs: DataFrame, least: float = LEAST, work: Workspace | None = None) -> DataFrame:
    """The rows of ``docs`` of which one of each class is kept: the one of least doc_id.

    Rows without a class (null id, text with no equal) stay; of rows that repeat the least id the
    first text by hash stays.
    """
    work = work or Workspace(docs.sparkSession, "neardups")
    named = work.put(classes(docs, least, work), "classes")
    known = named.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("rows"), F.max(F.col("doc_id") != F.col("class_id")).alias("other"), F.min(F.when(F.col("doc_id") == F.col("class_id"), F.struct("x1", "x2"))).alias("lead"))
    known = work.put(known.where("rows > 1 or other"), "known")
    own, first, second = (unused(docs, x) for x in ("own_id", "text_1", "text_2"))
    same = docs["doc_id"] == F.col(own)
    alone = docs.where("doc_id is not null").join(known.select(F.col("doc_id").alias(own)), same, "left_anti")
    leads = known.where("rows > 1 and lead is not null").select(F.col("doc_id").alias(own), F.col("lead.x1").alias(first), F.col("lead.x2").alias(second))
    text = F.coalesce(docs["text"], F.lit(""))
    repeated = docs.join(leads, same & (F.xxhash64(text) == F.col(first)) & (F.xxhash64(F.lit(1), text) == F.col(second)), "left_semi").dropDuplicates(["doc_id"])
    return alone.unionByName(repeated).unionByName(docs.where("doc_id is null"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its class of near duplicates and the class's size."""
    work = Workspace(spark, "neardups")
    rows = work.put(classes(read_table(spark, sf_dir, "documents"), work=work).select("doc_id", "class_id"), "classes")
    sizes = rows.groupBy("class_id").agg(F.count("*").alias("class_rows")).select(F.col("class_id").alias("c"), "class_rows")
    return rows.join(sizes, F.col("class_id").eqNullSafe(F.col("c"))).select("doc_id", "class_id", "class_rows")


def brute_force(texts: dict[int, str | None], least: float = LEAST) -> dict[int, int]:
    """Classes by comparing all pairs; for tests."""
    sets = {}
    for k, t in texts.items():
        raw = (t or "").encode()
        _, h, n = shingles(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        sets[k] = h, n
    root = {k: k for k in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(texts)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if (texts[a] or "") == (texts[b] or "") or likeness(*sets[a], *sets[b]) >= least:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {k: find(k) for k in texts}
