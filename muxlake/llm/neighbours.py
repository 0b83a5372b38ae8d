"""Approximate nearest neighbours (operator 9): robust-pruned directed graphs, by shard.

Vectors are dealt to shards of about ``shard_rows`` by a hash of the id. Each shard gets a directed
graph: starting from random edges, nodes are inserted in batches; a greedy beam search from the
shard's medoid proposes candidates for a node, and robust pruning keeps the nearest, dropping a
candidate c once a kept p has ``alpha`` * d(p, c) <= d(node, c), so that edges stay diverse;
reverse edges are added and pruned likewise. A second pass uses the relaxed ``alpha``. Queries run
a beam search over each shard in blocks of ``block_rows``, and a query's results are merged over the
shards by partial aggregation. Scores are recomputed from the original vectors in double precision.

Every row is indexed and every shard is searched; recall is measured in the tests. Rows of one
direction are one node of a shard's graph, and a node found stands for the smallest ids of each of
its vectors, so copies take no room in the beam. Searches start at the shard's medoid and at one
node of each part of the graph that it does not reach, so every node can be found, and a shard of no
more nodes than the beam holds is searched exactly. A shard's index stays in one task; the blocks
of queries stream past it.

Defined cases: vectors that are null, zero, of another length than the most common, or hold null or
non-finite components take no part; a null id takes no part; rows that repeat an id are one
candidate with the best score, and no candidate of their own id; ties go to the smaller id;
an empty table gives an empty result; further columns do not matter.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import Workspace, read_table

#: Shards whose results for a query are merged before all are.
SHARDS_MERGED = 256


def usable(column: Column) -> Column:
    """Whether a vector takes part: no null or non-finite component, and not zero."""
    bad = F.exists(column, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return column.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(column, lambda x: x != 0)


def _unit(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(1, keepdims=True)
    return (scaled / np.linalg.norm(scaled, axis=1, keepdims=True)).astype(np.float32)


def _nodes(vectors: np.ndarray, ids: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows by node, of each distinct vector those of the ``keep`` smallest ids, and each node's first place.

    Vectors whose unit vectors are equal are one node; the last place is the number of rows.
    """
    def number(x):
        x = np.ascontiguousarray(x + 0.0)  # -0.0 becomes 0.0
        return np.unique(x.view(np.dtype((np.void, x.dtype.itemsize * x.shape[1]))).ravel(), return_inverse=True)[1].ravel()

    node, vector = number(_unit(vectors)), number(vectors)
    order = np.lexsort((ids, vector, node))
    new = np.ones(len(order), bool)
    new[1:] = vector[order[1:]] != vector[order[:-1]]
    new[1:] |= ids[order[1:]] != ids[order[:-1]]
    order = order[new]  # rows repeated whole are one
    lead = np.ones(len(order), bool)
    lead[1:] = vector[order[1:]] != vector[order[:-1]]
    at = np.flatnonzero(lead)
    nth = np.arange(len(order)) - np.repeat(at, np.diff(np.append(at, len(order))))
    order = order[nth < keep]
    first = np.flatnonzero(np.append(True, node[order[1:]] != node[order[:-1]]))
    return order, np.append(first, len(order))


def beam_search(x: np.ndarray, graph: np.ndarray, starts: np.ndarray, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and squared distances of a beam search for each query, nearest first (-1: none).

    All queries advance together: in each step each expands its nearest node not yet expanded.
    """
    n, rows = len(queries), np.arange(len(queries))
    ids = np.full((n, beam), -1, np.int64)
    dist = np.full((n, beam), np.inf, np.float32)
    done = np.zeros((n, beam), bool)
    d = 2 - 2 * (queries @ x[starts].T)
    nearest = np.argsort(d, 1, kind="stable")[:, :beam]
    ids[:, : nearest.shape[1]] = starts[nearest]
    dist[:, : nearest.shape[1]] = np.take_along_axis(d, nearest, 1)
    seen = np.zeros((n, len(x)), bool)
    seen[:, starts] = True
    active = rows
    while len(active):
        pending = np.where(done[active] | (ids[active] < 0), np.inf, dist[active])
        pick = pending.argmin(1)
        go = np.isfinite(pending[np.arange(len(active)), pick])
        active, pick = active[go], pick[go]
        if not len(active):
            break
        done[active, pick] = True
        near = graph[ids[active, pick]]
        fresh = (near >= 0) & ~seen[active[:, None], near]
        near = np.where(fresh, near, -1)
        r, c = np.nonzero(fresh)
        seen[active[r], near[r, c]] = True
        d = np.full(near.shape, np.inf, np.float32)
        d[r, c] = 2 - 2 * np.einsum("ij,ij->i", queries[active[r]], x[near[r, c]])
        all_ids = np.concatenate((ids[active], near), 1)
        all_dist = np.concatenate((dist[active], d), 1)
        all_done = np.concatenate((done[active], np.zeros(near.shape, bool)), 1)
        order = np.argsort(all_dist, 1, kind="stable")[:, :beam]
        ids[active] = np.take_along_axis(all_ids, order, 1)
        dist[active] = np.take_along_axis(all_dist, order, 1)
        done[active] = np.take_along_axis(all_done, order, 1)
    return np.where(np.isfinite(dist), ids, -1), dist


def robust_prune(x: np.ndarray, node: np.ndarray, candidates: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """``degree`` diverse neighbours of each node out of its candidates (-1: none)."""
    candidates = np.where(candidates == node[:, None], -1, candidates)
    candidates = np.sort(candidates, 1)
    candidates[:, 1:][candidates[:, 1:] == candidates[:, :-1]] = -1
    vectors = x[candidates]
    d = 2 - 2 * np.einsum("ij,ikj->ik", x[node], vectors)
    d[candidates < 0] = np.inf
    out = np.full((len(node), degree), -1, np.int64)
    rows = np.arange(len(node))
    for k in range(degree):
        best = d.argmin(1)
        on = np.isfinite(d[rows, best])
        if not on.any():
            break
        out[on, k] = candidates[rows[on], best[on]]
        chosen = vectors[rows, best]
        between = 2 - 2 * np.einsum("ij,ikj->ik", chosen, vectors)
        d[(alpha * between <= d) & on[:, None]] = np.inf
        d[rows, best] = np.inf
    return out


def entries(graph: np.ndarray, start: int) -> np.ndarray:
    """``start`` and a node of each part of the graph that the nodes before do not reach."""
    seen = np.zeros(len(graph), bool)
    starts, fresh = [], np.array([start])
    while len(fresh):
        starts.append(int(fresh[0]))
        while len(fresh):
            seen[fresh] = True
            near = graph[fresh].ravel()
            near = np.unique(near[near >= 0])
            fresh = near[~seen[near]]
        fresh = np.flatnonzero(~seen)[:1]
    return np.array(starts)


def build_graph(x: np.ndarray, degree: int = 32, beam: int = 48, alpha: float = 1.2, batch: int = 256, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Neighbour lists of unit vectors ``x`` and the nodes where searches start."""
    n = len(x)
    rng = np.random.default_rng(seed)
    start = np.array([int((x @ x.mean(0)).argmax())])
    graph = rng.integers(0, n, (n, min(degree, 8)))
    graph = np.concatenate((graph, np.full((n, degree - graph.shape[1]), -1)), 1)
    graph[graph == np.arange(n)[:, None]] = -1
    for relax in (1.0, alpha):
        order = rng.permutation(n)
        for at in range(0, n, batch):
            node = order[at : at + batch]
            found, _ = beam_search(x, graph, start, x[node], beam)
            graph[node] = robust_prune(x, node, np.concatenate((found, graph[node]), 1), degree, relax)
            # reverse edges, the targets' lists pruned where they run over
            source, target = np.repeat(node, degree), graph[node].ravel()
            source, target = source[target >= 0], target[target >= 0]
            by = np.argsort(target, kind="stable")
            source, target = source[by], target[by]
            into, first, count = np.unique(target, return_index=True, return_counts=True)
            add = np.full((len(into), int(count.max(initial=1))), -1, np.int64)
            add[np.repeat(np.arange(len(into)), count), np.arange(len(target)) - np.repeat(first, count)] = source
            graph[into] = robust_prune(x, into, np.concatenate((graph[into], add), 1), degree, relax)
    return graph, entries(graph, int(start[0]))


def _nearest(vectors: np.ndarray, ids: np.ndarray, first: np.ndarray, graph: np.ndarray, starts: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, k: int, beam: int):
    """Up to k candidates of each query in one shard: query id, candidate id, score."""
    x, q = _unit(vectors[first[:-1]]), _unit(queries)
    found, _ = beam_search(x, graph, starts, q, beam)
    r, c = np.nonzero(found >= 0)
    node = found[r, c]
    size = first[node + 1] - first[node]
    r, at = np.repeat(r, size), np.arange(size.sum()) + np.repeat(first[node] - np.cumsum(size) + size, size)
    keep = ids[at] != query_ids[r]
    r, at = r[keep], at[keep]
    a, b = queries[r], vectors[at]
    score = np.einsum("ij,ij->i", a, b) / (np.sqrt(np.einsum("ij,ij->i", a, a)) * np.sqrt(np.einsum("ij,ij->i", b, b)))
    out = pd.DataFrame({"query_id": query_ids[r], "vec_id": ids[at], "score": score}).drop_duplicates(["query_id", "vec_id"])
    out = out.sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True])
    return out.groupby("query_id").head(k)


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, shard_rows: int = 4096, block_rows: int = 1024, beam: int = 64, degree: int = 32, work: Workspace | None = None) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the k nearest found of each row of ``queries``.

    Both tables have ``(vec_id, embedding)``.
    """
    spark = vectors.sparkSession
    work = work or Workspace(spark, "neighbours")
    pick = lambda df: df.where(F.col("vec_id").isNotNull()).where(usable(F.col("embedding"))).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows, asked = pick(vectors), pick(queries)
    sizes = rows.groupBy(F.size("embedding").alias("size")).count().orderBy(F.desc("count"), "size").limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    size, count = sizes[0]["size"], sizes[0]["count"]
    rows, asked = (df.where(F.size("embedding") == size) for df in (rows, asked))
    shards, blocks = -(-count // shard_rows), max(1, -(-asked.count() // block_rows))

    def index(pdf: pd.DataFrame) -> pd.DataFrame:
        own, ids = np.stack(pdf["embedding"].to_numpy()), pdf["vec_id"].to_numpy()
        order, first = _nodes(own, ids, k + 1)  # one more: a query's own id takes no part
        own, ids = own[order], ids[order]
        graph, starts = build_graph(_unit(own[first[:-1]]), degree)
        parts = [[x.tobytes()] for x in (ids, own, first.astype(np.int64), graph.astype(np.int32), starts.astype(np.int64))]
        return pd.DataFrame({"shard": [pdf["shard"].iloc[0]], **dict(zip(names, parts))})

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"block": [pdf["block"].iloc[0]], "ids": [pdf["vec_id"].to_numpy().tobytes()], "vectors": [np.stack(pdf["embedding"].to_numpy()).tobytes()]})

    names = ["ids", "vectors", "first", "graph", "starts"]
    tasks = min(shards, 8 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    # the row's hash spreads rows that repeat an id, too
    shard = F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(shards)).cast("int")
    built = rows.withColumn("shard", shard).repartition(tasks, "shard").groupBy("shard").applyInPandas(index, "shard int, " + ", ".join(f"{x} binary" for x in names))
    built = work.put(built, "index")
    packed = asked.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")).groupBy("block").applyInPandas(pack, "block int, ids binary, vectors binary")
    packed = work.put(packed, "asked")
    # a stated query set against all rows: every block comes to every shard's index, which comes first
    none = F.lit(None).cast("binary")
    blocks_of = packed.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), "block", "ids", "vectors", *[none.alias(x) for x in names[2:]])
    met = built.select("shard", F.lit(-1).alias("block"), *names).unionByName(blocks_of).repartition(tasks, "shard").sortWithinPartitions("shard", "block")

    def run(batches):
        for pdf in batches:
            for shard, block, ids, vectors, *rest in pdf.itertuples(index=False):
                ids, vectors = np.frombuffer(ids, np.int64), np.frombuffer(vectors, np.float64).reshape(-1, size)
                if block < 0:
                    first, graph, starts = (np.frombuffer(x, t) for x, t in zip(rest, (np.int64, np.int32, np.int64)))
                    own = vectors, ids, first, graph.reshape(len(first) - 1, -1), starts
                    continue
                for at in range(0, len(ids), 128):  # a node may stand for many rows
                    yield _nearest(*own, vectors[at : at + 128], ids[at : at + 128], k, beam).assign(part=shard // SHARDS_MERGED)

    found = met.mapInPandas(run, "query_id long, vec_id long, score double, part int")
    order = F.struct((-F.col("score")).alias("far"), F.col("vec_id"), F.col("score"))

    def nearest(rows: DataFrame, *by: str) -> DataFrame:
        best = rows.groupBy("query_id", *by, "vec_id").agg(F.max("score").alias("score"))
        return best.groupBy("query_id", *by).agg(F.slice(F.sort_array(F.collect_list(order)), 1, k).alias("top"))

    # at most k rows of each shard, so of SHARDS_MERGED shards at first, then of as many groups of shards
    some = nearest(found, "part").select("query_id", F.explode("top").alias("hit")).select("query_id", "hit.vec_id", "hit.score")
    top = nearest(some)
    return top.select("query_id", F.posexplode("top").alias("at", "hit")).select("query_id", (F.col("at") + 1).alias("rank"), F.col("hit.vec_id").alias("vec_id"), F.col("hit.score").alias("score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest of every row whose vec_id is divisible by 50."""
    rows = read_table(spark, sf_dir, "embeddings")
    return search(rows, rows.where(F.col("vec_id") % 50 == 0))


def brute_force(vectors: np.ndarray, ids: np.ndarray, queries: np.ndarray, k: int = 5) -> dict[int, list[int]]:
    """Exact neighbours; for tests."""
    x = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    out = {}
    for q in queries:
        s = x @ x[np.flatnonzero(ids == q)[0]]
        order = np.lexsort((ids, -s))
        out[int(q)] = [int(i) for i in ids[order] if i != q][:k]
    return out
