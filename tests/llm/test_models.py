"""Operators 9 and 10: recall, held-out accuracy and odd rows."""

import random
import zlib

import numpy as np
import pytest

from muxlake.llm import neighbours, toxicity

SCHEMA = "vec_id long, embedding array<float>, label int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)


def test_recall_and_scores_over_shards(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(30, 24))
    x = (centres[rng.integers(0, 30, 1500)] + 0.6 * rng.normal(size=(1500, 24))).astype(np.float32)
    df = vectors(spark, [(i, v.tolist()) for i, v in enumerate(x)])
    rows = neighbours.search(df, df.where("vec_id % 20 = 0"), shard_rows=400, block_rows=32).collect()
    exact = neighbours.brute_force(x.astype(np.float64), np.arange(1500), np.arange(0, 1500, 20))
    got = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append(r)
        a, b = x[r.query_id].astype(np.float64), x[r.vec_id].astype(np.float64)
        assert r.score == pytest.approx(a @ b / np.linalg.norm(a) / np.linalg.norm(b), abs=1e-12)
    assert all([r.rank for r in g] == [1, 2, 3, 4, 5] and all(a.score >= b.score for a, b in zip(g, g[1:])) for g in got.values())
    assert np.mean([len({r.vec_id for r in got[q]} & set(exact[q])) / 5 for q in exact]) >= 0.95


def test_recall_on_the_given_vectors_over_shards(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select("vec_id", "embedding")
    rows = {r.vec_id: np.array(r.embedding, np.float64) for r in df.collect()}
    ids = np.array(sorted(rows))
    asked = ids[ids % 50 == 0]
    exact = neighbours.brute_force(np.stack([rows[i] for i in ids]), ids, asked)
    got = {}
    for r in neighbours.search(df, df.where("vec_id % 50 = 0"), shard_rows=150, block_rows=8).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    assert got.keys() == set(asked.tolist())
    assert np.mean([len(got[q] & set(exact[q])) / 5 for q in exact]) >= 0.95


def test_small_shards_are_searched_whole(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(180, 6)).astype(np.float32)
    df = vectors(spark, [(i, v.tolist()) for i, v in enumerate(x)])
    exact = neighbours.brute_force(x.astype(np.float64), np.arange(180), np.arange(180))
    got = {}
    for r in neighbours.search(df, df, shard_rows=45).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got == exact


def test_every_node_can_be_reached():
    graph = np.array([[1, -1], [0, -1], [3, -1], [-1, -1], [2, 3]])
    starts = neighbours.entries(graph, 0)
    assert starts.tolist() == [0, 2, 4]


def test_recall_where_a_third_are_copies(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1500, 24)).astype(np.float32)
    x[rng.permutation(1500)[:500]] = x[7]
    df = vectors(spark, [(i, v.tolist()) for i, v in enumerate(x)])
    rows = neighbours.search(df, df.where("vec_id % 10 = 0"), shard_rows=800, block_rows=64).collect()
    exact = neighbours.brute_force(x.astype(np.float64), np.arange(1500), np.arange(0, 1500, 10))
    same = np.flatnonzero((x == x[7]).all(1))
    got = {}
    for r in rows:
        got.setdefault(r.query_id, set()).add(r.vec_id)
    for q in exact:
        if q in same:
            assert got[q] == set([int(i) for i in same if i != q][:5])
    assert np.mean([len(got[q] & set(exact[q])) / 5 for q in exact if q not in same]) >= 0.9


def test_pruned_edges_are_diverse():
    x = neighbours._unit(np.array([[1, 0.0], [1, 0.1], [1, 0.11], [1, 0.12], [1, -0.2]]))
    out = neighbours.robust_prune(x, np.array([0]), np.array([[1, 2, 3, 4, 0, 1, -1]]), 4, 1.2)
    assert out[0].tolist() == [1, 4, -1, -1]


def test_odd_vectors(spark, folder):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, [0.0, 1.0]), (50, [1.0, 0.0]), (100, None), (None, [1.0, 0.0]), (9, [1.0]), (2, [2.0, 0.0])]
    got = neighbours.query(spark, folder(embeddings=vectors(spark, rows))).collect()
    hits = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        hits.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert hits == {0: [(1, 1.0), (2, 1.0), (50, 1.0), (8, 0.0)], 50: [(0, 1.0), (1, 1.0), (2, 1.0), (8, 0.0)]}


def test_no_vectors(spark, folder):
    assert neighbours.query(spark, folder(embeddings=vectors(spark, []))).collect() == []
    assert neighbours.query(spark, folder(embeddings=vectors(spark, [(0, [1.0, 2.0])]))).collect() == []


def labelled(spark, docs, n=600, seed=1):
    rng = random.Random(seed)
    vocab = {lang: [lang + "".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 8))) for _ in range(300)] for lang in ("en", "de")}
    bad = {"en": ["vilest", "vilen", "vilex"], "de": ["grobig", "grobes"]}
    texts, rows = {}, []
    for i in range(n):
        lang = rng.choice(["en", "de"])
        words, toxic = [rng.choice(vocab[lang]) for _ in range(rng.randint(5, 80))], i % 4 == 0
        for _ in range(rng.randint(1, 4) if toxic else 0):
            words.insert(rng.randrange(len(words) + 1), rng.choice(bad[lang]) + rng.choice(["", "a", "o"]))
        texts[i] = " ".join(words)
        rows.append((i, 1, int(toxic)))
    return docs(texts), spark.createDataFrame(rows, "doc_id long, quality int, toxic int"), {r[0]: r[2] for r in rows}


def test_held_out_accuracy(spark, docs, folder):
    table, labels, truth = labelled(spark, docs)
    rows = toxicity.query(spark, folder(documents=table, labels=labels)).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    held = [r for r in rows if r.held_out]
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) >= 0.95


def test_scores_see_the_text_alone(spark, docs):
    table, labels, _ = labelled(spark, docs, 200)
    model = toxicity.train(table, labels)
    from pyspark.sql import functions as F

    other = table.withColumn("lang", F.lit("zz")).withColumn("source", F.lit("other")).withColumn("doc_id", F.col("doc_id") + 1000)
    a = {r.doc_id: r.score for r in toxicity.score(table, model).collect()}
    b = {r.doc_id - 1000: r.score for r in toxicity.score(other, model).collect()}
    assert a == b


def test_pooling_matches_plain_convolution():
    rng = np.random.default_rng(2)
    texts = ["", "one", "a bb", "the quick, brown fox the end", "x " * 30]
    model = toxicity.Model(rng.normal(size=(toxicity.SLOTS, toxicity.DIM)).astype(np.float32), [rng.normal(size=(w, toxicity.DIM, toxicity.FILTERS)).astype(np.float32) for w in toxicity.WIDTHS], rng.normal(size=48).astype(np.float32), np.zeros(48))
    raw = [t.encode() for t in texts]
    slots, at, first = toxicity.features(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    pooled, best = model.pool(slots, at, first, where=True)
    for i in range(len(texts)):
        v = model.table[slots].mean(1)[at[first[i] : first[i + 1]]]
        for k, width in enumerate(toxicity.WIDTHS):
            if not len(v):
                assert not pooled[i].any()
                continue
            padded = np.concatenate((v, np.zeros((width - 1, toxicity.DIM), np.float32)))
            resp = np.stack([sum(padded[t + j] @ model.filters[k][j] for j in range(width)) for t in range(len(v))])
            part = slice(k * 16, k * 16 + 16)
            assert np.allclose(pooled[i, part], np.maximum(resp.max(0) + model.bias[part], 0), atol=1e-4)


def test_few_and_odd_labels(spark, docs, folder):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = toxicity.query(spark, folder(documents=docs([(1, None), (1, "a"), (None, "b"), (2, "w " * 50000)]), labels=none)).collect()
    assert len(rows) == 4 and {r.score for r in rows} == {0.5}
    few = spark.createDataFrame([(1, 0, 1), (2, 0, 0), (3, None, None), (None, 1, 1), (1, 0, 1)], "doc_id long, quality int, toxic int")
    assert len(toxicity.query(spark, folder(documents=docs({1: "bad", 2: "good", 3: ""}), labels=few)).collect()) == 3
    assert toxicity.query(spark, folder(documents=docs({}), labels=few)).collect() == []


def test_reject_keeps_rows_whole(spark, docs):
    table, labels, truth = labelled(spark, docs)
    kept = toxicity.reject(table, toxicity.train(table, labels))
    assert kept.schema == table.schema
    ids = {r.doc_id for r in kept.collect()}
    clean = {k for k, t in truth.items() if not t}
    assert len(clean - ids) <= 2 and len(ids - clean) <= 0.1 * (len(truth) - len(clean))


def test_rows_of_every_shard_are_learned_from(spark, docs):
    from pyspark.sql import functions as F

    # by the hash of the id the last toxic rows, and half of the held-out ones, have words of their own
    ids = spark.range(13000).select("id", (F.crc32(F.col("id").cast("string").cast("binary")) % 5 == 0).alias("held"), (F.col("id") % 2).alias("toxic")).orderBy(F.xxhash64("id")).collect()
    rng = random.Random(4)
    plain = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(200)]
    late = {r.id for r in [r for r in ids if r.toxic and not r.held][4000:]} | {r.id for r in ids if r.toxic and r.held and r.id % 4 == 1}
    texts = {}
    for r in ids:
        words = rng.choices(plain, k=6)
        if r.toxic:
            words[rng.randrange(6)] = rng.choice(["zorrk", "qivvt"] if r.id in late else ["vilest", "grobig"])
        texts[r.id] = " ".join(words)
    table, labels = docs(texts), spark.createDataFrame([(r.id, 1, r.toxic) for r in ids], "doc_id long, quality int, toxic int")
    held = table.where("crc32(cast(cast(doc_id as string) as binary)) % 5 = 0")
    for size in (1 << 24, 1 << 16):  # one shard, and several
        got = {r.doc_id: r.score >= 0.5 for r in toxicity.score(held, toxicity.train(table, labels, shard_bytes=size)).collect()}
        assert np.mean([got[r.id] for r in ids if r.held and r.id in late]) >= 0.95
        assert np.mean([got[r.id] == r.toxic for r in ids if r.held]) >= 0.95


def test_learning_takes_as_many_jobs_for_any_number_of_partitions(spark, docs):
    texts = {k: f"word{k % 50} " + ("awful " if k % 2 else "lovely ") * 20 for k in range(400)}
    table, labels = docs(texts), spark.createDataFrame([(k, 1, k % 2) for k in texts], "doc_id long, quality int, toxic int")
    own = {"spark.sql.shuffle.partitions": "97", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in own}
    spark.sparkContext.setJobGroup("learning", "jobs of one training")
    try:
        for k, v in own.items():
            spark.conf.set(k, v)
        toxicity.train(table, labels, shard_bytes=1 << 14, epochs=1)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert 0 < len(spark.sparkContext.statusTracker().getJobIdsForGroup("learning")) < 97


def test_shards_merge_by_what_they_met():
    start, sums = toxicity.fit(["bad day", "good day"], np.array([1, 0]), 1), []
    for text in ("worse", "worst"):
        model, seen = toxicity.fit([text, "good"], np.array([1, 0]), 2, start=start)
        sums.append([np.frombuffer(b, np.float32).astype(np.float64) for b in toxicity._blocks(model, seen, start[1])])
    both = toxicity._merged(start, {k: a + b for k, (a, b) in enumerate(zip(*sums))})
    slots = [toxicity.features(np.frombuffer(w.encode(), np.uint8), np.array([0, 5]))[0][0, 0] for w in ("worse", "worst")]
    assert not np.array_equal(both.table[slots], start[0].table[slots])
    same = toxicity._merged(start, {k: 0 * a for k, a in enumerate(sums[0])})
    assert np.array_equal(same.table, start[0].table) and np.array_equal(same.dense, start[0].dense) and same.dense_bias == start[0].dense_bias
