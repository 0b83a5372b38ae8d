"""Operators 3, 4, 5 and 8: oracles, brute force and odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from muxlake.llm import fingerprints, lines, losses, mixing
from muxlake.llm._common import Workspace

ODD = {1: None, 2: "", 3: " \t\n", 4: "a", 5: "Ａ  B c", 6: "a b C", 7: "ﬁne Straße\n", 8: "x " * 40000, 9: "same line here\nshort\n" * 3, 10: " SAME line HERE \t\nother line of text"}


def compare(spark, folder_path, query, oracle):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{folder_path}/documents.parquet/*.parquet')")
    got, want = query(spark, folder_path).toPandas(), con.sql(oracle).df()
    key = lambda df: sorted(map(repr, df[sorted(df.columns)].astype(str).itertuples(index=False, name=None)))
    assert sorted(got.columns) == sorted(want.columns) and key(got) == key(want)
    return got


# --- fingerprints --------------------------------------------------------------------------------


def plain_fingerprints(texts):
    ids = sorted(texts)
    out = {}
    for i, k in enumerate(ids):
        own, following = texts[k] or "", texts[ids[(i + 1) % len(ids)]] or ""
        half = len(own) // 2
        e = own[: len(own) - half] + following[:half]
        a, b, c = (fingerprints.canonical(t) for t in (own, e, following))
        out[k] = (len(own), hashlib.sha256(e.encode()).hexdigest(), fingerprints.digest(a), fingerprints.digest(b), float(a == b), float(a == c))
    return out


def test_fingerprints_against_plain_python(spark, docs, folder):
    rng = random.Random(1)
    texts = ODD | {i: "".join(rng.choice("aB é\n") for _ in range(rng.randint(0, 40))) for i in range(20, 120)} | {-7: "first", 500: "a b c"}
    rows = fingerprints.query(spark, folder(documents=docs(texts).repartition(5))).collect()
    want = plain_fingerprints(texts)
    assert {r.doc_id: tuple(r)[1:7] for r in rows} == want
    groups = {}
    for k in sorted(texts):
        groups.setdefault(fingerprints.canonical(texts[k] or ""), k)
    assert {r.doc_id: r.group_id for r in rows} == {k: groups[fingerprints.canonical(t or "")] for k, t in texts.items()}
    assert want[5][2] == want[6][2] == want[500][2]


def test_collisions_do_not_join_texts(spark, docs, monkeypatch):
    texts = {1: "one", 2: "two", 3: "One ", 4: "three", 5: "two"}
    rows = fingerprints.keyed(docs(texts)).selectExpr("doc_id", "dh", "'bucket' AS fingerprint", "text")
    got = {r.doc_id: r.group_id for r in fingerprints.compare_buckets(rows).collect()}
    assert got == {1: 1, 2: 2, 3: 1, 4: 4, 5: 2}


def test_fingerprints_of_odd_tables(spark, docs, folder):
    assert fingerprints.query(spark, folder(documents=docs({}))).collect() == []
    rows = fingerprints.query(spark, folder(documents=docs([(1, "a"), (1, "a"), (1, "b"), (None, "a"), (None, None)]))).collect()
    assert len(rows) == 5 and len({r.fingerprint for r in rows}) == 3
    one = fingerprints.query(spark, folder(documents=docs({4: "abcd"}))).first()
    assert (one.near_next, one.edited_sha256) == (1.0, hashlib.sha256(b"abab").hexdigest())


# --- lines ---------------------------------------------------------------------------------------


def test_lines_against_sql(spark, docs, folder):
    rng = random.Random(2)
    pool = [" ".join(rng.choice(["ab", "Cd", "é", "10"]) for _ in range(rng.randint(1, 9))) for _ in range(60)]
    texts = ODD | {i: "\n".join(rng.choice(["", " ", "\t"]) + rng.choice(pool) + rng.choice(["", "\r", "\x0b"]) for _ in range(rng.randint(0, 12))) for i in range(20, 150)}
    got = compare(spark, folder(documents=docs(texts)), lines.query, lines.ORACLE)
    assert got.n_dropped.sum() > 50


@pytest.mark.parametrize("batches", [1, 3, 9])
def test_batches_and_levels_do_not_change_lines(spark, docs, batches):
    texts = {i: f"line number {i % 7}\nline common to all\nown line of {i}" for i in range(40)}
    rows = lines.dedup(docs(texts), batches=batches).collect()
    assert {r.doc_id: r.n_dropped for r in rows} == {i: (i > 0) + (i >= 7) for i in range(40)}


def test_runs_are_compacted(spark, docs):
    work = Workspace(spark, "runs")
    runs = lines.LineRuns(work, fanout=2)
    for b in range(5):
        runs.add(lines.line_hashes(docs({b: f"a line of batch {b}\na line of all batches"})), str(b))
    assert [len(x) for x in runs.levels] == [1, 0, 1]
    rows = [tuple(r) for level in runs.levels for _, run in level for r in run.collect()]
    assert sorted(first for _, _, first in rows) == [0, 0, 1, 2, 3, 4] and len(set(rows)) == 6


def test_runs_are_neither_moved_nor_sorted(spark, docs, capsys):
    work = Workspace(spark, "runs")
    runs = lines.LineRuns(work, fanout=3)
    for b in range(2):
        runs.add(lines.line_hashes(docs({b: f"a line of batch {b}\na line of all batches"})), str(b))
    with work.sorted_scans():
        runs.unseen(lines.line_hashes(docs({2: "a line of all batches"}))).explain()
    plan = capsys.readouterr().out
    assert plan.count("LeftAnti") == 2 and plan.count("Exchange") == 1 and plan.count("Sort [") == 1
    assert plan.index("HashAggregate") > plan.index("LeftAnti")


def test_rewrite_keeps_columns(spark, docs):
    table = docs({1: "keep this line\nand this line", 2: "keep this line\nother line here", 3: "keep this line", 4: None})
    got = {r.doc_id: (r.text, r.n_chars, r.dh) for r in lines.rewrite(table).collect()}
    assert got == {1: ("keep this line\nand this line", 28, "x"), 2: ("other line here", 15, "x"), 4: (None, 0, "x")}
    assert lines.rewrite(table).columns == table.columns
    wide = table.selectExpr("*", "'p' AS l_id", "1 AS L_KEPT", "2 AS l_own")
    assert {(r.doc_id, r.text, r.l_id, r.L_KEPT) for r in lines.rewrite(wide).collect()} == {(1, "keep this line\nand this line", "p", 1), (2, "other line here", "p", 1), (4, None, "p", 1)}


def test_lines_of_odd_tables(spark, docs, folder):
    assert lines.query(spark, folder(documents=docs({}))).collect() == []
    rows = lines.query(spark, folder(documents=docs([(1, "a line repeated"), (1, "a line repeated"), (None, "a line repeated"), (None, None)]))).collect()
    assert sorted((r.doc_id or -1, r.n_lines, r.n_dropped) for r in rows) == [(-1, 1, 0), (-1, 1, 0), (1, 1, 1), (1, 1, 1)]


# --- mixing --------------------------------------------------------------------------------------


def mixed(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def test_mixing_against_sql(spark, folder):
    rng = random.Random(3)
    rows = [(i, "w " * rng.randint(0, 60), rng.choice(["en", "de", "fr", None, "xx"]), rng.choice(["src0", "src0", "src0", "src1", "src2", "src7", None, "web"]), 0) for i in range(600)]
    got = compare(spark, folder(documents=mixed(spark, rows)), mixing.query, mixing.ORACLE)
    total = sum(len(r[1].split()) for r in rows)
    assert got.taken_tokens.sum() == total * 4 // 5


def test_shortage_goes_to_siblings_first(spark):
    rows = [(i, "w " * 10, lang, source, 0) for i, (lang, source) in enumerate([("en", "src0")] * 2 + [("en", "src4")] * 18 + [("de", "src0")] * 20 + [("en", "src1")] * 60)]
    got = mixing.mix(mixed(spark, rows), weights={"domain": {"d0": 1, "d1": 1}, "lang": {}, "source": {}}, share=(1, 2), max_epochs=1).toPandas()
    taken = (got.epochs * got.n_tokens + got.prefix_tokens).groupby([got.domain, got.lang, got.source]).sum().to_dict()
    # half of all tokens, split evenly by domain and language; src0 of en is short and src4 makes it good
    assert taken == {("d0", "de", "src0"): 125, ("d0", "en", "src0"): 20, ("d0", "en", "src4"): 105, ("d1", "en", "src1"): 250}


def test_epochs_and_seeds(spark):
    rows = [(i, "w " * (i + 1), "en", "src0", 0) for i in range(10)] + [(100 + i, "w " * 20, "en", "src1", 0) for i in range(20)]
    out = [mixing.mix(mixed(spark, rows), weights={"domain": {}, "lang": {}, "source": {}}, share=(4, 5), max_epochs=4, seed=s).toPandas() for s in (1, 2)]
    own = out[0][out[0].source == "src0"]
    assert set(own.epochs) == {3} and (own.epochs * own.n_tokens + own.prefix_tokens).sum() == (55 + 400) * 4 // 5 // 2
    picks = [tuple(sorted(o[(o.source == "src1") & (o.prefix_tokens > 0)].doc_id)) for o in out]
    assert picks[0] != picks[1]


def test_mixing_of_odd_tables(spark, folder):
    assert mixing.query(spark, folder(documents=mixed(spark, []))).collect() == []
    rows = [(None, "a b", None, None, 0), (1, None, "en", "src0", 0), (2, " ", "en", "src0", 0), (3, "x", "en", "src0", 0), (3, "x", "en", "src0", 0)]
    assert {r.doc_id for r in mixing.query(spark, folder(documents=mixed(spark, rows))).collect()} <= {None, 3}


# --- language-model scoring ----------------------------------------------------------------------


def plain_losses(texts, good, size):
    words = {k: re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower()) for k, t in texts.items()}

    def counts(keys):
        pairs, contexts, single = Counter(), Counter(), Counter()
        for k in keys:
            before = None
            for w in words[k]:
                pairs[before, w] += 1
                contexts[before] += 1
                single[w] += 1
                before = w
        return pairs, contexts, single

    def mean(k, model, without):
        pairs, contexts, single = model
        own = counts([k]) if without else (Counter(),) * 3
        total, out, before = sum(single.values()) - sum(own[2].values()), [], None
        for w in words[k]:
            c = contexts[before] - own[1][before]
            a = c / (c + 5)
            n = pairs[before, w] - own[0][before, w]
            out.append(-math.log(a * n / max(c, 1) + (1 - a) * (single[w] - own[2][w] + 1) / (total + size + 2)))
            before = w
        return sum(out) / len(out)

    target, background = counts(good), counts(texts)
    return {k: (mean(k, target, k in good), mean(k, background, True)) for k in texts if words[k]}


def test_losses_against_plain_python(spark, docs, folder):
    rng = random.Random(4)
    vocab = [f"w{i}" for i in range(40)]
    texts = {i: " ".join(rng.choice(vocab[:20] if i % 2 else vocab) for _ in range(rng.randint(0, 60))) for i in range(80)} | {200: None, 201: "W1 w2"}
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)] + [(None, 1, 0), (5, None, None)], "doc_id long, quality int, toxic int")
    rows = losses.query(spark, folder(documents=docs(texts), labels=labels)).collect()
    want = plain_losses(texts, {i for i in range(60) if i % 2}, len({w for t in texts.values() for w in (t or "").lower().split()}))
    assert len(rows) == len(texts)
    for r in rows:
        if r.doc_id in want:
            assert r.target_loss == pytest.approx(want[r.doc_id][0], rel=1e-9) and r.background_loss == pytest.approx(want[r.doc_id][1], rel=1e-9)
            assert r.score == pytest.approx(r.target_loss - r.background_loss)
        else:
            assert (r.n_tokens, r.score) == (0, None)
    scores = {r.doc_id: r.score for r in rows if r.score is not None}
    assert np.mean([s for k, s in scores.items() if k % 2]) < np.mean([s for k, s in scores.items() if not k % 2])


def test_losses_of_odd_tables(spark, docs, folder):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert losses.query(spark, folder(documents=docs({}), labels=labels)).collect() == []
    rows = losses.query(spark, folder(documents=docs([(1, "a b"), (1, "a b"), (None, "c"), (2, "word " * 30000)]), labels=labels)).collect()
    assert len(rows) == 4 and all(math.isfinite(r.score) for r in rows)


def test_losses_hold_more_words_than_any_fixed_table(spark, docs, folder, monkeypatch):
    monkeypatch.setattr(losses, "BLOCK_BYTES", 1 << 16, raising=False)
    monkeypatch.setattr(losses, "SHARD_BYTES", 1 << 17, raising=False)
    texts = {i: " ".join(f"w{(i // 2) * 1000 + j}" for j in range(1000)) for i in range(80)} | {100: "w1 w2 w1 w2"}
    labels = spark.createDataFrame([(0, 1, 0), (7, 1, 0)], "doc_id long, quality int, toxic int")
    want = plain_losses(texts, {0, 7}, 40000)
    rows = losses.query(spark, folder(documents=docs(texts), labels=labels)).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.target_loss, r.background_loss) == pytest.approx(want[r.doc_id], rel=1e-9)


def test_crc_is_zlibs(spark):
    from pyspark.sql import functions as F

    got = spark.createDataFrame([(12345,)], "i long").select(F.crc32(F.col("i").cast("string").cast("binary")).alias("c")).first().c
    assert got == zlib.crc32(b"12345")
