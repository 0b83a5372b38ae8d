"""Operators 6 and 7 against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from muxlake.llm import factors, suffixes
from muxlake.llm._common import anchor_runs, keyed, sliding_min


def corpus(seed=1):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 9))) for _ in range(60)]
    say = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    passage = say(150)
    texts = {i: say(rng.randint(0, 300)) for i in range(30)}
    texts[40] = passage
    texts[41] = say(30) + " " + passage + " " + say(30)
    texts[42] = passage[:500] + "X" + passage[500:]
    texts[43] = texts[3] + " " + texts[3]
    texts[44] = texts[41]
    texts[45] = None
    texts[46] = ""
    texts[47] = "z" * 1500
    texts[48] = "a b " * 400
    texts[49] = " \t\n" + passage[:403].replace(" ", "  ") + "\n"
    texts[50] = "q" + passage[3:410]
    texts[51] = "tail " + passage[200:640] + " end"
    texts[-5] = texts[7]
    return texts


@pytest.mark.parametrize("w", [1, 2, 5, 16, 17])
def test_anchor_runs_match_a_plain_scan(w):
    rng = np.random.default_rng(w)
    for n in (w, w + 3, 200):
        h = rng.integers(0, 6, n).astype(np.uint64)
        ok = rng.random(n - w + 1) < 0.8
        assert sliding_min(h, w).tolist() == [int(h[i : i + w].min()) for i in range(n - w + 1)]
        got = {}
        for lo, hi, at in zip(*anchor_runs(h, w, ok)):
            for j in range(lo, hi + 1):
                got[j] = at
        assert got == {j: j + int(np.argmin(h[j : j + w])) for j in range(n - w + 1) if ok[j]}


def test_bytes_against_brute_force(spark, docs, folder):
    texts = corpus()
    rows = suffixes.query(spark, folder(documents=docs(texts))).collect()
    assert {r.doc_id: tuple(r)[1:] for r in rows} == suffixes.brute_force(texts)


def test_words_against_brute_force(spark, docs, folder):
    texts = corpus(2)
    rows = factors.query(spark, folder(documents=docs(texts))).collect()
    assert {r.doc_id: tuple(r)[1:4] for r in rows} == factors.brute_force(texts)


def test_factors_point_at_equal_words(spark, docs):
    texts = corpus(3)
    for r in factors.dedup(docs(texts)).collect():
        for f in r.factors:
            own, ref = texts[r.doc_id].split(), texts[f["ref_id"]].split()
            assert f["words"] >= 20 and own[f["word"] : f["word"] + f["words"]] == ref[f["ref_word"] : f["ref_word"] + f["words"]]


@pytest.mark.parametrize("module", [suffixes, factors])
def test_empty_table_and_repeated_rows(spark, docs, folder, module):
    assert module.query(spark, folder(documents=docs({}))).collect() == []
    long = " ".join(f"w{i}" for i in range(200))
    rows = module.query(spark, folder(documents=docs([(1, long), (1, long), (None, "x"), (None, None)]))).collect()
    assert len(rows) == 4
    removed = [r.n_removed for r in rows if r.doc_id == 1]
    assert removed == ([len(long)] * 2 if module is suffixes else [0, 0])


def test_neighbouring_runs_on_one_grid(spark, docs):
    """Runs of one text whose anchors are a multiple of 16 apart do not share a piece at their border."""
    rng = random.Random(11)
    table = docs({1: "".join(rng.choice("abcdefghij") for _ in range(1500))})
    runs = keyed(table).select("doc_id", "dh").crossJoin(spark.createDataFrame([(296, 15, 407, True), (311, 1, 583, True)], "lo int, n int, anchor int, need boolean"))
    rows = suffixes._pieces(table, runs, 400, 16).collect()
    assert len(rows) > 1 and len({(r.s1, r.s2) for r in rows}) == len(rows)
    assert sorted(x for r in rows for x in range(r.lo, r.lo + r.n)) == list(range(296, 312))


def test_bytes_of_the_given_documents(spark):
    """Every document of the smallest table against a count of the hashes of all its windows."""
    where = "/root/testdata/sf0.001"
    texts = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{where}/documents.parquet").collect()}
    count = Counter(hash(b[i : i + 400]) for b in texts.values() for i in range(len(b) - 399))
    for r in suffixes.query(spark, where).collect():
        b = texts[r.doc_id]
        keep = np.ones(len(b), bool)
        for i in range(len(b) - 399):
            if count[hash(b[i : i + 400])] > 1:
                keep[i : i + 400] = False
        left = np.frombuffer(b, np.uint8)[keep].tobytes()
        assert (r.n_bytes, r.n_removed, r.kept_sha256) == (len(b), len(b) - len(left), hashlib.sha256(left).hexdigest())
