"""Operator 1 against brute force, and its estimate against the exact index."""

import random

import numpy as np
import pytest

from pyspark.sql import functions as F

from muxlake.llm import neardups


def corpus(seed=3):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    say = lambda n: [rng.choice(vocab) for _ in range(n)]
    texts, at = {}, 0
    passage = say(40)
    for _ in range(40):
        base = say(rng.randint(60, 300))
        for edits in (0, 0, 1, 2, 4):
            words = list(base)
            for _ in range(edits):
                words[rng.randrange(len(words))] = rng.choice(vocab)
            texts[at] = " ".join(words)
            at += 1
    for _ in range(20):
        texts[at] = " ".join(say(60) + passage)
        at += 1
    chain = say(200)
    for i in range(0, 60, 4):
        texts[at] = " ".join(chain[i : i + 140])
        at += 1
    texts |= {900: None, 901: "", 902: " \n", 903: "one two", 904: "One  two", 905: "one two three", 906: "x " * 300, 907: "x " * 310}
    return texts


def test_classes_against_brute_force(spark, docs, folder):
    texts = corpus()
    rows = neardups.query(spark, folder(documents=docs(texts))).collect()
    assert {r.doc_id: r.class_id for r in rows} == neardups.brute_force(texts)


def test_signature_estimates_probability_jaccard():
    rng = np.random.default_rng(1)
    h = rng.integers(0, 2**63, 130).astype(np.uint64)
    h.sort()
    v, w = rng.integers(1, 5, 130), rng.integers(1, 5, 130)
    v[100:115], w[115:] = 0, 0
    on = v > 0, w > 0
    exact = neardups.likeness(h[on[0]], v[on[0]], h[on[1]], w[on[1]])
    a, b = (neardups.signatures(1, np.zeros(o.sum(), np.int64), h[o], x[o], 8192)[0] for o, x in zip(on, (v, w)))
    assert abs(float((a == b).mean()) - exact) < 0.03
    plain = neardups.likeness(h[:100], np.ones(100), h[20:], np.ones(110))
    assert abs(plain - 80 / 130) < 1e-12


def test_dedup_keeps_one_of_each_class(spark, docs):
    texts = corpus(4)
    kept = neardups.dedup(docs([*texts.items(), (3, texts[3]), (None, "x y"), (None, None)]))
    assert kept.columns == docs({}).columns
    ids = [r.doc_id for r in kept.collect()]
    roots = neardups.brute_force(texts)
    assert sorted(i for i in ids if i is not None) == sorted(set(roots.values()))
    assert ids.count(None) == 2


def test_bounds_are_above_the_likeness():
    rng = np.random.default_rng(2)
    for most in (1, 4):
        sets = []
        for _ in range(30):
            h = np.unique(rng.integers(0, 90, 60).astype(np.uint64))
            sets.append((h, rng.integers(1, most + 1, len(h)).astype(np.int32)))
        sets += [(h, 3 * n) for h, n in sets[:5]]
        every = np.arange(len(sets))
        got = neardups.bounds(sets, every, every)
        exact = np.array([[neardups.likeness(*a, *b) for b in sets] for a in sets])
        assert (got >= exact - 1e-12).all()
        assert most > 1 or np.allclose(got[:30, :30], exact[:30, :30])


def test_stars_of_many_chunks(spark, docs, folder, monkeypatch):
    monkeypatch.setattr(neardups, "CHUNK", 2)
    texts = corpus(6)
    texts |= {1000 + i: texts[0] + f" tail{i}" for i in range(40)}
    rows = neardups.query(spark, folder(documents=docs(texts))).collect()
    assert {r.doc_id: r.class_id for r in rows} == neardups.brute_force(texts)


def test_ids_with_several_texts_and_clashing_names(spark, docs):
    say = lambda tag: " ".join(f"{tag}{i}" for i in range(100))
    rows = [(1, say("a")), (1, say("b")), (2, say("a") + " x"), (3, say("b") + " y"), (4, say("c"))]
    table = docs(rows).withColumn("own_id", F.lit("p")).withColumn("text_1", F.lit(2)).withColumn("class_id", F.lit(3))
    assert {r.doc_id: r.class_id for r in neardups.classes(table).collect()} == {1: 1, 2: 1, 3: 1, 4: 4}
    kept = neardups.dedup(table)
    assert kept.columns == table.columns and sorted(r.doc_id for r in kept.collect()) == [1, 4]


def test_a_very_long_text(spark, docs):
    rng = random.Random(8)
    long = " ".join(f"w{rng.randrange(10**6)}" for _ in range(150_000))
    rows = neardups.classes(docs({1: long, 2: long + " end", 3: long[: len(long) // 2]})).collect()
    assert {r.doc_id: r.class_id for r in rows} == {1: 1, 2: 1, 3: 3}


def test_empty_table(spark, docs, folder):
    assert neardups.query(spark, folder(documents=docs({}))).collect() == []


@pytest.mark.parametrize("chunk", [256, 7])
def test_lone_link_in_a_large_bucket(spark, docs, folder, monkeypatch, chunk):
    monkeypatch.setattr(neardups, "CHUNK", chunk)
    sign = neardups._sign
    monkeypatch.setattr(neardups, "_sign", lambda d: sign(d).withColumn("keys", F.array(F.lit(7).cast("long"))))
    rng = random.Random(5)
    shared = [f"s{i}" for i in range(60)]
    texts = {i: " ".join(shared + [f"u{rng.randrange(10**6)}" for _ in range(30)]) for i in range(60)}
    texts[41] = texts[23] + " end"
    # exactly alike: the bound holds at the threshold itself
    texts[52] = " ".join(f"v{i}" for i in range(84))
    texts[57] = " ".join(f"v{i}" for i in range(104))
    rows = neardups.query(spark, folder(documents=docs(texts))).collect()
    want = neardups.brute_force(texts)
    assert want[41] == 23 and want[57] == 52 and len(set(want.values())) == 58
    assert {r.doc_id: r.class_id for r in rows} == want
