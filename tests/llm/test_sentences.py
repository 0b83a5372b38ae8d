"""Operator 2: parity with the sentencepiece library and exact round trips."""

import random
import struct

import pytest
import sentencepiece

from muxlake.llm import sentences
from muxlake.llm.sentences import BPE, BYTE, CONTROL, NORMAL, UNIGRAM, UNKNOWN


def field(number, value):
    def varint(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    if isinstance(value, float):
        return varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    return varint(number << 3 | 2) + varint(len(value)) + value


def model(kind, pieces, fold=False, suffix=False):
    """A serialised model of hand-written pieces."""
    out = b"".join(field(1, field(1, p.encode()) + field(2, float(s)) + field(3, k)) for p, s, k in pieces)
    out += field(2, field(3, kind) + field(35, 1) + field(40, 0) + field(24, int(suffix)))
    return out + field(3, field(1, b"identity") + field(3, 1) + field(4, int(fold)) + field(5, 1))


def unigram(fold=False):
    pieces = [("<unk>", 0, UNKNOWN), ("<s>", 0, CONTROL), ("</s>", 0, CONTROL)] + [(f"<0x{i:02X}>", 0, BYTE) for i in range(256)]
    words = ["▁", "a", "b", "c", "▁a", "▁ab", "ab", "abc", "ca", "▁▁", "é"]
    return model(UNIGRAM, pieces + [(w, -1.5 - 0.37 * i, NORMAL) for i, w in enumerate(words)], fold)


TEXTS = ["", " ", "a", "  a  b ", "abc cab\nabca", "é̀ ∑ 😀 漢字 ab", "<s> <0x0A> </s>", "▁x▁ a", "aaaaaaaaaaaaa", "    ", "a\x00b\t\r\n", "abcabcabc " * 500]


@pytest.fixture(scope="module")
def bpe():
    with open(sentences.MODEL_PATH, "rb") as f:
        return f.read()


@pytest.mark.parametrize("fold", [False, True])
def test_unigram_parity(fold):
    data = unigram(fold)
    codec = sentences.Codec(data, 1)
    assert codec.by_unit == (not fold)
    texts = [t for t in TEXTS if "<" not in t]
    want = sentencepiece.SentencePieceProcessor(model_proto=data)
    ids, sizes, same, back = codec.encode(texts)
    assert ids.tolist() == [i for t in texts for i in want.encode(t)]
    assert all(same)
    if not fold:
        assert [a == b for a, b in zip(texts, back)] == ["▁" not in t for t in texts]


def test_bpe_parity(bpe):
    codec, rng = sentences.Codec(bpe, 1), random.Random(1)
    want = sentencepiece.SentencePieceProcessor(model_proto=bpe)
    texts = TEXTS + ["".join(rng.choice("aeinost  ,.\n'éü0123") for _ in range(rng.randint(0, 300))) for _ in range(300)]
    ids, sizes, same, back = codec.encode(texts)
    assert ids.tolist() == [i for t in texts for i in want.encode(t)] and all(same)
    assert [a == b for a, b in zip(texts, back)] == ["▁" not in t for t in texts]
    cuts = [0, *sizes.cumsum()]
    assert codec.decode([ids[a:b].tolist() for a, b in zip(cuts[:-1], cuts[1:])]) == back


def test_ids_are_those_of_the_rebuilt_tokenizer(bpe):
    codec = sentences.Codec(bpe, 1)
    want = codec.encode(["one two three"])[0].tolist()

    class Wrong:
        def encode(self, texts, num_threads=1):
            return [[7] for _ in texts]

        def piece_to_id(self, piece):
            return 7

    other = sentences.Codec(bpe, 1)
    other.other = Wrong()
    ids, _, same, back = other.encode(["one two three"])
    assert ids.tolist() == want and same == [False] and back == ["one two three"]


BYTES = [("<unk>", 0, UNKNOWN), ("<s>", 0, CONTROL), ("</s>", 0, CONTROL)] + [(f"<0x{i:02X}>", 0, BYTE) for i in range(256)]


def test_equal_splits_are_merged_by_place():
    words = ["▁", "a", "b", "aa", "ab", "ba", "aaa", "aba", "bab", "abab", "▁a", "▁ab"]
    data = model(BPE, BYTES + [(w, -1.0 * i, NORMAL) for i, w in enumerate(words)])
    codec, rng = sentences.Codec(data, 1), random.Random(4)
    want = sentencepiece.SentencePieceProcessor(model_proto=data)
    texts = ["".join(rng.choice("aab c") for _ in range(30)) for _ in range(400)]
    ids, sizes, same, _ = codec.encode(texts)
    assert all(same) and ids.tolist() == [i for t in texts for i in want.encode(t)]
    # the mending itself: every text by score and place alone
    known = sentencepiece.SentencePieceProcessor(model_proto=data)
    for t in texts:
        plain = t.replace("c", "")
        assert sentences.merged(codec.normalise(plain), codec._scores) == known.encode(plain, out_type=str)


@pytest.mark.parametrize("kind", [UNIGRAM, BPE])
def test_user_pieces_and_marks_as_suffix(kind):
    words = ["▁", "a", "b", "c", "ab", "a▁", "ab▁", "c▁"]
    normal = [(w, -1.5 - 0.37 * i, NORMAL) for i, w in enumerate(words)]
    texts = ["", "a", "ab c a", "aab  cab", "x é ab"]
    for data in (model(kind, BYTES + normal, suffix=True), model(kind, BYTES + [("[x]", 0, sentences.USER), ("bc", 0, sentences.USER)] + normal)):
        codec, want = sentences.Codec(data, 1), sentencepiece.SentencePieceProcessor(model_proto=data)
        own = [*texts, "ab[x]c a[x]", "abc [x"]
        ids, _, same, back = codec.encode(own)
        assert ids.tolist() == [i for t in own for i in want.encode(t)] and all(same)
        assert back == own


def test_units_are_forgotten_in_time(bpe, monkeypatch):
    monkeypatch.setattr(sentences, "UNITS_KEPT", 5)
    codec = sentences.Codec(bpe, 1)
    for t in ("one two three", "four five six seven", "one two three"):
        assert codec.encode([t])[0].tolist() == codec.other.encode(t)


def test_units_are_learned_in_groups(bpe):
    rng = random.Random(6)
    texts = [" ".join("".join(rng.choice("aeinostéü漢😀\n0") for _ in range(rng.randint(0, 9))) for _ in range(400)) for _ in range(5)]
    codec, single = sentences.Codec(bpe, 1), sentences.Codec(bpe, 1)
    single._learn = single._learn_singly
    sizes = []

    class Counted:
        def encode(self, texts, num_threads=1, known=codec.other):
            sizes.append(len(texts))
            return known.encode(texts, num_threads=num_threads)

        piece_to_id = codec.other.piece_to_id

    codec.other = Counted()
    a, b = codec.encode(texts), single.encode(texts)
    assert a[0].tolist() == b[0].tolist() and a[1].tolist() == b[1].tolist() and a[2:] == b[2:]
    assert codec.units == single.units and len(codec.units) > 1500
    assert sum(sizes) < len(codec.units) / 8


def test_a_group_that_differs_is_learned_singly(bpe):
    codec = sentences.Codec(bpe, 1)

    class Other:
        def encode(self, texts, num_threads=1, known=codec.other):
            return [[7] if "two" in t else known.encode(t) for t in texts]

        piece_to_id = codec.other.piece_to_id

    want = codec.encode(["one two three"])[0].tolist()
    codec.forget()
    codec.other = Other()
    ids, _, same, back = codec.encode(["one two three", "one three"])
    assert ids.tolist()[: len(want)] == want and same == [False, True] and back == ["one two three", "one three"]
    assert codec.differ == {"▁two"}


def test_model_parts(bpe):
    p = sentences.parse_model(bpe)
    assert p.kind == BPE and p.byte_fallback and len(p.pieces) == 32000 and p.dummy_prefix
    with pytest.raises(ValueError):
        sentences.parse_model(model(3, []))


def test_query(spark, docs, folder):
    texts = dict(enumerate([*TEXTS, None])) | {90: "word " * 30000}
    rows = sentences.query(spark, folder(documents=docs([*texts.items(), (None, "x"), (1, " ")]))).collect()
    want = sentencepiece.SentencePieceProcessor(model_file=sentences.MODEL_PATH)
    assert len(rows) == len(texts) + 2
    for r in rows:
        if r.doc_id is not None:
            t = texts[r.doc_id] or ""
            assert r.ids == want.encode(t) and r.n_tokens == len(r.ids) and r.round_trip == ("▁" not in t)


def test_empty_table(spark, docs, folder):
    assert sentences.query(spark, folder(documents=docs({}))).collect() == []
