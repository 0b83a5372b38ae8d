"""SentencePiece encoding and decoding (operator 2) on the tokenizers library.

The model file's protobuf is read here by wire format. From it the tokenizer is rebuilt: the
normaliser (compiled character map, white-space folding, dummy prefix, metaspace marker), the
model (unigram scores, or BPE merges in order of the merged piece's score), byte fallback, and the
decoder. Whole texts are normalised and, where the vocabulary proves that no piece crosses it, cut
before each run of marks; the distinct units of a batch are encoded by the library's threads.
Parity: every distinct unit (or else every text) is encoded by the sentencepiece library too, only to
be compared: the ids stored are always the rebuilt tokenizer's, and a text with a unit that differs
has a false ``parity``. The library ranks all merges, while two splits of one BPE piece are equal in
the model; a unit in which that made a difference is merged again here by score and place alone.
Every distinct unit's ids are decoded; a text with a unit that does not decode to itself is decoded
whole. User-defined pieces are cut out first; a model with white space as suffix has its marks last.

Defined cases: a null or empty text has no ids and decodes to ''; texts of any length are encoded
whole; ``round_trip`` is false where the model's normaliser changes a text (as U+2581, which
decodes to a space); repeated rows give repeated results; an empty table gives an empty result;
further columns do not matter.
"""

from __future__ import annotations

import hashlib
import heapq
import os
import re
import struct
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import read_table, small_batches

#: Where the public vocabulary files are installed; a parameter of every entry point.
MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
# fixed values of the model format: piece kinds and model types
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: Distinct units whose ids a worker remembers; beyond them it starts anew.
UNITS_KEPT = 1 << 18
#: New units that are encoded, compared and decoded as one text.
GROUP = 64
_UNIT = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")


def wire(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Fields of a protobuf message: number and value (varint, or bytes of the field)."""

    def varint(at: int) -> tuple[int, int]:
        out = shift = 0
        while True:
            b = data[at]
            out |= (b & 0x7F) << shift
            at, shift = at + 1, shift + 7
            if b < 0x80:
                return out, at

    at = 0
    while at < len(data):
        tag, at = varint(at)
        kind = tag & 7
        if kind == 0:
            value, at = varint(at)
        else:
            if kind == 2:
                size, at = varint(at)
            elif kind in (1, 5):
                size = 8 if kind == 1 else 4
            else:
                raise ValueError(f"wire type {kind}")
            value, at = data[at : at + size], at + size
        yield tag >> 3, value


@dataclass
class Parsed:
    """What the rebuilt tokenizer needs of a model file."""

    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    fold_spaces: bool = True
    escape_spaces: bool = True
    suffix: bool = False


def parse_model(data: bytes) -> Parsed:
    """Pieces, scores and settings of a serialised model."""
    out = Parsed()
    for number, value in wire(data):
        if number == 1:
            piece, score, kind = "", 0.0, NORMAL
            for n, v in wire(value):
                if n == 1:
                    piece = v.decode("utf-8")
                elif n == 2:
                    (score,) = struct.unpack("<f", v)
                elif n == 3:
                    kind = v
            out.pieces.append((piece, score, kind))
        elif number == 2:
            for n, v in wire(value):
                if n == 3:
                    out.kind = v
                elif n == 35:
                    out.byte_fallback = bool(v)
                elif n == 24:
                    out.suffix = bool(v)
        elif number == 3:
            for n, v in wire(value):
                if n == 2:
                    out.charsmap = v
                elif n == 3:
                    out.dummy_prefix = bool(v)
                elif n == 4:
                    out.fold_spaces = bool(v)
                elif n == 5:
                    out.escape_spaces = bool(v)
    if out.kind not in (UNIGRAM, BPE):
        raise ValueError(f"model type {out.kind} is not supported")
    return out


def merges(pieces: list[tuple[str, float, int]]) -> list[tuple[str, str]]:
    """All splits of each piece into two pieces, best merged piece first."""
    known = {p for p, _, k in pieces if k == NORMAL}
    out = []
    for rank, (piece, _, _) in enumerate(sorted((x for x in pieces if x[2] == NORMAL), key=lambda x: -x[1])):
        out += [(rank, i, piece[:i], piece[i:]) for i in range(1, len(piece)) if piece[:i] in known and piece[i:] in known]
    return [(a, b) for _, _, a, b in sorted(out)]


def merged(text: str, scores: dict[str, float]) -> list[str]:
    """Pieces of ``text`` after merging neighbours, the best scored first and of equals the leftmost."""
    piece, after, before = list(text), [*range(1, len(text)), -1], list(range(-1, len(text) - 1))
    agenda: list[tuple[float, int, str]] = []

    def offer(i: int) -> None:
        if i >= 0 and after[i] >= 0 and (both := piece[i] + piece[after[i]]) in scores:
            heapq.heappush(agenda, (-scores[both], i, both))

    for i in range(len(piece)):
        offer(i)
    while agenda:
        _, i, both = heapq.heappop(agenda)
        j = after[i]
        if not piece[i] or j < 0 or piece[i] + piece[j] != both:
            continue  # one of the two has gone into another piece
        piece[i], piece[j] = both, ""
        after[i] = after[j]
        if after[i] >= 0:
            before[after[i]] = i
        offer(before[i])
        offer(i)
    return [p for p in piece if p]


def build(parsed: Parsed):
    """The normaliser (without marks) and the tokenizer (of marked text) of a parsed model."""
    from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers

    vocab = {p: i for i, (p, _, _) in enumerate(parsed.pieces)}
    unknown = next((i for i, (_, _, k) in enumerate(parsed.pieces) if k == UNKNOWN), None)
    if parsed.kind == BPE:
        # the cache slows this model down: distinct units are encoded once anyway
        model = models.BPE(vocab, merges(parsed.pieces), unk_token=None if unknown is None else parsed.pieces[unknown][0], fuse_unk=True, byte_fallback=parsed.byte_fallback, cache_capacity=0)
    else:
        model = models.Unigram([(p, s) for p, s, _ in parsed.pieces], unknown, parsed.byte_fallback)
    out = Tokenizer(model)
    if user := [p for p, _, k in parsed.pieces if k == USER]:
        out.add_tokens([AddedToken(p, normalized=True) for p in user])
    steps = []
    if parsed.charsmap:
        steps.append(normalizers.Precompiled(parsed.charsmap))
    if parsed.fold_spaces:
        steps += [normalizers.Replace(Regex(" +"), " "), normalizers.Replace(Regex("^ +| +$"), "")]
    # a mark at the end is taken off by the codec
    tail = [decoders.Strip(" ", 1, 0)] if parsed.dummy_prefix and not parsed.suffix else []
    out.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *tail])
    return normalizers.Sequence(steps), out


class Codec:
    """Encoder and decoder of one model, with the sentencepiece library for parity."""

    def __init__(self, data: bytes, threads: int = 2):
        # read once, when the library first starts its threads
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "true")
        import sentencepiece

        parsed = parse_model(data)
        self.threads, self.parsed = threads, parsed
        self.simple = not parsed.charsmap and not parsed.fold_spaces
        dummy = MARK if parsed.escape_spaces else " "
        self._before, self._after = (dummy if parsed.dummy_prefix and parsed.suffix == at_end else "" for at_end in (False, True))
        self.normal, self.own = build(parsed)
        self.other = sentencepiece.SentencePieceProcessor(model_proto=data)
        user = any(k == USER for _, _, k in parsed.pieces)
        # if no piece has the mark after another character, none crosses a unit's start; where white
        # space is folded, a mark in the text is not a space, and texts are encoded whole
        self.by_unit = parsed.escape_spaces and not parsed.fold_spaces and not parsed.suffix and not user and not any(MARK in p.lstrip(MARK) for p, _, k in parsed.pieces if k == NORMAL)
        self._ids = {p: i for i, (p, _, k) in enumerate(parsed.pieces)}
        self._scores = {p: s for p, s, k in parsed.pieces if k == NORMAL} if parsed.kind == BPE and not user and parsed.byte_fallback else {}
        self._lead = [self._ids["a"]] if "a" in self._ids else self.own.encode("a", add_special_tokens=False).ids
        #: which ids' pieces begin with a mark
        self._marked = np.array([p.startswith(MARK) for p, _, _ in parsed.pieces])
        #: ids of known units (packed), and the units that differ or do not decode to themselves
        self.units: dict[str, bytes] = {}
        self.differ: set[str] = set()
        self.lossy: set[str] = set()

    def normalise(self, text: str) -> str:
        """The text as the tokenizer takes it, with marks."""
        text = text if self.simple else self.normal.normalize_str(text)
        text = text.replace(" ", MARK) if self.parsed.escape_spaces else text
        return self._before + text + self._after if text else ""

    def _agreed(self, normal: list[str], got: list[list[int]], want: list[list[int]]) -> list[bool]:
        """Whether the libraries agree; ids that differ are worked out again in place."""
        for i, (a, b) in enumerate(zip(got, want)):
            if a != b and self._scores:
                got[i] = []
                for p in merged(normal[i], self._scores):
                    got[i] += [self._ids[p]] if p in self._ids else [self._ids[f"<0x{x:02X}>"] for x in p.encode()]
        return [a == b for a, b in zip(got, want)]

    def _learn(self, units: list[str]) -> None:
        """Encodes new units, compares with the other library, decodes, and notes where either goes wrong.

        Units of one mark and a word are taken ``GROUP`` at a time, as one text: no piece crosses a
        unit's start, so a group's ids fall apart at the pieces that begin with a mark. A group in which
        anything differs is learned unit by unit.
        """
        plain, single = [], []
        for u in units:
            (plain if len(u) > 1 and u[0] == MARK != u[1] else single).append(u)
        groups = [plain[i : i + GROUP] for i in range(0, len(plain), GROUP)]
        texts = ["".join(g) for g in groups]
        spaced = [t.replace(MARK, " ") for t in texts]
        got = [e.ids for e in self.own.encode_batch_fast(texts, add_special_tokens=False)]
        want = self.other.encode([t[len(self._before) :] for t in spaced], num_threads=self.threads)
        # decoded after another unit, since the decoder strips the first space of all
        back = self.own.decode_batch([self._lead + a for a in got], skip_special_tokens=False)
        for group, text, a, b, t in zip(groups, spaced, got, want, back):
            ids = np.array(a, np.int32)
            cuts = np.flatnonzero(self._marked[ids])
            if a != b or t != "a" + text or len(cuts) != len(group) or cuts[0]:
                single += group
                continue
            packed, ends = ids.tobytes(), (4 * cuts).tolist()
            self.units.update(zip(group, [packed[i:j] for i, j in zip(ends, [*ends[1:], len(packed)])]))
        if single:
            self._learn_singly(single)

    def _learn_singly(self, units: list[str]) -> None:
        """As ``_learn``, each unit as a text of its own."""
        got = [e.ids for e in self.own.encode_batch_fast(units, add_special_tokens=False)]
        # the library adds the dummy prefix, which is the unit's first mark, itself
        want = self.other.encode([(u[1:] if self._before else u).replace(MARK, " ") for u in units], num_threads=self.threads)
        if self._before and MARK in units:
            want[units.index(MARK)] = [self.other.piece_to_id(MARK)]  # no text is this unit alone
        self.differ.update(u for u, same in zip(units, self._agreed(units, got, want)) if not same)
        # decoded after another unit, since the decoder strips the first space of all
        back = self.own.decode_batch([self._lead + a for a in got], skip_special_tokens=False)
        self.lossy.update(u for u, t in zip(units, back) if t != "a" + u.replace(MARK, " "))
        self.units.update((u, array("i", a).tobytes()) for u, a in zip(units, got))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[bool], list[str]]:
        """Ids of all texts, their numbers, whether both libraries agree, and the decoded texts."""
        normal = [self.normalise(t) for t in texts]
        if not self.by_unit:
            got = [e.ids for e in self.own.encode_batch_fast(normal, add_special_tokens=False)]
            same = self._agreed(normal, got, self.other.encode(texts, num_threads=self.threads))
            return np.fromiter(chain.from_iterable(got), np.int32), np.array([len(x) for x in got], np.int64), same, self.decode(got)
        units = [_UNIT.findall(t) for t in normal]
        distinct = set().union(*units)
        fresh = distinct - self.units.keys()
        if len(self.units) + len(fresh) > UNITS_KEPT:
            self.forget()
            fresh = distinct
        if fresh:
            self._learn(list(fresh))
        known = self.units.__getitem__
        packed = [b"".join(map(known, u)) for u in units]
        same = [self.differ.isdisjoint(u) for u in units]
        skip = len(self._before)
        # where every unit decodes to itself the text is the units', else it is decoded whole
        back = [t.replace(MARK, " ")[skip:] if self.lossy.isdisjoint(u) else self.decode([np.frombuffer(p, np.int32).tolist()])[0] for t, u, p in zip(normal, units, packed)]
        return np.frombuffer(b"".join(packed), np.int32), np.array([len(p) // 4 for p in packed], np.int64), same, back

    def forget(self) -> None:
        """Drops the units learned so far."""
        for x in (self.units, self.differ, self.lossy):
            x.clear()

    def decode(self, ids: list[list[int]]) -> list[str]:
        """Text of each list of ids."""
        out = self.own.decode_batch(ids, skip_special_tokens=False)
        return [t.removesuffix(" ") for t in out] if self._after else out


_codecs: dict[bytes, Codec] = {}


def codec(data: bytes, threads: int = 2) -> Codec:
    """The codec of a model, built once in a process."""
    key = hashlib.sha256(data).digest()
    if key not in _codecs:
        _codecs[key] = Codec(data, threads)
    return _codecs[key]


def encode(docs: DataFrame, model: bytes | None = None, threads: int = 2, batch_chars: int = 1 << 20) -> DataFrame:
    """``(doc_id, n_tokens, ids, parity, round_trip, decoded_sha256)`` of every row.

    ``batch_chars`` bounds the text that is encoded at once; a longer text is encoded alone.
    """
    if model is None:
        with open(MODEL_PATH, "rb") as f:
            model = f.read()
    # the model file has a fixed size
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = ["doc_id", "n_tokens", "ids", "parity", "round_trip", "decoded_sha256"]

    def run(batches):
        own = codec(shared.value, threads)
        for batch in batches:
            at, ids = 0, batch.column(0)
            sizes = pc.fill_null(pc.utf8_length(batch.column(1)), 0).to_pylist()
            while at < len(sizes):
                to, size = at, 0
                while to < len(sizes) and (to == at or size + sizes[to] <= batch_chars):
                    size += sizes[to]
                    to += 1
                part = [t or "" for t in batch.column(1).slice(at, to - at).to_pylist()]
                got, counts, same, back = own.encode(part)
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)).astype(np.int32)), pa.array(got))
                yield pa.RecordBatch.from_arrays([ids.slice(at, to - at), pa.array(counts), lists, pa.array(same), pa.array([a == b for a, b in zip(part, back)]), pa.array([hashlib.sha256(b.encode("utf-8", "surrogatepass")).hexdigest() for b in back])], names)
                at = to
        own.forget()  # the process may go on to other work

    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids array<int>, parity boolean, round_trip boolean, decoded_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's token ids, verified against the sentencepiece library and by decoding."""
    return encode(read_table(spark, sf_dir, "documents"))
