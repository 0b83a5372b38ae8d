"""Toxicity (operator 10): a convolutional text classifier in numpy.

Words (letters and digits, ASCII lower-cased) are embedded by hashing: a word's vector is the mean
of the vectors of its whole form and of its first 3, 4, 5 and 6 bytes, each in one of ``SLOTS`` rows.
Filters of widths 1, 2 and 3 slide over the word vectors, each filter's greatest response over
the whole text is kept (max pooling), and a logistic layer gives the score. Training is plain
numpy (Adagrad), over every labelled row outside the held-out fold:

1. the rows are dealt by a hash to shards of about ``SHARD_BYTES`` of text, and one task fits a
   model to the first shard;
2. from that model on, tasks fit the other shards, each row in one of them; every parameter becomes
   the mean of the shards' values, weighted by the squared gradients that it met in each;
3. every row gets a logit from a model that has not met it (of the first shard and the shards of the
   other half; in the first shard from a fit of its other half). All of them calibrate the score
   (Platt scaling) and then a decision threshold for each language.

Shards depend on the rows alone, and are as many as the rows need. Scoring covers whole texts, in
Arrow batches.

Neither labels, lang, source nor doc_id enter a score; lang chooses the threshold of ``flagged``.

Defined cases: a null text is empty; a text without words is scored by the bias alone; with no
labelled rows, or labels of one kind, the score is the smoothed frequency of label 1; null
labels or ids are not learned from; rows that repeat an id are learned from and scored each by its
own text; an empty table gives an empty result; further columns do not matter.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import CHUNK_BYTES, Words, Workspace, map_slices, read_table, slices, tidy

#: Text bytes of a shard that is fitted at once.
SHARD_BYTES = 1 << 24
SLOTS = 1 << 17
DIM = 16
FILTERS = 16
WIDTHS = (1, 2, 3)
PREFIXES = (3, 4, 5, 6)
#: Rows of the table in a block, when shards are put together.
BLOCK = 1 << 12
_FOLD = np.array([c if c >= 128 or chr(c).isalnum() else 0x20 for c in range(256)], np.uint8)


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slots of the distinct words (n, 5), each position's word, and the texts' first positions."""
    words = Words(_FOLD[data], offsets, lower=True)
    if not len(words.start):
        return np.zeros((0, 1 + len(PREFIXES)), np.int64), np.zeros(0, np.int64), words.first
    whole = words.span_hash(words.start, words.end)
    _, first, inverse = np.unique(whole, return_index=True, return_inverse=True)
    start, end = words.start[first], words.end[first]
    columns = [whole[first]] + [words.span_hash(start, np.minimum(start + k, end)) + np.uint64(k) for k in PREFIXES]
    return (np.stack(columns, 1) % np.uint64(SLOTS)).astype(np.int64), inverse, words.first


@dataclass
class Model:
    """Weights; ``scale`` and ``shift`` calibrate the logit, ``thresholds`` decide by language."""

    table: np.ndarray
    filters: list[np.ndarray]
    bias: np.ndarray
    dense: np.ndarray
    dense_bias: float = 0.0
    scale: float = 1.0
    shift: float = 0.0
    prior: float | None = None
    thresholds: dict[str, float] = field(default_factory=dict)

    def embed(self, slots: np.ndarray) -> np.ndarray:
        """The mean of each word's rows of the table."""
        rows = np.take(self.table, slots.ravel(), 0).reshape(len(slots), -1)
        out = rows[:, :DIM].copy()
        for k in range(1, slots.shape[1]):
            out += rows[:, k * DIM : (k + 1) * DIM]
        out /= slots.shape[1]
        return out

    def pool(self, slots: np.ndarray, at: np.ndarray, first: np.ndarray, where: bool = False, vectors: np.ndarray | None = None):
        """Pooled filter responses of each text, with the winning positions if asked for."""
        texts = len(first) - 1
        out = np.zeros((texts, FILTERS * len(WIDTHS)), np.float32)
        best = np.full(out.shape, -1, np.int64)
        full = np.flatnonzero(first[1:] > first[:-1])
        if not len(full):
            return out, best
        vectors = self.embed(slots) if vectors is None else vectors
        begin = first[full]
        n = len(at)
        left = np.repeat(first[1:] - 1, first[1:] - first[:-1]) - np.arange(n)
        lengths = np.diff(np.append(begin, n))
        owner = np.repeat(np.arange(len(full)), lengths) if where else None
        over = {j: np.flatnonzero(left[: n - j] < j) for j in range(1, max(WIDTHS))}
        for k, width in enumerate(WIDTHS):
            part = slice(k * FILTERS, (k + 1) * FILTERS)
            sums = np.take(vectors @ self.filters[k][0], at, 0)
            for j in range(1, width):
                got = np.take(vectors @ self.filters[k][j], at[j:], 0)
                got[over[j]] = 0
                sums[: n - j] += got
            top = np.maximum.reduceat(sums, begin)
            out[full, part] = np.maximum(top + self.bias[part], 0)
            if where:
                # the first of equal places is written last
                places, f = np.divmod(np.flatnonzero(sums == np.repeat(top, lengths, 0))[::-1], FILTERS)
                best[full[owner[places]], k * FILTERS + f] = places
        return out, best

    def logit(self, slots, at, first) -> np.ndarray:
        """Each text's logit before calibration."""
        return self.pool(slots, at, first)[0].astype(np.float64) @ self.dense + self.dense_bias

    def score(self, slots, at, first) -> np.ndarray:
        """Calibrated probability of label 1 for each text."""
        if self.prior is not None:
            return np.full(len(first) - 1, self.prior)
        logit = self.logit(slots, at, first)
        return 1 / (1 + np.exp(-np.clip(self.scale * logit + self.shift, -30, 30)))


def _parts(texts: list[str], limit: int = CHUNK_BYTES):
    """The texts in runs of about ``limit`` bytes: indices, bytes, offsets."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    at = 0
    while at < len(raw):
        to, size = at, 0
        while to < len(raw) and (to == at or size + len(raw[to]) <= limit):
            size += len(raw[to])
            to += 1
        yield np.arange(at, to), np.frombuffer(b"".join(raw[at:to]), np.uint8), np.cumsum([0, *map(len, raw[at:to])])
        at = to


def _blank(rng: np.random.Generator) -> tuple[Model, dict[str, np.ndarray]]:
    """A model of random weights, and the squared gradients that its parameters have met."""
    wide = FILTERS * len(WIDTHS)
    model = Model(rng.normal(0, 0.3, (SLOTS, DIM)).astype(np.float32), [rng.normal(0, 0.3, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS], np.zeros(wide, np.float32), rng.normal(0, 0.2, wide))
    seen = {"table": np.full((SLOTS, 1), 1e-6, np.float32), "bias": np.full(wide, 1e-6), "dense": np.full(wide, 1e-6), "db": np.full(1, 1e-6)}
    return model, seen | {f"f{k}": np.full(f.shape, 1e-6, np.float32) for k, f in enumerate(model.filters)}


def fit(texts: list[str], labels: np.ndarray, epochs: int = 6, seed: int = 5, rate: float = 0.08, start: tuple | None = None, positive: float | None = None) -> tuple[Model, dict[str, np.ndarray]]:
    """Trains on whole texts, from ``start`` on if given, and returns the model with ``_blank``'s sums.

    The two labels count alike; ``positive`` is the share of label 1 (unless given, that of the texts).
    """
    rng = np.random.default_rng(seed)
    model, seen = pickle.loads(pickle.dumps(start)) if start else _blank(rng)
    positive = float(labels.mean()) if positive is None else positive
    weight = np.where(labels == 1, 0.5 / max(positive, 1e-9), 0.5 / max(1 - positive, 1e-9))
    order = rng.permutation(len(texts))
    batches = [(order[i], *features(data, offsets)) for i, data, offsets in _parts([texts[k] for k in order], 1 << 17)]

    def step(name: str, value: np.ndarray, grad: np.ndarray) -> None:
        seen[name] += grad * grad
        value -= (rate * grad / np.sqrt(seen[name])).astype(value.dtype)

    for _ in range(epochs):
        for b in rng.permutation(len(batches)):
            which, slots, at, first = batches[b]
            vectors = model.embed(slots)
            pooled, best = model.pool(slots, at, first, True, vectors)
            logit = pooled.astype(np.float64) @ model.dense + model.dense_bias
            error = weight[which] * (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - labels[which]) / len(which)
            back = np.where(pooled > 0, error[:, None] * model.dense, 0).astype(np.float32)
            # gradients of a filter reach only its winning position
            word_grad = np.zeros_like(vectors)
            for k, width in enumerate(WIDTHS):
                grad = np.zeros_like(model.filters[k])
                block = slice(k * FILTERS, (k + 1) * FILTERS)
                text, f = np.nonzero(back[:, block])
                place, g = best[:, block][text, f], back[:, block][text, f]
                for j in range(width):
                    inside = place + j < first[text + 1]
                    word, own, gj = at[place[inside] + j], f[inside], g[inside]
                    np.add.at(grad[j].T, own, gj[:, None] * vectors[word])
                    np.add.at(word_grad, word, gj[:, None] * model.filters[k][j].T[own])
                step(f"f{k}", model.filters[k], grad)
            step("bias", model.bias, back.sum(0).astype(np.float64))
            step("dense", model.dense, pooled.T.astype(np.float64) @ error)
            seen["db"] += float(error.sum()) ** 2
            model.dense_bias -= rate * float(error.sum()) / float(seen["db"][0]) ** 0.5
            touched = np.flatnonzero(np.abs(word_grad).max(1) > 0)
            if len(touched):
                rows, inverse = np.unique(slots[touched].ravel(), return_inverse=True)
                grad = np.zeros((len(rows), DIM), np.float32)
                np.add.at(grad, inverse, np.repeat(word_grad[touched] / slots.shape[1], slots.shape[1], 0))
                seen["table"][rows] += (grad * grad).mean(1, keepdims=True)
                model.table[rows] -= rate * grad / np.sqrt(seen["table"][rows])
    return model, seen


def _values(model: Model) -> dict[str, np.ndarray]:
    """The parameters by the names of ``_blank``'s sums."""
    return {"table": model.table, "bias": model.bias, "dense": model.dense, "db": np.full(1, model.dense_bias)} | {f"f{k}": f for k, f in enumerate(model.filters)}


def _blocks(model: Model, seen: dict[str, np.ndarray], before: dict[str, np.ndarray] | None = None) -> list[bytes]:
    """Weights, and values times weights, in blocks; the weight is what was met since ``before``."""
    out = []
    gain = {k: (seen[k] - before[k] if before else seen[k]).astype(np.float32) for k in seen}
    values = _values(model)
    for at in range(0, SLOTS, BLOCK):
        g = gain["table"][at : at + BLOCK]
        out.append(np.concatenate((g.ravel(), (g * values["table"][at : at + BLOCK]).ravel())).astype(np.float32).tobytes())
    rest = [k for k in sorted(gain) if k != "table"]
    out.append(np.concatenate([gain[k].ravel() for k in rest] + [(gain[k] * values[k]).ravel() for k in rest]).astype(np.float32).tobytes())
    return out


def _merged(start: tuple[Model, dict[str, np.ndarray]], *halves: dict[int, np.ndarray]) -> Model:
    """The weighted mean of ``start`` and the shards whose blocks are summed up in ``halves``."""
    begun, seen = start
    model = Model(begun.table.copy(), [f.copy() for f in begun.filters], begun.bias.copy(), begun.dense.copy(), begun.dense_bias)
    values = _values(model)

    def mean(value: np.ndarray, met: np.ndarray, weight: np.ndarray, total: np.ndarray) -> np.ndarray:
        # where no shard has met a parameter, it stays as it was to the last bit
        return np.where(weight > 0, (met * value.astype(np.float64) + total) / (met + weight), value).astype(value.dtype)

    rest = [k for k in sorted(seen) if k != "table"]
    for block in sorted(set().union(*halves)):
        x = sum(h[block].astype(np.float64) for h in halves if block in h)
        if block < SLOTS // BLOCK:
            part = slice(block * BLOCK, (block + 1) * BLOCK)
            model.table[part] = mean(model.table[part], seen["table"][part], x[:BLOCK, None], x[BLOCK:].reshape(BLOCK, DIM))
        else:
            at, half = 0, len(x) // 2
            for k in rest:
                size, shape = values[k].size, values[k].shape
                values[k][...] = mean(values[k], seen[k], x[at : at + size].reshape(shape), x[half + at : half + at + size].reshape(shape))
                at += size
            model.dense_bias = float(values["db"][0])
    return model


def _logits(model: Model, texts: list[str]) -> np.ndarray:
    out = np.zeros(len(texts))
    for i, data, offsets in _parts(texts):
        out[i] = model.logit(*features(data, offsets))
    return out


def _first(texts: list[str], labels: np.ndarray, epochs: int, positive: float) -> tuple[tuple, np.ndarray]:
    """The first shard's model, and logits by fits of its two halves, each of the other's rows."""
    made = fit(texts, labels, epochs, positive=positive)
    half = np.zeros(len(texts), np.int64)
    for label in (0, 1):
        own = np.flatnonzero(labels == label)
        half[own] = np.arange(len(own)) % 2
    if any(len(set(labels[half == h].tolist())) < 2 for h in (0, 1)):
        return made, _logits(made[0], texts)  # too few rows to fit halves
    logit = np.zeros(len(texts))
    for h in (0, 1):
        one, two = np.flatnonzero(half == h), np.flatnonzero(half != h)
        logit[two] = _logits(fit([texts[i] for i in one], labels[one], epochs, positive=positive)[0], [texts[i] for i in two])
    return made, logit


def _calibrate(logits: DataFrame, counts: dict[int, int]) -> tuple[float, float, dict[str, float]]:
    """Scale and shift by Newton's method over all rows, then each language's threshold."""
    y = F.when(F.col("toxic") == 1, 1 - 1 / (counts[1] + 2)).otherwise(1 / (counts[0] + 2))  # short of 0 and 1: the scale stays finite
    spread = max(logits.agg(F.avg(F.abs("logit"))).head()[0], 1e-9)

    def clipped(a: float, b: float):
        return F.greatest(F.lit(-30.0), F.least(F.lit(30.0), a * F.col("logit") + b))

    def chance(z):
        return 1 / (1 + F.exp(-z))

    a, b = 1.0, 0.0
    for _ in range(60):
        x, p, q = F.col("logit") / spread, F.col("p"), F.col("p") * (1 - F.col("p"))
        s = logits.withColumn("p", chance(clipped(a / spread, b))).agg(F.sum((p - y) * x), F.sum(p - y), F.sum(q * x * x), F.sum(q * x), F.sum(q)).head()
        d = np.clip(np.linalg.solve([[s[2] + 1e-6, s[3]], [s[3], s[4] + 1e-6]], s[:2]), -2, 2)
        a, b = a - float(d[0]), b - float(d[1])
        if np.abs(d).max() < 1e-6:
            break
    # the order of Spark's sums shows in the last digits only
    scale, shift = max(round(a, 6) / spread, 1e-6), round(b, 6)
    cuts = logits.select("lang", "toxic", clipped(scale, shift).alias("z")).unionByName(logits.select("lang", F.lit(None).cast("int").alias("toxic"), F.lit(0.0).alias("z")).distinct())
    cuts = cuts.groupBy("lang", "z").agg(F.count_if(F.col("toxic") == 1).alias("pos"), F.count_if(F.col("toxic") == 0).alias("neg")).withColumn("bin", F.floor(F.col("z") * 64))
    # counts below a cut: of the bins before, and within its bin
    bins = cuts.groupBy("lang", "bin").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    by_lang, before = Window.partitionBy("lang"), Window.partitionBy("lang").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.select(F.col("lang").alias("b_lang"), F.col("bin").alias("b_bin"), *[F.coalesce(F.sum(k).over(before), F.lit(0)).alias(f"b_{k}") for k in ("pos", "neg")], *[F.sum(k).over(by_lang).alias(f"all_{k}") for k in ("pos", "neg")]).where("all_pos >= 10 and all_neg >= 10")
    within = Window.partitionBy("lang", "bin").orderBy("z").rowsBetween(Window.unboundedPreceding, -1)
    below = cuts.select("lang", "bin", chance(F.col("z")).alias("p"), *[F.coalesce(F.sum(k).over(within), F.lit(0)).alias(k) for k in ("pos", "neg")])
    wrong = F.col("b_pos") + F.col("pos") + F.col("all_neg") - F.col("b_neg") - F.col("neg")
    # a language with fewer rows has too few to say: 0.5 holds
    best = below.join(bins, (F.col("lang") == F.col("b_lang")) & (F.col("bin") == F.col("b_bin"))).groupBy("lang").agg(F.min(F.struct(wrong.alias("wrong"), F.abs(F.col("p") - 0.5).alias("far"), F.col("p").alias("p"))).alias("x"))
    return scale, shift, {r["lang"]: r["x"]["p"] for r in best.collect()}


def train(docs: DataFrame, labels: DataFrame, shard_bytes: int = SHARD_BYTES, epochs: int = 6) -> Model:
    """Fits on all labelled rows outside the held-out fold (crc32 of the id, mod 5, is 0)."""
    spark = docs.sparkSession
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    known = labels.where("doc_id is not null and toxic in (0, 1)").where(fold != 0).groupBy(F.col("doc_id").cast("long").alias("l_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    texts = docs.where("doc_id is not null").where(fold != 0).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("lang", F.lit("")).alias("lang"))
    work = Workspace(spark, "toxicity")
    # the labels grow with the input: merged at every size, not broadcast at a small one
    rows = work.put(texts.join(known.hint("merge"), F.col("doc_id") == F.col("l_id")).select("doc_id", F.xxhash64("doc_id", "text").alias("dh"), "text", "lang", "toxic"), "rows")
    found = {r["toxic"]: r for r in rows.groupBy("toxic").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("size")).collect()}
    tidy(spark)
    counts = {k: r["n"] for k, r in found.items()}
    total = sum(counts.values())
    if len(counts) < 2:
        work.drop("")
        return Model(np.zeros((1, 1)), [], np.zeros(1), np.zeros(1), prior=(counts.get(1, 0) + 1) / (total + 2))
    positive = counts[1] / total
    shards = max(1, -(-sum(r["size"] for r in found.values()) // shard_bytes))
    rows = rows.withColumn("shard", F.pmod("dh", F.lit(shards)).cast("int"))

    def first(batches):
        part = sorted((r for batch in batches for r in batch.to_pylist()), key=lambda r: (r["dh"], r["doc_id"]))
        made, logit = _first([r["text"] for r in part], np.array([r["toxic"] for r in part], np.int64), epochs, positive)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(made)], pa.binary()), *(pa.nulls(1, t) for t in (pa.string(), pa.int32(), pa.float64()))], ["model", "lang", "toxic", "logit"])
        yield pa.RecordBatch.from_arrays([pa.nulls(len(part), pa.binary()), pa.array([r["lang"] for r in part], pa.string()), pa.array([r["toxic"] for r in part], pa.int32()), pa.array(logit)], ["model", "lang", "toxic", "logit"])

    # one shard's rows in one task
    begun = work.put(rows.where("shard = 0").repartition(1).mapInArrow(first, "model binary, lang string, toxic int, logit double"), "first")
    made = begun.where("model is not null").select("model").collect()
    start = pickle.loads(bytes(made.pop()["model"])) if made else _blank(np.random.default_rng(5))
    logits = begun.where("model is null").drop("model")
    model = start[0]
    if shards > 1:
        sums = _others(rows.where("shard > 0"), start, shards, epochs, positive, work)
        tidy(spark)
        # the driver makes and sends one model at a time
        for half in (0, 1):
            shared = spark.sparkContext.broadcast(_merged(start, sums.get(1 - half, {})))
            logits = logits.unionByName(work.put(_scored(rows.where((F.col("shard") > 0) & (F.col("shard") % 2 == half)), shared), f"half{half}"))
            shared.destroy()
        model = _merged(start, *sums.values())
        del sums
    del start
    tidy(spark)
    model.scale, model.shift, model.thresholds = _calibrate(work.put(logits, "logits"), counts)
    work.drop("")
    return model


def _others(rows: DataFrame, start: tuple, shards: int, epochs: int, positive: float, work: Workspace) -> dict[int, dict[int, np.ndarray]]:
    """The sums of the blocks of the further shards, by halves (odd and even shards)."""
    shared = rows.sparkSession.sparkContext.broadcast(start)

    def learn(batches):
        def done():
            model, seen = fit([r["text"] for r in part], np.array([r["toxic"] for r in part]), epochs, 5 + own, start=shared.value, positive=positive)
            blocks = _blocks(model, seen, shared.value[1])
            return pa.RecordBatch.from_arrays([pa.array([own] * len(blocks), pa.int32()), pa.array(range(len(blocks)), pa.int32()), pa.array(blocks, pa.binary())], ["shard", "block", "sums"])

        part, own = [], None
        for batch in batches:
            for r in batch.to_pylist():
                if part and r["shard"] != own:
                    yield done()
                    part = []
                own = r["shard"]
                part.append(r)
        if part:
            yield done()

    def add(batches):
        def done():
            return pa.RecordBatch.from_arrays([pa.array([key[0]]), pa.array([key[1]]), pa.array([total.astype(np.float32).tobytes()], pa.binary())], ["half", "block", "sums"])

        key, total = None, None
        for batch in batches:
            for r in batch.to_pylist():
                x = np.frombuffer(r["sums"], np.float32).astype(np.float64)
                if key == (r["half"], r["block"]):
                    total += x
                    continue
                if key:
                    yield done()
                key, total = (r["half"], r["block"]), x
        if key:
            yield done()

    dealt = rows.select("shard", "dh", "doc_id", "text", "toxic").repartition(max(1, shards - 1), "shard").sortWithinPartitions("shard", "dh", "doc_id")
    blocks = work.put(dealt.mapInArrow(learn, "shard int, block int, sums binary"), "blocks")
    # summed up in the order of the shards, and stored: the driver gets two sums of about the size of a
    # model, a part at a time, in 16 jobs at most, however many partitions the shuffle has
    ordered = blocks.withColumn("half", F.col("shard") % 2).repartition("half", "block").sortWithinPartitions("half", "block", "shard")
    sums = work.put(ordered.mapInArrow(add, "half long, block long, sums binary"), "sums")
    shared.destroy()
    work.drop("blocks")
    out: dict[int, dict[int, np.ndarray]] = {}
    for r in sums.coalesce(16).toLocalIterator():
        out.setdefault(r["half"], {})[r["block"]] = np.frombuffer(r["sums"], np.float32)
    work.drop("sums")
    return out


def _scored(rows: DataFrame, shared: Broadcast) -> DataFrame:
    """``(lang, toxic, logit)`` of each row by the model that is sent."""

    def fn(part, data, offsets):
        return pa.RecordBatch.from_arrays([part.column("lang"), part.column("toxic"), pa.array(shared.value.logit(*features(data, offsets)))], ["lang", "toxic", "logit"])

    return map_slices(rows.select("text", "lang", "toxic"), fn, "lang string, toxic int, logit double")


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, score, flagged)``: flagged by the threshold of the row's language."""
    # of fixed size: SLOTS x DIM numbers and the filters
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("lang", F.lit("")).alias("lang"))

    def fn(part, data, offsets):
        own = shared.value
        p = own.score(*features(data, offsets))
        cut = np.array([own.thresholds.get(x, 0.5) for x in part.column("lang").to_pylist()])
        return pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(p, pa.float64()), pa.array((p >= cut).astype(np.int32))], ["doc_id", "score", "flagged"])

    return map_slices(rows, fn, "doc_id long, score double, flagged int")


def reject(docs: DataFrame, model: Model) -> DataFrame:
    """The rows that are not flagged, unchanged."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text"), docs.columns.index("lang")
    schema = docs.schema

    def run(batches):
        own = shared.value
        for batch in batches:
            batch = pa.RecordBatch.from_arrays(batch.columns, [f"c{i}" for i in range(batch.num_columns)])
            for part, data, offsets in slices(batch, f"c{at[0]}"):
                p = own.score(*features(data, offsets))
                cut = np.array([own.thresholds.get(x or "", 0.5) for x in part.column(at[1]).to_pylist()])
                kept = part.filter(pa.array(p < cut))
                yield pa.RecordBatch.from_arrays(kept.columns, schema.names)

    return docs.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity score; ``held_out`` marks the fold that was not learned from."""
    docs = read_table(spark, sf_dir, "documents")
    rows = score(docs, train(docs, read_table(spark, sf_dir, "labels")))
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return rows.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "flagged")
