"""Document fingerprints (operator 4): canonical exact digests.

A text is normalised to Unicode NFKC, case-folded, normalised again, and its white space is
folded to single spaces; the canonical text's 128-bit xxhash is the fingerprint. Documents with
one digest form a bucket, and inside a bucket canonical bytes are compared, so a collision of
digests never joins two different texts.

Defined cases: a null text counts as empty; the empty text has a fingerprint like any other;
texts of any length are processed whole; repeated rows give repeated results; an empty table
gives an empty result; only ``doc_id`` and ``text`` are read, so further columns do not matter.
A null ``doc_id`` sorts before all others where an order is needed.
"""

from __future__ import annotations

import hashlib
import unicodedata

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import Workspace, attach, keyed, map_columns, read_table, tidy


def canonical(text: str) -> bytes:
    """NFKC, case and white-space folding, as UTF-8."""
    if text.isascii():
        text = text.lower()
    else:
        text = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    return " ".join(text.split()).encode("utf-8", "surrogatepass")


def digest(canonical_text: bytes) -> str:
    """Hexadecimal 128-bit digest."""
    return xxhash.xxh3_128_hexdigest(canonical_text)


def fingerprint(docs: DataFrame) -> DataFrame:
    """``(doc_id, dh, fingerprint)`` of every row."""

    def run(x):
        return {"doc_id": x["doc_id"], "dh": x["dh"], "fingerprint": [digest(canonical(t)) for t in x["text"]]}

    return map_columns(keyed(docs), run, "doc_id long, dh long, fingerprint string")


def shared_buckets(prints: DataFrame, work: Workspace | None = None) -> DataFrame:
    """``(doc_id, dh, fingerprint)`` of the rows whose digest another row has too."""
    work = work or Workspace(prints.sparkSession, "shared")
    buckets = prints.groupBy("fingerprint").agg(F.count("*").alias("bucket_rows")).where("bucket_rows > 1").select(F.col("fingerprint").alias("b_fingerprint"))
    # stored, as the leads below: a hot digest's rows can then be split
    buckets = work.put(buckets, "shared")
    return prints.join(buckets, F.col("fingerprint") == F.col("b_fingerprint"), "left_semi").distinct()


def exact_groups(docs: DataFrame) -> DataFrame:
    """``(doc_id, dh, fingerprint, group_id)``: equal canonical texts share a ``group_id``."""
    prints = fingerprint(docs)
    texts = attach(keyed(docs), shared_buckets(prints), "inner")
    out = attach(prints, compare_buckets(texts))
    return out.select("doc_id", "dh", "fingerprint", F.coalesce("group_id", "doc_id").alias("group_id"))


def compare_buckets(texts: DataFrame, work: Workspace | None = None) -> DataFrame:
    """``(doc_id, dh, group_id)`` of ``(doc_id, dh, fingerprint, text)`` rows in shared buckets.

    ``group_id`` is the least doc_id of the group. Each text is compared with its bucket's first
    text; that one travels once for each bucket, and a join that a bucket's size makes uneven is
    split over tasks. Rows that differ from the first text although the digest is equal (a true
    collision) are told apart by a second, independent digest.
    """
    lead = texts.groupBy("fingerprint").agg(F.min(F.struct("doc_id", "dh")).alias("lead")).select(F.col("fingerprint").alias("l_fingerprint"), F.col("lead.doc_id").alias("doc_id"), F.col("lead.dh").alias("dh"))
    # stored, so that the join below has plain shuffles on both sides and a hot bucket can be split
    work = work or Workspace(texts.sparkSession, "buckets")
    leads = attach(texts, lead, "inner").where(F.col("fingerprint") == F.col("l_fingerprint")).select("l_fingerprint", F.col("text").alias("lead_text")).dropDuplicates(["l_fingerprint"])
    leads = work.put(leads, "leads")
    pairs = texts.join(leads, F.col("fingerprint") == F.col("l_fingerprint"))

    def compare(x):
        own, lead = ([canonical(t) for t in x[k]] for k in ("text", "lead_text"))
        apart = ["" if a == b else hashlib.sha256(a).hexdigest() for a, b in zip(own, lead)]
        return {"doc_id": x["doc_id"], "dh": x["dh"], "fingerprint": x["fingerprint"], "apart": apart}

    checked = work.put(map_columns(pairs.select("doc_id", "dh", "fingerprint", "text", "lead_text"), compare, "doc_id long, dh long, fingerprint string, apart string"), "checked")
    ids = work.put(checked.groupBy("fingerprint", "apart").agg(F.min("doc_id").alias("group_id")).select(F.col("fingerprint").alias("g1"), F.col("apart").alias("g2"), "group_id"), "ids")
    return checked.join(ids, (F.col("fingerprint") == F.col("g1")) & (F.col("apart") == F.col("g2"))).select("doc_id", "dh", "group_id").distinct()


def _cuts_below(cuts: list[int], value):
    """How many of the ascending ``cuts`` are less than ``value``, by groups of cuts first."""
    if not cuts:
        return F.lit(0)
    size = max(1, int(len(cuts) ** 0.5))
    groups = [cuts[i : i + size] for i in range(0, len(cuts), size)]
    array = lambda xs: F.array(*[F.lit(int(x)) for x in xs])
    group = F.size(F.filter(array([g[-1] for g in groups]), lambda c: c < value))
    inside = F.element_at(F.array(*[array(g) for g in groups], array([])), group + 1)
    return group * size + F.size(F.filter(inside, lambda c: c < value))


def with_next(docs: DataFrame, then, ddl: str, marks: DataFrame | None = None) -> DataFrame:
    """Applies ``then`` to rows ``(doc_id, dh, text, next_text, marked)``, given as lists by column.

    ``next_text`` is the text of the next row by ascending doc_id.

    The last row is followed by the first. ``marked`` tells the rows that ``marks`` names by
    ``(doc_id, dh)``; its narrow rows take part in the one sort, so no join moves texts again.
    Ranges of ids are sorted each in one task; a range's first row is sent to the range before it
    too, so every text moves once. The driver holds one id for each range.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    spark = docs.sparkSession
    schema = to_arrow_schema(StructType.fromDDL(ddl))
    base = keyed(docs)
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    order = F.struct("doc_id", "dh")
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    cuts = ids.agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)] or [0.5], 10_000).alias("c")).first()["c"] or []
    cuts = sorted(set(cuts))
    part = F.when(F.col("doc_id").isNull(), 0).otherwise(_cuts_below(cuts, F.col("doc_id"))).cast("int")
    base = base.withColumn("part", part)
    firsts = base.groupBy("part").agg(F.min(order).alias("f")).orderBy("part").collect()
    if not firsts:
        return spark.createDataFrame([], ddl)
    before = {}
    for i, row in enumerate(firsts):
        before[i] = (row["f"]["doc_id"], row["f"]["dh"], firsts[i - 1]["part"])
    heads = spark.createDataFrame(list(before.values()), "h_id long, h_dh long, h_part int")
    tails = base.join(F.broadcast(heads), F.col("doc_id").eqNullSafe(F.col("h_id")) & (F.col("dh") == F.col("h_dh"))).select("doc_id", "dh", "text", F.col("h_part").alias("part"), F.lit(2).alias("kind"))
    rows = base.select("doc_id", "dh", "text", "part", F.lit(1).alias("kind")).unionByName(tails)
    if marks is not None:
        rows = rows.unionByName(marks.select("doc_id", "dh", F.lit(None).cast("string").alias("text"), part.alias("part"), F.lit(0).alias("kind")))
    sorted_rows = rows.repartition(parts, "part").sortWithinPartitions("part", F.col("kind") == 2, F.col("doc_id").asc_nulls_first(), "dh", "kind")

    def run(batches):
        held = mark = None  # the row that waits for the next one; the last mark
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                x, out = batch.slice(at, 500).to_pydict(), []
                for doc_id, dh, text, part, kind in zip(x["doc_id"], x["dh"], x["text"], x["part"], x["kind"]):
                    if kind == 0:
                        mark = doc_id, dh
                        continue
                    if held is not None and held[0] == part:
                        out.append((*held[1:4], text, held[4]))
                        held = None
                    if kind == 1:
                        held = (part, doc_id, dh, text, mark == (doc_id, dh))
                names = ("doc_id", "dh", "text", "next_text", "marked")
                made = then(dict(zip(names, map(list, zip(*out)))) if out else {n: [] for n in names})
                yield pa.RecordBatch.from_arrays([pa.array(made[f.name], f.type) for f in schema], schema=schema)

    return sorted_rows.select("doc_id", "dh", "text", "part", "kind").mapInArrow(run, ddl)


def edited(text: str, following: str) -> str:
    """The last floor(n/2) code points replaced by the first as many of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint, its edited text's, and their likeness (1 equal, 0 not).

    An exact digest knows only equal and different, so likeness is 1.0 where canonical bytes
    are equal and 0.0 otherwise.
    """

    def run(x):
        out = {k: [] for k in ("n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")}
        for text, following in zip(x["text"], x["next_text"]):
            new = edited(text, following)
            own, changed, other = canonical(text), canonical(new), canonical(following)
            out["n_chars"].append(len(text))
            out["edited_sha256"].append(hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest())
            out["fingerprint"].append(digest(own))
            out["edited_fingerprint"].append(digest(changed))
            out["near_edited"].append(float(own == changed))
            out["near_next"].append(float(own == other))
        member = [t if m else None for t, m in zip(x["text"], x["marked"])]
        return {"doc_id": x["doc_id"], "dh": x["dh"], **out, "member_text": member}

    docs = read_table(spark, sf_dir, "documents")
    work = Workspace(spark, "fingerprints")
    prints = work.put(fingerprint(docs), "prints")
    tidy(spark)
    shape = "doc_id long, dh long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, member_text string"
    rows = work.put(with_next(docs, run, shape, shared_buckets(prints, work)), "rows")
    tidy(spark)
    members = rows.where("member_text is not null").select("doc_id", "dh", "fingerprint", F.col("member_text").alias("text"))
    out = attach(rows.drop("member_text"), compare_buckets(members, work))
    return out.withColumn("group_id", F.coalesce("group_id", "doc_id")).drop("dh")
