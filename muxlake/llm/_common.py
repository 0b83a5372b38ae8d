"""Helpers shared by the corpus operators: workspace tables, Arrow batch slicing and word spans."""

from __future__ import annotations

import atexit
import contextlib
import gc
import re
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one numpy step works on; a longer single text is worked on alone.
CHUNK_BYTES = 1 << 19


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Bounds the rows of a batch that crosses to Python: texts are long, and the default is 10,000."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(name, "10000")) > rows:
        spark.conf.set(name, rows)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Table ``name`` of a data folder, read by Spark alone (the folder may be in any store)."""
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Workspace:
    """A folder of intermediate Parquet tables in the session's shared checkpoint folder.

    Tables written here cut lineage: a lost executor costs a re-read, not a recomputation. The
    folder named in ``spark.checkpoint.dir`` is used; only where that is unset in a session of one
    machine (tests) a temporary folder stands in. Tables stay while the session may read them and
    are deleted when the driver's Python ends.
    """

    def __init__(self, spark: SparkSession, label: str):
        small_batches(spark)
        base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not base:
            base = spark.conf.get("spark.checkpoint.dir", None)
        if not base and not re.fullmatch(r"local(\[[^,]*(,\d+)?\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if not base:
            base = f"file://{tempfile.mkdtemp(prefix='muxlake-')}"
        self.spark = spark
        self.root = f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"
        self.tables: dict[str, str] = {}
        atexit.register(self._close)

    def _close(self) -> None:
        if self.spark.sparkContext._jsc is not None:
            self.drop("")

    def put(self, df: DataFrame, name: str, *partition_by: str, row_group: int | None = None) -> DataFrame:
        """Writes ``df`` as table ``name`` and returns the stored rows.

        Readers take up to 4096 rows of a row group at once: ``row_group`` bounds its bytes where rows
        are large.
        """
        writer = df.write.mode("overwrite").option("compression", "zstd")
        if row_group:
            writer = writer.option("parquet.block.size", row_group)
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(f"{self.root}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    @property
    def buckets(self) -> int:
        """Buckets of a sorted table: as many as shuffle partitions, within Spark's limit."""
        return min(int(self.spark.conf.get("spark.sql.shuffle.partitions")), int(self.spark.conf.get("spark.sql.sources.bucketing.maxBuckets")))

    def put_sorted(self, df: DataFrame, name: str, parts: int, *keys: str) -> DataFrame:
        """As ``put``, dealt by the hash of ``keys`` to ``parts`` buckets and sorted by them in each.

        A merge join on the keys of two such tables moves and sorts neither (see ``sorted_scans``).
        """
        table = self.tables[name] = f"muxlake_{uuid.uuid4().hex}"
        writer = df.write.format("parquet").option("compression", "zstd").option("path", f"{self.root}/{name}")
        writer.bucketBy(parts, *keys).sortBy(*keys).saveAsTable(table)
        return self.spark.table(table)

    @contextlib.contextmanager
    def sorted_scans(self):
        """Plans made and run within take the order of ``put_sorted`` tables from their files.

        Nor do they move an anti-join below an aggregate, which would shuffle its rows unaggregated.
        """
        conf, rule = self.spark.conf, "org.apache.spark.sql.catalyst.optimizer.PushDownLeftSemiAntiJoin"
        excluded = conf.get("spark.sql.optimizer.excludedRules", "")
        own = {"spark.sql.legacy.bucketedTableScan.outputOrdering": "true", "spark.sql.optimizer.excludedRules": f"{excluded},{rule}".strip(",")}
        before = {k: conf.get(k, None) for k in own}
        try:
            for k, v in own.items():
                conf.set(k, v)
            yield
        finally:
            for k, v in before.items():
                conf.unset(k) if v is None else conf.set(k, v)

    def drop(self, name: str) -> None:
        """Deletes table ``name`` (empty: all of them); nothing may read it afterwards."""
        for own in [name] if name else list(self.tables):
            if own in self.tables:
                self.spark.sql(f"DROP TABLE IF EXISTS {self.tables.pop(own)}")
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}".rstrip("/"))
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def keyed(docs: DataFrame, *extra: str) -> DataFrame:
    """``(doc_id, dh, text, *extra)``: null texts become empty, ``dh`` is a hash of the text.

    Rows are identified by ``(doc_id, dh)``, so rows that repeat an id with another text stay
    apart and exact repetitions of a row share one (identical) decision.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("dh"), text.alias("text"), *extra)


def unused(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it (in any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def attach(left: DataFrame, right: DataFrame, how: str = "left") -> DataFrame:
    """Joins per-document results back by the row key of :func:`keyed` (null ids match)."""
    r = right.select(F.col("doc_id").alias("r_doc_id"), F.col("dh").alias("r_dh"), *[c for c in right.columns if c not in ("doc_id", "dh")])
    return left.join(r, (left["dh"] == r["r_dh"]) & left["doc_id"].eqNullSafe(r["r_doc_id"]), how).drop("r_doc_id", "r_dh")


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cuts a batch into runs of rows of about ``limit`` text bytes: rows, bytes, row offsets."""
    if not batch.num_rows:
        return
    texts = pc.fill_null(batch.column(batch.schema.get_field_index(column)), "")
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    offsets = np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        to = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
        to = min(max(to, at + 1), len(texts))
        yield batch.slice(at, to - at), data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def map_slices(df: DataFrame, fn: Callable[[pa.RecordBatch, np.ndarray, np.ndarray], pa.RecordBatch | None], schema: str, column: str = "text") -> DataFrame:
    """Runs ``fn`` over slices of Arrow batches; it returns a record batch or nothing."""

    def run(batches):
        for batch in batches:
            for part, data, offsets in slices(batch, column):
                out = fn(part, data, offsets)
                if out is not None and out.num_rows:
                    yield out

    return df.mapInArrow(run, schema)


# The bytes that separate words: \x20 and \x09-\x0D.
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True

_BASE = 0x9E3779B97F4A7C15 | 1
_powers: tuple[np.ndarray, np.ndarray] | None = None


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if _powers is None or len(_powers[0]) < n:
        size = max(n, 2 * CHUNK_BYTES)
        both = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            both.append(np.cumprod(x))
        _powers = (both[0], both[1])
    return _powers


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """Words of a run of texts: ``canon`` holds them joined by one space within a text."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False):
        n = len(data)
        solid = ~_SPACE[data]
        first = np.zeros(n + 1, bool)
        first[offsets] = True
        before = np.empty(n, bool)
        before[:1] = False
        before[1:] = solid[:-1]
        starts = np.flatnonzero(solid & (~before | first[:n]))
        after = np.zeros(n, bool)
        after[:-1] = solid[1:]
        ends = np.flatnonzero(solid & (~after | first[1:])) + 1
        self.doc = np.searchsorted(offsets, starts, "right") - 1
        lead = np.ones(len(starts), bool)
        lead[1:] = self.doc[1:] != self.doc[:-1]
        keep = solid
        out = data.copy()
        seps = starts[~lead] - 1
        keep[seps] = True
        out[seps] = 0x20
        if lower:
            big = (out >= 65) & (out <= 90)
            out[big] += 32
        place = np.cumsum(keep)
        self.canon = out[keep]
        self.start = place[starts] - 1 if len(starts) else starts
        self.end = place[ends - 1] if len(ends) else ends
        #: of each text its first word, and after the last text the number of words
        self.first = np.searchsorted(self.doc, np.arange(len(offsets)))
        self._sums: np.ndarray | None = None

    def grams(self, q: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the q words from each word on, and where they stay within one text."""
        n = len(self.start) - q + 1
        if n <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, bool)
        ok = self.doc[:n] == self.doc[q - 1 :]
        return self.span_hash(self.start[:n], self.end[q - 1 :]), ok

    def span_hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A 64-bit hash of each byte span of ``canon``."""
        up, down = _power_tables(len(self.canon) + 1)
        if self._sums is None:
            self._sums = np.zeros(len(self.canon) + 1, np.uint64)
            np.cumsum((self.canon.astype(np.uint64) + np.uint64(1)) * up[: len(self.canon)], out=self._sums[1:])
        return mix64((self._sums[end] - self._sums[start]) * down[start] ^ (end - start).astype(np.uint64))


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each ``w`` consecutive values, by doubling."""
    out, have = x, 1
    while 2 * have <= w:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    return np.minimum(out[: len(x) - w + 1], out[w - have :]) if w > have else out


def anchor_runs(h: np.ndarray, w: int, ok: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one anchor: first window, last window, anchor.

    Window j covers the values h[j : j + w]; its anchor is the leftmost least of them, which
    depends on the window's values alone: equal windows have anchors at equal places. Only
    windows with ``ok`` count.
    """
    none = np.zeros(0, np.int64)
    n = len(h) - w + 1
    if n <= 0:
        return none, none, none
    least = sliding_min(h, w)
    # greatest of the windows' minima around each value; the padding (inverted: the top) never wins
    padded = np.full(n + 2 * (w - 1), 0xFFFFFFFFFFFFFFFF, np.uint64)
    padded[w - 1 : w - 1 + n] = ~least
    chosen = np.flatnonzero(h == ~sliding_min(padded, w))
    cut = np.zeros(n + 1, bool)
    cut[0] = True
    cut[1:n] |= (least[1:] != least[:-1]) | (ok[1:n] != ok[: n - 1])
    # of equal least values the next one takes over once the window has left the first
    left = chosen[chosen < n]
    cut[left[least[left] == h[left]] + 1] = True
    lo = np.flatnonzero(cut[:n])
    hi = np.append(lo[1:], n) - 1
    good = ok[lo]
    lo, hi = lo[good], hi[good]
    if not len(lo):
        return none, none, none
    values, which = np.unique(h[chosen], return_inverse=True)
    size = len(h) + 1
    keys = which.astype(np.int64) * size + chosen
    keys.sort()
    ids = np.searchsorted(values, least[lo])
    at = np.searchsorted(keys, ids.astype(np.int64) * size + lo)
    return lo, hi, keys[at] % size


def i64(x: np.ndarray) -> pa.Array:
    """A long column of any integer array."""
    return pa.array(np.ascontiguousarray(x).astype(np.int64, copy=False) if x.dtype != np.uint64 else np.ascontiguousarray(x).view(np.int64))


def map_columns(df: DataFrame, fn: Callable[[dict[str, list]], dict[str, list]], ddl: str) -> DataFrame:
    """Runs ``fn`` over Arrow batches as plain lists by column; nulls and 64-bit ids stay exact."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(ddl))

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                out = fn(batch.slice(at, 500).to_pydict())
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in schema], schema=schema)

    return df.mapInArrow(run, ddl)


def tidy(spark: SparkSession) -> None:
    """Lets Spark delete shuffle files of jobs that are over, and returns freed memory to the system.

    Spark does so only when the driver's JVM collects the handles, which may otherwise be long after;
    the deletion itself runs in the background, hence the pauses. What the JVM frees outside its heap
    (mostly compilers' work space) malloc keeps for later, some 100 MB after a few hundred jobs.
    """
    jvm = spark.sparkContext._jvm
    for _ in range(2):
        gc.collect()
        jvm.System.gc()
        time.sleep(0.4)
    with contextlib.suppress(Py4JError):  # not every JVM has the command
        _trim(spark)


def _trim(spark: SparkSession) -> None:
    """Has the driver's JVM call malloc_trim; by reflection, since the bean server's class is not exported."""
    jvm, new = spark.sparkContext._jvm, spark.sparkContext._gateway.new_array

    def array(kind, *values):
        out = new(kind, len(values))
        for i, x in enumerate(values):
            out[i] = x
        return out

    named = jvm.java.lang.Class.forName
    types = ("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")
    invoke = named("javax.management.MBeanServer").getMethod("invoke", array(jvm.java.lang.Class, *map(named, types)))
    commands = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
    invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), array(jvm.java.lang.Object, commands, "systemTrimNativeHeap", None, None))
