"""Media readings of the driver's tables: each is a plain projection, and has a SQL twin.

``events`` is a transport stream: an event is a packet, its user a PID, a view carries a PCR, a
click or purchase a PTS, a purchase a DTS too. ``lineitem`` gives frames, ``conversations`` PES islands.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from muxlake.functions.bits import be
from muxlake.functions.clock import PCR_MOD, PTS_MOD
from muxlake.operators import places


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _micros(column: str) -> str:
    return f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast({column} as timestamp_ntz))"


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transport packets of the event stream."""
    rn = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    x = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", F.expr(_micros("ts")).alias("us"))
    x = x.withColumn("cents", F.round(F.col("value") * 100).cast("long")).withColumn("rn", rn)
    kind = F.col("event_type")
    pts = F.when(kind.isin("click", "purchase"), F.pmod(F.expr("us * 9 div 100") + F.col("cents"), F.lit(PTS_MOD)))
    return x.select(
        F.lit("events").alias("source"),
        F.col("event_id").alias("n"),
        (F.col("event_id") * 188).alias("pos"),
        (F.col("user_id") + 256).alias("pid"),
        kind.alias("kind"),
        ((F.when(kind == "error", F.col("rn") + 3).when(kind == "signup", F.col("rn") + 15).otherwise(F.col("rn"))) % 16).cast("long").alias("cc"),
        (kind != "click").alias("has_payload"),
        ((kind == "purchase") & (F.col("cents") > 15000)).alias("disc"),
        F.when(kind == "view", F.pmod(F.col("us") * 27, F.lit(PCR_MOD))).alias("pcr"),
        pts.alias("pts"),
        F.when(kind == "purchase", F.pmod(pts - 3600, F.lit(PTS_MOD))).alias("dts"),
        "us",
        "cents",
        (F.col("cents") % 1500 + 1).alias("size"),
    )


#: PIDs of one stream: 0 to 15 are reserved, and 8191 is that of null packets.
PIDS = 0x1FFF - 16


def in_streams(packets: DataFrame) -> DataFrame:
    """Packets dealt to as many streams as their PIDs need: ``source`` is the stream's number, ``pid`` fits in 13 bits."""
    return packets.withColumns({"source": F.expr(f"cast((pid - 16) div {PIDS} as string)"), "pid": (F.col("pid") - 16) % PIDS + 16})


def pid_of(stream: Column, pid: Column) -> Column:
    """The PID before :func:`in_streams`."""
    return stream.cast("long") * PIDS + pid


PACKETS = f"""
WITH e AS (
  SELECT event_id, user_id, event_type AS kind, epoch_us(ts) AS us, CAST(round(value * 100) AS BIGINT) AS cents,
    row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events),
t AS (
  SELECT *, CASE WHEN kind IN ('click', 'purchase') THEN (us * 9 // 100 + cents) % {PTS_MOD} END AS pts FROM e),
packets AS (
  SELECT event_id AS n, event_id * 188 AS pos, user_id + 256 AS pid, kind,
    CASE kind WHEN 'error' THEN rn + 3 WHEN 'signup' THEN rn + 15 ELSE rn END % 16 AS cc,
    kind <> 'click' AS has_payload, kind = 'purchase' AND cents > 15000 AS disc,
    CASE WHEN kind = 'view' THEN us * 27 % {PCR_MOD} END AS pcr, pts,
    CASE WHEN kind = 'purchase' THEN (pts - 3600 + {PTS_MOD}) % {PTS_MOD} END AS dts, us, cents, cents % 1500 + 1 AS size
  FROM t)
"""


def programs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Program table: a region is a program."""
    r = F.col("r_regionkey").cast("long")
    return table(spark, sf_dir, "region").select(F.lit("events").alias("source"), (r * 188).alias("pos"), r.alias("program_number"), (r + 32).alias("pmt_pid"))


def streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stream tables: a nation is an elementary stream of its region's program."""
    k, r = F.col("n_nationkey").cast("long"), F.col("n_regionkey").cast("long")
    return table(spark, sf_dir, "nation").select(F.lit("events").alias("source"), (k * 188).alias("pos"), (r + 32).alias("pmt_pid"), r.alias("program_number"), (k % 30).alias("stream_type"), (k * 4 + 256).alias("elementary_pid"))


TABLES = """
WITH programs AS (SELECT CAST(r_regionkey AS BIGINT) * 188 AS pos, CAST(r_regionkey AS BIGINT) AS program_number, CAST(r_regionkey AS BIGINT) + 32 AS pmt_pid FROM region),
streams AS (
  SELECT CAST(n_nationkey AS BIGINT) * 188 AS pos, CAST(n_regionkey AS BIGINT) + 32 AS pmt_pid, CAST(n_nationkey AS BIGINT) % 30 AS stream_type, CAST(n_nationkey AS BIGINT) * 4 + 256 AS elementary_pid FROM nation)
"""


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames in order: an order line is a frame, its order the source."""
    q = F.col("l_quantity").cast("long")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("source"),
        (F.col("l_linenumber") * F.lit(10**12).cast("long") + F.col("l_partkey") * 10**5 + F.col("l_suppkey")).alias("idx"),
        F.when(q % 12 == 0, "I").when(q % 3 == 0, "P").otherwise("B").alias("kind"),
        F.when(q % 12 == 0, "I").when(q % 3 == 0, "P").when(q % 7 == 0, "mixed").otherwise("B").alias("slice_class"),
        (q % 2 == 0).alias("ref"),
        (q % 24 == 0).alias("idr"),
        F.when(q % 24 == 0, "idr").when(q % 2 == 0, "reference").otherwise("other").alias("category"),
        F.round(F.col("l_extendedprice") * 100).cast("long").alias("size"),
        (q % 4).alias("ref_idc"),
        (q % 32).alias("unit_type"),
        (q % 5).alias("slice_type"),
        F.when(q % 5 == 0, q % 16).alias("afd"),
    )


FRAMES = """
WITH l AS (SELECT *, CAST(l_quantity AS BIGINT) AS q FROM lineitem),
frames AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS source, l_linenumber * 1000000000000 + l_partkey * 100000 + l_suppkey AS idx,
    CASE WHEN q % 12 = 0 THEN 'I' WHEN q % 3 = 0 THEN 'P' ELSE 'B' END AS kind,
    CASE WHEN q % 12 = 0 THEN 'I' WHEN q % 3 = 0 THEN 'P' WHEN q % 7 = 0 THEN 'mixed' ELSE 'B' END AS slice_class,
    q % 2 = 0 AS ref, q % 24 = 0 AS idr, CASE WHEN q % 24 = 0 THEN 'idr' WHEN q % 2 = 0 THEN 'reference' ELSE 'other' END AS category,
    CAST(round(l_extendedprice * 100) AS BIGINT) AS size, q % 4 AS ref_idc, q % 32 AS unit_type, q % 5 AS slice_type, CASE WHEN q % 5 = 0 THEN q % 16 END AS afd
  FROM l)
"""


def capture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captured packets: an event is a datagram, its user a destination."""
    x = packets(spark, sf_dir)
    u = F.col("pid") - 256
    return x.select(
        "source",
        F.col("n").alias("pkt_no"),
        F.expr("us * 9 div 100").alias("t90"),
        (u % 3).alias("vlan"),
        (u + 167772160).alias("dst_ip"),
        (u % 4 + 5000).alias("dst_port"),
        F.when(F.col("kind") == "view", F.col("size") * 188).otherwise(F.col("size")).alias("size"),
        (u * 10 + (F.col("kind") == "signup").cast("long")).alias("ssrc"),
        F.col("cc").alias("seq"),
        (F.col("cents") % 8).cast("int").alias("pcp"),
        F.pmod(F.expr("us * 9 div 100") + F.col("cents"), F.lit(PTS_MOD)).alias("pcr90"),
    )


CAPTURE = (
    PACKETS
    + f""", capture AS (
  SELECT n AS pkt_no, us * 9 // 100 AS t90, (pid - 256) % 3 AS vlan, pid - 256 + 167772160 AS dst_ip, (pid - 256) % 4 + 5000 AS dst_port,
    CASE WHEN kind = 'view' THEN size * 188 ELSE size END AS size, (pid - 256) * 10 + CASE WHEN kind = 'signup' THEN 1 ELSE 0 END AS ssrc,
    cc AS seq, CAST(cents % 8 AS INTEGER) AS pcp, (us * 9 // 100 + cents) % {PTS_MOD} AS pcr90 FROM packets)
"""
)


def _bytes_of(bit_text):
    """Bytes of a column of bit text, closed by a stop bit and zeros."""
    closed = F.concat(bit_text, F.lit("1"))
    padded = F.rpad(closed, ((F.length(closed) + 7) / 8).cast("int") * 8, F.lit("0"))
    return F.unhex(F.lpad(F.conv(padded, 2, 16), (F.length(padded) / 4).cast("int"), F.lit("0")))


def laid_out(units: DataFrame) -> DataFrame:
    """Units (source, idx, data) as consecutive chunks (source, infile, data)."""
    before = F.sum(F.length("data").cast("long")).over(Window.partitionBy("source").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1))
    return units.select("source", F.coalesce(before, F.lit(0)).cast("long").alias("infile"), "data")


def h264_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An H.264 stream for each user: parameter sets, then a slice for each event (view: I, click: P, else B)."""
    x = packets(spark, sf_dir).select(F.col("pid").cast("string").alias("source"), F.col("n").alias("idx"), "kind", F.row_number().over(Window.partitionBy("pid").orderBy("n")).alias("rn"))
    kind = F.when(F.col("kind") == "view", "0001000").when(F.col("kind") == "click", "00110").otherwise("00111")
    bit_text = F.concat(F.lit("1"), kind, F.lit("1"), F.lpad(F.bin((F.col("rn") % 16).cast("long")), 4, "0"))
    head = F.when(F.col("kind") == "view", "41").when(F.col("kind") == "click", "41").otherwise("01")
    slices = x.select("source", F.col("idx"), F.concat(F.unhex(F.concat(F.lit("000001"), head)), _bytes_of(bit_text)).alias("data"))
    # fixed values: a baseline sequence set (4-bit frame numbers, order type 2) and its picture set
    sets = F.unhex(F.lit("00000167" + SPS_HEX + "00000168" + PPS_HEX))
    first = x.groupBy("source").agg((F.min("idx") - 1).alias("idx")).select("source", "idx", sets.alias("data"))
    return laid_out(first.unionByName(slices))


def _bits(*codes: str) -> str:
    text = "".join(codes) + "1"
    text += "0" * (-len(text) % 8)
    return f"{int(text, 2):0{len(text) // 4}x}"


def _ue(v: int) -> str:
    t = f"{v + 1:b}"
    return "0" * (len(t) - 1) + t


#: Profile 66, level 30, set 0, 4-bit frame numbers, order type 2, frames only.
SPS_HEX = _bits("01000010", "00000000", "00011110", _ue(0), _ue(0), _ue(2), _ue(1), "0", _ue(10), _ue(10), "1")
#: Set 0 of sequence set 0, one slice group, no redundant counts.
PPS_HEX = _bits(_ue(0), _ue(0), "0", "0", _ue(0), _ue(0), _ue(0), "0", "00", _ue(0), _ue(0), _ue(0), "0", "0", "0")


def h262_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An H.262 stream for each user: a sequence header at views, then a picture with one slice."""
    x = packets(spark, sf_dir).select(F.col("pid").cast("string").alias("source"), F.col("n").alias("idx"), "kind", F.row_number().over(Window.partitionBy("pid").orderBy("n")).alias("rn"))
    coding = F.when(F.col("kind") == "view", 1).when(F.col("kind") == "click", 2).otherwise(3)
    head = F.when(F.col("kind") == "view", F.unhex(F.lit("000001B3123456331A2B3C4D"))).otherwise(F.unhex(F.lit("")))
    field = F.unhex(F.lpad(F.hex((F.shiftleft((F.col("rn") % 1024).cast("long"), 6) + coding * 8)), 4, "0"))
    data = F.concat(head, F.unhex(F.lit("00000100")), field, F.unhex(F.lit("FFF8")), F.unhex(F.lit("00000101AABB")))
    return laid_out(x.select("source", "idx", data.alias("data")))


def _recut(units: DataFrame) -> DataFrame:
    """Units (source, infile, data) as pieces cut in the middle of each unit."""
    x = units.withColumn("h", F.floor(F.length("data") / 2).cast("int"))
    pieces = F.array(F.struct(F.col("infile"), F.expr("substring(data, 1, h)").alias("data")), F.struct((F.col("infile") + F.col("h")).alias("infile"), F.expr("substring(data, h + 1)").alias("data")))
    return x.select("source", F.inline(pieces))


def program_stream_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A program stream: a packet for each order, video or audio by its customer, ten to a pack."""
    x = table(spark, sf_dir, "orders").select(F.lit("orders").alias("source"), "o_orderkey", "o_custkey", F.col("o_orderpriority").cast("binary").alias("body"))
    x = places.sums_before(x, ["source"], F.col("o_orderkey"), ["o_orderkey"], {"k": F.lit(1), "before": F.length("body") + 9})
    kind = F.when(F.col("o_custkey") % 3 == 0, F.unhex(F.lit("E0"))).when(F.col("o_custkey") % 3 == 1, F.unhex(F.lit("C1"))).otherwise(F.unhex(F.lit("C2")))
    head = F.when(F.col("k") % 10 == 0, F.unhex(F.lit("000001BA440004000401000003F8"))).otherwise(F.unhex(F.lit("")))
    packet = F.concat(F.unhex(F.lit("000001")), kind, be(F.length("body") + 3, 2), F.unhex(F.lit("800000")), F.col("body"))
    # a header of 14 bytes for each ten packets before
    return _recut(x.select("source", (F.col("before") + F.expr("(k + 9) div 10") * 14).alias("infile"), F.concat(head, packet).alias("data")))


def capture_file_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A capture file (big-endian): a UDP datagram for each event, its kind being the payload."""
    x = packets(spark, sf_dir).select("n", "us", (F.col("pid") - 256).alias("u"), F.col("kind").cast("binary").alias("body"))
    x = places.sums_before(x.withColumn("source", F.lit("events")), ["source"], F.col("n"), ["n"], {"k": F.lit(1), "before": F.length("body") + 58})
    size = F.length("body")
    udp = F.concat(be(F.lit(1000), 2), be(F.col("u") % 4 + 5000, 2), be(size + 8, 2), F.unhex(F.lit("0000")), F.col("body"))
    ip = F.concat(F.unhex(F.lit("4500")), be(size + 28, 2), F.unhex(F.lit("00000000401100000A000001")), be(F.col("u") + 167772160, 4), udp)
    frame = F.concat(F.unhex(F.lit("0101010101010202020202020800")), ip)
    record = F.concat(be(F.expr("us div 1000000"), 4), be(F.expr("us % 1000000"), 4), be(F.length(frame), 4), be(F.length(frame), 4), frame)
    head = F.when(F.col("k") == 0, F.unhex(F.lit("A1B2C3D400020004" + "00" * 8 + "0000FFFF00000001"))).otherwise(F.unhex(F.lit("")))
    return _recut(x.select("source", (F.col("before") + F.when(F.col("k") > 0, 24).otherwise(0)).alias("infile"), F.concat(head, record).alias("data")))


def stamped_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transport packets with an arrival stamp before each: the event's microseconds. The payload begins with the stream's number."""
    x = in_streams(packets(spark, sf_dir)).select(F.col("n").alias("idx"), "us", "pid", F.col("source").cast("long").alias("stream"))
    raw = F.concat(be(F.col("us") % (1 << 32), 4), F.unhex(F.lit("47")), be(F.col("pid"), 2), F.unhex(F.lit("10")), be(F.col("stream"), 4), F.unhex(F.lit("FF" * 180)))
    x = places.number(x.select(F.lit("events").alias("source"), "idx", raw.alias("data")), ["source"], F.col("idx"), ["idx"], "k")
    return _recut(x.withColumn("infile", F.col("k") * 192))
