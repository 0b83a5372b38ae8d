from pyspark.sql import functions as F

from muxlake.operators import packets, places
from muxlake.sources import files


def test_sums_by_chunks_equal_plain_sums(spark):
    keys = [-40, -3, 0, 1, 2, 3, 5, 300, 301, 99999, 1 << 40]
    x = spark.createDataFrame([(s, k, i + 1) for s in ("a", "b") for i, k in enumerate(keys)], "source string, k long, size int")
    got = places.sums_before(x, ["source"], F.col("k"), ["k"], {"n": F.lit(1), "at": F.col("size")}, bits=2)
    for source in "ab":
        rows = got.where(F.col("source") == source).orderBy("k").collect()
        assert [(r.k, r.n, r.at) for r in rows] == [(k, i, i * (i + 1) // 2) for i, k in enumerate(keys)]


def test_reorder_counts_by_chunks_and_keeps_null_stamps(spark):
    x = spark.createDataFrame([("a", 1, 9 << 20), ("a", 2, None), ("a", 3, 5), ("a", 4, 5)], "source string, pos long, stamp long")
    got = packets.reorder(x, "stamp")
    assert [(r.pos, r.out_no) for r in got.orderBy("out_no").collect()] == [(2, 1), (3, 2), (4, 3), (1, 4)]
    assert "_chunk" in got._jdf.queryExecution().optimizedPlan().toString()


def test_pieces_go_to_the_reader_in_blocks(spark):
    x = spark.createDataFrame([("a", i * 10, bytearray(b"0123456789")) for i in range(500)] + [("b", 0, bytearray())], "source string, infile long, data binary")
    assert [(r.source, r.infile, r["size"]) for r in files._blocks(x).orderBy("source").collect()] == [("a", 0, 5000), ("b", 0, 0)]
