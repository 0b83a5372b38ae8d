import time

import pandas as pd

from muxlake.operators import packets
from muxlake.streaming import keyed


def drive(spark, tmp_path, rows, ddl, fn, name):
    for i, part in enumerate(rows):
        spark.createDataFrame(part, ddl).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
    stream = spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name))
    q = fn(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / f"{name}-state")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return spark.table(name).toPandas()


def test_continuity_over_batches(spark, tmp_path):
    ddl = "source string, pid long, pos long, cc int, has_payload boolean, disc boolean"
    make = lambda ccs, at: [("f", 1, at + i, c, True, False) for i, c in enumerate(ccs)]
    got = drive(spark, tmp_path, [make([1, 2, 3], 0), make([4, 6, 7], 10)], ddl, keyed.continuity, "cc")
    assert got["pos"].tolist() == [11]


def test_reorder_over_batches(spark, tmp_path):
    ddl = "source string, n long, stamp long"
    make = lambda stamps, at: [("f", at + i, s) for i, s in enumerate(stamps)]
    got = drive(spark, tmp_path, [make([1, 3, 2], 0), make([5, 4, 6], 3)], ddl, lambda s: keyed.reorder(s, 2), "ro")
    assert got.sort_values("out_no")["stamp"].tolist() == [1, 2, 3, 4]


def test_sections_over_batches(spark, tmp_path):
    ddl = "source string, dst_ip long, dst_port long, pkt_no long, t90 long, pcr90 long"
    row = lambda no, t: ("f", 1, 2, no, t, t)
    got = drive(spark, tmp_path, [[row(0, 0), row(1, 90000)], [row(2, 90000 * 60), row(3, 90000 * 61)]], ddl, keyed.sections, "se")
    assert got.sort_values("pkt_no")["section"].tolist() == [0, 0, 1, 1]
    assert isinstance(got, pd.DataFrame)


def test_duplicates_over_batches(spark, tmp_path):
    ddl = "source string, pid long, pos long, cc int, has_payload boolean, disc boolean, raw string"
    make = lambda rows, at: [("f", 1, at + i, c, True, False, raw) for i, (c, raw) in enumerate(rows)]
    batches = [make([(1, "a"), (2, "b"), (2, "b")], 0), make([(2, "b"), (2, "c"), (5, "d")], 10)]
    got = drive(spark, tmp_path, batches, ddl, lambda s: keyed.continuity(s, "raw"), "dup")
    assert sorted(zip(got["pos"], got["fault"])) == [(10, "duplicate"), (11, "content"), (11, "duplicate"), (12, "discontinuity")]
    whole = packets.continuity(spark.createDataFrame(sum(batches, []), ddl)).first()
    assert (whole.dup_errors, whole.content_errors, whole.cc_errors) == (2, 1, 1)


def test_reordered_packets_left_at_a_silence(spark, tmp_path):
    ddl = "source string, n long, stamp long"
    for part in ([("f", i, s) for i, s in enumerate([1, 3, 2, 4])],):
        spark.createDataFrame(part, ddl).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(ddl).parquet(str(tmp_path / "in"))
    q = keyed.reorder(stream, 3, silence_ms=500).writeStream.format("memory").queryName("silence").outputMode("append").trigger(processingTime="1 second").option("checkpointLocation", str(tmp_path / "state")).start()
    try:
        for _ in range(120):
            if spark.table("silence").count() == 4:
                break
            time.sleep(0.5)
    finally:
        q.stop()
    assert [r.stamp for r in spark.table("silence").orderBy("out_no").collect()] == [1, 2, 3, 4]
