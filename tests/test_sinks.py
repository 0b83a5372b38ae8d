"""Sinks, a served stream, planar pictures and command-line values."""

import socket
import threading

import pytest
from pyspark.sql import functions as F

from muxlake.functions import values
from muxlake.sources import pictures, records, sinks
from muxlake.streaming import serve


def rows(spark, n=20):
    return spark.range(n).select(F.lit("f").alias("source"), F.col("id").alias("idx"), (F.col("id") % 3 == 0).alias("ref"), F.format_string("<%d>", "id").cast("binary").alias("data"))


def whole(numbers):
    return "".join(f"<{i}>" for i in numbers).encode()


def test_file_and_tcp_sinks(spark, tmp_path):
    sink = sinks.open_sink(str(tmp_path / "x.es"))
    assert records.write_stream(rows(spark), ["idx"], "data", sink) == len(whole(range(20)))
    sink.close()
    assert (tmp_path / "x.es").read_bytes() == whole(range(20))
    server = socket.create_server(("127.0.0.1", 0))
    got = []

    def take():
        peer, _ = server.accept()
        with peer:
            peer.sendall(b"n f\n")
            while data := peer.recv(4096):
                got.append(data)

    reader = threading.Thread(target=take)
    reader.start()
    sink = sinks.open_sink(f"tcp://127.0.0.1:{server.getsockname()[1]}")
    records.write_stream(rows(spark), ["idx"], "data", sink)
    said = ""
    for _ in range(100):
        said += sink.commands()
        if len(said) == 2:
            break
    sink.close()
    reader.join(20)
    assert b"".join(got) == whole(range(20)) and said == "nf"


def test_udp_sink_paces_datagrams(spark):
    own = socket.socket(socket.AF_INET, socket.SOCK_DGRAM)
    own.bind(("127.0.0.1", 0))
    own.settimeout(20)
    sink = sinks.open_sink(f"udp://127.0.0.1:{own.getsockname()[1]}", size=10)
    waits = []
    timed = rows(spark, 6).withColumn("us", F.col("idx") * 10**8)
    records.write_stream(timed, ["idx"], "data", sink, "us", waits.append)
    sink.close()
    parts = [own.recv(100), own.recv(100)]
    assert [len(p) for p in parts] == [10, 8] and b"".join(parts) == whole(range(6)) and len(waits) == 5


def test_served_pictures(spark):
    server = serve.PictureServer(("127.0.0.1", 0), rows(spark, 40).cache(), step=5)
    server.start()
    try:
        with socket.create_connection(server.server_address, timeout=120) as peer:
            def ask(command, want):
                peer.sendall(command)
                got = b""
                while len(got) < len(want):
                    got += peer.recv(4096)
                assert got == want

            ask(b"n", whole(range(5)))
            ask(b"f", whole([6, 9, 12, 15, 18]))
            ask(b"r", whole([18, 15, 12, 9, 6]))
            ask(b"0n", whole(range(5)))
            peer.sendall(b"q")
            assert peer.recv(10) == b""
    finally:
        server.shutdown()
        server.server_close()


def test_planar_pictures(spark, tmp_path):
    bright, colour = pictures.plane_sizes(5, 3)
    assert (bright, colour) == (15, 6) and pictures.plane_sizes(4, 4, "422") == (16, 8) and pictures.plane_sizes(4, 4, "400") == (16, 0)
    frame = lambda k: bytes([k]) * 15 + bytes([k + 1]) * 6 + bytes([k + 2]) * 6
    (tmp_path / "x.yuv").write_bytes(frame(10) + frame(20) + b"short")
    x = pictures.read_planar(spark, str(tmp_path / "x.yuv"), 5, 3)
    assert [(r.n, bytes(r.y), bytes(r.u), bytes(r.v)) for r in x.orderBy("n").collect()] == [(i, bytes([k]) * 15, bytes([k + 1]) * 6, bytes([k + 2]) * 6) for i, k in enumerate((10, 20))]
    assert bytes(pictures.as_pgm(x, 5, 3).orderBy("n").first().image) == b"P5\n5 3\n255\n" + bytes([10]) * 15


def test_values():
    assert (values.integer("-0x10"), values.unsigned("7"), values.real("2.5"), values.host_port("a:81"), values.host_port("a", 88), values.ids("1, 0x100,")) == (-16, 7, 2.5, ("a", 81), ("a", 88), [1, 256])
    for wrong in (lambda: values.unsigned("-1"), lambda: values.integer("x"), lambda: values.real("3", most=2), lambda: values.host_port("a"), lambda: values.ids("9000")):
        with pytest.raises(ValueError):
            wrong()


def test_messages():
    own = sinks.Messages()
    said, wrong = [], []
    own.redirect(said.append, wrong.append)
    own.say("a")
    own.complain("b")
    own.all_to_error()
    own.say("c")
    assert (said, wrong) == (["a"], ["b", "c"])
