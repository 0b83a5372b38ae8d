"""The pipeline's stages on a small corpus, each against a brute-force version of its input."""

import gc
import re
import time
from pathlib import Path

import pytest

pipeline = pytest.importorskip("corpus_pipeline")

from muxlake.llm import neardups  # noqa: E402
from muxlake.llm._common import tidy  # noqa: E402

FOLDER = "/root/testdata/sf0.001"


def test_stages_one_by_one(spark, tmp_path):
    docs, ids = spark.read.parquet(f"{FOLDER}/documents.parquet"), []
    columns = docs.columns
    for name, stage in pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
        stage(spark, docs, FOLDER).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        if name != pipeline.STAGES[-1][0]:
            assert docs.columns == columns
            after = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
            assert len(after) == docs.count() and after.keys() <= before.keys()
        if name == "line_dedup":
            seen = {}
            for k in sorted(before):
                for line in before[k].split("\n"):
                    key = line.strip(" \t\n\x0b\x0c\r").encode().lower()
                    seen.setdefault(key, k)
            for k, text in before.items():
                left = [x for x in text.split("\n") if len(x.strip(" \t\n\x0b\x0c\r")) < 10 or seen[x.strip(" \t\n\x0b\x0c\r").encode().lower()] == k]
                assert after.get(k, "") == "\n".join(left) or (k not in after and not "".join(left).strip())
        if name == "near_dedup":
            roots = neardups.brute_force(before)
            assert after.keys() == set(roots.values()) and all(before[k] == after[k] for k in after)
        ids.append(docs.count())
    assert ids == sorted(ids, reverse=True)


def test_run_gives_the_last_stage(spark):
    rows = pipeline.run(spark, FOLDER)
    assert "ids" in rows.columns and rows.count() > 0


def test_stages_on_an_empty_table(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").where("doc_id < 0")
    for name, stage in pipeline.STAGES:
        stage(spark, docs, FOLDER).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.schema(stage(spark, docs, FOLDER).schema).parquet(f"{tmp_path}/{name}")
        assert docs.count() == 0


def test_stages_on_odd_rows(spark, tmp_path):
    """Null ids and texts, repeated rows, a long text and columns with clashing names."""
    long = "\n".join(f"line {i} of a long text with words {i * 7}" for i in range(4000))
    rows = [(1, "some words here\nthat are clean", "en", "s1"), (1, "some words here\nthat are clean", "en", "s1"), (None, "no id but words", None, None), (None, None, "en", "s2"), (2, None, None, "s2"), (3, "", "de", None), (4, long, "en", "s1"), (5, long, "en", "s3")]
    docs = spark.createDataFrame([(*r, len(r[1] or ""), 7, "x", 1.0, "y") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, mix_id int, l_kept string, own_id double, dh string")
    columns = docs.columns
    for name, stage in pipeline.STAGES:
        stage(spark, docs, FOLDER).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        ids = sorted(r.doc_id or -1 for r in docs.collect())
        if name != pipeline.STAGES[-1][0]:
            assert docs.columns == columns
        if name == "line_dedup":  # the copy has no line left; empty texts stay
            assert ids == [-1, -1, 1, 1, 2, 3, 4]
        if name == "near_dedup":  # the two empty texts are equal
            assert ids == [-1, -1, 1, 2, 4]


def test_tidy_returns_freed_memory_of_the_driver(spark):
    """100 MB outside the heap, freed in pieces between others that stay, which malloc keeps."""
    jvm = spark.sparkContext._jvm
    path = Path(f"/proc/{jvm.java.lang.ProcessHandle.current().pid()}/smaps_rollup")

    def held():
        return int(re.search(r"Pss_Anon:\s+(\d+)", path.read_text())[1]) / 1024

    buffers = [jvm.java.nio.ByteBuffer.allocateDirect(100_000) for _ in range(1000)]
    buffers = buffers[::100]
    for _ in range(3):
        gc.collect()
        jvm.System.gc()
        time.sleep(0.4)
    before = held()
    tidy(spark)
    assert before - held() > 60 and len(buffers) == 10
