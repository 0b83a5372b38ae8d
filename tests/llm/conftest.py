import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark():
    return (
        SparkSession.builder.master("local[4]").appName("llm-tests")
        .config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, dh string, h1 int"


@pytest.fixture
def docs(spark):
    """Builds a documents table with extra columns whose names clash with internal ones."""

    def make(texts):
        rows = [(k, t, "en", "src0", len(t or ""), "x", 1) for k, t in (texts.items() if isinstance(texts, dict) else texts)]
        return spark.createDataFrame(rows, SCHEMA)

    return make


@pytest.fixture
def folder(spark, tmp_path):
    """Writes tables to a data folder and returns its path."""

    def make(**tables):
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return make
