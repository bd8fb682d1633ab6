import duckdb
import pytest

from careflow.llm.queries import ORACLES
from tests.oracle import compare

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """Documents from texts, or (doc_id, text) pairs; other columns clash with those the operators add."""

    def make(*texts, clash=True):
        rows = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
        extra = ", score string, n_words string, rid string, key string, kept string, component_id string" if clash else ""
        more = ("x", None, "x", "x", "x", "x") if clash else ()
        return spark.createDataFrame([(i, t, "en", None, 0, *more) for i, t in rows], DOCS + extra)

    return make


@pytest.fixture
def labels(spark):
    def make(*rows, **columns):
        return spark.createDataFrame([*rows], "doc_id long, quality int, toxic int")

    return make


@pytest.fixture
def against_sql(spark, tmp_path):
    """Compares an operator's rows with a query's SQL on the given tables."""

    def check(query, operator, **tables):
        con = duckdb.connect()
        for name, df in tables.items():
            path = f"{tmp_path}/{name}.parquet"
            df.write.mode("overwrite").parquet(path)
            con.execute(f"CREATE OR REPLACE VIEW {name} AS SELECT * FROM read_parquet('{path}/*.parquet')")
        read = {name: spark.read.parquet(f"{tmp_path}/{name}.parquet") for name in tables}
        assert compare(spark, con, None, lambda *_: operator(**read), ORACLES[query]) is None

    return check
