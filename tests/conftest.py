import sys
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = (
        SparkSession.builder.master("local[8]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "6g").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"


def _plain(v):
    if isinstance(v, float):
        return round(v, 6) + 0.0
    return bytes(v) if isinstance(v, (bytearray, memoryview)) else v


@pytest.fixture(scope="session")
def same(spark, sf_dir):
    """Compares a query's rows with its SQL's, as sorted rows of columns sorted by name."""
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")

    def check(query, sql):
        df = query(spark, sf_dir)
        cols = sorted(df.columns)
        got = sorted(repr(tuple(_plain(r[c]) for c in cols)) for r in df.collect())
        rel = con.execute(sql)
        names = [d[0] for d in rel.description]
        assert sorted(names) == cols
        want = sorted(repr(tuple(_plain(row[names.index(c)]) for c in cols)) for row in rel.fetchall())
        assert got == want

    return check
