import os
import sys
from decimal import Decimal

import duckdb
import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared"))).getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(rows):
    """Rows as sorted tuples of comparable text; columns by name."""
    out = []
    for r in rows:
        out.append(tuple("" if r[k] is None or r[k] != r[k] else f"{float(r[k]):.6f}" if isinstance(r[k], (int, float, Decimal)) and not isinstance(r[k], bool) else str(r[k]) for k in sorted(r)))
    return sorted(out)


def same(df, con, sql):
    got = [r.asDict() for r in df.collect()]
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    want = [dict(zip(names, r, strict=True)) for r in cursor.fetchall()]
    assert sorted(df.columns) == sorted(names)
    assert plain(got) == plain(want)
