import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parent.parent)
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    from parcelmill.session import session

    spark = session("tests", "local[4]", **{"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    yield spark
    spark.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(rows):
    """Rows as sorted tuples of texts: floats to six places, missing as a dash."""
    def one(v):
        if v is None or v != v:
            return "-"
        return f"{v:.6f}".rstrip("0").rstrip(".") if isinstance(v, float) else str(v)

    return sorted(tuple(one(v) for v in r) for r in rows)


def held_against_sql(query, sql, spark, duck):
    df = query(spark, SF)
    names = sorted(df.columns)
    got = plain(tuple(r) for r in df.select(*[f"`{n}`" for n in names]).collect())
    result = duck.execute(sql)
    found = [d[0] for d in result.description]
    assert sorted(found) == names
    at = [found.index(n) for n in names]
    assert got == plain(tuple(r[i] for i in at) for r in result.fetchall())
