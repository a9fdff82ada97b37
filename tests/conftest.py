import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")  # for the executors' Python
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from tessera.session import local_session

    session = local_session(4, 4, "4g")
    session.sparkContext.setLogLevel("ERROR")
    session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoint")))
    return session


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for name in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SMALL}/{name}.parquet'")
    return con


@pytest.fixture(scope="session")
def same(spark, duck):
    """Holds a query's rows on the smallest tables against its SQL's."""

    def check(query, sql):
        got = query(spark, SMALL)
        rows = got.collect()
        result = duck.execute(sql)
        names = [d[0] for d in result.description]
        assert sorted(names) == sorted(got.columns)
        order = [names.index(c) for c in got.columns]
        want = [tuple(r[i] for i in order) for r in result.fetchall()]
        assert sorted(map(repr, map(tuple, rows))) == sorted(map(repr, want))
        return rows

    return check
