import os
import sys

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, HERE)
os.environ["PYTHONPATH"] = os.pathsep.join(x for x in (HERE, os.environ.get("PYTHONPATH", "")) if x)

os.environ.setdefault("OMP_NUM_THREADS", "1")  # Spark places the tasks

import pytest  # noqa: E402
from pyspark.sql import SparkSession  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[2]").appName("tests").config("spark.sql.shuffle.partitions", "2").config("spark.default.parallelism", "2")
        .config("spark.driver.memory", "4g").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false")
        .config("spark.local.dir", str(tmp_path_factory.mktemp("spark"))).config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoint"))).getOrCreate()
    )
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    def run(sql, **tables):
        con = duckdb.connect()
        for name, value in tables.items():
            if isinstance(value, str):
                con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{value}'")
            else:
                con.register(name, value)
        return con.execute(sql).df()

    return run


def rows_of(df, digits=9):
    """A frame's rows as comparable text, columns by name."""
    show = lambda v: "~" if v is None or v != v else (repr(round(float(v), digits)) if isinstance(v, float) else str(v))
    cols = sorted(df.columns)
    return sorted(tuple(show(v) for v in r) for r in df[cols].astype(object).itertuples(index=False, name=None))


@pytest.fixture(scope="session")
def same():
    def check(a, b, digits=6):
        assert sorted(a.columns) == sorted(b.columns)
        assert rows_of(a, digits) == rows_of(b, digits)

    return check
