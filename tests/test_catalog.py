"""Every registered query of the engine against its SQL in DuckDB, and the streaming form against the batch one."""

import glob
import os
from decimal import Decimal

import duckdb
import pytest

from lodestar.plans import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


def rows(values, order):
    return sorted((tuple(repr(round(v, 9) if isinstance(v, float) else float(v) if isinstance(v, Decimal) else v) for v in (r[i] for i in order)) for r in values))


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    got = [tuple(r) for r in df.collect()]
    text = catalog.oracle_sql().get(name)
    if text is None:
        assert got
        return
    want = duck.execute(text)
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(df.columns)
    mine, theirs = sorted(range(len(columns)), key=lambda i: df.columns[i]), sorted(range(len(columns)), key=lambda i: columns[i])
    assert rows(got, mine) == rows(want.fetchall(), theirs)


def test_stream_equals_batch(spark, tmp_path):
    from lodestar.streaming.windows import stream_tumbling, tumbling

    events = spark.read.parquet(f"{SF}/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    q = stream_tumbling(spark, str(tmp_path / "in"), events.schema).writeStream.outputMode("complete").format("memory").queryName("tumbled").option("checkpointLocation", str(tmp_path / "state")).start()
    q.processAllAvailable()
    q.stop()
    batch = tumbling(events.withColumn("ts", events["ts"].cast("timestamp")))
    assert sorted(map(tuple, spark.table("tumbled").collect())) == sorted(map(tuple, batch.collect()))


def test_entry_points():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
