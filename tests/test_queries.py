"""Every query of the core with SQL against DuckDB on the smallest tables."""

import glob
import os

import duckdb
import pytest

from censusflow.plans import registry

DATA = "/root/testdata/sf0.001"


def bag(frame):
    frame = frame[sorted(frame.columns)]
    return list(frame.columns), sorted(str(tuple("~" if v is None or v != v else str(v) for v in r)) for r in frame.itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
@pytest.mark.parametrize("name", list(registry.queries()))
def test_same_rows(spark, duck, name):
    assert bag(registry.queries()[name](spark, DATA).toPandas()) == bag(duck.execute(registry.oracle_sql()[name]).df())


def test_stream(spark, tmp_path):
    from censusflow.plans.pipeline import Options
    from censusflow.sources.derived import derived_export
    from censusflow.streaming import follow

    raw = derived_export(spark, DATA)
    raw.repartition(1).write.parquet(str(tmp_path / "in"))
    got = []
    q = follow(spark, str(tmp_path / "in"), raw.schema, Options(dedup_client_id=True), lambda df, i: got.append(df.count()), str(tmp_path / "cp"))
    q.awaitTermination()
    assert got == [registry.queries()["dedup_client_id"](spark, DATA).count()]
