"""The driver's contract, with and without the optional subpackage."""

import importlib
import sys

import pytest

import __spark_entry__ as entry


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["qid", "rank", "parent_id", "score", "label"] and df.count() > 0


def test_core_stands_alone(monkeypatch):
    monkeypatch.setitem(sys.modules, "marginalia.llm", None)
    monkeypatch.setitem(sys.modules, "marginalia.llm.registry", None)
    alone = importlib.reload(entry)
    assert alone.llm is None and "bm25_topk" in alone.queries()
    monkeypatch.undo()
    importlib.reload(entry)


@pytest.mark.parametrize("name", sorted(__import__("marginalia.plans.registry", fromlist=["x"]).QUERIES))
def test_core_queries_match_their_sql(spark, sf, name):
    """Each query on the smallest data; against DuckDB where there is SQL."""
    import glob
    import os

    import duckdb
    import numpy as np
    import pandas as pd

    from marginalia.plans import registry

    got = registry.QUERIES[name](spark, sf).toPandas()
    if name not in registry.ORACLES:
        assert len(got.columns)
        return
    c = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    want = c.execute(registry.ORACLES[name]).df()

    def plain(v):
        if isinstance(v, (list, tuple, np.ndarray)):
            return tuple(map(plain, v))
        if v is None or v is pd.NA or v != v:
            return None
        return round(float(v), 6) if isinstance(v, (float, np.floating)) else v.item() if isinstance(v, np.generic) else v

    rows = lambda d: sorted(repr(tuple(plain(x) for x in r)) for r in d[sorted(d.columns)].itertuples(index=False, name=None))
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
