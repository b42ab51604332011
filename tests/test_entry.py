"""The driver contract in __spark_entry__.py."""

import importlib.util
import os

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def load_entry():
    spec = importlib.util.spec_from_file_location("spark_entry", os.path.join(ROOT, "__spark_entry__.py"))
    m = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(m)
    return m


def test_entry_and_registry(spark):
    m = load_entry()
    df = m.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns == load_entry().entry(spark).columns      # stable schema
    q, o = m.queries(), m.oracle_sql()
    assert set(o) <= set(q)
    assert all((fn.__doc__ or "").strip() for fn in q.values())
    assert all(isinstance(s, str) and s.strip() for s in o.values())
