"""Registered queries: name -> (spark builder, DuckDB oracle SQL or None).

Every builder takes ``(spark, sf_dir)`` and returns a lazy DataFrame over the
whole driver tables (or data Spark derives from them).  Oracle SQL bodies may
reference the fixture views; ``oracle.with_views`` inlines them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import ship_package
from ..sources.fixtures import Fixture
from ..sources.tables import fingerprint
from .oracle import with_views

Builder = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[Builder, str | None]] = {}


def query(name: str, oracle: str | None = None):
    """Register a query builder; ``oracle`` is DuckDB SQL over the fixture views."""
    def deco(fn: Callable[[Fixture], DataFrame]):
        def build(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return fn(Fixture(spark, sf_dir))
        build.__name__ = fn.__name__
        build.__doc__ = fn.__doc__
        REGISTRY[name] = (build, with_views(oracle) if oracle else None)
        return fn
    return deco


_SHARED: dict[str, tuple] = {}


def shared(fx: Fixture, name: str, run: Callable[[Fixture], object]):
    """Result of ``run`` that several queries read, kept for the last data folder it ran on.

    It is run again in another session or where the folder's files have changed; only one result a name is held.
    """
    key = (fx.spark.sparkContext.applicationId, fx.t.sf_dir, fingerprint(fx.spark, fx.t.sf_dir))
    if _SHARED.get(name, (None,))[0] != key:
        _SHARED[name] = (key, run(fx))
    return _SHARED[name][1]


def queries() -> dict[str, Builder]:
    _load()
    return {k: v[0] for k, v in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    _load()
    return {k: v[1] for k, v in REGISTRY.items() if v[1]}


_MODULES = ["q_queue", "q_reputation", "q_categories", "q_ops", "q_text", "q_privacy", "q_vectors", "q_search", "q_model", "q_pipeline", "q_ingest", "q_streaming"]


def _load() -> None:
    # importing the modules registers their queries
    import importlib
    for m in _MODULES:
        importlib.import_module(f"{__package__}.{m}")
