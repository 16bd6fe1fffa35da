"""All queries of the reference operators, and their oracles.

A plan module registers its queries with `query`; the name starts with the operator's id in the
inventory. Oracles may use the stand-in views of `lodestone.plans.views` by name: the common table
expressions they need are put in front.
"""

from __future__ import annotations

import importlib
import pkgutil
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestone.plans import views

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Callable[[views.Tables], DataFrame]], Callable]:
    """Register a function of `Tables` as the query `name`, with its DuckDB SQL."""

    def put(f: Callable[[views.Tables], DataFrame]) -> Callable:
        if name in _QUERIES:
            raise ValueError(f"two queries are named {name}")
        _QUERIES[name] = lambda spark, sf_dir: f(views.Tables(spark, sf_dir))
        if oracle:
            _ORACLES[name] = views.with_views(oracle)
        return f

    return put


def _load() -> None:
    import lodestone.plans as package

    for m in pkgutil.iter_modules(package.__path__):
        if m.name.startswith("plan_"):
            importlib.import_module(f"lodestone.plans.{m.name}")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hybrid retrieval over all documents for a few questions at once."""
    return queries()["i07_hybrid_merge"](spark, sf_dir)


def queries() -> dict[str, Query]:
    _load()
    return dict(sorted(_QUERIES.items()))


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(sorted(_ORACLES.items()))
