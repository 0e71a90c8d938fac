"""Where query modules register a query and its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from chronofold.plans.standins import PRELUDE

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, *, recursive: bool = False):
    """Registers a function (spark, sf_dir) as query ``name``. ``sql`` follows the stand-ins' common table
    expressions: either ``SELECT ...`` or ``, more AS (...) SELECT ...``; with ``recursive`` these may refer to themselves."""

    def add(function):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = (PRELUDE.replace("WITH", "WITH RECURSIVE", 1) if recursive else PRELUDE) + "\n" + sql
        return function

    return add


def load() -> None:
    """Imports every query module once."""
    from chronofold.plans import (  # noqa: F401
        queries_admission,
        queries_books,
        queries_folds,
        queries_gates,
        queries_graph,
        queries_order,
        queries_sources,
        queries_text,
        queries_vectors,
        queries_views,
    )
