"""Named queries: ``name -> (spark builder, oracle SQL or None)``.

Each builder takes ``(spark, sf_dir)`` and returns a lazy DataFrame over
the warehouse written from that folder's tables. The catalogue replaces
the reference's editable query registry (see README).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators import graph as graph_ops
from ..operators import nested as nested_ops
from ..operators import star as star_ops
from . import oracle
from .warehouse import Warehouse

Builder = Callable[[SparkSession, str], DataFrame]

_REGISTRY: dict[str, tuple[Builder, str | None]] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: Builder) -> Builder:
        _REGISTRY[name] = (fn, sql)
        return fn
    return deco


def _layout_question(layout: str, qname: str, fn) -> Builder:
    if layout == "star":
        return lambda spark, d: fn(Warehouse.open(spark, d).star())
    if layout == "nested":
        return lambda spark, d: fn(Warehouse.open(spark, d).nested())
    return lambda spark, d: fn(Warehouse.open(spark, d).graph())


def _register_questions() -> None:
    sources = [
        ("star", star_ops.QUESTIONS, oracle.STAR_SQL, ()),
        ("nested", nested_ops.QUESTIONS, oracle.NESTED_SQL, ()),
        ("graph", graph_ops.QUESTIONS, oracle.GRAPH_SQL, ("graph",)),
    ]
    for layout, questions, sqls, layers in sources:
        for qname, fn in questions.items():
            sql = oracle.with_ctes(sqls[qname], *layers)
            _REGISTRY[f"{layout}_{qname}"] = (_layout_question(layout, qname, fn), sql)


_register_questions()


def _load_extensions() -> None:
    # Modules that add their own entries with ``register``.
    from . import catalog_access, catalog_ingest, catalog_more, catalog_streams  # noqa: F401


_load_extensions()


def queries() -> dict[str, Builder]:
    return {name: fn for name, (fn, _sql) in _REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_fn, sql) in _REGISTRY.items() if sql is not None}
