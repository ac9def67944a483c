"""Ad-hoc access (A1-A4): SQL over the star, and the document-store calls
``find`` and ``aggregate`` as plain DataFrame functions.

The reference parses a JSON stage list; here an aggregation is a list of
stage functions, each ``DataFrame -> DataFrame``, so every stage is an
ordinary Catalyst operator (filter, aggregate, sort, limit, project).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .star import Star

Stage = Callable[[DataFrame], DataFrame]

FIND_DEFAULT_LIMIT = 100


# -- A1: SQL over the star ----------------------------------------------------

def register_star(spark: SparkSession, star: Star, prefix: str = "") -> list[str]:
    """Temp views named as the reference's tables, for ``spark.sql``."""
    names = []
    for name, df in star.tables().items():
        df.createOrReplaceTempView(prefix + name)
        names.append(prefix + name)
    return names


# -- A2: find -------------------------------------------------------------------

def find(df: DataFrame, where: Column | str | None = None, cols: list[str] | None = None,
         limit: int | None = FIND_DEFAULT_LIMIT, sort: list[str] | None = None) -> DataFrame:
    """Filter, project, limit (default 100). Sorted before the limit (by
    ``sort`` or the first column) so the cut is the same on every run."""
    out = df if where is None else df.where(where)
    if cols:
        out = out.select(*[F.col(c).alias(c.replace(".", "_")) if "." in c else F.col(c)
                           for c in cols])
    if limit is not None:
        out = out.orderBy(*(sort or [out.columns[0]])).limit(limit)
    return out


# -- A3: aggregate with stage functions --------------------------------------

def aggregate(df: DataFrame, *stages: Stage) -> DataFrame:
    for stage in stages:
        df = stage(df)
    return df


def match(cond: Column | str) -> Stage:
    return lambda df: df.where(cond)


def group(keys: dict[str, Column | str], **aggs: Column) -> Stage:
    """``$group``: ``keys`` name -> expression; ``aggs`` name -> aggregate."""
    def run(df: DataFrame) -> DataFrame:
        exprs = [(F.col(e) if isinstance(e, str) else e).alias(k) for k, e in keys.items()]
        return df.groupBy(*exprs).agg(*[a.alias(n) for n, a in aggs.items()])
    return run


def sort(*cols: Column | str) -> Stage:
    return lambda df: df.orderBy(*cols)


def limit(n: int) -> Stage:
    return lambda df: df.limit(n)


def project(*cols: Column | str) -> Stage:
    return lambda df: df.select(*cols)


def add_fields(**exprs: Column) -> Stage:
    return lambda df: df.withColumns(exprs)


def ne_null(col: str) -> Column:
    return F.col(col).isNotNull()


# -- A4: records with differing fields ------------------------------------------

def union_records(*dfs: DataFrame) -> DataFrame:
    """Rows of all inputs; columns are the union of their fields in
    first-seen order, missing ones null."""
    out = dfs[0]
    for df in dfs[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out
