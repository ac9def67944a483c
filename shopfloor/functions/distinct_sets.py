"""Several distinct key sets from one scan: GROUPING SETS.

A layout needs many small tables of distinct values from the same order
lines (five dimensions; seven node labels and two small edge types). One
``groupingSets`` aggregation computes all of them in a single scan and a
single shuffle, with map-side partial aggregation (a hot value is combined
before the shuffle). The result is written once; each table is then a
filter on ``grouping_id`` of that small output.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.storage import Storage


def distinct_sets(df: DataFrame, sets: dict[str, list[str]], storage: Storage, stage: str,
                  firsts: dict[str, dict[str, str]] | None = None,
                  order: str = "line_no") -> dict[str, DataFrame]:
    """``sets``: table -> grouping columns. ``firsts``: table -> {output
    column: input column} taken from the first row in ``order``
    (``min_by``). Returns table -> frame of its columns; the exact row
    count of each table is in ``distinct_sets.counts`` of the result."""
    firsts = firsts or {}
    columns: list[str] = []
    for cols in sets.values():
        for c in cols:
            if c not in columns:
                columns.append(c)
    aggs = [F.grouping_id().alias("_gid")]
    for table, attrs in firsts.items():
        for out, src in attrs.items():
            aggs.append(F.min_by(F.col(src), F.col(order)).alias(f"_{table}__{out}"))
    grouped = df.groupingSets([list(cols) for cols in sets.values()], *columns).agg(*aggs)
    staged = storage.write(grouped, "stage", stage)
    width = len(columns)
    per_gid = {int(r["_gid"]): int(r["n"])  # one row per set: bounded
               for r in staged.groupBy("_gid").agg(F.count(F.lit(1)).alias("n")).collect()}
    out = Tables()
    for table, cols in sets.items():
        gid = sum(1 << (width - 1 - i) for i, c in enumerate(columns) if c not in cols)
        picked = [F.col(c) for c in cols]
        picked += [F.col(f"_{table}__{o}").alias(o) for o in firsts.get(table, {})]
        out[table] = staged.where(F.col("_gid") == gid).select(*picked)
        out.counts[table] = per_gid.get(gid, 0)
    return out


class Tables(dict):
    """table -> frame, with ``counts``: table -> exact row count."""

    def __init__(self):
        super().__init__()
        self.counts: dict[str, int] = {}
