"""The same question answered on several layouts, side by side.

The reference shows the three answers and leaves the comparing to the
reader; this job does it: full outer joins on the shared key, one value
column per layout and a status per key. Inputs are question results (one
row per key after aggregation), so the joins are small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _close(a: Column, b: Column, tol: float) -> Column:
    return F.abs(a - b) <= F.lit(tol) * F.greatest(F.lit(1.0), F.abs(a), F.abs(b))


def reconcile(sides: dict[str, DataFrame], tol: float = 1e-9) -> DataFrame:
    """``sides``: name -> frame with columns ``key`` (string) and ``value``
    (double). Result: key, one column per side, and ``status``:
    ``match`` (all present and equal within ``tol``, relative),
    ``differs`` (all present, some unequal), or ``only:<sides present>``."""
    names = list(sides)
    joined = None
    for name in names:
        df = sides[name].select(F.col("key"), F.col("value").cast("double").alias(name))
        joined = df if joined is None else joined.join(df, "key", "full_outer")
    present = [F.col(n).isNotNull() for n in names]
    all_present = present[0]
    for p in present[1:]:
        all_present = all_present & p
    equal = F.lit(True)
    for other in names[1:]:
        equal = equal & _close(F.col(names[0]), F.col(other), tol)
    only = F.concat_ws(",", *[F.when(F.col(n).isNotNull(), F.lit(n)) for n in names])
    status = (F.when(all_present & equal, F.lit("match"))
              .when(all_present, F.lit("differs"))
              .otherwise(F.concat(F.lit("only:"), only)))
    return joined.select("key", *names, status.alias("status"))


def keyed(df: DataFrame, key: Column, value: str) -> DataFrame:
    """A question result reduced to (key, value)."""
    return df.select(key.cast("string").alias("key"), F.col(value).alias("value"))
