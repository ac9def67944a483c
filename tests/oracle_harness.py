"""Run catalogue queries in Spark and their oracle SQL in DuckDB; compare.

Comparison mirrors the driver: row count, column names (sorted), and an
order-insensitive hash of the values. Floats are compared exactly first and
then, as a diagnostic only, with a relative tolerance.

    python tests/oracle_harness.py [sf_dir] [name-substring ...]
"""

from __future__ import annotations

import datetime as dt
import decimal
import hashlib
import math
import os
import sys
import time

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def duck_connect(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def _norm(v, exact: bool):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(v) if exact else float(f"{v:.9g}")
    if isinstance(v, decimal.Decimal):
        return _norm(float(v), exact)
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x, exact) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x, exact)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return _norm(v.asDict(), exact)
    if hasattr(v, "item"):
        return _norm(v.item(), exact)
    return v


def table_hash(columns: list[str], rows: list[tuple], exact: bool = True) -> str:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    keyed = sorted(repr(tuple(_norm(r[i], exact) for i in order)) for r in rows)
    return hashlib.sha1("\n".join(keyed).encode()).hexdigest()


_SPARK_KIND = {"int": "int32", "integer": "int32", "bigint": "int64", "long": "int64",
               "double": "float64", "string": "string", "boolean": "bool", "date": "date"}
_DUCK_KIND = {"INTEGER": "int32", "BIGINT": "int64", "DOUBLE": "float64", "VARCHAR": "string",
              "BOOLEAN": "bool", "DATE": "date"}


def type_mismatches(spark_df, con, sql: str) -> list:
    """Columns whose Spark type and DuckDB type differ in kind."""
    spark_types = {f.name: _SPARK_KIND.get(f.dataType.simpleString(), f.dataType.simpleString())
                   for f in spark_df.schema.fields}
    rel = con.sql(sql)
    duck_types = {n: _DUCK_KIND.get(str(t), str(t)) for n, t in zip(rel.columns, rel.types)}
    return [(c, spark_types[c], duck_types.get(c)) for c in spark_types
            if spark_types[c] != duck_types.get(c)]


def compare(spark_df, con, sql: str) -> dict:
    s_cols = spark_df.columns
    s_rows = [tuple(r) for r in spark_df.collect()]
    res = con.execute(sql)
    d_cols = [d[0] for d in res.description]
    d_rows = [tuple(r) for r in res.fetchall()]
    out = {
        "rows_spark": len(s_rows), "rows_oracle": len(d_rows),
        "schema_match": sorted(s_cols) == sorted(d_cols),
        "hash_match": False, "approx_match": False,
        "type_mismatches": type_mismatches(spark_df, con, sql),
    }
    if out["schema_match"]:
        d_rows = [tuple(r[d_cols.index(c)] for c in s_cols) for r in d_rows]
        out["hash_match"] = table_hash(s_cols, s_rows) == table_hash(s_cols, d_rows)
        out["approx_match"] = (table_hash(s_cols, s_rows, False)
                               == table_hash(s_cols, d_rows, False))
    else:
        out["columns"] = (s_cols, d_cols)
    return out


def main(argv: list[str]) -> int:
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    wanted = argv[2:]
    from shopfloor.session import build_session
    import __spark_entry__ as entry

    spark = build_session()
    con = duck_connect(sf_dir)
    qs, sqls = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, fn in qs.items():
        if wanted and not any(w in name for w in wanted):
            continue
        t0 = time.time()
        try:
            df = fn(spark, sf_dir)
            if name in sqls:
                r = compare(df, con, sqls[name])
                ok = (r["hash_match"] and r["rows_spark"] == r["rows_oracle"]
                      and not r["type_mismatches"])
            else:
                n = df.count()
                r, ok = {"rows_spark": n, "oracle": "none"}, True
        except Exception as exc:  # report and continue
            r, ok = {"error": f"{type(exc).__name__}: {str(exc)[:400]}"}, False
        bad += not ok
        print(f"{'OK ' if ok else 'BAD'} {name:55s} {time.time() - t0:6.2f}s {r}", flush=True)
    print(f"done: {bad} bad")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv))
