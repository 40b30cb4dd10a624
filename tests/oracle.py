"""Run registered queries on Spark and their SQL on DuckDB and compare whole results.

    python tests/oracle.py [--sf DIR] [name ...]
"""

from __future__ import annotations

import argparse
import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _plain(v):
    if isinstance(v, float) and math.isnan(v):
        return "nan"
    if hasattr(v, "tolist"):
        v = v.tolist()
    return repr(v)


def _family(t: str) -> str:
    t = t.lower()
    for k, names in {"int": ("tinyint", "smallint", "int16", "int8"), "int32": ("int", "integer", "int32"),
                     "int64": ("bigint", "int64"), "double": ("double",), "string": ("varchar", "string"),
                     "date": ("date", "date32[day]"), "boolean": ("boolean", "bool")}.items():
        if t in names:
            return k
    return t


def compare(spark_df, con, sql: str) -> list[str]:
    """Differences between a Spark result and a SQL result, as a list of short messages."""
    got = spark_df.toArrow()
    relation = con.sql(sql)
    names, types = relation.columns, [str(t) for t in relation.types]
    want = relation.fetchall()
    problems = []
    if sorted(got.column_names) != sorted(names):
        return [f"columns {sorted(got.column_names)} against {sorted(names)}"]
    spark_types = {f.name: _family(str(f.type)) for f in got.schema}
    for n, t in zip(names, types):
        if spark_types[n] != _family(t):
            problems.append(f"type of {n}: {spark_types[n]} against {_family(t)}")
    order = sorted(names)
    left = sorted([_plain(v) for v in row] for row in zip(*[got.column(n).to_pylist() for n in order]))
    place = [names.index(n) for n in order]
    right = sorted([_plain(row[i]) for i in place] for row in want)
    if len(left) != len(right):
        problems.append(f"rows {len(left)} against {len(right)}")
    different = [(a, b) for a, b in zip(left, right) if a != b]
    if different:
        problems.append(f"{len(different)} rows differ, columns {order}, first {different[0]}")
    return problems


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="/root/testdata/sf0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    from stillwell.catalog import ORACLE, QUERIES
    from stillwell.session import local_session
    spark, con = local_session("oracle"), duck(args.sf)
    bad = 0
    for name in args.names or QUERIES:
        t = time.time()
        try:
            df = QUERIES[name](spark, args.sf)
            if name in ORACLE:
                problems = compare(df, con, ORACLE[name])
                note = f"{time.time() - t:6.2f}s"
            else:
                problems, note = [], f"{time.time() - t:6.2f}s rows only: {df.count()}"
        except Exception as e:  # noqa: BLE001  one failing query must not stop the report
            problems, note = [f"{type(e).__name__}: {str(e)[:600]}"], ""
        bad += bool(problems)
        print(f"{'FAIL' if problems else 'ok  '} {name:28s} {note}", *problems, sep="\n       " if problems else " ", flush=True)
    print(f"{bad} of {len(args.names or QUERIES)} failed")
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main())
