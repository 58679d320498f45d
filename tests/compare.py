"""Runs registered queries next to their SQL and reports differences.

    python -m tests.compare [--sf 0.01] [name or prefix ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

ROOT = Path("/root/testdata")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{ROOT}/sf{sf}/{t}.parquet')")
    return con


def _cell(v):
    if v is None:
        return "~"
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0 if v else 0.0)
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def _kind(name: str) -> str:
    name = name.lower()
    if name.startswith(("int", "bigint", "integer", "smallint", "tinyint", "long")):
        return name.replace("integer", "int")
    return name


def compare(spark, con, name, fn, sql, sf):
    """None when equal, else a short text."""
    df = fn(spark, f"{ROOT}/sf{sf}")
    mine = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return None if mine else "no rows"
    res = con.execute(sql)
    cols = [d[0] for d in res.description]
    if sorted(cols) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(cols)}"
    kinds = {c: _kind(str(d[1])) for c, d in zip(cols, res.description)}
    theirs = rows_of(cols, res.fetchall())
    odd = [f"{c}: {t} against {kinds[c]}" for c, t in df.dtypes if _kind(t) != kinds[c] and {_kind(t), kinds[c]} not in ({"string", "varchar"},)]
    if mine != theirs:
        a, b = set(mine) - set(theirs), set(theirs) - set(mine)
        return f"{len(mine)} rows against {len(theirs)}; {len(a)} only here {sorted(a)[:3]}; {len(b)} only there {sorted(b)[:3]}"
    if odd:
        return f"types differ: {odd}"
    return None


def main(argv):
    import __spark_entry__ as entry
    from tintwell.session import build_session

    sf = "0.01"
    if "--sf" in argv:
        at = argv.index("--sf")
        sf = argv[at + 1]
        argv = argv[:at] + argv[at + 2 :]
    spark = build_session("compare", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g", "spark.ui.enabled": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    oracles = entry.oracle_sql()
    bad = 0
    for name, fn in entry.queries().items():
        if argv and not any(name == a or name.startswith(a + "_") or name.startswith(a) and a.endswith("_") for a in argv):
            continue
        t0 = time.time()
        try:
            problem = compare(spark, con, name, fn, oracles.get(name), sf)
        except Exception as e:  # noqa: BLE001 - report every failure and go on
            problem = f"{type(e).__name__}: {str(e)[:900]}"
        mark = "ok  " if problem is None else "FAIL"
        bad += problem is not None
        print(f"{mark} {name} {time.time() - t0:.1f}s {'' if name in oracles else '(rows only)'} {problem or ''}", flush=True)
    print(f"{bad} bad")


if __name__ == "__main__":
    main(sys.argv[1:])
