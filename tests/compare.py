"""Run queries next to their SQL on one data folder and compare rows exactly (types included)."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(value: object) -> object:
    if isinstance(value, float) and math.isnan(value):
        return "NaN"
    return value


def _sorted(rows: list[tuple], order: list[int]) -> list[tuple]:
    return sorted((tuple(_plain(row[i]) for i in order) for row in rows), key=repr)


def difference(spark, sf_dir: str, query, sql: str) -> str | None:
    """None if both give the same rows, else a short description."""
    df = query(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    result = connect(sf_dir).execute(sql)
    names = [d[0] for d in result.description]
    want = result.fetchall()
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} vs {sorted(names)}"
    got = _sorted(got, [df.columns.index(c) for c in sorted(names)])
    want = _sorted(want, [names.index(c) for c in sorted(names)])
    if len(got) != len(want):
        return f"{len(got)} rows vs {len(want)}; {[g for g in got if g not in want[:2000]][:2]} | {[w for w in want if w not in got[:2000]][:2]}"
    bad = [(g, w) for g, w in zip(got, want, strict=True) if repr(g) != repr(w)]
    if bad:
        return f"{len(bad)} of {len(got)} rows differ over {sorted(names)}, first: {bad[0]}"
    return None if got else "no rows"


def main() -> None:
    from __spark_entry__ import oracle_sql, queries
    from corpusgauge.caching import release
    from corpusgauge.session import local_session

    sf_dir = sys.argv[1]
    wanted = sys.argv[2:]
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    oracles = oracle_sql()
    failed = []
    for name, query in queries().items():
        if wanted and name not in wanted:
            continue
        start = time.time()
        try:
            if name in oracles:
                diff = difference(spark, sf_dir, query, oracles[name])
            else:
                n = query(spark, sf_dir).count()
                diff = None if n else "no rows"
        except Exception as exc:  # report and go on
            diff = f"{type(exc).__name__}: {str(exc)[:700]}"
        release()
        mark = "ok  " if diff is None else "FAIL"
        if diff:
            failed.append(name)
        print(f"{mark} {time.time() - start:6.1f}s {'sql ' if name in oracles else 'rows'} {name} {diff or ''}", flush=True)
    print("failed:", failed)


if __name__ == "__main__":
    main()
