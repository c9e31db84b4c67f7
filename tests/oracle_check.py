"""Compare registered queries with their SQL statements run by DuckDB on the same files."""

from __future__ import annotations

import datetime
import math
import sys
import time
from collections import Counter
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, (bytes, bytearray)):
        return bytes(value).hex()
    if hasattr(value, "as_tuple"):
        return int(value) if value == value.to_integral_value() else round(float(value), 9)
    return value


def connect(sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def compare(spark, con, sf_dir, query, sql):
    """Returns (rows, problem or None)."""
    df = query(spark, sf_dir)
    names = sorted(df.columns)
    got = Counter(tuple(plain(r[n]) for n in names) for r in df.collect())
    cur = con.execute(sql)
    columns = [d[0] for d in cur.description]
    if sorted(columns) != names:
        return sum(got.values()), f"columns {names} against {sorted(columns)}"
    position = [columns.index(n) for n in names]
    want = Counter(tuple(plain(r[i]) for i in position) for r in cur.fetchall())
    if got != want:
        extra, missing = got - want, want - got
        return sum(got.values()), (
            f"{sum(got.values())} rows against {sum(want.values())}; only Spark {list(extra.items())[:2]}; "
            f"only SQL {list(missing.items())[:2]} columns {names}"
        )
    return sum(got.values()), None


def main():
    import __spark_entry__ as entry

    from fleetrisk.session import build_session

    sf_dir = sys.argv[1]
    wanted = sys.argv[2:]
    spark = build_session("8", 8)
    con = connect(sf_dir)
    oracles = entry.oracle_sql()
    bad = 0
    for name, query in entry.queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            if name in oracles:
                rows, problem = compare(spark, con, sf_dir, query, oracles[name])
            else:
                rows, problem = len(query(spark, sf_dir).collect()), None
        except Exception as error:  # report and go on
            rows, problem = -1, f"{type(error).__name__}: {str(error)[:1500]}"
        bad += problem is not None
        mark = "ok" if problem is None else "BAD"
        print(f"{mark:4}{name:28}{rows:8} rows {time.time() - start:6.2f}s {'' if name in oracles else '(no SQL)'} {problem or ''}")
    print("bad:", bad)


if __name__ == "__main__":
    main()
