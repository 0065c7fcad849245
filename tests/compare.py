"""Run a registered query and its SQL on the same files and compare the rows."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    if value is not None and not isinstance(value, (int, str, bool)):
        return str(value)
    return value


def _sorted_rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    plain = [tuple(_plain(r[i]) for i in order) for r in rows]
    return [names[i] for i in order], sorted(plain, key=repr)


def sql_rows(folder: str, sql: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    return _sorted_rows(names, cursor.fetchall())


def spark_rows(df):
    return _sorted_rows(df.columns, [tuple(r) for r in df.collect()])


def differences(df, folder: str, sql: str) -> list[str]:
    """Empty when both sides agree."""
    names, ours = spark_rows(df)
    sql_names, theirs = sql_rows(folder, sql)
    if names != sql_names:
        return [f"columns {names} != {sql_names}"]
    found = []
    if len(ours) != len(theirs):
        found.append(f"rows {len(ours)} != {len(theirs)}")
    wrong = [(a, b) for a, b in zip(ours, theirs) if a != b]
    if wrong:
        found.append(f"{len(wrong)} rows differ, first: {str(wrong[0])[:600]}")
    return found


def main(argv):
    import __spark_entry__ as entry
    from stallbook.session import local_session

    folder = argv[0]
    wanted = set(argv[1:])
    spark = local_session(8)
    sqls = entry.oracle_sql()
    for name, build in entry.queries().items():
        if wanted and name not in wanted:
            continue
        started = time.time()
        try:
            df = build(spark, folder)
            if name in sqls:
                found = differences(df, folder, sqls[name])
                state = "ok" if not found else "DIFF " + "; ".join(found)
                state += f" rows={len(df.head(1)) and df.count()}" if not found else ""
            else:
                state = f"rows-only {len(df.collect())}"
        except Exception as error:  # report and go on with the next query
            state = f"ERROR {type(error).__name__}: {str(error)[:900]}"
        print(f"{name:28s} {time.time() - started:6.1f}s {state}", flush=True)


if __name__ == "__main__":
    main(sys.argv[1:])
