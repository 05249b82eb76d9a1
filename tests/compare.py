"""Side-by-side check of the registered queries against their SQL in DuckDB."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _value(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 6)
    if isinstance(x, bool) or x is None or isinstance(x, (int, str)):
        return x
    return str(x)


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(
        (tuple(_value(r[i]) for i in order) for r in rows), key=lambda r: tuple(map(repr, r))
    )


def difference(spark, con, name, query, sql, sf_dir) -> str | None:
    """None when both agree, else a short account of the first difference."""
    df = query(spark, sf_dir)
    mine = _rows(df.columns, [tuple(r) for r in df.collect()])
    cursor = con.execute(sql)
    columns = [d[0] for d in cursor.description]
    theirs = _rows(columns, cursor.fetchall())
    if sorted(df.columns) != sorted(columns):
        return f"columns {sorted(df.columns)} / {sorted(columns)}"
    if len(mine) != len(theirs):
        extra = [r for r in mine if r not in set(theirs)][:1], [r for r in theirs if r not in set(mine)][:1]
        return f"rows {len(mine)} / {len(theirs)}: {str(extra)[:600]}"
    for a, b in zip(mine, theirs):
        if a != b:
            return f"{str(a)[:500]}\n   / {str(b)[:500]}"
    return None


if __name__ == "__main__":
    from __spark_entry__ import oracle_sql, queries

    from codecairn.session import get_spark

    sf_dir = sys.argv[1]
    wanted = sys.argv[2:]
    spark = get_spark(
        master="local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
           "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"},
    )
    spark.sparkContext.setLogLevel("OFF")
    con, sqls, bad = connect(sf_dir), oracle_sql(), 0
    for name, query in queries().items():
        if wanted and name not in wanted:
            continue
        start = time.time()
        try:
            if name in sqls:
                found = difference(spark, con, name, query, sqls[name], sf_dir)
            else:
                found = None if query(spark, sf_dir).count() >= 0 else "no rows"
        except Exception as exc:  # noqa: BLE001
            found = f"{type(exc).__name__}: {str(exc)[:700]}"
        bad += found is not None
        print(f"{'ok ' if found is None else 'BAD'} {name} {time.time() - start:.1f}s {found or ''}", flush=True)
    print("different:", bad)
