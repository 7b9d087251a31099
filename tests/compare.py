"""Run registered queries against their check SQL: ``python tests/compare.py [sf] [name ...]``."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _key(v):
    if v is None:
        return "~"
    if isinstance(v, float):
        return "~" if v != v else f"{v:.9g}"
    return str(v)


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(_key(r[i]) for i in order) for r in rows)


def compare(df, con, sql: str) -> str | None:
    """None when equal, else a short text on the first difference."""
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    want = rel.fetchall()
    got = [tuple(r) for r in df.collect()]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    types = {d[0]: str(d[1]).upper() for d in rel.description}
    kinds = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    odd = [(c, t, types[c]) for c, t in df.dtypes if kinds.get(t, t).upper() != types[c]]
    a, b = rows_of(df.columns, got), rows_of(names, want)
    if a != b:
        sa, sb = set(a), set(b)
        return f"{len(a)} rows vs {len(b)}; only spark {sorted(sa - sb)[:2]}; only sql {sorted(sb - sa)[:2]}"
    return f"TYPES {odd}" if odd else None


def main(argv):
    from keystead.session import build_session
    import __spark_entry__ as entry

    sf = argv[0] if argv else "0.01"
    sf_dir = f"/root/testdata/sf{sf}"
    spark = build_session("compare", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "12g",
        "spark.ui.showConsoleProgress": "false",
    })
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    sqls = entry.oracle_sql()
    bad = 0
    for name, fn in entry.queries().items():
        if argv[1:] and not any(name.startswith(p) for p in argv[1:]):
            continue
        t = time.time()
        try:
            df = fn(spark, sf_dir)
            if name in sqls:
                diff = compare(df, con, sqls[name])
            else:
                diff = None
                n = df.count()
            text = "ok" if diff is None else diff
            if name not in sqls:
                text = f"ok rows-only {n}"
        except Exception as exc:
            text = f"ERROR {type(exc).__name__}: {str(exc)[:700]}"
        bad += not text.startswith("ok")
        print(f"{name:34s} {time.time() - t:6.2f}s {text}", flush=True)
    print("bad:", bad)
    spark.stop()
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
