"""Run queries against their SQL in DuckDB: python tests/oracle.py [sf] [query ...]"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
SAME_TYPE = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
}


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _normal(rows):
    def cell(v):
        if isinstance(v, float):
            return (1, "nan") if v != v else (1, v + 0.0)
        return (0, "") if v is None else (1, v)

    return sorted((tuple(cell(v) for v in r) for r in rows), key=repr)


def compare(spark, con, name, query, sql, sf_dir) -> str | None:
    """None when schema and rows agree, else what differs."""
    df = query(spark, sf_dir)
    columns = sorted(df.columns)
    types = dict(df.dtypes)
    got = _normal(df.select(*[f"`{c}`" for c in columns]).collect())
    rel = con.sql(sql)
    if sorted(rel.columns) != columns:
        return f"columns {columns} against {sorted(rel.columns)}"
    wanted_types = dict(zip(rel.columns, map(str, rel.types)))
    bad = {c: (types[c], wanted_types[c]) for c in columns if SAME_TYPE.get(types[c]) != wanted_types[c]}
    order = ", ".join(f'"{c}"' for c in columns)
    want = _normal(con.sql(f"SELECT {order} FROM ({sql}) q").fetchall())
    if len(got) != len(want):
        return f"rows {len(got)} against {len(want)}"
    if got != want:
        pairs = [(g, w) for g, w in zip(got, want) if g != w]
        return f"{len(pairs)} of {len(got)} rows differ, e.g. {pairs[0]}"
    if not got:
        return "no rows"
    return f"types {bad}" if bad else None


def main(argv):
    from __spark_entry__ import oracle_sql, queries
    from panelwright.session import local_session

    sf = argv[0] if argv else "sf0.01"
    sf_dir = f"/root/testdata/{sf}"
    spark, con = local_session(), connect(sf_dir)
    sqls, failed = oracle_sql(), []
    for name, query in queries().items():
        if argv[1:] and not any(a in name for a in argv[1:]):
            continue
        began = time.time()
        try:
            if name in sqls:
                problem = compare(spark, con, name, query, sqls[name], sf_dir)
            else:
                rows = query(spark, sf_dir).collect()
                problem = None if rows else "no rows"
                if argv[1:]:
                    print(*rows[:60], sep="\n")
        except Exception as e:  # report every query, then fail
            problem = f"{type(e).__name__}: {str(e)[:1500]}"
        note = "ok" if problem is None else "FAIL " + problem
        print(f"{name:32s} {'S' if name in sqls else '-'} {time.time() - began:6.2f}s {note}", flush=True)
        if problem:
            failed.append(name)
    print(f"{len(failed)} failed: {failed}")
    spark.stop()
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
