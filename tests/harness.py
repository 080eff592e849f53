"""Runs registered queries against their oracles: python -m tests.harness [--sf DIR] [name-prefix ...]"""

from __future__ import annotations

import math
import sys
import time
import traceback

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def oracle_connection(d: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{d}/{t}.parquet')")
    return con


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if hasattr(v, "asDict"):
        return norm(v.asDict())
    if isinstance(v, dict):
        return tuple(sorted((str(k), norm(x)) for k, x in v.items()))
    if type(v).__name__ == "Decimal":
        return float(v)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(norm(r[i]) for i in order) for r in rows]
    return sorted(columns), sorted(out, key=repr)


def compare(spark, con, name, fn, sql, d):
    df = fn(spark, d)
    cols, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    kinds = dict((c, t) for c, t in df.dtypes)
    if sql is None:
        return len(got), None
    rel = con.execute(sql)
    ocols = [x[0] for x in rel.description]
    okinds = {x[0]: str(x[1]) for x in rel.description}
    ecols, want = rows_of(ocols, rel.fetchall())
    if cols != ecols:
        return len(got), f"columns differ: {set(cols) ^ set(ecols)}"
    for c in cols:
        k, o = kinds[c], okinds[c]
        intish = k in ("int", "bigint", "smallint", "tinyint")
        if intish and o not in ("INTEGER", "BIGINT", "SMALLINT", "TINYINT"):
            return len(got), f"type of {c}: {k} vs {o}"
        if k in ("double", "float") and o not in ("DOUBLE", "FLOAT"):
            return len(got), f"type of {c}: {k} vs {o}"
    if len(got) != len(want):
        return len(got), f"rows {len(got)} vs {len(want)}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        g, w = bad[0]
        diff = [(c, a, b) for c, a, b in zip(cols, g, w) if a != b][:4]
        return len(got), f"{len(bad)} rows differ, first: {diff} in {str(g)[:150]}"
    return len(got), None


def main(argv):
    from fintrail.session import get_spark
    import __spark_entry__ as entry
    d = "/root/testdata/sf0.01"
    if "--sf" in argv:
        i = argv.index("--sf")
        d = argv[i + 1]
        argv = argv[:i] + argv[i + 2:]
    spark = get_spark("harness", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
                                                "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = oracle_connection(d)
    sql = entry.oracle_sql()
    failed = 0
    for name, fn in entry.queries().items():
        if argv and not any(name.startswith(p) for p in argv):
            continue
        t = time.time()
        try:
            n, err = compare(spark, con, name, fn, sql.get(name), d)
        except Exception as e:
            n, err = -1, f"{type(e).__name__}: {str(e)[:600]}"
            if "-v" in sys.argv:
                traceback.print_exc()
        failed += err is not None
        mark = "FAIL" if err else ("ok" if name in sql else "rows")
        print(f"{mark:5s}{name:40s}{n:8d} rows {time.time() - t:6.1f}s {err or ''}", flush=True)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    sys.exit(1 if main([a for a in sys.argv[1:] if a != "-v"]) else 0)
