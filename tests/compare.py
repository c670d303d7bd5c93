"""Run queries and oracles side by side: python tests/compare.py [sf] [key ...]."""

import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def oracle(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _sorted_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    picked = [tuple(row[i] for i in order) for row in rows]
    return [columns[i] for i in order], sorted(picked, key=repr)


def difference(df, con, sql):
    """None when names, row count and every value agree exactly."""
    ours = _sorted_rows(df.columns, [tuple(r) for r in df.collect()])
    result = con.execute(sql)
    theirs = _sorted_rows([d[0] for d in result.description], result.fetchall())
    if ours[0] != theirs[0]:
        return f"columns {ours[0]} != {theirs[0]}"
    if len(ours[1]) != len(theirs[1]):
        return f"{len(ours[1])} rows != {len(theirs[1])}"
    wrong = [(a, b) for a, b in zip(ours[1], theirs[1]) if repr(a) != repr(b)]
    return f"{len(wrong)} of {len(ours[1])} rows differ, e.g. {wrong[0]}" if wrong else None


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as driver

    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir = f"/root/testdata/sf{sys.argv[1] if len(sys.argv) > 1 else '0.01'}"
    con, sqls = oracle(sf_dir), driver.oracle_sql()
    wanted = sys.argv[2:] or list(sqls)
    bad = 0
    for key in wanted:
        t = time.time()
        try:
            found = difference(driver.queries()[key](spark, sf_dir), con, sqls[key])
        except Exception as exc:  # report and go on with the next query
            found = f"{type(exc).__name__}: {str(exc)[:600]}"
        bad += found is not None
        print(f"{'ok  ' if found is None else 'FAIL'} {key} {time.time() - t:.1f}s {found or ''}", flush=True)
    print(f"{len(wanted) - bad} of {len(wanted)} agree")
