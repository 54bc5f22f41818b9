"""Compare every registered query with its DuckDB statement at one scale.

    python -m carepulse.plans.check /root/testdata/sf0.01 [query ...]

The same check the tests run at sf0.001, for any test-table folder: each query's
rows against DuckDB's over the same Parquet files, compared in Spark as bags (EXCEPT
ALL both ways), with DuckDB's result written to a local folder: a tool for one machine. Prints one line per query
and exits non-zero on any mismatch.
"""

from __future__ import annotations

import os
import sys
import tempfile
import time

from pyspark.sql import functions as F

from ..functions.expr import ident

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def main(argv: list[str] | None = None) -> int:
    import duckdb

    from pyspark.sql import SparkSession

    from ..session import local_session
    from .catalog import QUERIES, oracle_statements

    args = sys.argv[1:] if argv is None else argv
    sf_dir, only = args[0].rstrip("/"), set(args[1:])
    joined = SparkSession.getActiveSession()
    spark = joined or local_session(app="carepulse-check")
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    sql = oracle_statements()
    folder = tempfile.mkdtemp(prefix="carepulse-check-")
    bad = 0
    for name, fn in QUERIES.items():
        if only and name not in only:
            continue
        t0 = time.perf_counter()
        got = fn(spark, sf_dir).persist()
        rows = got.count()
        secs = time.perf_counter() - t0
        path = f"{folder}/{name}.parquet"
        con.execute(f"COPY ({sql[name]}) TO '{path}' (FORMAT parquet)")
        want = spark.read.parquet(path)
        same = sorted(got.columns) == sorted(want.columns) and want.count() == rows
        if same:
            # Row by row in Spark, repeats counted; nothing but a few differing rows comes back.
            want = want.select([F.col(ident(f.name)).cast(f.dataType).alias(f.name) for f in got.schema.fields])
            differ = got.exceptAll(want).union(want.exceptAll(got)).limit(5).collect()
            same = not differ
            for row in differ:
                print("  differs:", row)
        got.unpersist()
        bad += not same
        print(f"{name:28s} {'OK ' if same else 'BAD'} rows={rows} spark={secs:.2f}s")
    print(f"mismatches: {bad}")
    if joined is None:  # stop only a session this tool started
        spark.stop()
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main())
