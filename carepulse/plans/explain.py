"""Print the physical plan of registered queries, and a one-line summary of each.

    python -m carepulse.plans.explain /root/testdata/sf0.01 [query ...] [--full]

The summary counts the operators that matter at scale (exchanges, joins by
strategy, aggregates, window limits) and lists the scans' pushed filters, so a
regression (a lost pushdown, a sort-merge join that should not be there) is
visible at a glance.
"""

from __future__ import annotations

import argparse
import contextlib
import io
import re
from collections import Counter

from pyspark.sql import DataFrame

from ..session import local_session
from .catalog import QUERIES

_NODES = (
    "Exchange",
    "BroadcastExchange",
    "SortMergeJoin",
    "BroadcastHashJoin",
    "ShuffledHashJoin",
    "BroadcastNestedLoopJoin",
    "CartesianProduct",
    "HashAggregate",
    "SortAggregate",
    "ObjectHashAggregate",
    "WindowGroupLimit",
    "Window",
    "TakeOrderedAndProject",
    "Generate",
)


def formatted_plan(df: DataFrame) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode="formatted")
    return buf.getvalue()


def summary(plan: str) -> dict:
    tree = plan.split("\n\n")[0]
    names = re.findall(r"([A-Za-z]+) \(\d+\)", tree)
    counts = Counter(n for n in names if n in _NODES)
    pushed = sorted({m for m in re.findall(r"PushedFilters: \[(.*?)\]", plan) if m})
    partition = sorted({m for m in re.findall(r"PartitionFilters: \[(.*?)\]", plan) if m})
    return {"operators": dict(counts), "pushed_filters": pushed, "partition_filters": partition}


def main(argv: list[str] | None = None) -> None:
    ap = argparse.ArgumentParser(description=__doc__)
    ap.add_argument("sf_dir")
    ap.add_argument("queries", nargs="*")
    ap.add_argument("--full", action="store_true", help="print the whole formatted plan")
    args = ap.parse_args(argv)
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    for name in args.queries or list(QUERIES):
        plan = formatted_plan(QUERIES[name](spark, args.sf_dir))
        print(f"{name}: {summary(plan)}")
        if args.full:
            print(plan)


if __name__ == "__main__":
    main()
