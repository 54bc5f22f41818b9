"""Connected components of a link table, by alternating large-star and small-star rounds.

Every round rewires each node to the smallest neighbour it knows, by joins and
pre-aggregated minima; the tables between rounds are reliable checkpoints, so every
join sits on two plain exchanges and a node with very many links is split by the
adaptive skew join. Nothing is collected but one count and checksum per round.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _forest(batches):
    """Spanning stars of the links one task holds: (node, smallest node it knows to reach)."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        top = x
        while root.setdefault(top, top) != top:
            top = root[top]
        while root[x] != top:
            root[x], x = top, root[x]
        return top

    for b in batches:
        for x, y in zip(b["a"].tolist(), b["b"].tolist()):
            x, y = find(x), find(y)
            if x != y:
                root[max(x, y)] = min(x, y)
    out = [(x, find(x)) for x in list(root) if find(x) != x]
    yield pd.DataFrame(out, columns=["a", "b"], dtype="int64")


def _mark(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def connected_components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every linked node; root is the smallest node reachable.

    ``links`` holds pairs of longs in any order, repeats and self-links allowed; pairs
    with a null end are ignored. An empty table gives no rows.
    """
    e = links.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a <> b")
    e = cut(e.mapInPandas(_forest, "a long, b long").distinct())
    seen = _mark(e)
    while seen[0]:
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = cut(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m")))
        large = both.join(least, both["a"] == least["k"]).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = cut(large.distinct())
        least = cut(large.groupBy(F.col("a").alias("k")).agg(F.min("b").alias("m")))
        pairs = F.explode(F.array(F.struct(F.col("b").alias("x"), F.col("m").alias("y")), F.struct(F.col("a").alias("x"), F.col("m").alias("y"))))
        small = large.join(least, large["a"] == least["k"]).select(pairs.alias("p")).select(F.col("p.x").alias("a"), F.col("p.y").alias("b"))
        e = cut(small.where("a <> b").distinct())
        now = _mark(e)
        if now == seen:
            break
        seen = now
    roots = e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
