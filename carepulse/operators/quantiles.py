"""Exact per-group quantiles without gathering a group into one task.

Spark's ``percentile`` aggregate merges a value->count map per group in a single
task, which breaks when one group holds a large share of the rows. Here:

1. range-partition by (group keys, value, unique tie-breaker) and sort inside
   each partition. Spark samples the keys to pick the bounds, so a hot group, and
   even a long run of one repeated value, spreads over many tasks;
2. ``monotonically_increasing_id`` then numbers rows inside each partition in
   sorted order; the frame is checkpointed so those numbers are fixed;
3. a small table of (partition, group) row counts, with a running sum over the
   partitions of each group, gives every row its exact rank in its group;
4. only the rows at the ranks the quantiles need are kept, and one aggregate
   interpolates them (linear, as ``percentile`` / ``quantile_cont``).

Step 3's table has at most (#partitions + #groups) rows: each partition holds a
contiguous range of groups.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import ident
from ..session import checkpoint_root


def _keys(keys: list[str]) -> list[str]:
    return [ident(k) for k in keys]


def _null_safe_equal(keys: list[str], side: dict[str, str]):
    """Join condition: each key equal, NULL matching NULL (NULL keys form a group)."""
    return F.expr(" AND ".join(f"{ident(k)} <=> {ident(side[k])}" for k in keys))


def _cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder: computed once, joined as AQE sees fit."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)


def ordered_values(df: DataFrame, keys: list[str], value: str, n_partitions: int | None = None) -> DataFrame:
    """Non-NULL values range-partitioned by (keys, value), sorted in each partition,
    numbered in that order, and checkpointed to the shared folder.

    A unique tie-breaker joins the range key, so even a run of identical
    (group, value) pairs (say, a third of all rows equal to 0) is cut into
    several partitions instead of landing in one task. Without ``n_partitions`` the
    number of partitions is AQE's choice.
    """
    bounds = [n_partitions] if n_partitions else []
    return _cut(
        df.selectExpr(*_keys(keys), f"CAST({ident(value)} AS DOUBLE) AS _v", "monotonically_increasing_id() AS _tie")
        .where("_v IS NOT NULL")
        .repartitionByRange(*bounds, *keys, "_v", "_tie")
        .sortWithinPartitions(*keys, "_v", "_tie")
        .selectExpr(*_keys(keys), "_v", "spark_partition_id() AS _pid", "monotonically_increasing_id() AS _mid")
    )


def ranked_values(ordered: DataFrame, keys: list[str]) -> DataFrame:
    """Rows (keys, _v, _rank, _n): each of the ``ordered_values`` with its 0-based rank in its group."""
    counts = ordered.groupBy("_pid", *keys).agg(F.expr("count(1) AS _cnt"), F.expr("min(_mid) AS _first"))
    side = {k: f"_k{i}" for i, k in enumerate(keys)}
    group = ", ".join(_keys(keys))
    counts = counts.selectExpr(
        "_pid AS _cpid",
        *[f"{ident(k)} AS {ident(side[k])}" for k in keys],
        "_first",
        f"coalesce(sum(_cnt) OVER (PARTITION BY {group} ORDER BY _pid "
        "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS _offset",
        f"sum(_cnt) OVER (PARTITION BY {group}) AS _n",
    )
    cond = F.expr("_pid = _cpid") & _null_safe_equal(keys, side)
    joined = ordered.join(_cut(counts), cond)
    return joined.selectExpr(*_keys(keys), "_v", "_offset + _mid - _first AS _rank", "_n")


def exact_quantiles(
    df: DataFrame,
    keys: list[str],
    value: str,
    probs: dict[str, float],
    n_partitions: int | None = None,
) -> DataFrame:
    """One row per group: keys, n, min, max and one column per entry of ``probs``."""
    return quantiles_of(ordered_values(df, keys, value, n_partitions), keys, probs)


def quantiles_of(ordered: DataFrame, keys: list[str], probs: dict[str, float]) -> DataFrame:
    """``exact_quantiles`` over values that ``ordered_values`` has numbered."""
    r = ranked_values(ordered, keys)
    pos = {name: f"({float(p)!r}D * (_n - 1))" for name, p in probs.items()}
    lo = {name: f"floor({x})" for name, x in pos.items()}
    hi = {name: f"ceil({x})" for name, x in pos.items()}
    wanted = ["0", "_n - 1", *lo.values(), *hi.values()]
    keep = r.where(" OR ".join(f"_rank = {w}" for w in wanted))
    aggs = ["max(_n) AS n", "max(CASE WHEN _rank = 0 THEN _v END) AS min"]
    for name in probs:
        aggs += [
            f"max(CASE WHEN _rank = {lo[name]} THEN _v END) AS _{name}_lo",
            f"max(CASE WHEN _rank = {hi[name]} THEN _v END) AS _{name}_hi",
            f"max({pos[name]} - {lo[name]}) AS _{name}_frac",
        ]
    aggs.append("max(CASE WHEN _rank = _n - 1 THEN _v END) AS max")
    g = keep.groupBy(*keys).agg(*[F.expr(a) for a in aggs])
    out = [*_keys(keys), "n", "min"]
    for name in probs:
        out.append(f"_{name}_lo + (_{name}_hi - _{name}_lo) * _{name}_frac AS {ident(name)}")
    out.append("max")
    return g.selectExpr(*out)


def box_summary(df: DataFrame, keys: list[str], value: str, whisker: float = 1.5) -> DataFrame:
    """Box-plot numbers per group: quartiles, whiskers (last point within
    ``whisker`` x IQR of the box) and the count of points beyond them."""
    ordered = ordered_values(df, keys, value)
    quart = quantiles_of(ordered, keys, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    # The quartiles ride along with the fences, so no join back is needed at the end.
    side = {k: f"_k{i}" for i, k in enumerate(keys)}
    stats = ["n", "min", "q1", "median", "q3", "max"]
    fences = quart.selectExpr(
        *[f"{ident(k)} AS {ident(side[k])}" for k in keys],
        *[f"{ident(c)} AS _s_{c}" for c in stats],
        f"q1 - {float(whisker)!r}D * (q3 - q1) AS _lf",
        f"q3 + {float(whisker)!r}D * (q3 - q1) AS _uf",
    )
    # The input is not read again: the whiskers come from the numbered values.
    j = ordered.join(fences, _null_safe_equal(keys, side))
    inside = "(_v >= _lf AND _v <= _uf)"
    return j.groupBy(*keys).agg(
        *[F.expr(f"max(_s_{c}) AS {ident(c)}") for c in stats],
        F.expr(f"min(CASE WHEN {inside} THEN _v END) AS lower_whisker"),
        F.expr(f"max(CASE WHEN {inside} THEN _v END) AS upper_whisker"),
        F.expr(f"count_if(NOT {inside}) AS n_outliers"),
    )
