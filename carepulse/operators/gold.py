"""Silver -> gold: provider-year metrics and state-year summary.

Both are one filter + one ``groupBy`` (partial aggregation map-side, so a hot key
is combined before the shuffle) + one projection of ratios and bands. Averages
are unweighted over rows; beneficiary sums double-count people seen by several
providers, as in the source definition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..contracts import (
    GOLD_PROVIDER_BANDS,
    GOLD_PROVIDER_KEYS,
    GOLD_PROVIDER_MEASURES,
    GOLD_PROVIDER_RATIOS,
    GOLD_STATE_KEYS,
    GOLD_STATE_MEASURES,
    GOLD_STATE_RATIOS,
    gold_provider_schema,
)
from ..functions.expr import (
    AVG_SCALE,
    BAND_FUNCTIONS,
    MONEY_SCALE,
    aliased,
    double_sum_of_parts,
    double_sum_parts,
    exact_avg_sql,
    exact_sum_double_sql,
    ident,
    long_sum_of_parts,
    long_sum_parts,
    safe_div_sql,
    wide_sum_long_sql,
)
from .silver import provider_level


def measure_sql(kind: str, source: str) -> str:
    if kind == "sum_long":
        return wide_sum_long_sql(source)
    if kind == "sum_money":
        return exact_sum_double_sql(source)
    if kind == "avg":
        return exact_avg_sql(source)
    raise ValueError(kind)


def _aggregate(silver: DataFrame, keys: list[str], measures) -> DataFrame:
    return (
        provider_level(silver)
        .groupBy(*keys)
        .agg(*[F.expr(aliased(measure_sql(kind, src), out)) for out, kind, src in measures])
    )


def gold_provider_base(silver: DataFrame) -> DataFrame:
    """7 keys, 3 long sums, 4 money sums, 9 averages."""
    return _aggregate(silver, GOLD_PROVIDER_KEYS, GOLD_PROVIDER_MEASURES)


def add_ratios(df: DataFrame, ratios) -> DataFrame:
    return df.selectExpr("*", *[aliased(safe_div_sql(num, den), out) for out, num, den in ratios])


def add_bands(df: DataFrame) -> DataFrame:
    bands = [aliased(BAND_FUNCTIONS[b][0](BAND_FUNCTIONS[b][1]), b) for b in GOLD_PROVIDER_BANDS]
    return df.selectExpr("*", *bands)


def build_gold_provider(silver: DataFrame) -> DataFrame:
    """The 33-column provider_year_metrics table."""
    return add_bands(add_ratios(gold_provider_base(silver), GOLD_PROVIDER_RATIOS))


def build_gold_state(silver: DataFrame) -> DataFrame:
    """The 15-column state_year_summary table, from silver (not from gold provider)."""
    return add_ratios(_aggregate(silver, GOLD_STATE_KEYS, GOLD_STATE_MEASURES), GOLD_STATE_RATIOS)


# ------------------------------------------------------------- mergeable state
# The gold state holds, for each key of the provider table, the summed parts of every
# measure and the number of rows. States of disjoint sets of silver rows add up to the
# state of all of them; both gold tables are finished from it without reading silver.
N_ROWS = "n_rows"


def _parts(kind: str, source: str) -> dict[str, str]:
    """Part name -> aggregate over silver rows."""
    if kind == "sum_long":
        return {p: f"sum({x})" for p, x in long_sum_parts(source).items()}
    parts = {p: f"sum({x})" for p, x in double_sum_parts(source, AVG_SCALE if kind == "avg" else MONEY_SCALE).items()}
    return parts | {"count": f"count({ident(source)})"} if kind == "avg" else parts


def _part_column(measure: str, part: str) -> str:
    return f"{measure}__{part}"


def _state_columns() -> list[str]:
    return [N_ROWS] + [_part_column(out, p) for out, kind, src in GOLD_PROVIDER_MEASURES for p in _parts(kind, src)]


def gold_parts_schema() -> T.StructType:
    """Provider keys, the number of rows and the summed parts, as the job stores them."""
    doubles = ("whole", "fine")
    parts = [(_part_column(out, p), T.DoubleType() if p in doubles else T.LongType()) for out, kind, src in GOLD_PROVIDER_MEASURES for p in _parts(kind, src)]
    keys = [f for f in gold_provider_schema().fields if f.name in GOLD_PROVIDER_KEYS]
    return T.StructType(keys + [T.StructField(N_ROWS, T.LongType())] + [T.StructField(n, t) for n, t in parts])


def gold_state_parts(silver: DataFrame) -> DataFrame:
    """The mergeable state of the provider-level rows of ``silver``, by the provider table's keys."""
    parts = [aliased(x, _part_column(out, p)) for out, kind, src in GOLD_PROVIDER_MEASURES for p, x in _parts(kind, src).items()]
    return provider_level(silver).groupBy(*GOLD_PROVIDER_KEYS).agg(F.expr(aliased("count(1)", N_ROWS)), *[F.expr(x) for x in parts])


def merge_gold_states(states: DataFrame, keys: list[str] = GOLD_PROVIDER_KEYS) -> DataFrame:
    """The state by ``keys`` of all rows behind ``states`` (a union of states, or one to roll up)."""
    return states.groupBy(*keys).agg(*[F.expr(aliased(f"sum({ident(c)})", c)) for c in _state_columns()])


def _finished(state: DataFrame, keys: list[str], measures) -> DataFrame:
    """Measures from the state's parts. A measure is found by its silver column, so the
    state-year table finishes from the parts of the provider table's measures."""
    held = {(kind, src): out for out, kind, src in GOLD_PROVIDER_MEASURES}

    def value(kind: str, source: str) -> str:
        def part(p: str) -> str:
            return ident(_part_column(held[kind, source], p))

        if kind == "sum_long":
            return long_sum_of_parts(part)
        if kind == "sum_money":
            return double_sum_of_parts(part)
        return f"try_divide({double_sum_of_parts(part, AVG_SCALE)}, {part('count')})"

    return state.selectExpr(*[ident(k) for k in keys], *[aliased(value(kind, src), out) for out, kind, src in measures])


def finish_gold_provider(state: DataFrame) -> DataFrame:
    """The provider_year_metrics table from a merged state: one projection, no shuffle."""
    return add_bands(add_ratios(_finished(state, GOLD_PROVIDER_KEYS, GOLD_PROVIDER_MEASURES), GOLD_PROVIDER_RATIOS))


def finish_gold_state(state: DataFrame) -> DataFrame:
    """The state_year_summary table, rolled up from the provider table's state."""
    rolled = merge_gold_states(state, GOLD_STATE_KEYS)
    return add_ratios(_finished(rolled, GOLD_STATE_KEYS, GOLD_STATE_MEASURES), GOLD_STATE_RATIOS)
