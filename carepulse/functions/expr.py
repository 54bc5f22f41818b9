"""Column-expression macros.

Each rule is written once, as a Spark SQL expression template (the ``*_sql``
functions, which return text), and offered as a ``Column`` through one
``F.expr`` call. Wide builders (silver, the audit, gold) pass the text to
``selectExpr`` / ``F.expr`` directly: building a projection from SQL text is one
parse on the JVM, while composing the same expression from ``Column`` calls
costs several Python-to-JVM round trips per node, which dominated the driver
time of a 38-column projection. Either way the result is an ordinary Catalyst
expression (no Python UDFs), code-generated and pushed like any built-in.

Operands are column names (quoted here as identifiers) or ``Sql`` expression
text. Semantics are fixed for ANSI Spark 4: every text-to-number conversion is a
``try_cast``, so a malformed cell becomes NULL instead of failing the job (the
audit in ``operators.silver`` counts them), and NaN or infinite results become
NULL too, so they never land in a band or a sum.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
SUPPRESSED = "*"  # the source's marker for a suppressed (small-count) cell
RISK_LOW_BELOW = 1.5
RISK_MEDIUM_BELOW = 3.0
DUAL_LOW_BELOW = 25
DUAL_MEDIUM_BELOW = 50
DUAL_HIGH_BELOW = 75
RURAL_DOMINANT_FROM = 50
RURAL_MIXED_FROM = 20
# --- end of fixed values ----------------------------------------------------

# Exact aggregation: money is summed at 4 decimals and average numerators at 8,
# as fixed-point integers, so the result does not depend on the order rows arrive
# in (double sums differ between runs and partitionings).
MONEY_SCALE = 4
AVG_SCALE = 8
# The same definition written with decimals (used by the SQL oracle).
MONEY_DECIMAL = f"decimal(38,{MONEY_SCALE})"
AVG_DECIMAL = f"decimal(38,{AVG_SCALE})"


class Sql(str):
    """Spark SQL expression text, as opposed to a column name."""


def ident(name: str) -> str:
    """A column name as a quoted SQL identifier."""
    return "`" + name.replace("`", "``") + "`"


def _ref(c: str) -> str:
    if isinstance(c, Sql):
        return f"({c})"
    if isinstance(c, str):
        return ident(c)
    raise TypeError(f"expected a column name or Sql text, got {type(c).__name__}")


def _double(x: float) -> str:
    """A double literal (a bare 1.5 would be a decimal in Spark SQL)."""
    return f"{float(x)!r}D"


def aliased(expr: str, name: str) -> str:
    """``expr AS `name``` for ``selectExpr``."""
    return f"{expr} AS {ident(name)}"


def select_names(df: DataFrame, names: list[str]) -> DataFrame:
    """``df.select(*names)`` as one ``selectExpr`` call (a name at a time costs a
    JVM round trip each)."""
    return df.selectExpr(*[ident(n) for n in names])


def _column(sql_fn: Callable[..., Sql]) -> Callable[..., Column]:
    """The Column form of a SQL template: one ``F.expr`` call."""

    def make(*args, **kwargs) -> Column:
        return F.expr(sql_fn(*args, **kwargs))

    make.__name__ = sql_fn.__name__.removesuffix("_sql")
    make.__doc__ = sql_fn.__doc__
    return make


# ------------------------------------------------------------ scalar rules
def as_text_sql(c: str) -> Sql:
    """Cast to string; works whether the bronze column is text or already numeric."""
    return Sql(f"CAST({_ref(c)} AS STRING)")


def finite_sql(d: str) -> Sql:
    """The double when finite, else NULL (NaN and +-Infinity compare >= Infinity)."""
    x = _ref(d)
    return Sql(f"CASE WHEN abs({x}) < double('Infinity') THEN {x} END")


def try_double_sql(c: str) -> Sql:
    """Text to double as Spark parses numbers; NULL when it does not parse."""
    return Sql(f"try_cast({as_text_sql(c)} AS DOUBLE)")


def to_double_sql(c: str) -> Sql:
    """Text to a finite double; malformed text, NaN and infinities become NULL.

    In a wide projection prefer ``try_double`` in one projection and ``finite``
    in the next (as ``operators.silver`` does): the cast then runs once per cell
    and each column's generated code stays small. Dozens of larger per-column
    expressions fused into one method get too big for the JIT, which cost about
    6x in the silver step.
    """
    return finite_sql(try_double_sql(c))


def to_long_sql(c: str) -> Sql:
    """Text to a whole number, truncating a fraction ('12.7' -> 12, '-12.7' -> -12).

    Through decimal, so '25.0' and '12.7' are counts (a plain bigint cast rejects
    them) and NaN, Infinity and type suffixes are rejected by the decimal parser.
    """
    return Sql(f"try_cast(try_cast({as_text_sql(c)} AS DECIMAL(38,6)) AS BIGINT)")


def pct_sql(c: str) -> Sql:
    """Suppressed marker to NULL, else the number as a finite double.

    The marker does not parse as a number, so it becomes NULL through the same
    cast; the audit counts it apart from malformed text.
    """
    return to_double_sql(c)


def year_date_sql(year: str) -> Sql:
    """January 1 of the year; NULL for NULL or out-of-range years."""
    y = _ref(year)
    return Sql(f"CASE WHEN {y} BETWEEN 1 AND 9999 THEN make_date(CAST({y} AS INT), 1, 1) END")


def safe_div_sql(num: str, den: str) -> Sql:
    """num / den as double; NULL when den is NULL or zero."""
    return Sql(f"try_divide(CAST({_ref(num)} AS DOUBLE), CAST({_ref(den)} AS DOUBLE))")


def kpi_div_sql(num: str, den: str) -> Sql:
    """Dashboard-style ratio: 0 instead of NULL when the denominator is 0 or missing."""
    return Sql(f"coalesce({safe_div_sql(num, den)}, 0.0D)")


# ------------------------------------------------------------ exact sums
# A sum is made of parts: scalar expressions of one cell, each of which is summed on its
# own (by any number of partial aggregates, in any order), and a last expression over the
# summed parts. The gold state table stores summed parts, so sums of further rows can be
# added to them later.
LONG_MIN, LONG_MAX = -(2**63), 2**63 - 1
_LIMB = 22  # bits; limbs of 22, 22 and 20 bits can be summed over 2**41 rows
_UNITS_LOW = 4096


def long_sum_parts(c: str) -> dict[str, Sql]:
    """The limbs of a whole number (the uppermost one is signed)."""
    x, mask = _ref(c), 2**_LIMB - 1
    return {
        "hi": Sql(f"shiftright({x}, {2 * _LIMB})"),
        "mid": Sql(f"shiftright({x}, {_LIMB}) & {mask}L"),
        "lo": Sql(f"{x} & {mask}L"),
    }


def long_sum_of_parts(part: Callable[[str], str]) -> Sql:
    """The exact sum of whole numbers from their summed limbs, as a long; a sum beyond the
    range of a long is the nearest end of that range."""
    hi, mid, lo = (f"CAST({part(p)} AS DECIMAL(20,0))" for p in ("hi", "mid", "lo"))
    total = f"{hi} * {2 ** (2 * _LIMB)}BD + {mid} * {2**_LIMB}BD + {lo}"
    end = f"CASE WHEN ({total}) > 0 THEN {LONG_MAX}L WHEN ({total}) < 0 THEN CAST({LONG_MIN}BD AS BIGINT) END"
    return Sql(f"coalesce(try_cast(({total}) AS BIGINT), {end})")


def wide_sum_long_sql(c: str) -> Sql:
    """Sum of a long column that never overflows: exact where it fits a long, else the
    largest (or smallest) long. NULL over no values, as ``sum``."""
    parts = long_sum_parts(c)
    return long_sum_of_parts(lambda p: f"sum({parts[p]})")


def double_sum_parts(c: str, scale: int = MONEY_SCALE) -> dict[str, Sql]:
    """The parts of a double: the nearest whole number, the rest in ``long`` units of
    10**-scale (in two limbs), and what the rest holds beyond those decimals.

    The last part is 0 unless the rest holds more than the value's own rounding error.
    """
    x = _ref(c)
    unit = _double(10**scale)
    rest = f"({x} - rint({x})) * {unit}"
    units = f"CAST(rint({rest}) AS BIGINT)"
    finer = f"({rest} - rint({rest}))"
    parts = {
        "whole": Sql(f"rint({x})"),
        "units": Sql(units),
        "fine": Sql(f"CASE WHEN abs({finer}) > {unit} * abs({x}) * 2.3E-16D + 1E-9D THEN {finer} ELSE 0.0D END"),
    }
    if scale > MONEY_SCALE:  # sums of wider units are kept in two limbs
        parts["units"] = Sql(f"{units} & {_UNITS_LOW - 1}L")
        parts["tens"] = Sql(f"shiftright({units}, {_UNITS_LOW.bit_length() - 1})")
    return parts


def double_sum_of_parts(part: Callable[[str], str], scale: int = MONEY_SCALE) -> Sql:
    """The sum, as a double, from the summed parts of ``double_sum_parts``."""
    unit = _double(10**scale)
    whole, fine = part("whole"), part("fine")
    units = f"CAST({part('units')} AS DECIMAL(38,0))"
    if scale > MONEY_SCALE:
        units = f"CAST(CAST({part('tens')} AS DECIMAL(20,0)) * {_UNITS_LOW}BD + CAST({part('units')} AS DECIMAL(20,0)) AS DECIMAL(38,0))"
    return Sql(
        f"CASE WHEN abs({whole}) < 9007199254740992D THEN "
        f"CAST(CAST({whole} AS DECIMAL(38,0)) * CAST({10**scale} AS DECIMAL(10,0)) + {units} AS DOUBLE) / {unit} "
        f"ELSE {whole} + CAST({units} AS DOUBLE) / {unit} END + {fine} / {unit}"
    )


def exact_sum_double_sql(c: str, scale: int = MONEY_SCALE) -> Sql:
    """Order-independent sum of a double column, as double; safe for every finite cell.

    Each value is split into its nearest whole number and the (exact) rest. Whole parts
    are summed as doubles, which is exact while the sum stays below 2**53; rests are
    summed as ``long`` units of 10**-scale. What a rest holds beyond ``scale`` decimals
    (more than the value's own rounding error) is summed as a double beside them, so
    finer cells are not rounded away; for cells of at most ``scale`` decimals it is 0
    and the result does not depend on the order of rows. No cell is dropped, and
    none fails the job: beyond 2**53 the sum is a plain double sum.
    """
    parts = double_sum_parts(c, scale)
    return double_sum_of_parts(lambda p: f"sum({parts[p]})", scale)


def exact_avg_sql(c: str, scale: int = AVG_SCALE) -> Sql:
    """Average over non-NULL rows, unweighted, from an exact fixed-point sum."""
    return Sql(f"try_divide({exact_sum_double_sql(c, scale)}, count({_ref(c)}))")


# ------------------------------------------------------------------ bands
def risk_band_sql(score: str) -> Sql:
    s = _ref(score)
    return Sql(
        f"CASE WHEN {s} IS NULL THEN 'UNKNOWN' "
        f"WHEN {s} < {_double(RISK_LOW_BELOW)} THEN 'LOW_RISK' "
        f"WHEN {s} < {_double(RISK_MEDIUM_BELOW)} THEN 'MEDIUM_RISK' "
        "ELSE 'HIGH_RISK' END"
    )


def dual_share_band_sql(share: str) -> Sql:
    s = _ref(share)
    return Sql(
        f"CASE WHEN {s} IS NULL THEN 'UNKNOWN' "
        f"WHEN {s} < {DUAL_LOW_BELOW} THEN 'LOW_DUAL' "
        f"WHEN {s} < {DUAL_MEDIUM_BELOW} THEN 'MEDIUM_DUAL' "
        f"WHEN {s} < {DUAL_HIGH_BELOW} THEN 'HIGH_DUAL' "
        "ELSE 'VERY_HIGH_DUAL' END"
    )


def rural_mix_band_sql(share: str) -> Sql:
    s = _ref(share)
    return Sql(
        f"CASE WHEN {s} IS NULL THEN 'UNKNOWN' "
        f"WHEN {s} >= {RURAL_DOMINANT_FROM} THEN 'RURAL_DOMINANT' "
        f"WHEN {s} >= {RURAL_MIXED_FROM} THEN 'MIXED' "
        "ELSE 'URBAN_DOMINANT' END"
    )


# ------------------------------------------------------------ Column forms
to_double = _column(to_double_sql)
to_long = _column(to_long_sql)
pct = _column(pct_sql)
safe_div = _column(safe_div_sql)
kpi_div = _column(kpi_div_sql)
exact_sum_double = _column(exact_sum_double_sql)
exact_avg = _column(exact_avg_sql)

# band column -> (SQL template, gold input column)
BAND_FUNCTIONS = {
    "risk_band": (risk_band_sql, "avg_bene_risk_score"),
    "dual_share_band": (dual_share_band_sql, "avg_dual_pct"),
    "rural_mix_band": (rural_mix_band_sql, "avg_rural_pct"),
}
