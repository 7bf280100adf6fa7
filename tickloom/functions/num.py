"""Null-safe numeric column helpers.

Missing values are NULL everywhere (never NaN: Spark orders NaN above every
number, so a NaN would silently pass ``>`` tests).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sdiv(a: Column, b: Column) -> Column:
    """a / b, NULL when b is 0 or NULL (ANSI mode would raise)."""
    return F.try_divide(a, b)


def clean(c: Column) -> Column:
    """NaN and infinities become NULL."""
    d = c.cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) != F.lit(float("inf"))), d)


def truth(cond: Column) -> Column:
    """Three-valued predicate to plain boolean: unknown is false."""
    return F.coalesce(cond, F.lit(False))


def flag(cond: Column, points: float = 1) -> Column:
    """``points`` where the condition holds, else 0."""
    return F.when(cond, F.lit(points)).otherwise(F.lit(points * 0))


def bands(value: Column, cuts: list[tuple[float, object]], default: object, op: str = ">=") -> Column:
    """First matching cut wins; ``op`` is one of >=, >, <, <=.  NULL gives ``default``."""
    test = {
        ">=": lambda c: value >= c,
        ">": lambda c: value > c,
        "<": lambda c: value < c,
        "<=": lambda c: value <= c,
    }[op]
    expr = None
    for cut, out in cuts:
        expr = F.when(test(cut), F.lit(out)) if expr is None else expr.when(test(cut), F.lit(out))
    return expr.otherwise(F.lit(default))


def all_present(*cols: Column) -> Column:
    """True when none of the columns is NULL."""
    return reduce(lambda a, b: a & b, [c.isNotNull() for c in cols])


def stacked(*cols: Column) -> Column:
    """cols[0] > cols[1] > cols[2] ... (NULL if any is NULL and none is already false)."""
    return reduce(lambda a, b: a & b, [x > y for x, y in zip(cols, cols[1:])])


def clip(c: Column, lo: float, hi: float) -> Column:
    return F.when(c.isNotNull(), F.greatest(F.lit(lo), F.least(F.lit(hi), c)))


class _Columns:
    """``c.close`` is ``F.col("close")``, resolved when used (no session needed at import)."""

    def __getattr__(self, name: str) -> Column:
        return F.col(name)


c = _Columns()


def rnd(x: Column | str, digits: int = 4) -> Column:
    """Round half away from zero in double arithmetic (no decimal conversion per row)."""
    x = F.col(x) if isinstance(x, str) else x
    scale = 10.0**digits
    return F.signum(x) * F.floor(F.abs(x) * scale + 0.5) / scale


def money(x: Column | str) -> Column:
    """Two-decimal text, rounded as :func:`rnd` does."""
    return F.format_string("%.2f", rnd(x, 2))


def evaluated(df: DataFrame) -> DataFrame:
    """Compute the columns once before later steps read them.

    Without it the optimizer substitutes long label expressions into every later use,
    which multiplies work and plan size.  A one-row ``inline`` per row stops that and
    moves no data.
    """
    return df.select(F.inline(F.array(F.struct(*df.columns))))
