"""Long rolling sums, minima and maxima with a cost per row that does not grow with n.

Spark re-aggregates a sliding frame for every row, so a 252-bar minimum costs 252
updates per bar.  Here the aggregate of the last 4^j bars is made from four shifted
copies of the level below (three ``lag``s in one window operator), and any length is
put together from levels: base-4 digits for a sum, overlapping pieces for min/max.
All series share the levels, i.e. log4(n)+1 window operators on one sort, and the sum
is hierarchical (no running difference, so nothing cancels).  A NULL inside the window
gives NULL, as a full pandas ``rolling(n)`` does.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ts import lag


def _join(op: str, parts: list[Column]) -> Column:
    if len(parts) == 1:
        return parts[0]
    if op == "sum":
        return reduce(lambda a, b: a + b, parts)
    present = reduce(lambda a, b: a & b, [p.isNotNull() for p in parts])
    return F.when(present, F.greatest(*parts) if op == "max" else F.least(*parts))


def _level(n: int) -> int:
    return (n.bit_length() - 1) // 2


def rolling(df: DataFrame, specs: dict[str, tuple[str, str, int]]) -> DataFrame:
    """Add ``{name: (op, column, n)}`` with op one of sum, mean, min, max."""
    want = {k: ("sum" if op == "mean" else op, col, n) for k, (op, col, n) in specs.items()}
    top: dict[tuple[str, str], int] = {}
    for op, col, n in want.values():
        top[(op, col)] = max(top.get((op, col), 0), _level(n))

    def name(op: str, col: str, j: int) -> str:
        return col if j == 0 else f"_{op}_{col}_{j}"

    def at(col: str, offset: int) -> Column:
        return lag(F.col(col), offset) if offset else F.col(col)

    made: list[str] = []
    for j in range(max(top.values())):
        step = {
            name(op, col, j + 1): _join(op, [at(name(op, col, j), i * 4**j) for i in range(4)])
            for (op, col), hi in top.items()
            if hi > j
        }
        df = df.withColumns(step)
        made += step

    out = {}
    for k, (op, col, n) in want.items():
        hi = _level(n)
        parts, offset = [], 0
        if op == "sum":
            for j in range(hi, -1, -1):
                for _ in range(n // 4**j % 4):
                    parts.append(at(name(op, col, j), offset))
                    offset += 4**j
        else:
            size = 4**hi
            offsets = {*range(0, n - size + 1, size), n - size}
            parts = [at(name(op, col, hi), o) for o in sorted(offsets)]
        acc = _join(op, parts)
        out[k] = acc / n if specs[k][0] == "mean" else acc
    return df.withColumns(out).drop(*made)
