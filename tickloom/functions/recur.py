"""First-order recursive smoothing, y[t] = r*y[t-1] + u[t], as window functions.

A recursion looks sequential, but it is a decayed running sum, and a decayed
running sum splits into blocks:

* inside a block of B rows:  L = r^k * sum(u * r^-k)   (k = row within the block)
* between blocks:            y = L + r^(k+1) * carry,  carry = fold of the previous
  block ends, carry' = r^B * carry + L_end

so each stage is two running windows on one sort order, all in the JVM, linear in
the number of rows.  The block keeps r^-k far from overflow (r >= 0.3, B = 512).
The list of block ends seen by a row has (bars of the symbol)/512 entries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import ts

BLOCK = 512


def with_blocks(df: DataFrame) -> DataFrame:
    """Add the bar number and its block, by which :func:`decay_sums` sorts."""
    return ts.position(df).withColumn("_blk", F.floor(F.col("bn") / BLOCK).cast("int"))


def in_blocks(key: str = "symbol"):
    """The order of bars by block, which is that by date: windows on it share the sort of :func:`decay_sums`."""
    return W.partitionBy(key).orderBy("_blk", "bn")


def decay_sums(df: DataFrame, specs: dict[str, tuple[Column, float]], key: str = "symbol") -> DataFrame:
    """For each ``name: (u, r)`` add y[t] = r*y[t-1] + u[t] with y[-1] = 0; NULL inputs count as 0.

    All series of one call share the two windows.
    """
    inside = W.partitionBy(key, "_blk").orderBy("bn").rowsBetween(W.unboundedPreceding, 0)
    before = in_blocks(key).rowsBetween(W.unboundedPreceding, -1)
    k = (F.col("bn") % BLOCK).cast("double")
    local = {
        f"_l_{n}": F.pow(F.lit(r), k) * F.sum(F.coalesce(u, F.lit(0.0)) * F.pow(F.lit(r), -k)).over(inside)
        for n, (u, r) in specs.items()
    }
    df = df.withColumns(local)
    # the block ends seen by a row are one list of rows, not a list per series
    df = df.withColumn("_ends", F.collect_list(F.when(k == BLOCK - 1, F.struct(*local))).over(before))
    seen = F.col("_ends")
    out = {}
    for n, (_, r) in specs.items():
        carry = F.when(F.size(seen) > 0, F.aggregate(seen, F.lit(0.0), _fold(float(r) ** BLOCK, f"_l_{n}"))).otherwise(0.0)
        out[n] = F.col(f"_l_{n}") + F.pow(F.lit(r), k + 1) * carry
    return df.withColumns(out).drop(*local, "_ends")


def _fold(q: float, name: str):
    return lambda acc, x: acc * F.lit(q) + x[name]


def seeded(x: Column, first: int, alpha: float, seed: Column) -> Column:
    """Input series of an exponential average: nothing before bar ``first``, the seed there, alpha*x after."""
    bn = F.col("bn")
    return F.when(bn == first, seed).when(bn > first, F.lit(alpha) * x)


def seed_shares(x: Column, start: int, first: int, r: float, n: int = 1) -> Column:
    """The seed sum(x of bars start..first) / n at bar ``first`` as inputs of those bars: decayed by r, they add up to it there.

    Smoothing is linear, so no running sum has to be known before it.  NULL on other bars.
    """
    bn = F.col("bn")
    return F.when(bn.between(start, first), x / F.lit(float(n)) * F.pow(F.lit(r), bn - first))


def run_sum(x: Column, start: int, key: str = "symbol") -> Column:
    """Running sum of ``x`` from bar ``start`` on: at the seeding bar it is the seed's total."""
    w = W.partitionBy(key).orderBy("_blk", "bn").rowsBetween(W.unboundedPreceding, 0)
    return F.sum(F.when(F.col("bn") >= start, x)).over(w)


def from_bar(c: Column, first: int) -> Column:
    return F.when(F.col("bn") >= first, c)
