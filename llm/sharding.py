"""A uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

How many rows each partition gives to each shard is drawn first: over partitions and shards one by one from the
hypergeometric distribution, so that the counts are those of a uniform permutation and every shard has its exact size.
Then each partition permutes its rows locally and gives its first ones to shard 0, the next to shard 1, and so on; after
the exchange each shard permutes what it got.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from llm.store import written

SUB = 50_000  # rows of a shard that are permuted together


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """How many of ``draws`` items out of good + bad are good, for totals of any size, by inversion around the mode."""
    low, high = max(0, draws - bad), min(draws, good)
    if low == high:
        return low
    mode = min(max((draws + 1) * (good + 1) // (good + bad + 2), low), high)
    p = good / (good + bad)
    reach = int(12 * np.sqrt(draws * p * (1 - p) + 1)) + 12
    a, b = max(low, mode - reach), min(high, mode + reach)
    k = np.arange(a, b, dtype=np.float64)
    step = np.log(good - k) + np.log(draws - k) - np.log(k + 1) - np.log(bad - draws + k + 1)
    log_p = np.concatenate(([0.0], np.cumsum(step)))
    weight = np.cumsum(np.exp(log_p - log_p.max()))
    return a + int(np.searchsorted(weight, rng.random() * weight[-1], side="right"))


def matrix(counts: list[int], shards: int, seed: int) -> list[list[int]]:
    """counts[i] rows of partition i dealt to the shards: row i of the matrix sums to counts[i], column j to shard j's
    size, and sizes are at most one apart. It has one row per partition of the input, not per row of data."""
    rng = np.random.Generator(np.random.PCG64(seed))
    total = sum(counts)
    left = [total // shards + (j < total % shards) for j in range(shards)]
    out = []
    for n in counts:
        row, rest = [], sum(left)
        for j in range(shards):
            k = hypergeometric(rng, left[j], rest - left[j], n) if rest else 0
            row.append(k)
            rest -= left[j]
            left[j] -= k
            n -= k
        out.append(row)
    return out


def sharded(rows: DataFrame, shards: int = 8, seed: int = 8) -> DataFrame:
    """rows with shard (int) and slot (long, gapless from 0 in its shard) in uniform random order.

    Sizes are at most one apart whatever the rows hold: nulls, empty texts and repeated rows are rows like any other, an
    empty table has no shards. The rows are written once with their place in the input, so a lost executor changes
    nothing. Own columns come in one struct, so any column names may occur except shard and slot, which are replaced.
    """
    spark = rows.sparkSession
    rows = rows.drop("shard", "slot")
    placed = written(rows.select(F.struct("*").alias("whole"), F.monotonically_increasing_id().alias("row")))
    part = F.shiftright("row", 33)
    sizes = placed.groupBy(part.alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect()
    dealt = matrix([r.n for r in sizes], shards, seed)
    ends = spark.createDataFrame([(r.part, np.cumsum(x).tolist()) for r, x in zip(sizes, dealt, strict=True)], "part long, ends array<long>")
    local = Window.partitionBy("part").orderBy(F.xxhash64(F.lit(seed), "row"), "row")
    keys = placed.select("row", part.alias("part")).withColumn("nth", F.row_number().over(local)).join(ends, "part")
    keys = keys.select("row", F.size(F.filter("ends", lambda e: e < F.col("nth"))).alias("shard"))
    subs = max(1, sum(r.n for r in sizes) // shards // SUB)
    second = F.xxhash64(F.lit(seed + 1), "row")
    keys = keys.withColumn("second", second).withColumn("sub", F.least(F.lit(subs - 1), F.floor((F.col("second") / 2.0**64 + 0.5) * subs)))
    before = Window.partitionBy("shard").orderBy("sub").rowsBetween(Window.unboundedPreceding, -1)
    blocks = keys.groupBy("shard", "sub").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    within = Window.partitionBy("shard", "sub").orderBy("second", "row")
    keys = keys.withColumn("nth", F.row_number().over(within)).join(blocks, ["shard", "sub"]).select("row", "shard", (F.col("before") + F.col("nth") - 1).alias("slot"))
    return placed.join(keys, "row").select("whole.*", "shard", F.col("slot").cast("long").alias("slot"))


def shard_query(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "utf-8")).alias("text_crc32"))
    return sharded(rows).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
