"""Mixing sources to target weights by systematic sampling.

Every document of a source is expected in the mix ``target / source_size`` times. The expected copies are summed up in an
order of the source's documents, one random offset is added, and a document is emitted once for each integer boundary
that its part of the sum crosses. The order is by size class, then at random, so that the words taken differ from the
target by about one large document at most. Sums are whole numbers of 2^-24 copies: exact, alike in any order of addition.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from llm import words as W
from llm.store import written

UNIT = 1 << 24
BUCKET = 20_000  # documents that are ordered together


def _sized(batches):
    for batch in batches:
        n = [np.diff(p.words) for p in W.slices(batch.column("text"))]
        yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(np.concatenate(n).astype(np.int64) if n else np.zeros(0, np.int64))], [*batch.schema.names[1:], "size"])


def sized(docs: DataFrame, *more: Column) -> DataFrame:
    """(doc_id, text_md5, source, ..., size) of docs(doc_id, text, source): size is the number of words, 0 for null."""
    rows = docs.select("text", "doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"), "source", *more)
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[1:])
    return rows.mapInArrow(_sized, f"{kind}, size long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: int = 3) -> DataFrame:
    """sizes(source, source_size) with the source's target.

    Sources in code-point order, null last, get the weights in turn and share 100 % of all sizes by weight. A target
    stops at ``cap`` times its source's size, and what is above goes to the others by weight until none is above: sources
    sorted by ``cap * size / weight`` are capped as long as a cap lies under the share that is then left to them. It runs
    over one row per source. A source without words gets 0.
    """
    nth = Window.orderBy(F.col("source").isNull(), "source")
    w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(nth) - 1, F.lit(len(weights))) + 1).cast("int")).cast("long")
    t = sizes.withColumn("w", w).withColumn("most", F.col("source_size") * cap)
    every = Window.partitionBy()
    order = Window.orderBy(F.col("most") / F.col("w"), F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumn("all", F.sum("source_size").over(every)).withColumn("all_w", F.sum("w").over(every))
    t = t.withColumn("left", F.col("all") - F.coalesce(F.sum("most").over(order), F.lit(0))).withColumn("left_w", F.col("all_w") - F.coalesce(F.sum("w").over(order), F.lit(0)))
    t = t.withColumn("full", F.col("most") * F.col("left_w") <= F.col("w") * F.col("left"))
    spare = F.col("all") - F.sum(F.when(F.col("full"), F.col("most")).otherwise(0)).over(every)
    open_w = F.sum(F.when(F.col("full"), 0).otherwise(F.col("w"))).over(every)
    share = F.col("w") * spare.cast("double") / open_w
    return t.withColumn("target", F.when(F.col("full"), F.col("most").cast("double")).otherwise(share)).select("source", "source_size", "target")


def size_class(size: Column) -> Column:
    """The five leading binary digits of a size and their place: equal for sizes within about 6 %."""
    shift = F.greatest(F.lit(0), F.length(F.bin(size)) - 5)
    return (shift * 32).cast("long") + F.floor(size / F.pow(F.lit(2.0), shift)).cast("long")


def copies(docs: DataFrame, seed: str = "mix", weights: tuple[int, ...] = (5, 2, 1), cap: int = 3) -> DataFrame:
    """docs(doc_id, text_md5, source, size) with source_size, target and the copies of each row in the mix.

    A row's place is fixed by its md5 of doc_id and text, so reruns agree. A source with a third of all rows is ordered in
    buckets of BUCKET rows whose sums are carried on. Rows that are equal in doc_id and text share the copies of their
    place among them. Null source: a source of its own. Null doc_id: ordered by text alone. Empty texts: size 0.
    """
    sizes = docs.groupBy("source").agg(F.sum("size").alias("source_size"))
    goal = targets(sizes, weights, cap).withColumn("expected", F.when(F.col("source_size") > 0, F.round(F.col("target") / F.col("source_size") * UNIT)).otherwise(0).cast("long"))
    digest = F.md5(F.concat_ws("|", F.lit(seed), F.col("doc_id").cast("string"), "text_md5"))
    rows = docs.withColumn("cls", size_class(F.col("size"))).withColumn("place", digest).withColumn("source_key", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")))
    part = rows.groupBy("source_key", "cls").agg(F.ceil(F.count("*") / BUCKET).alias("buckets"))
    rows = rows.join(part, ["source_key", "cls"]).withColumn("bucket", F.pmod(F.conv(F.substring("place", 1, 8), 16, 10).cast("long"), F.col("buckets")))
    goal = goal.withColumn("source_key", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))).drop("source")
    before = Window.partitionBy("source_key").orderBy("cls", "bucket").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy("source_key", "cls", "bucket").agg(F.count("*").alias("n"))
    blocks = blocks.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).join(goal, "source_key").select("source_key", "cls", "bucket", "before", "source_size", "target", "expected")
    within = Window.partitionBy("source_key", "cls", "bucket").orderBy("place", "doc_id")
    rows = rows.withColumn("nth", F.row_number().over(within)).join(blocks, ["source_key", "cls", "bucket"])
    offset = F.pmod(F.conv(F.substring(F.md5(F.concat(F.lit(seed), "source_key")), 1, 8), 16, 10).cast("long"), F.lit(UNIT))
    end = offset + (F.col("before") + F.col("nth")) * F.col("expected")
    crossed = F.floor(end / UNIT) - F.floor((end - F.col("expected")) / UNIT)
    return rows.withColumn("copies", crossed.cast("long")).drop("source_key", "cls", "buckets", "bucket", "place", "nth", "before", "expected")


def mixed(docs: DataFrame, seed: str = "mix", weights: tuple[int, ...] = (5, 2, 1), cap: int = 3) -> DataFrame:
    """docs(doc_id, text, source, ...) as the mix itself: each row as often as it is taken, all columns kept.

    Column names that clash with the operator's own are no matter: the columns ride along in one struct."""
    keyed = docs.select("doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"), "source", F.struct("*").alias("whole"))
    taken = copies(written(sized(docs)), seed, weights, cap)
    per = taken.groupBy("doc_id", "text_md5", "source").agg(F.sum("copies").alias("copies"), F.count("*").alias("rows"))
    per = written(per.where("copies > 0"))

    def joined(some: DataFrame) -> DataFrame:
        same = keyed["doc_id"].eqNullSafe(some["doc_id"]) & (keyed["text_md5"] == some["text_md5"]) & keyed["source"].eqNullSafe(some["source"])
        return keyed.join(some, same).select("whole", some["copies"].alias("n"), some["rows"].alias("rows"))

    every = joined(per.where("rows = 1")).select("whole", "n")
    if per.where("rows > 1").limit(1).count():
        # equal rows share their copies: the first of them have one more where they do not divide
        several = joined(per.where("rows > 1")).withColumn("k", F.row_number().over(Window.partitionBy(F.to_json("whole")).orderBy(F.lit(1))))
        several = several.withColumn("n", F.floor(F.col("n") / F.col("rows")) + F.when(F.col("k") <= F.pmod("n", "rows"), 1).otherwise(0))
        every = every.union(several.select("whole", "n").where("n > 0"))
    return every.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n").cast("long")))).select("whole.*")


def mix_query(docs: DataFrame) -> DataFrame:
    return copies(written(sized(docs))).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


SQL = r"""
WITH d AS (
  SELECT doc_id, md5(coalesce(text, '')) AS text_md5, coalesce('s' || source, 'n') AS sk, source,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT sk, source, sum(size)::BIGINT AS source_size FROM d GROUP BY sk, source),
t1 AS (SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3)::INT + 1]::BIGINT AS w, source_size * 3 AS most FROM s),
t2 AS (
  SELECT *, (sum(source_size) OVER ())::BIGINT AS all_s, (sum(w) OVER ())::BIGINT AS all_w,
         coalesce(sum(most) OVER o, 0)::BIGINT AS most_before, coalesce(sum(w) OVER o, 0)::BIGINT AS w_before FROM t1
  WINDOW o AS (ORDER BY most / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t3 AS (SELECT *, most * (all_w - w_before) <= w * (all_s - most_before) AS is_full FROM t2),
t4 AS (
  SELECT sk, source_size,
         CASE WHEN is_full THEN most::DOUBLE
              ELSE w * (all_s - (sum(CASE WHEN is_full THEN most ELSE 0 END) OVER ())::BIGINT)::DOUBLE / (sum(CASE WHEN is_full THEN 0 ELSE w END) OVER ())::BIGINT END AS target FROM t3),
goal AS (SELECT *, CASE WHEN source_size > 0 THEN round(target / source_size * 16777216)::BIGINT ELSE 0 END AS expected FROM t4),
r AS (
  SELECT *, md5(concat_ws('|', 'mix', doc_id::VARCHAR, text_md5)) AS place,
         (greatest(0, length(to_base(size, 2)) - 5) * 32 + floor(size / pow(2.0, greatest(0, length(to_base(size, 2)) - 5))))::BIGINT AS cls FROM d),
b AS (SELECT *, ('0x' || substr(place, 1, 8))::BIGINT % ceil(count(*) OVER (PARTITION BY sk, cls) / 20000.0)::BIGINT AS bucket FROM r),
n AS (SELECT *, row_number() OVER (PARTITION BY sk ORDER BY cls, bucket, place, doc_id) AS nth, ('0x' || substr(md5('mix' || sk), 1, 8))::BIGINT % 16777216 AS off FROM b)
SELECT doc_id, size, source_size, target,
       (((off + nth * expected) // 16777216 - (off + (nth - 1) * expected) // 16777216) * size)::BIGINT AS taken
FROM n JOIN goal USING (sk)
"""
