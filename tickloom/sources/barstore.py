"""Bars stored once and read without moving them.

The store keeps bars in two layouts:

* *by symbol*: hash buckets of the symbol, one file each, sorted by (symbol, date). Windows, aggregates and joins by symbol
  read it without an exchange and without a sort.
* *by day*: folders by month. A date range reads its months only.

An update writes a new generation of the first layout by merging each symbol's new days into its row of history; the old
side is read in its buckets, so only the new days are shuffled. Months that have new days are rewritten in the second.

Spark tells the sort order of a bucketed table only if ``spark.sql.legacy.bucketedTableScan.outputOrdering`` is set
(``session.local_session`` does); without it every bucket is sorted again, without a shuffle.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import work_folder
from .bars import keep_last


def _month(date: str = "date") -> Column:
    return F.date_format(date, "yyyy-MM")


@dataclass(frozen=True)
class BarStore:
    """A generation of stored bars: its tables, its buckets and the columns of a bar."""

    spark: SparkSession
    name: str
    buckets: int
    columns: tuple[str, ...]
    generation: int = 0

    @property
    def symbol_table(self) -> str:
        return f"{self.name}_symbol_{self.generation}"

    @property
    def day_table(self) -> str:
        return f"{self.name}_day_{self.generation}"

    def by_symbol(self) -> DataFrame:
        return self.spark.table(self.symbol_table)

    def by_day(self, start: str | None = None, end: str | None = None) -> DataFrame:
        """Bars of an inclusive range of days; only its months are read."""
        t = self.spark.table(self.day_table)
        if start is not None:
            t = t.filter((F.col("month") >= start[:7]) & (F.col("date") >= F.lit(start).cast("date")))
        if end is not None:
            t = t.filter((F.col("month") <= end[:7]) & (F.col("date") <= F.lit(end).cast("date")))
        return t.drop("month")

    def append(self, new: DataFrame) -> BarStore:
        """The next generation: new days replace bars of the same (symbol, date), all others stay.

        The old generation stays as it is, so what reads it is not disturbed and a failed update leaves nothing behind.
        """
        new = keep_last(new.select(*self.columns), ["symbol", "date"], F.struct(*[x for x in self.columns if x not in ("symbol", "date")]))
        rest = [x for x in self.columns if x != "symbol"]
        row = F.array_sort(F.collect_list(F.struct(*rest)))
        old = self.by_symbol().groupBy("symbol").agg(row.alias("old"))
        late = new.groupBy("symbol").agg(row.alias("new"))
        j = old.join(late, "symbol", "full_outer")
        none = F.array().cast(dict(old.dtypes)["old"])
        kept = F.filter(F.coalesce("old", none), lambda x: ~F.exists(F.coalesce("new", none), lambda y: y["date"] == x["date"]))
        merged = j.select("symbol", F.inline(F.array_sort(F.concat(kept, F.coalesce("new", none)))))
        after = BarStore(self.spark, self.name, self.buckets, self.columns, self.generation + 1)
        after._write_symbols(merged.select(*self.columns))
        touched = new.select(_month().alias("month")).distinct()
        same = self.spark.table(self.day_table)
        changed = same.join(F.broadcast(touched), "month", "left_semi").drop("month")  # a row for each month at most
        changed = changed.join(new.select("symbol", "date"), ["symbol", "date"], "left_anti").select(*self.columns).unionByName(new)
        after._write_days(same.join(F.broadcast(touched), "month", "left_anti").drop("month").select(*self.columns).unionByName(changed))
        return after

    def _write_symbols(self, bars: DataFrame) -> None:
        # the hash of a repartition is that of the buckets: one task writes one bucket, as one file
        placed = bars.repartition(self.buckets, "symbol")
        placed.write.format("parquet").option("path", work_folder(self.spark)).bucketBy(self.buckets, "symbol").sortBy("symbol", "date").saveAsTable(self.symbol_table)

    def _write_days(self, bars: DataFrame, parts: int = 4) -> None:
        placed = bars.withColumn("month", _month()).repartition("month", F.pmod(F.xxhash64("symbol"), F.lit(parts)))
        placed.write.format("parquet").option("path", work_folder(self.spark)).partitionBy("month").saveAsTable(self.day_table)

    def drop(self) -> None:
        """Forget the tables of this generation (their files stay in the shared folder)."""
        for t in (self.symbol_table, self.day_table):
            self.spark.sql(f"DROP TABLE IF EXISTS {t}")


def store_bars(bars: DataFrame, buckets: int = 64, name: str | None = None) -> BarStore:
    """bars(symbol, date, ...) as the first generation of a store."""
    spark = bars.sparkSession
    store = BarStore(spark, name or f"bars_{uuid.uuid4().hex}", buckets, tuple(bars.columns))
    store._write_symbols(bars)
    store._write_days(store.by_symbol())
    return store
