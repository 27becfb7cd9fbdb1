"""Windows over one total order, without a single-partition sort.

`Window.orderBy` without a partition moves every row to one task. Here the rows
are range-partitioned by the order and written once; a window runs within each
range, and what a range must know of those before it (its predecessor's last
value, the sum of all before) comes from a table with one row per range.

The order's columns must tell all rows apart; otherwise ties are broken anyhow.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.sources.staging import shuffle_partitions, written

PART = "__range"


class TotalOrder:
    """Rows in a total order, over which lags and running sums can be taken."""

    def __init__(self, df: DataFrame, *order: str, ranges: int | None = None):
        self.order = list(order)
        n = ranges or shuffle_partitions(df.sparkSession)
        self.df = written(df.repartitionByRange(n, *order).withColumn(PART, F.spark_partition_id()), "ranges")

    def _within(self):
        return Window.partitionBy(PART).orderBy(*self.order)

    def _with_carry(self, carry: DataFrame, name: str) -> DataFrame:
        return self.df.join(F.broadcast(carry.select(F.col(PART), F.col(name))), PART, "left")  # a row per range

    def lag(self, value: str | Column, name: str) -> TotalOrder:
        """The value of the row before, null for the first."""
        value = F.col(value) if isinstance(value, str) else value
        last = self.df.groupBy(PART).agg(F.max_by(value, F.struct(*self.order)).alias("__last"))
        carry = last.withColumn("__carry", F.lag("__last").over(Window.orderBy(PART)))
        local, first = F.lag(value).over(self._within()), F.row_number().over(self._within()) == 1
        out = self._with_carry(carry, "__carry").withColumn(name, F.when(first, F.col("__carry")).otherwise(local)).drop("__carry")
        return self._next(out)

    def running_sum(self, value: str | Column, name: str, inclusive: bool = True) -> TotalOrder:
        """The sum of all rows up to this one, or before it; 0 where there is none."""
        value = F.col(value) if isinstance(value, str) else value
        total = self.df.groupBy(PART).agg(F.sum(value).alias("__sum"))
        before = Window.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
        carry = total.withColumn("__carry", F.sum("__sum").over(before))
        frame = self._within().rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
        zero = F.lit(0)
        out = self._with_carry(carry, "__carry").withColumn(name, F.coalesce(F.sum(value).over(frame), zero) + F.coalesce("__carry", zero)).drop("__carry")
        return self._next(out)

    def row_number(self, name: str) -> TotalOrder:
        """0, 1, 2, ... in the order."""
        return self.running_sum(F.lit(1).cast("long"), name, inclusive=False)

    def where(self, condition: str | Column) -> TotalOrder:
        return self._next(self.df.where(condition))

    def with_column(self, name: str, value: Column) -> TotalOrder:
        return self._next(self.df.withColumn(name, value))

    def _next(self, df: DataFrame) -> TotalOrder:
        out = object.__new__(TotalOrder)
        out.order, out.df = self.order, df
        return out

    def rows(self) -> DataFrame:
        return self.df.drop(PART)
