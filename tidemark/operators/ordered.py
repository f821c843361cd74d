"""Rows in one order over a whole table, without a window that gathers them in one task.

The table is dealt into ranges of the order and each range is sorted; so it is written once, because a second run of
the same plan may draw other bounds of the ranges. What a row needs of rows before its own range is carried:

* its number: the sizes of the ranges before, one number a range;
* a running sum, count, minimum or maximum: the same of the ranges before, one row a range;
* a few rows before it (lags, moving means): a *halo* of the last rows before each range, which come along in a window
  that has the range as its key.

Only sizes and running values of ranges reach the driver, a row a range. Equal rows are dealt by their place as well,
so that a value which a third of all rows share fills many ranges; they keep the order in which they were read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..storage import kept

#: How running values of rows, and of ranges, are put together.
_AGGREGATES = {"sum": (F.sum, lambda a, b: a + b), "count": (F.count, lambda a, b: a + b), "max": (F.max, max), "min": (F.min, min)}
_JOINED = {"sum": lambda a, b: a + b, "count": lambda a, b: a + b, "max": F.greatest, "min": F.least}


#: The number of a row, from 1 over the whole table, in the windows of ``Ordered.window``.
NUMBER = "__o_n"


class Ordered:
    """A table in an order, whose columns have no names that begin with ``__o_``. ``rows`` has its columns and ``__o_range``, ``__o_n`` (from 1 over the whole table)."""

    def __init__(self, df: DataFrame, *order: str | Column, ranges: int | None = None):
        self.columns = df.columns
        keys = [F.col(o) if isinstance(o, str) else o for o in order]
        named = df.withColumns({f"__o_k{i}": k for i, k in enumerate(keys)}).withColumn("__o_place", F.monotonically_increasing_id())
        by = [*(f"__o_k{i}" for i in range(len(keys))), "__o_place"]
        dealt = (named.repartitionByRange(ranges, *by) if ranges else named.repartitionByRange(*by)).sortWithinPartitions(*by)
        # A task's number and, below it, the row's number in the task.
        at = F.monotonically_increasing_id()
        dealt = dealt.select(*self.columns, at.alias("__o_at"))
        written = kept(dealt.select(*self.columns, F.shiftright("__o_at", 33).cast("int").alias("__o_range"), F.col("__o_at").bitwiseAND(F.lit((1 << 33) - 1)).alias("__o_local")), "ordered")
        sizes = sorted(written.groupBy("__o_range").agg(F.count(F.lit(1)).alias("n")).collect())
        starts, total = [], 0
        for r, n in sizes:
            starts.append((r, total, n))
            total += n
        self.total = total
        self._starts = F.broadcast(df.sparkSession.createDataFrame(starts, "__o_range int, __o_start long, __o_size long"))  # a row a range
        self.rows = written.join(self._starts, "__o_range").withColumn("__o_n", F.col("__o_start") + F.col("__o_local") + 1).drop("__o_local")

    def numbered(self, name: str, first: int = 0) -> DataFrame:
        return self.rows.select(*self.columns, (F.col("__o_n") + (first - 1)).alias(name))

    def window(self, before: int, over: Callable[[WindowSpec], dict[str, Column]]) -> DataFrame:
        """The table with columns of windows over at most ``before`` rows before each row.

        ``over`` gets a window in order and returns the columns by name.
        """
        rows = self.rows
        last = rows.where(F.col("__o_n") > F.col("__o_start") + F.col("__o_size") - before) if before else rows.limit(0)
        # A row belongs to the halo of each range that starts behind it, and at most ``before`` rows away.
        ahead = last.drop("__o_range", "__o_start", "__o_size").withColumn("__o_start", F.explode(F.sequence(F.col("__o_n"), F.col("__o_n") + (before - 1))))
        halo = ahead.join(self._starts.where("__o_start > 0"), "__o_start").withColumn("__o_own", F.lit(False))
        both = rows.withColumn("__o_own", F.lit(True)).unionByName(halo)
        seen = both.withColumns(over(Window.partitionBy("__o_range").orderBy("__o_n")))
        return seen.where("__o_own").drop("__o_own", "__o_range", "__o_start", "__o_size", "__o_n")

    def running(self, values: dict[str, tuple[str, Column]], own: bool = True) -> DataFrame:
        """The table with running values of all rows before each row, and of the row itself if ``own``.

        ``values`` has for each new column one of sum, count, max and min, and what it is of. Nulls are passed over;
        before the first value there is null, or a count of 0.
        """
        rows = self.rows.withColumns({f"__o_v_{name}": value for name, (_, value) in values.items()})
        told = sorted(rows.groupBy("__o_range").agg(*(_AGGREGATES[kind][0](f"__o_v_{name}").alias(name) for name, (kind, _) in values.items())).collect(), key=lambda r: r["__o_range"])
        carried, so_far = [], dict.fromkeys(values)
        for r in told:
            carried.append((r["__o_range"], *so_far.values()))
            for name, (kind, _) in values.items():
                known = [x for x in (so_far[name], r[name]) if x is not None]
                so_far[name] = _AGGREGATES[kind][1](*known) if len(known) == 2 else next(iter(known), None)
        kinds = {f.name: f.dataType.simpleString() for f in rows.groupBy("__o_range").agg(*(_AGGREGATES[kind][0](f"__o_v_{name}").alias(name) for name, (kind, _) in values.items())).schema}
        before = rows.sparkSession.createDataFrame(carried, ", ".join(["__o_range int", *(f"`__o_b_{n}` {kinds[n]}" for n in values)]))
        until = Window.partitionBy("__o_range").orderBy("__o_n").rowsBetween(Window.unboundedPreceding, Window.currentRow if own else -1)
        out = rows.join(F.broadcast(before), "__o_range")  # a row a range
        for name, (kind, _) in values.items():
            within, carry = _AGGREGATES[kind][0](f"__o_v_{name}").over(until), F.col(f"__o_b_{name}")
            joined = _JOINED[kind](within, carry)
            value = F.when(carry.isNull(), within).when(within.isNull(), carry).otherwise(joined)
            out = out.withColumn(name, F.coalesce(value, F.lit(0)) if kind == "count" else value)
        return out.select(*self.columns, *values)
