"""Running aggregates over keyed, ordered rows, in which a hot key is many tasks.

A key with more rows than a task should hold is cut into ranges of its order with about as many rows each. Every range is
first reduced to one row; what those before a range leave is put in front of its rows, and a window within the
range does the rest. So any step works whose whole is the step over its parts in order: sums, extremes, the last value. Other
keys are one window, and nothing is joined, so null keys and nulls in the order are rows like others.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges of all hot keys together, and so also hot keys, are about this many at most.
MOST_RANGES = 10_000


class Step(NamedTuple):
    """A running aggregate: what a range leaves (of a value, and the rows' order), and the window function."""

    value: Column
    leaves: Callable[[Column, Column], Column]
    over: Callable[[Column], Column]


def total(value: Column) -> Step:
    return Step(value, lambda v, _: F.sum(v), F.sum)


def highest(value: Column) -> Step:
    return Step(value, lambda v, _: F.max(v), F.max)


def lowest(value: Column) -> Step:
    return Step(value, lambda v, _: F.min(v), F.min)


def last(value: Column) -> Step:
    """The last value that isn't null."""
    return Step(value, lambda v, order: F.max_by(v, F.when(v.isNotNull(), order)), lambda v: F.last(v, ignorenulls=True))


def free(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores at the end until no column of df has them."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def quoted(name: str) -> Column:
    return F.col(f"`{name.replace('`', '``')}`")


class Ranges:
    """How the rows of `df` are cut: by keys, and hot keys by quantiles of `order` (a number, a date, a time or a text).

    The counts of keys stay in Spark; the keys with more than rows_per_range rows (or more than a MOST_RANGESth of all), and
    the bounds of their ranges come to the driver. Rows that tie in `order` are in one range; nulls are in the first.
    The same ranges serve any frame with these keys and this order.
    """

    def __init__(self, df: DataFrame, by: list[str], order: str, rows_per_range: int = 1 << 16):
        self.by, self.order = by, order
        counts = df.groupBy(*map(quoted, by)).agg(F.count("*").alias("n_"))
        rows, most, self.keys = counts.agg(F.sum("n_"), F.max("n_"), F.count("*")).first()
        per = max(rows_per_range, (rows or 0) // MOST_RANGES)
        self.bounds: list = []
        self.hot = None
        if most and most > per:
            spark = df.sparkSession
            keys = counts.filter(F.col("n_") > per).select(*map(quoted, by))
            self.hot = spark.createDataFrame(keys.collect(), keys.schema) if by else None
            parts = math.ceil(rows / per)
            shares = [i / parts for i in range(1, parts)]
            rows = self._with_hot(df).filter("hot_").select(quoted(order).alias("o_")).filter("o_ is not null")
            if rows.dtypes[0][1] == "string":  # of those with the least hashes
                found = sorted(r[0] for r in rows.distinct().orderBy(F.xxhash64("o_"), "o_").limit(20 * parts).collect())
                found = [found[len(found) * i // parts] for i in range(1, parts)] if found else []
            else:
                found = rows.agg(F.percentile_approx("o_", shares, 10 * parts)).first()[0]
            self.bounds = sorted(set(found or []))

    @classmethod
    def turned(cls, ranges: Ranges, order: str = "back_") -> Ranges:
        """The same cuts for the opposite order: a column that holds the negative of the order's."""
        out = cls.__new__(cls)
        out.by, out.order, out.hot, out.keys = ranges.by, order, ranges.hot, ranges.keys
        out.bounds = [-b for b in reversed(ranges.bounds)]
        return out

    def _with_hot(self, df: DataFrame) -> DataFrame:
        if self.hot is None:
            return df.withColumn("hot_", F.lit(True))
        keys = self.hot.select(*(quoted(c).alias(f"k{i}_") for i, c in enumerate(self.by)), F.lit(True).alias("hot_"))
        same = [quoted(c).eqNullSafe(F.col(f"k{i}_")) for i, c in enumerate(self.by)]
        joined = df.join(F.broadcast(keys), same, "left")  # MOST_RANGES keys at most
        return joined.withColumn("hot_", F.coalesce("hot_", F.lit(False))).drop(*(f"k{i}_" for i in range(len(self.by))))

    def marked(self, df: DataFrame, name: str) -> DataFrame:
        """df with the number of each row's range; 0 for rows of keys that aren't cut."""
        if not self.bounds:
            return df.withColumn(name, F.lit(0))
        bounds, steps = F.lit(self.bounds), [1 << k for k in reversed(range(len(self.bounds).bit_length()))]
        further = lambda at, step: F.when(F.get(bounds, at + step - 1) < quoted(self.order), at + step).otherwise(at)
        found = F.aggregate(F.lit(steps), F.lit(0), further)  # a binary search
        return self._with_hot(df).withColumn(name, F.when(F.col("hot_"), found).otherwise(0)).drop("hot_")

    def running(self, df: DataFrame, steps: dict[str, Step], then: tuple[str, ...] = (), before: bool = False) -> DataFrame:
        """df with a column for each of `steps`: over the rows of the key so far, or (before) over those before.

        Rows are in the order of `order`, then of the columns `then`, nulls first.
        """
        range_, head, *values = free(df, "range_", "head_", *(f"v{i}_" for i in range(len(steps))))
        rows = self.marked(df, range_).withColumns({v: s.value for v, s in zip(values, steps.values(), strict=True)})
        ordered = [quoted(c) for c in (self.order, *then)]
        reach = Window.unboundedPreceding, -1 if before else 0
        if self.bounds:
            leaves = [s.leaves(F.col(v), F.struct(*ordered)).alias(v) for v, s in zip(values, steps.values(), strict=True)]
            earlier = Window.partitionBy(*map(quoted, self.by)).orderBy(range_).rowsBetween(Window.unboundedPreceding, -1)
            heads = rows.groupBy(*map(quoted, self.by), range_).agg(*leaves)
            heads = heads.withColumns({v: s.over(F.col(v)).over(earlier) for v, s in zip(values, steps.values(), strict=True)})
            rows = rows.withColumn(head, F.lit(False)).unionByName(heads.withColumn(head, F.lit(True)), allowMissingColumns=True)
            ordered = [F.desc(head), *ordered]
        within = Window.partitionBy(*map(quoted, self.by), range_).orderBy(*ordered).rowsBetween(*reach)
        out = rows.withColumns({name: s.over(F.col(v)).over(within) for (name, s), v in zip(steps.items(), values, strict=True)})
        return (out.filter(~F.col(head)).drop(head) if self.bounds else out).drop(range_, *values)


def sliding(df: DataFrame, by: list[str], nth: str, size: int, aggregates: dict[str, Column], rows_per_block: int = 1 << 16) -> DataFrame:
    """df with aggregates over each row and the size - 1 before it; `nth` numbers the rows of a key from 1 without a gap.

    Rows go to blocks by their number; the last size - 1 of a block also go to the next, so a hot key is many tasks.
    """
    block, halo = free(df, "block_", "halo_")
    wide = max(rows_per_block, 8 * size)
    own = F.floor((quoted(nth) - 1) / wide)
    also = F.pmod(quoted(nth) - 1, F.lit(wide)) >= wide - (size - 1)
    dealt = df.select("*", F.posexplode(F.when(also, F.array(own, own + 1)).otherwise(F.array(own))).alias(halo, block))
    frame = Window.partitionBy(*map(quoted, by), block).orderBy(quoted(nth)).rowsBetween(-(size - 1), 0)
    return dealt.withColumns({name: a.over(frame) for name, a in aggregates.items()}).filter(F.col(halo) == 0).drop(block, halo)
