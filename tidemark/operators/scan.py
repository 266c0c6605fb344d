"""Projections, filters, predicates, row-group pruning and its reports."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import range_request


def map_rows(df: DataFrame, *columns: Column) -> DataFrame:
    return df.select(*columns)


def map_pandas(df: DataFrame, f: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """An opaque function over batches of rows, for what columns can't express."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield f(frame)

    return df.mapInPandas(run, schema)


def equal(column: str, value: str) -> Column:
    return F.col(column) == F.lit(value)


def greater(column: str, value: str) -> Column:
    """As text, whatever the digits: '9' is greater than '30'."""
    return F.col(column).cast("string") > F.lit(value)


def both(*predicates: Column) -> Column:
    out = F.lit(True)
    for p in predicates:
        out = out & p
    return out


def filter_map_job(df: DataFrame, column: str, least, pattern: str, *columns: str) -> DataFrame:
    return df.filter(F.col(column) >= least).select(F.format_string(pattern, *columns).alias("line"))


def prefixed(df: DataFrame, column: str, prefix: str) -> DataFrame:
    return df.filter(F.col(column).startswith(prefix))


def with_status(df: DataFrame, column: str, status: str) -> DataFrame:
    return df.filter(F.col(column) == status)


def prune(footers: DataFrame, column: str, low=None, high=None, kind: str = "double") -> DataFrame:
    """The row groups (path, row_group) that can hold low <= column <= high; one without statistics stays.

    Give `low` alone for values of at least low, `high` alone for at most, both alike for a point.
    """
    least, most = (F.col(c).try_cast(kind) for c in ("min", "max"))
    keep = F.lit(True)
    if low is not None:
        keep = keep & (most.isNull() | (most >= F.lit(low).cast(kind)))
    if high is not None:
        keep = keep & (least.isNull() | (least <= F.lit(high).cast(kind)))
    return footers.filter(F.col("column") == column).withColumn("kept", keep)


def bytes_report(pruned: DataFrame, footers: DataFrame) -> DataFrame:
    """Bytes and requests of reading the kept row groups (with two footer reads a file) and all of them."""
    groups = footers.groupBy("path", "row_group").agg(F.sum("bytes").alias("bytes"), F.min("offset").alias("offset"), F.first("rows").alias("rows"))
    each = groups.join(pruned.select("path", "row_group", "kept"), ["path", "row_group"])
    return each.agg(
        F.sum("bytes").alias("all_bytes"),
        F.sum(F.when(F.col("kept"), F.col("bytes")).otherwise(0)).alias("kept_bytes"),
        F.count_if("kept").alias("kept_groups"),
        F.count("*").alias("groups"),
        F.sum(F.when(F.col("kept"), F.col("rows")).otherwise(0)).alias("kept_rows"),
        F.sum("rows").alias("all_rows"),
        (F.count_if("kept") + 2 * F.count_distinct("path")).alias("requests"),
        F.max(F.when(F.col("kept"), range_request(F.col("offset"), F.col("bytes")))).alias("a_request"),
    )


def column_bytes(footers: DataFrame) -> DataFrame:
    return footers.groupBy("column").agg(F.sum("bytes").alias("bytes"), F.count("*").alias("chunks"))


def validate_rows(df: DataFrame, rules: dict[str, str], required: tuple[str, ...] = (), positive: tuple[str, ...] = ()) -> DataFrame:
    """df with `reasons`: why a row isn't valid; an empty array for a valid row.

    rules gives the declared type of text columns: a value that isn't of the type is a reason, as is a
    null in a required column or a negative number in a positive one.
    """
    checks = [F.when(F.col(c).isNull(), F.lit(f"{c} is missing")) for c in required]
    checks += [F.when(F.col(c).isNotNull() & F.col(c).try_cast(kind).isNull(), F.lit(f"{c} is not {kind}")) for c, kind in rules.items()]
    checks += [F.when(F.col(c).try_cast("double") < 0, F.lit(f"{c} is negative")) for c in positive]
    return df.withColumn("reasons", F.array_compact(F.array(*checks)))


def latency_histogram(df: DataFrame, value: str, bounds: tuple[float, ...] = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1, 2.5, 5, 10)) -> DataFrame:
    """Cumulative counts of values up to each bound, and up to infinity, from one aggregate."""
    counts = [F.count_if(F.col(value) <= b).alias(f"b{i}") for i, b in enumerate(bounds)]
    one = df.agg(*counts, F.count(value).alias("all"))
    entries = [F.struct(F.lit(float(b)).alias("bound"), F.col(f"b{i}").alias("count")) for i, b in enumerate(bounds)]
    return one.select(F.explode(F.array(*entries, F.struct(F.lit(None).cast("double").alias("bound"), F.col("all").alias("count")))).alias("e")).select("e.bound", "e.count")
