"""Keyed offset logs: offsets, acknowledgements, the committed boundary, epoch fencing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.prefix import Ranges, highest, last, total


def assign_offsets(messages: DataFrame, partition: str = "partition", seq: str = "seq", first: int = 1, rows_per_range: int = 1 << 16, ends: DataFrame | None = None) -> DataFrame:
    """messages with `offset`: dense in each partition, in the order of arrival; a null partition is one, a null seq comes first.

    `ends` (partition, end) are the last offsets that a log has already; partitions that it lacks begin at `first`.
    A hot partition is numbered in ranges, each after the counts of those before it.
    """
    numbered = Ranges(messages, [partition], seq, rows_per_range).running(messages, {"offset": total(F.lit(1).cast("long"))})
    if ends is None:
        return numbered.withColumn("offset", F.col("offset") + F.lit(first - 1))
    known = ends.select(F.col("partition").alias("end_of_"), "end")
    joined = numbered.join(known, F.col(partition).eqNullSafe(F.col("end_of_")), "left")
    return joined.withColumn("offset", F.col("offset") + F.coalesce("end", F.lit(first - 1))).drop("end_of_", "end")


def latest_acks(acks: DataFrame) -> DataFrame:
    """The last offset that each replica of a partition reported; it may be lower than one before."""
    return acks.groupBy("partition", "replica").agg(F.max_by("offset", "seq").alias("offset"))


def committed_offset(acks: DataFrame, replicas: int) -> DataFrame:
    """(partition, committed): the least of the replicas' last offsets; a replica that never reported stands at 0."""
    last = latest_acks(acks)
    return last.groupBy("partition").agg(F.when(F.count("*") < replicas, F.lit(0)).otherwise(F.min("offset")).cast("long").alias("committed"))


def watermark_history(acks: DataFrame, replicas: list[int], rows_per_range: int = 1 << 16) -> DataFrame:
    """acks with `watermark`: after each, the largest least offset so far; it never goes back.

    Replicas that never reported stand at 0, and so do those of other numbers or none. Each replica's last offset, then the highest
    of their least, run over ranges of a hot partition. Null partitions are one; a null seq comes first.
    """
    ranges = Ranges(acks, ["partition"], "seq", rows_per_range)
    of = {f"r{r}_": F.when(F.col("replica") == r, F.col("offset")) for r in replicas}
    known = ranges.running(acks, {name: last(value) for name, value in of.items()})
    columns = [F.coalesce(name, F.lit(0)) for name in of]
    least = known.withColumn("least_", F.greatest(F.least(*columns) if len(columns) > 1 else columns[0], F.lit(0)))
    return ranges.running(least, {"watermark": highest(F.col("least_"))}).drop("least_", *of)


def fetch(log: DataFrame, bounds: DataFrame, start: int = 1, most: int | None = None) -> DataFrame:
    """Messages from `start` up to each partition's bound (partition, bound); nothing if start is below 1."""
    rows = log.join(bounds, "partition").filter((F.col("offset") >= start) & (F.col("offset") <= F.col("bound")) & F.lit(start >= 1))
    if most is not None:
        rows = rows.filter(F.col("offset") < start + most)
    return rows.drop("bound")


def lost_if_leader_dies(log: DataFrame, committed: DataFrame) -> DataFrame:
    """Messages that readers of the log's end see but committed readers don't."""
    return log.join(committed, "partition", "left").filter(F.col("offset") > F.coalesce("committed", F.lit(0))).drop("committed")


def behind(log: DataFrame, ends: DataFrame) -> DataFrame:
    """(partition, replica, missing, next_fetch): what each replica still has to fetch; ends is (partition, replica, offset)."""
    size = log.groupBy("partition").agg(F.max("offset").alias("end"))
    return ends.join(size, "partition").select("partition", "replica", F.greatest(F.col("end") - F.col("offset"), F.lit(0)).alias("missing"), (F.col("offset") + 1).alias("next_fetch"))


def fence(commands: DataFrame, *by: str, epoch: str = "epoch", seq: str = "seq", initial: int = 0, rows_per_range: int = 1 << 16) -> DataFrame:
    """commands with `accepted`: whether the epoch is at least the largest one accepted before.

    A stale command never raises the largest epoch, so the running maximum of all commands before does. `by` are
    the columns of independent registers; without them one register holds for all commands. A command without an epoch
    is refused; one without a seq comes first. One hot register, or the only one, is many tasks.
    """
    before = Ranges(commands, list(by), seq, rows_per_range).running(commands, {"largest_": highest(F.col(epoch))}, before=True)
    accepted = F.col(epoch) >= F.greatest(F.lit(initial), F.coalesce("largest_", F.lit(initial)))
    return before.withColumn("accepted", F.coalesce(accepted, F.lit(False))).drop("largest_")


def current_assignment(fenced: DataFrame, key: str = "partition") -> DataFrame:
    """(key, leader, epoch, stale): the last accepted command's leader, and how many were refused."""
    ok = F.col("accepted")
    return fenced.groupBy(key).agg(
        F.max_by(F.when(ok, F.col("leader")), F.when(ok, F.col("seq"))).alias("leader"),
        F.max_by(F.when(ok, F.col("epoch")), F.when(ok, F.col("seq"))).alias("epoch"),
        F.count_if(~ok).alias("stale"),
    )
