"""Streaming queries over events and orders, run to the end of what is there."""

from __future__ import annotations

import math
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators import states
from tidemark.operators.prefix import Ranges
from tidemark.plans import ordered
from tidemark.sources.files import discard, workspace
from tidemark.sources.versioned import VersionedTable
from tidemark.streaming import processors, runs


#: Rows of a file of the feed, and so of a micro-batch.
ROWS_PER_FILE = 1_000_000


@cache
def _feed(app: str, d: str) -> str:
    """events as a folder of files in the order of arrival, read file by file by their times; made once for each session.

    The times of files which tasks write side by side have no order. So the events are first laid apart by ranges of event_id, at least three
    and of about ROWS_PER_FILE rows at most, and then written range after range: one job, one task and one file each.
    """
    spark = SparkSession.active()
    path, laid = workspace(spark), workspace(spark)
    events = spark.read.parquet(f"{d}/events.parquet").select("event_id", "user_id", "event_type", "value")
    ranges = Ranges(events, [], "event_id", max(1, min(ROWS_PER_FILE, math.ceil(events.count() / 3))))
    ranges.marked(events, "part").repartition("part").sortWithinPartitions("part").write.partitionBy("part").parquet(laid)
    parts = spark.read.schema(T.StructType([*events.schema, T.StructField("part", T.IntegerType())])).parquet(laid)
    for part in [r[0] for r in parts.select("part").distinct().orderBy("part").collect()] or [0]:
        parts.filter(F.col("part") == part).drop("part").coalesce(1).sortWithinPartitions("event_id").write.mode("append").parquet(path)
    discard(spark, laid)
    return path


def _events(spark, d: str) -> DataFrame:
    return runs.file_stream(spark, _feed(spark.sparkContext.applicationId, d), "event_id long, user_id long, event_type string, value double")


def _partition():
    return F.pmod("user_id", F.lit(12)).cast("int").alias("partition")


def stream_offsets(spark, d: str) -> DataFrame:
    return runs.run_to_files(processors.stream_offsets(_events(spark, d).select(_partition(), F.col("event_id").alias("seq"))))


def stream_high_watermark(spark, d: str) -> DataFrame:
    acks = _events(spark, d).select(_partition(), F.col("event_id").alias("seq"), (F.col("event_id") % 3 + 1).cast("int").alias("replica"), F.floor(F.col("event_id") / 10).alias("offset"))
    return runs.run_to_files(processors.stream_high_watermark(acks, [1, 2, 3]))


def stream_fence(spark, d: str) -> DataFrame:
    e = F.col("event_id")
    commands = _events(spark, d).select(_partition(), e.alias("seq"), (F.floor(e / 1000) - (e % 7 == 0).cast("int")).cast("long").alias("epoch"))
    return runs.run_to_files(processors.stream_fence(commands))


def stream_merge_state(spark, d: str) -> DataFrame:
    values = _events(spark, d).select(F.col("user_id").alias("endpoint"), F.col("event_type").alias("key"), "value", F.floor(F.col("event_id") / 3).alias("version"), F.col("event_id").alias("seq"))
    return states.merge_values(runs.run_updates(processors.stream_merge_state(values)))


@cache
def _ticks(app: str, d: str) -> str:
    """A clock beside the feed: with each of its files the last tick so far, and at the end one a thousand ticks on."""
    spark = SparkSession.active()
    path = workspace(spark)
    feed = spark.read.parquet(_feed(app, d)).groupBy(F.input_file_name().alias("file")).agg((F.max("event_id") + 1).alias("tick"))
    ends = sorted(r["tick"] for r in feed.collect())  # one for each file
    for tick in [*ends, (ends or [0])[-1] + 1000]:
        spark.createDataFrame([(tick,)], "tick long").coalesce(1).write.mode("append").parquet(path)
    return path


def _clock(spark, d: str) -> DataFrame:
    return runs.file_stream(spark, _ticks(spark.sparkContext.applicationId, d), "tick long")


def stream_failure_detector(spark, d: str) -> DataFrame:
    """All changes of state up to the clock's last tick, also of endpoints that stay silent."""
    beats = _events(spark, d).select(F.col("user_id").alias("endpoint"), (F.col("event_id") + 1).alias("tick")).withColumn("at", F.timestamp_seconds("tick"))
    return runs.run_to_files(processors.stream_failure_detector(beats, threshold=2.0, size=5, most=300, clock=_clock(spark, d)))


def _acks(events: DataFrame) -> DataFrame:
    e = F.col("event_id")
    return events.select(_partition(), e.alias("seq"), (e % 3 + 1).cast("int").alias("replica"), F.floor(e / 400).alias("offset"))


def stream_committed_fetch(spark, d: str) -> DataFrame:
    """Every message up to the last boundary; most acknowledgements come batches after the messages that they let through."""
    messages = _events(spark, d).select(_partition(), F.col("event_id").alias("seq"), F.col("event_type").alias("payload"))
    return runs.run_to_files(processors.stream_committed_log(messages, _acks(_events(spark, d)), [1, 2, 3]))


def stream_append_table(spark, d: str) -> DataFrame:
    table = VersionedTable.create(spark, workspace(spark))
    runs.append_to_table(_events(spark, d), table, "events")
    return table.read().select("event_id", "user_id", "event_type", "value")


def list_then_watch(spark, d: str) -> DataFrame:
    """The state of the baseline and every change after it, by a watcher that is started twice: the second goes on after the bookmark."""
    change = lambda e: e.select(F.col("user_id").alias("key"), F.col("event_id").alias("revision"), F.when(F.col("event_type") == "error", "delete").otherwise("put").alias("op"), F.col("event_type").alias("value"))
    whole = change(spark.read.parquet(f"{d}/events.parquet"))
    last = whole.agg(F.max("revision")).first()[0] or 0
    table = VersionedTable.create(spark, workspace(spark))
    for upto in (last - last // 4, last):
        runs.Watcher(table).watch(change(_events(spark, d)).filter(F.col("revision") <= upto), whole=(whole, last // 2))
    return table.read()


QUERIES = {f.__name__: f for f in (stream_offsets, stream_high_watermark, stream_fence, stream_merge_state, stream_failure_detector, stream_committed_fetch, stream_append_table, list_then_watch)}

_E = "SELECT event_id, user_id, event_type, value FROM events"
ORACLES = {
    "stream_offsets": ordered.ORACLES["assign_offsets"],
    "stream_high_watermark": ordered.ORACLES["high_watermark_history"],
    "stream_fence": ordered.ORACLES["fence_by_partition"],
    "stream_failure_detector": ordered.ORACLES["down_episodes"].replace("SELECT * FROM e WHERE recovered_at IS NULL OR convicted_at < recovered_at", "SELECT endpoint, convicted_at AS tick, 'DOWN' AS state FROM e WHERE (recovered_at IS NULL OR convicted_at < recovered_at) AND convicted_at <= (SELECT max(event_id) + 1001 FROM events) UNION ALL SELECT endpoint, recovered_at, 'UP' FROM e WHERE convicted_at < recovered_at"),
    "stream_merge_state": ordered.ORACLES["merge_values"],
    "stream_committed_fetch": f"""WITH {ordered._LOG}, marks AS ({ordered.ORACLES["high_watermark_history"].replace("event_id // 10", "event_id // 400")}), high AS (SELECT partition, max(watermark) AS high FROM marks GROUP BY partition)
        SELECT partition, seq, "offset", event_type AS payload FROM log JOIN high USING (partition) JOIN events ON event_id = seq WHERE "offset" <= high""",
    "stream_append_table": _E,
    "list_then_watch": """WITH c AS (SELECT user_id AS key, event_id AS revision, CASE WHEN event_type = 'error' THEN 'delete' ELSE 'put' END AS op, event_type AS value FROM events), m AS (SELECT max(revision) // 2 AS r FROM c)
        SELECT key, revision, value, 'Added' AS kind FROM (SELECT c.* FROM c, m WHERE revision <= r QUALIFY row_number() OVER (PARTITION BY key ORDER BY revision DESC) = 1) WHERE op <> 'delete'
        UNION ALL SELECT key, revision, value, 'Changed' FROM c, m WHERE revision > r""",
}
