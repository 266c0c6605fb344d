"""Keyed state over ordered input: offsets, watermarks, fencing, failure detection, merged states.

Each processor sorts the rows of one key that a micro-batch brings by their sequence number; the size of a micro-batch
(maxFilesPerTrigger and the like) bounds them. State is kept by the state store and survives restarts.
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _ordered(rows: Iterator[pd.DataFrame], by: str) -> pd.DataFrame:
    return pd.concat(list(rows)).sort_values(by)


class Offsets(StatefulProcessor):
    """Dense offsets from 1 in each partition."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.end = handle.getValueState("end", "n long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        batch = _ordered(rows, "seq")
        end = self.end.get()[0] if self.end.exists() else 0
        self.end.update((end + len(batch),))
        yield pd.DataFrame({"partition": key[0], "seq": batch["seq"].to_numpy(), "offset": range(end + 1, end + len(batch) + 1)})

    def close(self) -> None:
        pass


class Watermark(StatefulProcessor):
    """The committed offset after each acknowledgement: the largest least offset of the replicas so far."""

    def __init__(self, replicas: list[int]):
        self.replicas = replicas

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getMapState("last", "replica int", "offset long")
        self.high = handle.getValueState("high", "n long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        known = {r: self.last.getValue((r,))[0] if self.last.containsKey((r,)) else 0 for r in self.replicas}
        high = self.high.get()[0] if self.high.exists() else 0
        batch = _ordered(rows, "seq")
        each = pd.DataFrame({r: batch["offset"].where(batch["replica"] == r).ffill().fillna(known[r]) for r in self.replicas})
        marks = each.min(axis=1).cummax().clip(lower=high).astype("int64")
        for r in self.replicas:
            self.last.updateValue((r,), (int(each[r].iloc[-1]),))
        self.high.update((int(marks.iloc[-1]),))
        out = pd.DataFrame({"partition": key[0], "seq": batch["seq"], "watermark": marks})
        yield out

    def close(self) -> None:
        pass


class Fence(StatefulProcessor):
    """Whether a command's epoch is at least the largest accepted before."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.epoch = handle.getValueState("epoch", "n long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        batch = _ordered(rows, "seq")
        largest = self.epoch.get()[0] if self.epoch.exists() else 0
        before = batch["epoch"].cummax().shift(fill_value=largest).clip(lower=largest)
        accepted = (batch["epoch"] >= before).to_numpy()
        self.epoch.update((max(largest, int(batch["epoch"].max())),))
        yield pd.DataFrame({"partition": key[0], "seq": batch["seq"].to_numpy(), "epoch": batch["epoch"].to_numpy(), "accepted": accepted})

    def close(self) -> None:
        pass


class CommittedLog(StatefulProcessor):
    """Messages with their offsets, each sent once, when the committed boundary has reached it.

    Messages and acknowledgements of a partition come as one input. What is above the boundary is held in blocks of consecutive
    offsets, named by their first, and goes out when acknowledgements raise the boundary, however many batches later.
    """

    BLOCK = 4096

    def __init__(self, replicas: list[int]):
        self.replicas = replicas

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.marks = handle.getValueState("marks", "end long, sent long, high long")
        self.last = handle.getMapState("last", "replica int", "offset long")
        self.held = handle.getMapState("held", "first long", "seqs array<long>, payloads array<string>")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values("seq", na_position="first", kind="stable")
        end, sent, high = self.marks.get() if self.marks.exists() else (0, 0, 0)
        acks = batch[batch["replica"].isin(self.replicas) & batch["acked"].notna()]
        if len(acks):
            known = {r: self.last.getValue((r,))[0] if self.last.containsKey((r,)) else 0 for r in self.replicas}
            each = pd.DataFrame({r: acks["acked"].where(acks["replica"] == r).ffill().fillna(known[r]) for r in self.replicas})
            high = max(high, int(each.min(axis=1).max()))
            for r in self.replicas:
                self.last.updateValue((r,), (int(each[r].iloc[-1]),))
        new = batch[batch["message"]]
        seqs = [None if pd.isna(s) else int(s) for s in new["seq"]]
        payloads = [p if isinstance(p, str) else None for p in new["payload"]]
        out: list[tuple] = []
        while sent < end and sent < high:  # of the blocks, those that the boundary has reached
            block, whole = self.held.getValue((sent + 1,)), (sent + 1,)
            count = min(len(block[0]), high - sent)
            out += [(key[0], block[0][i], sent + 1 + i, block[1][i]) for i in range(count)]
            self.held.removeKey(whole)
            sent += count
            if count < len(block[0]):
                self.held.updateValue((sent + 1,), (list(block[0][count:]), list(block[1][count:])))
        straight = max(0, min(high - end, len(seqs))) if sent == end else 0
        out += [(key[0], seqs[i], end + 1 + i, payloads[i]) for i in range(straight)]
        for i in range(straight, len(seqs), self.BLOCK):
            self.held.updateValue((end + 1 + i,), (seqs[i : i + self.BLOCK], payloads[i : i + self.BLOCK]))
        sent, end = sent + straight, end + len(seqs)
        self.marks.update((end, sent, high))
        yield pd.DataFrame(out, columns=["partition", "seq", "offset", "payload"]).astype({"seq": "Int64"})

    def close(self) -> None:
        pass


class Detector(StatefulProcessor):
    """DOWN when phi reaches the threshold, UP at the next beat, for the endpoints of one bucket.

    Endpoints are many and their beats in a micro-batch few, so a call takes a bucket of them, and reads and writes the gaps of those that beat.
    The tick of the conviction is known at each beat; the bucket keeps these ticks of all endpoints that aren't convicted, with one event-time timer for
    the first. It fires once the watermark is past, which beats of any endpoint and the ticks of a clock move on, and convicts all that are due
    by then. A beat that comes first reports a conviction which had been due.
    """

    def __init__(self, threshold: float, size: int, initial: int, most: int):
        self.threshold, self.size, self.initial, self.most = threshold, size, initial, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.known = handle.getMapState("known", "endpoint long", "last long, gaps array<long>")
        self.waiting = handle.getValueState("waiting", "timer long, endpoints array<long>, dues array<long>")

    def _wait(self, dues: dict, timer: int | None) -> None:
        """Keeps the dues, and the timer at the first of them; `timer` is set so far."""
        first = min(dues.values(), default=None)
        if timer is not None and timer != first:
            self.handle.deleteTimer(timer * 1000)
        if first is not None and timer != first:
            self.handle.registerTimer(first * 1000)
        self.waiting.update((first, list(dues), list(dues.values())))

    def _changes(self, out: list[tuple]) -> pd.DataFrame:
        endpoints, ticks, states = zip(*out, strict=True) if out else ((), (), ())
        return pd.DataFrame({"endpoint": pd.array(endpoints, dtype="Int64"), "tick": np.array(ticks, dtype="int64"), "state": np.array(states, dtype=object)})

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        batch, out = pd.concat(list(rows)), []
        if key[1]:  # else the clock's ticks, which only move time
            columns = batch["tick"].astype("int64").to_numpy(), batch["endpoint"].to_numpy(), batch["named"].to_numpy()
            ordered = np.lexsort(columns)
            timer, endpoints, ticks = self.waiting.get() if self.waiting.exists() else (None, [], [])
            dues = dict(zip(endpoints, ticks, strict=True))
            for (named, endpoint), beats in groupby(zip(*(c[ordered].tolist() for c in reversed(columns)), strict=True), itemgetter(0, 1)):
                endpoint = endpoint if named else None
                last, known = self.known.getValue((endpoint,)) or (None, [])
                due, gaps, total = dues.get(endpoint), deque(known, self.size), sum(known)  # none due: it is convicted
                for _, _, tick in beats:
                    gap = self.initial if last is None else max(tick - last, 1)
                    if last is not None and due is not None and due < tick:
                        out.append((endpoint, due, "DOWN"))
                    if last is not None and (due is None or due < tick):
                        out.append((endpoint, tick, "UP"))
                    if last is None or tick - last <= self.most:
                        total += gap - (gaps[0] if len(gaps) == self.size else 0)
                        gaps.append(gap)
                    last, due = tick, tick + max(1, math.ceil(self.threshold * math.log(10) * max(total / len(gaps), 0.1)))
                self.known.updateValue((endpoint,), (last, list(gaps)))
                dues[endpoint] = due
            self._wait(dues, timer)
        yield self._changes(out)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        until = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs() - 1)
        _, endpoints, ticks = self.waiting.get()
        dues = dict(zip(endpoints, ticks, strict=True))
        out = [(endpoint, due, "DOWN") for endpoint, due in dues.items() if due * 1000 <= until]
        self._wait({endpoint: due for endpoint, due in dues.items() if due * 1000 > until}, None)
        yield self._changes(out)

    def close(self) -> None:
        pass


def with_state(stream: DataFrame, processor: StatefulProcessor, schema: str, *by: str, time: str = "None") -> DataFrame:
    stream.sparkSession.conf.set(*STORE)
    return stream.groupBy(*by).transformWithStateInPandas(statefulProcessor=processor, outputStructType=schema, outputMode="Append", timeMode=time)


def stream_offsets(messages: DataFrame) -> DataFrame:
    return with_state(messages, Offsets(), "partition int, seq long, offset long", "partition")


def stream_high_watermark(acks: DataFrame, replicas: list[int]) -> DataFrame:
    return with_state(acks, Watermark(replicas), "partition int, seq long, watermark long", "partition")


def stream_fence(commands: DataFrame) -> DataFrame:
    return with_state(commands, Fence(), "partition int, seq long, epoch long, accepted boolean", "partition")


def stream_merge_state(values: DataFrame) -> DataFrame:
    """(endpoint, key, value, version, seq): the newest version of each value; of equal ones the first. For the output mode update.

    A streaming aggregate: keys are many and their rows few, so Spark's own state holds them, not a processor that is called for each key;
    rows of one key are combined before the shuffle. Out goes what a micro-batch brought rows of, as it then stands.
    """
    values.sparkSession.conf.set(*STORE)
    newest = values.groupBy("endpoint", "key").agg(F.max_by(F.struct("value", "version", "seq"), F.struct(F.col("version"), -F.col("seq"))).alias("v"))
    return newest.select("endpoint", "key", "v.value", "v.version", "v.seq")


def stream_committed_log(messages: DataFrame, acks: DataFrame, replicas: list[int]) -> DataFrame:
    """(partition, seq, offset, payload): every message (partition, seq, payload) once, when all replicas' acks (partition, seq, replica, offset) have reached it.

    A message without a seq comes first in its batch; acks of other replicas, or without an offset, count for nothing.
    """
    as_long = lambda c: F.col(c).cast("long").alias(c)
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    own = messages.select("partition", as_long("seq"), F.lit(True).alias("message"), "payload", none("int", "replica"), none("long", "acked"))
    theirs = acks.select("partition", as_long("seq"), F.lit(False).alias("message"), none("string", "payload"), F.col("replica").cast("int").alias("replica"), F.col("offset").cast("long").alias("acked"))
    return with_state(own.unionByName(theirs), CommittedLog(replicas), "partition int, seq long, offset long, payload string", "partition")


def stream_failure_detector(beats: DataFrame, threshold: float = 8.0, size: int = 1000, initial: int = 2, most: int = 1000, late: str = "0 seconds", clock: DataFrame | None = None, buckets: int = 256) -> DataFrame:
    """(endpoint, tick, state) of each change; beats: endpoint, tick, at (the tick as a timestamp).

    `clock` (tick) is a second stream that moves time on where endpoints fall silent: its ticks convict all that are due by then.
    It must not run ahead of the beats. Without it time moves with the beats of all endpoints. Endpoints go to `buckets` by their hashes; a stream that goes
    on from its checkpoint has to keep their number.
    """
    named, bucket = F.col("endpoint").isNotNull(), F.pmod(F.xxhash64("endpoint"), F.lit(buckets))
    rows = beats.select(bucket.alias("bucket"), F.lit(True).alias("beat"), named.alias("named"), F.coalesce(F.col("endpoint").cast("long"), F.lit(0)).alias("endpoint"), "tick", "at")
    if clock is not None:
        at = F.timestamp_millis(F.col("tick") * 1000 + 1)  # just past the tick, for timers that are due at it
        rows = rows.unionByName(clock.select(F.lit(0).cast("long").alias("bucket"), F.lit(False).alias("beat"), F.lit(False).alias("named"), F.lit(0).cast("long").alias("endpoint"), "tick", at.alias("at")))
    return with_state(rows.withWatermark("at", late), Detector(threshold, size, initial, most), "endpoint long, tick long, state string", "bucket", "beat", time="EventTime")
