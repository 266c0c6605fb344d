"""Streams against their batch twins on the same feed."""

import pytest

from tidemark.plans import ordered, streams


def test_detector_without_a_clock_lacks_only_what_no_time_has_shown(spark, sf):
    from pyspark.sql import functions as F

    from tidemark.streaming import processors, runs

    beats = streams._events(spark, sf).select(F.col("user_id").alias("endpoint"), (F.col("event_id") + 1).alias("tick")).withColumn("at", F.timestamp_seconds("tick"))
    got = [tuple(r) for r in runs.run_to_files(processors.stream_failure_detector(beats, threshold=2.0, size=5, most=300)).collect()]
    episodes = ordered.down_episodes(spark, sf).collect()
    down = {(r["endpoint"], r["convicted_at"]) for r in episodes}
    over = {(r["endpoint"], r["convicted_at"]) for r in episodes if r["recovered_at"] is not None}
    told = [(e, t) for e, t, s in got if s == "DOWN"]
    assert len(told) == len(set(told)) and over <= set(told) <= down
    assert sorted((e, t) for e, t, s in got if s == "UP") == sorted((r["endpoint"], r["recovered_at"]) for r in episodes if r["recovered_at"] is not None)


def test_clock_convicts_endpoints_that_stay_silent(spark, sf):
    episodes = ordered.down_episodes(spark, sf).collect()
    last = max(r["tick"] for r in ordered._ticks(spark, sf).collect()) + 1000
    want = [(r["endpoint"], r["convicted_at"], "DOWN") for r in episodes if r["convicted_at"] <= last] + [(r["endpoint"], r["recovered_at"], "UP") for r in episodes if r["recovered_at"] is not None]
    assert any(r["recovered_at"] is None and r["convicted_at"] <= last for r in episodes)
    assert sorted(map(tuple, streams.stream_failure_detector(spark, sf).collect())) == sorted(want)


def _files(spark, folder, frames):
    for df in frames:
        df.coalesce(1).write.mode("append").parquet(folder)


def test_messages_wait_for_late_acks_also_over_a_restart(spark, tmp_path):
    """Acks come batches after their messages, and the query is started anew in the middle: each message once, none lost."""
    from tidemark.streaming import processors, runs

    message, ack = "partition int, seq long, payload string", "partition int, seq long, replica int, offset long"
    batches = [[(p, 100 * b + i, f"{p}-{b}-{i}") for p in (1, 2) for i in range(9)] for b in range(4)]
    nothing = [(1, 0, 9, 5)]  # a replica that isn't asked
    acks = [nothing, [(1, 1, 1, 4), (1, 2, 2, 3)], [(2, 3, 1, 30)], [(1, 4, 2, 12), (1, 5, 1, 11), (2, 6, 2, 7)], [(1, 7, 1, 2), (2, 8, 2, 36)]]
    m, a, out, state = (str(tmp_path / x) for x in ("m", "a", "out", "state"))

    def go():
        streams_ = runs.file_stream(spark, m, message), runs.file_stream(spark, a, ack)
        return sorted(tuple(r) for r in runs.run_to_files(processors.stream_committed_log(*streams_, [1, 2]), out, state).collect())

    numbered = {p: [(p, s, i + 1, x) for i, (_, s, x) in enumerate(r for b in batches for r in b if r[0] == p)] for p in (1, 2)}
    _files(spark, m, [spark.createDataFrame(b, message) for b in batches])
    _files(spark, a, [spark.createDataFrame(b, ack) for b in acks[:2]])
    assert go() == numbered[1][:3]
    _files(spark, a, [spark.createDataFrame(b, ack) for b in acks[2:4]])
    assert go() == sorted(numbered[1][:11] + numbered[2][:7])
    _files(spark, a, [spark.createDataFrame(acks[4], ack)])
    assert go() == sorted(numbered[1][:11] + numbered[2][:30])  # a lower ack takes nothing back
    _files(spark, a, [spark.createDataFrame([(2, 9, 1, 99), (2, 10, 2, 99)], ack)])
    assert go() == sorted(numbered[1][:11] + numbered[2])


def test_every_detector_change_reaches_a_listener(spark, sf):
    from pyspark.sql import functions as F

    from tidemark.streaming import processors, runs

    seen = []
    beats = streams._events(spark, sf).select(F.col("user_id").alias("endpoint"), (F.col("event_id") + 1).alias("tick")).withColumn("at", F.timestamp_seconds("tick"))
    changes = processors.stream_failure_detector(beats, threshold=2.0, size=5, most=300)
    runs.run_batches(changes, lambda rows, batch: seen.append((batch, rows.count())))
    assert sum(n for _, n in seen) > 0 and len({b for b, _ in seen}) == len(seen)


def test_watcher_goes_on_after_its_bookmark_or_lists_anew(spark, tmp_path):
    from tidemark.sources.versioned import VersionedTable
    from tidemark.streaming import runs

    schema = "key string, revision long, op string, value string"
    rows = [(f"k{i % 5}", i, "delete" if i % 7 == 0 else "put", f"v{i}") for i in range(1, 41)]
    feed, table = str(tmp_path / "feed"), VersionedTable.create(spark, str(tmp_path / "t"))
    give = lambda a, b: _files(spark, feed, [spark.createDataFrame(rows[a:b], schema)])
    stream = lambda: runs.file_stream(spark, feed, schema)
    whole = lambda upto: (spark.createDataFrame(rows, schema), upto)
    state = lambda upto: {k: (r, v, "Added") for k, r, op, v in rows[:upto] if r == max(x for y, x, _, _ in rows[:upto] if y == k) and op == "put"}
    read = lambda: sorted(map(tuple, table.read().select("key", "revision", "value", "kind").collect()), key=lambda r: r[1])
    watcher = runs.Watcher(table)
    give(0, 16)
    assert watcher.watch(stream(), whole=whole(10), state=str(tmp_path / "s1")) and watcher.bookmark() == 16
    want = sorted([(k, *x) for k, x in state(10).items()], key=lambda r: r[1]) + [(k, r, v, "Changed") for k, r, _, v in rows[10:16]]
    assert read() == want
    give(16, 24)
    assert not runs.Watcher(table).watch(stream(), state=str(tmp_path / "s1"))  # with the stream's own checkpoint
    give(24, 30)
    assert not runs.Watcher(table).watch(stream())  # and without it: the feed is read from its start, what is known is passed over
    assert read() == want + [(k, r, v, "Changed") for k, r, _, v in rows[16:30]] and not runs.Watcher(table).watch(stream())
    with pytest.raises(ValueError, match="nothing to list from"):
        runs.Watcher(table).watch(stream(), kept_from=35)
    feed = str(tmp_path / "later")
    give(34, 40)
    assert runs.Watcher(table).watch(stream(), kept_from=35, whole=whole(36))
    assert read() == sorted([(k, *x) for k, x in state(36).items()], key=lambda r: r[1]) + [(k, r, v, "Changed") for k, r, _, v in rows[36:]]


def test_merged_states_are_a_streaming_aggregate_and_go_on_after_a_restart(spark, tmp_path):
    """No processor is called for each key; of equal versions the first by seq wins, also where it comes batches later."""
    from tidemark.operators import states
    from tidemark.streaming import processors, runs

    schema = "endpoint long, key string, value double, version long, seq long"
    batches = [[(e, "LOAD", float(b * 1000 + e), 3 if e % 2 else b, 50 - b * 20) for e in range(300)] for b in range(3)]
    feed, out, state = (str(tmp_path / x) for x in ("feed", "out", "state"))
    merged = lambda: processors.stream_merge_state(runs.file_stream(spark, feed, schema))
    want = {}
    for frames in (batches[:2], batches[2:]):
        _files(spark, feed, [spark.createDataFrame(b, schema) for b in frames])
        for e, _, v, version, seq in (r for b in frames for r in b):
            want[e] = max(want.get(e, ((-1, 0), 0)), ((version, -seq), v))
        assert "InPandas" not in merged()._jdf.queryExecution().logical().toString()
        got = {r["endpoint"]: (r["version"], r["value"]) for r in states.merge_values(runs.run_updates(merged(), out, state)).collect()}
        assert got == {e: (n[0], v) for e, (n, v) in want.items()}


def test_detector_takes_endpoints_by_buckets_and_goes_on_after_a_restart(spark, tmp_path, monkeypatch):
    """Calls grow with buckets and batches, not with endpoints; a null endpoint is one; the state of a bucket outlives the query."""
    import os
    import random

    from pyspark.sql import functions as F

    from tidemark.operators import states
    from tidemark.streaming import processors, runs

    calls, base = str(tmp_path / "calls"), processors.Detector

    class Counted(base):
        def handleInputRows(self, key, rows, timerValues):
            with open(calls, "a") as f:
                f.write("1\n")
            return base.handleInputRows(self, key, rows, timerValues)

    monkeypatch.setattr(processors, "Detector", Counted)
    r = random.Random(5)
    beats = [(e, t) for e in [None, *range(1500)] for t in sorted(r.sample(range(1, 3000), 6))]
    beat, tick = "endpoint long, tick long", "tick long"
    b, c, out, state = (str(tmp_path / x) for x in ("b", "c", "out", "state"))

    def go(numbers):
        _files(spark, b, [spark.createDataFrame([x for x in beats if x[1] // 1000 == n] or [], beat) for n in numbers if n < 3])
        _files(spark, c, [spark.createDataFrame([(1000 * n + 999,)], tick) for n in numbers])
        stream = runs.file_stream(spark, b, beat).withColumn("at", F.timestamp_seconds("tick"))
        return runs.run_to_files(processors.stream_failure_detector(stream, 2.0, 5, 2, 300, clock=runs.file_stream(spark, c, tick)), out, state).collect()

    first, got = go([0, 1]), go([2, 3])
    assert set(first) < set(got)
    episodes = states.down_episodes(spark.createDataFrame(beats, beat), 2.0, 5, 2, 300).collect()
    want = [(e["endpoint"], e["convicted_at"], "DOWN") for e in episodes if e["convicted_at"] <= 3999] + [(e["endpoint"], e["recovered_at"], "UP") for e in episodes if e["recovered_at"] is not None]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr) and any(e is None for e, _, _ in want)
    assert 0 < os.path.getsize(calls) // 2 < 4 * 300


def test_feed_comes_in_order_where_the_events_are_many_files(spark, tmp_path, duck, same):
    """Files by their times hold ascending ranges; of each write only one, since those that tasks write side by side have no order."""
    import os

    import pyarrow.parquet as pq
    from pyspark.sql import functions as F

    spark.range(600_000, numPartitions=4).select(F.col("id").alias("event_id"), (F.col("id") * 7 % 1500).alias("user_id"), F.lit("view").alias("event_type"), (F.col("id") / 3).alias("value")).write.parquet(str(tmp_path / "events.parquet"))
    folder = streams._feed(spark.sparkContext.applicationId, str(tmp_path)).removeprefix("file:")
    found = sorted((os.stat(f"{folder}/{f}").st_mtime_ns, f) for f in os.listdir(folder) if f.endswith(".parquet"))
    ids = [pq.read_table(f"{folder}/{f}", columns=["event_id"])["event_id"].to_pylist() for _, f in found]
    assert [i for one in ids for i in one] == list(range(600_000)) and len({f.split("-c000")[0].split("-", 2)[2] for _, f in found}) == len(found) >= 3
    numbered = duck.sql(f"WITH events AS (SELECT * FROM '{tmp_path}/events.parquet/*.parquet') {streams.ORACLES['stream_offsets'].replace('WITH ', ', ', 1)}").df()
    ours = {(r["partition"], r["seq"]): r["offset"] for r in streams.stream_offsets(spark, str(tmp_path)).collect()}
    assert ours == {(p, s): o for p, s, o in numbered.itertuples(index=False)}
