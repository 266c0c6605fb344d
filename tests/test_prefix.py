"""Running aggregates over ranges, and what is built on them, against plain Python; nulls, ties in nothing, one key with all rows."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import logs, prefix, recon, states


@pytest.fixture(scope="module")
def rows():
    r = random.Random(5)
    seqs = r.sample(range(1, 4000), 900)
    return [(None if s % 17 == 0 else (7 if s % 3 else s % 5), s if i else None, r.choice([None, 1, 2, 3]), r.choice([None, *range(40)])) for i, s in enumerate(seqs)]


def by_key(rows, order):
    out = {}
    for row in sorted(rows, key=lambda x: (x[order] is not None, x[order] or 0)):
        out.setdefault(row[0], []).append(row)
    return out


@pytest.mark.parametrize("per", [9, 100, 1 << 16])
def test_offsets_watermarks_and_fences_keep_every_row(spark, rows, per):
    df = spark.createDataFrame(rows, "partition int, seq long, replica int, offset long")
    offsets, marks, fenced, global_, largest = [], [], [], [], 0
    for key, own in by_key(rows, 1).items():
        last, high, epoch = {1: 0, 2: 0, 3: 0}, 0, 0
        for i, (_, seq, replica, offset) in enumerate(own):
            offsets.append((key, seq, i + 1))
            if replica and offset is not None:
                last[replica] = offset
            high = max(high, min(last.values()))
            marks.append((key, seq, high))
            fenced.append((key, seq, offset is not None and offset >= epoch))
            epoch = max(epoch, offset or 0)
    for _, seq, _, offset in sorted(rows, key=lambda x: (x[1] is not None, x[1] or 0)):
        global_.append((seq, offset is not None and offset >= largest))
        largest = max(largest, offset or 0)
    bag = lambda d, *c: sorted(map(tuple, d.select(*c).collect()), key=repr)
    assert bag(logs.assign_offsets(df.drop("offset"), rows_per_range=per), "partition", "seq", "offset") == sorted(offsets, key=repr)
    assert bag(logs.watermark_history(df, [1, 2, 3], rows_per_range=per), "partition", "seq", "watermark") == sorted(marks, key=repr)
    assert bag(logs.fence(df, "partition", epoch="offset", rows_per_range=per), "partition", "seq", "accepted") == sorted(fenced, key=repr)
    assert bag(logs.fence(df, epoch="offset", rows_per_range=per), "seq", "accepted") == sorted(global_, key=repr)


def test_reported_rows_are_kept(spark):
    df = spark.createDataFrame([(1, 1), (1, 2), (None, 3), (1, None)], "partition int, seq long")
    assert sorted(map(tuple, logs.assign_offsets(df).collect()), key=repr) == [(1, 1, 2), (1, 2, 3), (1, None, 1), (None, 3, 1)]


def test_offsets_go_on_after_known_ends(spark):
    df = spark.createDataFrame([(1, 1), (1, 2), (2, 3), (None, 4)], "partition int, seq long")
    ends = spark.createDataFrame([(1, 40), (None, 6)], "partition int, end long")
    assert sorted(map(tuple, logs.assign_offsets(df, ends=ends).collect()), key=repr) == [(1, 1, 41), (1, 2, 42), (2, 3, 1), (None, 4, 7)]


def test_one_hot_key_is_many_tasks(spark):
    df = spark.range(20_000).select(F.lit(1).alias("partition"), (F.col("id") * F.col("id")).alias("seq"))  # sparse numbers
    ranges = prefix.Ranges(df, ["partition"], "seq", 500)
    sizes = [r["count"] for r in ranges.marked(df, "r").groupBy("r").count().collect()]
    assert len(sizes) == 40 and max(sizes) < 800
    got = logs.assign_offsets(df, rows_per_range=500)
    assert got.filter("pow(offset - 1, 2) <> seq").count() == 0 and got.count() == 20_000


@pytest.mark.parametrize("per", [20, 1 << 16])
def test_beats_of_one_endpoint_and_of_many(spark, per):
    r = random.Random(3)
    ticks, at = [], 0
    for _ in range(700):
        at += r.choice([1, 1, 2, 3, 9, 400])
        ticks.append(at)
    rows = [(1, t) for t in ticks] + [(None, t) for t in ticks[:50]] + [(3, 5)]
    df = spark.createDataFrame(rows, "endpoint int, tick long")
    want, episodes, silences = [], [], []
    for key, own in by_key(rows, 1).items():
        gaps, before, means = [], None, []
        for _, tick in own:
            if before is None:
                gaps.append(2)
            elif tick - before <= 300:
                gaps.append(max(tick - before, 1))
            means.append((tick, max(sum(gaps[-5:]) / len(gaps[-5:]), 0.1)))
            before = tick
        want += [(key, t, m) for t, m in means]
        for (t, m), following in zip(means, [*(x for x, _ in means[1:]), None], strict=True):
            due = t + max(1, math.ceil(2.0 * math.log(10) * m))
            silences.append((key, t, round(((following or t) - t) / m / math.log(10), 6)))
            if following is None or due < following:
                episodes.append((key, due, following))
    bag = lambda d: sorted(map(tuple, d.collect()), key=repr)
    ranges = prefix.Ranges(df, ["endpoint"], "tick", per)
    means = states.arrival_mean(df, 5, 2, 300, ranges, rows_per_block=per)
    assert [(k, t, round(m, 9)) for k, t, m in bag(means.select("endpoint", "tick", "mean"))] == [(k, t, round(m, 9)) for k, t, m in sorted(want, key=repr)]
    assert bag(states.down_episodes(df, 2.0, 5, 2, 300, per)) == sorted(episodes, key=repr)
    assert bag(states.phi_of_silences(df, 5, 2, 300, per).select("endpoint", "tick", F.round("phi", 6))) == sorted(silences, key=repr)
    probes = [(k, t) for k in (1, None, 9) for t in range(0, 4000, 37)]
    got = {(k, t): p for k, t, p in bag(states.phi_at(spark.createDataFrame(probes, "endpoint int, tick long"), df, 5, 2, 300, per))}
    for k, t in probes:
        known = [(x, m) for key, x, m in want if key == k and x <= t]
        assert got[k, t] == pytest.approx((t - known[-1][0]) / known[-1][1] / math.log(10) if known else 0.0)


@pytest.mark.parametrize("per", [20, 1 << 16])
def test_probes_of_a_grid_are_made_by_the_beats(spark, per):
    """Those of phi_at for every endpoint, without a shuffle of them: also before the first beat, after the last, and without any tick."""
    r = random.Random(4)
    beats = [(e, t) for e in (1, 2, None) for t in sorted(r.sample(range(2500), 60))] + [(5, 4100), (6, 700), (7, None), (8, 1700), (8, None)]
    df = spark.createDataFrame(beats, "endpoint int, tick long")
    probes = spark.createDataFrame([(e, t) for e in (1, 2, None, 5, 6, 7, 8) for t in range(100, 4201, 50)], "endpoint int, tick long")
    bag = lambda d: sorted(((e, t, round(p, 9)) for e, t, p in d.select("endpoint", "tick", "phi").collect()), key=repr)
    upto = spark.createDataFrame([(4203,)], "last long")
    assert bag(states.phi_at_ticks(df, 100, 50, upto, 5, 2, 300, per)) == bag(states.phi_at(probes, df, 5, 2, 300, per))
    assert not states.phi_at_ticks(df, 100, 50, spark.createDataFrame([(99,)], "last long"), 5, 2, 300, per).count()


def test_query_phi_at_shuffles_no_probes(spark, sf):
    from tidemark.plans import ordered

    plan = ordered.phi_at(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan[: plan.index("Generate")] and "Sort" not in plan[: plan.index("Generate")]


def test_probes_of_a_grid_are_dealt_by_their_number_and_kept_small(spark, tmp_path, monkeypatch):
    """No task makes all probes before the first beats, no row more than a block; endpoints that fall silent alike share what a format compresses."""
    import glob

    import pyarrow.parquet as pq
    from pyspark.sql import functions as F

    monkeypatch.setattr(states, "PROBES_PER_TASK", 25_000, raising=False)
    monkeypatch.setattr(states, "RUN", 256, raising=False)
    beats = spark.range(300).select(F.col("id").alias("endpoint"), F.explode(F.sequence(F.lit(1), F.lit(5))).alias("n")).select("endpoint", (F.col("endpoint") * 1000 + F.col("n") * 7).alias("tick"))
    probes = states.phi_at_ticks(beats, 500, 100, spark.createDataFrame([(200_000,)], "last long"), 5, 2, 300)
    probes.write.parquet(str(tmp_path / "probes"))
    files = [pq.ParquetFile(f).metadata for f in glob.glob(str(tmp_path / "probes/*.parquet"))]
    rows = [m.num_rows for m in files]
    assert sum(rows) == 300 * 1996 and max(rows) < 2 * 25_000
    for name, most in (("endpoint", 0.5), ("tick", 0.5), ("phi", 2)):
        column = probes.columns.index(name)
        assert sum(m.row_group(g).column(column).total_compressed_size for m in files for g in range(m.num_row_groups)) < most * sum(rows)


def test_suspicions_are_rounded_like_decimals(spark):
    from pyspark.sql import functions as F

    r = random.Random(6)
    values = [0.0, 5e-7, 1.0000005, 1.0000015, 0.4999999, 999999.9999995, 123456.7890125, 1e6 + 5e-7, 1e12, 1e17, 1e300, *(r.random() * 10 ** r.randrange(-7, 14) for _ in range(5000)), *(r.randrange(10**9) / 10**7 for _ in range(5000))]
    df = spark.createDataFrame([(v,) for v in [*values, None]], "v double")
    assert not df.filter(~F.round("v", 6).eqNullSafe(states._rounded(F.col("v"), 6))).count()


@pytest.mark.parametrize("per", [20, 1 << 16])
def test_changes_of_one_key(spark, per):
    r = random.Random(8)
    rows = [(k, i, r.choice(["put", "put", "delete"]), r.choice([None, "a", "b"])) for k in (1, None) for i in r.sample(range(9000), 150)]
    df = spark.createDataFrame(rows, "key int, revision long, op string, value string")
    previous, kinds = [], []
    for key, own in by_key(rows, 1).items():
        op_before, value_before, created = None, None, None
        for _, revision, op, value in own:
            known = None if op_before in (None, "delete") else value_before
            previous.append((key, revision, known, "DELETE" if op == "delete" else "UPDATE" if known is not None else "ADD"))
            fresh = op_before in (None, "delete")
            if fresh:
                created = revision if op == "put" else None
            kinds.append((key, revision, created, "Deleted" if op == "delete" else "Added" if fresh else "Modified"))
            op_before, value_before = op, value
    ranges = prefix.Ranges(df, ["key"], "revision", per)
    bag = lambda d, *c: sorted(map(tuple, d.select("key", "revision", *c).collect()), key=repr)
    assert bag(recon.with_previous_value(df, ranges), "previous", "event") == sorted(previous, key=repr)
    assert bag(recon.classify_changes(df, ranges), "created", "kind") == sorted(kinds, key=repr)
