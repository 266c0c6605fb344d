"""Reads planned from the commit log: statistics, Bloom filters, the schema, and an offset log on them."""

import datetime

import pytest
from pyspark.sql import functions as F

from tidemark.sources.offsetlog import OffsetLog
from tidemark.sources.versioned import Conflict, VersionedTable


def names(df):
    return {f.rsplit("/", 1)[-1] for f in df.inputFiles()}


@pytest.fixture
def table(spark, tmp_path):
    table = VersionedTable.create(spark, str(tmp_path / "t"))
    rows = spark.range(4000).select("id", F.concat(F.lit("n"), F.pmod(F.col("id") * 7919, F.lit(4000))).alias("name"), F.when(F.col("id") % 3 > 0, F.col("id") % 10).alias("k"), F.date_add(F.lit(datetime.date(2020, 1, 1)), F.col("id").cast("int")).alias("day"), (F.col("id") / 7).alias("x"))
    table.append(rows.repartitionByRange(8, "id"), blooms=("name", "k"))
    return table


def test_a_point_read_opens_one_file(table):
    for where, value in (("id", 1234), ("day", datetime.date(2021, 5, 5)), ("name", "n2")):
        df = table.read(at={where: value})
        assert len(names(df)) == 1 and [r[where] for r in df.collect()] == [value]
    assert len(names(table.read(at={"k": 77}))) == 0 and table.read(at={"k": 77}).count() == 0  # inside no file's bounds
    assert table.read(at={"x": 0.0}).count() == 1 and table.read(at={"id": 9999}).columns == ["id", "name", "k", "day", "x"]


def test_a_range_read_opens_the_files_of_the_range(table):
    df = table.read(between={"id": (600, 640)})
    assert len(names(df)) <= 2 and sorted(r["id"] for r in df.collect()) == list(range(600, 641))
    assert table.read(between={"id": (None, 9)}).count() == 10 and table.read(between={"id": (3990, None)}).count() == 10
    assert table.read(between={"k": (3, 4)}).count() == table.read().filter("k between 3 and 4").count()


def test_statistics_of_a_file(spark, tmp_path):
    table = VersionedTable.create(spark, str(tmp_path / "s"))
    table.append(spark.createDataFrame([(3, None, "b"), (1, None, "é" * 300), (None, None, "a")], "i int, e int, s string").coalesce(1), blooms=("s",))
    (r,) = table.files().collect()
    assert r["stats"]["rows"] == "3" and (r["stats"]["min.i"], r["stats"]["max.i"], r["stats"]["nulls.i"]) == ("1", "3", "1")
    assert "min.e" not in r["stats"] and r["stats"]["nulls.e"] == "3" and "max.s" not in r["stats"] and r["stats"]["min.s"] == "a"
    assert table.read(at={"e": 1}).count() == 0 and table.read(at={"s": "é" * 300}).count() == 1 and table.read(at={"s": "none"}).count() == 0


def test_schema_comes_from_the_log(spark, tmp_path):
    table = VersionedTable.create(spark, str(tmp_path / "e"))
    assert table.read().columns == []
    table.append(spark.createDataFrame([(1, "a")], "i int, s string"))
    table.append(spark.createDataFrame([(2, 2.5)], "i int, x double"))
    assert sorted(map(tuple, table.read().select("i", "s", "x").collect())) == [(1, "a", None), (2, None, 2.5)]
    assert table.read(0).columns == ["i", "s", "x"] and table.read(0).count() == 0
    assert table.read(1).columns == ["i", "s"]
    table.replace(spark.createDataFrame([(7,)], "i int"))
    assert table.read().columns == ["i"] and table.diff_rows(2, 3).filter("change = 'removed'").count() == 2


def test_two_appends_give_dense_offsets(spark, tmp_path):
    log = OffsetLog.create(spark, str(tmp_path / "log"))
    rows = lambda a, b: spark.range(a, b).select((F.col("id") % 3).cast("int").alias("partition"), F.col("id").alias("seq"), F.concat(F.lit("m"), "id").alias("body"))
    log.append(rows(0, 3000), rows_per_file=100)
    log.append(rows(3000, 3600), rows_per_file=100)
    log.append(rows(0, 0))
    got = log.read().collect()
    assert sorted((r["partition"], r["offset"]) for r in got) == [(p, o) for p in range(3) for o in range(1, 1201)]
    assert all(r["seq"] == (r["offset"] - 1) * 3 + r["partition"] and r["body"] == f"m{r['seq']}" for r in got)
    assert {r["partition"]: r["end"] for r in log.ends().collect()} == {"0": 1200, "1": 1200, "2": 1200}
    bounds = spark.createDataFrame([(0, 1150), (2, 2)], "partition int, bound long")
    some = log.fetch(bounds, start=1040)
    assert sorted((r["partition"], r["offset"]) for r in some.collect()) == [(0, o) for o in range(1040, 1151)]
    assert len(names(some)) <= 3 < len(names(log.read())) and len(names(log.fetch(bounds, start=1, most=10))) <= 3
    with pytest.raises(Exception, match="null in partition column"):
        log.append(spark.createDataFrame([(None, 1)], "partition int, seq long"))


def test_an_append_that_comes_second_is_numbered_anew(spark, tmp_path, monkeypatch):
    log, other = (OffsetLog.create(spark, str(tmp_path / "c")) for _ in range(2))
    row = lambda s: spark.createDataFrame([(1, s)], "partition int, seq long")
    stage, first = log.table.stage, [True]

    def beaten(*args, **options):
        if first and first.pop():
            other.append(row(1))
        return stage(*args, **options)

    monkeypatch.setattr(log.table, "stage", beaten)
    log.append(row(2))
    assert sorted((r["seq"], r["offset"]) for r in log.read().collect()) == [(1, 1), (2, 2)]
    first.append(True)
    with pytest.raises(Conflict):
        log.append(row(3), tries=1)


def test_a_diff_reads_the_ranges_that_differ(spark, tmp_path, monkeypatch):
    table = VersionedTable.create(spark, str(tmp_path / "d"), digest=("id", 100))
    rows = spark.range(40_000).select("id", (F.col("id") % 7).alias("v")).repartitionByRange(16, "id")
    changed = rows.withColumn("v", F.when(F.col("id").between(12_300, 12_699), -1).otherwise(F.col("v"))).filter("id <> 39000").unionByName(spark.createDataFrame([(None, 1)], "id long, v long"))
    table.append(rows)
    table.replace(changed)
    table.replace(changed.repartition(3))  # the same rows in other files
    seen, plain = [], table._rows

    def watched(files, schema):
        df = plain(files, schema)
        seen.append(len(names(df)) if files.count() else 0)
        return df

    monkeypatch.setattr(table, "_rows", watched)
    got = sorted(map(tuple, table.diff_rows(1, 2).collect()), key=repr)
    want = [(i, i % 7, "removed") for i in [*range(12_300, 12_700), 39_000]] + [(i, -1, "added") for i in range(12_300, 12_700)] + [(None, 1, "added")]
    assert got == sorted(want, key=repr) and max(seen) <= 4
    assert table._ranges_that_differ(table.files(2), table.files(3)) == [] and table.diff_rows(2, 3).count() == 0
    assert table._ranges_that_differ(table.files(1), table.files(2)) == [(123, 126), (390, 390), (None, None)]
    assert table._ranges_that_differ(table.files(1), table.files(2), most=1) == [(123, 390), (None, None)]
    assert VersionedTable(spark, table.path).digest == ("id", 100) and VersionedTable.create(spark, str(tmp_path / "e")).digest is None


def test_a_diff_of_files_without_digests(spark, tmp_path):
    table = VersionedTable.create(spark, str(tmp_path / "n"), digest=("id", 100))
    table.append(spark.createDataFrame([(1,), (2,)], "other int"))
    table.replace(spark.createDataFrame([(2,), (3,)], "other int"))
    assert table._ranges_that_differ(table.files(1), table.files(2)) is None
    assert sorted(map(tuple, table.diff_rows(1, 2).collect())) == [(1, "removed"), (3, "added")]
    assert table.diff_rows(2, 2).count() == 0


def test_bloom_filters_shuffle_words_not_values(spark, tmp_path, monkeypatch):
    """Files grow in number with the rows, and of a column's values nothing but the words of its filter is exchanged."""
    from pyspark.sql import functions as F

    from tidemark.plans import versions
    from tidemark.sources.versioned import VersionedTable

    monkeypatch.setattr(versions, "ROWS_PER_FILE", 500, raising=False)
    plans, write = [], VersionedTable._write_blooms

    def seen(self, schema, folder, stats, blooms, batch):
        plain = F.broadcast
        monkeypatch.setattr(F, "broadcast", lambda df: plans.append(df.columns) or plain(df))
        write(self, schema, folder, stats, blooms, batch)
        monkeypatch.setattr(F, "broadcast", plain)

    monkeypatch.setattr(VersionedTable, "_write_blooms", seen)
    names = spark.range(10_000).select(F.col("id").alias("c_custkey"), F.concat(F.lit("Customer#"), F.lpad(F.col("id").cast("string"), 9, "0")).alias("c_name"), F.lit("X").alias("c_mktsegment"))
    names.write.parquet(str(tmp_path / "customer.parquet"))
    assert versions.point_lookup_by_log(spark, str(tmp_path)).collect() == [(42, "Customer#000000042")]
    assert versions.name_lookup_by_log(spark, str(tmp_path)).collect() == [(77, "Customer#000000077")]
    table = VersionedTable(spark, versions._keyed(spark.sparkContext.applicationId, str(tmp_path)))
    assert plans == [["plain", "stats"]] and table.files().count() > 16
