"""Every registered query of the library's own operators against its SQL, or for rows alone."""

import pytest

from tidemark.plans.registry import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, sf, duck, same):
    df = QUERIES[name](spark, sf)
    if name in ORACLES:
        same(df, duck, ORACLES[name])
    else:
        assert len(df.columns) and df.count() >= 1


def test_every_sql_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_pruning_reaches_the_scan(spark, sf):
    for name, pushed in (("prune_min", "GreaterThanOrEqual(l_orderkey,14000)"), ("prune_max", "LessThanOrEqual(l_orderkey,300)"), ("prune_range", "GreaterThanOrEqual(l_orderkey,500), LessThanOrEqual(l_orderkey,900)"), ("prune_point", "EqualTo(c_name,Customer#000000077)")):
        assert pushed in plan_of(QUERIES[name](spark, sf)), name


def test_sets_by_checksum(spark, sf, duck):
    import zlib

    parts = dict(duck.sql("SELECT p_partkey, p_name FROM part").fetchall())
    assert {r["p_partkey"]: r["set"] for r in QUERIES["crc_mod"](spark, sf).collect()} == {k: zlib.crc32(n.encode()) % 7 for k, n in parts.items()}
    names = dict(duck.sql("SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey < 16").fetchall())
    for r in QUERIES["route_to_set"](spark, sf).collect():
        own = zlib.crc32(r["key"].encode()) % 4
        assert (r["set"], r["nodes"]) == (own, ",".join(sorted(n for k, n in names.items() if k % 4 == own)))


def test_ranges_give_what_whole_partitions_give(spark, sf):
    from tidemark.operators import logs
    from tidemark.plans import ordered

    rows = lambda df: sorted(tuple(r) for r in df.select("partition", "seq", df.columns[-1]).collect())
    messages, acks = ordered._messages(spark, sf), ordered._acks(spark, sf)
    assert rows(logs.assign_offsets(messages, rows_per_range=37)) == rows(logs.assign_offsets(messages))
    assert rows(logs.watermark_history(acks, [1, 2, 3], rows_per_range=37)) == rows(logs.watermark_history(acks, [1, 2, 3]))


def test_cluster_has_to_name_a_shared_folder():
    from types import SimpleNamespace

    from tidemark.sources.files import shared_folder

    context = SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077")
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda k, d: d)))


def test_byte_reports_are_those_of_the_footers(spark, sf):
    """The sizes that the reports give, against the footers read one by one."""
    import glob

    import pyarrow.parquet as pq

    from tidemark.plans import scans

    files = glob.glob(scans._groups(spark, sf).removeprefix("file:") + "/*.parquet")
    chunks = [m.row_group(g).column(c) for f in files for m in [pq.ParquetFile(f).metadata] for g in range(m.num_row_groups) for c in range(m.num_columns)]
    want = {}
    for c in chunks:
        want[c.path_in_schema] = want.get(c.path_in_schema, 0) + c.total_compressed_size
    got = QUERIES["column_bytes"](spark, sf).collect()
    print(got[0], QUERIES["bytes_report"](spark, sf).collect()[0])
    assert {r["column"]: r["bytes"] for r in got} == want


def test_a_file_is_opened_once_for_many_row_groups(spark, tmp_path, monkeypatch):
    """Not once for each row group, whose footers would be parsed with the square of their number; and in several tasks."""
    import os
    import uuid

    from pyspark.sql import functions as F
    from pyspark.sql import types as T

    from tidemark.sources import files

    path, opened = str(tmp_path / "t"), str(tmp_path / "opened")
    os.mkdir(opened)
    files.write_parquet(spark.range(0, 60_000, 1, 2).select("id", (F.col("id") * 2).alias("twice")), path, 16_384)
    groups = files.footer_metadata(spark, path).select("path", "row_group").distinct()
    number, inner = groups.count(), files._open

    def counted(name, content):
        open(f"{opened}/{os.getpid()}-{uuid.uuid4()}", "w").close()
        return inner(name, content)

    monkeypatch.setattr(files, "_open", counted)
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("twice", T.LongType())])
    rows = files.scan_row_groups(spark, path, groups, schema).withColumn("task", F.spark_partition_id()).collect()
    assert sorted((r["id"], r["twice"]) for r in rows) == [(i, 2 * i) for i in range(60_000)]
    times = len(os.listdir(opened))
    assert 2 <= times <= 2 + number // files.GROUPS_PER_TASK and number > 8 and len({r["task"] for r in rows}) > 1


def test_files_of_row_groups_grow_in_number_not_in_size(spark, tmp_path, monkeypatch):
    import glob

    import pyarrow.parquet as pq
    from pyspark.sql import functions as F

    from tidemark.plans import scans
    from tidemark.sources import files

    monkeypatch.setattr(scans, "ROWS_PER_FILE", 1000, raising=False)
    monkeypatch.setattr(files, "FOOTER_ROWS", 2, raising=False)
    spark.range(12_000).select(F.col("id").alias("l_orderkey"), F.lit(1.5).alias("l_quantity"), F.timestamp_seconds("id").alias("l_shipdate")).write.parquet(str(tmp_path / "lineitem.parquet"))
    rows = [pq.ParquetFile(f).metadata.num_rows for f in glob.glob(scans._groups(spark, str(tmp_path)).removeprefix("file:") + "/*.parquet")]
    assert sum(rows) == 12_000 and len(rows) > 8 and max(rows) < 2000
    assert {r["rows"] for r in scans.footer_metadata(spark, str(tmp_path)).collect()} == {12_000}
