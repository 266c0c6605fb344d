"""Queries over a versioned table of orders."""

from __future__ import annotations

import math
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources import versioned
from tidemark.sources.files import files_of, workspace
from tidemark.sources.versioned import Conflict, VersionedTable


def _orders(spark, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")


@cache
def _built(app: str, d: str) -> str:
    """Four batches by key, then a replacement without the pending orders; made once for each session."""
    spark = SparkSession.active()
    table = VersionedTable.create(spark, workspace(spark))
    for k in range(4):
        table.append(_orders(spark, d).filter(F.col("o_orderkey") % 4 == k))
    table.replace(_orders(spark, d).filter("o_orderstatus <> 'P'"))
    return table.path


def _table(spark, d: str) -> VersionedTable:
    return VersionedTable(spark, _built(spark.sparkContext.applicationId, d))


def create_table(spark, d: str) -> DataFrame:
    table = VersionedTable.create(spark, workspace(spark), name="orders")
    VersionedTable.create(spark, table.path)
    orders = _orders(spark, d).agg(F.count("*").alias("orders"))
    return table.metadata().crossJoin(F.broadcast(orders)).select("type", "minReaderVersion", "minWriterVersion", "orders")


def append(spark, d: str) -> DataFrame:
    """What is staged is seen only once it is committed."""
    table = VersionedTable.create(spark, workspace(spark))
    table.append(_orders(spark, d).filter("o_orderstatus = 'O'"))
    before = table.pinned()
    staged = table.stage(_orders(spark, d).filter("o_orderstatus = 'P'"))
    seen = before().agg(F.count("*").alias("rows")).withColumn("at", F.lit("staged"))
    table.commit(staged, 1, "WRITE")
    return seen.unionByName(table.read().agg(F.count("*").alias("rows")).withColumn("at", F.lit("committed"))).unionByName(before().agg(F.count("*").alias("rows")).withColumn("at", F.lit("pinned")))


def insert_and_commit(spark, d: str) -> DataFrame:
    table = VersionedTable.create(spark, workspace(spark))
    for k in range(2):
        table.append(_orders(spark, d).filter(F.col("o_orderkey") % 2 == k))
    return table.read()


def append_partitioned(spark, d: str) -> DataFrame:
    table = VersionedTable.create(spark, workspace(spark), partition_columns=("o_orderstatus",))
    table.append(_orders(spark, d), "o_orderstatus")
    return table.read(o_orderstatus="F")


def path_partition_prune(spark, d: str) -> DataFrame:
    table = VersionedTable.create(spark, workspace(spark), partition_columns=("o_orderstatus",))
    table.append(_orders(spark, d), "o_orderstatus")
    return table.read(o_orderstatus="P").groupBy("o_orderstatus").agg(F.count("*").alias("orders"), F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("cents"))


#: Rows of a file of the indexed table, which one task sorts.
ROWS_PER_FILE = 100_000


@cache
def _keyed(app: str, d: str) -> str:
    """Customers in the order of their keys, eight files and more as the rows do, with Bloom filters of their names; made once for each session."""
    spark = SparkSession.active()
    table = VersionedTable.create(spark, workspace(spark))
    customers = spark.read.parquet(f"{d}/customer.parquet").select("c_custkey", "c_name", "c_mktsegment")
    table.append(customers.repartitionByRange(max(8, math.ceil(customers.count() / ROWS_PER_FILE)), "c_custkey").sortWithinPartitions("c_custkey"), blooms=("c_name",))
    return table.path


def point_lookup_by_log(spark, d: str) -> DataFrame:
    """One key's row, from the one file whose statistics allow it."""
    return VersionedTable(spark, _keyed(spark.sparkContext.applicationId, d)).read(at={"c_custkey": 42}).select("c_custkey", "c_name")


def name_lookup_by_log(spark, d: str) -> DataFrame:
    """One name's row: every file's names span it, so their Bloom filters decide."""
    return VersionedTable(spark, _keyed(spark.sparkContext.applicationId, d)).read(at={"c_name": "Customer#000000077"}).select("c_custkey", "c_name")


def range_by_log(spark, d: str) -> DataFrame:
    return VersionedTable(spark, _keyed(spark.sparkContext.applicationId, d)).read(between={"c_custkey": (40, 90)}).select("c_custkey", "c_mktsegment")


def replace(spark, d: str) -> DataFrame:
    return _table(spark, d).read(5).groupBy("o_orderstatus").agg(F.count("*").alias("orders"))


def read_table(spark, d: str) -> DataFrame:
    return _table(spark, d).read()


def read_as_of(spark, d: str) -> DataFrame:
    return _table(spark, d).read(2)


def read_in_txn(spark, d: str) -> DataFrame:
    table = VersionedTable.create(spark, workspace(spark))
    table.append(_orders(spark, d).filter("o_orderstatus = 'O'"))
    pinned = table.pinned()
    table.append(_orders(spark, d).filter("o_orderstatus = 'F'"))
    return pinned().groupBy("o_orderstatus").agg(F.count("*").alias("orders"))


def commit_with_retry(spark, d: str) -> DataFrame:
    """Two writers read the same version: the second is refused, and its retry over the newer one gets in."""
    table = VersionedTable.create(spark, workspace(spark))
    read = table.version()
    first, second = (table.stage(_orders(spark, d).filter(F.col("o_orderstatus") == s)) for s in ("O", "F"))
    table.commit(first, read, "WRITE")
    refused = False
    try:
        table.commit(second, read, "WRITE")
    except Conflict:
        refused = True
    table.commit_with_retry(lambda t, v: second)
    return table.read().groupBy("o_orderstatus").agg(F.count("*").alias("orders")).withColumn("refused", F.lit(refused))


def detect_lost_updates(spark, d: str) -> DataFrame:
    """A write whose commit is refused and given up leaves files that no version names."""
    table = VersionedTable.create(spark, workspace(spark))
    table.append(_orders(spark, d).filter("o_orderstatus = 'O'"))
    table.stage(_orders(spark, d).filter("o_orderstatus = 'F'"))
    return table.lost_updates().agg(F.count("*").alias("writers"))


def commit(spark, d: str) -> DataFrame:
    return _table(spark, d).history().select("version", "operation", "read_version")


def table_history(spark, d: str) -> DataFrame:
    return _table(spark, d).history().select("version", "operation", "read_version", (F.col("adds") > 0).alias("adds"), (F.col("removes") > 0).alias("removes"))


def table_detail(spark, d: str) -> DataFrame:
    """Its version, whether its files and bytes are those on disk, and its rows."""
    t = _table(spark, d)
    named = t.files().select(_plain("path"))
    rows = _data(spark, t).join(named, "path", "left_semi").agg(F.count("*").alias("rows"))
    on_disk = files_of(spark, f"{t.path}/data").withColumn("path", _plain("path")).join(named, "path", "left_semi").agg(F.count("*").alias("f"), F.sum("size").alias("b"))
    whole = t.detail().crossJoin(F.broadcast(on_disk)).crossJoin(F.broadcast(rows))
    return whole.select("last_version", (F.col("files") == F.col("f")).alias("files_agree"), (F.col("bytes") == F.col("b")).alias("bytes_agree"), "rows")


def snapshot_files(spark, d: str) -> DataFrame:
    t = _table(spark, d)
    each = [t.read(v).agg(F.count("*").alias("rows")).withColumn("version", F.lit(v)) for v in (1, 3, 4, 5, 99)]
    out = each[0]
    for more in each[1:]:
        out = out.unionByName(more)
    return out


def _plain(column: str):
    return F.regexp_replace(column, "^file:/+", "/").alias("path")


def _data(spark, t: VersionedTable) -> DataFrame:
    """The rows of all data files on disk, with their file's path."""
    return spark.read.option("recursiveFileLookup", True).parquet(f"{t.path}/data").select("*", F.col("_metadata.file_path").alias("path")).withColumn("path", _plain("path"))


def active_file_rows(spark, d: str) -> DataFrame:
    """Rows of all data files whose file is active at version 3: a semi join on the path."""
    t = _table(spark, d)
    return _data(spark, t).join(t.files(3).select(_plain("path")), "path", "left_semi").drop("path")


def snapshot_metadata(spark, d: str) -> DataFrame:
    return _table(spark, d).metadata(3).select("type", "minReaderVersion", "minWriterVersion")


def files_matching(spark, d: str) -> DataFrame:
    """Rows of the active files whose path matches: those of one status."""
    t = VersionedTable.create(spark, workspace(spark), partition_columns=("o_orderstatus",))
    t.append(_orders(spark, d), "o_orderstatus")
    return _data(spark, t).join(t.files().filter(F.col("path").contains("/p_o_orderstatus=F/")).select(_plain("path")), "path", "left_semi").agg(F.count("*").alias("rows"))


def read_commit_log(spark, d: str) -> DataFrame:
    """The kinds of actions of each version, in the order of their first lines."""
    kinds = _table(spark, d).actions().groupBy("version", "action.type").agg(F.min("line").alias("line"))
    return kinds.groupBy("version").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "type"))), lambda x: x["type"]), ",").alias("kinds"))


def actions_as_parquet(spark, d: str) -> DataFrame:
    """Actions kept as Parquet and read back, against those of the log."""
    path = workspace(spark)
    _table(spark, d).exported_actions().write.parquet(path)
    back = VersionedTable.import_actions(spark.read.parquet(path)).select("version", "line", F.to_json("action").alias("back"))
    both = _table(spark, d).actions().select("version", "line", "action.type", F.to_json("action").alias("own")).join(back, ["version", "line"], "full")
    return both.groupBy("version", "type").agg(F.bool_and(F.col("own").eqNullSafe(F.col("back"))).alias("same"))


def orphan_files(spark, d: str) -> DataFrame:
    """Rows of the files that no active entry names."""
    t = _table(spark, d)
    return _data(spark, t).join(t.orphans().select(_plain("path")), "path", "left_semi").agg(F.count("*").alias("rows"))


def diff_versions(spark, d: str) -> DataFrame:
    return _table(spark, d).diff_rows(4, 5).select("o_orderkey", "o_orderstatus", "change")


def diff_of_a_correction(spark, d: str) -> DataFrame:
    """A replacement that corrects the prices of one run of keys: only the ranges whose digests differ are read."""
    table = VersionedTable.create(spark, workspace(spark), digest=("o_orderkey", 512))
    orders = _orders(spark, d).repartitionByRange(16, "o_orderkey").sortWithinPartitions("o_orderkey")
    table.append(orders)
    table.replace(orders.withColumn("o_totalprice", F.when(F.col("o_orderkey").between(5000, 5100), F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))))
    return table.diff_rows(1, 2).select("o_orderkey", F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"), "change")


def _ledger(spark, d: str) -> DataFrame:
    """Orders as a ledger: each moves its price in cents from account 0 to its customer."""
    o = _orders(spark, d).select("o_custkey", (F.col("o_orderkey") % 4 + 1).alias("version"), F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"))
    return o.select("version", F.explode(F.array(F.struct(F.col("o_custkey").alias("account"), F.col("cents").alias("delta")), F.struct(F.lit(0).cast("long").alias("account"), (-F.col("cents")).alias("delta")))).alias("l")).select("version", "l.*")


def balances(spark, d: str) -> DataFrame:
    return versioned.balances(_ledger(spark, d))


def conservation_check(spark, d: str) -> DataFrame:
    return versioned.conservation(_ledger(spark, d), 0)


def running_balance_by_version(spark, d: str) -> DataFrame:
    return versioned.running_balances(_ledger(spark, d))


QUERIES = {
    f.__name__: f
    for f in (
        create_table, append, insert_and_commit, append_partitioned, path_partition_prune, point_lookup_by_log, name_lookup_by_log, range_by_log, replace, read_table, read_as_of, read_in_txn, commit_with_retry, detect_lost_updates, commit, table_history,
        table_detail, snapshot_files, active_file_rows, snapshot_metadata, files_matching, read_commit_log, actions_as_parquet, orphan_files, diff_versions, diff_of_a_correction, balances, conservation_check, running_balance_by_version,
    )
}

_COLUMNS = "o_orderkey, o_custkey, o_orderstatus, o_totalprice"
_LEDGER = "l AS (SELECT o_orderkey % 4 + 1 AS version, o_custkey AS account, CAST(round(o_totalprice * 100) AS BIGINT) AS delta FROM orders UNION ALL SELECT o_orderkey % 4 + 1, 0, -CAST(round(o_totalprice * 100) AS BIGINT) FROM orders)"

ORACLES = {
    "create_table": "SELECT t AS type, CASE t WHEN 'protocol' THEN CAST(1 AS INT) END AS minReaderVersion, CASE t WHEN 'protocol' THEN CAST(1 AS INT) END AS minWriterVersion, (SELECT count(*) FROM orders) AS orders FROM (VALUES ('protocol'), ('metadata')) AS v(t)",
    "append": "SELECT count(*) FILTER (o_orderstatus = 'O') AS rows, 'staged' AS at FROM orders UNION ALL SELECT count(*) FILTER (o_orderstatus IN ('O', 'P')), 'committed' FROM orders UNION ALL SELECT count(*) FILTER (o_orderstatus = 'O'), 'pinned' FROM orders",
    "insert_and_commit": f"SELECT {_COLUMNS} FROM orders",
    "append_partitioned": f"SELECT {_COLUMNS} FROM orders WHERE o_orderstatus = 'F'",
    "path_partition_prune": "SELECT o_orderstatus, count(*) AS orders, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS cents FROM orders WHERE o_orderstatus = 'P' GROUP BY 1",
    "point_lookup_by_log": "SELECT c_custkey, c_name FROM customer WHERE c_custkey = 42",
    "name_lookup_by_log": "SELECT c_custkey, c_name FROM customer WHERE c_name = 'Customer#000000077'",
    "range_by_log": "SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey BETWEEN 40 AND 90",
    "replace": "SELECT o_orderstatus, count(*) AS orders FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1",
    "read_table": f"SELECT {_COLUMNS} FROM orders WHERE o_orderstatus <> 'P'",
    "read_as_of": f"SELECT {_COLUMNS} FROM orders WHERE o_orderkey % 4 < 2",
    "read_in_txn": "SELECT o_orderstatus, count(*) AS orders FROM orders WHERE o_orderstatus = 'O' GROUP BY 1",
    "commit_with_retry": "SELECT o_orderstatus, count(*) AS orders, true AS refused FROM orders WHERE o_orderstatus IN ('O', 'F') GROUP BY 1",
    "commit": "SELECT CAST(v AS BIGINT) AS version, CASE WHEN v > 0 THEN 'WRITE' END AS operation, CASE WHEN v > 0 THEN CAST(v - 1 AS BIGINT) END AS read_version FROM range(6) AS u(v)",
    "snapshot_files": """SELECT count(*) FILTER (o_orderkey % 4 < 1) AS rows, CAST(1 AS INT) AS version FROM orders UNION ALL SELECT count(*) FILTER (o_orderkey % 4 < 3), 3 FROM orders UNION ALL SELECT count(*), 4 FROM orders
        UNION ALL SELECT count(*) FILTER (o_orderstatus <> 'P'), 5 FROM orders UNION ALL SELECT count(*) FILTER (o_orderstatus <> 'P'), 99 FROM orders""",
    "active_file_rows": f"SELECT {_COLUMNS} FROM orders WHERE o_orderkey % 4 < 3",
    "diff_versions": "SELECT o_orderkey, o_orderstatus, 'removed' AS change FROM orders WHERE o_orderstatus = 'P'",
    "diff_of_a_correction": """SELECT o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) AS cents, 'removed' AS change FROM orders WHERE o_orderkey BETWEEN 5000 AND 5100
        UNION ALL SELECT o_orderkey, CAST(round((o_totalprice + 1) * 100) AS BIGINT), 'added' FROM orders WHERE o_orderkey BETWEEN 5000 AND 5100""",
    "detect_lost_updates": "SELECT count(DISTINCT o_orderstatus) AS writers FROM orders WHERE o_orderstatus = 'F'",
    "table_history": "SELECT CAST(v AS BIGINT) AS version, CASE WHEN v > 0 THEN 'WRITE' END AS operation, CASE WHEN v > 0 THEN CAST(v - 1 AS BIGINT) END AS read_version, v > 0 AS adds, v = 5 AS removes FROM range(6) AS u(v)",
    "table_detail": "SELECT CAST(5 AS BIGINT) AS last_version, true AS files_agree, true AS bytes_agree, count(*) AS rows FROM orders WHERE o_orderstatus <> 'P'",
    "snapshot_metadata": "SELECT t AS type, CASE t WHEN 'protocol' THEN CAST(1 AS INT) END AS minReaderVersion, CASE t WHEN 'protocol' THEN CAST(1 AS INT) END AS minWriterVersion FROM (VALUES ('protocol'), ('metadata')) AS v(t)",
    "files_matching": "SELECT count(*) AS rows FROM orders WHERE o_orderstatus = 'F'",
    "read_commit_log": "SELECT CAST(v AS BIGINT) AS version, CASE WHEN v = 0 THEN 'protocol,metadata' WHEN v < 5 THEN 'commitInfo,add' ELSE 'commitInfo,remove,add' END AS kinds FROM range(6) AS u(v)",
    "actions_as_parquet": "SELECT CAST(v AS BIGINT) AS version, unnest(string_split(CASE WHEN v = 0 THEN 'protocol,metadata' WHEN v < 5 THEN 'commitInfo,add' ELSE 'commitInfo,remove,add' END, ',')) AS type, true AS same FROM range(6) AS u(v)",
    "orphan_files": "SELECT count(*) AS rows FROM orders",
    "balances": f"WITH {_LEDGER} SELECT account, CAST(sum(delta) AS BIGINT) AS balance FROM l GROUP BY account",
    "conservation_check": "SELECT o_orderkey % 4 + 1 AS version, CAST(0 AS BIGINT) AS total, true AS conserved FROM orders GROUP BY 1",
    "running_balance_by_version": f"WITH {_LEDGER}, e AS (SELECT account, version, sum(delta) AS delta FROM l GROUP BY ALL) SELECT account, version, CAST(sum(delta) OVER (PARTITION BY account ORDER BY version) AS BIGINT) AS balance FROM e",
}
