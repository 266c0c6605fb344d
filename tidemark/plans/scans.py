"""Queries of the scan family over the standard tables."""

from __future__ import annotations

import math
from functools import cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.columns import as_declared, bounded_name, csv_quoted, decode_statistic, java_hash, key_partition
from tidemark.operators import scan
from tidemark.sources import files

CUSTOMER = "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"


def _customer(spark, d: str) -> DataFrame:
    return files.scan_parquet(spark, f"{d}/customer.parquet", CUSTOMER)


def parallelize(spark, d: str) -> DataFrame:
    segments = files.parallelize(spark, [("BUILDING", 1), ("AUTOMOBILE", 2), ("MACHINERY", 3), ("HOUSEHOLD", 4), ("FURNITURE", 5)], "segment string, rank int")
    customers = _customer(spark, d).groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count("*").alias("customers"))
    return segments.join(customers, "segment").select("segment", "rank", "customers")


def scan_parquet(spark, d: str) -> DataFrame:
    return _customer(spark, d)


#: Rows of a file of many small row groups, whose sort and footer one task holds.
ROWS_PER_FILE = 250_000


@cache
def _grouped(app: str, d: str) -> str:
    """lineitem keys in order, as files of many small row groups: four, and more as the rows do; written once for each session."""
    from pyspark.sql import SparkSession

    spark = SparkSession.active()
    path = files.workspace(spark)
    lines = spark.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_quantity", "l_shipdate")
    rows = lines.repartitionByRange(max(4, math.ceil(lines.count() / ROWS_PER_FILE)), "l_orderkey").sortWithinPartitions("l_orderkey")
    files.write_parquet(rows, path, 16_384)
    return path


def _groups(spark, d: str) -> str:
    return _grouped(spark.sparkContext.applicationId, d)


LINES = T.StructType([T.StructField("l_orderkey", T.LongType()), T.StructField("l_quantity", T.DoubleType())])


def footer_metadata(spark, d: str) -> DataFrame:
    footers = files.footer_metadata(spark, _groups(spark, d))
    return footers.groupBy("column", "type", "repetition").agg(F.sum("rows").alias("rows"), F.sum("nulls").alias("nulls"))


def _pruned(spark, d: str, low=None, high=None) -> tuple[DataFrame, DataFrame]:
    footers = files.footer_metadata(spark, _groups(spark, d))
    return scan.prune(footers, "l_orderkey", low, high, "long"), footers


def _read_pruned(spark, d: str, where) -> DataFrame:
    """The filter goes to the Parquet reader, which skips row groups by their statistics."""
    return files.scan_parquet(spark, _groups(spark, d)).filter(where).select("l_orderkey", "l_quantity")


def scan_row_groups(spark, d: str) -> DataFrame:
    groups = files.footer_metadata(spark, _groups(spark, d)).select("path", "row_group").distinct()
    return files.scan_row_groups(spark, _groups(spark, d), groups, LINES)


def prune_min(spark, d: str) -> DataFrame:
    return _read_pruned(spark, d, F.col("l_orderkey") >= 14_000)


def prune_max(spark, d: str) -> DataFrame:
    return _read_pruned(spark, d, F.col("l_orderkey") <= 300)


def prune_point(spark, d: str) -> DataFrame:
    """A point in the order of strings."""
    path = files.workspace(spark)
    files.write_parquet(_customer(spark, d).repartitionByRange("c_name").sortWithinPartitions("c_name"), path, 16_384)
    return files.scan_parquet(spark, path, CUSTOMER).filter("c_name = 'Customer#000000077'").select("c_custkey", "c_name")


def prune_range(spark, d: str) -> DataFrame:
    return _read_pruned(spark, d, F.col("l_orderkey").between(500, 900))


def bytes_report(spark, d: str) -> DataFrame:
    groups, footers = _pruned(spark, d, low=14_000)
    return scan.bytes_report(groups, footers)


def column_bytes(spark, d: str) -> DataFrame:
    return scan.column_bytes(files.footer_metadata(spark, _groups(spark, d)))


def write_parquet(spark, d: str) -> DataFrame:
    path = files.workspace(spark)
    files.write_parquet(_customer(spark, d), path, 65_536)
    return spark.read.parquet(path)


def _order_maps(spark, d: str) -> DataFrame:
    """Orders as string maps; the priority is only there for open orders."""
    o = spark.read.parquet(f"{d}/orders.parquet")
    maps = files.to_maps(o.select("o_orderkey", "o_orderstatus", F.when(F.col("o_orderstatus") == "O", F.col("o_orderpriority")).alias("o_orderpriority")))
    return maps


def write_dynamic(spark, d: str) -> DataFrame:
    path = files.workspace(spark)
    files.write_parquet(files.from_maps(_order_maps(spark, d)), path)
    return files.read_dynamic(spark, path)


def read_dynamic(spark, d: str) -> DataFrame:
    return files.read_dynamic(spark, f"{d}/customer.parquet", scan.greater("c_custkey", "30")).select("c_custkey", "c_name", "c_mktsegment")


def csv_round_trip(spark, d: str) -> DataFrame:
    path = files.workspace(spark)
    part = spark.read.parquet(f"{d}/part.parquet").select("p_partkey", F.concat("p_name", F.lit(', "'), "p_brand", F.lit('"')).alias("p_label"), F.when(F.col("p_size") > 10, F.col("p_type")).alias("p_type"))
    files.write_csv(part, path)
    back = files.read_csv(spark, path, "p_partkey string, p_label string, p_type string")
    return back.select(F.col("p_partkey").cast("long").alias("p_partkey"), "p_label", F.coalesce("p_type", F.lit("")).alias("p_type"), csv_quoted(F.col("p_label")).alias("quoted"))


def read_range(spark, d: str) -> DataFrame:
    """Files of eight-digit keys, one a line: the first record (an offset below 0 is 0), the eleventh, what follows it, and past the end."""
    path = files.workspace(spark)
    keys = spark.read.parquet(f"{d}/part.parquet").select((F.col("p_partkey") % 8).alias("r"), F.lpad(F.col("p_partkey").cast("string"), 8, "0").alias("value"))
    keys.repartition("r").sortWithinPartitions("r", "value").write.partitionBy("r").text(path)
    part = lambda name, offset, length: files.read_range(spark, f"{path}/*/*.txt", offset, length).withColumnRenamed("bytes", name)
    slices = part("first", -3, 8).join(part("eleventh", 90, 8), "path").join(part("rest", 99, 0), "path").join(part("past", 1 << 40, 8), "path")
    text = lambda c: F.decode(c, "US-ASCII").alias(c)
    return slices.select(F.regexp_extract("path", "/r=([0-9]+)/", 1).cast("long").alias("r"), text("first"), text("eleventh"), F.length("rest").cast("long").alias("rest"), F.length("past").cast("long").alias("past"))


def ordered_collect(spark, d: str) -> DataFrame:
    """Results of a job in the order of their partitions and places, which an explicit order gives, not their arrival."""
    parts = spark.read.parquet(f"{d}/orders.parquet").select(F.floor(F.col("o_orderkey") / 1000).alias("part"), "o_orderkey").repartition("part")
    return scan.map_rows(parts, "part", "o_orderkey").orderBy("part", "o_orderkey")


def typed_fields(spark, d: str) -> DataFrame:
    """Text fields by their declared types; what is no scalar type stays text, and what isn't of its type is null."""
    o = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, F.lit("many")).otherwise(F.col("o_custkey").cast("string")).alias("v"))
    return o.select("o_orderkey", as_declared(F.col("v"), "long").alias("as_long"), as_declared(F.col("v"), "double").alias("as_double"), as_declared(F.col("v"), "array<int>").alias("as_text"))


def read_csv(spark, d: str) -> DataFrame:
    """A text file with blank lines and short rows: the lines vanish, the missing columns are null."""
    path = files.workspace(spark)
    part = spark.read.parquet(f"{d}/part.parquet")
    line = F.when(F.col("p_partkey") % 5 == 0, F.col("p_partkey").cast("string")).otherwise(F.concat_ws(",", F.col("p_partkey").cast("string"), "p_brand", "p_type"))
    rows = part.select(F.explode(F.when(F.col("p_partkey") % 7 == 0, F.array(line, F.lit(""))).otherwise(F.array(line))).alias("value"))
    rows.write.text(path)
    return files.read_csv(spark, path, "key string, brand string, type string", multi_line=False, header=False)


def list_objects(spark, d: str) -> DataFrame:
    p = spark.read.parquet(f"{d}/part.parquet")
    nodes = [p.filter(F.col("p_partkey") % 3 <= k).select(F.concat(F.col("p_type"), F.lit("/"), F.col("p_brand")).alias("key")) for k in range(3)]
    return files.list_objects(nodes, "S")


def map_(spark, d: str) -> DataFrame:
    return scan.map_rows(spark.read.parquet(f"{d}/lineitem.parquet"), "l_orderkey", "l_linenumber", F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")), 4).alias("net"))


def map_opaque(spark, d: str) -> DataFrame:
    c = _customer(spark, d).select("c_custkey", "c_name")
    return scan.map_pandas(c, lambda f: f.assign(c_name=f["c_name"].str[::-1]), "c_custkey long, c_name string")


def filter_(spark, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/lineitem.parquet").filter("l_quantity > 30").select("l_orderkey", "l_linenumber", "l_quantity")


def filter_map_job(spark, d: str) -> DataFrame:
    return scan.filter_map_job(_customer(spark, d), "c_acctbal", 5000.0, "%d|%s|%s", "c_custkey", "c_name", "c_mktsegment").orderBy("line")


def project(spark, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", "o_orderstatus")


def predicates(spark, d: str) -> DataFrame:
    c = files.read_dynamic(spark, f"{d}/customer.parquet")
    eq, gt = scan.equal("c_mktsegment", "BUILDING"), scan.greater("c_custkey", "30")
    return c.select("c_custkey", eq.alias("eq"), gt.alias("gt"), scan.both(eq, gt).alias("eq_and_gt"))


def point_lookup(spark, d: str) -> DataFrame:
    return _customer(spark, d).filter("c_custkey = 42").select("c_custkey", "c_name")


def prefix_filter(spark, d: str) -> DataFrame:
    return scan.prefixed(spark.read.parquet(f"{d}/part.parquet"), "p_type", "STANDARD").select("p_partkey", "p_type")


def by_status(spark, d: str) -> DataFrame:
    return scan.with_status(spark.read.parquet(f"{d}/orders.parquet"), "o_orderstatus", "P").select("o_orderkey", "o_custkey")


def feasible(spark, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/supplier.parquet").filter("s_acctbal > 0").select("s_suppkey", "s_name").orderBy("s_name")


def validate_rows(spark, d: str) -> DataFrame:
    o = spark.read.parquet(f"{d}/orders.parquet").select(
        F.col("o_orderkey").cast("string").alias("id"),
        F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderstatus")).alias("status"),
        F.when(F.col("o_orderkey") % 5 == 0, F.lit("many")).otherwise((F.col("o_custkey") % 9 - 1).cast("string")).alias("replicas"),
    )
    checked = scan.validate_rows(o, {"replicas": "int"}, required=("status",), positive=("replicas",))
    return checked.select("id", (F.size("reasons") == 0).alias("valid"), F.array_join("reasons", "; ").alias("reasons"))


def latency_histogram(spark, d: str) -> DataFrame:
    return scan.latency_histogram(spark.read.parquet(f"{d}/events.parquet"), "value")


def key_hash(spark, d: str) -> DataFrame:
    c = _customer(spark, d)
    return c.select("c_custkey", java_hash(F.col("c_name")).alias("hash"), key_partition(F.col("c_name"), 12).alias("partition"), bounded_name(F.col("c_name")).alias("short"), decode_statistic(F.concat(F.lit("0x"), F.hex(F.encode("c_name", "utf-8")))).alias("decoded"))


def first_n(spark, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", "o_totalprice").orderBy("o_orderkey").limit(20)


_HASH = "list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(string_split({}, ''), lambda x: CAST(unicode(x) AS BIGINT))), lambda a, b: (a * 31 + b) % 4294967296)"
JAVA_HASH = "(CASE WHEN {h} >= 2147483648 THEN {h} - 4294967296 ELSE {h} END)"


def sql_hash(column: str) -> str:
    return JAVA_HASH.format(h=_HASH.format(column))


_BOUNDS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1, 2.5, 5, 10)

QUERIES = {
    "parallelize": parallelize,
    "scan_parquet": scan_parquet,
    "scan_row_groups": scan_row_groups,
    "write_parquet": write_parquet,
    "write_dynamic": write_dynamic,
    "read_dynamic": read_dynamic,
    "footer_metadata": footer_metadata,
    "csv_round_trip": csv_round_trip,
    "read_range": read_range,
    "ordered_collect": ordered_collect,
    "typed_fields": typed_fields,
    "read_csv": read_csv,
    "list_objects": list_objects,
    "map": map_,
    "map_opaque": map_opaque,
    "filter": filter_,
    "filter_map_job": filter_map_job,
    "project": project,
    "predicates": predicates,
    "prune_min": prune_min,
    "prune_max": prune_max,
    "prune_point": prune_point,
    "prune_range": prune_range,
    "bytes_report": bytes_report,
    "column_bytes": column_bytes,
    "point_lookup": point_lookup,
    "prefix_filter": prefix_filter,
    "by_status": by_status,
    "feasible": feasible,
    "validate_rows": validate_rows,
    "latency_histogram": latency_histogram,
    "key_partition": key_hash,
    "first_n": first_n,
}

_LINES = "SELECT l_orderkey, l_quantity FROM lineitem WHERE "
ORACLES = {
    "parallelize": """SELECT segment, rank, count(*) AS customers FROM customer
        JOIN (VALUES ('BUILDING', 1), ('AUTOMOBILE', 2), ('MACHINERY', 3), ('HOUSEHOLD', 4), ('FURNITURE', 5)) AS s(segment, rank) ON c_mktsegment = segment GROUP BY segment, rank""",
    "scan_parquet": "SELECT * FROM customer",
    "write_parquet": "SELECT * FROM customer",
    "write_dynamic": "SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CASE WHEN o_orderstatus = 'O' THEN o_orderpriority END AS o_orderpriority, o_orderstatus FROM orders",
    "read_dynamic": "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, c_mktsegment FROM customer WHERE CAST(c_custkey AS VARCHAR) > '30'",
    "csv_round_trip": """SELECT p_partkey, p_name || ', "' || p_brand || '"' AS p_label, CASE WHEN p_size > 10 THEN p_type ELSE '' END AS p_type,
        '"' || replace(p_name || ', "' || p_brand || '"', '"', '""') || '"' AS quoted FROM part""",
    "read_range": """WITH k AS (SELECT p_partkey % 8 AS r, list(lpad(CAST(p_partkey AS VARCHAR), 8, '0') ORDER BY p_partkey) AS v FROM part GROUP BY 1)
        SELECT r, v[1] AS first, coalesce(v[11], '') AS eleventh, greatest(CAST(len(v) AS BIGINT) - 11, 0) * 9 AS rest, CAST(0 AS BIGINT) AS past FROM k""",
    "ordered_collect": "SELECT CAST(o_orderkey // 1000 AS BIGINT) AS part, o_orderkey FROM orders ORDER BY part, o_orderkey",
    "typed_fields": """SELECT o_orderkey, try_cast(v AS BIGINT) AS as_long, try_cast(v AS DOUBLE) AS as_double, v AS as_text
        FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'many' ELSE CAST(o_custkey AS VARCHAR) END AS v FROM orders)""",
    "read_csv": "SELECT CAST(p_partkey AS VARCHAR) AS key, CASE WHEN p_partkey % 5 <> 0 THEN p_brand END AS brand, CASE WHEN p_partkey % 5 <> 0 THEN p_type END AS type FROM part",
    "scan_row_groups": "SELECT l_orderkey, l_quantity FROM lineitem",
    "footer_metadata": "SELECT c AS \"column\", t AS type, 'OPTIONAL' AS repetition, (SELECT count(*) FROM lineitem) AS rows, CAST(0 AS BIGINT) AS nulls FROM (VALUES ('l_orderkey', 'INT64'), ('l_quantity', 'DOUBLE'), ('l_shipdate', 'INT64')) AS v(c, t)",
    "list_objects": "SELECT DISTINCT p_type || '/' || p_brand AS key FROM part WHERE starts_with(p_type, 'S') ORDER BY key",
    "map": "SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS net FROM lineitem",
    "map_opaque": "SELECT c_custkey, reverse(c_name) AS c_name FROM customer",
    "filter": "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity > 30",
    "filter_map_job": "SELECT c_custkey || '|' || c_name || '|' || c_mktsegment AS line FROM customer WHERE c_acctbal >= 5000 ORDER BY line",
    "project": "SELECT o_orderkey, o_orderstatus FROM orders",
    "predicates": """SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_mktsegment = 'BUILDING' AS eq, CAST(c_custkey AS VARCHAR) > '30' AS gt,
        c_mktsegment = 'BUILDING' AND CAST(c_custkey AS VARCHAR) > '30' AS eq_and_gt FROM customer""",
    "prune_min": _LINES + "l_orderkey >= 14000",
    "prune_max": _LINES + "l_orderkey <= 300",
    "prune_point": "SELECT c_custkey, c_name FROM customer WHERE c_name = 'Customer#000000077'",
    "prune_range": _LINES + "l_orderkey BETWEEN 500 AND 900",
    "point_lookup": "SELECT c_custkey, c_name FROM customer WHERE c_custkey = 42",
    "prefix_filter": "SELECT p_partkey, p_type FROM part WHERE starts_with(p_type, 'STANDARD')",
    "by_status": "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'P'",
    "feasible": "SELECT s_suppkey, s_name FROM supplier WHERE s_acctbal > 0 ORDER BY s_name",
    "validate_rows": """WITH r AS (SELECT CAST(o_orderkey AS VARCHAR) AS id, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderstatus END AS status,
          CASE WHEN o_orderkey % 5 = 0 THEN 'many' ELSE CAST(o_custkey % 9 - 1 AS VARCHAR) END AS replicas FROM orders),
        c AS (SELECT id, list_filter([CASE WHEN status IS NULL THEN 'status is missing' END, CASE WHEN try_cast(replicas AS INT) IS NULL THEN 'replicas is not int' END,
          CASE WHEN try_cast(replicas AS DOUBLE) < 0 THEN 'replicas is negative' END], lambda x: x IS NOT NULL) AS why FROM r)
        SELECT id, len(why) = 0 AS valid, array_to_string(why, '; ') AS reasons FROM c""",
    "latency_histogram": " UNION ALL ".join(f"SELECT CAST({b} AS DOUBLE) AS bound, count(*) FILTER (value <= {b}) AS count FROM events" for b in _BOUNDS) + " UNION ALL SELECT CAST(NULL AS DOUBLE), count(value) FROM events",
    "key_partition": f"""SELECT c_custkey, {sql_hash('c_name')} AS hash, CAST((({sql_hash('c_name')} % 12) + 12) % 12 AS INT) AS partition,
        substr(c_name, 1, 58) || substr(sha256(c_name), 1, 5) AS short, c_name AS decoded FROM customer""",
    "first_n": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 20",
}
