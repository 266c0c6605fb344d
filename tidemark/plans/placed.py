"""Queries of placement, durability and reconciliation over the standard tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import crc_set, key_partition
from tidemark.operators import placement, recon
from tidemark.plans.scans import sql_hash
from tidemark.sources import files


def _read(spark, d: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{table}.parquet")


def _keys(spark, d: str) -> DataFrame:
    return _read(spark, d, "customer").select(F.col("c_name").alias("key"), key_partition(F.col("c_name"), 3).alias("three"), key_partition(F.col("c_name"), 4).alias("four"), (key_partition(F.col("c_name"), 12)).alias("p"))


def count_per_partition(spark, d: str) -> DataFrame:
    return placement.distribution(_keys(spark, d), "p").select("p", "keys", F.round("share", 6).alias("share"))


def churn_report(spark, d: str) -> DataFrame:
    return placement.churn(_keys(spark, d), "three", "four").select("moved", "stayed", F.round("moved_percent", 6).alias("moved_percent"))


def placement_diff(spark, d: str) -> DataFrame:
    return _keys(spark, d).filter("three <> four").select("key", "three", "four")


def _partitions(spark, d: str) -> DataFrame:
    """One partition for each part."""
    return _read(spark, d, "part").select(F.col("p_partkey").alias("p")).distinct()


def assign_replicas(spark, d: str) -> DataFrame:
    placed = placement.assign_replicas(_partitions(spark, d), list(range(5)), 3, start=1, shift=2)
    return placed.select("p", F.array_join("replicas", ",").alias("replicas"))


def _brokers(spark, d: str) -> DataFrame:
    return _read(spark, d, "supplier").filter("s_suppkey < 5 and s_suppkey <> 3").select(F.col("s_suppkey").alias("broker"), F.col("s_name").alias("host"))


def assignment_with_brokers(spark, d: str) -> DataFrame:
    placed = placement.assign_replicas(_partitions(spark, d), list(range(5)), 3, start=1, shift=2).select("p", F.posexplode("replicas").alias("nth", "broker"))
    return placed.join(_brokers(spark, d), "broker", "left").select("p", "nth", F.col("broker").cast("int").alias("broker"), F.coalesce("host", F.lit("unknown")).alias("host"))


def select_leaders(spark, d: str) -> DataFrame:
    placed = placement.assign_replicas(_partitions(spark, d), list(range(5)), 3, start=1, shift=2)
    return placed.select("p", F.element_at("replicas", 1).alias("leader"))


def leaders_per_broker(spark, d: str) -> DataFrame:
    return select_leaders(spark, d).groupBy("leader").agg(F.count("*").alias("partitions"))


def rebalance_fixed_partitions(spark, d: str) -> DataFrame:
    held = spark.range(12).select(F.col("id").cast("int").alias("p")).withColumn("owner", placement.ranged_owner("p", 12, 3))
    moved = placement.rebalance(held, 3, 12)
    keys = _keys(spark, d).groupBy("p").agg(F.count("*").alias("keys"))
    both = moved.join(keys, "p", "left").withColumn("keys", F.coalesce("keys", F.lit(0)))
    m = F.col("owner") != F.col("new_owner")
    return both.agg(F.count_if(m).alias("partitions_moved"), F.sum(F.when(m, F.col("keys")).otherwise(0)).alias("keys_moved"), F.sum("keys").alias("keys"))


def place_objects(spark, d: str) -> DataFrame:
    """How objects spread over four sets by each rule, and how many another deployment id moves."""
    keys = _read(spark, d, "part").select(F.concat(F.lit("datasets/"), "p_type", F.lit("/"), F.col("p_partkey").cast("string")).alias("key"))
    one = placement.place_objects(keys, 4, b"deployment-id-01")
    two = placement.place_objects(one.withColumnRenamed("set", "one"), 4, b"deployment-id-02")
    three = placement.place_objects(two.withColumnRenamed("set", "two"), 4)
    return three.groupBy(F.col("set").alias("by_checksum"), "one").agg(F.count("*").alias("objects"), F.count_if(F.col("one") != F.col("two")).alias("moved"))


def route_to_set(spark, d: str) -> DataFrame:
    """Each key with the nodes of its set; four sets of four drives, so the lookup table has four rows of four names."""
    keys = placement.place_objects(_read(spark, d, "part").select(F.col("p_name").alias("key")), 4)
    nodes = _read(spark, d, "supplier").filter("s_suppkey < 16").groupBy((F.col("s_suppkey") % 4).cast("int").alias("set")).agg(F.array_sort(F.collect_list("s_name")).alias("nodes"))
    return keys.join(F.broadcast(nodes), "set").select("key", "set", F.array_join("nodes", ",").alias("nodes"))


def all_nodes(spark, d: str) -> DataFrame:
    """The nodes of all partitions' replicas, leaders and followers in lists of their own: the distinct union of nested lists."""
    placed = placement.assign_replicas(_partitions(spark, d), list(range(5)), 3, start=1, shift=2)
    nested = placed.select(F.array(F.slice("replicas", 1, 1), F.slice("replicas", 2, 2)).alias("lists"))
    return placement.all_nodes(nested, "lists").withColumn("node", F.col("node").cast("int"))


def sorted_keys(spark, d: str) -> DataFrame:
    """The listing of stored keys, in the order of the keys."""
    return _read(spark, d, "part").select(F.concat("p_type", F.lit("/"), "p_brand").alias("key")).distinct().orderBy("key")


def crc_mod(spark, d: str) -> DataFrame:
    """The set of each key by its checksum."""
    return _read(spark, d, "part").select("p_partkey", crc_set(F.col("p_name"), 7).alias("set"))


def _shards(spark, d: str) -> DataFrame:
    docs = _read(spark, d, "documents").select(F.col("doc_id").alias("object"), "n_chars")
    return docs.select("object", "n_chars", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("shard")).withColumn("node", (F.col("object") * 7 + F.col("shard") * 3) % 16)


def shard_quorum(spark, d: str) -> DataFrame:
    dead = _shards(spark, d).filter("node % 5 = 0").select("node")
    return placement.shard_quorum(_shards(spark, d), dead, 4)


def storage_overhead(spark, d: str) -> DataFrame:
    return placement.storage_overhead(_read(spark, d, "documents").select(F.col("n_chars").alias("size")), 4, 2)


def _versions(spark, d: str) -> DataFrame:
    return _read(spark, d, "orders").select(
        F.col("o_custkey").cast("string").alias("key"), F.col("o_orderkey").alias("version_id"), F.floor(F.col("o_orderkey") / 3).alias("mod_time"), (F.col("o_orderstatus") == "F").alias("deleted"), F.length("o_orderpriority").cast("long").alias("size")
    )


def latest_object_version(spark, d: str) -> DataFrame:
    return files.latest_versions(_versions(spark, d))


def object_versions(spark, d: str) -> DataFrame:
    """Versions and markers appended to a table of versions, then the listing with and without markers."""
    path = files.workspace(spark)
    v = _versions(spark, d)
    v.filter("not deleted").write.parquet(path)
    v.filter("deleted").write.mode("append").parquet(path)
    stored = spark.read.parquet(path)
    live = files.latest_versions(stored).select("key", F.lit(True).alias("readable"))
    return stored.select("key").distinct().join(live, "key", "left").select("key", F.coalesce("readable", F.lit(False)).alias("readable"))


def _blobs(spark, d: str) -> DataFrame:
    return _read(spark, d, "documents").select(F.col("doc_id").alias("object"), F.encode("text", "utf-8").alias("content"))


def shard_objects(spark, d: str) -> DataFrame:
    shards = placement.shard_objects(_blobs(spark, d), 4, 2, 4096)
    return shards.groupBy("shard").agg(F.count("*").alias("blocks"), F.sum(F.length("bytes")).alias("bytes"))


def repair_objects(spark, d: str) -> DataFrame:
    """Every object after the loss of two shards (three of every hundredth): whether all its blocks read back to the same bytes."""
    blobs = _blobs(spark, d)
    lost = (F.col("shard") == F.col("object") % 6) | (F.col("shard") == (F.col("object") + 2) % 6) | ((F.col("object") % 100 == 0) & (F.col("shard") == (F.col("object") + 3) % 6))
    repaired = placement.repair_objects(placement.shard_objects(blobs, 4, 2, 4096).filter(~lost), 4, 2)
    back = repaired.select("object", "block", (F.col("status") == "lost").alias("lost"), F.sha2("bytes", 256).alias("back"))
    source = placement.blocks_of(blobs, 4096).select("object", "block", F.sha2("bytes", 256).alias("sha"))
    same = F.when(~F.col("lost"), F.col("back") == F.col("sha"))
    return source.join(back, ["object", "block"], "left").groupBy("object").agg(F.bool_or(F.coalesce("lost", F.lit(True))).alias("lost"), F.bool_and(same).alias("same"))


def scrub_parity(spark, d: str) -> DataFrame:
    """Every block after one bit of shard 5 was turned in every tenth object."""
    shards = placement.shard_objects(_blobs(spark, d), 4, 2, 4096)
    turned = F.concat(F.unhex(F.lpad(F.hex(F.conv(F.hex(F.substring(F.col("bytes"), F.lit(1), F.lit(1))), 16, 10).cast("long").bitwiseXOR(F.lit(1))), 2, "0")), F.expr("substring(bytes, 2)"))
    bad = shards.withColumn("bytes", F.when((F.col("object") % 10 == 0) & (F.col("shard") == 5), turned).otherwise(F.col("bytes")))
    return placement.scrub_parity(bad, 4, 2)


def _changes(spark, d: str) -> DataFrame:
    o = _read(spark, d, "orders")
    return o.select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("revision"), F.when(F.col("o_orderstatus") == "F", "delete").otherwise("put").alias("op"), F.col("o_orderpriority").alias("value"))


def with_previous_value(spark, d: str) -> DataFrame:
    return recon.with_previous_value(_changes(spark, d)).select("key", "revision", "event", "previous")


def classify_changes(spark, d: str) -> DataFrame:
    return recon.classify_changes(_changes(spark, d)).select("key", "revision", "kind")


def materialize_feed(spark, d: str) -> DataFrame:
    return recon.materialize(_changes(spark, d))


def _owners(spark, d: str) -> DataFrame:
    p = _read(spark, d, "part")
    return p.groupBy(F.substring("p_type", 1, 3).alias("owner")).agg((F.count("*") % 40 + 300).cast("int").alias("wanted"))


def _items(spark, d: str) -> DataFrame:
    return _read(spark, d, "part").select(F.concat("p_type", F.lit("-"), F.lpad(F.col("p_partkey").cast("string"), 7, "0")).alias("name"), "p_size")


def _owned(spark, d: str) -> DataFrame:
    return recon.owned_by(_items(spark, d).filter("p_size <> 1"), _owners(spark, d).select("owner"))


def owned_by(spark, d: str) -> DataFrame:
    return _owned(spark, d).select("owner", "name")


def desired_vs_actual(spark, d: str) -> DataFrame:
    return recon.desired_vs_actual(_owners(spark, d), _owned(spark, d))


def scale_down_victims(spark, d: str) -> DataFrame:
    plan = recon.desired_vs_actual(_owners(spark, d), _owned(spark, d))
    return recon.scale_down_victims(_owned(spark, d).select("owner", "name"), plan.select("owner", (-F.col("difference")).alias("excess")))


def reconcile(spark, d: str) -> DataFrame:
    return recon.reconcile(_owners(spark, d), _owned(spark, d), containers=2)


def _nodes(spark, d: str) -> DataFrame:
    loads = _read(spark, d, "lineitem").filter("l_quantity > 45").groupBy("l_suppkey").agg(F.count("*").alias("n"))
    s = _read(spark, d, "supplier")
    return s.join(loads, s["s_suppkey"] == loads["l_suppkey"], "left").select(F.col("s_name").alias("node"), F.coalesce("n", F.lit(0)).alias("running"))


def pods_per_node(spark, d: str) -> DataFrame:
    pods = _read(spark, d, "lineitem").select(F.when(F.col("l_quantity") > 45, F.col("l_suppkey")).alias("node"))
    return pods.filter("node is not null").groupBy("node").agg(F.count("*").alias("pods"))


def score_nodes(spark, d: str) -> DataFrame:
    return recon.score_nodes(_nodes(spark, d))


def select_host(spark, d: str) -> DataFrame:
    return recon.select_host(recon.score_nodes(_nodes(spark, d)))


def balanced_assign(spark, d: str) -> DataFrame:
    items = _read(spark, d, "orders").filter("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("item"))
    return recon.balanced_assign(items, _nodes(spark, d).select(F.col("node").alias("worker"), F.col("running").alias("load")))


def rollup_status(spark, d: str) -> DataFrame:
    """Line items as containers of their order."""
    li = _read(spark, d, "lineitem").select("l_orderkey", (F.col("l_linenumber") % 5 != 0).alias("e"), ((F.col("l_linestatus") == "O") & (F.col("l_quantity") > 35)).alias("r"), F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("x"))
    return li.groupBy("l_orderkey").agg(recon.rollup_status(F.col("e"), F.col("r"), F.col("x")).alias("status"))


def new_topics(spark, d: str) -> DataFrame:
    """Types of parts that no part of the known ones has."""
    p = _read(spark, d, "part")
    return p.select("p_type").subtract(p.filter("p_size < 2 and p_partkey % 7 = 3").select("p_type"))


def membership_change(spark, d: str) -> DataFrame:
    o = _read(spark, d, "orders").select(F.col("o_custkey").alias("member"), "o_orderdate")
    return recon.membership_change(o.filter("o_orderdate < '1995-01-01'"), o.filter("o_orderdate >= '1995-01-01'"), "member")


def union_files(spark, d: str) -> DataFrame:
    c, s = _read(spark, d, "customer"), _read(spark, d, "supplier")
    return c.select(F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment")).unionByName(s.select(F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance")), allowMissingColumns=True)


def distinct_keys(spark, d: str) -> DataFrame:
    o, li = _read(spark, d, "orders"), _read(spark, d, "lineitem")
    return o.select(F.col("o_orderkey").alias("key")).union(li.select("l_orderkey")).distinct()


QUERIES = {
    f.__name__: f
    for f in (
        count_per_partition, churn_report, placement_diff, assign_replicas, assignment_with_brokers, select_leaders, leaders_per_broker, rebalance_fixed_partitions, place_objects, route_to_set,
        shard_quorum, storage_overhead, latest_object_version, object_versions, shard_objects, repair_objects, scrub_parity, with_previous_value, classify_changes, materialize_feed, owned_by,
        all_nodes, sorted_keys, crc_mod, desired_vs_actual, scale_down_victims, reconcile, pods_per_node, score_nodes, select_host, balanced_assign, rollup_status, new_topics, membership_change, union_files, distinct_keys,
    )
}

_MOD = "((({h} % {n}) + {n}) % {n})"


def _part(n: int) -> str:
    return f"CAST({_MOD.format(h=sql_hash('c_name'), n=n)} AS INT)"


_KEYS = f"k AS (SELECT c_name AS key, {_part(3)} AS three, {_part(4)} AS four, {_part(12)} AS p FROM customer)"
_LEAD = "(p + 1) % 5"
_REPLICAS = "r AS (SELECT p, [(p + 1) % 5, ((p + 1) % 5 + 1 + (2 + p // 5) % 4) % 5, ((p + 1) % 5 + 1 + (2 + p // 5 + 1) % 4) % 5] AS l FROM (SELECT DISTINCT p_partkey AS p FROM part))"
_CHANGES = "c AS (SELECT o_custkey AS key, o_orderkey AS revision, CASE WHEN o_orderstatus = 'F' THEN 'delete' ELSE 'put' END AS op, o_orderpriority AS value FROM orders)"
_OWNED = """o AS (SELECT substr(p_type, 1, 3) AS owner, CAST(count(*) % 40 + 300 AS INT) AS wanted FROM part GROUP BY 1),
 i AS (SELECT p_type || '-' || lpad(CAST(p_partkey AS VARCHAR), 7, '0') AS name FROM part WHERE p_size <> 1),
 owned AS (SELECT owner, name FROM i JOIN o ON starts_with(name, owner)),
 plan AS (SELECT o.owner, o.wanted, coalesce(a.n, 0) AS active, o.wanted - coalesce(a.n, 0) AS difference FROM o LEFT JOIN (SELECT owner, count(*) AS n FROM owned GROUP BY owner) a USING (owner)),
 victims AS (SELECT owner, name FROM (SELECT owner, name, difference, row_number() OVER (PARTITION BY owner ORDER BY name DESC) AS k FROM owned JOIN plan USING (owner)) WHERE k <= -difference)"""
_NODES = "n AS (SELECT s_name AS node, coalesce(c, 0) AS running FROM supplier LEFT JOIN (SELECT l_suppkey, count(*) AS c FROM lineitem WHERE l_quantity > 45 GROUP BY 1) ON s_suppkey = l_suppkey)"
_SCORED = _NODES + ", sc AS (SELECT node, running, 100 * (m - running) // m AS score FROM n, (SELECT max(running) + 1 AS m FROM n))"
_VERSIONS = "v AS (SELECT CAST(o_custkey AS VARCHAR) AS key, o_orderkey AS version_id, o_orderkey // 3 AS mod_time, o_orderstatus = 'F' AS deleted, CAST(length(o_orderpriority) AS BIGINT) AS size FROM orders), latest AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY key ORDER BY mod_time DESC, version_id DESC) = 1)"

_BLOCKS = """l AS (SELECT doc_id AS object, strlen(text) AS n FROM documents),
 b AS (SELECT object, CAST(k AS INT) AS block, least(4096, n - k * 4096) AS size FROM l, unnest(range(0, greatest((n + 4095) // 4096, 1))) AS u(k))"""

ORACLES = {
    "count_per_partition": f"WITH {_KEYS} SELECT p, count(*) AS keys, round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS share FROM k GROUP BY p",
    "churn_report": f"WITH {_KEYS} SELECT count(*) FILTER (three <> four) AS moved, count(*) FILTER (three = four) AS stayed, round(CAST(count(*) FILTER (three <> four) AS DOUBLE) * 100 / count(*), 6) AS moved_percent FROM k",
    "placement_diff": f"WITH {_KEYS} SELECT key, three, four FROM k WHERE three <> four",
    "assign_replicas": f"WITH {_REPLICAS} SELECT p, array_to_string(l, ',') AS replicas FROM r",
    "assignment_with_brokers": f"""WITH {_REPLICAS}, e AS (SELECT p, CAST(n - 1 AS INT) AS nth, CAST(l[n] AS INT) AS broker FROM r, range(1, 4) AS u(n))
        SELECT p, nth, broker, coalesce(s_name, 'unknown') AS host FROM e LEFT JOIN (SELECT * FROM supplier WHERE s_suppkey < 5 AND s_suppkey <> 3) ON s_suppkey = broker""",
    "select_leaders": f"SELECT DISTINCT p_partkey AS p, CAST((p_partkey + 1) % 5 AS INT) AS leader FROM part",
    "leaders_per_broker": "SELECT CAST((p + 1) % 5 AS INT) AS leader, count(*) AS partitions FROM (SELECT DISTINCT p_partkey AS p FROM part) GROUP BY 1",
    "rebalance_fixed_partitions": f"WITH {_KEYS} SELECT CAST(3 AS BIGINT) AS partitions_moved, count(*) FILTER (p % 4 = 3) AS keys_moved, count(*) AS keys FROM k",
    "shard_quorum": """WITH s AS (SELECT doc_id AS object, (doc_id * 7 + k * 3) % 16 AS node FROM documents, range(6) AS u(k)), c AS (SELECT object, count(*) FILTER (node % 5 <> 0) AS available FROM s GROUP BY object)
        SELECT object, available, CASE WHEN available < 4 THEN 'lost' WHEN available < 6 THEN 'at_risk' ELSE 'readable' END AS state FROM c""",
    "storage_overhead": "SELECT CAST(sum(n_chars) AS BIGINT) AS bytes, CAST(sum(n_chars * 3) AS BIGINT) AS replicated, CAST(sum((n_chars + 3) // 4 * 6) AS BIGINT) AS coded FROM documents",
    "latest_object_version": f"WITH {_VERSIONS} SELECT * FROM latest WHERE NOT deleted",
    "object_versions": f"WITH {_VERSIONS} SELECT key, NOT deleted AS readable FROM latest",
    "all_nodes": f"WITH {_REPLICAS} SELECT DISTINCT CAST(unnest(l) AS INT) AS node FROM r",
    "sorted_keys": "SELECT DISTINCT p_type || '/' || p_brand AS key FROM part ORDER BY key",
    "shard_objects": f"WITH {_BLOCKS} SELECT CAST(k AS INT) AS shard, count(*) AS blocks, CAST(sum(greatest((size + 3) // 4, 1)) AS BIGINT) AS bytes FROM b, range(6) AS u(k) GROUP BY k",
    "repair_objects": "SELECT doc_id AS object, doc_id % 100 = 0 AS lost, CASE WHEN doc_id % 100 <> 0 THEN true END AS same FROM documents",
    "scrub_parity": f"WITH {_BLOCKS} SELECT object, block, object % 10 <> 0 AS intact FROM b",
    "with_previous_value": f"""WITH {_CHANGES}, p AS (SELECT *, CASE WHEN lag(op) OVER w = 'delete' THEN NULL ELSE lag(value) OVER w END AS previous FROM c WINDOW w AS (PARTITION BY key ORDER BY revision))
        SELECT key, revision, CASE WHEN op = 'delete' THEN 'DELETE' WHEN previous IS NULL THEN 'ADD' ELSE 'UPDATE' END AS event, previous FROM p""",
    "classify_changes": f"""WITH {_CHANGES}, p AS (SELECT *, lag(op) OVER (PARTITION BY key ORDER BY revision) AS before FROM c)
        SELECT key, revision, CASE WHEN op = 'delete' THEN 'Deleted' WHEN before IS NULL OR before = 'delete' THEN 'Added' ELSE 'Modified' END AS kind FROM p""",
    "materialize_feed": f"WITH {_CHANGES} SELECT key, value, revision FROM (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY key ORDER BY revision DESC) = 1) WHERE op <> 'delete'",
    "owned_by": f"WITH {_OWNED} SELECT owner, name FROM owned",
    "desired_vs_actual": f"WITH {_OWNED} SELECT owner, wanted, active, difference FROM plan",
    "scale_down_victims": f"WITH {_OWNED} SELECT owner, name FROM victims",
    "reconcile": f"""WITH {_OWNED} SELECT owner, name, CASE WHEN v.name IS NULL THEN 'keep' ELSE 'delete' END AS action FROM owned LEFT JOIN victims v USING (owner, name)
        UNION ALL SELECT owner, owner || '-new-' || k, 'create' FROM plan, unnest(range(1, greatest(difference, 0) * 2 + 1)) AS u(k)""",
    "pods_per_node": "SELECT l_suppkey AS node, count(*) AS pods FROM lineitem WHERE l_quantity > 45 GROUP BY 1",
    "score_nodes": f"WITH {_SCORED} SELECT node, running, score FROM sc",
    "select_host": f"WITH {_SCORED} SELECT node, score FROM sc ORDER BY score DESC, node LIMIT 1",
    "balanced_assign": f"""WITH {_NODES}, items AS (SELECT o_orderkey AS item, row_number() OVER (ORDER BY o_orderkey) AS k FROM orders WHERE o_orderstatus = 'P'),
        places AS (SELECT node AS worker, level, row_number() OVER (ORDER BY level, node) AS k FROM n, unnest(range(running, running + (SELECT count(*) + 1 FROM items))) AS u(level))
        SELECT item, worker, level FROM items JOIN places USING (k)""",
    "rollup_status": """WITH c AS (SELECT l_orderkey, l_linenumber % 5 <> 0 AS e, l_linestatus = 'O' AND l_quantity > 35 AS r, CASE WHEN l_linenumber % 5 <> 0 AND l_returnflag = 'R' THEN 1 ELSE 0 END AS x FROM lineitem)
        SELECT l_orderkey, CASE WHEN bool_or(e AND r) THEN 'Running' WHEN bool_or(e) AND min(x) = 1 THEN 'Failed' WHEN max(x) = 0 THEN 'Succeeded' ELSE 'Scheduled' END AS status FROM c GROUP BY 1""",
    "new_topics": "SELECT p_type FROM part EXCEPT SELECT p_type FROM part WHERE p_size < 2 AND p_partkey % 7 = 3",
    "membership_change": """WITH a AS (SELECT DISTINCT o_custkey AS member FROM orders WHERE o_orderdate < TIMESTAMP '1995-01-01'), b AS (SELECT DISTINCT o_custkey AS member FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01')
        SELECT member, 'joined' AS change FROM b ANTI JOIN a USING (member) UNION ALL SELECT member, 'left' FROM a ANTI JOIN b USING (member)""",
    "union_files": "SELECT c_name AS name, c_acctbal AS balance, c_mktsegment AS segment FROM customer UNION ALL SELECT s_name, s_acctbal, NULL FROM supplier",
    "distinct_keys": "SELECT o_orderkey AS key FROM orders UNION SELECT l_orderkey FROM lineitem",
}
