"""Change feeds, and desired against actual state."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.prefix import Ranges, last


def with_previous_value(changes: DataFrame, ranges: Ranges | None = None) -> DataFrame:
    """changes (key, revision, op, value) with `previous` and `event`: ADD where the key had no value, UPDATE, DELETE.

    A null key is a key; a null revision comes first. A hot key is many tasks.
    """
    ranges = ranges or Ranges(changes, ["key"], "revision")
    rows = ranges.running(changes, {"before_": last(F.struct("op", "value"))}, before=True)
    gone = F.coalesce(F.col("before_.op") == "delete", F.lit(False))
    event = F.when(F.col("op") == "delete", "DELETE").when(F.col("previous").isNull(), "ADD").otherwise("UPDATE")
    return rows.withColumn("previous", F.when(~gone, F.col("before_.value"))).withColumn("event", event).drop("before_")


def classify_changes(changes: DataFrame, ranges: Ranges | None = None) -> DataFrame:
    """changes with `created` (the first revision since the last delete) and `kind`: Added, Modified or Deleted.

    A life begins with the first put of a key, or the first after a delete; a delete without a life has no `created`.
    """
    ranges = ranges or Ranges(changes, ["key"], "revision")
    gone = F.col("op") == "delete"
    rows = ranges.running(changes, {"before_": last(F.struct("op"))}, before=True)
    fresh = F.coalesce(F.col("before_.op") == "delete", F.lit(True))  # nothing stands before this change
    rows = rows.withColumn("fresh_", fresh).drop("before_")
    rows = ranges.running(rows, {"born_": last(F.when(~gone & F.col("fresh_"), F.struct("revision")))})
    created = F.when(~(gone & F.col("fresh_")), F.col("born_.revision"))
    kind = F.when(gone, "Deleted").when(F.col("fresh_"), "Added").otherwise("Modified")
    return rows.withColumn("created", created).withColumn("kind", kind).drop("fresh_", "born_")


def materialize(changes: DataFrame) -> DataFrame:
    """(key, value, revision) of the keys that the feed leaves."""
    last = changes.groupBy("key").agg(F.max_by(F.struct("op", "value", "revision"), "revision").alias("c"))
    return last.filter("c.op <> 'delete'").select("key", "c.value", "c.revision")


def _name_bounds(names: DataFrame, parts: int) -> list[str]:
    """Names at which the order of all names is cut into about equal parts, from those with the least hashes."""
    sample = sorted(r[0] for r in names.select("name").filter("name is not null").distinct().orderBy(F.xxhash64("name"), "name").limit(32 * parts).collect())
    return sorted({sample[len(sample) * i // parts] for i in range(1, parts)}) if sample else []


def owned_by(items: DataFrame, owners: DataFrame, least_prefix: int | None = None, parts: int | None = None) -> DataFrame:
    """Pairs of items (name) and owners (owner) whose name begins the item's; an empty owner's name begins every item, a null one none.

    Items and owners are dealt to ranges of names, an owner also to every range whose first name it begins: what it owns is one run of names. A
    task merges its range in the order of names and keeps the owners that are open, each the beginning of the next, on a stack. So a row is
    shuffled once, whatever the lengths of names, and the items of a hot owner are many tasks. Repeated items and owners pair again.
    Where all owners' names have least_prefix characters or more, rows can meet on that one beginning instead, by a plain join.
    """
    if least_prefix:
        i = items.withColumn("start_", F.substring("name", 1, least_prefix))
        o = owners.withColumn("start_", F.substring("owner", 1, least_prefix))
        return i.join(o, "start_").filter(F.col("name").startswith(F.col("owner"))).drop("start_")
    parts = parts or int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bounds = F.array(*map(F.lit, _name_bounds(items, parts))).cast("array<string>")
    steps = [1 << k for k in reversed(range(max(parts, 1).bit_length()))]
    place = lambda name: F.aggregate(F.lit(steps), F.lit(0), lambda at, step: F.when(F.get(bounds, at + step - 1) <= name, at + step).otherwise(at))
    item, owner = F.struct(*items.columns), F.struct(*owners.columns)
    opened = F.filter(F.sequence(F.lit(1), F.size(bounds)), lambda j: (F.size(bounds) > 0) & F.get(bounds, j - 1).startswith(F.col("owner")))
    none = lambda of: F.lit(None).cast(of.select(F.struct(*of.columns).alias("s")).schema["s"].dataType)
    left = items.filter("name is not null").select(place(F.col("name")).alias("part"), F.col("name").alias("at"), F.lit(1).alias("side"), item.alias("item"), none(owners).alias("owner"))
    right = owners.filter("owner is not null").select(F.explode(F.array_union(F.array(place(F.col("owner"))), opened)).alias("part"), F.col("owner").alias("at"), F.lit(0).alias("side"), none(items).alias("item"), owner.alias("owner"))
    dealt = left.unionByName(right).repartition("part").sortWithinPartitions("part", "at", "side")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack: list[tuple[str, dict]] = []
        part = None
        for batch in batches:
            rows, found = [], []
            sides, owned = batch.column(2).to_pylist(), batch.column(4)
            for i, (own, at) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                if own != part:
                    stack, part = [], own
                while stack and not at.startswith(stack[-1][0]):
                    stack.pop()
                if sides[i] == 0:
                    stack.append((at, owned[i].as_py()))
                else:
                    rows += [i] * len(stack)
                    found += [o for _, o in stack]
            yield pa.RecordBatch.from_arrays([batch.column(3).take(pa.array(rows, type=pa.int64())), pa.array(found, type=owned.type)], names=["item", "owner"])

    schema = T.StructType([T.StructField("item", dealt.schema["item"].dataType), T.StructField("owner", dealt.schema["owner"].dataType)])
    pairs = dealt.select("part", "at", "side", "item", "owner").mapInArrow(merge, schema)
    return pairs.select(*(F.col(f"item.{c}") for c in items.columns), *(F.col(f"owner.{c}") for c in owners.columns))


def desired_vs_actual(desired: DataFrame, active: DataFrame) -> DataFrame:
    """desired (owner, wanted) with `active` (count of active (owner) rows) and `difference`."""
    counts = active.groupBy("owner").agg(F.count("*").alias("active"))
    rows = desired.join(counts, "owner", "left").withColumn("active", F.coalesce("active", F.lit(0)))
    return rows.withColumn("difference", F.col("wanted") - F.col("active"))


def scale_down_victims(owned: DataFrame, excess: DataFrame) -> DataFrame:
    """The last `excess` items (owner, name) of each owner's list."""
    rank = F.row_number().over(Window.partitionBy("owner").orderBy(F.desc("name")))
    return owned.join(excess.filter("excess > 0"), "owner").withColumn("rank_", rank).filter("rank_ <= excess").drop("rank_", "excess")


def reconcile(desired: DataFrame, active: DataFrame, containers: int = 1) -> DataFrame:
    """(owner, name, action): keep, delete (the last ones) or create (one for each container of each missing replica)."""
    plan = desired_vs_actual(desired, active)
    delete = scale_down_victims(active.select("owner", "name"), plan.select("owner", (-F.col("difference")).alias("excess")))
    missing = plan.filter("difference > 0").select("owner", F.explode(F.sequence(F.lit(1), (F.col("difference") * containers).cast("int"))).alias("nth"))
    create = missing.select("owner", F.concat("owner", F.lit("-new-"), "nth").alias("name"), F.lit("create").alias("action"))
    marked = active.select("owner", "name").join(delete.withColumn("d_", F.lit(True)), ["owner", "name"], "left")
    kept = marked.select("owner", "name", F.when(F.col("d_"), "delete").otherwise("keep").alias("action"))
    return kept.unionByName(create)


def score_nodes(nodes: DataFrame) -> DataFrame:
    """nodes (node, running) with `score`: the free share of the room that the busiest node shows, in whole percent."""
    busiest = nodes.agg((F.max("running") + 1).alias("room_"))
    return nodes.crossJoin(F.broadcast(busiest)).withColumn("score", F.expr("100 * (room_ - running) div room_")).drop("room_")


def select_host(scored: DataFrame) -> DataFrame:
    """The node with the best score; of equal ones the first by name."""
    return scored.agg(F.min_by(F.struct("node", "score"), F.struct(-F.col("score"), F.col("node"))).alias("n")).select("n.node", "n.score")


def balanced_assign(items: DataFrame, workers: DataFrame, range_size: int = 1 << 16) -> DataFrame:
    """(item, worker, level): each item, in order, to the least loaded worker at that moment, of equal ones the first by name.

    Loads only rise, so the workers take places in the order of (load, name): worker w has the places (load, w), (load + 1, w)
    and so on. The nth item gets the nth place. Places up to the level that suffices are listed, ranked by level and name; items are
    ranked within ranges of their ids, and the ranges' counts are summed, so no task ranks all items.
    This is least-loaded assignment without rounding; whole-percent scores would stop telling loads apart above 100.
    """
    count = items.count()
    loads = [(r["load"], r["n"]) for r in workers.groupBy("load").agg(F.count("*").alias("n")).orderBy("load").collect()]  # different loads
    if not loads or not count:
        return items.select("item", F.lit(None).cast("string").alias("worker"), F.lit(None).cast("long").alias("level")).limit(0)
    level, open_, left, i = loads[0][0], 0, count, 0
    while True:
        while i < len(loads) and loads[i][0] <= level:
            open_ += loads[i][1]
            i += 1
        following = loads[i][0] if i < len(loads) else None
        steps = -(-left // open_) if following is None else min(following - level, -(-left // open_))
        left -= steps * open_
        level += steps
        if left <= 0:
            break
    places = workers.filter(F.col("load") < level).select("worker", F.explode(F.sequence("load", F.lit(level - 1))).alias("level"))
    per_level = places.groupBy("level").agg(F.count("*").alias("n_"))
    base = per_level.select("level", F.coalesce(F.sum("n_").over(Window.orderBy("level").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base_"))
    ranked = places.join(base, "level").select("worker", "level", (F.col("base_") + F.row_number().over(Window.partitionBy("level").orderBy("worker"))).alias("rank_"))
    ranged = items.select("item", F.floor(F.col("item") / range_size).alias("range_"))
    sizes = ranged.groupBy("range_").agg(F.count("*").alias("n_"))
    before = sizes.select("range_", F.coalesce(F.sum("n_").over(Window.orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before_"))
    numbered = ranged.join(before, "range_").select("item", (F.col("before_") + F.row_number().over(Window.partitionBy("range_").orderBy("item"))).alias("rank_"))
    return numbered.join(ranked, "rank_").select("item", "worker", "level")


def rollup_status(exists: Column, running: Column, exit_code: Column) -> Column:
    """One status from a pod's containers: any running; else all that exist failed; else all ended well; else scheduled."""
    code = F.when(exists, exit_code).otherwise(0)
    return (
        F.when(F.bool_or(exists & running), "Running")
        .when(F.bool_or(exists) & ~F.bool_or(code == 0), "Failed")
        .when(F.bool_and(code == 0), "Succeeded")
        .otherwise("Scheduled")
    )


def membership_change(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    joined = new.select(key).distinct().join(old, key, "left_anti").withColumn("change", F.lit("joined"))
    return joined.unionByName(old.select(key).distinct().join(new, key, "left_anti").withColumn("change", F.lit("left")))
