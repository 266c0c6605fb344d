"""Small cases with exact results: the blueprint's fixtures."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import columns as C
from tidemark.operators import logs, placement, recon, scan, states
from tidemark.sources import files
from tidemark.sources.versioned import Conflict, VersionedTable


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_text_predicates(spark):
    people = spark.createDataFrame([("John", "25", "New York"), ("Alice", "30", "LA"), ("Bob", "35", "New York"), ("Carol", "40", "Chicago"), ("Dave", "45", "New York")], "name string, age string, location string")
    old, york = scan.greater("age", "30"), scan.equal("location", "New York")
    assert [people.filter(p).count() for p in (old, york, scan.both(old, york))] == [3, 3, 2]


def test_row_groups_cover_all_rows_once(spark):
    people = spark.range(45).select((F.col("id") + 1).alias("n"), F.when(F.col("id") < 15, 20 + F.col("id") % 10).when(F.col("id") < 30, 35 + F.col("id") % 11).otherwise(55 + F.col("id") % 14).alias("age"))
    path = files.workspace(spark)
    files.write_parquet(people.coalesce(1).sortWithinPartitions("n"), path, 64)
    footers = files.footer_metadata(spark, path)
    kept = scan.prune(footers, "age", low=60, kind="long")
    read = lambda g: files.scan_row_groups(spark, path, g, people.schema)
    chosen, skipped = read(kept.filter("kept")), read(kept.filter("not kept"))
    assert chosen.count() + skipped.count() == 45
    assert skipped.filter("age >= 60").count() == 0
    assert chosen.filter("age >= 60").count() == people.filter("age >= 60").count()


def test_range_reads_clamp(spark, tmp_path):
    (tmp_path / "x").write_bytes(b"abcdef")
    got = lambda o, n: bytes(files.read_range(spark, str(tmp_path / "x"), o, n).first()["bytes"])
    assert [got(-2, 3), got(2, 0), got(4, 10), got(9, 3), got(1, -1)] == [b"abc", b"cdef", b"ef", b"", b"bcdef"]


def test_java_hash_and_moves(spark):
    keys = spark.range(10_000).select(F.concat(F.lit("user-account-"), F.col("id").cast("string")).alias("key"))
    assert keys.filter("key = 'user-account-0'").select(C.java_hash(F.col("key"))).first()[0] == 975799566
    placed = keys.select(C.key_partition(F.col("key"), 3).alias("a"), C.key_partition(F.col("key"), 4).alias("b"))
    assert placement.churn(placed, "a", "b").first()["moved"] == 7498
    pair = spark.createDataFrame([("\U0001f600a",), ("",), (None,)], "s string").select(C.java_hash(F.col("s"))).collect()
    units = "\U0001f600a".encode("utf-16-be")
    h = 0
    for i in range(0, len(units), 2):
        h = (h * 31 + int.from_bytes(units[i : i + 2], "big")) % 2**32
    assert [r[0] for r in pair] == [h - 2**32 if h >= 2**31 else h, 0, None]


def test_set_of_none(spark):
    assert placement.place_objects(spark.createDataFrame([("k",)], "key string"), 0).first()["set"] == -1


def test_siphash_vector():
    key = bytes(range(16))
    assert placement.sip_hash([bytes(range(15))], key).view("uint64")[0] == 0xA129CA6149BE45E5  # fixed values: published vectors
    assert placement.sip_hash([b""], key).view("uint64")[0] == 0x726FDB47DD0E0E31


def test_replicas(spark):
    p = spark.range(9).select(F.col("id").alias("p"))
    placed = placement.assign_replicas(p, [0, 1, 2], 2).collect()
    assert sorted(r["replicas"][0] for r in placed) == [0, 0, 0, 1, 1, 1, 2, 2, 2]
    assert all(len(set(r["replicas"])) == 2 for r in placed)
    for brokers, factor in (([0, 1, 2], 4), ([], 1), ([0], 0)):
        with pytest.raises(ValueError):
            placement.assign_replicas(p, brokers, factor)


def test_watermark(spark):
    acks = spark.createDataFrame([(0, 1, 1, 1), (0, 2, 2, 1)], "partition int, seq long, replica int, offset long")
    assert [r[0] for r in logs.watermark_history(acks, [1, 2]).orderBy("seq").select("watermark").collect()] == [0, 1]


def test_fencing(spark):
    commands = spark.createDataFrame([(1, 1, "o", 1), (2, 2, "o", 2), (3, 1, "o", 1)], "seq long, epoch long, partition string, leader int")
    assert rows(logs.current_assignment(logs.fence(commands))) == [("o", 2, 2, 1)]
    assert rows(logs.fence(commands).select("seq", "accepted")) == rows(logs.fence(commands, "partition").select("seq", "accepted"))


def test_negative_epochs_are_refused(spark):
    commands = spark.createDataFrame([(1, -1, 0, 1), (2, -1, 0, 2), (3, 0, 0, 3)], "seq long, epoch long, partition int, leader int")
    assert [r[0] for r in logs.fence(commands).orderBy("seq").select("accepted").collect()] == [False, False, True]


def test_fetch_clamps(spark):
    log = spark.range(1, 6).select(F.lit(0).alias("partition"), F.col("id").alias("offset"))
    bound = spark.createDataFrame([(0, 3)], "partition int, bound long")
    assert [logs.fetch(log, bound, s).count() for s in (1, 3, 4, 0, -1)] == [3, 1, 0, 0, 0]


def test_states_merge(spark):
    v = spark.createDataFrame([("e", "STATUS", "JOINING", 2, 1), ("e", "DC", "us-east", 1, 2), ("e", "STATUS", "NORMAL", 6, 3), ("e", "LOAD", "10.5", 4, 4), ("e", "STATUS", "LATE", 6, 5)], "endpoint string, key string, value string, version int, seq int")
    assert rows(states.merge_values(v)) == [("e", "DC", "us-east", 1), ("e", "LOAD", "10.5", 4), ("e", "STATUS", "NORMAL", 6)]
    b = spark.createDataFrame([("e", 1, 5000), ("e", 2, 1)], "endpoint string, generation int, version int")
    assert rows(states.merge_heartbeats(b)) == [("e", 2, 1)]


def loop_detector(ticks, threshold, size, initial, most):
    """The detector's rules, tick by tick."""
    gaps, last, down, out = [], None, False, []
    for t in range(1, max(ticks) + 400):
        if t in ticks:
            gap = initial if last is None else t - last
            if last is None or gap <= most:
                gaps = (gaps + [max(gap, 1) if last is not None else initial])[-size:]
            if down:
                out[-1][1] = t
                down = False
            last = t
        elif last is not None and not down and (t - last) / max(sum(gaps) / len(gaps), 0.1) / math.log(10) >= threshold:
            down = True
            out.append([t, None])
    return [tuple(x) for x in out]


def test_detector_against_a_loop(spark):
    r = random.Random(5)
    series, want = [], []
    for e in range(40):
        ticks, t = set(), 0
        for _ in range(r.randint(1, 15)):
            t += r.choice((1, 1, 2, 3, 7, 20, 60))
            ticks.add(t)
        series += [(e, t) for t in ticks]
        want += [(e, *x) for x in loop_detector(ticks, 2.0, 3, 2, 30)]
    beats = spark.createDataFrame(series, "endpoint long, tick long")
    got = [tuple(x) for x in states.down_episodes(beats, 2.0, 3, 2, 30).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_phi(spark):
    beats = spark.createDataFrame([("n", t) for t in range(10, 15)], "endpoint string, tick long")
    probes = spark.createDataFrame([("n", 14), ("n", 20), ("n", 5)], "endpoint string, tick long")
    got = {r["tick"]: r["phi"] for r in states.phi_at(probes, beats, initial=1).collect()}
    assert got[14] == 0 and got[5] == 0 and abs(got[20] - 6 / math.log(10)) < 1e-9


def test_previous_values(spark):
    c = spark.createDataFrame([("k", 1, "put", "a"), ("k", 2, "put", "b"), ("k", 3, "delete", "b"), ("k", 4, "put", "c")], "key string, revision long, op string, value string")
    assert [r["event"] for r in recon.with_previous_value(c).orderBy("revision").collect()] == ["ADD", "UPDATE", "DELETE", "ADD"]
    assert [r["kind"] for r in recon.classify_changes(c).orderBy("revision").collect()] == ["Added", "Modified", "Deleted", "Added"]
    assert rows(recon.materialize(c)) == [("k", "c", 4)]


def test_reconcile(spark):
    desired = spark.createDataFrame([("rs-1", 3), ("rs-2", 2), ("rs-3", 1)], "owner string, wanted int")
    active = spark.createDataFrame([("rs-2", "rs-2-a"), ("rs-2", "rs-2-b"), ("rs-3", "rs-3-a"), ("rs-3", "rs-3-b")], "owner string, name string")
    got = {(r["owner"], r["action"]): r["n"] for r in recon.reconcile(desired, active).groupBy("owner", "action").agg(F.count("*").alias("n")).collect()}
    assert got == {("rs-1", "create"): 3, ("rs-2", "keep"): 2, ("rs-3", "keep"): 1, ("rs-3", "delete"): 1}


def test_prefix_ownership(spark):
    items = spark.createDataFrame([("rs-1-a",), ("rs-10-a",)], "name string")
    owners = spark.createDataFrame([("rs-1",), ("rs-10",)], "owner string")
    for least in (None, 4):
        assert len(rows(recon.owned_by(items, owners, least))) == 3
    some = spark.createDataFrame([("",), ("rs-1",), ("rs-10-longer than any item",), (None,)], "owner string")
    every = {r["name"] for r in items.collect()}
    got = sorted((r["owner"], r["name"]) for r in recon.owned_by(items, some).collect())
    assert got == sorted((o, n) for o in ("", "rs-1") for n in every if n.startswith(o))
    assert rows(recon.owned_by(items, some.limit(0))) == []


def test_balanced_assign_is_sequential_least_loaded(spark):
    r = random.Random(3)
    for _ in range(4):
        loads = {f"w{i}": r.randint(0, 6) for i in range(5)}
        n = r.randint(1, 40)
        now, want = dict(loads), []
        for i in range(n):
            w = min(now, key=lambda k: (now[k], k))
            want.append((i, w))
            now[w] += 1
        items = spark.range(n).select(F.col("id").alias("item"))
        workers = spark.createDataFrame(list(loads.items()), "worker string, load long")
        assert rows(recon.balanced_assign(items, workers, range_size=7).select("item", "worker")) == want


@pytest.mark.parametrize(
    "containers,status",
    [
        ([(True, True, 0)] * 2, "Running"),
        ([(True, True, 0), (True, False, 0)], "Running"),
        ([(True, False, 0)] * 2, "Succeeded"),
        ([(True, False, 1)] * 2, "Failed"),
        ([(True, False, 1), (True, True, 0)], "Running"),
        ([(False, False, None)] * 2, "Succeeded"),
        ([(True, False, 0), (True, False, 1)], "Scheduled"),
    ],
)
def test_rollup(spark, containers, status):
    df = spark.createDataFrame([("p", *c) for c in containers], "pod string, e boolean, r boolean, x int")
    assert df.groupBy("pod").agg(recon.rollup_status(F.col("e"), F.col("r"), F.col("x")).alias("s")).first()["s"] == status


def test_erasure_coding(spark):
    blob = b"It was the best of shards, it was the worst of shards. " * 20
    blobs = spark.createDataFrame([(1, bytearray(blob)), (2, bytearray(b"x")), (3, bytearray(b""))], "object long, content binary")
    shards = placement.shard_objects(blobs, 4, 2, 256).cache()
    assert placement.scrub_parity(shards, 4, 2).filter("not intact").count() == 0
    for lost in ((0, 1), (2, 5), (4, 5), (1, 3)):
        back = placement.repair_objects(shards.filter(~F.col("shard").isin(*lost)), 4, 2).filter("object = 1").orderBy("block").collect()
        assert b"".join(bytes(r["bytes"]) for r in back) == blob
    assert placement.repair_objects(shards.filter("shard > 2"), 4, 2).filter("status <> 'lost'").count() == 0


def test_versions(spark):
    table = VersionedTable.create(spark, files.workspace(spark))
    one = spark.createDataFrame([("101", "Alice", 1000), ("102", "Bob", 500), ("103", "Charlie", 750)], "id string, owner string, balance int")
    two = spark.createDataFrame([("101", "Alice", 800), ("102", "Bob", 700), ("103", "Charlie", 750), ("104", "Diana", 300)], one.schema)
    table.append(one)
    table.replace(two)
    assert [table.read(v).count() for v in (1, 2, 99)] == [3, 4, 4]
    assert table.read(-1).count() == 0 and table.version() == 2
    again = VersionedTable.create(spark, table.path)
    assert again.version() == 2
    staged = table.stage(one)
    with pytest.raises(Conflict):
        table.commit(staged, 1, "WRITE")
    assert table.commit_with_retry(lambda t, v: staged) == 3
    assert table.read().count() == 7 and table.orphans(1).count() > 0


def test_partition_nulls_are_refused(spark):
    table = VersionedTable.create(spark, files.workspace(spark), partition_columns=("k",))
    bad = spark.createDataFrame([(1, None)], "v int, k string")
    with pytest.raises(Exception, match="null in partition column"):
        table.append(bad, "k")
    table.append(spark.createDataFrame([(1, "a b"), (2, "c")], "v int, k string"), "k")
    assert rows(table.read(k="a b").select("v", "k")) == [(1, "a b")]


def test_transactions_are_not_repeated(spark):
    table = VersionedTable.create(spark, files.workspace(spark))
    one = spark.createDataFrame([(1,)], "v int")
    assert [table.append(one, txn="q:0"), table.append(one, txn="q:0"), table.append(one, txn="q:1")] == [1, 1, 2]
    assert table.read().count() == 2


def test_checkpoints_change_no_read(spark):
    table = VersionedTable(spark, files.workspace(spark), checkpoint_every=3)
    VersionedTable.create(spark, table.path)
    for k in range(8):
        if k == 4:
            table.replace(spark.range(100, 110))
        else:
            table.append(spark.range(k, k + 1).coalesce(1), txn=f"a:b:{k}" if k % 2 else f"once {k}")
    plain = lambda v: {(r["path"], r["size"], r["version"]) for r in table.files(v).collect()}
    with_them = [plain(v) for v in (None, *range(-1, 10))]
    assert [table._checkpoint(v) for v in (None, 2, 3, 5, 6, 99)] == [6, -1, 3, 3, 6, 6]
    assert rows(table.metadata(7)) == rows(table.metadata(0)) != []
    opened = {f.rsplit("/", 1)[1] for f in table.actions(after=6).inputFiles()}
    read = table.actions(after=6).select("version").distinct().collect()
    assert sorted(r[0] for r in read) == [7, 8] and len(opened) == 9
    assert [table.has_txn(t) for t in ("a:b:1", "a:b:7", "a:b:8", "a:b", "a:c:1", "once 0", "once 6", "once 4", "once")] == [True, True, False, False, False, True, True, False, False]
    assert table.append(spark.range(1), txn="once 2") == 8 and sorted(r[0] for r in table.read(5).collect()) == list(range(100, 110))
    bare = VersionedTable(spark, table.path)
    bare._checkpoint = lambda upto: -1
    assert with_them == [{(r["path"], r["size"], r["version"]) for r in bare.files(v).collect()} for v in (None, *range(-1, 10))]


def test_csv_quotes(spark):
    df = spark.createDataFrame([('a,"b"', None), ("line\nfeed", "x")], "p string, q string")
    path = files.workspace(spark)
    files.write_csv(df, path)
    assert rows(files.read_csv(spark, path).select("p", F.coalesce("q", F.lit("")))) == [('a,"b"', ""), ("line\nfeed", "x")]


def test_log_names(spark):
    from tidemark.sources.versioned import log_names

    r = log_names(spark.createDataFrame([(7,)], "version long")).first()
    assert (r["name"], r["back"]) == ("00000000000000000007.json", 7)
    assert spark.createDataFrame([("x.json",)], "n string").select(C.version_of(F.col("n"))).first()[0] is None


def test_owners_by_a_merge_of_names(spark):
    """Names at and across the cuts, owners within owners, repeated rows, empty and null names, other columns."""
    import itertools
    import random

    r = random.Random(6)
    names = ["".join(x) for n in range(4) for x in itertools.product("ab\u00e9", repeat=n)] + [None]
    items = [(r.choice(names), i) for i in range(300)]
    owners = [(r.choice(names), f"o{i}") for i in range(40)] + [("", "all"), ("ab", "twice"), ("ab", "twice")]
    want = sorted((n, i, o, x) for n, i in items for o, x in owners if n is not None and o is not None and n.startswith(o))
    i, o = spark.createDataFrame(items, "name string, id int"), spark.createDataFrame(owners, "owner string, side string")
    for parts in (1, 2, 7, 60):
        got = recon.owned_by(i, o, parts=parts)
        assert got.columns == ["name", "id", "owner", "side"] and sorted(map(tuple, got.collect())) == want
    assert recon.owned_by(i.limit(0), o).count() == 0 and recon.owned_by(i, o.limit(0)).count() == 0
