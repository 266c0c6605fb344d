"""Exact Jaccard similarity of shingle sets within groups of candidates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import arrays
from tidemark.llm.graph import connected_components, small
from tidemark.llm.simhash import shingle_hashes

#: Shingles that a task compares at once (16 MB); larger groups are split.
MOST = 2_000_000


def _sets_task(words: int):
    """(root, node, text) to (root, node, shingles): sorted distinct hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, offsets, data in arrays.slices(batch.column(2), 1 << 20):
                raw = data.tobytes()
                sets = [np.unique(shingle_hashes(raw[a:b], words)) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                cuts = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                shingles = pa.ListArray.from_arrays(pa.array(cuts), pa.array(np.concatenate(sets).view(np.int64)))
                root, node = (batch.column(k).slice(first, last - first) for k in (0, 1))
                yield pa.RecordBatch.from_arrays([root, node, shingles], names=["root", "node", "shingles"])

    return run


def shingle_sets(texts: DataFrame, words: int) -> DataFrame:
    """(root, node, shingles) of (root, node, text)."""
    schema = T.StructType([texts.schema["root"], texts.schema["node"], T.StructField("shingles", T.ArrayType(T.LongType()))])
    return texts.select("root", "node", "text").mapInArrow(_sets_task(words), schema)


def enough(shared, a, b, similarity: float):
    """Whether sets of a and b elements that share so many are alike."""
    return (shared > 0) & (shared * (1 + similarity) >= similarity * (a + b) - 1e-9)


def exact_links(flat: np.ndarray, sizes: np.ndarray, labels: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Pairs of sets that connect all those of one group with a similarity of at least `similarity`.

    Sets with the same label are connected already. A set is compared, by the postings of its shingles, with all
    sets outside its component that weren't compared with all yet; those outside the largest component go first,
    so a dense group takes a few rounds.
    """
    n = len(sizes)
    root = np.unique(labels, return_inverse=True)[1].reshape(-1)
    if n < 2 or not root.any():
        return []
    cuts = np.concatenate([[0], np.cumsum(sizes)])
    ids = np.unique(flat, return_inverse=True)[1].reshape(-1)
    postings = np.repeat(np.arange(n), sizes)[np.argsort(ids, kind="stable")]
    ends = np.cumsum(np.bincount(ids)) if len(ids) else np.zeros(0, dtype=np.int64)
    starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
    open_, links = np.ones(n, dtype=bool), []
    while True:
        still = np.flatnonzero(open_)
        own = root[still]
        if not len(still) or (own == own[0]).all():
            return links
        q = still[np.argmax(own != np.bincount(own).argmax())]
        open_[q] = False
        of = ids[cuts[q] : cuts[q + 1]]
        lengths = ends[of] - starts[of]
        places = np.repeat(starts[of] - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())
        shared = np.bincount(postings[places], minlength=n)
        alike = np.flatnonzero(enough(shared, sizes[q], sizes, similarity) & open_ & (root != root[q]))
        for t in alike.tolist():
            if root[t] != root[q]:
                links.append((int(q), t))
                root[root == root[t]] = root[q]


def _links_task(similarity: float):
    """Rows (key, label, node, shingles) sorted by key, in batches; out go (a, b) of sets that are alike and connect each key's."""

    def linked(keys, labels, sizes, flat, nodes) -> pa.RecordBatch | None:
        new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        cuts = np.concatenate([[0], np.cumsum(sizes)])
        a, b = [], []
        for low, high in zip(new.tolist(), [*new[1:].tolist(), len(keys)], strict=True):
            for x, y in exact_links(flat[cuts[low] : cuts[high]], sizes[low:high], labels[low:high], similarity):
                a.append(low + x)
                b.append(low + y)
        return pa.RecordBatch.from_arrays([nodes.take(pa.array(a)), nodes.take(pa.array(b))], names=["a", "b"]) if a else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0

        def flush(upto_last_key: bool):
            keys, labels, sizes, flat = (np.concatenate([h[k] for h in held]) for k in range(4))
            nodes = pa.concat_arrays([h[4] for h in held])
            cut = int(np.searchsorted(keys, keys[-1])) if upto_last_key else len(keys)
            at = int(sizes[:cut].sum())
            held[:] = [(keys[cut:], labels[cut:], sizes[cut:], flat[at:], nodes.slice(cut))] if cut < len(keys) else []
            return linked(keys[:cut], labels[:cut], sizes[:cut], flat[:at], nodes.slice(0, cut)) if cut else None

        for batch in batches:
            if not batch.num_rows:
                continue
            column = batch.column(3)
            sizes = np.diff(column.offsets.to_numpy()).astype(np.int64)
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy(), sizes, column.flatten().to_numpy(), batch.column(2)))
            count += int(sizes.sum()) + len(sizes)
            if count >= MOST:
                if (out := flush(True)) is not None:
                    yield out
                count = sum(len(x[3]) + len(x[0]) for x in held)
        if held and (out := flush(False)) is not None:
            yield out

    return run


def _bounded(rows: DataFrame, similarity: float) -> DataFrame:
    node = rows.schema["node"].dataType
    schema = T.StructType([T.StructField("a", node), T.StructField("b", node)])
    return rows.select("key", "label", "node", "shingles").repartition("key").sortWithinPartitions("key").mapInArrow(_links_task(similarity), schema)


def _similarity(a: str, b: str):
    shared = F.size(F.array_intersect(a, b))
    return shared, F.size(a), F.size(b)


def _representatives(members: DataFrame, unsettled: DataFrame, counts: DataFrame, turn: int, sample: int = 256) -> DataFrame:
    """(root, rep, rep_set): for each root the member that is most like what a random unsettled member and those around it have in common."""
    pivots = unsettled.groupBy("root").agg(F.min_by(F.struct("node", "shingles"), F.struct(F.xxhash64("node", F.lit(turn)), "node")).alias("p"))
    pivots = small(pivots.join(counts, "root").select("root", "members", F.col("p.node").alias("pivot"), F.col("p.shingles").alias("pivot_set")))
    some = members.join(pivots, "root").filter((F.col("node") == F.col("pivot")) | (F.pmod(F.xxhash64("node"), F.lit(1_000_000)) * F.col("members") < sample * 1_000_000))
    shared, a, b = _similarity("shingles", "pivot_set")
    around = some.filter((F.col("node") == F.col("pivot")) | (shared * 3 >= a + b)).select("root", "shingles").checkpoint()  # a similarity of 0.5
    common = around.select("root", F.explode("shingles").alias("s")).groupBy("root", "s").count().join(small(around.groupBy("root").agg(F.count("*").alias("n"))), "root")
    common = small(common.filter("2 * count >= n").groupBy("root").agg(F.collect_list("s").alias("common")))
    shared, a, b = _similarity("shingles", "common")
    best = members.join(common, "root").select("root", "node", "shingles", (shared / F.greatest(a + b - shared, F.lit(1))).alias("j"))
    rep = best.groupBy("root").agg(F.max_by(F.struct("node", "shingles"), F.struct("j", "node")).alias("r"))
    return rep.select("root", F.col("r.node").alias("rep"), F.col("r.shingles").alias("rep_set")).checkpoint()


def _large_links(members: DataFrame, counts: DataFrame, similarity: float, most: int, rounds: int) -> DataFrame:
    """Links of groups that are too large for a task.

    Rounds link members to a representative, all in parallel. Members that are connected so need not be compared with each
    other. Every other pair meets: members are dealt into chunks by what they are connected to, and each two chunks
    that aren't connected are a key, so no task holds more than two chunks and no link is lost.
    """
    found, unsettled, labels = None, members, None
    for turn in range(rounds):
        reps = small(_representatives(members, unsettled, counts, turn))
        shared, a, b = _similarity("shingles", "rep_set")
        alike = members.join(reps, "root").filter(enough(shared, a, b, similarity)).select(F.col("node").alias("a"), F.col("rep").alias("b"))
        found = alike.checkpoint() if found is None else found.unionByName(alike).checkpoint()
        labels = connected_components(found).select("node", F.col("root").alias("united"))
        unsettled = members.join(labels, "node", "left_anti")
        left = unsettled.groupBy("root").agg(F.sum(F.size("shingles") + 1).alias("n")).filter(F.col("n") > most)
        unsettled = unsettled.join(small(left.select("root")), "root", "left_semi").checkpoint()
        if unsettled.isEmpty():
            break
    of = members.join(labels, "node", "left").select("root", "node", F.xxhash64(F.coalesce("united", "node")).alias("label"), "shingles", F.xxhash64("united").alias("whole"), F.col("united").isNotNull().alias("linked"))
    of = of.withColumn("whole", F.when(F.col("linked"), F.col("whole")).otherwise(F.lit(0))).checkpoint()
    dealt = small(of.groupBy("root", "linked", "whole").agg(F.ceil(F.sum(F.size("shingles") + 1) / F.lit(max(1, most // 2))).cast("long").alias("chunks")))
    name = lambda c: F.xxhash64("root", "linked", "whole", c)
    rows = of.join(dealt, ["root", "linked", "whole"]).select(name(F.pmod(F.xxhash64(F.lit(7), "node"), "chunks")).alias("chunk"), "node", "label", "shingles")
    chunks = dealt.select("root", "linked", "whole", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("c")).withColumn("chunk", name(F.col("c")))
    x, y = chunks.alias("x"), chunks.alias("y")
    apart = ~F.col("x.linked") | ~F.col("y.linked") | (F.col("x.whole") != F.col("y.whole"))
    pairs = x.join(y, (F.col("x.root") == F.col("y.root")) & (F.col("x.chunk") <= F.col("y.chunk")) & apart)
    pairs = pairs.select(F.xxhash64("x.chunk", "y.chunk").alias("key"), F.explode(F.array_distinct(F.array("x.chunk", "y.chunk"))).alias("chunk"))
    return found.unionByName(_bounded(rows.join(pairs, "chunk"), similarity))


def verified_links(sets: DataFrame, similarity: float, most: int = MOST, rounds: int = 4) -> DataFrame:
    """Links (a, b) of nodes whose sets are alike, which connect all such nodes of each root. sets: (root, node, shingles).

    No task holds much more than `most` shingles of a root. Root and node may be of any type that has an order.
    """
    sets = sets.checkpoint()
    counts = sets.groupBy("root").agg(F.count("*").alias("members"), F.sum(F.size("shingles") + 1).alias("n"))
    counts = small(counts.filter(F.col("n") > most).filter("members > 2"))
    links = _bounded(sets.join(counts, "root", "left_anti").select(F.xxhash64("root").alias("key"), F.xxhash64("node").alias("label"), "node", "shingles"), similarity)
    if counts.isEmpty():
        return links
    members = sets.join(counts, "root", "left_semi").checkpoint()
    return links.unionByName(_large_links(members, counts, similarity, most, rounds))
