"""A Merkle manifest of a dataset: digests of documents folded by source and over all sources, with checked inclusion proofs.

Leaves stand in the order of their ids. A superblock is a run of 3^depth leaves of one source, which is a whole subtree. The roots of the
superblocks are the leaves of the next round, and so on until a source has one node; the subroots are one more such
sequence. Then the way goes down: the leaves of each superblock and the outer nodes that their proofs need are cogrouped by superblock,
and one function finishes the local reduction, joins the proofs and folds them. No group holds more than 3^depth nodes,
whatever a source holds.
"""

from __future__ import annotations

import hashlib
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.prefix import Ranges, total
from tidemark.sources.files import workspace

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Nodes of a run that become one.
ARITY = 3


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_digest(values: list[Column]) -> Column:
    """The digest of one row: `-` for null, else the UTF-8 bytes' count, a colon and the value, one after the other."""
    each = [F.coalesce(F.concat(F.octet_length(t := v.cast("string")).cast("string"), F.lit(":"), t), F.lit("-")) for v in values]
    return F.sha2(F.concat(*each), 256)


def reduce_run(nodes: list[str]) -> list[list[str]]:
    """The levels of a sequence of nodes, from itself up to the level that has one node."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([digest(*below[i : i + ARITY]) for i in range(0, len(below), ARITY)])
    return levels


def siblings(levels: list[list[str]], place: int) -> list[tuple[int, list[str]]]:
    """For each level below the top: where the node at `place` stands in its run, and the run's other nodes."""
    out = []
    for level in levels[:-1]:
        first = place // ARITY * ARITY
        run = level[first : first + ARITY]
        out.append((place - first, run[: place - first] + run[place - first + 1 :]))
        place //= ARITY
    return out


def fold(node: str, path: list[tuple[int, list[str]]]) -> str:
    """The root that a node and its siblings give."""
    for at, others in path:
        node = digest(*others[:at], node, *others[at:])
    return node


def superblock(nodes: list[str], block: int, depth: int) -> list[list[str]]:
    """The levels of a sequence's superblock: `depth` of them above its nodes, or, where it is all there is, up to its one node.

    Only the last superblock may lack nodes, so a first one that does has no other beside it. In the last superblock of
    many a node that is alone in its run still becomes its digest, up to the common height.
    """
    levels = reduce_run(nodes)
    if block or len(nodes) == ARITY**depth:
        while len(levels) <= depth:
            levels.append([digest(*levels[-1])])
    return levels


def as_text(path: list[tuple[int, list[str]]]) -> list[str]:
    return [f"{at}:{','.join(others)}" for at, others in path]


def from_text(path) -> list[tuple[int, list[str]]]:
    parts = (x.split(":") for x in path)
    return [(int(at), others.split(",") if others else []) for at, others in parts]


def paths_to_root(nodes: DataFrame, depth: int, folder: str) -> DataFrame:
    """(seq, block, subroot, path) for each superblock of the sequences in nodes (seq, nth from 0, node).

    Going up, each round writes the roots of the superblocks, 3^depth times fewer than before, until every sequence
    has one node; going down, each round cogroups those nodes with the path of their superblock.
    """
    spark, size = nodes.sparkSession, ARITY**depth

    def up(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        seq, block = key
        levels = superblock(group.sort_values("nth")["node"].tolist(), block, depth)
        return pd.DataFrame({"seq": [seq], "nth": [block], "node": [levels[-1][0]]})

    def down(key: tuple, group: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        seq, block = key
        group = group.sort_values("nth")
        levels = superblock(group["node"].tolist(), block, depth)
        subroot, above = outer["subroot"].iloc[0], list(outer["path"].iloc[0])
        paths = [as_text(siblings(levels, place)) + above for place in range(len(group))]
        return pd.DataFrame({"seq": seq, "block": group["nth"], "subroot": subroot, "path": paths})

    in_blocks = lambda df: df.withColumn("block", F.floor(F.col("nth") / size))
    rounds = [in_blocks(nodes)]
    while True:
        roots = rounds[-1].groupBy("seq", "block").applyInPandas(up, "seq string, nth long, node string")
        roots.write.parquet(f"{folder}/up{len(rounds)}")
        roots = spark.read.parquet(f"{folder}/up{len(rounds)}")
        if not roots.agg(F.max("nth")).first()[0]:
            break
        rounds.append(in_blocks(roots))
    paths = roots.select("seq", F.col("nth").alias("block"), F.col("node").alias("subroot"), F.array().cast("array<string>").alias("path"))
    for above in reversed(rounds[1:]):
        paths = above.groupBy("seq", "block").cogroup(paths.groupBy("seq", "block")).applyInPandas(down, "seq string, block long, subroot string, path array<string>")
    return paths


RESULT = "leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def manifest(docs: DataFrame, *, check: dict[str, Column] | None = None, depth: int = 8, proofs: bool = False) -> DataFrame:
    """For each document its leaf, its source's subroot, the root, its proof's digest, and whether a copy is proven to be in the set.

    doc_id, place (of the leaf in its source), leaf, subroot, root, proof_sha256, folded_root (from the copy's leaf and the
    proof), verified (whether that is the root); with `proofs` also proof: for each level the place in the run, a
    colon, and the run's other nodes, which fold() takes after from_text(). `check` gives columns that differ in the copy to be checked.

    Digests are made where the texts are read; what is shuffled are ids and digests. A hot source is numbered in ranges
    and reduced in superblocks of 3^depth leaves. Nulls have a mark of their own, which no value has; a null source is
    one, before all others; null ids come first, and rows with one id follow each other by their leaves, so
    repeated rows are leaves of their own; a lone leaf is its subroot; an empty table has no rows. Other columns are no part of a leaf.
    """
    spark = docs.sparkSession
    folder = workspace(spark)
    known = docs.select(*FIELDS)
    fields = {c: F.col(c) for c in FIELDS}
    copy = leaf_digest(list((fields | (check or {})).values()))
    seq = F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))
    leaves = known.select(seq.alias("seq"), "doc_id", leaf_digest(list(fields.values())).alias("leaf"), (copy if check else F.lit(None).cast("string")).alias("copy"))
    numbered = Ranges(known.select(seq.alias("seq"), "doc_id"), ["seq"], "doc_id", ARITY**depth).running(leaves, {"nth": total(F.lit(1).cast("long"))}, then=("leaf",))
    slim = numbered.select("seq", (F.col("nth") - 1).alias("nth"), "doc_id", F.unhex("leaf").alias("leaf"), F.when(F.col("copy") != F.col("leaf"), F.unhex("copy")).alias("copy"))
    slim.write.parquet(f"{folder}/leaves")  # once: the reduction and the proofs read it
    slim = spark.read.parquet(f"{folder}/leaves").withColumns({c: F.lower(F.hex(c)) for c in ("leaf", "copy")})
    inner = paths_to_root(slim.select("seq", "nth", F.col("leaf").alias("node")), depth, f"{folder}/sources")
    inner.write.parquet(f"{folder}/inner")
    inner = spark.read.parquet(f"{folder}/inner")
    subroots = inner.filter("block = 0").select("seq", "subroot")
    places = Ranges(subroots, [], "seq", ARITY**depth).running(subroots, {"nth": total(F.lit(1).cast("long"))}).select("seq", (F.col("nth") - 1).alias("nth"), F.col("subroot").alias("node"))
    top = paths_to_root(places.select(F.lit("").alias("seq"), "nth", "node"), depth, f"{folder}/all")
    own = places.select(F.col("seq").alias("of"), "nth", F.col("node"), F.floor(F.col("nth") / ARITY**depth).alias("block"))

    def over_sources(key: tuple, group: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("nth")
        levels = superblock(group["node"].tolist(), key[0], depth)
        above = list(outer["path"].iloc[0])
        paths = [as_text(siblings(levels, place)) + above for place in range(len(group))]
        return pd.DataFrame({"seq": group["of"], "root": outer["subroot"].iloc[0], "over": paths})

    above = own.groupBy("block").cogroup(top.groupBy("block")).applyInPandas(over_sources, "seq string, root string, over array<string>")
    outer = inner.join(above, "seq").select("seq", "block", "subroot", "root", F.concat("path", "over").alias("path"))
    leaves = slim.withColumn("block", F.floor(F.col("nth") / ARITY**depth))
    kind = known.schema["doc_id"].dataType.simpleString()

    def finish(key: tuple, group: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("nth")
        nodes = group["leaf"].tolist()
        levels = superblock(nodes, key[1], depth)
        above, root = from_text(outer["path"].iloc[0]), outer["root"].iloc[0]
        proven, folded, listed = [], [], []
        for place, (leaf, copy) in enumerate(zip(nodes, group["copy"].tolist(), strict=True)):
            path = siblings(levels, place) + above
            proven.append(digest(*(node for _, others in path for node in others)))
            folded.append(fold(copy if isinstance(copy, str) else leaf, path))
            if proofs:
                listed.append(as_text(path))
        out = {"doc_id": group["doc_id"], "place": group["nth"], "leaf": nodes, "subroot": outer["subroot"].iloc[0], "root": root, "proof_sha256": proven, "folded_root": folded, "verified": [f == root for f in folded]}
        return pd.DataFrame(out | {"proof": listed} if proofs else out)

    schema = f"doc_id {kind}, place long, {RESULT}" + (", proof array<string>" if proofs else "")
    return leaves.groupBy("seq", "block").cogroup(outer.groupBy("seq", "block")).applyInPandas(finish, schema)


def op13_merkle(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    hit = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    return manifest(docs, check={"text": F.when(hit, F.translate("text", "\n", "")).otherwise(F.col("text"))}).drop("place")
