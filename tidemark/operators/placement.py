"""Placement of keys, replicas, objects and shards; durability; erasure coding as Spark jobs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import crc_set, floor_mod


def distribution(df: DataFrame, column: str) -> DataFrame:
    """(column, keys, share) with the share in percent."""
    counts = df.groupBy(column).agg(F.count("*").alias("keys"))
    total = counts.agg(F.sum("keys").alias("all_"))
    return counts.crossJoin(F.broadcast(total)).select(column, "keys", (F.col("keys") * 100.0 / F.col("all_")).alias("share"))


def churn(df: DataFrame, before: str, after: str) -> DataFrame:
    moved = F.count_if(F.col(before) != F.col(after))
    return df.agg(moved.alias("moved"), (F.count("*") - moved).alias("stayed"), (moved * 100.0 / F.count("*")).alias("moved_percent"))


def assign_replicas(partitions: DataFrame, brokers: list[int], factor: int, start: int = 0, shift: int = 0) -> DataFrame:
    """partitions (column p) with `replicas`: leaders go round, followers start one further each time round."""
    n = len(brokers)
    if n == 0 or factor <= 0 or factor > n:
        raise ValueError(f"{factor} replicas don't fit on {n} brokers")
    ids = F.array(*(F.lit(b) for b in brokers))
    leader = (F.col("p") + start) % n
    replicas = [leader]
    for j in range(1, factor):
        step = F.lit(shift) + F.floor(F.col("p") / n) + (j - 1)
        replicas.append((leader + 1 + step % (n - 1)) % n)
    return partitions.withColumn("replicas", F.array(*(F.element_at(ids, (r + 1).cast("int")) for r in replicas)))


def ranged_owner(p: str, partitions: int, brokers: int):
    """The broker of a partition where each holds a range of equal size."""
    return F.floor(F.col(p) / (partitions // brokers)).cast("int")


def rebalance(assignment: DataFrame, brokers: int, partitions: int) -> DataFrame:
    """assignment (p, owner; ranges of equal size) with `new_owner`: each broker's surplus over the new fair share, its last partitions, goes to a new one."""
    held = partitions // brokers
    surplus = held - partitions // (brokers + 1)
    return assignment.withColumn("new_owner", F.when(F.col("p") % held >= held - surplus, F.lit(brokers)).otherwise(F.col("owner")))


def sip_hash(data: list[bytes], key: bytes) -> np.ndarray:
    """SipHash-2-4 of each string, as signed 64-bit numbers."""
    k0, k1 = np.frombuffer(key, dtype="<u8").astype(np.uint64)
    sizes = np.array([len(d) for d in data], dtype=np.int64)
    words = sizes // 8 + 1
    width = int(words.max(initial=1))
    padded = np.zeros((len(data), width * 8), dtype=np.uint8)
    for i, d in enumerate(data):
        padded[i, : len(d)] = np.frombuffer(d, dtype=np.uint8)
        padded[i, words[i] * 8 - 1] = len(d) & 0xFF
    blocks = padded.view("<u8").astype(np.uint64)
    # fixed values: the initial state of the hash
    state = [np.full(len(data), int(k) ^ c, dtype=np.uint64) for k, c in ((k0, 0x736F6D6570736575), (k1, 0x646F72616E646F6D), (k0, 0x6C7967656E657261), (k1, 0x7465646279746573))]

    def rotated(x, b):
        return (x << np.uint64(b)) | (x >> np.uint64(64 - b))

    def rounds(s, n):
        a, b, c, d = s
        for _ in range(n):
            a, c = a + b, c + d
            b, d = rotated(b, 13) ^ a, rotated(d, 16) ^ c
            a = rotated(a, 32)
            c, a = c + b, a + d
            b, d = rotated(b, 17) ^ c, rotated(d, 21) ^ a
            c = rotated(c, 32)
        return [a, b, c, d]

    for w in range(width):
        live = words > w
        a, b, c, d = state
        moved = rounds([a, b, c, d ^ blocks[:, w]], 2)
        moved[0] = moved[0] ^ blocks[:, w]
        state = [np.where(live, m, s) for m, s in zip(moved, state, strict=True)]
    a, b, c, d = rounds([state[0], state[1], state[2] ^ np.uint64(0xFF), state[3]], 4)
    return (a ^ b ^ c ^ d).view(np.int64)


def place_objects(keys: DataFrame, sets: int, deployment: bytes | None = None) -> DataFrame:
    """keys (column key) with `set`: by SipHash under a deployment's 16 bytes, by checksum where they are missing or short; -1 without sets."""
    if sets <= 0:
        return keys.withColumn("set", F.lit(-1))
    if deployment is None or len(deployment) < 16:
        return keys.withColumn("set", crc_set(F.col("key"), sets))

    @F.pandas_udf("long")
    def hashed(key: pd.Series) -> pd.Series:
        return pd.Series(sip_hash([k.encode() for k in key.fillna("")], deployment[:16]))

    return keys.withColumn("set", floor_mod(hashed("key"), sets))


def all_nodes(sets: DataFrame, column: str) -> DataFrame:
    """(node): the distinct union of a column's nested lists of nodes; null lists add nothing."""
    return sets.select(F.explode(F.flatten(F.filter(column, lambda x: x.isNotNull()))).alias("node")).distinct()


def shard_quorum(shards: DataFrame, dead: DataFrame, k: int) -> DataFrame:
    """(object, available, state) from shards (object, node) and the nodes that are down: readable with all shards, at_risk from k, else lost."""
    live = shards.join(dead.select("node").distinct().withColumn("down_", F.lit(True)), "node", "left")
    counted = live.groupBy("object").agg(F.count_if(F.col("down_").isNull()).alias("available"), F.count("*").alias("shards"))
    state = F.when(F.col("available") < k, "lost").when(F.col("available") < F.col("shards"), "at_risk").otherwise("readable")
    return counted.select("object", "available", state.alias("state"))


def storage_overhead(objects: DataFrame, k: int, m: int, copies: int = 3) -> DataFrame:
    size = F.col("size")
    shard = F.floor((size + (k - 1)) / k)
    return objects.agg(F.sum(size).alias("bytes"), F.sum(size * copies).alias("replicated"), F.sum(shard * (k + m)).cast("long").alias("coded"))


# --- erasure coding ------------------------------------------------------------------------------

#: Fixed value: the field polynomial's low bits.
POLYNOMIAL = 29
_tables: dict = {}


def products() -> np.ndarray:
    """The 256 x 256 product table of the field."""
    if "product" not in _tables:
        exp, x = np.zeros(512, dtype=np.int64), 1
        for i in range(255):
            exp[i] = x
            x = (x << 1) ^ ((x >> 7) * (256 + POLYNOMIAL))
        exp[255:510] = exp[:255]
        log = np.zeros(256, dtype=np.int64)
        log[exp[:255]] = np.arange(255)
        table = exp[log[:, None] + log[None, :]]
        table[0, :] = table[:, 0] = 0
        _tables["product"], _tables["inverse"] = table.astype(np.uint8), np.concatenate([[0], exp[255 - log[1:]]]).astype(np.uint8)
    return _tables["product"]


def multiply(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The product of a matrix of the field with rows of bytes; two bytes are looked up at a time."""
    table = products()
    out = np.zeros((a.shape[0], b.shape[1]), dtype=np.uint8)
    even = b.shape[1] & ~1
    pairs = [row[:even].view(np.uint16) if row.flags.c_contiguous else np.ascontiguousarray(row[:even]).view(np.uint16) for row in b]
    for r in range(a.shape[0]):
        wide = out[r, :even].view(np.uint16)
        for i in np.flatnonzero(a[r]):
            wide ^= pairs[i] if a[r, i] == 1 else _wide_row(int(a[r, i]))[pairs[i]]
            if even < b.shape[1]:
                out[r, -1] ^= table[a[r, i], b[i, -1]]
    return out


def _wide_row(factor: int) -> np.ndarray:
    """The products of all pairs of bytes with one factor."""
    key = ("wide", factor)
    if key not in _tables:
        row = products()[factor].astype(np.uint16)
        _tables[key] = (row[None, :] | (row[:, None] << 8)).reshape(-1)
    return _tables[key]


def inverted(a: np.ndarray) -> np.ndarray:
    table, n = products(), len(a)
    work = np.concatenate([a.astype(np.uint8), np.eye(n, dtype=np.uint8)], axis=1)
    for c in range(n):
        pivot = c + int(np.flatnonzero(work[c:, c])[0])
        work[[c, pivot]] = work[[pivot, c]]
        work[c] = table[_tables["inverse"][work[c, c]], work[c]]
        for r in range(n):
            if r != c:
                work[r] ^= table[work[r, c], work[c]]
    return work[:, n:]


def coding_matrix(k: int, m: int) -> np.ndarray:
    """Systematic: powers of the row numbers, times the inverse of the first k rows."""
    table = products()
    powers = np.zeros((k + m, k), dtype=np.uint8)
    for r in range(k + m):
        value = 1
        for c in range(k):
            powers[r, c] = value
            value = table[value, r]
    return multiply(powers, inverted(powers[:k]))



def blocks_of(blobs: DataFrame, block: int) -> DataFrame:
    """(object, block, bytes) of blobs (object, content); a blob is sliced once, and an empty one is one empty block."""
    numbers = F.sequence(F.lit(0), F.greatest(F.floor((F.length("content") - 1) / block), F.lit(0)).cast("int"))
    cut = F.transform(numbers, lambda b: F.struct(b.alias("block"), F.substring(F.col("content"), b * block + 1, F.lit(block)).alias("bytes")))
    return blobs.select("object", F.explode(cut).alias("b")).select("object", "b.block", "b.bytes")


def _width(size: Column, k: int) -> Column:
    return F.greatest(F.floor((size + (k - 1)) / k), F.lit(1)).cast("int")


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values' lengths and their bytes one after the other, as they lie in the column's buffers."""
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, dtype=np.int32, count=len(column) + 1, offset=4 * column.offset)
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    return np.diff(ends), whole[ends[0] : ends[-1]]


def _binary(lengths: np.ndarray, data: np.ndarray) -> pa.Array:
    """The inverse of _flat."""
    ends = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(data)])


def _column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def shard_objects(blobs: DataFrame, k: int, m: int, block: int = 1 << 20) -> DataFrame:
    """blobs (object, content) as shards: each block as k data shards and m parity shards, zero padded; size is the block's own.

    Spark cuts blobs into blocks and blocks into data shards; Python adds the parity shards, one product for a batch of blocks whose
    bytes stay in the batch's buffers. A null content is an empty blob.
    """
    size = F.length("bytes")
    blocks = blocks_of(blobs.withColumn("content", F.coalesce("content", F.lit(b""))), block).withColumns({"size": size.cast("long"), "width_": _width(size, k)})
    blocks = blocks.withColumn("bytes", F.rpad(F.col("bytes"), F.col("width_") * k, F.lit(b"\0")))
    parts = blocks.select("object", "block", "size", *(F.substring("bytes", F.col("width_") * j + 1, F.col("width_")).alias(f"s{j}") for j in range(k)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parity = coding_matrix(k, m)[k:]
        for batch in batches:
            lengths, _ = _flat(_column(batch, "s0"))
            coded = multiply(parity, np.stack([_flat(_column(batch, f"s{j}"))[1] for j in range(k)])) if batch.num_rows else np.zeros((m, 0), dtype=np.uint8)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(_binary(lengths, c) for c in coded)], names=[*batch.schema.names, *(f"s{k + j}" for j in range(m))])

    kind = blobs.schema["object"].dataType.simpleString()
    whole = parts.mapInArrow(run, f"object {kind}, block int, size long, " + ", ".join(f"s{j} binary" for j in range(k + m)))
    each = F.explode(F.array(*(F.struct(F.lit(j).alias("shard"), F.col(f"s{j}").alias("bytes")) for j in range(k + m))))
    return whole.select("object", "block", "size", each.alias("s")).select("object", "block", "s.shard", "size", "s.bytes")


def _side_by_side(shards: DataFrame, k: int, m: int) -> DataFrame:
    """(object, block, size, s0, s1, ...) with the shards that are there; one whose length isn't that of its block is damaged, and so missing.

    A shard that was stored twice counts once.
    """
    fit = F.when(F.length("bytes") == _width(F.col("size"), k), F.col("bytes"))
    return shards.groupBy("object", "block").agg(F.max("size").alias("size"), *(F.max(F.when(F.col("shard") == j, fit)).alias(f"s{j}") for j in range(k + m)))


def repair_objects(shards: DataFrame, k: int, m: int) -> DataFrame:
    """(object, block, bytes, status) from the shards that are left: whole if k data shards are there, rebuilt from any k, else lost.

    Blocks of a batch that lost the same shards are rebuilt by one product with one inverse, over the batch's buffers.
    """
    inverses: dict[tuple, np.ndarray] = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [_column(batch, f"s{j}") for j in range(k + m)]
            there = np.stack([c.is_valid().to_numpy(zero_copy_only=False) for c in columns], axis=1)
            used = there & (np.cumsum(there, axis=1) <= k)
            code = used @ (1 << np.arange(k + m))
            pieces, order = [], []
            status = np.where(used.sum(axis=1) < k, "lost", np.where(used[:, :k].all(axis=1), "whole", "rebuilt"))
            for pattern in np.unique(code).tolist():
                rows = np.flatnonzero(code == pattern)
                some = tuple(j for j in range(k + m) if pattern >> j & 1)
                order.append(rows)
                if len(some) < k:
                    pieces.append(pa.nulls(len(rows), pa.binary()))
                    continue
                own = [columns[j].take(pa.array(rows)) for j in some]
                if some != tuple(range(k)):
                    if some not in inverses:
                        inverses[some] = inverted(coding_matrix(k, m)[list(some)])
                    lengths, _ = _flat(own[0])
                    own = [_binary(lengths, row) for row in multiply(inverses[some], np.stack([_flat(c)[1] for c in own]))]
                pieces.append(pc.binary_join_element_wise(*own, pa.scalar(b"", pa.binary())))
            back = pa.concat_arrays(pieces).take(pa.array(np.argsort(np.concatenate(order))))
            yield pa.RecordBatch.from_arrays([_column(batch, "object"), _column(batch, "block"), _column(batch, "size"), back, pa.array(status.tolist())], names=["object", "block", "size", "bytes", "status"])

    rows = _side_by_side(shards, k, m)
    kind = shards.schema["object"].dataType.simpleString()
    padded = rows.mapInArrow(run, f"object {kind}, block int, size long, bytes binary, status string")
    return padded.select("object", "block", F.substring("bytes", F.lit(1), F.col("size").cast("int")).alias("bytes"), "status")


def scrub_parity(shards: DataFrame, k: int, m: int) -> DataFrame:
    """(object, block, intact): whether the parity shards are what the data shards give; false if a shard is missing or damaged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [_column(batch, f"s{j}") for j in range(k + m)]
            intact = np.logical_and.reduce([c.is_valid().to_numpy(zero_copy_only=False) for c in columns])
            rows = np.flatnonzero(intact)
            if len(rows):
                own = [_flat(c.take(pa.array(rows))) for c in columns]
                every = np.stack([data for _, data in own])
                good = (multiply(coding_matrix(k, m)[k:], every[:k]) == every[k:]).all(axis=0)
                intact[rows] = np.logical_and.reduceat(good, np.cumsum(own[0][0]) - own[0][0])
            yield pa.RecordBatch.from_arrays([_column(batch, "object"), _column(batch, "block"), pa.array(intact)], names=["object", "block", "intact"])

    kind = shards.schema["object"].dataType.simpleString()
    return _side_by_side(shards, k, m).mapInArrow(run, f"object {kind}, block int, intact boolean")
