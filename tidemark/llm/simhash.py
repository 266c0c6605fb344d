"""SimHash fingerprints and their near duplicates by bit-sliced comparison."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import arrays
from tidemark.llm.graph import Names, columns, connected_components, shared_folder, small

#: Spreads a byte's bits over eight byte-wide counters, the highest bit first.
SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.uint8).copy().view(np.uint64).ravel()


def shingle_hashes(text: bytes, words: int, seed: int = 42) -> np.ndarray:
    """XXH64 of each run of `words` words (a shorter text: of the whole sequence; none: nothing)."""
    tokens = text.lower().split()
    if not tokens:
        return np.zeros(0, dtype=np.uint64)
    joined = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), dtype=np.int64, count=len(tokens)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(tokens) - words + 1)
    pieces = map(joined.__getitem__, map(slice, starts[:n].tolist(), ends[min(words, len(tokens)) - 1 :].tolist()))
    return np.fromiter(map(xxhash.xxh64_intdigest, pieces, repeat(seed)), dtype=np.uint64, count=n)


def majority_bits(hashes: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """For each run of hashes between two cuts, the bits that are set in over half of them.

    Eight byte-wide counters share a machine word, so 255 hashes are added before any is widened.
    """
    counts = np.diff(cuts)
    out = np.zeros(len(counts), dtype=np.uint64)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    spread = SPREAD[hashes.astype(">u8").view(np.uint8).reshape(-1, 8)]
    pieces = -(-counts[full] // 255)
    owner = np.repeat(np.arange(len(full)), pieces)
    step = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    sums = np.add.reduceat(spread, cuts[full][owner] + 255 * step, axis=0).view(np.uint8).reshape(-1, 64).astype(np.int64)
    totals = np.add.reduceat(sums, np.cumsum(pieces) - pieces, axis=0)
    bits = np.packbits((2 * totals > counts[full][:, None]).astype(np.uint8), axis=1)
    out[full] = bits.view(">u8").ravel().astype(np.uint64)
    return out


def _fingerprint_task(kept: list[str], words: int, planes: int, minima: int, distinct: bool = False):
    salts = arrays.mix(np.arange(1, planes + 1, dtype=np.uint64))
    keys = arrays.mix(np.arange(1001, 1001 + minima, dtype=np.uint64)) | np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, offsets, data in arrays.slices(batch.column(batch.schema.get_field_index("text")), 1 << 20):
                raw = data.tobytes()
                parts = [shingle_hashes(raw[a:b], words) for a, b in itertools.pairwise(offsets.tolist())]
                parts = [np.unique(p) for p in parts] if distinct else parts
                cuts = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
                hashes = np.concatenate(parts)
                fp = [majority_bits(hashes if k == 0 else arrays.mix(hashes ^ salts[k]), cuts) for k in range(planes)]
                columns = [batch.column(batch.schema.get_field_index(c)).slice(first, last - first) for c in kept]
                columns.append(pa.array(list(np.stack(fp, axis=1).view(np.int64)), type=pa.list_(pa.int64())))
                if minima:
                    low = np.zeros((len(parts), minima), dtype=np.int64)
                    full = np.flatnonzero(np.diff(cuts))
                    for k in range(minima if len(full) else 0):
                        low[full, k] = np.minimum.reduceat(arrays.mix(hashes * keys[k]), cuts[full]).view(np.int64)
                    columns.append(pa.array(list(low), type=pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(columns, names=[*kept, "fp", "minima"][: len(columns)])

    return run


def fingerprints(docs: DataFrame, *, kept: tuple[str, ...] = ("doc_id",), words: int = 3, planes: int = 1, minima: int = 0, distinct: bool = False) -> DataFrame:
    """(kept, fp, minima) of every whole text: fp has `planes` 64-bit numbers, the first the SimHash of the
    shingles' XXH64, the others of mixed copies of it; minima has that many minima of shingle hashes.
    With `distinct` a shingle counts once however often it is in the text."""
    fields = [docs.schema[c] for c in kept] + [T.StructField("fp", T.ArrayType(T.LongType())), T.StructField("minima", T.ArrayType(T.LongType()))]
    task = _fingerprint_task(list(kept), words, planes, minima, distinct)
    return docs.select(*kept, "text").mapInArrow(task, T.StructType(fields if minima else fields[:-1]))


# --- bit-sliced comparison -----------------------------------------------------------------------


class Counters:
    """Vertical counters: bit k of the counts of all lanes in one array, added to by carry-save steps.

    They start so far up that a count which goes over the radius overflows; `over` keeps those lanes. Three planes
    are first reduced to a sum and a carry, so that most planes don't ripple through the counters.
    """

    def __init__(self, shape, radius: int):
        self.width = radius.bit_length()
        start = (1 << self.width) - 1 - radius
        self.bits = [np.full(shape, ~np.uint64(0) if start >> k & 1 else 0, dtype=np.uint64) for k in range(self.width)]
        self.over = np.zeros(shape, dtype=np.uint64)
        self.held: list[list[np.ndarray]] = [[] for _ in range(self.width)]

    def add(self, plane: np.ndarray, k: int = 0) -> None:
        """Counts a plane of bits that weigh 2^k."""
        if k == self.width:
            self.over |= plane
            return
        held = self.held[k]
        held.append(plane)
        if len(held) == 3:
            a, b, c = held
            self.held[k] = []
            half = a ^ b
            self.add((a & b) | (half & c), k + 1)
            self.settle(half ^ c, k)

    def settle(self, plane: np.ndarray, k: int) -> None:
        carry = self.bits[k] & plane
        self.bits[k] = self.bits[k] ^ plane
        if k + 1 == self.width:
            self.over |= carry
        else:
            self.add(carry, k + 1)

    def beyond(self) -> np.ndarray:
        """The lanes that are known to be over the radius so far."""
        return self.over

    def within(self) -> np.ndarray:
        for k in range(self.width):
            for plane in self.held[k]:
                carry = plane
                for j in range(k, self.width):
                    self.bits[j], carry = self.bits[j] ^ carry, self.bits[j] & carry
                self.over |= carry
            self.held[k] = []
        return ~self.over


def within_radius(planes: np.ndarray, queries: np.ndarray, radius: int) -> np.ndarray:
    """Words of bits, (queries, words): which lanes of `planes` lie within `radius` bits of each query.

    planes[b] holds bit b of 64 fingerprints in each word, queries[:, b] is all ones or zeros. The differing bits of
    every lane are counted in vertical counters; a block is given up once all its lanes are over the radius.
    """
    counters = Counters((len(queries), planes.shape[1]), radius)
    for b in range(len(planes)):
        counters.add(planes[b][None, :] ^ queries[:, b][:, None])
        if b % 32 == 31 and b > radius and (counters.beyond() == ~np.uint64(0)).all():
            break
    return counters.within()


def vertical(fps: np.ndarray) -> np.ndarray:
    """Bit planes (bits, words) of fingerprints (n, numbers); unused lanes repeat the first one."""
    bits = np.unpackbits(fps.astype(">u8").view(np.uint8).reshape(len(fps), -1), axis=1)
    pad = -len(bits) % 64
    bits = np.concatenate([bits, np.repeat(bits[:1], pad, axis=0)])
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view(np.uint64)


def block_components(fps: np.ndarray, radius: int, most: int = 256) -> np.ndarray:
    """For each fingerprint of one block the least index that it is linked to, through any others.

    Up to `most` queries at a time are compared with fingerprints that weren't queries yet. Those of one
    component that were reached go first, against all outside of it, so a dense block takes a few
    rounds; where none wait, the next ones in order go, against all. Links are united, not listed by pairs.
    """
    n = len(fps)
    root = np.arange(n)
    open_, reached = np.ones(n, dtype=bool), np.zeros(n, dtype=bool)

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    while open_.any():
        while not (root[root] == root).all():
            root = root[root]
        waiting = np.flatnonzero(open_ & reached)
        if len(waiting):
            own = root[waiting[0]]
            queries, targets = waiting[root[waiting] == own][:most], np.flatnonzero(open_ & (root != own))
        else:
            targets = np.flatnonzero(open_)
            queries = targets[:most]
        open_[queries] = False
        if not len(targets):
            continue
        bits = np.unpackbits(fps[queries].astype(">u8").view(np.uint8).reshape(len(queries), -1), axis=1).astype(np.uint64)
        near = within_radius(vertical(fps[targets]), np.uint64(0) - bits, radius)
        linked = np.unpackbits(np.ascontiguousarray(near).view(np.uint8), axis=1, bitorder="little")[:, : len(targets)].astype(bool)
        hit = linked.any(axis=0)
        first = linked.argmax(axis=0)  # of the queries that reach a target; the others are united with it
        pairs = [(queries[first[hit]], targets[hit])]
        for k in range(len(queries)):
            others = np.unique(first[linked[k]])
            others = others[others != k]
            if len(others):
                pairs.append((np.full(len(others), queries[k]), queries[others]))
        for u, v in pairs:
            some = u != v
            for x, y in zip(u[some].tolist(), v[some].tolist(), strict=True):
                x, y = find(x), find(y)
                root[max(x, y)] = min(x, y)
        reached[targets[hit]] = True
    while not (root[root] == root).all():
        root = root[root]
    return root


def lane_components(fps: np.ndarray, heads: np.ndarray, sizes: np.ndarray, radius: int) -> np.ndarray:
    """The same for many blocks of at most 64 fingerprints at once: each block is one lane word."""
    n, blocks = int(sizes.max()), len(heads)
    member = np.minimum(np.arange(n)[None, :], sizes[:, None] - 1)
    rows = heads[:, None] + member
    bits = np.unpackbits(fps[rows].astype(">u8").view(np.uint8).reshape(blocks, n, -1), axis=2)
    planes = np.zeros((bits.shape[2], blocks), dtype=np.uint64)
    for j in range(n):
        planes |= bits[:, j, :].T.astype(np.uint64) << np.uint64(j)
    label = np.tile(np.arange(n), (blocks, 1))
    near = []
    for k in range(n):
        mask = np.uint64(0) - ((planes >> np.uint64(k)) & np.uint64(1))
        near.append(_near_lanes(planes ^ mask, radius))
    changed = True
    while changed:
        before = label.copy()
        for k in range(n):
            for j in range(k):
                linked = (near[k] >> np.uint64(j) & np.uint64(1)).astype(bool) & (k < sizes)
                low = np.minimum(label[:, k], label[:, j])
                label[:, k] = np.where(linked, low, label[:, k])
                label[:, j] = np.where(linked, low, label[:, j])
        changed = not np.array_equal(before, label)
    out = np.arange(len(fps))
    used = np.arange(n)[None, :] < sizes[:, None]
    out[rows[used]] = (heads[:, None] + label)[used]
    return out


def _near_lanes(differing: np.ndarray, radius: int) -> np.ndarray:
    counters = Counters(differing.shape[1:], radius)
    for plane in differing:
        counters.add(plane)
    return counters.within()


def _compare_task(planes: int, radius: int):
    """Rows (key, fp, node) sorted by key and fingerprint, in batches; out go (a, b) from each member's node to its component's first."""

    def components(keys: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        sizes = np.diff(np.append(new, len(keys)))
        root = np.arange(len(keys))
        for low, high in ((2, 2), (3, 4), (5, 8), (9, 16), (17, 64)):
            some = (sizes >= low) & (sizes <= high)
            for part in np.array_split(np.flatnonzero(some), max(1, int(some.sum()) * planes * high // 400_000)):
                if len(part):
                    got = lane_components(fps, new[part], sizes[part], radius)
                    rows = np.concatenate([np.arange(h, h + s) for h, s in zip(new[part], sizes[part], strict=True)])
                    root[rows] = got[rows]
        for g in np.flatnonzero(sizes > 64):
            root[new[g] : new[g] + sizes[g]] = block_components(fps[new[g] : new[g] + sizes[g]], radius) + new[g]
        linked = np.flatnonzero(root != np.arange(len(keys)))
        return linked, root[linked]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, pa.Array]] = []

        def flush(upto_last_key: bool):
            keys, fps = (np.concatenate([h[k] for h in held]) for k in (0, 1))
            nodes = pa.concat_arrays([h[2] for h in held])
            cut = int(np.searchsorted(keys, keys[-1])) if upto_last_key else len(keys)
            held[:] = [(keys[cut:], fps[cut:], nodes.slice(cut))] if cut < len(keys) else []
            if not cut:
                return None
            a, b = components(keys[:cut], fps[:cut])
            return pa.RecordBatch.from_arrays([nodes.take(pa.array(a)), nodes.take(pa.array(b))], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            fps = batch.column(1).flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(-1, planes)
            held.append((keys, fps, batch.column(2)))
            if sum(len(k) for k, _, _ in held) >= 20_000 and (out := flush(True)) is not None:
                yield out
        if held and (out := flush(False)) is not None:
            yield out

    return run


def band_keys(bits: int, radius: int, bands: int) -> list[list[tuple[int, int]]]:
    """Which bits stay in a key: all choices of bands - radius bands; two numbers within the radius agree in one choice."""
    edges = [round(k * bits / bands) for k in range(bands + 1)]
    return [[(edges[i], edges[i + 1]) for i in choice] for choice in itertools.combinations(range(bands), bands - radius)]


def _node(id_: str, *own: str) -> Column:
    """The name of a node of the graph: what it stands for, after the least doc_id of its rows, null after all others. The least node of a component so has its least doc_id."""
    return F.struct(F.col(id_).isNull().alias("none"), F.col(id_).alias("id"), *own)


def exact_links(fps: DataFrame, radius: int = 2, bands: int = 8) -> DataFrame:
    """Links (a, b) of nodes that connect all the 64-bit fingerprints (fp, distinct, each with its node) within `radius` bits of each other.

    Two such numbers agree in at least bands - radius of `bands` equal bands. Every choice of so many bands is
    a key, and the rows of a key form a block. A block holds distinct numbers with 64 * radius / bands free
    bits, so it has 65,536 members at most for radius 2 and 8 bands, however large the table is.
    """
    keys = []
    for k, choice in enumerate(band_keys(64, radius, bands)):
        mask = sum(((1 << (hi - lo)) - 1) << lo for lo, hi in choice)
        mask -= (mask >> 63) << 64
        keys.append(F.xxhash64(F.lit(k), F.col("fp").bitwiseAND(F.lit(mask))))
    return _links(fps.select(F.explode(F.array(*keys)).alias("key"), F.array("fp").alias("fp"), "node"), 1, radius)


def _links(blocks: DataFrame, planes: int, radius: int) -> DataFrame:
    rows = blocks.select("key", "fp", "node").repartition("key").sortWithinPartitions("key", "fp")
    node = blocks.schema["node"].dataType
    return rows.mapInArrow(_compare_task(planes, radius), T.StructType([T.StructField("a", node), T.StructField("b", node)]))


def simhash_components(docs: DataFrame, *, words: int = 3, radius: int = 2) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the least doc_id reachable over links of fingerprints.

    Copies meet in one row per distinct fingerprint before anything is compared. Null and empty texts
    have fingerprint zero and are linked like any other; repeated rows are kept, each with its component;
    rows with a null doc_id get the component of their fingerprint, null if it has no row with an id; an empty
    table gives no rows. Ids may be any numbers or texts; columns other than doc_id and text aren't used.
    """
    shared_folder(docs.sparkSession)
    prints = fingerprints(docs, words=words).select("doc_id", F.col("fp")[0].alias("fp")).checkpoint()
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("least")).select("fp", _node("least", "fp").alias("node")).checkpoint()
    roots = connected_components(exact_links(distinct, radius))
    rooted = distinct.join(roots, "node", "left").select("fp", F.when(F.col("root").isNull(), F.col("node.id")).otherwise(F.col("root.id")).alias("component_id"))
    return prints.join(rooted, "fp").select("doc_id", "fp", "component_id")


def op8_simhash(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return simhash_components(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# --- near duplicates by similarity ---------------------------------------------------------------


def differing_share(similarity: float, most: int = 40) -> float:
    """The largest chance that a bit differs in two sets of shingles with at least this Jaccard similarity.

    Of large sets it is the angle's share; up to `most` shared shingles, where ties count, it is summed up exactly.
    """
    worst = math.acos(2 * similarity / (1 + similarity)) / math.pi

    def chance(shared: int, own: int, s: int) -> float:  # that over half of shared + own bits are set, s of them in the shared ones
        return sum(math.comb(own, k) for k in range(own + 1) if 2 * (s + k) > shared + own) / 2**own

    for shared in range(1, most + 1):
        others = math.floor(shared * (1 / similarity - 1) + 1e-9)
        for x in range(others + 1):
            for y in range(min(x, others - x) + 1):
                p = [(chance(shared, x, s), chance(shared, y, s), math.comb(shared, s) / 2**shared) for s in range(shared + 1)]
                worst = max(worst, sum(w * (a * (1 - b) + b * (1 - a)) for a, b, w in p))
    return worst


def radius_of(similarity: float, bits: int) -> int:
    """The differing bits to be expected at most at a Jaccard similarity of shingles, and three standard deviations."""
    share = differing_share(similarity)
    return round(bits * share + 3 * math.sqrt(bits * share * (1 - share)))


def text_name(text: str = "text") -> Column:
    """Sixteen bytes that name a text; texts without a word share one name."""
    return F.unhex(F.md5(F.when(F.col(text).rlike(r"[^\x20\x09-\x0D]"), F.col(text)).otherwise(F.lit(""))))


def _groups(rows: DataFrame, words: int, similarity: float, planes: int, bands: int, most: int) -> DataFrame:
    """(node, copies, root) of the distinct texts of rows (doc_id, text): root is the least node linked to it, through any others."""
    from tidemark.llm.jaccard import shingle_sets, verified_links

    shared_folder(rows.sparkSession)
    extra = 8
    named = rows.select("doc_id", text_name().alias("name"), "text")
    prints = fingerprints(named, kept=("doc_id", "name"), words=words, planes=planes, minima=2 * bands + extra, distinct=True)
    distinct = prints.groupBy("name").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies"), F.first("fp").alias("fp"), F.first("minima").alias("minima"))
    distinct = distinct.select(_node("least", "name").alias("node"), "copies", "fp", "minima").checkpoint()
    keys = F.array(*(F.xxhash64(F.lit(k), F.col("minima")[2 * k], F.col("minima")[2 * k + 1]) for k in range(bands)))
    blocks = distinct.select(F.explode(keys).alias("key"), "fp", "node", F.slice("minima", 2 * bands + 1, extra).alias("more"))
    beyond = lambda b: small(b.groupBy("key").count().filter(F.col("count") > most).select("key", F.lit(True).alias("large")))
    finer = F.when(F.col("large"), F.array(*(F.xxhash64("key", F.lit(k), F.col("more")[k]) for k in range(extra)))).otherwise(F.array("key"))
    blocks = blocks.join(beyond(blocks), "key", "left").select(F.explode(finer).alias("key"), "fp", "node")
    large = beyond(blocks)
    links = _links(blocks.join(large, "key", "left_anti"), planes, radius_of(similarity, 64 * planes))
    alike = blocks.join(large, "key").select("key", "node")
    first = small(alike.groupBy("key").agg(F.min("node").alias("b")))
    links = links.unionByName(alike.join(first, "key").select(F.col("node").alias("a"), "b"))
    candidates = connected_components(links).select("root", "node", F.col("node.name").alias("name"), F.col("node.id").alias("least"))
    texts = named.join(candidates, (named["name"] == candidates["name"]) & named["doc_id"].eqNullSafe(candidates["least"])).select("root", "node", "text")
    roots = connected_components(verified_links(shingle_sets(texts, words), similarity))
    return distinct.select("node", "copies").join(roots, "node", "left").select("node", "copies", F.when(F.col("root").isNull(), F.col("node")).otherwise(F.col("root")).alias("root"))


def near_duplicates(docs: DataFrame, *, words: int = 5, similarity: float = 0.8, planes: int = 16, bands: int = 10, most: int = 20_000) -> DataFrame:
    """(doc_id, component_id) of every row: groups of texts linked by an exact Jaccard similarity of `similarity` or more.

    The similarity is that of the sets of shingles of `words` words (a shorter text is one shingle). Fingerprints of
    64 * planes bits find the candidates: pairs within radius_of(similarity), three standard deviations beyond the expected
    distance, are united; the members of each united group are then compared by their sets. Blocks to compare
    are keyed by pairs of shingle minima, `bands` of them (two texts of similarity 0.8 share none with a chance
    of 4e-5); a block of over `most` distinct texts is split by eight further minima, each with a block
    of its own, so its members meet again if alike (all but a chance of 3e-6), while texts that merely share a passage part. What
    is over `most` even then is one group of candidates as it stands, and no task ever holds it: see verified_links.

    Texts without a word form a group. Nodes of the graph are texts, not ids: unlike texts under one doc_id are apart, rows
    without a doc_id are grouped by their texts (component_id is null if no row of the group has an id), ids may be any
    numbers or texts. Repeated rows keep their group; ties go to the least doc_id; an empty table gives no rows; other columns
    aren't used.
    """
    rows = docs.select("doc_id", "text")
    groups = _groups(rows, words, similarity, planes, bands, most).select(F.col("node.name").alias("name"), F.col("root.id").alias("component_id"))
    return rows.select("doc_id", text_name().alias("name")).join(groups, "name").select("doc_id", "component_id")


def keep_one(docs: DataFrame, *, words: int = 5, similarity: float = 0.8, planes: int = 16, bands: int = 10, most: int = 20_000) -> DataFrame:
    """The rows of docs that stand for their group: one for each group of near_duplicates, with the least doc_id.

    Of several rows with that text and doc_id the one with the least hash stays. Rows without a doc_id come after all others, and a
    group of such rows alone is represented by one of them. All columns pass through, whatever their names.
    """
    names, free = docs.columns, Names(docs)
    name, least, copies, pick = (free(n) for n in ("name", "least", "copies", "pick"))
    groups = _groups(docs.select("doc_id", "text"), words, similarity, planes, bands, most)
    heads = groups.filter("node = root").select(F.col("node.name").alias(name), F.col("node.id").alias(least), F.col("copies").alias(copies)).checkpoint()
    rows = docs.withColumn(name, text_name())
    found = rows.join(heads, (rows[name] == heads[name]) & rows["doc_id"].eqNullSafe(heads[least])).select(*columns(names), heads[name], copies)
    hashed = columns([f.name for f in docs.schema if not any(kind in f.dataType.simpleString() for kind in ("map<", "variant"))])
    repeated = found.filter(F.col(copies) > 1).groupBy(name).agg(F.min_by(F.struct(*columns(names)), F.xxhash64(*hashed)).alias(pick))
    return found.filter(F.col(copies) == 1).select(*columns(names)).unionByName(repeated.select(f"{pick}.*"))
