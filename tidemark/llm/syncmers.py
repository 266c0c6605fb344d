"""Document fingerprints from closed syncmers."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tidemark.llm import arrays

#: Digits of a fingerprint's numbers.
HEX = 10


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The texts' code points one after the other, and where each text begins and the last one ends."""
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return points, np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)


def window_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each `width` values in a row."""
    done = 1
    while 2 * done <= width:
        values = np.minimum(values[:-done], values[done:])
        done *= 2
    rest = width - done
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


class Hashes:
    """Hashes of any substrings of a run of code points, from one prefix sum."""

    def __init__(self, points: np.ndarray):
        up, self.down = arrays.powers(len(points) + 1)
        self.sums = np.zeros(len(points) + 1, dtype=np.uint64)
        np.cumsum(arrays.mix(points.astype(np.uint64) + np.uint64(1)) * up[:-1], out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return arrays.mix((self.sums[ends] - self.sums[starts]) * self.down[starts])

    def alike(self, a: np.ndarray, b: np.ndarray, most: np.ndarray, step: int) -> np.ndarray:
        """How many code points, up to `most`, are the same from a and from b on (step 1) or before them (step -1)."""
        low, high = np.zeros_like(most), most.copy()
        while (low < high).any():
            n = (low + high + 1) // 2
            same = self.of(a, a + n) == self.of(b, b + n) if step > 0 else self.of(a - n, a) == self.of(b - n, b)
            low, high = np.where(same, n, low), np.where(same, high, n - 1)
        return low


def closed_syncmers(points: np.ndarray, cuts: np.ndarray, k: int, s: int, hashes: Hashes | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, place in the text, hash) of every closed syncmer: a k-mer whose least s-mer is its first or its last.

    Whether a k-mer is one depends on itself alone, so an edit elsewhere in a text changes no anchor.
    A text of under k code points, or without a syncmer, is anchored by itself as a whole.
    """
    hashes = hashes or Hashes(points)
    sums, down, hashed = hashes.sums, hashes.down, hashes.of
    text = at = value = np.zeros(0, dtype=np.int64)
    if len(points) >= k:
        inner = arrays.mix((sums[s:] - sums[:-s]) * down[: len(sums) - s])
        wide = k - s + 1
        least = window_minimum(inner, wide)
        at = np.flatnonzero((inner[: len(least)] == least) | (inner[wide - 1 :] == least))
        text = np.searchsorted(cuts, at, side="right") - 1
        inside = at + k <= cuts[text + 1]
        at, text = at[inside], text[inside]
        value = hashed(at, at + k)
    none = np.setdiff1d(np.flatnonzero(np.diff(cuts)), text)
    text = np.concatenate([text, none])
    value = np.concatenate([value.astype(np.uint64), hashed(cuts[none], cuts[none + 1])])
    at = np.concatenate([at, cuts[none]]) - cuts[text]
    return text, at, value


def changes(*columns: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before it; the first one does."""
    differs = np.ones(len(columns[0]), dtype=bool)
    if len(differs):
        differs[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return differs


class Anchors:
    """The anchors of a slice of texts: their sketches, and the passages that texts share."""

    def __init__(self, texts: list[str], k: int, s: int):
        points, self.cuts = code_points(texts)
        self.hashes = Hashes(points)
        text, at, value = closed_syncmers(points, self.cuts, k, s, self.hashes)
        order = np.lexsort((at, value, text))
        self.text, self.at, self.value = text[order], at[order], value[order]
        self.first = np.searchsorted(self.text, np.arange(len(texts) + 1))
        new = np.flatnonzero(changes(self.text, self.value))
        self.nth = np.arange(len(self.text)) - np.repeat(new, np.diff(np.append(new, len(self.text))))

    def sketches(self, size: int) -> list[np.ndarray]:
        """For each text the `size` least different hashes of its anchors, in order."""
        value = self.value >> np.uint64(64 - 4 * HEX)
        new = changes(self.text, value)
        value, first = value[new], np.searchsorted(self.text[new], np.arange(len(self.first)))
        return [value[a : min(b, a + size)] for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]

    def passages(self, pairs: list[tuple[int, int]]) -> np.ndarray:
        """For each pair of texts the code points of the longest passage in both, as anchors in the same order find it.

        The n-th place of an anchor in one text is matched with the n-th in the other. Matches at one distance
        with the same text between them are one passage, which then grows to both sides as far as the texts
        agree. So a passage counts if one of its anchors is matched, and its length is exact.
        """
        longest = np.zeros(len(pairs), dtype=np.int64)
        key = arrays.mix(self.value ^ arrays.mix(self.nth.astype(np.uint64)))
        order = np.lexsort((key, self.text))
        key, place = key[order], (self.at + self.cuts[self.text])[order]
        found = []
        for i, (a, b) in enumerate(pairs):
            ours, theirs = slice(self.first[a], self.first[a + 1]), slice(self.first[b], self.first[b + 1])
            if ours.start == ours.stop or theirs.start == theirs.stop:
                continue
            to = np.minimum(np.searchsorted(key[theirs], key[ours]), theirs.stop - theirs.start - 1)
            hit = np.flatnonzero(key[theirs][to] == key[ours])
            found.append((np.full(len(hit), i), place[ours][hit], place[theirs][to[hit]]))
        if not found:
            return longest
        pair, x, y = (np.concatenate(c) for c in zip(*found, strict=True))
        order = np.lexsort((x, y - x, pair))
        pair, x, y = pair[order], x[order], y[order]
        head = changes(pair, y - x)
        follows = np.flatnonzero(~head)
        head[follows] = self.hashes.of(x[follows - 1], x[follows]) != self.hashes.of(y[follows - 1], y[follows])
        pair, x, y = pair[head], x[head], y[head]
        a, b = np.array(pairs, dtype=np.int64).reshape(-1, 2)[pair].T
        before = self.hashes.alike(x, y, np.minimum(x - self.cuts[a], y - self.cuts[b]), -1)
        after = self.hashes.alike(x, y, np.minimum(self.cuts[a + 1] - x, self.cuts[b + 1] - y), 1)
        np.maximum.at(longest, pair, before + after)
        return longest


def sketches(texts: list[str], k: int, s: int, size: int) -> list[np.ndarray]:
    """For each text the `size` least different hashes of its anchors, in order."""
    return Anchors(texts, k, s).sketches(size)


def likeness(a: np.ndarray, b: np.ndarray, size: int) -> float:
    """The Jaccard similarity of two texts' anchors, as their sketches show it; two empty texts are alike."""
    if len(a) == len(b) and (a == b).all():
        return 1.0
    if not len(a) or not len(b):
        return 0.0
    union = np.union1d(a, b)[:size]
    both = np.intersect1d(a, b, assume_unique=True)
    return float(np.isin(union, both, assume_unique=True).sum() / len(union))


def as_text(sketch: np.ndarray) -> str:
    return sketch.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - HEX // 2 :].tobytes().hex()


def anchors(docs: DataFrame, *, k: int = 12, s: int = 6, slice_bytes: int = 1 << 20) -> DataFrame:
    """(doc_id, position, anchor) of every closed syncmer of every text, for positional matching.

    Null and empty texts have none; repeated rows repeat theirs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = arrays.plain(batch.column(1))
            for first, last, _, _ in arrays.slices(texts, slice_bytes):
                text, at, value = closed_syncmers(*code_points(texts.slice(first, last - first).to_pylist()), k, s)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(text + first)), pa.array(at, type=pa.int64()), pa.array(value.view(np.int64))], names=["doc_id", "position", "anchor"])

    schema = T.StructType([docs.schema["doc_id"], T.StructField("position", T.LongType()), T.StructField("anchor", T.LongType())])
    return docs.select("doc_id", "text").mapInArrow(run, schema)


#: Rows of the sample behind each range's bound.
PER_BOUND = 32


def _with_followers(docs: DataFrame) -> DataFrame:
    """(part, rep, doc_id, text) in ranges of (doc_id, hash of the text); rep 1: the first document of the next range, after the own ones.

    There are four ranges a shuffle partition, or one for 4,096 documents up to 10,000, so that the session's setting
    bounds a task's share at any size. Bounds are quantiles of the rows with the least hashes, so ids of any type, repeated
    ones and nulls are cut alike; only rows that agree in id and text can't be parted. The bounds' sample and
    the first row of each range come to the driver, without texts.
    """
    spark = docs.sparkSession
    keyed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    key, slim = F.struct("doc_id", "h"), keyed.select("doc_id", "h")
    kind = docs.schema["doc_id"].dataType
    parts = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), min(10_000, keyed.count() // 4096))
    sample = slim.orderBy(F.xxhash64("doc_id", "h"), "h").limit(PER_BOUND * parts).collect()
    sample = sorted((r["doc_id"] is not None, r["doc_id"] if r["doc_id"] is not None else 0, r["h"]) for r in sample)
    cuts = sorted({sample[len(sample) * i // parts] for i in range(1, parts)}) if sample else []
    literal = lambda there, value, h: F.struct(F.lit(value if there else None).cast(kind).alias("doc_id"), F.lit(h).cast("long").alias("h"))
    if cuts:
        bounds, steps = F.array(*(literal(*c) for c in cuts)), [1 << k for k in reversed(range(len(cuts).bit_length()))]
        further = lambda at, step: F.when(F.get(bounds, at + step - 1) < key, at + step).otherwise(at)
        part = F.aggregate(F.lit(steps), F.lit(0), further)  # a binary search
    else:
        part = F.lit(0)
    firsts = slim.withColumn("part", part).groupBy("part").agg(F.min(key).alias("first")).orderBy("part").collect()
    before = [(r["first"]["doc_id"], r["first"]["h"], firsts[i - 1]["part"]) for i, r in enumerate(firsts)]  # the last range is before the first one
    follow = spark.createDataFrame(before, T.StructType([T.StructField("id_", kind), T.StructField("h_", T.LongType()), T.StructField("part", T.IntegerType())]))
    same = F.col("doc_id").eqNullSafe(F.col("id_")) & (F.col("h") == F.col("h_"))
    reps = keyed.join(F.broadcast(follow), same).groupBy("part").agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text"), F.first("h").alias("h"))  # a row for each range
    placed = keyed.select(part.alias("part"), F.lit(0).alias("rep"), "doc_id", "text", "h").unionByName(reps.select("part", F.lit(1).alias("rep"), "doc_id", "text", "h"))
    return placed.repartition("part").sortWithinPartitions("part", "rep", "doc_id", "h")


def fingerprint(docs: DataFrame, *, k: int = 12, s: int = 6, size: int = 64, share: int = 4, slice_chars: int = 1 << 17) -> DataFrame:
    """Each document's fingerprint, and that of its text with the last 1/share replaced from the next document.

    doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, and passage_edited and
    passage_next: the code points of the longest passage that the text shares with the edited and with the
    next text, found by matching all anchors with their places (0: none; a shared passage of 17 code points or
    more has an anchor, which finds it where its repeats stand in the same order). Documents go once through a shuffle by ranges of
    doc_id; a task reads its ranges in order, holding a slice of texts and one row over. Null texts are
    empty: their fingerprint is empty. Ids may have any type that has an order. Documents with the same doc_id follow each other in the order of
    their texts' hashes; null ids come first; a lone document follows itself; an empty table gives no rows.
    """
    schema = T.StructType(
        [docs.schema["doc_id"]]
        + [T.StructField("n_chars", T.LongType())]
        + [T.StructField(c, T.StringType()) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")]
        + [T.StructField(c, T.DoubleType()) for c in ("near_edited", "near_next")]
        + [T.StructField(c, T.LongType()) for c in ("passage_edited", "passage_next")]
    )

    kind = to_arrow_type(docs.schema["doc_id"].dataType)

    def finished(rows: list[tuple], follower: tuple | None) -> tuple[pa.RecordBatch, np.ndarray | None]:
        """rows: (part, rep, doc_id, text) in order; all but those with rep get a result."""
        chain = [*rows, follower] if follower else rows
        own = [i for i in range(len(rows)) if rows[i][1] == 0]
        texts = [r[3] for r in chain]
        following = {i: i + 1 if i + 1 < len(chain) and chain[i + 1][0] == chain[i][0] else i for i in own}
        edited = []
        for i in own:
            text, after = texts[i], texts[following[i]]
            cut = len(text) // share
            edited.append(text[: len(text) - cut] + after[:cut])
        found = Anchors(texts + edited, k, s)
        prints = found.sketches(size)
        plain, changed = prints[: len(texts)], prints[len(texts) :]
        shared = found.passages([*((i, len(texts) + n) for n, i in enumerate(own)), *following.items()])
        return pa.RecordBatch.from_arrays(
            [
                pa.array([rows[i][2] for i in own], type=kind),
                pa.array([len(texts[i]) for i in own], type=pa.int64()),
                pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], type=pa.string()),
                pa.array([as_text(plain[i]) for i in own], type=pa.string()),
                pa.array([as_text(p) for p in changed], type=pa.string()),
                pa.array([likeness(plain[i], p, size) for i, p in zip(own, changed, strict=True)], type=pa.float64()),
                pa.array([likeness(plain[i], plain[j], size) for i, j in following.items()], type=pa.float64()),
                pa.array(shared[: len(own)], type=pa.int64()),
                pa.array(shared[len(own) :], type=pa.int64()),
            ],
            names=schema.names,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        chars = 0
        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(c)) for c in ("part", "rep", "doc_id", "text")]
            for first in range(0, batch.num_rows, 256):
                for row in zip(*(c.slice(first, 256).to_pylist() for c in columns), strict=True):
                    if rows and chars > slice_chars:
                        yield finished(rows, row)
                        rows, chars = [], 0
                    rows.append(row)
                    chars += len(row[3])
        if rows:
            yield finished(rows, None)

    return _with_followers(docs.select("doc_id", "text")).select("part", "rep", "doc_id", "text").mapInArrow(run, schema)


def op4_syncmers(spark, sf_dir: str) -> DataFrame:
    return fingerprint(spark.read.parquet(f"{sf_dir}/documents.parquet"))
