"""Phrase collocations by best-first branch and bound over a prefix tree of words.

A phrase's score is at most 1000 n / f(w), w its first word: it may be cut there, and the rest is as frequent as the phrase at
least. So words are the roots of subtrees with admissible bounds, and rare ones go first. The frontier is expanded in waves, each
grown word by word from the prefixes that are frequent enough; a wave's phrases are scored and settled against those
that contain them, and each language's score in the last place closes all subtrees whose bound is below it. What is open
then, ties included, is the next wave. A wave may be of any size without changing the result.

Words are known by hashes which the first pass proves to be different for different words. Tasks get bit maps of open prefixes, of a
fixed size however many those are; a false one costs a few rows, which the exact counts drop. Counts are combined in the
tasks before they are shuffled, so frequent phrases and copies are no hot keys.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import arrays
from tidemark.sources.files import discard, workspace

IS_CUT = np.zeros(256, dtype=bool)
IS_CUT[[*b".,;:!?", *range(10, 14)]] = True
IS_PIECE_WORD = ~IS_CUT
IS_PIECE_WORD[[32, 9]] = False
#: Least and largest long, where a group has no neighbour.
LEAST, MOST = -(2**63), 2**63 - 1


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    values = np.random.default_rng(seed).integers(1, 2**63, 256, dtype=np.uint64)
    return arrays.RollingHash(data, values).of(starts, ends)


def phrase_keys(langs: np.ndarray, words: list[np.ndarray]) -> np.ndarray:
    """One number for each phrase, for the bit maps and for grouping in a task."""
    key = langs
    for w in words:
        key = arrays.mix(key * np.uint64(0x9E3779B97F4A7C15) + w)
    return key


def lang_keys(langs: list[str]) -> np.ndarray:
    return np.array([int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in langs], dtype=np.uint64)


def grouped(key: np.ndarray, columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first row, group of each row, rows of each group): rows with the same values in all columns, found by their key."""
    _, first, group, counts = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
    if any((c != c[first][group]).any() for c in columns):  # two phrases with one key
        _, first, group, counts = np.unique(np.stack(columns), axis=1, return_index=True, return_inverse=True, return_counts=True)
    return first, group, counts


class BitMap:
    """Which phrases are meant: all of them, and by chance a few others."""

    def __init__(self, words: np.ndarray):
        self.words, self.bits = words, np.uint64(64 * len(words) - 1)

    def has(self, keys: np.ndarray) -> np.ndarray:
        at = keys & self.bits
        return (self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1


#: Bits of a map: 16 for each phrase, within these bounds (the larger is 32 MB).
FEWEST_BITS, MOST_BITS = 1 << 20, 1 << 28


def bit_map(phrases: DataFrame, bits: int | None):
    """The bit map of phrases (lang, phrase: hashes of words), made in Spark and sent to the tasks; bits / 64 numbers come to the driver."""
    if bits is None:
        bits = min(max(1 << (16 * phrases.count()).bit_length(), FEWEST_BITS), MOST_BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, lists = lang_keys(batch.column(0).to_pylist()), batch.column(1)
            sizes, flat = lists.value_lengths().to_numpy(), lists.flatten().to_numpy().view(np.uint64)
            starts, key = np.cumsum(sizes) - sizes, langs
            for i in range(int(sizes.max(initial=0))):
                on = sizes > i
                key = np.where(on, phrase_keys(key, [flat[np.where(on, starts + i, 0)]]), key)
            at = key & np.uint64(bits - 1)
            yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(6)).astype(np.int64)), pa.array((np.uint64(1) << (at & np.uint64(63))).view(np.int64))], names=["at", "mask"])

    found = phrases.select("lang", "phrase").mapInArrow(run, "at long, mask long").groupBy("at").agg(F.bit_or("mask").alias("mask")).toArrow()
    words = np.zeros(bits // 64, dtype=np.uint64)
    words[found.column("at").to_numpy()] = found.column("mask").to_numpy().view(np.uint64)
    return phrases.sparkSession.sparkContext.broadcast(BitMap(words))


def _pieces(batch: pa.RecordBatch, slice_bytes: int) -> Iterator[tuple]:
    """Of each slice of (lang, text): its languages, their keys, the lower-case bytes, words' starts, ends and rows, and cuts before them."""
    for first, last, offsets, data in arrays.slices(batch.column(1), slice_bytes):
        langs = batch.column(0).slice(first, last - first).to_pylist()
        data = arrays.LOWER[data]
        starts, ends = arrays.runs(IS_PIECE_WORD[data], offsets)
        rows = np.repeat(np.arange(last - first), np.diff(arrays.owners(offsets, starts)))
        piece = np.cumsum(IS_CUT[data], dtype=np.int64)[starts] + rows if len(starts) else rows
        yield langs, data, starts, ends, rows, piece


def _alike(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray, at_once: int = 1 << 16) -> bool:
    """Whether the words at a and at b, of these sizes, are the same, byte by byte."""
    for i in range(0, len(a), at_once):
        part = size[i : i + at_once]
        step = np.arange(part.sum()) - np.repeat(np.cumsum(part) - part, part)
        if (data[np.repeat(a[i : i + at_once], part) + step] != data[np.repeat(b[i : i + at_once], part) + step]).any():
            return False
    return True


class Tally:
    """Words and their counts over the slices of a task, given out when they are many."""

    def __init__(self, most: int = 400_000):
        self.most, self.keys, self.parts = most, np.zeros(0, dtype=np.uint64), None

    def add(self, keys: np.ndarray, part: tuple) -> Iterator[pa.RecordBatch]:
        if self.parts is not None:
            keys, part = np.concatenate([self.keys, keys]), tuple(np.concatenate(x) for x in zip(self.parts, part, strict=True))
        _, first, group = np.unique(keys, return_index=True, return_inverse=True)
        langs, hashes, words, counts = part
        if (words[first][group] != words).any() or (langs[first][group] != langs).any():  # two words with one key: none is joined
            self.keys, self.parts = keys, part
            yield from self.out()
            return
        self.keys, self.parts = keys[first], (langs[first], hashes[first], words[first], np.bincount(group, counts).astype(np.int64))
        if len(first) > self.most:
            yield from self.out()

    def out(self) -> Iterator[pa.RecordBatch]:
        if self.parts is not None:
            langs, hashes, words, counts = self.parts
            self.keys, self.parts = np.zeros(0, dtype=np.uint64), None
            yield pa.RecordBatch.from_arrays([pa.array(langs.tolist(), type=pa.string()), pa.array(hashes.view(np.int64)), pa.array([w.decode() for w in words.tolist()], type=pa.string()), pa.array(counts)], names=["lang", "hash", "word", "n"])


def _counted(corpus: DataFrame, seed: int, slice_bytes: int) -> DataFrame:
    """(lang, hash, word, f) of all words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Tally()
        for batch in batches:
            for langs, data, starts, ends, rows, _ in _pieces(batch, slice_bytes):
                if not len(starts):
                    continue
                own, size, hashes = lang_keys(langs)[rows], ends - starts, word_hashes(data, starts, ends, seed)
                first, group, counts = grouped(phrase_keys(own, [hashes]), [own, size])
                if not _alike(data, starts, starts[first[group]], size):
                    # two words with one hash are rows of their own here, which shows below
                    spelled = np.array([data[a:b].tobytes() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], dtype=object)
                    which = np.unique(spelled, return_inverse=True)[1].astype(np.uint64)
                    first, _, counts = grouped(phrase_keys(own, [which]), [own, which])
                spelled = np.array([data[a:b].tobytes() for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)], dtype=object)
                part = (np.array(langs, dtype=object)[rows[first]], hashes[first], spelled, counts)
                yield from known.add(phrase_keys(own[first], [hashes[first]]), part)
        yield from known.out()

    return corpus.mapInArrow(run, "lang string, hash long, word string, n long").groupBy("lang", "hash", "word").agg(F.sum("n").alias("f"))


def _sequences(corpus: DataFrame, frequent, seed: int, slice_bytes: int) -> DataFrame:
    """(lang, words): each text as hashes of its frequent words, with a 0 for each gap (a cut, or other words) and at its end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for langs, data, starts, ends, rows, piece in _pieces(batch, slice_bytes):
                hashes = word_hashes(data, starts, ends, seed)
                keep = np.flatnonzero(frequent.value.has(phrase_keys(lang_keys(langs)[rows], [hashes])))
                hashes, own, place = hashes[keep], rows[keep], keep + piece[keep]  # within a piece places have no gap; a cut makes one
                gap = np.append((np.diff(place) > 1) | (np.diff(own) > 0), True) if len(keep) else np.zeros(0, dtype=bool)
                at = np.arange(len(keep)) + np.cumsum(gap) - gap
                out = np.zeros(len(keep) + int(gap.sum()), dtype=np.uint64)
                out[at] = hashes
                sizes = np.bincount(own, minlength=len(langs)) + np.bincount(own[gap], minlength=len(langs))
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(langs, type=pa.string()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(out.view(np.int64)))], names=["lang", "words"])

    return corpus.mapInArrow(run, "lang string, words array<long>").filter("size(words) > 0")


def _runs(batch: pa.RecordBatch, most_words: int) -> Iterator[tuple[list[str], np.ndarray, np.ndarray]]:
    """Of runs of rows of sequences: their languages, the language of each place as its row, and the words."""
    lists = batch.column(1)
    ends = np.cumsum(lists.value_lengths().to_numpy())
    first = 0
    while first < batch.num_rows:
        last = max(int(np.searchsorted(ends, (ends[first - 1] if first else 0) + most_words, side="right")), first + 1)
        part = lists.slice(first, last - first)
        rows = np.repeat(np.arange(last - first), part.value_lengths().to_numpy())
        yield batch.column(0).slice(first, last - first).to_pylist(), rows, part.flatten().to_numpy().view(np.uint64)
        first = last


def _whole(words: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Those of the places at which `size` words stand without a gap."""
    at = at[at + size <= len(words)]
    for i in range(size):
        at = at[words[at + i] != 0]
    return at


def _phrases(langs: list[str], rows: np.ndarray, words: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[pa.Array]]:
    """The different phrases of `size` words at the places: grouped(), and columns lang and phrase."""
    names, code = np.unique(np.array(langs, dtype=object), return_inverse=True)
    own, columns = code[rows[at]], [words[at + i] for i in range(size)]
    first, group, counts = grouped(phrase_keys(own.astype(np.uint64), columns), [own.astype(np.uint64), *columns])
    flat = np.stack([c[first] for c in columns], axis=1).reshape(-1).view(np.int64)
    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, size, dtype=np.int32)), pa.array(flat))
    return first, group, counts, [pa.array(names[own[first]].tolist(), type=pa.string()), lists]


def _grown(sequences: DataFrame, size: int, heads, prefixes, tails, most_words: int) -> DataFrame:
    """(lang, phrase, f): the phrases of `size` words that begin with an open prefix and end with a word of `tails`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for langs, rows, words in _runs(batch, most_words):
                key = lang_keys(langs)[rows]
                single = phrase_keys(key, [words])
                is_tail = tails.value.has(single)
                at = _whole(words, np.flatnonzero(heads.value.has(single) & (words != 0)), size)
                at = at[is_tail[at + size - 1]]
                if prefixes is not None:
                    at = at[prefixes.value.has(phrase_keys(key[at], [words[at + i] for i in range(size - 1)]))]
                if len(at):
                    _, _, counts, columns = _phrases(langs, rows, words, at, size)
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(counts)], names=["lang", "phrase", "n"])

    return sequences.mapInArrow(run, "lang string, phrase array<long>, n long").groupBy("lang", "phrase").agg(F.sum("n").alias("f"))


def _settled(sequences: DataFrame, wanted, longest: int, most_words: int) -> DataFrame:
    """(lang, phrase, f, within): how often the wanted phrases occur, and whether always beside the same word of the same piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for langs, rows, words in _runs(batch, most_words):
                key = lang_keys(langs)[rows]
                before = np.concatenate([np.zeros(1, dtype=np.uint64), words])  # the word before each place
                for size in range(2, longest + 1):
                    at = _whole(words, np.arange(len(words)), size)
                    at = at[wanted.value.has(phrase_keys(key[at], [words[at + i] for i in range(size)]))]
                    if not len(at):
                        continue
                    _, group, counts, columns = _phrases(langs, rows, words, at, size)
                    for side in (before[at], words[at + size]):
                        inside = side != 0
                        value, of = side[inside].view(np.int64), group[inside]
                        low, high = np.full(len(counts), MOST), np.full(len(counts), LEAST)
                        np.minimum.at(low, of, value)
                        np.maximum.at(high, of, value)
                        columns += [pa.array(np.bincount(of, minlength=len(counts))), pa.array(low), pa.array(high)]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(counts)], names=["lang", "phrase", *NEIGHBOURS, "n"])

    rows = sequences.mapInArrow(run, f"lang string, phrase array<long>, {', '.join(f'{c} long' for c in NEIGHBOURS)}, n long")
    sums = rows.groupBy("lang", "phrase").agg(F.sum("n").alias("f"), *(getattr(F, c[2:] if c[2:] != "n" else "sum")(c).alias(c) for c in NEIGHBOURS))
    same = lambda s: (F.col(f"{s}_n") == F.col("f")) & (F.col(f"{s}_min") == F.col(f"{s}_max"))
    return sums.select("lang", "phrase", "f", (same("l") | same("r")).alias("within"))


NEIGHBOURS = ("l_n", "l_min", "l_max", "r_n", "r_min", "r_max")


def _exact(name: str) -> Column:
    return F.col(name).cast("decimal(38,0)")


def _scored(phrases: DataFrame, known: DataFrame, totals: DataFrame) -> DataFrame:
    """phrases (lang, phrase, a) with n, score, l and r of the lowest-scoring cut.

    known is (lang, phrase, f) and has all prefixes; for a rest that it lacks the phrase's own count is taken, which gives a bound of the score.
    """
    cuts = phrases.select("lang", "phrase", "a", F.explode(F.sequence(F.lit(1), F.size("phrase") - 1)).alias("k"))
    cuts = cuts.withColumns({"head": F.slice("phrase", 1, F.col("k")), "rest": F.slice("phrase", F.col("k") + 1, F.size("phrase") - F.col("k"))})
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l")), ["lang", "head"])
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"], "left").join(totals, "lang")
    each = cuts.select("lang", "phrase", "a", "k", "n", "l", F.coalesce("r", "a").alias("r"))
    score = F.expr("(1000 * cast(a as decimal(38,0)) * cast(n as decimal(38,0))) div (cast(l as decimal(38,0)) * cast(r as decimal(38,0)))")
    best = each.withColumn("score", score).groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    return best.select("lang", "phrase", "a", "n", "cut.score", "cut.l", "cut.r")


def collocations(docs: DataFrame, *, least: int = 100, top: int = 2000, longest: int = 5, waves: tuple[float, ...] = (0.05, 0.25, 1.0), bits: int | None = None, slice_bytes: int = 1 << 20, most_words: int = 1 << 19) -> DataFrame:
    """The first `top` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    Texts are read twice: to count words, and to write them as hashes of their frequent words, which is all that later passes
    read. `waves` are the shares of all frequent words' occurrences that the frontier has covered after each wave; the
    last one takes what is still open. The results of passes stand in the shared folder until the next ones don't need them.

    A null text is empty, a null lang `und`; repeated rows count again; other columns play no part; ties are settled by count, then
    by the phrase's bytes; languages without such phrases, and empty tables, give no rows.
    """
    spark = docs.sparkSession
    folder, kept = workspace(spark), [0]

    def keep(df: DataFrame) -> DataFrame:
        kept[0] += 1
        df.write.parquet(f"{folder}/{kept[0]}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{kept[0]}")

    corpus = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    for seed in range(1, 9):
        counts = keep(_counted(corpus, seed, slice_bytes))
        # with another seed, if two words of a language have one hash, or one has that of a gap
        if not counts.groupBy("lang", "hash").agg(F.count("*").alias("words")).filter("words > 1 or hash = 0").limit(1).count():
            break
    totals = keep(counts.groupBy("lang").agg(F.sum("f").alias("n")))
    frequent = counts.filter(F.col("f") >= least).join(totals, "lang")
    # frequent words by the bounds of their subtrees, in steps of a fourth of an octave; the share of occurrences up to each step
    frequent = frequent.withColumn("step", F.floor(4 * F.log2("f")))
    sizes = frequent.groupBy("lang", "step").agg(F.sum("f").alias("s"))
    so_far = F.sum("s").over(Window.partitionBy("lang").orderBy("step")) / F.sum("s").over(Window.partitionBy("lang"))
    first = F.min("step").over(Window.partitionBy("lang")) == F.col("step")
    wave = F.lit(len(waves) - 1)
    for i, share in reversed(list(enumerate(waves[:-1]))):
        wave = F.when(so_far <= share, i).otherwise(wave)
    steps = sizes.select("lang", "step", F.when(first, 0).otherwise(wave).alias("wave"))
    bound = F.expr("(1000 * cast(n as decimal(38,0))) div cast(f as decimal(38,0))")
    words = keep(frequent.join(steps, ["lang", "step"]).select("lang", F.array("hash").alias("phrase"), "f", "word", bound.alias("bound"), "wave"))
    every = bit_map(words, bits)
    sequences = keep(_sequences(corpus, every, seed, slice_bytes))
    singles = words.select("lang", "phrase", "f")
    survivors, closed = None, None  # closed: (lang, least_score), which a phrase has to reach

    sent = []  # maps that no pass needs once what it gave is written

    def mapped(phrases: DataFrame):
        sent.append(bit_map(phrases, bits))
        return sent[-1]

    def above(df: DataFrame, score: str) -> DataFrame:
        return df if closed is None else df.join(closed, "lang", "left").filter(f"least_score is null or {score} >= least_score").drop("least_score")

    for nth in range(len(waves)):
        roots = above(words.filter(F.col("wave") == nth), "bound").select("lang", "phrase")
        if not roots.limit(1).count():
            continue
        heads, prefixes, grown = mapped(roots), None, []
        last = every if closed is None else mapped(above(words, "bound"))  # a rest is cut off as a first word is
        parents = roots
        for size in range(2, longest + 1):
            found = _grown(sequences, size, heads, prefixes, last if size == longest else every, most_words).filter(F.col("f") >= least)
            own = parents.select("lang", F.col("phrase").alias("head"))
            found = found.withColumn("head", F.slice("phrase", 1, size - 1)).join(own, ["lang", "head"], "left_semi").select("lang", "phrase", "f")
            parents = keep(found)
            if not parents.limit(1).count():
                break
            grown.append(parents)
            prefixes = mapped(parents) if size < longest else None
        if not grown:
            while sent:
                sent.pop().destroy()
            continue
        phrases = grown[0]
        for more in grown[1:]:
            phrases = phrases.unionByName(more)
        known = singles.unionByName(phrases)
        # best first again: of the wave's phrases those with the highest bounds are settled, which closes most of the others
        bounds = keep(above(_scored(phrases.withColumnRenamed("f", "a"), known, totals), "score").select("lang", "phrase", "a", F.col("score").alias("bound")))
        nth_bound = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("bound")))
        firsts = bounds.select("lang", "bound", nth_bound.alias("nth")).filter(F.col("nth") <= 2 * top)
        cut = keep(firsts.groupBy("lang").agg(F.min("bound").alias("cut")))
        for part in (F.col("bound") >= F.col("cut"), F.col("bound") < F.col("cut")):
            candidates = above(bounds.join(cut, "lang").filter(part), "bound").select("lang", "phrase", "a")
            if not candidates.limit(1).count():
                continue
            rests = candidates.filter("size(phrase) > 2").select("lang", F.explode(F.transform(F.sequence(F.lit(2), F.size("phrase") - 1), lambda k: F.slice("phrase", k, F.size("phrase") - k + 1))).alias("phrase"))
            wanted = mapped(candidates.select("lang", "phrase").unionByName(rests))
            settled = keep(_settled(sequences, wanted, longest, most_words).filter(F.col("f") >= least))
            counts = settled.select("lang", "phrase", "f").unionByName(known).distinct()
            free = settled.filter((F.size("phrase") == longest) | ~F.col("within")).select("lang", "phrase")
            alive = above(_scored(candidates, counts, totals), "score").join(free, ["lang", "phrase"], "left_semi")
            survivors = keep(alive if survivors is None else above(survivors, "score").unionByName(alive))
            nth_score = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score")))
            firsts = survivors.select("lang", "score", nth_score.alias("nth")).filter(F.col("nth") <= top)
            closed = keep(firsts.groupBy("lang").agg(F.count("*").alias("n_"), F.min("score").alias("least_score")).filter(F.col("n_") == top).drop("n_"))
        while sent:
            sent.pop().destroy()
    every.destroy()
    if survivors is None:
        discard(spark, folder)
        return spark.createDataFrame([], "lang string, rank long, phrase string, a long, l long, r long, n long, score long")
    spelled = above(survivors, "score").select("*", F.posexplode("phrase").alias("at", "hash"))
    spelled = spelled.join(words.select("lang", F.col("phrase")[0].alias("hash"), "word"), ["lang", "hash"]).groupBy("lang", "phrase", "a", "l", "r", "n", "score")
    spelled = spelled.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda w: w["word"]), " ").alias("text"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "text"))
    result = spelled.withColumn("rank", place).filter(F.col("rank") <= top).select("lang", F.col("rank").cast("long").alias("rank"), F.col("text").alias("phrase"), "a", "l", "r", "n", "score")
    out = workspace(spark)
    result.write.parquet(out)  # `top` rows a language; the rest can go
    result = spark.read.schema(result.schema).parquet(out)
    discard(spark, folder)
    return result


def op11_collocations(spark, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))
