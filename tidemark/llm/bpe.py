"""Byte-pair encoding and decoding of whole texts, with long ones encoded in parts at once and joined exactly.

A long text is halved until its parts are short; the parts are encoded as rows of their own. Then neighbours are joined, two by two:
a window around the join is encoded anew and grows to both sides until its tokens agree with the tokens of either part.
What stands before the one place of agreement is right in the left part, what stands behind the other in the right
one, and what lies between in the window, so the joined tokens are those of the whole text.

Why agreement suffices: a text is cut into words from left to right, so where a word begins at the same place in two scans, both go on
alike as far as they see the same text; the window's ends and the join are kept a margin away. Within one endless word, tokens
follow from their neighbours alone: a row of tokens is the encoding of its text if each two that follow each other are that of theirs.
So a token that both have, with the same text before and after, joins them. Parts and agreements begin only at code points
that no normalisation joins to those before.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import arrays
from tidemark.llm.graph import Names, columns


@cache
def _loaded(file: str):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(file)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def _in_task(file: str):
    """The tokenizer for a task, which has one core: no threads beside it."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return _loaded(file)


@cache
def _seconds() -> frozenset[str]:
    """Code points that a canonical composition may join to the one before."""
    pairs = (unicodedata.decomposition(chr(c)).split() for c in range(0x110000))
    return frozenset(chr(int(p[1], 16)) for p in pairs if len(p) == 2 and not p[0].startswith("<")) | frozenset(map(chr, [*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)]))


@cache
def opens(char: str) -> bool:
    """Whether no normalisation joins this code point to those before it, or moves it there."""
    first = unicodedata.normalize("NFD", char)[0]
    return unicodedata.combining(first) == 0 and first not in _seconds()


def cut_near(text: str, at: int, step: int) -> int:
    """The first place from `at` on (step 1) or back (step -1) where a part may begin; else the text's end or start."""
    while 0 < at < len(text) and not opens(text[at]):
        at += step
    return min(max(at, 0), len(text))


def cuts(text: str, most: int) -> list[int]:
    """Where the parts of a text begin, and its end: halves of halves, until they have about `most` code points."""
    places = [0, len(text)]
    while max(b - a for a, b in zip(places, places[1:], strict=False)) > most:
        halved = [places[0]]
        for a, b in zip(places, places[1:], strict=False):
            halved += [min(max(cut_near(text, (a + b) // 2, 1), a), b), b]
        if len(set(halved)) == len(set(places)):  # nothing more can be cut
            break
        places = halved
    return places


class Tokens(NamedTuple):
    """The tokens of text[start:end]: ids, where each begins and ends, and whether it begins a word."""

    start: int
    end: int
    ids: np.ndarray
    begins: np.ndarray
    ends: np.ndarray
    first: np.ndarray


def tokens_of(encoding, start: int, end: int) -> Tokens:
    offsets = np.array(encoding.offsets, dtype=np.int64).reshape(-1, 2) + start
    words = np.array([-1 if w is None else w for w in encoding.word_ids], dtype=np.int64)
    first = np.ones(len(words), dtype=bool)
    first[1:] = (words[1:] != words[:-1]) | (words[1:] < 0)
    return Tokens(start, end, np.array(encoding.ids, dtype=np.int64), offsets[:, 0], offsets[:, 1], first)


def _places(t: Tokens) -> tuple[dict[int, int], dict[tuple[int, int, int], int]]:
    """By place: the token that begins a word there; and tokens within a word, that neither begin nor end it, by place and id.

    The values are numbers of the first token behind the place. No token before covers the place itself.
    """
    n = len(t.ids)
    reach = np.maximum.accumulate(t.ends) if n else t.ends
    clean = np.ones(n, dtype=bool)
    clean[1:] = reach[:-1] <= t.begins[1:]
    words = {int(t.begins[i]): i for i in np.flatnonzero(t.first & clean).tolist()}
    inner = np.flatnonzero(~t.first[:-1] & ~t.first[1:] & clean[1:] & (t.ends[:-1] == t.begins[1:])) if n else []
    within = {(int(t.begins[i]), int(t.ends[i]), int(t.ids[i])): int(i) + 1 for i in inner}
    return words, within


def _agreements(text: str, part: Tokens, window: Tokens, low: int, high: int) -> list[tuple[int, int, int]]:
    """(place, token of the part, token of the window) for the places from low to high at which they agree."""
    a, b = max(part.start, window.start), min(part.end, window.end)
    lo, hi = np.searchsorted(part.begins, [a, b])
    near = Tokens(part.start, part.end, *(x[max(lo - 2, 0) : hi + 2] for x in part[2:]))
    shift = max(int(lo) - 2, 0)
    (words, within), (w_words, w_within) = _places(near), _places(window)
    found = [(p, i + shift, w_words[p]) for p, i in words.items() if p in w_words]
    found += [(k[1], i + shift, w_within[k]) for k, i in within.items() if k in w_within]
    return sorted(f for f in found if low <= f[0] <= high and (f[0] == len(text) or opens(text[f[0]])))


def join(tokenizer, text: str, left: Tokens, right: Tokens, margin: int, grow: int = 64) -> Tokens:
    """The tokens of two parts that follow each other, as if their text had been encoded at once."""
    at = left.end
    while True:
        a = max(cut_near(text, at - grow, -1), left.start)
        b = min(cut_near(text, at + grow, 1), right.end)
        window = tokens_of(tokenizer.encode(text[a:b], add_special_tokens=False), a, b)
        before = [(a, 0, 0)] if a == left.start else _agreements(text, left, window, a + 1, at - margin)[-1:]
        after = [(b, len(right.ids), len(window.ids))] if b == right.end else _agreements(text, right, window, at, b - margin)[:1]
        if before and after:
            (_, i, k), (_, j, m) = before[0], after[0]
            return Tokens(left.start, right.end, *(np.concatenate([x[:i], w[k:m], y[j:]]) for x, w, y in zip(left[2:], window[2:], right[2:], strict=True)))
        grow *= 2


def concatenate(tokenizer, text: str, parts: list[Tokens], margin: int) -> np.ndarray:
    """The ids of a text from its parts' tokens: neighbours are joined two by two, until one is left."""
    parts = [p for p in parts if p.end > p.start]
    while len(parts) > 1:
        joined = [join(tokenizer, text, a, b, margin) for a, b in zip(parts[::2], parts[1::2], strict=False)]
        parts = joined + parts[len(parts) - len(parts) % 2 :]
    return parts[0].ids if parts else np.zeros(0, dtype=np.int64)


def margin_of(tokenizer) -> int:
    """No special string and no contraction reaches so far."""
    return 8 + max((len(t.content) for t in tokenizer.get_added_tokens_decoder().values()), default=0)


def encode_long(tokenizer, text: str, most: int) -> list[int]:
    """The same on one machine: parts, their tokens, and the tree of joins."""
    places = cuts(text, most)
    spans = list(zip(places, places[1:], strict=False))
    encoded = tokenizer.encode_batch([text[a:b] for a, b in spans], add_special_tokens=False)
    return concatenate(tokenizer, text, [tokens_of(e, a, b) for e, (a, b) in zip(encoded, spans, strict=True)], margin_of(tokenizer)).tolist()


def vocabulary(path: str | None = None) -> str:
    """The tokenizer's file, as a text that tasks get (a vocabulary has a bounded size)."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as f:
        return f.read()


#: How the public vocabulary's file treats a text before the merges (fixed values of that file).
NORMALIZED = ["NFC", "Replace", "Lowercase"]
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Below this code point nothing is composed, and lower case stays there (but for the dot of U+0130) whatever stands around a letter.
PLAIN = 0x180


def _class(kinds: str) -> str:
    return "".join(re.escape(chr(c)) for c in range(PLAIN) if unicodedata.category(chr(c))[0] in kinds)


class Memory:
    """A tokenizer that encodes each word once, in texts of which it can tell the words: code points below U+0180, no special string.

    Those are lower-cased and cut by the file's own pattern; words are remembered with their ids. Other texts, and all texts of
    another tokenizer, are encoded by the library as they are.
    """

    def __init__(self, file: str, most: int = 1 << 19):
        self.tokenizer, self.most, self.known = _in_task(file), most, {}
        told = json.loads(file)
        steps = [x["type"] for x in (told["normalizer"] or {}).get("normalizers", [])]
        split = ((told["pre_tokenizer"] or {}).get("pretokenizers") or [{}])[0]
        self.plain = steps == NORMALIZED and split.get("pattern") == {"Regex": WORDS} and split["behavior"] == "Removed" and split["invert"]
        if self.plain:
            self.lower = _loaded(json.dumps(told | {"normalizer": None}))
            letters, numbers = _class("L"), _class("N")
            self.words = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^\\x09-\\x0d \\x85\\xa0{letters}{numbers}]+").findall
            special = [re.escape(t.content[:2]) for t in self.tokenizer.get_added_tokens_decoder().values()]
            self.odd = re.compile("|".join([f"[^\\x00-{chr(PLAIN - 1)}]", *special])).search

    def ids(self, texts: list[str]) -> list[list[int]]:
        easy = [self.plain and self.odd(t) is None for t in texts]
        split = [self.words(t.lower()) if e else () for t, e in zip(texts, easy, strict=True)]
        new = list({w for own in split for w in own if w not in self.known})
        self.known.update(zip(new, (e.ids for e in self.lower.encode_batch_fast(new, add_special_tokens=False)), strict=True) if new else ())
        known = self.known
        rest = iter(self.tokenizer.encode_batch_fast([t for t, e in zip(texts, easy, strict=True) if not e], add_special_tokens=False))
        out = [[i for w in own for i in known[w]] if e else next(rest).ids for own, e in zip(split, easy, strict=True)]
        if len(known) > self.most:
            self.known = {}
        return out


@cache
def _memory(file: str) -> Memory:
    return Memory(file)


_IDS = T.ArrayType(T.IntegerType())
#: Tokens at either end of a part whose places are kept: windows seldom reach further, and then grow to the whole part.
EDGE = 256
_PART = "key binary, part int, text string, ids array<int>, edges array<int>"


def edges_of(t: Tokens) -> np.ndarray:
    """Begins, ends and firsts of the tokens at both ends."""
    n = len(t.ids)
    near = np.r_[0:n] if n <= 2 * EDGE else np.r_[0:EDGE, n - EDGE : n]
    return np.concatenate([t.begins[near], t.ends[near], t.first[near]])


def from_edges(start: int, end: int, ids: np.ndarray, edges: np.ndarray) -> Tokens:
    """A part of which the tokens in the middle begin and end nowhere that agrees with anything."""
    begins, ends, first = np.asarray(edges, dtype=np.int64).reshape(3, -1)
    begins, ends, first, n = begins + start, ends + start, first.astype(bool), len(ids)
    if n > 2 * EDGE:
        middle = n - 2 * EDGE
        begins = np.concatenate([begins[:EDGE], np.full(middle, ends[EDGE - 1]), begins[EDGE:]])
        ends = np.concatenate([ends[:EDGE], np.full(middle, begins[-EDGE]), ends[EDGE:]])
        first = np.concatenate([first[:EDGE], np.zeros(middle, dtype=bool), first[EDGE:]])
    return Tokens(start, end, ids, begins, ends, first)


def encode(docs: DataFrame, path: str | None = None, *, out: str = "ids", decoded: str | None = None, longest: int = 1 << 15, most: int = 1 << 14, keep_text: bool = True, slice_bytes: int = 1 << 20) -> DataFrame:
    """docs with their texts' token ids in `out`, as the library's encode gives them, without special tokens around them.

    Texts of up to `longest` code points are encoded where they are read. Longer ones are halved into parts of about `most`,
    each different text once; parts are shuffled by text and place, so one text, and a text with many copies, is work for many
    tasks. One task then joins a text's parts, re-encoding windows only; it holds one text and its ids.
    With `decoded`, also what decode() makes of the ids, by the same tasks.
    A null text is empty; an empty text has no ids; special strings in texts are their tokens, as in the library;
    repeated rows repeat theirs; an empty table has no rows. Other columns pass through, but for those named as the new ones, which are replaced.
    """
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary(path))
    made = [T.StructField(out, _IDS)] + ([T.StructField(decoded, T.StringType())] if decoded else [])
    docs = docs.drop(*(f.name for f in made))
    drop = () if keep_text else ("text",)
    size = F.length(F.coalesce("text", F.lit("")))
    kept = [f for f in docs.schema if f.name not in drop]

    def columns_of(ids: list[list[int]]) -> list[pa.Array]:
        texts = [pa.array(_in_task(sent.value).decode_batch(ids, skip_special_tokens=False), type=pa.string())] if decoded else []
        return [pa.array(ids, type=pa.list_(pa.int32())), *texts]

    def whole_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = arrays.plain(batch.column(batch.schema.get_field_index("text")))
            for a, b, _, _ in arrays.slices(texts, slice_bytes):
                part = batch.slice(a, b - a)
                new = columns_of(_memory(sent.value).ids(texts.slice(a, b - a).to_pylist()))
                yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(f.name)) for f in kept), *new], names=[f.name for f in [*kept, *made]])

    short = docs.filter(size <= longest).mapInArrow(whole_texts, T.StructType([*kept, *made]))
    names = Names(docs)
    key = names("key")
    long = docs.filter(size > longest).withColumn(key, F.unhex(F.sha2("text", 256)))

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, text in zip(batch.column(0), batch.column(1), strict=True):  # a text at a time
                text = text.as_py()
                places = cuts(text, most)
                spans = list(zip(places, places[1:], strict=False))
                yield pa.RecordBatch.from_arrays([pa.array([k.as_py()] * len(spans), type=pa.binary()), pa.array(range(len(spans)), type=pa.int32()), pa.array([text[a:b] for a, b in spans], type=pa.string())], names=["key", "part", "text"])

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _in_task(sent.value)
        for batch in batches:
            for i in range(0, batch.num_rows, 16):
                some = batch.slice(i, 16)
                texts = some.column(2).to_pylist()
                found = [tokens_of(e, 0, len(t)) for e, t in zip(tokenizer.encode_batch(texts, add_special_tokens=False), texts, strict=True)]
                new = [pa.array(x, type=pa.list_(pa.int32())) for x in ([t.ids for t in found], [edges_of(t) for t in found])]
                yield pa.RecordBatch.from_arrays([*some.columns, *new], names=[*some.schema.names, "ids", "edges"])

    def joined(group: pd.DataFrame) -> pd.DataFrame:
        tokenizer = _in_task(sent.value)
        group = group.sort_values("part")
        at, tokens = 0, []
        for row in group.itertuples(index=False):
            tokens.append(from_edges(at, at + len(row.text), np.asarray(row.ids, dtype=np.int64), row.edges))
            at += len(row.text)
        ids = [concatenate(tokenizer, "".join(group["text"]), tokens, margin_of(tokenizer)).tolist()]
        texts = {"text": tokenizer.decode_batch(ids, skip_special_tokens=False)} if decoded else {}
        return pd.DataFrame({"key": [group["key"].iloc[0]], "ids": ids, **texts})

    pieces = long.select(F.col(key).alias("key"), "text").mapInArrow(parts, "key binary, part int, text string")
    pieces = pieces.groupBy("key", "part").agg(F.first("text").alias("text"))  # copies are one
    whole = pieces.mapInArrow(encoded, _PART).groupBy("key").applyInPandas(joined, "key binary, ids array<int>" + (", text string" if decoded else ""))
    found = whole.select(F.col("key").alias(key), F.col("ids").alias(out), *([F.col("text").alias(decoded)] if decoded else []))
    own = [f.name for f in kept]
    return short.unionByName(long.select(*columns(own), F.col(key)).join(found, key).select(*columns([*own, *(f.name for f in made)])))


def decode(encoded: DataFrame, path: str | None = None, *, ids: str = "ids", out: str = "decoded", most: int = 1 << 18) -> DataFrame:
    """encoded with the text that the library's decode gives for `ids`, special tokens included, in `out`. No ids, or null, give an empty text."""
    sent = encoded.sparkSession.sparkContext.broadcast(vocabulary(path))
    encoded = encoded.drop(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index(ids))
            ends, first = np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)), 0
            while first < batch.num_rows:  # about `most` ids at a time
                last = max(int(np.searchsorted(ends, (ends[first - 1] if first else 0) + most, side="right")), first + 1)
                rows = [r or [] for r in lists.slice(first, last - first).to_pylist()]
                texts = pa.array(_in_task(sent.value).decode_batch(rows, skip_special_tokens=False), type=pa.string())
                yield pa.RecordBatch.from_arrays([*batch.slice(first, last - first).columns, texts], names=[*batch.schema.names, out])
                first = last

    return encoded.mapInArrow(run, T.StructType([*encoded.schema, T.StructField(out, T.StringType())]))


def op12_bpe(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    read = encode(docs, decoded="decoded", keep_text=False)
    return read.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
