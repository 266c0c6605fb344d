"""Encoding in parts against the library's encoding of whole texts."""

import hashlib
import random

import pytest

from tidemark.llm import bpe

POOL = [
    *("a", "b", "A", "'", "'s", "'re", "!", "?", "  ", "\n", "1", "٣", "é", "é", "́", "̣", "İ", "Σ", "ß", "각", "ᄀ", "ᅡ", "ᆨ"),
    *("<|endoftext|>", "<|startoftext|>", "<|endof", "text|>", "漢", "字", "\U0001f600", "ཱི", "ཱ", "̈́", "the", "ing", "tion", "\xa0", "xxxxxxx"),
]


@pytest.fixture(scope="module")
def library():
    return bpe._loaded(bpe.vocabulary())


def whole(library, text):
    return library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("seed", range(3))
def test_joins_give_the_whole_encoding(library, seed):
    r = random.Random(seed)
    for _ in range(250):
        text = "".join(r.choices(r.sample(POOL, r.choice([1, 2, 3, 5, len(POOL)])), k=r.choice([0, 1, 50, 400])))
        assert bpe.encode_long(library, text, r.choice([16, 40, 150])) == whole(library, text), repr(text)


@pytest.mark.parametrize("text", ["a" * 5000, "́" * 3000, "ab" * 2500, "'s" * 2000, "!" * 3000, "<|endoftext|>" * 300, "漢字" * 1500, " " * 4000, "각" * 900, "7" * 3000])
def test_texts_without_a_place_to_cut(library, text):
    assert bpe.encode_long(library, text, 100) == whole(library, text)


def test_parts_are_halves(library):
    places = bpe.cuts("word " * 4000, 3000)
    assert places[0] == 0 and places[-1] == 20_000 and len(places) == 9 and max(b - a for a, b in zip(places, places[1:], strict=False)) <= 3000


def test_windows_are_short(library, monkeypatch):
    """A join encodes a window, not the text."""
    sizes = []

    class Watched:
        def encode(self, text, **options):
            sizes.append(len(text))
            return library.encode(text, **options)

    text = "some plain words, and more of them. " * 2000
    places = bpe.cuts(text, 5000)
    parts = [bpe.tokens_of(library.encode(text[a:b], add_special_tokens=False), a, b) for a, b in zip(places, places[1:], strict=False)]
    assert bpe.concatenate(Watched(), text, parts, bpe.margin_of(library)).tolist() == whole(library, text)
    assert len(sizes) == len(parts) - 1 and max(sizes) < 400


def test_parts_known_at_their_edges_alone(library, monkeypatch):
    monkeypatch.setattr(bpe, "EDGE", 4)
    r = random.Random(9)
    for _ in range(150):
        text = "".join(r.choices(r.sample(POOL, r.choice([1, 2, 5, len(POOL)])), k=400))
        places = bpe.cuts(text, 100)
        whole_parts = [bpe.tokens_of(library.encode(text[a:b], add_special_tokens=False), a, b) for a, b in zip(places, places[1:], strict=False)]
        parts = [bpe.from_edges(t.start, t.end, t.ids, bpe.edges_of(t._replace(begins=t.begins - t.start, ends=t.ends - t.start))) for t in whole_parts]
        assert bpe.concatenate(library, text, parts, bpe.margin_of(library)).tolist() == whole(library, text), repr(text)


def test_remembered_words(library):
    memory = bpe.Memory(bpe.vocabulary(), most=50)
    other = bpe.Memory(bpe.vocabulary("/opt/tokenizers/byte_bpe_50k.json"))
    assert memory.plain and not other.plain
    assert other.ids(["Some words, 'tis so"]) == [other.tokenizer.encode("Some words, 'tis so", add_special_tokens=False).ids]
    r = random.Random(4)
    plain = [chr(c) for c in range(0x180)]
    for k in range(80):
        pool = [*POOL, " ", "\t", "\x1c", "\u2028", "\x85"] if k % 2 else [*plain, "'", "'", "s", "re", "LL", " "]
        texts = ["".join(r.choices(pool, k=r.choice([0, 3, 60]))) for _ in range(5)] + ["A<|ENDOFTEXT|>b"]
        assert memory.ids(texts) == [whole(library, t) for t in texts]
    every = " ".join(plain) + "".join(plain)
    assert memory.ids([every]) == [whole(library, every)]


def test_odd_rows(spark, library):
    long = "Longer text, 'tis one! " * 300 + "x" * 3000
    rows = [(1, None, "a"), (2, "", "b"), (None, "Plain words", None), (2, "Plain words", "c"), (4, long, "d"), (5, long, "e"), (5, long, "e"), (6, long[:-1] + "́" * 50, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, key string").withColumnsRenamed({"key": "ids_"})
    got = bpe.encode(df, longest=500, most=200)
    assert got.columns == ["doc_id", "text", "ids_", "ids"]
    assert sorted((r["doc_id"] or 0, r["text"] or "", tuple(r["ids"])) for r in got.collect()) == sorted((d or 0, t or "", tuple(whole(library, t or ""))) for d, t, _ in rows)
    assert bpe.encode(df.limit(0)).count() == 0
    read = bpe.decode(got.select("ids", "doc_id")).collect()
    assert all(r["decoded"] == library.decode(r["ids"], skip_special_tokens=False) for r in read) and len(read) == len(rows)


@pytest.mark.parametrize("longest", [None, 700])
def test_query(spark, sf, duck, library, longest):
    """Every row of the query; and of the operator with most texts cut, over the same table."""
    from pyspark.sql import functions as F

    texts = dict(duck.sql("SELECT doc_id, coalesce(text, '') FROM documents").fetchall())
    if longest:
        docs = bpe.encode(spark.read.parquet(f"{sf}/documents.parquet"), longest=longest, most=longest // 2, decoded="decoded")
        df = docs.select("doc_id", F.size("ids").cast("long"), F.sha2(F.array_join("ids", " "), 256), F.sha2("decoded", 256))
    else:
        df = bpe.op12_bpe(spark, sf)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    got = {r[0]: tuple(r)[1:] for r in df.collect()}
    assert len(got) == len(texts)
    for d, text in texts.items():
        ids = whole(library, text)
        assert got[d] == (len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))
