"""Collocations against counting all phrases; the query itself is held against its SQL too, in test_llm_queries."""

import re
from collections import Counter

import numpy as np
import pytest

from tidemark.llm import collocations as C

UP = {i: i + 32 for i in range(65, 91)}


def plain(rows, least=100, top=2000, longest=5):
    counts, n, out = {}, Counter(), []
    for lang, text in rows:
        lang = "und" if lang is None else lang
        k = counts.setdefault(lang, [Counter() for _ in range(longest + 1)])
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(UP)):
            w = [x for x in re.split(r"[\x20\x09]+", piece) if x]
            n[lang] += len(w)
            for size in range(1, longest + 1):
                k[size].update(zip(*(w[i:] for i in range(size)), strict=False))
    for lang, k in counts.items():
        found = {}
        for size in range(2, longest + 1):
            for q, a in k[size].items():
                if a >= least:
                    score, cut = min(((1000 * a * n[lang]) // (k[j][q[:j]] * k[size - j][q[j:]]), j) for j in range(1, size))
                    found[q] = (score, a, k[cut][q[:cut]], k[size - cut][q[cut:]])
        inside = {q[i:j] for q in found for i in range(len(q)) for j in range(i + 2, len(q) + 1) if j - i < len(q) and 100 * found[q][1] >= 100 * k[j - i][q[i:j]]}
        live = sorted((q for q in found if q not in inside), key=lambda q: (-found[q][0], -found[q][1], " ".join(q).encode()))
        out += [(lang, i + 1, " ".join(q), *found[q][1:], n[lang], found[q][0]) for i, q in enumerate(live[:top])]
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in df.collect())


@pytest.mark.parametrize("options", [dict(least=2, top=10, longest=4, waves=(0.02, 0.1, 0.3, 1.0)), dict(least=3, top=40, bits=64), dict(least=3, top=5, waves=(1.0,))])
def test_any_wave_and_any_bit_map_give_the_same(spark, sf, duck, options):
    """Also with a bit map of 64 bits, in which nearly every phrase is meant by chance."""
    rows = duck.sql("SELECT lang, text FROM documents").fetchall()
    got = C.collocations(spark.read.parquet(f"{sf}/documents.parquet"), slice_bytes=1 << 16, most_words=1 << 12, **options)
    assert rows_of(got) == plain(rows, **{k: v for k, v in options.items() if k in ("least", "top", "longest")})


def test_odd_rows_and_ties(spark):
    texts = [("a b c " * 9 + ".", "x"), ("A b, c\td e\rf  g é", "x"), (None, "x"), ("", None), ("p q p q p q", None), ("p q p q p q", "und"), ("u v! u v? u v; u v: u v", "t"), ("w z! w z? w z; w z: w z", "t"), ("same same same same", "t"), ("Straße Ölé straße Ölé", "t")] * 3
    df = spark.createDataFrame([(t, la, 1) for t, la in texts], "text string, lang string, phrase int")
    for options in (dict(least=2, top=3), dict(least=5, top=1, waves=(0.1, 1.0)), dict(least=1, top=100)):
        assert rows_of(C.collocations(df, **options)) == plain([(la, t) for t, la in texts], options["least"], options["top"])
    assert C.collocations(df.limit(0)).count() == 0 and C.collocations(df, least=1000).count() == 0


def test_products_beyond_64_bits(spark):
    phrases = spark.createDataFrame([("x", [1, 2], 10**13)], "lang string, phrase array<long>, a long")
    known = spark.createDataFrame([("x", [1], 10**13 + 7), ("x", [2], 10**13 + 9)], "lang string, phrase array<long>, f long")
    (r,) = C._scored(phrases, known, spark.createDataFrame([("x", 10**14 + 3)], "lang string, n long")).collect()
    assert r["score"] == 1000 * 10**13 * (10**14 + 3) // ((10**13 + 7) * (10**13 + 9)) and (r["l"], r["r"]) == (10**13 + 7, 10**13 + 9)


def test_phrases_with_one_key_stay_apart():
    first, group, counts = C.grouped(np.zeros(4, dtype=np.uint64), [np.array([1, 2, 1, 3], dtype=np.uint64)])
    assert sorted(counts.tolist()) == [1, 1, 2] and len(first) == 3 and group[0] == group[2] != group[1]


def test_nothing_stays_in_the_folder(spark, sf):
    import os

    from tidemark.sources.files import shared_folder

    root = shared_folder(spark).removeprefix("file:")
    before = set(os.listdir(root))
    C.collocations(spark.read.parquet(f"{sf}/documents.parquet"), least=5, top=3).collect()
    assert len(set(os.listdir(root)) - before) == 1  # the result
