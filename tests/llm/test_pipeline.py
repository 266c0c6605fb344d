"""run() against a brute-force version of the stages that have exact rules, and the stages' frame."""

import re

import corpus_pipeline
from pyspark.sql import functions as F

from tidemark.llm import toxicity


def test_stages_keep_their_columns(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(60).withColumn("extra", F.lit(1))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns, name
        out.count()


def test_run(spark, sf, duck):
    docs = {d: (t, s) for d, t, s in duck.sql("SELECT doc_id, text, source FROM documents").fetchall()}
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, sf).collect()}
    frame = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    scores = {r["doc_id"]: r["toxicity"]["score"] for r in toxicity.score(frame, toxicity.train(frame, labels)).collect()}
    left = {d: t for d, (t, _) in docs.items() if scores[d] < toxicity.THRESHOLD}
    # groups: exact copies and a Jaccard similarity of 0.8 of shingles of five words, safely above or below
    shingles = {}
    for d, t in left.items():
        w = t.encode().lower().split()
        shingles[d] = {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))}
    alike = {d: {} for d in left}
    for d in left:
        for e in left:
            if d < e:
                j = len(shingles[d] & shingles[e]) / len(shingles[d] | shingles[e])
                if j > 0.5:
                    alike[d][e] = alike[e][d] = j
    items = [t for (t,) in duck.sql("SELECT text FROM benchmark").fetchall()]
    up = {i: i + 32 for i in range(65, 91)}
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.translate(up))
    windows = {tuple(w[i : i + 10]) for w in map(words, items) for i in range(len(w) - 9)}
    dirty = {d for d, t in left.items() if any(tuple(w) in windows for w in zip(*(words(t)[k:] for k in range(10)), strict=False))}
    assert set(got) <= set(left) - dirty
    for d in set(left) - dirty - set(got):  # each that went has a likeness that stays, or had one before
        assert alike[d], d
    kept = sorted(got)
    for i, d in enumerate(kept):
        assert all(alike[d].get(e, 0) < 0.95 for e in kept[i + 1 :])
    for d, r in got.items():
        assert not re.search(r"[\w.]+@[\w-]+\.\w+", r["text"]) and r["n_chars"] == len(r["text"]) and r["repeats"] >= 1 and r["source"] == docs[d][1]


def test_odd_rows_go_through_all_stages(spark, sf):
    rows = [(1, None, "en", None, 0), (2, "", "en", "s", 0), (3, "one text of some words here", None, "s", 27), (3, "one text of some words here", None, "s", 27), (None, "no id but words of its own", "en", "t", 26), (9, "long " * 30_000, "en", "t", 150_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("result_x", F.lit(1)).withColumn("mixture", F.lit("own"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf).checkpoint()
        assert "mixture" in docs.columns and "result_x" in docs.columns
    left = {r["doc_id"] for r in docs.collect()}
    assert left == {1, 3, None, 9} and docs.count() == 4
    last = corpus_pipeline.mixture(spark, docs.withColumn("weight", F.lit("own")), sf)
    assert last.count() == 4 and {"mixture", "weight", "mixture_weight", "repeats"} <= set(last.columns)


def test_empty_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
    assert docs.count() == 0
