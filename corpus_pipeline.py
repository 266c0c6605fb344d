"""The corpus pipeline: toxicity, near duplicates, decontamination, personal data, mixture.

run() gives the documents that every stage keeps, with their sanitised texts and their place in the mixture.
Odd rows have the same result in every stage as in its operator: null and empty texts have no words, are not toxic beyond the
labels' share, form one group of copies, hold no benchmark window and no personal data, and stand once in the
mixture; ties go to the least doc_id; of repeated rows one stays; rows without a doc_id are grouped by their texts like others, and
of unlike texts under one doc_id each stays; a null source is a source; empty tables give no rows; other columns pass through,
whatever their names.

No stage can be stated in SQL (a fitted field, SimHash groups, corpus statistics, hashed permutations), so there is no
ORACLE_SQL; tests/llm holds run() against a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.decontaminate import remove_contaminated
from tidemark.llm.mixture import mix
from tidemark.llm.pii import sanitise
from tidemark.llm.simhash import keep_one
from tidemark.llm.toxicity import remove_toxic
from tidemark.sources.files import discard, workspace


def toxicity(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the field scores as toxic go."""
    return remove_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of exact and near copies (shingles of five words, similarity of 0.8) stays."""
    return keep_one(docs, words=5, similarity=0.8)


def decontamination(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten words in a row of a benchmark item go."""
    return remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data, and terms that reveal them, are generalised in the texts."""
    return sanitise(docs)


def mixture(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with how often and where it comes in the mix of sources (a name that docs has gets `mixture_` before it)."""
    taken = {c.lower() for c in docs.columns}
    mixed = mix(docs, max_repeats=4.0, out="mixed_")
    added = (F.col(f"mixed_.{c}").alias(f"mixture_{c}" if c in taken else c) for c in mixed.schema["mixed_"].dataType.names)
    return mixed.select(*(F.col(f"`{c}`") for c in docs.columns), *added)


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("mixture", mixture),
]
ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    """The stages, one after the other; what each keeps is written to the shared folder and read again, and goes once the next stage is written."""
    folder = workspace(spark)
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            discard(spark, before)
        before = f"{folder}/{name}"
    return STAGES[-1][1](spark, docs, sf_dir)
