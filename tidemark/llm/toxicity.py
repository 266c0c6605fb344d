"""Toxicity: a linear-chain conditional random field over words."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import arrays
from tidemark.llm.graph import Names, columns

HELD_OUT = 2
FOLDS = 4
#: A document is toxic from this score on.
THRESHOLD = 0.3
PREFIXES, SUFFIXES = (4, 5, 6, 7, 8), (4,)
SLOT_BITS = 22
_SALTS = arrays.mix(np.arange(7_001, 7_001 + 1 + len(PREFIXES) + len(SUFFIXES), dtype=np.uint64))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == HELD_OUT, F.lit(False))


@dataclass
class Words:
    """The words of a slice of texts: where they stand, where each text's words begin, their features' hashes."""

    starts: np.ndarray
    ends: np.ndarray
    cuts: np.ndarray
    features: np.ndarray


def words_of(offsets: np.ndarray, data: np.ndarray) -> Words:
    data = arrays.LOWER[data]
    starts, ends = arrays.runs(arrays.IS_WORD[data], offsets)
    hashes = arrays.RollingHash(data)
    features = np.zeros((1 + len(PREFIXES) + len(SUFFIXES), len(starts)), dtype=np.uint64)
    features[0] = hashes.of(starts, ends) ^ _SALTS[0]
    sizes = ends - starts
    for row, k in enumerate((*PREFIXES, *(-x for x in SUFFIXES)), start=1):
        long = np.flatnonzero(sizes > abs(k))
        a, b = (starts[long], starts[long] + k) if k > 0 else (ends[long] + k, ends[long])
        features[row, long] = hashes.of(a, b) ^ _SALTS[row]
    return Words(starts, ends, arrays.owners(offsets, starts), features)


def words_in_slices(texts: list[str]) -> Words:
    """The words of texts of any total size, hashed slice by slice; only cuts and features are kept."""
    parts = [words_of(offsets, data) for _, _, offsets, data in arrays.slices(pa.array(texts, type=pa.string()), 1 << 19)]
    before = np.cumsum([0, *(p.cuts[-1] for p in parts)])
    cuts = np.concatenate([p.cuts[:-1] + b for p, b in zip(parts, before[:-1], strict=True)] + [before[-1:]])
    none = np.zeros(0, dtype=np.int64)
    return Words(none, none, cuts, np.concatenate([p.features for p in parts], axis=1))


def scan(a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> np.ndarray:
    """x[t] = (a[t] x[t-1] + b[t]) / (c[t] x[t-1] + d[t]) from x = 1, for non-negative numbers.

    The recurrences of a two-state chain in the ratio of its states. Runs of the chain advance side by
    side: first each run's whole map is composed, then the runs' first values follow, then all values.
    """
    n = len(a)
    length = max(1, int(np.sqrt(n)))
    count = -(-n // length)
    pad = count * length - n
    shaped = [np.ascontiguousarray(np.concatenate([x, np.full(pad, fill)]).reshape(count, length).T) for x, fill in ((a, 1.0), (b, 0.0), (c, 0.0), (d, 1.0))]
    p, q, r, s = np.ones(count), np.zeros(count), np.zeros(count), np.ones(count)
    for ta, tb, tc, td in zip(*shaped, strict=True):
        p, q, r, s = ta * p + tb * r, ta * q + tb * s, tc * p + td * r, tc * q + td * s
        total = p + q + r + s
        p, q, r, s = p / total, q / total, r / total, s / total
    first, x = np.empty(count), 1.0
    for k, (kp, kq, kr, ks) in enumerate(zip(p.tolist(), q.tolist(), r.tolist(), s.tolist(), strict=True)):
        first[k] = x
        x = (kp * x + kq) / (kr * x + ks)
    out = np.empty((length, count))
    value = first
    for t, (ta, tb, tc, td) in enumerate(zip(*shaped, strict=True)):
        value = (ta * value + tb) / (tc * value + td)
        out[t] = value
    return out.T.ravel()[:n]


def forward_backward(emission: np.ndarray, cuts: np.ndarray, start: float, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(marginal of state 1 of each word, ratio alpha1/alpha0, ratio beta1/beta0); moves[i, j] are potentials' logarithms."""
    n = len(emission)
    if not n:
        return emission, emission, emission
    e, m = np.exp(np.clip(emission, -30, 30)), np.exp(moves)
    first = np.zeros(n, dtype=bool)
    first[cuts[:-1][np.diff(cuts) > 0]] = True
    last = np.append(first[1:], True)
    one, zero = np.ones(n), np.zeros(n)
    alpha = scan(np.where(first, zero, m[1, 1] * e), np.where(first, np.exp(start) * e, m[0, 1] * e), np.where(first, zero, m[1, 0]), np.where(first, one, m[0, 0]))
    after = np.append(e[1:], 1.0)
    beta = scan(*(np.where(last, end, x)[::-1] for end, x in ((zero, m[1, 1] * after), (one, one * m[1, 0]), (zero, m[0, 1] * after), (one, one * m[0, 0]))))[::-1]
    odds = np.minimum(alpha * beta, 1e12)
    return odds / (1 + odds), alpha, beta


@dataclass
class Model:
    keys: np.ndarray
    weights: np.ndarray
    bias: float
    start: float
    moves: np.ndarray
    document: np.ndarray  # of (1, strongest word's log-odds, logs of the expected toxic words, of those but the strongest, of all words)

    @cached_property
    def slots(self) -> np.ndarray:
        slots = np.zeros(1 << SLOT_BITS, dtype=np.int32)
        by = np.argsort(np.abs(self.weights), kind="stable")  # of features that share a slot the weightier one stays
        slots[self.keys[by] >> np.uint64(64 - SLOT_BITS)] = by
        slots[0] = 0
        return slots

    def ids(self, features: np.ndarray) -> np.ndarray:
        found = self.slots[features >> np.uint64(64 - SLOT_BITS)]
        return np.where(self.keys[found] == features, found, 0)

    def marginals(self, words: Words) -> np.ndarray:
        emission = np.full(words.features.shape[1], self.bias)
        for row in words.features:
            emission += self.weights[self.ids(row)]
        return forward_backward(emission, words.cuts, self.start, self.moves)[0]

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ self.document, -30, 30)))


def document_features(p: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    counts = np.diff(cuts)
    most, total = np.zeros(len(counts)), np.zeros(len(counts))
    full = np.flatnonzero(counts)
    if len(full):
        most[full] = np.maximum.reduceat(p, cuts[full])
        total[full] = np.add.reduceat(p, cuts[full])
    most = np.clip(most, 1e-6, 1 - 1e-6)
    rest = np.maximum(total - most, 0.0)
    return np.stack([np.ones(len(counts)), np.log(most / (1 - most)), np.log(total + 1e-3), np.log(rest + 1e-3), np.log1p(counts)], axis=1)


def training_sample(docs: DataFrame, labels: DataFrame, *, per_class: int, most_chars: int) -> tuple[DataFrame, float]:
    """(text, toxic) to fit, at most per_class toxic and twice as many clean ones with at most most_chars code points each, and the share of toxic labels.

    Of the labelled rows whose texts fit those with the least hashes of their ids are taken, so the sample doesn't change with the
    partitioning, and longer texts don't make it smaller.
    """
    usable = labels.filter(~held_out(F.col("doc_id"))).filter("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {row["toxic"]: row["count"] for row in usable.groupBy("toxic").count().collect()}
    share = (counts.get(1, 0) + 0.5) / (sum(counts.values()) + 1.0)
    fitting = docs.filter(F.length("text") <= most_chars).select("doc_id").join(usable, "doc_id").distinct()
    some = None
    for label in (0, 1):
        part = fitting.filter(F.col("toxic") == label).orderBy(F.xxhash64("doc_id", F.lit(17)), "doc_id").limit(per_class * (2 - label))
        some = part if some is None else some.unionByName(part)
    rows = docs.select("doc_id", "text").filter(F.length("text") <= most_chars).join(F.broadcast(some), "doc_id").select("text", "toxic").distinct()
    return rows, share


def _one_of_each_family(words: Words) -> np.ndarray:
    """Which texts stay if of those with the same least hash of three words one stays: near copies would make their own words evidence."""
    h = words.features[0]
    n = len(words.cuts) - 1
    if len(h) < 3:
        return np.ones(n, dtype=bool)
    three = arrays.mix(h[:-2] + arrays.mix(h[1:-1]) + arrays.mix(arrays.mix(h[2:])))
    least = [three[a : max(b - 2, a + 1)].min() if b - a >= 3 else arrays.mix(np.array([i], dtype=np.uint64))[0] for i, (a, b) in enumerate(zip(words.cuts[:-1], words.cuts[1:], strict=True))]
    keep = np.zeros(n, dtype=bool)
    keep[np.unique(np.array(least), return_index=True)[1]] = True
    return keep


def fit(texts: list[str], toxic: np.ndarray, share: float, *, steps: int = 40, evidence: float = 3.5, most_features: int = 20_000, penalty: float = 1e-3) -> Model:
    """The field that fits the words' labels, and a logistic score of documents over its marginals.

    The documents' labels give the words': a word of a toxic document is labelled toxic if one of its features (the
    word, its first 4 to 8 and last 4 bytes) has log-odds of at least `evidence` between toxic and other documents,
    where the part of a word counts only if no clean document of the sample has it.
    """
    zero = Model(np.zeros(1, dtype=np.uint64), np.zeros(1), -5.0, 0.0, np.zeros((2, 2)), np.array([np.log(share / (1 - share)), 0.0, 0.0, 0.0, 0.0]))
    if not (toxic == 1).any() or not (toxic == 0).any():
        return zero
    words = words_in_slices(texts)
    keep = _one_of_each_family(words)
    counts = np.diff(words.cuts)
    words.features = words.features[:, np.repeat(keep, counts)]
    words.cuts = np.concatenate([[0], np.cumsum(counts[keep])])
    toxic = toxic[keep]
    owner = np.repeat(np.arange(len(toxic)), np.diff(words.cuts))
    # in how many documents of each label a feature occurs
    keys, docs_with = [], []
    for row in words.features:
        used = np.flatnonzero(row)
        order = np.lexsort((owner[used], row[used]))
        f, o = row[used][order], owner[used][order]
        if not len(f):
            continue
        new = np.concatenate([[True], (f[1:] != f[:-1]) | (o[1:] != o[:-1])])
        f, o = f[new], o[new]
        key, at = np.unique(f, return_inverse=True)
        with_ = np.stack([np.bincount(at, weights=toxic[o] == label, minlength=len(key)) for label in (0, 1)])
        some = with_.sum(axis=0) >= 3
        keys.append(key[some])
        docs_with.append(with_[:, some])
    if not keys:
        return zero
    affix = np.concatenate([np.full(len(k), i > 0) for i, k in enumerate(keys)])
    key, with_ = np.concatenate(keys), np.concatenate(docs_with, axis=1)
    totals = np.bincount(toxic, minlength=2)
    odds = np.log((with_[1] + 0.5) / (totals[1] + 1)) - np.log((with_[0] + 0.5) / (totals[0] + 1))
    top = np.argsort(-np.abs(odds) * np.sqrt(with_.sum(axis=0)), kind="stable")[:most_features]
    telling = np.where(affix & (with_[0] > 0), 0.0, odds)  # an affix that clean documents have is a feature, but no evidence
    key, odds = np.concatenate([np.zeros(1, dtype=np.uint64), key[top]]), np.concatenate([[0.0], telling[top]])
    model = Model(key, np.zeros(len(key)), -3.0, -3.0, np.zeros((2, 2)), zero.document)
    ids = [model.ids(row).astype(np.int32) for row in words.features]
    y = np.zeros(len(owner), dtype=bool)
    for row in ids:
        y |= odds[row] >= evidence
    y &= toxic[owner] == 1
    # gradient ascent on the field's likelihood, with steps of their own for each parameter
    first = np.zeros(len(y), dtype=bool)
    first[words.cuts[:-1][np.diff(words.cuts) > 0]] = True
    inner = np.flatnonzero(~first)
    parameters = np.concatenate([model.weights, [model.bias, model.start], model.moves.ravel()])
    moment, spread = np.zeros_like(parameters), np.zeros_like(parameters)
    size = len(key)
    for step in range(1, steps + 1):
        weights, bias, start, moves = parameters[:size], parameters[size], parameters[size + 1], parameters[size + 2 :].reshape(2, 2)
        emission = np.full(len(y), bias)
        for row in ids:
            emission += weights[row]
        p, alpha, beta = forward_backward(emission, words.cuts, start, moves)
        gap = y - p
        gradient = np.zeros_like(parameters)
        gradient[:size] = sum(np.bincount(row, weights=gap, minlength=size) for row in ids) - penalty * len(y) ** 0.5 * weights
        gradient[0] = 0.0
        gradient[size], gradient[size + 1] = gap.sum(), gap[first].sum()
        a, e = np.exp(moves), np.exp(np.clip(emission[inner], -30, 30))
        before, after = alpha[inner - 1], e * beta[inner]
        pairs = np.stack([a[0, 0] * np.ones(len(inner)), a[0, 1] * after, before * a[1, 0], before * a[1, 1] * after])
        pairs /= pairs.sum(axis=0)
        seen = np.bincount(2 * y[inner - 1].astype(np.int64) + y[inner], minlength=4)
        gradient[size + 2 :] = seen - pairs.sum(axis=1) - parameters[size + 2 :]
        moment = 0.8 * moment + 0.2 * gradient
        spread = 0.95 * spread + 0.05 * gradient**2
        parameters = parameters + 0.3 * (moment / (1 - 0.8**step)) / (np.sqrt(spread / (1 - 0.95**step)) + 1e-6)
    model = Model(key, parameters[:size], parameters[size], parameters[size + 1], parameters[size + 2 :].reshape(2, 2), zero.document)
    # documents: logistic regression by Newton's method, then the labels' true share
    x = document_features(model.marginals(words), words.cuts)
    w = np.zeros(x.shape[1])
    for _ in range(25):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (q * (1 - q))[:, None]).T @ x + 0.5 * np.eye(len(w))
        w += np.linalg.solve(hessian, x.T @ (toxic - q) - 0.5 * w)
    w[0] += np.log(share / (1 - share)) - np.log(totals[1] / totals[0])
    model.document = w
    return model


def train(docs: DataFrame, labels: DataFrame, *, per_class: int = 1000, most_chars: int = 6000, **options) -> Model:
    """A model of labels.toxic, fitted in one task on a bounded sample of the rows that aren't held out.

    per_class bounds the toxic documents (there are up to twice as many clean ones), most_chars the size of one, so
    the sample has 18 million characters at most. Longer documents are only left out of the sample; all are scored
    whole. The driver gets the weights alone.
    """
    sample, share = training_sample(docs, labels, per_class=per_class, most_chars=most_chars)
    kinds = {"keys": np.uint64, "weights": np.float64, "moves": np.float64, "document": np.float64}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((y, t) for b in batches for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
        model = fit([t for _, t in rows], np.array([y for y, _ in rows], dtype=np.int64), share, **options)
        columns = [pa.array([np.ascontiguousarray(getattr(model, k)).astype(v).tobytes()], type=pa.binary()) for k, v in kinds.items()]
        yield pa.RecordBatch.from_arrays([*columns, pa.array([float(model.bias)]), pa.array([float(model.start)])], names=[*kinds, "bias", "start"])

    fitted = sample.repartition(1).mapInArrow(run, "keys binary, weights binary, moves binary, document binary, bias double, start double").first()
    if fitted is None:  # no partition at all
        return fit([], np.zeros(0, dtype=np.int64), share)
    parts = {k: np.frombuffer(bytes(fitted[k]), dtype=v) for k, v in kinds.items()}
    return Model(parts["keys"], parts["weights"], fitted["bias"], fitted["start"], parts["moves"].reshape(2, 2), parts["document"])


RESULT = "score double, spans array<struct<start: long, end: long, probability: double>>"
ARROW_RESULT = pa.struct([("score", pa.float64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("probability", pa.float64())])))])


def score_slice(offsets: np.ndarray, data: np.ndarray, model: Model) -> list[dict]:
    words = words_of(offsets, data)
    p = model.marginals(words)
    scores = model.scores(document_features(p, words.cuts))
    out = [{"score": s, "spans": []} for s in scores.tolist()]
    toxic = p >= 0.5
    if toxic.any():
        points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        first, last = arrays.runs(toxic, words.cuts)
        rows = np.searchsorted(words.cuts, first, side="right") - 1
        for r, a, b in zip(rows.tolist(), first.tolist(), last.tolist(), strict=True):
            base = points[offsets[r]]
            out[r]["spans"].append({"start": int(points[words.starts[a]] - base), "end": int(points[words.ends[b - 1]] - base), "probability": float(p[a:b].max())})
    return out


def score(docs: DataFrame, model: Model, out: str = "toxicity") -> DataFrame:
    """docs with `out`: score (0 to 1) and the toxic spans (code points, end exclusive) of every whole text.

    Null and empty texts have no words: their score follows from the labels' share. Repeated rows are
    alike; a table without labels of both kinds gives every text the labels' share; tied words of a span give its
    probability alike; an empty table gives no rows. One pass without a shuffle, in slices of about a megabyte. Other columns pass through (one named `out` is replaced).
    """
    known = docs.sparkSession.sparkContext.broadcast((model.keys, model.weights, model.bias, model.start, model.moves, model.document))
    names = [c for c in docs.columns if c.lower() != out.lower()]
    schema = T.StructType([*(docs.schema[c] for c in names), T.StructField(out, T.StructType.fromDDL(RESULT))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*known.value)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text"))
            results = [r for _, _, offsets, data in arrays.slices(texts, 1 << 20) for r in score_slice(offsets, data, model)]
            columns = [batch.column(batch.schema.get_field_index(c)) for c in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(results, type=ARROW_RESULT)], names=[*names, out])

    return docs.select(*(F.col(f"`{c}`") for c in names)).mapInArrow(run, schema)


def remove_toxic(docs: DataFrame, labels: DataFrame, *, threshold: float = THRESHOLD, **options) -> DataFrame:
    """The rows of docs with a score below the threshold (odd rows as in score); all where the labels fit no model, as their share alone tells nothing of a text."""
    model = train(docs, labels, **options)
    if not model.document[1:].any():
        return docs
    found = Names(docs)("found")
    return score(docs, model, found).filter(F.col(f"{found}.score") < threshold).select(*columns(docs.columns))


def op5_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    s = F.col("toxicity.score")
    return score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), s.alias("score"), (s >= THRESHOLD).cast("int").alias("predicted"), F.col("toxicity.spans").alias("spans"))
