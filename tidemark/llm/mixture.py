"""Mixing sources to target weights by temperature."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.graph import Names, columns, shared_folder, small

SECTIONS = 16
#: Blocks of one source that are ranked by one task.
PER_BUCKET = 1 << 16


def tokens(text: str = "text"):
    """How many runs of other than white space a text has."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\S++")), F.lit(0)).cast("long")


def measures(sources: DataFrame, exponents: list[float], scale: float | None) -> list[tuple[float, float]]:
    """For each exponent (entropy of the weights in nats, most repeats of a source).

    Repeats are counted for a budget of `scale` times the corpus; without one, for the budget that takes every source once at least.
    """
    cells = []
    for k, a in enumerate(exponents):
        power = F.pow("relative", F.lit(a))
        cells += [F.sum(power).alias(f"z{k}"), F.coalesce(F.sum(F.when(power > 0, power * F.log(power))), F.lit(0.0)).alias(f"s{k}"), F.max(power / F.col("share")).alias(f"m{k}"), F.min(power / F.col("share")).alias(f"l{k}")]
    row = sources.agg(*cells).first()
    ratio = lambda k: row[f"m{k}"] / row[f"l{k}"] if row[f"l{k}"] else math.inf
    repeats = lambda k: ratio(k) if scale is None else scale * row[f"m{k}"] / row[f"z{k}"]
    return [(math.log(row[f"z{k}"]) - row[f"s{k}"] / row[f"z{k}"], repeats(k)) for k in range(len(exponents))]


def exponent_for(sources: DataFrame, *, entropy: float | None, max_repeats: float | None, scale: float | None = None, steps: int = 6, tolerance: float = 1e-6) -> float:
    """The least exponent that keeps to the repetition limit, or the one that meets the target entropy.

    Both fall as the exponent grows (at 0 the weights are equal, at 1 they are the shares), so the interval is cut
    around the first exponent that fits; each step measures all its cuts in one aggregate over the sources. A target that
    no exponent meets, or that goes over the repetition limit, is an error.
    """
    fits = lambda m: (m[1] <= max_repeats * (1 + tolerance)) if entropy is None else (m[0] <= entropy + tolerance)
    low, high = 0.0, 1.0
    lowest, highest = measures(sources, [low, high], scale)
    if entropy is None and max_repeats is None:
        return 1.0
    if entropy is not None and lowest[0] < entropy - tolerance:
        raise ValueError(f"the entropy of {sources.count()} sources is {lowest[0]:.6g} at most, {entropy:.6g} can't be met")
    if fits(lowest):
        return low
    while not fits(highest):
        if entropy is None:
            raise ValueError(f"a budget of {scale:.6g} times the corpus repeats sources {highest[1]:.6g} times at least, the limit is {max_repeats:.6g}")
        if high > 1e4:
            raise ValueError(f"weights of these sources have an entropy of {highest[0]:.6g} at least, {entropy:.6g} can't be met")
        low, high = high, 2 * high
        highest = measures(sources, [high], scale)[0]
    for _ in range(steps):
        cuts = [low + (high - low) * k / SECTIONS for k in range(1, SECTIONS)]
        first = next((k for k, m in enumerate(measures(sources, cuts, scale)) if fits(m)), len(cuts))
        low, high = (cuts[first - 1] if first else low), (cuts[first] if first < len(cuts) else high)
    repeats = measures(sources, [high], scale)[0][1]
    if entropy is not None and max_repeats is not None and repeats > max_repeats * (1 + tolerance):
        raise ValueError(f"an entropy of {entropy:.6g} repeats a source {repeats:.6g} times, the limit is {max_repeats:.6g}")
    return high


def _before(rows: DataFrame, by: list[str], order: str, blocks: str, value: Column, out: str) -> DataFrame:
    """rows with `out`: the sum of `value` over the rows of the same `by` that come before in the order of a 64-bit hash.

    The order is cut into buckets of about PER_BUCKET rows; sums run within a bucket, and over the buckets' totals.
    """
    bucket = F.floor((F.col(order) / F.lit(2.0**64) + 0.5) * F.ceil(F.col(blocks) / F.lit(PER_BUCKET))).cast("long")
    rows = rows.withColumn("bucket_", bucket).withColumn("value_", value)
    earlier = Window.partitionBy(*by).orderBy("bucket_").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(*by, "bucket_").agg(F.sum("value_").alias("total_")).select(*by, "bucket_", F.coalesce(F.sum("total_").over(earlier), F.lit(0)).alias("base_"))
    within = Window.partitionBy(*by, "bucket_").orderBy(order, "block_").rowsBetween(Window.unboundedPreceding, -1)
    return rows.join(totals, [*by, "bucket_"]).withColumn(out, F.col("base_") + F.coalesce(F.sum("value_").over(within), F.lit(0))).drop("bucket_", "value_", "base_")


def mix(docs: DataFrame, *, max_repeats: float | None = 4.0, entropy: float | None = None, budget: int | None = None, block_tokens: int = 250_000, seed: int = 1, out: str = "mixture") -> DataFrame:
    """docs with `out`: n_tokens, weight (of the source), budget (tokens of the source), repeats, block, ranks.

    Weights are the sources' token shares to a power, which is found for the repetition limit, or for a
    target entropy if one is given. Without a budget the mix is as large as it must be for every document
    to come once at least. No source is repeated more than max_repeats times on average: a budget or a target for which no
    exponent keeps that is an error (None lifts the limit). A source's budget is filled by epochs: each takes the source's blocks
    in a new random order (ranks[e] is the block's place in epoch e), the last until the budget is full; the block at which it fills
    up is taken by documents in the order of their hashes, as long as they fit.

    Documents are dealt to blocks of about block_tokens by hashes, so a hot source is many blocks; ranks and running sums are taken
    in buckets of blocks, and over the documents of one block of each source. Texts are counted twice: for the plan, and as the rows go
    through. Null text has no tokens; a null source is one source; sources without tokens are taken once; equal shares have equal
    weights; repeated rows share their block and fate; an empty table gives no rows; other columns pass through, whatever their
    names (one named `out` is replaced).
    """
    shared_folder(docs.sparkSession)
    docs = docs.drop(out)
    free = Names(docs)
    src, count, block_, plan, per = (free(n) for n in ("src", "tokens", "block", "plan", "blocks"))
    named = F.struct(F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("name"))
    light = docs.select(named.alias("src_"), "doc_id", tokens().alias("tokens_")).checkpoint()
    counted = light.groupBy("src_").agg(F.sum("tokens_").alias("tokens_")).filter("tokens_ > 0").checkpoint()
    known, whole, most = counted.agg(F.count("*"), F.coalesce(F.sum("tokens_"), F.lit(0)), F.coalesce(F.max("tokens_"), F.lit(1))).first()
    # shares relative to the largest, which keeps powers within numbers
    sources = counted.withColumns({"share": F.col("tokens_") / F.lit(float(max(whole, 1))), "relative": F.col("tokens_") / F.lit(float(most))})
    scale = None if budget is None else budget / max(whole, 1)
    exponent = exponent_for(sources, entropy=entropy, max_repeats=max_repeats, scale=scale) if known else 1.0
    power = F.pow("relative", F.lit(exponent))
    z, least = sources.agg(F.sum(power), F.max(F.col("share") / power)).first() if known else (1.0, 1.0)
    size = budget if budget is not None else whole * least * z
    planned = sources.select(
        "src_",
        F.col("tokens_").alias("source_tokens_"),
        (power / z).alias("weight_"),
        # a hair over, so that a source which is to be taken whole isn't short of its last document by rounding
        F.floor(F.lit(float(size)) * power / z + F.lit(1e-6) * F.col("tokens_") / F.lit(float(max(whole, 1))) + 1e-3).alias("budget_"),
        F.ceil(F.col("tokens_") / block_tokens).alias("blocks_"),
    )
    planned = small(planned.withColumns({"full_": F.floor(F.col("budget_") / F.col("source_tokens_")), "rest_": F.col("budget_") % F.col("source_tokens_")}))
    block = lambda n: F.pmod(F.xxhash64(F.lit(seed), "doc_id"), n)
    order = F.xxhash64(F.lit(seed + 1), "doc_id")
    placed = light.join(planned, "src_").withColumn("block_", block(F.col("blocks_")))
    sized = placed.groupBy("src_", "block_").agg(F.sum("tokens_").alias("block_tokens_"), *(F.first(c).alias(c) for c in ("weight_", "budget_", "full_", "rest_", "blocks_")))
    epoch = sized.select("src_", "block_", "blocks_", F.explode(F.sequence(F.lit(0).cast("long"), F.col("full_"))).alias("epoch_")).withColumn("order_", F.xxhash64(F.lit(seed + 2), "epoch_", "block_"))
    ranks = _before(epoch, ["src_", "epoch_"], "order_", "blocks_", F.lit(1), "rank_").groupBy("src_", "block_").agg(F.transform(F.sort_array(F.collect_list(F.struct("epoch_", "rank_"))), lambda x: x["rank_"]).alias("ranks_"))
    last_order = sized.withColumn("order_", F.xxhash64(F.lit(seed + 2), F.col("full_"), "block_"))
    blocks = _before(last_order, ["src_"], "order_", "blocks_", F.col("block_tokens_"), "before_").join(ranks, ["src_", "block_"]).withColumn("upto_", F.col("before_") + F.col("block_tokens_")).checkpoint()
    edge = small(blocks.filter("before_ < rest_ and upto_ > rest_").select("src_", "block_", (F.col("rest_") - F.col("before_")).alias("room_")))
    # the documents of the block that is taken in part: how far their hashes' order fits
    last = placed.select("src_", "block_", "doc_id", "tokens_").join(edge, ["src_", "block_"])
    by_hash = Window.partitionBy("src_").orderBy(order).rangeBetween(Window.unboundedPreceding, 0)
    cut = last.withColumn("order_", order).withColumn("sum_", F.sum("tokens_").over(by_hash)).filter("sum_ <= room_").groupBy("src_", "block_").agg(F.max("order_").alias("cut_"))
    fate = F.struct("weight_", "budget_", "full_", "rest_", "upto_", "before_", "ranks_", "cut_")
    plans = small(blocks.join(small(cut), ["src_", "block_"], "left").select(F.col("src_").alias(src), F.col("block_").alias(block_), fate.alias(plan)))
    rows = docs.withColumns({src: named, count: tokens()})
    rows = rows.join(small(planned.select(F.col("src_").alias(src), F.col("blocks_").alias(per))), src, "left").withColumn(block_, block(F.col(per))).join(plans, [src, block_], "left")
    of = lambda c: F.col(f"{plan}.{c}_")
    taken = (of("upto") <= of("rest")) | ((of("before") < of("rest")) & (order <= of("cut")))
    times = of("full") + F.coalesce(taken, F.lit(False)).cast("long")
    mixture = F.struct(
        F.col(count).alias("n_tokens"),
        F.coalesce(of("weight"), F.lit(0.0)).alias("weight"),
        F.coalesce(of("budget"), F.lit(0)).cast("long").alias("budget"),
        F.coalesce(times, F.lit(1)).cast("long").alias("repeats"),
        F.coalesce(F.col(block_), F.lit(0)).cast("long").alias("block"),
        F.coalesce(F.slice(of("ranks"), 1, times.cast("int")), F.array(F.lit(0).cast("long"))).alias("ranks"),
    )
    return rows.select(*columns(docs.columns), mixture.alias(out))


def op6_mixture(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    m = F.col("mixture")
    return mix(docs).select("doc_id", "source", *(m[c].alias(c) for c in ("n_tokens", "weight", "budget", "repeats", "block", "ranks")))
