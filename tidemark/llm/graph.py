"""Connected components of a graph held in a DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.sources.files import shared_folder

#: A table with more rows than this is joined by a shuffle and not broadcast.
MOST_BROADCAST = 500_000


def small(df: DataFrame, most: int = MOST_BROADCAST) -> DataFrame:
    """df, checkpointed, marked for a broadcast if a count shows that it has at most `most` rows."""
    shared_folder(df.sparkSession)
    df = df.checkpoint()
    return F.broadcast(df) if df.count() <= most else df


class Names:
    """Column names that no column of `df` has, whatever the case: names("x") is x_, or x__ where that is taken, and so on."""

    def __init__(self, *frames: DataFrame):
        self.taken = {c.lower() for df in frames for c in df.columns}
        self.given: dict[str, str] = {}

    def __call__(self, base: str) -> str:
        if base not in self.given:
            name = base + "_"
            while name.lower() in self.taken:
                name += "_"
            self.given[base] = name
            self.taken.add(name.lower())
        return self.given[base]


def columns(names: list[str], of: str | None = None) -> list[Column]:
    """Columns by their whole names, which may hold dots or quotes."""
    return [F.col((f"{of}." if of else "") + f"`{c.replace('`', '``')}`") for c in names]


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of `edges` (columns a, b, of any type that has an order): root is the smallest node reachable.

    Alternates the large-star and small-star steps: each node's neighbours are linked to the least
    node of its neighbourhood, first the larger neighbours, then the others. Every step is an aggregate
    of minima and a join back on the node; a hub's rows are combined before they are shuffled and
    its join partition can be split. Nothing but the edge count and a sum come to the driver.
    Loops, repeated edges and nulls add nothing; an empty graph gives no rows.
    """
    spark = edges.sparkSession
    shared_folder(spark)
    edges = edges.select("a", "b").filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct().checkpoint()
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        edges = small.filter("a <> b").distinct().checkpoint()
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before or now[0] == 0:
            break
        before = now
    roots = edges.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root")
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
