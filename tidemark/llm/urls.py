"""URL filters: host and path rules, and redirect equivalence that carries blocks to aliases."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.graph import Names, columns, connected_components

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: (host, path, verdict)
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
#: More rules than this are joined as a table and not written into one expression.
MOST_RULES = 200


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty for null or without ://."""
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def path(url: Column) -> Column:
    """What follows the host up to ? # or the end."""
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def page_key(url: Column) -> Column:
    """What names the resource: host, path and query, without scheme and fragment."""
    return F.concat(host(url), F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^#]*)", 1), F.lit("")))


def _fits(host_: Column, path_: Column, rule_host: Column, rule_path: Column) -> Column:
    return ((host_ == rule_host) | host_.endswith(F.concat(F.lit("."), rule_host))) & path_.startswith(rule_path)


def with_rules(rows: DataFrame, rules: Sequence[tuple[str, str, str]] | DataFrame, out: str = "rule_", host_: str = "host_", path_: str = "path_") -> DataFrame:
    """rows with a column `out`: the longest fitting rule as struct(rule, verdict), or null.

    Up to MOST_RULES given rules are one expression. Others, and a DataFrame (host, path, verdict), are joined
    on the suffixes of the distinct (host, path) pairs, so that a host with many pages counts once.
    Of fitting rules of equal length the one with the longer host goes first, then allow before block, in either form.
    """
    if not isinstance(rules, DataFrame) and len(rules) <= MOST_RULES:
        found = F.lit(None).cast("struct<rule:string,verdict:string>")
        for h, p, verdict in sorted(rules, key=lambda r: (len(r[0] + r[1]), len(r[0]), r[2] == "allow")):
            rule = F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
            found = F.when(_fits(F.col(host_), F.col(path_), F.lit(h), F.lit(p)), rule).otherwise(found)
        return rows.withColumn(out, found)
    table = rules if isinstance(rules, DataFrame) else rows.sparkSession.createDataFrame(list(rules), "host string, path string, verdict string")
    table = table.select(F.col("host").alias("rule_host_"), F.col("path").alias("rule_path_"), F.col("verdict").alias("rule_verdict_"))
    pairs = rows.select(host_, path_).distinct()
    labels = F.split(F.col(host_), r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    found = (
        pairs.withColumn("rule_host_", F.explode(suffixes))
        .join(table, "rule_host_")
        .filter(F.col(path_).startswith(F.col("rule_path_")))
        .withColumn("name_", F.concat("rule_host_", "rule_path_"))
        .groupBy(host_, path_)
        .agg(F.max_by(F.struct(F.col("name_").alias("rule"), F.col("rule_verdict_").alias("verdict")), F.struct(F.length("name_"), F.length("rule_host_"), F.col("rule_verdict_") == "allow")).alias(out))
    )
    return rows.join(found, [host_, path_], "left")


def aliases(pages: DataFrame) -> DataFrame:
    """Links (a, b) between page keys: canonical links and refreshes that the pages' html declares."""
    tags = F.filter(
        F.regexp_extract_all("html", F.lit(r"(?i)<(?:link|meta)\b[^>]*>"), F.lit(0)),
        lambda t: t.rlike(r"(?i)\brel\s*=\s*[\"']?canonical\b") | t.rlike(r"(?i)\bhttp-equiv\s*=\s*[\"']?refresh\b"),
    )
    target = F.trim(F.replace(F.regexp_extract("tag_", r"(?i)(?:\bhref\s*=\s*|\burl\s*=\s*)[\"']?([^\"'\s>]+)", 1), F.lit("&amp;"), F.lit("&")))
    base = F.regexp_extract("url", r"^(.*?://[^/?#]*)", 1)
    folder = F.regexp_extract(path(F.col("url")), r"^(.*/)", 1)
    full = (
        F.when(F.instr("target_", "://") > 0, F.col("target_"))
        .when(F.col("target_").startswith("//"), F.concat(F.lit("http:"), "target_"))
        .when(F.col("target_").startswith("/"), F.concat(base, "target_"))
        .otherwise(F.concat(base, F.when(folder == "", "/").otherwise(folder), "target_"))
    )
    return (
        pages.filter(F.col("html").rlike(r"(?i)canonical|http-equiv") & (F.instr("url", "://") > 0))
        .select("url", F.explode(tags).alias("tag_"))
        .select("url", F.explode(F.array(target)).alias("target_"))  # a generator: each step's text is made once
        .filter("target_ <> ''")
        .select("url", F.explode(F.array(full)).alias("full_"))
        .select(page_key(F.col("url")).alias("a"), page_key(F.col("full_")).alias("b"))
        .filter("a <> b and b <> ''")
        .distinct()
    )


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]] | DataFrame = RULES, edges: DataFrame | None = None) -> DataFrame:
    """pages with host, path, rule and verdict (allow or block) in a struct `decision`.

    A page's own longest rule decides. A page without one belongs to the connected component of its
    aliases (edges a, b of page keys; by default those that the html declares): if any alias is
    explicitly allowed the page is allowed, else if any is blocked it is blocked, else it is allowed.

    Null urls and such without :// have an empty host and path, match no rule and are allowed; null html
    declares no alias; repeated rows are judged alike; ties go as in with_rules; an empty table gives no rows; other columns pass
    through, whatever their names (one named `decision` is replaced). A component is kept as rows of (key, root), never gathered.
    """
    edges = aliases(pages) if edges is None else edges
    roots = connected_components(edges)
    nodes = roots.withColumns({"host_": F.regexp_extract("node", r"^[^/?#]*", 0), "path_": F.regexp_extract("node", r"^[^/?#]*([^?#]*)", 1)})
    judged = with_rules(nodes, rules)
    by_root = judged.groupBy("root").agg(F.bool_or(F.coalesce(F.col("rule_.verdict") == "allow", F.lit(False))).alias("allowed_"), F.bool_or(F.coalesce(F.col("rule_.verdict") == "block", F.lit(False))).alias("blocked_"))
    pages = pages.drop("decision")
    free = Names(pages)
    rule, host_, path_, key, carried = (free(n) for n in ("rule", "host", "path", "key", "carried"))
    blocked = judged.join(by_root, "root").filter("blocked_ and not allowed_").select(F.col("node").alias(key), F.lit(True).alias(carried)).distinct()
    rows = with_rules(pages.withColumns({host_: host(F.col("url")), path_: path(F.col("url"))}), rules, rule, host_, path_)
    decided = lambda verdict: [*columns(pages.columns), F.struct(F.col(host_).alias("host"), F.col(path_).alias("path"), F.col(f"{rule}.rule").alias("rule"), verdict.alias("verdict")).alias("decision")]
    own = rows.filter(F.col(rule).isNotNull()).select(*decided(F.col(f"{rule}.verdict")))
    rest = rows.filter(F.col(rule).isNull()).withColumn(key, page_key(F.col("url"))).join(blocked, key, "left")
    return own.unionByName(rest.select(*decided(F.when(F.col(carried), "block").otherwise("allow"))))


def op2_urls(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    decided = filter_urls(pages.select("page_id", "url", "html"))
    return decided.select("page_id", "decision.host", "decision.path", "decision.rule", "decision.verdict")
