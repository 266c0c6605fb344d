"""Personal data: patterns, and terms that the corpus shows to reveal them."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.graph import Names, columns, shared_folder, small

KINDS = ("email", "ip", "card", "phone")
TERM = len(KINDS)
#: In the statistics of terms: personal data of any kind.
ANY = len(KINDS)

#: Possessive where nothing after it could want characters back, so that no text makes them backtrack or recurse.
#: A match may start inside a run of its first class only where the match before it ended.
PATTERNS = (
    r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    r"[0-9](?:[\x20-]?[0-9])++",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)
SPAN = "struct<start:int,kind:int,end:int>"
NONE = f"cast(array() as array<{SPAN}>)"


def _sql_text(s: str) -> str:
    return "r'" + s.replace("'", r"\x27") + "'"


def _luhn(digits: str) -> str:
    each = f"cast(substring({digits}, length({digits}) - i + 1, 1) as int)"
    return f"aggregate(sequence(1, length({digits})), 0, (s, i) -> s + if(i % 2 = 1, {each}, 2 * {each} - if({each} > 4, 9, 0))) % 10 = 0"


def _valid(kind: int) -> str:
    """Over x.h, a match."""
    digits = "regexp_replace(x.h, '[^0-9]', '')"
    if kind == 1:
        return r"forall(transform(split(x.h, r'\.'), p -> ltrim('0', p)), p -> p = '' or (length(p) <= 3 and try_cast(p as int) <= 255))"
    if kind == 2:
        return f"length({digits}) between 14 and 19 and {_luhn(digits)}"
    if kind == 3:
        return f"length({digits}) between 10 and 15"
    return "true"


def find(text: str, p: str, kind: int, valid: str = "true") -> str:
    """SQL: the spans of the matches of a pattern (SQL, too) in a text, in code points. Their places are the sums of
    the lengths of the matches and of what lies between them."""
    return f"""aggregate(
      zip_with(split({text}, {p}, -1), concat(regexp_extract_all({text}, {p}, 0), array('')), (g, h) -> named_struct('g', g, 'h', h)),
      named_struct('at', 0, 'out', {NONE}),
      (a, x) -> named_struct('at', a.at + length(x.g) + length(x.h), 'out', if(x.h <> '' and {valid},
        concat(a.out, array(named_struct('start', a.at + length(x.g), 'kind', {kind}, 'end', a.at + length(x.g) + length(x.h)))), a.out)),
      a -> a.out)"""


def base_spans(text: str) -> Column:
    """array<struct<start, kind, end>> of the base kinds, by start and kind."""
    digits = f"{text} rlike '[0-9]'"
    worth = (f"instr({text}, '@') > 0", rf"{text} rlike r'[0-9]\.[0-9]'", f"{text} rlike r'[0-9][ -]?[0-9]'", f"instr({text}, '+') > 0 and {digits}")
    parts = [f"if({w}, {find(text, _sql_text(PATTERNS[k]), k, _valid(k))}, {NONE})" for k, w in enumerate(worth)]
    return F.expr(f"array_sort(concat({', '.join(parts)}))")


def _replaced(text: str, spans: str, by: str) -> Column:
    """The text with `by` (SQL over s, a span) in place of each span, or run of overlapping spans."""
    merged = f"""aggregate({spans}, {NONE}, (a, s) -> if(size(a) > 0 and s.start < element_at(a, -1).end,
        concat(slice(a, 1, size(a) - 1), array(named_struct('start', element_at(a, -1).start, 'kind', element_at(a, -1).kind, 'end', greatest(element_at(a, -1).end, s.end)))),
        concat(a, array(s))))"""
    cut = f"""aggregate({merged}, named_struct('at', 0, 'out', cast(array() as array<string>)),
        (a, s) -> named_struct('at', s.end, 'out', concat(a.out, array(substring({text}, a.at + 1, s.start - a.at), {by}))),
        a -> concat(array_join(a.out, ''), substring({text}, a.at + 1, length({text}))))"""
    return F.expr(f"if(size({spans}) > 0, {cut}, {text})")


# --- terms ---------------------------------------------------------------------------------------

#: A word of the corpus statistics: three letters or digits or more.
WORD = r"[\p{L}\p{N}]{3,}+"


def terms_of(text: str) -> str:
    """SQL: the different terms of a text. A word of letters is a term, in lower case; others are known by their shape: 9:16 is
    sixteen digits, a9:40 forty letters and digits. So a secret that stands once in the corpus still has a term that can tell."""
    distinct = f"array_distinct({words_of(text)})"
    return f"if({text} rlike r'\\p{{N}}', array_distinct(transform({distinct}, w -> {_shaped('w')})), {distinct})"


def words_of(text: str) -> str:
    return f"regexp_extract_all(lower({text}), {_sql_text(WORD)}, 0)"


def _shaped(w: str) -> str:
    return rf"if({w} rlike r'\p{{N}}', concat(if({w} rlike r'\p{{L}}', 'a9:', '9:'), length({w})), {w})"


def _term_pattern(terms: str) -> str:
    """SQL: the pattern that matches any of some terms as whole words."""
    shape = r"""if(instr(t, ':') = 0, t, concat(if(t like 'a%', r'(?=\p{N}*+\p{L})(?=\p{L}*+\p{N})[\p{L}\p{N}]', r'\p{N}'), '{', substring_index(t, ':', -1), '}'))"""
    return rf"concat(r'(?iu)(?<![\p{{L}}\p{{N}}])(?:', array_join(transform({terms}, t -> {shape}), '|'), r')(?![\p{{L}}\p{{N}}])')"


def wilson(share: Column, n: Column, z: float) -> Column:
    """The lower bound of a share that was seen in n cases, z standard errors down."""
    return (share + z * z / (2 * n) - z * F.sqrt(share * (1 - share) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def _marked(docs: DataFrame, free: Names) -> DataFrame:
    """docs with the base spans, the text without them (blanks in their place) and a number for each row; computed once and kept in the shared folder."""
    shared_folder(docs.sparkSession)
    whole, spans, rest, row = (free(n) for n in ("whole", "spans", "rest", "row"))
    rows = docs.withColumn(whole, F.coalesce("text", F.lit(""))).withColumn(spans, base_spans(whole))
    return rows.withColumn(rest, _replaced(whole, spans, "repeat(' ', s.end - s.start)")).withColumn(row, F.monotonically_increasing_id()).checkpoint()


def _terms(marked: DataFrame, free: Names, threshold: float, z: float) -> DataFrame:
    spans, rest = free("spans"), free("rest")
    flags = [F.expr(f"exists({spans}, s -> s.kind = {k})") for k in range(len(KINDS))]
    size = marked.agg(F.count("*").alias("n"), *(F.count_if(f).alias(f"n{k}") for k, f in enumerate(flags)), F.count_if(F.size(spans) > 0).alias(f"n{ANY}")).first()
    shares = {k: size[f"n{k}"] / size["n"] for k in range(ANY + 1) if 0 < size[f"n{k}"] < size["n"]}
    if not shares:
        return marked.sparkSession.createDataFrame([], "kind int, term string, documents long, together long, contexts long, strength double")
    # what a share has to be at least for the threshold, and how many documents can show it
    least = {k: p ** (1 - threshold) for k, p in shares.items()}
    shown = {k: math.ceil(z * z * tau / (1 - tau)) for k, tau in least.items()}
    beside = marked.filter(F.size(spans) > 0).select(F.expr(words_of(rest)).alias("w"), *(f.alias(f"k{k}") for k, f in enumerate(flags)), F.lit(True).alias(f"k{ANY}"))
    per_doc = beside.select(F.explode(F.expr(f"array_distinct(transform(w, x -> {_shaped('x')}))")).alias("term"), *(f"k{k}" for k in shares))
    together = per_doc.groupBy("term").agg(*(F.count_if(f"k{k}").alias(f"c{k}") for k in shares))
    some = F.lit(False)
    for k, n in shown.items():
        some = some | (F.col(f"c{k}") >= n)
    together = small(together.filter(some))
    documents = marked.select(F.explode(F.expr(terms_of(rest))).alias("term")).join(together.select("term"), "term", "left_semi").groupBy("term").agg(F.count("*").alias("documents"))
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(f"c{k}").alias("together"), F.lit(p).alias("share"), F.lit(least[k]).alias("least"), F.lit(shown[k]).alias("shown")) for k, p in shares.items()))).alias("e")
    measured = documents.join(together, "term").select("term", "documents", each).select("term", "documents", "e.*").withColumn("rate", F.col("together") / F.col("documents"))
    measured = small(measured.filter("rate >= least and together >= shown"))
    # different surroundings, so that copies of a document are no more evidence than one
    around = F.expr(f"transform(w, (x, i) -> named_struct('term', {_shaped('x')}, 'context', xxhash64(get(w, i - 1), x, get(w, i + 1), i = 0)))")
    seen = beside.select(F.explode(around).alias("o"), *(f"k{k}" for k in shares)).select("o.*", *(f"k{k}" for k in shares)).join(small(measured.select("term").distinct()), "term", "left_semi")
    contexts = seen.groupBy("term", "context").agg(*(F.bool_or(f"k{k}").alias(f"k{k}") for k in shares)).groupBy("term").agg(*(F.count_if(f"k{k}").alias(f"x{k}") for k in shares))
    contexts = contexts.select("term", F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(f"x{k}").alias("contexts")) for k in shares))).alias("e")).select("term", "e.*")
    evidence = F.least("together", "contexts") / F.col("rate")
    strength = F.log2(wilson(F.col("rate"), evidence, z) / F.col("share")) / -F.log2("share")
    return measured.join(contexts, ["term", "kind"]).filter("contexts > 0").withColumn("strength", strength).filter(F.col("strength") >= threshold).select("kind", "term", "documents", "together", "contexts", "strength")


def disclosing_terms(docs: DataFrame, *, threshold: float = 0.6, z: float = 4.0) -> DataFrame:
    """(kind, term, documents, together, contexts, strength): terms that reveal personal data of a kind, or of any kind (ANY).

    Over all documents, outside of base spans: in how many a term stands (p(t)), in how many that hold the kind (p(t, e)).
    Knowing the term discloses log2(p(t, e) / (p(t) p(e))) bits of the kind's -log2 p(e). The strength is that share, with the lower
    confidence bound (z standard errors) of p(e | t) in the place of its estimate. For the bound, co-occurrences count by their different
    surroundings (the word itself, and those before and after), so that copies of a document are one piece of evidence. A term
    discloses from `threshold` on. Both limits are the same for a corpus of any size, and there is no other.

    Terms are counted by partial aggregates; only those that can reach the threshold are counted in all documents, and only
    those that do are looked at in their surroundings. The driver gets six counts. Null and empty texts have no terms; a
    table without personal data, or with some in every document, gives none; an empty table gives none.
    """
    free = Names(docs)
    return _terms(_marked(docs.select("text"), free), free, threshold, z)


def find_private(docs: DataFrame, terms: DataFrame | None = None, *, out: str = "private", **options) -> DataFrame:
    """docs with `out`: array<struct<start, kind, end>> of base spans and of disclosing terms, by start and kind.

    kind is a place in KINDS, or TERM for a term; a term that discloses (or that `terms`, column term, gives) is marked wherever it
    stands outside of base spans, in all documents. Rows meet the terms by a join of their distinct terms, and what they hold is
    joined back by a number of the row: neither the terms nor the rows come to the driver. Null and empty texts have no
    spans; very long runs of one character class cost linear time; where spans of one kind could overlap the leftmost counts;
    repeated rows are alike; an empty table gives no rows; other columns pass through, whatever their names (one named
    `out` is replaced).
    """
    docs = docs.drop(out)
    free = Names(docs)
    marked = _marked(docs, free)
    whole, spans, rest, row, held = (free(n) for n in ("whole", "spans", "rest", "row", "held"))
    found = small((_terms(marked, free, **{"threshold": 0.6, "z": 4.0, **options}) if terms is None else terms).select("term").distinct())
    own = marked.select(row, F.explode(F.expr(terms_of(rest))).alias("term")).join(found, "term", "left_semi").groupBy(row).agg(F.array_sort(F.collect_list("term")).alias(held))
    rows = marked.join(small(own), row, "left")
    more = f"if({held} is null, {NONE}, {find(rest, _term_pattern(held), TERM)})"
    return rows.select(*columns(docs.columns), F.expr(f"array_sort(concat({spans}, {more}))").alias(out))


def redact(text: str = "text", spans: str = "private") -> Column:
    """The text in which each span, or run of overlapping spans, is generalised to the kind of its first."""
    names = "array(" + ", ".join(f"'<{k.upper()}>'" for k in (*KINDS, "term")) + ")"
    return _replaced(text, spans, f"{names}[s.kind]")


def sanitise(docs: DataFrame, **options) -> DataFrame:
    """docs whose texts hold no span that find_private finds; n_chars, where there is one, follows. Odd rows as in find_private."""
    spans = Names(docs)("found")
    clean = find_private(docs, out=spans, **options).withColumn("text", redact(spans=spans)).drop(spans)
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return clean.select(*columns(docs.columns))


def op9_pii(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    names = "array(" + ", ".join(f"'{k}'" for k in (*KINDS, "term")) + ")"
    listed = lambda spans: f"array_join(transform({spans}, s -> concat({names}[s.kind], ':', s.start, ':', s.end)), ',')"
    counts = [F.expr(f"size(filter(private, s -> s.kind = {k}))").cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return find_private(docs).select(
        "doc_id",
        *counts,
        F.sha2(F.expr(listed(f"filter(private, s -> s.kind < {TERM})")), 256).alias("base_sha256"),
        F.expr(listed("private")).alias("spans"),
    )
