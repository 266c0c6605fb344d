"""Benchmark decontamination with suffix arrays over shards of the training text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import arrays
from tidemark.llm.graph import Names, columns

RESULT = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_hit", T.LongType()),
        T.StructField("longest", T.LongType()),
        T.StructField("longest_start", T.LongType()),
        T.StructField("items", T.ArrayType(T.StringType())),
        T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
    ]
)

#: Ranks of a suffix array fit in 21 bits.
MOST_TOKENS = 1 << 20


class TestSuffixes:
    """The suffixes of a block of benchmark items, ready to be looked up in any shard."""

    def __init__(self, ids: list[str], texts: list[str], window: int):
        ((_, _, offsets, data),) = arrays.slices(pa.array(texts, type=pa.large_string()), 1 << 60) if texts else ((0, 0, np.zeros(1, dtype=np.int64), np.zeros(0, dtype=np.uint8)),)
        self.ids, self.data = ids, arrays.LOWER[data]
        self.starts, self.ends = arrays.runs(arrays.IS_WORD[self.data], offsets)
        self.tokens = arrays.RollingHash(self.data).of(self.starts, self.ends)
        cuts = arrays.owners(offsets, self.starts)
        lengths = np.diff(cuts)
        self.item = np.repeat(np.arange(len(lengths)), lengths)
        self.place = np.arange(len(self.starts)) - np.repeat(cuts[:-1], lengths)
        self.size = np.minimum(lengths, window)[self.item]  # words of the window that starts here, if it is whole
        self.reach = np.minimum(lengths[self.item] - self.place, self.size)  # words that a match from here on can have, up to a window


def same_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, tests: TestSuffixes, word: np.ndarray, suffix: np.ndarray) -> np.ndarray:
    """Which of the windows that begin at `word` hold the very words of the test suffixes' windows."""
    right = np.ones(len(word), dtype=bool)
    for i in range(int(tests.size[suffix].max(initial=0))):
        k = np.flatnonzero(right & (tests.size[suffix] > i))
        a, b = starts[word[k] + i], tests.starts[suffix[k] + i]
        size = ends[word[k] + i] - a
        right[k] = size == tests.ends[suffix[k] + i] - b
        k, a, b, size = (x[right[k]] for x in (k, a, b, size))
        if len(k):
            step = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            equal = data[np.repeat(a, size) + step] == tests.data[np.repeat(b, size) + step]
            right[k] = np.logical_and.reduceat(equal, np.cumsum(size) - size)
    return right


def suffix_order(ranks: np.ndarray, depth: int) -> np.ndarray:
    """Places in the order of their suffixes' first `depth` tokens or more (ranks below 2^21)."""
    n = len(ranks)
    padded = np.concatenate([ranks, np.zeros(2, dtype=np.int64)])
    key = (padded[:n] << 42) | (padded[1 : n + 1] << 21) | padded[2 : n + 2]
    order = np.argsort(key, kind="stable")
    key, known = key[order], 3
    new = np.concatenate([[True], key[1:] != key[:-1]])
    while known < depth and not new.all():
        group = np.cumsum(new) - 1
        rank = np.zeros(n + known, dtype=np.int64)
        rank[order] = group + 1
        tied = np.flatnonzero(~new | ~np.append(new[1:], True))
        places = order[tied]
        key = (group[tied] << 31) | rank[places + known]
        moved = np.argsort(key, kind="stable")
        order[tied], key = places[moved], key[moved]
        new[tied[1:]] |= key[1:] != key[:-1]
        known *= 2
    return order


def occurrences(tokens: np.ndarray, tests: TestSuffixes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(test suffix, place) for every place where a test suffix's window stands, and for each place how many words from it on,
    up to a window, are those of some test suffix; by binary search.

    The interval of the suffix array that agrees with a test suffix is narrowed token by token; a
    suffix leaves the search when its interval is empty, or when its item or the window ends.
    """
    none = np.zeros(0, dtype=np.int64)
    if not len(tokens) or not len(tests.reach):
        return none, none, np.zeros(len(tokens), dtype=np.int64)
    window = int(tests.reach.max())
    if len(tokens) > MOST_TOKENS:  # one very long text: pieces that overlap by a window
        step = MOST_TOKENS - window + 1
        if step < MOST_TOKENS // 2:
            raise ValueError(f"a window has at most {MOST_TOKENS // 2} words")
        parts = []
        for at in range(0, len(tokens), step):
            suffix, place, deep = occurrences(tokens[at : at + MOST_TOKENS], tests)
            own = place < step
            parts.append((suffix[own], place[own] + at, deep[:step]))
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))
    known, ranks = np.unique(tokens, return_inverse=True)
    ranks = ranks.astype(np.int64)
    order = suffix_order(ranks, window)
    found = np.searchsorted(known, tests.tokens)
    found[found == len(known)] = 0
    wanted = np.where(known[found] == tests.tokens, found, -1)
    ahead = np.concatenate([ranks, np.full(window, -2, dtype=np.int64)])
    first = ranks[order]
    live = np.flatnonzero(wanted >= 0)
    low = np.searchsorted(first, wanted[live], side="left")
    high = np.searchsorted(first, wanted[live], side="right")
    whole = tests.reach == tests.size
    deep = np.zeros(len(tokens), dtype=np.int64)
    done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    depth = 1
    while len(live):
        inside = np.bincount(low, minlength=len(tokens) + 1) - np.bincount(high, minlength=len(tokens) + 1)
        deep[order[np.cumsum(inside)[:-1] > 0]] = depth
        ends = tests.reach[live] == depth
        full = ends & whole[live]
        done.append((live[full], low[full], high[full]))
        live, low, high = live[~ends], low[~ends], high[~ends]
        token = wanted[live + depth]
        low, high = (_bound(ahead, order, depth, token, low, high, right) for right in (False, True))
        keep = (high > low) & (token >= 0)
        live, low, high = live[keep], low[keep], high[keep]
        depth += 1
    if not done:
        return none, none, deep
    suffix, low, high = (np.concatenate(x) for x in zip(*done, strict=True))
    counts = high - low
    within = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    return np.repeat(suffix, counts), order[np.repeat(low, counts) + within], deep


def _bound(ahead, order, depth, token, low, high, right: bool) -> np.ndarray:
    """The first place in [low, high) whose token at `depth` is not below (right: is above) `token`."""
    low, high = low.copy(), high.copy()
    while (open_ := low < high).any():
        middle = (low + high) >> 1
        here = ahead[order[np.minimum(middle, len(order) - 1)] + depth]
        below = open_ & ((here <= token) if right else (here < token))
        low = np.where(below, middle + 1, low)
        high = np.where(open_ & ~below, middle, high)
    return low


def search_shard(offsets: np.ndarray, data: np.ndarray, tests: TestSuffixes) -> list[dict]:
    """A result for each row of a shard of texts."""
    data = arrays.LOWER[data]
    starts, ends = arrays.runs(arrays.IS_WORD[data], offsets)
    cuts = arrays.owners(offsets, starts)
    counts, rows = np.diff(cuts), len(cuts) - 1
    row_of = np.repeat(np.arange(rows), counts)
    # a token that no item has ends each row
    tokens = np.zeros(len(starts) + rows, dtype=np.uint64)
    shifted = np.arange(len(starts)) + row_of
    tokens[shifted] = arrays.RollingHash(data).of(starts, ends)
    suffix, place, deep = occurrences(tokens, tests)
    out = [{"n_words": n, "n_hit": 0, "longest": 0, "longest_start": None, "items": [], "spans": []} for n in counts.tolist()]
    deep = deep[shifted]
    matched = np.flatnonzero(deep)
    by = matched[np.lexsort((matched, -deep[matched], row_of[matched]))]
    for w in by[np.flatnonzero(np.diff(row_of[by], prepend=-1))].tolist():
        out[row_of[w]] |= {"longest": int(deep[w]), "longest_start": int(w - cuts[row_of[w]])}
    if not len(suffix):
        return out
    place_row = np.searchsorted(cuts + np.arange(rows + 1), place, side="right") - 1
    word = place - place_row
    # equal hashes are checked against the words themselves
    right = same_words(data, starts, ends, tests, word, suffix)
    suffix, word, place_row = suffix[right], word[right], place_row[right]
    wide = tests.size[suffix]
    if not len(suffix):
        return out
    cover = np.zeros(len(starts) + 1, dtype=np.int64)
    np.add.at(cover, word, 1)
    np.add.at(cover, word + wide, -1)
    hit = np.cumsum(cover)[:-1] > 0
    # windows in a row on one diagonal of an item are one longer verbatim match
    item = tests.item[suffix]
    by = np.lexsort((word, word - tests.place[suffix], item, place_row))
    a, b = by[1:], by[:-1]
    new = np.concatenate([[True], (place_row[a] != place_row[b]) | (item[a] != item[b]) | (word[a] - word[b] != tests.place[suffix[a]] - tests.place[suffix[b]]) | (word[a] != word[b] + 1)])
    heads = np.flatnonzero(new)
    tails = np.append(heads[1:], len(by)) - 1
    lengths = word[by[tails]] + wide[by[tails]] - word[by[heads]]
    rows_of = place_row[by[heads]]
    first = np.lexsort((word[by[heads]], -lengths, rows_of))
    for k in first[np.flatnonzero(np.diff(rows_of[first], prepend=-1))].tolist():
        if lengths[k] > out[rows_of[k]]["longest"]:
            out[rows_of[k]] |= {"longest": int(lengths[k]), "longest_start": int(word[by[heads[k]]] - cuts[rows_of[k]])}
    pairs = np.unique(place_row * len(tests.ids) + item)
    which, items = pairs // len(tests.ids), pairs % len(tests.ids)
    hit_rows, at = np.unique(which, return_index=True)
    for r, own in zip(hit_rows.tolist(), np.split(items, at[1:]), strict=True):
        mask = hit[cuts[r] : cuts[r + 1]]
        begin, end = arrays.runs(mask, np.array([0, len(mask)]))
        out[r] |= {
            "n_hit": int(mask.sum()),
            "items": sorted({tests.ids[i] for i in own.tolist()}),
            "spans": [{"start": x, "end": y} for x, y in zip(begin.tolist(), end.tolist(), strict=True)],
        }
    return out


def merged(old: dict | None, new: dict) -> dict:
    """The result over the items of two blocks."""
    if old is None:
        return new
    spans: list[dict] = []
    for s in sorted([*old["spans"], *new["spans"]], key=lambda s: (s["start"], s["end"])):
        if spans and s["start"] <= spans[-1]["end"]:
            spans[-1]["end"] = max(spans[-1]["end"], s["end"])
        else:
            spans.append(dict(s))
    longer = max((old, new), key=lambda r: (r["longest"], -(r["longest_start"] or 0)))  # at a tie the first place
    return {
        "n_words": new["n_words"],
        "n_hit": sum(s["end"] - s["start"] for s in spans),
        "longest": longer["longest"],
        "longest_start": longer["longest_start"],
        "items": sorted({*old["items"], *new["items"]}),
        "spans": spans,
    }


def benchmark_blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[tuple[list[str], list[str]]]:
    """The items, read partition by partition, in blocks of at most about block_bytes."""
    ids, texts, size = [], [], 0
    for row in benchmark.select(F.col("item_id").cast("string"), F.coalesce("text", F.lit(""))).toLocalIterator():
        if ids and size + len(row[1]) > block_bytes:
            yield ids, texts
            ids, texts, size = [], [], 0
        ids.append("null" if row[0] is None else row[0])
        texts.append(row[1])
        size += len(row[1])
    yield ids, texts


def scan(docs: DataFrame, benchmark: DataFrame, *, window: int = 10, shard_bytes: int = 2 << 20, block_bytes: int = 16 << 20, keep_text: bool = True, out: str = "contamination") -> DataFrame:
    """docs with a column `out`: n_words, n_hit, the longest verbatim match of any length and where it starts, items, spans of words.

    Every task sorts the suffixes of its texts, shard by shard (about shard_bytes of whole texts), and
    looks every suffix of every benchmark item up in that suffix array by binary search. Rows are not
    shuffled, so a hot source or a group of copies costs no more than other rows. Benchmark items
    are sent to the tasks in blocks of at most block_bytes; of a larger benchmark a task takes one block after the other for each shard and
    merges what they give, so driver and tasks hold one block at a time and the corpus is read once.

    Null or empty texts have no words and no hit; ties of equal length go to the first place in the text;
    repeated rows each get their result; an empty benchmark gives no hits; items without words never
    occur; a null item_id counts as the id "null". Other columns pass through, but for one named
    `out`, which is replaced.
    """
    docs = docs.drop(out)
    kept = [f for f in docs.schema if keep_text or f.name != "text"]
    names = [f.name for f in kept]
    sent = [docs.sparkSession.sparkContext.broadcast(TestSuffixes(*block, window)) for block in benchmark_blocks(benchmark, block_bytes)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text"))
            results = []
            for _, _, offsets, data in arrays.slices(texts, shard_bytes):
                found = None
                for block in sent:
                    new = search_shard(offsets, data, block.value)
                    found = [merged(a, b) for a, b in zip(found or [None] * len(new), new, strict=True)]
                    if len(sent) > 1:
                        vars(block).pop("_value", None)  # read again from the worker's disk when it is due
                results += found
            columns = [batch.column(batch.schema.get_field_index(n)) for n in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(results, type=ARROW_RESULT)], names=[*names, out])

    return docs.mapInArrow(run, T.StructType([*kept, T.StructField(out, RESULT)]))


ARROW_RESULT = pa.struct(
    [
        ("n_words", pa.int64()),
        ("n_hit", pa.int64()),
        ("longest", pa.int64()),
        ("longest_start", pa.int64()),
        ("items", pa.list_(pa.string())),
        ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
    ]
)


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of docs in which no benchmark window occurs, with the columns of docs. Odd rows as in scan: without words, a row stays."""
    found = Names(docs)("found")
    return scan(docs, benchmark, out=found, **options).filter(f"{found}.n_hit = 0").select(*columns(docs.columns))


def op1_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = scan(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep_text=False)
    c = F.col("contamination")
    return found.select(
        "doc_id",
        c["n_words"].alias("n_words"),
        c["n_hit"].alias("n_hit"),
        F.size(c["items"]).cast("long").alias("n_items"),
        F.sha2(F.array_join(c["items"], ","), 256).alias("items_sha256"),
        (c["n_hit"] > 0).alias("contaminated"),
        c["longest"].alias("longest"),
        c["longest_start"].alias("longest_start"),
    )
