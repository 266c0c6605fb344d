"""Small cases: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns, and each method's own rules."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import arrays, bpe, chat, decontaminate, graph, html, licenses, mixture, pii, simhash, syncmers, toxicity, urls
from tidemark.llm import jaccard as near

LONG = "w " * 60_000 + "a" * 200_000
ODD = [
    (1, None, "s"),
    (2, "", "s"),
    (3, "Plain words stand here for a while and then they end", None),
    (3, "Plain words stand here for a while and then they end", None),
    (None, "No id at all in this row of the table", "s"),
    (5, LONG, "t"),
    (6, "ÉTÉ naïve \U0001f600 mail a.b@c-d.example.org now", "t"),
]


def named_inside():
    """All names in quotes that the operators' code uses, so that none can clash with a user's column."""
    import pathlib

    code = "".join(p.read_text() for p in pathlib.Path(html.__file__).parent.glob("*.py"))
    return {n.lower() for n in re.findall(r"[\"'`]([A-Za-z]\w*)[\"'`]", code)} | {f"{n}{u}" for n in re.findall(r"free\(?n?\) for n in \(([^)]*)", code) for n in re.findall(r"\w+", n) for u in ("_", "__")}


CLASHING = sorted(named_inside() - {"doc_id", "text", "source", "url", "html", "n_chars"})


@pytest.fixture(scope="module")
def odd(spark):
    """Odd rows, with columns that bear the names which operators give or use."""
    df = spark.createDataFrame(ODD, "doc_id long, text string, source string")
    return df.withColumns({name: F.lit("own") for name in CLASHING})


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, "stand here for a while and then they end"), (2, None), (3, ""), (None, "zz"), (4, "w " * 12)], "item_id long, text string")


LABELS = "doc_id long, quality int, toxic int"


def all_operators(spark, docs, benchmark):
    labels = spark.createDataFrame([(1, 1, 0), (3, 0, 1), (7, 1, None)], LABELS)
    yield "scan", decontaminate.scan(docs, benchmark)
    yield "components", simhash.simhash_components(docs)
    yield "near", simhash.near_duplicates(docs)
    yield "syncmers", syncmers.fingerprint(docs)
    yield "toxicity", toxicity.score(docs, toxicity.train(docs, labels))
    yield "licenses", licenses.scan_licenses(docs)
    yield "pii", pii.find_private(docs)
    yield "sanitise", pii.sanitise(docs)
    yield "mixture", mixture.mix(docs)
    yield "html", html.extract(docs.withColumn("html", F.col("text")))
    yield "bpe", bpe.encode(docs, longest=300, most=150)
    yield "urls", urls.filter_urls(docs.withColumns({"url": F.col("text"), "html": F.col("text")}))


#: The column that each operator adds or replaces; the others give columns of their own only.
ADDED = {"scan": "contamination", "toxicity": "toxicity", "licenses": "licenses", "pii": "private", "sanitise": None, "mixture": "mixture", "html": "text", "urls": "decision", "bpe": "ids"}


def filters(spark, docs, benchmark):
    yield "keep_one", simhash.keep_one(docs)
    yield "remove_contaminated", decontaminate.remove_contaminated(docs, benchmark)
    yield "remove_toxic", toxicity.remove_toxic(docs, spark.createDataFrame([(k, 0, k % 2) for k in range(8)], LABELS))


def test_no_name_clashes(spark, odd, benchmark):
    for name, out in [*all_operators(spark, odd, benchmark), *filters(spark, odd, benchmark)]:
        if name in ADDED or name in ("keep_one", "remove_contaminated", "remove_toxic"):
            kept = [c for c in CLASHING if c != ADDED.get(name)]
            assert set(odd.columns) <= set(out.columns), name
            changed = out.select(*(F.count_if(~F.col(c).eqNullSafe(F.lit("own"))).alias(c) for c in kept)).first()
            assert not any(changed), name


def test_odd_rows(spark, odd, benchmark):
    for name, out in all_operators(spark, odd, benchmark):
        assert len(out.collect()) == len(ODD), name


def test_empty_tables(spark, odd, benchmark):
    for name, out in all_operators(spark, odd.limit(0), benchmark.limit(0)):
        assert out.collect() == [], name
    assert simhash.keep_one(odd.limit(0)).collect() == []
    assert syncmers.anchors(odd.limit(0)).collect() == []


def test_anchors_are_where_they_say(spark, odd):
    rows = syncmers.anchors(odd).filter("doc_id = 3").collect()
    assert rows and all(0 <= r["position"] < len(ODD[2][1]) for r in rows)
    # context-free: the same k-mers are chosen inside another text
    other = spark.createDataFrame([(9, "Something else. " + ODD[2][1])], "doc_id long, text string")
    moved = {(r["position"] - 16, r["anchor"]) for r in syncmers.anchors(other).collect()}
    assert {(r["position"], r["anchor"]) for r in rows} <= moved


@pytest.mark.parametrize("kind", ["string", "int", "long", "none", "one"])
def test_ids_of_any_type_follow_each_other(spark, kind):
    """Each text's follower, told by the digest of its edited text; also where all ids are null or one."""
    texts = [f"{'xyz' * (i % 7)} text number {i} of some length, to be cut and followed" for i in range(60)] + ["", "same", "same"]
    ids = {"string": [f"k{i * 7 % 64:02d}" for i in range(63)], "int": [i * 7 % 64 for i in range(63)], "long": [i * 7 % 64 for i in range(63)], "none": [None] * 63, "one": [5] * 63}[kind]
    df = spark.createDataFrame(list(zip(ids, texts, strict=True)), f"doc_id {'string' if kind == 'string' else 'int' if kind == 'int' else 'long'}, text string")
    got = syncmers.fingerprint(df)
    assert got.schema["doc_id"] == df.schema["doc_id"]
    order = [(r["doc_id"], r["text"]) for r in df.withColumn("h", F.xxhash64("text")).orderBy("doc_id", "h").collect()]
    want = []
    for (d, a), (_, b) in zip(order, [*order[1:], order[0]], strict=True):
        cut = len(a) // 4
        want.append((d, len(a), hashlib.sha256((a[: len(a) - cut] + b[:cut]).encode()).hexdigest()))
    assert sorted(((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got.collect()), key=repr) == sorted(want, key=repr)


def test_a_hot_id_is_many_ranges(spark):
    df = spark.range(4000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    sizes = [r["count"] for r in syncmers._with_followers(df).filter("rep = 0").groupBy("part").count().collect()]
    assert len(sizes) == 16 and max(sizes) < 900


def test_syncmers_are_chosen_by_their_least_part():
    rng, k, s = np.random.default_rng(5), 12, 6
    for letters in (2, 4, 200):
        texts = ["".join(chr(97 + c) for c in rng.integers(0, letters, n)) for n in (0, 3, 11, 12, 13, 40, 400)]
        points, cuts = syncmers.code_points(texts)
        text, at, value = syncmers.closed_syncmers(points, cuts, k, s)
        hashes = syncmers.Hashes(points)
        want = set()
        for i, t in enumerate(texts):
            chosen = []
            for p in range(len(t) - k + 1):
                places = cuts[i] + np.arange(p, p + k - s + 1)
                inner = hashes.of(places, places + s).tolist()
                if min(inner) in (inner[0], inner[-1]):
                    chosen.append(p)
            want |= {(i, p) for p in chosen or ([0] if t else [])}
            assert not t or len(t) < k or max(np.diff([-1, *chosen, len(t) - k + 1])) <= k - s + 1
        assert sorted(zip(text.tolist(), at.tolist(), strict=True)) == sorted(want)
        words = {}
        for i, p, v in zip(text.tolist(), at.tolist(), value.tolist(), strict=True):
            words.setdefault(v, set()).add(texts[i][p : p + k])
        assert all(len(w) == 1 for w in words.values())


def common(a, b):
    """The length of the longest substring of both, cell by cell."""
    best, row = 0, [0] * (len(b) + 1)
    for c in a:
        row = [0, *(row[j] + 1 if c == d else 0 for j, d in enumerate(b))]
        best = max(best, *row)
    return best


def test_passages_against_brute_force():
    rng = np.random.default_rng(8)
    word = lambda n, letters=26: "".join(chr(97 + c) for c in rng.integers(0, letters, n))
    pairs = [("", ""), ("", "abc"), ("abc", "abc"), ("abc", "abd"), ("é\U0001f600" * 40, "x" + "é\U0001f600" * 40)]
    for size in (17, 18, 25, 60, 300):
        for _ in range(8):
            shared = word(size)
            pairs.append((word(rng.integers(0, 200)) + shared + word(rng.integers(0, 200)), word(rng.integers(0, 200)) + shared + word(rng.integers(0, 90))))
    few = [(word(150, 2) + a, word(150, 2) + a) for a in (word(40, 2) for _ in range(10))]
    texts = [t for pair in pairs + few for t in pair]
    got = syncmers.Anchors(texts, 12, 6).passages([(2 * i, 2 * i + 1) for i in range(len(pairs + few))]).tolist()
    want = [common(*pair) for pair in pairs + few]
    exact = [w if w >= 12 or a == b else 0 for w, (a, b) in zip(want, pairs, strict=False)]
    assert got[: len(pairs)] == exact
    assert all(g <= w for g, w in zip(got[len(pairs) :], want[len(pairs) :], strict=True))


# --- decontamination -----------------------------------------------------------------------------


def brute_hits(text, items, window=10):
    up = {i: i + 32 for i in range(65, 91)}
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(up))
    w, hit, found = words(text), set(), set()
    for i, t in items:
        x = words(t)
        n = min(window, len(x))
        for p in range(len(x) - n + 1) if n else ():
            for q in range(len(w) - n + 1):
                if w[q : q + n] == x[p : p + n]:
                    hit |= set(range(q, q + n))
                    found.add("null" if i is None else str(i))
    return len(w), len(hit), sorted(found)


def test_windows_against_brute_force(spark):
    r = random.Random(1)
    vocabulary = ["a", "b", "C", "dé", "e1"]
    items = [(i, " ".join(r.choices(vocabulary, k=r.choice((3, 4, 6))))) for i in range(6)] + [(7, None), (None, "b b b b")]
    docs = [(i, r.choice((" ", ", ", "\n")).join(r.choices(vocabulary, k=r.randint(0, 40)))) for i in range(120)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for options in ({}, {"shard_bytes": 50}, {"block_bytes": 10}):
        got = {x["doc_id"]: x["contamination"] for x in decontaminate.scan(df, bench, window=4, **options).collect()}
        for d, t in docs:
            assert (got[d]["n_words"], got[d]["n_hit"], got[d]["items"]) == brute_hits(t, items, 4)
            assert sum(s["end"] - s["start"] for s in got[d]["spans"]) == got[d]["n_hit"]
            assert (got[d]["longest"], got[d]["longest_start"]) == brute_longest(t, items)


def brute_longest(text, items):
    words = lambda x: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (x or "").translate({i: i + 32 for i in range(65, 91)}))
    w, best, start = words(text), 0, None
    for p in range(len(w)):
        for _, item in items:
            v = words(item)
            for q in range(len(v)):
                n = 0
                while p + n < len(w) and q + n < len(v) and w[p + n] == v[q + n]:
                    n += 1
                if n > best:
                    best, start = n, p
    return best, start


def test_many_blocks_write_no_corpus(spark):
    import os

    from tidemark.sources.files import shared_folder

    items = [(i, " ".join(f"w{i}x{j}" for j in range(12))) for i in range(9)]
    docs = [(i, "before " + items[i % 9][1] + " after w3x4 w3x5") for i in range(30)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    before = sum(len(f) for _, _, f in os.walk(shared_folder(spark).removeprefix("file:")))
    got = decontaminate.scan(spark.createDataFrame(docs, "doc_id long, text string"), bench, block_bytes=200).collect()
    assert all(r["contamination"]["items"] == [str(r["doc_id"] % 9)] and r["contamination"]["longest"] == 12 for r in got) and len(got) == 30
    assert sum(len(f) for _, _, f in os.walk(shared_folder(spark).removeprefix("file:"))) == before


def test_wide_windows(monkeypatch):
    monkeypatch.setattr(decontaminate, "MOST_TOKENS", 64)
    words = [f"w{i}" for i in range(300)]
    data = np.frombuffer(" ".join(words).encode(), dtype=np.uint8)
    r = decontaminate.search_shard(np.array([0, len(data)]), data, decontaminate.TestSuffixes(["1"], [" ".join(words[100:140])], 30))[0]
    assert (r["n_hit"], r["longest"], r["longest_start"]) == (40, 40, 100)
    with pytest.raises(ValueError, match="at most 32 words"):
        decontaminate.search_shard(np.array([0, len(data)]), data, decontaminate.TestSuffixes(["1"], [" ".join(words[100:190])], 40))


def test_longest_match_and_pieces(spark, monkeypatch):
    item = " ".join(f"w{i}" for i in range(30))
    text = "x y " + " ".join(f"w{i}" for i in range(5, 28)) + " z"
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    c = decontaminate.scan(df, bench).first()["contamination"]
    assert (c["longest"], c["longest_start"], c["n_hit"]) == (23, 2, 23)
    monkeypatch.setattr(decontaminate, "MOST_TOKENS", 1040)  # steps of 16 tokens
    tests = decontaminate.TestSuffixes(["1"], [item], 10)
    data = np.frombuffer((text * 70).encode(), dtype=np.uint8)
    r = decontaminate.search_shard(np.array([0, len(data)]), data, tests)[0]
    assert r["n_hit"] == 23 * 70


def test_suffix_order_is_right():
    r = np.random.default_rng(0)
    ranks = r.integers(0, 3, 200).astype(np.int64)
    order = decontaminate.suffix_order(ranks, 12)
    keys = [tuple(ranks[i : i + 12]) for i in order.tolist()]
    assert keys == sorted(keys) and sorted(order.tolist()) == list(range(200))


# --- near duplicates -----------------------------------------------------------------------------


def test_components_of_a_graph(spark):
    r = random.Random(2)
    edges = [(i, i + 1) for i in range(60)] + [(r.randint(100, 180), r.randint(100, 180)) for _ in range(70)] + [(300, k) for k in range(301, 420)] + [(5, 5)]
    got = {x["node"]: x["root"] for x in graph.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    want = {x: find(x) for x in parent}
    want = {x: y for x, y in want.items() if x != y or any(z == x and w != x for w, z in want.items())}
    assert got == want


@pytest.mark.parametrize("size,radius", [(5, 2), (40, 2), (64, 3), (300, 2), (700, 5)])
def test_bit_sliced_blocks(size, radius):
    r = np.random.default_rng(size)
    base = r.integers(0, 2**63, 6, dtype=np.uint64)
    fps = base[r.integers(0, 6, size)]
    for _ in range(3):
        fps = fps ^ (np.uint64(1) << r.integers(0, 64, size).astype(np.uint64))
    fps = np.unique(fps)[:, None]
    near = np.bitwise_count(fps[:, 0][:, None] ^ fps[:, 0][None, :]) <= radius
    want = np.arange(len(fps))
    while True:
        new = np.where(near, want[None, :], len(fps)).min(axis=1)
        if (new == want).all():
            break
        want = new
    assert (simhash.block_components(fps, radius, most=16) == want).all()
    if len(fps) <= 64:
        assert (simhash.lane_components(fps, np.array([0]), np.array([len(fps)]), radius) == want).all()


def test_every_pair_within_the_radius_meets(spark):
    r = random.Random(4)
    fps, pairs = set(), []
    for _ in range(120):
        f = r.getrandbits(64)
        g = f
        for b in r.sample(range(64), r.choice((1, 2))):
            g ^= 1 << b
        fps |= {f, g}
        pairs.append((f, g))
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(f), signed(f)) for f in fps], "fp long, node long")
    links = {frozenset((x["a"], x["b"])) for x in simhash.exact_links(df).collect()}
    assert {frozenset((signed(f), signed(g))) for f, g in pairs} <= links


def test_near_copies_of_long_texts(spark):
    r = random.Random(6)
    words = lambda n: ["".join(r.choices("abcdefgh", k=6)) for _ in range(n)]
    docs, groups = [], []
    for g in range(12):
        base = words(300)
        members = []
        for k in range(4):
            w = list(base)
            if k:
                for i in r.sample(range(300), 3):  # a similarity of about 0.9
                    w[i] = "changed"
            members.append(len(docs))
            docs.append((len(docs), " ".join(w)))
        groups.append(members)
    for _ in range(60):
        docs.append((len(docs), " ".join(words(200))))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for most in (20_000, 1):  # blocks that are split, too
        got = {x["doc_id"]: x["component_id"] for x in simhash.near_duplicates(df, most=most).collect()}
        assert all(got[d] == members[0] for members in groups for d in members)
        assert all(got[d] == d for d, _ in docs[48:])
    kept = {x["doc_id"] for x in simhash.keep_one(df).collect()}
    assert kept == {m[0] for m in groups} | set(range(48, len(docs)))


def test_copies_keep_one_row(spark):
    df = spark.createDataFrame([(4, "same text of five words or more"), (2, "same text of five words or more"), (2, "same text of five words or more"), (None, "same text of five words or more"), (9, "another text that is not at all alike here")], "doc_id long, text string")
    assert sorted(x["doc_id"] for x in simhash.keep_one(df).collect()) == [2, 9]


HIGH = (1 << 62) + 5
ANY_IDS = [
    (HIGH, "one text with a number beyond all others as its id"),
    (HIGH + 4, "one text with a number beyond all others as its id"),
    (-7, "this text here has a number below zero as its id"),
    (8, "this text here has a number below zero as its id"),
    (-(1 << 63), "the least number of all is the id of this one"),
    (3, "two texts that are not alike under one and the same id"),
    (3, "an unlike second one which has the number three as well"),
    (None, "no id here at all but the words are its own ones"),
    (None, "no id here either and these words are others than those"),
    (None, "no id here either and these words are others than those"),
]


def test_ids_of_any_value(spark):
    df = spark.createDataFrame(ANY_IDS, "doc_id long, text string")
    want = {HIGH: {HIGH}, HIGH + 4: {HIGH}, -7: {-7}, 8: {-7}, -(1 << 63): {-(1 << 63)}, 3: {3}, None: {None}}
    for out in (simhash.near_duplicates(df), simhash.simhash_components(df)):
        got: dict = {}
        for x in out.collect():
            got.setdefault(x["doc_id"], set()).add(x["component_id"])
        assert got == want
    kept = sorted((x["doc_id"] is None, x["doc_id"] or 0, x["text"]) for x in simhash.keep_one(df).collect())
    assert len(kept) == 7 and {t for _, _, t in kept} == {t for _, t in ANY_IDS}
    named = df.withColumn("doc_id", F.col("doc_id").cast("string"))
    assert simhash.keep_one(named).count() == 7


def test_one_id_of_two_texts_unites_nothing(spark):
    r = random.Random(3)
    words = lambda: ["".join(r.choices("abcdefgh", k=6)) for _ in range(80)]
    a, b = words(), words()
    df = spark.createDataFrame([(1, " ".join(a)), (1, " ".join(b)), (2, " ".join(a[:-1])), (3, " ".join(b[:-1]))], "doc_id long, text string")
    assert {x["text"] for x in simhash.keep_one(df).collect()} == {" ".join(a), " ".join(b)}
    assert {(x["doc_id"], x["component_id"]) for x in simhash.near_duplicates(df).collect()} == {(1, 1), (2, 1), (3, 1)}


def jaccard(a, b):
    a, b = ({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (a.split(), b.split()))
    return len(a & b) / len(a | b)


def test_near_copies_are_those_of_an_exact_similarity(spark):
    r = random.Random(8)
    words = lambda n: ["".join(r.choices("abcdefgh", k=7)) for _ in range(n)]
    docs = []
    for length in (104, 304):  # 100 and 300 shingles; each new word at the end changes one
        for share in np.arange(5, 18, 0.5):
            for _ in range(2):
                base = words(length)
                changed = round((length - 4) * share / 100)
                docs += [" ".join(base), " ".join(base[: length - changed] + words(changed))]
    for length in (9, 10, 11, 12, 13, 14):  # short texts: one word changed, or one added
        for _ in range(6):
            base = words(length)
            docs += [" ".join(base), " ".join(base[:-1] + words(1)), " ".join(words(length)), " ".join(words(length))]
            base = words(length - 1)
            docs += [" ".join(base), " ".join(base + words(1))]
    base = words(60)  # sets count, not how often a passage comes
    docs += [" ".join(base + base[:10] * 30), " ".join(base + base[:10] * 2)]
    pairs = [(k, k + 1, jaccard(docs[k], docs[k + 1])) for k in range(0, len(docs), 2)]
    assert {0.78, 0.79, 0.8, 0.81, 0.82} <= {round(j, 2) for _, _, j in pairs}
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    got = {x["doc_id"]: x["component_id"] for x in simhash.near_duplicates(df).collect()}
    want = {k: k for k in range(len(docs))} | {b: a for a, b, j in pairs if j >= 0.8}
    assert got == want


def test_rows_without_an_id_stay(spark):
    df = spark.createDataFrame([(None, f"text number {k} has no id but words of its own") for k in range(40)], "doc_id long, text string")
    assert simhash.keep_one(df).count() == 40


def test_exact_links_unite_all_that_are_alike():
    r = np.random.default_rng(3)
    for n, pool in ((2, 12), (30, 14), (80, 16)):
        sets = [np.unique(r.choice(pool, r.integers(1, pool))).astype(np.int64) for _ in range(n)]
        alike = np.array([[len(np.intersect1d(a, b)) / len(np.union1d(a, b)) >= 0.75 for b in sets] for a in sets])
        want = np.arange(n)
        while not (want == (new := np.where(alike, want[None, :], n).min(axis=1))).all():
            want = new
        links = near.exact_links(np.concatenate(sets), np.array([len(s) for s in sets]), np.arange(n), 0.75)
        assert all(alike[a, b] for a, b in links) and len(links) == n - len(set(want.tolist()))
        assert all(want[a] == want[b] for a, b in links)


def test_large_groups_lose_no_link(spark):
    r = np.random.default_rng(5)
    sets = []
    for _ in range(3):  # copies of three bases, alike to their base and often not to each other; chains away from it; others
        base = r.integers(0, 2**40, 30)
        for _ in range(60):
            sets.append(np.concatenate([base[r.permutation(30)[: 30 - r.integers(0, 6)]], r.integers(0, 2**40, r.integers(0, 3))]))
        last = base
        for _ in range(12):
            last = np.concatenate([last[2:], r.integers(0, 2**40, 2)])
            sets.append(last)
    sets = [np.unique(s) for s in sets] + [np.unique(r.integers(0, 2**40, 30)) for _ in range(25)]
    n = len(sets)
    alike = np.array([[len(np.intersect1d(a, b)) / len(np.union1d(a, b)) >= 0.8 for b in sets] for a in sets])
    want = np.arange(n)
    while not (want == (new := np.where(alike, want[None, :], n).min(axis=1))).all():
        want = new
    df = spark.createDataFrame([(1, k, s.tolist()) for k, s in enumerate(sets)], "root long, node long, shingles array<long>")
    exact = near.verified_links(df, 0.8, most=600, rounds=2).collect()
    assert all(alike[x["a"], x["b"]] for x in exact)
    got = {x["node"]: x["root"] for x in graph.connected_components(spark.createDataFrame([tuple(x) for x in exact], "a long, b long")).collect()}
    assert [got.get(k, k) for k in range(n)] == want.tolist()


def test_no_task_holds_a_large_group(spark):
    r = random.Random(9)
    base = ["".join(r.choices("abcdefgh", k=6)) for _ in range(80)]
    docs = [(k, " ".join(base[: 80 - k % 3] + [f"own{k}"])) for k in range(200)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    sizes = []
    real = simhash._links
    simhash._links = lambda blocks, *a: (sizes.append(blocks.groupBy("key").count().agg(F.max("count")).first()[0]), real(blocks, *a))[1]
    try:
        got = {x["component_id"] for x in simhash.near_duplicates(df, most=50).collect()}
    finally:
        simhash._links = real
    assert got == {0} and all((s or 0) <= 50 for s in sizes)


def test_nothing_is_removed_without_a_model(spark):
    df = spark.createDataFrame([(k, f"some clean text {k}") for k in range(30)], "doc_id long, text string")
    for rows in ([], [(k, 0, 1) for k in range(30)]):  # no labels, or toxic ones only
        assert toxicity.remove_toxic(df, spark.createDataFrame(rows, LABELS)).count() == 30


# --- urls ----------------------------------------------------------------------------------------


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("decision", F.lit("own")).withColumn("host", F.lit("own"))


@pytest.mark.parametrize("most", [200, 0])
def test_rules_and_aliases(spark, monkeypatch, most):
    monkeypatch.setattr(urls, "MOST_RULES", most)
    rows = [
        (1, "http://a.org/x", '<link rel="canonical" href="http://b.net/es/1?a=1&amp;b=2">'),
        (2, "http://B.net/es/1?a=1&b=2#z", None),
        (3, "https://c.org/p/q", "<meta http-equiv=refresh content='0; url=/x2'>"),
        (4, "http://c.org/x2", "<LINK href=//a.org/x rel=canonical>"),
        (5, None, None),
        (6, "nourl", ""),
        (7, "http://d.org/", "<link rel=canonical href=http://e.net/fr/>"),
        (8, "http://d.org/", "<link rel=canonical href=http://f.com/>"),
        (9, "http://www.example.com/en/z?q=/es/", None),
        (10, "http://x.example.com/en/z", None),
        (11, "http://com", None),
        (12, "http://a.org/x", None),
        (12, "http://a.org/x", None),
    ]
    got = sorted((r["page_id"], r["decision"]["rule"], r["decision"]["verdict"]) for r in urls.filter_urls(pages(spark, rows)).collect())
    want = [(1, None, "block"), (2, "net/es/", "block"), (3, None, "block"), (4, None, "block"), (5, None, "allow"), (6, None, "allow"), (7, None, "allow"), (8, None, "allow")]
    want += [(9, "www.example.com/en/", "allow"), (10, "example.com/en/", "block"), (11, None, "allow"), (12, None, "block"), (12, None, "block")]
    assert got == want
    assert urls.filter_urls(pages(spark, rows).limit(0)).count() == 0


# --- html ----------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    "page,text",
    [
        (None, ""),
        ("", ""),
        ("<p>only <script>var a = '</p>';</script>this</p>", "only this"),
        ("<body><nav><a href=x>Home</a></nav><article><h1>T</h1><p>a&amp;b &lt;c&gt;<br>d\n e</p><p>Un<b>closed<p>Next.</article><footer>F</footer>", "T\na&b <c> d e\nUnclosed\nNext."),
        ("<body class='has-sidebar'><div class=content><h2>H</h2><p>Text that is long enough, really.</p><p>Short</p></div><div class=sidebar><p>Aside, with commas, and length, and more.</p></div></body>", "H\nText that is long enough, really.\nShort"),
        ("<main><p>Body text, of a page.</p><section id=comments><p>A comment, which is long, and has punctuation. Really long.</p></section><form><p>Name</p></form></main>", "Body text, of a page."),
        ("<article><p>cut off &am", "cut off &am"),
        ("<article><p>one</p><p cla", "one"),
        ("<article><ul><li>First item<li>Second item</ul><div class='cookie-notice'>We use cookies</div></article>", "First item\nSecond item"),
        ("<article><p title='a > b' x=\"5\" 6\">kept</p></article>", "kept"),
        ("just text", "just text"),
    ],
)
def test_main_text(page, text):
    assert html.main_text(page or "") == text


PLAIN = """<body><div class=w1><div class=k7><div>Home</div><div>Our work and more</div></div>
<div class=q3><h2>On rivers</h2><p>Rivers carry water, silt, and stories; they have done so for long.</p><p>Short one.</p><ul><li>a delta</li><li>a source</li></ul>
<p>People settle near them, as fields need water, and boats need a way, all year round.</p></div>
<div class=z9><span>All rights stay with us</span></div></div></body>"""


def test_paths_choose_without_telling_names():
    want = "On rivers\nRivers carry water, silt, and stories; they have done so for long.\nShort one.\na delta\na source\nPeople settle near them, as fields need water, and boats need a way, all year round."
    assert html.main_text(PLAIN) == want


FORUM = """<body><div class=top><a href=/>Home</a> <a href=/n>News</a></div><div class=k1><div class=k2><h1>On bridges</h1>
<p>A bridge carries a road over water, and it does so for a century, if it is cared for; few things that we build last as long.</p>
<p>The oldest ones are of stone. Later came iron, then steel, and with them spans that nobody had thought of, not even in dreams.</p></div>
<div class=k3><div class=k4>Bob: I don't agree with this at all.</div><div class=k4>Ann: nice one!</div><div class=k4>Tim: me too.</div></div></div>
<div class=k5>Write to us. All rights are ours.</div></body>"""


def test_comments_fall_by_their_paths():
    got = html.main_text(FORUM)
    assert got.startswith("On bridges\nA bridge") and got.endswith("in dreams.") and got.count("\n") == 2


@pytest.mark.parametrize("name", ["class='social-studies'", "id='related-work'", "class='ad-hoc'", "class='share-prices'", "id=search-algorithms"])
def test_names_within_other_words_are_none(name):
    text = "<p>This is about rivers, and about seas; it has a few sentences. It goes on.</p>" * 3
    assert html.main_text(f"<body><nav><a href=/>x</a></nav><div {name}>{text}</div><footer>All rights, of all kinds.</footer></body>").count("rivers") == 3


def test_a_name_weighs_and_does_not_decide():
    """A page that has nothing else keeps what stands in a box with a telling name."""
    assert html.main_text("<body><div class=comments><p>One long text, with marks, and a few words more. And so on.</p></div></body>").startswith("One long text")


def article_of(source):
    import html as references

    inner = re.sub(r"<[^>]*$", "", re.search(r"<article>(.*?)(</article>|\Z)", source, re.S)[1])
    blocks = [" ".join(references.unescape(re.sub(r"<[^>]+>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1)>", inner)]
    return "\n".join(b for b in blocks if b)


GIVEN = "SELECT html FROM '/root/testdata/sf0.1/pages.parquet'"


def test_scores_decide(monkeypatch, duck):
    """The lists alone give another text: with all scores at one, but none where no running text stands, and no mass asked for."""
    given = [h for (h,) in duck.sql(GIVEN).fetchall()]
    before = [html.main_text(h) for h in given]
    assert before == [article_of(h) for h in given]
    monkeypatch.setattr(html, "path_scores", lambda blocks: {(b.path, b.weight): float(b.weight > 0) for b in blocks})
    monkeypatch.setattr(html, "LEAST_MASS", 0.0)
    assert sum(a != html.main_text(h) for a, h in zip(before, given, strict=True)) > 2000


def test_ratios_give_most_articles_without_any_list(monkeypatch, duck):
    monkeypatch.setattr(html, "WEIGHED", frozenset())
    monkeypatch.setattr(html, "NAMES", frozenset())
    given = [h for (h,) in duck.sql(GIVEN).fetchall()]
    right = sum(html.main_text(h) == article_of(h) for h in given)
    assert right >= 0.93 * len(given)


def test_renamed_classes_and_tags_change_little(duck):
    given = [h for (h,) in duck.sql(GIVEN).fetchall()]
    plain = [h.replace('class="ad"', "class=q7") for h in given]
    for k, tag in enumerate(("nav", "article", "footer")):
        plain = [h.replace(f"<{tag}>", f"<div class=w{k}>").replace(f"</{tag}>", "</div>") for h in plain]
    assert sum(html.main_text(p) == article_of(h) for p, h in zip(plain, given, strict=True)) >= 0.9 * len(given)


def test_scores_against_plain_python(duck):
    """The ratios, the smoothing and the fusion written down once more."""
    import math

    for (page,) in duck.sql(GIVEN + " LIMIT 60").fetchall() + [(PLAIN,), (FORUM,)]:
        blocks, _ = html.blocks_of(page)
        of = {}
        for b in blocks:
            of.setdefault((b.path, b.weight), []).append(b)

        def ratio(key):
            own = of[key]
            chars = sum(len(b.text) - min(b.linked, len(b.text)) for b in own) / len(own)
            return chars * (1 + sum(1 for b in own for c in b.text if c in ".,;:!?…。，、；：！？") / len(own)) if key[1] else 0.0

        line = [ratio((b.path, b.weight)) for b in blocks]
        bell = {-1: math.exp(-0.5), 0: 1.0, 1: math.exp(-0.5)}
        want = {}
        for i, b in enumerate(blocks):
            near = {d: w for d, w in bell.items() if 0 <= i + d < len(line)}
            smooth = sum(w * line[i + d] for d, w in near.items()) / sum(near.values())
            want.setdefault((b.path, b.weight), []).append(math.sqrt(line[i] * smooth))
        got = html.path_scores(blocks)
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(k[1] * sum(v) / len(v)) for k, v in want.items())


def test_long_pages_take_linear_time():
    import time

    n = 100_000
    for page in ("<" * n, "<p a=\"" * 20_000, "<div>x" * n, "<div>" * n + "x" + "</div>" * n, "<i><div>" + "<b>" * n + "</i>" * n, "<b>" * n + "</i>" * n, "<ul><li>x" * n, "<table><tr><td>x" * 30_000, "<p><b>x" * n, "<section><p>A sentence, of words.</p>" * n):
        began = time.time()
        html.main_text(page)
        assert time.time() - began < 10, page[:20]


def test_extract_rows(spark):
    df = pages(spark, [(1, "u", None), (1, "u", None), (2, None, "<article><p>x</p></article>")]).withColumn("text", F.lit("own"))
    assert sorted(r["text"] for r in html.extract(df).collect()) == ["", "", "x"]


# --- toxicity ------------------------------------------------------------------------------------


def brute_marginals(emission, start, moves):
    n = len(emission)
    total, one = 0.0, np.zeros(n)
    for code in range(2**n):
        y = [code >> t & 1 for t in range(n)]
        s = (start if y[0] else 0) + sum(e for e, v in zip(emission, y, strict=True) if v) + sum(moves[a, b] for a, b in zip(y, y[1:], strict=False))
        total += np.exp(s)
        one += np.exp(s) * np.array(y)
    return one / total


def test_forward_backward_against_enumeration():
    r = np.random.default_rng(3)
    sizes = [1, 4, 0, 7, 2]
    cuts = np.concatenate([[0], np.cumsum(sizes)])
    emission, start, moves = r.normal(size=cuts[-1]) * 2, 0.7, r.normal(size=(2, 2))
    p, _, _ = toxicity.forward_backward(emission, cuts, start, moves)
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if b > a:
            assert np.allclose(p[a:b], brute_marginals(emission[a:b], start, moves))


def test_spans_are_code_points(spark):
    r = random.Random(8)
    plain = lambda: " ".join("".join(r.choices("aeiouxyz", k=5)) for _ in range(30))
    docs, labels = [], []
    for i in range(300):
        t = plain()
        if i % 3 == 0:
            w = t.split()
            w[r.randint(0, 29)] = "vileword" + r.choice(["s", "en", "y"])
            t = " ".join(w)
        docs.append((i, "é " + t))
        labels.append((i, 0, int(i % 3 == 0)))
    df, lf = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, LABELS)
    out = toxicity.score(df, toxicity.train(df, lf)).collect()
    for row in out:
        assert (row["toxicity"]["score"] >= toxicity.THRESHOLD) == (row["doc_id"] % 3 == 0)
        for s in row["toxicity"]["spans"]:
            assert row["text"][s["start"] : s["end"]].startswith("vileword")
    kept = toxicity.remove_toxic(df, lf)
    assert kept.columns == df.columns and kept.count() == 200


# --- chat ----------------------------------------------------------------------------------------


def test_round_trips(spark):
    r = random.Random(9)
    bits = ["<", "|", "\\", "<|", "im_start", "|>", "<|im_end|>", "<|im_start|>", "\n", "a", "<\\|", "%", "%3C|", "é", ""]
    rows = [(c, t, r.choice(["user", "assistant", "sys\ntem", "%0A<|x", None]), "".join(r.choices(bits, k=r.randint(0, 8))) if r.random() > 0.1 else None) for c in range(40) for t in range(r.randint(1, 5))]
    rows += [(None, 0, "user", "x"), (50, None, "assistant", "y"), (50, None, "assistant", "y")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("piece", F.lit("own"))
    out = chat.format_chats(df).withColumn("turns", chat.parse(F.col("formatted"))).collect()
    for row in out:
        want = sorted(((x[1] if x[1] is not None else -1, x[2] or "", x[3] or "") for x in rows if x[0] == row["conv_id"]))
        assert row["round_trip"] and [(t["role"], t["text"]) for t in row["turns"]] == [w[1:] for w in want]
        under = [re.sub(r"<(\\*)\\\|", r"<\1|", row["formatted"][s["start"] : s["end"]]) for s in row["loss"]]
        assert under == [w[2] for w in want if w[1] == "assistant"]
    assert chat.format_chats(df.limit(0)).count() == 0


# --- personal data -------------------------------------------------------------------------------


def base_spans(text):
    import importlib.util
    import os

    spec = importlib.util.spec_from_file_location("llm_queries_brute", os.path.join(os.path.dirname(__file__), "test_llm_queries.py"))
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return module.base_spans(text)


def test_spans_against_python(spark):
    r = random.Random(11)
    bits = ["a@b.c", "a@b.c.x@y.z", "@", ".", "1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1", "007.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 123-4567", "+12345", " ", "é", "\U0001f600", "\n", "-", "9", "%+_"]
    texts = ["".join(r.choices(bits, k=r.randint(1, 12))) for _ in range(400)] + ["a" * 100_000, "a@b" + ".c" * 50_000, "1" * 100_000, "1 " * 50_000, "+1" * 20_000, "+1" + "(" * 50_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x["doc_id"]: [(s["start"], s["kind"], s["end"]) for s in x["private"]] for x in pii.find_private(df, terms=spark.createDataFrame([], "term string")).collect()}
    for d, t in enumerate(texts):
        if len(t) < 1000:
            assert got[d] == base_spans(t), t
    assert got[401] == [(0, 0, 100_003)]


def brute_terms(texts, threshold, z):
    """The statistic of disclosing terms in plain Python: {(kind, term): (documents, together, contexts, strength)}."""
    word = re.compile(r"[^\W_]{3,}")

    def shape(w):
        digit, letter = any(c.isnumeric() for c in w), any(c.isalpha() for c in w)
        return f"{'a9' if letter else '9'}:{len(w)}" if digit else w

    documents, together, contexts, size = {}, {}, {}, [0] * 5
    for t in texts:
        spans = base_spans(t)
        kinds = {k for _, k, _ in spans} | ({4} if spans else set())
        for a, _, b in spans:
            t = t[:a] + " " * (b - a) + t[b:]
        words = word.findall(t.lower())
        terms = [shape(w) for w in words]
        for k in kinds:
            size[k] += 1
        for x in set(terms):
            documents[x] = documents.get(x, 0) + 1
            for k in kinds:
                together[k, x] = together.get((k, x), 0) + 1
        for i, x in enumerate(terms):
            for k in kinds:
                contexts.setdefault((k, x), set()).add((words[i - 1] if i else None, words[i], words[i + 1] if i + 1 < len(words) else None))
    out = {}
    for (k, x), c in together.items():
        share, rate = size[k] / len(texts), c / documents[x]
        n = min(c, len(contexts[k, x])) / rate
        low = (rate + z * z / (2 * n) - z * max(0.0, rate * (1 - rate) / n + z * z / (4 * n * n)) ** 0.5) / (1 + z * z / n)
        strength = np.log2(low / share) / -np.log2(share) if share < 1 and low > 0 else -9
        if strength >= threshold:
            out[k, x] = (documents[x], c, len(contexts[k, x]), strength)
    return out


def test_terms_against_brute_force(spark, sf):
    r = random.Random(12)
    common = ["alpha", "beta", "gamma", "delta", "epsilon"]
    texts = []
    for i in range(400):
        w = r.choices(common, k=25)
        if i % 10 == 0:  # a word and a secret of one shape beside addresses
            w[3:3] = ["clinicmail", f"u{i}@x.org", f"{r.getrandbits(80):020x}z1"]
        if i % 10 == 5:
            w[7:7] = ["rarely", f"10.0.0.{i % 200}" if i % 40 == 5 else "never"]
        texts.append(" ".join(w))
    texts += ["Clinicmail without any address, e5" + "a7" * 10] * 3 + ["copied words once@here.org of a single text"] * 60 + ["", "same"]
    df = spark.createDataFrame(list(enumerate([*texts, None])), "doc_id long, text string").withColumn("n_chars", F.lit(0))
    for threshold in (0.6, 0.3):
        want = brute_terms([*texts, ""], threshold, 4.0)
        got = {(x["kind"], x["term"]): tuple(x)[2:] for x in pii.disclosing_terms(df, threshold=threshold).collect()}
        assert got.keys() == want.keys() and all(np.allclose(got[k], want[k]) for k in want)
    assert {t for _, t in brute_terms(texts, 0.6, 4.0)} == {"clinicmail", "a9:22"}  # and no word of the copied text
    clean = {x["doc_id"]: x for x in pii.sanitise(df).collect()}
    assert all("<TERM> <EMAIL> <TERM>" in clean[i]["text"] for i in range(0, 400, 10))
    assert clean[400]["text"] == "<TERM> without any address, <TERM>"
    assert all(clean[i]["text"] == texts[i] and clean[i]["n_chars"] == len(texts[i]) for i in range(400) if i % 5)


def test_given_documents_yield_terms(spark, duck):
    sf = "/root/testdata/sf0.1"
    texts = [t for (t,) in duck.sql(f"SELECT coalesce(text, '') FROM '{sf}/documents.parquet'").fetchall()]
    want = brute_terms(texts, 0.6, 4.0)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {(x["kind"], x["term"]): x["strength"] for x in pii.disclosing_terms(docs).collect()}
    assert want and got.keys() == want.keys() and all(abs(got[k] - want[k][3]) < 1e-9 for k in want)
    spans = pii.find_private(docs).select(F.explode(F.filter("private", lambda s: s["kind"] == pii.TERM)).alias("s"), "text").select(F.expr("lower(substring(text, s.start + 1, s.end - s.start))").alias("w")).collect()
    found = [x["w"] for x in spans]
    assert {(4, "token"), (4, "a9:40")} <= want.keys() and set(found) >= {t for _, t in want if ":" not in t}
    assert found.count("token") == sum(len(re.findall(r"(?<![^\W_])token(?![^\W_])", t.lower())) for t in texts)


def test_overlaps_are_redacted_once(spark):
    df = spark.createDataFrame([(1, "call +1.2.3.4 5678901 or 10.0.0.1")], "doc_id long, text string")
    text = pii.sanitise(df).first()["text"]
    assert not re.search(r"\d", text) and text.startswith("call <")


# --- licenses ------------------------------------------------------------------------------------


def test_automaton_against_brute_force():
    r = random.Random(13)
    sequences = [[r.choice([b"a", b"b", b"c"]) for _ in range(r.randint(1, 8))] for _ in range(5)]
    automaton = licenses.SuffixAutomaton(sequences, 5)
    tokens = [r.choice([b"a", b"b", b"c", b"z"]) for _ in range(300)]
    inside = lambda x: any(s[i : i + len(x)] == x for s in sequences for i in range(len(s) - len(x) + 1))
    sizes = {p: n for p, _, n in automaton.matches(tokens)}
    for p in range(len(tokens)):
        n = 0
        while n < 9 and n <= p and inside(tokens[p - n : p + 1]):
            n += 1
        assert sizes.get(p, 0) == n
    found = {(p, k) for p, state, n in automaton.matches(tokens) for k, size in automaton.phrases[state] if n >= size}
    assert found == {(p, k) for p in range(len(tokens)) for k, s in enumerate(sequences) if p + 1 >= len(s) and tokens[p + 1 - len(s) : p + 1] == s}


def test_every_place_of_a_state():
    r = random.Random(14)
    sequences = [[r.choice([b"a", b"b", b"c"]) for _ in range(r.randint(1, 9))] for _ in range(6)]
    automaton = licenses.SuffixAutomaton(sequences)
    tokens = [r.choice([b"a", b"b", b"c"]) for _ in range(200)]
    for p, state, n in automaton.matches(tokens):
        piece = tokens[p - n + 1 : p + 1]
        assert sorted(automaton.ends[state]) == [(k, i + n - 1) for k, s in enumerate(sequences) for i in range(len(s) - n + 1) if s[i : i + n] == piece]


def test_covered_shares_against_brute_force():
    r = random.Random(15)
    scanner = licenses.Scanner((), licenses.TEMPLATES)
    for label, wording in licenses.TEMPLATES:
        words = licenses.words_of(wording.encode())
        for _ in range(12):
            broken = {i for i in range(len(words)) if r.random() < r.choice([0.02, 0.1, 0.25])}
            said = [b"zz%d" % i if i in broken else w for i, w in enumerate(words)]
            runs = "".join("x" if i in broken else "." for i in range(len(words)))
            whole = [m for m in re.finditer(r"\.+", runs) if len(m[0]) >= 3 or m.end() == len(words)]
            gaps = [b.start() - a.end() for a, b in zip(whole, whole[1:], strict=False)]
            if not whole or len(whole[0][0]) < 3 or max(gaps, default=0) > 8:
                continue
            share = sum(len(m[0]) for m in whole) / len(words)
            nth = iter(range(len(words)))
            written = licenses.WORD.sub(lambda m: said[next(nth)], wording.lower().encode())
            got = scanner.result(b"before it " + written + b" after it", 0.75)
            own = [s["covered"] for s in got["spans"] if s["label"] == label]
            if not licenses.states(label, said, written):  # the version, or a word of the variant, is among the broken ones
                assert not own
                continue
            assert bool(own) == (share >= 0.75) or (share >= 0.75 and got["spans"])
            assert share < 0.75 or not own or abs(max(own) - share) < 1e-9


def test_shared_wording_counts_for_all_templates():
    both = "one two three four five six seven"
    scanner = licenses.Scanner((), [("a", both + " eight nine"), ("b", both + " ten eleven")])
    assert scanner.result(both.encode(), 0.7)["labels"] == ["a", "b"]
    assert scanner.result((both + " ten eleven").encode(), 0.7)["labels"] == ["b"]


def test_template_spans():
    scanner = licenses.Scanner(licenses.PHRASES, licenses.TEMPLATES)
    mit = licenses.TEMPLATES[0][1]
    words = mit.split()
    r = scanner.result(("before it " + " ".join(words[:60] + ["altered"] + words[61:]) + " after it").encode(), 0.75)
    assert r["labels"] == ["mit"] and r["n_base"] == 0 and r["score"] > 0.8 and r["spans"][0]["start"] == 2
    assert scanner.result(b"nothing of the kind stands here", 0.75)["labels"] == []
    assert scanner.result(b"under the Apache License it is", 0.75)["base_labels"] == ["apache"]
    for text, labels in (("Licensed under CC BY-NC 4.0.", ["cc-by", "cc-by-nc-4.0"]), ("Licensed under CC BY 4.0", ["cc-by", "cc-by-4.0"]), ("it is licensed under the Apache License, Version 2.0, here", ["apache", "apache-2.0"])):
        assert scanner.result(text.encode(), 0.75)["labels"] == labels


@pytest.mark.parametrize(
    ("text", "labels"),
    [
        ("This work is licensed under the GNU General Public License, version 3.", ["gpl", "gpl-3.0"]),
        ("This work is licensed under the GNU General Public License v2.", ["gpl", "gpl-2.0"]),
        ("This work is licensed under the GNU General Public License.", ["gpl"]),
        ("This work is licensed under the GNU General Public License v1.0", ["gpl"]),
        ("This work is licensed under the GNU General Public License, version 2 or version 3", ["gpl", "gpl-2.0", "gpl-3.0"]),
        ("Licensed under the Apache License", ["apache"]),
        ("Licensed under the Apache License, Version 1.1", ["apache"]),
        ("Licensed under CC BY-NC", ["cc-by"]),
        ("Licensed under CC BY-SA 3.0", ["cc-by"]),
        ("Licensed under CC BY-NC-SA 4.0", ["cc-by", "cc-by-nc-sa-4.0"]),
        ("Licensed under the Mozilla Public License, Version 2.0", ["mpl-2.0"]),
    ],
)
def test_versions_only_where_stated(text, labels):
    assert licenses.Scanner(licenses.PHRASES, licenses.TEMPLATES).result(f"Before it. {text} Then 3.0 apples, all in all.".encode().replace(b" Then 3.0", b" And so they said that there were then 3.0"), 0.75)["labels"] == labels


def test_every_wording_names_itself_alone():
    scanner = licenses.Scanner((), licenses.TEMPLATES)
    for label, wording in licenses.TEMPLATES:
        assert scanner.result(wording.encode(), 0.75)["labels"] == [label], label


def test_given_notices_name_one_version(duck):
    scanner = licenses.Scanner(licenses.PHRASES, licenses.TEMPLATES)
    texts = [t for (t,) in duck.sql("SELECT text FROM '/root/testdata/sf0.1/documents.parquet' WHERE lower(text) LIKE '%general public license%'").fetchall()]
    assert len(texts) > 50 and {tuple(scanner.result(t.encode(), 0.75)["labels"]) for t in texts if "version 3" in t.lower()} <= {("gpl", "gpl-3.0"), ("apache", "gpl", "gpl-3.0")}


def test_given_documents_have_labels_beyond_the_phrases(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = licenses.scan_licenses(docs).select(F.explode("licenses.labels").alias("label")).groupBy("label").count().collect()
    assert {r["label"] for r in got} >= {"apache", "apache-2.0", "cc-by", "cc-by-nc-4.0", "mit"}


# --- mixture -------------------------------------------------------------------------------------


def test_exponent_meets_limits(spark):
    rows = [(i, "s" + str(min(9, int(i**0.5) // 3)), "w " * (1 + i % 7)) for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    for options in ({"max_repeats": 2.0}, {"max_repeats": 100.0}, {"entropy": 1.5, "max_repeats": None}, {"max_repeats": 3.0, "block_tokens": 50}, {"max_repeats": 3.0, "budget": 20_000}):
        got = [x.asDict(recursive=True) for x in mixture.mix(df, **options).collect()]
        weights = {x["source"]: x["mixture"]["weight"] for x in got}
        assert abs(sum(weights.values()) - 1) < 1e-9 and len(got) == 2000
        if "entropy" in options:
            assert abs(-sum(w * np.log(w) for w in weights.values()) - 1.5) < 1e-3
        else:
            assert max(x["mixture"]["repeats"] for x in got) <= options["max_repeats"] + 1
        for s in weights:
            own = [x["mixture"] for x in got if x["source"] == s]
            taken = sum(m["n_tokens"] * m["repeats"] for m in own)
            assert own[0]["budget"] - 7 <= taken <= own[0]["budget"]
            assert all(m["repeats"] >= 1 and len(m["ranks"]) == m["repeats"] for m in own)
            for e in range(max(m["repeats"] for m in own)):  # in each epoch a block has one place
                places = {m["block"]: m["ranks"][e] for m in own if m["repeats"] > e}
                assert len(set(places.values())) == len(places)


def test_ranks_in_buckets(spark, monkeypatch):
    df = spark.createDataFrame([(i, "s" + str(i % 2), "w w") for i in range(1500)], "doc_id long, source string, text string")
    whole = mixture.mix(df, block_tokens=10, max_repeats=2.0, budget=4_500)
    a = {x["doc_id"]: x["mixture"] for x in whole.collect()}
    monkeypatch.setattr(mixture, "PER_BUCKET", 20)
    b = {x["doc_id"]: x["mixture"] for x in mixture.mix(df, block_tokens=10, max_repeats=2.0, budget=4_500).collect()}
    assert a == b and sum(m["n_tokens"] * m["repeats"] for m in a.values()) == 4_500


def test_limits_that_cannot_be_kept(spark):
    df = spark.createDataFrame([(i, "s" + str(i % 3 % 2), "w w") for i in range(90)], "doc_id long, source string, text string")
    for options in ({"budget": 180 * 20}, {"entropy": 0.7, "max_repeats": None}, {"entropy": -0.1, "max_repeats": None}, {"entropy": 0.69, "max_repeats": 1.1}):
        with pytest.raises(ValueError):
            mixture.mix(df, **options)
    even = spark.createDataFrame([(i, "s" + str(i % 2), "w w") for i in range(90)], "doc_id long, source string, text string")
    with pytest.raises(ValueError):  # equal shares keep their entropy at any exponent
        mixture.mix(even, entropy=0.3)


def test_budget_below_the_corpus(spark):
    df = spark.range(500).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("string").alias("source"), F.lit("one two").alias("text"))
    got = mixture.mix(df, budget=400, block_tokens=40)
    assert got.agg(F.sum(F.col("mixture.n_tokens") * F.col("mixture.repeats"))).first()[0] == 400
    assert got.count() == 500


# --- the arrays ----------------------------------------------------------------------------------


def test_slices_hold_all_rows():
    import pyarrow as pa

    texts = ["", "abc", None, "é" * 100, "x" * 1000, ""]
    column = pa.chunked_array([pa.array(["skip", *texts[:2]]).slice(1), pa.array(texts[2:])])
    parts = [data[offsets[i] : offsets[i + 1]].tobytes().decode() for a, b, offsets, data in arrays.slices(column, 64) for i in range(b - a)]
    assert parts == [t or "" for t in texts]
