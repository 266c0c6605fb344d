"""The registered queries against SQL, or against brute force in plain Python, over the whole small tables."""

import hashlib
import itertools
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm.queries import ORACLES, QUERIES

UP = {i: i + 32 for i in range(65, 91)}
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(name, spark, sf, duck, same):
    same(QUERIES[name](spark, sf), duck, ORACLES[name])


def table(duck, sql):
    return duck.sql(sql).fetchall()


def result(spark, sf, name, key):
    return {r[key]: r.asDict() for r in QUERIES[name](spark, sf).collect()}


def test_op3_text_of_articles(spark, sf, duck):
    import html

    got = result(spark, sf, "op3_html", "page_id")
    for page, url, source in table(duck, "SELECT page_id, url, html FROM pages"):
        article = re.sub(r"<[^>]*$", "", re.search(r"<article>(.*?)(</article>|\Z)", source, re.S)[1])
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]+>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>|<br>", article)]
        want = "\n".join(b for b in blocks if b)
        assert (got[page]["text"], got[page]["n_chars"], got[page]["url"]) == (want, len(want), url)


def test_op4_edits_and_likeness(spark, sf, duck):
    got = result(spark, sf, "op4_syncmers", "doc_id")
    docs = table(duck, "SELECT doc_id, text FROM documents ORDER BY doc_id")
    grams = lambda t: {t[i : i + 12] for i in range(max(1, len(t) - 11))}
    gaps = []
    for i, (d, text) in enumerate(docs):
        following = docs[(i + 1) % len(docs)][1]
        q = len(text) // 4
        edited = text[: len(text) - q] + following[:q]
        r = got[d]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        a, b = grams(text), grams(edited)
        gaps.append(abs(len(a & b) / len(a | b) - r["near_edited"]))
        kept = len(text) - q
        assert (r["passage_edited"] >= kept and (edited == text) <= (r["passage_edited"] == len(text))) or kept < 17
        long = r["passage_next"]
        assert long <= len(text) and (not long or any(text[p : p + long] in following for p in range(len(text) - long + 1)))
    assert np.mean(gaps) < 0.06
    assert np.mean([r["near_edited"] for r in got.values()]) > 0.5 > 0.05 > np.mean([r["near_next"] for r in got.values()])
    of = {}
    for d, text in docs:
        of.setdefault(text, set()).add(got[d]["fingerprint"])
    assert all(len(s) == 1 for s in of.values())


def test_op5_held_out_documents(spark, duck):
    sf = "/root/testdata/sf0.01"
    got = result(spark, sf, "op5_toxicity", "doc_id")
    labels = dict(table(duck, f"SELECT doc_id, toxic FROM '{sf}/labels.parquet'"))
    assert all(r["held_out"] == (zlib.crc32(str(d).encode()) % 4 == 2) and r["predicted"] == (r["score"] >= 0.3) for d, r in got.items())
    held = [(r["predicted"], labels[d]) for d, r in got.items() if r["held_out"] and d in labels]
    right = sum(p == y for p, y in held) / len(held)
    caught = sum(p for p, y in held if y) / sum(y for _, y in held)
    assert right > 0.9 and caught > 0.5


def test_op6_mixture_adds_up(spark, sf, duck):
    got = result(spark, sf, "op6_mixture", "doc_id")
    docs = table(duck, "SELECT doc_id, source, text FROM documents")
    tokens = {d: len(re.findall(r"[^\x20\x09-\x0d]+", t)) for d, _, t in docs}
    total = {}
    for d, s, _ in docs:
        total[s] = total.get(s, 0) + tokens[d]
        assert got[d]["n_tokens"] == tokens[d] and got[d]["repeats"] == len(got[d]["ranks"]) >= 1
    weights = {r["source"]: r["weight"] for r in got.values()}
    assert abs(sum(weights.values()) - 1) < 1e-9
    size = max(total[s] / weights[s] for s in total)
    for s in total:
        budget = next(r["budget"] for r in got.values() if r["source"] == s)
        taken = sum(r["n_tokens"] * r["repeats"] for r in got.values() if r["source"] == s)
        assert abs(budget - size * weights[s]) <= 1 and budget / total[s] <= 4.001
        assert budget - max(tokens[d] for d, x, _ in docs if x == s) <= taken <= budget


def simhash(text, k=3):
    w = re.findall(r"[^\x20\x09-\x0d]+", text.translate(UP))
    if not w:
        return 0
    s = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else [" ".join(w)]
    counts = [0] * 64
    for x in s:
        h = xxhash.xxh64_intdigest(x, seed=42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(s))


def components(fingerprints, radius):
    parent = {d: d for d in fingerprints}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for (a, f), (b, g) in itertools.combinations(fingerprints.items(), 2):
        if (f ^ g).bit_count() <= radius:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {d: find(d) for d in fingerprints}


def test_op8_fingerprints_and_components(spark, sf, duck):
    got = result(spark, sf, "op8_simhash", "doc_id")
    prints = {d: simhash(t) for d, t in table(duck, "SELECT doc_id, text FROM documents")}
    whole = components(prints, 2)
    assert all((r["fingerprint"], r["component_id"]) == (f"{prints[d]:016x}", whole[d]) for d, r in got.items()) and len(got) == len(prints)


PATTERNS = (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)
KINDS = ("email", "ip", "card", "phone")


def luhn(digits):
    return sum(v if i % 2 == 0 else sum(divmod(2 * v, 10)) for i, v in enumerate(map(int, reversed(digits)))) % 10 == 0


def base_spans(text):
    out = []
    for k, p in enumerate(PATTERNS):
        for m in re.finditer(p, text):
            d = re.sub(r"[^0-9]", "", m[0])
            if (k == 0) or (k == 1 and all(int(x) <= 255 for x in m[0].split("."))) or (k == 2 and 14 <= len(d) <= 19 and luhn(d)) or (k == 3 and 10 <= len(d) <= 15):
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_op9_base_spans(spark, duck):
    sf = "/root/testdata/sf0.01"
    got = result(spark, sf, "op9_pii", "doc_id")
    for d, text in table(duck, f"SELECT doc_id, text FROM '{sf}/documents.parquet'"):
        spans, r = base_spans(text), got[d]
        assert [r[f"n_{k}"] for k in KINDS] == [sum(s[1] == k for s in spans) for k in range(4)]
        listed = ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)
        assert r["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest()
        assert set(filter(None, listed.split(","))) <= set(r["spans"].split(","))


def test_op10_base_phrases(spark, duck):
    sf = "/root/testdata/sf0.01"
    got = result(spark, sf, "op10_licenses", "doc_id")
    phrases = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
    for d, text in table(duck, f"SELECT doc_id, text FROM '{sf}/documents.parquet'"):
        w = WORD.findall(text.translate(UP))
        at = [(i, label) for p, label in phrases for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        r = got[d]
        assert (r["n_words"], r["n_base"], r["base_labels"]) == (len(w), len(at), ",".join(sorted({x for _, x in at})))
        assert (r["first_word"], r["last_word"]) == (min((i for i, _ in at), default=None), max((i for i, _ in at), default=None))
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
