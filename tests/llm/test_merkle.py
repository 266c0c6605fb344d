"""The manifest against a plain tree; the query itself is held against its SQL in test_llm_queries."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from tidemark.llm import merkle


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def way(nodes, i):
    out = []
    while len(nodes) > 1:
        a = i // 3 * 3
        run = nodes[a : a + 3]
        out.append((i - a, run[: i - a] + run[i - a + 1 :]))
        nodes = [H(*nodes[j : j + 3]) for j in range(0, len(nodes), 3)]
        i //= 3
    return nodes[0], out


def plain(rows):
    by = {}
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))):
        by.setdefault(r[1], []).append(r)
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    leaves = {s: [leaf(r) for r in by[s]] for s in order}
    subroots, out = [way(leaves[s], 0)[0] for s in order], []
    for k, s in enumerate(order):
        root, upper = way(subroots, k)
        for i, r in enumerate(by[s]):
            path = way(leaves[s], i)[1] + upper
            cut = r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
            node = leaf((*r[:4], r[4].replace("\n", "")) if cut else r)
            for at, others in path:
                node = H(*others[:at], node, *others[at:])
            out.append((r[0], leaves[s][i], subroots[k], root, H(*(x for _, o in path for x in o)), node, node == root))
    return sorted(out, key=repr)


ROWS = [(i, s, None, i, "a\nb" * (i % 3)) for i in range(40) for s in (None, "", "=", "x", "é")] + [(None, None, None, None, None)] * 3 + [(5, "x", "en", 3, "repeated")] * 2
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, seq int, leaf string"


@pytest.mark.parametrize("depth", [1, 2, 3, 8])
def test_odd_rows_and_any_superblock(spark, depth):
    df = spark.createDataFrame([(*r, 1, "l") for r in ROWS], SCHEMA)
    hit = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    got = merkle.manifest(df, check={"text": F.when(hit, F.translate("text", "\n", "")).otherwise(F.col("text"))}, depth=depth, proofs=True).collect()
    names = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    assert sorted((tuple(r[c] for c in names) for r in got), key=repr) == plain(ROWS)
    assert all(merkle.fold(r["leaf"], merkle.from_text(r["proof"])) == r["root"] for r in got)


def test_empty_and_lone_rows(spark):
    df = spark.createDataFrame([ROWS[1] + (1, "l")], SCHEMA)
    assert merkle.manifest(df.limit(0)).count() == 0
    (r,) = merkle.manifest(df).collect()
    assert r["leaf"] == r["subroot"] == r["root"] == leaf(ROWS[1]) and r["proof_sha256"] == H() and r["verified"]


def test_ids_may_be_texts(spark):
    df = spark.createDataFrame([(str(i), "s", None, None, None) for i in range(30)], "doc_id string, source string, lang string, n_chars long, text string")
    (root,) = {r["root"] for r in merkle.manifest(df, depth=1).collect()}
    assert root == way([leaf((x, "s", None, None, None)) for x in sorted(map(str, range(30)))], 0)[0]


def test_whole_levels_only(spark):
    """27 leaves under superblocks of 9: the first is full, and so are its siblings."""
    assert [len(x) for x in merkle.superblock(["x"] * 9, 0, 2)] == [9, 3, 1]
    assert [len(x) for x in merkle.superblock(["x"], 1, 2)] == [1, 1, 1]
    assert [len(x) for x in merkle.superblock(["x"], 0, 2)] == [1]
