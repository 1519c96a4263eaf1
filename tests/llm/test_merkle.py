"""Merkle manifest (operator 12) against trees built in one piece."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from codesieve.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    doc_id, text, lang, source, n_chars = row
    return sha(*("-" if x is None else f"{len(str(x).encode())}:{x}" for x in (doc_id, source, lang, n_chars, text)))


def tree(nodes, fanout=16):
    """The root, and per node its path of (left, right)."""
    paths, members = [[] for _ in nodes], [[k] for k in range(len(nodes))]
    while len(nodes) > 1:
        above, under = [], []
        for low in range(0, len(nodes), fanout):
            run = nodes[low:low + fanout]
            for k, group in enumerate(members[low:low + fanout]):
                for m in group:
                    paths[m].append(("".join(run[:k]), "".join(run[k + 1:])))
            above.append(sha(*run))
            under.append([m for group in members[low:low + fanout] for m in group])
        nodes, members = above, under
    return nodes[0], paths


def expected(rows, tampered):
    sources = {}
    for row in rows:
        sources.setdefault(row[3], []).append(row)
    order = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    grown = {}
    for s in order:
        own = sorted(sources[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        grown[s] = (own, *tree([leaf(r) for r in own]))
    root, tops = tree([grown[s][1] for s in order]) if order else (None, [])
    out = []
    for k, s in enumerate(order):
        own, subroot, paths = grown[s]
        for row, path in zip(own, paths):
            path = path + tops[k]
            folded = leaf(tampered(row))
            for left, right in path:
                folded = sha(left, folded, right)
            out.append((row[0], s, leaf(row), subroot, root, sha(*(x for p in path for x in p)), folded, folded == root))
    return sorted(out, key=str)


def lowered(row):
    if row[0] is None or row[1] is None or zlib.crc32(str(row[0]).encode()) % 5:
        return row
    return (row[0], "".join(c.lower() if "A" <= c <= "Z" else c for c in row[1]), *row[2:])


def found(docs):
    def one(text):
        return merkle.leaf_of(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text)

    text = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, one(text))
    return merkle.manifest(docs, one(F.col("text")), tampered=tampered)


def rows_of(got):
    return sorted(((r.id, r.source, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in got.collect()), key=str)


def test_sources_of_many_sizes(spark):
    rng = random.Random(2)
    rows, k = [], 0
    for source, n in ((None, 3), ("", 1), ("a", 16), ("B", 17), ("é", 256), ("src0", 700), ("\U0001f600", 257), ("ﬀ", 33)):
        for _ in range(n):
            rows.append((k, rng.choice(["Text A", "no capital", "", None, "É Z"]), rng.choice(["en", None]), source, rng.choice([3, None])))
            k += 1
    rows += [(f, "more", "en", f"many {f % 40}", 4) for f in range(9000, 9100)]
    rows += [(None, "No Id", None, "a", 1), (None, "other", None, "a", 1), (7, "again", None, None, None), (7, "again", None, None, None), (7, "A", "x", None, 0)]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(6).withColumn("tree", F.lit("clash")).withColumn("digest", F.lit(1)).withColumn("nth", F.lit(1))
    want = expected(rows, lowered)
    assert {v for *_, v in want} == {True, False}
    assert rows_of(found(docs)) == want


@pytest.mark.parametrize("levels", [1, 2])
def test_trees_of_many_blocks(spark, monkeypatch, levels):
    """With small blocks a tree takes several sweeps in each direction."""
    rows = [(k, f"Text {k}", None, "one" if k % 3 else f"source {k % 60}", k) for k in range(1500)]
    monkeypatch.setattr(merkle, "LEVELS", levels)
    monkeypatch.setattr(merkle, "BLOCK", 16 ** levels)
    assert merkle.Block([b"x"] * 5, 10 ** 6).levels == levels
    # workers import the module anew, so the sweep is followed here
    nodes = [leaf(r).encode() for r in rows]
    size, level = len(nodes), nodes
    while size > merkle.BLOCK:
        level = [merkle.Block(level[low:low + merkle.BLOCK], size).top() for low in range(0, size, merkle.BLOCK)]
        size = len(level)
    assert merkle.Block(level, size).top().decode() == tree([leaf(r) for r in rows])[0]


def test_more_than_a_block(spark):
    """65,536 rows are a block; this source has more, and another fills one exactly."""
    docs = spark.range(70_000 + 65_536).select(
        F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text"), F.lit(None).cast("string").alias("lang"),
        F.when(F.col("id") < 70_000, "large").otherwise("full").alias("source"), F.lit(1).cast("long").alias("n_chars"))
    rows = [(k, str(k), None, "large" if k < 70_000 else "full", 1) for k in range(70_000 + 65_536)]
    want = expected(rows, lowered)
    got = found(docs)
    assert rows_of(got) == want


def test_empty_table_and_single_row(spark):
    assert found(spark.createDataFrame([], SCHEMA)).collect() == []
    row = (5, "Alone", None, None, None)
    got = rows_of(found(spark.createDataFrame([row], SCHEMA)))
    assert got == expected([row], lowered) and got[0][5] == hashlib.sha256(b"").hexdigest()
