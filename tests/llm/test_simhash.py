"""SimHash near-duplicates (operator 4) and connected components."""

import random

import pytest
from pyspark.sql import functions as F

from brute import LONG, ODD_TEXTS, classes, documents, fingerprint
from codesieve.llm import simhash
from codesieve.llm.components import components


def signed(value):
    return value - (1 << 64) if value >> 63 else value


def expected(rows):
    """(doc_id, hex, component id) per row by comparing all fingerprints."""
    prints = [fingerprint(t) for _, t in rows]
    roots = classes(set(prints), lambda a, b: (a ^ b).bit_count() <= 2)
    least = {}
    for (doc, _), p in zip(rows, prints):
        if doc is not None:
            least[roots[p]] = min(doc, least.get(roots[p], doc))
    return sorted((str(doc), f"{p:016x}", str(least.get(roots[p]))) for (doc, _), p in zip(rows, prints))


@pytest.mark.parametrize("crowd", [0, 2, 256])
def test_documents_against_all_pairs(spark, crowd):
    base = LONG.split()[:400]
    texts = [*ODD_TEXTS, *ODD_TEXTS[:6], *(" ".join(base[:k] + ["new"] + base[k:]) for k in range(0, 400, 13)),
             "ONE two", "one TWO", "x y z", "A b c d", LONG + " end"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, "x y z"), (None, "null id"), (None, "x y z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit("clash"))
    found = simhash.near_duplicates(docs.repartition(3), crowd=crowd).collect()
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in found) == expected(rows)


@pytest.mark.parametrize("crowd", [0, 3, 10_000])
def test_links_of_dense_and_sparse_fingerprints(spark, crowd):
    rng = random.Random(7)
    values = {rng.getrandbits(64) for _ in range(150)}
    for centre in [0, (1 << 64) - 1, *list(values)[:12]]:
        values |= {centre ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64) for _ in range(25)}
    fps = spark.createDataFrame([(signed(v),) for v in values], "fp long")
    found = components(simhash.near_pairs(fps, crowd)).collect()
    roots = classes({signed(v) for v in values},
                    lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count() <= 2)
    got = {signed(v): signed(v) for v in values} | {r.node: r.component for r in found}
    assert got == roots


def test_components_of_paths_stars_and_loops(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(100)] + [(500, 500 + i) for i in range(200)] + [(900, 900), (901, 902), (902, 901)]
    rng.shuffle(edges)
    nodes = {x for e in edges for x in e if e[0] != e[1]}
    links = set(edges) | {(b, a) for a, b in edges}
    found = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.component for r in found} == classes(nodes, lambda a, b: (a, b) in links)
    assert len(found) == len(nodes)


def test_one_document_of_each_group_stays(spark):
    rows = [(5, "a b c d"), (2, "A b c d"), (2, "A b c d"), (7, "other words here"), (7, "yet another text"),
            (None, "no id"), (None, "no id"), (9, None), (4, " ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("__id", F.lit(1)) \
        .withColumn("component", F.lit("x"))
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((str(r.doc_id), r.text) for r in kept.collect()) == [
        ("2", "A b c d"), ("4", " "), ("7", "other words here"), ("7", "yet another text"), ("None", "no id")]


def test_empty_table(spark):
    assert simhash.near_duplicates(documents(spark, [])).collect() == []
    assert simhash.keep_one(documents(spark, [])).collect() == []
