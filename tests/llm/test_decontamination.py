"""Benchmark decontamination (operator 2)."""

import random

import pytest
from pyspark.sql import functions as F

from brute import LONG, ODD_TEXTS, documents
from codesieve.llm import decontamination as d


def brute(docs, items, threshold=0.8, n=5):
    by_words = {}
    for item, text in items:
        if words := d.words_of(text):
            by_words.setdefault(tuple(words), []).append(item)
    grams = {min(ids): set(d.shingles_of(list(w), n)) for w, ids in by_words.items()}
    out = set()
    for doc, text in docs:
        own = set(d.shingles_of(d.words_of(text), n))
        for item, wanted in grams.items():
            if len(own & wanted) >= threshold * len(wanted):
                out.add((doc, item, len(own & wanted), len(wanted)))
    return sorted(out, key=str)


def run(spark, docs, items):
    table = spark.createDataFrame(docs, "doc_id long, text string").withColumn("windows", F.lit(1)).withColumn("id", F.lit(2))
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("n", F.lit("clash"))
    found = d.contained(table.repartition(3), bench).collect()
    assert all(abs(r.containment - r.shared / r.shingles) < 1e-12 for r in found)
    kept = d.without_contaminated(table.repartition(3), bench)
    assert kept.columns == table.columns
    bad = {(r.doc_id, r.text_hash) for r in found}
    rows = table.withColumn("h", F.xxhash64("text")).collect()
    assert sorted(str((r.doc_id, r.text)) for r in kept.collect()) == sorted(str((r.doc_id, r.text)) for r in rows if (r.doc_id, r.h) not in bad)
    return sorted({(r.doc_id, r.item_id, r.shared, r.shingles) for r in found}, key=str)


def words(rng, n):
    return [f"w{rng.randrange(5000)}" for _ in range(n)]


def test_items_of_all_sizes_inside_long_documents(spark):
    rng = random.Random(4)
    items = [(k, " ".join(words(rng, n))) for k, n in enumerate([1, 3, 4, 5, 6, 7, 9, 12, 15, 20, 28, 40, 59, 90, 200])]
    items += [(20, items[9][1].upper() + "!"), (30, None), (31, ""), (32, " ,. "), (33, items[11][1])]
    docs = []
    for k, (item, text) in enumerate(items[:15]):
        inside = text.split()
        for edits in range(5):
            now = list(inside)
            for _ in range(edits):
                now[rng.randrange(len(now))] = "changed"
            docs.append((len(docs), " ".join(words(rng, 30 * rng.randrange(20)) + now + words(rng, rng.randrange(900)))))
        docs.append((len(docs), text))
        docs.append((len(docs), " ".join(inside[:len(inside) * 9 // 10])))
    docs += [(500 + k, t) for k, t in enumerate(ODD_TEXTS)] + [(7, items[11][1]), (7, items[11][1]), (None, "x " + items[12][1])]
    expected = brute(docs, items)
    assert len(expected) > 40 and run(spark, docs, items) == expected


def test_long_text_as_item_and_empty_tables(spark):
    assert run(spark, [(1, LONG)], [(1, LONG[:40000])]) == brute([(1, LONG)], [(1, LONG[:40000])])
    assert run(spark, [], [(1, "a b c d e f")]) == run(spark, [(1, "a b c d e f")], []) == []


@pytest.mark.parametrize("text", ODD_TEXTS)
def test_array_shingles_are_those_of_the_words(text):
    texts = ["before it", text or "", "after it all there are words"]
    own = d.Hashes(texts, 5)
    for k, t in enumerate(texts):
        found = [own.string(i) for i in range(len(own.shingle)) if own.of[i] == k]
        assert found == d.shingles_of(d.words_of(t), 5)


def test_items_with_words_put_in_left_out_or_moved(spark):
    """Every kind of edit, at all sizes of the benchmark: whatever still holds four fifths of an item is found."""
    rng = random.Random(9)
    docs, items = [], []
    for size in range(15, 57):
        inside = words(rng, size)
        items.append((size, " ".join(inside)))
        for _ in range(12):
            now = list(inside)
            for _ in range(rng.randrange(1, 3)):
                at, to = rng.randrange(len(now)), rng.randrange(len(now))
                kind = rng.randrange(4)
                if kind == 0:
                    now.insert(at, "new")
                elif kind == 1:
                    now.pop(at)
                elif kind == 2:
                    now[at:at] = ["several", "new", "words"]
                else:
                    now = now[to:] + now[:to]
            docs.append((len(docs), " ".join(words(rng, 50) + now + words(rng, 50))))
    expected = brute(docs, items)
    assert len(expected) > 150 and run(spark, docs, items) == expected


def test_window_is_never_longer_than_what_is_left():
    """Breaks at all distances, each at the cost of an inserted word: the longest run left is no shorter than the window."""
    for n in range(1, 130):
        lost = n - -(-8 * n // 10)
        breaks = lost // 4
        longest = -(-(n - 4 * breaks) // (breaks + 1))
        assert 1 <= d.window_of(n, 5, 0.8) <= max(longest, 1), n
