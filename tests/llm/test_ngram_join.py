"""N-gram Jaccard join (operator 13) against all pairs."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from brute import LONG, ODD_TEXTS, documents
from codesieve.llm import ngram_join


def shingles(text, n=3):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(words[i:i + n]) for i in range(len(words) - n + 1)} or ({tuple(words)} if words else set())


def expected(rows, n=3, percent=90):
    sets = [shingles(t, n) for _, t in rows]
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for k, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(k)] = min(doc, least.get(find(k), doc))
    return sorted((str(doc), len(s), str(doc if not s else least.get(find(k)))) for k, ((doc, _), s) in enumerate(zip(rows, sets)))


def found(spark, rows, **options):
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("node", F.lit("clash")).withColumn("first", F.lit(1))
    return sorted((str(r.doc_id), r.n_shingles, str(r.component_id))
                  for r in ngram_join.similar_sets(docs.repartition(3), cells=12, **options).collect())


def test_odd_texts(spark):
    texts = [*ODD_TEXTS, *ODD_TEXTS[:8], "x y", "X  Y", "x y z", "é É", "a\x0bb\x0cc", "a b c a b c a b c"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, "x y z"), (None, "x y z"), (None, "null id alone"), (5, None)]
    assert found(spark, rows) == expected(rows)


def test_near_copies_at_the_threshold(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = [rng.choice(vocabulary) for _ in range(30)]
    texts = []
    for size in (9, 10, 11, 12, 13, 20, 22, 31, 60, 120, 300):
        base = [rng.choice(vocabulary) for _ in range(size)]
        for changes in range(6):
            own = list(base)
            for _ in range(changes):
                at = rng.randrange(len(own))
                own[at:at + rng.randrange(2)] = [rng.choice(vocabulary)] * rng.randrange(3)
            texts.append(" ".join(own))
        texts += [" ".join(base + [f"end{k}" for k in range(extra)]) for extra in (1, 2, 5)]
        texts += [" ".join(base[:5] + passage + base[5:]), " ".join(passage + base)]
    rows = [(1000 + k, t) for k, t in enumerate(texts)]
    rng.shuffle(rows)
    want = expected(rows)
    assert len({c for _, _, c in want}) < len(rows) - 20
    assert found(spark, rows) == want


@pytest.mark.parametrize("percent, n", [(80, 2), (95, 5), (100, 3)])
def test_other_thresholds(spark, percent, n):
    rng = random.Random(percent)
    base = [f"w{rng.randrange(300)}" for _ in range(80)]
    rows = []
    for k in range(60):
        own = list(base)
        for _ in range(k % 7):
            own[rng.randrange(len(own))] = f"v{rng.randrange(50)}"
        rows.append((k, " ".join(own)))
    assert found(spark, rows, percent=percent, n=n) == expected(rows, n, percent)


def test_a_large_group_without_a_centre_makes_no_pairs_of_its_members(spark):
    """A chain of texts, each with the next word: neighbours link, all are one component."""
    words = [f"w{i}" for i in range(700)]
    rows = [(k, " ".join(words[k:k + 200])) for k in range(400)]
    got = found(spark, rows)
    assert {c for _, _, c in got} == {"0"} and len(got) == 400


def test_long_texts_are_read_in_pieces(monkeypatch):
    whole = ngram_join.Grams(3).of(LONG)
    monkeypatch.setattr(ngram_join, "PIECE_BYTES", 50)
    assert np.array_equal(whole, ngram_join.Grams(3).of(LONG)) and len(whole) == len(shingles(LONG))


def test_order_of_columns_depends_on_counts(spark):
    docs = documents(spark, ["a b c d"] * 40 + ["e f g"])
    levels = ngram_join.sketch(docs.select("text"), 3, 12)
    assert sorted(levels[levels > 0].tolist()) == [1, 6, 6]


def test_empty_table(spark):
    assert ngram_join.similar_sets(documents(spark, []), cells=12).collect() == []


def test_near_copies_below_the_threshold_make_few_pairs(spark, monkeypatch):
    """Copies that share nine columns with each other and link with none: nearly every pair is ruled out before it is a row."""
    made = []
    pairs = ngram_join._pairs

    def counted(*args):
        out = pairs(*args)
        made.append(out.count())
        return out

    monkeypatch.setattr(ngram_join, "_pairs", counted)
    words = [f"w{k}" for k in range(150)]
    rows = []
    for i in range(60):
        copy = list(words)
        copy[10 + i % 60], copy[80 + i % 55] = f"x{i}", f"y{i}"
        rows.append((i, " ".join(copy)))
    assert found(spark, rows) == expected(rows)
    assert sum(made) < 60 * 59 / 2 * 9 / 4  # each pair shares nine columns or so


def test_bit_maps_never_rule_out_a_link():
    draw = np.random.default_rng(3)
    for n in (5, 40, 148, 600, 4000):
        for apart in (0, 1, n // 30, n // 10):
            both = draw.integers(0, 1 << 63, n, dtype=np.uint64)
            a, b = both[:n - apart], both[apart:]
            found = np.unpackbits((ngram_join.bit_map(a) ^ ngram_join.bit_map(b)).view(np.uint8)).sum()
            assert found <= 2 * apart
