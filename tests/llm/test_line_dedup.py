"""Line dedup (operator 5)."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from brute import ODD_TEXTS, documents
from codesieve.llm import line_dedup


def is_long(line):
    return len(line.split()) >= 3


def order(doc):
    return -1 if doc is None else doc


def brute(rows, least=5):
    """(id, lines left, number removed) of each row, all documents held in memory and lines compared as text. Ids are unique
    but for repeated rows."""
    texts = {order(d): t or "" for d, t in rows}
    lines = {d: [x.strip() for x in t.split("\n")] for d, t in texts.items()}
    at = {d: [k for k, x in enumerate(ls) if is_long(x)] for d, ls in lines.items()}
    longs = {d: [lines[d][k] for k in at[d]] for d in texts}

    def places(d):
        found = {}
        for width in (1, 2):
            for p in range(len(longs[d]) - width + 1):
                found.setdefault(tuple(longs[d][p:p + width]), []).append(p)
        return found

    def gap(d, p):
        ends = [-1, *at[d], len(lines[d])]
        return [k for k in range(ends[p] + 1, ends[p + 1])]

    held = {d: places(d) for d in texts}
    first = {}
    for d in sorted(texts):
        for key in held[d]:
            first.setdefault(key, d)
    gone = {}
    for d in texts:
        blocks, beside = [], []
        for a in {first[key] for key in held[d]} - {d}:
            sure, other = set(), set()
            for key, here in held[d].items():
                if first[key] == a:
                    there = held[a][key]
                    kind = sure if len(here) == len(there) == 1 else other
                    kind.update((p + j, q + j) for p, q in zip(here, there) for j in range(len(key)))
            match = line_dedup.patience(sure, other - sure)
            assert all(longs[d][p] == longs[a][q] for p, q in match.items())
            for p, q in match.items():
                run = {p}
                for step in (1, -1):
                    k = p
                    while match.get(k + step) == match[k] + step:
                        k += step
                        run.add(k)
                blocks.append(run)
                if len(run) == len(longs[d]) == len(longs[a]):
                    blocks[-1].add("whole")
                for side in (0, 1):
                    mine, theirs = gap(d, p + side), gap(a, q + side)
                    if [lines[d][k] for k in mine] == [lines[a][k] for k in theirs]:
                        beside.append((p, mine))
        merged = []
        for run in blocks:
            touching = [x for x in merged if x & run - {"whole"}]
            merged = [x for x in merged if not x & run - {"whole"}] + [run.union(*touching)]
        kept = [run for run in merged if "whole" in run or sum(len(longs[d][p].split()) for p in run) >= least]
        kept = set().union(*kept) - {"whole"}
        gone[d] = {at[d][p] for p in kept} | {k for p, ks in beside if p in kept for k in ks}
    out = []
    for d, t in rows:
        left = [x for k, x in enumerate(lines[order(d)]) if k not in gone[order(d)]]
        out.append((d, left if any(left) else [], len(gone[order(d)])))
    return sorted(out, key=str)


def run(spark, rows, least=5):
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("id", F.lit("clash")) \
        .withColumn("numbers", F.lit(1)).withColumn("row", F.lit(2)).withColumn("key", F.lit(3))
    found = line_dedup.delete_duplicate_lines(docs.repartition(3), min_block_words=least)
    assert found.columns == [*docs.columns, "removed_lines"]
    rows = found.collect()
    lefts = [(r.doc_id, [x.strip() for x in (r.text or "").split("\n")], r.removed_lines) for r in rows]
    return sorted(((d, x if any(x) else [], n) for d, x, n in lefts), key=str)


def left(spark, texts, least=5):
    return {d: lines for d, lines, _ in run(spark, list(enumerate(texts)), least)}


def test_blocks_short_lines_and_odd_rows(spark):
    block = "one line of words\nHead\nanother line of words\n\na third line here"
    rows = [(0, "start of all texts\n" + block + "\nend of it all"), (1, "other start it is\n" + block),
            (2, block + "\nnothing else like this"), (3, block), (3, block), (None, "null id has words\n" + block),
            (4, "a third line here\nsome words between them\none line of words"), (5, "short\nok\n\nshort"), (6, "short\nok"),
            (7, "  one line of words  \n\n"), *((10 + k, f"text number {k} here\nthis line is quite common") for k in range(12))]
    rows += [(100 + k, t) for k, t in enumerate([*ODD_TEXTS, *ODD_TEXTS])]
    for least in (1, 5, 12, 13):
        assert run(spark, rows, least) == brute(rows, least)


@pytest.mark.parametrize("seed", [2, 8, 9])
def test_random_documents(spark, seed):
    rng = random.Random(seed)
    pool = [f"{a} {b} line" for a, b in itertools.product("abcd", "hijkl")] + ["", "x", "Head", "this is a longer line"]
    rows = []
    for k in range(80):
        lines = rng.choices(pool, k=rng.randint(1, 9)) + [f"own words of {k}"] * rng.randint(0, 2)
        if rows and rng.random() < 0.6:
            copied = rng.choice(rows)[1].split("\n")
            low = rng.randrange(len(copied))
            at = rng.randint(0, len(lines))
            lines[at:at] = copied[low:low + rng.randint(1, 8)]
        rows.append((k, "\n".join(lines)))
    rows += rng.sample(rows, 3) + [(200 + k, rows[k][1]) for k in range(0, 80, 9)]
    for least in (5, 7):
        assert run(spark, rows, least) == brute(rows, least)


def test_exact_copies_become_empty(spark):
    texts = ["Intro\na longer line here\nShort\n\nb longer line here\nEnd", "only three words", "s s s\ns s s\ns s s", "a b c\nd\na b c\nx y z"]
    found = left(spark, [*texts, "own words up here", *texts, *texts])
    assert [found[k] for k in range(5, 13)] == [[]] * 8


def test_a_coincidence_is_no_block(spark):
    found = left(spark, ["words of the first\nthanks for your reading\nand more of it here",
                         "something else is here\nthanks for your reading",
                         "and more of it here again\nthanks for your reading\nwords of the first\nand another line",
                         "own line is here\nthanks for your reading\nand more of it here"])
    assert found[1] == ["something else is here", "thanks for your reading"]
    assert len(found[2]) == 4  # crossed single lines
    assert found[3] == ["own line is here"]  # two lines that follow each other in both


@pytest.mark.parametrize("holders", [2, 8, 9, 40])
def test_one_rule_however_many_hold_a_line(spark, holders):
    line = "a line of more than five words"
    found = left(spark, [*(f"text number {k} here\n{line}" for k in range(holders)), f"{line}\nx\n{line}\ny\n{line}"])
    assert found[0] == ["text number 0 here", line] and all(found[k] == [f"text number {k} here"] for k in range(1, holders))
    assert found[holders] == ["x", line, "y", line]  # as many places as the first holder has are aligned


def test_a_passage_split_among_first_holders(spark):
    # the lines of document 2 are held first by others, one by one; its pairs of lines are its own
    found = left(spark, ["p one two\nu u u", "q one two\nv v v", "p one two\nq one two\nw w w", "start is here\np one two\nq one two\nend is here"])
    assert found[3] == ["start is here", "end is here"]


def test_moved_blocks_go(spark):
    a, b = "first block line\nsecond block line", "third block line\nfourth block line\nfifth block line"
    assert left(spark, [f"{a}\nbetween them here\n{b}", f"{b}\nmy own words\n{a}"])[1] == ["my own words"]


def test_nothing_is_lost_from_the_corpus(spark):
    rows = [(k, "\n".join(f"words of a line {(k * j) % 17}" for j in range(6))) for k in range(30)]
    kept = {line for _, lines, _ in run(spark, rows) for line in lines}
    assert kept - {""} == {line for _, text in rows for line in text.split("\n")}


def test_rows_that_lose_nothing_keep_their_exact_text(spark):
    texts = [*ODD_TEXTS, " a b c \r\n\n x", "\n\n"]
    found = line_dedup.delete_duplicate_lines(documents(spark, texts)).collect()
    assert {r.doc_id: r.text for r in found} == dict(enumerate(texts))


def test_a_column_of_the_name_of_the_count_is_replaced(spark):
    docs = documents(spark, ["words of a line", "words of a line"]).withColumn("Removed_Lines", F.lit("given"))
    found = line_dedup.delete_duplicate_lines(docs)
    assert found.columns == ["doc_id", "text", "removed_lines"]
    assert {tuple(r) for r in found.collect()} == {(0, "words of a line", 0), (1, "", 1)}


def test_patience():
    assert line_dedup.patience({(0, 0), (1, 1), (2, 2)}, set()) == {0: 0, 1: 1, 2: 2}
    assert line_dedup.patience({(0, 1), (1, 0)}, set()) == {0: 1, 1: 0}
    # a repeated line is matched beside a sure one before it is matched elsewhere
    assert line_dedup.patience({(5, 5)}, {(6, 6), (6, 0), (1, 6)}) == {5: 5, 6: 6}
    assert line_dedup.patience(set(), set()) == {}


def test_empty_table(spark):
    assert line_dedup.delete_duplicate_lines(documents(spark, [])).collect() == []
