"""Line dedup: blocks of lines that a document shares with an earlier one are deleted from the later one.

Method: a line of at least ``min_words`` words is a long line. The keys of a document are the hashes (128 bits) of its long
lines and of its pairs of neighbouring long lines. Documents meet through the keys they share, each key leading to the
first document that holds it and to no other; so a key in a third of all rows costs one row per holder, and no key is too
frequent. A later document is aligned with each first holder by patience diff: keys that are unique in both are anchors, a
longest run of anchors in the order of both is matched and extended over equal neighbours, and what is left is aligned
again, so that moved blocks are found too. A key that one of them repeats is matched k-th place with k-th place.

Matched long lines that follow each other in both documents are a block; blocks of one later document that overlap are
joined. A block goes from the later document if it has ``min_block_words`` words or is all of both documents; shorter ones
are taken for coincidence and stay. Short and blank lines between two long lines (or at an end of the text) go with a block
beside them if all of them, in order, are there in the earlier document as well. One rule holds for all lines, however many
documents hold them. White space at the ends of a line is ignored. The first holder of a key keeps it.

Documents are ordered by id (null first), then by a hash of their text. All alignments compare the given texts, so the
result does not depend on the order of the work.

Cases: rows equal in id and text are one document for all comparisons, and each keeps the same text; a null text stays null; an empty
table gives no rows; a text without long lines stays; text that keeps no visible character becomes empty; other columns are kept
as they are, but for one named removed_lines, which is replaced.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codesieve.llm.lineage import slices, written

KEY = ["id", "text_hash"]


def patience(sure: set[tuple[int, int]], other: set[tuple[int, int]]) -> dict[int, int]:
    """Matched places (later: earlier) of two documents, from possible matches (later, earlier).

    ``sure`` come from keys unique in both and are the first anchors; ``other`` serve to extend them, and as anchors once
    no sure one is left. Each round matches a longest run of anchors that is in the order of both documents.
    """
    matched: dict[int, int] = {}
    used: set[int] = set()
    possible = sure | other

    def free(pair: tuple[int, int]) -> bool:
        return pair[0] not in matched and pair[1] not in used

    for rest in (sure, other):
        while rest := {x for x in rest if free(x)}:
            for anchor in _in_order(sorted(rest, key=lambda x: (x[0], -x[1]))):
                if not free(anchor):
                    continue
                matched[anchor[0]] = anchor[1]
                used.add(anchor[1])
                for step in (1, -1):
                    pair = anchor[0] + step, anchor[1] + step
                    while pair in possible and free(pair):
                        matched[pair[0]] = pair[1]
                        used.add(pair[1])
                        pair = pair[0] + step, pair[1] + step
    return matched


def _in_order(anchors: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """A longest part of the anchors (later, earlier), sorted by later place, in which earlier places increase."""
    tails, tail_of, back = [], [], []
    for k, (_, earlier) in enumerate(anchors):
        at = bisect_left(tails, earlier)
        back.append(tail_of[at - 1] if at else -1)
        tails[at:at + 1], tail_of[at:at + 1] = [earlier], [k]
    kept, k = [], tail_of[-1] if tail_of else -1
    while k >= 0:
        kept.append(anchors[k])
        k = back[k]
    return kept[::-1]


def _blocks(matched: dict[int, int]) -> Iterator[tuple[int, int]]:
    """First and last later place of each stretch of matches that follow each other in both documents."""
    first = last = None
    for place in sorted(matched):
        if last is not None and (place != last + 1 or matched[place] != matched[last] + 1):
            yield first, last
            first = None
        first, last = place if first is None else first, place
    if last is not None:
        yield first, last


def _gone(rows: list[dict], min_block_words: int) -> list[int]:
    """Numbers of the lines to delete from a later document, from the keys it shares with their first holders."""
    shape: dict[int, list[int]] = {}
    by_first: dict[tuple, list[dict]] = {}
    for r in rows:
        by_first.setdefault((r["first_id"], r["first_hash"]), []).append(r)
        if r["shape"]:
            shape.update((p, r["shape"][4 * k:4 * k + 4]) for k, p in enumerate(r["places"]))
    blocks, above, below = [], set(), set()
    for common in by_first.values():
        sure, other, same = set(), set(), {}
        for r in common:
            after, before = r["places"], r["before"]
            width = len(r["marks"]) // len(after) - 1  # 1 for a line, 2 for a pair
            kind = sure if len(after) == r["n_before"] == 1 else other
            for k, (p, q) in enumerate(zip(after, before)):
                at = (width + 1) * k
                alike = [r["marks"][at + j] == r["marks_before"][at + j] for j in range(width + 1)]
                for j in range(width):
                    kind.add((p + j, q + j))
                    same[p + j, q + j] = alike[j], alike[j + 1]
        matched = patience(sure, other - sure)
        total = common[0]["total"]
        for first, last in _blocks(matched):
            whole = last - first + 1 == total == common[0]["first_total"] and matched[first] == 0
            blocks.append((first, last, whole))
        for pair in matched.items():
            if same[pair][0]:
                above.add(pair[0])
            if same[pair][1]:
                below.add(pair[0])
    numbers: set[int] = set()
    joined: list[list] = []
    for first, last, whole in sorted(blocks):
        if joined and first <= joined[-1][1]:
            joined[-1][1:] = max(last, joined[-1][1]), whole or joined[-1][2]
        else:
            joined.append([first, last, whole])
    for first, last, whole in joined:
        if whole or sum(shape[p][1] for p in range(first, last + 1)) >= min_block_words:
            for p in range(first, last + 1):
                number, _, lines_above, lines_below = shape[p]
                numbers.update(range(number - (lines_above if p in above else 0),
                                     number + 1 + (lines_below if p in below else 0)))
    return sorted(numbers)


def _keys_of(text: str, min_words: int) -> tuple[dict[bytes, tuple[list, list, list]], int]:
    """By key: its places among the long lines, a mark (hash of the short lines) for each gap before, between and after its
    lines, and per place of a line its number, its words, and the short lines above and below. And how many long lines."""
    from xxhash import xxh3_64_intdigest, xxh3_128_digest

    hashes, numbers, words, gap, marks = [], [], [], [], []

    def close_gap() -> None:
        marks.append(xxh3_64_intdigest("\n".join(gap).encode()) - (1 << 63) if gap else 0)
        gap.clear()

    number = -1
    for number, line in enumerate(text.split("\n")):
        line = line.strip()
        n = len(line.split())
        if n >= min_words:
            hashes.append(xxh3_128_digest(line.encode()))
            numbers.append(number)
            words.append(n)
            close_gap()
        else:
            gap.append(line)
    close_gap()
    ends = [-1, *numbers, number + 1]
    found: dict[bytes, tuple[list, list, list]] = {}
    for p, key in enumerate(hashes):
        places, mark, shape = found.setdefault(key, ([], [], []))
        places.append(p)
        mark += marks[p:p + 2]
        shape += numbers[p], words[p], numbers[p] - ends[p] - 1, ends[p + 2] - numbers[p] - 1
        if p + 1 < len(hashes):
            places, mark, _ = found.setdefault(xxh3_128_digest(key + hashes[p + 1]), ([], [], []))
            places.append(p)
            mark += marks[p:p + 3]
    return found, len(hashes)


def _keys(docs: DataFrame, id_column: str, text_column: str, min_words: int) -> DataFrame:
    """One row per document and key of it, as ``_keys_of`` describes."""
    schema = "id long, text_hash long, key binary, total int, places array<int>, marks array<long>, shape array<int>"
    types = [pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int32())]
    names = ["id", "text_hash", "key", "total", "places", "marks", "shape"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out: list[list] = [[] for _ in names]
            for doc, text_hash, text in zip(*(c.to_pylist() for c in batch.columns)):
                found, total = _keys_of(text or "", min_words)
                for column, value in zip(out, (doc, text_hash)):
                    column += [value] * len(found)
                out[2] += found
                out[3] += [total] * len(found)
                for k in range(3):
                    out[4 + k] += [x[k] for x in found.values()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=names)

    return _keyed(docs, id_column, text_column).select("id", "text_hash", "text").mapInArrow(run, schema)


def _keyed(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """The rows with their document key; the null id is the smallest of all."""
    return docs.select(F.struct("*").alias("row"), F.col(text_column).alias("text"),
                       F.coalesce(F.col(id_column).cast("long"), F.lit(-(1 << 63))).alias("id"),
                       F.xxhash64(text_column).alias("text_hash"))


def duplicate_lines(docs: DataFrame, min_words: int = 3, min_block_words: int = 5, id_column: str = "doc_id",
                    text_column: str = "text") -> DataFrame:
    """id, text_hash, numbers: the numbers (from 0) of the lines to delete, per document that has any."""
    key = F.struct(*KEY)
    held = written(_keys(docs, id_column, text_column, min_words), "line-keys")
    # written, so that the joins below can broadcast them or split the rows of a hot key
    repeated = written(held.groupBy("key").agg(F.min(key).alias("first"), F.max(key).alias("last"))
                       .where("first <> last").drop("last"), "repeated-keys")
    shared = written(held.join(repeated, "key").withColumn("is_first", key == F.col("first")), "shared-keys")
    firsts = written(shared.where("is_first").groupBy("key").agg(F.any_value(F.struct(
        F.col("total").alias("first_total"), F.col("places").alias("before"), F.col("marks").alias("marks_before"))).alias("there")),
        "first-holders")
    # of a key that the first holder repeats, no more places than the later document has: its rows stay as small as its text
    aligned = shared.where("not is_first").join(firsts, "key").groupBy(*KEY).agg(F.collect_set(F.struct(
        F.col("first.id").alias("first_id"), F.col("first.text_hash").alias("first_hash"), "there.first_total", "total",
        "places", "marks", "shape", F.size("there.before").alias("n_before"),
        F.slice("there.before", 1, F.size("places")).alias("before"),
        F.slice("there.marks_before", 1, F.size("marks")).alias("marks_before"))).alias("keys"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids, hashes, numbers = [], [], []
            for doc, text_hash, rows in zip(*batch.columns):
                if gone := _gone(rows.as_py(), min_block_words):
                    ids.append(doc.as_py())
                    hashes.append(text_hash.as_py())
                    numbers.append(gone)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(hashes, pa.int64()), pa.array(numbers, pa.list_(pa.int32()))],
                names=["id", "text_hash", "numbers"])

    return aligned.mapInArrow(run, "id long, text_hash long, numbers array<int>")


def delete_duplicate_lines(docs: DataFrame, min_words: int = 3, min_block_words: int = 5, id_column: str = "doc_id",
                           text_column: str = "text") -> DataFrame:
    """``docs`` with the common blocks deleted from their texts, and removed_lines (how many) as the last column."""
    gone = written(duplicate_lines(docs, min_words, min_block_words, id_column, text_column), "duplicate-lines")
    # the lines left, in one pass over the text; rows that lose nothing skip it
    left = F.get(F.transform(F.array(F.split("text", "\n")), lambda lines: F.array_join(F.transform(
        F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("numbers")), lambda k: F.get(lines, k)), "\n")), 0)
    others = [F.col("row").getField(c) for c in docs.columns if c.lower() != "removed_lines"]
    return _keyed(docs, id_column, text_column).join(gone, KEY, "left").select(
        "row", "numbers", F.when(F.col("numbers").isNotNull(), left).otherwise(F.col("text")).alias("left")).select(
        F.col("row").withField(text_column, F.when(F.col("numbers").isNull() | F.col("left").rlike(r"\S"), F.col("left"))
                               .otherwise("")).alias("row"),
        F.coalesce(F.size("numbers"), F.lit(0)).alias("removed_lines")).select(
        *(c.alias(name) for c, name in zip(others, (x for x in docs.columns if x.lower() != "removed_lines"))), "removed_lines")
