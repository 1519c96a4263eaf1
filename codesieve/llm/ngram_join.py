"""N-gram Jaccard join: documents whose sets of word n-grams overlap by ``percent`` of their union or more.

Method: a blocked sparse matrix product. Rows of the incidence matrix are the different sets, columns are n-grams, in one
order for all documents: rare ones first. The first block holds of each set of n the ``n - ceil(t n) + 1`` rarest n-grams
(t: the threshold); two sets that reach it share one of them. The product of this block with itself accumulates overlap
counts of pairs; sizes bound what the other columns can add, and pairs that stay below the overlap their sizes ask for are
discarded. For the rest the other columns are multiplied too, which gives exact overlaps.

Only components are asked for, so links inside one are not sought again, and a group of copies never becomes all its pairs:

1. equal sets are one row;
2. each column of the first block pairs its members with its first one; overlaps are exact, and links join components;
3. the product runs over pairs of different components: in each column, members outside its most frequent component
   against the others. Columns inside one component, as those of near copies, drop out. Bit maps of whole sets bound their
   symmetric difference, so near copies that stay below the threshold are compared in their columns, but few become rows.

Rarity comes from a sketch of ``2 ** cells`` counters over all documents (each counts the n-grams of its hash range), as
logarithms in one byte: what is broadcast has that fixed size. The order decides how much work there is, never the result.

Words are runs of characters other than ASCII white space, A-Z lower-cased. N-grams are 64-bit hashes; sets meet only in
pairs, so of 10^9 compared pairs of 1,000 n-grams less than one in ten thousand holds a false match. Sets are equal if two
64-bit sums over them and their sizes are.

Cases: texts of fewer words than ``n`` are one n-gram of all of them; null and blank texts are empty and linked with nothing;
an empty table gives no rows; repeated rows and ids are kept, each with its row; null ids are kept and do not count as
smallest (null if a component has no other); other columns are not used. Texts are read a megabyte at a time; a task
holds 16 bytes per word of its longest text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codesieve.llm.components import components
from codesieve.llm.lineage import slices, written

#: Texts longer than this are split into words piece by piece.
PIECE_BYTES = 1 << 20
#: Counters per row in which sketches travel.
CHUNK = 1 << 12
_SPACE = re.compile(rb"[\x20\x09-\x0d]")
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _B
    x = (x ^ (x >> np.uint64(29))) * _A
    return x ^ (x >> np.uint64(32))


class Grams:
    """The distinct n-grams of texts, as sorted unsigned hashes."""

    def __init__(self, n: int):
        from xxhash import xxh64_digest

        self.n, self.hash = n, xxh64_digest

    def _words(self, data: bytes) -> np.ndarray:
        parts, low = [], 0
        while low < len(data):
            high = low + PIECE_BYTES
            if high < len(data):
                cut = _SPACE.search(data, high)
                high = cut.start() if cut else len(data)
            parts.append(np.frombuffer(b"".join(map(self.hash, data[low:high].split())), np.uint64))
            low = high
        return np.concatenate(parts) if parts else np.zeros(0, np.uint64)

    def of(self, text: str | None) -> np.ndarray:
        # bytes.lower folds A-Z alone, bytes.split cuts at ASCII white space alone
        words = self._words((text or "").encode().lower())
        if not len(words):
            return words
        size = min(self.n, len(words))
        grams = np.full(len(words) - size + 1, size, np.uint64)
        for k in range(size):
            grams = _mixed(grams * _A + words[k:len(words) - size + 1 + k])
        grams.sort()
        return grams[np.concatenate(([True], grams[1:] != grams[:-1]))]


def least_shared(n: int, percent: int) -> int:
    """Overlap that a set of ``n`` needs with any set to reach the threshold."""
    return -(-percent * n // 100)


def sketch(docs: DataFrame, n: int, cells: int) -> np.ndarray:
    """One byte per counter: the number of bits of how many n-grams fell into it, over all documents."""
    width = min(CHUNK, 1 << cells)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, found, held = Grams(n), np.zeros(1 << cells, np.uint32), []

        def add() -> None:
            np.add(found, np.bincount(np.concatenate(held), minlength=1 << cells), out=found, casting="unsafe")
            held.clear()

        size = 0
        for batch in slices(batches):
            for text in batch.column(0).to_pylist():
                held.append((grams.of(text) >> np.uint64(64 - cells)).astype(np.int64))
                size += len(held[-1])
                if size > 1 << 21:
                    add()
                    size = 0
        if held:
            add()
        rows = found.reshape(-1, width)
        used = np.flatnonzero(rows.any(axis=1))
        # a byte per counter where that is enough
        yield from _chunk_rows(used, [x.astype(np.uint8) if x.max() < 256 else x for x in rows[used]])

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                total.setdefault(chunk, np.zeros(width, np.uint64))
                total[chunk] += np.frombuffer(counts, np.uint8 if len(counts) == width else np.uint32)
        levels = [np.frexp(x.astype(np.float64))[1].astype(np.uint8) for x in total.values()]
        yield from _chunk_rows(np.array(list(total)), levels)

    rows = docs.mapInArrow(count, "chunk int, counts binary").repartition("chunk").mapInArrow(add_up, "chunk int, counts binary")
    levels = np.zeros((1 << cells) // width * width, np.uint8).reshape(-1, width)
    # as many bytes as there are counters
    for row in rows.collect():
        levels[row["chunk"]] = np.frombuffer(row["counts"], np.uint8)
    return levels.ravel()


def _chunk_rows(chunks: np.ndarray, counts) -> Iterator[pa.RecordBatch]:
    for low in range(0, len(chunks), 64):
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.asarray(chunks[low:low + 64]).astype(np.int32)), pa.array([x.tobytes() for x in counts[low:low + 64]], pa.binary())],
            names=["chunk", "counts"])


def incidence(docs: DataFrame, n: int, percent: int, levels: np.ndarray) -> DataFrame:
    """Per document: doc_id, n_shingles, sum_a, sum_b (over its set), a bit map of the set and its columns of the first block,
    in order; empty if the set can reach the threshold with no other. A column is the level of an n-gram, then the rest of
    its hash."""
    cells = len(levels).bit_length() - 1
    broadcast = docs.sparkSession.sparkContext.broadcast(levels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, levels = Grams(n), broadcast.value
        for batch in slices(batches):
            sizes, sums, others, maps, first = [], [], [], [], []
            for text in batch.column(1).to_pylist():
                own = grams.of(text)
                size = len(own)
                sizes.append(size)
                sums.append(int(own.sum(dtype=np.uint64)))
                others.append(int(_mixed(own).sum(dtype=np.uint64)))
                maps.append(bit_map(own))
                prefix = size - least_shared(size, percent) + 1
                # a set so small that one more n-gram breaks the threshold links with its equals alone
                if not size or 100 * size < percent * (size + 1):
                    first.append(np.zeros(0, np.int64))
                else:
                    column = columns(own, levels, cells)
                    first.append(np.sort(np.partition(column, prefix - 1)[:prefix]) if prefix < size else np.sort(column))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(np.array(sums, np.uint64).view(np.int64)),
                 pa.array(np.array(others, np.uint64).view(np.int64)), pa.array(maps, pa.list_(pa.int64())), pa.array(first, pa.list_(pa.int64()))],
                names=["doc_id", "n_shingles", "sum_a", "sum_b", "bits", "first"])

    return docs.mapInArrow(run, "doc_id long, n_shingles long, sum_a long, sum_b long, bits array<long>, first array<long>")


#: Words of the bit map of a set: a bit per n-gram, by hash.
MAP = tuple(f"map_{k}" for k in range(8))


def bit_map(grams: np.ndarray) -> np.ndarray:
    found = np.zeros(64 * len(MAP), bool)
    found[(grams & np.uint64(64 * len(MAP) - 1)).astype(np.int64)] = True
    return np.packbits(found, bitorder="little").view(np.int64)


def columns(grams: np.ndarray, levels: np.ndarray, cells: int) -> np.ndarray:
    """Places of n-grams in the order of columns, as signed longs."""
    level = levels[(grams >> np.uint64(64 - cells)).astype(np.int64)].astype(np.uint64)
    # 7 bits of level, 56 bits of hash; neighbours in the sketch differ in the upper bits, so those are mixed in
    return (level << np.uint64(56) | _mixed(grams) >> np.uint64(8)).view(np.int64)


def full_sets(docs: DataFrame, n: int, wanted: DataFrame) -> DataFrame:
    """node and grams (the whole set) of the sets in ``wanted`` (node, first_id, sum_a, sum_b, n_shingles), read from
    document first_id. The ids are looked up in a bit map of fixed size; what passes it by chance falls to the join."""
    bits = 26
    key = ["sum_a", "sum_b", "n_shingles"]
    place = F.shiftrightunsigned(F.xxhash64("first_id"), 64 - bits)
    # at most 2^20 words
    marks = wanted.select(F.shiftrightunsigned(place, 6).alias("word"), place.bitwiseAND(63).cast("int").alias("bit")) \
        .groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits")).toPandas()
    words = np.zeros(1 << (bits - 6), np.int64)
    words[marks["word"].to_numpy(np.int64)] = marks["bits"].to_numpy(np.int64)
    broadcast = docs.sparkSession.sparkContext.broadcast(words.view(np.uint64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, words = Grams(n), broadcast.value
        for batch in batches:
            at = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64) >> np.uint64(64 - bits)
            marked = words[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1) == 1
            for part in slices([batch.filter(pa.array(marked))], 128):
                sets = [grams.of(text) for text in part.column(1).to_pylist()]
                a = [int(x.sum(dtype=np.uint64)) for x in sets]
                b = [int(_mixed(x).sum(dtype=np.uint64)) for x in sets]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.array(a, np.uint64).view(np.int64)), pa.array(np.array(b, np.uint64).view(np.int64)),
                     pa.array([len(x) for x in sets], pa.int64()), pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64()))],
                    names=["sum_a", "sum_b", "n_shingles", "grams"])

    found = docs.select(F.xxhash64("doc_id"), "text").mapInArrow(run, "sum_a long, sum_b long, n_shingles long, grams array<long>")
    return written(found.dropDuplicates(key).join(wanted, key).select("node", "grams"), "whole")


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that reach the threshold, by exact overlaps over all columns."""
    left = sets.select(F.col("node").alias("a"), F.col("grams").alias("grams_a"))
    right = sets.select(F.col("node").alias("b"), F.col("grams").alias("grams_b"))
    both = F.size(F.array_intersect("grams_a", "grams_b"))
    return pairs.select("a", "b").join(left, "a").join(right, "b") \
        .select("a", "b", both.alias("both"), (F.size("grams_a") + F.size("grams_b")).alias("sizes")) \
        .where(F.col("both") * 100 >= (F.col("sizes") - F.col("both")) * percent).select("a", "b")


def ceiling(value, by: int):
    return F.floor((value + (by - 1)) / by)


def _possible(percent: int, common: Column):
    """Whether the overlap of a pair can still reach what its sizes (n_a, n_b) ask for, given how many columns of the first
    block it has in common (or a bound of that) and the last columns of their first blocks (last_a, last_b)."""
    def rest(size: str):
        return ceiling(F.col(size) * percent, 100) - 1

    # all columns up to the smaller last one belong to the block, so that set alone bounds what is to come
    bound = common + F.when(F.col("last_a") < F.col("last_b"), rest("n_a")).otherwise(rest("n_b"))
    return bound >= ceiling((F.col("n_a") + F.col("n_b")) * percent, 100 + percent)


#: Words of the marks of a set: a bit per column, by hash.
MARKS = ("mark_0", "mark_1", "mark_2", "mark_3")


def _marks(column: str) -> list[Column]:
    place = F.pmod(F.xxhash64(column), F.lit(64 * len(MARKS))).cast("int")
    return [F.coalesce(F.bit_or(F.when(F.floor(place / 64) == k, F.expr(f"shiftleft(1L, cast(pmod(xxhash64({column}), 64) AS INT))"))),
                       F.lit(0).cast("long")).alias(name) for k, name in enumerate(MARKS)]


def _most_common(one: str, other: str) -> Column:
    """A bound of the columns that a pair has in common: those of the one, less its marks that the other lacks."""
    lacking = [F.bit_count(F.col(f"{x}_{one}").bitwiseAND(F.bitwise_not(F.col(f"{x}_{other}")))) for x in MARKS]
    return F.col(f"times_{one}") - sum(lacking[1:], lacking[0])


def _sized(percent: int):
    """Whether the sizes and bit maps of a pair allow the threshold at all: a bit of one map alone is an n-gram of one set alone."""
    apart = [F.bit_count(F.col(f"{x}_a").bitwiseXOR(F.col(f"{x}_b"))) for x in MAP]
    return (F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent) \
        & (F.col("n_a") + F.col("n_b") - sum(apart[1:], apart[0]) >= 2 * ceiling((F.col("n_a") + F.col("n_b")) * percent, 100 + percent))


def _pairs(mixed: DataFrame, marked: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of sets of different components, once per column that they have in common, with sizes and last columns."""
    values = ("n", "last", "times", *MAP, *MARKS)
    rows_of = mixed.join(marked, "node")
    ones = rows_of.where("component <> most").select("column", *(F.col(x).alias(f"{x}_a") for x in ("node", "component", *values)))
    twos = rows_of.select("column", "most", *(F.col(x).alias(f"{x}_b") for x in ("node", "component", *values)))
    # most pairs are never made: their marks tell that they have too few columns in common
    return ones.join(twos, "column").where((F.col("component_a") != F.col("component_b")) & _sized(percent)
                                            & _possible(percent, F.least(_most_common("a", "b"), _most_common("b", "a")))
                                            & ((F.col("component_b") == F.col("most")) | (F.col("node_a") < F.col("node_b")))) \
        .select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b"),
                *(F.when(F.col("node_a") < F.col("node_b"), F.col(f"{x}_a")).otherwise(F.col(f"{x}_b")).alias(f"{x}_a") for x in ("n", "last")),
                *(F.when(F.col("node_a") < F.col("node_b"), F.col(f"{x}_b")).otherwise(F.col(f"{x}_a")).alias(f"{x}_b") for x in ("n", "last")))


def similar_sets(docs: DataFrame, n: int = 3, percent: int = 90, cells: int = 22, id_column: str = "doc_id",
                 text_column: str = "text") -> DataFrame:
    """Per row: doc_id, n_shingles, node (its set; null if empty), component (smallest node linked) and component_id (smallest
    id reachable over links)."""
    docs = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    key = ["sum_a", "sum_b", "n_shingles"]
    rows = written(incidence(docs, n, percent, sketch(docs.select("text"), n, cells)), "incidence")
    # equal sets have equal columns
    sets = written(rows.where("n_shingles > 0").groupBy(*key).agg(F.min("doc_id").alias("first_id"), F.first("bits").alias("bits"), F.first("first").alias("first"))
                   .withColumn("node", F.monotonically_increasing_id()), "sets")
    cell = sets.where(F.size("first") > 0).select("node", F.explode("first").alias("column"))
    several = cell.groupBy("column").agg(F.count("*").alias("members")).where("members > 1")
    shared = written(cell.join(several, "column"), "shared")
    times = shared.groupBy("node").agg(F.count("*").alias("times"), F.sum("members").alias("members"))
    sizes = written(sets.select("node", F.col("n_shingles").alias("n"), F.array_max("first").alias("last"),
                               *(F.get("bits", F.lit(k)).alias(x) for k, x in enumerate(MAP))).join(times, "node"), "sizes")
    shared = shared.drop("members")
    # the member whose first block is in the fullest columns is the likeliest to be in the middle of its copies
    middle = F.struct((-F.col("members") / (F.col("n") - ceiling(F.col("n") * percent, 100) + 1)).alias("empty"), "node")
    heads = shared.join(sizes, "node").groupBy("column").agg(F.min(middle).alias("head"))
    named = sets.select("node", "first_id", *key)

    def ends(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()

    def sized(pairs: DataFrame) -> DataFrame:
        """Pairs (a, b) with sizes, last columns and numbers of shared columns of both."""
        for side in ("a", "b"):
            pairs = pairs.join(sizes.select(F.col("node").alias(side), *(F.col(x).alias(f"{x}_{side}") for x in ("n", "last", "times", *MAP))), side)
        return pairs

    stars = sized(shared.join(heads, "column").where("node <> head.node").select(F.col("head.node").alias("a"), F.col("node").alias("b"))
                  .distinct())
    stars = written(stars.where(_sized(percent) & _possible(percent, F.least("times_a", "times_b"))).select("a", "b"), "stars")
    whole = full_sets(docs, n, named.join(ends(stars), "node"))
    links = written(_linked(stars, whole, percent), "links")
    labels = written(components(links), "labels")
    labelled = written(shared.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node")), "labelled")
    most = labelled.groupBy("column", "component").agg(F.count("*").alias("times")).groupBy("column").agg(
        F.max_by("component", F.struct("times", "component")).alias("most"), F.count("*").alias("components")).where("components > 1")
    mixed = written(labelled.join(most.select("column", "most"), "column"), "mixed")
    marked = written(mixed.groupBy("node").agg(F.count("*").alias("times"), *_marks("column"))
                     .join(sizes.drop("times", "members"), "node"), "marked")
    pairs = _pairs(mixed, marked, percent)
    counted = pairs.groupBy("a", "b").agg(F.count("*").alias("common"), *(F.first(x).alias(x) for x in ("n_a", "n_b", "last_a", "last_b")))
    left = written(counted.where(_possible(percent, F.col("common"))).select("a", "b"), "left")
    more = full_sets(docs, n, named.join(ends(left).join(whole.select("node"), "node", "left_anti"), "node"))
    across = written(_linked(left, whole.unionByName(more), percent), "links")
    classes = components(labels.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(across))
    labelled = sets.select(*key, "node", "first_id").join(classes, "node", "left").withColumn("component", F.coalesce("component", "node"))
    smallest = labelled.groupBy("component").agg(F.min("first_id").alias("component_id"))
    found = labelled.join(smallest, "component").select(*key, "node", "component", "component_id")
    return rows.join(found, key, "left").select(
        "doc_id", "n_shingles", "node", "component", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
