"""Benchmark decontamination: documents that hold at least ``threshold`` of the word shingles of a test item.

Method: a size-partitioned MinHash search. A document may be a thousand times longer than an item, so a MinHash of
the whole document says nothing about the item (their Jaccard similarity is near zero, and no number of bands finds
it). Items are therefore partitioned by size (powers of two of their shingle count), and each partition has a window
length: the longest run of shingles that every item of it surely has left in one piece while at least ``threshold`` of
its shingles are shared, since each break of the item (a word put in, changed or left out, a part moved) costs at least
one shingle less than a shingle has words. Documents
and items are represented by the MinHashes of all their windows of that length: equal windows have equal MinHashes,
and neighbouring windows mostly share one, so a document gives about two values per window length. Matches are
candidates; they are verified by the exact share of the item's different shingles that the document has, compared as
strings.

What documents look up passes first through a bit map of the items' hashes, of fixed size (``2 ** BITS`` bits whatever
the tables), which lets through every hash that occurs in an item; only these are joined. With very many items the map
lets more through and the joins do more of the work; results stay the same.

Words are lower-cased runs of ASCII letters and digits and of non-ASCII characters; a text of fewer words than a
shingle has one shingle of all its words. Items of equal words are one item with the smallest item id.

Memory of a task: about 60 bytes per byte of the longest text.

Cases: null and blank items match nothing; null and blank documents hold nothing; repeated rows and ids: rows of one
document id are judged each by itself, and the best share counts; null ids are kept; empty tables give no rows; other
columns are not used.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codesieve.llm.lineage import written

BITS = 26
#: Texts are hashed together up to about so many bytes.
CHUNK_BYTES = 1 << 20

_SPACE = 32
_IS_WORD = np.zeros(256, bool)
_IS_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
_WORD_VALUE = np.where(_IS_WORD, np.arange(1, 257), 0).astype(np.uint64)
_BASE, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_WORD = re.compile("[a-z0-9\x80-\U0010ffff]+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def shingles_of(words: list[str], n: int) -> list[str]:
    return [" ".join(words[i:i + n]) for i in range(len(words) - n + 1)] or ([" ".join(words)] if words else [])


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    x = (x ^ (x >> np.uint64(32))) * _MIX
    return x ^ (x >> np.uint64(32))


def window_of(size: int, shingle: int, threshold: float) -> int:
    """The longest run of shingles in one piece in any item with 2^k <= shingles < 2^(k+1), k from ``size``."""
    low = 1 << (size.bit_length() - 1)

    def run(n: int) -> int:
        shared = int(np.ceil(threshold * n - 1e-9))
        # an inserted word breaks shingle - 1 of the item's shingles, fewer break none
        return -(-shared // ((n - shared) // max(shingle - 1, 1) + 1))

    return max(1, min(run(n) for n in range(low, 2 * low)))


class Hashes:
    """Words and shingles of several texts as arrays: where each begins and ends, which text it is of, its hash."""

    def __init__(self, texts: list[str], n: int):
        low = [t.lower().encode() for t in texts]
        data = np.frombuffer(b"\n".join(low), np.uint8)
        inside = _IS_WORD[data]
        edge = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).view(np.int8)))
        self.data, self.starts, self.ends = data, edge[0::2], edge[1::2]
        limits = np.cumsum([len(x) + 1 for x in low])
        self.text = np.searchsorted(limits, self.starts, side="right")
        if not len(self.starts):
            self.shingle, self.first, self.last, self.of = (np.zeros(0, t) for t in (np.uint64, int, int, int))
            return
        # polynomial hashes of the words, modulo 2^64
        powers = np.cumprod(np.full(int((self.ends - self.starts).max()), _BASE, np.uint64))
        span = self.ends - self.starts
        flat = np.repeat(self.starts - np.concatenate(([0], np.cumsum(span)[:-1])), span) + np.arange(span.sum())
        place = flat - np.repeat(self.starts, span)
        values = _WORD_VALUE[data[flat]] * powers[place]
        word = _mixed(np.add.reduceat(values, np.concatenate(([0], np.cumsum(span)[:-1]))))
        counts = np.bincount(self.text, minlength=len(texts))
        # short texts have one shingle of all their words, the others one at each word but the last n - 1
        begin = np.concatenate(([0], np.cumsum(counts)[:-1]))
        whole = np.flatnonzero((counts > 0) & (counts < n))
        full = np.flatnonzero(self.text[:len(word) - n + 1] == self.text[n - 1:]) if len(word) >= n else np.zeros(0, int)
        total = np.zeros(len(full), np.uint64)
        for k in range(n):
            total = total * _BASE + word[full + k]
        short = np.zeros(len(whole), np.uint64)
        for k in range(n - 1):
            more = counts[whole] > k
            short[more] = short[more] * _BASE + word[begin[whole[more]] + k] + np.uint64(1)
        first = np.concatenate((full, begin[whole]))
        last = np.concatenate((full + n - 1, begin[whole] + counts[whole] - 1))
        order = np.argsort(first, kind="stable")
        self.first, self.last = first[order], last[order]
        self.of, self.shingle = self.text[self.first], _mixed(np.concatenate((total, short)))[order]

    def minima(self, window: int) -> tuple[np.ndarray, np.ndarray]:
        """MinHash of every window of so many shingles of one text, and the text; runs of equal ones appear once."""
        if len(self.shingle) < window:
            return np.zeros(0, np.uint64), np.zeros(0, int)
        low, have = self.shingle, 1
        while have < window:
            step = min(have, window - have)
            low = np.minimum(low[:len(low) - step], low[step:])
            have += step
        of = self.of[:len(low)]
        good = of == self.of[window - 1:]
        low, of = low[good], of[good]
        new = np.ones(len(low), bool)
        new[1:] = (low[1:] != low[:-1]) | (of[1:] != of[:-1])
        # one family of values per window length
        return _mixed(low[new] + np.uint64(window)), of[new]

    def string(self, k: int) -> str:
        """Shingle ``k`` as its words, joined by spaces."""
        return " ".join(bytes(self.data[self.starts[w]:self.ends[w]]).decode() for w in range(self.first[k], self.last[k] + 1))


def chunks(column: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """Texts of a batch in chunks, with the row each chunk begins at; a longer text is a chunk of its own."""
    now, begin, size = [], 0, 0
    for row, text in enumerate(column):
        text = text.as_py() or ""
        if now and size + len(text) > CHUNK_BYTES:
            yield begin, now
            now, begin, size = [], row, 0
        now.append(text)
        size += len(text)
    if now:
        yield begin, now


def item_table(items: DataFrame, shingle: int, id_column: str, text_column: str) -> DataFrame:
    """item_id (smallest of equal items), words, n (different shingles)."""

    @F.pandas_udf("array<string>")
    def words(texts):
        return texts.map(words_of)

    worded = items.select(F.col(id_column).cast("long").alias("item_id"), words(F.coalesce(F.col(text_column), F.lit(""))).alias("words"))
    grams = F.when(F.size("words") < shingle, F.array(F.array_join("words", " "))).otherwise(F.transform(
        F.sequence(F.lit(1), F.greatest(F.size("words") - shingle + 1, F.lit(1))),
        lambda i: F.array_join(F.slice("words", i, shingle), " ")))
    return worded.where(F.size("words") > 0).groupBy("words").agg(F.min("item_id").alias("item_id")) \
        .select("item_id", F.array_join("words", " ").alias("text"), F.array_distinct(grams).alias("grams"), F.size(grams).alias("length")) \
        .withColumn("n", F.size("grams"))


def _bit_map(hashes: DataFrame) -> np.ndarray:
    """Bits of all hashes, as bytes; at most ``2 ** (BITS - 6)`` words come from the executors."""
    place = F.shiftrightunsigned("hash", 64 - BITS)
    rows = hashes.select(F.shiftrightunsigned(place, 6).alias("word"), place.bitwiseAND(63).cast("int").alias("bit")) \
        .groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits")).toPandas()
    words = np.zeros(1 << (BITS - 6), np.int64)
    words[rows["word"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64)
    return words.view(np.uint64)


def _hit(words: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    place = hashes >> np.uint64(64 - BITS)
    return words[place >> np.uint64(6)] >> (place & np.uint64(63)) & np.uint64(1) == 1


def contained(docs: DataFrame, items: DataFrame, threshold: float = 0.8, shingle: int = 5, doc_column: str = "doc_id",
              doc_text: str = "text", item_column: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, text_hash, item_id, shared, shingles, containment: per document and item it holds."""
    spark = docs.sparkSession
    known = written(item_table(items, shingle, item_column, item_text), "items")
    # sizes are powers of two: a few dozen at most
    sizes = [r.size for r in known.select(F.floor(F.log2("length")).cast("int").alias("size")).distinct().collect()]
    windows = {k: window_of(1 << k, shingle, threshold) for k in sizes}

    def item_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, kinds, values = [], [], []
            for item, text, length in zip(*(c.to_pylist() for c in batch.columns)):
                own = Hashes([text], shingle)
                low, _ = own.minima(windows[int(length).bit_length() - 1])
                for kind, found in (("window", low), ("shingle", own.shingle)):
                    found = np.unique(found).view(np.int64).tolist()
                    ids += [item] * len(found)
                    kinds += [kind] * len(found)
                    values += found
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(kinds, pa.string()), pa.array(values, pa.int64())],
                                             names=["item_id", "kind", "hash"])

    hashes = written(known.select("item_id", "text", "length").mapInArrow(item_hashes, "item_id long, kind string, hash long"), "item-hashes")
    window_bits = spark.sparkContext.broadcast(_bit_map(hashes.where("kind = 'window'")))
    shingle_bits = spark.sparkContext.broadcast(_bit_map(hashes.where("kind = 'shingle'")))
    lengths = sorted(set(windows.values()))

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_window, by_shingle = window_bits.value, shingle_bits.value
        for batch in batches:
            for begin, texts in chunks(batch.column(2)):
                own = Hashes(texts, shingle)
                found: dict[int, set[int]] = {}
                for length in lengths:
                    low, of = own.minima(length)
                    hit = _hit(by_window, low)
                    for text, value in zip(of[hit].tolist(), low[hit].view(np.int64).tolist()):
                        found.setdefault(text, set()).add(value)
                if not found:
                    continue
                held: dict[int, set[str]] = {}
                candidate = np.isin(own.of, list(found))
                for k in np.flatnonzero(candidate)[_hit(by_shingle, own.shingle[candidate])].tolist():
                    held.setdefault(int(own.of[k]), set()).add(own.string(k))
                rows = sorted(found)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(c).take(pa.array([begin + r for r in rows])) for c in (0, 1)]
                    + [pa.array([list(found[r]) for r in rows], pa.list_(pa.int64())),
                       pa.array([list(held.get(r, ())) for r in rows], pa.list_(pa.string()))],
                    names=["doc_id", "text_hash", "windows", "grams"])

    looked_up = written(docs.select(
        F.coalesce(F.col(doc_column).cast("long"), F.lit(-(1 << 63))).alias("doc_id"), F.xxhash64(doc_text).alias("text_hash"),
        F.col(doc_text).alias("text")).mapInArrow(look_up, "doc_id long, text_hash long, windows array<long>, grams array<string>"), "looked-up")
    key = ["doc_id", "text_hash"]
    candidates = looked_up.select(*key, F.explode("windows").alias("hash")) \
        .join(hashes.where("kind = 'window'").select("item_id", "hash"), "hash").select(*key, "item_id").distinct()
    # candidates first: only what a document shares with its own candidates is counted, at most its grams per candidate
    sought = candidates.join(known.select("item_id", "n", F.explode("grams").alias("gram")), "item_id")
    shared = looked_up.select(*key, F.explode("grams").alias("gram")).distinct().join(sought, [*key, "gram"]) \
        .groupBy(*key, "item_id").agg(F.count("*").alias("shared"), F.first("n").alias("n"))
    return shared.where(F.col("shared") >= F.lit(threshold) * F.col("n")).select(
        F.nullif("doc_id", F.lit(-(1 << 63))).alias("doc_id"), "text_hash", "item_id", "shared",
        F.col("n").cast("long").alias("shingles"), (F.col("shared") / F.col("n")).alias("containment"))


def without_contaminated(docs: DataFrame, items: DataFrame, threshold: float = 0.8, shingle: int = 5,
                         doc_column: str = "doc_id", doc_text: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no item."""
    bad = contained(docs, items, threshold, shingle, doc_column, doc_text).select(
        F.coalesce("doc_id", F.lit(-(1 << 63))).alias("id"), "text_hash").distinct()
    rows = docs.select(F.struct("*").alias("row"), F.coalesce(F.col(doc_column).cast("long"), F.lit(-(1 << 63))).alias("id"),
                       F.xxhash64(doc_text).alias("text_hash"))
    return rows.join(bad, ["id", "text_hash"], "left_anti").select("row.*")
