"""SimHash near-duplicates: 64-bit fingerprints of word shingles, linked by multi-index hashing.

Method: a fingerprint is cut into two segments of 32 bits. Two fingerprints at distance 2 or less differ in at most
one bit of one segment, so each fingerprint probes the table of each segment with the Hamming ball of radius 1
around its own value, and the matches are verified by their complete distance. A segment value that more than
``crowd`` different fingerprints share would give a pair for every two of them; its members and all fingerprints that
probe it are instead linked, equally exactly, through shared neighbours: two fingerprints are within distance 2 if and
only if some 64-bit value is within distance 1 of both, and at most 65 fingerprints are within 1 of a value. So rows
grow linearly with the fingerprints, and no link is lost. Copies share a fingerprint and count once.

Cases: a null or blank text has no shingle and fingerprint zero, linked like any other; fewer words than a shingle
give one shingle of all words; an empty table gives no rows; repeated rows and ids are kept, each with its own row;
null ids are kept and ignored by the smallest id of a component (null if it has no other); other columns stay unused.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codesieve.llm.components import components
from codesieve.llm.lineage import slices, written

CHUNK = 1 << 15
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprint(words: list[bytes], shingle: int = 3, seed: int = 42) -> int:
    """Bit k is set if more than half of the shingles' XXH64 have it set; zero without words."""
    from xxhash import xxh64_digest

    if not words:
        return 0
    n = max(len(words) - shingle + 1, 1)
    counts = np.zeros(64, np.int64)
    place = np.arange(7, -1, -1, dtype=np.int64) * 256  # digests are big-endian
    for low in range(0, n, CHUNK):
        part = words[low:low + CHUNK + shingle - 1]
        grams = zip(*(part[k:] for k in range(shingle))) if len(part) >= shingle else [part]
        digests = np.frombuffer(b"".join([xxh64_digest(b" ".join(g), seed) for g in grams]), np.uint8)
        cells = np.bincount((digests.reshape(-1, 8) + place).ravel(), minlength=2048)
        counts += (cells.reshape(8, 256) @ _BITS).ravel()
    return int.from_bytes(np.packbits(2 * counts > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, shingle: int = 3, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, text_hash and fp (the 64 bits as a signed long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            # bytes.lower folds A-Z alone, bytes.split cuts at ASCII white space alone
            values = [fingerprint((t or "").encode().lower().split(), shingle) for t in batch.column(1).to_pylist()]
            signed = np.array(values, np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(signed)],
                                             names=["doc_id", "text_hash", "fp"])

    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"),
                       F.xxhash64(text_column).alias("text_hash")) \
        .mapInArrow(run, "doc_id long, text_hash long, fp long")


def _segment_rows(fps: DataFrame, ball: bool) -> DataFrame:
    """(segment, value, fp): the own value of each 32-bit segment, with ``ball`` also its one-bit neighbours.

    Of two values that differ in one bit, the one without it probes the other, so only unset bits are flipped.
    """
    halves = F.array(F.col("fp").bitwiseAND(0xFFFFFFFF), F.shiftrightunsigned("fp", 32))
    rows = fps.select("fp", F.posexplode(halves).alias("segment", "value"))
    if not ball:
        return rows
    bits = F.array(*[F.lit(1 << k) for k in range(32)])
    value = F.col("value")
    flips = F.transform(F.filter(bits, lambda b: value.bitwiseAND(b) == 0), lambda b: value.bitwiseOR(b))
    return rows.select("fp", "segment", F.explode(F.concat(F.array(value), flips)).alias("value"))


def near_pairs(fps: DataFrame, crowd: int = 256) -> DataFrame:
    """Edges (a, b) whose components are those of all fingerprints within distance 2; ``fps`` are distinct."""
    table, probes, key = _segment_rows(fps, False), _segment_rows(fps, True), ["segment", "value"]
    crowded = written(table.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > crowd).select(key), "crowded")
    distance = F.bit_count(F.col("fp").bitwiseXOR(F.col("other")))
    pairs = probes.join(table.join(crowded, key, "left_anti").withColumnRenamed("fp", "other"), key) \
        .where((F.col("fp") != F.col("other")) & (distance <= 2)).select(F.col("fp").alias("a"), F.col("other").alias("b"))
    if crowded.isEmpty():
        return pairs
    fp = F.col("fp")
    around = F.concat(F.array(fp), F.transform(F.array(*[F.lit(1 << k if k < 63 else -(1 << 63)) for k in range(64)]),
                                               lambda b: fp.bitwiseXOR(b)))
    hubs = probes.join(crowded, key, "left_semi").select("fp").distinct().select("fp", F.explode(around).alias("hub"))
    # a value has at most 65 fingerprints around it
    shared = hubs.groupBy("hub").agg(F.min("fp").alias("a"), F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)
    return pairs.unionByName(shared.select("a", F.explode("fps").alias("b")).where("a <> b"))


def near_duplicates(docs: DataFrame, shingle: int = 3, crowd: int = 256, id_column: str = "doc_id",
                    text_column: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, text_hash, fp, fingerprint (16 hex digits), component (its smallest fingerprint)
    and component_id (smallest id reachable over links)."""
    marked = written(fingerprints(docs, shingle, id_column, text_column), "fingerprints")
    firsts = written(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    classes = components(near_pairs(firsts.select("fp"), crowd))
    named = firsts.join(classes.select(F.col("node").alias("fp"), "component"), "fp", "left") \
        .withColumn("component", F.coalesce("component", "fp"))
    smallest = named.groupBy("component").agg(F.min("first").alias("component_id"))
    ids = named.join(smallest, "component").select("fp", "component", "component_id")
    return marked.join(ids, "fp").select("doc_id", "text_hash", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0"))
                                         .alias("fingerprint"), "component", "component_id")


def keep_one(docs: DataFrame, shingle: int = 3, crowd: int = 256, id_column: str = "doc_id",
             text_column: str = "text") -> DataFrame:
    """``docs`` without near-duplicates: of each component the row with the smallest id (null: smallest of all), then
    text hash, stays; of rows equal in both, the one with the smallest hash over all columns."""
    found = near_duplicates(docs, shingle, crowd, id_column, text_column)
    best = found.groupBy("component").agg(F.min(F.struct("doc_id", "text_hash")).alias("best"))
    no_id = F.lit(-(1 << 63))
    kept = best.select(F.coalesce("best.doc_id", no_id).alias("id"), F.col("best.text_hash").alias("text_hash"))
    rows = docs.select(F.struct("*").alias("row"), F.coalesce(F.col(id_column).cast("long"), no_id).alias("id"),
                       F.xxhash64(text_column).alias("text_hash"))
    order = Window.partitionBy("id", "text_hash").orderBy(F.xxhash64("row"))
    return rows.join(kept, ["id", "text_hash"], "left_semi").withColumn("nth", F.row_number().over(order)) \
        .where("nth = 1").select("row.*")
