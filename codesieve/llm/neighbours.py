"""Approximate nearest neighbours by a permutation index.

Method: every vector is represented by its ``posted`` nearest pivots in order of distance. The index is a written table
of segments; a segment holds the vectors of up to ``SEGMENT`` entries and an inverted file per pivot, which lists
the entries that have it among their nearest pivots and its place there. A query walks the files of its own
``walked`` nearest pivots and adds up how much each entry falls below the greatest footrule distance (a pivot missing in
one of two lists counts as the place after its last). The best ``share`` of each segment, ``least`` at least, are ranked again by exact
Euclidean distance, and the nearest of all segments are the result.

Pivots are a bounded sample of the different vectors: those ``pivots`` of them with the smallest hash. All different
vectors are indexed. Copies are one entry; an entry lists its ``k + 1`` smallest ids, which is all that a list of
``k`` neighbours can show, since equal distances are broken by smaller id. Queries go against the index in blocks of
``BLOCK``; a task emits ``k + 1`` entries and their ties per query and segment.

Vectors of the given table have nearly 64 independent dimensions: the ten nearest of a vector are hardly nearer than
the rest, and short lists lose them (12 of 1,000 pivots: recall 0.3). 128 of 256 pivots posted, 64 walked and a share
of 0.15 reach 0.96 of 2,000 vectors, 0.99 of 10,000 and 1.00 of 51,000; ``tests/llm`` measures recall against brute
force.

Cases: vectors that are null, zero, of another dimension than ``dimension`` (default: the most frequent one, smaller
first) or hold null or non-finite components take no part, neither as query nor as candidate; null ids likewise;
repeated ids with different vectors are entries of their own; fewer candidates than ``k``: all of them; empty table:
no rows; other columns are not used.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codesieve.llm.lineage import new_path, written

SEGMENT, BLOCK = 4096, 4096
INDEX = "segment long, entries binary, vectors binary, starts binary, members binary, places binary"
FOUND = "query long, entry long, score double"


def usable(vectors: DataFrame, id_column: str, vector_column: str, dimension: int | None) -> DataFrame:
    """vec_id, vector (double) of the rows that take part."""
    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"),
                          F.col(vector_column).cast("array<double>").alias("vector"))
    good = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) \
        & F.exists("vector", lambda x: x != 0)
    rows = rows.where(F.col("vec_id").isNotNull() & F.coalesce(good, F.lit(False)))
    if dimension is None:
        found = rows.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").first()
        dimension = found["d"] if found else 1
    return rows.where(F.size("vector") == dimension)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def permutations(vectors: np.ndarray, pivots: np.ndarray, posted: int) -> np.ndarray:
    """The ``posted`` nearest pivots of each vector, nearest first (ties: smaller pivot number)."""
    away = (pivots ** 2).sum(axis=1) - 2 * (vectors @ pivots.T)
    return np.argsort(away, axis=1, kind="stable")[:, :posted].astype(np.int32)


def index(entries: DataFrame, pivots: np.ndarray, posted: int) -> DataFrame:
    """The segments of the index over ``entries`` (entry, vector)."""

    def segment(number: int, entry: np.ndarray, vectors: np.ndarray) -> pa.RecordBatch:
        near = permutations(vectors, pivots, posted)
        order = np.argsort(near, axis=None, kind="stable")  # by pivot, then entry
        starts = np.searchsorted(near.ravel()[order], np.arange(len(pivots) + 1)).astype(np.int32)
        members, places = (order // posted).astype(np.int32), (order % posted).astype(np.int32)
        return pa.RecordBatch.from_arrays(
            [pa.array([number]), *(pa.array([x.tobytes()], pa.binary())
                                   for x in (entry, vectors, starts, members, places))],
            names=["segment", "entries", "vectors", "starts", "members", "places"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for low in range(0, batch.num_rows, SEGMENT):
                part = batch.slice(low, SEGMENT)
                yield segment(number, part.column(0).to_numpy().astype(np.int64), _matrix(part.column(1)))
                number += 1

    return entries.select("entry", "vector").mapInArrow(run, INDEX)


def search(segments: DataFrame, queries: tuple[np.ndarray, np.ndarray], pivots: np.ndarray, posted: int, walked: int, k: int,
           share: float, least: int) -> DataFrame:
    """query, entry, score: the nearest entries found in each segment for a block of queries (numbers, vectors)."""
    numbers, asked = queries

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = permutations(asked, pivots, walked)
        for batch in batches:
            for row in batch.to_pylist():
                entries, starts = np.frombuffer(row["entries"], np.int64), np.frombuffer(row["starts"], np.int32)
                vectors = np.frombuffer(row["vectors"], np.float64).reshape(len(entries), -1)
                members, places = (np.frombuffer(row[c], np.int32) for c in ("members", "places"))
                to_end = (posted - places).astype(np.float64)
                out = []
                for number, vector, own in zip(numbers, asked, lists):
                    # a shared pivot takes twice the smaller distance to the end of the lists off the footrule
                    files = [(place, starts[pivot], starts[pivot + 1]) for place, pivot in enumerate(own.tolist())]
                    worth = np.concatenate([np.minimum(to_end[low:high], posted - place) for place, low, high in files])
                    met = np.concatenate([members[low:high] for _, low, high in files])
                    saved = np.bincount(met, worth, len(entries))
                    n = min(len(entries), max(least, int(np.ceil(share * len(entries)))))
                    near = np.argpartition(-saved, n - 1)[:n] if n < len(entries) else np.arange(len(entries))
                    away = np.sqrt(((vectors[near] - vector) ** 2).sum(axis=1))
                    edge = np.partition(away, k)[k] if n > k + 1 else np.inf
                    kept = away <= edge
                    out.append((np.full(kept.sum(), number), entries[near[kept]], away[kept]))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)],
                                                     names=["query", "entry", "score"])

    return segments.mapInArrow(run, FOUND)


def nearest(vectors: DataFrame, is_query: Column, k: int = 10, pivots: int = 256, posted: int = 128, walked: int = 64,
            share: float = 0.15, least: int = 128, dimension: int | None = None, id_column: str = "vec_id",
            vector_column: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest other rows found for each row that ``is_query`` (of vec_id)."""
    spark = vectors.sparkSession
    rows = usable(vectors, id_column, vector_column, dimension).withColumn("h", F.xxhash64("vector"))
    # one entry per different vector; its number is fixed once the table is written
    entries = written(rows.select("h", "vector").distinct().withColumn("entry", F.monotonically_increasing_id()), "entries")
    numbered = written(rows.join(entries, ["h", "vector"]).select("vec_id", "entry").distinct(), "entry-ids")
    # the k + 1 smallest ids: first of each of many salted parts, then of all
    salted = Window.partitionBy("entry", F.pmod(F.xxhash64("vec_id"), F.lit(64))).orderBy("vec_id")
    members = numbered.withColumn("nth", F.row_number().over(salted)).where(F.col("nth") <= k + 1) \
        .withColumn("nth", F.row_number().over(Window.partitionBy("entry").orderBy("vec_id"))) \
        .where(F.col("nth") <= k + 1).select("entry", "vec_id")
    asked = numbered.where(is_query).select(F.col("vec_id").alias("query_id"), F.col("entry").alias("query"))

    sample = np.array([r.vector for r in entries.orderBy("h", "entry").limit(pivots).select("vector").collect()])
    posted = min(posted, len(sample))
    path = new_path(spark, "found")
    spark.createDataFrame([], FOUND).write.parquet(path)
    if len(sample):
        segments = written(index(entries, sample, posted), "segments")
        stream = asked.select(F.col("query").alias("entry")).distinct().join(entries, "entry") \
            .select("entry", "vector").toLocalIterator()
        while block := [r for _, r in zip(range(BLOCK), stream)]:
            queries = np.array([r.entry for r in block], np.int64), np.array([r.vector for r in block])
            search(segments, queries, sample, posted, min(walked, posted), k, share, least).write.mode("append").parquet(path)
    found = spark.read.schema(FOUND).parquet(path)
    # k + 1 nearest entries and their ties hold the k nearest rows other than the query
    ranked = found.withColumn("place", F.rank().over(Window.partitionBy("query").orderBy("score"))).where(F.col("place") <= k + 1)
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return asked.join(ranked, "query").join(members, "entry").where("vec_id <> query_id") \
        .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k) \
        .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
