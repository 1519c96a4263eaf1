"""Best-fit packing: documents cut into pieces, pieces placed in as few sequences as possible.

Method: best-two-fit. A sequence is filled greedily with the largest piece that fits; then its smallest piece
is replaced by two unpacked pieces that fit the widened gap more tightly, if there are such. What can be
placed depends only on how many pieces of each length exist, so the plan is made on the histogram of lengths
(at most ``size`` numbers, whatever the corpus) and a filled sequence is repeated as often as its lengths last.
Each piece then finds its place by its rank among the pieces of its length; ranks come from counts per task and
length and their running sums, so no length, however frequent, is gathered in one task.

Cases: a null text is empty and gives one piece with the end id alone; an empty table gives no rows; rows
with equal ids are documents of their own; null ids stay null; other columns of the input are not used.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codesieve.llm.lineage import slices, written
from codesieve.llm.tokens import MEMO_BYTES, encoder

PIECES = ("doc_id long, piece int, start long, length int, ids binary, ids_crc32 long, "
          "task int, slot long")


def token_pieces(docs: DataFrame, tokenizer: str, spaces: str | None, end_id: int, size: int,
                 id_column: str = "doc_id", text_column: str = "text", memo_bytes: int = MEMO_BYTES) -> DataFrame:
    """Encode every text, add the end id and cut what is longer than ``size``; only the first piece may be shorter.

    ``task`` and ``slot`` number the pieces of one length within a task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, task, seen = encoder(tokenizer, spaces, memo_bytes), TaskContext.get().partitionId(), [0] * (size + 1)
        end = np.array([end_id], dtype="<u4").tobytes()
        for part in slices(batches, 256):
            out: list[list] = [[] for _ in range(8)]
            for doc, ids in zip(part.column(0).to_pylist(), coder.encode(part.column(1).to_pylist())):
                ids += end
                n = len(ids) // 4
                first = n % size or min(n, size)
                begins = [0, *range(first, n, size)]
                for k, begin in enumerate(begins):
                    length = first if k == 0 else size
                    own = ids[4 * begin:4 * (begin + length)]
                    for column, value in zip(out, (doc, k, begin, length, own, zlib.crc32(own), task, seen[length])):
                        column.append(value)
                    seen[length] += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary(),
                                                      pa.int64(), pa.int32(), pa.int64()))],
                names=["doc_id", "piece", "start", "length", "ids", "ids_crc32", "task", "slot"])

    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text")) \
        .mapInArrow(run, PIECES)


def largest(mask: int, most: int) -> int:
    """The largest set bit of ``mask`` up to ``most``, or 0; bit 0 is never set."""
    return max((mask & ((1 << (most + 1)) - 1)).bit_length() - 1, 0) if most > 0 else 0


def best_two_fit(counts: dict[int, int], size: int) -> list[tuple[int, list[int]]]:
    """Fillings (repeats, lengths in descending order) that use up all pieces of a histogram of lengths.

    Swaps can cost small pieces that later sequences need; the plan without them is taken if it is shorter.
    """
    plans = [_fill(counts, size, swap) for swap in (True, False)]
    return min(plans, key=lambda plan: sum(repeats for repeats, _ in plan))


def _fill(counts: dict[int, int], size: int, swap: bool) -> list[tuple[int, list[int]]]:
    left = {length: n for length, n in counts.items() if n}
    mask = sum(1 << length for length in left)
    plan = []
    while mask:
        free, used = mask, {}

        def take(length: int) -> None:
            nonlocal free
            used[length] = used.get(length, 0) + 1
            if used[length] == left[length]:
                free &= ~(1 << length)

        def put_back(length: int) -> None:
            nonlocal free
            used[length] -= 1
            free |= 1 << length

        gap = size
        while length := largest(free, gap):
            take(length)
            gap -= length
        if gap and swap:
            small = min(length for length, n in used.items() if n)
            wide, best = gap + small, (small, 0, 0)
            put_back(small)
            x = largest(free, wide - 1)
            while x and 2 * x > best[0]:
                pool = free if left[x] - used.get(x, 0) > 1 else free & ~(1 << x)
                y = largest(pool, min(x, wide - x))
                if y and x + y > best[0]:
                    best = (x + y, x, y)
                    if x + y == wide:
                        break
                x = largest(free, x - 1)
            for length in best[1:] if best[1] else (small,):
                take(length)
        used = {length: n for length, n in used.items() if n}
        repeats = min(left[length] // n for length, n in used.items())
        plan.append((repeats, [length for length in sorted(used, reverse=True) for _ in range(used[length])]))
        for length, n in used.items():
            left[length] -= repeats * n
            if not left[length]:
                mask &= ~(1 << length)
    return plan


def place_table(plan: list[tuple[int, list[int]]]) -> dict[str, np.ndarray]:
    """Per length and filling: first rank, first sequence, places per sequence and their first offset."""
    rows, taken, sequence = [], {}, 0
    for repeats, lengths in plan:
        offset = 0
        for length in dict.fromkeys(lengths):
            places = lengths.count(length)
            rows.append((length, taken.get(length, 0), sequence, places, offset))
            taken[length] = taken.get(length, 0) + repeats * places
            offset += length * places
        sequence += repeats
    table = np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)
    return dict(zip(("length", "rank", "sequence", "places", "offset"), table.T.copy()))


def pack(docs: DataFrame, tokenizer: str, spaces: str | None, end_id: int, size: int = 1024,
         id_column: str = "doc_id", text_column: str = "text", memo_bytes: int = MEMO_BYTES) -> DataFrame:
    """Pieces with their ids and places: doc_id, piece, start, length, ids, ids_crc32, sequence_id, offset.

    ``memo_bytes``: memory that a worker process keeps between tasks to encode equal words once."""
    pieces = written(token_pieces(docs, tokenizer, spaces, end_id, size, id_column, text_column, memo_bytes), "pieces")
    counts = pieces.groupBy("task", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    # at most ``size`` rows reach the driver
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    table = place_table(best_two_fit(histogram, size))

    @F.pandas_udf("sequence_id long, offset long")
    def placed(length, rank):
        import pandas as pd

        length, rank = length.to_numpy(np.int64), rank.to_numpy(np.int64)
        # ranks within a length are below 2^50, lengths below 2^13
        row = np.searchsorted(table["length"] << 50 | table["rank"], length << 50 | rank, side="right") - 1
        nth = rank - table["rank"][row]
        return pd.DataFrame({"sequence_id": table["sequence"][row] + nth // table["places"][row],
                             "offset": table["offset"][row] + nth % table["places"][row] * length})

    return pieces.join(bases, ["task", "length"]) \
        .withColumn("place", placed("length", F.col("base") + F.col("slot"))) \
        .select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids", "ids_crc32",
                "place.sequence_id", "place.offset")


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences: sequence_id, length, ids (little-endian unsigned 32-bit), spans of the documents.

    A group holds at most ``size`` tokens.
    """
    span = F.struct("offset", "doc_id", "piece", "start", "length", "ids")
    return packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(span)).alias("spans")).select(
        "sequence_id",
        F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["length"]).alias("length"),
        F.aggregate("spans", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"),
        F.transform("spans", lambda x: x.dropFields("ids")).alias("spans"))
