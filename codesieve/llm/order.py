"""Running numbers and running exclusive-ors within groups of any size, as a scan in two levels.

Rows are dealt out by ranges of (group, order), so a group with a third of all rows lies in many tasks. Each task scans its
own rows; what a group has in earlier tasks is added from a table with at most one row per task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructType

from codesieve.llm.lineage import written


def running(rows: DataFrame, group: str, order: list[str], xors: tuple[str, ...] = ()) -> DataFrame:
    """``rows`` with nth (from 0, within ``group``, by ``order``, nulls first); the columns ``xors`` (long, not null) hold the
    exclusive-or of all rows of the group up to this one. ``group`` must not be null. Rows equal in ``order`` should be
    equal in all columns, since a repeated task may see them in another order."""
    keys = [F.col(group), *(F.col(x).asc_nulls_first() for x in order)]
    names = rows.columns
    out = StructType([*rows.schema.fields]).add("nth", LongType()).add("task", IntegerType())

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, last, count, sums = TaskContext.get().partitionId(), None, 0, [0] * len(xors)
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(names.index(group))
            new = np.ones(batch.num_rows, bool)
            new[1:] = pc.not_equal(keys[1:], keys[:-1]).to_numpy(zero_copy_only=False)
            new[0] = keys[0].as_py() != last
            place = np.arange(batch.num_rows)
            start = np.maximum.accumulate(np.where(new, place, -1))  # -1: the group began in an earlier batch
            nth = np.where(start < 0, place + count, place - start)
            columns = list(batch.columns)
            for k, name in enumerate(xors):
                at = names.index(name)
                total = np.bitwise_xor.accumulate(columns[at].to_numpy(zero_copy_only=False))
                before = np.where(start > 0, total[start - 1], np.where(start < 0, sums[k], 0))
                columns[at] = pa.array(total ^ before)
                sums[k] = int(total[-1] ^ before[-1])
            last, count = keys[-1].as_py(), int(nth[-1]) + 1
            yield pa.RecordBatch.from_arrays([*columns, pa.array(nth.astype(np.int64)), pa.array(np.full(len(nth), task, np.int32))],
                                             names=[*names, "nth", "task"])

    scanned = written(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(scan, out), "scanned")
    ends = scanned.groupBy(group, "task").agg(F.count("*").alias("n"), *(F.max_by(x, "nth").alias(x) for x in xors))
    earlier = Window.partitionBy(group).orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    # a task has at most one group that began in an earlier one
    carried = ends.select(group, "task", F.sum("n").over(earlier).alias("n_before"),
                          *(F.bit_xor(x).over(earlier).alias(f"{x}_before") for x in xors)).where("n_before is not null")
    joined = scanned.join(F.broadcast(carried), [group, "task"], "left")
    return joined.select(*(F.col(x).bitwiseXOR(F.coalesce(f"{x}_before", F.lit(0).cast("long"))).alias(x) if x in xors else F.col(x)
                           for x in names), (F.col("nth") + F.coalesce("n_before", F.lit(0).cast("long"))).alias("nth"))
