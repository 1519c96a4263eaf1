"""Merkle manifest of a dataset: one tree of SHA-256 digests per source, one over all sources, and a proof per row.

A row's leaf is the digest of its fields, each ``-`` if null, else its length in UTF-8 bytes, ``:`` and its value. The leaves
of a source ascend by id. While a tree has several nodes, each run of ``FANOUT`` neighbours becomes the digest of their
hexadecimal digests; a lone node is the root of its tree. The sources' roots, in byte order of the source (null first),
make another such tree. A proof lists the other nodes of each run from the leaf up to the root.

Method: time-forward processing. Nodes are labelled by (last leaf below, height), so children come before their parents.
A sweep visits them in that order; a priority queue holds what has been sent to later nodes: children send their digests
to their parents. The reversed sweep starts at the root, and parents send each child the part of its proof above it. The
queue is external in two steps. Four levels of a tree, up to 65,536 nodes, are a block; a task sweeps whole blocks, and the
head of the queue in memory holds a few messages per level. What goes from one block to another is dealt out and sorted on
disk by Spark, as rows ordered by label. So trees of a billion rows need two passes in each direction, no task holds more
than a block, and a source with a third of all rows is thousands of blocks.

Cases: a null id comes first; rows equal in id go by their leaf (equal rows are equal in all results); null fields as
above, empty texts have length 0; a null source is a source of its own; an empty table gives no rows; clashing columns of
the input are not used, so they do not matter.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codesieve.llm.lineage import written
from codesieve.llm.order import running

FANOUT, LEVELS = 16, 4
BLOCK = FANOUT ** LEVELS
NODE = "tree string, nth long, digest binary, size long"
PATH = "array<struct<left:binary,right:binary>>"
_PATH = pa.list_(pa.struct([("left", pa.binary()), ("right", pa.binary())]))


def digest(parts: list[bytes]) -> bytes:
    """SHA-256, as hexadecimal text, of hexadecimal digests."""
    return hashlib.sha256(b"".join(parts)).hexdigest().encode()


def fold(leaf: bytes, path: list[tuple[bytes, bytes]]) -> bytes:
    """The root that a leaf and the nodes beside its path give."""
    for left, right in path:
        leaf = digest([left, leaf, right])
    return leaf


class Block:
    """The nodes of a block, given the digests of its lowest level in order; ``size`` nodes has the tree at that level."""

    def __init__(self, digests: list[bytes], size: int):
        self.levels = LEVELS if size > BLOCK else 0
        while size <= BLOCK and FANOUT ** self.levels < size:
            self.levels += 1
        self.nodes = {(0, i): x for i, x in enumerate(digests)}
        self.count = len(digests)

    @staticmethod
    def label(level: int, i: int) -> tuple[int, int]:
        return (i + 1) * FANOUT ** level - 1, level

    def top(self) -> bytes:
        """Forward sweep: every node sends its digest to its parent; the last one is the top of the block."""
        queue: list[tuple] = []

        def send(level: int, i: int, value: bytes) -> None:
            self.nodes[level, i] = value
            if level < self.levels:
                heapq.heappush(queue, (*self.label(level + 1, i // FANOUT), i // FANOUT, i, value))

        def settle(before: tuple[int, int] | None) -> None:
            while queue and (before is None or queue[0][:2] < before):
                end, level, i = queue[0][:3]
                parts = []
                while queue and queue[0][:3] == (end, level, i):
                    parts.append(heapq.heappop(queue)[4])
                send(level, i, digest(parts))

        for i in range(self.count):
            settle(self.label(0, i))
            send(0, i, self.nodes[0, i])
        settle(None)
        return self.nodes[self.levels, 0]

    def paths(self, above: list[tuple[bytes, bytes]]) -> Iterator[tuple[int, list[tuple[bytes, bytes]]]]:
        """Reversed sweep, after ``top``: every node sends its children their proofs; (place, path) of the lowest level."""
        queue: list[tuple] = [(tuple(-x for x in self.label(self.levels, 0)), 0, above)]
        while queue:
            (_, minus_level), i, path = heapq.heappop(queue)
            level = -minus_level
            if not level:
                yield i, path
                continue
            run = [k for k in range(i * FANOUT, (i + 1) * FANOUT) if (level - 1, k) in self.nodes]
            for k in run:
                beside = (b"".join(self.nodes[level - 1, x] for x in run if x < k), b"".join(self.nodes[level - 1, x] for x in run if x > k))
                heapq.heappush(queue, (tuple(-x for x in self.label(level - 1, k)), k, [beside, *path]))


def leaf_of(*fields: Column) -> Column:
    """The digest of the fields of a row, as hexadecimal text."""
    def part(x: Column) -> Column:
        text = x.cast("string")
        return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))

    return F.sha2(F.concat(*(part(x) for x in fields)), 256)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[tuple]]]:
    """(tree, block) and the rows of each block, from batches sorted by (tree, block); a block is bounded."""
    key, rows = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[:2] != key:
                if rows:
                    yield key, rows
                key, rows = row[:2], []
            rows.append(row[2:])
    if rows:
        yield key, rows


def _dealt(rows: DataFrame, *columns: str) -> DataFrame:
    """Rows (tree, block, nth, ...) in order of their labels, whole blocks together."""
    return rows.repartition("tree", "block").sortWithinPartitions("tree", "block", "nth").select("tree", "block", *columns)


def _packed(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], names=schema.names)


def tops(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Forward sweeps of trees (tree, nth, digest, size) -> the nodes that each sweep begins with, and (tree, digest) of the
    trees' roots."""
    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for (tree, block), rows in _blocks(batches):
            size = rows[0][1]
            out.append((tree, block, Block([x for x, _ in rows], size).top(), -(-size // BLOCK)))
            if len(out) == 4096:
                yield _packed(out, schema)
                out = []
        if out:
            yield _packed(out, schema)

    schema = pa.schema([("tree", pa.string()), ("nth", pa.int64()), ("digest", pa.binary()), ("size", pa.int64())])
    begun, roots = [], None
    while roots is None or not nodes.isEmpty():
        begun.append(nodes)
        block = F.floor(F.col("nth") / BLOCK).cast("long")
        swept = written(_dealt(nodes.withColumn("block", block), "digest", "size").mapInArrow(sweep, NODE), "tops")
        done = swept.where("size = 1").select("tree", "digest")
        roots = done if roots is None else roots.unionByName(done)
        nodes = swept.where("size > 1")
    return begun, roots


def _with_paths(nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """Rows of ``nodes`` and, first in its block, the path above each block: (tree, block, path) as a row of its own."""
    block = F.floor(F.col("nth") / BLOCK).cast("long")
    return nodes.withColumn("block", block).unionByName(paths.withColumn("nth", F.lit(-1).cast("long")), allowMissingColumns=True)


def paths_below(begun: list[DataFrame], roots: DataFrame) -> DataFrame:
    """Reversed sweeps but the last: tree, block and path above it, for the blocks of the first forward sweep.
    ``roots``: tree, path above its root."""
    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (tree, _), rows in _blocks(batches):
            above, first = rows[0][3], rows[1][0]
            block = Block([x for _, x, _, _ in rows[1:]], rows[1][2])
            block.top()
            path = [(x["left"], x["right"]) for x in above]
            yield _packed([(tree, first + i, [{"left": a, "right": b} for a, b in own]) for i, own in block.paths(path)], schema)

    schema = pa.schema([("tree", pa.string()), ("block", pa.int64()), ("path", _PATH)])
    ends = [x.select("tree", "size").distinct() for x in begun]
    paths = None
    for k in reversed(range(len(begun))):
        # the trees that end with this sweep begin with the path above their root
        last = roots.join(ends[k].where(F.col("size") <= BLOCK).select("tree"), "tree").select("tree", F.lit(0).cast("long").alias("block"), "path")
        now = last if paths is None else paths.unionByName(last)
        if not k:
            return now
        paths = written(_dealt(_with_paths(begun[k], now), "nth", "digest", "size", "path")
                        .mapInArrow(sweep, f"tree string, block long, path {PATH}"), "paths")


def manifest(docs: DataFrame, leaf: Column, id_column: str = "doc_id", source_column: str = "source", tampered: Column | None = None) -> DataFrame:
    """Per row: id, source, leaf, subroot, root, proof_sha256 (of the proof's digests in order), folded_root (from the proof
    and the tampered leaf, else the leaf) and verified (whether that is the root).

    ``leaf`` and ``tampered`` (null: unchanged) are expressions over ``docs``, see ``leaf_of``.
    """
    other = F.lit(None).cast("string") if tampered is None else tampered
    source = F.col(source_column).cast("string")
    # a null source sorts before all others
    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.coalesce(F.concat(F.lit("+"), source), F.lit("")).alias("tree"),
                       leaf.cast("binary").alias("digest"), other.cast("binary").alias("tampered"))
    leaves = running(rows, "tree", ["id", "digest"])
    sizes = leaves.groupBy("tree").agg(F.count("*").alias("size"))
    leaves = written(leaves.join(sizes, "tree"), "leaves")
    begun, subroots = tops(leaves.select("tree", "nth", "digest", "size"))
    subroots = written(subroots, "subroots")
    forest = running(subroots.select(F.lit("").alias("forest"), "tree", "digest"), "forest", ["tree"]).select("tree", "nth", "digest")
    forest = written(forest, "forest")
    top_nodes = forest.select(F.lit("").alias("tree"), "nth", "digest", F.lit(forest.count()).cast("long").alias("size"))
    top_begun, root = tops(top_nodes)
    found = root.first()
    if found is None:
        return _results(leaves, None)
    top = found["digest"]
    nothing = F.array().cast(PATH)
    above = paths_below(top_begun, root.select("tree", nothing.alias("path")))
    # the path above each source's root, by its place among the sources
    subpaths = written(_dealt(_with_paths(top_nodes, above), "nth", "digest", "size", "path")
                       .mapInArrow(_expand, f"nth long, path {PATH}"), "subpaths").join(forest.select("tree", "nth"), "nth").select("tree", "path")
    blocks = paths_below(begun, written(subpaths, "source-paths"))
    return _results(_with_paths(leaves, blocks.join(subroots.select("tree", F.col("digest").alias("subroot")), "tree")), bytes(top))


def _expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(nth, path) of every node of the blocks."""
    schema = pa.schema([("nth", pa.int64()), ("path", _PATH)])
    for _, rows in _blocks(batches):
        above, first = rows[0][3], rows[1][0]
        block = Block([x for _, x, _, _ in rows[1:]], rows[1][2])
        block.top()
        found = [(first + i, [{"left": a, "right": b} for a, b in own]) for i, own in block.paths([(x["left"], x["right"]) for x in above])]
        for low in range(0, len(found), 1024):
            yield _packed(found[low:low + 1024], schema)


def _results(rows: DataFrame, root: bytes | None) -> DataFrame:
    """The last reversed sweep: proofs reach the leaves."""
    schema = pa.schema([("id", pa.int64()), ("tree", pa.string()), ("leaf", pa.string()), ("subroot", pa.string()), ("root", pa.string()),
                        ("proof_sha256", pa.string()), ("folded_root", pa.string()), ("verified", pa.bool_())])

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for (tree, _), rows in _blocks(batches):
            _, _, _, above, _, _, subroot = rows[0]
            given = rows[1:]
            block = Block([r[1] for r in given], given[0][2])
            block.top()
            for i, path in block.paths([(x["left"], x["right"]) for x in above]):
                _, leaf, _, _, own_id, changed, _ = given[i]
                folded = fold(leaf if changed is None else changed, path)
                proof = hashlib.sha256(b"".join(x for pair in path for x in pair)).hexdigest()
                out.append((own_id, tree, leaf.decode(), subroot.decode(), root.decode(), proof, folded.decode(), folded == root))
                if len(out) == 4096:
                    yield _packed(out, schema)
                    out = []
        if out:
            yield _packed(out, schema)

    out = "id long, tree string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    if root is None:
        return rows.sparkSession.createDataFrame([], out).withColumn("source", F.col("tree")).drop("tree")
    return _dealt(rows, "nth", "digest", "size", "path", "id", "tampered", "subroot").mapInArrow(sweep, out) \
        .withColumn("source", F.when(F.col("tree") != "", F.substring("tree", 2, 1 << 30))).drop("tree")
