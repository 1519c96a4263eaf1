"""Prefix trie of conversations, with totals of every subtree by parallel tree contraction.

A node is a distinct sequence of first turns (role and text); conversations that begin with it are its members. Turns are
represented by two 64-bit hashes and nodes by the exclusive-or of their turns' hashes with their places (128 bits), so
texts leave the plan at once and a conversation of any length is scanned in many tasks (``order``).

Method: in each round all leaves are raked into their parents, and nodes with a single child that is no leaf are spliced
out, where their priority is below that of a neighbour that could be spliced too. Priorities are the trailing zeros of the
depth, then a hash: a chain halves with each round. What a spliced node adds on the way to its new parent is kept on the
edge of its child. A spliced node's total is its own sum plus its child's total, so going back through the rounds every
contracted node gets its total with one join per round. Rounds grow with the logarithm of the number of nodes; each is
written to the shared folder, so a lost executor repeats one round at most.

Cases: null roles and texts are empty; turns are ordered by turn (null first), ties by the hashes of role and text, so
repeated rows keep a defined place; rows without a conversation id belong to no conversation; an empty table gives no
rows, not even the root; other columns are not used. The digest of a node's ending members has to read their ids in
order: they are joined to chunks in many tasks, and one task streams the chunks of a node without holding them.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codesieve.llm.lineage import written
from codesieve.llm.order import running

#: Ids joined to one chunk of text.
CHUNK_IDS = 1 << 16


def turn_rows(conversations: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role",
              text: str = "text") -> DataFrame:
    """conv_id, nth (place of the turn, from 0), a and b (hashes of role and text), chars (code points of the text)."""
    said = [F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))]
    rows = conversations.select(
        F.col(conversation).cast("long").alias("conv_id"), F.col(turn).alias("turn"), F.xxhash64(F.lit(1), *said).alias("a"),
        F.xxhash64(F.lit(2), *said).alias("b"), F.length(said[1]).cast("long").alias("chars")).where("conv_id is not null")
    return written(running(rows, "conv_id", ["turn", "a", "b"]).drop("turn"), "turns")


def members_of(turns: DataFrame) -> DataFrame:
    """conv_id, n (number of turns)."""
    return turns.groupBy("conv_id").agg(F.count("*").alias("n"))


def shared_openings(turns: DataFrame, base: Column, opening: Column, most: int) -> tuple[DataFrame, DataFrame]:
    """Turns and members in which the first ``opening`` (an expression of conv_id, at most ``most``) turns of a
    conversation are replaced by those of conversation ``base``, as far as it has them."""
    heads = turns.where((F.col("nth") < most) & (F.col("conv_id") == base)) \
        .select(F.col("conv_id").alias("base"), "nth", "a", "b", "chars")
    sizes = heads.groupBy("base").agg(F.count("*").alias("has"))
    given = F.least(F.col("opening"), F.coalesce("has", F.lit(0).cast("long")))

    def based(rows: DataFrame) -> DataFrame:
        return rows.withColumn("base", base).withColumn("opening", opening.cast("long")).join(sizes, "base", "left")

    own = based(turns).where("nth >= opening").select("conv_id", (F.col("nth") - F.col("opening") + given).alias("nth"), "a", "b", "chars")
    members = written(based(members_of(turns)).select(
        "conv_id", "base", "opening", (given + F.greatest(F.col("n") - F.col("opening"), F.lit(0).cast("long"))).alias("n")), "members")
    opened = members.join(heads, "base").where("nth < opening").select("conv_id", "nth", "a", "b", "chars")
    return own.unionByName(opened), members.select("conv_id", "n")


def trie(turns: DataFrame, members: DataFrame) -> DataFrame:
    """Per node: node, parent (null: root), depth, conv_id (smallest member), parent_conv_id, n_convs, n_children, n_leaves
    (childless nodes in its subtree), saved_tokens (code points that its subtree stores once instead of per member) and
    ends_sha256 (of the ids of members that end here). Its last turn is turn ``depth`` of conversation conv_id.

    ``turns``: conv_id, nth (from 0), a, b, chars; ``members``: conv_id, n, also those without any turn.
    """
    hashed = turns.select("conv_id", "nth", "chars", F.xxhash64("nth", "a").alias("a"), F.xxhash64("nth", "b").alias("b"))
    keyed = hashed.withColumns({"own_a": F.col("a"), "own_b": F.col("b")}).withColumnRenamed("nth", "place")
    prefixes = written(running(keyed, "conv_id", ["place"], ("a", "b")).select(
        "conv_id", "a", "b", F.col("a").bitwiseXOR(F.col("own_a")).alias("up_a"), F.col("b").bitwiseXOR(F.col("own_b")).alias("up_b"),
        (F.col("nth") + 1).alias("depth"), "chars"), "prefixes")
    zero = F.lit(0).cast("long")
    root = members.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0").select(
        zero.alias("a"), zero.alias("b"), "conv_id", "n_convs", *(zero.alias(x) for x in ("depth", "chars")),
        *(F.lit(None).cast("long").alias(x) for x in ("up_a", "up_b")))
    nodes = prefixes.groupBy("a", "b").agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.first("depth").alias("depth"),
        F.first("chars").alias("chars"), F.first("up_a").alias("up_a"), F.first("up_b").alias("up_b"))
    nodes = written(nodes.unionByName(root).withColumn("node", F.monotonically_increasing_id()), "nodes")
    parents = nodes.select(F.col("a").alias("up_a"), F.col("b").alias("up_b"), F.col("node").alias("parent"),
                           F.col("conv_id").alias("parent_conv_id"))
    placed = nodes.join(parents, ["up_a", "up_b"], "left")
    kids = placed.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    tree = written(placed.join(kids, "node", "left").select(
        "node", "parent", "a", "b", "depth", "conv_id", "parent_conv_id", "n_convs", F.coalesce("n_children", zero).alias("n_children"),
        ((F.col("n_convs") - 1) * F.col("chars")).alias("saved")), "tree")
    totals = subtree_totals(tree.select("node", "parent", "depth", F.col("n_children").alias("kids"),
                                        (F.col("n_children") == 0).cast("long").alias("x"), F.col("saved").alias("y")))
    last = prefixes.groupBy("conv_id").agg(F.max_by(F.struct("a", "b"), "depth").alias("end"))
    ends = members.join(last, "conv_id", "left").select(
        F.coalesce("end.a", zero).alias("a"), F.coalesce("end.b", zero).alias("b"), "conv_id")
    return tree.join(totals, "node").join(digests(ends), ["a", "b"], "left").select(
        "node", "parent", "depth", "conv_id", "parent_conv_id", "n_convs", "n_children", F.col("x").alias("n_leaves"),
        F.col("y").alias("saved_tokens"), F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))


def subtree_totals(tree: DataFrame) -> DataFrame:
    """node, x and y summed over the subtree of each node. ``tree``: node, parent (null: root), depth, kids (number of
    children), x, y (long)."""
    zero = F.lit(0).cast("long")
    low = F.bit_count(F.col("depth").bitwiseAND(-F.col("depth")) - 1).cast("long")
    # what never is spliced has the highest priority
    priority = F.when(F.col("parent").isNull(), F.lit((1 << 63) - 1)).otherwise(
        F.shiftleft(low, 56) + F.xxhash64("node").bitwiseAND((1 << 56) - 1))
    state = written(tree.select("node", "parent", "kids", priority.alias("priority"), "x", "y", zero.alias("ex"), zero.alias("ey")), "alive")
    rounds: list[DataFrame] = []
    while not state.isEmpty():
        rounds.append(written(_contract(state), "contracted"))
        spliced = rounds[-1].where("child is not null").select(
            F.col("node").alias("parent"), F.col("parent").alias("grand"), (F.col("x") + F.col("ex")).alias("more_x"),
            (F.col("y") + F.col("ey")).alias("more_y"))
        state = written(rounds[-1].where("alive").join(spliced, "parent", "left").select(
            "node", F.coalesce("grand", "parent").alias("parent"), "kids", "priority", "x", "y",
            (F.col("ex") + F.coalesce("more_x", zero)).alias("ex"), (F.col("ey") + F.coalesce("more_y", zero)).alias("ey")), "alive")
    totals = None
    for done in reversed(rounds):
        raked = done.where("not alive and child is null").select("node", "x", "y")
        if totals is not None:
            spliced = done.where("child is not null").select("node", "child", F.col("x").alias("own_x"), F.col("y").alias("own_y"),
                                                             "child_ex", "child_ey")
            back = spliced.join(totals.withColumnRenamed("node", "child"), "child").select(
                "node", (F.col("own_x") + F.col("child_ex") + F.col("x")).alias("x"), (F.col("own_y") + F.col("child_ey") + F.col("y")).alias("y"))
            raked = raked.unionByName(back).unionByName(totals)
        totals = written(raked, "totals")
    return tree.select("node", "x", "y").where("false") if totals is None else totals


def _contract(state: DataFrame) -> DataFrame:
    """One round. alive: stays; else child tells spliced nodes (their only child, with what its edge bears) from raked."""
    leaf = F.col("kids") == 0
    below = state.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(
        F.sum(leaf.cast("long")).alias("gone"), F.sum(F.when(leaf, F.col("x") + F.col("ex")).otherwise(0)).alias("add_x"),
        F.sum(F.when(leaf, F.col("y") + F.col("ey")).otherwise(0)).alias("add_y"),
        F.max(F.when(~leaf, F.struct("node", "kids", "priority", "ex", "ey"))).alias("only"))
    above = state.select(F.col("node").alias("parent"), F.col("kids").alias("up_kids"), F.col("priority").alias("up_priority"))
    joined = state.join(below, "node", "left").join(above, "parent", "left")
    zero = F.lit(0).cast("long")
    spliced = F.col("parent").isNotNull() & (F.col("kids") == 1) & (F.coalesce("gone", zero) == 0) \
        & ((F.col("up_kids") != 1) | (F.col("up_priority") > F.col("priority"))) \
        & ((F.col("only.kids") != 1) | (F.col("only.priority") > F.col("priority")))
    marked = joined.withColumn("spliced", F.coalesce(spliced, F.lit(False)))
    chosen = F.col("spliced")
    return marked.select(
        "node", "parent", "priority", (F.col("kids") - F.coalesce("gone", zero)).alias("kids"), (F.col("x") + F.coalesce("add_x", zero)).alias("x"),
        (F.col("y") + F.coalesce("add_y", zero)).alias("y"), "ex", "ey", (~chosen & ~leaf).alias("alive"),
        F.when(chosen, F.col("only.node")).alias("child"), F.when(chosen, F.col("only.ex")).alias("child_ex"),
        F.when(chosen, F.col("only.ey")).alias("child_ey"))


def digests(ends: DataFrame) -> DataFrame:
    """a, b, ends_sha256: SHA-256 of the decimal conv_ids of each (a, b), ascending and joined by commas."""

    def runs(batches: Iterator[pa.RecordBatch]):
        """(key, ids) of neighbouring rows of one key, at most ``CHUNK_IDS`` at a time."""
        key, ids = None, []
        for batch in batches:
            for a, b, value in zip(*(c.to_pylist() for c in batch.columns[:3])):
                if (a, b) != key or len(ids) == CHUNK_IDS:
                    if ids:
                        yield key, ids
                    key, ids = (a, b), []
                ids.append(value)
        if ids:
            yield key, ids

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for (a, b), ids in runs(batches):
            out.append((a, b, ids[0], ",".join(map(str, ids))))
            if len(ids) > 1000 or len(out) == 4096:
                yield _batch(out, (pa.int64(), pa.int64(), pa.int64(), pa.string()), ("a", "b", "conv_id", "ids"))
                out = []
        if out:
            yield _batch(out, (pa.int64(), pa.int64(), pa.int64(), pa.string()), ("a", "b", "conv_id", "ids"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        key, sha, out = None, None, []
        for batch in batches:
            for a, b, chunk in zip(*(c.to_pylist() for c in batch.columns)):
                if (a, b) != key:
                    if key is not None:
                        out.append((*key, sha.hexdigest()))
                    key, sha = (a, b), hashlib.sha256(chunk.encode())
                else:
                    sha.update(b"," + chunk.encode())
            if out:
                yield _batch(out, (pa.int64(), pa.int64(), pa.string()), ("a", "b", "ends_sha256"))
                out = []
        if key is not None:
            yield _batch([(*key, sha.hexdigest())], (pa.int64(), pa.int64(), pa.string()), ("a", "b", "ends_sha256"))

    order = ["a", "b", "conv_id"]
    chunks = ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order) \
        .mapInArrow(join, "a long, b long, conv_id long, ids string")
    return chunks.repartition("a", "b").sortWithinPartitions(*order).select("a", "b", "ids") \
        .mapInArrow(digest, "a long, b long, ends_sha256 string")


def _batch(rows: list[tuple], types: tuple, names: tuple[str, ...]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=list(names))
