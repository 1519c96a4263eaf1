"""Prefix trie (operator 11) and running numbers in groups."""

import hashlib
import random
import zlib

from pyspark.sql import functions as F

from codesieve.llm import prefix_trie
from codesieve.llm.order import running

SCHEMA = "conv_id long, turn long, role string, text string"


def conversations(rows):
    """Turns (role, text) per conversation; no ties but equal rows."""
    found = {}
    for conv, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0)):
        found.setdefault(conv, []).append((role or "", text or ""))
    return found


def rebuilt(own):
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        # the remainder has the sign of the number
        base = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        out[c] = own.get(base, [])[:h] + turns[h:]
    return out


def nodes(turns):
    members = {}
    for c, said in turns.items():
        for d in range(len(said) + 1):
            members.setdefault(tuple(said[:d]), []).append(c)
    kids = {p: 0 for p in members}
    for p in members:
        if p:
            kids[p[:-1]] += 1
    leaves, saved = {p: 0 for p in members}, {p: 0 for p in members}
    for p, own in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += (len(own) - 1) * len(p[-1][1]) if p else 0
    out = []
    for p, own in members.items():
        ends = ",".join(str(c) for c in sorted(own) if len(turns[c]) == len(p))
        out.append((min(own), len(p), min(members[p[:-1]]) if p else None, len(own), kids[p], leaves[p], saved[p],
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def found(turns, members):
    return sorted((tuple(r) for r in prefix_trie.trie(turns, members).select(*COLUMNS).collect()), key=str)


def test_rebuilt_conversations(spark):
    rng = random.Random(1)
    rows = []
    for c in [0, 1, 2, 3, 99, 100, 101, 150, 199, 205, 206, 207, 299, 300, 301, -7, -100, -107, -200, 12345, 12300, 400, 401, 499]:
        rows += [(c, t, rng.choice(["user", "assistant", None]), rng.choice(["hi", "é", "", None, "more text"])) for t in range(rng.randrange(1, 9))]
    # the null turn is first, equal rows are turns of their own, a null conversation is none
    rows += [(500, None, "system", "first"), (500, 0, "user", "x"), (500, 0, "user", "x"), (None, 0, "user", "x"), (None, None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("nth", F.lit("clash")).withColumn("a", F.lit(1))
    number = F.col("conv_id")
    turns, members = prefix_trie.shared_openings(
        prefix_trie.turn_rows(docs.repartition(5)), base=number - number % 100, opening=F.crc32(number.cast("string")) % 6, most=5)
    want = nodes(rebuilt(conversations(rows)))
    assert any(depth == 0 for _, depth, *_ in want)
    assert found(turns, members) == want


def test_turnless_members_end_at_the_root(spark):
    # 205: its opening covers all its turns, and conversation 200 is absent
    c = next(c for c in range(201, 300) if zlib.crc32(str(c).encode()) % 6 >= 3)
    rows = [(c, t, "user", "x") for t in range(2)] + [(300, 0, "user", "y")]
    number = F.col("conv_id")
    turns, members = prefix_trie.shared_openings(
        prefix_trie.turn_rows(spark.createDataFrame(rows, SCHEMA)), number - number % 100, F.crc32(number.cast("string")) % 6, 5)
    got = found(turns, members)
    assert got == nodes(rebuilt(conversations(rows)))
    assert (c, 0, None, 2, 1, 1, 0, hashlib.sha256(str(c).encode()).hexdigest()) in got


def test_long_chains_and_wide_nodes(spark):
    rows = [(1, t, "user", f"turn {t}") for t in range(300)]
    rows += [(2, t, "user", f"turn {t}") for t in range(200)] + [(2, t, "user", f"other {t}") for t in range(200, 260)]
    rows += [(k, 0, "user", "turn 0") for k in range(10, 60)] + [(k, 0, "user", f"alone {k}") for k in range(60, 100)]
    turns = prefix_trie.turn_rows(spark.createDataFrame(rows, SCHEMA).repartition(7))
    assert found(turns, prefix_trie.members_of(turns)) == nodes(conversations(rows))


def test_random_trees(spark):
    """Totals of random trees, with chains between branching nodes."""
    rng = random.Random(4)
    parent = {0: None}
    for v in range(1, 700):
        parent[v] = v - 1 if rng.random() < 0.8 else rng.randrange(v)
    depth = {0: 0}
    for v in range(1, 700):
        depth[v] = depth[parent[v]] + 1
    kids = {v: 0 for v in parent}
    x = {v: rng.randrange(100) for v in parent}
    total = dict(x)
    for v in range(699, 0, -1):
        kids[parent[v]] += 1
        total[parent[v]] += total[v]
    tree = spark.createDataFrame([(v, parent[v], depth[v], kids[v], x[v], -x[v]) for v in parent],
                                 "node long, parent long, depth long, kids long, x long, y long")
    got = prefix_trie.subtree_totals(tree).collect()
    assert {r.node: (r.x, r.y) for r in got} == {v: (t, -t) for v, t in total.items()} and len(got) == 700


def test_digest_of_many_members(spark, monkeypatch):
    ends = spark.range(5000).select(F.when(F.col("id") % 2 == 0, 1).otherwise(F.col("id")).alias("a"), F.lit(2).cast("long").alias("b"),
                                    (F.col("id") * 7 - 100).alias("conv_id"))
    got = {r.a: r.ends_sha256 for r in prefix_trie.digests(ends.repartition(6)).collect()}
    ids = ",".join(str(i * 7 - 100) for i in range(0, 5000, 2))
    assert got[1] != got[3] and len(got) == 2500
    ones = ",".join(str(i) for i in sorted([i * 7 - 100 for i in range(0, 5000, 2)] + [7 - 100]))
    assert got[1] == hashlib.sha256(ones.encode()).hexdigest() and ids != ones


def test_empty_table(spark):
    turns = prefix_trie.turn_rows(spark.createDataFrame([], SCHEMA))
    assert found(turns, prefix_trie.members_of(turns)) == []


def test_running_numbers_over_several_tasks(spark):
    rows = [(g, k, k * 977 + g) for g, n in ((1, 5000), (2, 1), (3, 40), (9, 3000)) for k in range(n)]
    got = running(spark.createDataFrame(rows, "g long, k long, x long").repartition(9), "g", ["k"], ("x",)).collect()
    want, seen = {}, {}
    for g, k, x in rows:
        seen[g] = seen.get(g, 0) ^ x
        want[g, k] = (k, seen[g])
    assert {(r.g, r.k): (r.nth, r.x) for r in got} == want and len(got) == len(rows)
