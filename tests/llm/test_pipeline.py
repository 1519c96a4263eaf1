"""The pipeline: stages against plain Python, decisions, odd tables."""

import zlib
from collections import Counter

import pytest
import public_tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from brute import ODD_TEXTS, as_bytes, classes, fingerprint
from test_decontamination import brute as contained
from test_line_dedup import brute as deduped
from test_tokens import whole

FOLDER = "/root/testdata/sf0.001"

@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Input of each stage, written and reread, and the last result."""
    docs, tables = spark.read.parquet(f"{FOLDER}/documents.parquet"), []
    extra = spark.createDataFrame([(100_000 + k, t, "en", "src1", 1) for k, t in enumerate(ODD_TEXTS)] + [(None, "some text of no id", None, None, None)] * 2,
                                  docs.schema)
    docs = docs.unionByName(extra).withColumn("id", F.lit("clash"))
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        tables.append(docs)
        path = f"{tmp_path_factory.mktemp('stage')}/{k}"
        stage(spark, docs, FOLDER).write.parquet(path)
        docs = spark.read.parquet(path)
    return [*tables, docs]


def rows(table):
    return [(r.doc_id, r.text) for r in table.select("doc_id", "text").collect()]


def key(x):
    return str(x)


def test_all_but_the_last_keep_the_columns(stages):
    assert [t.columns for t in stages[:5]] == [stages[0].columns] * 5


def test_language_keeps_what_can_be_told(stages):
    before, after = Counter(rows(stages[0])), Counter(rows(stages[1]))
    assert not after - before
    gone = (before - after).elements()
    assert all(not any(map(str.isalpha, t or "")) or d is None or d >= 100_000 for d, t in gone)
    assert all((d, t) in after for d, t in before if d is not None and d < 100_000)


def test_line_dedup_stage(stages):
    expected = [(d, lines) for d, lines, n in deduped(rows(stages[1])) if lines or not n]
    got = [(d, [x.strip() for x in (t or "").split("\n")]) for d, t in rows(stages[2])]
    assert sorted(((d, x if any(x) else []) for d, x in got), key=key) == sorted(expected, key=key)
    assert all(r.n_chars == len(r.text) for r in stages[2].where("doc_id < 100000").collect())


def test_one_of_each_group_stays(stages):
    before, after = rows(stages[2]), rows(stages[3])
    prints = {t: fingerprint(t) for _, t in before}
    root = classes(set(prints.values()), lambda a, b: (a ^ b).bit_count() <= 2)
    groups = {}
    for d, t in before:
        groups.setdefault(root[prints[t]], []).append(-1 if d is None else d)
    assert sorted(-1 if d is None else d for d, _ in after) == sorted(map(min, groups.values()))


def test_contaminated_documents_go(spark, stages):
    items = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").select("item_id", "text").collect()]
    before, after = rows(stages[3]), rows(stages[4])
    bad = {d for d, *_ in contained(before, items)}
    assert bad and sorted(after, key=key) == sorted(((d, t) for d, t in before if d not in bad), key=key)


def test_everything_left_is_packed(stages):
    texts = rows(stages[4])
    ids = whole(public_tokenizers.path("byte_bpe_50k.json"), [t for _, t in texts])
    expected = Counter(zlib.crc32((x + as_bytes([2]))[:4 * ((len(x) // 4 + 1) % 1024 or 1024)]) for x in ids)
    pieces = stages[5].collect()
    assert Counter(r.ids_crc32 for r in pieces if r.piece == 0) == expected
    assert sum(r.length for r in pieces) == sum(len(x) // 4 + 1 for x in ids)
    assert all(r.offset + r.length <= 1024 for r in pieces)


def test_run_is_the_stages_in_turn(spark):
    found = corpus_pipeline.run(spark, FOLDER)
    assert found.columns[:4] == ["doc_id", "piece", "start", "length"] and found.count() > 100


def test_stages_on_an_empty_table(spark):
    empty = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, FOLDER).collect() == []
