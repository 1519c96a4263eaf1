"""Encoding, packing (operator 1) and token records (operator 10)."""

import functools
import random
import zlib

import pytest
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from brute import LONG, ODD_TEXTS, as_bytes, documents
from codesieve.llm import packing, records, tokens

BYTE = public_tokenizers.path("byte_bpe_50k.json")
WORD = public_tokenizers.path("word_bpe_49k.json")


@functools.cache
def tokenizer(path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    return t


def whole(path, texts):
    t = tokenizer(path)
    return [as_bytes(e.ids) for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


@pytest.mark.parametrize("path,spaces", [(BYTE, tokens.LEADING), (WORD, tokens.DROPPED), (BYTE, None)])
def test_pieces_give_the_ids_of_whole_texts(path, spaces):
    assert tokens.encoder(path, spaces).encode(ODD_TEXTS) == whole(path, ODD_TEXTS)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from(" \n\t'ab.,1  \x1ćé<|>"), st.characters(codec="utf-8")),
                        max_size=25), max_size=5))
def test_pieces_on_random_texts(texts):
    for path, spaces in ((BYTE, tokens.LEADING), (WORD, tokens.DROPPED)):
        assert tokens.encoder(path, spaces).encode(texts) == whole(path, texts)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from(" \n,.!*<'_abTHEthéÉßÿ÷s1"), max_size=30), max_size=5))
def test_pieces_on_wordlike_texts(texts):
    for path, spaces in ((BYTE, tokens.LEADING), (WORD, tokens.DROPPED)):
        assert tokens.encoder(path, spaces).encode(texts) == whole(path, texts)


def test_pieces_on_the_given_documents():
    import pyarrow.parquet as pq

    texts = pq.read_table("/root/testdata/sf0.001/documents.parquet")["text"].to_pylist()
    for path, spaces in ((BYTE, tokens.LEADING), (WORD, tokens.DROPPED)):
        assert tokens.encoder(path, spaces).encode(texts) == whole(path, texts)


def test_memo_is_bounded():
    coder = tokens.PieceEncoder(BYTE, tokens.LEADING, memo_bytes=10_000)
    for k in range(5):
        texts = [f"w{k}x{i} z{i}" for i in range(50)]
        assert coder.encode(texts) == whole(BYTE, texts)
        assert coder.held < 40_000


def packed_rows(docs, size):
    return packing.pack(docs, BYTE, tokens.LEADING, 2, size).collect()


@pytest.mark.parametrize("size", [16, 1024])
def test_packing_covers_every_document_without_gaps(spark, size):
    texts = ODD_TEXTS + ["a b c d e"] * 40 + [" ".join("x" * (i % 13 + 1)) for i in range(80)]
    ids = {i: x + as_bytes([2]) for i, x in enumerate(whole(BYTE, texts))}
    docs = documents(spark, texts).withColumn("length", F.lit("clash")).withColumn("task", F.lit(None).cast("int"))
    rows = packed_rows(docs.repartition(5), size)
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
        assert r.ids_crc32 == zlib.crc32(bytes(r.ids)) and len(r.ids) == 4 * r.length
    assert by_doc.keys() == ids.keys()
    for doc, pieces in by_doc.items():
        pieces.sort(key=lambda r: r.piece)
        assert [r.piece for r in pieces] == list(range(len(pieces)))
        assert b"".join(bytes(r.ids) for r in pieces) == ids[doc]
        assert [r.start for r in pieces] == [sum(x.length for x in pieces[:k]) for k in range(len(pieces))]
        assert all(r.length == size for r in pieces[1:]) and pieces[0].length <= size
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= size
    total = sum(r.length for r in rows)
    assert len(by_sequence) <= -(-total // size) * 1.05 + 1


def test_packing_of_an_empty_table_and_sequences(spark):
    assert packed_rows(documents(spark, []), 16) == []
    found = packing.sequences(packing.pack(documents(spark, ["a b", None, "c " * 50]), BYTE, tokens.LEADING, 2, 16)).collect()
    assert sum(r.length for r in found) == sum(len(x) // 4 + 1 for x in whole(BYTE, ["a b", None, "c " * 50]))
    assert all(len(r.ids) == 4 * r.length == 4 * sum(s.length for s in r.spans) for r in found)


def first_fit_decreasing(counts, size):
    """Sequences that the usual greedy packing needs."""
    gaps = []
    for length in sorted(counts, reverse=True):
        for _ in range(counts[length]):
            k = next((k for k, gap in enumerate(gaps) if gap >= length), None)
            if k is None:
                gaps.append(size - length)
            else:
                gaps[k] -= length
    return len(gaps)


def test_plan_uses_each_piece_once_and_few_sequences():
    rng = random.Random(1)
    for size in (10, 64, 1024):
        for _ in range(20):
            counts = {rng.randint(1, size): rng.randint(1, 10 ** rng.randint(0, 1)) for _ in range(rng.randint(0, size))}
            plan, used = packing.best_two_fit(counts, size), {}
            for repeats, lengths in plan:
                assert sum(lengths) <= size and repeats > 0
                for x in lengths:
                    used[x] = used.get(x, 0) + repeats
            assert used == counts
            assert sum(r for r, _ in plan) <= first_fit_decreasing(counts, size) + 1


def test_two_for_one_swap_closes_a_gap():
    # greedy alone fills 6 + 3; the pair 2 + 2 in place of 3 closes the gap
    assert packing.best_two_fit({6: 1, 3: 1, 2: 2}, 10)[0] == (1, [6, 2, 2])


def test_records_round_trip(spark, tmp_path):
    texts = [*ODD_TEXTS, *ODD_TEXTS]
    docs = documents(spark, texts).withColumn("ids", F.lit(1)).union(
        spark.createDataFrame([(None, "null id", 0)], "doc_id long, text string, ids int"))
    path = f"file://{tmp_path}/records"
    records.write_token_records(docs.repartition(4), path, WORD, tokens.DROPPED, 1, id_bytes=2)
    expected = [as_bytes([]) + x + as_bytes([1]) for x in whole(WORD, ["null id", *texts])]
    rows = sorted(records.read_token_records(spark, path).collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    assert [bytes(r.ids) for r in rows] == expected
    assert [r.start for r in rows] == [sum(len(x) // 4 for x in expected[:k]) for k in range(len(rows))]
    one, other = (records.read_token_records(spark, path, shuffle_seed=s).collect() for s in (1, 2))
    assert sorted(map(str, one)) == sorted(map(str, rows)) == sorted(map(str, other)) and one != other


def test_records_of_an_empty_table(spark, tmp_path):
    path = f"file://{tmp_path}/none"
    records.write_token_records(documents(spark, []), path, WORD, tokens.DROPPED, 1)
    assert records.read_token_records(spark, path).collect() == []


def test_damaged_records_are_refused():
    data = bytearray(records.frame(b"payload") + records.frame(LONG.encode()))
    first, at = records.unframe(bytes(data), 0)
    assert first == b"payload" and records.unframe(bytes(data), at)[0] == LONG.encode()
    for place in (0, 9, 13, 20):
        broken = bytearray(data)
        broken[place] ^= 1
        with pytest.raises(ValueError):
            records.unframe(bytes(broken), 0)


def test_strings_of_added_tokens_are_what_the_library_makes_of_them(spark):
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|ENDOFTEXT|>y", "<| no token |>", "a <|startoftext|>b <|endoftext|>"]
    for path, spaces in ((BYTE, tokens.LEADING), (WORD, tokens.DROPPED)):
        assert tokens.PieceEncoder(path, spaces).encode(texts) == whole(path, texts)
    assert tokens.PieceEncoder(BYTE, tokens.LEADING).encode(["<|endoftext|>"]) == [as_bytes([50256])]


def test_a_second_write_comes_after_the_first(spark, tmp_path):
    path = f"file://{tmp_path}/twice"
    for first in (0, 100):
        records.write_token_records(documents(spark, ["one two", "three"], first), path, WORD, tokens.DROPPED, 1, id_bytes=2)
    rows = records.read_token_records(spark, path).orderBy("start").collect()
    assert [r.doc_id for r in rows] == [0, 1, 100, 101] and rows[2].start == sum(r.n_tokens for r in rows[:2])
    with pytest.raises(Exception, match="holds ids of 2 bytes"):
        records.write_token_records(documents(spark, ["x"]), path, WORD, tokens.DROPPED, 1, id_bytes=4)


def test_ids_that_are_too_wide_are_an_error():
    assert records.narrowed(as_bytes([1, 65535]), 2) == bytes([1, 0, 255, 255])
    with pytest.raises(ValueError, match="does not fit"):
        records.narrowed(as_bytes([70000]), 2)


def test_batches_are_cut_by_bytes_too():
    import pyarrow as pa

    from codesieve.llm.lineage import slices

    batch = pa.RecordBatch.from_arrays([pa.array(["x" * 1000] * 10 + ["y" * 100_000] + [None] * 5)], names=["t"])
    got = list(slices([batch, batch.slice(0, 0)], rows=8, most_bytes=3000))
    assert [t for part in got for t in part.column(0).to_pylist()] == batch.column(0).to_pylist()
    assert max(sum(len(t or "") for t in part.column(0).to_pylist()) for part in got if part.num_rows > 1) <= 3000
