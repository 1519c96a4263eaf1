"""Language identification (operator 3)."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from brute import LONG, ODD_TEXTS
from codesieve.llm import language as lang


@pytest.fixture(scope="module")
def model(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text", F.col("lang").alias("language"))
    return lang.fit(rows, sample_rows=40)


def mix(counts, names):
    return np.array([counts.get(k, 0) for k in range(len(names))], float)


def brute(rows, names, table, least=0.5):
    """Rows (text, declared, suffix, host) -> (language, posterior), from the formulas of the method."""
    evidence, best = [], []
    for text, *_ in rows:
        data = f" {(text or '').lower()} ".encode()
        if not any(c.isalpha() for c in text or ""):
            evidence.append(None)
            best.append(None)
            continue
        codes = lang.cells(np.frombuffer(data, np.uint8))
        total, n = table.astype(np.float32)[codes].sum(axis=0, dtype=np.float64), len(codes)
        weight = lang.TEMPER / (n + lang.TEMPER)
        if (total.max() + n * math.log(lang.CELLS)) * weight < math.log(lang.BACKGROUND_PRIOR):
            evidence.append(None)
            best.append(None)
            continue
        evidence.append(total * weight)
        best.append(int(np.argmax(evidence[-1])))
    count = {key: Counter((r[key], b) for r, b in zip(rows, best) if b is not None and r[key] is not None) for key in (1, 2, 3)}
    world_counts = mix(Counter(b for b in best if b is not None), names)

    def others(key, value, own):
        if value is None:
            return np.zeros(len(names))
        return mix({k: n for (v, k), n in count[key].items() if v == value}, names) - own

    out = []
    for row, e, b in zip(rows, evidence, best):
        if b is None:
            out.append((None, 0.0))
            continue
        own = np.eye(len(names))[b]
        world = (world_counts - own + 1) / (world_counts.sum() - 1 + len(names))
        suffix = others(2, row[2], own)
        suffix = (suffix + lang.HOST_WEIGHT * world) / (suffix.sum() + lang.HOST_WEIGHT)
        host = others(3, row[3], own)
        host = (host + lang.HOST_WEIGHT * suffix) / (host.sum() + lang.HOST_WEIGHT)
        logs = e + np.log(host)
        if row[1] is not None:
            logs = logs + np.log((others(1, row[1], own) + 1) / (world_counts - own + 2))
        p = 1 / sum(math.exp(x - logs.max()) for x in logs)
        out.append((names[int(np.argmax(logs))] if p >= least else None, p))
    return out


def test_evidence_is_fused_as_stated(spark, model):
    names, table = model
    documents = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(40).collect()
    rows = [(d.text[:12 + 7 * k], [d.lang, None, "xx", "en"][k % 4], ["fr", "de", None][k % 3], ["a.fr", "b.de", None, "c"][k % 4])
            for k, d in enumerate(documents)]
    rows += [(t, "en", "fr", "a.fr") for t in ODD_TEXTS] + [rows[0], rows[0], ("12 ,.", None, None, None)]
    table_ = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i long, text string, declared string, suffix string, host string")
    found = lang.identify_rows(table_.withColumn("row", F.struct("i")).repartition(3), names, table, 0.7).collect()
    got = {r.row.i: (r.language, r.posterior) for r in found}
    for i, (language, posterior) in enumerate(brute(rows, names, table, 0.7)):
        assert got[i][0] == language and math.isclose(got[i][1], posterior, rel_tol=1e-6, abs_tol=1e-9)


def test_accuracy_on_held_out_documents(spark, model):
    train = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text")
    test = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").join(train, "text", "left_anti")
    found = lang.identify_rows(test.select(F.col("lang").alias("row"), "text", *[F.lit(None).cast("string").alias(c) for c in (
        "declared", "suffix", "host")]), *model).collect()
    assert len(found) > 700 and sum(r.row == r.language for r in found) / len(found) > 0.98


def test_host_and_markup_decide_short_texts(spark, model):
    names, table = model
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("lang = 'de'").select("text").limit(20).collect()
    rows = [(d.text, "de", "https://News.Example.DE/x?y") for d in docs] + [("q", "de", "http://news.example.de:80/z"), ("q", None, None)]
    pages = spark.createDataFrame([(i, t, f'<html class="a" LANG="{d}-AT"><p>' if d else "<p>", u) for i, (t, d, u) in enumerate(rows)],
                                  "i long, text string, html string, url string").withColumn("row", F.lit("clash"))
    labelled = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text", F.col("lang").alias("language"))
    found = lang.identify(pages, labelled, declared=lang.declared_in("html"), host=lang.host_of("url"), sample_rows=40).collect()
    got = {r.row.i: r for r in found}
    assert got[20].language == "de"
    assert set(found[0].row.asDict()) == set(pages.columns)


def test_texts_of_no_known_language_are_rejected(spark):
    labelled = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text", F.col("lang").alias("language"))
    texts = ["Wczoraj poszliśmy do kina, a potem wróciliśmy do domu późnym wieczorem.", "xkcd qwrtz bcdfg hjklm npqrs tvwxz zxcvb",
             "Hyvää huomenta, kuinka voit tänään ystäväni, kysyi vanha mies hiljaa"]
    found = lang.identify(spark.createDataFrame([(t,) for t in texts], "text string"), labelled).collect()
    assert [r.language for r in found] == [None] * 3
    clean = lang.identify(labelled.drop("language"), labelled)
    assert clean.where("language is null").count() <= 0.005 * labelled.count()


def test_every_label_is_a_language(spark):
    """Also labels of one row, and more than any fixed number of them."""
    rng = random.Random(6)
    rows = [(" ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(30)), f"l{i:02d}") for i in range(80)]
    docs = spark.createDataFrame(rows, "text string, lang string")
    found = lang.identify(docs.select("text", F.col("lang").alias("expected")), docs.select("text", F.col("lang").alias("language"))).collect()
    assert sum(r.language == r.row.expected for r in found) >= 70


def test_nothing_to_learn_from(spark):
    none = spark.createDataFrame([(1, "some text", None), (2, None, None)], "i long, text string, lang string")
    assert [r.language for r in lang.identify(none, declared=F.col("lang")).collect()] == [None, None]
    assert lang.identify(none.limit(0), declared=F.col("lang")).collect() == []


def test_addresses_and_declarations(spark):
    rows = [("http://A.b.De:8/x",), ("https://u@h.fr?x",), ("nothing",), (None,), ("ftp:///x",)]
    urls = spark.createDataFrame(rows, "url string").select(lang.host_of("url").alias("h")).collect()
    assert [r.h for r in urls] == ["a.b.de", "h.fr", None, None, None]
    rows = [("<HTML data-x='1' xml:lang=FR>",), ("<html>",), ("<html lang='pt-BR'>",), (None,), (LONG,)]
    found = spark.createDataFrame(rows, "html string").select(lang.declared_in("html").alias("d")).collect()
    assert [r.d for r in found] == ["fr", None, "pt", None, None]
