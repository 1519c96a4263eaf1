"""Licence scan (operator 9)."""

from pyspark.sql import functions as F

from brute import ODD_TEXTS, documents
from codesieve.llm import licenses


def dice(a, b):
    return 2 * len(a & b) / (len(a) + len(b)) if a or b else 0.0


def brute(rows, templates, threshold):
    out = []
    for doc, text in rows:
        for kind, position, unit in licenses.units(text or ""):
            scores = sorted((-dice(licenses.bigrams(unit), licenses.bigrams(t)), name) for name, t in templates.items())
            if -scores[0][0] >= threshold:
                out.append((doc, kind, position, scores[0][1], round(-scores[0][0], 9)))
    return sorted(out, key=str)


def test_scan_against_all_templates(spark):
    mit, isc = licenses.TEMPLATES["mit"], licenses.TEMPLATES["isc"]
    words = mit.split()
    texts = [*ODD_TEXTS, mit, "Copyright (c) 2020 A\n\n" + mit, mit.replace("Software", "Program"), isc.upper(),
             " ".join(words[:120]), "prose\n\nMore prose\n" + isc + "\n\nend", "Released under the MIT License.\nx",
             "x\nReleased under, the MIT license", "Copyright 2020\n  copyright 2021", mit + " " + mit]
    rows = list(enumerate(texts)) + [(3, mit), (3, mit), (None, isc)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("license", F.lit("clash"))
    for threshold in (0.5, 0.8):
        found = [(r.doc_id, r.unit, r.position, r.license, round(r.score, 9))
                 for r in licenses.scan(docs.repartition(3), threshold=threshold).collect()]
        assert sorted(found, key=str) == brute(rows, licenses.TEMPLATES, threshold)
        assert {"mit", "isc"} <= {f[3] for f in found}


def test_ties_take_the_first_name_and_empty_tables_give_nothing(spark):
    docs = documents(spark, ["one two three"])
    assert licenses.scan(docs, {"b": "one two three", "a": "One, two three!", "c": "x"}).first().license == "a"
    assert licenses.scan(documents(spark, [])).collect() == []
    assert licenses.scan(docs, {}).collect() == []
