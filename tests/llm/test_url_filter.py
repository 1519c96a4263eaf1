"""URL filter (operator 7)."""

import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from codesieve.llm import url_filter as u
from codesieve.llm.queries import URL_RULES


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    tail = rest[cut:]
    end = min((tail.find(c) for c in "?#" if c in tail), default=len(tail))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    return host, tail[:end]


def rule_of(host, path, rules):
    fits = [r for r in rules if (host == r.split("/", 1)[0] or host.endswith("." + r.split("/", 1)[0]))
            and path.startswith("/" + r.split("/", 1)[1])]
    return max(fits, key=len, default=None)


class Model:
    """Witten-Bell chain over characters, straight from the counts of one class."""

    def __init__(self, urls, order):
        self.order, self.next = order, defaultdict(Counter)
        for url in urls:
            text = u.START * order + url + u.END
            for i in range(order, len(text)):
                for k in range(order + 1):
                    self.next[text[i - k:i]][text[i]] += 1

    def probability(self, context, char):
        p = 1 / 65536
        for k in range(self.order + 1):
            seen = self.next.get(context[len(context) - k:])
            if seen:
                p = (seen[char] + len(seen) * p) / (seen.total() + len(seen))
        return p


def score(url, allow, block, order):
    text = u.START * order + url + u.END
    logs = [round((math.log(allow.probability(text[i - order:i], text[i])) - math.log(block.probability(text[i - order:i], text[i]))) * 1e9)
            for i in range(order, len(text))]
    return sum(logs) / len(logs) / 1e9


def brute(rows, rules, folds, order):
    """(page_id, host, path, rule, score) per row; folds: fold of each url."""
    out, label = [], {}
    for page, url in rows:
        host, path = parts(url)
        rule = rule_of(host, path, rules)
        out.append((page, url, host, path, rule))
        label[url or ""] = rules.get(rule)
    count = Counter(url or "" for _, url in rows)
    train = [x for x in count.elements() if label[x] and folds[x]]
    allow, block = (Model([x for x in train if label[x] == name], order) for name in ("allow", "block"))
    return [(*r[:1], *r[2:], None if r[4] else score(r[1] or "", allow, block, order)) for r in out]


@pytest.fixture(scope="module")
def pages(spark):
    given = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "url").collect()
    rows = [(r.page_id, r.url) for r in given]
    rows += [(1000 + k, x) for k, x in enumerate([
        None, "", "no scheme", "http://", "HTTP://EXAMPLE.ORG", "x://a.Example.ORG/es/1?q#f", "x://example.org/en/1/2", "x://notorg/", "x://org?/x",
        "http://a.com/de/://b.org/", "http://ÄÖ.org/é", "http://b.net/fr/" + "x" * 400, "http://b.com#/fr/", "://c.com/fr/", "a://b\n.com/fr/x"])]
    return rows + [(2000, rows[0][1]), (2000, rows[0][1]), (None, rows[1][1])]


def test_scores_and_rules_against_plain_models(spark, pages):
    table = spark.createDataFrame(pages, "page_id long, url string").withColumn("label", F.lit("clash")).withColumn("n", F.lit(1))
    texts = spark.createDataFrame([(x or "",) for _, x in pages], "url string").distinct()
    folds = {r.url: r.f for r in texts.select("url", F.pmod(F.xxhash64("url"), F.lit(u.FOLDS)).alias("f")).collect()}
    found = u.judge(table.repartition(3), URL_RULES, order=3).collect()
    expected = brute(pages, URL_RULES, folds, 3)
    assert sorted(str((r.page_id, r.host, r.path, r.rule)) for r in found) == sorted(str(e[:4]) for e in expected)
    wanted = {(e[1], e[2]): e[4] for e in expected if e[3] is None and e[2]}
    assert all(math.isclose(r.score, wanted[r.host, r.path], abs_tol=1e-6) for r in found
               if r.rule is None and sum((e[1], e[2]) == (r.host, r.path) for e in expected) == 1 and r.path)
    assert all(r.verdict == URL_RULES[r.rule] for r in found if r.rule)
    open_ = [r for r in found if not r.rule]
    assert len(open_) > 10 and min(r.score for r in open_ if r.verdict == "allow") > max(
        (r.score for r in open_ if r.verdict == "block"), default=-99)


def test_models_tell_classes_apart(spark):
    rows = [(k, f"http://good{k}.org/fr/page{k}") for k in range(60)] + [(100 + k, f"http://x{k}.example.org/es/sale?id={k}") for k in range(60)]
    rows += [(300 + k, f"http://good{k + 7}.net/fr/page{k}") for k in range(20)] + [(400 + k, f"http://x{k}.example.net/es/sale?id={k}") for k in range(20)]
    found = {r.page_id: r.verdict for r in u.judge(spark.createDataFrame(rows, "page_id long, url string"), URL_RULES).collect()}
    assert all(found[300 + k] == "allow" and found[400 + k] == "block" for k in range(20))


def test_without_labels_and_empty(spark):
    rows = [(1, "http://a.net/x"), (2, "http://b.org/x"), (3, None)]
    found = {r.page_id: (r.verdict, r.score) for r in u.judge(spark.createDataFrame(rows, "page_id long, url string"), URL_RULES).collect()}
    assert found == {1: ("allow", None), 2: ("allow", None), 3: ("allow", None)}
    assert u.judge(spark.createDataFrame([], "page_id long, url string"), URL_RULES).collect() == []
