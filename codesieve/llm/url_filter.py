"""URL filter: rules first, then the ratio of two character language models for accepted and rejected URLs.

Rules: ``host/path`` fits a URL whose host is the rule's host or a subdomain of it and whose path starts with the
rule's path; the longest fitting rule wins (ties: the longer host, then the smaller text). Rules label URLs; all
labelled URLs of the table train the models, and the models judge the rest.

Models: variable-order Markov chains over characters. One row per character holds it with the ``order`` characters
before it; counts of all shorter contexts are sums over such rows, so one aggregation over the labelled URLs gives both
models at all orders. A context interpolates with the next shorter one (Witten-Bell): contexts that were never seen
have no weight and leave the shorter context's probability, which makes the order vary. Only windows that occur in
URLs to be judged are evaluated, each once, order by order, by joins of aggregated tables; nothing is collected or
broadcast. Windows that many URLs share are few rows on the model side, so a skewed join splits.

Calibration: URLs of one hash fold of the labelled ones (a fifth) take no part in training; the threshold on the mean
log-likelihood difference per character is the one with the largest balanced accuracy on that fold, found on a fixed
grid (of equal ones the middle of the widest stretch without URLs). Without accepted or without rejected URLs on either side of the split the threshold is 0, and without any
labelled URL of a class all others are allowed.

Cases: null URL or one without ``://``: empty host and path, no rule, and the models judge the text as it is (null:
empty); empty table: no rows; repeated rows keep one row each; other columns are not used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codesieve.llm.lineage import written

ALLOW, BLOCK = "allow", "block"
START, END = "\x02", "\x03"
#: Scores are differences of natural logarithms per character; the grid covers -GRID_LIMIT..GRID_LIMIT.
GRID_STEP, GRID_LIMIT = 0.005, 10.0
FOLDS = 5


def host_of(url: str | Column) -> Column:
    """After the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased; empty if there is none."""
    url = F.col(url) if isinstance(url, str) else url
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: str | Column) -> Column:
    """What follows the host up to ``? #`` or the end."""
    url = F.col(url) if isinstance(url, str) else url
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting_rule(host: Column, path: Column, rules: dict[str, str]) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, null if none does."""
    def parts(rule: str) -> tuple[str, str]:
        name, _, rest = rule.partition("/")
        return name, "/" + rest

    order = sorted(rules, key=lambda r: (-len(r), -len(parts(r)[0]), r))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text in reversed(order):
        name, start = parts(text)
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, rules[text]).otherwise(verdict)
    return rule, verdict


def windows(urls: DataFrame, order: int, *keep: str) -> DataFrame:
    """One row per character of ``url`` and its end: ``gram`` is the character after the ``order`` ones before it."""
    padded = F.concat(F.lit(START * order), F.col("url"), F.lit(END))
    grams = F.transform(F.sequence(F.lit(1), F.length("url") + 1), lambda i: F.substring(padded, i, F.lit(order + 1)))
    return urls.select(*keep, F.explode(grams).alias("gram"))


def _tail(gram: str, n: int) -> Column:
    return F.substring(F.col(gram), -n, n) if n else F.lit("")


def log_ratio(counts: DataFrame, wanted: DataFrame, order: int) -> DataFrame:
    """gram, ratio: log P(allow model) - log P(block model) of the last character of each wanted window, times 1e9.

    ``counts``: gram, allow, block over the training URLs; ``wanted``: distinct gram.
    """
    # the shortest context: the character alone, mixed with a uniform distribution over Unicode's planes in use
    uniform = F.lit(1.0 / (1 << 16))
    known = None
    for k in range(order + 1):
        seen = counts.groupBy(_tail("gram", k + 1).alias("gram")).agg(F.sum("allow").alias("allow"), F.sum("block").alias("block"))
        context = F.substring("gram", 1, k) if k else F.lit("")
        totals = seen.groupBy(context.alias("context")).agg(
            *[F.sum(c).alias(f"{c}_n") for c in (ALLOW, BLOCK)],
            *[F.count(F.when(F.col(c) > 0, 1)).alias(f"{c}_kinds") for c in (ALLOW, BLOCK)])
        now = wanted.select(_tail("gram", k + 1).alias("gram")).distinct().withColumn("context", context) \
            .join(seen, "gram", "left").join(totals, "context", "left")
        if known is None:
            now = now.withColumn("p_allow", uniform).withColumn("p_block", uniform)
        else:
            now = now.withColumn("shorter", _tail("gram", k)).join(
                known.withColumnRenamed("gram", "shorter"), "shorter")
        # (seen + kinds * shorter) / (total + kinds); an unseen context leaves the shorter one
        mixed = [F.coalesce((F.coalesce(F.col(c), F.lit(0)) + F.col(f"{c}_kinds") * F.col(f"p_{c}"))
                            / F.nullif(F.col(f"{c}_n") + F.col(f"{c}_kinds"), F.lit(0)), F.col(f"p_{c}")).alias(f"p_{c}")
                 for c in (ALLOW, BLOCK)]
        known = now.select("gram", *mixed)
    # whole numbers of 1e-9: their sums are exact in any order
    return known.select("gram", F.round((F.log("p_allow") - F.log("p_block")) * 1e9).cast("long").alias("ratio"))


def _threshold(scored: DataFrame) -> float:
    """The grid value that best parts the calibration URLs (label, score); at most a fixed number of cells is read."""
    cells = int(GRID_LIMIT / GRID_STEP)
    cell = F.greatest(F.lit(-cells), F.least(F.lit(cells), F.floor(F.col("score") / GRID_STEP))).cast("int")
    rows = scored.groupBy(cell.alias("cell")).agg(
        F.count(F.when(F.col("label") == ALLOW, 1)).alias("allow"), F.count(F.when(F.col("label") == BLOCK, 1)).alias("block")).collect()
    allow, block = sum(r.allow for r in rows), sum(r.block for r in rows)
    if not allow or not block:
        return 0.0
    rows.sort(key=lambda r: r.cell)
    best, below_allow, below_block = (-1.0, 0, 0.0), 0, 0
    for last, r in zip([None, *rows], rows):
        # everything before this cell is blocked; of equally good places the middle of the widest empty stretch
        gain = (allow - below_allow) / allow + below_block / block
        empty = r.cell - last.cell - 1 if last else 0
        best = max(best, (gain, empty, (r.cell - empty / 2) * GRID_STEP))
        below_allow, below_block = below_allow + r.allow, below_block + r.block
    return best[2]


def judge(pages: DataFrame, rules: dict[str, str], order: int = 5, id_column: str = "page_id",
          url_column: str = "url") -> DataFrame:
    """page_id, url, host, path, rule, verdict (allow or block), score (null where a rule decides)."""
    host, path = host_of("url"), path_of("url")
    rule, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    urls = pages.select(F.col(id_column).alias("page_id"), F.col(url_column).alias("url")) \
        .withColumn("host", host).withColumn("path", path).withColumn("rule", rule).withColumn("label", verdict)
    # judged by their text, once each; fold 0 of the labelled ones calibrates
    texts = written(urls.select(F.coalesce("url", F.lit("")).alias("url"), "label").groupBy("url", "label").agg(
        F.count("*").alias("n")).withColumn("fold", F.pmod(F.xxhash64("url"), F.lit(FOLDS))), "urls")
    train = texts.where(F.col("label").isNotNull() & (F.col("fold") != 0))
    counts = written(windows(train, order, "label", "n").groupBy("gram").agg(
        F.sum(F.when(F.col("label") == ALLOW, F.col("n")).otherwise(0)).alias("allow"),
        F.sum(F.when(F.col("label") == BLOCK, F.col("n")).otherwise(0)).alias("block")), "url-grams")
    known = counts.agg(F.max("allow"), F.max("block")).first()
    if not all(known):
        return urls.withColumn("verdict", F.coalesce("label", F.lit(ALLOW))).withColumn("score", F.lit(None).cast("double")) \
            .select("page_id", "url", "host", "path", "rule", "verdict", "score")
    open_texts = texts.where(F.col("label").isNull() | (F.col("fold") == 0))
    grams = windows(open_texts, order, "url", "label")
    ratios = written(log_ratio(counts, grams.select("gram").distinct(), order), "url-ratios")
    scores = written(grams.join(ratios, "gram").groupBy("url", "label").agg(
        (F.sum("ratio") / F.count("*") / 1e9).alias("score")), "url-scores")
    threshold = _threshold(scores.where(F.col("label").isNotNull()))
    open_scores = scores.where(F.col("label").isNull()).select(F.col("url").alias("text"), "score")
    return urls.withColumn("text", F.when(F.col("label").isNull(), F.coalesce("url", F.lit("")))).join(open_scores, "text", "left") \
        .withColumn("verdict", F.coalesce("label", F.when(F.col("score") >= threshold, ALLOW).otherwise(BLOCK))) \
        .select("page_id", "url", "host", "path", "rule", "verdict", "score")
