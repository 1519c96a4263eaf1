"""Language identification by fusing the evidence of text, declaration, address and host.

Method: naive Bayes over independent pieces of evidence, each of which may be missing:

* text: byte trigram likelihoods, per language, tempered for dependence between neighbouring trigrams;
* the declared language (of the markup, or of a metadata column): how often a language is declared so;
* the address: the language mix of its host, shrunk to that of the address suffix (last label of the host name), which
  is shrunk to that of all documents.

The last two are counted over all documents by grouped aggregation, with the best language by text alone as the label,
and a document does not count for itself. Counts are aggregated partially before the shuffle, so a host with a third of
all rows is one row per task. The text model is fitted on a bounded sample of rows with a known language: about
``sample_rows`` per language, chosen by a hash of the text. All labels are languages (``least_rows`` can leave out those of
fewer rows); trigrams fall into ``2 ** 16`` cells, so the model has a fixed size per language.

A document is rejected if no language can be told: no letter in its text, a text that the background (all cells
equally likely) explains so much better than any language that its small prior still wins, or a posterior below ``least_posterior``.

Cases: a null or blank text has no text evidence and is rejected; a null declaration, address or host is missing evidence,
and so is a declaration never seen; without any labelled rows no language is known and every document is rejected; ties
go to the first language by name; an empty table gives no rows; repeated rows and null ids are kept; clashing columns
of the input are kept by ``identify_rows`` inside ``row``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codesieve.llm.lineage import written

CELLS = 1 << 16
#: Pseudo-counts: of a trigram cell, of a declared value or suffix, and the weight of a parent in the host hierarchy.
CELL_PRIOR, VALUE_PRIOR, HOST_WEIGHT = 0.5, 1.0, 10.0
#: Number of trigrams at which the text evidence has half of its greatest weight.
TEMPER = 256
#: Log likelihood of a trigram in text of no known language.
BACKGROUND = -np.log(CELLS)
#: Odds before the text is seen that it is of no known language.
BACKGROUND_PRIOR = 0.001


def cells(data: np.ndarray) -> np.ndarray:
    """The cell of each byte trigram."""
    wide = data.astype(np.uint32)
    return ((wide[:-2] * 65599 + wide[1:-1]) * 65599 + wide[2:]) * 2654435769 >> np.uint32(16) & np.uint32(CELLS - 1)


def prepared(text: str | None) -> np.ndarray:
    """Lower-cased text between two spaces, as bytes."""
    return np.frombuffer(f" {(text or '').lower()} ".encode(), np.uint8)


def fit(rows: DataFrame, sample_rows: int = 2000, least_rows: int = 1) -> tuple[list[str], np.ndarray]:
    """Languages and the log probability of each cell (cells x languages) from rows (text, language)."""
    known = rows.where(F.col("language").isNotNull() & F.col("text").isNotNull())
    sizes = known.groupBy("language").count().where(F.col("count") >= least_rows).collect()
    languages = sorted(r["language"] for r in sizes)
    if not languages:
        return [], np.zeros((CELLS, 0))
    # rows with a small hash, so many that sample_rows are expected per language
    share = F.create_map(*[x for r in sizes for x in (F.lit(r["language"]), F.lit(min(1.0, sample_rows / r["count"])))])
    number = F.create_map(*[x for k, name in enumerate(languages) for x in (F.lit(name), F.lit(k))])
    chosen = known.where(F.col("language").isin(languages)) \
        .where(F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < share[F.col("language")] * 1_000_000) \
        .select("text", number[F.col("language")].alias("n"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros((len(languages), CELLS), np.int64)
        for batch in batches:
            for text, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found[n] += np.bincount(cells(prepared(text)), minlength=CELLS)
        n, cell = np.nonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(n.astype(np.int32)), pa.array(cell.astype(np.int32)), pa.array(found[n, cell])],
                                         names=["n", "cell", "times"])

    # at most 2^16 rows per language reach the driver
    table = chosen.mapInArrow(count, "n int, cell int, times long").groupBy("n", "cell").agg(F.sum("times").alias("times")).toPandas()
    counts = np.full((CELLS, len(languages)), CELL_PRIOR)
    counts[table["cell"], table["n"]] += table["times"]
    return languages, np.log(counts / counts.sum(axis=0))


def text_evidence(rows: DataFrame, languages: list[str], model: np.ndarray) -> DataFrame:
    """``rows`` (row, text, ...) with evidence (tempered log likelihood per language) and best (its largest, from 0; null
    if the text has no letter or is told better by the background)."""
    table = model.astype(np.float32)
    broadcast = rows.sparkSession.sparkContext.broadcast(table)

    @F.pandas_udf("array<double>")
    def score(texts):
        import pandas as pd

        table, out = broadcast.value, []
        for text in texts:
            data, total = prepared(text), np.zeros(len(languages))
            if not any(map(str.isalpha, text or "")):
                out.append(None)
                continue
            n = len(data) - 2
            for low in range(0, n, 1 << 16):
                total += table[cells(data[low:low + (1 << 16) + 2])].sum(axis=0, dtype=np.float64)
            known = total / n * (n * TEMPER / (n + TEMPER))
            # the background explains the text so much better that even its small prior wins
            unknown = known.max() < BACKGROUND * (n * TEMPER / (n + TEMPER)) + np.log(BACKGROUND_PRIOR)
            out.append(None if unknown else known)
        return pd.Series(out, dtype="object")

    # called non-deterministic, or a filter on its result would run it once more, in Python workers of its own
    scored = rows.withColumn("evidence", score.asNondeterministic()(F.coalesce("text", F.lit(""))))
    return scored.withColumn("best", F.array_position("evidence", F.array_max("evidence")) - 1)


def host_of(url: str | Column) -> Column:
    """The lower-cased host name of an address, null if there is none."""
    url = F.col(url) if isinstance(url, str) else url
    host = F.lower(F.regexp_extract(url, r"(?s)^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return F.when(host != "", host)


def declared_in(html: str | Column) -> Column:
    """The primary subtag of the ``lang`` attribute of the ``html`` element, lower-cased, null if there is none."""
    html = F.col(html) if isinstance(html, str) else html
    found = F.lower(F.regexp_extract(html, r"(?is)<html\b[^>]*?\s(?:xml:)?lang\s*=\s*[\"']?([a-z]{2,8})", 1))
    return F.when(found != "", found)


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), use), 0)


def _counts(combined: DataFrame, keys: list[str], n: int) -> DataFrame:
    """Per key: how many documents have each language by text, as an array of ``n``."""
    times = combined.groupBy(*keys, "best").agg(F.sum("times").alias("times"))
    # at most one entry per language
    found = times.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("best", "times"))).alias("by_language"))
    counts = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.coalesce(
        F.try_element_at("by_language", k.cast("long")), F.lit(0)).cast("double"))
    return found.select(*keys, counts.alias("counts"))


def identify_rows(rows: DataFrame, languages: list[str], model: np.ndarray, least_posterior: float = 0.5) -> DataFrame:
    """``rows``: row, text, declared, suffix, host (all but row may be null) -> row, language (null: rejected), posterior,
    text_language."""
    n = len(languages)
    if not n:
        none = F.lit(None).cast("string")
        return rows.select("row", none.alias("language"), F.lit(0.0).alias("posterior"), none.alias("text_language"))
    scored = text_evidence(rows, languages, model)
    # the only pass over the texts that the counts need; their tables are written, so a join knows their sizes
    combined = written(scored.where("best is not null").groupBy("declared", "suffix", "host", "best").agg(
        F.count("*").alias("times")), "evidence")
    first = _counts(combined, [], n).first()
    totals = list(first["counts"]) if first else [0.0] * n
    named = scored
    for column, name in (("declared", "of_declared"), ("suffix", "of_suffix"), ("host", "of_host")):
        found = written(_counts(combined.where(F.col(column).isNotNull()), [column], n)
                        .select(F.col(column), F.col("counts").alias(name)), name)
        named = named.join(found, column, "left")

    zero, all_totals = (F.expr("array(" + ", ".join(f"{x!r}D" for x in values) + ")") for values in ([0.0] * n, totals))
    everything = sum(totals)
    # a document does not count for itself
    one = F.when(F.col("best").isNotNull(), 1.0).otherwise(0.0)
    own = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.when(k == F.col("best"), 1.0).otherwise(0.0))
    named = named.withColumn("own", own)

    def less_own(column: str) -> Column:
        return F.when(F.col(column).isNotNull(), F.zip_with(column, "own", lambda c, o: c - o)).otherwise(zero)

    def shrunk(column: str, parent: Column) -> Column:
        counts = less_own(column)
        return let(F.aggregate(counts, F.lit(0.0), lambda a, x: a + x) + HOST_WEIGHT, lambda size: F.zip_with(
            counts, parent, lambda c, p: (c + HOST_WEIGHT * p) / size))

    # mix of all documents, then of the suffix, then of the host, each shrunk to the one before
    world = F.zip_with(all_totals, F.col("own"), lambda t, o: (t - o + 1.0) / (everything - one + n))
    named = named.withColumn("world", world).withColumn("of_suffix", shrunk("of_suffix", F.col("world"))) \
        .withColumn("of_host", shrunk("of_host", F.col("of_suffix")))
    said = F.zip_with(less_own("of_declared"), F.zip_with(all_totals, F.col("own"), lambda t, o: t - o + 2 * VALUE_PRIOR),
                      lambda c, t: F.log((c + VALUE_PRIOR) / t))
    told = F.zip_with("evidence", "of_host", lambda e, h: e + F.log(h))
    logs = F.when(F.col("of_declared").isNotNull(), F.zip_with(told, said, lambda t, x: t + x)).otherwise(told)
    fused = named.select("row", "best", logs.alias("logs")).withColumn("top", F.array_max("logs"))
    weight = F.aggregate(F.col("logs"), F.lit(0.0), lambda a, x: a + F.exp(x - F.col("top")))
    names = F.array(*[F.lit(x) for x in languages])
    return fused.withColumn("posterior", F.coalesce(1.0 / weight, F.lit(0.0))).select(
        "row", F.when((F.col("posterior") >= least_posterior) & F.col("best").isNotNull(),
                      F.get(names, (F.array_position("logs", F.col("top")) - 1).cast("int"))).alias("language"),
        F.when(F.col("best").isNotNull(), F.col("posterior")).otherwise(0.0).alias("posterior"),
        F.get(names, F.col("best").cast("int")).alias("text_language"))


def identify(docs: DataFrame, labelled: DataFrame | None = None, text_column: str = "text", declared: Column | None = None,
             host: Column | None = None, sample_rows: int = 2000, least_posterior: float = 0.5, least_rows: int = 1) -> DataFrame:
    """row (the input row), language, posterior, text_language. ``labelled`` (text, language) fits the text model; by
    default the declared languages of ``docs`` do. The suffix is the last label of a host name that has a dot."""
    none = F.lit(None).cast("string")
    declared, host = (none if x is None else x for x in (declared, host))
    suffix = F.when(F.instr(host, ".") > 0, F.substring_index(host, ".", -1))
    rows = docs.select(F.struct("*").alias("row"), F.col(text_column).alias("text"), declared.alias("declared"),
                       suffix.alias("suffix"), host.alias("host"))
    if labelled is None:
        labelled = rows.select("text", F.col("declared").alias("language"))
    return identify_rows(rows, *fit(labelled, sample_rows, least_rows), least_posterior)
