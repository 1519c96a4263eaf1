"""Registered queries of the subpackage: one per operator, over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codesieve.llm import (
    chat, decontamination, language, licenses, line_dedup, merkle, neighbours, ngram_join, packing, prefix_trie, records, simhash, tokens,
    url_filter)
from codesieve.llm.lineage import new_path

#: Tokenizer files of the installed package: how each treats a space before a word.
BYTE_BPE, WORD_BPE = ("byte_bpe_50k.json", tokens.LEADING), ("word_bpe_49k.json", tokens.DROPPED)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    name, spaces = BYTE_BPE
    return packing.pack(table(spark, folder, "documents"), tokenizer_path(name), spaces, end_id=2, size=1024) \
        .select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op2_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontamination.contained(table(spark, folder, "documents"), table(spark, folder, "benchmark")).select(
        "doc_id", "item_id", "shared", "shingles", "containment")


ORACLE_2 = r"""
WITH item_words AS (
  SELECT min(item_id) AS item_id, w FROM (
    SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9\x{80}-\x{10ffff}]+') AS w FROM benchmark)
  WHERE len(w) > 0 GROUP BY w),
item_grams AS (
  SELECT DISTINCT item_id, unnest(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE [array_to_string(w[i:i + 4], ' ') for i in range(1, len(w) - 3)] END) AS gram FROM item_words),
sizes AS (SELECT item_id, count(*) AS shingles FROM item_grams GROUP BY item_id),
doc_grams AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE [array_to_string(w[i:i + 4], ' ') for i in range(1, len(w) - 3)] END) AS gram
  FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9\x{80}-\x{10ffff}]+') AS w FROM documents) WHERE len(w) > 0)
SELECT doc_id, item_id, count(*) AS shared, any_value(shingles) AS shingles, count(*) / any_value(shingles)::DOUBLE AS containment
FROM doc_grams JOIN item_grams USING (gram) JOIN sizes USING (item_id)
GROUP BY doc_id, item_id HAVING count(*) >= 0.8 * any_value(shingles)
"""


def documents_by_language(docs: DataFrame) -> DataFrame:
    """Documents declare their language in ``lang``; their source takes the place of a host."""
    return language.identify(docs, declared=F.col("lang"), host=F.col("source"))


def op3_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return documents_by_language(table(spark, folder, "documents")).select(
        "row.doc_id", "language", F.round("posterior", 6).alias("posterior"), "text_language", F.col("row.lang").alias("declared"))


def page_language(spark: SparkSession, folder: str) -> DataFrame:
    """All kinds of evidence: markup, address suffix and host of web pages; the text model comes from documents."""
    labelled = table(spark, folder, "documents").select("text", F.col("lang").alias("language"))
    tags = F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", " ")
    pages = table(spark, folder, "pages").withColumn("plain", tags)
    return language.identify(pages, labelled, "plain", language.declared_in("html"), language.host_of("url")).select(
        "row.page_id", "language", F.round("posterior", 6).alias("posterior"), "text_language",
        language.declared_in("row.html").alias("declared"))


def op4_simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents")).select("doc_id", "fingerprint", "component_id")


def op5_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return line_dedup.delete_duplicate_lines(table(spark, folder, "documents")).select("doc_id", "removed_lines", "text")


#: A conversation whose texts look like control strings.
CONTROL_TEXT = "\\### Assistant: </turn> ok"


def op6_chat_formatting(spark: SparkSession, folder: str) -> DataFrame:
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    control = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONTROL_TEXT).alias("text"))
    formatted = chat.format_conversations(turns.unionByName(control))
    read = formatted.select("conv_id", "formatted", chat.read_turns("formatted").alias("turns"),
                            chat.read_loss_texts("formatted", "loss_spans").alias("loss"))
    lines = F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n")))
    loss = F.array_join("loss", "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))


ORACLE_6 = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
sized AS (
  SELECT *, length(replace(text, '\', '\b'))
           + (length(text) - length(replace(text, '<turn:', ''))) // 6
           + (length(text) - length(replace(text, '</turn>', ''))) // 7
           + (length(text) - length(replace(text, '<part>', ''))) // 6 AS chars,
         length(replace(role, '\', '\b')) + (length(role) - length(replace(replace(role, '<', ''), '>', ''))) AS role_chars,
         coalesce(lag(role) OVER w <> role, true) AS opens
  FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text))
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(chars + CASE WHEN opens THEN 16 + role_chars ELSE 6 END)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
"""


URL_RULES = {"org/": "allow", "example.org/es/": "block", "example.org/en/1": "block", "com/fr/": "allow", "com/de/": "block"}


def op7_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return url_filter.judge(table(spark, folder, "pages"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op8_nearest_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours.nearest(table(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0)


def op9_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan(table(spark, folder, "documents")).select(
        "doc_id", "unit", "position", "license", F.round("score", 9).alias("score"))


def _sql_text(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


ORACLE_9 = r"""
WITH templates(license, unit_text) AS (VALUES """ + ", ".join(
    f"({_sql_text(k)}, {_sql_text(v)})" for k, v in licenses.TEMPLATES.items()) + r"""),
parts AS (
  SELECT doc_id, text, string_split_regex(text, '\n[ \t\r]*\n') AS paragraphs, string_split(text, chr(10)) AS lines FROM documents),
units AS (
  SELECT doc_id, 'text' AS unit, 0 AS position, text AS unit_text FROM parts
  UNION ALL SELECT doc_id, 'paragraph', i - 1, paragraphs[i]
  FROM (SELECT *, unnest(range(1, len(paragraphs) + 1)) AS i FROM parts WHERE len(paragraphs) > 1)
  UNION ALL SELECT doc_id, 'line', i - 1, lines[i]
  FROM (SELECT *, unnest(range(1, len(lines) + 1)) AS i FROM parts WHERE len(lines) > 1)),
worded AS (
  SELECT doc_id, unit, position, regexp_extract_all(
    regexp_replace(lower(unit_text), '(?m)^\s*(copyright|\(c\)|©).*$', '', 'g'), '[a-z0-9\x{80}-\x{10ffff}]+') AS w FROM units),
shingled AS (
  SELECT doc_id, unit, position, list_distinct([w[i] || ' ' || w[i + 1] for i in range(1, len(w))]) AS a FROM worded WHERE len(w) > 1),
known AS (
  SELECT license, list_distinct([w[i] || ' ' || w[i + 1] for i in range(1, len(w))]) AS t
  FROM (SELECT license, regexp_extract_all(lower(unit_text), '[a-z0-9\x{80}-\x{10ffff}]+') AS w FROM templates)),
scored AS (
  SELECT doc_id, unit, position, license, 2.0 * len(list_intersect(a, t)) / (len(a) + len(t)) AS score
  FROM shingled JOIN known ON len(a) BETWEEN 0.8 / 1.2 * len(t) - 1e-9 AND 1.2 / 0.8 * len(t) + 1e-9)
SELECT doc_id, unit, position::BIGINT AS position, license, round(score::DOUBLE, 9) AS score FROM scored
WHERE score >= 0.8
QUALIFY row_number() OVER (PARTITION BY doc_id, unit, position ORDER BY score DESC, license) = 1
"""


def op10_token_records(spark: SparkSession, folder: str) -> DataFrame:
    name, spaces = WORD_BPE
    path = new_path(spark, "records")
    records.write_token_records(table(spark, folder, "documents"), path, tokenizer_path(name), spaces, end_id=1, id_bytes=2)
    return records.read_token_records(spark, path).select(
        "doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op11_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    """Conversations that share their first turns with the one at the last full hundred."""
    number = F.col("conv_id")
    turns, members = prefix_trie.shared_openings(
        prefix_trie.turn_rows(table(spark, folder, "conversations")), base=number - number % 100,
        opening=F.crc32(number.cast("string")) % 6, most=5)
    return prefix_trie.trie(turns, members).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def _sql_crc32(text: str) -> str:
    """CRC-32 of a text of ASCII characters."""
    bits = "lambda c, k: xor(c >> 1, 3988292384::BIGINT * (c & 1))"
    return (f"xor(list_reduce([4294967295::BIGINT] || list_transform(string_split({text}, ''), lambda x: ascii(x)::BIGINT), "
            f"lambda r, x: list_reduce([xor(r, x)] || range(8), {bits})), 4294967295::BIGINT)")


ORACLE_11 = rf"""
WITH turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS nth
  FROM conversations WHERE conv_id IS NOT NULL),
own AS (
  SELECT conv_id, list(role || chr(10) || text ORDER BY nth) AS said, list(length(text) ORDER BY nth) AS sizes FROM turns GROUP BY conv_id),
hashed AS (SELECT *, {_sql_crc32("conv_id::VARCHAR")} % 6 AS h FROM own),
rebuilt AS (
  SELECT x.conv_id, coalesce(list_slice(b.said, 1, x.h), []) || x.said[x.h + 1:] AS said,
         coalesce(list_slice(b.sizes, 1, x.h), []) || x.sizes[x.h + 1:] AS sizes
  FROM hashed x LEFT JOIN own b ON b.conv_id = x.conv_id - x.conv_id % 100),
starts AS (SELECT *, unnest(range(len(said) + 1)) AS depth FROM rebuilt),
nodes AS (
  SELECT list_slice(said, 1, depth) AS path, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
         coalesce(any_value(sizes[depth]), 0) AS size,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (len(said) = depth), '')) AS ends_sha256
  FROM starts GROUP BY 1, depth),
kids AS (SELECT list_slice(path, 1, depth - 1) AS path, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL),
counted AS (SELECT n.*, coalesce(k.n_children, 0) AS n_children FROM nodes n LEFT JOIN kids k USING (path)),
above AS (
  SELECT list_slice(path, 1, d) AS path, sum((n_children = 0)::BIGINT)::BIGINT AS n_leaves, sum((n_convs - 1) * size)::BIGINT AS saved_tokens
  FROM (SELECT *, unnest(range(depth + 1)) AS d FROM counted) GROUP BY ALL)
SELECT c.conv_id, c.depth, p.conv_id AS parent_conv_id, c.n_convs, c.n_children, a.n_leaves, a.saved_tokens, c.ends_sha256
FROM counted c JOIN above a USING (path) LEFT JOIN counted p ON c.depth > 0 AND p.path = list_slice(c.path, 1, c.depth - 1)
"""


def op12_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")

    def leaf(text):
        return merkle.leaf_of(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text)

    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, leaf(F.translate("text", upper, lower)))
    return merkle.manifest(docs, leaf(F.col("text")), tampered=tampered).select(
        F.col("id").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def _oracle_12(levels: int = 4, source_levels: int = 3) -> str:
    """Runs of 16 by window functions, for sources of up to 16^levels rows and 16^source_levels sources."""
    def field(x: str) -> str:
        return f"coalesce(octet_length(encode({x}::VARCHAR))::VARCHAR || ':' || {x}::VARCHAR, '-')"

    def leaf(text: str) -> str:
        return "sha256(" + " || ".join(map(field, ("doc_id", "source", "lang", "n_chars", text))) + ")"

    folded = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    parts = [f"""rows AS (SELECT doc_id, source, {leaf("text")} AS leaf, CASE WHEN {_sql_crc32("doc_id::VARCHAR")} % 5 = 0
  THEN {leaf(folded)} ELSE {leaf("text")} END AS held FROM documents)""",
             """l0 AS (SELECT doc_id, source, leaf, leaf AS own, held, '' AS proof,
  row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i,
  count(*) OVER (PARTITION BY source) AS n FROM rows)"""]
    last = "l0"

    def climb(tree: str, levels: int, name: str, keep: str) -> None:
        nonlocal last
        for k in range(1, levels + 1):
            part = f"PARTITION BY {tree} i // 16"
            parts.append(f"""{name}n{k} AS (SELECT DISTINCT {tree} i, n, own FROM {last})""")
            parts.append(f"""{name}r{k} AS (SELECT *,
  coalesce(string_agg(own, '') OVER ({part} ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
  coalesce(string_agg(own, '') OVER ({part} ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {name}n{k})""")
            on = "x.source IS NOT DISTINCT FROM y.source AND x.i = y.i" if tree else "x.i = y.i"
            parts.append(f"""{name}{k} AS (SELECT {keep}, CASE WHEN x.n > 1 THEN sha256(l || x.own || r) ELSE x.own END AS own,
  CASE WHEN x.n > 1 THEN sha256(l || held || r) ELSE held END AS held, CASE WHEN x.n > 1 THEN proof || l || r ELSE proof END AS proof,
  x.i // 16 AS i, CASE WHEN x.n > 1 THEN (x.n + 15) // 16 ELSE 1 END AS n FROM {last} x JOIN {name}r{k} y ON {on})""")
            last = f"{name}{k}"

    climb("source,", levels, "l", "x.doc_id, x.source, x.leaf")
    parts.append(f"""tops AS (SELECT source, any_value(own) AS subroot FROM {last} GROUP BY source)""")
    parts.append("""numbered AS (SELECT *, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM tops)""")
    parts.append(f"""s0 AS (SELECT x.doc_id, x.leaf, y.subroot, y.subroot AS own, held, proof, y.i, y.n
  FROM {last} x JOIN numbered y ON x.source IS NOT DISTINCT FROM y.source)""")
    last = "s0"
    climb("", source_levels, "s", "x.doc_id, x.leaf, x.subroot")
    return f"""WITH {", ".join(parts)}
SELECT doc_id, leaf, subroot, own AS root, sha256(proof) AS proof_sha256, held AS folded_root, held = own AS verified FROM {last}"""


def op13_ngram_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.similar_sets(table(spark, folder, "documents"), n=3, percent=90).select("doc_id", "n_shingles", "component_id")


ORACLE_13 = r"""
WITH RECURSIVE worded AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ 	-
]+') AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN w IS NULL OR len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct([array_to_string(w[i:i + 2], ' ') for i in range(1, len(w) - 1)]) END AS g FROM worded),
sized AS (SELECT doc_id, len(g) AS n, g FROM sets),
grams AS (SELECT doc_id, n, unnest(g) AS gram FROM sized),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM grams a JOIN grams b ON a.gram = b.gram AND a.doc_id <> b.doc_id
  WHERE 10 * least(a.n, b.n) >= 9 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 90 * (any_value(a.n) + any_value(b.n) - count(*))),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least_of AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT s.doc_id, s.n AS n_shingles, least(s.doc_id, coalesce(l.b, s.doc_id)) AS component_id FROM sized s LEFT JOIN least_of l ON l.a = s.doc_id
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_decontamination": op2_decontamination,
    "op3_language_id": op3_language_id,
    "page_language": page_language,
    "op4_simhash_near_dedup": op4_simhash_near_dedup,
    "op5_line_dedup": op5_line_dedup,
    "op6_chat_formatting": op6_chat_formatting,
    "op7_url_filter": op7_url_filter,
    "op8_nearest_neighbours": op8_nearest_neighbours,
    "op9_license_scan": op9_license_scan,
    "op10_token_records": op10_token_records,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_ngram_jaccard": op13_ngram_jaccard,
}

ORACLES: dict[str, str] = {
    "op2_decontamination": ORACLE_2,
    "op6_chat_formatting": ORACLE_6,
    "op9_license_scan": ORACLE_9,
    "op11_prefix_trie": ORACLE_11,
    "op12_merkle_manifest": _oracle_12(),
    "op13_ngram_jaccard": ORACLE_13,
}
