"""The queries of this package over the driver's tables, and SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from mrkit.llm import (
    byte_bpe,
    conversation_trie,
    html_content,
    lexical_search,
    lm_scoring,
    minhash,
    packing,
    pii,
    quality_classifier,
    quality_rules,
    suffix_dedup,
    vector_graph,
    warc,
)
from mrkit.sources import spread_scan

# The key of the surrogates; whoever uses them for real keeps another one secret.
KEY = "surrogates of the test tables"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents for work that is done row by row, over all cores also where they are one small file."""
    return spread_scan(_table(spark, sf_dir, "documents"))


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), words=4)


def op2_html_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_content.main_text(_table(spark, sf_dir, "pages"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated_bytes(_table(spark, sf_dir, "documents"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    return quality_rules.quality_rules(documents, labels)


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    return quality_classifier.quality_classifier(documents, labels)


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return byte_bpe.round_trip(_spread(spark, sf_dir), ranks, public_tokenizers.PATTERN)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokenizer = public_tokenizers.path("word_bpe_49k.json")
    return packing.pack_documents(_spread(spark, sf_dir), tokenizer)


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.surrogate_documents(_spread(spark, sf_dir), KEY)


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.lm_scores(_spread(spark, sf_dir))


def op10_vector_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return vector_graph.nearest_neighbours(vectors, vectors.where("vec_id % 20 = 0"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(_spread(spark, sf_dir), _table(spark, sf_dir, "benchmark"))


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages"))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.conversation_trie(_table(spark, sf_dir, "conversations"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_minhash": op1_minhash,
        "op2_html_content": op2_html_content,
        "op3_suffix_dedup": op3_suffix_dedup,
        "op4_quality_rules": op4_quality_rules,
        "op5_quality_classifier": op5_quality_classifier,
        "op6_byte_bpe": op6_byte_bpe,
        "op7_packing": op7_packing,
        "op8_pii": op8_pii,
        "op9_lm_scoring": op9_lm_scoring,
        "op10_vector_graph": op10_vector_graph,
        "op11_lexical_search": op11_lexical_search,
        "op12_warc": op12_warc,
        "op13_conversation_trie": op13_conversation_trie,
    }


NEAR_DUPLICATES_SQL = r"""WITH RECURSIVE
  words AS (
    SELECT doc_id, regexp_extract_all(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
    FROM documents),
  shingles AS MATERIALIZED (
    SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS shingle
    FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM words WHERE len(w) > 0)),
  sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
  links AS MATERIALIZED (
    SELECT p.a, p.b
    FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM shingles x JOIN shingles y USING (shingle)
          WHERE x.doc_id <> y.doc_id GROUP BY ALL) p
    JOIN sizes s ON s.doc_id = p.a JOIN sizes t ON t.doc_id = p.b
    WHERE 100 * p.n >= 80 * (s.n + t.n - p.n)),
  reach(doc_id, other) AS (
    SELECT doc_id, doc_id FROM documents
    UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON links.a = reach.other)
SELECT doc_id, coalesce(any_value(n), 0) AS n_shingles, min(other) AS component_id, doc_id = min(other) AS kept
FROM reach LEFT JOIN sizes USING (doc_id) GROUP BY doc_id"""


LEXICAL_SEARCH_SQL = r"""WITH
  cut AS MATERIALIZED (
    SELECT *, regexp_extract_all(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
    FROM (SELECT true AS is_item, item_id AS id, text FROM benchmark UNION ALL SELECT false, doc_id, text FROM documents)),
  items AS MATERIALIZED (
    SELECT id AS item_id, term, count(*) AS repeats
    FROM (SELECT DISTINCT id, terms FROM cut WHERE is_item), unnest(terms) AS t(term) GROUP BY ALL),
  docs AS MATERIALIZED (
    SELECT row_number() OVER () AS doc, id AS doc_id, terms, len(terms) AS n FROM cut WHERE NOT is_item AND len(terms) > 0),
  totals AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM docs),
  counts AS MATERIALIZED (
    SELECT doc, term, count(*) AS tf FROM (SELECT doc, unnest(terms) AS term FROM docs)
    WHERE term IN (SELECT term FROM items) GROUP BY ALL),
  weights AS (
    SELECT term, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w
    FROM (SELECT term, count(*) AS df FROM counts GROUP BY term), totals),
  impacts AS MATERIALIZED (
    SELECT doc, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * n_docs) // n_terms))) AS impact
    FROM counts JOIN docs USING (doc) JOIN weights USING (term), totals),
  scores AS (
    SELECT item_id, doc, CAST(sum(repeats * impact) AS BIGINT) AS score FROM items JOIN impacts USING (term) GROUP BY ALL)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT item_id, doc_id, score,
             row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS FIRST) AS rank
      FROM scores JOIN docs USING (doc) WHERE score > 0)
WHERE rank <= 10"""


WARC_SQL = """WITH
  payloads AS (SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS hex FROM pages),
  groups AS (SELECT payload, min(page_id) AS first FROM payloads GROUP BY payload)
SELECT page_id, CAST(strlen(payload) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + ((CAST('0x' || substr(hex, 1 + 5 * (i // 4), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31), 1)), '')
    AS payload_digest,
  CASE WHEN page_id IS DISTINCT FROM first AND first IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM payloads JOIN groups USING (payload)"""


# The checksum is taken bit by bit over the digits of the id.
CONVERSATION_TRIE_SQL = r"""WITH
  own AS MATERIALIZED (
    SELECT conv_id AS conv, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS pos,
      sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS turn,
      len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words
    FROM conversations WHERE conv_id IS NOT NULL),
  convs AS MATERIALIZED (
    SELECT conv, conv - conv % 20 AS base,
      xor(list_reduce(
        list_prepend(CAST(4294967295 AS BIGINT),
                     list_transform(string_split(CAST(conv AS VARCHAR), ''), lambda c: CAST(ord(c) AS BIGINT))),
        lambda crc, c: list_reduce(
          list_prepend(xor(crc, c), list_transform(range(8), lambda i: CAST(0 AS BIGINT))),
          lambda x, i: xor(x >> 1, (x & 1) * CAST(3988292384 AS BIGINT)))), CAST(4294967295 AS BIGINT)) % 4 AS heads
    FROM (SELECT DISTINCT conv FROM own)),
  rebuilt AS MATERIALIZED (
    SELECT conv, list(turn ORDER BY part, pos) AS turns, list(words ORDER BY part, pos) AS words
    FROM (SELECT c.conv, 0 AS part, pos, turn, words FROM convs c JOIN own ON own.conv = c.base AND pos <= heads
          UNION ALL SELECT c.conv, 1, pos, turn, words FROM convs c JOIN own ON own.conv = c.conv AND pos > heads)
    GROUP BY conv),
  lists AS (SELECT conv, coalesce(turns, []) AS turns, coalesce(words, []) AS words FROM convs LEFT JOIN rebuilt USING (conv)),
  paths AS MATERIALIZED (
    SELECT conv, depth, len(turns) AS length, array_to_string(turns[1:depth], ',') AS path,
      array_to_string(turns[1:depth - 1], ',') AS above, CASE WHEN depth = 0 THEN 0 ELSE words[depth] END AS words
    FROM (SELECT *, unnest(range(len(turns) + 1)) AS depth FROM lists)),
  nodes AS MATERIALIZED (
    SELECT depth, path, any_value(above) AS above, min(conv) AS conv_id, count(*) AS n_convs, any_value(words) AS words,
      coalesce(string_agg(CAST(conv AS VARCHAR), ',' ORDER BY conv) FILTER (WHERE length = depth), '') AS ends
    FROM paths GROUP BY depth, path),
  kids AS (SELECT depth - 1 AS depth, above AS path, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL),
  counted AS MATERIALIZED (
    SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN kids USING (depth, path)),
  subtrees AS (
    SELECT p.depth, p.path, count(*) FILTER (WHERE n_children = 0) AS n_leaves,
      CAST(sum((n_convs - 1) * c.words) AS BIGINT) AS saved_tokens
    FROM counted c JOIN paths p ON p.conv = c.conv_id AND p.depth <= c.depth GROUP BY ALL)
SELECT c.conv_id, c.depth, a.conv_id AS parent_conv_id, c.n_convs, c.n_children, n_leaves, saved_tokens,
  sha256(c.ends) AS ends_sha256
FROM counted c JOIN subtrees USING (depth, path) LEFT JOIN nodes a ON a.depth = c.depth - 1 AND a.path = c.above"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_minhash": NEAR_DUPLICATES_SQL,
        "op11_lexical_search": LEXICAL_SEARCH_SQL,
        "op12_warc": WARC_SQL,
        "op13_conversation_trie": CONVERSATION_TRIE_SQL,
    }
