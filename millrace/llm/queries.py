"""The corpus operators as queries over the whole test tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from millrace.llm.bpe import with_tokens
from millrace.llm.common import read_table
from millrace.llm.decontaminate import contaminated
from millrace.llm.extract import with_main_text
from millrace.llm.jaccard import jaccard_components
from millrace.llm.langid import page_languages
from millrace.llm.phrases import collocations
from millrace.llm.quality import quality_rules
from millrace.llm.sharding import balanced_shards
from millrace.llm.simhash import simhash_components
from millrace.llm.suffix import without_repeats
from millrace.llm.toxicity import toxicity
from millrace.llm.trie import conversation_trie
from millrace.llm.warc import warc_round_trip

Query = Callable[[SparkSession, str], DataFrame]


# The vocabulary is a file outside the repository; its place is a parameter.
RANK_FILE = public_tokenizers.path("byte_bpe_50k.tiktoken")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return with_tokens(docs, RANK_FILE, public_tokenizers.PATTERN)


def op2_warc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_round_trip(read_table(spark, sf_dir, "pages"))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_main_text(read_table(spark, sf_dir, "pages"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return without_repeats(docs).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"
    )


def op5_bm25_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return contaminated(docs, read_table(spark, sf_dir, "benchmark")).drop("text_hash")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return quality_rules(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept",
    )


def op7_bayes_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return page_languages(read_table(spark, sf_dir, "pages"), docs)


def op8_balanced_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balanced_shards(read_table(spark, sf_dir, "documents"))


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return simhash_components(docs).select("doc_id", "fingerprint", "component_id")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return toxicity(docs, read_table(spark, sf_dir, "labels"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(read_table(spark, sf_dir, "documents"))


def op12_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(read_table(spark, sf_dir, "documents"))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(read_table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Query] = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_warc_chunks": op2_warc_chunks,
    "op3_html_extraction": op3_html_extraction,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_bm25_decontamination": op5_bm25_decontamination,
    "op6_quality_rules": op6_quality_rules,
    "op7_bayes_langid": op7_bayes_langid,
    "op8_balanced_shards": op8_balanced_shards,
    "op9_simhash_near_dedup": op9_simhash_near_dedup,
    "op10_toxicity": op10_toxicity,
    "op11_collocations": op11_collocations,
    "op12_jaccard_join": op12_jaccard_join,
    "op13_conversation_trie": op13_conversation_trie,
}

# Five hex digits of a digest are four letters of base 32.
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_GROUP = "CAST('0x' || substr(sha1, 5 * i + 1, 5) AS INTEGER)"
_LETTERS = " || ".join(
    f"substr('{_BASE32}', ({_GROUP} >> {shift}) % 32 + 1, 1)" for shift in (15, 10, 5, 0)
)

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

# SQL for what SQL can state; the others are tested against brute force.
ORACLE: dict[str, str] = {
    "op2_warc_chunks": f"""
WITH payloads AS (
  SELECT page_id, url, encode(coalesce(html, '')) AS payload,
    sha1(encode(coalesce(html, ''))) AS sha1
  FROM pages
),
firsts AS (SELECT payload, min(page_id) AS first_id FROM payloads GROUP BY payload)
SELECT page_id, CAST(octet_length(p.payload) AS BIGINT) AS payload_bytes,
  list_aggregate([{_LETTERS} FOR i IN range(8)], 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first_id THEN first_id END AS refers_to,
  url
FROM payloads p JOIN firsts f ON p.payload = f.payload""",
    "op11_collocations": f"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM documents
),
split AS (
  SELECT lang, row_number() OVER () AS p, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w
  FROM pieces
),
places AS (
  SELECT lang, p, unnest(w) AS w1, unnest(range(len(w))) AS i FROM split WHERE len(w) > 0
),
totals AS (SELECT lang, count(*) AS n FROM places GROUP BY lang),
following AS (
  SELECT lang, w1, lead(w1, 1) OVER s AS w2, lead(w1, 2) OVER s AS w3, lead(w1, 3) OVER s AS w4
  FROM places WINDOW s AS (PARTITION BY p ORDER BY i)
),
grams AS (
  SELECT lang, 1 AS m, w1 AS phrase FROM following
  UNION ALL SELECT lang, 2, w1 || ' ' || w2 FROM following WHERE w2 IS NOT NULL
  UNION ALL SELECT lang, 3, w1 || ' ' || w2 || ' ' || w3 FROM following WHERE w3 IS NOT NULL
  UNION ALL SELECT lang, 4, w1 || ' ' || w2 || ' ' || w3 || ' ' || w4 FROM following
    WHERE w4 IS NOT NULL
),
counts AS (
  SELECT lang, m, phrase, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 30
),
candidates AS (
  SELECT lang, phrase, f AS a, string_split(phrase, ' ') AS w, m FROM counts WHERE m > 1
),
cuts AS (
  SELECT c.lang, c.phrase, c.a, k, x.f AS l, y.f AS r,
    CAST(2000000 * CAST(c.a AS HUGEINT) // (x.f + y.f) AS BIGINT) AS score
  FROM candidates c JOIN range(1, 4) t(k) ON k < c.m
  JOIN counts x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:k], ' ')
  JOIN counts y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[k + 1:], ' ')
),
weakest AS (
  SELECT * FROM cuts
  QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
),
inner_phrases AS (
  SELECT lang, array_to_string(w[i:i + s - 1], ' ') AS phrase, max(a) AS longer
  FROM candidates, range(2, 4) t(s), range(1, 4) u(i)
  WHERE s < m AND i + s - 1 <= m GROUP BY ALL
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank,
  phrase, a, l, r, n, score
FROM weakest JOIN totals USING (lang) LEFT JOIN inner_phrases USING (lang, phrase)
WHERE longer IS NULL OR 100 * CAST(longer AS HUGEINT) < 80 * CAST(a AS HUGEINT)
QUALIFY rank <= 2000""",
    "op12_jaccard_join": f"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents
),
sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4
    THEN [array_to_string(w, ' ')]
    ELSE [array_to_string(w[i + 1:i + 4], ' ') FOR i IN range(len(w) - 3)] END) AS s
  FROM words
),
elements AS (SELECT doc_id, len(s) AS n, unnest(s) AS e FROM sets),
links AS (
  SELECT x.doc_id AS a, y.doc_id AS b FROM elements x JOIN elements y USING (e)
  WHERE x.doc_id <> y.doc_id AND 100 * x.n >= 85 * y.n AND 100 * y.n >= 85 * x.n
  GROUP BY x.doc_id, y.doc_id, x.n, y.n
  HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))
),
reached AS (
  SELECT a, b FROM links
  UNION
  SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a
)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles,
  least(doc_id, coalesce((SELECT min(b) FROM reached WHERE a = doc_id), doc_id)) AS component_id
FROM sets""",
    "op13_conversation_trie": """
WITH steps AS (
  SELECT i, list_reduce([i] || range(8), lambda c, k:
    CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v
  FROM range(256) t(i)
),
crc_table AS (SELECT list(v ORDER BY i) AS t FROM steps),
turns AS (
  SELECT conv_id AS c, {'r': coalesce(role, ''), 't': coalesce(text, '')} AS turn,
    row_number() OVER (PARTITION BY conv_id
      ORDER BY conversations.turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS k
  FROM conversations WHERE conv_id IS NOT NULL
),
own AS (SELECT c, list(turn ORDER BY k) AS w FROM turns GROUP BY c),
heads AS (
  SELECT c, w, xor(list_reduce([4294967295] || [CAST(ascii(x) AS BIGINT)
    FOR x IN string_split(CAST(c AS VARCHAR), '')],
    lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) % 4 AS h
  FROM own, crc_table
),
rebuilt AS (
  SELECT x.c, coalesce(y.w[1:x.h], []) || x.w[x.h + 1:] AS w
  FROM heads x LEFT JOIN own y ON y.c = x.c - x.c % 20
),
members AS (
  SELECT c, w[1:d] AS path, d, len(w) = d AS ends FROM rebuilt, range(0, 100000) t(d)
  WHERE d <= len(w)
),
nodes AS (
  SELECT path, d, min(c) AS first, count(*) AS n,
    coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE ends), '') AS ids,
    (count(*) - 1) * CASE WHEN d = 0 THEN 0 ELSE
      len(regexp_extract_all(path[d].t, '[^\\x20\\x09-\\x0D]+')) END AS saves
  FROM members GROUP BY path, d
),
kids AS (SELECT path[1:d - 1] AS up, d - 1 AS ud, count(*) AS k FROM nodes WHERE d > 0 GROUP BY ALL),
full_nodes AS (SELECT n.*, coalesce(k, 0) AS k FROM nodes n LEFT JOIN kids ON up = path AND ud = d),
sums AS (
  SELECT path[1:u] AS top, u, count(*) FILTER (WHERE k = 0) AS leaves, sum(saves) AS saved
  FROM full_nodes, range(0, 100000) t(u) WHERE u <= d GROUP BY ALL
)
SELECT n.first AS conv_id, n.d AS depth, p.first AS parent_conv_id, n.n AS n_convs,
  n.k AS n_children, leaves AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens,
  sha256(n.ids) AS ends_sha256
FROM full_nodes n JOIN sums s ON s.top = n.path AND s.u = n.d
LEFT JOIN nodes p ON n.d > 0 AND p.path = n.path[1:n.d - 1] AND p.d = n.d - 1""",
}
