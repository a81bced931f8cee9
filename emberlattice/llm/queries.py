"""The registered queries of the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from emberlattice.llm.common import table
from emberlattice.llm.decontaminate import decontaminate
from emberlattice.llm.divergence import audit
from emberlattice.llm.hard_negatives import hard_negatives
from emberlattice.llm.licenses import scan_licenses, scan_sql
from emberlattice.llm.metric_tree import top_k
from emberlattice.llm.ngram_join import jaccard_components
from emberlattice.llm.packing import pack_documents
from emberlattice.llm.quality import classify
from emberlattice.llm.quotes import reply_order
from emberlattice.llm.substrings import remove_repeats
from emberlattice.llm.suffixes import remove_repeated_bytes
from emberlattice.llm.token_counts import count_tokens
from emberlattice.llm.toxicity import learned, score_documents
from emberlattice.scratch import written

Query = Callable[[SparkSession, str], DataFrame]


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), limit=4096)


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), width=5)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return classify(docs, labels, threshold=0.3)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), width=10)
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), width=13).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op7_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reply_order(table(spark, sf_dir, "conversations"), stored=lambda df: written(df, "quotes"))


def op8_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), "vec_id % 20 = 0", k=20, stored=lambda df: written(df, "tree"))


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated_bytes(table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), max_tokens=1024)


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_documents(docs, learned(docs, table(spark, sf_dir, "labels")), threshold=0.3)


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives(table(spark, sf_dir, "embeddings"), "vec_id % 100 = 0")


QUERIES: dict[str, Query] = {
    "op1_token_counts": op1_token_counts,
    "op2_ngram_jaccard": op2_ngram_jaccard,
    "op3_quality": op3_quality,
    "op4_decontamination": op4_decontamination,
    "op5_licenses": op5_licenses,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_quotation_linking": op7_quotation_linking,
    "op8_top_k": op8_top_k,
    "op9_suffix_array_dedup": op9_suffix_array_dedup,
    "op10_packing": op10_packing,
    "op11_divergence": op11_divergence,
    "op12_toxicity": op12_toxicity,
    "op13_hard_negatives": op13_hard_negatives,
}

LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
BENCH_WORDS = r"list_filter(string_split_regex(" + LOWER + r", '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
SPACE_WORDS = r"list_filter(string_split_regex({}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"

OP2_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce({SPACE_WORDS.format(LOWER.format("text"))}, []) AS w FROM documents),
grams AS (
    SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS gram
    FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)
),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
common AS (
    SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM grams a JOIN grams b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY 1, 2
),
links AS (
    SELECT x, y FROM common JOIN sizes s ON s.doc_id = x JOIN sizes t ON t.doc_id = y WHERE 100 * c >= 80 * (s.n + t.n - c)
),
edges AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
reach AS (SELECT doc_id AS id, doc_id AS r FROM d UNION SELECT e.y, reach.r FROM reach JOIN edges e ON e.x = reach.id),
components AS (SELECT id AS doc_id, min(r) AS component_id FROM reach GROUP BY id)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id FROM d LEFT JOIN sizes USING (doc_id) JOIN components USING (doc_id)
"""

OP4_SQL = f"""
WITH d AS (SELECT doc_id, coalesce({BENCH_WORDS.format("text")}, []) AS w FROM documents),
b AS (SELECT item_id, {BENCH_WORDS.format("text")} AS w FROM benchmark WHERE text IS NOT NULL),
windows AS (
    SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(w[i:i + 9], ' ') AS gram
    FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)
),
places AS (
    SELECT d.doc_id, s.size, unnest(range(1, len(d.w) - s.size + 2)) AS i, d.w
    FROM d, (SELECT DISTINCT size FROM windows) s WHERE len(d.w) >= s.size
),
hits AS (
    SELECT p.doc_id, p.i, p.size, g.item_id
    FROM (SELECT doc_id, i, size, array_to_string(w[i:i + size - 1], ' ') AS gram FROM places) p JOIN windows g USING (size, gram)
),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM hits) GROUP BY doc_id),
items AS (
    SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
    FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
    sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

OP6_SQL = f"""
WITH d AS (SELECT doc_id, coalesce({SPACE_WORDS.format("text")}, []) AS w FROM documents),
windows AS (
    SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS gram
    FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)
),
firsts AS (SELECT gram, min(doc_id) AS first FROM windows GROUP BY gram HAVING count(DISTINCT doc_id) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM windows JOIN firsts USING (gram) WHERE first < doc_id),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (
    SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS text FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id
),
removed AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(removed.n, 0)::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN removed USING (doc_id)
"""

OP8_SQL = """
WITH v AS (
    SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
scored AS (
    SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score
    FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0
)
SELECT query_id, rank, vec_id, score
FROM (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank FROM scored) WHERE rank <= 20
"""

OP9_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
strings AS (
    SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS s FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 49)) AS i FROM d WHERE length(h) >= 100)
),
firsts AS (SELECT s, min(doc_id) AS first FROM strings GROUP BY s HAVING count(DISTINCT doc_id) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM strings JOIN firsts USING (s) WHERE first < doc_id),
counts AS (
    SELECT doc_id, count(*) AS n, count(*) FILTER (before IS NULL OR before <> p - 1) AS spans
    FROM (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS before FROM gone) GROUP BY doc_id
),
bytes AS (SELECT doc_id, p, substr(h, 2 * p + 1, 2) AS b FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2)) AS p FROM d)),
kept AS (SELECT doc_id, string_agg(b, '' ORDER BY p) AS h FROM bytes ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, (length(d.h) // 2)::BIGINT AS n_bytes, coalesce(n, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept.h, ''))) AS kept_sha256
FROM d LEFT JOIN counts USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

OP11_SQL = f"""
WITH d AS (
    SELECT row_number() OVER () AS r, {LOWER.format("coalesce(text, '')")} AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents
),
t AS (SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
sizes AS (SELECT lang, count(*) AS v, sum(n)::HUGEINT AS total FROM kept GROUP BY lang),
found AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
groups AS (SELECT DISTINCT lang, source FROM d),
counts AS (SELECT lang, source, term, coalesce(f.n, 0) AS n, k.n AS lang_n FROM groups JOIN kept k USING (lang) LEFT JOIN found f USING (lang, source, term)),
shares AS (
    SELECT lang, source, term, counts.n, 1 + (1000000000::HUGEINT * (counts.n + 1)) // (sum(counts.n) OVER (PARTITION BY lang, source)::HUGEINT + v) AS p,
        1 + (1000000000::HUGEINT * (lang_n + 1)) // (total + v) AS q
    FROM counts JOIN sizes USING (lang)
),
sums AS (
    SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
    FROM shares a JOIN shares b USING (lang, term) WHERE a.source <> b.source GROUP BY a.lang, a.source, b.source
),
found_values AS (
    SELECT lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
    FROM groups a JOIN groups b USING (lang) LEFT JOIN sums ON sums.lang = a.lang AND sums.source = a.source AND sums.item = b.source WHERE a.source <> b.source
    UNION ALL
    SELECT lang, source, 'term', term, (((p - q) * (p - q)) // q)::BIGINT FROM shares WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, value, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)))::INTEGER AS rank
FROM found_values QUALIFY part = 'pair' OR rank <= 200
"""

OP13_SQL = """
WITH v AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
scored AS (
    SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, list_dot_product(a.v, c.v)::BIGINT AS score
    FROM v a JOIN v c ON c.vec_id <> a.vec_id WHERE a.vec_id % 100 = 0
),
positives AS (
    SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id, (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id))::INTEGER AS rank,
    vec_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) <= 10
"""

ORACLE_SQL: dict[str, str] = {
    "op2_ngram_jaccard": OP2_SQL,
    "op4_decontamination": OP4_SQL,
    "op5_licenses": scan_sql(),
    "op6_substring_dedup": OP6_SQL,
    "op8_top_k": OP8_SQL,
    "op9_suffix_array_dedup": OP9_SQL,
    "op11_divergence": OP11_SQL,
    "op13_hard_negatives": OP13_SQL,
}
