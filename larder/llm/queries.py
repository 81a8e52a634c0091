"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.llm import quality_rules
from larder.llm.common import table
from larder.llm.fingerprints import fingerprint_edits
from larder.llm.hard_negatives import hard_negatives, quantised
from larder.llm.merkle import FIELDS, lower_case_tampering, manifest
from larder.llm.near_dedup import near_duplicates
from larder.llm.packing import pack
from larder.llm.pii import pii_digests
from larder.llm.quality_classifier import score_quality, train_quality
from larder.llm.quality_rules import rule_verdicts
from larder.llm.rank_encoding import rank_digests
from larder.llm.secret_scan import secret_digests
from larder.llm.token_counts import token_counts
from larder.llm.toxicity import score_toxicity, train_toxicity
from larder.llm.trie_encoding import encoding_digests


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_quality(docs, train_quality(docs, table(spark, sf_dir, "labels")), threshold=0.3)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_toxicity(docs, train_toxicity(docs, table(spark, sf_dir, "labels")), threshold=0.3)


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_digests(table(spark, sf_dir, "documents"))


def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_digests(table(spark, sf_dir, "documents"))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), size=2, percent=80)


def op6_bpe_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding_digests(table(spark, sf_dir, "documents"))


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_edits(table(spark, sf_dir, "documents"), k=128, size=5)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rule_verdicts(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), limit=512)


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), capacity=1024, end_id=2)


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(table(spark, sf_dir, "documents"), lower_case_tampering())


def op12_rank_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank_digests(table(spark, sf_dir, "documents"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quantised(table(spark, sf_dir, "embeddings"))
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.withColumn("label", moved), every=100, positives=5, negatives=5, low=80, high=100)


QUERIES = {
    f.__name__: f
    for f in (
        op1_quality_classifier, op2_toxicity, op3_secret_scan, op4_personal_data, op5_near_dedup, op6_bpe_encoding, op7_fingerprints,
        op8_quality_rules, op9_token_counts, op10_best_fit_packing, op11_merkle_manifest, op12_rank_encoding, op13_hard_negatives,
    )
}

#: The ratios of the quality rules as SQL.
_RATIOS = {"symbol_ratio": "n_symbols / chars", "dup_line_ratio": "n_dup_lines / words", "repeat_ratio": "n_repeat_words / words", "mean_word": "word_chars / words", "upper_ratio": "n_upper / chars"}


def _fences_sql(name: str, keys: str) -> str:
    q = quality_rules
    fence = lambda k: f"max(mid) FILTER (measure = '{k}') + {q.FENCE} * ({q.GROWTH} * max(mid) FILTER (measure = '{k}') - max(low) FILTER (measure = '{k}') + {q.RATIOS[k][1]} / max(median) FILTER (measure = '{q.RATIOS[k][0]}')) AS {k}"
    return f"""{name} AS (SELECT {keys}max(total) AS total, {", ".join(map(fence, _RATIOS))} FROM (
  SELECT {keys}measure, max(total) AS total, min(value) FILTER (upto >= {q.LOW} * total) AS low, min(value) FILTER (upto >= {q.MID} * total) AS mid, min(value) FILTER (upto >= 0.5 * total) AS median FROM (
    SELECT {keys}measure, coalesce(pow({q.GROWTH}, bucket - 0.5), 0.0) AS value, sum(n) OVER (PARTITION BY {keys}measure ORDER BY bucket ASC NULLS FIRST) AS upto, sum(n) OVER (PARTITION BY {keys}measure) AS total
    FROM (SELECT {keys}measure, bucket, sum(n) AS n FROM sketch GROUP BY ALL)) GROUP BY ALL) GROUP BY ALL)"""


def _quality_sql() -> str:
    q = quality_rules
    values = " UNION ALL ".join(f"SELECT lang, source, '{k}' AS measure, {v} AS value FROM r WHERE NOT base_failed" for k, v in {**_RATIOS, "words": "words", "chars": "chars"}.items())
    lean = lambda own, other, k: f"({own}.total * {own}.{k} + {q.PRIOR_ROWS} * {other}.{k}) / ({own}.total + {q.PRIOR_ROWS}) AS {k}"
    return f"""WITH w AS (SELECT doc_id, lang, source, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS ws FROM documents),
  g AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS gram FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) > 2)),
  twice AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM g) WHERE n > 1),
  rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, (VALUES (0), (1), (2)) s(k) GROUP BY doc_id),
  l AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM w) WHERE regexp_matches(line, '[^ \\t\\n\\x0B\\f\\r]') GROUP BY doc_id),
  m AS (SELECT doc_id, lang, source, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(l.n, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_upper
    FROM w LEFT JOIN rep USING (doc_id) LEFT JOIN l USING (doc_id)),
  r AS (SELECT *, nullif(n_words, 0)::DOUBLE AS words, nullif(word_chars, 0)::DOUBLE AS chars, n_words < {q.MIN_WORDS} OR 100 * n_repeat_words > {q.MAX_REPEAT_PERCENT} * n_words AS base_failed FROM m),
  v AS ({values}),
  sketch AS (SELECT lang, source, measure, CASE WHEN value > 0 THEN ceil(ln(value) / ln({q.GROWTH})) END AS bucket, count(*) AS n FROM v WHERE value IS NOT NULL GROUP BY ALL),
  {_fences_sql("own", "lang, source, ")}, {_fences_sql("of_lang", "lang, ")}, {_fences_sql("corpus", "")},
  lang_limits AS (SELECT of_lang.lang, {", ".join(lean("of_lang", "corpus", k) for k in _RATIOS)} FROM of_lang, corpus),
  limits AS (SELECT own.lang, own.source, {", ".join(lean("own", "lang_limits", k) for k in _RATIOS)} FROM own JOIN lang_limits ON own.lang IS NOT DISTINCT FROM lang_limits.lang)
  SELECT r.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT ({" OR ".join(f"coalesce({v} > limits.{k}, FALSE)" for k, v in _RATIOS.items())}) AS kept
  FROM r LEFT JOIN limits ON r.lang IS NOT DISTINCT FROM limits.lang AND r.source IS NOT DISTINCT FROM limits.source"""


def _climb_sql(name: str, first: str, levels: int = 8) -> str:
    """CTEs over `first` (key, r, h, total): {name}0 .. are the nodes of each level with the siblings in their run; enough levels for 16^levels nodes."""
    run = "PARTITION BY key, r // 16 ORDER BY r ROWS BETWEEN"
    parts = []
    for k in range(levels + 1):
        parts.append(f"""{name}{k} AS MATERIALIZED (SELECT *, coalesce(string_agg(h, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before,
  coalesce(string_agg(h, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after FROM {first if k == 0 else f"{name}{k}_nodes"})""")
        parts.append(f"""{name}{k + 1}_nodes AS (SELECT key, r // 16 AS r, CASE WHEN any_value(total) > 1 THEN sha256(string_agg(h, '' ORDER BY r)) ELSE any_value(h) END AS h, (any_value(total) + 15) // 16 AS total
  FROM {name}{k} GROUP BY key, r // 16)""")
    return ",\n".join(parts)


def _fold_sql(name: str, tree: str, first: str, levels: int = 8) -> str:
    """CTEs over `first` (id, key, r, x, said): x folded with the siblings of each level, said the siblings so far; {name}{levels + 1} is the last."""
    level = lambda k: first if k == 0 else f"{name}{k}"
    return ",\n".join(
        f"{name}{k + 1} AS (SELECT f.id, f.key, f.r // 16 AS r, CASE WHEN n.total > 1 THEN sha256(n.before || f.x || n.after) ELSE f.x END AS x, f.said || n.before || n.after AS said FROM {level(k)} f JOIN {tree}{k} n ON n.key = f.key AND n.r = f.r)"
        for k in range(levels + 1)
    )


def _merkle_sql() -> str:
    table_of_crc = "SELECT i, i AS c FROM range(256) t(i)"
    for _ in range(8):
        table_of_crc = f"SELECT i, CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END AS c FROM ({table_of_crc})"
    hashed = lambda text: "sha256(" + " || ".join(f"coalesce(strlen({v}::VARCHAR) || ':' || {v}::VARCHAR, '-')" for v in (text if f == "text" else f for f in FIELDS)) + ")"
    return f"""WITH crc AS MATERIALIZED (SELECT list(c ORDER BY i) AS t FROM ({table_of_crc})),
leaves AS MATERIALIZED (SELECT *, CASE WHEN xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda k: ascii((doc_id::VARCHAR)[k])::BIGINT)),
    lambda c, b: xor(crc.t[(xor(c, b) & 255) + 1], c >> 8))) % 5 = 0 THEN {hashed(f"translate(text, '{ascii_uppercase}', '{ascii_lowercase}')")} END AS forged
  FROM (SELECT *, {hashed("text")} AS leaf, coalesce('=' || source, '') AS key FROM documents), crc),
rows_ AS MATERIALIZED (SELECT row_number() OVER () AS id, key, row_number() OVER (PARTITION BY key ORDER BY doc_id NULLS FIRST, leaf) - 1 AS r, doc_id, leaf, forged, count(*) OVER (PARTITION BY key) AS total FROM leaves),
first_ AS (SELECT key, r, leaf AS h, total FROM rows_),
{_climb_sql("own", "first_")},
subroots AS MATERIALIZED (SELECT key AS source_key, h AS subroot, '' AS key, h, row_number() OVER (ORDER BY key) - 1 AS r, count(*) OVER () AS total FROM own8),
top_first AS (SELECT key, r, h, total FROM subroots),
{_climb_sql("top", "top_first")},
start_ AS (SELECT id, key, r, coalesce(forged, leaf) AS x, '' AS said FROM rows_),
{_fold_sql("up", "own", "start_")},
middle AS (SELECT id, s.key, s.r, x, said FROM up9 JOIN subroots s ON s.source_key = up9.key),
{_fold_sql("last", "top", "middle")}
SELECT doc_id, leaf, subroot, top8.h AS root, sha256(said) AS proof_sha256, x AS folded_root, x = top8.h AS verified, CASE WHEN w.key <> '' THEN w.key[2:] END AS source, w.r AS place
FROM (SELECT rows_.*, last9.said, last9.x, subroots.subroot FROM rows_ JOIN last9 ON last9.id = rows_.id JOIN subroots ON subroots.source_key = rows_.key) w, top8"""


#: Positives and negatives of the anchors by the definition.
_NEGATIVES_SQL = """WITH v AS MATERIALIZED (SELECT row_number() OVER () AS k, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (SELECT a.k, a.vec_id AS anchor_id, a.label AS own, b.k AS other, b.vec_id, b.label, list_dot_product(a.v, b.v)::BIGINT AS score FROM v a JOIN v b ON a.k <> b.k AND len(a.v) = len(b.v) WHERE a.vec_id % 100 = 0),
p AS (SELECT * FROM s WHERE label = own QUALIFY row_number() OVER (PARTITION BY k ORDER BY score DESC, vec_id) <= 5),
n AS (SELECT p.anchor_id, p.vec_id AS positive_id, row_number() OVER (PARTITION BY p.k, p.other ORDER BY s.score DESC, s.vec_id)::INTEGER AS rank, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
  FROM p JOIN s ON s.k = p.k AND s.label <> p.own AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score)
SELECT * FROM n WHERE rank <= 5"""


#: SQL for DuckDB where SQL can express the operator; the others are tested against brute force in tests/llm.
ORACLES: dict[str, str] = {"op8_quality_rules": _quality_sql(), "op11_merkle_manifest": _merkle_sql(), "op13_hard_negatives": _NEGATIVES_SQL}
