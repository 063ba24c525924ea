"""Queries of the training-data operators, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrand.llm import codepairs, leaks, mix, neighbours, secrets, split, truncated
from lodestrand.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def _t(*names: str):
    return lambda s, d: [table(s, d, n) for n in names]


def queries() -> dict[str, Query]:
    code, vec, docs = _t("raw_data", "code_entities"), _t("event_vectors", "vectors_index"), _t("documents")
    leak, mixed, raw, items = _t("documents", "eval_items"), _t("documents", "mix_targets"), _t("raw_data"), _t("event_vectors")
    return {
        "p1_found": lambda s, d: codepairs.pairs_found(*code(s, d)),
        "p1_pairs": lambda s, d: codepairs.documented_pairs(*code(s, d)),
        "p3_found": lambda s, d: split.split_found(*items(s, d)),
        "p3_pieces": lambda s, d: split.split_items(*items(s, d)),
        "p3_rebuilt": lambda s, d: split.rebuilt(*items(s, d)),
        "p4_found": lambda s, d: neighbours.neighbours_found(*vec(s, d)),
        "p4_neighbours": lambda s, d: neighbours.neighbour_lists(*vec(s, d)),
        "p6_found": lambda s, d: secrets.secrets_found(*raw(s, d)),
        "p6_findings": lambda s, d: secrets.find_secrets(*raw(s, d)).distinct(),
        "p6_redacted": lambda s, d: secrets.redact_secrets(*raw(s, d)).distinct(),
        "p6_restored": lambda s, d: secrets.restored(*raw(s, d)).select("raw_id", "digest"),
        "p6_rules": lambda s, d: secrets.rule_counts(*raw(s, d)),
        "p7_found": lambda s, d: leaks.leaks_found(*leak(s, d)),
        "p7_items": lambda s, d: leaks.leaked_items(*leak(s, d)),
        "p8_selection": lambda s, d: mix.mix_selection(*mixed(s, d)),
        "p8_shares": lambda s, d: mix.mix_shares(*mixed(s, d)),
        "p8_balance": lambda s, d: mix.mix_balance(*mixed(s, d)),
        "p9_found": lambda s, d: truncated.truncated_found(*docs(s, d)),
        "p9_rates": lambda s, d: truncated.truncation_rates(*docs(s, d)).withColumn("rate", F.round("rate", 9)),
    }


# every eight words in a row of the documents and of the items
_LEAKS = r"""WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents), i AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM eval_items),
    dg AS (SELECT DISTINCT doc_id, array_to_string(w[p:p + 7], ' ') AS g FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 7)) AS p FROM d)),
    ig AS (SELECT DISTINCT item_id, array_to_string(w[p:p + 7], ' ') AS g FROM (SELECT item_id, w, unnest(generate_series(1, len(w) - 7)) AS p FROM i)) """


def oracle_sql() -> dict[str, str]:
    return {
        "p4_found": """
            WITH v AS (SELECT DISTINCT event_id || '#' || chunk_seq AS key, embedding::DOUBLE[] AS e FROM event_vectors WHERE len(embedding) = 64
                UNION SELECT 'vec#' || vec_rowid, embedding::DOUBLE[] FROM vectors_index WHERE len(embedding) = 64),
            g AS (SELECT key, e FROM v WHERE key IS NOT NULL AND list_dot_product(e, e) > 0 AND NOT isnan(list_sum(e)) AND NOT isinf(list_sum(e))),
            n AS (SELECT a.key AS x, b.key AS y, list_cosine_similarity(a.e, b.e) AS c FROM g a JOIN g b ON a.key <> b.key),
            t AS (SELECT x, y, c FROM (SELECT *, row_number() OVER (PARTITION BY x ORDER BY c DESC, y) AS r FROM n) WHERE r <= 10 AND c >= 0.9)
            SELECT DISTINCT least(x, y) AS key_a, greatest(x, y) AS key_b FROM t""",
        "p7_found": _LEAKS + "SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g)",
        "p7_items": _LEAKS + """, l AS (SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g))
            SELECT item_id, min(suite) AS suite, min(task) AS task, n_docs FROM (SELECT item_id, count(*) AS n_docs FROM l GROUP BY 1) JOIN eval_items USING (item_id) GROUP BY item_id, n_docs""",
        "p3_rebuilt": """
            SELECT event_id, CAST(chunk_seq AS BIGINT) AS chunk_seq, length(t) AS n_chars, md5(t) AS digest, TRUE AS within_limit, TRUE AS overlaps
            FROM (SELECT event_id, chunk_seq, min(chunk_text) AS t FROM event_vectors WHERE length(chunk_text) > 3200 GROUP BY 1, 2)""",
        "p6_restored": "SELECT DISTINCT id AS raw_id, md5(content) AS digest FROM raw_data WHERE id IS NOT NULL",
        "p8_balance": r"""
            WITH t AS (SELECT regexp_replace(lower(trim(source)), '[\s\-_]+', '_', 'g') AS source, sum(target_share) AS target_share FROM mix_targets WHERE source IS NOT NULL GROUP BY 1),
            d AS (SELECT DISTINCT regexp_replace(lower(trim(source)), '[\s\-_]+', '_', 'g') AS source, TRUE AS here FROM documents WHERE text <> '' AND source IS NOT NULL)
            SELECT source, round(target_share, 9) AS target_share, round(coalesce(CASE WHEN here THEN target_share END, 0) / sum(CASE WHEN here THEN target_share END) OVER (), 9) AS feasible_share, TRUE AS in_share, TRUE AS in_repeats
            FROM t LEFT JOIN d USING (source)""",
        "p3_found": """
            SELECT DISTINCT event_id, CAST(chunk_seq AS BIGINT) AS chunk_seq
            FROM event_vectors WHERE length(chunk_text) > 3200""",
    }
