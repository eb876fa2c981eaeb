"""The registered queries of this subpackage and their SQL, where SQL can express them.

Trained models, tokenizers, byte-exact spans and bootstrapping cannot be said in SQL; those queries are tested against
brute force, held-out labels or the library in tests/llm.
"""

from __future__ import annotations

from . import decontaminate, language_id, licenses, mixing, ngram_join, pii, quality, suffix_dedup, token_counts, toxicity

NGRAM_JACCARD = r"""
WITH RECURSIVE w AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \t\n\x0B\f\r]+') AS w FROM documents),
s AS MATERIALIZED (
    SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM w),
n AS MATERIALIZED (SELECT doc_id, CAST(len(s) AS BIGINT) AS n FROM s),
t AS MATERIALIZED (SELECT doc_id, unnest(s) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM t a JOIN t b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
u AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, root) AS (SELECT doc_id, doc_id FROM n UNION SELECT u.b, r.root FROM r JOIN u ON u.a = r.doc_id AND r.root < u.b)
SELECT n.doc_id, n.n AS n_shingles, min(r.root) AS component_id FROM n JOIN r ON r.doc_id = n.doc_id GROUP BY 1, 2
"""


def queries() -> dict:
    return {
        "op1_suffix_dedup": suffix_dedup.op1_suffix_dedup,
        "op2_language_id": language_id.op2_language_id,
        "op3_ngram_jaccard": ngram_join.op3_ngram_jaccard,
        "op4_quality_rules": quality.op4_quality_rules,
        "op5_mixing": mixing.op5_mixing,
        "op6_toxicity": toxicity.op6_toxicity,
        "op7_decontamination": decontaminate.op7_decontamination,
        "op8_license_scan": licenses.op8_license_scan,
        "op9_token_counts": token_counts.op9_token_counts,
        "op10_pii": pii.op10_pii,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_ngram_jaccard": NGRAM_JACCARD}
