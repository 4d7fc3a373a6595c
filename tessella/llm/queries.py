"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

from importlib import import_module

#: query name -> module of this package that holds the function of the same name
MODULES = {
    "op1_topk": "topk",
    "op2_extract": "extract",
    "op3_language": "language",
    "op4_toxicity": "toxicity",
    "op5_sentencepiece": "pieces",
    "op6_mixing": "mixing",
    "op7_pii": "pii",
    "op8_token_codes": "token_codes",
    "op9_ngram_join": "jaccard",
    "op10_ann": "ann",
    "op11_simhash": "simhash",
    "op12_periods": "periods",
    "op13_merkle": "merkle",
}


def queries() -> dict:
    return {name: getattr(import_module(f"tessella.llm.{module}"), name) for name, module in MODULES.items()}


OP9_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])
  WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
p AS (SELECT a.doc_id AS x, b.doc_id AS y FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
r(x, y) AS (SELECT x, y FROM p UNION SELECT r.x, p.y FROM r JOIN p ON r.y = p.x),
c AS (SELECT x, min(y) AS m FROM r GROUP BY x)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, least(doc_id, coalesce(m, doc_id)) AS component_id FROM s LEFT JOIN c ON doc_id = x
"""


def oracle_sql() -> dict[str, str]:
    from tessella.llm.merkle import OP13_SQL
    from tessella.llm.topk import OP1_SQL

    return {"op1_topk": OP1_SQL, "op9_ngram_join": OP9_SQL, "op13_merkle": OP13_SQL}
