"""Shared pieces of the DuckDB SQL: the article view and everything derived from it."""

from __future__ import annotations

from quillspark.functions import scores
from quillspark.functions.text import STOP_WORDS

STOPS = ", ".join(f"'{w}'" for w in STOP_WORDS)


def quoted(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


def case(values: dict, key: str, default) -> str:
    lines = " ".join(f"WHEN '{k}' THEN {v}" for k, v in values.items())
    return f"(CASE {key} {lines} ELSE {default} END)"


def number(x: str) -> str:
    """The expression as a double: DuckDB takes decimal literals otherwise."""
    return f"CAST({x} AS DOUBLE)"


TOKENS = f"list_filter(regexp_extract_all(lower(text), '[a-z0-9]{{2,}}'), lambda t: t NOT IN ({STOPS}))"
ARTICLES = f"""
lab AS (SELECT doc_id, max(quality) AS q FROM labels GROUP BY doc_id),
art AS (SELECT d.doc_id, 'doc-' || d.doc_id AS slug, array_to_string(({TOKENS})[1:8], ' ') AS title,
  [{quoted(scores.TYPES)}][CAST(d.doc_id % 8 + 1 AS INT)] AS type,
  CASE WHEN d.doc_id % 10 = 0 THEN 'superseded' WHEN d.doc_id % 10 = 1 THEN 'historical' ELSE 'current' END AS lifecycle,
  ['public', 'internal', 'confidential'][CAST(d.doc_id % 3 + 1 AS INT)] AS sensitivity,
  ['tutorial', 'how-to', 'reference', 'explanation'][CAST(d.doc_id % 4 + 1 AS INT)] AS doc_type,
  len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS body_words, d.doc_id % 20 AS retrieval_count,
  CAST(CASE q WHEN 1 THEN 0.9 WHEN 0 THEN 0.6 ELSE 0.8 END AS DOUBLE) AS confidence, lang, source, text AS body
  FROM documents d LEFT JOIN lab USING (doc_id))
"""
POSTINGS = f"""
tok AS (SELECT doc_id, unnest({TOKENS}) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM tok GROUP BY doc_id, term),
post AS (SELECT *, max(tf) OVER (PARTITION BY doc_id) AS max_tf FROM tf),
tot AS (SELECT count(*) AS n FROM documents),
df AS (SELECT term, count(*) AS df, any_value(n) AS n, ln(CAST(any_value(n) + 1 AS DOUBLE) / (count(*) + 1)) + 1 AS idf FROM post, tot GROUP BY term)
"""
KEYWORDS = (
    POSTINGS
    + """,
ks AS (SELECT doc_id, term, round(CAST(tf AS DOUBLE) / max_tf * idf, 9) AS s FROM post JOIN df USING (term) WHERE df >= 2 AND df <= CAST(0.2 AS DOUBLE) * n),
kw AS (SELECT doc_id, term AS kw FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s DESC, term) AS r FROM ks) WHERE r <= 10)
"""
)
TIERS = (
    KEYWORDS
    + """,
fr AS (SELECT kw, count(*) AS df, any_value(n) AS n, ln(CAST(any_value(n) + 1 AS DOUBLE) / (count(*) + 1)) + 1 AS idf FROM kw, tot GROUP BY kw),
t0 AS (SELECT doc_id, kw, idf, df >= ceil(sqrt(n)) AS s FROM kw JOIN fr USING (kw)),
t1 AS (SELECT *, min(CAST(s AS INT)) OVER (PARTITION BY doc_id) AS a, row_number() OVER (PARTITION BY doc_id ORDER BY idf DESC, kw) AS r FROM t0),
tier AS (SELECT doc_id, kw, idf, CASE WHEN s AND NOT (a = 1 AND r <= 3) THEN 'subject' ELSE 'article' END AS tier FROM t1)
"""
)
CANDIDATES = (
    TIERS
    + """,
w AS (SELECT doc_id, kw, tier, idf * CAST(CASE tier WHEN 'subject' THEN 0.6 ELSE 1.4 END AS DOUBLE) AS w FROM tier),
nm AS (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM w GROUP BY doc_id),
pr AS (SELECT x.doc_id AS a, y.doc_id AS b, sum(x.w * y.w) AS d, sum(CAST(x.tier = 'article' AND y.tier = 'article' AS INT)) AS na, sum(CAST(x.tier = 'subject' AND y.tier = 'subject' AS INT)) AS ns
  FROM w x JOIN w y ON x.kw = y.kw AND x.doc_id < y.doc_id GROUP BY 1, 2),
cand AS (SELECT a, b, round(d / (p.norm * q.norm), 9) AS score FROM pr JOIN nm p ON p.doc_id = a JOIN nm q ON q.doc_id = b WHERE na >= 1 OR ns >= 3),
cnd AS (SELECT * FROM cand WHERE score >= CAST(0.1 AS DOUBLE))
"""
)
_base = case(scores.TYPE_BASE, "type", scores.OTHER_BASE)
BUDGETS = f"""
imp AS (SELECT *, greatest(least(CAST(1.0 AS DOUBLE) + CAST(CASE WHEN confidence >= 0.9 THEN 0.2 ELSE 0 END AS DOUBLE) + CAST(CASE WHEN retrieval_count >= 10 THEN 0.2 ELSE 0 END AS DOUBLE)
  - CAST(CASE WHEN lifecycle = 'superseded' THEN 0.5 ELSE 0 END AS DOUBLE), CAST(1.5 AS DOUBLE)), CAST(0.5 AS DOUBLE)) AS imp FROM art),
bud AS (SELECT doc_id, CAST(least(greatest(round_even({_base} * greatest(least(CAST(0.5 AS DOUBLE) + CAST(body_words AS DOUBLE) / 600, CAST(1.25 AS DOUBLE)), CAST(0.5 AS DOUBLE)) * imp, 0), 3), 20) AS INT) AS budget FROM imp)
"""
MUTUAL = (
    "WITH "
    + ARTICLES
    + ","
    + CANDIDATES
    + ","
    + BUDGETS
    + """,
bo AS (SELECT a AS doc_id, b AS other, score FROM cnd UNION ALL SELECT b, a, score FROM cnd),
rk AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, 'doc-' || other) AS rank FROM bo),
mut AS (SELECT least(doc_id, other) AS a, greatest(doc_id, other) AS b FROM rk JOIN bud USING (doc_id) WHERE rank <= budget GROUP BY 1, 2 HAVING count(*) = 2)
"""
)
MERGES = """
mz AS (SELECT doc_id, count(*) AS na, count(*) FILTER (WHERE tier = 'article') AS ma FROM tier GROUP BY doc_id),
mp AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS ia, count(*) FILTER (WHERE x.tier = 'article' AND y.tier = 'article') AS im FROM tier x JOIN tier y ON x.kw = y.kw AND x.doc_id < y.doc_id GROUP BY 1, 2),
mq AS (SELECT a, b, CASE WHEN p.ma + q.ma - im > 0 THEN CAST(im AS DOUBLE) / (p.ma + q.ma - im) ELSE 0 END AS j, CAST(ia AS DOUBLE) / least(p.na, q.na) AS r FROM mp JOIN mz p ON p.doc_id = a JOIN mz q ON q.doc_id = b),
mrg AS (SELECT a, b, round(greatest(j, r), 2) AS ratio FROM mq WHERE j >= CAST(0.7 AS DOUBLE) OR r > CAST(0.8 AS DOUBLE))
"""
