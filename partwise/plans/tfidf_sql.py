"""SQL text of TF-IDF, for checks: term tables, weights and cosine by plain aggregation."""

from __future__ import annotations

from partwise.functions.text import SEGMENTS
from partwise.functions.tfidf import Vectoriser


def grams(name: str, source: str, v: Vectoriser) -> str:
    """``source`` selects (id, text); the result is <name>(id, term, tf)."""
    words = f"regexp_extract_all(lower(text), '{v.pattern}')"
    if v.pattern == SEGMENTS:
        found = "regexp_extract_all(lower(text), '[一-鿿]{2,}|[\\p{Latin}\\p{Greek}\\p{Cyrillic}\\p{N}_]{2,}')"
        words = f"flatten([CASE WHEN regexp_matches(r, '^[一-鿿]') THEN [r[i:i+1] FOR i IN range(1, length(r))] ELSE [r] END FOR r IN {found}])"
    parts = [f"SELECT id, unnest(w) AS term FROM {name}_w"]
    for k in range(2, v.longest + 1):
        run = " || ' ' || ".join("w[i]" if j == 0 else f"w[i + {j}]" for j in range(k))
        parts.append(f"SELECT id, unnest([{run} FOR i IN range(1, len(w) - {k - 2})]) FROM {name}_w WHERE len(w) >= {k}")
    return (f"{name}_w AS (SELECT id, {words} AS w FROM ({source})), "
            f"{name} AS (SELECT id, term, count(*) AS tf FROM ({' UNION ALL '.join(parts)}) GROUP BY 1, 2)")


def vocabulary(name: str, counts: str, rows: str, v: Vectoriser) -> str:
    limit = f" QUALIFY row_number() OVER (ORDER BY cf DESC, term) <= {v.max_features}" if v.max_features else ""
    return (f"{name} AS (SELECT term, ln((1 + ({rows})) / (1 + df)) + 1 AS idf FROM "
            f"(SELECT term, count(*) AS df, sum(tf) AS cf FROM {counts} GROUP BY 1){limit})")


def weights(name: str, counts: str, vocab: str) -> str:
    return (f"{name} AS (SELECT id, term, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY id)) AS w "
            f"FROM {counts} JOIN {vocab} USING (term))")


def cosine(new: str, master: str, master_rows: str, v: Vectoriser) -> str:
    """CTEs ending in cos(new_id, master_id, s) over pairs that share a term."""
    return ", ".join([
        grams("m_tf", master, v), vocabulary("voc", "m_tf", master_rows, v), weights("m_w", "m_tf", "voc"),
        grams("n_tf", new, v), weights("n_w", "n_tf", "voc"),
        "cos AS (SELECT n_w.id AS new_id, m_w.id AS master_id, round(sum(n_w.w * m_w.w), 9) AS s FROM n_w JOIN m_w USING (term) GROUP BY 1, 2)",
    ])


def ratio(name: str, pairs: str) -> str:
    """Recursive CTEs ending in <name>(a, b, ratio): the matching-blocks ratio of the distinct pairs (a, b) of ``pairs``.

    A step takes the longest common piece of two strings, the earliest in the first and then in
    the second one, and leaves what lies before and behind it.
    """
    piece = "list_min(flatten([[CASE WHEN contains(y, substr(x, i, n)) THEN {'less': -n, 'i': i} END FOR n IN range(1, length(x) - i + 2)] FOR i IN range(1, length(x) + 1)]))"
    return f"""{name}_b AS (SELECT a, b, a AS x, b AS y, 0::BIGINT AS k FROM ({pairs}) UNION ALL
 SELECT a, b, unnest([substr(x, 1, i - 1), substr(x, i + n)]), unnest([substr(y, 1, j - 1), substr(y, j + n)]), unnest([n, 0]) FROM (
  SELECT *, strpos(y, substr(x, i, n)) AS j FROM (SELECT *, m.i AS i, -m.less AS n FROM (SELECT *, {piece} AS m FROM {name}_b WHERE x <> '' AND y <> '') WHERE m IS NOT NULL))),
{name} AS (SELECT a, b, 2.0::DOUBLE * sum(k) / (length(a) + length(b)) AS ratio FROM {name}_b GROUP BY a, b)"""
