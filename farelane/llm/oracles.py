"""DuckDB SQL with the rows of the queries that SQL can express."""

from __future__ import annotations

import re

from farelane.llm import licenses
from farelane.llm.common import LOWER, UPPER

_TEXT = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"

NEAR_DEDUP = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_TEXT}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, sh FROM (SELECT doc_id, unnest(CASE WHEN len(w) >= 2 THEN list_transform(range(1, len(w)), lambda i: concat(w[i], ' ', w[i + 1])) ELSE w END) AS sh FROM w) x),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both_have FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * both_have >= 80 * (x.n + y.n - both_have)),
reach AS (SELECT doc_id AS d, doc_id AS o FROM documents UNION SELECT r.d, l.b FROM reach r JOIN links l ON l.a = r.o)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, c.least AS component_id, w.doc_id = c.least AS kept
FROM w LEFT JOIN n ON n.doc_id = w.doc_id JOIN (SELECT d, min(o) AS least FROM reach GROUP BY d) c ON c.d = w.doc_id
"""


def _templates() -> str:
    rows = []
    for k, (text, label) in enumerate(licenses.TEMPLATES):
        words = ", ".join(f"'{w.lower()}'" for w in re.findall(r"[0-9A-Za-z]+", text))
        rows.append(f"({k}, '{label}', {str(k < len(licenses.PHRASES)).lower()}, [{words}])")
    return ", ".join(rows)


LICENSES = rf"""
WITH w AS (SELECT doc_id, regexp_extract_all({_TEXT}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT template, label, exact, len(tw) - 2 AS n, unnest(range(0, len(tw) - 2)) AS gram, tw FROM (VALUES {_templates()}) AS v(template, label, exact, tw)),
tg AS (SELECT template, label, exact, n, gram, concat(tw[gram + 1], ' ', tw[gram + 2], ' ', tw[gram + 3]) AS g FROM t),
r AS (SELECT doc_id, i AS place, concat(w[i + 1], ' ', w[i + 2], ' ', w[i + 3]) AS g FROM (SELECT doc_id, w, unnest(range(0, greatest(len(w) - 2, 0))) AS i FROM w) x),
v AS (SELECT doc_id, template, place - gram AS diagonal, list(DISTINCT gram) AS votes, min(place) AS f, max(place) + 2 AS l, any_value(n) AS n, any_value(exact) AS exact, any_value(label) AS label FROM r JOIN tg ON r.g = tg.g GROUP BY doc_id, template, place - gram),
q AS (SELECT *, lag(diagonal) OVER (PARTITION BY doc_id, template ORDER BY diagonal) AS before FROM v),
i AS (SELECT *, sum(CASE WHEN exact OR before IS NULL OR diagonal - before > {licenses.SLACK} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, template ORDER BY diagonal) AS island FROM q),
m AS (SELECT doc_id, template, island, CAST(len(list_distinct(flatten(list(votes)))) AS DOUBLE) / any_value(n) AS coverage, min(f) AS f, max(l) AS l, any_value(n) AS n, any_value(exact) AS exact, any_value(label) AS label FROM i GROUP BY doc_id, template, island),
k AS (SELECT * FROM m WHERE exact AND coverage = 1 OR NOT exact AND coverage >= {licenses.COVERED} AND l - f < {licenses.STRETCH} * (n + 2)),
d AS (SELECT doc_id, count(*) FILTER (WHERE exact) AS n_base, min(f) FILTER (WHERE exact) AS first_word, max(f) FILTER (WHERE exact) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE exact) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(coverage) AS score FROM k GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0e0) AS score FROM w LEFT JOIN d ON d.doc_id = w.doc_id
"""
