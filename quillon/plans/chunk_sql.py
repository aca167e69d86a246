"""DuckDB SQL of the chunking queries, with chunks of at most 200 words, 20 at least and 25 of overlap."""

from __future__ import annotations

_GAP = "chr(10) || chr(10)"
_WORDS = r"regexp_extract_all({}, '[^ \t\n\r\x0b\x0c]+')"
_STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
_HEADING = r"(?i)^(#{1,4}\s+|(chapter|section|part|appendix)\s+\d+[.:]?\s*)"

_TEXTS = f"t AS (SELECT doc_id, '# Part ' || (doc_id % 5) || {_GAP} || replace(text, chr(10), {_GAP}) AS text FROM documents WHERE text IS NOT NULL)"
_PARTS = rf"""p AS (SELECT doc_id, unnest(ps) AS p, generate_subscripts(ps, 1) AS i FROM (SELECT doc_id, string_split_regex({_STRIP.format("text")}, '\n\s*\n') AS ps FROM t)),
s AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM (SELECT *, len({_WORDS.format("p")}) AS n, regexp_matches({_STRIP.format("p")}, '{_HEADING}') AS h FROM p))"""
#: From ``raw(doc_id, g, text)``, chunks in order of g: the short ones go to the one before.
_JOINED = f"""c AS (SELECT *, len({_WORDS.format("text")}) AS n FROM raw), k AS (SELECT *, sum(CASE WHEN g = 1 OR n >= 20 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY g) AS m FROM c)
SELECT doc_id, (min(g) - 1)::INTEGER AS "index", md5(string_agg(text, {_GAP} ORDER BY g)) AS text_hash, sum(n)::INTEGER AS word_count FROM k GROUP BY doc_id, m"""


def _sentences(source: str) -> str:
    """``z(doc_id, i, g, text)``: sentences of ``source(doc_id, i, p)`` packed up to 200 words, in order of g."""
    return rf"""q AS (SELECT doc_id, i, unnest(ss) AS x, generate_subscripts(ss, 1) AS j FROM (SELECT doc_id, i, string_split(regexp_replace(p, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS ss FROM {source})),
qn AS (SELECT *, len({_WORDS.format("x")}) AS n FROM q),
y AS (SELECT doc_id, i, j, x, n AS held, 1 AS g FROM qn WHERE j = 1
  UNION ALL SELECT b.doc_id, b.i, b.j, b.x, CASE WHEN y.held + b.n > 200 THEN b.n ELSE y.held + b.n END, CASE WHEN y.held + b.n > 200 THEN y.g + 1 ELSE y.g END FROM y JOIN qn b ON b.doc_id = y.doc_id AND b.i = y.i AND b.j = y.j + 1),
z AS (SELECT doc_id, i, g, string_agg(x, ' ' ORDER BY j) AS text FROM y GROUP BY ALL)"""


SEMANTIC = f"""WITH RECURSIVE {_TEXTS}, {_PARTS},
f AS (SELECT doc_id, i, n AS held, 1 AS g, 0 AS tail FROM s WHERE i = 1
  UNION ALL SELECT s.doc_id, s.i, CASE WHEN s.h AND f.held > 0 THEN s.n WHEN f.held + s.n > 200 THEN s.n + CASE WHEN f.held > 25 THEN 25 ELSE 0 END ELSE f.held + s.n END,
    CASE WHEN s.h AND f.held > 0 OR f.held + s.n > 200 THEN f.g + 1 ELSE f.g END, CASE WHEN NOT (s.h AND f.held > 0) AND f.held + s.n > 200 AND f.held > 25 THEN 25 ELSE 0 END
  FROM f JOIN s ON s.doc_id = f.doc_id AND s.i = f.i + 1),
o AS (SELECT f.doc_id, f.g, string_agg(s.p, {_GAP} ORDER BY f.i) AS own, max(f.tail) AS tail, min(s.before) AS before FROM f JOIN s USING (doc_id, i) GROUP BY ALL),
raw AS (SELECT o.doc_id, o.g, CASE WHEN tail > 0 THEN array_to_string({_WORDS.format("t.text")}[before - 24 : before], ' ') || {_GAP} || own ELSE own END AS text FROM o JOIN t USING (doc_id)), {_JOINED}"""

PARAGRAPH = f"""WITH RECURSIVE {_TEXTS}, {_PARTS}, long AS (SELECT doc_id, i, p FROM s WHERE n > 200), {_sentences("long")},
w AS (SELECT *, coalesce(count(*) FILTER (n >= 50 AND n <= 200) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS fits FROM s),
e AS (SELECT doc_id, coalesce(max(i) FILTER (n >= 50), 1000000000) AS i, 1 AS g, string_agg(p, {_GAP} ORDER BY i) AS text FROM w WHERE n <= 200 GROUP BY doc_id, fits UNION ALL SELECT doc_id, i, g, text FROM z),
raw AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i, g) AS g, text FROM e), {_JOINED}"""

RECURSIVE = rf"""WITH RECURSIVE {_TEXTS}, a AS (SELECT doc_id, 1 AS i, {_STRIP.format("regexp_replace(text, '" + _HEADING + "', '')")} AS p FROM t), n AS (SELECT *, len({_WORDS.format("p")}) AS n FROM a),
long AS (SELECT doc_id, i, p FROM n WHERE n > 200), {_sentences("long")},
e AS (SELECT doc_id, 1 AS g, '#' || {_GAP} || p AS text FROM n WHERE n + 1 <= 200 UNION ALL SELECT doc_id, 1, '#' FROM n WHERE n + 1 > 200
  UNION ALL SELECT doc_id, 2, p FROM n WHERE n = 200 UNION ALL SELECT doc_id, g + 1, text FROM z),
b AS (SELECT *, lag({_WORDS.format("text")}) OVER (PARTITION BY doc_id ORDER BY g) AS last FROM e),
o AS (SELECT doc_id, g, CASE WHEN len(last) > 25 THEN array_to_string(last[len(last) - 24 : len(last)], ' ') || chr(10) || text ELSE text END AS text FROM b),
u AS (SELECT *, sum(CASE WHEN g = 1 OR len({_WORDS.format("text")}) >= 20 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY g) AS m FROM o),
raw AS (SELECT doc_id, m AS g, string_agg(text, chr(10) ORDER BY u.g) AS text FROM u GROUP BY doc_id, m), {_JOINED}"""
