"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

from quillon.llm import quality, urls
from quillon.llm.licences import COPYRIGHT_LINE, KNOWN, KNOWN_DIGESTS, SPELLINGS, canonical_text


def _quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _canonical(text: str) -> str:
    out = f"lower(regexp_replace({text}, {_quoted(COPYRIGHT_LINE)}, '', 'g'))"
    for old, new in SPELLINGS:
        out = f"replace({out}, {_quoted(old)}, {_quoted(new)})"
    return rf"trim(regexp_replace({out}, '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"


_MORE = ", ".join(f"({_quoted(licence)}, {_quoted(digest)})" for licence, digest in KNOWN_DIGESTS)
_KNOWN = ", ".join(f"({_quoted(licence)}, {_quoted(canonical_text(text))})" for licence, text in KNOWN)

LICENCES = f"""
WITH known AS (SELECT digest, min(licence) AS licence FROM (SELECT licence, sha256(text) AS digest FROM (VALUES {_KNOWN}) v(licence, text) UNION ALL FROM (VALUES {_MORE}) w(licence, digest)) GROUP BY 1),
rows AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
lines AS (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM rows),
found AS (SELECT rid, string_agg(DISTINCT licence, ',' ORDER BY licence) AS notices, count(*) AS n_notices
  FROM (SELECT rid, sha256({_canonical("line")}) AS digest FROM lines) JOIN known USING (digest) GROUP BY rid)
SELECT r.doc_id, sha256({_canonical("r.text")}) AS text_digest, k.licence AS text_licence, coalesce(f.notices, '') AS notices, coalesce(f.n_notices, 0)::BIGINT AS n_notices
FROM rows r LEFT JOIN known k ON k.digest = sha256({_canonical("r.text")}) LEFT JOIN found f ON f.rid = r.rid
"""

_SPACE = r"[^\x20\x09-\x0D]"


def _quality(alpha: float = 0.05, delta: float = 0.05) -> str:
    """All of the quality rules: counts, metrics, the ladder's tests with exact binomial tails, and verdicts."""
    rate = lambda part, whole: f"CASE WHEN {whole} > 0 THEN ({part})::DOUBLE / {whole} ELSE 0 END"
    rejected = " OR ".join(f"{m} > CASE step {' '.join(f'WHEN {k} THEN {c}::DOUBLE' for k, c in enumerate(ladder, 1))} END" for m, ladder in quality.LADDERS.items())
    ladders = ", ".join(f"[{', '.join(map(str, ladder))}]::DOUBLE[] AS c_{m}" for m, ladder in quality.LADDERS.items())
    above = " OR ".join(f"{m} > c_{m}[step]" for m in quality.LADDERS)
    log = "lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1)"
    term = f"exp(CASE WHEN i = 0 OR i = n THEN 0 ELSE {log} END + i * ln({alpha}::DOUBLE) + (n - i) * ln(1 - {alpha}::DOUBLE))"
    strata = ", ".join(f"'{x}'" for x in quality.STRATA)
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id::BIGINT AS doc_id, CASE WHEN lang IN ({strata}) THEN lang ELSE 'other' END AS stratum, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, doc_id, stratum, regexp_extract_all(text, '{_SPACE}+') AS w, list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '{_SPACE}')) AS l,
  len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, len(regexp_extract_all(text, '\p{{Lu}}')) AS upper FROM d),
g AS (SELECT rid, x.i AS i, count(*) OVER (PARTITION BY rid, x.g) AS n FROM (SELECT rid, unnest(list_transform(range(1, len(w) - 6), lambda k: {{'i': k, 'g': md5(array_to_string(w[k : k + 7], ' '))}})) AS x FROM w WHERE len(w) >= 8)),
r AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + 8)) AS p FROM g WHERE n > 1) GROUP BY rid),
c AS (SELECT w.rid, doc_id, stratum, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words,
  upper, len(l) AS n_lines, len(list_distinct(w)) AS kinds, len(list_filter(w, lambda x: right(x, 1) IN ('!', '?'))) AS bang FROM w LEFT JOIN r USING (rid)),
m AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, {rate("n_symbols", "n_words")} AS symbol_rate, {rate("upper", "word_chars")} AS upper_rate, {rate("bang", "n_words")} AS bang_rate,
  {rate("n_repeat_words", "n_words")} AS repeat_rate, {rate("n_dup_lines", "n_lines")} AS dup_line_rate, CASE WHEN n_words > 0 THEN 1 - kinds / sqrt((n_words * greatest(n_words, 100))::DOUBLE) ELSE 0 END AS sameness FROM c),
y AS (SELECT doc_id::BIGINT AS doc_id, min(quality) AS good FROM labels WHERE quality IS NOT NULL AND doc_id IS NOT NULL GROUP BY 1),
j AS (SELECT stratum, good >= 1 AS good, step, {rejected} AS rejected FROM m JOIN y USING (doc_id), (SELECT unnest(range(1, {quality.STEPS + 1})) AS step) WHERE NOT base_failed),
t AS (SELECT stratum, step, count(*) FILTER (good) AS n, count(*) FILTER (good AND rejected) AS lost, count(*) FILTER (NOT good AND rejected) AS caught FROM j GROUP BY stratum, step),
b AS (SELECT stratum, step, n, lost, caught, unnest(range(0, lost + 1)) AS i FROM t),
e AS (SELECT stratum, step, caught - 5 * lost AS gain, lost <= {alpha} * n AND sum({term}) <= {delta / (len(quality.STRATA) + 1)} AS ok FROM b GROUP BY stratum, step, n, lost, caught),
o AS (SELECT *, bool_and(ok) OVER (PARTITION BY stratum ORDER BY step) AS valid FROM e),
h AS (SELECT stratum, arg_min(step, -gain * 1000 + step) AS step FROM o WHERE valid AND gain > 0 GROUP BY stratum)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
  NOT base_failed AND NOT (step IS NOT NULL AND ({above})) AS kept, m.stratum FROM m LEFT JOIN h USING (stratum), (SELECT {ladders})"""


def _urls(loss: float = 0.001) -> str:
    """All of the URL verdicts: rules, word labels, both Markov models, the cutoff and the scores."""
    order, base = urls.ORDER, 1.0 / (len(urls.ALPHABET) + 3)
    host = r"CASE WHEN contains(url, '://') THEN lower(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1)) ELSE '' END"
    path = r"CASE WHEN contains(url, '://') THEN regexp_extract(url, '(?s)^.*?://[^/?#]*(/[^?#]*)?', 1) ELSE '' END"
    fits = [(r, v, *r.partition("/")) for v, r in sorted(urls.RULES, key=lambda x: -len(x[1]))]
    rule = " ".join(f"WHEN (host = '{name}' OR ends_with(host, '.{name}')) AND starts_with(path, '/{rest}') THEN '{r}'" for r, _, name, _, rest in fits)
    verdict = " ".join(f"WHEN '{r}' THEN '{v}'" for v, r in urls.RULES)
    words = "|".join(urls.REJECTED_WORDS)
    spelled = f"'{'^' * order}' || regexp_replace(lower(url), '[^a-z0-9./:?#=&%+_-]', '~', 'g') || '$'"
    seen, steps, ratio = [], "c", []
    for k in range(order + 1):
        seen.append(f"""s{k} AS (SELECT right(g, {k + 1}) AS tail, sum(n0) AS x0, sum(n1) AS x1 FROM c GROUP BY 1),
t{k} AS (SELECT left(tail, {k}) AS context, sum(x0) AS s0, sum(x1) AS s1, count(*) FILTER (x0 > 0) AS d0, count(*) FILTER (x1 > 0) AS d1 FROM s{k} GROUP BY 1),
p{k} AS (SELECT tail, x0 AS x0_{k}, x1 AS x1_{k}, s0 AS s0_{k}, s1 AS s1_{k}, d0 AS d0_{k}, d1 AS d1_{k} FROM s{k} JOIN t{k} ON context = left(tail, {k}))""")
        steps += f" JOIN p{k} ON p{k}.tail = right(g, {k + 1})"
    for y in (0, 1):
        p = f"{base!r}::DOUBLE"
        for k in range(order + 1):
            p = f"(CASE WHEN s{y}_{k} > 0 THEN (x{y}_{k} + d{y}_{k} * {p}) / (s{y}_{k} + d{y}_{k}) ELSE {p} END)"
        ratio.append(f"ln({p})")
    grams = lambda source, keep: f"(SELECT {keep}, unnest(list_transform(range(1, length(s) - {order} + 1), lambda i: s[i : i + {order}])) AS g FROM {source})"
    return rf"""
WITH u AS (SELECT row_number() OVER () AS id, page_id::BIGINT AS page_id, coalesce(url, '') AS url FROM pages),
r AS (SELECT id, page_id, url, host, path, CASE {rule} END AS rule, CASE WHEN url <> '' THEN {spelled} ELSE '' END AS s FROM (SELECT *, {host} AS host, {path} AS path FROM u)),
m AS (SELECT row_number() OVER () AS id, s, host, rejected, ('0x' || substr(md5(host), 1, 8))::BIGINT % {urls.FOLDS} = 0 AS held
  FROM (SELECT DISTINCT s, url, host, CASE WHEN regexp_matches(host, '(^|[.-])({words})([.-]|$)') THEN 1 ELSE 0 END AS rejected FROM r WHERE contains(url, '://')) WHERE host <> ''),
n AS (SELECT g, count(*) FILTER (rejected = 0) AS n0, count(*) FILTER (rejected = 1) AS n1 FROM {grams("m WHERE NOT held", "rejected")} GROUP BY g),
a AS (SELECT DISTINCT g FROM (SELECT g FROM {grams("r WHERE s <> ''", "id")} UNION ALL SELECT g FROM {grams("m", "id")})),
c AS (SELECT g, coalesce(n0, 0) AS n0, coalesce(n1, 0) AS n1 FROM a LEFT JOIN n USING (g)), two AS (SELECT sum(n0) > 0 AND sum(n1) > 0 AS ok FROM c),
{", ".join(seen)}, l AS (SELECT g, {ratio[1]} - {ratio[0]} AS ratio FROM {steps}),
h AS (SELECT floor(score * {urls.GRID}) AS k, count(*) AS n FROM (SELECT id, round(avg(ratio), 9) AS score FROM {grams("m WHERE held AND rejected = 0", "id")} JOIN l USING (g) GROUP BY id) GROUP BY 1),
q AS (SELECT coalesce(min(k) FILTER (a <= {loss} * t), 0) AS most FROM (SELECT k, coalesce(sum(n) OVER (ORDER BY k DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a, sum(n) OVER () AS t FROM h)),
e AS (SELECT id, round(avg(ratio), 9) AS score FROM {grams("r WHERE s <> ''", "id")} JOIN l USING (g) GROUP BY id),
f AS (SELECT r.*, CASE WHEN ok THEN e.score ELSE 0 END AS score, CASE WHEN ok THEN most ELSE 0 END AS most FROM r LEFT JOIN e USING (id), two, q)
SELECT page_id, host, path, rule, coalesce(CASE rule {verdict} END, CASE WHEN floor(score * {urls.GRID}) > most THEN 'block' ELSE 'allow' END) AS verdict, round(coalesce(score, 0), 6)::DOUBLE AS score FROM f"""


def _clusters(k: int = 8, rounds: int = 10, dim: int = 64, scale: int = 1024, seed: int = 3) -> str:
    """All rounds of assignment and of floored means, each a table of its own."""
    nearest = lambda c: f"SELECT vec_id, v, arg_min(c, {{'d': d, 'c': c}}) AS c, min(d) AS d FROM (SELECT rid, vec_id, v, c, list_sum(list_transform(range(1, {dim + 1}), lambda i: ((v[i] - w[i]) * (v[i] - w[i]))::HUGEINT))::BIGINT AS d FROM x, {c}) GROUP BY rid, vec_id, v"
    floor = "((s - ((s % n) + n) % n) // n)::BIGINT"
    steps = [f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v AS w FROM (SELECT v, sha256('{seed}:' || coalesce(vec_id::VARCHAR, '')) AS h FROM x ORDER BY h, v LIMIT {k}))"]
    for r in range(rounds):
        steps.append(f"a{r} AS MATERIALIZED ({nearest(f'c{r}')})")
        steps.append(f"m{r} AS (SELECT c, list({floor} ORDER BY i) AS w FROM (SELECT c, i, sum(e) AS s, count(*) AS n FROM (SELECT c, unnest(v) AS e, unnest(range(1, {dim + 1})) AS i FROM a{r}) GROUP BY c, i) GROUP BY c)")
        steps.append(f"c{r + 1} AS MATERIALIZED (SELECT c, coalesce(m{r}.w, c{r}.w) AS w FROM c{r} LEFT JOIN m{r} USING (c))")
    return f"""
WITH x AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda e: floor(e::DOUBLE * {scale})::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e::DOUBLE) OR abs(e::DOUBLE) >= 4503599627370496)) = 0), {", ".join(steps)}, a AS MATERIALIZED ({nearest(f"c{rounds}")})
SELECT vec_id, a.c::INTEGER AS cluster, d AS distance, sum(d) OVER (PARTITION BY a.c)::BIGINT AS cluster_inertia, sum(d) OVER ()::BIGINT AS inertia, sha256(array_to_string(w, ',')) AS centroid_sha256 FROM a JOIN c{rounds} USING (c)"""


#: Words of the documents in seeded order, targets by levels of size over weight, seats by rank of their quotients, spans around the end.
MIXING = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5('11:' || coalesce(doc_id::VARCHAR, '')) AS key FROM documents),
s AS (SELECT source, size, [3, 1, 2][(no - 1) % 3 + 1] AS w, no FROM (SELECT source, sum(size)::BIGINT AS size, row_number() OVER (ORDER BY source NULLS LAST) AS no FROM d GROUP BY source)),
r AS (SELECT *, 1.5::DOUBLE * sum(size) OVER () - coalesce(sum(2 * size) OVER (ORDER BY size::DOUBLE / w, no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest, sum(w) OVER (ORDER BY size::DOUBLE / w, no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open FROM s),
l AS (SELECT coalesce(arg_min(rest / open, {'a': size::DOUBLE / w, 'b': no}) FILTER (rest * w / open <= 2 * size), 0) AS level FROM r),
t AS (SELECT source, size, no, least(level * w, 2 * size)::DOUBLE AS target, floor(least(level * w, 2 * size) + 0.5)::BIGINT AS votes FROM s, l),
b AS (SELECT coalesce(list_filter([4096, 2048, 1024, 512, 256, 128, 64, 32, 16, 8, 4, 2, 1], lambda x: x * 256 <= coalesce(lowest, 0))[1], 1)::BIGINT AS block FROM (SELECT min(votes) FILTER (votes > 0) AS lowest FROM t)),
n AS (SELECT t.*, block, ((size + block - 1) // block)::BIGINT AS n FROM t, b),
q AS (SELECT no, unnest(range(0, 2 * n)) AS j, votes FROM n WHERE votes > 0),
a AS (SELECT no, count(*) AS q FROM (SELECT no, row_number() OVER (ORDER BY votes::DOUBLE / (2 * j + 1) DESC, no, j) AS seat FROM q) WHERE seat <= (SELECT (2 * sum(votes) + min(block)) // (2 * min(block)) FROM n) GROUP BY no),
f AS (SELECT n.*, coalesce(q, 0)::BIGINT AS q, CASE WHEN n > 0 THEN ('0x' || substr(md5('11:' || coalesce(source, '')), 1, 8))::BIGINT % n ELSE 0 END AS start FROM n LEFT JOIN a USING (no)),
g AS (SELECT *, CASE WHEN n > 0 THEN q // n ELSE 0 END AS full_, CASE WHEN n > 0 THEN q % n ELSE 0 END AS part FROM f),
p AS (SELECT d.*, coalesce(sum(size) OVER (PARTITION BY source ORDER BY key, doc_id, size, rid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS place FROM d)
SELECT doc_id, p.size, g.size AS source_size, target, (full_ * p.size + greatest(0, least(place + p.size, (start + part) * block, g.size) - greatest(place, start * block)) + greatest(0, least(place + p.size, (start + part - n) * block) - place))::BIGINT AS taken
FROM p JOIN g ON p.source IS NOT DISTINCT FROM g.source"""

DIVERGENCE = r"""
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
x AS (SELECT rid, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS MATERIALIZED (SELECT lang, term, count(*) AS c FROM x GROUP BY lang, term HAVING count(DISTINCT rid) >= 3),
v AS (SELECT lang, count(*) AS v, sum(c) AS n FROM k GROUP BY lang), g AS (SELECT DISTINCT lang, source FROM d),
c AS MATERIALIZED (SELECT lang, source, term, count(*) AS c FROM x SEMI JOIN k USING (lang, term) GROUP BY ALL), n AS (SELECT lang, source, sum(c) AS n FROM c GROUP BY ALL),
p AS MATERIALIZED (SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c, 1 + (1000000000::HUGEINT * (coalesce(c.c, 0) + 1)) // (coalesce(n.n, 0) + v.v)::HUGEINT AS p
  FROM g JOIN v USING (lang) JOIN k USING (lang) LEFT JOIN n USING (lang, source) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
s AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
q AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (c + 1)) // (n + v)::HUGEINT AS q FROM k JOIN v USING (lang)),
term AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q) // q)::BIGINT AS value FROM p JOIN q USING (lang, term) WHERE c > 0 AND p > q)
SELECT lang, source, part, item, value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item))::INTEGER AS rank FROM (FROM pair UNION ALL FROM term) QUALIFY part = 'pair' OR rank <= 200"""


ORACLE_SQL: dict[str, str] = {
    "op11_clusters": _clusters(), "op12_mixing": MIXING, "op13_divergence": DIVERGENCE,
    "op3_licence_scan": LICENCES, "op6_url_filter": _urls(), "op10_quality_rules": _quality(),
}
