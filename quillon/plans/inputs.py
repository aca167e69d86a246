"""Inputs that queries derive from the document table, in Spark and, word for word, in SQL.

The tables hold plain prose, so units, headings and dirt are put in by rule: by doc_id modulo some number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import vocabulary as V
from quillon.operators import knowledge, skills

PREFIXES = ("Best Practice: ", "Avoid: ", "Step 3: ", "Rule 2: ", "Example: ", "Strategy: ", "Always ")
KEYWORDS = tuple(k for k, _ in V.TAG_KEYWORDS)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _pick(values: tuple[str, ...], key: str | Column = "doc_id") -> Column:
    key = F.col(key) if isinstance(key, str) else key
    return F.element_at(F.array(*[F.lit(v) for v in values]), (key % len(values) + 1).cast("int"))


def _sql_pick(values: tuple[str, ...], key: str = "doc_id") -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + f"][({key} % {len(values)}) + 1]"


def first_line() -> Column:
    return F.split_part(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit(1))


def text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of every text, with its number as ``part``; a null text counts as an empty one."""
    return documents(spark, sf_dir).select("doc_id", "source", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("part", "line"))


TEXT_LINES_SQL = "text_lines AS (SELECT doc_id, source, unnest(string_split(coalesce(text, ''), chr(10))) AS f, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS part FROM documents)"


def unit_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three lines of each line of a text, a row and ``part`` each: two of a kind and with a keyword, picked by doc_id and number of the line, one plain."""
    key, line = F.col("doc_id") + F.col("part"), F.col("line")
    kind, other = _pick(PREFIXES, key), _pick(PREFIXES[::-1], key)
    text = F.concat_ws("\n", F.concat(kind, _pick(KEYWORDS, key), F.lit(" "), line), F.concat(F.lit("  "), other, line), line)
    return text_lines(spark, sf_dir).select("doc_id", "source", "part", text.alias("text"))


_KEY = "(doc_id + part)"
LINES_SQL = f"""{TEXT_LINES_SQL}, lines AS (
  SELECT doc_id, source, part, 3 * part + i - 1 AS line_no, trim(l) AS line FROM (
    SELECT doc_id, source, part, unnest([{_sql_pick(PREFIXES, _KEY)} || {_sql_pick(KEYWORDS, _KEY)} || ' ' || f, '  ' || {_sql_pick(PREFIXES[::-1], _KEY)} || f, f]) AS l, unnest([1, 2, 3]) AS i FROM text_lines))"""


def numbered(found: DataFrame) -> DataFrame:
    """Units with ``line_no`` counted over the parts of a text."""
    return found.withColumn("line_no", F.col("part") * 3 + F.col("line_no")).drop("part")


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units of whole texts; ``ord`` orders them (doc_id below 2^32)."""
    found = numbered(knowledge.units(unit_lines(spark, sf_dir), ["doc_id", "source", "part"]))
    return found.withColumn("ord", F.col("doc_id") * (1 << 31) + F.col("line_no")).withColumn("grp", F.concat_ws("-", "source", F.floor(F.col("doc_id") / 5).cast("string")))


def _regex(pattern: str) -> str:
    return pattern.replace("'", "''")


def _unit_sql() -> str:
    found = {n: f"trim(regexp_extract(line, '(?i)^{_regex(p)}', 2))" for n, p in V.UNIT_PATTERNS}
    kind = " ".join(f"WHEN length({e}) >= 10 THEN '{n}'" for n, e in found.items())
    content = " ".join(f"WHEN length({e}) >= 10 THEN {e}" for e in found.values())
    base = " ".join(f"WHEN '{n}' THEN {round(1000 * v)}" for n, v in V.BASE_CONFIDENCE.items())
    tags = ", ".join(f"CASE WHEN contains(low, '{k}') THEN '{t}' END" for k, t in V.TAG_KEYWORDS)
    return f"""{LINES_SQL},
classified AS (SELECT *, CASE {kind} END AS unit_type, CASE {content} END AS content FROM lines),
named AS (SELECT *, trim(CASE WHEN contains(line, '—') THEN split_part(line, '—', 1) WHEN contains(line, ':') THEN split_part(line, ':', 1) ELSE unit_type END) AS raw, lower(content) AS low
  FROM classified WHERE unit_type IS NOT NULL),
units AS (SELECT doc_id, source, part, line_no, doc_id * 2147483648 + line_no AS ord, source || '-' || (doc_id // 5) AS grp, unit_type, content,
    left(CASE WHEN {title_sql("raw")} <> '' THEN {title_sql("raw")} ELSE left(content, 60) END, 120) AS title,
    floor((least(CASE unit_type {base} ELSE 400 END + least(length(content), 300), 950) + 5) / 10::DOUBLE) / 100 AS confidence,
    list_filter([{tags}], lambda t: t IS NOT NULL)[1:5] AS tags
  FROM named)"""


def title_sql(x: str) -> str:
    plain = rf"trim(regexp_replace(regexp_replace(regexp_replace({x}, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '[_-]+', ' ', 'g'), '\s+', ' ', 'g'))"
    articles = ", ".join(f"'{a}'" for a in V.ARTICLES)
    return f"array_to_string(list_transform(string_split({plain}, ' '), lambda w, i: CASE WHEN i > 1 AND lower(w) IN ({articles}) THEN lower(w) WHEN w = lower(w) THEN upper(left(w, 1)) || substr(w, 2) ELSE w END), ' ')"


def name_sql(x: str) -> str:
    plain = rf"lower(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace({x}, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '[_-]+', ' ', 'g'), '[^a-zA-Z0-9 -]', ' ', 'g'), '\s+', ' ', 'g')))"
    text = f"(CASE WHEN regexp_matches({plain}, '^how to how( |$)') THEN substr({plain}, 8) ELSE {plain} END)"
    trailing = ", ".join(f"'{t}'" for t in V.TRAILING)
    parts = f"string_split({text}, ' ')"
    return f"array_to_string(CASE WHEN len({parts}) > 2 AND {parts}[-1] IN ({trailing}) THEN {parts}[:-2] ELSE {parts} END, '-')"


def category_sql(tags: str) -> str:
    cases = " ".join("WHEN " + " OR ".join(f"contains(t, '{k}')" for k in keys) + f" THEN '{name}'" for name, keys in V.CATEGORY_KEYWORDS)
    return f"coalesce(list_filter(list_transform({tags}, lambda t: CASE {cases} END), lambda c: c IS NOT NULL)[1], 'business')"


UNITS_SQL = _unit_sql()


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviewed skill records of the units' groups, with the source and a number in order of groups."""
    made = skills.reviewed(skills.records(units(spark, sf_dir), "grp", references=False))
    return made.withColumn("source", F.substring_index("grp", "-", 1)).withColumn("no", F.substring_index("grp", "-", -1).cast("long"))


SKILLS_SQL = f"""{UNITS_SQL},
grouped AS (SELECT grp, count(*) AS n_units,
    first(title ORDER BY CASE WHEN unit_type IN ('skill', 'best_practice', 'framework') THEN 0 ELSE 1 END, CASE WHEN unit_type IN ('skill', 'best_practice', 'framework') THEN 0 ELSE -confidence END, ord, title) AS lead,
    coalesce(list(content ORDER BY ord) FILTER (unit_type = 'best_practice'), []) AS bp,
    coalesce(list('🚫 ' || title || ': ' || content ORDER BY ord) FILTER (unit_type IN ('anti_pattern', 'common_mistake')), []) AS pit,
    coalesce(list({{'title': title, 'description': content}} ORDER BY ord) FILTER (unit_type = 'workflow'), []) AS wf,
    coalesce(list({{'title': title, 'code': content}} ORDER BY ord) FILTER (unit_type IN ('example', 'template')), []) AS ex,
    coalesce(list(content ORDER BY ord) FILTER (unit_type = 'rule'), []) AS rules,
    coalesce(list(content ORDER BY ord) FILTER (unit_type = 'skill'), []) AS sk,
    list(content ORDER BY ord) FILTER (length(content) > 30) AS long, list(ord ORDER BY ord) AS ids,
    round(least(0.6::DOUBLE * avg(confidence) + 0.4::DOUBLE * count(DISTINCT unit_type) / 6, 1::DOUBLE) + 1e-9::DOUBLE, 2) AS quality_score
  FROM units GROUP BY grp),
tagged AS (SELECT grp, list(tag ORDER BY tag) AS tags FROM (SELECT DISTINCT grp, unnest(tags) AS tag FROM units) GROUP BY grp),
filled AS (SELECT g.*, coalesce(t.tags, []) AS tags, CASE WHEN len(bp) > 0 THEN bp WHEN len(rules) > 0 THEN rules ELSE sk END AS b FROM grouped g LEFT JOIN tagged t USING (grp)),
skills AS (SELECT grp, split_part(grp, '-', 1) AS source, split_part(grp, '-', 2)::BIGINT AS no, {name_sql("lead")} AS name,
    left(coalesce(b[1], long[1], 'Skill derived from ' || n_units || ' knowledge units.'), 300) AS description, b[1:10] AS best_practices, pit[1:10] AS pitfalls,
    (CASE WHEN len(wf) > 0 THEN wf ELSE list_transform(CASE WHEN len(rules) > 0 THEN rules ELSE b END, lambda r, i: {{'title': 'Step ' || i, 'description': r}}) END)[1:10] AS workflow,
    ex[1:10] AS examples, tags[1:10] AS tags, {category_sql("tags")} AS category, quality_score, ids AS knowledge_ids FROM filled),
rated AS (SELECT *, floor(CASE WHEN trim(name) = '' THEN 0 ELSE CASE WHEN length(trim(description)) > 50 THEN 3 ELSE 0 END + CASE WHEN len(best_practices) > 0 THEN 2 ELSE 0 END
    + CASE WHEN len(workflow) > 0 THEN 2 ELSE 0 END + CASE WHEN len(pitfalls) > 0 THEN 1.5 ELSE 0 END + CASE WHEN len(examples) > 0 THEN 1.5 ELSE 0 END END)::INTEGER AS score FROM skills),
reviewed AS (SELECT *, CASE WHEN score >= 7 THEN 'approved' WHEN score >= 4 THEN 'reviewed' ELSE 'rejected' END AS status FROM rated)"""
