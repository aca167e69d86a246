"""The registered queries of the engine's own operators and, for most, SQL that yields the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import clean
from quillon.functions import text as T
from quillon.functions import vocabulary as V
from quillon.operators import chunk, embed, index, knowledge, models, relations, search, similar, skills, topics
from quillon.operators.lineage import scratch, written
from quillon.plans import chunk_sql, inputs, report
from quillon.plans.inputs import SKILLS_SQL, UNITS_SQL, documents, name_sql, records, title_sql, units
from quillon.sources import files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with equivalent SQL if there is any."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _quoted(*values: str) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


_HAY = "lower(coalesce(source, '') || ' ' || coalesce(lang, '') || ' ' || coalesce(text, ''))"


@query(f"""SELECT doc_id, (CASE WHEN contains(lower(source), 'en') OR contains(lower(source), 'the') THEN 1 ELSE 0 END + CASE WHEN contains(lower(lang), 'en') OR contains(lower(lang), 'the') THEN 1 ELSE 0 END
  + CASE WHEN contains(lower(text), 'en') OR contains(lower(text), 'the') THEN 1 ELSE 0 END + 2 * CASE WHEN contains(lower(lang), 'en') THEN 1 ELSE 0 END + 2 * CASE WHEN contains(lower(lang), 'the') THEN 1 ELSE 0 END)::INTEGER AS score
FROM documents WHERE contains({_HAY}, 'en') AND contains({_HAY}, 'the') ORDER BY score DESC, doc_id LIMIT 20""")
def keyword_search_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir)
    return search.keyword(d, "en the", [F.col("source"), F.col("lang"), F.col("text")], F.col("lang"), "doc_id", 20)


@query(ORACLE_SQL["keyword_search_topk"])
def keyword_index_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same search by a persisted index of two batches; the second replaces rows of the first."""
    d = documents(spark, sf_dir)
    made = index.TermIndex(spark, scratch(spark, "terms"), "long")
    made.add(d.withColumn("text", F.when(F.col("doc_id") % 3 == 0, F.lit("the end")).otherwise(F.col("text"))), "doc_id", [F.col("source"), F.col("lang"), F.col("text")], F.col("lang"))
    made.add(d.where("doc_id % 3 = 0"), "doc_id", [F.col("source"), F.col("lang"), F.col("text")], F.col("lang"))
    return made.search("en the", 20).withColumnRenamed("key", "doc_id")


@query(r"SELECT doc_id, len(regexp_extract_all(text, '[^ \t\n\r\x0b\x0c]+'))::INTEGER AS n_words, (length(text) // 4)::INTEGER AS n_tokens FROM documents")
def doc_word_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", T.word_count(F.col("text")).alias("n_words"), T.token_estimate(F.col("text")).alias("n_tokens"))


@query("SELECT sha256(text) AS text_hash, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def doc_sha256_exact_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).groupBy(F.sha2("text", 256).alias("text_hash")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


_DIRTY = "'  Page ' || (doc_id % 40) || chr(10) || replace(split_part(text, chr(10), 1), ' ', '  ') || chr(10) || chr(10) || chr(10) || chr(10) || '3 / 42' || chr(10) || 'All rights reserved.' || chr(10) || 'a' || chr(1) || 'b   ' || chr(10) || repeat('-', 15 + (doc_id % 10)::INTEGER) || chr(10) || text || chr(10)"


def _dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [F.lit("  Page "), (F.col("doc_id") % 40).cast("string"), F.lit("\n"), F.replace(inputs.first_line(), F.lit(" "), F.lit("  ")), F.lit("\n\n\n\n3 / 42\nAll rights reserved.\na\x01b   \n")]
    return documents(spark, sf_dir).select("doc_id", F.concat(*parts, F.repeat(F.lit("-"), (F.lit(15) + F.col("doc_id") % 10).cast("int")), F.lit("\n"), F.col("text"), F.lit("\n")).alias("text"))


def _clean_sql() -> str:
    drop = " OR ".join(rf"regexp_matches(regexp_replace(l, '^\s+|\s+$', '', 'g'), '{p}')" for p in V.DROPPED_LINES)
    split = "string_split(CASE WHEN ends_with({0}, chr(10)) THEN left({0}, length({0}) - 1) ELSE {0} END, chr(10))"
    count = r"len(regexp_extract_all({0}, '\S+'))"
    return rf"""WITH d AS (SELECT doc_id, {_DIRTY} AS t0 FROM documents),
s1 AS (SELECT *, {split.format("t0")} AS ls FROM d), s2 AS (SELECT *, list_filter(ls, lambda l: NOT ({drop})) AS ks FROM s1),
s3 AS (SELECT *, CASE WHEN len(ks) < len(ls) THEN array_to_string(ks, chr(10)) ELSE t0 END AS t1 FROM s2),
s4 AS (SELECT *, regexp_replace(t1, '\n{{3,}}', chr(10) || chr(10), 'g') AS t2 FROM s3),
s5 AS (SELECT *, array_to_string(list_transform({split.format("t2")}, lambda l: regexp_replace(l, '\s+$', '')), chr(10)) AS t3 FROM s4),
s6 AS (SELECT *, regexp_replace(t3, ' {{2,}}', ' ', 'g') AS t4 FROM s5), s7 AS (SELECT *, regexp_replace(t4, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]', '', 'g') AS t5 FROM s6),
s8 AS (SELECT *, regexp_replace(t5, '^\s+|\s+$', '', 'g') AS text, {count.format("t0")} AS o,
  list_filter([CASE WHEN t1 <> t0 THEN 'footer_header_removal' END, CASE WHEN t2 <> t1 THEN 'blank_line_collapse' END, CASE WHEN t3 <> t2 THEN 'trailing_whitespace_removed' END,
    CASE WHEN t4 <> t3 THEN 'space_normalisation' END, CASE WHEN t5 <> t4 THEN 'control_char_removal' END], lambda x: x IS NOT NULL) AS labels FROM s7)
SELECT doc_id, sha256(text) AS text_hash, array_to_string(labels, ',') AS transformations, o::INTEGER AS original_word_count, {count.format("text")}::INTEGER AS cleaned_word_count,
  round(CASE WHEN o = 0 THEN 0 WHEN {count.format("text")}::DOUBLE / o < 0.3 THEN {count.format("text")}::DOUBLE / o ELSE least({count.format("text")}::DOUBLE / o + least(len(labels) / 10::DOUBLE, 0.2::DOUBLE), 1::DOUBLE) END, 6) AS quality_score FROM s8"""


@query(_clean_sql())
def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = clean.cleaned(_dirty(spark, sf_dir), nfkc=False)
    return df.select("doc_id", F.sha2("text", 256).alias("text_hash"), F.array_join("transformations", ",").alias("transformations"), "original_word_count", "cleaned_word_count", F.round("quality_score", 6).alias("quality_score"))


@query()
def clean_nfkc(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = documents(spark, sf_dir).select("doc_id", F.concat(F.lit("ﬁrst №"), (F.col("doc_id") % 9).cast("string"), F.lit("　"), F.coalesce("text", F.lit(""))).alias("text"))
    return clean.cleaned(wide).select("doc_id", "text", "transformations")


_FIXED = r"""w AS (SELECT doc_id, regexp_extract_all(text, '[^ \t\n\r\x0b\x0c]+') AS w FROM documents),
k AS (SELECT doc_id, w, unnest(range(greatest(1, ceil((len(w) - 200) / 150::DOUBLE) + 1)::BIGINT)) AS i FROM w WHERE len(w) > 0),
c AS (SELECT doc_id, i::INTEGER AS "index", w[i * 150 + 1 : i * 150 + 200] AS p FROM k)"""


@query(f"""WITH {_FIXED} SELECT doc_id, "index", md5(array_to_string(p, ' ')) AS text_hash, len(p)::INTEGER AS word_count FROM c""")
def chunk_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk.fixed(documents(spark, sf_dir), "doc_id", 200, 50).select("doc_id", "index", F.md5("text").alias("text_hash"), "word_count")


@query(f"""WITH {_FIXED} SELECT count(*) AS n_chunks, round(avg(len(p)), 6) AS avg_words FROM c""")
def chunk_avg_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk.fixed(documents(spark, sf_dir), "doc_id", 200, 50).agg(F.count(F.lit(1)).alias("n_chunks"), F.round(F.coalesce(F.avg("word_count"), F.lit(0.0)), 6).alias("avg_words"))


def _paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = F.concat(F.lit("# Part "), (F.col("doc_id") % 5).cast("string"), F.lit("\n\n"))
    return documents(spark, sf_dir).select("doc_id", F.concat(head, F.replace("text", F.lit("\n"), F.lit("\n\n"))).alias("text"))


def _hashed_chunks(made: DataFrame) -> DataFrame:
    return made.select("doc_id", "index", F.md5("text").alias("text_hash"), "word_count")


@query(chunk_sql.SEMANTIC)
def chunk_semantic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hashed_chunks(chunk.folded(_paragraphs(spark, sf_dir), "doc_id", "semantic", 200, 20, 25))


@query(chunk_sql.PARAGRAPH)
def chunk_paragraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hashed_chunks(chunk.folded(_paragraphs(spark, sf_dir), "doc_id", "paragraph", 200, 20, 25))


@query(chunk_sql.RECURSIVE)
def chunk_recursive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hashed_chunks(chunk.folded(_paragraphs(spark, sf_dir), "doc_id", "recursive", 200, 20, 25))


_HEADS = ("# ", "#### ", "##### ", "chapter 3 ", "Part 2: ", "Chapter three ", "#")


@query(f"""WITH {inputs.TEXT_LINES_SQL} SELECT doc_id, line FROM (SELECT doc_id, {inputs._sql_pick(_HEADS, "(doc_id + part)")} || f AS line FROM text_lines) WHERE regexp_matches(line, '{V.HEADING}')""")
def heading_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = inputs.text_lines(spark, sf_dir).select("doc_id", F.concat(inputs._pick(_HEADS, F.col("doc_id") + F.col("part")), "line").alias("line"))
    return rows.where(F.col("line").rlike(V.HEADING))


@query(r"""SELECT doc_id, count(*) AS n_sentences, max(length(s))::INTEGER AS longest FROM (SELECT doc_id, unnest(string_split(regexp_replace(text, '([.!?])[ \t\n\r\x0b\x0c]+', '\1' || chr(30), 'g'), chr(30))) AS s FROM documents) GROUP BY doc_id""")
def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = F.split("text", r"(?<=[.!?])\s+")
    return documents(spark, sf_dir).select("doc_id", F.size(parts).cast("long").alias("n_sentences"), F.array_max(F.transform(parts, F.length)).alias("longest"))


@query(f"WITH {UNITS_SQL} SELECT doc_id, line_no::INTEGER AS line_no, unit_type, title, md5(content) AS content_hash, confidence, array_to_string(tags, ',') AS tags FROM units")
def knowledge_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return units(spark, sf_dir).select("doc_id", "line_no", "unit_type", "title", F.md5("content").alias("content_hash"), "confidence", F.array_join("tags", ",").alias("tags"))


@query(f"WITH {UNITS_SQL} SELECT unit_type, count(*) AS n, round(avg(confidence), 6) AS avg_confidence FROM units GROUP BY unit_type")
def knowledge_type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return units(spark, sf_dir).groupBy("unit_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("confidence"), 6).alias("avg_confidence"))


@query(f"WITH {UNITS_SQL} SELECT doc_id, line_no::INTEGER AS line_no, unit_type, confidence FROM units QUALIFY row_number() OVER (PARTITION BY doc_id, part ORDER BY line_no) <= 1")
def knowledge_limit_per_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.numbered(knowledge.units(inputs.unit_lines(spark, sf_dir), ["doc_id", "part"], most=1)).select("doc_id", "line_no", "unit_type", "confidence")


@query(f"WITH {UNITS_SQL} SELECT doc_id, line_no::INTEGER AS line_no, confidence FROM units WHERE confidence >= 0.5")
def min_confidence_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.numbered(knowledge.units(inputs.unit_lines(spark, sf_dir), ["doc_id", "part"], least=0.5)).select("doc_id", "line_no", "confidence")


_TAG_HITS = ", ".join(f"CASE WHEN contains(lower(line), '{k}') THEN '{t}' END" for k, t in V.TAG_KEYWORDS)


@query(f"""WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line0, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS part FROM documents),
k AS (SELECT doc_id AS chunk_id, part::INTEGER AS ord, trim(line0) AS line, ['best_practice', 'common_mistake', 'rule', NULL, 'workflow'][((doc_id + part) % 5) + 1] AS unit_type, ((doc_id + part) % 13) / 10 AS c FROM l)
SELECT chunk_id, ord, unit_type, 'First Title' AS title, left(line, 2000) AS content, round(least(c, 1.0), 2)::DOUBLE AS confidence,
  array_to_string(list_concat(['sales-team'], list_filter([{_TAG_HITS}], lambda t: t IS NOT NULL))[1:5], ',') AS tags FROM k WHERE unit_type IS NOT NULL AND length(line) >= 10""")
def llm_unit_coercion(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("doc_id") + F.col("part")
    kind = inputs._pick(("best-practices", "Mistake", "rule", "unknown", "workflow_steps"), key)
    item = F.struct(kind.alias("unit_type"), F.lit("first_title").alias("title"), F.col("line").alias("content"), (key % 13 / 10).alias("confidence"), F.array(F.lit("Sales Team")).alias("tags"))
    lines = inputs.text_lines(spark, sf_dir).withColumn("item", item)
    listed = lines.groupBy(F.col("doc_id").alias("chunk_id")).agg(F.array_sort(F.collect_list(F.struct("part", "item"))).alias("x"))
    found = knowledge.coerced(listed.select("chunk_id", F.concat(F.lit("Sure: "), F.to_json(F.transform("x", lambda e: e["item"]))).alias("response")))
    return found.withColumn("tags", F.array_join("tags", ","))


_KINDS = ("best-practices", "Mistake", "RULE", "unknown", "workflow_steps", " check-list ", "decisiontree")
_ALIAS_SQL = " ".join(f"WHEN '{a}' THEN '{k}'" for a, k in V.TYPE_ALIASES.items())


@query(f"SELECT doc_id, CASE WHEN k IN ({_quoted(*V.UNIT_TYPES)}) THEN k END AS unit_type FROM (SELECT doc_id, CASE n {_ALIAS_SQL} ELSE n END AS k FROM (SELECT doc_id, replace(lower(trim({inputs._sql_pick(_KINDS)})), '-', '_') AS n FROM documents))")
def unit_type_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", T.unit_type(inputs._pick(_KINDS)).alias("unit_type"))


@query(r"""WITH t AS (SELECT p_partkey, i, regexp_replace(regexp_replace(lower(x), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS tag FROM (
  SELECT p_partkey, unnest(string_split_regex(p_name || ', ' || p_brand || ' ' || p_type, '[,\s]+')) AS x, generate_subscripts(string_split_regex(p_name || ', ' || p_brand || ' ' || p_type, '[,\s]+'), 1) AS i FROM part)),
u AS (SELECT p_partkey, tag, min(i) AS i FROM t WHERE tag <> '' AND length(tag) <= 30 GROUP BY ALL)
SELECT p_partkey, array_to_string(list(tag ORDER BY i)[1:5], ',') AS tags FROM u GROUP BY p_partkey""")
def clean_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat("p_name", F.lit(", "), "p_brand", F.lit(" "), "p_type")
    return _table(spark, sf_dir, "part").select("p_partkey", F.array_join(T.clean_tags(F.split(raw, r"[,\s]+")), ",").alias("tags"))


_NAMED = ("{0}", "How to how{0}Technique", "singleClick{0}", "some_{0} Method!", "{0} of the strategy")


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = F.array(*[F.format_string(n.replace("{0}", "%s"), "p_name") for n in _NAMED])
    return _table(spark, sf_dir, "part").select("p_partkey", F.element_at(made, (F.col("p_partkey") % len(_NAMED) + 1).cast("int")).alias("raw"))


_NAMES_SQL = "raw AS (SELECT p_partkey, [" + ", ".join("'" + n.replace("{0}", "' || p_name || '") + "'" for n in _NAMED) + f"][(p_partkey % {len(_NAMED)}) + 1] AS raw FROM part)"


@query(f"WITH {_NAMES_SQL} SELECT p_partkey, {name_sql('raw')} AS name FROM raw")
def normalize_skill_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _names(spark, sf_dir).select("p_partkey", T.skill_name(F.col("raw")).alias("name"))


@query(f"WITH {_NAMES_SQL} SELECT p_partkey, {title_sql('raw')} AS title FROM raw")
def normalize_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _names(spark, sf_dir).select("p_partkey", T.title(F.col("raw")).alias("title"))


@query(f"""WITH {_NAMES_SQL} SELECT p_partkey, regexp_replace(left(replace(trim(regexp_replace(lower(raw), '[^a-z0-9]+', ' ', 'g')), ' ', '-'), 20), '-+$', '') AS slug,
  regexp_replace(regexp_replace(lower(raw), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS file_slug FROM raw""")
def slugify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _names(spark, sf_dir).select("p_partkey", T.slug(F.col("raw"), 20).alias("slug"), T.file_slug(F.col("raw")).alias("file_slug"))


@query(f"""WITH RECURSIVE {UNITS_SQL}, t AS (SELECT ord, unnest(list_distinct(list_transform(tags, lambda t: lower(t)))) AS tag FROM units), e AS (SELECT DISTINCT a.tag AS a, b.tag AS b FROM t a JOIN t b USING (ord)),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a), low AS (SELECT r.a AS tag, min(ord) AS topic FROM r JOIN t ON t.tag = r.b GROUP BY r.a)
SELECT ord AS unit_id, coalesce(min(topic), ord) AS topic FROM units LEFT JOIN t USING (ord) LEFT JOIN low USING (tag) GROUP BY ord""")
def topic_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topics over the whole table, by the tags of the units of whole texts."""
    return topics.components(units(spark, sf_dir).select(F.col("ord").alias("unit_id"), "tags"))


@query(f"""WITH {SKILLS_SQL} SELECT grp, name, description, len(best_practices)::INTEGER AS n_best, len(pitfalls)::INTEGER AS n_pitfalls, len(workflow)::INTEGER AS n_workflow, len(examples)::INTEGER AS n_examples,
  md5(array_to_string(best_practices, '|') || '#' || array_to_string(pitfalls, '|')) AS sections, array_to_string(tags, ',') AS tags, category, quality_score, array_to_string(knowledge_ids, ',') AS knowledge_ids FROM skills""")
def skill_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = lambda c: F.size(c)
    return records(spark, sf_dir).select(
        "grp", "name", "description", n("best_practices").alias("n_best"), n("pitfalls").alias("n_pitfalls"), n("workflow").alias("n_workflow"), n("examples").alias("n_examples"),
        F.md5(F.concat(F.array_join("best_practices", "|"), F.lit("#"), F.array_join("pitfalls", "|"))).alias("sections"), F.array_join("tags", ",").alias("tags"), "category", "quality_score",
        F.array_join(F.transform("knowledge_ids", lambda x: x.cast("string")), ",").alias("knowledge_ids"),
    )


@query(rf"""WITH RECURSIVE {SKILLS_SQL}, f AS (SELECT grp, name, root, row_number() OVER (PARTITION BY root ORDER BY no, grp) AS k FROM (SELECT *, regexp_replace(name, '(-\d+)+$', '') AS root FROM skills)),
r AS (SELECT grp, name, root, k, [name] AS used FROM f WHERE k = 1 UNION ALL SELECT grp, free, root, k, list_append(used, free) FROM (
  SELECT f.grp, f.root, f.k, r.used, CASE WHEN list_contains(r.used, f.name) THEN f.name || '-' || list_filter(range(2, len(r.used) + 3), lambda n: NOT list_contains(r.used, f.name || '-' || n))[1] ELSE f.name END AS free
  FROM r JOIN f ON f.root = r.root AND f.k = r.k + 1)) SELECT grp, name FROM r""")
def skill_unique_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = written(records(spark, sf_dir).select("grp", "name", F.struct("no", "grp").alias("o")), "records")
    return skills.unique_names(made, "o").select("grp", "name")


_SOUGHT = "list_filter(list_concat([name, description, category, source, review_feedback], tags, best_practices, pitfalls, list_transform(workflow, lambda w: w.title), list_transform(workflow, lambda w: w.description), list_transform(examples, lambda e: e.title), list_transform(examples, lambda e: e.code)), lambda f: f <> '')"


@query(f"""WITH {SKILLS_SQL}, f AS (SELECT grp, lower(name) AS name, list_transform({_SOUGHT}, lambda x: lower(x)) AS fields FROM (SELECT *, CASE status
    WHEN 'approved' THEN 'Skill is well-structured and ready for approval.' WHEN 'reviewed' THEN 'Skill is acceptable but needs improvements before approval.' ELSE 'Skill lacks essential sections; needs rework or rejection.' END AS review_feedback FROM reviewed))
SELECT grp, (len(list_filter(fields, lambda x: contains(x, 'step') OR contains(x, 'sales'))) + 2 * (CASE WHEN contains(name, 'step') THEN 1 ELSE 0 END + CASE WHEN contains(name, 'sales') THEN 1 ELSE 0 END))::INTEGER AS score
FROM f WHERE contains(array_to_string(fields, ' '), 'step') AND contains(array_to_string(fields, ' '), 'sales') ORDER BY score DESC, grp LIMIT 25""")
def skill_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields, lists = skills.searched()
    made = records(spark, sf_dir).withColumn("source_book", F.col("source"))
    return search.keyword(made, "Step sales", fields, F.col("name"), "grp", 25, lists)


@query(f"WITH {SKILLS_SQL} SELECT source, grp FROM skills QUALIFY row_number() OVER (PARTITION BY source ORDER BY no, grp) <= 5")
def skill_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return skills.capped(records(spark, sf_dir), "source", F.struct("no", "grp"), 5).select("source", "grp")


@query(f"WITH {SKILLS_SQL} SELECT grp, score, status FROM reviewed")
def review_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(spark, sf_dir).select("grp", "score", "status")


@query(f"WITH {SKILLS_SQL} SELECT status, count(*) AS n FROM reviewed GROUP BY status")
def review_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(spark, sf_dir).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


_SECTION = "CASE WHEN len({0}) > 0 THEN '## {1}' || chr(10) || chr(10) || array_to_string({0}, chr(10)) || '{2}' END"
_TOLD = "list_transform(workflow, lambda w, i: '### ' || i || '. ' || w.title || CASE WHEN coalesce(w.description, '') <> '' THEN chr(10) || chr(10) || w.description || chr(10) ELSE '' END)"
_SHOWN = "list_transform(examples, lambda e: '### ' || e.title || chr(10) || '```' || chr(10) || e.code || chr(10) || '```' || chr(10))"
_MARKDOWN = ", ".join([
    "'---'", "'name: ' || name", "'description: \"' || description || '\"'", "CASE WHEN len(tags) > 0 THEN 'tags: [' || array_to_string(tags, ', ') || ']' END", "CASE WHEN category <> '' THEN 'category: ' || category END", "'---' || chr(10)",
    "'# ' || name || chr(10)", "description || chr(10)", _SECTION.format("list_transform(best_practices, lambda x: '- ' || x)", "Best Practices", "\n"), _SECTION.format(_TOLD, "Workflow", ""), _SECTION.format(_SHOWN, "Examples", ""),
    _SECTION.format("list_transform(pitfalls, lambda x: '- ⚠️ ' || x)", "Pitfalls", "\n"),
])


@query(f"WITH {SKILLS_SQL} SELECT grp, array_to_string(list_filter([{_MARKDOWN}], lambda x: x IS NOT NULL), chr(10)) AS markdown FROM reviewed")
def skill_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = records(spark, sf_dir)
    return made.select("grp", skills.markdown(made).alias("markdown"))


@query(f"WITH {SKILLS_SQL} SELECT grp, category, status FROM reviewed WHERE status = 'reviewed' AND list_has_any(tags, ['sales', 'marketing', 'api', 'finance'])")
def skill_list_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return skills.listed(records(spark, sf_dir), status_="reviewed", tags=["sales", "marketing", "api", "finance"]).select("grp", "category", "status")


@query(f"WITH {SKILLS_SQL} SELECT grp, quality_score FROM reviewed ORDER BY quality_score DESC, grp LIMIT 20 OFFSET 10")
def skill_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return skills.listed(records(spark, sf_dir), limit=20, offset=10, order=(F.desc("quality_score"), F.col("grp"))).select("grp", "quality_score")


@query(f"""WITH {SKILLS_SQL} SELECT count(*) AS total, count(DISTINCT source) AS sources, count(*) FILTER (status = 'approved') AS approved, count(*) FILTER (status = 'reviewed') AS reviewed,
  count(*) FILTER (status = 'rejected') AS rejected, count(*) FILTER (status = 'draft') AS draft, count(*) FILTER (status = 'published') AS published, round(avg(quality_score), 2) AS avg_quality, max(quality_score) AS max_quality, min(quality_score) AS min_quality FROM reviewed""")
def skills_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return skills.stats(records(spark, sf_dir), "source")


@query(f"WITH {SKILLS_SQL} SELECT category, count(*) AS n FROM reviewed GROUP BY category")
def stats_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(spark, sf_dir).groupBy("category").agg(F.count(F.lit(1)).alias("n"))


_TOKENS_SQL = f"tok AS (SELECT doc_id, unnest(list_filter(regexp_extract_all(lower(text), '[a-z]+(?:''[a-z]+)?'), lambda t: length(t) > 1 AND t NOT IN ({_quoted(*V.STOPWORDS)}))) AS token FROM documents)"
_HEX = "('0x' || substr(h, 7, 2) || substr(h, 5, 2) || substr(h, 3, 2) || substr(h, 1, 2))::BIGINT"


@query(f"""WITH {_TOKENS_SQL}, c AS (SELECT doc_id, token, count(*) AS n, md5(token) AS h FROM tok GROUP BY doc_id, token),
b AS (SELECT doc_id, ({_HEX} % 384)::INTEGER AS bucket, sum(CASE WHEN ('0x' || substr(h, 9, 2))::BIGINT % 2 = 0 THEN 1 ELSE -1 END * sqrt(n)) AS v FROM c GROUP BY ALL),
q AS (SELECT doc_id, sqrt(sum(v * v)) AS norm FROM b GROUP BY doc_id) SELECT doc_id, count(*) FILTER (abs(v) > 1e-9) AS n_buckets, round(max(v / norm), 6) AS top, CASE WHEN abs(sum(v / norm)) < 5e-5 THEN 0 ELSE round(sum(v / norm), 4) END::DOUBLE AS total FROM b JOIN q USING (doc_id) WHERE norm > 0 GROUP BY doc_id""")
def hash_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = similar.hashed_vector(documents(spark, sf_dir), "doc_id", F.col("text"))
    return cells.groupBy("doc_id").agg(F.count_if(F.abs("value") > 1e-9).alias("n_buckets"), F.round(F.max("value"), 6).alias("top"), F.when(F.abs(F.sum("value")) < 5e-5, 0.0).otherwise(F.round(F.sum("value"), 4)).alias("total"))


_COS = "list_cosine_similarity(a.embedding::DOUBLE[], q.embedding::DOUBLE[])"


@query(f"SELECT a.vec_id, round({_COS}, 6) AS score FROM embeddings a, (SELECT embedding FROM embeddings WHERE vec_id = 3) q ORDER BY score DESC, vec_id LIMIT 10")
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings")
    wanted = rows.where("vec_id = 3").first()["embedding"]
    return search.vectors(rows, wanted, "vec_id", "embedding", 10)


@query(f"SELECT a.vec_id, round({_COS}, 6) AS score FROM embeddings a, (SELECT embedding FROM embeddings WHERE vec_id = 3) q WHERE a.label = 4 ORDER BY score DESC, vec_id LIMIT 10")
def vector_topk_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings")
    wanted = rows.where("vec_id = 3").first()["embedding"]
    return search.vectors(rows.where("label = 4"), wanted, "vec_id", "embedding", 10)


@query()
def vector_index_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten neighbours of every vector whose id is divisible by 20, by inverted lists; recall is measured in tests."""
    rows = _table(spark, sf_dir, "embeddings")
    made = index.VectorIndex(spark, scratch(spark, "lists")).build(rows, "vec_id", "embedding")
    return made.nearest(rows.where("vec_id % 20 = 0"), "vec_id", "embedding").select(F.col("query").alias("vec_id"), F.col("key").alias("neighbour"), "score", "rank")


@query("SELECT user_id AS key, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) WHERE n = 1")
def vector_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), "event_type", "value", "event_id")
    return search.upserted(rows.where("event_id % 2 = 0"), rows.where("event_id % 2 = 1"), "key", "event_id").select("key", "event_type", "value")


_CONTENT = f"list_distinct(list_filter(regexp_extract_all(lower(description || ' ' || array_to_string(best_practices, ' ') || ' ' || array_to_string(pitfalls, ' ')), '[a-z0-9]+'), lambda t: length(t) > 2 AND t NOT IN ({_quoted(*V.CONTENT_STOPWORDS)})))"


@query(f"""WITH {SKILLS_SQL}, c AS (SELECT source, no, grp, {_CONTENT} AS w FROM skills), p AS (SELECT a.source, a.no AS no_a, b.no AS no_b, CASE WHEN len(a.w) = 0 OR len(b.w) = 0 THEN 0 ELSE len(list_intersect(a.w, b.w))::DOUBLE / len(list_distinct(list_concat(a.w, b.w))) END AS j
  FROM c a JOIN c b ON a.source = b.source AND a.no < b.no) SELECT source, no_a, no_b, round(j, 4) AS similarity FROM p WHERE round(j, 4) >= 0.6""")
def dedup_content_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar.content_pairs(records(spark, sf_dir), "source", "no").select("source", "no_a", "no_b", "similarity")


def _embedded_records(spark: SparkSession, sf_dir: str, stored: bool = True) -> DataFrame:
    """Records with vectors; ``stored`` if they are read more than once."""
    made = records(spark, sf_dir).withColumnRenamed("source", "scope")
    wide = ("workflow", "examples", "review_feedback", "review_notes")
    made = made.drop(*wide)
    return (written(made, "records") if stored else made).withColumn("vector", embed.hashed(embed.skill_text()))


@query()
def dedup_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.survivors(_embedded_records(spark, sf_dir, stored=False), "scope", "no")


@query()
def dedup_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = _embedded_records(spark, sf_dir)
    return similar.merged(made, relations.survivors(made, "scope", "no"), "scope", "no").select("scope", "no", F.array_join("tags", ",").alias("tags"), F.size("knowledge_ids").alias("n_units"))


@query()
def dedup_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_greedy(spark, sf_dir)
    return found.agg(F.count(F.lit(1)).alias("input"), F.count("method").alias("removed"), F.count_if(F.col("no") == F.col("survivor")).alias("final"), F.count_if(F.col("method") == "semantic").alias("semantic"), F.count_if(F.col("method") == "lexical").alias("lexical"))


@query(f"WITH {SKILLS_SQL} SELECT grp AS id, name, category, array_to_string(tags, ',') AS tags, left(description, 200) AS description FROM skills")
def kg_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(spark, sf_dir).select(F.col("grp").alias("id"), "name", "category", F.array_join("tags", ",").alias("tags"), F.substring("description", 1, 200).alias("description"))


_PRE = " OR ".join(f"contains(p, '{k}')" for k in V.PREREQUISITE_KEYWORDS)


@query()
def kg_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All relations of whole sources, as rows of classes; names have no SQL, the other layers are in the two queries below."""
    return relations.relations(_embedded_records(spark, sf_dir), "scope", "no")


_EMBEDDED = "name || ' ' || description || ' ' || array_to_string(best_practices, ' ') || ' ' || array_to_string(pitfalls, ' ') || '  '"


@query(f"""WITH {SKILLS_SQL}, e AS (SELECT source, min(no) AS no, count(*) AS n, {_EMBEDDED} AS text FROM skills GROUP BY source, {_EMBEDDED}),
tok AS (SELECT source, no, unnest(list_filter(regexp_extract_all(lower(text), '[a-z]+(?:''[a-z]+)?'), lambda t: length(t) > 1 AND t NOT IN ({_quoted(*V.STOPWORDS)}))) AS token FROM e),
c AS (SELECT source, no, token, count(*) AS n, md5(token) AS h FROM tok GROUP BY ALL),
b AS (SELECT source, no, ({_HEX} % 384)::INTEGER AS bucket, sum(CASE WHEN ('0x' || substr(h, 9, 2))::BIGINT % 2 = 0 THEN 1 ELSE -1 END * sqrt(n)) AS v FROM c GROUP BY ALL),
q AS (SELECT source, no, sqrt(sum(v * v)) AS norm FROM b GROUP BY ALL), u AS (SELECT b.source, b.no, bucket, v / norm AS v FROM b JOIN q USING (source, no) WHERE norm > 0),
p AS (SELECT x.source, x.no AS a, y.no AS b, round(sum(x.v * y.v), 9) AS c FROM u x JOIN u y ON x.source = y.source AND x.bucket = y.bucket AND x.no <= y.no GROUP BY ALL)
SELECT p.source AS scope, 'related_to' AS type, 'vector' AS layer, a, b, x.n AS n_a, y.n AS n_b, round(least(c, 1), 3)::DOUBLE AS weight FROM p JOIN e x ON x.source = p.source AND x.no = a JOIN e y ON y.source = p.source AND y.no = b WHERE c >= 0.7 AND (a <> b OR x.n > 1)""")
def kg_vector_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.relations(_embedded_records(spark, sf_dir), "scope", "no").where("layer = 'vector'")


@query(rf"""WITH {SKILLS_SQL}, m AS (SELECT *, ({_PRE}) AS pre FROM (SELECT source, no, category, list_sort(list_distinct(tags)) AS tags, trim(regexp_replace(lower(regexp_replace(name, '[^a-zA-Z0-9\s]', '', 'g')), '\s+', ' ', 'g')) AS p FROM skills)),
t AS (SELECT source, tags, min(no) AS no, count(*) AS n FROM m WHERE len(tags) > 0 GROUP BY source, tags), n AS (SELECT source, p, min(no) AS no, count(*) AS n FROM m GROUP BY source, p),
c AS (SELECT source, min(no) AS no, count(*) AS n FROM m WHERE category <> '' GROUP BY source, category), k AS (SELECT source, min(no) FILTER (pre) AS a, min(no) FILTER (NOT pre) AS b, count(*) FILTER (pre) AS n_a, count(*) FILTER (NOT pre) AS n_b FROM m GROUP BY source),
j AS (SELECT x.source, x.no AS a, y.no AS b, x.n AS n_a, y.n AS n_b, len(list_intersect(x.tags, y.tags))::DOUBLE / len(list_distinct(list_concat(x.tags, y.tags))) AS w FROM t x JOIN t y ON x.source = y.source AND x.no <= y.no)
SELECT source AS scope, 'related_to' AS type, 'tags' AS layer, a, b, n_a, n_b, round(w, 3)::DOUBLE AS weight FROM j WHERE w >= 0.4 AND (a <> b OR n_a > 1)
UNION ALL SELECT source, 'related_to', 'category', no, no, n, n, 0.4 FROM c WHERE n > 1
UNION ALL SELECT x.source, 'extends', 'name', x.no, y.no, x.n, y.n, round(length(y.p)::DOUBLE / length(x.p), 3) FROM n x JOIN n y ON x.source = y.source AND contains(x.p, y.p) AND length(y.p) >= 4 WHERE x.no <> y.no OR x.n > 1
UNION ALL SELECT source, 'prerequisite', 'keyword', a, b, n_a, n_b, 1.0 FROM k WHERE n_a > 0 AND n_b > 0""")
def kg_class_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.relations(_embedded_records(spark, sf_dir), "scope", "no").where("layer IN ('tags', 'units', 'category', 'keyword') OR type = 'extends'")


@query(f"WITH {SKILLS_SQL} SELECT grp, md5(name || ' ' || description || ' ' || array_to_string(best_practices, ' ') || ' ' || array_to_string(pitfalls, ' ') || '  ') AS text_hash FROM skills")
def skill_embedding_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(spark, sf_dir).select("grp", F.md5(embed.skill_text()).alias("text_hash"))


@query("SELECT sha256(text) AS text_hash, length(min(text))::INTEGER AS n_chars FROM documents WHERE trim(text) <> '' AND sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 2 = 0 AND text IS NOT NULL) GROUP BY 1")
def embed_cache_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir)
    cache = rows.where("doc_id % 2 = 0").select(F.sha2("text", 256).alias("text_hash"), F.lit("hash").alias("backend"), F.lit(384).alias("dim"))
    return embed.missing(rows.where("trim(text) <> ''"), cache, "hash", 384).select("text_hash", F.length("text").alias("n_chars"))


@query(f"""WITH {_FIXED}, {SKILLS_SQL} SELECT doc_id || '-' || "index" AS id, 'chunk' AS source_type, md5(array_to_string(p, ' ')) AS text_hash, 384 AS dim FROM c
UNION ALL SELECT grp, 'skill', md5(name || '. ' || description || ' ' || array_to_string(best_practices, ' ')), 384 FROM skills""")
def embed_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    empty = spark.createDataFrame([], embed.CACHE_SCHEMA)
    chunks, _ = embed.embedded(chunk.fixed(documents(spark, sf_dir), "doc_id", 200, 50), empty)
    found = embed.payloads(chunks.withColumn("id", F.concat_ws("-", "doc_id", "index")), _embedded_records(spark, sf_dir), "id", "grp")
    return found.select("id", "source_type", F.md5("text").alias("text_hash"), F.size("vector").alias("dim"))


@query(f"WITH {SKILLS_SQL} SELECT grp, quality_score FROM reviewed WHERE contains(lower(name), 'step') OR contains(lower(description), 'step') OR contains(lower(array_to_string(tags, chr(10))), 'step') OR contains(lower(category), 'step') ORDER BY quality_score DESC, grp LIMIT 30")
def phrase_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.phrase(records(spark, sf_dir), "Step", [F.col("name"), F.col("description"), F.array_join("tags", "\n"), F.col("category")], F.desc("quality_score"), "grp").select("grp", "quality_score")


@query(f"WITH {UNITS_SQL} SELECT source, unit_type AS type, count(*) AS n_units, least(count(*) / 5.0, 1.0)::DOUBLE AS quality_score, array_to_string(list(ord ORDER BY ord), ',') AS knowledge_ids FROM units GROUP BY source, unit_type")
def type_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knowledge.by_type(units(spark, sf_dir), "source", "ord").select("source", F.col("unit_type").alias("type"), "n_units", "quality_score", F.array_join(F.transform("knowledge_ids", lambda x: x.cast("string")), ",").alias("knowledge_ids"))


@query(r"SELECT doc_id, md5(regexp_replace(regexp_replace('co-' || chr(10) || '  operate ' || text || chr(10) || 'end', '([[:word:]])-\s*\n\s*([[:word:]])', '\1\2', 'g'), '\n', ' ', 'g')) AS text_hash FROM documents WHERE NOT contains(text, chr(10) || chr(10)) AND NOT starts_with(text, chr(10)) AND NOT ends_with(text, chr(10)) AND NOT regexp_matches(text, '-\s*\n')")
def text_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", F.md5(files.repaired(F.concat(F.lit("co-\n  operate "), "text", F.lit("\nend")))).alias("text_hash"))


@query(f"WITH {_TOKENS_SQL} SELECT token, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM tok GROUP BY token")
def term_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = documents(spark, sf_dir).select("doc_id", F.explode(T.tokens(F.col("text"))).alias("token"))
    per_doc = tokens.groupBy("doc_id", "token").agg(F.count(F.lit(1)).alias("n"))
    return per_doc.groupBy("token").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_docs"))


@query()
def name_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "part").select("p_partkey", F.round(similar.name_ratio(F.col("p_name"), F.col("p_type")), 4).alias("ratio"))


@query("SELECT doc_id, md5(text) AS md5, sha1(text) AS sha1, sha256(text) AS sha256 FROM documents")
def file_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", *[files.digest(F.col("text"), a).alias(a) for a in ("md5", "sha1", "sha256")])


@query(f"""WITH {_FIXED} SELECT doc_id, sha256(string_agg(sha256(array_to_string(p, ' ')), '' ORDER BY "index")) AS digest FROM c GROUP BY doc_id""")
def chunk_list_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.chunk_list_digest(chunk.fixed(documents(spark, sf_dir), "doc_id", 200, 50), "doc_id", "index")


@query("SELECT l_orderkey, l_linenumber, round(greatest(0, 1 - l_discount * 20), 4)::DOUBLE AS cosine, -l_discount AS l2 FROM lineitem")
def distance_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    distance = F.col("l_discount")
    return _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", search.distance_score(distance * 20).alias("cosine"), search.distance_score(distance, "l2").alias("l2"))


@query(f"WITH {SKILLS_SQL} SELECT category AS value, count(*) AS n FROM reviewed GROUP BY category ORDER BY n DESC, value")
def category_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return skills.histogram(records(spark, sf_dir), "category")


@query(f"""WITH {UNITS_SQL} SELECT doc_id, line_no, unit_type FROM units WHERE unit_type IN ('rule', 'workflow')""")
def knowledge_allowed_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = knowledge.units(inputs.unit_lines(spark, sf_dir), ["doc_id", "part"], allowed=("rule", "workflow"))
    return inputs.numbered(found).select("doc_id", "line_no", "unit_type")


@query(f"""WITH {UNITS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY confidence DESC, ord) AS n FROM units)
SELECT grp, md5(string_agg(n || '. [' || unit_type || '] ' || title || chr(10) || '   ' || left(trim(regexp_replace(content, '[ \t\n\r\x0b\x0c]+', ' ', 'g')), 300), chr(10) ORDER BY n)) AS shown FROM r WHERE n <= 12 GROUP BY grp""")
def prompt_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.shown_units(units(spark, sf_dir), "grp", "ord").select("grp", F.md5("shown").alias("shown"))


@query("SELECT event_type, sum(event_id % 7)::BIGINT AS items, sum(user_id % 5)::BIGINT AS tokens, round(sum(value), 4) AS seconds, count(*) FILTER (value < 0) AS errors, bool_and(value >= 0) AS success FROM events GROUP BY event_type")
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "events").select("event_type", F.col("value").alias("seconds"), (F.col("value") >= 0).alias("success"), (F.col("event_id") % 7).alias("items"), (F.col("user_id") % 5).alias("tokens"))
    return report.summary(rows, "event_type")


@query("SELECT p_name AS name, min(p_partkey) AS p_partkey FROM part WHERE p_partkey % 3 <> 0 AND p_name NOT IN (SELECT p_name FROM part WHERE p_partkey % 3 = 0) GROUP BY p_name")
def save_name_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "part").select(F.col("p_name").alias("name"), "p_partkey")
    return search.unsaved(rows.where("p_partkey % 3 <> 0"), rows.where("p_partkey % 3 = 0"), "name", "p_partkey")


@query("SELECT doc_id, sha256(text) AS file_hash FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 2 = 0)")
def incremental_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir).select("doc_id", F.sha2("text", 256).alias("file_hash"))
    ledger = rows.where("doc_id % 2 = 0").select("file_hash", F.lit("clean").alias("stage"), F.lit("v1").alias("settings"))
    return search.unprocessed(rows, ledger, "clean", "v1").select("doc_id", "file_hash")


@query("SELECT event_type AS stage, count(*) AS items, round(sum(value), 4) AS duration, count(*) FILTER (value < 0) AS errors, bool_and(value >= 0) AS success FROM events GROUP BY event_type")
def stage_metrics_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("stage")).agg(F.count(F.lit(1)).alias("items"), F.round(F.sum("value"), 4).alias("duration"), F.count_if(F.col("value") < 0).alias("errors"), F.bool_and(F.col("value") >= 0).alias("success"))


@query("""SELECT p_partkey, CASE WHEN n <= 0 THEN 0.0 WHEN w / n > 150 THEN 1.0 WHEN w / n > 50 THEN 0.5 WHEN w / n > 10 THEN 0.2 ELSE 0.05 END::DOUBLE AS direct,
  CASE WHEN n <= 0 OR w <= 0 THEN 0.0 WHEN w / n > 200 THEN 0.9 WHEN w / n > 80 THEN 0.7 WHEN w / n > 20 THEN 0.4 ELSE 0.15 END::DOUBLE AS scanned FROM (SELECT p_partkey, p_retailprice::DOUBLE AS w, (p_size % 20)::DOUBLE AS n FROM part)""")
def page_quality_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "part").select("p_partkey", F.col("p_retailprice").cast("double").alias("w"), (F.col("p_size") % 20).cast("double").alias("n"))
    w, n = F.col("w"), F.col("n")
    return rows.select("p_partkey", files.page_quality(w, n).alias("direct"), files.scan_quality(w, n).alias("scanned"))
