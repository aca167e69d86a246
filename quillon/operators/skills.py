"""Skill records from groups of units, their review, their text and their statistics."""

from __future__ import annotations

import itertools

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.functions import text as T
from quillon.functions import vocabulary as V
from quillon.operators.lineage import written


#: Units whose contents go into one section of a record.
_SECTIONS = (("best_practice",), ("anti_pattern", "common_mistake"), ("workflow",), ("example", "template"), ("checklist",), ("rule",), ("skill",), ("reference",))


def records(units: DataFrame, group: str, order: str = "ord", checklist: bool = False, most: int = 10, references: bool = True) -> DataFrame:
    """One record per group: name, description, sections with back-filling, tags, category, quality, provenance.

    Sections hold ``most`` contents, and no more of a group's contents are gathered; its ids, which a record lists all, are, and, if units
    have a ``source_reference``, the different ones as source_chapters. One shuffle. Without ``references`` no unit may be one, as patterns
    give none; that spares a sort.
    """
    kind = F.col("unit_type")
    content = F.col("content")
    lead = F.when(kind.isin("skill", "best_practice", "framework"), F.struct(F.lit(0).alias("a"), F.lit(0.0).alias("c"), F.col(order).alias("o"), F.col("title").alias("t")))
    lead = lead.otherwise(F.struct(F.lit(1).alias("a"), (-F.col("confidence")).alias("c"), F.col(order).alias("o"), F.col("title").alias("t")))
    section = F.coalesce(*[F.when(kind.isin(*kinds), F.lit(i)) for i, kinds in enumerate(_SECTIONS)], F.lit(-1))
    dealt = units.repartition(F.col(group)).withColumn("_section", section)
    number = Window.partitionBy(group, "_section").orderBy(order)
    if references:  # of references, only different ones count
        new = F.row_number().over(Window.partitionBy(group, "_section", F.when(kind == "reference", content)).orderBy(order)) == 1
        dealt = dealt.withColumn("_new", new | (kind != "reference"))
        dealt = dealt.withColumn("_at", F.sum(F.col("_new").cast("int")).over(number.rowsBetween(Window.unboundedPreceding, 0)))
    else:
        dealt = dealt.withColumn("_at", F.row_number().over(number))
    # one list of the first rows of all sections, in input order
    chosen = F.struct(F.col("_section").alias("s"), F.col(order).alias("o"), F.col("title").alias("t"), content.alias("v"))
    gathered = F.array_sort(F.collect_list(F.when((F.col("_section") >= 0) & (F.col("_at") <= most), chosen)))
    long = F.when(F.octet_length(content) > 120, F.lit(True)).otherwise(F.length(content) > 30)  # most are told without counting characters
    first_long = F.min(F.when(long, F.struct(F.col(order).alias("o"), content.alias("v"))))
    df = dealt.groupBy(group).agg(
        F.min(lead).alias("_lead"),
        gathered.alias("_all"),
        F.array_compact(F.array(first_long["v"])).alias("_long"),
        F.array_sort(F.collect_list(F.struct(F.col(order).alias("o")))).alias("_ids"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("tags")))).alias("_tags"),
        F.round(F.least(0.6 * F.avg("confidence") + 0.4 * F.size(F.collect_set(kind)) / 6, F.lit(1.0)) + 1e-9, 2).alias("quality_score"),
        F.count(F.lit(1)).alias("n_units"),
        *([F.array_sort(F.collect_set(F.nullif("source_reference", F.lit("")))).alias("source_chapters")] if "source_reference" in units.columns else []),
    )
    shown = {  # how a row shows in a section, if not as its content
        "_pit": lambda p: F.concat(F.lit("🚫 "), p["t"], F.lit(": "), p["v"]),
        "_wf": lambda p: F.struct(p["t"].alias("title"), p["v"].alias("description")),
        "_ex": lambda p: F.struct(p["t"].alias("title"), p["v"].alias("code")),
    }
    own = lambda i: F.filter("_all", lambda p: p["s"] == i)
    for i, name in enumerate(("_bp", "_pit", "_wf", "_ex", "_ck", "_rules", "_skills", "_refs")):
        df = df.withColumn(name, F.transform(own(i), shown.get(name, lambda p: p["v"])))
    filled = F.when(F.size("_bp") > 0, F.col("_bp")).when(F.size("_rules") > 0, F.col("_rules")).otherwise(F.col("_skills"))
    df = df.withColumn("_b", filled).withColumn("_c", F.when(F.size("_ck") > 0, F.col("_ck")).when(F.size("_rules") > 0, F.col("_rules")).otherwise(F.col("_b")))
    steps = F.when(F.size("_rules") > 0, F.col("_rules")).when(F.size("_c") > 0, F.col("_c")).when(F.size("_b") >= 2, F.col("_b")).otherwise(F.array().cast("array<string>"))
    made = F.transform(steps, lambda r, i: F.struct(F.concat(F.lit("Step "), (i + 1).cast("string")).alias("title"), r.alias("description")))
    fallback = F.concat(F.lit("Skill derived from "), F.col("n_units").cast("string"), F.lit(" knowledge units."))
    description = F.coalesce(F.get("_b", F.lit(0)), F.get("_long", F.lit(0)), fallback)
    return df.select(
        group,
        T.skill_name(F.col("_lead.t")).alias("name"),
        F.substring(F.substring(description, 1, 300), 1, 500).alias("description"),
        F.slice("_b", 1, most).alias("best_practices"),
        F.slice("_pit", 1, most).alias("pitfalls"),
        F.slice(F.when(F.size("_wf") > 0, F.col("_wf")).otherwise(made), 1, most).alias("workflow"),
        F.slice("_ex", 1, most).alias("examples"),
        F.slice(F.col("_c") if checklist else F.array().cast("array<string>"), 1, most).alias("checklist"),
        F.slice(F.array_distinct("_refs"), 1, most).alias("references"),
        F.slice("_tags", 1, most).alias("tags"),
        T.category(F.col("_tags")).alias("category"),
        "quality_score",
        F.transform("_ids", lambda x: x["o"]).alias("knowledge_ids"),
        *(["source_chapters"] if "source_reference" in units.columns else []),
    )


def numbered(rows: DataFrame, by: list[str], order: str, name: str) -> DataFrame:
    """Rows with their number from 1 in each group ``by``, in ``order``; a large group is dealt over tasks, each of which counts on from those before."""
    dealt = written(rows.repartitionByRange(*by, order).withColumn("_part", F.spark_partition_id()), "dealt")
    before = F.sum("_c").over(Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    counts = dealt.groupBy(*by, "_part").agg(F.count(F.lit(1)).alias("_c")).select(*by, "_part", F.coalesce(before, F.lit(0)).alias("_c"))
    ranked = dealt.withColumn(name, F.row_number().over(Window.partitionBy(*by, "_part").orderBy(order))).join(counts, [*by, "_part"])
    return ranked.withColumn(name, F.col(name) + F.col("_c")).drop("_part", "_c")


def unique_names(skills: DataFrame, order: str, within: str | None = None) -> DataFrame:
    """Names made unique, over the table or ``within`` each of its parts: in ``order``, a taken name gets the lowest number from 2 on that is free.

    Names can meet only if one is the other with numbers at its end. Where a name has no such other, its records are numbered, over many tasks; only
    families of names that do have one are gone through in order, each in a task. ``order`` is unique.
    """
    scope = F.lit("") if within is None else F.col(within).cast("string")
    keyed = written(skills.select(F.col(order).alias("_by"), scope.alias("_in"), F.col("name").alias("_before"), F.regexp_replace("name", r"(-\d+)+$", "").alias("_root")), "names")
    names = keyed.select("_in", "_root", "_before").distinct()
    parts = F.split(F.substring("_before", F.length("_root") + 1, F.length("_before")), "-")
    shorter = F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.concat("_root", F.array_join(F.slice(parts, F.lit(1), i), "-"))))
    pairs = names.select("_in", "_before", F.explode(shorter).alias("_short")).join(names.select("_in", F.col("_before").alias("_short")), ["_in", "_short"])
    tied = pairs.select("_in", "_before").unionByName(pairs.select("_in", F.col("_short").alias("_before"))).distinct()

    def run(family: pd.DataFrame) -> pd.DataFrame:
        family = family.sort_values("_k", ignore_index=True)
        taken: set[str] = set()
        least: dict[str, int] = {}  # all lower numbers of a name are taken
        given = []
        for name in family["_before"]:
            if name in taken:
                n = next(n for n in itertools.count(least.get(name, 2)) if f"{name}-{n}" not in taken)
                least[name] = n + 1
                name = f"{name}-{n}"
            given.append(name)
            taken.add(name)
        return family.assign(_name=given)[["_in", "_name", "_root", "_k"]]

    free = numbered(keyed.join(tied, ["_in", "_before"], "left_anti"), ["_in", "_before"], "_by", "_k")
    free = free.select("_by", "_in", F.when(F.col("_k") == 1, F.col("_before")).otherwise(F.concat_ws("-", "_before", F.col("_k").cast("string"))).alias("_name"))
    placed = numbered(keyed.join(tied, ["_in", "_before"], "left_semi"), ["_in", "_root"], "_by", "_k").withColumn("_k", F.col("_k").cast("long"))
    found = placed.drop("_by").groupBy("_in", "_root").applyInPandas(run, "_in string, _name string, _root string, _k long")
    named = placed.join(found, ["_in", "_root", "_k"]).select("_by", "_in", "_name").unionByName(free)
    joined = skills.withColumns({"_own_order": F.col(order), "_own_scope": scope}).join(named, (F.col("_own_order") == F.col("_by")) & (F.col("_own_scope") == F.col("_in")))
    return joined.withColumn("name", F.col("_name")).drop("_by", "_own_order", "_in", "_own_scope", "_name")


def capped(skills: DataFrame, book: str, rank: Column, most: int = 50) -> DataFrame:
    """The first ``most`` records of each book; the cap is the operator."""
    return skills.withColumn("_n", F.row_number().over(Window.partitionBy(book).orderBy(rank))).where(F.col("_n") <= most).drop("_n")


def reviewed(skills: DataFrame) -> DataFrame:
    """Rubric score (whole numbers), status, feedback and notes on what is missing."""
    has = lambda c: F.size(c) > 0
    full = F.length(F.trim("description")) > 50
    part = lambda ok, points: F.when(ok, F.lit(points)).otherwise(F.lit(0.0))
    score = part(full, 3.0) + part(has("best_practices"), 2.0) + part(has("workflow"), 2.0) + part(has("pitfalls"), 1.5) + part(has("examples"), 1.5)
    named = F.trim("name") != ""
    score = F.when(named, score).otherwise(F.lit(0.0))
    met = {"description": full, "tags": has("tags") & (F.coalesce("category", F.lit("")) != "")}
    lacking = F.array_compact(F.array(*[F.when(~(met[what] if what in met else has(what)), F.lit(note)) for what, note in V.REVIEW_NOTES.items()]))
    notes = F.when(F.size(lacking) == 0, F.array(F.lit(V.REVIEW_COMPLETE))).otherwise(lacking)
    stored, feedback = F.floor(score).cast("int"), F.lit(None)
    for name, words in V.REVIEW_FEEDBACK.items():
        feedback = F.when(status(score) == name, F.lit(words)).otherwise(feedback)
    feedback = F.when(named, feedback).otherwise(F.lit(V.REVIEW_NAMELESS[0]))
    notes = F.when(named, notes).otherwise(F.array(F.lit(V.REVIEW_NAMELESS[1])))
    return skills.withColumns({"score": stored, "status": status(stored), "review_feedback": feedback, "review_notes": notes})


def status(score: Column) -> Column:
    return F.when(score >= 7, "approved").when(score >= 4, "reviewed").otherwise("rejected")


def markdown(skills: DataFrame) -> Column:
    """A record as a Markdown document with front matter; empty sections, and columns that the table lacks, are left out."""
    section = lambda head, items, end="\n": F.when(F.size(items) > 0, F.concat(F.lit(f"## {head}\n\n"), F.array_join(items, "\n"), F.lit(end)))
    front = lambda name: F.when(F.col(name) != "", F.concat(F.lit(f"{name}: "), name)) if name in skills.columns else F.lit(None).cast("string")
    listed_ = lambda name: F.when(F.size(name) > 0, F.concat(F.lit(f"{name}: ["), F.array_join(name, ", "), F.lit("]"))) if name in skills.columns else F.lit(None).cast("string")
    told = lambda w: F.when(F.coalesce(w["description"], F.lit("")) != "", F.concat(F.lit("\n\n"), w["description"], F.lit("\n"))).otherwise("")
    steps = F.transform("workflow", lambda w, i: F.concat(F.lit("### "), (i + 1).cast("string"), F.lit(". "), w["title"], told(w)))
    shown = F.transform("examples", lambda e: F.concat(F.lit("### "), e["title"], F.lit("\n```\n"), e["code"], F.lit("\n```\n")))
    bullets = lambda name, mark: F.transform(name, lambda x: F.concat(F.lit(mark), x))
    return F.array_join(
        F.array_compact(
            F.array(
                F.lit("---"), F.concat(F.lit("name: "), "name"), F.concat(F.lit('description: "'), "description", F.lit('"')), front("version"), listed_("tags"), listed_("related_skills"), front("category"), F.lit("---\n"),
                F.concat(F.lit("# "), "name", F.lit("\n")), F.concat("description", F.lit("\n")),
                section("Best Practices", bullets("best_practices", "- ")), section("Workflow", steps, ""), section("Examples", shown, ""),
                section("Pitfalls", bullets("pitfalls", "- ⚠️ ")), section("Checklist", bullets("checklist", "- [ ] ")), section("References", bullets("references", "- ")),
            )
        ),
        "\n",
    )


def searched() -> tuple[list[Column], tuple[Column, ...]]:
    """The fields of a stored record that a search looks through: texts, and lists whose texts are a field each."""
    texts = ("name", "description", "category", "source_book", "review_feedback")
    lists = ("tags", "best_practices", "pitfalls", "checklist", "references")
    inner = (("workflow", "title"), ("workflow", "description"), ("examples", "title"), ("examples", "code"))
    return [F.col(c) for c in texts], (*[F.col(c) for c in lists], *[F.col(f"{c}.{f}") for c, f in inner])


def listed(skills: DataFrame, category: str = "", status_: str = "", tags: list[str] | None = None, limit: int | None = None, offset: int = 0, order: tuple[Column, ...] = ()) -> DataFrame:
    """Filter first, then sort and page; empty arguments filter nothing."""
    df = skills
    if category:
        df = df.where(F.col("category") == category)
    if status_:
        df = df.where(F.col("status") == status_)
    if tags:
        df = df.where(F.arrays_overlap("tags", F.array(*[F.lit(t) for t in tags])))
    df = df.orderBy(*order) if order else df
    df = df.offset(offset) if offset else df
    return df.limit(limit) if limit is not None else df


def histogram(skills: DataFrame, column: str, blank: str = "uncategorized") -> DataFrame:
    """``(value, n)`` of a column, the most frequent first, ties by value; blanks under one name."""
    value = F.coalesce(F.nullif(F.col(column), F.lit("")), F.lit(blank))
    return skills.groupBy(value.alias("value")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value")


def stats(skills: DataFrame, source: str) -> DataFrame:
    return skills.agg(
        F.count(F.lit(1)).alias("total"), F.count_distinct(F.col(source)).alias("sources"), F.count_if(F.col("status") == "approved").alias("approved"),
        F.count_if(F.col("status") == "reviewed").alias("reviewed"), F.count_if(F.col("status") == "rejected").alias("rejected"),
        F.count_if(F.col("status") == "draft").alias("draft"), F.count_if(F.col("status") == "published").alias("published"),
        F.coalesce(F.round(F.avg("quality_score"), 2), F.lit(0.0)).alias("avg_quality"), F.max("quality_score").alias("max_quality"), F.min("quality_score").alias("min_quality"),
    )
