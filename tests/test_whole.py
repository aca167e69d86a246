"""Queries that must take whole texts and tables, against plain loops over a small collection."""

import hashlib
import re

import pytest

from quillon.functions import vocabulary as V
from quillon.plans import inputs
from quillon.plans.queries import QUERIES

TEXTS = (
    "The first line tells of sales and price.\nThe second line tells of a marketing funnel.\n\nThe fourth: of customers and budget.",
    "One line only, about the research of a team.",
    "short\n" + "\n".join(f"line {i} of a long text about product launches" for i in range(12)),
    None,
)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("whole"))
    spark.createDataFrame([(i, t, "en", f"src{i % 2}") for i, t in enumerate(TEXTS)], "doc_id long, text string, lang string, source string").write.parquet(f"{at}/documents.parquet")
    return at


def units():
    """(doc_id, line_no, type, content) of every line of every text."""
    for doc_id, text in enumerate(TEXTS):
        for part, line in enumerate((text or "").split("\n")):
            pick = lambda values: values[(doc_id + part) % len(values)]  # noqa: B023, E731
            for k, made in enumerate((f"{pick(inputs.PREFIXES)}{pick(inputs.KEYWORDS)} {line}", f"  {pick(inputs.PREFIXES[::-1])}{line}", line)):
                found = [(name, m[2].strip(" ")) for name, p in V.UNIT_PATTERNS if (m := re.match(f"(?i){p}", made.strip(" "))) and len(m[2].strip(" ")) >= 10]
                if found:
                    yield doc_id, 3 * part + k, *found[0]


def test_units_of_every_line(spark, folder):
    got = {(r["doc_id"], r["line_no"], r["unit_type"], r["content_hash"]) for r in QUERIES["knowledge_units"](spark, folder).collect()}
    assert got == {(d, n, kind, hashlib.md5(content.encode()).hexdigest()) for d, n, kind, content in units()}
    assert {n // 3 for d, n, *_ in got if d == 2} >= set(range(1, 13))
    ids = [int(i) for r in QUERIES["type_groups"](spark, folder).collect() for i in r["knowledge_ids"].split(",")]
    assert len(set(ids)) == len(ids) == len(got)


def test_whole_texts(spark, folder):
    cleaned = {r["doc_id"]: r["text"] for r in QUERIES["clean_nfkc"](spark, folder).collect()}
    assert "fourth: of customers" in cleaned[0] and "line 11 of" in cleaned[2]
    told = {(r["chunk_id"], r["ord"]): r["content"] for r in QUERIES["llm_unit_coercion"](spark, folder).collect()}
    assert told[0, 1] == "The second line tells of a marketing funnel." and {k for d, k in told if d == 2} == {k for k in range(1, 13) if (2 + k) % 5 != 3}
    heads = [r["line"] for r in QUERIES["heading_lines"](spark, folder).where("doc_id = 2").collect()]
    assert len(heads) > 1 and any("line 11 of" in h for h in heads)


def test_text_repair_of_all_documents(spark, tmp_path):
    texts = ["hyphen-\nated words", "two\n\nparagraphs, the sec- \n  ond one\nlonger", "\nbreak at the start", "at the end\n", "gap-\n\n filled", "- a list\n- of items", "", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")

    def repaired(t):
        out, i, t = "", 0, f"co-\n  operate {t}\nend"
        while i < len(t):
            j = i + 1
            while j < len(t) and t[j].isspace():
                j += 1
            if t[i] == "-" and i and (t[i - 1].isalnum() or t[i - 1] == "_") and "\n" in t[i + 1 : j] and j < len(t) and (t[j].isalnum() or t[j] == "_"):
                i = j
            else:
                out, i = out + t[i], i + 1
        return "".join(" " if c == "\n" and out[k - 1 : k] != "\n" and out[k + 1 : k + 2] != "\n" else c for k, c in enumerate(out))

    got = {r["doc_id"]: r["text_hash"] for r in QUERIES["text_repair"](spark, str(tmp_path)).collect()}
    assert got == {i: None if t is None else hashlib.md5(repaired(t).encode()).hexdigest() for i, t in enumerate(texts)}


def union_find(tagged):
    """The smallest unit of each unit's component; units are joined by lower-cased tags."""
    up = {unit: unit for unit, _ in tagged}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    first = {}
    for unit, tags in tagged:
        for t in tags:
            a, b = root(unit), root(first.setdefault(t.lower(), unit))
            up[max(a, b)] = min(a, b)
    return {unit: root(unit) for unit in up}


def test_topics_span_the_table(spark, tmp_path):
    # ids far apart; a chain of tags, one hot tag, and a unit apart
    texts = {5: "Our budget", 250: "Our budget and sales", 777: "About sales, with an api", 4_000: "The api of a team", 9_001: "Nothing that is known of", 12_345: "Sales again and again"}
    spark.createDataFrame([(k, f"{t} is told of here.\n{t} once more, at length.", "src0") for k, t in texts.items()], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    tagged = [(r["ord"], r["tags"]) for r in inputs.units(spark, str(tmp_path)).collect()]
    got = {r["unit_id"]: r["topic"] for r in QUERIES["topic_components"](spark, str(tmp_path)).collect()}
    assert got == union_find(tagged)
    assert any(unit >> 31 > (topic >> 31) + 100 for unit, topic in got.items())


def test_pairs_far_apart_in_a_source(spark, tmp_path):
    text = "Close the quarter with a review of each open customer account.\nKeep a list of late payments and call the owners."
    far = 7 * len(inputs.KEYWORDS) * 200  # the same prefixes and keywords as 0
    rows = [(d, text if d in (0, far) else f"Entry {d} is about matter{d} and topic{d} with detail{d} in place{d}.", "src0") for d in (0, 501, 1_002, far)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    at = str(tmp_path)
    assert [tuple(r) for r in QUERIES["dedup_content_jaccard"](spark, at).collect()] == [("src0", 0, far // 5, 1.0)]
    gone = {r["no"]: (r["survivor"], r["method"]) for r in QUERIES["dedup_greedy"](spark, at).collect()}
    assert gone[far // 5] == (0, "semantic") and QUERIES["dedup_counts"](spark, at).first()["removed"] >= 1
    assert {r["no"] for r in QUERIES["dedup_merged"](spark, at).collect()} == {no for no, (kept, _) in gone.items() if no == kept}
    assert (0, 0, 2) in {(r["a"], r["b"], r["n_a"]) for r in QUERIES["kg_edges"](spark, at).where("layer = 'vector'").collect()}  # equal texts: one class, named by the first
