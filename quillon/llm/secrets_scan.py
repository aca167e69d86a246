"""Secrets in texts: candidate strings, judged by a random forest. DataFrame expressions only.

Candidates are runs of key-like characters that have a digit or start as known keys do, and whatever is
assigned to a secret name. A forest over their length, character
classes and transitions, dictionary coverage, path marks and neighbouring words removes false findings. It
is trained from labelled findings and compiled into a column expression, so scanning a text is one row's work.
"""

from __future__ import annotations

import re

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.quality import SPACE

LEAST = 12
RUN = rf"[A-Za-z0-9+/_\-]{{{LEAST},}}"
#: All neighbouring key-like characters; free candidates are such runs.
WHOLE_RUN = r"[A-Za-z0-9+/_\-]+"
#: A text without a match has no candidate.
CUE = rf"(?<![A-Za-z0-9+/_\-])(?=[A-Za-z+/_\-]*[0-9])[A-Za-z0-9+/_\-]{{{LEAST},}}"
MASK = "[SECRET]"
#: Marks where an assigned value begins while words are told apart; it is no character, and is read as ? where a text holds it.
STOP = "\uffff"
#: Characters of a word, before and after a candidate and with the three runs or values before it at most, that its features see; so a word
#: of many candidates costs no more than as many words.
REACH = 200
#: Labelled findings that train the forest at most.
FINDINGS = 8_000
TREES, DEPTH = 15, 6
#: Names before secrets, names before harmless values, and words of identifiers; fixed values.
SECRET_NAMES = ("token", "secret", "password", "passwd", "pwd", "apikey", "api_key", "api-key", "access_key", "auth", "credential", "bearer", "private_key", "client_secret")
HARMLESS_NAMES = ("commit", "sha", "sha1", "sha256", "md5", "checksum", "digest", "hash", "etag", "uuid", "guid", "revision", "build", "version", "isbn", "order", "invoice", "card", "phone", "parcel", "session_id", "request_id", "id")
DICTIONARY = ("example", "sample", "changeme", "change", "password", "secret", "token", "your", "here", "test", "dummy", "placeholder", "value", "string", "config", "default", "public", "index", "page", "image", "photo", "file", "report", "section", "chapter", "version", "release", "december", "january", "october", "monday", "http", "html", "json", "node", "user", "name", "data", "table", "column", "insert", "select", "with", "from", "that", "this", "tion", "ing", "and", "the")
PREFIXES = ("AKIA", "ASIA", "ghp_", "gho_", "glpat-", "xox", "sk-", "sk_live_", "AIza", "SG", "npm_", "eyJ")
#: Starts of keys, after which runs of any length and without digits are candidates too.
MARKED = rf"(?<![A-Za-z0-9+/_\-])(?:{'|'.join(PREFIXES)})[A-Za-z0-9+/_\-]+"
#: The whole runs that are long or start as known keys do.
FREE = rf"(?<![A-Za-z0-9+/_\-])(?:(?:{'|'.join(PREFIXES)})[A-Za-z0-9+/_\-]+|{RUN})"
#: A secret name, = or :, and the value, of any characters but spaces, quotes and separators.
LEAD = rf"(?i)(?:{'|'.join(SECRET_NAMES)})[\"']?\s*+[=:]++>?\s*+[\"']?"
ASSIGNED = rf"({LEAD})((?<=\")[^\s\"]+|(?<=')[^\s']+|[^\s\"',;&<>]+)"
FEATURES = ("length", "digits", "uppers", "lowers", "transitions", "kinds", "hex", "coverage", "path", "dashes", "prefix", "named", "assigned", "quoted", "harmless", "follows")


def _any(words: tuple[str, ...]) -> str:
    return "|".join(re.escape(w) for w in sorted(words, key=lambda w: (-len(w), w)))


def described(value: Column, before: Column, word: Column, after: Column) -> dict[str, Column]:
    """The forest's features of a candidate: itself, the text before it, the word that it stands in, and the next word."""
    n = F.length(value).cast("double")
    share = lambda pattern: F.regexp_count(value, F.lit(pattern)) / n
    return {
        "length": n,
        "digits": share("[0-9]"),
        "uppers": share("[A-Z]"),
        "lowers": share("[a-z]"),
        "transitions": share("[A-Za-z](?=[0-9])") + share("[0-9](?=[A-Za-z])"),
        "kinds": F.size(F.array_distinct(F.split(value, ""))) / n,
        "hex": share("[0-9a-fA-F]"),
        "coverage": 1 - F.length(F.regexp_replace(F.lower(value), _any(DICTIONARY), "")) / n,
        "path": F.when(word.rlike(r"://|^/|\.[a-z]{2,4}/") | value.contains("/"), 1.0).otherwise(0.0),
        "dashes": share("[-_]"),
        "prefix": F.when(value.rlike(f"(?i)^({_any(PREFIXES)})"), 1.0).otherwise(0.0),
        "named": F.when(before.rlike(f"(?i)({_any(SECRET_NAMES)})[\"']?\\s*[=:]*>?\\s*[\"']?$"), 1.0).otherwise(0.0),
        "assigned": F.when(before.rlike("[=:]\\s*[\"']?$"), 1.0).otherwise(0.0),
        "quoted": F.when(before.rlike("[\"']$"), 1.0).otherwise(0.0),
        "harmless": F.when(before.rlike(f"(?i)(^|[^a-z])({_any(HARMLESS_NAMES)})[\"']?\\s*[=:]*\\s*[\"']?$"), 1.0).otherwise(0.0),
        "follows": F.when(after.rlike("^[A-Za-z]"), 1.0).otherwise(0.0),
    }


def example_findings(spark: SparkSession, rows: int = 4_000) -> DataFrame:
    """Labelled findings by rule: keys of known kinds in assignments, and look-alikes such as checksums, numbers and placeholders."""
    x = F.sha2(F.concat(F.lit("finding"), F.col("id").cast("string")), 256)
    hexed = lambda k: F.substring(x, 1, k)
    mixed = lambda k: F.substring(F.regexp_replace(F.base64(F.unhex(x)), "[^A-Za-z0-9]", ""), 1, k)
    digits = lambda k: F.substring(F.regexp_replace(F.conv(F.substring(x, 1, 15), 16, 10), "[^0-9]", "7"), 1, k)
    pick = lambda *words: F.element_at(F.array(*[F.lit(w) for w in words]), (F.pmod(F.xxhash64("id", F.lit(len(words))), F.lit(len(words))) + 1).cast("int"))
    upper = F.upper(F.substring(F.regexp_replace(F.base64(F.unhex(x)), "[^A-Za-z0-9]", ""), 1, 16))
    letters = lambda c: F.translate(c, "0123456789", "ghjkmnpqrt")
    name, plain = pick(*SECRET_NAMES), pick("the", "and", "von", "que", "les", "with", "of.", "here,")
    templates = [
        (1, F.concat(name, F.lit(' = "')), hexed(40)),
        (1, F.concat(name, F.lit("=")), hexed(18)),
        (1, F.concat(name, F.lit(": ")), mixed(32)),
        (1, F.concat(name, F.lit("='")), mixed(24)),
        (1, F.concat(plain, F.lit(" ")), F.concat(F.lit("AKIA"), upper)),
        (1, F.concat(plain, F.lit(" ")), F.concat(F.lit("ghp_"), mixed(36))),
        (1, F.concat(F.upper(name), F.lit(' = "')), F.upper(hexed(40))),
        (1, F.concat(F.upper(name), F.lit("=")), F.upper(hexed(18))),
        (1, F.concat(name, F.lit("=")), letters(mixed(10))),
        (1, F.concat(name, F.lit(": ")), F.concat(mixed(4), pick("!", "@", "#", "$"), F.substring(x, 9, 4))),
        (1, F.concat(name, F.lit('="')), F.lower(letters(mixed(9)))),
        (1, F.concat(plain, F.lit(" ")), F.concat(F.lit("AKIA"), F.upper(letters(upper)))),
        (0, F.concat(name, F.lit(": ")), pick("the", "required", "none", "null", "true", "your", "string", "optional", "value", "and", "this", "for", "is")),
        (0, F.concat(name, F.lit("=")), pick("none", "null", "true", "false", "changeme", "your_token", "<token>", "${TOKEN}", "{password}", "secret", "example")),
        (0, F.concat(plain, F.lit(" ")), pick("SGML", "SG", "SGD", "ASIA", "xoxo", "sk-learn", "SGML-based", "ASIAN", "SGI")),
        (0, F.concat(plain, F.lit(" ")), digits(16)),
        (0, F.concat(pick("commit", "sha1", "revision"), F.lit(" ")), hexed(40)),
        (0, F.concat(pick("checksum", "md5", "etag", "sha256"), F.lit(": ")), hexed(32)),
        (0, F.concat(pick("uuid", "id", "request_id"), F.lit("=")), F.concat_ws("-", hexed(8), F.substring(x, 9, 4), F.substring(x, 13, 4), F.substring(x, 17, 12))),
        (0, F.concat(name, F.lit("=")), F.concat(pick("your_token_here_", "changeme_password_", "example-secret-", "placeholder_value_", "dummy_string_"), digits(2))),
        (0, F.concat(plain, F.lit(" https://site/")), F.concat(pick("images/photo/", "report/section/", "page/index-"), digits(8))),
        (0, F.concat(plain, F.lit(" ")), F.concat(pick("december-report-", "chapter_section_", "release-version-", "table_column_"), digits(4))),
        (0, F.concat(pick("order", "invoice", "isbn", "card", "parcel"), F.lit(" ")), digits(14)),
    ]
    kind = F.pmod("id", F.lit(len(templates)))
    cases = F.array(*[F.struct(F.lit(label).alias("label"), before.alias("before"), value.alias("value")) for label, before, value in templates])
    rows_ = spark.range(0, rows, 1, 4).withColumn("c", F.element_at(cases, (kind + 1).cast("int"))).select("id", "c.*")
    last = F.element_at(F.split("before", " "), -1)
    return rows_.select("label", "value", "before", F.concat(last, F.col("value")).alias("word"), F.when(F.col("id") % 3 == 0, F.lit("")).otherwise(F.lit("thand")).alias("after"))


def compiled(model, at) -> Column:
    """A trained forest's share of trees that vote for a secret, as an expression; ``at(i)`` gives feature i."""

    def grow(lines: list[str]) -> Column:
        line = lines.pop(0).strip()
        if line.startswith("Predict:"):
            return F.lit(float(line.split(":")[1]))
        feature, cut = re.match(r"If \(feature (\d+) <= (\S+)\)", line).groups()
        low = grow(lines)
        lines.pop(0)
        return F.when(at(int(feature)) <= float(cut), low).otherwise(grow(lines))

    votes = []
    for tree in model.trees:
        votes.append(grow(tree.toDebugString.strip().splitlines()[1:]))
    return sum(votes[1:], votes[0]) / len(votes)


def train(findings: DataFrame):
    """A forest from ``findings(label, value, before, word, after)``, of which a sample of at most ``FINDINGS``, by hash, is used."""
    rows = findings.orderBy(F.xxhash64("value", "before"), "value", "before").limit(FINDINGS)
    rows = rows.select(F.col("label").cast("double").alias("label"), *[c.cast("double").alias(k) for k, c in described(*[F.col(c) for c in ("value", "before", "word", "after")]).items()])
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows).select("label", "features")
    return RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=7, featureSubsetStrategy="sqrt").fit(vectors)


def bound(x: Column, f) -> Column:
    """``f(x)``, with ``x`` computed once however often ``f`` uses it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def held(x: Column, among: Column) -> Column:
    """Whether a sorted array has a value, by halving; ``among`` is a bound one."""

    def halve(at: Column, _: Column) -> Column:
        middle = F.floor((at["low"] + at["high"]) / 2).cast("int")
        below = F.get(among, middle) < x
        ends = at["low"] >= at["high"]
        return F.struct(F.when(ends | ~below, at["low"]).otherwise(middle + 1).alias("low"), F.when(ends | below, at["high"]).otherwise(middle).alias("high"))

    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(among) + 1)).cast("int"))
    found = F.aggregate(steps, F.struct(F.lit(0).alias("low"), F.size(among).alias("high")), halve, lambda at: at["low"])
    return F.when(F.size(among) <= 8, F.array_contains(among, x)).otherwise(F.coalesce(F.get(among, found) == x, F.lit(False)))


def _cut(pieces: Column) -> Column:
    return F.transform(pieces, lambda x: F.right(x, F.lit(REACH)))


def candidates(text: Column) -> Column:
    """The candidates of a text, in order: word number, the run itself, and the words around it. Linear in the text."""

    def of_word(ws: Column, e: Column) -> Column:
        before = F.concat_ws(" ", *[F.right(F.get(ws, e["i"] - d), F.lit(REACH)) for d in (2, 1)])
        runs, gaps = F.regexp_extract_all(e["w"], F.lit(FREE), F.lit(0)), F.split(e["w"], FREE)
        parts = F.arrays_zip(gaps.alias("gap"), runs.alias("run"))
        word = F.struct(runs.alias("runs"), _cut(F.transform(parts, lambda p: F.concat(p["gap"], F.coalesce(p["run"], F.lit(""))))).alias("pieces"), F.transform(gaps, lambda g: F.left(g, F.lit(REACH))).alias("gaps"), before.alias("before"), F.coalesce(F.left(F.get(ws, e["i"] + 1), F.lit(REACH)), F.lit("")).alias("after"))

        def one(q: Column, r: Column, j: Column) -> Column:
            upto = F.right(F.concat_ws("", F.slice(q["pieces"], F.greatest(j - 2, F.lit(1)), F.least(j, F.lit(3))), F.right(F.get(q["gaps"], j), F.lit(REACH))), F.lit(REACH))
            return bound(upto, lambda u: F.struct(
                e["i"].cast("long").alias("at"), r.alias("value"), F.concat_ws(" ", F.when(q["before"] != "", q["before"]), u).alias("before"),
                F.concat(u, r, F.coalesce(F.get(q["gaps"], j + 1), F.lit(""))).alias("word"), q["after"].alias("after"),
            ))

        known = lambda v: (v.rlike("[0-9]") & (F.length(v) >= LEAST)) | v.rlike(f"^{MARKED}")
        return bound(word, lambda q: F.filter(F.transform(q["runs"], lambda r, j: one(q, r, j)), lambda c: known(c["value"])))

    words = F.array_remove(F.split(text, SPACE + "+"), "")
    hit = lambda w: ((F.length(w) >= LEAST) & w.rlike(CUE)) | w.rlike(MARKED)
    return bound(words, lambda ws: F.flatten(F.transform(F.filter(F.transform(ws, lambda w, i: F.struct(i.alias("i"), w.alias("w"))), lambda e: hit(e["w"])), lambda e: of_word(ws, e))))


def assigned(text: Column) -> Column:
    """Values of secret names, in order, as ``candidates`` gives them, with their number among the matches of ``ASSIGNED``; those that are long runs with a digit are left to it.

    Values hold no spaces, so each stands in one word: words are told apart once, with a mark before each value. Linear in the text.
    """
    clear = F.replace(text, F.lit(STOP), F.lit("?"))
    words = F.array_remove(F.split(F.regexp_replace(clear, ASSIGNED, f"$1{STOP}$2"), SPACE + "+"), "")
    parts = F.struct(words.alias("words"), F.split(clear, ASSIGNED).alias("gaps"), F.regexp_extract_all(clear, F.lit(ASSIGNED), F.lit(2)).alias("values"))

    def of_word(ws: Column, e: Column) -> Column:
        """Of each value in a word, what stands before it."""
        earlier = [F.replace(F.right(F.get(ws, e["i"] - d), F.lit(REACH)), F.lit(STOP), F.lit("")) for d in (3, 2, 1)]
        word = F.struct(_cut(F.split(e["w"], STOP)).alias("pieces"), F.concat_ws(" ", *earlier[1:]).alias("two"), F.concat_ws(" ", *earlier).alias("three"))

        def one(q: Column, j: Column) -> Column:
            last = F.right(F.concat_ws("", F.slice(q["pieces"], F.greatest(j - 2, F.lit(1)), F.least(j + 1, F.lit(4)))), F.lit(REACH))
            return bound(last, lambda x: F.struct(e["i"].cast("long").alias("at"), x.alias("last"), F.when(x == "", q["three"]).otherwise(F.concat_ws(" ", F.when(q["two"] != "", q["two"]), x)).alias("before")))

        return bound(word, lambda q: F.transform(F.slice(q["pieces"], F.lit(1), F.size(q["pieces"]) - 1), lambda _, j: one(q, j)))

    def listed(p: Column) -> Column:
        marked = F.filter(F.transform(p["words"], lambda w, i: F.struct(i.alias("i"), w.alias("w"))), lambda e: e["w"].contains(STOP))
        places = F.flatten(F.transform(marked, lambda e: of_word(p["words"], e)))

        def one(s: Column, k: Column) -> Column:
            v = F.get(p["values"], k)
            after = F.left(F.regexp_extract(F.get(p["gaps"], k + 1), r"[^\x20\x09-\x0D]+", 0), F.lit(REACH))
            return F.struct(s["at"].alias("at"), v.alias("value"), s["before"].alias("before"), F.concat(s["last"], v).alias("word"), after.alias("after"), k.alias("k"))

        return F.filter(F.transform(places, one), lambda e: ~(e["value"].rlike(f"^{RUN}$") & e["value"].rlike("[0-9]")) & ~e["value"].rlike(f"^{MARKED}$"))

    return bound(parts, listed)


def judged(docs: DataFrame, findings: DataFrame | None = None) -> DataFrame:
    """``docs`` with ``_found``: its candidates with the forest's ``votes`` (0 to 1). Null and empty texts have none."""
    model = train(findings if findings is not None else example_findings(docs.sparkSession))
    text = F.col("text").cast("string")
    listed = docs.withColumn("_c", F.when(text.rlike(f"{CUE}|{MARKED}"), candidates(text)).otherwise(F.array()))
    free = F.transform("_c", lambda e: e.withField("k", F.lit(None).cast("int")))
    listed = listed.withColumn("_c", F.concat(free, F.when(text.rlike(LEAD), assigned(text)).otherwise(F.array())))
    features = F.transform("_c", lambda e: F.struct(e["at"].alias("at"), e["value"].alias("value"), e["k"].alias("k"), F.array(*[c.cast("double") for c in described(e["value"], e["before"], e["word"], e["after"]).values()]).alias("f")))
    listed = listed.withColumn("_f", features)
    voted = F.transform("_f", lambda e: F.struct(e["at"].alias("at"), e["value"].alias("value"), e["k"].alias("k"), compiled(model, lambda i: F.get(e["f"], F.lit(i))).alias("votes")))
    return listed.withColumn("_found", voted).drop("_c", "_f")


def scan(docs: DataFrame, findings: DataFrame | None = None, cutoff: float = 0.5) -> DataFrame:
    """One row per candidate: doc_id, word_at (from 0), n_chars, value_sha256, votes, is_secret.

    Null and empty texts and those without candidates give none; repeated rows, and rows of null doc_id, give theirs each; a word with
    several candidates gives a row for each value. Other columns are left out; no rows give none.
    """
    rows = judged(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), findings)
    rows = rows.select("doc_id", F.explode_outer("_found").alias("e")).where("e IS NOT NULL")  # an inner explode would have the optimiser ask for its size first, and compute it twice
    return rows.select(
        "doc_id", F.col("e.at").alias("word_at"), F.length("e.value").cast("long").alias("n_chars"), F.sha2(F.col("e.value"), 256).alias("value_sha256"),
        F.round("e.votes", 6).alias("votes"), (F.col("e.votes") >= cutoff).alias("is_secret"),
    )


def redact(docs: DataFrame, findings: DataFrame | None = None, cutoff: float = 0.5) -> DataFrame:
    """``docs`` with every secret of a text replaced by ``MASK``; other columns, but for n_chars, stay as they are.

    Values of secret names are masked where they stand, other secrets wherever they are a whole run of key-like characters, never a
    part of one. Null texts stay null; repeated rows are masked each; no rows give none.
    """
    whole = F.col("text").cast("string")
    secrets = F.filter("_found", lambda e: e["votes"] >= cutoff)
    named = F.transform(F.filter(secrets, lambda e: e["k"].isNotNull()), lambda e: e["k"])  # in order, as the matches are
    found = F.arrays_zip(F.split(whole, ASSIGNED).alias("gap"), F.regexp_extract_all(whole, F.lit(ASSIGNED), F.lit(1)).alias("lead"), F.regexp_extract_all(whole, F.lit(ASSIGNED), F.lit(2)).alias("value"))
    inner = bound(named, lambda ks: F.transform(found, lambda m, k: F.concat(m["gap"], F.coalesce(m["lead"], F.lit("")), F.when(held(k, ks), F.lit(MASK)).otherwise(F.coalesce(m["value"], F.lit(""))))))
    placed = F.when(F.size(named) > 0, F.array_join(inner, "")).otherwise(whole)  # short values are masked where they stand only
    runs = F.array_sort(F.array_distinct(F.transform(F.filter(secrets, lambda e: e["k"].isNull()), lambda e: e["value"])))
    parts = F.arrays_zip(F.split("_placed", WHOLE_RUN, -1).alias("gap"), F.regexp_extract_all("_placed", F.lit(WHOLE_RUN), F.lit(0)).alias("run"))
    shown = bound(runs, lambda known: F.transform(parts, lambda p: F.concat(p["gap"], F.when(held(p["run"], known), F.lit(MASK)).otherwise(F.coalesce(p["run"], F.lit(""))))))
    text = F.when(F.size(runs) > 0, F.array_join(shown, "")).otherwise(F.col("_placed"))
    rows = judged(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), "text"), findings)
    changed = rows.select("_row", "_found", placed.alias("_placed")).select("_row", text.alias("_text"))
    out = [F.when(F.col("_row.text").isNotNull(), F.col("_text")).alias(c) if c == "text" else F.when(F.col("_row.text").isNull(), F.col("_row.n_chars")).otherwise(F.length("_text").cast(docs.schema[c].dataType)).alias(c) if c == "n_chars" else F.col(f"_row.`{c}`") for c in docs.columns]
    return changed.select(*out)
