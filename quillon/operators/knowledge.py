"""Knowledge units: lines classified by patterns, with titles, confidence and tags."""

from __future__ import annotations

import ast
import contextlib
import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from quillon.functions import text as T
from quillon.functions import vocabulary as V


#: How every pattern ends: the content of a line behind its head. A content ends before these.
_REST = r"\s*(.+)"
_ENDS = ("\r", "\x85", "\u2028", "\u2029")
#: A rest whose content has ten characters, without spaces around it.
_TEN = "^ *+[^ {0}][^{0}]{{8,}}?[^ {0}]".format("".join(_ENDS))


def _heads(kinds: tuple[str, ...]) -> str:
    """One pattern of the heads of all ``kinds``, which exclude each other, so that a line is matched once."""
    return f"(?i)^(?:{'|'.join(pattern.removesuffix(_REST) for name, pattern in V.UNIT_PATTERNS if name in kinds)})\\s*"


def _letters(pattern: str) -> list[str]:
    """The letters of a pattern's heads, by which they are told."""
    return [re.sub(r"\\[sd]|[^A-Za-z]", "", head).lower() for head in pattern[1 : pattern.index(")")].split("|")]


def _rest(line: Column, head: Column) -> Column:
    return F.substring(line.cast("binary"), F.length(head) + 1, F.octet_length(line)).cast("string")  # heads are ASCII


def _fits(line: Column, head: Column) -> Column:
    """Whether a content has ten characters; the twelve behind the head tell it of nearly all, without the content being made."""
    near, sure = F.substring(line, F.length(head) + 1, F.lit(12)), F.lit(True)
    for end in _ENDS:
        sure = sure & ~near.contains(end)
    return F.when(sure & (F.length(F.trim(near)) >= 10), F.lit(True)).otherwise(_rest(line, head).rlike(_TEN))


def _content(line: Column, head: Column) -> Column:
    """What a pattern's group 2 is, without going through all of a line in the regular expression, which takes most of the time."""
    rest = _rest(line, head)
    cut, some = rest, F.lit(False)
    for end in _ENDS:
        cut, some = F.substring_index(cut, end, 1), some | line.contains(end)
    return F.trim(F.when(some, cut).otherwise(rest))  # to be told that there is no end is far cheaper than a cut


def raw_title(line: Column, kind: Column) -> Column:
    """What a line says before its first dash, else before its first colon; its type if it has neither."""
    raw = F.when(line.contains("—"), F.substring_index(line, "—", 1)).when(line.contains(":"), F.substring_index(line, ":", 1)).otherwise(kind)
    return F.trim(raw)


def confidence(kind: Column, content: Column) -> Column:
    """In whole thousandths, so that halves round up exactly: a base by type, more for length, 0.95 at most."""
    base = F.lit(400)
    for name, value in V.BASE_CONFIDENCE.items():
        base = F.when(kind == name, F.lit(round(1000 * value))).otherwise(base)
    return F.floor((F.least(base + F.least(F.length(content), F.lit(300)), F.lit(950)) + 5) / 10) / 100


def units(chunks: DataFrame, keys: list[str], text: str = "text", least: float = 0.3, most: int = 10, allowed: tuple[str, ...] = V.UNIT_TYPES) -> DataFrame:
    """At most ``most`` units of ``allowed`` types of each chunk, in order of lines: type, title, content, confidence, tags."""
    kinds = tuple(name for name, _ in V.UNIT_PATTERNS if name in allowed)
    if not kinds:
        return units(chunks, keys, text, least, 0)
    pattern = _heads(kinds)

    lettered = lambda head: F.lower(F.regexp_replace(head, "[^A-Za-z]", ""))

    def kind(letters: Column) -> Column:
        out = F.lit(kinds[-1])
        for name, pattern_ in reversed([p for p in V.UNIT_PATTERNS if p[0] in kinds[:-1]]):
            out = F.when(letters.isin(*_letters(pattern_)), F.lit(name)).otherwise(out)
        return out

    fits = lambda x: _fits(x["line"], x["head"])
    if least > 0.4:  # no unit has less
        kept = lambda x: F.when(fits(x), confidence(kind(lettered(x["head"])), _content(x["line"], x["head"])) >= least).otherwise(F.lit(False))
    else:
        kept = fits
    headed = F.transform(F.split(F.col(text), "\n"), lambda x, i: F.struct(i.alias("line_no"), F.trim(x).alias("line"), F.regexp_extract(F.trim(x), pattern, 0).alias("head")))
    # a chunk is a row, so its lines are chosen in place; the rest is made of chosen lines only, outside of lambdas, as those are interpreted and copy what they make
    df = chunks.select(*keys, F.inline(F.slice(F.filter(headed, lambda x: (x["head"] != "") & kept(x)), 1, most)).alias("line_no", "line", "head"))
    df = df.withColumn("content", _content(F.col("line"), F.col("head")))
    # in steps, as what is used again in one expression is computed again
    df = df.withColumns({"_letters": lettered(F.col("head")), "tags": T.inferred_tags(F.col("content"))}).withColumn("unit_type", kind(F.col("_letters")))
    df = df.withColumns({"_raw": raw_title(F.col("line"), F.col("unit_type")), "confidence": confidence(F.col("unit_type"), F.col("content"))})
    df = df.withColumn("_named", T.title(F.col("_raw")))
    df = df.withColumn("title", F.substring(F.when(F.col("_named") != "", F.col("_named")).otherwise(F.substring("content", 1, 60)), 1, 120))
    return df.select(*keys, "line_no", "unit_type", "content", "title", "confidence", "tags")


#: What is read of an object in a model's answer; ``tags`` are kept as a list, or as one text to be cut.
_TEXT = StringType()
_OBJECT = StructType([StructField(n, _TEXT) for n in ("unit_type", "title", "content", "confidence")] + [StructField("tags", ArrayType(_TEXT)), StructField("tag_text", _TEXT)])


def read_answer(answer: str | None) -> list | dict | None:
    """The value in an answer: the inside of a code fence if there is one, read as JSON, else its outermost list or object, as JSON or as a Python literal."""
    if not answer or not answer.strip():
        return None
    fenced = re.search(r"```(?:json)?\s*(.*?)```", answer, re.DOTALL)
    body = (fenced[1] if fenced else answer).strip()
    inside = {o: body[body.find(o) : body.rfind(c) + 1] for o, c in ("[]", "{}") if o in body}
    tries = [(json.loads, body), *((json.loads, x) for x in inside.values()), *((ast.literal_eval, inside[o]) for o in "{[" if o in inside)]
    for read, text in tries:
        with contextlib.suppress(ValueError, SyntaxError, MemoryError, RecursionError):
            return read(text)
    return None


def objects(value: object) -> list[dict]:
    """The unit objects of an answer's value: of a list, of the list under ``units``, or the one object."""
    if isinstance(value, dict):
        listed = value.get("units")
        value = listed if isinstance(listed, list) else [value] if {"unit_type", "type", "title"} & value.keys() else []
    return [x for x in value if isinstance(x, dict)] if isinstance(value, list) else []


@F.pandas_udf(ArrayType(_OBJECT))
def _objects(answers: pd.Series) -> pd.Series:
    def one(x: dict) -> dict:
        text = lambda v, default="": default if v is None else str(v)
        tags = x.get("tags")
        return {
            "unit_type": text(x.get("unit_type", x.get("type"))), "title": text(x.get("title")), "content": text(x.get("content")), "confidence": text(x.get("confidence"), None),
            "tags": [text(t) for t in tags] if isinstance(tags, list) else None, "tag_text": tags if isinstance(tags, str) else None,
        }

    return pd.Series([[one(x) for x in objects(read_answer(a))] for a in answers])


def coerced(raw: DataFrame, allowed: tuple[str, ...] = V.UNIT_TYPES) -> DataFrame:
    """Units from a model's answers: ``raw(chunk_id, response)``; see :func:`read_answer` and :func:`objects` for what is understood.

    Types outside ``allowed`` and contents under ten characters are dropped; titles, confidence and tags are put in order.
    Null and unreadable answers give none.
    """
    df = raw.select("chunk_id", F.posexplode(_objects("response")).alias("ord", "u")).select("chunk_id", "ord", "u.*")
    df = df.withColumns({"unit_type": T.unit_type(F.col("unit_type")), "content": F.trim("content")})
    df = df.where(F.col("unit_type").isin(*allowed) & (F.length("content") >= 10))
    tags = T.clean_tags(F.coalesce("tags", F.split("tag_text", r"[,\s]+"), F.array().cast("array<string>")))
    topped = F.when(F.size(tags) < 2, F.slice(F.array_distinct(F.concat(tags, T.inferred_tags(F.col("content")))), 1, 5)).otherwise(tags)
    filled = lambda *texts: F.coalesce(*[F.nullif(t, F.lit("")) for t in texts])
    known = F.coalesce(F.col("confidence").try_cast("double"), F.lit(0.8))
    return df.select(
        "chunk_id", "ord", "unit_type", F.substring(filled(T.title(F.col("title")), T.title(F.substring("content", 1, 60)), F.replace("unit_type", F.lit("_"), F.lit(" "))), 1, 120).alias("title"),
        F.substring("content", 1, 2000).alias("content"), F.round(F.least(F.greatest(known, F.lit(0.0)), F.lit(1.0)), 2).alias("confidence"),
        F.when(F.size(topped) == 0, F.array("unit_type")).otherwise(topped).alias("tags"),
    )


def by_type(units_: DataFrame, book: str, order: str) -> DataFrame:
    """The plain grouping: one record for each type of unit in a book, of quality n/5 up to 1."""
    ids = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o")))), lambda x: x["o"])
    made = units_.groupBy(book, "unit_type").agg(F.count(F.lit(1)).alias("n_units"), ids.alias("knowledge_ids"))
    return made.withColumn("quality_score", F.least(F.col("n_units") / 5, F.lit(1.0)))
