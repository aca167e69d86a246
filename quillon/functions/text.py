"""Scalar text functions as column expressions."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from quillon.functions import vocabulary as V


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def place(among: Column, x: Column) -> Column:
    """How many items of a sorted array are below ``x``, by halving; ``among`` is a bound one."""

    def halve(at: Column, _: Column) -> Column:
        middle = F.floor((at["low"] + at["high"]) / 2).cast("int")
        goes = (at["low"] < at["high"]) & (F.get(among, middle) < x)
        return F.struct(F.when(goes, middle + 1).otherwise(at["low"]).alias("low"), F.when(goes, at["high"]).otherwise(F.least(middle, at["high"])).alias("high"))

    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(among) + 1)).cast("int"))
    return F.aggregate(steps, F.struct(F.lit(0).alias("low"), F.size(among).alias("high")), halve, lambda at: at["low"])


def words(text: Column) -> Column:
    """The runs of text without white space."""
    return F.regexp_extract_all(text, F.lit(r"(?U)\S+"), F.lit(0))


def word_count(text: Column) -> Column:
    return F.size(words(text))


def token_estimate(text: Column) -> Column:
    return F.floor(F.length(text) / 4).cast("int")


def camel_split(text: Column) -> Column:
    return F.regexp_replace(text, "([a-z0-9])([A-Z])", "$1 $2")


def skill_name(raw: Column) -> Column:
    """Kebab-case name: camel case split, marks dropped, without a doubled "how to" and a trailing kind word."""
    plain = F.regexp_replace(F.regexp_replace(camel_split(raw), "[_-]+", " "), "[^a-zA-Z0-9 -]", " ")
    text = F.lower(F.trim(F.regexp_replace(plain, r"\s+", " ")))
    text = F.when(text.rlike("^how to how( |$)"), F.substring(text, 8, 100_000)).otherwise(text)
    parts = F.split(text, " ")
    last = F.element_at(parts, -1)
    shorter = F.when((F.size(parts) > 2) & last.isin(*V.TRAILING), F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    return F.array_join(shorter, "-")


def title(raw: Column) -> Column:
    """Title case that keeps capitals inside words and writes articles small, but for the first word."""
    plain = F.regexp_replace(F.regexp_replace(camel_split(raw), "[_-]+", " "), r"\s+", " ")
    text = F.trim(F.when(raw.rlike(r"[a-z0-9][A-Z]|[_\t\n\x0B\f\r-]|  "), plain).otherwise(raw))  # most need none of it

    def one(w: Column, i: Column) -> Column:
        capital = F.when(w == F.lower(w), F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 100_000))).otherwise(w)
        return F.when((i > 0) & F.lower(w).isin(*V.ARTICLES), F.lower(w)).otherwise(capital)

    return F.array_join(F.transform(F.split(text, " "), one), " ")


def slug(text: Column, longest: int = 60) -> Column:
    plain = F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))
    return F.regexp_replace(F.substring(F.replace(plain, F.lit(" "), F.lit("-")), 1, longest), "-+$", "")


def file_slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def tokens(text: Column) -> Column:
    """Lower-case ASCII words for embeddings, without stop words and single letters."""
    found = F.regexp_extract_all(F.lower(text), F.lit("[a-z]+(?:'[a-z]+)?"), F.lit(0))
    return F.filter(found, lambda t: (F.length(t) > 1) & ~t.isin(*V.STOPWORDS))


def content_tokens(text: Column) -> Column:
    """Distinct words of three letters or more for comparing contents."""
    found = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))
    return F.array_distinct(F.filter(found, lambda t: (F.length(t) > 2) & ~t.isin(*V.CONTENT_STOPWORDS)))


def plain_name(name: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.regexp_replace(name, r"[^a-zA-Z0-9\s]", "")), r"\s+", " "))


def clean_tag(tag: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(tag)), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def clean_tags(raw: Column, most: int = 5, longest: int = 30) -> Column:
    """Tags of a list in kebab case, the first ``most``; longer ones than ``longest`` are left out."""
    cleaned = F.filter(F.transform(raw, clean_tag), lambda t: (t != "") & (F.length(t) <= longest))
    return F.slice(F.array_distinct(cleaned), 1, most)


def unit_type(raw: Column) -> Column:
    """The allowed unit type that a raw name means, or null."""
    name = F.regexp_replace(F.lower(F.trim(raw)), "-", "_")
    known = F.create_map(*[F.lit(x) for pair in V.TYPE_ALIASES.items() for x in pair])
    name = F.coalesce(F.try_element_at(known, name), name)
    return F.when(name.isin(*V.UNIT_TYPES), name)


#: Bytes of contents that are looked through at once, so that they stay in a core's cache.
_PIECE = 1 << 18
#: Letters of both cases and the space as 1 to 27, other bytes as 0; three of them make a code, and here are the codes that a keyword begins with.
_CLASS = np.zeros(256, "uint16")
_CLASS[[*b"abcdefghijklmnopqrstuvwxyz "]] = range(1, 28)
_CLASS[65:91] = range(1, 27)
_KEYS = [_CLASS[[*k.encode()]] for k, _ in V.TAG_KEYWORDS]
_CODES = np.array([k[0] * 784 + k[1] * 28 + k[2] for k in _KEYS])
_BEGINS = np.zeros(28**3, bool)
_BEGINS[_CODES] = True
#: Other letters that are a letter of a keyword in lower case: the Kelvin sign and the capital i with a dot.
_LOWERED = ("\u212a".encode(), "\u0130".encode())


def _hits(text: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which contents, that end at ``ends`` of ``text``, have which keyword: a row for each content, a column for each keyword."""
    out = np.zeros((len(ends), len(_KEYS)), bool)
    if len(text) < 3:
        return out
    kind = _CLASS[text]
    codes = kind[:-2] * np.uint16(784) + kind[1:-1] * np.uint16(28) + kind[2:]
    places = np.flatnonzero(_BEGINS[codes])
    codes = codes[places]
    for i, (key, code) in enumerate(zip(_KEYS, _CODES, strict=True)):
        at = places[codes == code]
        at = at[at + len(key) <= len(text)]
        for j in range(3, len(key)):
            at = at[kind[at + j] == key[j]]
        row = np.searchsorted(ends, at, "right")
        out[row[at + len(key) <= ends[row]], i] = True
    return out


@F.arrow_udf(ArrayType(StringType()))
def _tags_of(contents: pa.Array) -> pa.Array:
    """A batch's bytes tell where a keyword may begin; only there it is looked for, which is several times as fast here as forty of ``contains``."""
    contents = contents.fill_null("").cast(pa.large_string())
    if any(x in memoryview(contents.buffers()[2] or b"").tobytes() for x in _LOWERED):
        contents = pa.array([c.lower() for c in contents.to_pylist()], pa.large_string())
    bounds = np.frombuffer(contents.buffers()[1], "int64")[contents.offset : contents.offset + len(contents) + 1] if len(contents) else np.zeros(1, "int64")
    text, found, low = np.frombuffer(contents.buffers()[2] or b"", "uint8"), [np.zeros((0, len(_KEYS)), bool)], 0
    while low < len(contents):
        high = max(low + 1, int(np.searchsorted(bounds, bounds[low] + _PIECE, "right")) - 1)
        found.append(_hits(text[bounds[low] : bounds[high]], bounds[low + 1 : high + 1] - bounds[low]))
        low = high
    has = np.concatenate(found)
    tags = pa.array([t for _, t in V.TAG_KEYWORDS]).take(pa.array(np.nonzero(has)[1]))
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], has.sum(axis=1).cumsum()]), pa.int32()), tags)


def inferred_tags(content: Column, most: int = 5) -> Column:
    """Tags of the keywords that a content has in it, in order of the list."""
    return F.slice(_tags_of(content), 1, most)


def category(tags: Column) -> Column:
    """The category of the first keyword in the first tag, in sorted order, that has one; else business."""

    def of(tag: Column) -> Column:
        out = F.lit(None).cast("string")
        for name, keys in reversed(V.CATEGORY_KEYWORDS):
            hit = F.lit(False)
            for k in keys:
                hit = hit | tag.contains(k)
            out = F.when(hit, F.lit(name)).otherwise(out)
        return out

    found = F.filter(F.transform(F.array_sort(tags), of), lambda c: c.isNotNull())
    return F.coalesce(F.get(found, F.lit(0)), F.lit("business"))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 if either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column, norms: Column | None = None) -> Column:
    """Of two vectors; 0 for a zero vector, an empty one or different lengths. ``norms`` is the product of their norms, if known."""
    whole = norm(a) * norm(b) if norms is None else norms
    return F.when((F.size(a) == F.size(b)) & (whole > 0), dot(a, b) / whole).otherwise(F.lit(0.0))
