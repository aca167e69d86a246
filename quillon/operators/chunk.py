"""Chunking in column expressions: one text in, its chunks out, without a shuffle or a Python worker.

Word counts of the parts of a text (paragraphs, sentences) decide where chunks begin; one fold over the counts yields
the beginnings, and chunks are slices of the parts. A chunk's overlap is a slice of the text's words that ends where
the chunk's own first part begins.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.text import bound, place, word_count, words
from quillon.functions.vocabulary import HEADING

_STARTS = "array<struct<at:int,tail:int,word:int>>"
_TEXTS = "array<string>"
#: Beginnings that a fold appends to one list before it begins the next; so appending copies few at a time.
LISTED = 256


def fixed(docs: DataFrame, key: str, most: int = 800, overlap: int = 100) -> DataFrame:
    """Windows of ``most`` words that overlap by ``overlap``; native, one row in, its chunks out."""
    if overlap >= most:
        raise ValueError("the overlap must be smaller than the window")
    step = most - overlap
    df = docs.select(key, words(F.col("text")).alias("_w")).where(F.size("_w") > 0)
    count = F.greatest(F.lit(1), F.ceil((F.size("_w") - most) / step) + 1).cast("int")
    chunk = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.array_join(F.slice("_w", i * step + 1, F.lit(most)), " "))
    return df.select(key, F.posexplode(chunk).alias("index", "text")).withColumn("word_count", word_count(F.col("text")))


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def paragraphs(text: Column) -> Column:
    return F.split(stripped(text), r"(?U)\n\s*\n")


def positions(items: Column) -> Column:
    """Numbers from 0 of an array's items."""
    return F.transform(items, lambda _, i: i)


def beginnings(sizes: Column, heads: Column | None, most: int, overlap: int = 0) -> Column:
    """Where chunks begin if parts of ``sizes`` words are packed up to ``most``: the part, the words of overlap before it, the words of parts before it.

    A part in ``heads`` begins a chunk without overlap. A chunk closed for want of room hands on its last ``overlap`` words if it has more.
    """
    parts = F.transform(sizes, lambda n, i: F.struct(i.alias("at"), n.alias("n"), (F.get(heads, i) if heads is not None else F.lit(False)).alias("head")))

    def step(state: Column, part: Column) -> Column:
        held, n = state["held"], part["n"]
        headed = part["head"] & (held > 0)
        full = held + n > most
        opens = headed | full | (part["at"] == 0)
        tail = F.when(full & ~headed & (held > overlap), F.lit(overlap)).otherwise(F.lit(0))
        start = F.struct(part["at"].alias("at"), tail.alias("tail"), state["word"].alias("word"))
        filled = opens & (F.size(state["starts"]) >= LISTED)
        return F.struct(
            F.when(filled, F.array_append(state["before"], state["starts"])).otherwise(state["before"]).alias("before"),
            F.when(filled, F.array(start)).when(opens, F.array_append(state["starts"], start)).otherwise(state["starts"]).alias("starts"),
            F.when(opens, tail + n).otherwise(held + n).alias("held"),
            (state["word"] + n).alias("word"),
        )

    none = F.struct(F.array().cast(f"array<{_STARTS}>").alias("before"), F.array().cast(_STARTS).alias("starts"), F.lit(0).alias("held"), F.lit(0).alias("word"))
    return F.aggregate(parts, none, step, lambda state: F.concat(F.flatten(state["before"]), state["starts"]))


def slices(parts: Column, starts: Column, between: str, every: Column | None = None) -> Column:
    """The chunks that begin at ``starts``: parts joined, behind their overlap from ``every`` word of the text."""

    def one(s: Column, j: Column) -> Column:
        own = F.array_join(F.slice(parts, s["at"] + 1, F.coalesce(F.get(starts, j + 1)["at"], F.size(parts)) - s["at"]), between)
        if every is None:
            return own
        tail = F.array_join(F.slice(every, F.greatest(s["word"] - s["tail"], F.lit(0)) + 1, s["tail"]), " ")
        return F.when(s["tail"] > 0, F.concat(tail, F.lit(between), own)).otherwise(own)

    return F.transform(starts, one)


def sentences(text: Column, most: int) -> Column:
    """Sentences packed up to ``most`` words; a longer one stays whole."""
    cut = F.split(text, r"(?U)(?<=[.!?])\s+")
    return bound(cut, lambda parts: bound(beginnings(F.transform(parts, word_count), None, most), lambda starts: slices(parts, starts, " ")))


def semantic(text: Column, most: int, least: int, overlap: int) -> Column:
    """Paragraphs packed up to ``most`` words and never cut; headings begin anew, full chunks hand on their last words."""
    def cut(parts: Column, listed: Column) -> Column:
        heads = F.transform(parts, lambda p: stripped(p).rlike(HEADING))
        starts = bound(heads, lambda h: beginnings(F.transform(listed, lambda w: F.size(w)), h, most, overlap))
        return bound(F.struct(starts.alias("starts"), F.flatten(listed).alias("every")), lambda x: slices(parts, x["starts"], "\n\n", x["every"]))

    return bound(paragraphs(text), lambda parts: bound(F.transform(parts, words), lambda listed: cut(parts, listed)))


def paragraph(text: Column, most: int, least: int, overlap: int) -> Column:
    """A chunk for each paragraph; those below a quarter of ``most`` go in front of the next that fits, longer ones are cut at sentences.

    Short paragraphs wait for one that fits even where a long one comes before it, and come last if none does.
    """
    few = most // 4

    def cut(known: Column) -> Column:
        parts, sizes, numbers = known["parts"], known["sizes"], known["numbers"]
        size = lambda i: F.get(sizes, i)
        fitting = F.filter(numbers, lambda i: (size(i) <= most) & (size(i) >= few))
        waiting = lambda first, last: F.filter(F.slice(numbers, first + 1, last - first + 1), lambda i: size(i) <= most)
        joined = lambda at: F.array_join(F.transform(at, lambda i: F.get(parts, i)), "\n\n")

        def placed(fits: Column) -> Column:
            before = lambda i: F.coalesce(F.get(fits, place(fits, i) - 1), F.lit(-1))
            made = F.transform(
                F.filter(numbers, lambda i: size(i) >= few),
                lambda i: F.when(size(i) > most, sentences(F.get(parts, i), most)).otherwise(F.array(joined(waiting(before(i) + 1, i)))),
            )
            rest = waiting(F.coalesce(F.get(fits, F.size(fits) - 1), F.lit(-1)) + 1, F.size(parts) - 1)
            return F.concat(F.flatten(made), F.when(F.size(rest) > 0, F.array(joined(rest))).otherwise(F.array().cast(_TEXTS)))

        return bound(fitting, placed)

    return bound(paragraphs(text), lambda p: bound(F.struct(p.alias("parts"), F.transform(p, word_count).alias("sizes"), positions(p).alias("numbers")), cut))


def tail(text: Column, n: int) -> Column:
    """The last ``n`` words of a text that has more; else an empty text."""
    return bound(words(text), lambda w: F.when(F.size(w) > n, F.array_join(F.slice(w, F.size(w) - n + 1, F.lit(n)), " ")).otherwise(F.lit("")))


def joined_to(parts: Column, fits: Callable[[Column], Column], between: str) -> Column:
    """``(index, text)`` of parts; all but the first that don't ``fit`` are joined to the one before, which keeps its number."""
    kept = F.filter(positions(parts), lambda i: (i == 0) | fits(F.get(parts, i)))

    def joined(kept: Column) -> Column:
        def one(i: Column, j: Column) -> Column:
            upto = F.coalesce(F.get(kept, j + 1), F.size(parts))
            return F.struct(i.alias("index"), F.array_join(F.slice(parts, i + 1, upto - i), between).alias("text"))

        return F.transform(kept, one)

    return bound(kept, joined)  # else all parts would be judged again for each


def overlapped(parts: Column, least: int, overlap: int) -> Column:
    """Parts behind the last words of the one before; what then has less than ``least`` words is joined to the one before. No overlap: as they are."""
    if overlap <= 0:
        return parts

    def one(p: Column, i: Column) -> Column:
        put = lambda last: F.when(last != "", F.concat(last, F.lit("\n"), p)).otherwise(p)
        return F.when(i > 0, bound(tail(F.get(parts, i - 1), overlap), put)).otherwise(p)

    made = bound(F.transform(parts, one), lambda x: F.transform(joined_to(x, lambda p: word_count(p) >= least, "\n"), lambda c: c["text"]))
    return F.when(F.size(parts) > 1, made).otherwise(parts)


def recursive(text: Column, most: int, least: int, overlap: int) -> Column:
    """The mark of a heading that a text begins with, and its rest: one chunk if they fit, else the rest cut at sentences if need be; with overlaps.

    Texts without one are cut as by :func:`paragraph`.
    """
    def cut(known: Column) -> Column:
        mark, rest, size = known["mark"], known["rest"], known["size"]
        whole = F.array(F.concat(mark, F.lit("\n\n"), rest))
        more = F.concat(F.array(mark), F.when(size > most, sentences(rest, most)).otherwise(F.array(rest)))
        parts = F.when(word_count(mark) + size <= most, whole).otherwise(more)
        return F.when((mark != "") & (rest != ""), bound(parts, lambda p: overlapped(p, least, overlap))).otherwise(paragraph(text, most, least, overlap))

    # each of these goes through the text, so it is computed once
    halves = F.struct(stripped(F.regexp_extract(text, HEADING, 0)).alias("mark"), stripped(F.regexp_replace(text, HEADING, "")).alias("rest"))
    counted = lambda x: bound(F.struct(x["mark"].alias("mark"), x["rest"].alias("rest"), word_count(x["rest"]).alias("size")), cut)
    return bound(halves, counted)


STRATEGIES: dict[str, Callable[[Column, int, int, int], Column]] = {"semantic": semantic, "hybrid": semantic, "paragraph": paragraph, "recursive": recursive}


def folded(docs: DataFrame, key: str, strategy: str = "semantic", most: int = 800, least: int = 80, overlap: int = 100) -> DataFrame:
    """Chunks by a strategy; those below ``least`` words are joined to the one before, so numbers have gaps. Blank texts give none."""
    parts = STRATEGIES[strategy](F.col("text"), most, least, overlap)
    df = docs.select(key, "text").where(F.col("text").rlike(r"(?U)\S")).select(key, parts.alias("_p"))
    made = joined_to(F.col("_p"), lambda p: word_count(p) >= least, "\n\n")
    return df.select(key, F.explode(made).alias("_c")).select(key, "_c.index", "_c.text").withColumn("word_count", word_count(F.col("text")))
