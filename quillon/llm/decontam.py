"""Benchmark items found in documents within an error budget: pigeonhole pieces, then bit-parallel edit distance.

An item of m characters may differ in ``k = floor(rate * m)`` edits. Cut into k + 1 pieces, at least one piece
stays whole in any passage within the budget, so exact hits of pieces (one Aho-Corasick pass per text) give
all candidates. Myers' bit-parallel algorithm then finds the least distance of the item within the
stretch of text around each hit.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import bound_batches

#: Edits allowed per character of an item.
RATE = 0.05
#: Characters of items that are broadcast at once; a larger benchmark is searched in several passes.
PASS_CHARACTERS = 2_000_000
SCHEMA = "doc_id long, item_id long, distance int, budget int, end_at long"


def folded(text: str | None) -> str:
    """Lower case, white space as single spaces."""
    return " ".join((text or "").lower().split())


class Item:
    """One benchmark text with its pieces and the bit masks of its characters."""

    def __init__(self, ids: list[int], text: str, rate: float):
        self.ids, self.text, self.budget = ids, text, int(rate * len(text))
        self.masks: dict[str, int] = defaultdict(int)
        for i, c in enumerate(text):
            self.masks[c] |= 1 << i

    def pieces(self) -> Iterator[tuple[int, str]]:
        """Offset and text of ``budget + 1`` pieces, as equal in length as can be."""
        n, m = self.budget + 1, len(self.text)
        for j in range(n):
            a, b = j * m // n, (j + 1) * m // n
            yield a, self.text[a:b]

    def distance(self, stretch: str) -> tuple[int, int]:
        """Least edit distance of the item to any part of a stretch, and where the first such part ends."""
        m, masks = len(self.text), self.masks
        full, high = (1 << m) - 1, 1 << (m - 1)
        plus, minus, score = full, 0, m
        best, end = m, 0
        for at, c in enumerate(stretch, 1):
            equal = masks.get(c, 0)
            vertical = equal | minus
            horizontal = (((equal & plus) + plus) ^ plus) | equal
            up, down = minus | (full & ~(horizontal | plus)), plus & horizontal
            if up & high:
                score += 1
            elif down & high:
                score -= 1
            up, down = (up << 1) & full, (down << 1) & full
            plus, minus = down | (full & ~(vertical | up)), up & vertical
            if score < best:
                best, end = score, at
                if not best:
                    break
        return best, end


class Finder:
    """All items' pieces in one automaton."""

    def __init__(self, items: list[tuple[int, str]], rate: float = RATE):
        by_text: dict[str, list[int]] = {}
        for number, text in items:
            by_text.setdefault(folded(text), []).append(number)
        by_text.pop("", None)
        self.items = [Item(sorted(ids), text, rate) for text, ids in sorted(by_text.items())]
        places: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for i, item in enumerate(self.items):
            for offset, piece in item.pieces():
                places[piece].append((i, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, where in places.items():
            self.automaton.add_word(piece, (len(piece), where))
        if places:
            self.automaton.make_automaton()

    def find(self, text: str | None, first: bool = False) -> list[tuple[Item, int, int]]:
        """``(item, distance, end)`` of the items within their budgets; the least distance of each, at its first place."""
        text = folded(text)
        if not self.items or not text:
            return []
        stretches: dict[int, list[list[int]]] = defaultdict(list)
        for end, (size, where) in self.automaton.iter(text):
            for i, offset in where:
                item = self.items[i]
                low = end + 1 - size - offset - item.budget
                high = low + len(item.text) + 2 * item.budget
                spans = stretches[i]
                if spans and low <= spans[-1][1] and low >= spans[-1][0]:
                    spans[-1][1] = max(spans[-1][1], high)
                else:
                    spans.append([low, high])
        out = []
        for i, spans in stretches.items():
            item, best, at = self.items[i], self.items[i].budget + 1, 0
            for low, high in sorted(spans):
                low = max(low, 0)
                distance, end = item.distance(text[low : max(high, 0)])
                if distance < best:
                    best, at = distance, low + end
            if best <= item.budget:
                out.append((item, best, at))
                if first:
                    break
        return out


_built: dict[str, Finder] = {}


def _finder(key: str, items: Broadcast, rate: float) -> Finder:
    """One automaton per worker and portion."""
    if key not in _built:
        _built.clear()
        _built[key] = Finder(items.value, rate)
    return _built[key]


def passes(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The benchmark's items in portions of about ``PASS_CHARACTERS``; one portion for all but huge ones."""
    rows = benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), "text")
    total = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    portions = 1 + int(total) // PASS_CHARACTERS
    for k in range(portions):
        yield [(r["item_id"], r["text"]) for r in rows.where(F.pmod(F.xxhash64("item_id"), F.lit(portions)) == k).toLocalIterator()]


def matches(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """One row per document and item found in it: doc_id, item_id, distance, budget, end_at (in the folded text).

    Texts are compared in lower case with single spaces. Items of equal text are all reported; empty
    items and null or empty texts match nothing. Repeated rows report each; no rows give none.
    """
    bound_batches(docs.sparkSession)
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = None
    for portion in passes(benchmark):
        items, key = docs.sparkSession.sparkContext.broadcast(portion), uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch], items: Broadcast = items, key: str = key) -> Iterator[pa.RecordBatch]:
            finder = _finder(key, items, rate)
            for batch in batches:
                rows = [(doc.as_py(), n, d, item.budget, end) for doc, text in zip(*batch.columns, strict=True) for item, d, end in finder.find(text.as_py()) for n in item.ids]
                columns = list(zip(*rows, strict=True)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64()), strict=True)], ["doc_id", "item_id", "distance", "budget", "end_at"])

        found = narrow.mapInArrow(run, SCHEMA)
        out = found if out is None else out.unionByName(found)
    return out


def keep_clean(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """The documents without any item in them, with their own columns; row by row, without a shuffle.

    Null and empty texts hold no item and stay, as do all documents where there are no items; repeated rows stay or go together; no rows give none.
    """
    bound_batches(docs.sparkSession)
    for portion in passes(benchmark):
        items, key = docs.sparkSession.sparkContext.broadcast(portion), uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch], items: Broadcast = items, key: str = key) -> Iterator[pa.RecordBatch]:
            finder = _finder(key, items, rate)
            for batch in batches:
                at = batch.schema.get_field_index("text")
                yield batch.filter(pa.array([not finder.find(text.as_py(), first=True) for text in batch.column(at)], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
