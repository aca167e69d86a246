"""Byte-level BPE by monoid tree reduction.

A piece is halved down to leaves of a byte or two, which are a token each or one per byte, and the token lists of
neighbours are joined up the tree. A join is settled by the pair rule of byte-pair encodings: two valid
encodings put side by side are the encoding of the joined bytes exactly if the two tokens that meet
re-encode to themselves. Where they don't, a window around the seam is encoded anew and grown until
the tokens at both of its edges satisfy the rule with the tokens outside, which then cannot change.
Short halves recur in many pieces, so the lists of those are remembered, as are the re-encoded pairs of tokens.
Decoding concatenates byte strings up the same kind of tree.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quillon.llm.common import bound_batches, with_text

#: Bytes of a leaf of the encoding tree at most, and byte strings of a leaf of the decoding tree.
LEAF_BYTES, LEAF_IDS = 2, 64
#: Bytes of a half whose tokens are remembered; bytes of a window from which merges use a heap.
HALF_BYTES, HEAP_BYTES = 6, 48
#: Distinct pieces, halves and pairs that a worker remembers, each; the memories of the last two are emptied beyond it.
MEMO_PIECES, MEMO_HALVES, MEMO_PAIRS = 500_000, 300_000, 300_000
#: Characters from which the pieces of a text are taken in portions.
PORTION = 200_000
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def parse_ranks(raw: bytes) -> dict[bytes, int]:
    """The ranks of a tiktoken vocabulary file."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in raw.splitlines() if line)}


class TreeBpe:
    """Encoder and decoder over one rank table."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.vocabulary = {rank: token for token, rank in ranks.items()}
        self.pieces = regex.compile(pattern)
        self._pairs: dict[tuple[int, int], list[int] | None] = {}
        self._halves: dict[bytes, list[int]] = {}

    def merge(self, data: bytes) -> list[int]:
        """Merge adjacent parts by lowest rank, leftmost first, until none can be merged: the encoding of a window."""
        if len(data) > HEAP_BYTES:
            return self._merge_long(data)
        ranks = self.ranks
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                rank = ranks.get(parts[i] + parts[i + 1])
                if rank is not None and (best is None or rank < best):
                    best, at = rank, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[p] for p in parts]

    def _merge_long(self, data: bytes) -> list[int]:
        """The same merges over a linked list with a heap, for windows that had to grow."""
        ranks, n = self.ranks, len(data)
        end, before, after = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(data[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            if end[i] < 0 or after[i] >= n or end[after[i]] != stop:
                continue
            j = after[i]
            end[i], end[j], after[i] = stop, -1, after[j]
            if after[i] < n:
                before[after[i]] = i
                if (r := ranks.get(data[i : end[after[i]]])) is not None:
                    heapq.heappush(heap, (r, i, end[after[i]]))
            if before[i] >= 0 and (r := ranks.get(data[before[i] : stop])) is not None:
                heapq.heappush(heap, (r, before[i], stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[data[i : end[i]]])
            i = after[i]
        return out

    def seam(self, left: int, right: int) -> list[int] | None:
        """The encoding of two adjacent tokens' bytes; None if it is the two themselves."""
        pair = left, right
        try:
            return self._pairs[pair]
        except KeyError:
            if len(self._pairs) >= MEMO_PAIRS:
                self._pairs.clear()
            made = self.merge(self.vocabulary[left] + self.vocabulary[right])
            self._pairs[pair] = made = None if made == [left, right] else made
            return made

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The monoid's operation: the encoding of the joined bytes of two encodings."""
        if not left or not right:
            return left or right
        window = self.seam(left[-1], right[0])
        if window is None:
            return left + right
        width = 1
        while True:
            kept, rest = left[:-width], right[width:]
            if (not kept or self.seam(kept[-1], window[0]) is None) and (not rest or self.seam(window[-1], rest[0]) is None):
                return kept + window + rest
            width *= 2
            window = self.merge(b"".join(map(self.vocabulary.__getitem__, left[-width:] + right[:width])))

    def reduce(self, data: bytes) -> list[int]:
        """Encode by halves, down to leaves of a byte or two."""
        n = len(data)
        if n <= LEAF_BYTES:
            whole = self.ranks.get(data)
            return [self.ranks[data[i : i + 1]] for i in range(n)] if whole is None else [whole]
        if n > HALF_BYTES:
            return self.join(self.reduce(data[: n // 2]), self.reduce(data[n // 2 :]))
        known = self._halves.get(data)
        if known is None:
            if len(self._halves) >= MEMO_HALVES:
                self._halves.clear()
            known = self._halves[data] = self.join(self.reduce(data[: n // 2]), self.reduce(data[n // 2 :]))
        return known

    def encode_piece(self, piece: str) -> list[int]:
        """The ids of one pattern match; a match that is itself a token stays whole."""
        data = piece.encode("utf-8", "surrogatepass")
        whole = self.ranks.get(data)
        return [whole] if whole is not None else self.reduce(data)

    def encode(self, text: str) -> list[int]:
        return [i for piece in self.pieces.findall(text) for i in self.encode_piece(piece)]

    def decode(self, ids: list[int]) -> bytes:
        """The bytes of tokens, concatenated up the tree."""
        return concatenated(list(map(self.vocabulary.__getitem__, ids)))


def concatenated(parts: list[bytes]) -> bytes:
    """Byte strings joined by halves, down to leaves of ``LEAF_IDS``."""
    if len(parts) <= LEAF_IDS:
        return b"".join(parts)
    half = len(parts) // 2
    return concatenated(parts[:half]) + concatenated(parts[half:])


class _Written(dict):
    """By piece, its decimal ids joined by commas and the bytes that they decode to.

    Holds up to ``MEMO_PIECES`` pieces in two halves: a full half is kept until the next is full, and what is met again moves over.
    """

    def __init__(self, bpe: TreeBpe):
        self.bpe, self.before = bpe, {}

    def __missing__(self, piece: str) -> tuple[str, bytes]:
        if len(self) >= MEMO_PIECES // 2:
            self.before = dict(self)
            self.clear()
        out = self.before.pop(piece, None)
        if out is None:
            ids = self.bpe.encode_piece(piece)
            out = ",".join(map(str, ids)), self.bpe.decode(ids)
        self[piece] = out
        return out


def digests(bpe: TreeBpe, text: str | None, written: dict) -> tuple[int, str, str]:
    """Number of ids, SHA-256 of their written form and of the bytes they decode to; texts of any length in bounded portions."""
    count, ids_hash, bytes_hash = 0, hashlib.sha256(), hashlib.sha256()
    text = text or ""
    for pieces in [bpe.pieces.findall(text)] if len(text) <= PORTION else _portions(bpe, text):
        if not pieces:
            break
        found = list(map(written.__getitem__, pieces))
        joined = ",".join([ids for ids, _ in found])
        ids_hash.update((f",{joined}" if count else joined).encode())
        count += joined.count(",") + 1
        bytes_hash.update(concatenated([data for _, data in found]))
    return count, ids_hash.hexdigest(), bytes_hash.hexdigest()


def _portions(bpe: TreeBpe, text: str) -> Iterator[list[str]]:
    pieces: list[str] = []
    for match in bpe.pieces.finditer(text):
        pieces.append(match[0])
        if len(pieces) >= PORTION // 4:
            yield pieces
            pieces = []
    if pieces:
        yield pieces


_loaded: dict[tuple[int, str], TreeBpe] = {}


def _worker(raw: bytes, pattern: str) -> TreeBpe:
    """One encoder per worker and vocabulary."""
    key = (hash(raw), pattern)
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = TreeBpe(parse_ranks(raw), pattern)
    return _loaded[key]


def encode_documents(docs: DataFrame, vocabulary: str, pattern: str, keep: bool = False) -> DataFrame:
    """Encode and decode every whole text; nulls count as empty texts.

    ``vocabulary`` is the path, on the driver, of a tiktoken rank file; its few hundred kilobytes are
    broadcast. Returns ``SCHEMA`` per row, after the columns of ``docs`` if ``keep`` (columns of the same names are replaced). Empty texts get
    no ids and the digests of empty strings; repeated rows are encoded each; an empty table gives none.
    """
    bound_batches(docs.sparkSession)
    with open(vocabulary, "rb") as file:
        raw = docs.sparkSession.sparkContext.broadcast(file.read())
    source = docs if keep else with_text(docs)
    added = ["n_tokens", "ids_sha256", "decoded_sha256"]
    source = source.drop(*added)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _worker(raw.value, pattern)
        written = _Written(bpe)
        for batch in batches:
            at = batch.schema.get_field_index("text")
            rows = [digests(bpe, text.as_py(), written) for text in batch.column(at)]
            out = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int64(), pa.string(), pa.string()))]
            if keep:
                yield pa.RecordBatch.from_arrays([*batch.columns, *out], [*batch.schema.names, *added])
            else:
                yield pa.RecordBatch.from_arrays([batch.column(0), *out], ["doc_id", *added])

    if not keep:
        return source.mapInArrow(run, SCHEMA)
    kinds = (T.LongType(), T.StringType(), T.StringType())
    return source.mapInArrow(run, T.StructType([*source.schema, *[T.StructField(n, k) for n, k in zip(added, kinds, strict=True)]]))
