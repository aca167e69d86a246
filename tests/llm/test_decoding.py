"""Encoding and decoding by trees, counted in what the queries call."""

import hashlib
from collections import Counter

import public_tokenizers

from quillon.llm import bpe


def counted(monkeypatch, owner, name):
    calls, old = Counter(), getattr(owner, name)

    def new(*args):
        calls[name] += 1
        return old(*args)

    monkeypatch.setattr(owner, name, new)
    return calls


def test_digests_decode_up_the_tree(monkeypatch):
    mine = bpe.TreeBpe({bytes([i]): i for i in range(256)}, r"\S+|\s+")
    calls = counted(monkeypatch, bpe, "concatenated")
    text = "some words " * 1_000
    got = bpe.digests(mine, text, bpe._Written(mine))
    assert got[0] == len(text) and got[2] == hashlib.sha256(text.encode()).hexdigest()
    assert calls["concatenated"] > 2 * 4_000 // bpe.LEAF_IDS


def test_pieces_are_encoded_by_joins(spark, monkeypatch):
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as file:
        mine = bpe.TreeBpe(bpe.parse_ranks(file.read()), public_tokenizers.PATTERN)
    texts = [r[0] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    pieces = {p for t in texts for p in mine.pieces.findall(t or "")}
    halved = [p for p in pieces if p.encode() not in mine.ranks and len(p.encode()) > bpe.LEAF_BYTES]
    assert len(halved) > 0.5 * len(pieces)
    for p in halved:
        mine._halves.clear()
        calls = counted(monkeypatch, bpe.TreeBpe, "join")
        direct = mine._merge_long(p.encode())
        assert mine.encode_piece(p) == direct
        assert calls["join"] >= len(p.encode()) / bpe.LEAF_BYTES / 2 - 1 and calls["join"] >= 1
        monkeypatch.undo()


def test_windows_grow():
    """Ranks under which a far byte changes all tokens before it: the window has to grow to the start."""
    ranks = {bytes([i]): i for i in range(256)} | {b"ab": 300, b"ba": 299, b"abab": 302, b"baba": 301}
    mine = bpe.TreeBpe(ranks, r"\S+")
    for n in range(1, 40):
        for tail in ("", "a", "b", "ba", "c"):
            data = ("ab" * n + tail).encode()
            assert mine.reduce(data) == mine._merge_long(data)
