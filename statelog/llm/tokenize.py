"""Byte-level BPE encoding of a corpus with a public vocabulary of ranks.

A piece of text is merged with a segment tree over the ranks of its adjacent pairs: the root holds the leftmost pair of lowest
rank, and a merge updates the leaves of the two pairs it changes, in logarithmic time, until no pair has a rank. Very long
pieces therefore cost n log n. Pieces recur, so each worker keeps the ids of pieces it has met, up to CACHE of them.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Pieces a worker remembers, and bytes of a piece from which it isn't remembered.
CACHE, CACHED_BYTES = 400_000, 64
_NONE = 1 << 62
_POS = 32


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a ``.tiktoken`` file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merge_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a piece: merges of the leftmost pair of lowest rank until no adjacent pair has one.

    A single byte without rank can't be encoded and raises KeyError; an empty piece has no ids.
    """
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    if n < 2:
        return [ranks[piece]] if n else []
    get = ranks.get
    size = 1 << (n - 2).bit_length() if n > 2 else 1
    tree = [_NONE] * (2 * size)
    end = list(range(1, n + 1))  # end of the token that starts at a position
    for i in range(n - 1):
        r = get(piece[i : i + 2])
        if r is not None:
            tree[size + i] = r << _POS | i
    for k in range(size - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a < b else b
    before = list(range(-1, n - 1))  # start of the token before

    def put(i: int, value: int) -> None:
        k = size + i
        tree[k] = value
        k >>= 1
        while k:
            a, b = tree[2 * k], tree[2 * k + 1]
            least = a if a < b else b
            if tree[k] == least:
                return
            tree[k] = least
            k >>= 1

    while tree[1] != _NONE:
        i = tree[1] & ((1 << _POS) - 1)
        gone = end[i]
        stop = end[gone]
        end[i] = stop
        if stop < n:
            before[stop] = i
            r = get(piece[i : end[stop]])
            put(i, _NONE if r is None else r << _POS | i)
        else:
            put(i, _NONE)
        if gone < n - 1:
            put(gone, _NONE)
        p = before[i]
        if p >= 0:
            r = get(piece[p:stop])
            put(p, _NONE if r is None else r << _POS | p)
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : end[i]]])
        i = end[i]
    return ids


class Encoder:
    """Encodes texts: pieces by ``pattern``, each merged by :func:`merge_piece`."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks, self.pieces, self.known = ranks, regex.compile(pattern).findall, {}

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        known, out = self.known, []
        for piece in self.pieces(text):
            ids = known.get(piece)
            if ids is None:
                raw = piece.encode("utf-8", "replace")
                ids = merge_piece(raw, self.ranks)
                if len(raw) <= CACHED_BYTES:
                    if len(known) >= CACHE:
                        known.clear()
                    known[piece] = ids
            out += ids
        return out


def encode_texts(docs: DataFrame, ranks_path: str, pattern: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``(id, ids)``: token ids of each text, a row for each row of ``docs``; null and empty texts have the empty list.

    ``ranks_path`` names a ``.tiktoken`` vocabulary, which the driver reads and broadcasts (a fixed size of some 50,000 tokens).
    Strings of special tokens are ordinary text. No rows give no rows.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(read_ranks(ranks_path))
    kind = docs.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value, pattern)
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                ids = pa.array([encoder.encode(t) for t in part.column(1).to_pylist()], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), ids], [id_column, "ids"])

    return docs.select(id_column, text_column).mapInArrow(run, f"`{id_column}` {kind}, ids array<int>")
