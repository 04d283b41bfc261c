"""Encoding of whole texts with a public byte-level BPE vocabulary.

A text is split by the vocabulary's pattern; each piece starts as single bytes and
the pair of least rank, leftmost first, is merged until none is left.  A segment
tree over byte positions stores the leftmost least rank, so a merge costs a
logarithmic number of updates however long a piece is.
"""

from __future__ import annotations

import base64
import os
from array import array

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Splits a text before the merges; a fixed value of the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Largest vocabulary file that is sent to the executors.
MAX_VOCABULARY_BYTES = 1 << 26

#: Pieces whose ids a worker remembers, and the longest of them in characters.
CACHE_PIECES, CACHE_CHARS = 1 << 17, 64

NONE = 1 << 40


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken", directory: str | None = None) -> str:
    """The file ``name`` in ``directory``, else in $WEFTLINE_TOKENIZERS, else in the installed public_tokenizers."""
    directory = directory or os.environ.get("WEFTLINE_TOKENIZERS")
    if directory is None:
        import public_tokenizers

        return public_tokenizers.path(name)
    return os.path.join(directory, name)


def parse_ranks(content: bytes) -> dict[bytes, int]:
    """Token bytes and their rank, from lines of base64 and number."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in content.splitlines() if line.strip())}


def merge_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece.

    Leaf i of the tree is the rank of the pair that begins at byte i, or NONE.  A
    merge at i joins i with its right neighbour, and only the pairs of i and of its
    left neighbour change.  Equal ranks go to the leftmost.
    """
    if piece in ranks:
        return [ranks[piece]]
    n = len(piece)
    if n < 2:
        return [ranks[piece]] if n else []
    size = 1 << (n - 1).bit_length()
    tree = [NONE] * (2 * size)
    for i in range(n - 1):
        tree[size + i] = ranks.get(piece[i : i + 2], NONE)
    for k in range(size - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a <= b else b
    after, ends, before = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))

    def put(i: int, rank: int) -> None:
        k = size + i
        tree[k] = rank
        k >>= 1
        while k:
            a, b = tree[2 * k], tree[2 * k + 1]
            low = a if a <= b else b
            if tree[k] == low:
                return
            tree[k] = low
            k >>= 1

    while (least := tree[1]) != NONE:
        k = 1
        while k < size:
            k *= 2
            if tree[k] != least:
                k += 1
        i = k - size
        j = after[i]
        after[i], ends[i] = after[j], ends[j]
        if after[j] < n:
            before[after[j]] = i
        put(j, NONE)
        put(i, ranks.get(piece[i : ends[after[i]]], NONE) if after[i] < n else NONE)
        if before[i] >= 0:
            put(before[i], ranks.get(piece[before[i] : ends[i]], NONE))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : ends[i]]])
        i = after[i]
    return out


class Encoder:
    """Encodes texts in a worker, remembering the ids of short pieces."""

    def __init__(self, content: bytes, pattern: str = PATTERN) -> None:
        self.ranks = parse_ranks(content)
        self.split = regex.compile(pattern).findall
        self.known: dict[str, list[int]] = {}

    def piece(self, piece: str) -> list[int]:
        ids = merge_piece(piece.encode("utf-8", "surrogatepass"), self.ranks)
        if len(piece) <= CACHE_CHARS:
            if len(self.known) >= CACHE_PIECES:
                self.known.clear()
            self.known[piece] = ids
        return ids

    def extend(self, text: str, out: array) -> None:
        known, piece = self.known, self.piece
        for p in self.split(text):
            ids = known.get(p)
            out.extend(ids if ids is not None else piece(p))

    def count(self, text: str) -> int:
        known, piece, n = self.known, self.piece, 0
        for p in self.split(text):
            ids = known.get(p)
            n += len(ids if ids is not None else piece(p))
        return n


_encoders: dict[int, Encoder] = {}


def _encoder(shared) -> Encoder:
    key = hash(shared.value)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(shared.value)
    return _encoders[key]


def _shared(spark: SparkSession, path: str | None):
    path = path or vocabulary_path()
    if os.path.getsize(path) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{path} is larger than {MAX_VOCABULARY_BYTES} bytes")
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def encode(rows: DataFrame, text: str = "text", ids: str = "ids", path: str | None = None) -> DataFrame:
    """``rows`` with the token ids of ``text`` as array<int>, without special tokens.

    Empty and null texts have an empty list.  Strings of special tokens in a text are
    ordinary text.  Texts of any length are encoded whole; rows and other columns stay,
    a column named like the result is replaced.
    """
    shared = _shared(rows.sparkSession, path)

    def run(texts: pa.Array) -> pa.Array:
        encoder, out, ends = _encoder(shared), array("i"), [0]
        for t in texts:
            if t.is_valid:
                encoder.extend(t.as_py(), out)
            ends.append(len(out))
        return pa.ListArray.from_arrays(pa.array(np.array(ends, np.int32)), pa.array(np.frombuffer(out, np.int32) if len(out) else np.zeros(0, np.int32)))

    return rows.drop(ids).withColumn(ids, F.coalesce(F.arrow_udf(run, "array<int>")(F.col(text)), F.array().cast("array<int>")))


def token_counts(rows: DataFrame, text: str = "text", tokens: str = "n_tokens", path: str | None = None) -> DataFrame:
    """``rows`` with the number of tokens of ``text``; 0 for empty and null texts."""
    shared = _shared(rows.sparkSession, path)

    def run(texts: pa.Array) -> pa.Array:
        encoder = _encoder(shared)
        return pa.array([encoder.count(t.as_py()) if t.is_valid else 0 for t in texts], pa.int32())

    return rows.drop(tokens).withColumn(tokens, F.arrow_udf(run, "int")(F.col(text)))
