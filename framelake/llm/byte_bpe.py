"""Byte-level BPE encoding and decoding by a tree reduction.

Encodings form a monoid under `Merges.join`: a long piece is halved into leaves, leaves are merged by themselves, and
neighbours are joined by encoding a growing window at their boundary again until what lies outside provably stays.
Decoding concatenates the tokens' bytes in leaves and these up the tree. Pieces of the pattern never merge with each other, so their
join is plain concatenation.

Null texts are empty: no ids, no bytes. Repeated rows give repeated results, an empty table an empty result; only the
id and the text are read.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe_core, common

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


class TreeCodec:
    def __init__(self, path: str):
        self.merges = bpe_core.load_ranks(path)
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.token = {i: b for b, i in self.merges.ids.items()}
        self.memo: dict[str, bytes] = {}

    def encode_piece(self, piece: str) -> bytes:
        """The ids of one match of the pattern, as little-endian unsigned 32-bit integers."""
        data = piece.encode("utf-8", "surrogatepass")
        packed = self.merges.packed
        if data in packed:  # the library looks a whole piece up first
            return packed[data]
        return b"".join(map(packed.__getitem__, self.merges.tree(data)))

    def encode(self, text: str) -> bytes:
        """The ids of a text, packed as of encode_piece."""
        memo = self.memo
        pieces = self.pattern.findall(text)
        out = list(map(memo.get, pieces))
        if None in out:
            if len(memo) > bpe_core.MEMO_ENTRIES:
                memo.clear()
            for i, ids in enumerate(out):
                if ids is None:
                    piece = pieces[i]
                    ids = memo.get(piece)
                    if ids is None:
                        ids = self.encode_piece(piece)
                        if len(piece) < 64:
                            memo[piece] = ids
                    out[i] = ids
        return b"".join(out)

    def decode(self, packed: bytes) -> bytes:
        """The bytes of packed ids: tokens are concatenated in leaves, and leaves with their neighbours up the tree."""
        tokens, leaf = list(map(self.token.__getitem__, np.frombuffer(packed, "<u4").tolist())), bpe_core.LEAF_TOKENS
        level = [b"".join(tokens[i : i + leaf]) for i in range(0, len(tokens), leaf)]
        while len(level) > 1:
            level = [b"".join(level[i : i + 2]) for i in range(0, len(level), 2)]
        return level[0] if level else b""


@functools.lru_cache(maxsize=2)
def codec(path: str) -> TreeCodec:
    return TreeCodec(path)


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = "") -> DataFrame:
    """Per row: the id, the packed ids (binary, little-endian unsigned 32-bit) and their number."""
    path = vocabulary or public_tokenizers.path(VOCABULARY)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in common.slices(batches):
            packed = [own.encode(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary()), pa.array([len(p) // 4 for p in packed], pa.int64())], [id_col, "ids", "n_tokens"])

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"`{id_col}` {kind}, ids binary, n_tokens long")


def decode(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", vocabulary: str = "") -> DataFrame:
    """Per row: the id and the bytes that its packed ids stand for; null ids give no bytes."""
    path = vocabulary or public_tokenizers.path(VOCABULARY)
    kind = encoded.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in common.slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([own.decode(p or b"") for p in batch.column(1).to_pylist()], pa.binary())], [id_col, "decoded"])

    return encoded.select(F.col(id_col), F.col(ids_col)).mapInArrow(run, f"`{id_col}` {kind}, decoded binary")


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = "") -> DataFrame:
    """Per row: the id, n_tokens, and the sha256 of the packed ids and of the bytes decoded from them."""
    path = vocabulary or public_tokenizers.path(VOCABULARY)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in common.slices(batches):
            packed = [own.encode(t or "") for t in batch.column(1).to_pylist()]
            digests = ([hashlib.sha256(p).hexdigest() for p in packed], [hashlib.sha256(own.decode(p)).hexdigest() for p in packed])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(p) // 4 for p in packed], pa.int64()), *map(pa.array, digests)], [id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
