"""Token counts by prefix dynamic programming.

`PrefixCounter` holds the exact token count at each prefix of a text: at the ends of its pieces as running sums, and at
every byte inside a piece as the table that the dynamic program made. Truncation and budget questions read those
counts; nothing is encoded or counted again.

Null texts count as empty (0 bytes, 0 tokens). Repeated rows give repeated results, an empty table an empty result,
and other columns of the input are left alone: only the id and the text are read.
"""

from __future__ import annotations

import functools
import itertools
from array import array
from collections.abc import Collection, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe_core, common

VOCABULARY = "byte_bpe_50k.json"


class PrefixCounter:
    def __init__(self, path: str):
        self.merges, self.added = bpe_core.load_json(path)
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.around = regex.compile("(" + "|".join(map(regex.escape, self.added)) + ")") if self.added else None
        self.memo: dict[str, int] = {}
        self.prefixes: dict[str, bytes | array] = {}

    def pieces(self, text: str) -> list[str]:
        """The pieces that are merged separately; an added token's string is a piece of its own."""
        if self.around is None or not any(a in text for a in self.added):
            return self.pattern.findall(text)
        out: list[str] = []
        for i, part in enumerate(self.around.split(text)):
            out += [part] if i % 2 else self.pattern.findall(part)
        return out

    def learn(self, pieces: Collection[str]) -> None:
        """Put the counts at every prefix of new pieces into the memo, which is emptied first when it is full."""
        memo, prefixes = self.memo, self.prefixes
        new = {p for p in pieces if p not in memo}
        if new and len(memo) + len(new) > bpe_core.MEMO_ENTRIES:
            memo.clear()
            prefixes.clear()
            new = set(pieces)
        if self.added:
            for a in self.added:
                if a in new:
                    memo[a] = 1
                    new.discard(a)
        pairs = sorted((p.encode("utf-8", "surrogatepass"), p) for p in new)
        for (_, piece), counts in zip(pairs, self.merges.prefix_table(data for data, _ in pairs)):
            memo[piece] = counts[-1]
            prefixes[piece] = bytes(counts) if counts[-1] < 256 else array("I", counts)

    def piece_counts(self, pieces: list[str]) -> list[int]:
        counts = list(map(self.memo.get, pieces))
        if None in counts:
            self.learn(pieces)
            counts = [self.memo[p] for p in pieces]
        return counts

    def boundaries(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ends of the pieces in code points, and the token count at each."""
        pieces = self.pieces(text)
        return np.cumsum([len(p) for p in pieces]), np.cumsum(self.piece_counts(pieces))

    def total(self, text: str) -> int:
        return sum(self.piece_counts(self.pieces(text)))

    def totals(self, texts: list[str]) -> list[int]:
        """The token count of each text; the new pieces of all are counted together."""
        found = list(map(self.pieces, texts))
        self.learn(set(itertools.chain.from_iterable(found)))
        return [sum(self.piece_counts(pieces)) for pieces in found]

    def prefix_tokens(self, text: str) -> np.ndarray:
        """The token count of each prefix of the text by code points, from none to all: the pieces before it, and its part of its own piece."""
        out, before = [0], 0
        for piece in self.pieces(text):
            self.piece_counts([piece])
            if piece in self.added:
                out += [before + 1] * len(piece)  # a cut inside saves nothing
            else:
                at_byte, byte = self.prefixes[piece], 0
                for ch in piece:
                    byte += len(ch.encode("utf-8", "surrogatepass"))
                    out.append(before + at_byte[byte])
            before = out[-1]
        return np.array(out)

    def truncate(self, text: str, budget: int) -> str:
        """The longest run of whole characters from the start whose own tokens, within each piece, fit the budget."""
        ends, counts = self.boundaries(text)
        k = int(np.searchsorted(counts, budget, side="right"))
        if k == len(ends):
            return text
        start, used = (int(ends[k - 1]), int(counts[k - 1])) if k else (0, 0)
        piece = text[start : int(ends[k])]
        if piece in self.added:
            return text[:start]
        at_byte = self.prefixes[piece]
        fit, byte = 0, 0
        for i, ch in enumerate(piece):
            byte += len(ch.encode("utf-8", "surrogatepass"))
            if used + at_byte[byte] <= budget:
                fit = i + 1
        return text[: start + fit]


@functools.lru_cache(maxsize=2)
def counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = 512, vocabulary: str = "", truncate: bool = False) -> DataFrame:
    """Per row: the id, n_bytes, n_tokens and whether n_tokens is over the limit; with truncate, the text cut to the limit too."""
    path = vocabulary or public_tokenizers.path(VOCABULARY)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path)
        for batch in common.slices(batches):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            n = count.totals(texts)
            cols = [batch.column(0), pa.array(n, pa.int64())]
            names = [id_col, "n_tokens"]
            if truncate:
                cols.append(pa.array([count.truncate(t, limit) if k > limit else t for t, k in zip(texts, n)], pa.string()))
                names.append("truncated")
            cols.append(pa.array([len(t.encode()) for t in texts], pa.int64()))
            names.append("n_bytes")
            yield pa.RecordBatch.from_arrays(cols, names)

    extra = ", truncated string" if truncate else ""
    counted = docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"`{id_col}` {kind}, n_tokens long{extra}, n_bytes long")
    return counted.select(id_col, "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), *(["truncated"] if truncate else []))
