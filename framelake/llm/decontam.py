"""Benchmark decontamination by one Aho-Corasick automaton over the normalised benchmark items.

A-Z is lower-cased and everything but digits, letters a-z and bytes from 0x80 on separates words. Each run of
`window` words of an item (a shorter item: all its words) is a pattern. Words of the patterns are given a code point
each, so a pattern is a string of `window` letters, and a text, with one letter for a word, is scanned once; hits are
mapped back to code points of the original.

The patterns are made in Spark: a table of each pattern's words and the sorted ids of its items, of a pattern in more than
about `ITEMS` items as several rows. Words and ids are counted; up to `shard_words` of them it is one automaton, broadcast and built once in each worker. Beyond, patterns are dealt by
their hash into shards of that size, collected and broadcast one at a time, and each shard scans the documents in a job of
its own, whose hits alone are stored; then the hits of a row are put together. So neither the driver nor a worker holds
more than one shard, however large the benchmark is.

Items with a null id or no words are no items. Null texts have no words; repeated documents give repeated results;
repeated items count once by id; an empty benchmark contaminates nothing; an empty table gives an empty result. Only the
id and text columns are read, so others may have any name.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import math
import pickle
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Words and item ids of the patterns in one automaton, which takes about 60 bytes a word in a worker.
SHARD_WORDS = 1_000_000
#: Item ids of a pattern that stay in one row.
ITEMS = 1_000
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
#: Of bytes: A-Z to a-z, other separators to spaces.
FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
#: Code points for words: all but surrogates and the one that stands for words of no pattern.
LETTERS = [*range(1, 0xD800), *range(0xE000, 0x110000)]
OTHER = "\0"


def words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(FOLD).split()


def patterns(benchmark: DataFrame, item_col: str, text_col: str, window: int) -> DataFrame:
    """The distinct patterns: words (joined by spaces, as bytes), their number n, and the sorted ids of their items. Items are dealt
    into parts of about ITEMS, and a pattern has a row for each part that it occurs in.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                w = words(text)
                runs = [b" ".join(w[i : i + window]) for i in range(max(1, len(w) - window + 1) if w else 0)]
                yield pa.RecordBatch.from_arrays([pa.array(runs, pa.binary()), pa.array([min(window, len(w))] * len(runs), pa.int32()), pa.array([item] * len(runs), pa.string())], ["words", "n", "item"])

    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("text")).where("item is not null and text is not null")
    parts = max(1, -(-items.count() // ITEMS))
    rows = items.mapInArrow(run, "words binary, n int, item string").withColumn("part", F.pmod(F.xxhash64("item"), F.lit(parts)))
    return rows.groupBy("words", "part").agg(F.max("n").alias("n"), F.sort_array(F.collect_set("item")).alias("items"))


class Scanner:
    """An automaton over patterns (words, n, items)."""

    def __init__(self, found: list[tuple[bytes, int, list[str]]]):
        self.letters: dict[bytes, str] = {}
        self.automaton = ahocorasick.Automaton()
        for text, n, items in found:
            for w in text.split():
                if w not in self.letters:
                    self.letters[w] = chr(LETTERS[len(self.letters)])
            key = "".join(map(self.letters.__getitem__, text.split()))
            self.automaton.add_word(key, (n, self.automaton.get(key, (n, []))[1] + items))
        if len(self.automaton):
            self.automaton.make_automaton()

    def scan(self, text: str) -> tuple[int, np.ndarray | None, set[str]]:
        """The number of words, the marks of hit words (None without any) and the ids of the items that occur."""
        w = words(text)
        if not len(self.automaton) or not w:
            return len(w), None, set()
        get = self.letters.get
        found = list(self.automaton.iter("".join([get(x, OTHER) for x in w])))
        if not found:
            return len(w), None, set()
        last = np.array([end for end, _ in found])
        steps = np.zeros(len(w) + 1, np.int64)
        np.add.at(steps, last - np.array([n for _, (n, _) in found]) + 1, 1)
        np.add.at(steps, last + 1, -1)
        return len(w), np.cumsum(steps[:-1]) > 0, set(itertools.chain.from_iterable(items for _, (_, items) in found))


_built: dict[str, Scanner] = {}


def scanner(key: str, shared: Broadcast) -> Scanner:
    """The scanner of a broadcast shard, built once in a worker, which holds one at a time."""
    if key not in _built:
        _built.clear()
        _built[key] = Scanner(shared.value)
    return _built[key]


def runs_of(marks: np.ndarray) -> list[list[int]]:
    """The runs of marked words as [first, last + 1]."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], marks.astype(np.int8), [0]))))
    return edges.reshape(-1, 2).tolist()


def spans(text: str, runs: list[list[int]]) -> list[list[int]]:
    """Runs of words as code points of the original text, end exclusive."""
    where = [m.span() for m in WORD.finditer(text)] if runs else []
    return [[where[a][0], where[b - 1][1]] for a, b in runs]


HITS = "n_words long, n_hit long, item_ids array<string>, spans array<array<long>>"


def scanned(docs: DataFrame, key: str, shared: Broadcast, placed: bool) -> DataFrame:
    """Rows (id, text) scanned with one shard: id and HITS; with placed, spans are [first word, last word + 1, start, end]."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = scanner(key, shared)
        for batch in common.slices(batches):
            n, hits, items, where = [], [], [], []
            for text in batch.column(1).to_pylist():
                k, marks, ids = own.scan(text or "")
                runs = [] if marks is None else runs_of(marks)
                at = spans(text or "", runs)
                n.append(k)
                hits.append(0 if marks is None else int(marks.sum()))
                items.append(sorted(ids))
                where.append([a + b for a, b in zip(runs, at)] if placed else at)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(hits, pa.int64()), pa.array(items, pa.list_(pa.string())), pa.array(where, pa.list_(pa.list_(pa.int64())))], ["id", "n_words", "n_hit", "item_ids", "spans"])

    return docs.select("id", "text").mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, {HITS}")


def united(places: list[list[int]]) -> list[list[int]]:
    """The union of placed spans, those that touch in words joined."""
    out: list[list[int]] = []
    for a, b, start, end in sorted(places):
        if out and a <= out[-1][1]:
            if b > out[-1][1]:
                out[-1][1], out[-1][3] = b, end
        else:
            out.append([a, b, start, end])
    return out


def put_together(rows: DataFrame) -> DataFrame:
    """Rows (id, n_words, item_ids, spans: placed ones of all shards) as id and HITS."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            joined = [united(p) for p in batch.column(3).to_pylist()]
            hits = [sum(b - a for a, b, _, _ in p) for p in joined]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(hits, pa.int64()), batch.column(2), pa.array([[[x, y] for _, _, x, y in p] for p in joined], pa.list_(pa.list_(pa.int64())))], ["id", "n_words", "n_hit", "item_ids", "spans"])

    return rows.select("id", "n_words", "item_ids", "spans").mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, {HITS}")


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 13, shard_words: int = SHARD_WORDS) -> DataFrame:
    """Per row: the id, n_words, n_hit, the sorted ids of the items found (as strings), and the hit spans [start, end) in code points."""
    known = common.stored(patterns(benchmark, item_col, item_text_col, window))
    shards = max(1, math.ceil((known.agg(F.sum(F.col("n") + F.size("items")).alias("n")).first()["n"] or 0) / shard_words))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def broadcast(shard: int) -> tuple[str, Broadcast]:
        """The patterns of a shard, about shard_words words and ids, and a name for them."""
        group = sorted((bytes(r[0]), r[1], r[2]) for r in known.where(F.pmod(F.xxhash64("words", "part"), F.lit(shards)) == shard).select("words", "n", "items").collect())
        return hashlib.sha1(pickle.dumps(group)).hexdigest(), docs.sparkSession.sparkContext.broadcast(group)

    if shards == 1:
        found = scanned(rows, *broadcast(0), False)
        common.dropped(known)
        return found.withColumnRenamed("id", id_col)
    # rows need a number of their own to put the hits of all shards together, as ids may repeat or be null
    numbered = common.stored(rows.withColumn("at", F.monotonically_increasing_id()))
    parts = []
    for shard in range(shards):
        key, shared = broadcast(shard)
        hits = scanned(numbered.select(F.col("at").alias("id"), "text"), key, shared, True)
        parts.append(common.stored(hits if not parts else hits.where("n_hit > 0")))
        shared.destroy()
    # at most one row a shard for each document
    every = functools.reduce(DataFrame.union, parts).groupBy(F.col("id").alias("at")).agg(F.max("n_words").alias("n_words"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids"), F.flatten(F.collect_list("spans")).alias("spans"))
    found = common.stored(put_together(numbered.select("at", "id").join(every, "at")))
    common.dropped(known, numbered, *parts)
    return found.withColumnRenamed("id", id_col)


def contaminated(scanned: DataFrame) -> DataFrame:
    """The results of contamination() with the verdict: at least a word in twenty is hit."""
    return scanned.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))
