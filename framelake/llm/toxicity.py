"""Toxicity by a weighted lexicon, matched by Aho-Corasick after folding, normalised by length, with exceptions.

The lexicon isn't written by hand: terms (whole words, and word starts of four to nine letters) are counted over a
bounded sample of labelled rows, and those that toxic rows have far more often become entries, weighted by their log
odds. Words and two-word phrases that contain an entry but occur in clean rows become exceptions, which take the entry
out where they match. A text's score is a logistic function of its summed weights and of their share of the words.

Learning reads no more than `max_rows` labelled rows (chosen by a hash of the id) however large the labels are; of
the entries the `max_terms` that tell most, and as many exceptions, are kept. All texts are scored, whole. Null texts
are empty and score as texts without any entry. Without labels the score is the prior, 0. Repeated rows give repeated
results; of an id with several labels or texts the least is learned from; only the named columns are read, so others may
have any name. An empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

MAX_ROWS = 12_000
MAX_TERMS = 4_000
#: An entry occurs in so many toxic rows, in so large a share of them, so many times more often than in clean ones, and against such odds.
MIN_ROWS, MIN_SHARE, LIFT, SURPRISE = 5, 0.01, 20, 4.0
#: Look-alikes of Latin letters and digits used for letters: fixed values.
HOMOGLYPHS = str.maketrans(
    {"а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ѕ": "s", "ј": "j", "ԁ": "d", "һ": "h", "ո": "n", "ν": "v", "ο": "o", "α": "a", "ε": "e", "ι": "i", "κ": "k", "τ": "t", "ρ": "p", "υ": "u"}
)
DIGITS = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t"})
#: Runs of such digits next to a letter; others are numbers.
IN_WORD = re.compile(r"(?<=[^\W\d_])[013457]+|[013457]+(?=[^\W\d_])")
BETWEEN = re.compile(r"(?<=[^\W\d_])[@$](?=[^\W\d_])")
WORD = re.compile(r"[^\W_]+")
STARTS = range(4, 10)


def fold(text: str) -> str:
    """Lower case, full-width letters and look-alikes to Latin letters, digits next to letters to the letters they stand for."""
    text = text.lower()
    if "@" in text or "$" in text:
        text = BETWEEN.sub(lambda m: "a" if m[0] == "@" else "s", text)
    if not text.isascii() and any(0xFF01 <= ord(c) <= 0xFF5E for c in set(text)):
        text = "".join(chr(ord(c) - 0xFEE0) if 0xFF01 <= ord(c) <= 0xFF5E else c for c in text).lower()
    if not text.isascii():
        text = text.translate(HOMOGLYPHS)
    return IN_WORD.sub(lambda m: m[0].translate(DIGITS), text)


def terms(text: str) -> set[str]:
    """Whole words as =word, starts of words as they are."""
    words = set(WORD.findall(fold(text)))
    return {"=" + w for w in words if len(w) > 2} | {w[:k] for w in words for k in STARTS if len(w) > k}


@dataclass
class Lexicon:
    weights: dict[str, float] = field(default_factory=dict)
    exceptions: list[str] = field(default_factory=list)
    bias: tuple[float, float, float] = (-20.0, 0.0, 0.0)


class Matcher:
    def __init__(self, lexicon: Lexicon):
        self.lexicon = lexicon
        self.found = ahocorasick.Automaton()
        for term, weight in lexicon.weights.items():
            self.found.add_word(term.lstrip("="), (len(term.lstrip("=")), weight, term[0] == "="))
        if len(self.found):
            # a whole word and a word start can be the same letters: the start then covers both
            for term, weight in lexicon.weights.items():
                if term[0] != "=":
                    self.found.add_word(term, (len(term), weight, False))
            self.found.make_automaton()
        self.spared = ahocorasick.Automaton()
        for phrase in lexicon.exceptions:
            self.spared.add_word(phrase, len(phrase))
        if len(self.spared):
            self.spared.make_automaton()

    def matches(self, folded: str) -> dict[int, float]:
        """The greatest weight of the entries that match at the start of a word, by its place."""
        best: dict[int, float] = {}
        if not len(self.found):
            return best
        n = len(folded)
        for end, (length, weight, whole) in self.found.iter(folded):
            start = end - length + 1
            if (not start or not folded[start - 1].isalnum()) and not (whole and end + 1 < n and folded[end + 1].isalnum()) and weight > best.get(start, 0):
                best[start] = weight
        if best and len(self.spared):
            starts = sorted(best)
            for end, length in self.spared.iter(folded):
                start = end - length + 1
                if (not start or not folded[start - 1].isalnum()) and not (end + 1 < n and folded[end + 1].isalnum()):
                    for at in starts[bisect.bisect_left(starts, start) : bisect.bisect_right(starts, end)]:
                        best.pop(at, None)
        return best

    def features(self, text: str) -> tuple[float, float]:
        """The log of the summed weights, and of their sum for a hundred words."""
        best = self.matches(fold(text))
        if not best:
            return 0.0, 0.0
        total = sum(best.values())
        return math.log1p(total), math.log1p(100 * total / max(1, len(text.split())))

    def score(self, text: str) -> float:
        a, b = self.features(text)
        bias, total, share = self.lexicon.bias
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, bias + total * a + share * b))))


def usable_labels(labels: DataFrame, label_col: str, id_col: str) -> DataFrame:
    """The id and label of the rows that may be learned from; of an id with several labels the least."""
    usable = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~common.held_out(F.col(id_col))).select(F.col(id_col), F.col(label_col).cast("int").alias("label"))
    return usable.groupBy(id_col).agg(F.min("label").alias("label"))


def sample(docs: DataFrame, labels: DataFrame, label_col: str, id_col: str, text_col: str, max_rows: int) -> DataFrame:
    """Labelled rows that may be learned from, with their texts: label, text. At most about max_rows, half of them of each label where there are as many."""
    usable = usable_labels(labels, label_col, id_col)
    counts = {r["label"]: r["count"] for r in usable.groupBy("label").count().collect()}
    share = F.lit(0.0)
    for label, n in counts.items():
        share = F.when(F.col("label") == label, F.lit(min(1.0, max_rows / 2 / n))).otherwise(share)
    chosen = usable.where(F.pmod(F.xxhash64(F.col(id_col)), F.lit(1_000_000)) < share * 1_000_000)
    # about max_rows ids and labels: small enough to broadcast whatever the tables hold
    texts = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(chosen), id_col)
    return texts.groupBy(id_col).agg(F.min("label").alias("label"), F.min("text").alias("text")).select("label", "text")


def one_of_copies(rows: DataFrame) -> DataFrame:
    """Of rows (label, text) one for each least hash of the words next to each other, which near copies mostly share, in
    a few rounds: else the words of a text that is copied often would look like evidence."""
    for size, seed in ((3, 1), (2, 2), (2, 3)):

        def run(batches: Iterator[pa.RecordBatch], size: int = size, seed: int = seed) -> Iterator[pa.RecordBatch]:
            for batch in common.slices(batches):
                keys = []
                for text in batch.column(1).to_pylist():
                    w = text.encode("utf-8", "surrogatepass").lower().split()
                    keys.append(min(xxhash.xxh3_64_intdigest(b" ".join(w[i : i + size]), seed) for i in range(max(1, len(w) - size + 1))) >> 1)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys, pa.int64())], ["label", "text", "key"])

        keyed = rows.select("label", "text").mapInArrow(run, "label int, text string, key long")
        rows = keyed.groupBy("key").agg(F.max(F.struct("label", "text")).alias("x")).select("x.label", "x.text")
    return rows


def learn(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", max_rows: int = MAX_ROWS, max_terms: int = MAX_TERMS) -> Lexicon:
    rows = common.stored(one_of_copies(sample(docs, labels, label_col, id_col, text_col, max_rows)))
    sizes = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic or not clean:
        return Lexicon()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally: dict[int, Counter] = {0: Counter(), 1: Counter()}
        for batch in common.slices(batches):
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                tally[int(label == 1)].update(terms(text))
        names = list(tally[0].keys() | tally[1].keys())
        for i in range(0, len(names), 50_000):
            part = names[i : i + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array([tally[1][t] for t in part], pa.int64()), pa.array([tally[0][t] for t in part], pa.int64())], ["term", "toxic", "clean"])

    odds = F.log((F.col("toxic") + 0.5) / (toxic + 1.0)) - F.log((F.col("clean") + 0.5) / (clean + 1.0))
    entries = (
        rows.select("label", "text").mapInArrow(count, "term string, toxic long, clean long")
        .groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
        .where((F.col("toxic") >= max(MIN_ROWS, MIN_SHARE * toxic)) & (F.col("toxic") / toxic >= LIFT * F.col("clean") / clean))
        .withColumn("odds", odds).where(F.col("toxic") * F.log(F.lit((toxic + clean) / toxic)) - F.col("clean") * 3 > SURPRISE).orderBy(F.desc(F.col("toxic") * F.col("odds")), "term").limit(max_terms).collect()
    )
    weights = {r["term"]: float(r["odds"]) for r in entries}
    lexicon = Lexicon(weights)

    def phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, tally = Matcher(lexicon), {0: Counter(), 1: Counter()}
        for batch in common.slices(batches):
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                folded = fold(text)
                if best := own.matches(folded):
                    spans = [m.span() for m in WORD.finditer(folded)]
                    for i, (a, b) in enumerate(spans):
                        if a in best:
                            tally[int(label == 1)].update({folded[a:b], folded[spans[max(0, i - 1)][0] : b], folded[a : spans[min(len(spans) - 1, i + 1)][1]]})
        names = [t for t in tally[0]] + [t for t in tally[1] if t not in tally[0]]
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([tally[1][t] for t in names], pa.int64()), pa.array([tally[0][t] for t in names], pa.int64())], ["term", "toxic", "clean"])

    spared = (
        rows.select("label", "text").mapInArrow(phrases, "term string, toxic long, clean long")
        .groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
        .where((F.col("clean") >= 3) & (F.col("clean") / clean > F.col("toxic") / toxic))
        .orderBy(F.desc("clean"), "term").limit(max_terms).collect()
    )
    lexicon = Lexicon(weights, [r["term"] for r in spared])

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Matcher(lexicon)
        for batch in common.slices(batches):
            x = [own.features(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([a for a, _ in x]), pa.array([b for _, b in x])], ["label", "a", "b"])

    # at most about max_rows points, in an order of their own: the same fit whatever order they come in
    points = np.array(sorted(tuple(r) for r in rows.select("label", "text").mapInArrow(features, "label int, a double, b double").collect()), dtype=float)
    common.dropped(rows)
    share = usable_labels(labels, label_col, id_col).agg(F.avg((F.col("label") == 1).cast("double"))).first()[0]
    return Lexicon(weights, lexicon.exceptions, logistic(points[:, 1:], points[:, 0], share))


def logistic(x: np.ndarray, y: np.ndarray, share: float, ridge: float = 1e-2, steps: int = 50) -> tuple[float, ...]:
    """Bias and weights of a logistic regression by Newton's method; label 1 weighs its share of all labels."""
    design = np.column_stack((np.ones(len(x)), x))
    per = np.where(y == 1, share / max(1, (y == 1).sum()), (1 - share) / max(1, (y != 1).sum())) * len(y)
    w = np.zeros(design.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        g = design.T @ (per * (p - y)) + ridge * w
        h = (design * (per * p * (1 - p))[:, None]).T @ design + ridge * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in w)


def score(docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id and its score, from 0 to 1."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Matcher(lexicon)
        for batch in common.slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([own.score(t or "") for t in batch.column(1).to_pylist()], pa.float64())], [id_col, "score"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, score double")
