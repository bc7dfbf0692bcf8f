"""A quality classifier by Bradley-Terry ranking of documents.

Pairs of a good and a bad labelled document are compared: the chance that the good one wins is the logistic function
of the difference of their scores, a linear function of counts of the text. The weights minimise the logistic loss
over the pairs. The threshold is a quantile of the scores of the rows learned from; scores are then mapped on to 0 to
1 so that it falls on 0.3.

Learning reads no more than about `max_rows` labelled rows, half of each label where there are as many, and compares
each with `PARTNERS` of the other label; all texts are scored, whole. Null texts are empty. Without labels of both
kinds every score is 0.5. Repeated rows give repeated results; of an id with several labels or texts the least is learned
from; an empty table gives an empty result; only the named columns are read, so others may have any name.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common
from .quality_rules import STOP_WORDS
from .toxicity import sample

MAX_ROWS = 8_000
PARTNERS = 8
AT_THRESHOLD = 0.3
STOPS = frozenset(w.encode() for w in STOP_WORDS)
FEATURES = ["symbols", "bars", "marks", "capitals", "stop words", "repeated lines", "repeated triples", "few words", "word length", "digits", "tiny"]


def features(text: str) -> list[float]:
    """Measures of a text, each between 0 and 1."""
    data = text.encode("utf-8", "surrogatepass")
    words = data.lower().split()
    n = len(words)
    if not n:
        return [0.0] * (len(FEATURES) - 1) + [1.0]
    lines = [x for x in text.split("\n") if x and not x.isspace()]
    triples = max(1, n - 2)
    cap = lambda x: min(1.0, x)
    letters = max(1, len(data) - n)
    upper = len(data) - len(data.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    count = lambda chars: len(data) - len(data.translate(None, chars))
    return [
        cap(count(b"#*$%&<>") / n), cap(4 * data.count(b"|") / n), cap(count(b"!?") / n), cap(2 * upper / letters),
        cap(4 * sum(w.strip(b".,;:!?|*#$%&") in STOPS for w in words) / n), cap(2 * (len(lines) - len(set(lines))) / len(lines)) if lines else 0.0,
        cap(1.5 * (1 - len(set(zip(words, words[1:], words[2:]))) / triples)) if n > 2 else 0.0, cap(1.5 * (1 - len(set(words)) / n)),
        cap(letters / n / 20), cap(10 * count(b"0123456789") / letters), cap(5 / n),
    ]


@dataclass
class Model:
    weights: tuple[float, ...]
    threshold: float
    scale: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = math.log(AT_THRESHOLD / (1 - AT_THRESHOLD)) + (x @ np.array(self.weights) - self.threshold) * self.scale
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def bradley_terry(good: np.ndarray, bad: np.ndarray, ridge: float = 1.0, steps: int = 60) -> np.ndarray:
    """Weights that minimise the logistic loss of score differences; each row meets the same number of partners."""
    n = max(len(good), len(bad))
    i = np.arange(n * PARTNERS)
    d = good[i % len(good)] - bad[(i + i // n * 7919) % len(bad)]
    w = np.zeros(good.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(d @ w, -30, 30)))
        g = d.T @ (p - 1) + ridge * w
        h = (d * (p * (1 - p))[:, None]).T @ d + ridge * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def learn(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", max_rows: int = MAX_ROWS) -> Model | None:

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            x = [features(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.list_(pa.float64()))], ["label", "x"])

    rows = sample(docs, labels, label_col, id_col, text_col, max_rows).mapInArrow(run, "label int, x array<double>").collect()
    x, y = np.array([r["x"] for r in rows]).reshape(len(rows), len(FEATURES)), np.array([r["label"] for r in rows])
    order = np.lexsort((*x.T, y))  # the same whatever order the rows come in
    x, y = x[order], y[order]
    good, bad = x[y == 1], x[y == 0]
    if not len(good) or not len(bad):
        return None
    w = bradley_terry(good, bad)
    s_good, s_bad = np.sort(good @ w), np.sort(bad @ w)
    # the quantile of all scores that parts the labels best, each label weighing the same
    cuts = np.quantile(np.concatenate((s_good, s_bad)), np.linspace(0, 1, 2001))
    cuts = (cuts[1:] + cuts[:-1]) / 2
    right = 1 - np.searchsorted(s_good, cuts) / len(s_good) + np.searchsorted(s_bad, cuts) / len(s_bad)
    best = np.flatnonzero(right >= right.max() - 1e-12)
    threshold = float(cuts[best[len(best) // 2]])
    spread = float(np.std(np.concatenate((s_good, s_bad)))) or 1.0
    return Model(tuple(map(float, w)), threshold, 2 / spread)


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id and its score, from 0 to 1."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            s = np.full(len(texts), 0.5) if model is None else model.scores(np.array([features(t) for t in texts]).reshape(len(texts), len(FEATURES)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s, pa.float64())], [id_col, "score"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, score double")
