"""Periodic runs of words, found in linear time by the method of Kolpakov and Kucherov.

A run is a stretch of consecutive words with smallest period q and a length of at least max(LEAST, 2 * q) that no
neighbouring word extends keeping the period. Per text:

* Words become numbers. In a run each word lies in a window of LEAST // 2 words that occurs again within the run, so
  words outside all repeated windows cut a text into stretches, each looked at on its own. Most texts have no stretch left.
* A suffix automaton of the stretch, with the first end of each state, gives the LZ factors: each is the longest piece that
  begins earlier too, or one new word.
* A run belongs to the last factor start that it touches. For these Main's algorithm compares what is left and right of the
  start at each distance q, by Z functions: matches of q words and more are runs. The start of a run that ends in a factor
  is at most twice the length of the factor before and the factor's length to the left, so the work adds up to linear.
* The other runs are strictly inside a factor and are copies of runs in the factor's earlier occurrence.

A text is one record and is worked on whole in its task, in memory proportional to its words; nothing is shuffled. Null or
empty texts have no words and no runs; a row's id may be null; repeated rows and ids give a row each; an empty table gives
an empty table; other columns are not carried along, whatever their names.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common

#: The least number of words of a run, whatever its period.
LEAST = 12
#: Multipliers of the window hashes, odd and fixed.
STEP, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def words_of(text: str | None) -> list[bytes]:
    """The words of a text, cut at blanks and at tab to carriage return only."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def made_periodic(words: list, doc_id) -> list:
    """The words as the query wants them: in one of ten documents the words from a place on repeat with a period."""
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def numbered(words: list) -> np.ndarray:
    seen: dict = {}
    return np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))


def stretches(codes: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Ends of the stretches that can hold a run, narrowed until each window repeats within its own stretch.

    Equal windows have equal hashes, so hashing can only leave more words in, never leave a run out.
    """
    width, todo, out = least // 2, [(0, len(codes))], []
    while todo:
        low, high = todo.pop()
        if high - low < least:
            continue
        part = codes[low:high].astype(np.uint64)
        rolled = np.zeros(len(part) - width + 1, np.uint64)
        for i in range(width):
            rolled = (rolled ^ part[i : len(part) - width + 1 + i]) * STEP
            rolled ^= rolled >> np.uint64(29)
        _, where, times = np.unique(rolled * MIX, return_inverse=True, return_counts=True)
        again = times[where] > 1
        if not again.any():
            continue
        edges = np.zeros(len(part) + 1, np.int64)
        np.add.at(edges, np.flatnonzero(again), 1)
        np.add.at(edges, np.flatnonzero(again) + width, -1)
        covered = np.concatenate(([False], np.cumsum(edges[:-1]) > 0, [False]))
        turns = np.flatnonzero(covered[1:] != covered[:-1])
        found = [(low + int(a), low + int(b)) for a, b in zip(turns[::2], turns[1::2], strict=True)]
        (out if found == [(low, high)] else todo).extend(found)
    return sorted(out)


def lz_factors(w: list[int]) -> list[tuple[int, int, int]]:
    """(start, end, start of an earlier occurrence or -1) of each factor, walked on the suffix automaton of the words."""
    step: list[dict[int, int]] = [{}]
    link, length, first = [-1], [0], [-1]
    last = 0
    for i, c in enumerate(w):
        new = len(step)
        step.append({})
        length.append(length[last] + 1)
        first.append(i)
        link.append(0)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                clone = len(step)
                step.append(step[q].copy())
                length.append(length[p] + 1)
                first.append(first[q])
                link.append(link[q])
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = clone
                    p = link[p]
                link[q] = link[new] = clone
        last = new
    out, at, n = [], 0, len(w)
    while at < n:
        state, end, source = 0, at, -1
        while end < n:
            state = step[state][w[end]]
            if first[state] >= end:
                break
            source = first[state] - (end - at)
            end += 1
        out.append((at, max(end, at + 1), source))
        at = max(end, at + 1)
    return out


def z_function(s: list[int]) -> list[int]:
    """For each place the length of the longest prefix of s that begins there too."""
    n = len(s)
    z = [0] * n
    if n:
        z[0] = n
    left = right = 0
    for i in range(1, n):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        if i + k > right:
            left, right = i, i + k
        z[i] = k
    return z


def crossing(w: list[int], low: int, at: int, end: int) -> Iterator[tuple[int, int, int]]:
    """(start, end, q) where words q apart match around `at` over q places or more, between low and end."""
    left, right = w[low:at], w[at:end]
    n, m = len(left), len(right)
    own = z_function(right)
    # suffixes of left that are suffixes of right[:q] as well
    back = z_function([*left[::-1], -1, *right[::-1]])
    for q in range(1, m + 1):
        ahead, behind = own[q] if q < m else 0, back[n + 1 + m - q]
        if ahead + behind >= q:
            yield at - behind, at + q + ahead, q
    before = z_function(left[::-1])
    forth = z_function([*right, -1, *left, *right])
    for q in range(1, n + 1):
        ahead, behind = min(forth[m + 1 + n - q], m), before[q] if q < n else 0
        if ahead + behind >= q:
            yield at - q - behind, at + ahead, q


def runs_of(w: list[int], least: int = LEAST) -> list[tuple[int, int, int]]:
    """All runs (start, length, period) of numbers of 0 and more, by start, then period."""
    n = len(w)
    w = [*w, -2]  # a last factor of its own, so that runs up to the end touch a factor start
    found: dict[tuple[int, int], int] = {}
    by_start: dict[int, list[tuple[int, int]]] = {}

    def add(a: int, b: int, q: int) -> None:
        if (a, b) not in found:
            found[a, b] = q
            by_start.setdefault(a, []).append((b, q))

    before = 0
    for at, end, source in lz_factors(w):
        reach = at - before + end - at
        if at and 2 * reach > least:
            here: dict[tuple[int, int], int] = {}
            for a, b, q in crossing(w, max(0, before - reach), at, end):
                if b - a >= least and (a == 0 or w[a - 1] != w[a - 1 + q]) and (b > n or w[b] != w[b - q]):
                    here[a, b] = min(q, here.get((a, b), q))
            for (a, b), q in sorted(here.items()):
                add(a, b, q)
        if source >= 0 and end - at >= least and by_start:
            moved = at - source
            for a in range(source + 1, end - moved):
                for b, q in tuple(by_start.get(a, ())):
                    if b < end - moved:
                        add(a + moved, b + moved, q)
        before = at
    return sorted((a, b - a, q) for (a, b), q in found.items())


def text_runs(words: list, least: int = LEAST) -> list[tuple[int, int, int]]:
    """All runs (start, length, period) of a list of words, by start, then period."""
    codes = numbered(words)
    return sorted((low + a, length, q) for low, high in stretches(codes, least) for a, length, q in runs_of(codes[low:high].tolist(), least))


def collapsed(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words without those that a run holds after its first period."""
    edges = np.zeros(len(words) + 1, np.int64)
    for a, length, q in runs:
        edges[a + q] += 1
        edges[a + length] -= 1
    return [w for w, k in zip(words, np.cumsum(edges[:-1]).tolist(), strict=True) if not k]


SCHEMA = "{} {}, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", change=None, least: int = LEAST) -> DataFrame:
    """Per row: the id, n_runs, the longest run (start, length, period, exponent_milli; nulls without runs; of equally long
    ones that of the smallest start, then period), and digests of all runs and of the words that stay when runs are
    collapsed to their first period. change(words, id) may replace the words first.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            rows = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = words_of(text)
                words = change(words, key) if change else words
                runs = text_runs(words, least)
                best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
                longest = (None,) * 4 if best is None else (*best, 1000 * best[1] // best[2])
                listed = "".join(f"{a},{b},{q}\n" for a, b, q in runs)
                rows.append((len(runs), *longest, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(collapsed(words, runs))).hexdigest()))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 7
            arrays = [pa.array(c, pa.int64() if i < 5 else pa.string()) for i, c in enumerate(columns)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], [id_col, "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"])

    return docs.select(id_col, text_col).mapInArrow(run, SCHEMA.format(f"`{id_col}`", kind))


def without_repeats(docs: DataFrame, text_col: str = "text", least: int = LEAST) -> DataFrame:
    """The rows with their runs collapsed to the first period: words joined by one blank where there was a run, else the
    text as it is; null stays null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            at, out = batch.schema.get_field_index(text_col), []
            for text in batch.column(at).to_pylist():
                words = words_of(text)
                runs = text_runs(words, least)
                out.append(b" ".join(collapsed(words, runs)).decode("utf-8", "surrogatepass") if runs else text)
            yield batch.set_column(at, batch.schema.field(at), pa.array(out, batch.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)
