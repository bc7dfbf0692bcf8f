"""N-gram Jaccard join by parity sketches.

A document is the set of its word shingles (64-bit hashes). Two sets of similarity p/100 or more differ in at most
d = floor((100 - p) * (|A| + |B|) / (100 + p)) shingles. Shingles are XORed into parity sketches. In each band of sizes
a sketch has more than d words of 64 bits, d for the largest sets of the band, and a shingle changes one word: by the
pigeonhole principle linked sets agree in a word. Words are joined. A second sketch, of 1024 bits, has one bit flipped
for each shingle, so its Hamming distance is at most the size of the symmetric difference: pairs further apart than d
are dropped. Sets of more shingles than that would fill these bits, whatever they hold, so they have a third sketch, of a bit
for each shingle at least; else all pairs of long texts that share a passage would be left, which grow with its square. The others are verified on the sets, so the links are exact (but for collisions of 64-bit hashes).

Copies: equal sets are one class; only the words of its least id are joined. No group is expanded into all its pairs:

* a word shared by two sets gives that pair; by more sets, each member with two members chosen by hash. Of a set's
  partners the nearest by sketch are verified first, and the links found are contracted to components; then the
  other partners, as far as they are across components;
* then, for words whose members are in different components still, the members outside a word's largest component are
  compared with all others across components, hot words dealt into blocks by a salt, a block's rows in one task; only pairs
  that the sketches can't rule out leave the task, and are verified. Nothing is capped, so no link between components is lost.

Hot words: counts and marks of a word are partial aggregates; the join that tells members their word's marks has one row
a word on one side and may be split by Spark's skew join; later joins are salted by the word's count.

Ids are of any type that orders. Rows with null ids have no component and link with nothing, as have null texts and
texts without words. Texts of fewer words than a shingle has are one shingle. Repeated rows give repeated results. If
rows share an id but not the text, each has the component of its own text, and the id stands for all its texts in links.
An empty table gives an empty result. Only the id and text columns are read, so others may have any name.
"""

from __future__ import annotations

import functools
import math
import operator
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .components import components

LANES = 16
#: Sets of more shingles than bits of the sketch have a long one as well.
LONG_FROM = LANES * 64
#: Members of a word that are compared in one block.
BLOCK = 1024
#: Pairs, or numbers of their sketches, that are compared at a time.
COMPARED = 1 << 18
#: Rows of a word in a block: of the word's largest component, of others, and of others from another block.
RANKS = {"big": 0, "minor": 1, "visitor": 2}
#: Parts that the words are dealt into.
PARTS = 8
#: Partners of a set that are verified first.
NEAREST = 3
MIX = np.uint64(0x9E3779B97F4A7C15)
TURN = np.uint64(0xBF58476D1CE4E5B9)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * TURN
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, size: int) -> np.ndarray:
    """The sorted hashes of a text's distinct shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    k = min(size, len(words))
    total = np.full(len(words) - k + 1, k, np.uint64)
    for i in range(k):
        total = mixed(total * MIX + h[i : len(h) - k + 1 + i])
    return np.unique(total)


def parity(h: np.ndarray, bits: np.ndarray, words: int) -> np.ndarray:
    """Words of 64 bits, the bit of each shingle flipped."""
    return np.packbits((np.bincount(bits, minlength=words * 64) & 1).astype(np.uint8)).view(np.uint64)


def long_parity(h: np.ndarray) -> np.ndarray:
    """The sketch of a long set: as many bits as shingles, rounded up to a power of two; one of twice the bits folds on to it. Empty for others."""
    if len(h) <= LONG_FROM:
        return np.empty(0, np.int64)
    words = 1 << (len(h) - 1).bit_length() - 6
    return parity(h, (mixed(h ^ TURN) & np.uint64(64 * words - 1)).astype(np.int64), words).view(np.int64)


@functools.lru_cache(maxsize=None)
def bands(percent: int, limit: int = 1 << 40) -> list[int]:
    """Lower ends of the size bands, each a quarter longer than the one before."""
    ends = [1]
    while ends[-1] < limit:
        ends.append(max(ends[-1] + 1, ends[-1] * 5 // 4))
    return ends


def difference(percent: int, total: int) -> int:
    """The most shingles by which two linked sets of that total size differ."""
    return (100 - percent) * total // (100 + percent)


@functools.lru_cache(maxsize=None)
def lanes(band: int, percent: int) -> tuple[int, int]:
    """The number of sketch words of a band (0: only equal sets link), and how many of them may be empty for free.

    With d + 1 + m words linked sets agree in m + 1 at least. A set with up to m empty words therefore agrees with each
    partner in one that isn't empty, and needn't be joined on the empty ones, which very many sets share.
    """
    ends = bands(percent)
    low, high = ends[band] * percent / 100, ends[band + 1] - 1
    d = difference(percent, 2 * high)
    if not d:
        return 0, 0
    empty = lambda k: k * math.exp(-low / k)
    m = math.ceil(2 * empty(d + 1)) + 1 if empty(d + 1) > 0.05 else 0
    return d + 1 + m, m


def words_of(h: np.ndarray, percent: int) -> np.ndarray:
    """The sketch words of a set, hashed with their places: of its own band, and of each longer one that has sets that can link with it."""
    ends, n = bands(percent), len(h)
    own = int(np.searchsorted(ends, n, side="right")) - 1
    out = []
    for band in range(own, len(ends) - 1):
        if band > own and 100 * n < percent * ends[band]:
            break
        k, m = lanes(band, percent)
        if not k:
            continue
        lane = (h % np.uint64(k)).astype(np.int64)
        order = np.argsort(lane, kind="stable")
        starts = np.flatnonzero(np.diff(lane[order], prepend=-1))
        sketch, place = np.bitwise_xor.reduceat(mixed(h ^ MIX)[order], starts), lane[order][starts]
        if k - len(place) > m:
            place = np.concatenate((place, np.setdiff1d(np.arange(k), place)))
            sketch = np.concatenate((sketch, np.zeros(k - len(sketch), np.uint64)))
        out.append(mixed(sketch + mixed(place.astype(np.uint64) + np.uint64(band << 32))))
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def fingerprints(h: np.ndarray) -> tuple[int, int]:
    return (int(np.bitwise_xor.reduce(mixed(h ^ MIX)).view(np.int64)), int(mixed(h + TURN).sum(dtype=np.uint64).view(np.int64))) if len(h) else (0, 0)


def features(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Per row (id, text): id, a hash of the text, n_shingles, two fingerprints of the set, which tell equal sets, its sketch of
    1024 bits, its long sketch, and its words for the join, those of part k in a field pk of their own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            found = [shingles(t, size) for t in batch.column(1).to_pylist()]
            sketches = [parity(h, (mixed(h ^ TURN) >> np.uint64(54)).astype(np.int64), LANES).view(np.int64) if len(h) else np.zeros(LANES, np.int64) for h in found]
            marks = [pa.array(x, pa.int64()) for x in zip(*((len(h), *fingerprints(h)) for h in found), strict=True)]
            words = pa.StructArray.from_arrays(dealt([words_of(h, percent) if len(h) else np.empty(0, np.uint64) for h in found]), [f"p{k}" for k in range(PARTS)])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *marks, flat(sketches), flat([long_parity(h) for h in found]), words], names)

    names = ["id", "th", "n_shingles", "fp1", "fp2", "sketch", "long", "words"]
    kind = docs.schema["id"].dataType.simpleString()
    fields = ", ".join(f"p{k}: array<long>" for k in range(PARTS))
    return docs.select("id", "text", F.xxhash64("text").alias("th")).mapInArrow(run, f"id {kind}, th long, n_shingles long, fp1 long, fp2 long, sketch array<long>, long array<long>, words struct<{fields}>")


def dealt(words: list[np.ndarray]) -> list[pa.ListArray]:
    """The words of each row of a batch dealt into PARTS by their remainder: a column of lists a part."""
    rows, every = len(words), np.concatenate(words)
    part = (every % np.uint64(PARTS)).astype(np.uint8)
    counts = np.bincount(part.astype(np.int64) * rows + np.repeat(np.arange(rows), [len(w) for w in words]), minlength=PARTS * rows).reshape(PARTS, rows)
    pieces = np.split(every[np.argsort(part, kind="stable")].view(np.int64), np.cumsum(counts.sum(axis=1))[:-1])
    return [pa.ListArray.from_arrays(pa.array(np.cumsum([0, *n]), pa.int32()), pa.array(x, pa.int64())) for n, x in zip(counts, pieces, strict=True)]


def flat(parts: list[np.ndarray]) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, parts)]), pa.int32()), pa.array(np.concatenate(parts) if parts else np.empty(0, np.int64), pa.int64()))


def hamming(a: str, b: str) -> Column:
    return functools.reduce(operator.add, (F.bit_count(F.col(f"{a}.sketch")[i].bitwiseXOR(F.col(f"{b}.sketch")[i])) for i in range(LANES)))


def sized(a: str, b: str, percent: int) -> Column:
    """Whether sizes leave a link of two rows possible."""
    na, nb = F.col(f"{a}.n_shingles"), F.col(f"{b}.n_shingles")
    return 100 * F.least(na, nb) >= percent * F.greatest(na, nb)


def within(a: str, b: str, percent: int) -> Column:
    """Whether sizes and sketches leave a link of two rows possible."""
    na, nb = F.col(f"{a}.n_shingles"), F.col(f"{b}.n_shingles")
    return sized(a, b, percent) & ((100 + percent) * hamming(a, b) <= (100 - percent) * (na + nb))


def long_within(a: str, b: str, percent: int) -> Column:
    """The same by long sketches, the longer one folded on to the other. Rows without one, or of over twice the bits, aren't ruled out."""
    x, y, total = F.col(f"{a}.long"), F.col(f"{b}.long"), F.col(f"{a}.n_shingles") + F.col(f"{b}.n_shingles")
    least, most = F.least(F.size(x), F.size(y)), F.greatest(F.size(x), F.size(y))
    past = lambda v, i: F.coalesce(F.get(v, i + least), F.lit(0).cast("long"))
    flipped = lambda i: F.get(x, i).bitwiseXOR(F.get(y, i)).bitwiseXOR(past(x, i)).bitwiseXOR(past(y, i))
    far = F.aggregate(F.sequence(F.lit(0), least - 1), F.lit(0), lambda n, i: n + F.bit_count(flipped(i)))
    return F.when((least > 0) & (most <= 2 * least), (100 + percent) * far <= (100 - percent) * total).otherwise(F.lit(True))


def texts_of(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """The texts of the ids in pairs (a, b), each text of an id once. A sort-merge join at any size: ids grow with the input."""
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()
    return common.stored(rows.join(ids.hint("merge"), "id", "left_semi").dropDuplicates(["id", "text"]))


def verified(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Of pairs (a, b) of ids those that link, by their sets. Texts are shuffled, which are compressed, and sets made where both meet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = functools.lru_cache(maxsize=64)(lambda text: shingles(text, size))  # rows are sorted by one of the ids
        for batch in common.slices(batches):
            linked = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = found(x), found(y)
                inter = len(np.intersect1d(x, y, assume_unique=True))
                linked.append(inter > 0 and 100 * inter >= percent * (len(x) + len(y) - inter))
            yield batch.select([0, 1]).filter(pa.array(linked, pa.bool_()))

    left, right = (texts.select(F.col("id").alias(c), F.col("text").alias(f"t{c}")).hint("merge") for c in "ab")
    return common.stored(pairs.join(left, "a").join(right, "b").select("a", "b", "ta", "tb").mapInArrow(run, pairs.select("a", "b").schema))


def longs(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of an array column, end to end, and where each row's begin and end; without signs, as the bits of absolute values are counted."""
    return column.flatten().to_numpy(zero_copy_only=False).view(np.uint64), np.concatenate(([0], np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))))


def left_open(x: np.ndarray, y: np.ndarray, n: np.ndarray, sketch: np.ndarray, long: tuple[np.ndarray, np.ndarray], percent: int) -> np.ndarray:
    """Of pairs of rows (x[i], y[i]) which sizes and sketches don't rule out, as within and long_within tell of columns."""
    ok = np.flatnonzero(100 * np.minimum(n[x], n[y]) >= percent * np.maximum(n[x], n[y]))
    most = lambda i: (100 - percent) * (n[x[i]] + n[y[i]])
    ok = ok[(100 + percent) * np.bitwise_count(sketch[x[ok]] ^ sketch[y[ok]]).sum(axis=1, dtype=np.int64) <= most(ok)]
    flat, at = long
    size = np.diff(at)
    swap = size[x[ok]] > size[y[ok]]
    short, longer = np.where(swap, y[ok], x[ok]), np.where(swap, x[ok], y[ok])
    keep = np.ones(len(ok), bool)
    for k in np.unique(size[short]).tolist():
        for w in (k, 2 * k) if k else ():
            these = np.flatnonzero((size[short] == k) & (size[longer] == w))
            for i in np.split(these, range(step := max(1, COMPARED // w), len(these), step)):
                folded = np.bitwise_xor.reduce(flat[at[longer[i]][:, None] + np.arange(w)].reshape(len(i), w // k, k), axis=1)
                far = np.bitwise_count(folded ^ flat[at[short[i]][:, None] + np.arange(k)]).sum(axis=1, dtype=np.int64)
                keep[i] = (100 + percent) * far <= most(ok[i])
    return ok[keep]


def open_in(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Pairs of ids that are in different components and that sketches can't rule out, of rows sorted by word, block and rank.

    Each row but those of the largest component meets the rows before it that are at home in its block; a minor one at home in
    another block meets those of the largest component, and the minor ones of later blocks. What is held is a block's own rows.
    """
    held = None
    for batch in batches:
        rows = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        new, rows = rows.num_rows - batch.num_rows, rows.combine_chunks()
        if not batch.num_rows:
            continue
        word, block, home, rank, part, n = (rows[c].to_numpy() for c in ("word", "block", "home", "rank", "part", "n_shingles"))
        ids = rows["id"].combine_chunks()
        sketch, long = longs(rows["sketch"].combine_chunks())[0].reshape(-1, LANES), longs(rows["long"].combine_chunks())
        starts = np.flatnonzero(np.concatenate(([True], (word[1:] != word[:-1]) | (block[1:] != block[:-1]))))
        own = np.add.reduceat((rank != RANKS["visitor"]).astype(np.int64), starts)
        group = np.repeat(np.arange(len(starts)), np.diff(starts, append=len(word)))
        row = np.arange(len(word))
        counts = np.where((row >= new) & (rank != RANKS["big"]), np.minimum(row - starts[group], own[group]), 0)
        ends, low = np.cumsum(counts), 0
        while low < len(row):
            high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + COMPARED, side="right")))
            x = np.repeat(row[low:high], counts[low:high])
            y = starts[group[x]] + np.arange(len(x)) - np.repeat(ends[low:high] - counts[low:high] - (ends[low - 1] if low else 0), counts[low:high])
            once = (part[x] != part[y]) & ((rank[x] == RANKS["minor"]) | (rank[y] == RANKS["big"]) | (home[x] < block[x]))
            x, y = x[once], y[once]
            some = left_open(x, y, n, sketch, long, percent)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(x[some])), ids.take(pa.array(y[some]))], ["x", "y"])
            low = high
        held = rows.slice(starts[-1], own[-1])


def open_pairs(many: DataFrame, slim: DataFrame, percent: int, block: int) -> DataFrame:
    """Pairs (a, b) of members of a word that are in different components and that sketches can't rule out.

    many: rows (id, word, n, c) of the members of words that more than two sets share, n being the word's members and c the
    member's component. Members outside a word's largest component are spread over blocks of all members, so what is
    compared is those members by all, and what is shuffled a copy of them for each block.
    """
    per = many.groupBy("word", "c").agg(F.count(F.lit(1)).alias("k"), F.max("n").alias("n"))
    info = per.groupBy("word").agg(F.max_by("c", F.struct("k", "c")).alias("big"), F.max("n").alias("n"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
    blocks = F.ceil(F.col("n") / block).cast("int")
    salts = info.select("word", "big", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"))
    dealt = many.withColumn("block", F.pmod(F.hash("id"), blocks)).join(salts, ["word", "block"])
    facts = ["id", "word", "block", "home", "rank", F.xxhash64("c").alias("part"), "n_shingles", "sketch", "long"]
    rank = F.when(F.col("c") == F.col("big"), RANKS["big"]).otherwise(RANKS["minor"])
    rows = common.stored(dealt.join(slim, "id").withColumns({"home": F.col("block"), "rank": rank}).select(*facts, (blocks - 1).alias("last")))
    visits = rows.where(f"rank = {RANKS['minor']}").withColumn("block", F.explode(F.sequence(F.lit(0), "last"))).where("block <> home").withColumn("rank", F.lit(RANKS["visitor"]))
    met = rows.union(visits.select(rows.columns)).drop("last").repartition("word", "block").sortWithinPartitions("word", "block", "rank")
    kind = slim.schema["id"].dataType.simpleString()
    across = met.mapInArrow(lambda batches: open_in(batches, percent), f"x {kind}, y {kind}")
    found = common.stored(across.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    common.dropped(rows)
    return found


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """Per row: the id, n_shingles, and component_id, the least id that links reach (the id itself without links)."""
    docs = docs.select(F.col(id_col), F.col(text_col))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    # texts are read where they lie, and the words of representatives alone are shuffled, a part at a time
    known = common.stored(features(rows, size, percent))
    ids = common.stored(known.select("id", "n_shingles", "fp1", "fp2"))
    least = known.where("id is not null and n_shingles > 0").groupBy("fp1", "fp2", "n_shingles").agg(F.min(F.struct("id", "th")).alias("x"))
    classes = common.stored(least.select(F.col("x.id").alias("rep"), F.col("x.th").alias("th"), "n_shingles", "fp1", "fp2"))
    chosen = classes.select(F.col("rep").alias("id"), "th")

    def of_reps(*columns: str) -> DataFrame:
        # one row for each text of an id: a text is in one class, so it stands for one
        return known.select("id", "th", *columns).join(chosen, ["id", "th"], "left_semi").dropDuplicates(["id", "th"]).drop("th")

    slim = common.stored(of_reps("n_shingles", "sketch", "long"))

    # the words are joined part by part, so that shuffle files of one part at a time are kept; first they are only counted
    shared_parts = []
    for part in range(PARTS):
        members = common.stored(of_reps(f"words.p{part}").select("id", F.explode(f"p{part}").alias("word")))
        counted = common.stored(members.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
        shared_parts.append(common.stored(members.join(counted, "word")))
        common.dropped(members, counted)
    common.dropped(known)
    shared = functools.reduce(DataFrame.union, shared_parts)
    many = shared.where("n > 2")
    mark = F.xxhash64("id", "word")  # two members of each word, by an order that differs from word to word
    ends = common.stored(shared.groupBy("word").agg(F.max("n").alias("n"), F.min_by("id", mark).alias("low"), F.max_by("id", mark).alias("high")))
    # of each set's partners there are at most two for each of its own words
    stars = many.select("id", "word").join(ends.where("n > 2"), "word").select("id", F.explode(F.array("low", "high")).alias("other")).where("id <> other")
    pairs = ends.where("n = 2 and low <> high").select(F.col("low").alias("id"), F.col("high").alias("other")).union(stars).distinct()
    brief = slim.select("id", "n_shingles", "sketch")
    one, other = brief.alias("x"), brief.withColumnRenamed("id", "other").alias("y")
    hinted = common.stored(pairs.join(one, "id").join(other, "other").where(within("x", "y", percent)).select("id", "other", hamming("x", "y").alias("far")))
    # long sketches go only to what the others leave; any two texts of a pair of ids may link
    lengthy = slim.select("id", "n_shingles", "long")
    one, other = lengthy.alias("x"), lengthy.withColumnRenamed("id", "other").alias("y")
    near = common.stored(hinted.join(one, "id").join(other, "other").where(sized("x", "y", percent) & long_within("x", "y", percent)).select("id", "other", "far").distinct())
    common.dropped(hinted)
    nearest = near.groupBy("id").agg(F.slice(F.array_sort(F.collect_list(F.struct("far", "other"))), 1, NEAREST).alias("p")).select("id", F.explode("p.other").alias("other"))
    both_ways = lambda df: df.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct()
    checked = [common.stored(both_ways(nearest))]
    texts = texts_of(near.select(F.col("id").alias("a"), F.col("other").alias("b")), rows)
    verdicts = [verified(checked[0], texts, size, percent)]
    found = components(verdicts[0])

    def label(df: DataFrame, key: str, name: str) -> DataFrame:
        named = found.select(F.col("node").alias(key), F.col("component").alias(name))
        return df.join(named, key, "left").withColumn(name, F.coalesce(name, key))

    def settle(candidates: DataFrame, texts: DataFrame | None = None) -> None:
        """Verify pairs across components that weren't before, and join the components that they link."""
        nonlocal found
        rest = common.stored(candidates.join(functools.reduce(DataFrame.union, checked), ["a", "b"], "left_anti"))
        own = texts_of(rest, rows) if texts is None else texts
        more = verified(rest, own, size, percent)
        if texts is None:
            common.dropped(own)
        checked.append(rest)
        verdicts.append(more)
        if not more.isEmpty():
            old, found = found, components(functools.reduce(DataFrame.union, verdicts))
            common.dropped(old)

    # the other partners, as far as they are across components; then all members of words that hold several components
    settle(both_ways(label(label(near, "id", "ca"), "other", "cb").where("ca <> cb")), texts)
    common.dropped(texts)
    across = open_pairs(label(many.select("id", "word", "n"), "id", "c"), slim, percent, BLOCK)
    settle(across)

    placed = classes.join(found, classes["rep"] == found["node"], "left").select("fp1", "fp2", "n_shingles", F.coalesce("component", "rep").alias("component_id"))
    out = ids.join(placed, ["fp1", "fp2", "n_shingles"], "left")
    alone = F.col("id").isNull() | (F.col("n_shingles") == 0)
    final = common.stored(out.select(F.col("id").alias(id_col), "n_shingles", F.when(alone, F.col("id")).otherwise(F.col("component_id")).alias("component_id")))
    common.dropped(slim, *shared_parts, ends, near, across, *checked, *verdicts, found, classes, ids)
    return final
