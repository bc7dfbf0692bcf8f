"""Prefix trie of conversations, by an LCP-aware mergesort of their turns.

A conversation is a path: the 16-byte digests of its turns, one after another, so paths compare bytewise, and a common
prefix of paths is a common prefix of turns (but for collisions of 128-bit digests). `paths` makes them with built-in
expressions and one shuffle; texts are not shuffled.

The paths, ordered by themselves and the id, are dealt into ranges by Spark; a hot conversation or first turn is spread over
as many ranges as its size asks for. A task sorts each Arrow batch of its range into a run whose members carry the length of
the prefix that they share with the one before (LCP). A loser tree merges the runs: heads with different LCPs to the last
output are ordered by these alone, and equal ones are compared behind the shared turns only. A stack holds the open path of
the merged stream: what a path doesn't share with the one before closes nodes, which are then finished.

Nodes on a range's first or last path may go on in a neighbouring range. Their parts are added up by their key; what a
node shares between two ranges was counted in each, and the pairs of last and first path, one for each range, say how much is
taken off again. So what is combined grows with ranges times turns, not with nodes. Ids that end in such a node are
digested as a stream of chunks in order.

A range is cut to hold about PART_BYTES of paths, which bounds a task's memory; a single conversation (24 bytes a turn) has
to fit in a task. Turns are ordered by number, null first, equal numbers by digest; null role or text is empty; rows
without conv_id are left out; repeated turns are turns; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from . import common

#: Bytes of paths that a range is cut to.
PART_BYTES = 16 << 20
DIGEST = 16
#: Ids of a chunk that is handed on for a digest.
CHUNK = 1 << 16

Item = tuple[bytes, int, list[int]]


def turns_of(conversations: DataFrame) -> DataFrame:
    """Per turn: conv_id, turn, digest (hex) and n_bytes of its text."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    sized = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    return conversations.where("conv_id is not null").select(F.col("conv_id").cast("long"), "turn", F.md5(sized.cast("binary")).alias("digest"), F.octet_length(text).cast("long").alias("n_bytes"))


def path_of(turns) -> list:
    return [F.unhex(F.array_join(F.transform(turns, lambda t: t["digest"]), "")).alias("path"), F.transform(turns, lambda t: t["n_bytes"]).alias("sizes")]


def paths(conversations: DataFrame) -> DataFrame:
    """Per conversation: conv_id, path, sizes (the bytes of each turn's text)."""
    turns = turns_of(conversations).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "digest", "n_bytes"))).alias("turns"))
    return turns.select("conv_id", *path_of(F.col("turns")))


def rebuilt_paths(conversations: DataFrame, family: int = 5, most: int = 9) -> DataFrame:
    """paths() of rebuilt conversations: c takes its first h turns from c - c % family, h = crc32(c as text) % most, and the
    turns after the first h from its own. A family of conversations is brought together, so that one shuffle serves both.
    """
    turns = turns_of(conversations)
    grouped = turns.groupBy((F.col("conv_id") - F.col("conv_id") % family).alias("base")).agg(F.sort_array(F.collect_list(F.struct("turn", "digest", "n_bytes", "conv_id"))).alias("turns"))
    each = grouped.withColumn("conv_id", F.explode(F.array_distinct(F.transform("turns", lambda t: t["conv_id"]))))
    head = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    own = lambda c: F.filter("turns", lambda t: t["conv_id"] == F.col(c))
    built = each.withColumn("head", head.cast("int")).select("conv_id", F.concat(F.slice(own("base"), 1, F.col("head")), F.slice(own("conv_id"), F.col("head") + 1, F.greatest(F.size("turns"), F.lit(1)))).alias("built"))
    return built.select("conv_id", *path_of(F.col("built")))


def shared(a: bytes, b: bytes, known: int = 0) -> int:
    """The number of turns that two paths share, known of them being equal already."""
    at, end = known * DIGEST, min(len(a), len(b))
    while at < end and a[at : at + DIGEST] == b[at : at + DIGEST]:
        at += DIGEST
    return at // DIGEST


def sorted_run(items: list[Item]) -> list[tuple[int, Item]]:
    """The items in order, each with the turns that it shares with the one before."""
    items.sort(key=lambda x: (x[0], x[1]))
    return [(shared(items[i - 1][0], x[0]) if i else 0, x) for i, x in enumerate(items)]


def merged(runs: list[list[tuple[int, Item]]]) -> Iterator[tuple[int, Item]]:
    """The items of all runs in order, each with the turns that it shares with the one before, by a loser tree."""
    width = 1
    while width < len(runs):
        width *= 2
    heads: list = [iter(r) for r in runs] + [iter(())] * (width - len(runs))
    now: list = [next(h, None) for h in heads]  # (turns shared with the last output, item), or None at a run's end

    def play(i: int, j: int) -> tuple[int, int]:
        """(winner, loser) of two runs; the loser's LCP becomes the one with the winner."""
        x, y = now[i], now[j]
        if x is None or y is None:
            return (j, i) if x is None else (i, j)
        if x[0] != y[0]:
            return (i, j) if x[0] > y[0] else (j, i)
        k = shared(x[1][0], y[1][0], x[0])
        won, lost = (i, j) if (x[1][0][k * DIGEST :], x[1][1]) <= (y[1][0][k * DIGEST :], y[1][1]) else (j, i)
        now[lost] = (k, now[lost][1])
        return won, lost

    losers = [0] * width

    def build(node: int) -> int:
        if node >= width:
            return node - width
        won, losers[node] = play(build(2 * node), build(2 * node + 1))
        return won

    top = build(1)
    while now[top] is not None:
        yield now[top]
        now[top] = next(heads[top], None)
        node = (top + width) // 2
        while node:
            top, losers[node] = play(top, losers[node])
            node //= 2


class Node:
    """An open node: its members so far, and sums over the finished nodes below it."""

    __slots__ = ("depth", "size", "n_convs", "least", "children", "leaves", "saved", "key", "parent_key", "ends", "digest", "waiting")

    def __init__(self, depth: int, size: int, key, parent_key: bytes | None) -> None:
        self.depth, self.size, self.key, self.parent_key = depth, size, key, parent_key
        self.n_convs = self.children = self.leaves = self.saved = self.ends = 0
        self.least: int | None = None
        self.digest, self.waiting = hashlib.sha256(), []

    def end(self, conv_id: int) -> None:
        self.digest.update(f"{',' if self.ends else ''}{conv_id}".encode())
        self.ends += 1
        self.n_convs += 1
        self.least = conv_id if self.least is None else min(self.least, conv_id)

    def close(self) -> None:
        self.leaves += not self.children
        self.saved += (self.n_convs - 1) * self.size

    def take(self, child: Node) -> None:
        self.n_convs += child.n_convs
        self.least = child.least if self.least is None else min(self.least, child.least)
        self.children, self.leaves, self.saved = self.children + 1, self.leaves + child.leaves, self.saved + child.saved


#: What a range tells: kind 0 a finished node, 1 a part of an open node, 2 a chunk of ids that end in an open node, 3 its
#: first and last path.
FIELDS = "kind int, part int, key binary, parent_key binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, size long, ends string, seq long, first binary, last binary, sizes array<long>"
ARROW = pa.schema(
    [("kind", pa.int32()), ("part", pa.int32()), ("key", pa.binary()), ("parent_key", pa.binary()), *((n, pa.int64()) for n in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "size")), ("ends", pa.string()), ("seq", pa.int64()), ("first", pa.binary()), ("last", pa.binary()), ("sizes", pa.list_(pa.int64()))]
)


def range_nodes(stream: Iterable[tuple[int, Item]], first: bytes, last: bytes, part: int) -> Iterator[dict]:
    """The rows of FIELDS for the merged stream of a range whose first and last path are known.

    Only nodes on the first or last path have a key. A finished node waits at its parent until that is finished too, as a node
    names its parent's least conversation; one right below a node with a key names that by its key, and doesn't wait.
    """
    edge = lambda path, depth: path[: depth * DIGEST] in (first[: depth * DIGEST], last[: depth * DIGEST])
    keyed = hashlib.md5()
    stack = [Node(0, 0, keyed, None)]
    chunk, seq = array("q"), 0
    last_sizes: list[int] = []

    def row(node: Node, kind: int) -> dict:
        return {"kind": kind, "part": part, "conv_id": node.least, "depth": node.depth, "n_convs": node.n_convs, "n_children": node.children, "n_leaves": node.leaves, "saved_tokens": node.saved, "size": node.size}

    def close(path: bytes) -> Iterator[dict]:
        node = stack.pop()
        node.close()
        if stack:
            stack[-1].take(node)
        if node.key:
            yield row(node, 1) | {"key": node.key.digest(), "parent_key": node.parent_key}
            return
        for child in node.waiting:
            yield child | {"parent_conv_id": node.least}
        done, above = row(node, 0) | {"ends": node.digest.hexdigest()}, stack[-1]
        if above.key:
            yield done | {"parent_key": above.key.digest()}
        else:
            above.waiting.append(done)

    def flush(node: Node) -> Iterator[dict]:
        nonlocal seq
        if chunk:
            yield {"kind": 2, "part": part, "key": node.key.digest(), "seq": seq, "ends": ",".join(map(str, chunk))}
            seq += 1
            del chunk[:]

    before = b""
    for common_turns, (path, conv_id, sizes) in stream:
        if path != before:
            yield from flush(stack[-1])
        while len(stack) - 1 > common_turns:
            yield from close(before)
        for depth in range(len(stack), len(path) // DIGEST + 1):
            above, key = stack[-1], None
            if edge(path, depth):
                key = above.key.copy()
                key.update(path[(depth - 1) * DIGEST : depth * DIGEST])
            stack.append(Node(depth, sizes[depth - 1], key, above.key.digest() if key else None))
        if stack[-1].key:
            stack[-1].n_convs += 1
            stack[-1].least = conv_id if stack[-1].least is None else min(stack[-1].least, conv_id)
            chunk.append(conv_id)
            if len(chunk) >= CHUNK:
                yield from flush(stack[-1])
        else:
            stack[-1].end(conv_id)
        before, last_sizes = path, sizes
    yield from flush(stack[-1])
    while stack:
        yield from close(before)
    yield {"kind": 3, "part": part, "first": first, "last": last, "sizes": last_sizes}


def tables(rows: Iterable[dict]) -> Iterator[pa.RecordBatch]:
    held = []
    for r in rows:
        held.append(r)
        if len(held) == 8192:
            yield pa.RecordBatch.from_pylist(held, ARROW)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, ARROW)


def read_range(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorts and merges one range. Its place among the ranges is the number of its partition."""
    from pyspark import TaskContext

    runs = [sorted_run(list(zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True))) for batch in batches if batch.num_rows]
    if runs:
        order = lambda x: (x[1][0], x[1][1])
        first, last = min((r[0] for r in runs), key=order)[1][0], max((r[-1] for r in runs), key=order)[1][0]
        yield from tables(range_nodes(merged(runs), first, last, TaskContext.get().partitionId()))


def key_at(path: bytes, depths: int) -> list[bytes]:
    """The keys of a path's nodes down to a depth."""
    key, out = hashlib.md5(), []
    out.append(key.digest())
    for d in range(depths):
        key.update(path[d * DIGEST : (d + 1) * DIGEST])
        out.append(key.digest())
    return out


def overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each pair of neighbouring ranges (last, first, sizes): what the nodes that both hold have counted too much."""
    for batch in batches:
        for r in batch.to_pylist():
            depth = shared(r["last"], r["first"])
            ends_here, spared = len(r["last"]) // DIGEST == depth, 0
            rows = []
            keys = key_at(r["last"], depth)
            for d in range(depth, -1, -1):
                spared += r["sizes"][d - 1] if d else 0
                rows.append({"key": keys[d], "n_children": -1 if d < depth else 0, "n_leaves": -1 if ends_here else 0, "saved_tokens": spared})
            yield from (pa.RecordBatch.from_pylist(rows[i : i + 8192], OVERLAP) for i in range(0, len(rows), 8192))


OVERLAP = pa.schema([("key", pa.binary()), ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64())])


def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the chunks of each key, which come together and in order."""
    key, state, done = None, None, []
    for batch in batches:
        for k, ends in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if k != key:
                if key is not None:
                    done.append({"key": key, "ends": state.hexdigest()})
                key, state = k, hashlib.sha256(ends.encode())
            else:
                state.update(b"," + ends.encode())
        if len(done) > 4096:
            yield pa.RecordBatch.from_pylist(done, DIGESTS)
            done = []
    if key is not None:
        done.append({"key": key, "ends": state.hexdigest()})
    if done:
        yield pa.RecordBatch.from_pylist(done, DIGESTS)


DIGESTS = pa.schema([("key", pa.binary()), ("ends", pa.string())])


def prefix_trie(made: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """The nodes of the trie of paths (conv_id, path, sizes): conv_id (the least member), depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens (bytes of the subtree's last texts that members beyond the first repeat) and
    ends_sha256 (of the ids of members that end in the node, ascending, comma-joined).
    """
    spark = made.sparkSession
    made = common.stored(made.select("conv_id", "path", "sizes"))
    total = made.agg(F.sum(F.octet_length("path").cast(LongType()) + 32)).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // part_bytes))
    ranges = made.select("path", "conv_id", "sizes").repartitionByRange(parts, "path", "conv_id")
    told = common.stored(ranges.mapInArrow(read_range, FIELDS))
    common.dropped(made)

    # one row for each range
    beside = Window.orderBy("part")
    pairs = told.where("kind = 3").select("last", "sizes", F.lead("first").over(beside).alias("first")).where("first is not null")
    taken = pairs.mapInArrow(overlaps, "key binary, n_children long, n_leaves long, saved_tokens long")
    counts = ["n_children", "n_leaves", "saved_tokens"]
    own = told.where("kind = 1").select("key", "parent_key", "conv_id", "depth", "n_convs", *counts)
    less = taken.select("key", F.lit(None).cast("binary").alias("parent_key"), F.lit(None).cast("long").alias("conv_id"), F.lit(None).cast("long").alias("depth"), F.lit(0).cast("long").alias("n_convs"), *counts)
    sums = own.union(less).groupBy("key").agg(F.max("parent_key").alias("parent_key"), F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), *(F.sum(c).alias(c) for c in ("n_convs", *counts)))
    chunks = told.where("kind = 2").select("key", "ends", "part", "seq").repartition("key").sortWithinPartitions("key", "part", "seq")
    ended = chunks.mapInArrow(digests, "key binary, ends string")
    open_nodes = common.stored(sums.join(ended, "key", "left").withColumn("ends", F.coalesce("ends", F.sha2(F.lit(b""), 256))))

    rest = ["n_convs", *counts, F.col("ends").alias("ends_sha256")]
    parents = open_nodes.select(F.col("key").alias("above"), F.col("conv_id").alias("above_id"))
    finished = told.where("kind = 0")
    inner = finished.where("parent_key is null").select("conv_id", "depth", "parent_conv_id", *rest)
    hung = finished.where("parent_key is not null").join(parents, F.col("parent_key") == F.col("above")).select("conv_id", "depth", F.col("above_id").alias("parent_conv_id"), *rest)
    opened = open_nodes.join(parents, F.col("parent_key") == F.col("above"), "left").select("conv_id", "depth", F.col("above_id").alias("parent_conv_id"), *rest)
    return inner.unionAll(hung).unionAll(opened)
