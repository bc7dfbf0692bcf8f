"""Near-duplicate vectors by dual traversal of cover trees: all pairs with a cosine of at least a threshold.

On unit vectors the cosine bounds the distance d: cosine >= c is d <= t = sqrt(2 - 2c). A cover tree has nested levels of
centres with halving radii; a node knows the largest distance of its points to its centre. For two nodes with radii r and s
and centres d apart: if d > t + r + s no pair of their points links, and if d + r + s <= t all do, so that both are
decided without looking at the points. Other pairs are replaced by the pairs of their children; points are compared in
double precision. Nothing is approximate. Levels that gather few points, which bound nothing, are left out down to LEAP.

* Products are bounded first: turned by one fixed rotation, a vector is a head of half the dimensions and a tail, and
  x.y is at most the product of the heads plus that of the tails' lengths. Only pairs that this leaves are multiplied out.

* Equal vectors are one class, which counts as often as it has rows.
* The upper levels are the cover tree of at most SAMPLE classes, cut where it has up to CELLS nodes. Every class goes
  to the nearest of these cells; the cells' radii are those of all their classes. Pairs of cells that the bound rules out are never brought together.
* Each cell is cut into blocks by hash, so that a hot cell is many blocks; a task makes a block's own tree and packs
  both as one row. A task for each pair of blocks left walks both trees. Children are compared by one matrix product for a
  node and all nodes it is still open with.
* A task returns one row for each class that has a link there: how many rows it links with, and the least class
  that it is connected with within the two blocks. So a group is never expanded into its pairs. Sums give n_links, and the
  distributed components of these few edges give component_id.

Cost: the trees prune as far as the vectors cluster. Independent directions in many dimensions are all about as far from
each other, whatever the tree: then the heads of all classes are multiplied, quadratic in classes. Blocks
grow with the table up to BLOCK_BYTES, so what is shuffled is classes * (number of blocks), and memory is bounded.

Vectors that are null, empty or zero, or hold null or non-finite components, and rows without vec_id link with nothing;
vectors of different lengths don't link; rows that share an id are vectors of their own; an empty table gives an empty
table; other columns are not read.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .components import components

#: Classes that the upper levels are made from, and the most cells.
SAMPLE, CELLS = 2048, 256
#: Blocks that a table is cut into while they hold at least LEAST_BLOCK vectors; no block is longer than BLOCK_BYTES.
BLOCKS, LEAST_BLOCK, BLOCK_BYTES = 8, 2048, 32 << 20
#: Tasks that pairs of blocks are dealt to, two for each as far as this goes, so that few tasks have many.
MOST_TASKS = 4096
#: Points of a node that isn't split any more, and the radius below which none is.
FEW, FINE = 8, 2.0**-6
#: Levels of larger radius are made only if they gather half of so many points.
LEAP, TRIED = 0.25, 1024
#: What rounding may add to a distance or a float product.
SLACK, SLACK32 = 1e-7, 1e-5
#: Numbers of a matrix that is made at a time.
CELL_COUNT = 1 << 21
#: Heads that are multiplied at a time, vectors of fewer dimensions have none, and the least product for which they are worth it.
TILE, FEW_DIMENSIONS, WORTH = (256, 1024), 16, 0.6


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one, in double precision; scaled first, so that no square overflows or vanishes."""
    x = x.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def distance(cosine: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * cosine))


@functools.lru_cache(maxsize=8)
def rotation(size: int) -> np.ndarray:
    return np.linalg.qr(np.random.default_rng(size).standard_normal((size, size)))[0]


def heads(x: np.ndarray) -> np.ndarray:
    """Unit vectors of half the dimensions, the last of which holds the length of all others: no product is less than that of the vectors."""
    size = x.shape[1]
    if size < FEW_DIMENSIONS:
        return x.astype(np.float32)
    turned = x.astype(np.float64) @ rotation(size)
    tail = turned[:, size // 2 - 1 :]
    return np.concatenate((turned[:, : size // 2 - 1], np.sqrt(np.einsum("ij,ij->i", tail, tail))[:, None]), axis=1).astype(np.float32)


def over(x: np.ndarray, y: np.ndarray, head_x: np.ndarray, head_y: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs of rows (i, j) of float vectors whose product may be `least` or more, and their float products."""
    rows, columns = TILE
    cut, brief = np.float32(least - SLACK32), least >= WORTH and head_x.shape[1] < x.shape[1]
    for i in range(0, len(x), rows):
        for j in range(0, len(y), columns):
            a, b = x[i : i + rows], y[j : j + columns]
            if brief:
                c = head_x[i : i + rows] @ head_y[j : j + columns].T
                at = np.flatnonzero((c >= cut).ravel())
            if not brief or 64 * len(at) > c.size:
                c = a @ b.T
                at = np.flatnonzero((c >= cut).ravel())
                m, n = np.divmod(at, len(b))
                value = c.ravel()[at]
            else:
                m, n = np.divmod(at, len(b))
                value = np.einsum("ij,ij->i", a[m], b[n])
            if len(at):
                yield m + i, n + j, value


def cover(x: np.ndarray, radius: float) -> np.ndarray:
    """For each row of x the row that is its centre: rows within the radius of an earlier centre are covered, others become one."""
    cut, n, step = 1 - radius * radius / 2, len(x), 512
    centre, head = np.empty(n, np.int64), heads(x)
    places, known = np.empty(n, np.int64), 0
    seen, seen_head, brief = np.empty_like(x), np.empty_like(head), cut >= WORTH
    for low in range(0, n, step):
        part = x[low : low + step]
        best, where = np.full(len(part), -2.0, x.dtype), np.zeros(len(part), np.int64)
        for at in range(0, known, TILE[1]):
            y, rows = slice(at, min(at + TILE[1], known)), np.arange(len(part))
            if brief:
                rows = np.flatnonzero((head[low : low + step] @ seen_head[y].T).max(axis=1) >= cut - SLACK32)
            if len(rows):
                c = part[rows] @ seen[y].T
                near = c.argmax(axis=1)
                value = c[np.arange(len(rows)), near]
                better = value > best[rows]
                where[rows[better]], best[rows[better]] = places[at + near[better]], value[better]
        own = part @ part.T
        for i in np.flatnonzero(best < cut):
            if best[i] < cut or i + low == 0:
                nearer = own[i] > best
                nearer[:i] &= best[:i] < cut  # rows before it keep the centre that covers them
                nearer[i] = True
                where[nearer], best[nearer] = low + i, own[i][nearer]
                best[i] = 2.0
                places[known], seen[known], seen_head[known], known = low + i, part[i], head[low + i], known + 1
        centre[low : low + step] = where
    return centre


class Tree:
    """A cover tree of unit vectors. Inner nodes come first, then the points, in the order in which nodes hold them as ranges."""

    def __init__(self, x: np.ndarray) -> None:
        n, small = len(x), x.astype(np.float32)
        order = np.arange(n)
        radius, low, high, kids = [self.reach(x, order)], [0], [n], [[]]
        todo = [0]
        while todo:
            node = todo.pop()
            a, b, r = low[node], high[node], radius[node]
            points = order[a:b]
            if b - a <= FEW or r <= FINE:
                kids[node] = list(range(-a - 1, -b - 1, -1))
                continue
            centre = cover(small[points], self.following(small[points[:: -(-len(points) // TRIED)]], r))
            by = np.lexsort((centre != np.arange(len(points)), centre))
            order[a:b] = points[by]
            starts = np.flatnonzero(np.diff(centre[by], prepend=-1))
            sizes = np.diff(starts, append=len(points))
            kids[node] = (-(a + starts[sizes == 1]) - 1).tolist()
            for s, k in zip((a + starts[sizes > 1]).tolist(), sizes[sizes > 1].tolist(), strict=True):
                kids[node].append(len(radius))
                todo.append(len(radius))
                radius.append(self.reach(x, order[s : s + k]))
                low.append(s)
                high.append(s + k)
                kids.append([])
        self.order = order
        self.inner = len(radius)
        self.radius = np.concatenate((np.array(radius), np.zeros(n)))
        self.low = np.concatenate((np.array(low, np.int64), np.arange(n)))
        self.high = np.concatenate((np.array(high, np.int64), np.arange(1, n + 1)))
        flat = np.array([k if k >= 0 else self.inner - k - 1 for ks in kids for k in ks], np.int64)
        self.kids, self.kids_at = flat, np.concatenate(([0], np.cumsum([len(k) for k in kids]))).astype(np.int64)

    @classmethod
    def of(cls, radius: np.ndarray, low: np.ndarray, high: np.ndarray, kids: np.ndarray, kids_at: np.ndarray) -> Tree:
        """The tree of points in tree order, of what parts() gave."""
        t, n = cls.__new__(cls), int(high[0])
        t.order, t.inner = np.arange(n), len(radius)
        t.radius, t.low, t.high = np.concatenate((radius, np.zeros(n))), np.concatenate((low, t.order)), np.concatenate((high, t.order + 1))
        t.kids, t.kids_at = kids.astype(np.int64), kids_at
        return t

    def parts(self) -> tuple[np.ndarray, ...]:
        return self.radius[: self.inner], self.low[: self.inner], self.high[: self.inner], self.kids.astype(np.int32), self.kids_at

    @staticmethod
    def following(some: np.ndarray, radius: float) -> float:
        """The radius of the level below: the next power of two that gathers half of some points, or LEAP, or less."""
        r = 2.0 ** (math.ceil(math.log2(radius)) - 1)
        while r > LEAP and 2 * len(np.unique(cover(some, r))) > len(some):
            r /= 2
        return r

    @staticmethod
    def reach(x: np.ndarray, points: np.ndarray) -> float:
        return float(distance(x[points] @ x[points[0]]).max())

    def below(self, nodes: np.ndarray) -> np.ndarray:
        """The children of inner nodes; points stand for themselves."""
        inner = nodes[nodes < self.inner]
        return np.concatenate([self.kids[self.kids_at[k] : self.kids_at[k + 1]] for k in inner.tolist()] + [nodes[nodes >= self.inner]])

    def tops(self, most: int) -> np.ndarray:
        """The points that are centres of the deepest level with at most so many nodes."""
        level = np.array([0])
        while len(following := self.below(level)) <= most and not np.array_equal(following, level):
            level = following
        return self.order[self.low[level]]


class Side:
    """A block in a comparison: its tree, points in tree order, and how many rows each stands for."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, counts: np.ndarray, tree: Tree) -> None:
        self.tree, self.x, self.ids, self.counts = tree, x[tree.order], ids[tree.order], counts[tree.order]
        self.small, self.head = self.x.astype(np.float32), heads(self.x)
        self.sums = np.concatenate(([0], np.cumsum(self.counts)))
        self.added = np.zeros(len(ids) + 1, np.int64)
        self.whole = np.zeros(len(tree.radius), bool)

    def link(self, nodes: np.ndarray, other: Side, theirs: np.ndarray) -> None:
        rows = other.sums[other.tree.high[theirs]] - other.sums[other.tree.low[theirs]]
        np.add.at(self.added, self.tree.low[nodes], rows)
        np.add.at(self.added, self.tree.high[nodes], -rows)
        self.whole[nodes] = True

    def chains(self) -> tuple[np.ndarray, np.ndarray]:
        """Edges that connect all points of each whole node."""
        t, inner = self.tree, np.flatnonzero(self.whole[: self.tree.inner])
        sizes = t.high[inner] - t.low[inner]
        order = np.argsort(-sizes, kind="stable")
        seen, a, b = np.zeros(len(self.ids), bool), [], []
        for node in inner[order].tolist():
            if not seen[t.low[node] : t.high[node]].all():
                seen[t.low[node] : t.high[node]] = True
                b.append(np.arange(t.low[node], t.high[node]))
                a.append(np.full(len(b[-1]), t.low[node]))
        return (np.concatenate(a), np.concatenate(b)) if a else (np.empty(0, np.int64), np.empty(0, np.int64))


def labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least node connected with each of n nodes."""
    label = np.arange(n)
    while len(a):
        x, y = label[a], label[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(label, following := label[label]):
            label = following
    return label


def compare(one: Side, two: Side, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Links of two blocks, or within one (one is two): adds up their rows' counts, and returns edges between nodes of
    both (the second's behind the first's) that connect what links connect.
    """
    t, same = math.sqrt(2 - 2 * cosine), one is two
    a_edges: list[np.ndarray] = []
    b_edges: list[np.ndarray] = []

    def settle(a: np.ndarray, b: np.ndarray) -> None:
        """All pairs of points of nodes a and b link."""
        one.link(a, two, b)
        if not same:
            two.link(b, one, a)
        two.whole[b] = True
        a_edges.append(one.tree.low[a])
        b_edges.append(two.tree.low[b])

    def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which pairs of points link, in double precision."""
        a, b, value = one.tree.low[a], two.tree.low[b], np.empty(len(a))
        step = max(1, (CELL_COUNT << 1) // one.x.shape[1])
        for i in range(0, len(a), step):
            value[i : i + step] = np.einsum("ij,ij->i", one.x[a[i : i + step]], two.x[b[i : i + step]])
        return value >= cosine

    def visit(nodes: np.ndarray, others: np.ndarray) -> None:
        """Decides all pairs of children of the nodes and of the others, points by points and nodes by nodes."""
        mine, theirs = one.tree.below(nodes), two.tree.below(others)
        for left in (mine[mine >= one.tree.inner], mine[mine < one.tree.inner]):
            for right in (theirs[theirs >= two.tree.inner], theirs[theirs < two.tree.inner]):
                if len(left) and len(right):
                    points = left[0] >= one.tree.inner and right[0] >= two.tree.inner
                    step = len(left) if points else max(1, CELL_COUNT // len(right))
                    for i in range(0, len(left), step):
                        decide(left[i : i + step], right, points)

    def decide(left: np.ndarray, right: np.ndarray, points: bool) -> None:
        i, j = one.tree.low[left], two.tree.low[right]
        # what is further apart than this neither links nor is open
        far = min(2.0, t + one.tree.radius[left].max() + two.tree.radius[right].max() + 2 * SLACK)
        known = over(one.small[i], two.small[j], one.head[i], two.head[j], cosine if points else 1 - far * far / 2 - SLACK32)
        if points:
            for x, y, _ in known:
                linked = exact(left[x], right[y])
                settle(left[x][linked], right[y][linked])
            return
        found = list(known)
        x, y, c = (np.concatenate(part) for part in zip(*found, strict=True)) if found else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.float32))
        both = one.tree.radius[left[x]] + two.tree.radius[right[y]]
        linked = distance(c - SLACK32) + both + SLACK <= t
        settle(left[x[linked]], right[y[linked]])
        still = ~linked & (distance(c + SLACK32) <= t + both + SLACK)
        order = np.argsort(x[still], kind="stable")
        a, b = left[x[still][order]], right[y[still][order]]
        if left[0] < one.tree.inner:
            for at in np.split(np.arange(len(a)), np.flatnonzero(np.diff(a)) + 1):
                if len(at):
                    visit(a[at[:1]], b[at])
        else:  # points with nodes: a node and all points that it is open with
            order = np.argsort(b, kind="stable")
            for at in np.split(order, np.flatnonzero(np.diff(b[order])) + 1):
                if len(at):
                    visit(a[at], b[at[:1]])

    root = np.array([0])
    decide(root, root, False)
    shift = 0 if same else len(one.ids)
    ends = [(np.concatenate(a_edges), np.concatenate(b_edges) + shift), one.chains()] + ([] if same else [tuple(e + shift for e in two.chains())])
    return np.concatenate([e[0] for e in ends]), np.concatenate([e[1] for e in ends])


PARTS = {"radius": np.float64, "low": np.int64, "high": np.int64, "kids": np.int32, "kids_at": np.int64}
BLOCK = "slot string, dim int, ids binary, counts binary, vectors binary, " + ", ".join(f"{c} binary" for c in PARTS)


def packed(slot: str, table: pa.Table) -> pa.Table:
    """A block as one row: its classes and vectors, of length one, in the order of its tree, and the tree."""
    size = len(table["vector"].combine_chunks()[0])
    x = unit(table["vector"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, size))
    x = x.astype(table["vector"].type.value_type.to_pandas_dtype())
    ids, counts = (table[c].to_numpy().astype(np.int64) for c in ("node", "n"))
    order = np.argsort(ids)
    tree = Tree(unit(x[order]))
    order = order[tree.order]
    row = {"slot": [slot], "dim": pa.array([size], pa.int32()), "ids": [ids[order].tobytes()], "counts": [counts[order].tobytes()], "vectors": [x[order].tobytes()]}
    return pa.table(row | {c: [part.tobytes()] for c, part in zip(PARTS, tree.parts(), strict=True)})


def opened(row: dict, width: int) -> Side:
    x = unit(np.frombuffer(row["vectors"], np.float32 if width == 4 else np.float64).reshape(-1, row["dim"]))
    tree = Tree.of(*(np.frombuffer(row[c], kind) for c, kind in PARTS.items()))
    return Side(x, np.frombuffer(row["ids"], np.int64), np.frombuffer(row["counts"], np.int64), tree)


def valid(id_col: str, e: Column) -> Column:
    """Whether a row can link."""
    finite = F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce(F.col(id_col).isNotNull() & finite & F.exists(e, lambda v: v != 0), F.lit(False))


def cells_of(sample: list, most: int) -> dict[int, np.ndarray]:
    """By length of the vectors: the centres of the upper levels."""
    by: dict[int, list] = {}
    for v in sample:
        by.setdefault(len(v), []).append(v)
    out = {}
    for size, vectors in by.items():
        x = unit(np.array(vectors))
        out[size] = x[Tree(x).tops(most)]
    return out


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = 0.9, least_block: int = LEAST_BLOCK, cells: int = CELLS) -> DataFrame:
    """Per row: the id, n_links (other rows with a cosine of at least the threshold), component_id (the least id that links
    reach) and kept (whether that is the row itself). Ids are integers.
    """
    spark = vectors.sparkSession
    kind = vectors.schema[vector_col].dataType.elementType.simpleString()
    width = 4 if kind == "float" else 8
    element = "float" if width == 4 else "double"
    e = F.col(vector_col).cast(f"array<{element}>")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), e.alias("vector"), valid(id_col, e).alias("ok"))
    rows = rows.withColumns({"h1": F.xxhash64("vector"), "h2": F.xxhash64(F.lit(1), "vector")})
    classes = common.stored(rows.where("ok").groupBy("h1", "h2").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"), F.first("vector").alias("vector")).withColumn("node", F.monotonically_increasing_id()))

    sample = [r[0] for r in classes.orderBy(F.xxhash64("h1"), "h1").limit(SAMPLE).select("vector").collect()]
    centres = cells_of(sample, cells)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each class with its cell, the nearest centre, and the distance to that."""
        for batch in batches:
            sizes = np.diff(batch.column(2).offsets.to_numpy())
            cell, far = np.zeros(len(sizes), np.int32), np.zeros(len(sizes))
            for size in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == size)
                x = unit(batch.column(2).take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(-1, size))
                c = x @ centres.get(size, np.eye(1, size)).T
                cell[at], far[at] = c.argmax(axis=1), distance(c.max(axis=1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sizes, pa.int32()), pa.array(cell), pa.array(far)], ["node", "n", "vector", "dim", "cell", "far"])

    held = common.stored(classes.select("node", "n", "vector").mapInArrow(placed, f"node long, n long, vector array<{element}>, dim int, cell int, far double"))
    # one row for each cell: at most `cells` for each length of vectors
    known = held.groupBy("dim", "cell").agg(F.count(F.lit(1)).alias("k"), F.max("far").alias("r")).collect()
    total: dict[int, int] = {}
    for c in known:
        total[c["dim"]] = total.get(c["dim"], 0) + c["k"]
    block = lambda c: min(max(least_block, -(-total[c["dim"]] // BLOCKS)), max(1, BLOCK_BYTES // (width * c["dim"])))
    cut = {(c["dim"], c["cell"]): (-(-c["k"] // block(c)), c["r"]) for c in known}
    t = math.sqrt(2 - 2 * cosine)
    pairs, by_dim = [], {}
    for dim, cell in sorted(cut):
        by_dim.setdefault(dim, []).append(cell)
    for dim, own in by_dim.items():
        points = centres.get(dim, np.eye(1, dim))
        for i, c in enumerate(own):
            far = distance(points[own[i:]] @ points[c])
            pairs += [(dim, c, d, cut[dim, c][0], cut[dim, d][0]) for d, f in zip(own[i:], far.tolist(), strict=True) if f <= t + cut[dim, c][1] + cut[dim, d][1] + SLACK]

    slot = lambda cell, part: F.concat_ws(".", "dim", cell, part)
    counts = spark.createDataFrame([(d, c, k) for (d, c), (k, _) in cut.items()], "dim int, cell int, k int")
    dealt = held.join(counts, ["dim", "cell"]).withColumn("slot", slot("cell", F.pmod(F.xxhash64("node"), "k")))
    blocks = common.stored(dealt.select("slot", "node", "n", "vector").groupBy("slot").applyInArrow(lambda key, table: packed(key[0].as_py(), table), BLOCK))
    near = spark.createDataFrame(pairs, "dim int, a int, b int, ka int, kb int")
    near = near.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("ka") - 1))).withColumn("j", F.explode(F.sequence(F.when(F.col("a") == F.col("b"), F.col("i")).otherwise(F.lit(0)), F.col("kb") - 1)))
    near = near.select(slot("a", "i").alias("x"), slot("b", "j").alias("y"))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(MOST_TASKS, 2 * sum(ka * kb for *_, ka, kb in pairs)))
    sides = near.select("x", "y", F.explode(F.array_distinct(F.array("x", "y"))).alias("slot"))

    def linked(key: tuple, table: pa.Table) -> pa.Table:
        two = sorted(table.to_pylist(), key=lambda r: r["slot"] != key[0].as_py())
        if key[0].as_py() != key[1].as_py() and len(two) < 2:  # by chance no class fell into one of the blocks
            two = []
        known = [opened(r, width) for r in two]
        out = []
        if known:
            a, b = compare(known[0], known[-1], cosine)
            ids = np.concatenate([s.ids for s in known])
            order = np.argsort(ids, kind="stable")
            rank = np.empty(len(ids), np.int64)
            rank[order] = np.arange(len(ids))
            least = ids[order[labels(len(ids), rank[a], rank[b])[rank]]]
            n = np.concatenate([np.cumsum(s.added[:-1]) for s in known])
            some = n > 0
            out = [ids[some], n[some], least[some]]
        return pa.table(dict(zip(("node", "n", "least"), (pa.array(c, pa.int64()) for c in out or ([],) * 3), strict=True)))

    found = common.stored(sides.join(blocks, "slot").repartition(tasks, "x", "y").groupBy("x", "y").applyInArrow(linked, "node long, n long, least long"))
    joined = components(found.where("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b")).distinct())
    # the links of a class hold its own rows, and so the row itself
    links = found.groupBy("node").agg((F.sum("n") - 1).alias("n_links"))
    placed_classes = common.stored(classes.select("node", "h1", "h2", "id").join(links, "node").join(joined, "node", "left").withColumn("component", F.coalesce("component", "node")))
    least = placed_classes.groupBy("component").agg(F.min("id").alias("component_id"))
    judged = placed_classes.join(least, "component").select("h1", "h2", "n_links", "component_id")
    able = rows.where("ok").select("id", "h1", "h2").join(judged, ["h1", "h2"]).select("id", "n_links", "component_id")
    alone = rows.where("not ok").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = common.stored(able.union(alone).select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept")))
    common.dropped(classes, held, blocks, found, joined, placed_classes)
    return out
