"""Prefix trie, periodic runs and near-duplicate vectors against brute force."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from framelake.llm import cover_tree, periodic_runs, prefix_trie, queries

SF = "/root/testdata/sf0.001"


# -- periodic runs


def brute_runs(w, least=12):
    found = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            a = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i > a and i + q - a >= max(least, 2 * q):
                found.setdefault((a, i + q), q)
            i += i == a
    return sorted((a, b - a, q) for (a, b), q in found.items())


def test_runs_equal_brute_force():
    r = random.Random(5)
    for _ in range(1500):
        n, k = r.randrange(70), r.choice([1, 2, 2, 3, 5])
        w = [r.randrange(k) for _ in range(n)]
        if r.random() < 0.5 and n > 10:
            a, p = r.randrange(n), r.randrange(1, 8)
            w = w[:a] + [w[a + i % p] if a + i % p < n else 0 for i in range(n - a)]
            if r.random() < 0.5:
                w[r.randrange(n)] = 9
        for least in (12, 4, 2):
            assert periodic_runs.runs_of(w, least) == brute_runs(w, least)
        assert periodic_runs.text_runs([str(x) for x in w]) == brute_runs(w)


def test_factors_are_longest_earlier_pieces():
    r = random.Random(6)
    for _ in range(200):
        w = [r.randrange(2) for _ in range(r.randrange(1, 40))]
        ends = 0
        for at, end, source in periodic_runs.lz_factors(w):
            assert at == ends
            longest = max((k for s in range(at) for k in range(len(w) - at + 1) if w[s : s + k] == w[at : at + k]), default=0)
            assert end - at == max(1, longest)
            if source >= 0:
                assert source < at and w[source : source + end - at] == w[at:end]
            ends = end
        assert ends == len(w)


def expected_runs(doc_id, text):
    words = [w for w in (text or "").translate({c: " " for c in range(9, 14)}).split(" ") if w]
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and words:
        n, g = len(words), h // 10
        a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(words)
    gone = {i for a, length, q in runs for i in range(a + q, a + length)}
    best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha("".join("%d,%d,%d\n" % x for x in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_runs_of_the_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = queries.op12_periodic_runs(spark, SF)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    short = {d.doc_id for d in docs if len((d.text or "").split()) < 1500}
    want = sorted((expected_runs(*d) for d in docs if d.doc_id in short), key=str)
    assert sorted((tuple(r) for r in got.collect() if r.doc_id in short), key=str) == want
    assert sum(r[1] > 0 for r in want) > 5


def test_runs_of_odd_rows(spark):
    text = "a b c\x1c d " * 9  # only blanks and tab to carriage return part words
    rows = [(1, None), (2, ""), (None, text), (3, text), (3, text), (4, "x " * 20000), (5, "p q r\t" * 4000 + "end"), (6, " ".join(map(str, range(20000))) + " y z" * 7)]
    docs = spark.createDataFrame([(*r, 0, 0) for r in rows], "doc_id long, text string, start long, period long")
    got = {(r.doc_id, r.n_runs): r for r in periodic_runs.periodic_runs(docs).collect()}
    assert got[1, 0].start is None and got[2, 0].collapsed_sha256 == hashlib.sha256(b"").hexdigest()
    assert (got[4, 1].length, got[4, 1].period, got[4, 1].exponent_milli) == (20000, 1, 20_000_000)
    assert (got[5, 1].length, got[5, 1].period) == (12000, 3) and (got[6, 1].start, got[6, 1].length) == (20000, 14)
    assert (got[3, 1].length, got[3, 1].period) == (27, 3) and (None, 1) in got
    assert periodic_runs.periodic_runs(docs).count() == len(rows) and periodic_runs.periodic_runs(docs.where("false")).count() == 0
    clean = {r.doc_id: r.text for r in periodic_runs.without_repeats(docs).collect()}
    assert clean[1] is None and clean[2] == "" and clean[4] == "x" and clean[5] == "p q r end" and clean[3] == "a b c\x1c d"


# -- prefix trie


def brute_trie(rows):
    convs = {}
    for c, t, r, x in rows:
        if c is not None:
            convs.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    convs = {c: [(r, x) for _, _, r, x in sorted(v, key=lambda y: y[:2])] for c, v in convs.items()}
    nodes, built, kids = {}, {}, {}
    for c in convs:
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = tuple(convs.get(c - c % 5, [])[:h] + convs[c][h:])
    for c, p in built.items():
        for d in range(len(p) + 1):
            nodes.setdefault(p[:d], []).append(c)
    for p in nodes:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    leaves, saved = dict.fromkeys(nodes, 0), dict.fromkeys(nodes, 0)
    for p, m in nodes.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in kids
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1].encode()) if p else 0
    ends = {p: sorted(c for c in m if built[c] == p) for p, m in nodes.items()}
    return sorted(((min(m), len(p), min(nodes[p[:-1]]) if p else None, len(m), len(kids.get(p, ())), leaves[p], saved[p], hashlib.sha256(",".join(map(str, ends[p])).encode()).hexdigest()) for p, m in nodes.items()), key=str)


def some_rows(r, n, hot):
    out = []
    for c in range(n):
        many = r.choice([1, 1, 2, 3, 5, 12])
        out += [(c, t or r.choice([0, None]), r.choice(["user", "bot", None]), r.choice(["x", "yy", "éé", None]) if r.random() > hot else "hot") for t in range(many)]
    r.shuffle(out)
    return out


@pytest.mark.parametrize("n,hot,parts,batch", [(0, 0, 3, 100), (1, 0, 2, 100), (7, 0, 16, 2), (250, 0.2, 5, 7), (400, 0.97, 40, 3), (150, 0.9, 1, 10)])
def test_trie_equals_brute_force(spark, n, hot, parts, batch):
    rows = some_rows(random.Random(n), n, hot)
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, path int")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = sorted((tuple(r) for r in prefix_trie.prefix_trie(prefix_trie.rebuilt_paths(df)).collect()), key=str)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == brute_trie(rows)


def test_merge_of_runs():
    r = random.Random(2)
    for k in (1, 2, 3, 5, 9):
        items = [(bytes(r.choice(b"ab") for _ in range(r.randrange(5))).replace(b"a", b"a" * 16).replace(b"b", b"b" * 16), i, []) for i in range(60)]
        runs = [prefix_trie.sorted_run(items[i::k]) for i in range(k)]
        merged = list(prefix_trie.merged(runs))
        assert [x for _, x in merged] == sorted(items, key=lambda x: x[:2])
        assert [n for n, _ in merged] == [0, *(prefix_trie.shared(a[1][0], b[1][0]) for a, b in zip(merged, merged[1:], strict=False))]


def test_trie_of_odd_rows(spark):
    rows = [(None, 0, "user", "lost"), (0, None, None, None), (1, 1, "user", "x" * 100_000), (2, 1, "user", "x" * 100_000), (3, 5, "", ""), *((7, t, "user", "same") for t in range(3000))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    plain = prefix_trie.prefix_trie(prefix_trie.paths(df)).collect()
    root = next(r for r in plain if r.depth == 0)
    assert (root.conv_id, root.parent_conv_id, root.n_convs, root.n_children, root.n_leaves, root.saved_tokens) == (0, None, 5, 3, 3, 100_000)
    assert max(r.depth for r in plain) == 3000 and len(plain) == 3003


def test_trie_of_the_conversations(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted((tuple(r) for r in queries.op11_prefix_trie(spark, SF).collect()), key=str) == brute_trie(rows)


# -- near-duplicate vectors


def brute_links(rows):
    """id: (links, component) for rows (id, vector) of distinct ids."""
    fine = {i: np.array(v, float) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    links = {i: set() for i, _ in rows}
    for i, v in fine.items():
        for j, w in fine.items():
            if i < j and len(v) == len(w) and v @ w / np.sqrt((v @ v) * (w @ w)) >= 0.9:
                links[i].add(j)
                links[j].add(i)
    comp = {}
    for i in sorted(links):
        todo = [i]
        while todo:
            if (j := todo.pop()) not in comp:
                comp[j] = i
                todo += links[j]
    return sorted((i, len(links[i]), comp[i], comp[i] == i) for i in links)


def vectors(seed, n, d, noise):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(max(1, n // 20), d))
    x = centres[r.integers(len(centres), size=n)] + noise * r.normal(size=(n, d)) * (r.random((n, 1)) < 0.8)
    return [(i, v.astype(np.float32).tolist()) for i, v in enumerate(x)]


@pytest.mark.parametrize("noise", [0.0, 0.02, 0.33, 5.0])
@pytest.mark.parametrize("d", [3, 32])
def test_comparison_of_blocks(noise, d):
    def side(rows, counts):
        x = cover_tree.unit(np.array([v for _, v in rows]))
        return cover_tree.Side(x, np.arange(len(x)), counts[: len(x)], cover_tree.Tree(x))

    r, rows = np.random.default_rng(3), vectors(4, 500, d, noise)
    counts = r.integers(1, 4, 500)
    one, two = side(rows[:180], counts), side(rows[180:], counts)
    for a, b in ((one, two), (one, one)):
        a.added[:] = b.added[:] = 0
        a.whole[:] = b.whole[:] = False
        edges = cover_tree.compare(a, b, 0.9)
        links = (a.x @ b.x.T) >= 0.9
        assert np.array_equal(np.cumsum(a.added[:-1]), links @ b.counts)
        i, j = np.nonzero(links)
        shift = 0 if a is b else len(a.ids)
        assert np.array_equal(cover_tree.labels(shift + len(b.ids), *edges), cover_tree.labels(shift + len(b.ids), i, j + shift))


def test_tree_covers():
    x = cover_tree.unit(np.array([v for _, v in vectors(9, 400, 8, 0.4)]))
    t = cover_tree.Tree(x)
    points = x[t.order]
    for node in range(t.inner):
        far = cover_tree.distance(points[t.low[node] : t.high[node]] @ points[t.low[node]])
        assert far.max() <= t.radius[node] + 1e-12
        below = t.kids[t.kids_at[node] : t.kids_at[node + 1]]
        assert sorted(i for k in below for i in range(t.low[k], t.high[k])) == list(range(t.low[node], t.high[node]))
        assert all(t.radius[k] < t.radius[node] for k in below if k < t.inner)


@pytest.mark.parametrize("kind,noise,cells", [("float", 0.2, 4), ("double", 0.33, 256), ("float", 3.0, 1)])
def test_links_equal_brute_force(spark, kind, noise, cells):
    rows = vectors(7, 300, 12, noise)
    rows += [(1000 + i, rows[5][1]) for i in range(120)] + [(2000, [3 * v for v in rows[5][1]])]  # a hot vector, and a longer one
    rows += [(3000, None), (3001, []), (3002, [0.0] * 12), (3003, [1.0] * 11 + [None]), (3004, [1.0] * 11 + [float("nan")]), (3005, [float("inf")] * 12), (3006, rows[5][1][:11]), (3007, rows[5][1][:11]), (3008, [1.0])]
    df = spark.createDataFrame([(*r, 0) for r in rows], f"vec_id long, embedding array<{kind}>, n_links int").repartition(5)
    got = cover_tree.near_duplicates(df, least_block=40, cells=cells)
    assert sorted(tuple(r) for r in got.collect()) == brute_links(rows)


def test_vectors_without_rows_or_ids(spark):
    df = spark.createDataFrame([(None, [1.0, 2.0]), (4, [1.0, 2.0]), (4, [1.0, 2.0]), (4, [2.0, 1.9])], "vec_id long, embedding array<float>")
    got = sorted(map(tuple, cover_tree.near_duplicates(df).collect()), key=str)
    assert got == [(4, 2, 4, True), (4, 2, 4, True), (4, 2, 4, True), (None, 0, None, False)]
    assert cover_tree.near_duplicates(df.where("false")).count() == 0


def test_links_of_the_embeddings(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assert sorted(tuple(r) for r in queries.op13_cover_tree(spark, SF).collect()) == brute_links(rows)


def directions(n, d, seed, common=0.0):
    r = np.random.default_rng(seed)
    return cover_tree.unit(r.standard_normal((n, d)) + common * np.ones(d))


def test_levels_that_gather_little_are_left_out():
    """On independent directions nodes of large radius bounded nothing, and were opened with most points."""
    x = directions(3000, 64, 1)
    x[2500:] = cover_tree.unit(x[:500] + 0.01 * x[500:1000])
    tree = cover_tree.Tree(x)
    assert tree.inner > 1 and tree.radius[1:].max() <= cover_tree.LEAP + 1e-6
    tight = cover_tree.Tree(cover_tree.unit(np.repeat(directions(6, 24, 2), 200, axis=0) + 0.05 * directions(1200, 24, 3)))
    assert len(tight.tops(100)) >= 6  # levels that gather are made


@pytest.mark.parametrize("d,common", [(64, 0.0), (64, 1.5), (17, 0.0), (5, 0.3)])
def test_products_bounded_by_heads_equal_all_products(monkeypatch, d, common):
    monkeypatch.setattr(cover_tree, "TILE", (50, 70))
    x, y = directions(230, d, 4, common), directions(300, d, 5, common)
    y[:40] = cover_tree.unit(x[:40] + 0.3 * directions(40, d, 6))
    a, b, product = x.astype(np.float32), y.astype(np.float32), x @ y.T
    assert (cover_tree.heads(x).astype(float) @ cover_tree.heads(y).T >= product - cover_tree.SLACK32).all()
    for least in (0.9, 0.97, 0.2, -1.0):
        found = {(i, j): v for p in cover_tree.over(a, b, cover_tree.heads(x), cover_tree.heads(y), least) for i, j, v in zip(*(c.tolist() for c in p), strict=True)}
        assert set(zip(*(c.tolist() for c in np.nonzero(product >= least)), strict=True)) <= set(found)
        assert all(abs(v - product[p]) < cover_tree.SLACK32 for p, v in found.items())


def test_blocks_keep_their_tree():
    x = directions(500, 20, 7)
    x[300:] = cover_tree.unit(x[:200] + 0.02 * directions(200, 20, 8))
    table = pa.table({"node": pa.array(np.random.default_rng(9).permutation(500)), "n": pa.array(np.arange(1, 501)), "vector": pa.array(x.astype(np.float32).tolist(), pa.list_(pa.float32()))})
    side = cover_tree.opened(cover_tree.packed("s", table).to_pylist()[0], 4)
    node = table["node"].to_numpy()
    assert sorted(zip(side.ids.tolist(), side.counts.tolist(), strict=True)) == sorted(zip(node.tolist(), range(1, 501), strict=True))
    assert np.abs(side.x - x[np.argsort(node)][side.ids]).max() < 1e-6
    t = side.tree
    for k in range(t.inner):
        assert cover_tree.distance(side.x[t.low[k] : t.high[k]] @ side.x[t.low[k]]).max() <= t.radius[k] + cover_tree.SLACK
        below = t.kids[t.kids_at[k] : t.kids_at[k + 1]]
        assert sorted(i for c in below for i in range(t.low[c], t.high[c])) == list(range(t.low[k], t.high[k]))
