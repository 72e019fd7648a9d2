"""Operators on embeddings against brute force, and the rows that they must take."""

import hashlib

import numpy as np
import pytest

from stockroom.llm import centroids, cover_tree, near_vectors, queries, whitening

SCHEMA = "vec_id bigint, embedding array<float>, label int, component string, key string, block int, cell int"
EXTRA = (1, "x", "y", 2, 3)


def table(spark, rows, schema=SCHEMA):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], *EXTRA) for i, v in rows], schema)


def edge_rows(width):
    rnd = np.random.default_rng(5)
    base = rnd.standard_normal((12, width)).round(3)
    rows = [(k, base[k].tolist()) for k in range(12)]
    rows += [(3, base[3].tolist()), (20, base[3].tolist()), (None, base[3].tolist()), (21, base[4].tolist()), (4, base[5].tolist())]
    rows += [(30, None), (31, [None] * width), (32, [float("nan")] + [1.0] * (width - 1)), (33, [float("inf")] * width)]
    rows += [(34, []), (35, [0.0] * width), (36, base[0, :-1].tolist()), (37, (2 * base[6]).tolist()), (None, None)]
    return rows


def good(rows, width):
    return [(i, v) for i, v in rows if v is not None and len(v) == width and None not in v and np.isfinite(v).all()]


# --- whitening ----------------------------------------------------------------


def check_whitening(got, rows, wanted=32, tolerance=1e-8):
    x = np.floor(64 * np.array([v for _, v in rows], dtype=np.float32).astype(float)) + 1_000_000
    n = len(rows)
    ids = [i for i, _ in rows]
    total = [int(s) for s in x.sum(axis=0)]
    deviation = [sum((n * int(e) - s) ** 2 for e, s in zip(row, total, strict=True)) for row in x]
    centred = x - np.array(total) / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    kept = min(wanted, int((values > 1e-12 * values.sum()).sum()))
    assert len(got) == n * kept and {r.n for r in got} <= {n}
    assert sorted((r.vec_id, r.deviation) for r in got if r.component == 1 and r.vec_id is not None) == sorted(
        (i, d) for i, d in zip(ids, deviation, strict=True) if i is not None
    )
    assert all(r.identity_error < 1e-6 for r in got)
    for c in range(kept):
        own = [r for r in got if r.component == c + 1]
        assert own[0].explained == pytest.approx(values[c] / values.sum(), rel=1e-9)
        alone = (c == 0 or values[c - 1] > 1.0001 * values[c]) and values[c] > 1.0001 * (*values, 0)[c + 1]
        if alone:
            want = centred @ vectors[:, c] / np.sqrt(values[c])
            mine = sorted((r.whitened for r in own))
            assert min(np.abs(np.sort(want) - mine).max(), np.abs(np.sort(-want) - mine).max()) < tolerance
    return kept


def test_whitening_equals_brute_force(spark, small):
    frame = spark.read.parquet(f"{small}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in frame.collect()]
    got = queries.op11_whitening(spark, small).collect()
    assert check_whitening(got, rows) == 32
    want = {i: v for i, v in rows}
    x = np.floor(64 * np.array([want[i] for i in sorted(want)], dtype=np.float64))
    by_row = np.zeros((len(rows), 32))
    place = {i: k for k, i in enumerate(sorted(want))}
    for r in got:
        by_row[place[r.vec_id], r.component - 1] = r.whitened
    assert np.abs(by_row.T @ by_row / len(rows) - np.eye(32)).max() < 1e-9
    assert np.abs(by_row.mean(axis=0)).max() < 1e-9
    # each column is a projection of the rows, and uncorrelated columns of falling spread determine it
    fit, *_ = np.linalg.lstsq(x - x.mean(axis=0), by_row, rcond=None)
    assert np.abs((x - x.mean(axis=0)) @ fit - by_row).max() < 1e-8


def test_whitening_of_edge_rows(spark):
    rows = edge_rows(5)
    got = whitening.report(table(spark, rows)).collect()
    assert check_whitening(got, good(rows, 5)) == 5
    assert whitening.report(table(spark, [])).collect() == []
    assert whitening.report(table(spark, [(1, None), (2, [])])).collect() == []
    assert whitening.report(table(spark, [(1, [1, 2]), (2, [1, 2])])).collect() == []


def test_whitening_of_low_rank_and_equal_eigenvalues(spark):
    rnd = np.random.default_rng(2)
    # three directions in eight dimensions, far apart in size
    flat = (rnd.standard_normal((200, 3)) * [100, 10, 1]) @ np.linalg.qr(rnd.standard_normal((8, 3)))[0].T
    rows = [(i, np.round(v, 3)) for i, v in enumerate(flat)]
    got = whitening.report(table(spark, rows)).collect()
    check_whitening(got, rows, tolerance=1e-6)
    # the corners of a cross: six equal eigenvalues, which one start cannot tell apart
    cross = [(k, 4.0 * s * np.eye(6)[k // 2]) for k, s in zip(range(12), [1, -1] * 6, strict=True)]
    assert check_whitening(whitening.report(table(spark, cross)).collect(), cross) == 6


def test_whitening_stops_when_the_wanted_components_are_final(spark, monkeypatch):
    rnd = np.random.default_rng(3)
    spread = np.concatenate([[90.0, 60, 40, 25], np.full(36, 0.5)])
    rows = [(i, v) for i, v in enumerate(rnd.standard_normal((400, 40)) * spread)]
    passes = []
    product = whitening._Rows.product
    monkeypatch.setattr(whitening._Rows, "product", lambda self, v, w: passes.append(1) or product(self, v, w))
    check_whitening(whitening.report(table(spark, rows), wanted=3).collect(), rows, wanted=3)
    assert len(passes) < 40


def test_deviation_that_fits_no_long(spark):
    rows = [(1, [1e12, 0.0]), (2, [-1e12, 0.0]), (3, [0.0, 0.0])]
    got = whitening.report(table(spark, rows)).collect()
    assert {r.vec_id: r.deviation for r in got} == {1: None, 2: None, 3: 0}


# --- clustering ---------------------------------------------------------------


def brute_clusters(rows, k=8, rounds=10):
    x = [[int(np.floor(1024 * float(np.float32(c)))) for c in v] for _, v in rows]
    order = sorted(
        range(len(rows)),
        key=lambda i: (rows[i][0] is None, hashlib.sha256(f"3:{rows[i][0]}".encode()).hexdigest(), rows[i][1]),
    )
    centres = [x[i] for i in order[:k]]

    def nearest():
        far = [[sum((a - b) ** 2 for a, b in zip(row, c, strict=True)) for c in centres] for row in x]
        return [(f.index(min(f)), min(f)) for f in far]

    for _ in range(rounds):
        own = [c for c, _ in nearest()]
        for c in range(len(centres)):
            members = [row for row, o in zip(x, own, strict=True) if o == c]
            if members:
                centres[c] = [sum(column) // len(members) for column in zip(*members, strict=True)]
    return nearest(), centres


def check_clusters(got, rows):
    found, centres = brute_clusters(rows)
    inertia = sum(d for _, d in found)
    want = []
    for (i, _), (c, d) in zip(rows, found, strict=True):
        own = sum(e for o, e in found if o == c)
        digest = hashlib.sha256(",".join(map(str, centres[c])).encode()).hexdigest()
        want.append((i, c, d, own, inertia, digest))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_clusters_equal_brute_force(spark, small):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{small}/embeddings.parquet").collect()]
    check_clusters(queries.op12_centroid_clustering(spark, small).collect(), rows)


@pytest.mark.parametrize("block", [3, 4096])
def test_clusters_of_edge_rows(spark, monkeypatch, block):
    monkeypatch.setattr(centroids, "BLOCK", block)
    rows = edge_rows(64)
    check_clusters(centroids.report(table(spark, rows)).collect(), good(rows, 64))
    assert centroids.report(table(spark, [])).collect() == []
    few = [(1, [0.5] * 64), (2, [0.25] * 64), (3, [0.5] * 64)]
    check_clusters(centroids.report(table(spark, few)).collect(), few)


def test_only_expired_vectors_are_scanned_again(spark):
    rnd = np.random.default_rng(4)
    middle = rnd.standard_normal((8, 64)) * 3
    rows = [(i, middle[i % 8] + rnd.standard_normal(64) * 0.05) for i in range(400)]
    work = []
    assigned, _ = centroids.cluster(table(spark, rows), work=work)
    assert work[0] == 400 and sum(work[1:]) < 400 * 5
    found, _ = brute_clusters([(i, v.tolist()) for i, v in rows])
    assert sorted((r.vec_id, r.cluster) for r in assigned.collect()) == [(i, c) for i, (c, _) in enumerate(found)]


def test_distances_are_exact_beyond_doubles():
    x = np.array([[1 << 27, -(1 << 27), 3]])
    c = np.array([[-(1 << 27), 1 << 27, 2], [1 << 27, -(1 << 27), 3]])
    assert centroids.distances(x, c).tolist() == [[(1 << 57) + 1, 0]]


# --- near duplicates ----------------------------------------------------------


def brute_links(rows, least=0.9):
    vectors = [None if v is None or not v or None in v or not np.isfinite(v).all() or not np.any(v) else np.float32(v).astype(float) for _, v in rows]
    n, root = len(rows), list(range(len(rows)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    links = [0] * n
    for a in range(n):
        for b in range(a):
            x, y = vectors[a], vectors[b]
            if x is not None and y is not None and len(x) == len(y):
                if x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= least:
                    links[a], links[b] = links[a] + 1, links[b] + 1
                    root[find(a)] = find(b)
    ids = {}
    for k, (i, _) in enumerate(rows):
        ids.setdefault(find(k), []).append(i)
    lowest = {r: min((i for i in own if i is not None), default=None) for r, own in ids.items()}
    return [(i, links[k], lowest[find(k)], i == lowest[find(k)]) for k, (i, _) in enumerate(rows)]


def check_links(got, rows):
    assert sorted(map(tuple, got), key=repr) == sorted(brute_links(rows), key=repr)


def test_links_equal_brute_force(spark, small):
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{small}/embeddings.parquet").collect()]
    check_links(queries.op13_near_vectors(spark, small).collect(), rows)


@pytest.mark.parametrize("block", [4, 4096])
def test_links_of_edge_rows(spark, monkeypatch, block):
    monkeypatch.setattr(near_vectors, "BLOCK", block)
    monkeypatch.setattr(near_vectors, "CELL", block)
    rows = edge_rows(6)
    check_links(near_vectors.link(table(spark, rows)).collect(), rows)
    assert near_vectors.link(table(spark, [])).collect() == []


@pytest.mark.parametrize("block", [64, 4096])
def test_links_of_groups_chains_and_noise(spark, monkeypatch, block):
    monkeypatch.setattr(near_vectors, "BLOCK", block)
    monkeypatch.setattr(near_vectors, "CELL", block // 2)
    rnd = np.random.default_rng(6)
    centre = rnd.standard_normal((4, 16))
    tight = centre[0] + rnd.standard_normal((120, 16)) * 0.1
    loose = centre[1:][rnd.integers(0, 3, 150)] + rnd.standard_normal((150, 16)) * rnd.choice([0.2, 0.4, 0.7], 150)[:, None]
    turn = np.linspace(0, 3, 60)
    chain = np.zeros((60, 16))
    chain[:, 0], chain[:, 1] = np.cos(turn), np.sin(turn)
    every = np.concatenate([tight, loose, chain, rnd.standard_normal((100, 16)), np.repeat(centre[:1], 40, axis=0)])
    rows = [(int(i), v.tolist()) for i, v in zip(rnd.permutation(len(every)), every, strict=True)]
    check_links(near_vectors.link(table(spark, rows)).collect(), rows)


def test_a_large_group_is_linked_without_comparing_its_members():
    rnd = np.random.default_rng(7)
    near = rnd.standard_normal(32) + rnd.standard_normal((3000, 32)) * 0.01
    tree = cover_tree.build(cover_tree.unit(near))
    side = cover_tree.Side.of(near[tree.order], np.ones(3000, dtype=np.int64), tree, 0)
    links = cover_tree.Links(3000)
    compared = []
    record = cover_tree._record
    cover_tree._record = lambda *a: compared.append(a[5].size) or record(*a)
    try:
        cover_tree.traverse(side, side, 0.9, links, True)
    finally:
        cover_tree._record = record
    assert sum(compared) < 1000
    assert (links.weights() == 3000).all() and (links.root == 0).all()


def test_radii_cover_and_levels_are_nested():
    u = cover_tree.unit(np.random.default_rng(8).standard_normal((700, 3)))
    tree = cover_tree.build(u)
    assert sorted(tree.order) == list(range(700))
    placed = u[tree.order]
    for level, (starts, radii) in enumerate(zip(tree.starts, tree.radii, strict=True)):
        ends = np.append(starts[1:], 700)
        if level:
            assert set(tree.starts[level - 1]) <= set(starts)
        for a, b, r in zip(starts, ends, radii, strict=True):
            assert np.linalg.norm(placed[a:b] - placed[a], axis=1).max() <= r + 1e-7
            if 0 < level < len(tree.starts) - 1:
                assert r <= cover_tree.RADII[level - 1] + 1e-3
