import numpy as np
import pytest

from quillspark.llm import cover_tree
from quillspark.llm.components import forest
from quillspark.llm.cover_tree import Tree, dual, near_vectors, net
from quillspark.llm.storage import Shelf


def cloud(seed, n=300, dim=8):
    """Clusters of very different tightness, copies, scaled copies and strays."""
    rng = np.random.default_rng(seed)
    out = list(rng.normal(size=(n // 3, dim)))
    while len(out) < n:
        base = out[rng.integers(n // 3)]
        out += [base + rng.choice([0, 1e-9, 0.05, 0.3, 0.6]) * rng.normal(size=dim) for _ in range(4)] + [base * rng.choice([1.0, 2.0])]
    return np.array(out[:n])


def brute(ids, vectors, threshold):
    u = vectors / np.linalg.norm(vectors, axis=1)[:, None]
    near = u @ u.T >= threshold
    np.fill_diagonal(near, False)
    group = {i: i for i in range(len(ids))}

    def top(i):
        while group[i] != i:
            i = group[i]
        return i

    order = np.argsort(ids, kind="stable")
    rank = {i: k for k, i in enumerate(order)}
    for a, b in zip(*np.nonzero(near)):
        x, y = sorted((top(a), top(b)), key=rank.get)
        group[y] = x
    return {ids[i]: (int(near[i].sum()), ids[top(i)], top(i) == i) for i in range(len(ids))}


def test_net_covers_and_separates():
    p = cloud(0)
    p = p / np.linalg.norm(p, axis=1)[:, None]
    for radius in (1.0, 0.5, 0.125):
        owner = net(p, radius)
        centres = np.unique(owner)
        away = np.linalg.norm(p - p[owner], axis=1)
        apart = np.linalg.norm(p[centres][:, None] - p[centres][None], axis=2) + 9 * np.eye(len(centres))
        assert away.max() <= radius + 1e-7 and apart.min() > radius - 1e-7 and owner[0] == 0


@pytest.mark.parametrize("threshold", [0.5, 0.9, 0.99, 1.0])
def test_dual_counts_every_link(threshold):
    p = np.unique(np.round(cloud(int(threshold * 100)), 3), axis=0)
    p = p / np.linalg.norm(p, axis=1)[:, None]
    w = np.random.default_rng(1).integers(1, 4, len(p)).astype(float)
    near = p @ p.T >= threshold
    np.fill_diagonal(near, False)
    (got,), _ = dual(Tree(p, w), None, threshold)
    if threshold < 1.0:  # at 1.0 rounding decides about scaled copies
        assert (got.round() == near @ w).all()
        h = len(p) // 2
        (a, b), _ = dual(Tree(p[:h], w[:h]), Tree(p[h:], w[h:]), threshold)
        assert (a.round() == near[:h, h:] @ w[h:]).all() and (b.round() == near[h:, :h] @ w[:h]).all()


@pytest.mark.parametrize("spread", [0.05, 0.1, 0.16])
def test_crowded_nodes_and_reduced_links(monkeypatch, spread):
    monkeypatch.setattr(cover_tree, "MANY", 50)
    monkeypatch.setattr(cover_tree, "HELD", 100)
    rng = np.random.default_rng(7)
    p = rng.normal(size=8) + spread * np.sqrt(8) * rng.normal(size=(400, 8))
    p = p / np.linalg.norm(p, axis=1)[:, None]
    near = p @ p.T >= 0.9
    np.fill_diagonal(near, False)
    (got,), (x, y) = dual(Tree(p, np.ones(400)), None, 0.9)
    assert (got.round() == near.sum(axis=1)).all()
    root = lambda u, v: dict(zip(*(z.tolist() for z in forest(u, v)), strict=True)) if len(u) else {}
    assert root(x, y) == root(*np.nonzero(near))


@pytest.mark.parametrize("block,fan", [(8192, 32), (40, 5), (16, 2)])
def test_equals_all_pairs(spark, block, fan):
    vectors = cloud(block)
    ids = [int(x) for x in np.random.default_rng(2).permutation(len(vectors)) * 3]
    rows = [(i, v.tolist(), "clash") for i, v in zip(ids, vectors)]
    odd = [(-1, None, "c"), (-2, [], "c"), (-3, [0.0] * 8, "c"), (-4, [float("nan")] * 8, "c"), (-5, [1.0, None, *[0.0] * 6], "c"), (-6, [float("inf")] + [0.0] * 7, "c"), (-7, [1.0, 2.0], "c"), (-8, [2.0, 4.0], "c")]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, n_links string")
    found = {r[0]: tuple(r[1:]) for r in near_vectors(df, threshold=0.9, block=block, fan=fan, sample=64).collect()}
    wanted = brute(ids, vectors, 0.9) | {-k: (0, -k, True) for k in range(1, 7)} | {-7: (1, -8, False), -8: (1, -8, True)}
    assert found == wanted


def test_large_group_of_copies_and_empty_table(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=16)
    rows = [(i, base.tolist()) for i in range(200)] + [(500 + i, (base + 0.01 * rng.normal(size=16)).tolist()) for i in range(100)] + [(900, (-base).tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = {r[0]: tuple(r[1:]) for r in near_vectors(df, block=16).collect()}
    assert all(found[i][:2] == (299, 0) for i, _ in rows[:-1]) and found[900] == (0, 900, True)
    assert near_vectors(df.limit(0)).collect() == []


def test_repeated_ids_get_a_row_each(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (None, [1.0, 0.0])], "vec_id long, embedding array<float>")
    assert sorted((tuple(r) for r in near_vectors(df).collect()), key=str) == [(1, 1, 1, True), (1, 1, 1, True), (2, 0, 2, True), (None, 0, None, True)]


@pytest.mark.parametrize("size", [1e-300, 1e-200, 1e-320, 1.0, 1e200, 1e307])
def test_components_of_any_size(spark, size):
    rng = np.random.default_rng(5)
    base = rng.normal(size=8)
    rows = [(i, (base + 0.01 * rng.normal(size=8)).tolist()) for i in range(50)] + [(100, (base * size).tolist()), (101, [size, *[0.0] * 7]), (102, [0.0, -size, *[0.0] * 6])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = {r[0]: tuple(r[1:]) for r in near_vectors(df, block=16).collect()}
    # the smallest doubles are so few that a scaled vector is a coarse one
    assert all(found[i][0] == 50 and found[i][1] == 0 for i in [*range(50), 100]) and found[101][0] == found[102][0] == 0


def clusters(n, dim=16, spread=0.02):
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(n // 200, dim))
    return np.repeat(centres, 200, axis=0) + spread * rng.normal(size=(len(centres) * 200, dim))


def test_block_pairs_of_clustered_vectors_grow_with_their_number(spark):
    tau = np.sqrt(2 - 2 * 0.98)
    made = []
    for n in (2000, 8000):
        shelf = Shelf(spark, "test")
        rows = [(i, 1, (v / np.linalg.norm(v)).tobytes()) for i, v in enumerate(clusters(n))]
        reps = shelf.saved(spark.createDataFrame(rows, "rep long, weight long, vector binary"))
        settled, nodes, levels = cover_tree.cells(reps, tau, 64, 8, 256, shelf)
        assert settled.count() == n and settled.select("rep").distinct().count() == n and levels > 1
        made.append(cover_tree.meeting_blocks(nodes, levels, tau, 64, shelf).count())
    assert made[1] < 6 * made[0]  # all pairs of blocks: sixteen times as many


def test_tight_cells_are_not_taken_by_pairs(spark):
    rng = np.random.default_rng(10)
    base = rng.normal(size=8)
    vectors = np.concatenate([base + 1e-3 * rng.normal(size=(300, 8)), -base + 1e-3 * rng.normal(size=(5, 8)), rng.normal(size=(40, 8))])
    ids = list(range(1, len(vectors) + 1))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, vectors)], "vec_id long, embedding array<double>")
    assert {r[0]: tuple(r[1:]) for r in near_vectors(df, block=8, fan=4, sample=32).collect()} == brute(ids, vectors, 0.9)
