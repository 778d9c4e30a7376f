"""Near-duplicate vectors by dual traversal of cover trees, exactly at the threshold.

Unit vectors are linked if their cosine is at least ``threshold``, that is if their distance is at most tau = sqrt(2 - 2 threshold).

Cells: vectors that are equal in every component collapse to the one of smallest id with their number.  The rest form one cell for each length of
vectors, and every cell of more than ``block`` vectors is split into up to ``fan`` cells, level by level: a sample of the cell gives
the centres, far from each other, and each vector goes to its nearest.  All cells of a level are split at once, and crowded ones are dealt over many tasks.
A cell all of whose vectors are closer than tau / 2 to its centre is tight: they are all linked with each other, which sums by cell settle, so it needn't be split and
doesn't meet itself.  Tight or unsplittable cells of more than ``block`` vectors are dealt over blocks by hash.
Meeting cells are found by descending from the roots: of a pair of cells the pairs of children stay whose centres are no further
apart than both radii and tau.  Only this table of pairs is written; no cell meets those that its ancestors were pruned from.
Trees: each block becomes nested levels of nodes with halving radii 1, 1/2, 1/4, 1/8: a node's centre is a vector of the
block, centres of one parent are further apart than the radius, and every vector below a node is within it; the true covering radius is kept.
Pairs: the blocks of two meeting cells meet in a task, which descends both
trees at once: a node pair is pruned if its centres are further apart than both covering radii and tau, is taken whole, without looking at vectors, if
even its furthest vectors are within tau, and is opened otherwise, down to pairs of vectors, which are compared in double precision.
Out of a task come, for each vector, its number of links there and the smallest vector that it hangs together with; link pairs are
never listed.  Sums by vector and connected components over tasks finish the work.

How many pairs can be pruned depends on the data: where clusters hold a block or more, a cell meets its neighbours only, and block pairs grow with the number of vectors.  Vectors without
clusters, or with many small ones, whose centres then are such vectors, are about equally far from each other, so that all cells meet and comparisons grow with the square of the number of different vectors; this is the price of exactness there.

Defined cases
    Vectors that are null, empty, zero or hold null or non-finite components link with nothing; vectors of different lengths don't link.
    Components of any size count, from the smallest double to the largest: vectors are scaled by their largest component before their norm is taken.
    Rows that repeat an id are vectors of their own, which get a row each; "other vectors" counts rows.  Rows with a null id can't be named: they link with nothing
    and get a row each with a null component, kept.  An empty table gives an empty result.  Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components, forest
from .minhash_dedup import in_runs
from .storage import Shelf

RADII = (1.0, 0.5, 0.25, 0.125)
#: Distances within this of a bound are neither pruned nor taken whole; rounding errors are far smaller.
MARGIN = 1e-6
#: What single precision may take from a cosine, for each component.
SINGLE = 2e-7
TILE = 2048
#: Child pairs of one node pair beyond which they are taken by matrix products.
MANY = 4096
#: Links that are held before they are reduced to a forest.
HELD = 2_000_000
#: Levels of cells; what is still crowded then is dealt by hash.
LEVELS = 40


def unit(raw: list[bytes]) -> np.ndarray:
    rows = np.stack([np.frombuffer(r, np.float64) for r in raw])
    rows = rows / np.abs(rows).max(axis=1)[:, None]  # squares of what is left neither vanish nor overflow
    return rows / np.linalg.norm(rows, axis=1)[:, None]


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (a @ b.T)))


def net(points: np.ndarray, radius: float) -> np.ndarray:
    """For each point the index of a centre within ``radius`` (to single precision); the first point is a centre and centres are further apart than that."""
    n = len(points)
    owner = np.full(n, -1)
    if n == 1:
        return np.zeros(1, np.int64)
    least = 1 - radius * radius / 2
    fast = points.astype(np.float32)
    centres = np.empty((0, points.shape[1]), np.float32)
    names = np.empty(0, np.int64)
    for at in range(0, n, 512):
        block = np.arange(at, min(n, at + 512))
        if len(names):
            alike = fast[block] @ centres.T
            near = alike.argmax(axis=1)
            hit = alike[np.arange(len(block)), near] >= least
            owner[block[hit]] = names[near[hit]]
        left = block[owner[block] < 0]
        within = fast[left] @ fast[left].T >= least
        fresh = []
        for k in range(len(left)):
            if owner[left[k]] < 0:
                fresh.append(left[k])
                owner[left[within[k] & (owner[left] < 0)]] = left[k]
                owner[left[k]] = left[k]
        names = np.r_[names, np.array(fresh, np.int64)]
        centres = np.concatenate([centres, fast[fresh]]) if fresh else centres
    return owner


class Tree:
    """Levels of nodes over unit vectors: ``node[l]`` gives each vector's node at level l, ``centre[l]``, ``radius[l]`` and ``weight[l]``
    are by node; the last level holds the vectors themselves."""

    def __init__(self, points: np.ndarray, weight: np.ndarray):
        self.points = points
        n = len(points)
        owner = net(points, RADII[0])
        levels = [owner]
        for radius in RADII[1:]:
            finer = owner.copy()
            order = np.argsort(owner, kind="stable")
            cuts = np.flatnonzero(np.r_[True, np.diff(owner[order]) != 0, True])
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if b - a > 1:
                    members = order[a:b]
                    centre = owner[members[0]]
                    members = np.r_[centre, members[members != centre]]  # nested: the centre stays one
                    finer[members] = members[net(points[members], radius)]
            owner = finer
            levels.append(owner)
        levels.append(np.arange(n))
        self.node, self.centre, self.radius, self.weight, self.parent = [], [], [], [], []
        for level, own in enumerate(levels):
            centre, node = np.unique(own, return_inverse=True)
            away = np.zeros(len(centre))
            np.maximum.at(away, node, np.sqrt(np.maximum(0.0, 2 - 2 * np.einsum("ij,ij->i", points, points[own]))) if level < len(levels) - 1 else 0.0)
            self.node.append(node)
            self.centre.append(centre)
            self.radius.append(away)
            self.weight.append(np.bincount(node, weight, len(centre)))
            if level:
                parent = np.empty(len(centre), np.int64)
                parent[node] = self.node[level - 1]
                self.parent.append(parent)
        self.children = []
        for level, parent in enumerate(self.parent):
            order = np.argsort(parent, kind="stable")
            starts = np.searchsorted(parent[order], np.arange(len(self.centre[level]) + 1))
            self.children.append((order, starts))


def opened(tree: Tree, level: int, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which of ``nodes``, its child) for all children."""
    order, starts = tree.children[level]
    n = starts[nodes + 1] - starts[nodes]
    which = np.repeat(np.arange(len(nodes)), n)
    inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return which, order[np.repeat(starts[nodes], n) + inside]


def crossed(a: Tree, b: Tree, level: int, pa_: np.ndarray, pb: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of children of node pairs, about ``most`` at a time; no single pair has more."""
    if not len(pa_):
        return
    size = np.diff(a.children[level][1])[pa_] * np.diff(b.children[level][1])[pb]
    upto = np.cumsum(size)
    at = 0
    while at < len(pa_):
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + most, "right")))
        which, ca = opened(a, level, pa_[at:end])
        again, cb = opened(b, level, pb[at:end][which])
        yield ca[again], cb
        at = end


def dual(a: Tree, b: Tree | None, threshold: float) -> tuple[list[np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """Weights of linked vectors for each vector of both trees, and links that connect what is linked; vectors of
    ``b`` are numbered behind those of ``a``.  With ``b`` None the tree meets itself."""
    same = b is None
    b = a if same else b
    tau = float(np.sqrt(2 - 2 * threshold))
    last = len(RADII)
    found = [[np.zeros(len(c)) for c in t.centre] for t in (a, b)]
    links: list[tuple[np.ndarray, np.ndarray]] = []
    held = 0
    shift = (0, 0 if same else len(a.points))
    most = max(1024, 6_000_000 // a.points.shape[1])  # pairs whose vectors are laid side by side at once
    tied = [[np.zeros(len(c), bool) for c in t.centre] for t in (a, b)]

    def link(side: int, x: np.ndarray, other: int, y: np.ndarray) -> None:
        nonlocal held
        links.append((x + shift[side], y + shift[other]))
        held += len(x)
        if held > HELD:
            links[:] = [forest(*(np.concatenate([p[k] for p in links]) for k in (0, 1)))]
            held = 0

    def taken(level: int, i: np.ndarray, j: np.ndarray) -> None:
        """Node pairs whose vectors are all linked."""
        np.add.at(found[0][level], i, b.weight[level][j])
        np.add.at(found[1][level], j, a.weight[level][i])
        link(0, a.centre[level][i], 1, b.centre[level][j])
        if level < last:
            for side, tree, nodes, other, centres in ((0, a, i, 1, b.centre[level][j]), (1, b, j, 0, a.centre[level][i])):
                new, first = np.unique(nodes, return_index=True)
                fresh = ~tied[side][level][new]
                tied[side][level][new] = True
                if same:
                    tied[1 - side][level][new] = True
                target = np.full(len(tree.centre[level]), -1)
                target[new[fresh]] = centres[first[fresh]]
                members = np.flatnonzero(target[tree.node[level]] >= 0)
                link(side, members, other, target[tree.node[level]][members])

    def kept(level: int, i: np.ndarray, j: np.ndarray, d: np.ndarray, siblings: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Takes whole pairs and gives those to open.  Of ``siblings`` in one tree both orders are given; one counts."""
        if same:  # a node with itself is opened unless it is taken whole
            once = ~siblings | (i < j if level == last else i <= j)
            i, j, d = i[once], j[once], d[once]
        reach = a.radius[level][i] + b.radius[level][j]
        near = d <= reach + tau + MARGIN
        i, j, d, reach = i[near], j[near], d[near], reach[near]
        if level == last:
            exact = np.einsum("ij,ij->i", a.points[i], b.points[j]) >= threshold if len(i) else np.empty(0, bool)
            taken(level, i[exact], j[exact])
            return i[:0], j[:0]
        whole = d + reach <= tau - MARGIN
        self_pairs = whole & (i == j) if same else np.zeros(len(i), bool)
        if self_pairs.any():
            inside(level, i[self_pairs])
        others = whole & ~self_pairs
        if others.any():
            taken(level, i[others], j[others])
        return i[~whole], j[~whole]

    def inside(level: int, nodes: np.ndarray) -> None:
        """Nodes all of whose own vectors are linked; each vector's link with itself is taken off at the end."""
        chosen = np.zeros(len(a.centre[level]), bool)
        chosen[nodes] = True
        members = np.flatnonzero(chosen[a.node[level]])
        found[0][level][nodes] += a.weight[level][nodes]
        found[0][last][members] -= a.weight[last][members]
        link(0, members, 0, a.centre[level][a.node[level][members]])

    def onward(level: int, i: np.ndarray, j: np.ndarray, d: np.ndarray, siblings: np.ndarray) -> None:
        for k in range(0, len(i), most):
            part = slice(k, k + most)
            ki, kj = kept(level, i[part], j[part], d[part], siblings[part])
            if level < last and len(ki):
                descend(level, ki, kj)

    def descend(level: int, i: np.ndarray, j: np.ndarray) -> None:
        size = np.diff(a.children[level][1])[i] * np.diff(b.children[level][1])[j]
        for ci, cj in crossed(a, b, level, i[size <= MANY], j[size <= MANY], most):
            x, y = a.points[a.centre[level + 1][ci]], b.points[b.centre[level + 1][cj]]
            d = np.sqrt(np.maximum(0.0, 2 - 2 * np.einsum("ij,ij->i", x, y)))
            onward(level + 1, ci, cj, d, a.parent[level][ci] == b.parent[level][cj])
        for m, n in zip(i[size > MANY].tolist(), j[size > MANY].tolist(), strict=True):
            # two crowded nodes: tiles of all pairs of their children
            every = [opened(t, level, np.array([node]))[1] for t, node in ((a, m), (b, n))]
            for s in range(0, len(every[0]), TILE):
                for t in range(0, len(every[1]), TILE):
                    ci, cj = every[0][s : s + TILE], every[1][t : t + TILE]
                    alike = a.points[a.centre[level + 1][ci]] @ b.points[b.centre[level + 1][cj]].T
                    reach = a.radius[level + 1][ci][:, None] + b.radius[level + 1][cj][None, :] + (tau + MARGIN)
                    x, y = np.nonzero(alike >= 1 - reach * reach / 2 - MARGIN)
                    d = np.sqrt(np.maximum(0.0, 2 - 2 * alike[x, y]))
                    onward(level + 1, ci[x], cj[y], d, np.full(len(x), m == n))

    # A level that the next hardly refines says little more than it, but its radii are larger: start at the next.
    top = 0
    while top < last - 1 and len(a.centre[top + 1]) + len(b.centre[top + 1]) < 2 * (len(a.centre[top]) + len(b.centre[top])):
        top += 1
    # Nodes in the order of their radii, so that one bound for a whole tile is a sharp one for most tiles.
    order_a, order_b = np.argsort(a.radius[top], kind="stable"), np.argsort(b.radius[top], kind="stable")
    fast_a, fast_b = (t.points[t.centre[top][o]].astype(np.float32) for t, o in ((a, order_a), (b, order_b)))
    for s in range(0, len(order_a), TILE):
        for t in range(s if same else 0, len(order_b), TILE):
            rows, columns = order_a[s : s + TILE], order_b[t : t + TILE]
            reach = a.radius[top][rows[-1]] + b.radius[top][columns[-1]] + tau + MARGIN
            alike = fast_a[s : s + TILE] @ fast_b[t : t + TILE].T
            near = np.flatnonzero(alike.ravel() >= 1 - reach * reach / 2 - SINGLE * (64 + a.points.shape[1]))
            i, j = np.divmod(near, len(columns))
            if same and s == t:
                i, j = i[i <= j], j[i <= j]
            i, j = rows[i], columns[j]
            for k in range(0, len(i), most):
                ci, cj = i[k : k + most], j[k : k + most]
                d = np.sqrt(np.maximum(0.0, 2 - 2 * np.einsum("ij,ij->i", a.points[a.centre[top][ci]], b.points[b.centre[top][cj]])))
                ki, kj = kept(top, ci, cj, d, np.zeros(len(ci), bool))
                if len(ki):
                    descend(top, ki, kj)
    sums = [sum(f[level][t.node[level]] for level in range(last + 1)) for f, t in zip(found, (a, b), strict=True)]
    none = np.empty(0, np.int64)
    x, y = (np.concatenate([none, *(p[k] for p in links)]) for k in (0, 1))
    return ([sums[0] + sums[1]] if same else sums), (x, y)


def traverser(threshold: float) -> Callable:
    """Rows (p, q, side, vec_id, weight, vector), sorted by (p, q), to (u, v, n): n links of u here, and v smallest of those u hangs together with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in in_runs(batches, 2):
            side = table.column(2).to_numpy()
            ids, weight = table.column(3).to_numpy(), table.column(4).to_numpy().astype(np.float64)
            points = unit(table.column(5).to_pylist())
            order = [np.flatnonzero(side == s) for s in (0, 1)]
            order = [o[np.argsort(ids[o], kind="stable")] for o in order]
            trees = [Tree(points[o], weight[o]) for o in order if len(o)]
            if not trees or (len(trees) == 1 and table.column(0)[0] != table.column(1)[0]):
                continue
            sums, (x, y) = dual(trees[0], trees[1] if len(trees) > 1 else None, threshold)
            n = np.concatenate(sums).round().astype(np.int64)
            name = np.concatenate([ids[o] for o in order])
            low = np.arange(len(name))
            if len(x):
                by = np.argsort(name, kind="stable")  # forests are of smallest ids
                rank = np.empty(len(name), np.int64)
                rank[by] = np.arange(len(name))
                u, v = forest(rank[x], rank[y])
                low[by[u]] = by[v]
            some = np.flatnonzero(n > 0)
            if len(some):
                yield pa.RecordBatch.from_arrays([pa.array(name[some]), pa.array(name[low[some]]), pa.array(n[some])], names=["u", "v", "n"])

    return run


def spread(points: np.ndarray, most: int) -> np.ndarray:
    """At most ``most`` different points, each drawn with the square of its distance to those before as its weight, from a fixed seed."""
    rng = np.random.default_rng(0)
    chosen = [0]
    away = distances(points, points[:1])[:, 0]
    while len(chosen) < most and away.max() > MARGIN:
        weight = np.where(away > MARGIN, away, 0.0) ** 2
        chosen.append(int(rng.choice(len(points), p=weight / weight.sum())))
        away = np.minimum(away, distances(points, points[chosen[-1:]])[:, 0])
    return points[chosen]


def seeder(block: int, fan: int) -> Callable:
    """Rows (cell, n, rep, vector) of samples, sorted by cell, to (cell, kid, centre); nothing for cells that can't be split."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in in_runs(batches, 1):
            order = np.argsort(table.column(2).to_numpy(), kind="stable")
            raw = table.column(3).to_pylist()
            n, cell = table.column(1)[0].as_py(), table.column(0)[0].as_py()
            found = spread(unit([raw[k] for k in order]), min(fan, max(2, -(-n // block))))
            if len(found) > 1:
                kids = [xxhash.xxh3_64_intdigest(f"{cell}/{k}") - 2**63 for k in range(len(found))]
                columns = [pa.array([cell] * len(kids), pa.int64()), pa.array(kids, pa.int64()), pa.array([x.tobytes() for x in found], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["cell", "kid", "centre"])

    return run


def placer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (cell, part, kind, id, weight, vector), sorted by (cell, part), to (rep, weight, vector, cell, away) of those of kind 1; kind 0 are the cell's centres."""
    for table in in_runs(batches, 2):
        kind, ids = table.column(2).to_numpy(), table.column(3).to_numpy()
        at, members = np.flatnonzero(kind == 0), np.flatnonzero(kind == 1)
        if not len(members):
            continue
        at = at[np.argsort(ids[at])]
        d = distances(unit(table.column(5).take(pa.array(members)).to_pylist()), unit(table.column(5).take(pa.array(at)).to_pylist()))
        near = d.argmin(axis=1)
        rows = table.take(pa.array(members)).combine_chunks().to_batches()[0]
        columns = [rows.column(3), rows.column(4), rows.column(5), pa.array(ids[at][near]), pa.array(d[np.arange(len(members)), near])]
        yield pa.RecordBatch.from_arrays(columns, names=["rep", "weight", "vector", "cell", "away"])


def meeting(tau: float) -> Callable:
    """Rows (a, b, two radii, two centres) to those pairs whose cells may hold a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b, ra, rb = (batch.column(k).to_numpy() for k in range(4))
            x, y = (np.stack([np.frombuffer(v.as_py(), np.float64) for v in batch.column(k)]) for k in (4, 5))
            apart = np.sqrt(np.maximum(0.0, 2 - 2 * np.einsum("ij,ij->i", x, y)))
            near = np.flatnonzero((a == b) | (apart <= ra + rb + tau + MARGIN))
            yield pa.RecordBatch.from_arrays([pa.array(a[near]), pa.array(b[near])], names=["a", "b"])

    return run


def cells(reps: DataFrame, tau: float, block: int, fan: int, sample: int, shelf: Shelf) -> tuple[DataFrame, DataFrame, int]:
    """``reps`` (rep, weight, vector) with the leaf cell of each; all cells (cell, parent, centre, radius, n, tight, inner); the number of levels below the roots."""
    placed = reps.select("rep", "weight", "vector", F.expr("octet_length(vector) div 8").cast("long").alias("cell"), F.lit(2.0).alias("away"))
    settled, nodes, seeds, level = None, None, None, 0
    while True:
        sizes = placed.groupBy("cell").agg(F.max("away").alias("radius"), F.count("*").alias("n"))
        sizes = shelf.saved(sizes.withColumn("tight", 2 * F.col("radius") <= tau - MARGIN))
        crowded = sizes.where((F.col("n") > block) & ~F.col("tight") & F.lit(level < LEVELS)).select("cell", "n")
        some = placed.join(crowded, "cell").where(F.pmod(F.xxhash64("rep", F.lit(level)), F.col("n")) < sample)  # about ``sample`` of each cell
        drawn = some.select("cell", "n", "rep", "vector").repartition("cell").sortWithinPartitions("cell")
        found = shelf.saved(drawn.mapInArrow(seeder(block, fan), "cell long, kid long, centre binary"))
        inner = found.select("cell").distinct().withColumn("inner", F.lit(True))
        known = sizes.join(inner, "cell", "left").withColumn("inner", F.coalesce("inner", F.lit(False)))
        if seeds is None:
            known = known.withColumns({"parent": F.lit(None).cast("long"), "centre": F.lit(None).cast("binary")})
        else:
            known = known.join(seeds.select(F.col("kid").alias("cell"), F.col("cell").alias("parent"), "centre"), "cell")
        known = known.select("cell", "parent", "centre", "radius", "n", "tight", "inner")
        nodes = known if nodes is None else nodes.union(known)
        rest = placed.join(inner, "cell", "left_anti").select("rep", "weight", "vector", "cell")
        settled = rest if settled is None else settled.union(rest)
        if found.isEmpty():
            return settled, shelf.saved(nodes), level
        # the members of a crowded cell in parts, its centres in each of them
        parts = crowded.join(inner.select("cell"), "cell").select("cell", F.ceil(F.col("n") / (4 * block)).cast("int").alias("parts"))
        members = placed.join(parts, "cell").select("cell", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int").alias("part"), F.lit(1).alias("kind"), F.col("rep").alias("id"), "weight", "vector")
        centres = found.join(parts, "cell").select("cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("kind"), "kid", F.lit(0).cast("long").alias("weight"), "centre")
        dealt = members.union(centres).repartition("cell", "part").sortWithinPartitions("cell", "part")
        placed = shelf.saved(dealt.mapInArrow(placer, "rep long, weight long, vector binary, cell long, away double"))
        seeds, level = found, level + 1


def meeting_blocks(nodes: DataFrame, levels: int, tau: float, block: int, shelf: Shelf) -> DataFrame:
    """(p, q): the pairs of blocks that may hold links."""
    kids = nodes.where("parent is not null").select(F.col("parent").alias("node"), F.col("cell").alias("kid")).union(nodes.where("not inner").select("cell", "cell"))
    frontier = nodes.where("parent is null").select(F.col("cell").alias("a"), F.col("cell").alias("b"))
    for _ in range(levels):
        for end in ("a", "b"):
            frontier = frontier.join(kids.select(F.col("node").alias(end), F.col("kid").alias(f"{end}_kid")), end)
        frontier = frontier.where("a <> b or a_kid <= b_kid").select(F.col("a_kid").alias("a"), F.col("b_kid").alias("b"))
        for end in ("a", "b"):
            frontier = frontier.join(nodes.select(F.col("cell").alias(end), F.col("radius").alias(f"r{end}"), F.col("centre").alias(f"c{end}")), end)
        alone = frontier.where("ca is null or cb is null").select("a", "b")  # roots that were never split meet themselves
        frontier = frontier.where("ca is not null and cb is not null").select("a", "b", "ra", "rb", "ca", "cb").mapInArrow(meeting(tau), "a long, b long")
        frontier = shelf.saved(frontier.union(alone))
    for end in ("a", "b"):
        leaf = nodes.select(F.col("cell").alias(end), F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / block).cast("int") - 1)).alias(f"{end}_block"), F.col("tight").alias(f"{end}_tight"))
        frontier = frontier.join(leaf, end)
    frontier = frontier.where("a <> b or (not a_tight and a_block <= b_block)")
    return frontier.select(block_of("a", F.col("a_block")).alias("p"), block_of("b", F.col("b_block")).alias("q"))


def block_of(cell: str, number: Column) -> Column:
    return F.xxhash64(F.col(cell), number.cast("int"))


def packer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(vec_id, array of doubles) to (vec_id, its bytes)."""
    for batch in batches:
        lists = batch.column(1)
        flat, offsets = lists.values.to_numpy(zero_copy_only=False).astype(np.float64), lists.offsets.to_numpy()
        flat = flat + 0.0  # -0.0 and 0.0 are equal
        rows = [flat[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary())], names=["vec_id", "vector"])


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.9, block: int = 8192, fan: int = 32, sample: int = 1024) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every vector."""
    if not 0 < threshold <= 1:
        raise ValueError("the threshold must be above 0 and at most 1")
    shelf = Shelf(vectors.sparkSession, "near-vectors")
    tau = float(np.sqrt(2 - 2 * threshold))
    given = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.coalesce(F.col("vec_id").isNotNull() & (F.size("vector") > 0) & finite & F.exists("vector", lambda x: x != 0), F.lit(False))
    valid = shelf.saved(given.where(usable).mapInArrow(packer, "vec_id long, vector binary"))
    reps = shelf.saved(valid.groupBy("vector").agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight")).select("rep", "weight", "vector"))

    settled, nodes, levels = cells(reps, tau, block, fan, sample, shelf)
    pairs = shelf.saved(meeting_blocks(nodes, levels, tau, block, shelf))
    leaves = nodes.where("not inner").select("cell", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    blocks = settled.join(leaves, "cell").select(block_of("cell", F.pmod(F.xxhash64("rep", F.lit(5)), F.col("blocks"))).alias("block"), "rep", "weight", "vector")
    left = pairs.select(F.col("p").alias("block"), "p", "q", F.lit(0).alias("side"))
    right = pairs.where("p <> q").select(F.col("q").alias("block"), "p", "q", F.lit(1).alias("side"))
    work = blocks.join(left.union(right), "block").select("p", "q", "side", "rep", "weight", "vector")
    # a partition takes its pairs of blocks one after the other, so that few partitions hold no more memory than many
    work = work.repartition(max(1, min(pairs.count(), 20_000)), "p", "q").sortWithinPartitions("p", "q")
    found = shelf.saved(work.mapInArrow(traverser(threshold), "u long, v long, n long"))
    tight = settled.join(nodes.where("tight and not inner").select("cell"), "cell")
    sums = tight.groupBy("cell").agg(F.sum("weight").alias("all"), F.min("rep").alias("low"))
    found = found.union(tight.join(sums, "cell").select("rep", "low", F.col("all") - F.col("weight")).where("all - weight > 0"))

    links = found.groupBy("u").agg(F.sum("n").alias("n"))
    classes = components(found.where("u <> v"), "u", "v", shelf)
    known = reps.select("rep", "weight", "vector").join(links.withColumnRenamed("u", "rep"), "rep", "left").join(classes.withColumnRenamed("node", "rep"), "rep", "left")
    known = known.select("vector", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    linked = valid.join(known, "vector").select("vec_id", "n_links", "component_id")
    alone = given.where(~usable).select("vec_id", F.lit(0).cast("long"), "vec_id")
    return linked.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
