"""Forests and boosting for many candidates at once, on one binned frame.

Every feature is binned once, at exact quantiles; rows travel as blocks of
bytes. A tree asks for the best splits of its open nodes: histograms of
(node, feature, bin) are counted per block, added up, and searched. Trees of
all candidates and folds ask together, so a level of hundreds of trees is one
pass over the blocks. A table of BLOCK_ROWS rows at most needs no such rounds:
a task reads its binned rows and grows its candidates whole, with the same
splits: boosted trees of few leaves in passes over rows that stay in place,
others on rows sorted by node, small nodes by the bins that their rows have.
Row weights come from hashes of the row's id, so folds, candidates and
partitionings see the same samples.

Candidates share work where their trees are the same: with one seed, a forest
of fewer trees is a prefix of a larger one, and a smaller depth or a larger
``min_samples_split`` stops in the same trees earlier. Growth is level-wise, or
best-first up to ``num_leaves``; depth has no limit of its own.
"""

from __future__ import annotations

import json
import math
import sys
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.quantiles import quantiles
from ..session import settings, written

#: Rows of a table that is grown without rounds of jobs: a task reads them all, 28 bytes each.
BLOCK_ROWS = 1 << 24
#: Rows of a written block, a task's least work in a round.
SLICE_ROWS = 1 << 16
#: Rows of a forest's node, at least, for its tree to be grown on all rows; below smaller nodes it is grown on their rows alone.
BRANCH_ROWS = 1 << 18
#: Rows whose predictions by some trees of a forest travel together.
SAID_ROWS = 1 << 13
#: Bins of a feature at most.
BINS = 64
#: Histogram cells that a task may hold for one round.
ROUND_CELLS = 1 << 24
#: Histogram cells that are searched together: they stay in a core's cache.
SEARCH_CELLS = 1 << 17
#: Numbers of a column that holds several features, at most.
PACKED = 1 << 12
#: Rows a node, on average, from which histograms are counted by column and not by feature.
PAIRED_ROWS = 1 << 10
#: Rows of a node that is searched by the bins that its rows have, at most.
SMALL = 32
SMALL_SIZES = np.array([2, 3, 4, 5, 6, 7, 8, 10, 12, 16, 20, 24, SMALL])
#: Boosted trees that a task adds to the written predictions before they are written anew.
REFRESH = 4
#: Boosted candidates that grow together in rounds: a block carries 8 bytes a row for each.
ROUND_MODELS = 16
#: Blocks are rows of some megabytes: a Python task is sent one at a time.
ONE_A_BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 1}
#: Tasks that the trees of forests are dealt over, at least, where there are so many trees.
FOREST_TASKS = 48
TEST = -1  # fold of rows that no model is fitted on


# ------------------------------------------------------------------ the frame
def bin_edges(train: DataFrame, features: list) -> list[list[float]]:
    """Upper edges of each feature's bins: exact quantiles of the training rows."""
    names = {f"f{i}": c for i, c in enumerate(features)}
    got = quantiles(train, names, [i / BINS for i in range(1, BINS)])
    return [sorted({q for q in got[f"f{i}"] if q is not None}) for i in range(len(features))]


def binned_blocks(rows: DataFrame, edges: list) -> DataFrame:
    """Blocks (n, x, y, fold, id) of the rows (id, fold, y, x0..): bins as
    bytes. A value up to an edge is in that edge's bin; nulls are in the first."""
    p = len(edges)

    def block(parts):
        x, y, fold, key = (np.concatenate(v) for v in zip(*parts))
        return pa.RecordBatch.from_pydict({"n": [len(y)], "x": [x.tobytes()], "y": [y.tobytes()], "fold": [fold.tobytes()], "id": [key.tobytes()]},
                                          pa.schema([("n", pa.int64()), *[(c, pa.binary()) for c in ("x", "y", "fold", "id")]]))

    def task(batches):
        parts, held = [], 0
        for b in batches:
            x = np.empty((b.num_rows, p), np.uint8)
            for j in range(p):
                v = b.column(f"x{j}").to_numpy(zero_copy_only=False).astype(np.float64)
                x[:, j] = np.searchsorted(np.asarray(edges[j]), np.where(np.isnan(v), -np.inf, v), "left")
            parts.append((x, b.column("y").to_numpy().astype(np.float64), b.column("fold").to_numpy().astype(np.int32), b.column("id").to_numpy().astype(np.int64)))
            held += b.num_rows
            if held >= min(BLOCK_ROWS, SLICE_ROWS):
                yield block(parts)
                parts, held = [], 0
        if held:
            yield block(parts)
    return rows.mapInArrow(task, "n long, x binary, y binary, fold binary, id binary")


# ------------------------------------------------------------------- the trees
def _hash(x) -> np.ndarray:
    x = (np.asarray(x, np.uint64) + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _seeded(*numbers) -> np.uint64:
    out = np.zeros(1, np.uint64)
    for v in numbers:
        out = _hash(out ^ _hash(np.array([v % (1 << 64)], np.uint64)))
    return out[0]


#: Cumulative Poisson(1) probabilities: copies of a row in a bootstrap sample.
_POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)])


def row_weights(spec: dict, tree: int, key: np.ndarray, fold: np.ndarray) -> np.ndarray:
    use = (fold != TEST) & (fold != spec.get("held", TEST))
    if tree < 0:
        return use.astype(np.float64)
    share = spec.get("subsample", 1.0)
    if spec["kind"] == "rf" and not spec.get("bootstrap", True) or spec["kind"] == "gb" and share >= 1.0:
        return use.astype(np.float64)
    u = (_hash(key.astype(np.uint64) ^ _seeded(spec.get("seed", 42), tree)) >> np.uint64(11)) * (0.5 ** 53)
    w = np.searchsorted(_POISSON, u, "right") if spec["kind"] == "rf" else u < share
    return w * use.astype(np.float64)


def drawn_features(spec: dict, p: int) -> int:
    m = spec.get("max_features")
    if m is None or m == "all":
        return p
    if m == "sqrt":
        return max(1, int(math.sqrt(p)))
    if m == "log2":
        return max(1, int(math.log2(p)))
    return max(1, int(float(m) * p)) if isinstance(m, float) else int(m)


def allowed_features(spec: dict, tree: int, p: int) -> np.ndarray:
    """The candidate's features, thinned per tree by ``colsample_bytree``."""
    mine = np.asarray(spec.get("features") or range(p))
    share = spec.get("colsample_bytree", 1.0)
    if share < 1.0:
        rank = np.argsort(_hash(_hash(mine) ^ _seeded(spec.get("seed", 42), tree, 7)), kind="stable")
        mine = mine[np.sort(rank[:max(1, int(round(share * len(mine))))])]
    return mine


def best_splits(hist: np.ndarray, sizes: list, spec: dict, tree: int, uids: list) -> dict:
    """For each node the split of largest gain. ``hist`` is (3, node, cell):
    rows, weights and weighted targets of each feature's bins, one feature
    after the other. Draws of features skip those that cannot split the node,
    as exact searches do. Arrays total, gain (-inf: no split), feature, cut, left."""
    hist = hist.reshape(3, len(uids), -1)
    p, k = len(sizes), hist.shape[1]
    ends = np.cumsum(sizes)
    start, of = ends - sizes, np.repeat(np.arange(p), sizes)
    cum = hist.cumsum(2)
    total = cum[:, :, ends[0] - 1]
    before = np.where(start > 0, cum[:, :, start - 1], 0.0)
    c = cum[0] - before[0][:, of]
    tc, tw, ts = total
    lam = spec.get("reg_lambda", 0.0)
    least = max(1, spec.get("min_samples_leaf", 1))
    weight = spec.get("min_child_weight", 0.0)
    fine = (c >= least) & (tc[:, None] - c >= least)
    if weight > 0:
        w = cum[1] - before[1][:, of]
        fine &= (w >= weight) & (tw[:, None] - w >= weight)
    fine[:, ends - 1] = False
    mine = np.zeros(p, bool)
    mine[allowed_features(spec, tree, p)] = True
    fine &= mine[of]
    m = drawn_features(spec, int(mine.sum()))
    if m < mine.sum():
        able = np.logical_or.reduceat(fine, start, axis=1)
        h = _hash(_hash(np.asarray(uids, np.uint64))[:, None] ^ _hash(np.arange(p))[None, :])
        h = np.where(able, h >> np.uint64(1), np.uint64(1 << 63))
        fine &= (h <= np.partition(h, m - 1, 1)[:, m - 1:m])[:, of]
    fine &= hist[0] > 0  # an empty bin only repeats the cut before it
    # gains are reckoned where there are cuts: few cells of a small node
    node, cell = np.nonzero(fine)
    feature = of[cell]
    w, s = cum[1:, node, cell] - before[1:, node, feature]
    with np.errstate(invalid="ignore", divide="ignore"):
        gain = s * s / (w + lam) + (ts[node] - s) ** 2 / (tw[node] - w + lam) - ts[node] * ts[node] / (tw[node] + lam)
    best, at = np.full(k, -np.inf), np.zeros(k, np.int64)
    if len(node):
        begin = np.flatnonzero(np.diff(node, prepend=-1))
        best[node[begin]] = np.maximum.reduceat(gain, begin)
        # Gains that differ by rounding alone are equal: the first of them wins.
        top = np.flatnonzero(gain >= (best * (1 - 1e-9))[node])
        top = top[np.diff(node[top], prepend=-1) > 0]
        at[node[top]] = cell[top]
    rows = np.arange(k)
    below = cum[:, rows, at] - before[:, rows, of[at]]
    return {"total": total.T, "gain": np.where(np.isfinite(best), best, -np.inf), "feature": of[at], "cut": at - start[of[at]], "left": below.T}


class Tree:
    """Nodes as arrays: feature (-1: leaf), cut, left child, value, rows, depth."""

    TYPES = (np.int32, np.int16, np.int32, np.float64, np.float64, np.int32)

    def __init__(self, data=None):
        self.feature, self.cut, self.left, self.value, self.rows, self.depth = data or [np.empty(0, t) for t in self.TYPES]

    def add(self, value, rows, depth) -> np.ndarray:
        """New leaves; their numbers."""
        first, none = len(self.feature), np.full(len(value), -1)
        data = [np.concatenate([a, np.asarray(b).astype(t)]) for a, b, t in zip(self.plain(), (none, none * 0, none, value, rows, depth), self.TYPES)]
        self.feature, self.cut, self.left, self.value, self.rows, self.depth = data
        return np.arange(first, first + len(value))

    def plain(self) -> list:
        return [self.feature, self.cut, self.left, self.value, self.rows, self.depth]


def child_uids(uid: np.ndarray) -> np.ndarray:
    """The uids of the left and the right child of each node in turn."""
    return np.repeat(uid * np.uint64(0x9E3779B97F4A7C15), 2) + np.tile(np.array([1, 3], np.uint64), len(uid))


def growing(spec: dict, tree_no: int, root=None):
    """Generator of one tree, or of the part below a node of uid ``root``:
    yields (tree, nodes, uids) and is sent the best splits of those nodes;
    returns (tree, gains per feature)."""
    lam, lr = spec.get("reg_lambda", 0.0), spec.get("learning_rate", 1.0) if spec["kind"] == "gb" else 1.0
    depth, most = spec.get("max_depth"), spec.get("num_leaves")
    least = max(2, spec.get("min_samples_split", 2))
    floor = max(spec.get("gamma", 0.0), 1e-10)
    tree, gains, leaves, ready = Tree(), {}, 1, {}
    ask, uid = tree.add([0.0], [0], [0]), np.array([_seeded(spec.get("seed", 42), tree_no, 1) if root is None else root], np.uint64)
    names = ("gain", "feature", "cut", "left", "total")
    while len(ask) or ready:
        if len(ask):
            found = yield tree, ask, uid
            found = [np.asarray(found[n]) for n in names]
            if ask[0] == 0:
                tree.value[0], tree.rows[0] = lr * found[4][0, 2] / max(found[4][0, 1] + lam, 1e-300), found[4][0, 0]
            go = np.flatnonzero((found[0] > floor) & (found[4][:, 0] >= least))
            split = [ask[go], uid[go], *[f[go] for f in found]]
        if most is not None:  # one node at a time, the others wait
            ready.update({int(n): [v[i:i + 1] for v in split] for i, n in enumerate(split[0])} if len(ask) else {})
            if not ready or leaves >= most:
                break
            split = ready.pop(max(ready, key=lambda n: (ready[n][2][0], -n)))
        nodes, own, gain, feature, cut, below, total = split
        if not len(nodes):
            break
        for f in np.unique(feature):
            gains[int(f)] = gains.get(int(f), 0.0) + float(gain[feature == f].sum())
        leaves += len(nodes)
        c, w, s = np.stack([below, total - below], 1).reshape(-1, 3).T
        child = tree.add(lr * s / np.maximum(w + lam, 1e-300), c, np.repeat(tree.depth[nodes] + 1, 2))
        tree.feature[nodes], tree.cut[nodes], tree.left[nodes] = feature, cut, child[::2]
        uid = child_uids(own)
        on = c >= least if depth is None else (c >= least) & (tree.depth[child] < depth)
        ask, uid = child[on], uid[on]
    return tree, gains


# ----------------------------------------------------------- rows of one block
class Layout:
    """Features as columns of small numbers: several share a column, as digits of its numbers."""

    def __init__(self, sizes: list):
        p, ends = len(sizes), np.cumsum(sizes)
        self.sizes, self.width, self.start = sizes, int(ends[-1]), ends - sizes
        self.groups, self.bins = [], []
        self.column, self.digit = np.zeros(p, np.int64), np.zeros((p, PACKED), np.uint8)
        for j in sorted(range(p), key=lambda j: -sizes[j]):
            at = next((g for g, b in enumerate(self.bins) if b * sizes[j] <= PACKED), len(self.bins))
            if at == len(self.bins):
                self.groups.append([])
                self.bins.append(1)
            self.column[j] = at
            self.digit[j] = np.arange(PACKED) // self.bins[at] % sizes[j]
            self.groups[at].append(j)
            self.bins[at] *= sizes[j]
        # from the numbers of a column to the bins of its features
        self.cells = [np.concatenate([self.start[j] + np.arange(sizes[j]) for j in g]) for g in self.groups]
        self.parts = [np.concatenate([np.equal.outer(self.digit[j][:b], np.arange(sizes[j])) for j in g], axis=1).astype(np.float64) if len(g) > 2 else None
                      for g, b in zip(self.groups, self.bins)]

    def pack(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(self.groups), len(x)), np.uint16)
        for at, group in enumerate(self.groups):
            scale = 1
            for j in group:
                out[at] += x[:, j] * np.uint16(scale)
                scale = scale * self.sizes[j] % (1 << 16)
        return out

    def spread(self, at: int, h: np.ndarray, out: np.ndarray) -> None:
        """Put a column's counts (node, number) into the cells (node, cell) of its features."""
        group = self.groups[at]
        if len(group) == 2:
            h = h.reshape(len(h), self.sizes[group[1]], self.sizes[group[0]])
            out[:, self.cells[at]] = np.concatenate([h.sum(1), h.sum(2)], 1)
        else:
            out[:, self.cells[at]] = h if len(group) == 1 else h @ self.parts[at]

    def histogram(self, spec: dict, x: np.ndarray, w: np.ndarray, s: np.ndarray, place: np.ndarray | None, k: int) -> np.ndarray:
        """(3, node, cell) of rows with their nodes' places, 0 .. k - 1 (None: all 0)."""
        out = np.empty((3, k, self.width))

        def counted(codes, bins):
            cell = codes.astype(np.int64) if place is None else place * bins + codes
            c = np.bincount(cell, minlength=k * bins)
            each = c, c if spec["kind"] == "gb" else np.bincount(cell, w, k * bins), np.bincount(cell, s, k * bins)
            return enumerate(h.reshape(k, bins) for h in each)

        for at, group in enumerate(self.groups):
            if x.shape[1] > PAIRED_ROWS * k:
                for i, h in counted(x[at], self.bins[at]):
                    self.spread(at, h, out[i])
                continue
            for j in group:  # in small nodes, where gains can be next to nothing, sums are taken row by row
                for i, h in counted(self.digit[j][x[at]], self.sizes[j]):
                    out[i, :, self.start[j]:self.start[j] + self.sizes[j]] = h
        return out

    def exits(self, tree: Tree):
        """Of a tree of 64 leaves at most: for each of its columns a table from
        numbers to the leaves, as bits from left to right, that they leave open;
        the lowest open one is a row's leaf. And the leaves' node numbers."""
        leaves, spans, todo = [], {}, [(0, False)]
        while todo:
            at, done = todo.pop()
            if done:
                spans[at] = spans[at], len(leaves)
            elif tree.feature[at] < 0:
                leaves.append(at)
            else:  # left, then a mark of where the left leaves end, then right
                spans[at] = len(leaves)
                todo += [(tree.left[at] + 1, False), (at, True), (tree.left[at], False)]
        kind = next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if len(leaves) <= 8 * np.dtype(t).itemsize)
        tables = {}
        for at, (a, b) in spans.items():
            f, every = tree.feature[at], kind(np.iinfo(kind).max)
            table = tables.setdefault(int(self.column[f]), np.full(PACKED, every))
            table[self.digit[f] > tree.cut[at]] &= every ^ kind((1 << b) - (1 << a))
        return tables, np.array(leaves, np.int64)

    @staticmethod
    def exit_of(tables: dict, x: np.ndarray) -> np.ndarray:
        """For each row the place of its leaf among the leaves from left to right."""
        if not tables:
            return np.zeros(x.shape[1], np.uint8)
        left = None
        for at, table in tables.items():
            open_ = table[x[at]]
            left = open_ if left is None else np.bitwise_and(left, open_, out=left)
        return np.bitwise_count(~left & (left - left.dtype.type(1)))


class Rows:
    """A block's rows and, for each candidate, what its trees predict so far."""

    #: Leaves of a tree that are found by tables; trees of more are followed node by node.
    FEW = 64

    def __init__(self, sizes: list, x, y, fold, key):
        self.layout = Layout(sizes)
        self.x = self.layout.pack(np.frombuffer(x, np.uint8).reshape(-1, len(sizes)))
        self.y, self.fold, self.key = np.frombuffer(y), np.frombuffer(fold, np.int32), None if key is None else np.frombuffer(key, np.int64)
        self.sum, self.seen = {}, {}

    @classmethod
    def of(cls, sizes: list, count: int, blocks) -> Rows:
        """The ``count`` rows of many blocks, each put in its place as it is read."""
        out, end = cls(sizes, b"", b"", b"", b""), 0
        out.x = np.empty((len(out.layout.groups), count), np.uint16)
        out.y, out.fold, out.key = np.empty(count), np.empty(count, np.int32), np.empty(count, np.int64)
        for x, *rest in blocks:
            x, at = np.frombuffer(x, np.uint8).reshape(-1, len(sizes)), end
            end += len(x)
            out.x[:, at:end] = out.layout.pack(x)
            for own, data in zip((out.y, out.fold, out.key), rest):
                own[at:end] = np.frombuffer(data, own.dtype)
        return out

    def some(self, at: np.ndarray) -> Rows:
        out = Rows.__new__(Rows)
        out.layout, out.x, out.y, out.fold, out.key, out.sum, out.seen = self.layout, self.x.take(at, axis=1), self.y[at], self.fold[at], self.key[at], {}, {}
        return out

    def target(self, model) -> np.ndarray:
        return self.y - self.sum[model] if model in self.sum else self.y

    def slices(self, size: int | None = None) -> list:
        size = size or SLICE_ROWS
        return [slice(a, min(a + size, len(self.y))) for a in range(0, len(self.y), size)]

    def said(self, tree: Tree, values: np.ndarray, start=None) -> np.ndarray:
        """Of each row the value of the leaf that it reaches, added to ``start``."""
        out = np.empty(len(self.y), values.dtype)
        few = (len(tree.feature) + 1) // 2 <= self.FEW
        if few:
            tables, leaves = self.layout.exits(tree)
            values = values[leaves]
        for at in self.slices():
            x = self.x[:, at]
            found = values[self.layout.exit_of(tables, x) if few else self._followed(tree, x)]
            out[at] = found if start is None else start[at] + found
        return out

    def leaves(self, tree: Tree) -> np.ndarray:
        """The leaf that each row reaches."""
        return self.said(tree, np.arange(len(tree.feature), dtype=np.int32))

    def _followed(self, tree: Tree, x: np.ndarray) -> np.ndarray:
        layout, n = self.layout, x.shape[1]
        node, flat, base = np.zeros(n, np.int32), np.ascontiguousarray(x).ravel(), layout.column * n
        live, at = np.arange(n), np.zeros(n, np.int32)
        while len(live):
            f = tree.feature[at]
            go = f >= 0
            if not go.all():
                node[live[~go]] = at[~go]
                live, at, f = live[go], at[go], f[go]
            at = tree.left[at] + (layout.digit[f, flat[base[f] + live]] > tree.cut[at])
        return node

    def histogram(self, spec: dict, model, tree_no: int, tree: Tree, nodes: np.ndarray) -> np.ndarray:
        w = row_weights(spec, tree_no, self.key, self.fold)
        place = np.full(len(tree.feature), -1)
        place[nodes] = np.arange(len(nodes))
        k = place[self.leaves(tree)]
        live = np.flatnonzero((k >= 0) & (w > 0))
        w = w[live]
        return self.layout.histogram(spec, self.x[:, live], w, self.target(model)[live] * w, k[live], len(nodes))

    def boosted(self, model, base: float, trees: list) -> None:
        """Add trees to what a boosted candidate predicts."""
        total = self.sum.get(model)
        total = np.full(len(self.y), base) if total is None else total
        for t in trees:
            total = self.said(t, t.value, total)
        self.sum[model] = total

    @staticmethod
    def stopped(spec: dict, tree: Tree) -> list:
        """For each (depth, min_samples_split) of the candidate's variants what
        the tree's nodes say: the value of the first node on the way to them
        that such a tree would not have split."""
        inner = np.flatnonzero(tree.feature >= 0)
        levels = [inner[tree.depth[inner] == d] for d in np.unique(tree.depth[inner])]
        out = []
        for d, m in spec["stops"]:
            stop = (tree.feature < 0) | (tree.depth >= (math.inf if d is None else d)) | (tree.rows < max(2, m))
            said = tree.value
            if stop[inner].any():
                said = said.copy()
                for level in levels:  # below a stop all nodes say what it says
                    up = level[stop[level]]
                    for side in (0, 1):
                        said[tree.left[up] + side] = said[up]
                        stop[tree.left[up] + side] = True
            out.append(said)
        return out

    def forest(self, spec: dict, tree: Tree) -> np.ndarray:
        """What a tree says of each row under each of the variants' stops."""
        leaf = self.leaves(tree)
        return np.stack([said[leaf] for said in self.stopped(spec, tree)])

    def sums(self, spec: dict, pred: np.ndarray) -> dict:
        total = {}
        for at in self.slices():
            for part, v in score_sums(spec, self.y[at], self.fold[at], pred[at]).items():
                total[part] = [a + b for a, b in zip(total[part], v)] if part in total else v
        return total


def score_sums(spec: dict, y: np.ndarray, fold: np.ndarray, pred: np.ndarray) -> dict:
    """Sums over the held-out, the training and the test rows that all metrics follow from."""
    out = {}
    e, o = y - pred, np.expm1(y) - np.expm1(pred)
    fine = {"test": fold == TEST, "held": (fold == spec.get("held", TEST)) & (fold != TEST)}
    fine["train"] = ~fine["test"] & ~fine["held"]
    tiny = np.maximum(np.abs(np.expm1(y)), 2.220446049250313e-16)
    for part, use in fine.items():
        if use.any():
            out[part] = [float(v) for v in (use.sum(), y[use].sum(), (y[use] ** 2).sum(), (e[use] ** 2).sum(), np.abs(e[use]).sum(),
                                            (o[use] ** 2).sum(), np.abs(o[use]).sum(), (np.abs(o[use]) / tiny[use]).sum())]
    return out


def shared_growths(candidates: list[dict], whole: bool = False) -> list[dict]:
    """Candidates (each with ``held``) that grow the same trees, as one growth:
    the largest number of trees, no stricter stop than any, and ``wanted``:
    (candidate, trees, index into ``stops``). Boosted ones that differ in
    ``min_samples_split`` alone are one growth if it is grown ``whole``, by
    ``_boost_whole``, which parts them where their trees do."""
    growths = {}
    for i, c in enumerate(candidates):
        own = {k: v for k, v in c.items() if k != "n_estimators"}
        stop = (None, 2)
        if c["kind"] == "rf":
            stop = (own.pop("max_depth", None), own.pop("min_samples_split", 2))
        elif whole:
            stop = (None, own.pop("min_samples_split", 2))
        g = growths.setdefault(json.dumps(own, sort_keys=True), {**own, "n_estimators": 0, "stops": [], "wanted": []})
        if stop not in g["stops"]:
            g["stops"].append(stop)
        g["n_estimators"] = max(g["n_estimators"], c["n_estimators"])
        g["wanted"].append((i, c["n_estimators"], g["stops"].index(stop)))
    for g in growths.values():
        if g["kind"] == "rf":
            depths = [d for d, _ in g["stops"]]
            g["max_depth"] = None if None in depths else max(depths)
            g["min_samples_split"] = min(m for _, m in g["stops"])
    return list(growths.values())


def _importance(p: int, per_tree: list) -> list:
    total = np.zeros(p)
    for gains in per_tree:
        v = np.zeros(p)
        for f, g in gains.items():
            v[f] = g
        if v.sum():
            total += v / v.sum()
    return (total / total.sum() if total.sum() else total).tolist()


# -------------------------------------------------------- one block: no rounds
class _Growth:
    """The rows of a tree that grows, those of a node together."""

    def __init__(self, rows: Rows, spec: dict, t: int):
        weights = [row_weights(spec, t, rows.key[at], rows.fold[at]) for at in rows.slices()]
        use = np.concatenate([np.flatnonzero(w > 0) + at.start for at, w in zip(rows.slices(), weights)])
        self.layout, self.spec, self.t = rows.layout, spec, t
        self.x, self.w = rows.x.take(use, axis=1), np.concatenate([w[w > 0] for w in weights])
        self.s = rows.target(0)[use] * self.w
        self.nodes, self.bounds = np.zeros(1, np.int64), np.array([0, len(use)])
        self.waiting = {}

    def search(self, tree: Tree, nodes: np.ndarray, uids: np.ndarray) -> dict:
        if len(tree.feature) > 1:
            self._descend(tree, nodes)
        size, parts = np.diff(self.bounds), []
        small = size <= SMALL
        large = np.flatnonzero(~small)
        step = max(1, SEARCH_CELLS // self.layout.width)
        for a in range(0, len(large), step):
            some = large[a:a + step]
            k = len(some)
            if some[-1] - some[0] == k - 1:
                rows = slice(self.bounds[some[0]], self.bounds[some[-1] + 1])
            else:
                rows = np.repeat(self.bounds[some] - np.cumsum(size[some]) + size[some], size[some]) + np.arange(size[some].sum())
            place = None if k == 1 else np.repeat(np.arange(k), size[some])
            hist = self.layout.histogram(self.spec, self.x[:, rows], self.w[rows], self.s[rows], place, k)
            parts.append((some, best_splits(hist, self.layout.sizes, self.spec, self.t, uids[some])))
        of_size = np.searchsorted(SMALL_SIZES, size)
        for i, m in enumerate(SMALL_SIZES):
            some = np.flatnonzero(small & (of_size == i))
            step = max(1, SEARCH_CELLS // sum(min(m, b) for b in self.layout.sizes))
            for a in range(0, len(some), step):
                parts.append((some[a:a + step], self._search_small(some[a:a + step], m, uids[some[a:a + step]])))
        if len(parts) == 1:
            return parts[0][1]
        order = np.argsort(np.concatenate([some for some, _ in parts]))
        return {n: np.concatenate([p[n] for _, p in parts])[order] for n in parts[0][1]}

    def _search_small(self, some: np.ndarray, m: int, uids: np.ndarray) -> dict:
        """The same for nodes of ``m`` rows at most: a feature of more bins than
        that has a cell for each number of rows in lower bins. Cells that this
        leaves out are empty, so sums and choices are those of all cells."""
        layout, k, size = self.layout, len(some), np.diff(self.bounds)[some]
        at = self.bounds[some] + np.arange(m)[:, None]  # (row of the node, node)
        absent = np.arange(m)[:, None] >= size
        if full := not absent.any():
            x, w, s = self.x[:, at], self.w[at].ravel(), self.s[at].ravel()
        else:
            at = np.where(absent, 0, at)
            x, w, s = self.x[:, at], np.where(absent, 0.0, self.w[at]).ravel(), np.where(absent, 0.0, self.s[at]).ravel()
        sizes = [min(m, b) for b in layout.sizes]
        hist, begin, width = np.empty((3, k, sum(sizes))), 0, np.arange(k)
        for j, cells in enumerate(sizes):
            slot = layout.digit[j][x[layout.column[j]]]
            if cells < layout.sizes[j]:
                slot = self._lower(slot, absent, full)
            cell = slot + width * cells
            if not full:
                cell[absent] = k * cells
            cell = cell.ravel()
            c = np.bincount(cell, minlength=k * cells)[:k * cells]
            each = c, c if self.spec["kind"] == "gb" else np.bincount(cell, w, k * cells)[:k * cells], np.bincount(cell, s, k * cells)[:k * cells]
            for i, h in enumerate(each):
                hist[i, :, begin:begin + cells] = h.reshape(k, cells)
            begin += cells
        found = best_splits(hist, sizes, self.spec, self.t, uids)
        # from cells back to bins
        feature, cut = found["feature"], found["cut"]
        for j, cells in enumerate(sizes):
            if cells < layout.sizes[j] and len(mine := np.flatnonzero(feature == j)):
                b = layout.digit[j][x[layout.column[j]][:, mine]]
                here = self._lower(b, absent[:, mine], full) == cut[mine]
                if not full:
                    here &= ~absent[:, mine]
                cut[mine] = np.where(here, b, 0).max(0)
        return found

    @staticmethod
    def _lower(b: np.ndarray, absent: np.ndarray, full: bool) -> np.ndarray:
        """How many rows of its node are in lower bins."""
        if not full:
            b = np.where(absent, np.uint8(255), b)
        out = np.zeros(b.shape, np.uint8)
        for row in b:
            out += row < b
        return out

    def _descend(self, tree: Tree, nodes: np.ndarray) -> None:
        """Send the rows of split nodes on to the children that are asked."""
        if self.spec.get("num_leaves") is not None:  # other nodes wait with their rows
            for i, n in enumerate(self.nodes):
                rows = slice(self.bounds[i], self.bounds[i + 1])
                self.waiting[int(n)] = self.x[:, rows], self.w[rows], self.s[rows]
            parent = int(np.flatnonzero(tree.left == nodes[-1] - (nodes[-1] - 1) % 2)[0])
            self.x, self.w, self.s = self.waiting.pop(parent)
            self.nodes, self.bounds = np.array([parent]), np.array([0, len(self.w)])
        place = np.full(len(tree.feature) + 1, -1, np.int32)
        place[nodes] = np.arange(len(nodes), dtype=np.int32)
        split = self._few if len(self.nodes) <= Rows.FEW else self._many
        src, sizes = split(tree, place, len(nodes))
        self.nodes, self.bounds = nodes, np.r_[0, np.cumsum(sizes)]
        self.x, self.w, self.s = self.x.take(src, axis=1), self.w[src], self.s[src]

    def _few(self, tree: Tree, place: np.ndarray, k: int):
        """The rows of each child's place in turn, and how many they are: node by node."""
        parts = [np.empty(0, np.int64)] * k
        for n, a, b in zip(self.nodes, self.bounds[:-1], self.bounds[1:]):
            f = tree.feature[n]
            if f >= 0:
                right = (self.layout.digit[f] > tree.cut[n])[self.x[self.layout.column[f], a:b]]
                for side, go in enumerate((~right, right)):
                    to = place[tree.left[n] + side]
                    if to >= 0:
                        parts[to] = np.flatnonzero(go) + a
        return np.concatenate(parts), [len(p) for p in parts]

    def _many(self, tree: Tree, place: np.ndarray, k: int):
        """The same, for all nodes together."""
        size = np.diff(self.bounds)
        f, m = tree.feature[self.nodes], len(self.w)
        on = np.repeat(f >= 0, size)
        f = np.repeat(np.where(f >= 0, f, 0).astype(np.int32), size)
        right = self.layout.digit[f, self.x.ravel()[self.layout.column[f] * m + np.arange(m)]] > np.repeat(tree.cut[self.nodes], size)
        to = place[np.repeat(tree.left[self.nodes], size) + right]
        on &= to >= 0
        # a row's rank among its node's rows that go its way keeps the order
        ahead = np.cumsum(right) - right
        begin = np.repeat(self.bounds[:-1], size)
        rank = ahead - ahead[np.minimum(begin, m - 1)] if m else ahead
        rank = np.where(right, rank, np.arange(m) - begin - rank)
        live = np.flatnonzero(on)
        to = to[live]
        sizes = np.bincount(to, minlength=k)
        src = np.empty(len(live), np.int64)
        src[(np.cumsum(sizes) - sizes)[to] + rank[live]] = live
        return src, sizes


class _Scan:
    """The rows of a boosted tree of few leaves: they stay where they are, and
    a search is a pass over slices of them."""

    def __init__(self, rows: Rows, spec: dict, t: int):
        self.layout, self.spec, self.t = rows.layout, spec, t
        drawn = spec.get("subsample", 1.0) < 1.0
        key = spec.get("held", TEST)
        kept = None if drawn else rows.seen.get(key)
        self.parts, seen = [], []
        for i, at in enumerate(rows.slices()):
            if kept is None:
                use = np.flatnonzero(row_weights(spec, t, None if rows.key is None else rows.key[at], rows.fold[at]) > 0).astype(np.int32)
                part = use, rows.x[:, at].take(use, axis=1)
                seen.append(part)
            else:
                part = kept[i]
            y = rows.y[at]
            self.parts.append((part[1], (y - rows.sum[0][at] if 0 in rows.sum else y)[part[0]]))
        if not drawn:
            rows.seen = {key: kept or seen}

    def search(self, tree: Tree, nodes: np.ndarray, uids: np.ndarray) -> dict:
        layout, k = self.layout, len(nodes)
        tables, leaves = layout.exits(tree)
        place = np.full(len(tree.feature), k)
        place[nodes] = np.arange(k)
        place = place[leaves]
        spare = k + (place == k).any()  # rows of other leaves are counted beside them
        total = [[np.zeros((spare, b)) for b in layout.bins] for _ in range(2)]
        for x, s in self.parts:
            node = place[layout.exit_of(tables, x)] if spare > 1 else None
            for at, b in enumerate(layout.bins):
                cell = x[at].astype(np.int64) if node is None else node * b + x[at]
                total[0][at] += np.bincount(cell, minlength=spare * b).reshape(spare, b)
                total[1][at] += np.bincount(cell, s, spare * b).reshape(spare, b)
        hist = np.empty((3, k, layout.width))
        for at in range(len(layout.bins)):
            layout.spread(at, total[0][at][:k], hist[0])
            layout.spread(at, total[1][at][:k], hist[2])
        hist[1] = hist[0]
        return best_splits(hist, layout.sizes, self.spec, self.t, uids)


def _grown(rows: Rows, spec: dict, t: int, root=None):
    """One tree on rows that are all here: (tree, gains). Boosted trees of few
    leaves are searched in passes over the rows, if those are many to a node;
    the rows of others are sent on from node to node."""
    depth, growth = spec.get("max_depth"), _Growth
    if spec["kind"] == "gb" and spec.get("num_leaves") is None and depth is not None and len(rows.y) > PAIRED_ROWS << depth and 1 << depth <= Rows.FEW:
        growth = _Scan
    step, growth, answer = growing(spec, t, root), growth(rows, spec, t), None
    try:
        while True:
            answer = growth.search(*step.send(answer))
    except StopIteration as end:
        return end.value


def _forest_tree(rows: Rows, spec: dict, t: int, out: np.ndarray) -> list:
    """One tree of a forest: what it says under each stop is added to ``out``;
    its share of the importances. Nodes of BRANCH_ROWS rows are split first;
    what is below the others is grown on their rows alone, a branch at a time."""
    least = max(2, spec.get("min_samples_split", 2))
    top, gains = _grown(rows, {**spec, "min_samples_split": max(least, BRANCH_ROWS)}, t)
    gains, uid = dict(gains), np.zeros(len(top.feature), np.uint64)
    uid[0] = _seeded(spec.get("seed", 42), t, 1)
    for n in np.flatnonzero(top.feature >= 0):  # parents are before their children
        uid[top.left[n]:top.left[n] + 2] = child_uids(uid[n:n + 1])
    leaf, said, deepest = rows.leaves(top), rows.stopped(spec, top), spec.get("max_depth")
    for n in np.flatnonzero(top.feature < 0):
        at, depth = np.flatnonzero(leaf == n), int(top.depth[n])
        grows = least <= top.rows[n] < BRANCH_ROWS and (deepest is None or depth < deepest)
        if grows:
            branch = rows.some(at)
            tree, own = _grown(branch, {**spec, "max_depth": None if deepest is None else deepest - depth}, t, uid[n])
            for f, g in own.items():
                gains[f] = gains.get(f, 0.0) + g
            below = branch.stopped({"stops": [(None if d is None else max(0, d - depth), m) for d, m in spec["stops"]]}, tree)
            ends = branch.leaves(tree)
        for k, (d, _) in enumerate(spec["stops"]):
            out[k, at] += below[k][ends] if grows and (d is None or d > depth) else said[k][n]
    return _importance(len(rows.layout.sizes), [gains])


def _boost_whole(rows: Rows, spec: dict, sizes: list):
    """All stages of a boosted growth; yields (candidate, part, sums). Its
    stops share trees up to the first one in which a node is split that one of
    them would leave whole; from there on that one's trees are grown anew."""
    w = row_weights(spec, -1, rows.key, rows.fold)
    rows.boosted(0, float((rows.y * w).sum() / max(w.sum(), 1e-300)), [])
    least = [max(2, m, spec.get("min_samples_split", 2)) for _, m in spec.get("stops", [(None, 2)])]
    ways = [(0, range(len(least)), [], rows.sum[0])]
    while ways:
        first, mine, gains, rows.sum[0] = ways.pop()
        last = max((n for _, n, stop in spec["wanted"] if stop in mine), default=spec["n_estimators"])
        own = {**spec, "min_samples_split": min(least[k] for k in mine)}
        for t in range(first, last):
            tree, used = _grown(rows, own, t)
            smallest = tree.rows[tree.feature >= 0].min(initial=math.inf)
            other = [k for k in mine if least[k] > smallest]
            if other:
                ways.append((t, other, list(gains), rows.sum[0]))
                mine = [k for k in mine if k not in other]
            gains.append(used)
            rows.boosted(0, 0.0, [tree])
            for i, trees, stop in spec["wanted"]:
                if trees == t + 1 and stop in mine:
                    yield from ((i, part, sums) for part, sums in rows.sums(spec, rows.sum[0]).items())
                    yield i, "importance", _importance(len(sizes), gains)


_OUT = "candidate int, part string, sums array<double>"


def _out(found: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int32()), pa.array([f[1] for f in found], pa.string()),
                                       pa.array([f[2] for f in found], pa.list_(pa.float64()))], ["candidate", "part", "sums"])


def _read(files: list):
    """The blocks (x, y, fold, id) of a written table, one after the other."""
    import pyarrow.fs as pafs
    import pyarrow.parquet as pq
    for name in files:
        if name.startswith("viewfs:"):
            host, path = name.split("://", 1)[1].split("/", 1)
            fs, path = pafs.HadoopFileSystem("viewfs://" + host), "/" + path
        else:
            fs, path = (pafs.LocalFileSystem(), unquote(urlparse(name).path)) if urlparse(name).scheme in ("", "file") else pafs.FileSystem.from_uri(name)
        with pq.ParquetFile(fs.open_input_file(path)) as file:
            for b in file.iter_batches(1, columns=["x", "y", "fold", "id"]):
                r = b.to_pylist()[0]
                yield r["x"], r["y"], r["fold"], r["id"]


def _boost_task(sizes: list, growths: list, count: int, files: list):
    def task(batches):
        rows = None
        for b in batches:
            for g in b.column("id").to_pylist():
                rows = rows or Rows.of(sizes, count, _read(files))
                rows.sum = {}
                yield _out(list(_boost_whole(rows, growths[g], sizes)))
    return task


def _chunk(growths: list) -> int:
    """Trees of a forest that a task grows: divides every wanted number, 10 at
    most, fewer where that would make less than FOREST_TASKS tasks."""
    whole = math.gcd(*(w[1] for g in growths for w in g["wanted"]))
    most = sum(g["n_estimators"] for g in growths) // FOREST_TASKS
    return max(d for d in range(1, max(1, min(10, most)) + 1) if whole % d == 0)


_CHUNK = "growth int, chunk int, slice int, sums binary, y binary, fold binary, gains array<double>"


def _forest_task(sizes: list, jobs: list, size: int, count: int, files: list):
    """Some trees of a forest: what they say of every row under each stop,
    added up, a slice of rows at a time; a forest's first task sends the
    slices' targets and folds along."""
    def task(batches):
        rows = None
        for b in batches:
            for job in b.column("id").to_pylist():
                rows = rows or Rows.of(sizes, count, _read(files))
                g, c, spec = jobs[job]
                pred, shares = np.zeros((len(spec["stops"]), len(rows.y))), np.zeros(len(sizes))
                for t in range(c * size, (c + 1) * size):
                    shares += _forest_tree(rows, spec, t, pred)
                for i, at in enumerate(rows.slices(SAID_ROWS)):
                    own = [rows.y[at].tobytes(), rows.fold[at].tobytes()] if c == 0 else [None, None]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([v], t) for v, t in zip((g, c, i, pred[:, at].tobytes(), *own, shares.tolist() if i == 0 else None),
                                                          (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.float64())))],
                        ["growth", "chunk", "slice", "sums", "y", "fold", "gains"])
    return task


def _forest_score_task(growths: list, size: int):
    """The chunks of each growth's slices in order: its candidates' sums where their trees are complete."""
    def task(batches):
        now, total = None, {}
        for b in batches:
            for r in b.to_pylist():
                spec = growths[r["growth"]]
                if now != (r["growth"], r["slice"]):
                    now, pred = (r["growth"], r["slice"]), 0.0
                    y, fold = np.frombuffer(r["y"]), np.frombuffer(r["fold"], np.int32)
                pred = pred + np.frombuffer(r["sums"]).reshape(len(spec["stops"]), -1)
                trees = (r["chunk"] + 1) * size
                for i, n, stop in spec["wanted"]:
                    if n == trees:
                        for part, v in score_sums(spec, y, fold, pred[stop] / trees).items():
                            total[i, part] = [a + b for a, b in zip(total[i, part], v)] if (i, part) in total else v
        yield _out([(*at, v) for at, v in total.items()])
    return task


def _jobs(blocks: DataFrame, count: int) -> DataFrame:
    """The numbers 0 .. count - 1, a task each up to 512."""
    return blocks.sparkSession.range(0, count, 1, min(count, 512))


def _fit_whole(blocks: DataFrame, sizes: list, growths: list, few: tuple):
    """Fits on a table of few blocks: a task a boosted growth, a task a few
    trees of a forest; each reads the rows, a bounded number, from the shared
    folder."""
    boosted = [s for s in growths if s["kind"] == "gb"]
    if boosted:
        for r in _jobs(blocks, len(boosted)).mapInArrow(_boost_task(sizes, boosted, *few), _OUT).collect():
            yield r["candidate"], r["part"], r["sums"]
    forests = [s for s in growths if s["kind"] == "rf"]
    if forests:
        size = _chunk(forests)
        jobs = [(g, c, s) for g, s in enumerate(forests) for c in range(s["n_estimators"] // size)]
        parts = written(_jobs(blocks, len(jobs)).mapInArrow(_forest_task(sizes, jobs, size, *few), _CHUNK), "tree-chunks")
        shares = {(r["growth"], r["chunk"]): np.array(r["gains"]) for r in parts.where("slice = 0").select("growth", "chunk", "gains").collect()}
        slices = parts.where("chunk = 0").count()
        ordered = parts.drop("gains").repartition(min(slices, 512), "growth", "slice").sortWithinPartitions("growth", "slice", "chunk")
        total = {}
        for r in ordered.mapInArrow(_forest_score_task(forests, size), _OUT).collect():
            at = r["candidate"], r["part"]
            total[at] = [a + b for a, b in zip(total[at], r["sums"])] if at in total else r["sums"]
        yield from ((i, part, sums) for (i, part), sums in total.items())
        for g, spec in enumerate(forests):
            for i, trees, _ in spec["wanted"]:
                gains = sum(shares[g, c] for c in range(trees // size))
                yield i, "importance", (gains / max(gains.sum(), 1e-300)).tolist()


# -------------------------------------------------------- many blocks: rounds
def _round_task(sizes: list, growths: list, asked: list, since: dict, width: int):
    """Histograms of all asked nodes over a block. ``asked``: (growth, tree
    number, tree, nodes, uids); ``since``: growth -> (base, trees not yet in f)."""
    def task(batches):
        total = {}
        for b in batches:
            for r in b.to_pylist():
                rows = Rows(sizes, r["x"], r["y"], r["fold"], r.get("id"))
                f = np.frombuffer(r["f"]).reshape(width, -1)
                for g, (slot, trees) in since.items():
                    rows.sum[g] = f[slot]
                    rows.boosted(g, 0.0, [Tree(t) for t in trees])
                for k, (g, t, tree, nodes, _) in enumerate(asked):
                    hist = rows.histogram(growths[g], g, t, Tree(tree), nodes)
                    total[k] = total[k] + hist if k in total else hist
        for k, hist in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([hist.tobytes()], pa.binary())], ["ask", "hist"])
    return task


def _search_task(sizes: list, growths: list, asked: list):
    def task(batches):
        total = {}
        for b in batches:
            for k, h in zip(b.column("ask").to_pylist(), b.column("hist").to_pylist()):
                h = np.frombuffer(h)
                total[k] = total[k] + h if k in total else h
        out = [(k, json.dumps({n: v.tolist() for n, v in best_splits(h, sizes, growths[asked[k][0]], asked[k][1], asked[k][4]).items()})) for k, h in total.items()]
        yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int32()), pa.array([o[1] for o in out], pa.string())], ["ask", "splits"])
    return task


_STATE = "n long, x binary, y binary, fold binary, id binary, f binary"


def _state_task(sizes: list, width: int, base: dict, since: dict):
    """The blocks with the boosted predictions f brought up to date."""
    def task(batches):
        for b in batches:
            for r in b.to_pylist():
                rows = Rows(sizes, r["x"], r["y"], r["fold"], r["id"])
                f = np.frombuffer(r["f"]).reshape(width, -1).copy() if r.get("f") is not None else np.zeros((width, r["n"]))
                for g, (slot, trees) in since.items():
                    rows.sum[g] = f[slot] + base.get(g, 0.0)
                    rows.boosted(g, 0.0, [Tree(t) for t in trees])
                    f[slot] = rows.sum[g]
                yield pa.RecordBatch.from_pylist([{**{k: r[k] for k in ("n", "x", "y", "fold", "id")}, "f": f.tobytes()}],
                                                 pa.schema([("n", pa.int64()), *[(c, pa.binary()) for c in ("x", "y", "fold", "id", "f")]]))
    return task


def _score_task(sizes: list, growths: list, base: dict, trees: dict, mark: dict):
    """Sums of the candidates of the growths in ``mark``, under their trees."""
    def task(batches):
        for b in batches:
            for r in b.to_pylist():
                rows, found = Rows(sizes, r["x"], r["y"], r["fold"], r["id"]), []
                for g, wanted in mark.items():
                    spec = growths[g]
                    for count in sorted({w[1] for w in wanted}):
                        if spec["kind"] == "gb":
                            rows.sum.pop(g, None)
                            rows.boosted(g, base[g], [Tree(t) for t in trees[g][:count]])
                            pred = [rows.sum[g]]
                        else:
                            pred = sum(rows.forest(spec, Tree(t)) for t in trees[g][:count]) / count
                        for i, n, stop in wanted:
                            if n == count:
                                found += [(i, part, s) for part, s in rows.sums(spec, pred[stop if spec["kind"] == "rf" else 0]).items()]
                yield _out(found)
    return task


def _grown_in_rounds(blocks: DataFrame, sizes: list, growths: list):
    """Grow all trees level by level with jobs over the blocks. Forest trees
    are asked in waves that fit in ROUND_CELLS; boosted candidates go in step.
    (blocks with the boosted predictions, slots, base values, trees, gains)."""
    slots = {g: i for i, g in enumerate(k for k, s in enumerate(growths) if s["kind"] == "gb")}
    width = max(1, len(slots))
    total = blocks.select("n", "y", "fold").mapInArrow(_mean_task([s.get("held", TEST) for s in growths]), "growth int, w double, s double")
    mean = {r["growth"]: r["s"] / r["w"] for r in total.groupBy("growth").agg(F.sum("w").alias("w"), F.sum("s").alias("s")).collect() if r["w"]}
    base = {g: mean.get(g, 0.0) for g in slots}
    trees, gains = {g: {} for g in range(len(growths))}, {g: {} for g in range(len(growths))}
    state = written(blocks.mapInArrow(_state_task(sizes, width, base, {g: (s, []) for g, s in slots.items()}), _STATE), "tree-state")
    kept = {g: 0 for g in slots}
    live, waiting = {}, [(g, t) for g, s in enumerate(growths) if s["kind"] == "rf" for t in range(s["n_estimators"])]
    waiting = [(g, 0) for g in slots] + waiting

    def refresh():
        nonlocal state, kept
        since = {g: (slots[g], [trees[g][i].plain() for i in range(kept[g], len(trees[g]))]) for g in slots}
        state = written(state.mapInArrow(_state_task(sizes, width, {}, since), _STATE), "tree-state")
        kept = {g: len(trees[g]) for g in slots}

    while live or waiting:
        cells = sum(len(a[1]) for _, a in live.values()) * sum(sizes) * 3
        while waiting and (not live or cells < ROUND_CELLS):
            g, t = waiting.pop(0)
            step = growing(growths[g], t)
            live[g, t] = step, next(step)
            cells += sum(sizes) * 3
        asked, cells = [], 0
        for (g, t), (_, (tree, nodes, uids)) in live.items():
            if asked and cells > ROUND_CELLS:
                break
            asked.append((g, t, tree.plain(), nodes, uids))
            cells += len(nodes) * sum(sizes) * 3
        since = {g: (slots[g], [trees[g][i].plain() for i in range(kept[g], len(trees[g]))]) for g in {a[0] for a in asked} & set(slots)}
        by_id = any(growths[a[0]]["kind"] == "rf" or growths[a[0]].get("subsample", 1.0) < 1.0 for a in asked)
        read = state.select("x", "y", "fold", "f", *(["id"] if by_id else []))
        hists = read.mapInArrow(_round_task(sizes, growths, asked, since, width), "ask int, hist binary")
        found = hists.repartition(min(len(asked), 64), "ask").mapInArrow(_search_task(sizes, growths, asked), "ask int, splits string").collect()
        for r in found:
            g, t = asked[r["ask"]][:2]
            step = live[g, t][0]
            try:
                live[g, t] = step, step.send(json.loads(r["splits"]))
            except StopIteration as end:
                trees[g][t], gains[g][t] = end.value
                del live[g, t]
                if g in slots and t + 1 < growths[g]["n_estimators"]:
                    waiting.insert(0, (g, t + 1))
        if any(len(trees[g]) - kept[g] >= REFRESH for g in slots):
            refresh()
        if slots and not live and not waiting and any(len(trees[g]) > kept[g] for g in slots):
            refresh()
    return state, slots, base, {g: [trees[g][t].plain() for t in range(len(trees[g]))] for g in trees}, gains


def _in_rounds(blocks: DataFrame, sizes: list, growths: list):
    """Fits in rounds: boosted growths in waves, so that blocks stay small, then the forests."""
    boosted, forests = ([s for s in growths if s["kind"] == k] for k in ("gb", "rf"))
    for wave in [*(boosted[a:a + ROUND_MODELS] for a in range(0, len(boosted), ROUND_MODELS)), *([forests] if forests else [])]:
        yield from _fit_in_rounds(blocks, sizes, wave)


def _fit_in_rounds(blocks: DataFrame, sizes: list, growths: list):
    state, slots, base, plain, gains = _grown_in_rounds(blocks, sizes, growths)
    for g, spec in enumerate(growths):  # a growth at a time: its trees are what a task is sent
        sums = state.mapInArrow(_score_task(sizes, growths, base, {g: plain[g]}, {g: spec["wanted"]}), _OUT)
        places = sums.select("candidate", "part", F.posexplode("sums").alias("i", "v")).groupBy("candidate", "part", "i").agg(F.sum("v").alias("v"))
        got = {}
        for r in places.collect():
            got.setdefault((r["candidate"], r["part"]), {})[r["i"]] = r["v"]
        yield from ((i, part, [v[k] for k in range(len(v))]) for (i, part), v in got.items())
        for i, count, _ in spec["wanted"]:
            yield i, "importance", _importance(len(sizes), [gains[g][t] for t in range(count)])


def _mean_task(held: list):
    def task(batches):
        w, s = np.zeros(len(held)), np.zeros(len(held))
        for b in batches:
            for r in b.to_pylist():
                y, fold = np.frombuffer(r["y"]), np.frombuffer(r["fold"], np.int32)
                for g, h in enumerate(held):
                    use = (fold != TEST) & (fold != h)
                    w[g] += use.sum()
                    s[g] += y[use].sum()
        yield pa.RecordBatch.from_arrays([pa.array(range(len(held)), pa.int32()), pa.array(w), pa.array(s)], ["growth", "w", "s"])
    return task


# ------------------------------------------------------------------ the search
def fit_all(blocks: DataFrame, sizes: list, candidates: list[dict]) -> list[dict]:
    """For each candidate {part: sums, "importance": [..]}. A candidate is a
    kind ("rf", "gb"), sklearn-named parameters and ``held``, the fold that it
    is not fitted on (none: all training rows). Unknown parameters raise."""
    _check(candidates)
    few = _few_blocks(blocks)
    growths = sorted(shared_growths(candidates, few is not None), key=lambda g: (-g["n_estimators"], -(g.get("max_depth") or math.inf)))
    out = [{} for _ in candidates]
    with settings(blocks.sparkSession, ONE_A_BATCH if few is None or any(g["kind"] == "rf" for g in growths) else {}):
        for i, part, sums in _in_rounds(blocks, sizes, growths) if few is None else _fit_whole(blocks, sizes, growths, few):
            out[i][part] = list(sums)
    return out


_PREDICTED = "candidate int, id long, prediction double"


def _rows_out(candidate: int, key: np.ndarray, prediction: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(key), candidate, np.int32)), pa.array(key), pa.array(prediction)], ["candidate", "id", "prediction"])


def boosted_predictions(blocks: DataFrame, sizes: list, candidates: list[dict]) -> DataFrame:
    """(candidate, id, prediction): what each boosted candidate, fitted without
    its held-out fold, says of every row."""
    _check(candidates)
    specs = [{**c, "wanted": []} for c in candidates]
    few = _few_blocks(blocks)
    if few is not None:
        count, files = few

        def whole(batches):
            rows = None
            for b in batches:
                for g in b.column("id").to_pylist():
                    rows = rows or Rows.of(sizes, count, _read(files))
                    rows.sum = {}
                    for _ in _boost_whole(rows, specs[g], sizes):
                        pass
                    for at in rows.slices():
                        yield _rows_out(g, rows.key[at], rows.sum[0][at])
        return _jobs(blocks, len(specs)).mapInArrow(whole, _PREDICTED)
    with settings(blocks.sparkSession, ONE_A_BATCH):
        return _predicted_in_rounds(blocks, sizes, specs)


def _predicted_in_rounds(blocks: DataFrame, sizes: list, specs: list) -> DataFrame:
    state, slots, *_ = _grown_in_rounds(blocks, sizes, specs)
    width = len(slots)

    def rows(batches):
        for b in batches:
            for r in b.to_pylist():
                f = np.frombuffer(r["f"]).reshape(width, -1)
                for g, slot in slots.items():
                    yield _rows_out(g, np.frombuffer(r["id"], np.int64), f[slot])
    return written(state.mapInArrow(rows, _PREDICTED), "tree-predictions")


def _few_blocks(blocks: DataFrame) -> tuple | None:
    """The rows and the files of a table of BLOCK_ROWS rows at most, written for all tasks to read, else None."""
    rows = blocks.agg(F.sum("n").alias("n")).first()["n"]
    if rows is None:
        raise ValueError("no rows to fit on")
    return None if rows > BLOCK_ROWS else (rows, sorted(written(blocks, "tree-blocks").inputFiles()))


def _check(candidates: list[dict]) -> None:
    known = {"kind", "held", "seed", "features", "n_estimators", "learning_rate", "max_depth", "min_samples_split", "min_samples_leaf", "max_features",
             "subsample", "bootstrap", "gamma", "reg_lambda", "min_child_weight", "num_leaves", "colsample_bytree"}
    for c in candidates:
        if set(c) - known or c["kind"] not in ("rf", "gb"):
            raise ValueError(f"unknown parameters {sorted(set(c) - known)} of {c.get('kind')!r}")


def metrics_of(sums: list) -> dict:
    n, sy, syy, sse, sae, soo, sao, mape = sums
    sst = syy - sy * sy / n
    return {"n": n, "r2": 1 - sse / sst if sst > 0 else float("nan"), "rmse": (sse / n) ** 0.5, "mae": sae / n,
            "rmse_original": (soo / n) ** 0.5, "mae_original": sao / n, "mape": 100 * mape / n}


cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need no copy of the package
