"""Embedding near-duplicates: a navigable small-world graph per shard.

Vectors are dealt into shards by hash; each shard gets a hierarchical
navigable small-world graph. Every vector queries every shard's graph; the
beam is chosen by audits over all shards (the links of sampled vectors, and
planted vectors at the threshold from a vector of the shard, which are never
absent), and widens further where a task's own audit against brute force fails;
candidates are verified by their cosine in double precision, and links become
components.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.joins import checked_broadcast
from .common import batch_rows, components, write_table

COSINE = 0.9
#: What a shard holds at most: bytes of its vectors in double precision, and vectors.
SHARD_BYTES, SHARD_ROWS = 32 << 20, 65_536
#: Vectors of a block that queries, and most blocks that a task puts to the graph it loaded.
BLOCK_ROWS, TASK_BLOCKS = 8192, 8
DEGREE = 16
#: Beam that builds a graph, and the beam that queries start with.
BEAM, QUERY_BEAM = 48, 16
#: Share of an audit's links that a beam must find, and queries in an audit.
AUDIT_RECALL, AUDIT_QUERIES = 0.99, 64
#: Vectors that the pooled audit asks of every shard; a query with up to SPARSE links in a shard counts as sparse there.
POOL_QUERIES, SPARSE = 4096, 4
#: Vectors planted for the audit of a shard, each at the threshold from one of its vectors.
PLANTED = 256
#: Kinds of the audits' links.
FEW, MANY, PLANT = 0, 1, 2
#: How far under the threshold the graph is followed around a query's neighbours.
MARGIN = 0.03
_CHUNK = 512
#: (query, node) pairs whose neighbours are looked at in one step.
_PAIRS = 32_768


def _pick(x: np.ndarray, cand: np.ndarray, sim: np.ndarray, m: int) -> np.ndarray:
    """Per row up to ``m`` of its candidates (-1: none), nearest first, each
    nearer to the row's vector than to those picked before; places left over
    go to the nearest of the rest."""
    order = np.argsort(-sim, axis=1, kind="stable")
    cand, sim = np.take_along_axis(cand, order, 1), np.take_along_axis(sim, order, 1)
    rows, width = cand.shape
    picked, count = np.full((rows, m), -1, np.int32), np.zeros(rows, np.int64)
    taken = np.zeros(cand.shape, bool)
    for k in range(width):
        c = cand[:, k]
        ok = (c >= 0) & (count < m)
        if not ok.any():
            continue
        r = np.flatnonzero(ok)
        near = np.einsum("rmd,rd->rm", x[np.maximum(picked[r], 0)], x[c[r]])
        near[picked[r] < 0] = -2
        r = r[near.max(axis=1) < sim[r, k]]
        picked[r, count[r]] = c[r]
        taken[r, k] = True
        count[r] += 1
    for k in range(width):
        r = np.flatnonzero((cand[:, k] >= 0) & ~taken[:, k] & (count < m))
        picked[r, count[r]] = cand[r, k]
        count[r] += 1
    return picked


def _beam(x: np.ndarray, links: np.ndarray, q: np.ndarray, entry: np.ndarray, ef: int, step: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Best-first search of all queries in step: (ids, similarities), at most
    ``ef`` a query, -1 where fewer were met."""
    b, n = len(q), len(x)
    rows = np.arange(b)[:, None]
    seen = np.zeros((b, n + 1), bool)  # the last column takes the -1s
    seen[:, n] = True
    ids = np.full((b, ef), -1, np.int32)
    sim = np.full((b, ef), -np.inf, np.float32)
    k = min(entry.shape[1], ef)
    ids[:, :k] = entry[:, :k]
    sim[:, :k] = np.where(ids[:, :k] >= 0, np.einsum("bkd,bd->bk", x[ids[:, :k]], q), -np.inf)
    seen[rows, ids] = True
    done = ids < 0
    while True:
        todo = np.where(done, -np.inf, sim)
        front = np.argpartition(-todo, min(step, ef) - 1, axis=1)[:, :step] if ef > step else np.tile(np.arange(ef), (b, 1))
        open_ = np.isfinite(np.take_along_axis(todo, front, 1))
        act = np.flatnonzero(open_.any(axis=1))
        if not len(act):
            return ids, sim
        node = np.where(open_[act], ids[act[:, None], front[act]], -1)
        done[act[:, None], front[act]] = True
        nb = np.where(node[..., None] >= 0, links[node], -1).reshape(len(act), -1)
        nb = np.sort(nb, axis=1)
        nb[:, 1:][nb[:, 1:] == nb[:, :-1]] = -1
        nb[seen[act[:, None], nb]] = -1
        seen[act[:, None], nb] = True
        s = np.einsum("bkd,bd->bk", x[nb], q[act], dtype=np.float32)
        s[nb < 0] = -np.inf
        all_s = np.concatenate([sim[act], s], axis=1)
        top = np.argpartition(-all_s, ef - 1, axis=1)[:, :ef]
        ids[act] = np.take_along_axis(np.concatenate([ids[act], nb], axis=1), top, 1)
        sim[act] = np.take_along_axis(all_s, top, 1)
        done[act] = np.take_along_axis(np.concatenate([done[act], nb < 0], axis=1), top, 1)


class Graph:
    """x: unit vectors (float32); layers: (node ids, links) from the base up."""

    def __init__(self, x: np.ndarray, layers: list[tuple[np.ndarray, np.ndarray]]):
        self.x, self.layers = x, layers

    @classmethod
    def build(cls, x: np.ndarray, degree: int = DEGREE, ef: int = BEAM, seed: int = 7) -> "Graph":
        """Levels are geometric. The few nodes of an upper layer are linked by
        all their similarities; at the base the upper nodes come first, then
        blocks of the others find their neighbours by search of the graph so
        far and among themselves, and links go both ways."""
        n = len(x)
        level = np.floor(-np.log(np.random.default_rng(seed).random(n) + 1e-12) / np.log(degree)).astype(int) if n else np.empty(0, int)
        self = cls(x, [])
        upper = []
        for lev in range(1, int(level.max(initial=0)) + 1):
            nodes = np.flatnonzero(level >= lev).astype(np.int32)
            upper.append((nodes, self._all(nodes, degree)))
        links = np.full((n, 2 * degree), -1, np.int32)
        first = np.flatnonzero(level >= 1).astype(np.int32)
        first = first if len(first) else np.arange(min(n, 1), dtype=np.int32)
        if len(first):
            near = self._all(first, 2 * degree)
            links[first] = np.where(near >= 0, first[near], -1)
        self.layers = [(np.arange(n, dtype=np.int32), links), *upper]
        rest = np.setdiff1d(np.arange(n, dtype=np.int32), first)
        size = max(len(first), 64)
        while len(rest):
            some, rest = rest[:min(size, 1024)], rest[min(size, 1024):]
            size += len(some)
            ids, sim = self.search(x[some], ef)
            own = x[some] @ x[some].T
            np.fill_diagonal(own, -np.inf)
            k = min(degree, max(len(some) - 1, 0))
            mate = np.argpartition(-own, max(k - 1, 0), axis=1)[:, :k] if k else np.empty((len(some), 0), int)
            cand = np.concatenate([ids, some[mate].astype(np.int32)], axis=1)
            csim = np.concatenate([sim, np.take_along_axis(own, mate, 1)], axis=1)
            links[some, :degree] = _pick(x, cand, csim, degree)
            a = np.repeat(some, degree)
            c = links[some, :degree].ravel()
            a, c = a[c >= 0], c[c >= 0]
            order = np.argsort(c, kind="stable")
            a, c = a[order], c[order]
            target, start, times = np.unique(c, return_index=True, return_counts=True)
            back = np.full((len(target), int(times.max(initial=0))), -1, np.int32)
            back[np.repeat(np.arange(len(target)), times), np.arange(len(c)) - np.repeat(start, times)] = a
            for i in range(0, len(target), 2048):
                t = target[i:i + 2048]
                cand = np.sort(np.concatenate([links[t], back[i:i + 2048]], axis=1), axis=1)
                cand[:, 1:][cand[:, 1:] == cand[:, :-1]] = -1
                csim = np.where(cand >= 0, np.einsum("bkd,bd->bk", x[cand], x[t]), -np.inf)
                keep = min(cand.shape[1], 4 * degree)
                top = np.argpartition(-csim, keep - 1, axis=1)[:, :keep]
                links[t] = _pick(x, np.take_along_axis(cand, top, 1), np.take_along_axis(csim, top, 1), 2 * degree)
        return self

    def _all(self, nodes: np.ndarray, m: int) -> np.ndarray:
        """Links among a layer's nodes, as places in ``nodes``."""
        v = self.x[nodes]
        out = np.full((len(nodes), m), -1, np.int32)
        k = min(4 * m, len(nodes) - 1)
        for i in range(0, len(nodes) if k > 0 else 0, 1024):
            s = v[i:i + 1024] @ v.T
            s[np.arange(len(s)), np.arange(i, i + len(s))] = -np.inf
            top = np.argpartition(-s, k - 1, axis=1)[:, :k]
            out[i:i + 1024] = _pick(v, top.astype(np.int32), np.take_along_axis(s, top, 1), m)
        return out

    def search(self, q: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
        """Down the layers, then a beam of ``ef`` at the base."""
        entry = np.zeros((len(q), 1), np.int32)
        for nodes, links in self.layers[:0:-1]:
            place = np.searchsorted(nodes, entry) if nodes is not self.layers[-1][0] else np.zeros_like(entry)
            ids, _ = _beam(self.x[nodes], links, q, place.astype(np.int32), 8)
            ids = np.where(ids >= 0, ids, ids.max(axis=1, keepdims=True))
            entry = nodes[ids]
        ids, sim = [], []
        for i in range(0, len(q), _CHUNK):
            e = np.sort(entry[i:i + _CHUNK], axis=1)
            e[:, 1:][e[:, 1:] == e[:, :-1]] = -1
            e = -np.sort(-e, axis=1)
            a, s = _beam(self.x, self.layers[0][1], q[i:i + _CHUNK], e, min(ef, max(len(self.x), 1)))
            ids.append(a)
            sim.append(s)
        return np.concatenate(ids), np.concatenate(sim)

    def within(self, q: np.ndarray, least: float, ef: int):
        """(query, node) pairs of similarity ``least`` or more, a chunk of
        queries at a time: around what the beam found, links are followed as
        long as they stay within ``MARGIN`` of it, so a beam full of near
        neighbours is no end."""
        base, n = self.layers[0][1], len(self.x)
        for at in range(0, len(q), _CHUNK):
            ids, sim = self.search(q[at:at + _CHUNK], ef)
            row, col = np.nonzero(sim >= least - MARGIN)
            if not len(row):
                continue
            some = np.unique(row)
            known = np.zeros((len(some), n + 1), bool)  # the last column takes the -1s
            known[:, n] = True
            known[np.arange(len(some))[:, None], ids[some]] = True
            near = sim[row, col] >= least
            got = [(row[near], ids[row, col][near].astype(np.int64))]
            todo = [(row, ids[row, col].astype(np.int64))]
            while todo:
                r, v = todo.pop()
                if len(r) > _PAIRS:
                    todo.append((r[_PAIRS:], v[_PAIRS:]))
                    r, v = r[:_PAIRS], v[:_PAIRS]
                nb = base[v]
                place = np.searchsorted(some, r)
                new = ~known[place[:, None], nb]
                code = np.unique((place[:, None] * (n + 1) + nb)[new])
                if not len(code):
                    continue
                place, v = code // (n + 1), code % (n + 1)
                known[place, v] = True
                r = some[place]
                s = np.concatenate([np.einsum("kd,kd->k", self.x[v[i:i + 65_536]], q[at + r[i:i + 65_536]]) for i in range(0, len(v), 65_536)])
                got.append((r[s >= least], v[s >= least]))
                on = s >= least - MARGIN
                if on.any():
                    todo.append((r[on], v[on]))
            yield at + np.concatenate([r for r, _ in got]), np.concatenate([v for _, v in got])


def _forest(a: np.ndarray, b: np.ndarray, root: np.ndarray) -> np.ndarray:
    """Smallest node of each node's component under the edges a - b and those
    to its ``root``."""
    own = np.arange(len(root))
    a, b = np.concatenate([a, own]), np.concatenate([b, root])
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _rows(v: bytes, dim: int) -> np.ndarray:
    return np.frombuffer(v, "<f8").reshape(-1, dim)


def _units(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x / np.abs(x).max(axis=1, keepdims=True), axis=1, keepdims=True) / np.abs(x).max(axis=1, keepdims=True)


def _graph_task(pdf: pd.DataFrame) -> pd.DataFrame:
    """A shard's rows to one row: ids, copies, unit vectors and the graph."""
    pdf = pdf.sort_values("rep")
    x = _units(np.stack(pdf["embedding"].to_numpy()).astype(np.float64))
    g = Graph.build(x.astype(np.float32))
    parts = [np.int64(len(g.layers)).tobytes()]
    for nodes, links in g.layers:
        parts += [np.int64(len(nodes)).tobytes(), np.int64(links.shape[1]).tobytes(), nodes.astype("<i4").tobytes(), links.astype("<i4").tobytes()]
    return pd.DataFrame({"dim": [int(pdf["dim"].iloc[0])], "shard": [int(pdf["shard"].iloc[0])], "ids": [pdf["rep"].to_numpy().astype("<i8").tobytes()],
                         "copies": [pdf["copies"].to_numpy().astype("<i8").tobytes()], "x": [x.astype("<f8").tobytes()], "graph": [b"".join(parts)]})


def _load(graph: bytes, x: np.ndarray) -> Graph:
    layers, at = [], 8
    for _ in range(int(np.frombuffer(graph, "<i8", 1)[0])):
        n, w = np.frombuffer(graph, "<i8", 2, at)
        at += 16
        nodes = np.frombuffer(graph, "<i4", n, at)
        links = np.frombuffer(graph, "<i4", n * w, at + 4 * n).reshape(n, w)
        at += 4 * n + 4 * n * w
        layers.append((nodes, links))
    return Graph(x.astype(np.float32), layers)


def _block_beam(g: Graph, xq: np.ndarray, x: np.ndarray, own: int | None, least: float, beam: int) -> int:
    """The least beam, ``beam`` times a power of 2, that passes the audit of
    some queries of a block; ``own``: where the block stands in the shard."""
    some = np.unique(np.linspace(0, len(xq) - 1, min(AUDIT_QUERIES, len(xq))).astype(int))
    truth = xq[some] @ x.T >= least
    if own is not None:
        truth[np.arange(len(some)), own + some] = False
    while beam < len(x) and _found(g, xq[some], truth, least, beam).sum() < AUDIT_RECALL * truth.sum():
        beam *= 2
    return beam


def _found(g: Graph, xq: np.ndarray, truth: np.ndarray, least: float, beam: int) -> np.ndarray:
    """Number of each query's true links that a beam finds."""
    out = np.zeros(len(xq), np.int64)
    for a, b in g.within(xq.astype(np.float32), least - 1e-5, beam):
        out += np.bincount(a[truth[a, b]], minlength=len(xq))
    return out


def _planted(x: np.ndarray, least: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of some vectors, and unit vectors just within the threshold of
    them in random directions."""
    at = np.unique(np.linspace(0, len(x) - 1, min(PLANTED, len(x))).astype(int))
    off = np.random.default_rng(seed).normal(size=(len(at), x.shape[1]))
    off -= np.einsum("kd,kd->k", off, x[at])[:, None] * x[at]
    size = np.linalg.norm(off, axis=1, keepdims=True)
    at, off = at[size[:, 0] > 1e-9], off[size[:, 0] > 1e-9] / size[size[:, 0] > 1e-9]
    cos = min(least + 1e-4, 1.0)
    return at, cos * x[at] + np.sqrt(1 - cos * cos) * off


def _audit_task(least: float, beam: int, pool):
    """Per shard the links of the pooled queries and of the planted vectors,
    and how many of them each beam finds (up to the beam that finds all): beam
    0 stands for the truth. Queries go in units of ``_CHUNK``."""
    def unit(g, xq, truth, kinds):
        n = truth.sum(axis=1)
        use = np.flatnonzero(n)
        truth, n, xq, kinds = truth[use], n[use], xq[use], kinds(n)[use]
        rows, ef = [(0, n)], beam
        while len(n):
            found = n if ef >= len(g.x) else _found(g, xq, truth, least, ef)
            rows.append((ef, found))
            if found.sum() >= n.sum():
                break
            ef *= 2
        return [(ef, kind, int(f[kinds == kind].sum())) for ef, f in rows for kind in np.unique(kinds).tolist()]

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                x, ids = _rows(r["x"], r["dim"]), np.frombuffer(r["ids"], "<i8")
                own_ids, xq = pool.value.get(r["dim"], (np.empty(0, np.int64), np.empty((0, r["dim"]))))
                g, out = _load(r["graph"], x), []
                for i in range(0, len(xq), _CHUNK):
                    truth = (xq[i:i + _CHUNK] @ x.T >= least) & (own_ids[i:i + _CHUNK, None] != ids[None])
                    out += [(i, *o) for o in unit(g, xq[i:i + _CHUNK], truth, lambda n: np.where(n <= SPARSE, FEW, MANY))]
                at, q = _planted(x, least, r["shard"])
                truth = np.zeros((len(at), len(x)), bool)
                truth[np.arange(len(at)), at] = True
                out += [(-1, *o) for o in unit(g, q, truth, lambda n: np.full(len(n), PLANT))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r["dim"]] * len(out), pa.int32()), pa.array([r["shard"]] * len(out), pa.int32())]
                    + [pa.array([o[i] for o in out], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.int32(), pa.int64()))],
                    names=["dim", "shard", "unit", "beam", "kind", "found"])
    return run


def pooled_beams(graphs: DataFrame, reps: DataFrame, least: float, beam: int) -> dict[int, int]:
    """Length of vectors -> the least beam (``beam`` times a power of 2) that
    finds ``AUDIT_RECALL`` of the links of sampled vectors, counted over all
    shards, as much of the links of queries that have few in a shard, so a
    dense group cannot hide sparse pairs, and as much of the planted links,
    which every shard has. Each shard reads the sample, whose size is fixed, so
    nothing but counts is shuffled."""
    spark = graphs.sparkSession
    sample: dict = {}
    for r in reps.select("dim", "rep", "embedding").orderBy(F.xxhash64("rep"), "rep").limit(POOL_QUERIES).toLocalIterator():
        sample.setdefault(r.dim, []).append((r.rep, r.embedding))
    pool = spark.sparkContext.broadcast({d: (np.array([i for i, _ in v], np.int64), _units(np.array([e for _, e in v], np.float64))) for d, v in sample.items()})
    with batch_rows(spark, 1):
        counts = write_table(graphs.select("dim", "shard", "ids", "x", "graph").mapInArrow(
            _audit_task(least, beam, pool), "dim int, shard int, unit int, beam int, kind int, found long"), "hnsw-audits")
    # a unit that stopped found all it has, so it counts as that at wider beams
    of = ["dim", "shard", "unit", "kind"]
    truth = counts.where("beam = 0").withColumnRenamed("found", "all_").drop("beam")
    total = {(r.dim, r.kind): r.n for r in truth.groupBy("dim", "kind").agg(F.sum("all_").alias("n")).collect()}
    missed: dict = {}
    short = counts.where("beam > 0").join(truth, of).where("found < all_")
    for r in short.groupBy("dim", "kind", "beam").agg(F.sum(F.col("all_") - F.col("found")).alias("n")).collect():
        missed.setdefault(r.dim, {})[r.beam, r.kind] = r.n
    out = {}
    for dim in {d for d, _ in total}:
        out[dim] = beam
        while any(missed.get(dim, {}).get((out[dim], kind), 0) > (1 - AUDIT_RECALL) * total.get((dim, kind), 0) for kind in (FEW, MANY, PLANT)):
            out[dim] *= 2
    return out


def _query_task(least: float, beams: dict[int, int]):
    """Blocks past the graphs: of each target and part, the graph's row comes
    first and stays loaded until the next."""
    def run(batches):
        x = ids = copies = g = None
        for batch in batches:
            for r in batch.to_pylist():
                if r["graph"] is not None:
                    x, ids, copies = _rows(r["x"], r["dim"]), np.frombuffer(r["ids"], "<i8"), np.frombuffer(r["copies"], "<i8")
                    g = _load(r["graph"], x)
                    continue
                xq, iq, mq = _rows(r["x"], r["dim"]), np.frombuffer(r["ids"], "<i8"), np.frombuffer(r["copies"], "<i8")
                own = r["start"] if r["shard"] == r["target"] else None
                beam = _block_beam(g, xq, x, own, least, beams.get(r["dim"], BEAM))
                n_links, root = np.zeros(len(xq) + len(x), np.int64), np.arange(len(xq) + len(x))
                for a, b in g.within(xq.astype(np.float32), least - 1e-5, beam):
                    cos = np.concatenate([np.einsum("kd,kd->k", xq[a[i:i + 65_536]], x[b[i:i + 65_536]]) for i in range(0, len(a), 65_536)])
                    ok = cos >= least
                    if own is not None:  # of a shard's own pairs the first place asks
                        ok &= b > a + own
                    a, b = a[ok], b[ok]
                    n_links += np.concatenate([np.bincount(a, weights=copies[b], minlength=len(xq)),
                                               np.bincount(b, weights=mq[a], minlength=len(x))]).astype(np.int64)
                    root = _forest(a, b + len(xq), root)
                both, use = np.concatenate([iq, ids]), np.flatnonzero(n_links)
                yield pa.RecordBatch.from_arrays([pa.array(both[use]), pa.array(both[root[use]]), pa.array(n_links[use])], names=["a", "b", "n"])
    return run


def _asks(graphs: DataFrame, shards: DataFrame) -> DataFrame:
    """Blocks of each shard's vectors, once for each target from the shard on,
    and a row of the target's graph before each part of its blocks."""
    n = F.floor(F.octet_length("ids") / 8)
    of = graphs.join(shards, "dim").withColumn("start", F.explode(F.sequence(F.lit(0).cast("long"), n - 1, F.lit(BLOCK_ROWS).cast("long"))))

    def cut(c, width):
        return F.substring(F.col(c), (F.col("start") * width + 1).cast("int"), (F.lit(BLOCK_ROWS) * width).cast("int"))
    blocks = of.select("dim", "shard", "shards", "start", cut("ids", 8).alias("ids"), cut("copies", 8).alias("copies"),
                       cut("x", F.col("dim") * 8).alias("x"))
    size = blocks.groupBy().agg(F.sum(F.col("shards") - F.col("shard"))).first()[0] or 0
    per = min(TASK_BLOCKS, max(1, size // (4 * graphs.sparkSession.sparkContext.defaultParallelism)))
    asks = blocks.withColumn("target", F.explode(F.sequence(F.col("shard"), F.col("shards") - 1))).drop("shards")
    # a block's place among all blocks of its target, without a window: shards have at most so many blocks
    most = graphs.agg(F.max(F.ceil(F.octet_length("ids") / 8 / BLOCK_ROWS))).first()[0] or 1
    asks = asks.withColumn("part", F.floor((F.col("shard") * most + F.col("start") / BLOCK_ROWS) / per)).withColumn("graph", F.lit(None).cast("binary"))
    parts = asks.select("dim", "target", "part").distinct()
    loads = parts.join(graphs.withColumnRenamed("shard", "target"), ["dim", "target"]).select(
        "dim", F.col("target").alias("shard"), F.lit(-1).cast("long").alias("start"), "ids", "copies", "x", "target", "part", "graph")
    both = loads.unionByName(asks)
    return (both.repartition(max(1, parts.count()), "dim", "target", "part")
            .sortWithinPartitions("dim", "target", "part", "start", "shard"))


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE,
                    shard_rows: int = SHARD_ROWS, beam: int = QUERY_BEAM) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Vectors link at a cosine of ``cosine`` or more, verified in double
    precision; a component is what links reach. Vectors that are null, empty,
    zero, or hold null or non-finite components link with nothing, and vectors
    of different lengths do not link. Rows that repeat an id are one vector
    (the smallest); a null id links with nothing (component null, kept).

    Equal vectors collapse before any search and count with their number. A
    shard holds ``SHARD_BYTES`` of vectors (``shard_rows`` at most). Blocks of
    each shard pass the graph of every shard from their own on, with the beam
    that the pooled audit chose; a task loads one graph for up to
    ``TASK_BLOCKS`` blocks and returns a count and a spanning edge per vector,
    never all pairs, so a dense cluster costs no more rows than a sparse one.
    Shards are dealt by hash: no cluster fills one. An empty table gives no
    rows; other columns are left out."""
    spark = vectors.sparkSession
    v = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector_col}`").cast("array<double>").alias("embedding"))
    own = write_table(v.where("vec_id IS NOT NULL").groupBy("vec_id").agg(F.min("embedding").alias("embedding")), "hnsw-vectors")
    fine = (F.size("embedding") > 0) & F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists(
        "embedding", lambda c: c != 0)
    good = own.where("embedding IS NOT NULL").where(fine)
    reps = write_table(good.groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
                       .withColumn("dim", F.size("embedding")), "hnsw-reps")
    rows = F.least(F.lit(shard_rows), F.greatest(F.lit(64), F.floor(F.lit(SHARD_BYTES) / (F.col("dim") * 8))))
    shards = reps.groupBy("dim").agg(F.count("*").alias("n")).select("dim", F.ceil(F.col("n") / rows).cast("int").alias("shards"))
    dealt = reps.join(checked_broadcast(shards), "dim").withColumn("shard", F.pmod(F.xxhash64("rep"), F.col("shards")).cast("int"))
    graphs = write_table(dealt.groupBy("dim", "shard").applyInPandas(
        _graph_task, "dim int, shard int, ids binary, copies binary, x binary, graph binary"), "hnsw-graphs")
    beams = pooled_beams(graphs, reps, cosine, beam)
    with batch_rows(spark, 1):
        found = write_table(_asks(graphs, shards).mapInArrow(_query_task(cosine, beams), "a long, b long, n long"), "hnsw-links")
    counts = found.groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("found"))
    roots = components(found.select("a", "b")).select(F.col("node").alias("rep"), F.col("root").alias("component"))
    placed = (reps.select("embedding", "rep", "copies").join(counts, "rep", "left").join(roots, "rep", "left")
              .select(F.col("embedding").alias("e"), (F.coalesce("found", F.lit(0)) + F.col("copies") - 1).alias("links"),
                      F.coalesce("component", "rep").alias("component")))
    out = (own.join(placed, F.col("embedding") == F.col("e"), "left")
           .select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id")))
    none = v.where("vec_id IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.union(none).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
