"""Near-duplicates by DartMinHash.

Darts are thrown by hash into the region (weight x rank) of every element of a
document's weighted shingle set; the earliest dart of each coordinate is the
signature, so two sets agree in a coordinate with the probability of their
weighted Jaccard similarity. Bands of coordinates are joined, candidates are
verified exactly and linked documents become classes.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, maybe_in, small_batches, without_ids, write_table

SHINGLE_WORDS = 5
SIMILARITY = 0.8
BANDS = 25
ROWS = 5
#: Signature agreement below which a candidate cannot reach the similarity: 7 standard deviations under 0.8.
SLACK = 7.0
#: Buckets of so many members, or fewer, are paired whole once their centre is done.
PAIRED_MEMBERS = 32
#: Rounds of checks against a centre before the members left are checked with each other.
STAR_TURNS = 2
WORD = re.compile(r"\w+")


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply and shift rounds)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _unit(h: np.ndarray) -> np.ndarray:
    """Hash to a double in (0, 1]."""
    return ((h >> np.uint64(11)).astype(np.float64) + 1.0) * 2.0 ** -53


def shingle_sets(texts: list, size: int = SHINGLE_WORDS) -> list[tuple[np.ndarray, np.ndarray, bytes]]:
    """Per text: sorted distinct shingle hashes, their counts, and a digest of
    the whole word sequence. Words are lower-cased runs of word characters. A
    text of fewer words than a shingle is one shingle of all its words; a null
    text or one without words has none."""
    words = [WORD.findall(t.lower()) if t else [] for t in texts]
    lens = np.array([len(w) for w in words], dtype=np.int64)
    flat = np.empty(int(lens.sum()), dtype=object)
    flat[:] = [w for ws in words for w in ws]
    codes, distinct = pd.factorize(flat)
    hashed = np.array([xxhash.xxh3_64_intdigest(w) for w in distinct], dtype=np.uint64)[codes] if len(flat) else np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        rolled = np.zeros(max(0, len(hashed) - size + 1), dtype=np.uint64)
        for k in range(size):
            rolled = rolled * np.uint64(0x9E3779B97F4A7C15) + hashed[k:k + len(rolled)]
        rolled = _mix(rolled)
    out, at = [], 0
    for n in lens:
        own = hashed[at:at + n]
        digest = xxhash.xxh3_128_digest(own.tobytes())
        if n >= size:
            found, counts = np.unique(rolled[at:at + n - size + 1], return_counts=True)
        elif n:
            found, counts = np.array([xxhash.xxh3_64_intdigest(own.tobytes(), seed=int(n))], dtype=np.uint64), np.ones(1, np.int64)
        else:
            found, counts = np.empty(0, np.uint64), np.empty(0, np.int64)
        out.append((found, counts, digest))
        at += n
    return out


def dart_signatures(sets: list[tuple[np.ndarray, np.ndarray]], k: int, seed: int = 1) -> np.ndarray:
    """(elements, weights) per set -> (len(sets), k) dart hashes; empty sets: 0.

    The weight axis of an element is cut into slabs [2^v - 1, 2^(v+1) - 1).
    In a slab darts arrive along the rank axis as a Poisson process of rate
    2^v whose gaps, weight positions and coordinates are hashes of (element,
    slab, arrival): the same for every set that holds the element. A dart
    counts if its weight position is below the element's weight. Ranks are
    followed up to t / total weight with t = k ln k + 2k, which leaves few
    coordinates empty; sets with an empty one go on to twice the rank."""
    sig = np.zeros((len(sets), k), dtype=np.uint64)
    todo = np.array([i for i, (e, _) in enumerate(sets) if len(e)], dtype=np.int64)
    far = np.array([(k * np.log(k) + 2 * k) / max(float(np.sum(w)), 1e-300) if len(e) else 0.0 for e, w in sets])
    old = np.seterr(over="ignore")
    while len(todo):
        el = np.concatenate([sets[i][0] for i in todo])
        wt = np.concatenate([np.asarray(sets[i][1], dtype=np.float64) for i in todo])
        own = np.repeat(np.arange(len(todo)), [len(sets[i][0]) for i in todo])
        end = far[todo]
        cells, ranks, names = [], [], []
        for v in range(int(np.floor(np.log2(wt.max() + 1))) + 1 if len(wt) else 0):
            low, width = 2.0 ** v - 1, 2.0 ** v
            live = np.flatnonzero(wt > low)
            rank, base = np.zeros(len(live)), _mix(el[live] + np.uint64((0xA0761D6478BD642F * (v + 1) + seed) & (2 ** 64 - 1)))
            step = 0
            while len(live):
                step += 1
                h = _mix(base + np.uint64(step) * np.uint64(0xE7037ED1A0B428DB))
                rank = rank - np.log(_unit(h)) / width
                on = rank < end[own[live]]
                live, rank, base, h = live[on], rank[on], base[on], h[on]
                name = _mix(h ^ np.uint64(0x8EBC6AF09C88C6E3))
                hit = low + width * _unit(_mix(name + np.uint64(1))) <= wt[live] if v or wt.min() < 1 else slice(None)
                cells.append(own[live][hit] * k + (name[hit] % np.uint64(k)).astype(np.int64))
                ranks.append(rank[hit])
                names.append(name[hit])
        cell, rank, name = np.concatenate(cells), np.concatenate(ranks), np.concatenate(names)
        order = np.lexsort((rank, cell))
        cell = cell[order]
        first = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]]) if len(cell) else np.empty(0, np.int64)
        block = np.zeros(len(todo) * k, dtype=np.uint64)
        filled = np.zeros(len(todo) * k, dtype=bool)
        block[cell[first]] = name[order][first]
        filled[cell[first]] = True
        sig[todo] = block.reshape(-1, k)
        todo = todo[~filled.reshape(-1, k).all(axis=1)]
        far[todo] *= 2
    np.seterr(**old)
    return sig


def _lists(rows: np.ndarray) -> pa.ListArray:
    n, k = rows.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * k, k, dtype=np.int32)), pa.array(rows.reshape(-1)))


def _sketcher(size: int, bands: int, rows: int, weighted: bool):
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = shingle_sets(part.column(1).to_pylist(), size)
                sig = dart_signatures([(e, c if weighted else np.ones(len(e))) for e, c, _ in sets], bands * rows)
                with np.errstate(over="ignore"):
                    band = np.repeat(np.arange(1, bands + 1, dtype=np.uint64)[None], len(sets), axis=0)
                    for r in range(rows):
                        band = _mix(band * np.uint64(0x9E3779B97F4A7C15) + sig[:, r::rows])
                short = (sig & np.uint64(0xFFFF)).astype("<u2")
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([d for *_, d in sets], pa.binary()),
                     pa.array([len(e) if not weighted else int(c.sum()) for e, c, _ in sets], pa.int64()),
                     _lists(band.view(np.int64)), pa.array([s.tobytes() for s in short], pa.binary())],
                    names=["doc_id", "digest", "n", "bands", "sig"])
    return run


def _shingler(size: int, weighted: bool):
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = shingle_sets(part.column(1).to_pylist(), size)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([e.astype("<u8").tobytes() for e, _, _ in sets], pa.binary()),
                     pa.array([c.astype("<i4").tobytes() if weighted else b"" for _, c, _ in sets], pa.binary())],
                    names=["doc_id", "els", "cnt"])
    return run


def _agreer(least: float):
    """Candidates whose signatures agree in too few coordinates are no pairs."""
    def run(batches):
        for b in batches:
            x = [np.frombuffer(v, "<u2") for v in b.column("sig_a").to_pylist()]
            y = [np.frombuffer(v, "<u2") for v in b.column("sig_b").to_pylist()]
            keep = np.array([np.mean(p == q) >= least for p, q in zip(x, y)], dtype=bool)
            yield pa.RecordBatch.from_arrays([b.column("a").filter(pa.array(keep)), b.column("b").filter(pa.array(keep))],
                                             names=["a", "b"])
    return run


def weighted_jaccard(ea, ca, eb, cb) -> float:
    """Sum of minima over sum of maxima of two weighted sets (sorted elements)."""
    _, i, j = np.intersect1d(ea, eb, assume_unique=True, return_indices=True)
    both = float(np.minimum(ca[i], cb[j]).sum())
    return both / max(float(ca.sum() + cb.sum()) - both, 1e-300)


def _verifier(similarity: float, weighted: bool):
    def run(batches):
        for b in batches:
            cols = [b.column(c).to_pylist() for c in ("els_a", "cnt_a", "els_b", "cnt_b")]
            keep = []
            for ea, ca, eb, cb in zip(*cols):
                ea, eb = np.frombuffer(ea, "<u8"), np.frombuffer(eb, "<u8")
                wa = np.frombuffer(ca, "<i4") if weighted else np.ones(len(ea))
                wb = np.frombuffer(cb, "<i4") if weighted else np.ones(len(eb))
                keep.append(weighted_jaccard(ea, wa, eb, wb) >= similarity)
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column("a").filter(mask), b.column("b").filter(mask)], names=["a", "b"])
    return run


def _sets(docs: DataFrame, ids: DataFrame, size: int, weighted: bool) -> DataFrame:
    """Shingle sets of the documents of one column of ids. A bitmap of fixed
    size keeps most other texts out of the shuffle."""
    ids = write_table(ids.toDF("doc_id").distinct(), "dart-ids")
    sets = (maybe_in(docs, "doc_id", ids).where("maybe_").select("doc_id", "text")
            .mapInArrow(_shingler(size, weighted), "doc_id long, els binary, cnt binary")
            .join(ids, "doc_id", "left_semi").dropDuplicates(["doc_id"]))
    return write_table(sets, "dart-sets")


def _verified(pairs: DataFrame, sketches: DataFrame, docs: DataFrame, size: int, similarity: float,
              weighted: bool, k: int) -> DataFrame:
    """Pairs (a, b) of representatives -> those that reach the similarity.

    Signatures that agree in too few coordinates settle most pairs; the others
    are verified on their shingle sets."""
    least = similarity - SLACK * (similarity * (1 - similarity) / k) ** 0.5
    s = sketches.select("doc_id", "sig")
    close = write_table(
        pairs.join(s.toDF("a", "sig_a"), "a").join(s.toDF("b", "sig_b"), "b")
        .select("a", "b", "sig_a", "sig_b").mapInArrow(_agreer(least), "a long, b long"), "dart-close")
    sets = _sets(docs, close.select(F.col("a").alias("doc_id")).union(close.select("b")), size, weighted)
    both = (close.join(sets.toDF("a", "els_a", "cnt_a"), "a").join(sets.toDF("b", "els_b", "cnt_b"), "b")
            .select("a", "b", "els_a", "cnt_a", "els_b", "cnt_b"))
    return write_table(both.mapInArrow(_verifier(similarity, weighted), "a long, b long"), "dart-links")


def _strangers(weighted: bool):
    """Per member and its centres a row for each shingle that the member has
    and the centres together lack (or have fewer times), and one row without a
    shingle; all with o, the weight that the member shares with them."""
    def run(batches):
        for b in batches:
            out = {"c1": [], "c2": [], "rep": [], "n": [], "root": [], "o": [], "el": []}
            for r in b.to_pylist():
                sets = [np.frombuffer(r[k], "<u8") for k in ("els_x", "els_1", "els_2")]
                ws = [np.frombuffer(r[k], "<i4") if weighted else np.ones(len(e)) for k, e in zip(("cnt_x", "cnt_1", "cnt_2"), sets)]
                ex, wx, best = sets[0], ws[0], np.zeros(len(sets[0]))
                for ec, wc in zip(sets[1:], ws[1:]):
                    _, i, j = np.intersect1d(ex, ec, assume_unique=True, return_indices=True)
                    best[i] = np.maximum(best[i], wc[j])
                own = [None, *ex[best < wx].view("<i8").tolist()]
                for name, v in (*((k, r[k]) for k in ("c1", "c2", "rep", "n", "root")), ("o", float(np.minimum(wx, best).sum()))):
                    out[name] += [v] * len(own)
                out["el"] += own
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.float64() if k == "o" else pa.int64()) for k, v in out.items()], names=list(out))
    return run


def _rest(placed: DataFrame, centers: list[DataFrame], known: DataFrame, size: int, similarity: float, weighted: bool, ratio) -> DataFrame:
    """All pairs between components of the buckets left open that can be links.

    Buckets of few members are paired whole. In a large one let C hold all that
    its first and last centre hold. Linked x and y have |x n y| >= s / (1 + s)
    (|x| + |y|). If they share no shingle that C lacks, then |x n y| <=
    min(|x n C|, |y n C|). So members are joined on shingles that C lacks, of
    which copies of one text that are not copies of each other have few in
    common, and besides only pairs are made whose overlaps with C are that
    large. Both hold for weights too."""
    side = placed.select("bucket", "rep", "n", "root")
    counts = side.groupBy("bucket").agg(F.count("*").alias("m"))
    small = side.join(counts.where(F.col("m") <= PAIRED_MEMBERS).select("bucket"), "bucket", "left_semi")
    pairs = (small.toDF("bucket", "a", "n_a", "root_a").join(small.toDF("bucket", "b", "n_b", "root_b"), "bucket")
             .where("root_a < root_b").where(ratio).select("a", "b"))
    last = centers[-1].select("bucket", F.col("center").alias("c2"))
    large = write_table(side.join(counts.where(F.col("m") > PAIRED_MEMBERS).select("bucket"), "bucket", "left_semi")
                        .join(centers[0].select("bucket", F.col("center").alias("c1")), "bucket").join(last, "bucket", "left")
                        .select("c1", F.coalesce("c2", "c1").alias("c2"), "rep", "n", "root").distinct(), "dart-large")
    if not large.isEmpty():
        # any C will do: buckets of one first centre share the last centre that most of their members have
        common = large.groupBy("c1", "c2").count().groupBy("c1").agg(F.max(F.struct("count", F.col("c2").alias("c"))).alias("x"))
        large = large.drop("c2").distinct().join(common.select("c1", F.col("x.c").alias("c2")), "c1")
        sets = _sets(known, large.select("rep").union(large.select("c1")).union(large.select("c2")), size, weighted)
        own = (large.join(sets.toDF("rep", "els_x", "cnt_x"), "rep").join(sets.toDF("c1", "els_1", "cnt_1"), "c1")
               .join(sets.toDF("c2", "els_2", "cnt_2"), "c2")
               .mapInArrow(_strangers(weighted), "c1 long, c2 long, rep long, n long, root long, o double, el long"))
        own = write_table(own, "dart-strangers")
        loose = own.where("el IS NOT NULL").select("c1", "c2", "el", "rep", "n", "root")
        shared = (loose.toDF("c1", "c2", "el", "a", "n_a", "root_a").join(loose.toDF("c1", "c2", "el", "b", "n_b", "root_b"), ["c1", "c2", "el"])
                  .where("root_a < root_b").where(ratio).select("a", "b"))
        part = similarity / (1 + similarity)
        within = own.where("el IS NULL").select("c1", "c2", "rep", "n", "root", "o").where(F.col("o") >= similarity * F.col("n") - 1e-6)
        inner = (within.toDF("c1", "c2", "a", "n_a", "root_a", "o_a").join(within.toDF("c1", "c2", "b", "n_b", "root_b", "o_b"), ["c1", "c2"])
                 .where("root_a < root_b").where(ratio).where(F.least("o_a", "o_b") >= part * (F.col("n_a") + F.col("n_b")) - 1e-6).select("a", "b"))
        pairs = pairs.union(shared).union(inner)
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _stars(placed: DataFrame, ratio, last: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(centre of each bucket, its pairs with the members of other components).

    The centre is the most popular member: the one that shares buckets with
    most others, as the original of many copies does. ``last`` gives buckets'
    former centres, whose components are not chosen again."""
    best = placed
    if last is not None:
        best = placed.join(last.select("bucket", F.col("root").alias("not_root")), "bucket").where("root <> not_root")
    top = (best.groupBy("bucket").agg(F.max(F.struct("pop", (-F.col("rep")).alias("neg"), "root", "n")).alias("t"))
           .select("bucket", (-F.col("t.neg")).alias("center"), F.col("t.root").alias("root"), F.col("t.n").alias("n_a")))
    top = write_table(top, "dart-centers")
    pairs = (placed.withColumnRenamed("n", "n_b").join(top.withColumnRenamed("root", "root_c"), "bucket").where("root <> root_c").where(ratio)
             .select(F.least("center", "rep").alias("a"), F.greatest("center", "rep").alias("b")).distinct())
    return top, pairs


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE_WORDS,
                    similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS,
                    weighted: bool = False) -> DataFrame:
    """One row per document: doc_id, class_id (the smallest doc_id of its class
    of near-duplicates), kept (doc_id = class_id).

    Two documents are linked if the Jaccard similarity of their shingle sets
    (``weighted``: of the shingle counts) is at least ``similarity``; a class is
    a connected component of links. With the default 25 bands of 5 rows a pair
    of similarity 0.8 shares a band but for 1 in 20,000, of 0.85 but for 1 in
    1.6 million. Null texts and texts without words link with nothing. Rows
    that repeat a doc_id are one document, its class that of any of them;
    a null doc_id forms no class (class_id null, kept true).

    Copies of one word sequence collapse by digest before any join (a group
    aggregate that is combined map-side). In a band's bucket every member is
    checked against a centre, the member that meets most others; buckets whose
    members then lie in several components take further centres, and in the
    end all members left are checked between components. So a group of n alike
    documents costs about n checks, and no pair that shares a band stays
    untested unless its members are joined already."""
    spark = docs.sparkSession
    small_batches(spark)
    base = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    known = base.where("doc_id IS NOT NULL")
    sketches = write_table(known.mapInArrow(_sketcher(size, bands, rows, weighted),
                                            "doc_id long, digest binary, n long, bands array<long>, sig binary"), "dart-sketches")
    reps = write_table(sketches.where("n > 0").groupBy("digest").agg(F.min_by(F.struct("doc_id", "n", "bands", "sig"), "doc_id").alias("r"))
                       .select("digest", "r.*"), "dart-reps")
    member = reps.select(F.col("doc_id").alias("rep"), "n", F.explode("bands").alias("bucket"))
    shared = member.groupBy("bucket").agg(F.count("*").alias("m")).where("m > 1")
    member = write_table(member.join(shared, "bucket"), "dart-members")
    popular = member.groupBy("rep").agg(F.sum("m").alias("pop"))
    member = write_table(member.join(popular, "rep").select("bucket", "rep", "n", "pop"), "dart-members")
    ratio = F.least("n_a", "n_b") >= similarity * F.greatest("n_a", "n_b")
    args = (reps, known, size, similarity, weighted, bands * rows)
    placed = member.withColumn("root", F.col("rep"))
    center, pairs = _stars(placed, ratio)
    centers = [center]
    links = _verified(pairs, *args)
    for turn in range(STAR_TURNS):
        roots = components(links)
        placed = write_table(member.join(roots.toDF("rep", "root"), "rep", "left")
                             .select("bucket", "rep", "n", "pop", F.coalesce("root", "rep").alias("root")), "dart-placed")
        mixed = placed.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("m")).where("lo <> hi")
        placed = placed.join(mixed.select("bucket"), "bucket", "left_semi")
        pairs_left, members_left = mixed.agg(F.sum(F.expr("m * (m - 1) / 2")), F.sum("m")).first()
        if not members_left or pairs_left <= 4 * members_left or turn == STAR_TURNS - 1:
            break
        was = center.select("bucket", F.col("center").alias("rep")).join(placed.select("bucket", "rep", "root"), ["bucket", "rep"])
        center, pairs = _stars(placed, ratio, was)
        centers.append(center)
        links = links.union(_verified(pairs, *args))
    if members_left:
        more = _verified(write_table(_rest(placed, centers, known, size, similarity, weighted, ratio), "dart-rest"), *args)
        if not more.isEmpty():
            roots = components(links.union(more))
    copies = sketches.where("n > 0").select("doc_id", "digest").join(reps.select("digest", F.col("doc_id").alias("rep")), "digest")
    classes = (copies.join(roots.toDF("rep", "root"), "rep", "left")
               .groupBy("doc_id").agg(F.min(F.coalesce("root", "rep")).alias("class_id")))
    lone = sketches.where("n = 0").select("doc_id", F.col("doc_id").alias("class_id")).distinct()
    none = base.where("doc_id IS NULL").select("doc_id", F.col("doc_id").alias("class_id"))
    return classes.union(lone.join(classes, "doc_id", "left_anti")).union(none).select(
        "doc_id", "class_id", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(True)).alias("kept"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **knobs) -> DataFrame:
    """One document of each class, with the columns of ``docs``; rows of a null
    id stay, and of rows that repeat an id one stays."""
    classes = write_table(near_duplicates(docs, id_col, text_col, **knobs), "dart-classes")
    out = without_ids(docs, id_col, classes.where("NOT kept").select("doc_id"))
    again = docs.where(F.col(f"`{id_col}`").isNotNull()).groupBy(F.col(f"`{id_col}`").alias("id_")).count().where("count > 1").select("id_")
    again = write_table(again, "dart-again")
    if again.isEmpty():
        return out
    marked = maybe_in(out, id_col, again)
    more = marked.where("maybe_").drop("maybe_")
    return marked.where("NOT maybe_").drop("maybe_").unionByName(more.dropDuplicates([id_col]))
