"""Vector code compression: integer product quantisation with exact products.

Vectors become integers and are cut into parts; each part has a codebook that
rounds of assignment and averaging refine, and is coded by the index of its
nearest entry. Nearest entries come from matrix products of limbs: the
integers are broken into limbs so short that every float64 product sum stays
below 2^53, where BLAS is exact; limb products are put together again in
int64, and the first smallest distance wins. A round is one pass: a task
assigns its vectors and returns a count and a sum per entry, Spark adds those
up, and the driver holds nothing but the codebooks.
"""

from __future__ import annotations

import hashlib
import json
import math
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of the contract.
SCALE = 1024
PARTS = 4
ENTRIES = 256
ROUNDS = 4
#: Vectors a task compares at once.
BLOCK = 4096
#: Sums leave a task in digits of this many bits, so that adding them up stays in a long.
DIGIT = 30
LIMIT = 1 << 63


def limbs(x: np.ndarray, bits: int) -> list:
    """Signed limbs of int64 values, lowest first, as float64: the values are
    the sum of limb k times 2^(k*bits), every limb within 2^(bits-1)."""
    out, half = [], 1 << (bits - 1)
    while True:
        low = ((x + half) & ((1 << bits) - 1)) - half
        out.append(low.astype(np.float64))
        x = (x - low) >> bits
        if not x.any():
            return out


def exact_products(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """x @ c.T of int64 matrices whose true result fits in int64. A sum of d
    products of two limbs is at most d * 2^(2*bits-2), kept below 2^53."""
    bits = (53 - max(1, x.shape[1]).bit_length()) // 2 + 1
    out = np.zeros((len(x), len(c)), np.int64)
    right = limbs(c, bits)
    for i, a in enumerate(limbs(x, bits)):
        for j, b in enumerate(right):
            if (i + j) * bits < 64:
                out += (a @ b.T).astype(np.int64) << np.int64((i + j) * bits)
    return out


def _fits(x: np.ndarray, c: np.ndarray) -> bool:
    """Whether all squared distances are below 2^63."""
    if x.dtype == object or c.dtype == object:
        return False
    most = sum(max(abs(int(v.min())), abs(int(v.max()))) if v.size else 0 for v in (x, c))
    return x.shape[1] * most * most < LIMIT


def nearest(x: np.ndarray, c: np.ndarray):
    """(index of the nearest row of c, the first of equals; its squared
    distance) for every row of x. Values too large for int64 arithmetic are
    compared as Python integers, with the same result."""
    if not _fits(x, c):
        rows = [[sum((int(a) - int(b)) ** 2 for a, b in zip(v, e)) for e in c.tolist()] for v in x.tolist()]
        at = [d.index(min(d)) for d in rows]
        return np.array(at, np.int64), [d[k] for d, k in zip(rows, at)]
    at, far = np.empty(len(x), np.int64), np.empty(len(x), np.int64)
    sq = (c * c).sum(1)
    for s in range(0, len(x), BLOCK):
        v = x[s:s + BLOCK]
        d = sq[None, :] - 2 * exact_products(v, c)  # the vector's own square is the same for all entries
        k = d.argmin(1)
        at[s:s + BLOCK] = k
        far[s:s + BLOCK] = d[np.arange(len(v)), k] + (v * v).sum(1)
    return at, far


def to_integers(flat: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x): int64, or Python integers where those don't fit."""
    flat = np.asarray(flat, np.float64)
    if not flat.size or np.abs(flat).max() < 2.0 ** 60 / scale:
        y = np.floor(flat * scale)
        if math.frexp(scale)[0] == 0.5:  # a power of two scales exactly
            return y.astype(np.int64)
    return np.array([math.floor(Fraction(v) * scale) for v in flat.tolist()] or [], object)


def cuts(dim: int, parts: int) -> list:
    """Where the parts of a vector begin and end; equal where ``parts`` divides ``dim``."""
    return [dim * i // parts for i in range(parts + 1)]


@dataclass
class Codebooks:
    """``books[p]``: the entries of part p, lists of integers."""
    dim: int
    parts: int
    scale: int
    books: list

    def digest(self) -> str:
        """sha256 of all components by part, entry and position, as decimals parted by commas."""
        text = ",".join(str(v) for book in self.books for e in book for v in e)
        return hashlib.sha256(text.encode()).hexdigest()

    def plain(self) -> str:
        """What tasks get: plain JSON, so workers need no copy of this class."""
        return json.dumps([self.dim, self.parts, self.scale, self.books])


def _blocks(state: str):
    """A function from an Arrow list array to (rows of the table's length,
    their parts as integer matrices, the codebooks as matrices)."""
    dim, parts, scale, books = json.loads(state)
    edge = cuts(dim, parts)

    def matrix(rows, width):
        most = max((abs(v) for r in rows for v in r), default=0)
        return np.array(rows, np.int64 if most < 1 << 62 else object).reshape(len(rows), width)
    books = [matrix(b, edge[p + 1] - edge[p]) for p, b in enumerate(books)]

    def cut(vectors):
        length = vectors.value_lengths().to_numpy(zero_copy_only=False)
        mine = np.flatnonzero(length == dim)
        whole = vectors.take(pa.array(mine)).flatten() if len(mine) < len(vectors) else vectors.flatten()
        x = to_integers(whole.to_numpy(zero_copy_only=False), scale).reshape(len(mine), dim)
        return mine, [x[:, edge[p]:edge[p + 1]] for p in range(parts)], books
    return cut


def _sums_task(state: str):
    def task(batches):
        cut = _blocks(state)
        total = {}
        for b in batches:
            _, parts, books = cut(b.column("v_"))
            for p, (x, book) in enumerate(zip(parts, books)):
                at, _ = nearest(x, book)
                count = np.bincount(at, minlength=len(book))
                if x.dtype == object or (x.size and max(abs(int(x.min())), abs(int(x.max()))) * len(x) >= LIMIT):
                    sums = np.zeros((len(book), x.shape[1]), object)
                    for k, v in zip(at.tolist(), x.astype(object)):
                        sums[k] += v
                else:
                    sums, order = np.zeros((len(book), x.shape[1]), np.int64), np.argsort(at, kind="stable")
                    if x.size:
                        used = np.flatnonzero(count)
                        sums[used] = np.add.reduceat(x[order], (np.cumsum(count) - count)[used], axis=0)
                for k in np.flatnonzero(count).tolist():
                    n, s = total.get((p, k), (0, [0] * x.shape[1]))
                    total[p, k] = n + int(count[k]), [a + int(v) for a, v in zip(s, sums[k])]
        out = {"part": [], "entry": [], "n": [], "place": [], "digit": [], "total": []}
        for (p, k), (n, s) in sorted(total.items()):
            for place, v in enumerate(s or [0]):
                digit = 0
                while True:
                    rest = v >> DIGIT
                    for key, val in zip(out, (p, k, n, place, digit, v - (rest << DIGIT) if rest not in (0, -1) else v)):
                        out[key].append(val)
                    if rest in (0, -1):
                        break
                    v, digit = rest, digit + 1
        yield pa.RecordBatch.from_pydict(out, pa.schema([("part", pa.int32()), ("entry", pa.int32()), ("n", pa.int64()), ("place", pa.int32()),
                                                         ("digit", pa.int32()), ("total", pa.int64())]))
    return task


def _codes_task(state: str):
    def task(batches):
        cut = _blocks(state)
        for b in batches:
            mine, parts, books = cut(b.column("v_"))
            code, error = [""] * len(mine), [0] * len(mine)
            for x, book in zip(parts, books):
                at, far = nearest(x, book)
                for i, (k, d) in enumerate(zip(at.tolist(), far if isinstance(far, list) else far.tolist())):
                    code[i] += f"{k:02x}"
                    error[i] += d
            codes, errors = [None] * b.num_rows, [None] * b.num_rows
            for i, row in enumerate(mine.tolist()):
                codes[row], errors[row] = code[i], error[i] if error[i] < LIMIT else None
            yield pa.RecordBatch.from_arrays([b.column("id_"), b.column("label_"), pa.array(codes, pa.string()), pa.array(errors, pa.int64())],
                                             ["vec_id", "label_", "code", "error"])
    return task


def whole_vectors(vectors: DataFrame, id_col: str, vector_col: str, label_col: str | None) -> DataFrame:
    """id_, label_, v_ of the rows whose vector is not null and holds neither
    nulls nor non-finite components."""
    v = F.col(f"`{vector_col}`")
    label = F.col(f"`{label_col}`") if label_col else F.lit(None).cast("int")
    fine = v.isNotNull() & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return vectors.where(fine).select(F.col(f"`{id_col}`").alias("id_"), label.alias("label_"), v.alias("v_"))


def fit_codebooks(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> Codebooks:
    """Codebooks over the rows of ``whole_vectors``. They start as the parts of
    the ``entries`` smallest ids (equal ids by vector, null ids last); every
    round moves each used entry to floor(sum / count) of its parts."""
    first = [r.v_ for r in rows.orderBy(F.col("id_").asc_nulls_last(), "v_").limit(entries).select("v_").collect()]
    dim = len(first[0]) if first else 0
    edge = cuts(dim, parts)
    start = [to_integers(np.array(v, np.float64), scale).tolist() for v in first if len(v) == dim]
    books = Codebooks(dim, parts, scale, [[v[edge[p]:edge[p + 1]] for v in start] for p in range(parts)])
    for _ in range(rounds if dim else 0):
        sums = rows.select("v_").mapInArrow(_sums_task(books.plain()), "part int, entry int, n long, place int, digit int, total long")
        # At most parts * entries * places rows, whatever the table's size.
        found = sums.groupBy("part", "entry", "place", "digit").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect()
        count, total = {}, {}
        for r in found:
            at = r.part, r.entry, r.place
            total[at] = total.get(at, 0) + (r.total << (DIGIT * r.digit))
            if r.digit == 0:
                count[at] = r.n
        for (p, k, place), s in total.items():
            if place < len(books.books[p][k]):
                books.books[p][k][place] = s // count[p, k, place]
    return books


def encode_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label",
                   parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, Codebooks]:
    """(rows vec_id, label_, code, error; the final codebooks).

    Components become floor(scale * x), exactly, at any size. ``code`` holds
    the index of the nearest entry of each part, two hex digits each (so 256
    entries at most); ``error`` is the sum of the squared distances, null where
    it is beyond a long. Rows whose vector is null or holds null or non-finite
    components are dropped. The length of the smallest id's vector is the
    table's; a vector of another length stays with null code and error and
    does not count. Lengths that ``parts`` does not divide are cut as evenly as
    can be; a length of 0 gives the first entries and error 0. Equal distances
    take the lower index; repeated rows count as often as they stand; null ids
    and labels are kept; an empty table gives no rows and empty codebooks.
    Other columns are not read. A pass reads the vectors once, in batches; what
    it returns does not grow with the table, so no group is ever gathered."""
    rows = whole_vectors(vectors, id_col, vector_col, label_col)
    books = fit_codebooks(rows, parts, entries, rounds, scale)
    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    out = rows.mapInArrow(_codes_task(books.plain()), f"vec_id {types['id_']}, label_ {types['label_']}, code string, error long")
    return out, books
