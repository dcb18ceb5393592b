"""Exact top-k by inner product with a pivot-distance index.

Inner products become distances: every vector x gets one more component sqrt(M^2 - |x|^2) (M the largest norm) and a query gets 0 there, so d(q, x)^2 = |q|^2 + M^2 - 2 q.x, and the
largest products are the nearest vectors. Each vector is keyed by its nearest of PIVOTS pivots and its distance to it; the distances to one pivot are cut into annuli, and an
annulus of many vectors into cells of about CELL_ROWS. A query visits a cell only if the triangle inequality lets it hold a vector nearer than the query's k-th best so far: |d(q, p) - d(x, p)|
bounds d(q, x) from below. Within a cell the vectors stand in order of distance to the pivot, and pieces of that order are expanded from the query's own distance outwards until the
bound stops them.

The k-th best to start from comes from a bounded sample of SEED_ROWS vectors (and of as many pivots' candidates); it only saves visits. The index holds every vector and the result is exact. A cell is one
row, a group of at most QUERY_ROWS queries another, and they meet in one join by cell: no key gathers more than a cell, and many equal vectors fill many cells.

Components are floor(scale * x) as a long, held to the range of long where they leave it; a score is the exact inner product of longs, held to that range likewise before it is ranked. Products run in floating point where
all their sums are exact, else in 64-bit integers, and in whole numbers of any size for the few pairs that might leave 64 bits.

Cases: vectors that are null or hold null or non-finite components take no part; so do rows of null vec_id; rows that repeat a vec_id are one vector, the first in order of its components; shorter vectors count as filled with
zeros; ties go to the smaller vec_id; a query has fewer rows than k if there are fewer candidates; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialise

PIVOTS = 32
SEED_ROWS = 2048
RINGS = 64
CELL_ROWS = 4096
QUERY_ROWS = 4096
_PIECE = 512


def integer_vectors(table: DataFrame, scale: float = 256.0) -> DataFrame:
    """vec_id, vec (floor(scale * x) as bytes of int32, or of int64 where wide), wide, dims, n2 (squared norm) of the vectors that take part, one for each vec_id."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vecs, wides, norms, dims = [], [], [], []
            for v in b.column(1):
                with np.errstate(over="ignore"):
                    q = np.clip(np.floor(scale * v.values.to_numpy(zero_copy_only=False).astype(np.float64)), -(2.0**63), 2.0**63)
                wide = bool(np.abs(q).max(initial=0) >= 2**31)
                wides.append(wide)
                dims.append(len(q))
                norms.append(float(q @ q))
                # 2^63 itself becomes the largest long
                vecs.append((np.where(q == 2.0**63, np.iinfo(np.int64).max, np.minimum(q, 2.0**63 - 1024).astype(np.int64)) if wide else q.astype(np.int32)).tobytes())
            yield pa.RecordBatch.from_pydict({"vec_id": b.column(0), "vec": pa.array(vecs, pa.binary()), "wide": pa.array(wides, pa.bool_()), "dims": pa.array(dims, pa.int32()), "n2": pa.array(norms, pa.float64())})

    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).where("vec_id is not null and v is not null")
    whole = rows.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    return whole.groupBy("vec_id").agg(F.min("v").alias("v")).mapInArrow(pack, "vec_id long, vec binary, wide boolean, dims int, n2 double")


def _matrix(raw: list[bytes], wide: list[bool], dims: int) -> np.ndarray:
    """Rows of int64, filled with zeros."""
    if not any(wide) and all(len(r) == 4 * dims for r in raw):
        return np.frombuffer(b"".join(raw), np.int32).reshape(-1, dims).astype(np.int64)
    out = np.zeros((len(raw), dims), np.int64)
    for i, (r, w) in enumerate(zip(raw, wide, strict=True)):
        x = np.frombuffer(r, np.int64 if w else np.int32)
        out[i, : len(x)] = x
    return out


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products, held to the range of long: by float64 where every partial sum is under 2^53; else modulo 2^64, which is right where the whole is in range, and anew in whole numbers where it may not be."""
    x, y = a.astype(np.float64), b.astype(np.float64)
    most = float(np.abs(x).max(initial=0)) * float(np.abs(y).max(initial=0)) * a.shape[1]
    if most < 2**53:
        return (x @ y.T).astype(np.int64)
    out = a @ b.T
    if most >= 2**62:
        for i, j in zip(*np.nonzero(np.abs(x) @ np.abs(y).T >= 2**62), strict=True):
            exact = sum(p * q for p, q in zip(a[i].tolist(), b[j].tolist(), strict=True))
            out[i, j] = min(max(exact, -(2**63)), 2**63 - 1)
    return out


class _Pivots:
    """Pivots and sample vectors, and distances to the pivots."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, dims: int, m2: float) -> None:
        self.dims, self.m2 = dims, m2
        self.pivots, self.sample, self.ids = vectors[:PIVOTS], vectors, ids
        self.fill = np.sqrt(np.maximum(m2 - (self.pivots.astype(np.float64) ** 2).sum(axis=1), 0))

    def of_vectors(self, x: np.ndarray, n2: np.ndarray) -> np.ndarray:
        cross = x.astype(np.float64) @ self.pivots.astype(np.float64).T + np.sqrt(np.maximum(self.m2 - n2, 0))[:, None] * self.fill
        return np.sqrt(np.maximum(2 * self.m2 - 2 * cross, 0))

    def of_queries(self, q: np.ndarray, n2: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(n2[:, None] + self.m2 - 2 * (q.astype(np.float64) @ self.pivots.astype(np.float64).T), 0))

    def kth(self, q: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
        """A lower bound of each query's k-th best product: the k-th best in the sample without the query itself."""
        s = _products(q, self.sample).astype(np.float64)
        s[ids[:, None] == self.ids[None, :]] = -np.inf
        return np.partition(s, -k, axis=1)[:, -k] if s.shape[1] >= k else np.full(len(q), -np.inf)


def _bound(gap: np.ndarray, qn2: np.ndarray, m2: float) -> np.ndarray:
    """The largest product of a query and a vector whose distances to one pivot differ by gap, with room for rounding: a distance is the root of a difference of numbers of m2's size."""
    gap = np.maximum(np.maximum(gap, 0) * (1 - 1e-9) - 1e-6 * (1 + m2**0.5), 0)
    return (qn2 + m2 - gap**2) / 2 * (1 + 1e-12) + 1e-12 * m2 + 1e-6


def _search(x: np.ndarray, ids: np.ndarray, dist: np.ndarray, q: np.ndarray, qids: np.ndarray, qn2: np.ndarray, qdist: np.ndarray, best: np.ndarray, m2: float, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query rows, vector ids and products of the best k (products at least best) in a cell, whose vectors stand in order of dist."""
    pieces = [(a, min(a + _PIECE, len(x))) for a in range(0, len(x), _PIECE)]
    middle = float(np.median(qdist))
    held = [np.zeros(0, np.int64)] * 3
    best = best.copy()
    for a, b in sorted(pieces, key=lambda p: max(dist[p[0]] - middle, middle - dist[p[1] - 1], 0.0)):
        most = _bound(np.maximum(dist[a] - qdist, qdist - dist[b - 1]), qn2, m2)
        live = np.flatnonzero(most >= best)
        if not len(live):
            continue
        s = _products(q[live], x[a:b])
        at, col = np.nonzero((s >= best[live, None]) & (qids[live, None] != ids[None, a:b]))
        held = [np.concatenate(p) for p in zip(held, (live[at], ids[a:b][col], s[at, col]), strict=True)]
        order = np.lexsort((held[1], -held[2], held[0]))
        held = [h[order] for h in held]
        first = np.searchsorted(held[0], held[0])
        held = [h[np.arange(len(first)) - first < k] for h in held]
        rows, n = np.unique(held[0], return_counts=True)
        ends = np.cumsum(n) - 1
        full = n == k
        best[rows[full]] = np.maximum(best[rows[full]], held[2][ends[full]])
    return held[0], held[1], held[2]


def top_k(table: DataFrame, is_query: Column, k: int = 5, scale: float = 256.0) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k largest integer inner products of each query row with all other rows."""
    spark = table.sparkSession
    schema = "query_id long, rank int, vec_id long, score long"
    vectors = materialise(integer_vectors(table, scale), "vectors")
    total, m2, dims, wide = vectors.agg(F.count("*"), F.max("n2"), F.max("dims"), F.max("wide")).first()
    if not total:
        return spark.createDataFrame([], schema)
    dims, kind = max(1, dims), np.int64 if wide else np.int32
    drawn = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SEED_ROWS).collect()
    shared = spark.sparkContext.broadcast(_Pivots(_matrix([r["vec"] for r in drawn], [r["wide"] for r in drawn], dims), np.array([r["vec_id"] for r in drawn]), dims, m2))
    width = max(1e-9, 2 * m2**0.5 / RINGS)

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, n2 = _matrix(b.column(1).to_pylist(), b.column(2).to_pylist(), dims), b.column(3).to_numpy()
            d = shared.value.of_vectors(x, n2)
            p = d.argmin(axis=1)
            own = d[np.arange(len(d)), p]
            yield pa.RecordBatch.from_pydict({"vec_id": b.column(0), "vec": b.column(1), "wide": b.column(2), "ring": pa.array((p * (RINGS + 1) + np.minimum(own / width, RINGS).astype(np.int64)).astype(np.int32)), "dist": pa.array(own)})

    keyed = materialise(vectors.select("vec_id", "vec", "wide", "n2").mapInArrow(key, "vec_id long, vec binary, wide boolean, ring int, dist double"), "keyed")
    # at most PIVOTS * (RINGS + 1) rows
    rings = keyed.groupBy("ring").agg(F.count("*").alias("n"), F.min("dist").alias("lo"), F.max("dist").alias("hi")).orderBy("ring").collect()
    parts = [max(1, -(-r["n"] // CELL_ROWS)) for r in rings]
    first = np.concatenate([[0], np.cumsum(parts)])
    table_of = spark.createDataFrame([(r["ring"], int(first[i]), parts[i]) for i, r in enumerate(rings)], "ring int, first long, parts int")
    celled = keyed.join(F.broadcast(table_of), "ring").withColumn("cell", F.col("first") + F.pmod(F.xxhash64("vec_id", F.lit(5)), F.col("parts")))
    bounds = spark.sparkContext.broadcast((np.array([r["ring"] // (RINGS + 1) for r in rings]), np.array([r["lo"] for r in rings]), np.array([r["hi"] for r in rings]), first))

    def pack(t: pa.Table) -> pa.Table:
        t = t.sort_by([("dist", "ascending"), ("vec_id", "ascending")])
        x = _matrix(t.column("vec").to_pylist(), t.column("wide").to_pylist(), dims)
        return pa.table({"cell": t.column("cell")[:1], "ids": pa.array([t.column("vec_id").to_numpy().tobytes()], pa.binary()), "vecs": pa.array([x.astype(kind).tobytes()], pa.binary()), "dists": pa.array([t.column("dist").to_numpy().tobytes()], pa.binary())})

    cells = celled.select("cell", "vec_id", "vec", "wide", "dist").groupBy("cell").applyInArrow(pack, "cell long, ids binary, vecs binary, dists binary")

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivot_of, lo, hi, begin = bounds.value
        names = ["cell", "qids", "qvecs", "qn2", "qdist", "best"]
        for b in batches:
            for at in range(0, b.num_rows, QUERY_ROWS):
                part = b.slice(at, QUERY_ROWS)
                ids, q, n2 = part.column(0).to_numpy(), _matrix(part.column(1).to_pylist(), part.column(2).to_pylist(), dims), part.column(3).to_numpy()
                d, best = shared.value.of_queries(q, n2), shared.value.kth(q, ids, k)
                for r in range(len(lo)):
                    own = d[:, pivot_of[r]]
                    live = np.flatnonzero(_bound(np.maximum(lo[r] - own, own - hi[r]), n2, shared.value.m2) >= best)
                    if len(live):
                        group = [ids[live].tobytes(), q[live].astype(kind).tobytes(), n2[live].tobytes(), own[live].tobytes(), best[live].tobytes()]
                        for c in range(int(begin[r]), int(begin[r + 1])):
                            yield pa.RecordBatch.from_arrays([pa.array([c], pa.int64()), *(pa.array([g], pa.binary()) for g in group)], names=names)

    queries = vectors.where(is_query).select("vec_id", "vec", "wide", "n2").mapInArrow(visit, "cell long, qids binary, qvecs binary, qn2 binary, qdist binary, best binary")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                ids, vecs, dists, qids, qvecs, qn2, qdist, best = (np.frombuffer(b.column(c)[r].as_py(), t) for c, t in zip(range(1, 9), (np.int64, kind, np.float64, np.int64, kind, np.float64, np.float64, np.float64), strict=True))
                row, vec, score = _search(vecs.reshape(-1, dims).astype(np.int64), ids, dists, qvecs.reshape(-1, dims).astype(np.int64), qids, qn2, qdist, best, shared.value.m2, k)
                yield pa.RecordBatch.from_pydict({"query_id": pa.array(qids[row]), "vec_id": pa.array(vec), "score": pa.array(score)})

    found = cells.join(queries, "cell").mapInArrow(search, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE_SQL = """
WITH v AS (SELECT vec_id, list_transform(min(embedding), lambda x: floor(256 * CAST(x AS DOUBLE))) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 GROUP BY vec_id),
s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""
