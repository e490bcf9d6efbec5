"""Nearest neighbours by score-aware anisotropic quantisation and exact reranking.

The nearest vector by Euclidean distance maximises q.x - |x|^2 / 2. Vectors are quantised in subspaces
of two dimensions with 16 centroids each, under a loss that weighs the residual along the vector more
than the residual across it, since only the former changes the inner product with the queries that
matter. Codes take four bits; a query's inner products with all centroids form its tables, two of which
are joined into one of 256 entries, and a block of codes is scanned by look-ups in them. The best
``rerank`` of each block are compared by exact double-precision distances, and a query's best over all
blocks are its result.

Only the codebooks come from a sample, at most ``sample_rows`` vectors in the order of hashed ids; every
vector is indexed and scanned. Queries meet the index in blocks: a task holds one block of vectors and
streams the queries past it.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

CENTROIDS = 16
SUB = 2


@dataclass
class Codebooks:
    """Centroids (subspaces, 16, 2) of vectors with ``dims`` dimensions, and the weight of the parallel residual."""

    centroids: np.ndarray
    dims: int
    eta: float

    def split(self, x: np.ndarray) -> np.ndarray:
        pad = self.centroids.shape[0] * SUB - self.dims
        if pad:
            x = np.concatenate((x, np.zeros((len(x), pad))), axis=1)
        return x.reshape(len(x), -1, SUB)

    def encode(self, x: np.ndarray, rounds: int = 2) -> np.ndarray:
        """Codes (n, subspaces): nearest centroids, then coordinate descent on the anisotropic loss."""
        parts = self.split(x)
        n, m, _ = parts.shape
        norm = np.linalg.norm(x, axis=1)
        codes = np.empty((n, m), dtype=np.uint8)
        along = np.empty((n, m))
        for j in range(m):
            r = parts[:, j, None, :] - self.centroids[None, j]
            codes[:, j] = np.argmin((r**2).sum(axis=2), axis=1)
        for j in range(m):
            r = parts[:, j] - self.centroids[j][codes[:, j]]
            along[:, j] = (r * parts[:, j]).sum(axis=1) / norm
        whole = along.sum(axis=1)
        for _ in range(rounds):
            for j in range(m):
                r = parts[:, j, None, :] - self.centroids[None, j]
                a = (r * parts[:, j, None, :]).sum(axis=2) / norm[:, None]
                rest = whole - along[:, j]
                loss = (r**2).sum(axis=2) + (self.eta - 1) * (rest[:, None] + a) ** 2
                codes[:, j] = np.argmin(loss, axis=1)
                along[:, j] = a[np.arange(n), codes[:, j]]
                whole = rest + along[:, j]
        return codes

    def tables(self, q: np.ndarray) -> np.ndarray:
        """Inner products (queries, byte places, 256) for packed codes of two subspaces a byte."""
        t = np.einsum("qms,mcs->qmc", self.split(q), self.centroids)
        if t.shape[1] % 2:
            t = np.concatenate((t, np.zeros((len(t), 1, CENTROIDS))), axis=1)
        return (t[:, 1::2, :, None] + t[:, 0::2, None, :]).reshape(len(t), -1, 256).astype(np.float32)


def pack(codes: np.ndarray) -> np.ndarray:
    """Two four-bit codes a byte, the first in the low half."""
    if codes.shape[1] % 2:
        codes = np.concatenate((codes, np.zeros((len(codes), 1), np.uint8)), axis=1)
    return codes[:, 0::2] | (codes[:, 1::2] << 4)


def train(x: np.ndarray, threshold: float = 0.2, rounds: int = 6, seed: int = 11) -> Codebooks:
    """Codebooks by k-means in each subspace, then rounds of anisotropic assignment and least squares."""
    n, dims = x.shape
    m = -(-dims // SUB)
    eta = max(1.0, (dims - 1) * threshold**2 / (1 - threshold**2))
    books = Codebooks(np.zeros((m, CENTROIDS, SUB)), dims, eta)
    parts = books.split(x)
    rng = np.random.default_rng(seed)
    for j in range(m):
        c = parts[rng.choice(n, CENTROIDS, replace=n < CENTROIDS), j].copy()
        for _ in range(8):
            at = np.argmin(((parts[:, j, None] - c[None]) ** 2).sum(axis=2), axis=1)
            size = np.bincount(at, minlength=CENTROIDS)
            total = np.stack([np.bincount(at, parts[:, j, s], CENTROIDS) for s in range(SUB)], axis=1)
            c = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], c)
        books.centroids[j] = c
    unit = parts / np.linalg.norm(x, axis=1)[:, None, None]
    for _ in range(rounds):
        codes = books.encode(x, rounds=1)
        along = np.stack([((parts[:, j] - books.centroids[j][codes[:, j]]) * unit[:, j]).sum(axis=1) for j in range(m)], axis=1)
        whole = along.sum(axis=1)
        for j in range(m):
            # Least squares of |x - c|^2 + (eta - 1)(rest + u.x - u.c)^2 over each centroid's members.
            u, at = unit[:, j], codes[:, j]
            aim = whole - along[:, j] + (u * parts[:, j]).sum(axis=1)
            size = np.bincount(at, minlength=CENTROIDS)
            left = np.zeros((CENTROIDS, SUB, SUB))
            right = np.zeros((CENTROIDS, SUB))
            for a in range(SUB):
                right[:, a] = np.bincount(at, parts[:, j, a] + (eta - 1) * aim * u[:, a], CENTROIDS)
                for b in range(SUB):
                    left[:, a, b] = (a == b) * size + (eta - 1) * np.bincount(at, u[:, a] * u[:, b], CENTROIDS)
            used = size > 0
            books.centroids[j][used] = np.linalg.solve(left[used], right[used][:, :, None])[:, :, 0]
            new = ((parts[:, j] - books.centroids[j][at]) * u).sum(axis=1)
            whole += new - along[:, j]
            along[:, j] = new
    return books


def valid_vectors(embeddings: DataFrame) -> DataFrame:
    """vec_id and vector (doubles) of the rows that take part.

    Left out are vectors that are null, empty, all zero or hold a null or a component that isn't finite,
    rows without a vec_id, and vectors whose number of dimensions isn't the most frequent one.
    """
    x = F.col("embedding").cast("array<double>")
    e = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("vector")).filter(F.col("vec_id").isNotNull() & F.col("vector").isNotNull())
    bad = F.exists("vector", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    some = F.exists("vector", lambda v: v != 0)
    e = e.filter(~F.coalesce(bad, F.lit(True)) & F.coalesce(some, F.lit(False)))
    best = e.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    return e.filter(F.size("vector") == (best[0]["d"] if best else 0))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def nearest(
    embeddings: DataFrame, every: int = 100, k: int = 10, rerank: int = 128, sample_rows: int = 20_000, block_rows: int = 8192, threshold: float = 0.2
) -> DataFrame:
    """The ``k`` nearest found of each query (vec_id divisible by ``every``) among all other rows.

    Returns query_id, rank, vec_id, score (the Euclidean distance in double precision), nearest first,
    ties to the smaller vec_id. Rows of a query's own vec_id are no candidates of it; repeated rows
    are candidates each, and of a repeated query id the vector that is smallest, component by component, asks. See `valid_vectors` for the rows that take part. An empty table gives no rows.
    """
    vectors = materialize(valid_vectors(embeddings), "vectors")
    n = vectors.count()
    schema = "query_id long, rank int, vec_id long, score double"
    if n == 0:
        return embeddings.sparkSession.createDataFrame([], schema)
    sample = vectors.orderBy(F.xxhash64("vec_id"), "vec_id", "vector").limit(sample_rows).select("vector").toArrow()
    books = embeddings.sparkSession.sparkContext.broadcast(train(_matrix(sample.column(0).combine_chunks()), threshold))

    def index(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                codes = pack(books.value.encode(_matrix(batch.column("vector"))))
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array([c.tobytes() for c in codes], pa.binary())], names=["vec_id", "vector", "codes"]
                )

    coded = vectors.mapInArrow(index, "vec_id long, vector array<double>, codes binary")
    blocks = -(-n // block_rows)
    block = F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")
    stored = coded.select(block.alias("block"), F.lit(0).alias("kind"), "vec_id", "vector", "codes")
    asked = vectors.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("vector").alias("vector"))
    asked = asked.select(
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(1).alias("kind"), "vec_id", "vector",
        F.lit(None).cast("binary").alias("codes"),
    )
    dealt = stored.unionByName(asked).repartition(blocks, "block").sortWithinPartitions("block", "kind", "vec_id")

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, ids, xs, cs = None, [], [], []
        held: tuple[np.ndarray, ...] | None = None
        for batch in batches:
            blocks_, kinds = batch.column("block").to_numpy(), batch.column("kind").to_numpy()
            edge = np.flatnonzero((np.diff(blocks_) != 0) | (np.diff(kinds) != 0)) + 1
            for a, b in zip([0, *edge], [*edge, batch.num_rows]):
                if a == b:
                    continue
                if blocks_[a] != here:
                    here, ids, xs, cs, held = blocks_[a], [], [], [], None
                part = batch.slice(int(a), int(b - a))
                if kinds[a] == 0:
                    ids.append(part.column("vec_id").to_numpy())
                    xs.append(_matrix(part.column("vector")))
                    cs.append(np.frombuffer(b"".join(part.column("codes").to_pylist()), np.uint8).reshape(part.num_rows, -1))
                elif ids:
                    if held is None:
                        x = np.concatenate(xs)
                        held = np.concatenate(ids), x, np.concatenate(cs), (0.5 * (x**2).sum(axis=1)).astype(np.float32)
                    for lo in range(0, part.num_rows, 256):
                        some = part.slice(lo, 256)
                        yield from _scan(books.value, held, some.column("vec_id").to_numpy(), _matrix(some.column("vector")), k, rerank)

    found = dealt.mapInArrow(search, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _scan(books: Codebooks, held: tuple[np.ndarray, ...], qid: np.ndarray, q: np.ndarray, k: int, rerank: int) -> Iterator[pa.RecordBatch]:
    """Table scan of one block of codes for a few queries, and exact distances of the best."""
    ids, x, codes, half = held
    n = len(ids)
    tables = books.tables(q)
    approx = np.repeat(-half[None], len(q), axis=0)
    for j in range(codes.shape[1]):
        approx += tables[:, j, :][:, codes[:, j]]
    approx[qid[:, None] == ids[None]] = -np.inf
    keep = min(rerank, n)
    if keep < n:
        cut = np.partition(approx, n - keep, axis=1)[:, n - keep, None]
        above = approx > cut
        level = approx == cut  # of equal scores the smaller ids, which stand first
        level &= np.cumsum(level, axis=1) <= keep - above.sum(axis=1)[:, None]
        best = np.nonzero(above | level)[1].reshape(len(q), keep)
    else:
        best = np.repeat(np.arange(n)[None], len(q), axis=0)
    distance = np.sqrt(((x[best] - q[:, None, :]) ** 2).sum(axis=2))
    distance[ids[best] == qid[:, None]] = np.inf
    take = min(k, keep)
    order = np.lexsort((ids[best], distance), axis=1)[:, :take]
    chosen = np.take_along_axis(distance, order, axis=1)
    near = np.take_along_axis(ids[best], order, axis=1)
    ok = np.isfinite(chosen)
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.repeat(qid, take).reshape(near.shape)[ok]), pa.array(near[ok]), pa.array(chosen[ok])],
        names=["query_id", "vec_id", "score"],
    )
