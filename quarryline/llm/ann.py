"""Operator 2: nearest neighbours by randomly rotated one-bit codes.

Vectors are centred, padded with zeros to a length of BITS at least, rotated by a random orthogonal
matrix and stored as the signs of their coordinates, packed, with their distance to the centre and
the inner product of code and vector. A query is rotated too and quantised to PLANES bits a
coordinate; its inner products with codes are counts of common bits. They estimate the query's
distance to every vector without bias, with bounds; a vector is reranked by the exact distance, in
double precision on the original vectors, only if its lower bound is within the k-th smallest upper
bound of the query's candidates in a chunk, and within the k-th smallest distance of those that the
task has reranked for it before.

Every row is coded, in chunks of CHUNK codes; queries come in blocks of BLOCK. Each block meets each
chunk once, and a task holds one of either at a time, with the k best of the block's queries. A
chunk carries its original vectors once, for the chosen are reranked where their codes are: only k
rows of a query leave a task for each chunk at most, instead of every chosen pair. The centre is the mean of a sample of at most SAMPLE vectors, the
first by a hash of vec_id. EPSILON sets the bounds: at 2.5 a vector is missed with a probability of
about one in a hundred where the bound decides. Codes are scanned whole, so work grows with queries
times rows: vectors that are spread evenly, where a coarse index would cost recall, set that.

Defined results: vectors that are null, empty or zero, hold null or non-finite components, or have a
null id take no part; vectors of other lengths are never compared; a repeated vec_id is one query,
with the smallest of its vectors, and as many candidates as it has rows; candidates with the query's
own id are left out; an empty table gives no rows; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections import defaultdict
from functools import lru_cache
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarryline.llm.common import shuffle_width

K, EVERY = 10, 100
CHUNK, BLOCK, SAMPLE, EPSILON, SEED = 16_384, 512, 4096, 2.5, 20_240_521
BITS, PLANES = 512, 4


def valid(rows: DataFrame) -> DataFrame:
    """(vec_id, embedding) of the rows that take part."""
    e = F.col("embedding")
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.select("vec_id", "embedding").filter(F.col("vec_id").isNotNull() & e.isNotNull() & (F.size(e) > 0) & finite & F.exists(e, lambda x: x != 0))


def _packer(size: int):
    """Turns rows into chunks (dim, n, ids, vectors) of one dimension each, of at most size rows."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, list[tuple[np.ndarray, np.ndarray]]] = defaultdict(list)

        def chunk(dim: int) -> pa.RecordBatch:
            ids, vectors = (np.concatenate(c) for c in zip(*kept.pop(dim), strict=True))
            return pa.RecordBatch.from_pydict({"dim": pa.array([dim], pa.int32()), "n": pa.array([len(ids)], pa.int32()), "ids": pa.array([ids.tobytes()], pa.binary()), "vectors": pa.array([vectors.tobytes()], pa.binary())})

        for b in batches:
            for at in range(0, b.num_rows, size):
                part = b.slice(at, size)
                ids, column = part["vec_id"].to_numpy(zero_copy_only=False), part["embedding"]
                lengths = np.diff(column.offsets.to_numpy())
                flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                starts = np.cumsum(lengths) - lengths
                for dim in np.unique(lengths):
                    mine = lengths == dim
                    kept[int(dim)].append((ids[mine].astype(np.int64), flat[starts[mine][:, None] + np.arange(dim)]))
                    if sum(len(i) for i, _ in kept[int(dim)]) + size > size * 2 - 1:
                        yield chunk(int(dim))
        for dim in list(kept):
            yield chunk(dim)

    return pack


_CHUNK = "dim int, n int, ids binary, vectors binary"


@lru_cache(maxsize=4)
def rotation(dim: int) -> np.ndarray:
    """The rows of a random orthogonal matrix that vectors of dim coordinates, padded, meet; a multiple of 64 columns."""
    wide = -(-max(dim, BITS) // 64) * 64
    q, r = np.linalg.qr(np.random.default_rng(SEED + dim).standard_normal((wide, wide)))
    return (q * np.sign(np.diag(r)))[:dim]


def encode(vectors: np.ndarray, centre: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed signs, distance to the centre, and inner product of code and unit vector (1 where the vector is the centre)."""
    turn = rotation(vectors.shape[1])
    apart = vectors - centre
    norm = np.linalg.norm(apart, axis=1)
    turned = apart @ turn
    along = np.abs(turned).sum(1) / turn.shape[1] ** 0.5 / np.where(norm > 0, norm, 1)
    return np.packbits(turned > 0, axis=1), norm, np.where(norm > 0, along, 1.0)


def eligible(ids: np.ndarray, vectors: np.ndarray, k: int) -> np.ndarray:
    """Places of rows that can be among the k nearest of any query: of equal vectors the k + 1 smallest ids (one may be the query's own), k rows of each. A vector that many rows share thus costs no more than a few."""
    _, group = np.unique(vectors, axis=0, return_inverse=True)
    order = np.lexsort((ids, group.ravel()))
    g, i = group.ravel()[order], ids[order]
    at = np.arange(len(ids))
    new_group = np.r_[True, g[1:] != g[:-1]]
    new_id = new_group | np.r_[True, i[1:] != i[:-1]]
    nth_id = np.cumsum(new_id) - np.maximum.accumulate(np.where(new_group, np.cumsum(new_id), 0))
    nth_row = at - np.maximum.accumulate(np.where(new_id, at, 0))
    return np.sort(order[(nth_id <= k) & (nth_row < k)])


def _coder(centres: dict[int, np.ndarray], k: int):
    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for dim, raw_ids, raw in zip(b["dim"].to_pylist(), b["ids"].to_pylist(), b["vectors"].to_pylist(), strict=True):
                ids, vectors = np.frombuffer(raw_ids, np.int64), np.frombuffer(raw).reshape(-1, dim)
                keep = eligible(ids, vectors, k)
                made = encode(vectors[keep], centres.get(dim, np.zeros(dim)))
                yield pa.RecordBatch.from_pydict({"dim": pa.array([dim], pa.int32()), "n": pa.array([len(keep)], pa.int32()), "ids": pa.array([ids[keep].tobytes()], pa.binary()), "vectors": pa.array([vectors[keep].tobytes()], pa.binary())} | {k: pa.array([x.tobytes()], pa.binary()) for k, x in zip(("bits", "norms", "along"), made, strict=True)})

    return code


class Query:
    """A query's rotated difference to the centre, quantised, as planes of packed bits."""

    def __init__(self, vector: np.ndarray, centre: np.ndarray):
        apart = vector - centre
        turned = apart @ rotation(len(vector))
        self.width, self.away, self.sum = len(turned), np.linalg.norm(apart), turned.sum()
        self.low = turned.min()
        self.step = (turned.max() - self.low) / ((1 << PLANES) - 1)
        levels = np.rint((turned - self.low) / (self.step or 1)).astype(np.uint8)
        self.planes = [np.packbits(levels >> p & 1).view(np.uint64) for p in range(PLANES)]

    def products(self, words: np.ndarray, ones: np.ndarray) -> np.ndarray:
        """Estimated inner products with the codes (rows of words, with their counts of ones), each a unit vector of equal coordinates."""
        common = sum((np.bitwise_count(words & plane).sum(1, dtype=np.int64) << p) for p, plane in enumerate(self.planes))
        return (2 * (self.low * ones + self.step * common) - self.sum) / self.width**0.5

    def bounds(self, codes: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray], epsilon: float) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of the squared distances to the vectors of (words, counts of ones, distance to the centre, product of code and vector)."""
        words, ones, norm, along = codes
        near = norm**2 + self.away**2 - 2 * norm * self.products(words, ones) / along
        error = epsilon * (np.sqrt(np.maximum(1 - along**2, 0) / max(self.width - 1, 1)) * self.away + self.step / 12**0.5)
        slack = 2 * norm * error / along + 1e-9 * (1 + self.away**2 + norm**2)
        return near - slack, near + slack


def chosen(low: np.ndarray, high: np.ndarray, k: int, limit: float) -> np.ndarray:
    """Places whose lower bound is within the k-th smallest upper bound and within limit."""
    return np.flatnonzero(low <= (limit if len(high) <= k else min(limit, np.partition(high, k - 1)[k - 1])))


_FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64()), ("reranked", pa.int64())])


def _searcher(centres: dict[int, np.ndarray], k: int, epsilon: float):
    def rows(best: dict[int, tuple[np.ndarray, np.ndarray, int]]) -> pa.RecordBatch:
        parts = [(np.full(len(ids), q), ids, scores, np.where(np.arange(len(ids)) == 0, n, 0)) for q, (ids, scores, n) in best.items()]
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), f.type) for c, f in zip(zip(*parts, strict=True), _FOUND, strict=True)], schema=_FOUND)

    def search_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, best = None, {}
        for b in batches:
            for i in range(b.num_rows):
                r = {name: b[name][i].as_py() for name in b.schema.names}
                if r["query_ids"] != block:
                    if best:
                        yield rows(best)
                    block, best = r["query_ids"], {}
                ids, dim = np.frombuffer(r["ids"], np.int64), r["dim"]
                vectors, words = np.frombuffer(r["vectors"]).reshape(-1, dim), np.frombuffer(r["bits"], np.uint64).reshape(len(ids), -1)
                codes = words, np.bitwise_count(words).sum(1, dtype=np.int64), np.frombuffer(r["norms"]), np.frombuffer(r["along"])
                for q, vector in zip(np.frombuffer(block, np.int64).tolist(), np.frombuffer(r["query_vectors"]).reshape(-1, dim), strict=True):
                    low, high = Query(vector, centres.get(dim, np.zeros(dim))).bounds(codes, epsilon)
                    other = np.flatnonzero(ids != q)
                    old_ids, old, n = best.get(q, (ids[:0], codes[2][:0], 0))
                    limit = old[-1] ** 2 * (1 + 1e-9) if len(old) == k else np.inf
                    keep = other[chosen(low[other], high[other], k, limit)]
                    near_ids, near = np.r_[old_ids, ids[keep]], np.r_[old, np.sqrt(((vectors[keep] - vector) ** 2).sum(1))]
                    first = np.lexsort((near_ids, near))[:k]
                    best[q] = near_ids[first], near[first], n + len(keep)
        if best:
            yield rows(best)

    return search_pairs


def sampled(rows: DataFrame, size: int) -> DataFrame:
    """The first size rows by a hash of vec_id. The driver gets them alone: a sorted limit that is collected sends it as many of every task.

    The rows are counted by the hash's first bits, and only those up to the bits where size is reached are sorted.
    """
    key = F.xxhash64("vec_id")
    reached, last = 0, None
    for bits, n in sorted(rows.groupBy(F.shiftright(key, 52)).count().collect()):
        reached, last = reached + n, bits
        if reached >= size:
            break
    first = rows.filter(F.shiftright(key, 52) <= F.lit(last)).orderBy(key, "vec_id", "embedding").limit(size)
    # A step after the limit: so the tasks' first rows meet in a task, not in the driver.
    return first.filter(F.size("embedding") >= 0)


def nearest(rows: DataFrame, queries: DataFrame, k: int = K, epsilon: float = EPSILON) -> DataFrame:
    """(query_id, vec_id, score, reranked) of the k best of each query for each group of chunks, of valid rows and queries with an id each. reranked sums up to the pairs whose distances were computed."""
    spark = rows.sparkSession
    by: dict[int, list] = defaultdict(list)
    for r in sampled(rows, SAMPLE).collect():
        by[len(r["embedding"])].append(r["embedding"])
    centres = {dim: np.array(v, float).mean(0) for dim, v in by.items()}
    groups = 2 * shuffle_width(spark)
    coded = rows.mapInArrow(_packer(CHUNK), _CHUNK).mapInArrow(_coder(centres, k), "dim int, n int, ids binary, vectors binary, bits binary, norms binary, along binary")
    chunks = coded.withColumn("g", F.pmod(F.xxhash64("ids"), F.lit(groups)).cast("int"))
    # The stated query set, in blocks: each block goes once to each group of chunks.
    asked = queries.repartition(max(1, shuffle_width(spark) // 8), "vec_id").mapInArrow(_packer(BLOCK), _CHUNK)
    blocks = asked.select(F.col("dim").alias("query_dim"), F.col("ids").alias("query_ids"), F.col("vectors").alias("query_vectors"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"))
    # Merged, never broadcast: the copies of blocks grow with the queries, and a broadcast passes the driver.
    pairs = blocks.hint("merge").join(chunks, (F.col("g") == F.col("group")) & (F.col("dim") == F.col("query_dim"))).select("dim", "ids", "vectors", "bits", "norms", "along", "query_ids", "query_vectors")
    return pairs.mapInArrow(_searcher(centres, k, epsilon), "query_id long, vec_id long, score double, reranked long")


def search(rows: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """The k nearest of rows for each of queries, both (vec_id, embedding); queries of one id count once, with the smallest vector."""
    taking = valid(rows)
    asked = valid(queries).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    scored = nearest(taking, asked, k)
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def search_every(rows: DataFrame, every: int = EVERY, k: int = K) -> DataFrame:
    """The stated queries: rows whose vec_id is divisible by `every`, against all rows."""
    return search(rows, rows.filter(F.col("vec_id") % every == 0), k)
