"""Exact top-k by inner product over a bit-sliced index."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

K, STEP, EVERY = 10, 1024, 100
#: Vectors of an index block, at least and at most; between these there are about as many blocks as BLOCKS.
BLOCK_ROWS, MOST_ROWS, BLOCKS = 16_384, 131_072, 512
#: Queries whose results leave a task at a time.
BLOCK_QUERIES = 2048
#: Components from here on are handled as integers of any size.
WIDE = 1 << 31
#: Bits of a component that its slices hold; the lower ones are resolved exactly for the rows at the boundary.
SLICES = 6


def full_adders(maps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Adds bitmaps of one weight (count, words) three at a time: those that stay at the weight, and the carries."""
    n = len(maps) // 3
    a, b, c = maps[:n], maps[n : 2 * n], maps[2 * n : 3 * n]
    x = a ^ b
    carry = (a & b) | (x & c)
    return np.concatenate((x ^ c, maps[3 * n :])), carry


def added(levels: list[list[np.ndarray]]) -> list[np.ndarray]:
    """Sum of bitmaps by weight (levels[w]: arrays (count, words)), as one bitmap for each bit of the sum."""
    out, w = [], 0
    while w < len(levels):
        maps = np.concatenate(levels[w]) if levels[w] else None
        if maps is None or not len(maps):
            out.append(None)
            w += 1
            continue
        carries = []
        while len(maps) > 2:
            maps, carry = full_adders(maps)
            carries.append(carry)
        if len(maps) == 2:
            carries.append((maps[0] & maps[1])[None])
            maps = (maps[0] ^ maps[1])[None]
        if carries:
            if w + 1 == len(levels):
                levels.append([])
            levels[w + 1] += carries
        out.append(maps[0])
        w += 1
    return out


def signed_digits(x: int) -> list[tuple[int, int]]:
    """(bit, sign) of the shortest sum of signed powers of two."""
    out, k = [], 0
    while x:
        if x & 1:
            d = 2 - (x & 3)
            out.append((k, d))
            x -= d
        x >>= 1
        k += 1
    return out


class SlicedIndex:
    """Bitmaps of the upper bits of every component of a block of integer vectors, and the vectors for the boundary."""

    def __init__(self, vectors: np.ndarray, slices: int = SLICES):
        n, d = vectors.shape
        self.vectors, self.n = vectors, n
        self.base = int(vectors.min()) if vectors.size else 0
        spread = int(vectors.max()) - self.base if vectors.size else 0
        self.bits = min(slices, spread.bit_length())
        self.drop = spread.bit_length() - self.bits
        upper = (vectors - self.base) >> self.drop
        self.words = -(-max(n, 1) // 64)
        maps = np.zeros((self.bits, d, self.words * 8), np.uint8)
        for j in range(self.bits):
            packed = np.packbits((upper >> j & 1).astype(np.uint8).T, axis=1, bitorder="little")
            maps[j, :, : packed.shape[1]] = packed
        maps = maps.view(np.uint64)
        #: maps[0]: slices by (component, bit); maps[1]: their complements
        self.maps = np.stack((maps, ~maps)).transpose(0, 2, 1, 3).copy()
        live = np.zeros(self.words * 8, np.uint8)
        packed = np.packbits(np.ones(n, np.uint8), bitorder="little")
        live[: len(packed)] = packed
        self.live = live.view(np.uint64)
        self.floats = vectors.astype(np.float64)

    def score_slices(self, query: np.ndarray) -> list[np.ndarray]:
        """Bitmaps of sum(q * upper) plus a constant of the query. A power of two with a minus takes the complement."""
        groups: dict[tuple[int, int], list[int]] = {}
        for c, q in enumerate(query.tolist()):
            for k, sign in signed_digits(q):
                groups.setdefault((k, int(sign < 0)), []).append(c)
        levels: list[list[np.ndarray]] = [[] for _ in range(max((k for k, _ in groups), default=0) + self.bits)]
        for (k, minus), components in groups.items():
            picked = self.maps[minus][components]
            for j in range(self.bits):
                levels[k + j].append(picked[:, j])
        return added(levels)

    def candidates(self, query: np.ndarray, k: int) -> np.ndarray:
        """Rows that can be among the k best, from the most significant slice downward."""
        if k >= self.n:
            return np.arange(self.n)
        slices = self.score_slices(query)
        high, even, least = np.zeros_like(self.live), self.live.copy(), 0
        for w in range(len(slices) - 1, -1, -1):
            s = slices[w]
            if s is None:
                continue
            more = high | (even & s)
            count = int(np.bitwise_count(more).sum())
            if count >= k:
                # the k-th best has this bit
                even &= s
                least |= 1 << w
            else:
                high = more
                even &= ~s
        # what the dropped bits can change between two rows, in units of the slices
        slack = -(-int(np.abs(query).sum()) * ((1 << self.drop) - 1) >> self.drop)
        bound = max(0, least - slack)
        above, equal = np.zeros_like(self.live), self.live.copy()
        for w in range(len(slices) - 1, -1, -1):
            s = slices[w]
            if bound >> w & 1:
                equal = equal & s if s is not None else np.zeros_like(equal)
            elif s is not None:
                above |= equal & s
                equal &= ~s
        if bound >> len(slices):
            above, equal = np.zeros_like(above), np.zeros_like(equal)
        picked = (above | equal).view(np.uint8)
        return np.flatnonzero(np.unpackbits(picked, count=self.n, bitorder="little"))

    def top(self, query: np.ndarray, ids: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k best rows but those with id own: higher scores first, then smaller ids."""
        rows = self.candidates(query, k + int(np.count_nonzero(ids == own)))
        rows = rows[ids[rows] != own]
        most = float(np.abs(query).sum()) * float(np.abs(self.floats).max(initial=0))
        if most < 2**53:
            scores = (self.floats[rows] @ query.astype(np.float64)).astype(np.int64)
        elif most < 2**62:
            scores = self.vectors[rows] @ query
        else:
            return wide_top(self.vectors[rows], ids[rows], query, k)
        best = np.lexsort((ids[rows], -scores))[:k]
        return ids[rows][best], scores[best]


def wide_top(vectors: np.ndarray, ids: np.ndarray, query: np.ndarray, k: int) -> tuple[np.ndarray, list[int]]:
    """The k best by integers of any size."""
    scores = [sum(int(x) * int(q) for x, q in zip(v, query)) for v in vectors]
    best = sorted(range(len(scores)), key=lambda i: (-scores[i], ids[i]))[:k]
    return ids[best], [scores[i] for i in best]


def sized(score: int) -> float:
    """A score as a float, the largest one beyond its range."""
    try:
        return float(score)
    except OverflowError:
        return float("inf") if score > 0 else float("-inf")


def quantised(column: pa.ChunkedArray | pa.Array, dim: int, step: int) -> np.ndarray:
    """floor(step * x) of each component: 64-bit integers, or objects where one is too large for the slices."""
    parts = [np.asarray(c.flatten().to_numpy(zero_copy_only=False), np.float64) for c in (column.chunks if isinstance(column, pa.ChunkedArray) else [column])]
    values = np.floor(np.concatenate([np.empty(0), *parts]) * step)
    if len(values) and np.abs(values).max() >= WIDE:
        wide = np.empty(len(values), object)
        wide[:] = [int(x) for x in values.tolist()]
        return wide.reshape(len(column), dim)
    return values.astype(np.int64).reshape(len(column), dim)


class Block:
    """The vectors of a block under an index, to which batches of queries come in turn."""

    def __init__(self, tables: list[pa.RecordBatch], dim: int, step: int):
        whole = pa.Table.from_batches(tables)
        self.ids = whole.column("id").to_numpy()
        self.vectors = quantised(whole.column("vector"), dim, step)
        self.index = SlicedIndex(self.vectors) if self.vectors.dtype != object else None

    def best(self, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        if self.index is not None and query.dtype != object:
            return self.index.top(query, self.ids, own, k)
        others = self.ids != own
        return wide_top(self.vectors[others], self.ids[others], query, k)


def usable(vectors: DataFrame, id_col: str, vector: str) -> DataFrame:
    # what overflows when scaled isn't finite either
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double") * STEP) < F.lit(float("inf"))))
    return vectors.where(F.col(id_col).isNotNull() & F.col(vector).isNotNull() & whole).select(F.col(id_col).cast("long").alias("id"), F.col(vector).alias("vector"), F.size(vector).alias("dim"))


def exact_top_k(vectors: DataFrame, queries: DataFrame, k: int = K, step: int = STEP, id_col: str = "vec_id", vector: str = "embedding", block_rows: int | None = None, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of vectors with the highest inner product of floor(step * x) with each query.

    Vectors are dealt to blocks by a hash of their id, each once; every query goes to each block. In a task a block's vectors come first and
    become a bit-sliced index of their upper bits, then the queries stream past it: each is narrowed to the rows that can be
    among the best, and only those are scored. Of each block at most k rows remain, so the last step ranks few rows.
    A row isn't compared with rows of its own id. Ties go to the smaller id; rows that repeat an id are ranked each, equal query rows
    count once. Vectors that are null, or hold null or non-finite components, and rows without an id take no part; vectors are only
    compared with those of equal length. Empty tables give none. Components of any finite size are scored exactly; a score beyond 64 bits
    ranks by its value as a float, and is given as the nearest that fits.
    """
    data, asked = usable(vectors, id_col, vector), usable(queries, id_col, vector).distinct()
    rows = max((r.n for r in data.groupBy("dim").agg(F.count("*").alias("n")).collect()), default=0)
    size = block_rows or min(MOST_ROWS, max(BLOCK_ROWS, rows // BLOCKS))
    blocks = max(1, -(-rows // size))
    left = data.select("dim", F.pmod(F.xxhash64(F.lit(1), "id"), F.lit(blocks)).cast("int").alias("b"), F.lit(0).alias("part"), "id", F.lit(0).cast("long").alias("vhash"), "vector")
    right = asked.select("dim", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b"), F.lit(1).alias("part"), "id", F.xxhash64("vector").alias("vhash"), "vector")
    schema = pa.schema([("query_id", pa.int64()), ("vhash", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64()), ("size", pa.float64())])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, block = None, [], None
        for batch in batches:
            dims, bs, parts = (batch.column(c).to_numpy() for c in range(3))
            # stretches of one block's vectors or queries
            change = np.flatnonzero((np.diff(dims) != 0) | (np.diff(bs) != 0) | (np.diff(parts) != 0)) + 1
            for a, z in zip([0, *change.tolist()], [*change.tolist(), batch.num_rows]):
                if a == z:
                    continue
                now = (int(dims[a]), int(bs[a]))
                if now != key:
                    key, held, block = now, [], None
                stretch = batch.slice(a, z - a)
                if parts[a] == 0:
                    held.append(stretch)
                    continue
                if held:
                    block, held = Block(held, key[0], step), []
                for at in range(0, stretch.num_rows if block is not None else 0, block_queries):
                    some, made = stretch.slice(at, block_queries), [[], [], [], [], []]
                    for own, h, q in zip(some.column("id").to_pylist(), some.column("vhash").to_pylist(), quantised(some.column("vector"), key[0], step)):
                        found, scores = block.best(q, own, k)
                        made[0] += [own] * len(found)
                        made[1] += [h] * len(found)
                        made[2] += found.tolist()
                        whole = [int(x) for x in scores]
                        made[3] += [min(max(x, -(1 << 63)), (1 << 63) - 1) for x in whole]
                        made[4] += map(sized, whole)
                    yield pa.RecordBatch.from_arrays([pa.array(m, f.type) for m, f in zip(made, schema)], schema=schema)

    order = ["dim", "b", "part"]
    near = left.union(right).repartition("dim", "b").sortWithinPartitions(*order).mapInArrow(each, "query_id long, vhash long, vec_id long, score long, size double")
    nth = F.row_number().over(Window.partitionBy("query_id", "vhash").orderBy(F.desc("size"), F.desc("score"), "vec_id"))
    return near.withColumn("rank", nth).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return exact_top_k(vectors, vectors.where(F.col("vec_id") % EVERY == 0))


ORACLE_SQL = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
    FROM embeddings
    WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
           CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
    FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 10
"""
