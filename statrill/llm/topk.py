"""Exact top-k inner products by a bit-sliced index.

Components become integers floor(256 * x). A block of rows is indexed by bitmaps: for each attribute, one for each bit of
its value without the lowest ones. For a query with coarser weights, the slices of all attributes, shifted by the bits of
their weights (complemented for negative ones), are summed with carry-save adders on whole bitmaps. The k-th largest sum
is read off from the most significant slice downward; every row whose sum is within the rounding errors' bound of it (by
the Cauchy-Schwarz inequality) is a boundary row, and is resolved with its exact integer score.

Queries meet rows in cells of a grid: a cell holds up to SIDE blocks of queries and as many blocks of rows, whose index it
builds once. It gives the k best rows of each of its queries; the best of these over all cells are the result.

Vectors that are null or empty, or hold a null or non-finite component, or have no id, take no part. Vectors of unequal
length do not meet. Repeated rows count each; ties go to the smaller id. An empty table gives an empty one. Very long vectors
are indexed whole. Scores are 64-bit integers, which components beyond some 2**20 may exceed. Other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, table

SCALE, LOW_BITS, WEIGHT = 256, 2, 4
#: Rows of a block of the index, and of a block of queries; cells that are sought, and blocks of a cell's side at most.
ROWS, QUERIES, CELLS, SIDE = 8192, 256, 4096, 8


def quantised(vectors: DataFrame, id_: str, vector: str) -> DataFrame:
    """id, x (array<long>), dim of the vectors that take part."""
    x = F.transform(vector, lambda v: v.cast("double"))
    bad = F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    whole = F.transform("x", lambda v: F.floor(v * SCALE).cast("long"))
    return vectors.select(F.col(id_).cast("long").alias("id"), x.alias("x")).where(F.col("id").isNotNull() & F.col("x").isNotNull() & (F.size("x") > 0) & ~bad).select("id", whole.alias("x"), F.size("x").alias("dim"))


def blocks(rows: DataFrame, size: int, name: str) -> tuple[DataFrame, int]:
    """One row for each block: dim, its number, ids and the integer matrix as bytes; and how many numbers there are."""
    n = max(1, -(-rows.count() // size))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        return pd.DataFrame({"dim": [pdf["dim"].iloc[0]], name: [pdf["block_"].iloc[0]], f"{name}_ids": [pdf["id"].to_numpy(np.int64).tobytes()], f"{name}_x": [np.stack(pdf["x"].to_numpy()).astype(np.int64).tobytes()]})

    return stored(rows.withColumn("block_", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")).groupBy("dim", "block_").applyInPandas(pack, f"dim int, {name} int, {name}_ids binary, {name}_x binary")), n


class BitSlices:
    """Bitmaps over the rows of a block: planes[attribute, bit] of the values above the lowest, without their low bits."""

    def __init__(self, x: np.ndarray):
        self.rows, self.low = len(x), int(x.min()) >> LOW_BITS
        u = (x >> LOW_BITS) - self.low
        self.bits = max(1, int(u.max()).bit_length())
        width = -(-self.rows // 64) * 64
        planes = np.zeros((x.shape[1], self.bits, width), np.uint8)
        for j in range(self.bits):
            planes[:, j, : self.rows] = (u >> j & 1).T
        self.planes = np.packbits(planes, axis=2, bitorder="little").view(np.uint64)
        self.every = np.packbits(np.arange(width) < self.rows, bitorder="little").view(np.uint64)
        middle = ((u + self.low) << LOW_BITS) + ((1 << LOW_BITS) - 1) / 2
        self.norm, self.off = float(np.sqrt((middle**2).sum(1)).max()), float(np.sqrt(((x - middle) ** 2).sum(1)).max())

    def sums(self, weights: np.ndarray) -> list[np.ndarray]:
        """Slices, least significant first, of the rows' weighted sums; a negative weight counts how far a value falls short."""
        piles: list[list[np.ndarray]] = []
        for sign in (1, -1):
            some = np.flatnonzero(np.sign(weights) == sign)
            source = self.planes[some] if sign > 0 else ~self.planes[some] & self.every
            size = np.abs(weights[some])
            for i in range(int(size.max()).bit_length() if len(some) else 0):
                taken = source[(size >> i & 1).astype(bool)]
                for j in range(self.bits if len(taken) else 0):
                    piles += [[] for _ in range(i + j + 1 - len(piles))]
                    piles[i + j].append(taken[:, j])
        out, carried = [], []
        p = 0
        while p < len(piles) or carried:
            stack = [*(piles[p] if p < len(piles) else []), *carried]
            pile = np.concatenate(stack) if stack else np.zeros((0, len(self.every)), np.uint64)
            carried = []
            while len(pile) > 1:
                third = max(1, len(pile) // 3)
                if len(pile) == 2:
                    a, b = pile[:1], pile[1:]
                    carried.append(a & b)
                    pile = a ^ b
                    continue
                a, b, c = pile[:third], pile[third : 2 * third], pile[2 * third : 3 * third]
                half = a ^ b
                carried.append((a & b) | (half & c))
                pile = np.concatenate([half ^ c, pile[3 * third :]])
            out.append(pile[0] if len(pile) else np.zeros(len(self.every), np.uint64))
            p += 1
        return out

    def among(self, slices: list[np.ndarray], k: int) -> int:
        """The k-th largest sum."""
        tied, above, value = self.every, 0, 0
        for p in range(len(slices) - 1, -1, -1):
            ones = tied & slices[p]
            n = int(np.bitwise_count(ones).sum())
            if above + n >= k:
                tied, value = ones, value | 1 << p
            else:
                above, tied = above + n, tied & ~slices[p]
        return value

    def at_least(self, slices: list[np.ndarray], least: int) -> np.ndarray:
        """Rows whose sum is so large."""
        if least <= 0:
            return np.arange(self.rows)
        if least >> len(slices):
            return np.arange(0)
        tied, above = self.every, np.zeros_like(self.every)
        for p in range(len(slices) - 1, -1, -1):
            if least >> p & 1:
                tied = tied & slices[p]
            else:
                above, tied = above | (tied & slices[p]), tied & ~slices[p]
        return np.flatnonzero(np.unpackbits((above | tied).view(np.uint8), bitorder="little")[: self.rows])

    def candidates(self, q: np.ndarray, k: int) -> np.ndarray:
        """Rows among which the k of the largest scores are."""
        if self.rows <= k:
            return np.arange(self.rows)
        weights = np.floor_divide(q + WEIGHT // 2, WEIGHT)
        bound = float(np.sqrt((q.astype(float) ** 2).sum())) * self.off + float(np.sqrt(((q - WEIGHT * weights).astype(float) ** 2).sum())) * self.norm
        slices = self.sums(weights)
        if not slices:
            return np.arange(self.rows)
        return self.at_least(slices, self.among(slices, k) - int(2 * bound / (WEIGHT << LOW_BITS)) - 2)


def top_k(queries: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """query_id, rank, id, score: the k rows of the largest score for each query, other than those of its own id."""
    (some, n), (every, m) = blocks(queries, QUERIES, "query"), blocks(rows, ROWS, "row")
    side = min(SIDE, math.ceil(math.sqrt(n * m / CELLS)))
    tile = lambda name: F.floor(F.col(name) / side).cast("int")
    along = lambda n: F.explode(F.sequence(F.lit(0), F.lit((n - 1) // side)))
    some = some.select("dim", tile("query").alias("i"), along(m).alias("j"), "query_ids", "query_x")
    every = every.select("dim", along(n).alias("i"), tile("row").alias("j"), "row_ids", "row_x")

    def run(own: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"query_id": [], "id": [], "score": []}, dtype="int64")]
        for row in own.itertuples(index=False):
            ids, x = np.frombuffer(row.row_ids, np.int64), np.frombuffer(row.row_x, np.int64).reshape(-1, row.dim)
            index = BitSlices(x)
            for block in others.itertuples(index=False):
                for query, q in zip(np.frombuffer(block.query_ids, np.int64), np.frombuffer(block.query_x, np.int64).reshape(-1, block.dim), strict=True):
                    few = index.candidates(q, k + int((ids == query).sum()))
                    few = few[ids[few] != query]
                    score = x[few] @ q
                    best = np.lexsort((ids[few], -score))[:k]
                    out.append(pd.DataFrame({"query_id": query, "id": ids[few][best], "score": score[best]}))
        return pd.concat(out)

    cell = ("dim", "i", "j")
    best = every.groupBy(*cell).cogroup(some.groupBy(*cell)).applyInPandas(run, "query_id long, id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def op6_bit_sliced_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quantised(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return top_k(rows.where("id % 50 = 0"), rows, 5).withColumnRenamed("id", "vec_id")


ORACLE_SQL = {
    "op6_bit_sliced_top_k": """
    with v as (
      select vec_id, [floor(256 * x::double)::bigint for x in embedding] as x from embeddings
      where vec_id is not null and embedding is not null and len(embedding) > 0 and len([y for y in embedding if y is null or not isfinite(y)]) = 0),
    s as (
      select q.vec_id as query_id, c.vec_id, list_sum([q.x[i] * c.x[i] for i in range(1, len(q.x) + 1)])::bigint as score
      from v q join v c on q.vec_id <> c.vec_id and len(q.x) = len(c.x) where q.vec_id % 50 = 0)
    select query_id, rank, vec_id, score from (
      select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from s) where rank <= 5"""
}
