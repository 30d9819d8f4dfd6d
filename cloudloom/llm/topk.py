"""Exact top-k inner products on a bit-sliced index of quantised vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a block, and queries that meet it in one task.
BLOCK_ROWS = 32_768
QUERY_PART = 2048


class BitSlicedIndex:
    """Slices of the quantised attributes of a block's rows: bit b of attribute d of all rows as one bitmap."""

    def __init__(self, ids: np.ndarray, values: np.ndarray):
        order = np.argsort(ids, kind="stable")  # rows in id order: of equal scores, the first bits win
        self.ids, self.values = ids[order], values[order]
        self.n = len(ids)
        self.low = int(self.values.min(initial=0))
        self.bits = max(1, int(self.values.max(initial=0) - self.low).bit_length())
        shifted = (self.values - self.low).astype(np.uint64)
        pad = -self.n % 64
        packed = lambda bit: np.packbits(np.pad(bit, (0, pad)), bitorder="little").view("<u8")
        self.slices = [[packed(((shifted[:, d] >> np.uint64(b)) & np.uint64(1)).astype(bool)) for b in range(self.bits)] for d in range(values.shape[1])]
        self.all = packed(np.ones(self.n, bool))

    def sum_slices(self, query: np.ndarray) -> list[np.ndarray]:
        """Slices of score + constant for all rows, by bitmap arithmetic alone.

        A negative weight multiplies the complement of its attribute's slices, which shifts all scores by the same
        constant. Each bitmap waits in the column of its weight; carry-save adders turn three of a column into one of it
        and one of the next.
        """
        columns: list[list[np.ndarray]] = []
        flipped: dict[int, list[np.ndarray]] = {}
        for d, w in enumerate(query.tolist()):
            own = self.slices[d]
            if w < 0:
                own = flipped.setdefault(d, [~s for s in own])
            w = abs(w)
            shift = 0
            while w >> shift:
                if w >> shift & 1:
                    while len(columns) < shift + self.bits:
                        columns.append([])
                    for b, s in enumerate(own):
                        columns[shift + b].append(s)
                shift += 1
        total, k = [], 0
        while k < len(columns):
            own = columns[k]
            if len(own) > 1 and k + 1 == len(columns):
                columns.append([])
            while len(own) > 2:
                a, b, c = own.pop(), own.pop(), own.pop()
                half = a ^ b
                columns[k + 1].append((a & b) | (half & c))
                half ^= c
                own.insert(0, half)
            if len(own) == 2:
                a, b = own
                columns[k + 1].append(a & b)
                own = [a ^ b]
            total.append(own[0] if own else np.zeros_like(self.all))
            k += 1
        return total

    def top(self, query: np.ndarray, own_id: int, k: int) -> list[tuple[int, int]]:
        """(row, score) of the k best rows but the query's own: the surest from the most significant slice down, then
        those on the boundary, which all have one score, by id."""
        first, last = np.searchsorted(self.ids, own_id, "left"), np.searchsorted(self.ids, own_id, "right")
        open_, sure = self.all.copy(), np.zeros_like(self.all)
        for r in range(first, last):
            open_[r // 64] &= ~(np.uint64(1) << np.uint64(r % 64))
        n_sure = 0
        if np.bitwise_count(open_).sum() > k:
            for s in reversed(self.sum_slices(query)):
                with_bit = open_ & s
                n = n_sure + int(np.bitwise_count(with_bit).sum())
                if n > k:
                    open_ = with_bit
                elif n == k:
                    sure |= with_bit
                    n_sure, open_ = n, np.zeros_like(open_)
                    break
                else:
                    sure |= with_bit
                    n_sure, open_ = n, open_ & ~s
        rows = np.concatenate([_positions(sure), _positions(open_)[: k - n_sure]])
        scores = self.values[rows] @ query
        return sorted(zip(rows.tolist(), scores.tolist()), key=lambda x: (-x[1], x[0]))[:k]


def _positions(bitmap: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))


def quantise(vectors: DataFrame, id_column: str, vector_column: str, scale: int = 256) -> DataFrame:
    """id, n (number of components) and the little-endian 64-bit floor(scale * x) of each usable vector.

    Rows with a null id, a null vector, or a null or non-finite component take no part. Values so large that a score could pass
    64 bits are an error, never a wrong score.
    """

    def run(batches):
        for b in batches:
            flat = b.column(1)
            lengths = np.diff(flat.offsets.to_numpy())
            x = np.floor(flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale)
            if len(x) and np.abs(x).max() >= 2.0**31 / max(1, lengths.max()) ** 0.5:
                raise ValueError("components are too large for scores of 64 bits: scale the vectors down")
            x = x.astype("<i8")
            edge = np.concatenate([[0], np.cumsum(lengths)])
            blobs = [x[edge[k] : edge[k + 1]].tobytes() for k in range(len(lengths))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lengths.astype(np.int32)), pa.array(blobs, pa.binary())], ["id", "n", "q"])

    usable = vectors.select(F.col(id_column).cast("bigint").alias("id"), F.col(vector_column).cast("array<double>").alias("v"))
    usable = usable.where("id is not null and v is not null and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('inf'))")
    return usable.mapInArrow(run, "id bigint, n int, q binary")


def top_k(vectors: DataFrame, queries: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", k: int = 5, scale: int = 256) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k rows of highest integer inner product, ties to the smaller id.

    Rows and queries meet in a grid of blocks: each cell builds the index of its rows once and answers its queries from
    it, and the cells' best are merged for each query. Every row but those with the query's own id is a candidate; fewer
    than k candidates give as many rows. Vectors of other lengths than a query's are no candidates. Repeated rows are
    each a candidate; of several query rows with one id the smallest vector asks. Other columns are not read.
    """
    rows = quantise(vectors, id_column, vector_column, scale)
    asks = quantise(queries, id_column, vector_column, scale).groupBy("id").agg(F.min_by(F.struct("n", "q"), F.struct("n", "q")).alias("x")).select("id", "x.n", "x.q")
    n_rows, n_asks = vectors.count(), queries.count()
    blocks, parts = max(1, round(n_rows / BLOCK_ROWS)), max(1, -(-n_asks // QUERY_PART))
    own = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks)).cast("int")  # by row: a repeated id is dealt too
    part = F.pmod(F.xxhash64("id", F.lit(2)), F.lit(parts)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    cells = rows.select(own.alias("block"), every(parts).alias("part"), F.lit(0).alias("kind"), "id", "n", "q").unionByName(
        asks.select(every(blocks).alias("block"), part.alias("part"), F.lit(1).alias("kind"), "id", "n", "q")
    )

    def run(batches):
        cell, ids, blobs, index = None, [], [], None
        for b in batches:
            out = []
            for block, part, n, kind, i, q in zip(*(b.column(c).to_pylist() for c in ("block", "part", "n", "kind", "id", "q"))):
                if (block, part, n) != cell:
                    cell, ids, blobs, index = (block, part, n), [], [], None
                if kind == 0:
                    ids.append(i)
                    blobs.append(q)
                elif ids:
                    if index is None:
                        index = BitSlicedIndex(np.array(ids, np.int64), np.frombuffer(b"".join(blobs), "<i8").reshape(len(ids), n))
                        blobs = []
                    out += [(i, int(index.ids[r]), s) for r, s in index.top(np.frombuffer(q, "<i8"), i, k)]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], pa.int64()) for c in range(3)], ["query_id", "vec_id", "score"])

    dealt = cells.repartition(min(blocks * parts, 2_000) * 4, "block", "part", "n").sortWithinPartitions("block", "part", "n", "kind")
    best = dealt.mapInArrow(run, "query_id bigint, vec_id bigint, score bigint")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
