"""Exact top-k search by inner product over sorted lists, without random access (NRA).

Components become whole numbers, and rows are packed into blocks of vectors where they lie, without a shuffle. A block
holds one list a dimension, its vectors sorted by that component; a query reads each list from its better end. After
every stretch of the lists each vector has a lower and an upper bound of its score: what was read of it, and for the
dimensions not read yet the last value of the list, or the value at which reading stands. Reading stops once few
vectors can reach the k-th best lower bound; the scores of these are then resolved. The k best so far are carried from
block to block, so that later blocks stop earlier.

Query blocks meet candidate blocks by an equi-join on (query block, slice): the candidate blocks of a slice stream
through a task one by one, and each slice gives at most k rows a query to the merge.

Defined cases: vectors that are null or hold null or non-finite components take no part; vectors of different lengths
are compared over the positions that both have; a null id is no query, and ranks after others on ties; rows that
repeat an id are rows of their own and each other's candidates; an empty table gives an empty table; other columns are
ignored; components and scores beyond a long are given as the nearest long.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut

SCALE, BEST, QUERY_STEP = 256, 5, 50
#: Vectors of a candidate block and of a query block, and the components that either holds at most.
BLOCK, QUERIES, NUMBERS = 4096, 512, 1 << 20
#: Candidate blocks that a slice is meant to have, and slices at most.
SLICE_BLOCKS, MOST_SLICES = 8, 1024
#: Shares of the lists after which the bounds are compared, and the candidates, by k, with which reading may stop.
DEPTHS, FEW = (1 / 8, 1 / 2, 1.0), 8
#: Pairs of blocks in an Arrow batch.
PAIRS = 4
LONG = (-(1 << 63), (1 << 63) - 1)
PACKED = "part long, seq long, n int, width int, ids binary, no_ids binary, rows binary, numbers binary"


def whole_numbers(vector: Column, scale: int = SCALE) -> Column:
    return F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))


def is_finite(vector: Column) -> Column:
    return vector.isNotNull() & F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))


def _pack(limit: int):
    """Packs each partition's rows (row, id, numbers) into blocks, as they come."""

    def block(part: int, seq: int, held: list[tuple]) -> pa.RecordBatch:
        width = max(len(h[2]) for h in held)
        numbers = np.zeros((len(held), width), np.int64)
        for i, h in enumerate(held):
            numbers[i, : len(h[2])] = h[2]
        if numbers.size == 0 or np.abs(numbers.astype(np.float64)).max() < 1 << 31:
            numbers = numbers.astype(np.int32)
        ids, no_ids = [h[1] or 0 for h in held], [h[1] is None for h in held]
        cells = [pa.array([v], t) for v, t in zip((part, seq, len(held), width), (pa.int64(), pa.int64(), pa.int32(), pa.int32()))]
        cells += [pa.array([a.tobytes()], pa.binary()) for a in (np.array(ids, np.int64), np.array(no_ids, np.bool_), np.array([h[0] for h in held], np.int64), numbers)]
        return pa.RecordBatch.from_arrays(cells, [c.split()[0] for c in PACKED.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, held, widest = TaskContext.get().partitionId(), 0, [], 0
        for batch in batches:
            numbers = batch.column("numbers")
            flat, ends = numbers.values.to_numpy(zero_copy_only=False), numbers.offsets.to_numpy()
            for i, (row, key) in enumerate(zip(batch.column("row").to_pylist(), batch.column("id").to_pylist())):
                one = flat[ends[i] : ends[i + 1]]
                widest = max(widest, len(one))
                if held and (len(held) == limit or (len(held) + 1) * widest > NUMBERS):
                    yield block(part, seq, held)
                    seq, held, widest = seq + 1, [], len(one)
                held.append((row, key, one))
        if held:
            yield block(part, seq, held)

    return run


class Block:
    """A packed block: ids, rows (their identities) and a matrix of whole numbers."""

    def __init__(self, n: int, width: int, ids: bytes, no_ids: bytes, rows: bytes, numbers: bytes) -> None:
        self.ids, self.no_ids, self.rows = np.frombuffer(ids, np.int64), np.frombuffer(no_ids, np.bool_), np.frombuffer(rows, np.int64)
        self.numbers = np.frombuffer(numbers, np.int32 if len(numbers) == 4 * n * width else np.int64).reshape(n, width)

    def most(self) -> int:
        """The largest absolute component."""
        return max(int(self.numbers.max()), -int(self.numbers.min())) if self.numbers.size else 0

    def widened(self, width: int, kind: type) -> np.ndarray:
        out = np.zeros((len(self.numbers), width), kind)
        out[:, : self.numbers.shape[1]] = self.numbers
        return out


def _exact_type(queries: Block, found: Block, width: int) -> type:
    """The fastest type in which every sum is exact: a float while all sums fit its fraction, else Python's integers."""
    most = 2 * queries.most() * found.most() * max(width, 1)
    return np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else object


def nra(queries: Block, found: Block, best: list[list[tuple]], k: int) -> None:
    """Brings best, each query's k best (-score, has no id, id), up to date with the vectors of found."""
    width, n = max(queries.numbers.shape[1], found.numbers.shape[1]), len(found.rows)
    kind = _exact_type(queries, found, width)
    q, x = queries.widened(width, kind), found.widened(width, kind)
    order = np.argsort(-x, axis=0, kind="stable")  # the lists, from the largest component down
    lists, place = np.take_along_axis(x, order, axis=0), np.empty((n, width), np.int64)
    np.put_along_axis(place, order, np.broadcast_to(np.arange(n)[:, None], order.shape), axis=0)
    own = {row: j for j, row in enumerate(found.rows.tolist())}
    going, read, done = np.arange(len(q)), np.zeros((len(q), n), kind), 0
    for depth in DEPTHS:
        upto = min(n, max(done + 1, math.ceil(n * depth)))
        up, down = np.maximum(q[going], 0), np.minimum(q[going], 0)
        from_top, from_end = (place >= done) & (place < upto), (place < n - done) & (place >= n - upto)
        read = read + up @ np.where(from_top, x, 0).T + down @ np.where(from_end, x, 0).T
        low = high = read
        if upto < n:
            top_left, end_left = place >= upto, place < n - upto
            high = read + up @ np.where(top_left, lists[upto - 1], 0).T + down @ np.where(end_left, lists[n - upto], 0).T
            low = read + up @ np.where(top_left, lists[-1], 0).T + down @ np.where(end_left, lists[0], 0).T
        open_still = []
        for at, i in enumerate(going.tolist()):
            mine = own.get(int(queries.rows[i]))
            floors = low[at] if mine is None else np.delete(low[at], mine)
            floors = np.partition(floors, len(floors) - k)[-k:] if len(floors) > k and kind is not object else floors
            sure = sorted([*(-b[0] for b in best[i]), *floors.tolist()], reverse=True)[:k]
            able = np.flatnonzero(high[at] >= sure[-1]) if len(sure) == k else np.arange(n)
            if upto < n and len(able) > FEW * k:
                open_still.append(at)
                continue
            able = able if mine is None else able[able != mine]
            scores = read[at][able] if upto == n else x[able] @ q[i]
            if kind is not object:
                able, scores = (a[np.lexsort((found.ids[able], found.no_ids[able], -scores))[:k]] for a in (able, scores))
            fresh = [(-int(s), bool(found.no_ids[j]), int(found.ids[j])) for j, s in zip(able.tolist(), scores.tolist())]
            best[i] = sorted([*best[i], *fresh])[:k]
        going, read, done = going[open_still], read[open_still], upto
        if not len(going) or done == n:
            return


def _search(k: int):
    """Streams pairs of blocks, sorted by (query block, slice), and gives each query's k best of the slice."""

    def given(queries: Block, best: list[list[tuple]]) -> pd.DataFrame:
        rows = [(int(queries.rows[i]), int(queries.ids[i]), None if no_id else found, min(max(-less, LONG[0]), LONG[1])) for i, b in enumerate(best) for less, no_id, found in b]
        frame = pd.DataFrame(rows, columns=["query_row", "query_id", "vec_id", "score"], dtype=object)
        return frame.astype({"query_row": "int64", "query_id": "int64", "vec_id": "Int64", "score": "int64"})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, queries, best = None, None, []
        for frame in frames:
            for r in frame.itertuples(index=False):
                if (r.q_part, r.slice) != at:
                    if at is not None:
                        yield given(queries, best)
                    at, queries = (r.q_part, r.slice), Block(r.q_n, r.q_width, r.q_ids, r.q_no_ids, r.q_rows, r.q_numbers)
                    best = [[] for _ in range(r.q_n)]
                nra(queries, Block(r.n, r.width, r.ids, r.no_ids, r.rows, r.numbers), best, k)
        if at is not None:
            yield given(queries, best)

    return run


def top_k(vectors: DataFrame, asks: Column, k: int = BEST, key: str = "vec_id", vector: str = "embedding", scale: int = SCALE, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): for every row that asks (a condition on the row), its k other rows of most score."""
    told = vectors.where(is_finite(F.col(vector))).select(F.col(key).cast("long").alias("id"), F.coalesce(asks, F.lit(False)).alias("asks"), whole_numbers(F.col(vector), scale).alias("numbers"))
    rows = cut(told.withColumn("row", F.monotonically_increasing_id()), "vectors")
    asking = rows.where("asks AND id IS NOT NULL").select("row", "id", "numbers")
    count, widest = asking.agg(F.count("*"), F.max(F.size("numbers"))).first()
    q_blocks = max(1, math.ceil(count / QUERIES), math.ceil(count * (widest or 0) / NUMBERS))
    # One block a partition, so that the partition's number names it.
    asked = cut(asking.repartition(q_blocks).mapInArrow(_pack(count + 1), PACKED), "asked")
    found = cut(rows.select("row", "id", "numbers").mapInArrow(_pack(block), PACKED), "found")
    slices = min(MOST_SLICES, max(1, math.ceil(found.count() / SLICE_BLOCKS)))
    left = found.withColumn("slice", F.pmod(F.xxhash64("part", "seq"), F.lit(slices))).withColumn("q_part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(q_blocks - 1).cast("long"))))
    right = asked.select(*[F.col(c).alias(f"q_{c}") for c in asked.columns], F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slices - 1).cast("long"))).alias("slice"))
    pairs = left.join(right.hint("merge"), ["q_part", "slice"]).sortWithinPartitions("q_part", "slice")
    best = cut(pairs.mapInPandas(_search(k), "query_row long, query_id long, vec_id long, score long"), "best", batch=PAIRS)
    place = F.row_number().over(W.partitionBy("query_row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id")))
    return best.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op13_topk(vectors: DataFrame) -> DataFrame:
    return top_k(vectors, F.col("vec_id") % QUERY_STEP == 0)


ORACLE = """
WITH w AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND list_sum(list_transform(embedding, lambda x: CASE WHEN x IS NOT NULL AND isfinite(x) THEN 0 ELSE 1 END)) = 0
), s AS (
  SELECT q.r, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score FROM w q JOIN w c ON q.r <> c.r WHERE q.vec_id % 50 = 0
), t AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS n FROM s)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM t WHERE n <= 5
"""
