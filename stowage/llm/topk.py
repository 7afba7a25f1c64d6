"""Exact top-k inner products by columnar branch and bound.

Vectors are stored dimension by dimension. For each query the partial scores of all candidates grow by
one block of dimensions at a time; after a block a candidate stays only if its partial score plus the
product of the two remaining Euclidean masses can reach the k-th best lower bound, and the survivors
are compacted. Components are integers, so that partial scores are exact in float64 as long as no sum can
pass 2**53; where one could, bounds allow for rounding and the survivors are scored in whole integers.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stowage.llm.common import column, longs, prepared, released

BLOCK_DIMS = 16
CHUNK_ROWS = 32768
SLICE_VALUES = 1 << 23  # components of the candidates that a task holds, as float64: 64 MiB
LEAST, MOST = -(2**63), 2**63 - 1


def _tails(matrix: np.ndarray, step: int) -> list[np.ndarray]:
    """The norms of what remains of each column after 0, 1, 2... blocks of dimensions."""
    squares = [np.square(matrix[i : i + step]).sum(axis=0) for i in range(0, len(matrix), step)]
    total = [np.zeros(matrix.shape[1])]
    for s in reversed(squares):
        total.append(total[-1] + s)
    return [np.sqrt(t) for t in reversed(total)]


def search_chunk(queries: np.ndarray, ids: np.ndarray, matrix: np.ndarray, own: np.ndarray, k: int, floor: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query (a row of ``queries``): the positions and scores of its best k of the columns of
    ``matrix`` (dimensions x candidates, sorted by id), at or above ``floor``. ``own``: the query's id."""
    step = BLOCK_DIMS
    tails, query_tails = _tails(matrix, step), _tails(queries.T, step)
    first = queries[:, :step] @ matrix[:step]  # the first block, for all queries at once
    out = []
    for q in range(len(queries)):
        alive = np.flatnonzero(ids != own[q])
        partial = first[q, alive]
        bound = floor[q]
        for block in range(1, len(tails)):
            rest = query_tails[block][q] * tails[block][alive]
            if len(alive) >= k:
                low = partial - rest
                bound = max(bound, np.partition(low, len(low) - k)[len(low) - k])
            keep = partial + rest * (1 + 1e-12) + 1e-6 >= bound
            alive, partial = alive[keep], partial[keep]
            at = block * step
            if at < len(matrix) and len(alive):
                partial = partial + queries[q, at : at + step] @ matrix[at : at + step, alive]
        if len(alive) > k:  # ids ascend, so a stable sort settles ties
            best = np.argsort(-partial, kind="stable")[:k]
            alive, partial = alive[best], partial[best]
        out.append((alive, partial))
    return out


def exact_scores(query: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Inner products with the columns of ``candidates`` in whole integers, as longs: components and
    scores beyond the ends of long count as these."""
    q = [min(MOST, max(LEAST, int(x))) for x in query.tolist()]
    return np.array([min(MOST, max(LEAST, sum(a * min(MOST, max(LEAST, int(b))) for a, b in zip(q, c, strict=True)))) for c in candidates.T.tolist()], np.int64)


def search_large(query: np.ndarray, ids: np.ndarray, matrix: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """What search_chunk gives for one query, for components of any size. Blocks of dimensions add up in
    float64; what rounding can have cost is part of each bound, and survivors are scored exactly."""
    tails, query_tails = _tails(matrix, BLOCK_DIMS), _tails(query[:, None], BLOCK_DIMS)
    alive = np.flatnonzero(ids != own)
    partial = np.zeros(len(alive))
    error = 4e-16 * (len(query) + 4) * query_tails[0][0] * tails[0] + 1
    for block in range(1, len(tails)):
        at = (block - 1) * BLOCK_DIMS
        partial = partial + query[at : at + BLOCK_DIMS] @ matrix[at : at + BLOCK_DIMS, alive]
        slack = query_tails[block][0] * tails[block][alive] * (1 + 1e-9) + error[alive]
        if len(alive) > k:
            low = np.clip(partial - slack, -(2.0**63), 2.0**63)  # a saturated score is as good as any beyond it
            keep = np.clip(partial + slack, -(2.0**63), 2.0**63) >= np.partition(low, len(low) - k)[len(low) - k]
            alive, partial = alive[keep], partial[keep]
    scores = exact_scores(query, matrix[:, alive])
    best = np.lexsort((ids[alive], ~scores))[:k]  # ~x falls as x rises, at both ends of long too
    return alive[best], scores[best]


def search(queries: np.ndarray, ids: np.ndarray, matrix: np.ndarray, own: np.ndarray, k: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """(ids, scores as longs) of each query's best k of the columns of ``matrix``, sorted by id; ties go
    to the smaller id. Goes through the columns in chunks, whose best raise the floor of the next."""
    large = len(matrix) * np.abs(queries).max(initial=0) * np.abs(matrix).max(initial=0) >= 2**53
    best_ids, best = [np.zeros(0, np.int64)] * len(own), [np.zeros(0, np.int64)] * len(own)
    floor = np.full(len(own), -np.inf)
    for c in range(0, len(ids), CHUNK_ROWS):
        part, part_ids = matrix[:, c : c + CHUNK_ROWS], ids[c : c + CHUNK_ROWS]
        found = [search_large(q, part_ids, part, o, k) for q, o in zip(queries, own.tolist(), strict=True)] if large else search_chunk(queries, part_ids, part, own, k, floor)
        for i, (at, scores) in enumerate(found):
            all_ids, scores = np.concatenate([best_ids[i], part_ids[at]]), np.concatenate([best[i], scores.astype(np.int64)])
            pick = np.lexsort((all_ids, ~scores))[:k]
            best_ids[i], best[i] = all_ids[pick], scores[pick]
            if len(pick) == k:
                floor[i] = best[i][-1]
    return best_ids, best


def top_k(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 100, k: int = 10, scale: float = 1024.0, slice_values: int = SLICE_VALUES) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest integer inner products of each query.

    Components count as floor(scale * x), x as double. Queries: the rows whose id is divisible by
    ``every``; candidates: all rows but those with the query's own id. Candidates are dealt to slices of
    some ``slice_values`` components, by a hash of their place; a task holds a slice, and all queries
    stream by it in blocks. Neither queries nor candidates pass through the driver.

    Null id, null vector, or a vector with a null or non-finite component: the row takes no part. Vectors
    of another length than the query's are no candidates of it. Ties: the smaller id first; rows that
    repeat an id count as often as they stand. Components and scores beyond the ends of long count as
    these. Fewer than k candidates: all of them. Empty table: no rows.
    """
    spark = prepared(df.sparkSession)
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = rows.where("id is not null and v is not null and size(v) > 0 and not exists(v, x -> x is null or isnan(x) or abs(x) = double('Infinity'))")
    held = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("v").cast("long")).alias("values")).first()
    slices = max(-(-(held["values"] or 0) // slice_values), min(spark.sparkContext.defaultParallelism, held["n"] // 1024), 1)
    rows = rows.withColumn("no", F.monotonically_increasing_id()).withColumn("dims", F.size("v").cast("long"))
    zero = F.lit(0).cast("long")
    candidates = rows.select(F.pmod(F.xxhash64("no"), F.lit(slices).cast("long")).alias("slice"), "dims", zero.alias("asked"), "no", "id", "v")
    queries = rows.where(F.col("id") % every == 0).select(F.explode(F.sequence(zero, F.lit(slices - 1).cast("long"))).alias("slice"), "dims", F.lit(1).cast("long").alias("asked"), "no", "id", "v")
    laid = candidates.union(queries).repartition(slices, "slice").sortWithinPartitions("slice", "dims", "asked")

    def scan(stream):
        at, held, ids, matrix = None, [], np.zeros(0, np.int64), np.zeros((0, 0))
        for batch in stream:
            if not batch.num_rows:
                continue
            keys = np.stack([longs(column(batch, c)) for c in ("slice", "dims", "asked")])
            cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
            for a, b in itertools.pairwise(cuts):
                here, asked, dims = tuple(keys[:2, a].tolist()), keys[2, a], int(keys[1, a])
                part = batch.slice(a, b - a)
                own = longs(column(part, "id"))
                values = np.floor(scale * column(part, "v").flatten().to_numpy(zero_copy_only=False)).reshape(-1, dims)
                values = np.clip(values, -(2.0**63), 2.0**63)
                if here != at:
                    at, held, ids, matrix = here, [], np.zeros(0, np.int64), np.zeros((dims, 0))
                if not asked:
                    held.append((own, values.T))
                    continue
                if held:
                    ids, matrix = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held], axis=1)
                    order, held = np.argsort(ids, kind="stable"), []
                    ids, matrix = ids[order], np.ascontiguousarray(matrix[:, order])
                number = longs(column(part, "no"))
                for q in range(0, len(own), 256):
                    best_ids, best = search(values[q : q + 256], ids, matrix, own[q : q + 256], k)
                    n = [len(x) for x in best]
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(number[q : q + 256], n)), pa.array(np.repeat(own[q : q + 256], n)), pa.array(np.concatenate(best_ids)), pa.array(np.concatenate(best))], names=["query_no", "query_id", "vec_id", "score"])

    found = laid.mapInArrow(released(scan), "query_no long, query_id long, vec_id long, score long")
    order = Window.partitionBy("query_no").orderBy(F.desc("score"), F.asc("vec_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
