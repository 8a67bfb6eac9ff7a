"""Exact top-k by inner product of integer vectors: columnar branch-and-bound.

Vectors lie column by column (one row of a matrix for each dimension). Scores grow by blocks of dimensions,
those with most of the queries' mass first. After each block, what the remaining dimensions can still add to
a pair is bounded by the product of the lengths of what remains of both vectors; pairs that cannot reach the
query's k-th best score are dropped and the survivors are compacted. Queries go to the tasks in blocks of
bounded size; a task keeps k rows for each query of the block.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.session import written_table

#: Bytes of query vectors that are broadcast at once; more queries take more passes.
BLOCK_BYTES = 16 << 20
#: Rows whose scores give each query a first k-th best score: a bounded sample, it only starts the pruning.
SEED_ROWS = 4096
#: Queries that meet one batch of candidates at a time, and dimensions that are added at once.
TILE_QUERIES, DIM_BLOCK = 256, 8
#: Below this share of surviving pairs they are listed one by one, above it columns without any are left out.
SPARSE = 0.1
#: Sums up to this are exact in doubles.
EXACT = float(1 << 53)

_FOUND = "query_id bigint, vec_id bigint, score bigint"


def component_limit(dims: int) -> int:
    """The greatest size of a component for which an inner product fits 64 bits; larger ones are cut to it."""
    return 1 << ((62 - max(dims, 1).bit_length()) // 2)


def usable(vector: Column) -> Column:
    """True for vectors that are not null and hold finite components only."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True))


def integer_matrix(column: pa.ListArray, rows: np.ndarray, dims: int, scale: int) -> np.ndarray:
    """floor(scale * x) of some rows with ``dims`` components each, one row of the matrix for each dimension."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    starts = np.concatenate([[0], np.cumsum(np.asarray(column.value_lengths()))])[:-1][rows]
    limit = float(component_limit(dims))
    return np.clip(np.floor(values[starts[None, :] + np.arange(dims)[:, None]] * scale), -limit, limit)


@dataclass
class Queries:
    """A block of queries of one length: components by dimension in order of mass, and the lengths of what remains."""

    ids: np.ndarray
    vectors: np.ndarray
    order: np.ndarray
    remaining: np.ndarray
    least: np.ndarray  # a score that the k-th best reaches at least


def _remaining(vectors: np.ndarray) -> np.ndarray:
    """Row b: the length of each vector from dimension b * DIM_BLOCK on."""
    dims = len(vectors)
    starts = list(range(0, dims, DIM_BLOCK))
    squares = np.add.reduceat(vectors * vectors, starts, axis=0) if dims else np.zeros((0, vectors.shape[1]))
    tail = np.cumsum(squares[::-1], axis=0)[::-1]
    return np.sqrt(np.concatenate([tail, np.zeros((1, vectors.shape[1]))]))


def build(ids: np.ndarray, vectors: np.ndarray) -> Queries:
    order = np.argsort(-(vectors * vectors).sum(axis=1), kind="stable")
    vectors = np.ascontiguousarray(vectors[order])
    return Queries(ids, vectors, order, _remaining(vectors), np.full(len(ids), -np.inf))


def surviving(queries: Queries, part: slice, vectors: np.ndarray, remaining: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (place in ``part``, candidate, score) whose score reaches the least score of the query.

    ``vectors`` are the candidates in the dimension order of the queries.
    """
    q, q_left = queries.vectors[:, part], queries.remaining[:, part]
    n_dims, n_queries, n = len(q), q.shape[1], vectors.shape[1]
    largest = (np.abs(q).max(initial=0) or 1) * (np.abs(vectors).max(initial=0) or 1) * max(n_dims, 1)
    kind = np.float64 if largest < EXACT else np.int64
    q, vectors = q.astype(kind), vectors.astype(kind)
    columns, total = np.arange(n), np.zeros((n_queries, n), dtype=kind)
    pairs: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None
    for step, at in enumerate(range(0, n_dims, DIM_BLOCK), start=1):
        block = slice(at, at + DIM_BLOCK)
        if pairs is None:
            total += q[block].T @ vectors[block][:, columns]
            able = _reaches(total, q_left[step][:, None] * remaining[step][columns][None, :], least[:, None])
            share = able.mean() if able.size else 0.0
            if share < SPARSE:
                row, column = np.nonzero(able)
                pairs = (row, columns[column], total[row, column])
            elif not (some := able.any(axis=0)).all():
                columns, total = columns[some], total[:, some]
        else:
            row, column, score = pairs
            score = score + (q[block][:, row] * vectors[block][:, column]).sum(axis=0)
            able = _reaches(score, q_left[step][row] * remaining[step][column], least[row])
            pairs = (row[able], column[able], score[able])
    if pairs is None:
        row, column = np.nonzero(total >= least[:, None])
        pairs = (row, columns[column], total[row, column])
    return pairs[0], pairs[1], pairs[2].astype(np.int64)


def _reaches(score: np.ndarray, most: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Whether a score can reach the least one; the bound is widened by more than the rounding of doubles."""
    return score + most * (1 + 1e-9) + 1e-9 * np.abs(score) + 1 >= least


def _best(row: np.ndarray, vec_id: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best entries of each row: by score, then by smaller id."""
    order = np.lexsort((vec_id, -score, row))
    row = row[order]
    first = np.flatnonzero(np.diff(row, prepend=-1))
    rank = np.arange(len(row)) - np.repeat(first, np.diff(np.append(first, len(row))))
    return order[rank < k]


def _searcher(shared, k: int, scale: int):
    """A function over batches of candidates that gives the k best of its task for each query of the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[int, Queries] = shared.value
        held = {d: (np.empty(0, dtype=np.int64),) * 3 for d in blocks}
        least = {d: b.least.copy() for d, b in blocks.items()}
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            lengths = np.asarray(batch.column(1).value_lengths())
            for dims, queries in blocks.items():
                rows = np.flatnonzero(lengths == dims)
                if not len(rows):
                    continue
                vectors = np.ascontiguousarray(integer_matrix(batch.column(1), rows, dims, scale)[queries.order])
                own, remaining = ids[rows], _remaining(vectors)
                for at in range(0, len(queries.ids), TILE_QUERIES):
                    part = slice(at, at + TILE_QUERIES)
                    row, column, score = surviving(queries, part, vectors, remaining, least[dims][part])
                    other = queries.ids[part][row] != own[column]
                    row, vec_id, score = row[other] + at, own[column[other]], score[other]
                    kept = _best(row, vec_id, score, k)
                    new = (row[kept], vec_id[kept], score[kept])
                    before = held[dims]
                    mine = (before[0] >= at) & (before[0] < at + TILE_QUERIES)
                    row, vec_id, score = (np.concatenate([b[mine], x]) for b, x in zip(before, new, strict=True))
                    kept = _best(row, vec_id, score, k)
                    row, vec_id, score = row[kept], vec_id[kept], score[kept]
                    held[dims] = tuple(np.concatenate([b[~mine], x]) for b, x in zip(before, (row, vec_id, score), strict=True))
                    full = np.flatnonzero(np.bincount(row - at, minlength=1) >= k)
                    last = np.searchsorted(row, full + at, side="right") - 1
                    least[dims][full + at] = np.maximum(least[dims][full + at], score[last])
        for dims, (row, vec_id, score) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array(blocks[dims].ids[row], pa.int64()), pa.array(vec_id, pa.int64()), pa.array(score, pa.int64())], ["query_id", "vec_id", "score"])

    return run


def _seeded(blocks: dict[int, Queries], sample: pa.Table, k: int, scale: int) -> None:
    """Give each query the k-th best score among the sampled rows: no k-th best over all rows is less."""
    for batch in sample.combine_chunks().to_batches():
        lengths = np.asarray(batch.column(1).value_lengths())
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        for dims, queries in blocks.items():
            rows = np.flatnonzero(lengths == dims)
            if len(rows) <= k:
                continue
            vectors = np.ascontiguousarray(integer_matrix(batch.column(1), rows, dims, scale)[queries.order])
            remaining = _remaining(vectors)
            for at in range(0, len(queries.ids), TILE_QUERIES):
                part = slice(at, at + TILE_QUERIES)
                row, column, score = surviving(queries, part, vectors, remaining, queries.least[part])
                other = queries.ids[part][row] != ids[rows][column]
                row, score = row[other], score[other]
                kept = _best(row, column[other], score, k)
                row, score = row[kept], score[kept]
                full = np.flatnonzero(np.bincount(row, minlength=1) >= k)
                queries.least[full + at] = score[np.searchsorted(row, full, side="right") - 1]


def top_k(candidates: DataFrame, queries: DataFrame, k: int, scale: int, block_bytes: int = BLOCK_BYTES, seed_rows: int = SEED_ROWS) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k best candidates of each query, ties to the smaller id.

    Both tables have ``vec_id, embedding``. Components become floor(scale * x), cut to the size for which
    scores fit 64 bits (``component_limit``). Rows with a null id, a null vector or null or non-finite
    components take no part; a query meets vectors of its own length only, and no row of its own id. If a
    query's id occurs more than once, the least of its vectors asks; a candidate row that occurs more than
    once is found as often. Fewer than k candidates are all found; no queries or candidates give no rows.
    """
    spark = candidates.sparkSession

    def taking_part(df: DataFrame) -> DataFrame:
        return df.where(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))

    rows = taking_part(candidates)
    asking = taking_part(queries).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    size = asking.select(F.coalesce(F.sum(F.size("embedding") * 8 + 16), F.lit(0))).first()[0]
    n_blocks = max(1, -(-int(size) // (block_bytes // 2)))
    asking = asking.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)))
    if n_blocks > 1:
        asking = written_table(asking)
    total = rows.count()
    share = int(1_000_000 * min(1.0, seed_rows / max(total, 1)))
    sample = rows.where(F.pmod(F.xxhash64("vec_id", F.lit("seed")), F.lit(1_000_000)) < share).limit(2 * seed_rows).toArrow()
    found: DataFrame | None = None
    for number in range(n_blocks):
        block = asking.where(F.col("block") == number).select("vec_id", "embedding").toArrow().combine_chunks()
        blocks: dict[int, Queries] = {}
        for batch in block.to_batches():
            lengths = np.asarray(batch.column(1).value_lengths())
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for dims in np.unique(lengths).tolist():
                at = np.flatnonzero(lengths == dims)
                blocks[dims] = build(ids[at], integer_matrix(batch.column(1), at, dims, scale))
        _seeded(blocks, sample, k, scale)
        shared = spark.sparkContext.broadcast(blocks)
        near = rows.mapInArrow(_searcher(shared, k, scale), _FOUND)
        best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        ranked = near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
        if n_blocks > 1:
            ranked = written_table(ranked)
            shared.destroy()
        found = ranked if found is None else found.unionByName(ranked)
    return found


def nearest_vectors(embeddings: DataFrame) -> DataFrame:
    """The ten highest inner products of floor(1024 * x) for each row whose id is divisible by 100."""
    return top_k(embeddings, embeddings.where(F.col("vec_id") % 100 == 0), k=10, scale=1024)


def oracle() -> str:
    return """
    WITH v AS (SELECT CAST(vec_id AS BIGINT) AS vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings
        WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
        FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
    r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
    SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10"""
