"""Compressed codes of vectors: one codebook for each part of a vector, entries found with fixed pivots (LAESA).

Vectors are cut into parts. For each part position some entries of the first codebook become pivots, and the
distance of every part to the pivots is computed once and stored. In each round only the distances from the
entries to the pivots are new: the difference of two distances to one pivot is a lower bound of the distance
of part and entry. Entries are tried in the order of their bounds, and an entry is evaluated exactly, in
integers, only while its bound does not exceed the best distance found so far.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.llm.topk import usable
from corpusmill.session import written_table

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Fixed pivots of each part position.
PIVOTS = 4
#: Entries that are tried at once, in the order of their bounds.
WAVE = 4


def component_limit(width: int) -> int:
    """The greatest size of a component for which squared distances fit 64 bits; larger ones are cut to it."""
    return 1 << ((60 - max(width, 1).bit_length()) // 2)


def cuts(dims: int, parts: int) -> list[slice]:
    """``parts`` consecutive parts, equal if the number of dimensions allows it."""
    edges = [p * dims // parts for p in range(parts + 1)]
    return [slice(a, b) for a, b in zip(edges, edges[1:], strict=False)]


def matrix(column: pa.ListArray, dims: int) -> np.ndarray:
    """A list column as a matrix of 64-bit integers, a row for each vector."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)


def squares(parts: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distance of every part to every entry."""
    out = np.zeros((len(parts), len(entries)), dtype=np.int64)
    for a, e in zip(parts.T, entries.T, strict=True):
        out += (a[:, None] - e[None, :]) ** 2
    return out


def chosen_pivots(entries: np.ndarray, most: int = PIVOTS) -> np.ndarray:
    """Entries far from each other: each next one is the farthest from those before, ties to the lower index."""
    chosen = [0]
    far = squares(entries, entries[:1])[:, 0]
    while len(chosen) < min(most, len(entries)) and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, squares(entries, entries[chosen[-1:]])[:, 0])
    return entries[chosen]


@dataclass
class Assigned:
    entry: np.ndarray
    square: np.ndarray
    evaluated: int  # exact evaluations, for tests and reports


def assigned(parts: np.ndarray, to_pivots: np.ndarray, entries: np.ndarray, pivots: np.ndarray, wave: int = WAVE) -> Assigned:
    """The nearest entry of each part (ties to the lower index) and its squared distance.

    ``to_pivots``: squared distances of the parts to the pivots. Bounds are lowered by more than doubles
    round, so an entry at the best distance exactly is never passed over.
    """
    n, m = len(parts), len(entries)
    from_parts, from_entries = np.sqrt(to_pivots.astype(np.float64)), np.sqrt(squares(entries, pivots).astype(np.float64))
    bound = np.zeros((n, m))
    for p in range(len(pivots)):
        np.maximum(bound, np.abs(from_parts[:, p, None] - from_entries[None, :, p]), out=bound)
    slack = 1e-9 * (from_parts.max(axis=1, initial=0)[:, None] + from_entries.max(initial=0)) + 1e-6
    bound = np.maximum(bound - slack, 0) ** 2
    order = np.argsort(bound, axis=1, kind="stable")
    best = np.full(n, np.iinfo(np.int64).max)
    entry = np.full(n, m, dtype=np.int64)
    open_rows, evaluated = np.arange(n), 0
    for at in range(0, m, wave):
        tried = order[open_rows, at : at + wave]
        able = bound[open_rows[:, None], tried] <= best[open_rows, None]
        row, column = np.nonzero(able)
        who, which = open_rows[row], tried[row, column]
        evaluated += len(who)
        square = ((parts[who] - entries[which]) ** 2).sum(axis=1)
        first = np.lexsort((which, square, who))
        who, which, square = who[first], which[first], square[first]
        lead = np.flatnonzero(np.diff(who, prepend=-1))
        who, which, square = who[lead], which[lead], square[lead]
        better = (square < best[who]) | ((square == best[who]) & (which < entry[who]))
        best[who[better]], entry[who[better]] = square[better], which[better]
        if at + wave < m:  # rows whose next bound is beyond the best are done
            open_rows = open_rows[bound[open_rows, order[open_rows, at + wave]] <= best[open_rows]]
        if not len(open_rows):
            break
    return Assigned(entry, best, evaluated)


@dataclass
class Codec:
    """Codebooks and pivots by part position."""

    dims: int
    books: list[np.ndarray]
    pivots: list[np.ndarray]

    def digest(self) -> str:
        """SHA-256 of all components, in decimal, by part, entry and position, joined by commas."""
        return hashlib.sha256(",".join(str(x) for book in self.books for x in book.ravel().tolist()).encode()).hexdigest()


def _sizes(pivots: list[np.ndarray]) -> np.ndarray:
    return np.cumsum([0, *[len(p) for p in pivots]])


def _measured(dims: int, pivots: list[np.ndarray]):
    """Adds the squared distances of all parts to their pivots to batches of vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = matrix(batch.column("v"), dims)
            far = np.concatenate([squares(vectors[:, cut], p) for cut, p in zip(cuts(dims, len(pivots)), pivots, strict=True)], axis=1)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(far) + 1, dtype=np.int32) * far.shape[1]), pa.array(far.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], [*batch.schema.names, "far"])

    return run


def _assignments(batch: pa.RecordBatch, codec: Codec) -> Iterator[tuple[int, np.ndarray, Assigned]]:
    sizes = _sizes(codec.pivots)
    vectors, far = matrix(batch.column("v"), codec.dims), matrix(batch.column("far"), int(sizes[-1]))
    for p, cut in enumerate(cuts(codec.dims, len(codec.books))):
        yield p, vectors[:, cut], assigned(vectors[:, cut], far[:, sizes[p] : sizes[p + 1]], codec.books[p], codec.pivots[p])


def _summed(codec: Codec):
    """Sums and counts of the parts of each entry: one row for each part position and entry of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros((len(b), b.shape[1] + 1), dtype=np.int64) for b in codec.books]
        for batch in batches:
            if batch.num_rows:
                for p, parts, found in _assignments(batch, codec):
                    np.add.at(total[p], found.entry, np.concatenate([parts, np.ones((len(parts), 1), dtype=np.int64)], axis=1))
        rows = [(p, e, i, int(x)) for p, t in enumerate(total) for e, row in enumerate(t) if row[-1] for i, x in enumerate(row)]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 4, [pa.int32()] * 3 + [pa.int64()], strict=True)], ["part", "entry", "place", "total"])

    return run


def _coded(codec: Codec):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            entry, error = np.zeros((n, len(codec.books)), dtype=np.uint8), np.zeros(n, dtype=np.int64)
            if n:
                for p, _, found in _assignments(batch, codec):
                    entry[:, p] = found.entry
                    error += found.square
            text = entry.tobytes().hex()
            width = 2 * len(codec.books)
            codes = pa.array([text[i * width : (i + 1) * width] for i in range(n)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), codes, pa.array(error)], ["vec_id", "label", "code", "error"])

    return run


def trained(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, Codec | None]:
    """The rows with their distances to the pivots, written, and the codec after ``rounds`` rounds (None without rows).

    ``rows`` has ``vec_id, label, v`` (a list of integers). The first codebook is that of the ``entries`` smallest ids.
    """
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select("v").collect()
    if not first:
        return rows, None
    dims = len(first[0]["v"])
    rows = rows.where(F.size("v") == dims)
    start = np.array([r["v"] for r in first if len(r["v"]) == dims], dtype=np.int64).reshape(-1, dims)
    books = [start[:, cut] for cut in cuts(dims, parts)]
    codec = Codec(dims, books, [chosen_pivots(b) for b in books])
    kept = written_table(rows.mapInArrow(_measured(dims, codec.pivots), T.StructType([*rows.schema.fields, T.StructField("far", T.ArrayType(T.LongType()))])))
    for _ in range(rounds):
        # at most one number for each component of the codebooks comes to the driver
        sums = kept.select("v", "far").mapInArrow(_summed(codec), "part int, entry int, place int, total bigint").groupBy("part", "entry", "place").agg(F.sum("total").alias("total")).collect()
        gathered: dict[tuple[int, int], dict[int, int]] = {}
        for r in sums:
            gathered.setdefault((r["part"], r["entry"]), {})[r["place"]] = r["total"]
        books = [b.copy() for b in codec.books]
        for (p, e), places in gathered.items():
            width = books[p].shape[1]
            books[p][e] = [places[i] // places[width] for i in range(width)]
        codec = Codec(dims, books, codec.pivots)
    return kept, codec


def compressed(embeddings: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256`` of each vector.

    Rows whose vector is null or holds null or non-finite components are dropped, and so are vectors of
    another length than that of the smallest id. A length that the number of parts does not divide gives
    parts that differ by one. Components become floor(scale * x), cut to the size for which distances fit 64
    bits (``component_limit``). A null id comes after all others in the first codebook; rows of one id go in
    the order of their vectors, and repeated rows count as often as they occur. Fewer rows than entries give
    as many entries as there are rows; an empty table gives no rows. Null labels are one label. At most 256
    entries (two hex digits each).
    """
    vector = F.col("embedding").cast("array<double>")
    width = F.greatest(F.lit(1), F.ceil(F.size("embedding") / F.lit(parts)))
    limit = F.pow(F.lit(2.0), F.floor((F.lit(60) - F.ceil(F.log2(width + F.lit(1)))) / 2))
    rows = embeddings.where(usable(F.col("embedding"))).select(
        F.col("vec_id").cast("long").alias("vec_id"),
        "label",
        limit.alias("limit"),
        vector.alias("x"),
    )
    rows = rows.select("vec_id", "label", F.transform("x", lambda x: F.greatest(-F.col("limit"), F.least(F.col("limit"), F.floor(x * scale).cast("double"))).cast("long")).alias("v"))
    kept, codec = trained(rows, parts, entries, rounds)
    if codec is None:
        return kept.select("vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    coded = written_table(kept.mapInArrow(_coded(codec), T.StructType([kept.schema["vec_id"], kept.schema["label"], T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])))
    by_label = written_table(coded.groupBy("label").agg(F.sum("error").alias("label_error")))
    return coded.join(by_label, coded["label"].eqNullSafe(by_label["label"])).select("vec_id", "code", "error", "label_error", F.lit(codec.digest()).alias("codebooks_sha256"))


def oracle() -> str:
    """Every part against every entry, round by round."""

    def nearest(book: str) -> str:
        return f"""SELECT vec_id, part, any_value(p) AS p, min(CAST(list_sum(list_transform(list_zip(p, e), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) * 256 + entry) AS best
        FROM parts JOIN {book} USING (part) GROUP BY vec_id, part"""

    def next_book(book: str, near: str) -> str:
        return f"""SELECT b.part, b.entry, coalesce(n.e, b.e) AS e FROM {book} b LEFT JOIN (
            SELECT part, entry, list(CAST(c AS BIGINT) ORDER BY i) AS e FROM (
                SELECT part, best % 256 AS entry, i, floor(sum(p[i]) / count(*)) AS c FROM {near}, range(1, 1 + (SELECT max(len(p)) FROM parts)) r(i) GROUP BY ALL)
            GROUP BY part, entry) n USING (part, entry)"""

    return f"""
    WITH v AS MATERIALIZED (SELECT CAST(vec_id AS BIGINT) AS vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    parts AS MATERIALIZED (SELECT vec_id, CAST(k AS INTEGER) AS part, list_slice(v, k * (len(v) // {PARTS}) + 1, (k + 1) * (len(v) // {PARTS})) AS p FROM v, range(0, {PARTS}) r(k)),
    b0 AS MATERIALIZED (SELECT part, dense_rank() OVER (ORDER BY vec_id) - 1 AS entry, p AS e FROM parts WHERE vec_id IN (SELECT vec_id FROM v ORDER BY vec_id LIMIT {ENTRIES})),
    n0 AS MATERIALIZED ({nearest("b0")}),
    b1 AS MATERIALIZED ({next_book("b0", "n0")}),
    n1 AS MATERIALIZED ({nearest("b1")}),
    b2 AS MATERIALIZED ({next_book("b1", "n1")}),
    n2 AS MATERIALIZED ({nearest("b2")}),
    c AS (SELECT vec_id, string_agg(printf('%02x', best % 256), '' ORDER BY part) AS code, CAST(sum(best // 256) AS BIGINT) AS error FROM n2 GROUP BY vec_id)
    SELECT c.vec_id, c.code, c.error, CAST(sum(c.error) OVER (PARTITION BY v.label) AS BIGINT) AS label_error,
        (SELECT sha256(string_agg(array_to_string(e, ','), ',' ORDER BY part, entry)) FROM b2) AS codebooks_sha256
    FROM c JOIN v USING (vec_id)"""
