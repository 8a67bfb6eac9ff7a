"""A stored index of chunk vectors: cells around pivots, passed over by the triangle inequality; the nearest stay exact.

Vectors count by direction. Each lies in the cell of its nearest pivot and keeps its distance (``gap``) to
it. For a query at distance ``d`` from a pivot, a vector of its cell is at least ``|d - gap|`` away, so once
``k`` documents within a radius are known, only gaps from ``d - radius`` to ``d + radius`` can matter. How
much that leaves out depends on the data: vectors that form groups leave few candidates, vectors without
any structure in many dimensions nearly all. The result is the same in both cases.
"""

from __future__ import annotations

import dataclasses
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusmill.functions.vectors import cosine, for_ranking
from corpusmill.operators.retrieval import centroids
from corpusmill.schema import declared
from corpusmill.session import written_table
from corpusmill.sources.store import Staged, Store

TABLE, RETIRED, PIVOTS = "vectors", "vectors_retired", "vector_pivots"
#: The cell of vectors that have no direction: zero, not finite, with nulls, or of another length than the pivots.
UNDEFINED = -1
#: Pivots are fitted on the vectors of least hash, so many at most, in so many rounds; every vector is indexed.
SAMPLE, ROUNDS = 4096, 5
#: Fewest and most pivots; in between, the square root of the number of vectors.
LEAST_PIVOTS, MOST_PIVOTS = 8, 256
#: Chunks read first for each wanted document, to learn a radius.
FIRST = 8
#: Retired vectors as a share of all, and segments, beyond which segments are merged.
MOST_RETIRED, MOST_SEGMENTS = 0.2, 32
#: Growth of the number of vectors after which pivots are fitted anew.
GROWN = 16
#: Distances are compared with this allowance for rounding.
SLACK = 1e-6

STORED = declared("segment string, cell int, gap double, document_id bigint, ordinal int, digest bigint, embedding array<float>")
GONE = declared("document_id bigint, ordinal int, digest bigint, segment string")
PIVOT = declared("cell int, pivot array<double>, n bigint, least double, radius double, retired bigint, fitted bigint")
POINT = declared("anchor bigint, cell int, low double, high double")
KEY = ["document_id", "ordinal", "digest"]


def directions(vectors: list, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors as rows, and which of them are defined; the others are zero."""
    out, defined = np.zeros((len(vectors), size)), np.zeros(len(vectors), dtype=bool)
    for i, v in enumerate(vectors):
        x = np.asarray(v, dtype=np.float64) if v is not None and len(v) == size else np.zeros(0)
        norm = float(np.linalg.norm(x)) if len(x) else 0.0
        if norm > 0 and math.isfinite(norm):
            out[i], defined[i] = x / norm, True
    return out, defined


def fitted(sample: np.ndarray, most: int) -> np.ndarray:
    """Pivots among unit vectors: far-apart ones first, then moved to the means of their cells."""
    if not len(sample):
        return sample
    chosen, far = [0], np.linalg.norm(sample - sample[0], axis=1)
    while len(chosen) < most and far.max() > SLACK:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, np.linalg.norm(sample - sample[chosen[-1]], axis=1))
    pivots = sample[chosen]
    for _ in range(ROUNDS):
        nearest = (sample @ pivots.T).argmax(axis=1)
        sums = np.zeros_like(pivots)
        np.add.at(sums, nearest, sample)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        pivots = np.where(norms > SLACK, sums / np.maximum(norms, SLACK), pivots)
    return pivots


def _placed(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    """``rows`` with ``cell`` and ``gap``; at most 256 pivots go to the tasks."""
    size = pivots.shape[1] if pivots.ndim == 2 else 0

    @F.pandas_udf("cell int, gap double")
    def place(vectors: pd.Series) -> pd.DataFrame:
        unit, defined = directions(vectors.tolist(), size)
        if not defined.any():
            return pd.DataFrame({"cell": np.full(len(unit), UNDEFINED, dtype=np.int32), "gap": np.zeros(len(unit))})
        cell = (unit @ pivots.T).argmax(axis=1)
        gap = np.linalg.norm(unit - pivots[cell], axis=1)
        return pd.DataFrame({"cell": np.where(defined, cell, UNDEFINED).astype(np.int32), "gap": np.where(defined, gap, 0.0)})

    return rows.withColumn("at", place("embedding")).select("*", "at.cell", "at.gap").drop("at")


@dataclasses.dataclass(frozen=True)
class Neighbours:
    """``anchor, document_id, score, rank``, and how many vectors there are and were scored for each anchor."""

    rows: DataFrame
    scored: DataFrame


class VectorIndex:
    """The index of a store's chunk vectors as it was when it was opened. Rows of chunks that changed are retired."""

    def __init__(self, store: Store) -> None:
        self.store, self.folders = store, store.opened()
        rows = sorted(self._read(PIVOTS, PIVOT).collect(), key=lambda r: r["cell"])  # at most 257 rows
        self.cells = {r["cell"]: (r["n"], r["least"], r["radius"]) for r in rows if r["n"]}
        self.pivots = np.array([r["pivot"] for r in rows if r["cell"] != UNDEFINED], dtype=np.float64)
        self.n, self.n_retired = sum(r["n"] for r in rows), max([r["retired"] for r in rows], default=0)
        self.n_fitted = max([r["fitted"] for r in rows], default=0)

    def _read(self, table: str, schema: T.StructType) -> DataFrame:
        return self.store.read_parts(table, self.folders.get(table, []), schema)

    def live(self) -> DataFrame:
        """All indexed vectors (``STORED``)."""
        rows = self._read(TABLE, STORED)
        return rows.join(self._read(RETIRED, GONE), [*KEY, "segment"], "left_anti") if self.n_retired else rows

    def _fit(self, vectors: DataFrame) -> np.ndarray:
        norm = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
        vectors = vectors.where((norm > 0) & (norm < math.inf))
        n = vectors.count()
        sample = [r[0] for r in vectors.orderBy(F.xxhash64("embedding"), "document_id", "ordinal").limit(SAMPLE).select("embedding").collect()]
        sizes = sorted(len(v) for v in sample)
        unit, defined = directions(sample, sizes[len(sizes) // 2] if sizes else 0)
        return fitted(unit[defined], max(LEAST_PIVOTS, min(MOST_PIVOTS, math.isqrt(n))))

    def _segment(self, rows: DataFrame) -> Staged:
        """Vectors dealt out by cell, a large cell in several parts, each in order of the gap."""
        dealt = rows.hint("rebalance", "cell").sortWithinPartitions("cell", "gap")
        return self.store.stage(TABLE, dealt, segment=True, by=("cell",))

    def changed(self, chunks: DataFrame) -> list[Staged]:
        """Staged parts that bring the index to the vectors of ``chunks``, to be published with them; none if nothing changed.

        Chunks without a vector are not indexed; chunks of equal document, ordinal and vector count once.
        Pivots are fitted when an index is begun, and again when segments are merged.
        """
        vectors = chunks.where("embedding is not null").select("document_id", "ordinal", F.xxhash64("embedding").alias("digest"), "embedding").dropDuplicates(KEY)
        known = self.live().select(*KEY, "segment")
        both = known.join(vectors.select(*KEY, F.lit(True).alias("now")), KEY, "full_outer").where("segment is null or now is null")
        moved = written_table(both.select(*KEY, "segment"))
        if moved.isEmpty():
            return []
        new = vectors.join(moved.where("segment is null").select(*KEY), KEY, "left_semi")
        gone = written_table(self._read(RETIRED, GONE).unionByName(moved.where("segment is not null")))
        pivots = self.pivots if len(self.pivots) else self._fit(new)
        fresh = self._segment(_placed(new, pivots).select("cell", "gap", *KEY, "embedding"))
        n_gone, segments = gone.count(), [*self.folders.get(TABLE, []), fresh.folder]
        fits = self.n_fitted or new.count()
        if len(segments) > MOST_SEGMENTS or n_gone > MOST_RETIRED * max(1, self.n) or self.n > GROWN * fits:
            after = self.store.read_parts(TABLE, segments, STORED).join(gone, [*KEY, "segment"], "left_anti").select(*KEY, "embedding")
            pivots, fits = self._fit(after), after.count()
            fresh = dataclasses.replace(self._segment(_placed(after, pivots).select("cell", "gap", *KEY, "embedding")), added=False)
            gone, n_gone, segments = gone.limit(0), 0, [fresh.folder]
        rows = self.store.read_parts(TABLE, segments, STORED).join(gone, [*KEY, "segment"], "left_anti")
        found = {r["cell"]: r for r in rows.groupBy("cell").agg(F.count("*").alias("n"), F.min("gap").alias("least"), F.max("gap").alias("radius")).collect()}
        numbers = []
        for cell, pivot in [(UNDEFINED, []), *enumerate(pivots.tolist())]:
            n, least, radius = (found[cell]["n"], found[cell]["least"], found[cell]["radius"]) if cell in found else (0, 0.0, 0.0)
            numbers.append((cell, pivot, n, least, radius, n_gone, fits))
        sums = self.store.spark.createDataFrame(numbers, PIVOT).coalesce(1)
        return [fresh, self.store.stage(RETIRED, gone), self.store.stage(PIVOTS, sums)]

    def update(self, chunks: DataFrame) -> "VectorIndex":
        """Bring the index to ``chunks`` in a commit of its own; the index as it is then."""
        staged = self.changed(chunks)
        if staged:
            self.store.publish(staged)
        return VectorIndex(self.store)

    # --- searching ---

    def _windows(self, distances: dict[int, np.ndarray | None], radius: dict[int, float]) -> list[tuple]:
        """Cells and gaps that can hold a vector within the radius of an anchor."""
        rows = []
        for anchor, far in distances.items():
            for cell, (_, least, most) in self.cells.items():
                if far is None or math.isinf(radius[anchor]):
                    rows.append((anchor, cell, -1.0, math.inf))
                elif cell != UNDEFINED:
                    low, high = float(far[cell]) - radius[anchor] - SLACK, float(far[cell]) + radius[anchor] + SLACK
                    if low <= most and high >= least:
                        rows.append((anchor, cell, low, high))
        return rows

    def _first(self, distances: dict[int, np.ndarray | None], k: int) -> list[tuple]:
        """The nearest cells of each anchor that hold enough vectors to learn a radius from."""
        rows = []
        for anchor, far in distances.items():
            held = 0
            for cell in sorted((c for c in self.cells if c != UNDEFINED), key=lambda c: far[c]) if far is not None else ():
                rows.append((anchor, cell, -1.0, math.inf))
                held += self.cells[cell][0]
                if held >= FIRST * k:
                    break
        return rows

    def _scored(self, windows: list[tuple], points: DataFrame, seen: DataFrame) -> DataFrame:
        """``anchor, document_id, score, n`` of the documents with vectors in the windows: only their cells are read."""
        cells, low, high = sorted({w[1] for w in windows}), min([w[2] for w in windows], default=0.0), max([w[3] for w in windows], default=0.0)
        wanted = self.store.spark.createDataFrame(windows, POINT).coalesce(1)  # anchors times cells, both bounded
        rows = self.live().where(F.col("cell").isin(cells) & F.col("gap").between(low, high)).select("cell", "gap", "document_id", "embedding")
        rows = rows.join(seen, "document_id", "left_semi")
        pairs = rows.join(F.broadcast(wanted), "cell").where(F.col("gap").between(F.col("low"), F.col("high")) & (F.col("document_id") != F.col("anchor")))
        pairs = pairs.join(F.broadcast(points), "anchor")
        score = for_ranking(cosine(F.col("embedding"), F.col("centroid")))
        return written_table(pairs.groupBy("anchor", "document_id").agg(F.max(score).alias("score"), F.count("*").alias("n")))

    def nearest(self, docs: DataFrame, anchors: DataFrame, visible, k: int) -> Neighbours:
        """The ``k`` nearest visible documents of each anchor's centroid, equal to ``retrieval.related`` over the indexed chunks.

        ``anchors`` (``document_id``) is a query set of known small size: its centroids come to the driver.
        Anchors without a vector have no row. Ties go to the smaller id; vectors without a direction come last.
        """
        spark, live = self.store.spark, self.live()
        wanted = [r[0] for r in anchors.select("document_id").distinct().collect()]
        own = live.where(F.col("document_id").isin(wanted)).select("document_id", "embedding")
        found = [(r["document_id"], r["centroid"]) for r in centroids(own).collect()]
        points = spark.createDataFrame(found, "anchor bigint, centroid array<double>").coalesce(1)
        unit, defined = directions([c if all(x is not None for x in c) else None for _, c in found], self.pivots.shape[1] if len(self.pivots) else 0)
        distances = {a: np.linalg.norm(self.pivots - u, axis=1) if ok else None for (a, _), u, ok in zip(found, unit, defined)}
        seen = docs.where(visible).select(F.col("id").alias("document_id"))

        def best(rows: DataFrame) -> DataFrame:
            order = Window.partitionBy("anchor").orderBy(F.col("score").desc(), "document_id")
            return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

        radius = {a: math.inf for a in distances}
        for r in best(self._scored(self._first(distances, k), points, seen)).where(F.col("rank") == k).collect():
            if math.isfinite(r["score"]):
                radius[r["anchor"]] = math.sqrt(max(0.0, 2 - 2 * r["score"]))
        rows = self._scored(self._windows(distances, radius), points, seen)
        scored = points.select("anchor").join(rows.groupBy("anchor").agg(F.sum("n").alias("scored")), "anchor", "left")
        return Neighbours(best(rows.drop("n")), scored.select("anchor", F.lit(self.n).cast("long").alias("vectors"), F.coalesce("scored", F.lit(0)).alias("scored")))
