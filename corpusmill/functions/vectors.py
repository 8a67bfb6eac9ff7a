"""Vector functions: cosine similarity, centroids, packing."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity in double precision; NaN if a vector is zero."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms == 0, F.lit(float("nan"))).otherwise(dot(a, b) / norms)


def cosine_to(query: list[float]):
    """A vectorised similarity to one fixed vector: whole Arrow batches as matrices."""
    target = np.asarray(query, dtype=np.float64)
    size = float(np.linalg.norm(target))

    @F.pandas_udf(T.DoubleType())
    def similarity(vectors: pd.Series) -> pd.Series:
        if not len(vectors):
            return pd.Series([], dtype="float64")
        matrix = np.stack(vectors.to_numpy()).astype(np.float64)
        norms = np.linalg.norm(matrix, axis=1) * size
        with np.errstate(divide="ignore", invalid="ignore"):
            return pd.Series(np.where(norms == 0, np.nan, matrix @ target / norms))

    return similarity


def for_ranking(similarity: Column) -> Column:
    """Similarity with NaN last in descending order."""
    return F.when(F.isnan(similarity) | similarity.isNull(), F.lit(float("-inf"))).otherwise(similarity)


@F.pandas_udf(T.ArrayType(T.FloatType()))
def unpacked(blobs: pd.Series) -> pd.Series:
    """Little-endian 32-bit floats from bytes."""
    return blobs.map(lambda b: np.frombuffer(b, dtype="<f4"), na_action="ignore")


@F.pandas_udf(T.BinaryType())
def packed(vectors: pd.Series) -> pd.Series:
    return vectors.map(lambda v: np.asarray(v, dtype="<f4").tobytes(), na_action="ignore")
