"""Helpers for functions that work on Arrow batches inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters that one vectorised step takes at most, so memory does not depend on the length of texts.
BLOCK_CHARS = 1 << 18


def blocks(texts: list[str], overlap: int = 0, limit: int = BLOCK_CHARS) -> Iterator[list[tuple[int, str]]]:
    """Groups of (row, piece) of at most about ``limit`` characters; pieces of a long text overlap by ``overlap``."""
    group, size = [], 0
    for row, text in enumerate(texts):
        for at in range(0, max(1, len(text) - overlap), limit - overlap):
            piece = text if len(text) <= limit else text[at : at + limit]
            if size + len(piece) > limit and group:
                yield group
                group, size = [], 0
            group.append((row, piece))
            size += len(piece)
    if group:
        yield group


def bounded_sample(df: DataFrame, key: str, most: int, seed: str) -> DataFrame:
    """About ``most`` rows (all, if there are no more), chosen by a hash of ``key``: for fitting classifiers only."""
    n = df.count()
    if n <= most:
        return df
    return df.where(F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1_000_000)) < int(1_000_000 * most / n))
