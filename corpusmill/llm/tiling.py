"""Benchmark decontamination by greedy string tiling.

Documents and benchmark items are token sequences. Shared runs of ``k`` tokens, found by a rolling
Karp-Rabin hash, seed candidate pairs; for each pair the longest common run is marked first, then the
longest among what is unmarked, and so on while runs of ``k`` tokens are left. The share of an item's
tokens that tiles cover decides, so passages count in whatever order they were copied.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.shingles import _BASE, _INVERSE, _power, mixed
from corpusmill.session import written_table

#: Least length of a tile in tokens, and the coverage of an item from which a document counts as contaminated.
LEAST_TILE, COVERAGE = 5, 0.5
#: Benchmark tokens of one block; the benchmark is a query set that goes over all documents block by block.
BLOCK_TOKENS = 1_000_000
#: Blocks that one pass over the documents takes; what it has found is written before the next pass, and their memory is freed.
PASS_BLOCKS = 4
_SPACED = bytes(32 if not (48 <= c <= 57 or 97 <= c <= 122 or c >= 128) else c for c in range(256))


def tokens(text: str | None) -> list[bytes]:
    """Lower-cased runs of letters and digits; any character beyond ASCII counts as a letter."""
    return (text or "").lower().encode("utf-8", "replace").translate(_SPACED).split()


def _sums(ids: np.ndarray) -> np.ndarray:
    """Running sums from which the Karp-Rabin hash of any run follows."""
    total = np.zeros(len(ids) + 1, dtype=np.uint64)
    np.cumsum((ids + 1).astype(np.uint64) * _power(_BASE, len(ids)), out=total[1:])
    return total


def rolling(total: np.ndarray, k: int) -> np.ndarray:
    """Karp-Rabin hash (modulo 2**64) of every run of ``k`` ids, from their running sums."""
    n = len(total) - k
    if n < 1:
        return np.empty(0, dtype=np.uint64)
    return mixed((total[k:] - total[:n]) * _power(_INVERSE, n))


@dataclass(frozen=True)
class Block:
    """Some benchmark items, with their words numbered and their seeds sorted by hash."""

    words: dict[bytes, int]
    items: list[tuple[int, np.ndarray]]
    seeds: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]


def build(rows: list[tuple[int, list[bytes]]], k: int = LEAST_TILE) -> Block:
    """Seeds by length: ``k``, and for items of fewer tokens their own length, so that these match as a whole."""
    words: dict[bytes, int] = {}
    items = [(item, np.array([words.setdefault(w, len(words)) for w in body], dtype=np.int64)) for item, body in rows if body]
    found: dict[int, list[tuple[np.ndarray, int]]] = {}
    for index, (_, ids) in enumerate(items):
        size = min(k, len(ids))
        found.setdefault(size, []).append((rolling(_sums(ids), size), index))
    seeds = {}
    for size, lists in found.items():
        hashes = np.concatenate([h for h, _ in lists])
        owner = np.concatenate([np.full(len(h), i) for h, i in lists])
        place = np.concatenate([np.arange(len(h)) for h, _ in lists])
        order = np.argsort(hashes, kind="stable")
        seeds[size] = (hashes[order], owner[order], place[order])
    return Block(words, items, seeds)


def tile(doc: np.ndarray, item: np.ndarray, k: int) -> tuple[int, int]:
    """Covered item tokens and number of tiles of at least ``k`` tokens.

    The longest common run of unmarked tokens is marked first (ties: the one that starts first in the
    document, then in the item), then the longest among what is left. Its length is found by halving, for
    a run of some length holds runs of any less; all runs of that length are marked in one walk over the
    document. Memory is in proportion to the document and the item, however often runs repeat.
    """
    sums = _sums(doc), _sums(item)
    marked = np.zeros(len(doc), dtype=bool), np.zeros(len(item), dtype=bool)

    def free(side: int, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of unmarked runs and where they start."""
        used = np.concatenate([[0], np.cumsum(marked[side])])
        at = np.flatnonzero(used[size:] == used[: len(used) - size]) if len(used) > size else np.empty(0, dtype=np.int64)
        return rolling(sums[side], size)[at], at

    tiles, most = 0, min(len(doc), len(item))
    while most >= k:
        low, high = k - 1, most
        while low < high:
            size = (low + high + 1) // 2
            if np.isin(free(1, size)[0], free(0, size)[0]).any():
                low = size
            else:
                high = size - 1
        if low < k:
            break
        begin = 0
        in_doc, at_doc = free(0, low)
        while True:
            in_item, at_item = free(1, low)
            hits = np.flatnonzero((at_doc >= begin) & np.isin(in_doc, in_item))
            if not len(hits):
                break
            d = int(at_doc[hits[0]])
            i = next((int(i) for i in at_item[in_item == in_doc[hits[0]]] if np.array_equal(doc[d : d + low], item[i : i + low])), None)
            begin = d + 1
            if i is not None:
                marked[0][d : d + low] = marked[1][i : i + low] = True
                tiles += 1
                begin = d + low
        most = low - 1
    return int(marked[1].sum()), tiles


def best_match(block: Block, text: str | None) -> tuple[float, int | None, int]:
    """Highest coverage of an item by tiles of the text, that item (of equals the smallest id), and its tiles."""
    get = block.words.get
    ids = np.array([get(w, -1) for w in tokens(text)], dtype=np.int64)
    best: tuple[float, int | None, int] = (0.0, None, 0)
    for k, (hashes, owner, place) in block.seeds.items():
        if len(ids) < k:
            continue
        known = np.convolve(ids >= 0, np.ones(k, dtype=np.int64), "valid") == k
        found = np.unique(rolling(_sums(ids), k)[known])
        low, high = np.searchsorted(hashes, found, "left"), np.searchsorted(hashes, found, "right")
        n = high - low
        if not n.sum():
            continue
        # every seed of the block at most once, however often the document holds it
        seed = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        seed = seed[np.argsort(owner[seed], kind="stable")]
        cuts = np.flatnonzero(np.diff(owner[seed])) + 1
        bounds = []
        for s in np.split(seed, cuts):
            reached = np.zeros(len(block.items[owner[s[0]]][1]) + 1, dtype=np.int64)
            np.add.at(reached, place[s], 1)
            np.add.at(reached, place[s] + k, -1)
            bounds.append((-float((np.cumsum(reached[:-1]) > 0).mean()), int(owner[s[0]])))
        for bound, index in sorted(bounds):
            if -bound < best[0]:
                break
            item, body = block.items[index]
            covered, tiles = tile(ids, body, k)
            share = covered / len(body)
            if share > best[0] or (share == best[0] and share > 0 and item < best[1]):
                best = (share, item, tiles)
    return best


def benchmark_blocks(benchmark: DataFrame, k: int = LEAST_TILE, most: int = BLOCK_TOKENS) -> Iterator[Block]:
    """The benchmark in blocks of at most ``most`` tokens (or one item); null ids and texts without tokens are left out."""
    rows, size = [], 0
    ordered = benchmark.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select(F.col("item_id").cast("long"), "text").orderBy("item_id", "text")
    for item, text in ordered.toLocalIterator():
        body = tokens(text)
        if rows and size + len(body) > most:
            yield build(rows, k)
            rows, size = [], 0
        rows.append((item, body))
        size += len(body)
    if rows:
        yield build(rows, k)


_BEST = "struct<item_id:bigint,coverage:double,tiles:int>"


def _matcher(shared):
    """A function of a text column that gives the best match within a broadcast block."""

    @F.pandas_udf(_BEST)
    def matched(texts: pd.Series) -> pd.DataFrame:
        found = [best_match(shared.value, t) for t in texts]
        return pd.DataFrame({"item_id": pd.array([f[1] for f in found], dtype="Int64"), "coverage": [f[0] for f in found], "tiles": pd.array([f[2] for f in found], dtype="int32")})

    return matched


def contamination(docs: DataFrame, benchmark: DataFrame, k: int = LEAST_TILE, coverage: float = COVERAGE, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """``docs`` with ``item_id, coverage, tiles, contaminated`` for the item that the whole text covers best.

    A null or empty text covers nothing (item null, coverage 0); so does any text when the benchmark is
    empty. Repeated rows give repeated rows; input columns of those names are replaced. No row is moved:
    blocks of the benchmark, of bounded size, go to the tasks that read the documents, some in each pass.
    """
    names = ("item_id", "coverage", "tiles", "contaminated")
    out = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in names])
    kept = out.columns
    out = out.withColumn("__best", F.lit(None).cast(_BEST))
    held = []
    for block in benchmark_blocks(benchmark, k, block_tokens):
        if len(held) == PASS_BLOCKS:
            out = written_table(out)
            while held:
                held.pop().destroy()
        held.append(docs.sparkSession.sparkContext.broadcast(block))
        matched = _matcher(held[-1])
        now, before = F.col("__now"), F.col("__best")
        out = out.withColumn("__now", matched(F.col("text")))
        better = before.isNull() | (now["coverage"] > before["coverage"])
        out = out.withColumn("__best", F.when(better, now).otherwise(before)).drop("__now")
    share = F.coalesce(F.col("__best.coverage"), F.lit(0.0))
    return out.select(*[F.col(f"`{c}`") for c in kept], F.col("__best.item_id").alias("item_id"), share.alias("coverage"), F.coalesce(F.col("__best.tiles"), F.lit(0)).alias("tiles"), (share >= coverage).alias("contaminated"))


def contaminated_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return contamination(docs.select("doc_id", "text"), benchmark)
