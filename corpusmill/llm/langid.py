"""Language identification with a bit-sliced Bloom filter over character n-grams.

One filter serves all languages, however many: each slot holds a bitmask with one bit for each language,
in as many words as that takes, so a lookup ANDs the masks of an n-gram's slots and returns every language
that contains it at once. The number of slots follows the number of n-grams. A text's
languages are counted by bit over all its n-grams, counts are corrected for the filter's false-positive
rate of each language, and the largest corrected count decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.batches import blocks
from corpusmill.llm.columns import remainder
from corpusmill.session import written_table

#: Documents of each language that the classifier is fitted on at most (chosen by a hash of the id).
LANG_DOCS = 5_000
ORDER = 3
#: An n-gram belongs to a language if its rate there is at least this share of its highest rate.
SHARE = 0.35
#: Least uses of an n-gram in a language; less in a language of under 10,000 times as many n-grams.
LEAST_COUNT = 3
#: Slots for each n-gram, rounded up to a power of two, and slots that an n-gram sets.
SLOTS_A_GRAM, PROBES = 8, 3
UNDETERMINED = "und"

_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=np.uint64)
_letters: np.ndarray | None = None


def _is_letter() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)
    return _letters


def _codes(piece: str) -> np.ndarray:
    return np.frombuffer(piece.encode("utf-32-le", "replace"), dtype=np.uint32)


def _grams(pieces: list[tuple[int, str]]) -> tuple[np.ndarray, np.ndarray]:
    """N-gram keys and the row of each, over lower-cased letters with runs of other characters as one space."""
    joined = _codes(" ".join(p.lower() for _, p in pieces) + " ")
    sizes = [len(p.lower()) + 1 for _, p in pieces]
    owner = np.repeat(np.array([r for r, _ in pieces], dtype=np.int64), sizes)
    letter = _is_letter()[joined]
    kept = letter.copy()
    kept[1:] |= letter[:-1]
    codes, owner, letter = np.where(letter, joined, 32)[kept].astype(np.uint64), owner[kept], letter[kept]
    if len(codes) < ORDER:
        return np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)
    n = len(codes) - ORDER + 1
    key = np.zeros(n, dtype=np.uint64)
    for i in range(ORDER):
        key = key * np.uint64(0x100000001B3) + codes[i : i + n]
    same = (owner[:n] == owner[ORDER - 1 :]) & (letter[:n] | letter[1 : n + 1])
    return key[same], owner[:n][same]


def _slots(keys: np.ndarray, size: int) -> list[np.ndarray]:
    return [((keys ^ (keys >> np.uint64(29))) * m >> np.uint64(24)).astype(np.int64) % size for m in _MIX[:PROBES]]


@dataclass(frozen=True)
class Model:
    """``masks``: a row of words for each slot; ``false_positive``: how often each language is found for an n-gram of none."""

    langs: list[str]
    masks: np.ndarray
    false_positive: np.ndarray


def build(langs: list[str], keys: np.ndarray, of: np.ndarray) -> Model:
    """The filter: every n-gram (``keys``) sets the bit of its language (``of``, a place in ``langs``) in each of its slots."""
    size = 1 << max(10, int(np.ceil(np.log2(max(1, SLOTS_A_GRAM * len(np.unique(keys)))))))
    table = np.zeros((size, -(-len(langs) // 64) or 1), dtype=np.uint64)
    for slot in _slots(keys, size):
        np.bitwise_or.at(table, (slot, of // 64), np.uint64(1) << (of % 64).astype(np.uint64))
    fill = np.array([np.count_nonzero(table[:, i // 64] >> np.uint64(i % 64) & np.uint64(1)) / size for i in range(len(langs))])
    return Model(langs, table, fill**PROBES)


def contained(model: Model, keys: np.ndarray) -> np.ndarray:
    """The language mask, in words, of each n-gram."""
    found = np.full((len(keys), model.masks.shape[1]), ~np.uint64(0))
    for slot in _slots(keys, len(model.masks)):
        found &= model.masks[slot]
    return found


def fit(docs: DataFrame, most: int = LANG_DOCS) -> Model:
    """Fit on documents outside the held-out fold with text and language; n-grams are counted and chosen in Spark."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (remainder(F.col("doc_id"), 4) != 2)).select("doc_id", "text", "lang")
    sizes = known.groupBy("lang").agg(F.count("*").alias("docs"))
    chance = F.pmod(F.xxhash64("doc_id", F.lit("langid")), F.lit(1_000_000)) / F.lit(1e6)
    sample = known.join(sizes, "lang").where(chance * F.col("docs") < most).select("lang", "text")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lang, rows in batch.groupby("lang"):
                for group in blocks(rows["text"].tolist(), ORDER - 1):
                    keys, n = np.unique(_grams(group)[0], return_counts=True)
                    yield pd.DataFrame({"lang": lang, "gram": keys.view(np.int64), "n": n})

    counts = written_table(sample.mapInPandas(count, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    totals = written_table(counts.groupBy("lang").agg(F.sum("n").alias("total")))
    rated = counts.join(totals, "lang").where(F.col("n") >= F.least(F.lit(LEAST_COUNT), 1 + F.col("total") / 10_000)).select("lang", "gram", (F.col("n") / F.col("total")).alias("rate"))
    top = rated.groupBy("gram").agg(F.max("rate").alias("top"))
    chosen = rated.join(top, "gram").where(F.col("rate") >= SHARE * F.col("top")).select("lang", "gram").toArrow()
    langs = [r["lang"] for r in totals.orderBy(F.col("total").desc(), "lang").collect()]
    place = {lang: i for i, lang in enumerate(langs)}
    return build(langs, chosen["gram"].to_numpy().view(np.uint64), np.array([place[x] for x in chosen["lang"].to_pylist()], dtype=np.int64))


def decide(model: Model, texts: list[str | None]) -> tuple[list[str], list[float]]:
    """Language and score of each text; the score is the winner's part of all corrected counts."""
    n = len(texts)
    hits, total = np.zeros((n, len(model.langs))), np.zeros(n)
    bodies = ["" if t is None else t for t in texts]
    for group in blocks(bodies, ORDER - 1):
        keys, owner = _grams(group)
        if not len(keys):
            continue
        found = contained(model, keys)
        total += np.bincount(owner, minlength=n)
        for i in range(len(model.langs)):
            hits[:, i] += np.bincount(owner[(found[:, i // 64] >> np.uint64(i % 64) & np.uint64(1)).astype(bool)], minlength=n)
    lettered = [any(map(str.isalpha, t)) for t in bodies]
    if not model.langs:
        return [UNDETERMINED] * n, [0.0] * n
    fp = model.false_positive
    right = np.clip((hits - total[:, None] * fp) / np.maximum(1e-9, 1 - fp), 0, None)
    whole = right.sum(axis=1)
    best = right.argmax(axis=1)
    score = np.where(whole > 0, right[np.arange(n), best] / np.maximum(whole, 1e-9), 0.0)
    return [model.langs[b] if ok else UNDETERMINED for b, ok in zip(best, lettered)], [float(s) if ok else 0.0 for s, ok in zip(score, lettered)]


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, lang_pred, score`` for every row of ``docs`` (``doc_id``, ``text``); whole texts, in blocks.

    ``und`` with score 0 if the text is null or has no letter; a text with letters but no known n-gram
    gets the most frequent language with score 0. Repeated rows give repeated rows.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            langs, scores = decide(model, [t if isinstance(t, str) else None for t in batch["text"]])
            yield pd.DataFrame({"doc_id": batch["doc_id"], "lang_pred": langs, "score": scores})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id {kind}, lang_pred string, score double")


def identified_documents(docs: DataFrame) -> DataFrame:
    """Fit outside the held-out fold, then predict every document."""
    out = identify(docs, fit(docs))
    return out.select("doc_id", (remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")
