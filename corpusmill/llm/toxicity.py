"""Toxicity scores from a weighted lexicon matched by Aho-Corasick over folded text.

Folding undoes case, accents, look-alike letters and digits in place of letters, and turns everything but
letters into single spaces. Lexicon entries start at a word start; of the entries that start at one
word the longest counts, so a longer phrase of weight 0 is an exception. The weights of all matches,
divided by the text's length in words, go through a logistic curve. Lexicon, exceptions and curve are
learned from labelled documents outside the held-out fold: words, word starts and short phrases that toxic
documents share are counted in all of them and the strong ones become entries; then, in a count of what
surrounds their hits, the words and short phrases that are exceptions.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.batches import bounded_sample
from corpusmill.llm.columns import remainder

#: Labelled documents that are fitted on at most (chosen by a hash of the id).
TRAIN_DOCS = 10_000
#: Score from which a document counts as toxic.
THRESHOLD = 0.3
#: Letters of a word start that may become an entry, and of a whole word.
STARTS = (4, 5, 6, 7, 8)
LEAST_DOCS, LEAST_WEIGHT, MARGIN = 5, 1.8, 0.7
#: Words of a phrase, entry or exception, at most.
PHRASE_WORDS = 3
#: A word counts at most so often in one document while learning, so that one junk text decides nothing.
MOST_IN_DOC = 3
#: Added to the length in words: a single hit in a very short text is weighed down a little.
EXTRA_WORDS = 6.0

# Letters of other scripts that look like Latin ones, and digits and signs used for letters.
HOMOGLYPHS = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "һ": "h", "ո": "n", "ԛ": "q", "ԝ": "w", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "γ": "y", "η": "n", "ı": "i", "ɡ": "g", "ⅼ": "l",
}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s"}
#: Characters without width, dropped: soft hyphen, zero-width space, joiners, word joiner, byte order mark.
INVISIBLE = "­​‌‍⁠﻿"


def _folding() -> dict[int, str | None]:
    table: dict[int, str | None] = {}
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00), *range(0xFF21, 0xFF5B)]:
        base = "".join(c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c))
        if base and base != chr(code):
            table[code] = base.lower()
    table |= {ord(k): v for k, v in (HOMOGLYPHS | DIGITS).items()}
    table |= {ord(c): None for c in INVISIBLE}
    table |= {code: None for code in range(0x300, 0x370)}
    return table


_TABLE = _folding()
_BETWEEN = re.compile(r"[\W\d_]+")


def fold(text: str | None) -> str:
    """The folded text: words of letters, with one space before, between and behind them."""
    return " " + _BETWEEN.sub(" ", (text or "").lower().translate(_TABLE)).strip() + " "


@dataclass(frozen=True)
class Model:
    """``entries``: folded phrases, with a leading space and (for whole words) a trailing one, and their weights."""

    entries: dict[str, float]
    slope: float = 1.0
    intercept: float = 0.0
    _built: list = field(default_factory=list, compare=False)

    def automaton(self):
        if not self._built and self.entries:
            found = ahocorasick.Automaton()
            for phrase, weight in self.entries.items():
                found.add_word(phrase, (len(phrase), weight))
            found.make_automaton()
            self._built.append(found)
        return self._built[0] if self._built else None

    def __getstate__(self):
        return {"entries": self.entries, "slope": self.slope, "intercept": self.intercept, "_built": []}

    def __setstate__(self, state):
        for key, value in state.items():
            object.__setattr__(self, key, value)


def density(model: Model, text: str | None) -> float:
    """Weights of all matches over the length in words."""
    folded = fold(text)
    machine = model.automaton()
    if machine is None:
        return 0.0
    longest: dict[int, tuple[int, float]] = {}
    for end, (size, weight) in machine.iter(folded):
        start = end - size
        if start not in longest or longest[start][0] < size:
            longest[start] = (size, weight)
    covered, total = -1, 0.0
    for start in sorted(longest):
        size, weight = longest[start]
        if start + 1 < covered:
            continue
        if weight <= 0:
            covered = start + size  # an exception: nothing that starts inside counts
        total += max(0.0, weight)
    return total / (folded.count(" ") - 1 + EXTRA_WORDS)


def _candidates(folded: str) -> Counter:
    """Uses of words, word starts and phrases of up to ``PHRASE_WORDS`` words."""
    words = folded.split()
    found: Counter = Counter()
    for word, n in Counter(words).items():
        n = min(n, MOST_IN_DOC)
        found[f" {word} "] += n
        for k in STARTS:
            if len(word) >= k:
                found[f" {word[:k]}"] += n
    for k in range(2, PHRASE_WORDS + 1):
        for phrase, n in Counter(zip(*(words[i:] for i in range(k)))).items():
            found[f" {' '.join(phrase)} "] = min(n, MOST_IN_DOC)
    return found


def _curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic regression on one feature by Newton steps with a little shrinkage."""
    scale = x.std() or 1.0
    features = np.column_stack([x / scale, np.ones_like(x)])
    w = np.zeros(2)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(features @ w, -30, 30)))
        gradient = features.T @ (p - y) + np.array([1e-2, 0]) * w
        hessian = (features * (p * (1 - p))[:, None]).T @ features + np.diag([1e-2, 1e-6])
        w = w - np.clip(np.linalg.solve(hessian, gradient), -5, 5)
    return float(w[0] / scale), float(w[1])


def _weight(toxic_uses: int, clean_uses: int, toxic_words: int, clean_words: int) -> float:
    return math.log((toxic_uses + 0.5) / (toxic_words + 1)) - math.log((clean_uses + 0.5) / (clean_words + 1))


def learn_entries(rows: list[tuple[str, int, int, int, int]], toxic_words: int, clean_words: int) -> dict[str, float]:
    """Entries from candidate counts: phrase, toxic documents, toxic uses, clean documents, clean uses.

    The strongest by documents times weight come first. One that an entry is the start of, or a word of,
    must outweigh it by ``MARGIN``; one that is the start of a heavier entry is left out.
    """
    weight = {p: _weight(tu, cu, toxic_words, clean_words) for p, td, tu, cd, cu in rows}
    strong = sorted((r for r in rows if r[1] >= LEAST_DOCS and weight[r[0]] >= LEAST_WEIGHT), key=lambda r: (-r[1] * weight[r[0]], len(r[0]), r[0]))
    entries: dict[str, float] = {}
    begun: dict[str, float] = {}  # the heaviest entry that each start begins
    for phrase, *_ in strong:
        starts = [phrase[:k] for k in range(2, len(phrase))]
        inner = [p for word in phrase.split() for p in (f" {word} ", *(f" {word[:k]}" for k in STARTS)) if phrase.count(" ") > 2]
        if weight[phrase] < max((entries[e] for e in (*starts, *inner) if e in entries), default=-math.inf) + MARGIN or weight[phrase] < begun.get(phrase, -math.inf):
            continue
        entries[phrase] = weight[phrase]
        for start in starts:
            begun[start] = max(begun.get(start, -math.inf), weight[phrase])
    return entries


def _surroundings(folded: str, entries: dict[str, float]) -> Counter:
    """Uses of the runs of up to ``PHRASE_WORDS`` words that hold a word at which an entry starts."""
    words = folded.split()
    spans = set()
    for i, word in enumerate(words):
        if f" {word} " in entries or any(len(word) >= k and f" {word[:k]}" in entries for k in STARTS):
            for first in range(max(0, i - PHRASE_WORDS + 1), i + 1):
                spans.update((first, last) for last in range(i + 1, min(len(words), first + PHRASE_WORDS) + 1))
    uses = Counter(f" {' '.join(words[first:last])} " for first, last in spans)
    return Counter({p: min(n, MOST_IN_DOC) for p, n in uses.items()})


def learn_exceptions(rows: list[tuple[str, int, int, int, int]], entries: dict[str, float], toxic_words: int, clean_words: int) -> dict[str, float]:
    """Exceptions (weight 0) from counts of whole words and phrases around the entries, in rows as ``learn_entries`` takes.

    An exception is in enough clean documents and no sign of a toxic one, however few toxic documents hold
    it. Shorter ones come first; a phrase that they already clear is not needed.
    """
    clean = [r[0] for r in rows if r[0] not in entries and r[3] >= LEAST_DOCS and _weight(r[2], r[4], toxic_words, clean_words) <= 0]
    found: dict[str, float] = {}
    for n in range(1, PHRASE_WORDS + 1):
        known = Model(entries | found)
        found |= {p: 0.0 for p in sorted(clean) if p.count(" ") == n + 1 and density(known, p) > 0}
    return found


def fit(docs: DataFrame, labels: DataFrame, most: int = TRAIN_DOCS) -> Model:
    """Fit on labelled documents outside the held-out fold; phrases are counted in Spark.

    A document with several labels counts as toxic if any says so; null labels and ids are left out.
    """
    marks = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    marks = bounded_sample(marks.where(remainder(F.col("doc_id"), 4) != 2), "doc_id", most, "toxicity")
    known = docs.select("doc_id", "text").join(marks, "doc_id").select("toxic", "text")

    def counts(rows: DataFrame, phrases: Callable[[str], Counter]) -> DataFrame:
        def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for toxic, part in batch.groupby("toxic"):
                    uses: Counter = Counter()
                    inside: Counter = Counter()
                    for text in part["text"]:
                        found = phrases(fold(text))
                        uses.update(found)
                        inside.update(found.keys())
                    if uses:
                        yield pd.DataFrame({"phrase": list(uses), "toxic": int(toxic), "docs": [inside[p] for p in uses], "uses": list(uses.values())})

        counted = rows.mapInPandas(count, "phrase string, toxic int, docs bigint, uses bigint")
        sums = {f"{s}{v}": F.sum(F.when(F.col("toxic") == t, F.col(c)).otherwise(0)).alias(f"{s}{v}") for s, t in (("t", 1), ("c", 0)) for v, c in (("d", "docs"), ("u", "uses"))}
        return counted.groupBy("phrase").agg(*[sums[k] for k in ("td", "tu", "cd", "cu")])

    # what an entry may be is decided by the toxic documents alone; the clean ones are counted for that only
    shared = {r["phrase"] for r in counts(known.where("toxic = 1"), _candidates).where(F.col("td") >= LEAST_DOCS).select("phrase").collect()}

    def candidates(folded: str) -> Counter:
        found = Counter({p: n for p, n in _candidates(folded).items() if p in shared})
        found[""] = folded.count(" ") - 1
        return found

    rows = [tuple(r) for r in counts(known, candidates).collect()]
    whole = next((r for r in rows if r[0] == ""), ("", 0, 0, 0, 0))
    entries = learn_entries([r for r in rows if r[0]], whole[2], whole[4])
    if entries:
        found = dict(entries)
        around = counts(known, lambda folded: _surroundings(folded, found)).where(F.col("cd") >= LEAST_DOCS)
        entries |= learn_exceptions([tuple(r) for r in around.collect()], found, whole[2], whole[4])
    raw = Model(entries)

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"toxic": batch["toxic"].astype("int32"), "x": [density(raw, t) for t in batch["text"]]})

    points = known.mapInPandas(measure, "toxic int, x double").toPandas()
    if points["toxic"].nunique() < 2:
        return Model(entries, 1.0, -3.0)
    return Model(entries, *_curve(points["x"].to_numpy(), points["toxic"].to_numpy()))


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted``; columns of these names are replaced.

    Null and empty texts have no match and get the score of density 0, which is the least.
    """
    kept = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in ("score", "predicted")])
    machine = model

    @F.pandas_udf("double")
    def measured(texts: pd.Series) -> pd.Series:
        return pd.Series([density(machine, t) for t in texts], dtype="float64")

    value = 1 / (1 + F.exp(-(F.lit(model.slope) * measured(F.col("text")) + F.lit(model.intercept))))
    return kept.withColumn("score", value).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def toxic_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Fit outside the held-out fold, then score every document."""
    slim = docs.select("doc_id", "text")
    out = score(slim, fit(slim, labels))
    return out.select("doc_id", (remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "score", "predicted")
