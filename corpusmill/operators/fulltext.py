"""Full-text index and BM25 ranking as DataFrames.

Two tables make the index: postings (term, document, frequency), and document lengths. Statistics count
every document, also those that a search must not return, so visibility is applied after ranking.
"""

from __future__ import annotations

import math
import re

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.text import INDEX_TERM, QUERY_TERM, fold_text, folded, index_terms
from corpusmill.operators.ranking import numbered
from corpusmill.session import written_table

# Ranking parameters, and the weight of a term that most documents have.
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
COLUMNS = ("title", "content", "summary", "keywords")

#: Terms of a snippet.
SNIPPET_TERMS = 12

_token = regex.compile(INDEX_TERM.removesuffix("+") + r"[\p{L}\p{N}\p{Co}\p{Mn}]*")
_QUERY_TERM = re.compile(r"\w+")
_PART = re.compile(r"[^\W_]+")


def query_phrases(query: str) -> list[list[str]]:
    """Phrases of a query in order: a term with underscores is a phrase of its parts. Repeated terms stay."""
    return [parts for term in _QUERY_TERM.findall(query) if (parts := [fold_text(p) for p in _PART.findall(term)])]


def postings(docs: DataFrame, columns: tuple[str, ...] = COLUMNS, positions: bool = False) -> DataFrame:
    """``id, term, tf`` (or ``id, term, field, position``) over the folded columns of all documents.

    Terms never cross columns. Counting is by document and term, so a frequent term is no hot key.
    """
    fields = F.array(*[index_terms(folded(F.col(c))) for c in columns])
    rows = docs.select("id", F.posexplode(fields).alias("field", "terms")).select("id", "field", F.posexplode("terms").alias("position", "term"))
    if positions:
        return rows.select("id", "term", "field", "position")
    return rows.groupBy("id", "term").agg(F.count("*").alias("tf"))


def lengths(docs: DataFrame, columns: tuple[str, ...] = COLUMNS) -> DataFrame:
    """``id, len``: number of terms of every document; 0 for one without any."""
    return docs.select("id", sum((F.size(index_terms(folded(F.col(c)))) for c in columns), F.lit(0)).cast("long").alias("len"))


def term_statistics(posted: DataFrame) -> DataFrame:
    """``term, df, cf``: documents and occurrences of every term."""
    return posted.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def _phrase_counts(docs: DataFrame, phrases: list[list[str]]) -> DataFrame:
    """``id, len, tfs``: number of terms of every document, and of places where it has each phrase. Texts are read once."""
    fields = F.array(*[index_terms(folded(F.col(c))) for c in COLUMNS])

    def count(terms: Column, parts: list[str]) -> Column:
        if len(parts) == 1:
            return F.size(F.filter(terms, lambda t: t == parts[0]))
        places = F.sequence(F.lit(1), F.greatest(F.size(terms) - (len(parts) - 1), F.lit(1)))

        def here(i: Column) -> Column:
            same = F.lit(True)
            for k, part in enumerate(parts):
                same = same & F.coalesce(F.try_element_at(terms, i + k) == part, F.lit(False))
            return same

        return F.size(F.filter(places, here))

    rows = docs.select("id", fields.alias("fields"))
    length = F.aggregate("fields", F.lit(0).cast("long"), lambda s, t: s + F.coalesce(F.greatest(F.size(t), F.lit(0)), F.lit(0)))

    def uses(parts: list[str]) -> Column:
        return F.aggregate("fields", F.lit(0).cast("long"), lambda s, t: s + F.coalesce(count(t, parts), F.lit(0)))

    tfs = [uses(p) for p in phrases]
    return rows.select("id", length.alias("len"), F.array(*tfs).alias("tfs"))


def bm25(docs: DataFrame, query: str) -> DataFrame:
    """``id, score, matched``: documents with any phrase of the query, scored over all ``docs``.

    A repeated term is a phrase of its own and counts again. The result is empty for a query without terms.
    What a document has of the query, a few numbers, is written once; statistics and scores come from that.
    """
    phrases = query_phrases(query)
    if not phrases:
        return docs.select("id", F.lit(0.0).alias("score"), F.lit(0).alias("matched")).limit(0)
    counted = written_table(_phrase_counts(docs, phrases))
    totals = counted.agg(F.count("*").alias("n"), F.avg("len").alias("average"), *[F.count_if(F.col("tfs")[i] > 0).alias(f"df{i}") for i in range(len(phrases))]).first()
    gains = []
    for i in range(len(phrases)):
        raw = math.log((totals["n"] - totals[f"df{i}"] + 0.5) / (totals[f"df{i}"] + 0.5))
        tf = F.col("tfs")[i]
        gains.append(F.lit(raw if raw > 0 else LEAST_IDF) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("len") / F.lit(totals["average"] or 1.0))))
    hits = counted.where(F.exists("tfs", lambda t: t > 0))
    return hits.select("id", sum(gains, F.lit(0.0)).alias("score"), F.size(F.filter("tfs", lambda t: t > 0)).alias("matched"))


def best_matches(found: DataFrame, visible: DataFrame, whole: int) -> DataFrame:
    """``id, score`` of hits (``id, score, matched``) on visible documents with all phrases; if there is none, those with any.

    Which of both applies is part of the plan: the largest number of matched phrases decides.
    """
    seen = found.join(visible.select("id"), "id", "left_semi")
    kept = seen.crossJoin(F.broadcast(seen.agg(F.max("matched").alias("most"))))  # one row
    return kept.where((F.col("matched") == whole) | (F.coalesce(F.col("most"), F.lit(0)) < whole)).select("id", "score")


def search(docs: DataFrame, query: str, visible: Column) -> DataFrame:
    """``id, score`` as :func:`best_matches`, from the texts themselves; ``text_index`` has the same from a stored index."""
    return best_matches(bm25(docs, query), docs.where(visible), len(query_phrases(query)))


def ranked(found: DataFrame, score: str = "score", rank: str = "rank") -> DataFrame:
    """Hits with their 1-based rank; ties by id."""
    return numbered(found, F.col(score), "id", rank)


def best_window(texts: list[str | None], phrases: list[list[str]], most: int = SNIPPET_TERMS) -> str:
    """The window of ``most`` terms with the most different phrases, then the most places of phrases; the first of equal ones.

    Windows lie within one text; texts go in order. Cut ends are marked with an ellipsis.
    """
    best, shown = (-1, -1), ""
    for text in texts:
        found = list(_token.finditer(text or ""))
        terms = [fold_text(m.group()) for m in found]
        hits = [[i for i in range(len(terms) - len(p) + 1) if terms[i : i + len(p)] == p] for p in phrases]
        # a window that is the first of equal ones starts the text or ends with a place it needs
        ends = {i + len(p) for p, places in zip(phrases, hits, strict=True) for i in places}
        for start in sorted({0} | {max(0, e - most) for e in ends}):
            inside = [sum(start <= i and i + len(p) <= start + most for i in places) for p, places in zip(phrases, hits, strict=True)]
            rank = (len({tuple(p) for p, n in zip(phrases, inside, strict=True) if n}), sum(inside))
            if rank > best and found:
                last = min(start + most, len(found)) - 1
                best = rank
                shown = ("…" if start else "") + text[found[start].start() : found[last].end()] + ("…" if last + 1 < len(found) else "")
    return shown


def window_snippet(query: str):
    """:func:`best_window` of a query over an array of texts, for the few rows of a result."""
    phrases = [list(p) for p in dict.fromkeys(map(tuple, query_phrases(query)))]

    @F.pandas_udf("string")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: best_window(list(t), phrases))

    return cut


def query_terms(query: Column) -> Column:
    return F.regexp_extract_all(query, F.lit(QUERY_TERM), F.lit(0))
