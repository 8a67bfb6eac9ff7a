"""What filters do to each other, counted by truth-table survival words.

With n filters (five at most) there are 2^n sets of filters. A document becomes one 32-bit word whose bit s
says whether the document survives the filters of set s, all applied. Words are counted by bit position with
carry-save adders, so a task holds a few words for each part, and every figure of every order of the filters
follows from the survivors of sets: what a filter removes at a step is the difference of two of them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.session import written_table

FILTERS = "ABCDE"
#: Bits of the sets that lack filter i: the truth table of "filter i is not applied".
WITHOUT = (0x55555555, 0x33333333, 0x0F0F0F0F, 0x00FF00FF, 0x0000FFFF)
EVERY_SET = 0xFFFFFFFF
#: Parts that a task counts before it hands them on (counts of one part are summed up afterwards).
HELD_PARTS = 20_000


def text_failures(text: Column) -> list[Column]:
    """Failure of filters A to D by a text alone: few words, few different words, capitals, marks."""
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return [
        F.size(words) < 200,
        F.size(F.array_distinct(words)) * 100 < F.size(words) * 50,
        capitals * 100 > F.length(text) * 2,
        text.rlike(r"[#$%&*|]"),
    ]


def survival_word(failures: list[Column]) -> Column:
    """The sets of filters that a document survives, as the bits of a long below 2^32."""
    word = F.lit(EVERY_SET).cast("long")
    for failed, without in zip(failures, WITHOUT, strict=False):
        word = word.bitwiseAND(F.when(failed, F.lit(without).cast("long")).otherwise(F.lit(EVERY_SET).cast("long")))
    return word


def add_words(planes: list[np.ndarray], words: np.ndarray) -> list[np.ndarray]:
    """Add words to vertical counters: plane w has, at each bit, the digit of weight 2^w of that bit's count.

    Words of one weight are added three at a time by a full adder on all 32 positions at once; sums stay at
    the weight and carries go one up, until one word is left of each weight.
    """
    out: list[np.ndarray] = []
    rest, level = words.astype(np.uint32), 0
    while len(rest) or level < len(planes):
        rest = np.concatenate([rest, planes[level]]) if level < len(planes) else rest
        carries = []
        while len(rest) > 1:
            third = max(1, len(rest) // 3)
            a, b = rest[:third], rest[third : 2 * third]
            c = rest[2 * third : 3 * third] if len(rest) > 2 else np.zeros(third, dtype=np.uint32)
            half = a ^ b
            carries.append((a & b) | (half & c))
            rest = np.concatenate([half ^ c, rest[3 * third :]])
        out.append(rest)
        rest = np.concatenate(carries) if carries else np.empty(0, dtype=np.uint32)
        level += 1
    return out


def position_counts(planes: list[np.ndarray]) -> np.ndarray:
    """The count of each of the 32 positions."""
    bits = np.arange(32, dtype=np.uint32)
    total = np.zeros(32, dtype=np.int64)
    for weight, plane in enumerate(planes):
        for word in plane:
            total += ((word >> bits) & np.uint32(1)).astype(np.int64) << weight
    return total


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held: dict[tuple, list[np.ndarray]] = {}

    def handed_on() -> pd.DataFrame:
        keys = list(held)
        out = pd.DataFrame({"part": [k[0] for k in keys], "good": [k[1] for k in keys], "toxic": [k[2] for k in keys], "survivors": [position_counts(held[k]) for k in keys]})
        held.clear()
        return out

    for batch in batches:
        for key, rows in batch.groupby(["part", "good", "toxic"], sort=False)["word"]:
            held[key] = add_words(held.get(key, []), rows.to_numpy())
        if len(held) > HELD_PARTS:
            yield handed_on()
    if held:
        yield handed_on()


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, good, toxic, word`` for each document, its copies decided over the whole table.

    A document is a copy if another row with the same text (SHA-256) has a smaller id; a null id is no
    smaller one, and has none smaller. Of labels that repeat for an id, one that says 1 counts.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), F.sha2(text.cast("binary"), 256).alias("digest"), *[f.alias(f"fails_{n}") for n, f in zip("ABCD", text_failures(text), strict=True)])
    rows = written_table(rows)  # texts are read once; digests and flags are a small part of them
    first = written_table(rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("rows")).where("rows > 1").drop("rows"))
    marks = labels.where("doc_id is not null").groupBy("doc_id").agg(F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    both = rows.join(first, "digest", "left").join(marks, "doc_id", "left")
    failures = [F.col(f"fails_{n}") for n in "ABCD"] + [F.coalesce(F.col("first") < F.col("doc_id"), F.lit(False))]
    return both.select("part", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"), survival_word(failures).alias("word"))


def survivors(words: DataFrame) -> DataFrame:
    """``part`` with three arrays of 32 counts, the survivors of each set of filters: ``every, good, toxic`` documents."""
    counted = words.mapInPandas(_counted, "part string, good boolean, toxic boolean, survivors array<bigint>")

    def sums(where: Column) -> Column:
        return F.array(*[F.coalesce(F.sum(F.when(where, F.col("survivors")[s])), F.lit(0)) for s in range(32)])

    return counted.groupBy("part").agg(sums(F.lit(True)).alias("every"), sums(F.col("good")).alias("good"), sums(F.col("toxic")).alias("toxic"))


def _shapley(every: Column, bit: int, n: int) -> Column:
    """What a filter removes, summed over all orders: each set before it occurs in |set|! (n-1-|set|)! of them."""
    terms = [F.lit(math.factorial(s.bit_count()) * math.factorial(n - 1 - s.bit_count())) * (every[s] - every[s | bit]) for s in range(1 << n) if not s & bit]
    return sum(terms[1:], terms[0])


def interactions(counts: DataFrame, filters: str = FILTERS) -> DataFrame:
    """One row for each part, order of the filters and step, from the survivors of sets."""
    n = len(filters)
    full = (1 << n) - 1
    steps = [(order, step) for order in permutations(range(n)) for step in range(n)]
    before = [sum(1 << f for f in order[:step]) for order, step in steps]
    own = [1 << order[step] for order, step in steps]
    listed = F.arrays_zip(
        F.lit(["".join(filters[f] for f in order) for order, _ in steps]).alias("filter_order"),
        F.lit([step + 1 for _, step in steps]).alias("step"),
        F.lit(before).alias("before"),
        F.lit(own).alias("own"),
        F.lit([order[step] for order, step in steps]).alias("place"),
    )
    each = counts.withColumn("shapleys", F.array(*[_shapley(F.col("every"), 1 << f, n) for f in range(n)])).withColumn("at", F.explode(listed))
    start, own_bit = F.col("at.before"), F.col("at.own")
    after = start.bitwiseOR(own_bit)
    removed = F.col("every")[start] - F.col("every")[after]
    return each.select(
        "part",
        F.col("at.filter_order").alias("filter_order"),
        F.col("at.step").alias("step"),
        F.col("every")[after].alias("kept"),
        removed.alias("removed"),
        (F.col("every")[0] - F.col("every")[own_bit] - removed).alias("redundant"),
        (F.col("every")[F.lit(full).bitwiseXOR(own_bit)] - F.col("every")[full]).alias("unique_fails"),
        (F.col("good")[start] - F.col("good")[after]).alias("good_lost"),
        (F.col("toxic")[start] - F.col("toxic")[after]).alias("toxic_lost"),
        F.col("shapleys")[F.col("at.place")].alias("shapley"),
    )


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The interaction of filters A to E over whole texts: one row for each part, order and step.

    A part is a source; rows without one, and rows whose source is empty, make up the part ''. A null text
    is an empty one: it fails A, and E if an earlier row has no text either. A text without words does not
    fail B, one without characters not C. Repeated rows count as often as they occur; neither of two rows
    with one id and text is a copy of the other. A document without a label is neither good nor toxic. No
    documents give no rows. Other columns are not read.
    """
    return interactions(survivors(judged(docs, labels)))


def oracle() -> str:
    masks = ", ".join(f"({1 << i}, '{f}')" for i, f in enumerate(FILTERS))
    return rf"""
    WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
    w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY t) AS first FROM d),
    l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
    f AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
        (CASE WHEN len(words) < 200 THEN 1 ELSE 0 END) | (CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 2 ELSE 0 END)
        | (CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) THEN 4 ELSE 0 END)
        | (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END) | (CASE WHEN first < doc_id THEN 16 ELSE 0 END) AS fails
        FROM w LEFT JOIN l USING (doc_id)),
    g AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY ALL),
    m(bit, letter) AS (VALUES {masks}),
    o AS (SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
        FROM m a, m b, m c, m d, m e WHERE a.bit | b.bit | c.bit | d.bit | e.bit = 31),
    s AS (SELECT filter_order, CAST(i AS INTEGER) AS step, bits[i] AS own, CAST(coalesce(list_sum(bits[1:i - 1]), 0) AS INTEGER) AS gone FROM o, range(1, 6) r(i)),
    x AS (SELECT part, filter_order, step, own,
        coalesce(sum(n) FILTER (WHERE fails & (gone | own) = 0), 0) AS kept,
        coalesce(sum(n) FILTER (WHERE fails & gone = 0 AND fails & own > 0), 0) AS removed,
        coalesce(sum(n) FILTER (WHERE fails & gone > 0 AND fails & own > 0), 0) AS redundant,
        coalesce(sum(n) FILTER (WHERE fails = own), 0) AS unique_fails,
        coalesce(sum(good) FILTER (WHERE fails & gone = 0 AND fails & own > 0), 0) AS good_lost,
        coalesce(sum(toxic) FILTER (WHERE fails & gone = 0 AND fails & own > 0), 0) AS toxic_lost
        FROM g, s GROUP BY ALL)
    SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
        CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
        CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
    FROM x"""
