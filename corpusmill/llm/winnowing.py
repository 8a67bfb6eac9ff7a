"""Winnowing fingerprints of whole texts, in SQL functions only.

A text is cut into pieces (words; a word of over ``PIECE`` characters gives several), every run of ``k``
pieces gets a polynomial hash, and from every window of ``w`` such hashes the least is kept, of equal
ones the rightmost, with its position. So any run of ``k + w - 1`` pieces that two texts share, aligned
at piece starts, leaves a common hash in both fingerprints, and no match under ``k`` pieces does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusmill.llm.columns import let

#: Longest piece in characters.
PIECE = 12
#: Hashes are taken modulo this prime, so that products stay below 2**63.
PRIME = (1 << 31) - 1
BASE = 1_000_003
#: Quantile cells of document ids, and rows of a bucket; buckets = cells times parts of a cell.
CELLS, MOST_PARTS, BUCKET_ROWS = 64, 1024, 1000
_LAST = (1 << 31) - 1


def _doubled(values: Column, step: int, combine) -> Column:
    return F.zip_with(values, F.slice(values, step + 1, F.size(values)), combine)


def selected(text: Column, k: int = 4, w: int = 8) -> Column:
    """Array of the selected (hash, position) pairs of a text, packed as hash * 2**32 + (2**31 - 1 - position).

    ``k`` and ``w`` are powers of two. A text of under ``k`` pieces has one hash over all of them, a text
    without pieces (null, empty, white space) none.
    """
    pieces = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(rf"[^\x20\x09-\x0D]{{1,{PIECE}}}"), F.lit(0))
    hashes = F.transform(pieces, lambda p: F.pmod(F.xxhash64(p), F.lit(PRIME)))

    def grams(h: Column, width: int) -> Column:
        if width == k:
            return h
        power = pow(BASE, width, PRIME)
        joined = _doubled(h, width, lambda a, b: (a * F.lit(power) + F.coalesce(b, F.lit(0))) % F.lit(PRIME))
        return let(joined, lambda g: grams(g, 2 * width))

    def least(m: Column, width: int) -> Column:
        if width == w:
            return m
        return let(_doubled(m, width, lambda a, b: F.least(a, b)), lambda n: least(n, 2 * width))

    def head(values: Column, dropped: int) -> Column:
        return F.slice(values, 1, F.greatest(F.size(values) - dropped, F.least(F.size(values), F.lit(1))))

    def windows(g: Column) -> Column:
        packed = F.transform(g, lambda x, i: x * F.lit(1 << 32) + (F.lit(_LAST) - i))
        return F.array_distinct(let(packed, lambda p: let(least(p, 1), lambda m: head(m, w - 1))))

    return let(hashes, lambda h: let(let(grams(h, 1), lambda g: head(g, k - 1)), windows))


def written(marks: Column) -> Column:
    """A fingerprint as text: hash (hex) and position of each selected gram, in order of position."""
    return F.array_join(F.transform(marks, lambda e: F.concat(F.lower(F.hex(F.shiftright(e, 32))), F.lit("@"), (F.lit(_LAST) - e % F.lit(1 << 32)).cast("string"))), ",")


def likeness(one: Column, other: Column) -> Column:
    """Jaccard similarity of the hashes of two fingerprints; two empty fingerprints are alike (1.0)."""

    def of(marks: Column) -> Column:
        return F.array_distinct(F.transform(marks, lambda e: F.shiftright(e, 32)))

    def ratio(a: Column, b: Column) -> Column:
        return let(F.size(F.array_intersect(a, b)), lambda n: F.when(F.size(a) + F.size(b) == 0, F.lit(1.0)).otherwise(n / (F.size(a) + F.size(b) - n)))

    return let(of(one), lambda a: let(of(other), lambda b: ratio(a, b)))


def _tree(value: Column, bounds: list[int], low: int, high: int) -> Column:
    """Index of the last bound at or below ``value``, by halving: a balanced tree of conditions."""
    if low == high:
        return F.lit(low)
    mid = (low + high + 1) // 2
    return F.when(value >= bounds[mid], _tree(value, bounds, mid, high)).otherwise(_tree(value, bounds, low, mid - 1))


def with_next(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``text`` and ``next_text``: the text of the next document in descending ``doc_id``, after the last that of the first.

    Ids are cut into buckets at their quantiles (and evenly between two quantiles), so the texts are
    shuffled once and no task holds more than a bucket. Each bucket also gets the first row of the
    bucket that follows it; those rows, one for each of at most 64 * 1024 buckets, are broadcast by id.
    A null id comes last; rows of equal id are ordered by the hash of their text.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    ids = rows.select("doc_id")
    marks = [i / CELLS for i in range(CELLS)]
    found = ids.agg(F.count("*").alias("n"), F.max("doc_id").alias("top"), F.percentile_approx("doc_id", marks, 1000).alias("bounds")).first()
    bounds = sorted(set(found["bounds"] or [0]))
    parts = max(1, min(MOST_PARTS, found["n"] // (BUCKET_ROWS * len(bounds))))
    highs = [*bounds[1:], (found["top"] or 0) + 1]
    cell = _tree(F.col("doc_id"), bounds, 0, len(bounds) - 1)
    low = F.element_at(F.array(*[F.lit(b) for b in bounds]), F.col("cell") + 1)
    wide = F.element_at(F.array(*[F.lit(max(1, -(-(h - b) // parts))) for b, h in zip(bounds, highs)]), F.col("cell") + 1)
    part = F.least(F.lit(parts - 1), F.greatest(F.lit(0), F.floor((F.col("doc_id") - low) / wide)))
    # a null id sorts last: below every bucket
    placed = rows.withColumn("cell", cell).withColumn("bucket", F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(F.col("cell") * parts + part).cast("long")).drop("cell")

    down = Window.orderBy(F.col("bucket").desc())
    heads = placed.groupBy("bucket").agg(F.max("doc_id").alias("head"), F.max_by(F.xxhash64("text"), F.struct(F.col("doc_id"), -F.xxhash64("text").cast("decimal(20,0)"))).alias("mark"))
    spans = heads.select("bucket", F.struct(F.lead("head").over(down).alias("head"), F.lead("mark").over(down).alias("mark"), F.lead("bucket").over(down).alias("of")).alias("after"), F.first(F.struct("head", "mark", F.col("bucket").alias("of"))).over(down).alias("top"))
    follow = spans.select(F.when(F.col("after.of").isNull(), F.col("top")).otherwise(F.col("after")).alias("to"), F.col("bucket").alias("into")).select("to.head", "to.mark", "to.of", "into")
    ghosts = (
        placed.join(F.broadcast(follow), (F.col("bucket") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("head")) & (F.xxhash64("text") == F.col("mark")))
        .dropDuplicates(["into"])
        .select("doc_id", "text", F.col("into").alias("bucket"), F.lit(1).alias("ghost"))
    )
    every = placed.withColumn("ghost", F.lit(0)).unionByName(ghosts)
    order = Window.partitionBy("bucket").orderBy("ghost", F.col("doc_id").desc_nulls_last(), F.xxhash64("text"))
    return every.withColumn("next_text", F.lead("text").over(order)).where("ghost = 0").select("doc_id", "text", "next_text")


def fingerprints(docs: DataFrame, k: int = 4, w: int = 8) -> DataFrame:
    """Fingerprint of every whole text and of its edited text, and how alike they are.

    The edited text replaces the last half (rounded down, in code points) by as many code points from the
    start of the next document, or all that it has. A null text is empty; other columns are ignored;
    repeated rows give repeated rows; an empty table gives an empty result.
    """
    n = F.char_length("text")
    rows = with_next(docs).withColumn("n_chars", n.cast("long")).withColumn("half", F.floor(n / 2).cast("int"))
    rows = rows.withColumn("edited", F.expr("concat(substring(text, 1, cast(n_chars as int) - half), substring(next_text, 1, half))"))
    rows = rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), F.struct(selected(F.col("text"), k, w).alias("own"), selected(F.col("edited"), k, w).alias("edited"), selected(F.col("next_text"), k, w).alias("next")).alias("marks"))
    own, edited, following = F.col("marks.own"), F.col("marks.edited"), F.col("marks.next")
    return rows.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        written(own).alias("fingerprint"),
        written(edited).alias("edited_fingerprint"),
        likeness(own, edited).alias("near_edited"),
        likeness(own, following).alias("near_next"),
    )
