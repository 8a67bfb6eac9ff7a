"""Ranks over a whole table without meeting in one task, and the ranks of a few rows without ranking the others."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusmill.session import written_table

#: Bits of a number by ``monotonically_increasing_id`` that count within a partition.
WITHIN = 33


def sortable(score: Column) -> Column:
    """A score that comes last, in descending order, where it is null, NaN or infinitely low."""
    return F.when(score.isNull() | F.isnan(score), F.lit(float("-inf"))).otherwise(score)


def numbered(rows: DataFrame, score: Column, id_: str, name: str) -> DataFrame:
    """``rows`` with the 1-based rank by ``score``, highest first, ties by id; undefined scores come last.

    Rows are dealt out by ranges of score and id together, so equal scores spread over tasks as well, and
    written in order with their number within the range. A rank is that number and the sizes of the ranges
    before; only these sizes, one for each task, meet in one place.
    """
    ranges = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("__score").desc(), F.col(id_).asc()]
    dealt = rows.withColumn("__score", sortable(score)).repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    placed = written_table(dealt.withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", WITHIN).alias("__part")
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy(part).count().select("__part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__start"))
    within = F.col("__at").bitwiseAND(F.lit((1 << WITHIN) - 1))
    ranked = placed.withColumn("__part", part).join(F.broadcast(starts), "__part")  # a row for each task of the sort
    return ranked.withColumn(name, (F.col("__start") + within + 1).cast("int")).select(*[F.col(f"`{c}`") for c in rows.columns], name)


def head(rows: DataFrame, score: str, id_: str, n: int) -> list[tuple[float, int]]:
    """Score and id of the first ``n`` rows in the order of :func:`numbered`."""
    top = rows.select(sortable(F.col(score)).alias("s"), F.col(id_).alias("i")).orderBy(F.desc("s"), "i").limit(n)
    return [(r["s"], r["i"]) for r in top.collect()]


def places(rows: DataFrame, score: str, id_: str, keys: list[tuple[float, int]]) -> dict[int, int]:
    """The rank of some rows, given by score and id, among all ``rows``; nothing is sorted or dealt out.

    Each row finds by halving how many of the keys come before it, and rows are counted by that number.
    """
    if not keys:
        return {}
    ordered = sorted({(-s, i) for s, i in keys})
    size = 1 << len(ordered).bit_length()
    bounds = F.arrays_zip(F.lit([s for s, _ in ordered]).alias("s"), F.lit([i for _, i in ordered]).alias("i"))
    key = F.struct((-sortable(F.col(score))).alias("s"), F.col(id_).alias("i"))
    steps = F.lit([size >> b for b in range(1, size.bit_length())])
    ahead = F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(bounds, at + step - 1) < key, at + step).otherwise(at))
    counts = {r["ahead"]: r["count"] for r in rows.select(ahead.alias("ahead")).groupBy("ahead").count().collect()}
    ranks, total = {}, 0
    for n, (_, i) in enumerate(ordered):
        total += counts.get(n, 0)  # rows before or at key n; the key itself is the last of them
        ranks[i] = total
    return ranks
