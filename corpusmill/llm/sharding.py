"""Uniform shuffle into shards of exact sizes through a hypergeometric communication matrix.

In a uniformly random permutation of all rows, the number of rows that each input partition sends to
each shard follows a multivariate hypergeometric law. So the counts can be drawn first, from the
partition sizes alone; then every partition permutes its own rows and deals them out by its row of the
matrix; after the exchange each shard permutes what it received. No global sort takes place and every
shard has exactly its size.
"""

from __future__ import annotations

import json
import math
import random

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from corpusmill.session import cut_lineage

#: The matrix is broadcast up to so many bytes (8 for each partition and shard), else it is shuffled.
BROADCAST_BYTES = 64 << 20
#: Rows that one block of a shard holds at most on average; a block is sorted by one task.
BLOCK_ROWS = 500_000
#: Least number of blocks of a shard.
LEAST_BLOCKS = 32


def hypergeometric(rng: random.Random, good: int, bad: int, draws: int) -> int:
    """How many of ``draws`` balls drawn without replacement are good: inversion outwards from the mode."""
    low, high = max(0, draws - bad), min(draws, good)
    if low == high:
        return low
    mode = min(high, max(low, (draws + 1) * (good + 1) // (good + bad + 2)))

    def log_choose(n: int, k: int) -> float:
        return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)

    at_mode = math.exp(log_choose(good, mode) + log_choose(bad, draws - mode) - log_choose(good + bad, draws))
    left = rng.random() - at_mode
    up, down, p_up, p_down = mode, mode, at_mode, at_mode
    while left > 0 and (up < high or down > low):
        if up < high:
            p_up *= (good - up) * (draws - up) / ((up + 1) * (bad - draws + up + 1))
            up += 1
            left -= p_up
            if left <= 0:
                return up
        if down > low:
            p_down *= down * (bad - draws + down) / ((good - down + 1) * (draws - down + 1))
            down -= 1
            left -= p_down
            if left <= 0:
                return down
        if p_up + p_down < 1e-300:
            break
    return mode


def communication_matrix(partition_rows: list[int], n_shards: int, seed: int) -> list[list[int]]:
    """Rows that each partition sends to each shard, for a uniform shuffle with shard sizes at most one apart.

    Works on partition sizes alone: one draw for each partition and shard, none for a row.
    """
    total = sum(partition_rows)
    open_seats = [total // n_shards + (s < total % n_shards) for s in range(n_shards)]
    rng = random.Random(seed)
    matrix = []
    for rows in partition_rows:
        seats_left, rows_left, sent = sum(open_seats), rows, []
        for s in range(n_shards):
            take = hypergeometric(rng, open_seats[s], seats_left - open_seats[s], rows_left)
            seats_left -= open_seats[s]
            open_seats[s] -= take
            rows_left -= take
            sent.append(take)
        matrix.append(sent)
    return matrix


def shard(df: DataFrame, n_shards: int = 8, seed: int = 17) -> DataFrame:
    """All rows of ``df`` with ``shard`` (0 to ``n_shards`` - 1) and ``slot`` (gapless from 0 in each shard).

    Shard sizes are at most one row apart, and all permutations are equally likely up to the quality of
    the row hash. The input is checkpointed once, so the partitions that the matrix was drawn for are
    those that are dealt out, also after an executor is lost.

    Nulls hash like any value; repeated rows and ties are separate rows and keep separate slots (which of
    two equal rows gets which slot is open); empty input gives an empty result; input columns named
    ``shard`` or ``slot`` are replaced, all others are kept.
    """
    spark = df.sparkSession
    kept = [c for c in df.columns if c not in ("shard", "slot")]
    # simple types only reach the hash; maps cannot be hashed
    hashed = [F.col(f"`{f.name}`") for f in df.schema.fields if f.name in kept and not isinstance(f.dataType, (T.MapType, T.VariantType))]
    row = F.struct(*[F.col(f"`{c}`") for c in kept])
    base = cut_lineage(df.select(row.alias("row"), F.xxhash64(F.lit(seed), *hashed).alias("key")))
    sizes = dict(base.groupBy(F.spark_partition_id().alias("part")).count().collect())
    matrix = communication_matrix([sizes.get(p, 0) for p in range(max(sizes, default=-1) + 1)], n_shards, seed)
    ends = []
    for p, sent in enumerate(matrix):
        if sum(sent):
            ends.append({"part": p, "ends": [sum(sent[: s + 1]) for s in range(n_shards)]})
    dealt = spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(ends)), "array<struct<part:bigint,ends:array<bigint>>>")).alias("m")).select("m.*")
    if len(ends) * n_shards * 8 <= BROADCAST_BYTES:
        dealt = F.broadcast(dealt)

    number = F.monotonically_increasing_id()
    local = base.sortWithinPartitions("key").withColumn("number", number)
    local = local.withColumn("part", F.shiftright("number", 33)).withColumn("place", F.col("number").bitwiseAND(F.lit((1 << 33) - 1)))
    blocks = max(LEAST_BLOCKS, sum(sizes.values()) // (n_shards * BLOCK_ROWS))
    sent = (
        local.join(dealt, "part")
        .withColumn("shard", F.size(F.filter("ends", lambda e: e <= F.col("place"))).cast("int"))
        .withColumn("second", F.xxhash64(F.lit(seed + 1), "key", "number"))
        .withColumn("block", F.pmod(F.col("second"), F.lit(blocks)))
    )
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sent.groupBy("shard", "block").agg(F.count("*").alias("n")).withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    within = Window.partitionBy("shard", "block").orderBy("second", "number")
    placed = sent.select("row", "shard", "block", "second", "number").withColumn("rank", F.row_number().over(within))
    return placed.join(starts, ["shard", "block"]).select("row.*", "shard", (F.col("start") + F.col("rank") - 1).cast("long").alias("slot"))


def sharded_documents(docs: DataFrame, n_shards: int = 8, seed: int = 17) -> DataFrame:
    """Digest of a sharding of documents: ``doc_id, size, text_crc32, law, shard, slot, grown_shard``.

    A null text counts as no bytes: size 1 and the checksum of the empty string. The text itself is not
    moved: its size and checksum are taken where it is read.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).cast("long").alias("text_crc32"))
    out = shard(slim, n_shards, seed)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
