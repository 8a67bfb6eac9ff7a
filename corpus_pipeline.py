"""A training corpus in five stages, each an operator of ``corpusmill.llm`` over what the stage before kept.

Every stage takes ``(spark, docs, sf_dir)`` and returns the documents that go on, with the columns of
``docs``; the last adds the shard and the slot of each document. Nulls in any column are allowed; an empty
table goes through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.llm import jaccard, mixing, sharding, tiling, toxicity
from corpusmill.session import written_table

SHARDS = 8
#: Names of the two columns that tell rows apart.
KEY = ("__row_a", "__row_b")

#: The stages draw on a learned lexicon and on a random permutation, which SQL cannot express.
ORACLE_SQL = None


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity lexicon does not reject; the model is fitted outside the held-out fold."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    judged = toxicity.score(docs.select(F.struct(*columns).alias("doc"), "text"), model)
    return judged.where("predicted = 0").select("doc.*")


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: the one with the least id (a null id comes last), then the least row key.

    The row key is a hash of all columns, so rows of one id with different texts have fates of their own,
    and of rows that are equal throughout one stays. A row without words is in no group and stays, as
    often as it occurs.
    """
    simple = [F.col(f"`{f.name}`") for f in docs.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    keyed = docs.select("*", *[F.xxhash64(F.lit(seed), *simple).alias(name) for seed, name in enumerate(KEY)])
    rows = written_table(jaccard.with_components(keyed.select("doc_id", "text", *KEY)).where("component is not null"))
    first = rows.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", *KEY)).alias("first"), F.count("*").alias("members")).where("members > 1")
    first = written_table(first)  # so that a group of very many rows can be split in the join
    stays = F.col(KEY[0]).eqNullSafe(F.col(f"first.{KEY[0]}")) & F.col(KEY[1]).eqNullSafe(F.col(f"first.{KEY[1]}"))
    grouped = written_table(rows.join(first, "component").select(*KEY, stays.alias("stays")))
    gone = written_table(grouped.where("not stays").select(*KEY).distinct())
    again = written_table(grouped.where("stays").groupBy(*KEY).count().where("count > 1").select(*KEY))
    few = [F.broadcast(t) if t.count() * 64 <= jaccard.BROADCAST_BYTES else t for t in (gone, again)]
    left = keyed.join(few[0], list(KEY), "left_anti")
    if not again.isEmpty():
        left = left.join(few[1], list(KEY), "left_anti").unionByName(left.join(few[1], list(KEY), "left_semi").dropDuplicates(list(KEY)))
    return left.select(*[F.col(f"`{c}`") for c in docs.columns])


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose tiles cover less than the threshold of every benchmark item."""
    columns = [F.col(f"`{c}`") for c in docs.columns]
    judged = tiling.contamination(docs.select(F.struct(*columns).alias("doc"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return judged.where("not contaminated").select("doc.*")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample at probabilities that meet the target weights of sources, languages and length classes."""
    return mixing.mix(docs).where("kept = 1").select(*docs.columns)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, shuffled uniformly into shards of sizes at most one apart."""
    return sharding.shard(docs, SHARDS)


STAGES = [
    ("toxicity", without_toxic),
    ("near copies", without_near_copies),
    ("benchmark", without_benchmark),
    ("mixing", mixed),
    ("sharding", sharded),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over the documents of a folder; what a stage keeps is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written_table(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
