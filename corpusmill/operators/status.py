"""Status of the four stages: counts, heads of the queues, and run reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from corpusmill.schema import live, searchable
from corpusmill.session import written_table

STAGES = ("fetch", "embed", "enrich", "extract")


def stage_counts(docs: DataFrame, memberships: DataFrame) -> DataFrame:
    """``stage, done, waiting, failed``: one row for each stage over the documents that it may take."""

    def row(stage: str, rows: DataFrame, done, waiting, failed) -> DataFrame:
        return rows.agg(F.lit(stage).alias("stage"), F.count_if(done).alias("done"), F.count_if(waiting).alias("waiting"), F.count_if(failed).alias("failed"))

    seen, status, never = docs.where(searchable()), F.col("status"), F.lit(False)
    members = memberships.join(seen.select(F.col("id").alias("document_id")), "document_id", "left_semi")
    fetch = row("fetch", docs.where(live()), status == "ok", status == "pending", status == "failed")
    embed = row("embed", seen, F.col("chunks_hash").isNotNull(), F.col("chunks_hash").isNull(), never)
    enrich = row("enrich", seen, F.col("enriched_hash").isNotNull(), F.col("enriched_hash").isNull(), never)
    extract = row("extract", members, status == "ok", status == "pending", status.isin("partial", "failed"))
    return fetch.unionByName(embed).unionByName(enrich).unionByName(extract)


def fetch_queue(docs: DataFrame, limit: int = 10) -> DataFrame:
    """Head of the fetch queue: failures first, then newest first."""
    rows = docs.where(live() & F.col("status").isin("pending", "failed"))
    failed = F.col("status") == "failed"
    top = rows.orderBy(failed.desc(), F.col("created_at").desc(), F.col("id").desc()).limit(limit)
    return top.select(F.col("id").alias("document_id"), "title", "source", F.when(failed, "failed").otherwise("waiting").alias("state"), F.col("error").alias("detail"))


def hash_queue(docs: DataFrame, hash_column: str, limit: int = 10) -> DataFrame:
    """Head of the embed or enrich queue: documents that the stage never took."""
    rows = docs.where(searchable() & F.col(hash_column).isNull())
    top = rows.orderBy(F.col("created_at").desc(), F.col("id").desc()).limit(limit)
    return top.select(F.col("id").alias("document_id"), "title", "source", F.lit("waiting").alias("state"), F.lit(None).cast("string").alias("detail"))


def extract_queue(docs: DataFrame, memberships: DataFrame, sets: DataFrame, limit: int = 10) -> DataFrame:
    """Head of the extract queue: rows that failed before rows that wait."""
    rows = memberships.where("status <> 'ok'").withColumnRenamed("status", "state_of")
    named = rows.join(F.broadcast(sets.select(F.col("id").alias("set_id"), F.col("name").alias("detail"))), "set_id")
    joined = named.join(docs.where(searchable()).select(F.col("id").alias("document_id"), "title", "source"), "document_id")
    waits = F.col("state_of") == "pending"
    top = joined.orderBy(waits.asc(), F.col("document_id").desc(), "detail").limit(limit)
    return top.select("document_id", "title", "source", F.when(waits, "waiting").otherwise("failed").alias("state"), "detail")


def report(actions: DataFrame, outcome: str = "action") -> DataFrame:
    """``outcome, n``: how many rows a run treated in which way."""
    return actions.groupBy(F.col(outcome).alias("outcome")).agg(F.count("*").alias("n"))


def observed(rows: DataFrame, outcome: str, outcomes: tuple[str, ...]) -> tuple[DataFrame, dict[str, int]]:
    """``rows``, written, and how many have which outcome: counted while they are written, not by reading them again."""
    seen = Observation()
    kept = written_table(rows.observe(seen, *[F.count_if(F.col(outcome) == o).alias(o) for o in outcomes]))
    return kept, {o: n or 0 for o, n in seen.get.items()}
