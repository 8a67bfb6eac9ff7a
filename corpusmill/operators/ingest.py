"""Links into documents as one set-based job: decide under a budget, fetch with a cache, extract, and merge.

Notes, chats and retries all come here with their links (``LINK``); the caller commits what it gets back.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.urls import MOST_HOPS, adapter, request_url, without_query
from corpusmill.operators import sync
from corpusmill.session import written_table
from corpusmill.sources.extraction import shredded
from corpusmill.sources.fetching import RESULT, Journal, cache_key, fetched

LINK = ("position", "source", "source_ref", "url", "parent_document_id", "message_text")
OUTCOMES = ("tombstoned", "cached", "skipped", "fetched", "failed")


@dataclass
class Ingested:
    """``outcomes`` has the outcome of every link; ``rows`` what is upserted; ``placeholders`` what is inserted as pending."""

    outcomes: DataFrame
    rows: DataFrame
    placeholders: DataFrame
    cache: DataFrame  # new entries of the fetch cache


def decisions(links: DataFrame, current: DataFrame, cache: DataFrame, cap: int) -> DataFrame:
    """``links`` with ``decision`` and ``new_placeholder``: the budget is spent by position.

    A URL costs one fetch, at its first link that needs it, and none if the cache has its request. The
    budget is looked at before the cache: beyond it a cached URL waits as well.
    """
    gone_or_ok = current.where(F.col("deleted_at").isNotNull() | (F.col("status") == "ok")).select(*sync.KEY)
    keyed = links.withColumn("key", cache_key(request_url(F.col("url"))))
    need = keyed.join(gone_or_ok, sync.KEY, "left_anti").groupBy("key").agg(F.min("position").alias("first"))
    need = need.join(cache.select("key").distinct(), "key", "left_anti")
    costed = keyed.join(need, "key", "left").withColumn("cost", F.coalesce((F.col("position") == F.col("first")).cast("int"), F.lit(0)))
    decided = sync.url_decisions(costed.drop("key", "first").withColumnRenamed("cost", "__cost"), current, cap, F.col("__cost"))
    return decided.drop("__cost")


def fetched_through(wanted: DataFrame, cache: DataFrame, fetch: Callable, journal: Journal | None, hops: int = MOST_HOPS) -> tuple[DataFrame, DataFrame]:
    """Extracted documents by ``url``, and the new cache entries.

    Short links are followed round by round, every round one join with the cache and one pass of fetching
    for all of them; after ``hops`` rounds a link that is still short is an error.
    """
    at = wanted.select("url").distinct().select("url", F.col("url").alias("at"), F.lit(0).alias("hops"))
    known, new, done = cache, [], []
    for n in range(hops + 2):
        at = at.withColumn("kind", adapter(F.col("at")))
        late = (F.col("kind") == "shortener") & (F.col("hops") >= hops)
        hostless = F.col("kind") == "error"
        stuck = at.where(late | hostless).select("url", "kind", F.lit("failed").alias("status"), F.lit(None).cast("string").alias("body"), F.when(hostless, "URL has no host").otherwise(f"redirect loop: exceeded {hops} shortener hops").alias("error"), F.lit(None).cast("string").alias("fetched_at"))
        asked = at.where(~late & ~hostless).withColumn("request", request_url(F.col("at"))).withColumn("key", cache_key(F.col("request")))
        misses = asked.select("key", F.col("request").alias("url")).distinct().join(known.select("key"), "key", "left_anti")
        new.append(written_table(fetched(misses.select("url"), fetch, journal)))
        known = known.unionByName(new[-1], allowMissingColumns=True)
        got = written_table(asked.join(known.select("key", "final_url", "status", "body", "error", "fetched_at").dropDuplicates(["key"]), "key"))
        onward = F.col("kind").isin("shortener", "vm_tiktok") & (F.col("status") == "ok") & F.col("final_url").isNotNull()
        done += [stuck, got.where(~onward).select("url", "kind", "status", "body", "error", "fetched_at")]
        at = got.where(onward).select("url", F.when(F.col("kind") == "vm_tiktok", without_query(F.col("final_url"))).otherwise(F.col("final_url")).alias("at"), (F.col("hops") + 1).alias("hops"))
        if at.isEmpty():
            break
    every = done[0]
    for part in done[1:]:
        every = every.unionByName(part)
    entries = new[0]
    for part in new[1:]:
        entries = entries.unionByName(part)
    return shredded(every), entries


def ingested(links: DataFrame, current: DataFrame, cache: DataFrame, cap: int, fetch: Callable, journal: Journal | None = None) -> Ingested:
    """Bring links (``LINK``) into documents; ``current`` is the snapshot they meet, ``cache`` has ``RESULT``'s columns.

    A deleted document stays deleted and one that is ok is left alone. Both sides of a failure are kept: the
    document has the error, and the cache the failure, until a retry forgets it.
    """
    decided = written_table(decisions(links.select(*LINK), current, cache, cap))
    wanted = decided.where("decision = 'fetch'")
    pages, entries = fetched_through(wanted, cache, fetch, journal)
    pages = written_table(pages)
    status = F.when(F.col("error").isNull(), "ok").otherwise("failed")
    rows = written_table(wanted.join(pages.drop("kind", "status"), "url").select(*LINK[1:], "title", "author", "content", "extra", status.alias("status"), "error"))
    settled = rows.select(*sync.KEY, F.when(F.col("status") == "ok", "fetched").otherwise("failed").alias("settled"))
    outcomes = decided.join(settled, sync.KEY, "left").select(*LINK, F.coalesce("settled", "decision").alias("outcome"))
    waiting = decided.where("new_placeholder").select(*LINK[1:], F.lit("pending").alias("status"))
    return Ingested(outcomes, rows, waiting, entries)


def merged(current: DataFrame, done: Ingested, at: Column) -> DataFrame:
    """The snapshot with what was ingested; rows that are new have no id yet."""
    after = sync.upserted(current, done.rows, at)
    return after.unionByName(done.placeholders.withColumns({"created_at": at, "updated_at": at}), allowMissingColumns=True)


def empty_cache(current: DataFrame) -> DataFrame:
    return current.sparkSession.createDataFrame([], RESULT)
