"""Fetch cache and budget: which URLs are answered from the cache, fetched, or skipped; the fetching itself is injected."""

from __future__ import annotations

import json
import os
import shutil
import uuid
from collections.abc import Callable, Iterator
from datetime import UTC, datetime

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.operators.sync import running_total

RESULT = "key string, url string, final_url string, status string, body string, content_type string, error string, fetched_at string"


def cache_key(url):
    return F.sha2(url, 256)


def parsed_cache(files: DataFrame) -> DataFrame:
    """Cache entries from JSON texts (``value``); a text that is no object or lacks URL or status is a miss."""
    fields = "struct<url:string,final_url:string,fetched_at:string,status:string,body:string,content_type:string,error:string>"
    rows = files.select(F.from_json("value", fields).alias("c")).select("c.*")
    return rows.where(F.col("url").isNotNull() & F.col("status").isin("ok", "failed")).select(cache_key(F.col("url")).alias("key"), "*")


def fetch_decisions(requests: DataFrame, cache: DataFrame, cap: int) -> DataFrame:
    """``position, url, decision``: cached, fetch or skipped, the budget spent by position among cache misses.

    A URL that is asked for twice costs once: the second time it is in the cache.
    """
    keyed = requests.withColumn("key", cache_key(F.col("url")))
    first = keyed.groupBy("key").agg(F.min("position").alias("first"))
    hits = cache.select("key").distinct().withColumn("hit", F.lit(True))
    rows = keyed.join(first, "key").join(hits, "key", "left")
    rows = rows.withColumn("miss", (F.col("hit").isNull() & (F.col("position") == F.col("first"))).cast("int"))
    spent = running_total(rows, "position", "miss")
    own = F.when(F.col("hit").isNotNull(), "cached").when(F.col("spent") >= cap, "skipped").otherwise("fetch")
    decided = spent.withColumn("own", own)
    lead = decided.where("position = first").select("key", F.col("own").alias("lead"))
    joined = decided.join(lead, "key")
    return joined.select("position", "url", F.when(F.col("position") == F.col("first"), F.col("own")).when(F.col("lead") == "fetch", "cached").otherwise(F.col("lead")).alias("decision"))


def forgotten(cache: DataFrame, urls: DataFrame) -> DataFrame:
    """The cache without the failures of some URLs; successes stay."""
    keys = urls.select(cache_key(F.col("url")).alias("key"), F.lit(True).alias("__hit")).distinct()
    return cache.join(keys, "key", "left").where(F.col("__hit").isNull() | (F.col("status") != "failed")).drop("__hit")


class Journal:
    """What a running job has paid for, on a folder that all executors mount: claims, and results by content address.

    A claim is written before a URL is fetched and its result after, each in a file that appears as a
    whole. When a task is lost and run again it finds both: a result is taken from here, and a claim without
    a result is not paid for again but counts as interrupted.
    """

    def __init__(self, folder: str) -> None:
        self.folder = folder.removeprefix("file:")

    def _file(self, key: str, kind: str) -> str:
        return f"{self.folder}/{key[:2]}/{key}.{kind}"

    def claim(self, key: str) -> bool:
        """True for the first one that asks."""
        os.makedirs(f"{self.folder}/{key[:2]}", exist_ok=True)
        try:
            os.close(os.open(self._file(key, "claim"), os.O_CREAT | os.O_EXCL))
        except FileExistsError:
            return False
        return True

    def result(self, key: str) -> dict | None:
        """The stored result; a file that is no JSON object counts as none."""
        try:
            with open(self._file(key, "json")) as file:
                found = json.load(file)
        except (FileNotFoundError, ValueError):
            return None
        return found if isinstance(found, dict) else None

    def store(self, key: str, result: dict) -> None:
        part = self._file(key, uuid.uuid4().hex)
        os.makedirs(os.path.dirname(part), exist_ok=True)
        with open(part, "w") as file:
            json.dump(result, file)
        os.replace(part, self._file(key, "json"))

    def clear(self) -> None:
        """Forget everything: after the results are in the cache table."""
        shutil.rmtree(self.folder, ignore_errors=True)


def fetched(wanted: DataFrame, fetch: Callable[[str], tuple[str | None, str, str | None, str | None, str | None]], journal: Journal | None = None) -> DataFrame:
    """Results (``RESULT``) of distinct URLs. ``fetch`` returns final URL, status, body, content type and error; what it raises is a failure of that URL.

    With a journal no URL is paid for twice, also if its task fails afterwards and is run again.
    """
    names = [f.split(":")[0] for f in RESULT.replace(" ", ":").split(",:")]

    def result(key: str, url: str) -> dict:
        if journal is not None and (known := journal.result(key)) is not None:
            return known
        if journal is not None and not journal.claim(key):
            values = (None, "failed", None, None, "interrupted")
        else:
            try:
                values = fetch(url)
            except Exception as failure:
                values = (None, "failed", None, None, str(failure))
        now = datetime.now(UTC).strftime("%Y-%m-%d %H:%M:%S")
        done = dict(zip(names, (key, url, *values, now), strict=True))
        if journal is not None:
            journal.store(key, done)
        return done

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([result(k, u) for k, u in zip(batch["key"], batch["url"], strict=True)], columns=names)

    return wanted.select(cache_key(F.col("url")).alias("key"), "url").mapInPandas(run, RESULT)
