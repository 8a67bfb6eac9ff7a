"""Chat ingestion as a stream; on the same input it stores what the batch plan stores."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpusmill.api import Corpus
from corpusmill.operators.sync import message_links, parsed_messages
from corpusmill.sources.fetching import Journal

RAW = "id string, text string, timestamp string, senderName string"


def raw_stream(spark: SparkSession, folder: str, files_per_trigger: int = 1000) -> DataFrame:
    """Landed JSON pages of a chat as a file stream."""
    return spark.readStream.schema(RAW).option("maxFilesPerTrigger", files_per_trigger).json(folder)


def link_stream(raw: DataFrame, first_day=None) -> DataFrame:
    """New links of a message stream, each message and URL once.

    The state keeps every (message, URL) key: a watermark would bound it, but drop late messages, which
    the batch plan keeps.
    """
    messages = parsed_messages(raw)
    messages = messages if first_day is None else messages.where(F.to_date("ts") >= F.lit(first_day))
    return message_links(messages).dropDuplicates(["message_id", "url"])


def start(links: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Append new links to a Parquet table; a replayed batch replaces its own folder, so it is stored once."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")

    return links.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def start_sync(raw: DataFrame, corpus: Corpus, fetch: Callable, checkpoint: str, react: Callable[[str], bool] | None = None, journal: Journal | None = None, name: str = "chat") -> StreamingQuery:
    """Bring a stream of raw chat items into a corpus, batch by batch until there is no more.

    Each batch is one commit that holds its number, so one that is replayed after a failure changes nothing.
    """

    def merge(batch: DataFrame, number: int) -> None:
        corpus.sync_chat(batch, fetch, react, journal, stream=name, batch=number)

    return raw.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
