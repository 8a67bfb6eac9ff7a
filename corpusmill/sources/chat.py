"""A chat's messages as a Spark data source: pages from the newest back, as a table or as a stream.

After ``register``, ``spark.read.format("chat")`` reads every chat in a task of its own, page by page by cursor, and ends a walk
at the first message before the bound of a filter on ``ts``; that filter reaches the source through Spark's
pushdown (``spark.sql.python.filterPushdown.enabled``). ``spark.readStream.format("chat")`` keeps the place
of the newest message of each chat as its offset and walks back to it.
"""

from __future__ import annotations

import json
import logging
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import UTC, date, datetime
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition

SCHEMA = "chat string, message_id string, text string, ts timestamp, sender string"
#: Pages of one walk at most; a walk that ends there says so.
MOST_PAGES = 500

_log = logging.getLogger(__name__)


@dataclass(frozen=True)
class Page:
    items: list[dict]
    more: bool
    cursor: str | None


class Client(Protocol):
    """What a chat service offers: pages of a chat, newest first, each from a cursor on."""

    def page(self, chat: str, cursor: str | None) -> Page: ...


def register(spark: SparkSession, client: Callable[[], Client], name: str = "chat") -> None:
    """Make the chats of a service readable as format ``name``; ``client`` is called in the tasks."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")

    class Source(ChatSource):
        make = staticmethod(client)

        @classmethod
        def name(cls) -> str:
            return name

    spark.dataSource.register(Source)


def parsed(item: dict) -> tuple[str, str, datetime, str | None] | None:
    """Id, text, time and sender; None for an item without text, without a string as id or without a readable time."""
    text, key, at = item.get("text"), item.get("id"), item.get("timestamp")
    if not text or not isinstance(text, str) or not isinstance(key, str) or not isinstance(at, str):
        return None
    try:
        time = datetime.fromisoformat(at)
    except ValueError:
        return None
    sender = item.get("senderName")
    return key, text, (time if time.tzinfo else time.replace(tzinfo=UTC)).astimezone(UTC), sender if isinstance(sender, str) else None


def walk(client: Client, chat: str, most_pages: int) -> Iterator[tuple[str, str, datetime, str | None]]:
    """Messages of a chat from the newest back; pages are asked for one by one, as far as the reader goes on."""
    cursor = None
    for _ in range(most_pages):
        page = client.page(chat, cursor)
        yield from filter(None, map(parsed, page.items))
        if not page.more:
            return
        if page.cursor is None:
            _log.warning("chat %s: more pages are announced without a cursor; the walk ends here", chat)
            return
        cursor = page.cursor
    _log.warning("chat %s: the walk ends at %d pages and may be incomplete", chat, most_pages)


@dataclass
class Chat(InputPartition):
    name: str
    after: tuple[str, str] | None = None
    until: tuple[str, str] | None = None


class _Walks:
    """What both readers share. Options: ``chats`` (a JSON list), ``since`` (a day), ``pages`` (at most, of a walk)."""

    def __init__(self, make: Callable[[], Client], options: dict) -> None:
        self.make, self.chats, self.pages = make, json.loads(options["chats"]), int(options.get("pages", MOST_PAGES))
        self.since = datetime.combine(date.fromisoformat(options["since"]), datetime.min.time(), UTC) if options.get("since") else None

    def messages(self, chat: str) -> Iterator[tuple[str, str, datetime, str | None]]:
        for message in walk(self.make(), chat, self.pages):
            if self.since is not None and message[2] < self.since:
                return
            yield message


def _place(message: tuple) -> tuple[str, str]:
    return message[2].isoformat(timespec="microseconds"), message[0]


class ChatReader(_Walks, DataSourceReader):
    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Lower bounds on ``ts`` end the walk, a choice of ``chat`` leaves the others out; Spark still looks at every row."""
        for f in filters:
            name = ".".join(getattr(f, "attribute", ()))
            if name == "ts" and isinstance(f, GreaterThan | GreaterThanOrEqual) and isinstance(f.value, datetime):
                bound = f.value if f.value.tzinfo else f.value.astimezone()
                self.since = max(filter(None, (self.since, bound.astimezone(UTC))))
            if name == "chat" and isinstance(f, EqualTo | In):
                named = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.chats = [c for c in self.chats if c in named]
            yield f

    def partitions(self) -> list[InputPartition]:
        return [Chat(c) for c in self.chats]

    def read(self, partition: Chat | None) -> Iterator[tuple]:
        if partition is not None:
            for message in self.messages(partition.name):
                yield partition.name, *message


class ChatStream(_Walks, DataSourceStreamReader):
    """Offsets map each chat to time and id of its newest message that was read; messages come newest first."""

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        newest = ((c, next(self.messages(c), None)) for c in self.chats)
        return {c: list(_place(m)) for c, m in newest if m is not None}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [Chat(c, tuple(start[c]) if c in start else None, tuple(end[c])) for c in end if start.get(c) != end[c]]

    def read(self, partition: Chat) -> Iterator[tuple]:
        for message in self.messages(partition.name):
            place = _place(message)
            if partition.after is not None and place <= partition.after:
                return
            if partition.until is None or place <= partition.until:
                yield partition.name, *message

    def commit(self, end: dict) -> None:
        """Nothing is held back for a batch that is done."""


class ChatSource(DataSource):
    """The source of a service; ``register`` makes one that knows its client."""

    make: Callable[[], Client]

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return ChatReader(self.make, dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return ChatStream(self.make, dict(self.options))


def as_items(messages: DataFrame) -> DataFrame:
    """Messages of this source as raw chat items, which ``Corpus.sync_chat`` takes."""
    return messages.select(F.col("message_id").alias("id"), "text", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("timestamp"), F.col("sender").alias("senderName"))
