"""From fetched bodies to documents: web pages, oEmbed answers and tweets become title, author, content and extra fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.html import extracted_html
from corpusmill.functions.records import outer_json

EXTRACTED = ("title", "author", "content", "extra", "error")
_NO_EXTRA = "map<string,string>"


def _string(value: Column, path: str) -> Column:
    """A string at a path of a parsed payload; any other kind of value is null."""
    found = F.try_variant_get(value, path, "variant")
    return F.when(F.schema_of_variant(found) == "STRING", F.try_variant_get(value, path, "string"))


def _is_object(value: Column, path: str = "$") -> Column:
    return F.coalesce(F.schema_of_variant(F.try_variant_get(value, path, "variant")).startswith("OBJECT"), F.lit(False))


def shredded(results: DataFrame) -> DataFrame:
    """``results`` (``kind, status, body, error``) with ``title, author, content, extra, error`` in place of ``body`` and ``error``.

    ``kind`` is an adapter. An oEmbed answer that is no JSON object, and an answer about a tweet without its
    text or its author's name, are errors; a field of another type than string is null. A fetch that failed
    without a reason has "fetch failed". Payloads are parsed once, as variants; only web pages go to Python.
    """
    kind, body = F.col("kind"), F.col("body")
    video, tweet = kind.isin("tiktok", "youtube"), kind == "x"
    rows = results.withColumn("__json", F.when(tweet, outer_json(body)).when(video, body))
    rows = rows.withColumn("__value", F.try_parse_json("__json")).withColumn("__page", extracted_html(F.when(~video & ~tweet, body)))
    value = F.col("__value")
    found = F.when(
        (F.col("status") != "ok") | body.isNull() & (video | tweet), F.coalesce(F.col("error"), F.lit("fetch failed"))
    ).when(video & ~_is_object(value), F.lit("malformed oEmbed response")).when(tweet & F.col("__json").isNull(), F.lit("no JSON object in the answer about a tweet"))
    missing = _string(value, "$.tweet.text").isNull() | _string(value, "$.tweet.author.screen_name").isNull()
    error = found.when(tweet & missing, F.lit("malformed answer about a tweet"))
    rows = rows.withColumn("__error", error)
    good = F.col("__error").isNull()
    author_url = _string(value, "$.author_url")
    new = {
        "title": F.when(video, _string(value, "$.title")).when(~tweet, F.col("__page.title")),
        "author": F.when(video, _string(value, "$.author_name")).when(tweet, _string(value, "$.tweet.author.screen_name")),
        "content": F.when(kind == "tiktok", _string(value, "$.title")).when(tweet, _string(value, "$.tweet.text")).when(~video, F.col("__page.content")),
        "extra": F.when((kind == "tiktok") & author_url.isNotNull(), F.create_map(F.lit("author_url"), author_url)).otherwise(F.create_map().cast(_NO_EXTRA)),
    }
    kept = [c for c in results.columns if c not in ("body", *EXTRACTED)]
    return rows.select(*kept, *[F.when(good, v).alias(c) for c, v in new.items()], F.col("__error").alias("error"))
