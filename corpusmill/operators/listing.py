"""Listings: flags, keyset and offset pages, set records, the review queue, typed sorting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusmill.schema import live, searchable

MOST_ROWS = 200


def flagged(docs: DataFrame, chunks: DataFrame, memberships: DataFrame, sets: DataFrame) -> DataFrame:
    """Documents with ``embedded``, ``enriched`` and ``set_names`` (sorted): the correlated lookups as joins of sums."""
    has_vector = chunks.where(F.col("embedding").isNotNull()).select("document_id").distinct().withColumn("embedded", F.lit(True))
    names = memberships.join(F.broadcast(sets.select(F.col("id").alias("set_id"), "name")), "set_id").groupBy("document_id").agg(F.sort_array(F.collect_list("name")).alias("set_names"))
    joined = docs.join(has_vector.withColumnRenamed("document_id", "id"), "id", "left").join(names.withColumnRenamed("document_id", "id"), "id", "left")
    return joined.withColumns({"embedded": F.coalesce("embedded", F.lit(False)), "enriched": F.col("enriched_hash").isNotNull(), "set_names": F.coalesce("set_names", F.array().cast("array<string>"))})


def cursor_of(created_at: Column, id_: Column) -> Column:
    """URL-safe base 64 of timestamp and id."""
    return F.translate(F.base64(F.concat_ws("|", F.date_format(created_at, "yyyy-MM-dd HH:mm:ss"), id_.cast("string")).cast("binary")), "+/", "-_")


def read_cursor(cursor: str) -> tuple[str, int]:
    import base64

    at, _, number = base64.urlsafe_b64decode(cursor.encode()).decode().partition("|")
    return at, int(number)


def keyset_page(docs: DataFrame, limit: int = 50, after: tuple[str, int] | None = None) -> DataFrame:
    """Live documents, newest first, with ``next_cursor`` on the last row if there is another page.

    Takes one row more than the page, and no count; a top-k plan, not a full sort.
    """
    if not 1 <= limit <= MOST_ROWS:
        raise ValueError(f"limit must be from 1 to {MOST_ROWS}")
    rows = docs.where(live())
    if after is not None:
        rows = rows.where(F.struct(F.col("created_at").alias("a"), F.col("id").alias("b")) < F.struct(F.lit(after[0]).cast(docs.schema["created_at"].dataType).alias("a"), F.lit(after[1]).cast("long").alias("b")))
    newest = [F.col("created_at").desc(), F.col("id").desc()]
    page = rows.orderBy(*newest).limit(limit + 1)
    number = F.row_number().over(Window.orderBy(*newest))  # over the page only
    numbered = page.withColumn("__n", number).withColumn("__more", F.count("*").over(Window.partitionBy(F.lit(1))) > limit)
    marked = numbered.withColumn("next_cursor", F.when((F.col("__n") == limit) & F.col("__more"), cursor_of(F.col("created_at"), F.col("id"))))
    return marked.where(F.col("__n") <= limit).drop("__n", "__more").orderBy(*newest)


def set_records(docs: DataFrame, memberships: DataFrame, set_id: int, status: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    """Records of one set, by document id from the highest, by offset."""
    rows = memberships.where(F.col("set_id") == set_id)
    rows = rows.where(F.col("status") == status) if status is not None else rows
    about = docs.where(searchable()).select(F.col("id").alias("document_id"), "title", "url")
    return rows.drop("error").join(about, "document_id").orderBy(F.col("document_id").desc()).offset(offset).limit(limit)


def review_queue(docs: DataFrame, memberships: DataFrame, sets: DataFrame, limit: int = 50) -> DataFrame:
    """Records that need a person: partial or failed, newest document first."""
    open_rows = memberships.where(F.col("status").isin("partial", "failed"))
    named = open_rows.join(F.broadcast(sets.select(F.col("id").alias("set_id"), F.col("name").alias("set_name"))), "set_id")
    about = docs.where(searchable()).select(F.col("id").alias("document_id"), "title", "url")
    out = named.join(about, "document_id").select("document_id", "title", "url", "set_name", "status", F.coalesce("missing_fields", F.array().cast("array<string>")).alias("missing_fields"), "error")
    return out.orderBy(F.col("document_id").desc(), "set_name").limit(limit)


def typed_sort(rows: DataFrame, column: str, ascending: bool = True) -> DataFrame:
    """By a typed column: nulls last going up, first going down; ties by document."""
    key = F.col(f"`{column}`")
    return rows.orderBy(key.asc_nulls_last() if ascending else key.desc_nulls_first(), "document_id")
