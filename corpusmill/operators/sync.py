"""Incremental synchronisation as set-based plans: what to insert, update, keep, purge or leave deleted.

Every function compares an incoming snapshot with the current one and returns actions or the new snapshot;
``corpusmill.sources.store`` writes it. No row is read or decided on the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusmill.functions.urls import adapter, commentary, found_urls

KEY = ["source", "source_ref"]
NOTE_ACTIONS = ("insert", "update", "noop", "purge", "respect_tombstone", "stay_deleted")


def note_actions(current: DataFrame, notes: DataFrame, source: str = "obsidian") -> DataFrame:
    """``source_ref, id, action`` for each note and each current note row.

    ``notes`` (``source_ref, content_hash``) is the whole vault, so a live row without a note is purged;
    a deleted row stays deleted, with or without a note. Child rows (URLs of notes) are no notes.
    """
    rows = current.where((F.col("source") == source) & F.col("parent_document_id").isNull()).select("source_ref", "id", F.col("content_hash").alias("old"), F.col("deleted_at").isNotNull().alias("gone"))
    new = notes.select("source_ref", F.col("content_hash").alias("new"), F.lit(True).alias("seen"))
    joined = rows.join(new, "source_ref", "full_outer")
    action = (
        F.when(F.col("id").isNull(), "insert")
        .when(F.col("gone") & F.col("seen").isNotNull(), "respect_tombstone")
        .when(F.col("gone"), "stay_deleted")
        .when(F.col("seen").isNull(), "purge")
        .when(F.col("old").eqNullSafe(F.col("new")), "noop")
        .otherwise("update")
    )
    return joined.select("source_ref", "id", action.alias("action"))


def purged_with_children(current: DataFrame, actions: DataFrame) -> DataFrame:
    """Ids that a purge of notes removes: the notes, and their live children through the self join."""
    notes = actions.where("action = 'purge'").select("id")
    children = current.where(F.col("deleted_at").isNull()).join(notes.select(F.col("id").alias("parent_document_id")), "parent_document_id", "left_semi").select("id")
    return notes.unionByName(children).distinct()


def removed_urls(current: DataFrame, links: DataFrame) -> DataFrame:
    """Ids of live children whose URL their note no longer holds. ``links``: ``parent_document_id, source_ref``; only notes in it are judged."""
    judged = links.select("parent_document_id").distinct()
    children = current.where(F.col("deleted_at").isNull()).join(judged, "parent_document_id", "left_semi")
    return children.join(links.where("source_ref is not null"), ["parent_document_id", "source_ref"], "left_anti").select("id")


def url_decisions(links: DataFrame, current: DataFrame, cap: int, cost: Column | None = None) -> DataFrame:
    """What happens to each link (``position, source, source_ref, url``): tombstoned, cached, fetch or skipped.

    The fetch budget is spent in order of ``position`` by the links that need a fetch; one that starts
    while budget is left is taken whole, even if its hops (``cost``) exceed the rest.
    """
    state = current.select(*KEY, F.col("status").alias("old_status"), F.col("deleted_at").isNotNull().alias("gone"), F.lit(True).alias("known"))
    rows = links.join(state, KEY, "left")
    kind = F.when(F.col("gone"), "tombstoned").when(F.col("old_status") == "ok", "cached").otherwise("fetch")
    rows = rows.withColumn("kind", kind).withColumn("cost", F.when(kind == "fetch", cost if cost is not None else F.lit(1)).otherwise(0))
    spent = running_total(rows, "position", "cost")
    decided = F.when((F.col("kind") == "fetch") & (F.col("spent") >= cap), F.lit("skipped")).otherwise(F.col("kind"))
    return spent.select(*links.columns, decided.alias("decision"), (decided.eqNullSafe(F.lit("skipped")) & F.col("known").isNull()).alias("new_placeholder"))


def running_total(rows: DataFrame, order: str, value: str, width: int = 100_000) -> DataFrame:
    """``spent``: the sum of ``value`` over all rows before a row, in order of an integer column.

    In two levels: sums of ranges of ``width`` positions are added up first, so no task sorts all rows.
    """
    ranged = rows.withColumn("__range", F.floor(F.col(order) / width))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    sums = ranged.groupBy("__range").agg(F.sum(value).alias("s")).select("__range", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("__base"))
    within = Window.partitionBy("__range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return ranged.join(sums, "__range").withColumn("spent", F.col("__base") + F.coalesce(F.sum(value).over(within), F.lit(0))).drop("__range", "__base")


def resolved_status(error: Column, at_cap: Column) -> Column:
    """Terminal status of an extraction: a failure at the cap is only skipped."""
    return F.when(error.isNull(), "ok").when(at_cap, "skipped").otherwise("failed")


def retry_plan(current: DataFrame, cap: int) -> DataFrame:
    """``id, source, source_ref, url, decision``: live pending or failed rows with a URL, by id, until the cap."""
    rows = current.where(F.col("deleted_at").isNull() & F.col("status").isin("pending", "failed") & F.col("url").isNotNull())
    numbered = running_total(rows.select("id", *KEY, "url").withColumn("one", F.lit(1)), "id", "one")
    return numbered.select("id", *KEY, "url", F.when(F.col("spent") < cap, "retry").otherwise("skipped").alias("decision"))


def upserted(current: DataFrame, incoming: DataFrame, at: Column) -> DataFrame:
    """The snapshot after extraction results (``source, source_ref, url, parent_document_id, title, author, content, status, error``).

    By natural key; an update overwrites title, author, content, status and error also with nulls (a
    failed refetch loses old content), and so it does with ``extra`` and ``message_text`` if the results
    have them; it leaves everything else, also a deletion, as it is.
    """
    fresh = ("title", "author", "content", "status", "error", *[c for c in ("extra", "message_text") if c in incoming.columns])
    new = incoming.select(*KEY, *[F.col(c).alias(f"__{c}") for c in ("url", "parent_document_id", *fresh)], F.lit(True).alias("__hit"))
    old = current.withColumn("__old", F.lit(True))
    joined = old.join(new, KEY, "full_outer")
    hit, known = F.col("__hit").isNotNull(), F.col("__old").isNotNull()
    columns = []
    for c in current.columns:
        if c in KEY:
            columns.append(F.col(c))
        elif c in fresh:
            columns.append(F.when(hit, F.col(f"__{c}")).otherwise(F.col(c)).alias(c))
        elif c in ("url", "parent_document_id"):
            columns.append(F.when(known, F.col(c)).otherwise(F.col(f"__{c}")).alias(c))
        elif c in ("updated_at", "fetched_at"):
            columns.append(F.when(hit, at).otherwise(F.col(c)).alias(c))
        elif c == "created_at":
            columns.append(F.when(known, F.col(c)).otherwise(at).alias(c))
        else:
            columns.append(F.col(c))
    return joined.select(*columns)


def placeholders(current: DataFrame, links: DataFrame) -> DataFrame:
    """Links without a row yet, to be inserted as pending."""
    return links.join(current.select(*KEY), KEY, "left_anti").withColumn("status", F.lit("pending"))


def tombstoned(current: DataFrame, ids: DataFrame, at: Column) -> DataFrame:
    """Mark rows deleted (and updated); the rows stay, with everything that belongs to them."""
    marked = current.join(ids.select("id").withColumn("__hit", F.lit(True)), "id", "left")
    now = F.col("__hit").isNotNull() & F.col("deleted_at").isNull()
    return marked.withColumn("updated_at", F.when(now, at).otherwise(F.col("updated_at"))).withColumn("deleted_at", F.when(now, at).otherwise(F.col("deleted_at"))).drop("__hit").select(*current.columns)


def purged(current: DataFrame, ids: DataFrame) -> DataFrame:
    """Remove rows, except deleted ones, which stay as tombstones; children of removed rows lose their parent."""
    gone = current.where(F.col("deleted_at").isNull()).join(ids.select("id"), "id", "left_semi").select("id")
    kept = current.join(gone, "id", "left_anti")
    parents = gone.select(F.col("id").alias("parent_document_id"), F.lit(True).alias("__gone"))
    orphaned = kept.join(parents, "parent_document_id", "left")
    return orphaned.withColumn("parent_document_id", F.when(F.col("__gone").isNull(), F.col("parent_document_id"))).select(*current.columns)


def cascaded(children: DataFrame, survivors: DataFrame, key: str = "document_id", id_: str = "id") -> DataFrame:
    """Child rows (chunks, memberships, log entries) whose parent survived, and those without one."""
    kept = children.join(survivors.select(F.col(id_).alias(key)), key, "left_semi")
    return kept.unionByName(children.where(F.col(key).isNull()))


def parsed_messages(raw: DataFrame) -> DataFrame:
    """``message_id, text, ts, sender`` from raw chat items; rows without text, id or a readable time are dropped."""
    rows = raw.select(F.col("id").alias("message_id"), "text", F.try_to_timestamp(F.col("timestamp")).alias("ts"), F.col("senderName").alias("sender"))
    return rows.where((F.coalesce(F.length("text"), F.lit(0)) > 0) & F.col("message_id").isNotNull() & F.col("ts").isNotNull())


def since(messages: DataFrame, first_day) -> DataFrame:
    """Messages from a day on. On a feed in any order; it prunes files when the feed is laid out by day."""
    return messages if first_day is None else messages.where(F.to_date("ts") >= F.lit(first_day))


def message_links(messages: DataFrame) -> DataFrame:
    """One row for each distinct URL of a message: ``message_id, ts, url, source_ref, message_text, adapter``."""
    rows = messages.select("message_id", "ts", F.posexplode(found_urls(F.col("text"))).alias("place", "url"), commentary(F.col("text")).alias("message_text"))
    return rows.select("message_id", "ts", "place", "url", F.concat_ws("#", "message_id", "url").alias("source_ref"), "message_text", adapter(F.col("url")).alias("adapter"))


def due_reactions(documents: DataFrame, reacted: DataFrame) -> DataFrame:
    """Messages with any stored document that is ok, and no reaction yet: one row each."""
    chats = documents.where((F.col("source") == "signal") & F.col("deleted_at").isNull())
    ok = chats.groupBy(F.substring_index("source_ref", "#", 1).alias("message_id")).agg(F.bool_or(F.col("status") == "ok").alias("ok"))
    return ok.where("ok").select("message_id").join(reacted.select("message_id"), "message_id", "left_anti")
