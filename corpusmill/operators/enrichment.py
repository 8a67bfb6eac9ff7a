"""Indexing, enriching and field extraction: change detection, chunk replacement, memberships, records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.records import as_map, cleaned, missing_fields, record_status
from corpusmill.functions.text import chunked, digest, document_text, keyword_text, split_keywords, token_estimate
from corpusmill.schema import searchable


def change_plan(docs: DataFrame, model: str, stored: str = "chunks_hash") -> DataFrame:
    """Searchable documents with their indexed text, its digest, and ``action``: process or skip.

    Null-safe: a document without a stored digest is always processed.
    """
    text = document_text(F.col("message_text"), F.col("content"))
    rows = docs.where(searchable()).select("id", stored, text.alias("body")).withColumn("digest", digest(model, F.col("body")))
    return rows.withColumn("action", F.when(F.col(stored).eqNullSafe(F.col("digest")), "skip").otherwise("process"))


def new_chunks(plan: DataFrame, target: int = 4000, overlap: int = 400) -> DataFrame:
    """Chunks, without vectors, of the documents to process."""
    work = plan.where("action = 'process'").select(F.col("id").alias("document_id"), "body")
    return chunked(work, "body", target, overlap).withColumn("token_count", token_estimate(F.col("text")))


def outcomes(plan: DataFrame, tried: DataFrame, key: str = "document_id") -> DataFrame:
    """``plan`` without its texts, with ``action`` skip, process, or failed where any row of ``tried`` has an ``error``."""
    failed = tried.where("error is not null").select(F.col(key).alias("id"), F.lit(True).alias("failed")).distinct()
    return plan.drop("body").join(failed, "id", "left").withColumn("action", F.when(F.col("failed") & (F.col("action") == "process"), "failed").otherwise(F.col("action"))).drop("failed")


def replaced_chunks(chunks: DataFrame, fresh: DataFrame, done: DataFrame) -> DataFrame:
    """The chunk table after a run: ``fresh`` chunks of the processed documents in ``done``, all others as they were.

    So a document whose embedding failed keeps its chunks and vectors. ``fresh`` tells where a row comes from.
    """
    work = done.where("action = 'process'").select(F.col("id").alias("document_id"))
    names = ("document_id", "ordinal", "text", "token_count", "embedding")
    old = chunks.join(work, "document_id", "left_anti").withColumn("token_count", token_estimate(F.col("text")))
    new = fresh.join(work, "document_id", "left_semi")
    return old.select(*names, F.lit(False).alias("fresh")).unionByName(new.select(*names, F.lit(True).alias("fresh")))


def stamped(docs: DataFrame, done: DataFrame, column: str) -> DataFrame:
    """``docs`` with the digest of what was processed in ``column``."""
    new = done.where("action = 'process'").select("id", F.col("digest").alias("__digest"))
    return docs.join(new, "id", "left").withColumn(column, F.coalesce("__digest", F.col(column))).select(*docs.columns)


def enriched(docs: DataFrame, done: DataFrame, replies: DataFrame) -> DataFrame:
    """``docs`` with summary, keywords and digest from the replies to processed documents; all others as they were."""
    new = replies.select("id", F.col("summary").alias("__summary"), keyword_text(split_keywords(F.col("keywords"))).alias("__keywords"))
    new = done.where("action = 'process'").select("id").join(new, "id")
    hit = F.col("__keywords").isNotNull()
    joined = stamped(docs, done, "enriched_hash").join(new, "id", "left")
    return joined.withColumns({c: F.when(hit, F.col(f"__{c}")).otherwise(F.col(c)) for c in ("summary", "keywords")}).select(*docs.columns)


def matches(replies: DataFrame, sets: DataFrame) -> DataFrame:
    """``document_id, set_id`` of the sets that replies name; names that are no set are left out."""
    named = replies.select(F.col("id").alias("document_id"), F.explode("sets").alias("name"))
    return named.join(F.broadcast(sets.select(F.col("id").alias("set_id"), "name")), "name").select("document_id", "set_id").distinct()


def applied(memberships: DataFrame, changes: DataFrame) -> DataFrame:
    """The membership table after ``reconciled`` changes: deleted ones go, new ones are pending, others stay."""
    key = ["document_id", "set_id"]
    kept = memberships.join(changes.where("action = 'delete'").select(*key), key, "left_anti")
    new = changes.where("action = 'insert'").select(*key, F.lit("pending").alias("status"))
    return kept.unionByName(new, allowMissingColumns=True)


def reconciled(memberships: DataFrame, matched: DataFrame, judged: DataFrame) -> DataFrame:
    """``document_id, set_id, action``: insert, keep or delete, for the documents that were ``judged``.

    A membership that stays keeps its record. Documents that were not judged are left alone.
    """
    key = ["document_id", "set_id"]
    old = memberships.join(judged, "document_id", "left_semi").select(*key, F.lit(True).alias("old"))
    new = matched.join(judged, "document_id", "left_semi").select(*key, F.lit(True).alias("new")).distinct()
    action = F.when(F.col("old").isNull(), "insert").when(F.col("new").isNull(), "delete").otherwise("keep")
    return old.join(new, key, "full_outer").select(*key, action.alias("action"))


def open_memberships(memberships: DataFrame, docs: DataFrame, sets: DataFrame, set_name: str | None = None) -> DataFrame:
    """Memberships whose record is still to be extracted: pending or failed, of searchable documents."""
    rows = memberships.where(F.col("status").isin("pending", "failed"))
    chosen = sets if set_name is None else sets.where(F.col("name") == set_name)
    named = rows.join(F.broadcast(chosen.select(F.col("id").alias("set_id"), F.col("name").alias("set_name"))), "set_id")
    return named.join(docs.where(searchable()).select(F.col("id").alias("document_id")), "document_id", "left_semi")


def declared(schema_json: Column) -> tuple[Column, Column]:
    """Names of the properties of a set's schema, and of the required ones."""
    required = F.from_json(F.get_json_object(schema_json, "$.required"), "array<string>")
    return F.json_object_keys(F.get_json_object(schema_json, "$.properties")), required


def extracted(replies: DataFrame, properties: Column, required: Column) -> DataFrame:
    """Records from replies (``reply`` JSON, ``error``): undeclared keys dropped, missing fields listed, status set."""
    rows = replies.withColumn("record", cleaned(F.col("reply"), properties)).withColumn("missing_fields", missing_fields(F.col("record"), required))
    return rows.withColumn("status", record_status(F.col("missing_fields"), F.col("error")))


def recorded(memberships: DataFrame, records: DataFrame, at: Column) -> DataFrame:
    """The membership table after an extraction: a failed one keeps the record it had, the others have the new one."""
    key = ["document_id", "set_id"]
    new = records.select(*key, *[F.col(c).alias(f"__{c}") for c in ("reply", "missing_fields", "status", "error")])
    rows = memberships.join(new, key, "left")
    hit, good = F.col("__status").isNotNull(), F.col("__status") != "failed"
    columns = {
        "extracted_json": F.when(hit & good, F.col("__reply")).otherwise(F.col("extracted_json")),
        "missing_fields": F.when(hit & good, F.col("__missing_fields")).otherwise(F.col("missing_fields")),
        "error": F.when(hit, F.col("__error")).otherwise(F.col("error")),
        "extracted_at": F.when(hit, at).otherwise(F.col("extracted_at")),
        "status": F.coalesce("__status", "status"),
    }
    return rows.withColumns(columns).select(*memberships.columns)


def patch(records: DataFrame, record: Column, fields: Column, properties: Column, required: Column) -> DataFrame:
    """Records merged with ``fields``; a row with undeclared keys keeps its record and lists them in ``error``."""
    from corpusmill.functions.records import patched, unknown_keys

    rows = records.withColumn("unknown", unknown_keys(fields, properties))
    merged = F.when(F.size("unknown") == 0, patched(as_map(record), fields)).otherwise(as_map(record))
    rows = rows.withColumn("merged", merged).withColumn("missing_fields", missing_fields(F.col("merged"), required))
    error = F.when(F.size("unknown") > 0, F.concat(F.lit("unknown fields: "), F.array_join("unknown", ", ")))
    return rows.withColumn("error", error).withColumn("status", record_status(F.col("missing_fields"), F.lit(None).cast("string")))
