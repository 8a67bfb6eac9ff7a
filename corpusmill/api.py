"""The document store as one object: every method returns a DataFrame, or writes a new snapshot."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill import models, schema
from corpusmill.models import Embedder, Enricher, Extractor, embedded, enrichments, extractions
from corpusmill.functions.text import document_text
from corpusmill.operators import enrichment, ingest, listing, retrieval, status, sync
from corpusmill.operators.ranking import numbered
from corpusmill.operators.status import observed
from corpusmill.operators.text_index import TextIndex
from corpusmill.operators.vector_index import VectorIndex
from corpusmill.session import written_table
from corpusmill.sources import vault
from corpusmill.sources.fetching import Journal
from corpusmill.sources.store import Staged, Store


class Corpus:
    """A store of documents, chunks, sets and memberships below ``root``."""

    def __init__(self, spark: SparkSession, root: str, config: schema.Config | None = None) -> None:
        self.spark, self.store, self.config = spark, Store(spark, root), config or schema.Config()

    def documents(self) -> DataFrame:
        return self.store.read("documents", schema.DOCUMENTS)

    def chunks(self) -> DataFrame:
        return self.store.read("chunks", schema.CHUNKS)

    def sets(self) -> DataFrame:
        return self.store.read("sets", schema.SETS)

    def memberships(self) -> DataFrame:
        return self.store.read("set_memberships", schema.MEMBERSHIPS)

    def text_index(self) -> TextIndex:
        return TextIndex(self.store)

    def vector_index(self) -> VectorIndex:
        return VectorIndex(self.store)

    def fetch_cache(self) -> DataFrame:
        return self.store.read("fetch_cache", schema.FETCH_CACHE)

    def run_log(self) -> DataFrame:
        """``job, outcome, n, at``: what every run did, written with what it changed."""
        return self.store.read("run_log", schema.RUN_LOG)

    def _report(self, counts: dict[str, int]) -> DataFrame:
        return self.spark.createDataFrame([(k, n) for k, n in counts.items() if n], "outcome string, n bigint")

    def _commit(self, tables: dict[str, DataFrame], job: str | None = None, counts: dict[str, int] | None = None, staged: list[Staged] | None = None) -> DataFrame:
        """New snapshots of tables in one commit, with their indexes and the run's counts; returns the counts."""
        parts = [*(staged or []), *[self.store.stage(table, rows) for table, rows in tables.items()]]
        if "documents" in tables and self.config.full_text:
            folder = next(p.folder for p in parts if p.table == "documents")
            parts += self.text_index().changed(self.store.read_parts("documents", [folder], schema.DOCUMENTS))
        if "chunks" in tables and self.config.vector_index:
            folder = next(p.folder for p in parts if p.table == "chunks")
            parts += self.vector_index().changed(self.store.read_parts("chunks", [folder], schema.CHUNKS))
        report = self._report(counts or {})
        if job is not None:
            parts.append(self.store.stage("run_log", report.select(F.lit(job).alias("job"), "*", F.current_timestamp().alias("at")), segment=True))
        self.store.publish(parts)
        return report

    # --- reading ---

    def search(self, query: str, embedder: Embedder | None = None, limit: int = 20) -> DataFrame:
        """Hybrid search; the query is embedded on the driver, and only if there are vectors to compare it with."""
        chunks = self.chunks().where(F.col("embedding").isNotNull())
        vector = embedder.embed([query])[0] if embedder is not None and query.strip() and not chunks.isEmpty() else None
        index = self.text_index() if self.config.full_text else None
        return retrieval.hybrid_search(self.documents(), chunks, query, vector, schema.searchable(), limit, index)

    def _held_vectors(self) -> VectorIndex | None:
        """The index of vectors, if this store keeps one and it has been begun; else all chunks are scanned."""
        index = self.vector_index() if self.config.vector_index else None
        return index if index is not None and index.n else None

    def related(self, document_id: int, k: int = 10) -> DataFrame:
        anchor = self.spark.range(document_id, document_id + 1).select(F.col("id").alias("document_id"))
        index = self._held_vectors()
        if index is not None:
            return index.nearest(self.documents(), anchor, schema.searchable(), k).rows
        return retrieval.related(self.documents(), self.chunks(), anchor, schema.searchable(), k)

    def graph(self, document_id: int) -> tuple[DataFrame, DataFrame]:
        return retrieval.two_hops(self.documents(), self.chunks(), document_id, schema.searchable(), self._held_vectors())

    def page(self, limit: int = 50, cursor: str | None = None) -> DataFrame:
        """One page of live documents with their flags; the page is cut before anything is joined to it."""
        rows = listing.keyset_page(self.documents(), limit, listing.read_cursor(cursor) if cursor else None)
        return listing.flagged(rows, self.chunks(), self.memberships(), self.sets()).orderBy(F.col("created_at").desc(), F.col("id").desc())

    def document(self, document_id: int) -> DataFrame:
        row = self.documents().where((F.col("id") == document_id) & schema.live())
        return listing.flagged(row, self.chunks(), self.memberships(), self.sets())

    def set_records(self, name: str, status_: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
        """Records of a set with its declared fields as typed columns."""
        row = self.sets().where(F.col("name") == name).first()
        if row is None:
            raise KeyError(name)
        rows = listing.set_records(self.documents(), self.memberships(), row["id"], status_, limit, offset)
        return rows.withColumn("record", F.from_json("extracted_json", schema.struct_of(json.loads(row["schema_json"])))).drop("extracted_json")

    def review(self, limit: int = 50) -> DataFrame:
        return listing.review_queue(self.documents(), self.memberships(), self.sets(), limit)

    def pipeline(self) -> DataFrame:
        return status.stage_counts(self.documents(), self.memberships())

    # --- writing ---

    def add_set(self, name: str, description: str, set_schema: dict) -> None:
        schema.check_set(name, description, set_schema)
        sets = self.sets()
        if not sets.where(F.col("name") == name).isEmpty():
            raise ValueError(f"set exists: {name}")
        top = sets.agg(F.max("id")).first()[0] or 0
        now = F.current_timestamp()
        row = self.spark.createDataFrame([(top + 1, name, description, json.dumps(set_schema))], "id bigint, name string, description string, schema_json string").withColumns({"created_at": now, "updated_at": now})
        self.store.append("sets", row, schema.SETS)

    def remove_set(self, name: str) -> int:
        """Removes a set and its memberships; returns how many memberships went with it."""
        sets, memberships = self.sets(), self.memberships()
        if sets.where(F.col("name") == name).isEmpty():
            raise KeyError(name)
        kept = sets.where(F.col("name") != name)
        left = sync.cascaded(memberships, kept, "set_id")
        gone = memberships.count() - left.count()
        self.store.commit({"sets": kept, "set_memberships": left})
        return gone

    def delete(self, document_ids: DataFrame) -> None:
        """Tombstones: the documents stay away from listings and searches, and are not synced again."""
        self._commit({"documents": sync.tombstoned(self.documents(), document_ids, F.current_timestamp())})

    def sync_vault(self, folder: str, fetch: Callable | None = None, journal: Journal | None = None) -> DataFrame:
        """Brings the notes of a folder, and with ``fetch`` the pages they link, into the store; returns the report."""
        return self.sync_notes(vault.notes(vault.scan(self.spark, folder, self.config.vault_exclude)), fetch, journal)

    def sync_notes(self, notes: DataFrame, fetch: Callable | None = None, journal: Journal | None = None) -> DataFrame:
        """Notes (``vault.notes``) and their links as one change: all of it is there after the commit, or nothing.

        Notes come first, then the links of those that are not deleted, in order of note and place under one
        budget; documents of links that a note no longer has go, as do those of notes that are gone.
        """
        current, now = self.documents(), F.current_timestamp()
        actions, counts = observed(sync.note_actions(current, notes), "action", sync.NOTE_ACTIONS)
        after = written_table(self._numbered(self._with_notes(current, notes, actions, now), current))
        staged: list[Staged] = []
        if fetch is not None:
            links = self._note_links(notes, after)
            gone, removed = observed(sync.removed_urls(after, links).withColumn("outcome", F.lit("removed")), "outcome", ("removed",))
            after = sync.purged(after, gone)
            done = ingest.ingested(links.where("url is not null"), after, self.fetch_cache(), self.config.max_fetches_per_run, fetch, journal)
            _, outcomes = observed(done.outcomes, "outcome", ingest.OUTCOMES)
            counts |= {f"url_{k}": n for k, n in (outcomes | removed).items()}
            after = written_table(self._numbered(ingest.merged(after, done, now), current))
            staged.append(self.store.stage("fetch_cache", done.cache, segment=True))
        rows = {"chunks": self.chunks(), "set_memberships": self.memberships(), "ingest_log": self.store.read("ingest_log", schema.INGEST_LOG)}
        return self._commit({"documents": after} | {table: sync.cascaded(part, after) for table, part in rows.items()}, "sync_vault", counts, staged)

    def _with_notes(self, current: DataFrame, notes: DataFrame, actions: DataFrame, now: Column) -> DataFrame:
        """The snapshot with changed and new notes and without purged ones; new rows have no id."""
        left = sync.purged(current, sync.purged_with_children(current, actions))
        change = notes.join(actions.where("action in ('insert', 'update')").select("source_ref", "action"), "source_ref")
        fresh = change.select("source_ref", *[F.col(c).alias(f"__{c}") for c in ("title", "body", "content_hash", "frontmatter", "action")])
        updated = left.join(fresh.where("__action = 'update'").withColumn("source", F.lit("obsidian")), ["source", "source_ref"], "left")
        hit = F.col("__action").isNotNull()
        for column, new in (("title", "__title"), ("content", "__body"), ("content_hash", "__content_hash"), ("frontmatter_json", "__frontmatter")):
            updated = updated.withColumn(column, F.when(hit, F.col(new)).otherwise(F.col(column)))
        updated = updated.withColumn("updated_at", F.when(hit, now).otherwise(F.col("updated_at"))).select(*current.columns)
        inserts = fresh.where("__action = 'insert'").select(
            F.lit("obsidian").alias("source"), "source_ref", F.col("__title").alias("title"), F.col("__body").alias("content"), F.col("__content_hash").alias("content_hash"),
            F.col("__frontmatter").alias("frontmatter_json"), F.lit("ok").alias("status"), now.alias("created_at"), now.alias("updated_at"),
        )
        return updated.unionByName(inserts, allowMissingColumns=True)

    def _numbered(self, rows: DataFrame, current: DataFrame) -> DataFrame:
        """``rows`` with ids above all present ones where there is none; to be written before it is read twice."""
        top = max(current.agg(F.max("id")).first()[0] or 0, rows.agg(F.max("id")).first()[0] or 0)
        return rows.withColumn("id", F.coalesce("id", F.lit(top + 1) + F.monotonically_increasing_id()))

    def _note_links(self, notes: DataFrame, after: DataFrame) -> DataFrame:
        """Links of all notes that are not deleted; a note without any has one row without a URL."""
        parents = after.where((F.col("source") == "obsidian") & F.col("parent_document_id").isNull() & F.col("deleted_at").isNull()).select(F.col("source_ref").alias("path"), F.col("id").alias("parent_document_id"))
        rows = notes.select(F.col("source_ref").alias("path"), F.posexplode_outer("urls").alias("place", "url")).join(parents, "path")
        rows = rows.withColumn("__order", F.concat("path", F.lit("\0"), F.lpad(F.coalesce("place", F.lit(0)).cast("string"), 9, "0")))
        placed = numbered(rows, F.lit(0.0), "__order", "position")
        return written_table(placed.select("position", F.lit("obsidian").alias("source"), F.when(F.col("url").isNotNull(), F.concat_ws("#", "path", "url")).alias("source_ref"), "url", "parent_document_id", F.lit(None).cast("string").alias("message_text")))

    def sync_chat(self, raw: DataFrame, fetch: Callable, react: Callable[[str], bool] | None = None, journal: Journal | None = None, stream: str | None = None, batch: int = 0) -> DataFrame:
        """Chat messages (raw items) into documents, one for each link, newest first under the budget; returns the report.

        With a ``stream`` its batch number is part of the same commit, so a batch that comes again changes
        nothing. Reactions follow the commit, also for a repeated batch: each message that has a document
        gets one, and its mark is stored only after ``react`` has returned true.
        """
        counts: dict[str, int] = {}
        last = self.store.read("stream_batches", schema.BATCHES).where(F.col("stream") == stream).agg(F.max("batch")).first()[0] if stream is not None else None
        if last is None or batch > last:
            current, now = self.documents(), F.current_timestamp()
            found = sync.message_links(sync.since(sync.parsed_messages(raw), self.config.backfill_start)).dropDuplicates(["source_ref"])
            ordered = found.withColumn("__order", F.concat("message_id", F.lit("\0"), F.lpad(F.col("place").cast("string"), 9, "0")))
            placed = numbered(ordered, F.unix_timestamp("ts").cast("double"), "__order", "position")
            links = written_table(placed.select("position", F.lit("signal").alias("source"), "source_ref", "url", F.lit(None).cast("bigint").alias("parent_document_id"), "message_text"))
            done = ingest.ingested(links, current, self.fetch_cache(), self.config.max_fetches_per_run, fetch, journal)
            _, counts = observed(done.outcomes, "outcome", ingest.OUTCOMES)
            after = written_table(self._numbered(ingest.merged(current, done, now), current))
            staged = [self.store.stage("fetch_cache", done.cache, segment=True)]
            if stream is not None:
                row = self.spark.createDataFrame([(stream, batch)], schema.BATCHES)
                staged.append(self.store.stage("stream_batches", row, segment=True))
            report = self._commit({"documents": after}, "sync_chat", counts, staged)
        else:
            report = self._report({"repeated_batch": 1})
        if react is None:
            return report
        reacted = self.store.read("signal_reactions", schema.REACTIONS)
        due = sync.due_reactions(self.documents(), reacted)
        marks = written_table(models.reactions(due, react))
        good = marks.where("done").select("message_id", F.current_timestamp().alias("reacted_at"))
        self.store.publish([self.store.stage("signal_reactions", good, segment=True)])
        return report.unionByName(status.report(marks.withColumn("outcome", F.when(F.col("done"), "reacted").otherwise("reaction_failed")), "outcome"))

    def retry_fetches(self, fetch: Callable, journal: Journal | None = None) -> DataFrame:
        """Fetches live documents that are pending or failed again, by id under the budget, in their own rows.

        Cached failures of what is tried are forgotten; a cached success costs nothing.
        """
        current, cache, now = self.documents(), self.fetch_cache(), F.current_timestamp()
        open_ = current.where(F.col("deleted_at").isNull() & F.col("status").isin("pending", "failed") & F.col("url").isNotNull())
        links = written_table(open_.select(F.col("id").alias("position"), *ingest.LINK[1:]))
        done = ingest.ingested(links, current, cache.where("status = 'ok'"), self.config.max_fetches_per_run, fetch, journal)
        _, counts = observed(done.outcomes, "outcome", ingest.OUTCOMES)
        after = written_table(self._numbered(ingest.merged(current, done, now), current))
        left = cache.join(done.cache.select("key"), "key", "left_anti").unionByName(done.cache)
        return self._commit({"documents": after, "fetch_cache": left}, "retry_fetches", counts)

    def ingest_urls(self, urls: DataFrame, fetch: Callable, actor: str = "cli", journal: Journal | None = None) -> DataFrame:
        """Fetches URLs (``url``) asked for by hand, whatever is stored of them, and writes down who asked; returns the report.

        The log rows are part of the same commit. A deleted document is brought up to date and stays deleted.
        """
        if actor not in schema.ACTORS:
            raise ValueError(f"unknown actor: {actor}")
        current, now = self.documents(), F.current_timestamp()
        source = "mcp" if actor == "mcp" else "manual"
        placed = numbered(urls.select("url").distinct(), F.lit(0.0), "url", "position")
        links = written_table(placed.select("position", F.lit(source).alias("source"), F.col("url").alias("source_ref"), "url", F.lit(None).cast("bigint").alias("parent_document_id"), F.lit(None).cast("string").alias("message_text")))
        open_ = current.withColumns({"deleted_at": F.lit(None).cast("timestamp"), "status": F.lit("pending")})
        done = ingest.ingested(links, open_, self.fetch_cache(), self.config.max_fetches_per_run, fetch, journal)
        _, counts = observed(done.outcomes, "outcome", ingest.OUTCOMES)
        done.rows = done.rows.drop("message_text")
        after = written_table(self._numbered(ingest.merged(current, done, now), current))
        log = after.join(links.select(*sync.KEY), sync.KEY, "left_semi").select(F.monotonically_increasing_id().alias("id"), F.col("id").alias("document_id"), F.lit(actor).alias("actor"), "url", now.alias("at"))
        logged = self.store.read("ingest_log", schema.INGEST_LOG)
        top = logged.agg(F.max("id")).first()[0] or 0
        staged = [self.store.stage("fetch_cache", done.cache, segment=True), self.store.stage("ingest_log", log.withColumn("id", F.col("id") + top + 1), segment=True)]
        return self._commit({"documents": after}, "ingest_urls", counts, staged)

    def update_set(self, name: str, description: str, set_schema: dict) -> None:
        """A new description and schema of a set; its memberships stay."""
        schema.check_set(name, description, set_schema)
        sets = self.sets()
        here = F.col("name") == name
        if sets.where(here).isEmpty():
            raise KeyError(name)
        new = {"description": F.lit(description), "schema_json": F.lit(json.dumps(set_schema)), "updated_at": F.current_timestamp()}
        self.store.write("sets", sets.withColumns({c: F.when(here, v).otherwise(F.col(c)) for c, v in new.items()}))

    def index(self, embedder: Embedder) -> DataFrame:
        """Chunks and embeds what changed, stamps its digest; returns how many documents were processed, skipped, failed.

        What the model has computed is written once, so no chunk is sent to it twice; texts are read again instead.
        """
        docs = self.documents()
        plan = enrichment.change_plan(docs, self.config.embed_model)
        fresh = written_table(embedded(enrichment.new_chunks(plan, self.config.target_chars, self.config.overlap_chars), embedder))
        done, counts = observed(enrichment.outcomes(plan, fresh), "action", ("process", "skip", "failed"))
        chunks = enrichment.replaced_chunks(self.chunks(), fresh, done).withColumn("id", F.xxhash64("document_id", "ordinal"))
        return self._commit({"chunks": chunks.select(*schema.CHUNKS.fieldNames()), "documents": enrichment.stamped(docs, done, "chunks_hash")}, "index", counts)

    def enrich(self, enricher: Enricher) -> DataFrame:
        """Summaries, keywords and memberships of what changed; a failed document keeps what it had. Returns the report."""
        docs, sets, memberships = self.documents(), self.sets(), self.memberships()
        plan = enrichment.change_plan(docs, self.config.enrich_model, "enriched_hash")
        # the sets are part of every prompt
        prompts = [(r["name"], r["description"]) for r in sets.orderBy("name").select("name", "description").collect()]
        replies = written_table(enrichments(plan.where("action = 'process'"), enricher, prompts))
        done, counts = observed(enrichment.outcomes(plan, replies, "id"), "action", ("process", "skip", "failed"))
        good = replies.where("error is null")
        changes, moves = observed(enrichment.reconciled(memberships, enrichment.matches(good, sets), good.select(F.col("id").alias("document_id"))), "action", ("insert", "delete"))
        return self._commit({"documents": enrichment.enriched(docs, done, good), "set_memberships": enrichment.applied(memberships, changes)}, "enrich", counts | moves)

    def extract(self, extractor: Extractor, set_name: str | None = None) -> DataFrame:
        """Records of open memberships (pending or failed), of one set or all; returns how many ended in which status."""
        docs, sets, memberships = self.documents(), self.sets(), self.memberships()
        bodies = docs.select(F.col("id").alias("document_id"), document_text(F.col("message_text"), F.col("content")).alias("body"))
        known = F.broadcast(sets.select(F.col("id").alias("set_id"), "schema_json"))
        work = enrichment.open_memberships(memberships, docs, sets, set_name).join(bodies, "document_id").join(known, "set_id")
        replies = written_table(extractions(work, extractor))
        records, counts = observed(enrichment.extracted(replies.join(known, "set_id"), *enrichment.declared(F.col("schema_json"))), "status", ("ok", "partial", "failed"))
        return self._commit({"set_memberships": enrichment.recorded(memberships, records, F.current_timestamp())}, "extract", counts)
