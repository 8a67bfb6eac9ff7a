"""The store's logical tables, derived from the driver's synthetic tables: as DataFrames, and as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.operators.text_index import TextIndex, index_of
from corpusmill.operators.vector_index import VectorIndex

EMBED_MODEL = "bge-m3"

#: Schemas of the two sets, by id.
SETS = {
    1: ("quality", "Documents rated by quality", {"type": "object", "properties": {"lang_code": {"type": "string"}, "rating": {"type": ["integer", "null"]}, "origin": {"type": "string"}}, "required": ["rating", "lang_code"]}),
    2: ("toxic", "Documents rated as toxic", {"type": "object", "properties": {"lang_code": {"type": "string"}, "rating": {"type": ["integer", "null"]}}, "required": ["rating"]}),
}


class Tables:
    """Lazily derived tables of one folder."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def documents(self) -> DataFrame:
        n = F.col("doc_id")
        first_line = F.substring_index("text", "\n", 1)
        return self.raw("documents").select(
            n.alias("id"),
            F.when(n % 4 == 0, "obsidian").when(n % 4 == 1, "signal").when(n % 4 == 2, "manual").otherwise("mcp").alias("source"),
            F.concat(F.lit("ref-"), n.cast("string")).alias("source_ref"),
            F.concat(F.lit("https://host"), (n % 50).cast("string"), F.lit(".example/"), n.cast("string")).alias("url"),
            F.when((n % 6 == 0) & (n > 0), F.floor(n / 2)).cast("long").alias("parent_document_id"),
            F.substring(first_line, 1, 60).alias("title"),
            F.when(n % 19 != 0, F.col("text")).alias("content"),
            F.lit(None).cast("string").alias("summary"),
            F.concat_ws(", ", "lang", F.col("source")).alias("keywords"),
            F.when(n % 7 == 0, F.concat(F.lit("note "), F.col("lang"))).alias("message_text"),
            F.sha2("text", 256).alias("content_hash"),
            F.when(n % 3 == 0, F.lit("stale")).alias("chunks_hash"),
            F.when(n % 5 == 0, F.lit("seen")).alias("enriched_hash"),
            F.when(n % 17 == 0, "failed").when(n % 13 == 0, "pending").otherwise("ok").alias("status"),
            F.when(n % 17 == 0, F.lit("HTTP 404")).alias("error"),
            (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(secs=F.floor(n / 3))).alias("created_at"),
            F.when(n % 29 == 0, F.lit("2024-06-01").cast("timestamp")).alias("deleted_at"),
        )

    def text_index(self) -> TextIndex:
        """The stored full-text index of :meth:`documents`: made at the first search over the folder, read by the others."""
        return index_of(self.documents(), [self.raw("documents")], self.sf_dir)

    def vector_index(self) -> VectorIndex:
        """The stored index of the vectors of :meth:`chunks`, made and kept in the same way."""
        return index_of(self.chunks().drop("text"), [self.raw("embeddings"), self.raw("documents")], self.sf_dir, VectorIndex)

    def chunks(self) -> DataFrame:
        rows = self.raw("embeddings").select(F.expr("vec_id div 2").alias("document_id"), (F.col("vec_id") % 2).cast("int").alias("ordinal"), "embedding")
        texts = self.raw("documents").select(F.col("doc_id").alias("document_id"), F.col("text").alias("whole"))
        return rows.join(texts, "document_id").select("document_id", "ordinal", F.expr("substring(whole, ordinal * 400 + 1, 400)").alias("text"), "embedding")

    def sets(self) -> DataFrame:
        import json

        return self.spark.createDataFrame([(i, name, about, json.dumps(schema)) for i, (name, about, schema) in SETS.items()], "id bigint, name string, description string, schema_json string")

    def memberships(self) -> DataFrame:
        n = F.col("doc_id")
        rows = self.raw("labels").where("doc_id is not null")
        rows = rows.select("doc_id", F.explode(F.array_compact(F.array(F.when(F.col("quality") == 1, F.lit(1).cast("long")), F.when(F.col("toxic") == 1, F.lit(2).cast("long"))))).alias("set_id"))
        code = F.when(n % 7 != 0, F.concat(F.lit('"lang_code":"c'), (n % 3).cast("string"), F.lit('"')))
        rating = F.when(n % 5 == 0, F.lit('"rating":null')).otherwise(F.concat(F.lit('"rating":'), (n % 10).cast("string")))
        odd = F.when(n % 3 == 0, F.lit('"zzz":"extra"'))
        status = F.when(n % 11 == 0, "failed").when(n % 4 == 0, "pending").when(n % 5 == 0, "partial").otherwise("ok")
        return rows.select(
            F.col("doc_id").alias("document_id"),
            "set_id",
            F.concat(F.lit("{"), F.concat_ws(",", code, rating, odd), F.lit("}")).alias("extracted_json"),
            F.when(status == "partial", F.array(F.lit("rating"))).alias("missing_fields"),
            status.alias("status"),
            F.when(n % 11 == 0, F.lit("model error")).alias("error"),
        )

    def messages(self) -> DataFrame:
        """Raw chat items: every second turn links a page; some have no text, id or time."""
        pages = self.raw("pages").groupBy("page_id").agg(F.min("url").alias("url"))
        n = self.raw("pages").agg(F.max("page_id")).first()[0] + 1  # one number: the modulus of the mapping below
        talk = self.raw("conversations").withColumn("page_id", (F.col("conv_id") + F.col("turn")) % n)
        rows = talk.join(pages, "page_id", "left")
        key = F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
        at = F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(secs=F.col("conv_id") * 60 + F.col("turn"))
        return rows.select(
            F.when(F.col("conv_id") % 23 != 0, key).alias("id"),
            F.when(F.col("conv_id") % 31 == 0, F.lit("")).when(F.col("turn") % 2 == 0, F.concat(F.col("text"), F.lit(" ("), F.coalesce("url", F.lit("")), F.lit(").  see "), F.coalesce("url", F.lit("")))).otherwise(F.col("text")).alias("text"),
            F.when(F.col("conv_id") % 37 == 0, F.lit("never")).otherwise(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("timestamp"),
            F.col("role").alias("senderName"),
        )


SQL = """
docs AS (
    SELECT doc_id AS id, CASE doc_id % 4 WHEN 0 THEN 'obsidian' WHEN 1 THEN 'signal' WHEN 2 THEN 'manual' ELSE 'mcp' END AS source,
           'ref-' || doc_id AS source_ref, 'https://host' || (doc_id % 50) || '.example/' || doc_id AS url,
           CASE WHEN doc_id % 6 = 0 AND doc_id > 0 THEN doc_id // 2 END AS parent_document_id,
           substr(split_part(text, chr(10), 1), 1, 60) AS title, CASE WHEN doc_id % 19 <> 0 THEN text END AS content, NULL::VARCHAR AS summary,
           concat_ws(', ', lang, source) AS keywords, CASE WHEN doc_id % 7 = 0 THEN 'note ' || lang END AS message_text, sha256(text) AS content_hash,
           CASE WHEN doc_id % 3 = 0 THEN 'stale' END AS chunks_hash, CASE WHEN doc_id % 5 = 0 THEN 'seen' END AS enriched_hash,
           CASE WHEN doc_id % 17 = 0 THEN 'failed' WHEN doc_id % 13 = 0 THEN 'pending' ELSE 'ok' END AS status,
           CASE WHEN doc_id % 17 = 0 THEN 'HTTP 404' END AS error, TIMESTAMP '2024-01-01' + to_seconds(doc_id // 3) AS created_at,
           CASE WHEN doc_id % 29 = 0 THEN TIMESTAMP '2024-06-01' END AS deleted_at
    FROM documents),
visible AS (SELECT * FROM docs WHERE content IS NOT NULL AND status = 'ok' AND deleted_at IS NULL),
chunks AS (
    SELECT vec_id // 2 AS document_id, (vec_id % 2)::INT AS ordinal, substr(d.text, (vec_id % 2) * 400 + 1, 400) AS text, embedding::DOUBLE[] AS embedding
    FROM embeddings JOIN documents d ON d.doc_id = vec_id // 2),
sets AS (SELECT * FROM (VALUES (1, 'quality'), (2, 'toxic')) t(id, name)),
memberships AS (
    SELECT doc_id AS document_id, set_id,
           '{' || concat_ws(',', CASE WHEN doc_id % 7 <> 0 THEN '"lang_code":"c' || (doc_id % 3) || '"' END,
                            CASE WHEN doc_id % 5 = 0 THEN '"rating":null' ELSE '"rating":' || (doc_id % 10) END, CASE WHEN doc_id % 3 = 0 THEN '"zzz":"extra"' END) || '}' AS extracted_json,
           CASE WHEN doc_id % 11 = 0 THEN 'failed' WHEN doc_id % 4 = 0 THEN 'pending' WHEN doc_id % 5 = 0 THEN 'partial' ELSE 'ok' END AS status,
           CASE WHEN doc_id % 11 = 0 THEN 'model error' END AS error
    FROM (SELECT doc_id, 1 AS set_id FROM labels WHERE quality = 1 UNION ALL SELECT doc_id, 2 FROM labels WHERE toxic = 1)),
raw_messages AS (
    SELECT CASE WHEN conv_id % 23 <> 0 THEN conv_id || '-' || turn END AS id,
           CASE WHEN conv_id % 31 = 0 THEN '' WHEN turn % 2 = 0 THEN text || ' (' || coalesce(url, '') || ').  see ' || coalesce(url, '') ELSE text END AS text,
           CASE WHEN conv_id % 37 <> 0 THEN TIMESTAMP '2024-01-01' + to_seconds(conv_id * 60 + turn) END AS ts, role AS sender
    FROM conversations LEFT JOIN (SELECT page_id, min(url) AS url FROM pages GROUP BY page_id) p ON p.page_id = (conv_id + turn) % (SELECT max(page_id) + 1 FROM pages)),
messages AS (SELECT id AS message_id, text, ts, sender FROM raw_messages WHERE id IS NOT NULL AND text <> '' AND ts IS NOT NULL)
"""


def with_tables(query: str, more: str = "", recursive: bool = False) -> str:
    """A query over the logical tables."""
    return f"WITH {'RECURSIVE ' if recursive else ''}{SQL}{', ' + more if more else ''}\n{query}"
