"""Table schemas of the document store, and the mapping of user-defined JSON Schemas to Spark types."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_NAMES = {"bigint": T.LongType(), "int": T.IntegerType(), "string": T.StringType(), "timestamp": T.TimestampType()}
_NAMES |= {"array<string>": T.ArrayType(T.StringType()), "array<float>": T.ArrayType(T.FloatType()), "array<double>": T.ArrayType(T.DoubleType()), "double": T.DoubleType(), "map<string,string>": T.MapType(T.StringType(), T.StringType())}


def declared(columns: str) -> T.StructType:
    """A schema from names and types; unlike Spark's own parser it needs no session."""
    return T.StructType([T.StructField(*(part if i == 0 else _NAMES[part] for i, part in enumerate(c.split()))) for c in columns.split(", ")])


DOCUMENTS = declared(
    "id bigint, source string, source_ref string, url string, parent_document_id bigint, title string, author string, content string, "
    "summary string, keywords string, message_text string, content_hash string, chunks_hash string, enriched_hash string, extra map<string,string>, "
    "frontmatter_json string, status string, error string, fetched_at timestamp, created_at timestamp, updated_at timestamp, deleted_at timestamp"
)
CHUNKS = declared("id bigint, document_id bigint, ordinal int, text string, token_count int, embedding array<float>")
SETS = declared("id bigint, name string, description string, schema_json string, created_at timestamp, updated_at timestamp")
MEMBERSHIPS = declared("document_id bigint, set_id bigint, extracted_json string, missing_fields array<string>, status string, error string, extracted_at timestamp")
INGEST_LOG = declared("id bigint, document_id bigint, actor string, url string, at timestamp")
FETCH_CACHE = declared("key string, url string, final_url string, status string, body string, content_type string, error string, fetched_at string")
RUN_LOG = declared("job string, outcome string, n bigint, at timestamp")
BATCHES = declared("stream string, batch bigint")
REACTIONS = declared("message_id string, reacted_at timestamp")

# What the store allows in these columns.
SOURCES = ("signal", "obsidian", "manual", "mcp")
STATUSES = ("pending", "ok", "failed")
MEMBERSHIP_STATUSES = ("pending", "ok", "partial", "failed")
ACTORS = ("cron", "cli", "dashboard", "mcp")


@dataclass(frozen=True)
class Config:
    """Settings that plans depend on; model names take part in digests."""

    embed_model: str = "bge-m3"
    enrich_model: str = "qwen3:8b"
    vault_exclude: tuple[str, ...] = ()
    backfill_start: date | None = None
    max_fetches_per_run: int = 50
    target_chars: int = 4000
    overlap_chars: int = 400
    #: Keep a full-text index of the documents with every change.
    full_text: bool = True
    #: Keep an index of the chunks' vectors with every change.
    vector_index: bool = True
    extra: dict[str, str] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.max_fetches_per_run <= 0:
            raise ValueError("max_fetches_per_run must be positive")


def searchable() -> Column:
    """Rows that searching, indexing and enriching see: with content, fetched, not deleted."""
    return F.col("content").isNotNull() & (F.col("status") == "ok") & F.col("deleted_at").isNull()


def live() -> Column:
    """Rows that listings and status counts see: everything not deleted."""
    return F.col("deleted_at").isNull()


_TYPES = {"string": T.StringType(), "integer": T.LongType(), "number": T.DoubleType(), "boolean": T.BooleanType()}


def declared_type(prop: dict) -> str:
    """The first type other than null that a property declares; string if it declares none."""
    kind = prop.get("type", "string")
    kinds = kind if isinstance(kind, list) else [kind]
    return next((k for k in kinds if k != "null"), "string")


def struct_of(schema: dict) -> T.StructType:
    """A JSON Schema's properties, in order, as a struct for from_json()."""
    fields = []
    for name, prop in schema.get("properties", {}).items():
        kind = declared_type(prop)
        if kind == "array":
            fields.append(T.StructField(name, T.ArrayType(_TYPES.get(declared_type(prop.get("items", {})), T.StringType()))))
        else:
            fields.append(T.StructField(name, _TYPES.get(kind, T.StringType())))
    return T.StructType(fields)


def check_set(name: str, description: str, schema: dict) -> None:
    """A set needs a name, a description, and an object schema with properties."""
    if not name.strip():
        raise ValueError("a set needs a name")
    if not description.strip():
        raise ValueError("a set needs a description")
    if schema.get("type") != "object" or not isinstance(schema.get("properties"), dict) or not schema["properties"]:
        raise ValueError("a set's schema must be an object with properties")


def check_rows(column: str, allowed: tuple[str, ...]) -> Column:
    """The column, or an error in the job for a value that the table does not allow."""
    value = F.col(column)
    return F.when(value.isin(*allowed), value).otherwise(F.raise_error(F.concat(F.lit(f"{column} not allowed: "), F.coalesce(value, F.lit("null")))))
