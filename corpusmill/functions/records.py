"""JSON functions: payload fields, records of user-defined sets, missing fields, patches."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def outer_json(body: Column) -> Column:
    """From the first opening to the last closing brace; null if there is no such part."""
    return F.nullif(F.regexp_extract(body, r"(?s)(\{.*\})", 1), F.lit(""))


def text_field(payload: Column, path: str) -> Column:
    """A string at a path of a JSON text; any other value, or malformed JSON, is null."""
    value = F.try_parse_json(payload)
    found = F.try_variant_get(value, path, "variant")
    return F.when(F.schema_of_variant(found) == "STRING", F.try_variant_get(value, path, "string"))


def is_object(payload: Column) -> Column:
    return F.coalesce(F.schema_of_variant(F.try_parse_json(payload)).startswith("OBJECT"), F.lit(False))


def as_map(record: Column) -> Column:
    """A JSON object as a map from key to the value's JSON text; null values stay, as null."""
    keys = F.json_object_keys(record)
    value = F.from_json(record, "map<string,string>")
    return F.coalesce(F.map_from_arrays(keys, F.transform(keys, lambda k: value[k])), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))


def cleaned(record: Column, properties: Column) -> Column:
    """A map of record values without keys that the set's schema does not declare."""
    return F.map_filter(as_map(record), lambda k, _: F.array_contains(properties, k))


def missing_fields(values: Column, required: Column) -> Column:
    """Required fields whose value is absent or null, in the order of ``required``; none if nothing is required."""
    return F.filter(F.coalesce(required, F.array().cast("array<string>")), lambda f: F.element_at(values, f).isNull())


def record_status(missing: Column, error: Column) -> Column:
    return F.when(error.isNotNull(), F.lit("failed")).when(F.size(missing) > 0, F.lit("partial")).otherwise(F.lit("ok"))


def patched(values: Column, fields: Column) -> Column:
    """``values`` with the keys of ``fields`` replaced or added."""
    kept = F.map_filter(values, lambda k, _: ~F.map_contains_key(fields, k))
    return F.map_concat(kept, fields)


def unknown_keys(fields: Column, properties: Column) -> Column:
    return F.array_sort(F.array_except(F.map_keys(fields), properties))
