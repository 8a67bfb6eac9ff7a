"""Model calls behind small interfaces, with deterministic stand-ins that need no network."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Inputs of one embedding call, and characters of a text that a chat model is shown.
BATCH, MOST_CHARS = 16, 6000
#: Rows with their texts and vectors that a task holds at a time; whole calls.
SLICE = 16 * BATCH


class Embedder(Protocol):
    def embed(self, texts: list[str]) -> list[list[float]]: ...


class Enricher(Protocol):
    def enrich(self, text: str, sets: list[tuple[str, str]]) -> dict: ...


class Extractor(Protocol):
    def extract(self, text: str, schema: dict) -> dict: ...


class HashEmbedder:
    """Words hashed onto signed positions; equal texts have equal vectors."""

    def __init__(self, size: int = 64) -> None:
        self.size = size

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), self.size), dtype=np.float32)
        for row, text in zip(out, texts):
            for word in text.lower().split():
                h = hashlib.blake2b(word.encode(), digest_size=8).digest()
                row[int.from_bytes(h[:4], "little") % self.size] += 1 if h[4] & 1 else -1
        return out.tolist()


class FirstWords:
    """Enricher and extractor without a model: first sentence, longest words, and text for string fields."""

    def enrich(self, text: str, sets: list[tuple[str, str]]) -> dict:
        words = sorted(set(text.split()), key=lambda w: (-len(w), w))[:5]
        return {"summary": text.split(".")[0][:200], "keywords": words, "sets": [name for name, _ in sets if name in text]}

    def extract(self, text: str, schema: dict) -> dict:
        first = text.split()
        return {k: (first[0] if first else None) for k, p in schema.get("properties", {}).items() if p.get("type", "string") == "string"}


def embedded(chunks: DataFrame, embedder: Embedder) -> DataFrame:
    """``chunks`` with ``embedding`` and ``error``: calls of 16 texts inside Arrow batches, of which tasks hold ``SLICE`` rows at a time.

    When a call fails its texts are sent one by one, so that only those fail that the model refuses.
    """
    kept = [f for f in chunks.schema.fields if f.name not in ("embedding", "error")]

    def vectors_of(texts: list[str]) -> list[tuple]:
        try:
            return [(v, None) for v in embedder.embed(texts)]
        except Exception as failure:
            return [x for t in texts for x in vectors_of([t])] if len(texts) > 1 else [(None, str(failure))]

    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                part = batch.slice(start, SLICE)
                texts = part.column(names.index("text")).to_pylist()
                found = [x for at in range(0, len(texts), BATCH) for x in vectors_of(texts[at : at + BATCH])]
                vectors = pa.array([None if v is None else np.asarray(v, dtype=np.float32).tolist() for v, _ in found], pa.list_(pa.float32()))
                yield pa.RecordBatch.from_arrays([*part.columns, vectors, pa.array([e for _, e in found], pa.string())], [*names, "embedding", "error"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return chunks.select(*names).mapInArrow(run, f"{fields}, embedding array<float>, error string")


def enrichments(work: DataFrame, enricher: Enricher, sets: list[tuple[str, str]]) -> DataFrame:
    """``id, summary, keywords, sets, error`` for rows ``id, body``: one call for each document, whose failure is its own."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for key, body in zip(batch["id"], batch["body"]):
                try:
                    reply = enricher.enrich(body, sets)
                    out.append((key, reply["summary"], list(reply["keywords"]), list(reply["sets"]), None))
                except Exception as failure:
                    out.append((key, None, None, None, str(failure)))
            yield pd.DataFrame(out, columns=["id", "summary", "keywords", "sets", "error"])

    return work.select("id", model_text(F.col("body")).alias("body")).mapInPandas(run, "id bigint, summary string, keywords array<string>, sets array<string>, error string")


def extractions(work: DataFrame, extractor: Extractor) -> DataFrame:
    """``document_id, set_id, reply, error`` for rows with ``body`` and ``schema_json``; the reply keeps declared keys only."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for document, of, body, schema in zip(batch["document_id"], batch["set_id"], batch["body"], batch["schema_json"]):
                try:
                    declared = json.loads(schema)
                    reply = extractor.extract(body, declared)
                    out.append((document, of, json.dumps({k: v for k, v in reply.items() if k in declared["properties"]}, ensure_ascii=False), None))
                except Exception as failure:
                    out.append((document, of, None, str(failure)))
            yield pd.DataFrame(out, columns=["document_id", "set_id", "reply", "error"])

    return work.select("document_id", "set_id", model_text(F.col("body")).alias("body"), "schema_json").mapInPandas(run, "document_id bigint, set_id bigint, reply string, error string")


def reactions(due: DataFrame, react) -> DataFrame:
    """``message_id, done`` for messages to react to; what ``react`` raises is a reaction that was not made."""

    def made(message: str) -> bool:
        try:
            return bool(react(message))
        except Exception:
            return False

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(done=[made(m) for m in batch["message_id"]])

    return due.select("message_id").mapInPandas(run, "message_id string, done boolean")


def model_text(text):
    """What a chat model is shown of a text."""
    return F.substring(text, 1, MOST_CHARS)
