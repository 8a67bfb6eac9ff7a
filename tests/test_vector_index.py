"""The stored index of vectors against the scan of all vectors."""

import random

import pytest
from pyspark.sql import functions as F

from corpusmill import schema
from corpusmill.api import Corpus
from corpusmill.models import HashEmbedder
from corpusmill.operators import retrieval, vector_index
from corpusmill.operators.vector_index import VectorIndex
from corpusmill.sources.store import Store

DOCS = "id bigint, hidden boolean"
CHUNKS = "document_id bigint, ordinal int, embedding array<float>"


def grouped(rng, groups=12, each=20, size=8, spread=0.05):
    """Vectors in tight groups."""
    rows = []
    for g in range(groups):
        middle = [rng.gauss(0, 1) for _ in range(size)]
        for i in range(each):
            rows.append((g * each + i, 0, [m + rng.gauss(0, spread) for m in middle]))
            if i % 3 == 0:
                rows.append((g * each + i, 1, [m + rng.gauss(0, spread) for m in middle]))
    return rows


def tables(spark, rows):
    ids = sorted({r[0] for r in rows})
    return spark.createDataFrame([(i, i % 7 == 3) for i in ids], DOCS), spark.createDataFrame(rows, CHUNKS)


def answers(rows):
    return sorted((r["anchor"], r["rank"], r["document_id"], round(r["score"], 9)) for r in rows.collect())


def same(spark, store, docs, chunks, ids, k):
    anchors = spark.createDataFrame([(i,) for i in ids], "document_id bigint")
    found = VectorIndex(store).nearest(docs, anchors, F.expr("not hidden"), k)
    assert answers(found.rows) == answers(retrieval.related(docs, chunks, anchors, F.expr("not hidden"), k))
    return found.scored.collect()


def test_neighbours_equal_the_scan_and_cells_are_passed_over(spark, tmp_path):
    docs, chunks = tables(spark, grouped(random.Random(5)))
    store = Store(spark, str(tmp_path))
    VectorIndex(store).update(chunks)
    scored = same(spark, store, docs, chunks, [0, 21, 100, 239, 999], 5)
    assert len(scored) == 4 and all(r["vectors"] == chunks.count() and 0 < r["scored"] < r["vectors"] / 3 for r in scored)
    assert VectorIndex(store).changed(chunks) == []


def test_structureless_vectors_ties_and_undefined_ones(spark, tmp_path):
    rng = random.Random(6)
    rows = [(i, 0, [rng.gauss(0, 1) for _ in range(8)]) for i in range(40)]
    rows += [(40 + i, 0, [1.0] * 8) for i in range(6)] + [(50, 0, [0.0] * 8), (51, 0, [float("nan")] * 8), (52, 0, [1.0, None] * 4), (53, 0, [1.0, 2.0]), (54, 0, None), (55, 0, [float("inf")] * 8)]
    docs, chunks = tables(spark, rows)
    store = Store(spark, str(tmp_path))
    VectorIndex(store).update(chunks)
    same(spark, store, docs, chunks, [0, 5, 40, 41], 4)  # equal scores: the smaller id
    same(spark, store, docs, chunks, [1, 50, 54], 60)  # more than there are, and an anchor without a direction


def test_updates_retire_what_changed(spark, tmp_path, monkeypatch):
    rng = random.Random(7)
    rows = grouped(rng, groups=5)
    docs, chunks = tables(spark, rows)
    store = Store(spark, str(tmp_path))
    VectorIndex(store).update(chunks)
    # some documents move to another group, some go, some come
    moved = [(d, o, rows[(d + 31) % len(rows)][2] if d % 20 == 0 else v) for d, o, v in rows if d % 17] + [(500 + i, 0, [0.1 * i] + [1.0] * 7) for i in range(5)]
    docs, chunks = tables(spark, moved)
    index = VectorIndex(store).update(chunks)
    assert index.n == len(moved) and index.n_retired > 0
    same(spark, store, docs, chunks, [1, 20, 40, 502], 6)
    monkeypatch.setattr(vector_index, "MOST_RETIRED", 0.0)
    docs, chunks = tables(spark, moved[:-3])
    index = VectorIndex(store).update(chunks)
    assert index.n_retired == 0 and len(index.folders[vector_index.TABLE]) == 1 and index.live().count() == len(moved) - 3
    same(spark, store, docs, chunks, [1, 20, 500], 6)


def test_empty_index(spark, tmp_path):
    docs, chunks = tables(spark, [(1, 0, [1.0, 0.0])])
    store = Store(spark, str(tmp_path))
    assert VectorIndex(store).update(chunks.limit(0)).n == 0
    assert same(spark, store, docs, chunks.limit(0), [1], 3) == []
    VectorIndex(store).update(chunks)
    same(spark, store, docs, chunks, [1], 3)
    assert VectorIndex(store).update(chunks.limit(0)).n == 0


def test_indexing_documents_keeps_the_index_of_vectors(spark, tmp_path):
    corpus = Corpus(spark, str(tmp_path))
    rng = random.Random(8)
    words = ["alder", "birch", "cedar", "elm", "fir", "larch", "oak", "pine"]

    def write(texts):
        rows = spark.createDataFrame(list(texts.items()), "id bigint, content string").withColumns({"source": F.lit("manual"), "status": F.lit("ok")})
        kept = [F.col(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema.DOCUMENTS]
        corpus._commit({"documents": rows.select(*kept)})
        corpus.index(HashEmbedder())

    def equal():
        for i in (1, 2):
            anchor = spark.createDataFrame([(i,)], "document_id bigint")
            scan = retrieval.related(corpus.documents(), corpus.chunks(), anchor, schema.searchable(), 4)
            assert answers(corpus.related(i, 4)) == answers(scan)
        plain = retrieval.two_hops(corpus.documents(), corpus.chunks(), 1, schema.searchable())
        assert [sorted(map(tuple, t.collect())) for t in corpus.graph(1)] == [sorted(map(tuple, t.collect())) for t in plain]

    texts = {i: " ".join(rng.choices(words, k=12)) for i in range(1, 25)}
    write(texts)
    assert corpus.vector_index().n == 24
    texts[2] = "birch and birch and birch"
    write(texts)
    assert corpus.vector_index().n == corpus.chunks().count() == 24 and corpus.vector_index().n_retired == 1
    equal()
