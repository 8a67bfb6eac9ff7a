"""The store object, notes, retrieval, incremental runs and the stream, on small cases."""

import json
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from corpusmill import schema
from corpusmill.api import Corpus
from corpusmill.models import HashEmbedder
from corpusmill.operators import fulltext, retrieval, sync
from corpusmill.sources import vault
from corpusmill.sources.store import Store
from corpusmill.streaming import messages


def documents(spark, rows):
    base = {"source": "manual", "status": "ok", "content": "content"}
    full = [{**base, "source_ref": str(r["id"]), **r} for r in rows]
    return spark.createDataFrame([tuple(r.get(f.name) for f in schema.DOCUMENTS.fields) for r in full], schema.DOCUMENTS)


def chunks(spark, rows):
    return spark.createDataFrame([(i, d, o, t, len(t), v) for i, (d, o, t, v) in enumerate(rows)], schema.CHUNKS)


def test_search_prefers_all_terms_and_hides_deleted(spark):
    import datetime

    gone = datetime.datetime(2026, 1, 1)
    docs = documents(spark, [{"id": 1, "content": "red fox"}, {"id": 2, "content": "red"}, {"id": 3, "content": "red fox", "deleted_at": gone}, {"id": 4, "content": "red fox", "status": "failed"}])
    assert [r["id"] for r in fulltext.search(docs, "red fox", schema.searchable()).collect()] == [1]
    assert sorted(r["id"] for r in fulltext.search(docs, "red cat", schema.searchable()).collect()) == [1, 2]
    assert fulltext.search(docs, '"" --', schema.searchable()).count() == 0


def test_hidden_rows_take_part_in_statistics(spark):
    import datetime

    rows = [{"id": i, "content": "plain text" if i > 2 else "rare word"} for i in range(1, 9)]
    score = lambda r: fulltext.search(documents(spark, r), "rare", schema.searchable()).where("id = 1").first()["score"]
    before = score(rows)
    hidden = [{**r, "deleted_at": datetime.datetime(2026, 1, 1)} if r["id"] > 6 else r for r in rows]
    assert score(hidden) == pytest.approx(before)
    assert score(rows[:6]) != pytest.approx(before)


def test_underscore_terms_are_phrases(spark):
    docs = documents(spark, [{"id": 1, "content": "foo bar"}, {"id": 2, "content": "bar foo"}])
    assert [r["id"] for r in fulltext.search(docs, "foo_bar", schema.searchable()).collect()] == [1]


def test_fusion_and_snippet(spark):
    docs = documents(spark, [{"id": 1, "content": "apple pie"}, {"id": 2, "content": "apple"}, {"id": 3, "content": "pear"}])
    held = chunks(spark, [(1, 0, "first chunk", [0.0, 1.0]), (1, 1, "best chunk", [0.9, 0.1]), (3, 0, "pear chunk", [1.0, 0.0])])
    hits = retrieval.hybrid_search(docs, held, "apple", [1.0, 0.0], schema.searchable(), 10).collect()
    by_id = {r["document_id"]: r for r in hits}
    assert by_id[1]["score"] == pytest.approx(1 / (60 + by_id[1]["fts_rank"]) + 1 / 62)
    assert by_id[1]["snippet"] == "best chunk" and by_id[3]["fts_rank"] is None and by_id[2]["vector_rank"] is None
    assert retrieval.hybrid_search(docs, held, "...", [1.0, 0.0], schema.searchable(), 10).count() == 0
    assert retrieval.hybrid_search(docs, held, "apple", None, schema.searchable(), 0).count() == 0
    with pytest.raises(ValueError):
        retrieval.hybrid_search(docs, held, "apple", None, schema.searchable(), -1)


def test_graph_of_an_anchor_without_vectors_is_empty(spark):
    docs = documents(spark, [{"id": 1}, {"id": 2}])
    nodes, edges = retrieval.two_hops(docs, chunks(spark, [(2, 0, "x", [1.0, 0.0])]), 1, schema.searchable())
    assert nodes.count() == 0 and edges.count() == 0


def test_notes():
    assert vault.parse_frontmatter("a: b\nl:\n- x\n- y\ni: [p, q ]\n") == {"a": "b", "l": ["x", "y"], "i": ["p", "q"]}
    assert vault.parse_frontmatter("- stray\n") == {"raw": "- stray\n"}
    assert vault.split_frontmatter("---\nnever closed\n") == (None, "---\nnever closed\n")
    title, body, meta, found = vault.parse_note("﻿---\nu: https://b.c/d\n---\n# T\nhttps://a.b/c. https://b.c/d".encode(), "x/n.md")
    assert (title, found) == ("T", ["https://b.c/d", "https://a.b/c"]) and json.loads(meta) == {"u": "https://b.c/d"}
    assert vault.note_title({}, "# \nx", "stem") == "" and vault.note_title({"title": " "}, "x", "stem") == "stem"


def test_corpus_from_notes_to_search(spark, tmp_path):
    notes = tmp_path / "notes"
    (notes / "wiki").mkdir(parents=True)
    (notes / "a.md").write_text("# Apples\napples are red fruit")
    (notes / "b.md").write_text("# Birds\nbirds can fly")
    (notes / "wiki" / "c.md").write_text("left out")
    (notes / "wikipedia.md").write_text("kept by name")
    corpus = Corpus(spark, str(tmp_path / "store"), schema.Config(vault_exclude=("wiki",)))
    assert {r["outcome"]: r["n"] for r in corpus.sync_vault(str(notes)).collect()} == {"insert": 3}
    assert {r["outcome"]: r["n"] for r in corpus.index(HashEmbedder()).collect()} == {"process": 3}
    assert {r["outcome"]: r["n"] for r in corpus.index(HashEmbedder()).collect()} == {"skip": 3}
    top = corpus.search("apples", HashEmbedder()).first()
    assert top["title"] == "Apples"
    (notes / "a.md").write_text("# Apples\napples changed")
    (notes / "b.md").unlink()
    assert {r["outcome"]: r["n"] for r in corpus.sync_vault(str(notes)).collect()} == {"update": 1, "purge": 1, "noop": 1}
    corpus.delete(corpus.documents().where("source_ref = 'a.md'"))
    assert {r["outcome"]: r["n"] for r in corpus.sync_vault(str(notes)).collect()} == {"respect_tombstone": 1, "noop": 1}
    assert [r["title"] for r in corpus.page(1).collect()] == ["wikipedia"]
    corpus.add_set("kind", "what it is", {"type": "object", "properties": {"n": {"type": "integer"}}})
    with pytest.raises(ValueError):
        corpus.add_set("kind", "again", {"type": "object", "properties": {"n": {}}})
    assert corpus.remove_set("kind") == 0


# the stand-ins below go to the workers by value, as tests are not on their path
cloudpickle.register_pickle_by_value(sys.modules[__name__])


class Refusing(HashEmbedder):
    """An embedder that refuses texts with a word, and writes down every call."""

    def __init__(self, word, log):
        super().__init__()
        self.word, self.log = word, log

    def embed(self, texts):
        with open(self.log, "a") as out:
            out.write(f"{len(texts)}\n")
        if any(self.word in t for t in texts):
            raise RuntimeError(f"no {self.word}")
        return super().embed(texts)


def test_a_failed_embedding_keeps_the_chunks_and_is_counted(spark, tmp_path):
    notes = tmp_path / "notes"
    notes.mkdir()
    (notes / "a.md").write_text("# A\napples")
    (notes / "b.md").write_text("# B\nbirds")
    corpus = Corpus(spark, str(tmp_path / "store"))
    corpus.sync_vault(str(notes))
    corpus.index(HashEmbedder())
    before = {r["document_id"]: r["text"] for r in corpus.chunks().collect()}
    (notes / "a.md").write_text("# A\npoison apples")
    (notes / "b.md").write_text("# B\nbirds fly")
    corpus.sync_vault(str(notes))
    log = tmp_path / "calls"
    assert {r["outcome"]: r["n"] for r in corpus.index(Refusing("poison", str(log))).collect()} == {"process": 1, "failed": 1}
    after = {r["document_id"]: r["text"] for r in corpus.chunks().collect()}
    bad = next(i for i, t in before.items() if "apples" in t)
    assert after[bad] == before[bad] and "fly" in after[next(i for i in before if i != bad)]
    assert len(log.read_text().split()) <= 3  # one call of both, or one of each, and at most one again of each
    assert {r["outcome"]: r["n"] for r in corpus.index(HashEmbedder()).collect()} == {"process": 1, "skip": 1}
    assert "poison" in {r["document_id"]: r["text"] for r in corpus.chunks().collect()}[bad]


class Sorting:
    """Enricher and extractor that know one set, invent another, and refuse a word."""

    def enrich(self, body, sets):
        if "poison" in body:
            raise RuntimeError("refused")
        return {"summary": body[:5], "keywords": ["Keywords: a, b"], "sets": [n for n, _ in sets if "recipe" in body] + ["invented"]}

    def extract(self, body, declared):
        if "burnt" in body:
            raise RuntimeError("burnt")
        return {"minutes": 5 if "5" in body else None, "other": 1}


def test_enrich_and_extract_from_notes_to_records(spark, tmp_path):
    notes = tmp_path / "notes"
    notes.mkdir()
    for name, body in (("a", "recipe of 5 minutes"), ("b", "recipe without time"), ("c", "recipe burnt"), ("d", "letter"), ("e", "poison recipe")):
        (notes / f"{name}.md").write_text(body)
    corpus = Corpus(spark, str(tmp_path / "store"))
    corpus.sync_vault(str(notes))
    corpus.add_set("recipe", "food", {"type": "object", "properties": {"minutes": {"type": "integer"}}, "required": ["minutes"]})
    assert {r["outcome"]: r["n"] for r in corpus.enrich(Sorting()).collect()} == {"process": 4, "failed": 1, "insert": 3}
    docs = {r["source_ref"]: r for r in corpus.documents().collect()}
    assert (docs["a.md"]["summary"], docs["a.md"]["keywords"]) == ("recip", "a, b") and docs["e.md"]["enriched_hash"] is None
    assert {r["outcome"]: r["n"] for r in corpus.enrich(Sorting()).collect()} == {"skip": 4, "failed": 1}
    assert {r["outcome"]: r["n"] for r in corpus.extract(Sorting(), "recipe").collect()} == {"ok": 1, "partial": 1, "failed": 1}
    state = {r["document_id"]: r for r in corpus.memberships().collect()}
    row = state[docs["a.md"]["id"]]
    assert (json.loads(row["extracted_json"]), row["missing_fields"], row["error"]) == ({"minutes": 5}, [], None)
    assert state[docs["b.md"]["id"]]["missing_fields"] == ["minutes"] and state[docs["c.md"]["id"]]["error"] == "burnt"
    assert {r["outcome"]: r["n"] for r in corpus.extract(Sorting()).collect()} == {"failed": 1}
    # a changed note that leaves the set loses its record, one that stays keeps it
    (notes / "a.md").write_text("recipe of 5 minutes, again")
    (notes / "b.md").write_text("no longer one")
    corpus.sync_vault(str(notes))
    assert {r["outcome"]: r["n"] for r in corpus.enrich(Sorting()).collect()} == {"process": 2, "failed": 1, "skip": 2, "delete": 1}
    state = {r["document_id"]: r for r in corpus.memberships().collect()}
    assert docs["b.md"]["id"] not in state and json.loads(state[docs["a.md"]["id"]]["extracted_json"]) == {"minutes": 5}
    corpus.update_set("recipe", "cooking", {"type": "object", "properties": {"n": {"type": "integer"}}})
    assert corpus.sets().first()["description"] == "cooking" and len(state) == corpus.memberships().count()
    (notes / "a.md").unlink()
    corpus.sync_vault(str(notes))
    assert docs["a.md"]["id"] not in {r["document_id"] for r in corpus.memberships().collect()}
    for change in (lambda: corpus.remove_set("none"), lambda: corpus.update_set("none", "x", {"type": "object", "properties": {"n": {}}})):
        with pytest.raises(KeyError):
            change()
    assert corpus.remove_set("recipe") == 1


def test_a_change_of_several_tables_is_one_commit(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    rows = spark.createDataFrame([("a",)], "message_id string")
    store.commit({"t": rows, "u": rows})
    bad = rows.withColumn("message_id", F.raise_error(F.lit("stop")).cast("string"))
    with pytest.raises(Exception, match="stop"):
        store.commit({"t": rows.unionByName(rows), "u": bad})
    assert [store.read(t, schema.REACTIONS).count() for t in "tu"] == [1, 1]


def test_store_adds_missing_columns(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    assert store.read("t", schema.REACTIONS).count() == 0
    store.write("t", spark.createDataFrame([("a",)], "message_id string"))
    assert store.read("t", schema.REACTIONS).collect()[0]["reacted_at"] is None


def test_upsert_loses_content_of_a_failed_refetch(spark):
    docs = documents(spark, [{"id": 1, "title": "old", "extra": {"k": "v"}}])
    incoming = spark.createDataFrame([("manual", "1", None, None, None, None, None, "failed", "HTTP 500")], "source string, source_ref string, url string, parent_document_id bigint, title string, author string, content string, status string, error string")
    row = sync.upserted(docs, incoming, F.current_timestamp()).first()
    assert (row["title"], row["content"], row["status"], row["extra"]) == (None, None, "failed", {"k": "v"})


def test_stream_stores_what_the_batch_plan_stores(spark, tmp_path):
    landed = tmp_path / "landed"
    landed.mkdir()
    items = [{"id": f"m{i}", "text": f"look https://a.b/{i % 5} and https://c.d/x", "timestamp": f"2026-01-{1 + i % 9:02d}T00:00:00Z", "senderName": "s"} for i in range(20)]
    for i in range(0, 20, 5):
        (landed / f"{i}.json").write_text("\n".join(map(json.dumps, items[i : i + 5] + items[:2])))
    run = messages.start(messages.link_stream(messages.raw_stream(spark, str(landed), 1)), str(tmp_path / "out"), str(tmp_path / "check"))
    run.awaitTermination(120)
    streamed = spark.read.parquet(str(tmp_path / "out")).drop("batch")
    batch = sync.message_links(sync.parsed_messages(spark.read.schema(messages.RAW).json(str(landed)))).dropDuplicates(["message_id", "url"])
    assert streamed.count() == batch.count() == 40
    assert streamed.select(*batch.columns).exceptAll(batch).count() == 0


def test_set_schemas():
    kind = schema.struct_of({"properties": {"a": {"type": ["null", "integer"]}, "b": {"type": "array", "items": {"type": "string"}}, "c": {}}})
    assert kind.simpleString() == "struct<a:bigint,b:array<string>,c:string>"
    with pytest.raises(ValueError):
        schema.check_set("n", " ", {"type": "object", "properties": {"a": {}}})
