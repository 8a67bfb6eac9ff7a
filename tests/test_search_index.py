"""The stored full-text index, ranks and fusion: equal to plain search, to a rebuild, and to brute force."""

import datetime
import math
import random

import pytest
from pyspark.sql import functions as F

from corpusmill import schema
from corpusmill.api import Corpus
from corpusmill.models import HashEmbedder
from corpusmill.operators import fulltext, ranking, retrieval, text_index
from corpusmill.operators.text_index import TextIndex
from corpusmill.sources.store import Store

posted = text_index.posted
GONE = datetime.datetime(2026, 1, 1)
QUERIES = ("red fox", "the the Été", "bar_foo baz")


def corpus_rows(rng, n=60):
    words = ["the", "red", "fox", "foo", "bar", "baz", "rare", "été", "strasse", "straße"]
    rows = []
    for i in range(n):
        content = " ".join(rng.choices(words, weights=[9, 3, 3, 2, 2, 2, 1, 1, 1, 1], k=rng.randint(0, 30)))
        rows.append({"id": i, "title": rng.choice([None, "the foo", "bar"]), "content": content or None, "keywords": rng.choice([None, "foo", "bar, baz"]), "deleted_at": GONE if i % 9 == 0 else None, "status": "failed" if i % 7 == 0 else "ok"})
    return rows


def documents(spark, rows):
    base = {"source": "manual", "status": "ok"}
    full = [{**base, "source_ref": str(r["id"]), **r} for r in rows]
    return spark.createDataFrame([tuple(r.get(f.name) for f in schema.DOCUMENTS.fields) for r in full], schema.DOCUMENTS)


def scores(df):
    return {r["id"]: round(r["score"], 9) for r in df.collect()}


def same_results(index, docs):
    for words in QUERIES:
        assert scores(index.search(docs, words, schema.searchable())) == scores(fulltext.search(docs, words, schema.searchable())), words


def state(index):
    return sorted(map(tuple, index.postings().collect())), sorted((r["id"], r["len"], r["digest"]) for r in index.entries().collect()), (index.n, index.total)


def test_index_equals_plain_search_and_a_rebuild_after_updates(spark, tmp_path):
    rng = random.Random(6)
    rows = corpus_rows(rng)
    docs = documents(spark, rows)
    index = TextIndex(Store(spark, str(tmp_path / "a"))).update(docs)
    same_results(index, docs)
    assert index.changed(docs) == []
    # changed, removed, added, emptied, and changed in what is not indexed
    new = corpus_rows(rng)
    rows = [new[r["id"]] if r["id"] in (3, 4) else {**r, "deleted_at": None} if r["id"] == 9 else {**r, "content": None, "title": None, "keywords": None} if r["id"] == 5 else r for r in rows if r["id"] not in (10, 11)]
    rows.append({"id": 100, "content": "the rare red fox"})
    docs = documents(spark, rows)
    after = index.update(docs)
    assert len(after.folders[text_index.TABLE]) == 2 and after.n_retired == 5
    rebuilt = TextIndex(Store(spark, str(tmp_path / "b"))).update(docs)
    assert state(after) == state(rebuilt)
    same_results(after, docs)
    # a reader keeps what it opened
    assert index.n == 60 and index.entries().count() == 60
    # only changed documents are in the new segment
    fresh = after.store.read_parts(text_index.TABLE, after.folders[text_index.TABLE][1:], text_index.STORED)
    assert {r["id"] for r in fresh.select("id").distinct().collect()} == {3, 4, 5, 100}


def test_merged_segments_hold_the_live_rows(spark, tmp_path, monkeypatch):
    rng = random.Random(8)
    docs = documents(spark, corpus_rows(rng))
    index = TextIndex(Store(spark, str(tmp_path / "a"))).update(docs)
    docs = documents(spark, [{**r, "content": "all new words"} for r in corpus_rows(rng)[:40]])
    merged = index.update(docs)
    assert len(merged.folders[text_index.TABLE]) == 1 and merged.n_retired == 0
    assert state(merged) == state(TextIndex(Store(spark, str(tmp_path / "b"))).update(docs))
    monkeypatch.setattr(text_index, "MOST_SEGMENTS", 1)
    docs = docs.where("id > 0")
    merged = merged.update(docs)
    assert len(merged.folders[text_index.TABLE]) == 1 and merged.n == 39


def test_a_query_reads_the_buckets_of_its_terms(spark, tmp_path):
    index = TextIndex(Store(spark, str(tmp_path / "a"))).update(documents(spark, corpus_rows(random.Random(1))))
    plan = index.matching(["fox"])._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan and "PushedFilters" in plan and "places" not in plan.split("ReadSchema")[-1]
    files = index.matching(["fox"]).inputFiles()
    assert len({f.split("bucket=")[1].split("/")[0] for f in files}) <= index.buckets + 1
    read = index.matching(["fox"]).select(F.input_file_name().alias("f")).distinct().collect()
    assert len({r["f"].split("bucket=")[1].split("/")[0] for r in read}) == 1


def test_few_rows_are_dealt_out_for_many_postings(spark):
    docs = documents(spark, corpus_rows(random.Random(2))).coalesce(1)
    rows = text_index.posted(docs, 4)
    assert rows.count() <= 60 + 4
    plain = {(r["id"], r["term"], r["tf"]) for r in fulltext.postings(docs).collect()}
    found = text_index.single(rows.where("bucket >= 0").withColumn("segment", F.lit("a")), ["id", "tf", "places"])
    assert {(r["id"], r["term"], r["tf"]) for r in found.collect()} == plain
    assert found.where("size(places) <> tf").count() == 0


def test_the_first_segment_deals_out_no_text(spark, tmp_path, monkeypatch):
    joined = []
    monkeypatch.setattr(text_index, "posted", lambda docs, *more: joined.append("Join" in docs._jdf.queryExecution().optimizedPlan().toString()) or posted(docs, *more))
    index = TextIndex(Store(spark, str(tmp_path / "a"))).update(documents(spark, corpus_rows(random.Random(3))))
    index.update(documents(spark, corpus_rows(random.Random(4))))
    assert joined == [False, True]


def test_folding_equals_the_rule_for_every_character():
    import unicodedata

    rng = random.Random(4)
    marks = [chr(c) for c in range(0x300, 0x340)]
    for n in (1, 5, 40):
        for _ in range(200):
            text = "".join(rng.choice([chr(rng.randrange(0x20, 0xD7FF)), rng.choice("aéÅß"), rng.choice(marks[:n]), chr(rng.randrange(0x10000, 0x1F000))]) for _ in range(60))
            bare = "".join(c for c in unicodedata.normalize("NFD", text) if unicodedata.category(c) != "Mn")
            assert fulltext.fold_text(text) == unicodedata.normalize("NFC", bare).lower()


def test_empty_index_and_empty_documents(spark, tmp_path):
    empty = documents(spark, [{"id": 1}]).limit(0)
    index = TextIndex(Store(spark, str(tmp_path / "a")))
    assert index.search(empty, "fox", schema.searchable()).count() == 0
    index = index.update(empty)
    assert index.search(empty, "fox", schema.searchable()).count() == 0 and index.n == 0
    assert index.search(empty, '"" --', schema.searchable()).count() == 0
    one = documents(spark, [{"id": 1, "content": "fox"}, {"id": 2, "content": ""}])
    index = index.update(one)
    assert scores(index.search(one, "fox dog", schema.searchable())) == scores(fulltext.search(one, "fox dog", schema.searchable())) != {}
    assert index.update(empty).n == 0


def test_every_write_of_documents_keeps_the_index(spark, tmp_path):
    notes = tmp_path / "notes"
    notes.mkdir()
    for i in range(8):
        (notes / f"n{i}.md").write_text(f"# Note {i}\napples and pears {i}")
    corpus = Corpus(spark, str(tmp_path / "store"))
    corpus.sync_vault(str(notes))
    corpus.index(HashEmbedder())
    (notes / "n3.md").write_text("# Note 3\nzebra")
    (notes / "n4.md").unlink()
    corpus.sync_vault(str(notes))
    assert [r["title"] for r in corpus.search("zebra").collect()] == ["Note 3"]
    assert corpus.search("apples").count() == 6
    corpus.delete(corpus.documents().where("source_ref = 'n5.md'"))
    assert corpus.search("apples").count() == 5
    docs = corpus.documents()
    assert state(corpus.text_index()) == state(TextIndex(Store(spark, str(tmp_path / "b"))).update(docs))


def test_equal_scores_spread_over_tasks(spark):
    rows = [(i, 2.0 if i % 3 else None if i % 2 else float("nan")) for i in range(3000)]
    table = spark.createDataFrame(rows, "id bigint, score double").repartition(7)
    out = ranking.numbered(table, F.col("score"), "id", "rank")
    want = sorted(rows, key=lambda r: (-math.inf if r[1] == 2.0 else math.inf, r[0]))
    assert {r["id"]: r["rank"] for r in out.collect()} == {i: n for n, (i, _) in enumerate(want, start=1)}
    # the rows of each range of the sort, as written
    parts = [r["count"] for r in out.withColumn("part", F.col("rank")).groupBy(F.floor((F.col("rank") - 1) / 750)).count().collect()]
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = table.withColumn("s", ranking.sortable(F.col("score"))).repartitionByRange(ranges, F.desc("s"), F.asc("id")).groupBy(F.spark_partition_id()).count().collect()
    assert sum(parts) == 3000 and max(r["count"] for r in dealt) < 2 * 3000 / ranges


def test_places_of_some_rows(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice([0.5, 0.25, 1e-6, float("nan"), None, -1.0])) for i in range(500)]
    table = spark.createDataFrame(rows, "id bigint, score double")
    value = lambda s: -math.inf if s is None or math.isnan(s) else s
    order = sorted(rows, key=lambda r: (-value(r[1]), r[0]))
    want = {i: n for n, (i, _) in enumerate(order, start=1)}
    for some in (rows[:1], rows[:64], rows[::3], rows):
        assert ranking.places(table, "score", "id", [(value(s), i) for i, s in some]) == {i: want[i] for i, _ in some}
    assert ranking.places(table, "score", "id", []) == {}
    assert ranking.head(table, "score", "id", 40) == [(value(s), i) for i, s in order[:40]]


@pytest.mark.parametrize("sizes", [(700, 900), (5, 900), (700, 0), (0, 3)])
def test_fusion_from_heads_equals_ranking_everything(spark, sizes):
    rng = random.Random(sum(sizes))
    lists = [[(i, rng.choice([1.0, 0.5, rng.random()])) for i in rng.sample(range(1200), n)] for n in sizes]
    lexical = spark.createDataFrame(lists[0], "document_id bigint, score double")
    vector = spark.createDataFrame(lists[1], "document_id bigint, sim double")
    ranks = [{i: n for n, (i, _) in enumerate(sorted(rows, key=lambda r: (-r[1], r[0])), start=1)} for rows in lists]
    whole = [(i, sum(1 / (60 + r[i]) for r in ranks if i in r), ranks[0].get(i), ranks[1].get(i)) for i in {*ranks[0], *ranks[1]}]
    whole.sort(key=lambda f: (-f[1], f[0]))
    for limit in (0, 1, 20):
        assert retrieval.fused_top(lexical, vector, limit) == whole[:limit]


def brute_window(texts, phrases, most=12):
    best = None
    for field, text in enumerate(texts):
        found = list(fulltext._token.finditer(text or ""))
        terms = [fulltext.fold_text(m.group()) for m in found]
        for start in range(len(found)):
            window = terms[start : start + most]
            inside = [sum(window[i : i + len(p)] == p for i in range(len(window) - len(p) + 1)) for p in phrases]
            rank = (-sum(n > 0 for n in inside), -sum(inside), field, start)
            if best is None or rank < best[0]:
                end = min(start + most, len(found)) - 1
                best = (rank, ("…" if start else "") + text[found[start].start() : found[end].end()] + ("…" if end + 1 < len(found) else ""))
    return best[1] if best else ""


def test_best_window_equals_trying_all(spark):
    rng = random.Random(9)
    words = ["été", "fox", "the", "x_y", "a", "b", "c", "d", "Eté"]
    for _ in range(400):
        texts = [" ".join(rng.choices(words, k=rng.randint(0, 40))) + rng.choice(["", ".", " !"]) if rng.random() < 0.8 else None for _ in range(4)]
        query = rng.choice(["fox", "fox the", "x_y a", "Été b b", "zzz"])
        phrases = [list(p) for p in dict.fromkeys(map(tuple, fulltext.query_phrases(query)))]
        assert fulltext.best_window(texts, phrases) == brute_window(texts, phrases)
    docs = documents(spark, [{"id": 1, "url": "u", "title": "long way", "content": "w " * 30 + "red fox jumps" + " w" * 30}, {"id": 2, "content": "red only"}])
    none = spark.createDataFrame([], schema.CHUNKS)
    hit = retrieval.hybrid_search(docs, none, "red fox", None, schema.searchable(), 5).first()
    assert hit["url"] == "u" and hit["snippet"] == "…" + "w " * 10 + "red fox…"
