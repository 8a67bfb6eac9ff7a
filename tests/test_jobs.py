"""Jobs on the store: chat source and stream, links with cache, journal and budget, retries, logs, payloads."""

import json
import os
import sys
from datetime import UTC, datetime, timedelta

import chat_pages
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from corpusmill import schema
from corpusmill.api import Corpus
from corpusmill.operators import ingest, sync
from corpusmill.sources import chat, extraction, fetching
from corpusmill.sources.fetching import Journal
from corpusmill.streaming import messages

cloudpickle.register_pickle_by_value(sys.modules[__name__])
cloudpickle.register_pickle_by_value(chat_pages)
START = datetime(2026, 1, 1, tzinfo=UTC)


class Web:
    """Answers from a table, writes down every call, and fails a task once after some calls."""

    def __init__(self, folder, answers=None, fail_at=None):
        self.folder, self.answers, self.fail_at = str(folder), answers or {}, fail_at
        os.makedirs(self.folder, exist_ok=True)

    def calls(self):
        return sorted(open(os.path.join(self.folder, n)).read() for n in os.listdir(self.folder) if n.startswith("call"))

    def __call__(self, url):
        with open(os.path.join(self.folder, f"call{len(os.listdir(self.folder)):05d}-{os.getpid()}"), "w") as file:
            file.write(url)
        if self.fail_at == url and not os.path.exists(os.path.join(self.folder, "failed")):
            open(os.path.join(self.folder, "failed"), "w").close()
            os._exit(1)  # the worker dies with the result in its hands
        answer = self.answers.get(url, f"<title>t</title><p>{url}</p>")
        if isinstance(answer, Exception):
            raise answer
        return (answer[0], "ok", None, None, None) if isinstance(answer, tuple) else (url, "ok", answer, "text/html", None)


def corpus_at(spark, path, **config):
    return Corpus(spark, str(path), schema.Config(full_text=False, vector_index=False, **config))


def items(rows):
    return [{"id": i, "text": t, "timestamp": (START + timedelta(hours=h)).isoformat(), "senderName": "s"} for i, t, h in rows]


def raw(spark, rows):
    return spark.createDataFrame([(r["id"], r["text"], r["timestamp"], r["senderName"]) for r in items(rows)], messages.RAW)


@pytest.fixture
def service(spark, tmp_path):
    folder = tmp_path / "chat"
    folder.mkdir()
    where = str(folder)
    chat.register(spark, lambda: chat_pages.FolderChat(where))
    long = items([(f"m{n}", f"text {n} https://a.b/{n}", n) for n in range(95)])[::-1]
    odd = [{"id": None, "text": "no id", "timestamp": "2026-01-01T00:00:00Z"}, {"id": "x", "text": "", "timestamp": "2026-01-01T00:00:00Z"}, {"id": "y", "text": "bad time", "timestamp": "never"}, {"id": 5, "text": "number", "timestamp": "2026-01-01T00:00:00Z"}]
    (folder / "long.json").write_text(json.dumps(long[:30] + odd + long[30:]))
    (folder / "short.json").write_text(json.dumps(items([("s1", "one", 5)])))
    (folder / "broken.json").write_text(json.dumps(long))
    return folder


def reader(spark, folder, chats, **options):
    return spark.read.format("chat").options(chats=json.dumps(chats), **options).load()


def test_chat_source_pages_back_and_stops_at_the_day(spark, service):
    every = reader(spark, service, ["long", "short"])
    out = every.collect()
    assert {(r["chat"], r["message_id"]) for r in out} == {("long", f"m{n}") for n in range(95)} | {("short", "s1")}
    assert chat_pages.asked(service, "long") == 10
    # the rows that the batch plan parses from the same items
    items_ = spark.createDataFrame([(i.get("id") if isinstance(i.get("id"), str) else None, i["text"], i["timestamp"], i.get("senderName")) for i in json.loads((service / "long.json").read_text())], messages.RAW)
    want = sync.parsed_messages(items_)
    got = every.where("chat = 'long'").select("message_id", "text", "ts", "sender")
    assert got.exceptAll(want).count() == 0 == want.exceptAll(got).count()
    # a bound on the time ends the walk, a chosen chat leaves the other one alone
    before = chat_pages.asked(service, "long"), chat_pages.asked(service, "short")
    late = every.where((F.col("ts") >= F.lit(START + timedelta(hours=80))) & (F.col("chat") == "long"))
    assert late.count() == 15
    assert chat_pages.asked(service, "long") - before[0] == 2 and chat_pages.asked(service, "short") == before[1]
    assert reader(spark, service, ["long"], since="2026-01-04").count() == 23
    # announced pages without a cursor, and the cap on pages
    assert reader(spark, service, ["broken"]).count() == 10
    assert reader(spark, service, ["long"], pages="3").count() == 30
    assert reader(spark, service, []).count() == 0


def test_chat_stream_goes_on_where_it_was(spark, service, tmp_path):
    web = Web(tmp_path / "web")
    corpus = corpus_at(spark, tmp_path / "store", max_fetches_per_run=500)

    def run():
        stream = spark.readStream.format("chat").options(chats=json.dumps(["long", "short"])).load()
        messages.start_sync(chat.as_items(stream), corpus, web, str(tmp_path / "check")).awaitTermination(180)

    run()
    assert corpus.documents().count() == 95
    held = json.loads((service / "long.json").read_text())
    new = items([(f"n{n}", f"new https://a.b/{n} https://c.d/{n}", 200 + n) for n in range(3)])[::-1]
    (service / "long.json").write_text(json.dumps(new + held))
    pages, calls = chat_pages.asked(service, "long"), len(web.calls())
    run()
    assert corpus.documents().count() == 101 and len(web.calls()) == calls + 3  # a.b/0 to 2 were in the cache
    assert chat_pages.asked(service, "long") - pages <= 4  # one page for the offset, and the first ones for the rows
    run()
    assert corpus.documents().count() == 101


def test_chat_budget_replay_and_reactions(spark, tmp_path):
    web = Web(tmp_path / "web", {"https://a.b/3": ValueError("HTTP 404")})
    corpus = corpus_at(spark, tmp_path / "store", max_fetches_per_run=3)
    rows = [("m1", "old https://a.b/1 https://a.b/1", 1), ("m2", "see https://a.b/2. and https://a.b/3", 2), ("m3", "none", 3), ("m4", "https://a.b/2", 4)]
    made = []

    def report(df):
        return {r["outcome"]: r["n"] for r in df.collect()}

    react = tmp_path / "reacted"

    def reacted(message):
        with open(react, "a") as file:
            file.write(message + "\n")
        return message != "m2" or react.read_text().count("m2") > 1

    first = report(corpus.sync_chat(raw(spark, rows), web, reacted, stream="c", batch=0))
    assert first == {"fetched": 3, "failed": 1, "reacted": 2, "reaction_failed": 1}
    state = {r["source_ref"]: r for r in corpus.documents().collect()}
    assert state["m2#https://a.b/3"]["status"] == "failed" and state["m2#https://a.b/3"]["error"] == "HTTP 404"
    assert state["m2#https://a.b/2"]["message_text"] == "see and" and state["m4#https://a.b/2"]["message_text"] is None
    assert web.calls() == ["https://a.b/1", "https://a.b/2", "https://a.b/3"]
    # the batch comes again: nothing changes but the reaction that failed
    before = sorted(map(str, corpus.documents().collect()))
    assert report(corpus.sync_chat(raw(spark, rows), web, reacted, stream="c", batch=0)) == {"repeated_batch": 1, "reacted": 1}
    assert sorted(map(str, corpus.documents().collect())) == before and len(web.calls()) == 3
    assert corpus.store.read("signal_reactions", schema.REACTIONS).count() == 3 and not made
    # a new batch beyond the budget leaves a placeholder; a deleted document stays deleted
    corpus.delete(corpus.documents().where("source_ref = 'm4#https://a.b/2'"))
    more = [("m4", "https://a.b/2", 4), *[(f"k{n}", f"https://k.k/{n}", 10 + n) for n in range(5)]]
    assert report(corpus.sync_chat(raw(spark, more), web, stream="c", batch=1)) == {"fetched": 3, "skipped": 2, "tombstoned": 1}
    waiting = {r["source_ref"] for r in corpus.documents().where("status = 'pending'").collect()}
    assert waiting == {"k0#https://k.k/0", "k1#https://k.k/1"}  # the oldest ones
    # a retry forgets the failure, and takes up what waits
    web.answers = {}
    healed = corpus_at(spark, tmp_path / "store", max_fetches_per_run=10)
    assert report(healed.retry_fetches(Web(tmp_path / "web"))) == {"fetched": 3}
    assert healed.documents().where("status <> 'ok'").count() == 0 and healed.fetch_cache().where("status = 'failed'").count() == 0
    assert {(r["job"], r["outcome"]): r["n"] for r in healed.run_log().where("job = 'retry_fetches'").collect()} == {("retry_fetches", "fetched"): 3}


def test_a_lost_task_pays_for_no_url_twice(spark, tmp_path):
    urls = spark.createDataFrame([(f"https://a.b/{n}",) for n in range(12)], "url string").repartition(3)
    web = Web(tmp_path / "web", {"https://a.b/5": ValueError("HTTP 500")}, fail_at="https://a.b/7")
    journal = Journal(str(tmp_path / "journal"))
    # a local session does not try a failed task again, so the job itself is run again, as a lost driver would have it
    with pytest.raises(Exception, match="(?i)worker|crash|EOF"):
        fetching.fetched(urls, web, journal).collect()
    out = {r["url"]: r for r in fetching.fetched(urls, web, journal).collect()}
    assert len(web.calls()) == len(set(web.calls())) == 12
    assert out["https://a.b/7"]["error"] == "interrupted" and out["https://a.b/5"]["error"] == "HTTP 500"
    assert sum(r["status"] == "ok" for r in out.values()) == 10 and all(r["fetched_at"] for r in out.values())
    journal.clear()
    assert journal.result(out["https://a.b/1"]["key"]) is None
    (tmp_path / "journal" / "ab").mkdir(parents=True)
    (tmp_path / "journal" / "ab" / "abc.json").write_text("[broken")
    assert journal.result("abc") is None


def test_short_links_and_payloads(spark, tmp_path):
    answers = {
        "https://bit.ly/1": ("https://t.co/2",), "https://t.co/2": ("https://www.youtube.com/watch?v=1",), "https://t.co/loop": ("https://t.co/loop",),
        "https://www.youtube.com/oembed?url=https%3A%2F%2Fwww.youtube.com%2Fwatch%3Fv%3D1&format=json": '{"title": "clip", "author_name": "who", "author_url": "u"}',
        "https://vm.tiktok.com/z": ("https://www.tiktok.com/@u/video/1?_r=1",),
        "https://www.tiktok.com/oembed?url=https%3A%2F%2Fwww.tiktok.com%2F%40u%2Fvideo%2F1": '{"title": "dance", "author_name": 5, "author_url": "https://t/u"}',
        "https://api.fxtwitter.com/a/status/1": '<p>{"tweet": {"text": "hello", "author": {"screen_name": "me"}}}</p>',
        "https://api.fxtwitter.com/a/status/2": '{"tweet": {"text": "hello"}}', "https://api.fxtwitter.com/a/status/3": "nothing",
    }
    web = Web(tmp_path / "web", answers)
    urls = ["https://bit.ly/1", "https://t.co/loop", "https://vm.tiktok.com/z", "https://x.com/a/status/1", "https://x.com/a/status/2", "https://x.com/a/status/3", "https://plain.example/"]
    links = spark.createDataFrame([(n, "manual", u, u, None, None) for n, u in enumerate(urls)], "position bigint, source string, source_ref string, url string, parent_document_id bigint, message_text string")
    current = spark.createDataFrame([], schema.DOCUMENTS)
    done = ingest.ingested(links, current, ingest.empty_cache(current), 100, web)
    rows = {r["url"]: r for r in done.rows.collect()}
    assert (rows["https://bit.ly/1"]["title"], rows["https://bit.ly/1"]["author"], rows["https://bit.ly/1"]["content"]) == ("clip", "who", None)
    assert "redirect loop" in rows["https://t.co/loop"]["error"]
    tiktok = rows["https://vm.tiktok.com/z"]
    assert (tiktok["title"], tiktok["content"], tiktok["author"], tiktok["extra"]) == ("dance", "dance", None, {"author_url": "https://t/u"})
    assert (rows["https://x.com/a/status/1"]["author"], rows["https://x.com/a/status/1"]["content"]) == ("me", "hello")
    assert all(rows[f"https://x.com/a/status/{n}"]["status"] == "failed" for n in (2, 3))
    assert rows["https://plain.example/"]["title"] == "t" and rows["https://plain.example/"]["error"] is None
    assert len(web.calls()) == len(set(web.calls()))


def test_notes_and_their_links_as_one_change(spark, tmp_path):
    notes = tmp_path / "notes"
    notes.mkdir()
    (notes / "a.md").write_text("# A\nhttps://a.b/1 https://a.b/2")
    (notes / "b.md").write_text("# B\nhttps://a.b/2 https://a.b/3 https://a.b/4")
    corpus = corpus_at(spark, tmp_path / "store", max_fetches_per_run=3)
    web = Web(tmp_path / "web", {"https://a.b/3": ValueError("HTTP 500")})
    report = {r["outcome"]: r["n"] for r in corpus.sync_vault(str(notes), web).collect()}
    assert report == {"insert": 2, "url_fetched": 3, "url_failed": 1, "url_skipped": 1}
    docs = {r["source_ref"]: r for r in corpus.documents().collect()}
    assert docs["b.md#https://a.b/2"]["parent_document_id"] == docs["b.md"]["id"] and docs["b.md#https://a.b/4"]["status"] == "pending"
    assert len({r["id"] for r in docs.values()}) == len(docs) == 7
    (notes / "a.md").write_text("# A\nhttps://a.b/2")
    (notes / "b.md").unlink()
    report = {r["outcome"]: r["n"] for r in corpus.sync_vault(str(notes), web).collect()}
    assert report == {"update": 1, "purge": 1, "url_cached": 1, "url_removed": 1}
    assert sorted(r["source_ref"] for r in corpus.documents().collect()) == ["a.md", "a.md#https://a.b/2"]
    corpus.delete(corpus.documents().where("source_ref = 'a.md'"))
    assert {r["outcome"]: r["n"] for r in corpus.sync_vault(str(notes), web).collect()} == {"respect_tombstone": 1}


def test_urls_by_hand_are_logged_in_the_same_commit(spark, tmp_path):
    corpus = corpus_at(spark, tmp_path / "store")
    web = Web(tmp_path / "web")
    asked = spark.createDataFrame([("https://a.b/1",), ("https://a.b/2",)], "url string")
    assert {r["outcome"]: r["n"] for r in corpus.ingest_urls(asked, web, "mcp").collect()} == {"fetched": 2}
    corpus.delete(corpus.documents().where("url = 'https://a.b/1'"))
    corpus.ingest_urls(asked.limit(1), web, "mcp")
    log = corpus.store.read("ingest_log", schema.INGEST_LOG).collect()
    assert sorted(r["url"] for r in log) == ["https://a.b/1", "https://a.b/1", "https://a.b/2"] and len({r["id"] for r in log}) == 3
    gone = corpus.documents().where("url = 'https://a.b/1'").first()
    assert gone["deleted_at"] is not None and gone["status"] == "ok" and gone["source"] == "mcp"
    with pytest.raises(ValueError):
        corpus.ingest_urls(asked, web, "nobody")


def test_shredding_without_rows_and_failures(spark):
    rows = spark.createDataFrame([("u", "generic", "failed", None, None), ("v", "x", "ok", None, None), ("w", "youtube", "ok", "[1]", None)], "url string, kind string, status string, body string, error string")
    out = {r["url"]: r["error"] for r in extraction.shredded(rows).collect()}
    assert out == {"u": "fetch failed", "v": "fetch failed", "w": "malformed oEmbed response"}
    assert extraction.shredded(rows.limit(0)).count() == 0
