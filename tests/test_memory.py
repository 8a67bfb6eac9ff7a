"""What tasks hold and what runs write: bounded slices of texts, and no text beside the tables themselves."""

import pyarrow as pa
from pyspark.sql import types as T

from corpusmill import api, models
from corpusmill.functions import text
from corpusmill.models import FirstWords, HashEmbedder
from corpusmill.operators import status


class Rows:
    """Stands in for a table and keeps the function that is mapped over it."""

    def __init__(self, **kinds):
        self.schema = T.StructType([T.StructField(name, kind) for name, kind in kinds.items()])

    def select(self, *_):
        return self

    def mapInArrow(self, run, _):
        self.run = run


def test_tasks_hold_and_give_out_slices_of_a_batch(spark):
    texts = [None if i % 50 == 0 else f"text {i}. " * (i % 7) for i in range(1000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(1000), pa.int64()), pa.array(texts, pa.string())], ["id", "text"])
    docs = Rows(id=T.LongType(), text=T.StringType())
    text.chunked(docs, "text", 20, 5)
    found = list(docs.run(iter([batch])))
    want = [(i, n, piece) for i, t in enumerate(texts) for n, piece in enumerate(text.chunk_text(t, 20, 5))]
    assert [tuple(r.values()) for b in found for r in b.to_pylist()] == want
    assert len(found) == -(-1000 // text.SLICE)

    class Refuses:
        def embed(self, part):
            if any(t is None for t in part):
                raise ValueError("no text")
            return [[len(t), 0.5] for t in part]

    models.embedded(docs, Refuses())
    found = list(docs.run(iter([batch])))
    assert max(b.num_rows for b in found) == models.SLICE
    assert [tuple(r.values()) for b in found for r in b.to_pylist()] == [(i, t, None if t is None else [float(len(t)), 0.5], "no text" if t is None else None) for i, t in enumerate(texts)]


def test_runs_write_no_text_beside_chunks_and_documents(spark, tmp_path, monkeypatch):
    notes = tmp_path / "notes"
    notes.mkdir()
    for i in range(3):
        (notes / f"n{i}.md").write_text(f"# Note {i}\nsome words")
    corpus = api.Corpus(spark, str(tmp_path / "store"))
    corpus.sync_vault(str(notes))
    written = []
    for module in (api, status):
        monkeypatch.setattr(module, "written_table", lambda rows, write=module.written_table: written.append(rows.columns) or write(rows))
    assert {r["outcome"]: r["n"] for r in corpus.index(HashEmbedder()).collect()} == {"process": 3}
    assert {r["outcome"]: r["n"] for r in corpus.enrich(FirstWords()).collect()} == {"process": 3}
    assert len(written) >= 4 and not any("body" in columns for columns in written)
    assert {r["outcome"]: r["n"] for r in corpus.index(HashEmbedder()).collect()} == {"skip": 3}
