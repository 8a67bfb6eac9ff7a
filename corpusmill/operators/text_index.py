"""The stored full-text index: postings by term bucket, in segments that a change only adds to.

A posting says of a term and a document its frequency, its places, and the document's length, so a query
reads the buckets of its terms and nothing else. A row has the postings of a bucket's terms in some documents,
side by side in arrays, as most terms are in one document only. Documents have a row each in a bucket of their own (``DOCUMENTS``), with the digest of what was
indexed. A changed document goes into a new segment; its old postings stay where they are and are listed as
retired, until enough of them make a merge worth while.
"""

from __future__ import annotations

import dataclasses
import hashlib
import math
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.functions.text import INDEX_TERM, fold_text
from corpusmill.operators.fulltext import B, COLUMNS, K1, LEAST_IDF, best_matches, query_phrases
from corpusmill.session import shared_folder, written_table
from corpusmill.sources.store import Staged, Store

TABLE, RETIRED, STATISTICS = "postings", "postings_retired", "postings_statistics"
#: The bucket of the rows about documents.
DOCUMENTS = -1
#: Places left free between columns, so no phrase reaches from one into the next.
FIELD_GAP = 1
#: Characters of texts whose postings are put together in a task, and bits of the ids in a row after a merge.
SLICE, MERGED_BITS = 4 << 20, 14
#: Retired documents as a share of all, and segments, beyond which segments are merged.
MOST_RETIRED, MOST_SEGMENTS = 0.2, 32
#: Documents for each bucket of terms, and the fewest and most buckets; fixed when an index is begun.
DOCS_A_BUCKET, LEAST_BUCKETS, MOST_BUCKETS = 20_000, 16, 4096
#: Bytes of a row group.
ROW_GROUP = 2 << 20

_LONG, _TEXT = T.LongType(), T.StringType()


def _fields(**kinds: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in kinds.items()])


_INTS = T.ArrayType(T.IntegerType())
#: A row of postings: its terms, where the postings of each begin and how many they are, and what postings have. ``id``
#: is then the first of its documents; ``len`` and ``digest`` are those of a document's own row.
POSTING = _fields(bucket=T.IntegerType(), id=_LONG, len=_LONG, digest=_TEXT, terms=T.ArrayType(_TEXT), starts=_INTS, counts=_INTS, ids=T.ArrayType(_LONG), lens=_INTS, tfs=_INTS, places=T.ArrayType(_INTS))
#: The array of each thing that a posting has.
EACH = {"id": "ids", "len": "lens", "tf": "tfs", "places": "places"}
STORED = _fields(segment=_TEXT, **{f.name: f.dataType for f in POSTING.fields})
GONE = _fields(id=_LONG, segment=_TEXT)
NUMBERS = _fields(n=_LONG, total=_LONG, buckets=T.IntegerType(), retired=_LONG)

_term = regex.compile(INDEX_TERM)
_ascii_term = re.compile("[A-Za-z0-9]+")


def terms_of(text: str | None) -> list[str]:
    """Terms of a text, folded, in order."""
    folded = fold_text(text) or ""
    return (_ascii_term if folded.isascii() else _term).findall(folded)


def content_digest(columns: tuple[str, ...] = COLUMNS) -> Column:
    """Changes with any of the indexed columns, and with a column becoming null."""
    return F.sha2(F.to_json(F.struct(*[F.col(c) for c in columns])), 256)


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``SLICE`` characters of texts, at least one row each."""
    sizes = sum(pc.fill_null(pc.binary_length(batch.column(f + 2)), 0).to_numpy(zero_copy_only=False).astype(np.int64) for f in range(len(COLUMNS)))
    part = np.cumsum(sizes) // SLICE
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for at, end in zip(cuts, cuts[1:]):
        yield batch.slice(at, end - at)


def _postings(docs: pa.RecordBatch, buckets: int) -> tuple[pa.RecordBatch, pa.RecordBatch]:
    """The rows of some documents, and for each bucket a row of all postings of its terms in them."""
    tokens: list[str] = []
    sizes = np.zeros((docs.num_rows, len(COLUMNS)), dtype=np.int64)
    for row in range(docs.num_rows):
        for field in range(len(COLUMNS)):
            found = terms_of(docs.column(field + 2)[row].as_py())
            sizes[row, field] = len(found)
            tokens += found
    lens, n = sizes.sum(axis=1), docs.num_rows
    owner = np.repeat(np.arange(n), lens)
    place = np.arange(len(tokens)) - np.repeat(np.cumsum(lens) - lens, lens) + FIELD_GAP * np.repeat(np.tile(np.arange(len(COLUMNS)), n), sizes.ravel())
    coded = pa.array(tokens, pa.string()).dictionary_encode()
    bucket = np.array([zlib.crc32(t.encode()) % buckets for t in coded.dictionary.to_pylist()], dtype=np.int32)
    # terms by bucket, tokens by term, document and place
    by_bucket = np.argsort(bucket, kind="stable")
    codes = np.argsort(by_bucket)[coded.indices.to_numpy()]
    order = np.argsort(codes, kind="stable")
    codes, owner, place = codes[order], owner[order], place[order].astype(np.int32)
    # where a posting begins among the places, a term among the postings, and a row among the terms and postings
    posting = np.append(np.flatnonzero((np.diff(codes, prepend=-1) != 0) | (np.diff(owner, prepend=-1) != 0)), len(codes)).astype(np.int32)
    term = np.append(np.flatnonzero(np.diff(codes[posting[:-1]], prepend=-1) != 0), len(posting) - 1).astype(np.int32)
    rows = np.append(np.flatnonzero(np.diff(bucket[by_bucket], prepend=-1) != 0), len(term) - 1).astype(np.int32)
    terms, posts = pa.array(rows), pa.array(term[rows])
    of = owner[posting[:-1]]
    ids = docs.column(0).take(pa.array(of))
    starts = term[:-1] - np.repeat(term[rows[:-1]], np.diff(rows))
    lists = [
        *[pa.ListArray.from_arrays(terms, x) for x in (coded.dictionary.take(pa.array(by_bucket)), pa.array(starts), pa.array(np.diff(term)))],
        *[pa.ListArray.from_arrays(posts, x) for x in (ids, pa.array(lens[of].astype(np.int32)), pa.array(np.diff(posting)), pa.ListArray.from_arrays(pa.array(posting), pa.array(place)))],
    ]
    m = len(rows) - 1
    about = [pa.array(np.full(n, DOCUMENTS, dtype=np.int32)), docs.column(0), pa.array(lens), docs.column(1), *[pa.nulls(n, x.type) for x in lists]]
    found = [pa.array(bucket[by_bucket][rows[:-1]]), ids.take(pa.array(term[rows[:-1]])), pa.nulls(m, pa.int64()), pa.nulls(m, pa.string()), *lists]
    return tuple(pa.RecordBatch.from_arrays(columns, POSTING.fieldNames()) for columns in (about, found))


def posted(docs: DataFrame, buckets: int) -> DataFrame:
    """Rows of ``POSTING``: one for each document, and one for each bucket of terms and slice of the texts.

    Postings are put together within their task, so few rows are dealt out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch):
                yield from _postings(part, buckets)

    return docs.select("id", content_digest().alias("digest"), *COLUMNS).mapInArrow(run, POSTING)


def single(rows: DataFrame, names: list[str], terms: list[str] | None = None) -> DataFrame:
    """``segment, bucket, term`` and some of ``EACH``, a row for each posting; of some terms or of all."""
    entries = F.arrays_zip("terms", "starts", "counts")
    if terms is not None:
        entries = F.filter(entries, lambda e: e["terms"].isin(terms))
    lists = F.transform(entries, lambda e: F.struct(e["terms"].alias("term"), *[F.slice(F.col(EACH[n]), e["starts"] + 1, e["counts"]).alias(n) for n in names]))
    by_term = rows.select("segment", "bucket", F.inline(lists))
    each = F.transform(F.arrays_zip(*names), lambda p: F.struct(*[p[n].alias(n) for n in names]))
    return by_term.select("segment", "bucket", "term", F.inline(each))


def _moved(places: Column, by: int) -> Column:
    return F.transform(places, lambda x: x - by)


class TextIndex:
    """The index of a store's documents as it was when it was opened; every document counts, visible or not."""

    def __init__(self, store: Store) -> None:
        self.store, self.folders = store, store.opened()
        numbers = self._read(STATISTICS, NUMBERS).first() if STATISTICS in self.folders else None
        #: Documents, terms in all of them, buckets, and documents whose rows are retired.
        self.n, self.total, self.buckets, self.n_retired = numbers or (0, 0, 0, 0)

    def _read(self, table: str, schema: T.StructType) -> DataFrame:
        return self.store.read_parts(table, self.folders.get(table, []), schema)

    def stored(self) -> DataFrame:
        """All rows of all segments, retired ones too."""
        return self._read(TABLE, STORED)

    def live(self, rows: DataFrame) -> DataFrame:
        """``rows`` without those of retired documents."""
        return rows.join(self._read(RETIRED, GONE), ["id", "segment"], "left_anti") if self.n_retired else rows

    def entries(self) -> DataFrame:
        """``id, segment, len, digest`` of every indexed document."""
        return self.live(self.stored().where(F.col("bucket") == DOCUMENTS)).select("id", "segment", "len", "digest")

    def postings(self) -> DataFrame:
        """``id, term, tf`` of all indexed documents."""
        return self.live(single(self.stored().where(F.col("bucket") >= 0), ["id", "tf"])).select("id", "term", "tf")

    def _segment(self, rows: DataFrame) -> Staged:
        """Rows of ``POSTING`` as a segment: dealt out by bucket, a large bucket in several parts."""
        dealt = rows.hint("rebalance", "bucket").sortWithinPartitions("bucket")
        return self.store.stage(TABLE, dealt, segment=True, by=("bucket",), **{"parquet.block.size": str(ROW_GROUP)})

    def changed(self, docs: DataFrame) -> list[Staged]:
        """Staged parts that bring the index to ``docs``, to be published with them; none if nothing changed.

        Texts of unchanged documents are read for their digest and not split into terms.
        """
        n_docs = docs.count()
        if not self.n and not self.folders.get(TABLE) and n_docs:
            return self._begun(docs, self._buckets(n_docs))
        buckets = self.buckets or self._buckets(n_docs)
        new = docs.select("id", content_digest().alias("new"))
        both = self.entries().join(new, "id", "full_outer").where(~F.col("digest").eqNullSafe(F.col("new")))
        moved = written_table(both.select("id", "segment", F.col("new").isNotNull().alias("stays")))
        if moved.isEmpty():
            return []
        fresh = self._segment(posted(docs.join(moved.where("stays").select("id"), "id", "left_semi"), buckets))
        gone = written_table(self._read(RETIRED, GONE).unionByName(moved.where("segment is not null").select("id", "segment")))
        n_gone, segments = gone.count(), [*self.folders.get(TABLE, []), fresh.folder]
        if len(segments) > MOST_SEGMENTS or n_gone > MOST_RETIRED * n_docs:
            # one segment of all live rows: texts are not read again
            after = self.store.read_parts(TABLE, segments, STORED)
            posts = single(after.where(F.col("bucket") != DOCUMENTS), list(EACH)).join(gone, ["id", "segment"], "left_anti")
            lists = posts.groupBy("bucket", "term", F.shiftright("id", MERGED_BITS)).agg(F.sort_array(F.collect_list(F.struct(*EACH))).alias("p"))
            one = {"terms": F.array("term"), "starts": F.array(F.lit(0)), "counts": F.array(F.size("p"))}
            rows = lists.select("bucket", F.col("p.id")[0].alias("id"), *[c.alias(name) for name, c in one.items()], *[F.col(f"p.{n}").alias(column) for n, column in EACH.items()])
            rows = rows.unionByName(after.where(F.col("bucket") == DOCUMENTS).join(gone, ["id", "segment"], "left_anti").select("bucket", "id", "len", "digest"), allowMissingColumns=True)
            fresh = dataclasses.replace(self._segment(rows.select(*POSTING.fieldNames())), added=False)
            gone, n_gone, segments = gone.limit(0), 0, [fresh.folder]
        return [fresh, self.store.stage(RETIRED, gone), self._numbers(segments, gone, n_gone, buckets)]

    @staticmethod
    def _buckets(n_docs: int) -> int:
        return max(LEAST_BUCKETS, min(MOST_BUCKETS, 1 << math.ceil(math.log2(max(1, n_docs / DOCS_A_BUCKET)))))

    def _numbers(self, segments: list[str], gone: DataFrame, n_gone: int, buckets: int) -> Staged:
        """The statistics of an index of some segments."""
        rows = self.store.read_parts(TABLE, segments, STORED).where(F.col("bucket") == DOCUMENTS).join(gone, ["id", "segment"], "left_anti")
        sums = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("len"), F.lit(0)).alias("total"), F.lit(buckets).alias("buckets"), F.lit(n_gone).cast("long").alias("retired"))
        return self.store.stage(STATISTICS, sums)

    def _begun(self, docs: DataFrame, buckets: int) -> list[Staged]:
        """The first segment: every document is new, so nothing is compared and no text is dealt out."""
        fresh, gone = self._segment(posted(docs, buckets)), self._read(RETIRED, GONE).limit(0)
        return [fresh, self.store.stage(RETIRED, gone), self._numbers([fresh.folder], gone, 0, buckets)]

    def update(self, docs: DataFrame) -> "TextIndex":
        """Bring the index to ``docs`` in a commit of its own; the index as it is then."""
        staged = self.changed(docs)
        if staged:
            self.store.publish(staged)
        return TextIndex(self.store)

    # --- searching ---

    def matching(self, terms: list[str], places: bool = False) -> DataFrame:
        """Postings of some terms: only their buckets are read, and places only for phrases."""
        wanted = sorted({zlib.crc32(t.encode()) % self.buckets for t in terms}) if self.buckets else []
        rows = self.stored().where(F.col("bucket").isin(wanted))
        return self.live(single(rows, ["id", "len", "tf", *(["places"] if places else [])], terms))

    def _counted(self, phrases: list[list[str]]) -> DataFrame:
        """``id, len, tfs``: places of each phrase in the documents that have any of the terms."""
        long_ones = any(len(p) > 1 for p in phrases)
        rows = self.matching(sorted({t for p in phrases for t in p}), long_ones)

        def uses(parts: list[str]) -> Column:
            if len(parts) == 1:
                return F.sum(F.when(F.col("term") == parts[0], F.col("tf").cast("long")))
            starts = [_moved(F.max(F.when(F.col("term") == part, F.col("places"))), k) for k, part in enumerate(parts)]
            common = starts[0]
            for other in starts[1:]:
                common = F.array_intersect(common, other)
            return F.size(common).cast("long")

        counts = [F.greatest(F.coalesce(uses(p), F.lit(0)), F.lit(0)).alias(f"tf{i}") for i, p in enumerate(phrases)]
        return rows.groupBy("id").agg(F.max("len").alias("len"), *counts)

    def bm25(self, query: str) -> DataFrame:
        """``id, score, matched``, as ``fulltext.bm25`` gives it for the indexed documents, from the terms' buckets alone."""
        phrases = query_phrases(query)
        none = self.store.spark.createDataFrame([], "id bigint, score double, matched int")
        if not phrases or not self.n:
            return none
        counted = self._counted(phrases)
        dfs = counted.agg(*[F.count_if(F.col(f"tf{i}") > 0) for i in range(len(phrases))]).first()
        average = self.total / self.n or 1.0
        gains = []
        for i, df in enumerate(dfs):
            raw = math.log((self.n - df + 0.5) / (df + 0.5))
            tf = F.col(f"tf{i}")
            gains.append(F.lit(raw if raw > 0 else LEAST_IDF) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("len") / F.lit(average))))
        matched = sum([(F.col(f"tf{i}") > 0).cast("int") for i in range(len(phrases))], F.lit(0))
        return counted.select("id", sum(gains, F.lit(0.0)).alias("score"), matched.alias("matched")).where("matched > 0")

    def search(self, docs: DataFrame, query: str, visible: Column) -> DataFrame:
        """``id, score``: visible documents with all phrases; if there is none, those with any."""
        return best_matches(self.bm25(query), docs.where(visible), len(query_phrases(query)))


_kept: dict[tuple, tuple] = {}


def index_of(rows: DataFrame, sources: list[DataFrame], name: str, kind: type = TextIndex):
    """The index of ``rows``, which are derived from the files of ``sources``; made once and used again while these are the same.

    It lies in the shared folder. Files count as the same while their names, sizes and times do.
    """
    spark = rows.sparkSession
    files = [s.select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct().orderBy("file_path").collect() for s in sources]
    state = hashlib.sha256(repr([tuple(f) for found in files for f in found]).encode()).hexdigest()
    key = (spark.sparkContext.applicationId, name, kind)
    if _kept.get(key, ("", None))[0] != state:
        root = f"{shared_folder(spark)}/index/{uuid.uuid4().hex}"
        _kept[key] = (state, kind(Store(spark, root)).update(rows))
    return _kept[key][1]
