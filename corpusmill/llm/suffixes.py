"""Removal of byte strings that occur more than once, by interval expansion over a Burrows-Wheeler transform.

A string of ``LENGTH`` bytes is repeated if it also starts anywhere else, in the same document or another.
Texts are spread over tasks by content: each window of ``LENGTH`` bytes belongs to its anchor, the k-gram
with the least hash inside it, so equal windows always meet under one anchor, at one offset. Neighbouring
windows of one anchor form a span; equal spans are counted and kept once. Where different spans share an
anchor, a task sorts the suffixes at the anchors into a sparse Burrows-Wheeler transform and expands their
intervals breadth-first: step by step every interval of suffixes is extended backwards by one byte, until
common prefixes reach the threshold. An anchor with more spans than one task should hold is split by window
offset: half as many windows to a span, and the bytes that these have in common are added to its key, so
the pieces of one key get smaller until single windows are left, which counting alone decides.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.shingles import _BASE, _INVERSE, _power, mixed
from corpusmill.session import written_table

LENGTH = 200
#: Bytes of an anchor k-gram, of one vectorised step over a text, of one task's transform, and spans of a key in one task.
GRAM, STEP, TASK_BYTES, MOST_SPANS = 24, 1 << 20, 4 << 20, 20_000
#: Up to so many document ids are broadcast (8 bytes each), beyond it they are joined.
BROADCAST_IDS = 2_000_000


def _hashes(b: np.ndarray) -> np.ndarray:
    """Running sums from which the hash of any substring follows."""
    total = np.zeros(len(b) + 1, dtype=np.uint64)
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * _power(_BASE, len(b)), out=total[1:])
    return total


def _substrings(total: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    value = (total[stop] - total[start]) * _power(_INVERSE, len(total))[start]
    return mixed(value + (stop - start).astype(np.uint64))


def _least_in_windows(values: np.ndarray, width: int) -> np.ndarray:
    """Index of the least value of every window, of equal ones the rightmost: doubling over index pairs."""
    best = np.arange(len(values), dtype=np.int32)
    done = 1
    while done < width:
        step = min(done, width - done)
        left, right = best[:-step], best[step:]
        best = np.where(values[right] <= values[left], right, left)
        done += step
    return best


def spans_of(text: bytes, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """Anchor hash, span hash, first and last window start, and anchor offset in the first window, of each span of a text.

    Long texts go step by step; a step reads ``length`` - 1 bytes beyond its windows, and a span that a step
    cuts would differ from its equals, so a step ends where a span ends.
    """
    gram = min(GRAM, length)
    anchors, spans, firsts, lasts, leads = [], [], [], [], []
    at, n = 0, len(text) - length + 1
    while at < n:
        windows = min(STEP, n - at)
        b = np.frombuffer(text, dtype=np.uint8, count=windows + length - 1, offset=at)
        total = _hashes(b)
        starts = np.arange(len(b) - gram + 1)
        value = _substrings(total, starts, starts + gram)
        anchor = _least_in_windows(value, length - gram + 1)
        new = np.flatnonzero(np.diff(anchor)) + 1
        first = np.concatenate([[0], new])
        last = np.concatenate([new - 1, [windows - 1]])
        if at + windows < n and len(first) > 1:
            first, last = first[:-1], last[:-1]  # the next step starts with the last span
        anchors.append(value[anchor[first]])
        # windows of one anchor at other offsets are other windows: the offset is part of a span's hash
        body = _substrings(total, first, last + length)
        spans.append(mixed(body ^ (anchor[first] - first).astype(np.uint64)))
        firsts.append(first + at)
        lasts.append(last + at)
        leads.append(anchor[first] - first)
        at += int(last[-1]) + 1
    if not anchors:
        empty = np.empty(0, dtype=np.int64)
        return empty.astype(np.uint64), empty.astype(np.uint64), empty, empty, empty
    return tuple(np.concatenate(x) for x in (anchors, spans, firsts, lasts, leads))


def _shared_prefix(a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Length of the common prefix of rows of two byte matrices, at most ``most``."""
    differ = a != b
    return np.minimum(np.where(differ.any(axis=1), differ.argmax(axis=1), a.shape[1]), most)


class _RangeMinimum:
    """Minimum of any range of an array, from a table of ranges of powers of two."""

    def __init__(self, values: np.ndarray) -> None:
        self.levels = [values]
        width = 1
        while 2 * width <= len(values):
            last = self.levels[-1]
            self.levels.append(np.minimum(last[:-width], last[width:]))
            width *= 2

    def __call__(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Minimum over start <= i < stop; the ranges must not be empty."""
        out = np.empty(len(start), dtype=self.levels[0].dtype)
        level = np.frexp((stop - start).astype(np.float64))[1] - 1
        for k in np.unique(level):
            of = level == k
            out[of] = np.minimum(self.levels[k][start[of]], self.levels[k][stop[of] - (1 << k)])
        return out


def repeated_starts(keys: list[int], leads: list[int], bodies: list[bytes], length: int = LENGTH) -> np.ndarray:
    """Which windows of ``length`` bytes of spans occur in another span of their key.

    Returns a matrix: row i, column j stands for the window of span i that starts j bytes in front of its
    anchor (``leads[i]`` bytes into the span). The transform is sparse: it holds the suffixes at the anchors
    only, sorted by key and text. Its column of bytes in front of the suffixes drives the expansion: at each
    step all intervals are extended backwards by one byte, breadth-first, so the common prefix of an
    interval is one byte longer to the left; what its neighbours share to the right is known from the
    sorting, and shrinks to a range minimum when an interval splits. A window is repeated when both
    parts reach the threshold together. The work is one step for each span and offset, whatever its bytes.
    """
    n = len(bodies)
    widest = max(leads) + 1
    found = np.zeros((n, widest), dtype=bool)
    lead = np.array(leads, dtype=np.int64)
    order = np.array(sorted(range(n), key=lambda i: (keys[i], bodies[i][leads[i] :])), dtype=np.int64)
    right = np.zeros((n, length), dtype=np.uint8)
    before = np.zeros((n, widest), dtype=np.uint8)
    sizes = np.empty(n, dtype=np.int64)
    for i, (body, at) in enumerate(zip(bodies, leads)):
        part = np.frombuffer(body, dtype=np.uint8)
        tail = part[at : at + length]
        right[i, : len(tail)], sizes[i] = tail, len(tail)
        before[i, :at] = part[:at][::-1]
    key = np.array(keys, dtype=np.int64)[order]
    shared = np.full(n, -1, dtype=np.int64)  # with the one before in its interval; -1 starts an interval
    for at in range(1, n, 4096):
        a, b = order[at - 1 : min(at + 4095, n - 1)], order[at : at + 4096]
        shared[at : at + len(b)] = _shared_prefix(right[a], right[b], np.minimum(sizes[a], sizes[b]))
    first = np.concatenate([[True], key[1:] != key[:-1]])
    shared[first] = -1
    group = np.cumsum(first)
    for j in range(widest):
        near = shared >= length - j
        near[:-1] |= near[1:]
        found[order[near], j] = True
        # go on with spans that have a byte in front, and intervals that hold two suffixes or more
        pair = shared >= 0
        pair[:-1] |= shared[1:] >= 0
        kept = np.flatnonzero(pair & (lead[order] > j))
        if not len(kept):
            break
        minimum = _RangeMinimum(shared)
        byte = before[order[kept], j].astype(np.int64)
        place = kept[np.argsort(group[kept] * 256 + byte, kind="stable")]
        symbol = group[place] * 256 + before[order[place], j]
        first = np.concatenate([[True], symbol[1:] != symbol[:-1]])
        now = np.full(len(place), -1, dtype=np.int64)
        same = np.flatnonzero(~first)
        if len(same):
            now[same] = minimum(place[same - 1] + 1, place[same] + 1)
        order, group, shared = order[place], np.cumsum(first), now
    return found


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1


_COVER = "doc bigint, first int, last int"
#: A span: its windows start from ``first`` to ``last``; ``lead`` is the offset of the anchor in the first window.
_SPAN = "key bigint, span bigint, doc bigint, first int, last int, lead int"
_BODY = "key bigint, doc bigint, first int, last int, lead int, open boolean, bytes binary"


def _identified(docs: DataFrame) -> DataFrame:
    """Texts with ``doc``, a 64-bit hash of id and text. Equal rows share it; what is found for one holds for all."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", text.alias("text"), F.xxhash64("doc_id", text).alias("doc"))


def _spans(texts: DataFrame, length: int) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 512):
                part = batch.iloc[at : at + 512]
                found = [spans_of(t.encode("utf-8", "replace"), length) for t in part["text"]]
                columns = [np.concatenate(x) for x in zip(*found)]
                docs = np.repeat(part["doc"].to_numpy(), [len(f[0]) for f in found])
                yield pd.DataFrame({"key": columns[0].view(np.int64), "span": columns[1].view(np.int64), "doc": docs, "first": columns[2].astype(np.int32), "last": columns[3].astype(np.int32), "lead": columns[4].astype(np.int32)})

    return texts.select("text", "doc").mapInPandas(run, _SPAN)


def covered_windows(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``doc, first, last``: runs of starts of repeated strings in each document (``doc`` of ``_identified``)."""
    texts = _identified(docs)
    spans = written_table(_spans(texts, length))
    # a key that occurs once has no repeated window; one with equal spans only has no other
    busy = spans.groupBy("key").agg(F.count("*").alias("n"), F.min("span").alias("s0"), F.max("span").alias("s1")).where("n > 1")
    # written first, so that the join below has no aggregate in its stage and a key of very many rows can be split
    busy = written_table(busy.select("key", (F.col("s0") != F.col("s1")).alias("several")))
    rows = written_table(spans.join(busy, "key"))
    found = [rows.where("not several").select("doc", "first", "last")]
    several = rows.where("several")
    kinds = written_table(several.groupBy("key", "span").agg(F.count("*").alias("n"), F.min(F.struct("doc", "first", "last", "lead")).alias("at")))
    found.append(several.join(kinds.where("n > 1").select("key", "span"), ["key", "span"], "left_semi").select("doc", "first", "last"))
    # one row for each different span; a span that occurs once is open, the others only stand by
    heads = kinds.select("key", "at.*", (F.col("n") == 1).alias("open"))
    bodies = written_table(_with_bytes(texts, heads, length))
    cell = 1
    while cell < length - min(GRAM, length) + 1:
        cell *= 2
    while True:
        sizes = bodies.groupBy("key").agg(F.count("*").alias("spans"), F.max(F.col("open").cast("int")).alias("some")).where("spans > 1 and some = 1")
        sized = written_table(bodies.join(sizes.select("key", "spans"), "key"))
        light = sized.where(F.col("spans") <= MOST_SPANS)
        if not light.isEmpty():
            found.append(written_table(_expanded(light, length)))
        heavy = sized.where(F.col("spans") > MOST_SPANS)
        if heavy.isEmpty() or cell == 1:
            break
        cell //= 2
        pieces = written_table(_halved(heavy, length, cell))
        kinds = written_table(pieces.groupBy("key", "piece").agg(F.count("*").alias("n"), F.min(F.struct("doc", "first")).alias("at")))
        found.append(pieces.where("open").join(kinds.where("n > 1").select("key", "piece"), ["key", "piece"], "left_semi").select("doc", "first", "last"))
        one = kinds.select("key", "piece", "n", F.col("at.doc").alias("doc"), F.col("at.first").alias("first"))
        bodies = written_table(pieces.join(one, ["key", "piece", "doc", "first"]).select("key", "doc", "first", "last", "lead", (F.col("open") & (F.col("n") == 1)).alias("open"), "bytes").dropDuplicates(["key", "doc", "first"]))
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    return every


def _only(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """The texts whose ``doc`` is in ``ids``; the ids are broadcast if they are few enough."""
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    return texts.join(ids, "doc", "left_semi")


def _with_bytes(texts: DataFrame, heads: DataFrame, length: int) -> DataFrame:
    """The spans of ``heads`` with their bytes, cut from the texts of the documents that have any."""
    wanted = written_table(heads.groupBy("doc").agg(F.collect_list(F.struct("key", "first", "last", "lead", "open")).alias("s")).select("doc", *[F.col(f"s.{c}").alias(c) for c in ("key", "first", "last", "lead", "open")]))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                part, out = batch.iloc[at : at + 256], []
                for text, doc, *spans in zip(*[part[c] for c in ("text", "doc", "key", "first", "last", "lead", "open")]):
                    data = text.encode("utf-8", "replace")
                    out.extend((key, doc, first, last, lead, is_open, data[first : last + length]) for key, first, last, lead, is_open in zip(*spans))
                yield pd.DataFrame(out, columns=["key", "doc", "first", "last", "lead", "open", "bytes"])

    joined = _only(texts.select("text", "doc"), wanted.select("doc")).dropDuplicates(["doc"]).join(wanted, "doc")
    return joined.mapInPandas(run, _BODY)


def _expanded(spans: DataFrame, length: int) -> DataFrame:
    """Repeated windows of the open spans, found among the spans of a key: one transform for some keys in a task."""
    total = spans.agg(F.sum(F.length("bytes"))).first()[0] or 0
    buckets = max(1, int(total // TASK_BYTES))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        found = repeated_starts(rows["key"].tolist(), rows["lead"].tolist(), rows["bytes"].tolist(), length)
        out = []
        for doc, anchor, is_open, flag in zip(rows["doc"], rows["first"] + rows["lead"], rows["open"], found):
            if is_open and flag.any():
                out.extend((doc, anchor - z, anchor - a) for a, z in zip(*_runs(flag)))
        return pd.DataFrame(out, columns=["doc", "first", "last"])

    return spans.select("key", "doc", "first", "lead", "open", "bytes").withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets))).groupBy("bucket").applyInPandas(run, _COVER)


def pieces_of(first: int, last: int, lead: int, length: int, cell: int) -> list[tuple[int, int, int, int, int]]:
    """The windows of a span by cells of ``cell`` anchor offsets: cell number, first and last window, and the bytes that all windows of the cell have."""
    anchor, out = first + lead, []
    for number in range((anchor - last) // cell, lead // cell + 1):
        low, high = number * cell, number * cell + cell - 1
        a, z = max(first, anchor - high), min(last, anchor - low)
        out.append((number, a, z, anchor - low, anchor - high + length))
    return out


def _halved(spans: DataFrame, length: int, cell: int) -> DataFrame:
    """Each span in pieces by offset of the anchor; the bytes that all windows of a piece share become part of its key."""

    def digest(data: bytes, *numbers: int) -> int:
        salt = b"".join(int(n).to_bytes(8, "little", signed=True) for n in numbers)
        return int.from_bytes(hashlib.blake2b(bytes(data), key=salt, digest_size=8).digest(), "little", signed=True)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for key, doc, first, last, lead, is_open, data in zip(*[batch[c] for c in ("key", "doc", "first", "last", "lead", "open", "bytes")]):
                for number, a, z, low, high in pieces_of(first, last, lead, length, cell):
                    piece, core = data[a - first : z - first + length], data[low - first : max(low, high) - first]
                    offset = first + lead - a
                    out.append((digest(core, key, number), digest(piece, offset), doc, a, z, offset, is_open, bytes(piece)))
            yield pd.DataFrame(out, columns=["key", "piece", "doc", "first", "last", "lead", "open", "bytes"])

    return spans.select("key", "doc", "first", "last", "lead", "open", "bytes").mapInPandas(run, "key bigint, piece bigint, doc bigint, first int, last int, lead int, open boolean, bytes binary")


def cut_out(text: str, firsts: list[int], lasts: list[int], length: int) -> tuple[bytes, int, int]:
    """What is left of a text without the strings that start in the given runs, the bytes removed, and the removed runs."""
    data = text.encode("utf-8", "replace")
    kept, removed, runs, at = [], 0, 0, 0
    stop = -1
    for first, last in sorted(zip(firsts, lasts)):
        if first > stop or not runs:
            kept.append(data[at:first])
            runs += 1
            at = first
        stop = max(stop, last + length)
        removed += max(0, stop - at)
        at = max(at, stop)
    kept.append(data[at:])
    return b"".join(kept), removed, runs


def without_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept`` for every document (``doc_id``, ``text``).

    ``kept`` are the bytes outside all repeated strings, which may end inside a character. A null text is
    empty; a text of under ``length`` bytes keeps everything; equal rows remove each other's whole texts;
    an empty table gives an empty result.
    """
    texts = _identified(docs)
    covers = written_table(covered_windows(docs, length).groupBy("doc").agg(F.collect_list(F.struct("first", "last")).alias("c")).select("doc", F.col("c.first").alias("firsts"), F.col("c.last").alias("lasts")))
    few = covers.count() <= BROADCAST_IDS
    ids = F.broadcast(covers.select("doc")) if few else covers.select("doc")
    size = F.octet_length("text").cast("long")
    whole = texts.join(ids, "doc", "left_anti").select("doc_id", size.alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.sha2("text", 256).alias("kept_sha256"), F.encode("text", "utf-8").alias("kept"))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc_id, text, firsts, lasts in zip(batch["doc_id"], batch["text"], batch["firsts"], batch["lasts"]):
                kept, removed, runs = cut_out(text, firsts, lasts, length)
                out.append((doc_id, len(kept) + removed, removed, runs, hashlib.sha256(kept).hexdigest(), kept))
            yield pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    some = texts.join(ids, "doc", "left_semi").join(covers, "doc").select("doc_id", "text", "firsts", "lasts")
    cut = some.mapInPandas(run, f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary")
    return whole.unionByName(cut)


def deduplicated_documents(docs: DataFrame) -> DataFrame:
    return without_repeats(docs.select("doc_id", "text")).drop("kept")


def oracle() -> str:
    """The same in DuckDB SQL, by grouping every window of every text; for small tables."""
    return f"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
windows AS (SELECT doc_id, i, md5(substr(h, 2 * i - 1, {2 * LENGTH})) AS m FROM (SELECT doc_id, h, unnest(range(1, n - {LENGTH - 2})) AS i FROM d WHERE n >= {LENGTH})),
repeated AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY m) AS c FROM windows) WHERE c > 1),
begun AS (SELECT doc_id, i, (i > coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), -{2 * LENGTH}) + {LENGTH})::INT AS begins FROM repeated),
runs AS (SELECT doc_id, min(i) AS a, max(i) + {LENGTH - 1} AS z FROM (SELECT *, sum(begins) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM begun) GROUP BY doc_id, g),
parts AS (
    SELECT doc_id, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) + 1 AS s, a - 1 AS e FROM runs
    UNION ALL SELECT doc_id, max(z) + 1, any_value(n) FROM runs JOIN d USING (doc_id) GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(substr(h, 2 * s - 1, 2 * (e - s + 1)), '' ORDER BY s) AS k FROM parts JOIN d USING (doc_id) WHERE e >= s GROUP BY doc_id),
removed AS (SELECT doc_id, sum(z - a + 1) AS n_removed, count(*) AS n_spans FROM runs GROUP BY doc_id)
SELECT doc_id, n::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(CASE WHEN n_spans IS NULL THEN h ELSE coalesce(k, '') END)) AS kept_sha256
FROM d LEFT JOIN removed USING (doc_id) LEFT JOIN kept USING (doc_id)"""
