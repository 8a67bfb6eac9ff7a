"""Class-based n-gram language model in the manner of Brown, trained over the whole corpus.

A text's probability is the product over its tokens of P(class | class before) and P(word | class).
Counts are taken from all training documents in Spark, words by 64-bit hashes. The exchange algorithm
moves one unit at a time to the class that raises the likelihood of the class bigrams most, until none
moves; its units are the most frequent words and groups of all other words by their last two bytes. Then
every other word with enough uses leaves its group for the class that its own neighbours in the
core raise the likelihood in most; as core words keep their classes, one such sweep settles. Rarer words,
and unseen ones, have the class of their group. Class bigrams are counted again with all classes.
Tasks hold the most frequent words in memory; counts and classes of all others reach texts through joins,
so the bound on memory changes no result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.columns import remainder
from corpusmill.llm.shingles import mixed, word_parts
from corpusmill.session import written_table

#: Words that the exchange moves one by one; groups of the other words; classes (besides that of the text's end).
UNIT_WORDS, GROUPS, CLASSES, MOST_SWEEPS = 1000, 384, 48, 100
#: Uses from which a word outside the core leaves its group for a class of its own choice; less do not tell.
OWN_USES = 10
#: Words, the most frequent ones, that tasks hold in memory with count and class (18 bytes each); counts and classes of all others are joined.
HELD_WORDS = 1 << 19
#: Columns with the words of a text that are not held but have classes of their own, and these classes.
FAR = ("__far", "__far_class")
#: Rows of an Arrow batch that a task works on at a time.
SLICE = 1024


def words(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z only) words of a whole text; bytes.split() cuts at space and tab to carriage return."""
    return (text or "").encode("utf-8", "replace").lower().split()


def _group(tails: np.ndarray) -> np.ndarray:
    return (mixed(tails.astype(np.uint64)) % np.uint64(GROUPS)).astype(np.int64)


def _parts(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, np.ndarray, np.ndarray, np.ndarray]]:
    for batch in batches:
        for at in range(0, len(batch), SLICE):
            part = batch.iloc[at : at + SLICE]
            yield part, *word_parts(part["text"].tolist())


def _summed(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(keys, return_counts=True)


def count_words(docs: DataFrame) -> DataFrame:
    """``word, tail, n`` over all texts: hash, group and uses of every word; slices add up, the rest meets by word."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _, hashes, tails, _ in _parts(batches):
            found, first, n = np.unique(hashes, return_index=True, return_counts=True)
            yield pd.DataFrame({"word": found.view(np.int64), "tail": _group(tails[first]).astype(np.int32), "n": n})

    return docs.select("text").mapInPandas(count, "word bigint, tail int, n bigint").groupBy("word").agg(F.min("tail").alias("tail"), F.sum("n").alias("n"))


def _with_ends(ids: np.ndarray, sizes: np.ndarray, end: int) -> np.ndarray:
    """The end mark, and each text's ids with an end mark behind."""
    return np.insert(ids, np.concatenate([[0], np.cumsum(sizes)]), end)


def _found(held: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each hash in the sorted array ``held``, and whether it is there."""
    if not len(held):
        return np.zeros(len(hashes), dtype=np.int64), np.zeros(len(hashes), dtype=bool)
    at = np.minimum(np.searchsorted(held, hashes), len(held) - 1)
    return at, held[at] == hashes


def _pair_counts(docs: DataFrame, ids_of, size: int) -> np.ndarray:
    """Counts of neighbouring ids, ``ids_of(part, hashes, tails)``, as a matrix; ``size`` - 1 is the text's end, before the first token too."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(size * size, dtype=np.int64)
        for part, hashes, tails, sizes in _parts(batches):
            ids = _with_ends(ids_of(part, hashes, tails), sizes, size - 1)
            total += np.bincount(ids[:-1] * size + ids[1:], minlength=len(total))
        some = np.flatnonzero(total)
        yield pd.DataFrame({"pair": some, "n": total[some]})

    counted = docs.select("text", *[c for c in FAR if c in docs.columns]).mapInPandas(count, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    matrix = np.zeros(size * size)
    matrix[counted["pair"].to_numpy()] = counted["n"].to_numpy()
    return matrix.reshape(size, size)


def _f(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def exchange(bigrams: np.ndarray, n_classes: int = CLASSES, sweeps: int = MOST_SWEEPS) -> np.ndarray:
    """Class of every unit; the last unit (the text's end) keeps a class of its own, ``n_classes``.

    Starts from classes by frequency rank and ends when no unit moves. The work depends on the fixed number of units only.
    """
    n = len(bigrams)
    usage = bigrams.sum(axis=0)
    classes = np.empty(n, dtype=np.int64)
    classes[np.argsort(-usage[:-1], kind="stable")] = np.arange(n - 1) % n_classes
    classes[-1] = n_classes
    size = n_classes + 1
    one_hot = np.zeros((n, size))
    one_hot[np.arange(n), classes] = 1
    to_class, from_class = bigrams @ one_hot, bigrams.T @ one_hot
    table = one_hot.T @ to_class
    for _ in range(sweeps):
        moved = 0
        for u in np.argsort(-usage[:-1], kind="stable"):
            if not usage[u]:
                continue
            now, right, left, own = classes[u], to_class[u].copy(), from_class[u].copy(), bigrams[u, u]
            right[now] -= own
            left[now] -= own
            table[now] -= right
            table[:, now] -= left
            table[now, now] -= own
            rows, cols = table.sum(axis=1) + left, table.sum(axis=0) + right  # what the unit adds wherever it goes
            out_u, in_u = right.sum() + own, left.sum() + own
            gain = (_f(table + right) - _f(table)).sum(axis=1) + (_f(table + left[:, None]) - _f(table)).sum(axis=0)
            diagonal = np.diag(table)
            gain += _f(diagonal + right + left + own) - _f(diagonal + right) - _f(diagonal + left) + _f(diagonal)
            gain -= _f(rows + out_u) - _f(rows) + _f(cols + in_u) - _f(cols)
            best = int(np.argmax(gain[:n_classes]))
            if gain[best] <= gain[now] + 1e-9:  # no gain beyond rounding
                best = now
            table[best] += right
            table[:, best] += left
            table[best, best] += own
            if best != now:
                moved += 1
                classes[u] = best
                to_class[:, now] -= bigrams[:, u]
                to_class[:, best] += bigrams[:, u]
                from_class[:, now] -= bigrams[u]
                from_class[:, best] += bigrams[u]
        if not moved:
            break
    return classes


def gains(table: np.ndarray, word: np.ndarray, context: np.ndarray, n: np.ndarray, n_words: int) -> np.ndarray:
    """What each class gains in likelihood by each word, from counts of the classes before (context below ``len(table)``) and after it."""
    size = len(table)
    out = np.zeros((n_words, size - 1))
    for at in range(0, len(word), 20_000):
        w, c, m = word[at : at + 20_000], context[at : at + 20_000], n[at : at + 20_000, None].astype(float)
        cells = np.where((c < size)[:, None], table[c % size, : size - 1], table[: size - 1, c % size].T)
        np.add.at(out, w, _f(cells + m) - _f(cells))
    after = np.bincount(word[context >= size], n[context >= size], n_words)[:, None]
    before = np.bincount(word[context < size], n[context < size], n_words)[:, None]
    rows, cols = table.sum(axis=1)[: size - 1], table.sum(axis=0)[: size - 1]
    return out - (_f(rows + after) - _f(rows)) - (_f(cols + before) - _f(cols))


def _own_classes(docs: DataFrame, held: np.ndarray, core: np.ndarray, core_class: np.ndarray, table: np.ndarray, inside: bool) -> DataFrame:
    """``word, class`` of the words outside the core that have neighbours in it: those in ``held``, or (not ``inside``) all others."""
    size = len(table)
    shared = docs.sparkSession.sparkContext.broadcast((held, core, core_class))

    def contexts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        all_held, in_core, classes = shared.value
        for _, hashes, _, sizes in _parts(batches):
            at, there = _found(in_core, hashes)
            known = _with_ends(np.where(there, classes[at] if len(classes) else 0, -1), sizes, size - 1)
            names, (place, listed) = all_held, _found(all_held, hashes)
            wanted = listed & ~there
            if not inside:
                wanted = ~listed
                names, place[wanted] = np.unique(hashes[wanted], return_inverse=True)
            place = _with_ends(np.where(wanted, place, -1), sizes, -1)
            left, right = (place[1:] >= 0) & (known[:-1] >= 0), (place[:-1] >= 0) & (known[1:] >= 0)
            keys, n = _summed(np.concatenate([place[1:][left] * 2 * size + known[:-1][left], place[:-1][right] * 2 * size + size + known[1:][right]]))
            yield pd.DataFrame({"word": names[keys // (2 * size)].view(np.int64), "context": (keys % (2 * size)).astype(np.int32), "n": n})

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 2000):
                part = batch.iloc[at : at + 2000]
                counts = [len(x) for x in part["contexts"]]
                value = gains(table, np.repeat(np.arange(len(part)), counts), np.concatenate(part["contexts"].tolist()), np.concatenate(part["ns"].tolist()), len(part))
                yield pd.DataFrame({"word": part["word"], "class": value.argmax(axis=1).astype(np.int32)})

    counted = docs.select("text").mapInPandas(contexts, "word bigint, context int, n bigint").groupBy("word", "context").agg(F.sum("n").alias("n"))
    # in one order, as sums of floating point decide
    lists = counted.groupBy("word").agg(F.sort_array(F.collect_list(F.struct("context", "n"))).alias("c")).select("word", F.col("c.context").alias("contexts"), F.col("c.n").alias("ns"))
    return lists.mapInPandas(best, "word bigint, class int")


def _with_far(docs: DataFrame, held: np.ndarray, far: DataFrame | None) -> DataFrame:
    """``docs`` with ``FAR``: each text's words in ``far`` (``word, class``), which are too many to hold, with their classes."""
    if far is None:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(held)

    def others(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part, hashes, _, sizes in _parts(batches):
            _, there = _found(shared.value, hashes)
            pairs = pd.DataFrame({"__row": np.repeat(part["__row"].to_numpy(), sizes)[~there], "word": hashes[~there].view(np.int64)})
            yield pairs.drop_duplicates()

    numbered = written_table(docs.withColumn("__row", F.monotonically_increasing_id()))
    found = numbered.select("__row", "text").mapInPandas(others, "__row bigint, word bigint").join(far.select("word", "class"), "word")
    lists = found.groupBy("__row").agg(F.collect_list(F.struct("word", "class")).alias("f")).select("__row", F.col("f.word").alias(FAR[0]), F.col("f.class").alias(FAR[1]))
    return numbered.join(lists, "__row", "left").drop("__row")


@dataclass(frozen=True)
class Model:
    """Everything a scoring task holds, all of bounded size; ``held`` is sorted, ``whole``: it is the whole vocabulary.

    ``far`` is no part of that: a table of the words with classes of their own that are not held, if there are any.
    """

    held: np.ndarray
    held_n: np.ndarray
    held_class: np.ndarray
    group_class: np.ndarray
    transition: np.ndarray
    emission_base: np.ndarray
    tokens: int
    vocabulary: int
    ends: int
    whole: bool
    far: DataFrame | None = None

    def classes(self, part: pd.DataFrame, hashes: np.ndarray, at: np.ndarray, there: np.ndarray, tails: np.ndarray) -> np.ndarray:
        out = np.where(there, self.held_class[at] if len(self.held) else 0, self.group_class[_group(tails)]).astype(np.int64)
        listed = part[part[FAR[0]].notna()] if FAR[0] in part else []
        if len(listed):
            words, first = np.unique(np.concatenate(listed[FAR[0]].tolist()).view(np.uint64), return_index=True)
            place, own = _found(words, hashes)
            out[own] = np.concatenate(listed[FAR[1]].tolist())[first][place[own]]
        return out


def most_frequent(vocabulary: DataFrame, most: int) -> DataFrame:
    """At most ``most`` words: all from some frequency on, without sorting them."""
    level = F.floor(16 * F.log2("n"))
    levels = sorted(((r["level"], r["words"]) for r in vocabulary.groupBy(level.alias("level")).agg(F.count("*").alias("words")).collect()), reverse=True)
    least, held = None, 0
    for at, n in levels:
        if held + n > most:
            break
        least, held = at, held + n
    return vocabulary.where(level >= least) if least is not None else vocabulary.limit(0)


def fit(training: DataFrame, vocabulary: DataFrame) -> Model:
    """Model from training documents and their word counts ``vocabulary`` (``word, tail, n``)."""
    ends, size = training.count(), CLASSES + 1
    # the core in order of unsigned hashes, whatever else is held
    first = vocabulary.orderBy(F.desc("n"), F.col("word") < 0, "word").limit(UNIT_WORDS).select("word", "tail", "n")
    tops = [rows.toArrow() for rows in (first, most_frequent(vocabulary, HELD_WORDS).select("word", "tail", "n"))]
    held, at = np.unique(np.concatenate([t["word"].to_numpy() for t in tops]).view(np.uint64), return_index=True)
    held_n, held_tail = (np.concatenate([t[c].to_numpy() for t in tops])[at].astype(np.int64) for c in ("n", "tail"))
    core_at = np.sort(np.lexsort((held, -held_n))[:UNIT_WORDS])
    core = held[core_at]

    def units(_: pd.DataFrame, hashes: np.ndarray, tails: np.ndarray) -> np.ndarray:
        at, there = _found(core, hashes)
        return np.where(there, at, len(core) + _group(tails))

    bigrams = _pair_counts(training, units, len(core) + GROUPS + 1)
    unit_class = exchange(bigrams)
    group_class = unit_class[len(core) : -1]
    table = np.zeros((size, size))
    np.add.at(table, (unit_class[:, None].repeat(len(bigrams), 1), unit_class[None, :].repeat(len(bigrams), 0)), bigrams)
    held_class = group_class[held_tail]
    held_class[core_at] = unit_class[: len(core)]
    if len(held) > len(core):
        own = _own_classes(training, held, core, unit_class[: len(core)], table, inside=True).toArrow()
        at = np.searchsorted(held, own["word"].to_numpy().view(np.uint64))
        often = held_n[at] >= OWN_USES
        held_class[at[often]] = own["class"].to_numpy()[often]
    far, often = None, vocabulary.where(F.col("n") >= OWN_USES)
    if often.count() > int((held_n >= OWN_USES).sum()):
        own = _own_classes(training, held, core, unit_class[: len(core)], table, inside=False)
        far = written_table(own.join(often.select("word", "tail", "n"), "word"))
    groups = vocabulary.groupBy("tail").agg(F.count("*").alias("v"), F.sum("n").alias("n")).collect()
    total, distinct = np.zeros(size), np.zeros(size)
    for r in groups:
        total[group_class[r["tail"]]] += r["n"]
        distinct[group_class[r["tail"]]] += 1 * r["v"]
    seen_tokens, seen_words = int(total.sum()), int(distinct.sum())
    # words with a class of their own leave that of their group
    for classes, sign in ((group_class[held_tail], -1), (held_class, 1)):
        np.add.at(total, classes, sign * held_n)
        np.add.at(distinct, classes, sign)
    for r in far.groupBy("tail", "class").agg(F.count("*").alias("v"), F.sum("n").alias("n")).collect() if far is not None else []:
        for c, sign in ((group_class[r["tail"]], -1), (r["class"], 1)):
            total[c] += sign * r["n"]
            distinct[c] += sign * r["v"]
    total[CLASSES], distinct[CLASSES] = ends, 1
    model = Model(held, held_n, held_class.astype(np.int16), group_class, table, -np.log10(total + distinct + 1), seen_tokens + ends, seen_words + (ends > 0), ends, len(held) == seen_words)
    table = _pair_counts(_with_far(training, held, far), lambda part, hashes, tails: model.classes(part, hashes, *_found(model.held, hashes), tails), size)
    # one more word of each class stands for all unseen ones
    return Model(**{**model.__dict__, "transition": np.log10((table + 1) / (table.sum(axis=1, keepdims=True) + size)), "far": far})


def score(docs: DataFrame, model: Model, vocabulary: DataFrame) -> DataFrame:
    """``docs`` columns other than ``text``, with ``n_tokens, n_known, base_score, score``.

    Tasks sum what the words they hold decide; the counts of all other words are joined, one row for each
    distinct word of a document. A null text is empty: its only token is the end. Input columns of the
    names that are added are replaced.
    """
    added = ("n_tokens", "n_known", "base_score", "score")
    kept = [f for f in docs.schema.fields if f.name not in ("text", *added)]
    shared = docs.sparkSession.sparkContext.broadcast(replace(model, far=None))
    docs = _with_far(docs.select(*[F.col(f"`{f.name}`") for f in kept], "text"), model.held, model.far)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        held_log = np.log10(m.held_n + 1.0)
        for part, hashes, tails, sizes in _parts(batches):
            n = len(part)
            at, there = _found(m.held, hashes)
            ids = _with_ends(m.classes(part, hashes, at, there, tails), sizes, CLASSES)
            steps = m.transition[ids[:-1], ids[1:]] + m.emission_base[ids[1:]]
            path = np.bincount(np.repeat(np.arange(n), sizes + 1), steps, n)
            owner = np.repeat(np.arange(n), sizes)
            logs = np.bincount(owner[there], held_log[at[there]], n) + np.log10(m.ends + 1)
            known = np.bincount(owner[there], minlength=n) + int(m.ends > 0)
            other, times = [np.empty(0, dtype=np.int64)] * n, [np.empty(0, dtype=np.int64)] * n
            if not m.whole:
                rest, of = hashes[~there], owner[~there]
                for i, found in zip(np.unique(of), np.split(rest, np.flatnonzero(np.diff(of)) + 1)):
                    found, uses = _summed(found)
                    other[i], times[i] = found.view(np.int64), uses
            parts = pd.DataFrame({"n_tokens": sizes + 1, "held_known": known, "logs": logs, "path": path, "other": other, "times": times})
            yield pd.concat([part[[f.name for f in kept]].reset_index(drop=True), parts], axis=1)

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kept)
    parts = docs.mapInPandas(run, f"{fields}n_tokens bigint, held_known bigint, logs double, path double, other array<bigint>, times array<bigint>")
    if model.whole:  # no other word has a count
        parts = parts.withColumns({"rare_known": F.lit(0), "rare_logs": F.lit(0.0)})
    else:
        parts = written_table(parts.withColumn("__row", F.monotonically_increasing_id()))
        rare = parts.select("__row", F.explode(F.arrays_zip("other", "times")).alias("o")).select("__row", F.col("o.other").alias("word"), F.col("o.times").alias("times"))
        joined = rare.join(vocabulary.select("word", "n"), "word").groupBy("__row").agg(F.sum("times").alias("rare_known"), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("rare_logs"))
        parts = parts.join(joined, "__row", "left")
    logs = F.col("logs") + F.coalesce(F.col("rare_logs"), F.lit(0.0))
    base = logs - F.col("n_tokens") * F.log10(F.lit(float(model.tokens + model.vocabulary + 1)))
    return parts.select(
        *[F.col(f"`{f.name}`") for f in kept],
        "n_tokens",
        (F.col("held_known") + F.coalesce(F.col("rare_known"), F.lit(0))).cast("long").alias("n_known"),
        base.alias("base_score"),
        (logs + F.col("path")).alias("score"),
    )


def scored_documents(docs: DataFrame) -> DataFrame:
    """Train outside the held-out fold, then score every document."""
    slim = docs.select("doc_id", "text", (remainder(F.col("doc_id"), 7) == 2).alias("held_out"))
    training = slim.where(~F.col("held_out"))
    vocabulary = written_table(count_words(training))
    model = fit(training, vocabulary)
    out = score(slim, model, vocabulary)
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")
