"""Jaccard join, repeated strings and string tiling against brute force."""

import hashlib
import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pytest

from corpusmill.llm import components, jaccard, suffixes, tiling
from corpusmill.llm.shingles import shingle_set, word_hashes

SCHEMA = "doc_id bigint, text string"


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def brute_components(rows):
    sets = [(d, shingles(t)) for d, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            a, b = sets[i][1], sets[j][1]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                root[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, (d, _) in enumerate(sets):
        least[find(i)] = min(least.get(find(i), d), d)
    return [(d, len(s), least[find(i)]) for i, (d, s) in enumerate(sets)]


def corpus(seed=3):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    passage = " ".join(rng.choices(words, k=60))
    out = [None, "", "  ", "short", "SHORT", "two words", "É é", "é é"]
    for _ in range(6):
        base = rng.choices(words, k=rng.randint(20, 150))
        for _ in range(8):
            copy = list(base)
            for _ in range(rng.randint(0, 6)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            out.append(" ".join(copy))
        out.append(" ".join(base))
    out += [f"{passage} {' '.join(rng.choices(words, k=n))}" for n in (0, 3, 8, 10, 12, 15, 20, 60) for _ in range(5)]
    return list(enumerate(out))


SPLITS = ((64, 8, 2.0), (2, 1, 50.0))


@pytest.mark.parametrize("small, pivots, replicas", SPLITS)
def test_join_equals_brute_force(spark, monkeypatch, small, pivots, replicas):
    rows = corpus()
    for name, value in (("SMALL_REGION", small), ("PIVOTS", pivots), ("MOST_REPLICAS", replicas)):
        monkeypatch.setattr(jaccard, name, value)
    got = jaccard.join_classes(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert sorted(map(tuple, got)) == brute_components(rows)


def test_a_dense_group_compares_outsiders_only(spark, monkeypatch):
    rng = random.Random(11)
    words = [f"w{i}" for i in range(4000)]
    base = rng.choices(words, k=120)
    texts = []
    for k in [1] * 45 + [3] * 40 + [5] * 25:
        copy = list(base)
        for at in rng.sample(range(len(base)), k):
            copy[at] = rng.choice(words)
        texts.append(" ".join(copy))
    rows = list(enumerate(texts))
    monkeypatch.setattr(jaccard, "SMALL_REGION", 4)
    monkeypatch.setattr(jaccard, "PIVOTS", 2)
    nearly, plain = [], jaccard._with_pivots

    def noted(large, pivots, turn):
        nearly.append(large.where("nearly").count())
        return plain(large, pivots, turn)

    monkeypatch.setattr(jaccard, "_with_pivots", noted)
    got = jaccard.join_classes(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(map(tuple, got)) == brute_components(rows)
    assert len({c for _, _, c in brute_components(rows)}) > 1
    assert any(nearly)


@pytest.mark.parametrize("small, pivots, replicas", SPLITS[1:])
def test_all_links_equal_brute_force(spark, monkeypatch, small, pivots, replicas):
    rows = corpus()
    for name, value in (("SMALL_REGION", small), ("PIVOTS", pivots), ("MOST_REPLICAS", replicas)):
        monkeypatch.setattr(jaccard, name, value)
    sets = {d: shingles(t) for d, t in rows}
    want = {(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    members, pairs = jaccard.join_links(spark.createDataFrame(rows, SCHEMA).repartition(3))
    out = {r["doc_id"]: r for r in members.collect()}
    linked = [frozenset((r["a"], r["b"])) for r in pairs.collect()]
    assert len(set(linked)) == len(linked)
    same = lambda a, b: out[a]["class"] is not None and out[a]["class"] == out[b]["class"]
    got = {(a, b) for a in out for b in out if a < b and (same(a, b) or frozenset((out[a]["class"], out[b]["class"])) in set(linked))}
    assert got == want and len(out) == len(rows)
    uses = Counter(d for pair in want for d in pair)
    assert all(r["n_links"] == uses[d] and r["n_shingles"] == len(sets[d]) for d, r in out.items())


def test_join_of_odd_tables(spark):
    assert jaccard.join_classes(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(7, "a b c d e f"), (7, "a b c d e f"), (3, "a b c d e f"), (None, "a b c d e f"), (None, None)]
    out = jaccard.join_classes(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((str(r["doc_id"]), r["n_shingles"], r["component_id"]) for r in out) == [("3", 2, 3), ("7", 2, 3), ("7", 2, 3), ("None", 0, None), ("None", 2, 3)]


def alternating(n, a, b):
    """The word whose i-th letter is told by the parity of the bits of i: such pairs meet under any polynomial hash modulo 2**64."""
    return "".join(a if i.bit_count() % 2 == 0 else b for i in range(n))


def test_words_that_polynomial_hashes_confuse(spark):
    pairs = [(alternating(1 << k, "a", "b"), alternating(1 << k, "b", "a")) for k in (10, 11, 12)]
    rows = [(2 * i + j, word) for i, pair in enumerate(pairs) for j, word in enumerate(pair)] + [(6, pairs[0][0]), (7, pairs[0][1] + " x")]
    out = jaccard.joined_documents(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in out) == brute_components(rows)
    assert len({int(h[0]) for h in word_hashes([w for pair in pairs for w in pair])}) == 6


def test_shingles_of_long_texts_do_not_depend_on_pieces(monkeypatch):
    from corpusmill.llm import shingles as module

    body = " ".join(f"word{i}" for i in range(3000)) + " " + "x" * 500
    whole = shingle_set(word_hashes([body])[0])
    monkeypatch.setattr(module, "STEP", 300)
    assert np.array_equal(whole, shingle_set(word_hashes(["a", body, "b"])[1]))


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (7, 7)]
    out = dict(components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect())
    assert all(out[i] == 0 for i in range(41)) and {out[i] for i in (100, 101, 102)} == {100}


def brute_cut(rows, length):
    texts = [(d, (t or "").encode()) for d, t in rows]
    seen = Counter(b[i : i + length] for _, b in texts for i in range(len(b) - length + 1))
    out = []
    for d, b in texts:
        gone = np.zeros(len(b) + 1, dtype=bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = True
        gone = gone[: len(b)]
        kept = bytes(np.frombuffer(b, dtype=np.uint8)[~gone])
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((d, len(b), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


def test_repeated_strings_equal_brute_force(spark):
    rng = random.Random(5)
    line = "".join(rng.choices("abcdefgh é", k=330))
    rows = [None, "", "short", "ab" * 300, "x" * 450, line, line[40:290]]
    for i in range(12):
        own = ["".join(rng.choices("abcdefgh é", k=rng.randint(0, 300))) for _ in range(2)]
        text = list(own[0] + line[: rng.randint(150, 330)] + own[1])
        if i % 3 == 0 and text:
            text[rng.randrange(len(text))] = "#"
        rows.append("".join(text))
    rows = list(enumerate([*rows, rows[-1]]))
    for most in (20_000, 2):
        suffixes.MOST_SPANS = most
        got = suffixes.deduplicated_documents(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
        assert sorted(map(tuple, got)) == brute_cut(rows, suffixes.LENGTH)
    suffixes.MOST_SPANS = 20_000


def test_spans_cover_every_window_once():
    rng = random.Random(1)
    for step in (1 << 20, 70):
        suffixes.STEP, keep = step, suffixes.STEP
        for length in (30, 50):
            body = bytes(rng.choices(b"abc ", k=400))
            _, spans, first, last, lead = suffixes.spans_of(body, length)
            assert [p for a, z in zip(first, last) for p in range(a, z + 1)] == list(range(len(body) - length + 1))
        suffixes.STEP = keep


def test_cut_out_joins_overlapping_runs():
    assert suffixes.cut_out("0123456789", [1, 2, 6], [1, 3, 6], 3) == (b"09", 8, 1)
    assert suffixes.cut_out("0123456789", [7, 0], [7, 0], 2) == (b"234569", 4, 2)


def brute_tiles(doc, item, k):
    """Longest common run of unmarked tokens first, until none of ``k`` is left."""
    used_d, used_i, tiles = [False] * len(doc), [False] * len(item), 0
    while True:
        best = (0, 0, 0)
        for a in range(len(doc)):
            for b in range(len(item)):
                n = 0
                while a + n < len(doc) and b + n < len(item) and doc[a + n] == item[b + n] and not used_d[a + n] and not used_i[b + n]:
                    n += 1
                if n > best[0]:
                    best = (n, a, b)
        n, a, b = best
        if n < k:
            return sum(used_i), tiles
        used_d[a : a + n], used_i[b : b + n] = [True] * n, [True] * n
        tiles += 1


def test_tiling_equals_brute_force():
    rng = random.Random(2)
    for _ in range(150):
        item = [rng.choice("abcdef") for _ in range(rng.randint(1, 24))]
        doc = [rng.choice("abcdefg") for _ in range(rng.randint(0, 30))] + item[len(item) // 2 :] + ["z"] + item[: len(item) // 2]
        block = tiling.build([(9, [w.encode() for w in item])], 3)
        share, found, tiles = tiling.best_match(block, " ".join(doc))
        want = brute_tiles(doc, item, min(3, len(item)))
        assert (round(share * len(item)), tiles) == want and found == (9 if want[0] else None)
    for _ in range(60):
        item, doc = ([rng.choice("ab") for _ in range(rng.randint(3, 20))] for _ in "xy")
        block = tiling.build([(9, [w.encode() for w in item])], 3)
        share, _, tiles = tiling.best_match(block, " ".join(doc))
        assert (round(share * len(item)), tiles) == brute_tiles(doc, item, 3)


def test_tiling_of_very_repetitive_texts_takes_little_memory():
    item = [b"word"] * 10 + [b"y"] + [b"word"] * 989
    block = tiling.build([(1, item)])
    tracemalloc.start()
    for text, want in (("word " * 200_000, (999 / 1000, 1, 2)), (("word " * 10 + "z ") * 20_000, (999 / 1000, 1, 100))):
        assert tiling.best_match(block, text) == want
    assert tracemalloc.get_traced_memory()[1] < 100 << 20
    tracemalloc.stop()


def test_contamination_of_odd_tables(spark):
    item = "the quick brown fox jumps over the lazy dog near a river bank"
    moved = "river bank noise over the lazy dog near a RIVER BANK. more noise The quick, brown fox jumps"
    rows = [(0, None), (1, ""), (2, item), (3, moved), (4, "clean text with the quick brown words"), (2, item)]
    table = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id bigint, text string, coverage string")
    bench = spark.createDataFrame([(5, item), (6, None), (None, item), (7, "ab cd"), (8, "")], "item_id bigint, text string")
    for tokens in (1_000_000, 3):
        out = tiling.contamination(table, bench, block_tokens=tokens).collect()
        assert Counter((r["doc_id"], r["contaminated"]) for r in out) == Counter({(0, False): 1, (1, False): 1, (2, True): 2, (3, True): 1, (4, False): 1})
        assert {r["item_id"] for r in out if r["contaminated"]} == {5}
    assert tiling.contamination(table, bench.limit(0)).where("contaminated").count() == 0
    assert tiling.contamination(table.limit(0), bench).count() == 0
