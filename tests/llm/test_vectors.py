"""Exact top-k search and vector codes against brute force; odd vectors; bounds that never lose a tie."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest

from corpusmill.llm import codes, topk

NAN, INF = float("nan"), float("inf")
ODD = [(9001, None, 1), (9002, [0.5, None, 0.5, 0.5], 1), (9003, [NAN] * 4, 2), (9004, [INF, 0.0, 0.0, 0.0], 2), (None, [0.9, 0.9, 0.9, 0.9], 1)]
SCHEMA = "vec_id bigint, embedding array<float>, label int"


def usable(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def brute_top(rows, k, scale, modulus):
    rows = [(i, [math.floor(scale * float(np.float32(x))) for x in v]) for i, v, _ in rows if i is not None and usable(v)]
    out = {}
    for q, a in sorted((r for r in rows if r[0] % modulus == 0), reverse=True):
        scored = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in rows if i != q and len(b) == len(a))
        out[q] = [(rank, i, -s) for rank, (s, i) in enumerate(scored[:k], start=1)]
    return {(q, *r) for q, found in out.items() for r in found}


@pytest.fixture(scope="module")
def vectors():
    rng = random.Random(11)
    base = [[rng.gauss(0, 0.3) for _ in range(20)] for _ in range(6)]
    rows = [(i, [x + rng.gauss(0, 0.05) for x in base[i % 6]], i % 4 or None) for i in range(900)]
    rows += [(i, base[0], 3) for i in range(900, 1300)]  # one vector very often: ties go to the smaller id
    rows += [(1400, [0.0] * 20, 1), (1500, [-x for x in base[0]], 1)]
    return rows


def test_top_k_is_exact_with_ties_and_odd_vectors(spark, vectors):
    rows = vectors + ODD + [(3000, [0.5] * 4, 1), (3001, [0.1, 0.2, 0.3, 0.4], 1), (3100, [], 1), (3101, [], 1), (1200, [0.25] * 20, 2), (-100, [0.3] * 20, 1), (700, base_of(vectors, 700), 1)]
    table = spark.createDataFrame(rows, SCHEMA).repartition(5)
    want = brute_top(rows, 10, 1024, 100)
    out = {tuple(r) for r in topk.nearest_vectors(table.withColumnRenamed("label", "rank")).collect()}
    assert {q for q, *_ in want} == {q for q, *_ in out}
    assert out == {(q, rank, i, s) for q, rank, i, s in want}
    # several passes over small blocks of queries, without a sample to start from
    again = {tuple(r) for r in topk.top_k(table, table.where("vec_id % 100 = 0"), 10, 1024, block_bytes=1500, seed_rows=0).collect()}
    assert again == out


def base_of(vectors, vec_id):
    return next(v for i, v, _ in vectors if i == vec_id)


def test_few_candidates_and_empty_tables(spark):
    table = spark.createDataFrame([(100, [1.0, 2.0], 1), (7, [0.5, 0.5], 1)], SCHEMA)
    assert [tuple(r) for r in topk.nearest_vectors(table).collect()] == [(100, 1, 7, 512 * 1024 + 512 * 2048)]
    assert topk.nearest_vectors(table.where("vec_id = 7")).collect() == []
    assert topk.nearest_vectors(table.limit(0)).columns == ["query_id", "rank", "vec_id", "score"]
    assert topk.nearest_vectors(table.limit(0)).collect() == []
    huge = spark.createDataFrame([(0, [1e30, 1.0], 1), (1, [1e30, -1.0], 1), (2, [-1e30, 0.0], 1)], SCHEMA)
    assert [r["vec_id"] for r in sorted(topk.nearest_vectors(huge).collect())] == [1, 2]


def test_pruning_leaves_out_pairs_but_no_result(monkeypatch):
    rng = np.random.default_rng(3)
    spread = np.where(np.arange(64)[:, None] < 16, 400, 20)
    q, c = np.floor(rng.normal(size=(64, 40)) * spread), np.floor(rng.normal(size=(64, 3000)) * spread)
    seen = []
    whole = topk._reaches
    monkeypatch.setattr(topk, "_reaches", lambda score, most, least: seen.append(np.size(score)) or whole(score, most, least))
    queries = topk.build(np.arange(40), q)
    scores = q.T @ c
    least = np.sort(scores, axis=1)[:, -10]
    vectors = c[queries.order]
    row, column, score = topk.surviving(queries, slice(0, 40), vectors, topk._remaining(vectors), least)
    assert {(r, x, s) for r, x, s in zip(row.tolist(), column.tolist(), score.tolist(), strict=True)} == {(r, x, int(scores[r, x])) for r, x in zip(*np.nonzero(scores >= least[:, None]), strict=True)}
    assert sum(seen) < 0.5 * 40 * 3000 * 8  # of all steps of all pairs


def brute_codes(rows, parts=16, entries=64, rounds=2, scale=256):
    kept = [(i, [math.floor(scale * float(np.float32(x))) for x in v], label) for i, v, label in rows if usable(v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not kept:
        return {}, ""
    dims = len(kept[0][1])
    kept = [r for r in kept if len(r[1]) == dims]
    edges = [p * dims // parts for p in range(parts + 1)]
    cut = [[tuple(v[edges[p] : edges[p + 1]]) for _, v, _ in kept] for p in range(parts)]
    books = [c[:entries] for c in cut]

    def nearest(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, e, strict=True)), j) for j, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for part in cut[p]:
                groups.setdefault(nearest(part, books[p])[1], []).append(part)
            books[p] = [tuple(sum(x) // len(groups[j]) for x in zip(*groups[j], strict=True)) if j in groups else e for j, e in enumerate(books[p])]
    near = [[nearest(part, books[p]) for part in cut[p]] for p in range(parts)]
    code = ["".join(f"{near[p][n][1]:02x}" for p in range(parts)) for n in range(len(kept))]
    error = [sum(near[p][n][0] for p in range(parts)) for n in range(len(kept))]
    by_label = Counter()
    for (_, _, label), e in zip(kept, error, strict=True):
        by_label[label] += e
    digest = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    return Counter((i, c, e, by_label[label]) for (i, _, label), c, e in zip(kept, code, error, strict=True)), digest


@pytest.mark.parametrize("dims", [64, 21])
def test_codes_equal_brute_force(spark, dims):
    rng = random.Random(dims)
    base = [[rng.gauss(0, 0.4) for _ in range(dims)] for _ in range(9)]
    rows = [(i, [x + rng.gauss(0, 0.1) for x in base[i % 9]], rng.choice([1, 2, None])) for i in range(300)]
    rows += [(i, base[0], 7) for i in range(300, 380)] + [(20, base[1], 1), (20, base[1], 1), (None, base[2], None)] + ODD[:4] + [(5000, [0.1], 1)]
    rows.sort(key=lambda r: hash(str(r)))
    table = spark.createDataFrame(rows, SCHEMA).repartition(3)
    out = codes.compressed(table.withColumnRenamed("label", "label").selectExpr("*", "1 as v", "2 as far", "3 as code")).collect()
    want, digest = brute_codes(rows)
    assert Counter((r["vec_id"], r["code"], r["error"], r["label_error"]) for r in out) == want
    assert {r["codebooks_sha256"] for r in out} == {digest}


def test_codes_of_few_and_no_rows(spark):
    rows = [(5, [0.5] * 32, "x"), (6, [0.25] * 32, None), (7, [1e30] * 32, None)]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label string")
    out = {r["vec_id"]: r for r in codes.compressed(table).collect()}
    assert [out[i]["code"] for i in (5, 6, 7)] == ["00" * 16, "01" * 16, "02" * 16] and {r["error"] for r in out.values()} == {0}
    none = codes.compressed(table.limit(0))
    assert none.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"] and none.collect() == []


def test_bounds_order_and_prune_without_losing_ties():
    rng = np.random.default_rng(5)
    entries = np.floor(rng.normal(size=(64, 4)) * 300).astype(np.int64)
    entries[40] = entries[3]
    parts = np.concatenate([np.floor(rng.normal(size=(2000, 4)) * 300).astype(np.int64), entries, np.repeat(entries[3:4], 50, axis=0)])
    pivots = codes.chosen_pivots(entries)
    found = codes.assigned(parts, codes.squares(parts, pivots), entries, pivots)
    every = codes.squares(parts, entries)
    assert (found.square == every.min(axis=1)).all() and (found.entry == every.argmin(axis=1)).all()
    assert found.evaluated < 0.5 * every.size
    same = np.zeros((5, 4), dtype=np.int64)
    assert len(codes.chosen_pivots(same)) == 1 and codes.assigned(same, codes.squares(same, same[:1]), same, same[:1]).entry.tolist() == [0] * 5
