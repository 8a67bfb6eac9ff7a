"""Filter audit: figures of all orders against applying the filters one by one; vertical counters."""

import random
from itertools import permutations

import numpy as np

from corpusmill.llm import audit

WHITE = " \t\n\x0b\x0c\r"


def words_of(text):
    for c in WHITE[1:]:
        text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


def failing(rows):
    out = []
    for doc_id, text, _ in rows:
        text = text or ""
        words = words_of(text)
        copies = [d for d, t, _ in rows if (t or "") == text and d is not None]
        out.append(
            {
                "A": len(words) < 200,
                "B": 100 * len(set(words)) < 50 * len(words),
                "C": 100 * sum("A" <= c <= "Z" for c in text) > 2 * len(text),
                "D": any(c in "#$%&*|" for c in text),
                "E": doc_id is not None and any(d < doc_id for d in copies),
            }
        )
    return out


def brute(rows, labels):
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    fails = failing(rows)
    out = {}
    for part in {r[2] or "" for r in rows}:
        mine = [n for n, r in enumerate(rows) if (r[2] or "") == part]
        removed_at = {}
        for order in permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order, start=1):
                gone = [n for n in left if fails[n][f]]
                left = [n for n in left if not fails[n][f]]
                removed_at.setdefault(f, []).append(len(gone))
                all_failing = [n for n in mine if fails[n][f]]
                alone = sum(1 for n in all_failing if sum(fails[n].values()) == 1)
                out[part, "".join(order), step] = [len(left), len(gone), len(all_failing) - len(gone), alone, sum(rows[n][0] in good for n in gone), sum(rows[n][0] in toxic for n in gone)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(sum(removed_at[order[step - 1]]))
    return out


def table(rng):
    vocabulary = [f"w{i}" for i in range(300)] + ["Öl", "ÀB", "x y"]
    rows = []
    for i in range(160):
        n = rng.choice([0, 5, 199, 200, 260])
        body = rng.choice(WHITE).join(rng.choices(vocabulary[: rng.choice([40, 303])], k=n))
        body = rng.choice(["", " ", "\n"]) + body + rng.choice(["", " ", "AAA" * 20, " #", "|"])
        rows.append((i, body, rng.choice(["a", "b", "", None])))
    rows += [(500 + i, rows[3][1], rng.choice(["a", "b"])) for i in range(300)]  # one text very often
    return rows + [(900, None, "a"), (901, None, None), (902, "", "c"), (None, rows[3][1], "a"), (None, None, "a"), (5, rows[5][1], "a"), (5, rows[5][1], "a"), (903, "ABC" * 100_000 + " $", "long")]


def test_every_figure_of_every_order(spark):
    rng = random.Random(12)
    rows = table(rng)
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 920, 2)] + [(5, 0, 1), (5, 1, 0), (None, 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").selectExpr("*", "1 as part", "2 as word", "3 as good")
    marks = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").selectExpr("*", "'x' as text", "'y' as digest")
    out = audit.filter_audit(docs, marks).collect()
    figures = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    assert {(r["part"], r["filter_order"], r["step"]): [r[f] for f in figures] for r in out} == brute(rows, labels)
    assert len(out) == 600 * len({r[2] or "" for r in rows})
    assert audit.filter_audit(docs.limit(0), marks).count() == 0
    assert audit.filter_audit(docs, marks.limit(0)).where("good_lost + toxic_lost > 0").count() == 0


def test_vertical_counters_count_every_position():
    rng = np.random.default_rng(2)
    planes, want = [], np.zeros(32, dtype=np.int64)
    for n in (0, 1, 2, 3, 7, 1000, 4099):
        words = rng.integers(0, 1 << 32, n, dtype=np.uint64)
        planes = audit.add_words(planes, words.astype(np.int64))
        want += np.array([int(((words >> np.uint64(i)) & np.uint64(1)).sum()) for i in range(32)], dtype=np.int64)
        assert (audit.position_counts(planes) == want).all()
        assert all(len(p) <= 1 for p in planes)


def test_parts_beyond_what_a_task_holds(spark, monkeypatch):
    monkeypatch.setattr(audit, "HELD_PARTS", 3)
    words = spark.createDataFrame([(f"p{i % 10}", False, False, 0xFFFFFFFF) for i in range(50)], "part string, good boolean, toxic boolean, word bigint").repartition(3)
    assert {(r["part"], r["every"][0]) for r in audit.survivors(words).collect()} == {(f"p{i}", 5) for i in range(10)}
