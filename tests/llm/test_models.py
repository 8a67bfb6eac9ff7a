"""Language, toxicity and class model: held-out accuracy, odd texts, plain formulas; and the pipeline."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corpusmill.llm import classlm, langid, toxicity

FOLDER = "/root/testdata/sf0.001"
SYLLABLES = {"aa": ["lo", "mi", "ta", "ren"], "bb": ["sch", "kt", "ung", "ber"], "cc": ["ão", "ção", "lh", "nh"]}


def speech(rng, lang, n):
    return " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def talk(spark):
    rng = random.Random(4)
    rows = [(i, speech(rng, lang := list(SYLLABLES)[i % 3], rng.randint(3, 60)), lang) for i in range(240)]
    return spark.createDataFrame([*rows, (900, None, "aa"), (901, "", "bb"), (902, "123 !!", None), (903, "schungber ungber", None)], "doc_id bigint, text string, lang string")


def test_language_of_held_out_texts(talk):
    out = {r["doc_id"]: r for r in langid.identified_documents(talk).collect()}
    truth = {r["doc_id"]: r["lang"] for r in talk.collect()}
    held = [d for d, r in out.items() if r["held_out"] and d < 900]
    assert len(held) > 30 and sum(out[d]["lang_pred"] == truth[d] for d in held) / len(held) > 0.97
    assert [out[d]["lang_pred"] for d in (900, 901, 902, 903)] == ["und", "und", "und", "bb"]
    assert all(0 <= r["score"] <= 1 for r in out.values())
    assert langid.identified_documents(talk.limit(0)).count() == 0


def test_a_hundred_languages_and_the_filter_against_exact_sets(spark):
    import numpy as np

    rng = random.Random(12)
    letters = [chr(0x61 + i) for i in range(26)] + [chr(0x430 + i) for i in range(32)]
    tongue = {f"l{i}": ["".join(rng.choices(letters, k=3)) for _ in range(6)] for i in range(100)}
    rows = [(i, " ".join("".join(rng.choices(tongue[lang], k=2)) for _ in range(30)), lang) for i, lang in enumerate(x for x in tongue for _ in range(12))]
    table = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = langid.fit(table)
    assert sorted(model.langs) == sorted(tongue)
    out = {r["doc_id"]: r for r in langid.identified_documents(table).collect()}
    held = [(i, lang) for i, _, lang in rows if out[i]["held_out"]]
    assert sum(out[i]["lang_pred"] == lang for i, lang in held) / len(held) > 0.95
    keys = np.array([int(k) for k in np.random.default_rng(1).integers(0, 1 << 62, 5000)], dtype=np.uint64)
    of = np.arange(5000) % 100
    small = langid.build([str(i) for i in range(100)], keys, of)
    found = langid.contained(small, keys)
    assert all(found[j, c // 64] >> np.uint64(c % 64) & np.uint64(1) for j, c in enumerate(of))
    wrong = langid.contained(small, keys + np.uint64(1))
    rate = np.mean([[(w[c // 64] >> np.uint64(c % 64) & np.uint64(1)) for c in range(100)] for w in wrong], axis=0)
    assert abs(rate.mean() - small.false_positive.mean()) < 1e-3


def test_long_texts_go_through_in_blocks(talk, monkeypatch):
    from corpusmill.llm import batches

    model = langid.fit(talk)
    body = speech(random.Random(1), "cc", 4000)
    whole = langid.decide(model, [body])
    pieces = list(batches.blocks([body, "x"], 2, 500))
    assert len(pieces) > 5 and max(sum(len(p) for _, p in g) for g in pieces) <= 501
    monkeypatch.setattr(langid, "blocks", lambda t, o: batches.blocks(t, o, 500))
    split = langid.decide(model, [body])
    assert split[0] == whole[0] and split[1][0] == pytest.approx(whole[1][0], abs=0.02)


def test_folding_undoes_disguises():
    assert toxicity.fold("ÍD10T! st​upid́ сlоwn") == " idiot stupid clown "
    assert toxicity.fold(None) == "  " and toxicity.fold("!?") == "  "


def test_exceptions_and_longest_entries():
    model = toxicity.Model({" clown": 4.0, " clownfish ": 0.0, " bad": 1.0})
    assert toxicity.density(model, "clown") == pytest.approx(4 / (1 + toxicity.EXTRA_WORDS))
    assert toxicity.density(model, "a clownfish swims") == 0
    assert toxicity.density(model, "CL0WNS and clownfish, bad") == pytest.approx(5 / (4 + toxicity.EXTRA_WORDS))
    assert toxicity.density(toxicity.Model({}), "clown") == 0


def test_toxicity_of_held_out_texts(spark):
    rng = random.Random(8)
    words = [f"{a}{b}" for a in "bcdfg" for b in ("alo", "eri", "omun", "utes")]
    rows, labels = [], []
    for i in range(400):
        body = rng.choices(words, k=rng.randint(8, 60))
        toxic = i % 4 == 0
        for _ in range(max(1, len(body) // 15) if toxic else 0):
            body[rng.randrange(len(body))] = rng.choice(["moronic", "m0ron", "trashy", "TRASH"])
        rows.append((i, " ".join(body)))
        labels.append((i, int(toxic)))
    table = spark.createDataFrame([*rows, (900, None), (901, "")], "doc_id bigint, text string").withColumn("score", F.lit("clash"))
    marks = spark.createDataFrame([*labels, (None, 1), (5, None)], "doc_id bigint, toxic int")
    out = {r["doc_id"]: r for r in toxicity.toxic_documents(table, marks).collect()}
    held = [d for d, r in out.items() if r["held_out"] and d < 900]
    right = sum(out[d]["predicted"] == labels[d][1] for d in held)
    assert len(held) > 50 and right / len(held) > 0.95
    assert out[900]["predicted"] == out[901]["predicted"] == 0 and all(0 <= r["score"] <= 1 for r in out.values())
    assert toxicity.toxic_documents(table.limit(0), marks).count() == 0
    assert toxicity.toxic_documents(table, marks.limit(0)).count() == 402


def test_exceptions_are_learned_from_clean_documents(spark):
    rng = random.Random(9)
    words = [f"{a}{b}" for a in "bcdfg" for b in ("alo", "eri", "omun", "utes")]
    rows, labels = [], []
    for i in range(600):
        body, toxic = rng.choices(words, k=20), i % 3 == 0
        if toxic:
            body[rng.randrange(20)] = rng.choice(["clown", "clowns", "clowned", "clowny"])
            body[rng.randrange(20)] = "jester"
        elif i % 15 == 1:
            body[3:4] = [["clownfish"], ["class", "jester"]][i % 2]
        rows.append((i, " ".join(body)))
        labels.append((i, int(toxic)))
    model = toxicity.fit(spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, toxic int"))
    assert [model.entries.get(p) for p in (" clownfish ", " class jester ")] == [0.0, 0.0]
    assert toxicity.density(model, "balo clownfish ceri") == toxicity.density(model, "the class jester") == 0
    assert toxicity.density(model, "such clowns") > 0 and toxicity.density(model, "such a jester") > 0


@pytest.mark.parametrize("held", (50, 1 << 19))
def test_class_model_counts_and_base_score(spark, monkeypatch, held):
    rng = random.Random(6)
    texts = [speech(rng, list(SYLLABLES)[i % 3], rng.randint(0, 40)) for i in range(80)] + [None, "", "Unseen WORDS Ünseen ünseen"]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    monkeypatch.setattr(classlm, "HELD_WORDS", held)
    monkeypatch.setattr(classlm, "UNIT_WORDS", 20)
    out = {r["doc_id"]: r for r in classlm.scored_documents(table).collect()}
    tokens = {i: [*classlm.words(t), None] for i, t in enumerate(texts)}
    counts = Counter(w for i, ws in tokens.items() if not out[i]["held_out"] for w in ws)
    n, v = sum(counts.values()), len(counts)
    for i, ws in tokens.items():
        assert (out[i]["n_tokens"], out[i]["n_known"], out[i]["train_tokens"]) == (len(ws), sum(counts[w] > 0 for w in ws), n)
        assert out[i]["base_score"] == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws), rel=1e-9)
        assert out[i]["score"] < 0 and math.isfinite(out[i]["score"])
    held = [i for i in out if out[i]["held_out"]]
    assert sum(out[i]["score"] for i in held) > sum(out[i]["base_score"] for i in held)


def test_words_that_tasks_do_not_hold_have_classes_of_their_own(spark, monkeypatch):
    rng = random.Random(5)
    texts = [" ".join(f"w{2 * int(rng.paretovariate(0.7)) % 300 + j % 2}" for j in range(40)) for _ in range(400)] + [None, ""]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    monkeypatch.setattr(classlm, "UNIT_WORDS", 40)
    found = []
    for held in (1 << 19, 100, 0):
        monkeypatch.setattr(classlm, "HELD_WORDS", held)
        found.append({r["doc_id"]: (r["n_known"], r["base_score"], r["score"]) for r in classlm.scored_documents(table).collect()})
    for other in found[1:]:
        assert other.keys() == found[0].keys()
        assert all(other[i] == pytest.approx(found[0][i], rel=1e-9) for i in other)


def test_words_that_polynomial_hashes_confuse_are_told_apart(spark):
    import zlib

    one = "".join("ab"[i.bit_count() % 2] for i in range(1024))
    other = "".join("ba"[i.bit_count() % 2] for i in range(1024))
    held = next(i for i in range(50) if zlib.crc32(str(i).encode()) % 7 == 2)
    rows = [(i, "some plain words here" if i % 2 else f"some {one}") for i in range(50)]
    rows[held] = (held, other)
    out = {r["doc_id"]: r for r in classlm.scored_documents(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert (out[held]["n_tokens"], out[held]["n_known"]) == (2, 1)


def test_classes_of_all_words_and_scores_add_up(spark):
    rng = random.Random(5)
    # words of even and odd number follow each other, in 300 words of which the core holds 40
    texts = [" ".join(f"w{2 * int(rng.paretovariate(0.7)) % 300 + j % 2}" for j in range(40)) for _ in range(400)]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    vocabulary = classlm.count_words(table).cache()
    keep, classlm.UNIT_WORDS = classlm.UNIT_WORDS, 40
    model = classlm.fit(table, vocabulary)
    classlm.UNIT_WORDS = keep
    numbers = {h: i for i, h in ((i, int(classlm.word_parts([f"w{i}"])[0][0])) for i in range(300))}
    sides: dict = {}
    for h, n, c in zip(model.held.tolist(), model.held_n.tolist(), model.held_class.tolist()):
        sides.setdefault(c, Counter())[numbers[h] % 2] += n
    assert sum(max(s.values()) for s in sides.values()) > 0.97 * sum(sum(s.values()) for s in sides.values())
    # the probabilities of the classes, and of the words of a class with the unseen one, add up to 1
    assert (10.0**model.transition).sum(axis=1) == pytest.approx(1)
    for c in set(model.held_class.tolist()):
        of = model.held_class == c
        assert ((model.held_n[of] + 1).sum() + 1) * 10.0 ** model.emission_base[c] == pytest.approx(1)
    # the score is the plain sum of transitions and emissions
    row = classlm.score(table.limit(1), model, vocabulary).collect()[0]
    body = texts[row["doc_id"]].split()
    at = {h: i for i, h in enumerate(model.held.tolist())}
    path = [classlm.CLASSES, *(int(model.held_class[at[int(classlm.word_parts([w])[0][0])]]) for w in body), classlm.CLASSES]
    logs = [math.log10(model.held_n[at[int(classlm.word_parts([w])[0][0])]] + 1) for w in body] + [math.log10(model.ends + 1)]
    assert row["score"] == pytest.approx(sum(logs) + sum(model.transition[a, b] + model.emission_base[b] for a, b in zip(path, path[1:])))


def test_exchange_ends_where_no_single_move_raises_the_likelihood():
    import numpy as np

    rng = np.random.default_rng(3)
    counts = rng.poisson(rng.gamma(0.3, 8, (13, 13))).astype(float)

    def likelihood(classes):
        hot = np.eye(4)[classes]
        table = hot.T @ counts @ hot
        f = lambda x: (x * np.log(np.maximum(x, 1e-300))).sum()
        return f(table) - f(table.sum(axis=0)) - f(table.sum(axis=1))

    classes = classlm.exchange(counts, 3, 50)
    assert classes[-1] == 3 and set(classes[:-1]) <= {0, 1, 2}
    best = likelihood(classes)
    start = np.empty(13, dtype=int)
    start[np.argsort(-counts.sum(axis=0)[:-1], kind="stable")] = np.arange(12) % 3
    start[-1] = 3
    assert best > likelihood(start)
    for u in range(12):
        for c in range(3):
            moved = classes.copy()
            moved[u] = c
            assert likelihood(moved) <= best + 1e-9


def test_pipeline_stages_equal_plain_steps(spark):
    from corpusmill.llm import mixing, tiling

    from test_similarity import brute_components

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = {r["doc_id"]: r for r in docs.collect()}
    bench = [(r["item_id"], tiling.tokens(r["text"])) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    model = toxicity.fit(docs, spark.read.parquet(f"{FOLDER}/labels.parquet"))
    curve = lambda t: 1 / (1 + math.exp(-(model.slope * toxicity.density(model, t) + model.intercept)))
    clean = [(i, r["text"]) for i, r in sorted(rows.items()) if curve(r["text"]) < toxicity.THRESHOLD]
    heads = [i for i, _, c in brute_components(clean) if i == c]
    block = tiling.build(bench)
    pure = [i for i in heads if tiling.best_match(block, rows[i]["text"])[0] < tiling.COVERAGE]
    kept = {r["doc_id"] for r in mixing.mix(docs.where(F.col("doc_id").isin(pure))).where("kept = 1").collect()}
    out = corpus_pipeline.run(spark, FOLDER)
    assert out.columns == [*docs.columns, "shard", "slot"]
    got = out.collect()
    assert {r["doc_id"] for r in got} == kept and len(got) == len(kept)
    assert all(r["text"] == rows[r["doc_id"]]["text"] for r in got)


def test_pipeline_of_odd_tables(spark, tmp_path):
    base = str(tmp_path)
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, item_id string, shard string"
    rows = [(None, None, None, None, None, "x", "y"), (1, "", None, None, 0, "x", "y"), (2, "a b c d e f g", "en", None, 3, None, None), (2, "a b c d e f g", "en", None, 3, None, None)]
    spark.createDataFrame([(2, 1)], "doc_id bigint, toxic int").write.parquet(f"{base}/labels.parquet")
    spark.createDataFrame([(2, "q r s t u v")], "item_id bigint, text string").write.parquet(f"{base}/benchmark.parquet")
    spark.createDataFrame(rows, schema).write.parquet(f"{base}/documents.parquet")
    docs = spark.read.parquet(f"{base}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, base).columns == docs.columns
        assert stage(spark, docs.limit(0), base).count() == 0
    near = corpus_pipeline.without_near_copies(spark, docs, base)
    assert sorted(str(r["doc_id"]) for r in near.collect()) == ["1", "2", "None"]
    assert corpus_pipeline.sharded(spark, docs, base).count() == 4


def test_near_copies_keep_one_row_of_each_group_whatever_ids_repeat(spark):
    a, c = " ".join(f"a{i}" for i in range(60)), " ".join(f"c{i}" for i in range(60))
    rows = [(1, a, "x"), (2, a, "x"), (2, c, "x"), (3, f"{c} more", "x"), (None, "n " * 9, "x"), (None, "n " * 9, "x"), (None, "n " * 9, "y"), (4, None, "x"), (4, None, "x"), (5, "", "x"), (5, "", "z")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    left = corpus_pipeline.without_near_copies(spark, docs, "")
    assert left.columns == docs.columns
    got = Counter((r["doc_id"], r["text"], r["lang"]) for r in left.collect())
    of_n = [k for k in got if k[1] == "n " * 9]
    assert len(of_n) == 1 and got.pop(of_n[0]) == 1
    assert got == Counter({(1, a, "x"): 1, (2, c, "x"): 1, (4, None, "x"): 2, (5, "", "x"): 1, (5, "", "z"): 1})
