"""Mixing sources to target weights by iterative proportional fitting, in DataFrame operations only.

Token counts are summed by cell (source, language, topic). Raking scales the cells' probabilities to one
target margin after the other, with the caps inside: a target that a category's own tokens cannot meet is
lowered to what it has, and every step solves for a margin with the cells at probability 1 held there.
Each document is then kept with its cell's probability, decided by a hash of its id, so a rerun keeps the
same documents. ``margins`` tells wanted, feasible and achieved shares.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.llm.columns import WORD, let
from corpusmill.session import written_table

DIMS = ("source", "lang", "topic")
#: Target share of a category is its token share to this power, normalised: below 1 flattens, 0 levels.
POWERS = {"source": 0.5, "lang": 0.7, "topic": 0.3}
#: Share of all tokens that the mixture takes.
BUDGET = 0.5
#: Raking ends after so many sweeps, or when every margin is met to within this share of the budget.
SWEEPS, CLOSE, SEED = 20, 1e-9, "mix-1"
#: Cells and margins are broadcast up to so many bytes (at 200 a row), else shuffled.
BROADCAST_BYTES = 64 << 20
#: Topics by terms: a text has the topic whose terms it holds most often (ties: the first), or else the last. Terms are lower-case ASCII.
TOPICS = (("legal", ("licens", "licenc", "copyright", "warrant", "liabilit", "permission")), ("accounts", ("passw", "secret", "token", "api_key", "login")), ("contacts", ("@", "http", "www.", "phone")), ("general", ()))


def term_topic(text: Column, topics: tuple[tuple[str, tuple[str, ...]], ...] = TOPICS) -> Column:
    def uses(body: Column, terms: tuple[str, ...]) -> Column:
        return sum(((F.octet_length(body) - F.octet_length(F.replace(body, F.lit(t), F.lit("")))) / F.lit(len(t)) for t in terms), F.lit(0.0))

    def decided(n: Column) -> Column:
        topic = F.lit(topics[-1][0])
        for i, (name, _) in reversed(list(enumerate(topics[:-1]))):
            topic = F.when((n[i] > 0) & (n[i] == F.array_max(n)), F.lit(name)).otherwise(topic)
        return topic

    return let(F.lower(F.coalesce(text, F.lit(""))), lambda b: let(F.array(*[uses(b, terms) for _, terms in topics[:-1]]), decided))


def uniform(doc_id: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) that the id and the seed decide; a null id counts as the empty string."""
    digest = F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":" + seed)).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def _filling(tokens: Column, rate: Column, goal: Column, by: list[Column]) -> Column:
    """The factor f for which min(tokens, f * tokens * rate) adds up to ``goal`` in each group of rows.

    The sum is concave in f, the least of the lines that cap the k rows of the highest rates; so f is the
    greatest of their solutions.
    """
    order = Window.partitionBy(*by).orderBy(rate.desc())
    capped = F.coalesce(F.sum(tokens).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    free = F.sum(tokens * rate).over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    return F.when(free > 0, (goal - capped) / free)


def targets(cells: DataFrame, dim: str, power: float | None = None, weights: dict[str, float] | None = None, budget: float = BUDGET) -> DataFrame:
    """``dim, tokens, wanted, goal`` of a margin: tokens to keep by the weights (or the power) alone, and at most those there are.

    With ``weights``, categories that they do not name have weight 0. What a category has too little of
    goes to the others in proportion to their own targets.
    """
    share = cells.groupBy(dim).agg(F.sum("tokens").cast("double").alias("tokens"))
    aim = F.pow("tokens", F.lit(power)) if weights is None else F.coalesce(*[F.when(F.col(dim) == c, F.lit(float(w))) for c, w in weights.items()], F.lit(0.0))
    share = share.withColumn("s", F.when(F.col("tokens") > 0, aim).otherwise(0.0))
    total, whole = share.agg(F.sum("tokens"), F.sum("s")).first()
    kept, one = budget * (total or 0.0), [F.lit(1)]
    rate = F.when(F.col("tokens") > 0, F.col("s") / F.col("tokens")).otherwise(0.0)
    solved = share.withColumn("rate", rate).withColumn("f", _filling(F.col("tokens"), F.col("rate"), F.lit(kept), one))
    factor = F.coalesce(F.max("f").over(Window.partitionBy(*one)), F.lit(0.0))
    return solved.select(dim, "tokens", (F.col("s") * (kept / (whole or 1.0))).alias("wanted"), F.least("tokens", F.col("s") * factor).alias("goal"))


def rake(cells: DataFrame, dims: tuple[str, ...] = DIMS, powers: dict[str, float] | None = None, weights: dict[str, dict[str, float]] | None = None, budget: float = BUDGET, sweeps: int = SWEEPS) -> DataFrame:
    """Cells (``dims`` and ``tokens``) with ``prob``, at most 1, whose kept tokens meet the feasible target of each margin.

    Cells with no tokens have probability 0. Margins that are feasible each but not together are met as
    nearly as the sweeps get; the budget is met in any case. The cells are written once a sweep.
    """
    powers, weights = powers or POWERS, weights or {}
    n = cells.count()
    cells = written_table(cells.coalesce(1 + n // 100_000)) if n else cells
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    kept = F.col("tokens") * F.least(F.lit(1.0), F.col("rate"))
    held = F.broadcast if n * 200 <= BROADCAST_BYTES else (lambda df: df)
    cells = cells.withColumn("rate", F.when(F.col("tokens") > 0, F.lit(float(budget))).otherwise(0.0))
    for d in dims:
        cells = cells.join(held(targets(cells, d, powers.get(d), weights.get(d), budget).select(d, F.col("goal").alias(f"goal_{d}"))), d)
    cells = written_table(cells)
    for _ in range(sweeps if total else 0):
        for d in dims:
            solved = cells.withColumn("f", _filling(F.col("tokens"), F.col("rate"), F.col(f"goal_{d}"), [F.col(d)]))
            factor = F.coalesce(F.max("f").over(Window.partitionBy(d)), F.lit(1.0))
            cells = solved.withColumn("rate", F.col("rate") * factor).drop("f")
        cells = written_table(cells)
        gaps = [F.abs(F.sum(kept).over(Window.partitionBy(d)) - F.col(f"goal_{d}")) for d in dims]
        if cells.select(F.greatest(*gaps, F.lit(0.0)).alias("gap")).agg(F.max("gap")).first()[0] <= CLOSE * budget * total:
            break
    return cells.select(*dims, "tokens", F.least(F.lit(1.0), F.col("rate")).alias("prob"))


def margins(raked: DataFrame, dims: tuple[str, ...] = DIMS, powers: dict[str, float] | None = None, weights: dict[str, dict[str, float]] | None = None, budget: float = BUDGET) -> DataFrame:
    """``dim, category, wanted, feasible, achieved``: shares of the kept tokens, over cells with ``tokens, prob``."""
    powers, weights = powers or POWERS, weights or {}
    out = None
    for d in dims:
        now = raked.groupBy(d).agg(F.sum(F.col("tokens") * F.col("prob")).alias("now")).join(targets(raked, d, powers.get(d), weights.get(d), budget), d)
        whole = F.greatest(F.sum("goal").over(Window.partitionBy(F.lit(1))), F.lit(1e-300))
        rows = now.select(F.lit(d).alias("dim"), F.col(d).alias("category"), *[(F.col(c) / whole).alias(a) for c, a in (("wanted", "wanted"), ("goal", "feasible"), ("now", "achieved"))])
        out = rows if out is None else out.unionByName(rows)
    return out


def measured(docs: DataFrame, topic: Column | None = None) -> DataFrame:
    """``docs`` with its tokens and cell in columns of their own; tokens are words, ``topic`` a column (by terms if none is given)."""
    labels = (F.col("source"), F.col("lang"), topic if topic is not None else term_topic(F.col("text")))
    tokens = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return docs.withColumns({"__tokens": tokens} | {f"__{d}": F.coalesce(label.cast("string"), F.lit("(null)")) for d, label in zip(DIMS, labels)})


def drawn(rows: DataFrame, powers: dict[str, float] | None = None, weights: dict[str, dict[str, float]] | None = None, budget: float = BUDGET) -> DataFrame:
    """Rows that are ``measured``, with the probability of their cell and whether they are kept."""
    dims = [f"__{d}" for d in DIMS]
    cells = rows.groupBy(*dims).agg(F.sum("__tokens").alias("tokens"))
    raked = rake(cells, tuple(dims), {f"__{d}": p for d, p in (powers or POWERS).items()}, {f"__{d}": w for d, w in (weights or {}).items()}, budget)
    rates = raked.select(*dims, F.col("prob").alias("__prob"))
    rates = F.broadcast(rates) if raked.count() * 200 <= BROADCAST_BYTES else rates
    return rows.join(rates, dims).withColumn("__kept", (uniform(F.col("doc_id")) < F.col("__prob")).cast("int"))


_ADDED = ("topic", "tokens", "prob", "kept")


def mix(docs: DataFrame, topic: Column | None = None, powers: dict[str, float] | None = None, weights: dict[str, dict[str, float]] | None = None, budget: float = BUDGET) -> DataFrame:
    """``docs`` with ``topic, tokens, prob, kept``, for targets by ``powers`` or by given ``weights`` of a dimension's categories.

    A null source, language or topic is a category of its own, ``(null)``; a document without words has
    no tokens and the probability of its cell; repeated rows are kept or dropped together; an empty table
    gives an empty result; columns of those four names are replaced.
    """
    kept = [c for c in docs.columns if c not in _ADDED]
    out = drawn(measured(docs, topic), powers, weights, budget)
    return out.select(*[F.col(f"`{c}`") for c in kept], *[F.col(f"__{c}").alias(c) for c in _ADDED])


def mixed_documents(docs: DataFrame) -> DataFrame:
    """For every document its cell, tokens, probability and whether it is in the mixture. Texts are read once."""
    rows = written_table(measured(docs.select("doc_id", "text", "source", "lang")).drop("text"))
    return drawn(rows).select("doc_id", "source", "lang", F.col("__topic").alias("topic"), F.col("__tokens").alias("tokens"), F.round("__prob", 6).alias("prob"), F.col("__kept").alias("kept"))


def oracle(documents: str = "documents", budget: float = BUDGET) -> str:
    """The same in DuckDB SQL, all sweeps written out."""
    counts = [" + ".join(f"(strlen(b) - strlen(replace(b, '{t}', ''))) / {len(t)}" for t in terms) + f" AS n{i}" for i, (_, terms) in enumerate(TOPICS[:-1])]
    best = f"greatest({', '.join(f'n{i}' for i in range(len(counts)))}, 0)"
    topic = "CASE " + " ".join(f"WHEN n{i} > 0 AND n{i} = {best} THEN '{name}'" for i, (name, _) in enumerate(TOPICS[:-1])) + f" ELSE '{TOPICS[-1][0]}' END"

    def factor(by: str, goal: str) -> str:
        order = f"OVER ({by} ORDER BY rate DESC ROWS BETWEEN"
        return f"CASE WHEN sum(tokens * rate) {order} CURRENT ROW AND UNBOUNDED FOLLOWING) > 0 THEN ({goal} - coalesce(sum(tokens) {order} UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(tokens * rate) {order} CURRENT ROW AND UNBOUNDED FOLLOWING) END"

    steps = [
        rf"docs AS (SELECT *, coalesce(source, '(null)') AS c_source, coalesce(lang, '(null)') AS c_lang, {topic} AS c_topic FROM (SELECT *, coalesce(len(regexp_extract_all(text, '[^ \t\n\x0B\f\r]+')), 0)::BIGINT AS tokens, {', '.join(counts)} FROM (SELECT *, lower(coalesce(text, '')) AS b FROM {documents})))",
        "cells AS MATERIALIZED (SELECT c_source, c_lang, c_topic, sum(tokens)::DOUBLE AS tokens FROM docs GROUP BY ALL)",
        f"whole AS (SELECT sum(tokens) AS total, {budget} * sum(tokens) AS kept FROM cells)",
    ]
    for d in DIMS:
        steps.append(f"s_{d} AS (SELECT c_{d}, tokens, s, CASE WHEN tokens > 0 THEN s / tokens ELSE 0 END AS rate FROM (SELECT c_{d}, sum(tokens) AS tokens, CASE WHEN sum(tokens) > 0 THEN pow(sum(tokens), {POWERS[d]}) ELSE 0 END AS s FROM cells GROUP BY c_{d}))")
        steps.append(f"g_{d} AS MATERIALIZED (SELECT c_{d}, least(tokens, s * coalesce(max(f) OVER (), 0)) AS goal_{d} FROM (SELECT *, {factor('', 'kept')} AS f FROM s_{d}, whole))")
    steps.append(f"w0 AS MATERIALIZED (SELECT *, CASE WHEN tokens > 0 THEN {budget}::DOUBLE ELSE 0 END AS rate FROM cells {' '.join(f'JOIN g_{d} USING (c_{d})' for d in DIMS)})")
    n = 0
    for _ in range(SWEEPS):
        for d in DIMS:
            steps.append(f"w{n + 1} AS MATERIALIZED (SELECT * EXCLUDE (f) REPLACE (rate * coalesce(max(f) OVER (PARTITION BY c_{d}), 1.0) AS rate) FROM (SELECT *, {factor(f'PARTITION BY c_{d}', f'goal_{d}')} AS f FROM w{n}))")
            n += 1
    steps.append(f"rates AS (SELECT c_source, c_lang, c_topic, least(1.0, rate) AS p FROM w{n})")
    steps.append(f"drawn AS (SELECT d.*, p, (('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':{SEED}'), 1, 8))::UBIGINT / 4294967296.0 < p)::INT AS kept FROM docs d JOIN rates USING (c_source, c_lang, c_topic))")
    return "WITH " + ",\n".join(steps) + "\nSELECT doc_id, source, lang, c_topic AS topic, tokens, round(p, 6) AS prob, kept FROM drawn"
