"""Secret scan over an incremental ledger of content-addressed blobs, in SQL functions only.

Every version of a text is a blob, named by its SHA-256. The ledger has a row for each blob and rule
version that were scanned together: ``blob, kind, rule_version, spans``. A run scans only the pairs that
the ledger lacks, each once however many paths hold the blob, and joins the findings back to all paths.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.columns import let
from corpusmill.session import written_table


@dataclass(frozen=True)
class Rule:
    """A kind of secret. ``measured`` is the group whose length must reach ``least`` (0: the whole match).

    Matches are leftmost and non-overlapping; a match that is too short is dropped but still consumes its text.
    """

    kind: str
    pattern: str
    measured: int
    least: int
    version: str = "1"

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


# The patterns and least lengths of the three base kinds.
RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]+", 0, 16),
)

SPANS = "array<struct<start:bigint,stop:bigint>>"


def _java_pattern(rule: Rule) -> str:
    # Runs of one character class match whole or not at all, so their least length can stand in the pattern.
    if rule.kind == "hex":
        return r"[0-9a-f]{16,}"
    if rule.kind == "access":
        return r"AKIA[A-Z0-9]{14,}"
    return rf"(?i:{rule.pattern})"


def _running(values: Column) -> Column:
    """Running sums of an array of numbers.

    An array that grows in a fold is copied at every step, so the fold goes over blocks of about the square
    root of the length, and over the sums of the blocks; no array in a fold is longer than that.
    """

    def sums(part: Column) -> Column:
        start = F.array().cast("array<bigint>")
        return F.aggregate(part, start, lambda acc, x: F.concat(acc, F.array(F.coalesce(F.get(acc, F.size(acc) - 1), F.lit(0)) + x)))

    def joined(blocks: Column) -> Column:
        ends = sums(F.transform(blocks, lambda b: F.get(b, F.size(b) - 1)))
        return F.flatten(F.zip_with(blocks, ends, lambda b, end: F.transform(b, lambda v: v + end - F.get(b, F.size(b) - 1))))

    def cut(values: Column) -> Column:
        width = F.ceil(F.sqrt(F.size(values))).cast("int")
        return F.transform(F.sequence(F.lit(1), F.size(values), width), lambda at: sums(F.slice(values, at, width)))

    return let(values, lambda v: F.when(F.size(v) > 0, let(cut(v), joined)).otherwise(F.array().cast("array<bigint>")))


def spans(text: Column, rule: Rule) -> Column:
    """Start and end (code points, end exclusive) of the matches of a rule.

    Each extracted piece is the gap before a match and the match, anchored at the end of the one before,
    so that running sums of lengths give positions. A text of n characters with m matches takes n + m ** 1.5 steps.
    """
    pattern = _java_pattern(rule)

    def lengths(group: int) -> Column:
        found = F.regexp_extract_all(text, F.lit(rf"(?s)\G(.*?)({pattern})"), F.lit(group))
        return F.transform(found, lambda p: F.length(p).cast("bigint"))

    def located(pieces: Column) -> Column:
        places = F.arrays_zip(pieces.alias("piece"), lengths(1).alias("gap"), lengths(2 + rule.measured).alias("value"), _running(pieces).alias("stop"))
        kept = F.filter(places, lambda x: x["value"] >= rule.least)
        return F.transform(kept, lambda x: F.struct((x["stop"] - x["piece"] + x["gap"]).alias("start"), x["stop"].alias("stop")))

    return F.when(F.regexp_like(text, F.lit(pattern)), let(lengths(0), located)).otherwise(F.array().cast(SPANS))


def blob_name(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def scan(docs: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """New ledger rows ``blob, kind, rule_version, spans`` for the pairs of blob and rule version that ``ledger`` lacks.

    A null text is the empty blob. With an empty table, or one whose pairs are all in the ledger, no row
    results. The text of a blob is scanned once by each rule, whatever its number of copies.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    blobs = docs.select(F.sha2(body, 256).alias("blob"), body.alias("body")).dropDuplicates(["blob"])
    if ledger is None:
        blobs = blobs.withColumn("seen", F.array().cast("array<string>"))
    else:
        seen = ledger.groupBy("blob").agg(F.collect_set(F.concat("kind", F.lit("@"), "rule_version")).alias("seen"))
        blobs = blobs.join(seen, "blob", "left").withColumn("seen", F.coalesce("seen", F.array().cast("array<string>")))
    rows = []
    for rule in rules:
        unseen = ~F.array_contains("seen", rule.name)
        rows.append(F.when(unseen, F.struct(F.lit(rule.kind).alias("kind"), F.lit(rule.version).alias("rule_version"), spans(F.col("body"), rule).alias("spans"))))
    return blobs.select("blob", F.explode(F.array_compact(F.array(*rows))).alias("r")).select("blob", "r.*")


def findings(docs: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """``docs`` with a span array for each kind, from the ledger: findings go back to every path of a blob.

    Only ledger rows of the given rule versions that have findings are joined. A pair that is in the ledger
    twice, as two runs at a time may append it, counts once. Columns of ``docs`` named like a kind are replaced.
    """
    kinds = [r.kind for r in rules]
    now = F.concat("kind", F.lit("@"), "rule_version").isin([r.name for r in rules])
    some = ledger.where(now & (F.size("spans") > 0)).groupBy(F.col("blob").alias("__blob"))
    found = some.agg(*[F.first(F.when(F.col("kind") == k, F.col("spans")), ignorenulls=True).alias(f"__{k}") for k in kinds])
    kept = [c for c in docs.columns if c not in kinds]
    rows = docs.select(*[F.col(f"`{c}`") for c in kept], blob_name(F.col(text)).alias("__blob"))
    # written, so that a blob of very many paths can be split in the join
    joined = rows.join(written_table(found), "__blob", "left")
    return joined.select(*[F.col(f"`{c}`") for c in kept], *[F.coalesce(F.col(f"__{k}"), F.array().cast(SPANS)).alias(k) for k in kinds])


def update_ledger(docs: DataFrame, path: str, **options) -> DataFrame:
    """Scan what the Parquet ledger at ``path`` lacks, append it there, and return the whole ledger."""
    spark = docs.sparkSession
    try:
        ledger = spark.read.parquet(path)
    except Exception as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        ledger = None
    scan(docs, ledger, **options).write.mode("append").parquet(path)
    return spark.read.parquet(path)


def _said(rank: int, kind: str):
    return lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), F.concat_ws(":", F.lit(kind), s["start"].cast("string"), s["stop"].cast("string")).alias("said"))


def listed(rules: tuple[Rule, ...] = RULES) -> Column:
    """All spans of a row as ``kind:start:end``, by start and then by the order of the kinds, comma-joined."""
    every = F.concat(*[F.transform(F.col(r.kind), _said(i, r.kind)) for i, r in enumerate(rules)])
    return F.array_join(F.transform(F.array_sort(every), lambda s: s["said"]), ",")


def secret_documents(docs: DataFrame) -> DataFrame:
    """Digest of an incremental scan: counts by kind, all spans, and their checksum, for every document.

    An earlier run has seen the texts whose blob name starts with 0 to 7, under the present rules but for
    an old version of ``hex``; this run scans what is left. ``scanned`` is how many rules it ran over the
    document's blob.
    """
    slim = docs.select("doc_id", "text")
    first = F.substring(blob_name(F.col("text")), 1, 1) < "8"
    earlier = tuple(Rule(r.kind, r.pattern, r.measured, r.least, "0") if r.kind == "hex" else r for r in RULES)
    ledger = written_table(scan(slim.where(first), rules=earlier))
    new = written_table(scan(slim, ledger))
    scanned = written_table(new.groupBy("blob").agg(F.count("*").cast("int").alias("scanned")))
    found = findings(slim.withColumn("blob", blob_name(F.col("text"))), ledger.unionByName(new)).join(scanned, "blob", "left")
    digest = found.select("doc_id", *[F.size(r.kind).cast("long").alias(f"n_{r.kind}") for r in RULES], listed().alias("spans"), F.coalesce("scanned", F.lit(0)).alias("scanned"))
    return digest.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("spans", 256).alias("base_sha256"), "spans", "scanned")


def oracle() -> str:
    """The digest in DuckDB SQL: each match is where its text first occurs behind the match before it."""
    parts = []
    for rank, r in enumerate(RULES):
        pattern = _java_pattern(r).replace("'", "''")
        parts.append(f"SELECT blob, body, '{r.kind}' AS kind, {rank} AS rank, regexp_extract_all(body, '{pattern}', 0) AS p, regexp_extract_all(body, '{pattern}', {r.measured}) AS v FROM blobs")
    least = " ".join(f"WHEN '{r.kind}' THEN {r.least}" for r in RULES)
    return f"""
WITH RECURSIVE docs AS (SELECT doc_id, coalesce(text, '') AS body, sha256(coalesce(text, '')) AS blob FROM documents),
blobs AS (SELECT blob, any_value(body) AS body FROM docs GROUP BY blob),
matches AS ({' UNION ALL '.join(parts)}),
walk AS (
    SELECT blob, body, kind, rank, p, v, 1 AS i, strpos(body, p[1])::BIGINT - 1 AS start FROM matches WHERE len(p) > 0
    UNION ALL
    SELECT blob, body, kind, rank, p, v, i + 1, start + length(p[i]) + strpos(substr(body, start + length(p[i]) + 1), p[i + 1]) - 1
    FROM walk WHERE i < len(p)),
found AS (SELECT blob, kind, rank, start, start + length(p[i]) AS stop FROM walk WHERE length(v[i]) >= CASE kind {least} END),
by_blob AS (
    SELECT blob, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access,
           count(*) FILTER (WHERE kind = 'hex') AS n_hex, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) AS spans
    FROM found GROUP BY blob)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
       sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans, CASE WHEN blob < '8' THEN 1 ELSE 3 END::INT AS scanned
FROM docs LEFT JOIN by_blob USING (blob)"""
