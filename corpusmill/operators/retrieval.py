"""Vector ranking, reciprocal-rank fusion, related documents and the two-hop neighbourhood."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusmill.functions.text import chunk_snippet
from corpusmill.functions.vectors import cosine, cosine_to, for_ranking
from corpusmill.operators import fulltext
from corpusmill.operators.ranking import head, numbered, places, sortable
from corpusmill.session import written_table

#: Constant of reciprocal-rank fusion.
RRF = 60
HOP_ONE, HOP_TWO = 10, 5


def best_chunks(chunks: DataFrame, similarity: Column) -> DataFrame:
    """``document_id, sim, ordinal, text`` of each document's most similar chunk; ties by ordinal.

    An aggregate with map-side partial results, not a window: only the best chunk of a document in each task is shuffled.
    """
    kept = ["sim", "ordinal", *(["text"] if "text" in chunks.columns else [])]
    scored = chunks.where(F.col("embedding").isNotNull()).withColumn("sim", similarity).select("document_id", *kept)
    order = F.struct(for_ranking(F.col("sim")), -F.col("ordinal"))
    best = scored.groupBy("document_id").agg(F.max_by(F.struct(*kept), order).alias("b"))
    return best.select("document_id", "b.*")


def _on_visible(docs: DataFrame, chunks: DataFrame, visible: Column) -> DataFrame:
    return chunks.join(docs.where(visible).select(F.col("id").alias("document_id")), "document_id", "left_semi")


def vector_search(docs: DataFrame, chunks: DataFrame, query: list[float], visible: Column) -> DataFrame:
    """Every visible document with a vector, its best chunk and its rank; ties by id, undefined similarity last."""
    best = best_chunks(_on_visible(docs, chunks, visible), cosine_to(query)(F.col("embedding")))
    return numbered(best, F.col("sim"), "document_id", "vector_rank")


def fused(lexical: DataFrame, vector: DataFrame) -> DataFrame:
    """Full outer join of two ranked lists by ``document_id``, with the sum of 1 / (60 + rank)."""
    joined = lexical.join(vector, "document_id", "full_outer")
    part = [F.coalesce(1.0 / (RRF + F.col(r)), F.lit(0.0)) for r in ("fts_rank", "vector_rank")]
    return joined.withColumn("score", part[0] + part[1])


def fused_top(lexical: DataFrame, vector: DataFrame, limit: int) -> list[tuple[int, float, int | None, int | None]]:
    """``document_id, score, fts_rank, vector_rank`` of the first ``limit`` rows of the fusion, from the heads of both lists.

    ``lexical`` has ``document_id, score``, ``vector`` ``document_id, sim``; both are read several times. A
    list with ``limit`` rows or more gives each of its first ``limit`` at least 1 / (60 + limit). A document
    beyond place d of both lists gets at most 2 / (61 + d), which is less for d = 60 + 2 * limit. So the
    heads of that depth hold every document of the result; their places in the other list are counted.
    """
    depth = RRF + 2 * limit
    lists = ((lexical, "score"), (vector, "sim"))
    heads = [head(rows, score, "document_id", depth) for rows, score in lists]
    ranks = [{i: n for n, (_, i) in enumerate(h, start=1)} for h in heads]
    for n, (rows, score) in enumerate(lists):
        elsewhere = [i for i in ranks[1 - n] if i not in ranks[n]]
        if len(heads[n]) == depth and elsewhere:  # a shorter list was seen as a whole
            keys = rows.where(F.col("document_id").isin(elsewhere)).select(sortable(F.col(score)).alias("s"), "document_id").collect()
            ranks[n] |= places(rows, score, "document_id", [(r["s"], r["document_id"]) for r in keys])
    found = [(i, sum(1.0 / (RRF + r[i]) for r in ranks if i in r), ranks[0].get(i), ranks[1].get(i)) for i in {*ranks[0], *ranks[1]}]
    return sorted(found, key=lambda f: (-f[1], f[0]))[:limit]


def hybrid_search(docs: DataFrame, chunks: DataFrame, query: str, vector: list[float] | None, visible: Column, limit: int = 20, index=None) -> DataFrame:
    """BM25 and vector ranks fused; the snippet is that of the best chunk where there is one, else the best window of the text.

    ``index`` is a stored index of ``docs`` (``text_index.TextIndex``); without one the texts are read. A
    query without a term has no result, whatever the vectors say. ``limit`` 0 is empty, below 0 an error.
    """
    if limit < 0:
        raise ValueError("limit must not be negative")
    hits = index.search(docs, query, visible) if index is not None else fulltext.search(docs, query, visible)
    lexical = written_table(hits.select(F.col("id").alias("document_id"), "score"))
    if vector is not None and fulltext.query_phrases(query):
        best = best_chunks(_on_visible(docs, chunks, visible).drop("text"), cosine_to(vector)(F.col("embedding")))
        nearest = written_table(best.select("document_id", "sim", "ordinal"))
    else:
        nearest = chunks.select("document_id", F.lit(0.0).alias("sim"), "ordinal").limit(0)
    top = fused_top(lexical, nearest, limit)
    rows = docs.sparkSession.createDataFrame(top, "document_id bigint, score double, fts_rank int, vector_rank int").coalesce(1)
    ids = [t[0] for t in top]
    here = F.col("document_id").isin(ids)
    texts = chunks.where(here).select("document_id", "ordinal", "text").join(F.broadcast(nearest.where(here).select("document_id", "ordinal")), ["document_id", "ordinal"])
    about = docs.where(F.col("id").isin(ids)).select(F.col("id").alias("document_id"), "title", "url", "source", *[F.col(c).alias(f"__{c}") for c in fulltext.COLUMNS])
    found = about.join(F.broadcast(rows), "document_id").join(F.broadcast(texts), "document_id", "left")  # at most ``limit`` rows
    window = fulltext.window_snippet(query)(F.array(*[F.col(f"__{c}") for c in fulltext.COLUMNS]))
    return found.select("document_id", "title", "url", "source", F.coalesce(chunk_snippet(F.col("text")), window).alias("snippet"), "score", "fts_rank", "vector_rank").orderBy(F.col("score").desc(), "document_id")


def centroids(chunks: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """``document_id, centroid``: mean vector of each document's chunks, averaged by position."""
    rows = chunks.where(F.col("embedding").isNotNull())
    rows = rows.join(F.broadcast(ids), "document_id", "left_semi") if ids is not None else rows
    parts = rows.select("document_id", F.posexplode("embedding").alias("pos", "x"))
    means = parts.groupBy("document_id", "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    ordered = means.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("v"))
    return ordered.select("document_id", F.transform("v", lambda p: p["x"]).alias("centroid"))


def related(docs: DataFrame, chunks: DataFrame, anchors: DataFrame, visible: Column, k: int) -> DataFrame:
    """``anchor, document_id, score, rank``: the ``k`` nearest visible documents of each anchor's centroid.

    ``anchors`` (``document_id``) is a query set of known small size: its centroids are broadcast, chunks
    are scanned once, and of each anchor only the best ``k`` reach the last window.
    """
    targets = chunks.join(docs.where(visible).select(F.col("id").alias("document_id")), "document_id", "left_semi").where(F.col("embedding").isNotNull())
    points = centroids(chunks, anchors).select(F.col("document_id").alias("anchor"), "centroid")
    pairs = targets.crossJoin(F.broadcast(points)).where(F.col("document_id") != F.col("anchor"))
    best = pairs.groupBy("anchor", "document_id").agg(F.max(for_ranking(cosine(F.col("embedding"), F.col("centroid")))).alias("score"))
    order = Window.partitionBy("anchor").orderBy(F.col("score").desc(), "document_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def two_hops(docs: DataFrame, chunks: DataFrame, anchor: int, visible: Column, index=None) -> tuple[DataFrame, DataFrame]:
    """Nodes (``id, hop``) and edges (``source, target``) around an anchor: 10 related ones, and 5 of each of these.

    A node keeps its shortest distance; of the two directions of an edge the first one found stays.
    ``index`` is a stored index of the chunks' vectors (``vector_index.VectorIndex``); without one all chunks are scanned.
    """

    def near(anchors: DataFrame, k: int) -> DataFrame:
        return related(docs, chunks, anchors, visible, k) if index is None else index.nearest(docs, anchors, visible, k).rows

    start = docs.sparkSession.range(anchor, anchor + 1).select(F.col("id").alias("document_id"))
    # at most HOP_ONE rows, written so that the branches below do not find them again
    one = written_table(near(start, HOP_ONE).coalesce(1)).select(F.col("anchor").alias("source"), F.col("document_id").alias("target"), F.col("rank"), F.lit(0).alias("turn"), F.lit(1).alias("hop"))
    first = one.select(F.col("target").alias("document_id"), F.col("rank").alias("of"))
    two = near(first.select("document_id"), HOP_TWO)
    two = two.join(F.broadcast(first.withColumnRenamed("document_id", "anchor")), "anchor").select(F.col("anchor").alias("source"), F.col("document_id").alias("target"), "rank", F.col("of").alias("turn"), F.lit(2).alias("hop"))
    every = one.unionByName(two)
    root = start.select(F.col("document_id").alias("id"), F.lit(0).alias("hop"))
    found = every.select(F.col("target").alias("id"), "hop").unionByName(root).groupBy("id").agg(F.min("hop").alias("hop"))
    nodes = found.join(every.limit(1).select(F.lit(1).alias("any")), F.lit(True), "left_semi")
    pair = Window.partitionBy(F.least("source", "target"), F.greatest("source", "target")).orderBy("turn", "rank")
    edges = every.where("source <> target").withColumn("n", F.row_number().over(pair)).where("n = 1").select("source", "target")
    return nodes, edges


def radial_layout(nodes: DataFrame, order: DataFrame) -> DataFrame:
    """``id, hop, x, y`` on rings about (300, 300): radius 140 and 260, evenly spread in ``order`` (``id, position``)."""
    placed = nodes.join(order, "id", "left")
    ring = Window.partitionBy("hop")
    number = F.row_number().over(ring.orderBy(F.coalesce("position", F.lit(0)), "id")) - 1
    angle = 2 * F.pi() * F.col("number") / F.col("of") - F.pi() / 2
    radius = F.when(F.col("hop") == 0, 0).when(F.col("hop") == 1, 140).otherwise(260)
    rows = placed.withColumn("number", number).withColumn("of", F.count("*").over(ring))
    return rows.select("id", "hop", (300 + radius * F.cos(angle)).alias("x"), (300 + radius * F.sin(angle)).alias("y"))
