"""Exact Jaccard similarity join of word-shingle sets as a join in a metric space.

Jaccard distance is a metric, so distances to a pivot bound distances between documents. Equal sets are
one class. The first pivots are single shingles: a class enters the regions of its rarest shingles, of
which two sets that are similar enough share one, and its place in the order of its shingles bounds what
it can share with any other member. Small regions are compared pair by pair within these bounds. Large
ones are split: first by rings of set size (the distance to the pivot decides it), where the members
of the next ring are replicated to the ring below; then by documents as pivots: every member goes to the
Voronoi cell of its nearest pivot, and to the cell of another pivot if the triangle inequality leaves
partners there. Members within the threshold of a pivot are linked to it as a star, and a cell whose
members are known to be in one component is closed; the few members outside of its main component are
compared with all others. Where these are many, but fewer than the main component's, pivots are compared
with members of other components only: distances within a component would decide nothing. Cells recurse
with more pivots until they are small; pivots, compared with all members, leave. ``join_links`` is the complete form: it skips no pair for
being in one component already and returns every link.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.components import components
from corpusmill.llm.shingles import shingle_set, word_hashes
from corpusmill.session import written_table

#: Words of a shingle, and the least similarity in hundredths.
WIDTH, SIMILAR = 5, 80
#: Share of the hash range whose shingles are counted over the corpus; they come first, rarest first, in the order of shingles.
COUNTED = 0.3
#: Members of a region that are compared pair by pair; pivots of a larger one, four times as many in every round.
SMALL_REGION, PIVOTS = 64, 8
#: A region is split only into cells that hold together at most so many times its members; else its pivots leave and it stays.
MOST_REPLICAS = 2.0
#: Ids are broadcast up to so many bytes, counted at 64 bytes each; beyond it they are joined by a shuffle.
BROADCAST_BYTES = 64 << 20
#: Rows of an Arrow batch that a task works on at a time, so that a batch of sets is never held whole.
SLICE = 256


def prefix_length(n: int, similar: int = SIMILAR) -> int:
    """Shingles of which a set of ``n`` must share one with any set that is similar enough."""
    return n - -(-n * similar // 100) + 1


def _sliced(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for at in range(0, len(batch), SLICE):
            yield batch.iloc[at : at + SLICE].reset_index(drop=True)


def _mark(found: np.ndarray) -> bytes:
    if not len(found):
        return b""
    sums = int(found.sum(dtype=np.uint64)), int((found * found).sum(dtype=np.uint64)), int(np.bitwise_xor.reduce(found))
    return ((sums[0] * 0x9E3779B97F4A7C15 + len(found)) % (1 << 64)).to_bytes(8, "little") + ((sums[1] + sums[2]) % (1 << 64)).to_bytes(8, "little")


def _few(ids: DataFrame) -> DataFrame:
    """``ids``, a written table, marked for broadcast if its rows are few enough."""
    return F.broadcast(ids) if ids.count() * 64 <= BROADCAST_BYTES else ids


def signatures(docs: DataFrame, width: int = WIDTH, similar: int = SIMILAR) -> DataFrame:
    """The columns of ``docs`` but ``text``, with ``n``, ``mark`` (128 bits that stand for the set), ``counted`` and ``tokens``.

    ``tokens`` are the shingles in the counted part of the hash range (there are ``counted`` of them), and
    those that follow by hash if these alone are fewer than the set's prefix.
    """
    kept = [f for f in docs.schema.fields if f.name != "text"]
    last = np.uint64(min((1 << 64) - 1, int(COUNTED * (1 << 64))))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in _sliced(batches):
            sizes, marks, counted, tokens = [], [], [], []
            for words in word_hashes(batch["text"].tolist()):
                found = shingle_set(words, width)
                sizes.append(len(found))
                marks.append(_mark(found))
                counted.append(int(np.searchsorted(found, last, "right")))
                tokens.append(found[: max(counted[-1], prefix_length(len(found), similar) if len(found) else 0)].view(np.int64))
            yield pd.concat([batch.drop(columns="text"), pd.DataFrame({"n": sizes, "mark": marks, "counted": counted, "tokens": tokens})], axis=1)

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kept)
    return docs.select(*[F.col(f"`{f.name}`") for f in kept], "text").mapInPandas(run, f"{fields}n bigint, mark binary, counted bigint, tokens array<bigint>")


def _scatter(row: Column, seed: int) -> Column:
    """A number in [0, 1) that decides who is a pivot, the same in every region."""
    return F.pmod(F.xxhash64(row, F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))


#: Members in this order: those that share most of what they have, then by chance; the first is a region's first pivot.
_PLACE = ("own", "h", "row")


def _possible(a: str, b: str, similar: int) -> Column:
    """Whether bounds on what two sets share (``r_a, r_b``: shingles from the region's on) and their sizes allow a link."""
    return (100 + similar) * F.least(f"r_{a}", f"r_{b}") >= similar * (F.col(f"n_{a}") + F.col(f"n_{b}"))


def _regions(heads: DataFrame, similar: int) -> DataFrame:
    """``region, row, n, r, own``: the regions that the sets of ``heads`` enter and share with others.

    ``r`` bounds what the set can share with any other for which this is the first region in common;
    ``own`` is its share (in hundredths) of counted shingles that no other set has.
    """
    tokens = heads.select("row", F.posexplode("tokens").alias("idx", "region"))
    shared = written_table(tokens.groupBy("region").agg(F.count("*").alias("df")).where("df > 1"))
    hits = tokens.join(shared, "region").groupBy("row").agg(F.collect_list(F.struct("idx", "df", "region")).alias("hits"))
    hits = hits.join(heads.select("row", "n", "counted"), "row")
    first = F.array_sort(F.transform(F.filter("hits", lambda x: x["idx"] < F.col("counted")), lambda x: F.struct(x["df"], x["region"])))
    rows = hits.select("row", "n", "counted", first.alias("first"), F.filter("hits", lambda x: x["idx"] >= F.col("counted")).alias("rest")).withColumn("alone", F.col("counted") - F.size("first"))
    # no shingle is at a place from which less than the least similarity is left
    prefix = F.col("n") - F.ceil(F.col("n") * similar / 100) + 1
    placed = F.concat(
        F.transform(F.slice("first", F.lit(1), F.greatest(F.lit(0), prefix - F.col("alone")).cast("int")), lambda x, i: F.struct(x["region"].alias("region"), (F.col("alone") + i).cast("long").alias("pos"))),
        F.transform("rest", lambda x: F.struct(x["region"].alias("region"), x["idx"].cast("long").alias("pos"))),
    )
    own = F.floor(100 * F.col("alone") / F.greatest(F.col("counted"), F.lit(1))).cast("int")
    entered = written_table(rows.select("row", "n", own.alias("own"), F.explode(placed).alias("at")).select("at.region", "row", "n", (F.col("n") - F.col("at.pos")).alias("r"), "own"))
    members = entered.groupBy("region").agg(F.count("*").alias("members")).where("members > 1")
    return written_table(entered.join(members, "region"))


def _sets(docs: DataFrame, table: DataFrame, rows: DataFrame, width: int) -> DataFrame:
    """``row, shingles`` of the wanted rows, from the texts of their documents."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    wanted = written_table(table.join(_few(rows), "row", "left_semi").select("row", "doc_id", "mark"))
    ids = _few(written_table(wanted.select(F.col("doc_id").alias("id")).distinct()))
    texts = docs.select("doc_id", "text").join(ids, F.col("doc_id").eqNullSafe(F.col("id")), "left_semi")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in _sliced(batches):
            found = [shingle_set(w, width) for w in word_hashes(batch["text"].tolist())]
            yield pd.DataFrame({"id": batch["doc_id"], "of": [_mark(f) for f in found], "shingles": [f.view(np.int64) for f in found]})

    made = texts.mapInPandas(run, f"id {kind}, of binary, shingles array<bigint>")
    sets = made.join(_few(wanted), F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("of") == F.col("mark"))).select("row", "shingles")
    # rows of one id and one set, which equal each other, all bring the set
    single = table.groupBy("doc_id", "mark").count().where("count > 1").isEmpty()
    return written_table(sets if single else sets.dropDuplicates(["row"]))


def _compared(pairs: DataFrame, sets: DataFrame, similar: int) -> DataFrame:
    """``a, b, far, linked`` of the pairs; ``far`` is the Jaccard distance."""
    with_a = pairs.select("a", "b").join(sets.select(F.col("row").alias("a"), F.col("shingles").alias("of_a")), "a")
    with_b = with_a.join(sets.select(F.col("row").alias("b"), F.col("shingles").alias("of_b")), "b")
    counted = with_b.select("a", "b", F.size(F.array_intersect("of_a", "of_b")).alias("both"), (F.size("of_a") + F.size("of_b")).alias("sum"))
    return counted.select("a", "b", (1 - F.col("both") / (F.col("sum") - F.col("both"))).alias("far"), (100 * F.col("both") >= similar * (F.col("sum") - F.col("both"))).alias("linked"))


def _ordered(x: str, y: str) -> list[Column]:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def _pairs_within(small: DataFrame, similar: int) -> DataFrame:
    """``a, b, star`` for the possible pairs of regions of bounded size; ``star``: one of them is its region's pivot."""
    member = F.struct(*_PLACE, "n", "r", "native", "far")
    groups = small.groupBy("region").agg(F.array_sort(F.collect_list(member)).alias("m"))
    one = groups.select(F.posexplode("m").alias("i", "x"), "m")
    two = one.where(F.size("m") > F.col("i") + 1).select("i", "x", F.explode(F.slice("m", F.col("i") + 2, F.size("m"))).alias("y"))
    flat = two.select("i", *[F.col(f"{v}.{c}").alias(f"{c}_{v}") for v in "xy" for c in ("row", "n", "r", "native", "far")])
    window = F.coalesce(F.abs(F.col("far_x") - F.col("far_y")) <= _reach(similar), F.lit(True))
    possible = flat.where(_possible("x", "y", similar) & window & (F.col("native_x") | F.col("native_y")))
    return possible.select(*_ordered("row_x", "row_y"), (F.col("i") == 0).alias("star")).groupBy("a", "b").agg(F.max("star").alias("star"))


def _reach(similar: int) -> float:
    return 1 - similar / 100 + 1e-9


def _placed(regions: DataFrame) -> DataFrame:
    """Regions as they are first: every member is native, no distance is known."""
    return regions.withColumn("h", _scatter(F.col("row"), 0)).withColumn("native", F.lit(True)).withColumn("far", F.lit(None).cast("double"))


def _alive(open_regions: DataFrame, similar: int) -> DataFrame:
    """Members that some other one may be linked with: by the least size in the region, and two members at least."""
    least = open_regions.groupBy("region").agg(F.min("n").alias("least"))
    alive = open_regions.drop("members").join(least, "region").where((100 + similar) * F.col("r") >= similar * (F.col("n") + F.col("least"))).drop("least")
    counts = alive.groupBy("region").agg(F.count("*").alias("members"), F.max("native").alias("some")).where("members > 1 and some").drop("some")
    return written_table(alive.join(counts, "region"))


def _rings(large: DataFrame, similar: int) -> DataFrame:
    """Large regions by rings of size; a member is native in its ring and a replica in the ring below."""
    ring = F.floor(F.log("n") / F.lit(math.log(100 / similar) + 1e-9))
    both = large.withColumn("ring", ring).withColumn("lower", F.explode(F.array(F.lit(0), F.lit(1))))
    return both.select(F.xxhash64("region", F.col("ring") - F.col("lower")).alias("region"), "row", "n", "r", "own", "h", (F.col("lower") == 0).alias("native"), F.lit(None).cast("double").alias("far"))


def _rooted(large: DataFrame, roots: DataFrame) -> DataFrame:
    """Members of regions that are in several components, with ``root``, ``main`` (the first pivot's) and ``others`` (members outside of ``main``)."""
    rooted = large.join(roots, "row", "left").withColumn("root", F.coalesce("root", "row"))
    main = rooted.groupBy("region").agg(F.min(F.struct(*_PLACE, "root"))["root"].alias("main"))
    rooted = rooted.join(main, "region")
    others = rooted.where("root <> main").groupBy("region").agg(F.count("*").alias("others"))
    return written_table(rooted.join(others, "region"))


def _apart(pairs: DataFrame, roots: DataFrame | None) -> DataFrame:
    """The pairs ``a, b`` that are not known to be in one component."""
    for side in "ab" if roots is not None else "":
        pairs = pairs.join(roots.select(F.col("row").alias(side), F.col("root").alias(f"root_{side}")), side, "left")
    return (pairs if roots is None else pairs.where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b"))).select("a", "b")


def _pairs_outside(rooted: DataFrame, similar: int) -> DataFrame:
    """``a, b`` for the possible pairs of regions in which a bounded number of members is outside the main component."""
    columns = ("row", "n", "r", "native", "root")
    one = rooted.where("root <> main").select("region", *[F.col(c).alias(f"{c}_x") for c in columns])
    two = rooted.select("region", *[F.col(c).alias(f"{c}_y") for c in columns])
    possible = _possible("x", "y", similar) & (F.col("native_x") | F.col("native_y")) & (F.col("root_x") != F.col("root_y"))
    return one.join(two, "region").where(possible).select(*_ordered("row_x", "row_y")).distinct()


def _with_pivots(large: DataFrame, pivots: int, turn: int) -> DataFrame:
    """``region, row, pivot`` for all members and pivots of large regions; only those of different ``root`` where the region is ``nearly`` one component.

    Pivots are the member that shares most of what it has, and a random few; the same rows in any region they are members of.
    """
    first = large.groupBy("region").agg(F.min(F.struct(*_PLACE))["row"].alias("first"))
    chosen = large.join(first, "region").where((F.col("row") == F.col("first")) | (_scatter(F.col("row"), turn) * F.col("members") < pivots))
    chosen = written_table(chosen.select("region", F.col("row").alias("pivot"), F.col("root").alias("pivots_root")))
    useful = ~F.col("nearly") | (F.col("row") == F.col("pivot")) | (F.col("root") != F.col("pivots_root"))
    return large.select("region", "row", "root", "nearly").join(chosen, "region").where(useful).select("region", "row", "pivot")


def _cells(large: DataFrame, near: DataFrame, distances: DataFrame, similar: int) -> DataFrame:
    """Voronoi cells of large regions, with replicas of boundary members; pivots leave. Regions that are ``nearly`` one component stay whole."""
    both = distances.select(F.col("a").alias("row"), F.col("b").alias("pivot"), "far").unionByName(distances.select(F.col("b").alias("row"), F.col("a").alias("pivot"), "far"))
    known = near.where("row <> pivot").join(both, ["row", "pivot"]).groupBy("region", "row").agg(F.array_sort(F.collect_list(F.struct("far", "pivot"))).alias("p"))
    done = near.where("row = pivot").select("region", "row")
    members = large.drop("root", "main", "others").join(done, ["region", "row"], "left_anti").join(known, ["region", "row"], "left")
    own = F.get("p", F.lit(0))
    # a partner in the cell of another pivot is at most twice the threshold nearer to it; of two cells one takes the replica
    others = F.filter("p", lambda x: (x["pivot"] < own["pivot"]) & (x["far"] - own["far"] <= 2 * _reach(similar)))
    members = members.withColumn("others", F.when(F.col("native"), others).otherwise(F.filter("p", lambda x: (x["pivot"] != own["pivot"]) & (x["far"] - own["far"] <= 2 * _reach(similar)))))
    members = written_table(members.select("region", "row", "n", "r", "own", "h", "native", own.alias("cell"), F.coalesce("others", F.array()).alias("others"), "nearly"))
    split = members.groupBy("region").agg((~F.max("nearly") & (F.sum(F.size("others") + 1) <= MOST_REPLICAS * F.count("*"))).alias("split"))
    members = members.join(split, "region")
    here = F.struct(F.col("cell.far").alias("far"), F.col("cell.pivot").alias("pivot"), F.lit(True).alias("here"))
    there = F.transform("others", lambda x: F.struct(x["far"].alias("far"), x["pivot"].alias("pivot"), F.lit(False).alias("here")))
    cells = members.withColumn("at", F.explode(F.when(F.col("split"), F.concat(F.array(here), there)).otherwise(F.array(here))))
    # a replica of a ring stays one in every cell: it meets natives only
    return cells.select(
        F.when(F.col("split"), F.xxhash64("region", "at.pivot")).otherwise(F.col("region")).alias("region"),
        *("row", "n", "r", "own", "h"),
        (F.col("native") & F.col("at.here")).alias("native"),
        F.when(F.col("split"), F.col("at.far")).alias("far"),
    )


def _links(regions: DataFrame, sets: DataFrame, similar: int, complete: bool) -> DataFrame:
    """Linked pairs ``a, b, far``: all of them (``complete``), or so many that they connect whatever links connect."""
    entered = _placed(regions)
    waiting = written_table(_pairs_within(entered.where(F.col("members") <= SMALL_REGION), similar))
    large = entered.where(F.col("members") > SMALL_REGION)
    if not large.isEmpty():
        # members of large regions enter anew, with all their shingles counted among themselves
        rows = written_table(large.select("row").distinct())
        heads = sets.join(_few(rows), "row", "left_semi").withColumn("n", F.size("shingles").cast("long"))
        again = _placed(_regions(heads.select("row", "n", F.col("n").alias("counted"), F.col("shingles").alias("tokens")), similar))
        large = _alive(_rings(again.where(F.col("members") > SMALL_REGION), similar), similar)
        for small in (again.where(F.col("members") <= SMALL_REGION), large.where(F.col("members") <= SMALL_REGION)):
            waiting = waiting.unionByName(_pairs_within(small, similar))
        waiting = written_table(waiting.groupBy("a", "b").agg(F.max("star").alias("star")))
        large = large.where(F.col("members") > SMALL_REGION)
    pairs, waiting = waiting.where("star").select("a", "b"), waiting.where("not star").select("a", "b")
    found, pivots, turn = None, PIVOTS, 1
    while True:
        some = not large.isEmpty()
        if some:
            # members outside of a main component that has most members are compared with pivots; its own members need no distances
            known = "root" in large.columns
            large = large.withColumn("nearly", F.expr("2 * others <= members") if known else F.lit(False)).withColumn("root", F.col("root" if known else "row"))
            near = written_table(_with_pivots(large, pivots, turn))
            pairs = pairs.unionByName(near.where("row <> pivot").select(*_ordered("row", "pivot"))).distinct()
        distances = written_table(_compared(pairs, sets, similar))
        linked = distances.where("linked").select("a", "b", "far")
        found = linked if found is None else written_table(found.unionByName(linked))
        # what is left of this round is compared in the next one, unless it is known to be in one component
        pairs = waiting
        if complete or found.isEmpty():
            roots = None
        else:
            roots = written_table(components(found).withColumnRenamed("node", "row"))
        pairs = written_table(_apart(pairs, roots))
        if some and roots is not None:
            large = _rooted(large.drop("root", "main", "others"), roots)
            outside = written_table(_pairs_outside(large.where(F.col("others") <= SMALL_REGION), similar))
            large, pairs = large.where(F.col("others") > SMALL_REGION), pairs.unionByName(outside)
        if some:
            large = _alive(_cells(large, near, distances, similar), similar)
            within = written_table(_apart(_pairs_within(large.where(F.col("members") <= SMALL_REGION), similar), roots))
            large, pairs = large.where(F.col("members") > SMALL_REGION), pairs.unionByName(within)
            if roots is not None:  # closed cells need no pivots
                large = _rooted(large, roots)
        waiting = pairs.limit(0)
        if pairs.isEmpty() and large.isEmpty():
            break
        pairs, pivots, turn = pairs.distinct(), 4 * pivots, turn + 1
    return found.groupBy("a", "b").agg(F.min("far").alias("far"))


def _classes(docs: DataFrame, width: int, similar: int, complete: bool) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """Every row's signature, the classes of equal sets (``mark, row, held``), and links between classes (None: no two share a region)."""
    table = written_table(signatures(docs, width, similar).withColumn("row", F.monotonically_increasing_id()))
    classes = written_table(table.where("n > 0").groupBy("mark").agg(F.min("row").alias("row"), F.count("*").alias("held")))
    # copies take no further part; their rows are named, not moved, if they are few enough
    copies = written_table(table.select("row").join(_few(classes.select("row")), "row", "left_anti"))
    heads = table.join(_few(copies), "row", "left_anti").select("row", "n", "counted", "tokens")
    regions = _regions(heads, similar)
    if regions.isEmpty():
        return table, classes, None
    sets = _sets(docs, table, written_table(regions.select("row").distinct()), width)
    return table, classes, _links(regions, sets, similar, complete)


def with_components(docs: DataFrame, width: int = WIDTH, similar: int = SIMILAR) -> DataFrame:
    """The columns of ``docs`` (``doc_id``, ``text`` and any others) but ``text``, with ``n_shingles`` and ``component``, the same number for all rows that links connect.

    A row without words, or with a null text, has no shingle and a null component. Columns named like
    the ones added must not be among the others.
    """
    kept = [f"`{c}`" for c in docs.columns if c != "text"]
    table, classes, found = _classes(docs, width, similar, False)
    named = classes.select("mark", F.col("row").alias("component"))
    if found is not None and not found.isEmpty():
        roots = components(found).select(F.col("node").alias("component"), "root")
        named = named.join(roots, "component", "left").select("mark", F.coalesce("root", "component").alias("component"))
    return table.join(named, "mark", "left").select(*kept, F.col("n").alias("n_shingles"), "component")


def join_classes(docs: DataFrame, width: int = WIDTH, similar: int = SIMILAR) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row of ``docs`` (``doc_id``, ``text``; other columns are left out).

    ``component_id`` is the least ``doc_id`` reachable by links. Documents without words, and null texts,
    have no shingle, no link, and their own id. Rows of equal ``doc_id`` are separate documents that may
    be linked; a null id is never the least. An empty table gives an empty result.
    """
    rows = written_table(with_components(docs.select("doc_id", "text"), width, similar))
    # written, so that a component of very many rows can be split in the join
    least = written_table(rows.where("component is not null").groupBy("component").agg(F.min("doc_id").alias("least")))
    return rows.join(least, "component", "left").select("doc_id", "n_shingles", F.when(F.col("component").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id"))


def join_links(docs: DataFrame, width: int = WIDTH, similar: int = SIMILAR) -> tuple[DataFrame, DataFrame]:
    """All links: ``doc_id, n_shingles, class, n_links`` for every row of ``docs``, and the linked classes ``a, b, far``.

    A class holds the rows of equal sets, and is null for rows without words. Rows of one class are linked
    to each other and to all rows of linked classes (a < b, each pair once); ``n_links`` counts these.
    """
    rows = docs.select("doc_id", "text")
    table, classes, found = _classes(rows, width, similar, True)
    pairs = written_table(found) if found is not None else docs.sparkSession.createDataFrame([], "a bigint, b bigint, far double")
    named = table.select("doc_id", "n", "mark").join(classes.select("mark", F.col("row").alias("class")), "mark", "left")
    held = classes.select("row", "held")
    both = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    others = both.join(held.withColumnRenamed("row", "b"), "b").groupBy("a").agg(F.sum("held").alias("others"))
    counted = held.join(others.withColumnRenamed("a", "row"), "row", "left").select(F.col("row").alias("class"), (F.col("held") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    members = named.join(counted, "class", "left").select("doc_id", F.col("n").alias("n_shingles"), "class", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    return members, pairs


def joined_documents(docs: DataFrame) -> DataFrame:
    return join_classes(docs)


def oracle() -> str:
    """The same in DuckDB SQL, from shingles as text and all pairs that share one; for small tables."""
    return r"""
WITH RECURSIVE cut AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \t\n\x0B\f\r]+'), []) AS w FROM documents),
sets AS (SELECT doc_id, list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM cut),
held AS MATERIALIZED (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
links AS MATERIALIZED (
    SELECT a.doc_id AS a, b.doc_id AS b FROM held a JOIN held b USING (x) WHERE a.doc_id < b.doc_id
    GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
steps AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS d, doc_id AS r FROM documents UNION SELECT d, b FROM reach JOIN steps ON r = a)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id FROM sets JOIN (SELECT d AS doc_id, min(r) AS component_id FROM reach GROUP BY d) USING (doc_id)"""
