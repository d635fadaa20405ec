"""Exact Jaccard join of documents' word shingles in a metric space.

Jaccard distance is a metric.  The join picks pivot documents, puts every
document into the cells of the pivots that could lie near it, and uses the
triangle inequality to test as few pairs as possible:

1.  Every document becomes its sorted set of 64-bit shingle hashes.  A pair
    that links shares all but a known part of both sets, so a document needs
    several of its smallest hashes in some other document; the rest are
    alone.  Equal sets are one node from here on.
2.  Among the remaining nodes, shingles are ordered rarest first.  A pair that
    links shares a shingle in the rare prefixes of both.  The pivot of a
    shingle is the node, of those that have it in their prefix, with the
    smallest share of shingles that no other node has (the centre of a group
    of edited copies has few); every other one joins the pivot's cell with
    its exact distance.  So each pair that links meets in a cell.
3.  A node within the threshold of its pivot links to it.  Inside a cell, a
    pair is tested only if its two distances to the pivot differ by at most
    the threshold, the counts of shingles that others share allow the
    overlap, and the two are not yet in one component.
4.  A cell above ``CELL`` nodes splits again: the unlinked nodes of least
    priority become pivots, all members get exact distances to them, each
    goes to its nearest pivot's region, and by the triangle inequality also
    to every region whose pivot is at most twice the threshold farther away.

Nothing is capped: a cell that no longer shrinks is joined in blocks.

The number of links of a document needs all pairs that link, so it is counted
once the components are known, each of which holds its links whole.  A
component is a cell around its best linked node, and a large one splits into
Voronoi regions as above.  A node is at home in one region, which holds all it
links with.  There its links are the members in its window: two whose distances
to the pivot add up to the threshold at most link without a test, the others
are tested exactly.  Pairs are counted where they meet and never written.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rampart.llm.common import MULT, bounded_broadcast, mix64, partitions, slice_hashes, text_chunks, utf8
from rampart.llm.components import connected_components
from rampart.session import write_table

CELL = 4096           # nodes of a cell that are joined in one task
SPLIT = 16            # pivots of one split
CHUNK = 1 << 20       # bytes of text shingled at once, about 40 times that in memory
SPARE = 20            # one extra prefix shingle for so many in the set
ITEMS = 1 << 21       # shingles of a side of a block whose links are counted in one task


def shingle_sets(texts: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct hashes of all documents, hashes before each document).

    A-Z are lower-cased; words are runs without ASCII white space.  A text
    with fewer than ``words`` words has its whole sequence as one shingle.
    """
    off, data = utf8(texts)
    low = np.where((data >= 0x41) & (data <= 0x5A), data + 32, data).astype(np.uint8)
    word = ~((data == 0x20) | ((data >= 9) & (data <= 13)))
    edge = np.zeros(len(data) + 1, bool)
    edge[off] = True
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = word[:-1], word[1:]
    start = np.flatnonzero(word & (~before | edge[:-1]))
    end = np.flatnonzero(word & (~after | edge[1:])) + 1
    h = slice_hashes(low, start, end)
    begin = np.searchsorted(start, off)
    count = np.diff(begin)
    doc = np.repeat(np.arange(len(count)), count)
    left = begin[doc + 1] - np.arange(len(h))                   # words from here to the document's end
    length = np.minimum(words, np.maximum(count, 1))[doc]       # a short text is one shingle
    at = np.flatnonzero(left >= length)
    out = np.full(len(at), np.uint64(words), np.uint64)
    for j in range(words):
        has = length[at] > j
        out[has] = mix64(out[has] * MULT + h[at[has] + j])
    doc = doc[at]
    order = np.lexsort((out, doc))
    out, doc = out[order], doc[order]
    new = np.ones(len(out), bool)
    new[1:] = (out[1:] != out[:-1]) | (doc[1:] != doc[:-1])
    out, doc = out[new], doc[new]
    return out, np.searchsorted(doc, np.arange(len(count) + 1))


def set_nodes(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """64-bit id of each document's set; 0 for an empty set."""
    size = np.diff(at)
    node = np.zeros(len(size), np.uint64)
    full = np.flatnonzero(size)
    if len(full):
        total = np.add.reduceat(mix64(hashes ^ MULT), at[full])
        node[full] = mix64(total + size[full].astype(np.uint64) * MULT) | np.uint64(1)
    return node


def may_miss(n: np.ndarray, num: int, den: int) -> np.ndarray:
    """Most elements of a set of ``n`` that a linked set can lack."""
    return n - (num * n + den - 1) // den


def spare(n):
    """Shared prefix shingles asked for beyond the first."""
    return (n + SPARE - 1) // SPARE


def _lists(hashes: np.ndarray, at: np.ndarray, size: np.ndarray) -> pa.Array:
    """The first ``size`` hashes of each document as a list array."""
    doc = np.repeat(np.arange(len(size)), np.diff(at))
    keep = np.arange(len(hashes)) - at[doc] < size[doc]
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(size)], pa.int32()),
                                    pa.array(hashes[keep].view(np.int64)))


def signatures(docs: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """(doc_id, n, node, keys): set size, set id, and the prefix in hash order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_chunks(batches, limit=CHUNK):
            hashes, at = shingle_sets(b.column("text"), words)
            n = np.diff(at)
            size = np.minimum(n, may_miss(n, num, den) + spare(n))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(n, pa.int64()), pa.array(set_nodes(hashes, at).view(np.int64)),
                 _lists(hashes, at, size)], ["doc_id", "n", "node", "keys"])

    return docs.mapInArrow(run, "doc_id bigint, n bigint, node bigint, keys array<bigint>")


def full_sets(docs: DataFrame, words: int) -> DataFrame:
    """(node, n, items) of documents, items in ascending hash order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_chunks(batches, limit=CHUNK):
            hashes, at = shingle_sets(b.column("text"), words)
            n = np.diff(at)
            yield pa.RecordBatch.from_arrays(
                [pa.array(set_nodes(hashes, at).view(np.int64)), b.column("node"), pa.array(n, pa.int64()),
                 _lists(hashes, at, n)], ["node", "want", "n", "items"])

    got = docs.mapInArrow(run, "node bigint, want bigint, n bigint, items array<bigint>")
    return got.where("node = want").drop("want")


def survivors(sigs: DataFrame, num: int, den: int) -> DataFrame:
    """(doc_id, node) of one document for each node that may have a link.

    Two linked sets share at least ``spare`` of the smaller one's size in
    both prefixes, and a partner has at least num/den of the own size.
    """
    keys = sigs.where("n > 0").select("doc_id", "node", F.explode("keys").alias("h"))
    shared = (keys.groupBy("h").agg(F.min("node").alias("lo"), F.max("node").alias("hi"))
              .where("lo <> hi").select("h"))
    hits = keys.select("node", "doc_id", "h").join(shared, "h").groupBy("node", "doc_id").agg(F.count(F.lit(1)).alias("hits"))
    one = hits.groupBy("node").agg(F.min_by("hits", "doc_id").alias("hits"), F.min("doc_id").alias("doc_id"))
    least = F.ceil(F.col("n") * num / F.lit(den))
    # rounding in the float product can only lower the bound when taken one down
    need = F.greatest(F.lit(1), F.ceil((least - 1) / F.lit(SPARE)))
    sizes = sigs.where("n > 0").select("doc_id", "node", "n").distinct()
    return one.join(sizes, ["doc_id", "node"]).where(F.col("hits") >= need).select("doc_id", "node")


def rare_prefixes(sets: DataFrame, num: int, den: int) -> DataFrame:
    """(node, n, own, h): each node's rarest shingles that others have too.

    ``own`` counts the shingles that no other node has; they come first in
    the order and fill prefix places without candidates.
    """
    items = sets.select("node", "n", F.explode("items").alias("h"))
    often = items.groupBy("h").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    per = (items.join(often, "h").groupBy("node", "n")
           .agg(F.sort_array(F.collect_set(F.struct("df", "h"))).alias("s")))
    own = F.col("n") - F.size("s")
    size = F.greatest(F.lit(0), F.col("n") - F.floor((F.col("n") * num + den - 1) / F.lit(den)) + 1 - own)
    return per.select("node", "n", own.alias("own"), F.explode(F.slice("s", 1, size.cast("int"))).alias("e")).select(
        "node", "n", "own", F.col("e.h").alias("h"))


def priority():
    return F.struct(F.floor(F.col("own") * 1000 / F.col("n")).alias("share"), F.col("node").alias("node"))


def distances(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Adds ``inter``, the exact overlap of the sets ``a`` and ``b``, and their sizes."""
    left = sets.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("items").alias("sa"))
    right = sets.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("items").alias("sb"))
    both = pairs.join(left, "a").join(right, "b")
    return both.withColumn("inter", F.size(F.array_intersect("sa", "sb")).cast("bigint")).drop("sa", "sb")


def linked(num: int, den: int):
    return F.lit(den) * F.col("inter") >= F.lit(num) * (F.col("na") + F.col("nb") - F.col("inter"))


def distance():
    return 1 - F.col("inter") / (F.col("na") + F.col("nb") - F.col("inter"))


def cell_pairs(cell: pd.DataFrame, other: pd.DataFrame, num: int, den: int) -> pd.DataFrame:
    """Pairs of a node of ``cell`` outside the pivot's component with a node
    of ``other`` that still need a test.

    ``other`` is sorted by distance to the pivot, so a node's window is one
    run of rows; windows are cut by size, by what others share, and by
    component.  Pairs inside the pivot's component need no test, so these
    are all.
    """
    t = 1 - num / den + 1e-9
    b = other.sort_values(["d", "node"], ignore_index=True)
    out = []
    d, n, own, comp, node = (b[c].to_numpy() for c in ("d", "n", "own", "component", "node"))
    for r in cell[cell["component"] != cell["pivot_component"]].itertuples(index=False):
        lo, hi = np.searchsorted(d, [r.d - t, r.d + t], side="left")
        m = n[lo:hi]
        need = num * (r.n + m)                                     # times 1 / (num + den)
        ok = (np.minimum(r.n - r.own, m - own[lo:hi]) * (num + den) >= need) & (comp[lo:hi] != r.component)
        pick = np.flatnonzero(ok) + lo
        if len(pick):
            out.append(np.stack([np.minimum(node[pick], r.node), np.maximum(node[pick], r.node)], 1))
    got = np.concatenate(out) if out else np.zeros((0, 2), np.int64)
    return pd.DataFrame({"a": got[:, 0], "b": got[:, 1]})


def pairs_in_cells(cells: DataFrame, num: int, den: int, cell: int) -> DataFrame:
    """Untested pairs of all cells; a cell above ``cell`` members is dealt to
    blocks, and each pair of its blocks meets in one task."""
    sizes = cells.groupBy("pivot").agg(F.ceil(F.count(F.lit(1)) / F.lit(cell)).cast("int").alias("blocks"))
    dealt = cells.join(sizes, "pivot").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    # block i meets every block j: its rows go to the tasks (i, j) and (j, i)
    meets = dealt.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    meets = meets.withColumn("u", F.least("block", "j")).withColumn("v", F.greatest("block", "j"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        u, v = pdf["u"].iat[0], pdf["v"].iat[0]
        if u == v:
            return cell_pairs(pdf, pdf, num, den)
        a, b = pdf[pdf["block"] == u], pdf[pdf["block"] == v]
        return pd.concat([cell_pairs(a, b, num, den), cell_pairs(b, a, num, den)])

    # an explicit number of partitions, which AQE does not merge into few
    meets = meets.repartition(partitions(cells.sparkSession), "pivot", "u", "v")
    return meets.groupBy("pivot", "u", "v").applyInPandas(run, "a bigint, b bigint").distinct()


def split_cells(cells: DataFrame, sets: DataFrame, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """Voronoi regions of too large cells: (regions, links found).

    The pivots are members that are not in the old pivot's component, the one
    of least priority of each of ``SPLIT`` hash lanes.  Every member goes to its nearest new pivot (ties:
    smaller id) and to each whose distance is within twice the threshold of
    that, so a pair that links is whole in the nearest region of either.
    """
    lane = F.pmod(F.xxhash64("node", F.lit("split")), F.lit(SPLIT))
    fresh = (cells.where("component <> pivot_component").groupBy("pivot", lane.alias("lane"))
             .agg(F.min(priority()).alias("p")).select("pivot", F.col("p.node").alias("b")))
    pairs = cells.withColumnRenamed("node", "a").drop("d").join(fresh, "pivot")
    got = write_table(distances(pairs, sets), "regions")
    links = got.where(linked(num, den) & (F.col("a") != F.col("b"))).select("a", "b")
    near = Window.partitionBy("pivot", "a")
    regions = (got.withColumn("d", distance()).withColumn("home", F.min("d").over(near))
               .where(F.col("d") <= F.col("home") + 2 * (1 - num / den) + 1e-9)
               .select(F.col("b").alias("pivot"), F.col("a").alias("node"), "n", "own", "d").distinct())
    return regions, links


def with_components(cells: DataFrame, comps: DataFrame) -> DataFrame:
    """Current component of each member and of the pivot; a node without links is its own."""
    member = comps.select("node", "component")
    pivot = comps.select(F.col("node").alias("pivot"), F.col("component").alias("pivot_component"))
    out = cells.drop("component", "pivot_component").join(member, "node", "left").join(pivot, "pivot", "left")
    return out.withColumn("component", F.coalesce("component", "node")).withColumn(
        "pivot_component", F.coalesce("pivot_component", "pivot"))


def open_cells(cells: DataFrame) -> DataFrame:
    """Members of the cells that still hold a node outside the pivot's component."""
    still = cells.where("component <> pivot_component").select("pivot").distinct()
    return cells.join(still, "pivot", "left_semi")


def links(sets: DataFrame, num: int, den: int, cell: int = CELL) -> DataFrame:
    """(a, b) links that connect exactly the nodes that the join connects."""
    keys = write_table(rare_prefixes(sets, num, den), "prefixes")
    pivots = keys.groupBy("h").agg(F.min(priority()).alias("p"), F.count(F.lit(1)).alias("m")).where("m > 1")
    members = (keys.join(pivots.select("h", F.col("p.node").alias("b")), "h").where("node <> b")
               .select(F.col("node").alias("a"), "b", "n", "own").distinct())
    tested = write_table(distances(members, sets), "cells")
    found = tested.where(linked(num, den)).select("a", "b")
    cells = tested.select(F.col("b").alias("pivot"), F.col("a").alias("node"), "n", "own", distance().alias("d"))
    size = None
    while True:
        comps = connected_components(found)
        cells = write_table(open_cells(with_components(cells, comps)), "cells")
        large = cells.groupBy("pivot").count().where(F.col("count") > cell).select("pivot")
        total = cells.join(large, "pivot", "left_semi").count()
        if total == 0 or (size is not None and total > 0.9 * size):
            break
        size = total
        regions, more = split_cells(cells.join(large, "pivot", "left_semi"), sets, num, den)
        found = write_table(found.union(more).distinct(), "links")
        cells = cells.join(large, "pivot", "left_anti").select("pivot", "node", "n", "own", "d").union(
            regions.select("pivot", "node", "n", "own", "d"))
    rest = distances(pairs_in_cells(cells, num, den, cell), sets).where(linked(num, den)).select("a", "b")
    return found.union(rest).distinct()


def split_homes(cells: DataFrame, sets: DataFrame, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """Voronoi regions of cells whose links are counted: (regions, cells that stay whole).

    The pivots are the best linked member of each of ``SPLIT`` hash lanes.  A
    member is at home in its nearest pivot's region if it was at home in the
    cell, and a guest wherever the distance is within twice the threshold of
    that.  A cell whose regions do not halve the pairs to look at stays whole.
    """
    lane = F.pmod(F.xxhash64("node", F.lit("split")), F.lit(SPLIT))
    fresh = cells.groupBy("cell", lane.alias("lane")).agg(F.max_by("node", F.struct("degree", "node")).alias("b")).select("cell", "b")
    pairs = cells.withColumnRenamed("node", "a").drop("d").join(fresh, "cell")
    got = distances(pairs, sets).withColumn("d", distance())
    nearest = F.min(F.struct("d", "b")).over(Window.partitionBy("cell", "a"))
    regions = write_table(
        got.withColumn("nearest", nearest).where(F.col("d") <= F.col("nearest.d") + 2 * (1 - num / den) + 1e-9)
        .select("cell", F.concat_ws("/", "cell", "b").alias("region"), F.col("a").alias("node"), "n", "degree", "weight", "d",
                (F.col("home") & (F.col("b") == F.col("nearest.b"))).alias("home")), "regions")
    work = regions.groupBy("cell", "region").agg((F.count_if("home") * F.count(F.lit(1))).alias("pairs"))
    work = work.groupBy("cell").agg(F.sum("pairs").alias("after"))
    was = cells.groupBy("cell").agg((F.count_if("home") * F.count(F.lit(1))).alias("before"))
    halved = write_table(was.join(work, "cell").where("2 * after <= before").select("cell"), "halved")
    return (regions.join(halved, "cell", "left_semi").drop("cell").withColumnRenamed("region", "cell").select(*cells.columns),
            cells.join(halved, "cell", "left_anti"))


def block_counts(home: pd.DataFrame, members: pd.DataFrame, num: int, den: int) -> np.ndarray:
    """Documents among ``members`` that each row of ``home`` links with; a node
    that is its own member counts there too.

    Members are sorted by distance to the pivot, so that a window is one run
    of rows, and so is its part that needs no test.
    """
    t = 1 - num / den
    b = members.sort_values(["d", "node"], ignore_index=True)
    d, n, weight = (b[c].to_numpy() for c in ("d", "n", "weight"))
    before, at = np.r_[0, np.cumsum(weight)], np.r_[0, np.cumsum(n)]
    known, code = np.unique(np.concatenate(b["items"].to_list()), return_inverse=True)
    mark = np.zeros(len(known), np.int32)
    out = np.zeros(len(home), np.int64)
    for i, r in enumerate(home.itertuples(index=False)):
        lo, hi = np.searchsorted(d, [r.d - t - 1e-9, r.d + t + 1e-9])
        sure = min(max(np.searchsorted(d, t - r.d - 1e-9), lo), hi)
        out[i] = before[sure] - before[lo]
        if sure < hi:
            place = np.minimum(np.searchsorted(known, r.items), len(known) - 1)
            place = place[known[place] == r.items]
            mark[place] = 1
            both = np.add.reduceat(mark[code[at[sure]:at[hi]]], at[sure:hi] - at[sure], dtype=np.int64)
            mark[place] = 0
            out[i] += weight[sure:hi][den * both >= num * (r.n + n[sure:hi] - both)].sum()
    return out


def home_counts(cells: DataFrame, sets: DataFrame, num: int, den: int, cell: int) -> DataFrame:
    """(node, found): linked documents of each node at home, itself included.

    A cell is dealt to blocks of about ``cell`` rows and ``ITEMS`` shingles at
    most on either side; each task counts one block of homes in one of members.
    """
    def blocks(rows, items):
        return F.greatest(F.lit(1), F.ceil(rows / F.lit(cell)), F.ceil(items / F.lit(ITEMS))).cast("int")

    sizes = cells.groupBy("cell").agg(blocks(F.count_if("home"), F.sum(F.when(F.col("home"), F.col("n")).otherwise(0))).alias("us"),
                                      blocks(F.count(F.lit(1)), F.sum("n")).alias("vs"))
    rows = cells.join(sizes, "cell").join(sets.select("node", "items"), "node")
    h = F.xxhash64("node", F.lit("block"))
    every = {"us": F.sequence(F.lit(0), F.col("us") - 1), "vs": F.sequence(F.lit(0), F.col("vs") - 1)}
    homes = rows.where("home").withColumn("u", F.pmod(h, F.col("us")).cast("int")).withColumn("v", F.explode(every["vs"]))
    guests = rows.withColumn("v", F.pmod(h, F.col("vs")).cast("int")).withColumn("u", F.explode(every["us"]))
    cols = ["cell", "u", "v", "node", "n", "weight", "d", "items"]
    both = homes.select(*cols, F.lit(True).alias("asks")).union(guests.select(*cols, F.lit(False).alias("asks")))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        home, members = pdf[pdf["asks"]], pdf[~pdf["asks"]]
        if home.empty or members.empty:
            return pd.DataFrame({"node": [], "found": []}, dtype="int64")
        return pd.DataFrame({"node": home["node"].to_numpy(), "found": block_counts(home, members, num, den)})

    both = both.repartition(partitions(cells.sparkSession), "cell", "u", "v")
    got = both.groupBy("cell", "u", "v").applyInPandas(run, "node bigint, found bigint")
    return got.groupBy("node").agg(F.sum("found").alias("found"))


def link_counts(sets: DataFrame, edges: DataFrame, comps: DataFrame, weights: DataFrame, num: int, den: int,
                cell: int = CELL) -> DataFrame:
    """(node, found): documents that a document of the node links with, itself
    included, for all nodes of ``comps``; ``weights`` has the documents of each node."""
    degree = edges.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))
    nodes = write_table(comps.join(degree, "node").join(weights, "node"), "linked")
    centre = nodes.groupBy("component").agg(F.max_by("node", F.struct("degree", "node")).alias("b"))
    cells = write_table(distances(nodes.withColumnRenamed("node", "a").join(centre, "component"), sets)
                        .select(F.col("component").cast("string").alias("cell"), F.col("a").alias("node"), F.col("na").alias("n"),
                                "degree", "weight", distance().alias("d"), F.lit(True).alias("home")), "homes")
    done = []
    while True:
        large = write_table(cells.groupBy("cell").count().where(F.col("count") > cell).select("cell"), "large")
        if large.isEmpty():
            break
        done.append(cells.join(large, "cell", "left_anti"))
        regions, whole = split_homes(cells.join(large, "cell", "left_semi"), sets, num, den)
        done.append(whole)
        cells = write_table(regions, "homes")
    for more in done:
        cells = cells.union(more)
    return home_counts(cells, sets, num, den, cell)


def join(docs: DataFrame, words: int = 4, num: int = 85, den: int = 100, cell: int = CELL, count: bool = False) -> DataFrame:
    """Link documents whose shingle sets have a Jaccard similarity of at least num/den.

    Returns doc_id, n_shingles and component_id (the smallest doc_id
    reachable by links) for every row with an id, and with ``count`` also
    links, the number of other rows that the row links with.  A null or empty text, or
    one without words, has no shingles and links with nothing; equal sets
    link; repeated rows are returned as often as they come; rows without an
    id are left out; other columns are ignored; an empty table gives an empty
    result.  Sets and shingles are compared by 64-bit hashes.
    """
    docs = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    sigs = write_table(signatures(docs, words, num, den), "signatures")
    alive = write_table(survivors(sigs, num, den), "survivors")
    sets = write_table(full_sets(docs.join(bounded_broadcast(alive), "doc_id"), words).dropDuplicates(["node"]), "sets")
    edges = links(sets, num, den, cell)
    if count:
        edges = write_table(edges, "links")
    comps = connected_components(edges)
    plain = sigs.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("weight"))
    group = plain.join(comps, "node", "left").withColumn("component", F.coalesce("component", "node"))
    label = group.groupBy("component").agg(F.min("first").alias("component_id"))
    label = group.join(label, "component").select("node", "component_id", "weight")
    cols = [F.col("n").alias("n_shingles"),
            F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")]
    if count:
        # a node without links to other nodes has its own documents only
        found = link_counts(sets, edges, comps, plain.select("node", "weight"), num, den, cell)
        label = label.join(found, "node", "left")
        cols.append(F.when(F.col("n") > 0, F.coalesce("found", "weight") - 1).otherwise(0).cast("bigint").alias("links"))
    return sigs.select("doc_id", "n", "node").join(label, "node", "left").select("doc_id", *cols)
