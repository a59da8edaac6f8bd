"""Embedding near-duplicates by NN-descent.

Equal vectors of one label are one node with its number of copies. Each node keeps a list of its LIST nearest nodes
known so far, among those of its label and of cosine FLOOR or more. Lists begin from random projections: nodes are
sorted by the sides they lie on of random hyperplanes, and each meets the BLOCK nodes around it, in TABLES orders. They
are refined by joins of neighbours of neighbours: whoever is in one node's list, or has it in its own, meets all others
there, until a round brings no more links. Then an audit compares a sample of nodes with all of their label; while the
mean share of their links that was found is below RECALL, more orders are added and refined.

A list is saturated when it is full of links: there may be more. Saturated nodes and those linked to them are grouped by
their links, and lists grow to the whole group: its members are compared with each other in tiles of bounded size. Links
are counted there, never listed, so a large group of near copies makes no rows for its pairs; its cosines are all
computed, a number quadratic in the group. Nothing is capped.

Cases: null vectors, those with null or non-finite components, zero vectors and null labels link with nothing; vectors
of different lengths are not compared; repeated rows are copies of each other and count as linked; a null vec_id takes part
but never becomes a component's id unless all its ids are null (kept is then true); other columns are not read; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpuslake.llm.components import components
from corpuslake.llm.runtime import dropped, hot_keys, numbered, salted_join, settled, tune

#: Cosine of a link, and of what a list keeps.
THRESHOLD, FLOOR = 0.93, 0.5
#: Neighbours in a list; nodes that meet in an order; orders that are added at once.
LIST, BLOCK, TABLES = 16, 256, 8
#: A round that brings fewer new links than this share ends the refinement.
LEAST_GAIN = 0.001
#: Nodes of the audit, and the mean share of their links that is asked for.
AUDIT, RECALL = 1000, 0.99
#: Members of a group that meet as many others in one task.
TILE = 512
BITS = 62


def units(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Vectors of one length, as rows of length 1."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    rows = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def runs_of_equal(values: list) -> Iterator[tuple[int, int]]:
    """Ranges of equal neighbours."""
    start = 0
    for i in range(1, len(values) + 1):
        if i == len(values) or values[i] != values[start]:
            yield start, i
            start = i


def comparable() -> Column:
    """Whether a row has a label and a vector of finite components that are not all 0."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite & F.exists("embedding", lambda x: x != 0), F.lit(False))


def nodes_of(vectors: DataFrame) -> DataFrame:
    """node, kind (label and length), label, embedding, copies, least (vec_id): a row for each different vector of a label."""
    same = vectors.filter(comparable()).groupBy("label", "embedding").agg(F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("least"))
    kind = F.concat_ws("/", F.size("embedding").cast("string"), F.col("label").cast("string"))
    return settled(same.select(F.monotonically_increasing_id().alias("node"), kind.alias("kind"), "label", "embedding", "copies", "least"))


EDGE = "u long, v long, cos double"


def listed(u: np.ndarray, v: np.ndarray, cos: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.array(cos, pa.float64())], ["u", "v", "cos"])


def best_of(node: np.ndarray, rows: np.ndarray, floor: float, keep: int) -> pa.RecordBatch:
    """The `keep` nearest of each among all others of some nodes, at cosine floor or more."""
    cos = rows @ rows.T
    np.fill_diagonal(cos, -2)
    if len(node) > keep + 1:
        least = -np.partition(-cos, keep - 1, axis=1)[:, keep - 1 : keep]
        cos[cos < least] = -2
    a, b = np.nonzero(cos >= floor)
    return listed(node[a], node[b], cos[a, b])


def seeded(nodes: DataFrame, tables: range, centres: dict[int, np.ndarray], floor: float, keep: int) -> DataFrame:
    """u, v, cos: neighbours of nodes in the orders of random projections."""
    kind = dict(nodes.dtypes)["embedding"]

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in runs_of_equal(batch.column("kind").to_pylist()):
                part = batch.slice(a, b - a)
                rows = units(part.column("embedding"))
                rows = rows - centres.get(rows.shape[1], 0)
                for table in tables:
                    planes = np.random.RandomState(table).standard_normal((rows.shape[1], BITS))
                    codes = (rows @ planes > 0).astype(np.int64) @ (np.int64(1) << np.arange(BITS - 1, -1, -1))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(codes), table, np.int32)), part.column("kind"), pa.array(codes), part.column("node"), part.column("embedding")], ["table", "kind", "code", "node", "embedding"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def blocks(last: bool) -> Iterator[pa.RecordBatch]:
            rows = pa.concat_tables(held).combine_chunks()
            held.clear()
            keys = list(zip(rows["table"].to_pylist(), rows["kind"].to_pylist(), strict=True))
            for a, b in runs_of_equal(keys):
                for start in range(a, b, BLOCK):
                    end = min(start + BLOCK, b)
                    if end == len(keys) and not last:  # may go on
                        held.append(rows.slice(start))
                    elif end - start > 1:
                        yield best_of(rows["node"].slice(start, end - start).to_numpy(), units(rows["embedding"].slice(start, end - start)), floor, keep)

        for batch in batches:
            held.append(pa.Table.from_batches([batch]))
            if sum(t.num_rows for t in held) >= 4 * BLOCK:
                yield from blocks(False)
        if held:
            yield from blocks(True)

    order = ["table", "kind", "code", "node"]
    coded = nodes.select("node", "kind", "embedding").sortWithinPartitions("kind").mapInArrow(code, f"table int, kind string, code long, node long, embedding {kind}")
    spread = coded.repartitionByRange(*order).sortWithinPartitions(*order)
    return spread.mapInArrow(meet, EDGE)


def nearest(edges: DataFrame, keep: int) -> DataFrame:
    """The lists: each node's `keep` nearest of some edges, each once."""
    place = F.row_number().over(Window.partitionBy("u").orderBy(F.desc("cos"), "v"))
    return edges.dropDuplicates(["u", "v"]).withColumn("place", place).filter(F.col("place") <= keep).drop("place")


def refined(nodes: DataFrame, lists: DataFrame, floor: float, keep: int) -> DataFrame:
    """u, v, cos: pairs of neighbours of one node. A node's neighbours are those in its list and the nearest that list it, 2 * keep in all."""
    both = nearest(lists.unionByName(lists.select(F.col("v").alias("u"), F.col("u").alias("v"), "cos")), 2 * keep)
    both = settled(both.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("u"))).filter(F.col("n") > 1).select("u", "v"))
    vectors = nodes.select(F.col("node").alias("v"), "embedding")
    met = salted_join(both, vectors, ["v"], hot_keys(both, ["v"])[0])

    def local(rows: pa.Table) -> pa.Table:
        return pa.Table.from_batches([best_of(rows["v"].to_numpy(), units(rows["embedding"]), floor, keep)])

    return met.groupBy("u").applyInArrow(local, EDGE)


def links_of(lists: DataFrame, threshold: float) -> DataFrame:
    """left, right: the lists' links, each once, the lesser node on the left."""
    return lists.filter(F.col("cos") >= threshold).select(F.least("u", "v").alias("left"), F.greatest("u", "v").alias("right")).distinct()


def dense_groups(lists: DataFrame, links: DataFrame, threshold: float, keep: int) -> DataFrame | None:
    """node, root: saturated nodes and those linked to them, by group; None if there are none."""
    full = lists.groupBy("u").agg(F.count(F.lit(1)).alias("n"), F.min("cos").alias("least")).filter((F.col("n") >= keep) & (F.col("least") >= threshold))
    full = settled(full.select(F.col("u").alias("node")))
    if full.isEmpty():
        return None
    ends = [links.join(full.withColumnRenamed("node", side), side, "left_semi").select("left", "right") for side in ("left", "right")]
    return settled(components(ends[0].unionByName(ends[1])).select(F.col("class_id").alias("node"), "root"))


def tiled(nodes: DataFrame, groups: DataFrame, threshold: float) -> DataFrame:
    """node, n: links of each member within its group, copies counted."""
    placed = settled(numbered(groups, ["root"], ["node"], "place").withColumn("block", F.floor(F.col("place") / TILE)))
    blocks = placed.groupBy("root").agg((F.max("block") + 1).alias("blocks"))
    members = salted_join(placed, blocks, ["root"], hot_keys(placed, ["root"])[0]).join(nodes.select("node", "embedding", "copies").hint("merge"), "node")
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other")
    dealt = members.select("root", "node", "embedding", "copies", "block", other)
    dealt = dealt.select("root", "node", "embedding", "copies", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))

    def compare(key: tuple, rows: pa.Table) -> pa.Table:
        block, node = rows["block"].to_numpy(), rows["node"].to_numpy()
        vectors, copies = units(rows["embedding"]), rows["copies"].to_numpy()
        i, j = key[1].as_py(), key[2].as_py()
        a, b = np.flatnonzero(block == i), np.flatnonzero(block == j)
        met = vectors[a] @ vectors[b].T >= threshold
        if i == j:
            np.fill_diagonal(met, False)
            return pa.table({"node": node[a], "n": met @ copies[b]})
        return pa.table({"node": np.concatenate([node[a], node[b]]), "n": np.concatenate([met @ copies[b], met.T @ copies[a]])})

    return dealt.groupBy("root", "i", "j").applyInArrow(compare, "node long, n long").groupBy("node").agg(F.sum("n").alias("n"))


def audited(nodes: DataFrame, sample: list, lists: DataFrame, groups: DataFrame | None, threshold: float) -> float:
    """The mean share of their links that the graph has of the sample's nodes (those with links); 1 if none has any."""
    spark = nodes.sparkSession
    kinds: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    for kind in {r["kind"] for r in sample}:
        here = [r for r in sample if r["kind"] == kind]
        kinds[kind] = np.array([r["node"] for r in here]), units(pa.array([r["embedding"] for r in here]))
    shared = spark.sparkContext.broadcast(kinds)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in runs_of_equal(batch.column("kind").to_pylist()):
                if (asked := shared.value.get(batch.column("kind")[a].as_py())) is not None:
                    node = batch.column("node").slice(a, b - a).to_numpy()
                    cos = asked[1] @ units(batch.column("embedding").slice(a, b - a)).T
                    u, v = np.nonzero((cos >= threshold) & (asked[0][:, None] != node[None, :]))
                    yield listed(asked[0][u], node[v], cos[u, v])

    true = nodes.select("node", "kind", "embedding").sortWithinPartitions("kind").mapInArrow(compare, EDGE).select("u", "v")
    names = spark.createDataFrame([(r["node"],) for r in sample], "u long")  # AUDIT rows
    both = lists.filter(F.col("cos") >= threshold).select("u", "v")
    both = both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v"))).join(F.broadcast(names), "u", "left_semi").distinct()
    seen = true.join(both.withColumn("listed", F.lit(1)), ["u", "v"], "left")
    if groups is not None:
        seen = seen.join(groups.select(F.col("node").alias("u"), F.col("root").alias("a")), "u", "left").join(groups.select(F.col("node").alias("v"), F.col("root").alias("b")), "v", "left")
        seen = seen.withColumn("listed", F.coalesce("listed", F.when(F.col("a") == F.col("b"), 1)))
    share = seen.groupBy("u").agg((F.count("listed") / F.count(F.lit(1))).alias("share")).agg(F.avg("share")).first()[0]
    return 1.0 if share is None else share


def graph(nodes: DataFrame, threshold: float, floor: float, keep: int, tables: int, recall: float) -> tuple[DataFrame, DataFrame, DataFrame | None, float]:
    """Lists, links (left, right), dense groups and the recall that the audit found."""
    sample = nodes.select("node", "kind", "embedding").orderBy(F.xxhash64("embedding"), "node").limit(AUDIT).collect()
    centres = {}
    for size in {len(r["embedding"]) for r in sample}:
        centres[size] = units(pa.array([r["embedding"] for r in sample if len(r["embedding"]) == size])).mean(axis=0)
    lists, done, of_links = None, 0, F.count(F.when(F.col("cos") >= threshold, 1)).alias("links")
    while True:
        found = seeded(nodes, range(done, done + tables), centres, floor, keep)
        done += tables
        lists, now = settled(nearest(found if lists is None else lists.unionByName(found), keep), of_links)
        gain = now["links"]
        while gain > LEAST_GAIN * now["links"]:
            last, before = lists, now["links"]
            lists, now = settled(nearest(last.unionByName(refined(nodes, last, floor, keep)), keep), of_links)
            dropped(last)
            gain = now["links"] - before
        links = settled(links_of(lists, threshold))
        groups = dense_groups(lists, links, threshold, keep)
        share = audited(nodes, sample, lists, groups, threshold)
        if share >= recall:
            return lists, links, groups, share


def clustered(vectors: DataFrame, threshold: float = THRESHOLD, floor: float = FLOOR, keep: int = LIST, tables: int = TABLES, recall: float = RECALL) -> DataFrame:
    """vec_id, n_links, component_id, kept and recall (of the audit) of every vector (vec_id, embedding, label)."""
    tune(vectors.sparkSession)
    rows = vectors.select(F.col("vec_id").cast("long"), "embedding", "label")
    nodes = nodes_of(rows)
    lists, links, groups, share = graph(nodes, threshold, floor, keep, tables, recall)
    ends = links.unionByName(links.select(F.col("right").alias("left"), F.col("left").alias("right")))
    counted = []
    if groups is not None:
        roots = [groups.select(F.col("node").alias(side), F.col("root").alias(f"{side}_root")).hint("merge") for side in ("left", "right")]
        ends = ends.join(roots[0], "left", "left").join(roots[1], "right", "left").filter(~F.coalesce(F.col("left_root") == F.col("right_root"), F.lit(False)))
        counted.append(tiled(nodes, groups, threshold))
    copies = nodes.select(F.col("node").alias("right"), "copies")
    counted.append(ends.join(copies.hint("merge"), "right").groupBy(F.col("left").alias("node")).agg(F.sum("copies").alias("n")))
    counts = reduce(DataFrame.unionByName, counted).groupBy("node").agg(F.sum("n").alias("n"))
    classes = components(links).select(F.col("class_id").alias("node"), "root")
    known = nodes.select("node", "label", "embedding", "copies", "least").join(counts, "node", "left").join(classes, "node", "left")
    known = settled(known.select("label", "embedding", "least", F.coalesce("root", "node").alias("root"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    least = known.groupBy("root").agg(F.min("least").alias("component_id"))
    facts = settled(salted_join(known, least, ["root"], hot_keys(known, ["root"])[0]).select("label", "embedding", "n_links", "component_id"))
    dropped(lists, links, nodes, known)
    good = rows.filter(comparable())
    joined = salted_join(good, facts, ["label", "embedding"], hot_keys(good, ["label", "embedding"])[0]).select("vec_id", "n_links", "component_id")
    alone = rows.filter(~comparable()).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    both = joined.unionByName(alone)
    return both.select("*", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"), F.lit(share).alias("recall"))
