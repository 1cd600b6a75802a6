"""Graphs as edge tables (src, dst): reachability, order, components, merging of edge lists.

Loops write each round to the shared folder; a round is a few joins on node keys, and nothing of the graph comes to the driver
but counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedgewing.scratch import written


#: So many tables of levels, or of tables put together as often, become one.
MOST_TABLES = 8


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def reachable(edges: DataFrame, roots: DataFrame, most_rounds: int | None = None, both_ways: bool = False, stored: bool = False, hint: str | None = None) -> DataFrame:
    """(node, depth): all nodes that the roots (node) reach, with the least number of edges; the roots are among them. With ``both_ways``
    an edge leads either way. The edges are written once (``stored``: they are already), each level once and then only as often as tables
    of levels are put together. ``hint`` is the strategy of the joins, if not the planner's."""
    pairs = edges.select("src", F.col("dst").alias("node")).filter("src IS NOT NULL AND node IS NOT NULL")
    pairs = pairs if stored else written(pairs, "edges")
    ways = [pairs, pairs.select(F.col("node").alias("src"), F.col("src").alias("node"))] if both_ways else [pairs]
    hinted = lambda d: d.hint(hint) if hint else d
    front = written(roots.select("node").distinct().withColumn("depth", F.lit(0)), "front")
    seen, depth = [(1, front)], 0
    while most_rounds is None or depth < most_rounds:
        depth += 1
        near = hinted(front.select(F.col("node").alias("src")))
        step = _union([near.join(w, "src").select("node") for w in ways]).distinct()
        step = step.join(hinted(_union([d for _, d in seen]).select("node")), "node", "left_anti")
        front = written(step.withColumn("depth", F.lit(depth)), "front")
        if front.isEmpty():
            break
        seen.append((1, front))
        while len(seen) >= MOST_TABLES and seen[-1][0] == seen[-MOST_TABLES][0]:
            seen[-MOST_TABLES:] = [(seen[-1][0] * MOST_TABLES, written(_union([d for _, d in seen[-MOST_TABLES:]]), "reached"))]
    return _union([d for _, d in seen])


def levels(edges: DataFrame, nodes: DataFrame) -> tuple[bool, DataFrame]:
    """(whether there is no cycle, (node, level)): peeling of nodes without a predecessor; nodes on or behind a cycle have no row."""
    left, rest = written(nodes.select("node").distinct(), "nodes"), written(edges.select("src", "dst").distinct(), "edges")
    out, level = None, 0
    while True:
        free = left.join(rest.select(F.col("dst").alias("node")), "node", "left_anti")
        free = written(free.withColumn("level", F.lit(level)), "level")
        if free.isEmpty():
            break
        out = free if out is None else out.unionByName(free)
        left = written(left.join(free, "node", "left_anti"), "nodes")
        rest = written(rest.join(free.select(F.col("node").alias("src")), "src", "left_anti"), "edges")
        level += 1
    acyclic = left.isEmpty()
    return acyclic, out if out is not None else left.withColumn("level", F.lit(0)).limit(0)


def topological_positions(edges: DataFrame, nodes: DataFrame) -> tuple[bool, DataFrame]:
    """(whether there is no cycle, (node, position)): by level, then by node."""
    from sedgewing.operators.ordered import numbered

    acyclic, found = levels(edges, nodes)
    return acyclic, numbered(found, ["level", "node"], "position").select("node", "position")


def _on_cycles(edges: DataFrame) -> DataFrame:
    """edges without those that begin where none ends or end where none begins; again while more than a tenth goes."""
    left = edges.count()
    while left:
        before = left
        behind, ahead = edges.select(F.col("dst").alias("src")).distinct(), edges.select(F.col("src").alias("dst")).distinct()
        edges = written(edges.join(behind.hint("merge"), "src", "left_semi").join(ahead.hint("merge"), "dst", "left_semi").select("src", "dst"), "edges")
        left = edges.count()
        if before - left <= before // 10:
            break
    return edges


def strong_components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, component): the least node of each strongly connected component. Every round colours each node of the edges that may lie on
    a cycle with the least node that reaches it; the nodes of a colour from which its name can be reached back are a component. A node
    of none is its own. The joins shuffle their sides: small ones would come to the driver in every round to be broadcast."""
    rest = written(edges.select("src", "dst").filter("src <> dst").distinct(), "edges")
    done = []
    while True:
        rest = _on_cycles(rest)
        if rest.isEmpty():
            break
        ends = rest.select(F.col("src").alias("node")).union(rest.select("dst")).distinct()
        colour = written(ends.withColumn("colour", F.col("node")), "colour")
        while True:
            ahead = rest.join(colour.select(F.col("node").alias("src"), "colour").hint("merge"), "src").select(F.col("dst").alias("node"), "colour", F.lit(None).cast(rest.schema["dst"].dataType).alias("_was"))
            now = ahead.unionByName(colour.withColumn("_was", F.col("colour"))).groupBy("node").agg(F.min("colour").alias("colour"), F.min("_was").alias("_was"))
            now = written(now, "colour")
            colour = now.select("node", "colour")
            if now.filter("colour < _was").isEmpty():
                break
        side = lambda end: colour.select(F.col("node").alias(end), F.col("colour").alias(f"_{end}")).hint("merge")
        inner = written(rest.join(side("src"), "src").join(side("dst"), "dst").filter("_src = _dst").select("src", "dst"), "inner")
        back = inner.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        found = reachable(back, colour.filter("node = colour").select("node"), stored=True, hint="merge")
        closed = written(found.select("node").join(colour.hint("merge"), "node").select("node", F.col("colour").alias("component")), "closed")
        done.append(closed)
        gone = lambda end: closed.select(F.col("node").alias(end)).hint("merge")
        rest = written(inner.join(gone("src"), "src", "left_anti").join(gone("dst"), "dst", "left_anti").select("src", "dst"), "edges")
    nodes = nodes.select("node").filter("node IS NOT NULL").distinct()
    if not done:
        return nodes.select("node", F.col("node").alias("component"))
    return nodes.join(_union(done).hint("merge"), "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def merged_edges(*parts: DataFrame) -> DataFrame:
    """(a, b, c): edge lists with counts put together; loops are dropped."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.filter("a <> b").groupBy("a", "b").agg(F.sum("c").cast("long").alias("c"))


def adjacency(edges: DataFrame) -> DataFrame:
    """(src, targets): the sorted neighbours of each node."""
    return edges.groupBy("src").agg(F.array_sort(F.collect_list("dst")).alias("targets"))


def contained(overlaps: DataFrame, reads: DataFrame) -> DataFrame:
    """Reads (read_id, rlen) that lie in another whole: an overlap covers all of a."""
    a = overlaps.join(reads.select(F.col("read_id").alias("aread"), F.col("rlen").alias("alen")), "aread").filter("abpos = 0 AND aepos = alen AND aread <> bread")
    return a.select(F.col("aread").alias("read_id")).distinct()


def reduction_order(edges: DataFrame) -> DataFrame:
    """Edges in the order in which transitive ones are looked for: dovetails first, then by weight."""
    return edges.orderBy(F.col("dovetail").desc(), "w", "src", "dst")


def transitively_reduced(edges: DataFrame) -> DataFrame:
    """Edges (src, dst, w) without those that two edges replace whose weights are smaller."""
    e = edges.select("src", "dst", "w")
    two = e.select(F.col("src"), F.col("dst").alias("_m"), F.col("w").alias("_w1")).join(e.select(F.col("src").alias("_m"), "dst", F.col("w").alias("_w2")), "_m")
    longer = two.groupBy("src", "dst").agg(F.min(F.greatest("_w1", "_w2")).alias("_w"))
    return e.join(longer, ["src", "dst"], "left").filter(F.col("_w").isNull() | (F.col("_w") >= F.col("w"))).select("src", "dst", "w")


def string_edges(overlaps: DataFrame, alen: int | Column, blen: int | Column) -> DataFrame:
    """(from_id, to_id, to_begin, weight): edges from the end of a read to one that goes on behind it, by the bases that it adds;
    to_begin is false where the other read is turned round. Of several overlaps the one that adds least counts."""
    a, b = (x if isinstance(x, Column) else F.lit(x) for x in (alen, blen))
    on = overlaps.filter((F.col("aepos") == a) & (F.col("bepos") < b))
    return on.groupBy(F.col("aread").alias("from_id"), F.col("bread").alias("to_id"), (~F.col("inv")).alias("to_begin")).agg(F.min(b - F.col("bepos")).alias("weight"))


def compared(edges: DataFrame, wanted: DataFrame) -> DataFrame:
    """One row (missing, unfounded): edges that the graph lacks, and those that nothing calls for."""
    missing = wanted.exceptAll(edges).agg(F.count(F.lit(1)).alias("missing"))
    return missing.crossJoin(F.broadcast(edges.exceptAll(wanted).agg(F.count(F.lit(1)).alias("unfounded"))))  # one row each
