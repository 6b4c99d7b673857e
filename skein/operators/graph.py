"""Graphs of links: connected components, and greedy components of bounded size."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from skein.sources.shared import Scratch, written

#: Links for which a file of labels is written.
FILE_ROWS = 1 << 20


def components(edges: DataFrame, left: str = "a", right: str = "b", keep: Scratch | None = None) -> DataFrame:
    """(node, component) for each node of edges; component is the smallest node that it reaches. Repeated edges, edges
    in either direction and self-links make no difference; edges with a null end are left out. keep: what deletes the
    result once its readers are done.

    Rounds of smallest neighbours and pointer jumps. Each round is written to the shared folder, which cuts the lineage.
    Nothing is collected: a round's end is told by whether a label changed. A hub's links are summed up before the
    shuffle, and joins split hot keys (AQE)."""
    ends = edges.select(F.col(left).alias("u"), F.col(right).alias("v")).where("u is not null and v is not null")
    with Scratch(edges.sparkSession) as scratch:
        both = scratch.written(ends.union(ends.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "links")
        files = 1 + both.count() // FILE_ROWS
        step = table = scratch.written(both.groupBy(F.col("u").alias("node")).agg(F.least(F.col("node"), F.min("v")).alias("component")), "labels", files)
        while True:
            # The smallest label among neighbours, then that label's own label.
            near = both.join(step, F.col("v") == F.col("node")).groupBy("u").agg(F.min("component").alias("near"))
            mid = step.join(near, F.col("node") == F.col("u"), "left").select("node", F.col("component").alias("old"), F.least("component", F.coalesce("near", "component")).alias("mid"))
            jump = step.select(F.col("node").alias("via"), F.col("component").alias("far"))
            new = scratch.written(mid.join(jump, F.col("mid") == F.col("via"), "left").select("node", F.least("mid", F.coalesce("far", "mid")).alias("component"), (F.col("old") == F.least("mid", F.coalesce("far", "mid"))).alias("same")), "labels", files)
            scratch.drop(table)
            table, step = new, new.select("node", "component")
            if new.where("not same").isEmpty():
                scratch.release(new, keep)
                return step


def greedy_union(edges: list[tuple[int, int, float]], most: int) -> tuple[dict[int, int], dict[int, int]]:
    """Root and degree of each node: edges join by score (ties by ends) unless a component would outgrow most; edges that
    were rejected count for no degree."""
    parent, size, degree = {}, {}, {}

    def root(x: int) -> int:
        parent.setdefault(x, x)
        size.setdefault(x, 1)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b, _ in sorted(edges, key=lambda e: (-e[2], e[0], e[1])):
        ra, rb = root(a), root(b)
        if ra != rb:
            if most > 0 and size[ra] + size[rb] > most:
                continue
            if size[ra] < size[rb]:
                ra, rb = rb, ra
            parent[rb] = ra
            size[ra] += size[rb]
        degree[a] = degree.get(a, 0) + 1
        degree[b] = degree.get(b, 0) + 1
    return {x: root(x) for x in parent}, degree


def bounded_clusters(nodes: DataFrame, edges: DataFrame, max_size: int = 40) -> DataFrame:
    """(thread_id, number, representative, members): nodes (thread_id, number) in clusters of at most max_size (0: any).

    No edge leaves a connected component, so the greedy order within components gives what the order over all edges
    gives: components are cut up independently, each with its own edges only. The representative has the highest degree;
    ties go to the smaller number, then id."""
    labelled = edges.join(components(edges, "left_id", "right_id"), F.col("left_id") == F.col("node"))

    def cut(pdf: pd.DataFrame) -> pd.DataFrame:
        roots, degree = greedy_union(list(zip(pdf["left_id"], pdf["right_id"], pdf["score"], strict=True)), max_size)
        return pd.DataFrame({"thread_id": list(roots), "root": [roots[x] for x in roots], "degree": [degree.get(x, 0) for x in roots]})

    placed = labelled.select("component", "left_id", "right_id", "score").groupBy("component").applyInPandas(cut, "thread_id long, root long, degree long")
    rows = nodes.select("thread_id", "number").join(placed, "thread_id", "left").select("thread_id", "number", F.coalesce("root", "thread_id").alias("root"), F.coalesce("degree", F.lit(0)).alias("degree"))
    # Read twice below, and components are cut once.
    rows = written(rows, "rooted")
    best = rows.groupBy("root").agg(F.min_by("thread_id", F.struct(-F.col("degree"), "number", "thread_id")).alias("representative"), F.count("*").alias("members"))
    return rows.join(best, "root").select("thread_id", "number", "representative", "members")
