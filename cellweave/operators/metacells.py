"""Metacells by random walks (walktrap, Pons and Latapy 2005) within groups of cells."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cellweave.operators.modularity import leiden
from cellweave.sources.shared import materialised


def walk_vectors(w: np.ndarray, length: int) -> np.ndarray:
    """Where a walk of `length` steps from each node ends, over the root of the degree there. Each node first gets a loop as
    heavy as its mean edge."""
    w = w.copy()
    count = (w > 0).sum(1)
    w[np.diag_indices(len(w))] += np.where(count > 0, w.sum(1) / np.maximum(count, 1), 1.0)
    degree = w.sum(1)
    step, out = w / degree[:, None], np.eye(len(w))
    for _ in range(length):
        out = out @ step
    return out / np.sqrt(degree)[None]


def agglomerated(w: np.ndarray, groups: int, length: int = 4) -> np.ndarray:
    """Group of each node of a symmetric matrix: neighbouring groups merge, the pair first whose merging raises the summed squared
    distance of walk vectors from their group's mean least (ties by the least members), until `groups` are left or no two
    groups touch. A group's number is its least node."""
    n = len(w)
    vectors, size, alive = list(walk_vectors(w, length)), [1] * n, [True] * n
    near = [set(np.flatnonzero(row).tolist()) - {i} for i, row in enumerate(w)]
    stamp, group = [0] * n, np.arange(n)

    def cost(i: int, j: int) -> float:
        return size[i] * size[j] / (size[i] + size[j]) * float(((vectors[i] - vectors[j]) ** 2).sum()) / n

    heap = [(cost(i, j), i, j, 0, 0) for i in range(n) for j in near[i] if i < j]
    heapq.heapify(heap)
    left = n
    while left > groups and heap:
        _, i, j, si, sj = heapq.heappop(heap)
        if not (alive[i] and alive[j]) or (stamp[i], stamp[j]) != (si, sj):
            continue
        vectors[i] = (size[i] * vectors[i] + size[j] * vectors[j]) / (size[i] + size[j])
        size[i], alive[j] = size[i] + size[j], False
        stamp[i] += 1
        group[group == j] = i
        for k in near[j] - {i}:
            near[k].discard(j)
            near[k].add(i)
        near[i] = (near[i] | near[j]) - {i, j}
        left -= 1
        for k in near[i]:
            a, b = min(i, k), max(i, k)
            heapq.heappush(heap, (cost(a, b), a, b, stamp[a], stamp[b]))
    return group


def metacells(edges: DataFrame, cells: DataFrame, gamma: float, length: int = 4, most: int = 3000) -> DataFrame:
    """MDL08: (grp, cell, metacell, size): each group of cells (cell, grp) cut into floor(cells / gamma) metacells, one at least.

    edges: symmetric (src, dst, weight); those between groups are left out. Walks and merges are those of one group's graph,
    small ones together in tasks of about `most` cells. A group of over `most` cells is first parted into Leiden communities, with
    rising resolution until none is larger, and each is cut by itself. A cell without an edge of positive weight is a metacell of its own, and these
    count towards the number; a group whose graph falls apart has at least as many metacells as parts. A metacell's
    number is its least cell.
    """
    ends = [cells.select(F.col("cell").alias(c), F.col("grp").alias(f"g_{c}")) for c in ("src", "dst")]
    inside = edges.where("src <> dst and weight > 0").join(ends[0], "src").join(ends[1], "dst").where("g_src = g_dst")
    inside = materialised(inside.groupBy("src", "dst").agg(F.sum("weight").alias("weight"), F.first("g_src").alias("grp")))
    placed = materialised(cells.select("cell", "grp", F.lit(0).cast("long").alias("part")))
    resolution = 1.0
    while True:
        sizes = placed.groupBy("grp", "part").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most)
        large = placed.join(sizes.select("grp", "part"), ["grp", "part"], "left_semi")
        if large.isEmpty() or resolution > 1e6:
            break
        sides = [large.select(F.col("cell").alias(c), F.struct("grp", "part").alias(f"p_{c}")) for c in ("src", "dst")]
        own = inside.select("src", "dst", "weight").join(sides[0], "src").join(sides[1], "dst").where("p_src = p_dst")
        found = leiden(own.select("src", "dst", "weight"), (resolution,), passes=1).select("cell", F.col("community").alias("found"))
        # cells without edges in a large group are parts of their own, as they will be metacells
        parted = large.join(found, "cell", "left").select("cell", "grp", F.coalesce("found", "cell").alias("part"))
        placed = materialised(placed.join(large.select("cell"), "cell", "left_anti").select("cell", "grp", "part").union(parted))
        resolution *= 4
    rows = inside.join(placed.select(F.col("cell").alias("src"), "part"), "src").join(placed.select(F.col("cell").alias("dst"), F.col("part").alias("to")), "dst").where("part = to")
    rows = rows.select("grp", "part", "src", "dst", "weight").union(placed.select("grp", "part", F.col("cell").alias("src"), F.col("cell").alias("dst"), F.lit(0.0)))

    def cut(src: np.ndarray, dst: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        names, at = np.unique(src, return_inverse=True)
        if len(names) == 1:
            return names, names
        w = np.zeros((len(names), len(names)))
        np.add.at(w, (at, np.searchsorted(names, dst)), weight)
        core = np.flatnonzero(w.sum(1) > 0)
        wanted = max(1, int(len(names) // gamma))
        group = np.arange(len(names))
        if len(core):
            group[core] = core[agglomerated(w[np.ix_(core, core)], max(1, wanted - (len(names) - len(core))), length)]
        return names, names[group]

    def cut_all(several: pd.DataFrame) -> pd.DataFrame:
        grp, (src, dst, weight) = several["grp"].to_numpy(), (several[c].to_numpy() for c in ("src", "dst", "weight"))
        parts = list(several.groupby(["grp", "part"], dropna=False, sort=False).indices.values())
        cuts = [cut(src[p], dst[p], weight[p]) for p in parts]
        sizes = [len(names) for names, _ in cuts]
        return pd.DataFrame({"grp": np.repeat(grp[[p[0] for p in parts]], sizes), "cell": np.concatenate([c[0] for c in cuts]), "metacell": np.concatenate([c[1] for c in cuts])})

    schema = rows.select("grp", F.col("src").alias("cell"), F.col("src").alias("metacell")).schema
    bins = max(1, -(-placed.count() // most))
    dealt = rows.withColumn("bin", F.pmod(F.xxhash64("grp", "part"), F.lit(bins)))
    out = dealt.groupBy("bin").applyInPandas(cut_all, schema)
    return out.withColumn("size", F.count(F.lit(1)).over(W.partitionBy("metacell")))
