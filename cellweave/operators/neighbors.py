"""Neighbour joins: radius joins by grid bins, exact nearest neighbours against a small table or by blocks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cellweave.functions.numeric import euclidean
from cellweave.sources.shared import materialised


def radius_join(points: DataFrame, radius: float, keep_coincident: bool = False) -> DataFrame:
    """JON08, FLT05: (src, dst, distance) of all pairs of points (cell, x, y) at most `radius` apart, both directions.

    Points meet by an equi-join on grid bins of the radius: one side stands in its own bin, the other is copied to the
    nine around it. Coincident points are left out unless keep_coincident is set; self pairs always are.
    """
    return _binned(points.withColumn("_group", F.lit(0)), points.withColumn("_group", F.lit(0)), radius, keep_coincident)


def section_join(points: DataFrame, radius: float, between: float | None = None) -> DataFrame:
    """JON10, FLT07: radius join within sections of points (cell, x, y, section), and with `between` also from each
    section to the next one by number; column same_section tells the two apart."""
    inside = _binned(points.withColumn("_group", F.col("section")), points.withColumn("_group", F.col("section")), radius, False).withColumn("same_section", F.lit(True))
    if between is None:
        return inside
    following = points.select("section").distinct()
    following = following.withColumn("_group", F.lead("section").over(W.orderBy("section"))).where("_group is not null")  # one row per section
    lower = points.join(following, "section")
    across = _binned(lower, points.withColumn("_group", F.col("section")), between, True)
    both = across.union(across.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "distance"))
    return inside.union(both.withColumn("same_section", F.lit(False)))


def _binned(a: DataFrame, b: DataFrame, radius: float, keep_coincident: bool) -> DataFrame:
    at = lambda c: F.floor(F.col(c) / radius)
    left = a.select(F.col("cell").alias("src"), F.col("x").alias("x1"), F.col("y").alias("y1"), "_group", at("x").alias("bx"), at("y").alias("by"))
    around = F.array(*[F.struct((at("x") + i).alias("bx"), (at("y") + j).alias("by")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    right = b.select(F.col("cell").alias("dst"), F.col("x").alias("x2"), F.col("y").alias("y2"), "_group", F.explode(around).alias("b"))
    right = right.select("dst", "x2", "y2", "_group", "b.*")
    distance = F.sqrt((F.col("x1") - F.col("x2")) * (F.col("x1") - F.col("x2")) + (F.col("y1") - F.col("y2")) * (F.col("y1") - F.col("y2")))
    out = left.join(right, ["_group", "bx", "by"]).where("src <> dst").select("src", "dst", distance.alias("distance")).where(F.col("distance") <= radius)
    return out if keep_coincident else out.where("distance > 0")


#: Points of up to so many bytes go to all tasks as they are; beyond it they are dealt into blocks.
BROADCAST_BYTES = 32 << 20
MOST_CENTRES = 4096
#: Vectors of one group of packs; beyond the broadcast, a task takes two groups.
GROUP_BYTES = 32 << 20
#: Rough distances taken at a time, of so many points at most.
_ROUGH, _COLUMNS = 1 << 20, 4096
_FOUND = "src long, dst long, distance double"


def _closest(x: np.ndarray, own: np.ndarray, y: np.ndarray, ids: np.ndarray, k: int, same: bool, bound: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of x, row of y, distance) of the k nearest y of each x by (distance, id), in that order; same: not the own id.

    bound: for each x a distance beyond which nothing is asked for. Squared distances are first taken roughly, as products of
    short floats about the mean of y, _ROUGH at a time; pairs that their error may have put behind the k-th, and all tied with
    it, are then taken exactly. Where the short floats leave too many pairs, long ones take their place.
    """
    out, big = [], float(np.finfo(np.float32).max)
    if not len(own) or not len(ids):
        return np.empty(0, int), np.empty(0, int), np.empty(0)
    width = x.shape[1]
    some = lambda v: (slice(at, at + 2 * _COLUMNS) for at in range(0, len(v), 2 * _COLUMNS))
    with np.errstate(all="ignore"):  # odd values give no numbers, which are near to nothing
        middle = np.nan_to_num(sum(np.where(np.isfinite(y[p]), y[p] / len(y), 0.0).sum(0) for p in some(y)))
        top = max(float(np.max(np.abs(v[p] - middle), where=np.isfinite(v[p]), initial=0.0)) for v in (x, y) for p in some(v))
        unit = 2.0 ** -np.ceil(np.log2(top)) if 0 < top < np.inf else 1.0
        sizes = [np.concatenate([np.where(np.isfinite(v[p]), (v[p] * unit) ** 2, 0.0).sum(1) for p in some(v)]) for v in (x, y)]
        rest = 4 * (width + 4) * np.finfo(float).eps * (sizes[0] + sizes[1].max())

    def factors(kind: type) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a, c = np.empty((len(x), width + 2), kind), np.empty((width + 2, len(y)), kind)
        aa, most = np.empty(len(x)), 0.0
        with np.errstate(all="ignore"):
            for p in some(x):
                part = (x[p] - middle) * unit
                aa[p] = (part * part).sum(1)
                a[p, :width], a[p, width], a[p, width + 1] = -2 * part, aa[p], 1
            for p in some(y):
                part = (y[p] - middle) * unit
                cc = (part * part).sum(1)
                c[:width, p], c[width, p], c[width + 1, p] = part.T, 1, cc
                most = max(most, float(cc.max(where=np.isfinite(cc), initial=0.0)))
            return a, c, 8 * (width + 4) * np.finfo(kind).eps * (aa + most) + rest + 1e-35

    kind: type = np.float32
    left_of, right_of, slack = factors(kind)
    if same:
        by_id = np.argsort(ids, kind="stable")
        first, last = np.searchsorted(ids[by_id], own, "left"), np.searchsorted(ids[by_id], own, "right")
    step = max(1, _ROUGH // min(len(ids), _COLUMNS))
    for lo in range(0, len(own), step):
        part, near = x[lo : lo + step], slack[lo : lo + step]
        limit = np.full(len(part), big)
        if bound is not None:
            with np.errstate(all="ignore"):
                limit = np.fmin(limit, (bound[lo : lo + step] * unit) ** 2 * (1 + 1e-9) + near)
        if same:
            begin, times = first[lo : lo + step], (last - first)[lo : lo + step]
            me = np.repeat(np.arange(len(part)), times)
            mine = by_id[np.repeat(begin, times) + np.arange(len(me)) - np.repeat(np.cumsum(times) - times, times)]
        got, waiting, pairs, again, looked = (np.empty(0, int), np.empty(0, int), np.empty(0)), [], 0, 2 * _COLUMNS, 0
        for at in range(0, len(ids), _COLUMNS):
            with np.errstate(all="ignore"):
                rough = left_of[lo : lo + step] @ right_of[:, at : at + _COLUMNS]
            if same:
                here = (mine >= at) & (mine < at + _COLUMNS)
                rough[me[here], mine[here] - at] = np.inf
            if not at and bound is None and rough.shape[1] >= k:
                cut = np.partition(rough, k - 1, axis=1)[:, k - 1].astype(float)
                limit = np.fmin(limit, cut + near)
            i, j = np.divmod(np.flatnonzero((rough <= np.minimum(limit, big).astype(kind)[:, None]).ravel()), rough.shape[1])
            waiting.append((i, j + at))
            pairs += len(i)
            if pairs > _ROUGH // 4 or at + _COLUMNS >= min(again, len(ids)):
                looked += pairs
                got = _first(part, y, ids, k, got, waiting)
                ends = np.searchsorted(got[0], np.arange(len(part)), "right")
                full = np.flatnonzero(np.diff(ends, prepend=0) == k)
                limit[full] = np.minimum(limit[full], (got[2][ends[full] - 1] * unit) ** 2 * (1 + 1e-9) + near[full])
                waiting, pairs, again = [], 0, max(again, 2 * (at + _COLUMNS))
        out.append((got[0] + lo, got[1], got[2]))
        if kind is np.float32 and looked > 64 * (k + 16) * len(part):
            kind = np.float64
            left_of, right_of, slack = factors(kind)
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def _first(x: np.ndarray, y: np.ndarray, ids: np.ndarray, k: int, got: tuple, waiting: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k nearest pairs of each row of x by (distance, id) among those of `got` and the rows and columns that wait."""
    i, j = (np.concatenate(c) for c in zip(*waiting, strict=True))
    exact = np.empty(len(i))
    for at in range(0, len(i), 16_384):
        piece = slice(at, at + 16_384)
        with np.errstate(all="ignore"):
            exact[piece] = np.sqrt(((x[i[piece]] - y[j[piece]]) ** 2).sum(1))
    real = np.isfinite(exact)
    i, j, exact = i[real], j[real], exact[real]
    i, j, exact = (np.concatenate(c) for c in zip(got, (i, j, exact), strict=True))
    order = np.lexsort((ids[j], exact, i))
    i, j, exact = i[order], j[order], exact[order]
    first = np.arange(len(i)) - np.searchsorted(i, i) < k
    return i[first], j[first], exact[first]


def _ranked(found: DataFrame, k: int) -> DataFrame:
    return found.withColumn("rank", F.row_number().over(W.partitionBy("src").orderBy("distance", "dst"))).where(F.col("rank") <= k)


def nearest(points: DataFrame, queries: DataFrame | None = None, k: int = 10, block_rows: int = 4096, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """JON09, JON12: (src, dst, distance, rank) of the exact k nearest points (cell, v) of each query, by (distance, id).

    Without `queries` all points ask, and a point is not its own neighbour. With a column grp in `points` (and `queries`), only
    points of one group are neighbours. Points of up to broadcast_bytes, which is counted first, go to every task, and the
    queries are not joined or sorted at all. More points are dealt into blocks around centres; each query asks a part of its
    nearest centre's block, and then the blocks that the triangle inequality does not rule out by the k-th distance there.
    Both come to tasks in packs of bounded size. With grp, blocks are dealt by a hash and all blocks of a group meet.
    """
    group = ["grp"] if "grp" in points.columns else []
    size = points.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("width")).first()
    if size["n"] * (size["width"] or 0) * 8 <= broadcast_bytes:
        return _nearest_to_all(points, queries, k, group)
    if group:
        return _nearest_in_groups(points, queries, k, block_rows)
    return _nearest_in_blocks(points, queries, k, block_rows, size["n"], size["width"])


def _nearest_to_all(points: DataFrame, queries: DataFrame | None, k: int, group: list[str]) -> DataFrame:
    rows = points.select("cell", "v", *group).toPandas().sort_values("cell")
    y = np.stack(rows["v"].to_numpy()).astype(float) if len(rows) else np.empty((0, 1))
    given = points.sparkSession.sparkContext.broadcast((rows["cell"].to_numpy(), y, rows["grp"].to_numpy() if group else None))
    asked, same = points if queries is None else queries, queries is None
    tasks = max(1, min(points.sparkSession.sparkContext.defaultParallelism * 4, -(-len(rows) // 128)))

    def run(batches):
        ids, y, of = given.value
        for batch in batches:
            if not len(batch):
                continue
            own, x = batch["cell"].to_numpy(), np.stack(batch["v"].to_numpy()).astype(float)
            parts = [(np.arange(len(own)), np.arange(len(ids)))] if of is None else [(np.flatnonzero(batch["grp"].to_numpy() == g), np.flatnonzero(of == g)) for g in batch["grp"].unique()]
            for at, to in parts:
                i, j, exact = _closest(x[at], own[at], y[to], ids[to], k, same)
                yield pd.DataFrame({"src": own[at][i], "dst": ids[to][j], "distance": exact, "rank": np.arange(len(i)) - np.searchsorted(i, i) + 1})

    return asked.select("cell", "v", *group).repartition(tasks, "cell").mapInPandas(run, f"{_FOUND}, rank int")


def _best(k: int, same: bool):
    def best(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"src": [], "dst": [], "distance": []})
        own, ids = a["cell"].to_numpy(), b["cell"].to_numpy()
        i, j, exact = _closest(np.stack(a["v"].to_numpy()), own, np.stack(b["v"].to_numpy()), ids, k, same)
        return pd.DataFrame({"src": own[i], "dst": ids[j], "distance": exact})

    return best


def _nearest_in_groups(points: DataFrame, queries: DataFrame | None, k: int, block_rows: int) -> DataFrame:
    asked, same = points if queries is None else queries, queries is None
    sizes = points.groupBy("grp").agg(F.ceil(F.count(F.lit(1)) / F.lit(block_rows)).alias("blocks"))
    every, deal = F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), F.pmod(F.xxhash64("cell"), F.col("blocks"))
    target = points.join(sizes, "grp").select("cell", "v", "grp", F.explode(every).alias("qblock"), deal.alias("block"))
    copies = asked.join(sizes, "grp").select(*[F.col(c).alias(c) for c in ("cell", "v", "grp")], deal.alias("qblock"), F.explode(every).alias("block"))
    key = ("grp", "qblock", "block")
    return _ranked(copies.groupBy(*key).cogroup(target.groupBy(*key)).applyInPandas(lambda a, b: _best(k, same)(a, b), _FOUND), k)


def _packed(ids: np.ndarray, x: np.ndarray) -> tuple[bytes, bytes]:
    """Ids and vectors as bytes, the vectors as short floats where these are the same numbers."""
    with np.errstate(over="ignore"):
        short = x.astype(np.float32)
    return ids.astype(np.int64).tobytes(), (short if np.array_equal(short, x, equal_nan=True) else x).tobytes()


def _unpacked(ids: bytes, x: bytes, width: int) -> tuple[np.ndarray, np.ndarray]:
    got = np.frombuffer(ids, np.int64)
    return got, np.frombuffer(x, np.float32 if len(x) == 4 * len(got) * width else np.float64).astype(float).reshape(len(got), width)


def _nearest_in_blocks(points: DataFrame, queries: DataFrame | None, k: int, block_rows: int, n: int, width: int) -> DataFrame:
    """Points and queries lie in packs of about block_rows, those of one centre together. A query's k-th distance in one pack
    of its own centre tells which blocks the triangle inequality leaves open to it. Packs go into groups of GROUP_BYTES at most,
    and each pair of groups that has an open pair of packs is one task: a vector is shuffled once for each group that it meets, and
    only the k nearest of a query come out of a task.
    """
    asked, same, spark = points if queries is None else queries, queries is None, points.sparkSession
    block_rows = max(1, min(block_rows, GROUP_BYTES // (16 * 8 * width)))
    wanted = min(MOST_CENTRES, -(-n // block_rows))
    some = points.where(F.pmod(F.xxhash64("cell"), F.lit(1 << 30)) <= (1 << 30) * min(1.0, 4 * wanted / n)).orderBy(F.xxhash64("cell", F.lit(1))).limit(wanted)
    centres = np.array([r["v"] for r in some.select("v").collect()])  # at most MOST_CENTRES
    given = spark.sparkContext.broadcast(centres)

    def gaps(x: np.ndarray, c: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum((x * x).sum(1)[:, None] + (c * c).sum(1)[None] - 2 * x @ c.T, 0))

    def pieces(x: np.ndarray):
        step = max(1, _ROUGH // len(given.value))
        for lo in range(0, len(x), step):
            yield slice(lo, lo + step), gaps(x[lo : lo + step], given.value)

    def placed(radius):
        def run(batches):
            for batch in batches:
                if len(batch):
                    x, block, gap = np.stack(batch["v"].to_numpy()), np.empty(len(batch), np.int64), np.empty(len(batch))
                    for rows, d in pieces(x):
                        d = d if radius is None else np.where(np.isfinite(radius.value), d, np.inf)
                        block[rows], gap[rows] = d.argmin(1), d.min(1)
                    yield batch.assign(block=block, gap=gap)

        return run

    kind = "cell long, v array<double>, block long, gap double"
    counts = lambda rows, name: rows.groupBy("block").agg(F.max("gap").alias("radius"), F.ceil(F.count(F.lit(1)) / F.lit(block_rows)).cast("int").alias(name))
    own = materialised(points.select("cell", "v").mapInPandas(placed(None), kind))
    stats = materialised(counts(own, "tiles"))
    radius = np.full(len(centres), -np.inf)  # of a block without points
    for r in stats.collect():  # at most MOST_CENTRES
        radius[r["block"]] = r["radius"]
    reach = spark.sparkContext.broadcast(radius)

    def packed(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a):
            return pd.DataFrame({c: [] for c in ("block", "tile", "rows", "ids", "x", "kth", "opens")})
        mine, x = a["cell"].to_numpy(), np.stack(a["v"].to_numpy())
        kth, opens = np.full(len(mine), np.inf), np.zeros(len(centres), bool)
        if len(b):
            i, _, exact = _closest(x, mine, np.stack(b["v"].to_numpy()), b["cell"].to_numpy(), k, same)
            ends = np.searchsorted(i, np.arange(len(mine)), "right")
            full = np.flatnonzero(np.diff(ends, prepend=0) == k)
            kth[full] = exact[ends[full] - 1]
        for rows, d in pieces(x):
            opens |= left_open(d, kth[rows]).any(0)
        ids, data = _packed(mine, x)
        return pd.DataFrame({"block": [a["block"].iloc[0]], "tile": [a["tile"].iloc[0]], "rows": [len(a)], "ids": [ids], "x": [data], "kth": [kth.tobytes()], "opens": [np.flatnonzero(opens)]})

    def left_open(d: np.ndarray, kth: np.ndarray) -> np.ndarray:
        return np.isfinite(reach.value) & (d - reach.value[None] <= kth[:, None] * (1 + 1e-9) + 1e-9 * (1 + d))

    schema = "block long, tile int, rows int, ids binary, x binary, kth binary, opens array<long>"
    deal = lambda c: F.pmod(F.xxhash64("cell"), F.col(c)).cast("int")
    rows = own.join(F.broadcast(stats), "block").withColumn("tile", deal("tiles"))  # at most MOST_CENTRES rows
    if same:
        packs = there = materialised(rows.select("cell", "v", "block", "tile").groupBy("block", "tile").applyInPandas(lambda a: packed(a, a), schema))
    else:
        there = materialised(rows.select("cell", "v", "block", "tile").groupBy("block", "tile").applyInPandas(lambda a: packed(a, a[:0]), schema))
        asking = materialised(asked.select("cell", "v").mapInPandas(placed(reach), kind))
        asking_stats = F.broadcast(materialised(counts(asking, "shares").drop("radius")))
        home = rows.join(asking_stats, "block").withColumn("tile", F.explode(F.expr("filter(sequence(0, shares - 1), t -> t % tiles = tile)")))
        mine = asking.join(asking_stats, "block").withColumn("tile", deal("shares"))
        sides = [d.select(*[F.col(c).alias(c) for c in ("cell", "v", "block", "tile")]).groupBy("block", "tile") for d in (mine, home)]
        packs = materialised(sides[0].cogroup(sides[1]).applyInPandas(lambda a, b: packed(a, b), schema))
    group = F.floor((F.sum("rows").over(W.orderBy("block", "tile")) - 1) / F.lit(16 * block_rows))  # one row a pack
    to = there.select("block", "tile", group.alias("gp"))
    open_ = packs.select("block", "tile", group.alias("gq"), "opens").select(F.col("block").alias("qblock"), F.col("tile").alias("qtile"), "gq", F.explode("opens").alias("block"))
    open_ = materialised(open_.join(to, "block"))
    goes = open_.groupBy(F.col("qblock").alias("block"), F.col("qtile").alias("tile")).agg(F.first("gq").alias("gq"), F.explode(F.collect_set("gp")).alias("gp"))
    comes = open_.groupBy("block", "tile").agg(F.first("gp").alias("gp"), F.explode(F.collect_set("gq")).alias("gq"))

    def met(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out, last, target = [], None, None
        blocks, theirs = b["block"].to_numpy(), list(zip(b["ids"], b["x"], strict=True))
        for q in a.itertuples():
            mine, x = _unpacked(q.ids, q.x, width)
            kth = np.frombuffer(q.kth)
            open_to = np.empty((len(mine), len(theirs)), bool)
            for rows, d in pieces(x):
                open_to[rows] = left_open(d, kth[rows])[:, blocks]
            some = np.flatnonzero(open_to.any(0))
            if not len(some):
                continue
            if open_to[:, some].mean() > 0.5:  # nearly all ask nearly all
                if last is None or not np.array_equal(last, some):
                    last, target = some, [np.concatenate(c) for c in zip(*[_unpacked(*theirs[t], width) for t in some], strict=True)]
                jobs = iter([(np.flatnonzero(open_to.any(1)), *target)])
            else:
                jobs = ((np.flatnonzero(open_to[:, t]), *_unpacked(*theirs[t], width)) for t in some)
            for at, ids, y in jobs:
                i, j, exact = _closest(x[at], mine[at], y, ids, k, same, kth[at])
                out.append(pd.DataFrame({"src": mine[at][i], "dst": ids[j], "distance": exact}))
        return pd.concat(out) if out else pd.DataFrame({"src": [], "dst": [], "distance": []})

    key = ("gq", "gp")
    sides = [d.select(*[F.col(c).alias(c) for c in (*key, *columns)]).groupBy(*key) for d, columns in ((goes.join(packs, ["block", "tile"]), ("ids", "x", "kth")), (comes.join(there, ["block", "tile"]), ("block", "ids", "x")))]
    return materialised(_ranked(sides[0].cogroup(sides[1]).applyInPandas(met, _FOUND), k))


def capped(edges: DataFrame, k: int) -> DataFrame:
    """JON11: at most the k nearest of each source."""
    ranked = edges.withColumn("rank", F.row_number().over(W.partitionBy("src").orderBy("distance", "dst")))
    return ranked.where(F.col("rank") <= k)


def balanced(edges: DataFrame, k: int, most: int) -> DataFrame:
    """MDL14: (src, dst, distance): of candidate neighbours (src, dst, distance), k for each source, or fewer, with no dst chosen by
    over `most` sources.

    Rounds of proposals: a source asks its nearest candidates that have not refused it, up to k at a time; a candidate keeps
    the `most` nearest of those who asked, ties by id, and refuses the others for good. It ends when nobody was refused. The
    result does not depend on the order of rows: no source and candidate would both rather have each other than one they
    have got. A round is two windows, and a row that was refused goes.
    """
    left = materialised(edges.where("src <> dst").select("src", "dst", "distance").distinct())
    nearest_first = W.partitionBy("src").orderBy("distance", "dst")
    closest_first = W.partitionBy("dst").orderBy("distance", "src")
    while True:
        asked = left.withColumn("asks", F.row_number().over(nearest_first) <= k)
        heard = asked.where("asks").withColumn("kept", F.row_number().over(closest_first) <= most)
        told = materialised(heard.select("src", "dst", "distance", "kept"))
        refused = told.where("not kept").select("src", "dst")
        if refused.isEmpty():
            return told.select("src", "dst", "distance")
        left = materialised(left.join(refused, ["src", "dst"], "left_anti"))


def nearest_by_vectors(edges: DataFrame, points: DataFrame) -> DataFrame:
    """JON21, ARR06: edges with the exact distance of their end points' vectors."""
    ends = [points.select(F.col("cell").alias(c), F.col("v").alias(f"v_{c}")) for c in ("src", "dst")]
    return edges.join(ends[0], "src").join(ends[1], "dst").withColumn("distance", euclidean(F.col("v_src"), F.col("v_dst"))).drop("v_src", "v_dst")


def adaptive_parameters(
    cells: DataFrame, distances: DataFrame, least_cells: int = 50, least_samples: int = 1, penalty: tuple[float, float] = (1.2, 3.8),
    candidates: tuple[int, int] = (20, 60), attention: tuple[int, int] = (10, 30),
) -> DataFrame:
    """GRF11: (type, samples, cells, ratio, scattered, penalty, candidate_k, attention_k) of each type by how clumped it lies.

    cells: (cell, sample, type); distances: (cell, all_kth, same_kth), each cell's distance to its kth neighbour among all
    cells of its sample and among those of its type there, null where there are not so many. A sample's ratio for a type
    is the median of same_kth over the median of all_kth; a type of fewer than least_cells there, or of a null kth, is
    left out. Over samples the median weighted by cells counts; log(1 + ratio) is held between its 5 and 95 per cent
    quantiles over types and scaled to 0..1 (0.5 if all are alike), on which the parameters lie, the penalty falling.
    """
    rows = cells.join(distances, "cell")
    whole = rows.groupBy("sample").agg(F.median("all_kth").alias("all_median"))
    each = rows.groupBy("sample", "type").agg(F.count(F.lit(1)).alias("n"), F.median("same_kth").alias("same_median")).where((F.col("n") >= least_cells) & F.col("same_median").isNotNull())
    ratios = each.join(whole, "sample").where("all_median > 0").select("type", "sample", "n", (F.col("same_median") / F.col("all_median")).alias("ratio"))
    order = W.partitionBy("type").orderBy("ratio", "sample")  # one row a sample
    placed = ratios.withColumn("upto", F.sum("n").over(order)).withColumn("all", F.sum("n").over(W.partitionBy("type")))
    half = F.min(F.when(F.col("upto") >= F.col("all") / 2, F.struct("upto", "ratio")))["ratio"]
    types = placed.groupBy("type").agg(F.count(F.lit(1)).alias("samples"), F.sum("n").alias("cells"), half.alias("ratio")).where(F.col("samples") >= least_samples)
    types = types.withColumn("log", F.log1p("ratio"))
    q = types.agg(F.percentile("log", F.array(F.lit(0.05), F.lit(0.95))).alias("q")).select(F.col("q")[0].alias("lo"), F.col("q")[1].alias("hi"))  # one row a type
    score = F.when(F.col("hi") - F.col("lo") <= 1.5e-8 * F.col("lo"), 0.5).otherwise((F.least(F.greatest("log", "lo"), "hi") - F.col("lo")) / (F.col("hi") - F.col("lo")))
    types = types.join(F.broadcast(q)).withColumn("scattered", score)
    again = types.agg(F.percentile("scattered", F.array(F.lit(0.05), F.lit(0.95))).alias("q")).select(F.col("q")[0].alias("a"), F.col("q")[1].alias("b"))
    types = types.join(F.broadcast(again)).withColumn("s", F.when(F.col("b") - F.col("a") <= 1.5e-8, 0.5).otherwise((F.least(F.greatest("scattered", "a"), "b") - F.col("a")) / (F.col("b") - F.col("a"))))
    between = lambda ends, s: ends[0] + s * (ends[1] - ends[0])
    return types.select(
        "type", "samples", "cells", "ratio", "scattered", between(penalty, 1 - F.col("s")).alias("penalty"),
        F.bround(between(candidates, F.col("s"))).cast("int").alias("candidate_k"), F.bround(between(attention, F.col("s"))).cast("int").alias("attention_k"),
    )
