"""Near-duplicate vectors by a robust-pruned flat graph.

Vectors are compared within their group (a label) only. A group of many vectors is dealt into overlapping shards: around
centres fitted on a bounded sample, each vector has its nearest centre as its home and is copied to every other shard whose
cell may hold a vector within the threshold, so that all partners of a vector are members of its home. A group that centres
do not part, such as a heap of near copies, is dealt into tiles, and every vector asks at all tiles.

Each shard builds a graph: vectors enter in a random order, find their surroundings by a greedy search from the medoid, and
keep neighbours by robust pruning, in batches. The adjacency lists of a vector from all its shards are united. Then every
vector asks at home: a greedy search from the medoid, and from its own node, that goes on through everything within range
until the range is used up, each candidate being verified by its cosine in double precision. Each task compares a sample
of its queries with all its members; where less than `least_recall` of their links were found it searches again with wider
beams, and after that compares all its queries with all its members.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.llm import shared

ALPHA = 1.2
SAMPLE_ROWS, MOST_CENTRES, MOST_OVERLAP, LEVELS = 4096, 32, 3.0, 6
AUDITED = 64  # one query of so many is audited
BATCH = 512


def _distances(dots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * dots, 0))


def pruned(x: np.ndarray, centre: np.ndarray, candidates: np.ndarray, degree: int) -> np.ndarray:
    """Robust pruning: of each row's candidates (numbers of x, -1: none) at most `degree`, the nearest first; a candidate
    goes where ALPHA times its distance to one already chosen is at most its distance to the centre."""
    there = candidates >= 0
    near = x[np.maximum(candidates, 0)]
    gap = np.where(there, _distances(np.einsum("bd,bmd->bm", centre, near)), np.inf)
    order = np.argsort(gap, axis=1, kind="stable")
    candidates, gap = np.take_along_axis(candidates, order, 1), np.take_along_axis(gap, order, 1)
    near = np.take_along_axis(near, order[:, :, None], 1)
    between = ALPHA * _distances(near @ near.transpose(0, 2, 1))
    alive, out, rows = np.isfinite(gap), np.full((len(centre), degree), -1, np.int32), np.arange(len(centre))
    for k in range(degree):
        pick = alive.argmax(1)
        has = alive[rows, pick]
        if not has.any():
            break
        out[has, k] = candidates[rows, pick][has]
        alive[rows, pick] = False
        alive &= ~(between[rows, pick] <= gap) | ~has[:, None]
    return out


def greedy(x: np.ndarray, links: np.ndarray, start: np.ndarray, asked: np.ndarray, beam: int, width: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Beam search of many queries at once: (ids, distances), `beam` columns, -1 where there are fewer.

    start: nodes (queries x any number, -1: none) where each query begins. In each step the `width` best nodes of a beam
    that were not expanded yet are."""
    n, rows = len(x), np.arange(len(asked))
    seen = np.zeros((len(asked), n + 1), bool)
    ids, gap = np.full((len(asked), beam), -1, np.int32), np.full((len(asked), beam), np.inf, np.float32)
    done = np.zeros((len(asked), beam), bool)
    fresh, active = start.astype(np.int32), rows
    while True:
        fresh = np.sort(fresh, axis=1)
        new = fresh >= 0
        new[:, 1:] &= fresh[:, 1:] != fresh[:, :-1]
        new &= ~seen[active[:, None], fresh]
        seen[active[:, None], np.where(new, fresh, n)] = True
        at, col = np.nonzero(new)
        d = np.full(fresh.shape, np.inf, np.float32)
        d[at, col] = _distances(np.einsum("pd,pd->p", asked[active[at]], x[fresh[at, col]]))
        all_ids = np.concatenate([ids[active], np.where(new, fresh, -1)], axis=1)
        all_gap = np.concatenate([gap[active], d], axis=1)
        all_done = np.concatenate([done[active], np.zeros(fresh.shape, bool)], axis=1)
        best = np.argsort(all_gap, axis=1, kind="stable")[:, :beam]
        ids[active], gap[active], done[active] = (np.take_along_axis(a, best, 1) for a in (all_ids, all_gap, all_done))
        waiting = ~done[active] & np.isfinite(gap[active])
        left = waiting.any(1)
        active, waiting = active[left], waiting[left]
        if not len(active):
            return ids, gap
        rank = np.cumsum(waiting, axis=1)
        chosen = waiting & (rank <= width)
        done[active] |= chosen
        i, j = np.nonzero(chosen)
        fresh = np.full((len(active), width, links.shape[1]), -1, np.int32)
        fresh[i, rank[i, j] - 1] = links[ids[active][i, j]]
        fresh = fresh.reshape(len(active), -1)


def medoid(x: np.ndarray) -> int:
    return int((x @ x.mean(0)).argmax())


def graph(x: np.ndarray, degree: int, beam: int, seed: int = 7) -> np.ndarray:
    """Adjacency lists (rows x degree, -1: none) of unit vectors: robust-pruned, built by batches that double."""
    n = len(x)
    links = np.full((n, degree), -1, np.int32)
    order = np.random.default_rng(seed).permutation(n)
    first = medoid(x)
    order = np.concatenate([[first], order[order != first]])
    size, at = 1, 1
    while at < n:
        batch = order[at : at + size]
        found, _ = greedy(x, links, np.full((len(batch), 1), first), x[batch], beam)
        dots = x[batch] @ x[batch].T  # vectors of one batch do not find each other in the graph
        np.fill_diagonal(dots, -2)
        near = np.argsort(-dots, axis=1, kind="stable")[:, : min(8, len(batch) - 1)]
        links[batch] = pruned(x, x[batch], np.concatenate([found, batch[near].astype(np.int32)], axis=1), degree)
        i, j = np.nonzero(links[batch] >= 0)
        _link_back(x, links, links[batch][i, j], batch[i].astype(np.int32))
        at += len(batch)
        size = min(2 * size, BATCH)
    return links


def _link_back(x: np.ndarray, links: np.ndarray, to: np.ndarray, new: np.ndarray) -> None:
    """Add the edges to -> new; lists that get too long are pruned, with the nearest newcomers first."""
    degree = links.shape[1]
    gap = np.einsum("pd,pd->p", x[to], x[new])
    order = np.lexsort((-gap, to))
    to, new = to[order], new[order]
    begin = np.flatnonzero(np.append(True, to[1:] != to[:-1]))
    place = np.arange(len(to)) - np.repeat(begin, np.diff(np.append(begin, len(to))))
    nodes = to[begin]
    use = place < 2 * degree
    more = np.full((len(nodes), min(2 * degree, int(place.max()) + 1)), -1, np.int32)
    more[np.searchsorted(nodes, to[use]), place[use]] = new[use]
    own = links[nodes]
    more[(more[:, :, None] == own[:, None, :]).any(2)] = -1
    lists = np.concatenate([own, more], axis=1)
    over = (lists >= 0).sum(1) > degree
    front = np.take_along_axis(lists, np.argsort(lists < 0, axis=1, kind="stable"), 1)[:, :degree]
    links[nodes[~over]] = front[~over]
    for lo in range(0, int(over.sum()), BATCH):
        some = np.flatnonzero(over)[lo : lo + BATCH]
        links[nodes[some]] = pruned(x, x[nodes[some]], lists[some], degree)


def in_range(x: np.ndarray, links: np.ndarray, asked: np.ndarray, own: np.ndarray, least: float, beam: int) -> np.ndarray:
    """Queries x members, true where a search from the medoid and from the own node (-1: not a member) finds a member with a
    dot product of at least `least`. From everything within range it goes on to all neighbours."""
    n, out = len(x), np.zeros((len(asked), len(x)), bool)
    rough = x.astype(np.float32)
    for lo in range(0, len(asked), BATCH):
        q, me = asked[lo : lo + BATCH], own[lo : lo + BATCH]
        start = np.stack([np.full(len(q), medoid(x)), me], axis=1)
        ids, _ = greedy(rough, links, start, q.astype(np.float32), beam)
        seen, found = np.zeros((len(q), n), bool), out[lo : lo + BATCH]
        fresh = np.unique(np.nonzero(ids >= 0)[0].astype(np.int64) * n + ids[ids >= 0])
        while len(fresh):
            hits = []
            for at in range(0, len(fresh), 1 << 16):
                i, j = np.divmod(fresh[at : at + (1 << 16)], n)
                seen[i, j] = True
                hit = np.einsum("pd,pd->p", q[i], x[j]) >= least
                found[i[hit], j[hit]] = True
                hits.append(np.stack([i[hit], j[hit]]))
            i, j = np.concatenate(hits, axis=1)
            ahead = []
            for at in range(0, len(i), 1 << 15):
                near = links[j[at : at + (1 << 15)]].astype(np.int64)
                who = np.broadcast_to(i[at : at + (1 << 15), None], near.shape)
                new = (near >= 0) & ~seen[who, near]
                ahead.append(np.unique(who[new] * n + near[new]))
                seen[who[new], near[new]] = True
            fresh = np.concatenate(ahead) if ahead else np.empty(0, np.int64)
    return out


def _spanning(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least number in reach of each of n numbers over the links (a, b)."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        after = root.copy()
        np.minimum.at(after, a, low)
        np.minimum.at(after, b, low)
        after = after[after]
        if (after == root).all():
            return root
        root = after


def _stacked(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()) if len(column) else np.empty((0, 1))


def _built(degree: int, beam: int):
    def run(members: pd.DataFrame) -> pd.DataFrame:
        members = members.sort_values("node")
        links, nodes = graph(_stacked(members["u"]).astype(np.float32), degree, beam), members["node"].to_numpy()
        return pd.DataFrame({"node": nodes, "near": [nodes[row[row >= 0]] for row in links]})

    return run


def _asked(least: float, beam: int, least_recall: float):
    """Answers of one shard (or tile) to one share of its queries: (node, n_links, root, found, truth)."""
    fields = ["node", "n_links", "root", "found", "truth"]

    def run(members: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(members) or not len(queries):
            return pd.DataFrame({c: np.empty(0, np.int64) for c in fields})
        members, queries = members.sort_values("node"), queries.sort_values("node")
        nodes, x = members["node"].to_numpy(), _stacked(members["u"])
        asked, q = queries["node"].to_numpy(), _stacked(queries["u"])
        lengths = members["near"].str.len().fillna(0).to_numpy(np.int64)
        near = np.concatenate([*(v for v in members["near"] if v is not None), np.empty(0, np.int64)]).astype(np.int64)
        row = np.repeat(np.arange(len(nodes)), lengths)
        at = np.minimum(np.searchsorted(nodes, near), len(nodes) - 1)
        inside = nodes[at] == near
        at, row = at[inside], row[inside]
        per = np.bincount(row, minlength=len(nodes))
        links = np.full((len(nodes), max(1, int(per.max()))), -1, np.int32)
        links[row, np.arange(len(row)) - np.repeat(np.cumsum(per) - per, per)] = at
        own = np.minimum(np.searchsorted(nodes, asked), len(nodes) - 1)
        own = np.where(nodes[own] == asked, own, -1)
        audited = np.flatnonzero(np.arange(len(asked)) % AUDITED == 0)
        truth = np.stack([x @ q[i] >= least for i in audited])
        truth[own[audited] >= 0, own[audited][own[audited] >= 0]] = False
        wide = beam
        while True:
            hit = in_range(x, links, q, own, least, wide)
            mine = np.flatnonzero(own >= 0)
            hit[mine, own[mine]] = False
            both = hit[np.ix_(mine, own[mine])]
            hit[np.ix_(mine, own[mine])] = both | both.T
            found = (hit[audited] & truth).sum(1)
            if found.sum() >= least_recall * truth.sum():
                break
            if wide >= 8 * beam:
                hit = np.stack([x @ v >= least for v in q])
                hit[mine, own[mine]] = False
                break
            wide *= 2
        n_links = np.array([int(members["copies"].to_numpy()[row].sum()) for row in hit])
        # linked queries and members under one number each: a spanning forest of them is enough
        everyone = np.union1d(nodes, asked)
        i, j = np.nonzero(hit)
        root = everyone[_spanning(np.searchsorted(everyone, asked)[i], np.searchsorted(everyone, nodes)[j], len(everyone))]
        out = pd.DataFrame({"node": everyone, "n_links": 0, "root": root, "found": 0, "truth": 0})
        out.loc[np.searchsorted(everyone, asked), "n_links"] = n_links
        out.loc[np.searchsorted(everyone, asked[audited]), ["found", "truth"]] = np.stack([found, truth.sum(1)], axis=1)
        return out[(out["n_links"] > 0) | (out["root"] != out["node"]) | (out["truth"] > 0)]

    return run


def _centres(rows: pd.DataFrame) -> pd.DataFrame:
    """Up to MOST_CENTRES means of a sample of one shard."""
    rows = rows.sort_values("node")
    x, k = _stacked(rows["u"]), int(rows["k"].iloc[0])
    means = x[np.random.default_rng(3).permutation(len(x))[:k]]
    for _ in range(8):
        near = ((means**2).sum(1)[None] - 2 * x @ means.T).argmin(1)
        means = np.stack([x[near == c].mean(0) if (near == c).any() else means[c] for c in range(len(means))])
    return pd.DataFrame({"shard": rows["shard"].iloc[0], "centre": np.arange(len(means)), "c": list(means)})


def _dealt(radius: float):
    def run(members: pd.DataFrame, centres: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(members) and len(centres):
            x, c = _stacked(members["u"]), _stacked(centres.sort_values("centre")["c"])
            d = np.maximum((x**2).sum(1)[:, None] + (c**2).sum(1)[None] - 2 * x @ c.T, 0)
            home = d.argmin(1)
            apart = np.sqrt(np.maximum((c**2).sum(1)[:, None] + (c**2).sum(1)[None] - 2 * c @ c.T, 0))[home]
            into = d - d.min(1)[:, None] <= 2 * radius * apart  # the distance to the border of the cell is at most the radius
            into[np.arange(len(x)), home] = True
            i, j = np.nonzero(into)
            out = members.iloc[i][["node", "u", "copies", "shard"]].assign(home=members["home"].to_numpy()[i] & (home[i] == j))
            return out.assign(part=out["shard"] + "/" + pd.Series(j, index=out.index).astype(str))
        return pd.DataFrame({c: [] for c in ("node", "u", "copies", "shard", "home", "part")})

    return run


def _shards(nodes: DataFrame, radius: float, shard_rows: int) -> DataFrame:
    """(shard, node, u, copies, home, tiles) of nodes (node, grp, u, copies): overlapping shards of at most shard_rows
    members, or more and then to be dealt into `tiles`."""
    now, done = nodes.select("node", "u", "copies", F.col("grp").alias("shard"), F.lit(True).alias("home")), []
    for level in range(LEVELS + 1):
        sizes = now.groupBy("shard").agg(F.count(F.lit(1)).alias("size"))
        now = shared.cut(now.join(sizes, "shard"))
        done.append(now.where(F.col("size") <= shard_rows).drop("size"))
        large = now.where(F.col("size") > shard_rows)
        if level == LEVELS or large.isEmpty():
            done.append(large.drop("size"))
            break
        k = F.least(F.lit(MOST_CENTRES), F.ceil(2 * F.col("size") / F.lit(shard_rows))).cast("int")
        some = large.where(F.pmod(F.xxhash64("node", F.lit(level)), F.lit(1 << 30)) < (1 << 30) * SAMPLE_ROWS / F.col("size"))
        centres = shared.cut(some.select("shard", "node", "u", k.alias("k")).groupBy("shard").applyInPandas(_centres, "shard string, centre int, c array<double>"))
        salts = F.ceil(F.col("size") / F.lit(4 * shard_rows)).cast("int")
        salted = large.withColumn("salt", F.pmod(F.xxhash64("node"), salts).cast("int"))
        copies = centres.join(sizes, "shard").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1)))
        dealt = salted.groupBy("shard", "salt").cogroup(copies.groupBy("shard", "salt")).applyInPandas(_dealt(radius), "node long, u array<double>, copies long, shard string, home boolean, part string")
        dealt = shared.cut(dealt)
        # a shard is parted only where that makes it smaller without too many copies
        parts = dealt.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n")).groupBy("shard").agg(F.sum("n").alias("all"), F.max("n").alias("most"))
        good = parts.join(sizes, "shard").where((F.col("all") <= MOST_OVERLAP * F.col("size")) & (F.col("most") <= 0.75 * F.col("size"))).select("shard")
        done.append(large.join(good, "shard", "left_anti").drop("size"))
        now = dealt.join(good, "shard", "left_semi").select("node", "u", "copies", F.col("part").alias("shard"), "home")
    out = done[0]
    for df in done[1:]:
        out = out.unionByName(df)
    tiles = out.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / F.lit(shard_rows)).cast("int").alias("tiles"))
    return shared.cut(out.join(tiles, "shard"))


def near_duplicates(
    vectors: DataFrame, least: float = 0.98, shard_rows: int = 8192, degree: int = 32, beam: int = 64, least_recall: float = 0.97,
    id_col: str = "vec_id", vector_col: str = "embedding", group_col: str = "label",
) -> DataFrame:
    """One row per row of vectors: (id_col, n_links long, component_id long, kept boolean, audited_links, audited_found long).

    Two vectors of one group and one length are linked if their cosine is at least `least`, in double precision. n_links
    counts the other rows linked directly, component_id is the least id in reach over links, kept tells whether that is the
    own id. A vector that is null, zero or has null or non-finite components, or whose group is null, is linked with nothing.
    Equal vectors are one node with their number of copies: copies cost nothing and are always linked. Repeated rows count
    as rows; a row without an id is linked with nothing, and its component_id and kept are null. Other columns are not read,
    an empty table gives no rows. audited_links and audited_found are the links by comparison with all members, and those
    among them that the graph found, of the vectors of the audit; else null.

    No link is invented; the share found is audited in every task (see the module).
    """
    if not 0 < least <= 1:
        raise ValueError("least is over 0 and at most 1")
    v = F.col("v")
    usable = (F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    top = F.array_max(F.transform("v", lambda x: F.abs(x)))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), F.col(group_col).cast("string").alias("g"))
    good = rows.where(v.isNotNull() & F.col("g").isNotNull() & F.col("id").isNotNull()).where(usable).where(top > 0)
    good = good.withColumn("grp", F.concat("g", F.lit("/"), F.size("v").cast("string")))
    each = good.groupBy("grp", "v").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    scaled = F.transform("v", lambda x: x / F.col("top"))
    norm = F.sqrt(F.aggregate("s", F.lit(0.0), lambda a, x: a + x * x))
    each = each.withColumn("top", top).withColumn("s", scaled).withColumn("norm", norm).withColumn("u", F.transform("s", lambda x: x / F.col("norm")))
    nodes = shared.cut(each.select(F.monotonically_increasing_id().alias("node"), "grp", "v", "u", "rep", "copies"))

    slack = 1e-9
    members = _shards(nodes, float(np.sqrt(2 - 2 * least)) + slack, shard_rows)
    tile = F.when(F.col("tiles") > 1, F.concat("shard", F.lit("#"), F.pmod(F.xxhash64("node"), F.col("tiles")).cast("string"))).otherwise(F.col("shard"))
    placed = members.withColumn("tile", tile)
    lists = placed.select("tile", "node", "u").groupBy("tile").applyInPandas(_built(degree, beam), "node long, near array<long>")
    united = lists.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))
    # every query asks its home, at all tiles of it; tiles and queries are dealt into shares that one task can hold
    share = F.pmod(F.xxhash64("node", F.lit(1)), F.col("tiles")).cast("int")
    all_tiles = F.sequence(F.lit(0), F.col("tiles") - 1)
    graphs = placed.join(united, "node").select("tile", F.explode(all_tiles).alias("share"), "node", "u", "copies", "near")
    at = F.when(F.col("tiles") > 1, F.concat("shard", F.lit("#"), F.col("k").cast("string"))).otherwise(F.col("shard"))
    queries = members.where("home").withColumn("share", share).withColumn("k", F.explode(all_tiles)).select(at.alias("tile"), *[F.col(c).alias(c) for c in ("share", "node", "u")])
    answers = graphs.groupBy("tile", "share").cogroup(queries.groupBy("tile", "share")).applyInPandas(
        _asked(least, beam, least_recall), "node long, n_links long, root long, found long, truth long"
    )
    answers = shared.cut(answers)
    linked = answers.groupBy("node").agg(F.sum("n_links").alias("n_links"), F.sum("found").alias("found"), F.sum("truth").alias("truth"))
    reach = shared.components(answers.select(F.col("node").alias("a"), F.col("root").alias("b")))
    least_id = reach.join(nodes.select("node", "rep"), "node").groupBy("component").agg(F.min("rep").alias("least_id"))
    reach = reach.join(least_id, "component").select("node", "least_id")
    told = nodes.join(linked, "node", "left").join(reach, "node", "left")
    told = told.where("copies > 1 or n_links > 0 or least_id is not null or truth > 0")
    told = told.select(
        F.col("grp").alias("grp_"), F.col("v").alias("v_"), (F.coalesce("n_links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("least_id", "rep").alias("least_id"), F.when(F.col("truth") > 0, F.col("truth")).alias("audited_links"), F.when(F.col("truth") > 0, F.col("found")).alias("audited_found"),
    )
    told = shared.cut(told)
    key = F.when(v.isNotNull() & F.col("g").isNotNull() & F.col("id").isNotNull(), F.concat("g", F.lit("/"), F.size("v").cast("string")))
    out = rows.withColumn("grp", key).join(told, (F.col("grp") == F.col("grp_")) & (F.col("v") == F.col("v_")), "left")
    component = F.coalesce("least_id", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (component == F.col("id")).alias("kept"), "audited_links", "audited_found")
