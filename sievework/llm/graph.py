"""Embedding near-dedup by a robust-pruned flat graph.

Vectors go to the shards of their nearest centres (overlapping: ``overlap`` shards each); a shard with more rows than a
block is split again by centres of its own, level by level, so shards stay small at any size. On every shard a flat graph is
built: each vector's nearest candidates are pruned so that no kept neighbour is much nearer to another than to the
vector. The adjacency lists of a vector's shards are united. Each vector then searches its shards greedily from
the medoids of the shard and of clusters in it (a pair that meets in two counts in the first), and expands its range: from every vector found within the threshold (or just under) the
search goes on through its neighbours. Every reported link is verified by its cosine in double precision. An audit
compares a bounded sample of queries with brute force over all vectors, by the share of links found and by the mean share
of each query's links; if either is below the target recall the search is repeated with a wider beam and one more shard
for each vector. If the last attempt fails too, all vectors are compared exactly, tile by tile: right, but quadratic.

Identical vectors are searched once and counted as often as they occur. A shard that no centres can split, for its
vectors are all near each other, is tiled: blocks of its queries against blocks of its vectors, each with its own graph, so
no group grows with the data. Only counts and spanning edges leave a tile, never all pairs of a group.

Defined cases: vectors that are null, zero, or hold null or non-finite components link with nothing, and so do vectors
of another length than most (they are compared with their own length only); repeated rows, also of one key, count as vectors
of their own; a row with a null key links like any other and has the least key of its component, or null if that has none;
an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, cut, small

THRESHOLD, SLACK = 0.95, 0.03
SHARD_ROWS, BLOCK = 1500, 4096
#: Centres of one level, and levels of splitting.
MOST_CENTRES, LEVELS = 1024, 4
DEGREE, POOL, ALPHA, BEAM, MEDOIDS, FAR, BACK = 24, 48, 1.2, 32, 64, 8, 3
AUDIT_ROWS, RECALL, ATTEMPTS = 200, 0.9, 3
#: Centres nearer than this to another are dropped, so that groups of copies are not torn apart.
CENTRE_COSINE = 0.8


def _units(raw: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(raw), "<f8").reshape(len(raw), -1)


def unit_vectors(table: DataFrame, key: str, vector: str) -> DataFrame:
    """(r, k, v, s): row number, key, the unit vector as little-endian doubles, and its digest; null if it can't be compared."""

    def unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[bytes | None] = []
            for x in b.column(2).to_pylist():
                one = None
                if x and None not in x:
                    a = np.array(x, np.float64)
                    top = np.abs(a).max()
                    if np.isfinite(top) and top > 0:
                        a = a / top
                        one = (a / np.sqrt((a * a).sum())).astype("<f8").tobytes()
                out.append(one)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.binary())], names=["r", "k", "v"])

    rows = table.select(F.monotonically_increasing_id().alias("r"), F.col(key).cast("long").alias("k"), F.col(vector).cast("array<double>").alias("v"))
    return rows.mapInArrow(unit, "r long, k long, v binary").withColumn("s", F.unhex(F.sha2("v", 256)))


def _apart(sample: np.ndarray) -> np.ndarray:
    """The vectors, in order, without those near one before."""
    kept: list[int] = []
    for i in range(len(sample)):
        if not kept or (sample[kept] @ sample[i]).max() < CENTRE_COSINE:
            kept.append(i)
    return sample[kept]


def _centres(points: DataFrame, rows: int) -> np.ndarray:
    """A seeded bounded sample of points, without those near another."""
    count = min(MOST_CENTRES, -(-rows // SHARD_ROWS))
    return _apart(_units([bytes(r.v) for r in points.orderBy(F.xxhash64(F.lit(7), "id"), "id").limit(count).collect()]))


def _assigned(points: DataFrame, centres: np.ndarray, overlap: int) -> DataFrame:
    """(shard, shards, id, n, v): every point in the shards of its nearest centres, with the list of them."""
    overlap = min(overlap, len(centres))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            score = _units(b.column(2).to_pylist()) @ centres.T
            order = np.argsort(-score, axis=1, kind="stable")[:, :overlap].astype(np.int64)
            for rank in range(overlap):
                yield pa.RecordBatch.from_arrays([pa.array(order[:, rank]), pa.array(list(order)), b.column(0), b.column(1), b.column(2)], names=["shard", "shards", "id", "n", "v"])

    return points.select("id", "n", "v").mapInArrow(near, "shard long, shards array<long>, id long, n long, v binary")


def _resplit(overlap: int, threshold: float):
    def split(key: tuple, members: pd.DataFrame, centres: pd.DataFrame) -> pd.DataFrame:
        """Members of a shard in its children: the nearest, and those about as near, as a link to a member of theirs may be.

        A shard whose centres are all near each other stays whole, for good.
        """
        none = members[["shard", "id", "n", "v"]].assign(done=True)
        if members.empty or centres.empty:
            return none
        chosen = _apart(_units(centres.sort_values("id")["v"].tolist()))
        if len(chosen) < 2:
            return none
        angle = np.arccos(np.clip(_units(members["v"].tolist()) @ chosen.T, -1, 1))
        order = np.argsort(angle, axis=1, kind="stable")[:, : min(overlap, len(chosen))]
        far = np.take_along_axis(angle, order, axis=1)
        near = far <= far[:, :1] + np.arccos(threshold)
        parts = [none.assign(shard=members["shard"] * (MOST_CENTRES + 1) + 1 + order[:, rank], done=False)[near[:, rank]] for rank in range(order.shape[1])]
        return pd.concat(parts, ignore_index=True)

    return split


def _sharded(points: DataFrame, rows: int, overlap: int, threshold: float) -> DataFrame:
    """(shard, shards, id, n, v), written: points in overlapping shards of at most a block wherever centres can split them."""
    members = cut(_assigned(points, _centres(points, rows), overlap), "shards").withColumn("done", F.lit(False))
    for level in range(LEVELS):
        sizes = members.groupBy("shard").agg(F.count("*").alias("rows"), F.bool_or("done").alias("over"))
        big = cut(sizes.where(f"rows > {BLOCK} and not over").select("shard", "rows"), "big")
        if not big.limit(1).count():
            break
        inside = members.select("shard", "id", "n", "v", "done").join(small(big), "shard").withColumn("lot", F.pmod(F.xxhash64("id"), F.ceil(F.col("rows") / BLOCK)))
        drawn = F.pmod(F.xxhash64(F.lit(level), "id"), F.col("rows")) < F.least(F.ceil(2 * F.col("rows") / SHARD_ROWS), F.lit(MOST_CENTRES // 4))
        lots = F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("rows") / BLOCK) - 1)).alias("lot")
        centres = cut(inside.where(drawn).select("shard", "id", "v", "rows"), "centres").select("shard", "id", "v", lots)
        grouped = inside.select("shard", "lot", "id", "n", "v").groupBy("shard", "lot").cogroup(centres.groupBy("shard", "lot"))
        split = cut(grouped.applyInPandas(_resplit(overlap, threshold), "shard long, id long, n long, v binary, done boolean"), "shards")
        members = members.select(*split.columns).join(small(big.select("shard")), "shard", "left_anti").unionByName(split)
    if "shards" not in members.columns:
        lists = members.groupBy("id").agg(F.array_sort(F.collect_set("shard")).alias("shards"))
        members = cut(members.join(lists, "id"), "shards")
    return members.select("shard", "shards", "id", "n", "v")


def robust_graph(x: np.ndarray) -> list[np.ndarray]:
    """Adjacency of unit vectors x: pruned candidates, and the reverse of every edge.

    Candidates are the nearest and, so that groups of copies stay reachable, a few seeded far ones.
    """
    n = len(x)
    pool = min(POOL, n - 1)
    kept: list[list[int]] = [[] for _ in range(n)]
    if pool < 1:
        return [np.zeros(0, np.int64)] * n
    pools, step = [], max(1, min(2_000_000 // n, 512))
    for at in range(0, n, step):
        own = np.arange(at, min(n, at + step))
        score = x[own] @ x.T
        score[np.arange(len(own)), own] = -np.inf
        cand = np.argpartition(-score, pool - 1, axis=1)[:, :pool]
        near = np.take_along_axis(score, cand, axis=1)
        order = np.argsort(-near, axis=1, kind="stable")
        cand, near = np.take_along_axis(cand, order, axis=1), 1 - np.take_along_axis(near, order, axis=1)
        pools.append(cand)
        v = x[cand]
        apart = 1 - v @ v.transpose(0, 2, 1)
        alive, degree = np.ones(cand.shape, bool), np.zeros(len(own), int)
        for j in range(pool):
            take = alive[:, j] & (degree < DEGREE)
            for r in np.flatnonzero(take):
                kept[own[r]].append(int(cand[r, j]))
            degree += take
            alive &= ~(take[:, None] & (ALPHA * apart[:, j] <= near))
    far = np.random.default_rng(17).integers(0, n, (n, FAR)).tolist()
    for i in range(n):
        kept[i] += [j for j in far[i] if j != i and j not in kept[i]]
    forward = [list(k) for k in kept]
    for i in range(n):
        for j in forward[i]:
            if len(kept[j]) < 2 * DEGREE and i not in kept[j]:
                kept[j].append(i)
    load = np.zeros(n, np.int64)
    for i, near in enumerate(np.concatenate(pools)):  # hubs are full: the least used of the nearest lead back to i
        for j in near[np.argsort(load[near], kind="stable")[:BACK]].tolist():
            load[j] += 1
            if i not in kept[j]:
                kept[j].append(i)
    return [np.array(k, np.int64) for k in kept]


def medoids(x: np.ndarray, count: int = MEDOIDS) -> np.ndarray:
    """The medoid of all, then medoids of clusters around points each as far as can be from those before it."""
    first = int(np.argmax(x @ x.mean(axis=0)))
    chosen, near = [first], x @ x[first]
    while len(chosen) < min(count, len(x)):
        chosen.append(int(np.argmin(near)))
        near = np.maximum(near, x @ x[chosen[-1]])
    owner = np.argmax(x @ x[chosen].T, axis=1)
    out = [first]
    for c in range(len(chosen)):
        own = np.flatnonzero(owner == c)
        if len(own):
            out.append(int(own[np.argmax(x[own] @ x[own].mean(axis=0))]))
    return np.unique(out)


def range_search(x: np.ndarray, graph: list[np.ndarray], queries: np.ndarray, threshold: float, beam: int, batch: int = 256) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (query, vector) with cosine >= threshold, batch by batch of queries."""
    n = len(x)
    width = max((len(g) for g in graph), default=0)
    table = np.full((n + 1, max(1, width)), n, np.int64)
    for i, g in enumerate(graph):
        table[i, : len(g)] = g
    padded = np.concatenate([x, np.zeros((1, x.shape[1]))])
    entries = medoids(x)
    for at in range(0, len(queries), batch):
        q = queries[at : at + batch]
        rows = np.arange(len(q))[:, None]
        seen = np.zeros((len(q), n + 1), bool)
        seen[:, n] = True
        ids = np.broadcast_to(entries, (len(q), len(entries))).copy()
        seen[rows, ids] = True
        score, open_ = q @ x[entries].T, np.ones(ids.shape, bool)
        found_q, found_v = [], []

        def note(who: np.ndarray, what: np.ndarray, how: np.ndarray, found_q: list = found_q, found_v: list = found_v) -> None:
            hit = how >= threshold - SLACK
            found_q.append(np.stack([who[hit], what[hit]]))
            found_v.append(how[hit])

        note(np.repeat(np.arange(len(q)), ids.shape[1]), ids.ravel(), score.ravel())
        while open_.any():
            best = np.where(open_, score, -np.inf)
            pick = best.argmax(axis=1)
            going = open_.any(axis=1)
            open_[np.arange(len(q)), pick] = False
            fresh = table[np.where(going, ids[np.arange(len(q)), pick], n)]
            old = seen[rows, fresh]
            seen[rows, fresh] = True
            dots = np.einsum("qd,qkd->qk", q, padded[fresh])
            dots[old] = -np.inf
            new = ~old
            note(np.broadcast_to(rows, fresh.shape)[new], fresh[new], dots[new])
            ids, score, open_ = np.concatenate([ids, fresh], 1), np.concatenate([score, dots], 1), np.concatenate([open_, new], 1)
            if ids.shape[1] > beam:
                top = np.argpartition(-score, beam - 1, axis=1)[:, :beam]
                ids, score, open_ = (np.take_along_axis(a, top, axis=1) for a in (ids, score, open_))
        front = np.concatenate(found_q, axis=1)
        while front.shape[1]:
            grown = []
            for part in range(0, front.shape[1], 20_000):
                who, what = np.repeat(front[0, part : part + 20_000], table.shape[1]), table[front[1, part : part + 20_000]].ravel()
                new = ~seen[who, what]
                pairs = np.unique(who[new] * (n + 1) + what[new])
                who, what = pairs // (n + 1), pairs % (n + 1)
                seen[who, what] = True
                how = np.einsum("pd,pd->p", q[who], x[what])
                hit = how >= threshold - SLACK
                grown.append(np.stack([who[hit], what[hit]]))
                found_v.append(how[hit])
            front = np.concatenate(grown, axis=1)
            found_q.append(front)
        pairs, how = np.concatenate(found_q, axis=1), np.concatenate(found_v)
        yield pairs[0][how >= threshold] + at, pairs[1][how >= threshold]


def _build(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
    ids = frame["id"].to_numpy()
    graph = robust_graph(_units(frame["v"].tolist()))
    return pd.DataFrame({"id": ids, "near": [ids[g].tolist() for g in graph]})


def exact_search(x: np.ndarray, queries: np.ndarray, threshold: float, batch: int = 256) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (query, vector) with cosine >= threshold by brute force, batch by batch of queries."""
    for at in range(0, len(queries), batch):
        who, what = np.nonzero(queries[at : at + batch] @ x.T >= threshold)
        yield who + at, what


def _padded(lists: pd.Series, fill: int) -> np.ndarray:
    out = np.full((len(lists), max(map(len, lists))), fill, np.int64)
    for i, own in enumerate(lists):
        out[i, : len(own)] = own
    return out


def _search(threshold: float, beam: int | None):
    """The search of a tile; by brute force if there is no beam."""

    def search(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        base, asked = frame[frame["base"]].reset_index(drop=True), frame[frame["asked"]].reset_index(drop=True)
        none = pd.DataFrame({"id": np.zeros(0, np.int64), "other": np.zeros(0, np.int64), "links": np.zeros(0, np.int64)})
        if base.empty or asked.empty:
            return none
        ids, mine, n = base["id"].to_numpy(), asked["id"].to_numpy(), base["n"].to_numpy()
        place = {v: i for i, v in enumerate(ids.tolist())}
        graph = [np.array([place[j] for j in near if j in place], np.int64) if near is not None else np.zeros(0, np.int64) for near in base["near"]]
        links, head = np.zeros(len(asked), np.int64), {}
        theirs, own = _padded(base["shards"], -1), _padded(asked["shards"], -2)
        sooner = np.cumsum(own == key[0], axis=1) == 0  # shards in which the query meets the same vectors before this one

        def root(i: int) -> int:
            while head.setdefault(i, i) != i:
                head[i] = head[head[i]]
                i = head[i]
            return i

        vectors, queries = _units(base["v"].tolist()), _units(asked["v"].tolist())
        for who, what in exact_search(vectors, queries, threshold) if beam is None else range_search(vectors, graph, queries, threshold, beam):
            met = ((own[who][:, :, None] == theirs[what][:, None, :]) & sooner[who][:, :, None]).any(axis=(1, 2))
            other = (mine[who] != ids[what]) & ~met
            who, what = who[other], what[other]
            links += np.bincount(who, n[what], minlength=len(asked)).astype(np.int64)
            for a, b in zip(mine[who].tolist(), ids[what].tolist(), strict=True):
                a, b = root(a), root(b)
                if a != b:
                    head[max(a, b)] = min(a, b)
        tied = [(i, root(i)) for i in list(head) if root(i) != i]
        counted = pd.DataFrame({"id": mine, "other": pd.array([None] * len(mine), "Int64"), "links": links})
        edges = pd.DataFrame({"id": [a for a, _ in tied], "other": pd.array([b for _, b in tied], "Int64"), "links": 0})
        return pd.concat([counted, edges], ignore_index=True) if tied else counted

    return search


def _searched(points: DataFrame, rows: int, threshold: float, beam: int, overlap: int) -> DataFrame:
    """(id, other, links): counts where other is null, else edges."""
    members = _sharded(points, rows, overlap, threshold)
    blocks = members.groupBy("shard").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    placed = members.join(blocks, "shard").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    near = placed.groupBy("shard", "block").applyInPandas(_build, "id long, near array<long>")
    united = near.groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))  # one list a shard
    tiles = _tiles(placed.join(cut(united, "graph"), "id"))
    return cut(tiles.groupBy("shard", "q", "b").applyInPandas(_search(threshold, beam), "id long, other long, links long"), "found")


def _tiles(placed: DataFrame) -> DataFrame:
    """Every block's vectors in the tiles of all blocks of their shard."""
    tile = F.expr("filter(flatten(transform(sequence(0, blocks - 1), b -> array(struct(block as q, b as b, true as asked, b = block as base), struct(b as q, block as b, false as asked, b <> block as base)))), t -> t.asked or t.base)")
    return placed.select("shard", "shards", "id", "n", "v", "near", F.explode(tile).alias("t")).select("shard", "t.*", "shards", "id", "n", "v", "near")


def _compared(points: DataFrame, rows: int, threshold: float) -> DataFrame:
    """What _searched gives, by brute force: all points in one shard, each pair of blocks a tile."""
    blocks = -(-rows // BLOCK)
    block = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block")
    placed = points.select(F.lit(0).cast("long").alias("shard"), F.array(F.lit(0).cast("long")).alias("shards"), "id", "n", "v", F.lit(None).cast("array<long>").alias("near"), F.lit(blocks).alias("blocks"), block)
    return cut(_tiles(placed).groupBy("shard", "q", "b").applyInPandas(_search(threshold, None), "id long, other long, links long"), "found")


def audit(points: DataFrame, found: DataFrame, threshold: float, rows: int = AUDIT_ROWS) -> float:
    """The lesser of two recalls on a bounded seeded sample of points, by brute force over all points.

    They are the share of all links that were found, and the mean of each linked point's share: one large group cannot
    hide what is missed elsewhere.
    """
    sample = points.orderBy(F.xxhash64(F.lit(11), "id"), "id").limit(rows).select("id", "n", "v").collect()
    if not sample:
        return 1.0
    ids, queries = np.array([r.id for r in sample]), _units([bytes(r.v) for r in sample])

    def brute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                hit = (queries @ _units(b.column(2).to_pylist()).T >= threshold) & (ids[:, None] != b.column(0).to_numpy())
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array((hit @ b.column(1).to_numpy()).astype(np.int64))], names=["id", "t"])

    true = {r.id: r.t for r in points.select("id", "n", "v").mapInArrow(brute, "id long, t long").groupBy("id").agg(F.sum("t").alias("t")).collect()}
    got = {r.id: r.links for r in found.where("other is null").where(F.col("id").isin(ids.tolist())).groupBy("id").agg(F.sum("links").alias("links")).collect()}
    met = [(t, min(t, got.get(i, 0))) for i, t in true.items() if t]
    return min(sum(g for _, g in met) / sum(t for t, _ in met), sum(g / t for t, g in met) / len(met)) if met else 1.0


def near_vectors(table: DataFrame, key: str = "vec_id", vector: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """(key, n_links, component_id, kept) for every row."""
    marked = cut(unit_vectors(table, key, vector), "units")
    known = marked.where("v is not null").groupBy("s").agg(F.min("r").alias("id"), F.min("k").alias("least"), F.count("*").alias("n"), F.first("v").alias("v"))
    groups = cut(known.withColumn("width", F.octet_length("v")), "vectors")
    found = None
    for width, rows in sorted((r.width, r["count"]) for r in groups.groupBy("width").count().collect()):
        points, beam, overlap = groups.where(F.col("width") == width), BEAM, 2
        for _ in range(ATTEMPTS):
            own = _searched(points, rows, threshold, beam, overlap)
            if audit(points, own, threshold) >= RECALL:
                break
            beam, overlap = beam * 2, overlap + 1
        else:
            own = _compared(points, rows, threshold)
        found = own if found is None else found.unionByName(own)
    if found is None:
        heads = groups.select("s", F.lit(0).cast("long").alias("n_links"), F.col("least").alias("component_id"))
    else:
        linked = found.where("other is null").groupBy("id").agg(F.sum("links").alias("links"))
        parts = components(found.where("other is not null").select(F.col("id").alias("a"), F.col("other").alias("b")))
        told = cut(groups.drop("v").join(linked, "id", "left").join(parts, "id", "left").withColumn("g", F.coalesce("component", "id")), "told")
        least = told.groupBy("g").agg(F.min("least").alias("component_id"))
        heads = told.join(least, "g").select("s", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    linked = marked.where("v is not null").select("k", "s").join(heads, "s").select("k", "n_links", "component_id")
    silent = marked.where("v is null").select("k", F.lit(0).cast("long").alias("n_links"), F.col("k").alias("component_id"))
    return linked.unionByName(silent).select(F.col("k").alias(key), "n_links", "component_id", F.col("k").eqNullSafe(F.col("component_id")).alias("kept"))


def op10_graph(table: DataFrame) -> DataFrame:
    return near_vectors(table)
