"""Merkle manifest of a table: a tree of hashes a group, one root over the groups, and a proof for every row.

A row's leaf is the hash of its fields. The leaves of a group, in key order, are hashed together by runs of eight, again
and again until one is left, the group's subroot; the subroots in the order of the groups give the root in the same
way. Rows are numbered by a range sort, each partition after the rows of the earlier ones; blocks of 4,096 neighbours
then become one node in one task each, so a group may have any share of the rows. What is left after as many such
rounds as it takes is a small top tree: the driver builds it and broadcasts each top node's suffix path, and executors
finish the proofs inside the blocks and fold every row up to the root.

Defined cases: a null field is ``-``; null keys come before others, rows that share a key are ordered by their leaf,
and equal rows have a place each; a null group is a group; no rows give no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import crc32_sql, cut, free, small

#: Nodes of a run, and the levels that a block of FANOUT ** ROUNDS nodes climbs in its task.
FANOUT, ROUNDS = 8, 4
#: Nodes of the top tree that the driver builds, and suffix paths that it broadcasts, at most; beyond it, blocks of blocks.
TOP = 8192
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PATH = "array<struct<left string, right string>>"
Path = list[tuple[str, str]]


def hashed(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(*fields: Column) -> Column:
    """The hash of the fields, each with its length in bytes, so that no two rows give one text."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def raised(nodes: list[str]) -> list[str]:
    """One level up: every run of eight as its hash."""
    return [hashed("".join(nodes[i : i + FANOUT])) for i in range(0, len(nodes), FANOUT)]


def levels_of(nodes: list[str], rounds: int | None = None) -> list[list[str]]:
    """The nodes and the levels above them: as many as rounds, or until one node is left."""
    levels = [nodes]
    while len(levels) <= rounds if rounds is not None else len(levels[-1]) > 1:
        levels.append(raised(levels[-1]))
    return levels


def path_of(levels: list[list[str]], at: int) -> Path:
    """What stands left and right of node ``at`` in its run, level by level."""
    path = []
    for level in levels[:-1]:
        start = at - at % FANOUT
        path.append(("".join(level[start:at]), "".join(level[at + 1 : start + FANOUT])))
        at //= FANOUT
    return path


def folded(leaf: str, path: Path) -> str:
    for left, right in path:
        leaf = hashed(left + leaf + right)
    return leaf


def _numbered(rows: DataFrame, *order: str) -> DataFrame:
    """rows (tree, ...) with index, a row's place in its tree by order, and total, the tree's rows. Written."""
    by = [F.asc_nulls_first("tree"), *map(F.asc_nulls_first, order)]
    dealt = cut(rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("at", F.monotonically_increasing_id()), "sorted")
    parts = dealt.groupBy("tree", F.shiftright("at", 33).alias("part")).agg(F.min("at").alias("first"), F.count("*").alias("n"))
    tree = W.partitionBy("tree")
    before = F.sum("n").over(tree.orderBy("part").rowsBetween(W.unboundedPreceding, 0)) - F.col("n")
    starts = cut(parts.select(F.col("tree").alias("p_tree"), "part", (before - F.col("first")).alias("shift"), F.sum("n").over(tree).alias("total")), "starts")
    same = F.col("tree").eqNullSafe(F.col("p_tree")) & (F.shiftright("at", 33) == F.col("part"))
    return dealt.join(small(starts), same).withColumn("index", F.col("at") + F.col("shift")).drop("at", "part", "p_tree", "shift")


def _block_levels(rows: list[dict], rounds: int) -> list[list[str]]:
    """A block's levels: all that there are in a tree of one block."""
    return levels_of([r["hash"] for r in rows], rounds if rows[0]["total"] > FANOUT**rounds else None)


def _in_blocks(nodes: DataFrame, work: Callable, schema: T.StructType) -> DataFrame:
    """work over the blocks of nodes, each whole and in order, in the task that holds it."""
    dealt = nodes.repartition("tree", "block").sortWithinPartitions(F.asc_nulls_first("tree"), "block", "index")
    return dealt.mapInArrow(_by_block(work, to_arrow_schema(schema)), schema)


def _by_block(work: Callable, schema: pa.Schema):
    def given(at: tuple, held: list[dict]) -> pa.RecordBatch:
        columns = zip(*work(at, held))
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for batch in batches:
            for row in batch.to_pylist():
                if (row["tree"], row["block"]) != at:
                    if held:
                        yield given(at, held)
                    at, held = (row["tree"], row["block"]), []
                held.append(row)
        if held:
            yield given(at, held)

    return run


def _schema(ddl: str, **more: T.DataType) -> T.StructType:
    return T.StructType([*(T.StructField(n, t) for n, t in more.items()), *T.StructType.fromDDL(ddl)])


def _reduced(at: tuple, rows: list[dict], rounds: int) -> list[tuple]:
    return [(*at, -(-rows[0]["total"] // FANOUT**rounds), _block_levels(rows, rounds)[-1][0])]


def top_paths(nodes: list[tuple]) -> tuple[str, dict]:
    """The root, and for each (tree, index, hash) its path to the root and its subroot, by (tree, index)."""
    trees: dict = {}
    for tree, index, node in sorted(nodes, key=lambda r: (r[0] is not None, (r[0] or "").encode(), r[1])):
        trees.setdefault(tree, []).append(node)
    levels = {t: levels_of(n) for t, n in trees.items()}
    subroots = [x[-1][0] for x in levels.values()]
    above = levels_of(subroots)
    paths = {(t, i): (path_of(x, i) + path_of(above, k), x[-1][0]) for k, (t, x) in enumerate(levels.items()) for i in range(len(x[0]))}
    return (above[-1][0] if subroots else hashed("")), paths


def _suffixed(suffix: Broadcast | None, finish: Callable, rounds: int) -> Callable:
    """Work on a block that knows the path above it: broadcast, or in a first row of its own (index -1)."""

    def work(at: tuple, rows: list[dict]) -> list[tuple]:
        if suffix is None:
            head, rows = rows[0], rows[1:]
            path, subroot = [(p["left"], p["right"]) for p in head["path"]], head["subroot"]
        else:
            path, subroot = suffix.value[at]
        levels = _block_levels(rows, rounds)
        return [finish(at, r, path_of(levels, i) + path, subroot) for i, r in enumerate(rows)]

    return work


def _to_path(at: tuple, row: dict, path: Path, subroot: str) -> tuple:
    return at[0], row["index"], subroot, [{"left": a, "right": b} for a, b in path]


def _to_proof(at: tuple, row: dict, path: Path, subroot: str) -> tuple:
    return row["key"], row["hash"], subroot, hashed("".join(a + b for a, b in path)), folded(row["claim"], path)


def _with_suffix(nodes: DataFrame, suffix: Broadcast | DataFrame, finish: Callable, schema: T.StructType, rounds: int) -> DataFrame:
    keyed = nodes.withColumn("block", _block(rounds))
    if isinstance(suffix, Broadcast):
        return _in_blocks(keyed, _suffixed(suffix, finish, rounds), schema)
    heads = suffix.select("tree", F.col("index").alias("block"), F.lit(-1).cast("long").alias("index"), "subroot", "path")
    return _in_blocks(keyed.unionByName(heads, allowMissingColumns=True), _suffixed(None, finish, rounds), schema)


def _block(rounds: int) -> Column:
    return F.floor(F.col("index") / FANOUT**rounds)


def _tops(nodes: DataFrame, rounds: int) -> DataFrame:
    """One node a block."""
    return cut(_in_blocks(nodes.select("tree", "total", "index", "hash", _block(rounds).alias("block")), lambda at, rows: _reduced(at, rows, rounds), _schema("tree string, index long, total long, hash string")), "tops")


def manifest(rows: DataFrame, leaf: Column, tree: str, key: str, claim: Column | None = None, rounds: int = ROUNDS, top: int = TOP) -> DataFrame:
    """(key, leaf, subroot, root, proof_sha256, folded_root) of every row.

    leaf: the row's hash; tree: its group; claim: the leaf to be verified (default: leaf). proof_sha256 is the hash of the
    row's siblings on all levels, folded_root what the claim and these siblings give. rounds: levels of a block; top: bound
    of the driver's tree.
    """
    named = rows.select(F.col(tree).cast("string").alias("tree"), F.col(key).alias("key"), leaf.alias("hash"), (leaf if claim is None else claim).alias("claim"), F.monotonically_increasing_id().alias("tie"))
    facts = cut(named, "leaves")
    floors, grouped = [cut(_numbered(facts, "key", "hash", "tie").drop("tie"), "nodes")], None
    free(facts)
    tops = _tops(floors[0], rounds)
    while tops.limit(top + 1).count() > top:
        if grouped is None and tops.agg(F.max("total")).first()[0] == 1:
            # More groups than the driver takes: their subroots are the leaves of one more tree.
            grouped = len(floors)
            tops = cut(_numbered(tops.select(F.lit(None).cast("string").alias("tree"), F.col("tree").alias("name"), "hash"), "name"), "nodes")
        floors.append(tops)
        tops = _tops(tops, rounds)
    root, paths = top_paths([tuple(r) for r in tops.select("tree", "index", "hash").collect()])  # at most top rows
    suffix: Broadcast | DataFrame = rows.sparkSession.sparkContext.broadcast(paths)
    for i in range(len(floors) - 1, 0, -1):
        suffix = cut(_with_suffix(floors[i], suffix, _to_path, _schema(f"tree string, index long, subroot string, path {PATH}"), rounds), "paths")
        if i == grouped:
            trees = floors[i].select("index", F.col("name").alias("tree"), F.col("hash").alias("subroot"))
            suffix = suffix.select("index", "path").join(trees, "index").withColumn("index", F.lit(0).cast("long"))
    out = _with_suffix(floors[0], suffix, _to_proof, _schema("leaf string, subroot string, proof_sha256 string, folded_root string", key=floors[0].schema["key"].dataType), rounds)
    return out.select(F.col("key").alias(key), "leaf", "subroot", F.lit(root).alias("root"), "proof_sha256", "folded_root")


def op12_merkle(docs: DataFrame) -> DataFrame:
    leaf = leaf_of(*map(F.col, FIELDS))
    lowered = leaf_of(*map(F.col, FIELDS[:-1]), F.translate(F.col("text"), UPPER, LOWER))
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    out = manifest(docs, leaf, "lang", "doc_id", F.when(hit, lowered).otherwise(leaf))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def oracle(levels: int = 6, above: int = 3) -> str:
    """DuckDB SQL for op12: every level of the trees, then of the root's, unrolled (8 ** levels rows a group)."""
    told = lambda text: " || ".join(f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')" for c in (*FIELDS[:-1], text))
    hit = f"coalesce({crc32_sql('doc_id::VARCHAR')} % 3 = 0, false)"
    parts = [
        f"d AS (SELECT row_number() OVER () AS r, doc_id, lang, sha256({told('text')}) AS leaf, CASE WHEN {hit} THEN sha256({told(f"translate(text, '{UPPER}', '{LOWER}')")}) ELSE sha256({told('text')}) END AS claim FROM documents)",
        "f0 AS (SELECT r, doc_id, lang, leaf, claim, '' AS proof, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf, r) - 1 AS i FROM d)", "n0 AS (SELECT lang, i, leaf AS h, count(*) OVER (PARTITION BY lang) AS m FROM f0)",
    ]

    def climb(n: str, p: str, after: str, tree: str, k: int, before: str, then: str) -> list[str]:
        run = f"PARTITION BY {tree}, i // {FANOUT} ORDER BY i ROWS BETWEEN"
        same = f"p.{tree} IS NOT DISTINCT FROM f.{tree} AND p.i = f.i"
        return [
            f"{p} AS (SELECT {tree}, i, m, coalesce(string_agg(h, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS a, coalesce(string_agg(h, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS b FROM {n})",
            f"{after} AS (SELECT {tree}, i // {FANOUT} AS i, sha256(string_agg(h, '' ORDER BY i)) AS h, (max(m) + {FANOUT - 1}) // {FANOUT} AS m FROM {n} WHERE m > 1 GROUP BY {tree}, i // {FANOUT} UNION ALL SELECT {tree}, i, h, m FROM {n} WHERE m = 1)",
            f"{then} AS (SELECT f.* REPLACE (CASE WHEN p.m > 1 THEN sha256(p.a || f.claim || p.b) ELSE f.claim END AS claim, CASE WHEN p.m > 1 THEN f.proof || p.a || p.b ELSE f.proof END AS proof, CASE WHEN p.m > 1 THEN f.i // {FANOUT} ELSE f.i END AS i) FROM {before} f JOIN {p} p ON {same})",
        ]

    for k in range(levels):
        parts += climb(f"n{k}", f"p{k}", f"n{k + 1}", "lang", k, f"f{k}", f"f{k + 1}")
    top = f"n{levels}"
    parts += [f"m0 AS (SELECT 0 AS t, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, h, lang, count(*) OVER () AS m FROM {top})", f"g0 AS (SELECT f.* REPLACE (m.i AS i), 0 AS t, m.h AS subroot FROM f{levels} f JOIN m0 m ON m.lang IS NOT DISTINCT FROM f.lang)"]
    for k in range(above):
        parts += climb(f"m{k}", f"q{k}", f"m{k + 1}", "t", k, f"g{k}", f"g{k + 1}")
    return f"WITH {', '.join(parts)} SELECT doc_id, leaf, subroot, (SELECT h FROM m{above}) AS root, sha256(proof) AS proof_sha256, claim AS folded_root, claim = (SELECT h FROM m{above}) AS verified FROM g{above}"
