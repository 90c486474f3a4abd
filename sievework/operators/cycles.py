"""Nodes on cycles of directed graphs, many graphs at once, of any size.

Graphs of a bounded number of links are searched each in one task. A larger one is taken apart by joins: links that no
cycle can hold are trimmed; nodes with one way out are merged into the node that they lead to, a random independent
half of them at a time, so that a long chain or cycle takes a number of rounds like its logarithm; what is left is
parted into strongly connected sets by colours (the greatest name that reaches a node) and the way back to the node of
that name. Then the merged nodes join the set of their target, if that set leads to them.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..scratch import cut

#: Links of a graph that one task may search, once those without way in or out are gone.
LINKS = 20_000


def on_cycles(edges: list[tuple[str, str]]) -> list[str]:
    """Nodes that reach themselves: strongly connected components of two or more, and self-loops; no recursion."""
    out: dict[str, list[str]] = {}
    for a, b in edges:
        out.setdefault(a, []).append(b)
    index, low, stack, held, found = {}, {}, [], set(), {a for a, b in edges if a == b}
    for start in out:
        if start in index:
            continue
        index[start] = low[start] = len(index)
        stack.append(start)
        held.add(start)
        work = [(start, iter(out[start]))]
        while work:
            node, rest = work[-1]
            nxt = next(rest, None)
            if nxt is None:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[node])
                if low[node] == index[node]:
                    part = []
                    while not part or part[-1] != node:
                        part.append(stack.pop())
                        held.discard(part[-1])
                    found.update(part if len(part) > 1 else ())
            elif nxt not in index:
                index[nxt] = low[nxt] = len(index)
                stack.append(nxt)
                held.add(nxt)
                work.append((nxt, iter(out.get(nxt, ()))))
            elif nxt in held:
                low[node] = min(low[node], index[nxt])
    return sorted(found)


def on_cycle(links: DataFrame, graph: str, limit: int = LINKS) -> DataFrame:
    """(graph, node) of links (graph, a, b), a to b: nodes that reach themselves. Nulls link nothing."""
    edges = links.where("a is not null and b is not null").select(graph, "a", "b").distinct()
    inner = _trimmed(edges, graph)
    sizes = inner.groupBy(graph).agg(F.count("*").alias("n"))
    large = cut(sizes.where(F.col("n") > limit).select(graph), "large")
    schema = T.StructType([links.schema[graph], T.StructField("node", links.schema["a"].dataType)])

    def search(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        nodes = on_cycles(list(zip(frame["a"], frame["b"], strict=True)))
        return pd.DataFrame({graph: [key[0]] * len(nodes), "node": nodes}, dtype=object)

    if not large.count():
        return inner.groupBy(graph).applyInPandas(search, schema)
    out = inner.join(F.broadcast(large) if large.count() <= limit else large, graph, "left_anti").groupBy(graph).applyInPandas(search, schema)
    return out.unionByName(_by_joins(inner.join(large, graph, "left_semi"), graph).select(graph, F.col("node").cast(schema["node"].dataType)))


def _trimmed(edges: DataFrame, graph: str) -> DataFrame:
    """Links from nodes that something leads to, to nodes that lead somewhere."""
    into, out_of = edges.select(graph, F.col("b").alias("a")).distinct(), edges.select(graph, F.col("a").alias("b")).distinct()
    return edges.join(into, [graph, "a"], "left_semi").join(out_of, [graph, "b"], "left_semi")


def _merged(edges: DataFrame, graph: str, turn: int) -> DataFrame:
    """(graph, v, w): nodes with one way out, to w, such that no w is itself merged in this turn."""
    coin = lambda c: F.pmod(F.xxhash64(F.lit(turn), graph, c), F.lit(2)) == 1
    single = edges.groupBy(graph, "a").agg(F.count("*").alias("n"), F.min("b").alias("w")).where("n = 1")
    return single.where(coin("a") & ~coin("w")).select(graph, F.col("a").alias("v"), "w")


def _by_joins(edges: DataFrame, graph: str) -> DataFrame:
    """(graph, node) on cycles, by joins alone; every step is written."""
    edges = cut(edges, "edges")
    loops = cut(edges.where("a = b").select(graph, F.col("a").alias("node")), "loops")
    edges, steps, turn, still = edges.where("a <> b"), [], 0, 0
    while still < 4:  # a turn may merge nothing by chance
        turn += 1
        edges = cut(_trimmed(edges, graph), "edges")
        merged = cut(_merged(edges, graph, turn), "merged")
        if not merged.count():
            still += 1
            continue
        still = 0
        sources = merged.select(graph, F.col("v").alias("a"))
        into = merged.select(graph, F.col("v").alias("b"), "w")
        kept = edges.join(sources, [graph, "a"], "left_anti").join(into, [graph, "b"], "left")
        kept = cut(kept, "kept")
        steps.append((merged, cut(kept.where("w is not null").select(graph, F.col("a").alias("u"), F.col("b").alias("v"), "w"), "led")))
        edges = kept.select(graph, "a", F.coalesce("w", "b").alias("b")).where("a <> b").distinct()
    labels = _coloured(edges, graph)
    for merged, led in reversed(steps):
        # v belongs to the set of its target w, if a node of that set leads to v.
        named = lambda c: labels.select(graph, F.col("node").alias(c), F.col("label").alias(f"{c}_label"))  # noqa: E731, B023
        own = led.join(named("u"), [graph, "u"], "left").join(named("w"), [graph, "w"], "left")
        own = own.withColumns({c: F.coalesce(f"{c}_label", c) for c in ("u", "w")})
        back = own.where("u = w").select(graph, F.col("v").alias("node"), F.col("w").alias("label")).distinct()
        labels = cut(labels.unionByName(back), "labels")
    # A merged node carries its target's label; the target itself is in the set under its own name.
    members = labels.unionByName(labels.select(graph, F.col("label").alias("node"), "label")).distinct()
    sizes = members.groupBy(graph, "label").agg(F.count("*").alias("n")).where("n > 1")
    return members.join(sizes, [graph, "label"], "left_semi").select(graph, "node").unionByName(loops).distinct()


def _coloured(edges: DataFrame, graph: str) -> DataFrame:
    """(graph, node, label) of the strongly connected sets of two nodes or more; a label is a node of its set."""
    edges = cut(_trimmed(edges, graph), "edges")
    found = cut(edges.select(graph, F.col("a").alias("node"), F.col("a").alias("label")).limit(0), "sets")
    while edges.count():
        nodes = edges.select(graph, F.col("a").alias("node")).unionByName(edges.select(graph, F.col("b").alias("node"))).distinct()
        colour, mark = cut(nodes.withColumn("colour", F.col("node")), "colours"), None
        while True:
            led = edges.join(colour.select(graph, F.col("node").alias("a"), "colour"), [graph, "a"]).select(graph, F.col("b").alias("node"), "colour")
            colour = cut(colour.unionByName(led).groupBy(graph, "node").agg(F.max("colour").alias("colour")), "colours")
            now = tuple(colour.agg(F.sum(F.xxhash64(graph, "node", "colour").cast("decimal(38,0)"))).first())
            if now == mark:
                break
            mark = now
        one = edges.join(colour.select(graph, F.col("node").alias("a"), F.col("colour").alias("c")), [graph, "a"]).join(colour.select(graph, F.col("node").alias("b"), F.col("colour").alias("d")), [graph, "b"]).where("c = d")
        one = cut(one.select(graph, "a", "b", "c"), "within")
        back = cut(colour.where("node = colour").select(graph, "node", F.col("colour").alias("label")), "back")
        size = back.count()
        while True:
            more = one.join(back.select(graph, F.col("node").alias("b"), F.col("label").alias("c")), [graph, "b", "c"]).select(graph, F.col("a").alias("node"), F.col("c").alias("label"))
            back = cut(back.unionByName(more).distinct(), "back")
            before, size = size, back.count()
            if size == before:
                break
        found = cut(found.unionByName(back), "sets")
        gone = back.select(graph, "node")
        edges = edges.join(gone.withColumnRenamed("node", "a"), [graph, "a"], "left_anti").join(gone.withColumnRenamed("node", "b"), [graph, "b"], "left_anti")
        edges = cut(_trimmed(edges, graph), "edges")
    return found
