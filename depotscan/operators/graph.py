"""Directed graphs as tables of edges (src, dst): strong components, closure, reach between two sets, upkeep of a closure.

Every round is written to the shared folder, so lineage stays short and a lost executor costs no recomputation. Joins are
between stored tables, that is between plain exchanges, so Spark splits the partition of a hub. Edges with a null end are
left out; repeated edges count once; an edge from a node to itself makes that pair of the closure and nothing else.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depotscan import storage

#: Members of a strong component that are paired with all others of it, or of a reachable one, in one group.
BLOCK = 2048
#: Steps of a search that are planned as one job.
STEPS = 6


class Change(NamedTuple):
    deleted: DataFrame
    inserted: DataFrame
    table: DataFrame


class Level(NamedTuple):
    """Chains taken out of a graph: (src, dst, last) for each, and its inner nodes (node, last)."""

    chains: DataFrame
    inner: DataFrame


def plain_edges(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(src, dst) once each, without nulls."""
    return edges.select(F.col(src).alias("src"), F.col(dst).alias("dst")).where("src is not null and dst is not null").distinct()


def _trim(edges: DataFrame) -> DataFrame:
    """Without the edges into a node that has no edge out of it, and out of one that has none into it: no cycle has those."""
    out, into = edges.select(F.col("src").alias("dst")).distinct(), edges.select(F.col("dst").alias("src")).distinct()
    return edges.join(out, "dst", "left_semi").join(into, "src", "left_semi").select("src", "dst")


def _chains(edges: DataFrame) -> tuple[DataFrame, Level | None, DataFrame | None, int | None]:
    """(edges with each chain of nodes of one edge in and one out replaced by a single edge, the chains, rings (node, component) of such nodes alone, how many edges are left); None where there is no chain.

    Each node of a chain points ahead, and in each round to where the node it points to does, so a chain of n takes
    log2(n) rounds; what never meets an end is a ring, named by its smallest node."""
    out = edges.groupBy("src").agg(F.count("*").alias("n"), F.first("dst").alias("ahead")).where("n = 1")
    into = edges.groupBy("dst").agg(F.count("*").alias("m")).where("m = 1").withColumnRenamed("dst", "src")
    chain, seen = storage.measured(out.join(into, "src").select(F.col("src").alias("node"), "ahead", F.col("src").alias("last"), F.col("src").alias("low"), F.lit(True).alias("open")), "chain")
    if not seen.n:
        return edges, None, None, None
    before = None
    while True:
        after = chain.select(F.col("node").alias("ahead"), F.col("ahead").alias("ahead2"), F.col("last").alias("last2"), F.col("low").alias("low2"), F.lit(True).alias("met"))
        met = F.coalesce("met", F.lit(False))
        jumped = chain.join(after, "ahead", "left").select("node", F.coalesce("ahead2", "ahead").alias("ahead"), F.coalesce("last2", "last").alias("last"), F.least("low", "low2").alias("low"), met.alias("open"))
        older = chain
        chain, seen = storage.measured(jumped, "chain", n=F.count_if("open"), lows=F.sum(F.when(F.col("open"), F.xxhash64("low").cast("decimal(38,0)"))))
        storage.discard(older)
        if not seen.n or seen == before:
            break
        before = seen
    rings = chain.where("open").select("node", F.col("low").alias("component"))
    ends = chain.where("not open")
    heads = edges.join(chain.select(F.col("node").alias("src")), "src", "left_anti").join(ends.select(F.col("node").alias("dst"), F.col("ahead").alias("end"), "last"), "dst").select("src", F.col("end").alias("dst"), "last")
    level = Level(storage.store(heads, "chains"), ends.select("node", "last"))
    inner = chain.select("node")
    rest = edges.join(inner.withColumnRenamed("node", "src"), "src", "left_anti").join(inner.withColumnRenamed("node", "dst"), "dst", "left_anti")
    rest = rest.select("src", "dst").unionByName(level.chains.select("src", "dst")).where("src <> dst").distinct()
    rest, seen = storage.measured(rest, "graph")
    return rest, level, rings, seen.n


def _strongest(edges: DataFrame) -> DataFrame:
    """(node, top): the largest node from which each node can be reached, itself included. A node also takes what its
    largest one so far has, so paths are covered in steps that double."""
    nodes = edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).distinct()
    tops = storage.store(nodes.select("node", F.col("node").alias("top")), "tops")
    while True:
        near = edges.join(tops.withColumnRenamed("node", "src"), "src").select(F.col("dst").alias("node"), "top")
        jump = tops.join(tops.select(F.col("node").alias("top"), F.col("top").alias("top2")), "top").select("node", F.col("top2").alias("top"))
        best = near.unionByName(jump).groupBy("node").agg(F.max("top").alias("better"))
        better, older = tops.join(best, "node", "left").select("node", F.greatest("top", "better").alias("top"), (F.col("better") > F.col("top")).alias("moved")), tops
        tops, seen = storage.measured(better, "tops", n=F.count_if("moved"))
        tops = _columns(tops, "node", "top")
        storage.discard(older)
        if not seen.n:
            return tops


def _columns(stored: DataFrame, *names: str) -> DataFrame:
    """Some columns of a stored table, which can still be discarded."""
    some = stored.select(*names)
    some._stored_at = stored._stored_at
    return some


def strong_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component) of the nodes on a cycle of two nodes or more; a component is named by its smallest node.

    What has no way on or no way back is trimmed, chains shrink to an edge and rings are found by pointers that double.
    What is left is coloured: a node's colour is the largest node that reaches it. Of the nodes of a colour, those that
    reach its largest one are its component, found by colouring the reversed edges; the others go on without it."""
    left, seen = storage.measured(plain_edges(edges, src, dst).where("src <> dst"), "graph")
    kind = dict(left.dtypes)["src"]
    n, levels = seen.n, []
    found = edges.sparkSession.createDataFrame([], f"node {kind}, component {kind}")
    while n:
        while n:  # shrink
            left, level, rings, rest = _chains(left)
            if level:
                levels.append(level)
                found, n = found.unionByName(rings), rest
            if n:
                trimmed, seen = storage.measured(_trim(left), "graph")
                storage.discard(left)
                left, before, n = trimmed, n, seen.n
                if n == before and not level:
                    break
        if not n:
            break
        colour = _strongest(left)
        ends = left.join(colour.select(F.col("node").alias("src"), F.col("top").alias("a")), "src").join(colour.select(F.col("node").alias("dst"), F.col("top").alias("b")), "dst").where("a = b")
        inside = storage.store(ends.select("src", "dst", F.col("a").alias("colour")), "graph-coloured")
        back = _strongest(inside.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        members = storage.store(back.join(colour.withColumnRenamed("top", "colour"), "node").where("top = colour").select("node", F.col("colour").alias("component")), "strong")
        found = found.unionByName(members)
        older, gone = left, members.select("node")
        left, seen = storage.measured(inside.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti").select("src", "dst"), "graph")
        n = seen.n
        storage.discard(older, inside, colour, back)
    for level in reversed(levels):
        found = storage.store(found, "strong")
        at = lambda end, name: found.select(F.col("node").alias(end), F.col("component").alias(name))
        closed = level.chains.join(at("src", "a"), "src", "left").join(at("dst", "b"), "dst", "left").where("src = dst or a = b").select("src", "last", "a", F.coalesce("a", "src").alias("component"))
        closed = storage.store(closed, "strong-chains")
        heads = closed.where("a is null").select(F.col("src").alias("node"), "component").distinct()
        found = found.unionByName(heads).unionByName(level.inner.join(closed.select("last", "component"), "last").select("node", "component"))
    found = storage.store(found, "strong")
    least = found.groupBy("component").agg(F.min("node").alias("least"))
    return storage.store(found.join(least, "component").select("node", F.col("least").alias("component")), "strong-components")


def _acyclic_closure(edges: DataFrame, max_rounds: int) -> DataFrame:
    """The closure of stored edges by doubling distances: with the pairs of distance up to d known, those of distance d
    exactly are put before them, and what is new has distances up to 2d. A pair is made once for each node half way."""
    known, d = storage.store(edges.select("src", "dst", F.lit(1).alias("d")), "closure"), 1
    for _ in range(max_rounds):
        far = known.where(F.col("d") == d).select("src", F.col("dst").alias("via"))
        ahead = far.join(known.select(F.col("src").alias("via"), "dst", F.col("d").alias("e")), "via").groupBy("src", "dst").agg((F.min("e") + d).alias("d"))
        newer, seen = storage.measured(ahead.join(known, ["src", "dst"], "left_anti"), "closure-new")
        if not seen.n:
            return known.select("src", "dst")
        known, d = known.unionByName(newer), 2 * d
    raise RuntimeError(f"the closure did not end in {max_rounds} rounds")


def transitive_closure(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 64) -> DataFrame:
    """All (src, dst) pairs joined by a path of one edge or more; a cycle yields pairs of a node with itself.

    Strong components are found first and become one node each; the acyclic rest is closed, a path of n edges in log2(n)
    rounds; then pairs of components become pairs of their members, each made once, in blocks of members. So a component
    of s nodes costs its s**2 pairs and no join above that."""
    graph = storage.store(plain_edges(edges, src, dst), "closure-edges")
    strong = strong_components(graph)
    loops = graph.where("src = dst")
    if strong.isEmpty():
        return _acyclic_closure(graph.where("src <> dst"), max_rounds).unionByName(loops)
    named = lambda end: strong.select(F.col("node").alias(end), F.col("component").alias(f"{end}_c"))
    between = graph.join(named("src"), "src", "left").join(named("dst"), "dst", "left").select(F.coalesce("src_c", "src").alias("src"), F.coalesce("dst_c", "dst").alias("dst"))
    pairs = _acyclic_closure(storage.store(between.where("src <> dst").distinct(), "condensed"), max_rounds)
    sizes = strong.groupBy("component").agg((F.floor(F.count("*") / BLOCK) + 1).alias("blocks"))
    sizes = storage.store(sizes, "strong-sizes")
    pairs = pairs.unionByName(sizes.select(F.col("component").alias("src"), F.col("component").alias("dst")))
    first = pairs.join(named("node").select(F.col("node_c").alias("src"), "node"), "src", "left").select(F.coalesce("node", "src").alias("a"), "dst")
    first = first.join(sizes.withColumnRenamed("component", "dst"), "dst", "left").select("a", "dst", F.coalesce(F.pmod(F.xxhash64("a"), F.col("blocks")), F.lit(0)).alias("block"))
    second = strong.join(sizes, "component").select(F.col("component").alias("dst"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), F.col("node").alias("b"))
    found = first.join(second, ["dst", "block"], "left").select(F.col("a").alias("src"), F.coalesce("b", "dst").alias("dst"))
    alone = loops.join(strong.select(F.col("node").alias("src")), "src", "left_anti")
    return found.unionByName(alone)


def reachable(edges: DataFrame, start: DataFrame, backward: bool = False) -> DataFrame:
    """(node): what the nodes of start (node) reach by an edge or more; backward: what reaches them. Only edges of nodes just found are followed, several steps in one job."""
    step = edges.select(F.col("dst").alias("node"), F.col("src").alias("next")) if backward else edges.select(F.col("src").alias("node"), F.col("dst").alias("next"))
    found, front = None, start.select("node").distinct()
    while True:
        met = None
        for i in range(1, STEPS + 1):
            front = step.join(front, "node", "left_semi").select(F.col("next").alias("node")).distinct()
            here = front.withColumn("step", F.lit(i))
            met = here if met is None else met.unionByName(here)
        met = met.groupBy("node").agg(F.min("step").alias("step"))
        newer, seen = storage.measured(met if found is None else met.join(found, "node", "left_anti"), "reached", n=F.count_if(F.col("step") == STEPS))
        found = newer.select("node") if found is None else found.unionByName(newer.select("node"))
        front = newer.where(F.col("step") == STEPS).select("node")
        if not seen.n:
            return found


def reach_pairs(edges: DataFrame, sources: DataFrame, targets: DataFrame) -> DataFrame:
    """(src, dst) of the closure with src in sources (node) and dst in targets (node), without the closure.

    A search ahead from the sources and one back from what it met of the targets keep the edges that lie on such a path.
    Along these, pairs grow back from the targets; each round follows pairs that are new."""
    graph = storage.store(plain_edges(edges), "reach-edges")
    sources, targets = storage.store(sources.select("node").distinct(), "reach-sources"), targets.select("node").distinct()
    ahead = reachable(graph, sources)
    met = storage.store(targets.join(ahead, "node", "left_semi"), "reach-targets")
    on = sources.unionByName(ahead).distinct()
    graph = storage.store(graph.join(on.withColumnRenamed("node", "src"), "src", "left_semi").select("src", "dst"), "reach-edges")
    back = graph.select(F.col("dst").alias("via"), "src")
    found, front = None, met.select(F.col("node").alias("via"), F.col("node").alias("dst"))
    while True:
        some = None
        for i in range(1, STEPS + 1):
            front = back.join(front, "via").select(F.col("src").alias("via"), "dst").distinct()
            here = front.withColumn("step", F.lit(i))
            some = here if some is None else some.unionByName(here)
        some = some.groupBy("via", "dst").agg(F.min("step").alias("step")).withColumnRenamed("via", "src")
        newer, seen = storage.measured(some if found is None else some.join(found, ["src", "dst"], "left_anti"), "reach-pairs", n=F.count_if(F.col("step") == STEPS))
        found = newer.select("src", "dst") if found is None else found.unionByName(newer.select("src", "dst"))
        front = newer.where(F.col("step") == STEPS).select(F.col("src").alias("via"), "dst")
        if not seen.n:
            return found.join(sources.withColumnRenamed("node", "src"), "src", "left_semi").select("src", "dst")


def _through(closure: DataFrame, firsts: DataFrame) -> DataFrame:
    """(src, dst) pairs of paths that use an edge of firsts (a, d): from what reaches a, or a, to what d reaches, or d. closure is stored."""
    starts = firsts.select("a").distinct()
    before = closure.join(starts.withColumnRenamed("a", "dst"), "dst", "left_semi").select("src", F.col("dst").alias("a")).unionByName(starts.select(F.col("a").alias("src"), "a"))
    ends = firsts.select("d").distinct()
    after = closure.join(ends.withColumnRenamed("d", "src"), "src", "left_semi").select(F.col("src").alias("d"), "dst").unionByName(ends.select("d", F.col("d").alias("dst")))
    return firsts.select("a", "d").distinct().join(before.distinct(), "a").join(after.distinct(), "d").select("src", "dst").distinct()


def maintain_closure(closure: DataFrame, edges: DataFrame, deleted: DataFrame, inserted: DataFrame) -> Change:
    """The closure (src, dst) of edges, brought up to date for deleted and inserted edges: (pairs gone, pairs new, the table).

    Delete and rederive: pairs with some path over a deleted edge are doubtful; those of them that an edge left, or such an
    edge and a pair that is certain, still makes are kept, round by round, each following what was new. Inserted edges are
    linked where one leads to the next; the closure of these few links gives the pairs that they make, in one join with
    what reaches the first and what the last reaches. Pairs through no changed edge are neither made nor compared."""
    closure = storage.store(plain_edges(closure), "closure-old")
    old = plain_edges(edges)
    gone = storage.store(plain_edges(deleted).join(old, ["src", "dst"], "left_semi").join(plain_edges(inserted), ["src", "dst"], "left_anti"), "edges-gone")
    added = plain_edges(inserted).join(old, ["src", "dst"], "left_anti").withColumn("number", F.monotonically_increasing_id())
    added = storage.store(added, "edges-added")
    table, lost = closure, closure.limit(0)
    if not gone.isEmpty():
        each = gone.select(F.col("src").alias("a"), F.col("dst").alias("d"))
        doubtful = storage.store(_through(closure, each).join(closure, ["src", "dst"], "left_semi"), "closure-doubtful")
        certain = storage.store(closure.join(doubtful, ["src", "dst"], "left_anti"), "closure-certain")
        left = old.join(gone, ["src", "dst"], "left_anti").join(doubtful.select("src").distinct(), "src", "left_semi")
        left = storage.store(left.select("src", F.col("dst").alias("via")), "edges-left")
        direct = left.select("src", F.col("via").alias("dst"))
        reach = left.join(certain.select(F.col("src").alias("via"), "dst"), "via").select("src", "dst")
        again = storage.store(direct.unionByName(reach).distinct().join(doubtful, ["src", "dst"], "left_semi"), "closure-again")
        kept = again
        while not again.isEmpty():
            ahead = left.join(again.select(F.col("src").alias("via"), "dst"), "via").select("src", "dst").distinct()
            again = storage.store(ahead.join(doubtful, ["src", "dst"], "left_semi").join(kept, ["src", "dst"], "left_anti"), "closure-again")
            kept = kept.unionByName(again)
        lost = doubtful.join(kept, ["src", "dst"], "left_anti")
        table = storage.store(certain.unionByName(kept), "closure-left")
    new = closure.limit(0)
    if not added.isEmpty():
        tip, tail = added.select(F.col("number").alias("src"), F.col("dst").alias("b")), added.select(F.col("number").alias("dst"), F.col("src").alias("c"))
        on = table.join(tip.select(F.col("b").alias("src")).distinct(), "src", "left_semi").join(tail.select(F.col("c").alias("dst")).distinct(), "dst", "left_semi")
        on = on.select(F.col("src").alias("b"), F.col("dst").alias("c")).unionByName(added.select(F.col("dst").alias("b"), F.col("dst").alias("c"))).distinct()
        follows = transitive_closure(tip.join(on, "b").join(tail, "c").select("src", "dst")).unionByName(added.select(F.col("number").alias("src"), F.col("number").alias("dst")))
        chains = follows.join(added.select(F.col("number").alias("src"), F.col("src").alias("a")), "src").join(added.select(F.col("number").alias("dst"), F.col("dst").alias("d")), "dst")
        new = storage.store(_through(table, chains).join(table, ["src", "dst"], "left_anti"), "closure-added")
    back = lost.join(new, ["src", "dst"], "left_anti")
    return Change(back, new.join(lost, ["src", "dst"], "left_anti"), table.unionByName(new))
