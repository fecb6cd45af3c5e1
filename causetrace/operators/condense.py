"""Strongly connected components and levels of large call graphs, part by part (behind C9, C11)."""

from __future__ import annotations

import functools
import itertools
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causetrace.functions.shared import dropped, settled

#: Edges up to which a graph, or a weakly connected part of one, is walked whole in one task: some tens of megabytes, in place of many small rounds. Results are the same.
SMALL = 200_000
#: Asked rows of a part, and targets, that one task answers at once.
ASKED, TARGETS = 50_000, 4_096
#: Rows of a join that makes shortcuts through large parts, as a multiple of their links.
JOINED = 8
#: Rounds of trimming, at least, before colours are tried: chains are trimmed from both ends, and a long one by the outer rounds.
TRIMS = 3


def _flip(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def _among(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The edges between ``nodes(node)``."""
    return edges.join(nodes.select(F.col("node").alias("src")), "src", "left_semi").join(nodes.select(F.col("node").alias("dst")), "dst", "left_semi").select("src", "dst")


def _trimmed(edges: DataFrame, small: int) -> tuple[DataFrame, int]:
    """Edges of nodes that have one in and one out, as others are in no cycle, and their number: as long as a tenth goes at a time, or until ``small`` are left."""
    n = edges.count()
    for k in itertools.count(1):
        core = edges.select(F.col("src").alias("node")).distinct().intersect(edges.select(F.col("dst").alias("node")).distinct())
        less = settled(_among(edges, core), "trimmed")
        dropped(edges)
        was, n, edges = n, less.count(), less
        if n == was or n <= small or (k >= TRIMS and n > 0.9 * was):
            return edges, n


def _coloured(edges: DataFrame, max_rounds: int) -> DataFrame:
    """``node, colour``: the smallest node that reaches each node, or itself."""
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    now = settled(nodes.select("node", F.col("node").alias("colour")), "colours")
    for _ in range(max_rounds):
        came = edges.join(now.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.min("colour").alias("came"))
        then = settled(now.join(came, "node", "left").select("node", F.least("colour", "came").alias("colour"), (F.col("came") < F.col("colour")).alias("moved")), "colours")
        moved = not then.where("moved").isEmpty()
        dropped(now)
        now = then
        if not moved:
            return now.select("node", "colour")
    raise RuntimeError("colours did not settle")


def _back_to_roots(edges: DataFrame, colours: DataFrame, max_rounds: int) -> DataFrame:
    """``node, colour`` of the nodes that reach the node their colour is named after; they and it are a component."""
    to = lambda c: colours.select(F.col("node").alias(c), F.col("colour").alias(f"c{c}"))
    same = settled(edges.join(to("src"), "src").join(to("dst"), "dst").where("csrc = cdst").select("src", "dst"), "same")
    seen = front = settled(colours.where("node = colour").select("node"), "roots")
    for _ in range(max_rounds):
        step = same.join(front.select(F.col("node").alias("dst")), "dst").select(F.col("src").alias("node")).distinct()
        front = settled(step.join(seen, "node", "left_anti"), "front")
        if front.isEmpty():
            dropped(same)
            return colours.join(seen, "node", "left_semi")
        seen = settled(seen.unionByName(front), "seen")
    raise RuntimeError("components did not settle")


def walked(edges: list[tuple]) -> list[tuple]:
    """(node, component, level) of every node of a small graph: depth-first, components come out last first (Tarjan), so levels fill from the end."""
    links: dict = {}
    for a, b in edges:
        links.setdefault(a, []).append(b)
        links.setdefault(b, [])
    order: dict = {}
    low, open_, out, level, came = {}, [], {}, {}, {}
    for root in links:
        if root in order:
            continue
        stack = [(root, iter(links[root]))]
        order[root] = low[root] = len(order)
        open_.append(root)
        while stack:
            node, rest = stack[-1]
            for x in rest:
                if x not in order:
                    order[x] = low[x] = len(order)
                    open_.append(x)
                    stack.append((x, iter(links[x])))
                    break
                if x not in out:
                    low[node] = min(low[node], order[x])
            else:
                stack.pop()
                if stack:
                    low[stack[-1][0]] = min(low[stack[-1][0]], low[node])
                if low[node] == order[node]:
                    at = open_.index(node) if open_[-1] != node else len(open_) - 1
                    members = open_[at:]
                    del open_[at:]
                    name = min(members)
                    out.update(dict.fromkeys(members, name))
                    came[name] = members
    for name in reversed(came):  # callers before the called
        level.setdefault(name, 0)
        for node in came[name]:
            for x in links[node]:
                if out[x] != name:
                    level[out[x]] = max(level.get(out[x], 0), level[name] + 1)
    return [(n, c, level[c]) for n, c in out.items()]


def _walked_whole(edges: DataFrame, *by: Column) -> DataFrame:
    """``node, component, level, part`` of graphs that are groups ``by``; a part is named after the smallest node of its group."""
    kind = edges.schema["src"].dataType.simpleString()

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        got = pd.DataFrame(walked(list(zip(pdf["src"], pdf["dst"], strict=True))), columns=["node", "component", "level"])
        return got.assign(part=got["node"].min())

    return edges.groupBy(*by).applyInPandas(one, f"node {kind}, component {kind}, level bigint, part {kind}")


def weak_parts(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``node, part``, staged: the smallest node that links join a node to, whichever way they go (alternating large and small stars; rounds grow with the logarithm of a part)."""
    every = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    now = settled(edges.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct(), "stars")
    mark = lambda df: df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    was = mark(now)
    for _ in range(max_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = settled(both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "stars")
        led = large.join(large.groupBy("u").agg(F.min("v").alias("m")), "u")
        small = led.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(led.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        then = settled(small, "stars")
        dropped(large)
        dropped(now)
        now, seen, was = then, was, mark(then)
        if was == seen:
            return settled(every.join(now.select(F.col("u").alias("node"), F.col("v").alias("part")), "node", "left").select("node", F.coalesce("part", "node").alias("part")), "parts")
    raise RuntimeError("parts did not settle")


def strong_components(edges: DataFrame, max_rounds: int = 10_000, small: int = SMALL) -> DataFrame:
    """``node, component`` of every node of ``edges(src, dst)``: the smallest of the nodes that it reaches and that reach it.

    Nodes without callers or calls are trimmed; then each node takes the smallest node that reaches it as its colour, and the nodes
    that reach the node of their colour form a component and go; the rest starts again. Tables only shrink, and what is left of at most ``small`` edges is walked in one task;
    rounds grow with the longest of the shortest paths in what is more.
    """
    every = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    left = settled(edges.select("src", "dst").where("src <> dst").distinct(), "calls")
    found = None
    for _ in range(max_rounds):
        left, n = _trimmed(left, small)
        if n <= small:
            whole = settled(_walked_whole(left, F.lit(True)).select("node", F.col("component").alias("colour")), "component")
            found = whole if found is None else settled(found.unionByName(whole), "found")
            break
        colours = settled(_coloured(left, max_rounds), "coloured")
        told = settled(_back_to_roots(left, colours, max_rounds), "component")
        found = told if found is None else settled(found.unionByName(told), "found")
        rest = settled(_among(left, colours.join(told, "node", "left_anti")), "rest")
        dropped(left)
        dropped(colours)
        left = rest
    else:
        raise RuntimeError("components did not settle")
    return every.join(found, "node", "left").select("node", F.coalesce("colour", "node").alias("component"))


def _linked(edges: DataFrame, members: DataFrame) -> DataFrame:
    """Distinct links between the components of ``members(node, component)``."""
    of = lambda c: members.select(F.col("node").alias(c), F.col("component").alias(f"c{c}"))
    both = edges.join(of("src"), "src").join(of("dst"), "dst").where("csrc <> cdst")
    return settled(both.select(F.col("csrc").alias("src"), F.col("cdst").alias("dst")).distinct(), "links")


def _levels(links: DataFrame, members: DataFrame, max_rounds: int, small: int) -> DataFrame:
    """``node, level`` of every component, in rounds from both ends of the acyclic ``links``.

    What nothing left over links to has the round as its level. What links to nothing waits, as it holds up no other level, and is told at the end from those that
    link to it, last round first. The core has long paths before and behind each of its nodes; of at most ``small`` links, it is walked in one task.
    """
    left, open_ = links, settled(members.select(F.col("component").alias("node")).distinct(), "open")
    parts, waiting = [], []
    for at in range(max_rounds):
        if left.count() <= small:
            break
        ends = left.select(F.inline(F.array(F.struct(F.col("src").alias("node"), F.lit(1).alias("out")), F.struct(F.col("dst").alias("node"), F.lit(0).alias("out")))))
        ends = ends.groupBy("node").agg(F.max("out").alias("calls"), (1 - F.min("out")).alias("called"))
        told = settled(open_.join(ends, "node", "left").select("node", F.coalesce("calls", F.lit(0)).alias("calls"), F.coalesce("called", F.lit(0)).alias("called")), "told")
        parts.append(told.where("called = 0").select("node", F.lit(at).cast("long").alias("level")))
        waiting.append(told.where("called = 1 and calls = 0").select("node", F.lit(at).alias("at")))
        open_ = told.where("called = 1 and calls = 1").select("node")
        before, left = left, settled(_among(left, open_), "left")
        if at:
            dropped(before)
    else:
        raise RuntimeError("levels did not settle")
    core = settled(_walked_whole(left, F.lit(True)).select("node", (F.col("level") + at).alias("level")), "core")
    parts += [core, open_.join(core, "node", "left_anti").select("node", F.lit(at).cast("long").alias("level"))]
    levels = settled(functools.reduce(DataFrame.unionByName, parts), "levels")
    if waiting:
        late = functools.reduce(DataFrame.unionByName, waiting).withColumnRenamed("node", "dst")
        into = settled(links.join(late, "dst").join(levels.withColumnRenamed("node", "src"), "src", "left"), "into")
        known = into.where("level is not null").groupBy("dst").agg(F.max("level").alias("level"))
        # all but the links between those that wait is told at once
        known, between = settled(known, "known"), settled(into.where("level is null").select("src", "dst", "at"), "between")
        come = None
        for k in reversed(range(len(waiting))):
            here = waiting[k].select("node").join(known.withColumnRenamed("dst", "node"), "node", "left")
            if come is not None:
                more = between.where(F.col("at") == k).join(come.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.max("level").alias("more"))
                here = here.join(more, "node", "left").select("node", F.greatest("level", "more").alias("level"))
            here = settled(here.select("node", (F.col("level") + 1).alias("level")), "level")
            come = here if come is None else come.unionByName(here)
        levels = settled(levels.unionByName(come), "levels")
    return levels


def condensed(edges: DataFrame, max_rounds: int = 10_000, small: int = SMALL, levels: bool = True) -> tuple[DataFrame, DataFrame]:
    """(services, links): ``node, component, level, part`` of every node, and the distinct ``src, dst`` between components, staged.

    ``level`` is the longest path to a component. A path from one component to another goes up in level, so that equal components are joined, other
    components of one level are not, and a search for the rest never looks beyond the level of its target. No path leaves a ``part``.

    A graph of more than ``small`` edges is split into weakly connected parts. Those of at most ``small`` edges are walked whole, each in one task, tiny ones
    together; larger ones go by joins, down to a core of at most ``small`` edges. Without ``levels`` these have none, which ``joined_in_groups`` does not need.
    """
    edges = settled(edges.select("src", "dst").distinct(), "edges")
    if edges.count() <= small:
        services = settled(_walked_whole(edges, F.lit(True)), "services")
        return services, _linked(edges, services)
    parts = weak_parts(edges)
    named = edges.join(parts.withColumnRenamed("node", "src"), "src")
    named = settled(named.join(named.groupBy("part").agg(F.count(F.lit(1)).alias("n")), "part").select("src", "dst", "part", "n"), "named")
    few = named.where(F.col("n") <= small)
    alone = F.when(F.col("n") > small // 16, F.col("part"))
    shards = 1 + few.count() // max(small // 16, 1)
    services = settled(_walked_whole(few.select("src", "dst", alone.alias("alone"), F.when(alone.isNull(), F.pmod(F.xxhash64("part"), F.lit(shards))).alias("shard")), F.col("alone"), F.col("shard")), "services")
    rest = settled(named.where(F.col("n") > small).select("src", "dst"), "large")
    dropped(named)
    if not rest.isEmpty():
        members = settled(strong_components(rest, max_rounds, small), "members")
        if levels:
            told = _levels(_linked(rest, members), members, max_rounds, small)
            by_joins = members.join(told.select(F.col("node").alias("component"), "level"), "component")
        else:
            by_joins = members.withColumn("level", F.lit(None).cast("long"))
        by_joins = by_joins.join(parts, "node").select("node", "component", "level", "part")
        services = settled(services.unionByName(by_joins), "services")
    return services, _linked(edges, services)


def reaching(links: Iterable[tuple], targets: list) -> dict:
    """Which ``targets`` each node reaches or is, as the bits of an integer; ``links`` (source, destination) come with the highest sources first."""
    bit = {t: 1 << i for i, t in enumerate(targets)}
    far = dict(bit)
    for a, b in links:
        if b in far:
            far[a] = far.get(a, 0) | far[b]
    return far


def _bits(n: int) -> Iterator[int]:
    while n:
        low = n & -n
        yield low.bit_length() - 1
        n ^= low


def _placed(services: DataFrame, links: DataFrame) -> DataFrame:
    """``src, dst`` with the ``level`` of the source and the ``part`` of both."""
    return links.join(services.where("node = component").select(F.col("node").alias("src"), "level", "part"), "src").select("part", "level", "src", "dst")


def _told_in_parts(placed: DataFrame, asked: DataFrame, of: list[str], one: Callable[[list[tuple], pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """``one(links, rows)`` for each part with its ``asked`` rows; rows of a part that are many are dealt out by ``of``, with the part's links beside each share."""
    shares = asked.groupBy("part").agg((1 + F.floor(F.count(F.lit(1)) / ASKED)).cast("int").alias("shares"))
    rows = asked.join(shares, "part").withColumn("share", F.pmod(F.xxhash64(*of), "shares").cast("int")).drop("shares")
    beside = placed.join(shares, "part").withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1))).drop("shares")

    def told(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left = left.sort_values("level", ascending=False)
        return one(list(zip(left["src"], left["dst"], strict=True)), right)

    return beside.groupBy("part", "share").cogroup(rows.groupBy("part", "share")).applyInPandas(told, schema)


def _oversized(placed: DataFrame, small: int) -> DataFrame:
    """The parts of more than ``small`` links, or without levels."""
    return settled(placed.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.count("level").alias("levels")).where((F.col("n") > small) | (F.col("levels") < F.col("n"))).select("part"), "oversized")


def _shortcuts(links: DataFrame) -> tuple[DataFrame, bool]:
    """``src, dst`` of the paths of up to 1, 2, 4 ... of the acyclic ``links``, as far as a join makes no more rows than a few times the links, and whether these are all paths."""
    now, n = links, links.count()
    most = JOINED * n
    while True:
        outs, ins = (now.groupBy(F.col(c).alias("at")).agg(F.count(F.lit(1)).alias(f"n{c}")) for c in ("src", "dst"))
        rows = outs.join(ins, "at").agg(F.sum(F.col("nsrc") * F.col("ndst"))).first()[0] or 0
        if rows == 0 or rows > most:
            return now, rows == 0
        more = now.select("src", F.col("dst").alias("at")).join(now.select(F.col("src").alias("at"), "dst"), "at").select("src", "dst")
        grown = settled(now.unionByName(more).distinct(), "shortcuts")
        if now is not links:
            dropped(now)
        was, n, now = n, grown.count(), grown
        if n == was:
            return now, True


def _visited(services: DataFrame, links: DataFrame, starts: DataFrame, max_rounds: int) -> DataFrame:
    """``low, at``: the components that each of the distinct ``starts(low, top)`` reaches, or is, up to the level ``top`` if there is one, searched by joins from all starts at once along shortcuts. Each visit is written once."""
    level = services.where("node = component").select(F.col("node").alias("at"), "level")
    short, whole = _shortcuts(links)
    steps = settled(short.join(level.select(F.col("at").alias("dst"), "level"), "dst").select(F.col("src").alias("at"), "dst", "level"), "steps")
    if short is not links:
        dropped(short)
    front = settled(starts.select("low", F.col("low").alias("at"), "top"), "front")
    seen = front
    for _ in range(max_rounds):
        step = front.join(steps, "at").where("coalesce(level <= top, true)").select("low", F.col("dst").alias("at"), "top").distinct()
        front = settled(step if whole else step.join(seen, ["low", "at"], "left_anti"), "front")
        seen = seen.unionByName(front)
        if whole or front.isEmpty():
            return seen.select("low", "at")
    raise RuntimeError("paths did not settle")


def joined_pairs(services: DataFrame, links: DataFrame, pairs: DataFrame, max_rounds: int = 10_000, small: int = SMALL) -> DataFrame:
    """Those of the distinct ``pairs(src, dst)`` that a directed path joins, either way, told from ``condensed``'s tables.

    Members of one component are joined, those of different parts or of one level are not. The rest is told part by part: one task passes the bits of what is asked for up a part of
    at most ``small`` links. In larger ones a search by joins starts at the component of lower level, and a front stops at the highest level that its start asks for.
    """
    of = lambda c: services.select(F.col("node").alias(c), F.col("component").alias(f"c{c}"), F.col("level").alias(f"l{c}"), F.col("part").alias(f"p{c}"))
    told = pairs.select("src", "dst").distinct().join(of("src"), "src").join(of("dst"), "dst").where("psrc = pdst and (csrc = cdst or lsrc <> ldst)")
    told = settled(told, "pairs")
    up = F.col("lsrc") < F.col("ldst")
    low, high = F.when(up, F.col("csrc")).otherwise(F.col("cdst")), F.when(up, F.col("cdst")).otherwise(F.col("csrc"))
    asked = told.where("csrc <> cdst").select(low.alias("low"), high.alias("high"), F.greatest("lsrc", "ldst").alias("top"), F.col("psrc").alias("part")).distinct()
    asked, placed = settled(asked, "asked"), settled(_placed(services, links), "placed")
    large = _oversized(placed, small)

    def one(calls: list[tuple], rows: pd.DataFrame) -> pd.DataFrame:
        ends, hits = sorted(set(rows["high"])), []
        for k in range(0, len(ends), TARGETS):
            block = ends[k : k + TARGETS]
            at, far = {t: i for i, t in enumerate(block)}, reaching(calls, block)
            hits += [(a, b) for a, b in zip(rows["low"], rows["high"], strict=True) if b in at and far.get(a, 0) >> at[b] & 1]
        return pd.DataFrame(hits, columns=["low", "high"])

    kind = services.schema["node"].dataType.simpleString()
    fits = lambda df: df.join(large, "part", "left_anti")
    hit = _told_in_parts(fits(placed), fits(asked), ["high"], one, f"low {kind}, high {kind}")
    if not large.isEmpty():
        rest = asked.join(large, "part", "left_semi")
        seen = _visited(services, settled(placed.join(large, "part", "left_semi").select("src", "dst"), "large"), rest.groupBy("low").agg(F.max("top").alias("top")), max_rounds)
        hit = hit.unionByName(rest.join(seen.withColumnRenamed("at", "high"), ["low", "high"], "left_semi").select("low", "high"))
    found = told.withColumns({"low": low, "high": high}).join(hit.withColumn("hit", F.lit(True)), ["low", "high"], "left")
    return found.where("csrc = cdst or hit").select("src", "dst")


def joined_in_groups(services: DataFrame, links: DataFrame, asked: DataFrame, max_rounds: int = 10_000, small: int = SMALL) -> DataFrame:
    """Distinct ``src, dst`` that a directed path joins, either way, of which a row of ``asked(group, at, node)`` with ``src`` has a smaller ``at`` than one of its group with ``dst``.

    Only what is joined becomes a row: a task holds the links of a part of at most ``small`` and the asked rows of some groups there. In larger parts
    a search by joins starts at every asked component, and what it visits meets the groups of both.
    """
    rows = asked.where("group is not null and at is not null").groupBy("group", "node").agg(F.min("at").alias("lo"), F.max("at").alias("hi"))
    rows = settled(rows.join(services, "node").select("group", "node", "lo", "hi", "component", "level", "part"), "asked")
    placed = settled(_placed(services, links), "placed")
    large = _oversized(placed, small)

    def one(calls: list[tuple], rows: pd.DataFrame) -> pd.DataFrame:
        groups: dict = {}
        for g, *row in zip(rows["group"], rows["component"], rows["node"], rows["lo"], rows["hi"], strict=True):
            groups.setdefault(g, {}).setdefault(row[0], []).append(row[1:])
        ends, out = sorted(set(rows["component"])), []
        for k in range(0, len(ends), TARGETS):
            block = ends[k : k + TARGETS]
            at, far = {t: i for i, t in enumerate(block)}, reaching(calls, block)
            for members in groups.values():
                mask = sum(1 << at[c] for c in members if c in at)
                for c, starts in members.items():
                    for i in _bits(far.get(c, 0) & mask):
                        above = members[block[i]]
                        for a, lo, hi in starts:
                            out.append((a, [b for b, _, late in above if lo < late]))
                            if block[i] != c:
                                out += [(b, [a]) for b, early, _ in above if early < hi]
        return pd.DataFrame([x for x in out if x[1]], columns=["src", "dst"])

    kind = services.schema["node"].dataType.simpleString()
    fits = lambda df: df.join(large, "part", "left_anti")
    found = _told_in_parts(fits(placed), fits(rows), ["group"], one, f"src {kind}, dst array<{kind}>").select("src", F.explode("dst").alias("dst"))
    if not large.isEmpty():
        rest = settled(rows.join(large, "part", "left_semi"), "large")
        top = rest.groupBy("group", "part").agg(F.max("level").alias("top"))
        starts = rest.join(top, ["group", "part"]).groupBy(F.col("component").alias("low")).agg(F.max("top").alias("top"))
        seen = _visited(services, settled(placed.join(large, "part", "left_semi").select("src", "dst"), "large"), starts, max_rounds)
        of = lambda c: rest.select("group", F.col("component").alias(c)).distinct()
        met = seen.join(of("at").select("at").distinct(), "at", "left_semi").join(of("low"), "low").join(of("at"), ["group", "at"], "left_semi")
        a = rest.select("group", F.col("component").alias("low"), F.col("node").alias("a"), F.col("lo").alias("alo"), F.col("hi").alias("ahi"))
        b = rest.select("group", F.col("component").alias("at"), F.col("node").alias("b"), F.col("lo").alias("blo"), F.col("hi").alias("bhi"))
        up = F.struct(F.col("a").alias("src"), F.col("b").alias("dst"), F.expr("alo < bhi").alias("ok"))
        back = F.struct(F.col("b").alias("src"), F.col("a").alias("dst"), F.expr("low <> at and blo < ahi").alias("ok"))
        found = found.unionByName(met.join(a, ["group", "low"]).join(b, ["group", "at"]).select(F.inline(F.array(up, back))).where("ok").select("src", "dst"))
    return found.distinct()
