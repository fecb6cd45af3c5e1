"""Components of items that meet in MinHash buckets: one leader first, then every candidate that is still apart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causetrace.llm.common import stage, unstage
from causetrace.llm.components import connected_components

#: Members of a group whose pairs are all compared.
FEW = 8
#: Candidates that are drawn first for each line of the largest group, and how many times as many each time after.
DRAWN, MORE = 64, 8
#: Members of a group that meet all others of it in one task, and pairs that are verified at once.
SHARE, SLICE = 1024, 1_000_000


def band_keys(m: Column, bands: int, rows: int) -> list[Column]:
    """One key for each band of the MinHash values ``m``."""
    return [F.xxhash64(F.lit(b), *[m[i] for i in range(b * rows, b * rows + rows)]) for b in range(bands)]


def _agreement(p: str, q: str, values: int) -> Column:
    return sum((F.col(f"{p}.m")[i] == F.col(f"{q}.m")[i]).cast("int") for i in range(values))


def _alike(p: str, q: str, values: int, agree: int) -> Column:
    return _agreement(p, q, values) >= agree


def _rarest(lines: DataFrame, values: int, k: int) -> DataFrame:
    """``id, v``: the ``k`` of each line's values that the fewest of ``lines(id, m, c)`` have, ties by the value, so that all lines have one order. Of two lines that agree in more than ``values - k`` values, one is among the ``k`` of both."""
    each = lines.select("id", F.explode(F.array(*[F.xxhash64(F.lit(i), F.col("m")[i]) for i in range(values)])).alias("v"))
    often = stage(each.groupBy("v").agg(F.count(F.lit(1)).alias("n")), "often")
    placed = each.join(often.hint("merge"), "v").groupBy("id").agg(F.slice(F.sort_array(F.collect_list(F.struct("n", "v"))), 1, k).alias("first"))
    rarest = stage(placed.select("id", F.explode("first").alias("t")).select("id", "t.v"), "rarest")
    unstage(often)
    return rarest


def _within(p: str, q: str, similarity: float) -> Column:
    """False only for two lines whose sets can't have a Jaccard similarity of ``similarity``: each mark that one set has and the other lacks is of an element that the other lacks."""
    differ = F.size(f"{p}.marks") + F.size(f"{q}.marks") - 2 * F.size(F.array_intersect(f"{p}.marks", f"{q}.marks"))
    return differ <= (F.col(f"{p}.size") + F.col(f"{q}.size")) * ((1 - similarity) / (1 + similarity)) + 1e-6


def _placed(apart: DataFrame, values: int, agree: int, sketch: Callable[[DataFrame], DataFrame] | None) -> tuple[DataFrame, DataFrame]:
    """``id, v`` and ``id, m, first`` (with ``sketch`` also ``size, marks``) of the lines of ``apart(key, x, c)``: the values at which they meet others, and what they are compared by."""
    lines = stage(apart.groupBy("x.id").agg(F.first("x.m").alias("m")), "lines")
    rarest = _rarest(lines, values, values - agree + 1)
    told = lines.join(rarest.groupBy("id").agg(F.collect_list("v").alias("first")).hint("merge"), "id")
    if sketch is not None:
        shared = rarest.groupBy("v").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("v")
        told = told.join(sketch(rarest.join(shared.hint("merge"), "v").select("id").distinct()).hint("merge"), "id")
    told = stage(told, "told")
    unstage(lines)
    return rarest, told


def _meeting(rarest: DataFrame, comp: DataFrame) -> DataFrame:
    """``id, c, v, n`` of the lines that meet one of another component ``c`` at ``v``, which ``n`` lines have; ``comp(node, component)`` names the joined ones."""
    named = rarest.join(comp.select(F.col("node").alias("id"), "component").hint("merge"), "id", "left").select("id", "v", F.coalesce("component", "id").alias("c"))
    named = stage(named, "named")
    several = named.groupBy("v").agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("c0"), F.max("c").alias("c1")).where("c0 <> c1").select("v", "n")
    meeting = stage(named.join(several.hint("merge"), "v"), "meeting")
    unstage(named)
    return meeting


def _told(meeting: DataFrame, told: DataFrame, seen: DataFrame, values: int, agree: int, similarity: float | None, one_in: int = 1, but: int = 0) -> DataFrame:
    """Every pair ``a, b`` of different components that agrees in at least ``agree`` values, isn't ``seen`` and is among those drawn: one pair in ``one_in``, without the one in ``but`` that was drawn before.

    Lines meet where they share one of their rarest values, and are a pair at the first that they share. A value that many lines have is dealt out, so that no task holds more than ``SHARE`` times
    its lines. With ``similarity``, pairs whose sets can't be of it don't become rows.
    """
    rest = [c for c in told.columns if c != "id"]
    shares = (1 + F.floor(F.col("n") / SHARE)).cast("int")
    met = stage(meeting.withColumn("shares", shares).join(told.hint("merge"), "id").select("v", "shares", F.struct("id", "c", *rest).alias("x")), "met")
    p = met.select("v", F.pmod(F.xxhash64("x.id"), "shares").cast("int").alias("share"), F.col("x").alias("p"))
    q = met.select("v", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), F.col("x").alias("q"))
    alike = (F.col("p.id") < F.col("q.id")) & (F.col("p.c") != F.col("q.c"))
    draw = F.xxhash64(F.lit(11), "p.id", "q.id")
    if one_in > 1:
        alike &= F.pmod(draw, F.lit(one_in)) == 0
    if but:
        alike &= F.pmod(draw, F.lit(but)) != 0
    # the lambda also keeps this condition out of the join's generated method, which would be too long for the JVM to compile
    before = F.exists("p.first", lambda f: (f < F.col("v")) & F.array_contains("q.first", f))
    alike &= _alike("p", "q", values, agree) & ~before
    if similarity is not None:
        alike &= _within("p", "q", similarity)
    # into many parts: little to read, but much to compare
    parts = 4 * int(met.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    p, q = p.repartition(parts, "v", "share"), q.repartition(parts, "v", "share")
    pairs = p.join(q.hint("merge"), ["v", "share"]).where(alike).select(F.col("p.id").alias("a"), F.col("q.id").alias("b"))
    pairs = stage(pairs.join(seen.hint("merge"), ["a", "b"], "left_anti"), "left")
    unstage(met)
    return pairs


def _left_over(apart: DataFrame, seen: DataFrame, values: int, agree: int, sketch: Callable[[DataFrame], DataFrame] | None = None, similarity: float = 0.0) -> DataFrame:
    """Every pair ``a, b`` of different components among the lines of ``apart(key, x, c)`` that agrees in at least ``agree`` values and isn't ``seen``; no such pair shares none of its lines' rarest values.

    With ``sketch``, pairs whose sets can't be of that ``similarity`` don't become rows.
    """
    rarest, told = _placed(apart, values, agree, sketch)
    meeting = _meeting(rarest, apart.select(F.col("x.id").alias("node"), F.col("c").alias("component")).distinct())
    pairs = _told(meeting, told, seen, values, agree, None if sketch is None else similarity)
    for x in (rarest, told, meeting):
        unstage(x)
    return pairs


def _between(pairs: DataFrame, comp: DataFrame) -> DataFrame:
    """The ``pairs(a, b)`` whose ends are in different components."""
    of = lambda c: comp.select(F.col("node").alias(c), F.col("component").alias(f"c{c}")).hint("merge")
    told = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left")
    return stage(told.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b"), "between")


def _pairs_of_few(members: DataFrame, key: str, values: int, agree: int) -> DataFrame:
    """Candidates ``a, b`` within groups of ``members(key, x)``; a group has at most ``FEW`` members."""
    met = members.groupBy(key).agg(F.collect_list("x").alias("all")).select("all", F.explode("all").alias("x")).select("x", F.explode("all").alias("y"))
    return met.where("x.id < y.id").where(_alike("x", "y", values, agree)).select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))


def _first(members: DataFrame, values: int, agree: int) -> tuple[DataFrame, DataFrame]:
    """Candidates ``a, b``, and ``key, x`` of the buckets of more than ``FEW`` members. Candidates are all of small buckets, and of larger ones each member with the leader of one of its buckets, of those that it
    is a candidate with the one that has the most common values, and with the members that share a rare value with it: one that at most ``FEW`` members of large buckets have."""
    sizes = stage(members.groupBy("key").agg(F.count(F.lit(1)).alias("n")), "sizes")
    led = stage(members.join(sizes.hint("merge"), "key").select("key", "x", (F.col("n") > FEW).alias("many")), "led")
    unstage(sizes)
    small, large = led.where("not many"), led.where("many")
    big = stage(large.select("x").groupBy("x.id").agg(F.first("x").alias("x")).select("x"), "big")
    single = F.explode(F.array(*[F.xxhash64(F.lit(i), F.col("x.m")[i]) for i in range(values)])).alias("v")
    often = stage(big.select(single).groupBy("v").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "often")
    # the line whose values the most lines have leads: most of a template are near it
    weight = big.select(F.col("x.id").alias("id"), single).join(often.hint("merge"), "v").groupBy("id").agg(F.sum("n").alias("w"))
    weighed = stage(large.join(weight.hint("merge"), F.col("x.id") == F.col("id")).select("key", "x", "w"), "weighed")
    leaders = weighed.groupBy("key").agg(F.max(F.struct("w", "x")).alias("l"))
    heads = weighed.join(leaders.hint("merge"), "key").select("x", F.col("l.w").alias("w"), F.col("l.x").alias("l"))
    heads = heads.where("x.id <> l.id").where(_alike("x", "l", values, agree)).groupBy("x.id").agg(F.max(F.struct("w", "l.id")).alias("l"))
    heads = heads.select(F.least("id", "l.id").alias("a"), F.greatest("id", "l.id").alias("b"))
    rare = often.where(F.col("n") <= FEW).select("v")
    rare = stage(rare, "rare")
    sharing = big.select(single, "x").join(rare.hint("merge"), "v")
    pairs = heads.unionByName(_pairs_of_few(small, "key", values, agree)).unionByName(_pairs_of_few(sharing, "v", values, agree))
    pairs = stage(pairs.distinct(), "pairs")
    rest = stage(large.select("key", "x"), "rest")
    for x in (led, big, often, weighed, rare):
        unstage(x)
    return pairs, rest


def _joined(comp: DataFrame, links: DataFrame) -> DataFrame:
    """``node, component`` after more ``links(a, b)``: the named components are joined, not their nodes again."""
    of = lambda c: comp.select(F.col("node").alias(c), F.col("component").alias(f"c{c}")).hint("merge")
    ends = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    grown = connected_components(ends).select(F.col("node").alias("component"), F.col("component").alias("to"))
    nodes = comp.unionByName(links.select(F.explode(F.array("a", "b")).alias("node")).select("node", F.col("node").alias("component")))
    nodes = nodes.groupBy("node").agg(F.min("component").alias("component"))
    return stage(nodes.join(grown.hint("merge"), "component", "left").select("node", F.coalesce("to", "component").alias("component")), "components")


def _apart(members: DataFrame, comp: DataFrame) -> DataFrame:
    """``key, x, c`` (component) of the buckets that hold several components."""
    named = members.join(comp.withColumnRenamed("node", "id").hint("merge"), F.col("x.id") == F.col("id"), "left").select("key", "x", F.coalesce("component", "x.id").alias("c"))
    named = stage(named, "told")
    counted = named.groupBy("key", "c").agg(F.count(F.lit(1)).alias("n"))
    several = counted.groupBy("key").agg(F.count(F.lit(1)).alias("cs")).where("cs > 1").select("key")
    rest = stage(named.join(several.hint("merge"), "key").select("key", "x", "c"), "rest")
    unstage(named)
    return rest


def verified_components(members: DataFrame, values: int, agree: int, verify: Callable[[DataFrame], DataFrame], links: DataFrame | None = None, most: int = SLICE, sketch: Callable[[DataFrame], DataFrame] | None = None, similarity: float = 0.0) -> DataFrame:
    """``node, component`` over the verified links of ``members(key, x)``, ``x`` a struct of ``id`` and ``values`` MinHash values ``m``.

    A pair of a bucket is a candidate if it agrees in at least ``agree`` values; ``verify(pairs a, b)`` gives the staged links among
    candidates. All pairs of a bucket of at most ``FEW`` members are compared. In a larger one each member meets a leader,
    the line with the most common values, and those that share a rare value with it: lines of one template agree in the values of the template, near copies in rare ones too.
    Of the buckets that then still hold several components, every candidate between two of them is verified (see ``_rest_joined``). So no link of a candidate is lost. ``sketch(ids)`` gives
    ``id, size, marks`` of sets: with it, candidates that can't be of ``similarity`` are told before they become rows.
    """
    seen, rest = _first(members, values, agree)
    found = verify(seen)
    links = found if links is None else stage(links.unionByName(found), "links")
    comp = stage(connected_components(links), "components")
    apart = _apart(rest, comp)
    comp = _rest_joined(apart, seen, comp, values, agree, verify, most, sketch, similarity)
    for x in (seen, links, rest, apart):
        unstage(x)
    return comp


def _rest_joined(apart: DataFrame, seen: DataFrame, comp: DataFrame, values: int, agree: int, verify: Callable[[DataFrame], DataFrame], most: int, sketch: Callable[[DataFrame], DataFrame] | None, similarity: float) -> DataFrame:
    """``comp`` after the verified links of all candidates between components of ``apart(key, x, c)``.

    A group in which all are linked has a link for each pair. So candidates are drawn at random, first few for each line of the largest group, then ``MORE`` times as many each time, at last all,
    and components grow in between: of links of which one in ``MORE`` was drawn before, no more than ``MORE`` for each line are expected to be left between components, whatever the group's size.
    Rows are verified about ``most`` at once.
    """
    if apart.isEmpty():
        return comp
    rarest, told = _placed(apart, values, agree, sketch)
    one_in = but = 0
    while but != 1:
        meeting = _meeting(rarest, comp)
        n, lines = meeting.agg(F.max("n"), F.count_distinct("id")).first()
        if not lines:
            unstage(meeting)
            break
        if not but:
            one_in = 1
            while n > DRAWN * one_in:
                one_in *= MORE
        left = _told(meeting, told, seen, values, agree, None if sketch is None else similarity, one_in, but)
        unstage(meeting)
        drawn = count = left.count()
        while count:
            slices = 1 + count // most
            at = F.pmod(F.xxhash64("a", "b", F.lit(slices)), F.lit(slices))
            part, later = (left, None) if slices == 1 else (stage(left.where(at == 0), "part"), left.where(at != 0))
            found = verify(part)
            if not found.isEmpty():
                before, comp = comp, _joined(comp, found)
                unstage(before)
            unstage(found)
            before, left = left, None if later is None else _between(later, comp)
            count = 0 if left is None else left.count()
            for x in (part, before):
                unstage(x)
        # all at once if few are expected
        but, one_in = one_in, 1 if drawn * one_in <= MORE * lines else one_in // MORE
    unstage(rarest)
    unstage(told)
    return comp
