"""Causal graphs as node and edge tables: closure, cycles, pruning, events."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from causetrace.functions.shared import dropped, settled
from causetrace.operators import condense


def build_causal_graph(incidents: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """C4: (nodes, edges): a node for each anomalous metric, an edge for each significant pair."""
    nodes = incidents.select("incident_id", "metric", F.col("max_score").alias("anomaly_score"))
    return nodes, pairs.select("incident_id", "cause", "effect", "strength", "p_value", "lag")


def closure(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """All ``incident_id, src, dst`` joined by a directed path of one step or more; paths double each round."""
    paths = settled(edges.select("incident_id", "src", "dst").distinct())
    n = paths.count()
    for _ in range(max_rounds):
        more = paths.alias("p").join(paths.alias("q"), (F.col("p.incident_id") == F.col("q.incident_id")) & (F.col("p.dst") == F.col("q.src")))
        grown = settled(paths.union(more.select("p.incident_id", "p.src", "q.dst")).distinct())
        dropped(paths)
        was, n, paths = n, grown.count(), grown
        if n == was:
            return paths
    raise RuntimeError("paths did not settle")


def _links(edges: DataFrame) -> DataFrame:
    return edges.select("incident_id", F.col("cause").alias("src"), F.col("effect").alias("dst"))


def reached(links: dict[str, set[str]]) -> dict[str, set[str]]:
    """All nodes that each node of a small graph reaches by one step or more."""
    out = {}
    for start in links:
        seen: set[str] = set()
        stack = list(links[start])
        while stack:
            node = stack.pop()
            if node not in seen:
                seen.add(node)
                stack.extend(links.get(node, ()))
        out[start] = seen
    return out


def depths(links: dict[str, set[str]], start: str) -> dict[str, int]:
    """Steps from ``start`` to each node that it reaches by one step or more."""
    out: dict[str, int] = {}
    front, depth = {start}, 0
    while front:
        depth += 1
        front = {y for x in front for y in links.get(x, ())} - out.keys()
        out.update(dict.fromkeys(front, depth))
    return out


def incident_closure(edges: DataFrame) -> DataFrame:
    """``incident_id, src, dst, depth`` of every causal path, with the fewest steps. An incident's graph has at most its metrics as nodes, so each
    is walked whole in one task, all incidents in parallel after one shuffle."""

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        links: dict[str, set[str]] = {}
        for a, b in zip(pdf["src"], pdf["dst"], strict=True):
            links.setdefault(a, set()).add(b)
        rows = [(*key, a, b, d) for a in links for b, d in depths(links, a).items()]
        return pd.DataFrame(rows, columns=["incident_id", "src", "dst", "depth"])

    return _links(edges).groupBy("incident_id").applyInPandas(one, "incident_id string, src string, dst string, depth int")


def _acyclic(edges: list[tuple[bool, float, str, str]]) -> set[tuple[str, str]]:
    """The edges to drop: while a set of nodes reaches itself, its first edge in order (violators, then the weakest) goes."""
    left, gone = sorted((not late, s, a, b) for late, s, a, b in edges), set()
    while True:
        links: dict[str, set[str]] = {}
        for _, _, a, b in left:
            links.setdefault(a, set()).add(b)
        far = reached(links)
        first: dict[frozenset, tuple] = {}
        for e in left:
            a, b = e[2], e[3]
            if a in far.get(b, ()):
                first.setdefault(frozenset(x for x in far[a] if a in far.get(x, ())), e)
        if not first:
            return gone
        drop = set(first.values())
        gone |= {(a, b) for _, _, a, b in drop}
        left = [e for e in left if e not in drop]


def break_cycles(edges: DataFrame, first_seen: DataFrame | None = None) -> DataFrame:
    """Edges without cycles. In each strongly connected set one edge goes at a time: first one whose cause was seen after
    its effect, else the weakest (by strength, cause, effect). One incident's graph is one group.
    """
    now = edges
    if first_seen is not None:
        t = lambda c: first_seen.select("incident_id", F.col("metric").alias(c), F.col("first_seen").alias(f"__{c}"))
        now = now.join(t("cause"), ["incident_id", "cause"], "left").join(t("effect"), ["incident_id", "effect"], "left")
        now = now.withColumn("__late", F.coalesce(F.col("__cause") > F.col("__effect"), F.lit(False))).select(*edges.columns, "__late")
    else:
        now = now.withColumn("__late", F.lit(False))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        gone = _acyclic(list(zip(pdf["__late"], pdf["strength"], pdf["cause"], pdf["effect"], strict=True)))
        keep = [(a, b) not in gone for a, b in zip(pdf["cause"], pdf["effect"], strict=True)]
        return pdf[keep].drop(columns="__late")

    return now.groupBy("incident_id").applyInPandas(one, edges.schema)


def simple_cycles(links: dict[str, set[str]]) -> Iterator[list[str]]:
    """Every simple cycle once, from its smallest node on, in order of the sequences of nodes (Johnson's blocking: a node that led nowhere waits until a node on its way is freed)."""
    far = reached(links)
    for start in sorted(links):
        if start not in far[start]:
            continue
        # the rest of the cycle is larger than its start and gets back to it
        inside = {n for n in far[start] if n >= start and start in far.get(n, ())}
        after = {n: sorted(x for x in links.get(n, ()) if x in inside) for n in inside}
        path, blocked, waiting = [start], {start}, {n: set() for n in inside}
        stack, closed = [iter(after[start])], [False]
        while stack:
            node = next(stack[-1], None)
            if node == start:
                closed[-1] = True
                yield list(path)
            elif node is not None and node not in blocked:
                path.append(node)
                blocked.add(node)
                stack.append(iter(after[node]))
                closed.append(False)
            elif node is None:
                last, found = path.pop(), closed.pop()
                stack.pop()
                if found:
                    free = [last]
                    while free:
                        n = free.pop()
                        if n in blocked:
                            blocked.discard(n)
                            free += waiting[n]
                            waiting[n].clear()
                else:
                    for n in after[last]:
                        waiting[n].add(last)
                if closed:
                    closed[-1] |= found


def _weakest_of_cycles(edges: list[tuple[float, str, str]], most: int) -> set[tuple[str, str]]:
    """The edges that one pass over the simple cycles of the whole graph drops."""
    strength = {(a, b): s for s, a, b in edges}
    links: dict[str, set[str]] = {}
    for _, a, b in edges:
        links.setdefault(a, set()).add(b)
    gone: set[tuple[str, str]] = set()
    for k, cycle in enumerate(simple_cycles(links)):
        if k == most:
            left = [(False, s, a, b) for s, a, b in edges if (a, b) not in gone]
            return gone | _acyclic(left)
        steps = [e for e in zip(cycle, [*cycle[1:], cycle[0]], strict=True) if e not in gone]
        if steps:
            gone.add(min(steps, key=lambda e: (strength[e], e)))
    return gone


def break_cycles_weakest(edges: DataFrame, most: int = 100_000) -> DataFrame:
    """Edges without cycles, by one pass over the simple cycles of the input graph, ordered by their nodes from the smallest on: each loses its weakest remaining edge (ties by name),
    even if an earlier cycle has already broken it.

    Cycles may be exponentially many: after ``most`` of an incident, C5's rule breaks what is left. One incident's graph is one group.
    """

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        gone = _weakest_of_cycles(list(zip(pdf["strength"], pdf["cause"], pdf["effect"], strict=True)), most)
        return pdf[[(a, b) not in gone for a, b in zip(pdf["cause"], pdf["effect"], strict=True)]]

    return edges.groupBy("incident_id").applyInPandas(one, edges.schema)


def temporal_precedence_filter(edges: DataFrame, first_seen: DataFrame) -> DataFrame:
    """Without edges whose cause was first seen after their effect; unknown and equal times stay."""
    t = lambda c: first_seen.select("incident_id", F.col("metric").alias(c), F.col("first_seen").alias(f"__{c}"))
    got = edges.join(t("cause"), ["incident_id", "cause"], "left").join(t("effect"), ["incident_id", "effect"], "left")
    return got.where(F.coalesce(F.col("__cause") <= F.col("__effect"), F.lit(True))).select(*edges.columns)


def reachability(topology: DataFrame) -> DataFrame:
    """``src, dst``: services joined by a directed path either way, or the same. All pairs: for large graphs take ``reachability_labels``."""
    known = topology.select(F.explode(F.array("src", "dst")).alias("s")).distinct().select(F.col("s").alias("src"), F.col("s").alias("dst"))
    paths = closure(topology.select(F.lit(0).alias("incident_id"), "src", "dst")).select("src", "dst")
    return paths.union(paths.select("dst", "src")).union(known).distinct()


def reachable_pairs(topology: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those of the distinct ``pairs(src, dst)`` that a directed path joins, either way: a search over the condensed graph from the services that occur in ``pairs`` alone."""
    services, links = condense.condensed(topology)
    return condense.joined_pairs(services, links, pairs)


def reachable_in_groups(topology: DataFrame, asked: DataFrame) -> DataFrame:
    """The distinct ``src, dst`` that a directed path joins, either way, where ``asked(group, at, service)`` has ``src`` before ``dst`` in one group; pairs that no path joins never become rows."""
    services, links = condense.condensed(topology, levels=False)
    return condense.joined_in_groups(services, links, asked.select("group", "at", F.col("service").alias("node")))


def reachability_labels(topology: DataFrame) -> DataFrame:
    """C9, linear in the services: ``service, component, level``. Services of one component are joined, others of one level are not, and a path only goes up; ``reachable_pairs`` tells the rest."""
    return condense.condensed(topology)[0].select(F.col("node").alias("service"), "component", "level")


def service_of_metric(metric: Column) -> Column:
    """The first two name parts; a name of one part belongs to ``unknown_service``."""
    parts = F.split(metric, "_")
    return F.when(F.size(parts) < 2, "unknown_service").otherwise(F.array_join(F.slice(parts, 1, 2), "_"))


def refine_by_topology(edges: DataFrame, topology: DataFrame, cause_service: Column | None = None, effect_service: Column | None = None) -> DataFrame:
    """C11: without edges between known services that no path joins; an empty topology changes nothing."""
    a, b = cause_service if cause_service is not None else service_of_metric(F.col("cause")), effect_service if effect_service is not None else service_of_metric(F.col("effect"))
    known = topology.select(F.explode(F.array("src", "dst")).alias("s")).distinct()
    got = edges.withColumns({"__a": a, "__b": b})
    joined = reachable_pairs(topology, got.select("__a", "__b").where("__a <> __b").distinct().toDF("src", "dst")).unionByName(known.select(F.col("s").alias("src"), F.col("s").alias("dst")))
    got = got.join(known.select(F.col("s").alias("__a"), F.lit(True).alias("__ka")), "__a", "left").join(known.select(F.col("s").alias("__b"), F.lit(True).alias("__kb")), "__b", "left")
    got = got.join(joined.select(F.col("src").alias("__a"), F.col("dst").alias("__b"), F.lit(True).alias("__path")), ["__a", "__b"], "left")
    return got.where("__ka is null or __kb is null or __path").select(*edges.columns)


def _matched(first_seen: DataFrame, events: DataFrame) -> list[str]:
    """Keys that an event and an anomaly must share, where both tables have them."""
    return [c for c in ("entity",) if c in events.columns and c in first_seen.columns]


def _bucket(t: Column, hours: float) -> Column:
    return F.floor(F.timestamp_diff("SECOND", F.lit("1970-01-01").cast("timestamp_ntz"), t) / (hours * 3600))


def _hours() -> Column:
    return F.timestamp_diff("MICROSECOND", F.col("event_time"), F.col("anomaly_time")) / 3.6e9


def _told() -> list[Column]:
    return [F.round("h", 3).alias("delta_hours"), F.round(1 / (1 + F.col("h")), 6).alias("correlation_score")]


def event_lists(first_seen: DataFrame, events: DataFrame, max_lag_hours: int = 24) -> DataFrame:
    """C12 without copies: the events in the ``max_lag_hours`` before each distinct time of a first anomaly, ``anomaly_time, event_description, event_time, event_type, delta_hours, correlation_score``.

    All metrics that were first seen at one time have the same events, so anomalies on a grid of times cost no more than its times. A range join on equal keys: a time stands in every
    part, a 24th of the lag wide, that it looks back on, an event in its own.
    """
    keys, width = _matched(first_seen, events), max_lag_hours / 24
    kind = F.coalesce("type", F.lit("unknown")) if "type" in events.columns else F.lit("unknown")
    right = events.select(*keys, F.col("description").alias("event_description"), F.col("ts").alias("event_time"), kind.alias("event_type")).withColumn("__b", _bucket(F.col("event_time"), width))
    b = _bucket(F.col("first_seen"), width)
    left = first_seen.where("first_seen is not null").select(*keys, F.col("first_seen").alias("anomaly_time"), b.alias("__b")).distinct()
    left = left.withColumn("__b", F.explode(F.sequence(F.col("__b") - 24, "__b")))
    got = left.join(right, [*keys, "__b"]).withColumn("h", _hours()).where((F.col("h") > 0) & (F.col("h") <= max_lag_hours))
    return got.select(*keys, "anomaly_time", "event_description", "event_time", "event_type", *_told())


def correlate_events(first_seen: DataFrame, events: DataFrame, max_lag_hours: int = 24, shares: int = 64) -> DataFrame:
    """Events in the ``max_lag_hours`` before a metric's first anomaly, closer ones scoring higher.

    All pairs, so rows grow with anomalies times events. The list of a time is dealt out in ``shares`` parts, each with the anomalies of that time, so that no task holds a whole time.
    ``closest_events``, ``leading_events`` and ``event_lists`` tell the best, the first few and all without a row for each pair.
    """
    keys = _matched(first_seen, events)
    parts = 4 * int(first_seen.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [*keys, "anomaly_time", "__s"]
    lists = event_lists(first_seen, events, max_lag_hours).withColumn("__s", F.pmod(F.xxhash64("event_description", "event_time"), F.lit(shares)).cast("int")).repartition(parts, *by)
    seen = first_seen.where("first_seen is not null").select("incident_id", *keys, "metric", F.col("first_seen").alias("anomaly_time"), F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("__s"))
    got = lists.join(seen.repartition(parts, *by).hint("shuffle_hash"), by)
    return got.select("incident_id", "metric", "event_description", "event_time", "event_type", "anomaly_time", "delta_hours", "correlation_score")


def closest_events(first_seen: DataFrame, events: DataFrame, max_lag_hours: int = 24) -> DataFrame:
    """``incident_id, metric, event_time, anomaly_time, delta_hours, correlation_score`` of the last event in the ``max_lag_hours`` before each first anomaly: C12's best score, linear in both tables.

    Distinct times of anomalies and events are sorted together in buckets as wide as the lag, an event in its own and the next one.
    """
    keys = _matched(first_seen, events)
    t = first_seen.where("first_seen is not null").select(*keys, F.col("first_seen").alias("t")).distinct()
    e = events.where("ts is not null").select(*keys, F.col("ts").alias("t")).distinct()
    b = _bucket(F.col("t"), max_lag_hours)
    marks = t.select(*keys, "t", b.alias("__b"), F.lit(0).alias("event")).unionByName(e.select(*keys, "t", F.explode(F.array(b, b + 1)).alias("__b"), F.lit(1).alias("event")))
    # at one time the anomaly comes first: an event must be earlier
    w = Window.partitionBy(*keys, "__b").orderBy("t", "event").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = marks.withColumn("event_time", F.last(F.when(F.col("event") == 1, F.col("t")), True).over(w)).where("event = 0").select(*keys, F.col("t").alias("anomaly_time"), "event_time")
    last = last.withColumn("h", _hours()).where(F.col("h") <= max_lag_hours)
    seen = first_seen.select("incident_id", *keys, "metric", F.col("first_seen").alias("anomaly_time"))
    return seen.join(last, [*keys, "anomaly_time"]).select("incident_id", "metric", "event_time", "anomaly_time", *_told())


def leading_events(first_seen: DataFrame, events: DataFrame, k: int = 5, max_lag_hours: int = 24) -> DataFrame:
    """Those of ``correlate_events`` that can be among the ``k`` of a metric or an incident with the best score, then first by description: the ``k`` of each time."""
    keys = _matched(first_seen, events)
    w = Window.partitionBy(*keys, "anomaly_time").orderBy(F.desc("correlation_score"), "event_description")
    best = event_lists(first_seen, events, max_lag_hours).withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= k)
    got = first_seen.select("incident_id", *keys, "metric", F.col("first_seen").alias("anomaly_time")).join(best, [*keys, "anomaly_time"])
    return got.select("incident_id", "metric", "event_description", "event_time", "event_type", "anomaly_time", "delta_hours", "correlation_score")
