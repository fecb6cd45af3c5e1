"""Prefix trie of conversations: padded turn-id matrices of range shards, whose boundary nodes recombine."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from causetrace.llm.common import stage, unstage

#: Bytes of a turn id: 12 of a digest of role and text, 4 of the text's length in bytes.
TURN = 16
#: Distinct sequences of a shard, and depths that one padded matrix spans.
SHARD_ROWS, WIDTH = 1 << 15, 64


def _turn_id(role: Column, text: Column) -> Column:
    """32 hex digits; the length of the role keeps role and text apart."""
    digest = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))
    return F.concat(F.substring(digest, 1, 24), F.lpad(F.hex(F.octet_length(text)), 8, "0"))


def sequences(conversations: DataFrame) -> DataFrame:
    """``conv_id, key``: the turn ids of every conversation in order of ``turn`` (null first, equal turns by their ids), 16 bytes each.

    Null roles and texts are empty; rows without a ``conv_id`` belong to no conversation. Texts are hashed where they are read, so a turn is shuffled as 16 bytes; those of one conversation form one row.
    """
    rows = conversations.where("conv_id is not null")
    token = _turn_id(F.coalesce("role", F.lit("")), F.coalesce("text", F.lit("")))
    turns = rows.select("conv_id", F.struct("turn", F.unhex(token).alias("t")).alias("x"))
    got = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("x")).alias("xs"))
    return got.select("conv_id", F.unhex(F.array_join(F.transform("xs", lambda x: F.hex(x["t"])), "")).alias("key"))


def rebuilt(seqs: DataFrame, family: int = 5, most: int = 8) -> DataFrame:
    """``conv_id, key`` of conversation c: the first h turns of conversation c - c % family, then its own turns after the first h; h = crc32(c) % (most + 1).

    ``seqs`` is read twice. A conversation's head meets at most ``family`` others in the join.
    """
    c = F.col("conv_id")
    own = seqs.select("conv_id", "key", (c - c % family).alias("base"), (F.crc32(c.cast("string")) % (most + 1)).cast("int").alias("h"))
    heads = seqs.where(c % family == 0).select(c.alias("base"), F.substring("key", 1, TURN * most).alias("head"))
    both = own.where(c % family != 0).join(heads, "base", "left")
    head = F.coalesce(F.substring("head", F.lit(1), F.col("h") * TURN), F.lit(b""))
    return both.select("conv_id", F.concat(head, F.substring("key", F.col("h") * TURN + 1, F.octet_length("key"))).alias("key")).unionByName(own.where(c % family == 0).select("conv_id", "key"))


def _shards(rows: DataFrame, shard_rows: int) -> DataFrame:
    """``shard, key, lo, n, ends``, staged: each distinct sequence once, with its smallest member, how many it has and the digest of their ids.

    Members of a sequence first become strings of the ids of one range of 65,536 ids, by partial aggregates; then a task streams the strings of its
    sequences, in order, through one hasher each. So the members of a sequence are never held at once, however many there are.
    """
    listed = rows.groupBy("key", F.shiftright(F.col("conv_id").cast("long"), 16).alias("chunk")).agg(F.sort_array(F.collect_list("conv_id")).alias("ids"))
    listed = stage(listed.select("key", "chunk", F.array_join("ids", ",").alias("ids"), F.array_min("ids").cast("long").alias("lo"), F.size("ids").cast("long").alias("n")), "members")
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-listed.count() // shard_rows))
    placed = listed.repartitionByRange(parts, "key").sortWithinPartitions("key", "chunk")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, lo, n, h = None, 0, 0, None
        for batch in batches:
            done = []
            for k, ids, low, count in zip(*(batch.column(c).to_pylist() for c in ("key", "ids", "lo", "n")), strict=True):
                if k == key:
                    h.update(b",")
                    lo, n = min(lo, low), n + count
                else:
                    if h is not None:
                        done.append((key, lo, n, h.hexdigest()))
                    key, lo, n, h = k, low, count, hashlib.sha256()
                h.update(ids.encode())
            yield _batch(done)
        if h is not None:
            yield _batch([(key, lo, n, h.hexdigest())])

    def _batch(done: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*done, strict=True)) or [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(cols, (pa.binary(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["key", "lo", "n", "ends"])

    got = placed.mapInArrow(run, "key binary, lo bigint, n bigint, ends string").withColumn("shard", F.spark_partition_id())
    got = stage(got, "shards")
    unstage(listed)
    return got


def _with_neighbours(rows: DataFrame) -> DataFrame:
    """``rows`` and, in each shard, the last sequence of the one before (``side`` -1) and the first of the next (1)."""
    spans = rows.groupBy("shard").agg(F.min("key").alias("first"), F.max("key").alias("last"))
    order = Window.orderBy("shard")  # one row a shard, of some 30,000 sequences each
    spans = spans.select("shard", F.lag("last").over(order).alias("before"), F.lead("first").over(order).alias("after"))
    near = spans.select("shard", F.explode(F.array(F.struct(F.col("before").alias("key"), F.lit(-1).alias("side")), F.struct(F.col("after").alias("key"), F.lit(1).alias("side")))).alias("x"))
    near = near.where("x.key is not null").select("shard", "x.key", F.lit(0).cast("long").alias("lo"), F.lit(0).cast("long").alias("n"), F.lit(None).cast("string").alias("ends"), "x.side")
    return rows.withColumn("side", F.lit(0)).unionByName(near)


def _dense(hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
    """Ranks, from 0 and without gaps, of pairs of unsigned words."""
    order = np.lexsort((lo, hi))
    step = np.zeros(len(order), dtype=np.int64)
    step[1:] = (hi[order][1:] != hi[order][:-1]) | (lo[order][1:] != lo[order][:-1])
    out = np.empty(len(order), dtype=np.int64)
    out[order] = np.cumsum(step)
    return out


class _Block:
    """The turns of depths ``base + 1`` to ``base + width`` of the rows that reach them, as a padded matrix in trie order."""

    def __init__(self, rows: np.ndarray, group: np.ndarray, words: list[np.ndarray], counts: np.ndarray, base: int, width: int):
        """``words[r]``: the turn ids of row ``rows[r]`` as (high, low) words; ``group`` tells apart rows that already differ before ``base``."""
        take = np.minimum(counts[rows] - base, width)
        flat = np.concatenate([words[r][base : base + t] for r, t in zip(rows, take, strict=True)])
        inside = np.arange(int(take.max())) < take[:, None]
        ids = np.full(inside.shape, -1, dtype=np.int64)
        ids[inside] = _dense(flat[:, 0], flat[:, 1])
        size = np.zeros(inside.shape, dtype=np.int64)
        size[inside] = flat[:, 1] & 0xFFFFFFFF
        # of rows that agree in all these turns the one that ends here is first; the next block sorts the others
        order = np.lexsort((take + base < counts[rows], *ids.T[::-1], group))
        self.rows, self.group, self.size, inside, ids = rows[order], group[order], size[order], inside[order], ids[order]
        change = np.ones(ids.shape, dtype=bool)
        change[1:] = ids[1:] != ids[:-1]
        change[1:, 0] |= self.group[1:] != self.group[:-1]
        self.change = np.logical_or.accumulate(change, axis=1)
        self.start, self.base = self.change & inside, base
        # a row is a leaf unless the next one goes on from its last turn
        self.on = np.flatnonzero(counts[self.rows] > base + width)
        last = self.change[1:][np.arange(len(ids) - 1), take[order][:-1] - 1]
        self.leaf = (take[order] + base == counts[self.rows]) & np.concatenate([last, [True]])


def shard_nodes(keys: list[bytes], lo: np.ndarray, n: np.ndarray, ends: list, side: np.ndarray, width: int = WIDTH) -> dict[str, list]:
    """Nodes of one shard's distinct sequences. Rows of ``side`` -1 and 1 are neighbours: they tell what starts and ends here, and count nowhere.

    A node that a neighbour shares is partial: it has its path's digest as ``node``, sums that add up with those of the other shards, and no ``parent_lo``; a child of one has
    ``parent``, that digest. All sums are over rows: members are weights, children are starts one deeper, leaves are rows that the next doesn't go on from, and
    ``saved`` is what members' turns take less what the distinct ones take.
    """
    counts = np.array([len(k) // TURN for k in keys])
    words = [np.frombuffer(k, dtype=">u8").reshape(-1, 2).astype(np.uint64) for k in keys]
    real = side == 0
    blocks, rows, group = [], np.flatnonzero(counts > 0), np.zeros(int((counts > 0).sum()), dtype=np.int64)
    while len(rows):
        b = _Block(rows, group, words, counts, width * len(blocks), width)
        blocks.append(b)
        group, rows = np.cumsum(b.change[:, -1])[b.on], b.rows[b.on]
    for b, deeper in zip(blocks[-2::-1], blocks[:0:-1], strict=True):
        b.rows[b.on] = deeper.rows  # groups keep their places, so all blocks are in trie order now
    leaf = (counts == 0) & (len(keys) == 1)  # the empty sequence comes first of all
    tail, below = np.zeros(len(keys), dtype=np.int64), np.zeros(len(keys), dtype=np.int64)
    for b in reversed(blocks):
        b.below = below[b.rows]
        b.sums = np.cumsum((b.size * n[b.rows][:, None] - np.where(b.start & real[b.rows][:, None], b.size, 0))[:, ::-1], axis=1)[:, ::-1] + tail[b.rows][:, None]
        tail[b.rows] = b.sums[:, 0]
        below[:] = 0
        below[b.rows] = b.start[:, 0] & real[b.rows]
        leaf[b.rows] |= b.leaf
    leaf &= real

    out: dict[str, list] = {c: [] for c in ("depth", "lo", "n", "children", "leaves", "saved", "ends", "node", "parent_lo", "parent")}
    paths: dict[int, list[bytes]] = {}

    def path(row: int, depth: int) -> bytes:
        """Digest of the first ``depth`` turns of a neighbour, which all partial nodes lie on."""
        if row not in paths:
            h, told = hashlib.blake2b(digest_size=16), []
            for at in range(0, len(keys[row]) + 1, TURN):
                told.append(h.copy().digest())
                h.update(keys[row][at : at + TURN])
            paths[row] = told
        return paths[row][depth]

    above_lo, above_node = np.zeros(len(keys), dtype=np.int64), np.full(len(keys), None, dtype=object)

    def level(depth: int, rows: np.ndarray, first: np.ndarray, keep: np.ndarray, starts_below: np.ndarray, sums: np.ndarray) -> None:
        """One depth: segments of ``rows`` begin at ``first``, those of ``keep`` are nodes."""
        total = np.add.reduceat(n[rows], first)
        keep = keep & (total > 0)
        others = np.add.reduceat((~real[rows]).astype(np.int64), first)
        low = np.minimum.reduceat(np.where(real[rows], lo[rows], np.iinfo(np.int64).max), first)
        folds = [np.add.reduceat(x, first) for x in (starts_below, leaf[rows].astype(np.int64), sums)]
        node, segment = np.full(len(first), None, dtype=object), np.zeros(len(rows), dtype=np.int64)
        segment[first[1:]] = 1
        segment = np.cumsum(segment)
        for s in np.flatnonzero(keep & (others > 0)):
            inside = rows[first[s] : first[s + 1] if s + 1 < len(first) else len(rows)]
            node[s] = path(int(inside[~real[inside]][0]), depth)
        lead = rows[first]
        lead = np.where(real[lead] | (first + 1 >= len(rows)), lead, rows[np.minimum(first + 1, len(rows) - 1)])
        out["depth"].append(np.full(int(keep.sum()), depth))
        for c, x in zip(("lo", "n", "children", "leaves", "saved"), (low, total, *folds), strict=True):
            out[c].append(x[keep])
        out["ends"].append(np.array([ends[r] if counts[r] == depth else None for r in lead[keep]], dtype=object))
        out["node"].append(node[keep])
        out["parent_lo"].append(above_lo[lead[keep]])
        out["parent"].append(above_node[lead[keep]])
        above_lo[rows], above_node[rows] = low[segment], node[segment]

    every = np.concatenate([np.flatnonzero(counts == 0), *[b.rows for b in blocks[:1]]])
    level(0, every, np.zeros(1, dtype=np.int64), np.ones(1, dtype=bool), below[every], tail[every])
    for b in blocks:
        for j in range(b.start.shape[1]):
            first = np.flatnonzero(b.change[:, j])
            after = (b.start[:, j + 1] & real[b.rows]).astype(np.int64) if j + 1 < b.start.shape[1] else b.below if j + 1 == width else np.zeros(len(b.rows), dtype=np.int64)
            level(b.base + j + 1, b.rows, first, b.start[first, j], after, b.sums[:, j])
    told = {c: np.concatenate(x).tolist() for c, x in out.items()}
    told["parent_lo"] = [None if d == 0 or p is not None else x for d, p, x in zip(told["depth"], told["parent"], told["parent_lo"], strict=True)]
    return told


_NODES = "depth bigint, lo bigint, n bigint, children bigint, leaves bigint, saved bigint, ends string, node binary, parent_lo bigint, parent binary"


def trie(rows: DataFrame, shard_rows: int = SHARD_ROWS, width: int = WIDTH) -> DataFrame:
    """Nodes of the trie of ``rows(conv_id, key)``: ``conv_id`` (smallest member), ``depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``.

    Equal sequences collapse before they are dealt out, by range, into shards of about ``shard_rows`` distinct ones; a first turn that many share only makes
    nodes that several shards have in part. Those (at most two paths a shard) are added up; all others are whole as their shard made them. Inside a shard at most ``width`` depths of the rows that are
    that long are one padded matrix, so one long conversation doesn't widen the others. An empty table has no nodes.
    """
    placed = _shards(rows, shard_rows)

    def one(table: pa.Table) -> pa.Table:
        keys = table.column("key").to_pylist()
        lo, n, side = (table.column(c).to_numpy() for c in ("lo", "n", "side"))
        got = shard_nodes(keys, lo, n, table.column("ends").to_pylist(), side, width)
        kinds = [pa.int64()] * 6 + [pa.string(), pa.binary(), pa.int64(), pa.binary()]
        return pa.table([pa.array(x, type=t) for x, t in zip(got.values(), kinds, strict=True)], names=list(got))

    nodes = stage(_with_neighbours(placed).groupBy("shard").applyInArrow(one, _NODES), "nodes")
    unstage(placed)
    sums = [F.sum(c).alias(c) for c in ("n", "children", "leaves", "saved")]
    shared = nodes.where("node is not null").groupBy("node", "depth").agg(F.min("lo").alias("lo"), *sums, F.max("ends").alias("ends"), F.first("parent").alias("parent"), F.lit(None).cast("long").alias("parent_lo"))
    shared = stage(shared, "shared-nodes")
    names = shared.select(F.col("node").alias("parent"), F.col("lo").alias("named"))
    columns = ["depth", "lo", "n", "children", "leaves", "saved", "ends", "parent_lo", "parent"]
    whole = nodes.where("node is null").select(*columns)
    hung = whole.where("parent is null").withColumn("named", F.lit(None).cast("long")).unionByName(whole.where("parent is not null").join(names, "parent").select(*columns, "named"))
    # a partial node's parent is partial, or there is none
    hung = hung.unionByName(shared.select(*columns).join(names, "parent", "left").select(*columns, "named"))
    return hung.select(
        F.col("lo").alias("conv_id"), "depth", F.coalesce("named", "parent_lo").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("children").alias("n_children"),
        F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )


def report(conversations: DataFrame) -> DataFrame:
    """The trie of the rebuilt conversations, a row a node. Nulls, equal turns and repeated rows as in ``sequences``: a repeated row is a turn of its own; extra columns are ignored."""
    seqs = stage(sequences(conversations), "sequences")
    return trie(rebuilt(seqs))
