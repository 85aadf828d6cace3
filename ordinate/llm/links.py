"""Links within candidate groups: stars, verified, then what is left in blocks.

members(key, node, ...) says which nodes meet under a key. Not all pairs of a key are tested: first, every node is tested
against one node of its key. What is alike forms components, and a key whose nodes are all of one component needs no further
test; so a group of near copies costs a test a node. Another round of stars follows for the other keys. The nodes of each of these (or of those that
such keys connect) that are then still apart are dealt in blocks, each pair of blocks to a task, which tests the pairs of nodes of different components within it. So no
pair with a key in common that could join two components stays untested, no pairs are written out, and no task holds more than two blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import dropped, released, written
from .graph import components

#: Rounds of stars; nodes of a block, and bytes of their data.
STARS, SIDE, SIDE_BYTES = 2, 4000, 8 << 20


def verified(pairs: DataFrame, items: DataFrame, check: Callable, block: int) -> DataFrame:
    """The pairs(u, v) that check finds alike, as (u, v): a written table.

    items(node, data). A task gets u and block of its partners at most: rows (u, slice, node, data), those of one (u, slice)
    together, u's own row first. Both sides of the joins are tables, so that Spark splits a hot u or v.
    """
    pairs = written(pairs.distinct(), "pairs")
    cut = pairs.groupBy("u").agg(F.ceil(F.count("*") / block).alias("slices"))
    dealt = pairs.join(cut, "u").select("u", F.pmod(F.xxhash64("v"), F.col("slices")).alias("slice"), F.col("v").alias("node"))
    leads = cut.select("u", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("slices") - 1)).alias("slice"), F.col("u").alias("node"))
    rows = dealt.union(leads).join(items.select("node", "data"), "node").select("u", "slice", "node", "data")
    rows = rows.repartition("u", "slice").sortWithinPartitions("u", "slice", F.col("node") != F.col("u"), "node")
    found = written(rows.mapInArrow(released(check), "u bigint, v bigint"), "verified")
    dropped(pairs)
    return found


def _labelled(members: DataFrame, labels: DataFrame) -> DataFrame:
    own = labels.select(F.col("node").alias("_node"), "component")
    joined = members.join(own, F.col("node") == F.col("_node"), "left").drop("_node")
    return joined.withColumn("label", F.coalesce("component", "node")).drop("component")


def _blocks(members: DataFrame, keys: DataFrame, items: DataFrame, check_all: Callable, by_key: bool, percent: int) -> DataFrame:
    """The links between nodes of an open key with different labels; a written table.

    Each key is searched by itself, or, where nodes have many keys in common, each group of nodes that open keys connect. Of keys with the same
    nodes one is searched. A group's nodes are cut in the order of their sizes to blocks of SIDE nodes and SIDE_BYTES of data, about; a node is sent
    to the pairs of its block with those whose sizes can be alike, so that it is copied as often as sizes near its own fill blocks.
    If each key is searched by itself, rows also say in which groups the node is (groups) and whether it led the stars there (led).
    """
    data = items.select(F.col("node").alias("of"), F.octet_length("data").alias("bytes"))
    if by_key:
        own = members.join(keys.select("key"), "key").select(F.col("key").alias("group"), "node", "size", "label").distinct()
    else:
        groups = components(members.join(keys.select("key", "lead"), "key").select(F.col("lead.node").alias("u"), F.col("node").alias("v")), "open")
        own = members.select("node", "size", "label").distinct().join(groups.select(F.col("node").alias("in"), F.col("component").alias("group")), F.col("node") == F.col("in"))
    own = written(own.join(data, F.col("node") == F.col("of")).select("group", "node", "size", "label", "bytes"), "own")
    both = [F.sum(F.xxhash64("node", F.lit(k)).cast("decimal(20,0)")).cast("string").alias(f"nodes{k}") for k in (0, 1)]
    load = lambda: F.greatest(F.count("*") / SIDE, F.sum("bytes") / SIDE_BYTES)
    leads = F.array(*(F.min(F.struct(F.xxhash64("node", F.lit(k)), "node")).getField("node") for k in range(STARS))).alias("leads")
    cut = own.groupBy("group").agg(F.min("label").alias("least"), F.max("label").alias("most"), F.ceil(load()).alias("blocks"), leads, *both).where("least != most")
    cut = written(cut.groupBy("nodes0", "nodes1").agg(F.min(F.struct("group", "blocks", "leads")).alias("one")).select("one.group", "one.blocks", "one.leads"), "cut")
    large = cut.where("blocks > 1").select("group")
    # Where the nodes of a size begin among those of a large group: a row for each size that it has.
    sized = own.join(large, "group").groupBy("group", "size").agg(load().alias("load"))
    upto = F.sum("load").over(Window.partitionBy("group").orderBy("size"))
    begins = sized.select(F.col("group").alias("g"), F.col("size").alias("s"), "load", (upto - F.col("load")).alias("begin"))
    place = F.floor(F.col("begin") + F.pmod(F.xxhash64("node"), F.lit(1 << 20)) / float(1 << 20) * F.col("load")).cast("bigint")
    placed = own.join(cut.select("group", "leads"), "group").join(begins, (F.col("group") == F.col("g")) & (F.col("size") == F.col("s")), "left")
    led = F.array_contains("leads", F.col("node")).alias("led")
    placed = written(placed.select("group", "node", "size", "label", F.coalesce(place, F.lit(0).cast("bigint")).alias("side"), led), "placed")
    ranges = placed.groupBy("group", "side").agg(F.min("size").alias("least"), F.max("size").alias("most"))
    partner = ranges.select(F.col("group").alias("g"), F.col("side").alias("j"), F.col("least").alias("low"), F.col("most").alias("high"))
    met = (F.col("group") == F.col("g")) & (F.col("side") <= F.col("j")) & (F.least("most", "high") * 100 >= F.greatest("least", "low") * percent)
    pairs = written(ranges.join(partner, met).select("group", F.col("side").alias("i"), "j"), "pairs")
    sent = pairs.select("group", F.col("i").alias("side"), "i", "j").union(pairs.where("i != j").select("group", F.col("j").alias("side"), "i", "j"))
    dealt = placed.join(sent, ["group", "side"]).select("group", "i", "j", "side", F.col("node").alias("of"), "label")
    if by_key:  # the groups of each node, by which a pair is tested in the first one that both are in
        searched = placed.groupBy("node").agg(F.sort_array(F.collect_set(F.struct("group", "led"))).alias("in"))
        searched = searched.select("node", F.col("in.group").alias("groups"), F.col("in.led").alias("led"))
        items = items.join(searched, "node")
    rows = dealt.join(items, F.col("of") == F.col("node")).drop("of").repartition("group", "i", "j").sortWithinPartitions("group", "i", "j", "node")
    found = written(rows.mapInArrow(released(_each_task(check_all, SIDE if by_key else 1)), "u bigint, v bigint"), "verified")
    dropped(own, cut, placed, pairs, *([] if by_key else [groups]))
    return found


class Task:
    """The rows of pairs of blocks, and which of them are connected so far. pieces: where the rows of each pair begin and end, and whether it has two blocks."""

    def __init__(self, rows: pa.Table, pieces: list[tuple[int, int, bool]]) -> None:
        self.pieces = pieces
        self.node, self.side = rows.column("node").to_numpy(), rows.column("side").to_numpy()
        self.data = rows.column("data").to_pylist()
        self.rows = rows
        self.root = np.unique(rows.column("label").to_numpy(), return_inverse=True)[1]
        self.links: list[tuple[int, int]] = []
        self.groups: np.ndarray | None = None
        self.led: np.ndarray | None = None

    def column(self, name: str) -> np.ndarray:
        return self.rows.column(name).to_numpy()

    def asked(self, piece: int = 0) -> np.ndarray:
        """The rows of a piece whose partners are searched: all but those of its most frequent label."""
        a, b, _ = self.pieces[piece]
        root = self.root[a:b]
        return a + np.flatnonzero(root != np.bincount(root).argmax())

    def open(self, row: int, piece: int = 0) -> np.ndarray:
        """Which rows row is to be tested against, of a task of one piece: of another component, of another block if there are two."""
        mask = self.root != self.root[row]
        return mask & (self.side != self.side[row]) if self.pieces[piece][2] else mask

    def first(self, i: np.ndarray, j: np.ndarray, starred: np.ndarray) -> np.ndarray:
        """Which of the pairs of rows of a group are in no earlier group together and, of those that stars take (starred), in none that one of them led."""
        if self.groups is None:
            groups, led = (self.rows.column(c).combine_chunks() for c in ("groups", "led"))
            n = groups.value_lengths().to_numpy()
            self.groups, self.led = np.full((len(n), n.max()), -1, np.int64), np.zeros((len(n), n.max()), bool)
            at = np.repeat(np.arange(len(n)), n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            self.groups[at], self.led[at] = groups.flatten().to_numpy(), led.flatten().to_numpy(zero_copy_only=False)
        out, group = np.zeros(len(i), bool), self.column("group")
        step = max(1, (1 << 22) // self.groups.shape[1] ** 2)
        for k in range(0, len(i), step):
            a, b = i[k : k + step], j[k : k + step]
            own = self.groups[a]
            both = (own[:, :, None] == self.groups[b][:, None, :]) & (own != -1)[:, :, None]
            done = (both & (self.led[a][:, :, None] | self.led[b][:, None, :])).any((1, 2)) & starred[k : k + step]
            out[k : k + step] = ~done & (own[np.arange(len(a)), both.any(2).argmax(1)] == group[a])
        return out

    def link(self, a: int, b: int) -> None:
        if self.root[a] != self.root[b]:
            self.links.append((int(self.node[a]), int(self.node[b])))
            self.root[self.root == self.root[a]] = self.root[b]


def _each_task(check_all: Callable[[Task], None], most: int):
    """Pieces follow one another; those that have most rows together, or one, are a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, pieces, n = None, [], [], 0

        def ended() -> Iterator[pa.RecordBatch]:
            if pieces:
                task = Task(pa.Table.from_batches(held), [(a, b, across) for a, b, across in pieces])
                check_all(task)
                u, v = zip(*task.links) if task.links else ((), ())
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

        for batch in batches:
            names = np.stack([batch.column(c).to_numpy() for c in ("group", "i", "j")])
            cuts = [0, *(np.flatnonzero((names[:, 1:] != names[:, :-1]).any(0)) + 1).tolist(), batch.num_rows] if batch.num_rows else [0]
            for a, b in zip(cuts, cuts[1:]):
                own = tuple(names[:, a].tolist())
                if own == key:
                    pieces[-1] = (pieces[-1][0], n + b - a, pieces[-1][2])
                else:
                    if n >= most:
                        yield from ended()
                        held, pieces, n = [], [], 0
                    key = own
                    pieces.append((n, n + b - a, own[1] != own[2]))
                held.append(batch.slice(a, b - a))
                n += b - a
        yield from ended()

    return run


def linked(members: DataFrame, items: DataFrame, check: Callable, check_all: Callable[[Task], None], may: Callable[[Callable, Callable], Column], block: int, by_key: bool, percent: int) -> DataFrame:
    """(node, component) of all nodes with a link; a written table.

    members is a written table of (key, node, size, ...), items one of (node, data, ...). may(a, b) says of two members, whose columns a(name)
    and b(name) give, whether they can be alike. check() tests stars, check_all() a Task. by_key: whether open keys are searched each by itself.
    percent: of the size of the larger of two nodes that are alike, the smaller one has so much at least.
    """
    rest = [c for c in members.columns if c not in ("key", "node")]
    now, edges, labels = members, [], None
    for k in range(STARS + 1):
        lead = F.struct(F.xxhash64("node", F.lit(k)).alias("order"), "node", *rest, *(["label"] if k else []))
        apart = F.min("label") != F.max("label") if k else F.lit(True)
        keys = now.groupBy("key").agg(F.min(lead).alias("lead"), F.count("*").alias("n"), apart.alias("apart")).where("n > 1 AND apart")
        keys = written(keys, "keys")
        if keys.isEmpty():
            dropped(keys)
            break
        if k == STARS:
            edges.append(_blocks(now.join(keys.select("key"), "key", "left_semi"), keys, items, check_all, by_key, percent))
        else:
            differs = F.col("node") != F.col("lead.node")
            differs = differs & (F.col("label") != F.col("lead.label")) if k else differs
            pairs = now.join(keys.select("key", "lead"), "key").where(differs & may(F.col, lambda c: F.col(f"lead.{c}")))
            edges.append(verified(pairs.select(F.col("lead.node").alias("u"), F.col("node").alias("v")), items, check, block))
        every = edges[0]
        for e in edges[1:]:
            every = every.union(e)
        if labels is not None:
            dropped(labels)
        labels = components(every, "linked")
        if k == STARS:
            dropped(keys, now)
            break
        last = now.join(keys.where("n > 2").select("key"), "key", "left_semi").drop("label")  # the one pair of a key of two is tested
        following = written(_labelled(last, labels), "members")
        dropped(keys, *([now] if k else []))
        now = following
    if labels is None:
        labels = components(members.select(F.col("node").alias("u"), F.col("node").alias("v")).limit(0), "linked")
    dropped(*edges)
    return labels
