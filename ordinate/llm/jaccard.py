"""N-gram Jaccard join: pairs of documents whose sets of word shingles overlap enough, as components.

A T-occurrence search in two steps. Each document has its set of shingles as sorted hashes; equal sets are one node.

1. Shingles are dealt by hash and counted, and each block of documents learns which of its shingles others have too, and how
   often. Ordered by rarity, a set of n has a partner only if one of its n - T + 1 rarest shingles (T: the least
   overlap that any partner needs) is shared: these are the short lists of the search, its keys; the T - 1 longest lists are left
   aside. Of two sets with a key in common, the sizes and the places of the key in both say whether they can overlap enough.
2. Candidates are searched star by star (links.py): a task has a query set and some of its candidates. There, DivideSkip: of the
   candidates' inverted lists, the short ones are merged by a heap, and what occurs there often enough is looked up in the
   longest ones by binary search. What reaches the overlap is a link. Sets that stars leave apart are searched in blocks.

No candidate groups are formed before pairs are verified: chains of documents that share rare shingles cost a search a document. Exact for
any data, except that shingles are told apart by 48 bits (while they are counted by 38 or more, which can only add candidates) and whole sets by 128.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, flagged, fresh, prepare, released, released_table, slices, texts, written
from .links import Task, linked

WORDS = 5
#: Links need 100 * intersection >= PERCENT * union.
PERCENT = 75
#: Shingles that one task of step 1 counts, about; sets that one task of step 2 searches, and bytes of them that it holds, about.
COUNTED, BLOCK, HELD = 1 << 19, 500, 32 << 20
#: Occurrences in a block up to which a shingle is dealt with its rows; of others only their number is dealt, and their rows stay with the block.
FREQUENT = 4
_STAY = 0xFFFF
_P = np.uint64(0x9E3779B97F4A7C15)
_LOCAL = 1 << 12  # rows of a block fit into it
#: Text of a block, about.
STEP_BYTES = 8 << 20


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_sets(values: list[bytes | None], size: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(row, 48-bit hash), sorted by row, without repeats: the shingles of each text.

    Words are split at ASCII white space and lower-cased (A-Z). Fewer words than size, but not none, are one shingle.
    """
    tokens = [v.lower().split() if v else [] for v in values]
    n = np.array([len(t) for t in tokens], np.int64)
    ids: dict[bytes, int] = {}
    code = np.fromiter((ids.setdefault(w, len(ids)) for t in tokens for w in t), np.int64, int(n.sum()))
    word = np.array([xxhash.xxh3_64_intdigest(w) for w in ids] or [0], np.uint64)[code]
    row = np.repeat(np.arange(len(values)), n)
    if len(word) >= size:
        h = word[: len(word) - size + 1].copy()
        for k in range(1, size):
            h = h * _P + word[k : len(word) - size + 1 + k]
        whole = row[: len(h)] == row[size - 1 :]
        row_of, h = row[: len(h)][whole], h[whole]
    else:
        row_of, h = row[:0], word[:0]
    short = np.flatnonzero((n > 0) & (n < size))
    if len(short):
        starts = np.cumsum(n) - n
        ends = []
        for i in short:
            x = np.uint64(n[i])
            for w in word[starts[i] : starts[i] + n[i]]:
                x = np.uint64((int(x) * int(_P) + int(w)) & (2**64 - 1))
            ends.append(x)
        row_of, h = np.concatenate([row_of, short]), np.concatenate([h, np.array(ends, np.uint64)])
    h = _mixed(h) >> np.uint64(16)
    order = np.lexsort((h, row_of))
    row_of, h = row_of[order], h[order]
    first = np.ones(len(h), bool)
    first[1:] = (row_of[1:] != row_of[:-1]) | (h[1:] != h[:-1])
    return row_of[first], h[first]


def signatures(row: np.ndarray, h: np.ndarray, rows: int) -> np.ndarray:
    """128 bits of hash of each row's set, as two columns."""
    n = np.bincount(row, minlength=rows).astype(np.uint64)
    out = np.zeros((rows, 2), np.int64)
    for k, seed in enumerate((_P, np.uint64(0x2545F4914F6CDD1D))):
        total = np.zeros(rows, np.uint64)
        if len(h):
            starts = np.flatnonzero(np.diff(row, prepend=-1))
            total[row[starts]] = np.add.reduceat(_mixed(h + seed), starts)
        out[:, k] = _mixed(total + n * _P).view(np.int64)
    return out


def _packed(h: np.ndarray) -> bytes:
    return np.ascontiguousarray(h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    raw = np.zeros((len(data) // 6, 8), np.uint8)
    raw[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return raw.reshape(-1).view("<u8")


_SETS = "node bigint, doc_id bigint, n bigint, signature bigint, second bigint, shingles binary"


def _sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part = TaskContext.get().partitionId()
    k = 0
    for batch in slices(batches, "text", STEP_BYTES):
        values = [x.to_pybytes() if (x := v.as_buffer()) is not None else None for v in batch.column("text")]
        row, h = shingle_sets(values)
        sig = signatures(row, h, len(values))
        n = np.bincount(row, minlength=len(values))
        at, data = (6 * (np.cumsum(n) - n)).tolist(), _packed(h)
        columns = {
            "node": (part << 24 | k) * _LOCAL + np.arange(len(values)), "doc_id": batch.column("doc_id"), "n": n, "signature": sig[:, 0], "second": sig[:, 1],
            "shingles": pa.array([data[a : a + 6 * m] for a, m in zip(at, n.tolist())], pa.binary()),
        }
        yield pa.RecordBatch.from_pydict(columns)
        k += 1


def _parts_of(bits: int):
    """Cuts each block's list into 2**bits parts by the leading bits of the hashes; no part splits a shingle.

    A part's row: low, the shingles; rows, the block's rows that have them. more: how many rows a shingle has, of those (marked _STAY)
    that have too many to be dealt. Their rows go to a part of the block's own, where more is the part that the shingle is of.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes = batch.column("node").to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(nodes // _LOCAL)) + 1).tolist(), len(nodes)]
            for a, b in zip(edges, edges[1:]):
                out = {k: [] for k in ("part", "block", "low", "rows", "more")}
                block, local = int(nodes[a]) // _LOCAL, nodes[a:b] % _LOCAL
                _, first = np.unique(batch.column("signature").to_numpy()[a:b], return_index=True)  # equal sets of a block are listed once
                data = batch.column("shingles").slice(a, b - a).take(pa.array(np.sort(first))).to_pylist()
                local = local[np.sort(first)]
                h, row = _unpacked(b"".join(data)), np.repeat(local, [len(x) // 6 for x in data]).astype("<u2")
                order = np.argsort(h, kind="stable")
                h, row = h[order], row[order]
                starts = np.flatnonzero(np.diff(h, prepend=np.uint64(2**64 - 1)) != 0) if len(h) else np.zeros(0, np.int64)
                count = np.diff(np.append(starts, len(h)))
                many = np.repeat(count > FREQUENT, count)
                staying = many.copy()
                staying[starts] = False  # one entry of each stays with its number
                own, low, part = np.where(many, _STAY, row).astype("<u2")[~staying], h.astype("<u4")[~staying], (h >> np.uint64(48 - bits)).astype(np.int64)[~staying]
                number = np.repeat(count, count)[~staying].astype("<u2")
                at = np.searchsorted(part, np.arange((1 << bits) + 1)).tolist()
                for p in range(1 << bits):
                    i, j = at[p], at[p + 1]
                    if i < j:
                        for c, x in zip(out.values(), (p, block, low[i:j].tobytes(), own[i:j].tobytes(), number[i:j][own[i:j] == _STAY].tobytes())):
                            c.append(x)
                if many.any():
                    own_part = (1 << bits) + block % (1 << bits)
                    which = (h[many] >> np.uint64(48 - bits)).astype("<u4").tobytes()
                    for c, x in zip(out.values(), (own_part, block, h[many].astype("<u4").tobytes(), row[many].tobytes(), which)):
                        c.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out.values(), (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()))], names=list(out))

    return cut


_SHARED = ("block", "part", "low", "rows", "df", "more")


def _shared_of(bits: int):
    def shared(table: pa.Table) -> pa.Table:
        """Of one part, what occurs more than once: for each block its rows, with the shingle and its frequency."""
        blocks, lows, rows, more = (table.column(c).to_pylist() for c in ("block", "low", "rows", "more"))
        part = table.column("part")[0].as_py()
        if part >= 1 << bits:  # of blocks: it only passes through
            return pa.table([pa.array(c, t) for c, t in zip((blocks, [None] * len(blocks), lows, rows, [None] * len(blocks), more), _KINDS)], names=_SHARED)
        n = np.array([len(x) // 4 for x in lows], np.int64)
        low, row = np.frombuffer(b"".join(lows), "<u4"), np.frombuffer(b"".join(rows), "<u2")
        number = np.ones(len(low), np.int64)
        number[row == _STAY] = np.frombuffer(b"".join(more), "<u2")
        _, inverse = np.unique(low, return_inverse=True)
        df = np.bincount(inverse, weights=number).astype(np.int64)[inverse] if len(low) else number
        kept = df > 1
        of = np.repeat(np.arange(len(n)), n)[kept]
        low, row, df = low[kept], row[kept], np.minimum(df[kept], 2**32 - 1).astype("<u4")
        at = np.searchsorted(of, np.arange(len(n) + 1)).tolist()
        filled = [i for i in range(len(n)) if at[i] < at[i + 1]]
        columns = ([blocks[i] for i in filled], [part] * len(filled), *([x[at[i] : at[i + 1]].tobytes() for i in filled] for x in (low, row, df)), [None] * len(filled))
        return pa.table([pa.array(c, t) for c, t in zip(columns, _KINDS)], names=_SHARED)

    return shared


_KINDS = (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary())


def _sizes_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sizes of each block's sets, as a row like those of _shared_of, without part and df: rows and, as low, their sizes."""
    for batch in batches:
        nodes, n = batch.column("node").to_numpy(), batch.column("n").to_numpy().astype("<u4")
        edges = [0, *(np.flatnonzero(np.diff(nodes // _LOCAL)) + 1).tolist(), len(nodes)] if len(nodes) else [0]
        pieces = list(zip(edges, edges[1:]))
        none = [None] * len(pieces)
        columns = ([int(nodes[a]) // _LOCAL for a, _ in pieces], none, [n[a:b].tobytes() for a, b in pieces], [(nodes[a:b] % _LOCAL).astype("<u2").tobytes() for a, b in pieces], none, none)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _KINDS)], names=_SHARED)


def least_overlap(n: np.ndarray) -> np.ndarray:
    """The overlap that a set of n shingles needs with any partner, at least."""
    return -(-PERCENT * n // 100)


def _short_lists(table: pa.Table) -> pa.Table:
    """Of one block, the short lists that its sets are in, as (key, node, size, room); room: the set's shingles from the key on."""
    block = table.column("block")[0].as_py()
    parts, lows, rows, dfs, more = (table.column(c).to_pylist() for c in _SHARED[1:])
    joined = lambda c, kind, which: np.frombuffer(b"".join(c[i] for i in which), kind)
    sizes = [i for i, p in enumerate(parts) if p is None and more[i] is None]
    n = np.zeros(_LOCAL, np.int64)
    n[joined(rows, "<u2", sizes)] = joined(lows, "<u4", sizes)
    have, own = [i for i, p in enumerate(parts) if p is not None], [i for i, x in enumerate(more) if x is not None]
    key = np.repeat(np.array([parts[i] for i in have], np.int64), [len(lows[i]) // 4 for i in have]) << 32 | joined(lows, "<u4", have)
    row, df = joined(rows, "<u2", have), joined(dfs, "<u4", have)
    # Shingles of many rows: each has one entry with its frequency, and its rows are here.
    stay = row == _STAY
    all_keys, all_df = key[stay], df[stay]
    order = np.argsort(all_keys)
    all_keys, all_df = all_keys[order], all_df[order]
    held_key, held_row = joined(more, "<u4", own).astype(np.int64) << 32 | joined(lows, "<u4", own), joined(rows, "<u2", own)
    if len(held_key):
        at = np.minimum(np.searchsorted(all_keys, held_key), len(all_keys) - 1)
        key, row, df = np.concatenate([key[~stay], held_key]), np.concatenate([row[~stay], held_row]), np.concatenate([df[~stay], all_df[at]])
    row = row.astype(np.int64)
    order = np.lexsort((key, df, row))
    row, key = row[order], key[order]
    k = np.bincount(row, minlength=_LOCAL)
    rank = np.arange(len(row)) - (np.cumsum(k) - k)[row]
    place = (n - k)[row] + rank  # shingles that nobody else has come first
    kept = place < (n - least_overlap(n) + 1)[row]
    row, key, place = row[kept], key[kept], place[kept]
    return pa.table({"key": pa.array(key, pa.int64()), "node": pa.array(block * _LOCAL + row), "size": pa.array(n[row]), "room": pa.array(n[row] - place)})


def divide_skip(query: np.ndarray, sets: list[np.ndarray]) -> list[int]:
    """Which of the sets (sorted, not empty) overlap the query enough, by T-occurrence search.

    The inverted lists of the query's shingles are ordered by length. With T the overlap that the smallest set needs, the
    T - 1 longest lists are left aside and the others merged by a heap; the sets that occur there are looked up in the
    lists aside by binary search, until they have what they need or can't get it any more.
    """
    size = np.array([len(s) for s in sets], np.int64)
    need = -(-PERCENT * (len(query) + size) // (100 + PERCENT))
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
    at = np.minimum(np.searchsorted(query, flat), len(query) - 1)
    hit = query[at] == flat
    at, owner = at[hit], owner[hit]
    order = np.argsort(at, kind="stable")
    _, start = np.unique(at[order], return_index=True)
    lists = sorted(np.split(owner[order], start[1:]), key=len) if len(at) else []
    t = int(need.min())
    if len(lists) < t:
        return []
    short, long = lists[: len(lists) - t + 1], lists[len(lists) - t + 1 :]
    seen = Counter(heapq.merge(*(x.tolist() for x in short)))
    near = np.array(sorted(seen), np.int64)
    got, need = np.array([seen[x] for x in near.tolist()], np.int64), need[near]
    for k, postings in enumerate(long):
        p = np.minimum(np.searchsorted(postings, near), len(postings) - 1)
        got = got + (postings[p] == near)
        if k & 15 == 15:
            alive = got + (len(long) - 1 - k) >= need
            near, got, need = near[alive], got[alive], need[alive]
            if not len(near):
                break
    return near[got >= need].tolist()


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (u, slice, node, data) in order: the nodes whose sets overlap that of u enough, which comes first."""
    at, query, nodes, sets, held = None, None, [], [], 0

    def ended() -> Iterator[pa.RecordBatch]:
        if sets and (hit := divide_skip(query, sets)):
            yield pa.RecordBatch.from_arrays([pa.array([at] * len(hit), pa.int64()), pa.array([nodes[i] for i in hit], pa.int64())], names=["u", "v"])

    for batch in batches:
        for u, node, data in zip(batch.column("u").to_pylist(), batch.column("node").to_pylist(), batch.column("data")):
            if u == node or held > HELD:
                yield from ended()
                nodes, sets, held = [], [], 0
            if u == node:
                at, query = u, _unpacked(data.as_buffer())
            elif u == at:
                nodes.append(node)
                sets.append(_unpacked(data.as_buffer()))
                held += 8 * len(sets[-1])
    yield from ended()


def _search_all(task: Task) -> None:
    """The same search among the sets of a task, for those that are not of its most frequent component; long lists are merged by sorting."""
    sets = [_unpacked(x) for x in task.data]
    size = np.array([len(s) for s in sets], np.int64)
    universe, code = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), size)
    order = np.argsort(code, kind="stable")
    postings, start = owner[order], np.searchsorted(code[order], np.arange(len(universe) + 1))
    length, ends = np.diff(start), np.cumsum(size)
    for row in task.asked().tolist():
        may = task.open(row) & (100 * np.minimum(size, size[row]) >= PERCENT * np.maximum(size, size[row]))
        if not may.any():
            continue
        need = -(-PERCENT * (size[row] + size) // (100 + PERCENT))
        terms = code[ends[row] - size[row] : ends[row]]
        terms = terms[length[terms] > 1]
        t = int(need[may].min())
        if len(terms) < t:
            continue
        terms = terms[np.argsort(length[terms], kind="stable")]
        short, long = terms[: len(terms) - t + 1], terms[len(terms) - t + 1 :]
        near, got = np.unique(np.concatenate([postings[start[c] : start[c + 1]] for c in short]), return_counts=True)
        near, got = near[may[near]], got[may[near]]
        for k, c in enumerate(long):
            if k & 15 == 0:
                alive = got + (len(long) - k) >= need[near]
                near, got = near[alive], got[alive]
                if not len(near):
                    break
            held = postings[start[c] : start[c + 1]]
            p = np.minimum(np.searchsorted(held, near), len(held) - 1)
            got = got + (held[p] == near)
        for x in near[got >= need[near]].tolist():
            task.link(row, x)


def _may(a, b):
    """Whether two sets with a key in common can overlap enough, by their sizes and by the shingles that each has from the key on."""
    least, most, room = F.least(a("size"), b("size")), F.greatest(a("size"), b("size")), F.least(a("room"), b("room"))
    return (100 * least >= PERCENT * most) & ((100 + PERCENT) * room >= PERCENT * (least + most))


def cluster(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of docs(doc_id, text).

    component_id: the smallest doc_id reachable by links, the row's own included. A text that is null or without
    words has n_shingles 0 and its own doc_id. Rows with equal sets are linked, repeated rows so too. A null
    doc_id is never the smallest, unless all of its component are null. Texts of any length are taken whole. An empty table
    gives an empty table.
    """
    prepare(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), texts().alias("text"))
    sets = written(rows.mapInArrow(released(_sets_of), _SETS), "sets")
    bits = max(6, int(np.ceil(np.log2(max(1, (sets.agg(F.sum("n")).first()[0] or 0) / COUNTED)))))
    same = ["signature", "second", "n"]
    classes = sets.where("n > 0").groupBy(*same).agg(F.min("doc_id").alias("least"), F.min("node").alias("owner"), F.count("*").alias("copies"))
    classes = written(classes, "classes")

    parts = sets.where("n > 0").select("node", "signature", "shingles").mapInArrow(released(_parts_of(bits)), "part int, block bigint, low binary, rows binary, more binary")
    kind = "block bigint, part int, low binary, rows binary, df binary, more binary"
    shared = parts.groupBy("part").applyInArrow(released_table(_shared_of(bits)), kind)
    sizes = sets.where("n > 0").select("node", "n").mapInArrow(released(_sizes_of), kind)
    lists = shared.union(sizes).groupBy("block").applyInArrow(released_table(_short_lists), "key bigint, node bigint, size bigint, room bigint")
    lists = written(lists, "lists")
    # Of equal sets one is the node.
    again = classes.where("copies > 1").select("owner", *[F.col(c).alias(f"of_{c}") for c in same])
    again = sets.select("node", *same).join(again, [F.col(c) == F.col(f"of_{c}") for c in same]).where("node != owner").select(F.col("node").alias("again"))
    lists_ = lists.join(again.hint("merge"), F.col("node") == F.col("again"), "left_anti")
    met = lists_.groupBy("key").agg(F.count("*").alias("met")).where("met > 1").select(F.col("key").alias("of"))
    members = written(lists_.join(met.hint("merge"), F.col("key") == F.col("of"), "left_semi"), "members")
    dropped(lists)

    wanted = written(members.select(F.col("node").alias("wanted")).distinct(), "wanted")
    items = flagged(sets.select("node", F.col("shingles").alias("data")), F.col("node"), wanted, "may").where("may")
    items = written(items.join(wanted.hint("merge"), F.col("node") == F.col("wanted")).select("node", "data"), "items")
    labels = linked(members, items, _search, _search_all, _may, BLOCK, by_key=False, percent=PERCENT)  # near texts have many rare shingles in common
    dropped(members, wanted, items)

    inside = classes.join(labels, F.col("owner") == F.col("node")).select(*same, "component", "least")
    inside = written(inside, "inside")
    lowest = inside.groupBy("component").agg(F.min("least").alias("lowest"))
    named = inside.join(lowest, "component").select(*same, F.col("lowest").alias("component_id"))
    alone = classes.where("copies > 1").join(inside.select(*same), same, "left_anti").select(*same, F.col("least").alias("component_id"))
    named = written(named.union(alone), "named")
    members = written(sets.select("doc_id", *same), "documents")
    dropped(inside, classes, labels, sets)
    return members.join(named, same, "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs whose document is the first (smallest doc_id) of its component; of repeated rows all stay or go.

    Rows without doc_id stay. Only rows that may go are shuffled.
    """
    name = fresh(docs, "_gone")
    gone = written(cluster(docs).where("component_id != doc_id").select(F.col("doc_id").alias(name)).distinct(), "gone")
    may = flagged(docs, F.col("doc_id"), gone, f"{name}_may")
    left = may.where(f"{name}_may").join(gone.hint("merge"), F.col("doc_id").cast("bigint") == F.col(name), "left_anti")
    return may.where(f"NOT {name}_may").union(left).drop(f"{name}_may")
