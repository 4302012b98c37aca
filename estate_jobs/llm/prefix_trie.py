"""Prefix trie of conversations, by ternary search trees over range shards.

Turns are dictionary-encoded: each distinct (role, text) gets an integer. Conversations, as sequences of these, are
sorted and dealt in ranges. A shard takes its sorted sequences in blocks of a bounded number of turns. Each block becomes
a ternary search tree (a node has a turn id, its siblings below and above it, and its first child), balanced by inserting
the median sequence first; equal sequences are inserted once, with their number. An iterative walk of the tree adds up
members, leaves and savings.

Only nodes on the path of a block's first or last sequence can go on in another block: these boundary nodes are merged
with those of the next one, first within a task, then, a few for each shard, over all shards. What leaves the boundary is
final at once. The ids of a group of equal conversations that may go on in another shard, or is large, are kept as
pieces of text and hashed in order by one task that holds a piece at a time.

Edge cases: rows of a null conv_id belong to no conversation; null turns come first; rows of equal turns follow by the
hash of role and text, and repeated rows are turns like others; null roles and texts are empty; a conversation without
turns, after its rebuilding, is a member of the root alone and ends there; a very long text is hashed where it lies, and
a conversation of very many turns is one array of 12 bytes a turn; extra columns, whatever their names, are not read; an
empty table has no root and gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from estate_jobs.llm.common import kept, small_enough, table

#: Turns of distinct sequences that a tree holds, and characters of a piece of ids, about.
BLOCK_TURNS, PIECE_CHARS = 1 << 18, 1 << 16
NOTHING = hashlib.sha256(b"").hexdigest()
#: Turns at most that the query takes from another conversation, and how many conversations share them.
HEAD, FAMILY = 8, 5
ROWS = 4096


class Tree:
    """A ternary search tree of turn ids. Node 0 is the root; 0 as a link is none."""

    def __init__(self) -> None:
        self.key, self.lo, self.eq, self.hi, self.up, self.depth, self.size = [-1], [0], [0], [0], [-1], [0], [0]
        self.ends: dict[int, Group] = {}

    def _new(self, key: int, size: int, up: int) -> int:
        for values, x in ((self.key, key), (self.lo, 0), (self.eq, 0), (self.hi, 0), (self.up, up), (self.depth, self.depth[up] + 1), (self.size, size)):
            values.append(x)
        return len(self.key) - 1

    def insert(self, group: Group) -> int:
        """The node where the group's sequence ends."""
        at = 0
        for key, size in zip(group.ids.tolist(), group.sizes.tolist(), strict=True):
            slot, links, holder = self.eq[at], self.eq, at
            while slot and self.key[slot] != key:
                links, holder = (self.lo if key < self.key[slot] else self.hi), slot
                slot = links[slot]
            if not slot:
                slot = links[holder] = self._new(key, size, at)
            at = slot
        self.ends[at] = group
        return at

    def walk(self) -> Iterator[int]:
        """All nodes, each after its parent and siblings in the order of their ids."""
        yield 0
        todo, at = [], self.eq[0]
        while todo or at:
            while at:
                todo.append(at)
                at = self.lo[at]
            at = todo.pop()
            yield at
            # what is below comes before the greater siblings
            if self.hi[at]:
                todo.append(-self.hi[at])
            at = self.eq[at]
            while not at and todo and todo[-1] < 0:
                at = -todo.pop()

    def path(self, node: int) -> list[int]:
        """From the root to the node."""
        out = []
        while node >= 0:
            out.append(node)
            node = self.up[node]
        return out[::-1]


class Group:
    """Equal sequences: their turns, least id, number, and the hash of their ids or what refers to its pieces."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray, conv: int, ref: int | None) -> None:
        self.ids, self.sizes, self.conv, self.n, self.ref, self.ends = ids, sizes, conv, 0, ref, None
        self.hash, self.text, self.chars = hashlib.sha256(), [], 0

    def add(self, conv: int) -> None:
        text = f",{conv}" if self.n else str(conv)
        self.hash.update(text.encode())
        self.text.append(str(conv))
        self.chars += len(text)
        self.n += 1

    def piece(self) -> str:
        out = ",".join(self.text)
        self.text, self.chars = [], 0
        return out


class Node:
    """A boundary node: all members so far, and what hangs below it but not on the boundary."""

    __slots__ = ("key", "size", "conv", "n", "children", "leaves", "saved", "ends", "refs")

    def __init__(self, key: int, size: int, conv: int, n: int, children: int, leaves: int, saved: int, ends: str | None, refs: list[int]) -> None:
        self.key, self.size, self.conv, self.n, self.children, self.leaves, self.saved, self.ends, self.refs = key, size, conv, n, children, leaves, saved, ends, refs

    def take(self, other: Node) -> None:
        self.conv, self.n, self.ends = min(self.conv, other.conv), self.n + other.n, self.ends or other.ends
        self.children, self.leaves, self.saved = self.children + other.children, self.leaves + other.leaves, self.saved + other.saved
        self.refs = self.refs + other.refs


Emit = Callable[..., None]


def close(path: list[Node], depth: int, emit: Emit) -> None:
    """The node of that depth gets nothing more: it goes out, and counts below its parent."""
    v, parent = path[depth], path[depth - 1] if depth else None
    v.leaves, v.saved = v.leaves if v.children else 1, v.saved + (v.n - 1) * v.size
    emit(depth, v.conv, None, v.n, v.children, v.leaves, v.saved, v.ends, v.refs, parent.refs[0] if parent else None)
    if parent:
        parent.children, parent.leaves, parent.saved = parent.children + 1, parent.leaves + v.leaves, parent.saved + v.saved


class Boundary:
    """Paths of the first and of the last sequence of a run of sequences; the first `common` nodes are the same."""

    def __init__(self, left: list[Node], right: list[Node], common: int) -> None:
        self.left, self.right, self.common = left, right, common

    def merge(self, b: Boundary, emit: Emit) -> None:
        """Takes in the boundary of the run that follows; nodes that are on neither path any more go out."""
        old, k = self.right, 0
        while k < min(len(old), len(b.left)) and old[k].key == b.left[k].key:
            old[k].take(b.left[k])
            k += 1
        for d in range(len(old) - 1, max(k, self.common) - 1, -1):
            close(old, d, emit)
        inner = old[:k] + b.left[k:]
        for d in range(len(inner) - 1, b.common - 1, -1):
            if d < k and d < self.common:
                break
            close(inner, d, emit)
        m = min(k, b.common)
        self.right, self.common = old[:m] + b.right[m:], min(self.common, m)

    def finish(self, emit: Emit) -> None:
        for d in range(len(self.right) - 1, self.common - 1, -1):
            close(self.right, d, emit)
        for d in range(len(self.left) - 1, -1, -1):
            close(self.left, d, emit)


def grow(groups: list[Group]) -> tuple[Tree, int, int]:
    """A tree of sorted sequences, the median first, then those of either half; where the first and the last one end."""
    tree, at, todo = Tree(), {}, [(0, len(groups))]
    while todo:
        a, b = todo.pop()
        mid = (a + b) // 2
        at[mid] = tree.insert(groups[mid])
        todo += [(x, y) for x, y in ((mid + 1, b), (a, mid)) if x < y]
    return tree, at[0], at[len(groups) - 1]


def boundary(groups: list[Group], new_ref: Callable[[], int]) -> tuple[Boundary, Callable[[Emit], None]]:
    """The boundary of a block of groups, and a function that sends out its other nodes."""
    tree, first, last = grow(groups)
    paths = tree.path(first), tree.path(last)
    edge = {v: True for p in paths for v in p}
    order, n = list(tree.walk()), len(tree.key)
    members, conv, children, leaves, saved = [0] * n, [None] * n, [0] * n, [0] * n, [0] * n
    for v, g in tree.ends.items():
        members[v], conv[v] = g.n, g.conv
    for v in reversed(order):
        up = tree.up[v]
        if v not in edge:
            leaves[v] = leaves[v] if children[v] else 1
            saved[v] += (members[v] - 1) * tree.size[v]
            children[up], leaves[up], saved[up] = children[up] + 1, leaves[up] + leaves[v], saved[up] + saved[v]
        if v:
            members[up] += members[v]
            conv[up] = conv[v] if conv[up] is None else min(conv[up], conv[v])
    end_of = lambda v: (tree.ends[v].ends, [tree.ends[v].ref] if tree.ends[v].ref is not None else []) if v in tree.ends else (None, [])
    nodes = {}
    for v in edge:
        ends, refs = end_of(v)
        nodes[v] = Node(tree.key[v], tree.size[v], conv[v], members[v], children[v], leaves[v], saved[v], ends, [new_ref(), *refs])
    left, right = ([nodes[v] for v in p] for p in paths)
    refs_of = {v: x.refs[0] for v, x in nodes.items()}

    def rest(emit: Emit) -> None:
        for v in order:
            if v not in edge:
                ends, refs = end_of(v)
                up = tree.up[v]
                emit(tree.depth[v], conv[v], None if up in edge else conv[up], members[v], children[v], leaves[v], saved[v], ends, refs or None, refs_of.get(up))

    return Boundary(left, right, sum(a == b for a, b in zip(*paths, strict=False))), rest


FIELDS = [
    ("kind", pa.string()), ("depth", pa.int64()), ("conv_id", pa.int64()), ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("ends", pa.string()), ("refs", pa.list_(pa.int64())), ("parent_ref", pa.int64()),
    ("shard", pa.int64()), ("place", pa.int64()), ("key", pa.int64()), ("size", pa.int64()), ("is_left", pa.bool_()), ("is_right", pa.bool_()), ("piece", pa.string()),
]
DDL = "kind string, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends string, refs array<long>, parent_ref long, shard long, place long, key long, size long, is_left boolean, is_right boolean, piece string"


class Out:
    """Rows on their way out, in batches."""

    def __init__(self) -> None:
        self.rows: list[tuple] = []

    def node(self, *values) -> None:
        self.rows.append(("node", *values, *[None] * 7))

    def piece(self, ref: int, shard: int, place: int, text: str) -> None:
        self.rows.append(("piece", *[None] * 8, [ref], None, shard, place, *[None] * 4, text))

    def path(self, shard: int, place: int, depth: int, v: Node, is_left: bool, is_right: bool) -> None:
        self.rows.append(("path", depth, v.conv, None, v.n, v.children, v.leaves, v.saved, v.ends, v.refs, None, shard, place, v.key, v.size, is_left, is_right, None))

    def batches(self, least: int = ROWS) -> Iterator[pa.RecordBatch]:
        while len(self.rows) >= max(1, least):
            part, self.rows = self.rows[:ROWS], self.rows[ROWS:]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*part, strict=True), FIELDS, strict=True)], [n for n, _ in FIELDS])


def _shard(block_turns: int, piece_chars: int):
    """Nodes, boundary and pieces of one range of sorted conversations (conv_id, ids, sizes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, out, counter = TaskContext.get().partitionId(), Out(), 0
        total: Boundary | None = None
        groups: list[Group] = []
        current: Group | None = None
        turns = places = 0

        def new_ref() -> int:
            nonlocal counter
            counter += 1
            return (shard << 40) + counter

        def send_piece(g: Group) -> None:
            nonlocal places
            g.ref = new_ref() if g.ref is None else g.ref
            out.piece(g.ref, shard, places, g.piece())
            places += 1

        def finish_group(g: Group, last: bool) -> None:
            nonlocal turns
            if g.ref is not None or last:
                if g.text:
                    send_piece(g)
            else:
                g.ends = g.hash.hexdigest()
            g.text = []
            groups.append(g)
            turns += len(g.ids)

        def finish_block() -> None:
            nonlocal total, groups, turns
            own, rest = boundary(groups, new_ref)
            if total is None:
                total = own
            else:
                total.merge(own, out.node)
            rest(out.node)
            groups, turns = [], 0

        for batch in batches:
            flat, sizes = batch.column("ids"), batch.column("sizes")
            at, values, bytes_of = flat.offsets.to_numpy(), flat.values.to_numpy(zero_copy_only=False), sizes.values.to_numpy(zero_copy_only=False)
            at_sizes = sizes.offsets.to_numpy()
            for k, conv in enumerate(batch.column("conv_id").to_pylist()):
                ids = values[at[k] : at[k + 1]]
                if current is None or len(ids) != len(current.ids) or not np.array_equal(ids, current.ids):
                    first = current is None
                    if not first:
                        finish_group(current, False)
                        if turns >= block_turns:
                            finish_block()
                    current = Group(ids.copy(), bytes_of[at_sizes[k] : at_sizes[k + 1]].copy(), conv, new_ref() if first else None)
                current.add(conv)
                if current.chars >= piece_chars:
                    send_piece(current)
            yield from out.batches()
        if current is not None:
            finish_group(current, True)
            finish_block()
            same = {id(v) for v in total.left} & {id(v) for v in total.right}
            rows = [(d, v, True, id(v) in same) for d, v in enumerate(total.left)] + [(d, v, False, True) for d, v in enumerate(total.right) if id(v) not in same]
            for place, (d, v, is_left, is_right) in enumerate(rows):
                out.path(shard, place, d, v, is_left, is_right)
        yield from out.batches(1)

    return run


def _join_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merges the boundaries of all shards, in order: some rows a shard, of which two paths are held at a time."""
    out, total, shard, left, right, common = Out(), None, None, [], [], 0

    def add() -> None:
        nonlocal total
        own = Boundary(left, right, common)
        if total is None:
            total = own
        else:
            total.merge(own, out.node)

    for batch in batches:
        for r in batch.to_pylist():
            if r["shard"] != shard:
                if shard is not None:
                    add()
                shard, left, right, common = r["shard"], [], [], 0
            v = Node(r["key"], r["size"], r["conv_id"], r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"], r["ends"], r["refs"])
            if r["is_left"]:
                left.append(v)
            if r["is_right"]:
                right.append(v)
            common += r["is_left"] and r["is_right"]
        yield from out.batches()
    if shard is not None:
        add()
        total.finish(out.node)
    yield from out.batches(1)


def _hash_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the pieces of each node, sorted by node and place."""
    at, h = None, None
    row = lambda: pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([h.hexdigest()])], ["ref", "of_pieces"])
    for batch in batches:
        for ref, text in zip(batch.column("ref").to_pylist(), batch.column("piece").to_pylist(), strict=True):
            if ref != at:
                if h is not None:
                    yield row()
                at, h = ref, hashlib.sha256(text.encode())
            else:
                h.update(b"," + text.encode())
    if h is not None:
        yield row()


def encoded(turns: DataFrame) -> DataFrame:
    """conv_id, ids, sizes of each conversation of turns (conv_id, turn, role, text): turn ids and bytes of texts, in order."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = turns.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("long"), "turn", text("role").alias("role"), text("text").alias("text"))
    key = F.unhex(F.substring(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256), 1, 32))
    keyed = rows.select("conv_id", "turn", key.alias("key"), F.octet_length("text").alias("size"))
    dictionary = kept(keyed.groupBy("key").agg(F.max("size").alias("size")).withColumn("id", F.monotonically_increasing_id()))
    one = F.struct("turn", "key", "id", "size")
    found = keyed.drop("size").join(dictionary, "key").groupBy("conv_id").agg(F.sort_array(F.collect_list(one)).alias("t"))
    return found.select("conv_id", F.col("t.id").alias("ids"), F.col("t.size").alias("sizes"))


def trie(sequences: DataFrame, block_turns: int = BLOCK_TURNS, piece_chars: int = PIECE_CHARS) -> DataFrame:
    """A row for each node of the trie of sequences (conv_id, ids array<long>, sizes array<int>).

    conv_id: least member; depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256: as in the query.
    """
    sorted_ = sequences.select("conv_id", F.col("ids").cast("array<long>"), F.col("sizes").cast("array<long>")).repartitionByRange("ids", "conv_id").sortWithinPartitions("ids", "conv_id")
    rows = kept(sorted_.mapInArrow(_shard(block_turns, piece_chars), DDL))
    paths = rows.filter("kind = 'path'").repartition(1).sortWithinPartitions("shard", "place")
    nodes = rows.filter("kind = 'node'").union(kept(paths.mapInArrow(_join_shards, DDL)))

    # what boundary nodes are called in other rows, and what they came to be
    named = nodes.filter("refs IS NOT NULL").select(F.explode("refs").alias("ref"), F.col("refs")[0].alias("own"), F.col("conv_id").alias("of_ref"))
    pieces = rows.filter("kind = 'piece'").select(F.col("refs")[0].alias("ref"), "shard", "place", "piece").join(small_enough(named.select("ref", "own")), "ref")
    ordered = pieces.select(F.col("own").alias("ref"), "shard", "place", "piece").repartition("ref").sortWithinPartitions("ref", "shard", "place")
    hashes = small_enough(kept(ordered.mapInArrow(_hash_pieces, "ref long, of_pieces string")))
    parents = small_enough(named.select(F.col("ref").alias("parent_ref"), F.col("of_ref").alias("of_parent")))
    columns = ["conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    inner, below = nodes.filter("parent_ref IS NULL"), nodes.filter("parent_ref IS NOT NULL").join(parents, "parent_ref", "left").withColumn("parent_conv_id", F.col("of_parent"))
    both = inner.select(*columns, "parent_conv_id", "refs", "ends").union(below.select(*columns, "parent_conv_id", "refs", "ends"))
    plain = both.filter("refs IS NULL").select(*columns, "parent_conv_id", "ends")
    edge = both.filter("refs IS NOT NULL").withColumn("ref", F.col("refs")[0]).join(hashes, "ref", "left").select(*columns, "parent_conv_id", F.coalesce("of_pieces", "ends").alias("ends"))
    return plain.union(edge).select("conv_id", "depth", "parent_conv_id", *columns[2:], F.coalesce("ends", F.lit(NOTHING)).alias("ends_sha256"))


def rebuilt(sequences: DataFrame, family: int = FAMILY, most: int = HEAD) -> DataFrame:
    """Sequences whose first h turns, h by the id's crc32, are those of the first conversation of their family."""
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (most + 1)).cast("int")
    base = F.col("conv_id") - F.col("conv_id") % family
    own = sequences.withColumns({"h": h, "base": base})
    heads = sequences.filter(F.col("conv_id") % family == 0).select(F.col("conv_id").alias("base"), F.slice("ids", 1, most).alias("head_ids"), F.slice("sizes", 1, most).alias("head_sizes"))
    joined = own.join(heads, "base", "left")

    def both(part: str) -> Column:
        head = F.coalesce(F.expr(f"slice(head_{part}, 1, h)"), F.expr(f"slice({part}, 1, 0)"))
        return F.concat(head, F.expr(f"slice({part}, h + 1, greatest(size({part}), 1))"))

    return joined.select("conv_id", both("ids").alias("ids"), both("sizes").alias("sizes"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    sequences = kept(encoded(table(spark, sf_dir, "conversations")))
    return trie(kept(rebuilt(sequences)))


# crc32 bit by bit: DuckDB has no function for it
_CRC = "xor(list_reduce(list_concat([CAST(4294967295 AS UBIGINT)], list_transform(range(1, length(s) + 1), lambda k: CAST(ascii(s[k]) AS UBIGINT))), lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, CAST(3988292384 AS UBIGINT) * (x & 1)))), CAST(4294967295 AS UBIGINT))"
OP13_SQL = f"""
WITH given AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(role) || ':' || role || text)) AS k FROM given),
convs AS (SELECT conv_id AS c, conv_id - conv_id % {FAMILY} AS base, CAST({_CRC} % {HEAD + 1} AS BIGINT) AS h FROM (SELECT DISTINCT conv_id, CAST(conv_id AS VARCHAR) AS s FROM own)),
taken AS (SELECT c, k AS d, role, text FROM convs JOIN own ON own.conv_id = base AND k <= h),
counts AS (SELECT c, count(*) AS n FROM taken GROUP BY c),
turns AS (SELECT * FROM taken UNION ALL SELECT c, k - h + coalesce(n, 0), role, text FROM convs JOIN own ON own.conv_id = c AND k > h LEFT JOIN counts USING (c)),
spelled AS (SELECT c, d, string_agg(length(role) || ':' || role || length(text) || ':' || text, '') OVER (PARTITION BY c ORDER BY d) AS p, strlen(text) AS size FROM turns),
prefixes AS (SELECT c, d, sha256(p) AS p, size FROM spelled UNION ALL SELECT c, 0, '', 0 FROM convs),
linked AS (SELECT *, lag(p) OVER (PARTITION BY c ORDER BY d) AS up, lead(d) OVER (PARTITION BY c ORDER BY d) IS NULL AS is_end FROM prefixes),
nodes AS (SELECT p, d, min(c) AS conv_id, count(*) AS n, max(size) AS size, max(up) AS up, sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE is_end), '')) AS ends FROM linked GROUP BY p, d),
children AS (SELECT up AS p, count(*) AS n FROM nodes WHERE d > 0 GROUP BY up),
sums AS (SELECT x.p, count(*) FILTER (WHERE k.n IS NULL) AS leaves, sum((v.n - 1) * v.size) AS saved FROM nodes v LEFT JOIN children k USING (p) JOIN prefixes x ON x.c = v.conv_id AND x.d <= v.d GROUP BY x.p)
SELECT v.conv_id, CAST(v.d AS BIGINT) AS depth, u.conv_id AS parent_conv_id, v.n AS n_convs, coalesce(k.n, 0) AS n_children, s.leaves AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, v.ends AS ends_sha256
FROM nodes v LEFT JOIN nodes u ON v.up = u.p LEFT JOIN children k ON v.p = k.p JOIN sums s ON v.p = s.p
"""
