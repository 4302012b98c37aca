"""The prefix trie against a dictionary of prefixes, in shards and blocks of any size."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from estate_jobs.llm import prefix_trie as pt

SEQUENCES = "conv_id long, ids array<long>, sizes array<int>"


def brute(rows):
    """(conv_id, depth, parent, n, children, leaves, saved, ends) of each prefix of rows (conv_id, ids, sizes)."""
    members, ends, size = {}, {}, {(): 0}
    for c, ids, sizes in rows:
        for d in range(len(ids) + 1):
            members.setdefault(tuple(ids[:d]), []).append(c)
            size[tuple(ids[:d])] = sizes[d - 1] if d else 0
        ends.setdefault(tuple(ids), []).append(c)
    children = {}
    for p in members:
        if p:
            children.setdefault(p[:-1], []).append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        below = children.get(p, [])
        leaves[p] = sum(leaves[x] for x in below) if below else 1
        saved[p] = (len(members[p]) - 1) * size[p] + sum(saved[x] for x in below)
    digest = lambda p: hashlib.sha256(",".join(map(str, sorted(ends.get(p, [])))).encode()).hexdigest()
    return sorted(((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children.get(p, [])), leaves[p], saved[p], digest(p)) for p, m in members.items()), key=repr)


def found(df):
    return sorted((tuple(r[c] for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")) for r in df.collect()), key=repr)


def some(seed, n, alphabet, longest):
    r = random.Random(seed)
    rows = []
    for c in r.sample(range(-50, 10 * n), n):
        ids = [r.randrange(alphabet) for _ in range(r.randint(0, longest))]
        rows.append((c, ids, [3 + 2 * x for x in ids]))
    return rows


@pytest.mark.parametrize(("block_turns", "piece_chars", "seed", "alphabet"), [(1 << 18, 1 << 16, 1, 3), (5, 1 << 16, 2, 2), (1, 4, 3, 4), (20, 9, 4, 1)])
def test_shards_and_blocks_against_prefixes(spark, block_turns, piece_chars, seed, alphabet):
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so that there are several shards
    try:
        rows = some(seed, 150, alphabet, 6)
        # a third of all rows is one sequence, which so lies in several shards
        rows += [(5000 + k, [1, 0, 1], [5, 3, 5]) for k in range(80)]
        df = spark.createDataFrame(rows, SEQUENCES)
        assert found(pt.trie(df, block_turns, piece_chars)) == brute(rows)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


@pytest.mark.parametrize("cuts", [1, 2, 3, 7, 40])
def test_merged_boundaries(cuts):
    """Runs of sorted sequences cut anywhere give the same nodes, but for what parents are called."""
    for seed in range(30):
        rows = sorted(some(seed, 40, 2 + seed % 3, 5), key=lambda x: (x[1], x[0]))
        groups = []
        for c, ids, sizes in rows:
            if not groups or groups[-1].ids.tolist() != ids:
                groups.append(pt.Group(np.array(ids, np.int64), np.array(sizes, np.int64), c, None))
            groups[-1].add(c)
        for g in groups:
            g.ends = g.hash.hexdigest()
        out, refs, total = [], iter(range(10**6)), None
        emit = lambda *x: out.append(x)
        step = -(-len(groups) // cuts)
        for k in range(0, len(groups), step):
            own, rest = pt.boundary(groups[k : k + step], lambda: next(refs))
            if total is None:
                total = own
            else:
                total.merge(own, emit)
            rest(emit)
        total.finish(emit)
        named = {ref: x[1] for x in out for ref in x[8] or []}
        got = sorted(((conv, d, parent if parent is not None or ref is None else named[ref], n, kids, leaves, saved, ends or pt.NOTHING) for d, conv, parent, n, kids, leaves, saved, ends, _, ref in out), key=repr)
        assert got == brute(rows)


def test_trees_are_balanced_and_walked_in_order():
    groups = [pt.Group(np.array([k, 1]), np.array([1, 1]), k, None) for k in range(1023)]
    tree, first, last = pt.grow(groups)
    deep, todo = 0, [(tree.eq[0], 1)]
    while todo:
        v, d = todo.pop()
        deep = max(deep, d)
        todo += [(x, d + 1) for x in (tree.lo[v], tree.hi[v]) if x]
    assert deep == 10
    keys = [tree.key[v] for v in tree.walk() if tree.depth[v] == 1]
    assert keys == sorted(keys) == list(range(1023)) and sorted(tree.walk()) == list(range(len(tree.key)))
    assert [tree.key[v] for v in tree.path(first)] == [-1, 0, 1] and [tree.key[v] for v in tree.path(last)] == [-1, 1022, 1]


TURNS = "conv_id long, turn long, role string, text string"


def rebuilt(rows):
    """Sequences of (role, text) by conversation, with heads taken over, in plain Python."""
    own = {}
    key = lambda role, text: hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()[:32]
    for c, t, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((t is not None, t or 0, key(role or "", text or ""), (role or "", text or "")))
    turns = {c: [x[3] for x in sorted(v)] for c, v in own.items()}
    out = {}
    for c, mine in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = turns.get(c - (abs(c) % 5 if c >= 0 else -(abs(c) % 5)), [])[:h] + mine[h:]
    return out


def test_conversations(spark):
    r = random.Random(3)
    texts = ["hi", "é𝄞", "", None, "a:b", "long " * 2000]
    rows = [(c, t if t else None, r.choice(["user", "assistant", None]), r.choice(texts)) for c in [*range(-7, 60), None] for t in range(r.randint(1, 12))]
    bare = next(c for c in range(2001, 2100) if c % 5 and zlib.crc32(str(c).encode()) % 9)  # its base is absent
    rows += rows[5:25] + [(bare, 1, "user", "only"), (1001, 3, "x", "no base"), (1001, 3, "a", "tie"), (1001, 3, None, "tie")]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, TURNS).withColumn("ids", F.lit("x")).withColumn("size", F.lit(1)).withColumn("key", F.lit("k"))
    want = [(c, s, [len(t.encode()) for _, t in s]) for c, s in rebuilt(rows).items()]
    assert any(not s for _, s, _ in want)
    assert found(pt.trie(pt.rebuilt(pt.encoded(df)))) == brute(want)
    assert found(pt.trie(pt.rebuilt(pt.encoded(df.filter("false"))))) == []
