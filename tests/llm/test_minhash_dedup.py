"""Near-dedup by MinHash against all pairs, in blocks of several sizes, and on odd rows."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from estate_jobs.llm import minhash_dedup as md
from estate_jobs.llm.near_duplicates import Forest, least_matches
from estate_jobs.llm.tokens import buffers

BLANK = "[^\x20\x09-\x0d]+"


def set_of(text, n=3):
    w = re.findall(BLANK, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def brute(rows, percent=85, n=3):
    """(id, size, component, kept) of each row, by all pairs."""
    sets = [set_of(t, n) for _, t in rows]
    f = Forest(len(rows))
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                f.link(i, j)
    out = []
    for i, (doc_id, _) in enumerate(rows):
        ids = [x for k, (x, _) in enumerate(rows) if f.root(k) == f.root(i) and x is not None]
        least = min(ids) if ids else None
        out.append((doc_id, len(sets[i]), least, doc_id == least))
    return sorted(out, key=repr)


def found(spark, rows, **parameters):
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("row", F.lit("x")).withColumn("sig", F.lit(1)).withColumn("n_bytes", F.lit(2))
    return sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in md.near_dedup(docs, **parameters).collect()), key=repr)


def copies(r, n, base, words, edits):
    """n texts made from one, each with some words changed."""
    text = [r.choice(words) for _ in range(base)]
    out = []
    for _ in range(n):
        t = list(text)
        for _ in range(r.randint(0, edits)):
            t[r.randrange(len(t))] = r.choice(words)
        out.append(" ".join(t))
    return out


def test_words_and_shingles():
    texts = ["A b,c  d", None, "", " x\ty\x0bz", "one", "Two words", "a b c a b c", " \n"]
    import pyarrow as pa

    value, row = md.shingles(*buffers(pa.array(texts)))
    assert np.bincount(row, minlength=len(texts)).tolist() == [len(set_of(t)) for t in texts]
    same = md.shingles(*buffers(pa.array(["é Ab c D", "é\tAB\nC\rd", "É ab c d"])))
    by = [same[0][same[1] == k].tolist() for k in range(3)]
    assert by[0] == by[1] != by[2]


# Blocks of 3 texts: several for each group, so that hubs and rows outside of the largest component matter.
@pytest.mark.parametrize("block", [256, 3])
def test_components_against_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(md, "BLOCK_TEXTS", block)
    r = random.Random(block)
    words = [f"w{k}" for k in range(400)]
    texts = [t for edits in (1, 2, 3, 5) for t in copies(r, 12, 60, words, edits)]
    # a chain: neighbours are alike, its ends aren't
    chain = [f"c{k}" for k in range(300)]
    texts += [" ".join(chain[4 * k : 4 * k + 60]) for k in range(20)]
    texts += ["", None, "one", "one", "ONE", "two words", " two\twords ", "a b c", "-- !"] + [" ".join(r.choices(words, k=40)) for _ in range(10)]
    texts += texts[:5]
    rows = [(k if k % 9 else None, t) for k, t in enumerate(texts)]
    r.shuffle(rows)
    assert found(spark, rows) == brute(rows)


def test_parameters_and_repeated_ids(spark):
    r = random.Random(5)
    rows = [(k % 7, t) for k, t in enumerate(copies(r, 20, 50, [f"v{k}" for k in range(90)], 4))]
    assert found(spark, rows, percent=70, shingle=2) == brute(rows, 70, 2)
    assert found(spark, []) == []
    assert found(spark, [(None, "x y z"), (None, "x y z"), (None, None)]) == [(None, 0, None, True), (None, 1, None, True), (None, 1, None, True)]


def test_a_very_long_text(spark):
    long = " ".join(f"t{k}" for k in range(150_000))
    rows = [(1, long), (2, long + " more"), (3, long[: len(long) // 2]), (4, "short text here")]
    assert found(spark, rows) == brute(rows)


def test_group_with_a_centre_costs_little():
    """A group of near copies is joined by about one verification each, not by all pairs."""
    r = random.Random(1)
    import pyarrow as pa

    texts = copies(r, 200, 120, [f"w{k}" for k in range(500)], 2)
    value, row = md.shingles(*buffers(pa.array(texts)))
    _, starts, sizes = np.unique(row, return_index=True, return_counts=True)
    sig = md.signatures(value, starts)
    i, j = np.triu_indices(len(texts), 1)
    i, j, match = md._matches(sig, i, j, least_matches(0.85, 1e-6))
    f = Forest(len(texts))
    looked = md.connect(f, i, j, match, value, starts, sizes, 85)
    assert len(i) > 5_000 and looked < 3 * len(texts)
    want = Forest(len(texts))
    sets = [set_of(t) for t in texts]
    for a in range(len(texts)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                want.link(a, b)
    assert len(f.edges) == len(want.edges)


def test_hopeless_blocks_are_multiplied():
    """Where most pairs fail, intersections come from one product: the result is the same."""
    r = random.Random(2)
    import pyarrow as pa

    texts = copies(r, 60, 40, [f"w{k}" for k in range(300)], 12)
    value, row = md.shingles(*buffers(pa.array(texts)))
    _, starts, sizes = np.unique(row, return_index=True, return_counts=True)
    i, j = np.triu_indices(len(texts), 1)
    f = Forest(len(texts))
    assert md.connect(f, i, j, np.zeros(len(i)), value, starts, sizes, 85) > 16 * len(texts)
    sets = [set_of(t) for t in texts]
    want = Forest(len(texts))
    for a, b in zip(i.tolist(), j.tolist(), strict=True):
        if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
            want.link(a, b)
    assert {frozenset(k for k in range(60) if f.root(k) == f.root(x)) for x in range(60)} == {frozenset(k for k in range(60) if want.root(k) == want.root(x)) for x in range(60)}
