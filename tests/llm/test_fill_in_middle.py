"""Piece tables of the fill-in-the-middle transformation: round trips, cuts and odd rows."""

import hashlib
import random
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from estate_jobs.llm import fill_in_middle as fim

PARTS = "abé<P<S><M \n\n𝄞"


def plain(doc_id, text, rate=100, spm=50, seed=7, unit=r"[^\n]*\n|[^\n]+"):
    """The same transformation on strings."""
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    units = re.findall(unit, text, re.S)
    lo, hi = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = ("".join(x) for x in (units[:lo], units[lo:hi], units[hi:]))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return "plain", None, None, text, len(units)
    if h4 % 100 < spm:
        return "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}", len(units)
    return "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}", len(units)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["", "a", "<", "P>", "<S", "é\n", "\n", "𝄞", "M>", "x y"]), max_size=8), st.lists(st.integers(0, 40), min_size=2, max_size=2), st.sampled_from(["psm", "spm"]))
def test_pieces_come_back(parts, at, form):
    text = "".join(parts).encode()
    cuts = sorted(min(k, len(text)) for k in at)
    s, order = fim.Sentinels(("<P>", "<S>", "<M>")), fim.ARRANGEMENTS[form]
    if any(m in text for m in s.marks):
        return
    pieces = fim.split(fim.Piece(fim.TEXT, 0, len(text)), *cuts)
    views = (memoryview(text), s.view)
    assert b"".join(fim.stream(pieces, views)) == text
    assert fim.permute(fim.permute(pieces, order), fim.inverse(order)) == pieces
    output = b"".join(fim.stream(s.before(pieces, order), views))
    read = fim.split(fim.Piece(fim.TEXT, 0, len(text)), *cuts)
    assert [output[p.start : p.start + p.length] for p in s.read(output, order)] == [text[p.start : p.start + p.length] for p in read]


def test_units():
    ends = lambda t, unit: fim.unit_ends(np.frombuffer(t.encode(), np.uint8), unit).tolist()
    assert [ends(t, "line") for t in ("", "a", "\n", "a\n\nb", "é\n")] == [[], [1], [1], [2, 3, 4], [3]]
    assert [ends(t, "char") for t in ("", "a", "é𝄞b")] == [[], [1], [2, 6, 7]]


def test_rows_against_strings(spark, docs_of):
    r = random.Random(4)
    texts = [None, "", "\n", "one line", "has <M> inside", "<P", "a\n" * 50, "é𝄞\n" * 40_000] + ["".join(r.choice(PARTS) for _ in range(r.randint(1, 60))) for _ in range(120)]
    rows = [(k, t, None, "s") for k, t in enumerate(texts)] + [(None, "x\ny\nz", None, None), (6, "a\n" * 50, None, None), (6, "b\n" * 50, None, None), (-3, "q\nr", None, None)]
    docs = docs_of(rows).withColumn("output", F.lit(1)).withColumn("form", F.lit("x"))
    want = sorted((repr((i, *plain(i, t or ""))) for i, t, *_ in rows))
    found = fim.fill_in_middle(docs).collect()
    assert sorted(repr((f.doc_id, f.form, f.prefix_chars, f.middle_chars, f.output, f.n)) for f in found) == want
    texts_of = {}
    for i, t, *_ in rows:
        texts_of.setdefault(i, set()).add(hashlib.sha256((t or "").encode()).hexdigest())
    assert all(f.output_sha256 == hashlib.sha256(f.output.encode()).hexdigest() and f.restored_sha256 in texts_of[f.doc_id] for f in found)
    # the descriptors are the output
    sentinels = b"<P><S><M>"
    assert all(sum(p.length for p in f.pieces) == len(f.output.encode()) and all(p.start + p.length <= len(sentinels) for p in f.pieces if p.buffer == fim.SENTINEL) for f in found)
    assert {f.form for f in found} == {"plain", "psm", "spm"}


def test_rule_parameters(spark, docs_of):
    rows = [(k, f"line {k}\nsecond é line\nthird", None, None) for k in range(60)]
    rule = fim.Rule(rate=40, spm=0, seed=3, unit="char")
    found = {f.doc_id: f for f in fim.fill_in_middle(docs_of(rows), rule).collect()}
    for i, t, *_ in rows:
        form, p, m, out, n = plain(i, t, 40, 0, 3, ".")
        assert (found[i].form, found[i].prefix_chars, found[i].middle_chars, found[i].output, found[i].n) == (form, p, m, out, n)
    assert 0 < sum(f.form == "psm" for f in found.values()) < 60 and not any(f.form == "spm" for f in found.values())
    assert fim.fill_in_middle(docs_of([])).count() == 0
