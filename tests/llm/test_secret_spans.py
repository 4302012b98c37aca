"""Spans of texts with very many matches."""

import re
import time

from pyspark.sql import functions as F

from estate_jobs.llm import secrets


def test_a_text_of_many_matches(spark, docs_of):
    """100,000 hex runs in one text: each is found in its place, in time that grows with their number."""
    runs = [f"{k:032x}" if k % 7 else f"{k:05x}" for k in range(100_000)]
    text = "é ".join(runs)
    start = time.time()
    (row,) = secrets.find_secrets(docs_of([(1, text, None, None)])).collect()
    assert time.time() - start < 60
    assert [(s.start, s.end) for s in row["hex"]] == [m.span() for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]


def test_runs_of_matches_meet(spark, docs_of, monkeypatch):
    """Texts with fewer, as many and more matches than a run has; the last ones too short or at the end of the text."""
    monkeypatch.setattr(secrets, "RUN", 3)
    texts = ["".join(f"AKIA{'Z' * (14 + k % 4)}{sep}" for k in range(n)) for n in range(9) for sep in ("!", " 𝄞 ")] + ["x", "", None, "AKIA" + "Q" * 16]
    rule = next(r for r in secrets.RULES if r.kind == "access")
    df = docs_of([(k, t, None, None) for k, t in enumerate(texts)]).select("doc_id", secrets.matches(F.coalesce("text", F.lit("")), rule).alias("found"))
    for r in df.collect():
        want = [(m.start(), "access", m.end()) for m in re.finditer(rule.regex, texts[r.doc_id] or "") if len(m[0]) >= rule.least]
        assert [tuple(s) for s in r.found] == want
