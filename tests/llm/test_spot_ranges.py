import random
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from estate_jobs.llm import spot_signatures


@pytest.fixture(scope="module")
def crowded(spark, make, docs_of):
    """A third of the rows without an id, a third of one id, the others of any ids; copies and repeated rows in all."""
    r = random.Random(5)
    pool = [make("en", 30, k) for k in range(150)] + ["", None, "!!!"]
    rows = [(None, r.choice(pool)) for _ in range(400)] + [(7, r.choice(pool)) for _ in range(400)]
    rows += [(i, r.choice(pool)) for i in [-(1 << 63), (1 << 63) - 1, (1 << 60) + 1, (1 << 60) + 2, (1 << 60) + 2, 6, 8, *r.sample(range(-5000, 5000), 400)]]
    r.shuffle(rows)
    return [(i, t or "") for i, t in rows], docs_of([(i, t, "en", "s") for i, t in rows])


def test_rows_of_one_id_are_cut(spark, crowded):
    rows, docs = crowded
    put = spot_signatures._ranges(spot_signatures._docs(docs), 50)
    found = put(spot_signatures._docs(docs), F.xxhash64(spot_signatures.signatures(F.col("text")))).select("doc_id", "range", "turn").collect()
    used = {i: {x.range for x in found if x.doc_id == i} for i in (None, 7)}
    assert all(len(v) > 5 for v in used.values()) and not used[None] & used[7] and len(found) == len(rows)
    assert max(Counter(x.range for x in found).values()) < len(rows) / 6
    assert all((x.turn != 0) == (x.doc_id in (None, 7)) for x in found)
    # ranges follow each other along descending ids
    key = lambda x: (x.doc_id is None, 0 if x.doc_id is None else -x.doc_id, x.turn)
    placed = [x.range for x in sorted(found, key=key)]
    assert placed == sorted(placed)


def test_next_of_crowded_ids(spark, crowded):
    rows, docs = crowded
    sigs = {x.text: x.h for x in docs.select(F.coalesce("text", F.lit("")).alias("text")).distinct().select("text", F.xxhash64(spot_signatures.signatures(F.col("text"))).alias("h")).collect()}
    turn = lambda i, t: sigs[t] % spot_signatures.TURNS if i in (None, 7) else 0
    order = sorted(rows, key=lambda x: (x[0] is None, 0 if x[0] is None else -x[0], turn(*x), x[1]))
    want = Counter((i, t, n) for (i, t), (_, n) in zip(order, order[1:] + order[:1], strict=True))
    assert Counter((x.doc_id, x.text, x.next_text) for x in spot_signatures.with_next(docs, cut_rows=50).collect()) == want
    classes = spot_signatures.classes_of(docs)
    told = spot_signatures.with_next(docs, classes, 50).collect()
    assert Counter((x.doc_id, x.text, x.next_text) for x in told) == want
    prints = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("sigs", spot_signatures.signatures(F.col("text")))
    named = Counter((x.doc_id, x.text, x.class_id) for x in spot_signatures.near_classes(prints).collect())
    assert Counter((x.doc_id, x.text, x.class_id) for x in told) == named


def test_texts_without_words_are_no_anchors():
    assert xxhash.xxh64_intdigest(b"", 42) % spot_signatures.EVERY
