import re
from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from estate_jobs.llm.common import table
from tests.conftest import SF
from tests.llm.test_text_operators import brute_groups, brute_hits, brute_spans


def test_stages_against_brute_force(spark, tmp_path):
    docs = table(spark, SF, "documents")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        rows = docs.collect()
        after = {r.doc_id: r for r in rows}
        if name != "mixing":
            assert docs.columns == columns and len(after) == len(rows)
        if name == "language_id":
            assert len(after) >= 0.98 * len(before)
        if name == "near_duplicates":
            group, _ = brute_groups([(i, r.text) for i, r in before.items()])
            assert set(after) == {i for i, g in group.items() if i == g}
        if name == "decontamination":
            items = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
            assert set(after) == {k[0] for k in brute_hits([(i, r.text) for i, r in before.items()], items) if not k[2]} and len(after) < len(before)
        if name == "secret_scan":
            assert set(after) == set(before) and all(brute_spans(r.text) == "" for r in rows)
            assert all(after[i].text == r.text for i, r in before.items() if not brute_spans(r.text))
    assert {(r.doc_id, r.copy) for r in rows} == {(r.doc_id, k) for r in rows for k in range(1, 1 + sum(x.doc_id == r.doc_id for x in rows))}
    assert corpus_pipeline.run(spark, SF).count() == len(rows)


def test_stages_on_odd_tables(spark, docs_of, make, tmp_path):
    bench = "one two three four five six seven eight nine ten eleven twelve"
    (tmp_path / "sf").mkdir()
    spark.createDataFrame([(1, bench), (2, None), (None, "")], "item_id long, text string").write.parquet(f"{tmp_path}/sf/benchmark.parquet")
    clean = [make("en", 80, k) for k in range(8)]
    rows = [(5, clean[0]), (5, clean[1]), (None, clean[2]), (None, clean[3]), (None, clean[3]), (6, clean[4]), (6, clean[4]), (7, clean[4] + " end"), (8, None), (9, ""), (10, "?! 12"), (None, make("en", 40, 9) + " " + bench), (11, make("en", 20000, 10)), (11, clean[5] + " password = hunter22x"), (None, clean[6] + " token: abcdefgh1"), (1, clean[7])]
    docs = docs_of([(i, t, "en", "ab"[k % 2] if k % 5 else None) for k, (i, t) in enumerate(rows)])
    for c in ("kept_id", "kinds", "candidate_kinds", "coin", "target", "hit_key", "row", "own", "copies", "spans", "label", "first", "id"):
        docs = docs.withColumn(c, F.lit("own"))
    wanted = [(5, clean[0]), (5, clean[1]), (None, clean[2]), (None, clean[3]), (6, clean[4]), (11, make("en", 20000, 10)), (11, clean[5] + " password = hunter22x"), (None, clean[6] + " token: abcdefgh1"), (1, clean[7])]
    masked = [(i, re.sub("(password =|token:) .*", "[SECRET]", t)) for i, t in wanted]
    left = {"language_id": [r for r in rows if r[1] and r[1] != "?! 12"], "near_duplicates": [*wanted, (None, make("en", 40, 9) + " " + bench)], "decontamination": wanted, "secret_scan": masked}
    empty = docs.filter("false")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, f"{tmp_path}/sf").write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert docs.columns == columns + ["copy"] * (name == "mixing")
        if name != "mixing":
            assert Counter((r.doc_id, r.text) for r in docs.collect()) == Counter(left[name]), name
        assert docs.filter("kept_id = 'own' AND kinds = 'own' AND coin = 'own' AND target = 'own' AND row = 'own' AND id = 'own'").count() == docs.count()
        assert stage(spark, empty, f"{tmp_path}/sf").count() == 0
    assert {(r.doc_id, r.text) for r in docs.collect()} <= set(masked) and docs.count() > 0
