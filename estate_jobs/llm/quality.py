"""Quality classifier: histogram gradient-boosted trees over document statistics.

The statistics (shares of kinds of characters, repetition of words, word pairs and lines) are computed where the texts
lie. The trees grow on 64-bin histograms with the logistic loss; fitted, they are full binary trees in three arrays
(feature, threshold, leaf), and numpy walks all trees for all rows of a batch at once.

Edge cases: a null or empty text has all statistics 0 and is scored like any other; a very long text is described whole,
alone; several labels of a document are averaged, 0.5 counts as 1; null labels and labels of null ids teach nothing; of
equally good splits the first feature, then the lowest threshold is taken; with no labelled row every score is 0.5;
repeated rows score alike, and rows of one id teach once; extra columns (label among them) are not read; an empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from estate_jobs.llm.common import held_out, table
from estate_jobs.llm.tokens import buffers, chunks, mix, words

#: Labelled documents to learn from, at most about this many, chosen by a hash of the id. They may be broadcast.
TRAIN_DOCS = 12_000
TREES, DEPTH, BINS, RATE, MIN_CHILD, RIDGE = 60, 4, 64, 0.15, 10.0, 1.0
KEEP = 0.7

# Kinds of bytes; the rest (controls, marks not listed) is kind 0.
_KINDS = [b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r", b"\n", b".,;:?", b"!", b"|", b"#$%&*@^~_=+<>/\\", b"'\"()-[]{}`", bytes(range(0x80, 0x100))]
_KIND = np.zeros(256, np.int64)
for _k, _b in enumerate(_KINDS, 1):
    _KIND[np.frombuffer(_b, np.uint8)] = _k
FEATURES = ["log_bytes", "log_words", "other", "lower", "upper", "digits", "blanks", "newlines", "points", "exclaims", "pipes", "signs", "quotes", "beyond_ascii", "word_length", "short_words", "distinct_words", "distinct_pairs", "distinct_lines", "words_a_line", "top_word"]


def _distinct(row: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """Distinct values of each row."""
    key = np.sort((row.astype(np.uint64) << np.uint64(40)) | (value >> np.uint64(24)))
    return np.bincount((key[np.diff(key, prepend=key[:1] + np.uint64(1)) != 0] >> np.uint64(40)).astype(np.int64), minlength=n)


def _top(row: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """Count of the most frequent value of each row."""
    key = np.sort((row.astype(np.uint64) << np.uint64(40)) | (value >> np.uint64(24)))
    out = np.zeros(n, np.int64)
    if len(key):
        at = np.append(np.flatnonzero(np.diff(key, prepend=key[:1] + np.uint64(1)) != 0), len(key))
        np.maximum.at(out, (key[at[:-1]] >> np.uint64(40)).astype(np.int64), np.diff(at))
    return out


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of FEATURES for each text."""
    n, size = len(offsets) - 1, np.diff(offsets)
    w = words(data, offsets)
    row_of = np.repeat(np.arange(n), size)
    kinds = np.bincount(row_of * 12 + _KIND[w.raw], minlength=n * 12).reshape(n, 12)
    n_words = np.bincount(w.row, minlength=n)
    length = w.end - w.start
    pair = w.row[1:] == w.row[:-1]
    newline = w.raw == 10
    heads = (offsets[:-1] - offsets[0])[size > 0]
    breaks = newline.copy()
    breaks[heads] = True  # a text begins a line
    line = np.cumsum(breaks)[w.start] if len(w.start) else np.zeros(0, np.int64)
    first = np.flatnonzero(np.diff(line, prepend=-1))
    line_hash = mix(np.add.reduceat(mix(w.hash + (np.arange(len(line)) - np.repeat(first, np.diff(np.append(first, len(line))))).astype(np.uint64)), first)) if len(line) else w.hash
    lines = np.bincount(w.row[first], minlength=n)
    per = lambda x, total: x / np.maximum(1, total)
    return np.column_stack(
        [
            np.log1p(size), np.log1p(n_words), per(kinds, size[:, None]), per(np.bincount(w.row, length, n), n_words), per(np.bincount(w.row, length <= 3, n), n_words),
            per(_distinct(w.row, w.hash, n), n_words), per(_distinct(w.row[1:][pair], mix(w.hash[1:] + np.uint64(3) * w.hash[:-1])[pair], n), n_words - 1), per(_distinct(w.row[first], line_hash, n), lines), per(n_words, lines), per(_top(w.row, w.hash, n), n_words),
        ]
    ).astype(np.float32)


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = buffers(batch.column("text"))
        for a, b in chunks(offsets):
            x = statistics(data, offsets[a : b + 1])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), batch.column("label").slice(a, b - a), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float32()))], ["doc_id", "label", "x"])


class Trees(NamedTuple):
    base: float
    feature: np.ndarray  # (tree, inner node)
    threshold: np.ndarray
    leaf: np.ndarray  # (tree, leaf)

    def probability(self, x: np.ndarray) -> np.ndarray:
        """Walks all trees for all rows together."""
        trees, rows = np.arange(len(self.feature)), np.arange(len(x))[:, None]
        node = np.zeros((len(x), len(self.feature)), np.int64)
        for _ in range(DEPTH):
            node = 2 * node + 1 + (x[rows, self.feature[trees, node]] > self.threshold[trees, node])
        return 1 / (1 + np.exp(-(self.base + self.leaf[trees, node - (2**DEPTH - 1)].sum(axis=1))))


def fit(x: np.ndarray, y: np.ndarray) -> Trees:
    inner = 2**DEPTH - 1
    mean = np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3)
    base = float(np.log(mean / (1 - mean)))
    feature, threshold, leaf = np.zeros((TREES, inner), np.int64), np.full((TREES, inner), np.inf, np.float32), np.zeros((TREES, 2**DEPTH))
    if not len(y) or y.min() == y.max():
        return Trees(base, feature, threshold, leaf)
    cuts = [np.unique(np.quantile(c, np.arange(1, BINS) / BINS).astype(np.float32)) for c in x.T]
    binned = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T, strict=True)])  # v > cut k means a bin over k
    score = np.full(len(y), base)
    for t in range(TREES):
        p = 1 / (1 + np.exp(-score))
        g, h = p - y, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        for depth in range(DEPTH):
            lo, n = 2**depth - 1, 2**depth
            at = node - lo
            best, total_g, total_h = np.full(n, 1e-6), np.bincount(at, g, n), np.bincount(at, h, n)
            for f, c in enumerate(cuts):
                key = at * BINS + binned[f]
                left_g, left_h = (np.bincount(key, v, n * BINS).reshape(n, BINS).cumsum(axis=1)[:, : len(c)] for v in (g, h))
                right_g, right_h = total_g[:, None] - left_g, total_h[:, None] - left_h
                gain = left_g**2 / (left_h + RIDGE) + right_g**2 / (right_h + RIDGE) - (total_g**2 / (total_h + RIDGE))[:, None]
                gain[(left_h < MIN_CHILD / 4) | (right_h < MIN_CHILD / 4)] = 0
                k = gain.argmax(axis=1)
                won = gain[np.arange(n), k] > best
                best[won] = gain[np.arange(n), k][won]
                feature[t, lo : lo + n][won], threshold[t, lo : lo + n][won] = f, c[k[won]]
            go = x[np.arange(len(y)), feature[t, node]] > threshold[t, node]
            node = 2 * node + 1 + go
        at = node - inner
        leaf[t] = -RATE * np.bincount(at, g, 2**DEPTH) / (np.bincount(at, h, 2**DEPTH) + RIDGE)
        score += leaf[t][at]
    return Trees(base, feature, threshold, leaf)


def learn(documents: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS) -> Trees:
    """Trees from labelled documents, about train_docs of them or all if there are fewer.

    An id teaches once, by the row whose statistics have the least hash: of repeated ids no more rows reach the driver
    than there are ids. Only statistics are shuffled, after each task has kept one row an id.
    """
    known = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("double").alias("label"))
    n = max(1, known.count())
    chosen = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) * n < train_docs * (1 << 20))
    sample = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(F.broadcast(chosen.withColumn("doc_id", F.col("doc_id").cast("long"))), "doc_id").select("doc_id", "text", "label")
    described = sample.mapInArrow(_describe, "doc_id long, label double, x array<float>")
    rows = described.groupBy("doc_id").agg(F.min_by(F.struct("label", "x"), F.struct(F.xxhash64("x"), F.col("x"))).alias("row")).select("row.label", "row.x").toArrow()
    x = rows.column("x").combine_chunks().flatten().to_numpy().reshape(-1, len(FEATURES)) if rows.num_rows else np.zeros((0, len(FEATURES)), np.float32)
    y = rows.column("label").to_numpy()
    order = np.lexsort((*x.T, y))  # the same trees whatever the order of the rows
    return fit(x[order], y[order])


def _score(trees: Trees):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            for a, b in chunks(offsets):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array(trees.probability(statistics(data, offsets[a : b + 1])).astype(np.float64))], ["doc_id", "score"])

    return run


def score(documents: DataFrame, trees: Trees) -> DataFrame:
    """doc_id, score (0 to 1) of every document."""
    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_score(trees), "doc_id long, score double")


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    trees = learn(docs, labels.filter(~held_out()))
    return score(docs, trees).select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= KEEP, 1).otherwise(0).alias("predicted"))
