"""Benchmark decontamination by winnowing.

Of every 6 neighbouring 5-word hashes the least is kept, so any 10 words that a text shares with a benchmark item
share a kept hash. Kept hashes of documents are joined with those of the items, and each hit is extended to the
10-word windows around it, which are compared word by word.

Edge cases: a null or empty text has no words, hence no hit; an item without words never occurs; an item of 1 to 9
words is one window of that length and is looked up by its whole length; repeated items all count, a null item_id as
''; every row is judged by its own text, so repeated and null doc_ids do no harm and repeated rows give a row each;
a very long text is searched alone; equal fingerprints of neighbouring windows keep the last one; extra columns are
not read and are kept by keep, whatever their names; an empty table on either side gives no rows or no hits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from estate_jobs.llm.common import durable, small_enough, table
from estate_jobs.llm.tokens import PART, Words, buffers, chunks, grams, mix, whole, words

SPAN, GRAM = 10, 5
#: Benchmark bytes that each task may hold as an index; a larger benchmark is joined by shuffling fingerprints.
INDEX_BYTES = 8 << 20
SCHEMA = "doc_id long, n_words long, n_hit long, items array<string>"


def kept(hashes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions and values of the 5-word hashes that winnowing keeps: of each 10 words the least, the last of equals."""
    gram, inside = grams(hashes, GRAM), whole(rows, SPAN)
    m = len(inside)
    if not m:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    least, at = gram[:m].copy(), np.arange(m)
    for k in range(1, SPAN - GRAM + 1):
        lower = gram[k : k + m] <= least
        least[lower], at[lower] = gram[k : k + m][lower], np.flatnonzero(lower) + k
    at = at[inside]
    at = at[np.diff(at, prepend=-1) > 0]  # neighbouring windows mostly keep the same hash
    return at, gram[at]


class Index:
    """Fingerprints and windows of some benchmark items in flat arrays: about six times the bytes of their texts."""

    def __init__(self, items: list[tuple[str, str | None]]) -> None:
        data, offsets = buffers(pa.array([t for _, t in items], pa.string()))
        w = words(data, offsets)
        self.names, self.item = [name for name, _ in items], w.row.astype(np.int32)
        #: All words, a blank after each, and where each begins.
        self.said = b"".join(x + b" " for x in w.text(0, len(w.hash)))
        self.at = np.append(0, np.cumsum(w.end - w.start + 1))
        self.prints = np.unique(kept(w.hash, w.row)[1])
        #: By length: hashes of the windows, sorted, and the word that each begins with.
        self.windows: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for n, places in windows(w).items():
            value = grams(w.hash, n)[places]
            order = np.argsort(value, kind="stable")
            self.windows[n] = value[order], places[order].astype(np.int32)

    def hits(self, w: Words) -> Iterator[tuple[int, int, list[str]]]:
        """(first word, number of words, items) of each window that occurs."""
        for n in self.windows:
            if n == SPAN:
                at, value = kept(w.hash, w.row)
                starts = around(w.row, at[_among(value, self.prints)])
                value = hashes_at(w.hash, starts)
            else:
                starts = np.flatnonzero(whole(w.row, n))
                value = grams(w.hash, n)[starts]
            yield from self._same(w, starts, value, n)

    def _same(self, w: Words, starts: np.ndarray, value: np.ndarray, n: int) -> Iterator[tuple[int, int, list[str]]]:
        known, places = self.windows[n]
        first, last = np.searchsorted(known, value, "left"), np.searchsorted(known, value, "right")
        for k in np.flatnonzero(last > first).tolist():
            i = int(starts[k])
            said = b"".join(x + b" " for x in w.text(i, i + n))
            names = [self.names[self.item[p]] for p in places[first[k] : last[k]].tolist() if self.said[self.at[p] : self.at[p + n]] == said]
            if names:
                yield i, n, names


def windows(w: Words) -> dict[int, np.ndarray]:
    """First words of the windows by their length: SPAN words, or a whole row of fewer."""
    size = np.bincount(w.row, minlength=int(w.row[-1]) + 1 if len(w.row) else 0)
    out = {SPAN: np.flatnonzero(whole(w.row, SPAN))}
    for n in range(1, SPAN):
        there = whole(w.row, n)
        out[n] = np.flatnonzero(there & (size[w.row[: len(there)]] == n))
    return {n: places for n, places in out.items() if len(places)}


def around(rows: np.ndarray, at: np.ndarray) -> np.ndarray:
    """First words of the windows of SPAN words that hold a 5-word run which begins at one of `at`: the hits, extended."""
    inside = whole(rows, SPAN)
    starts = np.unique((at[:, None] - np.arange(SPAN - GRAM + 1)).ravel())
    starts = starts[(starts >= 0) & (starts < len(inside))]
    return starts[inside[starts]]


def hashes_at(hashes: np.ndarray, starts: np.ndarray, n: int = SPAN) -> np.ndarray:
    """Hashes of the n words from each start."""
    return grams(hashes[starts[:, None] + np.arange(n)].ravel(), n)[::n] if len(starts) else np.zeros(0, np.uint64)


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def _found(index: Index, column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, list[list[str]]]]:
    """First and last row (exclusive), words, hit words and items of the texts, part by part."""
    data, offsets = buffers(column)
    for a, b in chunks(offsets, PART):
        w = words(data, offsets[a : b + 1])
        hit, items = np.zeros(len(w.hash), bool), [set() for _ in range(b - a)]
        for i, n, names in index.hits(w):
            hit[i : i + n] = True
            items[w.row[i]].update(names)
        yield a, b, np.bincount(w.row, minlength=b - a).astype(np.int64), np.bincount(w.row[hit], minlength=b - a).astype(np.int64), [sorted(x) for x in items]


def _scan(index: Index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, n_words, n_hit, items in _found(index, batch.column("text")):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array(n_words), pa.array(n_hit), pa.array(items, pa.list_(pa.string()))], ["doc_id", "n_words", "n_hit", "items"])

    return run


def _keep(index: Index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, _, n_hit, _ in _found(index, batch.column("text")):
                yield batch.slice(a, b - a).filter(pa.array(n_hit == 0))

    return run


def _prints(key: str, lengths: tuple[int, ...]):
    """(key, fingerprint) of each kept hash; of documents also each run of so many words, of a short item its whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            for a, b in chunks(offsets, PART):
                w = words(data, offsets[a : b + 1])
                at, value = kept(w.hash, w.row)
                size = np.bincount(w.row, minlength=b - a)
                own = batch.column(key).slice(a, b - a)
                for n in lengths:
                    there = whole(w.row, n)
                    if key == "item_id":
                        there &= size[w.row[: len(there)]] == n
                    at, value = np.concatenate([at, np.flatnonzero(there)]), np.concatenate([value, grams(w.hash, n)[there]])
                yield pa.RecordBatch.from_arrays([own.take(pa.array(w.row[at])), pa.array(value.view(np.int64))], [key, "print"])

    return run


def _span_rows(names: list[str], owners: pa.Array, w: Words, starts: np.ndarray, n: int) -> pa.RecordBatch:
    """A row for each window: its owner, first word, length and two hashes, 128 bits together."""
    a, b = hashes_at(w.hash, starts, n), hashes_at(mix(w.hash + np.uint64(SPAN)), starts, n)
    return pa.RecordBatch.from_arrays([owners.take(pa.array(w.row[starts])), pa.array(starts - np.searchsorted(w.row, w.row[starts])), pa.array(np.full(len(starts), n, np.int32)), pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names)


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The windows of items."""
    for batch in batches:
        data, offsets = buffers(batch.column("text"))
        for a, b in chunks(offsets, PART):
            w = words(data, offsets[a : b + 1])
            for n, places in windows(w).items():
                yield _span_rows(["item_id", "start", "n", "span_a", "span_b"], batch.column("item_id").slice(a, b - a), w, places, n)


def _places(lengths: tuple[int, ...]):
    """The windows of texts around their shared fingerprints (column prints), and their runs of the lengths of short items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            for k in range(len(batch)):
                w = words(data, offsets[k : k + 2])
                shared = np.sort(np.asarray(batch.column("prints")[k].values, np.int64).view(np.uint64))
                at, value = kept(w.hash, w.row)
                names, owner = ["key", "start", "n", "span_a", "span_b"], batch.column("key").slice(k, 1)
                yield _span_rows(names, owner, w, around(w.row, at[_among(value, shared)]), SPAN)
                for n in lengths:
                    value = grams(w.hash, n)
                    yield _span_rows(names, owner, w, np.flatnonzero(_among(value, shared)), n)

    return run


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.col("text").cast("string"))


def _index(items: DataFrame, index_bytes: int) -> Index | None:
    """Index of all items if they have at most index_bytes."""
    size = items.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + F.octet_length("item_id"))).first()[0] or 0
    return Index([(r.item_id, r.text) for r in items.collect()]) if size <= index_bytes else None


def _key(text: Column) -> Column:
    """What a text's hits are joined back by: rows of equal texts have equal hits, whatever their ids; null for a null text."""
    return F.unhex(F.sha2(text.cast("string").cast("binary"), 256))


def _joined(texts: DataFrame, items: DataFrame) -> DataFrame:
    """key, items, n_hit of the texts (key, text) that hold a window, by shuffled fingerprints.

    Fingerprints find the texts that may hold a window and where; only the windows there, as hashes, meet those of the
    items, so neither text is ever sent to the other.
    """
    size = F.regexp_count("text", F.lit(r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"))
    lengths = tuple(r.n for r in items.select(size.alias("n")).filter(f"n between 1 and {SPAN - 1}").distinct().collect())
    items = items.distinct()
    prints = items.mapInArrow(_prints("item_id", lengths), "item_id string, print long").select("print").distinct()
    shared = durable(texts.mapInArrow(_prints("key", lengths), "key binary, print long").join(small_enough(prints), "print", "left_semi").groupBy("key").agg(F.collect_set("print").alias("prints")))
    some = texts.join(small_enough(shared.select("key")), "key", "left_semi").join(shared, "key").select("key", "text", "prints")
    places = some.mapInArrow(_places(lengths), "key binary, start long, n int, span_a long, span_b long").distinct()
    spans = items.mapInArrow(_windows, "item_id string, start long, n int, span_a long, span_b long").select("item_id", "n", "span_a", "span_b").distinct()
    hits = durable(places.join(spans, ["n", "span_a", "span_b"]).select("key", "start", "n", "item_id"))
    names = hits.groupBy("key").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    hit = hits.select("key", F.explode(F.sequence("start", F.col("start") + F.col("n") - 1)).alias("word"))
    return names.join(hit.groupBy("key").agg(F.countDistinct("word").alias("n_hit")), "key")


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, n_words, _, _ in _found(Index([]), batch.column("text")):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), batch.column("key").slice(a, b - a), pa.array(n_words)], ["doc_id", "key", "n_words"])


def keep(documents: DataFrame, benchmark: DataFrame, index_bytes: int = INDEX_BYTES) -> DataFrame:
    """The rows of documents in which no window of an item occurs."""
    items = _items(benchmark)
    if (index := _index(items, index_bytes)) is not None:
        return documents.mapInArrow(_keep(index), documents.schema)
    texts = documents.select(_key(F.col("text")).alias("key"), F.col("text").cast("string")).filter("key IS NOT NULL")
    hit = small_enough(_joined(texts, items).select(F.col("key").alias("hit_key")))
    return documents.join(hit, _key(documents["text"]) == hit["hit_key"], "left_anti")


def find_benchmark(documents: DataFrame, benchmark: DataFrame, index_bytes: int = INDEX_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, items (ids of the benchmark items that occur, sorted as strings) of every document.

    A benchmark of at most index_bytes is indexed in each task, so documents need no shuffle; a larger one is joined
    by fingerprint. Either way every row is judged by its own text, also where doc_id is null or repeated.
    """
    docs, items = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), _items(benchmark)
    if (index := _index(items, index_bytes)) is not None:
        return docs.mapInArrow(_scan(index), SCHEMA)
    keyed = docs.withColumn("key", _key(F.col("text")))
    far = _joined(keyed.select("key", "text").filter("key IS NOT NULL"), items)
    counts = keyed.mapInArrow(_sizes, "doc_id long, key binary, n_words long")
    return counts.join(far, "key", "left").select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_benchmark(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


_SQL_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP10_SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS doc, doc_id, coalesce({_SQL_WORDS}, []) AS w FROM documents),
items AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item_id, w, least({SPAN}, len(w)) AS n FROM (SELECT item_id, {_SQL_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
windows AS (SELECT DISTINCT item_id, n, array_to_string(w[k:k + n - 1], ' ') AS said FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS k FROM items)),
places AS (SELECT doc, n, k, array_to_string(w[k:k + n - 1], ' ') AS said FROM (
  SELECT doc, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM docs, (SELECT DISTINCT n FROM items))),
hits AS (SELECT doc, k, n, item_id FROM places JOIN windows USING (n, said)),
hit_words AS (SELECT doc, count(DISTINCT word) AS n_hit FROM (SELECT doc, unnest(range(k, k + n)) AS word FROM hits) GROUP BY doc),
hit_items AS (SELECT doc, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS names FROM hits GROUP BY doc)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit_words USING (doc) LEFT JOIN hit_items USING (doc)
"""
