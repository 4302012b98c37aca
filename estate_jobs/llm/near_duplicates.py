"""N-gram Jaccard join with Bayesian candidate pruning.

Texts become sets of hashed 5-word shingles. Texts with equal sets form a class, stood for by its first row.
Class representatives that share an LSH bucket (5 of 160 MinHash values) are candidates. Their MinHash values are
compared 32 at a time; with a uniform prior on the similarity, a pair goes as soon as the posterior probability that
it reaches the threshold is below the tolerance. Pairs that stay are compared exactly.

Buckets and groups are cut into blocks of a bounded number of texts, and pairs of blocks are compared in memory:
what leaves a task is a count for each text and a spanning forest, never the pairs, so a group of n near copies gives
rows in proportion to n. Connected components of the exact links are the groups.

Edge cases: a text of 1 to 4 words is one shingle; a text without words (null, empty, marks only) has no shingle and
no link and is a class of its own; rows are told apart by id and text, so repeated doc_ids and null ones are documents
like others, and a group is named by the least id in it; repeated rows are copies of each other; ties of ids are broken
by a hash of the text; a very long text is described alone and compared in a block of its own; extra columns, whatever
their names, are not read and are kept by keep_first; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from estate_jobs.llm.common import durable, small_enough, table
from estate_jobs.llm.tokens import PART, buffers, chunks, grams, mix, whole, words

SHINGLE, THRESHOLD, TOLERANCE = 5, 0.8, 1e-6
BANDS, ROWS = 32, 5
HASHES, STEP = BANDS * ROWS, 32
#: Texts and bytes that a block holds at most, about.
BLOCK_TEXTS, BLOCK_BYTES = 256, 8 << 20
#: What tells a row from all that aren't its repeats.
ROW = ("doc_id", "text_a", "text_b")
_A = (mix(np.arange(1, HASHES + 1, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_B = (mix(np.arange(1, HASHES + 1, dtype=np.uint64) + np.uint64(1 << 20)) >> np.uint64(32)).astype(np.uint32)


def shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes and their rows, ordered by row and hash."""
    w = words(data, offsets)
    size = np.bincount(w.row, minlength=len(offsets) - 1)
    at = np.flatnonzero(whole(w.row, SHINGLE))
    value, row = grams(w.hash, SHINGLE)[at], w.row[at]
    for n in range(1, SHINGLE):
        few = np.flatnonzero(whole(w.row, n) & (size[w.row[: max(0, len(w.row) - n + 1)]] == n))
        value, row = np.concatenate([value, grams(w.hash, n)[few] + np.uint64(n)]), np.concatenate([row, w.row[few]])
    order = np.lexsort((value, row))
    value, row = value[order], row[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (row[1:] != row[:-1])
    return value[new], row[new]


def shingles_of(texts: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The same of a column, part by part: words take some hundred bytes of arrays for each ten bytes of text."""
    data, offsets = buffers(texts)
    parts = [(np.zeros(0, np.uint64), np.zeros(0, np.int64))]
    for a, b in chunks(offsets, PART):
        value, row = shingles(data, offsets[a : b + 1])
        parts.append((value, row + a))
    return np.concatenate([v for v, _ in parts]), np.concatenate([r for _, r in parts])


def signatures(value: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """160 MinHash values of each set, 16 bits each; sets begin at starts and none is empty."""
    out = np.empty((len(starts), HASHES), np.uint16)
    if not len(starts):
        return out
    x = (value >> np.uint64(32)).astype(np.uint32)
    edges, first = [*range(0, len(starts), 64), len(starts)], np.append(starts, len(x))
    for a, b in zip(edges, edges[1:], strict=False):  # parts that stay in the processor's cache
        part, at = x[first[a] : first[b]], first[a:b] - first[a]
        y = np.empty_like(part)
        for k in range(HASHES):
            np.multiply(part, _A[k], out=y)
            np.add(y, _B[k], out=y)
            out[a:b, k] = np.minimum.reduceat(y, at).astype(np.uint16)
    return out


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = buffers(batch.column("text"))
        for a, b in chunks(offsets, PART):
            value, row = shingles(data, offsets[a : b + 1])
            full, starts, n = np.unique(row, return_index=True, return_counts=True)
            key = np.zeros((b - a, 2), np.int64)
            if len(full):
                key[full, 0] = np.add.reduceat(mix(value), starts).view(np.int64)
                key[full, 1] = np.bitwise_xor.reduceat(mix(value + np.uint64(7)), starts).view(np.int64)
            sig = np.full(b - a, None, object)
            for k, s in zip(full.tolist(), signatures(value, starts), strict=True):
                sig[k] = s.tobytes()
            size = np.zeros(b - a, np.int64)
            size[full] = n
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).slice(a, b - a) for c in ROW), pa.array(key[:, 0]), pa.array(key[:, 1]), pa.array(size), pa.array(np.diff(offsets[a : b + 1])), pa.array(sig.tolist(), pa.binary())],
                [*ROW, "key_a", "key_b", "n_shingles", "n_bytes", "sig"],
            )


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each representative and band: hash of the band's values."""
    for batch in batches:
        if len(batch):
            sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint16).reshape(-1, BANDS, ROWS).astype(np.uint64)
            key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), sig.shape[:2])
            for k in range(ROWS):
                key = mix(key + (sig[:, :, k] << np.uint64(8)) + np.uint64(k))
            yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), batch.column("id").take(pa.array(np.repeat(np.arange(len(batch)), BANDS)))], ["bucket", "id"])


def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> list[int]:
    """For 32, 64, ... compared values: the least number of equal ones at which a pair stays."""
    s = (np.arange(2000) + 0.5) / 2000
    out = []
    for n in range(STEP, HASHES + 1, STEP):
        for m in range(n + 1):
            log = m * np.log(s) + (n - m) * np.log1p(-s)
            p = np.exp(log - log.max())
            if p[s >= threshold].sum() / p.sum() >= tolerance:
                out.append(m)
                break
    return out


def _pairs(t: pa.Table, keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows i < j of one key: of the same block if the key pairs a block with itself, else of different ones."""
    n = len(t)
    new = np.ones(n, bool)
    new[1:] = np.any([(c := t.column(k).to_numpy())[1:] != c[:-1] for k in keys], axis=0)
    heads = np.flatnonzero(new)
    end = np.repeat(np.append(heads[1:], n), np.diff(np.append(heads, n)))
    count = end - np.arange(n) - 1
    i = np.repeat(np.arange(n), count)
    j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(count) - count, count)
    side, own = t.column("side").to_numpy(), t.column("one").to_numpy() == t.column("two").to_numpy()
    wanted = own[i] | (side[i] != side[j])
    return i[wanted], j[wanted]


def _survivors(sig: np.ndarray, i: np.ndarray, j: np.ndarray, least: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of signatures that Bayesian pruning keeps."""
    match = np.zeros(len(i), np.int32)
    for step, m in enumerate(least):
        part = np.ascontiguousarray(sig[:, step * STEP : (step + 1) * STEP])
        for k in range(0, len(i), 1 << 15):
            match[k : k + (1 << 15)] += (part[i[k : k + (1 << 15)]] == part[j[k : k + (1 << 15)]]).sum(1, dtype=np.int32)
        stay = match >= m
        i, j, match = i[stay], j[stay], match[stay]
    return i, j


class Forest:
    """Spanning forest of the links seen so far."""

    def __init__(self, n: int) -> None:
        self.up, self.edges = list(range(n)), []

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def link(self, a: int, b: int) -> None:
        x, y = self.root(a), self.root(b)
        if x != y:
            self.up[x] = y
            self.edges.append((a, b))


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str], size: str | None = None) -> Iterator[pa.Table]:
    """Tables of whole keys, from a partition sorted by keys; of about BLOCK_BYTES by the column `size`, if given.

    The rows of a key are a pair of blocks, which bounds what is held.
    """
    rest: pa.Table | None = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        rest = pa.concat_tables([rest, t]).combine_chunks() if rest is not None else t
        cols = [rest.column(k).to_numpy() for k in keys]
        edges = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1
        if size is not None and len(edges):
            part = np.cumsum(rest.column(size).to_numpy())[edges - 1] // BLOCK_BYTES
            edges = edges[np.append(part[1:] != part[:-1], True)]
        first = 0
        for edge in edges.tolist() if size is not None else edges[-1:].tolist():
            yield rest.slice(first, edge - first)
            first = edge
        rest = rest.slice(first)
    if rest is not None and len(rest):
        yield rest.combine_chunks()


def _candidates(least: list[int]):
    """Spanning forest of the pairs that stay, for each pair of blocks of a bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = ["bucket", "one", "two"]
        for t in _groups(batches, keys):
            sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint16).reshape(-1, HASHES)
            i, j = _survivors(sig, *_pairs(t, keys), least)
            ids, forest = t.column("id").to_numpy(), Forest(len(t))
            for x, y in zip(i.tolist(), j.tolist(), strict=True):
                forest.link(x, y)
            e = np.unique(np.sort(ids[np.array(forest.edges, np.int64).reshape(-1, 2)], axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(e[:, 0]), pa.array(e[:, 1])], ["a", "b"])

    return run


def _common(value: np.ndarray, starts: np.ndarray, sizes: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the sets i and j, one pair at a time."""
    own = lambda k: value[starts[k] : starts[k] + sizes[k]]
    return np.fromiter((len(np.intersect1d(own(a), own(b), assume_unique=True)) for a, b in zip(i.tolist(), j.tolist(), strict=True)), np.int64, len(i))


def _dense(value: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of all sets of a block pair, as products of 0/1 matrices over slices of the shingles."""
    code = np.unique(value, return_inverse=True)[1]
    row = np.repeat(np.arange(len(sizes)), sizes)
    order = np.argsort(code, kind="stable")
    code, row = code[order], row[order]
    out, width = np.zeros((len(sizes), len(sizes)), np.float32), 4096
    for lo in range(0, int(code[-1]) + 1, width):
        a, b = np.searchsorted(code, [lo, lo + width])
        m = np.zeros((len(sizes), width), np.float32)
        m[row[a:b], code[a:b] - lo] = 1
        out += m @ m.T
    return out.astype(np.int64)


def _links(threshold: float, least: list[int]):
    """Exact links within each pair of blocks: rows ("n", id, links, linked documents) and ("e", id, id, 0)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = ["grp", "one", "two"]
        for t in _groups(batches, keys, "n_bytes"):
            value, row = shingles_of(t.column("text"))
            _, starts, sizes = np.unique(row, return_index=True, return_counts=True)
            i, j = _survivors(signatures(value, starts), *_pairs(t, keys), least)
            group = np.cumsum(np.append(0, np.any([(c := t.column(k).to_numpy())[1:] != c[:-1] for k in keys], axis=0)))
            shared, edges = np.zeros(len(i), np.int64), np.flatnonzero(np.diff(group[i], prepend=-1, append=-1)) if len(i) else []
            for a, b in zip(edges, edges[1:], strict=False):
                lo, hi = np.searchsorted(group, [group[i[a]], group[i[a]] + 1])
                if b - a > 16 * (hi - lo):
                    end = starts[hi] if hi < len(starts) else len(value)
                    shared[a:b] = _dense(value[starts[lo] : end], sizes[lo:hi])[i[a:b] - lo, j[a:b] - lo]
                else:
                    shared[a:b] = _common(value, starts, sizes, i[a:b], j[a:b])
            # similarity >= threshold, without a division
            near = shared >= threshold * (sizes[i] + sizes[j] - shared) - 1e-9
            i, j, forest = i[near], j[near], Forest(len(t))
            for x, y in zip(i.tolist(), j.tolist(), strict=True):
                forest.link(x, y)
            ids, copies = t.column("id").to_numpy(), t.column("copies").to_numpy()
            n = np.bincount(i, minlength=len(t)) + np.bincount(j, minlength=len(t))
            docs = np.bincount(i, copies[j], len(t)) + np.bincount(j, copies[i], len(t))
            has, e = np.flatnonzero(n), np.array(forest.edges, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [pa.array(["n"] * len(has) + ["e"] * len(e), pa.string()), pa.array(np.concatenate([ids[has], ids[e[:, 0]]])), pa.array(np.concatenate([n[has], ids[e[:, 1]]])), pa.array(np.concatenate([docs[has].astype(np.int64), np.zeros(len(e), np.int64)]))],
                ["kind", "id", "other", "docs"],
            )

    return run


def in_blocks(rows: DataFrame, key: str, sizes: DataFrame) -> DataFrame:
    """rows with side, one, two: a row goes to each pair of blocks of its key that holds its own block.

    sizes has key and n_blocks. The block is a hash of the id, so a key with n blocks sends each row n times.
    """
    blocked = rows.join(sizes, key).withColumn("side", F.pmod(F.xxhash64("id", F.lit(3)), F.col("n_blocks")).cast("int"))
    pair = F.explode(F.transform(F.sequence(F.lit(0), (F.col("n_blocks") - 1).cast("int")), lambda x: F.struct(F.least(x, F.col("side")).alias("one"), F.greatest(x, F.col("side")).alias("two"))))
    return blocked.withColumn("pair", pair).select(*rows.columns, "side", "pair.one", "pair.two")


def components(edges: DataFrame) -> DataFrame:
    """id, root of every node of the edges (a, b): root is the least id of its component.

    Large-star and small-star in turn: each round hangs neighbours below their least neighbour, with partial
    minima, until nothing changes. The number of rounds grows with the logarithm of the component's size.
    """
    pairs = durable(edges.filter("a <> b").distinct())
    before = None
    while True:
        both = pairs.union(pairs.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        pairs = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        down = pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        joined = down.join(least, "a")
        pairs = durable(joined.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))).distinct())
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if now == before:
            roots = pairs.select(F.col("b").alias("id")).distinct()
            return pairs.select(F.col("a").alias("id"), F.col("b").alias("root")).union(roots.select("id", F.col("id").alias("root")))
        before = now


def _keys(text: Column) -> list[Column]:
    """Two hashes of a text, 128 bits together; with the doc_id they tell a row from all that aren't its repeats."""
    return [F.xxhash64(text).alias("text_a"), F.xxhash64(F.lit(1), text).alias("text_b")]


def near_duplicates(documents: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """doc_id, class_id, copy_id, n_links, n_text_links of every document.

    class_id: least doc_id of the group of documents joined by links, directly or through others; copy_id: least
    doc_id of the documents with the same shingles (both null where no document of them has an id); n_links: other
    documents of similarity `threshold` or more, its copies included; n_text_links: those with other shingles, copies
    counted once.
    """
    rows = _grouped(documents, threshold, tolerance)
    return rows.select("doc_id", F.when(F.col("n_shingles") > 0, F.col("first.doc_id")).otherwise(F.col("doc_id")).alias("class_id"), F.when(F.col("n_shingles") > 0, F.col("copy.doc_id")).otherwise(F.col("doc_id")).alias("copy_id"), "n_links", "n_text_links")


def keep_first(documents: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """The rows of documents less all but the first of each group of near duplicates; texts without words stay.

    First is the row with the least doc_id (null ids last), of equal ids the one with the least hash of its text. Rows
    are told apart by id and text, so ids that repeat or are null lose nothing. Of a first row that repeats, id and
    text, one is left, that with the least hash of its columns.
    """
    rows = durable(_grouped(documents, threshold, tolerance).filter("n_shingles > 0").select(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_a", "text_b").alias("own"), "first"))
    text = documents["text"].cast("string")
    key = [documents["doc_id"].cast("long"), *_keys(text)]

    def those(kind: str, some: DataFrame) -> DataFrame:
        """documents whose row key is (left_semi) or isn't (left_anti) in some."""
        right = small_enough(some.select("own.doc_id", "own.text_a", "own.text_b").distinct())
        return documents.join(right, reduce(Column.__and__, (a.eqNullSafe(right[b]) for a, b in zip(key, right.columns, strict=True))), kind)

    kept = those("left_anti", rows.filter("own <> first"))
    again = durable(rows.filter("own = first").groupBy("own").count().filter("count > 1"))
    if again.isEmpty():
        return kept
    hashed = F.xxhash64(*(c for c, kind in documents.dtypes if not kind.startswith("map")))
    one = those("left_semi", again).groupBy(*(c.alias(f"key_{k}") for k, c in enumerate(key))).agg(F.min_by(F.struct("*"), hashed).alias("row"))
    return those("left_anti", rows.filter("own <> first").select("own").union(again.select("own"))).union(one.select("row.*"))


def _grouped(documents: DataFrame, threshold: float, tolerance: float) -> DataFrame:
    """doc_id, text_a, text_b, n_shingles, first, copy (keys of the group's and of the class's first row), n_links, n_text_links."""
    docs = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), *_keys(F.col("text").cast("string")))
    least = least_matches(threshold, tolerance)
    described = durable(docs.mapInArrow(_describe, "doc_id long, text_a long, text_b long, key_a long, key_b long, n_shingles long, n_bytes long, sig binary"))
    # a class's id is its number in the table, written once; its copy is the key of its first row, null ids last
    copy = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_a", "text_b")
    found = described.filter("n_shingles > 0").groupBy("key_a", "key_b", "n_shingles").agg(F.min(copy).alias("copy"), F.count("*").alias("copies"), F.max("n_bytes").alias("n_bytes"), F.min("sig").alias("sig"))
    classes = durable(found.withColumn("id", F.monotonically_increasing_id()))

    bands = classes.select("id", "sig").mapInArrow(_bands, "bucket long, id long")
    sizes = bands.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1").select("bucket", F.ceil(F.col("n") / BLOCK_TEXTS).alias("n_blocks"))
    members = in_blocks(bands, "bucket", sizes).join(classes.select("id", "sig"), "id")
    spread = members.repartition("bucket", "one", "two").sortWithinPartitions("bucket", "one", "two")
    candidates = components(spread.mapInArrow(_candidates(least), "a long, b long"))

    grouped = candidates.withColumnRenamed("root", "grp").join(classes.select("id", "copies", "n_bytes"), "id")
    sizes = grouped.groupBy("grp").agg(F.greatest(F.ceil(F.count("*") / BLOCK_TEXTS), F.ceil(F.sum("n_bytes") / BLOCK_BYTES)).alias("n_blocks"))
    wanted = small_enough(candidates.select("id").join(classes.select("id", "copy"), "id").selectExpr("id", "copy.doc_id AS copy_id", "copy.text_a AS copy_a", "copy.text_b AS copy_b"))
    texts = docs.join(wanted, F.col("doc_id").eqNullSafe(F.col("copy_id")) & (F.col("text_a") == F.col("copy_a")) & (F.col("text_b") == F.col("copy_b"))).groupBy("id").agg(F.min("text").alias("text"))
    blocks = in_blocks(grouped, "grp", sizes).join(texts, "id")
    spread = blocks.repartition("grp", "one", "two").sortWithinPartitions("grp", "one", "two")
    links = durable(spread.mapInArrow(_links(threshold, least), "kind string, id long, other long, docs long"))

    count = links.filter("kind = 'n'").groupBy("id").agg(F.sum("other").alias("n_text_links"), F.sum("docs").alias("docs"))
    roots = components(links.filter("kind = 'e'").select(F.col("id").alias("a"), F.col("other").alias("b")))
    firsts = roots.join(classes.select("id", "copy"), "id").groupBy("root").agg(F.min("copy").alias("first"))
    known = classes.select("key_a", "key_b", "n_shingles", "id", "copies", "copy").join(count, "id", "left").join(roots.join(firsts, "root").select("id", "first"), "id", "left")
    out = described.select("doc_id", "text_a", "text_b", "key_a", "key_b", "n_shingles").join(known, ["key_a", "key_b", "n_shingles"], "left")
    return out.select(
        "doc_id", "text_a", "text_b", "n_shingles", F.coalesce("first", "copy").alias("first"), "copy",
        F.when(F.col("n_shingles") > 0, F.coalesce("docs", F.lit(0)) + F.col("copies") - 1).otherwise(0).alias("n_links"), F.coalesce("n_text_links", F.lit(0)).alias("n_text_links"),
    )


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
