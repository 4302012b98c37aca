"""MinHash near-dedup with sequential Bayesian verification.

A document is its set of 3-word shingles. Documents of equal sets are one class. Classes that share a band (5 of 160
MinHash values) are candidates. Their signatures are compared in batches of 32 values; after each, a pair is dropped
when the posterior probability that its similarity reaches the threshold, given the matches so far, is below the chosen
miss probability. What survives is verified on the full sets, taken from the texts.

Only connectivity is asked for, so a group isn't compared in all pairs. Bands and groups of candidates are cut into
blocks of a bounded size. First each block is compared within itself and with one hub that all blocks of the group get;
then only what isn't in the group's largest component so far meets the other blocks. Within a block, the best matches
are verified first, and pairs that are joined already are skipped. A group of n near copies with one centre so costs
about n verifications, and nothing that isn't linked to the centre is lost.

Edge cases: words are runs of characters other than blanks, tabs and line ends, A-Z as a-z; a text of one or two words
is one shingle; a null text, or one without words, has the empty set, is linked with nothing and is its own component;
rows are documents, whatever their ids: rows of equal texts are one class; a component is named by the least id in it,
null where it has none; a row of a null id is kept only if its component has no id; rows that repeat the least id are
all kept; ties of signatures or of ids don't matter to the result; a very long text is described whole, alone; extra
columns, whatever their names, are not read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from estate_jobs.llm.common import durable, kept, small_enough, table
from estate_jobs.llm.near_duplicates import BLOCK_BYTES, BLOCK_TEXTS, HASHES, STEP, Forest, _bands, _common, _dense, _groups, _pairs, least_matches, signatures
from estate_jobs.llm.tokens import LOWER, buffers, chunks, grams, mix, whole

SHINGLE, PERCENT, MISS = 3, 85, 1e-6
_BLANK = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_VALUE = mix(LOWER.astype(np.uint64) + np.uint64(1))
_ODD = np.uint64(0x9E3779B97F4A7C15)
#: One bucket in so many is compared first; near copies share most of their 32.
EARLY = 4
#: Pairs of signatures that are compared at once.
AT_ONCE = 1 << 15


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of each word of the rows that offsets delimits."""
    raw, at = data[offsets[0] : offsets[-1]], offsets - offsets[0]
    inside = ~_BLANK[raw]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    heads = at[:-1][at[1:] > at[:-1]]
    first[heads] = inside[heads]
    start, used = np.flatnonzero(first), np.flatnonzero(inside)
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    begin = np.searchsorted(used, start)
    place = np.arange(len(used)) - np.repeat(begin, np.diff(np.append(begin, len(used))))
    powers = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(int(place.max()), _ODD, np.uint64)]))
    return mix(np.add.reduceat(_VALUE[raw[used]] * powers[place], begin)), np.searchsorted(at, start, side="right") - 1


def shingles(data: np.ndarray, offsets: np.ndarray, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes and their rows, ordered by row and hash; a row of fewer words has one shingle of them all."""
    word, of = words(data, offsets)
    size = np.bincount(of, minlength=len(offsets) - 1)
    at = np.flatnonzero(whole(of, n))
    value, row = [grams(word, n)[at]], [of[at]]
    for m in range(1, n):
        few = np.flatnonzero(whole(of, m) & (size[of[: max(0, len(of) - m + 1)]] == m))
        value.append(grams(word, m)[few] + np.uint64(m))
        row.append(of[few])
    value, row = np.concatenate(value), np.concatenate(row)
    order = np.lexsort((value, row))
    value, row = value[order], row[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (row[1:] != row[:-1])
    return value[new], row[new]


def _describe(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            for a, b in chunks(offsets):
                value, row = shingles(data, offsets[a : b + 1], n)
                full, starts, size = np.unique(row, return_index=True, return_counts=True)
                key, sizes, sig = np.zeros((b - a, 2), np.int64), np.zeros(b - a, np.int64), np.full(b - a, None, object)
                if len(full):
                    key[full, 0] = np.add.reduceat(mix(value), starts).view(np.int64)
                    key[full, 1] = np.bitwise_xor.reduceat(mix(value + np.uint64(7)), starts).view(np.int64)
                    sizes[full] = size
                    sig[full] = [s.tobytes() for s in signatures(value, starts)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("row").slice(a, b - a), batch.column("doc_id").slice(a, b - a), pa.array(key[:, 0]), pa.array(key[:, 1]), pa.array(sizes), pa.array(np.diff(offsets[a : b + 1])), pa.array(sig.tolist(), pa.binary())],
                    ["row", "doc_id", "key_a", "key_b", "n_shingles", "n_bytes", "sig"],
                )

    return run


def _matches(sig: np.ndarray, i: np.ndarray, j: np.ndarray, least: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pairs that sequential pruning keeps, with their matches. After each batch of values the hopeless ones go."""
    kept_i, kept_j, kept_m = [], [], []
    for k in range(0, len(i), AT_ONCE):
        a, b = i[k : k + AT_ONCE], j[k : k + AT_ONCE]
        match = np.zeros(len(a), np.int32)
        for step, m in enumerate(least):
            part = sig[:, step * STEP : (step + 1) * STEP]
            match += (part[a] == part[b]).sum(1, dtype=np.int32)
            stay = match >= m
            a, b, match = a[stay], b[stay], match[stay]
        kept_i.append(a)
        kept_j.append(b)
        kept_m.append(match)
    none = np.zeros(0, np.int64)
    return tuple(np.concatenate(x) if x else none for x in (kept_i, kept_j, kept_m))


def _apart(t: pa.Table, keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a table's rows that are to be compared: of one key, of blocks that it pairs, not joined yet."""
    i, j = _pairs(t, keys)
    label = t.column("label").to_numpy()
    wanted = label[i] != label[j]
    return i[wanted], j[wanted]


def _signatures_of(t: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint16).reshape(-1, HASHES)


def _edges(t: pa.Table, forest: Forest) -> pa.RecordBatch:
    """Each id that is joined with others, below the least of them."""
    ids, linked = t.column("id").to_numpy(), np.unique(np.array(forest.edges, np.int64))
    root = np.array([forest.root(k) for k in linked.tolist()], np.int64)
    order = np.lexsort((ids[linked], root))
    head = np.flatnonzero(np.diff(root[order], prepend=-1))
    least = np.repeat(ids[linked][order][head], np.diff(np.append(head, len(order))))
    e = np.unique(np.column_stack([least, ids[linked][order]]), axis=0)
    e = e[e[:, 0] != e[:, 1]]
    return pa.RecordBatch.from_arrays([pa.array(e[:, 0]), pa.array(e[:, 1])], ["a", "b"])


def _alike_by_signature(keys: list[str], least: list[int]):
    """Spanning forest of the pairs of signatures that stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches, keys):
            i, j, _ = _matches(_signatures_of(t), *_apart(t, keys), least)
            forest = Forest(len(t))
            for x, y in zip(i.tolist(), j.tolist(), strict=True):
                forest.link(x, y)
            yield _edges(t, forest)

    return run


def connect(forest: Forest, i: np.ndarray, j: np.ndarray, match: np.ndarray, value: np.ndarray, starts: np.ndarray, sizes: np.ndarray, percent: int) -> int:
    """Joins sets by exactly verified pairs, best matches first; pairs that are joined by others are skipped.

    Returns the number of pairs looked at. Where most of a block's pairs fail, all its intersections come at once, as a
    product of matrices.
    """
    order, looked, shared = np.argsort(-match, kind="stable"), 0, None
    for x, y in zip(i[order].tolist(), j[order].tolist(), strict=True):
        if forest.root(x) == forest.root(y):
            continue
        if shared is None and looked > 16 * len(sizes):
            shared = _dense(value, sizes)
        n = int(shared[x, y]) if shared is not None else int(_common(value, starts, sizes, np.array([x]), np.array([y]))[0])
        looked += 1
        if 100 * n >= percent * (int(sizes[x]) + int(sizes[y]) - n):
            forest.link(x, y)
    return looked


def _alike_by_text(keys: list[str], least: list[int], n: int, percent: int):
    """Spanning forest of the exactly verified pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches, keys, "n_bytes"):
            value, row = shingles(*buffers(t.column("text")), n)
            _, starts, sizes = np.unique(row, return_index=True, return_counts=True)
            i, j, match = _matches(_signatures_of(t), *_apart(t, keys), least)
            group = np.cumsum(np.append(0, np.any([(c := t.column(k).to_numpy())[1:] != c[:-1] for k in keys], axis=0)))
            forest = Forest(len(t))
            for g in np.unique(group[i]).tolist():
                lo, hi = np.searchsorted(group, [g, g + 1])
                own = group[i] == g
                end = starts[hi] if hi < len(starts) else len(value)
                part = Forest(hi - lo)
                connect(part, i[own] - lo, j[own] - lo, match[own], value[starts[lo] : end], starts[lo:hi] - starts[lo], sizes[lo:hi], percent)
                for a, b in part.edges:
                    forest.link(a + lo, b + lo)
            yield _edges(t, forest)

    return run


def components(edges: DataFrame) -> DataFrame:
    """id, root of every node of the edges (a, b): root is the least id of its component.

    Neighbours are hung below the least one, of the larger ones, then of the smaller ones, until all are stars.
    """
    pairs = edges.filter("a <> b")
    while True:
        both = pairs.union(pairs.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        down = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        pairs = durable(down.join(least, "a").filter("b <> m").select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b")).union(least.select("a", F.col("m").alias("b"))).distinct())
        # stars: a child has one parent, and no parent is a child
        nodes = pairs.select("a", F.lit(1).alias("up"), F.lit(0).alias("down")).union(pairs.select("b", F.lit(0), F.lit(1)))
        if nodes.groupBy("a").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 OR up = 1 AND down = 1").isEmpty():
            return stars(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))


def stars(edges: DataFrame) -> DataFrame:
    """id, root of edges (root, id) that are stars already."""
    roots = edges.select(F.col("a").alias("id")).distinct()
    return edges.select(F.col("b").alias("id"), F.col("a").alias("root")).distinct().union(roots.select("id", F.col("id").alias("root")))


def joined(members: DataFrame, key: str, payload: DataFrame, compare: Callable[[list[str]], Callable], early: Column | None = None) -> DataFrame:
    """id, root of the ids that something is alike to: root is the least id of those joined, as all pairs of a key would.

    members: key, id, n_bytes (what an id weighs in a block); payload: id and what compare reads. An id has one key, or,
    with `early`, many: keys that fit `early` are compared first, of the others only those that still hold ids apart.
    """
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK_TEXTS), F.ceil(F.col("bytes") / BLOCK_BYTES), F.lit(1)).cast("int")
    sizes = members.groupBy(key).agg(F.count("*").alias("n"), F.sum("n_bytes").alias("bytes"), F.min("id").alias("hub")).filter("n > 1").select(key, "hub", blocks.alias("n_blocks"))
    hashed, first_keys = F.xxhash64("id", F.lit(3)), F.lit(True) if early is None else early

    def compared(rows: DataFrame) -> DataFrame:
        spread = rows.join(payload, "id").repartition(key, "one", "two").sortWithinPartitions(key, "one", "two")
        return durable(spread.mapInArrow(compare([key, "one", "two"]), "a long, b long"))

    shared = kept(members.join(sizes, key))
    # each block within itself and with the hub, which all blocks of a key get
    placed = shared.filter(first_keys).withColumn("side", F.pmod(hashed, "n_blocks").cast("int"))
    own = F.when(F.col("id") == F.col("hub"), F.sequence(F.lit(0), F.col("n_blocks") - 1)).otherwise(F.array("side"))
    first = compared(placed.select(key, "id", "side", F.col("id").alias("label"), F.explode(own).alias("one")).withColumn("two", F.col("one")))
    # the hub is the least id of its key: where an id has one key, what is below it in all blocks is one star
    roots = durable(stars(first) if early is None else components(first))

    # what isn't in a key's largest component meets the other blocks
    rest = shared.filter((F.col("n_blocks") > 1) | ~first_keys).join(roots, "id", "left").select(key, "id", "n_bytes", F.coalesce("root", "id").alias("label"))
    parts = rest.groupBy(key, "label").agg(F.count("*").alias("n"))
    main = parts.groupBy(key).agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.count("*").alias("parts")).filter("parts > 1").select(key, "main")
    apart = durable(rest.join(main, key).withColumn("minor", F.col("label") != F.col("main")))
    if apart.isEmpty():
        return roots
    halves = apart.groupBy(key, "minor").agg(F.count("*").alias("n"), F.sum("n_bytes").alias("bytes")).select(key, "minor", blocks.alias("k"))
    cut = halves.groupBy(key).agg(F.max(F.when(F.col("minor"), F.col("k"))).alias("u"), F.max(F.when(~F.col("minor"), F.col("k"))).alias("m"))
    rows = apart.join(cut, key).withColumn("side", F.when(F.col("minor"), F.pmod(hashed, "u")).otherwise(F.col("u") + F.pmod(hashed, "m")).cast("int"))
    others = F.sequence(F.lit(0), F.when(F.col("minor"), F.col("u") + F.col("m") - 1).otherwise(F.col("u") - 1))
    pair = F.explode(F.transform(others, lambda x: F.struct(F.least(x, F.col("side")).alias("one"), F.greatest(x, F.col("side")).alias("two"))))
    second = compared(rows.withColumn("pair", pair).select(key, "id", "side", "label", "pair.one", "pair.two"))
    if second.isEmpty():
        return roots
    # components of components: what was joined above is one node here
    named = lambda side: roots.select(F.col("id").alias(side), F.col("root").alias(f"{side}_root"))
    between = second.join(named("a"), "a", "left").join(named("b"), "b", "left").select(F.coalesce("a_root", "a").alias("a"), F.coalesce("b_root", "b").alias("b"))
    above = components(durable(between.distinct()))
    old = roots.join(above.select(F.col("id").alias("root"), F.col("root").alias("top")), "root", "left").select("id", F.coalesce("top", "root").alias("root"))
    return durable(old.union(above.join(roots, "id", "left_anti").select("id", "root")))


def near_dedup(documents: DataFrame, percent: int = PERCENT, shingle: int = SHINGLE, miss: float = MISS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document.

    Documents are linked where 100 * intersection >= percent * union of their sets. miss: the posterior probability of
    reaching that under which a pair of signatures is dropped.
    """
    text = F.col("text").cast("string")
    docs = documents.select(F.col("doc_id").cast("long"), text.alias("text"), F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), text).alias("b")).alias("row"))
    least = least_matches(percent / 100, miss)
    described = kept(docs.mapInArrow(_describe(shingle), "row struct<a: long, b: long>, doc_id long, key_a long, key_b long, n_shingles long, n_bytes long, sig binary"))
    keys = ["key_a", "key_b", "n_shingles"]
    # the text that stands for a class is its least by hash
    found = described.filter("n_shingles > 0").groupBy(*keys).agg(F.min("row").alias("row"), F.min("doc_id").alias("least_id"), F.max("n_bytes").alias("n_bytes"), F.first("sig").alias("sig"))
    classes = kept(found.withColumn("id", F.monotonically_increasing_id()))

    bands = classes.select("id", "sig").mapInArrow(_bands, "bucket long, id long").withColumn("n_bytes", F.lit(0))
    candidates = joined(bands, "bucket", classes.select("id", "sig"), lambda k: _alike_by_signature(k, least), F.pmod("bucket", F.lit(EARLY)) == 0)
    some = durable(candidates.join(classes.select("id", "row", "n_bytes", "sig"), "id"))
    wanted = small_enough(some.select("row", "id"))
    texts = kept(docs.select("row", "text").join(wanted, "row").groupBy("id").agg(F.first("text").alias("text")).join(some.select("id", "sig", "n_bytes"), "id"))
    members = some.select(F.col("root").alias("grp"), "id", "n_bytes")
    roots = joined(members, "grp", texts, lambda k: _alike_by_text(k, least, shingle, percent))

    names = roots.join(classes.select("id", "least_id"), "id").groupBy("root").agg(F.min("least_id").alias("component_id"))
    known = classes.select(*keys, "id", "least_id").join(roots.join(names, "root").select("id", "component_id", F.lit(True).alias("linked")), "id", "left").select(*keys, F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("least_id")).alias("component_id"), F.lit(True).alias("known"))
    out = described.select("doc_id", *keys).join(known, keys, "left").select("doc_id", "n_shingles", F.when(F.col("known"), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op12_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH RECURSIVE docs AS (SELECT row_number() OVER () AS doc, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (SELECT doc, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda k: w[k] || ' ' || w[k + 1] || ' ' || w[k + 2])) END AS s FROM docs),
sized AS (SELECT doc, doc_id, len(s) AS n, md5(array_to_string(list_sort(s), chr(10))) AS k, s FROM sets),
classes AS (SELECT k, n, min(doc_id) AS id, min(doc) AS doc FROM sized WHERE n > 0 GROUP BY k, n),
each AS (SELECT c.doc, c.n, unnest(z.s) AS g FROM classes c JOIN sized z USING (doc)),
pairs AS (SELECT a.doc AS a, b.doc AS b FROM each a JOIN each b ON a.g = b.g AND a.doc < b.doc AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) GROUP BY a.doc, b.doc, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
both_ways AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
reached AS (SELECT doc AS a, doc AS b FROM classes UNION SELECT r.a, e.b FROM reached r JOIN both_ways e ON r.b = e.a),
named AS (SELECT r.a AS doc, min(c.id) AS component_id FROM reached r JOIN classes c ON r.b = c.doc GROUP BY r.a),
of_class AS (SELECT c.k, c.n, m.component_id FROM classes c JOIN named m USING (doc))
SELECT z.doc_id, CAST(z.n AS BIGINT) AS n_shingles, CASE WHEN z.n = 0 THEN z.doc_id ELSE o.component_id END AS component_id,
  z.doc_id IS NOT DISTINCT FROM CASE WHEN z.n = 0 THEN z.doc_id ELSE o.component_id END AS kept
FROM sized z LEFT JOIN of_class o ON z.k = o.k AND z.n = o.n
"""
