"""Masked pseudo-likelihood scores of documents.

Every word is predicted from the two words on either side of it by a window network trained in numpy, and the
log-probabilities are summed. The output is a two-level softmax: first a group, then, in a group of single words, the
word. The most frequent words are single; the others share groups by hash, and there a word's probability is its own
share of the group's occurrences. Counts of all distinct words lie in a table that grows with the corpus; tasks hold
those of the most frequent ones, the others' are joined back. The number of groups, hence of single words, follows that
of distinct words.

The network trains on every word of every document once. Documents are dealt by a hash of id and text to rounds and,
within a round, to shards; a shard is gone through in the order of the hash by one run of Adam, the shards' weights are
averaged by words seen, and the next round starts from the average. Rounds and shards depend on the rows alone, not on
files, partitions or machines, so reruns agree (but for the last bits of sums). Only rows that repeat, id and text,
over REPEATS times are spread over shards by where they lie.

Words are told apart by 64-bit hashes: of a billion distinct words two collide with a probability of 3 %.

Edge cases: a null, empty or wordless text has 0 words, log_prob 0 and a null score; a very long text is one document of
one shard, read in one piece; words beyond the ends of a text are a padding class; unseen words count as half an
occurrence; ties of counts are ordered by hash; null and repeated ids are documents like others, repeated rows score
alike; extra columns are not read; empty tables give none.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from estate_jobs.llm.common import durable, kept, small_enough, table
from estate_jobs.llm.tokens import buffers, chunks, words

#: Groups of single words: 32 up to 2^18 distinct words, half the cube root of their number beyond; half as many of shared words.
GROUPS = 32
#: Single words of a group.
MEMBERS = 64
#: Most frequent words whose counts each task holds, at most; those of the others are joined.
HOT = 1 << 19
WINDOW = (-2, -1, 1, 2)
#: Width of the hidden layer; rounds of training; words of a shard, about, and number of shards, at most.
WIDTH, ROUNDS, SEED, SHARD, MOST_SHARDS = 24, 2, 7, 1 << 20, 20_000
#: Words of a training step, learning rate, words that are scored at once.
BATCH, RATE, PART = 8192, 0.01, 8192
#: Rows of one id and text that a shard takes; weights that travel in one row.
REPEATS, BLOCK = 10_000, 4096


class Shape(NamedTuple):
    """Classes of the network: groups * MEMBERS single words, then half as many shared groups, then padding."""

    groups: int

    @property
    def single(self) -> int:
        return self.groups * MEMBERS

    @property
    def shared(self) -> int:
        return self.groups // 2

    @property
    def pad(self) -> int:
        return self.single + self.shared


def shape_of(size: int) -> Shape:
    """Shape for so many distinct words."""
    return Shape(max(GROUPS, round(size ** (1 / 3) / 2)))


# --- counts


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = buffers(batch.column("text"))
        for a, b in chunks(offsets):
            value, n = np.unique(words(data, offsets[a : b + 1]).hash, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(n.astype(np.int64))], ["hash", "n"])


class Places:
    """Looks hashes up in a sorted array: their first bits tell where to begin, which is quicker than bisection."""

    def __init__(self, known: np.ndarray) -> None:
        self.known, self.bits = known, min(20, max(8, len(known).bit_length() + 2))
        first = known >> np.uint64(64 - self.bits)
        self.begin = np.searchsorted(first, np.arange(1 << self.bits, dtype=np.uint64)).astype(np.int32)
        #: Hashes that begin alike, at most.
        self.most = int(np.diff(self.begin, append=len(known)).max())

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place in the array of each hash, and whether it is there."""
        if not len(self.known):
            return np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
        last = len(self.known) - 1
        at = np.minimum(self.begin.take((hashes >> np.uint64(64 - self.bits)).view(np.int64)), last)
        there = self.known.take(at) == hashes
        left = np.flatnonzero(self.known.take(at) < hashes)
        for _ in range(self.most - 1):
            if not len(left):
                break
            at[left] = np.minimum(at[left] + 1, last)
            value, wanted = self.known.take(at[left]), hashes[left]
            there[left] = value == wanted
            left = left[value < wanted]
        return at, there


def _bucket(hashes: np.ndarray, groups: int) -> np.ndarray:
    return (hashes & np.uint64(0x7FFFFFFF)).astype(np.int64) % groups


class Index:
    """What tasks hold of the vocabulary: the class of any word, and log-shares within it as far as they are known."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, shape: Shape, totals: np.ndarray, kinds: np.ndarray) -> None:
        """Hot words; shape; occurrences and distinct words of each bucket, single words included."""
        order = np.lexsort((hashes, -counts))
        hashes, counts = hashes[order], counts[order]
        self.shape = shape
        top, self.n_top = hashes[: shape.single], counts[: shape.single]
        order = np.argsort(top)
        self.top, self.rank = Places(top[order]), order.astype(np.int32)
        of = _bucket(top, shape.shared)
        totals, kinds = totals - np.bincount(of, counts[: shape.single], shape.shared), kinds - np.bincount(of, minlength=shape.shared)
        #: Occurrences of each shared group, half a one added for each of its words and for one unseen.
        self.log_total = np.log(totals + 0.5 * (kinds + 1))
        rest, n = hashes[shape.single :], counts[shape.single :]
        order = np.argsort(rest)
        self.hot, self.log_n = Places(rest[order]), np.log(n[order] + 0.5)

    def of(self, hashes: np.ndarray) -> np.ndarray:
        out = (self.shape.single + _bucket(hashes, self.shape.shared)).astype(np.int32)
        at, there = self.top.find(hashes)
        out[there] = self.rank[at[there]]
        return out

    def log_share(self, hashes: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log-share of each word within its class, of those that aren't hot only its divisor; the places of these."""
        out, others = np.zeros(len(hashes)), np.flatnonzero(classes >= self.shape.single)
        out[others] = -self.log_total[classes[others] - self.shape.single]
        at, there = self.hot.find(hashes[others])
        out[others[there]] += self.log_n[at[there]]
        return out, others[~there]


class Vocabulary:
    """The table of all words (hash, n), what tasks hold of it, and the words that they don't (None if they hold all)."""

    def __init__(self, texts: DataFrame, hot: int = HOT) -> None:
        self.words = kept(texts.mapInArrow(_count, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n")))
        # counts fall into some hundred classes of size; the hot words are those of the highest ones
        size = F.floor(F.log2("n") * 16).cast("int")
        bins = sorted(((r.size, r.kinds, r.total) for r in self.words.groupBy(size.alias("size")).agg(F.count("*").alias("kinds"), F.sum("n").alias("total")).collect()), reverse=True)
        self.size, self.total = sum(b[1] for b in bins), sum(b[2] for b in bins)
        shape, held, least = shape_of(self.size), 0, 1 << 30
        for bin_, kinds, _ in bins:
            if held + kinds > max(hot, shape.single):
                break
            held, least = held + kinds, bin_
        first = self.words.filter(size >= least).toArrow()
        bucket = (F.col("hash").bitwiseAND(F.lit(0x7FFFFFFF)) % shape.shared).alias("bucket")
        got = self.words.groupBy(bucket).agg(F.sum("n").alias("total"), F.count("*").alias("kinds")).toArrow()
        totals, kinds = np.zeros(shape.shared), np.zeros(shape.shared)
        totals[got.column("bucket").to_numpy()], kinds[got.column("bucket").to_numpy()] = got.column("total").to_numpy(), got.column("kinds").to_numpy()
        self.index = Index(first.column("hash").to_numpy().astype(np.int64).view(np.uint64), first.column("n").to_numpy().astype(np.float64), shape, totals, kinds)
        self.others = self.words.filter(size < least) if held < self.size else None


# --- the network


class Net(NamedTuple):
    """Views of one array of weights. Output matrices have a last row for the bias."""

    embed: np.ndarray  # (place, class, width)
    first: np.ndarray  # (width + 1, group)
    second: np.ndarray  # (group, width + 1, member)


def view(weights: np.ndarray, shape: Shape) -> Net:
    sizes = [(len(WINDOW), shape.pad + 1, WIDTH), (WIDTH + 1, shape.groups + shape.shared), (shape.groups, WIDTH + 1, MEMBERS)]
    ends = np.cumsum([np.prod(s) for s in sizes])
    return Net(*(part.reshape(s) for part, s in zip(np.split(weights[: ends[-1]], ends[:-1]), sizes, strict=True)))


def start(seed: int, shape: Shape, index: Index | None = None) -> np.ndarray:
    """Small random weights; with an index the biases make a network that gives each word its share of all words."""
    n = len(WINDOW) * (shape.pad + 1) * WIDTH + (WIDTH + 1) * (shape.groups + shape.shared) + shape.single * (WIDTH + 1)
    weights = np.random.default_rng(seed).normal(0, 0.1, n).astype(np.float32)
    net = view(weights, shape)
    net.first[-1], net.second[:, -1] = 0, 0
    if index is not None:
        count = np.full(shape.single, 1e-3)
        count[: len(index.n_top)] = index.n_top
        count = count.reshape(MEMBERS, shape.groups).T  # word r is member r // groups of group r % groups
        net.second[:, -1] = np.log(count / count.sum(axis=1, keepdims=True))
        total = np.append(count.sum(axis=1), np.exp(index.log_total))
        net.first[-1] = np.log(total / total.sum())
    return weights


def context(classes: np.ndarray, rows: np.ndarray, pad: int) -> np.ndarray:
    """Classes of the words around each word, pad outside its row; of 16 bits where they fit, which sort faster."""
    out = np.full((len(classes), len(WINDOW)), pad, np.int16 if pad < 1 << 15 else np.int32)
    for k, d in enumerate(WINDOW):
        a, b = max(0, -d), len(classes) - max(0, d)
        if b > a:
            inside = rows[a:b] == rows[a + d : b + d]
            out[a:b, k] = np.where(inside, classes[a + d : b + d], pad)
    return out


class Targets(NamedTuple):
    """What a batch predicts: each word's group; of the single words, by group, the places, members and ends of the groups."""

    group: np.ndarray
    place: np.ndarray
    member: np.ndarray
    parts: list[tuple[int, int, int]]  # group, first, last (exclusive)


def targets(classes: np.ndarray, shape: Shape) -> Targets:
    single = classes < shape.single
    group = np.where(single, classes % shape.groups, classes - shape.single + shape.groups).astype(np.int16)
    place = np.flatnonzero(single)
    place = place[np.argsort(group[place], kind="stable")]
    of = group[place]
    edges = np.append(np.flatnonzero(np.diff(of, prepend=-1)), len(of)).tolist() if len(of) else []
    return Targets(group, place, classes[place] // shape.groups, [(int(of[a]), a, b) for a, b in zip(edges, edges[1:], strict=False)])


def hidden(net: Net, ctx: np.ndarray) -> np.ndarray:
    """Hidden layer of each word and a last column of ones."""
    out = np.empty((len(ctx), WIDTH + 1), net.embed.dtype)
    total = net.embed[0].take(ctx[:, 0], axis=0)
    for k in range(1, len(WINDOW)):
        total += net.embed[k].take(ctx[:, k], axis=0)
    np.tanh(total, out=out[:, :WIDTH])
    out[:, WIDTH] = 1
    return out


def logits(net: Net, h: np.ndarray, t: Targets) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Logits of all groups; hidden rows of the single words and logits of the members of their groups."""
    part, inner = h.take(t.place, axis=0), np.empty((len(t.place), MEMBERS), h.dtype)
    for g, a, b in t.parts:
        np.matmul(part[a:b], net.second[g], out=inner[a:b])
    return h @ net.first, part, inner


def _exp(x: np.ndarray) -> np.ndarray:
    """exp in place and the sums of rows. The hidden layer is within -1 and 1, so logits stay far from overflow."""
    np.exp(np.minimum(x, 80, out=x), out=x)
    return x @ np.ones(x.shape[1], x.dtype)


def log_probability(weights: np.ndarray, shape: Shape, ctx: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Log-probability of each word's class."""
    net, t = view(weights, shape), targets(classes, shape)
    outer, _, inner = logits(net, hidden(net, ctx), t)
    out = outer[np.arange(len(outer)), t.group]
    own = inner[np.arange(len(inner)), t.member]
    out -= np.log(_exp(outer))
    out[t.place] += own - np.log(_exp(inner))
    return out


def gradient(weights: np.ndarray, shape: Shape, ctx: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Gradient of the mean of -log_probability."""
    net, t, out = view(weights, shape), targets(classes, shape), np.zeros_like(weights)
    g_net, h = view(out, shape), hidden(net, ctx)
    outer, part, inner = logits(net, h, t)
    for x, own in ((outer, t.group), (inner, t.member)):
        x *= (1 / (_exp(x) * len(classes)))[:, None].astype(x.dtype)
        x[np.arange(len(x)), own] -= 1 / len(classes)
    np.matmul(h.T, outer, out=g_net.first)
    back, inner_back = outer @ net.first[:-1].T, np.empty((len(part), WIDTH), h.dtype)
    for g, a, b in t.parts:
        np.matmul(part[a:b].T, inner[a:b], out=g_net.second[g])
        np.matmul(inner[a:b], net.second[g, :-1].T, out=inner_back[a:b])
    back[t.place] += inner_back
    back *= 1 - h[:, :WIDTH] ** 2
    two = back.view(np.result_type(back.dtype, np.complex64))  # two columns are added at a time
    for k in range(len(WINDOW)):
        column = ctx[:, k].copy()
        order = np.argsort(column, kind="stable")
        used = column.take(order)
        first = np.flatnonzero(np.diff(used, prepend=-1))
        g_net.embed[k][used[first]] = np.add.reduceat(two.take(order, axis=0), first, axis=0).view(back.dtype)
    return out


def _train(weights: np.ndarray, index: Index):
    """One run over a shard; its weights in blocks, and how many words it saw."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, m, v, seen, step, tmp = weights.copy(), np.zeros_like(weights), np.zeros_like(weights), 0, 0, np.empty_like(weights)
        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            for a, b in chunks(offsets):
                said = words(data, offsets[a : b + 1])
                classes = index.of(said.hash)
                ctx = context(classes, said.row, index.shape.pad)
                seen += len(classes)
                for k in range(0, len(classes), BATCH):
                    g = gradient(w, index.shape, ctx[k : k + BATCH], classes[k : k + BATCH])
                    step += 1
                    m *= 0.9
                    m += np.multiply(g, 0.1, out=tmp)
                    v *= 0.99
                    g *= g
                    v += np.multiply(g, 0.01, out=g)
                    np.sqrt(v, out=g)
                    g /= np.float32(np.sqrt(1 - 0.99**step))
                    g += np.float32(1e-8)
                    np.divide(m, g, out=g)
                    w -= np.multiply(g, np.float32(RATE / (1 - 0.9**step)), out=g)
        if seen:
            shard, parts = TaskContext.get().partitionId(), [w[k : k + BLOCK].tobytes() for k in range(0, len(w), BLOCK)]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(parts), dtype=np.int32)), pa.array(np.full(len(parts), shard, np.int32)), pa.array(np.full(len(parts), seen, np.int64)), pa.array(parts, pa.binary())], ["block", "shard", "n", "weights"])

    return run


def _average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Mean weights of each block, by words seen; the rows of a block follow each other."""
    block, total, n = None, np.zeros(0), 0

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([(total / n).astype(np.float32).tobytes()], pa.binary())], ["block", "weights"])

    for batch in batches:
        for b, seen, raw in zip(batch.column("block").to_pylist(), batch.column("n").to_pylist(), batch.column("weights").to_pylist(), strict=True):
            if b != block:
                if block is not None:
                    yield done()
                block, total, n = b, 0.0, 0
            total, n = total + np.frombuffer(raw, np.float32).astype(np.float64) * seen, n + seen
    if block is not None:
        yield done()


def _dealt(documents: DataFrame) -> DataFrame:
    """text, key, salt of every document: the hash that it is dealt by, and a number for those of a row that repeats very often."""
    keyed = documents.select(F.col("text").cast("string"), F.xxhash64(F.col("doc_id").cast("string"), F.col("text").cast("string")).alias("key"))
    often = durable(keyed.groupBy("key").count().filter(F.col("count") > REPEATS).select("key", F.lit(1).alias("often")))
    if often.isEmpty():
        return keyed.withColumn("salt", F.lit(0))
    return keyed.join(small_enough(often), "key", "left").select("text", "key", F.when(F.col("often") == 1, F.monotonically_increasing_id() % 1024).otherwise(0).alias("salt"))


def train(documents: DataFrame, rounds: int = ROUNDS, seed: int = SEED, hot: int = HOT) -> tuple[Vocabulary, np.ndarray]:
    """Vocabulary and network of the documents. What the driver gets is bounded: counts of the hot words and the weights."""
    vocabulary = Vocabulary(documents.select(F.col("text").cast("string")), hot)
    weights, dealt = start(seed, vocabulary.index.shape, vocabulary.index), _dealt(documents)
    shards = int(np.clip(round(vocabulary.total / rounds / SHARD), 1, MOST_SHARDS))
    for turn in range(rounds):
        mine = dealt.filter(F.pmod(F.shiftright("key", 40), F.lit(rounds)) == turn)
        shuffled = mine.repartition(shards, "key", "salt").sortWithinPartitions("key").select("text")
        rows = shuffled.mapInArrow(_train(weights, vocabulary.index), "block int, shard int, n long, weights binary")
        got = rows.repartition("block").sortWithinPartitions("block", "shard").mapInArrow(_average, "block int, weights binary").toArrow()
        if got.num_rows:
            parts = dict(zip(got.column("block").to_pylist(), got.column("weights").to_pylist(), strict=True))
            weights = np.frombuffer(b"".join(parts[k] for k in range(len(parts))), np.float32)
    return vocabulary, weights


# --- scores


def _score(weights: np.ndarray, index: Index, known: bool):
    """known: words that aren't hot are unseen ones; else they are listed, to be joined."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row_id = TaskContext.get().partitionId() << 40
        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            for a, b in chunks(offsets):
                said = words(data, offsets[a : b + 1])
                classes, row = index.of(said.hash), said.row
                ctx = context(classes, row, index.shape.pad)
                log_p, others = index.log_share(said.hash, classes)
                for k in range(0, len(row), PART):
                    part = slice(k, k + PART)
                    log_p[part] += log_probability(weights, index.shape, ctx[part], classes[part])
                if known:
                    log_p[others] += np.log(0.5)
                    others = others[:0]
                n = np.bincount(row, minlength=b - a)
                ends = np.concatenate([[0], np.cumsum(np.bincount(row[others], minlength=b - a))]).astype(np.int32)
                listed = pa.ListArray.from_arrays(pa.array(ends), pa.array(said.hash[others].view(np.int64)))
                ids = pa.array(np.arange(row_id, row_id + b - a))
                row_id += b - a
                yield pa.RecordBatch.from_arrays([ids, batch.column("doc_id").slice(a, b - a), pa.array(n.astype(np.int64)), pa.array(np.bincount(row, log_p, b - a).astype(np.float64)), listed], ["row_id", "doc_id", "n_words", "log_prob", "others"])

    return run


def score(documents: DataFrame, vocabulary: Vocabulary, weights: np.ndarray) -> DataFrame:
    """doc_id, n_words, log_prob (sum), score (mean log-probability of a word) of every document."""
    docs = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    found = docs.mapInArrow(_score(weights, vocabulary.index, vocabulary.others is None), "row_id long, doc_id long, n_words long, log_prob double, others array<long>")
    if vocabulary.others is not None:
        found = kept(found)
        each = found.select("row_id", F.explode("others").alias("hash")).join(vocabulary.others, "hash", "left")
        sums = each.groupBy("row_id").agg(F.sum(F.log(F.coalesce("n", F.lit(0)) + 0.5)).alias("rest"))
        found = found.drop("others").join(sums, "row_id", "left").withColumn("log_prob", F.col("log_prob") + F.coalesce("rest", F.lit(0.0)))
    found = found.select("doc_id", "n_words", "log_prob")
    return found.withColumn("score", F.when(F.col("n_words") > 0, F.col("log_prob") / F.col("n_words")))


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, *train(docs))
