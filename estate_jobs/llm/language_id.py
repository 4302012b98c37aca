"""Language identification of mixed-language text.

The script of a word (by ranges of code points) narrows the languages it may be in; letter trigrams score it for each
of those; Viterbi with a penalty for switching labels every word, so a text becomes spans of one language each. The
language that covers most letters is the document's, its share of the letters the score.

Edge cases: a null text or one without letters is `und` with score 0 and no span; letters of a script that no
training text had keep the language around them, alone the most frequent one; a very long text is labelled whole, by
chunks of rows that it fills alone; null langs teach nothing, null and repeated ids are documents like others; with no
labelled row every document is `und`; ties go to the more frequent language, then by name; repeated rows are labelled
alike; extra columns are not read by identify and are kept by keep; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from estate_jobs.llm.common import held_out, small_enough, table
from estate_jobs.llm.tokens import PART, buffers, chunks

#: Labelled documents to learn from, for each language: about this many, chosen by a hash of the id.
TRAIN_DOCS = 4_000
#: Cost in nats of a change of language between two words.
SWITCH = 12.0
BUCKETS = 1 << 16
#: A script belongs to a language that has at least this share of its letters in it.
SCRIPT_SHARE = 0.01
#: Bytes of text whose words go through Viterbi together.
GROUP = 4 << 20

# First code point of each range and the script of its letters.
SCRIPT_RANGES = [
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"), (0x0600, "Arabic"), (0x0700, "Syriac"), (0x0750, "Arabic"), (0x0780, "Thaana"),
    (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "Gurmukhi"), (0x0A80, "Gujarati"), (0x0B00, "Oriya"), (0x0B80, "Tamil"), (0x0C00, "Telugu"), (0x0C80, "Kannada"), (0x0D00, "Malayalam"),
    (0x0D80, "Sinhala"), (0x0E00, "Thai"), (0x0E80, "Lao"), (0x0F00, "Tibetan"), (0x1000, "Myanmar"), (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Ethiopic"), (0x13A0, "Other"),
    (0x1C80, "Cyrillic"), (0x1C90, "Georgian"), (0x1CC0, "Other"), (0x1D00, "Latin"), (0x1F00, "Greek"), (0x2000, "Other"), (0x2C60, "Latin"), (0x2C80, "Other"), (0x2DE0, "Cyrillic"), (0x2E00, "Other"),
    (0x3005, "Han"), (0x3041, "Kana"), (0x3105, "Other"), (0x3131, "Hangul"), (0x3190, "Other"), (0x31F0, "Kana"), (0x3200, "Other"), (0x3400, "Han"), (0xA000, "Other"), (0xA640, "Cyrillic"),
    (0xA6A0, "Other"), (0xA720, "Latin"), (0xA800, "Other"), (0xAC00, "Hangul"), (0xD7FC, "Other"), (0xF900, "Han"), (0xFB00, "Latin"), (0xFB13, "Armenian"), (0xFB1D, "Hebrew"), (0xFB50, "Arabic"),
    (0xFE00, "Other"), (0xFE70, "Arabic"), (0xFF21, "Latin"), (0xFF66, "Kana"), (0xFFA0, "Hangul"), (0xFFE0, "Other"), (0x20000, "Han"), (0x323B0, "Other"),
]
SCRIPTS = sorted({s for _, s in SCRIPT_RANGES})
_FIRST = np.array([a for a, _ in SCRIPT_RANGES])
_SCRIPT = np.array([SCRIPTS.index(s) for _, s in SCRIPT_RANGES])


@cache
def lower_letters() -> np.ndarray:
    """Lower-case form of each letter, 0 for every other code point."""
    out = np.zeros(0x110000, np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            out[i] = ord(low) if len(low := c.lower()) == 1 else i
    return out


class Letters(NamedTuple):
    """Letters of some rows: trigram bucket of each; first letter, row, first and last character of each word."""

    bucket: np.ndarray
    first: np.ndarray
    row: np.ndarray
    start: np.ndarray
    end: np.ndarray
    script: np.ndarray


def letters(data: np.ndarray, offsets: np.ndarray) -> Letters:
    raw = data[offsets[0] : offsets[-1]]
    points = np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), np.uint32)
    chars = np.append(0, np.cumsum((raw & 0xC0) != 0x80))[offsets - offsets[0]]  # where each row begins, in characters
    low = lower_letters()[points]
    before, after = np.zeros_like(low), np.zeros_like(low)
    before[1:], after[:-1] = low[:-1], low[1:]
    heads, tails = chars[:-1][np.diff(chars) > 0], chars[1:][np.diff(chars) > 0] - 1
    before[heads], after[tails] = 0, 0
    at = np.flatnonzero(low)
    a, b, c = before[at], low[at], after[at]
    bucket = ((((a * np.uint32(0x9E3779B1)) ^ b) * np.uint32(0x85EBCA6B) ^ c) * np.uint32(0xC2B2AE35)) >> np.uint32(16)
    first = np.flatnonzero(a == 0)
    start, end = at[first], at[np.flatnonzero(c == 0)] + 1
    row = np.searchsorted(chars, start, side="right") - 1
    return Letters(bucket.astype(np.int64), first, row, start - chars[row], end - chars[row], _SCRIPT[np.searchsorted(_FIRST, points[start], side="right") - 1])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, slot, n) of a partition: trigram buckets, then letters by script."""
    seen: dict[str, np.ndarray] = {}
    for batch in batches:
        lang = np.array(batch.column("lang").to_pylist(), object)
        data, offsets = buffers(batch.column("text"))
        for a, b in chunks(offsets, PART):
            x = letters(data, offsets[a : b + 1])
            size = np.diff(np.append(x.first, len(x.bucket)))
            of_letter = np.repeat(x.row, size)
            for name in set(lang[a:b]):
                mine = lang[a:b] == name
                slots = seen.setdefault(name, np.zeros(BUCKETS + len(SCRIPTS), np.int64))
                slots[:BUCKETS] += np.bincount(x.bucket[mine[of_letter]], minlength=BUCKETS)
                slots[BUCKETS:] += np.bincount(x.script[mine[x.row]], size[mine[x.row]], len(SCRIPTS)).astype(np.int64)
    for name, slots in seen.items():
        at = np.flatnonzero(slots)
        yield pa.RecordBatch.from_pydict({"lang": pa.array([name] * len(at), pa.string()), "slot": at.astype(np.int32), "n": slots[at]})


class Model(NamedTuple):
    langs: list[str]
    prior: np.ndarray  # log share of the documents
    weight: np.ndarray  # (bucket, lang): log-probability
    allowed: np.ndarray  # (script, lang)


def learn(documents: DataFrame, train_docs: int = TRAIN_DOCS) -> Model:
    """Model from the rows with a lang: of each language about train_docs, all of them if there are fewer."""
    labelled = documents.filter("lang IS NOT NULL").select(F.col("doc_id").cast("string").alias("doc_id"), "lang", "text")
    sizes = labelled.groupBy("lang").agg(F.count("*").alias("n_docs"))
    chosen = F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(""))), F.lit(1 << 20)) * F.col("n_docs") < train_docs * (1 << 20)
    sample = labelled.join(small_enough(sizes), "lang").filter(chosen).select("lang", "text")
    counts = sample.mapInArrow(_count, "lang string, slot int, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n")).toArrow()
    docs = {r.lang: r.n_docs for r in sizes.collect()}
    langs = sorted(docs, key=lambda x: (-docs[x], x))
    n = np.zeros((BUCKETS + len(SCRIPTS), len(langs)))
    if len(langs):
        place = {x: k for k, x in enumerate(langs)}
        n[counts.column("slot").to_numpy(), [place[x] for x in counts.column("lang").to_pylist()]] = counts.column("n").to_numpy()
    grams, scripts = n[:BUCKETS], n[BUCKETS:]
    kinds = max(1, np.count_nonzero(grams.any(axis=1)))
    weight = np.log((grams + 0.1) / (grams.sum(axis=0) + 0.1 * kinds))
    share = scripts / np.maximum(1, scripts.sum(axis=0))
    total = max(1, sum(docs.values()))
    return Model(langs, np.log([docs[x] / total for x in langs] or [1.0]), weight.astype(np.float32), share >= SCRIPT_SHARE)


def viterbi(score: np.ndarray, first: np.ndarray, prior: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """Best label of each word. first: where each text's words begin, and the end; all texts advance together."""
    n_words, n_langs = score.shape
    length = np.diff(first)
    order = np.argsort(-length, kind="stable")
    order = order[length[order] > 0]
    begin, length = first[:-1][order], length[order]
    out = np.zeros(n_words, np.int16)
    if not len(order):
        return out
    steps = int(length[0])
    active = np.searchsorted(-length, -np.arange(steps), side="left")  # texts with more than t words
    base = np.append(0, np.cumsum(active))
    back, langs = np.empty((n_words, n_langs), np.int16), np.arange(n_langs, dtype=np.int16)
    best = score[begin] + prior
    for t in range(1, steps):
        n = active[t]
        now = best[:n]
        top = now.argmax(1)
        jump = now[np.arange(n), top][:, None] - switch
        stay = now >= jump
        back[base[t] : base[t] + n] = np.where(stay, langs, top[:, None])
        best[:n] = np.where(stay, now, jump) + score[begin[:n] + t]
    state = best.argmax(1).astype(np.int16)
    for t in range(steps - 1, 0, -1):
        n = active[t]
        out[begin[:n] + t] = state[:n]
        state[:n] = back[base[t] + np.arange(n), state[:n]]
    out[begin] = state
    return out


def _labels(model: Model, switch: float, column: pa.Array) -> Iterator[tuple[int, int, pa.Array, np.ndarray, pa.Array]]:
    """First and last row (exclusive), languages, scores and spans, part by part."""
    langs, n_langs = np.array([*model.langs, "und"], object), len(model.langs)

    data, offsets = buffers(column)
    for a, b in chunks(offsets, GROUP):
        parts, scores = [], []
        for c, d in chunks(offsets[a : b + 1], PART):
            x = letters(data, offsets[a + c : a + d + 1])
            s = np.zeros((len(x.first), n_langs), np.float32)
            if len(x.first) and n_langs:
                s = np.add.reduceat(model.weight[x.bucket], x.first, axis=0)
                allowed = model.allowed[x.script]
                s[~allowed] = -1e4  # not a language of this script
                s[~allowed.any(axis=1)] = 0
            parts.append((x.row + c, x.start, x.end))
            scores.append(s)
        row, start, end = (np.concatenate(p) for p in zip(*parts, strict=True))
        first = np.searchsorted(row, np.arange(b - a + 1))
        label = viterbi(np.concatenate(scores), first, model.prior, switch) if n_langs else np.zeros(len(row), np.int16)
        cover = np.bincount(row * max(1, n_langs) + label, end - start, (b - a) * max(1, n_langs)).reshape(b - a, -1)
        total = cover.sum(axis=1)
        lang = np.where((total > 0) & (n_langs > 0), cover.argmax(axis=1), n_langs)
        share = np.where(lang < n_langs, cover.max(axis=1) / np.maximum(1, total), 0.0)
        new = np.flatnonzero((np.diff(row, prepend=-1) != 0) | (np.diff(label, prepend=-1) != 0)) if n_langs else np.zeros(0, np.int64)
        last = np.append(new[1:], len(row))[: len(new)] - 1
        spans = pa.StructArray.from_arrays([pa.array(start[new]), pa.array(end[last]), pa.array(langs[label[new]], pa.string())], ["start", "end", "lang"])
        at = np.searchsorted(row[new], np.arange(b - a + 1)).astype(np.int32)
        yield a, b, pa.array(langs[lang], pa.string()), share, pa.ListArray.from_arrays(pa.array(at), spans)


def _label(model: Model, switch: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, lang, share, spans in _labels(model, switch, batch.column("text")):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), lang, pa.array(share), spans], ["doc_id", "lang_pred", "score", "spans"])

    return run


def _keep(model: Model, least: float, switch: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, _, share, _ in _labels(model, switch, batch.column("text")):
                yield batch.slice(a, b - a).filter(pa.array((share > 0) & (share >= least)))

    return run


def identify(documents: DataFrame, model: Model, switch: float = SWITCH) -> DataFrame:
    """doc_id, lang_pred, score, spans (start, end, lang; characters, end exclusive) of every document."""
    docs = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return docs.mapInArrow(_label(model, switch), "doc_id long, lang_pred string, score double, spans array<struct<start: long, end: long, lang: string>>")


def keep(documents: DataFrame, model: Model, least: float, switch: float = SWITCH) -> DataFrame:
    """The rows of documents with a language that covers at least this share of the letters."""
    return documents.mapInArrow(_keep(model, least, switch), documents.schema)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify(docs, learn(docs.filter(~held_out())))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", F.size("spans").cast("long").alias("n_spans"))
