"""URL filter: rules first, then a ratio of character language models.

A rule allows or blocks a host, its subdomains and the paths that begin with the rule's; the longest rule that fits
wins. The URLs that rules decide teach two smoothed variable-order Markov models, one of allowed and one of blocked
URLs: a character's probability after the last k characters is backed off to k - 1, down to none. A URL without a rule
is judged by the difference of its log-likelihoods, a character's mean, against a threshold that was calibrated on a
fifth of the ruled URLs that the models didn't see. Every ruled URL teaches one or the other.

Edge cases: a null url or one without :// has an empty host and path and no rule; it is judged by its characters, null
as ''; an empty url has difference 0; with no ruled URL the threshold is 0 and all differences are 0 (allow); of rules
of equal length the last by verdict and text wins; a very long url is judged whole; repeated rows are judged alike and
teach as often as they occur, counted before anything is learned; null and repeated page_ids are rows like others; extra columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from estate_jobs.llm.common import kept, table
from estate_jobs.llm.tokens import buffers, chunks, mix
from estate_jobs.sources.tables import running

#: (verdict, host/path) of each rule. At most some thousands: they become one expression.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
#: Distinct URLs whose contexts one task counts, about; fewer tasks send fewer counts.
TASK_URLS = 1 << 18
TRAIN_TASKS = 8
#: Distinct differences that the driver compares for the threshold; more are summed up in ranges.
CUTS = 1 << 12
ORDER, SLOTS, WEIGHT = 5, 1 << 18, 4.0
SEED_SHARE = 5


def parse(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url."""
    rest = F.when(F.instr(url, "://") > 0, F.regexp_replace(url, r"^(?s:.*?)://", "")).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def ruled(urls: DataFrame, rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """urls with host, path, rule and rule_verdict (null where no rule fits)."""
    host, path = parse(F.col("url"))
    out = urls.withColumn("host", host).withColumn("path", path)
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: (len(r[1]), r)):  # the longest comes last, so it is asked first
        name, _, rest = text.partition("/")
        fits = ((F.col("host") == name) | F.col("host").endswith(f".{name}")) & F.col("path").startswith(f"/{rest}")
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return out.withColumn("rule", rule).withColumn("rule_verdict", verdict)


def _contexts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Row and character of each byte, with hashed slots of the 0 to ORDER bytes before it, without and with it."""
    raw = data[offsets[0] : offsets[-1]]
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    char, key = raw.astype(np.uint64) + np.uint64(1), np.zeros(len(raw), np.uint64)
    before, after = [], []
    for k in range(ORDER + 1):
        if k:
            past = np.zeros(len(raw), np.uint64)  # 0: before the row's beginning
            past[k:] = np.where(row[k:] == row[: len(row) - k], char[: len(row) - k], 0) if len(raw) > k else 0
            key = key * np.uint64(257) + past
        here = mix(key + (np.uint64(k) << np.uint64(56)))
        before.append((here & np.uint64(SLOTS - 1)).astype(np.int64))
        after.append((mix(here + char) & np.uint64(SLOTS - 1)).astype(np.int64))
    return row, char, before, after


class Model(NamedTuple):
    """Counts of contexts and of contexts with their next character: (verdict, order, slot)."""

    seen: np.ndarray
    next: np.ndarray

    def differences(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Mean over a url's characters of log P(allowed model) - log P(blocked model)."""
        row, _, before, after = _contexts(data, offsets)
        log_p = []
        for v in range(2):
            p = np.full(len(row), 1 / 256)
            for k in range(ORDER + 1):
                p = (self.next[v, k][after[k]] + WEIGHT * p) / (self.seen[v, k][before[k]] + WEIGHT)
            log_p.append(np.log(p))
        n = len(offsets) - 1
        return np.bincount(row, log_p[0] - log_p[1], n) / np.maximum(1, np.diff(offsets))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(slot, n) over both tables, verdicts and orders, of urls with a verdict and how often they occur."""
    n = np.zeros((2, 2, ORDER + 1, SLOTS))
    for batch in batches:
        verdict, often = np.array(batch.column("verdict").to_pylist(), object) == "block", batch.column("often").to_numpy()
        data, offsets = buffers(batch.column("url"))
        for a, b in chunks(offsets):
            row, _, before, after = _contexts(data, offsets[a : b + 1])
            blocked, weight = verdict[a:b][row], often[a:b][row]
            for v in range(2):
                of = blocked == v
                for k in range(ORDER + 1):
                    n[0, v, k] += np.bincount(before[k][of], weight[of], SLOTS)
                    n[1, v, k] += np.bincount(after[k][of], weight[of], SLOTS)
    at = np.flatnonzero(n)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n.ravel()[at].astype(np.int64))], ["slot", "n"])


def _judge(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column("url"))
            d = [model.differences(data, offsets[a : b + 1]) for a, b in chunks(offsets)]
            rest = [c for c in batch.schema.names if c != "difference"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(np.concatenate(d) if d else np.zeros(0))], [*rest, "difference"])

    return run


def learn(judged: DataFrame, train_urls: int | None = None, cuts: int = CUTS) -> tuple[Model, float]:
    """Models of the allowed and the blocked URLs, and the calibrated threshold. judged has url and verdict.

    All URLs with a verdict are learned from; with train_urls of each verdict about so many distinct ones, chosen by a
    hash. The driver gets the counts of hashed slots, and at most 2 * cuts rows of differences.
    """
    known = judged.filter("verdict IS NOT NULL AND url IS NOT NULL").select("url", "verdict")
    if train_urls is not None:
        kinds = {r.verdict: r.n for r in known.groupBy("verdict").agg(F.approx_count_distinct("url", 0.02).alias("n")).collect()}
        draw, chosen = F.pmod(F.xxhash64("url"), F.lit(1 << 20)), F.lit(False)
        for verdict, n in kinds.items():
            chosen |= (F.col("verdict") == verdict) & (draw * n < train_urls * (1 << 20))
        known = known.filter(chosen)
    seen = kept(known.groupBy("url", "verdict").agg(F.count("*").alias("often")))
    calibrate = F.pmod(F.xxhash64("url", F.lit("calibrate")), F.lit(SEED_SHARE)) == 0
    # each task sends the counts of its own contexts, so their number follows that of the URLs
    tasks = max(TRAIN_TASKS, seen.count() // TASK_URLS)
    counts = seen.filter(~calibrate).coalesce(tasks).mapInArrow(_count, "slot int, n long")
    got = counts.groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    n = np.zeros((2, 2, ORDER + 1, SLOTS))
    n.ravel()[got.column("slot").to_numpy()] = got.column("n").to_numpy()
    model = Model(n[0].astype(np.float32), n[1].astype(np.float32))
    rows = seen.filter(calibrate).mapInArrow(_judge(model), "url string, verdict string, often long, difference double")
    return model, calibrated(rows, cuts)


def calibrated(rows: DataFrame, cuts: int = CUTS) -> float:
    """The threshold (see below) for rows with verdict, often and difference, by running sums if there are many differences."""
    of = lambda v: F.sum(F.when(F.col("verdict") == v, F.col("often")).otherwise(0)).alias(v)
    found = kept(rows.groupBy("difference").agg(of("allow"), of("block")))
    if found.count() <= cuts:
        few = found.toArrow()
        d, allow, block = (few.column(c).to_numpy() for c in ("difference", "allow", "block"))
        allowed, often = np.repeat([True, False], len(d)), np.append(allow, block)
        return threshold(np.append(d, d)[often > 0], allowed[often > 0], often[often > 0])
    total = found.agg(F.sum("allow").alias("allow"), F.sum("block").alias("block"), F.min("difference").alias("least")).first()
    if not total.allow or not total.block:
        return 0.0
    summed = running(found, [], ["difference"], {"below": F.col("allow"), "above": F.col("block")})
    miss = F.col("below") / total.allow + 1 - F.col("above") / total.block
    best = summed.agg(F.min(F.struct(miss.alias("miss"), "difference")).alias("best")).first().best
    if best.miss >= 1:
        return float(total.least)
    after = found.filter(F.col("difference") > best.difference).agg(F.min("difference").alias("d")).first().d
    return float(best.difference + 1e-9 if after is None else (best.difference + after) / 2)


def threshold(difference: np.ndarray, allowed: np.ndarray, often: np.ndarray) -> float:
    """The cut with the least mean of the two error rates; 0 unless both verdicts occur. Equal differences stay together."""
    if allowed.all() or not allowed.any():
        return 0.0
    d, at = np.unique(difference, return_inverse=True)
    below, above = np.bincount(at, often * allowed, len(d)), np.bincount(at, often * ~allowed, len(d))
    miss = np.append(0, np.cumsum(below)) / below.sum() + 1 - np.append(0, np.cumsum(above)) / above.sum()  # allowed below, blocked above
    k = int(miss.argmin())
    return float(d[0] if k == 0 else d[-1] + 1e-9 if k == len(d) else (d[k - 1] + d[k]) / 2)


def filter_urls(urls: DataFrame, rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, difference of every url."""
    found = ruled(urls.select(F.col("page_id").cast("long"), F.col("url").cast("string")), rules)
    model, cut = learn(found.select("url", F.col("rule_verdict").alias("verdict")))
    judged = found.mapInArrow(_judge(model), "page_id long, url string, host string, path string, rule string, rule_verdict string, difference double")
    return judged.select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", F.when(F.col("difference") >= cut, "allow").otherwise("block")).alias("verdict"), "difference")


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"))
