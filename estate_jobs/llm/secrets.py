"""Secret scans with a trigram index.

Each rule's regex is turned into a Boolean query of trigrams that every match must hold (any of some sets, all of a
set's trigrams). The index has a posting (trigram, document) for the trigrams that the queries ask for; postings are
intersected by counting the trigrams of a set that meet in a document. Documents that some set is complete in are
candidates, and only they are searched with the regex; a rule without mandatory trigrams (hex) searches all. Candidates
are few and narrow: up to MOST_CANDIDATES, counted first, they are broadcast and no text is shuffled; more are joined.

Edge cases: a null or empty text has no span; a very long text is searched whole, by native expressions; documents that
share a doc_id are candidates together and are searched each for itself; rows with a null doc_id aren't in the index and
are searched by every rule; matches of different rules may overlap, equal starts follow in the order of the rules;
repeated rows give a row each; extra columns, whatever their names, are not read and are kept by redact; an empty table
gives no rows.
"""

from __future__ import annotations

import re
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from estate_jobs.llm.common import durable, free_name, small_enough, table


class Rule(NamedTuple):
    kind: str
    regex: str
    #: Group whose length counts, and the least length; shorter matches are dropped.
    group: int
    least: int


#: A private key: its header; header lines such as Proc-Type; the base64 body to the END line or, where that is missing,
#: to the end of the lines of 20 characters or more and the line right after them. What separates lines may be written
#: as \\n, as in JSON. Counts are bounded: nested ones may come to 1000 in SQL's engine, and Java recurs for each group.
_HEAD = r"-----BEGIN [A-Z ]*PRIVATE KEY-----"
_FIELD = r"[ \t\r\n\\nr]*[A-Z][A-Za-z0-9]*(?:-[A-Za-z0-9]+)?:[^\r\n\\]*"
_CLOSED = r"[A-Za-z0-9+/= \t\r\n\\]*-----END [A-Z ]*PRIVATE KEY-----"
_LINE = r"(?:[ \t\r\n\\]+[A-Za-z0-9+/=]{20,})"
_OPEN = f"{_LINE}{{1,49}}{_LINE}{{0,49}}{_LINE}{{0,49}}" + r"(?:[ \t]*(?:\r?\n|\\n)[ \t]*[A-Za-z0-9+/=]+)?"
PEM = f"{_HEAD}(?:(?:{_FIELD}){{0,4}}(?:{_CLOSED}|{_OPEN}))?"

# The base rules, then those that the method adds.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24),
    Rule("pem", PEM, 0, 1),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 40),
)
BASE = 3
#: Runs of literals that classes may spread into; a class that gives more ends the run.
MOST_RUNS = 64
#: Matches whose lengths are added up together.
RUN = 256
#: Candidates (an id and some kinds each, about 100 bytes) that may be broadcast.
MOST_CANDIDATES = 500_000


def trigram_sets(regex: str) -> list[frozenset[str]]:
    """Sets of lower-case trigrams, one of which is complete in every text that the regex matches; [] if there is none.

    Literal runs give their trigrams, what follows in sequence is added to every set, alternatives give several sets.
    A small class of literals within a run (gh[pousr]_) is an alternative for each of them.
    """
    parse = re._parser  # the parse tree of the standard library

    def of(items) -> list[frozenset[str]]:
        sets, runs = [frozenset()], [""]

        def close() -> None:
            nonlocal sets, runs
            sets = list(dict.fromkeys(s | {run[k : k + 3] for k in range(len(run) - 2)} for s in sets for run in runs))
            runs = [""]

        for op, arg in items:
            name = str(op)
            if name == "LITERAL":
                runs = [run + chr(arg).lower() for run in runs]
                continue
            if name == "IN" and len(runs) * len(arg) <= MOST_RUNS and all(str(kind) == "LITERAL" for kind, _ in arg):
                runs = list(dict.fromkeys(run + chr(c).lower() for run in runs for _, c in arg))
                continue
            if name == "MAX_REPEAT" and arg[0] >= 1 and len(arg[2]) == 1 and str(arg[2][0][0]) == "LITERAL":
                runs = [run + chr(arg[2][0][1]).lower() * min(arg[0], 3) for run in runs]
            close()
            if name == "SUBPATTERN":
                sets = [s | t for s in sets for t in of(arg[3])]
            elif name == "BRANCH":
                sets = [s | t for s in sets for part in arg[1] for t in of(part)]
        close()
        return sets

    sets = list(dict.fromkeys(of(parse.parse(regex))))
    return sets if all(sets) else []


def postings(documents: DataFrame, trigrams: list[str]) -> DataFrame:
    """(doc_id, trigram) of the given trigrams that occur in a text, whatever their case."""
    low = F.lower("text")
    there = F.array(*(F.when(F.contains(F.col("low"), F.lit(t)), F.lit(t)) for t in trigrams))
    return documents.select("doc_id", low.alias("low")).select("doc_id", F.explode(F.array_compact(there)).alias("trigram"))


def candidates(documents: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, kinds: the indexed rules whose query a document satisfies; one row a document."""
    sets = [(r.kind, k, s) for r in rules for k, s in enumerate(trigram_sets(r.regex))]
    wanted = sorted({t for _, _, s in sets for t in s})
    # the query's terms: for each trigram the sets that it is in
    asked = reduce(lambda e, t: e.when(F.col("trigram") == t, F.array(*(F.lit(n) for n, (_, _, s) in enumerate(sets) if t in s))), wanted, F.when(F.lit(False), F.array().cast("array<int>")))
    met = postings(documents.filter("doc_id IS NOT NULL"), wanted).select("doc_id", "trigram", F.explode(asked).alias("set"))
    sizes = F.element_at(F.array(*(F.lit(len(s)) for _, _, s in sets)), F.col("set") + 1)
    kinds = F.element_at(F.array(*(F.lit(kind) for kind, _, _ in sets)), F.col("set") + 1)
    return met.groupBy("doc_id", "set").agg(F.count_distinct("trigram").alias("n")).filter(F.col("n") == sizes).groupBy("doc_id").agg(F.collect_set(kinds).alias("kinds"))


def matches(text: Column, rule: Rule) -> Column:
    """kind, start, end of the rule's matches, leftmost and not overlapping, without those that are too short.

    The lengths of what is between the matches and of the matches give the places: they are added up in runs of RUN
    matches, and the runs' sums move their spans. Appending to one array would copy it for each match of a text.
    """
    sizes = lambda x: F.transform(x, lambda v: F.length(v))
    found, counted = (sizes(F.regexp_extract_all(text, F.lit(rule.regex), F.lit(k))) for k in (0, rule.group))
    measured = F.arrays_zip(sizes(F.split(text, rule.regex, -1)).alias("gap"), found.alias("size"), counted.alias("counted"))
    spans_of = lambda x: F.array(x) if x is not None else F.array().cast("array<struct<start:int,end:int>>")
    start = F.struct(F.lit(0).alias("at"), spans_of(None).alias("spans"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + x["gap"]
        end = begin + F.coalesce(x["size"], F.lit(0))
        kept = F.concat(acc["spans"], spans_of(F.struct(begin.alias("start"), end.alias("end"))))
        return F.struct(end.alias("at"), F.when(x["size"].isNotNull() & (x["counted"] >= rule.least), kept).otherwise(acc["spans"]).alias("spans"))

    def placed(rows: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(rows) - 1) / RUN).cast("int")), lambda k: F.aggregate(F.slice(rows, k * RUN + 1, RUN), start, step))

    def moved(runs: Column) -> Column:
        first = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))
        starts = F.aggregate(runs, first, lambda acc, r: F.struct((acc["at"] + r["at"]).alias("at"), F.concat(acc["starts"], F.array(acc["at"])).alias("starts")))["starts"]
        return F.flatten(F.zip_with(runs, starts, lambda r, at: F.transform(r["spans"], lambda s: F.struct((at + s["start"]).alias("start"), F.lit(rule.kind).alias("kind"), (at + s["end"]).alias("end")))))

    once = lambda value, f: F.get(F.transform(F.array(value), f), F.lit(0))  # noqa: E731  value is worked out once
    return once(once(measured, placed), moved)


def _quick(rule: Rule) -> str:
    """A regex that every kept match holds, cheaper to test than all matches are to list."""
    return rule.regex.removesuffix("+") + f"{{{rule.least},}}" if rule.group == 0 and rule.regex.startswith("[") else rule.regex


def to_search(documents: DataFrame, rules: tuple[Rule, ...] = RULES, kinds: str = "kinds") -> DataFrame:
    """documents with a column `kinds` (of that name), the rules that may match."""
    free = [r.kind for r in rules if not trigram_sets(r.regex)]
    found = small_enough(durable(candidates(documents, rules)), MOST_CANDIDATES).select(F.col("doc_id").alias(free_name("candidate_id", documents)), F.col("kinds").alias(kinds))
    every = F.when(documents["doc_id"].isNull(), F.array(*(F.lit(r.kind) for r in rules)))
    indexed = F.coalesce(found[kinds], F.array().cast("array<string>"))
    both = F.coalesce(every, F.array_union(indexed, F.array(*map(F.lit, free)).cast("array<string>")))
    return documents.join(found, documents["doc_id"] == found[found.columns[0]], "left").select(*(documents[c] for c in documents.columns), both.alias(kinds))


def find_secrets(documents: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id and, for each rule, its spans (start, kind, end; characters, end exclusive) of every document."""
    docs = to_search(documents.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")), rules)
    none = F.array().cast("array<struct<start:int,kind:string,end:int>>")
    wanted = lambda r: F.array_contains("kinds", r.kind) & F.col("text").rlike(_quick(r))
    return docs.select("doc_id", *(F.when(wanted(r), matches(F.col("text"), r)).otherwise(none).alias(r.kind) for r in rules))


def joined(kinds: tuple[str, ...]) -> Column:
    """kind:start:end of the spans of some rules, by start, then in the order of the rules."""
    order = F.array(*map(F.lit, kinds))
    rows = F.concat(*(F.transform(F.col(k), lambda s: F.struct(s["start"].alias("start"), F.array_position(order, s["kind"]).alias("n"), s["kind"].alias("kind"), s["end"].alias("end"))) for k in kinds))
    return F.array_join(F.transform(F.array_sort(rows), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(documents: DataFrame, mark: str = "[SECRET]", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """documents with every kept match replaced by mark, rule by rule, and n_chars of the new text.

    Keys go first: the mark of another rule within a key's header or body would hide the rest of it.
    """
    def without(r: Rule) -> Column:
        found, counted = F.regexp_extract_all("text", F.lit(r.regex), F.lit(0)), F.regexp_extract_all("text", F.lit(r.regex), F.lit(r.group))
        rows = F.arrays_zip(F.split("text", r.regex, -1).alias("p"), found.alias("m"), counted.alias("g"))
        return F.array_join(F.transform(rows, lambda x: F.concat(x["p"], F.coalesce(F.when(F.length(x["g"]) >= r.least, F.lit(mark)).otherwise(x["m"]), F.lit("")))), "")

    kinds = free_name("kinds", documents)
    out = to_search(documents, rules, kinds)
    for r in sorted(rules, key=lambda r: r.kind != "pem"):
        out = out.withColumn("text", F.when(F.array_contains(kinds, r.kind) & F.col("text").rlike(_quick(r)), without(r)).otherwise(F.col("text")))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(documents.columns)


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"))
    kinds = tuple(r.kind for r in RULES)
    count = lambda k: F.size(k).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *map(count, kinds[:BASE]), F.sha2(joined(kinds[:BASE]), 256).alias("base_sha256"), joined(kinds).alias("spans"))


def _sql_regex(regex: str) -> str:
    """The regex for SQL's engine, in which (?i:) would fold letters beyond ASCII too."""
    folded = re.sub(r"\(\?i:([^)]*)\)", lambda m: "(?:" + re.sub("[a-z]", lambda c: f"[{c[0]}{c[0].upper()}]", m[1]) + ")", regex)
    return folded.replace("'", "''")


_SQL_SPANS = " UNION ALL ".join(
    f"SELECT doc, {n} AS n, '{r.kind}' AS kind, {r.least} AS least, string_split_regex(text, '{_sql_regex(r.regex)}') AS p,"
    f" regexp_extract_all(text, '{_sql_regex(r.regex)}') AS m, regexp_extract_all(text, '{_sql_regex(r.regex)}', {r.group}) AS g FROM docs"
    for n, r in enumerate(RULES)
)
_SQL_JOINED = "string_agg(kind || ':' || begins || ':' || ends, ',' ORDER BY begins, n)"
OP6_SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS doc, doc_id, coalesce(text, '') AS text FROM documents),
found AS ({_SQL_SPANS}),
each AS (SELECT doc, n, kind, least, k, length(p[k]) AS gap, length(m[k]) AS size, length(g[k]) AS counted FROM (SELECT *, unnest(range(1, len(m) + 1)) AS k FROM found)),
placed AS (SELECT *, CAST(sum(gap + size) OVER (PARTITION BY doc, n ORDER BY k) AS BIGINT) AS ends FROM each),
spans AS (SELECT doc, n, kind, ends - size AS begins, ends FROM placed WHERE counted >= least),
sums AS (SELECT doc, count(*) FILTER (WHERE n = 0) AS n_assign, count(*) FILTER (WHERE n = 1) AS n_access, count(*) FILTER (WHERE n = 2) AS n_hex,
  {_SQL_JOINED} FILTER (WHERE n < {BASE}) AS base, {_SQL_JOINED} AS spans FROM spans GROUP BY doc)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN sums USING (doc)
"""
