"""Chat formatting of reply trees.

Messages point to the message they answer. Self-joins that double the reach give every message its root and the score
of the path to it, so each leaf stands for a root-to-leaf path; the leaves of a root are ranked by score, and those of
the first ranks (one, some or all) are chosen. The same jump tables, taken from the longest down, list the messages on
the chosen paths. Every chosen path is written as one conversation:

    <s>role\\n text </s>\\n for each turn (without the blanks)

Inside texts a backslash is doubled and a control string gets one behind its first character, so the text can't be
taken for a mark and can be read back. In roles %, line breaks, < and [ are written as %25, %0A, %3C and %5B.

Edge cases: a null text is empty, a null role ''; a message whose parent isn't there is a root; messages on a cycle, and
those below one, reach no root and are on no path; of rows with the same tree and id one is the message, the least by
parent, score, role and text, nulls first; a null score counts as 0; ties between leaves go to the lesser id; in plain
conversations rows with equal turns follow by role, then text, repeated rows stay, and a null conv_id is one
conversation; a very long text is a turn like others, but a conversation is put together in one task; extra columns,
whatever their names, are not read; an empty table gives no rows.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from estate_jobs.llm.common import durable, table

# Strings that must not stand unescaped in a text.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|")
OPEN, CLOSE = "<s>", "</s>\n"
LEARNED = "assistant"
_ROLE = (("%", "%25"), ("\n", "%0A"), ("<", "%3C"), ("[", "%5B"))
_TURN = r"(?s)<s>([^\n]*)\n(.*?)</s>\n"


def escape(text: Column) -> Column:
    marks = "|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in CONTROL)
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), f"({marks})", r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def escape_role(role: Column) -> Column:
    for a, b in _ROLE:
        role = F.replace(role, F.lit(a), F.lit(b))
    return role


def unescape_role(role: Column) -> Column:
    for a, b in reversed(_ROLE):
        role = F.replace(role, F.lit(b), F.lit(a))
    return role


def paths(messages: DataFrame, most: int | None = 1) -> DataFrame:
    """tree, leaf, rank, score, id, depth: the messages of each root's `most` best paths (None: of all).

    messages: tree, id, parent (null: a root), score. A path's score is the sum of its messages' scores; depth counts
    from the leaf.
    """
    row = F.min(F.struct("parent", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))).alias("row")
    return _paths(messages.groupBy(F.struct("tree").alias("tree"), "id").agg(row).select("tree", "id", "row.*"), most).withColumn("tree", F.col("tree.tree"))


def _paths(messages: DataFrame, most: int | None) -> DataFrame:
    """paths() of messages with unique ids; tree is a struct, so that a null one joins too."""
    there = messages.select("tree", F.col("id").alias("parent"), F.lit(True).alias("there"))
    nodes = durable(messages.join(there, ["tree", "parent"], "left").select("tree", "id", F.when(F.col("there"), F.col("parent")).alias("up"), "score"))
    jumps, state = [], nodes.withColumn("root", F.col("id"))
    # up: the ancestor 2^k steps above, root: the highest one known, score: sum of the steps below `up`
    n = nodes.count()
    while (1 << len(jumps)) <= 2 * max(1, n) and not state.filter("up IS NOT NULL").isEmpty():
        jumps.append(state.filter("up IS NOT NULL").select("tree", "id", "up"))
        above = state.select("tree", F.col("id").alias("up"), F.col("up").alias("up2"), F.col("score").alias("score2"), F.col("root").alias("root2"))
        # messages that know their root stay as they are; the message above always exists
        moved = state.filter("up IS NOT NULL").join(above, ["tree", "up"]).select("tree", "id", F.col("up2").alias("up"), (F.col("score") + F.col("score2")).alias("score"), F.col("root2").alias("root"))
        state = durable(state.filter("up IS NULL").select("tree", "id", "up", "score", "root").union(moved))
    parents = nodes.filter("up IS NOT NULL").select("tree", F.col("up").alias("id")).distinct()
    leaves = state.filter("up IS NULL").join(parents, ["tree", "id"], "left_anti")
    ranked = leaves.withColumn("rank", F.row_number().over(W.partitionBy("tree", "root").orderBy(F.desc("score"), "id")))
    chosen = ranked if most is None else ranked.filter(F.col("rank") <= most)  # such a filter cuts ranks before the shuffle
    path = durable(chosen.select("tree", F.col("id").alias("leaf"), "rank", "score", "id", F.lit(0).alias("depth")))
    for k in reversed(range(len(jumps))):
        higher = path.join(jumps[k], ["tree", "id"]).select("tree", "leaf", "rank", "score", F.col("up").alias("id"), (F.col("depth") + (1 << k)).alias("depth"))
        path = durable(path.union(higher))  # each level reads the one before twice
    return path


def chains(turns: DataFrame) -> DataFrame:
    """Reply trees of plain conversations (conv_id, turn, role, text): each row answers the one before."""
    order = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = turns.withColumn("id", F.row_number().over(order))
    return rows.select(F.col("conv_id").alias("tree"), "id", F.when(F.col("id") > 1, F.col("id") - 1).alias("parent"), F.lit(0.0).alias("score"), "role", "text")


def format_trees(messages: DataFrame, most: int | None = 1, unique: bool = False) -> DataFrame:
    """tree, leaf, rank, score, formatted, loss (start, length; characters): a conversation for each of a root's `most` best paths.

    messages: tree, id, parent, score, role, text; unique: no tree has two rows of one id. The loss mask covers the
    escaped texts of assistant turns.
    """
    row = F.struct("parent", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    keyed = messages.select(F.struct("tree").alias("tree"), "id", row.alias("row"))
    kept = durable((keyed if unique else keyed.groupBy("tree", "id").agg(F.min("row").alias("row"))).select("tree", "id", "row.*"))
    turns = _paths(kept.select("tree", "id", "parent", "score"), most).join(kept.select("tree", "id", "role", "text"), ["tree", "id"])
    head, body = F.concat(F.lit(OPEN), escape_role(F.col("role")), F.lit("\n")), escape(F.col("text"))
    path = ["tree", "leaf", "rank", "score"]
    pieces = turns.select(*path, "depth", "role", head.alias("head"), body.alias("body"))
    order = W.partitionBy(*path).orderBy(F.desc("depth"))
    placed = pieces.withColumn("end", F.sum(F.length("head") + F.length("body") + len(CLOSE)).over(order))
    span = F.when(F.col("role") == LEARNED, F.struct((F.col("end") - F.length("body") - len(CLOSE)).alias("start"), F.length("body").cast("long").alias("length")))
    rows = placed.groupBy(*path).agg(F.array_sort(F.collect_list(F.struct((-F.col("depth")).alias("n"), F.concat("head", "body", F.lit(CLOSE)).alias("piece"), span.alias("span")))).alias("rows"))
    return rows.select(F.col("tree.tree").alias("tree"), "leaf", "rank", "score", F.array_join(F.col("rows.piece"), "").alias("formatted"), F.array_compact(F.col("rows.span")).alias("loss"))


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    out = format_trees(chains(turns.union(extra)), unique=True)
    roles, texts = (F.regexp_extract_all("formatted", F.lit(_TURN), F.lit(k)) for k in (1, 2))
    read = F.transform(F.arrays_zip(roles.alias("r"), texts.alias("t")), lambda x: F.concat(unescape_role(x["r"]), F.lit("\n"), unescape(x["t"]), F.lit("\n")))
    masked = F.array_join(F.transform("loss", lambda s: unescape(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
    found = out.select(F.col("tree").alias("conv_id"), read.alias("turns"), masked.alias("masked"), F.length("formatted").cast("long").alias("formatted_chars"))
    return found.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(F.array_join("turns", ""), 256).alias("turns_sha256"), F.length("masked").cast("long").alias("loss_chars"), F.sha2("masked", 256).alias("loss_sha256"), "formatted_chars")


def _sql_escape() -> str:
    text = "replace(text, '\\', '\\\\')"
    for c in CONTROL:
        text = f"replace({text}, '{c}', '{c[0]}\\{c[1:]}')"
    return text


OP2_SQL = f"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
pieces AS (SELECT *, length('{OPEN}' || replace(replace(replace(replace(role, '%', '%25'), chr(10), '%0A'), '<', '%3C'), '[', '%5B') || chr(10) || {_sql_escape()} || '</s>' || chr(10)) AS size FROM said)
SELECT CAST(conv_id AS BIGINT) AS conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = '{LEARNED}' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = '{LEARNED}' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
  CAST(sum(size) AS BIGINT) AS formatted_chars
FROM pieces GROUP BY conv_id
"""
