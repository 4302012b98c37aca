"""Document fingerprints by spot signatures.

A signature is an anchor (common words in a row) with the chain of the next two content words. Anchors are common
words of the languages at hand; as lists, tables and marked-up text may have none, a content word whose hash is 0
modulo 16 is an anchor too. A text's set of signatures (32-bit hashes) is its fingerprint; a text with no signature has
the hash of all its characters as the only one. Fingerprints fall into partitions by the size of the set; two are
compared by Jaccard only if their sizes leave room for the least likeness that is asked for.

The edited texts need each document's successor. Ids are cut into ranges, and the first row of each is sent to the range
before as well, so a window in each range finds it, and texts are shuffled once. An id (or null) that would fill several
ranges is cut by the hash of its rows' signatures.

Near copies: sets of likeness `least` or more are linked, and each document gets the class of all that are linked to it,
directly or through others. Equal sets are one. Partitions by size bound how many signatures two like sets can differ in;
so many places and one more hold their signatures, and the contents of at least one place are equal: sets with equal
contents of a place are in one cell. Each set is compared with that of its cell which is in the largest cells, in a
group of near copies the text that the others were made from; then, where a cell still holds more than one class, those
of different classes whose parities leave room for a link (sets differ in at least as many signatures as bits of their
parities). So a large group of near copies is compared with its centre, not in all pairs.

Edge cases: a null text is empty; the one signature of an empty text is that of no characters, so empty texts are
alike; a very long text is read whole by native expressions; rows with equal ids follow by text, those of an id that is
cut by the hash of their signatures, then by text; null ids come last in descending order; repeated rows have the same
signatures, hence the same class, and those with signatures and id alike are in one range; a class is named by the least
id in it, null if it has none; one document succeeds itself; extra columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from functools import reduce
from itertools import accumulate, groupby

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from estate_jobs.llm.common import durable, kept, small_enough, table
from estate_jobs.llm.near_duplicates import components

# Anchors, common words of English, German, French and Spanish.
ANCHORS = (
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "was", "with",
    "das", "dem", "den", "der", "des", "die", "ein", "eine", "einen", "ist", "mit", "nicht", "sich", "und", "von", "zu",
    "dans", "de", "du", "elle", "en", "est", "et", "il", "la", "le", "les", "pas", "pour", "que", "qui", "sur", "un", "une",
    "al", "con", "del", "el", "los", "las", "no", "por", "se", "su", "y",
)
#: The anchors as a regex, in groups of one first letter, so that most words are passed by at once.
_ANCHOR = "|".join(f"{first}(?:{'|'.join(w[1:] for w in words)})" for first, words in groupby(sorted(ANCHORS), lambda w: w[0]))
EVERY = 16
#: Ranges of ids for each shuffle partition.
RANGES = 4
#: An id with more rows than this, and than four ranges hold on average, is cut.
CUT_ROWS = 10_000
#: Hashes that cut an id are taken modulo this.
TURNS = 1 << 31
#: Ids of sets (8 bytes each) that may be broadcast to find their signatures.
MOST_SETS = 500_000
#: Places whose contents are compared, of each deal.
PLACES = 40
#: 64-bit words of a set's parities.
WORDS = 8


def _bind(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with value computed once however often f uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _short(x: Column) -> Column:
    """The low 32 bits of a hash as an int."""
    return (x.bitwiseAND(F.lit(0xFFFFFFFF)) - F.lit(1 << 31)).cast("int")


def signatures(text: Column) -> Column:
    """Sorted distinct signatures of a text."""
    plain = F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " ")))
    # anchors are tied to the content word that follows: " of the house" becomes " of~the~house"
    tied = F.split(F.substring(F.regexp_replace(plain, f"(?<= )({_ANCHOR}) ", "$1~"), 2, 1 << 30), " ")

    def spots(words: Column) -> Column:
        def spot(word: Column, k: Column) -> Column:
            chain = F.xxhash64(word, F.substring_index(F.get(words, k + 1), "~", -1))
            return F.when(F.contains(word, F.lit("~")) | (F.pmod(F.xxhash64(word), F.lit(EVERY)) == 0), _short(chain))

        return F.array_sort(F.array_distinct(F.array_compact(F.transform(words, spot))))

    # the hash of the one empty word of a text without words isn't 0 modulo EVERY, so it is no anchor
    return _bind(_bind(tied, spots), lambda found: F.when(F.size(found) > 0, found).otherwise(F.array(_short(F.xxhash64(text)))))


def fingerprint(signatures: Column) -> Column:
    return F.array_join(F.transform(signatures, lambda x: F.lpad(F.hex(x + F.lit(1 << 31)), 8, "0")), "")


def length_class(size: Column, least: float = 0.8) -> Column:
    """Partition of a set by its size: sets of likeness `least` or more are in the same or in neighbouring ones."""
    return F.floor(F.log(size.cast("double")) / F.log(F.lit(1 / least)) + 1e-9).cast("int")


def likeness(a: Column, b: Column, least: float = 0.0) -> Column:
    """Jaccard of two sorted sets; 0 without a comparison if their sizes can't give more than 0 and `least`."""
    small, large = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    shared = F.size(F.array_intersect(a, b)).cast("double")
    return F.when((small > 0) & (small >= least * large), shared / (F.size(a) + F.size(b) - shared)).otherwise(0.0)


def set_keys(sigs: Column, least: float = 0.8) -> Column:
    """Keys of a set: two sets of likeness `least` or more share one.

    Sets of two neighbouring partitions by size, s and s + 1, of which the smaller one is in s, differ in fewer than
    m = (1 - least) / least ** (s + 2) signatures, rounded up. Signatures are dealt by hash to m places; two such sets
    have a place with equal contents, which is a key. Several deals of a few places, or the first PLACES of many, leave
    a chance under 1e-6 that no such place is among those used or that all are empty, and that only for the least
    alike. A set has keys as the smaller one, for s its own partition, and as the larger one, for s the partition below.
    """

    def contents(s: Column, m: Column, deal: Column) -> Column:
        place = lambda x: F.pmod(F.xxhash64(deal, x), m)
        # place and signature in one number, so that sorting brings the contents of a place together
        used = F.filter(F.transform(sigs, lambda x: F.shiftleft(place(x), 32) + x.bitwiseAND(F.lit(0xFFFFFFFF))), lambda v: F.shiftright(v, 32) < PLACES)

        def cut(sorted_: Column) -> Column:
            mark = lambda v, k: F.when(F.shiftright(v, 32) == F.shiftright(F.get(sorted_, k - 1), 32), F.lit(",")).otherwise(F.lit(";"))
            return F.split(F.array_join(F.transform(sorted_, lambda v, k: F.concat(mark(v, k), F.hex(v))), ""), ";")

        return F.transform(F.filter(_bind(F.array_sort(used), cut), lambda x: F.length(x) > 0), lambda x: F.xxhash64(s, deal, x))

    def of_partition(s: Column) -> Column:
        m = (F.floor(F.lit(1 - least) * F.pow(F.lit(1 / least), s + 2) + 1e-9) + 1).cast("long")

        def all_deals(m: Column) -> Column:
            deals = F.when(m == 2, 5).when(m < 5, 4).when(m < 8, 3).when(m < 20, 2).otherwise(1)
            return F.flatten(F.transform(F.sequence(F.lit(1), deals), lambda deal: contents(s, m, deal)))

        # sets that may not differ at all are equal
        return F.when(m > 1, _bind(m, all_deals)).otherwise(F.array().cast("array<bigint>"))

    return _bind(length_class(F.size(sigs), least), lambda s: F.array_distinct(F.concat(of_partition(s), of_partition(s - 1))))


def parities(sigs: Column) -> list[Column]:
    """w0, w1 and so on: for each of 64 * WORDS bits, whether an odd number of signatures falls on it.

    Two sets differ in at least as many signatures as bits.
    """
    bit = lambda x: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(x, F.lit(64)).cast("int"))
    word = lambda k: F.filter(sigs, lambda x: F.pmod(F.xxhash64(x), F.lit(WORDS)) == k)
    return [F.aggregate(word(k), F.lit(0).cast("long"), lambda sofar, x: sofar.bitwiseXOR(bit(x))).alias(f"w{k}") for k in range(WORDS)]


def set_classes(prints: DataFrame, least: float = 0.8) -> DataFrame:
    """set_a, set_b (hashes of a set) and class_id of the sets that more than one row of prints (doc_id, sigs) is like."""
    sets = kept(prints.groupBy("sigs").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies")).withColumn("id", F.monotonically_increasing_id()))
    arrays = sets.select("id", "sigs")

    # cells: sets of one key
    keyed = arrays.select("id", F.explode(set_keys(F.col("sigs"), least)).alias("key"))
    cells = kept(keyed.withColumn("size", F.count("*").over(W.partitionBy("key"))).filter("size > 1"))
    central = cells.groupBy("id").agg(F.sum("size").alias("centrality"))
    centre = F.max_by("id", F.struct("centrality", "id")).alias("b")
    centres = cells.join(small_enough(central), "id").groupBy("key").agg(centre)
    first = cells.select("key", F.col("id").alias("a")).join(centres, "key").filter("a <> b").select("a", "b").distinct()
    alike = likeness(F.col("a_sigs"), F.col("b_sigs"), least) >= least - 1e-9

    def like(pairs: DataFrame) -> DataFrame:
        """Those of pairs (a, b) that are alike; signatures of other sets stay where they are while the ids are few."""
        for side in ("a", "b"):
            asked = small_enough(pairs.select(F.col(side).alias("id")).distinct(), MOST_SETS)
            own = arrays.join(asked, "id", "left_semi").select(F.col("id").alias(side), F.col("sigs").alias(f"{side}_sigs"))
            pairs = pairs.join(own, side)
        return pairs.filter(alike).select("a", "b")

    edges = durable(like(durable(first)))
    roots = durable(components(edges))

    # in cells that hold several classes still, sets of different ones meet if their parities allow for a link
    labelled = cells.join(small_enough(roots), "id", "left").select("key", "id", F.coalesce("root", "id").alias("label"))
    mixed = labelled.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high").select("key")
    wanted = durable(labelled.join(small_enough(mixed), "key", "left_semi"))
    sketches = small_enough(arrays.join(small_enough(wanted.select("id").distinct()), "id", "left_semi").select("id", F.size("sigs").alias("n"), *parities(F.col("sigs"))))
    left = kept(wanted.join(sketches, "id"))
    side = lambda x: left.select(*(F.col(c).alias(f"{x}_{c}") for c in left.columns))
    odd = reduce(Column.__add__, (F.bit_count(F.col(f"a_w{k}").bitwiseXOR(F.col(f"b_w{k}"))) for k in range(WORDS)))
    pair = (F.col("a_key") == F.col("b_key")) & F.expr("a_label <> b_label AND a_id < b_id") & (odd <= (1 - least) / (1 + least) * (F.col("a_n") + F.col("b_n")) + 1e-9)
    cross = side("a").join(side("b"), pair).select(F.col("a_id").alias("a"), F.col("b_id").alias("b")).distinct()
    roots = durable(components(edges.union(like(durable(cross)))))

    known = sets.select(F.xxhash64("sigs").alias("set_a"), F.xxhash64(F.lit(1), "sigs").alias("set_b"), "least", "copies", "id").join(small_enough(roots), "id", "left").withColumn("root", F.coalesce("root", "id"))
    names = known.groupBy("root").agg(F.min("least").alias("class_id"), F.sum("copies").alias("rows")).filter("rows > 1").select("root", "class_id")
    return durable(known.join(names, "root").select("set_a", "set_b", "class_id"))


def _with_hashes(prints: DataFrame) -> DataFrame:
    return prints.withColumn("set_a", F.xxhash64("sigs")).withColumn("set_b", F.xxhash64(F.lit(1), "sigs"))


def near_classes(prints: DataFrame, least: float = 0.8) -> DataFrame:
    """prints (doc_id, sigs and others) with class_id, the least doc_id of its class.

    prints is read twice.
    """
    classes = small_enough(set_classes(prints.select("doc_id", "sigs"), least).withColumn("in_class", F.lit(True)))
    rows = _with_hashes(prints).join(classes, ["set_a", "set_b"], "left")
    return rows.select(*prints.columns, F.when(F.col("in_class"), F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"))


def _docs(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def classes_of(documents: DataFrame, least: float = 0.8) -> DataFrame:
    """doc_id, set_a, class_id of the documents that aren't named by their own id; several rows for repeated ones."""
    prints = _docs(documents).select("doc_id", signatures(F.col("text")).alias("sigs"))
    classes = small_enough(set_classes(prints, least))
    return durable(_with_hashes(prints).select("doc_id", "set_a", "set_b").join(classes, ["set_a", "set_b"]).filter(~F.col("doc_id").eqNullSafe(F.col("class_id"))).select("doc_id", "set_a", "class_id").distinct())


def _numbers(values: list[int]) -> Column:
    """values as one literal array, however many."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def _below(ends: list[int], x: Column) -> Column:
    """How many of the sorted ends are under x, by bisection."""
    steps = F.array(*(F.lit(1 << k) for k in reversed(range(len(ends).bit_length()))))
    return F.aggregate(steps, F.lit(0), lambda n, step: F.when(F.get(_numbers(ends), n + step - 1) < x, n + step).otherwise(n))


def _ranges(docs: DataFrame, cut_rows: int) -> Callable[[DataFrame, Column], DataFrame]:
    """A function that adds range and turn to rows with doc_id, given the hash of a row's signatures.

    Ranges are numbered along descending ids, null last. turn orders the rows of an id that is cut, else it is 0. Ends
    come from percentiles, which hold ids as doubles: an id beyond 2 ** 53 is in some range, but may not be cut.
    """
    ranges = max(1, RANGES * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    cuts = F.percentile_approx("doc_id", [k / ranges for k in range(1, ranges)] or [0.5], 20 * ranges)
    seen = docs.agg(cuts.alias("cuts"), F.count("*").alias("rows"), F.count("doc_id").alias("ids")).first()
    often = Counter(seen.cuts or [])
    many = max(cut_rows, 4 * seen.rows // ranges)
    asked = [v for v, n in often.items() if n > 2]
    hot = {r.doc_id: r.n for r in docs.filter(F.col("doc_id").isin(asked)).groupBy("doc_id").agg(F.count("*").alias("n")).filter(F.col("n") > many).collect()} if asked else {}
    # an end before an id that is cut leaves it alone between two ends
    ends = sorted({*often, *(v - 1 for v in hot if v > -(1 << 63))}) or [0]
    rows = [0, *(hot.get(v, 0) for v in reversed(ends)), seen.rows - seen.ids]
    pieces = [-(-n * ranges // seen.rows) if n > many else 1 for n in rows]
    starts = list(accumulate(pieces, initial=0))

    def put(df: DataFrame, signed: Column) -> DataFrame:
        place = F.when(F.col("doc_id").isNull(), len(ends) + 1).otherwise(len(ends) - _below(ends, F.col("doc_id")))
        df = df.withColumn("place", place).withColumn("pieces", F.get(_numbers(pieces), F.col("place")))
        df = df.withColumn("turn", F.when(F.col("pieces") > 1, F.pmod(signed, F.lit(TURNS))).otherwise(F.lit(0)).cast("long"))
        return df.withColumn("range", F.get(_numbers(starts), F.col("place")) + F.floor(F.col("turn") * F.col("pieces") / TURNS)).drop("place", "pieces")

    return put


def with_next(documents: DataFrame, classes: DataFrame | None = None, cut_rows: int = CUT_ROWS) -> DataFrame:
    """doc_id, text, sigs and next_text, next_sigs of the next document by descending id; the first one's for the last.

    With `classes` (doc_id, set_a, class_id, as classes_of gives them) also class_id. Its rows go to the ranges of their
    ids, so texts are shuffled once.
    """
    docs = _docs(documents)
    put = _ranges(docs, cut_rows)
    placed = put(docs, F.xxhash64(signatures(F.col("text"))))
    # each range's first row, by the same order as the window's; one row a range comes to the driver
    order = F.coalesce(F.bitwise_not("doc_id"), F.lit(0))
    firsts = placed.groupBy("range").agg(F.min(F.struct(order.alias("id"), "turn")).alias("first")).collect()
    first = {r.range: r.first for r in firsts} or {0: (0, 0)}
    used, full = sorted(first), range(max(first) + 1)
    before = dict(zip(used, [used[-1], *used], strict=False))
    is_first = reduce(Column.__and__, (c == F.get(_numbers([first[r][k] if r in first else 0 for r in full]), F.col("range")) for k, c in enumerate([order, F.col("turn")])))
    guest = F.when(is_first, F.get(_numbers([before.get(r, 0) for r in full]), F.col("range")))
    to = F.explode(F.filter(F.array(F.struct(F.col("range"), F.lit(0).alias("guest")), F.struct(guest.alias("range"), F.lit(1).alias("guest"))), lambda x: x["range"].isNotNull()))
    rows = placed.withColumn("to", to).select("doc_id", "text", "turn", "to.range", "to.guest")
    if classes is not None:
        told = put(classes, F.col("set_a")).select("doc_id", F.lit(None).cast("string").alias("text"), "turn", "range", F.lit(2).alias("guest"), "set_a", F.struct("class_id").alias("told"))
        rows = rows.unionByName(told, allowMissingColumns=True)
    rows = rows.repartition("range").withColumn("sigs", F.when(F.col("text").isNotNull(), signatures(F.col("text"))))
    if classes is not None:
        same = W.partitionBy("range", "doc_id", "set_a").orderBy(F.desc("guest"))
        rows = rows.withColumn("set_a", F.coalesce("set_a", F.xxhash64("sigs"))).withColumn("told", F.first("told").over(same)).filter("guest < 2").withColumn("class_id", F.when(F.col("told").isNotNull(), F.col("told.class_id")).otherwise(F.col("doc_id")))
    along = W.partitionBy("range").orderBy("guest", F.desc_nulls_last("doc_id"), "turn", "text")
    nxt = rows.withColumn("next", F.lead(F.struct("text", "sigs")).over(along)).filter("guest = 0")
    return nxt.select("doc_id", "text", "sigs", F.col("next.text").alias("next_text"), F.col("next.sigs").alias("next_sigs"), *([] if classes is None else ["class_id"]))


def op3_spot_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    docs = with_next(documents, classes_of(documents))
    n = F.length("text")
    third = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - third), F.substring(F.col("next_text"), F.lit(1), third))
    texts = docs.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "sigs", "next_sigs", "class_id")
    sets = texts.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "sigs", signatures(F.col("edited")).alias("edited_sigs"), "next_sigs", "class_id")
    own, changed = F.col("sigs"), F.col("edited_sigs")
    near = [likeness(own, changed).alias("near_edited"), likeness(own, F.col("next_sigs")).alias("near_next")]
    return sets.select("doc_id", "n_chars", "edited_sha256", fingerprint(own).alias("fingerprint"), fingerprint(changed).alias("edited_fingerprint"), *near, F.size(own).alias("n_signatures"), length_class(F.size(own)).alias("length_class"), "class_id")
