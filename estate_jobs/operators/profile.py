"""Profiles of a crawl corpus."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from estate_jobs.operators.extract import resolve
from estate_jobs.sources.tables import running

# Named patterns whose matches are counted.
PATTERNS = {
    "href to /nehnutelnost/": r'href="[^"]*nehnutelnost/',
    "href to /detail/": r'href="[^"]*/detail/',
    "href to /inzerat/": r'href="[^"]*/inzerat/',
    "href to /vysledky/.../detail": r'href="[^"]*/vysledky/[^"]*/detail',
    "Bratislava text occurrences": r"Bratislava",
    "€ price patterns": r"\d{4,7}\s*€",
    "'izbový' (room) mentions": r"izbov",
    "__NEXT_DATA__ JSON blob": r"__NEXT_DATA__",
    "__NUXT__ blob": r"__NUXT__",
    "'apolloState'": r"apolloState",
    "'initialState'": r"initialState",
}
# Labelled patterns of addresses in pages (group 1 is mined).
MINED = {
    "URLs containing /api/": r"""["'`]((?:https?://[^"'`\s]{0,30})?/api/[^"'`\s]{5,120})["'`]""",
    "fetch() URLs": r"""fetch\(["'`]([^"'`\s)]{10,120})["'`]""",
    "GraphQL endpoints": r"""(?i)["'`]([^"'`\s]*graphql[^"'`\s]*)["'`]""",
    "Listing/advert/search-pattern URLs": r"""["'`]((?:https?://[^"'`\s]{0,40})?/(?:adverts?|listings?|inzeraty|nehnutelnosti|search|byty|realitky)[^"'`\s]{0,80})["'`]""",
    "window.* assignments": r"""(window\.\w+)\s*=\s*\{.{10,200}""",
    "API base URL config vars": r"""(?i)(?:API_URL|apiUrl|baseURL|BASE_URL|endpoint|ENDPOINT)\s*[=:]\s*["'`]([^"'`\s]{8,100})["'`]""",
}
# Labelled patterns of addresses in script bundles (group 1 is mined), and parts of those that are left out.
BUNDLE_MINED = {
    "nehnutelnosti URL": r"""["'`]((?:https?:)?//[^"'`\s]*nehnutelnosti\.sk/[^"'`\s]{5,150})["'`]""",
    "/api/ path": r"""["'`](/api/[^"'`\s]{3,120})["'`]""",
    "api.nehnutelnosti": r"""["'`]([^"'`\s]*api\.nehnutelnosti[^"'`\s]*)["'`]""",
    "adverts/search URL": r"""["'`](https?://[^"'`\s]+(?:adverts?|listings?|search|results?)[^"'`\s]{0,80})["'`]""",
    "/v1/ /v2/ path": r"""["'`](/v\d+/[^"'`\s]{3,120})["'`]""",
    "graphql path": r"""["'`](/graphql[^"'`\s]*)["'`]""",
    "fetch() call": r"""fetch\(["'`]([^"'`\s)]+)["'`]""",
    "axios call": r"""axios\.[a-z]+\(["'`]([^"'`\s)]+)["'`]""",
}
BUNDLE_DENIED = (".jpg", ".png", ".svg", ".css", ".woff", "facebook.com", "google", "doubleclick", "/static/", "/_next/static/", "/_next/image")
# Parts of script sources that are kept, and parts that aren't.
SCRIPTS_KEPT = ("nehnutel", "_next", "/static/", "/chunks/", "main", "app", "page")
SCRIPTS_DENIED = ("googletag", "doubleclick", "facebook", "hotjar", "criteo", "google-analytics", "gtag", "smartad")
# Parts of the names of keys that hold listings.
LISTING_KEYS = ("advert", "listing", "result", "item", "data", "offer", "estate")
#: White space of any alphabet: Java's \\s is that of ASCII.
SPACE = r"[\s\p{Z}\x{0085}\x{001C}-\x{001F}]"
# Words of links to further pages.
PAGER_WORDS = ("strana", "page", "stran", "další", "ďalš", "next", "»")
#: Page numbers of a site that are ordered together.
RANGE = 1 << 14
DENIED = r"\.(css|js|png|jpg|svg|woff)|google|facebook|analytics"


def _hrefs(regex: str = r'href="([^"#]{4,300})"') -> Column:
    return F.regexp_extract_all("html", F.lit(regex), F.lit(1))


def path_prefixes(pages: DataFrame, n: int = 20) -> DataFrame:
    """The n most frequent beginnings (three parts) of link paths. Partial counts precede the shuffle."""
    path = F.regexp_replace("href", r"^https?://[^/]+", "")
    found = pages.select(F.explode(_hrefs()).alias("href")).filter("NOT contains(href, 'javascript')")
    return found.select(F.array_join(F.slice(F.split(path, "/"), 1, 3), "/").alias("prefix")).groupBy("prefix").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "prefix").limit(n)


def candidates(pages: DataFrame) -> DataFrame:
    low = F.lower("href")
    like = F.col("href").rlike(r"/[0-9]{6,}") | low.rlike("detail|inzerat|advert") | (low.contains("/byt") & (F.length("href") > 30))
    return pages.select(F.explode(_hrefs(r'href="([^"#?]{4,200})"')).alias("href")).filter(like).distinct()


def pattern_counts(pages: DataFrame) -> DataFrame:
    """page_id, pattern, n: a row for each page and named pattern."""
    # white space of any alphabet, as where the patterns come from
    counts = F.array(*(F.struct(F.lit(k).alias("pattern"), F.regexp_count("html", F.lit(r.replace(r"\s", SPACE))).cast("long").alias("n")) for k, r in PATTERNS.items()))
    return pages.select("page_id", F.inline(counts))


def health(pages: DataFrame) -> DataFrame:
    """Pages by host: all, those still loading, blocked, with listing words."""
    low = F.lower("html")
    host = F.regexp_extract("url", r"^https?://([^/?#]+)", 1)
    flags = {"loading": "loading|skeleton", "blocked": "captcha|cloudflare|incapsula", "listing": "inzerat|advert|detail|article"}
    return pages.groupBy(host.alias("host")).agg(F.count("*").alias("pages"), *(F.count_if(low.rlike(r)).alias(k) for k, r in flags.items()))


def _mined(rows: DataFrame, text: str, patterns: dict[str, str]) -> DataFrame:
    """label, url: distinct addresses of 6 to 199 characters that the patterns find in a column of texts."""
    def labelled(label: str, regex: str) -> Column:
        urls = F.array_distinct(F.regexp_extract_all(text, F.lit(regex), F.lit(1)))
        return F.transform(urls, lambda u: F.struct(F.lit(label).alias("label"), u.alias("url")))

    pairs = F.concat(*(labelled(k, r) for k, r in patterns.items()))
    return rows.select(F.explode(pairs).alias("x")).select("x.label", "x.url").filter((F.length("url") > 5) & (F.length("url") < 200)).distinct()


def mined_urls(pages: DataFrame) -> DataFrame:
    """label, url, rn: all distinct URLs that aren't denied, numbered in order for each label."""
    found = _mined(pages, "html", MINED).filter(~F.lower("url").rlike(DENIED))
    return running(found, ["label"], ["url"], {"rn": F.lit(1)}).withColumn("rn", F.col("rn").cast("int"))


def mined_bundles(pages: DataFrame, bundles: DataFrame, top: int = 25) -> DataFrame:
    """label, url, rn: the first distinct addresses of each label in the script bundles that pages load.

    bundles: url, status, js. A page's sources (see `scripts`) are resolved against its address and counted once, so a
    bundle that many pages share is searched once; failed fetches are left out, and so are addresses with a denied part.
    """
    sources = scripts(pages.select("page_id", "html")).join(pages.select("page_id", "url"), "page_id").select("url", F.explode("scripts").alias("src"))
    wanted = sources.select(resolve(F.col("url"), F.col("src")).alias("url")).distinct()
    loaded = bundles.filter("status = 200").join(wanted, "url", "left_semi")
    found = _mined(loaded, "js", BUNDLE_MINED).filter(~F.col("url").rlike("|".join(re.escape(x) for x in BUNDLE_DENIED)))
    return found.withColumn("rn", F.row_number().over(W.partitionBy("label").orderBy("url"))).filter(F.col("rn") <= top)


def scripts(pages: DataFrame, kept: tuple[str, ...] = SCRIPTS_KEPT, denied: tuple[str, ...] = SCRIPTS_DENIED) -> DataFrame:
    """page_id, scripts: sources of script tags in page order, then bundle paths anywhere in the page, each once; those with a kept part and no denied one."""
    tags = F.regexp_extract_all("html", F.lit(r'<script[^>]+src="([^"]+\.js[^"]*)"'), F.lit(1))
    paths = F.regexp_extract_all("html", F.lit(r"/_next/static/[^\s\"']+\.js"), F.lit(0))
    some = lambda words: "|".join(re.escape(w) for w in words)
    return pages.select("page_id", F.filter(F.array_distinct(F.concat(tags, paths)), lambda s: s.rlike(some(kept)) & ~s.rlike(some(denied))).alias("scripts"))


def numeric_ids(pages: DataFrame, keys: str = "advertId|listingId|id", least: int = 6) -> DataFrame:
    """numeric_id: distinct numbers given to a key, in JSON, scripts or attributes: quotes and blanks may stand around."""
    found = F.array_distinct(F.regexp_extract_all("html", F.lit(rf"(?:{keys})[\"']?{SPACE}*[:=]{SPACE}*[\"']?([0-9]{{{least},12}})"), F.lit(1)))
    return pages.select(F.explode(found).alias("numeric_id")).distinct()


def snippets(pages: DataFrame, word: str, around: int = 30, k: int = 3) -> DataFrame:
    """page_id, snippets, classes: the first k places of a word with what is around it, and the first k class names."""
    found = F.regexp_extract_all("html", F.lit(rf"(?s)(.{{0,{around}}}{word}.{{0,{around}}})"), F.lit(1))
    return pages.select("page_id", F.slice(found, 1, k).alias("snippets"), F.slice(F.regexp_extract_all("html", F.lit(r'class="([^"]+)"'), F.lit(1)), 1, k).alias("classes"))


def pagination(pages: DataFrame, words: tuple[str, ...] = PAGER_WORDS) -> DataFrame:
    """page_id, href, label of anchors that lead to further pages: a short label or its link has one of the words."""
    anchor = r'<a[^>]+href="([^"#]+)"[^>]*>([^<]{1,30})</a>'
    both = F.arrays_zip(F.regexp_extract_all("html", F.lit(anchor), F.lit(1)).alias("href"), F.regexp_extract_all("html", F.lit(anchor), F.lit(2)).alias("label"))
    found = pages.select("page_id", F.explode(both).alias("x")).select("page_id", "x.href", F.regexp_replace("x.label", f"^{SPACE}+|{SPACE}+$", "").alias("label"))
    return found.filter(F.lower(F.concat("label", "href")).rlike("|".join(re.escape(w) for w in words)) & (F.length("href") < 200)).distinct()


def _differing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number of places, up to the end of the shorter one, where two texts have different characters."""
    codes = lambda t: np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)
    for batch in batches:
        n = []
        for x, y in zip(batch.column("html"), batch.column("before_html"), strict=True):
            a, b = codes(x.as_py()), codes(y.as_py())
            m = min(len(a), len(b))
            n.append(int(np.count_nonzero(a[:m] != b[:m])))
        yield pa.RecordBatch.from_arrays([batch.column("digest"), batch.column("before"), pa.array(n, pa.int64())], ["digest", "before", "n"])


def repeats(pages: DataFrame) -> DataFrame:
    """page_id, same, differing: each page of a site (site, page_no) against the one before; only unequal ones are compared by character.

    Only digests are ordered, in ranges of page_no; the last page of a range is carried to the site's next one. The
    html is joined back by digest for the unequal pairs, each pair of contents once.
    """
    whole = pages.select("page_id", "site", "page_no", "html", F.sha2(F.col("html").cast("binary"), 256).alias("digest"))
    keyed = whole.select("page_id", "site", "page_no", "digest", F.floor(F.col("page_no") / RANGE).alias("part"))
    own = F.struct("page_no", "page_id", "digest")
    lasts = keyed.groupBy("site", "part").agg(F.max(own).alias("last"))
    carried = lasts.select(F.col("site").alias("at_site"), F.col("part").alias("at_part"), F.lag("last").over(W.partitionBy("site").orderBy("part")).alias("carried"))
    lagged = keyed.withColumn("previous", F.lag(own).over(W.partitionBy("site", "part").orderBy("page_no", "page_id", "digest")))
    paired = lagged.join(carried, F.col("site").eqNullSafe(F.col("at_site")) & F.col("part").eqNullSafe(F.col("at_part")), "left")
    before = F.when(F.col("previous").isNotNull(), F.col("previous.digest")).otherwise(F.col("carried.digest"))
    paired = paired.select("page_id", "digest", before.alias("before")).filter("before IS NOT NULL")
    unequal = paired.filter("digest <> before").select("digest", "before").distinct()
    contents = whole.filter("digest IS NOT NULL").select("digest", "html").dropDuplicates(["digest"])
    texts = unequal.join(contents, "digest").join(contents.select(F.col("digest").alias("before"), F.col("html").alias("before_html")), "before")
    counted = texts.select("digest", "before", "html", "before_html").mapInArrow(_differing, "digest string, before string, n long")
    same = F.col("digest") == F.col("before")
    return paired.join(counted, ["digest", "before"], "left").select("page_id", same.alias("same"), F.when(same, 0).otherwise(F.col("n")).cast("long").alias("differing"))


def body_shapes(bodies: DataFrame) -> DataFrame:
    """body_id, shape, n, keys, listing_key, listing_size.

    shape: (empty), array, object or (non-JSON). keys: of an array's first item the first five, of an object the first
    eight, or six if some look like those of listings: then listing_key is the last such one and listing_size the
    length of its list (null if it isn't one). n: items of an array.
    """
    body = F.col("body")
    size, keys = F.json_array_length(body), F.json_object_keys(body)
    shape = F.when(F.trim(body) == "", "(empty)").when(size.isNotNull(), "array").when(keys.isNotNull(), "object").otherwise("(non-JSON)")
    like = F.try_element_at(F.filter(keys, lambda k: F.lower(k).rlike("|".join(LISTING_KEYS))), F.lit(-1))
    first = F.slice(F.json_object_keys(F.get_json_object(body, "$[0]")), 1, 5)
    shown = F.when(size.isNotNull(), first).when(like.isNotNull(), F.slice(keys, 1, 6)).otherwise(F.slice(keys, 1, 8))
    held = F.try_element_at(F.from_json(body, "map<string,string>"), like)
    return bodies.select("body_id", shape.alias("shape"), F.coalesce(size, F.lit(0)).cast("long").alias("n"), F.coalesce(F.array_join(shown, ","), F.lit("")).alias("keys"), like.alias("listing_key"), F.json_array_length(held).cast("long").alias("listing_size"))


def schema_profile(bodies: DataFrame) -> DataFrame:
    """host, shape, n, schema: the merged schema of a host's objects, arrays and other JSON bodies (url, body).

    What differs in type by body is VARIANT. Schemas are merged where the bodies lie before they are shuffled. Bodies
    that aren't JSON have the shape `none` and no schema.
    """
    v, head = F.try_parse_json("body"), F.substring(F.ltrim("body"), 1, 1)
    shape = F.when(v.isNull(), "none").when(head == "{", "object").when(head == "[", "array").otherwise("scalar")
    host = F.regexp_extract("url", r"^https?://([^/?#]+)", 1)
    merged = bodies.select(host.alias("host"), shape.alias("shape"), v.alias("v")).groupBy("host", "shape").agg(F.count("*").alias("n"), F.schema_of_variant_agg("v").alias("schema"))
    return merged.withColumn("schema", F.when(F.col("shape") != "none", F.col("schema")))


def state_blobs(pages: DataFrame) -> DataFrame:
    """page_id, keys, n_urls, n_prices of the page's embedded state."""
    blob = F.regexp_extract("html", r'(?s)<script id="__NEXT_DATA__"[^>]*>(.*?)</script>', 1)
    found = pages.select("page_id", blob.alias("blob")).filter("blob <> ''")
    return found.select("page_id", F.array_join(F.json_object_keys("blob"), ",").alias("keys"), F.regexp_count("blob", F.lit(r'"url":"[^"]*"')).cast("long").alias("n_urls"), F.regexp_count("blob", F.lit(r'"price":[0-9.]+')).cast("long").alias("n_prices"))
