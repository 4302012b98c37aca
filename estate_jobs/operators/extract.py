"""From crawled pages and JSON bodies to listing rows. All but `cards` are column expressions."""

from __future__ import annotations

import html.parser
import re
import urllib.parse
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from estate_jobs.functions.columns import S, nz
from estate_jobs.functions.markup import content_of, elements, values_of
from estate_jobs.functions.params import ENERGY_CLASSES, EXCLUDED, LD_TYPES, META_FIRST_LABELS, SIZE_LABELS

DETAIL = r"-r\d{6,8}\.html"
ITEM_LISTS = ("items", "results", "adverts", "data", "listings", "offers", "advertisements")


# --- links

@F.pandas_udf(T.StringType())
def _join_url(base: pd.Series, link: pd.Series) -> pd.Series:
    """Relative links that aren't of a plain form; a bad one gives null."""

    def one(b: str | None, x: str | None) -> str | None:
        try:
            return urllib.parse.urljoin(b or "", x) if x is not None else None
        except ValueError:
            return None

    return pd.Series([one(b, x) for b, x in zip(base, link, strict=True)], dtype="object")


def resolve(base: Column, link: Column) -> Column:
    """Absolute form of a link. Absolute, //host and /path links need no Python."""
    root = F.regexp_extract(base, r"^(https?://[^/?#]+)", 1)
    plain = F.when(link.rlike("^https?://"), link).when(link.startswith("//"), F.concat(F.lit("https:"), link)).when(link.rlike("^/(?!.*/\\.\\.?(/|$))"), F.concat(root, link))
    return F.coalesce(plain, _join_url(base, link))


def hrefs(pages: DataFrame) -> DataFrame:
    """page_id, url, base, href, position: a row for each distinct link of a page's anchors that leads somewhere.

    Links are relative to the href of the page's first base element, itself relative to its site, else to the root of
    the site.
    """
    root = F.concat(F.regexp_extract("url", r"^(https?://[^/?#]+)", 1), F.lit("/"))
    found = pages.select("page_id", "url", elements(F.col("html"), "a", "base").alias("found"))
    read = found.select("page_id", "url", F.trim(F.get(values_of(F.col("found"), "base", "href"), F.lit(0))).alias("own"), F.transform(values_of(F.col("found"), "a", "href"), lambda x: F.trim(x)).alias("links"))
    own = nz(F.col("own"), "")
    base = F.when(own.isNull(), root).otherwise(resolve(root, own))
    some = F.filter(F.array_distinct("links"), lambda x: ~x.rlike("^(#|javascript:|mailto:|$)"))
    return read.select("page_id", "url", base.alias("base"), F.posexplode(some).alias("position", "href"))


def dom_links(pages: DataFrame, fits: str = "/detail/") -> DataFrame:
    """page_id, url, text, position: the anchors of a page whose link has `fits`, resolved, with their texts (at most 200 characters)."""
    anchor = F.lit(r'(?s)<a\s[^>]*?href="([^"]*)"[^>]*>(.*?)</a>')
    both = F.arrays_zip(F.regexp_extract_all("html", anchor, F.lit(1)).alias("href"), F.regexp_extract_all("html", anchor, F.lit(2)).alias("inner"))
    found = pages.select("page_id", F.col("url").alias("page_url"), F.posexplode(both).alias("position", "a")).filter(F.contains("a.href", F.lit(fits)))
    return found.select("page_id", resolve(F.col("page_url"), F.col("a.href")).alias("url"), F.substring(visible_text(F.col("a.inner")), 1, 200).alias("text"), "position")


def not_excluded(path: Column) -> Column:
    return ~F.lower(path).rlike("|".join(EXCLUDED))


def detail_links(pages: DataFrame, host: str, path_regex: str = DETAIL) -> DataFrame:
    """page_id, link: links of the host whose path fits and isn't excluded, without ? and #, once a page."""
    full = hrefs(pages).withColumn("link", resolve(F.col("base"), F.col("href")))
    path, own = F.try_parse_url("link", F.lit("PATH")), F.coalesce(F.try_parse_url("link", F.lit("HOST")), F.lit(""))
    kept = full.filter(own.contains(host) & path.rlike(path_regex) & not_excluded(path))
    return kept.select("page_id", F.regexp_replace("link", r"[?#].*$", "").alias("link")).dropDuplicates()


def chunk_urls(pages: DataFrame) -> DataFrame:
    """page_id, url, uid, position: /detail/ URLs within pushed script chunks, JSON-unescaped where that works."""
    chunks = F.regexp_extract_all("html", F.lit(r'self\.__next_f\.push\(\[1,"((?:[^"\\]++|\\.)*+)"\]\)'), F.lit(1))
    text = F.array_join(F.transform(chunks, lambda c: F.coalesce(F.get_json_object(F.concat(F.lit('["'), c, F.lit('"]')), "$[0]"), c)), "\n")
    full = F.regexp_extract_all(text, F.lit(r'(https?://[^/"\s]+/detail/[A-Za-z0-9_-]+/[A-Za-z0-9_-]+)'), F.lit(1))
    root = F.regexp_extract("url", r"^(https?://[^/?#]+)", 1)
    short = F.transform(F.regexp_extract_all(text, F.lit(r'(?:^|["\s])(/detail/[A-Za-z0-9_-]+/[A-Za-z0-9_-]+)'), F.lit(1)), lambda x: F.concat(root, x))
    found = pages.select("page_id", F.posexplode(F.array_distinct(F.concat(full, short))).alias("position", "link"))
    return found.select("page_id", F.col("link").alias("url"), F.md5(F.col("link").cast("binary")).alias("uid"), "position")


def by_priority(dom: DataFrame, chunks: DataFrame, api_pages: DataFrame) -> DataFrame:
    """page_id, url, text: the first of equal urls, those with text before those of chunks; none of pages with API items."""
    both = dom.select("page_id", "url", "text", F.lit(0).alias("priority"), "position").unionByName(chunks.select("page_id", "url", F.lit("").alias("text"), F.lit(1).alias("priority"), "position"))
    first = both.join(api_pages.select("page_id").distinct(), "page_id", "left_anti").groupBy("url").agg(F.min_by(F.struct("page_id", "text"), F.struct("priority", "page_id", "position")).alias("row"))
    return first.select("row.page_id", "url", "row.text")


def unseen(links: DataFrame, seen: DataFrame, key: str = "link") -> DataFrame:
    return links.join(seen.select(key).distinct(), key, "left_anti")


# --- fields of pages

def _present(x: Column) -> Column:
    return x.isNotNull() & (x != "")


def _first(values: Column) -> Column:
    return F.get(F.filter(values, _present), F.lit(0))


def _first_of(values: Column) -> Column:
    return F.get(F.filter(values, F.isnotnull), F.lit(0))


def _last(values: Column) -> Column:
    return F.try_element_at(F.filter(values, F.isnotnull), F.lit(-1))


#: The parts of a linked-data object that listings use; nested ones stay JSON texts.
LD_OBJECT = "`@type` string, name string, image string, offers string, address string, floorSize string, numberOfRooms string, numberOfBedrooms string"


def linked_data(html: Column) -> Column:
    """The page's JSON-LD objects of known types, as structs of LD_OBJECT in page order. Each is parsed once."""
    scripts = F.regexp_extract_all(html, F.lit(r'(?s)<script[^>]*application/ld\+json[^>]*>(.*?)</script>'), F.lit(1))
    items = F.flatten(F.transform(scripts, lambda s: F.when(s.rlike(r"^\s*\["), F.coalesce(F.from_json(s, "array<string>"), F.array().cast("array<string>"))).otherwise(F.array(s))))
    objects = F.transform(items, lambda o: F.from_json(o, LD_OBJECT))
    kind = lambda t: F.when(t.startswith("["), F.get_json_object(t, "$[0]")).otherwise(t)
    return F.filter(objects, lambda o: F.coalesce(kind(o["@type"]).isin(*LD_TYPES), F.lit(False)))


def _json(o: Column, *paths: str) -> Column:
    return F.coalesce(*(nz(F.get_json_object(o, p), "") for p in paths))


def _amount(x: Column) -> Column:
    return nz(x.try_cast("double"), 0.0)


def _ld_image(x: Column) -> Column:
    return F.when(x.startswith("{"), F.get_json_object(x, "$.url")).when(x.startswith("["), _json(x, "$[0].url", "$[0]")).otherwise(x)


def ld_fields(objects: Column, first_price: bool = False) -> dict[str, Column]:
    """Title and image of the first of linked_data's objects that has them; size and rooms of the last.

    The sites differ in the rest. The price is the first of price, lowPrice, highPrice of an object's first offer that
    is a number, of the last object that has one; with first_price it is price, or lowPrice where that is missing, of
    the first object. The address is the first object's, with the postal code; with first_price the last one's, without.
    """
    of = lambda f: F.transform(objects, f)
    offers = F.transform(of(lambda o: F.when(o.offers.startswith("["), F.get_json_object(o.offers, "$[0]")).otherwise(o.offers)), lambda x: F.from_json(x, "price string, lowPrice string, highPrice string"))
    keys = ("streetAddress", "addressLocality", "addressRegion", "postalCode")[: 3 if first_price else 4]
    places = F.transform(of(lambda o: o.address), lambda x: F.struct(x.alias("whole"), F.when(x.startswith("{"), F.from_json(x, ", ".join(f"{k} string" for k in keys))).alias("parts")))
    addresses = F.transform(places, lambda p: F.when(p.parts.isNull(), p.whole).otherwise(F.concat_ws(", ", *(nz(p.parts[k], "") for k in keys))))
    some = lambda x: nz(x, "", "0", "0.0")  # noqa: E731  what counts as missing, so that the next one is taken
    if first_price:
        price = _first_of(F.transform(offers, lambda x: _amount(F.coalesce(some(x["price"]), some(x["lowPrice"])))))
        address = _last(F.transform(addresses, lambda a: nz(a, "")))
    else:
        price = _last(F.transform(offers, lambda x: F.coalesce(*(_amount(x[k]) for k in ("price", "lowPrice", "highPrice")))))
        address = _first(addresses)
    return {
        "ld_title": F.substring(_first(of(lambda o: o["name"])), 1, 200),
        "ld_image": _first(of(lambda o: _ld_image(o.image))),
        "ld_address": address,
        "ld_price": price,
        "ld_size": _last(of(lambda o: _amount(F.when(o.floorSize.startswith("{"), F.get_json_object(o.floorSize, "$.value"))))),
        "ld_rooms": _last(of(lambda o: _amount(F.coalesce(some(o.numberOfRooms), o.numberOfBedrooms).try_cast("double").cast("int")))),
    }


def meta(html: Column, name: str) -> Column:
    """Content of the first meta element with that property, in whatever order, case and quotes; null if there is none."""
    return content_of(elements(html, "meta"), name)


# Names that listing sites put after a title, behind a bar or a dash.
SITE_NAMES = r"[Nn]ehnute|(?i:topreality)"


def page_title(html: Column) -> Column:
    """<title> without a site's name and what follows it, at most 200 characters."""
    found = nz(F.regexp_extract(html, r"(?is)<title(?:\s[^>]*)?>(.*?)</title>", 1), "")
    return F.substring(F.trim(F.regexp_replace(found, rf"\s*[|\-]\s*(?:{SITE_NAMES}).*$", "")), 1, 200)


def title(ld_title: Column, og_title: Column, html: Column) -> Column:
    return F.coalesce(nz(ld_title, ""), og_title, page_title(html), F.lit(""))


def visible_text(html: Column) -> Column:
    """Text without scripts, styles, comments and tags; white space in runs of one blank."""
    bare = F.regexp_replace(F.regexp_replace(html, r"(?is)<(?:script.*?</script>|style.*?</style>|!--.*?-->)", " "), r"(?s)<[^>]*>", " ")
    return F.trim(F.regexp_replace(bare, f"{S}+", " "))


def price_from_text(text: Column) -> Column:
    found = F.regexp_extract(text, r"(\d{1,3}(?:[\s\x{00A0}\x{202F}\x{2009}]\d{3})+|\d{4,8})[\s\x{00A0}\x{202F}\x{2009}]*€", 1)
    return F.coalesce(F.regexp_replace(found, S, "").try_cast("double"), F.lit(0.0))


def digits_price(text: Column) -> Column:
    return F.coalesce(F.regexp_replace(text, r"[^0-9]", "").try_cast("double"), F.lit(0.0))


def _number(x: Column) -> Column:
    return F.replace(x, F.lit(","), F.lit(".")).try_cast("double")


def _if(x: Column, fits: Callable[[Column], Column]) -> Column:
    """x where it fits, else null; x is worked out once."""
    return F.get(F.filter(F.array(x), fits), F.lit(0))


def size_from_text(text: Column, title: Column | None = None, labels: tuple[str, ...] = SIZE_LABELS) -> Column:
    """Area after the first label, in order of priority, that has a plausible one; else the first plausible "N m²", else the title's."""
    def labelled(label: str) -> Column:
        v = _number(F.regexp_extract(text, "(?iu)" + label.replace("{s}", S) + r"[^0-9]{0,120}([0-9]{2,4}(?:[.,][0-9]+)?)" + S + r"*(?:m²|m2|m(?![0-9A-Za-z_]))", 1))
        return _if(v, lambda x: (x > 15) & (x < 500))

    any_label = text.rlike("(?iu)plocha|výmera|rozloha")
    cascade = F.when(any_label, F.coalesce(*map(labelled, labels)))
    numbers = F.transform(F.regexp_extract_all(text, F.lit(r"([0-9]{2,4}(?:[.,][0-9]+)?)" + S + "*(?:m²|m2)"), F.lit(1)), _number)
    steps = [cascade, F.get(F.filter(numbers, lambda x: (x > 20) & (x < 300)), F.lit(0))]
    if title is not None:
        v = _number(F.regexp_extract(title, r"([0-9]{2,4}(?:[.,][0-9]+)?)" + S + "*(?:m²|m2)", 1))
        steps.append(_if(v, lambda x: (x > 15) & (x < 500)))
    return F.coalesce(*steps, F.lit(0.0))


def simple_size(text: Column) -> Column:
    return F.coalesce(_number(F.regexp_extract(text, r"([0-9]+(?:[.,][0-9]+)?)\s*m", 1)), F.lit(0.0))


def energy_from_text(text: Column) -> Column:
    found = F.upper(F.regexp_extract(text, r"(?iu)energetick[aá][\s\x{00A0}]+(?:trieda|certifik[\p{L}]*)[^A-Z]{0,30}?(?<![0-9A-Za-z_])([A-G][01]?)(?![0-9A-Za-z_])", 1))
    return F.coalesce(_if(found, lambda x: x.isin(*ENERGY_CLASSES)), F.lit("UNKNOWN"))


def district(address: Column) -> Column:
    return F.coalesce(F.trim(F.split_part(address, F.lit(","), F.lit(-1))), F.lit(""))


def city(district: Column) -> Column:
    return F.split_part(F.trim(district), F.lit(" "), F.lit(1))


def image_url(src: Column, base: str) -> Column:
    return F.when(src.startswith("//"), F.concat(F.lit("https:"), src)).when(src.startswith("/"), F.concat(F.lit(base), src)).otherwise(src)


def details(pages: DataFrame, meta_first: bool = False) -> DataFrame:
    """Listing rows of detail pages (url, html): those with a price or a size. html is dropped at once.

    meta_first: for sites whose og:title, then <title>, precede the linked data, whose image is the og:image alone, that
    have no rooms, and whose linked data is read with first_price.
    """
    html, text = F.col("html"), F.col("text")
    df = pages.select("url", "html").withColumn("ld", linked_data(html)).withColumn("text", visible_text(html)).withColumn("metas", elements(html, "meta"))
    df = df.withColumns(ld_fields(F.col("ld"), meta_first)).drop("ld")
    og_title, og_image = content_of(F.col("metas"), "og:title"), content_of(F.col("metas"), "og:image")
    if meta_first:
        names = {"title": F.substring(F.coalesce(nz(F.trim(og_title), ""), nz(page_title(html), ""), "ld_title", F.lit("")), 1, 200), "image": F.coalesce(og_image, F.lit(""))}
    else:
        names = {"title": title(F.col("ld_title"), og_title, html), "image": F.coalesce(nz(F.col("ld_image"), ""), og_image, F.lit(""))}
    df = df.withColumns(names).drop("html", "metas")
    size = size_from_text(text, labels=META_FIRST_LABELS) if meta_first else size_from_text(text, F.col("title"))
    df = df.withColumns({"price_eur": F.coalesce("ld_price", price_from_text(text)), "size_m2": F.coalesce("ld_size", size), "energy_class": energy_from_text(text), "address_raw": F.coalesce("ld_address", F.lit(""))})
    rooms = F.lit(None).cast("double") if meta_first else F.col("ld_rooms")
    row = F.struct(F.md5(F.col("url").cast("binary")).alias("id"), "url", "title", "price_eur", "size_m2", rooms.alias("rooms"), "energy_class", "address_raw", district(F.col("address_raw")).alias("district"), F.col("image").alias("primary_image_url"))
    # A filter over plain columns would be pushed down with all it needs and read every page twice; one over a generator's output stays.
    return df.select(F.inline(F.array(row))).filter("price_eur > 0 OR size_m2 > 0")


# --- API bodies

#: Of from_json, so that it reads what get_json_object reads.
_LENIENT = {"allowUnquotedControlChars": "true"}
#: What an item holds of which a text may look like an object or a list.
_QUOTED = r"""["'][{\[]|\\\\u00[57]"""


def _members(text: Column) -> Column:
    """The members of a JSON object by name, as texts; null if text is none. The object is read once, whatever is taken from it."""
    return F.from_json(F.when(text.rlike(r"^\s*\{"), text), "map<string,string>", _LENIENT)


def _let(x: Column, use: Callable[[Column], Column]) -> Column:
    """use(x); x is worked out once."""
    return F.get(F.transform(F.array(x), use), F.lit(0))


def item_list(body: Column) -> Column:
    """The body's items as JSON texts: the body itself if it is a list, else the first list that isn't empty, at the top or in data."""
    as_list = lambda j: _if(F.from_json(F.when(j.rlike(r"^\s*\["), j), "array<string>"), lambda x: F.size(x) > 0)
    of = lambda members, keys: (as_list(F.try_element_at(members, F.lit(k))) for k in keys)
    inner = _let(_members(F.get_json_object(body, "$.data")), lambda m: F.coalesce(*of(m, (k for k in ITEM_LISTS if k not in ("data", "offers")))))
    return F.coalesce(as_list(body), _let(_members(body), lambda m: F.coalesce(*of(m, ITEM_LISTS), inner)), F.array().cast("array<string>"))


def listing_bodies(bodies: DataFrame) -> DataFrame:
    """Captured JSON bodies (url, content_type, body) of listing-like URLs."""
    return bodies.filter(F.col("content_type").contains("json") & F.lower("url").rlike("advert|listing|search|inzerat|offer|estate"))


def api_listings(bodies: DataFrame, base: str) -> DataFrame:
    """Listing rows of the items of bodies (body); items without an url or an id are dropped."""
    item, of = F.col("item"), lambda members, k: F.try_element_at(members, F.lit(k))
    within = {k: F.when(of("top", k).startswith("{"), F.when(F.col("quoted"), F.from_json(item, f"{k} map<string,string>", _LENIENT)[k]).otherwise(_members(of("top", k)))) for k in ("price", "priceInfo", "parameters", "location", "address")}

    def at(path: str) -> Column:
        _, *parents, k = path.split(".")
        return of(parents[0] if parents else "top", k)

    def first(k: str) -> Column:
        """Address of the first of a list of images: texts, or objects with url or src."""
        paths = F.filter(F.array(*(F.get_json_object(item, f"$.{k}[0]{x}") for x in (".url", ".src", ""))), lambda x: ~x.isin("", "null"))
        read = _let(F.get(F.from_json(of("top", k), "array<string>"), F.lit(0)), lambda x: F.when(x.startswith("{"), _let(_members(x), lambda m: F.coalesce(nz(of(m, "url"), ""), nz(of(m, "src"), ""), x))).otherwise(nz(x, "")))
        return F.when(of("top", k).startswith("["), F.when(F.col("quoted"), F.get(paths, F.lit(0))).otherwise(read))

    number = lambda *paths: F.coalesce(*(nz(at(p).try_cast("double"), 0.0) for p in paths), F.lit(0.0))
    text = lambda *paths: F.coalesce(*(nz(at(p), "") for p in paths))
    link = F.coalesce(text("$.url", "$.seoUrl", "$.link"), F.concat(F.lit("/nehnutelnost/"), nz(text("$.id", "$.advertId"), "0"), F.lit("/")))
    url = F.when(F.col("link").startswith("http"), F.col("link")).otherwise(F.concat(F.lit(base), F.when(F.col("link").startswith("/"), "").otherwise("/"), "link"))
    sizes = [f"{p}.{k}" for k in ("usableArea", "floorArea", "area", "size") for p in ("$", "$.parameters")]
    address = text("$.location.fullAddress", "$.location.address", "$.location.city", "$.address.fullAddress", "$.address.address", "$.address.city")
    plain = F.coalesce(*(F.when(~v.startswith("{"), v) for v in (text("$.location"), text("$.address"))))
    energy = F.col("energy")
    df = bodies.select(F.explode(item_list(F.col("body"))).alias("item")).withColumns({"top": _members(item), "quoted": item.rlike(_QUOTED)}).withColumns(within)
    df = df.withColumns({"link": link, "energy": F.upper(text("$.energyRating", "$.energyClass"))}).withColumn("url", url)
    row = F.struct(
        F.md5(F.col("url").cast("binary")).alias("id"), "url", F.substring(F.coalesce(text("$.title", "$.name", "$.heading"), F.lit("")), 1, 200).alias("title"),
        number("$.price.value", "$.price.amount", "$.price", "$.priceInfo.value", "$.priceInfo.amount", "$.priceInfo").alias("price_eur"), number(*sizes).alias("size_m2"), F.coalesce(address, plain, F.lit("")).alias("address_raw"),
        F.when(energy.isin(*ENERGY_CLASSES), energy).otherwise("UNKNOWN").alias("energy_class"), F.coalesce(first("images"), first("photos"), F.lit("")).alias("primary_image_url"),
    )
    # As in details: a filter over plain columns would be pushed down and read every item twice.
    return df.select(F.inline(F.array(row))).filter("url IS NOT NULL")


# --- cards: the one place where a page's structure needs a parser

class _Node(NamedTuple):
    tag: str
    attrs: dict[str, str]
    #: Place of the parent in the page's nodes, and first piece of text.
    parent: int
    begin: int


class _Cards(html.parser.HTMLParser):
    """Cards of one page: div.inzeratyflex with parts inzeratynadpis, inzeratycena, inzeratylok.

    On a page without such a div each link to a listing is taken once, with the nearest card-like element around it.
    What is still open at the end of the page ends there.
    """

    VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
    LEVELS = 6

    def __init__(self) -> None:
        super().__init__()
        self.nodes, self.ends, self.stack, self.pieces = [_Node("", {}, -1, 0)], {}, [0], []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.nodes.append(_Node(tag, {k: v or "" for k, v in attrs}, self.stack[-1], len(self.pieces)))
        k = len(self.nodes) - 1
        if tag in self.VOID:
            self.ends[k] = (len(self.pieces), k + 1)
        else:
            self.stack.append(k)

    def handle_endtag(self, tag: str) -> None:
        if any(self.nodes[k].tag == tag for k in self.stack):
            while True:
                k = self.stack.pop()
                self.ends[k] = (len(self.pieces), len(self.nodes))
                if self.nodes[k].tag == tag:
                    break

    def handle_data(self, data: str) -> None:
        self.pieces.append(data)

    def _end(self, k: int) -> tuple[int, int]:
        """Ends (exclusive) of a node's pieces of text and of the nodes within it."""
        return self.ends.get(k, (len(self.pieces), len(self.nodes)))

    def _text(self, k: int | None) -> str:
        return "" if k is None else " ".join(" ".join(self.pieces[self.nodes[k].begin : self._end(k)[0]]).split())

    def _first(self, k: int, fits: Callable[[_Node, str], bool]) -> int | None:
        """First node within node k that fits (the node and its classes)."""
        return next((j for j in range(k + 1, self._end(k)[1]) if fits(self.nodes[j], self.nodes[j].attrs.get("class", ""))), None)

    def _card(self, k: int, link: int, title: int | None, price: int | None, place: int | None) -> dict[str, str]:
        img = self._first(k, lambda n, _: n.tag == "img" and bool(n.attrs.get("src")))
        return {"href": self.nodes[link].attrs["href"], "link_text": self._text(title), "card_text": self._text(k), "price_text": self._text(price), "loc_text": self._text(place), "img": "" if img is None else self.nodes[img].attrs["src"]}

    def _around(self, link: int) -> int | None:
        """As in the reference: where no element is card-like within six levels, the next one, if there is one."""
        k = self.nodes[link].parent
        for _ in range(self.LEVELS):
            if k < 0:
                return None
            name = self.nodes[k].attrs.get("class", "")
            if "inzeratyflex" in name or "inzerat" in name and self.nodes[k].tag == "div":
                break
            k = self.nodes[k].parent
        return k if k >= 0 else None

    def cards(self) -> list[dict[str, str]]:
        is_link = lambda n, _="": n.tag == "a" and "/inzerat/" in n.attrs.get("href", "")
        part = lambda name: lambda _, classes: name in classes.split()
        found = [k for k, n in enumerate(self.nodes) if n.tag == "div" and "inzeratyflex" in n.attrs.get("class", "").split()]
        if found:
            linked = [(k, self._first(k, is_link)) for k in found]
            return [self._card(k, link, *(self._first(k, part(p)) for p in ("inzeratynadpis", "inzeratycena", "inzeratylok"))) for k, link in linked if link is not None]
        links = {}
        for j, n in enumerate(self.nodes):
            if is_link(n):
                links.setdefault(n.attrs["href"], j)
        priced = lambda _, classes: "cena" in classes
        placed = lambda n, classes: n.tag == "div" and "inzeratylok" in classes.split() or "lokalita" in classes or "mesto" in classes
        around = [(j, self._around(j)) for j in links.values()]
        return [self._card(k, j, j, self._first(k, priced), self._first(k, placed)) for j, k in around if k is not None]


def _parse_cards(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for page_id, text in zip(pdf["page_id"], pdf["html"], strict=True):
            parser = _Cards()
            parser.feed(text or "")
            parser.close()
            rows += [{"page_id": page_id, **c} for c in parser.cards()]
        yield pd.DataFrame(rows, columns=["page_id", "href", "link_text", "card_text", "price_text", "loc_text", "img"])


def cards(pages: DataFrame, base: str) -> DataFrame:
    """Listing rows of pages (page_id, html): one for each card with a listing link; on a page without cards, one for each listing link."""
    found = pages.select("page_id", "html").mapInPandas(_parse_cards, "page_id long, href string, link_text string, card_text string, price_text string, loc_text string, img string")
    url = F.when(F.col("href").startswith("http"), F.col("href")).otherwise(F.concat(F.lit(base), F.col("href")))
    own = digits_price(F.col("price_text"))
    fallback = F.coalesce(F.regexp_replace(F.regexp_extract("card_text", r"([0-9][0-9\s]{3,})\s*(?:€|EUR)", 1), r"\s", "").try_cast("double"), F.lit(0.0))
    return found.select("page_id", F.md5(url.cast("binary")).alias("id"), url.alias("url"), F.coalesce(nz(F.col("link_text"), ""), F.substring("card_text", 1, 80)).alias("title"), F.when(own > 0, own).otherwise(fallback).alias("price_eur"), simple_size(F.col("card_text")).alias("size_m2"), F.col("loc_text").alias("address_raw"), district(F.col("loc_text")).alias("district"), image_url(F.col("img"), base).alias("primary_image_url"))


# --- enrichment

def overlay(listings: DataFrame, details: DataFrame, unpriced: bool = False) -> DataFrame:
    """listings with what details (same ids) know: title only where it is blank, the rest wherever it is present.

    unpriced: only listings without a price take anything.
    """
    new = details.select("id", *(F.col(c).alias(f"new_{c}") for c in details.columns if c != "id"))
    missing = {"price_eur": 0.0, "size_m2": 0.0, "energy_class": "UNKNOWN", "rooms": 0}

    def rule(c: str) -> Column:
        if f"new_{c}" not in new.columns:
            return F.col(c)
        fresh = F.col(f"new_{c}")
        if c == "title":
            merged = F.coalesce(nz(F.col(c), ""), F.substring(fresh, 1, 200))
        else:
            merged = F.coalesce(nz(fresh, missing[c]) if c in missing else nz(fresh, ""), F.col(c))
        return F.when(F.coalesce("price_eur", F.lit(0.0)) == 0, merged).otherwise(F.col(c)) if unpriced else merged

    return listings.join(new, "id", "left").select(*(rule(c).alias(c) for c in listings.columns))


def backlog(listings: DataFrame, source: str, n: int = 200) -> DataFrame:
    """The newest n active listings of a source without a price or a size."""
    return listings.filter((F.col("source") == source) & (F.col("is_active") == 1) & ((F.col("price_eur") == 0) | (F.col("size_m2") == 0))).orderBy(F.desc("scraped_at"), "id").limit(n)


def gains(before: DataFrame, after: DataFrame) -> DataFrame:
    both = before.select("id", F.col("price_eur").alias("p0"), F.col("size_m2").alias("s0")).join(after.select("id", "price_eur", "size_m2"), "id")
    return both.agg(F.count_if((F.col("p0") <= 0) & (F.col("price_eur") > 0)).alias("gained_price"), F.count_if((F.col("s0") <= 0) & (F.col("size_m2") > 0)).alias("gained_size"))
