"""Tables of this domain as SQL over the driver's tables; the same text runs in Spark and in DuckDB."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from estate_jobs.sources.tables import durable, spread

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
#: Tables that queries do much with for each row.
LARGE = ("orders", "documents", "pages", "events")
_DISTRICTS = ("Bratislava I", "Bratislava II", "Bratislava III", "Bratislava IV", "Bratislava V", "Košice I", "Košice II", "Košice III", "Žilina", "Nitra", "Trnava", "Trenčín", "Prešov", "Banská Bystrica", "Martin", "Poprad", "Ružomberok", "Liptovský Mikuláš", " žilina ", "Nové Mesto nad Váhom", "Šurany", "Zvolen", "Košice IV", "Voderady", "")

LISTINGS = f"""
SELECT o.o_orderkey AS okey, md5(CAST(o.o_orderkey AS STRING)) AS id, 'src' || CAST(o.o_orderkey % 3 AS STRING) AS source, 'https://reality.example/' || CAST(o.o_orderkey AS STRING) AS url,
 'Byt ' || CAST(o.o_orderkey AS STRING) AS title,
 CASE WHEN o.o_orderkey % 17 = 0 THEN CAST(0 AS DOUBLE) ELSE CAST(o.o_totalprice AS DOUBLE) / 3 END AS price_eur,
 CASE WHEN o.o_orderkey % 23 = 0 THEN CAST(0 AS DOUBLE) ELSE CAST(20 + (o.o_orderkey * 7) % 131 AS DOUBLE) END AS size_m2,
 d.district, CASE o.o_orderkey % 5 WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN 'C' WHEN 3 THEN 'A1' ELSE 'UNKNOWN' END AS energy_class,
 CASE o.o_orderstatus WHEN 'F' THEN 'REJECTED' WHEN 'O' THEN 'PASS' ELSE 'PENDING' END AS lv_status, 'PENDING' AS classification,
 CASE WHEN o.o_orderkey % 19 = 0 THEN 0 ELSE 1 END AS is_active, o.o_orderdate AS scraped_at, d.district || ' ulica, ' || d.district AS address_raw,
 CASE WHEN o.o_orderkey % 6 <> 5 THEN CAST(48.08 AS DOUBLE) + CAST((o.o_orderkey * 41) % 997 AS DOUBLE) / 7000 END AS lat, CAST(17.03 AS DOUBLE) + CAST((o.o_orderkey * 59) % 991 AS DOUBLE) / 7000 AS lng
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN (VALUES {", ".join(f"({k},'{d}')" for k, d in enumerate(_DISTRICTS))}) AS d(k, district) ON c.c_nationkey = d.k"""

OBSERVATIONS = """
SELECT md5(CAST(user_id AS STRING)) AS id, event_id AS seq, event_type AS source, ts AS last_seen_at,
 CASE WHEN event_type = 'error' THEN CAST(0 AS DOUBLE) ELSE value * 1000 END AS price_eur,
 CASE WHEN event_type = 'view' THEN '' ELSE event_type || ' ' || props END AS title,
 CASE WHEN event_type = 'click' THEN NULL ELSE CAST(event_id % 6 AS INT) END AS rooms,
 CASE WHEN event_type IN ('error','view') THEN 'UNKNOWN' ELSE 'B' END AS energy_class
FROM events"""

PLACES = """
SELECT CAST(c_custkey AS BIGINT) AS poi_id,
 CASE WHEN c_custkey % 64 = 0 THEN 'transit_station' WHEN c_custkey % 64 IN (8, 32) THEN 'grocery_or_supermarket' WHEN c_custkey % 64 IN (16, 40) THEN 'pharmacy' ELSE 'school' END AS type,
 CAST(48.10 AS DOUBLE) + CAST((c_custkey * 37) % 997 AS DOUBLE) / 9970 AS lat, CAST(17.05 AS DOUBLE) + CAST((c_custkey * 53) % 991 AS DOUBLE) / 9910 AS lng
FROM customer WHERE c_custkey % 8 = 0"""

SITES = """
SELECT CAST(s_suppkey AS BIGINT) AS site_id, CAST(48.08 AS DOUBLE) + CAST((s_suppkey * 97) % 991 AS DOUBLE) / 7000 AS lat, CAST(17.03 AS DOUBLE) + CAST((s_suppkey * 83) % 997 AS DOUBLE) / 7000 AS lng, CAST(40 + s_suppkey % 40 AS DOUBLE) AS db FROM supplier"""

DEEDS = """
SELECT doc_id, text || CASE doc_id % 7 WHEN 0 THEN ' Záložné právo' WHEN 1 THEN ' EXEKÚCIA, Tatra banka' WHEN 2 THEN ' konkurz' ELSE '' END AS raw FROM documents"""

_STR = lambda x: f"CAST({x} AS STRING)"
#: A backslash, which the two engines escape differently within quotes.
_B = "chr(92)"
_INT = lambda x: f"CAST(CAST(floor({x}) AS BIGINT) AS STRING)"

#: Detail pages: marks and labels; two in three have linked data, with prices, sizes and rooms in several forms, some a second object, some an og:title.
DETAIL_PAGES = f"""
SELECT okey AS page_id, url, '<html><head><title>Byt ' || trim(district) || CASE okey % 3 WHEN 0 THEN ' | Reality' WHEN 1 THEN ' | Nehnuteľnosti.sk' ELSE ' - topreality.sk' END || '</title><meta property="og:image" content="//img.example/' || {_STR("okey")} || '.jpg">' ||
 CASE WHEN okey % 10 = 0 THEN '<meta property="og:title" content="OG ' || {_STR("okey")} || '">' ELSE '' END || '</head><body>' ||
 CASE WHEN okey % 3 = 0 THEN '' ELSE '<script type="application/ld+json">{{"@type":' || CASE WHEN okey % 2 = 0 THEN '"Apartment"' ELSE '["Place","Thing"]' END || ',"name":"' || title || '","image":["/a.jpg"],"offers":' ||
  CASE okey % 8 WHEN 1 THEN '[{{"lowPrice":"' || {_INT("price_eur")} || '","highPrice":"9"}}]' WHEN 2 THEN '{{"price":"na","lowPrice":"","highPrice":' || {_INT("price_eur")} || '}}' WHEN 3 THEN '{{"price":0,"lowPrice":' || {_INT("price_eur")} || '}}' ELSE '{{"price":' || {_INT("price_eur")} || '}}' END ||
  ',"address":{{"streetAddress":"Ulica ' || {_STR("okey % 90")} || '","addressLocality":"' || trim(district) || '","postalCode":"' || CASE WHEN okey % 4 = 0 THEN '01001' ELSE '' END || '"}},"floorSize":' ||
  CASE okey % 5 WHEN 1 THEN '{{"value":"55.5"}}' WHEN 2 THEN '60' WHEN 3 THEN '{{"value":0}}' ELSE '{{}}' END || ',"numberOfRooms":' || {_STR("okey % 5")} || ',"numberOfBedrooms":' || {_STR("okey % 4")} || '}}</script>' END ||
 CASE WHEN okey % 8 = 5 THEN '<script type="application/ld+json">[{{"@type":"House","name":"Second","offers":[{{"price":777777}}],"address":"Iná 1, Nitra","floorSize":{{"value":44}}}},{{"@type":"BreadcrumbList","name":"No"}}]</script>' ELSE '' END ||
 '<p>Cena: ' || {_STR("100 + okey % 800")} || ' ' || {_STR("100 + okey % 900")} || ' €</p><p>Úžitková plocha: ' || CAST(CAST(size_m2 AS INT) AS STRING) || ' m²</p><p>Energetická trieda ' || energy_class || '</p></body></html>' AS html
FROM ({LISTINGS}) AS l"""

#: API bodies: lists of up to four items of different forms in items, in data.results or bare, empty lists, no JSON, nothing.
BODIES = f"""
SELECT okey AS body_id, 'https://api.example/listing/' || {_STR("okey % 10")} AS url, CASE WHEN okey % 11 = 0 THEN 'text/html' ELSE 'application/json' END AS content_type,
 CASE WHEN okey % 26 = 0 THEN ' ' WHEN okey % 26 = 13 THEN 'oops ' || {_STR("okey")} ELSE CASE okey % 4 WHEN 0 THEN '{{"a":1,"items":[' || one || ',' || two || ',' || three || ',{{"title":"no link"}}],"page":2}}' WHEN 1 THEN '{{"data":{{"results":[' || one || ']}}}}' WHEN 2 THEN '[' || two || ',' || three || ']' ELSE '{{"total":0,"items":[],"adverts":[]}}' END END AS body
FROM (SELECT okey, '{{"id":' || {_STR("okey")} || ',"title":"' || title || '","price":{{"value":' || {_INT("price_eur")} || '}},"parameters":{{"area":' || CAST(CAST(size_m2 AS INT) AS STRING) || '}},"location":{{"city":"' || trim(district) || '"}},"energyClass":"' || lower(energy_class) || '"}}' AS one,
  '{{"advertId":"a' || {_STR("okey")} || '","name":"Dom ' || {_STR("okey")} || '","price":' || {_INT("price_eur")} || ',"floorArea":0,"parameters":{{"floorArea":' || CAST(CAST(size_m2 AS INT) AS STRING) || '}},"area":999,"address":{{"fullAddress":"Ulica 1, ' || trim(district) || '"}},"energyRating":"zz","images":[{{"url":"//i.example/' || {_STR("okey")} || '.jpg"}}]}}' AS two,
  '{{"seoUrl":"byt/' || {_STR("okey")} || '","heading":"Byt na predaj","priceInfo":{{"amount":' || {_INT("price_eur")} || '}},"usableArea":"70.5","location":"Nitra","photos":["/p.jpg"]}}' AS three FROM ({LISTINGS}) AS l) AS i"""

#: Result pages: two cards (one without a marked price, with an absolute link), or a bare link in a card of another kind.
CARD_PAGES = f"""
SELECT okey AS page_id, CASE WHEN okey % 5 = 0 THEN '<div class="inzerat box"><a href="/inzerat/' || {_STR("okey")} || '/">' || title || '</a><span class="cena">' || {_INT("price_eur")} || ' €</span><p class="lokalita">Ulica, ' || trim(district) || '</p>Rozmer ' || CAST(CAST(size_m2 AS INT) AS STRING) || ' m2<img src="//img.example/' || {_STR("okey")} || '.jpg"></div>'
 ELSE '<div class="inzeratyflex"><img src="/i/' || {_STR("okey")} || '.jpg"><div class="inzeratynadpis"><a href="/inzerat/' || {_STR("okey")} || '/">' || title || '</a></div><div class="popis">Byt ' || CAST(CAST(size_m2 AS INT) AS STRING) || ' m2</div><div class="inzeratycena"><b>' || {_INT("price_eur")} || ' €</b></div><div class="inzeratylok">Ulica, ' || trim(district) || '</div></div>' ||
  '<div class="inzeratyflex"><div class="inzeratynadpis"><a href="https://other.example/inzerat/' || {_STR("okey")} || '-b/">Druhý ' || title || '</a></div><div class="popis">Cena 12' || {_STR("100 + okey % 900")} || ' EUR</div><div class="inzeratylok">' || trim(district) || '</div></div>' END AS html FROM ({LISTINGS}) AS l"""

#: Pages with links in the text and pushed script chunks: links of their own, of both, of many pages, escaped, absolute.
CHUNK_PAGES = f"""
SELECT okey AS page_id, url, CASE WHEN okey % 3 = 0 THEN '' ELSE '<p><a class="x" href="/detail/a/' || {_STR("okey")} || '">Byt <b>' || {_STR("okey")} || '</b></a></p>' END || '<a href="https://reality.example/detail/s/' || {_STR("okey % 100")} || '">spolu</a><a href="/iny/1">x</a>' ||
 '<script>self.__next_f.push([1,"x ' || {_B} || '"/detail/a/' || {_STR("okey")} || {_B} || '" ' || {_B} || 'u0022https://r.example/detail/b/' || {_STR("okey")} || {_B} || 'u0022"])</script><script>self.__next_f.push([1,"' || {_B} || '"/detail/s/' || {_STR("okey % 100")} || {_B} || '" ' || {_B} || '"/detail/c/' || {_STR("okey % 500")} || {_B} || '""])</script>' AS html
FROM ({LISTINGS}) AS l"""

#: The driver's pages with links, scripts and state of listing sites.
SITE_PAGES = f"""
SELECT page_id, url, html || CASE page_id % 6 WHEN 0 THEN '<a href="/detail/' || {_STR("page_id")} || '">d</a><a href="/pekny-byt-v-centre-mesta-' || {_STR("page_id")} || '">b</a><a href="/x/' || {_STR("1000000 + page_id")} || '">n</a><script src="/static/app' || {_STR("page_id % 3")} || '.js?v=1"></script>'
 WHEN 1 THEN '<script>fetch("/api/v1/adverts/' || {_STR("page_id")} || '");var q=`/x/GraphQL/' || {_STR("page_id % 40")} || '`;</script>'
 WHEN 2 THEN '<script>window.__STATE' || {_STR("page_id % 9")} || '__ = {{"a":[1,2,3],"b":"c"}};advertId=' || {_STR("1000000 + page_id")} || ' listingId:"' || {_STR("2000000 + page_id % 77")} || '" var apiUrl = "https://api.example/v' || {_STR("page_id % 50")} || '";</script>'
 WHEN 3 THEN '<script src="https://googletag.example/main.js"></script><script async src="/_next/static/chunks/' || {_STR("page_id")} || '.js"></script><script>"/_next/static/pages/p.js"</script><a href="/inzerat/' || {_STR("page_id")} || '/">x</a>'
 WHEN 4 THEN '<script>var u="/search/byty/' || {_STR("page_id")} || '"; apolloState initialState __NUXT__</script><a href="/nehnutelnost/vysledky/1/detail">x</a> 123456 € 98765  € 3-izbový Bratislava' ELSE '<nav><a class="p" href="/inzeraty?p=2"> Ďalšia </a><a href="/vypis/stranka-3">3</a><a href="/x#y">next</a><a href="/z">»</a></nav><script>{{"advertId": ' || {_STR("3000000 + page_id")} || ', "id" : "' || {_STR("4000000 + page_id % 50")} || '", listingId = ' || chr(39) || {_STR("5000000 + page_id")} || chr(39) || '}}</script>' END AS html
FROM pages"""

#: Script bundles of the pages above, with addresses of every label and some that are left out; one in nine wasn't fetched.
BUNDLES = f"""
SELECT split_part(url, '/', 1) || '//' || split_part(url, '/', 3) || '/_next/static/chunks/' || {_STR("page_id")} || '.js' AS url, CASE WHEN page_id % 9 = 0 THEN 404 ELSE 200 END AS status,
 'fetch("/api/v2/items/' || {_STR("page_id")} || '");axios.get("/v1/adverts/' || {_STR("page_id % 40")} || '");var a="https://www.nehnutelnosti.sk/detail/' || {_STR("page_id")} || '",b=`https://api.nehnutelnosti.sk/x' || {_STR("page_id % 5")} || '`,c="https://x.example/search?p=' || {_STR("page_id % 60")} || '",d="/graphql/q' || {_STR("page_id % 3")} || '",e="/api/static/logo.png",f="https://www.google.com/search/adverts",g="/v9/x";axios.post("/_next/image?u=1");fetch(`/rest/' || {_STR("page_id % 30")} || '`)' AS js
FROM pages"""

#: Pages with a base and links relative to it, some with the site's root for base; links in all quotes and cases, with
#: entities, and in places where they aren't links.
LINK_PAGES = f"""
SELECT page_id, url, CASE page_id % 3 WHEN 0 THEN '<base href="/subfolder/">' WHEN 1 THEN '<BASE target=_top HREF=' || chr(39) || 'https://www.example.com/base/' || chr(39) || '>' ELSE '' END ||
 '<A title="a > b" HREF="/Velke-' || {_STR("page_id")} || '?a=1&amp;b=2">v</A><a class=x href=/bare-' || {_STR("page_id % 40")} || '>b</a><a data-href="/nope-data" href=' || chr(39) || '/jednoduche&amp;' || {_STR("page_id % 60")} || chr(39) || '>j</a><!-- <a href="/skryte-komentar">x</a> --><script>var a = "<a href=/skryte-skript>";</script><link rel=next href="/linkelement/">' || '<a href="byty-' || {_STR("page_id")} || '.html?x=1">r</a>' || html AS html FROM pages"""

#: Pages with a site's name after the title, or another one, and meta elements of all forms, one of them in a comment.
HEAD_PAGES = f"""
SELECT page_id, replace(html, '</title>', CASE page_id % 6 WHEN 0 THEN ' | Nehnuteľnosti.sk | byty' WHEN 1 THEN ' - TOPREALITY.sk' WHEN 2 THEN ' | Iné reality' WHEN 3 THEN '-nehnutelnosti' ELSE '' END || '</title>' ||
 CASE page_id % 5 WHEN 0 THEN '<meta property="og:title" content="Byt &amp; dom ' || {_STR("page_id")} || '">' WHEN 1 THEN '<META content=' || chr(39) || 'Byt "pekný" > ' || {_STR("page_id")} || chr(39) || ' PROPERTY=' || chr(39) || 'og:title' || chr(39) || '>'
 WHEN 2 THEN '<meta content=byt-' || {_STR("page_id")} || ' property=og:title />' WHEN 3 THEN '<!-- <meta property="og:title" content="skryté"> -->' ELSE '<meta name="x" data-content="nie" content = "Byt &lt; ' || {_STR("page_id")} || '" property = "og:title"><meta property="og:title" content="druhý">' END) AS html
FROM pages"""

#: Rows to seed a table with, in the order of seq: few ids and districts, so that they rule each other out.
SEEDS = f"""
SELECT 's' || {_STR("(okey * 7) % 211")} AS id, trim(district) AS district, CASE WHEN size_m2 < 60 THEN 'small' WHEN size_m2 < 100 THEN 'medium' ELSE 'large' END AS size_band, okey AS seq FROM ({LISTINGS}) AS l"""

DEALS = f"""
SELECT id AS listing_id, CASE WHEN okey % 7 = 0 THEN ' ' ELSE 'Kupec ' || CAST(okey AS STRING) END AS buyer, CASE WHEN okey % 2 = 0 THEN '' ELSE CAST(okey AS STRING) END AS ico, price_eur AS agreed, CAST(2000 AS DOUBLE) AS deposit, okey % 3 = 0 AS escrow, '' AS notary, CASE WHEN okey % 2 = 0 THEN 'personal' ELSE 'sro' END AS structure
FROM ({LISTINGS}) AS l"""


class Tables:
    """The driver's tables of one folder, and SQL over them."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir, self._stored = spark, sf_dir, {}

    def table(self, name: str) -> DataFrame:
        df = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return spread(df) if name in LARGE else df

    def sql(self, text: str) -> DataFrame:
        for name in BASE:
            if re.search(rf"\b(FROM|JOIN) {name}\b", text):
                self.table(name).createOrReplaceTempView(name)
        return self.spark.sql(text)

    def stored(self, name: str) -> DataFrame:
        """A table that a query uses many times, made once."""
        if name not in self._stored:
            self._stored[name] = durable(getattr(self, name))
        return self._stored[name]

    def __getattr__(self, name: str) -> DataFrame:
        adapters = {"listings": LISTINGS, "observations": OBSERVATIONS, "places": PLACES, "sites": SITES, "deeds": DEEDS, "detail_pages": DETAIL_PAGES, "bodies": BODIES, "card_pages": CARD_PAGES, "chunk_pages": CHUNK_PAGES, "site_pages": SITE_PAGES, "bundles": BUNDLES, "link_pages": LINK_PAGES, "head_pages": HEAD_PAGES, "seeds": SEEDS, "deals": DEALS}
        if name not in adapters:
            raise AttributeError(name)
        return self.sql(adapters[name])
