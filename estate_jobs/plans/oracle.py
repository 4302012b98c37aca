"""DuckDB SQL for the registered queries, written for itself and not derived from the Spark plans."""

from __future__ import annotations

import re

from estate_jobs.functions.params import CITIES, DEED_BANKS, DEED_FLAGS, EXCLUDED, INDUSTRIAL_ZONES, RENT_PER_M2, SIZE_LABELS
from estate_jobs.operators.profile import BUNDLE_MINED, DENIED, LISTING_KEYS, MINED, PATTERNS, SCRIPTS_DENIED, SCRIPTS_KEPT
from estate_jobs.operators.serve import DRAFT
from estate_jobs.plans import adapters as A

S = r"[\s\x{00A0}\x{202F}\x{2009}]"


def rnd(x: str, n: int) -> str:
    return f"CAST(round(CAST({x} AS DECIMAL(28,10)), {n}) AS DOUBLE)"


def first_of(x: str, words: tuple[str, ...]) -> str:
    return "CASE " + " ".join(f"WHEN contains({x}, '{w}') THEN '{w}'" for w in words) + " END"


def key(x: str) -> str:
    return f"lower(regexp_replace(coalesce({x}, ''), '^\\s+|\\s+$', '', 'g'))"


ZONE = f"coalesce({first_of(key('district'), INDUSTRIAL_ZONES)}, '')"
RENT = f"""
rates AS (SELECT * FROM (VALUES {", ".join(f"('{k}', {v}::DOUBLE)" for k, v in RENT_PER_M2.items())}) AS r(k, per_m2)),
rented AS (SELECT t.*, {rnd(f"coalesce(r.per_m2, 6.0::DOUBLE) * (CASE WHEN {ZONE} <> '' THEN 1.12::DOUBLE ELSE 1.0::DOUBLE END) * size_m2", 2)} AS estimate FROM todo t LEFT JOIN rates r ON r.k = {key("t.district")})"""


def annuity(loan: str, rate: str, years: str) -> str:
    grow = f"pow(1 + {rate} / 12, {years} * 12)"
    return f"CASE WHEN {loan} <= 0 THEN 0.0::DOUBLE WHEN {rate} = 0 THEN {loan} / ({years} * 12) ELSE {loan} * (({rate} / 12) * {grow}) / ({grow} - 1) END"


HOA = "CASE WHEN size_m2 < 40 THEN 35.0::DOUBLE WHEN size_m2 <= 70 THEN 60.0::DOUBLE WHEN size_m2 <= 120 THEN 90.0::DOUBLE ELSE 130.0::DOUBLE END"
TAX_P = "CASE WHEN gain <= 0 THEN 0.0::DOUBLE WHEN gain <= 41445 THEN gain * 0.19::DOUBLE ELSE 41445 * 0.19::DOUBLE + (gain - 41445) * 0.25::DOUBLE END"
PARTS = f"""{RENT},
a AS (SELECT *, coalesce(nullif(override, 0), estimate) AS rent, price_eur * ltv AS loan, price_eur * (1 - ltv) AS equity, {HOA} AS hoa, price_eur * 0.004::DOUBLE / 12 AS ptax, price_eur * 0.01::DOUBLE / 12 AS maint FROM rented),
b AS (SELECT *, {annuity("loan", "rate", "years")} AS mortgage, rent * 0.05::DOUBLE AS vacancy FROM a),
c AS (SELECT *, mortgage + hoa + ptax + vacancy + maint AS operating FROM b),
d AS (SELECT *, greatest((rent - operating) * 12, 0.0::DOUBLE) AS gain FROM c),
e AS (SELECT *, {TAX_P} / 12 AS tax_p, gain * 0.16::DOUBLE / 12 AS levy_p, greatest(gain * 0.21::DOUBLE, 0.0::DOUBLE) / 12 AS tax_s FROM d),
f AS (SELECT *, operating + tax_p + levy_p AS total_p, operating + tax_s AS total_s FROM e),
g AS (SELECT *, rent - total_p AS surplus_p, rent - total_s AS surplus_s, CASE WHEN total_p > 0 THEN rent / total_p ELSE 0 END AS ratio_p, CASE WHEN total_s > 0 THEN rent / total_s ELSE 0 END AS ratio_s FROM f),
h AS (SELECT *, (surplus_s - surplus_p) * 12 AS saving, CASE WHEN ratio_s >= 1.15::DOUBLE THEN 'GREEN' WHEN ratio_s >= 1.05::DOUBLE THEN 'YELLOW' ELSE 'WHITE' END AS cls FROM g),
i AS (SELECT *, CASE WHEN saving > 0 THEN CAST(ceil(2500.0::DOUBLE / (saving / 12)) AS INT) END AS months, printf('%.1f', CAST(round(CAST(ratio_s * 100 AS DECIMAL(28,10)), 1) AS DOUBLE)) AS pct FROM h)"""
_MONEY = {"rent_estimate": "rent", "mortgage_monthly": "mortgage", "hoa_monthly": "hoa", "property_tax_monthly": "ptax", "vacancy_cost": "vacancy", "maintenance_monthly": "maint", "income_tax_personal": "tax_p", "health_levy_personal": "levy_p", "total_personal": "total_p", "surplus_personal": "surplus_p", "income_tax_sro": "tax_s", "total_sro": "total_s", "surplus_sro": "surplus_s", "annual_sro_saving": "saving"}
_SHARES = {"ratio_personal": "ratio_p", "ratio_sro": "ratio_s", "cash_on_cash": "CASE WHEN equity > 0 THEN surplus_s * 12 / equity ELSE 0 END", "net_rental_yield": "CASE WHEN price_eur > 0 THEN surplus_s * 12 / price_eur ELSE 0 END", "gross_rental_yield": "CASE WHEN price_eur > 0 THEN rent * 12 / price_eur ELSE 0 END"}
SCORE_COLUMNS = f"""id AS listing_id, {", ".join(f"{rnd(b, 2)} AS {a}" for a, b in _MONEY.items())}, {", ".join(f"{rnd(b, 4)} AS {a}" for a, b in _SHARES.items())}, 0.0::DOUBLE AS health_levy_sro,
 CASE WHEN saving >= 0 THEN 'SRO' ELSE 'PERSONAL' END AS optimal_structure, months AS break_even_months, cls AS classification,
 concat_ws(' ', CASE cls WHEN 'GREEN' THEN '🟢 GREEN — self-funding via s.r.o. (ratio ' || pct || '%). Hold 20+ years.' WHEN 'YELLOW' THEN '🟡 YELLOW — yield play (ratio ' || pct || '%). Strong income asset.' ELSE '⚪ WHITE — below threshold (' || pct || '%). Flip or pass.' END,
  CASE WHEN saving > 0 THEN 's.r.o. saves €' || format('{{:,}}', CAST(round(CAST(saving AS DECIMAL(28,10)), 0) AS BIGINT)) || '/yr vs personal. Setup cost recovered in ' || CAST(months AS VARCHAR) || ' months.' ELSE 'Personal ownership marginally better — low income band.' END,
  CASE WHEN {ZONE} <> '' THEN '⚙️ Industrial zone premium applied (' || district || ').' END) AS recommendation,
 CAST({ZONE} <> '' AS INT) AS is_industrial, rate AS mortgage_rate_used, ltv AS ltv_used, CAST(years AS INT) AS loan_term_years"""
READY = "lv_status <> 'REJECTED' AND price_eur > 0 AND size_m2 > 0 AND is_active = 1"
_TERMS = "NULL::DOUBLE AS override, 0.8::DOUBLE AS ltv, 0.034::DOUBLE AS rate, 25 AS years"


def scored(where: str = READY, columns: str = SCORE_COLUMNS, terms: str = _TERMS, more: str = "") -> str:
    return f"WITH l AS ({A.LISTINGS}), todo AS (SELECT l.*, {terms} FROM l {more} WHERE {where}), {PARTS} SELECT {columns} FROM i"


#: Listings that have a score already, in queries that need some.
HAS_SCORE = "okey % 4 = 0"

_CITY = lambda k: "CASE " + " ".join(f"WHEN contains(lower(address_raw), '{c[0]}') THEN {c[k]}::DOUBLE" for c in CITIES) + " END"
HAV = "6371000.0::DOUBLE * 2 * atan2(sqrt(h), sqrt(1 - h))"


def _h(a: str, b: str) -> str:
    return f"pow(sin(radians({b}.lat - {a}.lat) / 2), 2) + cos(radians({a}.lat)) * cos(radians({b}.lat)) * pow(sin(radians({b}.lng - {a}.lng) / 2), 2)"


AROUND = f"""
l AS ({A.LISTINGS}), p AS ({A.PLACES}), pts AS (SELECT * FROM (SELECT id, CASE WHEN lat IS NULL THEN {_CITY(1)} ELSE lat END AS lat, CASE WHEN lat IS NULL THEN {_CITY(2)} ELSE lng END AS lng, district, energy_class FROM l WHERE lv_status = 'PASS' AND is_active = 1) WHERE lat IS NOT NULL),
near AS (SELECT id, type, {HAV} AS distance FROM (SELECT pts.id, p.type, {_h("pts", "p")} AS h FROM pts JOIN p ON abs(pts.lat - p.lat) < 0.02::DOUBLE AND abs(pts.lng - p.lng) < 0.03::DOUBLE) WHERE {HAV} <= 2000),
found AS (SELECT id, min(CASE WHEN type = 'transit_station' THEN distance END) AS transit, count(*) FILTER (type = 'grocery_or_supermarket' AND distance <= 800) AS grocery_or_supermarket, count(*) FILTER (type = 'pharmacy' AND distance <= 800) AS pharmacy, count(*) FILTER (type = 'school' AND distance <= 800) AS school FROM near GROUP BY id),
around AS (SELECT pts.*, {rnd("coalesce(transit, 9999.0::DOUBLE)", 1)} AS nearest_transit_m, coalesce(grocery_or_supermarket, 0) AS grocery_or_supermarket, coalesce(pharmacy, 0) AS pharmacy, coalesce(school, 0) AS school, coalesce(grocery_or_supermarket, 0) + coalesce(pharmacy, 0) + coalesce(school, 0) AS amenity_count FROM pts LEFT JOIN found USING (id)),
s AS ({A.SITES}), risky AS (SELECT DISTINCT id FROM (SELECT pts.id, {_h("pts", "s")} AS h FROM pts JOIN s ON abs(pts.lat - s.lat) < 0.02::DOUBLE AND abs(pts.lng - s.lng) < 0.03::DOUBLE) WHERE {HAV} <= 300),
loud AS (SELECT DISTINCT floor(lat / 0.02::DOUBLE) AS cy, floor(lng / 0.03::DOUBLE) AS cx FROM s WHERE db > 65),
heard AS (SELECT id, arg_max(db, (-distance, db)) AS db FROM (SELECT id, db, {HAV} AS distance FROM (SELECT pts.id, s.db, {_h("pts", "s")} AS h FROM pts JOIN s ON abs(pts.lat - s.lat) < 0.02::DOUBLE AND abs(pts.lng - s.lng) < 0.03::DOUBLE)) WHERE distance <= 500 GROUP BY id),
hazards AS (SELECT pts.id, CAST(risky.id IS NOT NULL AS INT) AS construction_risk, CAST(CASE WHEN heard.id IS NULL THEN loud.cy IS NOT NULL ELSE heard.db > 65 END AS INT) AS noise_flag FROM pts LEFT JOIN risky USING (id) LEFT JOIN heard USING (id) LEFT JOIN loud ON floor(pts.lat / 0.02::DOUBLE) = loud.cy AND floor(pts.lng / 0.03::DOUBLE) = loud.cx),
pointed AS (SELECT a.*, construction_risk, noise_flag, CAST(30 * CAST(nearest_transit_m <= 560 AS INT) + 20 * CAST(amenity_count >= 3 AS INT) + 20 * (1 - construction_risk) + 20 * (1 - noise_flag) + 10 * CAST(energy_class IN ('A0','A1','A') AS INT) AS INT) AS pts FROM around a JOIN hazards USING (id)),
location AS (SELECT id AS listing_id, lat, lng, nearest_transit_m, grocery_or_supermarket, pharmacy, school, amenity_count, construction_risk, noise_flag, {ZONE} AS industrial_zone, pts AS location_score, CASE WHEN noise_flag <> 0 THEN 'POOR' WHEN pts >= 75 THEN 'PRIME' WHEN pts >= 45 THEN 'SOLID' ELSE 'STANDARD' END AS location_tier, pts AS walkability_score, 0 AS flood_zone FROM pointed)"""

FEED = f"""WITH {AROUND}, scores AS ({scored()}),
feed AS (SELECT l.id, l.source, l.title, l.price_eur, l.size_m2, l.energy_class, l.lv_status, l.classification, s2.classification AS cf_class, s2.surplus_sro, s2.ratio_sro, s2.is_industrial, nearest_transit_m, amenity_count, construction_risk, noise_flag, location_tier, walkability_score
 FROM l LEFT JOIN scores s2 ON s2.listing_id = l.id LEFT JOIN location ON location.listing_id = l.id WHERE l.is_active = 1 AND l.lv_status <> 'REJECTED')"""

VERDICT = f"CASE WHEN {first_of('low', DEED_FLAGS)} IS NOT NULL AND {first_of('low', DEED_BANKS)} IS NULL THEN {first_of('low', DEED_FLAGS)} END"
DEED = f"deeds AS (SELECT doc_id, {VERDICT} AS flag FROM (SELECT doc_id, lower(raw) AS low FROM ({A.DEEDS})))"
JUDGED = f"""WITH l AS ({A.LISTINGS}), {DEED}, n AS (SELECT count(*) AS n FROM documents),
judged AS (SELECT l.id, CASE WHEN flag IS NOT NULL THEN 'REJECTED' ELSE 'PASS' END AS status, coalesce(flag, '') AS reason, coalesce('LV encumbrance detected: ''' || flag || '''', '') AS detail FROM l CROSS JOIN n LEFT JOIN deeds ON deeds.doc_id = okey % n.n"""

HREFS = "SELECT page_id, url, unnest(list_distinct(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1))) AS href FROM pages"
TEXT = r"trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '[\s\x{00A0}\x{202F}\x{2009}]+', ' ', 'g'))"
PRICE = rf"coalesce(try_cast(regexp_replace(regexp_extract(text, '([0-9]{{1,3}}(?:{S}[0-9]{{3}})+|[0-9]{{4,8}}){S}*€', 1), '{S}', '', 'g') AS DOUBLE), 0)"


def _labelled(label: str) -> str:
    v = f"try_cast(replace(regexp_extract(text, '(?i){label.replace('{s}', S)}[^0-9]{{0,120}}([0-9]{{2,4}}(?:[.,][0-9]+)?){S}*(?:m²|m2|m\\b)', 1), ',', '.') AS DOUBLE)"
    return f"CASE WHEN {v} > 15 AND {v} < 500 THEN {v} END"


SIZE = f"coalesce({', '.join(map(_labelled, SIZE_LABELS))}, list_extract(list_filter(list_transform(regexp_extract_all(text, '([0-9]{{2,4}}(?:[.,][0-9]+)?){S}*(?:m²|m2)', 1), lambda x: try_cast(replace(x, ',', '.') AS DOUBLE)), lambda x: x > 20 AND x < 300), 1), 0)"
ENERGY = "regexp_extract(text, 'Energetická trieda (A0|A1|A|B|C|D|E|F|G)\\b', 1)"
def _json_number(o: str, *paths: str) -> str:
    return "coalesce(" + ", ".join(f"nullif(try_cast(json_extract_string({o}, '{p}') AS DOUBLE), 0)" for p in paths) + ", NULL)"


_PRICES = [f"$.offers{k}.{p}" for k in ("", "[0]") for p in ("price", "lowPrice", "highPrice")]
_FIRST_PRICE = lambda o: f"CASE WHEN coalesce(json_extract_string({o}, '$.offers.price'), json_extract_string({o}, '$.offers[0].price'), '') NOT IN ('', '0') THEN {_json_number(o, '$.offers.price', '$.offers[0].price')} ELSE {_json_number(o, '$.offers.lowPrice', '$.offers[0].lowPrice')} END"
_ADDRESS = lambda o, *keys: f"CASE WHEN json_type({o}, '$.address') = 'OBJECT' THEN concat_ws(', ', {', '.join(f_part(o, k) for k in keys)}) ELSE json_extract_string({o}, '$.address') END"
_ROOMS = lambda o: f"nullif(CAST(CAST(try_cast(coalesce(nullif(nullif(json_extract_string({o}, '$.numberOfRooms'), ''), '0'), json_extract_string({o}, '$.numberOfBedrooms')) AS DOUBLE) AS INT) AS DOUBLE), 0)"


def f_part(o: str, key: str) -> str:
    return f"nullif(json_extract_string({o}, '$.address.{key}'), '')"


#: a and b: the page's first object and the one of its second script.
DETAILS = f"""WITH p AS ({A.DETAIL_PAGES}), t AS (SELECT page_id, url, html, {TEXT} AS text, nullif(regexp_extract(html, '(?s)<script type="application/ld.json">(\\{{.*?)</script>', 1), '') AS a, json_extract(nullif(regexp_extract(html, '(?s)<script type="application/ld.json">(\\[.*?)</script>', 1), ''), '$[0]') AS b,
 regexp_extract(html, '<meta property="og:title" content="([^"]*)"', 1) AS og, trim(regexp_replace(regexp_extract(html, '<title>(.*?)</title>', 1), '(\\| [Nn]ehnute|- topreality).*', '')) AS head, regexp_extract(html, '<meta property="og:image" content="([^"]*)"', 1) AS image FROM p),
 u AS (SELECT *, nullif(coalesce(json_extract_string(a, '$.name'), json_extract_string(b, '$.name')), '') AS name, coalesce({_json_number("b", "$.floorSize.value")}, {_json_number("a", "$.floorSize.value")}) AS ld_size FROM t),
 d AS (SELECT page_id, md5(url) AS id, url, coalesce(name, nullif(og, ''), head) AS title, coalesce({_json_number("b", *_PRICES)}, {_json_number("a", *_PRICES)}, {PRICE}) AS price_eur, coalesce(ld_size, CAST({SIZE} AS DOUBLE)) AS size_m2, coalesce({_ROOMS("b")}, {_ROOMS("a")}) AS rooms, CASE WHEN {ENERGY} = '' THEN 'UNKNOWN' ELSE {ENERGY} END AS energy_class,
  coalesce(nullif({_ADDRESS("a", "streetAddress", "addressLocality", "addressRegion", "postalCode")}, ''), {_ADDRESS("b", "streetAddress")}, '') AS address_raw, CASE WHEN a IS NOT NULL THEN '/a.jpg' ELSE image END AS primary_image_url, text FROM u),
 m AS (SELECT page_id, md5(url) AS id, url, coalesce(nullif(og, ''), nullif(head, ''), name, '') AS title, coalesce({_FIRST_PRICE("a")}, {_FIRST_PRICE("b")}, {PRICE}) AS price_eur, coalesce(ld_size, CAST({SIZE} AS DOUBLE)) AS size_m2, CASE WHEN {ENERGY} = '' THEN 'UNKNOWN' ELSE {ENERGY} END AS energy_class,
  coalesce({_ADDRESS("b", "streetAddress")}, nullif({_ADDRESS("a", "streetAddress", "addressLocality", "addressRegion")}, ''), '') AS address_raw, image AS primary_image_url FROM u)"""

ITEMS = f"""WITH b AS (SELECT body_id, url, content_type, CASE WHEN json_valid(body) THEN body ELSE '{{}}' END AS body, body AS raw FROM ({A.BODIES})),
 n AS (SELECT *, list_concat(list_concat(json_extract(body, '$[*]'), json_extract(body, '$.items[*]')), json_extract(body, '$.data.results[*]')) AS items FROM b)"""
_I = lambda *paths: "coalesce(" + ", ".join(f"nullif(json_extract_string(i, '{p}'), '')" for p in paths) + ", NULL)"

#: Texts of drafts; a name in braces is a column of the deals below.
_SAID = {
    "generated": "'2026-01-31 06:00'", "title": "title", "address_raw": "address_raw", "district": "district", "size": "CAST(size_m2 AS VARCHAR)", "energy": "energy_class", "area": "'[Doplniť]'", "parcel": "'[Doplniť]'", "lv": "lv_status", "buyer": "buyer",
    "buyer_id": "buyer_id", "ownership": "CASE WHEN structure = 'sro' THEN 's.r.o.' ELSE 'Personal' END", "agreed": "cents(agreed)", "deposit": "cents(deposit)", "rest": "cents(remainder)",
    "payment_text": "CASE WHEN escrow THEN '✅ Notárska úschova — odporúčané' ELSE '⚠️ Priamy prevod — neodporúčané' END", "condition": "CASE WHEN escrow THEN 'Finančné plnenie cez Notársku úschovu dle § 56a Notárskeho poriadku.' ELSE 'Finančné plnenie na účet predávajúceho po podpise zmluvy.' END",
    "notary": "'[Prideliť notára]'", "surplus": "coalesce(whole(surplus_sro), '—')", "saving": "coalesce(whole(annual_sro_saving), '—')", "net_yield": f"printf('%.2f', {rnd('coalesce(net_rental_yield, 0) * 100', 2)})",
}


def _draft() -> str:
    text = "'" + "\n".join(DRAFT).replace("'", "''") + "'"
    for name, value in _SAID.items():
        value = re.sub(r"cents\((\w+)\)", lambda m: f"format('{{:,.2f}}', {rnd(m[1], 2)})", value)
        value = re.sub(r"whole\((\w+)\)", lambda m: f"format('{{:,}}', CAST(round(CAST({m[1]} AS DECIMAL(28,10)), 0) AS BIGINT))", value)
        text = text.replace("{" + name + "}", f"' || {value} || '")
    return text


PREFIXES = "SELECT array_to_string(list_slice(string_split(regexp_replace(href, '^https?://[^/]+', ''), '/'), 1, 3), '/') AS prefix FROM (SELECT unnest(regexp_extract_all(html, 'href=\"([^\"#]{4,300})\"', 1)) AS href FROM pages) WHERE NOT contains(href, 'javascript')"
_Q = lambda r: r.replace("'", "''")
_COSTS = {"Mortgage": "mortgage_monthly", "HOA": "hoa_monthly", "Property Tax": "property_tax_monthly", "Vacancy 5%": "vacancy_cost", "Maintenance": "maintenance_monthly", "Income Tax": "income_tax_{s}", "Health Levy": "health_levy_{s}", "TOTAL COSTS": "total_{s}", "NET SURPLUS": "surplus_{s}"}
_CHECKS = {"Transit": "coalesce(nearest_transit_m, 9999) <= 560", "Amenities": "coalesce(amenity_count, 0) >= 3", "Walkability": "walkability_score IS NOT NULL", "Industrial": "coalesce(is_industrial = 1, false)", "Construction": "coalesce(construction_risk, 0) = 0", "Noise": "coalesce(noise_flag, 0) = 0", "Energy Class": "energy_class IS NOT NULL", "LV Status": "coalesce(lv_status IN ('PASS','CLEAN'), false)"}
_FOLD = """id, min_by(source, seq) AS source, max(last_seen_at) AS last_seen_at, coalesce(max_by(price_eur, seq) FILTER (price_eur > 0), min_by(price_eur, seq)) AS price_eur, coalesce(max_by(title, seq) FILTER (title <> ''), min_by(title, seq)) AS title,
 max_by(rooms, seq) FILTER (rooms IS NOT NULL) AS rooms, coalesce(max_by(energy_class, seq) FILTER (energy_class NOT IN ('UNKNOWN','')), min_by(energy_class, seq)) AS energy_class, 1 AS is_active"""

CHUNKS = rf"""WITH c AS (SELECT page_id, regexp_extract(url, '^(https?://[^/?#]+)', 1) AS root, html, array_to_string(list_transform(regexp_extract_all(html, 'push\(\[1,"((?:[^"\\]|\\.)*)"\]\)', 1), lambda x: replace(replace(x, chr(92) || '"', '"'), chr(92) || 'u0022', '"')), chr(10)) AS said FROM ({A.CHUNK_PAGES})), u AS (SELECT page_id, root, html, list_concat(regexp_extract_all(said, '(https?://[^/"\s]+/detail/[A-Za-z0-9_-]+/[A-Za-z0-9_-]+)', 1), list_transform(regexp_extract_all(said, '(?:^|["\s])(/detail/[A-Za-z0-9_-]+/[A-Za-z0-9_-]+)', 1), lambda x: root || x)) AS links FROM c), k AS (SELECT page_id, unnest(links) AS url, unnest(range(len(links))) AS n FROM u), firsts AS (SELECT page_id, url, min(n) AS n FROM k GROUP BY ALL), chunk AS (SELECT page_id, url, row_number() OVER (PARTITION BY page_id ORDER BY n) - 1 AS position FROM firsts)"""

SQL = {
    "s1_raw_pages": "SELECT page_id, url, html FROM pages",
    "s2_listing_bodies": f"SELECT body_id, url FROM ({A.BODIES}) WHERE contains(content_type, 'json') AND regexp_matches(lower(url), 'advert|listing|search|inzerat|offer|estate')",
    "x1_detail_links": rf"WITH q AS (SELECT page_id, url, regexp_replace(html, '(?is)<!--.*?-->|<script[^>]*>.*?</script>|<style[^>]*>.*?</style>', '', 'g') AS seen FROM ({A.LINK_PAGES})), h AS (SELECT page_id, url, regexp_extract(url, '^(https?://[^/?#]+)', 1) AS root, regexp_extract(seen, '(?i)<base[^>]* href=[\x22\x27]([^\x22\x27]+)[\x22\x27]', 1) AS b, unnest(list_distinct(list_transform(regexp_extract_all(seen, '(?i)<a(?:\s+[a-z-]+=(?:\x22[^\x22]*\x22|[^\s\x22\x27>]+))*?\s+href=(\x22[^\x22]*\x22|\x27[^\x27]*\x27|[^\s>]+)', 1), lambda x: replace(regexp_replace(x, '[\x22\x27]', '', 'g'), '&amp;', '&')))) AS href FROM q), r AS (SELECT *, CASE WHEN b = '' THEN root || '/' WHEN b LIKE 'http%' THEN b ELSE root || b END AS base FROM h), f AS (SELECT page_id, CASE WHEN regexp_matches(href, '^https?://') THEN href WHEN href LIKE '/%' THEN regexp_extract(base, '^(https?://[^/?#]+)', 1) || href ELSE base || href END AS link FROM r WHERE NOT regexp_matches(href, '^(#|javascript:|mailto:|$)')) SELECT DISTINCT page_id, regexp_replace(link, '[?#].*$', '') AS link FROM f WHERE contains(regexp_extract(link, '^https?://([^/?#]+)', 1), 'example') AND regexp_matches(regexp_extract(link, '^https?://[^/?#]+([^?#]*)', 1), '^/[A-Za-z]{{4,}}') AND NOT regexp_matches(lower(regexp_extract(link, '^https?://[^/?#]+([^?#]*)', 1)), '{'|'.join(EXCLUDED)}')",
    "x3_chunk_urls": CHUNKS + " SELECT page_id, url, md5(url) AS uid, CAST(position AS INT) AS position FROM chunk",
    "x4_link_priority": CHUNKS + f""", dom AS (SELECT page_id, CASE WHEN href LIKE '/%' THEN root || href ELSE href END AS url, trim(regexp_replace(inner_html, '<[^>]*>', '', 'g')) AS text FROM (SELECT page_id, root, unnest(regexp_extract_all(html, '<a [^>]*href="([^"]*)"[^>]*>(.*?)</a>', 1)) AS href, unnest(regexp_extract_all(html, '<a [^>]*href="([^"]*)"[^>]*>(.*?)</a>', 2)) AS inner_html FROM c) WHERE contains(href, '/detail/')), api AS (SELECT body_id AS page_id FROM ({ITEMS} SELECT * FROM n) WHERE len(items) > 0), both_kinds AS (SELECT page_id, url, text, 0 AS pr FROM dom UNION ALL SELECT page_id, url, '', 1 FROM chunk), best AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY pr, page_id) AS n FROM both_kinds WHERE page_id NOT IN (SELECT page_id FROM api)) SELECT page_id, url, text FROM best WHERE n = 1""",
    "x11_api_items": f"{ITEMS} SELECT body_id, CAST(len(items) AS BIGINT) AS n_items FROM n",
    "x12_api_listings": f"{ITEMS}, e AS (SELECT unnest(items) AS i FROM n WHERE contains(content_type, 'json') AND regexp_matches(lower(url), 'advert|listing|search|inzerat|offer|estate')), f AS (SELECT i, coalesce({_I('$.url', '$.seoUrl', '$.link')}, '/nehnutelnost/' || {_I('$.id', '$.advertId')} || '/') AS link FROM e), g AS (SELECT i, CASE WHEN link LIKE 'http%' THEN link WHEN link LIKE '/%' THEN 'https://reality.example' || link ELSE 'https://reality.example/' || link END AS url FROM f WHERE link IS NOT NULL) SELECT md5(url) AS id, url, substr(coalesce({_I('$.title', '$.name', '$.heading')}, ''), 1, 200) AS title, coalesce({_json_number('i', '$.price.value', '$.price.amount', '$.price', '$.priceInfo.value', '$.priceInfo.amount')}, 0) AS price_eur, coalesce({_json_number('i', '$.usableArea', '$.parameters.usableArea', '$.floorArea', '$.parameters.floorArea', '$.area', '$.parameters.area')}, 0) AS size_m2, coalesce({_I('$.location.city', '$.address.fullAddress')}, CASE WHEN json_type(i, '$.location') = 'VARCHAR' THEN json_extract_string(i, '$.location') END, '') AS address_raw, CASE WHEN upper({_I('$.energyRating', '$.energyClass')}) IN ('A0','A1','A','B','C','D','E','F','G') THEN upper({_I('$.energyRating', '$.energyClass')}) ELSE 'UNKNOWN' END AS energy_class, coalesce({_I('$.images[0].url', '$.photos[0]')}, '') AS primary_image_url FROM g",
    "x19_detail_rows": f"{DETAILS} SELECT * EXCLUDE (page_id, text), trim(split_part(address_raw, ',', -1)) AS district FROM d WHERE price_eur > 0 OR size_m2 > 0",
    "x19_meta_first_rows": f"{DETAILS} SELECT * EXCLUDE (page_id), trim(split_part(address_raw, ',', -1)) AS district FROM m WHERE price_eur > 0 OR size_m2 > 0",
    "x8_page_titles": rf"""WITH p AS (SELECT page_id, html, regexp_replace(html, '(?s)<!--.*?-->', '', 'g') AS seen FROM ({A.HEAD_PAGES})), t AS (SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title,
      list_filter(regexp_extract_all(seen, '(?i)<meta(?:\s+[a-z-]+\s*=\s*(?:"[^"]*"|\x27[^\x27]*\x27|[^\s>]+))+\s*/?>'), lambda m: regexp_matches(m, '(?i)\sproperty\s*=\s*["\x27]?og:title["\x27 />]'))[1] AS og FROM p)
      SELECT page_id, substr(trim(regexp_replace(title, '\s*[|-]\s*(?:[Nn]ehnute|[Tt][Oo][Pp][Rr][Ee][Aa][Ll][Ii][Tt][Yy]).*', '')), 1, 200) AS title,
      nullif(replace(replace(regexp_replace(regexp_extract(og, '(?i)\scontent\s*=\s*("[^"]*"|\x27[^\x27]*\x27|[^\s>]+)', 1), '^["\x27]|["\x27]$', '', 'g'), '&lt;', '<'), '&amp;', '&'), '') AS og_title FROM t""",
    "x9_visible_text": f"SELECT page_id, md5({TEXT}) AS text_md5 FROM pages",
    "x10_text_prices": f"{DETAILS} SELECT page_id, {PRICE} AS price_eur FROM d",
    "x13_text_sizes": f"{DETAILS} SELECT page_id, CAST({SIZE} AS DOUBLE) AS size_m2 FROM d",
    "x14_energy": f"{DETAILS} SELECT page_id, energy_class FROM d",
    "x15_districts": f"SELECT id, trim(split_part(address_raw, ',', -1)) AS district, split_part(trim(trim(split_part(address_raw, ',', -1))), ' ', 1) AS city FROM ({A.LISTINGS})",
    "x16_listing_ids": "SELECT page_id, md5(url) AS id FROM pages",
    "x17_cards": rf"""WITH p AS ({A.CARD_PAGES}), c AS (SELECT page_id, unnest(CASE WHEN contains(html, '<div class="inzeratyflex">') THEN string_split(html, '<div class="inzeratyflex">')[2:] ELSE [html] END) AS c FROM p), t AS (SELECT page_id, c, regexp_extract(c, 'href="([^"]*/inzerat/[^"]*)"', 1) AS href, trim(regexp_replace(regexp_replace(c, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS said, regexp_extract(c, '<a [^>]*>([^<]*)</a>', 1) AS title, regexp_replace(regexp_extract(c, 'class="(?:inzeratycena|cena)">(?:<b>)?([^<]*)<', 1), '[^0-9]', '', 'g') AS own, regexp_extract(c, 'class="(?:inzeratylok|lokalita)">([^<]*)<', 1) AS place, regexp_extract(c, '<img src="([^"]*)"', 1) AS img FROM c),
      u AS (SELECT *, CASE WHEN href LIKE 'http%' THEN href ELSE 'https://bazar.example' || href END AS url FROM t)
      SELECT page_id, md5(url) AS id, url, title, coalesce(nullif(try_cast(own AS DOUBLE), 0), try_cast(regexp_replace(regexp_extract(said, '([0-9][0-9\s]{{3,}})\s*(?:€|EUR)', 1), '\s', '', 'g') AS DOUBLE), 0) AS price_eur, coalesce(try_cast(replace(regexp_extract(said, '([0-9]+(?:[.,][0-9]+)?)\s*m', 1), ',', '.') AS DOUBLE), 0) AS size_m2, trim(place) AS address_raw, trim(split_part(place, ',', -1)) AS district, CASE WHEN img LIKE '//%' THEN 'https:' || img WHEN img LIKE '/%' THEN 'https://bazar.example' || img ELSE img END AS primary_image_url FROM u""",
    "x20_overlay": f"SELECT id, CASE WHEN price_eur = 0 AND okey % 2 = 1 THEN 'nový ' || title WHEN okey % 2 = 1 THEN '' ELSE title END AS title, CASE WHEN price_eur = 0 AND okey % 34 = 0 THEN 1000.0::DOUBLE ELSE price_eur END AS price_eur, CASE WHEN price_eur = 0 AND okey % 3 = 0 THEN 44.0::DOUBLE ELSE size_m2 END AS size_m2, CAST(CASE WHEN price_eur = 0 AND okey % 4 <> 0 THEN okey % 4 ELSE 3 END AS INT) AS rooms, CASE WHEN price_eur = 0 AND okey % 2 = 0 THEN 'B' ELSE energy_class END AS energy_class, CASE WHEN price_eur = 0 AND okey % 5 = 0 THEN 'Nová 1, Martin' ELSE address_raw END AS address_raw, CASE WHEN price_eur = 0 AND okey % 5 = 0 THEN 'Martin' ELSE district END AS district FROM ({A.LISTINGS})",
    "x21_backlog": f"SELECT id, scraped_at FROM ({A.LISTINGS}) WHERE source = 'src1' AND is_active = 1 AND (price_eur = 0 OR size_m2 = 0) ORDER BY scraped_at DESC, id LIMIT 200",
    "x22_gains": f"SELECT count(*) FILTER (price_eur <= 0 AND okey % 2 = 0) AS gained_price, count(*) FILTER (size_m2 <= 0 AND okey % 3 = 0) AS gained_size FROM ({A.LISTINGS})",
    "x23_unseen_links": f"WITH h AS (SELECT DISTINCT page_id, href AS link FROM ({HREFS})) SELECT page_id, link FROM h WHERE link NOT IN (SELECT link FROM h WHERE page_id % 5 = 0)",
    "m1_merge": f"SELECT {_FOLD} FROM ({A.OBSERVATIONS}) GROUP BY id",
    "m2_score_replace": f"WITH s AS ({scored(READY, 'id AS listing_id, cls AS classification')}), l AS ({A.LISTINGS}) SELECT l.id, coalesce(s.classification, l.classification) AS classification, coalesce(s.classification, CASE WHEN {HAS_SCORE} THEN 'OLD' END) AS stored_class FROM l LEFT JOIN s ON s.listing_id = l.id",
    "m4_deed_status": f"{JUDGED} WHERE l.lv_status = 'PENDING' AND l.is_active = 1) SELECT l.id, coalesce(status, lv_status) AS lv_status, CASE WHEN status = 'REJECTED' THEN reason END AS logged FROM l LEFT JOIN judged USING (id)",
    "m5_insert_or_ignore": f"""WITH s AS ({A.SEEDS}), e AS MATERIALIZED (SELECT 's' || CAST(min(okey) AS VARCHAR) AS id, trim(district) AS district, 'small' AS size_band, -min(okey) AS seq FROM ({A.LISTINGS}) WHERE size_m2 < 60 GROUP BY trim(district)),
      f AS MATERIALIZED (SELECT id, district, size_band, min(seq) AS seq FROM s GROUP BY ALL),
      g AS MATERIALIZED (SELECT list_reduce(list_prepend((SELECT {{'ids': list(id), 'pairs': list(district || '|' || size_band), 'taken': []::BIGINT[]}} FROM e), list({{'ids': [id], 'pairs': [district || '|' || size_band], 'taken': [seq]}} ORDER BY seq)),
       lambda a, x: CASE WHEN list_contains(a.ids, x.ids[1]) OR list_contains(a.pairs, x.pairs[1]) THEN a ELSE {{'ids': list_append(a.ids, x.ids[1]), 'pairs': list_append(a.pairs, x.pairs[1]), 'taken': list_append(a.taken, x.taken[1])}} END).taken AS taken FROM f)
      SELECT id, district, size_band, seq FROM e UNION ALL SELECT id, district, size_band, seq FROM f WHERE seq IN (SELECT unnest(taken) FROM g)""",
    "m6_valid_rows": f"SELECT sum(CASE WHEN seq % 9 = 0 THEN 0 ELSE 1 END)::BIGINT AS valid, sum(CASE WHEN seq % 9 = 0 THEN 1 ELSE 0 END)::BIGINT AS quarantined FROM ({A.OBSERVATIONS})",
    "l1_pending": f"SELECT id FROM ({A.LISTINGS}) WHERE lv_status = 'PENDING' AND is_active = 1",
    "l2_verdicts": f"WITH {DEED} SELECT doc_id, CASE WHEN flag IS NULL THEN 'PASS' ELSE 'REJECT' END AS verdict, flag, 'LV encumbrance detected: ''' || flag || '''' AS detail FROM deeds",
    "l3_debt_filter": f"{JUDGED} WHERE l.lv_status = 'PENDING' AND l.is_active = 1) SELECT count(*) FILTER (status = 'PASS') AS passed, count(*) FILTER (status = 'REJECTED') AS rejected FROM judged",
    "l4_reverify": f"{JUDGED}) SELECT id, status, reason FROM judged UNION ALL SELECT 'missing-' || CAST(n_nationkey AS VARCHAR), 'ERROR', '' FROM nation",
    "c1_unscored": f"SELECT id FROM ({A.LISTINGS}) WHERE {READY} AND NOT ({HAS_SCORE})",
    "c2_rent_estimate": f"WITH l AS ({A.LISTINGS}), todo AS (SELECT * FROM l), {RENT} SELECT id, estimate AS rent_estimate, {ZONE} AS zone FROM rented",
    "c4_mortgage": f"SELECT id, {rnd(annuity('price_eur * 0.8::DOUBLE', '0.034::DOUBLE', '25'), 2)} AS mortgage, {HOA} AS hoa, {rnd(TAX_P, 2)} AS tax_personal, {rnd('greatest(gain * 0.21::DOUBLE, 0.0::DOUBLE)', 2)} AS tax_company FROM (SELECT *, price_eur - 20000 AS gain FROM ({A.LISTINGS}))",
    "c14_cashflow_score": scored(),
    "c15_what_if": "WITH all_rows AS (" + scored(READY, "sc AS scenario, " + SCORE_COLUMNS, "s.sc, s.o AS override, coalesce(s.l, 0.8::DOUBLE) AS ltv, coalesce(s.r, 0.034::DOUBLE) AS rate, coalesce(s.y, 25) AS years", "CROSS JOIN (VALUES ('base', NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, NULL::INT), ('rich', 9000.0::DOUBLE, 0.6::DOUBLE, 0.05::DOUBLE, 20), ('free', 0.0::DOUBLE, 1.0::DOUBLE, 0.0::DOUBLE, 30)) AS s(sc, o, l, r, y)") + ") SELECT scenario, listing_id, surplus_sro, ratio_sro, income_tax_personal, classification, mortgage_rate_used, ltv_used, loan_term_years FROM all_rows",
    "c16_scoring_run": f"WITH s AS ({scored(READY + ' AND NOT (' + HAS_SCORE + ')')}) SELECT classification, count(*) AS n FROM s GROUP BY 1",
    "g1_unscored_location": f"SELECT id FROM ({A.LISTINGS}) WHERE lv_status = 'PASS' AND is_active = 1 AND NOT ({HAS_SCORE})",
    "g2_geocode": f"SELECT * FROM (SELECT id, {_CITY(1)} AS lat, {_CITY(2)} AS lng FROM ({A.LISTINGS})) WHERE lat IS NOT NULL",
    "g3_haversine": f"SELECT id, {rnd(HAV, 1)} AS metres FROM (SELECT l.id, {_h('l', 'c')} AS h FROM ({A.LISTINGS}) l CROSS JOIN (SELECT 48.1486::DOUBLE AS lat, 17.1077::DOUBLE AS lng) c)",
    "g4_surroundings": f"WITH {AROUND} SELECT id, nearest_transit_m, grocery_or_supermarket, pharmacy, school, amenity_count FROM around",
    "g6_hazards": f"WITH {AROUND} SELECT * FROM hazards",
    "g8_location_run": f"WITH {AROUND} SELECT * FROM location",
    "q1_active_feed": f"{FEED} SELECT * FROM feed",
    "q2_rejected_feed": f"{JUDGED} WHERE true) SELECT l.id, l.title, j.reason, j.detail, l.scraped_at AS flagged_at FROM l JOIN judged j USING (id) WHERE j.status = 'REJECTED'",
    "q3_stats": f"WITH s AS ({scored()}), l AS ({A.LISTINGS}), x AS (SELECT l.*, coalesce(s.classification, l.classification) AS cls FROM l LEFT JOIN s ON s.listing_id = l.id WHERE is_active = 1) SELECT count(*) AS total, CAST(sum(CAST(cls = 'GREEN' AS INT)) AS BIGINT) AS green, CAST(sum(CAST(cls = 'YELLOW' AS INT)) AS BIGINT) AS yellow, CAST(sum(CAST(cls = 'WHITE' AS INT)) AS BIGINT) AS white, CAST(sum(CAST(lv_status = 'REJECTED' AS INT)) AS BIGINT) AS rejected, CAST(sum(CAST(lv_status = 'PENDING' AS INT)) AS BIGINT) AS pending FROM x",
    "q4_completeness": f"SELECT source, count(*) AS total, count(*) FILTER (price_eur > 0) AS has_price, count(*) FILTER (size_m2 > 0) AS has_size, count(*) FILTER (price_eur > 0 AND size_m2 > 0) AS has_both, count(*) FILTER (lv_status = 'PENDING') AS pending FROM ({A.LISTINGS}) GROUP BY source",
    "q5_backlog_counts": f"SELECT count(*) FILTER ({HAS_SCORE}) AS scored, count(*) FILTER (NOT ({HAS_SCORE})) AS unscored FROM ({A.LISTINGS}) WHERE {READY}",
    "q6_latest": f"SELECT id, substr(title, 1, 60) AS title, scraped_at FROM ({A.LISTINGS}) WHERE source = 'src0' ORDER BY scraped_at DESC, id LIMIT 8",
    "q7_affordable": f"SELECT id, price_eur, size_m2 FROM ({A.LISTINGS}) WHERE coalesce(price_eur, 0) <= 300000 AND coalesce(size_m2, 0) >= 25",
    "q8_class_buckets": f"{FEED}, r AS (SELECT id, coalesce(cf_class, classification, 'PENDING') AS cls, surplus_sro, row_number() OVER (PARTITION BY coalesce(cf_class, classification, 'PENDING') ORDER BY coalesce(surplus_sro, 0) DESC, id) AS rn FROM feed) SELECT id, cls, surplus_sro, CAST(rn AS INT) AS rn FROM r WHERE rn <= 25",
    "q8_class_sizes": f"{FEED} SELECT coalesce(cf_class, classification, 'PENDING') AS cls, count(*) AS n FROM feed GROUP BY 1",
    "q9_cost_lines": f"WITH s AS ({scored()}) " + " UNION ALL ".join(f"SELECT listing_id, '{k}' AS label, {v} AS value FROM s WHERE {v} IS NOT NULL" + (f" AND {v} <> 0" if k == "TOTAL COSTS" else "") for k, v in ((k, f"CASE WHEN optimal_structure = 'SRO' THEN {c.format(s='sro')} ELSE {c.format(s='personal')} END") for k, c in _COSTS.items())),
    "q9_checklist": f"{FEED} " + " UNION ALL ".join(f"SELECT id, '{k}' AS label, {c} AS ok FROM feed" for k, c in _CHECKS.items()),
    "q10_contract_drafts": f"WITH sc AS ({scored()}), j AS (SELECT d.*, l.* EXCLUDE (id), sc.surplus_sro, sc.annual_sro_saving, sc.net_rental_yield, {rnd('agreed - deposit', 2)} AS remainder, coalesce(nullif(ico, ''), 'N/A — fyzická osoba') AS buyer_id FROM ({A.DEALS}) d JOIN ({A.LISTINGS}) l ON l.id = d.listing_id LEFT JOIN sc ON sc.listing_id = d.listing_id WHERE trim(buyer) <> '') SELECT listing_id, remainder, CASE WHEN escrow THEN 'Notárska úschova' ELSE 'Priamy prevod' END AS payment, buyer_id, structure, {_draft()} AS draft_text FROM j",
    "p1_path_prefixes": f"SELECT prefix, count(*) AS n FROM ({PREFIXES}) GROUP BY 1 ORDER BY n DESC, prefix LIMIT 20",
    "p2_candidates": f"SELECT DISTINCT href FROM (SELECT unnest(regexp_extract_all(html, 'href=\"([^\"#?]{{4,200}})\"', 1)) AS href FROM ({A.SITE_PAGES})) WHERE regexp_matches(href, '/[0-9]{{6,}}') OR regexp_matches(lower(href), 'detail|inzerat|advert') OR (contains(lower(href), '/byt') AND length(href) > 30)",
    "p3_pattern_counts": " UNION ALL ".join(f"SELECT page_id, '{_Q(k)}' AS pattern, CAST(len(regexp_extract_all(translate(html, chr(160) || chr(8239), '  '), '{_Q(r)}')) AS BIGINT) AS n FROM ({A.SITE_PAGES})" for k, r in PATTERNS.items()),
    "p4_health": "SELECT regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, count(*) AS pages, count(*) FILTER (regexp_matches(lower(html), 'loading|skeleton')) AS loading, count(*) FILTER (regexp_matches(lower(html), 'captcha|cloudflare|incapsula')) AS blocked, count(*) FILTER (regexp_matches(lower(html), 'inzerat|advert|detail|article')) AS listing FROM pages GROUP BY 1",
    "p5_mined_urls": "WITH u AS (" + " UNION ".join(f"SELECT '{k}' AS label, unnest(regexp_extract_all(html, '{_Q(r)}', 1)) AS url FROM ({A.SITE_PAGES})" for k, r in MINED.items()) + f"), f AS (SELECT DISTINCT label, url FROM u WHERE length(url) > 5 AND length(url) < 200 AND NOT regexp_matches(lower(url), '{DENIED}')), r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY url) AS rn FROM f) SELECT label, url, CAST(rn AS INT) AS rn FROM r",
    "p5_mined_bundles": f"WITH b AS ({A.BUNDLES}), w AS (SELECT DISTINCT split_part(url, '/', 1) || '//' || split_part(url, '/', 3) || unnest(regexp_extract_all(html, '/_next/static/[^\\s\"]+[.]js')) AS url FROM ({A.SITE_PAGES})), j AS (SELECT js FROM b WHERE status = 200 AND url IN (SELECT url FROM w)), u AS (" + " UNION ".join(f"SELECT '{k}' AS label, unnest(regexp_extract_all(js, '{_Q(r)}', 1)) AS url FROM j" for k, r in BUNDLE_MINED.items()) + "), f AS (SELECT DISTINCT label, url FROM u WHERE length(url) BETWEEN 6 AND 199 AND NOT regexp_matches(url, '[.](jpg|png|svg|css|woff)|facebook[.]com|google|doubleclick|/static/|/_next/image')), r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY url) AS rn FROM f) SELECT label, url, CAST(rn AS INT) AS rn FROM r WHERE rn <= 25",
    "p6_scripts": f"""WITH s AS (SELECT page_id, list_concat(regexp_extract_all(html, '<script[^>]+src="([^"]+\\.js[^"]*)"', 1), regexp_extract_all(html, '/_next/static/[^\\s"'']+\\.js')) AS all_found FROM ({A.SITE_PAGES})), u AS (SELECT page_id, unnest(all_found) AS src, unnest(range(len(all_found))) AS k FROM s), f AS (SELECT page_id, src, min(k) AS k FROM u WHERE regexp_matches(src, '{"|".join(SCRIPTS_KEPT)}') AND NOT regexp_matches(src, '{"|".join(SCRIPTS_DENIED)}') GROUP BY ALL) SELECT page_id, coalesce(n, 0) AS n, coalesce(scripts, '') AS scripts FROM pages LEFT JOIN (SELECT page_id, count(*) AS n, string_agg(src, ',' ORDER BY k) AS scripts FROM f GROUP BY page_id) USING (page_id)""",
    "p7_numeric_ids": rf"SELECT DISTINCT regexp_extract(hit, '[0-9]+$') AS numeric_id FROM (SELECT unnest(regexp_extract_all(html, '(?:advertId|listingId|id)[\x22\x27]?[ \t\n]*(?:=|:)[ \t\n]*(?:\x22|\x27)?[0-9]{{6,12}}')) AS hit FROM ({A.SITE_PAGES}))",
    "p8_snippets": "SELECT page_id, array_to_string(list_slice(regexp_extract_all(html, '(?s)(.{0,10}<h1>.{0,10})', 1), 1, 3), '¦') AS snippets, array_to_string(list_slice(regexp_extract_all(html, 'class=\"([^\"]+)\"', 1), 1, 3), '¦') AS classes FROM pages",
    "p9_pagination": f"WITH a AS (SELECT page_id, unnest(regexp_extract_all(html, '<a[^>]+href=\"[^\"#]+\"[^>]*>[^<]+</a>')) AS a FROM ({A.SITE_PAGES})), s AS (SELECT page_id, string_split(split_part(a, 'href=\"', 2), '\"')[1] AS href, regexp_extract(a, '>([^<]*)</a>$', 1) AS label FROM a) SELECT DISTINCT page_id, href, trim(label) AS label FROM s WHERE length(label) <= 30 AND length(href) < 200 AND (" + " OR ".join(f"contains(lower(label || href), '{w}')" for w in ("stran", "page", "další", "ďalš", "next", "»")) + ")",
    "p10_repeats": "WITH p AS (SELECT page_id, split_part(url, '/', 3) AS site, html, lag(html) OVER (PARTITION BY split_part(url, '/', 3) ORDER BY page_id) AS prev FROM pages) SELECT page_id, html = prev AS same, CAST(CASE WHEN html = prev THEN 0 ELSE (SELECT count(*) FROM (SELECT unnest(string_split(html, '')) AS x, unnest(range(1, length(html) + 1)) AS k) a JOIN (SELECT unnest(string_split(prev, '')) AS y, unnest(range(1, length(prev) + 1)) AS k) b USING (k) WHERE x <> y) END AS BIGINT) AS differing FROM p WHERE prev IS NOT NULL",
    "p11_body_shapes": f"""{ITEMS}, k AS (SELECT body_id, raw, body, json_type(body) AS kind, json_valid(raw) AS ok, list_filter(json_keys(body), lambda x: regexp_matches(lower(x), '{"|".join(LISTING_KEYS)}')) AS likes, json_keys(body) AS keys, json_extract(body, '$[0]') AS first_item FROM n), m AS (SELECT *, CASE WHEN len(likes) > 0 THEN likes[-1] END AS listing_key FROM k)
      SELECT body_id, CASE WHEN trim(raw) = '' THEN '(empty)' WHEN NOT ok THEN '(non-JSON)' WHEN kind = 'ARRAY' THEN 'array' ELSE 'object' END AS shape, CAST(CASE WHEN kind = 'ARRAY' THEN json_array_length(body) ELSE 0 END AS BIGINT) AS n,
       CASE WHEN NOT ok THEN '' WHEN kind = 'ARRAY' THEN array_to_string(json_keys(first_item)[:5], ',') WHEN listing_key IS NOT NULL THEN array_to_string(keys[:6], ',') ELSE array_to_string(keys[:8], ',') END AS keys, listing_key,
       CASE WHEN json_type(body, '$.' || listing_key) = 'ARRAY' THEN CAST(json_array_length(body, '$.' || listing_key) AS BIGINT) END AS listing_size FROM m""",
    "p12_state_blobs": f"""SELECT page_id, array_to_string(json_keys(blob), ',') AS keys, CAST(len(regexp_extract_all(blob, '"url":"[^"]*"')) AS BIGINT) AS n_urls, CAST(len(regexp_extract_all(blob, '"price":[0-9.]+')) AS BIGINT) AS n_prices FROM (SELECT okey AS page_id, '{{"props":{{}},"url":"' || url || '","price":' || CAST(CAST(floor(price_eur) AS BIGINT) AS VARCHAR) || CASE WHEN okey % 2 = 0 THEN ',"more":[{{"url":"/x","price":1.5}}]' ELSE '' END || '}}' AS blob FROM ({A.LISTINGS}) WHERE okey % 7 <> 0)""",
    "class_counts": f"WITH s AS ({scored()}) SELECT classification, count(*) AS n FROM s GROUP BY 1",
}
