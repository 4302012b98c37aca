"""Fixed cases, boundaries and equalities of the property-screening operators."""

import html.parser
import math
import random

import duckdb
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from estate_jobs.functions import markup
from estate_jobs.functions.columns import haversine
from estate_jobs.operators import cashflow, deeds, extract, location, merge, profile
from estate_jobs.plans.oracle import SQL
from estate_jobs.plans.queries import QUERIES
from estate_jobs.sources import relational, tables
from estate_jobs.streaming import daily
from estate_jobs.streaming.store import Store
from tests.conftest import SF

# price, size, district, rent, total_sro, surplus_sro, ratio_sro, saving, months, class
GOLDEN = [
    (185000.0, 52.0, "Bratislava II", 613.6, 1039.52, -425.92, 0.5903, 0.0, None, "WHITE"),
    (46000.0, 51.0, "Košice I", 468.38, 350.64, 117.74, 1.3358, 250.37, 120, "GREEN"),
    (38000.0, 36.0, "Nitra", 290.3, 254.05, 36.25, 1.1427, 77.09, 390, "YELLOW"),
    (39000.0, 38.0, "Košice IV", 255.36, 249.38, 5.98, 1.024, 12.71, 2361, "WHITE"),
    (55000.0, 55.0, "Nitra", 443.52, 380.91, 62.61, 1.1644, 133.15, 226, "GREEN"),
    (68000.0, 72.0, "Košice I", 661.25, 511.61, 149.64, 1.2925, 318.23, 95, "GREEN"),
]


def test_golden_scores(spark):
    rows = spark.createDataFrame([(str(k), *g[:3]) for k, g in enumerate(GOLDEN)], "id string, price_eur double, size_m2 double, district string")
    for r in cashflow.score(rows).collect():
        g = GOLDEN[int(r.listing_id)]
        assert [r.rent_estimate, r.total_sro, r.surplus_sro, r.ratio_sro, r.annual_sro_saving] == pytest.approx(g[3:8])
        assert (r.break_even_months, r.classification) == g[8:]


def test_boundaries(spark):
    value = lambda c: spark.range(1).select(c).first()[0]
    assert [value(cashflow.hoa(F.lit(x))) for x in (39.99, 40.0, 70.0, 70.01, 120.0, 120.01)] == [35, 60, 60, 90, 90, 130]
    assert value(cashflow.tax_personal(F.lit(41445.0))) == pytest.approx(7874.55) and value(cashflow.tax_personal(F.lit(-1.0))) == 0
    assert value(cashflow.annuity(F.lit(0.0), F.lit(0.034), F.lit(25))) == 0 and value(cashflow.annuity(F.lit(1200.0), F.lit(0.0), F.lit(10))) == 10
    points = lambda *a: tuple(spark.range(1).select(*location.score(*map(F.lit, a))).first())
    assert points(560.0, 3, 0, 0, "A") == (100, "PRIME") and points(560.1, 2, 0, 1, "B") == (20, "POOR") and points(9999.0, 3, 0, 0, "a1") == (60, "SOLID")


def test_deeds(spark):
    rows = spark.createDataFrame([(1, "ZÁLOŽNÉ PRÁVO"), (2, "exekúcia v prospech VÚB"), (3, "konkurz a exekúcia"), (4, ""), (5, None)], "k int, raw string")
    assert {r.k: r.flag for r in deeds.verdicts(rows).collect()} == {1: "záložné právo", 2: None, 3: "exekúcia", 4: None, 5: None}
    assert deeds.verdicts(rows, strict=True).filter("verdict = 'REJECT'").count() == 3


def test_text_fields(spark):
    one = lambda f, t: spark.createDataFrame([(t,)], "t string").select(f(F.col("t"))).first()[0]
    assert one(extract.price_from_text, "Cena: 125 000 €") == 125000 and one(extract.price_from_text, "bez ceny") == 0
    assert one(extract.size_from_text, "ÚŽITKOVÁ PLOCHA:\n 63,5 m²") == 63.5 and one(extract.size_from_text, "pozemok 900 m2, byt 55 m2") == 55
    assert one(extract.energy_from_text, "Energetický certifikát: Energetická trieda: a1 .") == "A1" and one(extract.energy_from_text, "") == "UNKNOWN"
    assert one(extract.district, "Ulica 1, Nitra ") == "Nitra" and one(extract.district, None) == ""


def test_links_resolve_like_a_browser(spark):
    rows = spark.createDataFrame([("http://h.sk/a/b", x) for x in ("c", "/d", "//x.sk/e", "../f", "https://y.sk/", "?q=1")], "b string, x string")
    got = [r[0] for r in rows.select(extract.resolve(F.col("b"), F.col("x"))).collect()]
    assert got[1:] == ["http://h.sk/d", "https://x.sk/e", "http://h.sk/f", "https://y.sk/", "http://h.sk/a/b?q=1"] and got[0] == "http://h.sk/a/c"


OBS = "id string, seq long, source string, title string, price_eur double, rooms double, energy_class string, last_seen_at string"
ROW = st.tuples(st.sampled_from("ab"), st.sampled_from(["s1", "s2"]), st.sampled_from(["", "t1", "t2"]), st.sampled_from([0.0, 1.0, 2.0]), st.sampled_from([None, 1.0]), st.sampled_from(["UNKNOWN", "", "B", "C"]))


@settings(max_examples=8, deadline=None)
@given(st.lists(ROW, min_size=1, max_size=10))
def test_fold_is_a_sequential_merge(spark, rows):
    state = {}
    for k, (i, source, title, price, rooms, energy) in enumerate(rows):
        old = state.setdefault(i, [source, title, price, rooms, energy, None])
        state[i] = [old[0], title or old[1], price if price > 0 else old[2], rooms if rooms is not None else old[3], energy if energy not in ("UNKNOWN", "") else old[4], f"{k:03}"]
    df = spark.createDataFrame([(r[0], k, *r[1:], f"{k:03}") for k, r in enumerate(rows)], OBS)
    got = {r.id: [r.source, r.title, r.price_eur, r.rooms, r.energy_class, r.last_seen_at] for r in merge.fold(df).collect()}
    assert got == state


def test_grid_join_is_brute_force(spark):
    points = spark.range(60).select("id", (48.1 + F.col("id") * 37 % 60 / 900).alias("lat"), (17.05 + F.col("id") * 17 % 60 / 700).alias("lng"))
    places = spark.range(40).select(F.col("id").alias("place"), (48.1 + F.col("id") * 7 % 40 / 600).alias("place_lat"), (17.05 + F.col("id") * 11 % 40 / 500).alias("place_lng"))
    brute = points.crossJoin(places).filter(haversine(F.col("lat"), F.col("lng"), F.col("place_lat"), F.col("place_lng")) <= 2000).count()
    assert location.within(points, places, 2000).count() == brute > 0


def test_stream_equals_batch(spark, tmp_path):
    df = spark.createDataFrame([("ab"[k % 2], k, "s", f"t{k}", float(k % 3), None, "B", f"{k}") for k in range(8)], OBS).withColumn("url", F.lit("u")).withColumn("scraped_at", F.lit("x"))
    for k in range(4):
        df.filter(f"seq div 2 = {k}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    daily.merge_stream(spark, f"{tmp_path}/in", f"{tmp_path}/store", f"{tmp_path}/cp").awaitTermination()
    key = lambda d: sorted((r.id, r.title is not None, r.price_eur > 0) for r in d.collect())
    assert key(daily.read_store(spark, f"{tmp_path}/store", 0)) == key(merge.fold(df))
    assert daily.run_steps([("bad", lambda: 1 / 0), ("good", lambda: None)])["good"] == "ok"


LISTING = "id string, seq long, source string, url string, title string, price_eur double, size_m2 double, district string, energy_class string, address_raw string, cadastral_number string, scraped_at string, last_seen_at string"


def test_days_of_a_stream(spark, tmp_path):
    obs = [(f"l{k % 4}", k + 1, "s", "u", f"t{k}", 46000.0 + k, 51.0, "Košice I", "A", "Ulica 1, Košice", f"c{k % 4}", f"{k}", f"{k}") for k in range(8)]
    obs.append(("bad", 9, None, "u", "t", 1.0, 1.0, "", "", "", "c", "x", "x"))
    rows = spark.createDataFrame(obs, LISTING)
    documents = spark.createDataFrame([("c1", "konkurz"), ("c2", "konkurz, VÚB")], "cadastral_number string, raw string")
    places = spark.createDataFrame([("transit_station", 48.7164, 21.2611)], "type string, lat double, lng double")
    sites, noise = places.select("lat", "lng").filter("false"), places.select("lat", "lng").withColumn("db", F.lit(10.0))
    rows.filter("seq IN (1, 2, 3)").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    side = (documents, "cadastral_number", places, sites, noise)
    daily.daily_stream(spark, f"{tmp_path}/in", f"{tmp_path}/store", f"{tmp_path}/cp", *side).awaitTermination()
    rows.filter("seq > 3").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    daily.daily_stream(spark, f"{tmp_path}/in", f"{tmp_path}/store", f"{tmp_path}/cp", *side).awaitTermination()
    at = lambda table, day="v1": daily.read_store(spark, f"{tmp_path}/store", day, table) if table in ("listings", "scores", "locations") else spark.read.parquet(f"{tmp_path}/store/{day}/{table}")
    assert {r.id: (r.title, r.lv_status, r.classification) for r in at("listings").collect()} == {"l0": ("t4", "PASS", "GREEN"), "l1": ("t5", "REJECTED", "PENDING"), "l2": ("t6", "PASS", "GREEN"), "l3": ("t7", "PASS", "GREEN")}
    assert {r.listing_id for r in at("scores").collect()} == {r.listing_id for r in at("locations").collect()} == {"l0", "l2", "l3"}
    assert [r.listing_id for r in at("rejections", "v0").collect()] == ["l1"] and at("rejections").count() == 0
    assert at("stats").first().asDict() == {"total": 4, "green": 3, "yellow": 0, "white": 0, "rejected": 1, "pending": 0}
    done = daily.run_day(spark, rows, f"{tmp_path}/store", "v2", "v1", documents, "cadastral_number", places.drop("type"), sites, noise)
    assert done["location"].startswith("failed") and done["stats"] == done["keep"] == "ok" and at("locations", "v2").count() == 3


def test_merge_leaves_what_it_does_not_see(spark):
    old = spark.createDataFrame([("a", "s", 1.0, 0), ("b", "s", 1.0, 0)], "id string, source string, price_eur double, is_active int")
    new = spark.createDataFrame([("a", 1, "x", 0.0)], "id string, seq long, source string, price_eur double")
    assert sorted((r.id, r.source, r.price_eur, r.is_active) for r in merge.merge_listings(old, new).collect()) == [("a", "s", 1.0, 1), ("b", "s", 1.0, 0)]


def test_stored_tables(spark, tmp_path):
    rows = spark.createDataFrame([(k, f"l{k}", "personal" if k % 2 else "sro", f"a{k}\nb") for k in range(6)], "k long, listing_id string, structure string, draft_text string")
    for some in (rows.filter("k < 4"), rows.filter("k < 4"), rows.union(rows)):
        tables.append_log(some.select("listing_id", "structure"), f"{tmp_path}/log", "listing_id", "structure")
    logged = spark.read.parquet(f"{tmp_path}/log")
    assert (logged.count(), logged.select("id").distinct().count()) == (6, 6)
    tables.write_drafts(rows, f"{tmp_path}/drafts")
    assert sorted((r.structure, r.value) for r in spark.read.option("basePath", f"{tmp_path}/drafts").text(f"{tmp_path}/drafts").collect()) == sorted((r.structure, r.draft_text.replace("\n", "\\n")) for r in rows.collect())


def test_relational_store(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    spark.range(20).selectExpr("id AS k", "cast(id * 2 AS double) AS price").write.jdbc(url, "prices")
    got = tables.read_jdbc(spark, url, "prices", "k", 0, 20, 3)
    assert got.rdd.getNumPartitions() == 3 and sorted((int(r[0]), r[1]) for r in got.collect()) == [(k, k * 2.0) for k in range(20)]


def test_first_seen_links_of_a_stream(spark, tmp_path):
    links = spark.createDataFrame([(f"u{k % 5}", k) for k in range(20)], "link string, t long").withColumn("seen_at", F.timestamp_seconds(F.col("t")))
    for k in range(2):
        links.filter(f"t div 10 = {k}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    for name, horizon in (("all", None), ("hour", "1 hour")):
        stream = spark.readStream.schema(links.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        daily.first_seen_stream(stream, horizon).writeStream.option("checkpointLocation", f"{tmp_path}/cp-{name}").trigger(availableNow=True).start(f"{tmp_path}/{name}", format="parquet").awaitTermination()
        got = spark.read.parquet(f"{tmp_path}/{name}")
        assert sorted(r.link for r in got.collect()) == sorted(r.link for r in links.select("link").distinct().collect())


def test_linked_data(spark):
    page = lambda *objects: "".join(f'<script type="application/ld+json">{o}</script>' for o in objects)
    cases = {
        1: page('{"@type":["Apartment","Place"],"name":"A","image":{"url":"/i"},"offers":[{"price":"x","lowPrice":"90000"}],"address":"Ulica 1, Nitra","floorSize":{"value":"55.5"},"numberOfBedrooms":2}'),
        2: page('[{"@type":"Apartment","name":"","offers":{"price":1000}},{"@type":"House","name":"B","offers":{"price":0,"highPrice":2000},"image":[{"url":"/j"}],"floorSize":60}]'),
        3: page('{"@type":"Apartment","name":"broken', "", '{"@type":"BreadcrumbList","name":"N"}', '{"@type":"Apartment","address":{"streetAddress":"","addressLocality":"Trnava","postalCode":917}}'),
        4: "",
        5: None,
    }
    rows = spark.createDataFrame(list(cases.items()), "k int, html string").withColumn("ld", extract.linked_data(F.col("html")))
    got = {r.k: tuple(r)[1:] for r in rows.select("k", *(c.alias(n) for n, c in extract.ld_fields(F.col("ld")).items())).collect()}
    assert got[1] == ("A", "/i", "Ulica 1, Nitra", 90000.0, 55.5, 2.0)
    assert got[2] == ("B", "/j", None, 2000.0, None, None)
    assert got[3] == (None, None, "Trnava, 917", None, None, None)
    assert got[4] == got[5] == (None,) * 6


def test_repeats_compare_whole_pages(spark, monkeypatch):
    monkeypatch.setattr(profile, "RANGE", 4)
    head = "é𝄞" * 300
    html = {1: head + "body", 2: head + "boxy and more", 3: head + "boxy and more", 5: None, 6: "a", 40: head + "b", 41: head + "c", 90: "x", 91: head + "d"}
    sites = {k: None if k > 80 else "s" for k in html}
    rows = spark.createDataFrame([(k, sites[k], k, t) for k, t in html.items()], "page_id long, site string, page_no long, html string")
    want, ids = {}, list(html)
    for a, b in zip(ids, ids[1:], strict=False):
        if sites[a] == sites[b] and html[a] is not None:
            want[b] = (None, None) if html[b] is None else (html[a] == html[b], sum(x != y for x, y in zip(html[a], html[b], strict=False)))
    assert {r.page_id: (r.same, r.differing) for r in profile.repeats(rows).collect()} == want and want[2] == (False, 1)
    assert profile.repeats(rows.filter("false")).count() == 0


def test_repeats_query_on_whole_pages(spark):
    import __spark_entry__ as entry

    rows = sorted(spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "url", "html").collect())
    last, want = {}, {}
    for r in rows:
        site = (r.url.split("/") + [""] * 3)[2]
        if site in last:
            want[r.page_id] = (last[site] == r.html, sum(x != y for x, y in zip(last[site], r.html, strict=False)))
        last[site] = r.html
    got = entry.queries()["p10_repeats"](spark, "/root/testdata/sf0.001").collect()
    assert {r.page_id: (r.same, r.differing) for r in got} == want and len(got) == len(want) > 0


def test_location_of_listings_without_coordinates(spark):
    rows = [("own", 48.5, 18.5, "Ulica 1, Košice"), ("none", None, None, "Ulica 1, Košice"), ("half", 48.5, None, "Ulica 1, Košice"), ("nowhere", None, None, "Ulica 1"), ("no address", 48.5, 18.5, None)]
    listings = spark.createDataFrame([(*r, "PASS", 1, "Košice I", "A") for r in rows], "id string, lat double, lng double, address_raw string, lv_status string, is_active int, district string, energy_class string")
    places = spark.createDataFrame([("transit_station", 48.5, 18.5)], "type string, lat double, lng double")
    sites = places.select("lat", "lng").filter("false")
    run = lambda df: {r.listing_id: (r.lat, r.lng) for r in location.run(df, spark.createDataFrame([], "listing_id string"), places, sites, sites.withColumn("db", F.lit(1.0))).collect()}
    city = run(listings.drop("lat", "lng"))["none"]
    assert run(listings) == {"own": (48.5, 18.5), "none": city, "half": city, "no address": (48.5, 18.5)}


def test_cards_of_odd_pages(spark):
    pages = {
        1: '<div class="inzerat x"><h2><a href="/inzerat/1/">Byt <b>A</b></a></h2><a href="/inzerat/1/">again</a><img><img src="/1.jpg"><span class="cena-eur">90 000 €</span><p class="lokalita">Nitra</p> 50 m2</div><p><a href="/inzerat/2/">Byt B</a></p><a href="/other">x</a>',
        2: '<section><div class="inzeratyflex"><div class="inzeratynadpis"><a href="/inzerat/3/">Byt C</a></div><div class="inzeratycena">70 000 €</div> 40 m2',
        3: '<div class="inzeratyflex"><div class="inzeratynadpis"><a href="/inzerat/4/">Byt D</a></div></div><a href="/inzerat/5/">stray</a>',
        4: "<i>" * 7 + '<a href="/inzerat/6/">deep</a>',
        5: None,
    }
    rows = spark.createDataFrame(list(pages.items()), "page_id long, html string")
    got = {r.url: (r.page_id, r.title, r.price_eur, r.size_m2, r.address_raw, r.primary_image_url) for r in extract.cards(rows, "b:").collect()}
    assert got["b:/inzerat/1/"] == (1, "Byt A", 90000.0, 50.0, "Nitra", "b:/1.jpg")
    assert got["b:/inzerat/3/"] == (2, "Byt C", 70000.0, 40.0, "", "")
    assert set(got) == {f"b:/inzerat/{k}/" for k in (1, 3, 4, 6)}


def test_linked_data_of_both_orders(spark):
    page = '<meta property="og:title" content=" Meta ">' + "".join(f'<script type="application/ld+json">{o}</script>' for o in (
        '{"@type":"Apartment","name":"A","offers":{"price":0,"lowPrice":"1000"},"address":{"streetAddress":"S 1","addressLocality":"Nitra","postalCode":"94901"},"floorSize":{"value":50},"numberOfRooms":0,"numberOfBedrooms":"2.0"}',
        '{"@type":"House","name":"B","offers":{"price":2000},"address":"Iná, Martin","floorSize":{"value":"0"},"numberOfRooms":0}',
        '{"@type":"House","offers":{"price":"na","lowPrice":3000},"floorSize":77}',
    )) + "<title>T | R</title>"
    rows = spark.createDataFrame([("u", page)], "url string, html string")
    one = extract.details(rows).first()
    assert (one.title, one.price_eur, one.size_m2, one.rooms, one.address_raw, one.district) == ("A", 3000.0, 50.0, 2.0, "S 1, Nitra, 94901", "94901")
    two = extract.details(rows, meta_first=True).first()
    assert (two.title, two.price_eur, two.size_m2, two.rooms, two.address_raw, two.district) == ("Meta", 1000.0, 50.0, None, "Iná, Martin", "Martin")


def test_base_of_links(spark):
    html = '<a href="a-r123456.html?x#y"><a href="/b-r123456.html"><a href="http://other.sk/c-r123456.html"><a href="#d"><a href="garaz-r123456.html">'
    pages = spark.createDataFrame([(1, "https://h.sk/x/y", html), (2, "https://h.sk/x/y", '<base href="/sub/">' + html), (3, "https://h.sk/x/y", '<base href="https://www.h.sk/b/c">' + html), (4, "https://h.sk", None)], "page_id long, url string, html string")
    got = {}
    for r in extract.detail_links(pages, "h.sk").collect():
        got.setdefault(r.page_id, set()).add(r.link)
    assert got == {1: {"https://h.sk/a-r123456.html", "https://h.sk/b-r123456.html"}, 2: {"https://h.sk/sub/a-r123456.html", "https://h.sk/b-r123456.html"}, 3: {"https://www.h.sk/b/a-r123456.html", "https://www.h.sk/b-r123456.html"}}


def test_overlay_of_unpriced_rows(spark):
    cols = "id string, title string, price_eur double, rooms int, address_raw string"
    old = spark.createDataFrame([("a", "", 0.0, 1, "x"), ("b", "", 5.0, 1, "x"), ("c", "t", 0.0, 1, "x"), ("d", "t", 0.0, 1, "x")], cols)
    new = spark.createDataFrame([("a", "n" * 300, 7.0, 0, ""), ("b", "n", 7.0, 2, "y"), ("c", "n", 0.0, 2, "y")], cols)
    got = {r.id: tuple(r)[1:] for r in extract.overlay(old, new, unpriced=True).collect()}
    assert got == {"a": ("n" * 200, 7.0, 1, "x"), "b": ("", 5.0, 1, "x"), "c": ("t", 0.0, 2, "y"), "d": ("t", 0.0, 1, "x")}
    assert {r.id: r.price_eur for r in extract.overlay(old, new).collect()}["b"] == 7.0


SEED = st.tuples(st.sampled_from("abc"), st.sampled_from("xyz"), st.sampled_from(["s", "l"]))


@settings(max_examples=6, deadline=None)
@given(st.lists(SEED, max_size=3), st.lists(SEED, min_size=1, max_size=12))
def test_insert_or_ignore_is_one_by_one(spark, there, seed):
    there = list({r[0]: r for r in {r[1:]: r for r in there}.values()}.values())
    cols, state = "id string, district string, size_band string, seq int", [(*r, -1) for r in there]
    for k, r in enumerate(seed):
        if all(r[0] != x[0] and r[1:] != x[1:3] for x in state):
            state.append((*r, k))
    got = merge.insert_or_ignore(spark.createDataFrame([(*r, -1) for r in there], cols), spark.createDataFrame([(*r, k) for k, r in enumerate(seed)], cols), order="seq")
    assert sorted(map(tuple, got.collect())) == sorted(state)


@pytest.mark.parametrize(("lat", "radius"), [(-33.0, 300.0), (0.0, 2000.0), (48.5, 9000.0), (69.0, 2000.0), (85.0, 800.0)])
def test_grid_join_at_any_latitude_and_radius(spark, lat, radius):
    step = radius / 111_000 / 3
    points = spark.range(80).select("id", (F.lit(lat) + (F.col("id") * 37 % 80 - 40) * step / 8).alias("lat"), ((F.col("id") * 17 % 80 - 40) * step / 3).alias("lng"))
    places = spark.range(50).select(F.col("id").alias("place"), (F.lit(lat) + (F.col("id") * 7 % 50 - 25) * step / 6).alias("place_lat"), ((F.col("id") * 11 % 50 - 25) * step / 2).alias("place_lng"))
    brute = points.crossJoin(places).filter(haversine(F.col("lat"), F.col("lng"), F.col("place_lat"), F.col("place_lng")) <= radius).count()
    assert location.within(points, places, radius).count() == brute > 0


def test_store_rewrites_touched_buckets(spark, tmp_path):
    obs = lambda *ids: spark.createDataFrame([(i, k, "s", f"t{i}{k}", 1.0, None, "B", f"{k}") for k, i in enumerate(ids, 1)], OBS)
    store = f"{tmp_path}/store"
    daily.merge_into_store(spark, obs(*"abcdefgh"), store, 0, 4)
    for _ in range(2):
        daily.merge_into_store(spark, obs("a", "z"), store, 1, 4)
        got = {r.id: r.title for r in daily.read_store(spark, store, 1).collect()}
        assert got == {i: f"t{i}{k}" for k, i in enumerate("abcdefgh", 1)} | {"a": "ta1", "z": "tz2"}
        folders = [Store(spark, store).version(v).tables["listings"].folders for v in ("0", "1")]
        assert 1 <= sum(folders[1][b] != folders[0].get(b) for b in folders[1]) <= 2
    daily.merge_into_store(spark, obs("a").filter("false"), store, 2, 4)
    assert daily.read_store(spark, store, 2).count() == 9


def test_cost_lines_and_drafts(spark):
    from estate_jobs.operators import serve

    scores = cashflow.score(spark.createDataFrame([("p", 185000.0, 52.0, "Bratislava II"), ("q", 46000.0, 51.0, "Košice I")], "id string, price_eur double, size_m2 double, district string"))
    lines = {(r.listing_id, r.label): r.value for r in serve.cost_lines(scores, F.when(F.col("listing_id") == "p", "personal").otherwise("sro")).collect()}
    assert lines["q", "TOTAL COSTS"] == 350.64 and lines["q", "NET SURPLUS"] == 117.74 and ("p", "NET SURPLUS") in lines and len(lines) == 18
    listings = spark.createDataFrame([("q", "Byt", 51.0, None)], "id string, title string, size_m2 double, address_raw string")
    deal = "listing_id string, buyer string, ico string, agreed double, deposit double, escrow boolean, notary string, structure string"
    deals = spark.createDataFrame([("q", "Eva", "", 1234567.5, 2000.0, False, None, "sro"), ("q", " ", "", 1.0, 0.0, True, "", "sro")], deal)
    draft = serve.contract_drafts(listings, deals, scores, "now").first()
    for text in ("Adresa:       —", "Katastrálne územie: [Doplniť]", "€1,234,567.50", "Zostatok:          €1,232,567.50", "⚠️ Priamy prevod", "Finančné plnenie na účet", "[Prideliť notára]", "s.r.o. surplus/mo:  €118", "Forma vlastníctva: s.r.o.", "Vygenerované:  now", "LV Status:          PENDING"):
        assert text in draft.draft_text
    assert "{" not in draft.draft_text


def test_odd_bodies_and_scripts(spark):
    bodies = {1: "", 2: "no", 3: "[]", 4: "[1]", 5: '{"a":1,"b":{},"Items":[1,2],"c":0,"d":0,"e":0,"f":0,"offers":{}}', 6: '[{"a":1,"b":2,"c":3,"d":4,"e":5,"f":6}]', 7: '{"results":[]}', 8: None}
    got = {r.body_id: tuple(r)[1:] for r in profile.body_shapes(spark.createDataFrame(list(bodies.items()), "body_id int, body string")).collect()}
    assert got[1][0] == "(empty)" and got[2][0] == got[8][0] == "(non-JSON)" and got[3] == ("array", 0, "", None, None) and got[4][:2] == ("array", 1)
    assert got[5] == ("object", 0, "a,b,Items,c,d,e", "offers", None) and got[6] == ("array", 1, "a,b,c,d,e", None, None) and got[7] == ("object", 0, "results", "results", 0)
    pages = spark.createDataFrame([(1, '<script src="/static/a.js?v"></script><script src="https://gtag/app.js"></script><script src="/other.js"></script>"/_next/static/x.js" "/_next/static/x.js"'), (2, None)], "page_id int, html string")
    assert {r.page_id: r.scripts for r in profile.scripts(pages).collect()} == {1: ["/static/a.js?v", "/_next/static/x.js"], 2: None}


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Context:
        master = "spark://somewhere:7077"
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        sparkContext, conf = Context(), spark.conf

    class Frame:
        sparkSession = Session()

    if spark.conf.get("spark.checkpoint.dir", None) is None:
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            tables.durable(Frame())


TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def plain(v):
    return None if isinstance(v, float) and math.isnan(v) else round(v, 6) if isinstance(v, float) else tuple(map(plain, v)) if isinstance(v, list | tuple) else v


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    cursor = duck.execute(SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    order = lambda row: tuple((x is None, str(x)) for x in row)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=order)
    assert got == sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in cursor.fetchall()), key=order) and got


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(QUERIES) - set(SQL) == {"p11_schema_profile"}


class _Reader(html.parser.HTMLParser):
    """Tags as the standard library reads them."""

    def __init__(self):
        super().__init__()
        self.found = []

    def handle_starttag(self, tag, attrs):
        if tag in ("a", "meta", "base"):
            self.found += [(tag, k, v or "") for k, v in attrs]

    handle_startendtag = handle_starttag


ODD_TAGS = [
    '<a href="/x">1</a>', "<A HREF='/y?a=1&amp;b=2' class=k>2</A>", "<a href=/z/w.html>3</a>", '<a\n  title="a > b"\thref = "/v" data-href="/no">4</a>', '<meta content="c" property="og:title"/>', "<meta property=og:title content=c />", '<a href="&eacute;&#269;&#x17E;&nope;&copy=1">5</a>',
    '<!-- <a href="/hidden"> -->', '<script>"<a href=/script>"</script>', "<style>a{}</style>", '<area href="/other">', "<a>6</a>", '<a href="">7</a>', "<a disabled href=\"/q'uote\">8</a>", '<base href="/b/">', '<abbr href="/n">', "text > < text", '<a href="1" href="2">9</a>', "&amp;",
]


@settings(max_examples=12, deadline=None)
@given(st.lists(st.lists(st.sampled_from(ODD_TAGS), max_size=8), min_size=20, max_size=40))
def test_attributes_as_the_standard_library_reads_them(spark, pages):
    texts = ["".join(p) for p in pages]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, page string").select("k", markup.attributes(F.col("page"), "a", "meta", "base").alias("found")).collect()
    for r in rows:
        reader = _Reader()
        # `&copy=1` is left alone by browsers, not by the library
        reader.feed(texts[r.k].replace("&copy=1", "&amp;copy=1"))
        reader.close()
        assert [tuple(x) for x in r.found] == reader.found


def test_links_and_titles_of_any_form(spark):
    page = "<title lang=sk>Byt - 3 izby | Nehnuteľnosti.sk</title><meta content='Pekný \"byt\"' PROPERTY=\"og:title\"><link href='/css-r123456.html'>" + """<A HREF="/a-r123456.html">1</A><a class=x href='/b-r123456.html'>2</a><a href=/c-r123456.html>3</a><a data-href="/d-r123456.html">4</a><!-- <a href="/e-r123456.html"> -->"""
    df = spark.createDataFrame([(1, "https://h.sk/x", page), (2, "https://h.sk/x", None), (3, "https://h.sk/x", "")], "page_id long, url string, html string")
    assert {r.link for r in extract.detail_links(df, "h.sk").collect()} == {f"https://h.sk/{c}-r123456.html" for c in "abc"}
    html_ = F.col("html")
    assert [tuple(r) for r in df.orderBy("page_id").select(extract.meta(html_, "og:title"), extract.page_title(html_)).collect()] == [('Pekný "byt"', "Byt - 3 izby"), (None, None), (None, None)]
    many = spark.createDataFrame([("<a " + "x=1 " * 2000 + 'href="/skipped"><a href="/kept">',)], "html string")
    assert many.select(markup.values_of(markup.elements(html_, "a"), "a", "href")).first()[0] == ["/kept"]


def test_ids_pagers_and_blanks(spark):
    page = 'x {"advertId":1234567, "id": 7654321, \'listingId\' = \'2345678\'} id=12345 <a class="p" href="/b?p=2"> Ďalšia » </a><a href="/c">ďalší</a><a href="/d">iné</a> 123456 € 98765　€'
    df = spark.createDataFrame([(1, page)], "page_id long, html string")
    assert {r[0] for r in profile.numeric_ids(df).collect()} == {"1234567", "7654321", "2345678"}
    assert {(r.href, r.label) for r in profile.pagination(df).collect()} == {("/b?p=2", "Ďalšia »"), ("/c", "ďalší")}
    assert {r.pattern: r.n for r in profile.pattern_counts(df).collect()}["€ price patterns"] == 2


def test_another_number_of_buckets(spark, tmp_path):
    rows = spark.range(200).selectExpr("CAST(id AS STRING) AS id", "id + 1 AS seq", "'s' AS source", "'t' AS title", "CAST(1 AS DOUBLE) AS price_eur", "'1' AS last_seen_at")
    path = f"{tmp_path}/store"
    daily.merge_into_store(spark, rows, path, 0, 8)
    with pytest.raises(ValueError, match="8 buckets, not 16"):
        daily.merge_into_store(spark, rows.limit(50), path, 1, 16)
    Store(spark, path).rebucket("0", "1", 16)
    daily.merge_into_store(spark, rows.limit(50).withColumn("title", F.lit("new")).withColumn("extra", F.lit(1)), path, 2)
    got = daily.read_store(spark, path, 2).collect()
    assert len(got) == len({r.id for r in got}) == 200 and sum(r.title == "new" for r in got) == 50 and "extra" in got[0]
    assert Store(spark, path).version("2").buckets == 16 and Store(spark, path).version("7") is None
    with pytest.raises(ValueError, match="no version 7"):
        daily.read_store(spark, path, 7)


def test_a_day_that_dies_between_its_writes(spark, tmp_path, monkeypatch):
    """What a killed attempt wrote is in no version; the day run again gives the rows of an undisturbed one; buckets that nothing touches stay where they are."""
    obs = [(f"l{k}", k + 1, "s", "u", f"t{k}", 46000.0 + k, 51.0, "Košice I", "A", "Ulica 1, Košice", f"c{k}", f"{k}", f"{k}") for k in range(40)]
    rows = spark.createDataFrame(obs, LISTING)
    documents = spark.createDataFrame([("c1", "konkurz"), ("c2", "konkurz, VÚB")], "cadastral_number string, raw string")
    places = spark.createDataFrame([("transit_station", 48.7164, 21.2611)], "type string, lat double, lng double")
    side = (documents, "cadastral_number", places, places.select("lat", "lng").filter("false"), places.select("lat", "lng").withColumn("db", F.lit(10.0)))
    second = rows.filter("id IN ('l3', 'l5')").withColumn("title", F.lit("seen again")).withColumn("seq", F.col("seq") + 100)
    contents = lambda path, table: sorted(map(repr, daily.read_store(spark, path, "d1", table).collect()))
    tables_ = ("listings", "scores", "locations")
    good, bad = f"{tmp_path}/good", f"{tmp_path}/bad"
    for path in (good, bad):
        assert set(daily.run_day(spark, rows, path, "d0", None, *side, buckets=8).values()) == {"ok"}
    assert set(daily.run_day(spark, second, good, "d1", "d0", *side).values()) == {"ok"}
    write, calls = Store.write, []

    def dying(self, version, table, df, key, touched):
        calls.append(table)
        done = write(self, version, table, df, key, touched)
        if table == "scores":
            raise RuntimeError("killed")
        return done

    monkeypatch.setattr(Store, "write", dying)
    outcome = daily.run_day(spark, second, bad, "d1", "d0", *side)
    assert outcome["keep"] == "failed: killed" and calls == ["listings", "scores"] and Store(spark, bad).version("d1") is None
    monkeypatch.setattr(Store, "write", write)
    for _ in range(2):
        assert set(daily.run_day(spark, second, bad, "d1", "d0", *side).values()) == {"ok"}
        assert all(contents(bad, t) == contents(good, t) for t in tables_)
    before, after = (Store(spark, bad).version(v).tables["listings"].folders for v in ("d0", "d1"))
    moved = {b for b in after if after[b] != before.get(b)}
    assert 1 <= len(moved) <= 2 < len(after)
    assert Store(spark, bad).version("d1").tables["locations"].folders == Store(spark, bad).version("d0").tables["locations"].folders


STORED = "id VARCHAR(40) NOT NULL PRIMARY KEY, source VARCHAR(40), title VARCHAR(200), price_eur DOUBLE, rooms DOUBLE, energy_class VARCHAR(20), last_seen_at VARCHAR(40), classification VARCHAR(20), is_active INT"


def test_upsert_is_a_merge(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db"
    relational.execute(spark, f"{url};create=true", f"CREATE TABLE listings ({STORED})", "CREATE TABLE cashflow_scores (listing_id VARCHAR(40) NOT NULL PRIMARY KEY, surplus_sro DOUBLE, classification VARCHAR(20))")
    cases = [(f"k{n % 23}", n + 1, f"s{n % 2}", ("", "t1", "t2")[n % 3], float(n % 4), None if n % 5 else float(n), ("UNKNOWN", "", "B", "C")[n % 4], f"{n:03}") for n in range(120)]
    first, second = spark.createDataFrame(cases[:40], OBS), spark.createDataFrame(cases[40:], OBS)
    relational.upsert_listings(first, url)
    want = merge.merge_listings(merge.fold(first), second)
    read = lambda: sorted(tuple(r[c] for c in ("id", "source", "title", "price_eur", "rooms", "energy_class", "last_seen_at", "is_active")) for r in spark.read.jdbc(url, "listings").toDF("id", "source", "title", "price_eur", "rooms", "energy_class", "last_seen_at", "classification", "is_active").collect())
    expected = sorted(tuple(r[c] for c in ("id", "source", "title", "price_eur", "rooms", "energy_class", "last_seen_at", "is_active")) for r in want.collect())
    for _ in range(2):  # a repeated batch changes nothing
        relational.upsert_listings(second, url, parts=3)
        assert read() == expected
    # rows that a retried task left twice, after a batch that was killed with its staging table in place
    relational.execute(spark, url, "CREATE TABLE listings_staging (x INT)")
    folded = merge.fold(second)
    relational.upsert(folded.union(folded), url, "listings", "id", relational.listing_rule)
    assert read() == expected and not relational._exists(spark, url, "listings_staging")
    with pytest.raises(Exception, match="MERGE|merge|unique|duplicate"):
        relational.upsert(folded.union(folded.withColumn("title", F.lit("other"))).filter("id = 'k1'").withColumn("id", F.lit("new")), url, "listings", "id")
    assert read() == expected

    scores = spark.createDataFrame([("k1", 5.0, "GREEN"), ("gone", 1.0, "WHITE")], "listing_id string, surplus_sro double, classification string")
    relational.upsert_scores(scores, url)
    relational.upsert_scores(scores.withColumn("surplus_sro", F.col("surplus_sro") + 1), url)
    assert {tuple(r) for r in spark.read.jdbc(url, "cashflow_scores").collect()} == {("k1", 6.0, "GREEN"), ("gone", 2.0, "WHITE")}
    classes = {r.ID: r.CLASSIFICATION for r in spark.read.jdbc(url, "listings").collect()}
    assert classes["k1"] == "GREEN" and len(classes) == 23 and "gone" not in classes and read() == expected


def test_nearest_by_rings(spark, monkeypatch):
    """The nearest place of every spot, by brute force; fewer pairs are looked at than within the whole limit."""
    spots = spark.range(300).select((48.1 + F.col("id") * 37 % 300 / 3000).alias("lat"), (17.05 + F.col("id") * 117 % 300 / 2500).alias("lng")).union(spark.createDataFrame([(10.0, 10.0)], "lat double, lng double"))
    places = spark.range(400).select((48.1 + F.col("id") * 71 % 400 / 5000).alias("place_lat"), (17.05 + F.col("id") * 119 % 400 / 4000).alias("place_lng"), F.col("id").alias("place"))
    places = places.union(places.filter("place < 20").withColumn("place", F.col("place") + 1000))
    at, looked = [(p.place_lat, p.place_lng, p.place) for p in places.collect()], []
    inner = location.within
    monkeypatch.setattr(location, "within", lambda *a: looked.append(inner(*a).count()) or inner(*a))
    got = {(r.lat, r.lng): r.nearest for r in location.nearest(spots, places, 2000.0, tie=F.col("place")).collect()}
    assert len(got) == 301 and got[10.0, 10.0] is None

    def metres(a, b, c, d):
        h = math.sin(math.radians(c - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(math.radians(d - b) / 2) ** 2
        return 6371000.0 * 2 * math.atan2(math.sqrt(h), math.sqrt(1 - h))

    for (lat, lng), found in got.items():
        least, place = min((metres(lat, lng, a, b), -k) for a, b, k in at)
        assert (found is None) == (least > 2000) and (found is None or (abs(found.distance - least) < 1e-6 and found.place == -place))
    assert len(looked) > 1 and sum(looked) < 0.3 * inner(spots, places, 2000.0).count()


def test_noise_is_that_of_the_nearest_reading(spark):
    points = spark.createDataFrame([("near", 48.1001, 17.0001), ("cell", 48.1150, 17.0010), ("far", 49.0, 18.0), ("tie", 48.5, 17.5)], "id string, lat double, lng double")
    noise = spark.createDataFrame([(48.1001, 17.0002, 50.0), (48.1003, 17.0001, 90.0), (48.5, 17.5, 60.0), (48.5, 17.5, 70.0)], "lat double, lng double, db double")
    got = {r.id: r.noise_flag for r in location.hazards(points, noise.select("lat", "lng").filter("false"), noise).collect()}
    assert got == {"near": 0, "cell": 1, "far": 0, "tie": 1}


def test_all_mined_urls_are_numbered(spark):
    """Every address of a label, however many, and a page's own ones once; each label is numbered by itself."""
    pages = spark.range(60).select(F.col("id").alias("page_id"), F.concat(F.lit("'/graphql/"), F.lpad(F.col("id") % 45, 3, "0"), F.lit("' fetch('/items/list/"), F.lpad("id", 3, "0"), F.lit("')")).alias("html")).repartition(5)
    got = {k: sorted((r.rn, r.url) for r in profile.mined_urls(pages).collect() if r.label == k) for k in ("GraphQL endpoints", "fetch() URLs")}
    assert got["GraphQL endpoints"] == [(k + 1, f"/graphql/{k:03}") for k in range(45)]
    assert got["fetch() URLs"] == [(k + 1, f"/items/list/{k:03}") for k in range(60)]
    assert profile.mined_urls(pages.filter("false")).count() == 0


def test_running_sums_over_ranges(spark):
    rows = spark.range(2000).select((F.col("id") % 3).alias("g"), F.reverse(F.col("id").cast("string")).alias("x"), F.col("id").alias("v")).repartition(7)
    got = tables.running(rows, ["g"], ["x"], {"n": F.lit(1), "total": F.col("v")}).collect()
    for g in range(3):
        mine = sorted((r for r in got if r.g == g), key=lambda r: r.x)
        assert [r.n for r in mine] == list(range(1, len(mine) + 1)) and [r.total for r in mine] == [sum(s.v for s in mine[: k + 1]) for k in range(len(mine))]
    assert len(got) == 2000
    assert [(r.x, r.n) for r in tables.running(rows.filter("g = 0").limit(2), [], ["x"], {"n": F.lit(1)}).sort("x").collect()] == [(r.x, k + 1) for k, r in enumerate(rows.filter("g = 0").limit(2).sort("x").collect())]


def test_bundles_are_searched_once_and_whole(spark):
    pages = spark.createDataFrame([(1, "https://h.sk/a/b", '<script src="/static/app.js?v=1"></script><script src="main.js"></script><script src="https://cdn.sk/googletag/main.js"></script>'), (2, "https://h.sk/c", '<script async src="/static/app.js?v=1"></script>'), (3, "https://h.sk/d", None)], "page_id long, url string, html string")
    js = "x" * 300_000 + 'fetch("/api/one");axios.put(`/v2/three`);k="/api/img.png";m="short";n="/api/' + "y" * 300 + '"'
    bundles = spark.createDataFrame([("https://h.sk/static/app.js?v=1", 200, js), ("https://h.sk/a/main.js", 200, '"/graphql"'), ("https://cdn.sk/googletag/main.js", 200, '"/graphql/denied"'), ("https://h.sk/other.js", 200, '"/graphql/unused"')], "url string, status int, js string")
    got = {(r.label, r.url) for r in profile.mined_bundles(pages, bundles).collect()}
    assert got == {("/api/ path", "/api/one"), ("fetch() call", "/api/one"), ("axios call", "/v2/three"), ("/v1/ /v2/ path", "/v2/three"), ("graphql path", "/graphql")}
    assert [(r.url, r.rn) for r in profile.mined_bundles(pages, bundles, top=1).filter("label = 'axios call'").collect()] == [("/v2/three", 1)]


def test_schema_profile_merges_bodies(spark):
    bodies = [("https://a.sk/x", '{"id":1,"p":{"v":1.5}}'), ("https://a.sk/y", '{"id":"s","q":[1,2]}'), ("https://a.sk/z", "oops"), ("https://a.sk/z", None), ("https://b.sk/", "[1]"), ("https://c.sk/", "")]
    got = {(r.host, r["shape"]): (r.n, r["schema"]) for r in profile.schema_profile(spark.createDataFrame(bodies, "url string, body string")).collect()}
    assert got == {("a.sk", "object"): (2, "OBJECT<id: VARIANT, p: OBJECT<v: DECIMAL(2,1)>, q: ARRAY<BIGINT>>"), ("a.sk", "none"): (2, None), ("b.sk", "array"): (1, "ARRAY<BIGINT>"), ("c.sk", "none"): (1, None)}


def test_schema_profile_holds_every_key(spark):
    """The merged schema of the query's bodies has the keys that the bodies have, at any depth."""
    import json
    import re

    from estate_jobs.plans.adapters import Tables

    def keys(x):
        return {k for k in x} | {n for v in x.values() for n in keys(v)} if isinstance(x, dict) else {n for v in x for n in keys(v)} if isinstance(x, list) else set()

    want = set()
    for r in Tables(spark, SF).bodies.select("body").collect():
        try:
            want |= keys(json.loads(r.body))
        except ValueError:
            continue
    rows = {r["shape"]: (r.n, r["schema"]) for r in QUERIES["p11_schema_profile"](spark, SF).collect()}
    named = {shape: set(re.findall(r"(\w+): ", schema or "")) for shape, (_, schema) in rows.items()}
    assert rows.keys() == {"object", "array", "none"} and named["object"] | named["array"] == want and {"items", "data", "results", "adverts"} <= named["object"] and not named["none"]


@pytest.mark.parametrize("horizon", [None, "10 minutes"])
def test_first_seen_links_after_a_restart(spark, tmp_path, horizon):
    """Runs over what has landed, stopped in between: together they give what X23 gives over all of it, and state that is over its horizon goes."""
    links = spark.createDataFrame([(f"u{(k * 7) % 13 + k // 30}", k) for k in range(60)], "link string, t long").withColumn("seen_at", F.timestamp_seconds(F.col("t")))
    landed, found, checkpoint = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/cp"
    for k in range(4):
        links.filter(f"t div 15 = {k}").coalesce(1).write.mode("append").parquet(landed)
        before = spark.read.parquet(found).select("link") if k else links.select("link").filter("false")
        new = extract.unseen(links.filter(f"t div 15 = {k}"), before).select("link").distinct()
        want = {r.link for r in before.union(new).collect()}
        query = daily.first_seen_links(spark, landed, found, checkpoint, horizon, files=1)
        query.awaitTermination()
        got = [r.link for r in spark.read.parquet(found).collect()]
        assert len(got) == len(set(got)) and set(got) == want
        custom = query.lastProgress["stateOperators"][0]["customMetrics"]
        assert any("rocksdb" in name.lower() for name in custom)
    # hours later: with a horizon the old state goes, and an old link counts as new
    for n, t in enumerate((50_000, 50_001, 50_002)):
        spark.createDataFrame([("late", t) if n == 0 else ("u3", t)], "link string, t long").withColumn("seen_at", F.timestamp_seconds(F.col("t"))).coalesce(1).write.mode("append").parquet(landed)
        query = daily.first_seen_links(spark, landed, found, checkpoint, horizon, files=1)
        query.awaitTermination()
    left = query.lastProgress["stateOperators"][0]["numRowsTotal"]
    again = [r.link for r in spark.read.parquet(found).collect()].count("u3")
    assert (left == 2 and again == 2) if horizon else (left == len(want) + 1 and again == 1)


def test_api_items_are_read_once(spark):
    """r04 F1: an item's members come from one reading; texts that look like objects or lists stay texts."""
    items = [
        '{"url":"/a","url":"/b","title":"T","price":{"value":"","amount":7},"parameters":{"floorArea":"61.5"},"location":{"city":"Nitra"},"images":[{"src":"/i"}]}',
        '{"advertId":5,"name":"N","price":"{\\"value\\":9}","priceInfo":{"value":8},"area":50,"location":"{x","address":"Martin","photos":["/p"]}',
        '{"seoUrl":"s","price":12.50,"location":{},"images":[null],"photos":["[1]"],"energyClass":"b"}', '{"title":"none"}', '"text"', "null", "[1]", '{"url":"\\u007b","images":["{\\"url\\":\\"/q\\"}"]}',
    ]
    bodies = [f"[{','.join(items)}]", '{"items":[],"data":{"results":[{"id":1}]}}', '{"data":[{"id":2}],"items":"x"}', '{"items": [{"id":3}', "oops", "", None]
    found = extract.api_listings(spark.createDataFrame([(b,) for b in bodies], "body string"), "https://r.example")
    assert sorted(tuple(r)[1:] for r in found.collect()) == [
        ("https://r.example/a", "T", 7.0, 61.5, "Nitra", "UNKNOWN", "/i"), ("https://r.example/nehnutelnost/1/", "", 0.0, 0.0, "", "UNKNOWN", ""), ("https://r.example/nehnutelnost/2/", "", 0.0, 0.0, "", "UNKNOWN", ""),
        ("https://r.example/nehnutelnost/5/", "N", 8.0, 50.0, "Martin", "UNKNOWN", "/p"), ("https://r.example/s", "", 12.5, 0.0, "", "B", "[1]"), ("https://r.example/{", "", 0.0, 0.0, "", "UNKNOWN", '{"url":"/q"}'),
    ]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("get_json_object(item") <= 6


def test_surveys_equal_brute_force(spark, monkeypatch):
    """r04 F2: counts and nearest places in one pass over tiles, in whatever parts; no checkpoint for each ring of a search."""
    r = random.Random(4)
    kinds = (*location.AMENITIES, "transit_station", "site", "noise")
    spots = [(48.0 + r.randrange(600) / 7000, 17.0 + r.randrange(600) / 7000) for _ in range(300)] + [(48.2, 17.3), (-48.0, 17.0), (10.0, 10.0)]
    places = [(r.choice(kinds), 48.0 + r.randrange(400) / 7000, 17.0 + r.randrange(400) / 7000, r.choice([None, 60.0, 70.0])) for _ in range(900)]
    places += [("noise", 10.001, 10.0, 60.0), ("noise", 9.999, 10.0, 70.0), ("site", -48.0, 17.003, None), ("bar", 48.0, 17.0, None), ("site", None, 17.0, None)]
    calls = []
    monkeypatch.setattr(location, "durable", lambda df: (calls.append(1), tables.durable(df))[1])
    for name, most in (("TILE_SPOTS", 50), ("TILE_PLACES", 300)):
        monkeypatch.setattr(location, name, most)
    found = location._surveyed(spark.createDataFrame(spots, "lat double, lng double").distinct(), spark.createDataFrame(places, "type string, place_lat double, place_lng double, db double"), location.DEFAULTS)
    got = {(x.lat, x.lng): (x.grocery_or_supermarket, x.pharmacy, x.school, x.risk, x.transit and round(x.transit, 6), x.nearest and (round(x.nearest.distance, 6), x.nearest.db)) for x in found.collect()}
    assert len(calls) == 1

    def metres(a, b, c, d):
        h = math.sin(math.radians(c - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(math.radians(d - b) / 2) ** 2
        return 6371000.0 * 2 * math.atan2(math.sqrt(h), math.sqrt(1 - h))

    for s in set(spots):
        apart = [(k, metres(*s, lat, lng), db) for k, lat, lng, db in places if lat is not None]
        readings = [(-round(m, 6), db or 0, db) for k, m, db in apart if k == "noise" and m <= 500]
        stops = [round(m, 6) for k, m, _ in apart if k == "transit_station" and m <= 2000]
        want = (*(sum(k == t and m <= 800 for k, m, _ in apart) for t in location.AMENITIES), int(any(k == "site" and m <= 300 for k, m, _ in apart)), min(stops, default=None), (-max(readings)[0], max(readings)[2]) if readings else None)
        assert got.pop(s, (0, 0, 0, 0, None, None)) == want
    assert not got
    # within a tile, blocks and lots of pairs of any size find the same
    table = lambda rows, names: pa.table({n: pa.array(c) for n, c in zip(names, zip(*rows, strict=True), strict=True)})
    near = [p for p in places if p[1] is not None]
    one = lambda: sorted(location._look(table(spots, ["lat", "lng"]), table(near, ["type", "place_lat", "place_lng", "db"]), 800.0, 300.0, 2000.0, 500.0).to_pylist(), key=str)
    whole = one()
    monkeypatch.setattr(location, "BLOCK", 3)
    monkeypatch.setattr(location, "PAIRS", 5)
    assert [{k: v for k, v in x.items() if "_l" not in k} for x in one()] == [{k: v for k, v in x.items() if "_l" not in k} for x in whole]


def test_feed_keeps_few_tables(spark, monkeypatch):
    """r04 F3: the feed keeps the spots and the tiles, however many rings a search would take."""
    calls = []
    monkeypatch.setattr(location, "durable", lambda df: (calls.append(1), tables.durable(df))[1])
    assert QUERIES["q1_active_feed"](spark, SF).count() and len(calls) == 2


def test_checklist_keeps_few_tables(spark, monkeypatch):
    """r04 F4: so does the checklist, over the same feed."""
    calls = []
    monkeypatch.setattr(location, "durable", lambda df: (calls.append(1), tables.durable(df))[1])
    assert QUERIES["q9_checklist"](spark, SF).columns == ["id", "label", "ok"] and len(calls) == 2
