"""Registered queries: every operator over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from estate_jobs.functions.columns import haversine, rnd, zone
from estate_jobs.operators import cashflow, deeds, extract, location, merge, profile, serve
from estate_jobs.plans.adapters import Tables
from estate_jobs.plans.oracle import HAS_SCORE
from estate_jobs.sources import tables as sources

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
    QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
    return f


def _scored_ids(t: Tables) -> DataFrame:
    return t.listings.filter(HAS_SCORE).select(F.col("id").alias("listing_id"))


def _ready(t: Tables) -> DataFrame:
    return cashflow.unscored(t.listings, _no_scores(t))


def _scores(t: Tables) -> DataFrame:
    return cashflow.score(_ready(t))


def _no_scores(t: Tables) -> DataFrame:
    return t.spark.createDataFrame([], "listing_id string")


def _locations(t: Tables) -> DataFrame:
    sites = t.sites
    return location.run(t.stored("listings"), _no_scores(t), t.places, sites, sites)


def _feed(t: Tables, ordered: bool = False) -> DataFrame:
    """The feed over one stored table of listings, which it reads three times."""
    listings = t.stored("listings")
    return serve.active_feed(listings, cashflow.score(cashflow.unscored(listings, _no_scores(t))), _locations(t), ordered)


FEED = ("id", "source", "title", "price_eur", "size_m2", "energy_class", "lv_status", "classification", "cf_class", "surplus_sro", "ratio_sro", "is_industrial", "nearest_transit_m", "amenity_count", "construction_risk", "noise_flag", "location_tier", "walkability_score")


def _deeds_of(t: Tables, listings: DataFrame) -> DataFrame:
    """listings with doc_id, the deed document's key."""
    n = t.table("documents").count()
    return listings.withColumn("doc_id", F.col("okey") % n)


@query
def class_counts(t: Tables) -> DataFrame:
    return _scores(t).groupBy("classification").agg(F.count("*").alias("n"))


# --- sources

@query
def s1_raw_pages(t: Tables) -> DataFrame:
    return sources.raw_pages(t.table("pages"))


@query
def s2_listing_bodies(t: Tables) -> DataFrame:
    return extract.listing_bodies(t.bodies).select("body_id", "url")


# --- extraction

@query
def x1_detail_links(t: Tables) -> DataFrame:
    return extract.detail_links(t.link_pages, "example", "^/[A-Za-z]{4,}")


@query
def x3_chunk_urls(t: Tables) -> DataFrame:
    return extract.chunk_urls(t.chunk_pages)


@query
def x4_link_priority(t: Tables) -> DataFrame:
    pages = t.chunk_pages
    api = t.bodies.filter(F.size(extract.item_list(F.col("body"))) > 0).select(F.col("body_id").alias("page_id"))
    return extract.by_priority(extract.dom_links(pages), extract.chunk_urls(pages), api)


@query
def x8_page_titles(t: Tables) -> DataFrame:
    html = F.col("html")
    return t.head_pages.select("page_id", extract.page_title(html).alias("title"), extract.meta(html, "og:title").alias("og_title"))


@query
def x9_visible_text(t: Tables) -> DataFrame:
    return t.table("pages").select("page_id", F.md5(extract.visible_text(F.col("html")).cast("binary")).alias("text_md5"))


def _texts(t: Tables) -> DataFrame:
    return t.detail_pages.select("page_id", extract.visible_text(F.col("html")).alias("text"))


@query
def x10_text_prices(t: Tables) -> DataFrame:
    return _texts(t).select("page_id", extract.price_from_text(F.col("text")).alias("price_eur"))


@query
def x11_api_items(t: Tables) -> DataFrame:
    return t.bodies.select("body_id", F.size(extract.item_list(F.col("body"))).cast("long").alias("n_items"))


@query
def x12_api_listings(t: Tables) -> DataFrame:
    return extract.api_listings(extract.listing_bodies(t.bodies), "https://reality.example")


@query
def x13_text_sizes(t: Tables) -> DataFrame:
    return _texts(t).select("page_id", extract.size_from_text(F.col("text")).alias("size_m2"))


@query
def x14_energy(t: Tables) -> DataFrame:
    return _texts(t).select("page_id", extract.energy_from_text(F.col("text")).alias("energy_class"))


@query
def x15_districts(t: Tables) -> DataFrame:
    found = extract.district(F.col("address_raw"))
    return t.listings.select("id", found.alias("district"), extract.city(found).alias("city"))


@query
def x16_listing_ids(t: Tables) -> DataFrame:
    return t.table("pages").select("page_id", F.md5(F.col("url").cast("binary")).alias("id"))


@query
def x17_cards(t: Tables) -> DataFrame:
    return extract.cards(t.card_pages, "https://bazar.example")


@query
def x19_detail_rows(t: Tables) -> DataFrame:
    return extract.details(t.detail_pages)


@query
def x19_meta_first_rows(t: Tables) -> DataFrame:
    return extract.details(t.detail_pages, meta_first=True).drop("rooms")


@query
def x20_overlay(t: Tables) -> DataFrame:
    """Details of every listing, laid over those without a price: prices, sizes and rooms that are there or not."""
    k = F.col("okey")
    old = t.listings.select("id", F.when(k % 2 == 0, F.col("title")).otherwise("").alias("title"), "price_eur", "size_m2", F.lit(3).alias("rooms"), "energy_class", "address_raw", "district")
    new = t.listings.select("id", F.concat(F.lit("nový "), "title").alias("title"), F.when(k % 34 == 0, 1000.0).otherwise(0.0).alias("price_eur"), F.when(k % 3 == 0, 44.0).otherwise(0.0).alias("size_m2"), (k % 4).cast("int").alias("rooms"), F.when(k % 2 == 0, "B").otherwise("UNKNOWN").alias("energy_class"), F.when(k % 5 == 0, "Nová 1, Martin").otherwise("").alias("address_raw"), F.when(k % 5 == 0, "Martin").otherwise("").alias("district"))
    return extract.overlay(old, new, unpriced=True)


@query
def x21_backlog(t: Tables) -> DataFrame:
    return extract.backlog(t.listings, "src1").select("id", "scraped_at")


@query
def x22_gains(t: Tables) -> DataFrame:
    after = t.listings.select("id", F.when(F.col("okey") % 2 == 0, 5.0).otherwise(F.col("price_eur")).alias("price_eur"), F.when(F.col("okey") % 3 == 0, 5.0).otherwise(F.col("size_m2")).alias("size_m2"))
    return extract.gains(t.listings, after)


@query
def x23_unseen_links(t: Tables) -> DataFrame:
    pages = t.table("pages").select("page_id", F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit(r'href="([^"]*)"'), F.lit(1)))).alias("link"))
    return extract.unseen(pages, pages.filter("page_id % 5 = 0")).select("page_id", "link")


# --- merges

@query
def m1_merge(t: Tables) -> DataFrame:
    return merge.fold(t.observations)


@query
def m2_score_replace(t: Tables) -> DataFrame:
    """New scores of all ready listings over older ones of some."""
    listings = t.stored("listings")
    new = cashflow.score(cashflow.unscored(listings, _no_scores(t))).select("listing_id", "classification")
    old = listings.filter(HAS_SCORE).select(F.col("id").alias("listing_id"), F.lit("OLD").alias("classification"))
    stored = merge.replace(old, new).select(F.col("listing_id").alias("id"), F.col("classification").alias("stored_class"))
    return merge.write_back(listings, new).join(stored, "id", "left").select("id", "classification", "stored_class")


@query
def m4_deed_status(t: Tables) -> DataFrame:
    found = deeds.judge(_deeds_of(t, deeds.pending(t.listings)), t.deeds, "doc_id")
    updated, log = merge.set_deed_status(t.listings, found)
    return updated.join(log.select(F.col("listing_id").alias("id"), F.col("reason").alias("logged")), "id", "left").select("id", "lv_status", "logged")


@query
def m5_insert_or_ignore(t: Tables) -> DataFrame:
    """What is there: a row for each district with small flats; the seed: rows that share ids and districts."""
    existing = t.listings.filter("size_m2 < 60").groupBy(F.trim("district").alias("district")).agg(F.min("okey").alias("seq")).select(F.concat(F.lit("s"), F.col("seq").cast("string")).alias("id"), "district", F.lit("small").alias("size_band"), (-F.col("seq")).alias("seq"))
    return merge.insert_or_ignore(existing, t.seeds, order="seq")


@query
def m6_valid_rows(t: Tables) -> DataFrame:
    rows = t.observations.withColumn("source", F.when(F.col("seq") % 9 != 0, F.col("source")))
    both = merge.valid(rows).select(F.lit(True).alias("ok")).union(merge.invalid(rows).select(F.lit(False)))
    return both.agg(F.count_if("ok").alias("valid"), F.count_if(~F.col("ok")).alias("quarantined"))


# --- deeds

@query
def l1_pending(t: Tables) -> DataFrame:
    return deeds.pending(t.listings).select("id")


@query
def l2_verdicts(t: Tables) -> DataFrame:
    return deeds.verdicts(t.deeds)


@query
def l3_debt_filter(t: Tables) -> DataFrame:
    found = deeds.judge(_deeds_of(t, deeds.pending(t.listings)), t.deeds, "doc_id")
    return found.agg(F.count_if(F.col("status") == "PASS").alias("passed"), F.count_if(F.col("status") == "REJECTED").alias("rejected"))


@query
def l4_reverify(t: Tables) -> DataFrame:
    ids = t.listings.select("id").union(t.table("nation").select(F.concat(F.lit("missing-"), F.col("n_nationkey").cast("string"))))
    return deeds.reverify(ids, _deeds_of(t, t.listings), t.deeds, "doc_id").select("id", "status", "reason")


# --- cash flow

@query
def c1_unscored(t: Tables) -> DataFrame:
    return cashflow.unscored(t.listings, _scored_ids(t)).select("id")


@query
def c2_rent_estimate(t: Tables) -> DataFrame:
    return t.listings.select("id", cashflow.rent(F.col("district"), F.col("size_m2")).alias("rent_estimate"), zone(F.col("district")).alias("zone"))


@query
def c4_mortgage(t: Tables) -> DataFrame:
    gain = F.col("price_eur") - 20000
    return t.listings.select("id", rnd(cashflow.annuity(F.col("price_eur") * 0.8, F.lit(0.034), F.lit(25)), 2).alias("mortgage"), cashflow.hoa(F.col("size_m2")).alias("hoa"), rnd(cashflow.tax_personal(gain), 2).alias("tax_personal"), rnd(cashflow.tax_company(gain), 2).alias("tax_company"))


@query
def c14_cashflow_score(t: Tables) -> DataFrame:
    return _scores(t)


@query
def c15_what_if(t: Tables) -> DataFrame:
    scenarios = t.spark.createDataFrame([("base", None, None, None, None), ("rich", 9000.0, 0.6, 0.05, 20), ("free", 0.0, 1.0, 0.0, 30)], "scenario string, rent_override double, ltv double, rate double, years int")
    return cashflow.what_if(_ready(t), scenarios).select("scenario", "listing_id", "surplus_sro", "ratio_sro", "income_tax_personal", "classification", "mortgage_rate_used", "ltv_used", "loan_term_years")


@query
def c16_scoring_run(t: Tables) -> DataFrame:
    return cashflow.run(t.listings, _scored_ids(t)).groupBy("classification").agg(F.count("*").alias("n"))


# --- location

@query
def g1_unscored_location(t: Tables) -> DataFrame:
    return location.unscored(t.listings, _scored_ids(t)).select("id")


@query
def g2_geocode(t: Tables) -> DataFrame:
    lat, lng = location.geocode(F.col("address_raw"))
    return t.listings.select("id", lat.alias("lat"), lng.alias("lng")).filter("lat IS NOT NULL")


@query
def g3_haversine(t: Tables) -> DataFrame:
    return t.listings.select("id", rnd(haversine(F.col("lat"), F.col("lng"), F.lit(48.1486), F.lit(17.1077)), 1).alias("metres"))


def _points(t: Tables) -> DataFrame:
    return location.located(location.unscored(t.listings, _no_scores(t))).select("id", "lat", "lng")


@query
def g4_surroundings(t: Tables) -> DataFrame:
    return location.surroundings(_points(t), t.places).drop("lat", "lng")


@query
def g6_hazards(t: Tables) -> DataFrame:
    return location.hazards(_points(t), t.sites, t.sites)


@query
def g8_location_run(t: Tables) -> DataFrame:
    return _locations(t)


# --- serving

@query
def q1_active_feed(t: Tables) -> DataFrame:
    return _feed(t, ordered=True).select(*FEED)


@query
def q2_rejected_feed(t: Tables) -> DataFrame:
    log = merge.set_deed_status(t.listings, deeds.judge(_deeds_of(t, t.listings), t.deeds, "doc_id"))[1]
    stamped = log.join(t.listings.select(F.col("id").alias("listing_id"), F.col("scraped_at").alias("flagged_at")), "listing_id")
    return serve.rejected_feed(t.listings, stamped).select("id", "title", "reason", "detail", "flagged_at")


@query
def q3_stats(t: Tables) -> DataFrame:
    return serve.stats(merge.write_back(t.listings, _scores(t)))


@query
def q4_completeness(t: Tables) -> DataFrame:
    return serve.completeness(t.listings)


@query
def q5_backlog_counts(t: Tables) -> DataFrame:
    waiting = cashflow.unscored(t.listings, _scored_ids(t))
    both = _ready(t).filter(HAS_SCORE).select(F.lit(True).alias("has")).union(waiting.select(F.lit(False)))
    return both.agg(F.count_if("has").alias("scored"), F.count_if(~F.col("has")).alias("unscored"))


@query
def q6_latest(t: Tables) -> DataFrame:
    return serve.latest(t.listings, "src0").select("id", "title", "scraped_at")


@query
def q7_affordable(t: Tables) -> DataFrame:
    return serve.affordable(t.listings).select("id", "price_eur", "size_m2")


@query
def q8_class_buckets(t: Tables) -> DataFrame:
    return serve.top_of_classes(_feed(t), 25).select("id", "cls", "surplus_sro", "rn")


@query
def q8_class_sizes(t: Tables) -> DataFrame:
    return serve.class_sizes(_feed(t))


@query
def q9_cost_lines(t: Tables) -> DataFrame:
    return serve.cost_lines(_scores(t), F.lower("optimal_structure"))


@query
def q9_checklist(t: Tables) -> DataFrame:
    return serve.location_checklist(_feed(t))


@query
def q10_contract_drafts(t: Tables) -> DataFrame:
    return serve.contract_drafts(t.listings, t.deals, _scores(t), "2026-01-31 06:00")


# --- profiles

@query
def p1_path_prefixes(t: Tables) -> DataFrame:
    return profile.path_prefixes(t.table("pages"))


@query
def p2_candidates(t: Tables) -> DataFrame:
    return profile.candidates(t.site_pages)


@query
def p3_pattern_counts(t: Tables) -> DataFrame:
    return profile.pattern_counts(t.site_pages)


@query
def p4_health(t: Tables) -> DataFrame:
    return profile.health(t.table("pages"))


@query
def p5_mined_urls(t: Tables) -> DataFrame:
    return profile.mined_urls(t.site_pages)


@query
def p5_mined_bundles(t: Tables) -> DataFrame:
    return profile.mined_bundles(t.site_pages, t.bundles)


@query
def p6_scripts(t: Tables) -> DataFrame:
    return profile.scripts(t.site_pages).select("page_id", F.size("scripts").cast("long").alias("n"), F.array_join("scripts", ",").alias("scripts"))


@query
def p7_numeric_ids(t: Tables) -> DataFrame:
    return profile.numeric_ids(t.site_pages)


@query
def p8_snippets(t: Tables) -> DataFrame:
    return profile.snippets(t.table("pages"), "<h1>", 10).select("page_id", F.array_join("snippets", "¦").alias("snippets"), F.array_join("classes", "¦").alias("classes"))


@query
def p9_pagination(t: Tables) -> DataFrame:
    return profile.pagination(t.site_pages)


@query
def p10_repeats(t: Tables) -> DataFrame:
    pages = t.table("pages").select("page_id", F.split_part("url", F.lit("/"), F.lit(3)).alias("site"), F.col("page_id").alias("page_no"), "html")
    return profile.repeats(pages)


@query
def p11_body_shapes(t: Tables) -> DataFrame:
    return profile.body_shapes(t.bodies)


@query
def p11_schema_profile(t: Tables) -> DataFrame:
    return profile.schema_profile(t.bodies)


@query
def p12_state_blobs(t: Tables) -> DataFrame:
    """State of listings in pages of which every seventh has none, every second a list more."""
    more = F.when(F.col("okey") % 2 == 0, ',"more":[{"url":"/x","price":1.5}]').otherwise("")
    blob = F.concat(F.lit('<script id="__NEXT_DATA__" type="application/json">{"props":{},"url":"'), "url", F.lit('","price":'), F.floor("price_eur").cast("string"), more, F.lit("}</script>"))
    return profile.state_blobs(t.listings.select(F.col("okey").alias("page_id"), F.when(F.col("okey") % 7 == 0, "<p>no state</p>").otherwise(blob).alias("html")))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return class_counts(Tables(spark, sf_dir))
