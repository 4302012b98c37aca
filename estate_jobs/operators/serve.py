"""Serving queries: feeds, statistics, buckets, drafts."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _without(df: DataFrame, key: str, *drop: str) -> DataFrame:
    return df.withColumnRenamed("listing_id", key).drop(*drop)


def active_feed(listings: DataFrame, scores: DataFrame, locations: DataFrame, ordered: bool = True) -> DataFrame:
    """Active listings that aren't rejected, with their scores; ordered: best company surplus first, none last."""
    live = listings.filter("is_active = 1 AND lv_status <> 'REJECTED'")
    scored = _without(scores.withColumnRenamed("classification", "cf_class"), "id")
    placed = _without(locations, "id", "lat", "lng")
    feed = live.join(scored, "id", "left").join(placed, "id", "left")
    return feed.orderBy(F.col("surplus_sro").desc_nulls_last(), "id") if ordered else feed


def rejected_feed(listings: DataFrame, log: DataFrame) -> DataFrame:
    return log.withColumnRenamed("listing_id", "id").join(listings, "id").orderBy(F.desc("flagged_at"), "id")


def stats(listings: DataFrame) -> DataFrame:
    """Counts over active listings; null sums where there is none."""
    total = lambda condition, name: F.sum(F.when(condition, 1).otherwise(0)).cast("long").alias(name)
    cls = F.col("classification")
    return listings.filter("is_active = 1").agg(F.count("*").alias("total"), *(total(cls == c.upper(), c) for c in ("green", "yellow", "white")), total(F.col("lv_status") == "REJECTED", "rejected"), total(F.col("lv_status") == "PENDING", "pending"))


def completeness(listings: DataFrame) -> DataFrame:
    total = lambda condition, name: F.sum(F.when(condition, 1).otherwise(0)).cast("long").alias(name)
    price, size = F.col("price_eur") > 0, F.col("size_m2") > 0
    return listings.groupBy("source").agg(F.count("*").alias("total"), total(price, "has_price"), total(size, "has_size"), total(price & size, "has_both"), total(F.col("lv_status") == "PENDING", "pending"))


def latest(listings: DataFrame, source: str, n: int = 8) -> DataFrame:
    """The newest n of a source, with titles of at most 60 characters."""
    return listings.filter(F.col("source") == source).orderBy(F.desc("scraped_at"), "id").limit(n).withColumn("title", F.substring("title", 1, 60))


def affordable(feed: DataFrame, most_price: float = 300_000, least_size: float = 25) -> DataFrame:
    return feed.filter((F.coalesce("price_eur", F.lit(0.0)) <= most_price) & (F.coalesce("size_m2", F.lit(0.0)) >= least_size))


def feed_class() -> Column:
    return F.coalesce("cf_class", "classification", F.lit("PENDING"))


def top_of_classes(feed: DataFrame, k: int) -> DataFrame:
    """The k best of each class. Ranks are limited before the shuffle, so a class of most rows stays small."""
    ranked = feed.withColumn("cls", feed_class()).withColumn("rn", F.row_number().over(W.partitionBy("cls").orderBy(F.coalesce("surplus_sro", F.lit(0.0)).desc(), "id")))
    rank = F.when(F.col("cls") == "GREEN", 0).when(F.col("cls") == "YELLOW", 1).when(F.col("cls") == "WHITE", 2).otherwise(3)
    return ranked.filter(F.col("rn") <= k).withColumn("class_rank", rank).orderBy("class_rank", "rn")


def class_sizes(feed: DataFrame) -> DataFrame:
    return feed.groupBy(feed_class().alias("cls")).agg(F.count("*").alias("n"))


# Labels of cost lines and the columns that they show, {s} for the structure.
COSTS = (("Mortgage", "mortgage_monthly"), ("HOA", "hoa_monthly"), ("Property Tax", "property_tax_monthly"), ("Vacancy 5%", "vacancy_cost"), ("Maintenance", "maintenance_monthly"), ("Income Tax", "income_tax_{s}"), ("Health Levy", "health_levy_{s}"), ("TOTAL COSTS", "total_{s}"), ("NET SURPLUS", "surplus_{s}"))


def cost_lines(scores: DataFrame, structure: Column) -> DataFrame:
    """listing_id, label, value: a row for each cost that is known, the total unless it is 0, and the surplus, under each row's structure (sro or personal)."""
    under = lambda c: F.when(structure == "sro", F.col(c.format(s="sro"))).otherwise(F.col(c.format(s="personal")))
    wide = scores.select("listing_id", *(under(c).alias(label) for label, c in COSTS))
    return wide.unpivot("listing_id", [label for label, _ in COSTS], "label", "value").filter("value IS NOT NULL AND NOT (label = 'TOTAL COSTS' AND value = 0)")


def location_checklist(feed: DataFrame) -> DataFrame:
    """id, label, ok: eight checks of each listing."""
    ok = {
        "Transit": F.coalesce("nearest_transit_m", F.lit(9999.0)) <= 560, "Amenities": F.coalesce("amenity_count", F.lit(0)) >= 3, "Walkability": F.col("walkability_score").isNotNull(), "Industrial": F.coalesce(F.col("is_industrial") == 1, F.lit(False)),
        "Construction": F.coalesce("construction_risk", F.lit(0)) == 0, "Noise": F.coalesce("noise_flag", F.lit(0)) == 0, "Energy Class": F.col("energy_class").isNotNull(), "LV Status": F.coalesce(F.col("lv_status").isin("PASS", "CLEAN"), F.lit(False)),
    }
    return feed.select("id", *(c.alias(k) for k, c in ok.items())).unpivot("id", list(ok), "label", "ok")


_RULE = "━" * 58
# The sections of a draft. Names in braces are filled in for each deal.
DRAFT = (
    "╔" + "═" * 58 + "╗", "║         KÚPNA ZMLUVA — DRAFT / NÁVRH ZMLUVY             ║", "╚" + "═" * 58 + "╝", "",
    "Vygenerované:  {generated}", "Stav:          DRAFT — vyžaduje notariálne vyhotovenie", "", _RULE, "",
    "§ 1. PREDMET ZMLUVY", "", "Nehnuteľnosť: {title}", "Adresa:       {address_raw}", "Okres:        {district}", "Výmera:       {size} m²", "Energetická trieda: {energy}", "",
    "Katastrálne územie: {area}", "Číslo parcely:      {parcel}", "List vlastníctva:   [Overiť na Katastri pred podpisom]", "LV Status:          {lv} (stav k dátumu generovania)", "", _RULE, "",
    "§ 2. ZMLUVNÉ STRANY", "", "KUPUJÚCI (Buyer):", "  Meno / Spoločnosť: {buyer}", "  IČO:               {buyer_id}", "  Forma vlastníctva: {ownership}", "",
    "PREDÁVAJÚCI (Seller):", "  [Doplniť notárom — overiť totožnosť a vlastníctvo]", "", _RULE, "",
    "§ 3. KÚPNA CENA", "", "Dohodnutá cena:    €{agreed}", "Záloha (depozit):  €{deposit}", "Zostatok:          €{rest}", "", "Platobný mechanizmus:", "  {payment_text}", "", _RULE, "",
    "§ 4. PODMIENKY", "", "1. Zmluva nadobúda platnosť podpisom oboch strán pred notárom.", "2. Prevod vlastníctva nastáva zápisom do katastra nehnuteľností.", "3. Predávajúci zaručuje, že nehnuteľnosť je bez právnych vád.",
    "4. Kupujúci vyhlasuje, že je oboznámený so stavom nehnuteľnosti.", "5. {condition}", "", _RULE, "",
    "§ 5. NOTÁR", "", "Notár:   {notary}", "Dátum:   [Doplniť]", "Miesto:  [Doplniť]", "", _RULE, "",
    "FINANČNÁ ANALÝZA (pre interné účely):", "", "s.r.o. surplus/mo:  €{surplus}", "Ročná úspora s.r.o.: €{saving}", "Net Yield:           {net_yield}%", "LV overenie:        {lv} — OVERIŤ 48H PRED PODPISOM", "", _RULE, "",
    "⚠️  PRÁVNE UPOZORNENIE", "", "Tento dokument je počítačom generovaný NÁVRH bez právnej záväznosti.", "Nemá žiadnu právnu platnosť bez vyhotovenia a overenia licencovaným", "slovenským notárom. Vždy overte LV bezprostredne pred podpisom.", "Finálny prevod vyžaduje zápis na Katastri nehnuteľností SR.",
)
# Payment, with and without escrow: short, in section 3, in section 4.
ESCROW = ("Notárska úschova", "✅ Notárska úschova — odporúčané", "Finančné plnenie cez Notársku úschovu dle § 56a Notárskeho poriadku.")
DIRECT = ("Priamy prevod", "⚠️ Priamy prevod — neodporúčané", "Finančné plnenie na účet predávajúceho po podpise zmluvy.")


def contract_drafts(listings: DataFrame, deals: DataFrame, scores: DataFrame, generated: str) -> DataFrame:
    """listing_id, remainder, payment, buyer_id, structure, draft_text of the deals with a buyer.

    deals: listing_id, buyer, ico, agreed, deposit, escrow, notary, structure (sro or personal); generated: the time
    that the drafts bear. What a listing or its score lacks gets a placeholder.
    """
    cents = lambda c: F.round(c.cast("decimal(28,10)"), 2)
    grouped = lambda c, n: F.format_number(F.round(c.cast("decimal(28,10)"), n), n)
    known = lambda c, other: F.coalesce(F.col(c).cast("string"), F.lit(other)) if c in listings.columns else F.lit(other)
    by = F.when(F.col("escrow"), 0).otherwise(1)
    pay = lambda k: F.when(by == 0, ESCROW[k]).otherwise(DIRECT[k])
    money = scores.select("listing_id", "surplus_sro", "annual_sro_saving", "net_rental_yield")
    df = deals.filter("trim(buyer) <> ''").join(listings.withColumnRenamed("id", "listing_id"), "listing_id").join(money, "listing_id", "left")
    df = df.withColumn("remainder", cents(F.col("agreed") - F.col("deposit")).cast("double"))
    buyer_id = F.coalesce(F.nullif("ico", F.lit("")), F.lit("N/A — fyzická osoba"))
    fill = {
        "generated": F.lit(generated), "title": known("title", "—"), "address_raw": known("address_raw", "—"), "district": known("district", "—"), "size": known("size_m2", "?"), "energy": known("energy_class", "—"),
        "area": known("cadastral_area", "[Doplniť]"), "parcel": known("cadastral_number", "[Doplniť]"), "lv": known("lv_status", "PENDING"), "buyer": F.col("buyer"), "buyer_id": buyer_id,
        "ownership": F.when(F.col("structure") == "sro", "s.r.o.").otherwise("Personal"), "agreed": grouped(F.col("agreed"), 2), "deposit": grouped(F.col("deposit"), 2), "rest": grouped(F.col("remainder"), 2),
        "payment_text": pay(1), "condition": pay(2), "notary": F.coalesce(F.nullif("notary", F.lit("")), F.lit("[Prideliť notára]")),
        "surplus": F.coalesce(grouped(F.col("surplus_sro"), 0), F.lit("—")), "saving": F.coalesce(grouped(F.col("annual_sro_saving"), 0), F.lit("—")), "net_yield": F.format_string("%.2f", cents(F.coalesce("net_rental_yield", F.lit(0.0)) * 100).cast("double")),
    }
    # the text is cut at the names: fixed parts and values in turn
    parts = re.split(r"\{(\w+)\}", "\n".join(DRAFT))
    text = F.concat(*(fill[x] if k % 2 else F.lit(x) for k, x in enumerate(parts)))
    return df.select("listing_id", "remainder", pay(0).alias("payment"), buyer_id.alias("buyer_id"), "structure", text.alias("draft_text"))
