"""Rental cash flow under personal and company tax: one projection, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from estate_jobs.functions.columns import place_key, rnd, zone
from estate_jobs.functions.params import DEFAULTS, RENT_PER_M2, Params


def unscored(listings: DataFrame, scores: DataFrame) -> DataFrame:
    """Active listings with a price and a size, not rejected, that have no score yet. A null deed status is excluded."""
    ready = listings.filter("lv_status <> 'REJECTED' AND price_eur > 0 AND size_m2 > 0 AND is_active = 1")
    return ready.join(scores.select(F.col("listing_id").alias("id")), "id", "left_anti")


def rent(district: Column, size: Column, p: Params = DEFAULTS) -> Column:
    rates = F.create_map(*(F.lit(x) for pair in RENT_PER_M2.items() for x in pair))
    rate = F.coalesce(F.try_element_at(rates, place_key(district)), F.lit(p.default_rent))
    return rnd(rate * F.when(zone(district) != "", p.industrial_premium).otherwise(1.0) * size, 2)


def annuity(loan: Column, rate: Column, years: Column) -> Column:
    """Monthly payment; 0 without a loan, plain division at rate 0."""
    r, n = rate / 12, years * 12
    growth = F.pow(1 + r, n)
    return F.when(loan <= 0, 0.0).when(rate == 0, loan / n).otherwise(loan * (r * growth) / (growth - 1))


def hoa(size: Column) -> Column:
    return F.when(size < 40, 35.0).when(size <= 70, 60.0).when(size <= 120, 90.0).otherwise(130.0)


def tax_personal(net: Column, p: Params = DEFAULTS) -> Column:
    high = p.tax_threshold * p.tax_low + (net - p.tax_threshold) * p.tax_high
    return F.when(net <= 0, 0.0).when(net <= p.tax_threshold, net * p.tax_low).otherwise(high)


def tax_company(net: Column, p: Params = DEFAULTS) -> Column:
    return F.greatest(net * p.tax_company, F.lit(0.0))


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def score(listings: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """All score columns of listings (id, price_eur, size_m2, district).

    Columns rent_override, ltv, rate and years, where present and not null, replace the parameters row by row.
    """
    given = lambda name, value: F.coalesce(F.col(name), F.lit(value)) if name in listings.columns else F.lit(value)
    extra = [c for c in ("scenario",) if c in listings.columns]
    override = F.nullif(F.col("rent_override"), F.lit(0.0)) if "rent_override" in listings.columns else F.lit(None).cast("double")
    df = listings.select("id", *extra, F.col("price_eur").alias("price"), F.col("size_m2").alias("size"), "district", given("ltv", p.ltv).alias("ltv"), given("rate", p.rate).alias("rate"), given("years", p.years).alias("years"), override.alias("override"))
    c = F.col
    df = df.withColumns({"rent": F.coalesce("override", rent(c("district"), c("size"), p)), "loan": c("price") * c("ltv"), "equity": c("price") * (1 - c("ltv")), "hoa": hoa(c("size")), "ptax": c("price") * p.property_tax / 12, "maint": c("price") * p.maintenance / 12})
    df = df.withColumns({"mortgage": annuity(c("loan"), c("rate"), c("years")), "vacancy": c("rent") * p.vacancy})
    df = df.withColumn("operating", c("mortgage") + c("hoa") + c("ptax") + c("vacancy") + c("maint")).withColumn("net", (c("rent") - c("operating")) * 12)
    gain = F.greatest(c("net"), F.lit(0.0))
    df = df.withColumns({"tax_p": tax_personal(gain, p) / 12, "levy_p": gain * p.levy_personal / 12, "tax_s": tax_company(gain, p) / 12})
    df = df.withColumns({"total_p": c("operating") + c("tax_p") + c("levy_p"), "total_s": c("operating") + c("tax_s")})
    df = df.withColumns({"surplus_p": c("rent") - c("total_p"), "surplus_s": c("rent") - c("total_s"), "ratio_p": _ratio(c("rent"), c("total_p")), "ratio_s": _ratio(c("rent"), c("total_s"))})
    df = df.withColumn("saving", (c("surplus_s") - c("surplus_p")) * 12)
    df = df.withColumn("class", F.when(c("ratio_s") >= p.green, "GREEN").when(c("ratio_s") >= p.yellow, "YELLOW").otherwise("WHITE")).withColumn("months", F.when(c("saving") > 0, F.ceil(p.setup_cost / (c("saving") / 12)).cast("int")))
    # The sentences of the recommendation.
    percent = F.format_string("%.1f", rnd(c("ratio_s") * 100, 1))
    lead = F.when(c("class") == "GREEN", F.concat(F.lit("🟢 GREEN — self-funding via s.r.o. (ratio "), percent, F.lit("%). Hold 20+ years."))).when(c("class") == "YELLOW", F.concat(F.lit("🟡 YELLOW — yield play (ratio "), percent, F.lit("%). Strong income asset."))).otherwise(F.concat(F.lit("⚪ WHITE — below threshold ("), percent, F.lit("%). Flip or pass.")))
    saves = F.when(c("saving") > 0, F.concat(F.lit("s.r.o. saves €"), F.format_number(F.round(c("saving").cast("decimal(28,10)"), 0), 0), F.lit("/yr vs personal. Setup cost recovered in "), c("months").cast("string"), F.lit(" months."))).otherwise("Personal ownership marginally better — low income band.")
    premium = F.when(zone(c("district")) != "", F.concat(F.lit("⚙️ Industrial zone premium applied ("), c("district"), F.lit(").")))
    money = {"rent_estimate": "rent", "mortgage_monthly": "mortgage", "hoa_monthly": "hoa", "property_tax_monthly": "ptax", "vacancy_cost": "vacancy", "maintenance_monthly": "maint", "income_tax_personal": "tax_p", "health_levy_personal": "levy_p", "total_personal": "total_p", "surplus_personal": "surplus_p", "income_tax_sro": "tax_s", "total_sro": "total_s", "surplus_sro": "surplus_s", "annual_sro_saving": "saving"}
    shares = {"ratio_personal": c("ratio_p"), "ratio_sro": c("ratio_s"), "cash_on_cash": _ratio(c("surplus_s") * 12, c("equity")), "net_rental_yield": _ratio(c("surplus_s") * 12, c("price")), "gross_rental_yield": _ratio(c("rent") * 12, c("price"))}
    return df.select(
        F.col("id").alias("listing_id"), *extra, *(rnd(c(b), 2).alias(a) for a, b in money.items()), *(rnd(x, 4).alias(a) for a, x in shares.items()), F.lit(0.0).alias("health_levy_sro"),
        F.when(c("saving") >= 0, "SRO").otherwise("PERSONAL").alias("optimal_structure"), c("months").alias("break_even_months"), c("class").alias("classification"), F.concat_ws(" ", lead, saves, premium).alias("recommendation"),
        (zone(c("district")) != "").cast("int").alias("is_industrial"), c("rate").alias("mortgage_rate_used"), c("ltv").alias("ltv_used"), c("years").cast("int").alias("loan_term_years"),
    )


def what_if(listings: DataFrame, scenarios: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """score() of every listing under every scenario (scenario, rent_override, ltv, rate, years).

    Scenarios come as a table of some dozens; the count decides whether it may be broadcast.
    """
    few = scenarios.limit(1001).count() <= 1000
    return score(listings.crossJoin(F.broadcast(scenarios) if few else scenarios), p)


def run(listings: DataFrame, scores: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """New scores of the listings that wait for one."""
    return score(unscored(listings, scores), p)
