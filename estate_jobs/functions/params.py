"""Fixed values that results depend on, and the parameters that may be changed."""

from __future__ import annotations

from dataclasses import dataclass

# Rent in euros per square metre by district.
RENT_PER_M2 = {
    "bratislava i": 14.5, "bratislava ii": 11.8, "bratislava iii": 11.2, "bratislava iv": 10.5, "bratislava v": 10.8, "košice i": 8.2, "košice ii": 7.8, "žilina": 7.8, "nitra": 7.2,
    "trnava": 8.5, "trenčín": 6.8, "prešov": 7.0, "banská bystrica": 6.8, "martin": 6.5, "poprad": 6.2, "ružomberok": 6.0, "liptovský mikuláš": 5.8,
}
# Industrial zones, in the order in which they are looked for.
INDUSTRIAL_ZONES = ("žilina", "nitra", "trnava", "voderady", "šurany", "bytča", "kysucké nové mesto", "nové mesto nad váhom", "košice", "prešov")
# Deed flags in order, and bank names that clear them.
DEED_FLAGS = ("záložné právo", "exekúcia", "súdny spor", "vecné bremeno", "predkupné právo", "konkurz", "zabezpečovacie prevodné právo")
DEED_BANKS = ("slovenská sporiteľňa", "vúb", "tatra banka", "čsob", "prima banka", "unicredit", "oberbank", "hypotekárna banka", "365 bank", "mbank")
# Words in a path that exclude a link.
EXCLUDED = ("prenajom", "rodinn", "pozemok", "zahrad", "garaz", "kancelar", "chal", "chat", "obchodn", "sklado", "administr", "statie", "vikend", "budov", "kaviar", "reštaur", "hotel", "penzion")
# City coordinates, in the order in which they are looked for.
CITIES = (
    ("bratislava", 48.1486, 17.1077), ("košice", 48.7164, 21.2611), ("žilina", 49.2231, 18.7394), ("nitra", 48.3069, 18.0853), ("trnava", 48.3774, 17.5869), ("prešov", 48.9986, 21.2392),
    ("banská bystrica", 48.7395, 19.1531), ("trenčín", 48.8946, 18.0446), ("martin", 49.0627, 18.9218), ("poprad", 49.0594, 20.2981),
)
# Labels before a size, in order of priority.
SIZE_LABELS = ("úžitkov[áa]{s}+plocha", "podlahov[áa]{s}+plocha", "celkov[áa]{s}+plocha", "obytn[áa]{s}+plocha", "plocha{s}+bytu", "plocha{s}+úžitkov[áa]", "výmera", "rozloha", "plocha")
# The labels that sites with titles in meta tags are read by, all but one of these.
META_FIRST_LABELS = tuple(x for x in SIZE_LABELS if x != "plocha{s}+úžitkov[áa]")
# Energy classes that are known, and types of linked data that are listings.
ENERGY_CLASSES = ("A0", "A1", "A", "B", "C", "D", "E", "F", "G")
LD_TYPES = ("Product", "Apartment", "House", "Residence", "RealEstateListing", "SingleFamilyResidence", "Accommodation", "Place")


@dataclass(frozen=True)
class Params:
    """Rates, thresholds and radii of the scorers."""

    rate: float = 0.034
    years: int = 25
    ltv: float = 0.80
    tax_low: float = 0.19
    tax_high: float = 0.25
    tax_threshold: float = 41445.0
    tax_company: float = 0.21
    levy_personal: float = 0.16
    property_tax: float = 0.004
    vacancy: float = 0.05
    maintenance: float = 0.01
    default_rent: float = 6.0
    industrial_premium: float = 1.12
    green: float = 1.15
    yellow: float = 1.05
    setup_cost: float = 2500.0
    transit_walk: float = 560.0
    transit_search: float = 2000.0
    no_transit: float = 9999.0
    amenity_radius: float = 800.0
    construction_radius: float = 300.0
    noise_limit: float = 65.0
    #: Metres within which the nearest reading of noise counts.
    noise_reach: float = 500.0


DEFAULTS = Params()
