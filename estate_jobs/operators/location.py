"""Location score: points of interest around spots, in tiles; joins over grids and nearest places by rings."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from estate_jobs.functions.columns import haversine, rnd, zone
from estate_jobs.functions.params import CITIES, DEFAULTS, Params
from estate_jobs.sources.tables import durable

AMENITIES = ("grocery_or_supermarket", "pharmacy", "school")
#: Degrees of the grid that noise readings stand for.
CELL_LAT, CELL_LNG = 0.02, 0.03
#: Metres of a degree of latitude on the sphere of `haversine`; 0.1 % less, to be on the safe side.
DEGREE = 111_080.0
#: Metres of the first ring of a search for the nearest place; each further one is twice as wide.
FIRST_RING = 250.0
#: Parts that a crowded cell's spots are dealt to.
SPLIT = 4
#: Most spots and places of a tile that are one group, spots that are looked at together, places that pairs are made with at once.
TILE_SPOTS, TILE_PLACES, BLOCK, PAIRS = 16_384, 1_000_000, 128, 8_192
#: Metres of the sphere of `haversine`, and a chord (of a sphere of 1) of some micrometres on it.
RADIUS, TINY = 6_371_000.0, 1e-12
#: Columns of what a tile finds.
FOUND = ["lat", "lng", *AMENITIES, "sites", "stop_lat", "stop_lng", "noise_lat", "noise_lng", "db"]


def unscored(listings: DataFrame, scores: DataFrame) -> DataFrame:
    return listings.filter("lv_status = 'PASS' AND is_active = 1").join(scores.select(F.col("listing_id").alias("id")), "id", "left_anti")


def geocode(address: Column) -> tuple[Column, Column]:
    """Latitude and longitude of the first city, in order, that the address names; else null."""
    low = F.lower(address)
    at = lambda k: F.coalesce(*(F.when(F.contains(low, F.lit(c[0])), F.lit(c[k])) for c in CITIES))
    return at(1), at(2)


def located(listings: DataFrame) -> DataFrame:
    """listings with lat and lng: their own where both are there, else those of the city that the address names; others go."""
    lat, lng = geocode(F.col("address_raw"))
    if "lat" in listings.columns and "lng" in listings.columns:
        own = F.col("lat").isNotNull() & F.col("lng").isNotNull()
        lat, lng = F.when(own, F.col("lat")).otherwise(lat), F.when(own, F.col("lng")).otherwise(lng)
    return listings.withColumns({"lat": lat, "lng": lng}).filter("lat IS NOT NULL AND lng IS NOT NULL")


def _row(lat: Column, reach: Column) -> Column:
    return F.floor(lat / (reach / DEGREE)).cast("long")


def _column(row: Column, lng: Column, reach: Column) -> Column:
    """Cell of a longitude in a row of cells: at the latitudes of the row and its neighbours `reach` spans less than one cell."""
    high = F.least((F.abs(row) + 2) * (reach / DEGREE), F.lit(89.0))
    return F.floor(lng / (reach / DEGREE) * F.cos(F.radians(high))).cast("long")


def within_reach(points: DataFrame, places: DataFrame, *reaches: float) -> DataFrame:
    """points (lat, lng, others) and places (place_lat, place_lng, reach, others) at most `reach` metres apart, with distance.

    reaches: the values that reach has. Each has a grid of its own, with cells as large as it asks for at their latitude,
    up to 88 degrees; pairs across the 180th meridian aren't found. A place is sent to the nine cells around it, so the
    join is an equi-join by cell. It gives many rows for few bytes, so its partitions are as many as shuffles have, and
    the spots of a cell are dealt to some of them.
    """
    near, reach = F.array(F.lit(-1), F.lit(0), F.lit(1)), F.col("reach")
    parts, keys = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")), ["reach", "cy", "cx", "part"]
    rows = places.withColumn("cy", F.explode(F.transform(near, lambda d: _row(F.col("place_lat"), reach) + d)))
    sent = rows.withColumn("cx", F.explode(F.transform(near, lambda d: _column(F.col("cy"), F.col("place_lng"), reach) + d))).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SPLIT - 1))))
    seen = points.withColumn("reach", F.explode(F.array(*map(F.lit, reaches)))).withColumn("cy", _row(F.col("lat"), reach)).withColumn("cx", _column(F.col("cy"), F.col("lng"), reach)).withColumn("part", F.pmod(F.hash("lat", "lng"), F.lit(SPLIT)))
    joined = seen.repartition(parts, *keys).join(sent.repartition(parts, *keys), keys)
    distance = haversine(F.col("lat"), F.col("lng"), F.col("place_lat"), F.col("place_lng"))
    return joined.withColumn("distance", distance).filter(F.col("distance") <= reach).drop(*keys)


def within(points: DataFrame, places: DataFrame, radius: float) -> DataFrame:
    """points and places at most `radius` metres apart, with distance."""
    return within_reach(points, places.withColumn("reach", F.lit(float(radius))), float(radius))


def nearest(spots: DataFrame, places: DataFrame, limit: float, first: float = FIRST_RING, tie: Column | None = None) -> DataFrame:
    """spots (lat, lng, distinct) with `nearest`, a struct of distance and place of the nearest place, null if none is within limit.

    A ring that finds a place finds the nearest one, since it covers all that is closer; only spots that it finds none
    for go on to the next ring, twice as wide. Of places at the same distance the one with the greatest `tie` is taken.
    """
    others = [c for c in places.columns if c not in ("place_lat", "place_lng")]
    rank = F.struct((-F.col("distance")).alias("near"), (F.lit(0) if tie is None else tie).alias("tie"))
    left, found, ring = spots.select("lat", "lng"), None, min(first, limit)
    while True:
        best = within(left, places, ring).groupBy("lat", "lng").agg(F.max_by(F.struct("distance", *others), rank).alias("nearest"))
        done = durable(left.join(best, ["lat", "lng"], "left"))
        here = done if ring >= limit else done.filter("nearest IS NOT NULL")
        found = here if found is None else found.union(here)
        left = done.filter("nearest IS NULL").select("lat", "lng")
        if ring >= limit or left.isEmpty():
            return found
        ring = min(2 * ring, limit)


def _place(df: DataFrame, kind: Column, db: Column | None = None) -> DataFrame:
    return df.select(kind.alias("type"), F.col("lat").alias("place_lat"), F.col("lng").alias("place_lng"), (F.lit(None) if db is None else db).cast("double").alias("db"))


def _vectors(lat: np.ndarray, lng: np.ndarray) -> np.ndarray:
    lat, lng = np.radians(lat), np.radians(lng)
    return np.stack([np.cos(lat) * np.cos(lng), np.cos(lat) * np.sin(lng), np.sin(lat)], 1)


def _metres(lat1: np.ndarray, lng1: np.ndarray, lat2: np.ndarray, lng2: np.ndarray) -> np.ndarray:
    """As `haversine`."""
    a = np.sin(np.radians(lat2 - lat1) / 2) ** 2 + np.cos(np.radians(lat1)) * np.cos(np.radians(lat2)) * np.sin(np.radians(lng2 - lng1) / 2) ** 2
    return RADIUS * 2 * np.arctan2(np.sqrt(a), np.sqrt(1 - a))


class _Kind:
    """Places of one kind, by latitude."""

    def __init__(self, lat: np.ndarray, lng: np.ndarray, rank: np.ndarray, row: np.ndarray) -> None:
        order = np.argsort(lat, kind="stable")
        self.lat, self.lng, self.rank, self.row = lat[order], lng[order], rank[order], row[order]
        self.at = _vectors(self.lat, self.lng)

    def around(self, lat: np.ndarray, centre: np.ndarray, reach: float) -> tuple[int, np.ndarray]:
        """First of the places by latitude that can be within reach of the spots, and the chords from the centre to these."""
        k, n = np.searchsorted(self.lat, [lat.min() - reach / DEGREE, lat.max() + reach / DEGREE])
        return k, np.sqrt(((self.at[k:n] - centre) ** 2).sum(1))

    def count(self, lat: np.ndarray, lng: np.ndarray, at: np.ndarray, centre: np.ndarray, wide: float, reach: float) -> np.ndarray:
        """How many are within reach of each spot. All spots are within the chord `wide` of the centre.

        What is so near to the centre that it is near all spots, or so far that it is near none, needs no pairs. Pairs
        are compared by chords; those at the limit, but for rounding, by `_metres`.
        """
        first, chords = self.around(lat, centre, reach)
        limit = 2 * math.sin(reach / RADIUS / 2)
        all_near = chords < limit - wide - TINY
        some = first + np.flatnonzero(~all_near & (chords <= limit + wide + TINY))
        found = np.full(len(lat), all_near.sum())
        here = at - centre
        for k in range(0, len(some), PAIRS):
            x = some[k : k + PAIRS]
            there = self.at[x] - centre
            square = (here**2).sum(1)[:, None] + (there**2).sum(1) - 2 * here @ there.T
            close = limit**2 * 1e-7
            found += (square < limit**2 - close).sum(1)
            i, j = np.nonzero(np.abs(square - limit**2) <= close)
            found += np.bincount(i[_metres(lat[i], lng[i], self.lat[x[j]], self.lng[x[j]]) <= reach], minlength=len(lat))
        return found

    def nearest(self, lat: np.ndarray, lng: np.ndarray, centre: np.ndarray, wide: float, reach: float) -> np.ndarray:
        """Row of the nearest one to each spot, the one with the greatest rank of those at one distance; -1 if none is within reach."""
        best, rank, row = np.full(len(lat), reach * (1 + 1e-9)), np.full(len(lat), -np.inf), np.full(len(lat), -1)
        first, chords = self.around(lat, centre, reach)
        some = first + np.flatnonzero(chords <= chords.min(initial=np.inf) + 2 * wide + TINY)
        for k in range(0, len(some), PAIRS):
            x = some[k : k + PAIRS]
            metres = _metres(lat[:, None], lng[:, None], self.lat[x], self.lng[x])
            least = metres.min(1)
            j = np.where(metres == least[:, None], self.rank[x], -np.inf).argmax(1)
            better = (least < best) | (least == best) & (self.rank[x[j]] > rank)
            best[better], rank[better], row[better] = least[better], self.rank[x[j]][better], self.row[x[j]][better]
        return row


def _blocks(at: np.ndarray, rows: np.ndarray) -> Iterator[np.ndarray]:
    """Rows in blocks of spots that are near each other: halves along the longest side, again and again."""
    if len(rows) <= BLOCK:
        yield rows
        return
    side = np.ptp(at[rows], axis=0).argmax()
    rows, half = rows[np.argsort(at[rows, side], kind="stable")], len(rows) // 2
    yield from _blocks(at, rows[:half])
    yield from _blocks(at, rows[half:])


def _look(spots: pa.Table, places: pa.Table, amenities: float, sites: float, stops: float, noise: float) -> pa.Table:
    """Counts and nearest places of a tile's spots, among the places sent to it. The numbers: how far each kind is looked for."""
    lat, lng = spots["lat"].to_numpy(), spots["lng"].to_numpy()
    place_lat, place_lng, types = places["place_lat"].to_numpy(), places["place_lng"].to_numpy(), places["type"].to_numpy()
    db = places["db"].to_numpy()
    # an unknown reading comes before none at all, NaN last, as in Spark's order
    rank = np.where(places["db"].is_null().to_numpy(), np.finfo(float).min, np.where(np.isnan(db), np.inf, db))
    kinds = {t: _Kind(place_lat[k], place_lng[k], rank[k], k) for t in (*AMENITIES, "site", "transit_station", "noise") if len(k := np.flatnonzero(types == t))}
    at = _vectors(lat, lng)
    counts = {t: np.zeros(len(lat), np.int64) for t in (*AMENITIES, "site")}
    rows = {t: np.full(len(lat), -1) for t in ("transit_station", "noise")}
    for b in _blocks(at, np.arange(len(lat))):
        centre = at[b].mean(0)
        wide = np.sqrt(((at[b] - centre) ** 2).sum(1)).max()
        for t, kind in kinds.items():
            if t in counts:
                counts[t][b] = kind.count(lat[b], lng[b], at[b], centre, wide, sites if t == "site" else amenities)
            else:
                rows[t][b] = kind.nearest(lat[b], lng[b], centre, wide, noise if t == "noise" else stops)
    taken = {t: pa.array(r, mask=r < 0) for t, r in rows.items()}
    stop, reading = places.take(taken["transit_station"]), places.take(taken["noise"])
    return pa.table([spots["lat"], spots["lng"], *map(pa.array, counts.values()), stop["place_lat"], stop["place_lng"], reading["place_lat"], reading["place_lng"], reading["db"]], FOUND)


def _surveyed(spots: DataFrame, places: DataFrame, p: Params) -> DataFrame:
    """lat, lng of spots (distinct), a count for each amenity, risk, transit, nearest (distance and db of a reading); no rows for spots far from all.

    places: type, place_lat, place_lng, db; type site: construction, noise: readings. Spots and places meet in tiles as
    wide as the farthest reach, a place being sent to nine of them. A tile of many spots or places is cut into parts,
    every one of spots with every one of places; what the parts find is merged.
    """
    amenities, sites, stops, noise = map(float, (p.amenity_radius, p.construction_radius, p.transit_search, p.noise_reach))
    reach, near = F.lit(max(amenities, sites, stops, noise)), F.array(F.lit(-1), F.lit(0), F.lit(1))
    rows = places.filter(F.col("type").isin(*AMENITIES, "site", "transit_station", "noise") & F.col("place_lat").isNotNull() & F.col("place_lng").isNotNull()).withColumn("cy", F.explode(F.transform(near, lambda d: _row(F.col("place_lat"), reach) + d)))
    sent = rows.withColumn("cx", F.explode(F.transform(near, lambda d: _column(F.col("cy"), F.col("place_lng"), reach) + d)))
    seen = spots.select("lat", "lng").withColumn("cy", _row(F.col("lat"), reach)).withColumn("cx", _column(F.col("cy"), F.col("lng"), reach))
    parts = lambda df, most, name: df.groupBy("cy", "cx").agg(F.ceil(F.count("*") / most).cast("int").alias(name))
    tiles = durable(parts(seen, TILE_SPOTS, "spot_parts").join(parts(sent, TILE_PLACES, "place_parts"), ["cy", "cx"]))
    # without hints what is sent could be taken for small, since sizes are guessed by those of files
    tiles = F.broadcast(tiles) if tiles.count() <= 200_000 else tiles.hint("merge")
    keys = ["cy", "cx", "spot_part", "place_part"]
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    dealt = lambda n, *by: F.pmod(F.xxhash64(*by), F.col(n)).cast("int")
    left = seen.join(tiles, ["cy", "cx"]).withColumn("spot_part", dealt("spot_parts", "lat", "lng")).withColumn("place_part", every("place_parts")).select("lat", "lng", *keys)
    right = sent.join(tiles, ["cy", "cx"]).withColumn("place_part", dealt("place_parts", "place_lat", "place_lng")).withColumn("spot_part", every("spot_parts")).select("type", "place_lat", "place_lng", "db", *keys)
    kinds = dict.fromkeys(FOUND, "double") | dict.fromkeys((*AMENITIES, "sites"), "long")
    look = lambda a, b: _look(a, b, amenities, sites, stops, noise)
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(look, ", ".join(f"{c} {k}" for c, k in kinds.items()))
    apart = lambda x, most: F.when((d := haversine(F.col("lat"), F.col("lng"), F.col(f"{x}_lat"), F.col(f"{x}_lng"))) <= most * (1 + 1e-12), d)
    found = found.withColumns({"stop_m": apart("stop", stops), "noise_m": apart("noise", noise)})
    nearest = F.max_by(F.when(F.col("noise_m").isNotNull(), F.struct(F.col("noise_m").alias("distance"), "db")), F.when(F.col("noise_m").isNotNull(), F.struct((-F.col("noise_m")).alias("near"), "db")))
    return found.groupBy("lat", "lng").agg(*(F.sum(t).alias(t) for t in AMENITIES), (F.sum("sites") > 0).cast("int").alias("risk"), F.min("stop_m").alias("transit"), nearest.alias("nearest"))


def _with_surroundings(joined: DataFrame, p: Params) -> DataFrame:
    zero = {t: F.coalesce(t, F.lit(0)) for t in AMENITIES}
    return joined.withColumns(zero).withColumn("nearest_transit_m", rnd(F.coalesce("transit", F.lit(p.no_transit)), 1)).withColumn("amenity_count", sum((F.col(t) for t in AMENITIES[1:]), F.col(AMENITIES[0]))).drop("transit")


def surroundings(points: DataFrame, places: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """id, lat, lng, nearest_transit_m, a count for each amenity, amenity_count. points: id, lat, lng; one row an id.

    Listings at the same coordinates are looked up once.
    """
    spots = durable(points.select("lat", "lng").distinct())
    found = spots.join(_surveyed(spots, _place(places, F.col("type")).filter(F.col("type").isin("transit_station", *AMENITIES)), p), ["lat", "lng"], "left")
    return _with_surroundings(points.join(found, ["lat", "lng"]).select(*points.columns, "transit", *AMENITIES), p)


def _noise(found: DataFrame, noise: DataFrame, p: Params) -> DataFrame:
    """found with noise_flag for `nearest`: 1 if the nearest reading is over the limit, the loudest of those at one distance.

    Where no reading is within noise_reach, any reading of the spot's cell of the grid counts.
    """
    cell = lambda c, size: F.floor(F.col(c) / size).cast("long")
    loud = noise.filter(F.col("db") > p.noise_limit).select(cell("lat", CELL_LAT).alias("cy"), cell("lng", CELL_LNG).alias("cx")).distinct().withColumn("loud", F.lit(1))
    joined = found.withColumn("cy", cell("lat", CELL_LAT)).withColumn("cx", cell("lng", CELL_LNG)).join(loud, ["cy", "cx"], "left")
    flag = F.when(F.col("nearest").isNull(), F.coalesce("loud", F.lit(0))).otherwise(F.when(F.col("nearest.db") > p.noise_limit, 1).otherwise(0))
    return joined.withColumn("noise_flag", flag).drop("cy", "cx", "loud", "nearest")


def _hazards(sites: DataFrame, noise: DataFrame) -> DataFrame:
    return _place(sites, F.lit("site")).union(_place(noise, F.lit("noise"), F.col("db")))


def hazards(points: DataFrame, sites: DataFrame, noise: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """id, construction_risk, noise_flag. sites: lat, lng; noise: lat, lng, db."""
    spots = durable(points.select("lat", "lng").distinct())
    found = _noise(spots.join(_surveyed(spots, _hazards(sites, noise), p), ["lat", "lng"], "left").select("lat", "lng", "risk", "nearest"), noise, p)
    return points.join(found, ["lat", "lng"]).select("id", F.coalesce("risk", F.lit(0)).alias("construction_risk"), "noise_flag")


def score(transit: Column, amenities: Column, construction: Column, noise: Column, energy: Column, p: Params = DEFAULTS) -> tuple[Column, Column]:
    """Points and tier."""
    give = lambda condition, n: F.when(condition, n).otherwise(0)
    points = give(transit <= p.transit_walk, 30) + give(amenities >= 3, 20) + give(construction == 0, 20) + give(noise == 0, 20) + give(energy.isin("A0", "A1", "A"), 10)
    return points, F.when(noise != 0, "POOR").when(points >= 75, "PRIME").when(points >= 45, "SOLID").otherwise("STANDARD")


def run(listings: DataFrame, scores: DataFrame, places: DataFrame, sites: DataFrame, noise: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """New location scores of the listings that can be located, each distinct spot looked up once."""
    todo = located(unscored(listings, scores)).select("id", "lat", "lng", "district", "energy_class")
    spots, known = durable(todo.select("lat", "lng").distinct()), _place(places, F.col("type")).filter(F.col("type").isin("transit_station", *AMENITIES))
    found = _noise(spots.join(_surveyed(spots, known.union(_hazards(sites, noise)), p), ["lat", "lng"], "left"), noise, p)
    around = _with_surroundings(found.withColumn("construction_risk", F.coalesce("risk", F.lit(0))).drop("risk"), p)
    df = todo.join(around, ["lat", "lng"])
    points, tier = score(F.col("nearest_transit_m"), F.col("amenity_count"), F.col("construction_risk"), F.col("noise_flag"), F.col("energy_class"), p)
    return df.select(F.col("id").alias("listing_id"), "lat", "lng", "nearest_transit_m", *AMENITIES, "amenity_count", "construction_risk", "noise_flag", zone(F.col("district")).alias("industrial_zone"), points.cast("int").alias("location_score"), tier.alias("location_tier"), points.cast("int").alias("walkability_score"), F.lit(0).alias("flood_zone"))
