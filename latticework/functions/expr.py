"""Column expressions: missing values, guarded arithmetic, parsing, classification."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(c: Column) -> Column:
    """NaN and infinities become null, so that aggregates and least/greatest aren't poisoned."""
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def any_zero(*cols: Column) -> Column:
    """True where some column is 0; nulls aren't 0, so the negation keeps them."""
    return reduce(lambda a, b: a | b, (F.coalesce(c == 0, F.lit(False)) for c in cols))


def clip(c: Column, low: Column, high: Column) -> Column:
    return F.when(c.isNotNull(), F.least(F.greatest(c, low), high))


def minmax(c: Column, low: Column, high: Column) -> Column:
    """To [0, 1]; 0 where the range is empty."""
    return F.when(high > low, (c - low) / (high - low)).otherwise(F.when(c.isNotNull(), F.lit(0.0)))


def directed(c: Column, low: Column, high: Column, benefit: bool) -> Column:
    return minmax(c, low, high) if benefit else 1 - minmax(c, low, high)


def chart_scale(c: Column, low: Column, high: Column, invert: bool = False) -> Column:
    s = (c - low) / (high - low + 1e-9)
    return 1 - s if invert else s


def number(c: Column) -> Column:
    """A number, or null for what isn't one."""
    return F.trim(c.cast("string")).try_cast("double")


def unit_price(unit: Column, price: Column, area: Column) -> Column:
    """The stated unit price, else price / area; null unless positive."""
    area = number(area)
    u = F.coalesce(number(unit), number(price) / F.when(area > 0, area))
    return F.when(u > 0, u)


def contract_year(c: Column) -> Column:
    """Year of MMYY, MM/YY or MM/YYYY; null for anything else."""
    c = F.trim(c)
    part = F.element_at(F.split(c, "/"), -1)
    year = F.when(F.length(part) == 2, 2000 + part.try_cast("int")).otherwise(part.try_cast("int"))
    return F.when(c.rlike(r"^\d{4}$"), 2000 + F.substring(c, 3, 2).try_cast("int")).when(c.rlike(r"^\d{1,2}/(\d{2}|\d{4})$"), year)


def month_year(c: Column) -> Column:
    return F.year(F.try_to_timestamp(c, F.lit("yyyy-MM")))


#: Amenities that are no places, and place types by category; the first match wins, and any shop counts as retail.
NO_PLACES = [
    "waste_basket", "bench", "post_box", "recycling", "vending_machine", "telephone", "parking", "parking_entrance", "parking_space", "bicycle_parking",
    "toilets", "fire_hydrant", "fuel", "car_wash", "police", "fire_station", "substation", "water_tower", "drinking_water", "shower",
]
FOOD = ["restaurant", "cafe", "fast_food", "bar", "pub", "food_court", "ice_cream"]
RETAIL = ["bank", "marketplace", "pharmacy", "atm"]
CIVIC = ["school", "university", "college", "kindergarten", "library", "hospital", "clinic", "dentist", "post_office", "place_of_worship", "community_centre", "social_facility"]
LEISURE = ["cinema", "theatre", "nightclub", "arts_centre", "sports_centre", "pitch", "swimming_pool"]


def place_category(amenity: Column, shop: Column, tourism: Column) -> Column:
    """Case doesn't matter; nan, none and empty strings count as missing."""
    amenity = F.lower(amenity)
    there = lambda c: c.isNotNull() & ~F.lower(c).isin("nan", "none", "")
    return (
        F.when(amenity.isin(FOOD), "F&B").when(there(shop), "Retail").when(amenity.isin(RETAIL), "Retail").when(amenity.isin(CIVIC), "Civic")
        .when(amenity.isin(LEISURE), "Leisure").when(there(tourism), "Tourism").otherwise("Drop")
    )


def not_in(c: Column, values: list) -> Column:
    """Not one of the values; nulls are kept."""
    return ~F.coalesce(c.isin(values), F.lit(False))


def lookup(c: Column, table: dict, default) -> Column:
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), c), F.lit(default))


def capped_detour(network: Column, straight: Column, most: float = 3.0) -> Column:
    """The network distance if it is at most `most` times the straight one; 0 / 0 and x / 0 fall back."""
    return F.when((straight > 0) & (network / F.nullif(straight, F.lit(0.0)) <= most), network).otherwise(straight)


def green_cap(built: Column, share: float = 0.8) -> Column:
    """The most greenness that built-up land leaves: share * (1 - built), within [0, 1]."""
    return clip(share * (1 - built), F.lit(0.0), F.lit(1.0))


def percent_change(new: Column, old: Column, least: float = 0.0) -> Column:
    """100 * (new - old) / |old|; 0 where |old| is no more than least."""
    return F.when(F.abs(old) > least, 100 * (new - old) / F.abs(F.nullif(old, F.lit(0.0)))).otherwise(0.0)


def stars(p: Column) -> Column:
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("ns")


def level(r: Column) -> Column:
    r = F.abs(r)
    return F.when(r >= 0.85, "very high").when(r >= 0.70, "high").otherwise("moderate")


def advice(df, vif: str, importance: str, has_twin: str):
    """df with decision and reason, by a rule table: collinear features with a twin go, others are to be considered."""
    v, m = F.col(vif), F.col(importance)
    decision = F.when((v > 10) & F.col(has_twin), "DROP").when(((v > 5) & (m < 0.1)) | (v > 10), "CONSIDER DROP").otherwise("KEEP")
    keep = F.format_string("VIF=%.1f. Ablation total=%.3f.", v, m)
    drop, consider = F.format_string("VIF=%.1f, and a twin carries the same.", v), F.format_string("VIF=%.1f against an ablation total of %.3f.", v, m)
    return df.withColumn("decision", decision).withColumn("reason", F.when(F.col("decision") == "KEEP", keep).when(F.col("decision") == "DROP", drop).otherwise(consider))


def grid_key(x: Column, y: Column, x0: Column, y0: Column, size: float, width: int = 10_000) -> Column:
    """row * width + column of the square of side `size` that holds the point."""
    return F.floor((y - y0) / size).cast("long") * width + F.floor((x - x0) / size).cast("long")


def arithmetic_hash(c: Column, a: int = 48271, b: int = 11, p: int = 2147483647) -> Column:
    """(a * c + b) mod p: a seeded order that any engine can follow."""
    return (c * a + b) % p


def dot(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, v: s + v)
