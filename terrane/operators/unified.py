"""Documents of two kinds of source, ads and auction lots, under one schema of listings, and its flat extract.

A source's documents hold any part of the fields that are read here: a field that the schema lacks counts as null, a value
of the wrong type too. Every row of the input gives one row; rows that repeat are kept. An empty table gives an empty one
with the same schema.
"""

from __future__ import annotations

import re
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

from terrane.functions import columns as C
from terrane.functions import listings as L
from terrane.operators.search import ACTIVE

INACTIVE = "неактивне"
CURRENCIES = ["UAH", "USD", "EUR"]
LANGUAGES = ["uk_UA", "en_US", "ru_RU"]
PLACES = {"region": "region", "oblast_raion": "district", "city": "settlement", "city_district": "city_district"}  # of a listing, of an address

REGION_WORD = "область"

# Where documents of each kind tell regions and cities; the first are resolved, the others stand in for them.
AD_PLACES = {
    "region": ["detail.address_refs.region.name", "search_data.location", "detail.resolved_locations.results.address_structured.region"],
    "city": ["detail.address_refs.city.name", "search_data.location", "detail.resolved_locations.results.address_structured.city", "detail.resolved_locations.results.address_structured.settlement"],
}
LOT_PLACES = {
    "region": ["auction_data.address_refs.region.name", "llm_result.result.addresses.region", "auction_data.items.address.region.uk_UA"],
    "city": ["auction_data.address_refs.city.name", "llm_result.result.addresses.settlement", "auction_data.items.address.locality.uk_UA"],
}
LISTING_PLACES = {"region": ["addresses.region"], "city": ["addresses.settlement"]}


def _type_at(schema: DataType | None, names: list[str]) -> DataType | None:
    for n in names:
        schema = schema[n].dataType if isinstance(schema, StructType) and n in schema.names else None
    return schema


def field(df: DataFrame, path: str, as_type: str) -> Column:
    """The field at a dotted path, as the type; null where the schema lacks it or the value cannot be cast."""
    found = _type_at(df.schema, path.split("."))
    nested = isinstance(found, StructType | ArrayType) != as_type.startswith(("array", "struct"))
    return F.lit(None).cast(as_type) if found is None or nested else F.col(path).try_cast(as_type)


def root_place(addresses: Column, name: str) -> Column:
    """A listing's place: that of its first complete address if filled, else the most frequent of all, the one met first; null without any.

    The addresses are those of one listing, a handful.
    """
    clean = lambda a: C.first_filled(F.trim(a[name]))
    exact = clean(F.get(F.filter(addresses, lambda a: a["is_complete"]), F.lit(0)))
    told = F.filter(F.transform(addresses, clean), lambda v: v.isNotNull())
    votes = F.transform(told, lambda v, i: F.struct((-F.size(F.filter(told, lambda w: w == v))).alias("n"), i.alias("met"), v.alias("place")))
    return F.coalesce(exact, F.array_min(votes)["place"])


def values_along(df: DataFrame, path: str) -> Column | None:
    """All texts at a dotted path through structs and arrays at any depth, as an array; None where the schema has no such path."""

    def has(t: DataType, names: list[str]) -> bool:
        if isinstance(t, ArrayType):
            return has(t.elementType, names)
        return (names[0] in t.names and has(t[names[0]].dataType, names[1:])) if names and isinstance(t, StructType) else not names and not isinstance(t, StructType)

    def below(c: Column, t: DataType, names: list[str]) -> Column:
        if isinstance(t, ArrayType):
            return F.flatten(F.coalesce(F.transform(c, lambda x: below(x, t.elementType, names)), F.array().cast("array<array<string>>")))
        return below(c[names[0]], t[names[0]].dataType, names[1:]) if names else F.array(c.cast("string"))

    first, *rest = path.split(".")
    return below(F.col(first), df.schema[first].dataType, rest) if has(df.schema, [first, *rest]) else None


def in_places(df: DataFrame, told: dict[str, list[str]], cities: list[str], regions: list[str]) -> Column:
    """Whether a document tells any of the cities or regions at any of its kind's paths, in any case and also inside a longer text.

    A region is meant with and without its word. Blank names are none; without names every document passes. Paths that the
    schema lacks tell nothing.
    """
    wanted = {"city": [c.strip() for c in cities], "region": [re.sub(rf"\s+{REGION_WORD}$", "", r.strip()) for r in regions]}
    names = {k: "|".join(re.escape(n) for n in v if n) for k, v in wanted.items()}
    if not any(names.values()):
        return F.lit(True)
    out = F.lit(False)
    for kind, pattern in names.items():
        for values in (values_along(df, path) for path in told[kind] if pattern):
            if values is not None:
                out = out | C.elem_match(values, lambda v: v.rlike("(?iu)" + pattern))  # noqa: B023 (called at once)
    return out


def _element(df: DataFrame, name: str) -> StructType:
    """The schema of an array's elements; without the array, one that has no fields."""
    found = _type_at(df.schema, [name])
    return found.elementType if isinstance(found, ArrayType) and isinstance(found.elementType, StructType) else StructType([])


def _finished(df: DataFrame, rate: Column, at: Column) -> DataFrame:
    """The fields that follow from others: places, prices in both currencies and by area; then all in order."""
    have = _element(df, "addresses").names
    place = lambda name: root_place(F.col("addresses"), name) if name in have and "is_complete" in have else F.lit(None).cast("string")
    out = df.withColumns({k: place(v) for k, v in PLACES.items()} | {"rate": rate.cast("double")})
    metrics = C.price_metrics(F.col("price_uah"), F.col("building_area_sqm"), F.col("land_area_sqm"), F.col("rate"))
    out = out.withColumns(metrics | {"currency_rate": F.when((F.col("price_uah") > 0) & (F.col("rate") > 0), F.col("rate"))})
    told = {"source_updated_at": F.coalesce("source_updated_at", at), "floor": F.coalesce("floor", F.lit("")), "tags": F.coalesce("tags", F.array().cast("array<string>")), "title": F.coalesce("title", F.lit("")), "description": F.coalesce("description", F.lit(""))}
    return out.withColumns(told).select(
        "source", "source_id", "source_updated_at", "status", "page_url", "identifier", "property_type", "title", "description", *PLACES, *(["addresses"] if have else []), "cadastral_numbers",
        "building_area_sqm", "land_area_sqm", "floor", "tags", "price_uah", *metrics, "currency_rate",
    )


def from_ads(df: DataFrame, source: str, rate: Column | float, at: Column | datetime | None = None) -> DataFrame:
    """Listings of ads: url, updated_at, is_active, search_data (title, price_value, currency, area_m2), addresses, cadastral_numbers, detail.

    detail holds description, price (value, currency) and llm (property_type, areas, floor, tags). The detail's price goes
    before the card's, each with its currency; other currencies than UAH, USD and EUR count as UAH. The card's area is the
    building's where neither area is told. An ad is active unless is_active is false; at stands for a missing date (now).
    """
    s, n = (lambda p: field(df, p, "string")), (lambda p: field(df, p, "double"))
    llm = "detail.llm."
    detail, card = n("detail.price.value"), n("search_data.price_value")
    if not isinstance(_type_at(df.schema, ["detail", "price"]), StructType):
        detail = n("detail.price")
    currency = F.upper(F.trim(F.when(detail.isNotNull(), s("detail.price.currency")).otherwise(s("search_data.currency"))))
    amount = F.coalesce(detail, card)
    price = C.in_home_currency(amount, F.when(currency.isin(CURRENCIES), currency).otherwise("UAH"), F.lit(rate))
    building, land = F.nullif(n(llm + "building_area_sqm"), F.lit(0.0)), F.coalesce(n(llm + "land_area_sqm"), n(llm + "land_area_ha") * C.SQM_PER_HECTARE)
    untold = building.isNull() & F.nullif(land, F.lit(0.0)).isNull()
    title, description = s("search_data.title"), s("detail.description")
    rows = df.withColumns({
        "source": F.lit(source), "source_id": s("url"), "source_updated_at": field(df, "updated_at", "timestamp"),
        "status": F.when(F.coalesce(field(df, "is_active", "boolean"), F.lit(True)), ACTIVE).otherwise(INACTIVE), "page_url": s("url"), "identifier": s("url"),
        "property_type": L.kind_of_listing(s(llm + "property_type"), F.concat_ws(" ", title, description)), "title": title, "description": description,
        "cadastral_numbers": field(df, "cadastral_numbers", "array<string>"), "building_area_sqm": F.when(untold, n("search_data.area_m2")).otherwise(building), "land_area_sqm": land,
        "floor": s(llm + "floor"), "tags": field(df, llm + "tags", "array<string>"), "price_uah": F.when(amount > 0, price),
    })
    return _finished(rows, F.lit(rate), F.current_timestamp() if at is None else F.lit(at))


def from_lots(df: DataFrame, source: str, rate: Column | float, page: str = "", at: Column | datetime | None = None) -> DataFrame:
    """Listings of lots: auction_id, addresses, cadastral_numbers, auction_data (dateModified, status, title, description, id, value, items, floor, tags).

    Texts are structs by language, or plain; a lot without a title is called by its id. Statuses that begin with active are
    active ones. Items (code, props, land_area, building_area, unit) tell the kind and, in their units, the areas; an area
    that they do not tell is null. A lot's page is page and its auction_id.
    """
    s, data = (lambda p: field(df, p, "string")), "auction_data."
    text = lambda p: C.first_filled(*[s(f"{p}.{k}") for k in LANGUAGES], s(p))
    amount = F.coalesce(field(df, data + "value.amount", "double"), field(df, data + "value", "double"))
    items = F.col(data + "items") if _type_at(df.schema, ["auction_data", "items"]) else F.array().cast("array<struct<code:string,props:string,land_area:double,building_area:double,unit:string>>")
    total = lambda name, unit: F.aggregate(items, F.lit(0.0), lambda a, i: a + F.coalesce(F.greatest(C.square_metres(i[name].cast("double"), unit(i)), F.lit(0.0)), F.lit(0.0)))
    area = lambda name, unit=lambda i: i["unit"]: F.nullif(total(name, unit), F.lit(0.0))
    rows = df.withColumns({
        "source": F.lit(source), "source_id": s("auction_id"), "source_updated_at": field(df, data + "dateModified", "timestamp"),
        "status": F.when(s(data + "status").startswith("active"), ACTIVE).otherwise(INACTIVE), "page_url": F.concat(F.lit(page), s("auction_id")), "identifier": s("auction_id"),
        "property_type": L.kind_of_items(items), "title": F.coalesce(text(data + "title"), s(data + "id")), "description": text(data + "description"),
        "cadastral_numbers": field(df, "cadastral_numbers", "array<string>"), "building_area_sqm": area("building_area"), "land_area_sqm": area("land_area"),
        "floor": s(data + "floor"), "tags": field(df, data + "tags", "array<string>"), "price_uah": F.when(amount > 0, amount),
    })
    return _finished(rows, F.lit(rate), F.current_timestamp() if at is None else F.lit(at))


def flat_extract(listings: DataFrame) -> DataFrame:
    """One flat row for each listing that has a source and an id: its places, else those of its best address; street, house, areas, prices.

    A street is a struct (street_type, name) or plain text. Texts that nothing tells are '', numbers and the floor null.
    """
    element = _element(listings, "addresses")
    best = L.best_address(F.col("addresses")) if "is_complete" in element.names else F.get(F.col("addresses"), F.lit(0)) if element.names else None

    def told(*path: str) -> Column:
        found = _type_at(element, list(path))
        if best is None or found is None or isinstance(found, StructType | ArrayType):
            return F.lit(None).cast("string")
        c = best
        for p in path:
            c = c[p]
        return c.cast("string")

    or_blank = lambda *cs: F.coalesce(C.first_filled(*cs), F.lit(""))
    place = {k: or_blank(F.col(k), told(v)) for k, v in PLACES.items()}
    listed = listings.where(C.filled(F.col("source").cast("string")) & C.filled(F.col("source_id").cast("string")))
    return listed.select(
        "source", "source_id", or_blank(F.col("page_url"), F.col("identifier")).alias("listing_url"), or_blank(F.col("property_type")).alias("property_type"), C.day_key(F.col("source_updated_at")).alias("source_date"),
        *[c.alias(k) for k, c in place.items()], place["city"].alias("settlement"), or_blank(told("settlement_type")).alias("settlement_type"),
        or_blank(told("street", "street_type")).alias("street_type"), or_blank(told("street", "name"), told("street")).alias("street"), or_blank(told("building")).alias("building"),
        C.first_filled(F.col("floor")).alias("floor"), F.when(F.col("land_area_sqm") > 0, F.col("land_area_sqm")).alias("land_area_sqm"), "building_area_sqm",
        *(f"price_{m}_{c}" for m in ("per_m2", "per_ha") for c in ("uah", "usd")), "price_uah", "price_usd",
    )
