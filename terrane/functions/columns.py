"""Column functions for document-shaped market data.

A missing field is null. Negations keep nulls, as the document queries that they stand for do; casts of user data never
fail but give null; regular expressions fold case in every alphabet.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0
SQM_PER_HECTARE = 10_000.0


# comparisons


def differs(c: Column, value) -> Column:
    """Not equal; null differs from every value."""
    return ~c.eqNullSafe(F.lit(value))


def not_in(c: Column, values: list) -> Column:
    return ~F.coalesce(c.isin(values), F.lit(False))


def negated(c: Column) -> Column:
    """True where c is false or null."""
    return ~F.coalesce(c, F.lit(False))


def none_of(*cs: Column) -> Column:
    out = F.lit(False)
    for c in cs:
        out = out | F.coalesce(c, F.lit(False))
    return ~out


def filled(c: Column) -> Column:
    return c.isNotNull() & (c != "")


def empty(c: Column) -> Column:
    return c.isNull() | (c == "")


def contains(c: Column, text: str) -> Column:
    """Case-insensitive, in any alphabet; text is taken literally."""
    return c.rlike("(?iu)" + re.escape(text))


def lacks(c: Column, text: str) -> Column:
    return c.isNull() | ~contains(c, text)


def same_text(a: Column, b: Column) -> Column:
    return F.lower(a) == F.lower(b)


def elem_match(items: Column, test) -> Column:
    """Whether any element passes; null and empty arrays have none."""
    return F.coalesce(F.exists(items, test), F.lit(False))


def date_between(first, last, *columns: Column) -> Column:
    """Whether any of the dates lies in [first, last]."""
    out = F.lit(False)
    for c in columns:
        out = out | F.coalesce(c.between(F.lit(first), F.lit(last)), F.lit(False))
    return out


def since(ts: Column, now: Column, days: int) -> Column:
    """On or after the start of the day `days` before now."""
    return ts >= F.date_trunc("day", now - F.make_dt_interval(F.lit(days)))


def array_equal(a: Column, b: Column) -> Column:
    """Equality of arrays whatever their order."""
    return F.array_sort(a).eqNullSafe(F.array_sort(b))


def changed(old: Column, new: Column, tolerance: float | None = None) -> Column:
    """A material change; numbers count as equal within the tolerance."""
    if tolerance is None:
        return ~old.eqNullSafe(new)
    both = old.isNotNull() & new.isNotNull()
    return F.when(both, F.abs(old - new) >= tolerance).otherwise(old.isNotNull() | new.isNotNull())


# values


def is_number(c: Column) -> Column:
    """Whether a field of any type holds a number."""
    return c.cast("string").try_cast("double").isNotNull()


def count_is(items: Column, n: int) -> Column:
    """Whether an array has n elements; a missing one has none."""
    return F.coalesce(F.size(items), F.lit(0)) == n


def first_filled(*cs: Column) -> Column:
    """The first field that is neither null nor ''."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cs])


def first_of(items: Column, default=None) -> Column:
    """The first element, or the default."""
    return F.coalesce(F.get(items, F.lit(0)), F.lit(default))


def number(c: Column) -> Column:
    """A number from tolerant text: spaces of any kind dropped, comma or point as the decimal mark; else null."""
    return F.replace(F.regexp_replace(c, "[\\s\\u00a0]", ""), F.lit(","), F.lit(".")).try_cast("double")


def first_number(*cs: Column) -> Column:
    """The first of several fields that holds a number."""
    return F.coalesce(*[number(c.cast("string")) for c in cs])


def unit_price(price: Column, area: Column) -> Column:
    """price / area where both are positive."""
    return F.when((price > 0) & (area > 0), price / area)


def price_metrics(price: Column, building_sqm: Column, land_sqm: Column, rate: Column) -> dict[str, Column]:
    """Price in the second currency, and per square metre and hectare in both."""
    second = F.when((price > 0) & (rate > 0), price / rate)
    hectares = land_sqm / SQM_PER_HECTARE
    return {
        "price_usd": second,
        "price_per_m2_uah": unit_price(price, building_sqm),
        "price_per_m2_usd": unit_price(second, building_sqm),
        "price_per_ha_uah": unit_price(price, hectares),
        "price_per_ha_usd": unit_price(second, hectares),
    }


def in_home_currency(amount: Column, currency: Column, usd_rate: Column, eur_per_usd: float = 1.1) -> Column:
    """Amounts in UAH; USD by the rate, EUR by the rate times a fixed ratio; others are taken as they are."""
    return F.when(currency == "USD", amount * usd_rate).when(currency == "EUR", amount * usd_rate * eur_per_usd).otherwise(amount)


def square_metres(value: Column, unit: Column) -> Column:
    """Areas in m2 from hectares, sotky (100 m2) or acres, told by the unit's text; m2 otherwise."""
    u = F.lower(F.coalesce(unit, F.lit("")))
    return (
        F.when(u.contains("сот") | u.contains("sot"), value * 100.0)
        .when(u.contains("га") | u.contains("hect") | (u == "ha"), value * SQM_PER_HECTARE)
        .when(u.contains("акр") | u.contains("acre"), value * 4046.86)
        .otherwise(value)
    )


def listing_type(building: Column, land: Column) -> Column:
    b, la = F.coalesce(building, F.lit(0.0)) > 0, F.coalesce(land, F.lit(0.0)) > 0
    return F.when(b & la, "mixed").when(la, "land").when(b, "real_estate").otherwise("general")


def week_key(d: Column) -> Column:
    """ISO week, as 2024-W01."""
    return F.concat(F.extract(F.lit("YEAROFWEEK"), d).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(d).cast("string"), 2, "0"))


def day_key(d: Column) -> Column:
    return F.date_format(d, "yyyy-MM-dd")


def month_key(d: Column) -> Column:
    return F.date_format(d, "yyyy-MM")


def position_label(price: Column, q1: Column, q2: Column, q3: Column, q4: Column) -> Column:
    """Where a price stands among its group's quartiles: six labels, tested in this order."""
    spread = F.greatest(q3 - q1, q2 * 0.05, F.lit(1.0))
    return (
        F.when(price < q1 - spread * 1.5, "abnormally_low")
        .when(price <= q1, "good")
        .when(price <= (q2 + q3) / 2, "below_average")
        .when(price <= (q3 + q4) / 2, "average")
        .when(price <= q3 + spread * 1.5, "above_average")
        .otherwise("abnormally_high")
    )


# texts and places


def canonical_url(url: Column) -> Column:
    """The address without its query and fragment."""
    return F.regexp_replace(F.trim(url), "[?#].*$", "")


def description_hash(text: Column) -> Column:
    """md5 of the text's lines, trimmed, without empty ones."""
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return F.md5(F.array_join(lines, "\n").cast("binary"))


def cadastral_parts(code: Column) -> dict[str, Column]:
    """Parts of a cadastral number of three or four groups, or of 19 digits in a row; null where it is none."""
    flat = F.regexp_replace(F.coalesce(code, F.lit("")), "\\s", "")
    run = F.regexp_replace(flat, "^(\\d{10})(\\d{2})(\\d{3})(\\d{4})\\d*$", "$1:$2:$3:$4")
    good = run.rlike("^\\d{8,10}(:\\d+){2,3}$")
    groups = F.split(run, ":")
    head = F.lpad(groups[0], 10, "0")
    part = lambda c: F.when(good, c)
    return {"oblast_code": part(head.substr(1, 2)), "district_code": part(head.substr(3, 3)), "city_code": part(head.substr(6, 3)), "zone": part(F.get(groups, F.lit(1))), "quarter": part(F.get(groups, F.lit(2))), "parcel": part(F.get(groups, F.lit(3)))}


# The noun сотка (a hundred square metres) in the cases of both numbers, what it is shortened to, and the fraction сота.
SOTKY = "|".join(["сот" + end for end in ("ка", "ки", "ці", "ку", "кою", "ко", "ок", "кам", "ками", "ках", "а", "у", "і", "их", "ими")] + ["сот\\.?"])
# Units of area.
HECTARES = "гектарів|гектари|гектара|гектар|га"
SQUARE_METRES = "м²|м2|кв\\.?\\s?м"
NUMBER = "\\d{1,3}(?:[ \\u00a0]\\d{3})+(?:[.,]\\d+)?|\\d+(?:[.,]\\d+)?"


def numbers_before(text: Column, unit: str) -> Column:
    """All numbers that stand before a unit, as doubles; blanks may part thousands."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"(?iu)(?<![\\d.,])({NUMBER})\\s*(?:{unit})(?![\\p{{L}}\\d])"), F.lit(1))
    return F.transform(found, lambda x: number(x))


def numbers_after(text: Column, words: str, unit: str) -> Column:
    """All numbers that stand after one of the words and before no unit."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"(?iu)(?:{words})[:\\s]*({NUMBER})(?!\\d|[.,]\\d)(?!\\s?\\d)(?!\\s*(?:{unit}))"), F.lit(1))
    return F.transform(found, lambda x: number(x))


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def _units() -> str:
    return f"{SQUARE_METRES}|{HECTARES}|{SOTKY}"


def building_area(text: Column) -> Column:
    """The square metres that a text names, each mention once, or a bare number after the word for area; null without any."""
    named = F.concat(numbers_before(text, SQUARE_METRES), numbers_after(text, "площа|площею", _units()))
    some = F.filter(named, lambda v: (v > 0.1) & (v < 1e8))
    return F.when(F.size(some) > 0, _total(some))


def land_hectares(text: Column) -> Column:
    """The hectares that a text names, sotky as hundredths, each mention once; null without any."""
    sotky = F.transform(numbers_before(text, SOTKY), lambda v: v * 0.01)
    named = F.concat(numbers_before(text, HECTARES), sotky, numbers_after(text, "площа\\s+ділянки|площа\\s+землі|земельна\\s+ділянка", _units()))
    some = F.filter(named, lambda v: (v > 0.00001) & (v < 100_000))
    return F.when(F.size(some) > 0, _total(some))


def phone(c: Column) -> Column:
    """Digits of a phone number with the country's code, or null."""
    digits = F.regexp_replace(F.coalesce(c, F.lit("")), "\\D", "")
    return F.when(F.length(digits) == 10, F.concat(F.lit("+38"), digits)).when((F.length(digits) == 12) & digits.startswith("380"), F.concat(F.lit("+"), digits))


def kilometres(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance."""
    a, b = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((b - a) / 2), F.lit(2.0)) + F.cos(a) * F.cos(b) * F.pow(F.sin((F.radians(lon2) - F.radians(lon1)) / 2), F.lit(2.0))
    return F.lit(2 * EARTH_KM) * F.asin(F.sqrt(h))


def nearest_address_km(addresses: Column, lat: Column, lon: Column) -> Column:
    """The smallest distance to any address (struct of latitude, longitude), rounded to 2 places; null without any."""
    return F.round(F.array_min(F.transform(addresses, lambda a: kilometres(lat, lon, a["latitude"], a["longitude"]))), 2)


def inside(root: Column, addresses: Column, field: str, text: str) -> Column:
    """The root field or any address's field names the place."""
    return F.coalesce(contains(root, text), F.lit(False)) | elem_match(addresses, lambda a: contains(a[field], text))


def not_inside(root: Column, addresses: Column, field: str, text: str) -> Column:
    return ~inside(root, addresses, field, text)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of doubles, null where either has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def price_in_text(text: Column) -> Column:
    """The largest number of at least 100 in a noisy text; null without any."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("(\\d[\\d \\u00a0]*(?:[.,]\\d+)?)"), F.lit(1))
    return F.array_max(F.filter(F.transform(found, lambda x: number(x)), lambda v: v >= 100))


def place_and_date(text: Column) -> dict[str, Column]:
    """Both sides of the last " - "; the whole text is the place where there is none."""
    cut = F.regexp_extract_all(text, F.lit("(?s)^(.*) - (.*)$"), F.lit(1))
    has = F.size(cut) > 0
    return {"place": F.trim(F.when(has, cut[0]).otherwise(text)), "date": F.when(has, F.trim(F.substring_index(text, " - ", -1)))}


def card_hash(*fields: Column) -> Column:
    """md5 of a search card's fields in their order; missing ones are left out."""
    return F.md5(F.concat_ws("|", *fields).cast("binary"))


def query_hash(text: Column) -> Column:
    """md5 of a geocoding query, in lower case and with single blanks."""
    return F.md5(F.lower(F.trim(F.regexp_replace(text, "\\s+", " "))).cast("binary"))


def values_at(docs: Column, *path: str) -> Column:
    """All filled values at a path through nested arrays of structs."""
    field = lambda name: lambda x: x[name]
    for i, name in enumerate(path):
        docs = F.transform(docs, field(name))
        if i < len(path) - 1:
            docs = F.flatten(F.filter(docs, lambda x: x.isNotNull()))
    return F.filter(docs, filled)
