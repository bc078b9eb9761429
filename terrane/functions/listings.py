"""Column functions on listings: nested addresses and items, kinds of property, ranked uses, dates and areas in text.

An address is a struct with any of the fields that a function names; a missing array counts as an empty one.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from terrane.functions import columns as C

# The kinds of property and the words that tell them.
FARMLAND = "Землі с/г призначення"
LAND_AND_BUILDING = "Земельна ділянка з нерухомістю"
LAND = "Земельна ділянка"
BUILDING = "Комерційна нерухомість"
OTHER = "інше"
FARM_WORDS = ["с/г", "сільськогосподарськ"]
LAND_WORDS = ["земельн", "земля", "ділянк", "соток", "га ", " гектар"]
HOUSE_WORDS = ["будинк", "будівл", "приміщен", "офіс", "склад", "магазин"]
TRADE_WORDS = ["нерухомість", "приміщен", "офіс", "склад", "магазин", "комерц", "нежитлов"]
STORED_LAND_WORDS = ["земля", "ділянка"]
STORED_BUILDING_WORDS = ["нерухомість", "будівл"]

# Words that show what a property is used for.
USE_WORDS = {
    "магазин": ["магазин", "крамниця", "торговий зал", "торгове приміщення"],
    "склад": ["склад", "складське", "логистика", "зберігання"],
    "виробництво": ["виробництво", "цех", "виробниче", "завод", "фабрика"],
    "офіс": ["офіс", "офісне приміщення", "бізнес-центр"],
    "аптека": ["аптека", "аптечний пункт"],
    "кафе": ["кафе", "ресторан", "бар", "їдальня", "кав'ярня"],
    "клініка": ["клініка", "медцентр", "медичний центр", "поліклініка"],
    "салон": ["салон краси", "перукарня", "косметологія"],
    "спортзал": ["спортзал", "фітнес", "тренажерний зал"],
    "автосервіс": ["автосервіс", "автомийка", "шиномонтаж", "СТО"],
}

# A use, the places nearby that speak for it, its least area, its base score.
USES = [
    ("аптека", ["pharmacy", "hospital"], 30, 80),
    ("кафе", ["cafe", "restaurant", "apartment_building"], 50, 75),
    ("магазин", ["supermarket", "shopping_mall", "apartment_building"], 30, 75),
    ("офіс", ["apartment_building", "bank", "local_government_office"], 50, 70),
    ("клініка", ["hospital", "pharmacy", "bus_station"], 80, 75),
    ("склад", ["apartment_building", "bus_station"], 100, 65),
    ("виробництво", ["apartment_building"], 150, 60),
]

# Months in the genitive, from January.
MONTHS = ["січня", "лютого", "березня", "квітня", "травня", "червня", "липня", "серпня", "вересня", "жовтня", "листопада", "грудня"]

# The classifier code that marks leases, and words for a lease and a sale.
LEASE_CODE = "PA01-7"
LEASE_WORDS = ["lease", "rent", "оренд", "rental", "аренд"]
LEASE_WORDS_IN_TEXT = ["оренд", "lease", "rent"]
SALE_WORDS = ["продаж", "sale"]


def any_word(text: Column, words: list[str], whole_up_to: int = 0) -> Column:
    """Whether the text holds any of the words, in any case; null texts hold none.

    Words may stand inside others, as stems do, but those of at most whole_up_to letters only as words of their own.
    """
    alone = lambda w: f"(?<!\\p{{L}}){re.escape(w)}(?!\\p{{L}})" if len(w) <= whole_up_to else re.escape(w)
    return F.coalesce(text.rlike("(?iu)" + "|".join(alone(w) for w in words)), F.lit(False))


# addresses


def best_address(addresses: Column) -> Column:
    """The first complete address, or the first one."""
    return F.coalesce(F.get(F.filter(addresses, lambda a: a["is_complete"]), F.lit(0)), F.get(addresses, F.lit(0)))


def best_candidate(results: Column, field: str, wanted: Column) -> Column:
    """The first result whose field holds the wanted text, or the first one."""
    fits = F.filter(results, lambda r: F.lower(r[field]).contains(F.lower(wanted)))
    return F.coalesce(F.get(fits, F.lit(0)), F.get(results, F.lit(0)))


def kept(items: Column, test) -> Column:
    """The elements that pass, or all where none does."""
    fits = F.filter(items, test)
    return F.when(F.size(fits) > 0, fits).otherwise(items)


def addresses_text(addresses: Column, fields: list[str]) -> Column:
    """Addresses as one text: filled fields joined by commas, addresses by semicolons, empty addresses left out."""
    one = F.transform(addresses, lambda a: F.array_join(F.filter(F.array(*[a[f].cast("string") for f in fields]), lambda x: C.filled(x)), ", "))
    return F.coalesce(F.array_join(F.filter(one, lambda x: x != ""), "; "), F.lit(""))


def root_or_address(root: Column, address: Column, field: str) -> Column:
    """The listing's own field where it is filled, else that of an address, else ''."""
    return F.coalesce(F.nullif(root, F.lit("")), address[field], F.lit(""))


# kinds and rules


def kind_of_text(text: Column) -> Column:
    """The kind of property that a title and description tell."""
    house, land = any_word(text, HOUSE_WORDS), any_word(text, LAND_WORDS)
    return F.when(any_word(text, FARM_WORDS), FARMLAND).when(land & house, LAND_AND_BUILDING).when(land, LAND).when(any_word(text, TRADE_WORDS), BUILDING).otherwise(OTHER)


def kind_of_listing(stored: Column, text: Column) -> Column:
    """The kind of property of a listing: what its stored kind tells, else (null, blank or without such words) what its text does."""
    land, building = any_word(stored, STORED_LAND_WORDS), any_word(stored, STORED_BUILDING_WORDS)
    told = F.when(any_word(stored, FARM_WORDS), FARMLAND).when(land & building, LAND_AND_BUILDING).when(land, LAND).when(building, BUILDING)
    return F.coalesce(told, kind_of_text(text))


def kind_of_items(items: Column) -> Column:
    """The kind of property of a lot, from its items (code, props, land_area, building_area, unit).

    Codes 06 are land, 04 buildings, 05 both; a kind, an area or a unit of measure of any item counts as well.
    """
    says = lambda c: F.coalesce(c, F.lit(False))
    unit = lambda i: F.lower(i["unit"])
    land = C.elem_match(items, lambda i: says(i["code"].rlike("^0[56]")) | says(F.lower(i["props"]) == "land") | says(i["land_area"] > 0) | says(unit(i).contains("га")))
    building = C.elem_match(items, lambda i: says(i["code"].rlike("^0[45]")) | says(F.lower(i["props"]).isin("building", "asset")) | says(i["building_area"] > 0) | says(unit(i).rlike("м²|кв\\.м|квадратний")))
    return F.when(land & building, LAND_AND_BUILDING).when(land, LAND).when(building, BUILDING).otherwise(OTHER)


def is_lease(lease_type: Column, sale_type: Column, procedure: Column, codes: Column, text: Column, code_texts: Column | None = None) -> Column:
    """Whether a lot is let; the first rule that speaks decides: kind of lease, of sale, procedure, codes, their descriptions, text."""
    by_text = any_word(text, LEASE_WORDS_IN_TEXT) & ~any_word(text, SALE_WORDS)
    marked = F.coalesce(F.array_contains(codes, LEASE_CODE), F.lit(False))
    if code_texts is not None:
        marked = marked | C.elem_match(code_texts, lambda t: any_word(t, LEASE_WORDS_IN_TEXT))
    return F.when(C.filled(lease_type), True).when(C.filled(sale_type), False).when(any_word(procedure, LEASE_WORDS) | marked, True).otherwise(by_text)


def is_open_lot(status: Column, start: Column, now: Column, codes: Column, extra_codes: Column, prefixes: list[str], days: int = 7) -> Column:
    """Active, not begun or begun at most `days` whole days ago (or without a start), no lease, of a wanted code."""
    recent = start.isNull() | (start.cast("timestamp") > now.cast("timestamp") - F.make_dt_interval(F.lit(days + 1)))
    lease = F.coalesce(F.array_contains(extra_codes, LEASE_CODE), F.lit(False))
    return F.coalesce(status.startswith("active"), F.lit(False)) & recent & ~lease & C.elem_match(codes, lambda c: c.rlike("^(?:" + "|".join(re.escape(p) for p in prefixes) + ")"))


# uses


def uses_in_text(text: Column) -> Column:
    """The uses that a text speaks of, in the order of the table."""
    return F.array_compact(F.array(*[F.when(any_word(text, words, 3), F.lit(use)) for use, words in USE_WORDS.items()]))


def ranked_uses(known: Column, area: Column, nearby: Column, most: int = 10, least: int = 50) -> Column:
    """Array of (score, use), best first: uses already known score 85; others their base, 5 more or 10 less by the area,
    and two for every fitting place nearby (a map from kind to number), 15 at the most. Equal scores keep the tables' order.
    """
    seen = F.transform(known, lambda u, i: F.struct(F.lit(85).alias("score"), (-i).alias("order"), u.alias("use")))
    cases = []
    for i, (use, places, at_least, base) in enumerate(USES):
        near = sum((F.coalesce(nearby[p], F.lit(0)) for p in places), F.lit(0))
        fit = F.when(area >= at_least, 5).when(area < at_least, -10).otherwise(0)
        score = F.least(F.lit(base) + fit + F.least(near * 2, F.lit(15)), F.lit(100)).cast("int")
        cases.append(F.when(~F.array_contains(known, use) & (score >= least), F.struct(score.alias("score"), F.lit(-100 - i).alias("order"), F.lit(use).alias("use"))))
    ranked = F.sort_array(F.concat(seen, F.array_compact(F.array(*cases))), asc=False)
    return F.transform(F.slice(ranked, 1, most), lambda x: F.struct(x["score"].alias("score"), x["use"].alias("use")))


# dates and areas in text


def listed_date(text: Column, today: Column) -> Column:
    """The day of "Сьогодні о 07:28", "Вчора о 12:00" or "04 лютого 2026 р."; null where there is none or it is no date."""
    pattern = "(?iu)(\\d{1,2})\\s+(" + "|".join(MONTHS) + ")\\s+(\\d{4})"
    month = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.lower(F.regexp_extract(text, pattern, 2)))
    day = F.concat_ws("-", F.regexp_extract(text, pattern, 3), F.lpad(month.cast("string"), 2, "0"), F.lpad(F.regexp_extract(text, pattern, 1), 2, "0"))
    clock = "\\s+о\\s+\\d{1,2}:\\d{2}"
    named = F.when(month > 0, day.try_cast("date"))
    return F.when(text.rlike("(?iu)^\\s*сьогодні" + clock), today).when(text.rlike("(?iu)^\\s*вчора" + clock), F.date_sub(today, 1)).otherwise(named)


def sotky(text: Column) -> Column:
    """The different numbers of sotky (100 m2) that a text names, up to 100,000."""
    values = F.transform(C.numbers_before(text, C.SOTKY), lambda x: F.round(x, 4))
    return F.array_distinct(F.filter(values, lambda v: (v > 0) & (v <= 100_000)))


def sotky_sqm(text: Column) -> Column:
    return F.aggregate(sotky(text), F.lit(0.0), lambda a, x: a + x) * 100.0


def wrong_scale(current: Column, expected: Column) -> Column:
    """Whether an area must give way to the one that the text names: missing, or more than a fifth to five times off, or a power of ten."""
    ratio = current / expected
    tens = F.lit(False)
    for r in (0.01, 0.1, 10.0, 100.0):
        tens = tens | ratio.between(r * 0.85, r * 1.15)
    off = ~ratio.between(0.97, 1.03) & (tens | (ratio < 0.2) | (ratio > 5.0))
    return F.when(F.coalesce(expected, F.lit(0.0)) <= 0, False).when(F.coalesce(current, F.lit(0.0)) <= 0, True).otherwise(off)


def told_enough(building: Column, land: Column, addresses: Column) -> Column:
    """Whether an area or an address was found, so that no costlier reading is needed."""
    return building.isNotNull() | land.isNotNull() | (F.coalesce(F.size(addresses), F.lit(0)) > 0)


def agreement(pairs: list[tuple[Column, Column]]) -> Column:
    """The share of equal fields among those filled on either side; 1 where none is."""
    text = lambda c: F.trim(F.coalesce(c.cast("string"), F.lit("")))
    told = [((text(a) != "") | (text(b) != "")).cast("int") for a, b in pairs]
    same = [((text(a) != "") & (text(a) == text(b))).cast("int") for a, b in pairs]
    n = sum(told, F.lit(0))
    return F.when(n == 0, F.lit(1.0)).otherwise(sum(same, F.lit(0)) / n)
