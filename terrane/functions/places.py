"""Names of places: regions, settlements, districts of the capital, streets, and predicates over nested addresses."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from terrane.functions import columns as C

# The regions by the code that begins their cadastral numbers.
REGION_CODES = {
    "01": "АР Крим", "05": "Вінницька", "07": "Волинська", "12": "Дніпропетровська", "14": "Донецька", "18": "Житомирська", "21": "Закарпатська", "23": "Запорізька", "26": "Івано-Франківська",
    "32": "Київська", "35": "Кіровоградська", "44": "Луганська", "46": "Львівська", "48": "Миколаївська", "51": "Одеська", "53": "Полтавська", "56": "Рівненська", "59": "Сумська",
    "61": "Тернопільська", "63": "Харківська", "65": "Херсонська", "68": "Хмельницька", "71": "Черкаська", "73": "Чернівецька", "74": "Чернігівська", "80": "Київ", "85": "Севастополь",
}

# Settlements by the form that follows "in".
SETTLEMENT_CASES = {
    "києві": "Київ", "львові": "Львів", "вінниці": "Вінниця", "харкові": "Харків", "одесі": "Одеса", "дніпрі": "Дніпро", "запоріжжі": "Запоріжжя", "полтаві": "Полтава", "сумах": "Суми",
    "чернігові": "Чернігів", "житомирі": "Житомир", "черкасах": "Черкаси", "тернополі": "Тернопіль", "івано-франківську": "Івано-Франківськ", "луцьку": "Луцьк", "рівному": "Рівне",
    "ужгороді": "Ужгород", "миколаєві": "Миколаїв", "херсоні": "Херсон", "кропивницькому": "Кропивницький",
}

# Districts of Kyiv.
DISTRICTS = ["Деснянський", "Святошинський", "Дніпровський", "Печерський", "Голосіївський", "Дарницький", "Солом'янський", "Оболонський", "Шевченківський", "Подільський"]

# Words for kinds of street.
STREET_WORDS = ["вулиця", "вул.", "вул", "просп.", "просп", "бул.", "бул", "пров.", "пров", "пл.", "пл"]


def _lookup(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


# names


def region_name(c: Column) -> Column:
    """A region in the nominative, without its word for region: "Волинській області" is "Волинська"; null where empty."""
    bare = F.trim(F.regexp_replace(F.trim(c), "(?iu)\\s+(?:область|області|обл\\.?)\\s*$", ""))
    return F.nullif(F.regexp_replace(bare, "(?iu)(.+[сц]ьк)(?:ій|ої|ою|у)$", "$1а"), F.lit(""))


def canonical_region(c: Column) -> Column:
    """One of the fixed regions, however it is written ("о. Чернігівська", "м.Київ", "Автономна Республіка Крим"); else null."""
    low = F.regexp_replace(F.lower(F.trim(c)), "\\s+", " ")
    city = F.regexp_extract(low, "^(?:м\\.? ?)?(київ|севастополь)(?: місто)?$", 1)
    crimea = F.regexp_replace(low, "[ .-]", "").isin("аркрим", "автономнареспублікакрим", "крим")
    bare = F.regexp_replace(F.regexp_replace(low, "^(?:о\\.|обл\\.?|область) ", ""), " (?:область|області|обл\\.?)$", "")
    key = F.regexp_replace(region_name(bare), "[- ]", "")
    regions = {r.lower().replace("-", ""): f"{r} область" for r in REGION_CODES.values() if r.endswith("ька")}
    return F.when(city == "київ", "м. Київ").when(city == "севастополь", "м. Севастополь").when(crimea, "АР Крим").otherwise(F.element_at(_lookup(regions), key))


def region_forms(canonical: str) -> list[str]:
    """The words that name a fixed region in a sentence: the cases of its adjective, or of its noun."""
    name = canonical.removeprefix("м. ").removeprefix("АР ").removesuffix(" область").lower()
    if name.endswith("ька"):
        return [name[:-1] + end for end in ("а", "ої", "ій", "у", "ою")]
    if name == "київ":
        return [name, "києва", "києву", "києві", "києвом"]
    if name == "севастополь":
        return [name[:-1] + end for end in ("ь", "я", "ю", "і", "ем")]
    return [name + end for end in ("", "у", "ові", "ом")]


def names_region(text: Column, canonical: str) -> Column:
    """Whether a word of the text is a fixed region, in any case and number of letters around it."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[\\p{L}'’ʼ-]+"), F.lit(0))
    return F.arrays_overlap(words, F.array(*[F.lit(w) for w in region_forms(canonical)]))


# What stands before a settlement's name: prepositions, and words for its kind.
PREPOSITIONS = ["у", "в", "з", "на", "до"]
SETTLEMENT_KINDS = ["м.", "місто", "с.", "село", "смт", "смт.", "селище"]


def settlement_name(c: Column) -> Column:
    """A settlement without a preposition and its kind, in the nominative where its case is known; null where empty."""
    words = F.filter(F.split(F.regexp_replace(F.trim(c), "\\.\\s*", ". "), "\\s+"), lambda w: w != "")
    low = lambda k: F.lower(F.coalesce(F.get(words, F.lit(k)), F.lit("")))
    skip = F.when(low(0).isin(*PREPOSITIONS), F.when(low(1).isin(*SETTLEMENT_KINDS), 2).otherwise(1)).when(low(0).isin(*SETTLEMENT_KINDS), 1).otherwise(0)
    bare = F.trim(F.array_join(F.slice(words, skip + 1, F.greatest(F.size(words) - skip, F.lit(0))), " "))
    return F.nullif(F.coalesce(F.element_at(_lookup(SETTLEMENT_CASES), F.lower(bare)), bare), F.lit(""))


def _plain(c: Column) -> Column:
    """Lower case, without apostrophes."""
    return F.regexp_replace(F.lower(c), "['’ʼ`]", "")


def _district_stems() -> dict[str, str]:
    return {d.lower().replace("'", "").removesuffix("ий"): d for d in DISTRICTS}


def district_name(c: Column) -> Column:
    """A district of Kyiv from its name in any case, with or without its word for district; else null."""
    bare = F.trim(F.regexp_replace(_plain(c), "(?iu)(?<!\\p{L})(?:район\\p{L}*|в|у)(?!\\p{L})", ""))
    return F.element_at(_lookup(_district_stems()), F.regexp_replace(bare, "(?:ий|ому|ого|им)$", ""))


def district_in_text(text: Column) -> Column:
    """The district of Kyiv that a text names first, in any case; a part of a longer or hyphenated word is none."""
    stems = _district_stems()
    word = F.regexp_extract(_plain(text), "(?u)(?<![\\p{L}-])(" + "|".join(stems) + ")(?:ий|ого|ому|им|а|ої|ій|у|ою)(?![\\p{L}-])", 1)
    return F.element_at(_lookup(stems), word)


def city_and_district(c: Column) -> dict[str, Column]:
    """A city and its district from "Київ, Соломянський"; other text after the comma stays as it is."""
    city = F.trim(F.substring_index(c, ",", 1))
    rest = F.when(c.contains(", "), F.trim(F.regexp_replace(c, "^[^,]*,", "")))
    known = F.when(F.lower(city).contains("київ"), district_name(rest))
    return {"city": F.nullif(city, F.lit("")), "district": F.nullif(F.coalesce(known, rest), F.lit(""))}


def district_pattern(name: str) -> str:
    """A pattern for a district at the start of a field; its apostrophe, of any kind, may be missing."""
    return "(?iu)^" + re.sub("['’ʼ`]", "['’ʼ`]?", name)


# addresses


def street_and_house(text: Column) -> dict[str, Column]:
    """The street's name and the house's number of "вул. Соборності, 7 корпус А"; both may be null.

    After a comma the first word is the number if it begins with a digit; without a comma a last word of digits is (12, 12/4, 12а).
    """
    text = F.trim(text)
    bare = F.trim(F.regexp_replace(F.trim(F.substring_index(text, ",", 1)), "(?iu)^(?:" + "|".join(re.escape(w) for w in STREET_WORDS) + ")\\s+", ""))
    after = F.when(text.contains(","), F.regexp_extract(text, ",\\s*(\\d[^\\s,]*)", 1))
    number = "\\d+(?:[/-]\\d+)?\\p{L}?"
    last = F.when(~text.contains(","), F.regexp_extract(bare, f"\\s({number})$", 1))
    street = F.when(last != "", F.trim(F.regexp_replace(bare, f"\\s{number}$", ""))).otherwise(bare)
    return {"street": F.nullif(street, F.lit("")), "house": F.nullif(F.coalesce(after, last), F.lit(""))}


def item_address(region: Column, locality: Column, street: Column) -> Column:
    """The address of a lot's item as a struct: region without its word, settlement, street, building, formatted_address."""
    bare = F.nullif(F.trim(F.regexp_replace(region, " (?:область|обл\\.)", "")), F.lit(""))
    place, parts = C.first_filled(F.trim(locality)), street_and_house(street)
    shown = F.array_compact(F.array(bare, place, F.nullif(F.trim(street), F.lit(""))))
    formatted = F.nullif(F.array_join(shown, ", "), F.lit(""))
    return F.struct(bare.alias("region"), place.alias("settlement"), parts["street"].alias("street"), parts["house"].alias("building"), formatted.alias("formatted_address"))


# What is shown of an item's utilities and of claims on it.
WITH_UTILITIES, WITHOUT_UTILITIES, ENCUMBERED = "електрика, вода, газ, опалення", "відсутні", "Є обтяження"


def item_facts(item: Column) -> Column:
    """What an item of a lot tells, as a struct; item is a struct of cadastral_number, utilities, encumbered, region, locality, street.

    The address fields of ``item_address``, the region falling back to that of the cadastral number; the number, where it
    is filled; what is known of utilities (null if nothing) and of claims. A null item gives a struct of nulls.
    """
    address = item_address(item["region"], item["locality"], item["street"])
    number = C.first_filled(F.trim(item["cadastral_number"]))
    utilities = F.when(item["utilities"], WITH_UTILITIES).when(~item["utilities"], WITHOUT_UTILITIES)
    return F.struct(
        number.alias("cadastral_number"), F.coalesce(address["region"], region_of_parcel(number)).alias("region"),
        *[address[c].alias(c) for c in ("settlement", "street", "building", "formatted_address")],
        utilities.alias("utilities"), F.when(item["encumbered"], ENCUMBERED).alias("encumbrances"),
    )


def region_of_parcel(code: Column) -> Column:
    """The region that a cadastral number begins with; null where it is none."""
    return F.element_at(_lookup(REGION_CODES), C.cadastral_parts(code)["oblast_code"])


# predicates over a listing's places


@dataclass
class Places:
    """Where a listing may be: in any of the cities or regions, in none of the others, and near a point."""

    cities: list[str] = field(default_factory=list)
    regions: list[str] = field(default_factory=list)
    not_cities: list[str] = field(default_factory=list)
    not_regions: list[str] = field(default_factory=list)
    near: tuple[float, float, float] | None = None  # latitude, longitude, kilometres


RADIUS_KM = 6378.1


def within(lat: Column, lon: Column, at: tuple[float, float, float]) -> Column:
    """Whether a point lies in the spherical cap around at; a box is tested first. Points without coordinates do not."""
    import math

    wide = math.degrees(at[2] / RADIUS_KM)
    box = lat.between(at[0] - wide, at[0] + wide)
    return F.coalesce(box & (C.kilometres(lat, lon, F.lit(at[0]), F.lit(at[1])) * (RADIUS_KM / C.EARTH_KM) <= at[2]), F.lit(False))


def _named(root: Column, addresses: Column, column: str, names: list[str]) -> Column:
    out = F.lit(False)
    for n in names:
        out = out | C.inside(root, addresses, column, n)
    return out


def located(p: Places, city: Column, region: Column, addresses: Column, city_field: str = "settlement", region_field: str = "region") -> Column:
    """The predicate of p on a listing's own city and region and its addresses.

    A city or a region that is asked for is enough; each exclusion holds for the listing and all its addresses.
    """
    keep = F.lit(True)
    if p.cities or p.regions:
        keep = _named(city, addresses, city_field, p.cities) | _named(region, addresses, region_field, p.regions)
    keep = keep & ~_named(city, addresses, city_field, p.not_cities) & ~_named(region, addresses, region_field, p.not_regions)
    if p.near:
        keep = keep & C.elem_match(addresses, lambda a: within(a["latitude"], a["longitude"], p.near))
    return keep


def any_of(*tests: Column) -> Column:
    return ~C.none_of(*tests)


def all_of(*tests: Column) -> Column:
    out = F.lit(True)
    for t in tests:
        out = out & F.coalesce(t, F.lit(False))
    return out
