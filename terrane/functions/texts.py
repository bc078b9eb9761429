"""What a listing's description and its list of parameters say, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from terrane.functions import columns as C
from terrane.functions import places
from terrane.functions.listings import any_word

LETTERS = "А-Яа-яІіЇїЄєҐґ'’\\-"

# Kinds of property in descriptions, in the order in which they are tested.
DESCRIBED_KINDS = [
    ("Земля під будівництво", ["земельна ділянка", "землі житлової забудови", "земля під будівництво"]),
    ("Землі с/г призначення", ["с/г", "сільськогосподарськ"]),
    ("Нерухомість", ["нерухомість"]),
]

# Words for what is laid on, and for there being nothing.
UTILITIES = {
    "електрика": ["електропостачання", "електрика", "світло"],
    "вода": ["водопостачання", "вода", "водопровід"],
    "газ": ["газопостачання", "газ"],
    "каналізація": ["каналізація"],
    "опалення": ["опалення", "тепло"],
}
NO_UTILITIES = ["відсутні", "не підведені"]

# Tags and the words that give them.
TAGS = {
    "крамниця": ["крамниця", "магазин"],
    "аптека": ["аптека"],
    "офіс": ["офіс"],
    "склад": ["склад", "складське"],
    "кафе": ["кафе"],
    "ресторан": ["ресторан"],
    "газ": ["газ"],
    "вода": ["вода"],
    "електрика": ["електрика", "світло"],
    "каналізація": ["каналізація"],
    "опалення": ["опалення"],
}

# Fields of a parameter list and the words in their labels; the first that fits takes the parameter.
PARAMETERS = {
    "total_area_m2": ["загальна площа"],
    "floor": ["^поверх(?!ов)"],
    "floors_total": ["поверхов"],
    "object_type": ["тип об['’]єкта", "тип объекта"],
    "building_location": ["^розташув", "расположен"],
    "distance_to_city": ["відстань до найближчого міста", "расстояние до ближайшего города"],
    "year_built_range": ["рік побудови", "год постройки"],
    "bathroom": ["санвузол", "санузел"],
    "heating": ["опалення", "отопление"],
}
FLAGS = {"is_business": ["бізнес"], "no_commission": ["без коміс"], "co_rent": ["спільн", "совмес"]}


def parcel_number(text: Column) -> Column:
    """The first cadastral number of a text, or ''."""
    return F.regexp_extract(F.coalesce(text, F.lit("")), "(?<!\\d)(\\d{10,12}(?::\\d{1,4}){2,3})(?!\\d)", 1)


def described_address(text: Column) -> Column:
    """region, settlement, street, building as a text names them; '' for what it doesn't name, null where it names none."""
    text = F.coalesce(text, F.lit(""))
    word = f"[{LETTERS}]+"
    region = places.region_name(F.regexp_extract(text, f"(?iu)(?:^|[,.\\s])({word}[сц]ька\\s+(?:область|обл\\.?))", 1))
    name = f"\\p{{Lu}}[{LETTERS}]*(?:\\s+\\p{{Lu}}[{LETTERS}]*)*"  # words with capitals; "м." alone is a metre
    settlement = F.trim(F.regexp_extract(text, f"(?u)(?:^|[^\\p{{L}}])(?:[МмСс]|[Сс]мт|[Сс]-ще)\\.\\s*({name})", 1))
    kinds = "вулиця|вул\\.|просп\\.|бул\\.|пров\\.|пл\\."
    street = F.trim(F.regexp_extract(text, f"(?iu)(?:^|[^\\p{{L}}])(?:{kinds})\\s*({word}(?:\\s+{word})*?)(?=\\s*(?:,|\\.|$|\\d|\\s(?:буд|№)))", 1))
    beside = F.regexp_extract(text, f"(?iu)(?:^|[^\\p{{L}}])(?:{kinds})\\s*{word}(?:\\s+{word})*?,?\\s+(\\d+[а-яіїєґ]?)(?!\\p{{L}})", 1)
    named = F.regexp_extract(text, "(?iu)(?:будинок|буд\\.|№)\\s*(\\d+[а-яіїєґ]?)(?!\\p{L})", 1)
    building = F.coalesce(F.nullif(beside, F.lit("")), named)
    found = F.struct(F.coalesce(region, F.lit("")).alias("region"), settlement.alias("settlement"), street.alias("street"), building.alias("building"))
    return F.when((found["region"] != "") | (settlement != "") | (street != "") | (building != ""), found)


def floor(text: Column) -> Column:
    """The floor that a text names ("на 3 поверсі", "5-й поверх"), or ''."""
    named = F.regexp_extract(F.coalesce(text, F.lit("")), "(?iu)(?<!\\d)\\d+(?:-й|-му)?\\s*повер(?:х|сі)(?!\\p{L})", 0)
    return F.regexp_extract(named, "^\\d+", 0)


def described_kind(text: Column) -> Column:
    """The kind of property that a description names, or ''."""
    out = F.lit("")
    for kind, words in reversed(DESCRIBED_KINDS):
        out = F.when(any_word(text, words), kind).otherwise(out)
    return out


def _hits(text: Column, table: dict[str, list[str]]) -> Column:
    return F.array_compact(F.array(*[F.when(any_word(text, words, 3), F.lit(name)) for name, words in table.items()]))


def utilities(text: Column) -> Column:
    """What is laid on, joined by commas; the word for nothing where the text says so; or ''."""
    return F.when(any_word(text, NO_UTILITIES), NO_UTILITIES[0]).otherwise(F.array_join(_hits(text, UTILITIES), ", "))


def tags(text: Column) -> Column:
    """The tags of a description, in the order of the table."""
    return _hits(text, TAGS)


def described(text: Column) -> Column:
    """Everything that patterns find in a description, as one struct."""
    return F.struct(
        parcel_number(text).alias("cadastral_number"),
        C.building_area(text).alias("building_area_sqm"),
        C.land_hectares(text).alias("land_area_ha"),
        described_address(text).alias("address"),
        floor(text).alias("floor"),
        described_kind(text).alias("property_type"),
        utilities(text).alias("utilities"),
        tags(text).alias("tags"),
    )


def parameters(items: Column) -> Column:
    """A struct of fields from an array of (label, value): the last fitting parameter of a field counts.

    Labels without a value are flags. Areas and floors are numbers, null where the value begins with none.
    """
    label = lambda i: F.lower(F.trim(F.coalesce(i["label"], F.lit(""))))
    value = lambda i: F.trim(F.coalesce(i["value"], F.lit("")))
    labelled = lambda words, others: lambda i: label(i).rlike("|".join(words)) & (~label(i).rlike("|".join(others)) if others else F.lit(True))
    given, bare = F.filter(items, lambda i: value(i) != ""), F.filter(items, lambda i: (value(i) == "") & (label(i) != ""))
    fields, before = [], []
    for name, words in PARAMETERS.items():
        last = F.try_element_at(F.transform(F.filter(given, labelled(words, before)), value), F.lit(-1))
        if name == "total_area_m2":
            last = F.replace(F.regexp_extract(last, "[\\d.,]+", 0), F.lit(","), F.lit(".")).try_cast("double")
        elif name in ("floor", "floors_total"):
            last = F.regexp_extract(last, "^\\d+", 0).try_cast("int")
        fields.append(last.alias(name))
        before = [*before, *words]
    flags = [C.elem_match(bare, labelled(words, [])).alias(name) for name, words in FLAGS.items()]
    raw = F.transform(bare, lambda i: F.trim(i["label"]))
    return F.struct(*fields, *flags, raw.alias("raw_flags"))
