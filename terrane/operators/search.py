"""Searches over unified listings: parameters as one predicate, pages with their totals, checks of a result."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.functions import columns as C
from terrane.functions import places
from terrane.operators.groups import MOST_ROWS

ACTIVE = "активне"
TESTS: dict[str, Callable[[Column, object], Column]] = {"eq": lambda c, v: c == v, "gte": lambda c, v: c >= v, "lte": lambda c, v: c <= v}


@dataclass
class Search:
    """What a caller may ask for; a parameter that is None or empty asks for nothing."""

    region: str = ""
    city: str = ""
    price_min: float | None = None
    price_max: float | None = None
    price_eq: float | None = None
    source: str = ""
    property_type: str = ""
    building_area_sqm: tuple[str, float] | None = None  # ("eq", "gte" or "lte", square metres)
    land_area_ha: tuple[str, float] | None = None
    updated_days: int | None = None
    status: str = ""  # empty: active listings
    title_contains: str = ""
    description_contains: str = ""
    price_per_m2_min: float | None = None
    price_per_m2_max: float | None = None
    price_per_ha_min: float | None = None
    price_per_ha_max: float | None = None
    exclude: places.Places = field(default_factory=places.Places)


def default_status(tests: dict[str, Column], status: Column) -> Column:
    """The conjunction of tests (by the field that each is on), with the active status unless one is on the status."""
    return places.all_of(*tests.values(), *([] if "status" in tests else [status == ACTIVE]))


def predicate(s: Search, now: Column) -> Column:
    """One predicate over a unified listing for all parameters of a search.

    An exact price overrides its bounds; land is stored in square metres and asked for in hectares; a city or a region,
    of the listing or of any of its addresses, is enough.
    """
    tests: dict[str, Column] = {}
    if s.status:
        tests["status"] = F.col("status") == s.status
    for name in ("source", "property_type"):
        if value := getattr(s, name):
            tests[name] = F.col(name) == value
    if s.updated_days:
        tests["updated"] = F.col("source_updated_at") >= now - F.make_dt_interval(F.lit(s.updated_days))
    bounds = [("price_uah", s.price_eq, s.price_eq)] if s.price_eq is not None else [("price_uah", s.price_min, s.price_max)]
    bounds += [("price_per_m2_uah", s.price_per_m2_min, s.price_per_m2_max), ("price_per_ha_uah", s.price_per_ha_min, s.price_per_ha_max)]
    for name, low, high in bounds:
        if low is not None:
            tests[f"{name} from"] = F.col(name) >= low
        if high is not None:
            tests[f"{name} to"] = F.col(name) <= high
    if s.building_area_sqm:
        tests["building"] = TESTS[s.building_area_sqm[0]](F.col("building_area_sqm"), s.building_area_sqm[1])
    if s.land_area_ha:
        tests["land"] = TESTS[s.land_area_ha[0]](F.col("land_area_sqm"), s.land_area_ha[1] * C.SQM_PER_HECTARE)
    for name, text in (("title", s.title_contains), ("description", s.description_contains)):
        if text:
            tests[f"{name} text"] = C.contains(F.col(name), text)
    where = places.Places([s.city] if s.city else [], [s.region] if s.region else [], s.exclude.not_cities, s.exclude.not_regions, s.exclude.near)
    tests["place"] = places.located(where, F.col("city"), F.col("region"), F.col("addresses"))
    return default_status(tests, F.col("status"))


def newest_first(*dates: str) -> list[Column]:
    """Newest first by the first date that a row has; rows without any last."""
    return [F.coalesce(*[F.col(c) for c in dates]).desc_nulls_last()]


def page(df: DataFrame, order: list[Column], skip: int, limit: int) -> tuple[DataFrame, DataFrame]:
    """A page of rows, and the number of all rows (one row, total), as two plans that run on their own."""
    return df.orderBy(*order).offset(skip).limit(min(limit, MOST_ROWS)), df.agg(F.count("*").alias("total"))


def exists(df: DataFrame, test: Column) -> bool:
    """Whether any row passes; reading stops at the first."""
    return not df.where(test).isEmpty()


def without_region_if_none(df: DataFrame, test: Column, region: Column) -> DataFrame:
    """Rows that pass both tests, or where there are none, those that pass the first alone."""
    both = df.where(test & region)
    return df.where(test) if both.isEmpty() else both


def violations(df: DataFrame, excluded: Column, metrics: list[str]) -> DataFrame:
    """rule, count: rows of a result that hold an excluded place, and rows without each metric that was asked for."""
    rules = {"excluded place": ~F.coalesce(excluded, F.lit(False))} | {f"no {m}": F.col(m).isNotNull() for m in metrics}
    names = F.array_compact(F.array(*[F.when(~ok, F.lit(n)) for n, ok in rules.items()]))
    return df.select(F.explode(names).alias("rule")).groupBy("rule").agg(F.count("*").alias("count"))
