"""Reports as files, and fields of stored web pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BOM = "\ufeff"


def flat(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text, nulls as empty text, all columns as text."""
    nested = (T.ArrayType, T.StructType, T.MapType)
    cols = [(F.to_json(F.col(f.name)) if isinstance(f.dataType, nested) else F.col(f.name).cast("string")).alias(f.name) for f in df.schema]
    return df.select(cols).na.fill("")


def write_csv(df: DataFrame, path: str, separator: str = ";") -> None:
    """One CSV folder with a header whose first name carries the byte order mark, for spreadsheets."""
    text = flat(df)
    text = text.withColumnRenamed(text.columns[0], BOM + text.columns[0])
    text.write.option("header", True).option("sep", separator).option("encoding", "UTF-8").csv(path)


def read_csv(spark, path: str, separator: str = ";") -> DataFrame:
    df = spark.read.option("header", True).option("sep", separator).csv(path)
    return df.toDF(*[c.lstrip(BOM) for c in df.columns])


def write_json(df: DataFrame, path: str, columns: list[str] | None = None) -> None:
    (df.select(*columns) if columns else df).write.option("ignoreNullFields", False).json(path)


def rows_by_ids(df: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """The rows whose key is among ids (one column), each once."""
    return df.join(ids.toDF(key).distinct(), key, "left_semi").dropDuplicates([key])


def months(first: str | Column, last: str | Column) -> Column:
    """The first days of all months from one date's to another's, one to a row."""
    day = lambda c: F.trunc((c if isinstance(c, Column) else F.lit(c)).cast("date"), "month")
    return F.explode(F.sequence(day(first), day(last), F.expr("interval 1 month")))


def tile_of(lon: Column, lat: Column, zoom: int) -> dict[str, Column]:
    """x and y of the map tile that holds a point, in the usual web projection."""
    n = F.lit(float(2**zoom))
    return {"x": F.floor((lon + 180) / 360 * n), "y": F.floor((1 - F.asinh(F.tan(F.radians(lat))) / F.pi()) / 2 * n)}


def tile_cells(spark, west: float, south: float, east: float, north: float, zoom: int, first: tuple[float, float, float, float] | None = None) -> DataFrame:
    """x, y, bounds and priority of the map tiles over a box, in the usual web projection.

    Tiles that meet the box `first` (west, south, east, north) have priority 0, all others 1.
    """
    import math

    n = 2**zoom
    x = lambda lon: int((lon + 180) / 360 * n)
    y = lambda lat: int((1 - math.asinh(math.tan(math.radians(lat))) / math.pi) / 2 * n)
    grid = spark.range((x(east) - x(west) + 1) * (y(south) - y(north) + 1))
    wide = x(east) - x(west) + 1
    cells = grid.select((F.col("id") % wide + x(west)).alias("x"), (F.floor(F.col("id") / wide) + y(north)).alias("y"))
    lon = lambda c: c / F.lit(float(n)) * 360 - 180
    lat = lambda c: F.degrees(F.atan(F.sinh(F.lit(math.pi) * (1 - 2 * c / F.lit(float(n))))))
    cells = cells.select("x", "y", lon(F.col("x")).alias("west"), lat(F.col("y") + 1).alias("south"), lon(F.col("x") + 1).alias("east"), lat(F.col("y")).alias("north"))
    meets = (F.col("west") < first[2]) & (F.col("east") > first[0]) & (F.col("south") < first[3]) & (F.col("north") > first[1]) if first else F.lit(False)
    return cells.withColumn("priority", F.when(meets, 0).otherwise(1))


PARCELS = "features array<struct<geometry struct<type string, coordinates array<array<array<double>>>>, properties struct<number string, area double, purpose string, ownership string>>>"


def geojson_parcels(df: DataFrame, column: str) -> DataFrame:
    """A row for every polygon of GeoJSON texts: its properties, outer ring (closed) and bounding box; others are left out."""
    features = df.select(F.explode(F.from_json(column, PARCELS)["features"]).alias("f")).where("f.geometry.type = 'Polygon'")
    outer = F.get(F.col("f.geometry.coordinates"), F.lit(0))
    closed = F.when(outer[0] == F.element_at(outer, -1), outer).otherwise(F.concat(outer, F.slice(outer, 1, 1)))
    rows = features.where(F.size(outer) > 2).select("f.properties.*", closed.alias("ring"))
    xs, ys = F.transform("ring", lambda p: p[0]), F.transform("ring", lambda p: p[1])
    return rows.withColumns({"x0": F.array_min(xs), "y0": F.array_min(ys), "x1": F.array_max(xs), "y1": F.array_max(ys)})


def page_fields(html: Column) -> dict[str, Column]:
    """Title, language, number of links and visible text of a page, by patterns."""
    body = F.regexp_replace(html, "(?is)<(script|style)\\b.*?</\\1>", " ")
    text = F.trim(F.regexp_replace(F.regexp_replace(body, "(?s)<[^>]*>", " "), "\\s+", " "))
    return {
        "title": F.trim(F.regexp_extract(html, "(?is)<title[^>]*>(.*?)</title>", 1)),
        "lang": F.regexp_extract(html, "(?i)<html[^>]*\\blang=\"([^\"]*)\"", 1),
        "n_links": F.regexp_count(html, F.lit("(?i)<a\\s")),
        "text": text,
    }


# Phrases of pages that check the visitor, and of listings that are gone.
BLOCKED = ["captcha", "cloudflare", "перевірка браузера", "перевірте, що ви не робот", "please wait", "just a moment", "enable javascript", "увімкніть javascript", "ddos protection", "checking your browser", "ray id", "cf-browser-verification", "challenge-running", "turnstile"]
INACTIVE = ["оголошення неактивне", "прибрано з публікації", "знято з публікації", "оголошення не знайдено", "ми не знайшли оголошення", "таке оголошення не знайдено", "об'єкт не знайдено", "сторінку не знайдено"]


def page_state(html: Column, least: int = 40) -> Column:
    """'blocked', 'inactive', 'empty' (under `least` characters of text) or 'ok'."""
    import re

    low = F.translate(F.lower(html), "\u00a0\u202f", "  ")
    says = lambda phrases: low.rlike("|".join(re.escape(p) for p in phrases))
    return F.when(html.isNull() | (F.trim(html) == ""), "empty").when(says(BLOCKED), "blocked").when(says(INACTIVE), "inactive").when(F.length(page_fields(html)["text"]) < least, "empty").otherwise("ok")


def newest_file(spark, path: str, pattern: str) -> DataFrame:
    """file, path, modified: the file under path that was modified last among those whose name fits the pattern."""
    files = spark.read.format("binaryFile").load(path).select("path", "modificationTime")
    named = files.withColumn("file", F.element_at(F.split("path", "/"), -1)).where(F.col("file").rlike(pattern))
    return named.agg(F.max_by("file", F.struct("modificationTime", "file")).alias("file"), F.max_by("path", F.struct("modificationTime", "file")).alias("path"), F.max("modificationTime").alias("modified"))


def dates_in_name(name: Column) -> dict[str, Column]:
    """The first and last day that a file's name gives, as 2024-01-05_2024-02-01 or 05.01.2024-01.02.2024; null where it gives none."""
    iso, dotted = "(\\d{4}-\\d{2}-\\d{2})", "(\\d{2}\\.\\d{2}\\.\\d{4})"
    day = lambda k: F.coalesce(F.regexp_extract(name, f"{iso}_{iso}", k).try_cast("date"), F.try_to_timestamp(F.nullif(F.regexp_extract(name, f"{dotted}-{dotted}", k), F.lit("")), F.lit("dd.MM.yyyy")).cast("date"))
    return {"first": day(1), "last": day(2)}


def report(template: list[tuple[str, DataFrame]], base: str, kind: str = "csv") -> dict[str, str]:
    """Write each named part of a template under base, as CSV with commas or as JSON; the parts' paths."""
    paths = {}
    for name, df in template:
        paths[name] = f"{base}/{name}"
        if kind == "csv":
            write_csv(df, paths[name], ",")
        else:
            write_json(df, paths[name])
    return paths


def rebuild(df: DataFrame, path: str) -> str:
    """Write a whole new version of a table beside the old ones and return its path; readers change over at once."""
    import uuid

    fresh = f"{path}/version-{uuid.uuid4().hex}"
    df.write.parquet(fresh)
    return fresh


# The start of a card's link in a list of pages, and what a card may hold.
CARD = "(?s)<a\\s[^>]*href=\"[^\"]*\"[^>]*>.*?</a>"


def html_cards(html: Column) -> Column:
    """The cards of a page of results: place (from 1), link, title (the link's text without tags), price, from its numbers."""
    found = F.regexp_extract_all(html, F.lit(CARD), F.lit(0))
    text = lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, "(?s)<[^>]*>", " "), "\\s+", " "))
    from terrane.functions.columns import price_in_text

    return F.transform(found, lambda c, i: F.struct((i + 1).alias("place"), F.regexp_extract(c, "href=\"([^\"]*)\"", 1).alias("link"), text(c).alias("title"), price_in_text(text(c)).alias("price")))


def largest_ring(rings: Column) -> Column:
    """The ring of the most area, closed; rings of fewer than three points are none."""
    def area(r: Column) -> Column:
        nxt = F.concat(F.slice(r, F.lit(2), F.size(r)), F.slice(r, 1, 1))
        return F.abs(F.aggregate(F.zip_with(r, nxt, lambda p, q: p[0] * q[1] - q[0] * p[1]), F.lit(0.0), lambda a, x: a + x)) / 2

    sized = F.transform(F.filter(rings, lambda r: F.size(r) > 2), lambda r: F.struct(area(r).alias("area"), r.alias("ring")))
    best = F.array_max(sized)["ring"]
    return F.when(best[0] == F.element_at(best, -1), best).otherwise(F.concat(best, F.slice(best, 1, 1)))
