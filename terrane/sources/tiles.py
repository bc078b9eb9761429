"""Vector map tiles: decoded into features and parcels in Arrow batches, and written in parts.

A tile is a list of layers, a layer a list of features over common keys and values. Two tiles' bytes in a row are one tile
with the layers of both, so a tile may be written in parts, wherever its features lie, and no task needs to hold it whole.
"""

from __future__ import annotations

import gzip
import itertools
import math
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.sources.files import largest_ring

EXTENT = 4096
KINDS = {1: "point", 2: "line", 3: "polygon"}
MOVE, LINE, CLOSE = 1, 2, 7
FEATURES = "x long, y long, layer string, id long, kind string, parts array<array<array<double>>>, properties map<string,string>"
ARROW = pa.schema(
    [("x", pa.int64()), ("y", pa.int64()), ("layer", pa.string()), ("id", pa.int64()), ("kind", pa.string()), ("parts", pa.list_(pa.list_(pa.list_(pa.float64())))), ("properties", pa.map_(pa.string(), pa.string()))]
)


# bytes


def _varint(data: bytes, at: int) -> tuple[int, int]:
    """A number of seven bits a byte, the lowest first, and where the next thing begins."""
    value = shift = 0
    while True:
        if at >= len(data) or shift > 63:
            raise ValueError("a number has no end")
        b = data[at]
        value |= (b & 127) << shift
        at, shift = at + 1, shift + 7
        if b < 128:
            return value & (1 << 64) - 1, at


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of each field of a message: a number, or bytes."""
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        kind = tag & 7
        if kind == 0:
            value, at = _varint(data, at)
        else:
            if kind == 2:
                n, at = _varint(data, at)
            elif kind in (1, 5):
                n = 8 if kind == 1 else 4
            else:
                raise ValueError("no such kind of field")
            value, at = data[at : at + n], at + n
            if at > len(data):
                raise ValueError("a field has no end")
        yield tag >> 3, value


def _numbers(data: bytes) -> list[int]:
    out, at = [], 0
    while at < len(data):
        n, at = _varint(data, at)
        out.append(n)
    return out


def _signed(n: int) -> int:
    return (n >> 1) ^ -(n & 1)


def _value(data: bytes) -> str | None:
    """A property's value as text."""
    text = None
    for field, v in _fields(data):
        if field == 1:
            text = v.decode("utf-8", "replace")
        elif field in (2, 3):
            text = repr(struct.unpack("<f" if field == 2 else "<d", v)[0])
        elif field in (4, 5):
            text = str(v - (1 << 64) if field == 4 and v >> 63 else v)
        elif field == 6:
            text = str(_signed(v))
        elif field == 7:
            text = "true" if v else "false"
    return text


def drawn(commands: list[int], kind: int) -> list[list[tuple[int, int]]]:
    """The points, lines or rings (open) that a feature's commands draw, in the units of its layer."""
    parts: list[list[tuple[int, int]]] = []
    x = y = at = 0
    while at < len(commands):
        what, times = commands[at] & 7, commands[at] >> 3
        at += 1
        if what == CLOSE:
            continue
        if what not in (MOVE, LINE) or at + 2 * times > len(commands) or (what == LINE and not parts):
            raise ValueError("no such command")
        for _ in range(times):
            x, y, at = x + _signed(commands[at]), y + _signed(commands[at + 1]), at + 2
            if what == MOVE:
                parts.append([])
            parts[-1].append((x, y))
    return parts if kind != 3 else [p[:-1] if len(p) > 1 and p[0] == p[-1] else p for p in parts]


def layers(data: bytes | None) -> list[tuple[str, int, list[tuple]]]:
    """(name, extent, features) of each layer, a feature being (id, kind, parts, properties); a broken tile has none.

    Tiles may be packed by gzip. Features of no known kind and properties without a key or value are left out.
    """
    try:
        data = gzip.decompress(data) if data and data[:2] == b"\x1f\x8b" else data or b""
        return [_layer(v) for field, v in _fields(data) if field == 3]
    except (ValueError, TypeError, AttributeError, struct.error, OSError, EOFError):
        return []


def _layer(data: bytes) -> tuple[str, int, list[tuple]]:
    name, extent, keys, values, features = "", EXTENT, [], [], []
    for field, v in _fields(data):
        if field == 1:
            name = v.decode("utf-8", "replace")
        elif field == 2:
            features.append(v)
        elif field == 3:
            keys.append(v.decode("utf-8", "replace"))
        elif field == 4:
            values.append(_value(v))
        elif field == 5:
            extent = v
    if not extent:
        raise ValueError("a layer has no extent")
    return name, extent, [f for f in (_feature(x, keys, values) for x in features) if f[1]]


def _feature(data: bytes, keys: list[str], values: list[str | None]) -> tuple:
    ident, kind, tags, commands = None, 0, [], []
    for field, v in _fields(data):
        if field == 1:
            ident = v - (1 << 64) if v >> 63 else v
        elif field == 2:
            tags += _numbers(v)
        elif field == 3:
            kind = v
        elif field == 4:
            commands += _numbers(v)
    pairs = zip(tags[::2], tags[1::2], strict=False)
    known = {keys[k]: values[v] for k, v in pairs if k < len(keys) and v < len(values) and values[v] is not None}
    return ident, KINDS.get(kind), drawn(commands, kind), known


def place(x: int, y: int, zoom: int, extent: int, point: tuple[int, int]) -> list[float]:
    """Longitude and latitude of a point of a tile."""
    n = 2.0**zoom
    lat = math.atan(math.sinh(math.pi * (1 - 2 * (y + point[1] / extent) / n)))
    return [(x + point[0] / extent) / n * 360 - 180, math.degrees(lat)]


# tables


def tile_features(df: DataFrame, data: str, x: str | Column, y: str | Column, zoom: str | Column) -> DataFrame:
    """x, y, layer, id, kind, parts, properties: a row for each feature of the tiles in a column.

    parts are points, lines or rings (closed; of three points or more) in degrees. Null, empty and broken tiles and those of no known place give no row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for tx, ty, z, tile in zip(*b.columns, strict=True):
                tx, ty, z = tx.as_py(), ty.as_py(), z.as_py()
                rows = []
                if None not in (tx, ty, z) and 0 <= z <= 30:
                    for name, extent, features in layers(tile.as_py()):
                        for ident, kind, parts, known in features:
                            closed = [[*p, p[0]] for p in parts if len(p) > 2] if kind == "polygon" else parts
                            rows.append({"x": tx, "y": ty, "layer": name, "id": ident, "kind": kind, "parts": [[place(tx, ty, z, extent, q) for q in p] for p in closed], "properties": list(known.items())})
                yield pa.RecordBatch.from_pylist(rows, schema=ARROW)

    cols = [(c if isinstance(c, Column) else F.col(c)).cast("long").alias(n) for c, n in ((x, "x"), (y, "y"), (zoom, "z"))]
    return df.select(*cols, F.col(data).alias("tile")).mapInArrow(run, FEATURES)


# The layers that hold parcels, and what their properties may be called.
PARCEL_LAYER = "polygons"
NUMBER = ["cadnum", "cadastral_number", "kadastr", "number", "id", "code", "cadastralNumber", "kadastr_number"]
AREA = ["area_sqm", "area", "площа", "area_m2"]
FIELDS = {
    "address": ["address", "full_address", "addr", "адреса"],
    "purpose": ["purpose_code", "purpose", "призначення"],
    "purpose_label": ["purpose", "purpose_label", "purpose_name"],
    "category": ["category", "category_name", "категорія"],
    "ownership": ["ownership", "ownership_form", "форма_владності"],
}


def tile_parcels(features: DataFrame) -> DataFrame:
    """number, area (square metres), ring, bounding box and what else is said of the parcels among the features of tiles.

    The ring is the largest one. Areas under 1 are hectares. Features without a number or a ring are none. A parcel that
    several tiles show is one row, that of its largest box (then smallest tile), since tiles cut what crosses their border.
    """
    said = lambda names: F.coalesce(*[F.nullif(F.trim(F.try_element_at("properties", F.lit(n))), F.lit("")) for n in names])
    area = F.replace(said(AREA), F.lit(","), F.lit(".")).try_cast("double")
    metres = F.when((area > 0) & (area < 1), area * 10_000).otherwise(area)
    of_parcels = features.where(F.lower("layer").contains(PARCEL_LAYER) & (F.col("kind") == "polygon"))
    rows = of_parcels.select("x", "y", said(NUMBER).alias("number"), metres.alias("area"), *[said(n).alias(c) for c, n in FIELDS.items()], largest_ring(F.col("parts")).alias("ring")).where("number is not null and ring is not null")
    xs, ys = F.transform("ring", lambda p: p[0]), F.transform("ring", lambda p: p[1])
    boxed = rows.withColumns({"x0": F.array_min(xs), "y0": F.array_min(ys), "x1": F.array_max(xs), "y1": F.array_max(ys)})
    wide = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    cols = [c for c in boxed.columns if c not in ("x", "y", "number")]
    best = F.max_by(F.struct(*cols), F.struct(wide, -F.col("x"), -F.col("y"), *[c for c in cols if c != "ring"]))
    return boxed.groupBy("number").agg(best.alias("p")).select("number", "p.*")


def _number(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _held(field: int, data: bytes) -> bytes:
    return _number(field << 3 | 2) + _number(len(data)) + data


def polygon_commands(rings: list[list[list[int]]]) -> list[int]:
    """The commands that draw rings, whose points are in the units of the layer."""
    zigzag = lambda n: n << 1 if n >= 0 else (-n << 1) - 1
    out, x, y = [], 0, 0
    for ring in rings:
        steps = []
        for px, py in ring:
            steps += [zigzag(px - x), zigzag(py - y)]
            x, y = px, py
        out += [MOVE | 1 << 3, *steps[:2], LINE | len(ring) - 1 << 3, *steps[2:], CLOSE | 1 << 3]
    return out


def polygon_layer(name: str, features: list[tuple[int, list, dict[str, str]]], extent: int = EXTENT) -> bytes:
    """A tile of one layer with polygons (id, rings, properties)."""
    keys: dict[str, int] = {}
    values: dict[str, int] = {}
    body = b""
    for ident, rings, known in features:
        tags = [n for k, v in known.items() for n in (keys.setdefault(k, len(keys)), values.setdefault(v, len(values)))]
        body += _held(2, _number(8) + _number(ident) + _held(2, b"".join(map(_number, tags))) + b"\x18\x03" + _held(4, b"".join(map(_number, polygon_commands(rings)))))
    body += b"".join(_held(3, k.encode()) for k in keys) + b"".join(_held(4, _held(1, v.encode())) for v in values)
    return _held(3, b"\x78\x02" + _held(1, name.encode()) + body + _number(5 << 3) + _number(extent))


def tile_parts(df: DataFrame, layer: str) -> DataFrame:
    """x, y, data: tiles of polygons (x, y, id, rings in units of the tile, properties as text), in parts that are tiles themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for (x, y), rows in itertools.groupby(b.to_pylist(), lambda r: (r["x"], r["y"])):
                data = polygon_layer(layer, [(r["id"], r["rings"], {k: v for k, v in r["properties"] if v is not None}) for r in rows])
                yield pa.RecordBatch.from_pylist([{"x": x, "y": y, "data": data}], schema=pa.schema([("x", pa.int64()), ("y", pa.int64()), ("data", pa.binary())]))

    cols = df.select(F.col("x").cast("long"), F.col("y").cast("long"), F.col("id").cast("long"), F.col("rings").cast("array<array<array<int>>>"), "properties")
    # tiles come together in partitions of bounded size, whatever the input's are; a tile of many polygons may lie in several
    return cols.hint("rebalance", "x", "y").sortWithinPartitions("x", "y", "id").mapInArrow(run, "x long, y long, data binary")
