"""Map-data payloads as a Spark data source: files are read in ranges, filters reach the parse.

``spark.read.format("osm").load(path)`` after ``register(spark)``. Each file is
cut into ranges of ``splitBytes`` bytes, a partition each; a partition parses
the elements that begin in its range, wherever they end. An element is found
by its first members (``{"type": "way", "id": ...``), which no JSON text can
hold unescaped; a relation's members begin otherwise (``"ref"``). So one
payload of any length is read by many tasks, and a file may hold many payloads.

Comparisons of columns with values are taken over from Spark and decided on the
parsed element before a row is made of it; whatever else is asked stays with
Spark. ``clause`` names which clause of the search an element meets, so that
the search's tags can be asked for in one comparison beside the box.

A file that isn't a payload gives no rows; where a payload breaks off, its
elements before that are read.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from operator import eq, ge, gt, le, lt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull,
    LessThan, LessThanOrEqual, StringContains, StringEndsWith, StringStartsWith
)

from waypost.sources.osm import BOX, ingest
from waypost.sources.scratch import file_system

_SCHEMA = "id long, type string, lat double, lon double, clause string, tourism string, amenity string, motorhome string, tags map<string, string>"
_COLUMNS = tuple(part.split()[0] for part in _SCHEMA.split(", ") if " " in part and not part.startswith("string>"))
_HEAD = re.compile(rb'\{\s*"type"\s*:\s*"(?:node|way|relation)"\s*,\s*"(?!ref")')
_HEAD_TEXT = re.compile(_HEAD.pattern.decode())
#: Bytes read beyond a range at first; doubled while its last element is cut off.
_TAIL = 1 << 16


def clause(kind: str | None, tags: dict) -> str | None:
    """Which clause of the search the tags of an element of that type meet."""
    motorhome = tags.get("motorhome") or ""
    if tags.get("tourism") == "caravan_site":
        return "caravan_site"
    if tags.get("amenity") == "parking" and motorhome == "yes" and kind in ("node", "way"):
        return "parking"
    if tags.get("tourism") == "camp_site" and re.search("yes|designated", motorhome):
        return "camp_site"
    return None


def _row(element: dict) -> tuple:
    """The values of an element; its own coordinates, else its centre's, exactly zero counting as missing."""
    tags = {k: v if isinstance(v, str) else json.dumps(v) for k, v in (element.get("tags") or {}).items()}
    centre, kind = element.get("center") or {}, element.get("type")
    lat, lon = (float(x) if (x := element.get(c) or centre.get(c)) is not None else None for c in ("lat", "lon"))
    return element.get("id"), kind, lat, lon, clause(kind, tags), tags.get("tourism"), tags.get("amenity"), tags.get("motorhome"), tags


_COMPARED: dict[type, Callable] = {
    EqualTo: eq, GreaterThan: gt, GreaterThanOrEqual: ge, LessThan: lt, LessThanOrEqual: le, StringContains: lambda a, b: b in a,
    StringStartsWith: str.startswith, StringEndsWith: str.endswith, In: lambda a, b: a in b
}


def _test(asked: Filter) -> Callable[[tuple], bool] | None:
    """A filter as a test of a row; None if it isn't a comparison of a plain column with a value."""
    if len(asked.attribute) != 1 or asked.attribute[0] not in _COLUMNS[:-1]:
        return None
    at = _COLUMNS.index(asked.attribute[0])
    if isinstance(asked, IsNotNull):
        return lambda row: row[at] is not None
    if isinstance(asked, IsNull):
        return lambda row: row[at] is None
    if (compare := _COMPARED.get(type(asked))) is None or getattr(asked, "value", None) != getattr(asked, "value", None):
        return None
    value = asked.value
    return lambda row: row[at] is not None and compare(row[at], value)


@dataclass
class Range(InputPartition):
    path: str
    low: int
    high: int


class OsmReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.split = options["path"], int(options.get("splitBytes", 32 << 20))
        self.asked: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for asked in filters:
            if _test(asked) is None:
                yield asked
            else:
                self.asked.append(asked)

    def partitions(self) -> list[Range]:
        from pyarrow import fs

        files, inner = file_system(self.path)
        found = files.get_file_info(inner)
        if found.type == fs.FileType.Directory:
            infos = files.get_file_info(fs.FileSelector(inner, recursive=True))
        else:
            infos = [found] if found.type == fs.FileType.File else []
        shown = [f for f in infos if f.type == fs.FileType.File and f.base_name[0] not in "._"]
        ranges = [
            Range(f.path, low, min(low + self.split, f.size)) for f in sorted(shown, key=lambda f: f.path)
            for low in range(0, f.size, self.split)
        ]
        return ranges or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[tuple]:
        if partition.high == 0:
            return
        tests = [_test(asked) for asked in self.asked]
        files, _ = file_system(self.path)
        with files.open_input_file(partition.path) as file:
            for element in _elements(file, partition.low, partition.high):
                row = _row(element)
                if all(test(row) for test in tests):
                    yield row


def _elements(file, low: int, high: int) -> Iterator[dict]:
    """The elements that begin in bytes [low, high) of an open file."""
    end, tail, decoder = file.size(), _TAIL, json.JSONDecoder()
    data = file.read_at(min(end, high + tail) - low, low)
    if (first := _HEAD.search(data)) is None or first.start() >= high - low:
        return
    skipped = first.start()
    last = len(data[skipped : high - low].decode("utf-8", "ignore"))
    text, at = data[skipped:].decode("utf-8", "ignore"), 0
    while (head := _HEAD_TEXT.search(text, at)) is not None and head.start() < last:
        try:
            element, at = decoder.raw_decode(text, head.start())
        except json.JSONDecodeError:
            if high + tail >= end:
                return
            tail *= 2
            text = file.read_at(min(end, high + tail) - low - skipped, low + skipped).decode("utf-8", "ignore")
            at = head.start()
            continue
        yield element


class OsmSource(DataSource):
    """Format ``osm``; options ``path`` (a file or folder) and ``splitBytes``."""

    @classmethod
    def name(cls) -> str:
        return "osm"

    def schema(self) -> str:
        return _SCHEMA

    def reader(self, schema) -> OsmReader:
        return OsmReader(self.options)


def register(spark: SparkSession) -> None:
    """Makes the format known to the session, and lets filters be handed to Python sources."""
    spark.dataSource.register(OsmSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def read(spark: SparkSession, path: str, split_bytes: int = 32 << 20) -> DataFrame:
    register(spark)
    return spark.read.format("osm").option("splitBytes", split_bytes).load(path)


def search(spark: SparkSession, path: str, split_bytes: int = 32 << 20) -> DataFrame:
    """The elements in the search's box that meet one of its clauses; both are decided in the parse."""
    south, west, north, east = BOX
    within = F.col("lat").between(south, north) & F.col("lon").between(west, east)
    return read(spark, path, split_bytes).filter(within & F.col("clause").isNotNull())


def places(found: DataFrame, *keep: str) -> DataFrame:
    """The base columns of elements that this source gave."""
    centre = F.lit(None).cast("struct<lat: double, lon: double>").alias("center")
    return ingest(found.select(*keep, F.struct("type", "lat", "lon", centre, "tags").alias("e")), *keep)
