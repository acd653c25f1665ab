"""Folders of many small writes, folded into generations.

A shelf is a folder of a table, such as one period of one topic. Below it, every write has a folder
of its own: a unit, numbered in the order of writing. Folding a shelf writes the rows of its finished units, and of its generation if
it has one, as a new generation: a hidden folder that nobody reads until a marker names it. The
marker also lists the units that the generation covers. It appears by one rename, so a reader sees
either the units or the generation, and every row once. What a generation replaced is removed later,
when no reader that began before can still need it.

Shelves are read through ``read_shelves``; listing them as plain Parquet folders sees units alone.
"""

import json
import time
import uuid
from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from flowloop.sources.files import Files

MARKER = "_generation-"


class Generation(NamedTuple):
    """``covers`` are the units that it replaced and that may still be there; ``through`` the last
    number that it ever took from a folder of numbered units."""

    number: int = 0
    rows: str | None = None
    covers: frozenset[str] = frozenset()
    through: dict[str, int] = {}


def _number(name: str) -> int:
    return int(name.removeprefix(MARKER))


def generation_of(files: Files, shelf: str) -> Generation:
    """The generation that readers of a shelf use by now."""
    marked = [name for name in files.names(shelf) if name.startswith(MARKER)]
    if not marked:
        return Generation()
    last = max(marked, key=_number)
    told = json.loads(files.read(f"{shelf}/{last}"))
    return Generation(_number(last), told["rows"], frozenset(told["covers"]), told["through"])


def units_of(files: Files, shelf: str, depth: int) -> list[str]:
    """The units of a shelf, ``depth`` partition folders below it, as paths from the shelf on."""
    units = [""]
    for _ in range(depth):
        units = [
            f"{unit}/{name}".lstrip("/")
            for unit in units
            for name in files.names(f"{shelf}/{unit}")
            if "=" in name and not name.startswith(("_", "."))
        ]
    return units


def read_shelves(
    spark: SparkSession,
    files: Files,
    path: str,
    shelves: Sequence[str],
    schema: T.StructType,
    depth: int,
) -> DataFrame:
    """The rows of shelves of the table at ``path``, each once."""
    units, folded = [], []
    for shelf in shelves:
        now = generation_of(files, shelf)
        if now.rows is None:
            units.append(shelf)
            continue
        folded.append(f"{shelf}/{now.rows}")
        units += [
            f"{shelf}/{unit}" for unit in units_of(files, shelf, depth) if unit not in now.covers
        ]
    reader = spark.read.schema(schema)
    parts = []
    if units:
        parts.append(reader.option("basePath", path).parquet(*units))
    if folded:
        parts.append(spark.read.schema(schema).parquet(*folded))
    parts = [part.select(*schema.names) for part in parts]
    if not parts:
        return spark.createDataFrame([], schema)
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def fold(
    spark: SparkSession,
    files: Files,
    path: str,
    shelf: str,
    schema: T.StructType,
    depth: int,
    finished: Callable[[str], bool],
    by: Sequence[str] = (),
) -> bool:
    """Make the finished units of a shelf a new generation; whether there was anything to gain.

    A generation has no partitions; its rows are sorted ``by`` columns, so that filters on them
    skip row groups. Two folds at once cannot both win: the later one's rows are dropped.
    """
    now = generation_of(files, shelf)
    units = [
        unit
        for unit in units_of(files, shelf, depth)
        if unit not in now.covers and finished(unit)
    ]
    if len(units) + (now.rows is not None) < 2:
        return False
    reader = spark.read.schema(schema).option("basePath", path)
    rows = reader.parquet(*[f"{shelf}/{unit}" for unit in units]).select(*schema.names)
    if now.rows is not None:
        old = spark.read.schema(schema).parquet(f"{shelf}/{now.rows}")
        rows = rows.unionByName(old.select(*schema.names))
    name = f"_rows-{now.number + 1}-{uuid.uuid4().hex}"
    # Units are many small files; their rows come together in few.
    rows = rows.hint("rebalance", *by)
    if by:
        rows = rows.sortWithinPartitions(*by)
    rows.write.parquet(f"{shelf}/{name}")
    # Units that are gone need no mention; those that wait for their removal do.
    waiting = [unit for unit in now.covers if files.exists(f"{shelf}/{unit}")]
    through = dict(now.through)
    for unit in units:
        parent, number = unit.rsplit("=", 1)
        through[parent] = max(int(number), through.get(parent, -1))
    told = json.dumps({"rows": name, "covers": sorted([*waiting, *units]), "through": through})
    if files.publish(f"{shelf}/{MARKER}{now.number + 1}", told):
        return True
    files.delete(f"{shelf}/{name}")
    return False


def sweep(files: Files, shelf: str, kept_seconds: float) -> None:
    """Remove what the generation of a shelf replaced at least ``kept_seconds`` ago."""
    now = generation_of(files, shelf)
    if now.rows is None:
        return
    if time.time() - files.changed_at(f"{shelf}/{MARKER}{now.number}") < kept_seconds:
        return
    for unit in sorted(now.covers):
        files.delete(f"{shelf}/{unit}")
    for name in files.names(shelf):
        older = name.startswith(MARKER) and _number(name) < now.number
        # Rows of a fold that is still being written have a higher number.
        replaced = name.startswith("_rows-") and int(name.split("-")[1]) <= now.number
        if older or (replaced and name != now.rows):
            files.delete(f"{shelf}/{name}")


def was_folded(files: Files, shelf: str, unit: str) -> bool:
    """Whether a numbered unit, or a later one of its folder, is in the shelf's generation."""
    parent, number = unit.rsplit("=", 1)
    return int(number) <= generation_of(files, shelf).through.get(parent, -1)
