"""CSV tables: the missing value is ``NA`` on the way out, and ``NA`` or nothing on the way in.

Texts keep their blanks, quotes, backslashes and line breaks. What cannot be told apart in a file is read as missing: an
empty text, and the text ``NA``.

Files of one table may differ in the order and number of their columns: files are grouped by their header line, each group is one
scan by its own names, and the groups are put together. An export is written beside its place and gets its name when it is
complete; an export without the marker that Spark writes last is left alone by readers.
"""

from __future__ import annotations

import csv
import io
import json
import re
from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, IntegerType, LongType, StringType, StructField, StructType

from assayline.schemas import SCHEMAS, WITH_LINE_BREAKS
from assayline.sources.files import Files

MISSING = "NA"
# For reading and writing alike.
TEXT_OPTIONS = {
    "header": "true",
    "nullValue": MISSING,
    "escape": '"',
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
}
#: Column that tells the order of a table's rows in its files.
POSITION = "_position"
# File or folder name of an export: the table, a date stamp or none, ".csv".
STAMPED_NAME = r"^(.*?)(?:_?([0-9]{6,}))?\.csv$"


def _typed(name: str, kind: DataType) -> Column:
    raw = F.col(f"`{name}`")
    if isinstance(kind, LongType):
        # Exports may write a whole number as 12.0.
        return F.coalesce(raw.try_cast("bigint"), raw.try_cast("double").try_cast("bigint")).alias(name)
    return raw.try_cast(kind).alias(name)


def _header(head: bytes, path: str) -> tuple[str, ...]:
    """Column names of the first line of a file that holds any text. Without a line there are none."""
    names = next((row for row in csv.reader(io.StringIO(head.decode("utf-8-sig"), newline="")) if row), [])
    if len(set(names)) < len(names):
        raise ValueError(f"{path} has a column twice: {names}")
    return tuple(names)


def files_by_header(spark: SparkSession, path: str | Sequence[str]) -> dict[tuple[str, ...], list[str]]:
    """Data files at some paths by their column names; files without a line are left out. Only first lines are read."""
    files = Files(spark)
    paths = [f for p in ([path] if isinstance(path, str) else path) for f in files.data_files(p)]
    groups: dict[tuple[str, ...], list[str]] = {}
    for name, head in zip(paths, files.heads(paths), strict=True):
        if names := _header(head, name):
            groups.setdefault(names, []).append(name)
    return groups


def read_csv(
    spark: SparkSession,
    path: str | Sequence[str],
    schema: StructType,
    line_breaks: bool = False,
    misfits: str | None = None,
    position: bool = False,
) -> DataFrame:
    """A CSV table with the columns of ``schema``, found by name in each file; text that does not fit a type is NULL.

    Files with the same header are read by one scan. A column that a file lacks is NULL in its rows; reading is refused if no file
    has it, as a mistake in the name. ``line_breaks``: quoted text may hold line breaks; a file is then read by one task.
    ``misfits`` names an additional column with the number of values of a row that did not fit. ``position`` adds the column POSITION:
    it compares as the rows stand in the files, these in the order of their names, however the scan is split; only its order means
    something.
    """
    groups = files_by_header(spark, path)
    known = {name for header in groups for name in header}
    unknown = [name for name in schema.names if name not in known]
    if groups and unknown:
        raise ValueError(f"no file at {path} has the columns {unknown}")
    scans = [_read_group(spark, files, header, schema, line_breaks, misfits, position) for header, files in sorted(groups.items())]
    if not scans:
        extra = [StructField(misfits, IntegerType())] if misfits else []
        empty = spark.createDataFrame([], StructType([*schema.fields, *extra]))
        return empty.withColumn(POSITION, F.struct(F.lit("").alias("file"), *[F.lit(0).cast("long").alias(c) for c in ("block", "row")])) if position else empty
    return reduce(DataFrame.union, scans)


def _read_group(
    spark: SparkSession,
    files: list[str],
    header: tuple[str, ...],
    schema: StructType,
    line_breaks: bool,
    misfits: str | None,
    position: bool,
) -> DataFrame:
    reader = spark.read.options(**TEXT_OPTIONS, emptyValue=MISSING, multiLine=str(line_breaks).lower())
    # A column without a name, as some tools write for row numbers, is never asked for.
    layout = StructType([StructField(name or f"_unnamed_{i}", StringType()) for i, name in enumerate(header)])
    there = {name for name in header if name}
    raw = reader.schema(layout).option("enforceSchema", "" in header).csv(files)
    values = [_typed(f.name, f.dataType) if f.name in there else F.lit(None).cast(f.dataType).alias(f.name) for f in schema]
    if misfits is not None:
        given = [(f, v) for f, v in zip(schema, values, strict=True) if f.name in there]
        lost = [(F.col(f"`{f.name}`").isNotNull() & v.isNull()).cast("int") for f, v in given]
        values.append(reduce(add, lost, F.lit(0)).alias(misfits))
    if position:
        # A split's rows are numbered upwards as they are read, and a file's splits are told apart by where they begin.
        place = F.struct(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("row"),
        )
        values.append(place.alias(POSITION))
    return raw.select(*values)


def _read_table(spark: SparkSession, path: str, table: str, position: bool = False) -> DataFrame:
    return read_csv(spark, path, SCHEMAS[table], line_breaks=table in WITH_LINE_BREAKS, position=position)


def read_lab_csv(spark: SparkSession, folder: str, table: str, position: bool = False) -> DataFrame:
    """One lab table from ``<folder>/<table>.csv``."""
    return _read_table(spark, f"{folder}/{table}.csv", table, position)


def _day(stamp: str) -> str:
    """Stamps of six digits are years from 2000 on: 220801 is 20220801."""
    return f"20{stamp}" if len(stamp) == 6 else stamp


def newest_exports(spark: SparkSession, folder: str, whole_only: bool = True) -> dict[str, str]:
    """Table name to the path of its newest export: ``test_20220724.csv`` is a copy of ``test``.

    An export is a file, or a folder of part files, directly in the given folder. A folder without the marker that is written last
    is not complete, and the newest one before it counts; with ``whole_only`` off it counts too, for folders of tools that write
    no marker. Names are listed only; nothing is read.
    """
    files = Files(spark)
    stamped: dict[str, list[tuple[str, str]]] = {}
    for name, _ in files.listed(folder):
        found = re.match(STAMPED_NAME, name)
        if found and found[1] and name[0] not in "_.":
            stamped.setdefault(found[1], []).append((_day(found[2] or ""), f"{folder.rstrip('/')}/{name}"))
    newest = {}
    for table, exports in sorted(stamped.items()):
        whole = (path for _, path in sorted(exports, reverse=True) if not whole_only or files.is_whole(path))
        if (path := next(whole, None)) is not None:
            newest[table] = path
    return newest


def read_lab_folder(
    spark: SparkSession, folder: str, whole_only: bool = True, position: Sequence[str] = ()
) -> dict[str, DataFrame]:
    """All lab tables of a folder of dated exports, the newest of each; other files are left alone. Tables named in ``position`` get
    the column POSITION, by which operators choose the first of several rows.

    If the folder has a published set of exports (``publish_set``), its tables are those of the newest set, and only tables that
    are in no set are looked for by their stamps.
    """
    found = newest_exports(spark, folder, whole_only) | newest_set(spark, folder)
    return {table: _read_table(spark, path, table, table in position) for table, path in found.items() if table in SCHEMAS}


def publish_set(spark: SparkSession, folder: str, stamp: str, exports: dict[str, str]) -> str:
    """Makes written exports (table to path) the set of a stamp, all at one moment: readers see the whole set or none of it.
    Returns the path of the manifest. An export that is not complete is refused."""
    files = Files(spark)
    if broken := [path for path in exports.values() if not files.exists(path) or not files.is_whole(path)]:
        raise ValueError(f"not complete: {broken}")
    manifest = f"{folder.rstrip('/')}/set_{stamp}.json"
    files.publish(manifest, json.dumps({"stamp": stamp, "exports": exports}, indent=1, sort_keys=True))
    return manifest


def newest_set(spark: SparkSession, folder: str) -> dict[str, str]:
    """Table to path of the newest published set of a folder; empty if there is none."""
    files = Files(spark)
    stamps = [(_day(m[1]), name) for name, _ in files.listed(folder) if (m := re.fullmatch(r"set_(.+)\.json", name))]
    return json.loads(files.text(f"{folder.rstrip('/')}/{max(stamps)[1]}"))["exports"] if stamps else {}


def write_lab_folder(spark: SparkSession, tables: dict[str, DataFrame], folder: str, stamp: str) -> dict[str, str]:
    """Writes tables as exports of one stamp and publishes them as a set when all are written; table to path."""
    exports = {}
    for name, df in tables.items():
        exports[name] = f"{folder.rstrip('/')}/{name}_{stamp}.csv"
        write_table(df, exports[name])
    publish_set(spark, folder, stamp, exports)
    return exports


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] | None = None) -> None:
    """Write a table as CSV; with ``partition_by`` one folder per key.

    Rows are brought together by key so that a key has few files; a large key gets several. The table is written beside its place:
    what was there before stays until the new one is complete, and stays if writing fails.
    """
    if partition_by:
        df = df.hint("rebalance", *partition_by)
    writer = df.write.options(**TEXT_OPTIONS)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    _write_beside(df.sparkSession, writer, path)


def _write_beside(spark: SparkSession, writer: DataFrameWriter, path: str) -> None:
    files = Files(spark)
    staged = files.beside(path)
    writer.csv(staged)
    files.replace(staged, path)


def write_site_errors(site_rates: DataFrame, path: str) -> None:
    """The per-site error tables: one folder with one file per site, rows by falling percentage."""
    # A fixed number of tasks, so that they are not merged into one: the work is in the files, not the rows.
    tasks = int(site_rates.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = site_rates.repartition(tasks, "supplier_site_id").sortWithinPartitions(
        "supplier_site_id", F.desc("percent"), "error_code_list"
    )
    _write_beside(site_rates.sparkSession, placed.write.options(**TEXT_OPTIONS).partitionBy("supplier_site_id"), path)
