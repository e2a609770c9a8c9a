"""Tables from a database, and the export of its catalog.

A scan is split into ranges of a whole-number key that hold like numbers of rows (``key_ranges``). An export runs a bounded number
of tables at once, writes each under a new name, notes the tables that are complete, and publishes them by one manifest when all
are; run again under the same name, it does only what is left.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from assayline.functions.nulls import blank_to_null
from assayline.sources import key_ranges
from assayline.sources.files import Files
from assayline.sources.lab_csv import write_table

DEFAULT_PARTITIONS = 32
FETCH_ROWS = 10_000
#: Rows of a key's sample, if the database keeps no histogram of it.
SAMPLE_ROWS = 50_000
#: Tables that an export works on at the same time.
TABLES_AT_ONCE = 4


def scan_options(url: str, schema: str, table: str, properties: dict[str, str] | None = None) -> dict[str, str]:
    """Options of a full scan of one table; filters and columns are pushed into it by Spark."""
    return {"url": url, "dbtable": f"{schema}.{table}", "fetchsize": str(FETCH_ROWS), **(properties or {})}


def range_options(column: str, low: int, high: int, partitions: int) -> dict[str, str]:
    """Options that split a scan into ranges of equal width of a numeric key; rows without a key go to the first range."""
    return {
        "partitionColumn": column,
        "lowerBound": str(low),
        "upperBound": str(high + 1),
        "numPartitions": str(max(1, min(partitions, high - low + 1))),
    }


def key_query(schema: str, table: str) -> str:
    """Query for the whole-number columns of a table, those of its primary key first."""
    own = f"c.table_schema = '{_quoted(schema)}' AND c.table_name = '{_quoted(table)}'"
    return f"""SELECT c.column_name,
      CASE WHEN EXISTS (SELECT 1 FROM information_schema.key_column_usage k
        JOIN information_schema.table_constraints t ON t.constraint_name = k.constraint_name AND t.table_schema = k.table_schema
        WHERE t.constraint_type = 'PRIMARY KEY' AND k.table_schema = c.table_schema AND k.table_name = c.table_name
        AND k.column_name = c.column_name) THEN 0 ELSE 1 END AS place, c.ordinal_position
      FROM information_schema.columns c WHERE {own}
      AND LOWER(c.data_type) IN ('smallint', 'integer', 'int', 'bigint', 'int2', 'int4', 'int8')"""


def _quoted(text: str) -> str:
    return text.replace("'", "''")


def find_key(spark: SparkSession, url: str, schema: str, table: str, properties: dict[str, str] | None = None) -> str | None:
    """The column by which to split the scan of a table: a whole-number one, of the primary key if there is one."""
    query = key_query(schema, table)
    rows = spark.read.format("jdbc").options(url=url, query=query, **(properties or {})).load().collect()
    return min(((r[1], r[2], r[0]) for r in rows), default=(None, None, None))[2]


def catalog_query(schemas: Sequence[str]) -> str:
    """Query for the tables of some schemas."""
    listed = ", ".join(f"'{_quoted(s)}'" for s in schemas)
    return f"SELECT table_schema, table_name FROM information_schema.tables WHERE table_schema IN ({listed})"


def statistics_query(schema: str, table: str, column: str) -> str:
    """Query for what the database knows of a column: histogram, frequent values with their shares, share of missing ones."""
    own = f"schemaname = '{_quoted(schema)}' AND tablename = '{_quoted(table)}' AND attname = '{_quoted(column)}'"
    lists = ("histogram_bounds", "most_common_vals", "most_common_freqs")
    return f"SELECT {', '.join(f'CAST({c} AS text) AS {c}' for c in lists)}, null_frac FROM pg_stats WHERE {own}"


def sample_query(schema: str, table: str, column: str, percent: float) -> str:
    """Query for the keys of a sample of the table's pages."""
    return f"SELECT {column} AS sampled FROM {schema}.{table} TABLESAMPLE SYSTEM ({percent:.6f}) WHERE {column} IS NOT NULL"


def size_query(schema: str, table: str) -> str:
    """Query for the database's estimate of a table's rows; it counts nothing."""
    own = f"n.nspname = '{_quoted(schema)}' AND c.relname = '{_quoted(table)}'"
    return f"SELECT c.reltuples AS estimate FROM pg_class c JOIN pg_namespace n ON n.oid = c.relnamespace WHERE {own}"


def key_distribution(
    ask: Callable[[str], DataFrame], schema: str, table: str, column: str, partitions: int
) -> key_ranges.Distribution | None:
    """The distribution of a key, from the database's histogram, else from a sample of some SAMPLE_ROWS keys, of which Spark takes
    the quantiles; None for a table without keys. ``ask`` runs a query in the database."""
    row = ask(statistics_query(schema, table, column)).first()
    if row is not None and (known := key_ranges.from_catalog(*row)) is not None:
        return known
    size = ask(size_query(schema, table)).first()
    rows = float(size[0]) if size is not None and size[0] else 0.0
    sampled = ask(sample_query(schema, table, column, min(100.0, 100.0 * SAMPLE_ROWS / rows) if rows > 0 else 100.0))
    places = [i / partitions for i in range(partitions + 1)]
    bounds = sampled.agg(F.percentile_approx("sampled", places, F.lit(10 * max(partitions, 100)))).first()[0]
    return key_ranges.Distribution(tuple(int(b) for b in bounds)) if bounds else None


def read_lab_jdbc(
    spark: SparkSession,
    url: str,
    schema: str,
    table: str,
    key: str | None = None,
    partitions: int = DEFAULT_PARTITIONS,
    properties: dict[str, str] | None = None,
    even: bool = False,
) -> DataFrame:
    """One table from a database, in parallel; blank text is NULL.

    The scan is split by a whole-number key, which is found in the catalog if none is given: half-open ranges of like numbers of
    rows, as far as the key's distribution is known, which an index can serve, and the rows without a key. A table without any such
    column is read by one task. With ``even`` ranges of equal width between the least and the greatest key are read instead, which
    needs no statistics; use it for databases without ``pg_stats`` and sampling.
    """
    asked = {"url": url, **(properties or {})}

    def ask(query: str) -> DataFrame:
        return spark.read.format("jdbc").options(query=query, **asked).load()

    key = key or find_key(spark, url, schema, table, properties)
    reader = spark.read.format("jdbc").options(**scan_options(url, schema, table, properties))
    if key is not None and even:
        bounds = ask(f"SELECT MIN({key}) AS low, MAX({key}) AS high FROM {schema}.{table}").first()
        if bounds is not None and bounds[0] is not None:
            reader = reader.options(**range_options(key, int(bounds[0]), int(bounds[1]), partitions))
    elif key is not None:
        known = key_distribution(ask, schema, table, key, partitions)
        parts = key_ranges.predicates(key, key_ranges.cuts(known, partitions) if known else [])
        given = {"fetchsize": str(FETCH_ROWS), **(properties or {})}
        return blank_to_null(spark.read.jdbc(url, f"{schema}.{table}", predicates=parts, properties=given))
    return blank_to_null(reader.load())


class ExportError(RuntimeError):
    """Some tables of an export failed (``failed``: table to error); the others are complete and are not written again."""

    def __init__(self, failed: dict[str, Exception]):
        super().__init__("; ".join(f"{name}: {error}" for name, error in sorted(failed.items())))
        self.failed = failed


def _manifest(out: str, run: str) -> str:
    return f"{out.rstrip('/')}/manifest_{run}.json"


def export_catalog(
    spark: SparkSession,
    url: str,
    schemas: Sequence[str],
    out: str,
    keys: Callable[[str, str], str | None] = lambda schema, table: None,
    properties: dict[str, str] | None = None,
    run: str = "export",
    at_once: int = TABLES_AT_ONCE,
) -> list[str]:
    """Writes every table of the schemas as CSV below ``<out>/<schema>`` and returns the paths.

    ``at_once`` tables are read at the same time, ``keys`` names the key by which to split the scan of a table; by default the
    catalog is asked. A complete table is noted in ``<out>/runs/<run>``, with its number of rows; when all are, the manifest of the
    run is published, which ``exported`` reads. If tables fail the others go on, an ExportError names those that failed, and no manifest
    appears; run again under the same name, only tables without a note are read. A run that has its manifest is not done again.
    """
    asked = {"url": url, **(properties or {})}
    catalog = spark.read.format("jdbc").options(query=catalog_query(schemas), **asked).load()
    tables = sorted((row[0], row[1]) for row in catalog.collect())
    files = Files(catalog.sparkSession)
    if files.exists(_manifest(out, run)):
        return [entry["path"] for entry in exported_rows(catalog.sparkSession, out, run)]
    notes = f"{out.rstrip('/')}/runs/{run}"
    have = {name for name, _ in files.listed(notes)}

    def note(schema: str, table: str) -> str:
        return f"{schema}.{table}.json"

    def export(schema: str, table: str) -> None:
        path = f"{out.rstrip('/')}/{schema}/{table}_{run}-{uuid.uuid4().hex[:8]}.csv"
        counted = Observation()
        df = read_lab_jdbc(spark, url, schema, table, keys(schema, table), properties=properties)
        write_table(df.observe(counted, F.count(F.lit(1)).alias("rows")), path)
        entry = {"schema": schema, "table": table, "path": path, "rows": counted.get["rows"]}
        files.publish(f"{notes}/{note(schema, table)}", json.dumps(entry, sort_keys=True))

    left = [t for t in tables if note(*t) not in have]
    failed: dict[str, Exception] = {}
    with ThreadPoolExecutor(max(1, at_once)) as pool:
        started = {t: pool.submit(inheritable_thread_target(catalog.sparkSession)(export), *t) for t in left}
        for (schema, table), job in started.items():
            if (error := job.exception()) is not None:
                if not isinstance(error, Exception):
                    raise error
                failed[f"{schema}.{table}"] = error
    if failed:
        raise ExportError(failed)
    entries = [json.loads(files.text(f"{notes}/{note(*t)}")) for t in tables]
    files.publish(_manifest(out, run), json.dumps({"run": run, "tables": entries}, indent=1, sort_keys=True))
    return [entry["path"] for entry in entries]


def exported_rows(spark: SparkSession, out: str, run: str = "export") -> list[dict]:
    """The entries of a published run: schema, table, path, rows. Without a manifest there is nothing to read yet."""
    files = Files(spark)
    if not files.exists(_manifest(out, run)):
        raise FileNotFoundError(f"the export {run} in {out} is not complete")
    return json.loads(files.text(_manifest(out, run)))["tables"]


def exported(spark: SparkSession, out: str, run: str = "export") -> dict[tuple[str, str], str]:
    """(schema, table) to path of the tables of a published run."""
    return {(e["schema"], e["table"]): e["path"] for e in exported_rows(spark, out, run)}
