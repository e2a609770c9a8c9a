"""Database scans and exports against a stand-in for the reader (there is no database to scan)."""

import functools
import json
import pathlib
import threading

import pytest

from assayline.sources import jdbc, key_ranges
from assayline.sources.key_ranges import Distribution


def test_database_options():
    scan = jdbc.scan_options("jdbc:x", "lab", "test", {"user": "u"})
    assert scan == {"url": "jdbc:x", "dbtable": "lab.test", "fetchsize": "10000", "user": "u"}
    assert jdbc.range_options("test_id", 5, 104, 32) == {
        "partitionColumn": "test_id",
        "lowerBound": "5",
        "upperBound": "105",
        "numPartitions": "32",
    }
    assert jdbc.range_options("test_id", 5, 6, 32)["numPartitions"] == "2"
    query = jdbc.catalog_query(["lab", "o'x"])
    assert query.endswith("WHERE table_schema IN ('lab', 'o''x')")


class StandInDatabase:
    """Answers the scans and queries that the source sends, and notes their options."""

    def __init__(self, tables, catalog, keys, statistics=None):
        self.tables, self.catalog, self.keys, self.statistics, self.asked = tables, catalog, keys, statistics, []
        self.broken, self.running, self.most, self.lock = set(), 0, 0, threading.Lock()

    @property
    def read(self):
        return _StandInReader(self)

    def answer(self, options):
        with self.lock:
            self.asked.append(options)
        query = options.get("query", "")
        if "information_schema.columns" in query:
            return self.keys
        if "pg_stats" in query:
            return self.statistics
        if "pg_class" in query:
            session = self.keys.sparkSession
            return session.createDataFrame([(4.0 * jdbc.SAMPLE_ROWS,)], "estimate double")
        if "TABLESAMPLE" in query:
            column = query.split(" ")[1]
            return self.tables[query.split(" ")[5]].selectExpr(f"{column} as sampled").filter("sampled is not null")
        if not query:
            if options["dbtable"] in self.broken:
                raise OSError(f"{options['dbtable']} is gone")
            return self.tables[options["dbtable"]]
        if "information_schema" in query:
            return self.catalog
        table = self.tables[query.rsplit(" ", 1)[1]]
        return table.selectExpr("min(id) low", "max(id) high")


class _StandInReader:
    def __init__(self, database):
        self.database, self.chosen = database, {}

    def format(self, name):
        assert name == "jdbc"
        return self

    def options(self, **more):
        self.chosen.update(more)
        return self

    def load(self):
        return self.database.answer(self.chosen)

    def jdbc(self, url, table, predicates, properties):
        """Rows by predicate; the predicates are Spark SQL as well."""
        scanned = self.database.answer({"dbtable": table, "predicates": predicates, **properties})
        return functools.reduce(lambda a, b: a.union(b), [scanned.filter(p) for p in predicates])


KEYS = "column_name string, place int, ordinal_position int"
STATISTICS = "histogram_bounds string, most_common_vals string, most_common_freqs string, null_frac double"


def test_even_ranges_and_blanks_are_missing(rows):
    tables = {"lab.site": rows("id bigint, city string", (3, ""), (40, "x")), "lab.empty": rows("id bigint, city string")}
    database = StandInDatabase(tables, None, rows(KEYS))
    got = jdbc.read_lab_jdbc(database, "jdbc:x", "lab", "site", "id", 8, even=True)
    assert [tuple(r) for r in got.collect()] == [(3, None), (40, "x")]
    scan = database.asked[-1]
    assert (scan["partitionColumn"], scan["lowerBound"], scan["upperBound"], scan["numPartitions"]) == ("id", "3", "41", "8")
    assert jdbc.read_lab_jdbc(database, "jdbc:x", "lab", "empty", "id", even=True).count() == 0
    assert "partitionColumn" not in database.asked[-1]


def held(values, parts):
    """How many of the values each predicate holds; Python's own evaluation of the conditions."""

    def holds(predicate, key):
        if "NULL" in predicate:
            return (key is None) != ("NOT" in predicate)
        return key is not None and all(
            {"<": key < int(c[2]), ">=": key >= int(c[2])}[c[1]] for c in (p.split(" ") for p in predicate.split(" AND "))
        )

    counts = [sum(holds(p, v) for v in values) for p in parts]
    assert all(sum(holds(p, v) for p in parts) == 1 for v in values)
    return counts


def histogram(values, buckets=100, common=10):
    """What a database would keep of a column: frequent values apart, equal shares of the others."""
    present = sorted(v for v in values if v is not None)
    often = [v for v in sorted(set(present), key=present.count, reverse=True)[:common] if present.count(v) > len(present) / 50]
    others = [v for v in present if v not in often]
    bounds = tuple(others[(len(others) - 1) * i // buckets] for i in range(buckets + 1)) if len(others) > 1 else ()
    return Distribution(bounds, tuple((v, present.count(v) / len(values)) for v in often), 1 - len(present) / len(values))


LEAST, GREATEST = -(2**63), 2**63 - 1
SPREADS = {
    "even": list(range(5000)),
    "crowded": [i**3 for i in range(3000)] + [10**12 + i for i in range(2000)],
    "negative": [-(i * i) for i in range(4000)],
    "extreme": [LEAST, LEAST + 1, *range(-1000, 1000), GREATEST - 1, GREATEST],
    "hot": [7] * 1700 + list(range(100, 3500)),
    "hot at the ends": [LEAST] * 700 + list(range(1000)) + [GREATEST] * 700,
    "few": [1, 1, 1, 2, 2, 3, None],
    "missing": [None] * 1500 + list(range(3000)),
}


@pytest.mark.parametrize("spread", SPREADS)
def test_ranges_hold_like_numbers_of_rows(spread):
    values = SPREADS[spread]
    known = histogram(values)
    parts = key_ranges.predicates("k", key_ranges.cuts(known, 16))
    counts = held([*values, LEAST, GREATEST, None], parts)
    assert len(parts) <= 16 + 2 * len(known.common) + 1
    hottest = max(values.count(v) for v in {*[v for v, _ in known.common], None})
    assert max(counts) <= max(hottest, 2.2 * len(values) / 16) + 3


def test_ranges_without_knowledge():
    assert key_ranges.cuts(Distribution(), 8) == []
    assert key_ranges.cuts(Distribution((5, 5)), 8) == [6]  # one value is one range
    assert held([None, 5, LEAST], key_ranges.predicates("k", [])) == [2, 1]
    assert key_ranges.from_catalog(None, None, None, None) is None
    known = key_ranges.from_catalog("{-5,0,10}", "{3,-4}", "{0.25,0.125}", 0.5)
    assert known == Distribution((-5, 0, 10), ((3, 0.25), (-4, 0.125)), 0.5)
    assert sum(share for _, _, share in known.steps()) == pytest.approx(0.5)


@pytest.mark.parametrize("kept", ["histogram", "sample"])
def test_scans_are_split_by_ranges(rows, kept):
    table = rows("name string, id bigint, other int", ("", None, 1), *[(f"n{i}", i * i - 40, i) for i in range(60)])
    keys = rows(KEYS, ("other", 1, 3), ("id", 0, 2))
    row = ("{-40,24,216,860,1896,3441}", None, None, 0.02) if kept == "histogram" else (None, None, None, 0.0)
    database = StandInDatabase({"lab.site": table}, None, keys, rows(STATISTICS, row))
    got = jdbc.read_lab_jdbc(database, "jdbc:x", "lab", "site", partitions=5, properties={"user": "u"})
    assert sorted(r.id for r in got.collect() if r.id is not None) == [i * i - 40 for i in range(60)]
    assert [(r.name, r.other) for r in got.collect() if r.id is None] == [(None, 1)]
    scan = database.asked[-1]
    assert scan["predicates"][-1] == "id IS NULL" and len(scan["predicates"]) == 6
    assert max(table.filter(p).count() for p in scan["predicates"]) <= 16
    assert (scan["user"], scan["fetchsize"]) == ("u", "10000")
    sampled = [a["query"] for a in database.asked if "TABLESAMPLE" in a.get("query", "")]
    assert sampled == ([] if kept == "histogram" else ["SELECT id AS sampled FROM lab.site TABLESAMPLE SYSTEM (25.000000) WHERE id IS NOT NULL"])


def test_tables_without_keys(rows):
    table = rows("name string, id bigint", ("a", None), ("b", None))
    none = StandInDatabase({"lab.site": table}, None, rows(KEYS))
    assert jdbc.read_lab_jdbc(none, "jdbc:x", "lab", "site").count() == 2
    assert "predicates" not in none.asked[-1]
    empty = StandInDatabase({"lab.site": table}, None, rows(KEYS, ("id", 0, 1)), rows(STATISTICS))
    assert jdbc.read_lab_jdbc(empty, "jdbc:x", "lab", "site").count() == 2
    assert empty.asked[-1]["predicates"] == ["id IS NOT NULL", "id IS NULL"]
    assert "c.table_name = 'o''x'" in jdbc.key_query("lab", "o'x")
    assert "tablename = 'o''x'" in jdbc.statistics_query("lab", "o'x", "id")


def some_tables(rows, n=6):
    tables = {f"lab.t{i}": rows("id bigint, name string", *[(j, f"x{j}") for j in range(i + 1)]) for i in range(n)}
    catalog = rows("table_schema string, table_name string", *[tuple(t.split(".")) for t in tables])
    return StandInDatabase(tables, catalog, rows(KEYS, ("id", 0, 1)), rows(STATISTICS, ("{0,2,4}", None, None, 0.0)))


def test_exported_catalog_keeps_schemas_apart(spark, rows, tmp_path):
    tables = {"lab.site": rows("id bigint", (1,)), "stage.site": rows("id bigint", (2,))}
    catalog = rows("table_schema string, table_name string", ("stage", "site"), ("lab", "site"))
    database = StandInDatabase(tables, catalog, rows(KEYS, ("id", 1, 1)), rows(STATISTICS, ("{0,5}", None, None, 0.0)))
    paths = jdbc.export_catalog(database, "jdbc:x", ["lab", "stage"], str(tmp_path), run="one")
    assert [pathlib.PurePath(p).parent.name for p in paths] == ["lab", "stage"]
    assert all(pathlib.PurePath(p).name.startswith("site_one-") for p in paths)
    assert [spark.read.option("header", True).csv(p).first()["id"] for p in paths] == ["1", "2"]
    assert list(jdbc.exported(spark, str(tmp_path), "one").values()) == paths
    again = len(database.asked)
    assert jdbc.export_catalog(database, "jdbc:x", ["lab", "stage"], str(tmp_path), run="one") == paths
    assert len(database.asked) == again + 1  # the catalog only
    other = jdbc.export_catalog(database, "jdbc:x", ["lab", "stage"], str(tmp_path), run="two")
    assert not set(other) & set(paths) and jdbc.exported(spark, str(tmp_path), "one")[("lab", "site")] == paths[0]


def test_an_export_goes_on_where_it_failed(spark, rows, tmp_path):
    out, database = str(tmp_path), some_tables(rows)
    database.broken = {"lab.t2", "lab.t4"}
    with pytest.raises(jdbc.ExportError, match="lab.t2 is gone") as failure:
        jdbc.export_catalog(database, "jdbc:x", ["lab"], out)
    assert set(failure.value.failed) == database.broken
    with pytest.raises(FileNotFoundError, match="not complete"):
        jdbc.exported(spark, out)
    whole = {p.name for p in (tmp_path / "lab").iterdir() if not p.name.startswith(".")}
    assert len(whole) == 4
    database.broken, database.asked = {"lab.t4"}, []
    with pytest.raises(jdbc.ExportError, match="lab.t4"):
        jdbc.export_catalog(database, "jdbc:x", ["lab"], out)
    assert {a["dbtable"] for a in database.asked if "dbtable" in a} == {"lab.t2", "lab.t4"}
    database.broken, database.asked = set(), []
    paths = jdbc.export_catalog(database, "jdbc:x", ["lab"], out)
    assert {a["dbtable"] for a in database.asked if "dbtable" in a} == {"lab.t4"}
    assert whole < {pathlib.PurePath(p).name for p in paths}
    entries = jdbc.exported_rows(spark, out)
    assert [(e["table"], e["rows"]) for e in entries] == [(f"t{i}", i + 1) for i in range(6)]
    for e in entries:
        assert spark.read.option("header", True).csv(e["path"]).count() == e["rows"]
    assert json.loads((tmp_path / "manifest_export.json").read_text())["run"] == "export"


def test_tables_at_once_are_bounded(spark, rows, tmp_path, monkeypatch):
    database = some_tables(rows)
    meet = threading.Barrier(2, timeout=60)
    write = jdbc.write_table

    def counted(df, path):
        with database.lock:
            database.running += 1
            database.most = max(database.most, database.running)
        meet.wait()  # passes only if two tables are under way at the same time
        write(df, path)
        with database.lock:
            database.running -= 1

    monkeypatch.setattr(jdbc, "write_table", counted)
    assert len(jdbc.export_catalog(database, "jdbc:x", ["lab"], str(tmp_path), at_once=2)) == 6
    assert database.most == 2
