"""Shape of the physical plans: what must not come back as the operators change."""

import io
import re
from contextlib import redirect_stdout

import pytest
from pyspark.sql import functions as F

from assayline.plans.registry import QUERIES

MEDIUM = "/root/testdata/sf0.01"
WRITERS = {"csv_round_trip", "read_lab_csv", "read_lab_folder", "write_table_csv", "site_error_files"}
READERS = sorted(set(QUERIES) - WRITERS)


def plan(df) -> str:
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


@pytest.mark.parametrize("name", READERS)
def test_plan_has_no_bottleneck(spark, name):
    text = plan(QUERIES[name](spark, MEDIUM))
    # No pairing of everything with everything, and no Python in the row path.
    for banned in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "Arrow", "InPandas"):
        assert banned not in text
    # No window over one partition.
    for node in re.findall(r"^\(\d+\) Window.*?^Arguments: (.*?)$", text, flags=re.S | re.M):
        assert not re.search(r"^\[[^\]]*\], \[\],", node)


@pytest.mark.parametrize(
    "name, columns",
    [
        ("total_plates_my", {"l_orderkey", "l_linenumber"}),
        ("kit_error_totals", {"l_orderkey", "l_linenumber", "l_discount"}),
    ],
)
def test_only_needed_columns_are_read(spark, name, columns):
    text = plan(QUERIES[name](spark, MEDIUM))
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", text)
    read = [{c.split(":")[0] for c in s.split(",")} for s in schemas]
    widest = max((r for r in read if "l_orderkey" in r), key=len)
    assert widest <= columns


def test_date_filter_reaches_the_files(spark):
    text = plan(QUERIES["tests_last_year"](spark, MEDIUM))
    pushed = [f for f in re.findall(r"PushedFilters: \[([^\n]*)\]", text) if "o_orderdate" in f]
    assert pushed and "GreaterThanOrEqual(o_orderdate,2000-08-02T00:00" in pushed[0]


@pytest.mark.parametrize("name", ["percent_plates_my_country", "error_rate_site", "monthly_code_rate", "test_perc_table"])
def test_fact_is_scanned_once(spark, name):
    fact = "lineitem" if "plates" in name else "orders"
    tree = plan(QUERIES[name](spark, MEDIUM))
    measures = re.findall(rf"Location: InMemoryFileIndex \[[^\]]*{fact}.parquet\].*?ReadSchema: struct<([^>]*)>", tree, flags=re.S)
    wide = [m for m in measures if m.count(":") > 1]
    assert len(wide) == 1


def test_large_tables_move_the_fact_once(spark, no_broadcast):
    """With a large instrument table one shuffled join by instrument, and no job while the plan is built."""
    from assayline.operators.cleaning import enrich_activity
    from assayline.plans.lab_views import LabViews

    v = LabViews(spark, MEDIUM)
    fact, master = v.test_activity_roche(), v.instrument_master()
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("plan only", "")
    tree = plan(enrich_activity(fact, master)).split("\n\n")[0]
    assert list(tracker.getJobIdsForGroup("plan only")) == []
    assert tree.count("SortMergeJoin") == 1 and "Broadcast" not in tree
    assert tree.count("Scan parquet") == 2


@pytest.mark.parametrize("name", ["country_error_series", "error_country_series", "error_share_all"])
def test_series_read_the_fact_once(spark, name):
    """In the plan that ran: the tally's exchange is made once and reused."""
    df = QUERIES[name](spark, MEDIUM)
    df.collect()
    ran = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    scans = re.findall(r"FileScan parquet \[[^\]]*o_orderkey[^\]]*\]", ran)
    assert len(scans) == 1


@pytest.mark.parametrize("name", ["site_error_series_filled", "error_country_series_short"])
def test_series_made_from_a_stored_tally(spark, name):
    assert "orders.parquet" not in plan(QUERIES[name](spark, MEDIUM))


def test_share_of_all_tests_reads_the_fact_once(spark):
    tree = plan(QUERIES["error_share_all"](spark, MEDIUM))
    assert len(re.findall(r"Location: InMemoryFileIndex \[[^\]]*orders.parquet\]", tree)) == 1


def test_nearest_lab_does_not_join_on_a_constant(spark):
    """A join brings a row per site and node it has come to, not one per site and lab or box."""
    import random

    from assayline.operators import site_match

    random.seed(1)
    place = lambda: (random.uniform(-90, 90), random.uniform(-180, 180))
    labs = spark.createDataFrame(
        [(i, f"l{i}", "x", *place()) for i in range(5000)],
        "id long, name string, countryname string, latitude double, longitude double",
    )
    sites = spark.createDataFrame(
        [(i, *place()) for i in range(300)], "supplier_site_id long, candidate_lat double, candidate_lon double"
    )
    matched = site_match.nearest_lab(sites, labs)
    rows = {r.supplier_site_id: r for r in matched.collect()}
    points = [(r.latitude, r.longitude, r.id) for r in labs.collect()]
    for r in sites.limit(40).collect():
        best = min(points, key=lambda p: _metres(r.candidate_lat, r.candidate_lon, p[0], p[1]))
        assert rows[r.supplier_site_id].id == best[2]
    found = matched._jdf.queryExecution()
    found.toRdd().count()
    assert sum(_joined(found.executedPlan())) < 40 * 300


def test_nearest_lab_where_labs_are_dense(spark):
    """100,000 labs in one city and 5,000 elsewhere: boxes are small in the city, and sites there meet no more of them."""
    from assayline.operators import site_match

    city = spark.range(100_000).selectExpr("id", "-1.3 + (id % 317) / 2000.0 latitude", "36.8 + (id div 317) / 2000.0 longitude")
    others = spark.range(100_000, 105_000).selectExpr("id", "(id * 7919 % 17000) / 100.0 - 85 latitude", "(id * 104729 % 36000) / 100.0 - 180 longitude")
    labs = city.union(others).selectExpr(
        "id", "concat('l', id) name", "'x' countryname", "cast(latitude as double) latitude", "cast(longitude as double) longitude"
    )
    sites = spark.range(400).selectExpr(
        "id supplier_site_id",
        "cast(case when id % 2 = 0 then -1.3 + (id * 31 % 400) / 2531.0 else (id * 7907 % 16000) / 100.0 - 80 end as double) candidate_lat",
        "cast(case when id % 2 = 0 then 36.8 + (id * 17 % 400) / 2531.0 else (id * 104723 % 35000) / 100.0 - 175 end as double) candidate_lon",
    )
    matched = site_match.nearest_lab(sites, labs)
    rows = {r.supplier_site_id: r for r in matched.collect()}
    points = [(r.latitude, r.longitude, r.id) for r in labs.collect()]
    for r in sites.filter("supplier_site_id % 40 < 2").collect():
        nearest = min(_metres(r.candidate_lat, r.candidate_lon, p[0], p[1]) for p in points)
        assert abs(rows[r.supplier_site_id].distance_nearest_datim_loc_km - nearest / 1000) < 0.0051
    found = matched._jdf.queryExecution()
    found.toRdd().count()
    assert sum(_joined(found.executedPlan())) < 100 * 400
    leaf = site_match._leaves(site_match._on_sphere(labs.withColumn("lab", F.struct("id", "name")), "latitude", "longitude"))
    assert leaf.agg(F.max(F.size("inside"))).first()[0] <= site_match.LEAF


def _metres(lat, lon, lat2, lon2):
    from math import asin, cos, radians, sin, sqrt

    a, b, c, d = map(radians, (lat, lon, lat2, lon2))
    return 2 * 6378137.0 * asin(min(1.0, sqrt(sin((c - a) / 2) ** 2 + cos(a) * cos(c) * sin((d - b) / 2) ** 2)))


def _joined(node):
    """Rows out of each join of an executed plan."""
    name, rows = node.nodeName(), []
    if "Join" in name and node.metrics().get("numOutputRows").isDefined():
        rows.append(node.metrics().get("numOutputRows").get().value())
    below = [node.children().apply(i) for i in range(node.children().size())]
    if name.startswith("AdaptiveSparkPlan"):
        below.append(node.executedPlan())
    if "QueryStage" in name:
        below.append(node.plan())
    return rows + [r for b in below for r in _joined(b)]
