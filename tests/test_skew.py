"""A third of all rows under one key: results stay whole, and the hot key is split or combined early."""

import pytest
from pyspark.sql import functions as F

from assayline.operators import code_rates, plates, site_match
from assayline.operators.cleaning import enrich_activity

ROWS = 60_000
HOT = 7


@pytest.fixture
def split_early(spark):
    """Let adaptive execution see skew at test size."""
    settings = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "16KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16KB",
        "spark.sql.shuffle.partitions": "16",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.fixture
def activity(spark):
    hot = F.col("id") % 3 == 0
    return spark.range(0, ROWS, 1, 8).select(
        F.when(hot, HOT).otherwise(F.col("id") % 400).cast("bigint").alias("instrument_id"),
        F.when(hot, F.lit("d|t|HOT|F|1")).otherwise(F.concat(F.lit("d|t|B"), (F.col("id") % 900).cast("string"), F.lit("|F|2"))).alias(
            "test_record_id"
        ),
        F.when(F.col("id") % 2 == 0, "A").alias("country_code"),
        F.expr("date_add(date'2021-03-05', cast(id % 2 as int))").alias("test_date"),
        F.lit("v").alias("test_type_id"),
        F.when(F.col("id") % 5 == 0, 4442.0).alias("error_type_id"),
        (F.col("id") % 2).alias("error_count"),
        F.when(F.col("id") % 4 == 0, "x,y").when(hot, "x").alias("error_code_list"),
        F.col("id").alias("record_key"),
    )


@pytest.fixture
def master(spark):
    return spark.range(400).select(
        F.col("id").alias("instrument_id"), F.lit("cobas 4800").alias("instrument_model"), (F.col("id") % 50).alias("supplier_site_id")
    )


def final_plan(df) -> str:
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_hot_instrument_is_split(activity, master, no_broadcast, split_early):
    enriched = enrich_activity(activity, master)
    assert "skew=true" in final_plan(enriched)
    assert enriched.count() == ROWS
    assert enriched.filter("instrument_model is null").count() == 0


def test_hot_plate_is_combined_before_the_shuffle(spark, activity, master):
    types = spark.sql("select 'v' test_type_id, 'VL' test_type_psm")
    site = spark.range(50).select(F.col("id").alias("supplier_site_id"), F.col("id").cast("string").alias("supplier_site_name"))
    share = plates.percent_plates(activity, master, types, site, "my")
    tree = final_plan(share)
    first_shuffle = tree.rindex("plate_id", 0, tree.rindex("Range"))
    assert "HashAggregate(keys=" in tree[tree.rindex("Exchange hashpartitioning", 0, first_shuffle) :]
    # All in one month, so the plate keys are the other three.
    keys = ["country_code", "instrument_id", "test_record_id"]
    assert share.first()["plates"] == activity.select(*keys).distinct().count()


def test_hot_place_is_split(spark, no_broadcast, split_early):
    sites = spark.range(0, ROWS, 1, 8).select(
        F.col("id").alias("supplier_site_id"),
        F.when(F.col("id") % 3 == 0, -1.25).otherwise(F.col("id") % 50).alias("candidate_lat"),
        F.when(F.col("id") % 3 == 0, 36.5).otherwise(F.col("id") % 70).cast("double").alias("candidate_lon"),
    )
    labs = spark.range(40).selectExpr("id", "concat('l', id) name", "'x' countryname", "cast(id as double) latitude", "cast(id as double) longitude")
    matched = site_match.nearest_lab(sites, labs)
    assert "skew=true" in final_plan(matched)
    assert matched.count() == ROWS
    assert matched.filter("id is null").count() == 0


def test_hot_instrument_counts(activity, master, no_broadcast, split_early):
    top = code_rates.top_codes(activity, master, ["country_code", "instrument_model"], 2)
    assert top.agg(F.sum("n")).first()[0] == activity.select(F.explode(F.split("error_code_list", ","))).count()


def test_hot_missing_key_is_split(spark, activity, no_broadcast, split_early):
    from assayline.operators.lookups import attach

    fact = activity.withColumn("instrument_id", F.when(F.col("instrument_id") != HOT, F.col("instrument_id")))
    names = spark.range(401).select(F.when(F.col("id") < 400, F.col("id")).alias("instrument_id"), F.concat(F.lit("n"), "id").alias("name"))
    named = attach(fact, names, "instrument_id")
    assert "skew=true" in final_plan(named)
    assert named.count() == ROWS
    assert named.filter("instrument_id is null and name = 'n400'").count() == fact.filter("instrument_id is null").count() > ROWS / 3


def test_many_places_and_labs_in_one_cell(spark, no_broadcast, split_early):
    """Thousands of places and labs within 400 m."""
    sites = spark.range(3000).selectExpr(
        "id supplier_site_id", "1.0 + id % 1000 / 1e6 candidate_lat", "cast(36.0 + id div 1000 / 1e6 as double) candidate_lon"
    )
    labs = spark.range(2000).selectExpr(
        "id", "concat('l', id) name", "'x' countryname", "1.0 + id / 1e6 latitude", "36.0 + id % 3 / 1e6 longitude"
    )
    sites = sites.withColumn("candidate_lat", F.col("candidate_lat").cast("double"))
    labs = labs.withColumn("latitude", F.col("latitude").cast("double")).withColumn("longitude", F.col("longitude").cast("double"))
    matched = site_match.nearest_lab(sites, labs)
    assert matched.count() == 3000
    assert matched.filter("id is null or distance_nearest_datim_loc_km > 0.01").count() == 0
