"""SimHash groups against all pairs."""

import brute
import pytest
from conftest import plain
from pyspark.sql import functions as F

from assayline.llm import components, simhash


@pytest.mark.parametrize("table", ["small_docs", "odd_docs", "no_docs"])
def test_groups(spark, table, on_table, request):
    docs = request.getfixturevalue(table)
    found = on_table("op6_simhash", docs, spark)
    assert found.columns == ["doc_id", "fingerprint", "component_id"]
    assert brute.order(tuple(r) for r in found.collect()) == brute.groups(plain(docs))


def test_pairs_are_all_that_are_close(spark):
    marks = [0, 1, 3, 7, 1 << 63, (1 << 63) | 3, 0xFF00FF00FF00FF00, 0xFF00FF00FF00FF00 ^ (1 << 40) ^ (1 << 9), (1 << 64) - 1]
    marks += [marks[6] ^ (1 << i) for i in range(64)]
    signed = [m - (1 << 64) if m >> 63 else m for m in marks]
    df = spark.createDataFrame([(m,) for m in signed], "fingerprint long")
    found = {tuple(r) for r in simhash.close_pairs(df).collect()}
    want = {
        (min(a, b), max(a, b))
        for x, a in zip(marks, signed, strict=True)
        for y, b in zip(marks, signed, strict=True)
        if a != b and (x ^ y).bit_count() <= 2
    }
    assert found == want
    assert simhash.close_pairs(df).count() == len(want)
    assert {tuple(r) for r in simhash.close_pairs(df, max_bits=2, blocks=3).collect()} == want


def test_components_of_chains_stars_and_rings(spark):
    chain = [(i, i + 1) for i in range(100, 160)]
    star = [(1000, i) for i in range(1001, 1400)]
    ring = [(i, 200 + (i - 199) % 37) for i in range(200, 237)]
    links = spark.createDataFrame([*chain, *star, *ring, (5, 5)], "a long, b long")
    got = {r.node: r.component for r in components.components(links).collect()}
    assert {got[i] for i in range(101, 161)} == {100}
    assert {got[i] for i in range(1001, 1400)} == {1000}
    assert {got[i] for i in range(201, 237)} == {200}
    assert 5 not in got


def joins_of(df):
    """Joins of the plan that ran."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    return [name for name in ("BroadcastHashJoin", "SortMergeJoin", "ShuffledHashJoin", "BroadcastNestedLoopJoin") if name in plan]


def test_exploded_rows_are_not_broadcast(spark, monkeypatch):
    """Spark takes a table's exploded rows to be as few as the table's own: 28 keys a fingerprint, both ends of a link."""
    marks = spark.range(3000).select(F.xxhash64("id").alias("fingerprint"))
    assert joins_of(simhash.close_pairs(marks)) == ["SortMergeJoin"]
    links = spark.range(1, 3000).select(F.col("id").alias("a"), (F.col("id") % 50).alias("b"))
    for smaller in (True, False):
        assert joins_of(components._stars(links, smaller=smaller, few=False)) == ["SortMergeJoin"]
    monkeypatch.setattr(components, "FEW_LINKS", 0)
    got = {r.node: r.component for r in components.components(links).collect()}
    assert got == {i: i % 50 for i in range(50, 3000)}
