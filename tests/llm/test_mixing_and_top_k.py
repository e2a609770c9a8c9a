"""Mixing and exact search against SQL and plain versions."""

import os
import random
import sys

import brute
import pytest
from conftest import SMALL, plain
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import oracle  # noqa: E402

from assayline.llm import mixing, queries, top_k  # noqa: E402


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_matches_sql(spark, name):
    found = oracle.spark_result(queries.QUERIES[name](spark, SMALL))
    wanted = oracle.duckdb_result(oracle.connect(SMALL), queries.ORACLE_SQL[name])
    assert oracle.difference(found, wanted) is None
    assert found[1].total() > 0


def mixed(docs, spark, on_table):
    return on_table("op5_mixing", docs, spark).collect()


@pytest.mark.parametrize("table", ["small_docs", "odd_docs", "no_docs"])
def test_targets_and_words_taken(spark, table, on_table, request):
    docs = request.getfixturevalue(table)
    rows = mixed(docs, spark, on_table)
    assert brute.order((r.doc_id, r.size) for r in rows) == brute.order((i, len(brute.words(t))) for i, t in plain(docs))
    source = {}
    for r in mixing.mix(docs).collect():
        s = source.setdefault(r.source, {"size": 0, "taken": 0, "target": r.target, "largest": 0})
        s["size"] += r.size
        s["taken"] += r.taken
        s["largest"] = max(s["largest"], r.size)
        assert r.taken in (0, r.size, 2 * r.size) and r.source_size >= r.size
    want = brute.targets({k: s["size"] for k, s in source.items()})
    for k, s in source.items():
        assert s["target"] == pytest.approx(want[k])
        assert abs(s["taken"] - s["target"]) <= s["largest"] / 2 + 1e-6


def test_reruns_and_layouts_agree(spark, odd_docs, on_table):
    one = brute.order(map(tuple, mixed(odd_docs, spark, on_table)))
    assert brute.order(map(tuple, mixed(odd_docs.repartition(7), spark, on_table))) == one
    for ranges in (1, 16):
        found = mixing.mix(odd_docs, ranges=ranges).select("doc_id", "size", "source_size", "target", "taken", "copies")
        assert brute.order(map(tuple, found.collect())) == one


def test_the_mix_itself(spark, small_docs, odd_docs):
    for docs in (small_docs, odd_docs):
        copies = {}
        for r in mixing.mix(docs).collect():
            copies[r.doc_id] = copies.get(r.doc_id, 0) + r.copies
        got = {r.doc_id: r.n for r in mixing.take(docs).groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
        assert got == {k: n for k, n in copies.items() if n}
        assert mixing.take(docs).columns == docs.columns


@pytest.mark.parametrize("ids", ["one", "none", "each"])
def test_alike_at_the_cut(spark, ids):
    """Rows that tie with the last one taken: the mix has the words that are counted for it, not those of all of them."""
    ident = {"one": F.lit(7), "none": F.lit(None), "each": F.col("id")}[ids].cast("long")
    rows = spark.range(60).select(
        ident.alias("doc_id"),
        F.concat(F.repeat(F.lit("word "), 69), F.when(F.col("id") % 3 == 0, F.col("id").cast("string")).otherwise("last")).alias("text"),
        F.when(F.col("id") < 25, "a").otherwise("b").alias("source"),
        F.lit("x").alias("row"),
        F.lit("y").alias("copies"),
        F.lit("z").alias("epochs"),
    )
    for seed in "abcd":
        mixed = mixing.mix(rows, weights=(2, 3), seed=seed)
        counted = {r.source: (r.n, r.target) for r in mixed.groupBy("source").agg(F.sum("taken").alias("n"), F.max("target").alias("target")).collect()}
        got = mixing.take(rows, weights=(2, 3), seed=seed)
        assert got.columns == rows.columns
        words = {r.source: r.n for r in got.groupBy("source").agg((F.count("*") * 70).alias("n")).collect()}
        assert words == {s: n for s, (n, _) in counted.items()}
        assert all(abs(n - target) <= 35 for n, target in counted.values())
        most = got.groupBy("source", "text").count().join(rows.groupBy("source", "text").agg(F.count("*").alias("rows")), ["source", "text"])
        assert most.filter(F.col("count") > 2 * F.col("rows")).isEmpty()
        assert brute.order(map(tuple, got.collect())) == brute.order(map(tuple, mixing.take(rows.repartition(5), weights=(2, 3), seed=seed).collect()))


def best(rows, k):
    """Plain top-k of (id, vector) rows."""
    out = []
    for i, v in sorted(rows):
        if i % 50 == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j) for j, w in rows if j != i)[:k]
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(scores)]
    return sorted(out)


def whole(v):
    return [int(x * 256 // 1) for x in v]


@pytest.mark.parametrize("tree_rows, query_rows", [(8192, 2048), (40, 2)])
def test_top_k_of_odd_vectors(spark, on_table, monkeypatch, tree_rows, query_rows):
    monkeypatch.setattr(top_k, "PAGE", 8)
    random.seed(2)
    vectors = [(i, [random.choice([-1.0, -0.3, 0.0, 0.25, 0.7]) for _ in range(5)]) for i in range(300)]
    vectors += [(i, [0.5, 0.5, 0.0, 0.0, 0.1]) for i in range(300, 420)] + [(-50, [0.0] * 5)]
    odd = [(1000, None), (1050, [1.0, None, 0.0, 0.0, 0.0]), (1100, [float("nan")] * 5), (1150, [float("inf")] * 5), (None, [1.0] * 5)]
    df = spark.createDataFrame([(i, v, "x") for i, v in vectors + odd], "vec_id long, embedding array<float>, id string")
    vectors = [(r.vec_id, whole(r.embedding)) for r in df.collect() if r.vec_id is not None and r.vec_id < 1000]
    found = top_k.top_k(df, F.col("id") % 50 == 0, k=5, tree_rows=tree_rows, query_rows=query_rows)
    assert sorted(tuple(r) for r in found.collect()) == best(vectors, 5)
    assert on_table("op8_top_k", df.filter("false"), spark).count() == 0
    few = df.filter("vec_id in (0, 1, 50)")
    assert sorted(tuple(r) for r in on_table("op8_top_k", few, spark).collect()) == best(
        [v for v in vectors if v[0] in (0, 1, 50)], 5
    )
    assert on_table("op8_top_k", df.union(df), spark).count() == len(best(vectors, 5))


def test_search_skips_pages(spark):
    """Far clusters are not looked at."""
    import numpy as np

    random.seed(4)
    centres = [[random.randint(-2000, 2000) for _ in range(8)] for _ in range(40)]
    vectors = np.unique(np.array([[c + random.randint(-5, 5) for c in random.choice(centres)] for _ in range(4000)]), axis=0)
    length2 = float((vectors**2).sum(1).max())
    tree = top_k.Tree(vectors, [np.array([i]) for i in range(len(vectors))], length2)
    seen = []

    class Watched(list):
        def __getitem__(self, i):
            seen.append(i)
            return super().__getitem__(i)

    pages = len(tree.pages)
    tree.pages = Watched(tree.pages)
    for i in range(0, len(vectors), 400):
        got = tree.search(vectors[i], 5, i)
        scores = vectors @ vectors[i]
        want = sorted((-int(s), j) for j, s in enumerate(scores) if j != i)[:5]
        assert got == want
    assert len(seen) < 0.7 * pages * len(range(0, len(vectors), 400))
