"""Sketches against sets of shingles."""

import brute
import pytest
from conftest import plain
from pyspark.sql import functions as F

from assayline.llm import fingerprints


def edits(docs):
    """n_chars, hash of the edited text, by id, for ids that occur once or with one text."""
    ordered = sorted(docs, key=lambda d: (d[0] is None, -(d[0] or 0), d[1]))
    out = []
    for i, (ident, text) in enumerate(ordered):
        following = ordered[(i + 1) % len(ordered)][1]
        moved = len(text) // 2
        edited = text[: len(text) - moved] + following[:moved]
        out.append((ident, len(text), brute.sha(edited)))
    return brute.order(out)


@pytest.mark.parametrize("table", ["small_docs", "odd_docs", "no_docs"])
def test_edits(spark, table, on_table, request):
    docs = request.getfixturevalue(table)
    found = on_table("op2_fingerprints", docs, spark)
    rows = found.collect()
    assert brute.order((r.doc_id, r.n_chars, r.edited_sha256) for r in rows) == edits(plain(docs))
    assert all(0 <= x <= 1 for r in rows for x in (r.near_edited, r.near_next))


@pytest.mark.parametrize("ranges", [1, 2, 7, 50])
def test_any_number_of_ranges(spark, odd_docs, ranges):
    rows = fingerprints.fingerprint_edits(odd_docs, ranges=ranges).collect()
    assert brute.order((r.doc_id, r.n_chars, brute.sha(r.edited)) for r in rows) == edits(plain(odd_docs))


def test_equal_texts_have_equal_sketches_and_estimates_are_near(spark, small_docs, on_table):
    texts = dict(plain(small_docs))
    rows = {r.doc_id: r for r in fingerprints.fingerprint_edits(small_docs).collect()}
    by_text = {}
    for i, r in rows.items():
        assert by_text.setdefault(texts[i], r.sketch) == r.sketch
        if r.edited == texts[i]:
            assert r.near_edited == 1

    def shingles(text):
        own = text.lower().split()
        return {tuple(own[i : i + 5]) for i in range(len(own) - 4)} or {tuple(own)}

    gaps = []
    for i, r in rows.items():
        one, other = shingles(texts[i]), shingles(r.edited)
        gaps.append(abs(r.near_edited - len(one & other) / min(len(one), len(other))))
    assert sum(gaps) / len(gaps) < 0.08
    assert sum(r.near_next for r in rows.values()) / len(rows) < 0.1


def test_sketch_of_two_texts_is_the_union(spark):
    docs = [("one two three four five six seven eight nine ten " * 1, "alpha beta gamma delta epsilon zeta eta theta iota " * 1)]
    df = spark.createDataFrame([(a, b, a + "| " * 0 + b) for a, b in docs], "a string, b string, c string")
    for name in "ab":
        df = fingerprints.with_sketch(df, name, f"s{name}", one_in=2)
    row = df.select("sa", "sb", fingerprints.merged(F.col("sa"), F.col("sb"), one_in=2).alias("m")).first()
    assert row.m == sorted({*row.sa, *row.sb}) and all(h < (1 << 63) // 2 for h in row.m)


def test_small_texts_in_large_ones(spark):
    words = [f"w{i}" for i in range(4000)]
    df = spark.createDataFrame([(" ".join(words), " ".join(words[1000:1400]), " ".join(words[::-1]))], "a string, b string, c string")
    for name in "abc":
        df = fingerprints.with_sketch(df, name, f"s{name}")
    row = df.select(
        fingerprints.containment(F.col("sb"), F.col("sa")).alias("inside"),
        fingerprints.containment(F.col("sa"), F.col("sb")).alias("share"),
        fingerprints.likeness(F.col("sa"), F.col("sc")).alias("none"),
    ).first()
    assert row.inside == 1 and 0.05 < row.share < 0.2 and row.none == 0


def test_no_python_in_the_plan(spark, small_docs, on_table):
    for name in ("op2_fingerprints", "op5_mixing"):
        plan = on_table(name, small_docs, spark)._jdf.queryExecution().toString()
        assert not any(x in plan for x in ("Python", "Pandas", "InArrow"))
