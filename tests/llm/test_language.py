"""Language identification by held-out accuracy, language-model scores against counting."""

import brute
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from conftest import plain
from pyspark.sql import functions as F

from assayline.llm import elias_fano, language_id, lm_scoring


def test_held_out_accuracy(spark, small_docs, on_table):
    found = {r.doc_id: r for r in on_table("op9_language_id", small_docs, spark).collect()}
    docs = small_docs.collect()
    assert len(found) == len(docs)
    assert all(found[r.doc_id].held_out == brute.in_fold(r.doc_id, 5, 0) for r in docs)
    held = [r for r in docs if found[r.doc_id].held_out]
    assert len(held) > 20
    assert sum(found[r.doc_id].lang_pred == r.lang for r in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 for r in found.values())


def test_only_texts_and_languages_of_the_other_folds_are_learned(spark, small_docs):
    one = language_id.identify(small_docs)
    held = language_id.held_out("doc_id", 5, 0)
    lied = small_docs.withColumn("lang", F.when(held, F.lit("xx")).otherwise(F.col("lang"))).withColumn("source", F.lit("s"))
    rows = lambda df: brute.order(tuple(r) for r in df.collect())
    assert rows(one) == rows(language_id.identify(lied))


def test_odd_texts(spark, odd_docs, no_docs, on_table):
    rows = on_table("op9_language_id", odd_docs, spark).collect()
    assert len(rows) == odd_docs.count()
    texts = odd_docs.select("doc_id", "text").collect()
    silent = {r.doc_id for r in texts if not any(c.isalpha() for c in r.text or "")} - {None}
    assert {r.doc_id for r in rows if r.lang_pred == "und"} - {None} == silent
    assert all(r.score == 0 for r in rows if r.lang_pred == "und")
    assert {r.lang_pred for r in rows} <= {"en", "de", "fr", "und"}
    assert on_table("op9_language_id", no_docs, spark).count() == 0
    unlabelled = odd_docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in on_table("op9_language_id", unlabelled, spark).collect()} == {"und"}


def check_scores(df, docs, held, tolerance, least=1):
    want = brute.order(brute.language_model(docs, held, least=least))
    got = brute.order((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in df.collect())
    assert [w[:4] for w in want] == [g[:4] for g in got]
    for w, g in zip(want, got, strict=True):
        assert g[4] == pytest.approx(w[4], rel=1e-9)
        assert abs(g[5] - w[5]) <= tolerance * w[1]  # probabilities are quantised
    return want, got


@pytest.mark.parametrize("table", ["small_docs", "odd_docs"])
def test_scores(spark, table, on_table, request):
    docs = request.getfixturevalue(table)
    check_scores(on_table("op4_lm_scoring", docs, spark), plain(docs), lambda i: brute.in_fold(i, 7, 2), 0.05)


def test_small_files_and_split_contexts(spark, small_docs, monkeypatch):
    for name, value in (("LEVEL_ROWS", 300), ("SHARD_TOKENS", 500), ("FLUSH_PAIRS", 2000), ("MEMO_WORDS", 500), ("PART_BYTES", 9000)):
        monkeypatch.setattr(lm_scoring, name, value)
    docs = small_docs.filter("doc_id < 60")
    check_scores(lm_scoring.score_texts(docs, F.col("doc_id") % 4 != 1), plain(docs), lambda i: i % 4 == 1, 0.05)


def test_rare_bigrams_left_out(spark, small_docs):
    docs = small_docs.filter("doc_id < 60")
    found = lm_scoring.score_texts(docs, F.col("doc_id") % 4 != 1, min_count=2)
    check_scores(found, plain(docs), lambda i: i % 4 == 1, 0.05, least=2)


def test_bigrams_help(spark, small_docs, on_table):
    rows = on_table("op4_lm_scoring", small_docs, spark).filter("held_out").collect()
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_nothing_to_learn_from(spark, odd_docs, no_docs, on_table):
    assert on_table("op4_lm_scoring", no_docs, spark).count() == 0
    rows = lm_scoring.score_texts(odd_docs, F.lit(False)).collect()
    assert {(r.n_known, r.train_tokens, r.base_score, r.score) for r in rows} == {(0, 0, 0.0, 0.0)}


@pytest.mark.parametrize("table", ["small_docs", "odd_docs"])
def test_bigrams_seen_once_count(spark, table, on_table, request):
    docs = request.getfixturevalue(table)
    held = lambda i: brute.in_fold(i, 7, 2)
    whole = brute.order(brute.language_model(plain(docs), held, least=1))
    got = brute.order(tuple(r)[:6] for r in on_table("op4_lm_scoring", docs, spark).collect())
    assert [w[:4] for w in whole] == [g[:4] for g in got]
    for w, g in zip(whole, got, strict=True):
        assert g[4] == pytest.approx(w[4], rel=1e-9)
        assert abs(g[5] - w[5]) <= 0.05 * w[1]  # probabilities are quantised


def test_words_of_arrow_are_those_of_bytes():
    """White space of ASCII only, A-Z lowered only, an end behind each text, texts without words."""
    texts = ["", " \n", "a  b\x1cc\x0b d\xa0e \x00 é\u2003x\x85y", "A É\tÀ a\r", "\f", "one", ""]
    low = pa.array([t.translate({x: x + 32 for x in range(65, 91)}) for t in texts])
    hashes, found, sizes = lm_scoring._tokens(low)
    wanted = [[*t.encode().split(), lm_scoring.END] for t in low.to_pylist()]
    assert sizes.tolist() == list(map(len, wanted))
    assert hashes[found].tolist() == [xxhash.xxh64_intdigest(w) for t in wanted for w in t]
    hashes, found, sizes = lm_scoring._tokens(low[:0])
    assert len(hashes) == 1 and not len(found) and not len(sizes)


def test_a_lookup_decodes_few_values_for_each_asked():
    """In long sequences, where each value that is asked for stands in a block of its own."""
    values = np.arange(200_000, dtype=np.uint64) * np.uint64(977)
    held = elias_fano.sequence("x", elias_fano.named("x", elias_fano.encode(values)))
    decoded = []
    plain = held.decode
    held.decode = lambda blocks: (decoded.append(len((found := plain(blocks))[0])), found)[1]
    wanted = values[5::1000]
    for part, position, value in held.successors(wanted):
        assert (value == wanted[part]).all() and (position == np.arange(len(values))[5::1000][part]).all()
    assert sum(decoded) <= 16 * len(wanted)
