"""Shards in any number with few files open."""

import resource

import brute
import numpy as np
from conftest import plain
from pyspark.sql import functions as F

from assayline.llm import elias_fano, lm_scoring, suffix_dedup
from assayline.llm.storage import shared_uri


def test_thousands_of_files_under_a_limit(tmp_path):
    places = [elias_fano.save(str(tmp_path), "x", {"a": np.arange(i), "b": np.full((2, i % 3), i, np.int16)}) for i in range(5000)]
    before = resource.getrlimit(resource.RLIMIT_NOFILE)
    resource.setrlimit(resource.RLIMIT_NOFILE, (256, before[1]))
    try:
        with elias_fano.Opened() as files:
            for _ in range(2):
                for i, place in enumerate(places):
                    arrays = files.get(place)
                    assert arrays["a"].sum() == i * (i - 1) // 2 and arrays["b"].shape == (2, i % 3) and (arrays["b"] == i).all()
            assert len(files.held) == elias_fano.OPEN_FILES
            assert files.get(places[-1]) is files.get(places[-1])
    finally:
        resource.setrlimit(resource.RLIMIT_NOFILE, before)


def test_a_file_is_copied_once(tmp_path, monkeypatch):
    """On a file system that is not mounted."""
    place = elias_fano.save(f"file:{tmp_path}", "x", {"a": np.arange(9)})
    system, path = elias_fano._system(place)
    other = elias_fano.fs.SubTreeFileSystem(str(tmp_path), system)
    monkeypatch.setattr(elias_fano, "_system", lambda p: (other, path.rpartition("/")[2]))
    copied = []
    monkeypatch.setattr(elias_fano.fs, "copy_files", lambda a, b, **k: (copied.append(a), open(b, "wb").write(open(path, "rb").read())))
    with elias_fano.Opened(limit=1) as files:
        for _ in range(3):
            files.held.clear()
            assert files.get(place)["a"].sum() == 36
    assert len(copied) == 1


def test_the_shared_folder_is_one_for_spark_and_tasks(spark):
    folder = shared_uri(spark)
    assert folder.startswith("file:") and elias_fano._system(folder)[1].startswith("/")


def test_suffix_shards_with_few_open_files(spark, small_docs, monkeypatch):
    monkeypatch.setattr(elias_fano, "OPEN_FILES", 2)
    docs = small_docs.filter("doc_id < 80")
    found = suffix_dedup.remove_repeats(docs, shard_bytes=500).select(
        "doc_id", "n_bytes", F.size("spans").alias("n"), F.sha2("kept", 256).alias("kept")
    )
    got = {r.doc_id: (r.n_bytes, r.n, r.kept) for r in found.collect()}
    assert got == {i: (n, spans, sha) for i, n, _, spans, sha in brute.cut(plain(docs))}


def test_language_model_with_few_open_files(spark, small_docs, monkeypatch):
    docs = small_docs.filter("doc_id < 60")
    for name, value in (("LEVEL_ROWS", 100), ("SHARD_TOKENS", 200), ("PART_BYTES", 9000)):
        monkeypatch.setattr(lm_scoring, name, value)
    many = {r.doc_id: r.score for r in lm_scoring.score_texts(docs, F.col("doc_id") % 4 != 1).collect()}
    monkeypatch.setattr(elias_fano, "OPEN_FILES", 1)
    few = {r.doc_id: r.score for r in lm_scoring.score_texts(docs, F.col("doc_id") % 4 != 1).collect()}
    assert few == many and len(few) == docs.count()


def test_too_many_words_for_pair_numbers_are_refused(spark):
    import pytest

    level = lm_scoring.Level1([], np.zeros(0, np.uint64), np.zeros(0, np.int64), 10, 4 * 10**9)
    with pytest.raises(ValueError, match="64 bits"):
        lm_scoring.shard_cuts(level, spark.range(1))


def test_results_of_many_shards_lie_in_few_files(spark, small_docs, monkeypatch):
    seen = []
    plain_cut = suffix_dedup.cut_repeats
    monkeypatch.setattr(suffix_dedup, "cut_repeats", lambda rows, *given: (seen.append(given[:3]), plain_cut(rows, *given))[1])
    docs = small_docs.filter("doc_id < 80")
    want = {i: (n, spans, sha) for i, n, _, spans, sha in brute.cut(plain(docs))}
    for hot in (1, suffix_dedup.HOT_SEGMENTS):
        found = suffix_dedup.remove_repeats(docs, shard_bytes=500, hot_segments=hot)
        found = found.select("doc_id", "n_bytes", F.size("spans").alias("n"), F.sha2("kept", 256).alias("kept"))
        assert {r.doc_id: (r.n_bytes, r.n, r.kept) for r in found.collect()} == want
    for anchors, starts, shards in seen:
        assert shards > 200
        for places in (anchors, starts):
            assert 1 < len(places) <= -(-shards // 64) and {len(x) for x in places.values()} == {1}
