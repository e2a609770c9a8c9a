"""Removal of repeats against all windows, and the suffix sort against sorting."""

import random
import tempfile

import brute
import numpy as np
import pytest
from conftest import plain

from assayline.llm import elias_fano, induced_sort, suffix_dedup


@pytest.mark.parametrize("table", ["small_docs", "odd_docs", "no_docs"])
def test_whole_tables(spark, table, on_table, request):
    docs = request.getfixturevalue(table)
    if table == "odd_docs":
        docs = docs.filter("length(text) < 5000 or text is null")  # the brute-force version is slow
    found = on_table("op3_suffix_dedup", docs, spark)
    assert brute.order(tuple(r) for r in found.collect()) == brute.cut(plain(docs))


def pieced_texts():
    random.seed(5)
    base = ["".join(random.choice("ab cdefgé\0") for _ in range(300)) for _ in range(8)]
    docs = []
    for i in range(90):
        text = ""
        for _ in range(random.randint(0, 5)):
            at = random.randint(0, 250)
            text += random.choice(base)[at : at + random.randint(10, 250)]
            text += "".join(random.choice("xyz ") for _ in range(random.choice([0, 0, 20])))
        docs.append((i * 7 % 97, text))
    return [*docs, (200, "a" * 900), (201, "a" * 120), (202, "ab" * 90), (203, "ab" * 90 + "c"), (-5, "x" * 49), (204, "x" * 51)]


@pytest.mark.parametrize("settings", [{}, {"hot_segments": 0}, {"hot_segments": 3}, {"shard_bytes": 2000}, {"length": 31}])
def test_pieced_texts(spark, settings):
    docs = pieced_texts()
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    masks = brute.removed(docs, settings.get("length", 50))
    got = {r.doc_id: r for r in suffix_dedup.remove_repeats(df, carry=("text",), **settings).collect()}
    for (i, text), mask in zip(docs, masks, strict=True):
        kept = bytes(x for x, gone in zip(text.encode(), mask, strict=True) if not gone)
        assert bytes(got[i].kept) == kept
        assert sum(s.end - s.begin for s in got[i].spans) == sum(mask)
        assert got[i].text == text
    whole = suffix_dedup.remove_repeats(df, whole_characters=True, **settings)
    texts = {r.doc_id: bytes(r.kept).decode() for r in whole.collect()}
    assert texts == {i: brute.whole_characters(t, m) for (i, t), m in zip(docs, masks, strict=True)}


def test_small_parts(spark, monkeypatch):
    for name, value in (("CHUNK_BYTES", 700), ("PART_BYTES", 2000), ("TEXT_BYTES", 300)):
        monkeypatch.setattr(suffix_dedup, name, value)
    docs = pieced_texts()
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: bytes(r.kept) for r in suffix_dedup.remove_repeats(df).collect()}
    for (i, text), mask in zip(docs, brute.removed(docs), strict=True):
        assert got[i] == bytes(x for x, gone in zip(text.encode(), mask, strict=True) if not gone)


def sorted_suffixes(text, depth):
    order = sorted(range(len(text) - 1), key=lambda i: text[i:], reverse=True)
    common = [0] if order else []
    for a, b in zip(order[:-1], order[1:], strict=True):
        n = 0
        while n < depth and max(a, b) + n < len(text) and text[a + n] == text[b + n]:
            n += 1
        common.append(n)
    return order, common


@pytest.mark.parametrize("queues", [0, 3, 4096])
@pytest.mark.parametrize("held", [64, 1 << 20])
def test_induced_sort(monkeypatch, queues, held):
    monkeypatch.setattr(induced_sort, "QUEUES", queues)  # names by doubling, by either, by recursion
    monkeypatch.setattr(induced_sort, "HELD_BYTES", held)  # queues in files, in memory
    random.seed(queues)
    with tempfile.TemporaryDirectory() as folder:
        for trial in range(250):
            symbols = random.choice([1, 2, 3, 200])
            text = [random.randint(1, symbols) for _ in range(random.randint(0, 50))]
            text = (text * random.choice([1, 1, 3])) + [0]
            array = np.array(text, np.uint16)
            order, common = induced_sort.sort_suffixes(array, 500, folder)
            assert (list(order), list(common)) == sorted_suffixes(text, 500)
            order, common = induced_sort.sort_suffixes(array, 5, folder)
            want, lengths = sorted_suffixes(text, 5)
            assert [text[i : i + 5] for i in order] == [text[i : i + 5] for i in want]
            assert list(common) == lengths


def test_elias_fano():
    random.seed(3)
    for trial in range(60):
        top = random.choice([5, 300, 1 << 20, 1 << 50, (1 << 64) - 1])
        values = sorted(random.randint(0, top) for _ in range(random.choice([0, 1, 127, 128, 129, 1000])))
        sequence = elias_fano.Sequence(elias_fano.encode(np.array(values, np.uint64)))
        if values:
            spots = np.array(sorted(random.sample(range(len(values)), min(50, len(values)))), np.int64)
            assert sequence.at(spots).tolist() == [values[i] for i in spots]
        wanted = np.array(sorted(random.choice([random.randint(0, top), *values[:1], *values[-1:]]) for _ in range(40)), np.uint64)
        for part, position, value in sequence.successors(wanted):
            for w, p, v in zip(wanted[part].tolist(), position.tolist(), value.tolist(), strict=True):
                at = next((i for i, x in enumerate(values) if x >= w), len(values))
                assert (p == at or (p < len(values) and values[p] == values[at])) and v == (values[at] if at < len(values) else 0)


def test_few_anchors_are_looked_up_without_decoding_the_others(tmp_path, monkeypatch):
    anchors = np.arange(1, 300_000, dtype=np.uint64) * np.uint64(2**45)
    place = suffix_dedup.save(str(tmp_path), "anchors", suffix_dedup.encode(anchors))
    decoded = []
    plain_decode = elias_fano.Sequence.decode
    monkeypatch.setattr(
        elias_fano.Sequence, "decode", lambda s, blocks: (decoded.append(len((x := plain_decode(s, blocks))[0])), x)[1]
    )
    wanted = np.concatenate([anchors[7::3000], anchors[7::3000] + np.uint64(1)])
    with suffix_dedup._files({0: [place]}) as files:
        known = suffix_dedup._known(wanted, files, 1)
    assert known.tolist() == [True] * (len(wanted) // 2) + [False] * (len(wanted) // 2)
    assert sum(decoded) <= 16 * len(wanted)


def test_a_part_without_segments_asks_for_no_shard(spark):
    """Texts shorter than the length, which have no window, beside others."""
    assert list(suffix_dedup._by_shard(np.zeros(0, np.int64))) == []
    assert list(suffix_dedup._by_shard(np.array([1, 1, 4]))) == [(1, 0, 2), (4, 2, 3)]
    docs = [(1, "short"), (2, None), (3, "x" * 70), (4, "y" + "x" * 60)]
    df = spark.createDataFrame(docs[:2], "doc_id long, text string").union(spark.createDataFrame(docs[2:], "doc_id long, text string"))
    found = suffix_dedup.remove_repeats(df).collect()
    assert {r.doc_id: bytes(r.kept).decode() for r in found} == {1: "short", 2: "", 3: "x" * 70, 4: "y"}


def test_exploded_windows_are_not_broadcast(spark, tmp_path):
    rows = [(0, bytes([65 + i % 20]) * (50 + i % 30), i, i + 1) for i in range(300)]
    distinct = spark.createDataFrame(rows, "shard int, segment binary, least long, greatest long")
    done = suffix_dedup.write_hot_starts(distinct, str(tmp_path), 50)
    done.collect()
    plan = done._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
