"""The pipeline against plain versions of its stages."""

import hashlib
from collections import Counter

import brute
import pytest
from conftest import SMALL

import __spark_entry__ as entry_point
import corpus_pipeline as pipeline
from assayline.llm import language_id

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_stage(docs, model):
    letters = language_id.letter_table()
    out = []
    for i, text, lang, source, _ in docs:
        (name,), (score,) = language_id.score_texts([text], model, letters) if model else (["und"], [0.0])
        if name != "und":
            out.append((i, text, lang or name, source))
    return out


def simhash_stage(docs):
    """Of each group one row: that of the least id, one of those without id only if there are no others."""
    numbers = [(i is None, 0 if i is None else i, n) for n, (i, *_) in enumerate(docs)]
    groups = brute.groups(list(zip(numbers, [d[1] for d in docs], strict=True)))
    stay = {least[2] for _, _, least in groups}
    return [d for n, d in enumerate(docs) if n in stay]


def suffix_stage(docs):
    masks = brute.removed([(i, t) for i, t, *_ in docs])
    cut = [(i, brute.whole_characters(t, m), lang, s) for (i, t, lang, s), m in zip(docs, masks, strict=True)]
    return [d for d in cut if brute.words(d[1])]


def mixing_stage(docs):
    """Sources in the order of their keys; the whole epochs of the target, then those whose middle lies in the rest."""
    size = Counter()
    for _, text, _, source in docs:
        size[source] += len(brute.words(text))
    target = brute.targets(size)
    out = []
    for source, total in size.items():
        own = [d for d in docs if d[3] == source]
        own.sort(key=lambda d: (hashlib.md5(f"{'' if d[0] is None else d[0]}:mix".encode()).hexdigest()[:16], d[0] is not None, d[0]))
        epochs = int(target[source] // total)
        rest, done = target[source] - epochs * total, 0
        for d in own:
            n = len(brute.words(d[1]))
            done += n
            out += [d] * min(epochs + (rest > 0 and done - n / 2 <= rest), 2)
    return out


def plain_run(docs, model):
    docs = mixing_stage(suffix_stage(simhash_stage(language_stage(docs, model))))
    return Counter((i, lang, s, tuple(brute.CODEC.encode_ordinary(t)), t) for i, t, lang, s in docs)


def staged(spark, docs, folder):
    for name, stage in pipeline.STAGES:
        docs = stage(spark, docs, SMALL)
        docs.write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if name != pipeline.STAGES[-1][0]:
            assert docs.columns == COLUMNS
    return docs


@pytest.mark.parametrize("table", ["small_docs", "odd_docs", "no_docs"])
def test_stages_match_plain_versions(spark, table, tmp_path, request):
    docs = request.getfixturevalue(table)
    if table == "odd_docs":
        docs = docs.filter("length(text) < 5000 or text is null")
    found = staged(spark, docs, str(tmp_path)).collect()
    assert all(r.n_tokens == len(r.ids) for r in found)
    model = language_id.train(docs, ~language_id.held_out("doc_id", 5, 0))
    rows = [tuple(r) for r in docs.select(*COLUMNS).collect()]
    assert Counter((r.doc_id, r.lang, r.source, tuple(r.ids), r.text) for r in found) == plain_run(rows, model)


def test_one_row_of_each_group_stays(spark):
    """Copies without id, repeated rows, two texts under one id, a near copy."""
    text = " ".join(f"word{i}" for i in range(300))
    other = " ".join(f"other{i}" for i in range(300))
    rows = [(None, text)] * 5 + [(None, other), (1, text), (1, text), (1, text), (2, other), (2, text + " end"), (3, "alone here")]
    rows += [(None, "no id at all")] * 3 + [(None, None), (None, ""), (4, "alone here too")]
    docs = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = pipeline.drop_near_duplicates(spark, docs.repartition(3), "")
    assert kept.columns == COLUMNS
    ids = Counter((r.doc_id, r.text) for r in kept.collect())
    empty = [k for k in ids if not k[1]]
    assert len(empty) == 1 and ids.pop(empty[0]) == 1
    assert ids == Counter([(1, text), (2, other), (3, "alone here"), (None, "no id at all"), (4, "alone here too")])


def test_short_texts_stay(spark, small_docs):
    """Of texts cut to a few words none goes that has letters."""
    from pyspark.sql import functions as F

    short = small_docs.withColumn("text", F.concat_ws(" ", F.slice(F.split("text", r"\s+"), 1, 1 + F.col("doc_id") % 3)))
    kept = pipeline.identify_language(spark, short.unionByName(small_docs.withColumn("doc_id", -1 - F.col("doc_id"))), SMALL)
    letters = short.filter(F.col("text").rlike(r"\p{L}"))
    assert kept.filter("doc_id >= 0").count() == letters.count() > 100


def test_run_is_registered(spark):
    assert [n for n, _ in pipeline.STAGES] == ["language_id", "simhash_near_dedup", "suffix_array_dedup", "source_mixing", "byte_bpe"]
    assert entry_point.queries()["pipeline"] is pipeline.run
    assert "pipeline" not in entry_point.oracle_sql()
    assert pipeline.run(spark, SMALL).count() > 100
