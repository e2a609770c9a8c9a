import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from assayline.llm import queries, spelling

FOLD = str.maketrans({c: chr(ord(c) + 32) for c in spelling.UPPER})


def counted(texts):
    out = Counter()
    for doc_id, text in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(FOLD)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            out[run] += 1
    return {w: n for w, n in out.items() if len(w) >= 7 and n >= 2}


def one_edit(a, b):
    """Whether an insertion, a deletion or a replacement makes b of a, by trying the places."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) - len(short) == 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def pairs(words):
    """All near pairs: candidates share a word with one code point left out, and are tried."""
    gaps = defaultdict(set)
    for w in words:
        for g in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))}:
            gaps[g].add(w)
    near = defaultdict(set)
    for met in gaps.values():
        for a in met:
            near[a] |= {b for b in met if b != a and b not in near[a] and one_edit(a, b)}
    return near


def expected(n, ratio=10):
    near = pairs(n)
    form = {}
    for w in n:
        best = min(near[w], key=lambda o: (-n[o], o), default=None)
        form[w] = best if best is not None and n[best] >= ratio * n[w] else None
    rows = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        rows.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(rows)


def check(df, texts):
    assert df.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert sorted(tuple(r) for r in df.collect()) == expected(counted(texts))


def test_near_pairs_by_trying_all():
    words = ["abcdefg", "abcdefgh", "xabcdefg", "abcdxefg", "abcdeff", "bcdefgh", "aaaaaaa", "aaaaaaaa", "aaaaaaab", "abababab"]
    near = pairs(words)
    assert {(a, b) for a in words for b in near[a]} == {(a, b) for a in words for b in words if one_edit(a, b)}


def test_whole_table(spark):
    folder = "/root/testdata/sf0.01"
    texts = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    check(queries.op11_spelling(spark, folder), [tuple(r) for r in texts])


@pytest.mark.parametrize("docs", ["odd_docs", "no_docs"])
def test_odd_tables(spark, on_table, docs, request):
    table = request.getfixturevalue(docs)
    check(on_table("op11_spelling", table, spark), [tuple(r) for r in table.select("doc_id", "text").collect()])


def odd_texts():
    """Chains of forms, ties, letters beyond ASCII, near words of every kind, very long words, a null id."""
    texts = [(None, "Straßen straßen STRASSEN strasen ×÷éÉxyzw " * 3), (1, None), (2, "")]
    for word, n in (("colourings", 2000), ("colouring", 30), ("colourin", 2), ("colourzin", 2), ("abcdefgh", 20), ("abcdefgi", 20), ("abcdefgj", 2)):
        texts += [(1000 + i, f"{word} {word.upper()}") for i in range(n // 2)]
    long = "lang" * 9000
    texts += [(7, f"{long} {long} {long}x {long}x x{long[:-1]}y x{long[:-1]}y")]
    return texts + [(8, "aaaaaaa aaaaaaaa aaaaaaaaa abababab babababa aabababab " * 2)] * 2


@pytest.mark.parametrize("small", [False, True])
def test_odd_texts(spark, on_table, monkeypatch, small):
    """With small pieces every word is in a large group, which is cut into blocks and tiles."""
    if small:
        for name, value in (("GROUP", 3), ("BLOCK", 2), ("BLOCK_CODES", 40)):
            monkeypatch.setattr(spelling, name, value)
    texts = odd_texts()
    table = spark.createDataFrame(texts, "doc_id long, text string")
    for name in ("word", "n", "id", "key", "run"):
        table = table.withColumn(name, F.lit("?"))
    check(on_table("op11_spelling", table, spark), texts)


@pytest.mark.parametrize("broadcast", [100, 0])
def test_hot_groups(spark, monkeypatch, broadcast):
    """A third of all words shares the first and last letters."""
    for name, value in (("GROUP", 16), ("BLOCK", 8), ("BROADCAST_KEYS", broadcast)):
        monkeypatch.setattr(spelling, name, value)
    alike = {f"commencement{a}{b}ation": 2 + (i * 7 + j) ** 2 for i, a in enumerate("abcdefgh") for j, b in enumerate("xyzvw")}
    other = {f"{a}word{b}{b}{a}ing": 3 + i for i, a in enumerate("abcdefghij") for b in "klmnopqr"}
    n = {**alike, **other}
    words = spark.createDataFrame(list(n.items()), "word string, n long")
    sizes = [r["count"] for r in spelling._tiles(spelling._filed(words)).groupBy("key", "i", "j", "side").count().collect()]
    assert max(sizes) <= 32 < len(alike)
    got = spelling.near_words(words).collect()
    want = {(w, n_near, form, form_n) for w, form, _, _, n_near, form_n in expected(n)}
    assert {(r.word, r.n_near, r.form, r.form_n) for r in got} == want and len(got) == len(n)
