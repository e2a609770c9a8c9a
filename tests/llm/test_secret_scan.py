import hashlib
import re
from collections import Counter
from math import log2
from uuid import uuid4

import brute
import duckdb
import pytest
from pyspark.sql import functions as F

from assayline.llm import queries, secret_scan

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base_of(text):
    """The fixed rules as stated: all matches, then those that are long enough."""
    found = [("assign", m) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [("access", m) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [("hex", m) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return [(m.start(), secret_scan.BASE_KINDS.index(k), m.end(), k) for k, m in found]


def added_of(text):
    """Every window of every candidate, counted anew."""
    spans = []
    for c in re.finditer("[A-Za-z0-9+/_-]{20,}", text):
        if any(re.fullmatch(a.replace("*+", "*"), c[0]) for a in secret_scan.ALLOWED):
            continue
        kind = 3 if re.fullmatch("[0-9A-Fa-f]+", c[0]) else 4
        least = secret_scan.HEX_BITS if kind == 3 else secret_scan.MIXED_BITS
        own = []
        for w in range(len(c[0]) - 19):
            counts = Counter(c[0][w : w + 20]).values()
            if -sum(n / 20 * log2(n / 20) for n in counts) < least - 1e-7:
                continue
            if own and own[-1][1] >= w:
                own[-1][1] = w + 20
            else:
                own.append([w, w + 20])
        names = secret_scan.ENTROPY_KINDS
        spans += [(c.start() + b, kind, c.start() + e, names[kind - 3]) for b, e in own]
    return spans


def joined(spans):
    return ",".join(f"{kind}:{begin}:{end}" for begin, _, end, kind in sorted(spans))


def expected(doc_id, text):
    base = base_of(text or "")
    n = Counter(s[3] for s in base)
    digest = hashlib.sha256(joined(base).encode()).hexdigest()
    return doc_id, n["assign"], n["access"], n["hex"], digest, joined(base + added_of(text or ""))


def check(df, texts):
    assert df.columns == ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]
    assert brute.order(tuple(r) for r in df.collect()) == brute.order(expected(*t) for t in texts)


KEY = "zX9/kLm3Qw8vBn2RtY7uIo4p"
ODD = [
    "token=a token: abcdefgh",
    "secret=token:abcdefgh12",  # the short match is dropped and still takes up its place
    "PassWord'  =  'abc.def-ghi/' and API_KEY=\"12345678\" apikey::::12345678 apikey==12345678",
    "toKen=abcdefgh ſecret=abcdefgh",  # letters that only fold to ASCII ones
    "AKIAABCDEFGHIJK AKIAABCDEFGHIJKL xAKIAAKIAABCDEFGHIJ1é AKIA",
    "é\U0001fae9 " + "0123456789abcdef" * 2 + " " + "f" * 31 + " " + "a" * 32,
    f"é {KEY} x",
    KEY + "a" * 60 + KEY,  # two spans in one candidate
    "x" * 9000 + KEY * 400,  # across pieces
    "a-" * 50_000 + "b",  # a slug of any length is no secret
    "/usr/local/share/python3/site-packages 12345678901234567890 123e4567-e89b-12d3-a456-426614174000",
    ("token=a " * 20_000) + "token=abcdefgh",
    "9233A8ECF7C5B09FE5949719B6B82BC439E9329B",
    "A" * 30_000,
]


def test_odd_texts(spark, on_table):
    texts = [(i, t) for i, t in enumerate(ODD)] + [(None, None), (None, ""), (3, ODD[3]), (3, ODD[3])]
    table = spark.createDataFrame(texts, "doc_id long, text string").withColumn("base", F.lit("x")).withColumn("id", F.lit("y"))
    check(on_table("op13_secret_scan", table, spark), texts)


@pytest.mark.parametrize("docs", ["odd_docs", "no_docs"])
def test_odd_tables(spark, on_table, docs, request):
    table = request.getfixturevalue(docs)
    check(on_table("op13_secret_scan", table, spark), [tuple(r) for r in table.select("doc_id", "text").collect()])


def test_whole_table(spark, small_docs):
    folder = "/root/testdata/sf0.01"
    texts = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    check(queries.op13_secret_scan(spark, folder), [tuple(r) for r in texts])


def test_sql(spark, on_table):
    """The SQL agrees on the odd texts too; long ones apart, which it counts window by window."""
    table = spark.createDataFrame([(i, t) for i, t in enumerate(ODD) if len(t) < 2000], "doc_id long, text string")
    frame = table.toPandas()
    con = duckdb.connect()
    con.register("documents", frame)
    got = brute.order(tuple(r) for r in on_table("op13_secret_scan", table, spark).collect())
    assert got == brute.order(con.sql(queries.ORACLE_SQL["op13_secret_scan"]).fetchall())


def test_allow_list_and_thresholds(spark):
    table = spark.createDataFrame([(1, f"{KEY} {uuid4()}")], "doc_id long, text string")
    spans = lambda **given: [s.kind for s in secret_scan.scan(table, **given).first().spans]
    assert spans() == ["mixed_entropy"]
    assert spans(allowed=["zX9.*", *secret_scan.ALLOWED]) == []
    assert spans(mixed_bits=4.33) == []
    assert "mixed_entropy" in spans(allowed=[], mixed_bits=2.5)


def test_no_python_worker(spark, small_docs):
    plan = secret_scan.scan(small_docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Exchange", plan)
