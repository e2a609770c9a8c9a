import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SMALL = "/root/testdata/sf0.001"
#: Names that operators use inside.
CLASHING = ("id", "rank", "size", "key", "range", "guest", "carried", "shard", "found", "fingerprint", "n_tokens", "block", "host")


@pytest.fixture(scope="session")
def small_docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Null and repeated ids and rows, null, empty, blank and long texts, null languages and sources, clashing columns."""
    texts = [
        (1, "The same text, twice over, and then some more of it to be long enough for a window.", "en", "a"),
        (2, "The same text, twice over, and then some more of it to be long enough for a window.", "en", "b"),
        (2, "The same text, twice over, and then some more of it to be long enough for a window.", "en", "b"),
        (3, None, "en", None),
        (4, "", None, "a"),
        (5, " \n\t ", "fr", "a"),
        (6, "12 34 !!", "de", "é"),
        (None, "kein Ausweis, aber ein Text", "de", "a"),
        (None, None, None, None),
        (7, "ein " * 30_000, "de", "a"),
        (8, "x" * 20_000, None, "Z"),
        (9, "日本語のテキスト \U0001fae9   \x00 \x1c ende", "de", "a"),
        (10, "one", "en", "b"),
        (-11, "The same TEXT, twice over, and then some more of it to be long enough for a window", "en", ""),
    ]
    rows = [(i, t, lang, s, None if t is None else len(t), *([None] * len(CLASHING))) for i, t, lang, s in texts]
    layout = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHING)
    return spark.createDataFrame(rows, layout).repartition(3)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.filter("false")


def plain(docs):
    """Ids and texts, null for empty."""
    return [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]


@pytest.fixture
def on_table(monkeypatch):
    """Runs a registered query over a given table."""
    from assayline.llm import queries

    def run(name, table, spark):
        with monkeypatch.context() as m:
            m.setattr(queries, "_table", lambda *_: table)
            return queries.QUERIES[name](spark, "")

    return run
