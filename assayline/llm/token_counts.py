"""Token counts by the whole-token shortcut.

Before the job starts, `prove_whole_tokens` encodes every string of the vocabulary alone and keeps those that the library
splits into one pre-token and encodes as one token. In the tasks a pre-token of that set counts as one; only the others are
merged, once per distinct pre-token of a task, up to a bound of memory. Rows are independent: there is no shuffle, and a lost
task is computed again.

The vocabulary file and the proven strings are sent to the executors; their size is that of the vocabulary, not of the data.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from assayline.llm.pretokens import CLASS_MARKS, Splitter, byte_letters

MEMO_ENTRIES = 400_000
MEMO_CHARS = 64


def prove_whole_tokens(vocabulary: str) -> set[str]:
    """The texts that the library, given each alone, encodes as the single token they are in the vocabulary."""
    tokenizer = Tokenizer.from_str(vocabulary)
    byte_of = {letter: b for b, letter in enumerate(byte_letters())}
    proven = set()
    for token, ident in json.loads(vocabulary)["model"]["vocab"].items():
        try:
            text = bytes(byte_of[x] for x in token).decode()
        except (KeyError, UnicodeDecodeError):
            continue
        pieces = tokenizer.pre_tokenizer.pre_tokenize_str(text)
        if len(pieces) == 1 and [t.id for t in tokenizer.model.tokenize(token)] == [ident]:
            proven.add(text)
    return proven


class PieceCounts(dict):
    """Tokens by pre-token: proven strings count one, others are merged by the library's model when first seen."""

    def __init__(self, tokenizer: Tokenizer, proven: set[str]):
        super().__init__(dict.fromkeys(proven, 1))
        self.proven = proven
        self.model = tokenizer.model
        self.letters = byte_letters()

    def __missing__(self, piece: str) -> int:
        count = len(self.model.tokenize("".join([self.letters[b] for b in piece.encode()])))
        if len(piece) <= MEMO_CHARS:
            if len(self) > len(self.proven) + MEMO_ENTRIES:
                self.clear()
                self.update(dict.fromkeys(self.proven, 1))
            self[piece] = count
        return count


class WordCounts(dict):
    """Tokens by word behind a blank."""

    def __init__(self, split: Splitter, pieces: PieceCounts):
        super().__init__()
        self.split, self.pieces = split, pieces

    def __missing__(self, word: str) -> int:
        count = sum(map(self.pieces.__getitem__, self.split(" " + word)))
        if len(word) <= MEMO_CHARS:
            if len(self) > MEMO_ENTRIES:
                self.clear()
            self[word] = count
        return count


def _library_class(tokenizer: Tokenizer) -> Callable[[str], str]:
    split = tokenizer.pre_tokenizer.pre_tokenize_str
    return lambda char: next((m for m in CLASS_MARKS if len(split(m + char)) == 1), " ")


def text_counter(vocabulary: str, proven: set[str], pattern: str) -> Callable[[str], int]:
    """A function that counts the tokens of a text; special strings inside it are single tokens, as the library has it."""
    tokenizer = Tokenizer.from_str(vocabulary)
    special = [t for t in json.loads(vocabulary)["added_tokens"]]
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in special):
        raise ValueError("added tokens that look at their neighbours are not supported")
    contents = sorted((t["content"] for t in special), key=len, reverse=True)
    at_special = regex.compile("|".join(map(regex.escape, contents))) if contents else None
    pieces = PieceCounts(tokenizer, proven)
    split = Splitter(pattern, _library_class(tokenizer))
    words = WordCounts(split, pieces)

    def plain(text: str) -> int:
        first, *others = split.words(text)
        return sum(map(pieces.__getitem__, split(first))) + sum(map(words.__getitem__, others))

    def count(text: str) -> int:
        if at_special is None or not any(c in text for c in contents):
            return plain(text)
        parts = at_special.split(text)
        return len(parts) - 1 + sum(map(plain, parts))

    return count


def count_tokens(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    vocabulary_path: str | None = None,
    pattern: str | None = None,
    limit: int = 1024,
) -> DataFrame:
    """Bytes and tokens of every whole text.

    Returns id_col, n_bytes, n_tokens and over_limit (n_tokens > limit), a row per row of docs: repeated rows and null ids
    are kept, a null or empty text has 0 bytes and 0 tokens, other columns are left out, an empty table gives an empty one.
    """
    vocabulary = open(vocabulary_path or public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8").read()
    pattern = pattern or public_tokenizers.PATTERN
    sent = docs.sparkSession.sparkContext.broadcast((vocabulary, prove_whole_tokens(vocabulary)))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    schema = rows.select("id", F.lit(0).cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_tokens")).schema

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = text_counter(*sent.value, pattern)
        for batch in batches:
            texts = batch.column("text")
            tokens = pa.array([count(t) for t in texts.to_pylist()], pa.int64())
            size = pc.binary_length(texts).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("id"), size, tokens], names=["id", "n_bytes", "n_tokens"])

    return rows.mapInArrow(counted, schema).select(
        F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )
